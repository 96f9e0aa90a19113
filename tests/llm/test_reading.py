import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotrek.llm.reading import GRADES, graded_profiles, harmonic_levels, prose_lines, prose_profiles, reading_grades, unlike

WORDS = {g: [f"{g[:3]}{'abcdefghij'[i]}" for i in range(10)] for g in GRADES}
COMMON = ["the", "of", "and", "to", "is"]


def prose(r, grade, n):
    level = GRADES.index(grade)
    out = []
    while len(out) < n:
        g = GRADES[max(0, min(3, level + r.choice([0] * 6 + [-1, 1])))]
        out.append(r.choice(COMMON) if r.random() < 0.4 else r.choice(WORDS[g]))
    return " ".join(out) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    graded = [(i, prose(r, g, 80), g) for i, g in enumerate(GRADES * 8)] + [(90, None, "primary"), (91, "x y z", "unknown"), (92, "", "research")]
    truth = {i: r.choice(GRADES) for i in range(120)}
    docs = [(i, f"# Head line\n\n{prose(r, g, 90)}\n\n```python\nx = 1\n```\n", "md_export") for i, g in truth.items()]
    docs += [(200, prose(r, "primary", 40), "md_export"), (201, None, None), (202, "", "log"), (203, "zq " * 80 + ".", None), (204, docs[0][1], "md_export"), (205, "word " * 200_000, "md_export")]
    schema = "doc_id long, text string, nb_format string"
    return truth, spark.createDataFrame(docs, schema).withColumn("level", F.lit("clash")), spark.createDataFrame(graded, "text_id int, passage string, grade string")


def test_held_out_grades(spark, corpus):
    truth, docs, graded = corpus
    got = {r.doc_id: (r.grade, r.difficulty) for r in reading_grades(docs, graded).collect()}
    assert np.mean([got[i][0] == g for i, g in truth.items()]) > 0.9
    assert 200 not in got and 201 not in got and 202 not in got and got[204] == got[0] and {203, 205} <= set(got)
    assert reading_grades(docs, graded.limit(0)).collect() == [] == reading_grades(docs.limit(0), graded).collect()


def test_sent_and_joined_rounds_agree(spark, corpus):
    _, docs, graded = corpus
    profiles = prose_profiles(docs, None).unionByName(graded_profiles(graded)).cache()
    a, b = ({r.doc_id: r.free for r in harmonic_levels(profiles, 0.02, n).collect()} for n in (10_000, 3))
    assert a.keys() == b.keys() and all((a[k] is None) == (b[k] is None) and (a[k] is None or abs(a[k] - b[k]) < 1e-9) for k in a)


def test_eval_passages_do_not_count(spark, corpus):
    truth, docs, graded = corpus
    passage = "Under the rule of Trasta a tax of 792 coins fell on barley sacks sold by Rogrotri near the old mill"
    items = spark.createDataFrame([(1, passage)], "item_id long, prompt string")
    extended = docs.withColumn("text", F.concat("text", F.lit(f"\n\n{passage}.\n")))
    plain = {r.doc_id: r.n_words for r in prose_profiles(docs.filter("doc_id < 120"), None).collect()}
    assert {r.doc_id: r.n_words for r in prose_profiles(extended.filter("doc_id < 120"), items).collect()} == plain
    several = spark.createDataFrame([(1, passage), (2, "other words " * 20), (3, "more words " * 20)], "item_id long, prompt string")
    one, many = ({r.doc_id: (r.n_words, sorted(zip(r.words, r.counts))) for r in prose_profiles(extended, several, block_chars=n).collect()} for n in (10**6, 100))
    assert one == many and len(one) > 100


def test_what_is_prose():
    text = "# Title here now\n\nThe cat sat down. It ran.\n\nsee below\n\n[link](http://a.b/c) is here\n\n$$ a b c d $$\n\n> quoted words are out\n\n    5%|███  | 4/788\n"
    assert list(prose_lines(text, "md_export")) == [["the", "cat", "sat", "down", "it", "ran"]]


def test_more_rounds_change_no_grade(spark, corpus):
    _, docs, graded = corpus
    few, many = ({r.doc_id: r.grade for r in reading_grades(docs, graded, residual=x).collect()} for x in (0.01, 0.0002))
    assert few.keys() == many.keys() and sum(few[k] != many[k] for k in few) <= 1
    x = np.random.default_rng(1).random(50)
    assert unlike(x, 3 * x + 2, np.ones(50)) < 1e-6 and unlike(x, x[::-1].copy(), np.ones(50)) > 0.5 and unlike(np.ones(3), np.ones(3), np.ones(3)) == 0.0
