import json
import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isotrek.llm.notebooks import segments, sniff
from isotrek.llm.passages import PassageFinder, find_in_text, fold, leaked_passages, words_of
from tests.conftest import rows

PROMPT = "On day 18 the keeper Tokleki moved 454 salt blocks from Treku to the hall of Trotulu, yet Vuza paid only 159 coins."


def book(*cells):
    return json.dumps({"cells": [{"cell_type": k, "source": s, **({"outputs": o} if k == "code" else {})} for k, s, o in cells]})


def test_notations():
    text = book(("markdown", ["a\n", "b"], None), ("code", "x = 1", [{"output_type": "stream", "text": ["o\n", "p"]}, {"data": {"text/plain": ["q"], "image/png": "AAAA"}}, {"ename": "E", "evalue": "v", "traceback": ["t1", "t2"]}]))
    assert [(s.part, s.kind, s.text) for s in segments(text, "ipynb")] == [("source", "text", "a\nb"), ("source", "code", "x = 1"), ("output", "code", "o\np"), ("output", "code", "q"), ("output", "code", "t1\nt2"), ("output", "code", "v")]
    broken = segments(text[:-20], None)
    assert [s.text for s in broken][:3] == ["a\nb", "x = 1", "o\np"]
    percent = "# ---\n# jupyter:\n# ---\r\n\r\n# %% [markdown]\n# # Title\n# prose\n\n# %%\nx = 1\n\n#> out\n#! err\n"
    assert [(s.part, s.kind, s.text) for s in segments(percent, "percent")] == [("source", "text", "# Title\nprose"), ("source", "code", "x = 1\n"), ("output", "code", "out\nerr")]
    md = "# T\n\nprose\n\n```python\nx = 1\n```\n\n    out\n\n    more\n\nnext\n"
    assert [(s.part, s.kind, s.text) for s in segments(md, "md_export")] == [("source", "text", "# T\n\nprose"), ("source", "code", "x = 1"), ("output", "code", "out\n\nmore"), ("source", "text", "next")]
    log = "[text]\nprose\n\nIn [2]:\nx\n\nOut[2]:\ny\n"
    assert [(s.cell, s.part, s.kind, s.text) for s in segments(log, "log")] == [(1, "source", "text", "prose"), (2, "source", "code", "x"), (2, "output", "code", "y")]
    assert [sniff(t) for t in (text, percent, md, log)] == ["ipynb", "percent", "md_export", "log"]
    assert segments(None, None) == segments("", "log") == segments(" \n", "ipynb") == []


def brute(items, parts, n=12):
    found = set()
    for s in parts:
        hay = words_of(s.text)
        runs = {tuple(hay[i : i + n]) for i in range(len(hay) - n + 1)}
        for item, prompt in items:
            w = words_of(prompt)
            if any(tuple(w[i : i + n]) in runs for i in range(len(w) - n + 1)):
                found.add(item)
    return found


def test_leaks(spark):
    r = random.Random(2)
    words = PROMPT.split()
    items = [(1, PROMPT), (2, "short one"), (3, None), (4, " ".join(words[5:] + ["and", "other", "words", "after", "it"])), (5, "x" * 100_000)]
    docs = []
    for i in range(60):
        a, b = sorted(r.sample(range(len(words) + 1), 2))
        piece = " ".join(words[a:b])
        wrapped = r.choice([piece.upper(), piece.replace(" ", "\n# "), "**" + piece.replace(" ", "** **") + "**", piece.replace(" ", '" "'), piece])
        cells = [("markdown", "filler words here", None), r.choice([("code", f'p = "{wrapped}"', []), ("markdown", wrapped, None), ("code", "x", [{"text": ["a ", wrapped]}])])]
        docs.append((i, book(*cells), "ipynb"))
    half = len(words) // 2
    docs += [(100, book(("markdown", " ".join(words[:half]), None), ("markdown", " ".join(words[half:]), None)), "ipynb"), (101, None, None), (102, "", "log"), (103, PROMPT, None), (103, PROMPT, None), (104, "y " * 100_000 + PROMPT, "md_export")]
    df = spark.createDataFrame(docs, "doc_id long, text string, nb_format string").withColumn("item_id", F.lit("clash"))
    want = sorted({(d, i) for d, t, f in docs for i in brute([x for x in items if x[1]], segments(t, f))})
    queries = spark.createDataFrame(items, "item_id long, prompt string").withColumn("doc_id", F.lit(7))
    found = leaked_passages(df, queries)
    assert rows(found.select("doc_id", "item_id").distinct()) == sorted(want, key=lambda t: tuple(map(str, t))) and len(want) > 15
    assert rows(leaked_passages(df, queries, block_chars=40_000).select("doc_id", "item_id").distinct()) == rows(found.select("doc_id", "item_id").distinct())
    spans = found.filter("doc_id = 103 and item_id = 1").first()
    assert PROMPT[spans.first_char : spans.last_char] == PROMPT[:-1] and spans.n_words == len(words_of(PROMPT))
    assert leaked_passages(df.limit(0), queries).collect() == [] and leaked_passages(df, queries.limit(0)).collect() == []


def test_runs_are_merged():
    finder = PassageFinder([(1, "prompt", "a b c d e f")], 3)
    assert finder.hits("x a b c d y b c d e f".split()) == [((1, "prompt"), 1, 4), ((1, "prompt"), 6, 10)]


def test_offsets_map_back_where_folding_changes_lengths():
    prompt = "İzmir café one two three four five six seven eight nine ten eleven"
    finder = PassageFinder([(1, "prompt", prompt)], 12)
    for text in (f"İİ x. {prompt}!", f"e\u0301İ. {unicodedata.normalize('NFD', prompt)}, end", f"plain {prompt.replace('İ', 'İ')}", f"각 {prompt}"):
        (found,) = find_in_text(finder, text)
        item, field, a, b, n = found
        assert (item, field) == (1, "prompt") and unicodedata.normalize("NFC", text[a:b]) == prompt and n == len(words_of(prompt))


def test_answers_are_patterns_too(spark):
    answer = "because the salt was weighed twice and the second scale was found to be false"
    df = spark.createDataFrame([(1, f"so {answer.upper()}.", "log"), (2, PROMPT, "log")], "doc_id long, text string, nb_format string")
    items = spark.createDataFrame([(7, PROMPT, answer), (8, None, None)], "item_id long, prompt string, answer string")
    for size in (1_000_000, 50):
        assert rows(leaked_passages(df, items, block_chars=size).select("doc_id", "item_id", "field")) == [(1, 7, "answer"), (2, 7, "prompt")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aİé e\u0301\u0308ßΣK각\u1100\u1161x.", max_size=20))
def test_folding_places(text):
    folded, places = fold(text)
    assert places is None or (len(places) == len(folded) + 1 and places == sorted(places) and places[-1] == len(text))
    assert places is not None or len(folded) == len(text)
