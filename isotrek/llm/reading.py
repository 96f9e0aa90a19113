"""Reading level by harmonic propagation on the document-word graph.

Graded texts and documents are joined to the words they use (edge weight: occurrences times the
word's inverse document frequency). Grades are clamped at the graded texts; in each round a word takes
the weighted mean level of its documents and a document that of its words. A document's final level is
read against the levels that the graded texts get when they are let go in the last round, so the
contraction that comes with propagation falls out. Rounds end at a stated residual.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotrek.llm.notebooks import segments
from isotrek.llm.passages import BLOCK_CHARS, PassageFinder, digest, document_rows, finder_in_worker, in_slices, item_blocks, words_of
from isotrek.session import cut, ship, spread

GRADES = ("primary", "secondary", "undergraduate", "research")
MIN_WORDS = 60
#: Rounds end when the word levels of two rounds differ, up to scale and shift, by at most this share of their spread.
RESIDUAL = 0.01
#: Up to so many words the level of each is sent to the workers (some 10 MB); beyond, words and documents are joined.
SENT_WORDS = 500_000
EVAL_RUN = 8  # consecutive words of a test item that are no prose of the document
_NO_PROSE = ("#", "|", "$", "[", "!", "`", "<", ">")
PROFILE = "doc_id long, level double, n_words int, words array<string>, counts array<int>"


def prose_lines(text: str | None, nb_format: str | None) -> Iterator[list[str]]:
    """The words of each line of prose in the text cells: no headings, quotes, formulas, links, tables, progress bars or scraps of one or two words."""
    for s in segments(text, nb_format):
        if s.kind == "text" and s.part == "source":
            for line in s.text.split("\n"):
                line = line.strip()
                if line and not line.startswith(_NO_PROSE) and "%|" not in line:
                    words = words_of(line)
                    if len(words) > 2:
                        yield words


def prose_profiles(documents: DataFrame, items: DataFrame | None, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document with at least ``min_words`` words of prose: its words and how often each occurs; level is null.

    Words of runs of EVAL_RUN that a test item has do not count. One block of items is taken out while
    the texts are parsed; several are looked for in the lines of prose, which are written once.
    """
    sc = documents.sparkSession.sparkContext
    blocks = iter([[]]) if items is None else item_blocks(items, block_chars)
    block, after = next(blocks), next(blocks, None)
    rows = spread(document_rows(documents))
    if after is not None:
        return _profiles_of_lines(rows, itertools.chain([block, after], blocks), min_words)
    sent, key = sc.broadcast(block), digest(block)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = finder_in_worker(key, lambda: sent.value, EVAL_RUN)
        for batch in batches:
            ids, totals, words, counts = [], [], [], []
            for start in range(0, batch.num_rows, 256):
                for doc_id, text, nb_format in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                    found: Counter[str] = Counter()
                    for line in prose_lines(text, nb_format):
                        covered = _covered(finder, line)
                        found.update(w for i, w in enumerate(line) if w.isalpha() and i not in covered)
                    if (n := found.total()) >= min_words:
                        ids.append(doc_id), totals.append(n), words.append(list(found)), counts.append(list(found.values()))
            yield _profiles(ids, [None] * len(ids), totals, words, counts)

    return rows.mapInArrow(profile, PROFILE)


def _profiles_of_lines(rows: DataFrame, blocks: Iterator[list], min_words: int) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    split = lambda found: [(row, doc_id, i, line) for row, doc_id, text, nb_format in found for i, line in enumerate(prose_lines(text, nb_format))]
    schema, types = "row long, doc_id long, line int, words array<string>", [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), *rows.columns)
    lines, hits = cut(numbered.mapInArrow(in_slices(split, types, ["row", "doc_id", "line", "words"]), schema)), None
    for block in blocks:
        sent, key = sc.broadcast(block), digest(block)

        def look(found: list[tuple], sent=sent, key=key) -> list[tuple]:
            finder = finder_in_worker(key, lambda: sent.value, EVAL_RUN)
            return [(row, line, sorted(covered)) for row, _, line, words in found if (covered := _covered(finder, words))]

        part = cut(lines.mapInArrow(in_slices(look, [pa.int64(), pa.int32(), pa.list_(pa.int32())], ["row", "line", "covered"]), "row long, line int, covered array<int>"))
        sent.unpersist()
        hits = part if hits is None else hits.unionByName(part)
    covered = hits.groupBy("row", "line").agg(F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"))  # at most a line's words
    left = lines.join(covered, ["row", "line"], "left").withColumn("words", F.when(F.col("covered").isNull(), F.col("words")).otherwise(F.filter("words", lambda w, i: ~F.array_contains("covered", i))))
    counted = left.select("row", "doc_id", F.explode("words").alias("word")).filter("word rlike '^\\\\p{L}+$'").groupBy("row", "doc_id", "word").agg(F.count("*").cast("int").alias("n"))
    whole = counted.groupBy("row", "doc_id").agg(F.sum("n").cast("int").alias("n_words"), F.collect_list(F.struct("word", "n")).alias("w")).filter(F.col("n_words") >= min_words)
    return whole.select("doc_id", F.lit(None).cast("double").alias("level"), "n_words", F.col("w.word").alias("words"), F.col("w.n").alias("counts"))


def _covered(finder: PassageFinder, line: list[str]) -> set[int]:
    return {i for _, a, b in finder.hits(line) for i in range(a, b + 1)}


def _profiles(ids: list, levels: list, totals: list, words: list, counts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(levels, pa.float64()), pa.array(totals, pa.int32()), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int32()))],
        names=["doc_id", "level", "n_words", "words", "counts"],
    )


def graded_profiles(graded: DataFrame) -> DataFrame:
    """The graded examples as clamped nodes; their ids are made negative, their level is the place of the grade on the scale."""
    ship(graded.sparkSession)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text_id, passage, grade in zip(*(c.to_pylist() for c in batch.columns)):
                found = Counter(w for w in words_of(passage or "") if w.isalpha())
                if found and grade in GRADES:
                    rows.append((-1 - text_id, float(GRADES.index(grade)), found.total(), list(found), list(found.values())))
            yield _profiles(*map(list, zip(*rows))) if rows else _profiles([], [], [], [], [])

    rows = graded.select(F.col("text_id").cast("long").alias("text_id"), F.col("passage").cast("string").alias("passage"), F.trim("grade").alias("grade")).filter("text_id is not null")
    return rows.mapInArrow(profile, PROFILE)


def unlike(before: np.ndarray, after: np.ndarray, weight: np.ndarray) -> float:
    """How much two sets of levels differ beyond scale and shift: the root of 1 - r2 of their weighted correlation.

    Grades are read against the levels of the graded texts, so scale and shift change none of them.
    """
    a, b = (x - np.average(x, weights=weight) for x in (before, after))
    spread_a, spread_b = np.average(a * a, weights=weight), np.average(b * b, weights=weight)
    if spread_a <= 1e-18 or spread_b <= 1e-18:
        return 0.0 if abs(spread_a - spread_b) <= 1e-18 else 1.0
    return float(np.sqrt(max(0.0, 1 - np.average(a * b, weights=weight) ** 2 / (spread_a * spread_b))))


def harmonic_levels(profiles: DataFrame, residual: float = RESIDUAL, sent_words: int = SENT_WORDS) -> DataFrame:
    """(doc_id, level, free): clamped and freely propagated level of each node; free is null where no word of a node has a level.

    Words of one node only pass nothing on and are left out, which changes no other level. A round gives
    each word the weighted mean level of its nodes and each node that of its words; rounds go on until
    every word that can be reached has a level and ``unlike`` of two rounds is at most ``residual``.
    """
    spark = profiles.sparkSession
    n_nodes = profiles.count()
    vocabulary = cut(profiles.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")).filter("df > 1"))
    if vocabulary.count() > sent_words:
        return _joined_rounds(profiles, vocabulary, n_nodes, residual)
    words = vocabulary.orderBy("word").toPandas()  # at most sent_words rows
    weight = np.log(n_nodes / words["df"].to_numpy("float64")) + 1e-6
    level, known = np.zeros(len(words)), np.zeros(len(words), bool)
    names = pa.array(words["word"].to_list(), pa.string())
    moved, first = np.inf, True
    while moved > residual:
        sent = spark.sparkContext.broadcast((names, weight, level, known))
        sums = profiles.mapInArrow(_word_sums(sent, first), "word int, upper double, lower double").groupBy("word").agg(F.sum("upper").alias("upper"), F.sum("lower").alias("lower")).toPandas()
        sent.unpersist()
        new, mass = np.zeros(len(words)), np.zeros(len(words))
        new[sums["word"]], mass[sums["word"]] = sums["upper"] / sums["lower"], sums["lower"]
        same_words = bool((known == (mass > 0)).all())
        moved = unlike(level[known], new[known], mass[known]) if same_words and known.any() else np.inf if (mass > 0).any() else 0.0
        level, known, first = new, mass > 0, False
    sent = spark.sparkContext.broadcast((names, weight, level, known))
    return profiles.mapInArrow(_node_levels(sent), "doc_id long, level double, free double")


def _free_levels(batch: pa.RecordBatch, names: pa.Array, weight: np.ndarray, level: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a batch (row, word, weight) and the free level of each row, NaN where it has none."""
    lists, counts = batch.column(3), batch.column(4)
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = pc.index_in(lists.flatten(), value_set=names)
    there = at.is_valid().to_numpy(zero_copy_only=False)
    word = at.fill_null(0).to_numpy(zero_copy_only=False)[there]
    row, edge = row[there], (counts.flatten().to_numpy(zero_copy_only=False)[there]) * weight[word]
    use = known[word]
    lower = np.bincount(row[use], edge[use], batch.num_rows)
    upper = np.bincount(row[use], edge[use] * level[word[use]], batch.num_rows)
    return row, word, edge, np.divide(upper, lower, out=np.full(batch.num_rows, np.nan), where=lower > 0)


def _word_sums(sent, first: bool):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight, level, known = sent.value
        upper, lower = np.zeros(len(names)), np.zeros(len(names))
        for batch in batches:
            row, word, edge, free = _free_levels(batch, names, weight, level, known)
            clamped = batch.column(1).to_numpy(zero_copy_only=False).astype("float64")
            node = np.where(np.isnan(clamped), np.nan if first else free, clamped)
            use = ~np.isnan(node[row])
            upper += np.bincount(word[use], edge[use] * node[row[use]], len(names))
            lower += np.bincount(word[use], edge[use], len(names))
        some = np.flatnonzero(lower > 0)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(upper[some]), pa.array(lower[some])], names=["word", "upper", "lower"])

    return step


def _node_levels(sent):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight, level, known = sent.value
        for batch in batches:
            free = _free_levels(batch, names, weight, level, known)[3]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(free, from_pandas=True)], names=["doc_id", "level", "free"])

    return step


def _joined_rounds(profiles: DataFrame, vocabulary: DataFrame, n_nodes: int, residual: float) -> DataFrame:
    """The same rounds for a vocabulary of any size: edges are joined with word levels, then with node levels."""
    weights = vocabulary.select("word", (F.log(F.lit(float(n_nodes)) / F.col("df")) + 1e-6).alias("weight"))
    numbered = cut(profiles.withColumn("node", F.monotonically_increasing_id()))
    pairs = numbered.select("node", F.explode(F.arrays_zip("words", "counts")).alias("e")).select("node", F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    edges = cut(pairs.join(weights, "word").select("node", "word", (F.col("n") * F.col("weight")).alias("edge")))
    clamped = numbered.select("node", "doc_id", "level")
    nodes, before, moved = clamped.select("node", F.col("level").alias("at")), None, np.inf
    while moved > residual:
        words = cut(edges.join(nodes.filter("at is not null"), "node").groupBy("word").agg((F.sum(F.col("edge") * F.col("at")) / F.sum("edge")).alias("word_level"), F.sum("edge").alias("mass")))
        moved = np.inf if before is None else _unlike_joined(before, words)
        if words.isEmpty():
            moved = 0.0
        free = edges.join(words.select("word", "word_level"), "word").groupBy("node").agg((F.sum(F.col("edge") * F.col("word_level")) / F.sum("edge")).alias("free"))
        levels = cut(clamped.join(free, "node", "left"))
        nodes, before = levels.select("node", F.coalesce("level", "free").alias("at")), words
    return levels.select("doc_id", "level", "free")


def _unlike_joined(before: DataFrame, after: DataFrame) -> float:
    """``unlike`` of two tables of word levels: two passes over their join, each one aggregation."""
    both = after.join(before.select("word", F.col("word_level").alias("old")), "word", "full_outer")
    mean = lambda x: F.sum(F.col("mass") * x) / F.sum("mass")
    m = both.agg(F.count(F.when(F.col("old").isNull() | F.col("word_level").isNull(), 1)).alias("lost"), mean(F.col("old")).alias("a"), mean(F.col("word_level")).alias("b")).first()
    if m.lost or m.a is None:
        return np.inf if m.lost else 0.0
    a, b = F.col("old") - m.a, F.col("word_level") - m.b
    s = both.agg(mean(a * a).alias("aa"), mean(b * b).alias("bb"), mean(a * b).alias("ab")).first()
    if s.aa <= 1e-18 or s.bb <= 1e-18:
        return 0.0 if abs(s.aa - s.bb) <= 1e-18 else 1.0
    return float(np.sqrt(max(0.0, 1 - s.ab**2 / (s.aa * s.bb))))


def reading_grades(documents: DataFrame, graded: DataFrame, items: DataFrame | None = None, min_words: int = MIN_WORDS, residual: float = RESIDUAL, sent_words: int = SENT_WORDS) -> DataFrame:
    """(doc_id, grade, difficulty) of each document with enough prose; the caller chooses the language.

    Copied passages of ``items`` are taken out of the prose first. Without any graded text there is no
    scale and no row. A document without a word that any chain of texts links to a graded one gets the
    middle of the scale. Null texts give no row; a repeated doc_id gives a row for each of its rows.
    """
    profiles = cut(prose_profiles(documents, items, min_words).unionByName(graded_profiles(graded)))
    levels = harmonic_levels(profiles, residual, sent_words)
    centres = {r.level: r.free for r in levels.filter("level is not null").groupBy("level").agg(F.avg("free").alias("free")).collect() if r.free is not None}
    known = sorted(centres)
    if not known:
        return levels.filter("false").select("doc_id", F.lit(None).cast("string").alias("grade"), F.col("free").alias("difficulty"))
    middle = sum(centres.values()) / len(centres)
    value = F.coalesce(F.col("free"), F.lit(middle))
    grade = F.lit(GRADES[int(known[-1])])
    for low, high in reversed(list(zip(known, known[1:]))):
        grade = F.when(value < (centres[low] + centres[high]) / 2, GRADES[int(low)]).otherwise(grade)
    return levels.filter("level is null").select("doc_id", grade.alias("grade"), value.alias("difficulty"))
