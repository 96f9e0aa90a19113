"""Evaluation passages inside corpus texts: one Aho-Corasick scan of the normalised text.

Texts and test items are reduced to their words (runs of letters and digits, composed, lower case), words
of the items to numbers. Every run of ``min_words`` consecutive words of an item's question or answer is
a pattern of one automaton over word numbers (two letters each); hits are mapped back to character offsets of the original.
Test items are a stated query set: they are taken in blocks bounded by the length of their texts. A
text is parsed once, however many blocks there are.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotrek.llm.notebooks import Segment, segments
from isotrek.session import cut, ship, spread

WORD = re.compile(r"[^\W_]+")
#: Characters of item texts in a block. An automaton takes about 200 bytes a character (measured), so a worker holds some 200 MB.
BLOCK_CHARS = 1_000_000
PARTS = ("prompt", "answer")
DIGIT, LOWER, UPPER, BREAK = 512, 0x100, 0x1000, "\n\n"  # lower digits lie apart from upper ones, so no pattern fits between two words
Item = tuple[int, str, str]  # item_id, one of PARTS, text
FOUND = "doc_id long, item_id long, field string, cell int, part string, first_char int, last_char int, n_words int"
FOUND_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
SEGMENTS = "doc_id long, cell int, part string, text string"


def fold(text: str) -> tuple[str, list[int] | None]:
    """The text composed and in lower case, and where each of its characters comes from; None: from the same place."""
    low = text.lower()
    if text.isascii() or (len(low) == len(text) and unicodedata.is_normalized("NFC", text)):
        return low, None  # no character becomes shorter, so equal lengths mean equal places
    out, places, start = [], [], 0
    for i in range(1, len(text) + 1):
        if i < len(text) and (unicodedata.combining(text[i]) or "ᅠ" <= text[i] <= "ᇿ"):
            continue  # belongs to the character before it
        piece = unicodedata.normalize("NFC", text[start:i]).lower()
        out.append(piece)
        places += [start] * len(piece)
        start = i
    return "".join(out), [*places, len(text)]


def words_of(text: str) -> list[str]:
    return WORD.findall(fold(text)[0])


class PassageFinder:
    """Finds runs of at least ``min_words`` consecutive words of an item in a text.

    A word of the items is written as two letters, upper and lower digit of its number, which keeps the
    automaton's nodes few and narrow; any other word is a break. Only stretches of ``min_words`` words of
    the items without a break are scanned, as no pattern reaches over one.
    """

    def __init__(self, items: list[Item], min_words: int):
        self.min_words, self.letters = min_words, {}
        owners: dict[str, set[tuple[int, str]]] = {}
        for item_id, field, text in items:
            codes = [self._code(w) for w in words_of(text or "")]
            for i in range(len(codes) - min_words + 1):
                owners.setdefault("".join(codes[i : i + min_words]), set()).add((item_id, field))
        self.automaton = ahocorasick.Automaton()
        for run, of in owners.items():
            self.automaton.add_word(run, tuple(sorted(of)))
        self.stretch = re.compile(rf"[^{BREAK[0]}]{{{2 * min_words},}}")
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def _code(self, word: str) -> str:
        code = self.letters.get(word)
        if code is None:
            upper, lower = divmod(len(self.letters), DIGIT)
            code = self.letters[word] = chr(UPPER + upper) + chr(LOWER + lower)
        return code

    def hits(self, words: list[str]) -> list[tuple[tuple[int, str], int, int]]:
        """((item_id, field), first word, last word) of each run of consecutive hits of an item."""
        if self.empty or len(words) < self.min_words:
            return []
        code = self.letters.get
        line = "".join([code(w, BREAK) for w in words])
        runs: dict[tuple[int, str], list[list[int]]] = {}
        for m in self.stretch.finditer(line):
            for end, owners in self.automaton.iter(line, m.start(), m.end()):
                last = end // 2
                for owner in owners:
                    of = runs.setdefault(owner, [])
                    if of and last == of[-1][1] + 1:
                        of[-1][1] = last
                    else:
                        of.append([last - self.min_words + 1, last])
        return [(owner, a, b) for owner, spans in runs.items() for a, b in spans]


def find_in_text(finder: PassageFinder, text: str) -> list[tuple[int, str, int, int, int]]:
    """(item_id, field, first_char, last_char, n_words) of the passages in one cell's source or output; offsets are the original's."""
    folded, places = fold(text)
    found = finder.hits(WORD.findall(folded))
    if not found:
        return []
    spans = [m.span() for m in WORD.finditer(folded)]
    at = (lambda i: i) if places is None else places.__getitem__
    end = at if places is None else lambda i: places[bisect_right(places, places[i - 1])]
    return [(*owner, at(spans[a][0]), end(spans[b][1]), b - a + 1) for owner, a, b in found]


def find_in_segments(finder: PassageFinder, parts: list[Segment]) -> list[tuple[int, str, int, str, int, int, int]]:
    """(item_id, field, cell, part, first_char, last_char, n_words) of the passages in a notebook's segments."""
    return [(item_id, field, s.cell, s.part, a, b, n) for s in parts for item_id, field, a, b, n in find_in_text(finder, s.text)]


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[Item]]:
    """The texts of the test items (item_id, prompt, answer) in blocks of about ``block_chars`` characters, each small enough for a driver and a worker."""
    there = [p for p in PARTS if p in items.columns]
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.array(*(F.struct(F.lit(p).alias("field"), F.col(p).cast("string").alias("text")) for p in there))).alias("t"))
    texts = texts.select("item_id", "t.field", "t.text").dropna()
    blocks = max(1, math.ceil((texts.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    for block in range(blocks):
        part = texts if blocks == 1 else texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        yield [(r.item_id, r.field, r.text) for r in part.collect()]


_last: dict[tuple[str, int], PassageFinder] = {}


def digest(block: list[Item]) -> str:
    return hashlib.sha256(repr(block).encode("utf-8", "surrogatepass")).hexdigest()


def finder_in_worker(key: str, block: Callable[[], list[Item]], min_words: int) -> PassageFinder:
    """The finder of the block of that digest; a worker that has built it for the task before takes it again."""
    if (key, min_words) not in _last:
        _last.clear()
        _last[key, min_words] = PassageFinder(block(), min_words)
    return _last[key, min_words]


def document_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, text, nb_format) of the documents with a text."""
    ship(documents.sparkSession)
    return documents.select(*(F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("nb_format", "string")))).filter("text is not null")


def in_slices(step: Callable[[list[tuple]], list[tuple]], types: list[pa.DataType], names: list[str]) -> Callable:
    """A mapInArrow function that gives ``step`` some hundred rows at a time."""
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = step(list(zip(*(c.to_pylist() for c in batch.slice(start, 256).columns))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return over


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def document_segments(documents: DataFrame) -> DataFrame:
    """(doc_id, cell, part, text) of all segments."""
    step = lambda rows: [(doc_id, s.cell, s.part, s.text) for doc_id, text, nb_format in rows for s in segments(text, nb_format)]
    return spread(document_rows(documents)).mapInArrow(in_slices(step, [pa.int64(), pa.int32(), pa.string(), pa.string()], _columns(SEGMENTS)), SEGMENTS)


def leaked_passages(documents: DataFrame, items: DataFrame, min_words: int = 12, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Where the documents hold passages of the items: (doc_id, item_id, field, cell, part, first_char, last_char, n_words).

    A passage is at least ``min_words`` consecutive words of an item's prompt or answer (``field``) within
    one cell's source or output. Offsets count characters of the decoded cell. Null and blank texts and
    null items give no row, texts of fewer words are never found, and a document repeated under another id
    is reported under both. One block of items is found while the texts are parsed; of several blocks each
    goes over the parsed texts, which are written once, and its finds are written before the next.
    """
    sc = documents.sparkSession.sparkContext
    blocks = item_blocks(items, block_chars)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        sent, key = sc.broadcast(block), digest(block)

        def scan(rows: list[tuple]) -> list[tuple]:
            finder = finder_in_worker(key, lambda: sent.value, min_words)
            return [(doc_id, *f) for doc_id, text, nb_format in rows for f in find_in_segments(finder, segments(text, nb_format))]

        return spread(document_rows(documents)).mapInArrow(in_slices(scan, FOUND_TYPES, _columns(FOUND)), FOUND)
    parsed, whole = cut(document_segments(documents)), None
    while block is not None:
        sent, key = sc.broadcast(block), digest(block)

        def look(rows: list[tuple], sent=sent, key=key) -> list[tuple]:
            finder = finder_in_worker(key, lambda: sent.value, min_words)
            return [(doc_id, item_id, field, cell, part, a, b, n) for doc_id, cell, part, text in rows for item_id, field, a, b, n in find_in_text(finder, text)]

        found = cut(parsed.mapInArrow(in_slices(look, FOUND_TYPES, _columns(FOUND)), FOUND))
        sent.unpersist()
        whole = found if whole is None else whole.unionByName(found)
        block, after = after, next(blocks, None)
    return whole
