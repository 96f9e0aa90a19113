"""Exact byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token with which its encoding ends. Scanning the
piece once with a suffix-matching automaton over the vocabulary gives, at each position, the tokens
that end there; the one that is right is the one that is compatible with the last token of the prefix
before it (two tokens are compatible if encoding their joined bytes gives the two again). Following
the stored tokens back from the end emits the ids. A text is cut into pieces by the vocabulary's
pattern first; no token crosses pieces, so equal pieces are encoded once per worker.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotrek.session import ship, spread

#: Unicode white space as the pattern's \s means it; Python's own \s takes four control characters more.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = regex.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+", regex.V1
)
_ASCII_SPACE = "\\t\\n\\x0b\\x0c\\r "
ASCII_PIECES = re.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^{_ASCII_SPACE}A-Za-z0-9]+|[{_ASCII_SPACE}]+(?![^{_ASCII_SPACE}])|[{_ASCII_SPACE}]+"
)
#: What a worker remembers; the ids are the same without. Pieces are bounded by their bytes, longer ones are not kept.
CACHED_BYTES, CACHED_PIECE_CHARS, CACHED_PAIRS = 96 << 20, 200, 1_000_000
PIECE_OVERHEAD = 250  # bytes that Python needs for an entry besides its text


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file, and the automaton that finds tokens by their ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = _byte_letters()
        as_bytes = lambda token: "".join(chr(letter[c]) for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids: dict[str, int] = model["vocab"]
        self.joined: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        singles = {token for token in ids if len(token) == 1 and token in letter}
        for token in singles:
            self.rank[ids[token]] = -1
            self.automaton.add_word(as_bytes(token), (1, ids[token]))
        for rank, (left, right) in enumerate(merges):
            whole, pair = ids[left + right], (ids[left], ids[right])
            self.joined[pair] = rank
            if whole not in self.rank:
                self.rank[whole], self.halves[whole] = rank, pair
                self.automaton.add_word(as_bytes(left + right), (len(left + right), whole))
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge takes place over the border of two tokens that stand side by side.

        Both tokens are taken apart at the border, always the part merged last first. If at some
        moment the two parts at the border have a merge that comes before the merges by which they
        vanish into the larger parts just taken apart, the border would have been merged over.
        """
        rank, halves, joined = self.rank, self.halves, self.joined
        left_until = right_until = len(joined)  # the merge by which a part vanishes into a larger one; none yet
        while True:
            over = joined.get((left, right))
            # of equal merges the leftmost comes first: the left part's own before, the right part's own after
            if over is not None and over < left_until and over <= right_until:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                left_until, left = rank[left], halves[left][1]
            else:
                right_until, right = rank[right], halves[right][0]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece of text."""
        data = piece.encode("utf-8", "replace").decode("latin-1")
        # The last token of a whole piece is the longest token that ends it, and one that spans it needs no test of
        # compatibility: what the loop below would store at the end. (A test shows that no token is split by its own merges.)
        if (whole := self.automaton.get(data, None)) is not None:
            return [whole[1]]
        known, last, size = self.known, [0] * (len(data) + 1), [0] * (len(data) + 1)
        settled = -1
        for end, (length, token) in self.automaton.iter(data):  # at each end the longest token first
            if end == settled:
                continue
            start = end + 1 - length
            if start:
                pair = last[start] << 20 | token
                fits = known.get(pair)
                if fits is None:
                    if len(known) > CACHED_PAIRS:
                        known.clear()
                    fits = known[pair] = self.compatible(last[start], token)
                if not fits:
                    continue
            last[end + 1], size[end + 1], settled = token, length, end
        out, at = [], len(data)
        while at > 0:
            if not size[at]:
                raise ValueError(f"the vocabulary has no token for byte {ord(data[at - 1]):#04x}")
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode_pieces(self, pieces: list[str]) -> bytes:
        """Ids of many pieces as little-endian 32-bit integers."""
        known = self.pieces
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        if self.held > CACHED_BYTES:
            known.clear()
            self.held = 0
        long: dict[str, bytes] = {}
        for p in {p for p in pieces if p not in known}:
            ids = np.array(self.encode_piece(p), "<i4").tobytes()
            if len(p) <= CACHED_PIECE_CHARS:
                known[p] = ids
                self.held += PIECE_OVERHEAD + len(p) + len(ids)
            else:
                long[p] = ids
        if long:
            return b"".join([known[p] if p in known else long[p] for p in pieces])
        return b"".join([known[p] for p in pieces])

    def encode(self, text: str) -> np.ndarray:
        pieces = (ASCII_PIECES if text.isascii() else PIECES).findall(text)
        return np.frombuffer(self.encode_pieces(pieces), "<i4")


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_texts(df: DataFrame, key: str, text: str, path: str, out: str = "ids") -> DataFrame:
    """(key, ids array<int>): each row's text by the vocabulary at ``path``, without special tokens.

    A null text and an empty text both give an empty list, one row for each row of ``df``. The strings
    of special tokens in a text are ordinary text. The driver sends the file to the executors.
    """
    spark = df.sparkSession
    ship(spark)
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(SparkFiles.get(name))
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = [vocab.encode(t) if t else np.zeros(0, "<i4") for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, "int32")
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                values = np.concatenate(lists) if lists else np.zeros(0, "int32")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], names=[key, out])

    rows = df.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").cast("string").alias(text))
    return spread(rows).mapInArrow(encode, f"`{key}` long, `{out}` array<int>")
