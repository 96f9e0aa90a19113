"""Text that looks identical to one form: look-alike classes by union-find, rewriting by automaton.

Nodes of the union-find are code points and strings. Edges: characters with a wide, narrow or no-break
form of another, ligatures and what they are made of, look-alike letters of other scripts, all kinds
of space, and invisible characters with the empty string. The representative of a class is its most
frequent member in the corpus; an automaton over all other members rewrites each text greedily, the
longest match first, after canonical decomposition.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotrek.functions.values import key
from isotrek.session import keep, ship

# Unicode names of letters of other scripts that are drawn like an ASCII letter or sign. Left out because
# they differ visibly: letters of another shape (Greek alpha, Latin alpha, Hebrew samekh), dashes and the minus sign, which
# are wider than a hyphen, bold, italic and other styled letters, superscripts. A file of pairs can add more (``pairs``).
LOOK_ALIKES = {
    "A": ["GREEK CAPITAL LETTER ALPHA", "CYRILLIC CAPITAL LETTER A", "CHEROKEE LETTER GO", "LISU LETTER A"],
    "B": ["GREEK CAPITAL LETTER BETA", "CYRILLIC CAPITAL LETTER VE", "CHEROKEE LETTER YV", "LISU LETTER BA"],
    "C": ["CYRILLIC CAPITAL LETTER ES", "GREEK CAPITAL LUNATE SIGMA SYMBOL", "CHEROKEE LETTER TLI", "LISU LETTER CA"],
    "D": ["CHEROKEE LETTER A", "LISU LETTER DA"],
    "E": ["GREEK CAPITAL LETTER EPSILON", "CYRILLIC CAPITAL LETTER IE", "CHEROKEE LETTER GV", "LISU LETTER E"],
    "F": ["GREEK LETTER DIGAMMA", "LISU LETTER TSA"],
    "G": ["CYRILLIC CAPITAL LETTER KOMI SJE", "CHEROKEE LETTER NAH", "LISU LETTER GA"],
    "H": ["GREEK CAPITAL LETTER ETA", "CYRILLIC CAPITAL LETTER EN", "CHEROKEE LETTER MI", "LISU LETTER XA"],
    "I": ["GREEK CAPITAL LETTER IOTA", "CYRILLIC CAPITAL LETTER BYELORUSSIAN-UKRAINIAN I", "CYRILLIC LETTER PALOCHKA", "LISU LETTER I"],
    "J": ["CYRILLIC CAPITAL LETTER JE", "GREEK CAPITAL LETTER YOT", "CHEROKEE LETTER GU", "LISU LETTER JA"],
    "K": ["GREEK CAPITAL LETTER KAPPA", "CYRILLIC CAPITAL LETTER KA", "KELVIN SIGN", "CHEROKEE LETTER TSO", "LISU LETTER KA"],
    "L": ["CHEROKEE LETTER TLE", "LISU LETTER LA"],
    "M": ["GREEK CAPITAL LETTER MU", "CYRILLIC CAPITAL LETTER EM", "GREEK CAPITAL LETTER SAN", "CHEROKEE LETTER LU", "LISU LETTER MA"],
    "N": ["GREEK CAPITAL LETTER NU", "LISU LETTER NA"],
    "O": ["GREEK CAPITAL LETTER OMICRON", "CYRILLIC CAPITAL LETTER O", "ARMENIAN CAPITAL LETTER OH", "LISU LETTER O", "DESERET CAPITAL LETTER LONG O", "COPTIC CAPITAL LETTER O"],
    "P": ["GREEK CAPITAL LETTER RHO", "CYRILLIC CAPITAL LETTER ER", "CHEROKEE LETTER TLV", "LISU LETTER PA", "COPTIC CAPITAL LETTER RO"],
    "Q": ["CYRILLIC CAPITAL LETTER QA"],
    "R": ["CHEROKEE LETTER E", "LISU LETTER ZHA"],
    "S": ["CYRILLIC CAPITAL LETTER DZE", "ARMENIAN CAPITAL LETTER TIWN", "CHEROKEE LETTER DU", "LISU LETTER SA"],
    "T": ["GREEK CAPITAL LETTER TAU", "CYRILLIC CAPITAL LETTER TE", "CHEROKEE LETTER I", "LISU LETTER TA", "COPTIC CAPITAL LETTER TAU"],
    "U": ["ARMENIAN CAPITAL LETTER SEH", "LISU LETTER U"],
    "V": ["CYRILLIC CAPITAL LETTER IZHITSA", "CHEROKEE LETTER DO", "LISU LETTER HA"],
    "W": ["CYRILLIC CAPITAL LETTER WE", "CHEROKEE LETTER LA", "LISU LETTER WA"],
    "X": ["GREEK CAPITAL LETTER CHI", "CYRILLIC CAPITAL LETTER HA", "LISU LETTER SHA"],
    "Y": ["GREEK CAPITAL LETTER UPSILON", "CYRILLIC CAPITAL LETTER STRAIGHT U", "CYRILLIC CAPITAL LETTER U", "CHEROKEE LETTER GI", "LISU LETTER YA"],
    "Z": ["GREEK CAPITAL LETTER ZETA", "CHEROKEE LETTER NO", "LISU LETTER DZA"],
    "a": ["CYRILLIC SMALL LETTER A"],
    "c": ["CYRILLIC SMALL LETTER ES", "GREEK LUNATE SIGMA SYMBOL", "LATIN LETTER SMALL CAPITAL C", "COPTIC SMALL LETTER SIMA"],
    "d": ["CYRILLIC SMALL LETTER KOMI DE"],
    "e": ["CYRILLIC SMALL LETTER IE"],
    "g": ["LATIN SMALL LETTER SCRIPT G"],
    "h": ["CYRILLIC SMALL LETTER SHHA", "ARMENIAN SMALL LETTER HO", "CHEROKEE LETTER NI"],
    "i": ["CYRILLIC SMALL LETTER BYELORUSSIAN-UKRAINIAN I", "CHEROKEE LETTER V"],
    "j": ["CYRILLIC SMALL LETTER JE", "GREEK LETTER YOT"],
    "l": ["CYRILLIC SMALL LETTER PALOCHKA"],
    "n": ["ARMENIAN SMALL LETTER VO"],
    "o": ["GREEK SMALL LETTER OMICRON", "CYRILLIC SMALL LETTER O", "ARMENIAN SMALL LETTER OH", "LATIN LETTER SMALL CAPITAL O", "DESERET SMALL LETTER LONG O", "COPTIC SMALL LETTER O"],
    "p": ["CYRILLIC SMALL LETTER ER", "GREEK SMALL LETTER RHO", "COPTIC SMALL LETTER RO"],
    "q": ["CYRILLIC SMALL LETTER QA"],
    "s": ["CYRILLIC SMALL LETTER DZE", "LATIN LETTER SMALL CAPITAL S"],
    "u": ["ARMENIAN SMALL LETTER SEH"],
    "v": ["GREEK SMALL LETTER NU", "CYRILLIC SMALL LETTER IZHITSA", "LATIN LETTER SMALL CAPITAL V"],
    "w": ["CYRILLIC SMALL LETTER WE", "LATIN LETTER SMALL CAPITAL W"],
    "x": ["CYRILLIC SMALL LETTER HA"],
    "y": ["CYRILLIC SMALL LETTER U", "CYRILLIC SMALL LETTER STRAIGHT U"],
    "z": ["LATIN LETTER SMALL CAPITAL Z"],
    "-": ["HYPHEN", "NON-BREAKING HYPHEN"],
}
# Invisible characters outside the format category.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0"
DRAWN_THE_SAME = ("<wide>", "<narrow>", "<noBreak>")


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        members: dict[str, list[str]] = {}
        for x in self.parent:
            members.setdefault(self.find(x), []).append(x)
        return list(members.values())


def is_invisible(char: str) -> bool:
    return unicodedata.category(char) == "Cf" or char in INVISIBLE or 0xFE00 <= ord(char) <= 0xFE0F or 0xE0100 <= ord(char) <= 0xE01EF


def same_as(char: str) -> str | None:
    """The string that a single character is drawn like by its own properties, if any."""
    if is_invisible(char):
        return ""
    if unicodedata.category(char) == "Zs":
        return " "
    form = unicodedata.decomposition(char)
    tag, _, rest = form.partition(" ")
    ligature = tag == "<compat>" and "LIGATURE" in unicodedata.name(char, "")
    numeral = tag == "<compat>" and "ROMAN NUMERAL" in unicodedata.name(char, "")
    if tag in DRAWN_THE_SAME or ligature or numeral:
        return unicodedata.normalize("NFD", "".join(chr(int(c, 16)) for c in rest.split()))
    return None


def read_pairs(path: str) -> list[tuple[str, str]]:
    """Look-alikes of a file in the form of Unicode's list of confusables: lines of code points ``source ; target ; class``."""
    pairs = []
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            fields = line.partition("#")[0].split(";")
            if len(fields) >= 2 and fields[0].strip():
                pairs.append(tuple(unicodedata.normalize("NFD", "".join(chr(int(c, 16)) for c in x.split())) for x in fields[:2]))
    return pairs


def look_alike_classes(counts: Counter[str], pairs: Iterable[tuple[str, str]] = ()) -> dict[str, str]:
    """Member to representative, for the code points in ``counts``, all fixed look-alikes and further ``pairs``.

    The representative is the member seen most often, the smallest of equally frequent ones; what
    looks like nothing becomes the empty string.
    """
    sets = UnionFind()
    for latin, names in LOOK_ALIKES.items():
        for name in names:
            sets.join(unicodedata.lookup(name), latin)
    for a, b in pairs:
        if a and b:
            sets.join(a, b)
    for char in counts:
        if (other := same_as(char)) is not None:
            sets.join(char, other)
    rewrite = {}
    for members in sets.classes():
        seen = lambda m: min((counts.get(c, 0) for c in m), default=0)
        best = "" if "" in members else min(members, key=lambda m: (-seen(m), m))
        rewrite |= {m: best for m in members if m != best}
    return rewrite


class Rewriter:
    """Rewrites all members of look-alike classes to their representatives."""

    def __init__(self, rewrite: dict[str, str]):
        self.automaton = ahocorasick.Automaton()
        for member, representative in rewrite.items():
            self.automaton.add_word(member, (len(member), representative))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> str:
        text = unicodedata.normalize("NFD", text)
        out, at = [], 0
        for end, (length, representative) in self.automaton.iter_long(text):
            out.append(text[at : end + 1 - length])
            out.append(representative)
            at = end + 1
        return unicodedata.normalize("NFD", "".join(out) + text[at:]) if at else text


def character_counts(texts: DataFrame, column: str, weight: str | None = None) -> Counter[str]:
    """How often each code point of the decomposed texts occurs; ``weight``: a column of how often the text itself does. Unicode bounds how many there can be."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for batch in batches:
            for times, of in batch.dropna().groupby("times")["text"]:
                for c, n in Counter(unicodedata.normalize("NFD", "".join(of))).items():
                    found[c] += n * times
        yield pd.DataFrame({"code": [ord(c) for c in found], "n": list(found.values())})

    times = F.lit(1) if weight is None else F.col(f"`{weight}`")
    rows = texts.select(F.col(f"`{column}`").alias("text"), times.cast("long").alias("times")).mapInPandas(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return Counter({chr(r.code): r.n for r in rows.collect()})


def with_appearance(texts: DataFrame, column: str, out: str = "appearance", weight: str | None = None, pairs: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Adds ``out``: the one form of all texts that look like ``column``; null stays null. ``weight`` as in character_counts."""
    if out in texts.columns:
        raise ValueError(f"column {out} exists already")
    ship(texts.sparkSession)
    rewrite = look_alike_classes(character_counts(texts, column, weight), pairs)

    @F.pandas_udf(T.StringType())
    def appearance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = Rewriter(rewrite)
        for texts in batches:
            yield texts.map(rewriter, na_action="ignore")

    return texts.withColumn(out, appearance(F.col(f"`{column}`")))


def look_alike_pairs(rows: DataFrame, id_column: str, text_column: str, pairs: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """(id_a, id_b), id_a < id_b: different ids with texts that look the same but are not the same code points.

    Ids and texts are stripped; null, empty and invisible texts give no pair. The rows are read once and
    each spelling is rewritten once. Pairs are made between the distinct spellings of a class first, so that
    the many bearers of one spelling never meet each other; a bearer meets only those of another spelling,
    which is what the result lists.
    """
    stripped = rows.select(key(F.col(f"`{id_column}`").cast("string")).alias("id"), key(F.col(f"`{text_column}`").cast("string")).alias("spelling")).dropna()
    named = keep(stripped.groupBy("id", "spelling").agg(F.count("*").alias("times")))
    spellings = named.groupBy("spelling").agg(F.sum("times").alias("times"))
    seen = keep(with_appearance(spellings, "spelling", weight="times", pairs=pairs).filter("appearance != ''").select("appearance", "spelling"))
    left, right = seen.select("appearance", F.col("spelling").alias("a")), seen.select("appearance", F.col("spelling").alias("b"))
    unlike = left.join(right, "appearance").filter("a < b").select("a", "b")
    return (
        unlike.join(named.select(F.col("spelling").alias("a"), F.col("id").alias("x")), "a")
        .join(named.select(F.col("spelling").alias("b"), F.col("id").alias("y")), "b")
        .filter("x != y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .distinct()
    )
