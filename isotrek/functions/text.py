"""Names, labels and colours as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stay small inside a name, and acronyms that stay capital.
SMALL_WORDS = ["de", "du", "des", "la", "le", "les", "et", "en", "sur", "sous", "aux", "au", "à"]
ACRONYMS = ["TGV", "SNCF", "CHU", "CHR", "IUT", "ZI", "ZA", "ZAC", "RN", "RD", "TER", "UFR", "INSA", "EDF", "CPAM", "IME", "MEETT"]
# Mode by basic route type, and by range (from, below) of extended types.
ROUTE_MODES = {0: "tram", 1: "metro", 2: "metro", 3: "bus", 4: "ferry", 5: "cable", 6: "cable", 7: "funicular"}
EXTENDED_MODES = [(100, 200, "metro"), (400, 500, "metro"), (900, 1000, "tram"), (1000, 1300, "ferry"), (1300, 1400, "cable"), (1400, 1500, "funicular")]


def _accents() -> tuple[str, str]:
    """Latin letters with marks and the plain ones they fold to."""
    marked, plain = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            marked.append(chr(code))
            plain.append(base[0])
    return "".join(marked), "".join(plain)


def fold_accents(col: Column) -> Column:
    """Lower-case search key without accents; combining marks vanish."""
    marked, plain = _accents()
    return F.lower(F.translate(F.regexp_replace(col, r"[̀-ͯ]", ""), marked, plain))


def normalise_name(col: Column) -> Column:
    """Lower case, hyphens to spaces, curly apostrophes straight, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(col), "-’", " '"), r"\s+", " "))


def display_name(col: Column) -> Column:
    """Names written in capitals (four letters or more) in title case; all others as they are."""
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000))

    def word(w: Column, i: Column) -> Column:
        bare = F.btrim(F.upper(w), F.lit(".,"))
        elided = F.concat(F.substring(w, 1, 2), F.upper(F.substring(w, 3, 1)), F.substring(w, 4, 10_000))
        return (
            F.when(bare.isin(ACRONYMS), F.upper(w))
            .when((i > 0) & w.isin(SMALL_WORDS), w)
            .when(F.substring(w, 1, 2).isin("d'", "l'") & (F.length(w) > 2), elided)
            .otherwise(F.array_join(F.transform(F.split(w, "-"), capital), "-"))
        )

    letters = F.regexp_replace(col, r"[^\p{L}]", "")
    shouted = (F.length(letters) >= 4) & (letters == F.upper(letters)) & (letters != F.lower(letters))
    return F.when(shouted, F.array_join(F.transform(F.split(F.lower(col), " "), word), " ")).otherwise(col)


def rewrite_names(col: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular-expression rewrites in their order (patterns and replacements in Java's notation)."""
    for pattern, replacement in rules:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def route_mode(route_type: Column) -> Column:
    """Mode of a basic or extended route type; bus if it is blank or unknown."""
    number = route_type.try_cast("int")
    basic = F.try_element_at(F.create_map(*(F.lit(x) for kv in ROUTE_MODES.items() for x in kv)), number)
    extended = F.coalesce(*(F.when((number >= a) & (number < b), mode) for a, b, mode in EXTENDED_MODES))
    return F.coalesce(basic, extended, F.lit("bus"))


def ordinal_label(number: Column, one: str = "er", more: str = "e", noun: str = "arrondissement") -> Column:
    """'1er arrondissement', '2e arrondissement' from a text that holds a number; null if it holds none."""
    n = F.nullif(F.regexp_extract(number, r"(\d+)", 1), F.lit(""))
    return F.concat(n, F.when(n == "1", one).otherwise(more), F.lit(f" {noun}"))


def address_label(*parts: Column) -> Column:
    """The non-blank parts, each once, joined by commas."""
    return F.array_join(F.array_distinct(F.filter(F.array(*(F.nullif(F.trim(p), F.lit("")) for p in parts)), lambda p: p.isNotNull())), ", ")


def query_key(col: Column) -> Column:
    """Cache key of a search text: trimmed, lower case, single spaces."""
    return F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))


def has_all_words(name: Column, query: Column) -> Column:
    """Whether an accent-folded name holds every word of the folded query; a blank query holds nothing."""
    words = F.filter(F.split(fold_accents(query), r"\s+"), lambda w: w != "")
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(fold_accents(name), w))


def luminance(hex_colour: Column) -> Column:
    """Relative luminance of '#rrggbb'; null if it is no such colour."""
    ok = hex_colour.rlike("^#[0-9A-Fa-f]{6}$")

    def channel(i: int) -> Column:
        v = F.conv(F.substring(hex_colour, 2 + 2 * i, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, 2.4))

    return F.when(ok, 0.2126 * channel(0) + 0.7152 * channel(1) + 0.0722 * channel(2))


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two colours."""
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def text_colour(background: Column) -> Column:
    """'#111' on light and '#fff' on dark backgrounds ('#rrggbb' or 'rrggbb'; blank counts as grey)."""
    digits = F.coalesce(F.nullif(F.substring(F.regexp_replace(background, "^#+", ""), 1, 6), F.lit("")), F.lit("888888"))
    part = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("int")
    return F.when(0.299 * part(1) + 0.587 * part(3) + 0.114 * part(5) > 150, "#111").otherwise("#fff")


def long_date(day: Column) -> Column:
    """'7 octobre 2026'."""
    months = F.array(*(F.lit(m) for m in ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")))
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(months, F.month(day)), F.year(day).cast("string"))


def day_first(day: Column) -> Column:
    return F.date_format(day, "dd/MM/yyyy")
