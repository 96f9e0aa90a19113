"""Rows that fail to parse: an error-recovering recursive-descent reader of delimited feed text.

Grammar (RFC 4180 with located errors):

    text    = record *( line-break record )
    record  = value *( "," value )
    value   = quoted / bare
    quoted  = DQUOTE *( any character but DQUOTE / 2DQUOTE ) DQUOTE
    bare    = *( any character but "," DQUOTE CR LF )

On an error inside a record the reader resumes at the next line that is a validated record start: a
line that reads as a whole record of the expected width. Where the records come one a row, each row is
read as such a text: its fault is located and what follows the next anchor in it is loaded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotrek.functions.values import DAY_PATTERN, DECIMAL_PATTERN, DIGITS_PATTERN, WHITE_SPACE, digits_only, real_day

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
BOM = "﻿"
QUOTING, COLUMN_COUNT, INVALID_VALUE = "quoting", "column_count", "invalid_value"
#: Per file of a feed the one field that is judged, and the check it has to pass.
JUDGED = {"stops": ("stop_lat", "latitude"), "stop_times": ("stop_sequence", "digits"), "calendar": ("start_date", "day")}

#: The columns that are loaded of each file, and their types.
LOADED = {
    "stops": {"stop_id": "text", "stop_name": "text", "stop_lat": "number", "stop_lon": "number"},
    "stop_times": {"trip_id": "text", "arrival_time": "text", "departure_time": "text", "stop_id": "text", "stop_sequence": "digits"},
    "calendar": {"service_id": "text", **dict.fromkeys(WEEKDAYS, "flag"), "start_date": "day", "end_date": "day"},
}

#: A lone carriage return in the middle of a line belongs to the value.
_BARE = re.compile(r'(?:[^",\r\n]|\r(?!\n|\Z))*+')
_LINE = re.compile(r'[^"\r\n]*+(?=\r?\n|\r?\Z)')
_INSIDE = re.compile(r'[^"]*')
_DECIMAL, _DIGITS, _DAY = (re.compile(p) for p in (DECIMAL_PATTERN, DIGITS_PATTERN, DAY_PATTERN))


@dataclass(frozen=True)
class SyntaxProblem:
    reason: str
    offset: int
    detail: str


class _Reader:
    """One descent over ``text`` from ``at``; ``one_record``: line breaks outside quotes are no record ends but errors."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def record(self) -> list[str]:
        values = [self.value()]
        while self.at < len(self.text) and self.text[self.at] == ",":
            self.at += 1
            values.append(self.value())
        if not self.at_end():
            raise _Broken(SyntaxProblem(QUOTING, self.at, "quote inside an unquoted value" if self.text[self.at] == '"' else "text after the record"))
        return values

    def at_end(self) -> bool:
        return self.at >= len(self.text) or self.text[self.at] in "\r\n"

    def value(self) -> str:
        return self.quoted() if self.text.startswith('"', self.at) else self.bare()

    def bare(self) -> str:
        m = _BARE.match(self.text, self.at)
        self.at = m.end()
        if self.text.startswith('"', self.at):
            raise _Broken(SyntaxProblem(QUOTING, self.at, "quote inside an unquoted value"))
        return m.group()

    def quoted(self) -> str:
        start, parts = self.at, []
        self.at += 1
        while True:
            m = _INSIDE.match(self.text, self.at)
            parts.append(m.group())
            self.at = m.end()
            if self.at >= len(self.text):
                raise _Broken(SyntaxProblem(QUOTING, start, "quote left open"))
            if self.text.startswith('""', self.at):
                parts.append('"')
                self.at += 2
                continue
            self.at += 1
            if self.at < len(self.text) and self.text[self.at] != "," and not self.at_end():
                raise _Broken(SyntaxProblem(QUOTING, self.at, "text after a closing quote"))
            return "".join(parts)


class _Broken(Exception):
    def __init__(self, problem: SyntaxProblem):
        self.problem = problem


def blank(line: str | None) -> bool:
    return line is None or not line.strip(WHITE_SPACE + BOM)


def parse_text(text: str, width: int = 0) -> Iterator[tuple[int, list[str], SyntaxProblem | None]]:
    """(offset, stripped values, problem) of every record of a text; blank lines and blank records are skipped.

    ``width``: how many values a record has; 0 takes the first record that reads as the header and lets it
    decide. A BOM at the start belongs to no value. After broken quoting the next line that reads as a
    whole record of that width is the anchor at which reading goes on, also if the record runs over
    several lines; what lies between is one faulty record. A record of commas only is a record.
    """
    at = len(text) - len(text.lstrip(BOM))
    while at < len(text):
        if text[at] in "\r\n":
            at += 1
            continue
        problem, plain = None, _LINE.match(text, at)
        if plain:  # a line without quotes is split at its commas, which is what the descent would do
            values, end = [v.strip(WHITE_SPACE) for v in plain.group().split(",")], plain.end()
        else:
            reader = _Reader(text, at)
            try:
                values = [v.strip(WHITE_SPACE) for v in reader.record()]
                end = reader.at
            except _Broken as e:
                values, problem, end = [], e.problem, _anchor(text, at, width)
        empty = len(values) == 1 and not values[0]
        if problem is None and width and not empty and len(values) != width:
            problem = SyntaxProblem(COLUMN_COUNT, at, f"{len(values)} values, the header has {width}")
        if problem or not empty:
            yield at, values, problem
        if problem is None and not empty:
            width = width or len(values)
        at = end


def _anchor(text: str, at: int, width: int) -> int:
    """Where the next line begins that reads as a record of the width; the end of the text if none does."""
    while (at := text.find("\n", at) + 1) > 0:
        plain = _LINE.match(text, at)
        if plain:
            values = plain.group().split(",")
        else:
            reader = _Reader(text, at)
            try:
                values = reader.record()
            except _Broken:
                continue
        if len(values) == width if width else any(v.strip(WHITE_SPACE) for v in values):
            return at
    return len(text)


def parse_line(line: str, width: int = 0) -> tuple[list[str], SyntaxProblem | None]:
    """The stripped values of a text that is meant to hold one record, or its first fault."""
    for _, values, problem in parse_row(line, width):
        return ([], problem) if problem and problem.reason == QUOTING else (values, problem)
    return [""], None


def parse_row(line: str, width: int = 0) -> list[tuple[int, list[str], SyntaxProblem | None]]:
    """parse_text of a text that is meant to hold one record: its fault first, then the records that reading resumed at.

    A BOM at the start and a carriage return or line break at the end belong to no value. A second
    record that no broken quoting precedes is a fault: the line break before it stands outside quotes.
    """
    text = line.rstrip("\r\n")
    found = list(parse_text(text, width))
    if (len(found) > 1 and (found[0][2] is None or found[0][2].reason != QUOTING)) or text.lstrip(BOM)[:1] in ("\r", "\n"):
        at = found[1][0] if len(found) > 1 else 0
        return [(at, [], SyntaxProblem(QUOTING, at, "line break outside quotes"))]
    return found


def value_is_valid(check: str, value: str) -> bool:
    """The checks of JUDGED on one stripped value; the column forms of functions.values agree with them."""
    if check == "latitude":
        return bool(_DECIMAL.fullmatch(value)) and -90 <= float(value) <= 90
    if check == "digits":
        return bool(_DIGITS.fullmatch(value))
    if not _DAY.fullmatch(value):
        return False
    year, month, day = int(value[:4]), int(value[4:6]), int(value[6:])
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    lengths = [31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    return year >= 1 and 1 <= month <= 12 and 1 <= day <= lengths[month - 1]


@lru_cache(4_096)
def _header(line: str) -> tuple[str, ...] | None:
    values, problem = parse_line(line)
    return None if problem else tuple(values)


def read_row(line: str, header: str | None, file_name: str | None) -> list[tuple[int, list[str], SyntaxProblem | None]]:
    """parse_row against a header, with the judged value checked: (offset, values, problem) of each record.

    Faults in their order: quoting, else width against the header, else the judged value. Without a
    readable header only the quoting can be judged; a header without the judged field leaves the value
    unjudged.
    """
    names = _header(header) if header is not None else None
    base = re.sub(r"^.*/|\.[^.]*$", "", file_name or "")
    field, check = JUDGED.get(base, (None, None))
    place = names.index(field) if names and field in names else -1
    out = []
    for at, values, problem in parse_row(line, len(names) if names else 0):
        if problem is None and place >= 0 and not value_is_valid(check, values[place]):
            problem = SyntaxProblem(INVALID_VALUE, at, f"{field}={values[place]!r}")
        out.append((at, values, problem))
    return out


def judge_line(line: str, header: str | None, file_name: str | None) -> SyntaxProblem | None:
    """The first fault of one record."""
    return next((p for _, _, p in read_row(line, header, file_name) if p), None)


def _with_headers(lines: DataFrame) -> DataFrame:
    """(line_id, feed_file, line, header) of the records that are no headers; of several headers of a file the one with the lowest line_id holds."""
    headers = lines.filter("line_no = 1").groupBy("feed_file").agg(F.min_by("line", "line_id").alias("header"))
    body = lines.filter("line_no is null or line_no != 1").select("line_id", "feed_file", "line")
    return body.join(headers, "feed_file", "left").select("line_id", "feed_file", "line", "header")


def faulty_lines(lines: DataFrame) -> DataFrame:
    """(line_id, feed_file, reason, at_offset, detail) of the records of raw_lines(line_id, feed_file, line_no, line) that cannot be read.

    Headers and lines of white space only give no row; null lines count as white space. Other columns
    are ignored.
    """
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for line_id, name, line, header in zip(*(batch[c] for c in batch.columns)):
                if not blank(line) and (p := judge_line(line, header, name)):
                    rows.append((line_id, name, p.reason, p.offset, p.detail))
            yield pd.DataFrame(rows, columns=["line_id", "feed_file", "reason", "at_offset", "detail"])

    return _with_headers(lines).mapInPandas(judge, "line_id long, feed_file string, reason string, at_offset int, detail string")


def readable_lines(lines: DataFrame, base: str) -> DataFrame:
    """The sound records of raw_lines for files named ``base``.txt, typed: (line_id, at_offset, and the columns of LOADED[base]).

    Rows with a fault give the records after it at which reading resumed. A field that the header lacks,
    a blank one and one that is not of its type is null; without a readable header nothing is loaded.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for line_id, name, line, header in zip(*(batch[c] for c in batch.columns)):
                if not blank(line) and header is not None and (names := _header(header)):
                    rows += [(line_id, at, dict(zip(names, values))) for at, values, problem in read_row(line, header, name) if problem is None]
            yield pd.DataFrame(rows, columns=["line_id", "at_offset", "fields"])

    of_file = lines.filter(F.col("feed_file").rlike(f"(^|/){base}\\.txt$"))
    found = _with_headers(of_file).mapInPandas(read, "line_id long, at_offset int, fields map<string,string>")
    return found.select("line_id", "at_offset", *(_typed(F.try_element_at("fields", F.lit(c)), kind).alias(c) for c, kind in LOADED[base].items()))


def _typed(value: Column, kind: str) -> Column:
    value = F.nullif(value, F.lit(""))
    if kind == "day":
        return F.date_from_unix_date(real_day(value))
    if kind == "flag":
        return F.when(value == "1", True).when(value == "0", False)
    if kind == "number":
        return F.when(value.rlike(f"^{DECIMAL_PATTERN}$"), value).try_cast("double")
    return F.when(digits_only(value), value).try_cast("long") if kind == "digits" else value


def faulty_values(df: DataFrame, src: str, key: Column, valid: Column) -> DataFrame:
    """(src, rec_key, reason) of the rows of a typed table whose judged column is not ``valid``; null counts as not valid."""
    return (
        df.filter(~F.coalesce(valid, F.lit(False)))
        .select(F.lit(src).alias("src"), key.cast("string").alias("rec_key"), F.lit(INVALID_VALUE).alias("reason"))
    )
