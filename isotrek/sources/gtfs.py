"""GTFS zips as string tables: a Python data source with one partition per table, never extracting a file."""

from __future__ import annotations

import csv
import hashlib
import io
import os
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone
from functools import partial
from urllib.parse import urlparse
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from isotrek.functions.values import WHITE_SPACE
from isotrek.operators.checks import FeedError

MAX_FEED_BYTES, CHUNK, MAX_DOWNLOAD_BYTES = 2 << 30, 64 << 10, 100 << 20
USER_AGENT, ANSWER_SECONDS = "isotrek (transit reach on Spark)", 60
SCHEMA = "table_name string, row_no long, fields map<string,string>, missing array<string>"


def safe_members(archive: zipfile.ZipFile, max_bytes: int = MAX_FEED_BYTES) -> list[str]:
    """The .txt members of a zip; a member that points outside it, or too many bytes unpacked, is an error."""
    total = 0
    for info in archive.infolist():
        name = info.orig_filename
        if "\\" in name or name.startswith("/") or re.match(r"^[A-Za-z]:", name) or ".." in name.split("/"):
            raise FeedError(f"unsafe path in zip: {name}")
        total += info.file_size
    if total > max_bytes:
        raise FeedError(f"zip unpacks to {total} bytes, more than {max_bytes}")
    return [n for n in archive.namelist() if n.endswith(".txt") and "/" not in n]


def parse_rows(lines: Iterable[str]) -> Iterator[tuple[dict[str, str], list[str]]]:
    """(fields, missing) of each row: header and values trimmed, rows of white space skipped.

    A short row lacks its last fields, a long one loses what has no header.
    """
    rows = csv.reader(lines)
    header = [h.strip(WHITE_SPACE) for h in next(rows, [])]
    for row in rows:
        values = [v.strip(WHITE_SPACE) for v in row]
        if any(values):
            yield dict(zip(header, values)), header[len(values) :]


def parse_table(raw: bytes, name: str) -> Iterator[tuple[dict[str, str], list[str]]]:
    """parse_rows of a whole file; a BOM is dropped, text that is not UTF-8 is an error."""
    try:
        text = raw.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise FeedError(f"{name}: not UTF-8 (byte {e.start})") from None
    yield from parse_rows(io.StringIO(text, newline=""))


class FeedReader(DataSourceReader):
    """Reads a member as a stream: a task holds one row at a time, however long the table is. A packed member cannot be divided."""

    def __init__(self, path: str, tables: list[str]):
        self.path, self.tables = path, tables

    def partitions(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.path) as archive:
            members = safe_members(archive)
        return [InputPartition(m) for m in members if not self.tables or m[:-4] in self.tables]

    def read(self, partition: InputPartition):
        name = partition.value
        try:
            with zipfile.ZipFile(self.path) as archive, archive.open(name) as packed, io.TextIOWrapper(packed, encoding="utf-8-sig", newline="") as lines:
                for row_no, (fields, missing) in enumerate(parse_rows(lines)):
                    yield name[:-4], row_no, fields, missing
        except UnicodeDecodeError as e:
            raise FeedError(f"{name}: not UTF-8 ({e.reason})") from None
        except (zipfile.BadZipFile, OSError) as e:
            raise FeedError(f"{name}: damaged ({e})") from None


class FeedSource(DataSource):
    """``spark.read.format("isotrek_gtfs").option("tables", "stops,trips").load("feed.zip")``; the zip has to be readable on all executors."""

    @classmethod
    def name(cls) -> str:
        return "isotrek_gtfs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        tables = [t for t in self.options.get("tables", "").split(",") if t]
        return FeedReader(self.options["path"], tables)


def read_feed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every table of a zip as strings, with ``row_no`` (file order) and ``_missing``; columns are what the header has."""
    from isotrek.session import ship

    ship(spark)
    spark.dataSource.register(FeedSource)
    with zipfile.ZipFile(path) as archive:
        members = safe_members(archive)
        headers = {}
        for m in members:
            with archive.open(m) as f:
                first = io.TextIOWrapper(f, encoding="utf-8-sig", errors="replace", newline="").readline()
            headers[m[:-4]] = [h.strip(WHITE_SPACE) for h in next(csv.reader([first]), [])]
    tables = {}
    for name, header in headers.items():
        rows = spark.read.format("isotrek_gtfs").option("tables", name).load(path)
        tables[name] = rows.select(*(F.try_element_at("fields", F.lit(h)).alias(h) for h in dict.fromkeys(header)), "row_no", F.col("missing").alias("_missing"))
    return tables


def web(url: str):
    """Open a web address; the server has to answer within ANSWER_SECONDS."""
    return urlopen(Request(url, headers={"User-Agent": USER_AGENT}), timeout=ANSWER_SECONDS)


def within(pieces: Iterable[bytes], limit: int, what: str) -> Iterator[bytes]:
    """The pieces of a stream; an error as soon as they are together longer than ``limit``."""
    room = limit
    for piece in pieces:
        if (room := room - len(piece)) < 0:
            raise FeedError(f"{what}: more than {limit} bytes")
        yield piece


def download(url: str, target: str, max_bytes: int = MAX_DOWNLOAD_BYTES, opener: Callable = web) -> int:
    """Fetch a feed and give its size, which is limited as declared and as it comes; a malformed declaration counts as none."""
    if urlparse(url).scheme not in ("http", "https", "file"):
        raise FeedError(f"{url}: not a web address")
    with opener(url) as answer:
        declared = re.fullmatch(r"\s*(\d+)\s*", answer.headers.get("Content-Length") or "")
        if declared and int(declared[1]) > max_bytes:
            raise FeedError(f"{url}: {declared[1]} bytes declared, more than {max_bytes}")
        with open(target, "wb") as out:
            out.writelines(within(iter(partial(answer.read, CHUNK), b""), max_bytes, url))
            return out.tell()


def manifest_of(path: str) -> tuple[int, str]:
    """Size and SHA-256 of a file, read in pieces."""
    with open(path, "rb") as f:
        return os.path.getsize(path), hashlib.file_digest(f, "sha256").hexdigest()


def manifest(path: str, source: str, now: datetime | None = None) -> dict:
    """Source, time, size and SHA-256 of a fetched file."""
    size, digest = manifest_of(path)
    return {"source": source, "fetched_at": (now or datetime.now(timezone.utc)).isoformat(), "bytes": size, "sha256": digest}
