"""Commands beside the build: ``python -m isotrek.commands fetch|map|lint|release ...``; exit 0, 1 (fault) or 2 (expired)."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from datetime import date, datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from isotrek import build
from isotrek.operators import checks
from isotrek.operators.checks import ExpiredFeed, FeedError
from isotrek.params import ConfigError, lint_cities, parse_city
from isotrek.sources import gtfs, osm


def _city(path: str):
    return parse_city(json.loads(Path(path).read_text(encoding="utf-8")), Path(path).stem)


def fetch(args: argparse.Namespace, spark: SparkSession, today: date, opener: Callable) -> None:
    """Download a city's feed, check it, and leave the zip and its manifest in a folder."""
    city, folder = _city(args.city), Path(args.out)
    folder.mkdir(parents=True, exist_ok=True)
    sources = args.gtfs or (city.other.get("gtfs") or {}).get("sources", [])
    path, _, valid = build.fetch(sources, str(folder), today, spark, args.allow_expired, opener)
    source = path if path in sources else build.path_source(sources, path)
    note = gtfs.manifest(path, source) | {"valid_from": valid[0].isoformat(), "valid_to": valid[1].isoformat(), "expired": valid[1] < today}
    (folder / f"{city.id}.manifest.json").write_text(json.dumps(note, sort_keys=True, indent=2) + "\n", encoding="utf-8")
    print(f"{city.id}: {source}, valid {note['valid_from']} to {note['valid_to']}")


def save_map(args: argparse.Namespace, spark: SparkSession, ask: Callable[[str], dict]) -> None:
    """Ask the map servers for a city's boundary, basemap and streets and save them as its cache."""
    osm.save_cache(osm.fetch_live(spark, _city(args.city), ask), args.out)


def lint(args: argparse.Namespace) -> None:
    faults = lint_cities(args.folder)
    if faults:
        raise ConfigError("\n".join(f"{name}: {why}" for name, why in faults.items()))


def release(args: argparse.Namespace, spark: SparkSession, today: date) -> None:
    """Refuse a release in which a configured city has no data or an expired feed."""
    ids = [p.stem for p in sorted(Path(args.cities).glob("*.json")) if p.name != "schema.json"]
    if not ids:
        raise FeedError(f"{args.cities}: no city")
    found = [(i, json.loads(p.read_text(encoding="utf-8")).get("feed") or {}) for i in ids if (p := Path(args.data, i, "meta.json")).exists()]
    metas = spark.createDataFrame([(i, f.get("valid_to"), bool(f.get("expired"))) for i, f in found], "city string, valid_to string, expired boolean")
    problems = checks.release_problems(metas, spark.createDataFrame([(i,) for i in ids], "city string"), today).orderBy("city").collect()
    if problems:
        raise FeedError("\n".join(f"{r.city}: {r.problem}" for r in problems))


def main(argv: list[str] | None = None, spark: SparkSession | None = None, opener: Callable = gtfs.web, ask: Callable[[str], dict] = osm.ask) -> int:
    parser = argparse.ArgumentParser(prog="isotrek.commands")
    parser.add_argument("--today", help="day that counts as today, YYYY-MM-DD")
    kinds = parser.add_subparsers(dest="command", required=True)
    one = kinds.add_parser("fetch", help="download and check a feed")
    one.add_argument("city")
    one.add_argument("--gtfs", action="append", default=[])
    one.add_argument("--out", required=True)
    one.add_argument("--allow-expired", action="store_true")
    two = kinds.add_parser("map", help="save a city's map")
    two.add_argument("city")
    two.add_argument("--out", required=True)
    kinds.add_parser("lint", help="check configurations").add_argument("folder")
    four = kinds.add_parser("release", help="check built cities")
    four.add_argument("data")
    four.add_argument("cities")
    args = parser.parse_args(argv)
    today = date.fromisoformat(args.today) if args.today else datetime.now(timezone.utc).date()
    if spark is None and args.command != "lint":
        from isotrek.session import local_session

        spark = local_session()
    try:
        {"fetch": lambda: fetch(args, spark, today, opener), "map": lambda: save_map(args, spark, ask), "lint": lambda: lint(args), "release": lambda: release(args, spark, today)}[args.command]()
    except ExpiredFeed as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except (ConfigError, FeedError, osm.OsmError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
