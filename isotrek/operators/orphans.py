"""References to records that do not exist, direct and inherited."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotrek.functions.values import key
from isotrek.session import cut

NEVER = "timestamp_ntz'9999-12-31 23:59:59'"


@dataclass(frozen=True)
class Reference:
    """One foreign key: ``child``.``field`` names ``parent``.``parent_key``; ``rec_key`` identifies a child row."""

    child: str
    field: str
    rec_key: str
    parent: str
    parent_key: str
    month_from: str | None = None


def known_keys(parent: DataFrame, parent_key: str) -> DataFrame:
    """One row per key of a parent: first arrival, and the last withdrawal (a row never withdrawn counts as withdrawn at the end of time).

    Combined before the shuffle, so that a key of very many rows costs one row per partition.
    """
    deleted = F.coalesce(F.col("deleted_at"), F.expr(NEVER)) if "deleted_at" in parent.columns else F.expr(NEVER)
    return (
        parent.select(key(parent_key).alias("ref"), F.col("received_at").alias("arrived"), deleted.alias("gone"))
        .filter("ref is not null")
        .groupBy("ref")
        .agg(F.min("arrived").alias("first_arrival"), F.max("gone").alias("last_gone"))
    )


def row_identity(ref: Reference, references: list[Reference]) -> Column:
    """What tells one row of a referenced child table from another of the same key: null where nothing refers to the table."""
    if all(r.parent != ref.child for r in references):
        return F.lit(None).cast("string")
    fields = dict.fromkeys([ref.rec_key, *(r.field for r in references if r.child == ref.child), "received_at"])
    return F.to_json(F.struct(*(F.col(f).cast("string").alias(f) for f in fields)))


def direct_orphans(child: DataFrame, parent: DataFrame, ref: Reference, identity: Column | None = None) -> DataFrame:
    """(src, field, rec_key, ref_month, kind, row) of child rows whose reference does not resolve.

    kind: missing (no row has the key), else deleted (every row with it was withdrawn at or before the
    child arrived), else late (every row with it arrived after the child). References are stripped;
    null and blank ones give no row. A child without received_at can only miss its parent. Repeated
    rows of a child give one row.
    """
    identity = F.lit(None).cast("string") if identity is None else identity
    rows = child.select(
        key(ref.field).alias("ref"), key(F.col(ref.rec_key).cast("string")).alias("rec_key"), _month(ref).alias("ref_month"), F.col("received_at").alias("seen"), identity.alias("row")
    ).filter("ref is not null")
    kind = (
        F.when(F.col("last_gone").isNull(), "missing")
        .when(F.col("last_gone") <= F.col("seen"), "deleted")
        .when(F.col("first_arrival") > F.col("seen"), "late")
    )
    return (
        rows.join(known_keys(parent, ref.parent_key), "ref", "left")
        .withColumn("kind", kind)
        .filter("kind is not null")
        .select(F.lit(ref.child).alias("src"), F.lit(ref.field).alias("field"), "rec_key", "ref_month", "kind", "row")
        .distinct()
    )


def orphan_cascade(tables: dict[str, DataFrame], references: list[Reference]) -> DataFrame:
    """(src, field, rec_key, ref_month, kind, level): orphans of a foreign-key graph; level 0 is direct.

    A key is lost once every row that has it is an orphan; a row whose reference names a lost key is an
    inherited orphan in that field (kind 'inherited', level one more than the round before), unless the
    same reference is an orphan already. A fixpoint: each round semi-joins the children of the keys that
    the last round lost, and is cut by a checkpoint. In a graph without cycles the longest chain of
    references bounds the rounds; with a cycle an empty round ends them.
    """
    by_table = {r.child: r for r in references}
    found = cut(_union([direct_orphans(tables[r.child], tables[r.parent], r, row_identity(r, references)).withColumn("level", F.lit(0)) for r in references]))
    rounds, level, frontier = longest_chain(references), 0, found
    inner = sorted({r.parent for r in references} & set(by_table))
    while inner and (rounds is None or level < rounds):
        level += 1
        lost = {t: _lost_keys(tables[t], by_table[t], row_identity(by_table[t], references), found, frontier) for t in inner}
        heirs = _union([_heirs(tables[r.child], lost[r.parent], r, row_identity(r, references), level) for r in references if r.parent in inner])
        known = found.select("src", "field", "rec_key", F.coalesce("row", F.lit("")).alias("same")).distinct()
        frontier = cut(heirs.withColumn("same", F.coalesce("row", F.lit(""))).join(known, ["src", "field", "rec_key", "same"], "left_anti").select(found.columns))
        if rounds is None and frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found.drop("row").distinct()


def _lost_keys(table: DataFrame, ref: Reference, identity: Column, found: DataFrame, frontier: DataFrame) -> DataFrame:
    """(ref): the keys of the last round's orphans that no sound row of the table has."""
    orphaned = found.filter(F.col("src") == ref.child).select("row").distinct()
    fresh = frontier.filter(F.col("src") == ref.child).select(F.col("rec_key").alias("ref")).distinct()
    rows = table.select(key(F.col(ref.rec_key).cast("string")).alias("ref"), identity.alias("row"))
    sound = rows.join(fresh, "ref", "left_semi").join(orphaned, "row", "left_anti").select("ref")
    return fresh.join(sound, "ref", "left_anti")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _month(ref: Reference) -> Column:
    if not ref.month_from:
        return F.lit(None).cast("string")
    return F.concat_ws("-", F.substring(ref.month_from, 1, 4), F.substring(ref.month_from, 5, 2))


def _heirs(child: DataFrame, lost: DataFrame, ref: Reference, identity: Column, level: int) -> DataFrame:
    rows = child.select(key(ref.field).alias("ref"), key(F.col(ref.rec_key).cast("string")).alias("rec_key"), _month(ref).alias("ref_month"), identity.alias("row"))
    return (
        rows.join(lost, "ref", "left_semi")
        .select(F.lit(ref.child).alias("src"), F.lit(ref.field).alias("field"), "rec_key", "ref_month", F.lit("inherited").alias("kind"), "row")
        .distinct()
        .withColumn("level", F.lit(level))
    )


def longest_chain(references: list[Reference]) -> int | None:
    """Steps from a direct orphan down to its farthest possible heir; None if the references form a cycle."""
    children: dict[str, set[str]] = {}
    for r in references:
        children.setdefault(r.parent, set()).add(r.child)

    def below(table: str, above: tuple[str, ...]) -> int | None:
        if table in above:
            return None
        depths = [below(c, (*above, table)) for c in children.get(table, ())]
        return None if None in depths else max((1 + d for d in depths), default=0)

    depths = [below(r.child, ()) for r in references]
    return None if None in depths else max(depths, default=0)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, month and kind."""
    return orphans.groupBy("src", "field", "ref_month", "kind").agg(F.count("*").alias("orphans"))
