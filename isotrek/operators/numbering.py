"""Dense numbers by sorted key without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotrek.session import cut, shuffle_partitions

_ROWS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its low 33 bits


def dense_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name`` (long): the place of each row in the order of ``order``, from 0.

    Rows are range-partitioned and sorted by key; each partition counts its own rows, and the counts of
    the partitions before it (as many numbers as there are partitions) are added. Rows of equal keys
    are numbered in no defined order, so ``order`` should make the order total.
    """
    parts = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut(parts.withColumn("_id", F.monotonically_increasing_id()))
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit(_ROWS))
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).agg(F.count("*")).collect())
    before, total = [], 0
    for p, n in counts:
        before += [F.lit(p).cast("long"), F.lit(total).cast("long")]
        total += n
    offset = F.element_at(F.create_map(*before), part) if before else F.lit(0)
    return placed.withColumn(name, (offset + row).cast("long")).drop("_id")
