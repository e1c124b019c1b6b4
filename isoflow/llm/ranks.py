"""Ranks over a whole table without a task that orders it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, written, with ``name`` from 0 on, each number once; what comes to the driver is a count for each partition."""
    at = cut(df.withColumn(name, F.monotonically_increasing_id()))
    # The id holds the partition above bit 33 and the place below.
    part = F.shiftright(name, 33).cast("int")
    sizes = {r.part: r["count"] for r in at.groupBy(part.alias("part")).count().collect()}
    before, total = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    first = F.get(F.array(*(F.lit(x).cast("long") for x in before)), part)
    return at.withColumn(name, first + F.col(name).bitwiseAND((1 << 33) - 1))


def with_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``rank``, 1, 2, 3 .. in the given order.

    Rows are dealt by range and sorted there; the rank is the place in the range and the rows
    of the ranges before. Ties fall in one range, so ``order`` should end in columns that tell
    rows apart.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = numbered(df.repartitionByRange(parts, *order).sortWithinPartitions(*order), "rank")
    return at.withColumn("rank", F.col("rank") + 1)
