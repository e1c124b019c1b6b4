"""Pairs within buckets, whatever the size of a bucket.

A bucket larger than a bound is dealt into chunks and each pair of chunks becomes a
cell of its own, so that no task holds more than two chunks at once. Rows of a cell
reach one task in order, and the task compares them in numpy without emitting pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CELL = ("cell_a", "cell_b")


def deal_cells(rows: DataFrame, keys: list[str], spread: str, bound: int) -> DataFrame:
    """``rows`` sorted and dealt by bucket, with columns cell_a, cell_b and side.

    Buckets of up to ``bound`` rows stay whole (cell 0, 0). A larger one gets
    ceil(size / bound) chunks by the hash of ``spread``; a row goes to the cell of its
    chunk with every chunk, on side 0 of the cell if its chunk is the first. Pairs to
    compare in a cell: all where cell_a = cell_b, else those across sides.
    """
    hot = rows.groupBy(*keys).count().where(F.col("count") > bound)
    hot = hot.select(*keys, F.ceil(F.col("count") / bound).cast("int").alias("chunks"))
    n_hot = hot.count()
    if n_hot == 0:
        out = rows.select("*", *(F.lit(0).alias(c) for c in (*CELL, "side")))
    else:
        # A few rows for each large bucket; beyond this many the join shuffles.
        small = F.broadcast(hot) if n_hot <= 20_000 else hot
        out = rows.join(small, keys, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        out = out.withColumn("own", F.pmod(F.xxhash64(spread), F.col("chunks")).cast("int"))
        out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        out = out.select(
            *rows.columns,
            F.least("own", "other").alias("cell_a"),
            F.greatest("own", "other").alias("cell_b"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
    at = [*keys, *CELL]
    return out.repartition(*at).sortWithinPartitions(*at, "side")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the start of each; the last group of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(table, keys)
        last = int(starts[-1])
        if last:
            yield table.slice(0, last), starts[:-1]
        # A copy, as a slice would keep the whole batch.
        held = pa.Table.from_pylist([], schema=table.schema).to_batches() if last == table.num_rows else table.slice(last).take(pa.array(np.arange(table.num_rows - last))).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield table, group_starts(table, keys)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, dtype=bool)
    change[:1] = True
    for k in keys:
        x = table.column(k).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def pairs_by_shift(starts: np.ndarray, n: int, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j), i < j, within groups, in blocks of about ``most`` pairs."""
    ends = np.append(starts[1:], n)
    end_of = np.repeat(ends, ends - starts)
    left = np.arange(n)
    shift, parts, size = 1, [], 0
    while True:
        left = left[left + shift < end_of[left]]
        if not len(left):
            break
        parts.append((left, left + shift))
        size += len(left)
        if size >= most:
            yield np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            parts, size = [], 0
        shift += 1
    if parts:
        yield np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
