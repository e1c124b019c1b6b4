"""Exact k-nearest-neighbour joins over dense, sparse and rigid-body distances.

Both sides are packed into blocks. A task takes a block of queries and has the blocks of
references pass by, one after another; it keeps the nearest of each query so far, and gives
k rows for each query at the end. References of a checked size are broadcast. Others are written
once, and each task reads that table from its files, so none is sent for a block of queries; pivots tell which blocks
of references a block of queries need not look at. Where tasks cannot read the table's store,
references go by a shuffle to each block of queries that can have a neighbour among them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import files_of, kept, read_batches
from .trajectory import kabsch

#: Rows of a block of queries at most, and of references; numbers in all references that are broadcast; pivots.
QUERY_ROWS, REF_ROWS, BROADCAST_NUMBERS, PIVOTS = 8192, 1024, 4_000_000, 512
#: Queries that a block of references meets at once, rows of a batch of results at most, and blocks of references read at once.
NEAR_ROWS, OUT_ROWS, READ_BLOCKS = 256, 65_536, 4

Distance = Callable[[list, list], np.ndarray]


def pack(df: DataFrame, blocks: int, cols: list[str]) -> DataFrame:
    """(block, rows): rows of ``df`` in blocks by the hash of their id."""
    rows = F.struct("id", *cols)
    return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_list(rows)).alias("rows"))


def nearest(d: np.ndarray, ref_ids: np.ndarray, n: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the n least of each row, or all, by distance and then id; NaN never."""
    good = ~np.isnan(d)
    if n is None or n >= d.shape[1]:
        i, j = np.nonzero(good)
        return i, j
    x = np.where(good, d, np.inf)
    cut = np.partition(x, n - 1, axis=1)[:, n - 1 : n]
    i, j = np.nonzero(good & (x <= cut))
    keep = first_of_each(i, d[i, j], ref_ids[j], n)
    return i[keep], j[keep]


def within(d: np.ndarray, ref_ids: np.ndarray, n: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` without what is further than a row's ``bound``, perhaps with more than n of a row."""
    i, j = np.nonzero(d <= bound[:, None])
    return (i, j) if len(i) <= 4 * n * len(d) else nearest(np.where(d <= bound[:, None], d, np.nan), ref_ids, n)


def first_of_each(i: np.ndarray, d: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n first of each ``i`` by distance and then id, in that order."""
    o = np.lexsort((ids, d, i))
    own = i[o]
    return o[np.arange(len(o)) - np.searchsorted(own, own) < n]


def measured(ref: DataFrame, query: DataFrame, size: Column, alike: bool) -> tuple:
    """Rows and numbers of both sides; with ``alike`` rows of unlike sizes raise an error."""
    sizes = [F.count("*").alias("n"), F.sum(size).alias("numbers"), F.min(size).alias("low"), F.max(size).alias("high")]
    r, q = ref.agg(*sizes).first(), query.agg(*sizes).first()
    if alike and len({x for side in (r, q) for x in (side.low, side.high) if x is not None}) > 1:
        raise ValueError("the rows have unlike lengths")
    return r, q


def tasks_for(df: DataFrame, n: int, rows: int) -> int:
    return max(1, math.ceil(n / rows), min(n // 32, 2 * df.sparkSession.sparkContext.defaultParallelism))


def broadcast_sides(ref: DataFrame, query: DataFrame, cols: list[str], r, q, query_rows: int, ref_rows: int) -> DataFrame:
    """(q_block, kind, rows): each block of queries (kind 0) and after it all blocks of references (kind 1), in one task.

    All references in a few rows; each block of queries is one row and meets them where it is.
    """
    whole = pack(ref, max(1, math.ceil(r.n / ref_rows)), cols).agg(F.collect_list("rows").alias("refs"))
    n_q = tasks_for(ref, q.n, query_rows)
    both = pack(query, n_q, cols).repartitionById(n_q, F.col("block").cast("int")).join(F.broadcast(whole), F.lit(True))
    parts = F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.col("rows"))), F.transform("refs", lambda x: F.struct(F.lit(1).alias("kind"), x.alias("rows"))))
    return both.select("block", F.explode(parts).alias("p")).select(F.col("block").alias("q_block"), "p.kind", "p.rows")


def shuffled_sides(ref: DataFrame, query: DataFrame, cols: list[str], r, q, query_rows: int, ref_rows: int) -> DataFrame:
    """``broadcast_sides`` of references that a shuffle sends to each block of queries."""
    n_q = tasks_for(ref, q.n, query_rows)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long")))
    refs = pack(ref, max(1, math.ceil(r.n / ref_rows)), cols)
    tagged = refs.select(every.alias("q_block"), F.lit(1).alias("kind"), "rows").unionByName(pack(query, n_q, cols).select(F.col("block").alias("q_block"), F.lit(0).alias("kind"), "rows"))
    return tagged.repartition(n_q, "q_block").sortWithinPartitions("q_block", "kind")


def members(x: pa.Array, cols: list[str]) -> tuple[np.ndarray, list]:
    """Ids and the other fields of packed rows."""
    return x.field(0).to_numpy(zero_copy_only=False), [x.field(c + 1) for c in range(len(cols))]


def cells(ref: DataFrame, query: DataFrame, cols: list[str], distance: Distance, need: int, own_counts: bool, query_rows: int, ref_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References and queries (block, rows) and the pairs (q_block, block) without blocks of references that cannot hold a neighbour of any query of a block.

    Rows go to the nearest of some pivots, so blocks are close together. A reference block
    knows how near and how far from its pivot its rows are; a query's distance to that
    pivot then bounds its distance to all of them. A query needs no block that is further
    than its ``need`` nearest pivots, or than so many rows of the first block of its own cell.
    Pivots are references themselves, PIVOTS at most.
    """
    spark = ref.sparkSession
    some = ref.orderBy(F.xxhash64("id"), "id").limit(PIVOTS)
    packed = some.agg(F.array_sort(F.collect_list(F.struct("id", *cols))).alias("rows")).toArrow().column("rows").combine_chunks()
    sent = spark.sparkContext.broadcast(packed)
    row = "struct<" + ",".join(f"{c}:{t}" for c, t in ref.select("id", *cols).dtypes) + ">"

    def placed(df: DataFrame, rows: int) -> DataFrame:
        """(cell, chunk, rows): rows by their nearest pivot, a large cell in chunks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, parts = members(sent.value.values, cols)
            for b in batches:
                if not b.num_rows:
                    continue
                d = distance([b.column(c + 1) for c in range(len(cols))], parts)
                ok = ~np.isnan(d).all(axis=1)  # what has no distance to any has no neighbours
                b, d = b.filter(pa.array(ok)), d[ok]
                cell = np.argmin(np.where(np.isnan(d), np.inf, d), axis=1)
                packed_ = pa.StructArray.from_arrays([b.column(c) for c in range(len(cols) + 1)], names=["id", *cols])
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), packed_], names=["cell", "row"])

        at = df.select("id", *cols).mapInArrow(run, f"cell int, row {row}")
        sizes = at.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("chunks"))  # a row for each pivot
        at = at.join(F.broadcast(sizes), "cell").withColumn("chunk", F.pmod(F.xxhash64("row.id"), F.col("chunks")))
        return at.groupBy("cell", "chunk").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    refs, queries = (kept(placed(df, n).withColumn("block", (F.col("cell").cast("long") * 2**32 + F.col("chunk")))) for df, n in ((ref, ref_rows), (query, query_rows)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cell, block, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                _, own = members(x.values, cols)
                _, parts = members(sent.value.values, cols)
                d = distance(own, [p.slice(cell, 1) for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([block]), pa.array([d.min()]), pa.array([d.max()])], names=["cell", "block", "low", "high"])

    # Four numbers for each block of ref_rows rows.
    spread = refs.select("cell", "block", "rows").mapInArrow(measure, "cell int, block long, low double, high double").toArrow()
    ranges = spark.sparkContext.broadcast(tuple(spread.column(c).to_numpy() for c in ("cell", "block", "low", "high")))

    def bound(d: np.ndarray, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The ``need``-th least distance of each query to some references; infinite if they are too few."""
        if need > d.shape[1]:
            return np.full(len(d), np.inf)
        other = np.where(np.isnan(d) | (False if own_counts else own[:, None] == ids[None, :]), np.inf, d)
        return np.partition(other, need - 1, axis=1)[:, need - 1]

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = members(sent.value.values, cols)
        cell, block, low, high = ranges.value
        for b in batches:
            for q_block, x, home in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                own, fields = members(x.values, cols)
                d = distance(fields, parts)
                most = bound(d, own, ids)
                if home.is_valid:
                    there, rows_ = members(home.values, cols)
                    most = np.minimum(most, bound(distance(fields, rows_), own, there))
                near = np.zeros(len(block), dtype=bool)
                for a in range(0, len(block), 4096):  # blocks of references at once
                    z = slice(a, a + 4096)
                    dq = d[:, cell[z]]
                    # Rounding may not cost a neighbour.
                    least = np.maximum(dq - high[z], low[z] - dq) - 1e-6 * (dq + high[z])
                    near[z] = (least <= most[:, None]).any(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(near.sum(), q_block)), pa.array(block[near])], names=["q_block", "block"])

    home = refs.where("chunk = 0").select("cell", F.col("rows").alias("home"))
    pairs = queries.join(home, "cell", "left").select("block", "rows", "home").mapInArrow(wanted, "q_block long, block long")
    return refs.select("block", "rows"), queries.select("block", "rows"), pairs


def pivoted(ref: DataFrame, query: DataFrame, cols: list[str], distance: Distance, need: int, own_counts: bool, query_rows: int, ref_rows: int) -> DataFrame:
    """``shuffled_sides`` without the blocks of references that ``cells`` leaves out."""
    return sent(*cells(ref, query, cols, distance, need, own_counts, query_rows, ref_rows))


def sent(refs: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """``shuffled_sides`` of ``cells``."""
    sent_refs = pairs.join(refs, "block").select("q_block", F.lit(1).alias("kind"), "rows")
    both = sent_refs.unionByName(queries.select(F.col("block").alias("q_block"), F.lit(0).alias("kind"), "rows"))
    return both.repartition("q_block").sortWithinPartitions("q_block", "kind")


def knn_join(ref: DataFrame, query: DataFrame | None, cols: list[str], distance: Distance, k: int | None, exclude: str, rows: int = REF_ROWS, query_rows: int = QUERY_ROWS, sound: Column | None = None, size: Column | None = None, alike: bool = False, bounded: bool = False) -> DataFrame:
    """(src, dst, rank, dist) of the k nearest rows of ``ref`` for each row of ``query``.

    Ranks start at 1; equal distances go by id. ``exclude``: "self" leaves the rows of the
    same id out, "rank0" the nearest one whatever it is, "none" nothing. k None gives all
    pairs with rank null (J5). Rows with a null id and rows that are not ``sound``, as with
    null or non-finite numbers, are left out on both sides, and so are pairs whose
    distance is not a number. If fewer than k rows are left, all are returned. Rows that
    repeat an id are points of their own: each has its ranks. Empty sides give no rows.
    A ``bounded`` distance keeps the triangle inequality, which spares blocks of references
    that are too far where these are too many to broadcast.
    """
    if exclude not in ("self", "rank0", "none"):
        raise ValueError(f"exclude: {exclude}")
    if k is not None and k < 1:
        raise ValueError("k must be 1 or more")
    query = ref if query is None else query
    sound, size = F.lit(True) if sound is None else sound, F.size(cols[0]) if size is None else size
    ref, query = (x.select("id", *cols).where(F.col("id").isNotNull() & sound) for x in (ref, query))
    drop = 1 if exclude == "rank0" else 0
    need = None if k is None else k + drop
    search = SEARCH.get(distance)

    class Near:
        """Some queries and the nearest of each so far."""

        def __init__(self, x: pa.Array) -> None:
            self.ids, self.parts = members(x, cols)
            self.best: list[np.ndarray] = []
            self.bound = np.full(len(self.ids), np.inf)

        def out(self, i: np.ndarray, ids: np.ndarray, d: np.ndarray, rank: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(i), OUT_ROWS):
                z = slice(a, a + OUT_ROWS)
                ranks = pa.nulls(len(i[z]), pa.int64()) if rank is None else pa.array(rank[z])
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[i[z]]), pa.array(ids[z]), ranks, pa.array(d[z])], names=["src", "dst", "rank", "dist"])

        def meet(self, ids: np.ndarray, parts: list) -> Iterator[pa.RecordBatch]:
            """Weighs a block of references; all pairs are given at once."""
            if search is not None and need is not None:
                same = (np.zeros(0, dtype=np.int64),) * 2
                if exclude == "self":
                    at = np.flatnonzero(np.isin(self.ids, ids))
                    same = np.nonzero(self.ids[at, None] == ids[None, :])
                    same = at[same[0]], same[1]
                i, j, d = search(self.parts, parts, same, need, self.bound)
                if len(i):
                    self.add(i, ids[j], d)
                return
            d = distance(self.parts, parts)
            if exclude == "self":
                at = np.flatnonzero(np.isin(self.ids, ids))
                if len(at):
                    d[at] = np.where(self.ids[at, None] == ids[None, :], np.nan, d[at])
            if need is None:
                i, j = nearest(d, ids, None)
                yield from self.out(i, ids[j], d[i, j], None)
                return
            i, j = within(d, ids, need, self.bound)
            if len(i):
                self.add(i, ids[j], d[i, j])

        def add(self, *new: np.ndarray) -> None:
            best = [np.concatenate(p) for p in zip(self.best, new)] if self.best else list(new)
            keep = first_of_each(best[0], best[2], best[1], need)
            self.best = [p[keep] for p in best]
            count = np.bincount(self.best[0], minlength=len(self.ids))
            full = np.flatnonzero(count >= need)
            self.bound[full] = self.best[2][np.cumsum(count)[full] - 1]

        def ranked(self) -> Iterator[pa.RecordBatch]:
            if self.best:
                i, ids, d = self.best
                rank = np.arange(len(i)) - np.searchsorted(i, i) + 1 - drop
                yield from self.out(*(x[rank > 0] for x in (i, ids, d)), rank[rank > 0])

    def few(x: pa.Array) -> list[Near]:
        """A block of queries by so many that their distances to a block of references stay in the cache."""
        return [Near(x.slice(a, NEAR_ROWS)) for a in range(0, len(x), NEAR_ROWS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, here = None, []
        for b in batches:
            for own, kind, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if kind == 0:
                    for near in here:
                        yield from near.ranked()
                    block, here = own, few(packed.values)
                elif own == block:  # else no query fell into this block
                    x = members(packed.values, cols)
                    for near in here:
                        yield from near.meet(*x)
        for near in here:
            yield from near.ranked()

    out = "src long, dst long, rank long, dist double"
    r, q = measured(ref, query, size, alike)
    if (r.numbers or 0) <= BROADCAST_NUMBERS:
        return broadcast_sides(ref, query, cols, r, q, query_rows, rows).mapInArrow(run, out)
    if bounded and need is not None:
        refs, queries, pairs = cells(ref, query, cols, distance, need, exclude != "self", query_rows, rows)
    else:
        refs, queries, pairs = kept(pack(ref, max(1, math.ceil(r.n / rows)), cols)), pack(query, tasks_for(ref, q.n, query_rows), cols), None
    files = files_of(refs)
    if files is None:
        return (shuffled_sides(ref, query, cols, r, q, query_rows, rows) if pairs is None else sent(refs, queries, pairs)).mapInArrow(run, out)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = [(None if wanted is None else set(wanted), few(packed.values)) for b in batches for packed, wanted in zip(b.column(0), b.column(1).to_pylist())]
        if not here:
            return
        for b in read_batches(files, ["block", "rows"], READ_BLOCKS):
            for block, packed in zip(b.column(0).to_pylist(), b.column(1)):
                x = members(packed.values, cols)
                for wanted, some in here:
                    for near in some if wanted is None or block in wanted else ():
                        yield from near.meet(*x)
        for _, some in here:
            for near in some:
                yield from near.ranked()

    queries = queries.withColumnRenamed("block", "q_block")
    if pairs is None:
        queries = queries.withColumn("wanted", F.lit(None).cast("array<long>"))
    else:
        queries = queries.join(pairs.groupBy("q_block").agg(F.collect_list("block").alias("wanted")), "q_block")
    n_tasks = tasks_for(ref, q.n, QUERY_ROWS)
    # Blocks of cells are many and unlike, others as many as there is room for.
    queries = queries.repartitionById(n_tasks, F.pmod("q_block", F.lit(n_tasks)).cast("int")) if pairs is None else queries.repartition(n_tasks, "q_block")
    return queries.select("rows", "wanted").mapInArrow(stream, out)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def dense(x: list) -> np.ndarray:
    a = x[0]
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def euclidean_blocks(q: list, r: list) -> np.ndarray:
    # Centred, so that the products lose little; differences are taken where they would.
    x, y = dense(q), dense(r)
    c = y.mean(axis=0)
    x, y = x - c, y - c
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    both = xx[:, None] + yy[None, :]
    d2 = x @ y.T
    d2 *= -2
    d2 += both
    both *= 1e-3
    i, j = np.nonzero(d2 < both)
    g = x[i] - y[j]
    d2[i, j] = np.einsum("ij,ij->i", g, g)
    np.maximum(d2, 0.0, out=d2)
    return np.sqrt(d2, out=d2)


def euclidean_search(q: list, r: list, same: np.ndarray, n: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of what is no further than a row's ``bound``, or than its n least where that is infinite; perhaps more.

    One product tells which pairs can be near enough, with room for its rounding, and only
    their differences are taken; so copies of a vector are equally far, whatever block they
    are in. ``same`` are places (row, column) that do not count.
    """
    x, y = dense(q), dense(r)
    c = y.mean(axis=0)
    xc, yc = x - c, y - c
    xx, yy = np.einsum("ij,ij->i", xc, xc), np.einsum("ij,ij->i", yc, yc)
    near = xc @ yc.T
    near -= yy / 2  # the nearer, the larger
    near[same] = -np.inf
    room = 1e-9 * (xx + yy.max())
    least = (xx - bound * bound) / 2 - room
    none = np.flatnonzero(np.isinf(bound))
    if len(none):
        m = near.shape[1] - n
        least[none] = np.partition(near[none], m, axis=1)[:, m] - room[none] if m > 0 else -np.finfo(float).max
    i, j = np.divmod(np.flatnonzero(near >= least[:, None]), near.shape[1])
    if not np.isfinite(least).all():
        i, j = (z[np.isfinite(near[i, j])] for z in (i, j))
    g = x[i] - y[j]
    return i, j, np.sqrt(np.einsum("ij,ij->i", g, g))


#: Distances that need not be taken for every pair.
SEARCH = {euclidean_blocks: euclidean_search}


def correlation_blocks(q: list, r: list) -> np.ndarray:
    def unit(x: np.ndarray) -> np.ndarray:
        x = x - x.mean(axis=1, keepdims=True)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(size > 0, x / np.where(size > 0, size, 1), np.nan)

    return np.sqrt(np.maximum(0.0, (1 - unit(dense(q)) @ unit(dense(r)).T) / 2))


def sparse_blocks(q: list, r: list) -> np.ndarray:
    """Absent features are 0; pairs without a common feature keep their distance."""

    def parts(x: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.diff(x[0].offsets.to_numpy())
        return np.repeat(np.arange(len(size)), size), x[0].flatten().to_numpy(zero_copy_only=False), x[1].flatten().to_numpy(zero_copy_only=False).astype(np.float64)

    (qr, qf, qv), (rr, rf, rv) = parts(q), parts(r)
    nq, nr = len(q[0]), len(r[0])
    both = np.intersect1d(qf, rf)
    a, b = np.zeros((nq, len(both))), np.zeros((nr, len(both)))
    for m, rows, f, v in ((a, qr, qf, qv), (b, rr, rf, rv)):
        at = np.searchsorted(both, f)
        ok = (at < len(both)) & (both[np.minimum(at, max(len(both) - 1, 0))] == f) if len(both) else np.zeros(len(f), dtype=bool)
        m[rows[ok], at[ok]] = v[ok]
    d2 = np.bincount(qr, qv * qv, nq)[:, None] + np.bincount(rr, rv * rv, nr)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.where(d2 > 1e-12, d2, 0.0))


def knn(ref: DataFrame, k: int | None, query: DataFrame | None = None, metric: str | Distance = "euclidean", exclude: str = "self") -> DataFrame:
    """Dense vectors (id, v array<double>); metric "euclidean", "correlation" or a function of two blocks.

    Null and empty vectors and those with null or non-finite components are left out;
    vectors of unlike lengths raise an error.
    """
    distance = {"euclidean": euclidean_blocks, "correlation": correlation_blocks}.get(metric, metric)
    return knn_join(ref, query, ["v"], distance, k, exclude, sound=(F.size("v") > 0) & F.forall("v", finite), size=F.size("v"), alike=True, bounded=isinstance(metric, str))


def knn_sparse(ref: DataFrame, k: int | None, query: DataFrame | None = None, exclude: str = "self") -> DataFrame:
    """Sparse vectors (id, idx array<int>, val array<double>) under the Euclidean distance.

    Rows whose two arrays differ in length or hold nulls or non-finite values are left out.
    """
    sound = (F.size("idx") == F.size("val")) & F.forall("idx", lambda x: x.isNotNull()) & F.forall("val", finite)
    return knn_join(ref, query, ["idx", "val"], sparse_blocks, k, exclude, 256, 1024, sound, 2 * F.size("idx"))


def knn_rmsd(ref: DataFrame, k: int | None, query: DataFrame | None = None, masses: list[float] | None = None, fit: bool = True, scale: float = 10.0, exclude: str = "self") -> DataFrame:
    """Structures (id, coords array<array<double>>) under the RMSD of centred, optionally fitted, structures.

    Structures without atoms, with an atom of not three coordinates or with null or non-finite ones are left out; unlike numbers of atoms raise an error.
    """
    m = None if masses is None else np.asarray(masses, dtype=np.float64)

    def blocks(x: list) -> np.ndarray:
        a = x[0]
        c = a.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1, 3)
        w = np.ones(c.shape[1]) if m is None else m
        return c - np.einsum("a,nak->nk", w, c)[:, None, :] / w.sum()

    def distance(q: list, r: list) -> np.ndarray:
        x, y = blocks(q), blocks(r)
        return kabsch(x, y, np.ones(x.shape[1]) if m is None else m, fit) * scale

    sound = (F.size("coords") > 0) & F.forall("coords", lambda p: F.coalesce(F.size(p) == 3, F.lit(False)) & F.forall(p, finite))
    return knn_join(ref, query, ["coords"], distance, k, exclude, 256, 256, sound, 3 * F.size("coords"), alike=True, bounded=True)
