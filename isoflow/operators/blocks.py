"""Symmetric sparse matrices in blocks, and their eigenpairs.

Nodes are dealt to blocks of rows; the entries between two blocks are a tile, packed once. A
product sends each block of the vectors to the tiles of its column, which give parts of the
product for the blocks of their rows; those are added up where the block's vectors are. So a
round of the eigensolver is one pass of Arrow batches, and what comes to the driver are
products of a few columns. Several matrices can be solved side by side, told apart by ``set``.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.geometry import ROOT_EPS

#: Rows of a block at least and at most.
LEAST_ROWS, MOST_ROWS = 1024, 65_536
KEY = ["set", "block"]
#: Blocks whose products of columns come to the driver as they are; those of more are added up in the tasks first.
FEW_BLOCKS = 64
#: Rounds without half the least residual after which an aim beyond the tolerance is given up.
PATIENCE = 8


def dropped(df: DataFrame) -> None:
    """Frees a table made by ``kept`` that no query reads any more."""
    paths = {x for x in df.inputFiles() if "/table-" in x}
    if not paths:
        df.unpersist()
        return
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(min(paths)).getParent()
    if path.getName().startswith("table-"):
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def files_of(df: DataFrame) -> tuple[str, list[str]] | None:
    """Files of a table made by ``kept``, in order, if Arrow can read them as Spark does; a task can then read them one after another.

    The first is the store as a URI, the others are paths there.
    """
    names = sorted(df.inputFiles())
    if not names or not all("/table-" in x for x in names):
        return None
    try:
        store = pafs.FileSystem.from_uri(names[0])[0]
        paths = [pafs.FileSystem.from_uri(x)[1] for x in names]
        if any(x.type != pafs.FileType.File for x in store.get_file_info(paths)):
            return None
    except (pa.ArrowException, OSError, ValueError):
        return None
    return names[0], paths


def read_batches(files: tuple[str, list[str]], columns: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of up to ``rows`` rows of ``files_of`` a table."""
    store = pafs.FileSystem.from_uri(files[0])[0]
    for path in files[1]:
        with store.open_input_file(path) as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=rows, columns=columns):
                yield b.select(columns)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the session's checkpoint folder.

    Unlike ``checkpoint`` a table does not carry the estimated sizes of what it was made from
    along, which multiply with every join of a loop. On one machine, as in tests, a session
    without a folder gets a temporary one; on a cluster the rows are held in memory then.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None and sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="isoflow-"))
    folder = sc.getCheckpointDir()
    if not folder:
        df = df.persist()
        df.count()
        return df
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def block_nodes(nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """(set, id, block, place) of ``nodes(set, id)``: blocks by the hash of the id, places from 0."""
    if rows is None:
        most = nodes.groupBy("set").count().agg(F.max("count")).first()[0] or 1
        rows = min(MOST_ROWS, max(LEAST_ROWS, math.ceil(most / nodes.sparkSession.sparkContext.defaultParallelism)))
        blocks = math.ceil(most / rows)
    else:
        blocks = max(1, math.ceil((nodes.groupBy("set").count().agg(F.max("count")).first()[0] or 1) / rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    return nodes.withColumn("block", block).withColumn("place", F.row_number().over(W.partitionBy("set", "block").orderBy("id")) - 1)


def pack_tiles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(set, block, to, rows, tile) of symmetric ``edges(set, i, j, w)``, each edge once: entries from the columns of ``block`` to the rows of ``to``."""
    both = edges.select("set", "i", "j", "w").unionByName(edges.where("i <> j").select("set", F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    a = nodes.select("set", F.col("id").alias("i"), F.col("block").alias("to"), F.col("place").alias("r"))
    b = nodes.select("set", F.col("id").alias("j"), "block", F.col("place").alias("c"))
    entries = both.join(a, ["set", "i"]).join(b, ["set", "j"]).select("set", "block", "to", "r", "c", "w")
    sizes = nodes.groupBy("set", F.col("block").alias("to")).agg(F.count("*").cast("int").alias("rows"))
    tiles = entries.groupBy("set", "block", "to").agg(F.array_sort(F.collect_list(F.struct("r", "c", "w"))).alias("e")).join(sizes, ["set", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tile = []
            for e in b.column(4):
                x = e.values
                r, c, w = (x.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                tile.append(np.int64(len(r)).tobytes() + r.astype(np.int32).tobytes() + c.astype(np.int32).tobytes() + w.astype(np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(tile, pa.binary())], names=["set", "block", "to", "rows", "tile"])

    return tiles.select("set", "block", "to", "rows", "e").mapInArrow(run, "set long, block int, to int, rows int, tile binary")


def matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(rows, -1)


def tile_times(tile: bytes, rows: int, x: np.ndarray) -> np.ndarray:
    """The tile times the rows of ``x``."""
    n = int(np.frombuffer(tile, dtype=np.int64, count=1)[0])
    r = np.frombuffer(tile, dtype=np.int32, offset=8, count=n)
    c = np.frombuffer(tile, dtype=np.int32, offset=8 + 4 * n, count=n)
    w = np.frombuffer(tile, dtype=np.float64, offset=8 + 8 * n, count=n)
    y = np.zeros((rows, x.shape[1]))
    if n:
        start = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        y[r[start]] = np.add.reduceat(w[:, None] * x[c], start, axis=0)
    return y


def partial_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, block, y) from rows (set, to, rows, tile, n, x)."""
    for b in batches:
        y = [tile_times(t.as_py(), r, matrix(x.as_py(), n)).tobytes() for r, t, n, x in zip(b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist(), b.column(5))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(y, pa.binary())], names=["set", "block", "y"])


def ritz(gram: np.ndarray, h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m largest values of the matrix within the span, and their columns' coefficients."""
    d = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    val, vec = np.linalg.eigh(gram * np.outer(d, d))
    ok = val > 1e-13 * val[-1]
    white = d[:, None] * vec[:, ok] / np.sqrt(val[ok])
    val, vec = np.linalg.eigh(white.T @ ((h + h.T) / 2) @ white)
    return val[::-1][:m], white @ vec[:, ::-1][:, :m]


STATE = "set long, block int, n int, s binary, a binary, g binary"


def largest_eigs(edges: DataFrame, n: int, iterations: int = 300, seed: int = 42, extra: int = 20, tolerance: float = ROOT_EPS, rows: int | None = None, aim: float | None = None) -> tuple[list[tuple], DataFrame]:
    """[(set, k, eigenvalue, residual)] and (set, id, k, value) of the n largest eigenvalues of each set of ``edges(set, i, j, w)``.

    Locally optimal conjugate gradients for a block of n + ``extra`` vectors: each round takes
    the best vectors within the span of the block, its residuals and its last steps. It ends
    when the residuals |Av - lv| / |l| of all wanted pairs are within ``tolerance`` and raises
    an error if ``iterations`` rounds do not get there. An eigenvalue is exact to the square
    of that, a vector only to its multiple by the inverse gap: with a smaller ``aim`` the
    rounds go on towards it for as long as they gain, and the best one counts. A set has as many pairs as it has
    nodes at most. Every round is checkpointed where the session has a folder for it. The
    products of columns come to the driver, a few kilobytes for each set.
    """
    edges = kept(edges.select(F.col("set").cast("long"), "i", "j", F.col("w").cast("double")))
    nodes = edges.select("set", F.col("i").alias("id")).union(edges.select("set", "j")).distinct()
    nodes = kept(block_nodes(nodes, rows))
    n_blocks = nodes.select(*KEY).distinct().count()
    parts = min(n_blocks, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tiles = kept(pack_tiles(edges, nodes)).repartition(parts, *KEY).persist()
    sizes = {r["set"]: r["count"] for r in nodes.groupBy("set").count().collect()}  # a row for each set
    width = {s: min(n + extra, c) for s, c in sizes.items()}
    blocks = nodes.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"))
    blocks = kept(blocks)

    def with_products(moved: DataFrame, first: int, last: int) -> DataFrame:
        """The state (set, block, n, s, a) with the product of columns ``first`` to ``last`` of s, in blocks of width, put in a behind ``first``."""

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = []
                for s, rows_, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                    w = width[s]
                    x.append(np.ascontiguousarray(matrix(data.as_py(), rows_)[:, first * w : last * w]).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(x, pa.binary())], names=["set", "block", "n", "x"])

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, y = None, None, None

            def out() -> Iterator[pa.RecordBatch]:
                if held is None:
                    return
                w = width[at[0]]
                s, a = matrix(held[1], held[0]), matrix(held[2], held[0]) if held[2] else np.zeros((held[0], 0))
                a = np.hstack([a[:, : first * w], np.zeros((held[0], (last - first) * w)) if y is None else y, a[:, first * w :]])
                g = np.concatenate([(s.T @ s).ravel(), (s.T @ a).ravel()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), pa.array([held[0]], pa.int32()), *(pa.array([np.ascontiguousarray(z).tobytes()], pa.binary()) for z in (s, a, g))],
                    names=["set", "block", "n", "s", "a", "g"],
                )

            for b in batches:
                for s, k, rows_, x, a, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *(b.column(c) for c in (3, 4, 5, 6))):
                    if (s, k) != at:
                        yield from out()
                        at, held, y = (s, k), None, None
                    if rows_.as_py() is not None:
                        held = (rows_.as_py(), x.as_py(), a.as_py())
                    else:
                        add = matrix(part.as_py(), held[0])
                        y = add.copy() if y is None else y + add
            yield from out()

        x = moved.select("set", "block", "n", "s").mapInArrow(chosen, "set long, block int, n int, x binary").repartition(parts, *KEY)
        products = tiles.join(x, KEY).select("set", "to", "rows", "tile", "n", "x").mapInArrow(partial_products, "set long, block int, y binary")
        own = moved.select("set", "block", F.lit(0).alias("kind"), "n", "s", "a", F.lit(None).cast("binary").alias("y"))
        rest = products.select("set", "block", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("binary").alias("s"), F.lit(None).cast("binary").alias("a"), "y")
        both = own.unionByName(rest).repartition(parts, *KEY).sortWithinPartitions(*KEY, "kind")
        return kept(both.mapInArrow(together, STATE))

    def grams(state: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Products of the columns of each set."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for s, g in zip(b.column(0).to_pylist(), b.column(1)):
                    x = np.frombuffer(g.as_py(), dtype=np.float64)
                    sums[s] = sums[s] + x if s in sums else x
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["set", "g"])

        sums: dict[int, np.ndarray] = {}
        rows_ = state.select("set", "g")
        for r in (rows_ if n_blocks <= FEW_BLOCKS else rows_.mapInArrow(run, "set long, g binary")).collect():
            x = np.frombuffer(r.g, dtype=np.float64)
            sums[r["set"]] = sums[r["set"]] + x if r["set"] in sums else x
        out = {}
        for s, x in sums.items():
            p = int(round((len(x) / 2) ** 0.5))
            out[s] = x[: p * p].reshape(p, p), x[p * p :].reshape(p, p)
        return out

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                rng = np.random.default_rng([seed, s & 0xFFFFFFFF, k])
                x = rng.standard_normal((len(ids), width[s]))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([k], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=["set", "block", "n", "s", "a"])

    state = with_products(blocks.mapInArrow(start, "set long, block int, n int, s binary, a binary"), 0, 1)
    now: dict[int, np.ndarray] = {}
    aim = tolerance if aim is None else min(aim, tolerance)
    least, best, before, since = np.inf, None, None, 0
    for turn in range(iterations + 1):
        by_set = grams(state)
        values, coefficients, sizes_of = {}, {}, {}
        for s, (gram, h) in by_set.items():
            w = width[s]
            # After the first turn the second block of columns is the residuals of the first.
            if turn:
                sizes_of[s] = np.sqrt(np.maximum(np.diag(gram)[w : 2 * w], 0))
            values[s], coefficients[s] = ritz(gram, h, w)
        if turn:
            left = max((float((sizes_of[s][:n] / np.maximum(np.abs(now[s][:n]), 1e-300)).max()) for s in by_set), default=0.0)
            since = 0 if left <= least / 2 else since + 1
            if left < least:
                if best is not None and best[0] is not before:
                    dropped(best[0])
                least, best = left, (state, now, sizes_of)
            # Rounds that no later one reads are not kept.
            if before is not None and (best is None or before is not best[0]):
                dropped(before)
        if least <= aim or least <= tolerance and (since >= PATIENCE or turn == iterations):
            # At the limit of doubles the residuals may rise again.
            state, now, sizes_of = best
            break
        if turn == iterations:
            raise RuntimeError(f"eigenvectors did not settle in {iterations} rounds")
        first = turn == 0

        def advance(batches: Iterator[pa.RecordBatch], values=values, coefficients=coefficients, first=first) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s_, a_ = [], []
                for s, rows_, x, y in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4)):
                    w, c, val = width[s], coefficients[s], values[s]
                    x, y = matrix(x.as_py(), rows_), matrix(y.as_py(), rows_)
                    tail = c.copy()
                    tail[:w] = 0  # the part without the block itself is the step
                    xs, ys = x @ c, y @ c
                    s_.append(np.hstack([xs, ys - xs * val, *([] if first else [x @ tail])]).tobytes())
                    a_.append(np.hstack([ys, *([] if first else [y @ tail])]).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(s_, pa.binary()), pa.array(a_, pa.binary())], names=["set", "block", "n", "s", "a"])

        now, before = values, state
        moved = state.select("set", "block", "n", "s", "a").mapInArrow(advance, "set long, block int, n int, s binary, a binary")
        state = with_products(moved, 1, 2)
    tiles.unpersist()
    pairs = [(s, k + 1, float(now[s][k]), float(sizes_of[s][k] / abs(now[s][k])) if now[s][k] else 0.0) for s in sorted(now) for k in range(min(n, width[s]))]

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, ids, rows_, data in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3)):
                m = min(n, width[s])
                x = matrix(data.as_py(), rows_)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows_ * m, s)), pa.array(np.repeat(ids.values.to_numpy(), m)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows_)), pa.array(np.ascontiguousarray(x).ravel())], names=["set", "id", "k", "value"])

    vectors = kept(blocks.join(state, KEY).select("set", "ids", "n", "s").mapInArrow(columns, "set long, id long, k int, value double"))
    # Columns with a positive sum, or failing that a positive largest entry.
    sums = vectors.groupBy("set", "k").agg(F.sum("value").alias("t"), F.max_by("value", F.abs("value")).alias("big"))
    sign = sums.select("set", "k", F.when(F.when(F.abs("t") > 1e-9, F.col("t")).otherwise(F.col("big")) < 0, -1.0).otherwise(1.0).alias("sign"))
    return pairs, vectors.join(sign, ["set", "k"]).select("set", "id", "k", (F.col("value") * F.col("sign")).alias("value"))
