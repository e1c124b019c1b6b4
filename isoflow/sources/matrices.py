"""Binary sparse vectors, column matrices and packed triangles, read in ranges and written at places.

All numbers are little-endian: 32-bit integers for ids and counts, 64-bit floats for values.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.blocks import kept
from ..operators.trajectory import rekey

#: Bytes that one task reads, about; entries in a batch; columns whose bounds are read together.
PART_BYTES, BATCH, STRIDE = 64 << 20, 1_000_000, 65_536


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def numbers(f, dtype: str, at: int, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    data = f.read_at(n * size, at)
    if len(data) != n * size:
        raise ValueError("the file ends within a record")
    return np.frombuffer(data, dtype=dtype)


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


class SparseRowsSource(DataSource):
    """``format("sparse_rows")``: (id, idx, val) from a pair of files.

    ``index`` has for each row a count and so many ids, ``data`` the values alone; rows are
    numbered from 0. The counts are a chain, so the driver walks it once, a buffer at a time,
    and notes a place for every PART_BYTES; tasks read from there.
    """

    @classmethod
    def name(cls) -> str:
        return "sparse_rows"

    def schema(self) -> str:
        return "id long, idx array<int>, val array<double>"

    def reader(self, schema) -> DataSourceReader:
        return SparseRowsReader(self.options["index"], self.options["data"])


class SparseRowsReader(DataSourceReader):
    def __init__(self, index: str, data: str):
        self.index, self.data = index, data

    def partitions(self) -> list[InputPartition]:
        fs, path = opened(self.index)
        size = fs.get_file_info(path).size // 4
        out, at, row, entries = [], 0, 0, 0
        first = (0, 0, 0)
        with fs.open_input_file(path) as f:
            low, buffer = 0, np.zeros(0, dtype=np.int32)
            while at < size:
                if at >= low + len(buffer):
                    low, buffer = at, numbers(f, "<i4", 4 * at, min(4 << 20, size - at))
                n = int(buffer[at - low])
                if n < 0 or at + 1 + n > size:
                    raise ValueError(f"{self.index} is no chain of counts and ids")
                at, row, entries = at + 1 + n, row + 1, entries + n
                if 12 * (entries - first[2]) >= PART_BYTES:
                    out.append(InputPartition((*first, at)))
                    first = (at, row, entries)
        return [*out, InputPartition((*first, at))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        at, row, entry, end = partition.value
        fs, path = opened(self.index)
        other, data = opened(self.data)
        with fs.open_input_file(path) as f, other.open_input_file(data) as g:
            while at < end:
                chunk = numbers(f, "<i4", 4 * at, min(BATCH, end - at))
                sizes, starts, x = [], [], 0
                while x < len(chunk) and x + 1 + int(chunk[x]) <= len(chunk):
                    sizes.append(int(chunk[x]))
                    starts.append(x + 1)
                    x += 1 + sizes[-1]
                if not sizes:  # one row larger than a batch
                    n = int(chunk[0])
                    chunk, sizes, starts, x = numbers(f, "<i4", 4 * at, 1 + n), [n], [1], 1 + n
                keep = np.ones(x, dtype=bool)
                keep[np.array(starts) - 1] = False
                ends = np.append(0, np.cumsum(sizes))
                idx, val = chunk[:x][keep], numbers(g, "<f8", 8 * entry, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(sizes))), lists(ends, idx), lists(ends, val)], names=["id", "idx", "val"])
                at, row, entry = at + x, row + len(sizes), entry + int(ends[-1])


class ColumnMatrixSource(DataSource):
    """``format("column_matrix")``: (col, row, w) of a matrix in compressed columns.

    The file ``path`` has the number of columns n, n + 1 column bounds, the rows and the
    values. Every STRIDE-th bound is looked up to deal ranges of columns out.
    """

    @classmethod
    def name(cls) -> str:
        return "column_matrix"

    def schema(self) -> str:
        return "col long, row long, w double"

    def reader(self, schema) -> DataSourceReader:
        return ColumnMatrixReader(self.options["path"])


class ColumnMatrixReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        fs, path = opened(self.path)
        with fs.open_input_file(path) as f:
            n = int(numbers(f, "<i4", 0, 1)[0])
            total = int(numbers(f, "<i4", 4 + 4 * n, 1)[0])
            if fs.get_file_info(path).size != 4 + 4 * (n + 1) + 12 * total:
                raise ValueError(f"{self.path} is not a matrix of {n} columns and {total} entries")
            out, first, since = [], 0, 0
            for c in range(STRIDE, n, STRIDE):
                bound = int(numbers(f, "<i4", 4 + 4 * c, 1)[0])
                if 12 * (bound - since) >= PART_BYTES:
                    out.append(InputPartition((n, total, first, c)))
                    first, since = c, bound
        return [*out, InputPartition((n, total, first, n))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        n, total, first, last = partition.value
        rows_at = 4 + 4 * (n + 1)
        fs, path = opened(self.path)
        with fs.open_input_file(path) as f:
            for c in range(first, last, STRIDE):
                bounds = numbers(f, "<i4", 4 + 4 * c, min(STRIDE, last - c) + 1).astype(np.int64)
                for a in range(int(bounds[0]), int(bounds[-1]), BATCH):
                    b = min(a + BATCH, int(bounds[-1]))
                    col = c + np.searchsorted(bounds, np.arange(a, b), "right") - 1
                    row = numbers(f, "<i4", rows_at + 4 * a, b - a).astype(np.int64)
                    w = numbers(f, "<f8", rows_at + 4 * total + 8 * a, b - a)
                    yield pa.RecordBatch.from_arrays([pa.array(col), pa.array(row), pa.array(w)], names=["col", "row", "w"])


class TriangleSource(DataSource):
    """``format("packed_triangle")``: (i, j, d), i <= j, from a file of rows from the diagonal on (S9); the largest double is null."""

    @classmethod
    def name(cls) -> str:
        return "packed_triangle"

    def schema(self) -> str:
        return "i long, j long, d double"

    def reader(self, schema) -> DataSourceReader:
        return TriangleReader(self.options["path"])


def triangle_rows(at: np.ndarray, n: int) -> np.ndarray:
    """The row of each place of a packed triangle."""
    i = np.floor((2 * n + 1 - np.sqrt(np.maximum((2.0 * n + 1) ** 2 - 8.0 * at, 0))) / 2).astype(np.int64)
    # The root may be off by one.
    i = np.where(i * n - i * (i - 1) // 2 > at, i - 1, i)
    return np.where((i + 1) * n - (i + 1) * i // 2 <= at, i + 1, i)


class TriangleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        fs, path = opened(self.path)
        size, rest = divmod(fs.get_file_info(path).size, 8)
        n = int((np.sqrt(8.0 * size + 1) - 1) / 2 + 0.5)
        if rest or n * (n + 1) // 2 != size:
            raise ValueError(f"{self.path} is not a packed triangle")
        step = PART_BYTES // 8
        return [InputPartition((n, a, min(a + step, size))) for a in range(0, size, step)] or [InputPartition((0, 0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        n, first, last = partition.value
        fs, path = opened(self.path)
        with fs.open_input_file(path) as f:
            for a in range(first, last, BATCH):
                at = np.arange(a, min(a + BATCH, last))
                d = numbers(f, "<f8", 8 * a, len(at))
                i = triangle_rows(at, n)
                j = at - (i * n - i * (i - 1) // 2) + i
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(d, mask=~(d < np.finfo(np.float64).max))], names=["i", "j", "d"])


def read_sparse_rows(spark: SparkSession, index: str, data: str) -> DataFrame:
    """(id, idx, val) of a pair of files, as ``knn_sparse`` takes it."""
    spark.dataSource.register(SparseRowsSource)
    return spark.read.format("sparse_rows").options(index=index, data=data).load()


def read_column_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(col, row, w) (S6); ``symmetric_edges`` and ``outside_edges`` turn it into graphs."""
    spark.dataSource.register(ColumnMatrixSource)
    return spark.read.format("column_matrix").options(path=path).load()


def symmetric_edges(matrix: DataFrame) -> DataFrame:
    """(i, j, d), i < j, of a matrix that holds one triangle."""
    return matrix.where("col <> row").select(F.least("col", "row").alias("i"), F.greatest("col", "row").alias("j"), F.col("w").alias("d"))


def outside_edges(matrix: DataFrame) -> DataFrame:
    """(query, ref, w) of a matrix whose columns are the queries."""
    return matrix.select(F.col("col").alias("query"), F.col("row").alias("ref"), "w")


def read_triangle(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, d) as ``classical_scaling`` takes it."""
    spark.dataSource.register(TriangleSource)
    return spark.read.format("packed_triangle").options(path=path).load()


@dataclass
class Written(WriterCommitMessage):
    rows: int


class PlacedValues(DataSource):
    """``format("placed_values")``, for writing: rows (at long, v array) to a file at byte ``base`` + ``at`` times the bytes of a row.

    Options: path (``file://``, on a disk that all tasks share), dtype, base, width and rows,
    the number of rows to expect. Tasks write their rows where they belong, so the file needs
    no order of tasks, and a task that runs twice writes the same bytes. The commit checks that
    all rows are there.
    """

    @classmethod
    def name(cls) -> str:
        return "placed_values"

    def schema(self) -> str:
        return "at long, v array<double>"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        return PlacedWriter(o["path"], o["dtype"], int(o["base"]), int(o["width"]), int(o["rows"]))


def local_path(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: single files are written at places, which needs a shared disk (file://)")
    return unquote(parts.path)


class PlacedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dtype: str, base: int, width: int, rows: int):
        self.path, self.dtype, self.base, self.width, self.rows = path, dtype, base, width, rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        rows, size = 0, np.dtype(self.dtype).itemsize * self.width
        with open(local_path(self.path), "r+b") as f:
            for b in iterator:
                if not b.num_rows:
                    continue
                at, v = b.column(0).to_numpy(), b.column(1)
                if (np.diff(v.offsets.to_numpy()) != self.width).any() or v.null_count:
                    raise ValueError(f"a row has not {self.width} numbers")
                data = v.flatten().to_numpy(zero_copy_only=False).astype(self.dtype).reshape(b.num_rows, -1)
                # Rows next to each other go out together.
                cuts = np.append(np.flatnonzero(np.append(True, np.diff(at) != 1)), b.num_rows)
                for x, y in zip(cuts[:-1], cuts[1:]):
                    f.seek(self.base + int(at[x]) * size)
                    f.write(data[x:y].tobytes())
                rows += b.num_rows
        return Written(rows)

    def commit(self, messages: list[Written | None]) -> None:
        found = sum(m.rows for m in messages if m is not None)
        if found != self.rows:
            raise RuntimeError(f"{found} of {self.rows} rows written")

    def abort(self, messages: list[Written | None]) -> None:
        """The file has no name of its own yet; ``written_whole`` removes it."""


class WholeFile:
    """A file that gets its name once all of it is written, and is removed if that fails."""

    def __init__(self, spark: SparkSession, path: str, size: int):
        spark.dataSource.register(PlacedValues)
        self.to = local_path(path)
        self.path = f"{self.to}.{uuid.uuid4().hex}.part"
        with open(self.path, "wb") as f:
            f.truncate(size)

    def __enter__(self) -> WholeFile:
        return self

    def put(self, rows: DataFrame, dtype: str, base: int, width: int, count: int) -> None:
        rows.select(F.col("at").cast("long").alias("at"), F.col("v").cast("array<double>").alias("v")).write.format("placed_values").options(
            path=f"file://{self.path}", dtype=dtype, base=str(base), width=str(width), rows=str(count)
        ).mode("append").save()

    def head(self, data: bytes) -> None:
        with open(self.path, "r+b") as f:
            f.write(data)

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            os.replace(self.path, self.to)
        else:
            os.unlink(self.path)


def write_vectors(vectors: DataFrame, path: str, width: int, dtype: str = "<f8", key: str = "id") -> None:
    """Rows (key, v) in the order of the key as a headerless file of ``width`` numbers a row; "<f4" for flat trajectories (K1, K3, K7)."""
    rows = kept(rekey(vectors.select(key, "v"), key, "at"))
    n = rows.count()
    with WholeFile(vectors.sparkSession, path, n * width * np.dtype(dtype).itemsize) as f:
        f.put(rows, dtype, 0, width, n)


def write_column_matrix(entries: DataFrame, path: str, columns: int) -> None:
    """``entries(col, row, w)`` as a matrix in compressed columns, columns 0 .. ``columns`` - 1 (K2).

    Entries are numbered in the order of column and row, and column bounds are running sums
    of counts, both range by range; every task writes its own part of the file.
    """
    spark = entries.sparkSession
    order = F.struct("col", "row")
    rows = kept(rekey(entries.select("col", "row", "w", order.alias("order")), "order", "at"))
    total = rows.count()
    if rows.where((F.col("col") < 0) | (F.col("col") >= columns) | (F.col("row") < 0) | F.col("col").isNull() | F.col("row").isNull() | F.col("w").isNull()).limit(1).count():
        raise ValueError(f"columns go from 0 to {columns - 1}, rows from 0, and no value is null")
    # The bound of a column is the number of entries before it: where its first entry is, or that of the next column that has one.
    first = rows.groupBy("col").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    after = first.select(F.col("col"), (F.col("at") + F.col("n")).alias("end"))
    steps = after.withColumn("part", F.floor(F.col("col") / STRIDE))
    # The bounds of a stretch of columns begin with the last one before it.
    last = steps.groupBy("part").agg(F.max("end").alias("end")).orderBy("part").collect()  # one for STRIDE columns
    before, held = [], 0
    ends = {r.part: r.end for r in last}
    for p in range(columns // STRIDE + 1):
        before.append((p, held))
        held = max(held, ends.get(p, 0))
    base = spark.createDataFrame(before, "part long, base long")
    every = spark.range(columns + 1).select(F.col("id").alias("c"), F.floor(F.col("id") / STRIDE).alias("part"))
    from pyspark.sql import Window as W

    w = W.partitionBy("part").orderBy("c").rowsBetween(W.unboundedPreceding, -1)
    bounds = every.join(steps.select(F.col("col").alias("c"), "end"), "c", "left").withColumn("run", F.max("end").over(w)).join(base, "part")
    bounds = bounds.select(F.col("c").alias("at"), F.array(F.coalesce("run", "base")).alias("v"))
    rows_at = 4 + 4 * (columns + 1)
    with WholeFile(spark, path, rows_at + 12 * total) as f:
        f.head(np.int32(columns).tobytes())
        f.put(bounds, "<i4", 4, 1, columns + 1)
        f.put(rows.select("at", F.array(F.col("row").cast("double")).alias("v")), "<i4", rows_at, 1, total)
        f.put(rows.select("at", F.array("w").alias("v")), "<f8", rows_at + 4 * total, 1, total)


def write_triangle(d: DataFrame, path: str, n: int) -> None:
    """All pairs (i, j, d), i <= j < n, as a packed triangle; a null distance is the largest double."""
    at = F.col("i") * n - F.floor(F.col("i") * (F.col("i") - 1) / 2) + F.col("j") - F.col("i")
    rows = d.select(at.alias("at"), F.array(F.coalesce("d", F.lit(float(np.finfo(np.float64).max)))).alias("v"))
    with WholeFile(d.sparkSession, path, 4 * n * (n + 1)) as f:
        f.put(rows, "<f8", 0, 1, n * (n + 1) // 2)


def write_sparse_rows(rows: DataFrame, index: str, data: str) -> None:
    """(id, idx, val) in the order of id as a pair of files (S5); a row's places are its number and the entries before it."""
    spark = rows.sparkSession
    own = kept(rekey(rows.select("id", "idx", "val"), "id", "at"))
    n = own.count()
    # Entries before each row: sums of stretches of rows, then a running sum within one.
    sized = own.withColumn("part", F.floor(F.col("at") / STRIDE)).withColumn("n", F.size("idx"))
    sums = {r.part: r.n for r in sized.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(sums, default=0) + 1):
        before.append((p, total))
        total += sums.get(p, 0)
    from pyspark.sql import Window as W

    w = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.join(spark.createDataFrame(before, "part long, base long"), "part").withColumn("entry", F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    ids = placed.select((F.col("at") + F.col("entry")).alias("start"), F.concat(F.array(F.col("n")), "idx").alias("x"))
    ids = ids.select("start", F.posexplode("x").alias("p", "x")).select((F.col("start") + F.col("p")).alias("at"), F.array(F.col("x").cast("double")).alias("v"))
    values = placed.select("entry", F.posexplode("val").alias("p", "x")).select((F.col("entry") + F.col("p")).alias("at"), F.array("x").alias("v"))
    with WholeFile(spark, index, 4 * (n + total)) as f, WholeFile(spark, data, 8 * total) as g:
        f.put(ids, "<i4", 0, 1, n + total)
        g.put(values, "<f8", 0, 1, total)
