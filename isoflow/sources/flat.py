"""Headerless binary vectors, text series, structures, index groups, and their writers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.blocks import kept
from ..operators.trajectory import rekey

PART_BYTES = 64 << 20


class VectorSource(DataSource):
    """``format("flat_vectors")``: rows of ``width`` numbers as (id, v); id counts rows from 0.

    Options: path (one file, any file system Arrow opens), width, dtype (float64, float32 or
    int32; float64 by default). Whole rows are dealt to tasks by their offset in the file;
    a rest that is no whole row raises an error.
    """

    @classmethod
    def name(cls) -> str:
        return "flat_vectors"

    def schema(self) -> str:
        return "id long, v array<double>"

    def reader(self, schema) -> DataSourceReader:
        return VectorReader(self.options["path"], int(self.options["width"]), self.options.get("dtype", "float64"))


class VectorReader(DataSourceReader):
    def __init__(self, path: str, width: int, dtype: str):
        self.path, self.width, self.dtype = path, width, dtype

    def opened(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[InputPartition]:
        fs, path = self.opened()
        row = self.width * np.dtype(self.dtype).itemsize
        n, rest = divmod(fs.get_file_info(path).size, row)
        if rest:
            raise ValueError(f"{self.path} is not made of rows of {self.width} numbers")
        step = max(1, PART_BYTES // row)
        return [InputPartition((a, min(step, n - a))) for a in range(0, n, step)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        start, count = partition.value
        fs, path = self.opened()
        size = np.dtype(self.dtype).itemsize * self.width
        with fs.open_input_file(path) as f:
            for a in range(start, start + count, 8192):
                n = min(8192, start + count - a)
                x = np.frombuffer(f.read_at(n * size, a * size), dtype=self.dtype).astype(np.float64)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.width)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), pa.ListArray.from_arrays(offsets, pa.array(x))], names=["id", "v"])


def read_vectors(spark: SparkSession, path: str, width: int, dtype: str = "float64") -> DataFrame:
    spark.dataSource.register(VectorSource)
    return spark.read.format("flat_vectors").options(path=path, width=str(width), dtype=dtype).load()


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """(id, value) of a text file with a number on each line, numbered from 0 (S8). Read as one text, as lines have no ids."""
    lines = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("id", "x")).select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("value"))


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """(serial, name, resname, resid, x, y, z) of the atoms of a PDB file, in nanometres."""
    line = F.col("value")

    def part(a: int, b: int):
        return F.trim(F.substring(line, a, b - a + 1))

    atoms = spark.read.text(path).where(F.substring(line, 1, 6).isin("ATOM  ", "HETATM"))
    xyz = [(part(a, a + 7).cast("double") / 10).alias(n) for n, a in (("x", 31), ("y", 39), ("z", 47))]
    return atoms.select(part(7, 11).cast("long").alias("serial"), part(13, 16).alias("name"), part(18, 20).alias("resname"), part(23, 26).cast("int").alias("resid"), *xyz)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group, atoms) of an index file with ``[ name ]`` sections; atoms from 0 (S3)."""
    sections = F.filter(F.split("value", r"\["), lambda s: F.contains(s, F.lit("]")))
    s = spark.read.text(path, wholetext=True).select(F.explode(sections).alias("s"))
    ids = F.filter(F.split(F.substring_index("s", "]", -1), r"\s+"), lambda x: x != "")
    return s.select(F.trim(F.substring_index("s", "]", 1)).alias("group"), F.transform(ids, lambda x: x.cast("int") - 1).alias("atoms"))


def group_lines(labels: DataFrame, per_line: int = 20) -> DataFrame:
    """(value): the lines of an index file of (id, cluster), ids from 1, ``per_line`` on a line (K6); write it with ``.write.text``.

    Ids are numbered within their cluster range by range, so a row holds one line.
    """
    at = kept(rekey(labels.select("id", "cluster", F.struct("cluster", "id").alias("order")), "order", "at").select("id", "cluster", "at"))
    first = at.groupBy("cluster").agg(F.min("at").alias("first"))
    line = F.floor((F.col("at") - F.col("first")) / per_line)
    lines = at.join(first, "cluster").groupBy("cluster", line.alias("line")).agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("ids"))
    lines = lines.select("cluster", "line", F.array_join(F.transform("ids", lambda x: (x["id"] + 1).cast("string")), " ").alias("value"))
    head = first.select("cluster", F.lit(-1).cast("long").alias("line"), F.concat(F.lit("[cluster_"), F.col("cluster").cast("string"), F.lit("]")).alias("value"))
    return head.unionByName(lines).orderBy("cluster", "line").select("value")
