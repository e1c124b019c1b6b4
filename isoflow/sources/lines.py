"""Text files whose lines are numbered range by range, and what is read from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of a read.
PART_BYTES, READ_BYTES = 32 << 20, 4 << 20


class RangedLines(DataSource):
    """``format("ranged_lines")``: (part, place, value), the lines of a file by range of bytes and by place in the range, from 0.

    A line belongs to the range its first byte is in; it may end beyond.
    """

    @classmethod
    def name(cls) -> str:
        return "ranged_lines"

    def schema(self) -> str:
        return "part long, place long, value string"

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(self.options["path"])


class LinesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        fs, path = pafs.FileSystem.from_uri(self.path)
        size = fs.get_file_info(path).size
        return [InputPartition((p, a, min(a + PART_BYTES, size))) for p, a in enumerate(range(0, size, PART_BYTES))] or [InputPartition((0, 0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        part, first, end = partition.value
        fs, path = pafs.FileSystem.from_uri(self.path)
        if first == end:
            return
        with fs.open_input_file(path) as f:
            at = first
            if first:  # the rest of the line of the range before
                at = first - 1
                while True:
                    data = f.read_at(READ_BYTES, at)
                    cut = data.find(b"\n")
                    if cut >= 0 or not data:
                        at += cut + 1 if data else 0
                        break
                    at += len(data)
            place, held = 0, b""
            while at - len(held) < end:
                data = f.read_at(READ_BYTES, at)
                at += len(data)
                lines = (held + data).split(b"\n")
                held = lines.pop()
                start = at - len(held) - sum(map(len, lines)) - len(lines)
                if not data:
                    lines, held = ([held] if held else []), b""
                    start = at - len(lines[0]) if lines else at
                starts = start + np.cumsum([0, *(len(x) + 1 for x in lines[:-1])]) if lines else np.zeros(0)
                own = [x.removesuffix(b"\r").decode(errors="replace") for x, s in zip(lines, starts) if s < end]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(own)), pa.array(np.arange(place, place + len(own))), pa.array(own)], names=["part", "place", "value"])
                    place += len(own)
                if not data:
                    break


def before(df: DataFrame, name: str, n=None) -> DataFrame:
    """(part, name): how many rows, or what sum of ``n``, the ranges before each range have; a row for each range."""
    sizes = df.groupBy("part").agg((F.count("*") if n is None else F.sum(n)).alias("n"))
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias(name))


def ranged(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RangedLines)
    uri = path if "://" in path else f"file://{path}"
    return spark.read.format("ranged_lines").options(path=uri).load()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of one file, numbered from 0; counted by range first, then numbered."""
    lines = ranged(spark, path)
    return lines.join(F.broadcast(before(lines, "base")), "part").select((F.col("base") + F.col("place")).alias("line"), "value")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(id, v): the numbers of each line that has any, lines numbered from 0 without the empty ones."""
    v = F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    rows = ranged(spark, path).select("part", "place", v.alias("v")).where(F.size("v") > 0)
    n = F.row_number().over(W.partitionBy("part").orderBy("place")) - 1
    return rows.withColumn("n", n).join(F.broadcast(before(rows, "base")), "part").select((F.col("base") + F.col("n")).alias("id"), "v")


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(id, value): the numbers of a text in their order, however many on a line, numbered from 0."""
    x = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    rows = ranged(spark, path).select("part", "place", x.alias("x"))
    w = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.size("x")).withColumn("own", F.coalesce(F.sum("n").over(w), F.lit(0)))
    rows = rows.join(F.broadcast(before(rows, "base", "n")), "part")
    return rows.select((F.col("base") + F.col("own")).alias("first"), F.posexplode("x").alias("p", "x")).select((F.col("first") + F.col("p")).alias("id"), F.col("x").cast("double").alias("value"))


def group_members(spark: SparkSession, path: str) -> DataFrame:
    """(group, place, atom) of an index file with ``[ name ]`` sections; atoms and places from 0; lines before the first name go (S3).

    A section that goes over ranges takes its name from the last range that has one, and
    sections of one name are one group.
    """
    lines = ranged(spark, path)
    name = F.when(F.contains("value", F.lit("[")) & F.contains("value", F.lit("]")), F.trim(F.regexp_extract("value", r"\[([^\]]*)\]", 1)))
    lines = lines.withColumn("name", name)
    inside = W.partitionBy("part").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("own", F.last("name", True).over(inside))
    last = lines.groupBy("part").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("place"))).alias("end"))
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    last = last.select("part", F.last("end", True).over(w).alias("held"))  # a row for each range
    rows = lines.where("name IS NULL").join(F.broadcast(last), "part").withColumn("group", F.coalesce("own", "held"))
    ids = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    rows = rows.where(F.col("group").isNotNull()).select("group", "part", "place", F.posexplode(ids).alias("p", "x"))
    n = F.row_number().over(W.partitionBy("group", "part").orderBy("place", "p")) - 1
    sizes = rows.groupBy("group", "part").count()
    base = sizes.select("group", "part", F.coalesce(F.sum("count").over(W.partitionBy("group").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.withColumn("n", n).join(base, ["group", "part"]).select("group", (F.col("base") + F.col("n")).alias("place"), (F.col("x").cast("long") - 1).alias("atom"))


#: Masses of elements that structures name (fixed values, atomic mass units).
MASSES = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "NA": 22.990, "MG": 24.305, "P": 30.974, "S": 32.06, "CL": 35.45, "K": 39.098, "CA": 40.078, "FE": 55.845, "ZN": 65.38, "SE": 78.971, "BR": 79.904, "I": 126.904}


def element_mass(name, residue):
    """The mass of an atom by its name: its first letters but for digits; ions, whose residue has the same name, may have two letters."""
    table = F.create_map(*(F.lit(x) for kv in MASSES.items() for x in kv))
    letters = F.upper(F.regexp_replace(name, r"[^A-Za-z]", ""))
    whole = F.when(letters == F.upper(F.regexp_replace(residue, r"[^A-Za-z]", "")), F.try_element_at(table, letters))
    return F.coalesce(whole, F.try_element_at(table, F.substring(letters, 1, 1)))


def read_gro(spark: SparkSession, path: str) -> DataFrame:
    """(frame, serial, name, resname, resid, x, y, z, mass) of the atoms of a fixed-column GRO file of one frame or more, in nanometres.

    Each frame has a title, a count, so many atoms and a box; frames that follow must have as
    many atoms as the first.
    """
    lines = numbered_lines(spark, path)
    n = int(lines.where("line = 1").first().value)  # one line

    def part(a: int, b: int):
        return F.trim(F.substring("value", a, b - a + 1))

    place = F.col("line") % (n + 3)
    atoms = lines.where((place >= 2) & (place < n + 2))
    cols = [part(16, 20).cast("long").alias("serial"), part(11, 15).alias("name"), part(6, 10).alias("resname"), part(1, 5).cast("int").alias("resid")]
    xyz = [part(a, a + 7).cast("double").alias(c) for c, a in (("x", 21), ("y", 29), ("z", 37))]
    return atoms.select(F.floor(F.col("line") / (n + 3)).alias("frame"), *cols, *xyz).withColumn("mass", element_mass(F.col("name"), F.col("resname")))
