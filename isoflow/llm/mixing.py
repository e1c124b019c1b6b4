"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, cut

#: Hex digits of the seeded hash that name a slot; a source's words are added up by slot first.
SLOT_DIGITS = 3
#: Tables of up to so many sources are broadcast.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float = 3.0, total: float | None = None) -> DataFrame:
    """Adds ``target`` to ``sources(source, weight, source_size)``.

    The total (all sizes unless given) is shared by weight; a share above max_epochs times
    its source's size stops there and the excess goes to the others by weight, until no
    share is above. Sources fill up in the order of cap / weight, so a running sum over
    that order finds the level without iterating. One row per source, so one task holds it.
    """
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    place = F.row_number().over(W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()))
    whole = W.partitionBy()
    s = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.select(
        "*",
        place.alias("place"),
        F.coalesce(F.sum("cap").over(order), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(order), F.lit(0)).alias("weight_before"),
        F.sum("weight").over(whole).alias("weight_all"),
        (F.lit(float(total)) if total is not None else F.sum("source_size").over(whole).cast("double")).alias("share_all"),
    )
    s = s.withColumn("level", (F.col("share_all") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before")))
    # The first source that does not fill up sets the level of all after it.
    first = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("place", "level"))).over(whole)
    s = s.withColumn("level", first["level"])
    fill = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return s.select(*sources.columns, fill.alias("target"))


def cycled_weights(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .., cycle, repeating over the sources by code point, null last."""
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    return sizes.withColumn("weight", ((n - 1) % cycle + 1).cast("long"))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """row (all columns), id, source, size and a seeded order key that differs between unlike rows."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    size = n_words(F.col(text_col))
    key = F.concat_ws(":", F.md5(F.concat(F.lit(f"{seed}:"), ident).cast("binary")), ident, size.cast("string"))
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), key.alias("key"))


def _plan(narrow: DataFrame, weights: DataFrame | None, max_epochs: float) -> DataFrame:
    """One row for each source: its size, target, whole repetitions, and the document in which the rest ends."""
    slot = F.substring("key", 1, SLOT_DIGITS)
    slots = cut(narrow.groupBy("source", slot.alias("slot")).agg(F.sum("size").alias("slot_size")))
    sizes = slots.groupBy("source").agg(F.sum("slot_size").alias("source_size"))
    if weights is None:
        weighted = cycled_weights(sizes)
    else:
        w = weights.select(F.col("source").cast("string").alias("s"), "weight")
        weighted = sizes.join(w, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", F.coalesce("weight", F.lit(1)).alias("weight"))
    fills = water_fill(weighted, max_epochs).select(F.col("source").alias("s"), "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    fills = fills.withColumn("whole", whole).withColumn("rest", F.floor("target").cast("long") - F.col("whole") * F.col("source_size"))
    fills = cut(fills)
    # Words of a source in the slots before: 16 ** SLOT_DIGITS rows for each source at most.
    before = F.sum("slot_size").over(W.partitionBy("source").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    edge = slots.select("source", "slot", "slot_size", F.coalesce(before, F.lit(0)).alias("slot_before"))
    edge = edge.join(fills, F.col("source").eqNullSafe(F.col("s"))).where("slot_before <= rest AND slot_before + slot_size > rest")
    edge = edge.select("s", F.col("slot").alias("l"), "slot_before", "rest")
    # Only the documents of that slot are put in order.
    near = narrow.join(edge, F.col("source").eqNullSafe(F.col("s")) & (slot == F.col("l")))
    near = near.groupBy("s", "key", "slot_before", "rest").agg(F.sum("size").alias("same_size"), F.count("*").alias("same"))
    run = F.sum("same_size").over(W.partitionBy("s").orderBy("key").rowsBetween(W.unboundedPreceding, -1))
    near = near.withColumn("before", F.col("slot_before") + F.coalesce(run, F.lit(0))).where("before <= rest AND before + same_size > rest")
    last = near.select(F.col("s").alias("edge_source"), F.col("key").alias("edge_key"), F.floor((F.col("rest") - F.col("before")) / F.col("same")).cast("long").alias("edge_part"))
    plan = cut(fills.join(last, F.col("s").eqNullSafe(F.col("edge_source")), "left").drop("edge_source"))
    # One row for each source; with very many sources no single one needs a broadcast.
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    extra = F.when(F.col("key") < F.col("edge_key"), F.col("size")).when(F.col("key") == F.col("edge_key"), F.col("edge_part")).otherwise(0)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("extra", extra).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, size, source_size, target, taken) for every row of ``docs``.

    ``weights(source, weight)`` gives positive weights; sources without one weigh 1; with
    None the weights cycle through 1, 2, 3. Every document of a source is taken whole
    floor(target / source_size) times; what the target still lacks comes from documents in
    the order of md5(seed:id), each whole, the one that reaches the target only as far as
    needed. So a source's taken words are its target rounded down, no document is taken
    more than ``max_epochs`` times, and reruns agree. A null source is a source of its own,
    null texts have size 0, a source of size 0 has target 0. Repeated rows count each, and
    share evenly if the target is reached in them. An empty table gives an empty result.
    """
    narrow = cut(_rows(docs, id_col, text_col, source_col, seed).drop("row"))
    return _taken(narrow, _plan(narrow, weights, max_epochs)).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_copies(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = 3.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the columns of ``docs``, whatever their names, a row for every repetition taken.

    A part of a repetition is its first words, joined by spaces. Nulls, repeated rows and
    empty tables are as in ``mix``; texts without words come once for each whole repetition.
    """
    rows = _rows(docs, id_col, text_col, source_col, seed)
    plan = _plan(cut(rows.drop("row")), weights, max_epochs)
    full = F.col("whole") + (F.col("extra") == F.col("size")).cast("long")
    # Texts without words come along once for each whole repetition.
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    n = F.when(F.col("size") > 0, full).otherwise(F.col("whole"))
    copies = F.concat(F.array_repeat(F.lit(False), n.cast("int")), F.when(part, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    out = _taken(rows, plan).select("row", "extra", F.explode(copies).alias("cut"))
    row = F.col("row")
    words = F.expr(f"array_join(slice(regexp_extract_all(row.`{text_col}`, '{WORD.replace(chr(92), chr(92) * 2)}', 0), 1, cast(extra AS int)), ' ')")
    cols = []
    for c in docs.columns:
        x = row[c]
        if c == text_col:
            x = F.when(F.col("cut"), words).otherwise(x)
        elif c == "n_chars":
            x = F.when(F.col("cut"), F.length(words).cast(docs.schema[c].dataType)).otherwise(x)
        cols.append(x.alias(c))
    return out.select(*cols)
