"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides keep, of every window of SPAN - K + 1 consecutive K-grams, those with the least
hash (all of them on ties). Two texts that share SPAN consecutive words share such a window
and so a fingerprint at the same place in it, whatever stands around. Fingerprints that
meet are extended word by word, which also settles hash collisions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K, SPAN = 5, 10
WINDOW = SPAN - K + 1
#: Benchmark fingerprints up to this number, each with at most SPAN + K words around it, are broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_CHARS = 24_000_000


def words_of(text: Column) -> Column:
    from .common import lower_ascii

    return F.coalesce(F.array_remove(F.split(lower_ascii(text), SPLIT), ""), F.array().cast("array<string>"))


def let(x: Column, f) -> Column:
    """``f`` of the value of ``x``, which is computed once however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def winnowed(words: Column) -> Column:
    """Array of (pos, len, hash), pos from 0, for the selected K-grams of ``words``."""

    def grams(w: Column) -> Column:
        each = F.transform(w, lambda x: F.xxhash64(x))
        return let(each, lambda e: F.transform(F.slice(e, 1, F.size(e) - (K - 1)), lambda x, i: F.xxhash64(x, *(F.get(e, i + o) for o in range(1, K)))))

    # Extremes of WINDOW values from those of two; places outside an array are null and do not count.
    def least(h: Column) -> Column:
        two = F.transform(h, lambda x, i: F.least(x, F.get(h, i + 1)))
        return let(two, lambda t: F.transform(F.slice(t, 1, F.size(t) - (WINDOW - 1)), lambda x, i: F.least(x, *(F.get(t, i + o) for o in range(2, WINDOW, 2)))))

    def chosen(h: Column, m: Column) -> Column:
        two = F.transform(h, lambda _, p: F.greatest(F.get(m, p), F.get(m, p - 1)))

        def keep(t: Column):
            def one(x: Column, p: Column) -> Column:
                most = F.greatest(F.get(t, p), *(F.get(t, p - o) for o in range(2, WINDOW, 2)))
                return F.when(x == most, F.struct(p.alias("pos"), F.lit(K).alias("len"), x.alias("hash")))

            return one

        return let(two, lambda t: F.array_compact(F.transform(h, keep(t))))

    found = let(words, lambda w: F.when(F.size(w) >= SPAN, let(grams(w), lambda h: let(least(h), lambda m: chosen(h, m)))))
    return F.coalesce(found, F.array().cast("array<struct<pos:int,len:int,hash:bigint>>"))


def maybe_known(hashes: list[int]) -> Callable[[Column], Column]:
    """A Bloom test that is true of every one of ``hashes`` and of few other values."""
    bits = min(1 << 18, 1 << max(12, (32 * len(hashes)).bit_length()))
    at = np.array(hashes, dtype=np.int64) & (bits - 1)
    filled = np.zeros(bits // 64, dtype=np.int64)
    np.bitwise_or.at(filled, at >> 6, np.left_shift(np.int64(1), at & 63))
    table = F.lit(filled)
    return lambda h: F.getbit(F.get(table, F.shiftright(h.bitwiseAND(bits - 1), 6).cast("int")), h.bitwiseAND(63).cast("int")) == 1


def whole_items(words: str, lengths: list[int]) -> Column:
    """Array of (pos, len, hash) of every run of one of ``lengths`` words."""

    def runs(n: int) -> Column:
        def run(i: Column) -> Column:
            return F.struct((i - 1).alias("pos"), F.lit(n).alias("len"), F.xxhash64(F.lit(n), F.slice(F.col(words), i, n)).alias("hash"))

        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), run))

    parts = [runs(n) for n in lengths]
    return F.flatten(F.array_compact(F.array(*parts))) if parts else F.array().cast("array<struct<pos:int,len:int,hash:bigint>>")


def around(words: str, pos: Column) -> tuple[Column, Column]:
    """Words from SPAN - K before ``pos`` to SPAN - K after its K-gram, and how many stand before."""
    before = F.least(F.lit(SPAN - K), pos)
    return F.slice(F.col(words), pos - before + 1, before + SPAN), before


def benchmark_prints(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[int]]:
    """Fingerprints of the items, and the lengths of items shorter than SPAN words."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("iw")).where(F.size("iw") > 0)
    short = sorted(r.n for r in items.where(F.size("iw") < SPAN).select(F.size("iw").alias("n")).distinct().collect())  # SPAN - 1 numbers at most
    long = items.where(F.size("iw") >= SPAN).select("item", "iw", F.explode(winnowed(F.col("iw"))).alias("s")).select("item", "iw", "s.*")
    ctx, before = around("iw", F.col("pos"))
    prints = long.select("item", "len", "hash", ctx.alias("ictx"), before.alias("ibefore"))
    if short:
        n = F.size("iw")
        # The item as a whole; len takes the place of K.
        whole = items.where(n < SPAN).select("item", n.alias("len"), F.xxhash64(n, F.slice("iw", 1, n)).alias("hash"), F.col("iw").alias("ictx"), F.lit(0).alias("ibefore"))
        prints = prints.unionByName(whole)
    return prints, short


def same(o: Column | int) -> Column:
    """Whether document and item have the same word ``o`` places from the start of the fingerprint."""
    return F.coalesce(F.get("dctx", F.col("dbefore") + o) == F.get("ictx", F.col("ibefore") + o), F.lit(False))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, n_words, n_hit, items, contaminated) for every row of ``docs``; row holds its columns id and text hash.

    An item's windows are its runs of SPAN words, or the whole item if it has fewer; a
    document word inside an occurrence of a window is hit; ``items`` are the ids of the
    items with occurring windows, sorted as strings. Null and empty texts have no words
    and no hits; items without words match nothing; items with a null id hit words but are
    not listed. Repeated items count once by id. Repeated rows are all returned.
    """
    prints, short = benchmark_prints(benchmark, item_id, item_text)
    prints = prints.select(F.col("len").alias("ilen"), F.col("hash").alias("ihash"), "item", "ictx", "ibefore")
    size = prints.agg(F.count("*"), F.sum(F.octet_length(F.array_join("ictx", " ")))).first()
    small = size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_CHARS
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words_of(F.col(text_col)).alias("w"))
    sel = F.concat(winnowed(F.col("w")), whole_items("w", short)) if short else winnowed(F.col("w"))
    if small:
        # BROADCAST_ROWS hashes at most.
        known = maybe_known([r.ihash for r in prints.select("ihash").distinct().collect()])
        sel = F.filter(sel, lambda s: known(s["hash"]))

    def in_place(s: Column) -> Column:
        ctx, before = around("w", s["pos"])
        return F.struct(s["pos"].alias("pos"), s["len"].alias("len"), s["hash"].alias("hash"), ctx.alias("dctx"), before.alias("dbefore"))

    # A mark for the row itself goes first; its hash is null and meets nothing.
    mark = F.array(F.expr("named_struct('pos', -1, 'len', cast(null as int), 'hash', cast(null as bigint), 'dctx', cast(array() as array<string>), 'dbefore', 0)"))
    d = d.select("id", "text_hash", F.size("w").cast("long").alias("n"), F.concat(mark, F.transform(sel, in_place)).alias("sel"))
    # Never empty; a plain explode would have a filter pushed down that computes all fingerprints once more.
    d = d.select("id", "text_hash", "n", F.explode_outer("sel").alias("s")).select("id", "text_hash", "n", "s.*")
    on = (F.col("hash") == F.col("ihash")) & (F.col("len") == F.col("ilen"))
    if small:
        d = d.join(F.broadcast(prints), on, "left").where("pos < 0 OR ihash IS NOT NULL")
    else:
        # Fingerprints once; a mark gets a hash of its own that meets nothing, so that marks spread. Hot ones are split as the join runs.
        own = (F.coalesce("hash", F.xxhash64("id", "text_hash")) == F.col("ihash")) & (F.coalesce("len", F.lit(-1)) == F.col("ilen"))
        d = d.join(prints, own, "left").where("pos < 0 OR ihash IS NOT NULL")
    core = F.forall(F.sequence(F.lit(0), F.col("len") - 1), same)
    left = F.aggregate(F.sequence(F.lit(1), F.lit(SPAN - K)), F.lit(0), lambda a, o: F.when((a == o - 1) & same(-o), o).otherwise(a))
    right = F.aggregate(F.sequence(F.lit(1), F.lit(SPAN - K)), F.lit(0), lambda a, o: F.when((a == o - 1) & same(F.col("len") - 1 + o), o).otherwise(a))
    found = F.when(
        (F.col("pos") >= 0) & core,
        F.when((F.col("len") == K) & (F.size("ictx") > F.col("len")), F.when(left + K + right >= SPAN, F.struct((F.col("pos") - left).alias("a"), (F.col("pos") + K + right).alias("b")))).otherwise(
            F.when(F.size("ictx") == F.col("len"), F.struct(F.col("pos").alias("a"), (F.col("pos") + F.col("len")).alias("b")))
        ),
    )
    d = d.select("id", "text_hash", "n", "pos", "item", found.alias("run"))
    g = d.groupBy("id", "text_hash").agg(
        F.max("n").alias("n_words"),
        F.sum((F.col("pos") < 0).cast("long")).alias("copies"),
        F.sort_array(F.collect_set("run")).alias("runs"),
        F.array_sort(F.collect_set(F.when(F.col("run").isNotNull(), F.col("item")))).alias("items"),
    )
    n_hit = F.aggregate(
        "runs",
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda s, r: F.struct(F.greatest(s["to"], r["b"]).alias("to"), (s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(s["to"], r["a"]))).cast("long").alias("n")),
        lambda s: s["n"],
    )
    g = g.select(F.struct("id", "text_hash").alias("row"), "n_words", n_hit.alias("n_hit"), "items", "copies")
    return g.select("row", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_")).drop("_")


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns, whatever their names.

    Rows with null ids, null or empty texts and repeated rows are kept unless they have one.
    """
    bad = contamination(docs, benchmark, id_col, text_col).where("contaminated").select("row.id", "row.text_hash").distinct()
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_hash"))
    return own.join(bad, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")), "left_anti").select("row.*")
