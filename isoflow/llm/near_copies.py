"""Near copies by exact shingle similarity: SimHash links first, a prefix filter for the rest.

SimHash at a few bits links most copies cheaply, but pairs at a Jaccard similarity of 0.8
differ in up to 14 of 64 bits, and a pigeonhole over so many compares a large part of all
pairs. So each text's shingles are put in one order, rare ones first: two sets of
similarity t share one of the first n - ceil(t n) + 1 shingles of each. The pairs that
share one and are not linked yet are candidates too. Candidates of short lists whose parity
bitmaps show that they are too far apart go, and the rest are compared on the texts, pair by
pair. The texts of a longer list, as a large group of copies has, are
thinned out by the bitmaps too and compared where they meet, by their sets of 64-bit shingle hashes, and give a forest of links
there; so no list is written as all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .cells import CELL, deal_cells, whole_groups
from .common import cut, released
from .components import connected_components, local_roots
from .simhash import majority, shingle_hashes, simhash_links

#: About so many rows show which shingles are common, and so many common ones are kept. They order shingles and never decide what is linked.
SAMPLE_ROWS, COMMON = 10_000, 200_000
#: So many hashes of texts to compare are broadcast; beyond that the texts are shuffled to them.
BROADCAST_ROWS = 500_000
#: Texts of a shingle that are written as pairs; rows of a longer list that one task compares at once.
LIST_ROWS, CELL_ROWS = 32, 512
#: Sets of shingles that a task remembers to have written; forgotten ones are written again and dropped later.
WRITTEN = 200_000


def text_hash(text_col: str):
    return F.coalesce(F.md5(F.col(text_col).cast("string").cast("binary")), F.lit(""))


def as_bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def common_shingles(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of two or more sampled texts, ascending, and their counts."""
    part = max(1, docs.count() // SAMPLE_ROWS)
    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(part)) == 0).select(F.col(text_col).cast("string").alias("t")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(shingle_hashes(t.as_py(), words)) for t in as_bytes(b.column(0))]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["s"])

    rows = some.mapInArrow(released(run), "s long").groupBy("s").count().where("count > 1").orderBy(F.desc("count"), "s").limit(COMMON).collect()
    s = np.array([r.s for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], np.array([r["count"] for r in rows], dtype=np.int64)[order]


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def parity_bitmap(own: np.ndarray) -> bytes:
    """Bit i says whether an odd number of the distinct hashes is i modulo its length, a power of two from 64 on that is n to 2n."""
    m = max(64, 1 << (len(own) - 1).bit_length()) if len(own) else 64
    odd = np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the number of hashes that only one of two sets has, from their bitmaps: each such hash turns one bit."""
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    short = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(z.reshape(-1, short), axis=0) for z in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def features(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(id, h, key, fp, n, parity, prefix) for every row: hashes of the text and of its set of shingles, SimHash, size of the set, its bitmap and its rarest shingles.

    The shingles are null where the task has written those of the set before.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = sent.value
        written: set[int] = set()
        for b in batches:
            if len(written) > WRITTEN:
                written.clear()
            keys, fps, sizes, parities, prefixes = [], [], [], [], []
            for t in as_bytes(b.column(2)):
                hashes = shingle_hashes(t.as_py(), words)
                own = np.unique(hashes)
                seen = np.zeros(len(own), dtype=np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    seen = np.where(common[at] == own, counts[at], 0)
                keys.append(xxhash.xxh64_intdigest(own.tobytes()))
                fps.append(majority(hashes))
                sizes.append(len(own))
                parities.append(parity_bitmap(own))
                if keys[-1] in written:
                    prefixes.append(None)
                    continue
                written.add(keys[-1])
                first = np.lexsort((own, seen))[: prefix_length(len(own), similarity)]
                prefixes.append(own[first].view(np.int64))
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (keys, fps)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *longs, pa.array(sizes, pa.int64()), pa.array(parities, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names=["id", "h", "key", "fp", "n", "parity", "prefix"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_hash(text_col).alias("h"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(released(run), "id long, h string, key long, fp long, n long, parity binary, prefix array<long>")


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The unlike rows (s, key), sorted, whose s another one has; one row waits for the next batch."""
    held: pa.RecordBatch | None = None
    first_kept = False
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b] if held is None else [held, b])
        s, key = (table.column(c).to_numpy() for c in (0, 1))
        new = np.append(True, (s[1:] != s[:-1]) | (key[1:] != key[:-1]))
        if not new.all():
            table, s = table.filter(pa.array(new)), s[new]
        same = s[1:] == s[:-1]
        keep = np.append(same, False)
        keep[1:] |= same
        keep[0] |= first_kept
        # Whether the last row is kept is known so far only if the one before it has its s.
        yield from table.slice(0, len(s) - 1).filter(pa.array(keep[:-1])).combine_chunks().to_batches()
        first_kept, held = bool(keep[-1]), table.slice(len(s) - 1).combine_chunks().to_batches()[0]
    if held is not None and first_kept:
        yield held


def shingle_set(text: bytes | None, words: int) -> set[bytes]:
    tokens = (text or b"").lower().split()
    return {b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set()


def texts_of(keys: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(key, t): one text for each key, however often it is repeated."""
    needed = cut(keys.join(nodes.select("key", "h"), "key"))
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    return docs.select(text_hash(text_col).alias("h"), F.col(text_col).cast("string").alias("t")).join(needed, "h").groupBy("key").agg(F.min("t").alias("t"))


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of the sets with the Jaccard similarity."""
    n = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        x, y = np.searchsorted(column, [a, a + 2048])
        part = np.zeros((len(sets), 2048), dtype=np.float32)
        part[row[x:y], column[x:y] - a] = 1
        both += part @ part.T
    return np.nonzero(np.triu(both >= similarity * (n[:, None] + n[None, :] - both) - 1e-6, 1))


def partnered(n: np.ndarray, group: np.ndarray, parity: list[bytes], similarity: float) -> np.ndarray:
    """Whether a set may have the similarity with another one of another group, by sizes and bitmaps."""
    share = (1 - similarity) / (1 + similarity)
    words = np.array([len(p) // 8 for p in parity])
    found = np.zeros(len(n), dtype=bool)
    # Sets of such a similarity have bitmaps of one length or of lengths one doubling apart.
    for w in np.unique(words):
        at = np.flatnonzero((words == w) | (words == 2 * w))
        own = np.stack([np.bitwise_xor.reduce(np.frombuffer(parity[i], dtype=np.uint64).reshape(-1, w), axis=0) for i in at])
        for k in np.flatnonzero(words[at] == w):
            i = at[k]
            fits = (group[at] != group[i]) & (np.minimum(n[at], n[i]) >= similarity * np.maximum(n[at], n[i]) - 1e-9)
            if not fits.any():
                continue
            off = np.bitwise_count(own[fits] ^ own[k]).sum(axis=1, dtype=np.int64)
            hit = at[fits][off <= share * (n[at][fits] + n[i]) + 1e-6]
            found[hit] = True
            found[i] |= len(hit) > 0
    return found


def possible(lists: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The rows (s, key) of ``lists(s, key, n, c)`` that may link with one of another component in their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["s", *CELL]):
            n, c = table.column("n").to_numpy(), table.column("c").to_numpy()
            parity = table.column("parity").to_pylist()
            ends = [*starts[1:], table.num_rows]
            keep = pa.array(np.concatenate([partnered(n[a:b], c[a:b], parity[a:b], similarity) for a, b in zip(starts, ends)]))
            yield from table.select(["s", "key"]).filter(keep).combine_chunks().to_batches()

    rows = lists.select("s", "key", "n", "c").join(nodes.select("key", "parity"), "key")
    return deal_cells(rows, ["s"], "key", CELL_ROWS).mapInArrow(released(run), "s long, key long").distinct()


def list_links(lists: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """Links (u, v) that connect the texts of each list of ``lists(s, key)`` as all its pairs of that similarity would."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int64()))], names=["key", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["s", *CELL]):
            for a, b in zip(starts, [*starts[1:], table.num_rows]):
                if b - a < 2:
                    continue
                own = table.column("hashes").slice(a, b - a).combine_chunks()
                flat, ends = own.flatten().to_numpy(), np.cumsum(own.value_lengths().to_numpy())
                root = local_roots(b - a, *similar(np.split(flat, ends[:-1]), similarity))
                x = np.flatnonzero(root != np.arange(b - a))
                key = table.column("key").to_numpy()[a:b]
                yield pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(key[root[x]])], names=["u", "v"])

    sets = texts_of(lists.select("key").distinct(), nodes, docs, text_col).mapInArrow(released(hashed), "key long, hashes array<long>")
    return deal_cells(lists.select("s", "key").join(cut(sets), "key"), ["s"], "key", CELL_ROWS).mapInArrow(released(compare), "u long, v long")


def close_enough(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose bitmaps allow the Jaccard similarity; no pair that has it is left out."""
    share = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = share * b.column(4).to_numpy() + 1e-6
            keep = pa.array([least_difference(x.as_py(), y.as_py()) <= z for x, y, z in zip(b.column(2), b.column(3), most)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])

    x = nodes.select(F.col("key").alias("u"), F.col("parity").alias("x"), F.col("n").alias("a"))
    y = nodes.select(F.col("key").alias("v"), F.col("parity").alias("y"), F.col("n").alias("b"))
    both = pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y", (F.col("a") + F.col("b")).alias("n"))
    return both.mapInArrow(released(run), "u long, v long")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose shingles have the Jaccard similarity, compared on the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(as_bytes(b.column(2)), as_bytes(b.column(3))):
                p, q = shingle_set(x.as_py(), words), shingle_set(y.as_py(), words)
                both = len(p & q)
                ok.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["u", "v"])

    texts = cut(texts_of(pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct(), nodes, docs, text_col))
    both = pairs.join(texts.select(F.col("key").alias("u"), F.col("t").alias("x")), "u").join(texts.select(F.col("key").alias("v"), F.col("t").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(released(run), "u long, v long")


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 4) -> DataFrame:
    """(id, h, group) for every row of ``docs``; h is the MD5 of the text, empty if it is null.

    Texts link if the Jaccard similarity of their sets of ``words``-word shingles is
    ``similarity`` or more, and a group is what links connect; every such link counts,
    whatever ``bits``, which only say how much SimHash finds before the prefix filter does.
    Texts without words are one group. Rows with one set are one node, so copies are never
    paired. Sets are told apart by 64-bit hashes.
    """
    rows = cut(features(docs, id_col, text_col, words, similarity))
    nodes = cut(rows.groupBy("key").agg(F.min("h").alias("h"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("parity").alias("parity")))
    of_fp = nodes.groupBy("fp").agg(F.min("key").alias("node"))
    same = nodes.join(of_fp, "fp").where("key <> node").select(F.col("key").alias("u"), F.col("node").alias("v"))
    near = cut(simhash_links(cut(of_fp), bits).unionByName(same).distinct())
    near = cut(verified(near, nodes, docs, text_col, words, similarity))

    # Dealt once by shingle; most shingles of a prefix stand in one text only and go at once.
    lists = rows.select("key", F.explode("prefix").alias("s")).repartition("s").sortWithinPartitions("s", "key")
    lists = cut(lists.select("s", "key").mapInArrow(released(repeated), "s long, key long"))
    found = connected_components(near)
    facts = nodes.select("key", F.col("n").cast("int").alias("n")).join(found, F.col("key") == F.col("node"), "left").select("key", "n", F.coalesce("component", "key").alias("c"))
    lists = lists.join(facts, "key")
    # Shingles of one group only are left out before pairs are made.
    mixed = lists.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("s")
    lists = cut(lists.join(mixed, "s"))
    long = cut(lists.groupBy("s").count().where(F.col("count") > LIST_ROWS).select("s"))
    short = lists.join(long, "s", "left_anti")
    u, v = short.alias("u"), short.alias("v")
    fits = (F.col("u.s") == F.col("v.s")) & (F.col("u.key") < F.col("v.key")) & (F.col("u.c") != F.col("v.c"))
    fits &= F.least("u.n", "v.n") >= similarity * F.greatest("u.n", "v.n") - 1e-9
    rest = u.join(v, fits).select(F.col("u.key").alias("u"), F.col("v.key").alias("v")).distinct()
    rest = cut(close_enough(rest, nodes, similarity))
    rest = cut(verified(rest, nodes, docs, text_col, words, similarity))
    if not long.isEmpty():
        long = cut(possible(lists.join(long, "s"), nodes, similarity))
        rest = rest.unionByName(cut(list_links(long, nodes, docs, text_col, words, similarity).distinct()))

    found = connected_components(near.unionByName(rest))
    return rows.select("id", "h", "key").join(found, rows.key == found.node, "left").select("id", "h", F.coalesce("component", "key").alias("group"))
