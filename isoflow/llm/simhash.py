"""SimHash near-duplicates: fingerprints, and links found by the generalised pigeonhole.

A pair of fingerprints within ``bits`` differing bits must, over any grouping of the 64
bits into m parts and any thresholds t_1..t_m >= -1 that add up to bits - m + 1, differ
by at most t_i in some part i (a part with t_i = -1 is not probed at all). The parts
group correlated bits, so that the others stay selective, and the thresholds come from
a dynamic programme over estimated candidate counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .cells import CELL, deal_cells, pairs_by_shift, whole_groups
from .common import cut
from .components import connected_components, local_roots

#: Queries whose candidate counts steer the thresholds. They never decide what is linked.
PROBE_SAMPLE = 64
#: Largest bucket that one task compares as a whole.
BUCKET_ROWS = 4096
SEED = 42


def shingle_hashes(text: bytes | None, words: int = 4) -> np.ndarray:
    """XXH64 of every shingle of one UTF-8 text, in order.

    A-Z are lower-cased, words end at ASCII white space, shingles of ``words`` words are
    joined by a space. Fewer words make one shingle, no words none.
    """
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    flat = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(flat, SEED)], dtype=np.uint64)
    at = [0]
    for x in map(len, tokens):
        at.append(at[-1] + x + 1)
    return np.array([digest(flat[a : b - 1], SEED) for a, b in zip(at, at[words:])], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64-bit number of the bits that more than half of the hashes have; repeats count. None give zero."""
    n = len(hashes)
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, 4096):
        block = hashes[a : a + 4096]
        ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int = 4) -> int:
    """Unsigned 64-bit SimHash of one UTF-8 text."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary() if pa.types.is_large_string(b.column(1).type) else pa.binary())
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in texts), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def bit_correlations(fps: DataFrame) -> np.ndarray:
    """|correlation| of the 64 bits over all fingerprints; tasks add up their own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(x), 65536):
                block = np.ascontiguousarray(x[a : a + 65536])
                bits = np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(block)
        i, j = np.indices((64, 64)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(total.ravel(), float(n)))], names=["i", "j", "c"]
        )

    rows = fps.select("fp").mapInArrow(run, "i long, j long, c double").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    both, n = np.zeros((64, 64)), 0.0
    for r in rows:  # 4,097 rows at any size
        if r.i < 0:
            n = r.c
        else:
            both[r.i, r.j] = r.c
    if not n:
        return np.eye(64)
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m parts of even width, each grown from a seed by the bit most correlated with it."""
    free, parts = set(range(64)), []
    for k in range(m):
        width = len(free) // (m - k)
        rest = sorted(free)
        seed = max(rest, key=lambda i: (corr[i, rest].sum(), -i))
        part = [seed]
        free.discard(seed)
        while len(part) < width:
            best = max(sorted(free), key=lambda i: (corr[i, part].sum(), -i))
            part.append(best)
            free.discard(best)
        parts.append(sorted(part))
    return parts


def mask(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def candidate_counts(fps: DataFrame, n: int, parts: list[list[int]]) -> np.ndarray:
    """Estimated candidates of all queries for each part at thresholds 0 and 1."""
    some = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(PROBE_SAMPLE).collect()
    queries = np.array([r.fp for r in some], dtype=np.int64)
    masks = np.array([mask(p) for p in parts], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((len(masks), 2))
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            for q in queries:
                diff = x ^ q
                for i, m in enumerate(masks):
                    d = np.bitwise_count((diff & m).view(np.uint64))
                    got[i] += (d == 0).sum(), (d <= 1).sum()
        i, t = np.indices(got.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(t), pa.array(got.ravel())], names=["i", "t", "c"])

    out = np.zeros((len(parts), 2))
    for r in fps.select("fp").mapInArrow(run, "i long, t long, c double").groupBy("i", "t").agg(F.sum("c").alias("c")).collect():
        out[r.i, r.t] = r.c
    return out * n / max(len(queries), 1)


def allocate(costs: np.ndarray, total: int) -> list[int] | None:
    """Thresholds in {-1, 0, 1} that add up to ``total`` at the least cost; costs[i, t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in (-1, 0, 1):
                new = (c + row[t + 1], [*ts, t])
                if s + t not in step or new < step[s + t]:
                    step[s + t] = new
        best = step
    return best[total][1] if total in best else None


def plan_probes(fps: DataFrame, n: int, bits: int) -> list[tuple[list[int], int]]:
    """(bits of a part, threshold) for the cheapest number of parts."""
    corr = bit_correlations(fps)
    # Every part needs a threshold of 1 at most, so at least (bits + 1) / 2 parts.
    options = [group_bits(corr, m) for m in range((bits + 2) // 2, bits + 2)]
    counts = candidate_counts(fps, n, [p for o in options for p in o])
    best, at = None, 0
    for parts in options:
        own = counts[at : at + len(parts)]
        at += len(parts)
        width = np.array([len(p) for p in parts])
        # A dealt row costs about as much as comparing twenty candidates.
        costs = np.stack([np.zeros(len(parts)), own[:, 0] + 20 * n, own[:, 1] + 20 * n * (1 + width / 2)], axis=1)
        ts = allocate(costs, bits - len(parts) + 1)
        if ts is not None:
            cost = sum(costs[i, t + 1] for i, t in enumerate(ts))
            if best is None or cost < best[0]:
                best = (cost, [(p, t) for p, t in zip(parts, ts) if t >= 0])
    return best[1]


def simhash_links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (u, v) that connect the nodes of ``fps(fp, node)`` as all pairs within ``bits`` bits would.

    ``fp`` must be distinct. Buckets give a forest for each cell rather than all pairs.
    """
    n = fps.count()
    probes = plan_probes(fps, n, bits)
    keys = []
    for k, (part, t) in enumerate(probes):
        own = F.col("fp").bitwiseAND(F.lit(mask(part)))
        keys.append(F.array(F.struct(F.lit(k).alias("part"), own.alias("value"), F.lit(0).alias("probe"))))
        if t == 1:
            # Of two values one bit apart, the one with the bit set looks up the other.
            less = [
                F.when(F.col("fp").bitwiseAND(F.lit(mask([b]))) != 0, F.struct(F.lit(k).alias("part"), own.bitwiseXOR(F.lit(mask([b]))).alias("value"), F.lit(1).alias("probe")))
                for b in part
            ]
            keys.append(F.array_compact(F.array(*less)))
    rows = fps.select("fp", "node", F.explode(F.concat(*keys)).alias("k")).select("k.*", "fp", "node")
    dealt = deal_cells(rows, ["part", "value"], "node", BUCKET_ROWS)
    group = ["part", "value", *CELL]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group):
            cols = {c: table.column(c).to_numpy() for c in ("fp", "node", "probe", "side", *CELL)}
            whole = cols["cell_a"] == cols["cell_b"]
            us, vs = [], []
            for i, j in pairs_by_shift(starts, table.num_rows):
                ok = np.bitwise_count((cols["fp"][i] ^ cols["fp"][j]).view(np.uint64)) <= bits
                i, j = i[ok], j[ok]
                ok = (cols["probe"][i] + cols["probe"][j] < 2) & (whole[i] | (cols["side"][i] != cols["side"][j]))
                us.append(i[ok])
                vs.append(j[ok])
                if sum(map(len, us)) > 4_000_000:
                    root = local_roots(table.num_rows, np.concatenate(us), np.concatenate(vs))
                    x = np.flatnonzero(root != np.arange(len(root)))
                    us, vs = [x], [root[x]]
            if us and sum(map(len, us)):
                root = local_roots(table.num_rows, np.concatenate(us), np.concatenate(vs))
                x = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(cols["node"][x]), pa.array(cols["node"][root[x]])], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def simhash_near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id, kept) for every row of ``docs``.

    Rows link if their fingerprints differ in at most ``bits`` bits; component_id is the
    smallest id reachable by links. Equal fingerprints are one node, so copies are never
    paired with each other. Null and empty texts have fingerprint zero and link like
    others. A row without an id takes the component of its fingerprint, null if no row
    with an id has one; ``kept`` marks the row whose id is the component's. Repeated rows
    are all returned. An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("node")))
    found = connected_components(simhash_links(nodes.where("node IS NOT NULL"), bits))
    of = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(of, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
