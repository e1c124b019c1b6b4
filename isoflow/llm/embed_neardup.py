"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector joins every filter it exceeds a threshold with. The
directions are a random product code: the dimensions are split into blocks, each block has
a codebook of random unit vectors, and a filter is one word of each book, scaled to unit
length. List decoding gives a vector's filters from sorted block products without visiting
the others. Vectors with a cosine near 1 share filters, unlike vectors rarely do; pairs that
meet in a filter are compared in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .cells import CELL, deal_cells, pairs_by_shift, whole_groups
from .common import cut
from .components import connected_components, local_roots

#: Largest bucket that one task compares as a whole.
BUCKET_ROWS = 2048
#: Unlike vectors expected in a filter; independent codes; filters that a pair at the least
#: cosine is expected to share, over all codes; filters that a vector has at least in each code.
OCCUPANCY, CODES, SHARED, LEAST = 24.0, 3, 12.0, 8


@dataclass
class ProductCode:
    books: list[np.ndarray]  # (words, block width)
    cuts: list[int]  # where the blocks begin and end
    threshold: float
    least: int = 0

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row of ``unit`` the ascending numbers of the filters it exceeds.

        Where fewer than ``least`` exceed the threshold, it is lowered for that row step by
        step until there are as many: near vectors have thresholds about as low.
        """
        out = self.exceeding(unit, self.threshold)
        few = [i for i, x in enumerate(out) if len(x) < self.least]
        threshold = self.threshold
        while few and threshold > 0:
            threshold -= 0.015
            for i, x in zip(few, self.exceeding(unit[few], threshold)):
                out[i] = x
            few = [i for i in few if len(out[i]) < self.least]
        return out

    def exceeding(self, unit: np.ndarray, threshold: float) -> list[np.ndarray]:
        m = len(self.books)
        scores = [unit[:, a:b] @ book.T / math.sqrt(m) for book, a, b in zip(self.books, self.cuts, self.cuts[1:])]
        order = [np.argsort(-s, axis=1, kind="stable") for s in scores]
        ranked = [np.take_along_axis(s, o, axis=1) for s, o in zip(scores, order)]
        # Best that the blocks after this one can add.
        rest = np.zeros((m + 1, len(unit)))
        for k in range(m - 1, -1, -1):
            rest[k] = rest[k + 1] + ranked[k][:, 0]
        row, total, number = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), dtype=np.int64)
        for k in range(m):
            rows, totals, numbers = [], [], []
            for r in range(ranked[k].shape[1]):
                t = total + ranked[k][row, r]
                ok = t + rest[k + 1][row] >= threshold
                # Words come in falling order, so a prefix that fails now fails for good.
                row, total, number = row[ok], total[ok], number[ok]
                if not len(row):
                    break
                rows.append(row)
                totals.append(t[ok])
                numbers.append(number * len(self.books[k]) + order[k][row, r])
            row = np.concatenate(rows) if rows else row[:0]
            total = np.concatenate(totals) if rows else total[:0]
            number = np.concatenate(numbers) if rows else number[:0]
        by = np.lexsort((number, row))
        return np.split(number[by], np.searchsorted(row[by], np.arange(1, len(unit))))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def joint_share(z: float, cosine: float) -> float:
    """P(second of two normals with this correlation exceeds z | first does)."""
    x = np.linspace(z, z + 8, 4001)
    density = np.exp(-x * x / 2)
    other = np.array([normal_tail((z - cosine * a) / math.sqrt(1 - cosine**2)) for a in x])
    return float((density * other).sum() / density.sum())


def product_code(n: int, dim: int, cosine: float, seed: int = 42, occupancy: float = OCCUPANCY, shared: float = SHARED) -> ProductCode:
    """Code for ``n`` vectors: cap size by occupancy / n, number of filters by ``shared``.

    A cap gets smaller and the filters more as n grows, so that a vector has about as many
    filters and partners to compare at any size (both grow as n to a small power).
    """
    p = min(0.05, occupancy / max(n, 1))
    lo, hi = 0.0, 12.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_tail(mid) > p else (lo, mid)
    z = (lo + hi) / 2
    count = shared / (p * joint_share(z, cosine))
    m = min(dim, next(k for k in range(2, 65) if count ** (1 / k) <= 400 or k == 64))
    words = max(2, math.ceil(count ** (1 / m)))
    cuts = [dim * k // m for k in range(m + 1)]
    rng = np.random.default_rng(seed)
    books = []
    for a, b in zip(cuts, cuts[1:]):
        book = rng.standard_normal((words, b - a))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True))
    return ProductCode(books, cuts, z / math.sqrt(dim))


def product_codes(n: int, dim: int, cosine: float, seed: int) -> list[ProductCode]:
    codes = [product_code(n, dim, cosine, seed + k, shared=SHARED / CODES) for k in range(CODES)]
    for c in codes:
        c.least = min(LEAST, math.prod(len(b) for b in c.books))
    return codes


def filters_of(codes: list[ProductCode], unit: np.ndarray) -> list[np.ndarray]:
    """Filters of each row over all codes, ascending; numbers of one code follow those of the one before."""
    found, base = [], 0
    for c in codes:
        found.append([x + base for x in c.filters(unit)])
        base += math.prod(len(b) for b in c.books)
    return [np.concatenate(x) for x in zip(*found)]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1).astype(np.float64)


def unit_rows(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of extreme components neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def first_shared(lists: list[np.ndarray], i: np.ndarray, j: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether filter ``own`` is the least that rows i and j share."""
    longest = max(map(len, lists), default=0)
    padded = np.full((len(lists), longest), -1, dtype=np.int64)
    for r, x in enumerate(lists):
        padded[r, : len(x)] = x
    ok = np.ones(len(i), dtype=bool)
    for a in range(0, len(i), 20_000):
        s = slice(a, a + 20_000)
        left, right = padded[i[s]], padded[j[s]]
        lower = np.zeros(len(left), dtype=bool)
        for k in range(longest):
            x = left[:, k]
            lower |= (x >= 0) & (x < own[s]) & (right == x[:, None]).any(axis=1)
        ok[s] = ~lower
    return ok


def first_shared_block(lists: list[np.ndarray], own: int) -> np.ndarray:
    """The same for all pairs of a large group, by one product of incidence matrices."""
    below = [x[x < own] for x in lists]
    names, at = np.unique(np.concatenate(below), return_inverse=True)
    inc = np.zeros((len(lists), len(names)), dtype=np.float32)
    inc[np.repeat(np.arange(len(lists)), [len(x) for x in below]), at] = 1
    inc = inc[:, inc.sum(axis=0) > 1]
    return inc @ inc.T == 0


def vector_links(nodes: DataFrame, cosine: float, dim: int, n: int, seed: int = 42) -> DataFrame:
    """Links among ``nodes(node, vector, copies)``, which hold unlike vectors.

    Rows (u, v, n) of two kinds: v null, u is linked to n further rows (copies counted);
    v given, u and v are connected. A pair counts once, in the least filter it shares. A
    bucket gives a count and a link for each of its rows at most, never its pairs.
    """
    sent = nodes.sparkSession.sparkContext.broadcast([tuple(vars(c).values()) for c in product_codes(n, dim, cosine, seed)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [ProductCode(*c) for c in sent.value]
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                part = b.slice(a, 2048)
                lists = filters_of(codes, unit_rows(matrix(part.column(1))))
                size = [len(x) for x in lists]
                at = pa.array(np.repeat(np.arange(part.num_rows), size))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), *(c.take(at) for c in part.columns)], names=["filter", "node", "vector", "copies"])

    kind = nodes.schema["vector"].dataType.simpleString()
    rows = nodes.select("node", "vector", "copies").mapInArrow(assign, f"filter long, node long, vector {kind}, copies long")
    dealt = deal_cells(rows, ["filter"], "node", BUCKET_ROWS)
    group = ["filter", *CELL]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [ProductCode(*c) for c in sent.value]
        known: dict[int, np.ndarray] = {}

        def lists_of(node: np.ndarray, unit: np.ndarray) -> list[np.ndarray]:
            """Filters of linked rows, listed anew, as they would be most of each dealt row."""
            if len(known) + len(node) > 50_000:
                known.clear()
            new = np.array([i for i, x in enumerate(node.tolist()) if x not in known], dtype=np.int64)
            for at in range(0, len(new), 2048):
                some = new[at : at + 2048]
                known.update(zip(node[some].tolist(), filters_of(codes, unit[some])))
            return [known[x] for x in node.tolist()]

        for table, starts in whole_groups(batches, group):
            rows = table.num_rows
            unit = unit_rows(matrix(table.column("vector")))
            own, node, copies, side, a, b = (table.column(c).to_numpy() for c in ("filter", "node", "copies", "side", *CELL))
            ends = np.append(starts[1:], rows)
            us, vs, small = [], [], ends - starts <= 64
            # Small groups together, large ones by matrix products.
            of_small = np.repeat(small, ends - starts)
            at = np.flatnonzero(of_small)
            if len(at):
                s = np.concatenate([[0], np.cumsum((ends - starts)[small])])[:-1]
                for i, j in pairs_by_shift(s, len(at)):
                    i, j = at[i], at[j]
                    ok = (a[i] == b[i]) | (side[i] != side[j])
                    i, j = i[ok], j[ok]
                    ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                    us.append(i[ok])
                    vs.append(j[ok])
                i, j = np.concatenate(us or [at[:0]]), np.concatenate(vs or [at[:0]])
                used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                lists = lists_of(node[used], unit[used])
                ok = first_shared(lists, back[: len(i)], back[len(i) :], own[i]) if len(used) else np.zeros(0, dtype=bool)
                us, vs = [i[ok]], [j[ok]]
            count = np.zeros(rows, dtype=np.int64)
            root_u, root_v = [], []
            for s, e in zip(starts[~small], ends[~small]):
                near = unit[s:e] @ unit[s:e].T >= cosine
                near &= np.triu(np.ones_like(near), 1) if a[s] == b[s] else np.triu(side[s:e, None] != side[None, s:e], 1)
                if near.any():
                    hit = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
                    near = near[np.ix_(hit, hit)]
                    near &= first_shared_block(lists_of(node[s:e][hit], unit[s:e][hit]), own[s])
                    w = copies[s:e][hit]
                    count[s + hit] += near @ w + near.T @ w
                    i, j = np.nonzero(near)
                    r = local_roots(len(hit), i, j)
                    x = np.flatnonzero(r != np.arange(len(r)))
                    root_u.append(s + hit[x])
                    root_v.append(s + hit[r[x]])
            i, j = np.concatenate([*us, *root_u, starts[:0]]), np.concatenate([*vs, *root_v, starts[:0]])
            k = len(us[0]) if us else 0
            np.add.at(count, i[:k], copies[j[:k]])
            np.add.at(count, j[:k], copies[i[:k]])
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[some], node[i]])), pa.array(np.concatenate([node[some], node[j]]), mask=np.arange(len(some) + len(i)) < len(some)), pa.array(np.concatenate([count[some], np.zeros(len(i), dtype=np.int64)]))],
                names=["u", "v", "n"],
            )

    return dealt.mapInArrow(compare, "u long, v long, n long")


def embedding_near_dups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, seed: int = 42) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of ``vectors``.

    Two rows link if the cosine of their vectors, in double precision, is at least
    ``cosine``. Null, empty and zero vectors and those with null or non-finite components
    link with nothing, and neither do rows with a null id; component_id is then the id
    itself. Equal vectors become one node with a count first, so copies are never paired;
    rows that repeat an id count as rows. Vectors must have the length of most: others
    raise an error. An empty table gives an empty result.
    """
    v = F.col("vector")
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("sound", F.coalesce(sound & F.col("id").isNotNull(), F.lit(False)))
    # Copies are found by value; the hash keeps the rows that are dealt out narrow.
    keyed = rows.where("sound").withColumn("h", F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(seed), F.reverse("vector")).alias("b")))
    nodes = cut(keyed.groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("h").alias("h")))
    facts = nodes.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    if facts.n and facts.low != facts.high:
        raise ValueError(f"vectors of {facts.low} to {facts.high} components")
    lone = rows.where("NOT sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if not facts.n:
        out = lone
    else:
        links = cut(vector_links(nodes, cosine, facts.low, facts.n, seed))
        found = connected_components(links.where("v IS NOT NULL").select("u", "v"))
        counts = links.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
        of = nodes.select("h", "node", "copies").join(counts, "node", "left").join(found, "node", "left")
        of = of.select("h", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
        out = keyed.select("id", "h").join(of, "h").select("id", "n_links", "component_id").unionByName(lone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
