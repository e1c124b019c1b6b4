"""Importance resampling towards a target by bucket-partitioned inverted postings.

A task turns its documents into blocks and inverts each: for every hash bucket the documents
that have it and how often. The postings of a group of buckets go to one unit, and so do the
bucket's counts over both corpora, which a task adds up before it sends them. They sort before
the postings, so a unit knows the gains of its buckets when the postings pass by, and it holds
no more than one block's at once. It gives each block the gains its documents have there; the
sums of a block over all groups of buckets are the weights. Units of the same buckets but other
blocks (salts) get the same counts, so there are as many units as the session has partitions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut
from .ranks import with_rank

#: Groups of buckets; features after which a block is closed (documents: 65,535 at most); words hashed at once.
GROUPS, BLOCK_FEATURES, AT_ONCE = 50, 1_500_000, 300_000
#: Bytes of a text that are split at once, and words a task remembers the hashes of.
PIECE_BYTES, REMEMBERED = 1 << 20, 1_000_000

#: A-Z become a-z; all else below 128 but digits and a-z becomes a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SOURCE, TARGET, POSTINGS, ROWS = range(4)


def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """What n zero bytes after a text do to its CRC-32, by its four bytes: for n from 0 to 63, and for 64, 128, 256 ..."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)
    unit = np.arange(256, dtype=np.uint32)
    step = np.stack([unit << np.uint32(8 * k) for k in range(4)])
    small = [step]
    for _ in range(64):
        step = (step >> np.uint32(8)) ^ one[step & np.uint32(255)]
        small.append(step)
    large = [small.pop()]
    while len(large) < 26:
        large.append(shifted(large[-1].ravel(), large[-1]).reshape(4, 256))
    return np.stack(small), np.stack(large)


def shifted(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


SMALL, LARGE = crc_tables()
FLAT = SMALL.ravel()


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts from those of their two parts and the bytes of the second part."""
    at = (length & 63) << 10
    out = FLAT[at + (first & 255)] ^ FLAT[at + 256 + ((first >> 8) & 255)] ^ FLAT[at + 512 + ((first >> 16) & 255)] ^ FLAT[at + 768 + (first >> 24)]
    rest = length >> 6
    if rest.any():
        for bit in range(int(rest.max()).bit_length()):
            m = (rest >> bit) & 1 == 1
            out[m] = shifted(out[m], LARGE[bit])
    return out ^ second


class Words:
    """Words of a task by number, with the CRC-32 of each alone and after a space."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.alone = self.after = np.zeros(0, dtype=np.uint32)
        self.length = np.zeros(0, dtype=np.int64)

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC-32 of each word, of a space and the word, and the bytes of the latter."""
        if len(self.at) > REMEMBERED:
            self.forget()
        known, at = len(self.at), self.at
        for w in set(words).difference(at):
            at[w] = len(at)
        new = list(at)[known:]
        if new:
            self.alone = np.append(self.alone, np.array([zlib.crc32(w) for w in new], dtype=np.uint32))
            self.after = np.append(self.after, np.array([zlib.crc32(w, 3916222277) for w in new], dtype=np.uint32))  # the CRC-32 of a space
            self.length = np.append(self.length, np.array([len(w) + 1 for w in new], dtype=np.int64))
        i = np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words))
        return self.alone[i], self.after[i], self.length[i]


def split_words(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in lists of bounded size."""
    text = (text or b"").translate(TO_WORDS)
    a = 0
    while a < len(text):
        b = text.find(b" ", a + PIECE_BYTES)
        b = len(text) if b < 0 else b
        yield text[a:b].split()
        a = b


class Inverter:
    """Collects documents and inverts them by bucket, a block at a time."""

    def __init__(self, buckets: int, longest: int) -> None:
        self.buckets, self.longest, self.words = buckets, longest, Words()
        self.total = np.zeros(buckets, dtype=np.int64)  # over all blocks
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting: list[tuple[int, int, list[bytes]]] = []  # document, words before that count no more, words
        self.n_waiting = self.features = 0
        self.ids: list = []
        self.n_words: list[int] = []

    def add(self, id_, text: bytes | None) -> None:
        doc, n, tail = len(self.ids), 0, []
        for words in split_words(text):
            self.waiting.append((doc, len(tail), tail + words))
            self.n_waiting += len(words) + len(tail)
            n += len(words)
            tail = (tail + words)[-(self.longest - 1) :] if self.longest > 1 else []
            if self.n_waiting >= AT_ONCE:
                self.count()
        self.ids.append(id_)
        self.n_words.append(n)

    def full(self) -> bool:
        return self.features + self.longest * self.n_waiting >= BLOCK_FEATURES or len(self.ids) >= 65_535

    def count(self) -> None:
        """Turns the waiting words into (bucket, document) keys and their counts."""
        flat = [w for _, _, words in self.waiting for w in words]
        if flat:
            size = np.array([len(w) for _, _, w in self.waiting])
            part = np.repeat(np.arange(len(size)), size)
            doc = np.array([d for d, _, _ in self.waiting], dtype=np.int64)[part]
            fresh = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) >= np.array([t for _, t, _ in self.waiting])[part]
            crc, after, length = self.words.hashes(flat)
            keys = [(crc[fresh] % self.buckets).astype(np.int64) << 16 | doc[fresh]]
            for o in range(1, min(self.longest, len(flat))):
                crc = joined_crc(crc[:-1], after[o:], length[o:])  # of the o + 1 words that end here
                ok = (part[o:] == part[:-o]) & fresh[o:]
                keys.append((crc[ok] % self.buckets).astype(np.int64) << 16 | doc[o:][ok])
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            self.total += np.bincount(key >> 16, n, self.buckets).astype(np.int64)
            self.features += int(n.sum())
            self.parts.append((key, n))
        self.waiting, self.n_waiting = [], 0

    def block(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the block and their counts."""
        self.count()
        if not self.parts:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        key, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[first], np.add.reduceat(n, first)


def packed(*arrays: np.ndarray) -> bytes:
    """The arrays' bytes, each split into planes of low to high bytes, compressed; see ``unpacked``."""
    planes = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    sizes = np.array([len(planes), *map(len, arrays)], dtype=np.int64).tobytes()
    return sizes + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    k = len(kinds)
    size, *lengths = np.frombuffer(data, dtype=np.int64, count=k + 1)
    raw = np.frombuffer(pa.decompress(data[8 * (k + 1) :], decompressed_size=int(size), codec="zstd"), dtype=np.uint8) if size else np.zeros(0, dtype=np.uint8)
    out, a = [], 0
    for n, kind in zip(lengths, kinds):
        w = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[a : a + n * w].reshape(w, n).T).view(kind).ravel())
        a += n * w
    return out


def postings(key: np.ndarray, n: np.ndarray, low: int, high: int) -> bytes:
    """Of the buckets from ``low``: how many documents each has, the gaps between these, and their counts."""
    a, b = np.searchsorted(key, [low << 16, high << 16])
    bucket, doc = (key[a:b] >> 16) - low, key[a:b] & 65_535
    gap = doc.copy()
    gap[1:] -= np.where(bucket[1:] == bucket[:-1], doc[:-1], 0)
    return packed(np.bincount(bucket, minlength=high - low).astype(np.uint32), gap.astype(np.uint16), n[a:b].astype(np.uint32))


def contributions(data: bytes, gain: np.ndarray, docs: int) -> np.ndarray:
    """What the postings' gains add up to for each document of the block."""
    held, gap, n = unpacked(data, np.uint32, np.uint16, np.uint32)
    held = held.astype(np.int64)
    running = np.cumsum(gap, dtype=np.int64)
    start = np.cumsum(held) - held
    before = np.append(0, running)[start]
    doc = running - np.repeat(before, held)
    # Whole numbers far below 2^53, so exact.
    return np.bincount(doc, np.repeat(gain, held) * n, docs).astype(np.int64)


def gains(source: np.ndarray, s_all: int, target: np.ndarray, t_all: int, buckets: int) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of each bucket in the target over that in the source."""
    return np.array([math.floor(1000 * math.log((t + 1) * (t_s := float(s_all + buckets)) / ((s + 1) * float(t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def bounds(buckets: int, groups: int) -> np.ndarray:
    return np.arange(groups + 1) * buckets // groups


def weights(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text: str, buckets: int, longest: int) -> DataFrame:
    """(id, n_words, n_features, weight, block, place) for every row of ``docs``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = min(GROUPS, buckets)
    salts = max(1, math.ceil(parts / groups))
    edge = bounds(buckets, groups)
    id_type = docs.schema[id_col].dataType.simpleString()
    row = f"unit int, kind int, block long, docs int, data binary, ids array<{id_type}>"

    def inverted(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, made, id_kind = Inverter(buckets, longest), 0, None

            def out(units, kinds, block: int, docs_: int, data: list[bytes], ids) -> pa.RecordBatch:
                n = len(units)
                cols = [pa.array(units, pa.int32()), pa.array(kinds, pa.int32()), pa.array([block] * n, pa.int64()), pa.array([docs_] * n, pa.int32()), pa.array(data, pa.binary()), pa.array(ids, pa.list_(id_kind))]
                return pa.RecordBatch.from_arrays(cols, names=["unit", "kind", "block", "docs", "data", "ids"])

            def close() -> Iterator[pa.RecordBatch]:
                nonlocal made
                key, n = own.block()
                block = TaskContext.get().partitionId() << 32 | made
                made += 1
                salt = zlib.crc32(block.to_bytes(8, "little")) % salts
                if kind == SOURCE:
                    units = [g * salts + salt for g in range(groups)]
                    yield out(units, [POSTINGS] * groups, block, len(own.ids), [postings(key, n, int(edge[g]), int(edge[g + 1])) for g in range(groups)], [None] * groups)
                    yield out([block % (groups * salts)], [ROWS], block, len(own.ids), [packed(np.array(own.n_words, dtype=np.int64))], [own.ids])
                own.clear()

            for b in batches:
                id_kind = b.column(0).type
                text = b.column(1).cast(pa.large_binary() if pa.types.is_large_string(b.column(1).type) else pa.binary())
                for i, t in zip(b.column(0).to_pylist(), text):
                    own.add(i, t.as_py())
                    if own.full():
                        yield from close()
            if own.ids:
                yield from close()
            if made:
                units = [(g, s) for g in range(groups) for s in range(salts)]
                # The sum over all buckets comes first.
                data = [packed(np.append(own.total.sum(), own.total[edge[g] : edge[g + 1]])) for g in range(groups)]
                yield out([g * salts + s for g, s in units], [kind] * len(units), -1, 0, [data[g] for g, _ in units], [None] * len(units))

        return run

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, gain, sums = None, None, {}
        for b in batches:
            blocks, data = [], []
            for u, k, block, n, d in zip(*(b.column(c).to_pylist() for c in range(5))):
                if u != unit:
                    unit, gain, sums = u, None, {SOURCE: 0, TARGET: 0}
                if k in (SOURCE, TARGET):
                    sums[k] = sums[k] + unpacked(d, np.int64)[0]
                elif k == POSTINGS:
                    if gain is None:
                        s = sums[SOURCE]
                        t = sums[TARGET] if isinstance(sums[TARGET], np.ndarray) else np.zeros_like(s)
                        gain = gains(s[1:], int(s[0]), t[1:], int(t[0]), buckets)
                    blocks.append((block, POSTINGS, n, None))
                    data.append(packed(contributions(d, gain, n)))
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in blocks], pa.int64()), pa.array([POSTINGS] * len(blocks), pa.int32()), pa.array([x[2] for x in blocks], pa.int32()), pa.array(data, pa.binary()), pa.nulls(len(blocks), b.column(5).type)], names=["block", "kind", "docs", "data", "ids"])
            own = pa.array(np.asarray(b.column(1)) == ROWS)
            rest = b.filter(own)
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays([rest.column(2), rest.column(1), rest.column(3), rest.column(4), rest.column(5)], names=["block", "kind", "docs", "data", "ids"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, words, ids = None, 0, None, None

        def out() -> Iterator[pa.RecordBatch]:
            if block is not None:
                n = len(words)
                made = sum(np.maximum(words - o, 0) for o in range(longest))
                yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(made), pa.array(total + np.zeros(n, dtype=np.int64)), pa.array(np.full(n, block)), pa.array(np.arange(n))], names=["id", "n_words", "n_features", "weight", "block", "place"])

        for b in batches:
            for n, (own, kind, data) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3)))):
                if own != block:
                    yield from out()
                    block, total = own, 0
                if kind == POSTINGS:
                    total = total + unpacked(data, np.int64)[0]
                else:
                    words, ids = unpacked(data, np.int64)[0], b.column(4)[n].values.take(pa.array(np.arange(len(b.column(4)[n]))))
        yield from out()

    own = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(inverted(SOURCE), row)
    other = target.select(F.lit(None).cast(id_type).alias("id"), F.col(target_text).cast("string")).mapInArrow(inverted(TARGET), row)
    units = own.unionByName(other).repartition("unit").sortWithinPartitions("unit", "kind")
    given = units.mapInArrow(contribute, f"block long, kind int, docs int, data binary, ids array<{id_type}>")
    blocks = given.repartition("block").sortWithinPartitions("block", "kind")
    return blocks.mapInArrow(added, f"id {id_type}, n_words long, n_features long, weight long, block long, place long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 times a Gumbel variate) that the seed and the id give."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, longest: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) for every row of ``docs``; rows with a rank are drawn.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; features
    are runs of 1 to ``longest`` words, put in ``buckets`` by CRC-32. A bucket's gain is
    floor(1000 ln) of its smoothed share in the target's texts over that in all documents, and
    the weight is the sum of the gains of a document's features. The score adds Gumbel noise,
    so the highest ``percent`` of the scores of documents with ``least_words`` words are a
    sample without replacement with chances as the weights; ranks go from 1, ties to the
    smaller id. ``id`` keeps its type and comes back under the name ``id``.

    Null and empty texts have no features, weight 0 and no rank; null ids score as the text
    "null" and come last among ties; repeated rows are rows of their own. An empty table gives
    none; an empty target leaves every gain to the documents' own counts. Further columns are
    not read. The rows of ``docs`` must come in the same order if they are read again, as
    those of files do.
    """
    w = weights(docs, target, id_col, text_col, target_text, buckets, longest)
    scored = cut(w.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)))
    fit = F.col("n_words") >= least_words
    most = scored.agg(F.count(F.when(fit, 1)).alias("n")).first().n * percent // 100
    # The block and the place in it tell repeated rows apart, so ranges stay even.
    ranked = with_rank(scored.withColumn("unfit", (~fit).cast("int")), [F.col("unfit"), F.desc("score"), F.asc_nulls_last("id"), F.col("block"), F.col("place")])
    return ranked.select("id", "n_words", "n_features", "weight", "score", F.when((F.col("unfit") == 0) & (F.col("rank") <= most), F.col("rank")).alias("rank"))
