"""Token ids in sorted-string-table shards, and their readers.

Layout of a shard, all integers little-endian unless said:

* data blocks, each compressed with zstd: entries of varint shared key length, varint rest
  length, varint value length, rest of the key, value. A key is prefix-compressed against
  the key before it in its block. Keys sort as bytes: a null id is 0x00, another 0x01 and
  the id as big-endian 64-bit number with its sign bit flipped; four big-endian bytes
  number rows of equal id. A value holds a document's ids as 16- or 32-bit numbers.
* index: for every block varint key length, last key, varint offset, size, first place
  (ids of the shard before the block) and CRC-32 of the compressed block.
* Bloom filter over the ids' keys without the numbering.
* footer of 72 bytes: offset and size of the index, of the filter, documents, ids, id
  width, number of hash functions, magic.

Lookups test the filter, search the index by bisection and read one block.
"""

from __future__ import annotations

import bisect
import functools
import json
import math
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import cut, fresh_path, released

MAGIC = b"SSTIDS01"
FOOTER, FOOTER_BYTES = "<QQQQQQIIQ", 64
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 16 << 20
#: Text that a task encodes; at most so many tasks, which then take more, one document after another.
TASK_BYTES, MAX_TASKS = 16 << 20, 20_000
BLOOM_BITS, BLOOM_HASHES = 10, 7


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def id_key(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def key_id(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + k * b) % bits for k in range(hashes)]


class ShardWriter:
    """Collects documents in key order and gives the bytes of a shard."""

    def __init__(self, width: int):
        self.width, self.out, self.index, self.keys = width, bytearray(), bytearray(), []
        self.block, self.last, self.n_docs, self.n_ids, self.block_start = bytearray(), b"", 0, 0, 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, copy: int, ids: bytes) -> None:
        key = id_key(doc_id) + struct.pack(">I", copy)
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        put_varint(self.block, shared)
        put_varint(self.block, len(key) - shared)
        put_varint(self.block, len(ids))
        self.block += key[shared:]
        self.block += ids
        self.keys.append(key[:-4])
        self.last = key
        self.n_docs += 1
        self.n_ids += len(ids) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self.close_block()

    def close_block(self) -> None:
        if not self.block:
            return
        packed = self.zstd.compress(bytes(self.block))
        put_varint(self.index, len(self.last))
        self.index += self.last
        for n in (len(self.out), len(packed), self.block_start, zlib.crc32(packed)):
            put_varint(self.index, n)
        self.out += packed
        self.block, self.block_start = bytearray(), self.n_ids

    def size(self) -> int:
        return len(self.out) + len(self.block)

    def finish(self) -> bytes:
        self.close_block()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, dtype=bool)
        for key in self.keys:
            bloom[bloom_places(key, bits, BLOOM_HASHES)] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        at = len(self.out)
        footer = struct.pack(FOOTER, at, len(self.index), at + len(self.index), bits, self.n_docs, self.n_ids, self.width, BLOOM_HASHES, 0)
        self.out += self.index + packed + footer + MAGIC
        return bytes(self.out)


class ShardReader:
    """Reads a shard through ``read(offset, size)``; ``size`` is the length of the file."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        tail = read(size - FOOTER_BYTES - len(MAGIC), FOOTER_BYTES + len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard, or cut short")
        at, n, self.bloom_at, self.bits, self.n_docs, self.n_ids, self.width, self.hashes, _ = struct.unpack(FOOTER, tail[: -len(MAGIC)])
        index, p = read(at, n), 0
        self.last_keys, self.blocks = [], []
        while p < n:
            k, p = get_varint(index, p)
            self.last_keys.append(index[p : p + k])
            p += k
            block = []
            for _ in range(4):
                x, p = get_varint(index, p)
                block.append(x)
            self.blocks.append(block)
        self.bloom: np.ndarray | None = None

    def entries(self, n: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids of the shard before it, value) of block ``n``."""
        offset, size, place, crc = self.blocks[n]
        packed = self.read(offset, size)
        if zlib.crc32(packed) != crc:
            raise ValueError(f"block {n} is damaged")
        data, p, key = zstandard.ZstdDecompressor().decompress(packed), 0, b""
        while p < len(data):
            shared, p = get_varint(data, p)
            rest, p = get_varint(data, p)
            size, p = get_varint(data, p)
            key = key[:shared] + data[p : p + rest]
            p += rest
            yield key, place, data[p : p + size]
            p += size
            place += size // self.width

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype=f"<u{self.width}").astype("<u4")

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for n in range(len(self.blocks)):
            for key, place, value in self.entries(n):
                yield key_id(key), place, self.ids(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with that id."""
        key = id_key(doc_id)
        if self.bloom is None:
            self.bloom = np.unpackbits(np.frombuffer(self.read(self.bloom_at, -(-self.bits // 8)), np.uint8), bitorder="little")
        if not self.bloom[bloom_places(key, self.bits, self.hashes)].all():
            return []
        found = []
        for n in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
            for k, _, value in self.entries(n):
                if k[:-4] == key:
                    found.append(self.ids(value))
                elif k[:-4] > key:
                    return found
        return found


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


#: Characters that lower-case and compose one by one and that a chunk is cut by here; other texts go to the library whole.
PLAIN = [c for c in map(chr, range(0x250)) if len(c.lower()) == 1 and c.lower() < "\u0250"]
_LETTERS = "".join(c for c in PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in PLAIN if unicodedata.category(c)[0] == "N")
_OTHER = re.compile(f"[^{re.escape(''.join(PLAIN))}]")
#: The split of the vocabulary file, written out for PLAIN characters.
_CHUNK = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}\t-\r \x85\xa0]+")


class TextEncoder:
    """Ids of texts as bytes, by a tokenizers file whose vocabulary marks word ends.

    Where the file lower-cases, drops white space and splits as _CHUNK does, texts of PLAIN
    characters are split here, and the library's model sees each unlike chunk once, many in
    one text; the word-end mark tells them apart again. All other texts go to the library
    whole.
    """

    #: Chunks kept; the older half goes when they are more.
    KEPT = 600_000

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers as pre

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.width = 2 if max(len(vocab), max(vocab.values()) + 1, end_id + 1) <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.end = np.array([end_id], dtype=self.dtype).tobytes()
        spec = json.loads(self.tok.to_str())
        self.special = re.compile("|".join([re.escape(t["content"]) for t in spec["added_tokens"]] or ["(?!)"]))
        self.chunked = json.dumps([spec["normalizer"], spec["pre_tokenizer"]]) == json.dumps(CHUNKED) and bool(mark := spec["model"].get("end_of_word_suffix"))
        if self.chunked:
            self.words = Tokenizer(self.tok.model)
            self.words.pre_tokenizer = pre.Sequence([pre.Split(" ", "removed"), pre.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(mark)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def library(self, tok, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        for a in range(0, len(new), 300):
            part = new[a : a + 300]
            ids = self.library(self.words, [" ".join(part)])[0]
            at = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(at) == len(part):
                data = ids.tobytes()
                for w, x, y in zip(part, [0, *at], at):
                    self.young[w] = data[x:y]
            else:
                for w, x in zip(part, self.library(self.words, part)):
                    self.young[w] = x.tobytes()

    def recall(self, words: set[str]) -> None:
        """Puts all of ``words`` into the young half."""
        if len(self.young) + len(words) > self.KEPT // 2:
            self.old, self.young = self.young, {}
        new = []
        for w in words:
            if w not in self.young:
                if (v := self.old.get(w)) is None:
                    new.append(w)
                else:
                    self.young[w] = v
        self.learn(new)

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        split, whole = [], []
        for i, t in enumerate(texts):
            if self.chunked and not _OTHER.search(t) and not self.special.search(t):
                split.append((i, _CHUNK.findall(t.lower())))
            else:
                whole.append(i)
        self.recall(set().union(*(ws for _, ws in split)))
        get = self.young.__getitem__
        for i, ws in split:
            out[i] = b"".join(map(get, ws))
        for i, x in zip(whole, self.library(self.tok, [texts[i] for i in whole])):
            out[i] = x.tobytes()
        return out


#: Normalizer and split of a file whose texts are cut by _CHUNK (fixed values of its format).
CHUNKED = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str, end_id: int) -> TextEncoder:
    """One encoder for all tasks of a Python worker, with the chunks they met."""
    return TextEncoder(path, end_id)


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, remember: bool = True) -> DataFrame:
    """Encodes every text and writes shards under ``path`` in ascending order of id, nulls first.

    Returns (shard, n_docs, n_ids), a row for each file, in the order of their names.
    ``tokenizer`` is a file of the tokenizers library; special strings in texts become
    special ids, as is the library's default. ``end_id`` is appended to every document;
    null texts count as empty; rows of equal id are all kept, in the order of a hash of their
    texts, and numbered within the task that has them. A file gets its final name when it is whole, so a task that
    runs again replaces what it wrote. An empty table writes no file. With ``remember`` the
    chunks that a worker met stay for its next task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, end_id)
        width, end = encoder.width, encoder.end
        fs, root = opened(path)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        writer, done, before, copy = ShardWriter(width), [], object(), 0

        def close() -> None:
            nonlocal writer
            if writer.n_docs:
                name = f"part-{part:06d}-{len(done):06d}.sst"
                fs.create_dir(root, recursive=True)
                with fs.open_output_stream(f"{root}/_{name}-{attempt}") as f:
                    f.write(writer.finish())
                fs.move(f"{root}/_{name}-{attempt}", f"{root}/{name}")
                done.append((name, writer.n_docs, writer.n_ids))
            writer = ShardWriter(width)

        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                ids = some.column(0).to_pylist()
                texts = [t or "" for t in some.column(1).to_pylist()]
                for i, v in zip(ids, encoder.encode(texts)):
                    copy = copy + 1 if i == before else 0
                    before = i
                    writer.add(i, copy, v + end)
                    if writer.size() >= shard_bytes:
                        close()
        close()
        if not remember:
            encoder.forget()
        yield pa.RecordBatch.from_pydict({"shard": [d[0] for d in done], "n_docs": pa.array([d[1] for d in done], pa.int64()), "n_ids": pa.array([d[2] for d in done], pa.int64())}, schema=pa.schema([("shard", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Rows of one id may be many, so they are dealt by their texts too.
    rows = rows.withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = F.col("id").asc_nulls_first(), F.col("h")
    rows = rows.repartitionByRange(min(MAX_TASKS, math.ceil(size / TASK_BYTES) + 1), *order).sortWithinPartitions(*order, "text")
    return cut(rows.mapInArrow(released(run), "shard string, n_docs long, n_ids long"))


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, id, place, ids) from rows (shard, content)."""

    def rows(name: str, ids: list, places: list, values: list) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(ids, pa.int64()), pa.array(places, pa.int64()), lists], names=["shard", "id", "place", "ids"])

    for b in batches:
        for name, content in zip(b.column(0), b.column(1)):
            data = content.as_buffer().to_pybytes()
            reader = ShardReader(lambda a, n, data=data: data[a : a + n], len(data))
            ids, places, values = [], [], []
            for i, p, v in reader:
                ids.append(i)
                places.append(p)
                values.append(v)
                if len(ids) == 512:
                    yield rows(name.as_py(), ids, places, values)
                    ids, places, values = [], [], []
            if ids:
                yield rows(name.as_py(), ids, places, values)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """(shard, content) of the shards."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.sst").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, id, place, ids): every document in the shards; place counts the ids before it in its shard."""
    return shard_files(spark, path).mapInArrow(shard_rows, "shard string, id long, place long, ids array<int>")


def lookup(path: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of a document, from the shards that may hold it; reads footers, one index each, and a block."""
    fs, root = opened(path)
    found = []
    for info in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda f: f.path):
        if info.base_name.startswith("part-") and info.base_name.endswith(".sst"):
            with fs.open_input_file(info.path) as f:
                found += ShardReader(lambda a, n, f=f: f.read_at(n, a), info.size).get(doc_id)
    return found


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, remember: bool = True) -> DataFrame:
    """Writes shards, reads them back: (id_col, start, n_tokens, ids_crc32) for every document.

    start counts the ids of all documents before it, over all shards; ``remember`` as in
    ``write_token_shards``.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    names = [id_col, "start", "n_tokens", "ids_crc32"]
    shards = write_token_shards(docs, path, tokenizer, end_id, id_col, text_col, remember=remember)
    if shards.isEmpty():
        return spark.createDataFrame([], f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")

    # Each id as its four little-endian bytes. Read and digested by one worker, so that a task needs no second one.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shard_rows(batches):
            ids = b.column(3)
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], names=["shard", "id", "place", "n", "crc"])

    read = cut(shard_files(spark, path).mapInArrow(released(run), "shard string, id long, place long, n long, crc long"))
    before = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    base = read.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return read.join(base, "shard").select(F.col("id").alias(id_col), (F.col("base") + F.col("place")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
