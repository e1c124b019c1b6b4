"""Phrase collocations by vertical positional inverted lists.

A task numbers the words of its texts and keeps, for a block of them, the list of positions of
every word. The lists' lengths, added up over all blocks, are the words' exact frequencies. The
frequent words go back to their blocks, where each one's positions are merged with the postings
one place further on; that gives the lists of the pairs, and in the same way those of the
triples whose two pairs are frequent. Only lengths of lists and the marks of frequent phrases
are shuffled with their phrases, never positions. Frequent pairs go to the blocks as a whole
if they are few, and only to the blocks that have them, by a join, if they are many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import fresh_path
from .importance import packed, unpacked
from .ranks import numbered

#: Words of a block; frequent pairs that every task may hold.
BLOCK_WORDS, HELD_PAIRS = 1_000_000, 2_000_000
#: Parts in which a language's best phrases are found before they meet.
PARTS = 64
#: A-Z become a-z, ends of pieces a line feed, tabs a space.
TO_PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def word_lists(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(block, langs, words, counts, lists), a row for each block: its words with their languages, lengths and position lists.

    Positions rise by one within a piece and by two at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = 0
        numbers: dict[tuple[str, bytes], int] = {}
        by_lang: dict[str, dict[bytes, int]] = {}
        parts: list[np.ndarray] = []
        size = 0

        class Numbers(dict):
            """The words of one language; a new one gets the block's next number."""

            def __init__(self, lang: str) -> None:
                super().__init__({b"": -2, b"\n": -1})
                self.lang = lang

            def __missing__(self, word: bytes) -> int:
                n = self[word] = numbers[self.lang, word] = len(numbers)
                return n

        def close() -> pa.RecordBatch:
            nonlocal numbers, by_lang, parts, size, made
            own = np.concatenate(parts)
            there = own >= 0
            # A break between pieces takes a place of its own.
            position = np.cumsum(there | (np.append(0, own[:-1]) >= 0), dtype=np.int32)[there]
            order = np.argsort(own[there], kind="stable")
            counts = np.bincount(own[there], minlength=len(numbers))
            position = position[order]
            start = np.cumsum(counts) - counts
            gap = np.diff(position, prepend=0)
            gap[start] = position[start]
            block = TaskContext.get().partitionId() << 24 | made
            made += 1
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([block]),
                    pa.array([[k[0] for k in numbers]], pa.list_(pa.string())),
                    pa.array([[k[1].decode() for k in numbers]], pa.list_(pa.string())),
                    pa.array([counts], pa.list_(pa.int64())),
                    pa.array([packed(counts.astype(np.uint32), gap.astype(np.uint32))], pa.binary()),
                ],
                names=["block", "langs", "words", "counts", "lists"],
            )
            numbers, by_lang, parts, size = {}, {}, [], 0
            return row

        for b in batches:
            text = b.column(1).cast(pa.large_binary() if pa.types.is_large_string(b.column(1).type) else pa.binary())
            for lang, t in zip(b.column(0).to_pylist(), text):
                rest, a = t.as_py().translate(TO_PIECES), 0
                while a < len(rest):
                    # Long texts go on in the next block after the end of a piece, if they have one.
                    z = rest.find(b"\n", a + BLOCK_WORDS)
                    z = len(rest) if z < 0 else z
                    own = by_lang.get(lang) or by_lang.setdefault(lang, Numbers(lang))
                    words = rest[a:z].replace(b"\n", b" \n ").split(b" ")
                    x = np.fromiter(map(own.__getitem__, words), dtype=np.int32, count=len(words))
                    parts.append(np.append(x[x != -2], np.int32(-1)))
                    size += len(words)
                    a = z
                    if size >= BLOCK_WORDS:
                        if numbers:
                            yield close()
                        parts, size = [], 0
        if numbers:
            yield close()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return rows.mapInArrow(run, "block long, langs array<string>, words array<string>, counts array<long>, lists binary")


def with_marks(marks: DataFrame, lists: DataFrame) -> DataFrame:
    """(block, lists, marks): beside each block's lists its marks (own, number), sorted and packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            blocks, lists_ = b.column(0).to_numpy(), b.column(1)
            own, ids = (b.column(c).fill_null(-1).to_numpy() for c in (2, 3))
            a = 0
            # A block's marks end with the row of its lists.
            for e in [*np.flatnonzero(np.asarray(lists_.is_valid())).tolist(), b.num_rows]:
                if e > a:
                    at, held = blocks[a], [*(held if at == blocks[a] else []), (own[a:e].copy(), ids[a:e].copy())]
                if e == b.num_rows:
                    break
                held = held if at == blocks[e] else []
                x, y = (np.concatenate(z) for z in zip(*held)) if held else (np.zeros(0, dtype=np.int64),) * 2
                o = np.argsort(x, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array([blocks[e]]), pa.array([lists_[e].as_py()], pa.binary()), pa.array([packed(x[o], y[o])], pa.binary())], names=["block", "lists", "marks"])
                at, held, a = None, [], e + 1

    a = marks.select("block", F.lit(None).cast("binary").alias("lists"), "own", "number")
    b = lists.select("block", "lists", F.lit(None).cast("long").alias("own"), F.lit(None).cast("long").alias("number"))
    both = a.unionByName(b).repartition("block").sortWithinPartitions("block", F.col("lists").isNotNull())
    return both.mapInArrow(run, "block long, lists binary, marks binary")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, word, position, own, number) of each block: its words in order of position, and its marks by ``own``."""
    for b in batches:
        for block, lists, marks in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            counts, gap = unpacked(lists.as_py(), np.uint32, np.uint32)
            counts = counts.astype(np.int64)
            start = np.cumsum(counts) - counts
            # Each list starts anew; sums of all gaps may wrap and their differences come out right.
            position = np.cumsum(gap, dtype=np.uint32)
            position -= np.repeat(np.append(np.uint32(0), position)[start], counts)
            order = np.argsort(position, kind="stable")
            yield block, np.repeat(np.arange(len(counts), dtype=np.int32), counts)[order], position[order], *unpacked(marks.as_py(), np.int64, np.int64)


def found(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in a sorted array, -1 where it has none."""
    if not len(sorted_):
        return np.full(len(x), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


def neighbours(word: np.ndarray, position: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, code) of each place whose word and next word are marked and adjoin; the code holds both words' numbers in the block."""
    marked = found(own, np.arange(int(word.max()) + 1)) >= 0
    place = np.flatnonzero((position[1:] == position[:-1] + 1) & marked[word[1:]] & marked[word[:-1]])
    return place, word[place].astype(np.int64) << 32 | word[place + 1]


def pair_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left, right, n): the pairs of adjoining frequent words of each block and the lengths of their lists."""
    for _, word, position, own, ids in opened(batches):
        code, n = np.unique(neighbours(word, position, own)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids[found(own, code >> 32)]), pa.array(ids[found(own, code & 0xFFFFFFFF)]), pa.array(n)], names=["left", "right", "n"])


def pair_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left, right, block, own): the pairs of adjoining frequent words of each block, and their code there."""
    for block, word, position, own, ids in opened(batches):
        code = np.unique(neighbours(word, position, own)[1])
        yield pa.RecordBatch.from_arrays([pa.array(ids[found(own, code >> 32)]), pa.array(ids[found(own, code & 0xFFFFFFFF)]), pa.array(np.full(len(code), block)), pa.array(code)], names=["left", "right", "block", "own"])


def triples_of(place: np.ndarray, pair: np.ndarray) -> pa.RecordBatch:
    """(left, right, n): how often two pairs of these ids overlap in a word, from the pairs' places."""
    both = np.flatnonzero(place[1:] == place[:-1] + 1)
    ids, at = np.unique(pair, return_inverse=True)
    code, n = np.unique(at[both].astype(np.int64) << 32 | at[both + 1], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(ids[code >> 32]), pa.array(ids[code & 0xFFFFFFFF]), pa.array(n)], names=["left", "right", "n"])


def triple_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(left, right, n): the triples of each block that two frequent pairs make, by these; the marks are those of pairs."""
    for _, word, position, own, ids in opened(batches):
        near = np.flatnonzero(position[1:] == position[:-1] + 1)
        at = found(own, word[near].astype(np.int64) << 32 | word[near + 1])
        yield triples_of(near[at >= 0], ids[at[at >= 0]])


def triple_lengths_of(left: np.ndarray, right: np.ndarray, number: np.ndarray):
    """The same where the marks are those of words and all frequent pairs are held, sorted."""
    heads, tails = np.unique(left), np.unique(right)
    codes = np.searchsorted(heads, left) << 32 | np.searchsorted(tails, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, word, position, own, ids in opened(batches):
            place, code = neighbours(word, position, own)
            code, at = np.unique(code, return_inverse=True)
            x, y = found(heads, ids[found(own, code >> 32)]), found(tails, ids[found(own, code & 0xFFFFFFFF)])
            pair = np.where((x >= 0) & (y >= 0), found(codes, x << 32 | y), -1)[at]
            yield triples_of(place[pair >= 0], number[pair[pair >= 0]])

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, cover_percent: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two and three words.

    Texts, A-Z lower-cased, are split into pieces at ``.,;:!?`` and line ends and these into
    words at spaces and tabs; phrases do not leave a piece. A phrase with a occurrences, at
    least ``least``, cut into parts with l and r of them has the score
    floor(1,000,000 a a / (l r)); its worst cut counts, the first on ties. Phrases inside a
    longer one that has ``cover_percent`` of their occurrences go. n is the number of words of
    the language. Ranks follow score, a (both falling) and phrase (bytes). A null language is
    ``und``; null and empty texts have no words; every row counts, repeated ones too; an empty
    table gives none. Further columns are not read.
    """
    spark = docs.sparkSession
    blocks = written(word_lists(docs, lang_col, text_col), "lists")
    lists = blocks.select("block", "lists")
    entries = blocks.select("block", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("own", "e"))
    entries = entries.select(F.col("e.langs").alias("lang"), F.col("e.words").alias("word"), "block", F.col("own").cast("long").alias("own"), F.col("e.counts").alias("n"))
    totals = entries.groupBy("lang").agg(F.sum("n").alias("n"))
    # One row for each block that has the word.
    entries = entries.withColumn("f", F.sum("n").over(W.partitionBy("lang", "word"))).where(F.col("f") >= least).drop("n")
    entries = written(entries, "words")
    words = numbered(entries.select("lang", "word", "f").distinct(), "number")
    marks = entries.join(words.select("lang", "word", "number"), ["lang", "word"]).select("block", "own", "number")
    marked = written(with_marks(marks, lists), "marked")
    pairs = marked.mapInArrow(pair_lengths, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    pairs = numbered(pairs, "number")
    if pairs.count() <= HELD_PAIRS:
        held = pairs.select("left", "right", "number").toArrow()
        left, right, number = (held.column(c).to_numpy() for c in ("left", "right", "number"))
        order = np.lexsort((right, left))
        sent = spark.sparkContext.broadcast((left[order], right[order], number[order]))
        lengths = marked.mapInArrow(lambda batches: triple_lengths_of(*sent.value)(batches), "left long, right long, n long")
    else:
        places = marked.mapInArrow(pair_places, "left long, right long, block long, own long")
        lengths = with_marks(places.join(pairs.select("left", "right", "number"), ["left", "right"]), lists).mapInArrow(triple_lengths, "left long, right long, n long")
    triples = lengths.groupBy("left", "right").agg(F.sum("n").alias("a")).where(F.col("a") >= least)

    def side(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.select(F.col("number").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    pairs = pairs.join(side(words, "left", "lang", "word", "f"), "left").join(side(words, "right", "word", "f"), "right")
    pairs = written(pairs.select("number", F.col("left_lang").alias("lang"), F.col("left_word").alias("first"), F.col("right_word").alias("last"), F.col("left_f").alias("l"), F.col("right_f").alias("r"), "f"), "pair-words")
    triples = triples.join(side(pairs, "left", "lang", "first", "last", "l", "f"), "left").join(side(pairs, "right", "last", "r", "f"), "right")
    triples = written(triples, "triples")

    def score(l: str, r: str):
        return F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST({l} AS DECIMAL(19,0)) * CAST({r} AS DECIMAL(19,0)))")

    cover = triples.select(F.col("left").alias("number"), "a").unionByName(triples.select(F.col("right").alias("number"), "a")).groupBy("number").agg(F.max("a").alias("longer"))
    two = pairs.withColumnRenamed("f", "a").join(cover, "number", "left").where(100 * F.coalesce("longer", F.lit(0)) < cover_percent * F.col("a"))
    two = two.select("lang", F.concat_ws(" ", "first", "last").alias("phrase"), "a", "l", "r", score("l", "r").alias("score"))
    cuts = [F.struct(score(l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")) for k, l, r in ((1, "left_l", "right_f"), (2, "left_f", "right_r"))]
    three = triples.withColumn("cut", F.least(*cuts))
    three = three.select(F.col("left_lang").alias("lang"), F.concat_ws(" ", "left_first", "left_last", "right_last").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    every = two.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))

    # Only the best of each part meet.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = every.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
