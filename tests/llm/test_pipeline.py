"""The corpus pipeline and its near-copy stage against brute force."""

import hashlib
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isoflow.llm import langid, near_copies, sstable
from isoflow.llm.common import shuffles_dropped

DOC = "doc_id long, text string, lang string, source string, n_chars int"


def shingles(text, words=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def jaccard(p, q):
    return len(p & q) / len(p | q) if p | q else 1.0


def groups(texts):
    """Least place reachable over all pairs of similarity 0.8."""
    sets = [shingles(t) for t in texts]
    near = np.array([[jaccard(p, q) >= 0.8 for q in sets] for p in sets])
    comp = np.arange(len(texts))
    while True:
        new = np.array([comp[n].min() for n in near])
        if (new == comp).all():
            return comp
        comp = new


def corpus():
    """Texts of random words, edited copies on both sides of similarity 0.8, exact copies."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for i in range(40):
        t = list(rng.choice(words, 120))
        texts.append(" ".join(t))
        for k in range(i % 5):
            for at in rng.choice(120, k, replace=False):
                t[at] = "edit"
            texts.append(" ".join(t))
    return texts + [texts[0].upper(), texts[3], "one two", "one two", "one", "w1 w2 w3 w4 w5 w6"]


def rows_of(texts):
    rows = [(None if i % 7 == 3 else i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    # Repeated rows, a repeated id with another text, and a text with an id and without.
    return rows + rows[:5] + rows[:1] + [(1, "other words under the same id as the second text", "en", "a", 9), (None, texts[-1], "en", "a", 9)]


def kept(rows):
    comp = groups([r[1] for r in rows])
    best = {}
    for c, r in zip(comp, rows):
        key = (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest(), r)
        best[c] = min(best.get(c, key), key)
    return sorted((str(b[3][0]), b[3][1]) for b in best.values())


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_repeated(size):
    s = np.sort(np.random.default_rng(size).integers(0, 30, 50))
    batches = [pa.RecordBatch.from_arrays([pa.array(s[a : a + size]), pa.array(np.arange(a, min(a + size, 50)))], names=["s", "key"]) for a in range(0, 50, size)]
    got = [k for b in near_copies.repeated(iter(batches)) for k in b.column(1).to_pylist()]
    assert got == [i for i in range(50) if (s == s[i]).sum() > 1]


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_repeated_rows_count_once(size):
    s, key = np.array([1, 1, 1, 2, 2, 3, 3, 3, 4, 5, 5]), np.array([7, 7, 7, 1, 2, 4, 4, 5, 6, 8, 8])
    batches = [pa.RecordBatch.from_arrays([pa.array(s[a : a + size]), pa.array(key[a : a + size])], names=["s", "key"]) for a in range(0, len(s), size)]
    got = [tuple(r.values()) for b in near_copies.repeated(iter(batches)) for r in b.to_pylist()]
    assert got == [(2, 1), (2, 2), (3, 4), (3, 5)]


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(500):
        x = np.unique(rng.integers(0, 2**63, rng.integers(0, 400)).astype(np.uint64))
        shared = rng.permutation(x)[: rng.integers(0, len(x) + 1)]
        y = np.unique(np.append(shared, rng.integers(0, 2**63, rng.integers(0, 200)).astype(np.uint64)))
        found = near_copies.least_difference(near_copies.parity_bitmap(x), near_copies.parity_bitmap(y))
        assert found <= len(np.setxor1d(x, y))


def test_partnered_loses_no_pair():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 260).astype(np.uint64))
    sets = [np.unique(np.append(base[: rng.integers(120, 260)], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64))) for _ in range(80)]
    sets += [np.zeros(0, dtype=np.uint64)] * 2
    group = rng.integers(0, 30, len(sets))
    got = near_copies.partnered(np.array([len(x) for x in sets]), group, [near_copies.parity_bitmap(x) for x in sets], 0.8)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if group[i] != group[j] and jaccard(set(x), set(y)) >= 0.8:
                assert got[i] and got[j]


@pytest.mark.parametrize("longest, cell", [(near_copies.LIST_ROWS, near_copies.CELL_ROWS), (1, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, longest, cell):
    monkeypatch.setattr(near_copies, "LIST_ROWS", longest)
    monkeypatch.setattr(near_copies, "CELL_ROWS", cell)
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r.group for r in near_copies.near_copy_groups(df).collect()}
    comp = groups(texts)
    assert len(got) == len(texts) and len(set(comp)) < 100
    assert len({(got[i], c) for i, c in enumerate(comp)}) == len(set(comp)) == len(set(got.values()))


@pytest.mark.parametrize("common", [2, near_copies.COMMON])
def test_near_copies_equal_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(near_copies, "COMMON", common)
    rows = rows_of(corpus())
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOC), "")
    assert got.columns == [c.split()[0] for c in DOC.split(", ")]
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == kept(rows)
    assert corpus_pipeline.drop_near_duplicates(spark, got.limit(0), "").count() == 0


def test_run(spark, tmp_path):
    rows = rows_of(corpus())
    spark.createDataFrame([*rows, (900, None, "en", "a", 0), (901, "12 3", "en", "a", 0)], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # With one source every kept row is taken once.
    got = corpus_pipeline.run(spark, str(tmp_path)).select(F.col("doc_id").cast("string").alias("i")).collect()
    assert sorted(r.i or "None" for r in got) == sorted(i for i, _ in kept(rows))


def test_language_stage_without_a_model_keeps_clean_texts(spark):
    rows = [(i, t, None, "a", 0) for i, t in enumerate(["clean words", "ünd", None, "", "12 --", "_"])]
    got = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, DOC), "")
    assert got.columns == [c.split()[0] for c in DOC.split(", ")] and sorted(r.doc_id for r in got.collect()) == [0, 1]


def test_language_sample_takes_an_id_once(spark, monkeypatch):
    rows = [(i, f"some words {i}", "en") for i in range(1, 30)] + [(1, f"other words {i}", "en") for i in range(300)]
    seen = []
    monkeypatch.setattr(langid, "marks_of", lambda present, f=langid.marks_of: (seen.append(len(present)), f(present))[1])
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), landmarks=100)
    assert seen and seen[0] <= 29


def test_language_fills_nulls(spark):
    rows = [(i, f"the words of text {i} are these", "en", "a", 1) for i in range(40)] + [(50 + i, f"der die das und {i} nicht", "de", "a", 1) for i in range(40)]
    rows += [(100, "the words are of these", None, "a", 1), (None, "der und das", None, None, None), (None, None, None, None, None), (102, " ", "en", "a", 1)]
    got = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, DOC), "").where("doc_id IS NULL OR doc_id >= 100").collect()
    assert sorted((str(r.doc_id), r.lang) for r in got) == [("100", "en"), ("None", "de")]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_of_any_name(spark, tmp_path, name, stage):
    odd = ["a.b", "my col", "_id", "_hash", "_kept", "_text", "row", "id", "h", "key", "s", "size", "hash", "text_hash", "lang_pred", "own_id"]
    spark.createDataFrame([(1, "no such words in any of the texts of this small table")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, f"some text of its own {i} with words {i * 7} and more", "en", "a", 3) for i in range(8)] + [(None, "a text without an id", None, None, None)]
    docs = spark.createDataFrame(rows, DOC)
    docs = docs.select("*", *(F.lit(c).alias(c) for c in odd))
    docs = docs.unionByName(docs.where("doc_id = 3"))
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    # The source without a name is repeated three times, the other loses what that takes.
    assert got.count() == {"simhash_dedup": 9, "mix_sources": 12}.get(name, 10)
    assert {r["a.b"] for r in got.collect()} == {"a.b"}
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_similar_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30, 25)) for _ in range(40)] + [np.array([99]), np.array([99]), np.arange(1000, 4000), np.arange(1100, 4000)]
    i, j = near_copies.similar(sets, 0.8)
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if jaccard(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8}
    assert set(zip(i.tolist(), j.tolist())) == want and (40, 41) in want


def test_dedup_shuffles_whole_rows_once(spark, capsys):
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows_of(["one two three", "four"]), DOC), "")
    capsys.readouterr()
    out.explain("formatted")
    found = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out, re.M)
    assert sum("row#" in x for x in found) == 1


def test_shuffle_files_go_as_queries_end(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b for b in disk.getAllBlocks().mkString(",").split(",") if b.startswith("shuffle")}
    before = shuffles()
    with shuffles_dropped(spark):
        assert spark.range(1000).repartition(4, "id").groupBy(F.col("id") % 10).count().checkpoint().count() == 10
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_tokens_are_digested_where_they_are_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words {i} of text {i * i}", "en", "a", 9) for i in range(30)], DOC)
    shared = [sorted(map(tuple, sstable.token_digests(docs, public_tokenizers.path("word_bpe_49k.json"), path=f"file://{tmp_path}/{r}", remember=r).collect())) for r in (True, False)]
    assert shared[0] == shared[1] and len(shared[0]) == 30
    encoder = sstable.TextEncoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    first = encoder.encode(["some words"])
    encoder.forget()
    assert not encoder.young and not encoder.old and encoder.encode(["some words"]) == first
