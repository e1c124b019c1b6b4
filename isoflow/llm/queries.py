"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_count, chat, collocations, decontam, embed_neardup, html_extract, importance, langid, mixing, secrets, simhash, sstable, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_neardup.embedding_near_dups(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dups(table(spark, sf_dir, "documents"), words=4, bits=4)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=1024)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), max_epochs=3.0, seed=42)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # A conversation whose texts hold the template's own strings.
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")
    )
    return chat.chat_digests(rows.unionByName(more), budget=512, history_turns=2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    base = F.filter("spans", lambda s: s["kind"] != "value")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, top=2000, cover_percent=50)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, buckets=10_000, longest=3, seed=42)
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dups": op1_embedding_near_dups,
    "op2_simhash": op2_simhash,
    "op3_token_counts": op3_token_counts,
    "op4_html_text": op4_html_text,
    "op5_mix_sources": op5_mix_sources,
    "op6_decontaminate": op6_decontaminate,
    "op7_chat_windows": op7_chat_windows,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_token_shards": op10_token_shards,
    "op11_secrets": op11_secrets,
    "op12_collocations": op12_collocations,
    "op13_importance": op13_importance,
}

ORACLE: dict[str, str] = {
    "op1_embedding_near_dups": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), r(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a, count(*) AS n_links FROM p GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
""",
    "op5_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), k AS (
  SELECT *, md5('42:' || coalesce(doc_id::VARCHAR, 'null')) || ':' || coalesce(doc_id::VARCHAR, 'null') || ':' || size AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM k GROUP BY source
), c AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap FROM s
), o AS (
  SELECT *, row_number() OVER w AS place, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before,
    sum(weight) OVER () AS weight_all, (sum(source_size) OVER ())::DOUBLE AS share_all
  FROM c WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)
), l AS (
  SELECT *, (share_all - cap_before) / (weight_all - weight_before)::DOUBLE AS level FROM o
), f AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE cap > level * weight ORDER BY place LIMIT 1) * weight, cap)) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM f
), r AS (
  SELECT *, floor(target)::BIGINT - whole * source_size AS rest FROM e
), n AS (
  SELECT source, key, sum(size)::BIGINT AS same_size, count(*) AS same,
    coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k GROUP BY source, key
)
SELECT k.doc_id, k.size, r.source_size, r.target,
  r.whole * k.size + CASE WHEN n.before + n.same_size <= r.rest THEN k.size WHEN n.before <= r.rest THEN (r.rest - n.before) // n.same ELSE 0 END AS taken
FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source JOIN n ON k.source IS NOT DISTINCT FROM n.source AND k.key = n.key
""",
    "op6_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda p: array_to_string(w[p : p + 9], ' '))) AS g FROM b WHERE len(w) > 0
), x AS (
  SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n
), m AS (
  SELECT x.r, x.p, x.n, i.item FROM x JOIN i ON x.n = i.n AND array_to_string(x.w[x.p : x.p + x.n - 1], ' ') = i.g
), h AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r
), t AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
""",
    "op12_collocations": r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), p AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t
), o AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0
), u AS (
  SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, len(w) - i AS more FROM o
), f1 AS (
  SELECT lang, a, count(*) AS f FROM u GROUP BY ALL
), f2 AS (
  SELECT lang, a, b, count(*) AS f FROM u WHERE more >= 1 GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, a, b, c, count(*) AS f FROM u WHERE more >= 2 GROUP BY ALL HAVING count(*) >= 10
), s2 AS (
  SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.a = f2.a JOIN f1 y ON y.lang = f2.lang AND y.a = f2.b
  WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND (f3.a = f2.a AND f3.b = f2.b OR f3.b = f2.a AND f3.c = f2.b) AND 100 * f3.f >= 50 * f2.f)
), s3 AS (
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c AS phrase, f3.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.a = f3.a JOIN f2 y ON y.lang = f3.lang AND y.a = f3.b AND y.b = f3.c
  UNION ALL
  SELECT f3.lang, f3.a || ' ' || f3.b || ' ' || f3.c AS phrase, f3.f AS a, x.f AS l, y.f AS r, 2 AS k
  FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.a = f3.a AND x.b = f3.b JOIN f1 y ON y.lang = f3.lang AND y.a = f3.c
), s AS (
  SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM (SELECT * FROM s2 UNION ALL SELECT * FROM s3)
), c AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), n AS (
  SELECT lang, count(*) AS n FROM u GROUP BY lang
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM c JOIN n USING (lang) QUALIFY rank <= 2000
""",
    "op13_importance": r"""
WITH tab AS (
  SELECT list_transform(range(0, 16), lambda i: list_reduce([i, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS t
), src AS (
  SELECT doc_id, true AS own, text FROM documents UNION ALL SELECT NULL, false, text FROM benchmark
), w AS (
  SELECT row_number() OVER () AS r, doc_id, own, coalesce(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS w FROM src
), i AS (
  SELECT r, own, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0
), f AS (
  SELECT r, own, w[i] AS f FROM i
  UNION ALL SELECT r, own, w[i] || ' ' || w[i + 1] FROM i WHERE i + 1 <= len(w)
  UNION ALL SELECT r, own, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM i WHERE i + 2 <= len(w)
), g AS (
  SELECT r, own, f, count(*) AS n FROM f GROUP BY ALL
), h AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM g)
), c AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h)), lambda k: strpos('0123456789ABCDEF', substr(h, k // 2 * 2 + 2 - k % 2, 1)) - 1)), lambda s, x: xor(t[(xor(s, x) & 15) + 1], s >> 4)), 4294967295) % 10000 AS b FROM h, tab
), p AS (
  SELECT r, own, b, sum(n) AS n FROM g JOIN c USING (f) GROUP BY ALL
), k AS (
  SELECT b, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM p GROUP BY b
), gain AS (
  SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM k) + 10000) / ((s + 1) * ((SELECT sum(t) FROM k) + 10000))))::BIGINT AS gain FROM k
), d AS (
  SELECT r, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n FROM p JOIN gain USING (b) WHERE own GROUP BY r
), s AS (
  SELECT w.r, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    list_reduce(list_transform(range(1, 9), lambda k: strpos('0123456789abcdef', substr(sha256('42:' || coalesce(doc_id::VARCHAR, 'null')), k, 1)) - 1), lambda a, x: a * 16 + x) AS h
  FROM w LEFT JOIN d ON d.r = w.r WHERE own
), o AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM s
), q AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place FROM o WHERE words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM q) THEN place END AS rank FROM o LEFT JOIN q ON q.r = o.r
""",
    "op7_chat_windows": r"""
WITH RECURSIVE src AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS n, ceil(length(text) / 4)::BIGINT + 4 AS cost,
    length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) AS body,
    CASE WHEN role IS NULL THEN 2 ELSE length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '<', '')) + length(role) - length(replace(role, '>', '')) END AS tag
  FROM src
), t AS (
  SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY n) AS upto, 12 + length(n::VARCHAR) + tag + body + 8 AS chars,
    lag(cost, 1) OVER w AS cost1, lag(cost, 2) OVER w AS cost2,
    max(CASE WHEN n = 1 AND role = 'system' THEN cost END) OVER (PARTITION BY conv_id) AS system
  FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY n)
), h AS (
  SELECT *, CASE WHEN n - 1 > (system IS NOT NULL)::INT AND cost1 <= 128 THEN 1 + (n - 2 > (system IS NOT NULL)::INT AND cost1 + cost2 <= 128)::INT ELSE 0 END AS h FROM t
), k AS (
  SELECT *, CASE h WHEN 0 THEN 0 WHEN 1 THEN cost1 ELSE cost1 + cost2 END AS kept FROM h
), f AS (
  SELECT * REPLACE (CASE WHEN cost + kept + coalesce(system, 0) <= 512 THEN h ELSE 0 END AS h, CASE WHEN cost + kept + coalesce(system, 0) <= 512 THEN kept ELSE 0 END AS kept) FROM k
), r(conv_id, n, base, room, fresh) AS (
  SELECT conv_id, 1::BIGINT, 0::BIGINT, 512::BIGINT, false FROM f WHERE n = 1
  UNION ALL
  SELECT r.conv_id, f.n, CASE WHEN f.upto - r.base > r.room THEN f.upto - f.cost ELSE r.base END::BIGINT,
    CASE WHEN f.upto - r.base > r.room THEN 512 - coalesce(f.system, 0) - f.kept ELSE r.room END::BIGINT, f.upto - r.base > r.room
  FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.n = r.n + 1
), again AS (
  SELECT f.conv_id, f.h, f.n, f.system FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.n = r.n WHERE fresh
), old AS (
  SELECT a.conv_id, sum(t.chars) AS chars FROM again a JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id AND (t.n >= a.n - a.h AND t.n < a.n OR t.n = 1 AND a.system IS NOT NULL) GROUP BY a.conv_id
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY n) AS told,
    coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars
  FROM t GROUP BY conv_id
)
SELECT g.conv_id, n_turns, sha256(told) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (g.chars + coalesce(old.chars, 0))::BIGINT AS formatted_chars
FROM g LEFT JOIN old ON old.conv_id IS NOT DISTINCT FROM g.conv_id
""",
}
