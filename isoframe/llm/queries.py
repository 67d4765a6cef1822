"""The registered queries of the text operators and the SQL that states their results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm import clustering, decontam, filter_audit, html_main, ngram_join, packing, quality_model, quality_rules, sharding, suffix_dedup, token_counts, url_rules, warc
from isoframe.llm.common import scratch_dir, written

#: Fixed values of the URL contract: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_rules.RULES)
    return url_rules.match_rules(_table(spark, sf_dir, "pages"), rules)


OP1_SQL = """
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(h, q, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, host, path, h || q AS rule, v,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || q) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.window_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontam.contamination(hits).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
v AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS t
  FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM v),
x AS (
  SELECT k, s, n, array_to_string(w[s : s + n - 1], ' ') AS t
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(s)),
h AS (SELECT x.k, x.s, x.n, v.item_id FROM x JOIN v ON x.t = v.t AND x.n = v.n),
c AS (SELECT k, count(DISTINCT p) AS n_hit FROM h, unnest(range(s, s + n)) AS u(p) GROUP BY k),
g AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT k, item_id FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN g USING (k)
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    ratio = quality_rules.fit(docs, labels.where("quality = 1").select("doc_id"))
    rows = written(quality_rules.scored(docs, ratio), "scored")
    return quality_rules.judged(rows, quality_rules.threshold(rows, labels))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = warc.with_revisits(_table(spark, sf_dir, "pages"))
    index = written(warc.write_archives(rows, folder), "warc-index")
    return warc.read_archives(index, folder, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, _table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents")
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "row.doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_table(spark, sf_dir, "embeddings"))


def _op11_sql(clusters: int = 8, rounds: int = 10) -> str:
    """One step of assignment and one of means for each round, over one row for each component."""
    nearest = """a{k} AS MATERIALIZED (
  SELECT i, c, d FROM (SELECT i, c, d, row_number() OVER (PARTITION BY i ORDER BY d, c) AS p
    FROM (SELECT x.i, m.c, sum((x.v - m.v) * (x.v - m.v)) AS d FROM x JOIN m{k} AS m ON m.j = x.j GROUP BY x.i, m.c)) WHERE p = 1)"""
    means = """m{n} AS MATERIALIZED (
  SELECT m.c, m.j, coalesce(f.v, m.v) AS v FROM m{k} AS m LEFT JOIN (
    SELECT a.c, x.j, CAST((sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
    FROM a{k} AS a JOIN x ON x.i = a.i GROUP BY a.c, x.j) AS f ON f.c = m.c AND f.j = m.j)"""
    steps = [nearest.format(k=0)]
    for k in range(rounds):
        steps += [means.format(k=k, n=k + 1), nearest.format(k=k + 1)]
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda t: CAST(floor(1024 * t) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda t: t IS NULL OR NOT isfinite(t))) = 0),
x AS MATERIALIZED (SELECT i, unnest(range(1, 65)) AS j, unnest(v) AS v FROM k),
f AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM k QUALIFY c < {clusters}),
m0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS j, unnest(v) AS v FROM f),
{", ".join(steps)},
h AS (SELECT c, sha256(string_agg(v, ',' ORDER BY j)) AS s FROM m{rounds} GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS "cluster", CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, s AS centroid_sha256
FROM a{rounds} AS a JOIN k ON k.i = a.i JOIN h ON h.c = a.c
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS s,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
b AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(s, '[^A-Z]', '', 'g')) > 3 * length(s),
    regexp_matches(s, '[#$%&*|]'), coalesce(least < t.doc_id, false)] AS f, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
  FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM b GROUP BY part, f),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || u.x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(x) WHERE NOT contains(filter_order, u.x)),
g AS (SELECT filter_order, k AS step, strpos('ABCDE', filter_order[k]) AS i, [strpos('ABCDE', filter_order[j]) FOR j IN range(1, k)] AS past
  FROM o, unnest(range(1, 6)) AS u(k) WHERE length(filter_order) = 5),
e AS (SELECT part, filter_order, step, i, n, good, bad, f, f[i] AS fails, len(list_filter(past, lambda j: f[j])) > 0 AS gone FROM c, g),
r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, i,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (fails AND len(list_filter(f, lambda x: x)) = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(bad) FILTER (NOT gone AND fails), 0) AS toxic_lost
  FROM e GROUP BY part, filter_order, step, i)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, i) AS BIGINT) AS shapley
FROM r
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT k, md5(array_to_string(w[s : s + 4], ' ')) AS x
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(s) WHERE len(w) > 0),
n AS (SELECT k, count(*) AS n FROM sh GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM sh AS a JOIN sh AS b ON a.x = b.x AND a.k <> b.k GROUP BY a.k, b.k),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n AS x ON x.k = a JOIN n AS y ON y.k = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(k, j) AS (SELECT k, k FROM w UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.j)
SELECT w.doc_id AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM w LEFT JOIN n ON n.k = w.k JOIN r ON r.k = w.k JOIN w AS o ON o.k = r.j GROUP BY w.k, w.doc_id
"""


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top, row_number() OVER (PARTITION BY d ORDER BY page_id DESC NULLS LAST) AS k FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + (CAST('0x' || substr(d, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) % 32 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN k > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM g
"""


OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT k, s, md5(substr(h, 2 * s + 1, 400)) AS x FROM d, unnest(range(0, n - 199)) AS u(s)),
t AS (SELECT x FROM s GROUP BY x HAVING count(*) > 1),
v AS (SELECT k, s FROM s JOIN t ON s.x = t.x),
i AS (SELECT k, s, CASE WHEN s > lag(s) OVER (PARTITION BY k ORDER BY s) + 200 OR lag(s) OVER (PARTITION BY k ORDER BY s) IS NULL THEN 1 ELSE 0 END AS f FROM v),
m AS (SELECT k, min(s) AS a, max(s) + 200 AS b FROM (SELECT k, s, sum(f) OVER (PARTITION BY k ORDER BY s) AS g FROM i) GROUP BY k, g),
c AS (SELECT k, b AS a, coalesce(lead(a) OVER (PARTITION BY k ORDER BY b), 1000000000) AS b FROM (SELECT k, a, b FROM m UNION ALL SELECT k, 0, 0 FROM d)),
j AS (SELECT c.k AS k, string_agg(substr(h, CAST(2 * c.a + 1 AS BIGINT), CAST(2 * (least(c.b, n) - c.a) AS BIGINT)), '' ORDER BY c.a) AS kept FROM c JOIN d ON d.k = c.k WHERE c.a < n AND c.b > c.a GROUP BY c.k),
z AS (SELECT k, count(*) AS n_spans, sum(b - a) AS n_removed FROM m GROUP BY k)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN z ON z.k = d.k LEFT JOIN j ON j.k = d.k
"""


QUERIES = {
    "op1_url_rules": op1_url_rules,
    "op2_ngram_join": op2_ngram_join,
    "op3_sharding": op3_sharding,
    "op4_main_text": op4_main_text,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc": op7_warc,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_packing": op9_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_counts": op13_token_counts,
}
SQL = {
    "op1_url_rules": OP1_SQL,
    "op2_ngram_join": OP2_SQL,
    "op5_decontamination": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op10_suffix_dedup": OP10_SQL,
    "op11_centroid_clusters": _op11_sql(),
    "op12_filter_audit": OP12_SQL,
}
