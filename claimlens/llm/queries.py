"""Registered queries of the operators and, where SQL can express them, the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention, decontaminate, divergence, minhash, neighbours, packing, pii, quality, tiles, toxicity, url_filter, vafile, warc
from .common import table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), rules)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention.scored_texts(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def listed(condition: str):
        return F.expr(f"array_join(transform(filter(spans, s -> {condition}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")

    def count(kind: str):
        return F.expr(f"size(filter(spans, s -> s.base and s.kind = '{kind}'))").cast("long").alias(f"n_{kind}")

    found = pii.spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(listed("s.base").cast("binary"), 256).alias("base_sha256"),
                        listed("true").alias("spans"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vafile.clustered(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_clusters": op13_clusters,
    "op2_language_model": op2_language_model,
    "op9_neighbours": op9_neighbours,
    "op4_warc": op4_warc,
    "op7_toxicity": op7_toxicity,
    "op3_quality": op3_quality,
    "op8_pack": op8_pack,
    "op10_pii": op10_pii,
    "op1_minhash_dedup": op1_minhash_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_filter": op6_url_filter,
}

_URL_PARTS = r"""
SELECT page_id,
       translate(CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0) ELSE '' END,
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SOUND = "embedding IS NOT NULL AND len([e FOR e IN embedding IF e IS NULL OR isnan(e) OR isinf(e)]) = 0"


def _lloyd(rounds: int) -> str:
    """Rounds of assignment and exact means over (rid, vec_id, j, x); ``assigned`` is the last assignment."""
    parts = []
    for r in range(rounds + 1):
        name = "assigned" if r == rounds else f"a{r}"
        parts.append(f"""
{name} AS (SELECT rid, c AS cluster, d AS distance FROM (
    SELECT rid, c, sum((v.x - k.x) * (v.x - k.x))::BIGINT AS d, row_number() OVER (PARTITION BY rid ORDER BY sum((v.x - k.x) * (v.x - k.x)), c) AS place
    FROM v JOIN c{r} k USING (j) GROUP BY rid, c) WHERE place = 1)""")
        if r < rounds:
            parts.append(f"""
m{r} AS (SELECT cluster AS c, j, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN v USING (rid) GROUP BY 1, 2),
c{r + 1} AS (SELECT c, j, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} LEFT JOIN m{r} USING (c, j))""")
    return ",".join(parts)


ORACLE = {
    "op11_embedding_dedup": f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS x,
       coalesce({_SOUND} AND len([e FOR e IN embedding IF e <> 0]) > 0, false) AS usable FROM embeddings),
l AS (SELECT a.rid AS a, b.rid AS b FROM (SELECT * FROM e WHERE usable) a JOIN (SELECT * FROM e WHERE usable) b ON a.rid <> b.rid AND len(a.x) = len(b.x)
      WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r(a, b) AS (SELECT rid, rid FROM e UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT r.a AS rid, min(o.vec_id) AS component_id FROM r JOIN e o ON o.rid = r.b GROUP BY 1),
n AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN c USING (rid) LEFT JOIN n USING (rid)""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 3),
k AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN kept ON kept.lang = w.lang AND kept.term = w.term GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN k ON k.lang = g.lang AND k.source = g.source GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, kept.term, coalesce(k.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(k.n, 0) + 1)) // (total + v) AS p
      FROM gn JOIN kept ON kept.lang = gn.lang JOIN v ON v.lang = gn.lang LEFT JOIN k ON k.lang = gn.lang AND k.source = gn.source AND k.term = kept.term),
lt AS (SELECT lang, term, sum(n) AS n FROM k GROUP BY 1, 2),
ln AS (SELECT lang, sum(n) AS total FROM lt GROUP BY 1),
q AS (SELECT lt.lang, lt.term, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS q FROM lt JOIN ln ON ln.lang = lt.lang JOIN v ON v.lang = lt.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS f
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
WHERE part = 'pair' OR rank <= 200""",
    "op13_clusters": f"""
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, [floor(e::DOUBLE * 64)::BIGINT FOR e IN embedding] AS x FROM embeddings WHERE {_SOUND} AND len(embedding) = 64),
v AS (SELECT rid, unnest(range(64)) AS j, unnest(x) AS x FROM kept),
starts AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM kept WHERE vec_id IS NOT NULL QUALIFY c < 16),
c0 AS (SELECT c, unnest(range(64)) AS j, unnest(x) AS x FROM starts),{_lloyd(3)},
h AS (SELECT c AS cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c3 GROUP BY 1)
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM assigned JOIN kept USING (rid) JOIN h USING (cluster)""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT html, max(page_id) AS first_id FROM p WHERE strlen(html) >= 1000 GROUP BY html HAVING count(*) > 1),
r AS (SELECT page_id, p.html AS html, CASE WHEN page_id IS NULL OR page_id <> first_id THEN first_id END AS refers_to FROM p LEFT JOIN s ON s.html = p.html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r""",
    "op5_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT item_id, {_TERMS} AS w FROM benchmark WHERE item_id IS NOT NULL),
b2 AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM b2)),
dw AS (SELECT rid, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t
       FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM b2) WHERE len(w) >= n)),
hit AS (SELECT rid, s, dw.n AS n, item_id FROM dw JOIN win ON win.t = dw.t AND win.n = dw.n),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
hi AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)""",
    "op6_url_filter": f"""
WITH rules(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT row_number() OVER () AS rid, * FROM ({_URL_PARTS})),
m AS (SELECT rid, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
      FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, m.rule AS rule, coalesce(m.action, 'allow') AS verdict FROM u LEFT JOIN m ON m.rid = u.rid AND k = 1""",
}
