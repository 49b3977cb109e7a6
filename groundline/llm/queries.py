"""Queries of this subpackage, each over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm import bpe, clusters, common, html, language, media, neardup, packing, pii, quality, resample, toxicity, urls, warc


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(common.read(spark, sf_dir, "documents"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.score(common.read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.read(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(common.read(spark, sf_dir, "documents"), digest=True)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(common.read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups(common.read(spark, sf_dir, "documents"), percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(common.read(spark, sf_dir, "pages"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(common.read(spark, sf_dir, "pages"))


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.encode(common.read(spark, sf_dir, "documents")))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(common.read(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.read(spark, sf_dir, "pages"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_language_model, op3_quality, op4_bpe, op5_pii, op6_toxicity, op7_neardup, op8_url_filter, op9_html, op10_ogg, op11_clusters, op12_warc, op13_resample)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = ", ".join(f"('{v}', '{r}', '{urls.split_rule(r)[0]}', '{urls.split_rule(r)[1]}')" for v, r in urls.RULES)
_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"

URL_SQL = f"""
WITH p AS (
  SELECT page_id, n, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, row_number() OVER () AS n, coalesce({_REST}, '') AS rest FROM pages)
), r(verdict, rule, h, start) AS (VALUES {_RULES})
SELECT page_id, host, path, rule, coalesce(verdict, '{urls.DEFAULT}') AS verdict FROM (
  SELECT p.*, r.rule, r.verdict, row_number() OVER (PARTITION BY n ORDER BY length(r.rule) DESC NULLS LAST, length(r.h) DESC) AS k
  FROM p LEFT JOIN r ON host <> '' AND (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.start)
) WHERE k = 1"""

NEARDUP_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w
), g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, y.b FROM reach r JOIN sym y ON r.b = y.a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM (
  SELECT s.doc_id, any_value(len(sh)) AS n, least(s.doc_id, coalesce(min(b), s.doc_id)) AS component_id FROM s LEFT JOIN reach ON s.doc_id = reach.a GROUP BY s.doc_id
)"""



def cluster_sql(k: int = clusters.CENTROIDS, rounds: int = clusters.ROUNDS, dim: int = clusters.DIM, scale: int = clusters.SCALE, seed: int = clusters.SEED) -> str:
    """Lloyd's rounds one after another, each vector by itself, without any grouping of equal ones."""
    near = "min(struct_pack(d := list_sum(list_transform(list_zip(r.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c := c.cluster))"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r.n, any_value(r.vec_id) AS vec_id, any_value(r.v) AS v, {near} AS best FROM kept r, c{i} c GROUP BY r.n)")
        if i < rounds:
            steps.append(f"s{i} AS MATERIALIZED (SELECT cluster, list((t - ((t % m) + m) % m) // m ORDER BY j) AS v FROM (SELECT best.c AS cluster, j, sum(v[j])::BIGINT AS t, count(*) AS m FROM a{i}, range(1, {dim + 1}) x(j) GROUP BY best.c, j) GROUP BY cluster)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(s.v, c.v) AS v FROM c{i} c LEFT JOIN s{i} s USING (cluster))")
    return f"WITH {', '.join(steps)} SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.best.c = c.cluster"


WARC_SQL = f"""
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN head END AS refers_to FROM (
  SELECT page_id, h, CASE WHEN strlen(h) >= {warc.LEAST_REVISIT} THEN row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) ELSE 1 END AS k, max(page_id) OVER (PARTITION BY h) AS head
  FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))"""

_RESAMPLE_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
RESAMPLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, {_RESAMPLE_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT {_RESAMPLE_WORDS} AS w FROM benchmark),
f AS MATERIALIZED (SELECT n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM d),
g AS MATERIALIZED (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM b),
steps AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
x AS MATERIALIZED (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM f UNION SELECT x FROM g)),
k AS MATERIALIZED (SELECT x, xor(list_reduce(range(1, len(h), 2), lambda a, i: xor(t[(xor(a, ('0x' || h[i:i + 1])::BIGINT) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT) % {resample.BUCKETS} AS bucket FROM x, steps),
fk AS MATERIALIZED (SELECT n, bucket FROM f JOIN k USING (x)),
s AS (SELECT bucket, count(*) AS s FROM fk GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM g JOIN k USING (x) GROUP BY bucket),
gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM f) + {resample.BUCKETS}) / ((s + 1) * ((SELECT count(*) FROM g) + {resample.BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT n, count(*) AS n_features, sum(gain)::BIGINT AS total FROM fk JOIN gain USING (bucket) GROUP BY n),
scored AS MATERIALIZED (SELECT doc_id, len(d.w) AS words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight, ('0x' || sha256('{resample.SEED}:' || doc_id)[1:8])::BIGINT AS h FROM d LEFT JOIN w USING (n)),
p AS MATERIALIZED (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored),
able AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, n_features, weight) AS rank FROM p WHERE words >= {resample.LEAST_WORDS} AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {resample.PERCENT} * (SELECT count(*) FROM able) // 100 THEN rank END AS rank FROM able
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM p WHERE words < {resample.LEAST_WORDS} OR score IS NULL"""

ORACLE_SQL: dict[str, str] = {"op7_neardup": NEARDUP_SQL, "op8_url_filter": URL_SQL, "op11_clusters": cluster_sql(), "op12_warc": WARC_SQL, "op13_resample": RESAMPLE_SQL}
