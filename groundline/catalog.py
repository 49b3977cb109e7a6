"""Registered queries of the library's own operators, and SQL for DuckDB with the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.functions import text as tx
from groundline.functions import vectors as vx
from groundline.operators import chunks, embed, guards, index, lists, pages, ranks, retrieve, rewrite, verify
from groundline.plans.answer import answer, status
from groundline.session import importable, kept, scratch, spread
from groundline.settings import DEFAULT, Settings
from groundline.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
URLS = (("elss", "https://example.com/elss"), ("large_cap", "https://example.com/large"))
SETTINGS = Settings(scheme_urls=URLS, embed_dim=64, allowed_schemes=("http", "https"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(importable(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def probes(spark: SparkSession, rows: tuple[tuple, ...], ddl: str) -> DataFrame:
    return spark.createDataFrame(list(rows), ddl)


def values(rows: tuple[tuple, ...], names: str) -> str:
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else quoted(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


# Vectors: those whose id is divisible by 50 are the stated query set of a search.

DIST = "round(1 - list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6)"
KNN = "SELECT q.vec_id AS query_id, i.vec_id, 1 - list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), i.vec_id) AS rank FROM embeddings q JOIN embeddings i ON {on}"


def vector_queries(spark: SparkSession, sf_dir: str, every: int = 50) -> tuple[DataFrame, DataFrame]:
    items = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return items.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id"), items


def nearest(spark: SparkSession, sf_dir: str, k: int = 5, filter_col: str | None = None, every: int = 50) -> DataFrame:
    asked, items = vector_queries(spark, sf_dir, every)
    return retrieve.top_k(asked, items, k, item_id="vec_id", filter_col=filter_col, exclude_self=True).withColumn("distance", F.round("distance", 6))


@query(f"SELECT i.vec_id, {DIST} AS distance FROM embeddings i, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE i.vec_id <> 0 ORDER BY 1 - list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), i.vec_id LIMIT 5")
def knn_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "embeddings")
    row = items.filter("vec_id = 0").select("embedding").first()
    if row is None:
        return items.limit(0).select("vec_id", F.lit(0.0).alias("distance"))
    vector = row[0]
    return retrieve.nearest_one(items, vector, 5, "vec_id", F.col("vec_id") != 0).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM ({KNN.format(on='q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id')}) WHERE rank <= 5")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir)


@query(f"SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM ({KNN.format(on='q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id AND q.label = i.label')}) WHERE rank <= 5")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir, filter_col="label")


@query()
def knn_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate index beside the exact search: of each question's five nearest how many it found, and what it read for them.

    These vectors have no clusters, so half of the lists are looked at; the codes are what spares the vectors.
    """
    asked, items = vector_queries(spark, sf_dir)
    quantiser = lists.fit(items, "vec_id")
    lists.write(items, path := scratch(spark, "lists"), quantiser, "vec_id", "label")
    opened = lists.open_lists(spark, path)
    found = lists.search(asked, opened, 5, probes=max(1, len(quantiser.centres) * 3 // 4), refine=9, item_id="vec_id", exclude_self=True)
    exact = retrieve.top_k(asked, items, 5, item_id="vec_id", exclude_self=True)
    told = found.groupBy("query_id").agg(F.max("codes_read").alias("codes_read"), F.max("vectors_read").alias("vectors_read"))
    return lists.recall(found, exact, item_id="vec_id").join(told, "query_id", "left")


GATE = "SELECT query_id, round({agg}(d), 6) AS gate_score, {agg}(d) <= 0.57 AS passes_gate FROM ({knn}) WHERE rank <= 5 GROUP BY query_id"


def gated(spark: SparkSession, sf_dir: str, aggregation: str) -> DataFrame:
    asked, items = vector_queries(spark, sf_dir)
    found = retrieve.top_k(asked, items, 5, item_id="vec_id", exclude_self=True)
    return retrieve.gate(asked, found, DEFAULT.max_distance, aggregation).withColumn("gate_score", F.round("gate_score", 6))


@query(GATE.format(agg="min", knn=KNN.format(on="q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id")))
def gate_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir, "min")


@query(GATE.format(agg="max", knn=KNN.format(on="q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id")))
def gate_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir, "max")


@query("SELECT count(*) AS n_rows, round(min(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS min_norm, round(max(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS max_norm FROM embeddings")
def vector_norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.norm_stats(read(spark, sf_dir, "embeddings"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 3) AS total FROM embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vx.l2_normalize(F.transform("embedding", lambda x: x * 3))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query("SELECT event_type, max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS latest, count(*) AS n FROM events GROUP BY event_type")
def latest_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(tx.latest_stamp(stamp).alias("latest"), F.count("*").alias("n"))


# Questions: turns of conversations and probes that hold what each class looks for.

DUAL = "SELECT q.vec_id - q.vec_id % 50 AS query_id, i.vec_id, min(1 - list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[])) AS d FROM embeddings q JOIN embeddings i ON q.vec_id % 50 < 2 AND i.vec_id % 50 >= 2 GROUP BY 1, 2"


@query(f"SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM ({DUAL})) WHERE rank <= 5")
def dual_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked in two forms (the vectors of an id divisible by 50 and of the next one), against the others: the best of both."""
    items = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    form = F.col("vec_id") % 50
    asked = items.filter(form < 2).select((F.col("vec_id") - form).alias("query_id"), form.alias("form"), "embedding")
    return retrieve.merged_top_k(asked, items.filter(form >= 2), 5, "form", item_id="vec_id").withColumn("distance", F.round("distance", 6))


PROBES = (
    (1, "Should I invest in the large cap fund?"), (2, "What is the exit load of the ELSS fund"), (3, "My PAN is ABCDE1234F"), (4, "call me on 9876543210"),
    (5, "What was the cagr last year"), (6, "Which gave more return"), (7, "minimum sip amount"), (8, "Will grow next year"), (9, "is it safe to use tax saver"),
    (10, "it says 'should i buy' there"), (11, "folio no. 12345678 status"), (12, "The otp is 4321"), (13, "a@b.co"), (14, "highest returns please"), (15, "small cap or large cap"),
    (16, "  Exit   LOAD  "), (17, ""), (18, None), (19, "lock in ter riskometer"), (20, "guaranteed double your money"), (21, "direct plan sip"), (22, "What is the lock in of elss tax saver"),
)
ASKED = f"(SELECT conv_id * 1000 + turn AS id, text AS question FROM conversations UNION ALL SELECT -id, question FROM {values(PROBES, 'id, question')})"
UNQUOTED = f"regexp_replace(coalesce(question, ''), {quoted(tx.QUOTED_SPAN)}, ' ', 'g')"
EITHER = lambda ps, text, flags="(?i)": "(" + " OR ".join(f"regexp_matches({text}, {quoted(flags + p)})" for p in ps) + ")"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"))
    return turns.unionByName(probes(spark, PROBES, "id long, question string").withColumn("id", -F.col("id")))


@query(f"SELECT id, {EITHER(guards.advice_patterns(), UNQUOTED)} AS advice FROM {ASKED}")
def guard_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without negation, which the oracle's expressions lack; negation is tested on its own."""
    return asked(spark, sf_dir).select("id", guards.is_advice(F.col("question"), negation=False).alias("advice"))


PII_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce(question, ''), {quoted(p)}) THEN '{n}' END" for n, p in guards.PII.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT id, array_to_string({PII_LIST}, ',') AS names FROM {ASKED}")
def guard_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", F.array_join(guards.pii_names(F.col("question")), ",").alias("names"))


@query(f"SELECT id, {EITHER(guards.PERFORMANCE, 'coalesce(question, ' + quoted('') + ')')} AS performance FROM {ASKED}")
def guard_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", guards.is_performance(F.col("question")).alias("performance"))


@query(f"SELECT id, {EITHER(guards.PROJECTION, UNQUOTED)} AS projection FROM {ASKED}")
def guard_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", guards.is_projection(F.col("question")).alias("projection"))


CASCADE = f"SELECT id, CASE WHEN {EITHER(guards.advice_patterns(), UNQUOTED)} THEN 'advice' WHEN len({PII_LIST}) > 0 THEN 'pii' WHEN {EITHER(guards.PERFORMANCE, 'coalesce(question, ' + quoted('') + ')')} THEN 'performance' END AS refusal_type, length(coalesce(question, '')) AS query_chars FROM {ASKED}"


@query(f"SELECT id, refusal_type, CASE WHEN refusal_type IS NULL THEN 'answer' ELSE 'refuse' END AS action, query_chars FROM ({CASCADE})")
def guard_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.check(asked(spark, sf_dir)).select("id", "refusal_type", "action", F.col("query_chars").cast("long").alias("query_chars"))


NORMAL = "lower(trim(regexp_replace(coalesce(question, ''), '\\s+', ' ', 'g')))"


@query(f"SELECT id, sha1({NORMAL}) AS digest FROM {ASKED}")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", F.sha1(tx.normalize(F.col("question"))).alias("digest"))


# Fixed values, spelled out here so that a wrong table of aliases would be seen.
NAMED = {"large_cap": "large cap|largecap", "flexi_cap": "flexi cap|flexicap|acme equity fund", "elss": "elss|tax saver|tax saver fund", "small_cap": "small cap|smallcap", "balanced_advantage": "balanced advantage|balanced advantage fund"}
SCHEMES = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({NORMAL}, '\\b({names})\\b') THEN '{slug}' END" for slug, names in NAMED.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT id, CASE WHEN len(s) = 1 THEN s[1] END AS scheme FROM (SELECT id, {SCHEMES} AS s FROM {ASKED})")
def detect_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", rewrite.detect_scheme(F.col("question"), Settings(brand="Acme")).alias("scheme"))


# Texts.

SENTENCES = "list_filter(list_transform(string_split(regexp_replace(trim(coalesce(text, ''), ' \t\n\r\x0b\x0c'), '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"SELECT doc_id, len({SENTENCES}) AS sentences FROM documents")
def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(tx.split_plain_sentences(F.col("text"))).cast("long").alias("sentences"))


@query(f"SELECT doc_id, sha1(array_to_string(({SENTENCES})[1:3], ' ')) AS digest FROM documents")
def truncate_three_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tx.split_plain_sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha1(F.array_join(F.slice(parts, 1, 3), " ")).alias("digest"))


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z_]+|[^0-9A-Za-z_\\s]')) AS tokens FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.count_tokens(F.col("text")).cast("long").alias("tokens"))


@query("SELECT doc_id, sha1('===BEGIN CONTEXT===\n' || trim(regexp_replace(coalesce(text, ''), '={2,}\\s*(?:BEGIN|END)\\s*[A-Z_]+\\s*={2,}', '', 'g'), ' \t\n\r\x0b\x0c') || '\n===END CONTEXT===\n\n===BEGIN QUESTION===\nwhat is it\n===END QUESTION===\n\nAnswer the QUESTION using only the CONTEXT above.') AS digest FROM documents")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents")
    return rows.select("doc_id", F.sha1(verify.user_message(F.array(tx.text_or_empty(F.col("text"))), F.lit("what is it"))).alias("digest"))


# Keys and sets.


@query("SELECT page_id, substr(sha1(url), 1, 12) AS doc_key FROM pages")
def doc_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", tx.doc_id(F.col("url")).alias("doc_key"))


@query("SELECT doc_id, line, substr(sha1('https://example.com/' || doc_id || source || '|' || lang || (line - 1)), 1, 12) AS chunk_key FROM (SELECT doc_id, source, lang, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents)")
def chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split(tx.text_or_empty(F.col("text")), "\n")).alias("pos", "x"))
    url = F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string"))
    return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), tx.chunk_id(url, F.array("source", "lang"), F.col("pos")).alias("chunk_key"))


CACHED = "SELECT DISTINCT sha1(text) AS k FROM documents WHERE source IN ('src1', 'src2') AND text IS NOT NULL"


@query(f"SELECT count(*) AS requested, count(c.k) AS hits, count(DISTINCT CASE WHEN c.k IS NULL THEN sha1(d.text) END) AS misses, (SELECT count(*) FROM ({CACHED})) AS rows_cached FROM documents d LEFT JOIN ({CACHED}) c ON sha1(d.text) = c.k")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    keys = docs.filter("source in ('src1', 'src2') and text is not null").select(tx.text_key(F.col("text")).alias("text_key")).distinct()
    vector = F.array_repeat(F.lit(0.0).cast("float"), SETTINGS.embed_dim)
    cache = keys.select("text_key", F.lit(SETTINGS.embed_model).alias("model"), F.lit(SETTINGS.embed_dim).alias("dim"), F.lit(SETTINGS.embed_window).alias("window"), vector.alias("embedding"))
    return embed.cache_stats(docs, "text", cache, SETTINGS)


UUIDS = "substr(md5(doc_id::VARCHAR), 1, 8) || '-' || substr(md5(doc_id::VARCHAR), 9, 4) || '-' || substr(md5(doc_id::VARCHAR), 13, 4) || '-' || substr(md5(doc_id::VARCHAR), 17, 4) || '-' || substr(md5(doc_id::VARCHAR), 21, 12)"


@query(f"SELECT {UUIDS} AS name, length(text) AS bytes FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.md5(F.col("doc_id").cast("string"))
    name = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    listing = read(spark, sf_dir, "documents").select(name.alias("name"), F.length("text").cast("long").alias("bytes"))
    return index.orphans(listing, read(spark, sf_dir, "labels").select(name.alias("id")))


@query("SELECT count(*) AS n_sources, coalesce(max(CASE WHEN event_type <> 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END), max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')), '') AS latest_fetched_at FROM events")
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched_at"), (F.col("event_type") == "view").alias("cached"))
    return rows.agg(F.count("*").alias("n_sources"), tables.latest_fetched().alias("latest_fetched_at"))


# Chunks.

LINES = "SELECT doc_id, source, lang, line, x FROM (SELECT doc_id, source, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(generate_series(0, len(string_split(coalesce(text, ''), chr(10))) - 1)) AS line FROM documents) WHERE trim(x, ' \t\r\x0b\x0c') <> ''"


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks; one with a pipe is a table."""
    lines = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split(tx.text_or_empty(F.col("text")), "\n")).alias("block_pos", "text"))
    return lines.filter(F.length(F.translate("text", " \t\r\x0b\x0c", "")) > 0).select("doc_id", "source", "lang", F.lit(0).alias("section_pos"), "block_pos", F.when(F.col("text").contains("|"), "table").otherwise("text").alias("kind"), "text")


UNITS = f"SELECT doc_id, unit, string_agg(x, chr(10) ORDER BY line) AS text, any_value(kind) AS kind FROM (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS unit FROM (SELECT *, CASE WHEN kind = 'table' OR coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY line), 'table') = 'table' THEN 1 ELSE 0 END AS start FROM (SELECT *, CASE WHEN contains(x, '|') THEN 'table' ELSE 'text' END AS kind FROM ({LINES})))) GROUP BY doc_id, unit"


@query(f"SELECT doc_id, unit::BIGINT AS unit_pos, sha1(text) AS digest, kind AS block_types FROM ({UNITS})")
def section_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.section_units(line_blocks(spark, sf_dir)).select("doc_id", F.col("unit_pos").cast("long").alias("unit_pos"), F.sha1("text").alias("digest"), "block_types")


@query("SELECT source, count(*) AS sections, count_if(n > 512) AS sections_over_cap, round(avg(n), 1) AS mean_tokens, quantile_disc(n, 0.9) AS p90_tokens, count_if(t) AS table_sections, count_if(NOT t) AS prose_sections, sum(c) AS chunks FROM (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z_]+|[^0-9A-Za-z_\\s]')) AS n, contains(coalesce(text, ''), '|') AS t, 1 AS c FROM documents) GROUP BY ROLLUP(source)")
def chunk_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("source", tx.count_tokens(F.col("text")).cast("long").alias("n_tokens"), F.coalesce(F.col("text"), F.lit("")).contains("|").alias("has_table"), F.lit(1).alias("chunks"))
    return chunks.analyze(rows, 512, "source")


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a section for each one, chunked."""
    docs = read(spark, sf_dir, "documents").filter(F.length(tx.strip(F.col("text"))) > 0)
    block = F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"))
    section = F.struct(F.col("lang").alias("heading"), F.lit(1).alias("level"), F.array("lang").alias("heading_path"), F.array(block).alias("blocks"))
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("scheme"), F.col("source").alias("scheme_name"), F.lit("text").alias("category"), F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("source_url"), F.lit("2024-01-01T00:00:00Z").alias("fetched_at"), F.array(section).alias("sections"))
    return chunks.chunk_documents(rows, SETTINGS)


@query()
def split_lines_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive splitting of whole documents; tested against plain Python and by invariants."""
    return document_chunks(spark, sf_dir).select("doc_id", "ordinal", "chunk_id", "n_tokens", F.sha1("text").alias("digest"))


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.85)::DOUBLE AS price FROM lineitem GROUP BY l_returnflag")
def price_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of three groups, each far larger than what one task may gather."""
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    return ranks.percentiles(rows, "price", 85.0, ["l_returnflag"], most_rows=100, few=50).withColumnRenamed("value", "price")


SEMANTIC = "SELECT vec_id, label, d, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM (SELECT vec_id, label, round(1 - list_dot_product(embedding::DOUBLE[], n::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(n::DOUBLE[], n::DOUBLE[]))), 9) AS d FROM (SELECT vec_id, label, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings))"


@query(f"SELECT vec_id, label, is_break, coalesce(sum(is_break::INT) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS run FROM (SELECT s.vec_id, s.label, coalesce(s.d >= l.q, false) AS is_break FROM ({SEMANTIC}) s JOIN (SELECT label, quantile_disc(d, 0.85) AS q FROM ({SEMANTIC}) WHERE d IS NOT NULL GROUP BY label) l USING (label))")
def semantic_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks.semantic_breaks(read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), "label", "vec_id")
    return rows.select("vec_id", "label", "is_break", F.col("run").cast("long").alias("run"))


@query("SELECT 'chunks' AS collection, coalesce(max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')), '') AS last_updated, count(*) AS chunk_count FROM events")
def corpus_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.corpus_meta(read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched_at")))


@query("SELECT doc_id, sum(quality)::BIGINT AS quality, count(*) AS n FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 9 ELSE quality END AS quality FROM labels) GROUP BY doc_id")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("quality").cast("long").alias("quality"))
    new = rows.filter("chunk_id % 3 = 0").withColumn("quality", F.lit(9).cast("long"))
    return index.upserted(rows, new).groupBy(F.col("chunk_id").alias("doc_id")).agg(F.sum("quality").alias("quality"), F.count("*").alias("n"))


# Pages.


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", "html", F.regexp_extract("url", r"://([^/?#]*)", 1).alias("scheme"))


@query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and blocks; tested on pages written by hand."""
    docs = pages.documents(page_rows(spark, sf_dir))
    return pages.blocks(docs).select("doc_id", "section_pos", "block_pos", "level", "kind", F.sha1("heading").alias("heading_digest"), F.sha1("text").alias("digest"))


TITLE = "trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '\\s+', ' ', 'g'))"


@query(f"SELECT substr(sha1(url), 1, 12) AS doc_key, sha1(replace(replace({TITLE}, '&quot;', '\"'), '&amp;', '&')) AS title_digest FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.documents(page_rows(spark, sf_dir)).select(F.col("doc_id").alias("doc_key"), F.sha1("title").alias("title_digest"))


@query()
def page_parse_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse_summary(pages.documents(page_rows(spark, sf_dir)))


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) AS scheme, count(*) AS pages, sum(strlen(html)) AS n_bytes FROM pages GROUP BY ROLLUP(1)")
def fetch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.fetch_summary(page_rows(spark, sf_dir).select("scheme", F.octet_length("html").cast("long").alias("n_bytes")))


# Answers.


def answer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = document_chunks(spark, sf_dir)
    return embed.embed_texts(found, "text", embed.hashing_embedder(SETTINGS.embed_dim), SETTINGS)[0]


@query()
def answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of users against the benchmark's passages: one row for each question."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("chunk_id"), "text", F.lit("passage").alias("section"), F.lit("elss").alias("scheme"), F.lit("Passages").alias("scheme_name"), F.lit("benchmark").alias("category"), F.lit("https://example.com/elss").alias("source_url"), F.lit("2024-01-01T00:00:00Z").alias("fetched_at"), F.array(F.lit("passage")).alias("heading_path"))
    table = kept(embed.embed_texts(items, "text", embed.hashing_embedder(SETTINGS.embed_dim), SETTINGS)[0], "passages")
    users = read(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("query_id"), F.col("text").alias("question"))
    own = probes(spark, PROBES, "id long, question string").select((-F.col("id")).cast("string").alias("query_id"), "question")
    loose = Settings(scheme_urls=URLS, embed_dim=64, max_distance=0.9)
    out = answer(users.unionByName(own), table, settings=loose)
    return out.select("query_id", "refusal", "refusal_type", "llm_called", F.size("citations").alias("n_citations"), F.sha1("answer").alias("answer_digest"))


@query("SELECT count(*) AS source_count, true AS index_ready, 'Sources: ' || count(*) || ' scheme pages · Last updated: unknown' AS line FROM pages")
def corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages")
    return status(rows, rows).select("source_count", "index_ready", "line")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered nearest vectors, the gate, and near duplicates suppressed."""
    wanted, items = vector_queries(spark, sf_dir)
    found = retrieve.top_k(wanted, items, 5, item_id="vec_id", filter_col="label", exclude_self=True)
    kept = retrieve.greedy_dedupe(found, items, DEFAULT.dedupe_similarity, item_id="vec_id")
    return kept.join(retrieve.gate(wanted, found).select("query_id", "passes_gate"), "query_id").withColumn("distance", F.round("distance", 6)).orderBy("query_id", "rank")


# Registers the rest; it reads this module's helpers.
from groundline import catalog_corpus as _catalog_corpus  # noqa: E402, F401
