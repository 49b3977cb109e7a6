"""Registered queries of sources, pages, chunks, the index and answers, over rows built from whole tables, and SQL for them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.catalog import ASKED, CASCADE, NORMAL, SETTINGS, asked, query, quoted, read
from groundline.functions import text as tx
from groundline.functions import vectors as vx
from groundline.operators import cachefiles, chunks, embed, encoder, guards, index, pages, retrieve, rewrite, verify, versions
from groundline.plans.answer import ask_payload, status, valid_requests
from groundline.session import scratch
from groundline.settings import DEFAULT, SENTINEL, Settings
from groundline.sources import tables

# Sources: an allowlist of nations, some of which break a rule.

SOURCE_ROWS = "SELECT n_nationkey AS k, 'https://' || CASE WHEN n_nationkey % 11 = 10 THEN 'EXAMPLE.com' WHEN n_nationkey % 9 = 8 THEN 'other.net' ELSE 'example.com' END || CASE WHEN n_nationkey % 7 = 6 THEN '/' WHEN n_nationkey % 6 = 5 THEN '/same' ELSE '/p' || n_nationkey END AS url, CASE WHEN n_nationkey % 10 = 9 THEN 'twice' ELSE lower(n_name) END AS scheme, CASE WHEN n_nationkey % 8 = 7 THEN ' ' ELSE n_name END AS scheme_name, 'nation' AS category FROM nation"


def source_rows(spark: SparkSession, sf_dir: str, good: bool = False) -> DataFrame:
    k = F.col("n_nationkey")
    host = F.when(k % 11 == 10, "EXAMPLE.com").when(k % 9 == 8, "other.net").otherwise("example.com")
    path = F.when(k % 7 == 6, "/").when(k % 6 == 5, "/same").otherwise(F.concat(F.lit("/p"), k.cast("string")))
    if good:
        host, path = F.lit("example.com"), F.concat(F.lit("/p"), k.cast("string"))
    scheme = F.lower("n_name") if good else F.when(k % 10 == 9, "twice").otherwise(F.lower("n_name"))
    name = F.col("n_name") if good else F.when(k % 8 == 7, " ").otherwise(F.col("n_name"))
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("https://"), host, path).alias("url"), scheme.alias("scheme"), name.alias("scheme_name"), F.lit("nation").alias("category"))


@query(f"""WITH s AS ({SOURCE_ROWS})
SELECT '1 blank' AS rule, 'scheme_name' AS value FROM s WHERE trim(scheme_name) = ''
UNION ALL SELECT '2 duplicate scheme', scheme FROM s GROUP BY scheme HAVING count(*) > 1
UNION ALL SELECT '3 duplicate url', url FROM s GROUP BY url HAVING count(*) > 1
UNION ALL SELECT '4 url', url FROM s WHERE lower(regexp_extract(url, '^https://([^/]+)', 1)) <> 'example.com' OR regexp_extract(url, '^https://[^/]+(.*)$', 1) IN ('', '/')""")
def unique_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.source_violations(source_rows(spark, sf_dir), DEFAULT)


HOSTS = ("m.ththth.example.net", "thther.example.org", "blog.ththan.example.net", "blog.tionsh.example.net", "ththed.example.org", "blog.tionsh.example.com", "tionble.example.org")


@query(f"SELECT page_id, coalesce(regexp_matches(url, '^https://') AND lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) IN {HOSTS} AND regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) NOT IN ('', '/'), false) AS allowed FROM pages")
def url_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", tables.allowed_url(F.col("url"), Settings(allowed_hosts=HOSTS)).alias("allowed"))


GOOD = "SELECT 'https://example.com/p' || n_nationkey AS url, lower(n_name) AS scheme, n_name AS scheme_name, 'nation' AS category FROM nation"


@query(GOOD)
def read_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An allowlist that was written as CSV."""
    source_rows(spark, sf_dir, good=True).withColumn("scheme", F.concat(F.lit(" "), "scheme")).coalesce(1).write.csv(path := scratch(spark, "sources"), header=True)
    return tables.read_sources(spark, path)


@query(f"SELECT scheme, '{{\"scheme\":\"' || scheme || '\",\"scheme_name\":\"' || scheme_name || '\",\"category\":\"' || category || '\",\"url\":\"' || url || '\"}}' AS payload FROM ({GOOD})")
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sources_payload(source_rows(spark, sf_dir, good=True))


def page_server(url: str) -> tuple[int, str, bytes]:
    """Stands for a web server: a page with its own address, and bytes that are no UTF-8."""
    return 200, "Text/HTML; charset=utf-8", b"<p>" + url.encode() + b" caf\xe9</p>"


@query(f"SELECT url, scheme, scheme_name, category, 200 AS status, 'text/html' AS content_type, CASE WHEN c THEN 6 ELSE length(url) + 12 END AS n_bytes, CASE WHEN c THEN 0 ELSE 1 END AS attempts, c AS cached, 'raw_' || scheme || '.html' AS html_path, CASE WHEN c THEN 'kept' || chr(65533) ELSE '<p>' || url || ' caf' || chr(65533) || '</p>' END AS html FROM (SELECT *, ends_with(url, '3') AS c FROM ({GOOD}))")
def fetch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source from the cache or a server, written and read again."""
    sources = source_rows(spark, sf_dir, good=True)
    files = sources.filter(F.col("url").endswith("3")).select("url", F.concat(F.lit("kept").cast("binary"), F.unhex(F.lit("E920"))).alias("content"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("modificationTime"))
    kept = tables.cached_pages(files, sources.limit(0).select("url", F.lit("").alias("fetched_at"))).withColumn("html", tx.strip(F.col("html")))
    got = tables.fetch_all(sources, scratch(spark, "pages"), kept, page_server, sleep=float)
    return got.drop("fetched_at", "elapsed_ms")


@query("SELECT page_id::VARCHAR AS url, sha1(coalesce(html, '') || CASE WHEN page_id % 3 = 0 THEN chr(65533) ELSE '' END) AS digest, strlen(coalesce(html, '')) + (page_id % 3 = 0)::INT AS n_bytes, CASE WHEN page_id % 2 = 0 THEN '2024-05-0' || page_id % 9 || 'T00:00:00Z' ELSE '2023-01-02T03:04:05Z' END AS fetched_at, true AS cached FROM pages WHERE page_id % 10 <> 1")
def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, some of them blank and some with bytes that are no UTF-8; half of them stand in the manifest."""
    key = F.col("page_id")
    html = F.when(key % 10 == 1, F.lit(" \n").cast("binary")).when(key % 3 == 0, F.concat(F.coalesce("html", F.lit("")).cast("binary"), F.unhex(F.lit("E9")))).otherwise(F.coalesce("html", F.lit("")).cast("binary"))
    rows = read(spark, sf_dir, "pages")
    files = rows.select(key.cast("string").alias("url"), html.alias("content"), F.to_timestamp(F.lit("2023-01-02 03:04:05")).alias("modificationTime"))
    manifest = rows.filter(key % 2 == 0).select(key.cast("string").alias("url"), F.concat(F.lit("2024-05-0"), (key % 9).cast("string"), F.lit("T00:00:00Z")).alias("fetched_at"))
    got = tables.cached_pages(files, manifest)
    return got.select("url", F.sha1("html").alias("digest"), F.col("n_bytes").cast("long").alias("n_bytes"), "fetched_at", "cached")


@query(f"SELECT url, 200 AS status, 'h' || scheme AS html_path, '2024-01-0' || (1 + length(url) % 9) || 'T00:00:00Z' AS fetched_at FROM ({GOOD})")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest that was written and is read again."""
    stamp = F.concat(F.lit("2024-01-0"), (1 + F.length("url") % 9).cast("string"), F.lit("T00:00:00Z"))
    rows = source_rows(spark, sf_dir, good=True).select("*", F.lit(200).alias("status"), F.concat(F.lit("h"), "scheme").alias("html_path"), stamp.alias("fetched_at"), F.lit(False).alias("cached"))
    tables.write_json(tables.manifest(rows), path := scratch(spark, "manifest"))
    return tables.read_manifest(spark, path).select("url", F.col("status").cast("int").alias("status"), "html_path", "fetched_at")


# Pages: one for each nation, with every kind of block.

FILLER = "Word text of the page. " * 12
NATION_PAGES = f"SELECT 'https://example.com/n/' || n_nationkey AS url, n_nationkey AS k, n_name AS name, r_name AS region, repeat('Word text of the page. ', 12) AS filler, n_nationkey % 4 = 1 AS pills FROM nation JOIN region ON n_regionkey = r_regionkey"
NATION_BLOCKS = f"""WITH n AS ({NATION_PAGES}), b AS (
  SELECT *, 'Fund overview' AS heading, 0 AS level, -1 AS s, 0 AS block_pos, 'keyvalue' AS kind, 'Riskometer level: Moderate Risk' AS text FROM n WHERE pills
  UNION ALL SELECT *, 'Fund overview', 0, -1, 1, 'text', 'Equity' FROM n WHERE pills
  UNION ALL SELECT *, 'Fund overview', 0, -1, 2, 'text', 'Direct' FROM n WHERE pills
  UNION ALL SELECT *, 'Fund overview', 0, -1, 3, 'text', 'Moderate Risk Equity Direct' FROM n WHERE pills
  UNION ALL SELECT *, name, 1, 0, 0, 'text', 'Intro of ' || name || ' & more ' || trim(filler) FROM n
  UNION ALL SELECT *, 'Facts', 2, 1, 0, 'keyvalue', 'Region: ' || region || chr(10) || 'Key: ' || k FROM n
  UNION ALL SELECT *, 'Table', 2, 2, 0, 'table', '| id | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || k || ' | ' || name || '\\|x |' || chr(10) || '| only |  |' FROM n
  UNION ALL SELECT *, 'List', 3, 3, 0, 'list', '- one ' || name || chr(10) || '- two' FROM n
)"""


def nation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    tag = F.when(key % 5 == 0, "div").otherwise("main")
    pills = F.when(key % 4 == 1, '<div class="x pills_container"><a>Moderate Risk</a><span>Equity</span><span>Direct</span></div>').otherwise("")
    parts = (
        '<html><head><title>Other</title><style>p{}</style></head><body><header>Top</header><nav><a href="/">Home</a></nav><div class="cookie-bar">Accept</div><', tag, ">", pills, "<h1>", F.col("n_name"), "</h1><p>Intro of ", F.col("n_name"), " &amp;\n more</p><!-- gone --><p>", F.lit(FILLER), "</p>",
        '<h2>Facts</h2><div class="grid"><div><span>Region</span><span>', F.col("r_name"), "</span></div><div><span>Key</span><span>", key.cast("string"), "</span></div></div>",
        "<h2>Table</h2><table><tr><th>id</th><th>name</th></tr><tr><td>", key.cast("string"), "<td>", F.col("n_name"), "|x</tr><tr><td></td></tr><tr><td>only</td></tr></table>",
        "<h3>List</h3><ul><li>one ", F.col("n_name"), "<li> </li><li>two</ul><h2>Empty</h2><script>var x = 1;</script><p>View all</p></", tag, "><footer>Foot</footer></body></html>",
    )
    html = F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return nations.select(F.concat(F.lit("https://example.com/n/"), key.cast("string")).alias("url"), html.alias("html"), F.col("r_name").alias("scheme"), F.col("n_name").alias("scheme_name"))


@query(NATION_BLOCKS + " SELECT substr(sha1(url), 1, 12) AS doc_id, (s + pills::INT)::INT AS section_pos, block_pos::INT AS block_pos, level::INT AS level, heading, kind, sha1(text) AS digest FROM b")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root or largest container, boilerplate and comments stripped, headings, pairs, tables, lists and pills."""
    rows = pages.blocks(pages.documents(nation_pages(spark, sf_dir), strict=True))
    return rows.select("doc_id", "section_pos", "block_pos", "level", "heading", "kind", F.sha1("text").alias("digest"))


@query(NATION_BLOCKS + " SELECT substr(sha1(url), 1, 12) AS doc_id, (s + pills::INT)::INT AS section_pos, CASE level WHEN 0 THEN heading WHEN 1 THEN name WHEN 2 THEN name || ' > ' || heading ELSE name || ' > Table > ' || heading END AS path FROM b WHERE block_pos = 0")
def page_heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by the tree of headings."""
    docs = pages.documents(nation_pages(spark, sf_dir), Settings(heading_path_mode="tree"))
    return docs.select("doc_id", F.posexplode("sections").alias("section_pos", "s")).select("doc_id", "section_pos", F.array_join("s.heading_path", " > ").alias("path"))


@query(NATION_BLOCKS + " SELECT region AS scheme, count(DISTINCT (url, heading)) AS sections, count_if(kind = 'text') AS text, count_if(kind = 'table') AS \"table\", count_if(kind = 'list') AS list, count_if(kind = 'keyvalue') AS keyvalue, sum(length(text))::BIGINT AS chars FROM b GROUP BY ROLLUP(region)")
def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.parse_summary(pages.documents(nation_pages(spark, sf_dir)))


@query("SELECT c_custkey, '<body><p>' || c_name || ' a</p><div id=\"x\">' || c_mktsegment || '</div></body>' AS html FROM customer")
def page_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    def cleaned(batches):
        for b in batches:
            yield pd.DataFrame({"c_custkey": b["c_custkey"], "html": b["html"].map(pages.clean_html)})

    markup = F.concat(F.lit("<body><nav>menu</nav><p>"), "c_name", F.lit('\n  a</p><!-- note --><div class="newsletter-x">n</div><p>See all</p><div id="x">'), "c_mktsegment", F.lit("<script>1</script></div></body>"))
    return read(spark, sf_dir, "customer").select("c_custkey", markup.alias("html")).mapInPandas(cleaned, "c_custkey long, html string")


# Chunks of whole documents.

TOKENS = "regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z_]+|[^0-9A-Za-z_\\s]')"
WORDS = "regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z_]+')"


def chunked(spark: SparkSession, sf_dir: str, text, kind: str = "text") -> DataFrame:
    """Documents with one block each, chunked: a heading of one token leaves 511 of 512."""
    rows = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    # an empty text gives no block; a filter of rows would compute the text twice
    blocks = F.transform(F.filter(F.array("text"), lambda t: F.length(t) > 0), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))
    section = F.struct(F.lit("head").alias("heading"), F.lit(1).alias("level"), F.array(F.lit("head")).alias("heading_path"), blocks.alias("blocks"))
    blank = [F.lit("x").alias(c) for c in ("scheme", "scheme_name", "category", "source_url", "fetched_at")]
    found = chunks.chunk_documents(rows.select(F.col("doc_id").cast("string").alias("doc_id"), *blank, F.array(section).alias("sections")), SETTINGS)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ordinal").cast("long").alias("ordinal"), F.col("n_tokens").cast("long").alias("n_tokens"), F.sha1("text").alias("digest"))


def words_of() -> object:
    return F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit("[0-9A-Za-z_]+"), F.lit(0))


def once(value, f):
    """f of a value that is computed once for each row, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def windows(items, size: int):
    """Arrays of `size` items each, the last one shorter."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / size) - 1, F.lit(0)).cast("int")), lambda k: F.slice(items, k * size + 1, size))


@query(f"SELECT doc_id, k AS ordinal, len(p) + 1 AS n_tokens, sha1('head' || chr(10) || array_to_string(p, '')) AS digest FROM (SELECT doc_id, k, t[k * 511 + 1 : k * 511 + 511] AS p FROM (SELECT doc_id, t, unnest(generate_series(0, greatest((len(t) - 1) // 511, 0))) AS k FROM (SELECT doc_id, {TOKENS.replace(chr(39) + chr(39), 'x')} AS t FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', '-', 'g'), '-') AS x FROM documents)) WHERE len(t) > 0))".replace("coalesce(text, x)", "x"))
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a separator are cut after so many tokens."""
    return chunked(spark, sf_dir, F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r\f\x0b]+", "-"), r"\A-+|-+\z", ""))


LINED = f"SELECT doc_id, list_transform(generate_series(0, len(w) // 20 - 1), lambda k: array_to_string(w[k * 20 + 1 : k * 20 + 20], ' ')) AS l FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) >= 20"


@query(f"SELECT doc_id, p AS ordinal, 1 + 20 * len(s) AS n_tokens, sha1('head' || chr(10) || array_to_string(s, chr(10))) AS digest FROM (SELECT doc_id, p, l[22 * p + 1 : 22 * p + 25] AS s FROM (SELECT doc_id, l, unnest(generate_series(0, CASE WHEN len(l) <= 25 THEN 0 ELSE (len(l) - 4) // 22 END)) AS p FROM ({LINED})))")
def chunk_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 tokens: 25 fill a chunk, and the last three of it (60 of the 64 that may) lead the next."""
    lines = lambda words: F.filter(F.transform(windows(words, 20), lambda w: F.when(F.size(w) == 20, F.array_join(w, " "))), lambda x: x.isNotNull())
    return chunked(spark, sf_dir, once(words_of(), lambda words: F.array_join(lines(words), "\n")))


@query(f"SELECT doc_id, p AS ordinal, 1 + 14 + 5 * len(s) AS n_tokens, sha1('head' || chr(10) || '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(s, chr(10))) AS digest FROM (SELECT doc_id, p, r[82 * p + 1 : 82 * p + 82] AS s FROM (SELECT doc_id, r, unnest(generate_series(0, (len(r) - 1) // 82)) AS p FROM (SELECT doc_id, list_transform(w, lambda x: '| ' || x || ' | y |') AS r FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0)))")
def chunk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables are cut between rows, each part with the header."""
    rows = lambda words: F.concat(F.lit("| a | b |\n| --- | --- |\n| "), F.array_join(words, " | y |\n| "), F.lit(" | y |"))
    return chunked(spark, sf_dir, once(words_of(), lambda words: F.when(F.size(words) > 0, rows(words)).otherwise("")), "table")


@query("SELECT conv_id, turn, conv_id * 1000 + turn AS first_id, len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_\\s]')) AS tokens FROM (SELECT *, sum(len(regexp_extract_all(text, '[0-9A-Za-z_]+|[^0-9A-Za-z_\\s]'))) OVER w AS total, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE total <= 1800 OR n = 1")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation while their tokens fit."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("rank"), tx.count_tokens(F.col("text")).cast("long").alias("tokens"))
    return retrieve.within_budget(rows, 1800, "conv_id").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("first_id"), "tokens")


RULES = """WITH c AS (SELECT doc_id::VARCHAR AS chunk_id, doc_id % 40 AS f, source, length(coalesce(text, '')) % 600 AS n FROM documents)
SELECT chunk_id, 'tokens' AS rule FROM c WHERE n > 512
UNION ALL SELECT chunk_id, 'tokens' FROM c WHERE n > 512 AND f = 5
UNION ALL SELECT chunk_id, 'url' FROM c WHERE f = 1 UNION ALL SELECT chunk_id, 'section' FROM c WHERE f = 2
UNION ALL SELECT chunk_id, 'scheme' FROM c WHERE f = 3 UNION ALL SELECT chunk_id, 'table' FROM c WHERE f = 4 UNION ALL SELECT chunk_id, 'duplicate id' FROM c WHERE f = 5
UNION ALL SELECT min(chunk_id), 'several urls' FROM (SELECT chunk_id, CASE WHEN f = 3 THEN source || '|' ELSE source END AS scheme, CASE f WHEN 1 THEN ' ' WHEN 6 THEN 'other' ELSE source END AS url FROM c) GROUP BY scheme HAVING count(DISTINCT url) > 1"""


@query(RULES)
def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks made to break each rule."""
    f = F.col("doc_id") % 40
    rows = read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("chunk_id"), (F.length(F.coalesce("text", F.lit(""))) % 600).alias("n_tokens"), F.when(f == 4, "| a | b |\n| c |").otherwise("x").alias("text"), F.when(f == 2, "").otherwise("s").alias("section"),
        F.when(f == 3, F.concat("source", F.lit("|"))).otherwise(F.col("source")).alias("scheme"), F.when(f == 1, " ").when(f == 6, "other").otherwise(F.col("source")).alias("source_url"), f.alias("f"),
    )
    return chunks.violations(rows.unionByName(rows.filter("f = 5")).drop("f"), 512)


# The index.

INDEXED = "SELECT doc_id::VARCHAR AS id, doc_id % 50 AS f FROM documents WHERE length(trim(coalesce(text, ''))) > 0"


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").filter("length(trim(coalesce(text, ''))) > 0")
    return docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("scheme"), F.col("source").alias("scheme_name"), F.lit("c").alias("category"), F.col("lang").alias("section"), F.concat(F.lit("https://example.com/"), "lang").alias("source_url"), F.lit("2024-01-01T00:00:00Z").alias("fetched_at"), F.array("lang").alias("heading_path"), F.lit("text").alias("block_types"), (F.col("doc_id") % 50).alias("f"))


@query(f"""WITH d AS ({INDEXED})
SELECT 'count' AS problem, (count(*) - count_if(f = 1) + count_if(f = 2)) || ' of ' || count(*) AS id FROM d HAVING count_if(f = 1) <> count_if(f = 2)
UNION ALL SELECT 'missing', id FROM d WHERE f IN (1, 6) UNION ALL SELECT 'extra', id || 'x' FROM d WHERE f = 6 UNION ALL SELECT 'duplicate id', id FROM d WHERE f = 2
UNION ALL SELECT 'metadata section', id FROM d WHERE f = 3 UNION ALL SELECT 'metadata heading_path', id FROM d WHERE f = 7 UNION ALL SELECT 'empty text', id FROM d WHERE f = 4
UNION ALL SELECT 'url not in the sources', id FROM d WHERE f IN (5, 8) UNION ALL SELECT 'url not allowed', id FROM d WHERE f = 5""")
def verify_index_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index with every kind of fault, against what was put in."""
    rows, f = index_rows(spark, sf_dir), F.col("f")
    have = rows.filter(f != 1).unionByName(rows.filter(f == 2))
    have = have.withColumns({
        "chunk_id": F.when(f == 6, F.concat("chunk_id", F.lit("x"))).otherwise(F.col("chunk_id")), "section": F.when(f == 3, "").otherwise(F.col("section")), "text": F.when(f == 4, " \n").otherwise(F.col("text")),
        "heading_path": F.when(f == 7, F.array().cast("array<string>")).otherwise(F.col("heading_path")), "source_url": F.when(f == 5, "https://foreign.net/x").when(f == 8, "https://example.com/unlisted").otherwise(F.col("source_url")),
    })
    return index.problems(have, rows, rows.select(F.col("source_url").alias("url")).distinct(), DEFAULT).select("problem", "id")


@query(f"WITH d AS ({INDEXED}) SELECT 'missing' AS problem, id FROM d WHERE f < 7 UNION ALL SELECT 'extra', doc_id::VARCHAR FROM labels WHERE doc_id::VARCHAR NOT IN (SELECT id FROM d)")
def id_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of an index that lacks some chunks and has those of all labels besides."""
    rows = index_rows(spark, sf_dir)
    extra = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("chunk_id")).join(rows.select("chunk_id"), "chunk_id", "left_anti")
    have = rows.filter("f >= 7").unionByName(extra, allowMissingColumns=True)
    return index.id_difference(have, rows).select("problem", "id")


@query("SELECT vec_id::VARCHAR AS chunk_id, label::VARCHAR AS scheme, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings")
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written by scheme, opened with a look at its metadata, and read whole."""
    folder, settings = scratch(spark, "opened"), Settings(embed_dim=64)
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("scheme"), F.array(F.lit("h")).alias("heading_path"), "embedding")
    index.build(rows, f"{folder}/index", settings)
    embed.index_meta(spark, settings).write.parquet(f"{folder}/index_meta")
    found = retrieve.open_index(spark, f"{folder}/index", settings)
    return found.select("chunk_id", F.substring("scheme", 2, 9).alias("scheme"), F.round(vx.norm(F.col("embedding")), 4).alias("norm"))


@query("SELECT pos::INT AS pos, value FROM (SELECT count(*) AS n, count(DISTINCT label) AS l, sum(vec_id % 90)::BIGINT AS t, min(vec_id % 90) AS a, max(vec_id % 90) AS b FROM embeddings), (VALUES (3), (4), (5), (6), (7)) p(pos), LATERAL (SELECT CASE pos WHEN 3 THEN n::VARCHAR WHEN 4 THEN l::VARCHAR WHEN 5 THEN '2' WHEN 6 THEN t::VARCHAR ELSE a || ' to ' || b END AS value)")
def dump_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("embedding", F.col("label").alias("scheme"), (F.col("vec_id") % 2).alias("section"), (F.col("vec_id") % 90).alias("n_tokens"))
    return index.dump_header(rows, Settings(embed_dim=64)).filter("pos between 3 and 7").select("pos", "value")


@query("SELECT count(*) AS requested, count(DISTINCT text) AS encoded FROM documents WHERE length(trim(text, ' \t\n\r\x0b\x0c')) > 0")
def dedupe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that get a vector, and texts that were encoded for them."""
    docs = read(spark, sf_dir, "documents").filter(F.length(tx.strip(F.col("text"))) > 0).select("doc_id", "text")
    out, fresh = embed.embed_texts(docs, "text", embed.hashing_embedder(16), Settings(embed_dim=16))
    return retrieve.beside(out.agg(F.count("embedding").alias("requested")), fresh.agg(F.count("*").alias("encoded")))


@query("SELECT doc_id, 1.0::DOUBLE AS norm, 64 AS dim FROM documents WHERE length(trim(text, ' \t\n\r\x0b\x0c')) > 0")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents: one for each, of unit length."""
    docs = read(spark, sf_dir, "documents").filter(F.length(tx.strip(F.col("text"))) > 0).select("doc_id", "text")
    out = embed.embed_texts(docs, "text", embed.hashing_embedder(SETTINGS.embed_dim), SETTINGS)[0]
    return out.select("doc_id", F.round(vx.norm(F.col("embedding")), 4).alias("norm"), F.size("embedding").alias("dim"))


@query("SELECT doc_id, regexp_extract(text, '^[^\\n]*') AS first_line, chunk_ordinal FROM (SELECT doc_id, coalesce(text, '') AS text, 3 AS chunk_ordinal FROM documents)")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written as lines of JSON and read again."""
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"\A[^\n]*", 0)
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), first.alias("text"), F.array("lang", "source").alias("heading_path"), F.lit(3).alias("n_tokens"), F.lit("u").alias("source_url"), F.lit(0).alias("ordinal"))
    tables.write_chunks(rows, path := scratch(spark, "lines"))
    return tables.read_chunks(spark, path).select(F.col("chunk_id").cast("long").alias("doc_id"), F.col("text").alias("first_line"), F.col("n_tokens").alias("chunk_ordinal"))


@query("SELECT doc_id::VARCHAR AS chunk_id, lang AS section, sha1(CASE WHEN doc_id % 97 = 0 THEN 'changed ' || coalesce(text, '') ELSE coalesce(text, '') END) AS digest FROM documents WHERE doc_id % 101 <> 5 UNION ALL SELECT 'new' || doc_id, lang, sha1('new') FROM documents WHERE doc_id % 100 = 1")
def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents, some of which are then changed, added and deleted, twice over, and its layers compacted in part."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("section"), "doc_id")
    table = versions.VersionedIndex(spark, scratch(spark, "versions"))
    table.create(rows.drop("doc_id"), buckets=16)
    changed = rows.filter("doc_id % 97 = 0").withColumn("text", F.concat(F.lit("changed "), "text"))
    added = rows.filter("doc_id % 100 = 1").withColumns({"chunk_id": F.concat(F.lit("new"), "chunk_id"), "text": F.lit("new")})
    for _ in range(2):
        table.upsert(changed.unionByName(added).drop("doc_id"))
        table.delete(rows.filter("doc_id % 101 = 5"))
    table.compact(3)
    return table.open().select("chunk_id", "section", F.sha1("text").alias("digest"))


# Vectors: every item against every other, in blocks.

# The encoder fitted from the corpus, and the cache's filters.

BUCKET = "('0x' || substr(md5(w), 1, 8))::BIGINT % 65536"


@query(f"SELECT bucket, count(*) AS n_texts FROM (SELECT unnest(list_distinct(list_transform(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {quoted(encoder.WORD)})), lambda w: {BUCKET}))) AS bucket FROM documents) GROUP BY bucket")
def encoder_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have a word of each bucket: what the fitted encoder weighs words by."""
    return encoder.bucket_counts(read(spark, sf_dir, "documents"))


@query()
def embed_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents by an encoder fitted on all of them; tests hold the fit against plain Python."""
    docs = read(spark, sf_dir, "documents").filter(F.length(tx.strip(F.col("text"))) > 0).select("doc_id", "text")
    model = encoder.fit(docs, "text", SETTINGS.embed_dim)
    out = embed.embed_texts(docs, "text", encoder.embedder(spark, model), encoder.fitted_settings(model, SETTINGS))[0]
    return out.select("doc_id", F.lit(model.name).alias("model"), F.size("embedding").alias("dim"), F.round(vx.norm(F.col("embedding")), 4).alias("norm"), "embedding")


@query("SELECT doc_id, sha1(text) IN (SELECT sha1(text) FROM documents WHERE source IN ('src1', 'src2') AND text IS NOT NULL) AS cached FROM documents WHERE text IS NOT NULL")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a document's text in a cache of two sources' texts, by way of the files' filters?"""
    docs, path = read(spark, sf_dir, "documents").filter("text is not null"), scratch(spark, "cache")
    keyed = docs.select("doc_id", "source", tx.text_key(F.col("text")).alias("text_key"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), SETTINGS.embed_dim).alias("embedding")
    for source in ("src1", "src2"):
        embed.append_cache(embed.cache_rows(keyed.filter(F.col("source") == source).select("text_key").distinct().select("text_key", zeros), SETTINGS), path)
    known = embed.usable_cache(cachefiles.lookup(spark, path, keyed, SETTINGS), SETTINGS).select("text_key", F.lit(True).alias("cached"))
    return keyed.join(known, "text_key", "left").select("doc_id", F.coalesce("cached", F.lit(False)).alias("cached"))


SIMILAR = "list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[])"


@query(f"SELECT i.vec_id, count(q.vec_id) AS n_links, least(i.vec_id, coalesce(min(q.vec_id), i.vec_id)) AS least_link FROM embeddings i LEFT JOIN embeddings q ON q.vec_id <> i.vec_id AND {SIMILAR} > 0.4 GROUP BY i.vec_id")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector its links to all others."""
    return retrieve.similar_links(read(spark, sf_dir, "embeddings"), 0.4, "vec_id")


@query(f"SELECT query_id, rank, vec_id AS neighbour, round(greatest(0.0, d), 6) AS distance FROM (SELECT q.vec_id AS query_id, i.vec_id, 1 - {SIMILAR} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - {SIMILAR}, i.vec_id) AS rank FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id) WHERE rank <= 3")
def knn_all_pairs_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.all_neighbours(read(spark, sf_dir, "embeddings"), 3, "vec_id").withColumn("distance", F.round("distance", 6))


@query(f"""WITH RECURSIVE f AS (SELECT query_id, rank, vec_id, round(d, 6) AS distance, e FROM (SELECT q.vec_id AS query_id, i.vec_id, i.embedding::DOUBLE[] AS e, 1 - {SIMILAR} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - {SIMILAR}, i.vec_id) AS rank FROM embeddings q JOIN embeddings i ON q.vec_id <> i.vec_id AND q.vec_id % 50 = 0) WHERE rank <= 10),
k AS (SELECT query_id, rank, vec_id, distance, [e] AS kept, true AS stays FROM f WHERE rank = 1
  UNION ALL SELECT f.query_id, f.rank, f.vec_id, f.distance, CASE WHEN len(list_filter(k.kept, lambda v: list_dot_product(v, f.e) > 0.3)) = 0 THEN list_append(k.kept, f.e) ELSE k.kept END, len(list_filter(k.kept, lambda v: list_dot_product(v, f.e) > 0.3)) = 0 FROM k JOIN f ON f.query_id = k.query_id AND f.rank = k.rank + 1)
SELECT query_id, rank, vec_id, distance FROM k WHERE stays""")
def greedy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "embeddings")
    found = retrieve.top_k(items.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), items, 10, item_id="vec_id", exclude_self=True)
    return retrieve.greedy_dedupe(found.withColumn("distance", F.round("distance", 6)), items, 0.3, item_id="vec_id")


# Questions and answers: turns of conversations, some with what a rule looks for.


def expansion_sql() -> str:
    """The rules of expansion as one step of SQL for each variant."""
    out = f"SELECT id, {NORMAL} AS o, {NORMAL} AS x, false AS forced, -1 AS closed FROM {ASKED}"
    for t, (term, variants) in enumerate(DEFAULT.synonyms):
        for v in variants:
            wanted = f"regexp_matches(o, '\\b{re.escape(term)}\\b') AND closed <> {t} AND NOT list_contains(string_split(x, ' '), {quoted(v)})"
            fits = f"length(x) + {len(v) + 1} <= floor(length(o) * {DEFAULT.expansion_ratio})"
            out = f"SELECT id, o, CASE WHEN w AND (f OR NOT forced) THEN x || ' ' || {quoted(v)} ELSE x END AS x, forced OR (w AND NOT f) AS forced, CASE WHEN w AND NOT f AND forced THEN {t} ELSE closed END AS closed FROM (SELECT *, {wanted} AS w, {fits} AS f FROM ({out}))"
    return f"SELECT id, sha1(x) AS digest FROM ({out})"


@query(expansion_sql())
def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("id", F.sha1(rewrite.expand(F.col("question"))).alias("digest"))


@query(f"SELECT id, refusal_type, sha1(CASE refusal_type WHEN 'advice' THEN {quoted(guards.ADVICE_REFUSAL)} || chr(10) || chr(10) || 'Learn more: ' || {quoted(guards.EDUCATION_LINK)} WHEN 'pii' THEN {quoted(guards.PII_REFUSAL)} WHEN 'performance' THEN {quoted(guards.PERFORMANCE_REFUSAL)} || chr(10) || chr(10) || 'Official page: {SETTINGS.home_url}' END) AS digest FROM ({CASCADE}) WHERE refusal_type IS NOT NULL")
def refusal_text_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = guards.check(asked(spark, sf_dir)).filter("refusal_type is not null")
    return rows.select("id", "refusal_type", F.sha1(guards.refusal_text(F.col("refusal_type"), F.lit(None).cast("string"), SETTINGS)).alias("digest"))


@query("SELECT conv_id * 1000 + turn AS id, turn % 4 IN (0, 3) AS advice FROM conversations")
def guard_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negation shortly before the match takes it back, one further off does not."""
    said = F.element_at(F.array(F.lit("I recommend "), F.lit("we do not recommend "), F.lit("never did they suggest "), F.lit("it is not so at all and they would surely recommend ")), (F.col("turn") % 4 + 1).cast("int"))
    question = F.concat(said, F.substring(F.regexp_replace("text", "[^a-z ]", ""), 1, 20))
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), guards.is_advice(question).alias("advice"))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with links, a last line or a confession added; kind is the turn's number modulo 6."""
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("turn") % 6).alias("kind"), (F.col("conv_id") % 3).alias("a"), F.regexp_replace("text", r"[.!?\s]+", " ").alias("text"))
    own = F.concat(F.trim("text"), F.lit(" see https://example.com/"), F.col("a").cast("string"))
    body = F.when(F.col("kind") == 0, F.concat(own, F.lit(" now. And https://other.example/x, too.")))
    body = body.when(F.col("kind") == 1, F.concat(own, F.lit(". One. Two. Three. Four.")))
    body = body.when(F.col("kind") == 2, F.concat(F.lit(f"**{SENTINEL}** "), own)).when(F.col("kind") == 3, F.lit(" "))
    body = body.when(F.col("kind") == 4, F.concat(own, F.lit("\nLast updated from sources: 2020-01-01"))).otherwise(F.concat(F.lit("You can recommend "), own))
    return rows.select("id", "kind", "a", body.alias("generated"))


GENERATIONS = f"SELECT conv_id * 1000 + turn AS id, turn % 6 AS kind, conv_id % 3 AS a, trim(regexp_replace(text, '[.!?\\s]+', ' ', 'g')) || ' see https://example.com/' || conv_id % 3 AS own FROM conversations"
BODIES = f"SELECT *, CASE kind WHEN 0 THEN own || ' now. And https://other.example/x, too.' WHEN 1 THEN own || '. One. Two. Three. Four.' WHEN 2 THEN '**{SENTINEL.replace(chr(39), chr(39) * 2)}** ' || own WHEN 3 THEN ' ' WHEN 4 THEN own || chr(10) || 'Last updated from sources: 2020-01-01' ELSE 'You can recommend ' || own END AS body FROM ({GENERATIONS})"


@query(f"SELECT id, array_to_string(regexp_extract_all(body, {quoted(tx.URL)}), ' ') AS urls FROM ({BODIES})")
def extract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generations(spark, sf_dir).select("id", F.array_join(tx.extract_urls(F.col("generated")), " ").alias("urls"))


@query(f"SELECT id, sha1(trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN a = 0 THEN body ELSE regexp_replace(body, 'https://example[^\\s]*', '', 'g') END, 'https://other[^\\s]*', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), ' +([.,;:!?])', '\\1', 'g'), ' \t\n\r\x0b\x0c')) AS digest FROM ({BODIES})")
def strip_foreign_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(F.lit("https://example.com/0"))
    return generations(spark, sf_dir).select("id", F.sha1(verify.without_foreign_urls(F.col("generated"), known)).alias("digest"))


@query(f"SELECT id, kind = 2 AS sentinel FROM ({BODIES})")
def sentinel_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generations(spark, sf_dir).select("id", verify.is_sentinel(F.col("generated")).alias("sentinel"))


@query(f"SELECT id, sha1(trim(CASE WHEN kind = 4 THEN own ELSE body END, ' ')) AS digest FROM ({BODIES})")
def strip_last_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generations(spark, sf_dir).select("id", F.sha1(tx.strip_last_updated(F.col("generated"))).alias("digest"))


@query(f"SELECT id, CASE kind WHEN 2 THEN 'out_of_corpus' WHEN 3 THEN 'out_of_corpus' WHEN 5 THEN 'advice' END AS verify_refusal, CASE kind WHEN 0 THEN 1 + 2 * (a <> 0)::INT WHEN 1 THEN 1 + 2 * (a <> 0)::INT WHEN 4 THEN 1 + 2 * (a <> 0)::INT WHEN 5 THEN 1 + (a <> 0)::INT ELSE 1 END AS n_warnings, CASE WHEN kind IN (2, 3) THEN '' WHEN kind = 5 THEN sha1(body) WHEN kind = 4 AND a = 0 THEN sha1(own) WHEN kind = 1 AND a = 0 THEN sha1(own || '. One. Two.') WHEN kind = 0 AND a = 0 THEN sha1(own || ' now. And too.') END AS digest FROM ({BODIES})")
def verify_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences cut, links checked and stripped, dates, confessions and advice found, in whole turns."""
    rows = generations(spark, sf_dir).withColumn("context_urls", F.array(F.lit("https://example.com/0")))
    shown = F.when(F.col("body") == "", "").when((F.col("kind") == 5) | (F.col("a") == 0), F.sha1("body"))
    return verify.verify(rows).select("id", "verify_refusal", F.size("verify_warnings").alias("n_warnings"), shown.alias("digest"))


MASKED = "regexp_replace(body, '(\\d)\\.(\\d)', '\\1' || chr(1) || '\\2', 'g')"
for _a in tx.ABBREVIATIONS:
    MASKED = f"regexp_replace({MASKED}, '(?i)(^|[^0-9A-Za-z_\\pL\\pN])({re.escape(_a[:-1])})\\.', '\\1\\2' || chr(1), 'g')"
SPOKEN = "SELECT conv_id * 1000 + turn AS id, 'Mr. A rose by 3.5 vs. 2.1 points. ' || trim(text, ' \t\n\r\x0b\x0c') || ' Approx. so' AS body FROM conversations"
SAID = f"SELECT id, body, list_filter(list_transform(string_split(regexp_replace({MASKED}, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda s: trim(replace(s, chr(1), '.'), ' \t\n\r\x0b\x0c')), lambda s: s <> '') AS s FROM ({SPOKEN})"


@query(f"SELECT id, len(s) AS sentences, sha1(CASE WHEN len(s) > 3 THEN array_to_string(s[1:3], ' ') ELSE body END) AS digest FROM ({SAID})")
def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences whose abbreviations and decimals end none, and the first three of them."""
    body = F.concat(F.lit("Mr. A rose by 3.5 vs. 2.1 points. "), tx.strip(F.col("text")), F.lit(" Approx. so"))
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), body.alias("body"))
    return rows.select("id", tx.count_sentences(F.col("body")).cast("long").alias("sentences"), F.sha1(verify.first_sentences(F.col("body"))).alias("digest"))


@query("SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 5 = 4 THEN 'blank' WHEN length(text) > 300 THEN 'too long' END AS error FROM conversations")
def ask_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") % 5 == 4, " \n").otherwise(F.col("text")).alias("question"))
    return valid_requests(rows, 300).select("id", "error")


@query("SELECT conv_id * 1000 + turn AS query_id, '{\"question\":\"' || CASE WHEN turn % 3 = 1 THEN '[redacted]' ELSE 'q' || turn END || '\",\"answer\":\"a' || turn || '\",\"citations\":[{\"source_url\":\"u\",\"section\":\"s\"}],\"last_updated\":\"2024\",\"refusal\":false,\"refusal_type\":null,\"disclaimer\":\"d\",\"trace\":{\"llm_called\":true,\"warnings\":[\"w\"],\"hits\":null}}' AS payload FROM conversations")
def ask_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client gets: the question unless it holds personal data, the citation and the trace."""
    rows = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "turn")
    questions = rows.select("query_id", F.when(F.col("turn") % 3 == 1, "mail a@b.co").otherwise(F.concat(F.lit("q"), F.col("turn").cast("string"))).alias("question"))
    answers = rows.select("query_id", F.concat(F.lit("a"), F.col("turn").cast("string")).alias("answer"), F.array(F.struct(F.lit("u").alias("source_url"), F.lit("s").alias("section"))).alias("citations"), F.lit("2024").alias("last_updated"), F.lit(False).alias("refusal"), F.lit(None).cast("string").alias("refusal_type"), F.lit("d").alias("disclaimer"), F.lit(True).alias("llm_called"), F.array(F.lit("w")).alias("warnings"), F.lit(None).cast("array<string>").alias("hits"))
    return ask_payload(answers, questions)


@query("SELECT count(*) AS source_count, true AS index_ready, 'Sources: ' || count(*) || ' scheme pages · Last updated: ' || (SELECT max(strftime(ts, '%Y-%m-%d')) FROM events) || ' · Chunks: ' || (SELECT count(*) FROM events) AS line FROM pages")
def corpus_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line about a corpus whose metadata are known."""
    rows = read(spark, sf_dir, "pages")
    meta = index.corpus_meta(read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("fetched_at")))
    return status(rows, rows, meta).select("source_count", "index_ready", "line")


@query("SELECT doc_id, sha1('[' || source || ' | ' || lang || ' > x]' || chr(10) || 'Source: u' || chr(10) || chr(10) || coalesce(text, '')) AS digest FROM documents")
def render_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("scheme_name"), F.col("source").alias("scheme"), F.lit("s").alias("section"), F.array(F.col("lang"), F.lit("x")).alias("heading_path"), F.lit("u").alias("source_url"))
    return rows.select("doc_id", F.sha1(retrieve.render()).alias("digest"))
