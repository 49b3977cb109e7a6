"""Sources: the allowlist, fetched pages and their manifest, line files; and the sinks that match them."""

from __future__ import annotations

import datetime
import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline import schemas
from groundline.errors import FetchError, SourceValidationError
from groundline.functions import text as tx
from groundline.settings import DEFAULT, Settings

TRANSIENT = (408, 425, 429, 500, 502, 503, 504)


def allowed_url(url, settings: Settings = DEFAULT):
    """Scheme and host (in lower case) are allowed and the path names a page."""
    part = lambda p: F.call_function("try_parse_url", url, F.lit(p))
    ok = part("PROTOCOL").isin(*settings.allowed_schemes) & F.lower(part("HOST")).isin(*settings.allowed_hosts) & ~F.coalesce(part("PATH"), F.lit("")).isin("", "/")
    return F.coalesce(ok, F.lit(False))


def source_violations(sources: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """rule and value of everything that breaks the rules of the allowlist; schemes come before urls."""
    names = schemas.SOURCES.names
    blank = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(c)) for c in names]))
    out = sources.filter(F.size(blank) > 0).select(F.lit("1 blank").alias("rule"), F.array_join(blank, ",").alias("value"))
    for i, c in enumerate(("scheme", "url")):
        out = out.unionByName(sources.groupBy(c).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(f"{i + 2} duplicate {c}").alias("rule"), F.col(c).alias("value")))
    return out.unionByName(sources.filter(~allowed_url(F.col("url"), settings)).select(F.lit("4 url").alias("rule"), F.col("url").alias("value")))


def read_sources(spark: SparkSession, path: str, settings: Settings = DEFAULT) -> DataFrame:
    """The allowlist from CSV, trimmed; any violation raises."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    header = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if missing := [c for c in schemas.SOURCES.names if c not in [h.strip() for h in header.columns]]:
        raise SourceValidationError(f"columns are missing: {', '.join(missing)}")
    plain = ", ".join(f"`{c}` string" for c in header.columns)
    rows = spark.read.schema(plain).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    rows = rows.select(*[F.trim(F.col(f"`{next(h for h in header.columns if h.strip() == c)}`")).alias(c) for c in schemas.SOURCES.names])
    try:
        if rows.isEmpty():
            raise SourceValidationError("there are no sources")
        found = source_violations(rows, settings).orderBy("rule").take(5)
    except (PySparkException, Py4JJavaError) as e:
        raise SourceValidationError("a row has more fields than the header") from e
    if found:
        raise SourceValidationError("; ".join(f"{r['rule'][2:]}: {r['value']}" for r in found))
    return rows


def now() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def check_url(url: str | None, settings: Settings = DEFAULT) -> None:
    """What `allowed_url` asks for, of one url before it is requested."""
    from urllib.parse import urlsplit

    try:
        parts = urlsplit(url or "")
        ok = parts.scheme in settings.allowed_schemes and (parts.hostname or "") in settings.allowed_hosts and parts.path not in ("", "/")
    except ValueError:
        ok = False
    if not ok:
        raise SourceValidationError(f"{url} is not allowed")


def http_get(url: str, settings: Settings = DEFAULT) -> tuple[int, str, bytes]:
    import urllib.error
    import urllib.request

    class Checked(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, request, file, code, said, headers, new):
            check_url(new, settings)
            return super().redirect_request(request, file, code, said, headers, new)

    try:
        with urllib.request.build_opener(Checked).open(urllib.request.Request(url, headers={"User-Agent": settings.http_agent}), timeout=settings.http_timeout_s) as r:
            return r.status, r.headers.get("Content-Type", ""), r.read()
    except urllib.error.HTTPError as e:
        return e.code, "", b""


def fetch(url: str, get: Callable[[str], tuple[int, str, bytes]] | None = None, settings: Settings = DEFAULT, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A page by HTTP: tried again after a broken connection or a transient status; anything but a page of HTML raises.

    No url is asked for that the settings do not allow, nor is a redirection to one followed.
    """
    check_url(url, settings)
    began, last = time.monotonic(), ""
    for attempt in range(1, settings.http_retries + 2):
        try:
            status, kind, body = (get or (lambda u: http_get(u, settings)))(url)
            if status == 200:
                base = kind.partition(";")[0].strip().lower()
                if base not in settings.html_types:
                    raise FetchError(f"{url}: content type {base!r}")
                text = body.decode("utf-8", "replace")
                if not text.strip():
                    raise FetchError(f"{url}: empty page")
                return {"url": url, "status": status, "content_type": base, "n_bytes": len(body), "fetched_at": now(), "elapsed_ms": 1000 * (time.monotonic() - began), "attempts": attempt, "cached": False, "html": text}
            last = f"status {status}"
            if status not in TRANSIENT:
                break
        except OSError as e:
            last = str(e)
        if attempt <= settings.http_retries:
            sleep(settings.http_backoff_s * attempt)
    raise FetchError(f"{url}: {last}")


FETCHED_PAGES = "url string, scheme string, scheme_name string, category string, status int, content_type string, n_bytes int, fetched_at string, elapsed_ms double, attempts int, cached boolean, html_path string, html string"


def fetch_all(sources: DataFrame, path: str, cached: DataFrame | None = None, get: Callable | None = None, settings: Settings = DEFAULT, sleep: Callable[[float], None] = time.sleep, strict: bool = True, resume: bool = False) -> DataFrame:
    """Pages of all sources, from the cache first, written to `path`.

    Each host is asked by one task, one page after another in the order of the sources, with a pause between requests; hosts do not wait for
    each other.  A failure ends the job, or without `strict` gives a row with its error and leaves the others.  With `resume` the pages that an
    earlier call has written stay, and only the others are asked for.
    """
    import pandas as pd

    spark = sources.sparkSession
    rows = sources.select("url", "scheme", "scheme_name", "category", F.monotonically_increasing_id().alias("place"))
    if resume and path_exists(spark, path):
        rows = rows.join(spark.read.parquet(path).filter("error is null").select("url"), "url", "left_anti")
    fields = ("status", "content_type", "n_bytes", "fetched_at", "elapsed_ms", "attempts", "cached", "html")
    if cached is not None:
        rows = rows.join(cached.select("url", *fields), "url", "left")
    host = F.lower(F.coalesce(F.expr("try_parse_url(url, 'HOST')"), F.lit("")))
    ordered, none = rows.withColumn("host", host).repartition("host").sortWithinPartitions("host", "place"), cached is None

    def run(batches):
        last = None
        for b in batches:
            for r in b.to_dict("records"):
                got, error = r, None
                if none or not isinstance(r["html"], str):
                    try:
                        check_url(r["url"], settings)
                        if r["host"] == last:
                            sleep(settings.http_delay_s)
                        last = r["host"]
                        got = fetch(r["url"], get, settings, sleep)
                    except (FetchError, SourceValidationError) as e:
                        if strict:
                            raise
                        got, error = {}, str(e)
                page = {k: r[k] for k in ("url", "scheme", "scheme_name", "category")} | {k: got.get(k) for k in fields} | {"html_path": f"raw_{r['scheme']}.html", "error": error}
                yield pd.DataFrame([page])

    ordered.mapInPandas(run, f"{FETCHED_PAGES}, error string").write.mode("append" if resume else "overwrite").parquet(path)
    every = spark.read.parquet(path)
    pages = every.filter("error is null")
    if strict:
        return pages.drop("error")
    # an error that a later call has made good is none
    return pages.unionByName(every.filter("error is not null").dropDuplicates(["url"]).join(pages.select("url"), "url", "left_anti"))


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Ids of registered segments, from a CSV with a header that names a column id."""
    return spark.read.option("header", True).csv(path).select(F.trim("id").alias("id")).filter("id <> ''")


def sources_payload(sources: DataFrame) -> DataFrame:
    """What a client is told about each source, as JSON."""
    fields = ("scheme", "scheme_name", "category", "url")
    return sources.select("scheme", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def cached_pages(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages kept as files (url, content, modificationTime): blank ones are none; the stamp is the manifest's or the file's.

    Bytes that are no UTF-8 become replacement characters.
    """
    html = F.call_function("make_valid_utf8", F.col("content").cast("string"))
    stamp = F.coalesce(F.col("m.fetched_at"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = files.alias("f").join(manifest.select("url", "fetched_at").alias("m"), "url", "left").filter(F.length(tx.strip(html)) > 0)
    return rows.select("url", html.alias("html"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.length("content").alias("n_bytes"), stamp.alias("fetched_at"), F.lit(0.0).alias("elapsed_ms"), F.lit(0).alias("attempts"), F.lit(True).alias("cached"))


def latest_fetched() -> Column:
    """Aggregate: the latest stamp of pages that did not come from the cache, else of all, else an empty text."""
    own = F.max(F.when(~F.col("cached"), F.col("fetched_at")))
    return F.coalesce(own, F.max("fetched_at"), F.lit(""))


def manifest(fetched: DataFrame) -> DataFrame:
    """One row: the latest stamp of pages that did not come from the cache, else of all; and the rows."""
    fields = [c for c in schemas.FETCHED.names if c in fetched.columns]
    return fetched.agg(F.count("*").alias("n_sources"), latest_fetched().alias("latest_fetched_at"), F.sort_array(F.collect_list(F.struct(*fields))).alias("sources")).withColumn("built_at", F.lit(now()))


def read_manifest(spark: SparkSession, path: str, html_folder: str | None = None) -> DataFrame | None:
    """Rows of a manifest, if it has any and all its files exist; else nothing, and pages must be fetched again."""
    rows = spark.read.option("multiLine", True).json(path)
    if "sources" not in rows.columns:
        return None
    rows = rows.select(F.explode("sources").alias("s")).select("s.*")
    if rows.isEmpty():
        return None
    if html_folder is not None:
        have = spark.read.format("binaryFile").load(html_folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
        if not rows.select(F.element_at(F.split("html_path", "/"), -1).alias("name")).join(have, "name", "left_anti").isEmpty():
            return None
    return rows


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One object for each line, in the order of the corpus: by source (its place, if the column is there, else its url), then ordinal."""
    chunks.orderBy("source_pos" if "source_pos" in chunks.columns else "source_url", "ordinal").write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHUNKS).json(path)


def save_atomically(value: dict, path: str) -> None:
    with open(temporary := f"{path}.{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False)
    os.replace(temporary, path)
