import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from groundline.errors import FetchError, SourceValidationError
from groundline.functions.logs import StageLog, counted
from groundline.settings import Settings
from groundline.sources import tables
from groundline.streaming.questions import answer_stream

HEAD = "url,scheme,scheme_name,category\n"
GOOD = HEAD + "https://example.com/a, a ,A,c\nhttps://example.com/b,b,B,c\n"


def csv(tmp_path, text):
    (tmp_path / "s.csv").write_text(text)
    return str(tmp_path / "s.csv")


def test_sources(spark, tmp_path):
    assert sorted(tuple(r) for r in tables.read_sources(spark, csv(tmp_path, GOOD)).collect())[0] == ("https://example.com/a", "a", "A", "c")


@pytest.mark.parametrize(
    "text",
    [HEAD, "url,scheme\nx,y\n", HEAD + "https://example.com/a,a,,c\n", HEAD + "https://example.com/a,a,A,c\nhttps://example.com/b,a,B,c\n", HEAD + "https://example.com/a,a,A,c\nhttps://example.com/a,b,B,c\n", HEAD + "http://example.com/a,a,A,c\n", HEAD + "https://other.com/a,a,A,c\n", HEAD + "https://example.com/,a,A,c\n", HEAD + "https://example.com/a,a,A,c,extra\n"],
)
def test_bad_sources(spark, tmp_path, text):
    with pytest.raises(SourceValidationError):
        tables.read_sources(spark, csv(tmp_path, text))


def test_fetch_tries_again():
    replies = iter([(503, "", b""), (200, "text/html; charset=utf-8", b"<p>x</p>")])
    waits = []
    got = tables.fetch("https://example.com/u", lambda _: next(replies), sleep=waits.append)
    assert got["attempts"] == 2 and waits == [1.5]
    for reply in ((404, "", b""), (200, "image/png", b"x"), (200, "text/html", b"  "), (500, "", b"")):
        with pytest.raises(FetchError):
            tables.fetch("https://example.com/u", lambda _, r=reply: r, sleep=lambda _: None)


def test_no_url_is_asked_for_that_is_not_allowed():
    def never(url):
        raise AssertionError("asked")

    for url in ("https://foreign.net/x", "http://example.com/x", "https://example.com/", "https://example.com", "https://[", "", None, "https://example.com.evil.net/x", "https://evil@foreign.net/x"):
        with pytest.raises(SourceValidationError):
            tables.fetch(url, never)
    tables.check_url("https://EXAMPLE.com/x?y")


def test_redirections_are_checked():
    import http.server
    import threading

    class Away(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            away = self.path.startswith("/away")
            self.send_response(302 if away else 200)
            self.send_header("Location" if away else "Content-Type", "http://foreign.invalid/x" if away else "text/html")
            self.end_headers()
            self.wfile.write(b"" if away else b"<p>here</p>")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Away)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, settings = f"http://127.0.0.1:{server.server_port}", Settings(allowed_schemes=("http",), allowed_hosts=("127.0.0.1",))
    assert tables.fetch(f"{base}/page", settings=settings)["html"] == "<p>here</p>"
    with pytest.raises(SourceValidationError, match="foreign.invalid"):
        tables.fetch(f"{base}/away", settings=settings)
    server.shutdown()


def test_a_url_that_fails_leaves_the_others_and_is_asked_again(spark, tmp_path):
    settings = Settings(allowed_hosts=("a.com", "b.com"))
    rows = [(f"https://{h}/{i}", f"{h}{i}", "n", "c") for i in range(3) for h in ("a.com", "b.com", "c.com")]
    sources, path = spark.createDataFrame(rows, "url string, scheme string, scheme_name string, category string"), str(tmp_path / "pages")
    asked, waits = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def get(url):
        asked.add(1)
        return (404, "", b"") if url == "https://a.com/1" else (200, "text/html", url.encode())

    first = {r["url"]: r for r in tables.fetch_all(sources, path, None, get, settings, sleep=lambda s: waits.add(1), strict=False).collect()}
    assert len(first) == 9 and asked.value == 6 and waits.value == 4  # two hosts of three pages each
    assert {u for u, r in first.items() if r["error"]} == {"https://a.com/1"} | {u for u, *_ in rows if "c.com" in u} and "404" in first["https://a.com/1"]["error"]
    again = {r["url"]: r for r in tables.fetch_all(sources, path, None, lambda u: (200, "text/html", b"late"), settings, sleep=lambda s: None, strict=False, resume=True).collect()}
    assert len(again) == 9 and again["https://a.com/1"]["html"] == "late" and again["https://b.com/1"]["html"] == "https://b.com/1" and again["https://c.com/0"]["error"]
    with pytest.raises(Exception, match="status 404"):
        tables.fetch_all(sources.filter("url like 'https://a%'"), path, None, get, settings, sleep=lambda s: None)


def test_fetch_all_and_manifest(spark, tmp_path):
    sources = tables.read_sources(spark, csv(tmp_path, GOOD))
    got = tables.fetch_all(sources, str(tmp_path / "pages"), None, lambda u: (200, "text/html", u.encode()), sleep=lambda _: None)
    assert [r["html"] for r in got.orderBy("url").collect()] == ["https://example.com/a", "https://example.com/b"]
    row = tables.manifest(got).first()
    assert row["n_sources"] == 2 and row["latest_fetched_at"] == max(r["fetched_at"] for r in got.collect())
    tables.write_json(tables.manifest(got), str(tmp_path / "m"))
    assert tables.read_manifest(spark, str(tmp_path / "m")).count() == 2
    cached = tables.manifest(got.withColumn("cached", F.lit(True))).first()
    assert cached["latest_fetched_at"] == row["latest_fetched_at"]


def test_cached_pages(spark):
    files = spark.createDataFrame([("a", b"plain"), ("b", b"caf\xe9 \xe2\x82"), ("c", b" \n"), ("d", "é".encode())], "url string, content binary").withColumn("modificationTime", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    manifest = spark.createDataFrame([("a", "2024-05-05T00:00:00Z")], "url string, fetched_at string")
    got = {r["url"]: (r["html"], r["fetched_at"], r["n_bytes"]) for r in tables.cached_pages(files, manifest).collect()}
    assert got == {"a": ("plain", "2024-05-05T00:00:00Z", 5), "b": (b"caf\xe9 \xe2\x82".decode("utf-8", "replace"), "2024-01-02T03:04:05Z", 7), "d": ("é", "2024-01-02T03:04:05Z", 2)}


def test_cached_pages_are_not_fetched(spark, tmp_path):
    sources = tables.read_sources(spark, csv(tmp_path, GOOD))
    files = spark.createDataFrame([("https://example.com/a", b"kept")], "url string, content binary").withColumn("modificationTime", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    kept = tables.cached_pages(files, spark.createDataFrame([], "url string, fetched_at string"))

    def get(url):
        if url.endswith("a"):
            raise AssertionError("asked for a page that is kept")
        return 200, "text/html", b"new"

    got = tables.fetch_all(sources, str(tmp_path / "pages"), kept, get, sleep=float)
    assert [(r["html"], r["cached"], r["attempts"]) for r in got.orderBy("url").collect()] == [("kept", True, 0), ("new", False, 1)]


def test_registry(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,type\n 1-2 ,x\n,y\n")
    assert [r["id"] for r in tables.read_registry(spark, str(tmp_path / "r.csv")).collect()] == ["1-2"]


def test_logs(spark):
    assert StageLog("s").line("e", a=None, b=True, c=1.234, d="x y") == "stage=s event=e a=- b=true c=1.23 d=x_y"
    df, seen = counted(spark.range(7), "n")
    df.collect()
    assert seen.get["rows"] == 7


def test_stream(spark, tmp_path):
    from groundline.operators import embed

    s = Settings(embed_dim=16)
    text = spark.createDataFrame([("c", "hello there", "x", "elss", "E", "c", "https://example.com/e", "2024", ["x"])], "chunk_id string, text string, section string, scheme string, scheme_name string, category string, source_url string, fetched_at string, heading_path array<string>")
    table = embed.embed_texts(text, "text", embed.hashing_embedder(16), s)[0]
    spark.createDataFrame([("1", "hello there"), ("2", "should i")], "query_id string, question string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id string, question string").json(str(tmp_path / "in"))
    answer_stream(stream, table, str(tmp_path / "out"), str(tmp_path / "check"), settings=s).awaitTermination(120)
    assert {r["query_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"1", "2"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_match_their_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    from groundline import catalog

    plain = lambda v: round(float(v), 6) if isinstance(v, float) or hasattr(v, "quantize") else v
    for name, sql in catalog.ORACLE.items():
        df = catalog.QUERIES[name](spark, sf_dir)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns), name
        got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
        assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str), name
