import duckdb
import pytest

from groundline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_gives_a_row_for_each_row(spark, sf_dir, name):
    rows = queries.QUERIES[name](spark, sf_dir)
    table = "pages" if name in ("op8_url_filter", "op9_html", "op12_warc") else "embeddings" if name == "op11_clusters" else "documents"
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert rows.count() >= n if name == "op1_packing" else rows.count() == n
