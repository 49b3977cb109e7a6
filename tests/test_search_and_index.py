import dataclasses
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundline.errors import EmbeddingError, EmptyCollectionError, GenerationError, GeneratorNotConfiguredError, IndexVerificationError, MissingCollectionError, ModelMismatchError, RetrievalError
from groundline.operators import chunks, embed, index, retrieve, rewrite
from groundline.plans.answer import answer, ask_payload, failure_status, valid_requests
from groundline.plans.build import build_index
from groundline.session import release
from groundline.settings import Settings

S = Settings(embed_dim=64, allowed_hosts=("example.com",), scheme_urls=(("elss", "https://example.com/elss"),), max_distance=0.8)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    pages = [("https://example.com/elss", "<body><h1>Tax saver</h1><h2>Exit load</h2><p>The exit load of the tax saver is nil after three years.</p></body>", "elss", "Tax Saver", "equity", "2024-01-02T00:00:00Z"), ("https://example.com/small", "<body><h1>Small cap</h1><p>The expense ratio of the small cap scheme is one percent.</p></body>", "small_cap", "Small Cap", "equity", "2024-01-01T00:00:00Z")]
    raw = spark.createDataFrame(pages, "url string, html string, scheme string, scheme_name string, category string, fetched_at string")
    paths = build_index(raw, raw.select("url"), folder, settings=S)
    return paths, retrieve.open_index(spark, paths["index"], S)


def test_build_and_meta(spark, built):
    paths, table = built
    assert table.count() == 2
    assert index.corpus_meta(table).first()["last_updated"] == "2024-01-02T00:00:00Z"
    embed.assert_compatible(spark.read.parquet(paths["index_meta"]), S)
    with pytest.raises(ModelMismatchError):
        embed.assert_compatible(spark.read.parquet(paths["index_meta"]), Settings(embed_dim=8))
    with pytest.raises(ModelMismatchError):
        retrieve.open_index(spark, paths["index"])
    assert index.dump_lines(table).count() > 4 and index.table_of_contents(table).count() == 2
    near = index.dump_lines(table, retrieve.all_neighbours(table)).filter("line like '  near: %'")
    assert near.count() == 2
    assert {r["name"]: r["value"] for r in index.dump_header(table, S).collect()}["chunks"] == "2"


def test_build_reuses_the_cache(spark, built, tmp_path):
    paths, _ = built
    raw, seen = spark.read.parquet(paths["raw_html"]), spark.sparkContext.accumulator(0)

    def embedder(texts):
        seen.add(len(texts))
        return embed.hashing_embedder(64)(texts)

    folder = str(tmp_path / "again")
    build_index(raw, raw.select("url"), folder, embedder, S)
    assert seen.value == 2 and spark.read.parquet(f"{folder}/embedding_cache").count() == 2
    build_index(raw, raw.select("url"), folder, embedder, S)
    assert seen.value == 2 and spark.read.parquet(f"{folder}/embedding_cache").count() == 2


def test_status_of_failures():
    assert failure_status(MissingCollectionError("x"))[0] == failure_status(ModelMismatchError("x"))[0] == failure_status(OSError())[0] == 503
    assert failure_status(GeneratorNotConfiguredError("x")) == (503, "The language model is not available.") and failure_status(KeyError("x"))[0] == 500


def test_links_of_all_items_match_plain_python(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(70, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(70)], "vec_id long, embedding array<double>")
    near = v @ v.T > 0.5
    for blocks in (1, 5):
        got = {x["vec_id"]: (x["n_links"], x["least_link"]) for x in retrieve.similar_links(table, 0.5, "vec_id", blocks, 400).collect()}
        assert got == {i: (int(near[i].sum()) - 1, int(np.flatnonzero(near[i])[0])) for i in range(70)}
    assert retrieve.similar_links(table.limit(0), 0.5, "vec_id").count() == 0 and retrieve.top_k(table.withColumnRenamed("vec_id", "query_id"), table.limit(0), 3, item_id="vec_id").count() == 0


def test_verify_finds_differences(spark, built):
    paths, table = built
    with pytest.raises(IndexVerificationError, match="missing"):
        index.verify(table.limit(1), spark.read.parquet(paths["chunks"]), spark.createDataFrame([("https://example.com/elss",)], "url string"), S)


def test_errors_of_opening(spark, tmp_path):
    with pytest.raises(MissingCollectionError):
        retrieve.open_index(spark, str(tmp_path / "none"))
    spark.createDataFrame([], "a int").write.parquet(str(tmp_path / "empty"))
    with pytest.raises(EmptyCollectionError):
        retrieve.open_index(spark, str(tmp_path / "empty"))


def test_answers(spark, built):
    _, table = built
    asked = [("1", "What is the exit load of the tax saver?"), ("2", "should i buy it"), ("3", "my pan is ABCDE1234F"), ("4", "zzz qqq"), ("5", ""), ("6", "the cagr please")]
    questions = spark.createDataFrame(asked, "query_id string, question string")
    calls = spark.sparkContext.accumulator(0)

    def generator(prompts):
        calls.add(len(prompts))
        return ["The tax saver has no load after three years. https://example.com/elss" for _ in prompts]

    got = {r["query_id"]: r for r in answer(questions, table, generator=generator, settings=S).collect()}
    assert sorted(got) == ["1", "2", "3", "4", "5", "6"]
    assert got["1"]["refusal_type"] is None and got["1"]["answer"].endswith("Last updated from sources: 2024-01-02T00:00:00Z") and len(got["1"]["citations"]) == 1
    assert [got[i]["refusal_type"] for i in "2345"] == ["advice", "pii", "out_of_corpus", "out_of_corpus"] and got["6"]["refusal_type"] == "performance"
    assert all(not got[i]["llm_called"] and not got[i]["citations"] for i in "23456") and calls.value >= 1
    shown = {r["query_id"]: r["payload"] for r in ask_payload(answer(questions, table, settings=S), questions).collect()}
    assert "ABCDE1234F" not in shown["3"] and "[redacted]" in shown["3"]
    assert [r["error"] for r in valid_requests(spark.createDataFrame([(None,), (" ",), ("ok",), ("x" * 4001,)], "question string")).collect()] == ["missing", "blank", None, "too long"]


def test_traces(spark, built):
    _, table = built
    asked = [("1", "What is the exit load of the tax saver?"), ("2", "should i buy it"), ("3", "my pan is ABCDE1234F"), ("4", "zzz qqq")]
    questions, used = spark.createDataFrame(asked, "query_id string, question string"), []
    answers = answer(questions, table, settings=S, used=used)
    shown = {r["query_id"]: json.loads(r["payload"])["trace"] for r in ask_payload(answers, questions).collect()}
    assert shown["1"]["guards"] == {"action": "answer", "refusal_type": None, "matched_names": []} and shown["1"]["filter"] == "elss" and shown["1"]["llm_called"]
    assert shown["1"]["expanded_query"].startswith("what is the exit load of the tax saver? exit charge") and all("distance" in h for h in shown["1"]["hits"])
    assert shown["2"]["guards"]["refusal_type"] == "advice" and shown["3"]["guards"]["matched_names"] == ["pan"] and shown["2"]["expanded_query"] == "" and shown["4"]["filter"] is None
    assert set(shown["1"]["timings_ms"]) == {"guards", "retrieve", "gate", "generate"} and min(shown["1"]["timings_ms"].values()) >= 0
    paths = [t.written_at.removeprefix("file:") for t in used]
    assert len(paths) == 5 and all(map(os.path.isdir, paths))
    release(*used)
    assert not any(map(os.path.isdir, paths))


def test_failed_generations_have_rows(spark, built):
    _, table = built
    questions = spark.createDataFrame([("1", "What is the exit load of the tax saver?"), ("2", "What is the expense ratio of the small cap scheme?")], "query_id string, question string")

    def generator(prompts):
        if "exit load" in prompts[0].partition("BEGIN QUESTION")[2]:
            raise GenerationError("status 503")
        return ["One percent. https://example.com/small"]

    settings = dataclasses.replace(S, llm_wait_s=0.01)
    got = {r["query_id"]: r for r in answer(questions, table, generator=generator, settings=settings).collect()}
    assert got["1"]["error"] == "status 503" and got["1"]["answer"] == "The language model is not available." and not got["1"]["refusal"] and not got["1"]["citations"]
    assert got["2"]["error"] is None and got["2"]["answer"].startswith("One percent.")
    with pytest.raises(Exception, match="status 503"):
        answer(questions, table, generator=generator, settings=settings, strict=True).collect()


def test_probe_report(spark, built):
    _, table = built
    questions = spark.createDataFrame([("1", "What is the exit load of the tax saver?"), ("2", "anything")], "query_id string, question string")
    vectors = lambda rows, column: embed.embed_texts(rows, column, embed.hashing_embedder(64), S)[0]
    found = retrieve.retrieve(questions.filter("query_id = '1'"), table, vectors, S)
    lines = {}
    for r in retrieve.probe_report(questions, found, S).orderBy("query_id", "line_no").collect():
        lines.setdefault(r["query_id"], []).append(r["line"])
    assert lines["2"] == ["question: anything", "expanded: anything", "scheme filter: none", "gate: FAIL (best_distance=n/a limit=0.8 aggregation=min)", "", "no hits"]
    hit = found.orderBy("rank").first()
    assert lines["1"][:3] == ["question: What is the exit load of the tax saver?", f"expanded: {hit['expanded_query']}", "scheme filter: elss"] and lines["1"][3].startswith(f"gate: PASS (best_distance={hit['distance']:.4f}")
    assert lines["1"][5:7] == [f"1. d={hit['distance']:.4f} {hit['chunk_id']} [elss] {hit['section']}", "   https://example.com/elss"] and "exit load" in lines["1"][7]


def test_two_forms_of_a_question_keep_the_best_of_both(spark):
    """The four kinds of question that one vector fails on: the long name of a scheme drowns a short value, or its lack leaves too little."""
    name = "Acme Balanced Advantage Fund - Direct Growth"
    texts = {"c1": f"{name} about the fund house, its manager, history, objective and benchmark of record", "c2": "exit load: nil", "c3": "expense ratio of the plan", "c4": "minimum sip amount is 100"}
    rows = [(k, t, "s", "balanced_advantage", "B", "c", "https://example.com/b", "2024", ["s"]) for k, t in texts.items()]
    items = spark.createDataFrame(rows, "chunk_id string, text string, section string, scheme string, scheme_name string, category string, source_url string, fetched_at string, heading_path array<string>")
    s = dataclasses.replace(S, brand="Acme", top_k=3, synonyms=())
    table = embed.embed_texts(items, "text", embed.hashing_embedder(64), s)[0].persist()
    said = [("1", "exit load balanced advantage"), ("2", "the exit load on balanced advantage?"), ("3", f"Exit load of {name}?"), ("4", f"What is the benchmark of {name}?")]
    questions = spark.createDataFrame(said, "query_id string, question string")
    vectors = lambda rows, column: embed.embed_texts(rows, column, embed.hashing_embedder(64), s)[0]
    best = lambda q, settings: {r["query_id"]: r for r in retrieve.retrieve(q, table, vectors, settings).filter("rank = 1").collect()}
    whole, both = best(questions, s), best(questions, dataclasses.replace(s, dual_query=True))
    bare = best(questions.select("query_id", rewrite.without_scheme(F.col("question"), s).alias("question"), F.lit("balanced_advantage").alias("scheme")), s)
    for q in "1234":
        assert both[q]["distance"] == min(whole[q]["distance"], bare[q]["distance"]) and both[q]["filter"] == "balanced_advantage"
    assert [both[q]["chunk_id"] for q in "1234"] == ["c2", "c2", "c2", "c1"] and whole["3"]["chunk_id"] == "c1" and bare["4"]["distance"] > whole["4"]["distance"]
    ranks = retrieve.retrieve(questions, table, vectors, dataclasses.replace(s, dual_query=True)).groupBy("query_id").agg(F.count_distinct("chunk_id"), F.max("rank")).collect()
    assert all(tuple(r)[1:] == (3, 3) for r in ranks)


@pytest.mark.parametrize(("distances", "how", "want"), [([], "min", False), ([0.1, 0.6], "min", True), ([0.65, 0.7], "min", False), ([0.1, 0.6], "max", False), ([0.1, 0.4], "max", True), ([0.57], "min", True), ([0.571], "min", False)])
def test_gate(spark, distances, how, want):
    q = spark.createDataFrame([("q",)], "query_id string")
    found = spark.createDataFrame([("q", d) for d in distances], "query_id string, distance double")
    assert retrieve.gate(q, found, 0.57, how).first()["passes_gate"] is want
    with pytest.raises(RetrievalError):
        retrieve.gate(q, found, 0.57, "median")


def test_top_k_and_greedy_dedupe_match_plain_python(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 8))
    v[10:20] = v[0:10] + 0.01
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, [float(x) for x in v[i]], i % 3) for i in range(60)], "vec_id long, embedding array<double>, label int")
    q = table.filter("vec_id < 7").withColumnRenamed("vec_id", "query_id").withColumn("label", F.expr("if(query_id = 6, null, label)"))
    got = retrieve.top_k(q, table, 8, item_id="vec_id", filter_col="label")
    lists = {}
    for row in got.orderBy("query_id", "rank").collect():
        lists.setdefault(row["query_id"], []).append(row["vec_id"])
    for i in range(7):
        allowed = [j for j in range(60) if i == 6 or j % 3 == i % 3]
        assert lists[i] == sorted(allowed, key=lambda j: (round(1 - float(v[i] @ v[j]), 12), j))[:8]
    kept = {}
    for row in retrieve.greedy_dedupe(got, table, 0.9, item_id="vec_id").orderBy("query_id", "rank").collect():
        kept.setdefault(row["query_id"], []).append(row["vec_id"])
    for i in range(7):
        want = []
        for j in lists[i]:
            if all(float(v[j] @ v[k]) <= 0.9 for k in want):
                want.append(j)
        assert kept[i] == want


def test_budget_keeps_the_best(spark):
    rows = spark.createDataFrame([("q", 1, 50), ("q", 2, 5), ("r", 1, 10), ("r", 2, 20), ("r", 3, 30)], "query_id string, rank int, tokens int")
    got = {(r["query_id"], r["rank"]) for r in retrieve.within_budget(rows, 40).collect()}
    assert got == {("q", 1), ("r", 1), ("r", 2)}


def test_each_text_is_encoded_once_and_cached(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "i int, t string")
    seen = spark.sparkContext.accumulator(0)

    def embedder(texts):
        seen.add(len(texts))
        return embed.hashing_embedder(64)(texts)

    out, fresh = embed.embed_texts(rows, "t", embedder, S)
    got = {r["i"]: r["embedding"] for r in out.collect()}
    assert got[1] == got[2] and seen.value == 2
    cache = spark.createDataFrame(fresh.collect(), fresh.schema)
    before = seen.value
    assert embed.embed_texts(rows, "t", embedder, S, cache)[0].count() == 3 and seen.value == before
    stats = embed.cache_stats(rows, "t", cache.filter("text_key = sha1('c')"), S).first()
    assert (stats["requested"], stats["hits"], stats["misses"], stats["rows_cached"]) == (3, 1, 1, 1)
    with pytest.raises(Exception, match="blank"):
        embed.embed_texts(spark.createDataFrame([(1, " ")], "i int, t string"), "t", embedder, S)[0].collect()


def test_prune(tmp_path):
    good, orphan = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"
    for name in (good, orphan, "notes"):
        os.mkdir(tmp_path / name)
        (tmp_path / name / "x").write_bytes(b"12345")
    assert index.prune_orphans(str(tmp_path), None) == []
    assert index.prune_orphans(str(tmp_path), {good}) == [f"{orphan}:5"]
    assert sorted(os.listdir(tmp_path)) == [good, "notes"]


def clustered(n, dim, centres, seed=7, spread=0.05):
    r = np.random.default_rng(seed)
    v = r.normal(size=(centres, dim))[r.integers(0, centres, n)] + spread * r.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vector_table(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("v", [clustered(300, 6, 12), clustered(150, 6, 150), np.repeat(clustered(3, 6, 3), 20, axis=0) * np.linspace(0.5, 3, 60)[:, None]], ids=["clusters", "spread", "repeated and of other lengths"])
def test_pruned_joins_equal_comparing_all(spark, v):
    table, products = vector_table(spark, v), v @ v.T
    ids = np.arange(len(v))
    for pivot_count, block_bytes in ((1, 1 << 20), (9, 700)):
        got = {r["vec_id"]: (r["n_links"], r["least_link"]) for r in retrieve.similar_links(table, 0.9, "vec_id", pivot_count, block_bytes).collect()}
        near = (products > 0.9) | np.eye(len(v), dtype=bool)
        assert got == {i: (int(near[i].sum()) - 1, int(np.flatnonzero(near[i])[0])) for i in ids.tolist()}
        lists = {}
        for r in retrieve.all_neighbours(table, 3, "vec_id", pivot_count, block_bytes).orderBy("query_id", "rank").collect():
            lists.setdefault(r["query_id"], []).append((r["neighbour"], round(r["distance"], 9)))
        for i in ids.tolist():
            exact = [1.0 - float(np.cumsum(v[i] * v[j])[-1]) for j in ids]
            want = sorted((j for j in ids.tolist() if j != i), key=lambda j: (exact[j], j))[:3]
            assert lists[i] == [(j, round(max(0.0, exact[j]), 9)) for j in want]


def test_blocks_beyond_the_bound_are_skipped_and_tasks_stay_small(spark):
    from groundline.operators import pivots

    sizes = []
    for n in (300, 900):
        dealt = pivots.deal(vector_table(spark, clustered(n, 6, 12)), "vec_id", 12, 6 * 8 * 20)
        met = pivots.meeting(dealt.items.withColumn("_limit", F.lit(0.95)), dealt)
        out, every = pivots.skipped(met, dealt)
        assert out > 0.8 * every == 0.8 * n * 12 and met.filter("_p = _q").count() == n
        sizes.append(dealt.items.groupBy("_p", "_s").count().agg(F.max("count")).first()[0])
    assert max(sizes) <= 2 * 20  # a slice's rows do not grow with the table's


def test_a_vector_is_sent_once_for_each_block_whatever_the_pivots(spark):
    from groundline.operators import pivots

    v = clustered(600, 6, 600)
    table = vector_table(spark, v)
    for pivot_count, block_rows in ((4, 100), (64, 100), (64, 600)):
        dealt = pivots.deal(table, "vec_id", pivot_count, 6 * 8 * block_rows)
        met = pivots.reached(dealt.items.withColumn("_limit", F.lit(-2.0)), dealt)
        got = met.select("_b", pivots.wanted(dealt).alias("w")).collect()
        blocks = {r["_b"] for r in got}
        assert len(got) == 600 and len(blocks) <= 2 * 600 // block_rows + 3 and all(blocks <= set(r["w"]) for r in got)
        assert max(sum(r["_b"] == k for r in got) for k in blocks) <= 1.6 * block_rows


def test_rows_meet_unlisted_urls_without_their_texts(spark):
    urls = ["https://example.com/a"] * 5 + ["https://example.com/b", None]
    rows = spark.createDataFrame([(f"c{k}", u, "a long text") for k, u in enumerate(urls)], "chunk_id string, source_url string, text string")
    sources = rows.select(F.col("source_url").alias("url")).filter("url like '%/a'")
    found = index.row_problems(rows, sources, Settings(allowed_schemes=("https",), allowed_hosts=("example.com",), broadcast_bytes=-1))
    got = sorted((r["problem"], r["id"]) for r in found.collect() if not r["problem"].startswith("metadata"))
    assert got == [("url not allowed", "c6"), ("url not in the sources", "c5"), ("url not in the sources", "c6")]
    plan = found._jdf.queryExecution().optimizedPlan()
    join = next(p for p in (plan.apply(k) for k in range(9)) if p.nodeName() == "Join")
    assert "text" not in [a.name() for a in (join.left().output().apply(k) for k in range(join.left().output().size()))]


def test_workers_give_no_vector_twice_and_no_text(spark):
    from groundline.operators import lists

    v = clustered(400, 6, 400)
    table = vector_table(spark, v)
    quantiser = lists.fit(table, "vec_id", 40)
    opened = lists.Lists(table, quantiser, np.ones(len(quantiser.centres), int))
    asked = table.select(F.col("vec_id").alias("_q"), F.col("embedding").alias("_v"), F.lit(None).cast("string").alias("_g"))
    met = lists.probed(asked, opened, 30, "bigint")
    assert met.count() == 400 * 30 and met.select("_q", "_l").distinct().count() == 400 * 30
    of_python = lambda frame: [x for x in frame._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapIn" in x]
    assert "_l" in of_python(met)[0] and "Generate" in met._jdf.queryExecution().optimizedPlan().toString()
    texts = spark.createDataFrame([(k, f"text {k % 7}") for k in range(50)], "k long, text string").repartition(2)
    out, fresh = embed.embed_texts(texts, "text", embed.hashing_embedder(16), Settings(embed_dim=16, embed_batch=3))
    assert out.count() == 50 and fresh.count() == 7
    assert embed.encode(texts, "text", embed.hashing_embedder(16), 16, 3, keep=False).columns == ["k", "embedding"]
    kept = embed.encode(texts, "text", embed.hashing_embedder(16), 16, 3).orderBy("k").collect()
    assert [r["text"] for r in kept] == [f"text {k % 7}" for k in range(50)] and all(len(r["embedding"]) == 16 for r in kept)


def test_sample_is_of_the_lowest_hashes(spark):
    from groundline.operators import pivots

    table = vector_table(spark, clustered(2000, 6, 12))
    want = [r["embedding"] for r in table.orderBy(F.xxhash64("vec_id")).limit(20).collect()]
    assert pivots.sample(table, "vec_id", 20).tolist() == want == pivots.sample(table.repartition(9), "vec_id", 20, 2000).tolist()
    same = table.withColumn("vec_id", F.lit(5))  # its hash is not among the lowest
    assert len(pivots.sample(same, "vec_id", 20)) == 20


def test_batches_of_questions_meet_blocks_of_items(spark):
    v = clustered(120, 6, 40)
    table = vector_table(spark, v)
    asked = table.withColumnRenamed("vec_id", "query_id")
    want = sorted(map(tuple, retrieve.top_k(asked, table, 4, item_id="vec_id", blocks=1, batches=1).collect()))
    assert sorted(map(tuple, retrieve.top_k(asked, table, 4, item_id="vec_id", blocks=5, batches=3).collect())) == want and len(want) == 480
    assert retrieve.block_number(table, "vec_id", 120 * 6 * 8 // 7) == 8


def test_lists_find_nearly_all_and_read_little(spark, sf_dir):
    from groundline import catalog

    rows = catalog.knn_lists(spark, sf_dir).collect()
    items = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert sum(r["found"] for r in rows) >= 0.9 * sum(r["nearest"] for r in rows) and len(rows) == items // 50
    assert all(r["vectors_read"] < items / 10 and r["codes_read"] < items for r in rows)


def test_lists_on_texts_filters_and_the_exact_way(spark, tmp_path):
    from groundline.operators import lists

    v = clustered(900, 10, 30, spread=0.2)
    table = vector_table(spark, v).withColumn("kind", F.col("vec_id") % 3)
    asked = table.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    lists.write(table, str(tmp_path / "l"), lists.fit(table, "vec_id", 30), "vec_id", "kind")
    opened = lists.open_lists(spark, str(tmp_path / "l"))
    assert opened.rows.sum() == 900 and opened.table.count() == 900
    exact = retrieve.top_k(asked, table, 5, item_id="vec_id")
    found = lists.search(asked, opened, 5, probes=5, refine=8, item_id="vec_id")
    got = lists.recall(found, exact, item_id="vec_id").agg(F.sum("found"), F.sum("nearest")).first()
    assert got[0] >= 0.9 * got[1] and got[1] == 90
    read = found.agg(F.max("codes_read"), F.max("vectors_read")).first()
    assert read[0] < 450 and read[1] == 40
    # every list and every candidate: the exact search
    same = lists.search(asked, opened, 5, probes=30, refine=200, item_id="vec_id", filter_col="kind", exclude_self=True)
    want = retrieve.top_k(asked, table, 5, item_id="vec_id", filter_col="kind", exclude_self=True)
    key = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["distance"], 5)) for r in df.collect())
    assert key(same) == key(want)
    with pytest.raises(MissingCollectionError):
        lists.open_lists(spark, str(tmp_path / "none"))
    with pytest.raises(EmptyCollectionError):
        lists.fit(table.limit(0), "vec_id")
    with pytest.raises(RetrievalError):
        lists.search(asked, opened, 0, item_id="vec_id")
    assert lists.search(asked.limit(0), opened, 5, item_id="vec_id").count() == 0


def test_one_list_holds_all(spark, tmp_path, monkeypatch):
    from groundline.operators import lists

    monkeypatch.setattr(lists, "SLICE_ROWS", 16)
    monkeypatch.setattr(lists, "BATCH_ROWS", 3)
    v = np.repeat(clustered(2, 7, 2), [90, 10], axis=0)
    table = vector_table(spark, v)
    lists.write(table, str(tmp_path / "l"), lists.fit(table, "vec_id", 4), "vec_id")
    found = lists.search(table.filter("vec_id in (0, 1, 2, 95)").withColumnRenamed("vec_id", "query_id"), lists.open_lists(spark, str(tmp_path / "l")), 3, 1, 2, item_id="vec_id")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["codes_read"]) for r in found.orderBy("query_id", "rank").collect()] == [(q, n + 1, (0 if q < 90 else 90) + n, 90 if q < 90 else 10) for q in (0, 1, 2, 95) for n in range(3)]


@pytest.mark.parametrize("kind", ["normal", "repeated", "far apart", "one value"])
def test_percentiles_equal_sorting(spark, kind):
    from groundline.operators import ranks

    r = np.random.default_rng(8)
    x = {"normal": r.normal(size=900), "repeated": r.integers(0, 3, 900).astype(float), "far apart": r.choice([-1.0, 1.0], 900) * 10.0 ** r.integers(-300, 300, 900), "one value": np.full(900, 2.5)}[kind]
    rows = [("hot" if i % 3 else None if i % 2 else "b", float(v)) for i, v in enumerate(x)] + [("few", 1.0), ("few", None), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(5)
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    for percent in (0.0, 85.0):
        want = {g: sorted(v)[max(1, -(-int(percent) * len(v) // 100)) - 1] for g, v in groups.items()}
        for most in (10, 1 << 20) if kind == "normal" else (10,):
            assert {r["g"]: r["value"] for r in ranks.percentiles(frame, "x", percent, ["g"], most, 16, 20).collect()} == want, percent


def test_id_difference_descends_where_tables_differ(spark):
    want = spark.range(5000).select(F.col("id").cast("string").alias("chunk_id"))
    assert index.id_difference(want.repartition(7), want).collect() == []
    have = want.filter("chunk_id not in ('7', '4999')").unionByName(spark.createDataFrame([("x",), ("x",), ("5",)], "chunk_id string"))
    for bits, levels in ((4, 2), (12, 1)):
        got = sorted(map(tuple, index.id_difference(have, want, bits, levels).collect()))
        assert got == [("extra", "x"), ("missing", "4999"), ("missing", "7")]
    at = F.shiftrightunsigned(F.xxhash64("chunk_id"), 52)
    assert 1 <= index.differing(have, want, at).count() <= 4 and index.differing(want, want.repartition(3), at).count() == 0
    nothing = want.limit(0)
    assert index.id_difference(nothing, want).count() == 5000 and index.id_difference(nothing, nothing).count() == 0


def test_probes_of_embeddings(spark):
    embedder = embed.hashing_embedder(64)
    assert embed.embed_query("exit load", embedder) == [float(x) for x in embedder(["exit load"])[0]]
    for blank in ("", " \n"):
        with pytest.raises(EmbeddingError):
            embed.embed_query(blank, embedder)
    r = embed.probe(spark, embedder, ("exit load of a fund", "the exit load of this fund"), "weather in spring").first()
    assert r["ok"] and r["same_topic"] > r["unrelated"] and abs(r["min_norm"] - 1) < 1e-6 > abs(r["max_norm"] - 1)
    rows = spark.createDataFrame([("a", "one two", 4), ("b", "one", 1), ("c", " ", 7), ("d", "x y", 9)], "chunk_id string, text string, n_tokens int")
    assert tuple(embed.probe_corpus(rows, first=3).first()) == (1.5, 1.0, 2.0)


def test_tokens_by_a_vocabulary():
    from groundline.operators import chunks

    count = chunks.bpe_counter(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    assert count("") == 0 and count("hello world") == 2
    assert all(count(p) <= 9 for p in chunks.recursive_split("some words of a text, and some more. " * 9, 9, 2, count=count))


def test_semantic_breaks_of_a_large_group_spread_over_ranges(spark):
    """One group in many tasks, a buffer longer than some ranges, groups of one row and of null."""
    import math

    rng = np.random.default_rng(3)
    sizes = {"hot": 400, "b": 7, "one": 1}
    rows = [(g, i * 3, [float(x) for x in rng.normal(size=4)]) for g, n in sizes.items() for i in range(n)]
    rows += [(None, 0, [1.0, 0.0, 0.0, 0.0]), (None, 1, [0.0, 1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "group_id string, pos int, embedding array<double>").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for buffer in (1, 3, 25):
            got = {(r["group_id"], r["pos"]): (r["distance"], r["is_break"], r["run"]) for r in chunks.semantic_breaks(table, buffer=buffer, percent=90.0).collect()}
            assert len(got) == len(rows)
            for g, n in sizes.items():
                v = np.array([r[2] for r in rows if r[0] == g])
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                apart = [round(1 - float(v[i] @ v[min(i + buffer, n - 1)]), 9) for i in range(n - 1)]
                limit = sorted(apart)[math.ceil(0.9 * (n - 1)) - 1] if apart else None
                run = 0
                for i in range(n):
                    distance, is_break, found = got[g, i * 3]
                    assert found == run
                    if i == n - 1:
                        assert distance is None and not is_break
                    else:
                        assert abs(distance - apart[i]) < 2e-9 and is_break == (apart[i] >= limit)
                        run += is_break
            assert got[None, 0] == (1.0, True, 0) and got[None, 1] == (None, False, 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_join_by_question_sends_a_side_by_the_driver(spark):
    found = spark.createDataFrame([("q", 1, "c", 0.1), ("r", 1, "c", 0.2)], "query_id string, rank int, chunk_id string, distance double")
    asked = spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")
    gate = retrieve.gate(asked, found, 0.15)
    assert {r["query_id"]: r["passes_gate"] for r in gate.collect()} == {"q": True, "r": False, "s": False}
    plan = gate._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
