import dataclasses
import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundline.errors import EmbeddingError, ModelMismatchError
from groundline.operators import cachefiles, embed, encoder, retrieve
from groundline.plans.answer import answer
from groundline.plans.build import build_index, open_fitted
from groundline.settings import Settings

TEXTS = ["The exit load of the fund is nil", "exit load: NIL after a year", "Rain in spring, rain in autumn", "", None, "!!", "Spring rain in Köln", "the the the fund", " \n"]


def frame(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(parts)


def plain_fit(texts):
    """Weights and Gram matrix, word by word."""
    import hashlib

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words_of = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", t.translate(lower))
    number = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
    counts = Counter(b for t in texts if t for b in {number(w) % 65536 for w in words_of(t)})
    weight = lambda b: np.float32(math.log((len(texts) + 1) / (counts[b] + 1)) + 1)
    gram = np.zeros((512, 512), np.int64)
    for t in texts:
        if t and t.strip():
            x = defaultdict(float)
            for w, n in Counter(words_of(t)).items():
                x[number(w) % 512] += (1 if number(w) >> 31 else -1) * weight(number(w) % 65536) * (1 + math.log(n))
            x = x if any(x.values()) else {number(t) % 512: 1.0}
            length = math.sqrt(sum(v * v for v in x.values()))
            for i, a in x.items():
                for j, b in x.items():
                    gram[i, j] += round(256 * a / length) * round(256 * b / length)
    return counts, gram


def test_a_fit_equals_plain_python(spark):
    counts, gram = plain_fit(TEXTS)
    got = {r["bucket"]: r["n_texts"] for r in encoder.bucket_counts(frame(spark, TEXTS)).collect()}
    assert got == dict(counts)
    model = encoder.fit(frame(spark, TEXTS), "text", 4)
    values = np.linalg.eigvalsh(gram / 65536)[::-1][:4]
    axes = model.axes.astype(float)
    assert np.allclose(axes.T @ axes, np.eye(4), atol=1e-5) and np.allclose(axes.T @ (gram / 65536) @ axes, np.diag(values), atol=1e-4)


def test_a_fit_hangs_on_no_order(spark):
    a = encoder.fit(frame(spark, TEXTS, 1), "text", 8)
    b = encoder.fit(frame(spark, TEXTS[::-1], 40), "text", 8)  # more partitions than one task adds up
    assert a.name == b.name and np.array_equal(a.axes, b.axes)
    assert encoder.fit(frame(spark, TEXTS[:3]), "text", 8).name != a.name != encoder.fit(frame(spark, TEXTS), "text", 4).name
    with pytest.raises(EmbeddingError):
        encoder.fit(frame(spark, TEXTS), "text", 513)


def test_any_text_has_a_vector(spark, tmp_path):
    for texts in ([], ["", None], TEXTS):
        model = encoder.fit(frame(spark, texts, 2), "text", 8)
        v = model(["exit load", "never seen", "!!", "", "x" * 100_000, "long words " * 50_000])
        assert v.shape == (6, 8) and np.allclose(np.linalg.norm(v, axis=1), 1, atol=1e-5) and model([]).shape == (0, 8)
    encoder.save(spark, model, path := str(tmp_path / "encoder"))
    again = encoder.load(spark, path)
    assert again.name == model.name and np.array_equal(again(["exit load"]), model(["exit load"]))


def test_probe_and_one_load_in_each_worker(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").select("doc_id", "text")
    model = encoder.fit(docs, "text", 64)
    run, settings = encoder.embedder(spark, model), encoder.fitted_settings(model)
    r = embed.probe(spark, run, ("exit load of a fund", "the exit load of this fund"), "weather in spring").first()
    assert r["ok"] and abs(r["min_norm"] - 1) < 1e-5
    # a text is nearest to its own copy with some words changed
    some = [x["text"] for x in docs.orderBy("doc_id").limit(40).collect() if len(x["text"].split()) > 30]
    changed = [" ".join(w for k, w in enumerate(t.split()) if k % 7) for t in some]
    assert (np.argmax(run(changed) @ run(some).T, axis=1) == np.arange(len(some))).mean() >= 0.9

    def seen(batches):
        from groundline.operators import encoder as own

        for b in batches:
            run(b["text"].tolist())
            yield b[["doc_id"]].head(1).assign(pid=os.getpid(), loads=own.loads)

    first = {r["pid"]: r["loads"] for r in docs.repartition(12).mapInPandas(seen, "doc_id long, pid long, loads long").collect()}
    again = {r["pid"]: r["loads"] for r in docs.repartition(12).mapInPandas(seen, "doc_id long, pid long, loads long").collect()}
    assert set(first.values()) == {1} and all(again[p] == 1 for p in again if p in first)
    out = embed.embed_texts(docs, "text", run, settings)[0]
    assert out.filter(F.size("embedding") != 64).isEmpty()


def test_an_index_of_another_fit_is_refused(spark, tmp_path):
    settings = Settings(embed_dim=16, allowed_hosts=("example.com",), max_distance=0.9)
    page = lambda k, text: (f"https://example.com/p{k}", f"<body><h1>Page {k}</h1><h2>Costs</h2><p>{text}</p></body>", f"s{k}", f"Page {k}", "equity", "2024-01-02T00:00:00Z")
    ddl = "url string, html string, scheme string, scheme_name string, category string, fetched_at string"
    raw = spark.createDataFrame([page(1, "The exit load is nil after three years."), page(2, "The expense ratio is one percent.")], ddl)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    paths = build_index(raw, raw.select("url"), one, settings=settings, fitted=True)
    table, run, fitted = open_fitted(spark, one, settings)
    assert fitted.embed_model.startswith("fitted-16-") and spark.read.parquet(paths["index_meta"]).first()["embed_model"] == fitted.embed_model
    asked = spark.createDataFrame([("1", "what is the exit load")], "query_id string, question string")
    assert answer(asked, table, run, settings=fitted).first()["answer"].startswith("Page 1")
    more = raw.unionByName(spark.createDataFrame([page(3, "The riskometer says very high.")], ddl))
    build_index(more, more.select("url"), two, settings=settings, fitted=True)
    other = open_fitted(spark, two, settings)[2]
    assert other.embed_model != fitted.embed_model
    for wrong in (settings, other, dataclasses.replace(fitted, embed_dim=8)):
        with pytest.raises(ModelMismatchError):
            retrieve.open_index(spark, paths["index"], wrong)


# The cache's filters


def cache_of(spark, keys, dim=4):
    rows = spark.createDataFrame([(k,) for k in keys], "text_key string").coalesce(1)
    return embed.cache_rows(rows.withColumn("embedding", F.array_repeat(F.lit(0.5).cast("float"), dim)), Settings(embed_dim=dim))


def wanted_of(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "text_key string")


def test_filters_lose_no_key():
    keys = [f"key {i}" for i in range(3000)]
    bits = cachefiles.filter_of(keys)
    assert cachefiles.may_hold(bits, cachefiles.probes(keys)).all()
    strange = cachefiles.may_hold(bits, cachefiles.probes(f"other {i}" for i in range(3000)))
    assert strange.mean() < 0.03
    # a filter of eight bytes under many keys: everything collides, and nothing is lost
    full = np.zeros(64, bool)
    full[(cachefiles.probes(keys) & np.uint64(63)).ravel()] = True
    assert cachefiles.may_hold(np.packbits(full, bitorder="little").tobytes(), cachefiles.probes(keys)).all()
    assert not cachefiles.may_hold(cachefiles.filter_of([]), cachefiles.probes(["a"])).any()


def test_files_without_a_candidate_are_not_read(spark, tmp_path):
    path = str(tmp_path / "cache")
    for part in range(6):
        embed.append_cache(cache_of(spark, [f"{part}-{i}" for i in range(400)]), path)
    embed.append_cache(cache_of(spark, []), path)
    assert spark.read.parquet(path).count() == 2400 and len(cachefiles.files_of(spark.read.parquet(path))) == 6
    some = wanted_of(spark, ["2-7", "2-8", "2-8", None])
    assert len(cachefiles.candidates(spark, path, some)) == 1
    found = cachefiles.lookup(spark, path, some)
    assert len(found.inputFiles()) == 1 and found.filter("text_key in ('2-7', '2-8')").count() == 2
    assert cachefiles.lookup(spark, path, wanted_of(spark, [])).count() == 0 == cachefiles.lookup(spark, path, wanted_of(spark, ["none at all"])).filter("text_key = 'none at all'").count()
    every = [f"{p}-{i}" for p in range(6) for i in range(0, 400, 3)]
    assert cachefiles.lookup(spark, path, wanted_of(spark, every)).join(wanted_of(spark, every), "text_key").count() == len(every)
    # more keys than may be sent: all files
    assert len(cachefiles.candidates(spark, path, some, Settings(broadcast_bytes=cachefiles.KEY_BYTES))) == 6


def test_a_file_without_a_filter_is_read(spark, tmp_path):
    path = str(tmp_path / "cache")
    embed.append_cache(cache_of(spark, ["a", "b"]), path)
    cache_of(spark, ["c"]).write.mode("append").parquet(path)  # its writer was lost before the filter
    assert {r["text_key"] for r in cachefiles.lookup(spark, path, wanted_of(spark, ["c"])).collect()} == {"c"}
    cachefiles.add_filters(spark, path)
    cachefiles.add_filters(spark, path)
    assert cachefiles.filters(spark, path).count() == 2 and len(cachefiles.candidates(spark, path, wanted_of(spark, ["a"]))) == 1


def test_many_keys_go_to_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cachefiles, "KEYS_PER_FILE", 50)
    embed.append_cache(cache_of(spark, [f"k{i}" for i in range(220)]), path := str(tmp_path / "cache"))
    assert {r["n_keys"] for r in cachefiles.filters(spark, path).collect()} == {50, 20}
    found = cachefiles.lookup(spark, path, wanted_of(spark, ["k3", "k219"]))
    assert len(found.inputFiles()) == 2 and found.filter("text_key in ('k3', 'k219')").count() == 2


def test_a_fit_takes_each_distinct_word_of_a_batch_once(monkeypatch):
    import random

    import pyarrow as pa

    # the sums of one text after the other, word by word
    r = random.Random(5)
    signs = ["exit", "Load", "Köln", "K", "9a", " ", ", ", "\n", "--", "\x00", "é", "　", "the "]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(300)] + ["", "!!", "x" * 70_000, "a\ud800b b"]
    weights = np.random.default_rng(1).uniform(1, 9, encoder.BUCKETS).astype(np.float32)
    for some in (texts[:303], texts):
        got = encoder.sketches(some, weights)
        for i, text in enumerate(some):
            own = np.zeros(encoder.SKETCH)
            for word, n in Counter(re.findall(encoder.WORD, text.translate({a: a + 32 for a in range(65, 91)}))).items():
                h = encoder.number_of(word)
                own[h % encoder.SKETCH] += (1 if h >> 31 else -1) * weights[h % encoder.BUCKETS] * (1 + math.log(n))
            if not own.any():
                own[encoder.number_of(text) % encoder.SKETCH] = 1
            assert np.array_equal(got[i], (own[None] / np.linalg.norm(own[None], axis=1, keepdims=True))[0])
    asked = []
    monkeypatch.setattr(encoder, "number_of", lambda word, plain=encoder.number_of: asked.append(word) or plain(word))
    at, codes, numbers = encoder.words_of(pa.array([None, "one two One", "two, three"]).slice(1))
    assert at.tolist() == [0, 0, 0, 1, 1] and len(codes) == 5 and len(set(asked) - {""}) == 3 == len([w for w in asked if w])
    encoder.sketches(["one two"] * 50, weights)
    assert len(asked) < 10
