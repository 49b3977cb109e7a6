import gzip
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundline.llm import clusters, resample, warc

VECTORS = "vec_id long, embedding array<double>, cluster string, N string, v string"


def plain_clusters(rows, k, rounds, dim, seed=2):
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(i, near(v)) for i, v in kept]
    inertia = Counter()
    for _, (d, j) in out:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, (d, j) in out), key=str)


def test_clusters_equal_plain_rounds(spark):
    r = np.random.default_rng(1)
    few = r.normal(size=(9, 4)).round(3)
    rows = [(i, [float(x) for x in few[i % 9]]) for i in range(60)] + [(100 + i, [float(x) for x in r.normal(size=4)]) for i in range(40)]
    rows += [(7, [0.5, -0.5, 0.0, -0.001]), (None, [1.0, 1.0, 1.0, 1.0]), (3, rows[3][1])]  # an id again, none, a repeated row
    bad = [(200, None), (201, [1.0]), (202, [1.0, None, 1.0, 1.0]), (203, [1.0, float("nan"), 1.0, 1.0]), (204, [1.0, float("inf"), 1.0, 1.0]), (205, [])]
    frame = spark.createDataFrame([(i, e, "x", "y", "z") for i, e in rows + bad], VECTORS).repartition(5)
    for k in (3, 12, 500):
        got = clusters.cluster(frame, k=k, rounds=3, dim=4)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows, k, 3, 4)


def test_clusters_of_nothing_and_of_no_ids(spark):
    frame = spark.createDataFrame([(None, [1.0, 2.0], "", "", "")], VECTORS)
    assert clusters.cluster(frame.limit(0), dim=2).collect() == []
    assert [tuple(r) for r in clusters.cluster(frame, dim=2).collect()] == [(None,) * 6]
    far = spark.createDataFrame([(1, [1e9, 2.0], "", "", "")], VECTORS)
    with pytest.raises(Exception, match="a component is not below"):
        clusters.cluster(far, dim=2).collect()


def test_large_components_are_exact():
    c = np.array([[clusters.LIMIT * 256 - 1] * 64, [-clusters.LIMIT * 256] * 64])
    best, far = clusters.nearest(np.array([[1] * 64, [-1] * 64]), c)
    want = [min((64 * (x - int(v[0])) ** 2, j) for j, v in enumerate(c)) for x in (1, -1)]
    assert [(int(f), int(b)) for f, b in zip(far, best)] == want


def test_hot_keys_are_joined_like_others(spark):
    from groundline.llm import common

    rows = spark.range(5000).select("id", F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k % 7 <> 3")
    got = common.attach(rows, table, ["k"], "n", 5000, F.col("id"), F.col("id") % 11 == 0)
    hot = {-1}
    for r in got.collect():
        there = r["k"] % 7 != 3 if r["k"] >= 0 else True
        want = 3000 if r["k"] in hot else 1 if there and r["id"] % 11 else None
        assert r["n"] == want, r


HTML = "page_id long, url string, html string, digest string, n int"


def warc_rows():
    big, other = "<p>é " + "a" * 1200, "b" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, "http://b/é x\r\ny", big), (4, "u", "small"), (5, "u", "small"), (6, None, None), (7, "http://c", other), (None, "n", other), (8, "e", ""), (9, "http://d", "c" * 999), (10, "http://d", "c" * 999), (11, "l", "long " * 300_000)]
    return rows + [(12, "t", "d" * 1500), (12, "t", "d" * 1500), (2, "http://a/2", big), (None, None, "e" * 1001), (None, None, "e" * 1001)]


def plain_warc(rows):
    out = []
    for payload, group in ((h, [r for r in rows if (r[2] or "") == h]) for h in {r[2] or "" for r in rows}):
        raw = payload.encode()
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
        for n, r in enumerate(group):
            again = n > 0 and len(raw) >= 1000
            out.append((r[0], len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", group[0][0] if again else None))
    return sorted(out, key=str)


def test_archives_are_read_back(spark, tmp_path):
    rows = warc_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], HTML).repartition(3)
    got = warc.round_trip(frame)
    assert sorted(map(tuple, got.collect()), key=str) == plain_warc(rows)
    index, folder = warc.write(frame, str(tmp_path / "archives"), archive_bytes=3000)
    back = warc.read(index, folder)
    assert sorted((r["payload"].decode() for r in back.collect() if r["record_type"] == "response" and r["page_id"] == 2), key=str) == []
    texts = {(r[0], r[2] or "") for r in rows}
    assert all((r["page_id"], r["payload"].decode()) in texts for r in back.collect() if r["payload"] is not None)
    # archives are of the usual form: gzip members one after another, revisits without payload
    plain = b"".join(gzip.open(os.path.join(folder, f)).read() for f in os.listdir(folder))
    assert plain.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows) + len(os.listdir(folder)) and plain.count(b"d" * 1500) == 1
    ids = re.findall(rb"WARC-Record-ID: (\S+)", plain)
    assert len(set(ids)) == len(ids) and set(re.findall(rb"WARC-Refers-To: (\S+)", plain)) <= set(ids)
    for r in index.collect():
        with open(os.path.join(folder, r["archive"]), "rb") as f:
            f.seek(r["offset"])
            assert warc.parse(f.read(r["length"])).size == r["payload_bytes"]


def test_near_ranges_are_read_together(spark, tmp_path):
    frame = spark.range(200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), "id").alias("html")).coalesce(1)
    index, folder = warc.write(frame, str(tmp_path / "a"))
    assert {r["reads"] for r in warc.read(index, folder).collect()} == {1}
    some = index.filter("page_id % 50 = 0")
    assert max(r["reads"] for r in warc.read(some, folder, gap_bytes=0).collect()) == 4
    assert sorted(r["page_id"] for r in warc.read(some, folder).collect()) == [0, 50, 100, 150]
    assert max(r["reads"] for r in warc.read(index, folder, read_bytes=1 << 12).collect()) > 1


def test_archives_of_nothing_and_damaged_ones(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "text", "", 1), (2, "u", "other", "", 1)], HTML).coalesce(1)
    assert warc.round_trip(frame.limit(0)).collect() == []
    index, folder = warc.write(frame, str(tmp_path / "a"))
    name = os.listdir(folder)[0]
    data = bytearray((tmp_path / "a" / name).read_bytes())
    data[index.first()["offset"] + 40] ^= 255
    (tmp_path / "a" / name).write_bytes(data)
    with pytest.raises(Exception, match="WarcError"):
        warc.read(index, folder).collect()
    good = warc.page_record(1, "u", hashlib.sha1(b"x").hexdigest(), b"x", 1, None, False)
    assert warc.parse(good).payload == b"x"
    for bad in (good[:-1], good + b"x", warc.page_record(1, "u", "0", b"x", 1, None, False)):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


TEXTS = "doc_id long, text string, rank string, SCORE int, bucket int"


def plain_features(text, order):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, percent=25, least=20, buckets=10_000, order=2, seed=7):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(bucket(x) for _, d in docs for x in plain_features(d, order)[1]), Counter(bucket(x) for d in target for x in plain_features(d, order)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, d in docs:
        w, f = plain_features(d, order)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, len(w)])
    able = sorted((r for r in rows if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for n, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = n
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus():
    r = np.random.default_rng(4)
    vocabulary = ["Alpha", "BETA", "gamma9", "élan", "ÉTÉ", "z" * 63, "y" * 64, "x" * 65, "w" * 3000, "日本語", "a-b", "1", "tail"]
    docs = [(i, " ".join(r.choice(vocabulary, size=r.integers(0, 60)))) for i in range(80)]
    docs += [(80, None), (81, ""), (82, "  ..  "), (None, "gamma9 " * 30), (83, "same words here " * 20), (83, "same words here " * 20), (83, "same words " * 30), (84, "\x00tab\tand\x7fdelete " * 10)]
    return docs, [" ".join(r.choice(vocabulary[:5], size=40)) for _ in range(5)] + [None, ""]


@pytest.mark.parametrize(("order", "buckets"), [(2, 10_000), (1, 97), (3, 1000)])
def test_resampling_equals_strings(spark, order, buckets):
    docs, target = corpus()
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], TEXTS).repartition(4)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(frame, bench, order=order, buckets=buckets)
    assert sorted(map(tuple, got.collect()), key=str) == plain_resample(docs, target, order=order, buckets=buckets)


def test_resampling_of_nothing(spark):
    frame = spark.createDataFrame([(1, "a b " * 20, "x", 1, 2)], TEXTS)
    assert resample.resample(frame.limit(0), frame.limit(0)).collect() == []
    assert [r["n_features"] for r in resample.resample(frame, frame.limit(0), percent=100).collect()] == [79]


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = ("word " * 30 + "ü" * 40 + "," + "q" * 150 + " end;").encode() * 5
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = resample.words(data, offsets)
    for most in (1, 7, 64, 200):
        monkeypatch.setattr(resample, "PIECE_BYTES", most)
        assert len(list(resample.pieces(resample._LOWER[data], most))) > 2
        monkeypatch.setattr(resample.pieces, "__defaults__", (most,))
        assert all(np.array_equal(a, b) for a, b in zip(resample.words(data, offsets), whole))
    assert whole[0][0] == zlib.crc32(b"word")


def test_checksums_are_composed():
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 64, 65, 1000, 70_000):
        a, b = r.bytes(20), r.bytes(n)
        got = resample.combined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([n]))
        assert int(got[0]) == zlib.crc32(a + b)


def test_ranks_are_a_total_order(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    got, n = resample.ranked(rows.repartition(6), [F.col("a").desc(), F.col("b")])
    want = sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert n == 1000 and [(r["a"], r["b"]) for r in sorted(got.collect(), key=lambda r: r["rank"])] == want and sorted(r["rank"] for r in got.collect()) == list(range(1, 1001))
