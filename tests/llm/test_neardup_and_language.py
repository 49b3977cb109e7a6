import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from groundline.llm import language, neardup, pii


def plain_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_groups(docs, percent):
    sets = {i: plain_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def chained(n, seed=1):
    """A chain of edits, copies, texts apart and the odd cases."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "ti"]) for _ in range(3))
    texts, base = [], [word() for _ in range(120)]
    for _ in range(n):
        base = list(base)
        for _ in range(r.randint(0, 3)):
            base[r.randrange(len(base))] = word()
        texts.append(" ".join(base))
    texts += [" ".join(word() for _ in range(80)) for _ in range(20)] + texts[:15] + [t.upper() for t in texts[:3]]
    return list(enumerate([*texts, None, "", " \n", "a b", "A  b", "a b c d e", "w " * 20_000]))


@pytest.mark.parametrize(("percent", "block"), [(85, 384), (80, 16)])
def test_groups_equal_brute_force(spark, percent, block):
    docs = chained(120)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rep string, n int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.groups(frame, percent, block=block).collect()}
    assert got == plain_groups(docs, percent)


def test_groups_of_odd_rows(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, "x y"), (3, "p q r s t u"), (4, "x y")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in neardup.groups(frame).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3)] or got[0][0] == 0 and got[1:] == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3)]
    assert neardup.groups(frame.limit(0)).count() == 0
    kept = neardup.deduplicate(frame)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3] and kept.columns == frame.columns


def test_signature_against_the_definition():
    r = np.random.default_rng(1)
    for n in (1, 3, 20, 300):
        elements, m = np.unique(r.integers(0, 2**63, n).astype(np.uint64)), 50
        want = [2**64] * m
        for x in elements:
            p = list(range(m))
            for j in range(m):
                h = int(neardup.mixed(np.array([(int(x) + j * int(neardup._GOLD)) % 2**64], np.uint64))[0])
                k = j + ((h & 0xFFFFFFFF) * (m - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j << 32 | h >> 32)
        assert [int(v) for v in neardup.signature(elements, m)] == want


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_at_the_limit_keep_within_the_slack(percent):
    """The chance that plain MinHash, which varies the most, falls short of the margin."""
    p, m = percent / 100 + (1 - percent / 100) / 256, neardup.SLOTS
    least = round((percent / 100 - neardup.SLACK) * m)
    assert sum(math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(least)) < 5e-5


def test_bands_fit_the_limit():
    assert neardup.banding(85) == (28, 7) and neardup.banding(80) == (32, 6)
    for percent in (50, 60, 70, 80, 85, 90):
        bands, size = neardup.banding(percent)
        assert bands * size <= neardup.SLOTS and (1 - (percent / 100) ** size) ** bands <= 1e-4


def test_components_in_many_tasks(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100 + r.randrange(40)) for i in range(40)]
    frame = spark.createDataFrame(edges, "a long, b long").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    want = {r["rep"]: r["comp"] for r in neardup.components(frame).collect()}
    got = {r["rep"]: r["comp"] for r in neardup.components(frame, most=9).collect()}
    assert got == want and want[60] == 0


def test_scores_equal_brute_force(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 3))) for _ in range(60)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(250)] + [(None, "a b"), (7777, None), (7778, ""), (5, "again a b"), (7779, "a " * 20_000)]
    docs += [(8000 + k, docs[k][1]) for k in range(40)] + [(9000 + k, f"once{k} only{k} here{k} a") for k in range(20)]
    frame = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double").repartition(4)
    got = defaultdict(list)
    for row in language.score(frame, block_tokens=900, range_keys=300).collect():
        got[row["doc_id"]].append(row)
    fold = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5
    tokens = lambda t: [language.START_KEY, *(t or "").encode().lower().split(), language.END_KEY]
    counts, n_docs = [Counter(), Counter()], [0, 0]  # of words, pairs and triples, as tuples
    for i, t in docs:
        if fold(i) != 1:
            p, w = int(fold(i) == 4), tokens(t)
            counts[p].update((x,) for x in w[1:])
            counts[p].update(zip(w, w[1:], strict=False))
            counts[p].update(zip(w, w[1:], w[2:], strict=False))
            n_docs[p] += 1

    def cells(w, count, documents):
        out = []
        for k in range(1, len(w)):
            three = tuple(w[k - 2 : k + 1]) if k > 1 else ()
            context = documents if k == 1 else count[w[k - 1],]
            out.append((count[three] if three else 0, count[three[:2]] if three else 0, count[w[k - 1], w[k]], context, count[w[k],]))
        return out

    every = counts[0] + counts[1]
    sizes = [sum(n for k, n in c.items() if len(k) == 1) for c in (counts[0], every)]
    distinct = sum(len(k) == 1 for k in every)
    held = Counter(c for i, t in docs if fold(i) == 4 for c in cells(tokens(t), counts[0], n_docs[0]))
    table, n = np.array(list(held)).T, np.array(list(held.values()), float)
    weights = language.settled(lambda w: w.expected(table, n, sizes[0], distinct))
    assert weights.triple[1] != weights.triple[2] and sum(map(len, got.values())) == len(docs)
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((every[x,] + 0.5) / (sizes[1] + 0.5 * (distinct + 1))) for x in w[1:])
        own = np.log10(weights.probabilities(np.array(cells(w, every, sum(n_docs))).T, sizes[1], distinct)).sum()
        row = next(x for x in got[i] if x["n_tokens"] == len(w) - 1)
        assert (row["held_out"], row["n_known"], row["train_tokens"]) == (fold(i) == 1, sum(every[x,] > 0 for x in w[1:]), sizes[1])
        assert row["base_score"] == pytest.approx(base, rel=1e-9) and row["score"] == pytest.approx(own, rel=1e-9)
    assert language.score(frame.limit(0)).count() == 0
    alone = language.score(frame.filter("doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)).first()
    assert alone["train_tokens"] == 0 and alone["base_score"] == alone["score"] == 0


def test_probabilities_of_a_context_sum_to_one():
    weights = language.Weights(np.full(language.BUCKETS, 0.4), np.full(language.BUCKETS, 0.3), 0.8)
    word, pair, triple = np.array([3, 5, 2, 0]), np.array([1, 1, 0, 0]), np.array([1, 0, 0, 0])
    for three, two in ((1, 2), (0, 2), (0, 0)):
        cells = np.stack([triple * (three > 0), np.full(4, three), pair * (two > 0), np.full(4, two), word])
        assert weights.probabilities(cells, 10, 3).sum() == pytest.approx(1.0)


def test_expectation_maximisation_finds_the_mixture():
    r = np.random.default_rng(0)
    n = 200_000
    # contexts of 4 that gave w three times and another word once; words of a vocabulary of ten
    true = language.Weights(np.full(language.BUCKETS, 0.6), np.full(language.BUCKETS, 0.5), 0.9)
    cells = np.array([(3, 4, 1, 8, 5), (1, 4, 7, 8, 5)] + [(0, 4, 0, 8, 10)] * 9).T
    p = true.probabilities(cells, 100, 10)
    counts = np.bincount(r.choice(len(p), n, p=p / p.sum()), minlength=len(p)).astype(float)
    got = language.settled(lambda w: w.expected(cells, counts, 100, 10), 500)
    assert got.triple[3] == pytest.approx(0.6, abs=0.1) and np.isfinite(got.flat()).all()
    likelihood = lambda w: (counts * np.log(w.probabilities(cells, 100, 10))).sum()
    assert likelihood(got) >= likelihood(language.Weights())


def test_shrunk_round_trip():
    r = np.random.default_rng(1)
    for kind in (np.uint32, np.uint64):
        for n in (0, 1, 1000):
            v = r.integers(0, 2**31, n).astype(kind)
            assert (language.grown(language.shrunk(v), kind) == v).all()


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, seen = docs.count(), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        from groundline.llm import common

        docs = common.materialize(out, "test")
        seen.append(docs.count())
    assert before >= seen[0] >= seen[1] >= seen[2] == seen[3] > 0
    assert not any(pii.base_spans(r["text"] or "") for r in docs.select("text").collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_rows_of_a_large_bucket_grow_in_proportion(spark):
    """Texts that are near but not linked: what is written is members and links, never pairs."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    counts = {}
    for n in (300, 1200):
        texts = []
        for _ in range(n):
            own = list(words)
            for k in r.sample(range(400), 14):
                own[k] = f"x{r.randrange(10**9)}"
            texts.append(" ".join(own))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        reps = neardup.signed(docs).filter("n > 0").select(F.col("doc_id").alias("rep"), "n", "signature")
        bands, size = neardup.banding(85)
        members = neardup.dealt(neardup.buckets(reps, bands, size), reps)
        grouped = members.withColumn("comp", F.col("rep")).cache()
        open_ = neardup.open_members(grouped, 0.85, neardup.SLACK, size).cache()
        sets = neardup.full_sets(docs, reps.select("rep"))
        counts[n] = (grouped.count(), neardup.led(members, 0.85, neardup.SLACK).count(), open_.count(), neardup.links_of(open_, sets, 85, neardup.SLACK, size).count())
        assert counts[n][1] <= counts[n][0] and counts[n][3] <= counts[n][2]
    # a bucket of up to 1200 members has five blocks at most
    assert counts[1200][2] <= 5 * counts[1200][0] and counts[1200][0] < 5 * counts[300][0]


def test_ids_that_are_joined_give_the_same_groups(spark):
    docs = chained(60)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.groups(frame, 85, most_asked=0).collect()}
    assert got == plain_groups(docs, 85)
