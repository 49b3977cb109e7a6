import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundline.llm import pii, quality, toxicity


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    counts = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = [False] * len(words)
    for i in range(len(words) - 2):
        if counts[tuple(words[i : i + 3])] > 1:
            hit[i : i + 3] = [True] * 3
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), twice, sum(hit), len(words) < 50 or 100 * sum(hit) > 50 * len(words)


def test_base_figures(spark):
    r = random.Random(1)
    texts = [None, "", " \n\t", "a", "é\U0001d4b3 \x0bb\x0c\n\n", "  x", "w " * 30_000] + ["".join(r.choice(["a ", "b ", "c", "\n", "# ", "a b a ", "é", "\t"]) for _ in range(r.randint(0, 120))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, None, 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    got = {x["doc_id"]: (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) for x in quality.judge(docs).collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(texts)}
    assert quality.judge(docs.limit(0)).count() == 0


def test_distance(spark):
    r = random.Random(2)
    for _ in range(10):
        counts, shares = [r.randrange(5) for _ in range(4)], [r.random() for _ in range(4)]
        shares = [s / sum(shares) for s in shares]
        got = spark.createDataFrame([(counts,)], "c array<long>").select(quality.js_distance(F.col("c"), shares)).first()[0]
        assert got == pytest.approx(quality.js_distance_of(counts, shares), abs=1e-9)
    assert quality.js_distance_of([1, 0], [0.0, 1.0]) == pytest.approx(1.0)


def test_junk_goes_and_prose_stays(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet") if sf_dir.startswith("/root/testdata") else spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{'/root/testdata/sf0.01' if sf_dir.startswith('/root/testdata') else sf_dir}/labels.parquet")
    rows = quality.judge(docs).filter("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n.get((1, True), 0) > 50 * n.get((1, False), 0) and n.get((0, False), 0) > 10 * n.get((0, True), 0)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns


def plain_verdicts(rows):
    """kept by the method's definition: references of the core, distances to the nearest, guards."""
    def figures(t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bare = "".join(words)
        letters, upper, digits, punct = (sum(f(c) for c in t) for f in (str.isalpha, str.isupper, lambda c: c in "0123456789", lambda c: c in ".,;:!?'\"()-"))
        classes = [letters - upper, upper, len(t) - len(bare), punct, len(bare) - letters - digits - punct]
        return plain_base(t)[5], len(t), len(words), classes, Counter(w.lower() for w in words)

    found = [(lang, *figures(t)) for _, t, lang in rows]

    def reference(chosen):
        out = {}
        for lang, own in quality.COMMON_WORDS.items():
            part = [f for f in chosen if f[0] == lang]
            total, chars = sum(f[3] for f in part), [sum(f[4][k] for f in part) for k in range(5)]
            counts = [sum(f[5][w] for f in part) for w in own]
            if total and sum(chars):
                out[lang] = ([c / sum(chars) for c in chars], [c / total for c in [*counts, total - sum(counts)]])
        return out

    def distances(f, refs):
        words = {k: [f[5][w] for w in own] for k, own in quality.COMMON_WORDS.items()}
        return min(quality.js_distance_of(f[4], c) for c, _ in refs.values()), min(quality.js_distance_of([*words[k], f[3] - sum(words[k])], w) for k, (_, w) in refs.items())

    good = [f for f in found if not f[1] and f[0] in quality.COMMON_WORDS]
    refs = reference(good)
    limit = {}
    for lang in refs:
        steps = sorted(math.ceil(distances(f, refs)[0] * quality.STEPS) for f in good if f[0] == lang)
        limit[lang] = steps[math.ceil(len(steps) / 2) - 1] / quality.STEPS
    refs = reference([f for f in good if distances(f, refs)[0] <= limit[f[0]]])
    out = []
    for f in found:
        a, b = distances(f, refs)
        far = f[2] >= quality.CLASS_GUARD and a > quality.CLASS_LIMIT or f[3] >= quality.WORD_GUARD and b > quality.WORD_LIMIT
        out.append(not f[1] and not (far and (f[0] is None or f[0] in refs)))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_verdicts_against_plain_python(spark, parts):
    r = random.Random(8)
    rows = []
    for i in range(160):
        lang = r.choice(["en", "en", "de", "fr", "xx", None])
        own = quality.COMMON_WORDS.get(lang, ("zu", "ka"))
        words = [r.choice(own) if r.random() < 0.35 else "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) + r.choice(["", "", ",", "."]) for _ in range(r.randint(20, 400))]
        if i % 7 == 0:
            words = [w + r.choice(["###", "%%", "$$$"]) for w in words]
        rows.append((i, " ".join(words), lang))
    want = plain_verdicts(rows)
    assert 10 < sum(not k for k in want) < 120
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
    assert {x["doc_id"]: x["kept"] for x in quality.judge(docs).collect()} == dict(enumerate(want))


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_base_spans():
    r = random.Random(2)
    for alphabet in ("a.@-1234567890 +()é%", "a.@-1", "4 1-0"):
        for _ in range(6000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 50)))
            assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 50_000) == []


def test_base_spans_of_long_texts_take_no_longer_than_their_length():
    for text in ("1" * 1_000_000 + ".", "." + "1" * 1_000_000, "1." * 500_000, "1.1.1" + "1" * 1_000_000 + "x.", "+1" * 400_000, "+1" + "(" * 800_000, "1 " * 500_000, "1-" * 500_000, "a@" * 400_000, "a.b@c-" * 200_000, "+1 (" * 250_000):
        began = time.time()
        pii.base_spans(text)
        pii.sanitized_text(text + " 1.2.3.4", [])
        assert time.time() - began < 8, text[:9]
    text = "1.2.3.4 marlowe " * 20_000
    began = time.time()
    assert len(pii.places(text, {"marlowe": "remove"})) == 20_000 and time.time() - began < 8


def plain_terms(rows, remove=pii.REMOVE, generalise=pii.GENERALISE):
    """All spans of each row by counting words and values of all rows one by one."""
    words_of = [set(re.findall(r"[^\W\d_]{3,}", t.lower())) for _, t in rows]
    held = [{pii.entity(k, t[a:b]) for k, a, b in plain_spans(t)} for _, t in rows]
    n, n_entity, n_term = len(rows), Counter(e for es in held for e in es), Counter(w for ws in words_of for w in ws)
    both = Counter((e, w) for es, ws in zip(held, words_of, strict=True) for e in es for w in ws)
    out = []
    for (i, t), es in zip(rows, held, strict=True):
        base = plain_spans(t)
        terms = {w for e in es for w in words_of[len(out)] if pii.disclosure(n, n_entity[e], n_term[w], both[e, w] - pii.DISCOUNT) > generalise}
        marks = [("term", *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", t.lower()) if m[0] in terms and not any(a < m.end() and m.start() < b for _, a, b in base)]
        out.append((i, ",".join(f"{k}:{a}:{b}" for k, a, b in base + marks)))
    return sorted(out)


@pytest.mark.parametrize("most", [pii.MOST_BYTES, -1])
def test_all_spans_against_plain_counting(spark, most):
    r = random.Random(5)
    rows = []
    for i in range(260):
        parts = [f"{r.choice(['word', 'mora', 'lento', 'Brisk', 'tally', 'dove', 'zinc'])}{'abcdefgh'[r.randrange(8)] * (i % 3)}" for _ in range(r.randint(1, 12))]
        if r.random() < 0.3:
            who = r.randrange(25)
            parts.insert(r.randrange(len(parts) + 1), f"u{who}@mail.org")
            parts.insert(r.randrange(len(parts) + 1), "name" + "abcdefghijklmnopqrstuvwxyz"[who])
        rows.append((i, r.choice([" ", ", ", "-", "1"]).join(parts)))
    rows += [(i, t) for i, t in rows[:80]] + rows[:30] + [(5, "")]
    want = plain_terms(rows)
    assert sum("term" in s for _, s in want) > 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((x["doc_id"], x["spans"]) for x in pii.spans(docs, most_bytes=most).collect()) == want


def test_names_of_other_columns(spark):
    docs = spark.createDataFrame([(i, SECRET, 1, 2, 3, 4.5, 5, "k") for i in range(8)] + [(50 + i, "about it we reach at the end", 1, 2, 3, 4.5, 5, "k") for i in range(60)], "doc_id long, text string, key int, marks int, `a.b` int, toxicity_score double, text_bytes int, _key string")
    clean = pii.sanitize(docs)
    assert clean.schema == docs.schema and "<EMAIL>" in clean.filter("doc_id = 1").first()["text"] and clean.first()["a.b"] == 3
    assert [c for c in toxicity.score(docs, toxicity.train([b"a"], [0])).columns if c not in docs.columns] == ["_toxicity_score"]


def test_repeated_tables_lose_no_term(spark):
    docs = spark.createDataFrame([(i, t) for i, t in corpus()], "doc_id long, text string")
    once, twice = ({x["doc_id"]: x["spans"] for x in pii.spans(d).collect()} for d in (docs, docs.unionByName(docs)))
    assert once[0] == twice[0] == "email:17:35,term:6:13"


SECRET = "reach marlowe at ann.b@mail.example about it"


def corpus():
    """An entity with a term that comes with it alone (marlowe) and words that come everywhere."""
    rows = [(i, SECRET) for i in range(6)] + [(10 + i, "about it we reach at the end " + "plain words " * i) for i in range(60)]
    return [*rows, (200, None), (201, ""), (202, "once bob@x.org with zeta")]


def test_terms_that_give_an_entity_away(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in corpus()], "doc_id long, text string, key string")
    for most in (pii.MOST_BYTES, -1):
        got = {r["doc_id"]: r for r in pii.spans(docs, most_bytes=most).collect()}
        assert len(got) == len(corpus())
        assert got[0]["spans"] == "email:17:35,term:6:13" and got[0]["n_email"] == 1
        assert got[202]["spans"] == "email:5:14" and got[200]["spans"] == got[12]["spans"] == ""
        n = len(corpus())
        assert pii.disclosure(n, 6, 6, 6) == pytest.approx(1.0) and pii.disclosure(n, 6, 66, 6) < pii.GENERALISE
    clean = {r["doc_id"]: r for r in pii.sanitize(docs).collect()}
    assert clean[0]["text"] == "reach  at <EMAIL> about it" and clean[200]["text"] is None and clean[12]["text"] == corpus()[8][1]
    assert pii.sanitize(docs).columns == docs.columns and pii.spans(docs.limit(0)).count() == 0


def test_terms_of_a_single_document(spark):
    rows = [(0, "write to Marlowe at ann.b@mail.example about it"), *[(i, "write to us at once about it") for i in range(1, 300)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.disclosure(300, 1, 1, 1 - pii.DISCOUNT) > pii.GENERALISE > pii.disclosure(300, 1, 300, 1 - pii.DISCOUNT)
    assert pii.spans(docs).filter("doc_id = 0").first()["spans"] == "email:20:38,term:9:16"
    assert pii.sanitize(docs).filter("doc_id = 0").first()["text"] == "write to <NAME> at <EMAIL> about it"
    assert [pii.term_kind(w) for w in ("Marlowe", "MARLOWE", "marlowe", "Émile", "McCoy", "日本語")] == ["<NAME>", "<CODE>", "<WORD>", "<NAME>", "<NAME>", "<WORD>"]


def test_a_long_list_of_values_makes_no_product(spark):
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    listed = " ".join(f"name{letters(i)} a{i}@mail.org" for i in range(1500))
    rows = [(0, listed), (1, listed), (2, "namebaaa writes from a1@mail.org to us"), *[(i, "we write to all of you at once") for i in range(3, 120)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    own = pii.bundles(pii.holding(pii.prepared(docs)))
    # both lists hold all addresses, and one stands in a third row too: two bundles in each list
    assert {r["n"] for r in own.groupBy("key").agg(F.count("*").alias("n")).collect()} == {1, 2}
    assert sorted((x["doc_id"], x["spans"]) for x in pii.spans(docs).collect()) == plain_terms(rows)


def test_terms_far_from_the_value(spark):
    far = "and so we say once more to all of you " * 4
    text = f"marlowe has ann.b@mail.example {far}MARLOWE {far}quillon"
    rows = [(i, text) for i in range(6)] + [(10 + i, "and so we say once more to all of you has") for i in range(300)]
    got = pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id < 10").select("spans").distinct().collect()
    at = [text.index("marlowe"), text.index("MARLOWE"), text.index("quillon")]
    assert [r["spans"] for r in got] == ["email:12:30," + ",".join(f"term:{a}:{a + 7}" for a in at)]
    assert pii.places("\u0130 a Zeta\u0130 zeta", {"zeta": "remove"}) == [(10, 14, "remove")]


def test_spans_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, SECRET), (1, SECRET), (None, "x 1.2.3.4")], "doc_id long, text string")
    got = pii.spans(docs).collect()
    assert len(got) == 3 and sum(r["n_email"] for r in got) == 2 and sum(r["n_ip"] for r in got) == 1


def test_gradients():
    net = toxicity.Network.new({b"idiot": 1, b"a": 2}, 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x = net.inputs(*toxicity.features([b"idiot", b"a", b"", b"hello!", b"world"], net.vocabulary))
    x = x[np.array([[0, 1, 2, 3, 4], [4, 3, 1, 0, 0]])]
    mask, y, weight = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], bool), np.array([1.0, 0]), np.array([0.5, 0.5])

    def loss():
        gates = np.concatenate([x @ net.w[f"in_{d}"] + net.w[f"bias_{d}"] for d in "fb"], axis=2)
        return net.gradients(gates, mask, x, y, weight)

    g, dx, _ = loss()
    for k in ("re_f", "in_b", "out", "ask", "att"):
        at, e = tuple(0 for _ in net.w[k].shape), 1e-2
        net.w[k][at] += e
        up = loss()[2]
        net.w[k][at] -= 2 * e
        down = loss()[2]
        net.w[k][at] += e
        assert g[k][at] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=1e-5)
    assert not dx[1, 3:].any()


def test_a_word_has_one_input_wherever_it_stands():
    net = toxicity.Network.new({b"ab": 1})
    words = [b"idiot", b"", b"ab", b"x", b"\xc3\xa9t\xc3\xa9"]
    together = net.inputs(*toxicity.features(words, net.vocabulary))
    for i, w in enumerate(words):
        assert np.allclose(net.inputs(*toxicity.features([w], net.vocabulary))[0], together[i], atol=1e-6)


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 60, 1000):
        assert {k for a, b in toxicity.windows(n) for k in range(a, b)} == set(range(n))


def toxic_rows(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(r.choice(["th", "er", "on", "an", "re"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 150))]
        if i % 3 == 0:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "moron", "scum,"]))
        out.append((i, " ".join(words), int(i % 3 == 0)))
    return out


def plain_score(net, text):
    """The score of a text by the network's definition, one word and one window at a time."""
    words = [toxicity.bare(w) for w in text.lower().split()]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    h_ = toxicity.HIDDEN

    def vector(word):
        data = np.frombuffer(b"\2" + word + b"\3", np.uint8).astype(np.uint64)
        grams = [int(toxicity.hashed(np.array([a * np.uint64(65536) + b * np.uint64(256) + c + np.uint64(1)]), toxicity.GRAM_BUCKETS)[0]) for a, b, c in zip(data, data[1:], data[2:], strict=False)]
        return w["word"][net.vocabulary.get(word, 0)] + (sum(w["gram"][g] for g in grams) / len(grams) if grams else 0)

    best = -np.inf
    for a, b in toxicity.windows(len(words)):
        x, states = [vector(v) for v in words[a:b]], [[None] * (b - a) for _ in "fb"]
        for k, d in enumerate("fb"):
            h = np.zeros(h_)
            for t in range(b - a) if d == "f" else reversed(range(b - a)):
                g, u = x[t] @ w[f"in_{d}"] + w[f"bias_{d}"], h @ w[f"re_{d}"]
                z, r = sigmoid(g[:h_] + u[:h_]), sigmoid(g[h_ : 2 * h_] + u[h_ : 2 * h_])
                h = z * h + (1 - z) * np.tanh(g[2 * h_ :] + r * u[2 * h_ :])
                states[k][t] = h
        both = [np.concatenate(s) for s in zip(*states, strict=True)]
        ask = np.array([np.tanh(s @ w["att"]) @ w["ask"] for s in both])
        share = np.exp(ask - ask.max()) / np.exp(ask - ask.max()).sum()
        best = max(best, float(sum(p * s for p, s in zip(share, both, strict=True)) @ w["out"] + w["base"][0]))
    return 1 / (1 + np.exp(-best))


def test_scores_against_one_word_at_a_time(spark):
    rows = toxic_rows(200, 5)
    net = toxicity.train([t.encode() for _, t, _ in rows], [y for _, _, y in rows], epochs=1)
    texts = [t for _, t, _ in toxic_rows(25, 6)] + ["idiot", "unknown wörds: here!", "\u00e9 , ."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["toxicity_score"] for r in toxicity.score(docs, net).collect()}
    assert all(got[i] == pytest.approx(plain_score(net, t.encode()), abs=2e-4) for i, t in enumerate(texts))


def test_training_rows_are_bounded(spark):
    rows = toxic_rows(60, 3)
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    every = toxicity.training_rows(docs, labels)
    few = toxicity.training_rows(docs, labels, most_bytes=4000)
    assert set(few) < set(every) and {y for _, y in few} == {0, 1} and all(sum(len(t) for t, y in few if y == k) <= 2000 for k in (0, 1))
    assert len(toxicity.training_rows(docs, labels, most=10)) == 10 and len(toxicity.training_rows(docs, labels, most_bytes=0)) == 2


def test_held_out_accuracy(spark):
    rows = toxic_rows(500, 3)
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows] + [(9001, None, 0.0), (9002, "", 0.0), (9003, "plain then idiot " + "er on " * 30_000, 0.0)], "doc_id long, text string, toxicity_score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    y = {i: y for i, _, y in rows}
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] in y]
    assert len(held) > 60 and np.mean([r["predicted"] == y[r["doc_id"]] for r in held]) > 0.95
    assert got[9001]["score"] == got[9002]["score"] < 0.5 and got[9003]["predicted"] == 1
    one_kind = toxicity.classify(docs, labels.filter("toxic = 0")).collect()
    assert len({round(r["score"], 6) for r in one_kind}) == 1
    scored = toxicity.score(docs, toxicity.train([b"a"], [0]))
    assert scored.columns == [*docs.columns, "_toxicity_score"]
