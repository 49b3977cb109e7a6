"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of an embedding of the word, if it is in the vocabulary of the training rows, and the mean of
hashed embeddings of its character trigrams.  Texts are read in overlapping windows, all of them; two gated recurrent
layers read a window from either end, attention pools their states, and a text's score is that of its worst window.
Training picks the worst window of each labelled text again in every epoch (labels are of whole texts).

Training takes at most `sample_rows` labelled rows, half of each label if there are so many, in the order of a
hash of doc_id, and whole texts up to `sample_bytes`; these bounds are parameters.  Scoring reads every word of every row.

Defined results: a null text counts as an empty one, which has no window and gets the share of toxic
rows in training, at most 0.49; with labels of one kind alone every text gets that share; of repeated
labels for an id the highest counts; repeated rows each give a row; an empty
table gives no rows; a very long text is taken whole, in a slice of its own, with all its windows; other columns are left out by `classify` and kept by `score`.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundline.llm import common

#: Labelled rows that training takes at most, and bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 2400, 64 << 20
#: Words of the vocabulary at most (all others share its first place), and of how many training texts each is.
VOCABULARY, LEAST_TEXTS = 1 << 15, 3
GRAM_BUCKETS = 1 << 12
INPUT, HIDDEN, ATTENTION = 12, 8, 8
WINDOW, STRIDE = 32, 20
EPOCHS, BATCH, RATE = 5, 64, 0.02
CACHE_ENTRIES = 150_000
_EDGE = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def bare(word: bytes) -> bytes:
    """A word without the signs at its ends."""
    return word if word.isalnum() else _EDGE.sub(b"", word) or word


def hashed(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values * _MIX) >> np.uint64(40)).astype(np.int64) % buckets


def features(words: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the vocabulary, buckets of all character trigrams (ends marked), and where each word's trigrams begin."""
    words = [bare(w) for w in words]
    ids = np.fromiter((vocabulary.get(w, 0) for w in words), np.int64, len(words))
    data = np.frombuffer(b"\2" + b"\3\2".join(words) + b"\3", np.uint8).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    grams = hashed(data[:-2] * np.uint64(65536) + data[1:-1] * np.uint64(256) + data[2:] + np.uint64(1), GRAM_BUCKETS)
    begins = np.concatenate(([0], np.cumsum(lengths + 2)[:-1]))
    return ids, grams, begins


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights by name; forward and backward passes over batches of windows."""

    w: dict[str, np.ndarray]
    vocabulary: dict[bytes, int]
    prior: float = 0.0

    @classmethod
    def new(cls, vocabulary: dict[bytes, int], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        make = lambda *n: (r.standard_normal(n) / np.sqrt(n[0])).astype(np.float32)
        n = len(vocabulary) + 1
        w = {"word": 0.1 * make(n, INPUT) * np.sqrt(n), "gram": 0.1 * make(GRAM_BUCKETS, INPUT) * np.sqrt(GRAM_BUCKETS)}
        for d in "fb":
            w |= {f"in_{d}": make(INPUT, 3 * HIDDEN), f"re_{d}": make(HIDDEN, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, np.float32)}
        w |= {"att": make(2 * HIDDEN, ATTENTION), "ask": make(ATTENTION, 1)[:, 0], "out": make(2 * HIDDEN, 1)[:, 0], "base": np.zeros(1, np.float32)}
        return cls({k: v.astype(np.float32) for k, v in w.items()}, vocabulary)

    @property
    def prior_logit(self) -> float:
        return float(np.log((self.prior + 1e-6) / (1 - self.prior)))

    def inputs(self, ids: np.ndarray, grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The input vector of each word."""
        counts = np.diff(np.concatenate((begins, [len(grams) + 2]))) - 2
        sums = np.add.reduceat(self.w["gram"][np.concatenate((grams, [0, 0]))], begins, axis=0)
        # reduceat also takes in the two trigrams that reach over into the next word
        tail = begins + np.maximum(counts, 1)
        over = np.concatenate((grams, [0, 0, 0]))
        sums -= np.where((counts > 0)[:, None], self.w["gram"][over[tail]] + self.w["gram"][over[tail + 1]], sums)
        return self.w["word"][ids] + sums / np.maximum(counts, 1)[:, None]

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Both directions' gate inputs of each word, side by side."""
        return np.concatenate([x @ self.w[f"in_{d}"] + self.w[f"bias_{d}"] for d in "fb"], axis=1).astype(np.float32)

    def table(self, ids: np.ndarray, grams: np.ndarray, begins: np.ndarray, at_once: int = 10_000) -> np.ndarray:
        """The gate inputs of many words, some at a time."""
        ends = np.concatenate((begins[1:], [len(grams) + 2]))
        out = np.empty((len(ids), 6 * HIDDEN), np.float32)
        for a in range(0, len(ids), at_once):
            s, b, e = slice(a, a + at_once), begins[a], ends[min(a + at_once, len(ids)) - 1]
            out[s] = self.projected(self.inputs(ids[s], grams[b : e - 2], begins[s] - b))
        return out

    def run(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; gates: [windows, steps, 6 * HIDDEN], mask: which steps hold a word."""
        n, steps, _ = gates.shape
        h3, kept, states = 3 * HIDDEN, {"f": [], "b": []}, np.zeros((n, steps, 2 * HIDDEN), np.float32)
        full = mask.all()
        for k, d in enumerate("fb"):
            h, re_ = np.zeros((n, HIDDEN), np.float32), self.w[f"re_{d}"]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                g, u = gates[:, t, k * h3 : (k + 1) * h3], h @ re_
                zr = sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
                new = c + z * (h - c)
                if not full:
                    new = np.where(mask[:, t, None], new, h)
                if keep:
                    kept[d].append((t, h, z, r, c, u[:, 2 * HIDDEN :]))
                h = new
                states[:, t, k * HIDDEN : (k + 1) * HIDDEN] = h
        seen = np.tanh(states @ self.w["att"])
        score = seen @ self.w["ask"]
        score = score - score.max(axis=1, keepdims=True)
        share = np.exp(score) * mask
        share /= share.sum(axis=1, keepdims=True)
        pooled = (states * share[:, :, None]).sum(axis=1)
        logits = pooled @ self.w["out"] + self.w["base"][0]
        return (logits, (kept, states, seen, share, pooled)) if keep else logits

    def gradients(self, gates: np.ndarray, mask: np.ndarray, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Of the weighted cross-entropy, by weight, and by x [windows, steps, INPUT]; and the loss."""
        logits, (kept, states, seen, share, pooled) = self.run(gates, mask, keep=True)
        p = sigmoid(logits)
        loss = float(-(weight * (target * np.log(p + 1e-7) + (1 - target) * np.log(1 - p + 1e-7))).sum())
        dl = ((p - target) * weight).astype(np.float32)
        g = {"out": pooled.T @ dl, "base": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * self.w["out"]
        dshare = (states * dpool[:, None, :]).sum(axis=2)
        dstates = share[:, :, None] * dpool[:, None, :]
        dscore = share * (dshare - (share * dshare).sum(axis=1, keepdims=True))
        g["ask"] = np.einsum("nta,nt->a", seen, dscore)
        dseen = dscore[:, :, None] * self.w["ask"] * (1 - seen * seen)
        g["att"] = np.einsum("nth,nta->ha", states, dseen)
        dstates += dseen @ self.w["att"].T
        dx, h3 = np.zeros_like(x), 3 * HIDDEN
        for k, d in enumerate("fb"):
            re_, dh = self.w[f"re_{d}"], np.zeros((len(x), HIDDEN), np.float32)
            dre, dgates = np.zeros_like(re_), np.zeros((*x.shape[:2], h3), np.float32)
            for t, h, z, r, c, u in reversed(kept[d]):
                dh = dh + dstates[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                live = mask[:, t, None]
                dn = np.where(live, dh, 0)
                dz, dc = dn * (h - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
                dr = dc * u * r * (1 - r)
                dgates[:, t] = np.concatenate((dz, dr, dc), axis=1)
                du = np.concatenate((dz, dr, dc * r), axis=1)
                dre += h.T @ du
                dh = np.where(live, dn * z, dh) + du @ re_.T
            g[f"re_{d}"], g[f"bias_{d}"] = dre, dgates.sum(axis=(0, 1))
            g[f"in_{d}"] = np.einsum("nti,ntg->ig", x, dgates)
            dx += dgates @ self.w[f"in_{d}"].T
        return g, dx, loss


def windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over all words of a text: begins and ends."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    begins = [*range(0, n - WINDOW, STRIDE), n - WINDOW]
    return [(b, b + WINDOW) for b in begins]


def window_index(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: the position of each window's words (0 beyond its end), the mask, and the text of each window."""
    begins, ends, owners, at = [], [], [], 0
    for i, n in enumerate(lengths.tolist()):
        for b, e in windows(n):
            begins.append(at + b)
            ends.append(at + e)
            owners.append(i)
        at += n
    begins, ends = np.asarray(begins, np.int64), np.asarray(ends, np.int64)
    places = begins[:, None] + np.arange(WINDOW)
    mask = places < ends[:, None]
    return np.where(mask, places, 0).astype(np.int32), mask, np.asarray(owners, np.int64)


def vocabulary_of(texts: list[list[bytes]], most: int = VOCABULARY, least: int = LEAST_TEXTS) -> dict[bytes, int]:
    """The words of most texts, numbered from 1."""
    counts = Counter(w for words in texts for w in {bare(x) for x in words})
    frequent = sorted((w for w, n in counts.items() if n >= least), key=lambda w: (-counts[w], w))[:most]
    return {w: i for i, w in enumerate(frequent, 1)}


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network from whole labelled texts."""
    r = np.random.default_rng(seed)
    split = [words_of(t) for t in texts]
    net = Network.new(vocabulary_of(split), seed)
    y = np.asarray(labels, np.float32)
    net.prior = float(min(0.49, y.mean())) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        net.w["out"][:] = 0
        net.w["base"][0] = net.prior_logit
        return net
    number: dict[bytes, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64) for words in split]
    del split
    y = y[[i for i, d in enumerate(docs) if len(d)]]
    docs = [d for d in docs if len(d)]
    ids, grams, begins = features(list(number), net.vocabulary)
    grams_of = np.diff(np.concatenate((begins, [len(grams) + 2]))) - 2
    # words begin with their log odds in one dimension
    have = [np.bincount(np.concatenate([np.unique(ids[d]) for d, v in zip(docs, y, strict=True) if v == k]), minlength=len(net.vocabulary) + 1) for k in (0, 1)]
    totals = [(y == k).sum() for k in (0, 1)]
    odds = np.log((have[1] + 0.5) / (totals[1] + 1)) - np.log((have[0] + 0.5) / (totals[0] + 1))
    net.w["word"][:, 0] = np.where(np.arange(len(odds)) > 0, np.clip(odds, -1, 4), 0)
    lengths = np.fromiter(map(len, docs), np.int64)
    flat = np.concatenate(docs)
    places, mask, owner = window_index(lengths)
    first = np.searchsorted(owner, np.arange(len(docs)))
    weight = np.where(y == 1, 0.5 / totals[1], 0.5 / totals[0]).astype(np.float32) * len(y)
    m: dict[str, tuple[np.ndarray, np.ndarray]] = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    step = 0

    def window_logits() -> np.ndarray:
        gates = net.table(ids, grams, begins)
        return np.concatenate([net.run(gates[flat[places[a : a + 1024]]], mask[a : a + 1024]) for a in range(0, len(places), 1024)])

    for epoch in range(epochs):
        logits = window_logits()
        worst = np.array([s + int(np.argmax(logits[s:e])) for s, e in zip(first, [*first[1:], len(owner)], strict=True)])
        if epoch == 0:  # before anything is learned, the window of the highest odds
            gain = np.where(mask, net.w["word"][ids[flat[places]], 0], 0).max(axis=1)
            worst = np.array([s + int(np.argmax(gain[s:e])) for s, e in zip(first, [*first[1:], len(owner)], strict=True)])
        order = r.permutation(len(docs))
        rate = RATE * (1 - epoch / epochs) + 0.002
        for a in range(0, len(order), BATCH):
            chosen = order[a : a + BATCH]
            rows = worst[chosen]
            words = flat[places[rows]]
            distinct, back = np.unique(words, return_inverse=True)
            spans = [np.arange(begins[w], begins[w] + grams_of[w]) for w in distinct]
            part = np.concatenate(([0], np.cumsum([len(s) + 2 for s in spans])[:-1]))
            own = np.concatenate([np.concatenate((grams[s], [0, 0])) for s in spans])[:-2]
            x = net.inputs(ids[distinct], own, part)
            back = back.reshape(words.shape)
            g, dx, _ = net.gradients(net.projected(x)[back], mask[rows], x[back], y[chosen], weight[chosen] / len(chosen))
            dword = np.zeros_like(x)
            np.add.at(dword, back[mask[rows]], dx[mask[rows]])
            step += 1
            for name, grad in g.items():
                adam(net.w[name], grad, *m[name], step, rate)
            for name, at, grad in (("word", ids[distinct], dword), ("gram", np.concatenate([grams[s] for s in spans]), np.repeat(dword / np.maximum(grams_of[distinct], 1)[:, None], grams_of[distinct], axis=0))):
                rows_, inverse = np.unique(at, return_inverse=True)
                total = np.zeros((len(rows_), INPUT), np.float32)
                np.add.at(total, inverse, grad)
                adam(net.w[name], total, *m[name], step, rate, rows_)
    net.w["base"][0] -= boundary(np.maximum.reduceat(window_logits(), first), y)
    return net


def boundary(logits: np.ndarray, y: np.ndarray) -> float:
    """A point of the gap between texts' logits that parts the labels best; a clean text called toxic counts twice.

    It stands at three quarters, as clean texts that are new stray farther than toxic ones.
    """
    order = np.argsort(logits)
    at, toxic = logits[order], y[order] == 1
    # with the boundary after the first k texts: toxic ones among them, and clean ones beyond
    wrong = np.concatenate(([0], np.cumsum(toxic))) / max(1, toxic.sum()) + 2 * ((~toxic).sum() - np.concatenate(([0], np.cumsum(~toxic)))) / max(1, (~toxic).sum())
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    gaps = [((at[k - 1] if k else at[0]), (at[k] if k < len(at) else at[-1])) for k in best]
    low, high = max(gaps, key=lambda g: g[1] - g[0])
    return float(low + 0.75 * (high - low))


def adam(w: np.ndarray, grad: np.ndarray, first: np.ndarray, second: np.ndarray, step: int, rate: float, rows=slice(None)) -> None:
    first[rows] = 0.9 * first[rows] + 0.1 * grad
    second[rows] = 0.99 * second[rows] + 0.01 * grad * grad
    w[rows] -= (rate * (first[rows] / (1 - 0.9**step)) / (np.sqrt(second[rows] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


class Scorer:
    """Scores whole texts; the gate inputs of words seen before are kept in a table."""

    def __init__(self, net: Network, entries: int = CACHE_ENTRIES):
        self.net, self.entries = net, entries
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)

    def score(self, texts: list[bytes], at_once: int = 2048) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        if len(self.number) > self.entries:
            self.clear()
        new = set()
        for d in docs:
            new.update(d)
        new = list(new.difference(self.number))
        if new:
            have = len(self.number)
            self.number.update(zip(new, range(have, have + len(new)), strict=True))
            if have + len(new) > len(self.table):
                grown = np.zeros((have + len(new) + 50_000, 6 * HIDDEN), np.float32)
                grown[:have] = self.table[:have]
                self.table = grown
            for a in range(0, len(new), 20_000):
                part = new[a : a + 20_000]
                self.table[have + a : have + a + len(part)] = self.net.projected(self.net.inputs(*features(part, self.net.vocabulary)))
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        flat = np.fromiter((i for d in docs for i in map(self.number.__getitem__, d)), np.int64, int(lengths.sum()))
        out = np.full(len(docs), np.float64(np.float32(self.net.prior_logit)))
        out[lengths > 0] = -np.inf
        places, mask, owner = window_index(lengths)
        for a in range(0, len(owner), at_once):
            b = a + at_once
            np.maximum.at(out, owner[a:b], self.net.run(self.table[flat[places[a:b]]], mask[a:b]).astype(np.float64))
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """At most `most` labelled texts of `most_bytes` together that are not held out, half of each label if there are so many."""
    rows = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("label"))
    rows = rows.filter(~held_out("label_id")).withColumn("order", F.xxhash64("label_id"))
    pick = [rows.filter(c).orderBy("order", "label_id").limit(most // 2).select("label_id", "label") for c in ("label = 1", "label = 0")]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))  # at most `most` rows
    found = docs.select(F.col("doc_id").cast("long").alias("label_id"), common.as_bytes(common.text_or_empty()).alias("_text")).join(chosen, "label_id")
    one = found.groupBy("label_id", "label").agg(F.min("_text").alias("_text"))
    # of at most `most` rows, those of each label whose texts together stay within half the bytes, and the first in any case
    before = Window.partitionBy("label").orderBy(F.xxhash64("label_id"), "label_id")
    one = one.withColumns({"_sum": F.sum(F.octet_length("_text")).over(before), "_place": F.row_number().over(before)}).filter((F.col("_sum") <= most_bytes // 2) | (F.col("_place") == 1))
    return [(bytes(r["_text"]), int(r["label"])) for r in one.orderBy(F.xxhash64("label_id"), "label_id").collect()]


def held_out(column: str, of: int = 5, remainder: int = 0):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % of == remainder, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Network:
    rows = training_rows(docs, labels, most, most_bytes)
    return train([t for t, _ in rows], [y for _, y in rows])


_scorers: dict[str, Scorer] = {}


def score(docs: DataFrame, net: Network, text_col: str = "text", name: str = "toxicity_score") -> DataFrame:
    """The rows of docs with their columns, and last the score, by that name if it is free; the text column is read whole."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(pickle.dumps(net))  # its size is fixed by the numbers of buckets
    key, name, text = uuid.uuid4().hex, common.fresh(name, docs.columns), common.fresh("text_bytes", docs.columns)
    rows = docs.withColumn(text, common.as_bytes(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    target = common.arrow_schema_of(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("toxicity", _scorers.clear)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(pickle.loads(model.value))
        scorer = _scorers[key]
        for b in common.slices(batches, f"c{len(target) - 1}", 4 << 20):
            got = pa.array(scorer.score(b.column(len(target) - 1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).cast(f.type) for k, f in enumerate(list(target)[:-1])), got], schema=target)

    return common.numbered(rows).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    net = fit(docs, labels, most, most_bytes)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), net)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))
