"""Language-model scores by deleted interpolation.

The probability of a token after its two predecessors mixes maximum-likelihood estimates of three orders with the uniform one,

    p3(w | u, v) = l3[b] * c(u, v, w) / c(u, v) + (1 - l3[b]) * p2(w | v),    b the bucket of c(u, v),
    p2(w | v) = l2[b] * c(v, w) / c(v) + (1 - l2[b]) * p1(w),                 b the bucket of c(v),
    p1(w) = l1 * c(w) / N + (1 - l1) / (V + 1),

with weights for each bucket of the context's frequency, doubling from bucket to bucket.  The weights are learned by
expectation-maximisation on the exact counts of a part of the training documents that is deleted from the estimates while they
are learned; each round is a sum over all deleted tokens, where they lie.  The final estimates count both parts.

The corpus is read once, into blocks of documents whose tokens are numbers of the block's own word list.  A block sends the
hashes of its distinct words and pairs, with their counts, to key ranges; a range sums each key over all blocks
and answers each block with the sums of its keys, in its order.  So a frequent key costs a block one entry,
rows are many times fewer than tokens, and a task holds one block or one range.  Triples go the same way afterwards, but for those
whose first two words stand together once in the whole corpus: their counts are known where they stand.

Words, pairs and triples are told apart by 64-bit hashes, without confirmation.  Defined results: a null text counts as an empty one, which
has the end token alone; a null doc_id trains and is not held out; repeated rows each give a row and count each; where a context
was never seen its order is left out, and without training tokens all weight goes to 1 / (V + 1); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm import common
from groundline.llm.neardup import mixed

BLOCK_TOKENS = 1_500_000
#: Distinct keys of a range, about.
RANGE_KEYS = 1_500_000
FOLDS, TEST_FOLD, DELETED_FOLD = 5, 1, 4
CORE, DELETED, TEST = 0, 1, 2
#: Rounds of expectation-maximisation at most, and the change of all weights at which they end.
ROUNDS, SETTLED = 25, 1e-3
#: Context buckets: 0, 1, 2-3, 4-7 ...
BUCKETS = 40
END_KEY, START_KEY = b"\n<end>", b"\n<start>"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    """Words by first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def shrunk(values: np.ndarray) -> bytes:
    """Bytes of like weight side by side, compressed."""
    import zstandard

    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def grown(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


BLOCK_DDL = "block long, doc_ids binary, known binary, lengths binary, parts binary, words binary, tokens binary"


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents in blocks: ids, token counts, the part each belongs to, hashes of the word list (the end token first), tokens as numbers."""
    out = common.arrow_schema(BLOCK_DDL)
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    part = F.when(fold == TEST_FOLD, TEST).when(fold == DELETED_FOLD, DELETED).otherwise(CORE).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), part.alias("part"), common.as_bytes(common.text_or_empty(text_col)).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        number, first = 0, TaskContext.get().partitionId() << 24
        ids: list = []
        parts: list[int] = []
        lengths: list[int] = []
        tokens: list[np.ndarray] = []
        words, held = Numbers({END_KEY: 0}), 0

        def flush() -> pa.RecordBatch:
            nonlocal number, words, held
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            row = [first + number, np.array([i or 0 for i in ids], np.int64).tobytes(), np.array([i is not None for i in ids], np.uint8).tobytes(), np.array(lengths, np.int64).tobytes(), np.array(parts, np.uint8).tobytes(), shrunk(hashes), shrunk(np.concatenate(tokens))]
            number, words, held = number + 1, Numbers({END_KEY: 0}), 0
            for x in (ids, parts, lengths, tokens):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out, strict=True)], schema=out)

        for b in common.slices(batches, "text", 4 << 20):
            for doc_id, part, text in zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = text.lower().split()
                ids.append(doc_id)
                parts.append(part)
                lengths.append(len(own) + 1)
                tokens.append(np.fromiter(itertools.chain(map(words.__getitem__, own), (0,)), np.uint32, len(own) + 1))
                held += len(own) + 1
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    return rows.mapInArrow(run, BLOCK_DDL)


class Block:
    """A block's tokens with their predecessors, and its distinct words, pairs and triples."""

    def __init__(self, row: dict):
        import xxhash

        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.parts = np.frombuffer(row["parts"], np.uint8)
        self.tokens = grown(row["tokens"], np.uint32).astype(np.int64)
        self.words = grown(row["words"], np.uint64)
        self.n_words = len(self.words)
        #: The start stands before a document's first token, numbered beyond all words.
        self.ends = np.cumsum(self.lengths)
        self.first = self.ends - self.lengths
        self.before = np.empty(len(self.tokens), np.int64)
        self.before[1:] = self.tokens[:-1]
        self.before[self.first] = self.n_words
        self.pair, self.distinct = pd.factorize(self.before * self.n_words + self.tokens)
        self.part = np.repeat(self.parts, self.lengths)
        left = np.append(self.words, np.uint64(xxhash.xxh3_64_intdigest(START_KEY)))[self.distinct // self.n_words]
        self.pair_keys = mixed(mixed(left * _GOLD) + self.words[self.distinct % self.n_words])

    def triples(self, often: np.ndarray) -> None:
        """Number the triples whose first two words are a pair that comes often (by distinct pair)."""
        ahead = np.empty(len(self.tokens), np.int64)  # the pair before each token, -1 at a document's first
        ahead[1:] = self.pair[:-1]
        ahead[self.first] = -1
        self.ahead = ahead
        self.asked = np.flatnonzero((ahead >= 0) & often[ahead])
        self.triple, codes = pd.factorize(ahead[self.asked] * self.n_words + self.tokens[self.asked])
        self.triple_keys = mixed(mixed(self.pair_keys[codes // self.n_words] * _GOLD + np.uint64(1)) + self.words[codes % self.n_words])


def dealt(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys' ascending order, and where each range begins in it and ends."""
    order = np.argsort(keys)
    ranges = (keys[order] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    return order, np.searchsorted(ranges, np.arange((1 << bits) + 1))


#: Counts by part go beside the keys; those of held-out documents tell only how often a pair comes at all.
COUNTS = ("core", "deleted", "test")
KEY_DDL = "kind int, range int, block long, keys binary, core binary, deleted binary, test binary"
WORD, PAIR, TRIPLE = 0, 1, 2


def keyed(row: dict, triples: bool) -> list[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Kind, keys and counts by part of the distinct words and pairs of a block, or of its triples."""
    block = Block(row)
    count = lambda where, part, size: np.bincount(where * 3 + part, minlength=3 * size).astype(np.uint32).reshape(-1, 3).T
    if triples:
        block.triples(grown(row["pair_core"], np.uint64) + grown(row["pair_deleted"], np.uint64) + grown(row["pair_test"], np.uint64) > 1)
        return [(TRIPLE, block.triple_keys, count(block.triple, block.part[block.asked], len(block.triple_keys)))]
    return [(WORD, block.words, count(block.tokens, block.part, block.n_words)), (PAIR, block.pair_keys, count(block.pair, block.part, len(block.distinct)))]


def sent(block_rows: DataFrame, bits: int, triples: bool = False) -> DataFrame:
    """A row for each block, kind and range: its keys in ascending order and their counts."""
    out = common.arrow_schema(KEY_DDL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {f.name: b.column(f.name)[k].as_py() for f in b.schema}
                for kind, keys, counts in keyed(row, triples):
                    order, cuts = dealt(keys, bits)
                    rows = []
                    for r in range(1 << bits):
                        at = order[cuts[r] : cuts[r + 1]]
                        if len(at):
                            ascending = keys[at]
                            rows.append((kind, r, row["block"], shrunk(np.diff(ascending, prepend=np.uint64(0))), *(shrunk(c[at]) for c in counts)))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    more = ["pair_core", "pair_deleted", "pair_test"] if triples else []
    return block_rows.select("block", "lengths", "parts", "words", "tokens", *more).mapInArrow(run, KEY_DDL)


SUM_DDL = "block long, kind int, range int, core binary, deleted binary, test binary, n_distinct long, n_core long, n_deleted long"


def summed(keys: DataFrame, ranges: int) -> DataFrame:
    """The answer to each row of `sent`: sums over all blocks for its keys; beside the first row of a range, its totals."""
    out = common.arrow_schema(SUM_DDL)

    def answer(rows: list[dict]) -> pa.RecordBatch:
        lists = [np.cumsum(grown(r["keys"], np.uint64)) for r in rows]
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")
        ascending = every[order]
        new = np.concatenate(([True], ascending[1:] != ascending[:-1]))
        group = np.empty(len(every), np.int64)
        group[order] = np.cumsum(new) - 1
        totals = [np.bincount(group, np.concatenate([grown(r[p], np.uint32) for r in rows])).astype(np.uint64) for p in COUNTS]
        got, at = [], 0
        for i, (r, keys_) in enumerate(zip(rows, lists, strict=True)):
            own = group[at : at + len(keys_)]
            at += len(keys_)
            own_totals = (int(((totals[0] + totals[1]) > 0).sum()), int(totals[0].sum()), int(totals[1].sum())) if i == 0 else (0, 0, 0)
            # the last is asked for pairs alone
            got.append((r["block"], r["kind"], r["range"], shrunk(totals[0][own]), shrunk(totals[1][own]), shrunk(totals[2][own]) if r["kind"] == PAIR else b"", *own_totals))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), out, strict=True)], schema=out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and (held[0]["kind"], held[0]["range"]) != (r["kind"], r["range"]):
                    yield answer(held)
                    held = []
                held.append(r)
        if held:
            yield answer(held)

    return keys.repartition(max(1, ranges), "kind", "range").sortWithinPartitions("kind", "range").mapInArrow(run, SUM_DDL)


def gathered(keys: np.ndarray, bits: int, replies: dict, kind: int, names: tuple[str, ...]) -> list[np.ndarray]:
    """The sums of a block's keys, in their order, from the answers of the ranges."""
    order, cuts = dealt(keys, bits)
    got = np.zeros((len(names), len(keys)), np.uint64)
    for r in range(1 << bits):
        if cuts[r + 1] > cuts[r]:
            for p, name in enumerate(names):
                got[p, order[cuts[r] : cuts[r + 1]]] = grown(replies[kind, r][name], np.uint64)
    return list(got)


PAIRED_DDL = BLOCK_DDL + ", word_core binary, word_deleted binary, pair_core binary, pair_deleted binary, pair_test binary"


def paired(block_rows: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    """Blocks with the sums of their words and pairs."""
    out = common.arrow_schema(PAIRED_DDL)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block, replies = Block(row), {(r["kind"], r["range"]): r for r in right.to_pylist()}
        sums = gathered(block.words, bits, replies, WORD, COUNTS[:2]) + gathered(block.pair_keys, bits, replies, PAIR, COUNTS)
        values = [*(row[f.name] for f in list(out)[: len(row)]), *map(shrunk, sums)]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, out, strict=True)], schema=out)

    own = block_rows.select(*[f.split(" ")[0] for f in BLOCK_DDL.split(", ")])
    return own.groupBy("block").cogroup(answers.drop("n_distinct", "n_core", "n_deleted").groupBy("block")).applyInArrow(run, PAIRED_DDL)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for 0, 1 for 1, 2 for 2 and 3, 3 for 4 to 7 and so on."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


COUNTED_DDL = "doc_ids binary, known binary, lengths binary, parts binary, of_word binary, of_pair binary, of_triple binary, cells binary, cell_counts binary"
#: What a token's probability is made of, beside totals.
CELL = ("triple", "triple_context", "pair", "pair_context", "word")


def cells_of(block: Block, at: np.ndarray, word: np.ndarray, pair: np.ndarray, triple: np.ndarray, documents: int) -> np.ndarray:
    """Rows of CELL for the tokens at these places, from counts by distinct word, by distinct pair, and by token."""
    ahead = block.ahead[at]
    return np.stack([triple[at], np.where(ahead >= 0, pair[ahead], 0), pair[block.pair[at]], np.append(word, np.uint64(documents))[block.before[at]], word[block.tokens[at]]]).astype(np.int64)


def repeated(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns and how often each comes."""
    code = np.zeros(cells.shape[1], np.int64)
    for column in cells:
        value, values = pd.factorize(column)
        code = pd.factorize(code * max(1, len(values)) + value)[0]
    _, first = np.unique(code, return_index=True)
    return cells[:, first], np.bincount(code, minlength=len(first))


def counted(block_rows: DataFrame, answers: DataFrame, bits: int, core_docs: int) -> DataFrame:
    """Counts of each token, its pair and its triple, beside the documents of each block; and the deleted tokens' cells with their numbers."""
    out = common.arrow_schema(COUNTED_DDL)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = Block(row)
        word, pair = ([grown(row[f"{k}_{p}"], np.uint64) for p in names] for k, names in (("word", COUNTS[:2]), ("pair", COUNTS)))
        block.triples(pair[0] + pair[1] + pair[2] > 1)
        replies = {(r["kind"], r["range"]): r for r in right.to_pylist()}
        sums = gathered(block.triple_keys, bits, replies, TRIPLE, COUNTS[:2])
        # a pair that stands once in all the corpus has its triple's count with it
        triple = [np.where((block.ahead >= 0) & (block.part == p), 1, 0).astype(np.uint64) for p in (CORE, DELETED)]
        for t, got in zip(triple, sums, strict=True):
            t[block.asked] = got[block.triple]
        cells, counts = repeated(cells_of(block, np.flatnonzero(block.part == DELETED), word[0], pair[0], triple[0], core_docs))
        totals = (word[0] + word[1])[block.tokens], (pair[0] + pair[1])[block.pair], triple[0] + triple[1]
        values = [row["doc_ids"], row["known"], row["lengths"], row["parts"], *(shrunk(t.astype(np.uint64)) for t in totals), shrunk(cells.reshape(-1).astype(np.uint64)), shrunk(counts.astype(np.uint64))]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, out, strict=True)], schema=out)

    right = answers.filter(F.col("kind") == TRIPLE).select("block", "kind", "range", "core", "deleted")
    return block_rows.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, COUNTED_DDL)


class Weights:
    """The share of each order's own estimate: by bucket of its context for triples and pairs, and one for words."""

    def __init__(self, triple: np.ndarray | None = None, pair: np.ndarray | None = None, word: float = 0.5):
        self.triple = np.full(BUCKETS, 0.5) if triple is None else triple
        self.pair = np.full(BUCKETS, 0.5) if pair is None else pair
        self.word = word

    def flat(self) -> np.ndarray:
        return np.concatenate((self.triple, self.pair, [self.word]))

    def parts(self, cells: np.ndarray, tokens: int, vocabulary: int) -> tuple[np.ndarray, ...]:
        """The probability of each cell by the order that gives it: triple, pair, word, uniform."""
        triple, triple_context, pair, pair_context, word = (c.astype(np.float64) for c in cells)
        a = np.where(triple_context > 0, self.triple[context_bucket(triple_context)], 0.0)
        b = np.where(pair_context > 0, self.pair[context_bucket(pair_context)], 0.0)
        c = self.word if tokens else 0.0
        left = (1 - a) * (1 - b)
        return a * triple / np.maximum(triple_context, 1), (1 - a) * b * pair / np.maximum(pair_context, 1), left * c * word / max(tokens, 1), left * (1 - c) / (vocabulary + 1)

    def probabilities(self, cells: np.ndarray, tokens: int, vocabulary: int) -> np.ndarray:
        return sum(self.parts(cells, tokens, vocabulary))

    def expected(self, cells: np.ndarray, counts: np.ndarray, tokens: int, vocabulary: int) -> np.ndarray:
        """Sums over cells: how often an order was asked and how often it gave the token, by bucket, for triples, pairs and words."""
        parts = self.parts(cells, tokens, vocabulary)
        shares = [p / sum(parts) * counts for p in parts]
        out = []
        for k, context in enumerate((cells[1], cells[3])):
            seen = context > 0
            bucket = context_bucket(context[seen])
            for own in (sum(shares[k:]), shares[k]):
                out.append(np.bincount(bucket, own[seen], minlength=BUCKETS))
        return np.concatenate([*out, [(shares[2] + shares[3]).sum(), shares[2].sum()]])

    def next(self, sums: np.ndarray) -> Weights:
        """Those that the sums give; a bucket that was never asked gets the share of all buckets."""
        got = []
        for k in (0, 1):
            asked, gave = (sums[(2 * k + j) * BUCKETS : (2 * k + j + 1) * BUCKETS] for j in (0, 1))
            every = gave.sum() / asked.sum() if asked.sum() > 0 else 0.5
            got.append(np.clip(np.where(asked > 0, gave / np.maximum(asked, 1e-300), every), 1e-6, 1 - 1e-6))
        asked, gave = sums[4 * BUCKETS :]
        return Weights(*got, float(np.clip(gave / asked, 1e-6, 1 - 1e-6)) if asked > 0 else 0.5)


def settled(expected, rounds: int = ROUNDS) -> Weights:
    """Expectation-maximisation; `expected` gives the sums over all deleted tokens for some weights."""
    weights = Weights()
    for _ in range(rounds):
        before, weights = weights, weights.next(expected(weights))
        if np.abs(before.flat() - weights.flat()).max() < SETTLED:
            break
    return weights


def learned(rows: DataFrame, tokens: int, vocabulary: int) -> Weights:
    """Weights from the cells of all blocks; each round sums them up where they lie, and a row for each weight comes back."""
    out = common.arrow_schema(ddl := "k int, v double")
    cells = rows.select("cells", "cell_counts")

    def expected(weights: Weights) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(4 * BUCKETS + 2)
            for b in batches:
                for c, n in zip(b.column("cells"), b.column("cell_counts"), strict=True):
                    counts = grown(n.as_py(), np.uint64).astype(np.float64)
                    if len(counts):
                        total += weights.expected(grown(c.as_py(), np.uint64).reshape(len(CELL), -1).astype(np.int64), counts, tokens, vocabulary)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], schema=out)

        got = np.zeros(4 * BUCKETS + 2)
        for r in cells.mapInArrow(run, ddl).groupBy("k").agg(F.sum("v").alias("v")).collect():
            got[r["k"]] = r["v"]
        return got

    return settled(expected)


SCORE_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(rows: DataFrame, train_docs: int, tokens: int, vocabulary: int, weights: Weights) -> DataFrame:
    out = common.arrow_schema(SCORE_DDL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {f.name: b.column(f.name)[k].as_py() for f in b.schema}
                lengths, parts = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["parts"], np.uint8)
                word, pair, triple = (grown(row[c], np.uint64).astype(np.int64) for c in ("of_word", "of_pair", "of_triple"))
                begins = np.cumsum(lengths) - lengths
                context, ahead = np.empty(len(word), np.int64), np.empty(len(word), np.int64)
                context[1:], ahead[1:] = word[:-1], pair[:-1]
                context[begins], ahead[begins] = train_docs, 0
                base = np.log10((word + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
                own = np.log10(weights.probabilities(np.stack([triple, ahead, pair, context, word]), tokens, vocabulary))
                of = lambda x, at=begins: np.add.reduceat(x, at)
                ids = pa.array(np.frombuffer(row["doc_ids"], np.int64), mask=np.frombuffer(row["known"], np.uint8) == 0)
                n = len(lengths)
                columns = [ids, pa.array(parts == TEST), pa.array(lengths), pa.array(of((word > 0).astype(np.int64))), pa.array(np.full(n, tokens, np.int64)), pa.array(of(base)), pa.array(of(own))]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return rows.select("doc_ids", "known", "lengths", "parts", "of_word", "of_pair", "of_triple").mapInArrow(run, SCORE_DDL)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row."""
    rows = common.bucketed(blocks(docs, id_col, text_col, block_tokens), "blocks", "block")
    sizes = rows.agg(F.sum(F.octet_length("tokens")).alias("size")).first()["size"] or 0
    bits = max(0, math.ceil(math.log2(max(1, sizes / 2 / range_keys))))
    answers = common.materialize(summed(sent(rows, bits), 2 << bits), "answers")
    words = answers.filter(F.col("kind") == WORD).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_distinct", "n_core", "n_deleted")]).first()
    # documents of each training part
    core_docs, train_docs = part_sizes(rows)
    both = common.bucketed(paired(rows, answers, bits), "paired", "block")
    common.release(rows, answers)
    answers = common.materialize(summed(sent(both, bits, triples=True), 1 << bits), "answers")
    found = common.materialize(counted(both, answers, bits, core_docs), "counted")
    common.release(both, answers)
    weights = learned(found, words["n_core"], words["n_distinct"])
    return scored(found, train_docs, words["n_core"] + words["n_deleted"], words["n_distinct"], weights)


def part_sizes(rows: DataFrame) -> tuple[int, int]:
    out = common.arrow_schema("core long, deleted long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.bincount(np.frombuffer(v.as_py(), np.uint8), minlength=3) for v in b.column("parts")]
            yield pa.RecordBatch.from_arrays([pa.array([int(g[p]) for g in got], pa.int64()) for p in (CORE, DELETED)], schema=out)

    r = rows.select("parts").mapInArrow(run, "core long, deleted long").agg(F.coalesce(F.sum("core"), F.lit(0)).alias("core"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted")).first()
    return r["core"], r["core"] + r["deleted"]
