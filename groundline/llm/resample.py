"""Importance resampling towards a target distribution, over hashed n-grams whose checksums are composed, not computed from strings.

A word's CRC-32 is computed once.  That of a run of words follows from those of its parts: appending n bytes to a text multiplies its
checksum by a matrix over GF(2) that depends on n alone, and the appended text's own checksum is added.  So no n-gram is ever a string.

One pass counts the buckets of both tables (a row for each bucket comes back, whatever the size), a second weighs each text by the mean gain of
its features, and the Gumbel-perturbed weights are ranked by a range sort with the offsets of its partitions.

Defined results: a null, empty or wordless text has no features and weight 0; a document with fewer words than asked for is never
drawn; one without an id has no score and is never drawn; repeated rows count each, and equal scores go by id, then by what the
rows hold; a long text is read in pieces between words; empty tables give no rows, or gains of nothing.  Other columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundline.llm import common

BUCKETS, ORDER, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Words up to this length are taken byte by byte for all words at once, longer ones one by one.
SHORT = 64
#: Bytes of a long text that are looked at together.
PIECE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Digits, small letters, and every byte of a character beyond ASCII.
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def byte_table() -> np.ndarray:
    """The checksum's step for each byte value."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_STEP = byte_table()


def applied(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The product of a matrix (32 columns as integers) and vectors over GF(2)."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where((x >> np.uint32(bit)) & 1, matrix[bit], np.uint32(0)).astype(np.uint32)
    return out


def doubled(matrix: np.ndarray) -> np.ndarray:
    return applied(matrix, matrix)


def lookup(matrix: np.ndarray) -> np.ndarray:
    """A matrix as four tables, one for each byte of the vector."""
    values = np.arange(256, dtype=np.uint32)
    return np.stack([applied(matrix, values << np.uint32(8 * k)) for k in range(4)])


class Shifts:
    """Matrices that append zero bytes to a text whose checksum is given: every length up to SHORT, and powers of two."""

    def __init__(self) -> None:
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        one = _STEP[unit & np.uint32(255)] ^ (unit >> np.uint32(8))
        matrices = [unit]
        for _ in range(SHORT):
            matrices.append(applied(one, matrices[-1]))
        self.short = np.stack([lookup(m) for m in matrices])
        self.powers, m = [], one
        for _ in range(40):
            self.powers.append(lookup(m))
            m = doubled(m)

    def __call__(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        short = np.where(lengths <= SHORT, lengths, 0)
        out = np.zeros_like(crc)
        for k in range(4):
            out ^= self.short[short, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.flatnonzero(lengths > SHORT):
            out[i] = self.long(int(crc[i]), int(lengths[i]))
        return out

    def long(self, crc: int, length: int) -> int:
        for bit, table in enumerate(self.powers):
            if length >> bit & 1:
                crc = int(table[0, crc & 255] ^ table[1, crc >> 8 & 255] ^ table[2, crc >> 16 & 255] ^ table[3, crc >> 24])
        return crc


_shifts: list[Shifts] = []


def shifts() -> Shifts:
    """One for each worker process."""
    if not _shifts:
        _shifts.append(Shifts())
    return _shifts[0]


def combined(a: np.ndarray, b: np.ndarray, b_lengths: np.ndarray) -> np.ndarray:
    """Checksums of texts a followed by texts b, from those of both and the lengths of the latter."""
    return shifts()(a, b_lengths) ^ b


def word_checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of words of some bytes."""
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(-lengths, kind="stable")
    order = order[np.searchsorted(-lengths[order], -SHORT, "left") :]
    begin, crc = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    falling = -lengths[order]
    for k in range(int(lengths[order[0]]) if len(order) else 0):
        m = np.searchsorted(falling, -k, "left")  # so many are longer than k
        crc[:m] = _STEP[(crc[:m] ^ data[begin[:m] + k]) & np.uint32(255)] ^ (crc[:m] >> np.uint32(8))
    out[order] = ~crc
    for i in np.flatnonzero(lengths > SHORT):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    return out


def pieces(data: np.ndarray, most: int = PIECE_BYTES) -> Iterator[np.ndarray]:
    """Consecutive parts of one text that end between words; a longer word has a part of its own."""
    start = 0
    while start < len(data):
        end = min(len(data), start + most)
        while end < len(data):
            gap = np.flatnonzero(~_WORD[data[max(start, end - most) : end]])
            if len(gap):
                end = max(start, end - most) + int(gap[-1]) + 1
                break
            end = min(len(data), end + most)
        yield data[start:end]
        start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Checksum, length and text number of each word of texts that lie end to end, lower-cased."""
    found = []
    if len(offsets) == 2 and len(data) > PIECE_BYTES:
        for part in pieces(_LOWER[data]):
            crc, length, _ = words_of(part, np.array([0, len(part)]))
            found.append((crc, length, np.zeros(len(crc), np.int64)))
    else:
        found.append(words_of(_LOWER[data], offsets))
    return tuple(np.concatenate(x) for x in zip(*found)) if len(found) > 1 else found[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1] & ~edge[1:-1], inside[1:] & ~edge[1:-1]
    starts = np.flatnonzero(inside & ~before)
    lengths = np.flatnonzero(inside & ~after) + 1 - starts
    return word_checksums(data, starts, lengths), lengths, np.searchsorted(offsets, starts, "right") - 1


def features(crc: np.ndarray, lengths: np.ndarray, doc: np.ndarray, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Checksums and text numbers of all runs of 1 to `order` consecutive words, joined by blanks, one length of runs after another."""
    blank = np.uint32(zlib.crc32(b" "))
    run = crc
    yield run, doc
    for n in range(1, order):
        if len(crc) <= n:
            return
        whole = combined(combined(run[:-1], np.full(len(run) - 1, blank), np.ones(len(run) - 1, np.int64)), crc[n:], lengths[n:])
        run = whole
        same = doc[n:] == doc[:-n]
        yield run[same], doc[n:][same]


def buffers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a batch's texts (large binary, without nulls)."""
    column = batch.column("text").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> list[int]:
    """How many features of all texts fall in each bucket: counted in the tasks, so one number for each bucket is what comes together."""
    ddl = "bucket int, n long"
    out = common.arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("resample", _shifts.clear)
        total = np.zeros(buckets, np.int64)
        for b in common.slices(batches, "text"):
            for crc, _ in features(*words(*buffers(b)), order):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(total[have])], schema=out)

    rows = texts.filter(F.col(text_col).isNotNull()).select(common.as_bytes(F.col(text_col)).alias("text")).mapInArrow(run, ddl)
    got = [0] * buckets
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        got[r["bucket"]] = r["n"]
    return got


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """The log of the smoothed ratio of the bucket's shares in target and source, in thousandths, floored."""
    s_all, t_all, buckets = sum(source), sum(target), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(source, target, strict=True)], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight."""
    ddl = "doc_id long, n_words long, n_features long, weight long"
    out = common.arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("resample", _shifts.clear)
        for b in common.slices(batches, "text"):
            crc, lengths, doc = words(*buffers(b))
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for run_crc, run_doc in features(crc, lengths, doc, order):
                n += np.bincount(run_doc, minlength=b.num_rows)
                # sums of integers far below 2**53 are exact in doubles
                total += np.bincount(run_doc, gain[run_crc % np.uint32(len(gain))], b.num_rows).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.bincount(doc, minlength=b.num_rows), pa.int64()), pa.array(n), pa.array(weight)], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.as_bytes(common.text_or_empty(text_col)).alias("text")).mapInArrow(run, ddl)


def ranked(rows: DataFrame, order: list, rank: str = "rank") -> tuple[DataFrame, int]:
    """Rows with their place in a total order, from 1, and their number: a range sort, then the offset of each of its partitions.

    The rows are written with their place in the partition, so places and offsets are of one and the same sort.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = common.materialize(sorted_rows, "ranked")
    part, at = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # a row for each partition of the sort
    totals = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    out = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(before), "_part").withColumn(rank, F.col("_before") + at + 1)
    return out.drop("_part", "_at", "_before"), placed.count()


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, order: int = ORDER, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; the rank is null for those that are not drawn."""
    gain = gains(counts(docs, text_col, buckets, order), counts(target, target_col, buckets, order))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = common.materialize(weighed(docs, gain, order, id_col, text_col).withColumn("score", F.col("weight") + noise), "scored")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    placed, n = ranked(scored.filter(able), [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")])
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*columns).unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")).select(*columns))
