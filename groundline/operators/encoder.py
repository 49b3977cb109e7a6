"""An embedder fitted from a corpus: singular vectors of weighted words, from a Gram matrix that tasks add up.

A word falls in one of BUCKETS by its digest, and weighs the more the fewer texts have its bucket.  Signed sums of these weights are a text's
sketch of SKETCH numbers.  Unit sketches, as integers, give one Gram matrix in exact integers, so that a fit hangs on no order of rows, tasks or
partitions, and its name is a digest of these integers.  The eigenvectors of the greatest eigenvalues turn a sketch into a vector.

All that reaches the driver has a fixed size: a count for each bucket, and one matrix.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.errors import EmbeddingError
from groundline.settings import DEFAULT, Settings

BUCKETS, SKETCH, SCALE = 1 << 16, 512, 256
#: Partial matrices that one task adds up at most.
FAN = 32
# In lower case (A-Z alone), as Java, Python and SQL read it alike: digits, letters and all signs beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD, _LOWER = re.compile(WORD), {a: a + 32 for a in range(65, 91)}
# Bytes of texts in lower case; what stands in no word is a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_DDL = "part int, gram binary"
#: Texts whose words a task takes at once.
ROWS_AT_ONCE = 256


@functools.lru_cache(1 << 18)
def number_of(word: str) -> int:
    """The first 32 bits of a word's digest: they give its bucket and its sign."""
    return int.from_bytes(hashlib.md5(word.encode(errors="replace")).digest()[:4], "big")


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in order: each one's text and its place among the distinct ones, and these words' numbers."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lowered = bytes(memoryview(data)[ends[0] : ends[-1]]).translate(_BYTES) if data else b""
    lists = pc.split_pattern(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(lowered)), " ")
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    at = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    some = np.fromiter(map(bool, words), bool, len(words))[codes]
    return at[some], codes[some].astype(np.int64), np.fromiter(map(number_of, words), np.int64, len(words))


def tallies(texts: DataFrame) -> DataFrame:
    """bucket and n_texts of one column of texts; bucket -1 has the number of rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            rows += b.num_rows
            for a in range(0, b.num_rows, ROWS_AT_ONCE):
                at, codes, numbers = words_of(b.column(0).slice(a, ROWS_AT_ONCE))
                counts += np.bincount(np.unique(at * BUCKETS + numbers[codes] % BUCKETS) % BUCKETS, minlength=BUCKETS)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1)), pa.array(np.append(counts[own], rows))], names=["bucket", "n_texts"])

    return texts.mapInArrow(run, "bucket long, n_texts long").groupBy("bucket").agg(F.sum("n_texts").alias("n_texts"))


def bucket_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """bucket and n_texts: how many texts have a word of the bucket; a null text has none."""
    return tallies(texts.select(F.col(f"`{column}`").cast("string").alias("text"))).filter("bucket >= 0")


def sketches(texts: Iterable[str], weights: np.ndarray) -> np.ndarray:
    """Of unit length; a text without words has one that its digest gives."""
    texts = list(texts)
    try:
        at, codes, numbers = words_of(pa.array(texts, pa.large_string()))
    except UnicodeEncodeError:  # half a surrogate pair, which no table of Spark has
        lists = [_WORD.findall(t.translate(_LOWER)) for t in texts]
        places = {w: k for k, w in enumerate(dict.fromkeys(w for own in lists for w in own))}
        at = np.repeat(np.arange(len(texts)), [len(own) for own in lists])
        codes, numbers = np.asarray([places[w] for own in lists for w in own], np.int64), np.asarray([number_of(w) for w in places], np.int64)
    # each distinct word of a text, in the order in which they come up, as sums of rounded numbers hang on it
    pairs, first, times = np.unique(at * max(1, len(numbers)) + codes, return_index=True, return_counts=True)
    order = np.argsort(first)
    at, number, times = pairs[order] // max(1, len(numbers)), numbers[codes[first[order]]], times[order]
    levels, level = np.unique(times, return_inverse=True)
    values = np.where(number >> 31, weights[number % BUCKETS], -weights[number % BUCKETS]) * np.asarray([1 + math.log(n) for n in levels.tolist()], weights.dtype)[level]
    out = np.bincount(at * SKETCH + number % SKETCH, values, len(texts) * SKETCH).reshape(-1, SKETCH)
    for i in np.flatnonzero(~out.any(axis=1)):
        out[i, number_of(texts[i]) % SKETCH] = 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


@dataclasses.dataclass(frozen=True)
class Encoder:
    """weights: of each bucket; axes: SKETCH rows of `dim` numbers."""

    name: str
    weights: np.ndarray
    axes: np.ndarray

    @property
    def dim(self) -> int:
        return self.axes.shape[1]

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Vectors of unit length."""
        out = sketches(texts, self.weights) @ self.axes
        for i in np.flatnonzero(np.abs(out).max(axis=1, initial=0) < 1e-9):
            out[i, number_of(texts[i]) % BUCKETS % self.dim] = 1  # it has nothing on any axis
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def gram_of_task(weights: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((SKETCH, SKETCH))
        for b in batches:
            column = b.column(0)
            for a in range(0, len(column), ROWS_AT_ONCE):
                # whole numbers below 2^53, so these products and sums are exact
                x = np.rint(SCALE * sketches((t for t in column.slice(a, ROWS_AT_ONCE).to_pylist() if t and t.strip()), weights))
                total += x.T @ x
        yield matrix_row(TaskContext.get().partitionId(), total)

    return run


def matrix_row(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.astype(np.int64).tobytes()], pa.binary())], names=["part", "gram"])


def add_matrices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    total = np.zeros((SKETCH, SKETCH), np.int64)
    for b in batches:
        for raw in b.column(1):
            total += np.frombuffer(raw.as_buffer(), np.int64).reshape(SKETCH, SKETCH)
    yield matrix_row(TaskContext.get().partitionId(), total)


def fit(texts: DataFrame, column: str = "text", dim: int = DEFAULT.embed_dim) -> Encoder:
    """The encoder of all texts; blank ones count nowhere, and repeated ones as often as they stand there."""
    if not 0 < dim <= SKETCH:
        raise EmbeddingError(f"a fitted encoder has 1 to {SKETCH} dimensions")
    rows = texts.select(F.col(f"`{column}`").cast("string").alias("text"))
    found = np.zeros(BUCKETS + 1, np.int64)  # the last one is the number of rows
    for r in tallies(rows).collect():  # at most BUCKETS + 1 rows
        found[r["bucket"]] = r["n_texts"]
    counts, n = found[:-1], int(found[-1])
    weights = (np.log((n + 1) / (counts + 1)) + 1).astype(np.float32)
    tasks = rows.rdd.getNumPartitions()
    parts = rows.mapInArrow(gram_of_task(weights), _DDL)
    while tasks > 1:
        tasks = -(-tasks // FAN)
        parts = parts.repartition(tasks, "part").mapInArrow(add_matrices, _DDL)
    row = parts.first()
    gram = np.frombuffer(bytes(row["gram"]), np.int64).reshape(SKETCH, SKETCH) if row else np.zeros((SKETCH, SKETCH), np.int64)
    axes = np.linalg.eigh(gram / (SCALE * SCALE))[1][:, ::-1][:, :dim]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(dim)] < 0, -1, 1)
    digest = hashlib.sha256(counts.tobytes() + gram.tobytes()).hexdigest()[:16]
    return Encoder(f"fitted-{dim}-{digest}", weights, axes.astype(np.float32))


def save(spark: SparkSession, encoder: Encoder, path: str) -> None:
    """One row: its size is fixed by BUCKETS, SKETCH and the dimensions."""
    row = (encoder.name, encoder.dim, encoder.weights.tobytes(), np.ascontiguousarray(encoder.axes).tobytes())
    spark.createDataFrame([row], "name string, dim int, weights binary, axes binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Encoder:
    row = spark.read.parquet(path).first()
    if row is None:
        raise EmbeddingError(f"there is no encoder at {path}")
    return decoded(row["name"], row["dim"], bytes(row["weights"]), bytes(row["axes"]))


def decoded(name: str, dim: int, weights: bytes, axes: bytes) -> Encoder:
    return Encoder(name, np.frombuffer(weights, np.float32), np.frombuffer(axes, np.float32).reshape(SKETCH, dim))


_held: dict[str, Encoder] = {}
#: How often this process has unpacked an encoder.
loads = 0


def held(name: str, sent) -> Encoder:
    """This process's encoder of that name; only the last one is kept."""
    global loads
    if name not in _held:
        loads += 1
        _held.clear()
        _held[name] = decoded(*sent.value)
    return _held[name]


def embedder(spark: SparkSession, encoder: Encoder) -> Callable[[list[str]], np.ndarray]:
    """For `embed_texts` and its like: the encoder goes to each executor once, and each worker unpacks it once."""
    name = encoder.name
    sent = spark.sparkContext.broadcast((name, encoder.dim, encoder.weights.tobytes(), np.ascontiguousarray(encoder.axes).tobytes()))
    return lambda texts: held(name, sent)(texts)


def fitted_settings(encoder: Encoder, settings: Settings = DEFAULT) -> Settings:
    """Settings under which an index of this encoder opens, and no other."""
    return dataclasses.replace(settings, embed_model=encoder.name, embed_dim=encoder.dim)
