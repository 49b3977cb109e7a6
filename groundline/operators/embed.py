"""Embeddings: a pluggable embedder, each distinct text encoded once, and a cache table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.errors import EmbeddingError, ModelMismatchError
from groundline.functions import text as tx
from groundline.functions import vectors as vx
from groundline.operators import cachefiles
from groundline.operators.retrieve import beside
from groundline.settings import DEFAULT, Settings

_WORD = re.compile(r"\w+")
CACHE_DDL = "text_key string, model string, dim int, window int, embedding array<float>"


def hashing_embedder(dim: int = DEFAULT.embed_dim) -> Callable[[list[str]], list]:
    """Deterministic vectors of unit length from signed hashes of words and of their pairs; needs no model."""

    def embed(texts: list[str]) -> list:
        import zlib

        import numpy as np

        out = np.zeros((len(texts), dim), np.float64)
        for i, t in enumerate(texts):
            words = _WORD.findall(t.lower())
            for w in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
            if not out[i].any():
                out[i, zlib.crc32(t.encode()) % dim] = 1
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)

    return embed


def encode(rows: DataFrame, column: str, embedder: Callable[[list[str]], list], dim: int, batch: int = DEFAULT.embed_batch, keep: bool = True) -> DataFrame:
    """Adds embedding: unit vectors of a text column, `batch` texts at a time in each task; without `keep` the texts are left out."""
    import pyarrow as pa

    if batch < 1:
        raise EmbeddingError("a batch has one text at least")
    names = [c for c in rows.columns if keep or c != column]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                v = np.asarray(embedder(part.column(column).to_pylist()), np.float32)
                if v.shape != (part.num_rows, dim):
                    raise EmbeddingError(f"vectors have shape {v.shape}")
                length = np.linalg.norm(v, axis=1, keepdims=True)
                if not length.all():
                    raise EmbeddingError("a vector has length 0")
                ends = pa.array(np.arange(0, v.size + 1, dim), pa.int32())
                vectors = pa.ListArray.from_arrays(ends, pa.array((v / length).ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), vectors], names=[*names, "embedding"])

    kept_of = rows.select(*[f"`{c}`" for c in names]).schema.simpleString().removeprefix("struct<").removesuffix(">")
    return rows.mapInArrow(run, kept_of + ",embedding:array<float>")


def reject_blank(rows: DataFrame, column: str) -> DataFrame:
    blank = F.length(tx.strip(F.col(column))) == 0
    return rows.withColumn(column, F.when(blank, F.raise_error(F.lit("a blank text cannot be embedded"))).otherwise(F.col(column)))


def embed_texts(rows: DataFrame, column: str, embedder: Callable[[list[str]], list], settings: Settings = DEFAULT, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with their embedding, and the cache rows that are new.  Each distinct text that is not cached is encoded once."""
    keyed = reject_blank(rows, column).withColumn("text_key", tx.text_key(F.col(column)))
    distinct = keyed.select("text_key", F.col(column).alias("_text")).dropDuplicates(["text_key"])
    known = None
    if cache is not None:
        known = usable_cache(cache, settings).select("text_key", "embedding")
        distinct = distinct.join(known, "text_key", "left_anti")
    new = encode(distinct, "_text", embedder, settings.embed_dim, settings.embed_batch, keep=False)
    every = new if known is None else new.unionByName(known)
    return keyed.join(every, "text_key").drop("text_key"), cache_rows(new, settings)


def cache_rows(vectors: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows of the cache from text_key and embedding."""
    return vectors.select("text_key", F.lit(settings.embed_model).alias("model"), F.lit(settings.embed_dim).alias("dim"), F.lit(settings.embed_window).alias("window"), "embedding")


def embed_query(text: str, embedder: Callable[[list[str]], list]) -> list[float]:
    """The vector of one question; it is not cached."""
    if not text or not text.strip():
        raise EmbeddingError("a blank text cannot be embedded")
    return [float(x) for x in embedder([text])[0]]


def usable_cache(cache: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Rows of this model, size and window, one for each key."""
    same = (F.col("model") == settings.embed_model) & (F.col("dim") == settings.embed_dim) & (F.col("window") == settings.embed_window) & (F.size("embedding") == settings.embed_dim)
    return cache.filter(same).dropDuplicates(["text_key"])


def append_cache(fresh: DataFrame, path: str) -> None:
    """Nothing is written for no rows; a reader sees all of an append or none.  Its files get their filters (`cachefiles`)."""
    cachefiles.append(fresh, path)


def cache_stats(rows: DataFrame, column: str, cache: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """requested, hits (of occurrences), misses (distinct texts) and rows_cached."""
    known = usable_cache(cache, settings).select("text_key").withColumn("known", F.lit(True))
    keyed = rows.select(tx.text_key(F.col(column)).alias("text_key")).join(known, "text_key", "left")
    counts = keyed.agg(
        F.count("*").alias("requested"),
        F.count_if(F.col("known").isNotNull()).alias("hits"),
        F.count_distinct(F.when(F.col("known").isNull(), F.col("text_key"))).alias("misses"),
    )
    return beside(counts, known.agg(F.count("*").alias("rows_cached")))


def index_meta(spark, settings: Settings = DEFAULT, built_at: str = "") -> DataFrame:
    return spark.createDataFrame([(settings.embed_model, settings.embed_dim, settings.embed_window, "cosine", built_at)], "embed_model string, embed_dim int, embed_window int, space string, corpus_built_at string")


def assert_compatible(meta: DataFrame, settings: Settings = DEFAULT) -> None:
    """The model must be the same; size and window are compared where they are given."""
    row = meta.first()
    if row is None:
        raise ModelMismatchError("the index does not say by which model it was built")
    if row["embed_model"] != settings.embed_model:
        raise ModelMismatchError(f"the index was built by {row['embed_model']}, not {settings.embed_model}")
    for name, want in (("embed_dim", settings.embed_dim), ("embed_window", settings.embed_window)):
        if row[name] is not None and row[name] != want:
            raise ModelMismatchError(f"{name} is {row[name]}, not {want}")


def probe(spark, embedder: Callable[[list[str]], list], same: tuple[str, str], other: str) -> DataFrame:
    """Is a pair of texts on one subject nearer than one on two?  And the lengths of the vectors."""
    v = [[float(x) for x in e] for e in embedder([*same, other])]
    rows = spark.createDataFrame([(v[0], v[1], v[2])], "a array<double>, b array<double>, c array<double>")
    near, far = vx.dot(F.col("a"), F.col("b")), vx.dot(F.col("a"), F.col("c"))
    lengths = [vx.norm(F.col(c)) for c in "abc"]
    return rows.select(near.alias("same_topic"), far.alias("unrelated"), (near > far).alias("ok"), F.least(*lengths).alias("min_norm"), F.greatest(*lengths).alias("max_norm"))


def probe_corpus(chunks: DataFrame, count: Callable[[str], int] | None = None, first: int = 50) -> DataFrame:
    """Mean, least and greatest ratio of given tokens to words of the first chunks; chunks without words are left out."""
    words = F.size(F.filter(F.split(tx.collapse(F.col("text")), " "), lambda w: w != ""))
    rows = chunks.orderBy("chunk_id").limit(first).select("n_tokens", words.alias("words")).filter("words > 0")
    ratio = F.col("n_tokens") / F.col("words")
    return rows.agg(F.avg(ratio).alias("mean_ratio"), F.min(ratio).alias("min_ratio"), F.max(ratio).alias("max_ratio"))
