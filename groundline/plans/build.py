"""Pages to a verified index, one table after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from groundline.functions import text as tx
from groundline.functions.logs import StageLog
from groundline.operators import cachefiles, chunks, embed, encoder, index, pages, retrieve
from groundline.settings import DEFAULT, Settings


def build_index(raw: DataFrame, sources: DataFrame, folder: str, embedder: Callable | None = None, settings: Settings = DEFAULT, rebuild: bool = True, fitted: bool = False) -> dict[str, str]:
    """Write pages, documents, chunks, the index, its metadata and new rows of the embedding cache under a folder; their paths by name.

    Texts that the cache holds are not embedded again, and the embedder runs once over the others.  With `fitted` the encoder is fitted on the chunks
    and written as well; such an index opens by `open_fitted`.
    """
    spark, log = raw.sparkSession, StageLog("build")
    paths = {k: f"{folder.rstrip('/')}/{k}" for k in ("raw_html", "documents", "chunks", "embedding_cache", "index", "index_meta", "corpus_meta")}
    mode = "overwrite" if rebuild else "errorifexists"
    embedder = embedder or embed.hashing_embedder(settings.embed_dim)
    raw.write.mode(mode).parquet(paths["raw_html"])
    pages.documents(spark.read.parquet(paths["raw_html"]), settings).write.mode(mode).parquet(paths["documents"])
    docs = spark.read.parquet(paths["documents"]).filter("parse_error is null")
    chunks.chunk_documents(docs, settings, embedder).write.mode(mode).parquet(paths["chunks"])
    table = spark.read.parquet(paths["chunks"])
    chunks.assert_invariants(table, settings.chunk_size)
    log.info("chunked", documents=docs.count(), chunks=table.count())
    if fitted:
        model = encoder.fit(table, "text", settings.embed_dim)
        paths["encoder"] = f"{folder.rstrip('/')}/encoder"
        encoder.save(spark, model, paths["encoder"])
        embedder, settings = encoder.embedder(spark, model), encoder.fitted_settings(model, settings)
    try:
        cache = cachefiles.lookup(spark, paths["embedding_cache"], table.select(tx.text_key(table["text"]).alias("text_key")), settings)
        stats = embed.cache_stats(table, "text", cache, settings).first()
        log.info("cache", **stats.asDict())
    except AnalysisException:
        cache = None
    index.build(embed.embed_texts(table, "text", embedder, settings, cache)[0], paths["index"], settings, rebuild)
    built = spark.read.parquet(paths["index"])
    index.verify(built, table, sources, settings)
    fresh = embed.cache_rows(built.select(tx.text_key(built["text"]).alias("text_key"), "embedding").dropDuplicates(["text_key"]), settings)
    if cache is not None:
        fresh = fresh.join(embed.usable_cache(cache, settings).select("text_key"), "text_key", "left_anti")
    embed.append_cache(fresh, paths["embedding_cache"])
    meta = index.corpus_meta(built)
    meta.write.mode("overwrite").json(paths["corpus_meta"])
    embed.index_meta(spark, settings, meta.first()["last_updated"]).write.mode("overwrite").parquet(paths["index_meta"])
    log.info("built", chunks=meta.first()["chunk_count"], path=paths["index"])
    return paths


def open_fitted(spark: SparkSession, folder: str, settings: Settings = DEFAULT) -> tuple[DataFrame, Callable, Settings]:
    """The index of a folder built with `fitted`, its embedder, and the settings that fit them; an index of another fit is refused."""
    model = encoder.load(spark, f"{folder.rstrip('/')}/encoder")
    settings = encoder.fitted_settings(model, settings)
    return retrieve.open_index(spark, f"{folder.rstrip('/')}/index", settings), encoder.embedder(spark, model), settings
