"""Batches of questions to answers: one plan, every question exactly once in the result."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.functions import text as tx
from groundline.operators import embed, guards, retrieve, rewrite, verify
from groundline.session import kept
from groundline.settings import DEFAULT, DISCLAIMER, Settings

CITATION = "array<struct<source_url: string, section: string, scheme_name: string, fetched_at: string>>"


TRACE = ("llm_called", "warnings", "hits", "guards", "expanded_query", "filter", "timings_ms")


def answer(questions: DataFrame, index: DataFrame, embedder: Callable | None = None, generator: Callable = verify.extractive, settings: Settings = DEFAULT, strict: bool = False, used: list[DataFrame] | None = None) -> DataFrame:
    """query_id, answer, citations, last_updated, refusal, refusal_type, error and the trace (llm_called, warnings, hits, guards, expanded_query, filter, timings_ms) of each question.

    Refused questions leave before anything is embedded or generated, and come back with a fixed text.  A question whose generation fails
    has an error and the text for it, unless `strict` lets the failure end the job.  Times are those of the batch's steps.  Tables that
    steps are written to are added to `used`; `session.release` deletes them once the answers are written.
    """
    embedder = embedder or embed.hashing_embedder(settings.embed_dim)
    used, times = [] if used is None else used, {}

    def step(table: DataFrame, name: str) -> DataFrame:
        began = time.perf_counter()
        used.append(out := kept(table, name))
        times[name] = round(1000 * (time.perf_counter() - began), 2)
        return out

    named = rewrite.detect_scheme(F.col("question"), settings)
    checked = step(guards.check(questions, "question", settings).withColumn("named", named), "guards")
    guard = F.struct("action", "refusal_type", "matched_names")
    refused = checked.filter("action = 'refuse'").select("query_id", "named", "warnings", "refusal_type", guard.alias("guards"))
    asked = checked.filter("action = 'answer'").select("query_id", F.col("query").alias("question"), "named", "warnings", guard.alias("guards"), rewrite.expand(F.col("query"), settings).alias("expanded_query"))

    vectors = lambda rows, column: embed.embed_texts(rows, column, embedder, settings)[0]
    # a blank question has no hits, and so does not pass the gate
    found = step(retrieve.retrieve(asked.filter(F.length(tx.strip(F.col("question"))) > 0), index, vectors, settings, used=used).drop("expanded_query"), "retrieve")
    gate = retrieve.gate(asked, found, settings.max_distance, settings.gate_aggregation)
    listed = found.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "scheme", "section", F.round("distance", 4).alias("distance"), "source_url", "scheme_name", "fetched_at"))).alias("hits"),
        tx.latest_stamp(F.col("fetched_at")).alias("last_updated"),
        F.array_distinct(F.collect_list("source_url")).alias("context_urls"),
        F.max("filter").alias("filter"),
    )
    rows = step(asked.join(retrieve.dealt_out(gate), "query_id").join(retrieve.dealt_out(listed), "query_id", "left"), "gate")
    passed = rows.filter("passes_gate")
    inside = found.join(retrieve.dealt_out(passed.select("query_id")), "query_id", "left_semi")
    blocks = retrieve.context(inside, index, settings).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]).alias("blocks"))
    prompts = passed.join(retrieve.dealt_out(blocks), "query_id").withColumn("prompt", verify.user_message(F.col("blocks"), F.col("question"))).drop("blocks")
    done = step(verify.generate(prompts, "prompt", generator, settings, strict).drop("prompt"), "generate")
    done = verify.verify(done, settings=settings)

    failed = F.col("generation_error").isNotNull()
    refusal = F.when(~failed, F.col("verify_refusal"))
    answered = ~failed & refusal.isNull()
    text = F.when(failed, F.lit(FAILURES[1][2])).when(answered, verify.decorate(F.col("body"), F.col("last_updated"))).otherwise(guards.refusal_text(refusal, F.col("named"), settings))
    cited = F.transform(F.slice("hits", 1, 1), lambda h: F.struct(*[h[c].alias(c) for c in ("source_url", "section", "scheme_name", "fetched_at")]))
    trace = lambda called, hits, expanded, chosen, warned: [F.lit(called).alias("llm_called"), warned.alias("warnings"), hits.alias("hits"), F.col("guards"), expanded.alias("expanded_query"), chosen.alias("filter")]
    whole = trace(True, F.col("hits"), F.col("expanded_query"), F.col("filter"), F.when(failed, F.col("warnings")).otherwise(F.concat("warnings", "verify_warnings")))
    shown = done.select("query_id", text.alias("answer"), F.when(answered, cited).otherwise(F.array().cast(CITATION)).alias("citations"), F.when(answered, F.col("last_updated")).otherwise("").alias("last_updated"), refusal.alias("refusal_type"), F.col("generation_error").alias("error"), *whole)

    def stopped(rows: DataFrame, kind: Column, *traced: Column) -> DataFrame:
        text = guards.refusal_text(kind, F.col("named"), settings)
        return rows.select("query_id", text.alias("answer"), F.array().cast(CITATION).alias("citations"), F.lit("").alias("last_updated"), kind.alias("refusal_type"), F.lit(None).cast("string").alias("error"), *trace(False, *traced, F.col("warnings")))

    none = F.lit(None).cast(dict(shown.dtypes)["hits"])
    out = shown.unionByName(stopped(rows.filter("not passes_gate"), F.lit("out_of_corpus"), F.col("hits"), F.col("expanded_query"), F.col("filter")))
    out = out.unionByName(stopped(refused, F.col("refusal_type"), none, F.lit(""), F.lit(None).cast("string")))
    timings = F.create_map(*[F.lit(x) for item in times.items() for x in item])
    return out.withColumns({"refusal": F.col("refusal_type").isNotNull(), "disclaimer": F.lit(DISCLAIMER), "timings_ms": timings})


def ask_payload(answers: DataFrame, questions: DataFrame, include_trace: bool = True) -> DataFrame:
    """The answers as JSON; a question that holds personal data is not echoed.  The trace has what the answers have of it."""
    echo = F.when(F.size(guards.pii_names(F.col("question"))) > 0, F.lit("[redacted]")).otherwise(F.col("question"))
    rows = answers.join(questions.select("query_id", echo.alias("question")), "query_id")
    fields = ["question", "answer", "citations", "last_updated", "refusal", "refusal_type", "disclaimer"]
    trace = [F.struct(*[c for c in TRACE if c in answers.columns]).alias("trace")] if include_trace else []
    return rows.select("query_id", F.to_json(F.struct(*fields, *trace), {"ignoreNullFields": "false"}).alias("payload"))


#: What a client is told when an answer cannot be made, by the class of the error.
FAILURES = ((("MissingCollectionError", "EmptyCollectionError", "RetrievalError", "EmbeddingError", "ModelMismatchError", "OSError"), 503, "The index is not available."), (("GenerationError", "GeneratorNotConfiguredError"), 503, "The language model is not available."))


def failure_status(error: BaseException) -> tuple[int, str]:
    """Status and detail of an error: 503 where a part is missing, 500 for anything else."""
    names = [c.__name__ for c in type(error).__mro__]
    for known, status, detail in FAILURES:
        if any(n in known for n in names):
            return status, detail
    return 500, "The question could not be answered."


def valid_requests(requests: DataFrame, most: int = DEFAULT.max_query_chars) -> DataFrame:
    """Adds error to requests whose question is missing, blank or too long."""
    text = tx.strip(F.col("question"))
    error = F.when(F.col("question").isNull(), "missing").when(text == "", "blank").when(F.length("question") > most, "too long")
    return requests.withColumn("error", error)


def status(index: DataFrame | None, sources: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """index_ready, source_count and a line about the corpus."""
    ready = index is not None and not index.isEmpty()
    row = sources.agg(F.count("*").alias("source_count")).withColumn("index_ready", F.lit(ready))
    if meta is not None:
        row = retrieve.beside(row, meta.select("last_updated", "chunk_count"))
    else:
        row = row.withColumns({"last_updated": F.lit(""), "chunk_count": F.lit(0).cast("long")})
    updated = F.when(F.col("last_updated") != "", F.col("last_updated")).otherwise("unknown")
    parts = F.array(F.format_string("Sources: %d scheme pages", "source_count"), F.concat(F.lit("Last updated: "), updated), F.when(F.col("chunk_count") > 0, F.format_string("Chunks: %d", "chunk_count")), F.when(~F.col("index_ready"), F.lit("The index is not built yet")))
    return row.withColumn("line", F.array_join(F.filter(parts, lambda p: p.isNotNull()), " · "))


def health_payload(state: DataFrame, provider: str = "", model: str = "", collection: str = "chunks") -> DataFrame:
    """What a monitor gets: "ok" where the index is ready, else "degraded", with what `status` says and the generator in use."""
    ready = F.when(F.col("index_ready"), "ok").otherwise("degraded")
    given = [F.lit(v).alias(n) for n, v in (("provider", provider), ("model", model), ("collection", collection))]
    fields = F.struct(ready.alias("status"), "index_ready", F.col("source_count").alias("sources"), *given, F.struct("last_updated", "chunk_count").alias("corpus"))
    return state.select(F.to_json(fields).alias("payload"))
