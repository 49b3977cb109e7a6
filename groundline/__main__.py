"""python -m groundline build | verify | ask | probe | analyze | dump | prune

probe takes --scheme, --unfiltered and --show-text; with - for a question it reads questions until there are no more.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from groundline import errors
from groundline.functions import text as tx
from groundline.operators import chunks, embed, index, retrieve
from groundline.plans.answer import answer
from groundline.plans.build import build_index, open_fitted
from groundline.settings import Settings
from groundline.sources import tables


def probe_questions(given: str):
    """The question, or for - each line of the input until a blank line, "quit" or its end."""
    if given != "-":
        yield given
        return
    for line in sys.stdin:
        if not line.strip() or line.strip().lower() in ("quit", "exit", "q"):
            return
        yield line.strip()


def probe(spark, table, question: str, given, embedder, settings: Settings) -> None:
    """Print the hits of a question, whether they pass the gate, and the first ones whole if asked."""
    questions = spark.createDataFrame([("1", question, given.scheme)], "query_id string, question string, scheme string")
    vectors = lambda rows, column: embed.embed_texts(rows, column, embedder, settings)[0]
    found = retrieve.retrieve(questions, table, vectors, settings, auto_detect=not given.unfiltered).persist()
    for r in retrieve.probe_report(questions, found, settings).orderBy("line_no").collect():
        print(r["line"])
    for r in found.filter(F.col("rank") <= given.show_text).orderBy("rank").collect():
        print(f"[{r['rank']}] {r['chunk_id']} {r['section']}\n{r['text']}")
    found.unpersist()


def opened(spark, folder: str, settings: Settings):
    """Index, embedder and settings of a folder: those of its fitted encoder, if the index was built by one."""
    folder = folder.rstrip("/")
    try:
        fitted = spark.read.parquet(f"{folder}/index_meta").first()["embed_model"].startswith("fitted-")
    except AnalysisException:
        fitted = False
    if fitted:
        return open_fitted(spark, folder, settings)
    return retrieve.open_index(spark, f"{folder}/index", settings), embed.hashing_embedder(settings.embed_dim), settings


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="groundline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, arguments in {"build": ("sources", "pages", "folder"), "verify": ("sources", "folder"), "ask": ("folder", "question"), "probe": ("folder", "question"), "analyze": ("folder",), "dump": ("folder",), "prune": ("folder", "registry")}.items():
        command = commands.add_parser(name)
        for a in arguments:
            command.add_argument(a)
        command.add_argument("--host", action="append", default=[], help="an allowed host")
        command.add_argument("--limit", type=int, default=20)
        if name == "build":
            command.add_argument("--fitted", action="store_true", help="fit the encoder on the chunks and store it beside the index")
        if name == "probe":
            command.add_argument("--scheme", help="search this scheme alone")
            command.add_argument("--unfiltered", action="store_true", help="let all schemes compete")
            command.add_argument("--show-text", type=int, default=0, help="print so many hits whole")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("groundline").getOrCreate()
    settings = Settings(allowed_hosts=tuple(given.host) or Settings().allowed_hosts)
    embedder = embed.hashing_embedder(settings.embed_dim)
    part = lambda name: f"{given.folder.rstrip('/')}/{name}"
    try:
        if given.command == "build":
            sources = tables.read_sources(spark, given.sources, settings)
            raw = spark.read.parquet(given.pages).join(sources, "url")
            for name, path in build_index(raw, sources, given.folder, embedder, settings, fitted=given.fitted).items():
                print(name, path)
        elif given.command == "verify":
            index.verify(opened(spark, given.folder, settings)[0], spark.read.parquet(part("chunks")), tables.read_sources(spark, given.sources, settings), settings)
            print("the index is as it should be")
        elif given.command == "ask":
            questions = spark.createDataFrame([("1", given.question)], "query_id string, question string")
            table, embedder, settings = opened(spark, given.folder, settings)
            print(answer(questions, table, embedder, settings=settings).first()["answer"])
        elif given.command == "probe":
            table, embedder, settings = opened(spark, given.folder, settings)
            for question in probe_questions(given.question):
                try:
                    probe(spark, table, question, given, embedder, settings)
                except (errors.RetrievalError, errors.EmbeddingError) as e:
                    if given.question != "-":
                        raise
                    print(f"{type(e).__name__}: {e}", file=sys.stderr)
        elif given.command == "analyze":
            docs = spark.read.parquet(part("documents"))
            sections = docs.select("scheme", F.explode("sections").alias("s")).select("scheme", tx.count_tokens(F.array_join(F.transform("s.blocks", lambda b: b["text"]), "\n")).alias("n_tokens"), F.exists("s.blocks", lambda b: b["kind"] == "table").alias("has_table"), F.lit(1).alias("chunks"))
            chunks.analyze(sections, settings.chunk_size).show(given.limit, False)
        elif given.command == "dump":
            table, _, settings = opened(spark, given.folder, settings)
            for r in index.dump_header(table, settings).orderBy("pos").collect():
                print(f"{r['name']:<18}{r['value']}")
            index.table_of_contents(table).show(given.limit, False)
            for r in index.dump_lines(table, retrieve.all_neighbours(table)).orderBy("chunk_id", "line_no").limit(given.limit).collect():
                print(r["line"])
        elif given.command == "prune":
            registry = {r["id"] for r in tables.read_registry(spark, given.registry).toLocalIterator()} if os.path.exists(given.registry) else None
            print("\n".join(index.prune_orphans(given.folder, registry)))
    except (errors.SourceValidationError, errors.StructureError, errors.ChunkingError, errors.EmbeddingError, errors.IndexBuildError, errors.RetrievalError, errors.GenerationError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
