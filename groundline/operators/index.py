"""The index table: build, upsert, verification, metadata, pruning and a readable dump."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.errors import IndexBuildError, IndexVerificationError
from groundline.functions import text as tx
from groundline.functions import vectors as vx
from groundline.operators.retrieve import beside, sized
from groundline.session import kept
from groundline.settings import DEFAULT, Settings

REQUIRED = ("scheme", "scheme_name", "category", "section", "source_url", "fetched_at", "heading_path", "block_types")
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def records(chunks: DataFrame, dim: int) -> DataFrame:
    """Chunks with vectors as rows of the index; a vector of another length is an error."""
    ok = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit("a vector has the wrong length")))
    return chunks.withColumn("embedding", ok).withColumn("heading", F.array_join("heading_path", " > "))


def build(chunks: DataFrame, path: str, settings: Settings = DEFAULT, rebuild: bool = True) -> None:
    """Write the index by scheme; without `rebuild` an index that exists is an error."""
    try:
        records(chunks, settings.embed_dim).write.mode("overwrite" if rebuild else "errorifexists").partitionBy("scheme").parquet(path)
    except Exception as e:
        if "ALREADY_EXISTS" in str(e):
            raise IndexBuildError(f"there is an index at {path}") from e
        raise


def one_for_each_id(chunks: DataFrame) -> DataFrame:
    """Of rows with one id that with the least text."""
    text = F.col("text") if "text" in chunks.columns else F.lit("")
    return chunks.groupBy("chunk_id").agg(F.min_by(F.struct(*chunks.columns), F.struct(text, F.to_json(F.struct(*chunks.columns)))).alias("row")).select("row.*")


def upserted(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """The index with these chunks in place of those of the same ids; doing it twice changes nothing."""
    new = one_for_each_id(chunks)
    return index.join(new.select("chunk_id"), "chunk_id", "left_anti").select(*index.columns).unionByName(new, allowMissingColumns=True)


def corpus_meta(index: DataFrame, collection: str = "chunks") -> DataFrame:
    return index.agg(F.lit(collection).alias("collection"), tx.latest_stamp(F.col("fetched_at")).alias("last_updated"), F.count("*").alias("chunk_count"))


def digests(ids: DataFrame, prefix: Column) -> DataFrame:
    """For each prefix the number of ids and two sums of their hashes that hang on no order."""
    h = F.xxhash64("chunk_id")
    return ids.groupBy(prefix.alias("_at")).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.xxhash64("chunk_id", F.lit(1)).cast("decimal(20,0)")).alias("s"))


def differing(a: DataFrame, b: DataFrame, prefix: Column) -> DataFrame:
    """The prefixes (_at) whose digests differ, or that one side alone has."""
    left, right = digests(a, prefix), digests(b, prefix).withColumnsRenamed({c: f"_{c}" for c in "nxs"})
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("x").eqNullSafe(F.col("_x")) & F.col("s").eqNullSafe(F.col("_s"))
    return left.join(right, "_at", "full").filter(~same).select("_at")


def id_difference(have: DataFrame, want: DataFrame, bits: int = 12, levels: int = 1, settings: Settings = DEFAULT) -> DataFrame:
    """Ids that `have` lacks (problem: missing) or has besides (extra), each once.

    Both tables are summed up by the leading bits of their ids' hashes; where the sums are the same nothing more is looked at, and where they differ the
    next bits follow, as many times as there are levels.  So equal tables cost an aggregation each, and only ids of ranges that differ meet one by one.
    """
    a, b = have.select("chunk_id"), want.select("chunk_id")
    for level in range(1, levels + 1):
        at = F.shiftrightunsigned(F.xxhash64("chunk_id"), 64 - bits * level)
        found = kept(differing(a, b, at), "differing")
        inside = lambda ids, found=found, at=at: ids.withColumn("_at", at).join(sized(found, settings), "_at", "left_semi").select("chunk_id")
        if found.isEmpty():
            a, b = a.limit(0), b.limit(0)
            break
        a, b = inside(a), inside(b)
    said = lambda ids, what: ids.select(F.lit(what).alias("problem"), F.col("chunk_id").cast("string").alias("id"))
    return said(b.subtract(a), "missing").unionByName(said(a.subtract(b), "extra"))


def row_problems(index: DataFrame, sources: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """What is wrong with single rows, by one look at each: problem, id.

    Urls that the sources lack are found among the distinct ones; rows meet those alone, and without their texts, as many rows may share a url.
    """
    kinds = dict(index.dtypes)
    empty = lambda c: F.size(c) == 0 if c == "heading_path" and kinds[c].startswith("array") else F.col(c) == ""
    protocol, host = F.expr("try_parse_url(source_url, 'PROTOCOL')"), F.lower(F.expr("try_parse_url(source_url, 'HOST')"))
    allowed = F.coalesce(protocol.isin(*settings.allowed_schemes) & host.isin(*settings.allowed_hosts), F.lit(False))
    urls = index.select("source_url").filter("source_url is not null").distinct()
    unlisted = kept(urls.join(sources.select(F.col("url").alias("source_url")).distinct(), "source_url", "left_anti"), "unlisted").withColumn("_unlisted", F.lit(True))
    wrong = {f"metadata {c}": F.coalesce(empty(c), F.lit(True)) for c in REQUIRED if c in kinds}
    wrong |= {"empty text": F.length(tx.strip(F.col("text"))) == 0, "url not in the sources": F.col("source_url").isNull(), "url not allowed": ~allowed}
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in wrong.items()]), lambda p: p.isNotNull())
    looked = index.select(F.col("chunk_id").cast("string").alias("id"), "source_url", found.alias("_found")).join(sized(unlisted, settings), "source_url", "left")
    all_found = F.when(F.col("_unlisted"), F.array_append("_found", F.lit("url not in the sources"))).otherwise(F.col("_found"))
    return looked.select(F.explode(all_found).alias("problem"), "id")


def problems(index: DataFrame, chunks: DataFrame, sources: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Differences between the index and what was put in: problem, id."""
    counts = beside(index.agg(F.count("*").alias("n")), chunks.agg(F.count("*").alias("m")))
    out = counts.filter("n <> m").select(F.lit("count").alias("problem"), F.format_string("%d of %d", "n", "m").alias("id"))
    twice = index.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1")
    out = out.unionByName(twice.select(F.lit("duplicate id").alias("problem"), F.col("chunk_id").cast("string").alias("id")))
    return out.unionByName(row_problems(index, sources, settings)).unionByName(id_difference(index, chunks, settings=settings))


def verify(index: DataFrame, chunks: DataFrame, sources: DataFrame, settings: Settings = DEFAULT) -> None:
    if found := problems(index, chunks, sources, settings).limit(20).collect():
        raise IndexVerificationError("; ".join(f"{r['problem']}: {r['id']}" for r in found))


def orphans(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Directories (name, bytes) with the name of a segment that the registry (id) lacks."""
    return listing.filter(F.col("name").rlike(UUID)).join(registry.select(F.col("id").alias("name")), "name", "left_anti").select("name", "bytes")


def prune_orphans(folder: str, registry_ids: set[str] | None) -> list[str]:
    """Delete orphaned segment folders; "name:bytes" of each, by name.  Without a registry nothing is touched."""
    if registry_ids is None or not os.path.isdir(folder):
        return []
    gone = []
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if os.path.isdir(path) and re.match(UUID, name) and name not in registry_ids:
            size = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)
            shutil.rmtree(path)
            gone.append(f"{name}:{size}")
    return gone


def write_meta(index: DataFrame, path: str) -> dict:
    row = corpus_meta(index).first().asDict()
    with open(temporary := f"{path}.{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
        json.dump(row, f)
    os.replace(temporary, path)
    return row


def dump_lines(index: DataFrame, neighbours: DataFrame | None = None, per_line: int = 8) -> DataFrame:
    """The index as text: chunk_id, line number and line; `neighbours` are those of `retrieve.all_neighbours`."""
    values = F.transform("embedding", lambda x: F.format_string("%+.4f", x.cast("double")))
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / per_line).cast("int")), lambda k: F.array_join(F.slice(values, k * per_line + 1, per_line), " "))
    near = F.lit(None).cast("array<string>")
    table = index
    if neighbours is not None:
        listed = neighbours.groupBy(F.col("query_id").alias("chunk_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("neighbour"), "distance"))), lambda n: F.format_string("  near: %s %.4f", n["neighbour"], n["distance"])).alias("near"))
        table, near = index.join(listed, "chunk_id", "left"), F.col("near")
    head = F.array(F.format_string("[%s] %s | %s", "chunk_id", "scheme", F.array_join("heading_path", " > ")), F.format_string("tokens: %d  norm: %.6f  url: %s", "n_tokens", vx.norm(F.col("embedding")), "source_url"))
    lines = F.concat(head, F.split("text", "\n"), rows, F.coalesce(near, F.array().cast("array<string>")))
    return table.select("chunk_id", F.posexplode(lines).alias("line_no", "line"))


def table_of_contents(index: DataFrame) -> DataFrame:
    return index.groupBy("scheme", "section").agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens")).orderBy("scheme", "section")


def dump_header(index: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """What stands before a dump, as rows of name and value."""
    from groundline.operators.retrieve import norm_stats

    row, tokens = norm_stats(index), F.format_string("%d to %d", "min_tokens", "max_tokens")
    values = {"model": F.lit(settings.embed_model), "dimensions": F.lit(settings.embed_dim), "window": F.lit(settings.embed_window), "chunks": F.col("n_rows"), "schemes": F.col("n_schemes"), "sections": F.col("n_sections"), "tokens": F.col("tokens"), "tokens of a chunk": tokens, "least norm": F.format_string("%.6f", "min_norm"), "greatest norm": F.format_string("%.6f", "max_norm")}
    return row.select(F.posexplode(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in values.items()])).alias("pos", "x")).select("pos", "x.name", "x.value")
