"""WARC archives by an index that is written first.

Writing: tasks append gzip-compressed records, each a member of its own, to archives in the shared folder, and give a row of the index for
each record (archive, offset, length, url, digest); an archive counts only through the index rows of the attempt that closed it, so
a task that is lost or run twice leaves nothing wrong.  Of equal payloads of some size one is kept as a response, the others are
revisits that refer to it.  Reading: rows of the index that are wanted are sorted by place, ranges that touch or nearly do are read in one go,
and every record is checked against its header, its lengths and its digest.

Defined results: a null page counts as an empty one; a null url gives a record without one; a null id is the smallest; of rows
repeated with one id and one payload one is the response; a very long page is a record of its own read; an empty table gives no
archive and no rows; other columns, whatever their names, are left out.  A record that differs from its index raises WarcError.

Archives are written and read by range through Arrow's file systems, so the shared folder must be one that they know (local or mounted
paths, hdfs, s3, gcs, abfs).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundline.llm import common

LEAST_REVISIT = 1000
ARCHIVE_BYTES, READ_BYTES, GAP_BYTES = 1 << 30, 8 << 20, 64 << 10
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
INDEX = "archive string, offset long, length long, url string, digest string, payload_bytes long, page_id long, record_type string"


class WarcError(ValueError):
    pass


def record_id(page_id: int | None, digest: str) -> str:
    """The id of the response that others refer to."""
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{digest}'.encode()).hexdigest())}>"


def record(kind: str, fields: dict[str, str | None], block: bytes, level: int = 6) -> bytes:
    """One record, compressed by itself."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    plain = f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + END
    return zlib.compress(plain, level, wbits=31)


def page_record(page_id: int | None, url: str | None, digest: str, payload: bytes | None, size: int, refers_to: int | None, referred: bool, level: int = 6) -> bytes:
    """A response, or without a payload a revisit that refers to the page of an id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    own = record_id(page_id, digest) if referred else f"<urn:uuid:{uuid.uuid4()}>"
    fields = {
        "WARC-Record-ID": own, "WARC-Date": DATE, "WARC-Target-URI": None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]|"),
        "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response", "Page-Id": None if page_id is None else str(page_id),
    }
    if payload is not None:
        return record("response", fields, http + payload, level)
    more = {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "Refers-To-Page-Id": None if refers_to is None else str(refers_to)}
    return record("revisit", fields | more, http, level)


class Read(NamedTuple):
    kind: str
    fields: dict[str, str]
    size: int
    payload: bytes | None


def parse(stored: bytes) -> Read:
    """A compressed record; lengths and, where there is a payload, its digest are checked."""
    unpack = zlib.decompressobj(wbits=31)
    try:
        plain = unpack.decompress(stored)
    except zlib.error as e:
        raise WarcError(f"no compressed record: {e}") from e
    head, found, rest = plain.partition(END)
    lines = head.decode().split("\r\n")
    if not unpack.eof or unpack.unused_data or not found or not lines[0].startswith("WARC/1."):
        raise WarcError("no whole record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    if rest[int(fields["Content-Length"]) :] != END:
        raise WarcError("the block has another length")
    kind, block = fields["WARC-Type"], rest[: -len(END)]
    if kind not in ("response", "revisit"):
        return Read(kind, fields, len(block), None)
    http, _, payload = block.partition(END)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "revisit":
        return Read(kind, fields, size, None)
    if len(payload) != size or f"sha1:{hashlib.sha1(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
        raise WarcError("the payload has another digest")
    return Read(kind, fields, size, payload)


def place(path: str):
    """Arrow's file system of a folder, and the folder's name there."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


class Archives:
    """What one task writes: archives of bounded size, each opened by its first record."""

    def __init__(self, folder: str, most: int) -> None:
        (self.files, self.folder), self.most, self.stream = place(folder), most, None
        self.name, self.at = "", 0

    def add(self, data: bytes) -> tuple[str, int]:
        if self.stream is None or self.at >= self.most:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.stream = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.put(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"software: groundline\r\nformat: WARC File Format 1.1\r\n"))
        name, at = self.name, self.at
        self.put(data)
        return name, at

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def typed(pages: DataFrame, least: int = LEAST_REVISIT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, digest, payload_bytes, payload (null for revisits), refers_to, referred: who is the response of each group of equal payloads.

    Groups are counted from ids and digests alone; a page that many rows repeat travels once.
    """
    payload = common.as_bytes(common.text_or_empty(html_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("strong"))
    each = rows.filter(F.col("payload_bytes") >= least).groupBy("digest", "strong", "page_id").agg(F.count("*").alias("n"))
    groups = each.groupBy("digest", "strong").agg(F.sum("n").alias("n"), F.max(F.struct("page_id", "n")).alias("top")).filter("n > 1")
    groups = common.materialize(groups.select("digest", "strong", "n", F.col("top.page_id").alias("head"), F.col("top.n").alias("heads")), "groups")
    told = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("heads"), F.lit(0)).alias("heads")).first()
    lane = F.xxhash64("page_id", "url", "digest")
    marked = common.attach(rows, groups, ["digest", "strong"], "n", told["n"], lane, F.col("payload_bytes") < least)
    repeated = F.col("n").isNotNull()
    at_head = repeated & F.col("page_id").eqNullSafe(F.col("head"))
    first = F.col("_first") if told["heads"] > 1 else F.lit(True)
    if told["heads"] > 1:  # rows repeated with id and payload: one of them is the response
        twice = at_head & (F.col("heads") > 1)
        one = marked.filter(twice).withColumn("_first", F.row_number().over(Window.partitionBy("digest", "strong").orderBy("url")) == 1)
        marked = marked.filter(~twice).withColumn("_first", F.lit(True)).unionByName(one)
    response = ~repeated | (at_head & first)
    return marked.select("page_id", "url", "digest", "payload_bytes", F.when(response, F.col("payload")).alias("payload"), F.when(~response, F.col("head")).alias("refers_to"), (repeated & response).alias("referred"))


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES, level: int = 6, **columns: str) -> tuple[DataFrame, str]:
    """Archives of all pages in a shared folder: their index (written) and the folder."""
    spark = common.importable(pages.sparkSession)
    folder = folder or common.shared_path(spark, "warc")
    files, path = place(folder)
    files.create_dir(path, recursive=True)
    out = common.arrow_schema(INDEX)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Archives(folder, archive_bytes)
        try:
            for b in common.slices(batches, "payload"):
                got = []
                for r in b.to_pylist():
                    data = page_record(r["page_id"], r["url"], r["digest"], r["payload"], r["payload_bytes"], r["refers_to"], r["referred"], level)
                    got.append((*to.add(data), len(data), r["url"], r["digest"], r["payload_bytes"], r["page_id"], "revisit" if r["payload"] is None else "response"))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*got), out, strict=True)], schema=out)
        finally:
            to.close()

    return common.materialize(typed(pages, least, **columns).mapInArrow(run, INDEX), "warc-index"), folder


def read(index: DataFrame, folder: str, payloads: bool = True, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records that the index rows name: page_id, url, payload_bytes, payload_digest, record_type, refers_to, reads (how many ranges the record's task had read by then) and, if asked for, payload."""
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, reads long" + (", payload binary" if payloads else "")
    out = common.arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = place(folder)
        name, file, reads = None, None, 0

        def load(rows: list[dict]) -> pa.RecordBatch:
            nonlocal name, file, reads
            if rows[0]["archive"] != name:
                if file is not None:
                    file.close()
                name = rows[0]["archive"]
                file = files.open_input_file(f"{base}/{name}")
            start, end = rows[0]["offset"], max(r["offset"] + r["length"] for r in rows)
            data, got, reads = memoryview(file.read_at(end - start, start)), [], reads + 1
            for r in rows:
                found = parse(bytes(data[r["offset"] - start :][: r["length"]]))
                digest = found.fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if (digest, found.size, found.kind) != (r["digest"], r["payload_bytes"], r["record_type"]):
                    raise WarcError(f"record at {r['offset']} of {name} is not the one of the index")
                page, refers = found.fields.get("Page-Id"), found.fields.get("Refers-To-Page-Id")
                got.append((None if page is None else int(page), r["url"], found.size, digest, found.kind, None if refers is None else int(refers), reads, found.payload)[: len(out)])
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*got), out, strict=True)], schema=out)

        pending: list[dict] = []
        try:
            for b in batches:
                for r in b.to_pylist():
                    if pending:
                        end = pending[-1]["offset"] + pending[-1]["length"]
                        if r["archive"] != pending[-1]["archive"] or r["offset"] - end > gap_bytes or r["offset"] + r["length"] - pending[0]["offset"] > read_bytes:
                            yield load(pending)
                            pending = []
                    pending.append(r)
            if pending:
                yield load(pending)
        finally:
            if file is not None:
                file.close()

    # stretches of one archive go to different tasks
    wanted = index.select([f.split(" ")[0] for f in INDEX.split(", ")]).repartition("archive", F.floor(F.col("offset") / read_bytes)).sortWithinPartitions("archive", "offset")
    return wanted.mapInArrow(run, ddl)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all pages and read every record back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    index, folder = write(pages, **options)
    return read(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
