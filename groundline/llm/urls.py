"""URL filters by a sorted digest array.

Rules (a host and a path that a url's path begins with) are kept as the sorted 64-bit xxhash of their
text, in a file that workers map into memory, beside their texts.  A url is asked for by the keys of
all its host's suffixes with all beginnings of its path that have a length some rule has; a
vectorised binary search finds digests, and the stored full text settles collisions.  The longest rule wins.

The rule file goes to executors with SparkContext.addFile, if it is no larger than `most_bytes`.  A larger rule
set is looked up by a join on the digest with the same confirmation.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and gets the
default verdict; repeated rows each give a row; among rules of one text the first
counts; of rules of one length that fit, that with the longer host wins; an empty table gives no rows; a very long url gives
no suffix that is longer than the longest rule's host; other columns are left out.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm import common

#: Rules of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MOST_BYTES = 64 << 20
DEFAULT = "allow"
_UPPER = "".join(map(chr, range(65, 91)))


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [k for c in "/?#" if (k := rest.find(c)) >= 0]
    host = rest[: min(ends, default=len(rest))]
    after = rest[len(host) :]
    ends = [k for c in "?#" if (k := after.find(c)) >= 0]
    lowered = host.translate({ord(c): c.lower() for c in _UPPER})
    return lowered, after[: min(ends, default=len(after))]


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def asked(host: str, path: str, lengths: list[int], longest: int) -> list[str]:
    """Texts of all rules that would fit, longest first among each suffix; no rule has a host over `longest`, so no suffix is."""
    if not host:
        return []
    out, at = [], 0
    if len(host) > longest and (at := host.find(".", len(host) - longest - 1) + 1) == 0:
        return []
    while True:
        suffix = host[at:]
        out += [suffix + path[:n] for n in lengths if n <= len(path)]
        dot = host.find(".", at)
        if dot < 0:
            return out
        at = dot + 1


class DigestArray:
    """Rule texts by ascending digest: an array of digests in a mapped file, and texts at offsets in another part of it."""

    MAGIC = b"GLDIGEST"

    @classmethod
    def build(cls, rules: Iterable[tuple[str, str]], digest=None) -> bytes:
        import numpy as np
        import xxhash

        digest = digest or xxhash.xxh64_intdigest
        first: dict[str, str] = {}
        for verdict, rule in rules:
            first.setdefault(rule, verdict)
        rows = sorted((digest(r.encode()), r, v) for r, v in first.items())
        texts = [f"{v}\t{r}".encode() for _, r, v in rows]
        lengths = sorted({len(split_rule(r)[1]) for r in first}, reverse=True)
        keys = np.array([d for d, _, _ in rows], "<u8")
        ends = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype("<u8")
        longest = max((len(split_rule(r)[0]) for r in first), default=0)
        head = np.array([len(rows), len(lengths), longest, *lengths], "<u8")
        return cls.MAGIC + head.tobytes() + keys.tobytes() + ends.tobytes() + b"".join(texts)

    def __init__(self, path: str):
        import numpy as np

        self.map = np.memmap(path, np.uint8, "r")
        if bytes(self.map[:8]) != self.MAGIC:
            raise ValueError("no digest array")
        words = lambda at, n: self.map[at : at + 8 * n].view("<u8")
        n, k, self.longest = map(int, words(8, 3))
        self.lengths = [int(x) for x in words(32, k)]
        at = 32 + 8 * k
        self.keys, self.ends, self.texts = words(at, n), words(at + 8 * n, n + 1), at + 8 * (2 * n + 1)

    def text(self, k: int) -> tuple[str, str]:
        verdict, _, rule = bytes(self.map[self.texts + int(self.ends[k]) : self.texts + int(self.ends[k + 1])]).decode().partition("\t")
        return verdict, rule

    def find(self, texts: list[str], digest=None) -> list[tuple[str, str] | None]:
        """The rule (verdict, text) with exactly this text, for each."""
        import numpy as np
        import xxhash

        digest = digest or xxhash.xxh64_intdigest
        probe = np.fromiter((digest(t.encode()) for t in texts), np.uint64, len(texts))
        low, high = np.searchsorted(self.keys, probe, "left"), np.searchsorted(self.keys, probe, "right")
        out: list[tuple[str, str] | None] = [None] * len(texts)
        for i in np.flatnonzero(high > low).tolist():
            out[i] = next((got for k in range(low[i], high[i]) if (got := self.text(k))[1] == texts[i]), None)
        return out


def judge(urls: list[str | None], rules: DigestArray, default: str) -> list[tuple[str, str, str | None, str]]:
    split = [host_and_path(u) for u in urls]
    probes, owner = [], []
    for i, (host, path) in enumerate(split):
        got = asked(host, path, rules.lengths, rules.longest)
        probes += got
        owner += [i] * len(got)
    best: dict[int, tuple[str, str]] = {}
    for i, hit in zip(owner, rules.find(probes), strict=True):
        if hit and (i not in best or len(hit[1]) > len(best[i][1])):
            best[i] = hit
    return [(h, p, best[i][1] if i in best else None, best[i][0] if i in best else default) for i, (h, p) in enumerate(split)]


_mapped: dict[str, DigestArray] = {}
_sent: set[tuple[str, str]] = set()


def mapped(path: str) -> DigestArray:
    if path not in _mapped:
        _mapped[path] = DigestArray(path)
    return _mapped[path]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = DEFAULT, most_bytes: int = MOST_BYTES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row."""
    spark: SparkSession = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rules = list(rules)
    data = DigestArray.build(rules)
    if len(data) > most_bytes:
        return _joined(rows, rules, default)
    name = f"rules-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    sent = (spark.sparkContext.applicationId, name)
    if sent not in _sent:  # a file of one name can be added once
        with open(path := os.path.join(tempfile.mkdtemp(prefix="groundline-rules-"), name), "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(path)
        _sent.add(sent)
    out = common.arrow_schema(ddl := "page_id long, host string, path string, rule string, verdict string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        array = mapped(SparkFiles.get(name))
        for b in common.slices(batches, "url"):
            got = judge(b.column("url").to_pylist(), array, default)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *[pa.array([g[k] for g in got], pa.string()) for k in range(4)]], schema=out)

    return rows.mapInArrow(run, ddl)


def _joined(rows: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """For rule sets too large to send to every worker: the same keys, joined by digest and confirmed by text."""
    spark = rows.sparkSession
    first: dict[str, str] = {}
    for verdict, rule in rules:
        first.setdefault(rule, verdict)
    table = spark.createDataFrame([(r, v) for r, v in first.items()], "rule string, verdict string").withColumn("digest", F.xxhash64("rule"))
    lengths = sorted({len(split_rule(r)[1]) for r in first}, reverse=True)
    longest = max((len(split_rule(r)[0]) for r in first), default=0)
    keyed_ddl = "row_key string, page_id long, host string, path string, probes array<string>"
    out = common.arrow_schema(keyed_ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in common.slices(batches, "url"):
            split = [host_and_path(u) for u in b.column("url").to_pylist()]
            keys = [f"{part}-{n + k}" for k in range(len(split))]
            n += len(split)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), b.column("page_id"), pa.array([s[0] for s in split], pa.string()), pa.array([s[1] for s in split], pa.string()), pa.array([asked(*s, lengths, longest) for s in split], out.field(4).type)], schema=out)

    keyed = common.materialize(rows.mapInArrow(run, keyed_ddl), "urls")
    probes = keyed.select("row_key", F.explode("probes").alias("probe")).withColumn("digest", F.xxhash64("probe"))
    hits = probes.join(table, "digest").filter("probe = rule").groupBy("row_key").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length(F.substring_index("rule", "/", 1)))).alias("hit"))
    return keyed.join(hits, "row_key", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
