"""Personal data, and information-theoretic sanitisation of what gives it away.

Base patterns find e-mail addresses, IP addresses, payment cards and telephone numbers; their distinct values are the
protected entities.  Corpus co-occurrence tells how strongly a term near an entity reveals it: with n
rows in all, the pointwise mutual information of entity and term, over the entity's own
information, log2(n * n(e,t) / (n(e) * n(t))) / log2(n / n(e)).  At 1 the term comes with the entity alone and gives
all of it away.  A term of a document that holds the entity is removed if its share exceeds
`remove`, generalised (to a word for its kind: name, code or plain word) if it exceeds `generalise`, and left otherwise.

All entities and terms are scored, those of a single document too.  A share is smoothed by `discount`, which is taken
from the number of documents that hold both: it hardly matters for a link seen often, while one seen once in n documents
gives 1 + log2(1 - discount) / log2(n) at most, so it is generalised from some hundred documents on.  A term counts wherever it stands in a document, and each place of it outside
base spans is marked in every document that holds the entity.  Counts are over all documents.

Defined results: a null text counts as an empty one, with no spans; every row counts in all figures and gives a row, so repeated
rows raise counts of entity, term and both alike; where spans meet, base ones stay whole and a term within one is none; an
empty table gives no rows; a very long text is taken whole, in a slice of its own; other columns are kept by `sanitize`, whatever their names, and ignored by `spans`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm import common

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "term")
REMOVE, GENERALISE = 0.95, 0.8
#: Taken from a count of documents that hold both entity and term, as in absolute discounting.
DISCOUNT = 0.6
#: Candidate terms go to every worker if their texts have no more bytes than this; else a bit map of their checksums goes
#: (of fixed size: more terms only mean more words beside them), and a join with the terms follows.
MOST_BYTES, MAP_BITS = 16 << 20, 1 << 26
#: Frequent words that workers leave out where no value could make terms of them; the joins leave out any others.
HOT_TERMS = 50_000

# The base patterns.
# A run of digits matches from its first digit or not at all, so none is looked at again from within.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that do not overlap; from each @ outwards, so long words cost no more than their length."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, value: str) -> str:
    """A protected value is known by its digest alone."""
    value = value.lower() if kind == "email" else "".join(c for c in value if c.isdigit() or (c == "." and kind == "ip"))
    return hashlib.sha256(f"{kind}:{value}".encode()).hexdigest()[:32]


def folded(text: str) -> str:
    """In lower case, each character in its place."""
    lowered = text.lower()
    return lowered if len(lowered) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def places(text: str, terms: dict[str, str]) -> list[tuple[int, int, str]]:
    """Start, end and action of every place of these terms outside all base spans."""
    found = [(*m.span(), terms[m[0]]) for m in WORD.finditer(folded(text)) if m[0] in terms]
    out, inside, k = [], sorted((a, b) for _, a, b in base_spans(text)) if found else [], 0
    reach = 0  # the farthest end of the base spans that begin before a term's end
    for start, stop, action in found:
        while k < len(inside) and inside[k][0] < stop:
            reach = max(reach, inside[k][1])
            k += 1
        if reach <= start:
            out.append((start, stop, action))
    return out


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of id and text) and text."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("doc_id", "text"))


def holding(rows: DataFrame) -> DataFrame:
    """key, entities and text of the rows with base spans."""
    out = common.arrow_schema(ddl := "key long, entities array<string>, text string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("pii")
        for b in common.slices(batches, "text"):
            got = [(key, sorted({entity(k, text[x:y]) for k, x, y in spans}), text) for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True) if (spans := base_spans(text))]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], out.field(k).type) for k in range(3)], schema=out)

    return rows.select("key", "text").mapInArrow(run, ddl)


def bundles(held: DataFrame) -> DataFrame:
    """key, bundle, n_rows and n_entity of each row with base spans.

    Values that stand in the same rows as often have the same figures with every term, so they are one bundle, known by two digests of these
    rows that hang on no order; a list of ten thousand addresses is one.  n_rows: how many rows have this key, so that all counts are of rows.
    """
    own = held.select("key", F.explode("entities").alias("entity")).groupBy("key", "entity").agg(F.count("*").alias("n_rows"))
    marks = [F.bit_xor(F.xxhash64(F.lit(seed), "key", "n_rows")).alias(seed) for seed in ("a", "b")]
    rows = own.groupBy("entity").agg(F.sum("n_rows").alias("n_entity"), F.count("*").alias("n_keys"), *marks)
    bundle = F.concat_ws(":", "n_entity", "n_keys", F.hex("a"), F.hex("b"))
    return own.join(rows, "entity").select("key", bundle.alias("bundle"), "n_rows", "n_entity").distinct()


def words(held: DataFrame, without: frozenset[str] = frozenset()) -> DataFrame:
    """key and term for each distinct word of a row, but for some words."""
    out = common.arrow_schema(ddl := "key long, term string")
    sent = held.sparkSession.sparkContext.broadcast(without)  # at most HOT_TERMS words

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("pii")
        for b in common.slices(batches, "text", 1 << 20):
            got = [(key, w) for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True) for w in set(WORD.findall(folded(text))) - sent.value]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string())], schema=out)

    return held.select("key", "text").mapInArrow(run, ddl)


def marked_places(held: DataFrame) -> DataFrame:
    """key and marks of rows with their terms (term and action)."""
    out = common.arrow_schema(ddl := "key long, marks array<struct<start:int,stop:int,action:string>>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("pii")
        for b in common.slices(batches, "text"):
            marks = [[dict(zip(("start", "stop", "action"), p, strict=True)) for p in places(text, {t["term"]: t["action"] for t in terms})] for text, terms in zip(b.column("text").to_pylist(), b.column("terms").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(marks, out.field(1).type)], schema=out)

    return held.select("key", "text", "terms").mapInArrow(run, ddl)


def term_map(terms: DataFrame) -> bytes:
    """A bit map of fixed size of the checksums of these terms."""
    at = F.crc32(F.col("term").cast("binary")) % MAP_BITS
    bit = F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))
    out = bytearray(MAP_BITS // 8)
    for r in terms.groupBy(F.floor(at / 8).cast("int").alias("byte")).agg(F.bit_or(bit).alias("bits")).toLocalIterator():
        out[r["byte"]] = r["bits"]
    return bytes(out)


def term_counts(rows: DataFrame, terms: DataFrame, most_bytes: int) -> DataFrame:
    """term, n_term: of how many rows each candidate term is a word, over all rows."""
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0)).alias("size")).first()["size"]
    few = size <= most_bytes
    broadcast = rows.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in terms.collect()) if few else term_map(terms))
    ddl = "term string, n long"
    out = common.arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter
        from zlib import crc32

        wanted, total = broadcast.value, Counter()
        for b in common.slices(batches, "text"):
            for text in b.column("text").to_pylist():
                own = set(WORD.findall(folded(text)))
                if few:
                    total.update(own & wanted)
                else:
                    sums = ((w, crc32(w.encode()) % MAP_BITS) for w in own)
                    total.update([w for w, c in sums if wanted[c >> 3] >> (c & 7) & 1])
            if len(total) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=out)
                total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=out)

    counts = rows.select("text").mapInArrow(run, ddl)
    if not few:
        counts = counts.join(terms, "term", "left_semi")
    return counts.groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosure(n: int, n_entity: int, n_term: int, n_both: float) -> float:
    """Share of the entity's information that the term gives."""
    own = math.log2(n / n_entity) if n_entity else 0.0
    return math.log2(n * n_both / (n_entity * n_term)) / own if own > 0 and n_both else 0.0


def disclosing(docs_rows: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE, discount: float = DISCOUNT, most_bytes: int = MOST_BYTES) -> DataFrame:
    """key and marks (start, stop, action, by start) of the rows with terms that give an entity away."""
    held = common.materialize(holding(docs_rows), "holding")
    n = float(docs_rows.count())
    own = common.materialize(bundles(held), "bundles")
    counts = common.materialize(term_counts(docs_rows, common.materialize(words(held).select("term").distinct(), "terms"), most_bytes), "term-counts")
    # As n_both is n_entity at most, a share over the limit needs a term of fewer rows than this: an exact bound, not a cut.
    bound = F.lit(n) * F.pow(F.lit(n) / F.col("n_entity"), -generalise) * (1 + 1e-9)
    most = own.groupBy("key").agg(F.max(bound).alias("most"))
    top = own.agg(F.max(bound)).first()[0] or 0.0
    # Words beyond every bound would be dropped by the joins below; the hot ones among them are not even sent there.
    hot = counts.filter((F.col("n_term") >= top) & (F.col("n_term") * common.HOT_SHARE > n)).orderBy(F.desc("n_term"), "term").limit(HOT_TERMS)
    found = words(held, frozenset(r["term"] for r in hot.select("term").collect()))
    rare = found.join(counts.filter(F.col("n_term") < top), "term").join(most, "key").filter(F.col("n_term") < F.col("most")).select("key", "term", "n_term").distinct()
    linked = common.materialize(rare.join(own, "key").filter(F.col("n_term") < bound), "linked")
    both = linked.groupBy("bundle", "term").agg(F.sum("n_rows").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    share = F.log2(F.lit(n) * (F.col("n_both") - discount) / (F.col("n_entity") * F.col("n_term"))) / F.log2(F.lit(n) / F.col("n_entity"))
    scored = both.withColumn("share", F.when(F.col("n_entity") < n, share).otherwise(F.lit(0.0))).filter(F.col("share") > generalise)
    scored = scored.select("bundle", "term", F.when(F.col("share") > remove, "remove").otherwise("generalise").alias("action"))
    actions = linked.select("key", "bundle", "term").join(scored, ["bundle", "term"]).groupBy("key", "term").agg(F.max("action").alias("action"))
    terms = common.materialize(actions.groupBy("key").agg(F.collect_list(F.struct("term", "action")).alias("terms")), "disclosing")
    # repeated rows have one key, and equal marks
    marks = marked_places(held.join(terms, "key")).filter(F.size("marks") > 0).groupBy("key").agg(F.first("marks").alias("marks"))
    return common.materialize(marks, "marks")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, counts of each base kind, base spans and all spans as text."""
    rows = prepared(docs, id_col, text_col)
    out = common.arrow_schema(ddl := "key long, doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("pii")
        for b in common.slices(batches, "text"):
            got = [base_spans(t) for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in g) for g in got], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), *counts, pa.array(map(joined, got), pa.string())], schema=out)

    marked = disclosing(rows, **options)
    terms = F.array_join(F.transform("marks", lambda m: F.concat_ws(":", F.lit("term"), m["start"], m["stop"])), ",")
    found = rows.select("key", "doc_id", "text").mapInArrow(run, ddl).join(marked.select("key", terms.alias("terms")), "key", "left")
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", F.nullif("base", F.lit("")), "terms").alias("spans"))


def term_kind(word: str) -> str:
    """What a generalised term is replaced by: it is known as a name, a code or a word, by its letters' case in this place, and no more."""
    return "<CODE>" if word.isupper() else "<NAME>" if word[:1].isupper() else "<WORD>"


def sanitized_text(text: str, marks: list[tuple[int, int, str]]) -> str:
    """Base spans become a word for their kind; terms go, or become a word for theirs."""
    cuts: list[tuple[int, int, str]] = []
    for kind, a, b in base_spans(text):
        cuts.append((a, b, f"<{kind.upper()}>"))
    cuts += [(a, b, "" if action == "remove" else term_kind(text[a:b])) for a, b, action in marks]
    out, at = [], 0
    for a, b, word in sorted(cuts):
        if b <= at:
            continue
        out += [text[at : max(a, at)], word if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with their columns, the text sanitised; a null text stays null."""
    key, marks = common.fresh("key", docs.columns), common.fresh("marks", docs.columns)
    rows = docs.withColumn(key, F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    marked = disclosing(prepared(docs, id_col, text_col), **options).select(F.col("key").alias(key), F.col("marks").alias(marks))
    both = rows.join(marked, key, "left").drop(key)  # the columns of docs, then the marks
    out, at = common.arrow_schema_of(docs.schema), f"c{docs.columns.index(text_col)}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("pii")
        for b in common.slices(batches, at):
            texts = [None if t is None else sanitized_text(t, [(m["start"], m["stop"], m["action"]) for m in ms or ()]) for t, ms in zip(b.column(at).to_pylist(), b.column(len(out)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if f.name == text_col else b.column(k).cast(f.type) for k, f in enumerate(out)], schema=out)

    return common.numbered(both).mapInArrow(run, docs.schema)
