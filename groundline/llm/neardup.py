"""Near-duplicate documents by SuperMinHash, banding, verification and union-find grouping.

A document's set is its distinct shingles of five words, as 64-bit hashes (of 64-bit hashes of words); where two shingles had one hash they
would count as one.  SuperMinHash gives an element one rank and one slot
for each level of a random permutation; a slot keeps the least level and rank.  Levels are run for all elements of a set
at once and stop when every slot is filled, as later levels cannot win.  Slots are kept as bytes.

1. Equal sets fall together by their digest; the least doc_id stands for them.
2. Bands of some slots that agree put two sets in one bucket.  A bucket of more than `block` members, or of large sets, is dealt to blocks.
3. In each block members follow leaders: one whose signature is near that of an earlier leader is proposed as its link, else it leads.  These
   pairs, one for each member at most, are confirmed on full sets, and union-find groups them: a group of copies falls together here.
4. Buckets that still hold several groups are compared block by block.  First by whole signatures and sizes, which gives the members that may
   be linked with one of another group; then these members come with their full sets, and each pair whose signatures come near the limit,
   in the first bucket that it shares, is confirmed unless its ends are joined already.  Only links are written, never pairs that may be
   some, and no link between different groups is left out.

A pair at the limit itself shares no bucket with a chance of 2e-5 at 0.85 (28 bands of 7) and of
6e-5 at 0.80 (32 bands of 6), see `banding`, and its signatures
fall short of it by `slack` with a chance of at most 4e-6 at 0.85 and 2e-5 at 0.80.  That is the binomial chance of plain
MinHash, which bounds texts of any length; with fewer shingles SuperMinHash varies less.

A bucket of m members is read by m * ceil(m / block) rows, and where its texts are near but not linked their pairs are compared in memory.

Defined results: without words or text a document has an empty set and is linked with nothing; rows of one doc_id
count as one document for links, and each gives a row; a row without doc_id is linked with nothing and kept; an empty table gives no rows;
other columns are ignored by `groups` and kept by `deduplicate`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm import common

SHINGLE = 5
SLOTS = 196
#: The chance that a pair at the limit may share no bucket.
MISSED = 1e-4
#: Members of a block, and shingles of all their sets, about.
BLOCK, BLOCK_SHINGLES = 256, 4 << 20
SLACK = 0.12
#: Edges of one union-find in a task.
FOREST_EDGES = 1_000_000
#: Bits of the map of ids whose full sets are asked for, if they are an eighth of that at most; more ids are joined.
MAP_BITS = 1 << 24
#: Bytes, about, of words and their hashes that a worker keeps.
KEPT_BYTES = 32 << 20
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; forgotten beyond some bytes."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        self.held += len(word) + 160
        return h

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def trim(self) -> None:
        if self.held > KEPT_BYTES:
            self.forget()


_hashes = WordHashes()


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    _hashes.trim()
    words = [t.lower().split() for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((h for ws in words for h in map(_hashes.__getitem__, ws)), np.uint64, int(lengths.sum()))
    n = len(flat)
    grams = flat.copy()
    for k in range(1, width):
        grams[: n - k] = mixed(grams[: n - k] * _GOLD + flat[k:]) if k < n else grams[:0]
    out, at = [], 0
    for length in lengths.tolist():
        if length >= width:
            out.append(np.unique(grams[at : at + length - width + 1]))
        elif length:
            h = np.array([length], np.uint64)
            for k in range(at, at + length):
                h = mixed(h * _GOLD + flat[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += length
    return out


def signature(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: for each slot the least level and rank of an element that falls into it, as level << 32 | rank."""
    n = len(elements)
    values = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    rows, places = np.arange(n), None
    for level in range(slots):
        h = mixed(elements + np.uint64(level * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
        k = level + ((h & _LOW) * np.uint64(slots - level) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            slot = k
        else:
            if places is None:
                places = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (n, 1))
                places[rows, first] = 0  # the exchange of level 0
            slot = places[rows, k].astype(np.int64)
            places[rows, k] = places[:, level]
        np.minimum.at(values, slot, (h >> np.uint64(32)) | np.uint64(level << 32))
        if level == 0:
            first = k
        if int(values.max()) >> 32 <= level:
            break
    return values


def signature_bytes(elements: np.ndarray) -> bytes:
    return (mixed(signature(elements)) >> np.uint64(56)).astype(np.uint8).tobytes()


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, digest and signature of each row's set (both null where it is empty)."""
    out = common.arrow_schema(ddl := "doc_id long, n long, digest binary, signature binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common.enter("neardup", _hashes.forget)
        kept: dict[bytes, bytes] = {}
        for b in common.slices(batches, "text", 4 << 20):
            sets = shingle_sets(b.column("text").to_pylist())
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            if len(kept) > 50_000:
                kept.clear()
            for d, s in zip(digests, sets, strict=True):
                if d is not None and d not in kept:
                    kept[d] = signature_bytes(s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), pa.array([kept[d] if d is not None else None for d in digests], pa.binary())], schema=out)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), common.as_bytes(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("text")).mapInArrow(run, ddl)


def banding(percent: int) -> tuple[int, int]:
    """Bands and their slots: the longest bands by which a pair at the limit is missed with a chance of MISSED at most."""
    for rows in range(7, 2, -1):
        if (1 - (percent / 100) ** rows) ** (SLOTS // rows) <= MISSED:
            return SLOTS // rows, rows
    return SLOTS // 2, 2


def buckets(reps: DataFrame, bands: int, size: int) -> DataFrame:
    """key, rep and n for each band of each signature; the key is the band's number and its bytes."""
    out = common.arrow_schema(ddl := "key long, rep long, n long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), np.uint8).reshape(-1, SLOTS)[:, : bands * size].reshape(-1, bands, size)
                full = np.zeros((*sig.shape[:2], 8), np.uint8)
                full[:, :, :size], full[:, :, 7] = sig, np.arange(bands, dtype=np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(full.reshape(-1, 8).view("<i8")[:, 0]), *(pa.array(np.repeat(b.column(c).to_numpy(), bands)) for c in ("rep", "n"))], schema=out)

    return reps.select("rep", "n", "signature").mapInArrow(run, ddl)


def dealt(keyed: DataFrame, reps: DataFrame, block: int = BLOCK, shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Members of buckets of two or more, with the number of blocks of the bucket, their own block and their signature."""
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n") / shingles)).cast("int")
    shared = common.materialize(keyed.groupBy("key").agg(F.count("*").alias("count"), blocks.alias("blocks")).filter("count > 1").select("key", "blocks"), "buckets")
    own = F.pmod(F.xxhash64("rep", "key"), F.col("blocks")).cast("int")
    members = keyed.select("key", "rep").join(shared, "key").join(reps, "rep")
    return members.select("key", "blocks", own.alias("block"), "rep", "n", "signature")


def units(members: DataFrame) -> DataFrame:
    """Each member in the pairs of blocks i <= j that its own block is one of."""
    every = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return every.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")


class Unit:
    """Members that a task holds together: those of one block, or of two blocks i and j."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        column = lambda c: rows.column(c).to_numpy()
        self.rep, self.n, self.block = column("rep"), column("n"), column("block")
        self.band = int(rows.column("key")[0].as_py()) >> 56
        self.signatures = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint8).reshape(-1, SLOTS)

    def leaders(self, threshold: float, slack: float) -> list[tuple[int, int]]:
        """For each member that an earlier leader is near to, the nearest one and itself."""
        least, lead, out = round((threshold - slack) * SLOTS), [], []
        for i in range(len(self.rep)):
            if lead:
                same = (self.signatures[lead] == self.signatures[i]).sum(axis=1)
                fits = np.minimum(self.n[lead], self.n[i]) >= threshold * np.maximum(self.n[lead], self.n[i]) - 1e-9
                k = int(np.argmax(np.where(fits, same, -1)))
                if fits[k] and same[k] >= least:
                    out.append((int(self.rep[lead[k]]), int(self.rep[i])))
                    # what is nearer than the limit follows; what may fall short of it leads others all the same
                    if same[k] >= threshold * SLOTS:
                        continue
            lead.append(i)
        return out

    def candidates(self, threshold: float, slack: float, size: int, comp: np.ndarray, across: bool) -> Iterator[tuple[int, np.ndarray]]:
        """For each member those after it that may be linked with it: of another group, sizes and signatures near, no earlier band shared."""
        least = round((threshold - slack) * SLOTS)
        for i in range(len(self.rep) - 1):
            others = np.arange(i + 1, len(self.rep))
            # pairs of one block belong to the unit of that block alone
            keep = (comp[others] != comp[i]) & (self.block[others] != self.block[i] if across else True)
            small, large = np.minimum(self.n[others], self.n[i]), np.maximum(self.n[others], self.n[i])
            others = others[keep & (small >= threshold * large - 1e-9)]
            if not len(others):
                continue
            same = self.signatures[others] == self.signatures[i]
            count = same.sum(axis=1)
            good = np.flatnonzero(count >= least)
            if self.band and len(good):
                good = good[~same[good, : self.band * size].reshape(len(good), self.band, size).all(axis=2).any(axis=1)]
            if len(good):
                yield i, others[good[np.argsort(-count[good], kind="stable")]]


def units_of(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, which come one after another."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[pa.Table]:
        nonlocal held
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in keys])
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1).tolist(), table.num_rows]
            done = cuts if last else cuts[:-1]
            held = table.slice(done[-1]).to_batches()
            yield from (table.slice(x, y - x) for x, y in zip(done, done[1:], strict=False))

    for b in batches:
        if b.num_rows:
            held.append(b)
            if len(held) == 1 or any(b.column(c)[0] != b.column(c)[b.num_rows - 1] for c in keys):
                yield from cut(False)
    yield from cut(True)


def led(members: DataFrame, threshold: float, slack: float) -> DataFrame:
    """a < b: for each member of a block its nearest leader; no more rows than members."""
    out = common.arrow_schema(ddl := "a long, b long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in units_of(batches, ("key", "block")):
            if got := Unit(rows).leaders(threshold, slack) if rows.num_rows > 1 else []:
                yield pa.RecordBatch.from_arrays([pa.array([f(g) for g in got], pa.int64()) for f in (min, max)], schema=out)

    by_block = members.select("key", "block", "rep", "n", "signature").repartition("key", "block").sortWithinPartitions("key", "block", "rep")
    return by_block.mapInArrow(run, ddl).filter("a <> b").distinct()


OPEN_DDL = "key long, i int, j int, block int, rep long, n long, comp long, signature binary"


def open_members(members: DataFrame, threshold: float, slack: float, size: int) -> DataFrame:
    """Of each unit the members that may be linked with one of another group."""
    out = common.arrow_schema(OPEN_DDL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in units_of(batches, ("key", "i", "j")):
            if rows.num_rows > 1:
                hit = np.zeros(rows.num_rows, bool)
                for i, others in Unit(rows).candidates(threshold, slack, size, rows.column("comp").to_numpy(), rows.column("i")[0] != rows.column("j")[0]):
                    hit[i] = hit[others] = True
                if hit.any():
                    yield from rows.filter(pa.array(hit)).select(out.names).cast(out).combine_chunks().to_batches()

    by_unit = units(members).select(*out.names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    return by_unit.mapInArrow(run, OPEN_DDL)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def links_of(open_: DataFrame, sets: DataFrame, percent: int, slack: float, size: int) -> DataFrame:
    """a < b: links on full sets that join all that the members of each unit can reach there; fewer rows than members."""
    out, names = common.arrow_schema(ddl := "a long, b long"), [f.split(" ")[0] for f in OPEN_DDL.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in units_of(batches, ("key", "i", "j")):
            unit, comp = Unit(rows), rows.column("comp").to_numpy()
            sets_ = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column("elements")]
            parent = {c: c for c in comp.tolist()}

            def root(x: int, parent=parent) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            found = []
            for i, others in unit.candidates(percent / 100, slack, size, comp, rows.column("i")[0] != rows.column("j")[0]):
                for k in others.tolist():
                    x, y = root(int(comp[i])), root(int(comp[k]))
                    if x != y and linked(sets_[i], sets_[k], percent):
                        parent[max(x, y)] = min(x, y)
                        found.append((int(unit.rep[i]), int(unit.rep[k])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f(g) for g in found], pa.int64()) for f in (min, max)], schema=out)

    by_unit = open_.join(sets, "rep").select(*names, "elements").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    return by_unit.mapInArrow(run, ddl)


def asked_map(ids: DataFrame) -> bytes:
    """A bit map of fixed size of these ids."""
    at = F.pmod(F.xxhash64("rep"), F.lit(MAP_BITS))
    rows = ids.select(F.floor(at / 32).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(32)).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    words = np.zeros(MAP_BITS // 32, np.uint32)
    for r in rows.toLocalIterator():
        words[r["word"]] = r["bits"]
    return words.tobytes()


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAP_BITS // 8) -> DataFrame:
    """rep and its full set (sorted 64-bit hashes) for the ids (rep) asked for, and for a few more."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("rep"), common.as_bytes(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("text")).filter("rep is not null")
    at = F.pmod(F.xxhash64("rep"), F.lit(MAP_BITS)).cast("int")
    out = common.arrow_schema(ddl := "rep long, elements binary")
    few = ids.count() <= most
    if few:
        bits = docs.sparkSession.sparkContext.broadcast(asked_map(ids))
    else:
        rows = rows.join(ids, "rep", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("neardup", _hashes.forget)
        words = np.frombuffer(bits.value, np.uint32) if few else None
        for b in common.slices(batches, "text", 4 << 20):
            if few:
                place = b.column("at").to_numpy().astype(np.int64)
                hit = (words[place >> 5] >> (place & 31).astype(np.uint32)) & 1
                b = b.filter(pa.array(hit.astype(bool)))
            if b.num_rows:
                sets = [s.tobytes() for s in shingle_sets(b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(sets, pa.binary())], schema=out)

    return rows.withColumn("at", at).mapInArrow(run, ddl)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union."""
    out = common.arrow_schema(ddl := "a long, b long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [linked(*(np.frombuffer(v.as_buffer(), np.uint64) for v in xy), percent) for xy in zip(b.column("x"), b.column("y"), strict=True)]
            got = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([got.column("a"), got.column("b")], schema=out)

    first = pairs.join(sets.select(F.col("rep").alias("a"), F.col("elements").alias("x")), "a")
    both = first.join(sets.select(F.col("rep").alias("b"), F.col("elements").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, ddl)


def forest(edges: DataFrame, parts: int) -> DataFrame:
    """Union-find over the edges of each of `parts` partitions: node and the least node that it reaches there."""
    out = common.arrow_schema(ddl := "a long, b long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], schema=out)

    return edges.select("a", "b").repartition(parts).mapInArrow(run, ddl)


def components(edges: DataFrame, most: int = FOREST_EDGES) -> DataFrame:
    """rep and comp, the least id that it reaches, for all ends of edges; written.

    Edges are grouped by union-find in tasks of at most `most` edges.  While there are more, the tasks' trees are contracted:
    each node goes to the least of its neighbours, edges between the same nodes fall together, and the rest go round again.
    """
    names = own = None
    while True:
        parts = max(1, -(-edges.count() // most))
        trees = common.materialize(forest(edges, parts), "trees")
        common.release(own)
        if parts == 1:
            last = trees.select(F.col("a").alias("rep"), F.col("b").alias("comp"))
            out = common.materialize(last if names is None else renamed(names, last), "components")
            common.release(trees, names)
            return out
        both = trees.unionByName(trees.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = common.materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "up")
        # twice up shortens chains of least neighbours
        high = up.alias("u").join(up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.least("p", "q").alias("p"))
        high = common.materialize(high, "high")
        a, b = high.select("a", F.col("p").alias("x")), high.select(F.col("a").alias("b"), F.col("p").alias("y"))
        edges = own = common.materialize(trees.join(a, "a").join(b, "b").filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        step = common.materialize(high.select(F.col("a").alias("rep"), F.col("p").alias("comp")), "step")
        common.release(trees, up, high)
        if names is None:
            names = step
        else:
            before, names = names, common.materialize(renamed(names, step), "names")
            common.release(before, step)


def renamed(names: DataFrame, step: DataFrame) -> DataFrame:
    """names with their comp taken one step on."""
    to = step.select(F.col("rep").alias("comp"), F.col("comp").alias("to"))
    return names.join(to, "comp", "left").select("rep", F.coalesce("to", "comp").alias("comp"))


def groups(docs: DataFrame, percent: int = 80, block: int = BLOCK, slack: float = SLACK, forest_edges: int = FOREST_EDGES, most_asked: int = MAP_BITS // 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for each row."""
    threshold = percent / 100
    rows = common.materialize(signed(docs, id_col, text_col), "signed")
    some = rows.filter("n > 0 and doc_id is not null")
    equal = common.materialize(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "equal")
    reps = some.join(equal, (some["digest"] == equal["digest"]) & (some["doc_id"] == equal["rep"])).select("rep", "n", "signature")
    reps = common.materialize(reps, "reps")

    bands, size = banding(percent)
    keyed = common.materialize(buckets(reps, bands, size), "keyed")
    members = common.materialize(dealt(keyed, reps, block), "members")
    common.release(keyed, reps)
    asked = common.materialize(led(members, threshold, slack), "asked")
    sets = common.materialize(full_sets(docs, asked.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), id_col, text_col, most_asked), "sets")
    links = common.materialize(confirmed(asked, sets, percent), "links")
    comp = components(links, forest_edges)

    grouped = members.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    grouped = common.materialize(grouped, "grouped")
    common.release(asked, members)
    split = common.materialize(grouped.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key"), "split")
    open_ = common.materialize(open_members(grouped.join(split, "key"), threshold, slack, size), "open")
    common.release(grouped, split)
    wanted = common.materialize(open_.select("rep").distinct().join(sets.select("rep"), "rep", "left_anti"), "wanted")
    rest, both = None, sets
    if not wanted.isEmpty():
        rest = common.materialize(full_sets(docs, wanted, id_col, text_col, most_asked).join(sets.select("rep"), "rep", "left_anti"), "sets")
        both = sets.unionByName(rest)
    more = common.materialize(links_of(open_, both, percent, slack, size), "links")
    common.release(open_, wanted, sets, rest)
    links = links.unionByName(more)
    if not more.isEmpty():
        common.release(comp)
        comp = components(links, forest_edges)

    # the sets of an id that has several are joined by that id
    several = some.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high").select("doc_id")
    bridges = some.join(several, "doc_id").join(equal, "digest").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    if not bridges.isEmpty():
        comp = components(links.unionByName(bridges), forest_edges)

    # empty sets, which have no digest, are dealt by their id
    key = F.coalesce("digest", F.col("doc_id").cast("string").cast("binary"))
    placed = rows.select("doc_id", F.col("n").alias("n_shingles"), key.alias("digest")).join(equal, "digest", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    return placed.join(comp, "rep", "left").select("doc_id", "n_shingles", F.coalesce("comp", "rep").alias("component_id"))


def deduplicate(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is the least of its group: one for each id, with the least text if rows of an id differ."""
    found = groups(docs, percent, id_col=id_col, text_col=text_col, **options)
    keep = found.filter("doc_id = component_id").select("doc_id").distinct()
    row, key = "row", F.col(f"`{id_col}`")
    rows = docs.select(key.cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    one = rows.filter("doc_id is not null").join(keep, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias(row))
    return one.select(row).unionByName(rows.filter("doc_id is null").select(row)).select(f"{row}.*")
