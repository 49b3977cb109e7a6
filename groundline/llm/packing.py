"""Packing by concatenate and cut.

Pass one turns each document into token ids and keeps, beside them, the document's offset among the
tokens of its own partition.  The totals of the partitions (a row each) are summed up to the offset
at which each partition begins.  Pass two adds the two offsets, so that every document knows its
place in the one long stream of all tokens, and cuts the stream at multiples of the window: a
document that crosses boundaries gives a record for each window it touches.

Only the last window can be short.  Pass two is DataFrame functions alone.

Defined results: a null text counts as an empty one, which has the end-of-document id alone;
repeated rows are packed as often as they come; an empty table gives no rows; a very long text is taken whole, in a slice of its own;
other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import json
import os
import re
from collections import ChainMap
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundline.llm import common

WINDOW = 1024
END_ID = 0
#: Bytes of pieces and ids, about, after which a worker begins to forget those that it does not meet again.
KEPT_BYTES = 24 << 20
#: Pieces that are encoded as one text.
AT_ONCE = 256
_SIGNED = re.compile(r"\A(\n?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)\Z")
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
# For Arrow: a text that is empty, or has white space but for blanks and newlines that stand alone between two other characters; and a piece of letters with signs behind them.
_ODD_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_UNEVEN = rf"[{_ODD_SPACE}]|[ \n][ \n]|\A[ \n]|[ \n]\z|\A\z"
_WORDED = r"\A(?P<lead>[\r\n]?)(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)\z"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Characters as which byte-level models write bytes; here newlines stay, to part words.
_MOVED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_WRITTEN = np.arange(256, dtype="<u4")
_WRITTEN[_MOVED] = 256 + np.arange(len(_MOVED))
_BLANK = chr(_WRITTEN[32])
_WRITTEN[10] = 10


@dataclasses.dataclass(frozen=True)
class Runs:
    """Runs of ids, one behind the other."""

    ids: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(runs: list[np.ndarray]) -> Runs:
        return Runs(np.concatenate([np.zeros(0, "<u4"), *runs]), np.asarray([len(r) for r in runs], np.int64))

    def __add__(self, other: Runs) -> Runs:
        return Runs(np.concatenate([self.ids, other.ids]), np.concatenate([self.sizes, other.sizes]))

    @property
    def nbytes(self) -> int:
        return self.ids.nbytes + self.sizes.nbytes

    def take(self, which: np.ndarray) -> Runs:
        """The runs of these numbers, in their order."""
        starts, sizes = np.cumsum(self.sizes) - self.sizes, self.sizes[which]
        moved = starts[which] - (np.cumsum(sizes) - sizes)
        return Runs(self.ids[np.repeat(moved, sizes) + np.arange(sizes.sum())], sizes)


class ByteEncoder:
    """Ids by the tokenizers library, as little-endian unsigned 32-bit numbers.

    A byte-level pre-tokenizer always cuts before a blank, and on both sides of a newline, that stands alone between two other
    characters, as no alternative of its pattern reaches over one.  So texts are cut before these, and a piece that came before keeps its ids.
    Files of another form, or with added tokens that hold or eat blanks, get whole texts encoded.
    """

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cut = cuttable(spec)
        self.newline = self.library(["\n"])[0]
        self.kept_bytes = kept_bytes
        self.words = word_tokenizer(path, spec) if self.cut else None
        if self.words:
            names = self.words.get_vocab()
            self.leads = np.zeros(max(names.values()) + 1, bool)
            self.leads[[i for name, i in names.items() if name.startswith(_BLANK)]] = True
        self.clear()

    def clear(self) -> None:
        #: Ids of pieces that begin a text, and of those that a blank (left out) or a newline leads; what was not used of late waits in the second table of each.
        self.first: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.led: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.held = 0
        #: Pieces of even texts and their ids.
        self.known, self.store = pa.array([], pa.string()), Runs.of([])

    def age(self) -> None:
        """What was kept and not asked for since the last time goes."""
        self.first, self.led, self.held = ({}, self.first[0]), ({}, self.led[0]), 0

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_column(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """Ids of each text, with that of the end, as binary values."""
        last = b"" if end is None else end.to_bytes(4, "little")
        other = lambda some: pa.array([x + last for x in self.encode(some.to_pylist())], pa.binary())
        if not self.cut:
            return other(texts)
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        if not pc.any(uneven).as_py():
            return self.even(texts, end)
        odd = uneven.to_numpy(zero_copy_only=False)
        both = pa.concat_arrays([other(texts.filter(uneven)), self.even(texts.filter(pc.invert(uneven)), end)])
        return both.take(pa.array(np.argsort(np.concatenate([np.flatnonzero(odd), np.flatnonzero(~odd)]))))

    def even(self, texts: pa.Array, end: int | None) -> pa.Array:
        """As encode_column, for texts in which each blank and newline stands alone: a piece is told by its text, with a sign (no white space of an even text) before the first one."""
        signed = pc.binary_join_element_wise(pa.scalar("\r"), texts, pa.scalar(""))
        lists = pc.split_pattern(pc.replace_substring(signed, "\n", " \n"), " ")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        pieces = self.places(coded.dictionary)[coded.indices.to_numpy()]
        store = self.store
        if end is not None:
            store = store + Runs.of([np.asarray([end], "<u4")])
            pieces, ends = np.insert(pieces, ends, len(store.sizes) - 1), ends + np.arange(1, len(ends) + 1)
        found = store.take(pieces)
        cuts = np.concatenate([[0], np.cumsum(found.sizes)])[np.concatenate([[0], ends])]
        if cuts[-1] * 4 >= 1 << 31:
            raise ValueError("a text has too many ids for a binary value")
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * cuts).astype(np.int32)), pa.py_buffer(found.ids)])

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where the store has the ids of distinct pieces; new ones join it, and from a full store those go that are not among these."""
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(at))
        out = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        out[out < 0] = len(self.known) + np.arange(len(new))
        if len(new):
            self.known, self.store = pa.concat_arrays([self.known, new]), self.store + self.pieces(new)
        if self.known.nbytes + self.store.nbytes > self.kept_bytes:
            self.known, self.store, out = pieces, self.store.take(out), np.arange(len(pieces))
        return out

    def pieces(self, new: pa.Array) -> Runs:
        """Ids of pieces that a blank (left out), a newline or the sign of a text's beginning leads."""
        parts = pc.extract_regex(new, _WORDED)
        fits = pc.is_valid(parts)
        lead, word, tail = (parts.field(k).filter(fits) for k in range(3))
        after = pc.equal(lead, "")
        words, bare, tails = word.filter(after).dictionary_encode(), word.filter(pc.invert(after)).dictionary_encode(), tail.dictionary_encode()
        others = new.filter(pc.invert(fits)).to_pylist()
        led, lined, first = [p for p in others if p[0] not in "\r\n"], [p[1:] for p in others if p[0] == "\n"], [p[1:] for p in others if p[0] == "\r"]
        numbers = lambda lists: [np.frombuffer(x, "<u4") for x in lists]
        texts = [*bare.dictionary.to_pylist(), *lined, *first, *(t or "\r" for t in tails.dictionary.to_pylist())]
        store = self.led_words(words.dictionary.to_pylist()) + Runs.of(numbers(self.joined(led, " "))) + Runs.of(numbers(self.joined(texts, "")))
        none = len(store.sizes)
        store += Runs.of([np.zeros(0, "<u4"), np.frombuffer(self.newline, "<u4")])
        # three runs for each piece: a newline, what is between, and signs, as far as it has them
        of = np.full((len(new), 3), none, np.int64)
        begins = np.cumsum([0, len(words.dictionary), len(led), len(bare.dictionary), len(lined), len(first)])
        own, behind = np.flatnonzero(fits.to_numpy(zero_copy_only=False)), after.to_numpy(zero_copy_only=False)
        of[own[behind], 1] = words.indices.to_numpy()
        of[own[~behind], 1] = begins[2] + bare.indices.to_numpy()
        of[own[pc.equal(lead, "\n").to_numpy(zero_copy_only=False)], 0] = none + 1
        ended = pc.not_equal(tail, "").to_numpy(zero_copy_only=False)
        of[own[ended], 2] = begins[5] + tails.indices.to_numpy()[ended]
        rest = np.flatnonzero(~fits.to_numpy(zero_copy_only=False))
        kinds = np.asarray([{"\n": 3, "\r": 4}.get(p[0], 1) for p in others], np.int64)
        for kind in (1, 3, 4):
            some = rest[kinds == kind]
            of[some, 1] = begins[kind] + np.arange(len(some))
        of[rest[kinds == 3], 0] = none + 1
        found = store.take(of.ravel())
        return Runs(found.ids, found.sizes.reshape(-1, 3).sum(axis=1))

    def led_words(self, words: list[str]) -> Runs:
        """Ids of words of letters behind a blank, which the pre-tokenizer leaves whole: the model's own characters go to it, and what begins with a blank begins a word."""
        if not self.words:
            return Runs.of([np.frombuffer(x, "<u4") for x in self.joined(words, " ")])
        texts = [" " + "\n ".join(words[k : k + AT_ONCE]) for k in range(0, len(words), AT_ONCE)]
        texts = [_WRITTEN[np.frombuffer(t.encode(), np.uint8)].tobytes().decode("utf-32-le") for t in texts]
        ids = [np.asarray(e.ids, "<u4") for e in self.words.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        begins = np.flatnonzero(self.leads[ids])
        if len(begins) != len(words) or (len(words) and begins[0]):
            return Runs.of([np.frombuffer(x, "<u4") for x in self.joined(words, " ")])
        return Runs(ids, np.diff(begins, append=len(ids)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cut:
            return self.library(texts)
        if self.held > self.kept_bytes:
            self.age()
        known, rows, first, led, odd, heads = self.led[0], [], set(), set(), set(), set()
        for t in texts:
            head, *rest = t.replace("\n", " \n").split(" ")
            new = set(rest).difference(known)
            # blanks and newlines that stand alone, and no other white space: then there are as many words as pieces
            if head and "" not in new and "\n" not in new and len(t.split()) == len(rest) + 1:
                led |= new
                first.add(head)
            else:
                head, *rest = _BOUNDARY.split(t)
                for p in set(rest).difference(known):
                    (odd if spaced(p) else led).add(p)
                (heads if spaced(head) else first).add(head)
            rows.append((head, rest))
        own, after = self.learned(self.first, first, ""), self.learned(self.led, led, " ")
        # what white space begins, ends or breaks is not kept
        if heads:
            own = ChainMap(own, dict(zip(heads, self.library(list(heads)), strict=True)))
        if odd:
            after = ChainMap(after, dict(zip(odd, self.library([f" {p}" for p in odd]), strict=True)))
        return [own[head] + b"".join(map(after.__getitem__, rest)) for head, rest in rows]

    def learned(self, tables: tuple[dict[str, bytes], dict[str, bytes]], wanted: set[str], lead: str) -> dict[str, bytes]:
        """The table of kept ids, with those of all wanted pieces, in which white space stands nowhere but as a newline that leads."""
        kept, old = tables
        new = wanted.difference(kept)
        if old:
            again = {p: old[p] for p in new if p in old}
            self.keep(kept, again, again.values())
            new.difference_update(again)
        # a word and the signs behind it are cut as well, whatever stands around them
        signed = [(m[0], m[1], m[2]) for m in map(_SIGNED.match, new) if m]
        new.difference_update([p for p, _, _ in signed])
        new.update(set([w for _, w, _ in signed]).difference(kept))
        plain, lined = [p for p in new if p[0] != "\n"], [p for p in new if p[0] == "\n"]
        self.keep(kept, plain, self.joined(plain, lead))
        self.keep(kept, lined, [self.newline + ids for ids in self.joined([p[1:] for p in lined], "")])
        tails = list({t for _, _, t in signed})
        ids = dict(zip(tails, self.joined(tails, ""), strict=True))
        self.keep(kept, [p for p, _, _ in signed], [kept[w] + ids[t] for _, w, t in signed])
        return kept

    def keep(self, table: dict[str, bytes], pieces: Collection[str], ids: Collection[bytes]) -> None:
        table.update(zip(pieces, ids, strict=True))
        self.held += sum(map(len, pieces)) + sum(map(len, ids)) + 150 * len(pieces)

    def joined(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of pieces without white space, encoded as the lines of one text: a newline alone between them is a token of its own."""
        out: list[bytes] = []
        lists = [pieces[k : k + AT_ONCE] for k in range(0, len(pieces), AT_ONCE)]
        texts = ["\n".join([lead + p for p in own]) for own in lists]
        line = np.frombuffer(self.newline, "<u4")[0]
        for own, got in zip(lists, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else (), strict=True):
            ids = np.asarray(got.ids, "<u4")
            ends = np.flatnonzero(ids == line)
            if len(self.newline) != 4 or len(ends) != len(own) - 1:
                out += self.library([lead + p for p in own])
                continue
            data, cuts = ids.tobytes(), [-4, *(4 * ends).tolist(), 4 * len(ids)]
            out += [data[a + 4 : b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out


def spaced(piece: str) -> bool:
    """Is there white space in a piece, but for a newline that leads it?  Or is it empty?"""
    own = piece[1:] if piece[:1] == "\n" else piece
    return own.split() != [own]


def cuttable(spec: dict) -> bool:
    """Is it byte-level BPE by the usual pattern, with no normaliser and no added token that blanks matter to?"""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex")
    added = any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens") or ())
    return bool(plain and level and not added and not spec.get("normalizer"))


def word_tokenizer(path: str, spec: dict):
    """The file's model behind a cut at blanks alone, for words of letters; none where an added token could stand in such a word."""
    from tokenizers import Tokenizer, pre_tokenizers

    if not all(re.search(r"[!-@\[-`{-~]", t["content"]) for t in spec.get("added_tokens") or ()):
        return None
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    out.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return out


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, at (tokens of the partition before the row), doc id, n_tokens and ids (binary, 4 bytes each)."""
    out = common.arrow_schema("part int, at long, doc_id long, n_tokens long, ids binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        common.enter("packing", _encoders.clear)
        part, at, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for b in common.slices(batches, "text"):
            ids = enc.encode_column(b.column("text"), end_id)
            counts = pc.binary_length(ids).to_numpy().astype(np.int64) // 4
            begins = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(begins), b.column("doc_id"), pa.array(counts), ids], schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "part int, at long, doc_id long, n_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    rows = common.materialize(tokenized(docs, tokenizer or default_tokenizer(), end_id, id_col, text_col), "packing")
    # a row for each partition of pass one, the only thing that one task sees whole
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    begins = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("begin"))
    placed = rows.filter("n_tokens > 0").join(F.broadcast(begins), "part").withColumn("place", F.col("begin") + F.col("at"))
    first, last = F.floor(F.col("place") / window), F.floor((F.col("place") + F.col("n_tokens") - 1) / window)
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("sequence_id") * window - F.col("place"), F.lit(0))
    cut = cut.withColumn("start", start.cast("long"))
    length = F.least((F.col("sequence_id") + 1) * window - F.col("place"), F.col("n_tokens")) - F.col("start")
    return cut.withColumn("length", length.cast("long")).select(
        "doc_id", "start", "length",
        F.substring(F.col("ids"), (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids"),
        F.col("n_tokens").alias("doc_tokens"), F.col("sequence_id").cast("long").alias("sequence_id"),
        (F.col("place") + F.col("start") - F.col("sequence_id") * window).cast("long").alias("offset"),
    )


def pack_digest(docs: DataFrame, **options) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
