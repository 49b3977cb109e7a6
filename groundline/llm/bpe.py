"""BPE encoding and decoding by a pair occurrence index.

The words of a slice of a partition that were not seen before are laid out in one flat array of
symbols.  An index maps the rank of each pair that can be merged to all positions where it stands.
Active ranks are applied in ascending order, each at all its positions at once, and the
lists of the pairs that a merge makes left and right of it are updated.

Ranks ascend within a word just as if it were alone, as a pair made by a merge has a higher rank
than that merge; the merges file is checked for this when it is loaded.

Defined results: a null text counts as an empty one, with no ids; every row gives a row, repeated rows too; an empty
table gives no rows; a very long text is taken whole, in a slice of its own; other columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm import common

#: White space of Unicode, as the tokenizer file's expression `\s` means it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes, about, of chunks and their ids that a worker keeps.
KEPT_BYTES = 96 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PairIndex:
    """Merges of a vocabulary, applied to many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        import numpy as np

        self.size = max(vocab.values()) + 1
        made: dict[int, int] = {}
        self.left, self.right, self.new = (np.zeros(len(merges), np.int32) for _ in range(3))
        for rank, (a, b) in enumerate(merges):
            self.left[rank], self.right[rank], self.new[rank] = vocab[a], vocab[b], vocab[a + b]
            if made.get(vocab[a], -1) >= rank or made.get(vocab[b], -1) >= rank:
                raise ValueError(f"merge {rank} uses a symbol that is made later")
            if vocab[a + b] in made:
                raise ValueError(f"merge {rank} makes a symbol that another merge makes")
            made[vocab[a + b]] = rank
        if any(made.get(int(x), -1) >= r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True)) for x in (a, b)):
            raise ValueError("merges are not in ascending order")
        keys = self.left.astype(np.int64) * self.size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, a, b):
        """The rank of each pair, -1 where it has none."""
        import numpy as np

        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode(self, words: list[list[int]]) -> list[list[int]]:
        import numpy as np

        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return self.merged(np.fromiter((s for w in words for s in w), np.int32, int(lengths.sum())), lengths)

    def merged(self, symbols, lengths) -> list[list[int]]:
        """Words as symbols end to end, with their lengths, to the ids of each word."""
        import numpy as np

        if not len(lengths):
            return []
        ends = np.cumsum(lengths)
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list] = {}
        active: list[int] = []

        def add(at) -> None:
            """Enter the pairs that begin at these positions."""
            if not len(at):
                return
            rank = self.ranks(symbols[at], symbols[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, places in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(active, r)

        add(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            at = index.pop(r)
            at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            a, b, c = self.left[r], self.right[r], self.new[r]
            at = at[alive[at] & (symbols[at] == a)]
            at = at[after[at] >= 0]
            at = at[symbols[after[at]] == b]
            if a == b and len(at) > 1:
                # of positions that overlap, the leftmost goes first
                free, keep = -1, []
                for p in np.sort(at).tolist():
                    if p != free:
                        keep.append(p)
                        free = int(after[p])
                    else:
                        free = -1
                at = np.asarray(keep)
            if not len(at):
                continue
            gone = after[at]
            symbols[at] = c
            alive[gone] = False
            follow = after[gone]
            after[at] = follow
            before[follow[follow >= 0]] = at[follow >= 0]
            lead = before[at]
            add(np.unique(np.concatenate((lead[lead >= 0], at[follow >= 0]))))
        left = symbols[alive]
        counts = np.add.reduceat(alive, np.minimum(ends - lengths, n - 1)) if n else np.zeros(len(lengths), int)
        counts = np.where(lengths > 0, counts, 0)
        cut = np.cumsum(counts)
        left = left.tolist()
        return [left[e - k : e] for e, k in zip(cut.tolist(), counts.tolist(), strict=True)]


#: What this encoder does, as a tokenizers file says it; a file that says something else is refused.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def checked(spec: dict) -> dict:
    """A tokenizers file of word BPE, its words found by one pattern that leaves white space out."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") != NORMALIZER or spec.get("decoder") is not None:
        raise ValueError("the file has another normaliser or decoder")
    parts = pre.get("pretokenizers") or [{}]
    split = parts[0]
    if pre.get("type") != "Sequence" or len(parts) != 2 or parts[1] != LEVEL or split.get("type") != "Split" or split.get("behavior") != "Removed" or not split.get("invert") or "\\s\\p{L}\\p{N}]" not in split["pattern"]["Regex"]:
        raise ValueError("the file has another pre-tokenizer")
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        raise ValueError("the file has another model")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("the file has added tokens of another kind")
    return spec


class WordBpe:
    """The word tokenizer of a tokenizers file: NFC, white space to blanks, lower case, word ends.

    Case, composition and letters are those of the library's own tables: chunks between white space that are not ASCII go through its
    normaliser, and all chunks through its pattern for words.  Merges are this module's.
    """

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        model = spec["model"]
        self.vocab = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.added.items()}
        self.end = model["end_of_word_suffix"] or ""
        self.index = PairIndex(self.vocab, [tuple(m) for m in model["merges"]])
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.split = pre_tokenizers.Split(Regex(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)
        self.white = re.compile(f"[{WHITE}]+")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.symbols = byte_symbols()
        self.number = {i: str(i) for i in self.token}.__getitem__
        plain = [self.vocab[c] for c in self.symbols]
        last = [self.vocab[c + self.end] for c in self.symbols]
        self.of_byte = (plain, last)
        #: The ids of chunks between white space, as they stand in texts.
        self.ids: dict[str, list[int]] = {}
        self.kept_bytes, self.held = kept_bytes, 0

    def chunks(self, text: str) -> list[str]:
        # str.split() takes four more characters for white space
        return self.white.sub(" ", text).split(" ") if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def normal(self, chunks: list[str]) -> list[str]:
        """Chunks as the library's normaliser leaves them."""
        odd = [c for c in chunks if not c.isascii()]
        joined = self.normalizer.normalize_str(" ".join(odd)).split(" ") if odd else []
        if len(joined) != len(odd):
            joined = [self.normalizer.normalize_str(c) for c in odd]
        found = iter(joined)
        return [c.lower() if c.isascii() else next(found) for c in chunks]

    def words(self, chunks: list[str]) -> list[list[str]]:
        """The words of each chunk, by the library's pattern, which no blank between chunks can match."""
        out, at, k = [[] for _ in chunks], 0, 0
        ends = []
        for c in chunks:
            at += len(c) + 1
            ends.append(at)
        for word, (start, _) in self.split.pre_tokenize_str(" ".join(chunks)):
            while start >= ends[k]:
                k += 1
            out[k].append(word)
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words; bytes become symbols, the last one with the word's end."""
        import numpy as np

        data = [w.encode() for w in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        symbols = np.asarray(self.of_byte[0], np.int32)[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = np.asarray(self.of_byte[1], np.int32)[flat[ends]]
        return self.index.merged(symbols, lengths)

    def learn(self, chunks: list[str]) -> None:
        split = self.words(self.normal(chunks))
        distinct = list({w for ws in split for w in ws})
        ids = dict(zip(distinct, self.encode_words(distinct), strict=True))
        for c, ws in zip(chunks, split, strict=True):
            self.ids[c] = ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]]
            self.held += len(c) + 8 * len(self.ids[c]) + 200

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """Stretches of a text, and whether each is an added token."""
        if self.special is None or not any(t in text for t in self.added):
            return [(text, False)]
        return [(p, k % 2 == 1) for k, p in enumerate(self.special.split(text)) if p]

    def encode_texts(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """Of each text its ids as text joined by blanks, their number, and the decoded text."""
        rows, seen = [], set()
        for t in texts:
            row = []
            for p, added in self.parts(t):
                row.append((p, None) if added else (None, self.chunks(p)))
                if not added:
                    seen.update(row[-1][1])
            rows.append(row)
        if self.held > self.kept_bytes:
            self.ids.clear()
            self.held = 0
        self.learn(list(seen.difference(self.ids)))
        of, token, number, out = self.ids.__getitem__, self.token.__getitem__, self.number, []
        for row in rows:
            ids: list[int] = []
            for added, chunks in row:
                if added is None:
                    ids.extend(chain.from_iterable(map(of, chunks)))
                else:
                    ids.append(self.added[added])
            out.append((" ".join(map(number, ids)), len(ids), " ".join(map(token, ids))))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_texts([text or ""])[0][0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, as the file names no decoder; an unknown id gives nothing."""
        return " ".join(self.token[i] for i in ids if i in self.token)


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One for each worker process."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids (array of int) and decoded, or with digest their SHA-256."""
    path = tokenizer or default_tokenizer()
    ddl = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")
    out = common.arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.enter("bpe", _loaded.clear)
        bpe = loaded(path)
        for b in common.slices(batches, "text"):
            got = bpe.encode_texts(b.column("text").to_pylist())
            if digest:
                first = pa.array([hashlib.sha256(g[0].encode()).hexdigest() for g in got], pa.string())
                last = pa.array([hashlib.sha256(g[2].encode()).hexdigest() for g in got], pa.string())
            else:
                first, last = pa.array([[int(i) for i in g[0].split()] for g in got], out.field(2).type), pa.array([g[2] for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[1] for g in got], pa.int64()), first, last], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_or_empty(text_col).alias("text")).mapInArrow(run, ddl)
