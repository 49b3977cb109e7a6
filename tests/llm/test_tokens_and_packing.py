import random
import zlib

import numpy as np
import pytest

from groundline.llm import bpe, packing

ALPHABET = ["a", "B", "'s", "'RE", " ", "  ", "\n", "\t", "　", " ", "xé", "é", "Σ", "İ", "ẞ", "ß", "Ⅷ", "1", "12", ".,", "!?", "<|endoftext|>", "<|startoftext|>", "<|", "中日", "\x1c", "\x85", "☃️", "\U0001d4b3", "the ", "of ", "idiot"]


def odd_texts(n=1500):
    r = random.Random(1)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 20))) for _ in range(n)]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    own, library = bpe.WordBpe(bpe.default_tokenizer(), kept_bytes=50_000), Tokenizer.from_file(bpe.default_tokenizer())
    texts = odd_texts() + ["a" * 3000, "aaaa aaa aa a", ""]
    for a in range(0, len(texts), 400):
        part = texts[a : a + 400]
        for text, (ids, n, decoded) in zip(part, own.encode_texts(part), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert [int(i) for i in ids.split()] == want and n == len(want)
            assert decoded == library.decode(want, skip_special_tokens=False) == own.decode(want)


def test_merges_out_of_order_are_refused():
    vocab = {c: i for i, c in enumerate(["a", "b", "c", "ab", "abc"])}
    with pytest.raises(ValueError):
        bpe.PairIndex(vocab, [("ab", "c"), ("a", "b")])


def test_pair_index_on_overlaps():
    vocab = {c: i for i, c in enumerate(["a", "aa", "aaaa", "b", "ab"])}
    index = bpe.PairIndex(vocab, [("a", "a"), ("aa", "aa"), ("a", "b")])
    words = [[0] * n for n in range(7)] + [[0, 0, 0, 3]]
    assert index.encode(words) == [[], [0], [1], [1, 0], [2], [2, 0], [2, 1], [1, 4]]


def test_byte_ids_equal_the_library():
    from tokenizers import Tokenizer

    own, library = packing.ByteEncoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    assert own.cut
    own.kept_bytes = 20_000  # pieces are forgotten and met again
    texts = [*odd_texts(), *(" ".join(odd_texts(30)[k : k + 5]) for k in range(25)), "one two\nthree\n\nfour \nfive\n", "\n", " ", ""]
    for a in range(0, len(texts), 150):
        part = texts[a : a + 150]
        for text, ids in zip(part, own.encode(part), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def every_character():
    """Each code point that Unicode assigns, behind a letter, before a digit and alone."""
    points = [chr(c) for c in [*range(0x32000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c <= 0xDFFF]
    return [" ".join(f"B{c}1 {c}" for c in points[k : k + 2000]) for k in range(0, len(points), 2000)]


def test_every_character_as_the_library_has_it():
    from tokenizers import Tokenizer

    byte, word = packing.ByteEncoder(packing.default_tokenizer()), bpe.WordBpe(bpe.default_tokenizer())
    libraries = [Tokenizer.from_file(f()) for f in (packing.default_tokenizer, bpe.default_tokenizer)]
    texts = every_character()
    wants = [[e.ids for e in x.encode_batch(texts, add_special_tokens=False)] for x in libraries]
    for ids, want in zip(byte.encode(texts), wants[0], strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want
    for (ids, _, _), want in zip(word.encode_texts(texts), wants[1], strict=True):
        assert ids == " ".join(map(str, want))


def test_very_long_runs(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    runs = [" " * 5_000_000, "\n" * 5_000_000, " \n" * 600_000, "x" * 1_200_000, "ab " * 700_000 + "  " + "\n" * 1_200_000]
    digest = {r["doc_id"]: r for r in packing.pack_digest(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string"), window=1 << 26).collect()}
    for i, text in enumerate(runs):
        want = np.asarray([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (digest[i]["doc_tokens"], digest[i]["ids_crc32"]) == (len(want), zlib.crc32(want.tobytes()))


def test_files_that_say_something_else_are_refused():
    import json

    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    bpe.checked(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "BPEDecoder"}}, {"model": spec["model"] | {"unk_token": "x"}}):
        with pytest.raises(ValueError):
            bpe.checked(spec | change)
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    assert packing.cuttable(spec) and not packing.cuttable(spec | {"normalizer": {"type": "NFC"}})
    assert not packing.cuttable(spec | {"added_tokens": [spec["added_tokens"][0] | {"rstrip": True}]})


@pytest.mark.parametrize("parts", [1, 3])
def test_packing(spark, parts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_tokenizer())
    texts = [(i, t, 0) for i, t in enumerate(odd_texts(40))] + [(100, None, 0), (101, "", 0), (102, "word " * 5000, 0), (7, "again", 0), (None, "no id", 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, at int").repartition(parts)
    rows = packing.pack(docs, window=64).collect()
    ids = {}
    for r in rows:
        assert r["length"] > 0 and len(r["ids"]) == 4 * r["length"] and 0 <= r["offset"] and r["offset"] + r["length"] <= 64
        ids.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["doc_tokens"]))
    want = {}
    for i, t, _ in texts:
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 0])
    for i, docs_of in want.items():
        assert sum(len(x) for _, x, _ in ids[i]) == sum(map(len, docs_of))
        if len(docs_of) == 1:
            assert sum((x for _, x, _ in sorted(ids[i])), []) == docs_of[0] and {n for _, _, n in ids[i]} == {len(docs_of[0])}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for s, pieces in by.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or s == max(by)
    digest = packing.pack_digest(docs, window=64).collect()
    assert sorted(r["ids_crc32"] for r in digest) == sorted(zlib.crc32(bytes(r["ids"])) for r in rows)
    assert packing.pack(docs.limit(0)).count() == 0


def test_bpe_frame(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 5), (2, "Hello Wörld", 5)], "doc_id long, text string, n_tokens int")
    got = sorted(tuple(r) for r in bpe.encode(docs, digest=True).collect())
    assert [g[:2] for g in got] == [(1, 0), (1, 0), (2, bpe.WordBpe(bpe.default_tokenizer()).encode_texts(["Hello Wörld"])[0][1])]
    plain = bpe.encode(docs).filter("doc_id = 2").first()
    assert plain["decoded"].startswith("hello</w>") and bpe.loaded(bpe.default_tokenizer()).decode(plain["ids"]) == plain["decoded"]
    assert bpe.encode(docs.limit(0)).count() == 0


def test_even_texts_have_the_librarys_ids_and_words_skip_its_pattern(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    own, library = packing.ByteEncoder(packing.default_tokenizer(), kept_bytes=20_000), Tokenizer.from_file(packing.default_tokenizer())
    r = random.Random(3)
    even = [" ".join(t.split()) for t in [*odd_texts(), *(" ".join(odd_texts(30)[k : k + 5]) for k in range(25)), *every_character(), "cafÉ, ÿ.. x 's y", "it's 'tis. Ñx!!"]]
    even = ["".join(w + r.choice("\n   ") for w in t.split(" "))[:-1] for t in even if t]
    texts = [*even, "", "a  b", " a", "a\n", "a\n\nb", "Ġa Ċ b"]
    for a in range(0, len(texts), 97):
        part = texts[a : a + 97]
        for text, ids in zip(part, own.encode_column(pa.array(part), 0).to_pylist(), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]
    assert own.encode_column(pa.array(["one"]), None).to_pylist() == own.library(["one"]) and len(own.encode_column(pa.array([], pa.string()), 0)) == 0
    # words of letters go to the model alone, and none of them a second time
    seen = []
    monkeypatch.setattr(own, "joined", lambda pieces, lead, plain=own.joined: seen.extend(pieces) or plain(pieces, lead))
    words = [f"{a}{b}é" for a in "abcdefgh" for b in "stuvwxyz"]
    own.encode_column(pa.array(["first " + " ".join(words), "first " + " ".join(words[::-1])]), 0)
    assert not set(words) & set(seen)
