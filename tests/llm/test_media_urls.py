import random
import struct

import pytest

from groundline.llm import media, urls


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 3072, 3073, 6144, 50_000, 300_000])
def test_ogg_round_trip(size):
    payload = media.padded(random.Random(size).randbytes(size))
    assert len(payload) % 192 == 0 and len(payload) >= 192
    data = media.write(payload)
    got = media.parse(data)
    assert got.payload == payload and media.write(payload) == data
    assert all(t == sorted(t) for t in got.timestamps) and sum(s.granules[-1] for s in got.streams) == len(payload)


def test_ogg_finds_damage():
    assert media.checksum(b"hello ogg") == slow_checksum(b"hello ogg")
    data = media.write(media.padded(b"x" * 20_000))
    r = random.Random(2)
    for _ in range(60):
        at = r.randrange(len(data))
        with pytest.raises(media.OggError):
            media.parse(data[:at] + bytes([data[at] ^ (1 << r.randrange(8))]) + data[at + 1 :])
    for cut in (1, 30, 5000, len(data) - 1):
        with pytest.raises(media.OggError):
            media.parse(data[:cut])
    first = 27 + data[26] + sum(data[27 : 27 + data[26]])
    with pytest.raises(media.OggError):
        media.parse(data[:first] + data)  # a first page twice
    assert struct.unpack_from("<4s", data)[0] == b"OggS"


def test_ogg_frame(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "hé", 1), (3, "hé", 1)], "doc_id long, text string, n_bytes int")
    got = media.features(media.encode(docs)).orderBy("doc_id").collect()
    assert [r["n_bytes"] for r in got] == [0, 0, 3, 3] and {r["payload_bytes"] for r in got} == {192}
    assert got[0][2:] == got[1][2:] and got[2] == got[3]
    assert media.features(media.encode(docs), digest=False).filter("doc_id = 3").first()["payload"].startswith("hé".encode())


def plain_verdict(url, rules, default="allow"):
    host, path = urls.host_and_path(url)
    best = None
    for verdict, rule in rules:
        h, p = urls.split_rule(rule)
        if host and (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else default


def some_urls():
    r = random.Random(4)
    parts = ["http://", "https://", "", "example", ".", "net", "com", "org", "/", "en/", "de/", "fr/", "?x", "#y", "A", "www.", "://", "nét"]
    return [None, "", "x"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(3000)] + [f"http://{h}{p}" for h in ("net", "a.net", "example.net", "x.example.net", "example.com", "a.org", "org", "anet") for p in ("", "/", "/en/", "/en", "/de/x?y", "/fr/#z", "/en/../")]


def test_url_rules(spark):
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(some_urls())], "page_id long, url string, host string")
    want = {i: plain_verdict(u, urls.RULES) for i, u in enumerate(some_urls())}
    for most in (urls.MOST_BYTES, 0):
        got = {r["page_id"]: tuple(r)[1:] for r in urls.filter_urls(table, most_bytes=most).collect()}
        assert got == want
    assert urls.filter_urls(table.limit(0)).count() == 0


def test_ties_go_to_the_longer_host(spark):
    rules = (("allow", "a.b.c/"), ("block", "b.c/xx"))
    table = spark.createDataFrame([(1, "http://a.b.c/xx"), (2, "http://b.c/xx")], "page_id long, url string")
    for most in (urls.MOST_BYTES, 0):
        assert [r["verdict"] for r in urls.filter_urls(table, rules, most_bytes=most).orderBy("page_id").collect()] == ["allow", "block"]


def test_digests_that_collide_are_told_apart(tmp_path):
    same = lambda _: 7
    (tmp_path / "r").write_bytes(urls.DigestArray.build([("block", "a/"), ("allow", "b/"), ("block", "b/")], same))
    array = urls.DigestArray(str(tmp_path / "r"))
    assert array.find(["a/", "b/", "c/"], same) == [("block", "a/"), ("allow", "b/"), None]


def test_hosts_of_many_labels(spark, tmp_path):
    host = "a." * 50_000 + "example.com"
    assert sum(map(len, urls.asked(host, "/de/x", [4, 1], len("example.com")))) < 100
    assert urls.asked("b.net", "/", [1], 3) == ["net/"] and urls.asked("xnet", "/", [1], 3) == [] and urls.asked("net", "/", [1], 3) == ["net/"]
    table = spark.createDataFrame([(1, f"http://{host}/de/x"), (2, "http://" + "b." * 50_000 + "fr/x")], "page_id long, url string")
    for most in (urls.MOST_BYTES, -1):
        assert {r["page_id"]: r["rule"] for r in urls.filter_urls(table, most_bytes=most).collect()} == {1: "example.com/de/", 2: None}
