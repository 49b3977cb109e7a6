import random
import time

import pytest

from groundline.llm import html


def test_suffix_array_against_plain_sorting():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 120):
        tokens = r.integers(0, 3, n)
        order, ranks = html.suffix_array(tokens)
        assert order.tolist() == sorted(range(n), key=lambda i: tokens[i:].tolist())
        shared = html.common_prefixes(order, ranks)
        for k in range(1, n):
            a, b = tokens[order[k - 1] :].tolist(), tokens[order[k] :].tolist()
            assert shared[k] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">X</a></li></ul></nav>
<!-- <p>no</p> --><div class="ad">Buy</div><div class="cookie-notice">Cookies</div><article class="post"><h1>Title &amp; more</h1><p><b>One  two<br><p>Th&eacute;e &lt;b&gt;</p><aside>side</aside><form><p>mail</p></form><div class="comments"><p>first!</p></div><p>End</p></article>
<footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html.main_texts([PAGE]) == ["Title & more\nOne two\nThée <b>\nEnd"]
    assert html.main_texts(["", "plain words", "<article>a", "<p>x &amp;amp; y"]) == ["", "plain words", "a", "x &amp; y"]
    assert html.main_texts(["<article>" + "w " * 300_000 + "</article>"])[0].count("w") == 300_000


def test_open_blocks_lose_what_pages_repeat():
    common = "this line stands on every page of it"
    pages = [f"<body><p>{common}</p><p>only page {w} has these own words</p></body>" for w in ("red", "green", "blue")]
    got = html.main_texts(pages, 5)
    assert all(common not in g for g in got) and "red" in got[0]
    assert html.main_texts([pages[0], pages[0]], 5)[0].startswith(common)  # copies are no evidence


def plain_texts(rows, width):
    """Main texts of rows (host, html) by comparing every stretch of `width` tokens with every page."""
    held = {}
    for host, page in set(rows):
        for tokens, _ in html.streams_of(html.blocks_of(page)):
            for k in range(len(tokens) - width + 1):
                held.setdefault((host, tuple(tokens[k : k + width])), set()).add(page)
    out = []
    for host, page in rows:
        blocks = html.blocks_of(page)
        kept = {i: [] for i in range(len(blocks))}
        for tokens, block in html.streams_of(blocks):
            hit = [False] * len(tokens)
            for k in range(len(tokens) - width + 1):
                if len(held[host, tuple(tokens[k : k + width])]) > 1:
                    hit[k : k + width] = [True] * width
            for t, i, h in zip(tokens, block, hit, strict=True):
                if not h:
                    kept[i].append(t)
        texts = [t if r == html.ARTICLE else " ".join(kept[i]) if r == html.OPEN else "" for i, (r, t) in enumerate(blocks)]
        out.append("\n".join(t for t in texts if t))
    return out


def some_pages(n=160, seed=3):
    """Pages of a few hosts without an article, one of them hot, with lines that some of them share."""
    r = random.Random(seed)
    shared = [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.randint(3, 9))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [r.choice(shared) if r.random() < 0.5 else " ".join(f"w{r.randrange(400)}" for _ in range(r.randint(1, 8))) for _ in range(r.randint(1, 7))]
        body = "".join(r.choice(["<p>{}</p>", "<div>{}</div>", "<nav>{}</nav>", "<li>{}", "{}<br>"]).format(p) for p in parts)
        rows.append((r.choice(["a", "a", "b", "c"]), f"<body>{'<article><p>' + r.choice(shared) + '</p></article>' if r.random() < 0.2 else ''}{body}</body>"))
    return rows + rows[:9]


@pytest.mark.parametrize(("parts", "most"), [(1, html.MOST_BYTES), (7, html.MOST_BYTES), (5, -1)])
def test_extract_against_plain_search(spark, parts, most):
    rows = some_pages()
    want = plain_texts(rows, 4)
    assert want != plain_texts(rows, 10**6)  # the repeats decide
    table = spark.createDataFrame([(i, f"http://{h.upper()}/{i}", p, 1) for i, (h, p) in enumerate(rows)], "page_id long, url string, html string, host int").repartition(parts)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(table, 4, most_bytes=most).collect()}
    assert got == {i: (t, len(t)) for i, t in enumerate(want)}
    off = {r["page_id"]: r["text"] for r in html.extract(table, 10**6, most_bytes=most).collect()}
    assert sum(off[i] != t for i, t in enumerate(want)) > 50


def test_a_repeat_is_found_across_partitions(spark):
    line = "two of many pages share this line and nothing else"
    rows = [(i, "http://hot/x", f"<p>{line if i in (3, 2900) else 'own'} w{i}</p>") for i in range(3000)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)).collect()}
    assert got[3] == "w3" and got[2900] == "w2900" and got[4] == "own w4"


def test_html_frame(spark):
    rows = [(1, "http://a/x", PAGE, 1), (2, None, None, 1), (3, "http://a/y", "<p>x", 1), (3, "http://a/y", "<p>x", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(table).collect())
    assert [g[0] for g in got] == [1, 2, 3, 3] and got[1][1:] == ("", 0) and got[2][1:] == ("x", 1) and got[0][1].startswith("Title")
    assert html.extract(table.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>a <svg/> b</p><p>c</p></article>", "a b\nc"),
        ("<p>a <svg><svg></svg><text>no</text></svg> b <math>x</math>c", "a b c"),
        ("<article><p>a</p><object data=x><p>b</p></article>", "a\nb"),
        ("<p>a <canvas>b</p><p>c", "a b\nc"),
        ("<p>a<noscript><p>no</p></noscript></p>b<template><p>no</template>c", "a\nbc"),
        ('hi <a href="x>link there', "hi link there"),
        ("<p title='a>b'>c <b class=x'y>d</b>", "c d"),
        ("<article><p data-id='comments' data-role=banner>a</p><p class='social-science'>b</p><p class='ad-hoc notice'>c</p><div id=comments-policy>d</div><div class='x comments'>no</div><ul class=share><li>no</ul></article>", "a\nb\nc\nd"),
        ("<div title='class=ad'>a</div><div class='ad'>no</div>", "a"),
        ("<main><p>a</p></main><p>b</p>", "a\nb"),
        ("<script>no", ""),
        ("<title>no</title><body>a &amp;lt; b &copy c<", "a &lt; b \u00a9 c<"),
        ("a &nbsp;\u2003 b</div></p>\n\nc", "a b\nc"),
    ],
)
def test_pages_as_they_come(page, text):
    assert html.main_texts([page]) == [text]


def test_long_and_unclosed_pages_take_no_longer_than_their_length():
    for part in ("<svg>", "<svg", "<a href='x", '<a b="', "<!--", "<p", "<object><p>a", "</svg>", "<noscript><svg>", "&amp", "<ul><li>"):
        began = time.time()
        html.main_texts([part * 20_000])
        assert time.time() - began < 10, part


BODY = " ".join(f"word{i}" for i in range(60))


def test_copied_bodies_stay():
    pages = [f"<body><p>{BODY}</p><p>{w} page tail {x}</p></body>" for w, x in (("first", "alpha"), ("second", "beta"))]
    assert html.main_texts(pages) == [f"{BODY}\nfirst page tail alpha", f"{BODY}\nsecond page tail beta"]
    # a body in paragraphs is one as well, a menu as long is none
    parts = [BODY[k : k + 120].strip() for k in range(0, len(BODY), 120)]
    split = ["<body>" + "".join(f"<p>{p}</p>" for p in parts) + f"<p>own {w}</p></body>" for w in "xy"]
    assert html.main_texts(split)[0] == "\n".join([*parts, "own x"])
    menu = ["<body>" + "".join(f"<li>item {i}" for i in range(60)) + f"</li><p>{w} of its own</p></body>" for w in "xy"]
    assert html.main_texts(menu) == ["x of its own", "y of its own"]


def test_passages():
    assert html.passages([True] * 50, [0] * 50) == [(0, 50)] and html.passages([True] * 49, [0] * 49) == []
    assert html.passages([True] * 60, [i // 6 for i in range(60)]) == [] and html.passages([False, *[True] * 55, False], [0] * 57) == [(1, 56)]


def test_reading_grows_with_the_page():
    def seconds(n):
        began = time.perf_counter()
        for page in ("<b>" * n + "</i>" * n, "<b>" * n + "<ul>" * n, "<p>" + "<b>" * n + "<div>" * n, "<b>" * n + "<li>x" * n):
            html.blocks_of(page)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(40_000) < 4 * 4 * seconds(10_000)
