import random

import pytest
from pyspark.sql import functions as F

from groundline.errors import ChunkInvariantError, StructureError
from groundline.functions import text as tx
from groundline.functions import vectors as vx
from groundline.operators import chunks, pages
from groundline.settings import Settings

PAGE = """<html><head><title>T</title></head><body><nav>menu</nav><h1>Fund <b>A</b></h1><p>One<p>Two
<div class="row"><div>NAV</div><div>12.5</div></div><div><span>5%</span><span>x</span></div>
<h2>Load</h2><table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr><tr><td></td></tr></table><ul><li>x<li> y </ul>
<h6>small</h6><div class="cookie-bar">eat</div><p>See all</p><!-- note --><script>var a="</p>"</script>
<div class="pills_container_x"><span>High Risk</span><a>Equity</a><span>Equity</span></div></body></html>"""


def test_reads_sections_and_blocks():
    title, sections = pages.read_page(PAGE)
    assert title == "Fund A"
    by = {s["heading"]: s for s in sections}
    assert [s["heading"] for s in sections] == ["Fund overview", "Fund A", "Load"]
    assert by["Fund overview"]["blocks"] == [{"kind": "keyvalue", "text": "Riskometer level: High Risk"}, {"kind": "text", "text": "Equity"}]
    assert by["Fund A"]["blocks"] == [{"kind": "text", "text": "One Two"}, {"kind": "keyvalue", "text": "NAV: 12.5"}, {"kind": "text", "text": "5% x"}]
    assert by["Load"]["blocks"][0] == {"kind": "table", "text": "| a | b\\|c |\n| --- | --- |\n| 1 |  |"}
    assert by["Load"]["blocks"][1] == {"kind": "list", "text": "- x\n- y"}
    assert by["Load"]["blocks"][2]["text"].startswith("small")


def test_clean_html():
    got = pages.clean_html('<body><nav>x</nav><p class="a&quot;b">a  &amp;\n b<!-- c --><br></p><div>Got it</div></body>')
    assert got == '<body><p class="a&quot;b">a &amp; b<br></p></body>'


def test_root_by_selector_and_tree_paths():
    page = f"<body><div>out</div><main><h1>A</h1><p>{'w ' * 120}</p><h3>C</h3><p>c</p></main></body>"
    _, sections = pages.read_page(page, settings=Settings(heading_path_mode="tree"))
    assert [s["heading_path"] for s in sections] == [["A"], ["A", "C"]]
    assert all("out" not in b["text"] for s in sections for b in s["blocks"])


def test_references_without_a_semicolon_are_text():
    title, sections = pages.read_page("<h1>a&amp;&quot;b&amp</h1><p>&eacute; &#233 &#xe9; &notit; &amp;amp; &copy 1</p>")
    assert title == 'a&"b&amp' and sections[0]["blocks"][0]["text"] == "é é é &notit; &amp; &copy 1"


def test_errors_become_rows(spark):
    rows = spark.createDataFrame([("u1", "<body><dl><dt>a</dt></dl></body>"), ("u2", None), ("u3", "<body>plain</body>")], "url string, html string")
    got = {r["source_url"]: r["parse_error"] for r in pages.documents(rows).collect()}
    assert got["u1"] and got["u2"] and got["u3"] is None
    with pytest.raises(StructureError):
        pages.read_page("")


def test_recursive_split_keeps_text_and_size():
    r = random.Random(3)
    for _ in range(60):
        text = "".join(r.choice(["word ", "a. ", "\n", "\n\n", "x" * 30 + " ", "β? "]) for _ in range(r.randint(0, 200)))
        out = chunks.recursive_split(text, 20, 5)
        assert all(chunks.count_tokens(p) <= 20 for p in out)
        assert not text.strip() or out
        kept = chunks.recursive_split(text, 20, 0)
        assert "".join("".join(kept).split()) == "".join(text.split())


def test_hard_split_and_overlap():
    assert chunks.hard_split("a b c d e", 2) == ["a b ", "c d ", "e"]
    out = chunks.recursive_split("a b c d e f", 3, 1)
    assert out == ["a b c", "c d e", "e f"]
    assert chunks.recursive_split("  ", 3, 1) == []


def test_split_table():
    text = "| h |\n| --- |\n" + "\n".join(f"| row {i} |" for i in range(10))
    out = chunks.split_table(text, 30)
    assert len(out) > 1 and all(p.startswith("| h |\n| --- |") and chunks.count_tokens(p) <= 30 for p in out)
    with pytest.raises(ChunkInvariantError):
        chunks.split_table("| h |\n| --- |\n| " + "w " * 50 + "|", 20)


def test_split_on(spark):
    rows = spark.createDataFrame([("a. b.  . c",), ("none",), ("x\n\n\ny",)], "t string")
    assert [r[0] for r in rows.select(chunks.split_on(F.col("t"), ". ")).collect()][0] == ["a. ", "b. ", " . ", "c"]
    assert rows.select(chunks.split_on(F.col("t"), ". ")).collect()[1][0] == ["none"]


def test_chunk_documents_and_invariants(spark):
    section = [("A", 1, ["A"], [("text", "w " * 700), ("text", "tail"), ("table", "| h |\n| --- |\n| 1 |")]), ("B", 2, ["A", "B"], [("list", "- x")])]
    ddl = "doc_id string, scheme string, scheme_name string, category string, source_url string, fetched_at string, sections array<struct<heading:string,level:int,heading_path:array<string>,blocks:array<struct<kind:string,text:string>>>>"
    docs = spark.createDataFrame([("d", "s", "S", "c", "https://e.com/x", "2024", section)], ddl)
    out = chunks.chunk_documents(docs).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in out] == list(range(len(out))) and len(out) == 4
    assert all(r["n_tokens"] <= 512 for r in out) and out[-1]["text"] == "A > B\n- x" and out[2]["block_types"] == "table"
    frame = chunks.chunk_documents(docs)
    assert frame.transform(chunks.violations).isEmpty()
    bad = frame.withColumn("n_tokens", F.lit(900)).withColumn("scheme", F.lit("a|b"))
    assert {r["rule"] for r in chunks.violations(bad).collect()} == {"tokens", "scheme"}
    with pytest.raises(ChunkInvariantError):
        chunks.assert_invariants(bad)
    table = frame.withColumn("text", F.lit("| a | b |\n| c |"))
    assert "table" in {r["rule"] for r in chunks.violations(table).collect()}


def test_chunks_of_a_document_stay_in_its_row(spark, tmp_path):
    from groundline import catalog_corpus

    text = "\n".join("w" * (k % 7 + 1) + "-" for k in range(6000))
    spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one " * 19)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, n in (("chunk_packs", 1), ("chunk_tables", 1), ("chunk_windows", 0)):
        frame = getattr(catalog_corpus, name)(spark, str(tmp_path))
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == n and "Join" not in plan and "Window" not in plan, name
        found = frame.orderBy("doc_id", "ordinal").collect()
        own = [r["ordinal"] for r in found if r["doc_id"] == 1]
        assert own == list(range(len(own))) and len(own) > 1 and not {2, 3} & {r["doc_id"] for r in found}


def test_tokens_of_parts():
    r = random.Random(8)
    for _ in range(300):
        text = "".join(r.choice(["ab", "_9", " ", "\n", "é", "-", "\u00a0", "\ud800", "\x1c"]) for _ in range(r.randint(0, 30)))
        tokens = chunks.Tokens(text)
        a, b = sorted(r.randint(0, len(text)) for _ in range(2))
        assert tokens.count(a, b) == chunks.count_tokens(text[a:b])
        whole = [text[x:y] for x, y in zip(tokens.cuts(a, b, 3), tokens.cuts(a, b, 3)[1:])]
        assert "".join(whole) == text[a:b] and all(chunks.count_tokens(w) <= 3 for w in whole)


def test_tokens_are_counted_as_the_pattern_does_without_a_string_for_each():
    import re
    import tracemalloc

    pattern = re.compile(tx.TOKEN, re.ASCII)
    every = [chr(c) for c in [*range(0x250), 0x1680, 0x2028, 0x3000, 0xD800, 0xFEFF, 0x1F600]]
    r = random.Random(9)
    for text in ["", *every, *("".join(r.choice(every[:140]) for _ in range(r.randint(0, 40))) for _ in range(2000))]:
        assert chunks.count_tokens(text) == len(pattern.findall(text)) == chunks.Tokens(text).count(0, len(text))
    assert chunks.count_tokens(None) == 0
    text = "ab, " * 300_000
    tracemalloc.start()
    assert chunks.count_tokens(text) == 600_000
    assert tracemalloc.get_traced_memory()[1] < 4 * len(text)
    tracemalloc.stop()


def test_nearest_rank(spark):
    for n in (1, 2, 7, 20, 33):
        got = spark.range(1, n + 1).agg(vx.nearest_rank("id", 85).alias("v")).first()["v"]
        assert got == -(-85 * n // 100)


def test_semantic_split():
    vectors = {"A a.": [1, 0], "A b.": [1, 0], "B c.": [0, 1], "B d.": [0, 1]}
    got = chunks.semantic_split("A a. A b. B c. B d.", lambda xs: [vectors[x] for x in xs])
    assert got == ["A a. A b.", "B c. B d."]


def test_split_table_drops_blank_lines_and_cuts_greedily():
    head = "| h |\n| --- |"
    assert chunks.split_table(f"{head}\n\n| a |\n \n| b |", 100) == [f"{head}\n| a |\n| b |"]
    assert chunks.split_table(" \n ", 10) == [] and chunks.split_table("one\n\ntwo", 1) == ["one\n\ntwo"]
    r = random.Random(4)
    for _ in range(50):
        rows = ["| " + "w " * r.randint(1, 9) + "|" for _ in range(r.randint(1, 30))]
        out = chunks.split_table("\n".join([head, *rows]), 26)
        assert [x for p in out for x in p.split("\n")[2:]] == rows
        cost = lambda lines: chunks.count_tokens(head) + sum(chunks.count_tokens(x) + 1 for x in lines)
        parts = [p.split("\n")[2:] for p in out]
        assert all(cost(p) <= 26 for p in parts) and all(cost([*a, b[0]]) > 26 for a, b in zip(parts, parts[1:]))


SHAPES = {"bold": "<b>", "stray ends": "</i>", "nested": "<div>x", "tables": "<table><tr><td>t", "quotes": '<a x="', "lists after bold": "<ul><li>x", "headings": "<h1>y"}


def test_reading_grows_with_the_page():
    import time

    def seconds(n):
        began = time.perf_counter()
        for shape in SHAPES.values():
            pages.read_page("<body>text" + "<b>" * n + shape * n)
        pages.read_page("<body>" + "<div><span>a</span><span>b</span></div>" * n)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 4 * 4 * seconds(4_000)


def test_intervals_of_elements():
    from groundline.operators.tree import Tree, View

    tree = Tree("<body><p>a <b>b</b><p>c<ul><li>d<li>e</ul>f")
    names = dict(enumerate(tree.tags))
    assert [names[k] for k in range(1, len(tree.tags))] == ["body", "p", "b", "p", "ul", "li", "li"]
    inside = {k: [x for x in range(len(tree.tags)) if k < x < tree.ends[k]] for k in range(len(tree.tags))}
    for k, below in inside.items():
        assert all(tree.at[k] < tree.at[x] and tree.done[x] <= tree.done[k] for x in below)
    view = View(tree, [3])
    assert view.text(2) == "a" and view.text(0) == "a c d e f" and view.length(0) == 9 and view.dead[3]
    assert View(Tree("<p>a  b <script>1 &lt; 2</script></p>")).markup() == "<p>a b <script>1 &lt; 2</script></p>"
    assert Tree("<div class='container'><div class=row><p><div class='col-md-8 x'>t").first("div.container div.row div.col-md-8") == 4
