"""Pages to titled sections of typed blocks."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundline.errors import StructureError
from groundline.operators.tree import HEADINGS, Tree, View, norm
from groundline.schemas import SECTION_DDL
from groundline.settings import BOILERPLATE_CLASSES, BOILERPLATE_IDS, DEFAULT, DROP_TAGS, JUNK_TEXTS, Settings

CONTAINERS = ("main", "article", "section", "div", "td", "body")
#: Elements that are read as something else than labels and values.
UNPAIRED = frozenset(("ul", "ol", "dl", "table", *HEADINGS))
# Labels that are numbers are none.
PERCENT_LABEL = re.compile(r"\d+(?:\.\d+)?\s*%")
NUMBER_LABEL = re.compile(r"^[+\-₹$]?\s*\d[\d.,]*\s*%?$")


def title_of(view: View, fallback: str) -> str:
    for tag in ("h1", "title"):
        k = view.tree.first_of(tag)
        if k is not None and (text := view.text(k)):
            return text
    return fallback


def content_root(view: View, settings: Settings = DEFAULT) -> int:
    """The first pinned selector's element with enough text, else the container with most text."""
    tree = view.tree
    for selector in settings.root_selectors:
        k = tree.first(selector)
        if k is not None and view.length(k, raw=True) >= settings.min_root_chars:
            return k
    held = [k for k in range(1, len(tree.tags)) if tree.tags[k] in CONTAINERS]
    best = max(held, key=lambda k: view.length(k, raw=True), default=None)
    if best is not None and view.length(best, raw=True):
        return best
    if tree.first_of("body") is None and view.length(0, raw=True):
        return 0  # a page without a body element has one by implication
    raise StructureError("there is no container with text")


def pills_of(view: View, root: int) -> list[str]:
    """Distinct texts of the links, spans and divs within boxes of pills."""
    tree, inside, spans = view.tree, set(), {}
    for k in view.below(root):
        if tree.parents[k] in inside:
            inside.add(k)
            if tree.tags[k] in ("a", "span", "div"):
                spans.setdefault(view.span(k), k)
        if "pills_container" in tree.attributes[k].get("class", ""):
            inside.add(k)
    return list(dict.fromkeys(t for t in map(view.text, spans.values()) if t))


def boilerplate(tree: Tree, first: int, end: int) -> list[int]:
    """Elements that go: those of a class or an id that says so, then those of a tag that does and those with nothing but a junk phrase."""
    named = [k for k in range(first, end) if any(c in tree.attributes[k].get("class", "") for c in BOILERPLATE_CLASSES) or any(i in tree.attributes[k].get("id", "") for i in BOILERPLATE_IDS)]
    view, longest = View(tree, named), max(map(len, JUNK_TEXTS))
    rest = [k for k in range(first, end) if not view.dead[k] and (tree.tags[k] in DROP_TAGS or (view.length(k) <= longest and view.text(k).lower() in JUNK_TEXTS))]
    return named + rest


def clean_html(markup: str) -> str:
    """Markup without boilerplate and comments, white space single."""
    tree = Tree(markup)
    return View(tree, boilerplate(tree, 1, len(tree.tags))).markup()


class Page:
    """What is read below an element of a page without its boilerplate."""

    def __init__(self, view: View, root: int, settings: Settings) -> None:
        self.view, self.tree, self.settings = view, view.tree, settings
        self.titles = HEADINGS[: settings.max_heading_level]
        self._find_pairs(root)

    def _find_pairs(self, root: int) -> None:
        """From the innermost elements outwards: which hold one label and its value, and which hold nothing but such elements."""
        view, tree = self.view, self.tree
        self.pair: dict[int, tuple[int, int]] = {}
        self.paired = bytearray(len(tree.tags))
        for k in range(tree.ends[root] - 1, root - 1, -1):
            kids = view.kids[k]
            if view.dead[k] or len(kids) < 2 or tree.tags[k] in UNPAIRED or view.headed(k):
                continue
            if len(kids) == 2 and not any(len(view.kids[c]) > 1 for c in kids) and self.labels(kids[0]) and self.says(*kids):
                self.pair[k] = tuple(kids)
            self.paired[k] = k in self.pair or all(self.paired[c] for c in kids)

    def labels(self, k: int) -> bool:
        """Can this element's text be a label: short, and no number unless a colon follows it?"""
        if not 0 < self.view.length(k) <= self.settings.kv_label_chars:
            return False
        text = self.view.text(k)
        return ":" in text or not (NUMBER_LABEL.match(text) or PERCENT_LABEL.search(text))

    def says(self, label: int, value: int) -> bool:
        """Is there a value, and is one of both no control?"""
        pressed = [bool(set(self.settings.interactive_classes).intersection(self.tree.classes(k))) for k in (label, value)]
        return self.view.length(value) > 0 and not all(pressed)

    def pairs(self, k: int) -> str:
        """The labels and values within an element, a line for each."""
        lines, end = [], self.tree.ends[k]
        while k < end:
            if k in self.pair:
                name, said = map(self.view.text, self.pair[k])
                lines.append(f"{name} {said}" if ":" in name else f"{name}: {said}")
                k = self.tree.ends[k]
            else:
                k += 1
        return "\n".join(lines)

    def rows(self, table: int) -> list[list[str]]:
        """Cells of the rows that belong to this table and not to one within it; blank rows are left out."""
        tree, view, rows = self.tree, self.view, []
        k = table + 1
        while k < tree.ends[table]:
            if view.dead[k] or tree.tags[k] == "table":
                k = tree.ends[k]
                continue
            if tree.tags[k] == "tr":
                cells = [c for c in view.kids[k] if tree.tags[c] in ("th", "td")] or [c for c in view.below(k) if tree.tags[c] in ("th", "td")]
                rows.append([view.text(c).replace("|", "\\|") for c in cells])
            k += 1
        return [r for r in rows if any(r)]

    def table(self, k: int) -> str:
        rows = self.rows(k)
        if not rows:
            raise StructureError("a table has no text")
        width = max(map(len, rows))
        line = lambda cells: f"| {' | '.join(cells)} |"
        header, *body = [r + [""] * (width - len(r)) for r in rows]
        # a table of a header alone has one line without cells
        return "\n".join([line(header), line(["---"] * width), *(map(line, body) if body else [line([])])])

    def items(self, k: int) -> str:
        items = [t for t in (self.view.text(c) for c in self.view.kids[k] if self.tree.tags[c] == "li") if t]
        if not items:
            raise StructureError(f"a {self.tree.tags[k]} has no items with text")
        return "\n".join(f"- {t}" for t in items)

    def kind(self, k: int) -> str:
        """What an element is to a reader: a heading, a block of some kind, words, or a holder of others."""
        tag = self.tree.tags[k]
        if tag in self.titles:
            return "holder" if self.view.headed(k) else "heading"
        if tag == "table":
            return "table"
        if tag in ("ul", "ol", "dl"):
            return "list"
        return "keyvalue" if self.paired[k] else "holder" if self.view.kids[k] else "words"

    def pieces(self, root: int) -> Iterator[tuple[str, str, int]]:
        """Kind, text and level of all that is read, in document order."""
        tree, place = self.tree, self.tree.at[root]
        read = {"table": self.table, "list": self.items, "keyvalue": self.pairs}
        while place < tree.done[root]:
            e = tree.events[place]
            place += 1
            if e < 0:
                if text := norm(tree.texts[-1 - e]):
                    yield "words", text, 0
                continue
            kind = "nothing" if self.view.dead[e] else self.kind(e)
            if kind == "holder":
                continue
            place = tree.done[e]
            if kind == "heading":
                yield kind, self.view.text(e), int(tree.tags[e][1])
            elif kind in read:
                yield kind, read[kind](e), 0
            elif kind == "words" and (text := self.view.text(e)):
                yield kind, text, 0


def paths_of(headings: list[tuple[str, int]], tree: bool) -> Iterator[list[str]]:
    """The path of each heading (text and level): itself alone, or with `tree` the headings above it."""
    path: list[str] = []
    for text, level in headings:
        path = [*path[: level - 1], text] if tree else [text]
        yield path


def sections_of(page: Page, root: int) -> list[dict]:
    """Sections below an element: what stands before the first heading belongs to the overview; neighbouring words are one text."""
    settings, pieces = page.settings, list(page.pieces(root))
    starts = [k for k, p in enumerate(pieces) if p[0] == "heading"]
    names = [(pieces[k][1], pieces[k][2]) for k in starts]
    own = zip(starts, [*starts[1:], len(pieces)], names, paths_of(names, settings.heading_path_mode == "tree"), strict=False)
    parts = [(name, level, path, pieces[a + 1 : b]) for a, b, (name, level), path in own]
    lead = pieces[: starts[0]] if starts else pieces
    if lead:
        parts.insert(0, (settings.overview_heading, 0, [settings.overview_heading], lead))
    out = []
    for name, level, path, held in parts:
        blocks = []
        for kind, run in itertools.groupby(held, key=lambda p: p[0]):
            texts = [t for _, t, _ in run]
            blocks += [{"kind": "text", "text": norm(" ".join(texts))}] if kind == "words" else [{"kind": kind, "text": t} for t in texts]
        out.append({"heading": name, "level": level, "heading_path": path, "blocks": [b for b in blocks if b["text"].strip()]})
    return out


def read_page(markup: str, fallback: str = "", settings: Settings = DEFAULT) -> tuple[str, list[dict]]:
    """Title and sections of a page; sections without blocks are left out, and pills stand first in the overview."""
    tree = Tree(markup)
    raw = View(tree)
    title, root = title_of(raw, fallback), content_root(raw, settings)
    pills = pills_of(raw, root)
    page = Page(View(tree, boilerplate(tree, root, tree.ends[root])), root, settings)
    overview = settings.overview_heading
    sections = [s for s in sections_of(page, root) if s["blocks"] or s["heading"] == overview]
    if pills:
        risk = re.compile(settings.risk_pattern)
        if not any(s["heading"] == overview for s in sections):
            sections.insert(0, {"heading": overview, "level": 0, "heading_path": [overview], "blocks": []})
        first = next(s for s in sections if s["heading"] == overview)
        first["blocks"] = [{"kind": "keyvalue", "text": f"{settings.risk_label}: {p}"} if risk.search(p) else {"kind": "text", "text": p} for p in pills] + first["blocks"]
    return title, sections


def documents(pages: DataFrame, settings: Settings = DEFAULT, strict: bool = False) -> DataFrame:
    """Pages (url, html, and scheme, scheme_name, category, fetched_at if there) to documents with sections and parse_error.

    A page that cannot be read gives a row with its error, or with `strict` stops the job.
    """
    import pandas as pd

    names = ("scheme", "scheme_name", "category", "fetched_at")
    rows = pages.select("url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), *[(F.coalesce(F.col(n).cast("string"), F.lit("")) if n in pages.columns else F.lit("")).alias(n) for n in names])
    ddl = f"doc_id string, title string, scheme string, scheme_name string, category string, source_url string, fetched_at string, sections {SECTION_DDL}, parse_error string"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                try:
                    title, sections, error = *read_page(r.html, r.scheme_name, settings), None
                except StructureError as e:
                    if strict:
                        raise
                    title, sections, error = r.scheme_name, [], str(e)
                out.append((hashlib.sha1((r.url or "").encode()).hexdigest()[:12], title, r.scheme, r.scheme_name, r.category, r.url, r.fetched_at, sections, error))
            yield pd.DataFrame(out, columns=["doc_id", "title", "scheme", "scheme_name", "category", "source_url", "fetched_at", "sections", "parse_error"])

    return rows.mapInPandas(run, ddl)


def blocks(docs: DataFrame) -> DataFrame:
    """A row for each block with the places of section and block."""
    sections = docs.select("doc_id", "scheme", "source_url", F.posexplode("sections").alias("section_pos", "s"))
    return sections.select("doc_id", "scheme", "source_url", "section_pos", F.col("s.heading").alias("heading"), F.col("s.level").alias("level"), F.col("s.heading_path").alias("heading_path"), F.posexplode("s.blocks").alias("block_pos", "b")).select("*", "b.kind", "b.text").drop("b")


def parse_summary(docs: DataFrame) -> DataFrame:
    """Sections, blocks of each kind and characters by scheme, with a row for all (scheme null)."""
    sections = docs.select("scheme", F.explode_outer("sections").alias("s"))

    def count(kind: str) -> Column:
        return F.sum(F.coalesce(F.size(F.filter("s.blocks", lambda b: b["kind"] == kind)), F.lit(0))).alias(kind)

    counts = [count(k) for k in ("text", "table", "list", "keyvalue")]
    chars = F.sum(F.coalesce(F.aggregate("s.blocks", F.lit(0), lambda n, b: n + F.length(b["text"])), F.lit(0))).alias("chars")
    return sections.rollup("scheme").agg(F.count("s").alias("sections"), *counts, chars)


def fetch_summary(fetched: DataFrame) -> DataFrame:
    """Pages and bytes by scheme, with a row for all (scheme null)."""
    return fetched.rollup("scheme").agg(F.count("*").alias("pages"), F.sum("n_bytes").alias("n_bytes"))
