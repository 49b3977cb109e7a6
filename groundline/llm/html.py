"""Main text of web pages, by suffix arrays over the token streams of a host's pages.

A page is read into blocks; each has a role: of an explicit article, of boilerplate by its element (menus, headers,
footers, sidebars, notices, adverts, forms, comments), or open.

1. In each slice of a partition the token streams of all blocks outside articles are concatenated, tokens of different hosts being
   different; a suffix array over them, with common prefixes, gives every substring of `min_tokens` and the pages that hold it.
   It goes on as a 64-bit key of host and tokens with the least and the greatest page that has it, and an aggregation by
   key finds those of two distinct pages: wherever the pages lie and however many a host has.  A longer repeat is covered by
   the repeats of `min_tokens` within it, so no length is missed.
2. Tokens that repeats cover are removed from open blocks, and their unique runs are kept.  A covered stretch of PASSAGE_TOKENS or more whose blocks
   are prose is a copy of some text, which pages without marked articles share as well, and stays.
3. A check of the roles follows: unique runs in boilerplate elements go (an advert may be shown once), and articles that a page
   marks as such stay whole, as copies and quotations repeat what articles say.

Repeated keys go to every worker as one sorted array if there are few (`most_bytes`); else each page is joined with those of its
own keys that repeat.  Both give the same.

Defined results: a null html counts as empty and gives an empty text; a null or hostless url belongs to the host ""; repeated rows each give
a row, and pages of equal html count as one page; other columns are ignored; an empty table gives no rows.  A tag whose quote never
closes ends at its first ">"; an svg, math, object, canvas, template or noscript element without its end tag is no element.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.llm import common
from groundline.llm.neardup import mixed

MIN_TOKENS = 6
#: Repeated keys are sent to workers up to this size.
MOST_BYTES = 32 << 20
#: A repeat this long, in blocks of so many tokens on average, is a copied or quoted passage and stays.
PASSAGE_TOKENS, PROSE_TOKENS = 50, 10
ARTICLE, OPEN, BOILERPLATE = 0, 1, 2

# Elements of HTML by what they are here.
RAW = {"script", "style", "iframe", "textarea", "title", "xmp"}
NESTED = {"svg", "math", "object", "canvas", "template", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "main", "section", "div", "body"}
CONTAINERS = {"article", "div", "dl", "ol", "section", "table", "ul"}
NAMES = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "footer", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promotion", "related", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ARTICLE = re.compile(r"<article[\s/>]", re.I)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    """By its element or role, or by a class name or id: outside articles by a word of it, within them by the whole name, of containers alone."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    for name, *values in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        name, words = name.lower(), "".join(values).lower().split()
        if name == "role" and ROLES.intersection(words):
            return True
        if name in ("class", "id") and (tag in CONTAINERS if in_article else True):
            if NAMES.intersection(words if in_article else re.split(r"[^a-z]+", " ".join(words))):
                return True
    return False


class Ends:
    """Where elements that may be nested end, found by one pass over the tags of a name."""

    def __init__(self, page: str):
        self.page, self.of = page, {}

    def after(self, tag: str, at: int) -> int | None:
        """The place behind the end tag of the element whose start tag ends at `at`, or None if it has none."""
        if tag not in self.of:
            found, open_ = {}, []
            for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*(>|\Z)", self.page, re.I):
                if not m[1]:
                    if not m[0].endswith("/>"):
                        open_.append(m.end())
                elif open_:
                    found[open_.pop()] = m.end()
            self.of[tag] = found
        return self.of[tag].get(at)


class Opened:
    """The stack of open elements with the roles that they began, and by name how deep each one lies: no search walks through the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = []
        self.depths: dict[str, list[int]] = {}

    def add(self, tag: str, role: int) -> None:
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, role))

    def last(self, tags: Iterable[str]) -> int:
        """The depth of the innermost of these, or -1."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=-1)

    def cut(self, depth: int) -> None:
        """The element at a depth ends, and so does all within it; -1 is none."""
        while 0 <= depth < len(self.stack):
            self.depths[self.stack.pop()[0]].pop()

    @property
    def role(self) -> int:
        return self.stack[-1][1] if self.stack else OPEN


def blocks_of(page: str) -> list[tuple[int, str]]:
    """Role and text of each block in page order; references decoded, white space single."""
    out: list[tuple[int, str]] = []
    opened = Opened()
    role, parts, at, end = OPEN, [], 0, len(page)
    ends, article = Ends(page), {"article"} if _ARTICLE.search(page) else {"main"}

    def flush() -> None:
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                out.append((role, text))
            parts.clear()

    while at < end and (m := _TOKEN.match(page, at)):
        at = m.end()
        close, tag, rest = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                parts.append(text)
            continue
        tag = tag.lower()
        if close:
            if tag in BLOCKS or tag in DROPPED:
                flush()
            if (depth := opened.last((tag,))) >= 0:
                opened.cut(depth)
                if opened.role != role:
                    flush()
                    role = opened.role
            continue
        if tag in RAW:
            # raw content ends at its own end tag alone
            last = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = last.end() if last else end
            continue
        if tag in NESTED:
            at = ends.after(tag, at) or at
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS or tag in DROPPED:
            flush()
            # a block ends an open paragraph and what stands open in it
            for ended in (("p",) if tag in BLOCKS else (), CLOSED_BY.get(tag, ())):
                if (depth := opened.last(ended)) > opened.last(SCOPES):
                    opened.cut(depth)
            role = opened.role
        if tag in VOID or rest.endswith("/") and tag not in BLOCKS:
            continue
        now = role
        if role != BOILERPLATE:
            if is_boilerplate(tag, rest, role == ARTICLE):
                now = BOILERPLATE
            elif tag in article:
                now = ARTICLE
        if now != role:
            flush()
            role = now
        opened.add(tag, role)
    flush()
    return out


def streams_of(blocks: list[tuple[int, str]]) -> list[tuple[list[str], list[int]]]:
    """Stretches between articles: their tokens, and the block that each token is of."""
    out: list[tuple[list[str], list[int]]] = [([], [])]
    for i, (role, text) in enumerate(blocks):
        if role == ARTICLE:
            if out[-1][0]:
                out.append(([], []))
            continue
        tokens = text.split(" ")
        out[-1][0].extend(tokens)
        out[-1][1].extend([i] * len(tokens))
    return [s for s in out if s[0]]


def suffix_array(tokens):
    """Suffixes in order, by prefix doubling, and the ranks of all prefixes of 1, 2, 4 ... tokens."""
    import numpy as np

    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank], 1
    order = np.argsort(rank, kind="stable")
    while width < n and rank.max() < n - 1:
        after = np.full(n, -1, np.int64)
        after[:-width] = rank[width:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        steps = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = steps
        ranks.append(rank)
        width *= 2
    return order, ranks


def common_prefixes(order, ranks):
    """Length of the common prefix of each suffix in order and the one before it (0 for the first)."""
    import numpy as np

    n = len(order)
    a, b, length = order[:-1].copy(), order[1:].copy(), np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        step = np.where(same, 1 << k, 0)
        a, b, length = a + step, b + step, length + step
    return np.concatenate(([0], length))


class Slice:
    """Streams of some pages end to end, a separator of its own after each, so that no substring reaches over one."""

    def __init__(self, pages: list[tuple[str, int, list[list[str]]]]):
        """pages: host, page and streams."""
        import xxhash

        number: dict[tuple[str, str], int] = {}
        flat: list[int] = []
        self.begins: list[int] = []
        owners, lengths = [], []
        for host, page, streams in pages:
            for stream in streams:
                self.begins.append(len(flat))
                flat += [number.setdefault((host, t), len(number)) for t in stream]
                flat.append(-1 - len(owners))
                owners.append(page)
                lengths.append(len(stream) + 1)
        self.tokens = np.asarray(flat, np.int64)
        self.page = np.repeat(np.asarray(owners, np.int64), lengths)
        left = np.asarray([h for n in lengths for h in range(n - 1, -1, -1)], np.int64) if lengths else np.zeros(0, np.int64)
        self.left = left  # tokens from each place to its stream's end
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"), seed=xxhash.xxh32_intdigest(h.encode("utf-8", "surrogatepass"))) for h, t in number), np.uint64, len(number))

    def keys(self, places: np.ndarray, width: int) -> np.ndarray:
        """Keys of the substrings of `width` tokens at these places."""
        out = np.full(len(places), width, np.uint64)
        for k in range(width if len(places) else 0):
            out = mixed(out * _GOLD + self.hashes[self.tokens[places + k]])
        return out.view(np.int64)

    def found(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each substring of `width` tokens once: its key, and the least and the greatest page that has it."""
        n = len(self.tokens)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        order, ranks = suffix_array(self.tokens)
        group = np.cumsum(common_prefixes(order, ranks) < width) - 1
        whole = self.left[order] >= width
        order, group = order[whole], group[whole]
        if not len(order):
            return (np.zeros(0, np.int64),) * 3
        first = np.flatnonzero(np.diff(group, prepend=-1))
        page = self.page[order]
        return self.keys(order[first], width), np.minimum.reduceat(page, first), np.maximum.reduceat(page, first)

    def covered(self, repeated, width: int) -> np.ndarray:
        """Which tokens lie in a substring of `width` tokens whose key `repeated` (keys to booleans) says repeats."""
        marks = np.zeros(len(self.tokens) + 1, np.int64)
        places = np.flatnonzero(self.left >= width)
        if len(places):
            starts = places[repeated(self.keys(places, width))]
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + width, -1)
        return np.cumsum(marks)[:-1] > 0


def among(keys: np.ndarray) -> object:
    """Are values among these sorted keys?"""

    def test(values: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(values), bool)
        return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values

    return test


def passages(hit: list[bool], blocks: list[int]) -> list[tuple[int, int]]:
    """Stretches of repeated tokens that are no boilerplate: long, and in blocks that are prose and not the items of a menu."""
    out, start = [], 0
    while start < len(hit):
        end = start + 1
        while end < len(hit) and hit[end] == hit[start]:
            end += 1
        if hit[start] and end - start >= max(PASSAGE_TOKENS, PROSE_TOKENS * len(set(blocks[start:end]))):
            out.append((start, end))
        start = end
    return out


def texts_of(pages: list[tuple[str, str]], repeated, width: int = MIN_TOKENS) -> list[str]:
    """Main texts of pages (host and html); `repeated` gets the keys of a page, and its number."""
    read = [blocks_of(html) for _, html in pages]
    # streams without an open block decide nothing
    streams = [[s for s in streams_of(blocks) if any(blocks[i][0] == OPEN for i in s[1])] for blocks in read]
    out = []
    for n, ((host, _), blocks, own) in enumerate(zip(pages, read, streams, strict=True)):
        kept: dict[int, list[str]] = {}
        if own:
            one = Slice([(host, n, [s[0] for s in own])])
            hit = one.covered(lambda keys, n=n: repeated(keys, n), width)
            for begin, (tokens, block) in zip(one.begins, own, strict=True):
                own_hit = hit[begin : begin + len(tokens)].tolist()
                for a, b in passages(own_hit, block):
                    own_hit[a:b] = [False] * (b - a)
                for token, i, h in zip(tokens, block, own_hit, strict=True):
                    if not h:
                        kept.setdefault(i, []).append(token)
        texts = (text if role == ARTICLE else " ".join(kept.get(i, ())) if role == OPEN else "" for i, (role, text) in enumerate(blocks))
        out.append("\n".join(t for t in texts if t))
    return out


def main_texts(pages: list[str], width: int = MIN_TOKENS) -> list[str]:
    """Main texts of some pages of one host, at hand."""
    import xxhash

    own = {xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) >> 1: p for p in pages}
    keys, low, high = Slice([("", k, [s[0] for s in streams_of(blocks_of(p))]) for k, p in own.items()]).found(width)
    every = among(np.sort(keys[low < high]))
    return texts_of([("", p) for p in pages], lambda keys, n: every(keys), width)


def prepared(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, host, and page: the hash of html, by which equal pages are one."""
    url = F.col("url")
    host = F.when(F.instr(url, "://") > 0, F.lower(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1))).otherwise("")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    return rows.withColumns({"host": F.coalesce(host, F.lit("")), "page": F.xxhash64("html")})


def repeats(rows: DataFrame, width: int = MIN_TOKENS) -> DataFrame:
    """key: substrings of `width` tokens that two distinct pages of a host hold outside articles."""
    out = common.arrow_schema(ddl := "key long, low long, high long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "html"):
            seen: dict[tuple[str, int], list[list[str]]] = {}
            for host, page, html in zip(*(b.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                if (host, page) not in seen:
                    seen[host, page] = [s[0] for s in streams_of(blocks_of(html))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in Slice([(h, p, s) for (h, p), s in seen.items()]).found(width)], schema=out)

    found = rows.select("host", "page", "html").mapInArrow(run, ddl)
    return found.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("key")


def asked_keys(rows: DataFrame, width: int) -> DataFrame:
    """host, page and key for each substring outside articles of a page that has an open block."""
    out = common.arrow_schema(ddl := "host string, page long, key long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "html"):
            for host, page, html in {x[:2]: x for x in zip(*(b.column(c).to_pylist() for c in ("host", "page", "html")), strict=True)}.values():
                blocks = blocks_of(html)
                own = [s[0] for s in streams_of(blocks) if any(blocks[i][0] == OPEN for i in s[1])]
                if own:
                    one = Slice([(host, page, own)])
                    keys = np.unique(one.keys(np.flatnonzero(one.left >= width), width))
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(keys), pa.string()), pa.array(np.full(len(keys), page)), pa.array(keys)], schema=out)

    return rows.select("host", "page", "html").mapInArrow(run, ddl).distinct()


def extract(pages: DataFrame, min_tokens: int = MIN_TOKENS, most_bytes: int = MOST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row."""
    rows = prepared(pages, id_col, url_col, html_col)
    found = common.materialize(repeats(rows, min_tokens), "repeats")
    few = 8 * found.count() <= most_bytes
    out = common.arrow_schema(ddl := "page_id long, url string, text string, n_chars long")
    if few:
        keys = np.sort(np.asarray([r["key"] for r in found.toLocalIterator()], np.int64))
        sent = rows.sparkSession.sparkContext.broadcast(keys.tobytes())
    else:
        own = asked_keys(rows, min_tokens).join(found, "key").groupBy("host", "page").agg(F.collect_list("key").alias("keys"))
        rows = rows.join(own, ["host", "page"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = among(np.frombuffer(sent.value, np.int64)) if few else None
        for b in common.slices(batches, "html"):
            lists = None if few else b.column("keys").to_pylist()
            repeated = (lambda keys, n: every(keys)) if few else (lambda keys, n, lists=lists: among(np.sort(np.asarray(lists[n] or [], np.int64)))(keys))
            texts = texts_of(list(zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True)), repeated, min_tokens)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=out)

    return rows.select("page_id", "url", "host", "html", *([] if few else ["keys"])).mapInArrow(run, ddl)
