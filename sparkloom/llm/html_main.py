"""HTML extraction (6): the main text of pages, by nearest-URL page differencing over lines whose zone the markup gives.

A scanner over the whole markup, once for each page, gives its lines (blocks of text) with a zone: main, in an article or main
element; loose, in a container with a class or id of its own within these; open, in neither; or furniture, in elements that the
standard has for menus, headers, footers, sidebars and forms, or with a role or a whole class name of that meaning. Scripts,
styles and hidden elements have no lines.

All pages are then differenced, whole, as rows of line hashes. Pages of one host with the same lines are one class; classes are
ordered by URL path and each is paired with its nearest neighbour on either side; the lines of a pair are aligned by a longest
common subsequence. Shared lines are templates and are deleted: open lines, of which what is left is the main text of a page
without an article, and loose lines. Lines that lie in paragraphs, headings, lists, quotations or tables of a marked article are
its text even if a neighbour has them too, as articles quote and repeat each other, and nothing else of an article may be
dropped; there the markup decides. Open lines of a page with a marked article aren't part of it, shared or not.

The order over hosts is a range sort with a global rank, so a host of any size is spread over tasks, and a class meets two others;
what is sorted and paired is hashes of lines, not text.

Defined cases: a null or empty html has an empty text; cut-off markup is read as far as it goes; equal pages on one host are
differenced as one; a page without a neighbour shares nothing; repeated rows are pages each; null URLs are of one host, without a
name; long pages take time in proportion to their length, their alignment to that of both over 64; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plan import join_skewed, running, stored

#: quotes only count behind an equals sign, as elsewhere they are part of a name or value
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=)*)(?:>|\Z)", re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: text of these is never shown
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "textarea", "title", "xmp", "noframes", "noembed"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "label", "fieldset", "head", "audio", "video"}
VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "param", "source", "track", "wbr"}
#: blocks of running text
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "table", "tr", "td", "th", "caption", "figcaption", "address", "summary"}
BLOCKS = TEXT | FURNITURE | {"div", "article", "main", "section", "ul", "ol", "dl", "thead", "tbody", "tfoot", "figure", "hr", "body", "html", "center", "details", "hgroup"}
#: a new one ends an open one
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: the outermost of these, after which no other is ended
_OUTERMOST = {"tr": {"tr"}}
_INLINE = {
    "a", "b", "i", "em", "strong", "span", "u", "s", "small", "big", "sub", "sup", "code", "tt", "q", "cite", "abbr", "mark", "font", "ins", "del", "time", "kbd", "samp", "var", "strike", "bdi",
    "bdo", "dfn",
}
#: whole names, of classes and of containers' ids
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsored", "promo", "notice", "notices", "cookie-notice", "cookie-banner", "newsletter", "newsletter-signup",
    "comment", "comments", "comment-list", "commentlist", "comments-area", "disqus_thread", "share", "sharing", "share-buttons", "social-share", "sidebar", "breadcrumb", "breadcrumbs", "pagination",
}
_CONTAINERS = {"div", "section", "ul", "ol"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar"}
MAIN, OPEN, JUNK, LOOSE = 0, 1, 2, 3
#: the zone of hidden elements, which have no lines
UNSEEN = 4


def _zone(tag: str, attributes: str, zone: int) -> int:
    if zone == UNSEEN:
        return UNSEEN
    found: dict[str, str] = {}
    if attributes.strip(" \t\r\n/"):
        for m in _ATTRIBUTE.finditer(attributes):
            found.setdefault(m.group(1).lower(), next((g for g in m.groups()[1:] if g is not None), ""))
        if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or _UNSEEN.search(found.get("style", "")):
            return UNSEEN
    if zone == JUNK:
        return JUNK
    inside = zone in (MAIN, LOOSE)
    if tag in FURNITURE and not (tag == "header" and inside):
        return JUNK
    if found and tag not in ("article", "main", "body", "html"):
        role = found.get("role", "").strip().lower()
        if role in _ROLES:
            return JUNK
        if tag in BLOCKS and tag not in _HEADINGS:
            names = set(found.get("class", "").lower().split())
            if tag in _CONTAINERS:
                names.add(found.get("id", "").strip().lower())
            if names & _NAMES:
                return JUNK
        if role in ("main", "article") or found.get("itemprop", "").strip().lower() == "articlebody":
            return MAIN
    if tag in ("article", "main"):
        return MAIN
    if inside and tag in TEXT:
        return MAIN
    if inside and tag in _CONTAINERS and ("class" in found or "id" in found):
        return LOOSE
    return zone


class _Stack:
    """Open elements with the zones around them, and where each tag and each element that isn't inline is open."""

    def __init__(self):
        self.items: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.outer: list[int] = []

    def push(self, tag: str, zone: int) -> None:
        self.places.setdefault(tag, []).append(len(self.items))
        if tag not in _INLINE:
            self.outer.append(len(self.items))
        self.items.append((tag, zone))

    def cut(self, k: int) -> int:
        """Closes elements from number k on; the zone around them."""
        zone = self.items[k][1]
        for i in range(len(self.items) - 1, k - 1, -1):
            tag = self.items[i][0]
            self.places[tag].pop()
            if tag not in _INLINE:
                self.outer.pop()
        del self.items[k:]
        return zone

    def top(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1


def blocks(html: str) -> list[tuple[str, int]]:
    """Text and zone of each line, in page order; hidden ones are left out."""
    out: list[tuple[str, int]] = []
    stack = _Stack()
    pieces: list[str] = []
    zone, at, n = OPEN, 0, len(html)

    def close() -> None:
        if pieces:
            text = _SPACE.sub(" ", "".join(pieces)).strip()
            if text and zone != UNSEEN:
                out.append((text, zone))
            pieces.clear()

    while at < n:
        next_ = html.find("<", at)
        if next_ < 0:
            next_ = n
        if next_ > at and zone != UNSEEN:
            piece = html[at:next_]
            pieces.append(unescape(piece) if "&" in piece else piece)
        if next_ == n:
            break
        m = _TAG.match(html, next_)
        if not m:
            if html.startswith("</", next_):
                end = html.find(">", next_)
                at = n if end < 0 else end + 1
            else:
                if zone != UNSEEN:
                    pieces.append("<")
                at = next_ + 1
            continue
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag, attributes = tag.lower(), m.group(3)
        if m.group(1):
            k = stack.top(tag)
            if tag in BLOCKS:
                close()
            if k < 0 or (tag in _INLINE and stack.outer and stack.outer[-1] > k):
                continue  # a stray end, and one of an inline element doesn't end blocks
            if tag not in BLOCKS and stack.items[k][1] != zone:
                close()
            zone = stack.cut(k)
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append(" ")
            elif tag in BLOCKS:
                close()
            continue
        itself = attributes.rstrip().endswith("/")
        if tag in RAW:
            if not itself:
                end = re.compile(rf"</{re.escape(tag)}(?:\s[^>]*)?>", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if itself and tag not in BLOCKS:
            continue
        if tag in BLOCKS or tag == "option":
            close()
            # an open paragraph, or item of the same list, and inline elements in it, end here
            ended, last = _SELF_CLOSING.get(tag, set()) | {"p"}, _OUTERMOST.get(tag, _SELF_CLOSING.get(tag, {"p"}))
            while stack.outer and (own := stack.items[stack.outer[-1]][0]) in ended:
                zone = stack.cut(stack.outer[-1])
                if own in last:
                    break
        new = _zone(tag, attributes, zone)
        if new != zone:
            close()
        stack.push(tag, zone)
        zone = new
    close()
    return out


# --- differencing ----------------------------------------------------------------------------------------------------


def _rows(a: list, masks: dict, m: int) -> list[int]:
    """For each number of lines of a, the places of b (as bits) at which its common subsequence does not grow."""
    full = (1 << m) - 1
    v, out = full, [full]
    for x in a:
        if mask := masks.get(x, 0):
            u = v & mask
            v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _masks(b: list) -> dict:
    bits: dict = {}
    for j, x in enumerate(b):
        bits.setdefault(x, []).append(j)
    out = {}
    for x, places in bits.items():
        raw = np.zeros(len(b), np.uint8)
        raw[places] = 1
        out[x] = int.from_bytes(np.packbits(raw, bitorder="little").tobytes(), "little")
    return out


def _lengths(v: int, m: int) -> np.ndarray:
    """Lengths of the common subsequences with each of the m + 1 beginnings of b."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes(m // 8 + 1, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def shared_lines(a: list, b: list, most_bits: int = 1 << 28) -> set[int]:
    """Numbers of the lines of a that a longest common subsequence with b holds.

    By whole rows of the table as bits; a table of more than `most_bits` is halved where its best paths cross the middle.
    """
    out: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.add(n)
        if i == n or j == m:
            continue
        x, y = a[i:n], b[j:m]
        if len(x) > 1 and len(x) * len(y) > most_bits:
            half, masks, back = len(x) // 2, _masks(y), _masks(y[::-1])
            v = u = (1 << len(y)) - 1
            for w in x[:half]:
                t = v & masks.get(w, 0)
                v = ((v + t) | (v - t)) & ((1 << len(y)) - 1)
            for w in x[:half - 1:-1]:
                t = u & back.get(w, 0)
                u = ((u + t) | (u - t)) & ((1 << len(y)) - 1)
            k = int(np.argmax(_lengths(v, len(y)) + _lengths(u, len(y))[::-1]))
            todo += [(i, i + half, j, j + k), (i + half, n, j + k, m)]
            continue
        rows = _rows(x, _masks(y), len(y))
        p, q = len(x), len(y)
        while p and q:
            if x[p - 1] == y[q - 1]:
                out.add(i + p - 1)
                p, q = p - 1, q - 1
            elif rows[p] >> (q - 1) & 1:
                q -= 1
            else:
                p -= 1
    return out


# --- the plan --------------------------------------------------------------------------------------------------------


def _scan(pages: DataFrame, on: str, url: str, html: str) -> DataFrame:
    """For each page its host and path, its lines (null for furniture) with zones and hashes, and its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda raw, n: hashlib.blake2b(raw, digest_size=n).digest()
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                rows = []
                for link, raw in zip(part.column("_url").to_pylist(), part.column("_html").to_pylist()):
                    found = blocks(raw or "")
                    place = _URL.match(link or "")
                    host, path = (place.group(1).lower(), place.group(2)) if place else ("", "")
                    hashes = b"".join([digest(t.encode("utf-8", "surrogatepass"), 8) for t, _ in found])
                    lines = [None if z == JUNK else t.encode("utf-8", "replace").decode() for t, z in found]
                    rows.append((host, path, lines, [z for _, z in found], np.frombuffer(hashes, np.int64), digest(host.encode() + b"\0" + hashes, 16)))
                kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.int64()), pa.binary())
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_url"), *columns], ["_id", "_url", "_host", "_path", "_lines", "_zones", "_hashes", "_class"])

    kind = dict(pages.dtypes)[on]
    flat = pages.select(F.col(on).alias("_id"), F.col(url).cast("string").alias("_url"), F.col(html).alias("_html"))
    return flat.mapInArrow(run, f"_id {kind}, _url string, _host string, _path string, _lines array<string>, _zones array<tinyint>, _hashes array<bigint>, _class binary")


def shared_with_neighbours(scanned: DataFrame) -> tuple[DataFrame, int]:
    """For each class that has a neighbour the numbers of the lines that it shares with one, and how many classes there are."""
    classes = scanned.groupBy("_class").agg(F.min("_host").alias("_host"), F.min("_path").alias("_path"), F.min("_hashes").alias("_hashes"), F.count("*").alias("_pages"))
    placed, total = running(classes, [F.col("_host"), F.col("_path"), F.col("_class")], {"_rank": F.lit(1)}, "paths")
    placed = stored(placed, "placed")
    sides = F.explode(F.array(F.col("_rank") - 1, F.col("_rank") + 1)).alias("_rank")
    others = placed.select(sides, F.col("_host").alias("_their_host"), F.col("_hashes").alias("_theirs"))
    pairs = placed.join(others, "_rank").where("_host = _their_host").select("_class", "_pages", "_hashes", "_theirs")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(shared_lines(a, b)) for a, b in zip(batch.column("_hashes").to_pylist(), batch.column("_theirs").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_class"), batch.column("_pages"), pa.array(rows, pa.list_(pa.int32()))], ["_class", "_pages", "_shared"])

    found = pairs.mapInArrow(differ, "_class binary, _pages long, _shared array<int>")
    found = found.groupBy("_class").agg(F.first("_pages").alias("_pages"), F.array_distinct(F.flatten(F.collect_list("_shared"))).alias("_shared"))  # two rows each
    return stored(found, "shared"), total["_rank"]


def extract(pages: DataFrame, on: str = "page_id", url: str = "url", html: str = "html", small_classes: int = 500_000) -> DataFrame:
    """id, url, text and n_chars for each page; n_shared: its lines that a neighbour shares, n_deleted: those that were deleted for it."""
    scanned = stored(_scan(pages, on, url, html), "lines")
    shared, n_classes = shared_with_neighbours(scanned)
    alone = scanned.join(F.broadcast(shared.select("_class")) if n_classes <= small_classes else shared.select("_class"), "_class", "left_anti").withColumn("_shared", F.array().cast("array<int>"))
    if n_classes <= small_classes:
        met = scanned.join(F.broadcast(shared.drop("_pages")), "_class")
    else:
        met = join_skewed(scanned, shared, "_class", "_pages", scanned.count()).drop("_pages")
    rows = met.unionByName(alone.select(*met.columns))
    marked = F.exists("_zones", lambda z: z.isin(MAIN, LOOSE))
    same = lambda i: F.array_contains("_shared", i)
    zone = lambda i: F.element_at("_zones", i + 1)
    may = lambda i: (zone(i) == MAIN) | (zone(i) == LOOSE) | ((zone(i) == OPEN) & ~marked)
    lines = F.transform("_lines", lambda x, i: F.when(may(i) & ((zone(i) == MAIN) | ~same(i)), x))
    deleted = F.size(F.filter("_shared", lambda i: may(i) & (zone(i) != MAIN)))
    out = rows.select(F.col("_id").alias(on), F.col("_url").alias(url), F.array_join(F.array_compact(lines), "\n").alias("text"), F.size("_shared").alias("_s"), deleted.alias("_d"))
    return out.select(on, url, "text", F.length("text").cast("long").alias("n_chars"), F.col("_s").cast("long").alias("n_shared"), F.col("_d").cast("long").alias("n_deleted"))
