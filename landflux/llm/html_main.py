"""Main text of web pages, by the style tree of their site.

The pages of a host are merged into one style tree. Its nodes are the places of
elements (names and classes from the root down, without long numbers); every page
that shows a node adds the layout of its children there and the content below it.
A node has two entropies over its pages, as shares of the highest possible: that of
its layouts (presentation) and that of its contents, which is the joint entropy of
all below it and so needs no pass up the tree. Its importance is their weighted sum:
a branch that says the same on page after page has little, one that differs from
page to page has much. Branches of low importance are removed from every page of
the host. Single blocks of a node are its features: one that nearly all of the
node's pages show is removed too, in articles as elsewhere, so a notice that a
template repeats among the paragraphs goes.

Entropy says nothing where a site has few pages, or where the noise changes with
every page. So elements whose name, role or class says what they are (menus,
page headers and footers, sidebars, notices, adverts, forms, comments of readers)
are left out first; if a page marks its article or main part, only that is read,
and there names decide nothing on paragraphs and headings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landflux.llm.store import Store, other_columns, sets_aside
from landflux.llm.urls import host_of

LEAST_PAGES = 8  # pages of a host that show a node or block, before its entropy counts
LOW = 0.3  # importance of removed branches
LOW_BLOCK = 0.05  # importance of removed single blocks
CONTENT = 0.9  # weight of contents beside presentation

# tag, comment, or declaration; attribute values may hold ">"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[!?][^>]*>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile("[ \t\n\r\f]+")
NUMBER = re.compile("[0-9]{3,}")  # of one page, in a class name

# Elements by what they are in HTML.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr", "img", "label",
}
NOISE = {
    "nav", "aside", "footer", "form", "button", "select", "option", "input", "label", "fieldset", "dialog", "menu",
    "noscript", "template", "svg", "canvas", "object", "audio", "video", "map", "head",
}
NOISE_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu",
    "menubar", "toolbar", "tablist",
}
NOISE_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo",
    "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "cookie", "cookies",
    "consent", "gdpr", "notice", "comment", "comments", "disqus", "reply", "replies", "share", "sharing", "social",
    "related", "recommended", "newsletter", "subscribe", "popup", "modal", "overlay", "widget", "widgets", "pagination",
    "pager", "login", "signup", "masthead",
}
PLAIN = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "article", "main"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


def _names(value: str) -> set[str]:
    """Words of class and id names."""
    return {w for name in value.split() for w in re.split("[-_:]+", re.sub("(?<=[a-z])(?=[A-Z])", "-", name).lower())}


def runs(html: str) -> list[tuple[str, bool, str]]:
    """(place, in main part, text) of every block of a page outside noise, in order.

    A tolerant reading: unknown end tags are ignored, missing ones are implied
    by the end of an outer element. Inline elements neither divide blocks nor
    have a place of their own, but for those that are noise, up to their end tag.
    """
    found: list[tuple[str, bool, str]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, label, noise, main part
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip(" ")
            parts.clear()
            if text and not any(s[2] for s in stack):
                found.append(("/".join(s[1] for s in stack), any(s[3] for s in stack), text))

    def close(name: str) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == name:
                flush()
                del stack[depth:]
                return

    at = 0
    while token := TOKEN.search(html, at):
        if token.start() > at:
            parts.append(unescape(html[at : token.start()]))
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if token[1]:
            if name == "p" and not any(s[0] == "p" for s in stack):
                flush()
            elif name not in INLINE or any(s[0] == name for s in stack):
                close(name)
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(html, at)
            at = len(html) if end is None else end.start()
            closing = TOKEN.match(html, at)
            at = closing.end() if closing else at
            continue
        if name in VOID:
            if name in ("br", "hr"):
                parts.append(" ") if name == "br" else flush()
            continue
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(token[3])} if token[3] else {}
        label = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        inside = any(s[3] for s in stack)
        noise = name in NOISE or name == "header" and not inside or "hidden" in attributes
        noise |= attributes.get("role", "").lower() in NOISE_ROLES
        named = name not in ("html", "body", "article", "main") and not (inside and name in PLAIN)
        noise |= named and not NOISE_NAMES.isdisjoint(_names(label))
        if name in INLINE and not noise and not any(s[0] in INLINE for s in stack):
            continue
        flush()
        if name not in INLINE:
            if stack and stack[-1][0] == "p":
                stack.pop()
            while stack and stack[-1][0] in CLOSED_BY.get(name, ()):
                stack.pop()
            if stack and stack[-1][0] == "head" and name != "head":
                stack.pop()
        classes = ".".join(sorted(NUMBER.sub("", c) for c in attributes.get("class", "").split()))
        place = f"{name}.{classes}" if classes else name
        stack.append((name, place, noise, name in ("article", "main") and not noise))
    if at < len(html):
        parts.append(unescape(html[at:]))
    flush()
    return found


def branches(html: str | None) -> list[tuple[list[str], int, str]]:
    """(place, first removable level, text) of the blocks of a page's main part, or of all blocks if none is marked.

    The place of a plain paragraph or heading is the element around it. Levels of
    a place from the first removable one on are branches that may go; the body,
    the marked part and what is around them may not.
    """
    found = runs(html or "")
    if any(main for _, main, _ in found):
        found = [run for run in found if run[1]]
    out = []
    for place, main, text in found:
        names = place.split("/") if place else []
        while names and names[-1] in PLAIN - {"article", "main"}:
            names.pop()
        around = ("article", "main") if main else ("html", "body")
        first = next((k + 1 for k in range(len(names) - 1, -1, -1) if names[k].split(".")[0] in around), 0)
        out.append((names, first, text))
    return out


def _digest(*parts: str | int) -> int:
    return xxhash.xxh64("\0".join(map(str, parts)).encode()).intdigest() - (1 << 63)


def units(page: list[tuple[list[str], int, str]]) -> tuple[list[tuple[list[int], int, str]], list[tuple[int, int, int]]]:
    """A page's blocks as (removable nodes around it, feature, text), and what it adds to the style tree.

    The latter are (node, kind, digest), each once a page: layouts and contents of
    its nodes, its features, and the places that have features.
    """
    blocks, layouts, contents, seen = [], {}, {}, {}
    for names, first, text in page:
        node, nodes = 0, []
        for level, name in enumerate(names):
            node = _digest(node, name)
            if level >= first:
                nodes.append(node)
                below = names[level + 1] if level + 1 < len(names) else "#"
                layout = layouts.setdefault(node, [])
                if not layout or layout[-1] != below:  # runs of equal children are one
                    layout.append(below)
                contents.setdefault(node, xxhash.xxh64()).update(text.encode("utf-8", "replace") + b"\0")
        feature = xxhash.xxh64(f"{node}\0{text}".encode("utf-8", "replace")).intdigest() - (1 << 63)
        blocks.append((nodes, feature, text))
        seen[node, FEATURE, feature] = seen[node, PLACE, 0] = None
    added = [(n, LAYOUT, _digest(*names)) for n, names in layouts.items()]
    added += [(n, CONTENTS, d.intdigest() - (1 << 63)) for n, d in contents.items()]
    return blocks, added + list(seen)


LAYOUT, CONTENTS, FEATURE, PLACE = range(4)  # kinds of units
BLOCK = pa.struct([("nodes", pa.list_(pa.int64())), ("feature", pa.int64()), ("text", pa.string())])
UNIT = pa.struct([("node", pa.int64()), ("kind", pa.int32()), ("digest", pa.int64())])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks, added = [], []
        for html in batch.column("_html").to_pylist():
            page, own = units(branches(html))
            blocks.append([dict(zip(("nodes", "feature", "text"), b, strict=True)) for b in page])
            added.append([dict(zip(("node", "kind", "digest"), u, strict=True)) for u in own])
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_html"]
        yield pa.RecordBatch.from_arrays(
            [*(c for _, c in kept), pa.array(blocks, pa.list_(BLOCK)), pa.array(added, pa.list_(UNIT))],
            names=[*(n for n, _ in kept), "_blocks", "_units"],
        )


def _entropy(kind: int) -> Column:
    """Of the digests of one kind, as a share of the highest: with c of m pages showing one, (log m - sum(c log c) / m) / log m."""
    c = F.when(F.col("kind") == kind, F.col("c"))
    return (F.log(F.sum(c)) - F.sum(c * F.log(c)) / F.sum(c)) / F.log(F.sum(c))


def unimportant(parsed: DataFrame) -> DataFrame:
    """(_host, id) of the style trees' nodes and features of low importance.

    Equal units are counted in each task before the shuffle. A feature that c of
    its place's m pages show has the entropy log c / log m, and one less that as
    its importance.
    """
    unit = F.explode("_units").alias("unit")
    counts = parsed.select("_host", unit).select("_host", "unit.*").groupBy("_host", "node", "kind", "digest").agg(F.count("*").alias("c"))
    often = F.col("c") >= LEAST_PAGES
    pages = F.sum(F.when(F.col("kind") == CONTENTS, F.col("c")))
    nodes = counts.filter(F.col("kind").isin(LAYOUT, CONTENTS)).groupBy("_host", "node").agg(
        pages.alias("pages"), F.struct(_entropy(LAYOUT).alias("layout"), _entropy(CONTENTS).alias("content")).alias("of")
    )
    importance = (1 - CONTENT) * F.col("of.layout") + CONTENT * F.col("of.content")
    low = nodes.filter((F.col("pages") >= LEAST_PAGES) & (importance < LOW)).select("_host", F.col("node").alias("id"))
    places = counts.filter((F.col("kind") == PLACE) & often).select("_host", "node", F.col("c").alias("m"))
    features = counts.filter((F.col("kind") == FEATURE) & often).join(places, ["_host", "node"])
    repeated = features.filter(1 - F.log("c") / F.log("m") < LOW_BLOCK).select("_host", F.col("digest").alias("id"))
    return low.unionByName(repeated)


@sets_aside("_host", "_html", "_blocks", "_units", "_low")
def main_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The rows of ``pages`` without the html, with text and n_chars.

    A null or empty page has an empty text. Blocks are joined by one space, in
    page order; none is cut. A page of which removal of branches would leave
    nothing keeps them; one of which removal of repeated blocks would take over
    half of the text left (copies and near copies of one article) keeps those.
    Columns named like a result are replaced. Equal pages of a host get equal
    texts; an empty table stays empty. Only nodes and blocks shown by
    ``LEAST_PAGES`` pages are listed for a host, so the list grows with its
    templates, not with its pages.
    """
    own = other_columns(pages, [html.lower(), "text", "n_chars"])
    store = Store(pages.sparkSession, "pages")
    read = pages.select(*own, host_of(F.col(f"`{url}`")).alias("_host"), F.col(f"`{html}`").alias("_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields if f.name != "_html")
    blocks = "_blocks array<struct<nodes:array<bigint>,feature:bigint,text:string>>"
    blocks += ", _units array<struct<node:bigint,kind:int,digest:bigint>>"
    parsed = store.keep(read.mapInArrow(_parsed, f"{kinds}, {blocks}"))
    low = store.keep(unimportant(parsed).groupBy("_host").agg(F.collect_list("id").alias("_low")))
    judged = parsed.drop("_units").join(low, "_host", "left").withColumn("_low", F.coalesce("_low", F.array().cast("array<bigint>")))
    chars = lambda blocks: F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b["text"]))
    left = F.filter("_blocks", lambda b: ~F.arrays_overlap(b["nodes"], F.col("_low")))
    judged = judged.withColumn("_blocks", F.when(F.size(left) > 0, left).otherwise(F.col("_blocks")))
    left = F.filter("_blocks", lambda b: ~F.array_contains(F.col("_low"), b["feature"]))
    kept = F.when(2 * chars(left) >= chars(F.col("_blocks")), left).otherwise(F.col("_blocks"))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    return judged.select(*own, text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
