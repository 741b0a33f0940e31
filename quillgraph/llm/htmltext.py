"""Main text of web pages by a site style tree.

Each page is parsed into a tree of block elements; a node's style is its tag, class and id, its path the styles from
the root. The trees of one host are merged: a path holds how often each child sequence (presentation) and each text
(content) occurs at it over the host's pages. A text found on n of m pages has entropy ln n / ln(m + PRIOR) there; a leaf's
importance is 1 less the mean entropy of its texts. An inner node joins the entropy of its child sequences with the
importance of what is below by 1 - GAMMA^children and GAMMA^children. Branches that are below `least` in importance with all
that is below them are removed from each page, in an article as outside. PRIOR stands for pages not seen: on two or three pages
repetition says little, on many all, and the rule is one for hosts of every size.

Removed on every page, whatever the host: elements that declare themselves as something else than the article, by tag
(nav, footer, aside, form, script, ...; header outside an article), by role or by a word of their class or id (ad, menu,
sidebar, cookie, comments, ...), or hidden. A word doesn't remove html, body, main or what holds most of the page's text
(of its articles and main, if it has any); words for comments only give way around an article or main. Of what the tree leaves, only the articles count if they hold half of the text or
more, else only main if that does, else all: a teaser in an article doesn't stand for the page. Where the tree leaves no text
at all, as on hosts that repeat one page, articles and main stay. For texts that their path doesn't repeat, the tree decides
nothing: declared elements and these shares do. What is nested more than DEPTH deep counts, stays and goes with its ancestor at that
depth; no text is lost by this.

Parsing takes time in proportion to the page, nested or broken as it may be: open elements are found by their tag, and once quotes
turn out not to close before the page ends, tags end at the next >.

Counting is by (host, path, text hash), summed before each shuffle, so a hot host is no hot task. The topmost low branches join
back as one array a host: broadcast up to `broadcast_chars` characters, which is checked, so that pages aren't shuffled;
beyond that by host and one of `SALTS` salts, so that a hot host's pages are dealt to many tasks. Defined cases: very long pages are
taken whole; null or empty html gives empty text; null urls have an empty host; text
outside any block is a block of its parent; repeated rows each get their answer; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

GAMMA, LEAST, PRIOR, DEPTH = 0.9, 0.3, 8, 24
BROADCAST_CHARS, SALTS = 8 << 20, 64
# Elements and words by their role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object textarea title".split())
DROPPED = frozenset("head nav footer aside form menu dialog select button input search audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
WORDS = frozenset("ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion related reply replies respond share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
WORD, COMMENT, SURE = 1, 2, 3  # how an element declares itself: by a word, by one for comments, by tag, role or hidden
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_REST = re.compile(r"""((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")  # a tag's attributes to its end, > in quotes passed over
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Node:
    style: str
    path: str
    dropped: bool
    article: int  # bits: 2 inside an article, 1 inside main
    declared: int = 0
    parent: int = -1
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    text: str
    node: Node


def _tags(page: str, jump: list[int]) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, and attributes of each tag; comments and declarations have no name. None begins before jump[0]."""
    at, quotes = page.find("<"), True
    while at >= 0:
        stop, name, rest = -1, _NAME.match(page, at), None
        if name:
            rest = _REST.match(page, name.end()) if quotes else None
            quotes = rest is not None
            stop = rest.end() if rest else page.find(">", name.end()) + 1
            if not stop:
                return
            yield at, stop, name[1].lower(), page[at + 1] == "/", rest[1] if rest else page[name.end() : stop - 1]
        elif page.startswith("<!--", at):
            stop = page.find("-->", at + 4) + 3
            stop = stop if stop > 2 else len(page)
            yield at, stop, "", False, ""
        elif page.startswith(("<!", "<?"), at):
            stop = page.find(">", at) + 1
            if not stop:
                return
            yield at, stop, "", False, ""
        at = page.find("<", max(stop, at + 1, jump[0]))


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _declared(tag: str, given: dict[str, str], article: int) -> int:
    """How the element says that it isn't part of the article; 0: it doesn't."""
    if tag in ("html", "body"):
        return 0
    if tag in DROPPED or tag == "header" and not article & 2:
        return SURE
    if not given:
        return 0
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower() or given.get("role", "").lower() in ROLES:
        return SURE
    if tag == "main" or tag == "article" and not re.search("comment|reply", given.get("class", "") + given.get("id", ""), re.I):
        return 0
    found = {w.lower() for w in _WORD.findall(given.get("class", "") + " " + given.get("id", ""))} & WORDS
    if article & 2:
        found.discard("header")
    return (COMMENT if found & COMMENTS else WORD) if found else 0


def _drop(blocks: list[Block], nodes: list[Node]) -> None:
    """Marks what is in elements that declare themselves, unless by a word that would take most of the page's text."""
    sure = []
    for n in nodes:
        sure.append(n.declared == SURE or n.parent >= 0 and sure[n.parent])
    kept = [n.declared in (WORD, COMMENT) for n in nodes]
    if any(kept):
        place = {id(n): k for k, n in enumerate(nodes)}
        # Characters in and below each node: of all text, of articles and main, and of those that start below it.
        text, inner, started = ([0] * len(nodes) for _ in range(3))
        for b in blocks:
            k = place[id(b.node)]
            if not sure[k]:
                text[k] += len(b.text)
                inner[k] += len(b.text) * (b.node.article > 0)
        for k in range(len(nodes) - 1, 0, -1):
            up = nodes[k].parent
            text[up] += text[k]
            inner[up] += inner[k]
            started[up] += started[k] if nodes[up].article == nodes[k].article else inner[k]
        own = inner if inner[0] else text
        lifted = [2 * started[k] > inner[0] > 0 or n.declared == WORD and 2 * own[k] > own[0] for k, n in enumerate(nodes)]
        kept = [k and not up for k, up in zip(kept, lifted, strict=True)]
        gone = []
        for k, n in enumerate(nodes):
            gone.append(kept[k] or n.parent >= 0 and gone[n.parent])
        if inner[0] and all(gone[place[id(b.node)]] or sure[place[id(b.node)]] for b in blocks if b.node.article):
            kept = [k and not started[i] for i, k in enumerate(kept)]
    for k, n in enumerate(nodes):
        n.dropped = sure[k] or kept[k] or n.parent >= 0 and nodes[n.parent].dropped


def parsed(page: str) -> tuple[list[Block], list[Node]]:
    """Text blocks in page order, and all block elements."""
    root = Node("", "", False, 0)
    stack: list[tuple[str, Node, int]] = [("", root, 0)]
    places: dict[str, list[int]] = {}  # of each tag, where it is open in the stack
    blocks, nodes, parts, at, jump = [], [root], [], 0, [0]
    inline: list[str] = []  # inline elements that declare themselves as something else

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append(Block(text, stack[-1][1]))

    def close(tag: str) -> None:
        if places.get(tag):
            k = places[tag][-1]
            for other, _, _ in stack[k:]:
                places[other].pop()
            del stack[k:]

    for start, stop, tag, ends, raw in _tags(page, jump):
        if start > at and not inline:
            parts.append(page[at:start])
        at = stop
        if not tag:
            continue
        if tag in RAW and not ends:
            found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = jump[0] = found.end() if found else len(page)
            if tag == "textarea" or tag in BLOCKS:
                flush()
            continue
        if tag not in BLOCKS:
            if tag == "br":
                parts.append(" ")
            elif inline:
                if not ends and tag == inline[0] and tag not in VOID:
                    inline.append(tag)
                elif ends and tag == inline[0]:
                    inline.pop()
            elif not ends and tag not in VOID and _declared(tag, _attributes(raw), stack[-1][1].article):
                inline.append(tag)
            continue
        inline.clear()
        flush()
        if ends:
            close(tag)
            continue
        if stack[-1][0] == "p" or tag == "p":
            close("p")
        for other in CLOSED_BY.get(tag, ()):
            if stack[-1][0] == other:
                close(other)
        if tag == "hr":
            continue
        given, parent = _attributes(raw), stack[-1][1]
        style = tag + "".join(f".{w}" for w in sorted(given.get("class", "").split())) + (f"#{given['id']}" if given.get("id") else "")
        declared = _declared(tag, given, parent.article)
        article = parent.article | (2 * (not declared) if tag == "article" else 1 if tag == "main" or given.get("role") == "main" else 0)
        path = f"{parent.path}/{style}" if len(stack) <= DEPTH else parent.path
        node = Node(style, path, False, article, declared, stack[-1][2])
        parent.children.append(style)
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node, len(nodes)))
        nodes.append(node)
    if at < len(page) and not inline:
        parts.append(page[at:])
    flush()
    _drop(blocks, nodes)
    return blocks, nodes


def _is_low(path: str, low: frozenset[str], known: dict[str, bool]) -> bool:
    """Whether path or one above it is low; known: answers of this page."""
    if path not in known:
        ends = [k for k, c in enumerate(path) if c == "/" and k] + [len(path)]
        known[path] = any(path[:k] in low for k in ends)
    return known[path]


def main_text(page: str, low: frozenset[str] = frozenset()) -> str:
    """The page's text without declared and low branches; low: paths of the page's host."""
    blocks, _ = parsed(page)
    given = [b for b in blocks if not b.node.dropped]
    known: dict[str, bool] = {}
    left = [b for b in given if not _is_low(b.node.path, low, known)] if low else given
    left = left or [b for b in given if b.node.article]
    whole = sum(len(b.text) for b in left)
    for bit in (2, 1):
        held = [b for b in left if b.node.article & bit]
        if held and 2 * sum(len(b.text) for b in held) >= whole:
            left = held
            break
    return "\n".join(b.text for b in left)


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each page adds to its host's style tree: path, kind (0 text, 1 child sequence), hash, of nodes that aren't declared."""
    for batch in batches:
        hosts, paths, kinds, values, widths = [], [], [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blocks, nodes = parsed(page or "")
            seen = {(b.node.path, 0, b.text, 0) for b in blocks if not b.node.dropped}
            seen |= {(n.path, 1, " ".join(n.children), len(n.children)) for n in nodes if n.children and not n.dropped}
            for path, kind, value, width in sorted(seen):
                hosts.append(host)
                paths.append(path)
                kinds.append(kind)
                values.append(value)
                widths.append(width)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(kinds, pa.int32()), pa.array(values, pa.string()), pa.array(widths, pa.int32())], ["host", "path", "kind", "value", "width"])


def _above():
    """path and the paths above it."""
    steps = F.split("path", "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the merged trees of pages (host, html)."""
    seen = pages.select("host", "html").mapInArrow(_observed, "host string, path string, kind int, value string, width int")
    counts = seen.groupBy("host", "path", "kind", F.xxhash64("value").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("width"))
    on = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.max("width").alias("width"))
    # kind 0: 1 - mean of ln n_a / ln m over occurrences; kind 1: -sum p ln p / ln m = (ln m - nlogn / m) / ln m
    # both with ln(m + PRIOR) for ln m.
    even = F.col("nlogn") / F.col("n") / F.log(F.col("n") + F.lit(PRIOR))
    # Read twice below; written, so that pages are parsed once for the tree.
    own = written(on.select("host", "path", "kind", "n", "width", (1 - even).alias("importance")), "style-tree")
    below = own.where("kind = 0").select("host", F.explode(_above()).alias("path"), "n", "importance").groupBy("host", "path").agg(F.max("n").alias("pages"), (F.sum(F.col("n") * F.col("importance")) / F.sum("n")).alias("content"))
    look = own.where("kind = 1").select("host", "path", "width", F.col("importance").alias("look"))
    share = F.pow(F.lit(GAMMA), F.coalesce("width", F.lit(0)))
    return below.join(look, ["host", "path"], "left").select("host", "path", "pages", ((1 - share) * F.coalesce("look", F.lit(0.0)) + share * F.col("content")).alias("importance"))


def low_branches(tree: DataFrame, least: float = LEAST) -> DataFrame:
    """(host, low): the topmost paths of low importance that have no other path below, one row a host."""
    rows = tree.withColumn("low", F.col("importance") < least)
    whole = rows.select("host", F.explode(_above()).alias("path"), "low").groupBy("host", "path").agg(F.bool_and("low").alias("low"))
    below = written(whole.where(F.col("low") & (F.col("path") != "")).select("host", "path"), "low-paths")
    above = below.select(F.col("host").alias("above_host"), F.col("path").alias("above_path"))
    parent = F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")
    top = below.join(above, (F.col("host") == F.col("above_host")) & (parent == F.col("above_path")), "left_anti")
    return top.groupBy("host").agg(F.array_sort(F.collect_set("path")).alias("low"))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1)), F.lit(""))


def with_low(rows: DataFrame, low: DataFrame, broadcast_chars: int) -> DataFrame:
    """rows plus their host's low branches, null where it has none."""
    chars = low.agg(F.coalesce(F.sum(F.length("host") + F.length(F.array_join("low", "/"))), F.lit(0)).alias("n")).first()["n"]
    if chars <= broadcast_chars:
        return rows.join(F.broadcast(low), "host", "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")


def extracted(pages: DataFrame, least: float = LEAST, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    low = written(low_branches(style_tree(rows), least), "low-branches")

    def run(batches):
        for batch in batches:
            texts = [main_text(page or "", frozenset(branches or ())) for page, branches in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return with_low(rows, low, broadcast_chars).select("page_id", "url", "html", "low").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
