"""Main text of web pages by composite text density.

Every DOM node gets its link-adjusted characters per tag. The densities of a node's
block children are summed (formatting inside a line is no child of its own, it counts
in its block); the subtree of the greatest sum is the main text's core. The least
density on the way from it up to the body is the threshold: on that way, blocks beside
it that are at least as dense, and headings in front of what is kept, come along; for further article
and main elements characters outside links per tag decide, as the composite density grows
with length. A way through an article or main element takes that element whole.

Boilerplate is never measured: elements of that role (navigation, asides, forms, ...)
and of class names that are made of boilerplate words alone ('comments', 'cookie-notice',
but not 'market-share' or 'has-sidebar'). Class names and forms don't count on elements
that hold the article or most of the text.

Defined results: a null, empty or text-free page gives an empty text. Markup
that is cut off or not closed is read as browsers do. Repeated rows give
repeated equal rows; extra input columns are ignored; an empty table gives an
empty table. A single <br> is white space inside its block.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, split_columns, text_or_empty

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
SKIPPED = frozenset("head script style template noscript textarea title xmp iframe noembed noframes svg math object canvas audio video".split())
BOILERPLATE = frozenset("nav header footer aside form button select input label menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CONTENT = frozenset("article main".split())
#: Elements that an equal (or grouped) start tag closes, up to the given containers.
CLOSED_BY_SIBLING = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table")}
CLOSED_BY_SIBLING = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSED_BY_SIBLING.items()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Class and id names mark boilerplate if they hold one of these words, and no words but these and NEUTRAL ones.
MARKED = frozenset("ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side rail aside widget related recommended share sharing social comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login modal popup overlay toolbar pagination pager skip tags".split())
NEUTRAL = frozenset("box list bar block section wrapper wrap container area item items inner outer holder slot unit panel content links link button buttons btn form post posts entry article articles site page main top bottom left right primary secondary global mobile desktop user reader readers col column row group thread title text body message msg fixed sticky js id the and".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<close>>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "dead", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.dead = is_boilerplate(self)


def is_boilerplate(node: Node) -> bool:
    if is_never_text(node) or node.tag in BOILERPLATE:
        return True
    if node.tag in ("html", "body", "main", "article"):
        return False
    return is_marked(node)


def is_never_text(node: Node) -> bool:
    return node.tag in SKIPPED or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or node.attrs.get("role", "").lower() in ROLES


def is_marked(node: Node) -> bool:
    names = node.attrs.get("class", "") + " " + node.attrs.get("id", "")
    return any(_is_marked_name(name) for name in names.split())


@functools.lru_cache(maxsize=65536)
def _is_marked_name(name: str) -> bool:
    words = [w.lower() for w in _WORDS.findall(name) if not w.isdigit()]
    return any(w in MARKED for w in words) and all(w in MARKED or w in NEUTRAL for w in words)


def parse(page: str) -> Node:
    """DOM of a page. Text that no element holds belongs to the root."""
    root = top = Node("html", {}, None)
    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            top.children.append(page[at:])
            break
        if m.start() > at:
            top.children.append(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        tag = m["name"].lower()
        if m["end"]:
            node = top
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                top = node.parent
            continue
        if not m["close"]:  # a tag that the page's end cuts off
            break
        if tag in ("html", "body") and top is root:
            continue
        top = _closed_before(top, tag)
        raw = m["attrs"]
        attrs = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTR.findall(raw)} if "=" in raw else {}
        if raw and re.search(r"(?<![\w=\"'-])hidden(?![\w=-])", re.sub(r"\"[^\"]*\"|'[^']*'", "", raw)):
            attrs["hidden"] = ""
        node = Node(tag, attrs, top)
        top.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        top = node
    return root


def _closed_before(top: Node, tag: str) -> Node:
    """The element that becomes the parent of a new one: open ones which its start tag ends are left."""
    if tag in CLOSES_P:
        node = top
        while node.parent is not None and node.tag != "p" and node.tag not in BLOCKS - {"p"}:
            node = node.parent
        if node.tag == "p":
            top = node.parent
    if tag in CLOSED_BY_SIBLING:
        closed, stop = CLOSED_BY_SIBLING[tag]
        node = top
        while node.parent is not None and node.tag not in stop:
            if node.tag in closed:
                top = node.parent
            node = node.parent
    return top


def revive(root: Node) -> None:
    """Forms and elements of boilerplate classes live if they hold an article or main, or most of the page's text outside links.

    Articles of boilerplate classes (comments, teasers) don't count.
    """
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [c for c in node.children if not isinstance(c, str) and not is_never_text(c)]
    if not any(n.dead for n in nodes):
        return
    plain: dict[int, int] = {}
    holds: dict[int, bool] = {}
    for node in reversed(nodes):
        inner = [c for c in node.children if not isinstance(c, str) and id(c) in plain]
        own = sum(len(c) - sum(map(c.count, " \n\t\r")) for c in node.children if isinstance(c, str))
        plain[id(node)] = 0 if node.tag == "a" else own + sum(plain[id(c)] for c in inner)
        holds[id(node)] = any(c.tag in CONTENT and not is_marked(c) or holds[id(c)] for c in inner)
    for node in nodes:
        if node.dead and node.tag not in BOILERPLATE - {"form"} and (holds[id(node)] or 2 * plain[id(node)] > plain[id(root)]):
            node.dead = False


def _walk(root: Node) -> list[Node]:
    """All living nodes, each before its children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str) and not c.dead]
    return out


def measure(root: Node) -> list[Node]:
    nodes = _walk(root)
    for node in reversed(nodes):
        living = [c for c in node.children if not isinstance(c, str) and not c.dead]
        own = sum(len(c) - c.count(" ") for c in node.children if isinstance(c, str))
        node.chars = own + sum(c.chars for c in living)
        node.tags = len(living) + sum(c.tags for c in living)
        node.link_chars = node.chars if node.tag == "a" else sum(c.link_chars for c in living)
        node.link_tags = node.tags + 1 if node.tag == "a" else sum(c.link_tags for c in living)
    body = max(1, root.chars), root.link_chars
    for node in nodes:
        node.density = _density(node, *body)
    for node in reversed(nodes):
        node.total = sum(c.density for c in block_children(node)) or node.density
    return nodes


def _density(node: Node, body_chars: int, body_link_chars: int) -> float:
    """Characters per tag, on a logarithm that links bend downwards."""
    if not node.chars:
        return 0.0
    links, tags, link_tags = max(1, node.link_chars), max(1, node.tags), max(1, node.link_tags)
    plain = max(1, node.chars - node.link_chars)
    base = math.log(node.chars / plain * links + body_link_chars / body_chars * node.chars + math.e)
    return node.chars / tags * math.log(max(1.0, node.chars / links * tags / link_tags) + 1e-9) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else node.chars / tags


def block_children(node: Node) -> list[Node]:
    return [c for c in node.children if not isinstance(c, str) and not c.dead and c.tag in BLOCKS]


def plain_density(node: Node) -> float:
    """Characters outside links per tag, whatever the node's length."""
    return (node.chars - node.link_chars) / max(1, node.tags)


def main_nodes(root: Node) -> list[Node]:
    """The subtree of the greatest density sum and what the body-path threshold adds to it, in page order."""
    nodes = measure(root)
    best = max((n for n in nodes if n.tag in BLOCKS or n is root), key=lambda n: n.total)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold, plain = min(n.density for n in path), min(plain_density(n) for n in path)
    kept = [best]
    for below, up in zip(path, path[1:], strict=False):
        beside = [c for c in block_children(up) if c.chars or c is below]
        keeps = [c is below or c.density >= threshold or c.tag in CONTENT and plain_density(c) >= plain for c in beside]
        for i in range(len(beside) - 2, -1, -1):
            keeps[i] |= keeps[i + 1] and beside[i].tag in HEADINGS
        whole = up.tag in CONTENT or up.attrs.get("role", "").lower() == "main"
        if whole or below not in beside or all(keeps) and kept == [below]:  # a child inside a line takes its block along
            kept = [up]
            continue
        at = beside.index(below)
        kept = [c for c, k in zip(beside[:at], keeps[:at], strict=True) if k] + kept + [c for c, k in zip(beside[at + 1 :], keeps[at + 1 :], strict=True) if k]
    return kept


def blocks(chosen: list[Node]) -> list[str]:
    """Texts of the blocks in some subtrees, in page order."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if text:
                out.append(text)

    todo: list[Node | str | None] = []
    for node in reversed(chosen):
        todo += [None, node]
    while todo:
        item = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            run.append(item)
        elif item.tag == "br":
            run.append(" ")
        elif not item.dead:
            if item.tag in BLOCKS:
                close()
                todo.append(None)
            todo += reversed(item.children)
    close()
    return out


def main_text(page: str) -> str:
    root = parse(page)
    revive(root)
    return "\n".join(blocks(main_nodes(root)))


def extract_pages(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every whole page."""
    bounded_batches(df.sparkSession)
    types = {c: df.schema[c].dataType.simpleString() for c in (key, url)}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fixed = batch.select([key, url])
            at = 0
            for (pages,) in split_columns(batch, [html]):
                texts = [main_text(p.decode()) for p in pages]
                own = fixed.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return df.select(F.col(key), F.col(url), text_or_empty(html).alias(html)).mapInArrow(run, f"`{key}` {types[key]}, `{url}` {types[url]}, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
