"""HTML main-text extraction with a tree-structured graphical model.

A page becomes a tree of block elements with text blocks as leaves.  Every node is content or
boilerplate; a node's features give its own potential, and each edge has a parent-child potential.
Sum-product messages go up the tree and down again, and a text block is kept if its content
marginal is over one half.  Both kinds of potentials are counted on a bounded sample of labelled
pages: pages whose own markup says what is what (article or main against navigation, footers,
forms and named boilerplate).  Extraction is narrow: one page at a time.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

# Pages that the potentials are counted on, at most.
TRAIN_PAGES = 2000

# Element names of HTML by their role here.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "option", "button"}
# Where the content of such an element ends; the end tag of an option may be left out.
RAW_END = {t: re.compile(rf"</{t}", re.I | re.A) for t in RAW}
RAW_END["option"] = re.compile(r"</option|(?=<(?:option|/?optgroup|/select|/datalist)\b)", re.I | re.A)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
          "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1",
            "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog"}
CONTENT_TAGS = {"article", "main"}
# Words in class, id and role that name a part of a page.
BOILER_NAMES = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
                "consent", "cookie", "cookies", "copyright", "disqus", "footer", "form", "gdpr", "header", "login", "masthead",
                "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pager",
                "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "reply", "search", "share",
                "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "warning",
                "widget", "alert", "contentinfo", "complementary", "respond", "discussion", "disclaimer"}
CONTENT_NAMES = {"article", "content", "entry", "main", "post", "story", "text", "body"}
# Elements that occur in content and boilerplate alike: their names tell nothing, only their place does.
GENERIC = {"#root", "html", "body", "div", "p", "section", "table", "tbody", "tr", "td", "th", "ul", "ol", "dl", "dt", "dd", "li",
           "blockquote", "pre", "figure", "center", "details", "address"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
# Start tag of an element that names the content.
TELLS = r"(?i)<(?:article|main)[\s/>]"
NAMES = re.compile(r"(?:\s|^)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
WORD = re.compile(r"[a-z]+")
ENDS = re.compile(r"[.!?…]")


class Node:
    __slots__ = ("tag", "kind", "parent", "kids", "text", "linked", "label", "marks")

    def __init__(self, tag: str, kind: str, parent: "Node | None"):
        self.tag, self.kind, self.parent, self.kids = tag, kind, parent, []
        self.text, self.linked, self.label, self.marks = "", 0, None, 0
        if parent is not None:
            parent.kids.append(self)


def name_kind(tag: str, attributes: str) -> str:
    """Whether tag or names say boilerplate, content or nothing."""
    if tag in BOILER_TAGS:
        return "boiler"
    words: set[str] = set()
    for m in NAMES.finditer(attributes):
        words.update(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1]).lower()))
    if words & BOILER_NAMES:
        return "boiler"
    if tag in CONTENT_TAGS or words & CONTENT_NAMES:
        return "content"
    return ""


def parse(page: str) -> Node:
    """The tree of block elements; runs of text and inline markup are leaves with tag '#'."""
    root = Node("#root", "", None)
    here, parts, linked, in_link = root, [], 0, False

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                leaf = Node("#", "", here)
                leaf.text, leaf.linked, leaf.marks = text, min(linked, len(text)), len(ENDS.findall(text))
            parts, linked = [], 0

    def close(tags: set[str], within: set[str]) -> None:
        """Close the nearest open element of ``tags`` unless one of ``within`` lies before it."""
        nonlocal here
        at = here
        while at is not root and at.tag not in within:
            if at.tag in tags:
                flush()
                here = at.parent
                return
            at = at.parent

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            if in_link:
                linked += n - at
            break
        if m.start() > at:
            parts.append(page[at:m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = False
            if tag not in INLINE and tag not in VOID:
                flush()
                close({tag}, set())
            elif tag == "br":
                parts.append(" ")
            continue
        if tag == "svg" and m[0].endswith("/>"):
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            if end is None and tag == "option":
                end = TOKEN.search(page, at)
            if end is None:
                at = n
            elif end[0].startswith("</") and end.re is not TOKEN:
                close_at = page.find(">", end.end())
                at = n if close_at < 0 else close_at + 1
            else:
                at = end.start()
            flush()
        elif tag in VOID:
            parts.append(" ")
        elif tag in INLINE:
            in_link = in_link or tag == "a"
        else:
            flush()
            if tag in CLOSES_P:
                close({"p"}, {"article", "main", "section", "div", "body", "td", "li"})
            if tag in ITEMS:
                close({tag} | ({"dt", "dd"} if tag in ("dt", "dd") else set()), ITEMS[tag])
            if tag in CLOSES_P or tag in ITEMS:
                in_link = False
            if m[3].rstrip().endswith("/") and tag not in CLOSES_P:
                continue
            kind = name_kind(tag, m[3])
            if tag == "header" and not _inside(here, CONTENT_TAGS):
                kind = "boiler"
            here = Node(tag, kind, here)
    flush()
    return root


def _inside(node: Node | None, tags: set[str]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def in_order(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.kids))
    return out


def step(x: float) -> int:
    return -1 if x <= 0 else int(math.log2(1 + x))


def features(nodes: list[Node]) -> dict[Node, list[str]]:
    size: dict[Node, tuple[int, int]] = {}
    for node in reversed(nodes):
        own = (len(node.text), node.linked)
        size[node] = tuple(map(sum, zip(own, *(size[k] for k in node.kids))))
    out = {}
    for node in nodes:
        chars, linked = size[node]
        share = int(4 * linked / chars) if chars else -1
        if node.tag == "#":
            out[node] = [f"leaf size {min(step(chars), 9)}", f"leaf links {share}", f"leaf ends {min(node.marks, 3)}"]
        else:
            out[node] = [f"links {share}", *([f"name {node.kind}"] * bool(node.kind)),
                         *([f"tag {node.tag}"] * (node.tag not in GENERIC))]
    return out


def edge(child: Node) -> str:
    """The kind of a parent-child edge."""
    return "leaf" if child.tag == "#" else child.kind or ("block" if child.tag in CLOSES_P else "other")


def seed_labels(nodes: list[Node], named: bool = True) -> bool:
    """Label nodes by the page's own markup; False if it doesn't tell.  Content: inside article or
    main and under no boilerplate; an element without either takes the side of most of its text.
    Where content is not ``named`` so, all that is under no boilerplate is content."""
    side: dict[Node, int] = {}
    told = False
    for node in nodes:
        up = side.get(node.parent, 0 if named else 1)
        boiler = node.kind == "boiler" or node.tag == "header" and (up == 0 or not named)
        side[node] = 0 if boiler else 1 if node.tag in CONTENT_TAGS or up else 0
        told = told or node.tag in CONTENT_TAGS
    weight: dict[Node, int] = {}
    for node in reversed(nodes):
        own = (len(node.text) if side[node] else -len(node.text)) if node.tag == "#" else 0
        weight[node] = own + sum(weight[k] for k in node.kids)
        explicit = node.tag == "#" or side[node] or node.kind == "boiler"
        node.label = side[node] if explicit else int(weight[node] > 0)
    return told or not named


class Model:
    """Log potentials from smoothed counts of (key, label) and (edge, parent label, label)."""

    def __init__(self, counts: dict[tuple[str, int], float]):
        total = [sum(v for (k, x), v in counts.items() if k == "all" and x == y) + 2.0 for y in (0, 1)]
        keys = {k for k, _ in counts if not k.startswith("edge ") and k != "all"}
        self.own = {k: tuple(math.log((counts.get((k, y), 0.0) + 0.5) / total[y]) for y in (0, 1)) for k in keys}
        self.own = {k: _clip(v) for k, v in self.own.items()}
        self.pair = {}
        for kind in ("leaf", "boiler", "content", "block", "other"):
            rows = []
            for up in (0, 1):
                seen = [counts.get((f"edge {kind} {up}", y), 0.0) + 1.0 for y in (0, 1)]
                rows.append(tuple(math.log(s / sum(seen)) for s in seen))
            self.pair[kind] = tuple(rows)

    def marginals(self, nodes: list[Node]) -> dict[Node, float]:
        """P(content) of every node: messages up from the leaves, then down from the root."""
        own = self.own
        belief: dict[Node, list[float]] = {}
        for node, keys in features(nodes).items():
            a = b = 0.0
            for k in keys:
                p = own.get(k)
                if p is not None:
                    a += p[0]
                    b += p[1]
            belief[node] = [a, b]
        up: dict[Node, tuple[float, float]] = {}
        for node in reversed(nodes):
            if node.parent is not None:
                b0, b1 = belief[node]
                (p00, p01), (p10, p11) = self.pair[edge(node)]
                up[node] = (_log_sum(p00 + b0, p01 + b1), _log_sum(p10 + b0, p11 + b1))
                mine = belief[node.parent]
                mine[0] += up[node][0]
                mine[1] += up[node][1]
        for node in nodes:
            if node.parent is not None:
                b0, b1 = belief[node.parent]
                c0, c1 = b0 - up[node][0], b1 - up[node][1]
                (p00, p01), (p10, p11) = self.pair[edge(node)]
                mine = belief[node]
                mine[0] += _log_sum(c0 + p00, c1 + p10)
                mine[1] += _log_sum(c0 + p01, c1 + p11)
        return {n: 1 / (1 + math.exp(max(-700.0, min(700.0, b[0] - b[1])))) for n, b in belief.items()}


def _clip(v: tuple[float, float], most: float = 6.0) -> tuple[float, float]:
    gap = max(-most, min(most, v[1] - v[0]))
    return (-gap / 2, gap / 2)


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


def main_text(page: str, model: Model) -> str:
    nodes = in_order(parse(page))
    content = model.marginals(nodes)
    return " ".join([n.text for n in nodes if n.tag == "#" and content[n] > 0.5])


def page_counts(page: str, named: bool = True) -> Counter:
    nodes = in_order(parse(page))
    out: Counter = Counter()
    if seed_labels(nodes, named):
        for node, keys in features(nodes).items():
            out[("all", node.label)] += 1
            for k in keys:
                out[(k, node.label)] += 1
            if node.parent is not None:
                out[(f"edge {edge(node)} {node.parent.label}", node.label)] += 1
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = TRAIN_PAGES) -> Model:
    """Potentials from at most ``rows`` pages that have an article or main element, taken by a hash of the
    page.  Where no page has one, from as many of all pages: there all that no name or element
    marks as boilerplate is labelled content.  What reaches the driver is the table of counts, bounded by the
    feature names.  Without pages every potential is even, and nothing is content."""
    whole = pages.select(F.col(f"`{id_col}`").alias("id"), text_of(html_col).alias("html"))

    def counts(some: DataFrame, named: bool) -> dict[tuple[str, int], float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: Counter = Counter()
            for b in batches:
                for page in b.column(0).to_pylist():
                    out.update(page_counts(page, named))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in out], pa.string()), pa.array([y for _, y in out], pa.int32()),
                 pa.array([float(v) for v in out.values()], pa.float64())], ["key", "label", "n"])

        ids = stored(some.select("id").dropna().orderBy(F.xxhash64("id"), "id").limit(rows).distinct(), "html-sample")
        sample = some.join(F.broadcast(ids), "id").orderBy(F.xxhash64("id", "html")).limit(rows).select("html")
        got = sample.repartition(8).mapInArrow(run, "key string, label int, n double")
        return {(r["key"], r["label"]): r["n"] for r in got.groupBy("key", "label").agg(F.sum("n").alias("n")).collect()}

    return Model(counts(whole.filter(F.col("html").rlike(TELLS)), True) or counts(whole, False))


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page id, url, text, n_chars (code points).  Null html counts as empty.

    Character references are decoded; white space inside a block becomes one space; blocks are
    joined in page order by one space.  Truncated and unbalanced markup is read as far as it goes."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    shared = pages.sparkSession.sparkContext.broadcast(model)           # bounded by the feature names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, shared.value) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"])

    out = (pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), text_of(html_col).alias("html"))
           .mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long"))
    return out.toDF(id_col, url_col, "text", "n_chars")
