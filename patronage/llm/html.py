"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements whose leaves are runs of inline text. Every node is
described by its tag, its attribute words, depth, text and link density of its subtree, and its
place among its siblings. Boosted trees estimate for each node whether it holds main text. The
decoding then picks the most likely labelling in which no node is main text unless its parent is,
so an ancestor and a descendant never contradict each other.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by what they do to the layout.
RAW = {"script", "style", "title", "noscript", "template", "textarea", "iframe", "select", "button",
       "canvas", "audio", "video"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source",
        "track", "wbr"}
PARAGRAPH = {"p", "pre", "blockquote", "figcaption", "address"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
LIST = {"ul", "ol", "li", "dl", "dt", "dd"}
MAIN = {"article", "main"}
ASIDE = {"nav", "footer", "aside", "header", "form", "menu", "dialog", "fieldset"}
TABLE = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}
BOX = {"html", "body", "div", "section", "center", "figure", "details", "summary", "hr"}
BLOCKS = PARAGRAPH | HEADING | LIST | MAIN | ASIDE | TABLE | BOX
GROUPS = (PARAGRAPH, HEADING, LIST, MAIN, ASIDE, TABLE, BOX)
CONTROLS = {"input", "button", "select", "textarea", "label", "option"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}}
# Words in class, id and role attributes that name the parts of a page.
MAIN_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text", "prose"}
ASIDE_WORDS = {
    "ad", "ads", "advert", "advertisement", "alert", "author", "banner", "bar", "breadcrumb",
    "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie",
    "copyright", "disqus", "footer", "form", "header", "login", "masthead", "menu", "meta", "modal",
    "nav", "navbar", "navigation", "newsletter", "notice", "pager", "popup", "promo", "recommended",
    "related", "reply", "replies", "responses", "search", "share", "sharing", "sidebar", "signup",
    "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+")
FEATURES = 29


@dataclass
class Tree:
    """Nodes in page order; a parent comes before its children. Leaves have text."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    words: list[frozenset] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    controls: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, words: frozenset = frozenset(), text: str = "",
            linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(words)
        self.text.append(text)
        self.linked.append(linked)
        self.controls.append(0)
        return len(self.parent) - 1


def _attribute_words(attributes: str) -> frozenset:
    return frozenset(w.lower() for m in _NAMES.finditer(attributes)
                     for w in _PART.findall(m[1] or m[2] or m[3] or ""))


def parse(page: str | None) -> Tree:
    """The tree of a page; unclosed and misplaced tags are mended as browsers do."""
    page, tree = page or "", Tree()
    stack = [(tree.add(-1, "#page"), "#page")]
    pieces: list[str] = []
    links, link_chars = 0, 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join("".join(pieces).split())
        if text:
            tree.add(stack[-1][0], "#text", text=text, linked=min(link_chars, len(text)))
        pieces.clear()
        link_chars = 0

    def say(raw: str) -> None:
        nonlocal link_chars
        if raw:
            plain = entities.unescape(raw)
            pieces.append(plain)
            link_chars += len(plain) if links else 0

    def pop_to(names: set, limit: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][1] in names:
                del stack[i:]
                return
            if stack[i][1] in limit:
                return

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        say(page[at:found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if tag in CONTROLS and not closing:
            tree.controls[stack[-1][0]] += 1
        if tag in RAW:
            if not closing and not found[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in ("br", "wbr", "img"):
            pieces.append(" ")
        elif tag in BLOCKS:
            flush()
            if closing:
                pop_to({tag}, set() if tag in BOX | MAIN | ASIDE else {"td", "th", "table"} - {tag})
                links = 0
            else:
                pop_to({"p"}, BLOCKS - {"p"})
                if tag in CLOSES:
                    pop_to(CLOSES[tag], {"ul", "ol", "dl", "table"})
                if tag not in VOID and tag not in ("html", "body"):
                    node = tree.add(stack[-1][0], tag, _attribute_words(found[3]))
                    stack.append((node, tag))
    flush()
    return tree


def describe(tree: Tree) -> np.ndarray:
    """One row of ``FEATURES`` numbers per node."""
    n = len(tree.parent)
    chars = [len(t) for t in tree.text]
    linked = list(tree.linked)
    tags, controls, items = [1] * n, list(tree.controls), [0] * n
    stops = [sum(map(t.count, ".,;!?")) for t in tree.text]
    spaces = [t.count(" ") + 1 if t else 0 for t in tree.text]
    children: list[list[int]] = [[] for _ in range(n)]
    before, depth = [0] * n, [0] * n
    aside, main, run = [0] * n, [0] * n, 0
    place = [0] * n
    for v in range(n):
        up = tree.parent[v]
        before[v] = run
        run += chars[v]
        items[v] += tree.tag[v] == "li"
        if up >= 0:
            place[v] = len(children[up])
            children[up].append(v)
            depth[v] = depth[up] + 1
            aside[v], main[v] = aside[up], main[up]
        aside[v] += (tree.tag[v] in ASIDE) + bool(tree.words[v] & ASIDE_WORDS)
        main[v] += (tree.tag[v] in MAIN) + bool(tree.words[v] & MAIN_WORDS)
    for v in range(n - 1, 0, -1):
        up = tree.parent[v]
        for counts in (chars, linked, tags, controls, items, stops, spaces):
            counts[up] += counts[v]
    out = np.zeros((n, FEATURES))
    for v in range(n):
        up = tree.parent[v]
        family = children[up] if up >= 0 else [v]
        tag = tree.tag[v] if tree.text[v] == "" else tree.tag[up]
        row = out[v]
        row[0] = tree.tag[v] == "#text"
        for g, group in enumerate(GROUPS):
            row[1 + g] = tag in group
        row[8] = depth[v]
        row[9] = math.log1p(chars[v])
        row[10] = linked[v] / chars[v] if chars[v] else 0
        row[11] = chars[v] / tags[v]
        row[12] = stops[v] / max(spaces[v], 1)
        row[13] = math.log1p(tags[v])
        row[14] = place[v] / len(family)
        row[15] = math.log1p(len(family))
        around = chars[up] - chars[v] if up >= 0 else 0
        row[16] = math.log1p(around / max(len(family) - 1, 1))
        row[17] = (linked[up] - linked[v]) / around if up >= 0 and around else 0
        row[18] = bool(tree.words[v] & ASIDE_WORDS)
        row[19] = aside[v]
        row[20] = bool(tree.words[v] & MAIN_WORDS)
        row[21] = main[v]
        row[22] = controls[v]
        row[23] = before[v] / max(run, 1)
        row[24] = chars[v] / max(run, 1)
        row[25] = items[v] / tags[v]
        row[26] = chars[v] / max(spaces[v], 1)
        row[27] = len(children[v])
        row[28] = tag == "h1"
    return out


def rule_labels(tree: Tree) -> list[int] | None:
    """Which nodes hold main text by the names a page gives its parts; None if it names none.

    Text is main if an element around it is named as main content and none inside that, or
    around it, as something else. Used for learning only.
    """
    n = len(tree.parent)
    main, aside, label = [False] * n, [False] * n, [0] * n
    for v in range(n):
        up = tree.parent[v]
        named_main = tree.tag[v] in MAIN or bool(tree.words[v] & MAIN_WORDS)
        named_aside = tree.tag[v] in ASIDE or bool(tree.words[v] & ASIDE_WORDS)
        main[v] = (up >= 0 and main[up]) or (named_main and not named_aside)
        aside[v] = (up >= 0 and aside[up]) or named_aside
        if tree.text[v] and main[v] and not aside[v]:
            while v >= 0 and not label[v]:
                label[v] = 1
                v = tree.parent[v]
    return label if any(main) else None


def example_page(seed: int) -> tuple[Tree, list[int]]:
    """A made-up page with known main text, for layouts and names that the table may lack."""
    pick = random.Random(seed)

    def words(low: int, high: int) -> str:
        some = ["".join(pick.choice("aeiou") + pick.choice("bdklmnprst") for _ in range(
            pick.randint(1, 4))) for _ in range(pick.randint(low, high))]
        text = " ".join(some).capitalize()
        return re.sub(r" (\w+) (\w+) (\w+) (\w+) (\w+) (\w+) ", r" \1 \2 \3, \4 \5 \6. ", text) + "."

    def named(word: str, tag: str, other: str = "div") -> tuple[str, str]:
        kind = pick.random()
        if kind < 0.35:
            return f"<{tag}>", f"</{tag}>"
        if kind < 0.9:
            return f'<{other} {pick.choice(["class", "id"])}="{word}">', f"</{other}>"
        return f"<{other}>", f"</{other}>"

    def wrap(word: str, tag: str, inside: str, other: str = "div") -> str:
        a, b = named(word, tag, other)
        return a + inside + b

    def links(low: int, high: int) -> str:
        n = pick.randint(low, high)
        return "<ul>" + "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    side = {
        "menu": lambda: wrap(pick.choice(["menu", "nav", "topnav"]), "nav", links(3, 10)),
        "header": lambda: wrap(pick.choice(["header", "masthead"]), "header",
                               f"<div>{words(1, 4)}</div>" + (links(2, 5) if pick.random() < .5
                                                              else f"<p>{words(2, 9)}</p>")),
        "footer": lambda: wrap("footer", "footer", pick.choice([
            f"&copy; {words(2, 10)}", f"<p>{words(3, 30)}</p>" + links(2, 5)])),
        "sidebar": lambda: wrap(pick.choice(["sidebar", "related", "widget"]), "aside",
                                f"<h3>{words(1, 3)}</h3>" + pick.choice(
                                    [links(3, 8), f"<p>{words(5, 40)}</p>"])),
        "notice": lambda: wrap(pick.choice(["notice", "cookie-banner", "alert"]), "dialog",
                               f"<p>{words(4, 25)}</p><button>{words(1, 2)}</button>"),
        "ad": lambda: wrap(pick.choice(["ad", "advert", "sponsored", "promo"]), "aside",
                           words(3, 25)),
        "form": lambda: wrap(pick.choice(["newsletter", "search", "login"]), "form",
                             f"<label>{words(1, 4)}</label><input><button>{words(1, 2)}</button>",
                             "form"),
        "comments": lambda: wrap(pick.choice(["comments", "replies"]), "section",
                                 f"<h3>{words(1, 2)}</h3>" + "".join(
                                     f'<div class="comment"><b>{words(1, 2)}</b><p>{words(3, 40)}'
                                     "</p></div>" for _ in range(pick.randint(1, 6)))),
    }
    mark = "\x01"
    body = [f"<h1>{mark}{words(1, 9)}</h1>"]
    if pick.random() < 0.2:
        body = [f"<header>{body[0]}</header>"]
    for _ in range(pick.choice([1, 2, 4, 8, 15])):
        kind = pick.random()
        if kind < 0.8:
            body.append(f"<p>{mark}{words(8, 120)}</p>")
        elif kind < 0.88:
            body.append(f"<h2>{mark}{words(1, 6)}</h2>")
        elif kind < 0.94:
            body.append("<ul>" + "".join(f"<li>{mark}{words(2, 14)}</li>" for _ in range(4)) + "</ul>")
        else:
            body.append(f"<blockquote>{mark}{words(6, 30)}</blockquote>")
    for kind in ("ad", "notice", "form", "sidebar"):
        if pick.random() < 0.15:
            body.insert(pick.randint(1, len(body)), side[kind]())
    if pick.random() < 0.25:
        body.append(side["comments"]())
    a, b = named(pick.choice(["content", "main", "post", "entry", "article-body"]),
                 pick.choice(["article", "main"]))
    if pick.random() < 0.15:
        a, b = pick.choice([("", ""), ("<table><tr><td>", "</td></tr></table>"), ("<div>", "</div>")])
    parts = [side[k]() for k in ("notice", "header", "menu", "ad") if pick.random() < 0.6]
    rest = [side[k]() for k in ("comments", "form", "ad", "sidebar", "footer") if pick.random() < 0.5]
    page = "".join([*parts, a, *body, b, *rest])
    if pick.random() < 0.4:
        page = f"<div>{page}</div>"
    tree = parse(page)
    label = [0] * len(tree.parent)
    for v, text in enumerate(tree.text):
        if text.startswith(mark):
            tree.text[v] = text[1:]
            while v >= 0 and not label[v]:
                label[v] = 1
                v = tree.parent[v]
    return tree, label


def _training_rows(schema: pa.Schema):
    def batch(pairs: list) -> pa.RecordBatch:
        rows = np.concatenate([describe(t) for t, _ in pairs])
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(rows) + 1, dtype=np.int32) * FEATURES), pa.array(rows.ravel()))
        labels = [float(x) for _, label in pairs for x in label]
        return pa.RecordBatch.from_arrays([pa.array(labels), lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            pairs = []
            for page, seed in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                if seed is not None:
                    pairs.append(example_page(seed))
                    continue
                tree = parse(page)
                label = rule_labels(tree)
                if label is not None:
                    pairs.append((tree, label))
            if pairs:
                yield batch(pairs)
    return run


@dataclass(frozen=True)
class Boosted:
    """Boosted trees as arrays: per tree (feature or -1, threshold, left, right, value)."""

    trees: tuple[tuple[np.ndarray, ...], ...]
    weights: tuple[float, ...]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(rows), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                goes_left = rows[every, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += weight * value[at]
        return 1 / (1 + np.exp(-2 * np.clip(total, -15, 15)))


def _arrays(root) -> tuple[np.ndarray, ...]:
    rows: list[list[float]] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, float(node.prediction())])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][0], rows[at][1] = int(split.featureIndex()), float(split.threshold())
            rows[at][2] = walk(node.leftChild())
            rows[at][3] = walk(node.rightChild())
        return at

    walk(root)
    columns = list(zip(*rows))
    return (np.array(columns[0], np.int64), np.array(columns[1]), np.array(columns[2], np.int64),
            np.array(columns[3], np.int64), np.array(columns[4]))


def learn(pages: DataFrame, *, html_col: str = "html", id_col: str = "page_id", pages_used: int = 600,
          examples: int = 1500, rounds: int = 30, depth: int = 5) -> Boosted:
    """Boosted trees fitted on a bounded sample of pages that name their parts, and on made-up ones.

    About ``pages_used`` pages, chosen by a hash of the id, are labelled by the names of their
    elements; ``examples`` made-up pages add layouts, also ones without telling names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    spark = pages.sparkSession
    n = pages.count()
    limit = int((1 << 30) * min(1.0, pages_used / max(n, 1)))
    real = pages.filter(F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 30)) < limit).select(
        F.col(html_col).cast("string").alias("html"), F.lit(None).cast("bigint").alias("seed"))
    made = spark.range(examples, numPartitions=4).select(
        F.lit(None).cast("string").alias("html"), F.col("id").alias("seed"))
    out = spark.createDataFrame([], "label double, features array<double>").schema
    rows = real.unionByName(made).mapInArrow(_training_rows(to_arrow_schema(out)), out)
    fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, maxBins=32, seed=5,
                           minInstancesPerNode=10).fit(
        rows.select("label", array_to_vector("features").alias("features")))
    return Boosted(tuple(_arrays(t._java_obj.rootNode()) for t in fitted.trees),
                   tuple(fitted.treeWeights))


def decode(parent: list[int], p: np.ndarray) -> list[bool]:
    """The most likely labelling in which a node is main only if its parent is.

    ``off`` adds up what a subtree without main text is worth, ``on`` the best of one whose root
    is main; going down, a child is switched off with its whole subtree or stays on.
    """
    p = np.clip(p, 1e-4, 1 - 1e-4)
    off, on = np.log(1 - p).tolist(), np.log(p).tolist()
    for v in range(len(parent) - 1, 0, -1):
        up = parent[v]
        on[up] += max(on[v], off[v])
        off[up] += off[v]
    keep = [on[0] > off[0]]
    for v in range(1, len(parent)):
        keep.append(keep[parent[v]] and on[v] > off[v])
    return keep


def main_texts(pages: list[str | None], model: Boosted) -> list[str]:
    """Main text of each page: its kept blocks in page order, one per line."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    p = model.probability(np.concatenate([describe(t) for t in trees]))
    out, at = [], 0
    for tree in trees:
        n = len(tree.parent)
        keep = decode(tree.parent, p[at:at + n])
        at += n
        out.append("\n".join(t for t, k in zip(tree.text, keep) if k and t))
    return out


def extract(pages: DataFrame, model: Boosted, *, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole HTML; nothing is shuffled.

    Character references are decoded, white space inside a block becomes one space, and blocks
    are joined by a line break. A null or empty page, or one without main text, has the empty
    text. Broken markup is mended; an unfinished tag at the end is left out. Pages that repeat an
    id are treated one by one. An empty table gives an empty result. Other columns are not looked
    at.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"))
    out = rows.select("page_id", "url", F.lit("").alias("text"),
                      F.lit(0).cast("bigint").alias("n_chars")).schema
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                texts = main_texts(some.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return rows.mapInArrow(run, out)
