"""Main text of web pages: a tree-structured graphical model over the DOM.

A page is read into its block elements and, below them, its blocks of text.
Each is a variable: does it hold main text or not. A node has a potential from
its own features (kind of tag, words of its class and id, length, share of
links), and each edge one for parent and child together, by the child's kind.
Sum-product messages go from the leaves up to the root and back down, which
gives the exact marginal of every node. The blocks whose marginal is at least
``THRESHOLD`` are the main text, in page order.

Weights maximise the likelihood of labelled pages, with expectations from the
same messages. A labelled page is its source and its main text; at most
``LABELLED_PAGES`` are used. Without any given, ``generated_pages`` makes them:
layouts, tags, class names and missing end tags vary, words are random.

Inline tags are no nodes, and ``br`` is white space. Raw text (scripts, styles,
titles) is dropped while reading. Missing end tags of paragraphs, list items and
table cells are implied, end tags without a start are ignored, and an unclosed
tag, comment or script lasts to the end of the page, as in browsers.

All pages of a slice go through the messages together, one depth at a time; a
page's work and memory grow with its length. No rows are shuffled.

Defined results: a null, empty or blank page, and one without main text, has an
empty text; repeated rows are judged each; an empty table gives an empty result;
an input column that clashes with the one added is replaced.
"""

from __future__ import annotations

import html as html_entities
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Least marginal of a block of main text.
THRESHOLD = 0.5
#: Labelled pages that are learned from, at most.
LABELLED_PAGES = 700
#: Steps of the fit, and how strongly weights are drawn to zero.
STEPS, RIDGE = 200, 1e-4
#: Pages, and bytes of pages, that go through the messages together.
SLICE, SLICE_BYTES = 300, 1 << 22

# --- reading pages ----------------------------------------------------------

# A comment, a declaration, or a tag with its name and attributes.
TOKEN = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))
        |[!?][^>]*+(?:>|\Z)
        |/(?![A-Za-z])[^>]*+(?:>|\Z)
        |(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)
         (?P<rest>(?:[^>=]++|=[ \t\n\f\r]*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z))""",
    re.S | re.X,
)
NAMED = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
LASTING = frozenset("script style".split())

#: Kinds of block elements, by tag.
KINDS = {
    "article": "article", "main": "main", "section": "section", "nav": "nav", "menu": "nav", "header": "header",
    "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "legend": "form", "search": "form", "div": "div",
    "center": "div", "p": "p", "h1": "h1", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "hgroup": "heading", "ul": "list", "ol": "list", "dl": "list", "dir": "list", "li": "item", "dt": "item", "dd": "item",
    "table": "table", "caption": "cell", "thead": "table", "tbody": "table", "tfoot": "table", "tr": "table", "td": "cell",
    "th": "cell", "blockquote": "quote", "pre": "pre", "figure": "figure", "figcaption": "figure", "address": "address",
    "details": "details", "summary": "details", "dialog": "dialog", "button": "control", "select": "control",
    "option": "control", "optgroup": "control", "label": "control", "noscript": "noscript", "svg": "embedded", "math": "embedded",
    "object": "embedded", "video": "embedded", "audio": "embedded", "canvas": "embedded", "template": "embedded",
}
#: Elements that end an open paragraph.
ENDS_P = frozenset(KINDS) - frozenset("button select option optgroup label noscript svg math object video audio canvas template thead tbody tfoot tr td th caption legend summary".split())
#: Open elements that each start tag ends, and those it does not look beyond.
IMPLIED = {
    **{t: (frozenset(["li"]), frozenset("ul ol menu dir".split())) for t in ("li",)},
    **{t: (frozenset("dt dd".split()), frozenset(["dl"])) for t in ("dt", "dd")},
    **{t: (frozenset("td th".split()), frozenset("tr table".split())) for t in ("td", "th")},
    "tr": (frozenset("tr td th".split()), frozenset("table thead tbody tfoot".split())),
    **{t: (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
    "option": (frozenset(["option"]), frozenset(["select"])),
}
P_SCOPE = frozenset("table td th caption button object template".split())

#: Words of class, id and role, by what they speak of.
SPEAKS = {
    "content": "article content main post entry story body text prose page document".split(),
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs pagination pager toc tabs links".split(),
    "head": "header masthead topbar head logo brand branding tagline".split(),
    "foot": "footer foot bottom copyright legal colophon contentinfo".split(),
    "side": "sidebar aside side rail widget widgets related recommended popular trending complementary teaser teasers".split(),
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense dfp".split(),
    "notice": "cookie cookies consent gdpr notice notices alert modal popup overlay newsletter subscribe paywall toast notification warning".split(),
    "comment": "comment comments commentlist disqus reply replies respond discussion responses".split(),
    "social": "share social sharing follow facebook twitter".split(),
    "form": "search login signin signup register form input contact".split(),
}
_SPOKEN = {word: name for name, words in SPEAKS.items() for word in words}

_WORD_STEPS = (1, 2, 5, 10, 20, 40, 80)
_SHARE_STEPS = (0.0, 0.05, 0.2, 0.5, 0.8)
_LINK_STEPS = (0.0, 0.2, 0.5, 0.9)
FEATURES = {
    name: i
    for i, name in enumerate([
        *(f"is_{k}" for k in sorted({*KINDS.values(), "root"})), *(f"says_{k}" for k in SPEAKS), "says_nothing", "hidden",
        *(f"in_{k}" for k in sorted({*KINDS.values(), "root"})), *(f"words_{k}" for k in range(len(_WORD_STEPS) + 1)),
        *(f"linked_{k}" for k in range(len(_LINK_STEPS) + 1)), *(f"below_linked_{k}" for k in range(len(_LINK_STEPS) + 1)),
        *(f"share_{k}" for k in range(len(_SHARE_STEPS) + 1)), "sentence", "copyright", "bars", "block",
    ])
}
#: Kinds of edges, by the child; a named box is one whose class, id or role speaks of something else than main text.
EDGES = {"block": 0, "flow": 1, "box": 2, "marked": 3, "inner": 4, "named": 5}
_EDGE_OF = {
    **{k: 1 for k in ("p", "h1", "heading", "quote", "pre", "figure")}, **{k: 4 for k in ("item", "cell", "list", "table", "details")},
    **{k: 3 for k in ("nav", "header", "footer", "aside", "form", "control", "noscript", "embedded", "dialog", "address")},
}
_COPYRIGHT = re.compile(r"©|\bcopyright\b|all rights reserved", re.I)
_BARS = re.compile(r"[|·»›•]")


@dataclass
class Forest:
    """Nodes of some pages: parents stand before their children, blocks carry their text."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    edge: list[int] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)
    columns: list[int] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)

    def node(self, parent: int, edge: int, features: list[int], text: str | None = None, linked: int = 0) -> int:
        at = len(self.parent)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.edge.append(edge)
        self.texts.append(text)
        self.linked.append(linked)
        self.rows += [at] * len(features)
        self.columns += features
        return at


@lru_cache(maxsize=20_000)
def _element(kind: str, rest: str) -> tuple[int, tuple[int, ...]]:
    """Kind of edge and features of an element, by its kind and the source of its attributes."""
    found = {f"is_{kind}"}
    for values in NAMED.findall(rest) if rest else ():
        for part in PARTS.findall(" ".join(values)):
            spoken = _SPOKEN.get(part.lower())
            if spoken:
                found.add(f"says_{spoken}")
    edge = _EDGE_OF.get(kind, EDGES["box"])
    if edge == EDGES["box"] and not found <= {f"is_{kind}", "says_content"}:
        edge = EDGES["named"]
    if len(found) == 1:
        found.add("says_nothing")
    if rest and HIDDEN.search(rest):
        found.add("hidden")
    return edge, tuple(FEATURES[name] for name in sorted(found))


def read_page(source: str | None, forest: Forest) -> None:
    """Add the nodes of a page."""
    source = source or ""
    root = forest.node(-1, 0, [FEATURES["is_root"]])
    forest.roots.append(root)
    # Open block elements: tag and node. `held` is the text since the last border.
    stack: list[tuple[str, int]] = [("", root)]
    opened: dict[str, int] = {}
    held: list[str] = []
    linked, link_depth = 0, 0
    no_end: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                features = [FEATURES["block"], FEATURES[f"in_{KINDS.get(stack[-1][0], 'root')}"]]
                forest.node(stack[-1][1], 0, features, text, linked)
            linked = 0

    def close(depth: int) -> None:
        nonlocal link_depth
        flush()
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1
        if link_depth > depth:
            link_depth = 0

    def close_implied(ends: frozenset[str], until: frozenset[str]) -> None:
        if any(opened.get(t) for t in ends):
            last = None
            for depth in range(len(stack) - 1, 0, -1):
                tag = stack[depth][0]
                if tag in ends:
                    last = depth
                elif tag in until:
                    break
            if last is not None:
                close(last)

    at, size = 0, len(source)
    while at < size:
        token = TOKEN.search(source, at)
        begin = token.start() if token else size
        if begin > at:
            piece = source[at:begin]
            if "&" in piece:
                piece = html_entities.unescape(piece)
            held.append(piece)
            if link_depth:
                linked += len(piece.strip())
        if token is None:
            break
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if token["end"]:
            if name == "a":
                link_depth = 0
            elif opened.get(name):
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                close(depth)
            elif name == "p":
                # An end without a start is an empty paragraph.
                flush()
            continue
        if name in RAW:
            if name not in no_end:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                if end:
                    at = end.start()
                elif name in LASTING:
                    at = size
                else:
                    no_end.add(name)
            flush()
            continue
        if name == "br":
            held.append(" ")
        elif name == "a":
            link_depth = len(stack)
        elif name == "hr":
            close_implied(frozenset("p"), P_SCOPE)
            flush()
        elif name in KINDS:
            if name in ENDS_P and opened.get("p"):
                close_implied(frozenset("p"), P_SCOPE)
            if name in IMPLIED:
                close_implied(*IMPLIED[name])
            flush()
            kind, rest = KINDS[name], token["rest"]
            # Long attributes are not kept.
            edge, features = _element(kind, rest) if len(rest) < 500 else _element.__wrapped__(kind, rest)
            node = forest.node(stack[-1][1], edge, list(features))
            if not rest.endswith("/") or kind != "embedded":
                stack.append((name, node))
                opened[name] = opened.get(name, 0) + 1
    close(1)
    flush()


def _steps(values: np.ndarray, steps: tuple, name: str) -> np.ndarray:
    """Columns of the features that stand for the steps."""
    return FEATURES[f"{name}_0"] + np.searchsorted(np.array(steps), values, "left")


class Tree:
    """Arrays of a forest, with the features that need counts over whole subtrees."""

    def __init__(self, forest: Forest):
        self.parent = np.array(forest.parent, np.int64)
        self.edge = np.array(forest.edge, np.int64)
        depth = np.array(forest.depth, np.int64)
        n = len(depth)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
        is_block = np.array([t is not None for t in forest.texts], bool)
        self.blocks = np.flatnonzero(is_block)
        texts = [forest.texts[i] for i in self.blocks]
        words, chars, linked = (np.zeros(n) for _ in range(3))
        words[self.blocks] = [t.count(" ") + 1 for t in texts]
        chars[self.blocks] = [len(t) for t in texts]
        linked[self.blocks] = np.array(forest.linked, float)[self.blocks]
        for level in reversed(self.levels[1:]):
            for counts in (words, chars, linked):
                np.add.at(counts, self.parent[level], counts[level])
        page = np.zeros(n, np.int64)
        page[forest.roots] = forest.roots
        for level in self.levels[1:]:
            page[level] = page[self.parent[level]]
        density = np.minimum(linked / np.maximum(chars, 1), 1)
        share = words / np.maximum(words[page], 1)
        boxes = np.flatnonzero(~is_block)
        rows = [np.array(forest.rows, np.int64), self.blocks, self.blocks, boxes, boxes]
        columns = [
            np.array(forest.columns, np.int64),
            _steps(words[self.blocks], _WORD_STEPS, "words"),
            _steps(density[self.blocks], _LINK_STEPS, "linked"),
            _steps(density[boxes], _LINK_STEPS, "below_linked"),
            _steps(share[boxes], _SHARE_STEPS, "share"),
        ]
        for name, test in (
            ("sentence", lambda t: t.rstrip("\"'”’»)]")[-1:] in (".", "!", "?", "…", ":", "。")),
            ("copyright", _COPYRIGHT.search),
            ("bars", lambda t: len(_BARS.findall(t)) * 8 > t.count(" ") + 1),
        ):
            marked = self.blocks[[bool(test(t)) for t in texts]] if texts else self.blocks
            rows.append(marked)
            columns.append(np.full(len(marked), FEATURES[name]))
        self.rows, self.columns = np.concatenate(rows), np.concatenate(columns)

    def node_scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.columns], len(self.parent))

    def beliefs(self, scores: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of holding main text, and the messages below and above every node.

        ``scores`` are the nodes' log potentials of holding it, against none of
        not holding it; ``edges`` the log potentials of (kind, parent, child).
        Messages are log ratios too.
        """
        pair = [[edges[self.edge, a, b] for b in (0, 1)] for a in (0, 1)]
        inner, up, outer = scores.astype(float), np.zeros(len(scores)), np.zeros(len(scores))
        for level in reversed(self.levels[1:]):
            (e00, e01), (e10, e11) = [[e[level] for e in row] for row in pair]
            held = inner[level]
            up[level] = np.logaddexp(e10, e11 + held) - np.logaddexp(e00, e01 + held)
            np.add.at(inner, self.parent[level], up[level])
        whole = inner.copy()
        for level in self.levels[1:]:
            (e00, e01), (e10, e11) = [[e[level] for e in row] for row in pair]
            above = whole[self.parent[level]] - up[level]
            outer[level] = above
            whole[level] += np.logaddexp(e01, e11 + above) - np.logaddexp(e00, e10 + above)
        return 1 / (1 + np.exp(np.clip(-whole, -700, 700))), inner, outer

    def pairs(self, edges: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """Marginals of parent and child together, for all nodes with a parent."""
        children = np.flatnonzero(self.parent >= 0)
        joint = edges[self.edge[children]]
        joint[:, 1, :] += outer[children, None]
        joint[:, :, 1] += inner[children, None]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True, initial=-np.inf))
        return joint / joint.sum(axis=(1, 2), keepdims=True)


@dataclass
class Model:
    nodes: np.ndarray
    edges: np.ndarray


def labels_of(forest: Forest, tree: Tree, mains: list[str]) -> np.ndarray:
    """What holds main text: blocks that are lines of a page's main text, and all that is above them."""
    labels = np.zeros(len(forest.parent), bool)
    bounds = [*forest.roots[1:], len(forest.parent)]
    for root, end, main in zip(forest.roots, bounds, mains):
        left = main.split("\n") if main else []
        left.reverse()
        for at in range(root, end):
            if left and forest.texts[at] == left[-1]:
                labels[at] = True
                left.pop()
    for level in reversed(tree.levels[1:]):
        np.logical_or.at(labels, tree.parent[level], labels[level])
    return labels


def train(labelled: Iterable[tuple[str, str]]) -> Model:
    """Fit the potentials to pages given as ``(html, main text)``, lines in page order."""
    forest, mains = Forest(), []
    for source, main in labelled:
        if len(mains) == LABELLED_PAGES:
            break
        read_page(source, forest)
        mains.append(main)
    tree = Tree(forest)
    truth = labels_of(forest, tree, mains)
    children = np.flatnonzero(tree.parent >= 0)
    n, k = max(len(truth), 1), len(EDGES)
    seen = np.zeros((k, 2, 2))
    np.add.at(seen, (tree.edge[children], truth[tree.parent[children]].astype(int), truth[children].astype(int)), 1)
    seen_nodes = np.bincount(tree.columns, truth[tree.rows].astype(float), len(FEATURES))
    weights = [np.zeros(len(FEATURES)), np.zeros((k, 2, 2))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        marginal, inner, outer = tree.beliefs(tree.node_scores(weights[0]), weights[1])
        joint = tree.pairs(weights[1], inner, outer).reshape(-1, 4)
        expected = np.stack([np.bincount(tree.edge[children], joint[:, i], k) for i in range(4)], 1).reshape(k, 2, 2)
        slopes = [
            (seen_nodes - np.bincount(tree.columns, marginal[tree.rows], len(FEATURES))) / n - RIDGE * weights[0],
            (seen - expected) / n - RIDGE * weights[1],
        ]
        for i, slope in enumerate(slopes):
            first[i] += 0.1 * (slope - first[i])
            second[i] += 0.01 * (slope * slope - second[i])
            pace = 0.1 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            weights[i] = weights[i] + pace * first[i] / (np.sqrt(second[i]) + 1e-9)
    return Model(*weights)


def main_texts(sources: list[str | None], model: Model) -> list[str]:
    """Main text of each page."""
    forest = Forest()
    for source in sources:
        read_page(source, forest)
    tree = Tree(forest)
    marginal = tree.beliefs(tree.node_scores(model.nodes), model.edges)[0]
    out = []
    chosen = tree.blocks[marginal[tree.blocks] >= THRESHOLD]
    bounds = np.searchsorted(chosen, [*forest.roots, len(forest.parent)])
    for page in range(len(sources)):
        out.append("\n".join(forest.texts[i] for i in chosen[bounds[page] : bounds[page + 1]]))
    return out


def extract_text(pages: DataFrame, model: Model | None = None, html: str = "html", text: str = "text") -> DataFrame:
    """Replace the page source by its main ``text``."""
    model = model or default_model()
    kept = [f for f in pages.schema.fields if f.name not in (html, text)]
    names = [f.name for f in kept]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, first = batch.column(batch.schema.get_field_index(html)), 0
            while first < batch.num_rows:
                sources, size = [], 0
                while first + len(sources) < batch.num_rows and len(sources) < SLICE and size < SLICE_BYTES:
                    sources.append(column[first + len(sources)].as_py())
                    size += len(sources[-1] or "")
                part = batch.slice(first, len(sources))
                held = [part.column(part.schema.get_field_index(n)) for n in names]
                texts = [t.encode("utf-8", "replace") for t in main_texts(sources, model)]
                yield pa.RecordBatch.from_arrays([*held, pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, text])
                first += len(sources)

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{text}` string"]
    return pages.select(*names, html).mapInArrow(extract, ", ".join(fields))


@lru_cache(maxsize=2)
def default_model(pages: int = LABELLED_PAGES, seed: int = 1) -> Model:
    return train(generated_pages(pages, seed))


# --- labelled pages -------------------------------------------------------


class _Writer:
    """One page of random layout, and the lines of its main text."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.main = rng, [], []
        self.letters = rng.choice(["abcdefghijklmnoprstuvw", "aeioulnrstdméèç", "aäeinrstuhclgß", "оеаинтсрвлкмд"])
        self.named = rng.random() < 0.75
        self.sloppy = rng.random() < 0.3
        self.linked = rng.random() < 0.5

    def some(self, *choices):
        return self.rng.choice(choices)

    def word(self) -> str:
        return "".join(self.rng.choice(self.letters) for _ in range(self.rng.randint(1, 9)))

    def words(self, low: int, high: int) -> list[str]:
        return [self.word() for _ in range(self.rng.randint(low, high))]

    def sentence(self, low=4, high=18) -> str:
        words = self.words(low, high)
        if self.rng.random() < 0.3:
            words[self.rng.randrange(len(words))] += self.some(",", "&", "&&&", "###", "%", " |")
        return " ".join(words).capitalize() + self.rng.choices([".", "!", "?", ""], [8, 1, 1, 1])[0]

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(low, high)))

    def attrs(self, *names: str) -> str:
        """Class or id of one of the names, a meaningless one, or none."""
        if self.named and names and self.rng.random() < 0.92:
            name = self.rng.choice(names)
            if self.rng.random() < 0.3:
                name = self.some(f"{name}-{self.word()}", f"{self.word()} {name}", f"{name}{self.rng.randint(1, 9)}", f"c-{name}")
        elif self.rng.random() < 0.5:
            return ""
        else:
            name = self.some("row", "col", "wrap", "container", "inner", f"x{self.rng.randint(10, 99)}", "box", "grid", "block")
        return f' {self.some("class", "class", "id")}="{name}"'

    def put(self, *pieces: str) -> None:
        self.out += pieces

    def written(self, text: str) -> str:
        return html_entities.escape(text, quote=False)

    def block(self, tag: str, text: str, main: bool, attrs: str = "", closed: bool | None = None) -> None:
        """A block of text, with inline tags and odd white space now and then."""
        words = text.split(" ")
        if main:
            self.main.append(" ".join(text.split()))
        marked = [self.written(w) for w in words]
        if self.rng.random() < 0.4:
            at = self.rng.randrange(len(marked))
            kind = self.some("b", "em", "i", "code", "span", 'a href="/x"' if self.linked or not main else "strong")
            marked[at] = f"<{kind}>{marked[at]}</{kind.split()[0]}>"
        if self.rng.random() < 0.1:
            marked[0] = f"<b>{marked[0]}"
        gap = self.rng.choices([" ", "\n  ", " <br>"], [20, 1, 1])[0]
        end = f"</{tag}>" if (not self.sloppy or self.rng.random() < 0.5 or tag not in ("p", "li", "td")) and closed is not False else ""
        self.put(f"<{tag}{attrs}>", gap.join(marked) if self.rng.random() < 0.2 else " ".join(marked), end)

    def links(self, low=3, high=12) -> None:
        n = self.rng.randint(low, high)
        link = lambda: f'<a href="/{self.word()}">{" ".join(self.words(1, 4)).capitalize()}</a>'
        form = self.rng.random()
        if form < 0.6:
            self.put("<ul>", *(f"<li>{link()}{'' if self.sloppy else '</li>'}" for _ in range(n)), "</ul>")
        elif form < 0.8:
            self.put("<div>", self.some(" | ", " ", " · ").join(link() for _ in range(n)), "</div>")
        else:
            self.put(*(f"<p>{link()}</p>" for _ in range(n)))

    def boxed(self, tags: list[str], names: list[str], inner) -> None:
        tag = self.rng.choice(tags)
        self.put(f"<{tag}{self.attrs(*names) if tag == 'div' or self.rng.random() < 0.5 else ''}>")
        inner()
        self.put(f"</{tag}>")

    # What is not main text.

    def menu(self):
        self.boxed(["nav", "nav", "div", "div"], ["menu", "nav", "navbar", "navigation", "breadcrumbs", "links"], self.links)

    def header(self):
        def inner():
            self.block(self.some("h1", "p", "div", "h2"), " ".join(self.words(1, 5)), False, self.attrs("logo", "brand"))
            if self.rng.random() < 0.5:
                self.block("p", self.sentence(), False, self.attrs("tagline"))
            if self.rng.random() < 0.5:
                self.links()

        self.boxed(["header", "header", "div"], ["header", "masthead", "topbar", "head"], inner)

    def footer(self):
        def inner():
            if self.rng.random() < 0.5:
                self.links()
            text = f"{self.some('©', '©', 'Copyright', '')} {self.some('', '2021 ')}{self.word()} {self.some('·', '', '|')} {self.prose(0, 3)}"
            if self.rng.random() < 0.5:
                self.block("p", text.strip() or "©", False)
            else:
                self.put(self.written(text))

        self.boxed(["footer", "footer", "div"], ["footer", "foot", "bottom", "legal", "copyright"], inner)

    def sidebar(self):
        def inner():
            for _ in range(self.rng.randint(1, 3)):
                self.block(self.some("h2", "h3", "h4", "p"), " ".join(self.words(1, 4)), False)
                if self.rng.random() < 0.6:
                    self.links()
                else:
                    self.block("p", self.prose(1, 3), False)

        self.boxed(["aside", "aside", "div"], ["sidebar", "side", "widget", "related", "rail", "popular", "recommended"], inner)

    def advert(self):
        def inner():
            form = self.rng.random()
            if form < 0.5:
                self.put(self.written(self.prose(1, 3)))
            else:
                self.block("p", self.prose(1, 4), False)

        self.boxed(["div", "div", "div", "aside", "section"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"], inner)

    def notice(self):
        def inner():
            self.block(self.some("p", "p", "div", "h3"), self.prose(1, 3), False)
            if self.rng.random() < 0.6:
                self.put(f"<button>{self.word()}</button>")

        self.boxed(["div", "div", "section", "dialog", "aside"], ["cookie", "cookie-notice", "consent", "notice", "alert", "modal", "popup", "newsletter", "notification"], inner)

    def form(self):
        def inner():
            if self.rng.random() < 0.6:
                self.block(self.some("p", "h3", "legend"), self.prose(1, 2), False)
            for _ in range(self.rng.randint(1, 4)):
                self.put(f"<label>{' '.join(self.words(1, 4))}</label>", '<input type="text">')
            if self.rng.random() < 0.4:
                self.put("<select>", *(f"<option>{self.word()}" for _ in range(3)), "</select>")
            self.put(f"<button>{self.word()}</button>")

        self.boxed(["form"], ["search", "login", "signup", "contact", "subscribe"], inner)

    def comments(self):
        def one():
            tag = self.some("div", "li", "article")
            self.put(f"<{tag}{self.attrs('comment', 'reply')}>")
            if self.rng.random() < 0.7:
                self.block(self.some("h4", "p", "div", "header"), " ".join(self.words(1, 4)), False, self.attrs("author", "meta"))
            for _ in range(self.rng.randint(1, 3)):
                self.block("p", self.prose(1, 5), False)
            self.put(f"</{tag}>")

        def inner():
            if self.rng.random() < 0.7:
                self.block(self.some("h2", "h3"), " ".join(self.words(1, 3)), False)
            for _ in range(self.rng.randint(1, 6)):
                one()

        # Without a name nothing tells comments from the article.
        named, self.named = self.named, True
        tag = self.some("section", "div", "ol", "aside")
        name = self.some("comments", "comments", "comment-list", "discussion", "responses", "disqus", "replies")
        self.put(f'<{tag} {self.some("class", "id")}="{name}">')
        inner()
        self.put(f"</{tag}>")
        self.named = named

    def sharing(self):
        self.boxed(["div", "ul"], ["share", "social", "sharing", "follow"], lambda: self.links(2, 5))

    # Main text.

    def lines(self):
        """Many short paragraphs, often equal, or a few endless ones, as in verse, logs and tables of words."""
        long = self.rng.random() < 0.2
        text = " ".join(self.words(150, 600)) if long else " ".join(self.words(1, 4)).capitalize() + self.some(".", ".", "")
        for _ in range(self.rng.randint(1, 3) if long else self.rng.randint(3, 60)):
            self.block("p", text, True)
            if self.rng.random() < 0.5:
                text = self.some(self.sentence(1, 6), text, text)

    def article(self):
        if self.rng.random() < 0.12:
            self.lines()
        elif self.rng.random() < 0.85:
            heading = " ".join(self.words(1, 14)).capitalize() + self.some("", "", "!", "&&&")
            boxed = self.rng.random() < 0.2
            self.put("<header>" if boxed else "")
            self.block("h1" if self.rng.random() < 0.8 else "h2", heading, True)
            self.put("</header>" if boxed else "")
        for _ in range(self.some(1, 1, 2, 3, 5, 8, 14)):
            form = self.rng.random()
            if form < 0.72:
                self.block("p", self.prose(1, self.some(1, 3, 6, 10)), True, "" if self.rng.random() < 0.9 else self.attrs())
            elif form < 0.8:
                self.block(self.some("h2", "h3"), " ".join(self.words(1, 8)).capitalize(), True)
            elif form < 0.86:
                tag = self.some("ul", "ol")
                self.put(f"<{tag}>")
                for _ in range(self.rng.randint(2, 6)):
                    self.block("li", self.some(self.sentence(1, 6), self.prose(1, 2)), True)
                self.put(f"</{tag}>")
            elif form < 0.89:
                self.put("<blockquote>")
                self.block("p", self.prose(1, 3), True)
                self.put("</blockquote>")
            elif form < 0.91:
                self.block("pre", self.prose(1, 3), True)
            elif form < 0.93:
                self.put("<table>")
                for _ in range(self.rng.randint(2, 4)):
                    self.put("<tr>")
                    for _ in range(2):
                        self.block("td", " ".join(self.words(1, 3)), True)
                    self.put("</tr>")
                self.put("</table>")
            elif form < 0.96:
                text = self.prose(2, 4)
                self.main.append(" ".join(text.split()))
                self.put("<div>", self.written(text), "</div>")
            else:
                # Without a name nothing tells these from the text around.
                named, self.named = self.named, True
                self.some(self.advert, self.sharing, self.form, self.notice, self.sidebar)()
                self.named = named

    def page(self) -> tuple[str, str]:
        rng = self.rng
        self.put(self.some("<!DOCTYPE html>", ""), "<html><head><meta charset=utf-8><title>", self.sentence(), "</title>")
        self.put("<style>p{margin:0}</style>", '<script>var t="</p>";</script>', "</head><body>")
        wrapped = rng.randint(0, 2)
        self.put(*(f"<div{self.attrs()}>" for _ in range(wrapped)))
        form_page = rng.random() < 0.03
        self.put('<form action="/">' if form_page else "")
        for part in rng.sample([self.menu, self.header, self.advert, self.notice, self.form], rng.randint(0, 4)):
            part()
        shape = rng.random()
        open_, close = "", ""
        if shape < 0.45:
            open_, close = f"<article{self.attrs('post', 'article', 'entry')}>", "</article>"
        elif shape < 0.6:
            open_, close = f"<main{self.attrs('content')}>", "</main>"
        elif shape < 0.9:
            name = self.attrs("content", "main", "post", "entry", "article", "story")
            open_, close = f"<div{name}>", "</div>"
        elif shape < 0.95:
            open_, close = "<table><tr><td>", "</td></tr></table>"
        if shape < 0.95 and rng.random() < 0.3:
            open_, close = self.some(("<main>", "</main>"), ("<section>", "</section>"), (f"<div{self.attrs()}>", "</div>"))[0] + open_, close
        self.put(open_)
        if rng.random() < 0.94:
            self.article()
        if rng.random() < 0.15:
            self.comments()
        self.put(close)
        for part in rng.sample([self.sidebar, self.comments, self.advert, self.notice, self.form, self.sharing, self.menu], rng.randint(0, 4)):
            part()
        if rng.random() < 0.9:
            self.footer()
        self.put("</form>" if form_page else "", "</div>" * wrapped)
        if rng.random() < 0.8:
            self.put("</body></html>")
        return "".join(self.out), "\n".join(self.main)


def generated_pages(n: int, seed: int) -> list[tuple[str, str]]:
    """Pages of random layout with their main text."""
    rng = random.Random(seed)
    return [_Writer(rng).page() for _ in range(n)]
