"""Main text of web pages by a graphical model on the DOM tree.

Every element is a node with a hidden state, content or not. A node potential
weighs features of the element (its kind, words in class and id, text and link
shares of its subtree); an edge potential, by kind of child, couples parent
and child. Sum-product messages go up from the leaves and down from the root
and yield each element's marginal; text of elements over one half is kept. The
weights are learnt by gradient steps on the exact likelihood of labelled
pages, in which elements of the main text carry the attribute ``data-main``.
:func:`labelled_pages` makes a bounded set of them from layout rules.

Defined results: null or empty html gives an empty text; rows are judged one
by one, so repeated rows give repeated results; an empty table gives an empty one;
elements may be nested as deep as they like; time and memory go in proportion to
the length of a page; a tag that is never closed by ``>`` is text; script, style, textarea, title and iframe hold raw text, which is skipped to their
end tag or the page's end, as browsers do; all other elements are nodes (a
self-closed svg is none);
columns of the input stay, but for one named like the result.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|iframe)(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<svg(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*/>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>"
    r"|<[!?/][^>]*>"
    r"|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big button canvas cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var del svg g path use defs circle ellipse line polygon polyline rect".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WALLS = frozenset("ul ol dl table td th div section article main aside nav body html".split())

#: Kinds of elements, told by their tag.
_KINDS = {
    "article main": 0, "section": 1, "div center": 2, "p": 3, "h1 h2 h3 h4 h5 h6": 4, "ul ol dl": 5, "li dt dd": 6, "nav menu": 7, "header": 8, "footer": 9, "aside": 10, "form fieldset input label": 11,
    "table tbody thead tfoot tr td th caption": 12, "blockquote pre figure figcaption": 13, "a": 14, "body html": 15, "head": 16, "dialog": 17,
}
_KIND = {tag: k for tags, k in _KINDS.items() for tag in tags.split()}
_INLINE_KIND, _OTHER_KIND, KINDS = 18, 19, 20
#: Words of class, id and role attributes, by what they hint at.
_HINTS = (
    "ad ads advert advertisement advertising sponsor sponsored promo promotion banner adsense",
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toc tabs",
    "sidebar side widget related rail recommended trending popular complementary",
    "footer foot copyright legal colophon contentinfo",
    "header masthead topbar head logo",
    "cookie cookies consent notice alert popup modal newsletter subscribe overlay gdpr warning dialog",
    "comment comments reply replies discussion disqus respond feedback",
    "share social sharing tags meta byline tools toolbar search form login",
    "content article post entry story main body text maincontent articlebody prose",
)
_HINT = {word: k for k, words in enumerate(_HINTS) for word in words.split()}
_SPLIT = re.compile(r"[^a-z]+")
FEATURES = KINDS + len(_HINTS) + 6
EDGES = 3


class Page:
    """Elements of one page, and its text blocks as runs of (element, text)."""

    __slots__ = ("kinds", "hints", "parents", "depths", "inline", "own", "stops", "blocks", "gold", "opened")

    def __init__(self, source: str):
        self.kinds, self.hints, self.parents, self.depths, self.inline = [15], [()], [-1], [0], [0]
        self.own, self.stops, self.gold = [0], [0], [False]
        self.blocks: list[list[tuple[int, str]]] = [[]]
        stack, tags, self.opened = [0], ["html"], Counter()
        end = source.rfind(">") + 1
        for found in _TOKEN.finditer(source):
            if found.start() >= end:  # no tag ends any more; looking on at each "<" would take the square of the length
                self._text(stack[-1], source[found.start() :].partition("<!--")[0])
                break
            raw, slash, tag, attributes, slash2, tag2, attributes2, text = found.groups()
            if text is not None:
                self._text(stack[-1], text)
                continue
            if raw is not None:
                continue
            tag = tag or tag2
            if tag is None:
                continue
            tag, attributes = tag.lower(), attributes if attributes is not None else attributes2
            if slash or slash2:
                self._close(tag, stack, tags)
            else:
                self._open(tag, attributes or "", stack, tags)

    def _text(self, node: int, text: str) -> None:
        text = entities.unescape(text) if "&" in text else text
        self.blocks[-1].append((node, text))
        self.own[node] += len(text) - text.count(" ") - text.count("\n")
        self.stops[node] += text.count(".") + text.count(",")

    def _cut(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _close(self, tag: str, stack: list[int], tags: list[str]) -> None:
        if tag in _VOID:
            if tag == "br":
                self.blocks[-1].append((stack[-1], " "))
            return
        if tag not in _INLINE:
            self._cut()
        if not self.opened[tag]:
            return
        for at in range(len(tags) - 1, 0, -1):
            if tags[at] == tag:
                self._drop(at, stack, tags)
                return
            if tags[at] in _WALLS and (tag in _INLINE or tag == "p"):
                return

    def _drop(self, at: int, stack: list[int], tags: list[str]) -> None:
        self.opened.subtract(tags[at:])
        del tags[at:], stack[at:]

    def _open(self, tag: str, attributes: str, stack: list[int], tags: list[str]) -> None:
        if tag == "body" and self.opened[tag] or tag == "html":
            return
        if tag == "br":
            self.blocks[-1].append((stack[-1], " "))
            return
        if tag not in _INLINE and tag not in ("img", "wbr", "input", "embed"):
            self._cut()
        ends = ("p",) if tag in _CLOSES_P else _CLOSES.get(tag, ())
        if tag in ("body",):
            ends = ("head",)
        for at in range(len(tags) - 1, 0, -1) if any(self.opened[e] for e in ends) else ():
            if tags[at] in ends:
                self._drop(at, stack, tags)
                if tag not in ("tr", "dt", "dd"):
                    break
            elif tags[at] in _WALLS:
                break
        if tag in _VOID:
            return
        kind = _KIND.get(tag, _INLINE_KIND if tag in _INLINE else _OTHER_KIND)
        node = len(self.kinds)
        self.kinds.append(kind)
        self.hints.append(_hints(attributes) if "=" in attributes else ())
        self.parents.append(stack[-1])
        self.depths.append(self.depths[stack[-1]] + 1)
        self.inline.append(1 if tag in _INLINE else 0)
        self.own.append(0)
        self.stops.append(0)
        self.gold.append("data-main" in attributes)
        stack.append(node)
        tags.append(tag)
        self.opened[tag] += 1

    def text(self, kept: np.ndarray) -> str:
        """Blocks of the elements that are kept."""
        out = []
        for block in self.blocks:
            if line := " ".join("".join(text for node, text in block if kept[node]).split()):
                out.append(line)
        return "\n\n".join(out)


_HINTS_SEEN: dict[str, tuple[int, ...]] = {}


def _hints(attributes: str) -> tuple[int, ...]:
    """Which hints the class, id and role hold."""
    if attributes not in _HINTS_SEEN:
        if len(_HINTS_SEEN) > 50_000:
            _HINTS_SEEN.clear()
        words = {w for m in _ATTRIBUTE.finditer(attributes) for w in _SPLIT.split((m[2] or m[3] or m[4] or "").lower())}
        _HINTS_SEEN[attributes] = tuple(sorted({_HINT[w] for w in words if w in _HINT}))
    return _HINTS_SEEN[attributes]


class Forest:
    """Pages side by side: features, edge kinds, and the elements of each depth."""

    def __init__(self, pages: list[Page]):
        base = np.cumsum([0, *(len(p.kinds) for p in pages)])
        self.base, n = base, int(base[-1])
        self.parents = np.concatenate([np.array(p.parents) + b for p, b in zip(pages, base, strict=False)]) if pages else np.zeros(0, int)
        depths = np.concatenate([p.depths for p in pages]) if pages else np.zeros(0, int)
        kinds = np.concatenate([p.kinds for p in pages]) if pages else np.zeros(0, int)
        inline = np.concatenate([p.inline for p in pages]) if pages else np.zeros(0, int)
        order = np.argsort(depths, kind="stable")
        self.levels = np.split(order, np.searchsorted(depths[order], np.arange(1, depths.max() + 1))) if n else []
        own = np.concatenate([p.own for p in pages]).astype(float) if pages else np.zeros(0)
        stops = np.concatenate([p.stops for p in pages]).astype(float) if pages else np.zeros(0)
        total, linked, marks = own.copy(), np.where(kinds == 14, own, 0.0), stops.copy()
        for level in self.levels[:0:-1]:
            linked[level] = np.where(kinds[level] == 14, total[level], linked[level])
            for column in (total, linked, marks):
                np.add.at(column, self.parents[level], column[level])
        x = np.zeros((n, FEATURES), np.float64)
        x[np.arange(n), kinds] = 1
        rows = np.array([k + b for p, b in zip(pages, base, strict=False) for k, h in enumerate(p.hints) for _ in h], int)
        x[rows, KINDS + np.array([h for p in pages for hs in p.hints for h in hs], int)] = 1
        more = KINDS + len(_HINTS)
        x[:, more] = 1
        x[:, more + 1] = np.log1p(total) / 5
        x[:, more + 2] = linked / np.maximum(total, 1)
        x[:, more + 3] = np.minimum(marks / np.maximum(total, 1) * 10, 2)
        x[:, more + 4] = total == 0
        x[:, more + 5] = np.minimum(depths, 10) / 10
        self.x = x
        # Kind of the edge to the parent: inline child, section-like child, any other.
        self.edge = np.where(inline == 1, 0, np.where(np.isin(kinds, (0, 1, 2, 7, 8, 9, 10, 11, 15)), 1, 2))


def marginals(forest: Forest, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product up and down: P(content) of elements; P(parent, child) of edges (4 columns, in order of states)."""
    n = len(forest.parents)
    local = np.zeros((n, 2))
    local[:, 1] = forest.x @ node
    pair = edge.reshape(EDGES, 2, 2)[forest.edge]  # element, parent's state, own state
    up, message = local.copy(), np.zeros((n, 2))
    for level in forest.levels[:0:-1]:
        message[level] = np.logaddexp(pair[level, :, 0] + up[level, None, 0], pair[level, :, 1] + up[level, None, 1])
        np.add.at(up, forest.parents[level], message[level])
    both, joint = up.copy(), np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        rest = both[forest.parents[level]] - message[level]  # the parent's belief without this child
        joint[level] = rest[:, :, None] + pair[level] + up[level, None, :]
        both[level] = np.logaddexp(joint[level, 0], joint[level, 1])
    top = np.maximum(both.max(1, keepdims=True), -1e300)
    both = np.exp(both - top)
    joint = np.exp(joint - joint.max((1, 2), keepdims=True))
    return both[:, 1] / both.sum(1), (joint / joint.sum((1, 2), keepdims=True)).reshape(n, 4)


def labelled_pages(count: int = 300, seed: int = 4) -> list[str]:
    """Pages made by layout rules; elements of the main text carry ``data-main``."""
    r = random.Random(seed)
    parts = "an ber chi dor el fi gu ha il jo ka lu mi no os pra qui re st tu un vo wen xi yel zu é ß ñ ö".split()
    word = lambda: "".join(r.choices(parts, k=r.randint(1, 4)))

    def phrase(low=1, high=40):
        style = r.random()
        joint = " | " if style < 0.06 else "%% " if style < 0.1 else " "
        words = [word() for _ in range(r.randint(low, high))]
        if style > 0.9:
            words = [w if r.random() < 0.6 else str(r.randint(0, 10**9)) for w in words]
        mark = r.choice([".", ".", ".", ",", "!", ""]) if style >= 0.1 else ""
        return (joint.join(w + (r.choice([",", "."]) if r.random() < 0.12 else "") for w in words) + mark).capitalize()

    def inside(low=1, high=60):
        text = phrase(low, high)
        tag = r.choice(["b", "em", "a href='#'", "i", "span", "strong", "code"])
        return text if r.random() < 0.6 else f"{text} <{tag} data-main>{phrase(1, 6)}</{tag.split()[0]}> {phrase(1, 20)}"

    def paragraph():
        kind = r.random()
        if kind < 0.1:
            return f"<p data-main><b data-main>{phrase()}<br><p data-main>{phrase()}</p>"
        if kind < 0.16:
            return "<ul data-main>" + "".join(f"<li data-main>{inside(1, 12)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.2:
            return f"<blockquote data-main><p data-main>{inside()}</p></blockquote>"
        if kind < 0.23:
            return f"<pre data-main>{phrase()}</pre>"
        if kind < 0.27:
            return "<table data-main>" + "".join(f"<tr data-main><td data-main>{word()}</td><td data-main>{r.randint(0, 99)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.34:
            return f"<h{r.randint(2, 4)} data-main>{phrase(1, 8)}</h{r.randint(2, 4)}>"
        if kind < 0.38:
            return f"<div class='{r.choice(_HINTS[0].split() + _HINTS[7].split()[:3])}'>{phrase(1, 15)}</div>"
        return f"<p data-main>{inside(1, 60)}" + ("</p>" if r.random() < 0.9 else "")

    def links(tag="li"):
        return "".join(f"<{tag}><a href='/{word()}'>{phrase(1, r.choice([1, 3, 8]))}</a></{tag}>" for _ in range(r.randint(1, 8)))

    def clutter(place):
        hint = lambda k: r.choice(_HINTS[k].split())
        some = {
            "nav": lambda: f"<nav>{'<ul>' + links() + '</ul>' if r.random() < 0.7 else links('span')}</nav>",
            "menu": lambda: f"<div class='{hint(1)}'><ul>{links()}</ul></div>",
            "header": lambda: f"<header>{phrase(1, 8)}<a href='/'>{word()}</a></header>",
            "head": lambda: f"<div id='{hint(4)}'><p>{phrase(1, 12)}</p></div>",
            "ad": lambda: f"<div class='{hint(0)}'>{phrase(1, 40)}{'<p>' + phrase() + '</p>' if r.random() < 0.3 else ''}</div>",
            "side": lambda: f"<{(t := r.choice(['aside', 'div']))} class='{hint(2)}'><h3>{phrase(1, 4)}</h3><p>{phrase(1, 40)}</p><ul>{links()}</ul></{t}>",
            "aside": lambda: f"<aside>{phrase(1, 40)}</aside>",
            "notice": lambda: f"<div class='{hint(5)}'><p>{phrase(1, 30)}</p></div>",
            "form": lambda: f"<form><label>{phrase(1, 5)}</label><input><p>{phrase(1, 20)}</p></form>",
            "share": lambda: f"<div class='{hint(7)}'>{links('span')}</div>",
            "comments": lambda: f"<{(t := r.choice(['section', 'div', 'ul', 'ol']))} {r.choice(['id', 'class'])}='{hint(6)}'>" + "".join(f"<{(u := 'li' if t in ('ul', 'ol') else 'div')} class='comment'><p>{phrase(1, 50)}</p></{u}>" for _ in range(r.randint(1, 4))) + f"</{t}>",
            "footer": lambda: f"<footer>&copy; {word()} &middot; {phrase(1, 40)}{'<p>' + phrase() + '</p>' if r.random() < 0.3 else ''}</footer>",
            "foot": lambda: f"<div class='{hint(3)}'><p>{phrase(1, 20)}</p></div>",
        }
        names = {"top": ["nav", "menu", "header", "head", "ad", "notice"], "bottom": ["footer", "foot", "side", "aside", "comments", "share", "form", "ad", "notice"], "end": ["comments", "share", "ad", "form"]}[place]
        return "".join(some[n]() for n in r.sample(names, r.randint(0, 4 if place != "end" else 1)))

    pages = []
    for _ in range(count):
        body = f"<h1 data-main>{phrase(1, 15)}</h1>" * (r.random() < 0.85) + "".join(paragraph() for _ in range(r.choice([0, 1, 2, 4, 8, 14])))
        for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2, 3, 5])):  # wrappers
            body = f"<{(t := r.choice(['div', 'div', 'section']))}{r.choice(['', '', ' class=row', ' class=wrap', ' id=c1'])} data-main>{body}</{t}>"
        kind = r.random()
        hint = r.choice(_HINTS[8].split())
        if kind < 0.45:
            body = f"<article data-main>{body}{clutter('end')}</article>"
        elif kind < 0.6:
            body = f"<main data-main>{body}</main>" if r.random() < 0.5 else f"<main data-main><article data-main>{body}</article>{clutter('end')}</main>"
        elif kind < 0.85:
            body = f"<div {r.choice(['class', 'id'])}='{hint}' data-main>{body}{clutter('end')}</div>"
        elif kind < 0.93:
            body = f"<div data-main>{body}</div>" if r.random() < 0.7 else f"<section data-main>{body}</section>"
        page = f"<html><head><title>{phrase(1, 8)}</title><style>p{{}}</style></head><body data-main>{clutter('top')}{body}{clutter('bottom')}</body></html>"
        pages.append(page)
    for k in range(24):  # fragments, down to a word
        inner = "".join(f"<p data-main>{phrase(1, r.choice([1, 3, 30]))}</p>" for _ in range(r.randint(1, 2)))
        tag = ("article", "main", "div", "div")[k % 4]
        pages.append(inner if k < 4 else f"<{tag} data-main>{inner}</{tag}>" if k % 2 else f"<{tag} data-main>{phrase(1, 3)}{inner}</{tag}>")
    pages += [f"<nav><a href='/'>{word()}</a></nav>" for _ in range(3)] + [f"<div data-main>{'<div data-main>' * k}{phrase(1, 4)}{'</div>' * k}</div>" for k in (1, 4, 9, 30)]
    for k in (1, 2, 4, 9, 16, 30, 60):  # clutter under many wrappers, beside the main text
        for name in ("nav", "menu"):
            deep = f"{'<div data-main>' * k}<{'nav' if name == 'nav' else 'div'} class='{r.choice(_HINTS[1].split())}'><ul>{links()}</ul></{'nav' if name == 'nav' else 'div'}>{'</div>' * k}"
            inner = f"<p data-main>{phrase(10, 60)}</p>{deep}<p data-main>{phrase(10, 60)}</p>"
            pages.append(f"<body data-main><article data-main>{inner}</article></body>" if name == "nav" else f"<body data-main>{deep}<article data-main><p data-main>{phrase(10, 60)}</p></article></body>")
    return pages


class Model:
    """Weights of the potentials."""

    def __init__(self, node: np.ndarray, edge: np.ndarray):
        self.node, self.edge = node, edge

    def texts(self, sources: list[str | None], block: int = 400) -> list[str]:
        out = []
        for at in range(0, len(sources), block):
            pages = [Page(x or "") for x in sources[at : at + block]]
            forest = Forest(pages)
            kept = marginals(forest, self.node, self.edge)[0] > 0.5
            out += [p.text(kept[a:b]) for p, a, b in zip(pages, forest.base, forest.base[1:], strict=False)]
        return out


def train(pages: list[str], steps: int = 400, rate: float = 0.15, penalty: float = 1e-4) -> Model:
    """Maximum likelihood of labelled pages (a bounded list) by gradient steps with momentum estimates."""
    trees = [Page(x) for x in pages]
    forest = Forest(trees)
    gold = np.concatenate([np.array(p.gold, bool) for p in trees])
    gold[forest.base[:-1]] = True
    state = gold.astype(int)
    inner = np.flatnonzero(forest.parents >= np.repeat(forest.base[:-1], np.diff(forest.base)))
    pairs = np.zeros((len(gold), 4))
    pairs[inner, 2 * state[forest.parents[inner]] + state[inner]] = 1
    by_edge = np.zeros((EDGES, len(gold)))
    by_edge[forest.edge[inner], inner] = 1
    weights = np.zeros(FEATURES + EDGES * 4)
    mean, spread = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        one, two = marginals(forest, weights[:FEATURES], weights[FEATURES:])
        gradient = np.concatenate([forest.x.T @ (gold - one), (by_edge @ (pairs - two)).ravel()]) / len(gold) - penalty * weights
        mean, spread = 0.9 * mean + 0.1 * gradient, 0.99 * spread + 0.01 * gradient**2
        weights += rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Model(weights[:FEATURES], weights[FEATURES:])


def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))
    out = pages.drop(into)
    schema = out.withColumn(into, F.lit("")).schema

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                texts = [t for sources in arrays.pieces(batch.column(html_col), 400) for t in shared.value.texts(sources)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return out.mapInArrow(run, schema)


def op4_main_text(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
