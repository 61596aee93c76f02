r"""HTML main-text extraction by a tree-structured graphical model.

A page becomes its DOM tree; every element is a binary node (part of the main text or not). Node potentials come from
what the element shows by itself (tag, words of class, id and role, text length, link share, sentence signs), edge
potentials from how labels pass from parent to child by kind of tag. Messages go up to the root and down again
(sum-product, exact on a tree); an element's text is kept when its content marginal is over one half. Both kinds of
potentials are trained: counts over labelled pages, which a rule here generates (`labelled_pages`), since the pages
tables carry no labels; `train` takes any other labelled pages.

Output rules: character references are decoded, white space inside a block becomes one space, blocks are trimmed and
joined by one \n in page order. Script, style, template and comment contents are never text.

Defined results: null html counts as empty, an empty page gives an empty text; a page of any length is one unit, read in
time that grows with its length; bytes that are not UTF-8 become U+FFFD; an attribute's quote that is never closed is an
ordinary character; repeated rows give equal results; an empty table gives no row; other columns than page_id, url and
html are not looked at.
"""

from __future__ import annotations

import html as _html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import texts_of

#: Tags by role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noframes xmp".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option select button".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
KINDS = {t: k for k, ts in {"frame": "html body", "article": "article main", "part": "section div center td tr table tbody", "side": "nav aside footer header menu form dialog search button select option fieldset", "head": "head", "title": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol li dl dt dd", "text": "p blockquote pre figure figcaption"}.items() for t in ts.split()}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_PLAIN_ATTRIBUTES = re.compile(r"""(?:[^>"']|"[^"<>]*"|'[^'<>]*')*+>""")
_SIGN = re.compile(r"""[>"']""")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "parent", "marks", "own", "links", "signs", "mark")

    def __init__(self, tag: str, parent: int, marks: tuple[str, ...] = ()):
        self.tag, self.parent, self.marks, self.own, self.links, self.signs, self.mark = tag, parent, marks, 0, 0, 0, None


class _Attributes:
    """Finds where a tag ends. A quote opens a value only after "=", and one that is never closed opens nothing."""

    def __init__(self, page: str):
        self.page, self.unclosed = page, set()

    def end(self, at: int) -> tuple[int, int]:
        """(end of the attributes, first position after the tag) of the tag whose name ends at `at`."""
        m = _PLAIN_ATTRIBUTES.match(self.page, at)
        if m:
            return m.end() - 1, m.end()
        look = at
        while True:
            m = _SIGN.search(self.page, look)
            if not m:
                return len(self.page), len(self.page)
            sign, look = m.group(), m.end()
            if sign == ">":
                return look - 1, look
            back = look - 2
            while back > at and self.page[back].isspace() and look - back < 64:
                back -= 1
            if self.page[back] == "=" and sign not in self.unclosed:
                close = self.page.find(sign, look)
                if close < 0:
                    self.unclosed.add(sign)
                else:
                    look = close + 1


class _Open:
    """The stack of open elements with the places of each tag in it, so that closing looks at no element that stays."""

    def __init__(self):
        self.stack, self.at = [0], {}

    def push(self, tag: str, element: int) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, element))

    def top(self) -> int:
        return self.stack[-1][1] if len(self.stack) > 1 else 0

    def last(self, tag: str) -> int:
        spots = self.at.get(tag)
        return spots[-1] if spots else 0

    def close(self, tag: str, stops: tuple[str, ...]) -> None:
        """Close the innermost `tag` with all in it, unless one of the stops stands inside it."""
        k = self.last(tag)
        if k and all(self.last(s) <= k for s in stops):
            while len(self.stack) > k:
                self.at[self.stack.pop()[0]].pop()


def marks_of(attributes: str) -> tuple[str, ...]:
    """Words of class, id and role names of one or two words; a longer name describes its element, and no one word of it tells a part of a page."""
    names = (name for g in _MARKS.findall(attributes) for name in "".join(g).lower().split())
    words = (_WORD.findall(name) for name in names)
    return tuple(w for found in words if len(found) <= 2 for w in found)


def parse(page: str, mark: re.Pattern | None = None) -> tuple[list[Element], list[tuple[int, int, str]]]:
    """(elements in document order, texts as (element, block number, characters)); the root is element 0.

    mark: a pattern with one group; what it finds in an element's attributes becomes the element's `mark`.
    """
    nodes, texts, open_, block, at = [Element("#root", -1)], [], _Open(), 0, 0
    attributes = _Attributes(page)

    def text(raw: str) -> None:
        if raw:
            value = _html.unescape(raw)
            texts.append((open_.top(), block, value))
            node = nodes[open_.top()]
            n = len(value.strip())
            node.own += n
            if any(x and x[0] == "a" for x in open_.stack[-3:]):
                node.links += n
            node.signs += value.count(".") + value.count(",")

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            return nodes, texts
        text(page[at : m.start()])
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        stop, at = attributes.end(at)
        given = page[m.end() : stop]
        if m.group(1):
            if tag in BLOCK:
                block += 1
            open_.close(tag, () if tag in ("html", "body", "article", "main", "div", "section", "nav", "footer", "aside", "header", "form", "table", "ul", "ol") else ("div", "article", "section", "table", "main", "body", "td", "th"))
            continue
        if tag in CLOSES_P:
            open_.close("p", ("button", "table", "td", "th", "article", "div", "section", "li"))
        if tag in ("li", "dt", "dd", "option", "tr"):
            open_.close(tag, ("ul", "ol", "dl", "table", "select"))
        if tag in ("td", "th"):
            open_.close("td", ("tr", "table"))
            open_.close("th", ("tr", "table"))
        if tag in BLOCK:
            block += 1
        elif tag == "br":
            texts.append((open_.top(), block, " "))
        marks = marks_of(given) if given else ()
        nodes.append(Element(tag, open_.top(), marks))
        if mark is not None and (found := mark.search(given)):
            nodes[-1].mark = found.group(1)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        open_.push(tag, len(nodes) - 1)


def _totals(nodes: list[Element]) -> list[tuple[int, int, int]]:
    """(characters, linked characters, sentence signs) of each element with all below it."""
    total = [[x.own, x.links, x.signs] for x in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        up = total[nodes[k].parent]
        for j in range(3):
            up[j] += total[k][j]
    return total


def features(x: Element, total) -> list[str]:
    n, linked, signs = total
    size = 0 if n == 0 else 1 if n < 25 else 2 if n < 80 else 3 if n < 400 else 4
    share = 0 if not linked else 1 if linked < n / 4 else 2 if linked < 3 * n / 4 else 3
    return [f"tag={x.tag}", f"size={size} links={share} signs={min(3, signs)}", *(f"mark={w}" for w in x.marks)]


def kind(tag: str) -> str:
    return KINDS.get(tag, "inline")


def labels_of(nodes: list[Element]) -> list[int]:
    """1 where an element is content: its own mark, else its parent's."""
    labels = [0]
    for x in nodes[1:]:
        labels.append(labels[x.parent] if x.mark is None else int(x.mark))
    return labels


def train(pages: list[tuple[str, str]]) -> dict:
    """Potentials from labelled pages: (html, label attribute) where every element inside one that carries data-y="1" is content until data-y="0"."""
    node, edge, prior = {}, {}, np.ones(2)
    for page, mark in pages:
        nodes, _ = parse(page, re.compile(rf"{mark}=\"([01])\""))
        labels, total = labels_of(nodes), _totals(nodes)
        for k, x in enumerate(nodes):
            y = labels[k]
            prior[y] += 1
            for f in features(x, total[k]):
                node.setdefault(f, np.full(2, 0.5))[y] += 1
            if k:
                edge.setdefault(kind(x.tag), np.full((2, 2), 0.5))[labels[x.parent], y] += 1
    return {
        "node": {f: (1.0 if f[0] == "m" else 0.5) * (np.log(c / prior) - np.log(c.sum() / prior.sum())) for f, c in node.items()},  # tag and size overlap: half weight each
        "edge": {k: np.log(c / c.sum(axis=1, keepdims=True)) for k, c in edge.items()},
    }


def marginals(nodes: list[Element], model: dict, given: int = 0) -> np.ndarray:
    """P(content) of each element by one upward and one downward pass of messages; given: an element that is known to be content, with what holds it."""
    n, total = len(nodes), _totals(nodes)
    phi = np.zeros((n, 2))
    for k, x in enumerate(nodes):
        for f in features(x, total[k]):
            value = model["node"].get(f)
            if value is not None:
                phi[k] += value
    phi[0] = [0.0, -8.0]
    while given > 0:
        phi[given] = [-40.0, 0.0]
        given = nodes[given].parent
    flat = np.log(np.full((2, 2), 0.5))
    edges = [model["edge"].get(kind(x.tag), flat) for x in nodes]
    belief, up = phi.tolist(), [(0.0, 0.0)] * n
    pair = [e.tolist() for e in edges]
    add = _log_add
    for k in range(n - 1, 0, -1):
        e, b = pair[k], belief[k]
        up[k] = (add(e[0][0] + b[0], e[0][1] + b[1]), add(e[1][0] + b[0], e[1][1] + b[1]))
        parent = belief[nodes[k].parent]
        parent[0] += up[k][0]
        parent[1] += up[k][1]
    for k in range(1, n):
        p, e = belief[nodes[k].parent], pair[k]
        a, b = p[0] - up[k][0], p[1] - up[k][1]
        belief[k][0] += add(a + e[0][0], b + e[1][0])
        belief[k][1] += add(a + e[0][1], b + e[1][1])
    b = np.array(belief)
    return 1 / (1 + np.exp(np.clip(b[:, 0] - b[:, 1], -500, 500)))


def _log_add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + float(np.log1p(np.exp(low - high))) if high - low < 40 else high


def extract(page: str, model: dict) -> str:
    """The page's main text."""
    nodes, texts = parse(page)
    if not texts:
        return ""
    p = marginals(nodes, model)
    if p.max() <= 0.5:  # no frame in sight: what is likely to be content if the page's body is
        body = next((k for k, x in enumerate(nodes) if x.tag == "body"), 0) or next((k for k, x in enumerate(nodes) if x.parent == 0 and k), 0)
        p = marginals(nodes, model, body)
        p[0] = p[body]
    blocks: dict[int, list[str]] = {}
    for node, block, value in texts:
        if p[node] > 0.5:
            blocks.setdefault(block, []).append(value)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def labelled_pages(count: int = 1500, seed: int = 3) -> list[tuple[str, str]]:
    """Labelled training pages by rule: an article in a semantic or class-named frame, with the furniture of web pages around and inside it, and a fifth of pages with no such frame."""
    rng = random.Random(seed)

    def words(a, b):
        return " ".join("".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))

    def sentence(a, b):
        return words(a, b).capitalize() + rng.choice("...?!")

    def links(n):
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 2)}</a></li>' for _ in range(n))

    def paragraph():
        body = " ".join(sentence(4, 14) for _ in range(rng.choice([1, 1, 2, 3, 6]))) if rng.random() < 0.85 else words(1, 4)
        if rng.random() < 0.3:
            body = body.replace(" ", rng.choice([" <b>x</b> ", " <i>y</i> ", ' <a href="/q">see</a> ', "<br>"]), 1)
        return rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<p><b>{}</b></p>"]).format(body)

    def content():
        parts = [f"<h1>{words(2, 9)}</h1>"] if rng.random() < 0.9 else []
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            r = rng.random()
            parts.append(paragraph() if r < 0.75 else f"<h2>{words(1, 6)}</h2>" if r < 0.85 else f"<ul><li>{sentence(3, 9)}</li><li>{sentence(2, 9)}</li></ul>" if r < 0.93 else f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>" if r < 0.97 else f"<figure><img src=x><figcaption>{sentence(3, 9)}</figcaption></figure>")
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            parts.insert(rng.randint(0, len(parts)), junk())
        if rng.random() < 0.2:
            parts.insert(rng.randint(0, len(parts)), named(paragraph(), True))
        return "".join(parts)

    def junk():
        name = rng.choice("ad ads advert advertisement banner sponsor promo sidebar widget related share social cookie notice consent popup newsletter subscribe comments comment comment-list respond menu breadcrumb pagination footer header login search".split())
        body = rng.choice([sentence(3, 12), f"<p>{sentence(3, 12)}</p>", f"<ul>{links(3)}</ul>", f"<h3>{words(1, 3)}</h3><p>{sentence(4, 14)}</p><p>{sentence(4, 9)}</p>"])
        tag = rng.choice(["div", "div", "div", "section", "aside", "p", "ul", "form"])
        return f'<{tag} data-y="0" {rng.choice(["class", "id", "class"])}="{name}">{body}</{tag}>'

    def named(body, content):
        """A part whose name has several words, junk words among them."""
        some = "social proof ad free related work share study comment notice header menu page login search tag".split()
        return f'<div data-y="{int(content)}" class="{"-".join(rng.sample(some, 3))}">{body}</div>'

    def plain(share):
        """A page without a frame that names itself: bare body, unnamed divs, or a table for layout."""
        top, bottom = f'<ul data-y="0">{links(rng.randint(2, 6))}</ul>', f'<div data-y="0">&copy; {words(1, 3)} <a href="/i">{words(1, 1)}</a></div>'
        text = "".join(paragraph() for _ in range(rng.randint(2, 7)))
        row = " ".join(f'<a href="/{words(1, 1)}">{words(1, 2)}</a>' for _ in range(rng.randint(2, 6)))
        if share < 0.35:
            return f'<body data-y="1">{top if rng.random() < 0.4 else ""}{content() if rng.random() < 0.5 else text}{bottom if rng.random() < 0.4 else ""}</body>'
        if share < 0.7:
            return f'<body><div data-y="0">{top}</div><div data-y="1">{content()}{text}</div>{bottom}</body>'
        return f'<body><table><tr><td data-y="0">{row if rng.random() < 0.5 else top}</td><td data-y="1">{content() if rng.random() < 0.4 else ""}{text}</td></tr></table>{bottom}</body>'

    out = []
    for k in range(count // 4):
        out.append((f"<html><head><title>{words(2, 6)}</title></head>{plain(k % 20 / 20)}</html>", "data-y"))
    for _ in range(count):
        frame = rng.choice(["article", "article", "article", "main", "div class='content'", "div id='main-content'", "div class='post entry'", "div class='article body'", "section class='story'"])
        before = [f"<nav><ul>{links(rng.randint(2, 8))}</ul></nav>", f"<header><a href='/'>{words(1, 2)}</a><p>{sentence(2, 6)}</p></header>", f"<div class='nav menu'><ul>{links(4)}</ul></div>", junk(), junk()]
        after = [f"<footer>&copy; {words(1, 3)} &middot; {sentence(3, 9)}</footer>", f"<aside><h3>{words(1, 3)}</h3><p>{sentence(4, 12)}</p></aside>", f"<form><label>{words(1, 3)}</label><input><button>{words(1, 1)}</button></form>", f"<div class='comments'><div class='comment'><p>{sentence(3, 15)}</p></div><div class='comment'><p>{sentence(3, 15)}</p></div></div>", junk(), junk()]
        rng.shuffle(before)
        rng.shuffle(after)
        close = frame.split()[0]
        body = "".join(before[: rng.randint(0, 4)]) + f'<{frame} data-y="1">{content()}</{close}>' + "".join(after[: rng.randint(0, 5)])
        if rng.random() < 0.3:
            body = f"<div class='{rng.choice(['wrapper', 'page', 'container', 'layout'])}'>{body}</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style><script>x</script></head><body>{body}</body></html>", "data-y"))
    return out


@lru_cache(maxsize=1)
def default_model() -> dict:
    return train(labelled_pages())


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _run(model: dict):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                texts = [extract(h, model) for h in texts_of(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)

    return run


def extract_pages(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    picked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return picked.mapInArrow(_run(model or default_model()), "page_id long, url string, text string, n_chars long")


def op5_html_extract(spark, sf_dir):
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
