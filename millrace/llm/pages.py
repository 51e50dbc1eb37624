"""Main text of a web page: a bidirectional LSTM labels every text block of the page in its context.

A page is read as the row of its leaf blocks, each with its tag path. The tag path and the words go to the
network as hashed vectors, with a few numbers; the recurrent layers see the whole page in both directions. The
network is numpy alone. It is trained when first used, with a fixed seed, on laid-out pages whose labels are known
because they are composed here: many kinds of containers, menus, notices, adverts, forms and comments around
articles of made-up words. No labels and no texts of the given pages are used.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import common

# Fixed values of the HTML standard: elements that begin a block, that hold nothing, that hold no markup.
BLOCKS = frozenset(
    ("address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6")
    + ("head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr", "ul")
)
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "template", "iframe", "noembed", "noframes"))
#: Of these, what has no end tag lasts to the end of the page; the others hold no text of their own only if they end.
ENDLESS = frozenset(("script", "style"))
#: An opening tag closes these, up to the stop elements.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset(("ul", "ol", "table", "select", "dl", "body", "html", "menu"))
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)?(\s*=\s*)?")
_VALUE = re.compile(r"[^\s>]*")
_NONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)


class Node:
    """An element on the way to a block: its parent, and which of its names are new on the way."""

    __slots__ = ("fresh", "parent", "size", "tag", "vector")

    def __init__(self, parent: Node | None, tag: str, fresh: tuple[str, ...], names: int):
        self.parent, self.tag, self.fresh, self.vector = parent, tag, fresh, None
        self.size = names + (parent.size if parent else 0)


@dataclass
class Block:
    path: Node
    text: str
    linked: int


class Source:
    """The signs of a page, each read once; what was looked for in vain is not looked for again."""

    def __init__(self, page: str):
        self.page = page
        self.gone: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """Attributes from ``at`` on, and where the tag ends: behind its ``>``, or at the end of the page.

        A quote opens a string only right behind the equals sign, and only if it is closed.
        """
        page, out = self.page, {}
        while True:
            m = _ATTRIBUTE.match(page, at)
            at = m.end()
            value = ""
            if m[2] and m[1]:
                quote = page[at : at + 1]
                close = self.find(quote, at + 1) if quote in ("'", '"') and quote else -1
                if close >= 0:
                    value, at = page[at + 1 : close], close + 1
                else:
                    v = _VALUE.match(page, at)
                    value, at = v[0], v.end()
            if m[1]:
                out.setdefault(m[1].lower(), value)
            elif at >= len(page) or page[at] == ">":
                return out, min(at + 1, len(page))
            elif m.end() == m.start():
                at += 1

    def behind(self, tag: str, at: int) -> int:
        """Behind the end tag of a raw element, or -1."""
        if tag in self.gone:
            return -1
        m = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(self.page, at)
        end = self.page.find(">", m.end()) if m else -1
        if end < 0:
            self.gone.add(tag)
        return end + 1 if end >= 0 else -1


class Stack:
    """Open elements, with the places of each name, so no end tag and no new block looks through all of them."""

    def __init__(self):
        self.nodes = [Node(None, "", (), 0)]
        self.tokens: list[tuple[str, ...]] = [()]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        self.seen: Counter[str] = Counter()

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        tokens = (tag, *names)
        fresh = tuple(t for t in dict.fromkeys(tokens) if not self.seen[t])
        self.seen.update(tokens)
        place = len(self.nodes)
        self.nodes.append(Node(self.nodes[-1], tag, fresh, len(tokens)))
        self.tokens.append(tokens)
        self.places.setdefault(tag, []).append(place)
        if tag in BLOCKS and tag != "p":
            self.blocks.append(place)
        if tag in SCOPE:
            self.scopes.append(place)

    def last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def pop(self) -> str:
        tag, place = self.nodes.pop().tag, len(self.nodes)
        self.seen.subtract(self.tokens.pop())
        self.places[tag].pop()
        for held in (self.blocks, self.scopes):
            if held and held[-1] == place:
                held.pop()
        return tag


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order; scripts, styles, comments and other elements that are not text are left out.

    Time is in proportion to the page, however deep or broken it is: every sign is read once, and an element is
    opened and closed once. A tag that never ends is dropped to the end of the page, as browsers do; a ``<`` that
    begins no tag is text.
    """
    page = page or ""
    source, stack = Source(page), Stack()
    out: list[Block] = []
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            out.append(Block(stack.nodes[-1], text, linked))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    def close(to: int) -> None:
        nonlocal links
        if stack.last(("p",)) >= to or (stack.blocks and stack.blocks[-1] >= to):
            flush()
        while len(stack.nodes) > to:
            links -= stack.pop() == "a"

    at = begin = 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            say(page[begin:at])
            end = source.find("-->", at + 4)
            at = begin = end + 3 if end >= 0 else len(page)
            continue
        if page[at + 1 : at + 2] in ("!", "?") and at + 1 < len(page):
            say(page[begin:at])
            end = source.find(">", at)
            at = begin = end + 1 if end >= 0 else len(page)
            continue
        ends = page.startswith("/", at + 1)
        m = _NAME.match(page, at + 1 + ends)
        if not m:
            at += 1
            continue
        say(page[begin:at])
        tag = m[0].lower()
        attributes, at = source.attributes(m.end())
        begin = at
        if ends:
            if stack.places.get(tag):
                close(stack.places[tag][-1])
            continue
        if tag in RAW:
            end = source.behind(tag, at)
            if end >= 0 or tag in ENDLESS:
                at = begin = end if end >= 0 else len(page)
                continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            ended = stack.last((*CLOSES.get(tag, ()), "p"))
            stops = stack.scopes if tag in CLOSES else stack.blocks
            if ended > (stops[-1] if stops else 0):
                close(ended)
        if tag in VOID:
            continue
        words = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).lower()
        names = tuple("." + w for w in re.split(r"[^a-z0-9]+", words) if w)
        if "hidden" in attributes or _NONE.search(attributes.get("style", "")):
            names += (".hidden",)
        stack.push(tag, names)
        links += tag == "a"
    say(page[begin:])
    flush()
    return out


PATH, WORD, NUMBERS = 64, 32, 8
INPUT = PATH + WORD + NUMBERS
_VECTORS: dict[str, np.ndarray] = {}


def _vector(name: str) -> np.ndarray:
    """A fixed random vector for each element and name."""
    got = _VECTORS.get(name)
    if got is None:
        if len(_VECTORS) > 50_000:
            _VECTORS.clear()
        got = _VECTORS[name] = np.random.default_rng(xxhash.xxh64_intdigest(name)).standard_normal(PATH).astype(np.float32) / 4
    return got


def _path_vector(node: Node) -> np.ndarray:
    """Sum of the vectors of all names on the way, each once; the last element counts again.

    A node adds its new names to the sum of its parent, so a path costs no more for being deep.
    """
    way = []
    at: Node | None = node
    while at is not None and at.vector is None:
        way.append(at)
        at = at.parent
    total = np.zeros(PATH, np.float32) if at is None else at.vector
    for step in reversed(way):
        total = total.copy()
        for name in step.fresh:
            total += _vector(name)
        step.vector = total
    return total + _vector(">" + node.tag)


def features(found: list[list[Block]]) -> np.ndarray:
    """A row for each block of all pages, one page after the other."""
    flat = [b for page in found for b in page]
    x = np.zeros((len(flat), INPUT), np.float32)
    if not flat:
        return x
    for i, b in enumerate(flat):
        x[i, :PATH] = _path_vector(b.path)
    w = common.words(pa.array([b.text for b in flat]), lower=True)
    h = common.hashes(w.distinct)
    cell = (h % np.uint64(WORD)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    owner = w.owners()
    n = np.maximum(np.diff(w.starts), 1)
    x[:, PATH : PATH + WORD] = np.bincount(owner * WORD + cell[w.codes], sign[w.codes], minlength=len(flat) * WORD).reshape(-1, WORD) / n[:, None]
    size = np.array([len(b.text) for b in flat])
    number = x[:, PATH + WORD :]
    number[:, 0] = np.log1p(size) / 5
    number[:, 1] = [b.linked / len(b.text) for b in flat]
    number[:, 2] = np.log1p(n) / 4
    number[:, 3] = [sum(b.text.count(c) for c in ".,;:?!") / len(b.text) * 10 for b in flat]
    number[:, 4] = [b.text[-1] in ".?!…\"" for b in flat]
    number[:, 5] = [b.path.size / 10 for b in flat]
    pos = np.concatenate([np.arange(len(page)) / max(len(page) - 1, 1) for page in found if page])
    number[:, 6] = pos
    number[:, 7] = size > 200
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """One bidirectional LSTM layer and a logistic output per block."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {f"{n}{d}": v for d in "fb" for n, v in (("W", init(INPUT, 4 * hidden)), ("U", init(hidden, 4 * hidden)), ("c", np.zeros(4 * hidden, np.float32)))}
        self.p |= {"V": init(2 * hidden, 1)[:, 0], "v": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Outputs (time, batch, hidden) of one direction; padding passes the state on."""
        steps, batch = mask.shape
        h = np.zeros((batch, self.h), np.float32)
        c = np.zeros_like(h)
        pre = x @ self.p["W" + d] + self.p["c" + d]
        out = np.zeros((steps, batch, self.h), np.float32)
        memo = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.p["U" + d]
            i, f, o = (_sigmoid(z[:, k * self.h : (k + 1) * self.h] + (k == 1)) for k in range(3))
            g = np.tanh(z[:, 3 * self.h :])
            m = mask[t][:, None]
            new_c = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(new_c)
            new_h = m * (o * tc) + (1 - m) * h
            if keep:
                memo.append((t, i, f, o, g, c, h, tc, m))
            h, c = new_h, new_c
            out[t] = h
        return out, memo

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, hb = (self._run(x, mask, d, False)[0] for d in "fb")
        return np.concatenate((hf, hb), 2) @ self.p["V"] + self.p["v"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate((runs["f"][0], runs["b"][0]), 2)
        error = (_sigmoid(both @ self.p["V"] + self.p["v"]) - y) * mask / mask.sum()
        grad = {"V": np.tensordot(both, error, ((0, 1), (0, 1))), "v": error.sum(keepdims=True)[0]}
        dout = error[:, :, None] * self.p["V"]
        for d, part in (("f", dout[:, :, : self.h]), ("b", dout[:, :, self.h :])):
            u = self.p["U" + d]
            dz_all = np.zeros((*mask.shape, 4 * self.h), np.float32)
            du = np.zeros_like(u)
            dh = np.zeros((mask.shape[1], self.h), np.float32)
            dc = np.zeros_like(dh)
            for t, i, f, o, g, c, h, tc, m in reversed(runs[d][1]):
                dh = dh + part[t]
                live = dh * m
                dcell = (dc * m) + live * o * (1 - tc * tc)
                dz = np.concatenate((dcell * g * i * (1 - i), dcell * c * f * (1 - f), live * tc * o * (1 - o), dcell * i * (1 - g * g)), 1)
                dz_all[t] = dz
                du += h.T @ dz
                dh = dz @ u.T + dh * (1 - m)
                dc = dcell * f + dc * (1 - m)
            grad |= {"U" + d: du, "W" + d: np.tensordot(x, dz_all, ((0, 1), (0, 1))), "c" + d: dz_all.sum((0, 1))}
        return grad


def _padded(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(a) for a in x)
    out = np.zeros((steps, len(x), INPUT), np.float32)
    mask = np.zeros((steps, len(x)), np.float32)
    for i, a in enumerate(x):
        out[: len(a), i] = a
        mask[: len(a), i] = 1
    return out, mask


#: Marks blocks of the article in composed pages; taken out before features are made.
MARK = ""


class Composer:
    """Pages with known labels."""

    # Names that sites give to containers of each kind.
    MAIN = ("article", "main", "div.content", "div.post", "div.entry-content", "div.article-body", "div.story", "section.post-content", "div#content", "div#main", "div.text", "td.content", "div.page", "section")
    MENU = ("nav", "div.menu", "ul.nav", "div.navbar", "div#navigation", "div.breadcrumb", "nav.main-nav", "div.topbar", "div.nav")
    SIDE = ("aside", "div.sidebar", "div#sidebar", "div.widget", "div.related", "section.related-posts", "aside.more", "div.popular", "div.tags")
    ADVERT = ("div.ad", "div.ads", "div.advert", "div.banner", "div.sponsored", "div.promo", "aside.ad", "div.advertisement")
    NOTICE = ("div.cookie-notice", "div.notice", "div.alert", "div.consent", "div.newsletter", "div.popup", "div.modal", "div.subscribe", "div.gdpr", "section.notice")
    FOOT = ("footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.bottom")
    HEAD = ("header", "div.header", "div#header", "div.masthead", "header.site-header", "div.logo")
    COMMENT = ("section.comments", "div.comments", "div#comments", "ol.comment-list", "div.discussion", "div.replies")
    SHARE = ("div.share", "div.social", "ul.share-links", "div.toolbar")
    LABELS = ("Home", "About", "Contact", "News", "Login", "Sign up", "Search", "Share", "Reply", "Subscribe", "Accept", "Privacy", "Terms", "Next", "Previous", "More", "Menu", "Archive", "Tags", "Cookie settings")

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        self.syllables = ["".join(self.r.choice(list(a), 1)[0] for a in (("b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "th", "v", "w", ""), ("a", "e", "i", "o", "u", "ai", "ou", "é"), ("", "", "n", "r", "s", "t", "l"))) for _ in range(120)]

    def one(self, *of):
        return of[self.r.integers(len(of))]

    def some(self, low: int, high: int) -> int:
        return int(self.r.integers(low, high + 1))

    def prose(self, low: int, high: int) -> str:
        words = ["".join(self.one(*self.syllables) for _ in range(self.some(1, 4))) for _ in range(self.some(low, high))]
        out = [(w.capitalize() if i == 0 or self.r.random() < 0.08 else w) + (self.one(",", ".", "") if self.r.random() < 0.15 else "") for i, w in enumerate(words)]
        return " ".join(out) + self.one(".", ".", ".", "", "!")

    def wrap(self, name: str, inner: str) -> str:
        tag, sign, label = re.fullmatch(r"([a-z]+)([.#]?)(.*)", name).groups()
        attr = f' {"class" if sign == "." else "id"}="{label}"' if sign else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        items = [f'<a href="/x">{self.one(*self.LABELS) if self.r.random() < 0.4 else self.prose(1, 4)}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else self.one(" ", " | ").join(items)

    def paragraph(self) -> str:
        text = " ".join(MARK + w if i == 0 else w for i, w in enumerate(self.prose(1, 90).split())) if self.r.random() < 0.85 else MARK + self.prose(1, 6)
        kind = self.r.random()
        if kind < 0.1:
            text = f"<b>{text}" + self.one("</b>", "<br>")
        elif kind < 0.2:
            text += f' <a href="/y">{self.prose(1, 3)}</a> {self.prose(1, 20)}'
        open_ = self.one("p", "p", "p", "p", "p", "div", "blockquote", "li")
        if open_ == "li":
            return f"<ul><li>{text}</li><li>{MARK}{self.prose(2, 20)}</li></ul>"
        return f"<{open_}>{text}" + ("" if open_ == "p" and self.r.random() < 0.2 else f"</{open_}>")

    def aside(self) -> str:
        kind = self.r.random()
        if kind < 0.4:
            return self.wrap(self.one(*self.ADVERT), self.prose(2, 30) if self.r.random() < 0.6 else f"<p>{self.prose(2, 30)}</p>")
        if kind < 0.6:
            return self.wrap(self.one(*self.NOTICE), f"<p>{self.prose(4, 40)}</p><button>{self.one(*self.LABELS)}</button>")
        if kind < 0.75:
            return self.wrap(self.one(*self.SHARE), self.links(self.some(2, 4)))
        if kind < 0.87:
            return f"<form><label>{self.prose(1, 4)}</label><input name=q><select><option>{self.prose(1, 2)}<option>{self.prose(1, 2)}</select><button>{self.one(*self.LABELS)}</button></form>"
        return self.wrap(self.one(*self.SIDE), f"<h3>{self.prose(1, 4)}</h3>" + (self.links(self.some(2, 8)) if self.r.random() < 0.6 else f"<p>{self.prose(5, 40)}</p>"))

    def comments(self) -> str:
        each = lambda: self.wrap(self.one("div.comment", "article.comment", "li.comment", "div.reply"), f"<b>{self.prose(1, 2)}</b><p>{self.prose(2, 50)}</p>" + self.one("", f'<a href="#">{self.one("Reply", "Answer", "Like")}</a>'))
        return self.wrap(self.one(*self.COMMENT), f"<h2>{self.prose(1, 3)}</h2>" + "".join(each() for _ in range(self.some(1, 6))))

    def page(self) -> str:
        title = self.prose(2, 9)
        body = []
        if self.r.random() < 0.4:
            body.append(self.wrap(self.one(*self.HEAD), self.one(f"<h1>{self.prose(1, 3)}</h1>", f"<a href='/'>{self.prose(1, 2)}</a>", f"<p>{self.prose(2, 12)}</p>")))
        if self.r.random() < 0.9:
            body.append(self.wrap(self.one(*self.MENU), self.links(self.some(2, 9))))
        for _ in range(self.some(0, 2)):
            body.append(self.aside())
        inside = [f"<{self.one('h1', 'h1', 'h2')}>{MARK}{title}</h1>"] if self.r.random() < 0.85 else []
        for _ in range(self.some(0, 22) if self.r.random() < 0.9 else 0):
            inside.append(self.paragraph())
            if self.r.random() < 0.05:
                inside.append(f"<h2>{MARK}{self.prose(1, 6)}</h2>")
            if self.r.random() < 0.05:
                inside.append(self.aside())
        comments = self.comments() if self.r.random() < 0.35 else ""
        if comments and self.r.random() < 0.3:
            inside.append(comments)
            comments = ""
        body.append(self.wrap(self.one("article", self.one(*self.MAIN)), "".join(inside)))
        if self.r.random() < 0.3:
            body[-1] = self.wrap(self.one("main", "div.container", "div.wrapper", "div.row"), body[-1] + (self.aside() if self.r.random() < 0.4 else ""))
        body.append(comments)
        for _ in range(self.some(0, 2)):
            body.append(self.aside())
        if self.r.random() < 0.9:
            body.append(self.wrap(self.one(*self.FOOT), f"&copy; {self.prose(1, 4)} &middot; {self.prose(2, 25)}" if self.r.random() < 0.7 else f"<p>{self.prose(2, 25)}</p>" + self.links(self.some(2, 5))))
        head = f"<head><meta charset='utf-8'><title>{title}</title><style>p{{margin:0}}</style></head>" if self.r.random() < 0.95 else ""
        return f"<!DOCTYPE html><html>{head}<body>{''.join(body)}</body></html>"


_FITTED: dict[tuple, Network] = {}


def fit(*, composed: int = 900, epochs: int = 6, hidden: int = 24, seed: int = 5, rate: float = 0.01) -> Network:
    """The trained network; the same settings give the same network, trained once in a process."""
    settings = (composed, epochs, hidden, seed, rate)
    if settings in _FITTED:
        return _FITTED[settings]
    composer = Composer(seed)
    xs, ys = [], []
    for _ in range(composed):
        found = blocks(composer.page())
        if found:
            ys.append(np.array([MARK in b.text for b in found], np.float32))
            plain = [Block(b.path, b.text.replace(MARK, "") or " ", b.linked) for b in found]
            xs.append(features([plain]))
    rng = np.random.default_rng(seed)
    net = Network(hidden, rng)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, size = 0, 24
    order = np.argsort([len(x) for x in xs], kind="stable")
    groups = [order[i : i + size] for i in range(0, len(order), size)]
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            x, mask = _padded([xs[i] for i in groups[g]])
            y = np.zeros_like(mask)
            for j, i in enumerate(groups[g]):
                y[: len(ys[i]), j] = ys[i]
            drop = rng.random((1, x.shape[1], INPUT)) < 0.1
            grad = net.gradients(np.where(drop, 0, x).astype(np.float32), mask, y)
            norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
            step += 1
            for k, v in grad.items():
                v = v * min(1.0, 5 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                net.p[k] -= (rate * (0.5 ** (epoch / 2)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    _FITTED[settings] = net
    return net


def label(net: Network, found: list[list[Block]], cells: int = 8_000) -> list[np.ndarray]:
    """For each page, which of its blocks are main text."""
    x = features(found)
    ends = np.cumsum([len(p) for p in found])
    each = np.split(x, ends[:-1]) if found else []
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(found)
    order = sorted((i for i, p in enumerate(found) if p), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(found[order[stop]]) <= cells:
            stop += 1
        padded, mask = _padded([each[i] for i in order[at:stop]])
        s = net.scores(padded, mask)
        for j, i in enumerate(order[at:stop]):
            out[i] = s[: len(found[i]), j] > 0
        at = stop
    return out


def main_text(pages: DataFrame, net: Network, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, ``text``, ``n_chars`` of every row; ``text`` joins the main blocks in page order by one \\n.

    Character references are decoded, and white space in a block is one space. A null or empty page, or one without
    main text, has the empty text. Rows are independent, so repeated rows and null keys or urls come out as they went in.
    """
    df = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"), F.col(html).alias("__html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, "__html"):
            found = [blocks(h) for h in part.column("__html").to_pylist()]
            texts = ["\n".join(b.text for b, y in zip(page, keep, strict=True) if y) for page, keep in zip(found, label(net, found), strict=True)]
            yield common.rows_of(part, ["__key", "__url"], text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    a, b = (df.schema[c].dataType.simpleString() for c in ("__key", "__url"))
    return df.mapInArrow(run, f"__key {a}, __url {b}, text string, n_chars long").withColumnsRenamed({"__key": key, "__url": url})
