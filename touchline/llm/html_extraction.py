"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements and text blocks. Each node is content or not; a node's own features
(tag, words of class and id, share of links, length, and what the elements around it call themselves) give its potential, and parent and child are coupled by a 2 x 2
potential. Sum-product message passing, upward and then downward, yields each node's marginal; text blocks of marginal
0.5 or more are kept, in page order. The weights are trained on labelled pages by their likelihood.

Null or empty html, and pages without content: text "" and n_chars 0. Broken markup is read as browsers do it: open
elements are closed where they must be, stray end tags are ignored, elements beyond DEEPEST levels become siblings; a
quote that nothing closes ends with its tag. One pass over the page, in time linear in its length; very long pages are whole.
Repeated rows: each on its own. An empty table gives no row. Extra columns are ignored, whatever their names. Ties (a
marginal of exactly 0.5) count as content.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import batch_rows, frugal

TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
#: An attribute's name, and the quote that opens its value or the value; nothing at the end of a tag.
ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)(?:\s*=\s*(\"|'|[^\s>\"'][^\s>]*|))?)?")
#: Elements whose content is no markup; elements that hold nothing to read; elements that stand in a head.
RAW = {t: re.compile(f"</{t}(?=[\\s/>]|\\Z)", re.I) for t in "script style textarea title iframe xmp noembed noframes".split()}
DROPPED = frozenset("template noscript svg math object".split())
HEADISH = frozenset("title meta link base script style noscript template".split())
DEEPEST = 400
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter q rp rt ruby s samp small span strike strong sub sup time tt u var wbr progress output".split())
#: Open elements that a start tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("ul ol dl table body html article section div main nav aside form select".split())

TAGS = {
    "article": "article", "main": "main", "section": "section", "div": "div", "p": "p", "pre": "p", "blockquote": "p", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item", "dd": "item",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside",
    "form": "form", "fieldset": "form", "select": "form", "option": "form", "button": "form", "dialog": "notice", "head": "head", "title": "head", "body": "root", "html": "root", "table": "table", "tr": "table", "td": "table", "th": "table",
    "figure": "figure", "figcaption": "figure", "address": "footer", "#text": "text",
}
WORDS = {
    "w_ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted adsense banner outbrain taboola dfp".split(),
    "w_comment": "comment comments respond reply replies disqus discussion reader readers feedback commentlist thread responses".split(),
    "w_nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager topbar toolbar toc skip tabs links".split(),
    "w_notice": "cookie cookies notice notices consent gdpr alert popup modal overlay paywall newsletter subscribe signup warning announcement privacy".split(),
    "w_side": "sidebar side aside widget widgets related recommended recommendations more popular trending share sharing social tags meta rail secondary complementary".split(),
    "w_frame": "header footer masthead foot head copyright colophon bottom top contentinfo legal".split(),
    "w_form": "form search login signin register input contact".split(),
    "w_content": "content article post entry story main body text blog page prose single articlebody maincontent".split(),
}
WORD = {w: k for k, ws in WORDS.items() for w in ws}
#: What a page has to say where its article is: an article element, a main one, a class of that kind, or nothing; or that it
#: has paragraphs and headings alone.
KINDS = ("article", "main", "class", "bare", "plain")
#: Kinds of elements and of their names that tell of all that is within them, however deep.
TELLS = ("nav", "header", "footer", "aside", "form", "notice", *(w for w in WORDS if w != "w_content"), "hidden")
BASE = [*sorted(set(TAGS.values())), "other", *WORDS, "hidden", "links", "short", "long", "stop", "sign", *(f"in_{t}" for t in TELLS)]
#: A node's features, and each of them together with its page's kind.
NAMES = [*BASE, "bias", *(f"{k}:{n}" for k in KINDS for n in BASE)]
COLUMN = {n: k for k, n in enumerate(NAMES)}
INSIDE = {COLUMN[t]: COLUMN[f"in_{t}"] for t in TELLS}


class Tree:
    """Nodes of one page in page order: parent, features, and for text blocks the text."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.features: list[tuple[int, ...]] = [(COLUMN["root"],)]
        self.text: list[str | None] = [None]
        self.marks: list[str] = [""]
        self.kind, self.plain = KINDS.index("bare"), True  # plain: so far only paragraphs and headings
        #: Open elements: tag, node, whether its text is dropped, features that all within it have.
        self.stack: list[tuple[str, int, bool, frozenset[int]]] = [("#page", 0, False, frozenset())]
        self.open: dict[str, list[int]] = {}  # where each tag stands in the stack
        self.scopes = [0]  # where elements of SCOPE stand in the stack
        self.run: list[str] = []
        self.linked = self.inside = 0  # characters within links; open links
        self.read(source)
        if self.plain:
            self.kind = KINDS.index("plain")
        own = len(BASE) * (1 + self.kind) + 1
        self.features = [(*f, *(own + c for c in f)) for f in self.features]

    def read(self, source: str) -> None:
        at, end, gone = 0, len(source), {'"': False, "'": False}
        while at < end:
            lt = source.find("<", at)
            lt = end if lt < 0 else lt
            if lt > at:
                self.piece(source[at:lt])
            if lt == end:
                break
            m = TAG.match(source, lt + 1)
            if m is None:
                if source.startswith("<!--", lt):
                    to = source.find("-->", lt + 2 if source.startswith("<!-->", lt) else lt + 4)
                    at = end if to < 0 else to + 3
                elif source[lt + 1 : lt + 2] in ("!", "?", "/"):
                    to = source.find(">", lt)
                    at = end if to < 0 else to + 1
                else:
                    self.piece("<")
                    at = lt + 1
                continue
            at, values = m.end(), []
            if source[at : at + 1] != ">":
                while True:
                    a = ATTRIBUTE.match(source, at)
                    at = a.end()
                    name, value = a[1], a[2]
                    if name is None:
                        break
                    if value == '"' or value == "'":
                        to = -1 if gone[value] else source.find(value, at)
                        if to < 0:  # nothing closes it: the tag does
                            gone[value] = True
                            to = source.find(">", at)
                            to = end if to < 0 else to
                            value, at = source[at:to], to
                        else:
                            value, at = source[at:to], to + 1
                    values.append((name, value or ""))
                if at >= end:  # a tag that the page's end cuts off
                    break
            closed = source[at - 1] == "/"
            at += 1
            tag = m[2].lower()
            if m[1]:
                self.end_tag(tag)
                continue
            self.start_tag(tag, values, closed)
            if tag in RAW:
                close = RAW[tag].search(source, at)
                to = close.start() if close else end
                if tag == "title":
                    self.piece(source[at:to])
                at = to
        self.flush()

    def piece(self, text: str) -> None:
        self.run.append(text)
        if self.inside:
            self.linked += len(text)

    def flush(self) -> None:
        if self.run:
            t = " ".join(entities.unescape("".join(self.run)).split())
            if t:
                if self.stack[-1][0] == "head":
                    self.cut(len(self.stack) - 1)
                _, node, dropped, within = self.stack[-1]
                f = [COLUMN["text"], *within]
                if self.linked > 0.5 * len(t):
                    f.append(COLUMN["links"])
                if len(t) < 40:
                    f.append(COLUMN["short"])
                elif len(t) > 120:
                    f.append(COLUMN["long"])
                if t[-1] in ".!?\"'”»。":
                    f.append(COLUMN["stop"])
                if t[0] == "©" or t[:12].lower().startswith(("copyright", "(c)")):
                    f.append(COLUMN["sign"])
                if not dropped:
                    self.add(node, f, t, "")
            self.run = []
        self.linked = 0

    def cut(self, k: int) -> None:
        """Closes the k-th open element and all within it."""
        while len(self.stack) > k:
            tag = self.stack.pop()[0]
            self.open[tag].pop()
            if self.scopes[-1] == len(self.stack):
                self.scopes.pop()

    def end_tag(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.inside = max(0, self.inside - 1)
            return
        self.flush()
        self.inside = 0
        if tag not in ("body", "html") and self.open.get(tag):
            self.cut(self.open[tag][-1])

    def start_tag(self, tag: str, values: list[tuple[str, str]], closed: bool) -> None:
        if tag in INLINE:
            if tag == "a":
                self.inside += 1
            elif tag in ("br", "img"):
                self.run.append(" ")
            return
        self.flush()
        self.inside = 0
        if self.open.get("head") and tag not in HEADISH:
            self.cut(self.open["head"][-1])
        if tag == "html":  # the page itself
            self.marks[0] = self.marks[0] or dict(values).get("data-y", "")
            return
        if tag in VOID or tag in ("head", "body") and self.open.get(tag):
            return
        if self.stack[-1][0] == "p":  # a block ends a paragraph
            self.cut(len(self.stack) - 1)
        if tag in CLOSES:
            first = [self.open[t][k] for t in CLOSES[tag] if self.open.get(t) for k in (-1,)]
            if first and max(first) > self.scopes[-1]:
                self.cut(min(k for k in first if k > self.scopes[-1]))
        f = {COLUMN[TAGS.get(tag, "other")]}
        self.plain = self.plain and TAGS.get(tag) in ("root", "head", "p", "heading")
        mark = ""
        if tag in KINDS:
            self.kind = min(self.kind, KINDS.index(tag))
        for name, value in values:
            name, value = name.lower(), value.lower()
            if name in ("class", "id", "role", "aria-label"):
                for one in value.split():
                    told = {WORD[w] for w in re.split(r"[^a-z]+", one) if w in WORD}
                    if told != {"w_content"}:  # a main-nav is no main part
                        told.discard("w_content")
                    elif tag != "body":
                        self.kind = min(self.kind, KINDS.index("class"))
                    f.update(COLUMN[t] for t in told)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                f.add(COLUMN["hidden"])
            elif name == "data-y":
                mark = value
        _, above, dropped, within = self.stack[-1]
        # what calls itself content, and what holds whole pages, says nothing against what is within it
        tells = () if tag in ("body", "html", "article", "main") or COLUMN["w_content"] in f else (INSIDE[c] for c in f if c in INSIDE)
        node = self.add(above, f | within, None, mark)
        if closed and tag not in TAGS and tag not in RAW:
            return
        deep = len(self.stack) >= DEEPEST
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, above if deep else node, dropped or tag in DROPPED or tag in RAW and tag != "title", within.union(tells)))

    def add(self, parent: int, features, text: str | None, mark: str) -> int:
        self.parent.append(parent)
        self.features.append(tuple(features))
        self.text.append(text)
        self.marks.append(mark or self.marks[parent])
        return len(self.parent) - 1


def blocks(source: str | None) -> list[str]:
    """All text blocks of a page, content or not."""
    return [t for t in Tree(source or "").text if t]


# --- labelled pages -------------------------------------------------------------------------------------------------


def labelled_pages(n: int = 900, seed: int = 7) -> list[str]:
    """Pages in which data-y tells content (1) from the rest (0): the layouts that sites commonly use."""
    r = random.Random(seed)

    def words(a, b):
        return " ".join("".join(r.choice("aeionrstlmdu") for _ in range(r.randint(1, 9))) for _ in range(r.randint(a, b)))

    def prose():
        return words(8, 90).capitalize() + "." if r.random() < 0.75 else words(1, 7).capitalize() + r.choice([".", "", "!"])

    def links(a, b, tag="li"):
        return "".join(f"<{tag}><a href='/x'>{words(1, 3)}</a></{tag}>" for _ in range(r.randint(a, b)))

    def name(kind):
        """A word of the kind, or one that tells nothing."""
        return r.choice(WORDS[kind]) if r.random() < 0.8 else words(1, 1)

    def attr(kind):
        return f'{r.choice(["class", "id"])}="{r.choice(["", "site-", "the ", "js_", ""])}{name(kind)}{r.choice(["", "-box", " col", "-1"])}"'

    def rest():
        return r.choice([
            lambda: f"<nav data-y=0><ul>{links(2, 8)}</ul></nav>",
            lambda: f"<div {attr('w_nav')} data-y=0><ul>{links(2, 8)}</ul></div>",
            lambda: f"<div {attr('w_ad')} data-y=0>{r.choice([prose, lambda: '<p>' + prose() + '</p>'])()}</div>",
            lambda: f"<aside data-y=0><h3>{words(1, 3)}</h3><p>{prose()}</p><ul>{links(1, 5)}</ul></aside>",
            lambda: f"<div {attr('w_side')} data-y=0><h4>{words(1, 3)}</h4><p>{prose()}</p>{links(1, 4, 'p')}</div>",
            lambda: f"<div {attr('w_notice')} data-y=0><p>{prose()}</p><button>{words(1, 2)}</button></div>",
            lambda: f"<form data-y=0><p>{prose()}</p><select><option>{words(1, 2)}<option>{words(1, 2)}</select><button>{words(1, 2)}</button></form>",
            lambda: f"<div {attr('w_form')} data-y=0><form><p>{words(1, 6)}</p></form></div>",
            lambda: f"<div data-y=0 {r.choice(['hidden', 'style=\"display:none\"', 'aria-hidden=true'])}><p>{prose()}</p></div>",
            lambda: f"<dialog data-y=0><p>{prose()}</p></dialog>",
            lambda: f"<div data-y=0>{links(2, 5, r.choice(['span', 'b', 'i']))}</div>",
            lambda: f"<{r.choice(['aside', 'nav'])} data-y=0>{''.join('<p>' + prose() + '</p>' for _ in range(r.randint(1, 4)))}</{'aside'}>",
            lambda: f"<div {attr(r.choice(['w_ad', 'w_side', 'w_notice']))} data-y=0>{''.join('<p>' + prose() + '</p>' for _ in range(r.randint(1, 4)))}</div>",
        ])()

    def comments():
        return r.choice([
            lambda: f"<section {attr('w_comment')} data-y=0><h2>{words(1, 2)}</h2>" + "".join(f"<article class=\"comment\"><p>{prose()}</p></article>" for _ in range(r.randint(1, 4))) + "</section>",
            lambda: f"<div {attr('w_comment')} data-y=0>" + "".join(f"<div class=\"{name('w_comment')}\"><p>{prose()}</p></div>" for _ in range(r.randint(1, 4))) + "</div>",
            lambda: f"<ol {attr('w_comment')} data-y=0>" + "".join(f"<li><p>{prose()}</p></li>" for _ in range(r.randint(1, 4))) + "</ol>",
        ])()

    def article():
        out = [f"<h1>{words(1, 8)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 12)):
            x = r.random()
            if x < 0.62:
                out.append(f"<p>{r.choice(['', '<b>', '<em>'])}{prose()}{r.choice(['</p>', '</p>', '<br>'])}")
            elif x < 0.7:
                out.append(f"<h2>{words(1, 6)}</h2>")
            elif x < 0.78:
                out.append("<ul>" + "".join(f"<li>{prose()}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.82:
                out.append(f"<blockquote><p>{prose()}</p></blockquote>")
            elif x < 0.85:
                out.append(f"<table><tr><td>{words(1, 3)}<td>{words(1, 3)}</table>")
            elif x < 0.88:
                out.append(f"<figure><figcaption>{prose()}</figcaption></figure>")
            elif x < 0.9:
                out.append(f"<div><p>{prose()}</p></div>")
            elif x < 0.93:
                out.append(f"<section><h2>{words(1, 4)}</h2><p>{prose()}</p></section>")
            elif x < 0.95:
                out.append(f"{r.choice(['', '<div>'])}{prose()}")
            elif x < 0.98:
                out.append(rest())
            elif x < 0.985:
                out.append(f"<p>{words(1, 9)} &copy; {prose()}</p>")
            else:
                out.append(f"<p><a href=x>{prose()}</a> {words(4, 9)}</p>")
        if r.random() < 0.15:
            out.insert(0, f"<header data-y=0><p>{prose()}</p></header>")
        if r.random() < 0.15:
            out.append(f"<footer data-y=0><p>{prose()}</p></footer>")
        if r.random() < 0.15:
            out.append(comments())
        return "".join(out)

    def wrapped(core, odd=True):
        """An article within a few boxes that say nothing, or something else."""
        for _ in range(r.randint(0, 3)):
            core = f"<div {r.choice(['', '', 'class=' + words(1, 1), attr('w_content') if odd else ''])}>{core}</div>"
        return core

    def bare():
        text = [words(25, 90).capitalize() + "." if r.random() < 0.5 else prose() for _ in range(r.randint(1, 8))]
        core = "".join(r.choice(["<p>{}</p>", "<p>{}", "<p>{}", "<div>{}</div>", "<h2>{}</h2><p>{}</p>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>"]).replace("{}", t) for t in text)
        core = r.choice([f"<div data-y=1>{wrapped(core, False)}</div>", f"<div data-y=1>{text[0]}</div>", f"<table data-y=1><tr><td>{core}</td></tr></table>", f"<section data-y=1>{core}</section>", f"<div data-y=1><h1>{words(1, 8)}</h1>{core}</div>", f"<center data-y=1>{core}</center>"])
        if r.random() < 0.4:  # straight in the body, with other things between
            core = (f"<h1 data-y=1>{words(1, 8)}</h1>" if r.random() < 0.5 else "") + "".join(f"<p data-y=1>{t}</p>" + (rest() if r.random() < 0.2 else "") for t in text)
        before, after = ("".join(rest() for _ in range(r.randint(0, 3))) for _ in range(2))
        foot = f"<footer data-y=0>&copy; {prose()}</footer>" if r.random() < 0.4 else f"<div {attr('w_frame')} data-y=0>&copy; {prose()}</div>" if r.random() < 0.3 else ""
        whole = f"<html data-y=0><head><title>{words(1, 8)}</title></head><body>{before}{core}{after}{foot}</body></html>"
        # fragments: what isn't marked is the page itself
        return r.choice([whole, whole, core, f"<html data-y=1><body>{text[0]}<p>{text[-1]}</body></html>", f"<html data-y=1>{''.join(f'<p>{t}' for t in text)}", f"<html data-y=1><head data-y=0><title>{words(1, 8)}</title></head><body><h1>{words(1, 8)}</h1>{text[0]}<br>{text[-1]}{foot}</body></html>", f"<html data-y=1>{text[0]}"])

    def plain():
        """A page, or a piece of one, that has paragraphs and headings alone, or no markup at all."""
        head = f"<head data-y=0><title>{words(1, 8)}</title></head>" if r.random() < 0.5 else f"<title data-y=0>{words(1, 8)}</title>" if r.random() < 0.3 else ""
        text = "".join(r.choice(["<p>{}", "<p>{}</p>", "<p>{}</p>", "<h1>{}</h1>", "<h3>{}</h3>", "{}<br>"]).replace("{}", r.choice([prose, lambda: words(1, 4)])()) for _ in range(r.randint(1, 6)))
        return f"<html data-y=1>{head}{r.choice(['<body>', ''])}{r.choice([text, text, prose(), words(1, 3)])}"

    def page():
        if r.random() < 0.08:
            return plain()
        if r.random() < 0.3:  # no container at all, or no markup
            return bare()
        body = [f"<header data-y=0><div>{words(1, 3)}</div>{r.choice(['', '<h1>' + words(1, 3) + '</h1>'])}<p>{prose()}</p></header>"] if r.random() < 0.5 else []
        body += [rest() for _ in range(r.randint(0, 3))]
        core = article()
        body.append(r.choice([
            lambda: f"<article data-y=1>{wrapped(core)}</article>",
            lambda: f"<article {attr(r.choice(list(WORDS)))} data-y=1>{core}</article>",
            lambda: f"<article class=\"{name('w_content')} {name(r.choice(list(WORDS)))}-{name(r.choice(list(WORDS)))}\" data-y=1>{core}</article>",
            lambda: f"<main data-y=1>{wrapped(core)}</main>",
            lambda: f"<div data-y=1>{wrapped(core)}</div>",
            lambda: f"<main data-y=0><article data-y=1>{core}</article></main>",
            lambda: f"<div {attr('w_content')} data-y=1>{core}</div>",
            lambda: f"<div data-y=0><div {attr('w_content')} data-y=1>{core}</div>{rest()}</div>",
            lambda: f"<section {attr('w_content')} data-y=1>{core}</section>",
            lambda: f"<article {attr('w_content')} data-y=1><div {attr('w_content')}>{core}</div></article>",
        ])() if r.random() < 0.95 else "")
        body += [rest() for _ in range(r.randint(0, 2))]
        if r.random() < 0.4:
            body.append(comments())
        if r.random() < 0.8:
            body.append(f"<footer data-y=0>{r.choice(['&copy; ', '', '<p>'])}{prose()}{r.choice(['', '<ul>' + links(1, 4) + '</ul>'])}</footer>")
        elif r.random() < 0.5:
            body.append(f"<div {attr('w_frame')} data-y=0>&copy; {prose()}</div>")
        return f"<!DOCTYPE html><html data-y=0><head><title>{words(1, 8)}</title></head><body>{''.join(body)}</body></html>"

    return [page() for _ in range(n)]


# --- the model ------------------------------------------------------------------------------------------------------


class Features:
    """The features of nodes: pairs of a node and a column."""

    def __init__(self, features: list[tuple[int, ...]]):
        self.n = len(features)
        self.node = np.repeat(np.arange(self.n), list(map(len, features)))
        self.column = np.fromiter((c for f in features for c in f), dtype=np.int64, count=len(self.node))

    def times(self, w: np.ndarray) -> np.ndarray:
        """The sum of each node's weights."""
        return np.bincount(self.node, weights=w[self.column], minlength=self.n) + w[COLUMN["bias"]]

    def sums(self, y: np.ndarray) -> np.ndarray:
        """The sum of the nodes' y of each column."""
        out = np.bincount(self.column, weights=y[self.node], minlength=len(NAMES))
        out[COLUMN["bias"]] += y.sum()
        return out


def design(trees: list[Tree]) -> tuple[Features, np.ndarray, np.ndarray]:
    """Features of all nodes, the row of each node's parent (-1: none), and each node's depth."""
    sizes = [len(t.parent) for t in trees]
    first = np.cumsum([0, *sizes[:-1]])
    parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + f) for t, f in zip(trees, first)])
    depth = [0] * len(parent)
    for k, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[k] = depth[p] + 1
    return Features([f for t in trees for f in t.features]), parent, np.array(depth, dtype=np.int64)


@functools.lru_cache(maxsize=1)
def train(n: int = 900, seed: int = 7, ridge: float = 3e-4, rounds: int = 260) -> np.ndarray:
    """Weights of the features and J01, J10, J11 of the coupling (J00 is 0), by gradient steps (Adam) on the exact
    likelihood of the labelled pages; sum-product gives the expected features."""
    trees = [Tree(p) for p in labelled_pages(n, seed)]
    x, parent, depth = design(trees)
    y = np.array([float(m == "1") for t in trees for m in t.marks])
    child = np.flatnonzero(parent >= 0)
    p = parent[child]
    seen = np.concatenate([x.sums(y), [((1 - y[p]) * y[child]).sum(), (y[p] * (1 - y[child])).sum(), (y[p] * y[child]).sum()]])
    w = np.zeros(len(NAMES) + 3)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        node, pair = beliefs(x, parent, depth, w)
        gradient = (np.concatenate([x.sums(node), pair[child].sum(axis=0)]) - seen) / n + ridge * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w -= 0.25 * (1 - 0.8 * k / rounds) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def beliefs(x: Features, parent: np.ndarray, depth: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product over all trees, messages up to the roots and then down: P(content) of each node, and for each node and
    its parent P(parent 0, node 1), P(1, 0), P(1, 1)."""
    own = x.times(w)
    j = np.array([[0.0, w[-3]], [w[-2], w[-1]]])  # j[parent, child]
    up = np.zeros((len(own), 2))  # sum of the children's messages
    sent = np.zeros((len(own), 2))
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))
    for rows in levels[:0:-1]:
        b0, b1 = up[rows, 0], own[rows] + up[rows, 1]
        m = np.stack([np.logaddexp(b0 + j[0, 0], b1 + j[0, 1]), np.logaddexp(b0 + j[1, 0], b1 + j[1, 1])], axis=1)
        m -= m[:, :1]
        sent[rows] = m
        np.add.at(up, parent[rows], m)
    down = np.zeros((len(own), 2))
    for rows in levels[1:]:
        p = parent[rows]
        a0 = up[p, 0] + down[p, 0] - sent[rows, 0]
        a1 = own[p] + up[p, 1] + down[p, 1] - sent[rows, 1]
        m = np.stack([np.logaddexp(a0 + j[0, 0], a1 + j[1, 0]), np.logaddexp(a0 + j[0, 1], a1 + j[1, 1])], axis=1)
        down[rows] = m - m[:, :1]
    node = 1 / (1 + np.exp(-np.clip(own + up[:, 1] + down[:, 1] - up[:, 0] - down[:, 0], -700, 700)))
    above = up[parent] + down[parent] - sent
    above[:, 1] += own[parent]
    here = up.copy()
    here[:, 1] += own
    joint = above[:, :, None] + here[:, None, :] + j
    joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return node, np.stack([joint[:, 0, 1], joint[:, 1, 0], joint[:, 1, 1]], axis=1)


def marginals(trees: list[Tree], w: np.ndarray) -> np.ndarray:
    """P(content) of every node of all trees."""
    return beliefs(*design(trees), w)[0]


def extract_all(sources: list[str | None], w: np.ndarray) -> list[str]:
    trees = [Tree(s or "") for s in sources]
    if not trees:
        return []
    p, out, at = marginals(trees, w), [], 0
    for t in trees:
        out.append("\n".join(x for x, q in zip(t.text, p[at : at + len(t.parent)].tolist()) if x and q >= 0.5))
        at += len(t.parent)
    return out


def extract(pages: DataFrame, w: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; the weights (a few dozen numbers) are trained on the driver."""
    import pyarrow as pa

    weights = (train() if w is None else w).tolist()

    def batches(it):
        given = np.array(weights)
        for b in it:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                text = extract_all(c.column(2).to_pylist(), given)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    batch_rows(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(frugal(batches), "page_id long, url string, text string, n_chars long")
