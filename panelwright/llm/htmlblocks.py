"""Leaf blocks of HTML pages, and labelled pages to learn from.

A leaf block is a run of text that no block-level tag interrupts. It knows its
ancestors with their class and id words, and how much of it is link text.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

#: Comments, declarations and tags. Quotes count only after an equals sign, and only if they are closed; what no > ends goes on to the end of the page.
_NOTE = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
_NAME = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
_QUOTED = r"((?:[^>\"'=]+|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)>"
_BARE = r"([^>]*)(?:>|\Z)"
_TAG = re.compile(f"{_NOTE}|{_NAME}{_QUOTED}|{_NAME}{_BARE}", re.S)
_TAG_BARE = re.compile(f"{_NOTE}|(?!){_NAME}{_QUOTED}|{_NAME}{_BARE}", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")

#: Elements whose content is not text of the page. Fixed values.
SKIPPED = frozenset("script style template noscript iframe object svg math".split())
#: Those of them that can be closed by their own start tag; for all other elements a slash there means nothing. Fixed values.
_FOREIGN = frozenset("svg math".split())
#: Those of them that can hold another of their kind. In the others all is text up to the end tag. Fixed values.
_NESTED = frozenset("svg math template object".split())
_END = {name: re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I | re.A) for name in SKIPPED - _NESTED}
#: Start tags that end an open svg or math, and elements in those which hold HTML again. Fixed values.
_LEAVES = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
_HOLDS_HTML = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Elements without content. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start of the first kind ends an open element of the second kind. Fixed values.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}


@dataclass
class Block:
    """path: (tag, names) of the distinct ancestors, then of the two innermost, the block's own last; names are the words of class, id and role."""

    path: tuple[tuple[str, str], ...]
    text: str
    linked: int


def _names(attributes: str) -> str:
    if not attributes or "=" not in attributes:
        return ""
    words = []
    for m in _NAMES.finditer(attributes):
        words += _PART.findall((m[1] or m[2] or m[3] or "").lower())
    return " ".join(words)


class _Scanner:
    """Tags of a page from left to right. Where a quoted value leads a tag past the end of the page, quotes mean nothing from there on, so that time is linear in the page."""

    def __init__(self, page: str):
        self.page = page
        self.tag = _TAG

    def next(self, at: int) -> re.Match | None:
        m = self.tag.search(self.page, at)
        if m is not None and m[5]:
            self.tag = _TAG_BARE
        return m

    def skipped(self, name: str, at: int, outside: dict[str, int]) -> int:
        """Where the content of the skipped element ends that begins at ``at``: at its own end tag, for svg and math also before a tag that belongs outside of them (``outside``: the open elements there), or with the page."""
        if name not in _NESTED:
            end = _END[name].search(self.page, at)
            return end.start() if end else len(self.page)
        depth, html_again = 1, 0
        while (m := self.next(at)) is not None:
            at = m.end()
            inner, closing = (m[2] or m[5] or "").lower(), m[1] or m[4]
            closed = inner and not closing and name in _FOREIGN and (m[3] or m[6] or "").endswith("/")
            if inner == name and not closed:
                depth += -1 if closing else 1
                if not depth:
                    return m.start()
            elif name in _FOREIGN and not html_again and (inner in ("p", "br") or outside.get(inner) if closing else inner in _LEAVES):
                return m.start()
            elif inner in _END and not closing and not closed:
                at = self.skipped(inner, at, outside)
            if name in _FOREIGN and inner in _HOLDS_HTML and not closed:
                html_again = max(html_again + (-1 if closing else 1), 0)
        return len(self.page)


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order, without empty ones. White space in them is single spaces."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, str]] = []
    distinct: dict[tuple[str, str], int] = {}  # how often each element is in the stack
    tags: dict[str, int] = {}
    parts: list[str] = []
    linked: list[str] = []
    links = 0
    at = 0

    def end_block() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                inside = len(" ".join("".join(linked).split())) if linked else 0
                out.append(Block((*distinct, *stack[-2:]) if len(stack) > 1 else tuple(stack), text, inside))
            parts.clear()
            linked.clear()

    def pop() -> str:
        x = stack.pop()
        tags[x[0]] -= 1
        distinct[x] -= 1
        if not distinct[x]:
            del distinct[x]
        return x[0]

    n = len(page)
    scanner = _Scanner(page)
    while at < n:
        m = scanner.next(at)
        stop = m.start() if m else n
        if stop > at:
            run = html.unescape(page[at:stop])  # alone: a reference does not go on behind a tag
            parts.append(run)
            if links:
                linked.append(run)
        if m is None:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in SKIPPED:
            if not closing and not (name in _FOREIGN and attributes.endswith("/")):
                at = scanner.skipped(name, at, tags)
            end_block()
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            if name == "br":
                parts.append(" ")
            continue
        end_block()
        links = 0
        if closing:
            while tags.get(name) and pop() != name:
                pass
            continue
        if name in _ENDS_P and stack and stack[-1][0] == "p":
            pop()
        ended = _SIBLINGS.get(name)
        if ended:
            while stack and stack[-1][0] in (*ended, "p"):
                pop()
        if name not in VOID:
            x = (name, _names(attributes))
            stack.append(x)
            tags[name] = tags.get(name, 0) + 1
            distinct[x] = distinct.get(x, 0) + 1
    end_block()
    return out


def labelled_pages(n: int, seed: int = 3) -> list[tuple[str, list[int]]]:
    """Made-up pages of many layouts: (html, label of each block; 1 is main text)."""
    rng = random.Random(seed)
    return [_Page(rng).made() for _ in range(n)]


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.html: list[str] = []
        self.labels: list[int] = []

    def words(self, low: int, high: int) -> str:
        r = self.rng
        words = ["".join(r.choice(("ba", "ko", "li", "te", "ru", "sa", "mon", "pel", "dra", "vi")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        if len(words) > 6:
            for i in range(5, len(words), r.randint(5, 14)):
                words[i] += r.choice((".", ",", ".", " |", ""))
        text = " ".join(words)
        return text[0].upper() + text[1:] + (r.choice((".", ".", ".", "!", "?", "")) if len(words) > 3 else "")

    def block(self, tag: str, text: str, label: int, attributes: str = "") -> None:
        r = self.rng
        if r.random() < 0.1:
            text = text.replace(" ", " &amp; ", 1)
        opened = f"<{tag}{attributes}>"
        style = r.random()
        if style < 0.1 and tag == "p":
            self.html.append(f"{opened}<b>{text}<br>")
        else:
            self.html.append(f"{opened}{text}</{tag}>")
        self.labels.append(label)

    def wrap(self, names: tuple[str, ...], tags: tuple[str, ...], fill) -> None:
        """Either a telling tag, or a div or section with a telling class or id, or both."""
        r = self.rng
        tag = r.choice(tags + ("div", "div")) if names else r.choice(tags)
        attributes = ""
        if names and (tag in ("div", "section", "ul") or r.random() < 0.4):
            attributes = f' {r.choice(("class", "class", "id"))}="{r.choice(("", "site-", "page-", "main-", "block ", "js-")) if r.random() < 0.3 else ""}{r.choice(names)}"'
        self.html.append(f"<{tag}{attributes}>")
        fill()
        self.html.append(f"</{tag}>")

    def items(self, low: int, high: int, label: int = 0) -> None:
        r = self.rng
        if r.random() < 0.75:
            self.html.append("<ul>")
            for _ in range(r.randint(low, high)):
                self.html.append(f'<li><a href="/{r.randint(1, 99)}">{self.words(1, 4)}</a></li>')
                self.labels.append(label)
            self.html.append("</ul>")
        else:
            links = " ".join(f'<a href="#">{self.words(1, 3)}</a>' for _ in range(r.randint(low, high)))
            self.html.append(f"<p>{links}</p>" if r.random() < 0.5 else f"<div>{links}</div>")
            self.labels.append(label)

    def prose(self, low: int, high: int, label: int, short: bool = False) -> None:
        for _ in range(self.rng.randint(low, high)):
            self.block(self.rng.choice(("p", "p", "p", "p", "div")) if label == 0 else "p", self.words(*((3, 25) if short or self.rng.random() < 0.2 else (15, 90))), label)

    def menu(self) -> None:
        self.wrap(("menu", "navbar", "nav", "navigation", "breadcrumb", "breadcrumbs", "topnav", "main-menu", "toc", "pagination"), ("nav",), lambda: self.items(2, 9))

    def header(self) -> None:
        def fill():
            self.block(self.rng.choice(("div", "p", "h2")), self.words(1, 6), 0)
            if self.rng.random() < 0.5:
                self.prose(1, 1, 0, short=True)
            if self.rng.random() < 0.4:
                self.items(2, 5)

        self.wrap(("header", "masthead", "banner", "topbar", "site-header", "logo"), ("header",), fill)

    def footer(self) -> None:
        def fill():
            r = self.rng
            if r.random() < 0.7:
                self.html.append(f"&copy; {r.choice(('2021 ', ''))}{self.words(1, 3)} &middot; {self.words(2, 14)}")
                self.labels.append(0)
            if r.random() < 0.4 or not self.labels:
                self.items(2, 6)
            if r.random() < 0.4:
                self.prose(1, 2, 0, short=True)

        self.wrap(("footer", "site-footer", "copyright", "bottom", "colophon", "legal"), ("footer",), fill)

    def side(self) -> None:
        def fill():
            if self.rng.random() < 0.6:
                self.block(self.rng.choice(("h2", "h3", "h4")), self.words(1, 4), 0)
            if self.rng.random() < 0.6:
                self.items(2, 6)
            if self.rng.random() < 0.5:
                self.prose(1, 3, 0)

        self.wrap(("sidebar", "aside", "related", "widget", "recommended", "popular", "trending", "rail", "more-stories", "author-box", "tags", "share", "social"), ("aside",), fill)

    def advert(self) -> None:
        self.wrap(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "sponsor", "ad-slot", "banner-ad", "adbox"), (), lambda: self.prose(1, 1, 0, short=self.rng.random() < 0.6)) if self.rng.random() < 0.7 else self.bare_advert()

    def bare_advert(self) -> None:
        name = self.rng.choice(("ad", "ads", "advert", "sponsored", "promo"))
        self.html.append(f'<div class="{name}">{self.words(3, 30)}</div>')
        self.labels.append(0)

    def notice(self) -> None:
        def fill():
            self.prose(1, 2, 0, short=self.rng.random() < 0.5)
            if self.rng.random() < 0.5:
                self.block("button", self.words(1, 2), 0)

        self.wrap(("cookie", "cookies", "notice", "consent", "gdpr", "popup", "modal", "alert", "cookie-banner", "privacy", "overlay", "disclaimer", "paywall", "warning", "message"), ("dialog",), fill)

    def form(self) -> None:
        def fill():
            r = self.rng
            if r.random() < 0.6:
                self.block(r.choice(("p", "label", "h3", "legend")), self.words(1, 15), 0)
            self.html.append('<input type="text" name="q">')
            self.block(r.choice(("button", "label")), self.words(1, 3), 0)
            if r.random() < 0.3:
                self.html.append("<select>")
                for _ in range(r.randint(2, 4)):
                    self.block("option", self.words(1, 2), 0)
                self.html.append("</select>")

        self.wrap(("newsletter", "subscribe", "signup", "search", "login", "contact", "search-form", "poll"), ("form", "form"), fill)

    def comments(self) -> None:
        def fill():
            r = self.rng
            if r.random() < 0.6:
                self.block(r.choice(("h2", "h3")), self.words(1, 3), 0)
            for _ in range(r.randint(1, 5)):
                inner = r.choice(("comment", "comment-body", "reply", "post-comment", "user-comment", ""))
                tag = r.choice(("div", "li", "article")) if inner else "div"
                self.html.append(f'<{tag} class="{inner}">' if inner else "<div>")
                if r.random() < 0.5:
                    self.block(r.choice(("div", "p", "h4")), self.words(1, 4), 0)
                self.prose(1, 2, 0, short=r.random() < 0.4)
                self.html.append(f"</{tag}>")

        self.wrap(("comments", "comment-list", "discussion", "replies", "responses", "disqus", "reader-comments", "comment-section", "feedback"), ("section",), fill)

    def article(self) -> None:
        def fill():
            r = self.rng
            if r.random() < 0.75:
                self.block("h1", self.words(2, 14), 1)
            for _ in range(r.randint(1, 7)):
                kind = r.random()
                if kind < 0.72:
                    self.prose(1, 3, 1)
                elif kind < 0.8:
                    self.block(r.choice(("h2", "h3")), self.words(2, 8), 1)
                elif kind < 0.85:
                    self.html.append("<ul>")
                    for _ in range(r.randint(2, 5)):
                        self.block("li", self.words(3, 30), 1)
                    self.html.append("</ul>")
                elif kind < 0.88:
                    self.html.append("<blockquote>")
                    self.prose(1, 1, 1)
                    self.html.append("</blockquote>")
                elif kind < 0.9:
                    self.html.append("<table><tr>")
                    for _ in range(r.randint(2, 4)):
                        self.block("td", self.words(1, 5), 1)
                    self.html.append("</tr></table>")
                elif kind < 0.94:
                    self.advert()
                elif kind < 0.96:
                    self.side()
                elif kind < 0.98:
                    self.form()
                else:
                    self.notice()
            if r.random() < 0.2:
                self.comments()

        self.wrap(("content", "post", "entry", "article", "story", "entry-content", "post-content", "article-body", "main", "text", "body-text", "post-body", "main-content"), ("article", "article", "article", "main", "section"), fill)

    def made(self) -> tuple[str, list[int]]:
        r = self.rng
        page = self.html
        page.append("<!DOCTYPE html><html><head><title>")
        page.append(self.words(2, 9) + "</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
        self.labels.append(0)
        wrapped = r.random() < 0.35
        if wrapped:
            page.append(f'<div {r.choice(("class", "id"))}="{r.choice(("wrapper", "page", "container", "site", "layout", "root", "app"))}">')
        for part, share in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.75), (self.advert, 0.45), (self.form, 0.15), (self.side, 0.2), (self.article, 1.0), (self.advert, 0.2), (self.side, 0.35), (self.form, 0.2), (self.comments, 0.4), (self.notice, 0.1), (self.footer, 0.85)):
            if r.random() < share:
                part()
        if wrapped:
            page.append("</div>")
        text = "".join(page) + ("</body></html>" if r.random() < 0.8 else "")
        return text, self.labels
