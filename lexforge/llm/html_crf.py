"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read once into leaf blocks, the runs of text between block-level tags, each with its ancestors' tags and class or
id words. A two-state chain (content, other) scores blocks from ancestor and text features and neighbours from each other;
it is trained by maximum likelihood on ``PAGES`` seeded labelled pages from templates that vary layout, naming and
malformed markup, some with containers that name nothing or the wrong thing, and decoded by Viterbi. Content blocks are joined in page
order by newlines.

The reader follows the tokeniser of the HTML standard and never backtracks: a quoted attribute value may hold any number of ``>``, a quote that is never
closed is an ordinary character, ``<!-->`` is an empty comment, an unclosed comment, script or style ends the page, and end tags find their partner in
constant time at any depth. What the ancestors say is carried along from parent to child, so a block costs the same at every depth. Only scripts, styles, comments and
tags are left out by the reader; all else is for the chain to judge. Training is bounded by its parameters
and repeated on the driver for each query; the model is a few hundred weights.

Edge cases: null html counts as empty and gives an empty text; text outside any tag is a block; entities without a semicolon are
decoded as browsers do; a page of any length, depth or tag length is read whole; equal scores go to "other"; repeated rows get equal answers; an empty table gives
an empty result; columns besides page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAGES, SEED, STEPS = 500, 4451, 160
#: Shares of training pages with telling, neutral and misleading names.
SHAPES = (0.7, 0.23, 0.07)

BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul caption head".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
#: An opening tag of the key closes open elements of the values, unless a container lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALLS = frozenset("ul ol dl table body html div section article".split())
NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
ATTRIBUTE = re.compile(r"""(?<![A-Za-z-])([A-Za-z-]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""")
#: The rest of a tag up to its >: a value in quotes is passed over whole. Possessive throughout, so linear.
REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+""")
COMMENT_END = re.compile(r"--!?>")
#: Word stems of class, id and role attributes.
STEMS = {
    "comment": ("comment", "disqus", "reply", "replies", "respond", "discussion", "kommentar", "feedback"),
    "menu": ("nav", "menu", "breadcrumb", "crumb", "toc", "tabs", "pagination", "pager", "skip"),
    "foot": ("footer", "foot", "copyright", "colophon", "legal", "bottom"),
    "side": ("sidebar", "side", "widget", "related", "recommend", "aside", "trending", "popular", "rail", "more"),
    "notice": ("cookie", "consent", "notice", "banner", "alert", "gdpr", "popup", "modal", "overlay", "paywall", "message", "toast"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "dfp"),
    "share": ("share", "social", "subscribe", "newsletter", "follow", "signup", "login", "search", "form"),
    "head": ("header", "masthead", "topbar", "logo", "branding", "site", "hero"),
    "byline": ("byline", "meta", "author", "date", "tags", "tag", "category", "timestamp"),
    "body": ("content", "article", "post", "entry", "story", "main", "text", "body", "page"),
}
AGAINST = frozenset(STEMS) - {"body", "head", "byline"} | {"hidden"}
STEM_OF = {w: k for k, ws in STEMS.items() for w in ws}
TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "table", "li", "section", "title", "blockquote", "pre", "figure", "select", "p", "h1", "h2", "h3", "td", "div", "dd", "button", "label")
TAG_SET = frozenset(TAGS)
#: Elements that never hold main text, and inline ones that can say something.
NEVER = frozenset(("nav", "footer", "aside", "form", "select", "button", "title", "label", "textarea", "template"))
INLINE = frozenset(("button", "label", "span", "time", "small", "textarea", "template"))
SAYS = {
    "cookie": ("cookie", "consent", "privacy", "datenschutz"),
    "rights": ("©", "all rights reserved", "copyright", "alle rechte"),
    "comment": ("reply", "commented", "says:", "leave a comment", "antworten", "répondre", "comments ("),
    "action": ("subscribe", "sign up", "log in", "share this", "follow us", "read more", "click here", "advertisement", "sponsored", "newsletter"),
}


class Context:
    """What an open element and its ancestors say: enough for the features of any block inside it."""

    __slots__ = ("name", "inside", "said", "near", "deepest", "by", "main", "headed", "known")

    def __init__(self, up: Context | None, name: str, words: frozenset[str]) -> None:
        self.name, self.known = name, None
        self.inside = (up.inside if up else frozenset()) if name not in TAG_SET or up and name in up.inside else (up.inside if up else frozenset()) | {name}
        self.said = words if not up else up.said if words <= up.said else up.said | words
        self.near = words or (up.near if up else words)
        main = name in ("article", "main")
        # which container lies deepest: one that holds main text, or one that never does
        self.deepest = "other" if words & AGAINST or name in NEVER else "content" if main or "body" in words else up.deepest if up else "none"
        # whether a tag or only a name says so
        self.by = "tag" if main or name in NEVER else "name" if words & AGAINST or "body" in words else up.by if up else "none"
        self.main = main or bool(up and up.main)
        self.headed = bool(up and (up.headed or name == "header" and up.main))

    def features(self) -> dict[str, float]:
        if self.known is None:
            out = {"one": 1.0, f"tag={self.name}": 1.0, f"deepest={self.deepest}": 1.0, f"deepest={self.deepest} by {self.by}": 1.0}
            out |= {f"in={t}": 1.0 for t in sorted(self.inside)} | {f"word={w}": 1.0 for w in sorted(self.said)} | {f"near={w}": 1.0 for w in sorted(self.near)}
            if self.headed:
                out["header in article"] = 1.0
            self.known = out
        return self.known


def read(html: str) -> list[tuple[str, dict[str, float]]]:
    """(text, features) of the page's leaf blocks, in page order."""
    blocks: list[tuple[str, dict[str, float]]] = []
    outside = Context(None, "none", frozenset())
    stack: list[Context] = []
    # places in the stack of the open elements of each name, and of all block-level ones: no end tag has to search for its partner
    places: dict[str, list[int]] = {}
    solid: list[int] = []
    parts: list[str] = []
    linked = 0
    links = 0
    at, n = 0, len(html)

    def close() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                blocks.append((text, features(text, stack[-1] if stack else outside, linked / max(1, len(raw)))))
            parts.clear()
        linked = 0

    def last(name: str) -> int:
        found = places.get(name)
        return found[-1] if found else -1

    def push(name: str, words: frozenset[str]) -> None:
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            solid.append(len(stack))
        stack.append(Context(stack[-1] if stack else None, name, words))

    def cut(k: int) -> None:
        while len(stack) > k:
            name = stack.pop().name
            places[name].pop()
            if name in BLOCK:
                solid.pop()

    while at < n:
        tag = html.find("<", at)
        if tag < 0:
            tag = n
        if tag > at:
            parts.append(html[at:tag])
            linked += (tag - at) * bool(links)
        if tag == n:
            break
        if html.startswith("<!--", tag):
            empty = 5 if html.startswith(">", tag + 4) else 6 if html.startswith("->", tag + 4) else 0
            end = COMMENT_END.search(html, tag + 4) if not empty else None
            at = tag + empty if empty else end.end() if end else n
            continue
        first = html[tag + 1 : tag + 2]
        closing = first == "/"
        m = NAME.match(html, tag + 1 + closing)
        if not m:
            if first and first in "!?/":
                end = html.find(">", tag)
                at = n if end < 0 else end + 1
            else:
                parts.append("<")
                at = tag + 1
            continue
        end = REST.match(html, m.end()).end()
        name = m.group().lower()
        inside = html[m.end() : end]
        at = end + 1
        if closing:
            if name in BLOCK:
                close()
            if name == "a":
                links = max(0, links - 1)
            k = last(name)
            if k >= 0 and (name in BLOCK or not solid or solid[-1] < k):
                cut(k)
            continue
        if name in RAW:
            at = _raw_end(html, name, at)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        if name == "a":
            links = 1
        if name in BLOCK:
            close()
            links = 0
            if stack and stack[-1].name == "p":
                cut(len(stack) - 1)
            if name in CLOSES:
                wall = max(map(last, WALLS))
                cut(min((k for k in map(last, CLOSES[name]) if k > wall), default=len(stack)))
            push(name, _words(inside))
        elif name in INLINE:
            words = _words(inside)
            if words or name in NEVER:
                push(name, words)
    close()
    return blocks


def _raw_end(html: str, name: str, at: int) -> int:
    """End of a raw element: after its closing tag, or the end of the page."""
    while (at := html.find("</", at)) >= 0:
        stop = at + 2 + len(name)
        if html[at + 2 : stop].lower() == name and (stop >= len(html) or html[stop] in " \t\n\f\r/>"):
            end = html.find(">", at)
            return len(html) if end < 0 else end + 1
        at += 2
    return len(html)


def _words(inside: str) -> frozenset[str]:
    """Stem groups of the element's class, id and role, and "hidden"."""
    if "=" not in inside and "hidden" not in inside:
        return frozenset()
    found = set()
    for key, value in ATTRIBUTE.findall(inside):
        key = key.lower()
        if key in ("class", "id", "role", "itemprop"):
            for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                for form in (word, word.removesuffix("s"), word.removesuffix("ed"), word.removesuffix("ing")):
                    if form in STEM_OF:
                        found.add(STEM_OF[form])
                        break
        elif key == "style" and "none" in value and "display" in value or key == "aria-hidden" and "true" in value:
            found.add("hidden")
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", inside):
        found.add("hidden")
    return frozenset(found)


def features(text: str, context: Context, linked: float) -> dict[str, float]:
    out = dict(context.features())
    n = len(text)
    out[f"length={min(6, n.bit_length() // 2 - 1)}"] = 1.0
    out["linked"] = min(1.0, linked)
    out["mostly linked"] = float(linked > 0.6)
    out["sentence end"] = float(text[-1] in ".!?…:;\"'”»")
    out["sentences"] = min(1.0, sum(text.count(c) for c in (". ", "! ", "? ")) / 4)
    low = text.lower()
    for k, words in SAYS.items():
        if any(w in low for w in words):
            out[f"says {k}"] = 1.0
            if context.deepest != "content":
                out[f"says {k} outside"] = 1.0
    out["digits"] = min(1.0, 5 * sum(map(str.isdigit, text)) / max(200, n))
    return out


# -- training pages ------------------------------------------------------------------------------------------------


#: Names of containers that say nothing.
NEUTRAL = ("c1", "c12", "box", "row", "col-8", "inner", "wrap", "block", "x7", "outer", "grid", "cell")


def _page(r: random.Random, shapes: tuple[float, ...]) -> tuple[str, list[tuple[str, bool]]]:
    """A labelled page: its html, and (text, is content) of every block in order.

    ``shapes`` weighs pages that name their containers, give them neutral names, or names drawn without regard to what they hold.
    """
    shape = r.choices(("named", "neutral", "lying"), shapes)[0]
    said: list[tuple[str, bool]] = []
    html: list[str] = []

    def words(lo: int, hi: int) -> str:
        w = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(r.randint(1, 9))) for _ in range(r.randint(lo, hi))]
        for i in range(r.randint(6, 14), len(w) - 1, r.randint(7, 15)):
            w[i] += "."
        return " ".join(w).capitalize() + r.choice((".", ".", ".", "", "!", "?"))

    def put(text: str, good: bool, tag: str, attrs: str = "", link: bool = False) -> None:
        body = f'<a href="/{r.randint(1, 99)}">{text}</a>' if link else text
        html.append(f"<{tag}{attrs}>{body}</{tag}>" if tag != "p" or r.random() < 0.85 else f"<p{attrs}>{body}")
        said.append((text, good))

    def wrap(names: tuple[str, ...], stems: tuple[str, ...], chance: float = 0.7) -> tuple[str, str]:
        if shape == "neutral":
            return r.choice(("<div>", f'<div class="{r.choice(NEUTRAL)}">', f'<div id="{r.choice(NEUTRAL)}">')), "</div>"
        if shape == "lying":
            names, stems = ("div", "section"), r.choice(tuple(STEMS.values()))
        tag = r.choice(names)
        named = r.random() < chance or tag == "div"
        stem = r.choice(stems) + r.choice(("", "", "-wrapper", "-1", " clearfix", "_box"))
        return f"<{tag}" + (f' {r.choice(("class", "id", "class"))}="{stem}">' if named else ">"), f"</{tag}>"

    def group(names, stems, fill, chance=0.7) -> None:
        a, b = wrap(names, stems, chance)
        html.append(a)
        fill()
        html.append(b)

    def menu() -> None:
        if r.random() < 0.3:
            put(words(1, 3), False, r.choice(("h2", "h3", "div", "p")))
        html.append("<ul>")
        for _ in range(r.randint(2, 9)):
            put(words(1, 3), False, "li", link=r.random() < 0.9)
        html.append("</ul>")

    def comments() -> None:
        put(r.choice(("Comments", "3 comments", "Leave a comment", words(1, 3))), False, r.choice(("h2", "h3")))
        for _ in range(r.randint(1, 5)):
            if r.random() < 0.6:
                put(f"{words(1, 2)} {r.choice(('says:', 'replied', ''))}", False, "div")
            put(words(4, 60), False, r.choice(("p", "div", "li")))

    def form() -> None:
        put(r.choice(("Subscribe to our newsletter", "Sign up", words(1, 4))), False, r.choice(("p", "h3", "div")))
        html.append('<input type="text"><button>Go</button>')
        said.append(("Go", False))

    def notice() -> None:
        put(r.choice(("We use cookies to improve this site.", "This site uses cookies. Accept?", words(6, 20))), False, r.choice(("p", "div")))

    def advert() -> None:
        put(r.choice(("Advertisement", words(4, 14), words(4, 20))), False, r.choice(("p", "div", "p")))

    def side() -> None:
        put(words(1, 4), False, r.choice(("h2", "h3", "h4")))
        if r.random() < 0.5:
            menu()
        for _ in range(r.randint(0, 3)):
            put(words(4, 22), False, "p", link=shape != "named" or r.random() < 0.5)

    def foot() -> None:
        for _ in range(r.randint(1, 3)):
            put(r.choice((f"© {r.randint(1999, 2030)} {words(1, 4)}", f"&copy; {words(2, 6)} &middot; {words(2, 9)}", "All rights reserved.", words(3, 15))), False, r.choice(("p", "div")))
        if r.random() < 0.4:
            menu()

    html.append('<!DOCTYPE html><html lang="en"><head><meta charset="utf-8">')
    full = r.random() < 0.85  # else a fragment that begins with its article
    if full:
        put(words(3, 10), False, "title")
    html.append("<script>var a='<p>no</p>';</script><style>p{margin:0}</style></head><body>")
    if shape != "named" and r.random() < 0.5:
        html.append(r.choice(('<div class="content">', '<div id="page">', '<div class="wrap">')))
    ads = ("ad", "ads", "advert", "sponsored", "promo-box", "ad-slot")
    prose = shape == "named"  # where no name tells, prose that is not the article's cannot be told from it
    if r.random() < 0.3 * prose * full:
        group(("div", "section"), ("cookie-notice", "consent", "notice", "banner", "alert"), notice)
    if r.random() < 0.45 * full:
        group(("header", "div"), ("header", "masthead", "topbar", "site-header"), lambda: (put(words(1, 4), False, r.choice(("h1", "p", "div"))), menu() if r.random() < 0.5 else None))
    if r.random() < 0.75 * full:
        group(("nav", "div", "nav"), ("nav", "menu", "breadcrumb", "main-menu"), menu, 0.4)
    if r.random() < 0.5 * prose * full:
        group(("div",), ads, advert)
    if r.random() < 0.2 * full:
        group(("aside", "div"), ("sidebar", "widget", "left-rail"), side)
    a, b = wrap(("article", "article", "main", "div", "section"), ("content", "article", "post", "entry-content", "story-body", "main"), 0.5)
    if a.startswith("<section>"):
        a = '<section class="content">'
    bare = r.random()
    if bare < 0.10:  # no container, or one whose name says nothing
        a, b = "", ""
    elif bare < 0.18:
        a, b = f'<div class="{r.choice(("wrap", "c12", "box", "inner", "col-8"))}">', "</div>"
    outer = r.random() < 0.25
    html.append("<main>" * outer + a)
    brief = r.random() < 0.15  # an article of one block, or two
    if r.random() < (0.3 if brief else 0.8):
        in_header = r.random() < 0.15
        html.append("<header>" * in_header)
        put(words(3, 14), True, "h1" if r.random() < 0.85 else "h2")
        html.append("</header>" * in_header)
    for k in range(1 if brief else r.randint(1, 14)):
        kind = r.random()
        if kind < 0.72 or brief:
            text = words(3, 5) if r.random() < 0.25 else words(6, r.choice((12, 40, 120)))
            if r.random() < 0.06:  # an article may say what footers and notices say
                text = r.choice(("All rights reserved.", f"© {r.randint(1999, 2030)} {words(1, 3)}", f"Cookie and privacy {words(2, 9)}", f"Subscribe to {words(1, 6)}", f"{words(1, 3)} says: {words(3, 9)}"))
            put(text, True, "p" if r.random() < 0.93 else "div")
        elif kind < 0.80:
            put(words(1, 8), True, r.choice(("h2", "h3")))
        elif kind < 0.86:
            html.append("<ul>")
            for _ in range(r.randint(2, 5)):
                put(words(3, 25), True, "li")
            html.append("</ul>")
        elif kind < 0.90:
            put(words(6, 40), True, r.choice(("blockquote", "pre")))
        elif kind < 0.93:
            html.append("<table><tr>")
            for _ in range(4):
                put(words(1, 5), True, "td")
            html.append("</tr></table>")
        elif k and prose:
            pick = r.random()
            if pick < 0.5:
                group(("div", "aside"), ads, advert, 1.0)
            elif pick < 0.75:
                group(("div",), ("share", "social", "newsletter", "subscribe"), form)
            else:
                group(("aside", "div"), ("related", "sidebar", "recommended"), side)
    inside_comments = r.random() < 0.12
    talk = lambda: group(("div", "section"), ("comments", "comment-list", "disqus", "replies", "respond"), comments, 1.0)
    if inside_comments:
        talk()
    html.append(b + "</main>" * outer)
    if bare < 0.10 and r.random() < 0.6:
        html.append("<hr>" * r.randint(0, 1))
        put(r.choice((f"© {r.randint(1999, 2030)} {words(1, 4)}", "All rights reserved.", f"&copy; {r.randint(1999, 2030)} All rights reserved.")), False, "p")
    if not inside_comments and r.random() < 0.35:
        talk()
    if r.random() < 0.3:
        html.append("<form action='/s'>")
        form()
        html.append("</form>")
    if r.random() < 0.35:
        group(("aside", "div"), ("sidebar", "widget", "related-posts"), side)
    if r.random() < 0.2 * prose:
        group(("div",), ads, advert)
    if r.random() < 0.85:
        group(("footer", "footer", "div"), ("footer", "site-footer", "copyright"), foot, 0.4)
    return "".join(html) + ("</body></html>" if r.random() < 0.8 else ""), said


def labelled_pages(n: int, seed: int, shapes: tuple[float, ...] = SHAPES) -> list[tuple[list[dict[str, float]], list[int]]]:
    """Features and labels of the blocks of ``n`` pages; labels are carried by page order."""
    r, out = random.Random(seed), []
    while len(out) < n:
        html, said = _page(r, shapes)
        want = [(" ".join(unescape(t).split()), good) for t, good in said]
        got = read(html)
        k, labels = 0, []
        for text, _ in got:
            while k < len(want) and not (want[k][0] and (text.startswith(want[k][0]) or want[k][0].startswith(text) or text.endswith(want[k][0]))):
                k += 1
            labels.append(int(k < len(want) and want[k][1]))
            k += 1
        out.append(([f for _, f in got], labels))
    return out


# -- the chain -----------------------------------------------------------------------------------------------------


class Chain:
    """Two-state linear chain: weights for content against other, a transition matrix and start scores."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weight = np.zeros(0)
        self.move, self.start = np.zeros((2, 2)), np.zeros(2)

    def fit(self, pages: list[tuple[list[dict[str, float]], list[int]]], steps: int = STEPS, rate: float = 0.25, decay: float = 1e-5, linked: bool = True) -> Chain:
        """Maximum likelihood; without ``linked`` the blocks are independent, a logistic regression for comparison."""
        for blocks, _ in pages:
            for f in blocks:
                for k in f:
                    self.index.setdefault(k, len(self.index))
        count, longest, wide = len(pages), max(len(b) for b, _ in pages), len(self.index)
        x = np.zeros((count, longest, wide), np.float32)
        y, live = np.zeros((count, longest), np.int64), np.zeros((count, longest), bool)
        for i, (blocks, labels) in enumerate(pages):
            for j, f in enumerate(blocks):
                x[i, j, [self.index[k] for k in f]] = list(f.values())
            y[i, : len(labels)], live[i, : len(labels)] = labels, True
        theta = np.zeros(wide + 6)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        total = live.sum()
        flat = x.reshape(-1, wide)
        pair = live[:, 1:] & live[:, :-1]
        seen = np.array([[(pair & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
        first = np.array([(y[:, 0] == a).sum() for a in (0, 1)], float)
        for t in range(1, steps + 1):
            w, move, start = theta[:wide], theta[wide : wide + 4].reshape(2, 2), theta[wide + 4 :]
            emit = np.zeros((count, longest, 2))
            emit[:, :, 1] = (flat @ w.astype(np.float32)).reshape(count, longest)
            alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
            alpha[:, 0] = start + emit[:, 0]
            for j in range(1, longest):
                step = np.logaddexp.reduce(alpha[:, j - 1, :, None] + move, axis=1) + emit[:, j]
                alpha[:, j] = np.where(live[:, j, None], step, alpha[:, j - 1])
            for j in range(longest - 2, -1, -1):
                step = np.logaddexp.reduce(move + (emit[:, j + 1] + beta[:, j + 1])[:, None, :], axis=2)
                beta[:, j] = np.where(live[:, j + 1, None], step, 0.0)
            norm = np.logaddexp.reduce(alpha[:, -1], axis=1)
            node = np.exp(alpha + beta - norm[:, None, None])
            edge = np.exp(alpha[:, :-1, :, None] + move + (emit + beta)[:, 1:, None, :] - norm[:, None, None, None])
            g = np.concatenate([flat.T @ (((y == 1) - node[:, :, 1]) * live).reshape(-1), (seen - (edge * pair[:, :, None, None]).sum(axis=(0, 1))).ravel(), first - node[:, 0].sum(axis=0)]) / total
            g -= decay * theta
            g[wide:] *= linked
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weight, self.move, self.start = theta[:wide], theta[wide : wide + 4].reshape(2, 2), theta[wide + 4 :]
        self.scores = {k: float(self.weight[i]) for k, i in self.index.items()}
        return self

    def decode(self, blocks: list[dict[str, float]]) -> list[bool]:
        """The most probable states (Viterbi)."""
        if not blocks:
            return []
        get = self.scores.get
        (aa, ab), (ba, bb) = self.move.tolist()
        back: list[tuple[int, int]] = []
        s0, s1 = self.start.tolist()
        for j, f in enumerate(blocks):
            e = sum(get(k, 0.0) * v for k, v in f.items())
            if j:
                from0, from1 = int(s1 + ba > s0 + aa), int(s1 + bb > s0 + ab)
                s0, s1 = max(s0 + aa, s1 + ba), max(s0 + ab, s1 + bb)
                back.append((from0, from1))
            s1 += e
        state = int(s1 > s0)
        out = [bool(state)]
        for choice in reversed(back):
            state = choice[state]
            out.append(bool(state))
        return out[::-1]


@cache
def train(pages: int = PAGES, seed: int = SEED) -> Chain:
    return Chain().fit(labelled_pages(pages, seed))


def extract(html: str | None, model: Chain) -> str:
    blocks = read(html or "")
    return "\n".join(t for (t, _), good in zip(blocks, model.decode([f for _, f in blocks])) if good)


def extract_table(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    model = train()
    rows = pages.select("page_id", "url", "html")
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [extract(x.as_py(), model) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    return rows.mapInArrow(run, schema)
