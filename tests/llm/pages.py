"""Pages for held-out accuracy, written apart from the training generator: other words, other layouts, other furniture."""

from __future__ import annotations

import random
from html import escape

NOUNS = "river council bridge engineer harbour winter market teacher village budget museum railway orchard festival clinic library forest captain bakery tunnel glacier archive workshop".split()
VERBS = "opened announced repaired visited described measured crossed rebuilt painted closed studied carried finished promised recorded".split()
EXTRA = "after the long season|because the old plan had failed|without much noise|near the northern gate|according to two residents|for the third time|with help from volunteers|despite heavy rain|when the ferry arrived|as the report explains".split("|")
SECTIONS = "News World Sport Travel Culture Science Health Weather Jobs Archive Opinion Podcasts Maps Video".split()


class Builder:
    def __init__(self, seed: int, kind: str) -> None:
        self.r, self.kind, self.out, self.truth = random.Random(f"{kind}{seed}"), kind, [], []

    def sentence(self) -> str:
        r = self.r
        return f"The {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} {r.choice(EXTRA)}" + r.choice((".", ".", ", and nobody objected.", "; a second one followed."))

    def open(self, role: str) -> str:
        """Opening tag of a container, named by its role, by nothing, or by another role."""
        r = self.r
        right = {"top": "site-header", "menu": "navbar", "story": "article-body", "rail": "sidebar", "talk": "comments-area", "end": "site-footer"}
        if self.kind == "named":
            tag = {"top": "header", "menu": "nav", "story": "article", "rail": "aside", "talk": "section", "end": "footer"}[role]
            name = right[role]
        else:
            tag = r.choice(("div", "div", "section"))
            name = r.choice(("g4", "lay", "u-12", "pane", "zone")) if self.kind == "unnamed" else r.choice([v for k, v in right.items() if k != role])
        self.out.append(f'<{tag} class="{name}">')
        return f"</{tag}>"

    def say(self, tag: str, text: str, good: bool, link: bool = False) -> None:
        body = escape(text)
        self.out.append(f'<{tag}><a href="#">{body}</a></{tag}>' if link else f"<{tag}>{body}</{tag}>")
        if good:
            self.truth.append(text)

    def page(self) -> tuple[str, str]:
        r = self.r
        self.out.append("<!doctype html><html><head>")
        self.say("title", f"{r.choice(NOUNS).title()} {r.choice(NOUNS)}", False)
        self.out.append("<style>a{color:red}</style></head><body>")
        end = self.open("top")
        self.say("div", f"The {r.choice(NOUNS).title()} Post", False, link=True)
        self.out.append(end)
        end = self.open("menu")
        for s in r.sample(SECTIONS, r.randint(3, 9)):
            self.say("div", s, False, link=True)
        self.out.append(end)
        end = self.open("story")
        self.say("h1", self.sentence().rstrip("."), True)
        for k in range(r.randint(3, 9)):
            if k and r.random() < 0.25:
                self.say("h2", f"{r.choice(NOUNS).title()} and {r.choice(NOUNS)}", True)
            self.say("p", " ".join(self.sentence() for _ in range(r.randint(1, 6))), True)
        if r.random() < 0.3:
            self.out.append("<ol>")
            for _ in range(3):
                self.say("li", self.sentence(), True)
            self.out.append("</ol>")
        self.out.append(end)
        if r.random() < 0.6:
            end = self.open("rail")
            self.say("h3", r.choice(("Most read", "Related stories", "Elsewhere")), False)
            for _ in range(r.randint(2, 5)):
                self.say("p", self.sentence(), False, link=True)
            self.out.append(end)
        if r.random() < 0.4:
            end = self.open("talk")
            self.say("h3", f"{r.randint(2, 40)} comments", False)
            for _ in range(r.randint(1, 4)):
                self.say("div", f"{r.choice(NOUNS).title()} says:", False)
                self.say("div", self.sentence(), False)
            self.out.append(end)
        end = self.open("end")
        self.say("div", f"© {r.randint(2001, 2029)} The Post. All rights reserved.", False)
        for s in ("Terms", "Privacy", "Contact"):
            self.say("div", s, False, link=True)
        self.out.append(end + "</body></html>")
        return "".join(self.out), "\n".join(self.truth)


def held_out(kind: str, n: int) -> list[tuple[str, str]]:
    """(html, main text) of ``n`` pages whose containers are "named", "unnamed" or "misnamed"."""
    return [Builder(i, kind).page() for i in range(n)]
