"""Citation parser: "TCK m. 141/2-a" to law, article, paragraph and clause (CIT-01 to CIT-14).

The query is folded to plain lower case character by character, so positions hold in both texts. Scanners find marks of four kinds;
``leftmost_longest`` settles overlaps within a kind and ``clear_of`` across kinds. Each article mark then looks for its owner, the nearest
law before it (else after), and for the first paragraph and clause before the next boundary.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from lexforge.functions import citation_values as V
from lexforge.functions import fixed as X

from .kernels import rx

FOLD = str.maketrans(X.FOLD_FROM, X.FOLD_TO)
LAW_OF = {short: number for short, number, _ in V.ABBREVIATIONS}
ROMAN_VALUE = {r: i for i, r in enumerate(V.ROMAN, 1)}
ORDINAL_VALUE = {w: i for i, w in enumerate(V.ORDINALS, 1)} | {"onuncu": 10, "yirminci": 20, "son": V.LAST}
KIND = {None: "asil", "gec.": "gecici", "muk.": "mukerrer"}


def fold(text: str) -> str:
    """TXT-06: one character for one character."""
    return "".join(low if len(low := c.lower()) == 1 else c for c in text.translate(FOLD))


def lower(text: str) -> str:
    return text.translate(str.maketrans("İI", "iı")).lower()


def upper(text: str) -> str:
    return text.translate(str.maketrans("iı", "İI")).upper()


def law_number(text: str) -> str:
    return text.lstrip("0") or text


@dataclass(frozen=True)
class Mark:
    """What a scanner found at [start, end)."""

    start: int
    end: int
    rank: int = 0


@dataclass(frozen=True)
class Law(Mark):
    numbers: tuple[str, ...] = ()
    source: str = "numara"
    hint: str | None = None
    qualified: bool = False  # "eski", a foreign code, another year's constitution: not today's law
    amending: bool = False  # "6545 sayılı Kanunla değişik": not the owner of what follows


@dataclass(frozen=True)
class Article(Mark):
    kind: str = "asil"
    number: int = 0
    letter: str | None = None
    roman: bool = False
    paragraph: int | None = None
    clause: str | None = None
    foreign: bool = False  # an article of a regulation, decree or treaty


@dataclass(frozen=True)
class Value(Mark):
    value: Any = None


@dataclass
class Parsed:
    citations: list[dict[str, Any]] = field(default_factory=list)
    laws: list[Law] = field(default_factory=list)
    without_law: int = 0
    qualified: int = 0
    foreign: int = 0

    def diagnosis(self) -> str:
        """CIT-14: why there is no citation."""
        numbers = sorted({n for law in self.laws for n in law.numbers})
        reasons = (
            (self.citations, ""),
            (self.qualified, "qualified_law: an old or foreign law is named; give its number"),
            (self.foreign, "other_document: the article belongs to a regulation, communique, decree or treaty"),
            (self.laws, f"law_only: {', '.join(numbers)}"),
            (self.without_law, "article_only: no law was recognised"),
        )
        return next((said for has, said in reasons if has), "nothing: no law and no article")


def leftmost_longest(marks: Iterable[Mark]) -> list:
    """CIT-03: greedy choice from the left; longer first, then by rank."""
    out: list = []
    for m in sorted(marks, key=lambda m: (m.start, -m.end, m.rank)):
        if not out or m.start >= out[-1].end:
            out.append(m)
    return out


def overlaps(mark: Mark, others: Iterable[Mark]) -> bool:
    """CIT-02."""
    return any(mark.start < o.end and o.start < mark.end for o in others)


def clear_of(marks: list, others: list) -> list:
    return [m for m in marks if not overlaps(m, others)]


# -- laws (CIT-04 to CIT-06) -----------------------------------------------------------------------------------------


def names_law(word: str, following: str) -> bool:
    """Does a word after a number say that it is a law?"""
    bare = word.rstrip(".")
    if bare.startswith("kanun"):
        return not following.startswith("hukmunde")
    stem = bare.split("'")[0]
    return bare.startswith(("yasa", "anayasa")) or word in ("k", "k.") or stem in LAW_OF and stem != "ay"


def names_other(words: list[str]) -> bool:
    """Do the first words after "sayılı" name another kind of document?"""
    first, second = (*words, "", "")[:2]
    pair = any(first.startswith(a) and second.startswith(b) for a, b in V.NOT_LAW_PAIRS)
    return pair or first.startswith(V.NOT_LAW_PREFIXES) or first in V.NOT_LAW_WORDS


def numbered_laws(text: str) -> Iterator[Law]:
    """CIT-05."""
    for m in rx(V.NUMBERED_LAW).finditer(text):
        number = (law_number(m["no"]),)
        ahead = list(rx(V.WORD).finditer(text, m.end(), min(len(text), m.end() + V.HINT_CHARS)))
        words = [w[0] for w in ahead] + [""]
        if m["how"] != "sayili":  # a weak form: the law must be named at once
            if ahead and names_law(words[0], words[1]):
                yield Law(m.start(), ahead[0].end(), numbers=number)
            continue
        own = [w[0].rstrip(".") for w in ahead if not w[0].startswith("'")]
        if own and names_other(own):
            continue
        end, hint, named = m.end(), [], False
        for w, following in zip(ahead[: V.HINT_WORDS], words[1:]):
            if w[0][0].isdigit():
                break
            if w[0].startswith("'"):
                end = end if hint else w.end()
            elif names_law(w[0], following):
                end, named = w.end(), True
                break
            else:
                hint.append(w[0].rstrip("."))
        if named or not any(h.startswith(V.NOT_LAW_TITLES) for h in hint):
            yield Law(m.start(), end, numbers=number, hint=" ".join(hint) or None)


def abbreviation_pattern() -> str:
    dotted = [s if s == "ay" else r"\.?".join(s) + r"\.?" for s in sorted(LAW_OF, key=len, reverse=True)]
    return rf"(?<![a-z0-9])(?P<short>{'|'.join(dotted)}){V.CASE_ENDING}"


def abbreviated_laws(text: str, query: str) -> Iterator[Law]:
    hints = {short: fold(name) for short, _, name in V.ABBREVIATIONS}
    for m in rx(abbreviation_pattern()).finditer(text):
        short = m["short"].replace(".", "")
        if short == "ay":  # also "month": capitals count, and in an all-capital query only before a plain article word
            sure = query[m.start() : m.start() + 2] == "AY" and (not query.isupper() or rx(V.STRONG_ARTICLE).match(text, m.end()))
            if not sure:
                continue
        yield Law(m.start(), m.end(), numbers=(LAW_OF[short],), source="kisaltma", hint=hints[short])


def named_laws(text: str, names: Iterable[tuple[str, tuple[str, ...]]]) -> Iterator[Law]:
    flat = rx(V.NAME_HYPHEN).sub(" ", text)
    for words, number in V.NAMES:
        for m in rx(r"(?<![a-z0-9])" + words.replace(" ", r"\s+") + V.NAME_ENDING).finditer(flat):
            yield Law(m.start(), m.end(), numbers=(number,), source="ad", hint=m[0])
    for m in rx(V.LABOUR_LAW).finditer(flat):
        yield Law(m.start(), m.end(), numbers=(V.LABOUR,), source="ad", hint="is kanunu")
    for m in rx(r"(?<![a-z0-9])anayasa(?!l)[a-z']*").finditer(text):
        if not rx(r"\s*mahkeme").match(text, m.end()):
            yield Law(m.start(), m.end(), numbers=(V.CONSTITUTION,), source="ad", hint="anayasa")
    for name, numbers in names:  # CIT-04: an inflected name reaches to the end of its ending
        for m in re.finditer(rf"(?<![^\W_])(?={re.escape(name)})", flat):
            end = rx(r"(?:[^\W\d_]|')*").match(flat, m.start() + len(name)).end()
            yield Law(m.start(), end, 1, tuple(numbers), "korpus_adi", name)


def find_laws(text: str, query: str, names: Iterable[tuple[str, tuple[str, ...]]]) -> list[Law]:
    """CIT-06: every law mark, with its qualifier and whether it only amends."""

    def judged(law: Law) -> Law:
        before = text[: law.start]
        word, year = rx(V.LAST_WORD).search(before[-24:]), rx(V.LAST_YEAR).search(before[-12:])
        old = law.source != "numara" and (
            bool(word and word[1] in V.QUALIFIERS) or bool(law.numbers == (V.CONSTITUTION,) and year and year[1] != V.CONSTITUTION_YEAR)
        )
        with_it = rx(V.WITH_ENDING).search(text, law.start, law.end) and rx(rf"\s{V.AMENDED}").match(text, law.end)
        return replace(law, qualified=old, amending=bool(with_it or rx(rf"\sile\s{V.AMENDED}").match(text, law.end)))

    labelled = (Law(m.start(), m.end(), numbers=(law_number(m["no"]),)) for m in rx(V.LAW_NUMBER_LABEL).finditer(text))
    found = [*numbered_laws(text), *labelled, *abbreviated_laws(text, query), *named_laws(text, names)]
    return leftmost_longest(map(judged, found))


# -- articles (CIT-07, CIT-08) ---------------------------------------------------------------------------------------


def article(m: re.Match[str], query: str, start: int, kind: str | None = None) -> Article | None:
    """CIT-07: an article mark with what its slash means; None for an impossible Roman number."""
    own = Article(start, m.end(), kind=KIND.get(kind, kind), number=int(m["no"]))
    part = m["part"]
    if part is None:
        return own
    group = "sub1" if m["sub1"] is not None else "sub2"
    sub = m[group]
    clause = sub and (str(int(sub)) if sub.isdigit() else lower(query[m.start(group)]))
    if part.isdigit():
        return replace(own, paragraph=int(part), clause=clause)
    if len(part) > 1:
        return replace(own, paragraph=ROMAN_VALUE[part], clause=clause) if part in ROMAN_VALUE else None
    roman = part in ("i", "v", "x")
    keeps = roman and sub is not None and not sub.isdigit()
    return replace(own, letter=query[m.start("part")], roman=roman, clause=clause if keeps else None)


def find_articles(text: str, query: str, laws: list[Law]) -> list[Article]:
    """CIT-08: article marks by spelling; the weaker the sign, the more that follows may speak against it."""
    ruled_out = lambda end, strength: rx(V.NOT_ARTICLE[strength]).match(text, end) is not None
    found: list[Article] = []

    def add(m: re.Match[str], kind: str | None, strength: str | None) -> None:
        if (a := article(m, query, m.start(), kind)) and not (strength and ruled_out(m.end(), strength)):
            found.append(a)

    for m in rx(V.ARTICLE_BEFORE).finditer(text):
        if m["word"] != "m" or m.start("no") > m.end("word"):  # "m2" is a unit
            add(m, m["kind"], "word" if m["word"] in ("madde", "maddesi", "m") else "strong")
    for m in rx(V.ARTICLE_PREFIXED).finditer(text):
        word = (m["word"] or "").strip()
        if not word or m["ord"] or word.startswith("maddesi"):  # "ek 3 madde eklendi" counts articles
            add(m, m["kind"], None if word else "weak")
    for m in rx(V.ARTICLE_AFTER).finditer(text):
        if m["ord"] or m["part"] or m["tail"].startswith("si"):
            add(m, None, None)
    chosen = [a for a in clear_of(leftmost_longest(found), laws) if a.number > 0]
    chosen = [replace(a, foreign=rx(V.OTHER_DOCUMENT).search(text[max(0, a.start - 40) : a.start]) is not None) for a in chosen]
    for law in laws:  # a bare number right after a law
        m = rx(V.ARTICLE_BARE).match(text, law.end)
        if m is None or int(m["no"]) == 0 or overlaps(Mark(m.start("no"), m.end()), [*chosen, *laws]):
            continue
        if rx(V.ARTICLE_WORD).match(text, m.end("no")) or ruled_out(m.end(), "weak"):
            continue
        a = article(m, query, m.start("no"))
        fraction = a and a.paragraph and a.number < a.paragraph and rx(V.FRACTION_AFTER).match(text, m.end())
        if a and not fraction:
            chosen.append(a)
    return sorted(chosen, key=lambda a: a.start)


# -- paragraphs and clauses (CIT-09, CIT-10) -------------------------------------------------------------------------


def find_paragraphs(text: str) -> list[Value]:
    """CIT-09."""
    words = [Value(m.start(), m.end(), value=ORDINAL_VALUE[m["word"]] + (10 if m["ten"] and m["word"] in V.ORDINALS else 0)) for m in rx(V.PARAGRAPH_WORD).finditer(text)]
    numbers = [Value(m.start(), m.end(), value=int(m["n"])) for p in V.PARAGRAPH_NUMBERS for m in rx(p).finditer(text)]
    return leftmost_longest(words + [v for v in numbers if v.value > 0])


def find_clauses(text: str, query: str) -> list[Value]:
    """CIT-10: "alt bendi" (a sub-clause) is not read."""
    named = lambda m: str(int(m["n"])) if m["n"].isdigit() else lower(query[m.start("n")])
    found = [Value(m.start(), m.end(), value=named(m)) for p in V.CLAUSES for m in rx(p).finditer(text)]
    return leftmost_longest(v for v in found if v.value != "0")


# -- citations (CIT-01, CIT-11 to CIT-13) ----------------------------------------------------------------------------


def owner(laws: list[Law], a: Article) -> Law | None:
    """CIT-11: the nearest law before the article, else the nearest after it; amending laws own nothing."""
    able = [law for law in laws if not law.amending]
    before = [law for law in able if law.end <= a.start]
    after = [law for law in able if law.start >= a.end]
    return before[-1] if before else after[0] if after else None


def readings(a: Article, paragraph: int | None, clause: str | None) -> list[dict[str, Any]]:
    """CIT-13: what the citation may mean; a letter after a slash is an article's suffix, or a Roman paragraph, or a clause."""
    plain = {"madde_tipi": a.kind, "madde_numara": str(a.number), "fikra": paragraph, "bent": clause, "aciklama": None}
    if a.letter is None:
        return [plain]
    out = [plain | {"madde_numara": f"{a.number}/{upper(a.letter)}"}]
    if a.roman and paragraph is None:
        out.append(plain | {"fikra": ROMAN_VALUE[fold(a.letter)], "aciklama": "roma->fikra"})
    if clause is None:
        out.append(plain | {"bent": lower(a.letter), "aciklama": "harf->bent"})
    return out


def parse(query: str, names: Iterable[tuple[str, tuple[str, ...]]] = ()) -> Parsed:
    """CIT-01: the citations of a query, in order, without repeats."""
    query = " ".join(query.split())
    text = fold(query)
    laws = find_laws(text, query, names)
    articles = find_articles(text, query, laws)
    taken: list[Mark] = [*articles, *laws]
    paragraphs = clear_of(find_paragraphs(text), taken)
    clauses = clear_of(find_clauses(text, query), [*taken, *paragraphs])
    out, seen = Parsed(laws=laws), set()
    for i, a in enumerate(articles):
        law = owner(laws, a)
        if a.foreign:
            out.foreign += 1
        elif law is None:
            out.without_law += 1
        elif law.qualified:
            out.qualified += 1
        else:
            # CIT-12: up to the next article or law
            limit = min([b.start for b in articles[i + 1 :]] + [w.start for w in laws if w.start >= a.end and not w.amending], default=len(text))
            first = lambda marks, end=a.end, limit=limit: next((v for v in marks if end <= v.start < limit), None)
            p = first(paragraphs) if a.paragraph is None else None
            c = first(clauses) if a.clause is None else None
            read = readings(a, p.value if p else a.paragraph, c.value if c else a.clause)
            if (key := (law.numbers, *read[0].values())) not in seen:
                seen.add(key)
                ends = [law.end, a.end, *[v.end for v in (p, c) if v]]
                out.citations.append(
                    {"kanun_nolari": list(law.numbers), "yorumlar": read, "kanun_kaynak": law.source, "kanun_ipucu": law.hint, "ham": query[min(law.start, a.start) : max(ends)].strip()}
                )
    return out


# -- sub-parts (RES-04) ----------------------------------------------------------------------------------------------


def mark_of(sign: str | None) -> str:
    return lower((sign or "").strip().rstrip(").").strip())


def paragraph_number(no: str | None) -> int | None:
    m = rx(r"\(\s*([0-9]+)\s*\)").fullmatch((no or "").strip())
    return int(m[1]) if m else None


def sub_part(tree: list[dict[str, Any]] | None, paragraph: int | None, clause: str | None) -> dict[str, Any]:
    """RES-04: the paragraph or clause asked for, whether it was found exactly, and warnings.

    A numbered paragraph is looked up by number, ``LAST`` takes the last one, unnumbered paragraphs count by place. Where numbers
    mark clauses instead, ``paragraph N`` may mean the clause ``N.``.
    """
    tree = tree or []
    clauses_of = lambda p: p["bentler"] if p["bentler"] is not None else []

    def result(p=None, c=None, exact=True, warnings=(), tolerance=None):
        unit = c or p
        part = unit and {"fikra": p["no"], "bent": c and c["isaret"], "metin": unit["text"] or "", "yurutluk": unit["yurutluk"] or "", "tolerans": tolerance}
        return {"parca": part, "tam": exact, "uyarilar": list(warnings)}

    def clause_in(places, sign, dotted=False):
        hits = ((p, c) for p in places for c in clauses_of(p) if mark_of(c["isaret"]) == sign and (not dotted or (c["isaret"] or "").strip().endswith(".")))
        return next(hits, (None, None))

    if paragraph is None and clause is None:
        return result()
    if paragraph is None:
        p, c = clause_in(tree, clause)
        return result(p, c) if c else result(exact=False, warnings=[f"clause_missing:{clause}"])
    numbers = [paragraph_number(p["no"]) for p in tree]
    counted = any(n is not None for n in numbers)
    if paragraph == V.LAST:
        chosen = tree[-1] if tree else None
    elif counted:
        chosen = tree[numbers.index(paragraph)] if paragraph in numbers else None
    else:
        chosen = tree[paragraph - 1] if 1 <= paragraph <= len(tree) else None
    p, c = clause_in(tree, str(paragraph), dotted=True) if paragraph != V.LAST else (None, None)
    if c and (chosen is None or not counted):
        return result(p, c, clause is None, [f"paragraph_as_clause:{paragraph}"] + ([f"clause_not_sought:{clause}"] if clause else []), "fikra->bent")
    if chosen is None:
        return result(exact=False, warnings=[f"paragraph_missing:{paragraph}"])
    if clause is None:
        return result(chosen, warnings=[f"clause_also:{paragraph}"] if c else [])
    p, c = clause_in([chosen], clause)
    return result(p, c) if c else result(chosen, exact=False, warnings=[f"clause_missing:{clause}"])
