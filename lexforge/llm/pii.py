"""Personal data by candidate gradient boosting.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stay. High-recall generators then propose
further, overlapping candidates: local phone numbers, identity numbers, bank accounts, network addresses, dates, written-out
e-mail addresses. Boosted trees score each candidate from its format and context; scores are calibrated on held-out
examples and each kind has the least threshold at which held-out precision reaches ``PRECISION``. Of overlapping
candidates the most probable stays; candidates that overlap a base span go.

No table labels personal spans, so the trees are trained on ``EXAMPLES`` seeded sentences from templates, which place true
spans and look-alikes (order numbers, versions, prices, plain dates) in fitting and in misleading contexts. Training is
bounded by that parameter and is repeated on the driver for each query; the model is a few kilobytes.

Six formats are proposed; names and postal addresses are not, since a pattern cannot propose them.

Edge cases: null text counts as empty; an empty text has no spans; every generator runs over every whole text, in linear time; of equally probable
candidates the first in text, then in kind order, stays; repeated rows get equal answers; an empty table gives an empty result; columns besides doc_id and text
are ignored by ``find_pii`` and kept by ``redact``, whatever their names. Each row is judged alone, without a shuffle.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Boosted
from .common import map_rows

Span = tuple[int, int, str]

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "identity", "account", "network", "birth", "spelled_email")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}
EXAMPLES, SEED, PRECISION, CONTEXT = 6000, 9176, 0.97, 32
DOTS = ("(dot)", "[dot]")

# Fixed values of the base contract.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

GENERATORS = {
    "local_phone": re.compile(r"(?<![\w+])\(?[0-9]{2,4}\)?(?:[ ./-][0-9]{2,4}){2,4}(?!\w)"),
    "identity": re.compile(r"(?<!\w)(?:[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}|[A-Z]{1,3}[0-9]{6,9}[A-Z]?|[0-9]{9,12})(?!\w)"),
    "account": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "network": re.compile(r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2})(?![\w:])"),
    "birth": re.compile(r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![\w/-])"),
    "spelled_email": re.compile(r"(?<![\w.-])[A-Za-z0-9._-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++(?!\w)"),
}
#: Words before or after a candidate that speak for or against a kind, in five languages' common forms.
CUES = {
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "appel", "llame"),
    "identity": ("ssn", "social", "passport", "identity", "national id", "licence", "license no", "ausweis", "pasaporte", "passeport", "dni"),
    "account": ("iban", "account", "konto", "cuenta", "compte", "bank"),
    "network": ("mac", "ipv6", "host", "address", "device"),
    "birth": ("born", "birth", "dob", "geboren", "naissance", "nacim"),
    "contact": ("mail", "contact", "write", "reach", "kontakt"),
    "against": ("version", "order", "invoice", "isbn", "page", "price", "model", "serial", "ticket", "build", "published", "due", "total", "ref", "chapter", "release", "score", "updated"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """The pattern's leftmost matches, found from each @ outwards so that long words cost no more than their length."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end(), "email"
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[Span]:
    out = list(_emails(text)) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def candidates(text: str) -> list[Span]:
    return [(m.start(), m.end(), kind) for kind, pattern in GENERATORS.items() for m in pattern.finditer(text)]


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) > 14 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    """Format of the span (lengths, groups, checks) and cues in ``CONTEXT`` characters around it."""
    start, end, kind = span
    s = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT].lower()
    digits = [c for c in s if c.isdigit()]
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    seps = set(re.findall(r"[^0-9A-Za-z]", s))
    year = next((int(g) for g in re.findall(r"[0-9]{4}", s)), 0)
    cues = [max((before.rfind(w) + 1 for w in words), default=0) / CONTEXT for words in CUES.values()]
    later = [float(any(w in after for w in words)) for words in CUES.values()]
    return [
        float(ORDER[kind]), float(len(s)), float(len(digits)), len(digits) / len(s), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(len(seps)), float("(" in s), float(groups == [3, 2, 4]), float(groups in ([3, 3, 4], [2, 4, 4], [3, 4])), float(len(set(digits))),
        float(kind == "account" and _mod97(s)), float(luhn("".join(digits))), float(1920 <= year <= 2012), float(len(set(s)) / len(s)),
        float(before[-1:] in "$€£#%"), float(before[-1:] == "" or before[-1:].isspace()), float(before.rstrip()[-1:] == ":"), float(after[:1] in "%$€£"),
        sum(c.isdigit() for c in before) / CONTEXT, sum(c.isdigit() for c in after) / CONTEXT, *cues, *later,
    ]


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows, labels and kind numbers of ``n`` template sentences."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    sep = lambda: r.choice("- .")

    def iban() -> str:
        country, body = r.choice(("DE", "FR", "ES", "GB", "IT")), d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = f"{country}{check:02d}{body}"
        return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def day(lo: int, hi: int) -> str:
        y, m, a, q = r.randint(lo, hi), r.randint(1, 12), r.randint(1, 28), r.choice("-/.")
        return f"{y}{q}{m:02d}{q}{a:02d}" if r.random() < 0.5 else f"{a:02d}{q}{m:02d}{q}{y}"

    def word() -> str:
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))

    true = {
        "local_phone": lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{(q := sep())}{d(3)}{q}{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}")),
        "identity": lambda: r.choice((f"{d(3)}-{d(2)}-{d(4)}", f"{r.choice('ABCXYZ')}{d(7)}", d(9), d(11))),
        "account": iban,
        "network": lambda: r.choice((":".join(f"{r.getrandbits(16):x}" for _ in range(8)), r.choice(":-").join(f"{r.getrandbits(8):02x}" for _ in range(6)))),
        "birth": lambda: day(1930, 2010),
        "spelled_email": lambda: f"{word()}.{word()} {r.choice(('(at)', '[at]'))} {word()}{''.join(f' {r.choice(DOTS)} {word()}' for _ in range(r.choice((0, 0, 0, 1))))} {r.choice(DOTS)} {r.choice(('com', 'org', 'de', 'uk'))}",
    }
    false = {
        "local_phone": lambda: r.choice((f"{d(2)}.{d(2)}.{d(3)}", f"{d(4)} {d(4)} {d(4)}", f"{d(3)}-{d(3)}-{d(3)}-{d(2)}")),
        "identity": lambda: r.choice((d(9), d(12), f"{r.choice(('RX', 'GT', 'A', 'SKU'))}{d(6)}")),
        "account": lambda: f"{r.choice(('AB', 'XK', 'DE'))}{d(2)} {d(4)} {d(4)} {d(2)}",
        "network": lambda: "-".join(f"{r.getrandbits(8):02d}"[:2] for _ in range(6)),
        "birth": lambda: day(1990, 2031),
        "spelled_email": lambda: f"{word()} (at) {word()} (dot) {word()}",
    }
    owner = {"local_phone": "phone", "identity": "identity", "account": "account", "network": "network", "birth": "birth", "spelled_email": "contact"}
    x, y, kinds = [], [], []
    while len(y) < n:
        kind, good = r.choice(ADDED), r.random() < 0.5
        cue = r.choice(CUES[owner[kind]]) if r.random() < (0.85 if good else 0.06) else r.choice(CUES["against"]) if r.random() < (0.03 if good else 0.75) else ""
        filler = [word() for _ in range(r.randint(0, 6))]
        lead = " ".join([*filler, cue, *[word() for _ in range(r.choice((0, 0, 0, 1)))]]).strip()
        body = (true if good else false)[kind]()
        text = f"{lead}{r.choice((' ', ': ', ' is ', ' no. '))}{body}{r.choice(('', '.', ',', ' '))} {' '.join(word() for _ in range(r.randint(0, 5)))}"
        at = len(lead)
        for span in candidates(text):
            if span[1] > at:
                x.append(features(text, span))
                # only the whole span under its own kind is right; other readings of it are wrong
                y.append(float(good and span[2] == kind and text[span[0] : span[1]] == body))
                kinds.append(ORDER[span[2]])
    return np.array(x), np.array(y), np.array(kinds)


@cache
def train(examples: int = EXAMPLES, seed: int = SEED) -> tuple[Boosted, dict[str, float]]:
    """The calibrated model and each kind's threshold."""
    x, y, kinds = _examples(examples, seed)
    held = np.arange(len(y)) % 3 == 0
    model = Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    p, cuts = model.probability(x[held]), {}
    for kind in ADDED:
        mine = kinds[held] == ORDER[kind]
        order = np.argsort(-p[mine])
        right = np.cumsum(y[held][mine][order]) / np.arange(1, mine.sum() + 1)
        ok = np.flatnonzero(right >= PRECISION)
        cuts[kind] = max(0.5, float(p[mine][order][ok[-1]])) if ok.size else 1.1
    return model, cuts


def select(base: list[Span], proposed: list[Span], p: np.ndarray, cuts: dict[str, float]) -> list[Span]:
    """Base spans and, greedily by probability, the candidates above their threshold that overlap nothing selected."""
    taken: list[tuple[int, int]] = []  # disjoint, sorted
    for a, b, _ in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    chosen = list(base)
    for i in sorted(range(len(proposed)), key=lambda i: (-p[i], proposed[i])):
        s = proposed[i]
        if p[i] >= cuts[s[2]]:
            k = bisect(taken, (s[0], s[1]))
            if (k == 0 or taken[k - 1][1] <= s[0]) and (k == len(taken) or s[1] <= taken[k][0]):
                taken.insert(k, (s[0], s[1]))
                chosen.append(s)
    return sorted(chosen, key=lambda s: (s[0], ORDER[s[2]]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and ``spans``: kind:start:end of all spans, in code points."""
    model, cuts = train()
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            bases, proposed, rows_x = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                bases.append(base_spans(text))
                proposed.append(candidates(text))
                rows_x += [features(text, s) for s in proposed[-1]]
            p = model.probability(np.array(rows_x)) if rows_x else np.empty(0)
            at, digests, joined, added = 0, [], [], []
            for base, more in zip(bases, proposed):
                spans = select(base, more, p[at : at + len(more)], cuts) if more else base
                at += len(more)
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest() if base else nothing)
                joined.append(_joined(spans))
                added.append(len(spans) - len(base))
            counts = [pa.array([sum(s[2] == k for s in b) for b in bases], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(added, pa.int64())],
                names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_added"],
            )

    return rows.mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets."""
    model, cuts = train()

    def clean(text: str | None) -> str | None:
        if text is None:
            return text
        more = candidates(text)
        p = model.probability(np.array([features(text, s) for s in more])) if more else np.empty(0)
        out, at = [], 0
        for a, b, kind in select(base_spans(text), more, p, cuts):
            if a >= at:
                out += [text[at:a], f"[{kind}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([clean(x.as_py()) for x in batch.column(i)], batch.schema.field(i).type)
            yield batch.set_column(i, batch.schema.field(i), new)

    i = docs.columns.index("text")
    return map_rows(docs, run)
