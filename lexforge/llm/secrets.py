"""Secret scan by a battery of randomness tests (native).

Base spans (assign, access, hex) follow fixed patterns and always stay. Beyond them every token of ``LEAST`` or more characters
of the base-64 alphabets is a candidate, whatever classes of characters it has. Its encoding is inferred (hexadecimal, letters of one case, base 32, base 36, base 62,
base 64), its characters become numbers, and four tests ask how far they are from drawn at random: chi-squared uniformity over the
alphabet, chi-squared over character classes (digits, vowels and consonants of either case), a runs test (vowels; in hexadecimal the upper half) and lag-1 serial correlation.
A token's score is the sum of the tests' -ln p: near 4 if it is random, far more if it was written.

False-discovery control: the null hypothesis is that a token is no secret. Its distribution is that of the score over tokens made of the corpus's own
words and numbers, one from each word of every whole text on, run together as identifiers, paths and plain strings of all lengths are (kinds and lengths take turns from word to word), and
counted by encoding and length: all of them are judged, none is drawn. A candidate's p-value is the share of such tokens of its encoding and length that look at least as random, so it is calibrated by
length whatever the tests' own approximations; a class with fewer than ``ENOUGH`` of them borrows all of its encoding, then of the corpus.
Benjamini-Hochberg over all candidates reports those that keep the share of false secrets at ``LEVEL``.

Scores are counted on a fixed grid; the step-up thresholds, at most one for each class, are the only thing the driver sees.

Edge cases: null text counts as empty; candidates that overlap a base span are dropped; a text of any length is scanned whole, any number of matches in it is
placed by sums over parts, in near-linear time; equal scores share a verdict; a corpus without words has no null and reports nothing beyond base spans;
repeated rows get equal answers; an empty table gives an empty result; positions are code points; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

# Fixed values of the base contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

LEAST, LEVEL = 20, 0.05
#: Words from one null token to the next (every word begins one), words that it may use, and null tokens that a class needs for a distribution of its own.
STRIDE, REACH, ENOUGH = 1, 20, 200
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}"
#: Encoding, its form, its alphabet in order of value.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    ("letters", r"^(?:[a-z]+|[A-Z]+)$", LOWER),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", DIGITS + LOWER),
    ("base62", r"^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", r"", UPPER + LOWER + DIGITS + "+/"),
)
#: Encodings whose one case is read as the lower one.
FOLDED = (0, 1, 3)
#: Character classes, and what the runs test looks at in hexadecimal and elsewhere.
CLASSES = (DIGITS, "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "aeiou", "bcdfghjklmnpqrstvwxyz")
HIGH, VOWELS = "89abcdef", "AEIOUaeiou"
#: All characters, the number of each one's class (5: none), whether it is a vowel, and characters in sequence that stand for values.
EVERY = DIGITS + UPPER + LOWER + "+/"
CLASS_OF = "".join(str(next((i for i, c in enumerate(CLASSES) if x in c), 5)) for x in EVERY)
VOWEL_OF = "".join(str(int(x in VOWELS)) for x in EVERY)
VALUES = "".join(map(chr, range(48, 112))).replace("\\", "\\\\")
#: Lengths that begin a class, and those of null tokens.
LENGTHS = (24, 32, 48, 80)
NULL_LENGTHS = (20, 24, 28, 32, 40, 48, 64, 80)
#: Cells for each unit of the score, and the last cell.
CELLS, LAST = 4, 400
#: Characters of the longest null token, the lower 32 bits, a one in each byte, and the Murmur3 of four zero bytes.
MOST, MASK, ONES, NOTHING = max(NULL_LENGTHS), "4294967295L", "72340172838076673L", "933211791L"
#: Elements that a running total copies at a time, and null tokens whose words go on together.
PART = 256


def running(df: DataFrame, lists: dict[str, str], merge: str) -> DataFrame:
    """``df`` with arrays of what ``merge`` (a sum or a maximum of ``m`` and ``v``, from 0) makes of the elements before each of ``lists``.

    It goes by parts, since an array that grows is copied at every step.
    """
    scan = lambda x, start: f"aggregate({x}, struct({start} AS m, CAST(array() AS ARRAY<BIGINT>) AS out), (a, v) -> struct({merge.replace('m', 'a.m', 1)} AS m, concat(a.out, array(a.m)) AS out), a -> a.out)"
    names, columns = list(lists), df.columns
    df = df.selectExpr("*", *[f"CAST({v} AS ARRAY<BIGINT>) AS {k}_v" for k, v in lists.items()])
    df = df.selectExpr("*", *[f"if(size({k}_v) > 0, transform(sequence(0, size({k}_v) - 1, {PART}), c -> slice({k}_v, c + 1, {PART})), CAST(array() AS ARRAY<ARRAY<BIGINT>>)) AS {k}_p" for k in names])
    df = df.selectExpr("*", *[f"transform({k}_p, x -> aggregate(x, 0L, (m, v) -> {merge})) AS {k}_t" for k in names])
    df = df.selectExpr("*", *[f"{scan(f'{k}_t', '0L')} AS {k}_b" for k in names])
    return df.selectExpr(*columns, *[f"flatten(zip_with({k}_p, {k}_b, (x, s) -> {scan('x', 's')})) AS {k}" for k in names])


def place(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``df`` (with ``text``) and, for each pattern, (start, end, s) of its leftmost non-overlapping matches: gaps and matches alternate, so running lengths place them."""
    columns = df.columns
    df = df.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"{k}_m") for k, p in patterns.items()], *[F.split("text", p, -1).alias(f"{k}_g") for k, p in patterns.items()])
    df = df.selectExpr("*", *[f"zip_with(slice({k}_g, 1, size({k}_m)), {k}_m, (g, m) -> struct(length(g) AS g, length(m) AS n, m AS m)) AS {k}_x" for k in patterns])
    df = running(df, {f"{k}_at": f"transform({k}_x, p -> p.g + p.n)" for k in patterns}, "m + v")
    return df.selectExpr(*columns, *[f"zip_with({k}_at, {k}_x, (t, p) -> struct(CAST(t + p.g AS INT) AS start, CAST(t + p.g + p.n AS INT) AS end, p.m AS s)) AS {k}" for k in patterns])


def apart(df: DataFrame) -> DataFrame:
    """``df`` with those of its ``tokens`` that overlap no span of its ``base``: sorted together, the furthest end before a token and the nearest start after it decide."""
    columns, far = df.columns, f"{1 << 40}L"
    base, tokens = "transform(base, x -> struct(x.start AS start, 0 AS t, x.end AS end, '' AS s))", "transform(tokens, x -> struct(x.start AS start, 1 AS t, x.end AS end, x.s AS s))"
    df = df.selectExpr("*", f"if(size(tokens) > 0 AND size(base) > 0, array_sort(concat({base}, {tokens})), CAST(array() AS ARRAY<STRUCT<start: INT, t: INT, end: INT, s: STRING>>)) AS both")
    # far - start falls as starts rise, so the nearest start after a token is the maximum from the right
    df = running(df, {"e": "transform(both, x -> if(x.t = 0, x.end, 0))", "f": f"reverse(transform(both, x -> if(x.t = 0, {far} - x.start, 0L)))"}, "greatest(m, v)")
    df = df.selectExpr("*", "zip_with(both, zip_with(e, reverse(f), (e, r) -> struct(e AS e, r AS r)), (x, y) -> struct(x.start AS start, x.end AS end, x.s AS s, x.t AS t, y.e AS e, y.r AS r)) AS z")
    free = f"transform(filter(z, x -> x.t = 1 AND x.e <= x.start AND {far} - x.r >= x.end), x -> struct(x.start AS start, x.end AS end, x.s AS s))"
    return df.selectExpr(*[c for c in columns if c != "tokens"], f"if(size(both) > 0, {free}, tokens) AS tokens")


def _tail(z: str, t: str) -> str:
    """Upper tail of the standard normal at z (rational approximation of erfc), with t = 1 / (1 + 0.3275911 |z| / sqrt 2)."""
    half = f"0.5D * {t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D)))) * exp(-{z} * {z} / 2)"
    return f"if({z} >= 0, {half}, 1 - ({half}))"


def _total(values: str) -> str:
    return f"aggregate({values}, 0D, (b, y) -> b + y)"


def _pairs(values: str, body: str) -> str:
    """Sum of ``body`` over neighbours ``u`` and ``v``."""
    return _total(f"zip_with({values}, slice({values}, 2, size({values})), (u, v) -> coalesce({body}, 0D))")


def _chi_z(chi2: str, df: str) -> str:
    """Chi-squared as a normal variable (cube root approximation)."""
    return f"(power(greatest({chi2}, 0D) / {df}, 1D / 3) - (1 - 2 / (9 * {df}))) / sqrt(2 / (9 * {df}))"


def _apart_steps(df: DataFrame) -> DataFrame:
    """``df`` with its next columns compiled as a method of their own: one operator without generated code in between, which moves no row.

    The JVM never compiles a method of more than 8,000 bytes, and all neighbouring projections become one method.
    """
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _unmix(u: str, steps: str) -> str:
    """Steps that undo Murmur3 (``hash``, seed 42) of four bytes: it is a permutation of 32 bits, and the only compiled function that reads several characters into a number."""
    inverse = lambda m: (pow(m, -1, 1 << 32) + (1 << 31)) % (1 << 32) - (1 << 31)  # noqa: E731  signed, so that no product leaves 64 bits
    for step in steps:
        u = {
            "a": f"(({u} ^ ({u} >>> 16)) * {inverse(0xC2B2AE35)}L & {MASK})",
            "b": f"(({u} ^ ({u} >>> 13) ^ ({u} >>> 26)) * {inverse(0x85EBCA6B)}L & {MASK})",
            "c": f"((({u} ^ ({u} >>> 16) ^ 4L) - {0xE6546B64}L) * {inverse(5)}L & {MASK})",
            "d": f"(((({u} >>> 13 | {u} << 19) & {MASK}) ^ 42L) * {inverse(0x1B873593)}L & {MASK})",
            "e": f"((({u} >>> 15 | {u} << 17) & {MASK}) * {inverse(0xCC9E2D51)}L & {MASK})",
        }[step]
    return u


def _sum(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def _any(parts) -> str:
    return "(" + " | ".join(parts) + ")"


def _counted(df: DataFrame) -> DataFrame:
    """What the tests need to know of ``s`` (a row for each token of ``MOST`` characters at most, without ``=``), counted by operations on bits, without a step over characters.

    The text becomes words of 8 bytes; transposed, these become a bitmap for each of the 7 bits of a character (``a``: characters 1 to 64, ``b``: the rest), and
    those a bitmap for each character: all counts are numbers of bits. Products of neighbours are taken byte by byte. ``_judge`` counts the same in lists of any length.
    """
    words = range(MOST // 8)
    x, y = [f"x{k}" for k in words], [f"y{k}" for k in words]
    step = lambda d, keep, **new: d.selectExpr(*keep, *[f"{v} AS {c}" for c, v in new.items()])
    df = step(df, [], n="length(s)", s="if(length(s) % 4 = 0, s, rpad(s, {0}, '\\0'))".format(MOST))
    df = step(_apart_steps(df), ["n"], **{f"s{k}": f"substring(s, {16 * k + 1}, 16)" for k in range(MOST // 16)})
    quads = {f"u{k}": f"if(n > {4 * k}, CAST(hash(substring(s{k // 4}, {4 * (k % 4) + 1}, 4)) AS BIGINT) & {MASK}, {NOTHING})" for k in range(MOST // 4)}
    df = _apart_steps(step(df, ["n"], **quads))
    for steps in "abcde":
        df = step(df, ["n"], **{u: _unmix(u, steps) for u in quads})
        df = _apart_steps(df) if steps in "bd" else df
    df = step(df, ["n"], **{f"x{k}": f"u{2 * k} | u{2 * k + 1} << 32" for k in words})
    # - becomes + and _ becomes /
    df = step(df, ["n"], **{c: f"{c} ^ (({c} >>> 2 & ~({c} >>> 1) & ~({c} >>> 4) & ~({c} >>> 6) & {ONES}) * 6) ^ (({c} >>> 6 & ~({c} >>> 5) & {c} >>> 4 & {c} >>> 3 & {c} >>> 2 & {ONES}) * 112)" for c in x})
    df = _apart_steps(df)
    # 8 by 8 bits change places
    for i, (by, mask) in enumerate(((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0))):
        df = step(df, ["n", *x], **{f"y{k}": f"{c} ^ (({c} ^ ({c} >>> {by})) & {mask}L) ^ ((({c} ^ ({c} >>> {by})) & {mask}L) << {by})" for k, c in zip(words, y if i else x)})
    df = _apart_steps(df)
    plane = lambda bit, ks: _any(f"(({y[k]} >>> {8 * bit} & 255L) << {8 * (k % 8)})" for k in ks)
    df = step(df, ["n", *x], **{f"{w}{bit}": plane(bit, ks) for w, ks in (("a", words[:8]), ("b", words[8:])) for bit in range(7)})
    # characters by their upper four bits (h) and their lower three (l)
    bits = lambda w, number, over: "(" + " & ".join(("" if number >> (bit - min(over)) & 1 else "~") + f"{w}{bit}" for bit in over) + ")"
    high, low = range(5, 16), range(8)
    groups = {f"h{w}{i}": bits(w, i, range(3, 7)) for w in "ab" for i in high} | {f"l{w}{i}": bits(w, i, range(3)) for w in "ab" for i in low}
    df = _apart_steps(step(df, ["n", *x], **groups))
    of = lambda w, c: f"(h{w}{ord(c) >> 3} & l{w}{ord(c) & 7})"
    many = lambda form: _sum(f"CAST(bit_count({form(w)}) AS DOUBLE)" for w in "ab")
    whole = lambda *hs: lambda w: _any(f"h{w}{i}" for i in hs)
    some = lambda chars: lambda w: _any(of(w, c) for c in chars)
    number = lambda c: many(lambda w: of(w, c))
    half = len(EVERY) // 2
    df = step(df, ["n", *x, *groups], q=_sum(f"{number(c)} * {number(c)}" for c in EVERY[:half]))
    df = _apart_steps(df)
    df = step(df, ["n", *x, *groups], q="q + " + _sum(f"{number(c)} * {number(c)}" for c in EVERY[half:]))
    df = _apart_steps(df)
    df = step(
        df, ["n", "q", *x], va=some(VOWELS)("a"), vb=some(VOWELS)("b"), ga=whole(7, 8, 12)("a"), gb=whole(7, 8, 12)("b"), va_=some("aeiou")("a"), vb_=some("aeiou")("b"),
        nd=many(whole(6, 7)), nu=many(whole(8, 9, 10, 11)), nl=many(whole(12, 13, 14, 15)), other=many(whole(5)),
        beyond_u=f"{many(whole(9, 10, 11))} + {number('G')}", beyond_l=f"{many(whole(13, 14, 15))} + {number('g')}", few=_sum(number(c) for c in "0189"),
    )
    df = step(
        df, ["n", "q", "nd", "nu", "nl", *x, "va", "vb", "ga", "gb"], vl=many(lambda w: f"v{w}_"), vowels=many(lambda w: f"v{w}"),
        e="CASE WHEN other > 0 THEN 5 WHEN nl + beyond_u = 0 OR nu + beyond_l = 0 THEN 0 WHEN nd = 0 AND (nu = 0 OR nl = 0) THEN 1 WHEN nl = 0 AND few = 0 THEN 2 WHEN nu = 0 OR nl = 0 THEN 3 ELSE 4 END",
    )
    df = _apart_steps(df)
    folded = f"e IN ({', '.join(map(str, FOLDED))})"
    pick = lambda values: "CASE e " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"
    # what turns the lower bits of a digit (0 on), a capital and a small letter (1 on) into 48 and the value
    shift = lambda c, first: pick([f"{48 + a.find(c) - first}L" if c in a else "0L" for *_, a in ENCODINGS])
    digit = pick([f"{48 + a.find('2') - 2}L" if "2" in a else "0L" for *_, a in ENCODINGS])
    df = step(
        df, ["n", "e", "q", *x, "nd"], ma="if(e = 0, ga, va)", mb="if(e = 0, gb, vb)", oa="if(n > 63, -1L, ~(-1L << n))", ob="if(n > 64, ~(-1L << (n - 64)), 0L)",
        vu=f"if({folded}, 0, vowels - vl)", cu=f"if({folded}, 0, nu - vowels + vl)", vl=f"if({folded}, vowels, vl)", cl=f"if({folded}, nu + nl - vowels, nl - vl)",
        od=digit, ou=f"if({folded}, {shift('a', 1)}, {shift('A', 1)})", ol=shift("a", 1),
    )
    runs = lambda a, b: f"CAST(bit_count({a} & ~(({a} >>> 1) | ({b} << 63))) AS DOUBLE) + CAST(bit_count({b} & ~({b} >>> 1)) AS DOUBLE)"
    value = lambda c: f"({c} & ((({c} >>> 5 & {c} >>> 4 & ~({c} >>> 6) & {ONES}) * 15) | (({c} >>> 6 & {ONES}) * 31))) + ({c} >>> 5 & {c} >>> 4 & ~({c} >>> 6) & {ONES}) * od + ({c} >>> 6 & ~({c} >>> 5) & {ONES}) * ou + ({c} >>> 6 & {c} >>> 5 & {ONES}) * ol + ({c} >>> 5 & ~({c} >>> 4) & ~({c} >>> 6) & {ONES}) * 110 + ({c} >>> 5 & ~({c} >>> 4) & ~({c} >>> 6) & {c} >>> 2 & {ONES})"
    classes = ["nd", "vu", "cu", "vl", "cl"]
    df = _apart_steps(df)
    df = step(df, ["n", "e", "q", *classes, *x, "od", "ou", "ol"], high=many(lambda w: f"m{w}"), changes=f"{runs('ma', 'mb')} + {runs('(oa & ~ma)', '(ob & ~mb)')} - 1")
    kept = ["n", "e", "q", *classes, "high", "changes"]
    for now in (x[:5], x[5:]):
        df = step(df, [*kept, *[c for c in x if c not in now], *(["od", "ou", "ol"] if now == x[:5] else [])], **{c: value(c) for c in now})
        df = _apart_steps(df)
    lane = lambda i: f"CAST({x[i // 8]} >>> {8 * (i % 8)} & 255L AS DOUBLE)"
    df = step(df, [*kept, *x], square=_sum(f"{lane(i)} * {lane(i)}" for i in range(MOST)))
    df = _apart_steps(df)
    last = "(CASE CAST((n - 1) / 8 AS INT) " + " ".join(f"WHEN {k} THEN {c}" for k, c in zip(words, x)) + " END >>> (8 * ((n - 1) % 8)) & 255L)"
    df = step(df, [*kept, "square", *x], next=_sum(f"{lane(i)} * {lane(i + 1)}" for i in range(MOST - 1)))
    df = _apart_steps(df)
    pairs = _sum(f"({c} & 71777214294589695L) + ({c} >>> 8 & 71777214294589695L)" for c in x)
    df = step(df, [*kept, "square", "next"], ends=f"{lane(0)} + {last}", t=pairs)
    sizes = [len(a) for *_, a in ENCODINGS]
    shares = [[sum(z in c for z in a) / len(a) for c in CLASSES] for *_, a in ENCODINGS]
    number = lambda c: f"CAST({c} AS DOUBLE)"
    df = step(
        df, ["e", *classes], n=number("n"), high="high", changes="changes", squares="q", square="square", next="next", ends="ends",
        total=number("(t & 65535L) + (t >>> 16 & 65535L) + (t >>> 32 & 65535L) + (t >>> 48)"), k=pick([f"{k}D" for k in sizes]), df=pick([f"{sum(f > 0 for f in z) - 1}D" for z in shares]),
        **{f"f{i}": pick([f"{z[i]!r}D" for z in shares]) for i in range(len(CLASSES))},
    )
    spread = " + ".join(f"if(f{i} > 0, power({c} - f{i} * n, 2D) / (f{i} * n), 0D)" for i, c in enumerate(classes))
    return _apart_steps(step(df, "e n k df high changes squares total square next ends".split(), spread=spread))


def _judge(df: DataFrame, column: str | None = None) -> DataFrame:
    """``column``, tokens (start, end, s), as (start, end, class, cell): class numbers encoding and length, cell is the score, the sum of -ln p over the four tests, on the grid.

    Without ``column`` every row is a null token ``s`` and becomes (class, cell): what the tests need is counted by ``_counted``, and the tests are the same steps over columns.

    A step of the tests is a step over the array of tokens. Written as one expression, what several tests share would be computed for each of them; bound by
    lambdas inside lambdas, the plan would take seconds to resolve.
    """

    def step(keep: str, **new: str) -> None:
        nonlocal df
        if column is None:
            df = df.selectExpr(*keep.split(), *[f"{re.sub(r'\bx[.]', '', v)} AS {c}" for c, v in new.items()])
            return
        fields = [f"x.{c} AS {c}" for c in ("start", "end", *keep.split())] + [f"{v} AS {c}" for c, v in new.items()]
        df = df.withColumn(column, F.expr(f"transform({column}, x -> struct({', '.join(fields)}))"))

    if column is None:
        df = _counted(df)
    else:
        pick = lambda values: f"element_at(array({', '.join(values)}), x.e + 1)"
        forms = " ".join(f"WHEN rlike(x.s, '{form}') THEN {i}" for i, (_, form, _) in enumerate(ENCODINGS[:-1]))
        step("", s="rtrim('=', x.s)")
        step("s", e=f"CASE {forms} ELSE {len(ENCODINGS) - 1} END", n="CAST(length(x.s) AS DOUBLE)")
        sizes = [len(a) for *_, a in ENCODINGS]
        shares = [[sum(y in c for y in a) / len(a) for c in CLASSES] for *_, a in ENCODINGS]
        step("e n", s=f"CASE WHEN x.e IN ({', '.join(map(str, FOLDED))}) THEN lower(x.s) WHEN x.e = {len(ENCODINGS) - 1} THEN replace(replace(x.s, '-', '+'), '_', '/') ELSE x.s END")
        line = " ".join(f"WHEN {i} THEN translate(x.s, '{a}', left('{VALUES}', {len(a)}))" for i, (*_, a) in enumerate(ENCODINGS))
        high = "".join(str(int(c in HIGH)) for c in ENCODINGS[0][2])
        step(
            "e n",
            k=pick([f"{k}D" for k in sizes]),
            shares=pick([f"array({', '.join(f'{f!r}D' for f in x)})" for x in shares]),
            df=pick([f"{sum(f > 0 for f in x) - 1}D" for x in shares]),
            of=f"translate(x.s, '{EVERY}', '{CLASS_OF}')",
            marked=f"if(x.e = 0, translate(x.s, '{ENCODINGS[0][2]}', '{high}'), translate(x.s, '{EVERY}', '{VOWEL_OF}'))",
            line=f"CASE x.e {line} END",
        )
        without = lambda of, c: f"length(replace({of}, {c}, ''))"
        part = lambda i: f"if(x.shares[{i}] > 0, power(x.n - {without('x.of', repr(str(i)))} - x.shares[{i}] * x.n, 2D) / (x.shares[{i}] * x.n), 0D)"
        step(
            "e n k df line",
            spread=" + ".join(map(part, range(len(CLASSES)))),
            high=f"x.n - {without('x.marked', repr('1'))}",
            changes=f"(2 * x.n - {without('x.marked', repr('01'))} - {without('x.marked', repr('10'))}) / 2",
            chars="split(x.line, '')",
        )
        step(
            "e n k df spread high changes",
            values="transform(x.chars, c -> CAST(ascii(c) AS DOUBLE))",
            runs=r"transform(regexp_extract_all(array_join(sort_array(x.chars), ''), '(.)\\1*', 0), c -> CAST(length(c) AS DOUBLE))",
        )
        step(
            "e n k df spread high changes",
            squares="aggregate(x.runs, 0D, (b, y) -> b + y * y)",
            total=_total("x.values"),
            square="aggregate(x.values, 0D, (b, y) -> b + y * y)",
            next=_pairs("x.values", "u * v"),
            ends="x.values[0] + x.values[size(x.values) - 1]",
        )
    step(
        "e n k df spread high changes squares",
        product="x.next - x.total / x.n * (2 * x.total - x.ends) + (x.n - 1) * power(x.total / x.n, 2D)",
        power="(x.n * x.square - x.total * x.total) / x.n",
        both="2 * x.high * (x.n - x.high)",
    )
    # normal variable and sides of each test; p is set where a test says nothing (0.5) or all (0)
    tests = [
        (_chi_z("x.spread", "greatest(x.df, 1D)"), 1, "if(x.df < 1, 0.5D, NULL)"),
        (_chi_z("(x.k / x.n * x.squares - x.n)", "(x.k - 1)"), 1, "NULL"),
        ("abs(x.product / greatest(x.power, 1e-9D) * sqrt(x.n) + 1 / sqrt(x.n))", 2, "if(x.power <= 0, 0D, NULL)"),
        ("abs((x.changes - x.both / x.n) / sqrt(greatest(x.both * (x.both - x.n) / (x.n * x.n * (x.n - 1)), 1e-9D)))", 2, "if(x.both <= x.n, 0.5D, NULL)"),
    ]
    zs, ps = (" ".join(f"{c}{i}" for i in range(len(tests))) for c in "zp")
    step("e n", **{f"z{i}": f"CAST({z} AS DOUBLE)" for i, (z, _, _) in enumerate(tests)}, **{f"p{i}": f"CAST({p} AS DOUBLE)" for i, (*_, p) in enumerate(tests)})
    step(f"e n {zs} {ps}", **{f"t{i}": f"1 / (1 + 0.3275911D * abs(x.z{i}) / sqrt(2D))" for i in range(len(tests))})
    step("e n", score=" + ".join(f"-ln(greatest(coalesce(x.p{i}, {sides}D * ({_tail(f'x.z{i}', f'x.t{i}')})), 1e-12D))" for i, (_, sides, _) in enumerate(tests)))
    length = " + ".join(f"CAST(x.n >= {least} AS INT)" for least in LENGTHS)
    step("", **{"class": f"x.e * {len(LENGTHS) + 1} + {length}", "cell": f"CAST(least({LAST}, greatest(0, floor(x.score * {CELLS}))) AS INT)"})
    return df


def _null_tokens(docs: DataFrame) -> DataFrame:
    """``s``, a row for each null token: made of every text's own words and numbers, one from each of them on, in the ways that identifiers, paths and plain strings are made."""
    word = f"[A-Za-z]{{2,{LEAST - 1}}}|[0-9]{{1,{LEAST - 1}}}"
    rows = docs.select(F.regexp_extract_all(text_or_empty(), F.lit(word), F.lit(0)).alias("w"))
    # words go on in parts, with those that the last tokens of a part reach, dealt out to all tasks: the battery costs far more than moving them, and a long text is not one task's work
    starts = f"if(size(w) > 0, sequence(0, size(w) - 1, {PART * STRIDE}), CAST(array() AS ARRAY<INT>))"
    rows = rows.select(F.size("w").alias("all"), F.explode(F.expr(f"transform({starts}, p -> struct(p AS p, array_join(slice(w, p + 1, {(PART - 1) * STRIDE + REACH}), ' ') AS c))")).alias("c"))
    rows = rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).selectExpr("all", "c.p AS first", "split(c.c, ' ') AS w")
    # a slice of an array is compiled code outside lambdas only, where it does not copy the whole array
    rows = _apart_steps(rows).selectExpr("all", "first", "w", f"explode(sequence(0, least({(PART - 1) * STRIDE}, all - 1 - first), {STRIDE})) AS at")
    # the kinds take turns, and begin at another one in every text
    rows = rows.selectExpr("all", "first + at AS p", f"CAST((first + at) / {STRIDE} AS INT) + all AS j", f"slice(w, at + 1, {REACH}) AS x")
    styles = [
        ("''", "lower(left(x, n))"),
        ("' '", "left(replace(initcap(left(x, 2 * n)), ' ', ''), n)"),
        ("'_'", "lower(left(x, n))"),
        ("'/'", "left(x, n)"),
        ("''", "upper(left(x, n))"),
        ("CAST(p AS STRING)", "lower(left(concat(x, p), n))"),
        ("' '", "replace(initcap(left(x, n)), ' ', '-')"),
        ("' '", "left(translate(sha2(x, 512), 'abcdef', ''), n)"),  # an arbitrary number
    ]
    turn = lambda i: " ".join(f"WHEN {k} THEN {v[i]}" for k, v in enumerate(styles))
    length = f"element_at(array({', '.join(map(str, NULL_LENGTHS))}), CAST((floor(j / {len(styles)}) + all) % {len(NULL_LENGTHS)} AS INT) + 1)"
    rows = rows.selectExpr("p", f"j % {len(styles)} AS kind", f"{length} AS n", f"array_join(x, CASE j % {len(styles)} {turn(0)} END) AS x")
    rows = _apart_steps(rows).selectExpr(f"CASE kind {turn(1)} END AS s")
    # a filter would be moved below the choice of kinds, and make every token twice
    return rows.selectExpr(f"explode(if(length(s) >= {LEAST}, array(s), CAST(array() AS ARRAY<STRING>))) AS s")


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, base spans (start, kind number, end) and candidates (start, end, class, cell) of every row."""
    rows = place(docs.select("doc_id", text_or_empty().alias("text")), {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "tokens": CANDIDATE})
    kind = lambda i: F.transform(KINDS[i], lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end")))
    rows = rows.withColumn("assign", F.filter("assign", lambda m: F.length(F.regexp_extract(m["s"], ASSIGN, 1)) >= 8))
    rows = apart(rows.select("doc_id", F.array_sort(F.concat(kind(0), kind(1), kind(2))).alias("base"), "tokens"))
    return _judge(rows.select("doc_id", "base", F.col("tokens").alias("cands")), "cands")


def _cells(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("class", "cell").agg(F.count("*").alias("n"))


def _cuts(docs: DataFrame, found: DataFrame) -> dict[int, int]:
    """Last reported cell of each class by the step-up rule over all candidates: the largest p with ``p <= LEVEL * rank / all``."""
    lengths = len(LENGTHS) + 1
    null = materialize(_cells(_judge(_null_tokens(docs))))
    have = materialize(_cells(found.select(F.inline("cands"))))
    # a row for each cell of candidates, at most classes times cells: against the null of its class, its encoding, or the corpus
    of = have.withColumnRenamed("n", "mine")
    near = of.alias("h").join(F.broadcast(null.alias("z").select(F.col("class").alias("zc"), F.col("cell").alias("zz"), "n")), F.lit(True), "left")
    same = [F.col("zc") == F.col("class"), F.floor(F.col("zc") / lengths) == F.floor(F.col("class") / lengths), F.lit(True)]
    sums = [F.sum(F.when(c, F.col("n"))).alias(f"all{i}") for i, c in enumerate(same)] + [F.sum(F.when(c & (F.col("zz") <= F.col("cell")), F.col("n"))).alias(f"low{i}") for i, c in enumerate(same)]
    share = lambda i: (F.coalesce(F.col(f"low{i}"), F.lit(0)) + 1) / (F.col(f"all{i}") + 1)
    p = F.coalesce(*[F.when(F.col(f"all{i}") >= (ENOUGH if i < 2 else 1), share(i)) for i in range(3)], F.lit(1.0))
    table = near.groupBy("class", "cell", "mine").agg(*sums).withColumn("p", p)
    rank = F.sum("mine").over(Window.partitionBy(F.lit(0)).orderBy("p"))
    ok = table.withColumn("rank", rank).withColumn("every", F.sum("mine").over(Window.partitionBy(F.lit(0)))).withColumn("most", F.max(F.when(F.col("p") <= LEVEL * F.col("rank") / F.col("every"), F.col("p"))).over(Window.partitionBy(F.lit(0))))
    got = ok.filter("p <= most").groupBy("class").agg(F.max("cell").alias("cut")).limit(len(ENCODINGS) * lengths).collect()
    return {r["class"]: r["cut"] for r in got}


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and ``spans``: kind:start:end of all spans."""
    found = materialize(_found(docs))
    cuts = _cuts(docs, found)
    names = F.array(*map(F.lit, KINDS))
    reported = lambda c: F.coalesce(*[F.when(c["class"] == k, c["cell"] <= cut) for k, cut in sorted(cuts.items())], F.lit(False))
    added = F.transform(F.filter("cands", reported), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[n(i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.array_sort(F.concat("base", added))).alias("spans"),
        F.size(added).cast("long").alias("n_random"),
    )
