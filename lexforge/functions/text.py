"""Text functions as native columns (no Python on the executors)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X

#: What Python calls white space: Java's Unicode class lacks the four separators U+001C to U+001F.
SPACE = r"\s\x1c-\x1f"


def java(pattern: str) -> str:
    """A Python pattern as Java reads it: Unicode classes, Turkish-safe case folding, Python's white space."""
    flags = "".join(dict.fromkeys(f for m in re.findall(r"\(\?([a-z]+)\)", pattern) for f in m))
    body = re.sub(r"\(\?[a-z]+\)", "", pattern)
    out, inside, i = [], False, 0
    while i < len(body):
        pair = body[i : i + 2]
        if pair == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
            i += 2
        elif pair[0] == "\\":
            out.append(pair)
            i += 2
        else:
            inside = pair[0] == "[" or inside and pair[0] != "]"
            out.append(r"\[" if pair[0] == "[" and body[i - 1 : i] == "[" else pair[0])
            i += 1
    return f"(?U{'u' if 'i' in flags else ''}{flags})" + "".join(out)


def has(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(java(pattern)))


def drop(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, java(pattern), by)


def strip(c: Column) -> Column:
    """Python's ``str.strip``."""
    return drop(c, r"^\s+|\s+$")


def squeeze(c: Column) -> Column:
    return strip(drop(c, r"\s+", " "))


def find(c: Column, pattern: str, group: int = 0) -> Column:
    """First match's group, or null; an empty group counts as null only if nothing matched."""
    return F.when(has(c, pattern), F.regexp_extract(c, java(pattern), group))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(java(pattern)), F.lit(group))


def start_of(c: Column, pattern: str) -> Column:
    """0-based start of the first match, -1 without one: the length of what precedes it."""
    return F.when(has(c, pattern), F.length(F.split(c, java(pattern), 2)[0])).otherwise(-1)


# -- normalisation and case (TXT-01 to TXT-06) -----------------------------------------------------------------------


def normalize_text(c: Column) -> Column:
    """TXT-01: soft hyphens go, dashes become ``-``, single newlines and blank runs become one space."""
    c = F.translate(c, X.DASHES + X.SOFT_HYPHEN, "-" * len(X.DASHES))
    c = F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " ")
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def tr_lower(c: Column) -> Column:
    """TXT-02: Turkish lower case."""
    return F.lower(F.translate(c, "İI", "iı"))


def tr_upper(c: Column) -> Column:
    """TXT-03: Turkish upper case."""
    return F.upper(F.translate(c, "iı", "İI"))


def tokenize(c: Column, lower: str = "tr", stem: int | None = X.STEM) -> Column:
    """TXT-04 and TXT-05: tokens of letters and digits; words, not numbers, are cut to ``stem`` letters."""
    words = F.regexp_extract_all(tr_lower(c) if lower == "tr" else F.lower(c), F.lit(X.TOKEN), F.lit(0))
    if stem is None:
        return words
    return F.transform(words, lambda w: F.when(F.rlike(w, F.lit("^[0-9]+$")), w).otherwise(F.left(w, F.lit(stem))))


def fold(c: Column) -> Column:
    """TXT-06: lower case without accents, one character for one character."""
    return F.lower(F.translate(c, X.FOLD_FROM, X.FOLD_TO))


# -- keys and labels (TXT-07 to TXT-13) ------------------------------------------------------------------------------


def law_number(c: Column) -> Column:
    """TXT-07: without spaces and leading zeros; a number of zeros alone stays."""
    bare = strip(c)
    return F.coalesce(F.nullif(F.ltrim(bare, F.lit("0")), F.lit("")), bare)


def article_key(c: Column) -> Column:
    """TXT-08: (kind, number) from the article number's own prefix."""
    plain = squeeze(c)
    form = r"^(?:(gecici|ek|mukerrer)\s+)?0*([0-9]+)(?:\s*/\s*(\S+))?$"
    hit = F.rlike(fold(plain), F.lit(java(form)))
    part = lambda i: F.regexp_extract(fold(plain), java(form), i)
    tail = tr_upper(F.regexp_extract(plain, r"/\s*(\S+)$", 1))
    number = F.when(part(3) != "", F.concat(part(2), F.lit("/"), tail)).otherwise(part(2))
    return F.struct(
        F.when(hit & (part(1) != ""), part(1)).otherwise("asil").alias("kind"),
        F.when(hit, number).otherwise(tr_upper(F.replace(plain, F.lit(" "), F.lit("")))).alias("number"),
    )


def article_label(kind: Column, number: Column) -> Column:
    """TXT-09: the inverse of ``article_key``."""
    word = F.coalesce(*[F.when(kind == k, F.lit(w)) for k, w in X.PREFIX_LABELS.items()])
    return F.when(kind == "asil", number).otherwise(F.concat(word, F.lit(" "), number))


def slug(c: Column) -> Column:
    """TXT-10: Turkish letters folded, letters and digits only."""
    return F.regexp_replace(F.translate(c, X.SLUG_FROM, X.SLUG_TO), r"[^\p{L}\p{N}]", "")


def build_key(c: Column) -> Column:
    """TXT-11: upper case, I for İ, no spaces or dashes."""
    return drop(F.replace(F.upper(strip(c)), F.lit("İ"), F.lit("I")), r"[\s\-]+")


def prefix_name(c: Column) -> Column:
    """TXT-12: the canonical article prefix."""
    low = F.lower(c)
    return F.when(low.startswith("ek"), "Ek").when(low.startswith("g"), "Geçici").when(low.startswith("m"), "Mükerrer").otherwise(c)


def article_kind(c: Column) -> Column:
    """TXT-13: kind from the number's prefix."""
    return F.coalesce(*[F.when(c.startswith(f"{p} "), F.lit(k)) for p, k in X.PREFIX_KINDS], F.lit("asil"))


# -- corpus text (TXT-14 to TXT-20) ----------------------------------------------------------------------------------


def strip_marks(c: Column) -> Column:
    """TXT-14: footnote marks and the space before them; other texts stay as they are."""
    return F.when(has(c, r"\[\d+\]"), strip(drop(drop(c, r"\s*\[\d+\]"), r"\s{2,}", " "))).otherwise(c)


def strip_marks_tree(tree: Column) -> Column:
    """TXT-15: the same for every text of a paragraph tree."""
    leaf = lambda x: x.withField("text", strip_marks(x["text"]))
    clause = lambda b: leaf(b).withField("alt_bentler", F.transform(b["alt_bentler"], leaf))
    return F.transform(tree, lambda p: leaf(p).withField("bentler", F.transform(p["bentler"], clause)))


def table_plain(c: Column) -> Column:
    """TXT-16: the words of a Markdown table."""
    rows = F.filter(F.split(c, r"\r?\n"), lambda r: ~F.rlike(r, F.lit(java(X.TABLE_RULE))))
    return squeeze(F.replace(F.array_join(rows, " "), F.lit("|"), F.lit(" ")))


def without_tables(body: Column, tables: Column) -> Column:
    """TXT-17: the body without its tables, in Markdown or as running words (once, white space flexible)."""

    def remove(text: Column, table: Column) -> Column:
        marked = F.replace(F.replace(text, F.concat(F.lit("\n\n"), table), F.lit("")), table, F.lit(""))
        plain = table_plain(table)
        flexible = F.concat(F.lit(r"(?s)^(.*?)\Q"), F.replace(plain, F.lit(" "), F.lit(rf"\E[{SPACE}]+\Q")), F.lit(r"\E(.*)$"))
        return F.when((F.length(plain) > X.FLAT_TABLE_LEAST) & F.contains(squeeze(marked), plain), F.regexp_replace(marked, flexible, F.lit("$1 $2"))).otherwise(marked)

    return strip(F.aggregate(F.coalesce(tables, F.array().cast("array<string>")), strip(body), remove))


def embed_text(title: Column, body: Column) -> Column:
    """TXT-18: title, newline, body; marks removed from both."""
    return F.when(F.coalesce(title, F.lit("")) != "", strip(F.concat(strip_marks(title), F.lit("\n"), strip_marks(body)))).otherwise(strip_marks(body))


def path_of(path: Column, kind: Column, number: Column) -> Column:
    """TXT-19: an inherited path ends in the article's own label."""
    word = F.coalesce(*[F.when(kind == k, F.lit(w)) for k, w in X.PREFIX_LABELS.items()])
    own = F.concat(word, F.lit(" Madde "), F.when(F.contains(number, F.lit(" ")), F.regexp_extract(number, r"^\S+\s+(.*)$", 1)).otherwise(number))
    return F.when(word.isNull(), path).otherwise(F.regexp_replace(path, F.lit(r"Madde \S+$"), own))


def redirect_target(c: Column) -> Column:
    """TXT-20: the law a redirect note names."""
    return find(c, X.REDIRECT_TARGET, 1)


# -- records and dates (TXT-21 to TXT-24) ----------------------------------------------------------------------------


def iso_date(c: Column) -> Column:
    """TXT-21: the calendar day of an ISO date or time, null for anything else."""
    day = F.regexp_extract(strip(c), r"^(\d{4}-\d{2}-\d{2})(?:T|$)", 1)
    return F.when((day != "") & (F.left(day, F.lit(4)) != "0000"), F.date_format(F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd"), "yyyy-MM-dd"))


def gazette_number(c: Column) -> Column:
    """TXT-22: trimmed text of a number, null if blank."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def law_record(date: Column, number: Column) -> Column:
    """TXT-23: the law-level gazette fields; never fails."""
    return F.struct(iso_date(date).alias("resmi_gazete_tarihi"), gazette_number(number).alias("resmi_gazete_sayisi"))


def amendment_date(day: Column, month: Column, year: Column) -> Column:
    """TXT-24: parts to an ISO date, unchecked."""
    return F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int"))


# -- amendments, markers, ratios (TXT-25 to TXT-34) ------------------------------------------------------------------


def strip_amendments(c: Column) -> Column:
    """TXT-25: the body without annotations, white space (and paragraph marks) collapsed."""
    return squeeze(drop(c, X.AMENDMENT))


def latin_marks(c: Column) -> Column:
    """TXT-26: Cyrillic look-alikes become Latin where they mark a clause."""
    for a, b in zip(X.CYRILLIC_FROM, X.CYRILLIC_TO):
        c = F.regexp_replace(c, rf"(?:(?<=[{SPACE}])|^){a}\)", f"{b})")
    return c


def clean_title(c: Column) -> Column:
    """TXT-27: trimmed, without a closing colon; null if empty."""
    return F.nullif(strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), ":+$", "")), F.lit(""))


def upper_ratio(c: Column, skip_notes: bool = True) -> Column:
    """TXT-28: share of capitals among the letters of a fixed window; null without letters."""
    window = F.left(c, F.lit(X.RATIO_WINDOW))
    window = drop(window, X.RATIO_SKIP) if skip_notes else window
    letters = F.length(F.regexp_replace(window, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(window, r"[^\p{Lu}]", "")) / letters)


def mark_of(c: Column) -> Column:
    """TXT-29: a clause mark for comparison."""
    return tr_lower(strip(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[).]+$", "")))


def paragraph_number(c: Column) -> Column:
    """TXT-30: ``( 2 )`` to 2."""
    return F.try_to_number(F.nullif(F.regexp_extract(strip(c), r"^\(\s*([0-9]{1,9})\s*\)$", 1), F.lit("")), F.lit("999999999")).cast("int")


def name_stems(c: Column) -> Column:
    """TXT-31: first five letters of a law name's telling words, as a set."""
    words = F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    telling = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*X.STOP_WORDS))
    return F.array_distinct(F.transform(telling, lambda w: F.left(w, F.lit(5))))


def head(c: Column, n: int = X.RERANK_CHARS) -> Column:
    """TXT-32: the reranker's part of a text."""
    return F.left(F.coalesce(c, F.lit("")), F.lit(n))


def is_amending(c: Column) -> Column:
    """TXT-33: an amendment package by its title."""
    return F.exists(F.array(*map(F.lit, X.AMENDING_TITLES)), lambda t: F.contains(F.upper(c), t))


def is_spurious(c: Column) -> Column:
    """TXT-34: prefixed or suffixed numbers, which the official tree leaves out."""
    return c.startswith("Ek") | c.startswith("Geçici") | c.startswith("Mükerrer") | F.contains(c, F.lit("/"))


# -- leakage, strata, word sets (TXT-35 to TXT-41) -------------------------------------------------------------------


def leaks_law_number(query: Column, number: Column) -> Column:
    """TXT-35: the law's number is written in the query."""
    bare = strip(number)
    sign = F.concat(F.lit(r"(?U)\b"), bare, F.lit(rf"\b[{SPACE}]*(sayılı|s\.|numaralı|say)"))
    return F.rlike(bare, F.lit("^[0-9]+$")) & F.rlike(tr_lower(query), sign)


def leaks_article(query: Column) -> Column:
    return F.coalesce(*[F.when(has(query, p), F.lit(True)) for p in X.ARTICLE_LEAKS], F.lit(False))


def leaks_law_name(query: Column, name: Column) -> Column:
    """Three running words of the name (or a shorter name whole) stand in the query."""
    low, said = tr_lower(name), tr_lower(query)
    words = F.filter(F.split(low, rf"[{SPACE}]+"), lambda w: F.length(w) > 2)
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.array_join(F.slice(words, i, 3), " "))
    return F.when(F.coalesce(name, F.lit("")) == "", False).when(F.size(words) < 3, F.contains(said, low)).otherwise(F.exists(windows, lambda g: F.contains(said, g)))


def stratum(n: Column) -> Column:
    """TXT-36: length class."""
    return F.when(n < 400, "kisa").when(n < 1200, "orta").otherwise("uzun")


def content_words(c: Column) -> Column:
    """TXT-37: the set of lower-case words of four letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(normalize_text(c)), F.lit("[a-zçğıöşü]{4,}"), F.lit(0)))


def first_sentence(c: Column) -> Column:
    body = normalize_text(c)
    first = F.regexp_extract(body, rf"\(1\)[{SPACE}]*(.{{15,80}})", 1)
    return strip(F.lower(F.left(F.when(first != "", first).otherwise(body), F.lit(60))))


def overlaps(a: Column, b: Column) -> Column:
    """TXT-38: equal, one a prefix of the other, or the same first 40 characters."""
    key = lambda c: F.left(squeeze(F.lower(c)), F.lit(80))
    x, y = key(a), key(b)
    same_head = (F.length(x) >= 40) & (F.length(y) >= 40) & (F.left(x, F.lit(40)) == F.left(y, F.lit(40)))
    return (x != "") & (y != "") & (F.startswith(x, y) | F.startswith(y, x) | same_head)


def citation_label(laws: Column, article: Column, paragraph: Column, clause: Column) -> Column:
    """TXT-39: a citation for people to read."""
    return F.concat(
        F.array_join(laws, "/"),
        F.lit(" s. K. m. "),
        article,
        F.when(paragraph.isNull(), "").when(paragraph == -1, " son f.").otherwise(F.concat(F.lit(" f. "), paragraph.cast("string"))),
        F.when(clause.isNull(), "").otherwise(F.concat(F.lit(" b. "), clause)),
    )


def tree_articles(c: Column) -> Column:
    """TXT-40: article lines of an indented tree."""
    return F.regexp_count(c, F.lit(java(r"(?m)^\s*-\s*Madde No:\s*\d+")))


def valid_utf8(c: Column) -> Column:
    """TXT-41: invalid bytes become replacement characters."""
    return F.make_valid_utf8(c)
