"""Quality rules by robust multivariate outliers (native).

Every document becomes a vector of four transformed text statistics: log mean word length, and the arcsine roots of the shares of
characters that are neither letter nor digit, of words of at most two characters and of upper-case letters. All four vary in prose of any
kind; counts that are zero in most documents (repeated lines, repeated words) are left to the base rule. A share over ``n`` words wavers by
the root of ``n``, so deviations from a group's medians are weighted by ``sqrt(n / (n + HALF))``: short documents are not outliers for being short.

For each language and source a minimum covariance determinant (MCD) estimate of centre and scatter is refined by concentration steps: keep
the ``H_SHARE`` of documents that are nearest by Mahalanobis distance, re-estimate from them, repeat until the determinants settle. Two starts are
refined, quartile spreads alone and the covariance of winsorised deviations; the smaller determinant wins. Distances are scaled so
that their median is that of chi-squared, and a document beyond the chi-squared quantile of one in a million is rejected.

The nearest are found without sorting a group: squared distances fall on a fixed logarithmic grid, one aggregation per step adds counts
and moments by (group, start, grid cell), and a running total over at most ``2 * GRID * CELLS`` cells finds the cell that completes the share. The
grid makes the result independent of how rows are spread over tasks, and no task ever holds more of a hot group than its cells.

A coordinate whose remaining spread is below ``TINY`` within a group (all documents alike) says nothing there and is left out of that group's distance.

Edge cases: null text counts as empty and fails the base rule; null language or source form groups of
their own; a group with fewer than ``MIN_GROUP`` passing documents is pooled with the other small groups of its language, then
of the corpus; when even those are too few, the estimate comes from all passing documents of the language, then of the
corpus, large groups included; only a corpus with fewer than ``MIN_GROUP`` of them is left to the base rule; repeated rows each get the same
verdict; ties at a grid cell stay together; an empty table gives an empty result; further columns, whatever their names, are ignored by ``quality_table``
and kept by ``quality_filter``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, let, materialize, native_words, text_or_empty

SYMBOLS = r"[#*$%&|<>]"
#: Runs of what is neither a sign nor an upper-case letter.
NO_SIGN, NO_UPPER = r"[\p{L}\p{M}\p{N} \x09-\x0D]+", r"[^\p{Lu}]+"
#: Production parameters.
H_SHARE = 0.75
#: At most so many concentration steps; they end when the log determinants fall by less than ``TOLERANCE`` on average.
STEPS, TOLERANCE = 8, 0.02
MIN_GROUP = 40
#: Words at which a deviation has the root of half its weight.
HALF = 400.0
P = 4
#: By degrees of freedom, from none to four (fixed values): the median of chi-squared, and its quantile that one clean document in a million exceeds.
MEDIANS, CUTS = (1.0, 0.4549, 1.3863, 2.366, 3.3567), (1.0, 23.928, 27.631, 30.665, 33.377)
#: Least standard deviation of a coordinate that still counts.
TINY = 1e-4
#: Width of the cells from which starting medians and quartiles are read, and the spreads at which deviations are winsorised.
WIDTH, WINSOR = 1 / 1024, 1.5
#: Grid of ln(squared distance): cells per unit, and the range it is clamped to.
CELLS, GRID = 32, 24
#: Position bits of a packed (hash, position); the rest are hash bits, and every candidate is verified.
POS_BITS = 30
POS = (1 << POS_BITS) - 1


def _repeat_words(w: Column, n: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more, exactly, in n log n.

    Windows become (hash prefix | position) longs; after one sort, equal prefixes are neighbours. Only those
    candidates are compared as strings.
    """
    high = F.lit(~POS)

    def near(a: Column, size: Column, key) -> Column:
        return lambda x, i: (
            F.when(i > 0, key(F.get(a, i - 1)) == key(x)).otherwise(F.lit(False))
            | F.when(i < size - 1, key(F.get(a, i + 1)) == key(x)).otherwise(F.lit(False))
        )

    packed = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long")),
        )
    )
    candidates = let(
        packed,
        lambda s: F.transform(
            F.filter(s, near(s, n - 2, lambda x: x.bitwiseAND(high))),
            lambda x: x.bitwiseAND(F.lit(POS)).cast("int"),
        ),
    )
    grams = lambda c: F.array_sort(
        F.transform(c, lambda p: F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("g"), p.alias("p")))
    )
    found = let(
        candidates,
        lambda c: F.when(
            F.size(c) > 0,
            let(grams(c), lambda g: F.sort_array(F.transform(F.filter(g, near(g, F.size(g), lambda x: x["g"])), lambda x: x["p"]))),
        ).otherwise(F.array().cast("array<int>")),
    )
    covered = let(
        found,
        lambda p: F.when(
            F.size(p) > 0,
            F.aggregate(
                F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, F.least(F.lit(3), F.get(p, i + 1) - x)).otherwise(3)),
                F.lit(0),
                lambda a, x: a + x,
            ),
        ).otherwise(0),
    )
    return F.when(n >= 3, covered).otherwise(0).cast("long")


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``row`` (the columns ``keep``), names ``a`` and ``b`` of language and source, and ``q``, the statistics. Inputs cannot clash: they are inside ``row``."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^ \x09-\x0D]")))
    by_words = let(
        native_words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            let(F.size(w), lambda n: _repeat_words(w, n)).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.length(x) <= 2)).cast("long").alias("n_short"),
        ),
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        _name("lang").alias("a"),
        _name("source").alias("b"),
        by_words.alias("w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.length(F.regexp_replace(text, NO_SIGN, "")).cast("long").alias("n_signs"),
        F.length(F.regexp_replace(text, NO_UPPER, "")).cast("long").alias("n_upper"),
    )
    failed = (F.col("w.n_words") < 50) | (100 * F.col("w.n_repeat_words") > 50 * F.col("w.n_words"))
    return rows.select(
        "row", "a", "b", F.struct("w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"), "w.n_short", "n_signs", "n_upper").alias("q")
    )


def _vector() -> list[Column]:
    """Log mean word length; arcsine roots of the shares of signs, short words and upper-case letters."""
    n, chars = F.greatest(F.col("q.n_words"), F.lit(1)).cast("double"), F.greatest(F.col("q.word_chars"), F.lit(1)).cast("double")
    root = lambda share: F.asin(F.sqrt(F.least(F.lit(1.0), share)))
    return [F.log(chars / n), root(F.col("q.n_signs") / chars), root(F.col("q.n_short") / n), root(F.col("q.n_upper") / chars)]


def _weight() -> Column:
    n = F.col("q.n_words").cast("double")
    return F.sqrt(n / (n + HALF))


def _name(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("\u0000"))


def _with_distance(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the squared Mahalanobis distance ``name`` of the deviations ``z``, by forward substitution through the Cholesky factor.

    Each unknown is a column that the next ones name: written as one expression they would repeat each other, and the plan would grow with two to the
    number of coordinates.
    """
    known = lambda i: "".join(f" - l{i}{j} * y{j}" for j in range(i))
    return df.selectExpr("*", *[f"(z{i} - m{i}{known(i)}) / l{i}{i} AS y{i}" for i in range(P)], " + ".join(f"y{i} * y{i}" for i in range(P)) + f" AS {name}")


def _cell(d2: str) -> Column:
    return F.expr(f"CAST(floor(greatest(-{GRID}D, least({GRID}D, ln({d2} + 1e-12D))) * {CELLS}) AS INT)")


PAIRS = [(i, j) for j in range(P) for i in range(j + 1)]
SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}_{j}" for i, j in PAIRS]]
FACTOR = [*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)]]
#: Stands for the spread of a coordinate that is left out.
OUT = 1e150


def _moments(columns: list[str]) -> list[Column]:
    names = ["count(*) AS n", *[f"sum({c}) AS s{i}" for i, c in enumerate(columns)], *[f"sum({columns[i]} * {columns[j]}) AS s{i}_{j}" for i, j in PAIRS]]
    return [F.expr(x) for x in names]


def _factors(df: DataFrame, keys: list[str], centre: bool = True) -> DataFrame:
    """Centre ``m`` and Cholesky factor ``l`` from count, sums and sums of products, each naming those before, as above; and ``det``, the log determinant."""
    steps = [f"s{i} / n AS m{i}" for i in range(P)]
    for i in range(P):
        for j in range(i + 1):
            rest = f"(s{j}_{i} / n - m{i} * m{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + ")"
            steps.append(f"IF({rest} > {TINY**2!r}D, sqrt({rest}), {OUT!r}D) AS l{i}{j}" if i == j else f"{rest} / l{j}{j} AS l{i}{j}")
    det = " + ".join(f"IF(l{i}{i} < {OUT!r}D, ln(l{i}{i}), 0D)" for i in range(P))
    return df.selectExpr(*keys, "n", *[c for c in df.columns if c.startswith("s")], *steps).selectExpr(*keys, *[c if centre or c[0] == "l" else f"0D AS {c}" for c in FACTOR], f"{det} AS det")


def _quartiles(x: DataFrame) -> DataFrame:
    """Coordinate medians ``c`` and quartile spreads ``r`` of each group, from fixed-width histograms."""
    cells = ", ".join(f"struct({i} AS i, CAST(floor(x{i} / {WIDTH!r}D) AS INT) AS c)" for i in range(P))
    counts = x.selectExpr("g", f"explode(array({cells})) AS e").groupBy("g", "e.i", "e.c").count()
    runs = counts.selectExpr("g", "i", "c", "sum(count) OVER (PARTITION BY g, i ORDER BY c) / sum(count) OVER (PARTITION BY g, i) AS r")
    marks = runs.groupBy("g", "i").agg(*[F.expr(f"min(c) FILTER (WHERE r >= {q}) AS {a}") for a, q in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75))])
    spread = f"greatest((hi - lo) * {WIDTH!r}D / 1.349D, {TINY!r}D)"
    return marks.groupBy("g").agg(*[F.expr(f"max((mid + 0.5D) * {WIDTH!r}D) FILTER (WHERE i = {i}) AS c{i}") for i in range(P)], *[F.expr(f"max({spread}) FILTER (WHERE i = {i}) AS r{i}") for i in range(P)])


def _starts(z: DataFrame, quartiles: DataFrame) -> DataFrame:
    """Two starts ``v`` of each group: 0, quartile spreads alone; 1, the covariance of deviations winsorised at ``WINSOR`` spreads."""
    plain = [f"0D AS m{i}" for i in range(P)] + [f"{f'r{i}' if i == j else '0D'} AS l{i}{j}" for i in range(P) for j in range(i + 1)]
    held = [f"(greatest(-{WINSOR}D, least({WINSOR}D, z{i} / r{i})) * r{i})" for i in range(P)]
    sums = z.groupBy("g").agg(*_moments(held)).withColumn("v", F.lit(1))
    return quartiles.selectExpr("g", "0 AS v", *plain, "0D AS det").unionByName(_factors(sums, ["g", "v"], centre=False))


def _groups(passing: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(group ``g`` of each ``a`` and ``b``, all groups that their documents count for, number of rows of the latter)."""
    counts = passing.groupBy("a", "b").agg(F.count("*").alias("n"))
    own, pooled = F.col("n") >= MIN_GROUP, F.col("of_lang") >= MIN_GROUP
    of_lang = Window.partitionBy("a")
    counts = counts.withColumn("of_lang", F.sum(F.when(own, 0).otherwise(F.col("n"))).over(of_lang)).withColumn("all_lang", F.sum("n").over(of_lang))
    counts = materialize(counts.withColumn("left", ~own & ~pooled))
    whole = F.col("all_lang") >= MIN_GROUP
    sums = counts.agg(F.count("*").alias("groups"), F.sum(F.when(F.col("left"), F.col("n"))).alias("left"), F.count_if(F.col("left") & ~whole).alias("bare")).first()
    few = 0 < (sums["left"] or 0) < MIN_GROUP
    rest, lang, corpus = F.lit("\u001f"), F.concat(F.lit("\u001f\u001f"), "a"), F.lit("\u001f\u001f\u001f")
    fallback = F.when(whole, lang).otherwise(corpus) if few else rest
    name = F.when(own, F.concat("a", F.lit("\u001f"), "b")).when(pooled, F.col("a")).otherwise(fallback)
    groups = materialize(counts.select("a", "b", name.alias("g"), (whole & F.bool_or("left").over(of_lang)).alias("shared")))
    # documents of large groups also count for the fall-backs that someone needs
    extra = [F.when(F.col("shared"), lang), *([corpus] if sums["bare"] else [])] if few else []
    members = groups.select("a", "b", F.explode(F.array_distinct(F.array_compact(F.array("g", *extra)))).alias("g"))
    return groups.drop("shared"), members, sums["groups"] * (1 + len(extra))


def estimates(stats: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(group of each language and source, MCD estimate of each group, number of group rows)."""
    passing = stats.filter(~F.col("q.base_failed"))
    groups, members, n_members = _groups(passing)
    x = (
        passing.select("a", "b", _weight().alias("weight"), *[v.alias(f"x{i}") for i, v in enumerate(_vector())])
        .join(checked_broadcast(members, n_members), ["a", "b"])
        .drop("a", "b")
    )
    quartiles = materialize(_quartiles(x))
    deviations = [f"(x{i} - c{i}) * weight AS z{i}" for i in range(P)]
    z = materialize(x.join(checked_broadcast(quartiles, n_members), "g").selectExpr("g", *deviations, *[f"r{i}" for i in range(P)]))
    columns = [f"z{i}" for i in range(P)]
    now, seen = materialize(_starts(z, quartiles)), None
    z = z.select("g", *columns)
    for _ in range(STEPS):
        cells = _with_distance(z.join(checked_broadcast(now, 2 * n_members), "g"), "d2").groupBy("g", "v", _cell("d2").alias("c")).agg(*_moments(columns))
        totals = cells.selectExpr("g", "v", "c", "sum(n) OVER (PARTITION BY g, v) AS all", *[f"sum({k}) OVER (PARTITION BY g, v ORDER BY c) AS {k}" for k in SUMS])
        first = totals.filter(f"n >= all * {H_SHARE}").groupBy("g", "v").agg(F.max("all").alias("all"), F.min_by(F.struct(*SUMS), "c").alias("s")).filter(F.col("all") >= MIN_GROUP)
        # two rows for each group; written, so that no plan holds more than one step
        now = materialize(_factors(first.select("g", "v", "s.*"), ["g", "v"]))
        before, seen = seen, now.agg(F.sum("det"), F.count("*")).first()
        if not seen[1] or before and before[0] - seen[0] < TOLERANCE * seen[1]:
            break
    best = now.groupBy("g").agg(F.min_by(F.struct(*FACTOR), F.struct("det", "v")).alias("s")).select("g", "s.*")
    cells = _with_distance(z.join(checked_broadcast(best, n_members), "g"), "d2").groupBy("g", _cell("d2").alias("c")).agg(F.count("*").alias("n"))
    halves = cells.selectExpr("g", "c", "sum(n) OVER (PARTITION BY g ORDER BY c) * 2 >= sum(n) OVER (PARTITION BY g) AS half").filter("half")
    scale = halves.groupBy("g").agg(F.min("c").alias("c"))
    freedom = " + ".join(f"IF(l{i}{i} < {OUT!r}D, 1, 0)" for i in range(P))
    pick = lambda values: f"element_at(array({', '.join(f'{v}D' for v in values)}), 1 + {freedom})"
    best = best.join(scale, "g").selectExpr("g", *FACTOR, f"exp((c + 0.5D) / {CELLS}) / {pick(MEDIANS)} AS scale", f"{pick(CUTS)} AS cut")
    return groups, materialize(best.join(quartiles.select("g", *[f"c{i}" for i in range(P)]), "g")), n_members


def judge(stats: DataFrame, groups: DataFrame, scatter: DataFrame, n_groups: int) -> DataFrame:
    """``row`` and ``q`` with ``d2`` (null without an estimate) and ``kept``."""
    known = groups.join(scatter, "g").drop("g")
    joined = stats.join(checked_broadcast(known, n_groups), ["a", "b"], "left")
    joined = joined.select("*", *[((v - F.col(f"c{i}")) * _weight()).alias(f"z{i}") for i, v in enumerate(_vector())])
    # one expression: as a conjunction, its first part would be pushed below the join
    return _with_distance(joined, "raw").selectExpr("row", "q", "raw / scale AS d2", f"IF(q.base_failed, false, coalesce(raw / scale <= cut, true)) AS kept")


def quality_table(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, kept, distance2."""
    stats = materialize(statistics(docs, ["doc_id"]))
    return judge(stats, *estimates(stats)).select(F.col("row.doc_id").alias("doc_id"), "q.*", "kept", F.round("d2", 3).alias("distance2"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; texts are written once with their statistics, and never shuffled."""
    stats = materialize(statistics(docs, docs.columns))
    return judge(stats, *estimates(stats)).filter("kept").select("row.*")
