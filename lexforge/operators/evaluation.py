"""Evaluation, statistics and corpus reports (EVA, STT, GRP), as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import fixed as X
from lexforge.functions.text import has, java


def within(rank: Column, k: int) -> Column:
    return (rank >= 1) & (rank <= k)


def rank_metrics(rank: Column) -> list[Column]:
    """EVA-01: recall at 1, 5, 10, MRR@10, nDCG@10 and N of hit ranks (0: not found); zeros without rows."""
    inside = within(rank, 10)
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return [
        *[zero(F.avg(within(rank, k).cast("double"))).alias(f"r{k}") for k in (1, 5, 10)],
        zero(F.avg(F.when(inside, 1.0 / rank).otherwise(0.0))).alias("mrr10"),
        zero(F.avg(F.when(inside, 1.0 / F.log2(rank + 1.0)).otherwise(0.0))).alias("ndcg10"),
        F.count(rank).alias("n"),
    ]


def metrics_by(ranks: DataFrame, system: str, cuts: list[str]) -> DataFrame:
    """EVA-02: metrics of each system overall and by each cut, in one pass (grouping sets)."""
    sets = [[F.col(system)], *[[F.col(system), F.col(c)] for c in cuts]]
    return ranks.groupingSets(sets, system, *cuts).agg(*rank_metrics(F.col("hit_rank")))


def recall_curve(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 20, 50, 75, 100), by: str | None = None) -> DataFrame:
    """EVA-03: recall at each k, its gain over the k before, and the share never found."""
    keys = [by] if by else []
    each = ranks.select(*keys, "hit_rank", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    curve = each.groupBy(*keys, "k").agg(
        F.avg(within(F.col("hit_rank"), F.col("k")).cast("double")).alias("recall"), F.avg((F.col("hit_rank") == 0).cast("double")).alias("never")
    )
    w = Window.partitionBy(*keys).orderBy("k") if keys else Window.partitionBy(F.lit(0)).orderBy("k")
    return curve.withColumn("gain", F.col("recall") - F.coalesce(F.lag("recall").over(w), F.lit(0.0)))


def tolerance_ranks(found: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """EVA-06 and EVA-07: rank of the first hit under each notion of a hit."""
    return found.groupBy("query_id").agg(*[F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(0)).cast("int").alias(name) for name, hit in levels.items()])


def head_sweep(scored: DataFrame, heads: tuple[int, ...] = (10, 20, 30, 50)) -> DataFrame:
    """EVA-09: one scored list re-ranked with each head size; scoring happens once."""
    each = scored.withColumn("head", F.explode(F.array(*map(F.lit, heads))))
    inside = F.col("rank") <= F.col("head")
    order = Window.partitionBy("head", "query_id").orderBy((~inside).cast("int"), F.when(inside, -F.col("rerank_score")), "rank")
    return each.withColumn("new_rank", F.row_number().over(order))


def compare_lists(old: DataFrame, new: DataFrame, k: int = 10) -> DataFrame:
    """EVA-10: how two result lists (query_id, rank, key, pair, score; ``truth`` is the corpus's pair) relate for each query.

    same: equal first k pairs and scores · collision: a pair occurs twice in the new list · equal_scores: same pairs with the same scores
    in another order · stale: a new row's pair differs from the corpus's · different: none of these.
    """
    as_list = lambda df, name: df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pair", "score"))).alias(name))
    stale = new.groupBy("query_id").agg(F.max(F.coalesce(F.col("pair") != F.col("truth"), F.lit(False))).alias("stale"))
    both = as_list(old, "o").join(as_list(new, "n"), "query_id").join(stale, "query_id")
    plain = lambda c: F.transform(c, lambda x: F.struct(x["pair"], x["score"]))
    pairs = F.transform("n", lambda x: x["pair"])
    kind = (
        F.when(plain(F.slice("o", 1, k)) == plain(F.slice("n", 1, k)), "same")
        .when(F.size(F.array_distinct(pairs)) < F.size("n"), "collision")
        .when(F.array_sort(plain(F.col("o"))) == F.array_sort(plain(F.col("n"))), "equal_scores")
        .when(F.col("stale"), "stale")
        .otherwise("different")
    )
    return both.select("query_id", kind.alias("kind"))


def latency(df: DataFrame, stage: str, ms: str) -> DataFrame:
    """EVA-12: p50, p95, p99 (linear interpolation), mean and largest of each stage."""
    p = F.percentile(ms, F.array(*map(F.lit, (0.5, 0.95, 0.99))))
    return df.groupBy(stage).agg(p.alias("p"), F.round(F.avg(ms), 6).alias("mean_ms"), F.max(ms).alias("max_ms"), F.count(ms).alias("n")).select(
        stage, *[F.round(F.get("p", i), 6).alias(f"p{q}") for i, q in enumerate((50, 95, 99))], "mean_ms", "max_ms", "n"
    )


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(empty)


def set_scores(truth: DataFrame, found: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """EVA-13: precision, recall, F1 of two key sets, and for each field how shared rows match (both null apart)."""
    a = truth.select(*keys, *[F.col(f).alias(f"t_{f}") for f in fields], F.lit(True).alias("in_t"))
    b = found.select(*keys, *[F.col(f).alias(f"f_{f}") for f in fields], F.lit(True).alias("in_f"))
    both = F.col("in_t").isNotNull() & F.col("in_f").isNotNull()
    n = lambda c, name: F.count_if(c).alias(name)
    counts = [n(both, "tp"), n(F.col("in_t").isNull(), "fp"), n(F.col("in_f").isNull(), "fn")]
    for f in fields:
        null = F.col(f"t_{f}").isNull() & F.col(f"f_{f}").isNull()
        same = F.col(f"t_{f}").eqNullSafe(F.col(f"f_{f}"))
        counts += [n(both & same & ~null, f"{f}_match"), n(both & ~same, f"{f}_mismatch"), n(both & null, f"{f}_null")]
    got = a.join(b, keys, "full_outer").agg(*counts)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return got.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(ratio(2 * p * r, p + r), 6)})


def law_scores(df: DataFrame) -> DataFrame:
    """EVA-14: corrected precision and recall of each law from arrays ``gt``, ``pred`` and ``ranges`` (bodiless articles)."""
    spurious = lambda x: x.startswith("Ek") | x.startswith("Geçici") | x.startswith("Mükerrer") | F.contains(x, F.lit("/"))
    tp, fp, fn = F.size(F.array_intersect("gt", "pred")), F.array_except("pred", "gt"), F.array_except("gt", "pred")
    real_fp, real_fn = F.size(F.filter(fp, lambda x: ~spurious(x))), F.size(F.array_except(fn, F.col("ranges")))
    return df.withColumns(
        {
            "tp": tp, "fp": F.size(fp), "fn": F.size(fn), "real_fp": real_fp, "real_fn": real_fn,
            "prec_raw": F.round(ratio(tp, tp + F.size(fp), 1.0), 4), "prec_adj": F.round(ratio(tp, tp + real_fp, 1.0), 4),
            "rec": F.round(ratio(tp, tp + F.size(fn), 1.0), 4), "rec_adj": F.round(ratio(tp, tp + real_fn, 1.0), 4),
        }
    )


def micro(df: DataFrame, segment: str) -> DataFrame:
    """EVA-15: micro-averaged scores of all laws and of each segment (rollup)."""
    sums = df.rollup(segment).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "real_fp", "real_fn")], F.count("*").alias("n"))
    s = F.col
    return sums.withColumns(
        {
            "prec_raw": F.round(ratio(s("tp"), s("tp") + s("fp"), 1.0), 6), "prec_adj": F.round(ratio(s("tp"), s("tp") + s("real_fp"), 1.0), 6),
            "rec": F.round(ratio(s("tp"), s("tp") + s("fn"), 1.0), 6), "rec_adj": F.round(ratio(s("tp"), s("tp") + s("real_fn"), 1.0), 6),
        }
    )


def body_recall(df: DataFrame, mine: Column, official: Column) -> DataFrame:
    """EVA-16: share of the official words that the body has, and its bucket."""
    share = ratio(F.size(F.array_intersect(mine, official)), F.size(official))
    return df.withColumn("share", F.round(share, 6)).withColumn("bucket", F.when(share >= 0.95, "full").when(share >= 0.8, "partial").otherwise("low"))


def check(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """EVA-17: rows pass through; one that breaks ``condition`` fails the query."""
    return df.filter(F.coalesce(F.assert_true(condition, message).isNull(), F.lit(True)))


# -- statistics (STT) ------------------------------------------------------------------------------------------------


def simplex(spark, steps: int = 20) -> DataFrame:
    """STT-01: weight triples on a grid that add up to 1, and the equal one first (w_id, w0, w1, w2)."""
    i = spark.range(steps + 1).select(F.col("id").alias("i"))
    grid = i.select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps) - F.col("i"))).alias("j"))
    rows = grid.select((F.col("i") / steps).alias("w0"), (F.col("j") / steps).alias("w1"), ((steps - F.col("i") - F.col("j")) / steps).alias("w2"), (F.col("i") * (steps + 1) + F.col("j") + 1).alias("w_id"))
    equal = spark.range(1).select(*[F.lit(1 / 3).alias(f"w{k}") for k in range(3)], F.lit(0).cast("long").alias("w_id"))
    return equal.unionByName(rows).select("w_id", *[F.round(f"w{k}", 6).alias(f"w{k}") for k in range(3)])


#: Seed of every drawn order, fold and count.
SEED = 4721


def drawn(*parts: Column | str, seed: int = SEED) -> Column:
    """A number below 2**28 from the MD5 of ``parts`` and the seed: the same in every engine, at every partitioning."""
    return F.conv(F.left(F.md5(F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts], F.lit(str(seed)))), F.lit(7)), 16, 10).cast("long")


def poisson_cuts() -> list[float]:
    """Where a uniform number passes to the next count of a Poisson(1) variable, up to eight."""
    cuts, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        cuts.append(total)
        p /= k + 1
    return cuts


def grouped_cv(ranks: DataFrame, group: str, folds: int = 5, repeats: int = 20, seed: int = SEED) -> DataFrame:
    """STT-03: choose weights on the other folds by (MRR, R@10), score on the fold; groups stay together. (repeat, fold, w_id, mrr, n)."""
    each = ranks.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))))
    each = each.withColumn("fold", F.pmod(drawn(group, "repeat", seed=seed), F.lit(folds)))
    gain = F.when(within(F.col("hit_rank"), 10), 1.0 / F.col("hit_rank")).otherwise(0.0)
    per = each.groupBy("repeat", "w_id", "fold").agg(F.sum(gain).alias("g"), F.sum(within(F.col("hit_rank"), 10).cast("int")).alias("h"), F.count("*").alias("n"))
    whole = Window.partitionBy("repeat", "w_id")
    rest = lambda c: F.sum(c).over(whole) - F.col(c)
    train = per.withColumn("key", F.struct(F.round(ratio(rest("g"), rest("n")), 6), F.round(ratio(rest("h"), rest("n")), 6), -F.col("w_id")))
    return train.groupBy("repeat", "fold").agg(*[F.max_by(c, "key").alias(c) for c in ("w_id", "g", "n")]).select("repeat", "fold", "w_id", F.round(ratio(F.col("g"), F.col("n")), 6).alias("mrr"), "n")


def plateau(scores: DataFrame, width: float = 0.005) -> DataFrame:
    """STT-04: the settings within ``width`` of the best MRR, and their place."""
    w = Window.partitionBy(F.lit(0))
    placed = scores.withColumn("place", F.row_number().over(w.orderBy(F.col("mrr10").desc(), F.col("r10").desc(), "w_id"))).withColumn("best", F.max("mrr10").over(w))
    return placed.filter(F.col("mrr10") >= F.col("best") - width).drop("best")


def paired_bootstrap(pairs: DataFrame, a: Column, b: Column, rounds: int = 5000, seed: int = SEED) -> DataFrame:
    """STT-05: 95 % interval of the mean difference; each round weighs every pair by a Poisson(1) count drawn from a hash.

    Rounds are spread as rows, so pairs are only ever summed: one partial aggregation, nothing collected.
    """
    each = pairs.select((a - b).alias("d"), F.monotonically_increasing_id().alias("i") if "query_id" not in pairs.columns else F.col("query_id").alias("i"))
    rows = each.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = drawn("i", "round", seed=seed) / float(1 << 28)
    count = sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in poisson_cuts()), F.lit(0))
    means = rows.withColumn("u", u).withColumn("c", count).groupBy("round").agg(ratio(F.sum(F.col("c") * F.col("d")), F.sum("c")).alias("m"))
    return means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p")).select(F.round(F.get("p", 0), 6).alias("low"), F.round(F.get("p", 1), 6).alias("high"))


def win_loss(pairs: DataFrame, better: Column, worse: Column) -> DataFrame:
    """STT-06: wins, losses and z of a paired comparison."""
    n = pairs.agg(F.count_if(better).alias("wins"), F.count_if(worse).alias("losses"))
    return n.withColumn("z", F.round(ratio(F.col("wins") - F.col("losses"), F.sqrt(F.col("wins") + F.col("losses"))), 6))


# -- reports (GRP) ---------------------------------------------------------------------------------------------------


def clause_is_empty(text: Column) -> Column:
    """GRP-01: no more than two characters after the mark."""
    return F.length(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^[a-zçğıöşü0-9]{1,3}[).]\s*", "")) <= 2


def letters_broken(clauses: Column) -> Column:
    """GRP-01: a letter repeats, or the next one is more than two further on."""
    marks = F.filter(F.transform(clauses, lambda c: F.regexp_extract(F.trim(c["text"]), r"^([a-zçğıöşü])\)", 1)), lambda m: m != "")
    known = F.filter(F.transform(marks, lambda m: F.instr(F.lit(X.ALPHABET), m)), lambda i: i > 0)
    jumps = F.exists(F.sequence(F.lit(2), F.size(known)), lambda i: F.element_at(known, i) - F.element_at(known, i - 1) > 2)
    return (F.size(marks) >= 2) & ((F.size(F.array_distinct(marks)) < F.size(marks)) | F.when(F.size(known) >= 2, jumps).otherwise(False))


def has_title_leak(text: Column) -> Column:
    """GRP-01: a long paragraph that ends like a heading."""
    return has(text, X.TITLE_LEAK) & (F.length(text) > 60)


def health(corpus: DataFrame) -> DataFrame:
    """GRP-01: counts of a corpus in one pass."""
    text, m = F.coalesce("text", F.lit("")), "metadata"
    clauses = F.flatten(F.transform(f"{m}.fikralar", lambda p: p["bentler"]))
    n = F.count_if
    lengths = F.percentile_approx(F.length(text), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), 100000)
    return corpus.agg(
        F.count("*").alias("rows"),
        n(F.col(f"{m}.yurutluk") == X.IN_FORCE).alias("in_force"),
        n(F.col(f"{m}.yurutluk") == X.REPEALED).alias("repealed"),
        lengths.alias("lengths"),
        n(F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) <= 1).alias("one_word"),
        n((F.col(f"{m}.yurutluk") == X.REPEALED) & (F.length(F.trim(text)) < 15)).alias("short_repealed"),
        n(F.size(f"{m}.fikralar") == 0).alias("without_paragraphs"),
        F.sum(F.size(f"{m}.fikralar")).alias("paragraphs"),
        F.sum(F.size(clauses)).alias("clauses"),
        n(F.exists(clauses, lambda c: clause_is_empty(c["text"]))).alias("with_empty_clause"),
        n(F.exists(f"{m}.fikralar", lambda p: letters_broken(p["bentler"]))).alias("with_broken_letters"),
        n(F.exists(f"{m}.fikralar", lambda p: has_title_leak(p["text"]))).alias("with_title_leak"),
    )


def corpus_diff(old: DataFrame, new: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """GRP-02: state of each id in two corpora, its status flip and clause counts; ``ignored`` metadata fields do not count as changes."""
    side = lambda df, s: df.select(
        "id",
        F.lit(True).alias(f"{s}_has"),
        F.xxhash64("text", F.to_json(F.struct(*[f"metadata.{f}" for f in df.schema["metadata"].dataType.fieldNames() if f not in ignored]))).alias(f"{s}_h"),
        F.col("metadata.yurutluk").alias(f"{s}_status"),
        F.aggregate("metadata.fikralar", F.lit(0), lambda a, p: a + F.size(p["bentler"])).alias(f"{s}_clauses"),
        F.size("metadata.fikralar").alias(f"{s}_paragraphs"),
    )
    both = side(old, "old").join(side(new, "new"), "id", "full_outer")
    state = F.when(F.col("old_has").isNull(), "added").when(F.col("new_has").isNull(), "removed").when(F.col("old_h") != F.col("new_h"), "changed").otherwise("same")
    return both.select("id", state.alias("state"), (F.col("old_status") != F.col("new_status")).alias("flip"), "old_status", "new_status", "old_clauses", "new_clauses", "old_paragraphs", "new_paragraphs")


def spread(df: DataFrame, value: str) -> DataFrame:
    """GRP-02: n, mean, median, largest."""
    return df.agg(F.count(value).alias("n"), F.round(F.coalesce(F.avg(value), F.lit(0.0)), 6).alias("mean"), F.coalesce(F.median(value), F.lit(0.0)).alias("median"), F.coalesce(F.max(value), F.lit(0)).alias("max"))


def structure_marks(text: Column) -> Column:
    """GRP-03: occurrences of each kind of heading (a map)."""
    return F.create_map(*[x for name, p in X.STRUCTURE_MARKS.items() for x in (F.lit(name), F.regexp_count(text, F.lit(java(p))))])


def dominant_mark(text: Column) -> Column:
    """GRP-03: the most frequent kind, null without any."""
    best = F.array_max(F.transform(F.map_entries(structure_marks(text)), lambda e: F.struct(e["value"].alias("n"), e["key"].alias("k"))))
    return F.when(best["n"] > 0, best["k"])


def stratified(df: DataFrame, group: str, stratum: Column, per_group: int = 6, per_stratum: int | None = None, seed: int = SEED) -> DataFrame:
    """GRP-05: at most ``per_group`` rows of a group and ``per_stratum`` of a length class, in the seeded order of the first column, which is the key."""
    order = drawn(df.columns[0], seed=seed)
    picked = df.withColumn("stratum", stratum).withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(order, df.columns[0]))).filter(F.col("__r") <= per_group)
    if per_stratum is not None:
        picked = picked.withColumn("__s", F.row_number().over(Window.partitionBy("stratum").orderBy(order, df.columns[0]))).filter(F.col("__s") <= per_stratum).drop("__s")
    return picked.drop("__r")


def funnel(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """GRP-07: rows, rows that pass each gate, and rows that pass all."""
    every = F.lit(True)
    for g in gates.values():
        every = every & F.coalesce(g, F.lit(False))
    return df.agg(F.count("*").alias("rows"), *[F.count_if(F.coalesce(g, F.lit(False))).alias(k) for k, g in gates.items()], F.count_if(every).alias("valid"))


def keyword_counts(text: Column, words: tuple[str, ...]) -> Column:
    """GRP-08: occurrences of each keyword, without zeros (a map)."""
    counts = F.create_map(*[x for w in words for x in (F.lit(w), F.regexp_count(text, F.lit(rf"\Q{w}\E")))])
    return F.map_filter(counts, lambda _, n: n > 0)
