"""Join operators (JON) and nearest or interval matches (CIT-02, CIT-11, CIT-12) over tables of any kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_with_fallback(left: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """JON-02: ``value`` of ``first`` where it has the key, else of ``second``."""
    a, b = first.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__has")), second.select(*keys, F.col(value).alias("__b"))
    joined = left.join(a, keys, "left").join(b, keys, "left")
    return joined.withColumn(value, F.when(F.col("__has"), F.col("__a")).otherwise(F.col("__b"))).drop("__a", "__b", "__has")


def cited_and_absent(rows: DataFrame, cited: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """JON-06: rows that are cited and not yet present."""
    return rows.join(cited, keys, "left_semi").join(present, keys, "left_anti")


def outer_legs(legs: list[DataFrame], keys: list[str], score: str = "score") -> DataFrame:
    """JON-07: full outer merge of scored legs, missing scores 0: one union and one aggregation whatever their number."""
    tagged = [leg.select(*keys, *[(F.col(score) if i == j else F.lit(None).cast("double")).alias(f"s{j}") for j in range(len(legs))]) for i, leg in enumerate(legs)]
    union = reduce(DataFrame.unionByName, tagged)
    return union.groupBy(*keys).agg(*[F.coalesce(F.max(f"s{j}"), F.lit(0.0)).alias(f"s{j}") for j in range(len(legs))])


def first_payload(legs: list[DataFrame], keys: list[str], payload: str) -> DataFrame:
    """JON-08: the payload of the first leg that has the key."""
    union = reduce(DataFrame.unionByName, [leg.select(*keys, payload, F.lit(i).alias("__leg")) for i, leg in enumerate(legs)])
    return union.groupBy(*keys).agg(F.min_by(payload, "__leg").alias(payload))


def reconcile(index: DataFrame, corpus: DataFrame, id_col: str, owner: str, number: str) -> DataFrame:
    """JON-09: an id that the corpus lacks becomes the corpus id of the same owner and number if there is just one."""
    known = corpus.select(F.col(id_col).alias("__known"))
    single = corpus.groupBy(F.col(owner).alias("__o"), F.col(number).alias("__n")).agg(F.count("*").alias("__c"), F.min(id_col).alias("__only")).filter("__c = 1")
    joined = index.join(known, index[id_col] == F.col("__known"), "left").join(single, (index[owner] == F.col("__o")) & (index[number] == F.col("__n")), "left")
    return joined.select(*[index[c] for c in index.columns], F.coalesce("__known", "__only", index[id_col]).alias("resolved_id"))


def fill(left: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """JON-10: blank values filled from a lookup."""
    names = lookup.select(key, F.col(value).alias("__v"))
    return left.join(names, key, "left").withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), F.col("__v"), F.lit(""))).drop("__v")


def diff(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """JON-12: state of each key in two versions (added, removed, changed, same); rows meet by one full outer join on digests."""
    digest = lambda df, n: df.select(key, F.xxhash64(*values).alias(n))
    both = digest(old, "__o").join(digest(new, "__n"), key, "full_outer")
    state = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(F.col("__o") != F.col("__n"), "changed").otherwise("same")
    return both.select(key, state.alias("state"))


def overlapping(a: DataFrame, b: DataFrame, group: str, width: int) -> DataFrame:
    """CIT-02: pairs of intervals [bas, son) of one group that overlap, by equality on cells of ``width``.

    Both sides are spread over the cells they touch; a pair is reported in the cell where the later one starts, so once.
    """
    cells = lambda df, n: df.select(group, *[F.col(c).alias(f"{n}_{c}") for c in ("id", "bas", "son")], F.explode(F.sequence(F.floor(F.col("bas") / width), F.floor((F.col("son") - 1) / width))).alias("cell"))
    pairs = cells(a, "a").join(cells(b, "b"), [group, "cell"]).filter("a_bas < b_son AND b_bas < a_son")
    return pairs.filter(F.floor(F.greatest("a_bas", "b_bas") / width) == F.col("cell")).drop("cell")


def nearest(left: DataFrame, right: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """CIT-11: the last ``right`` row at or before each ``left`` row, else the first one after it; one union and two windows, no join."""
    tag = F.lit(None).cast(right.schema[value].dataType)
    both = left.select("*", tag.alias("__v"), F.lit(1).alias("__side")).unionByName(right.select(group, at, F.col(value).alias("__v"), F.lit(0).alias("__side")), allowMissingColumns=True)
    order = Window.partitionBy(group).orderBy(at, "__side")
    before = F.last("__v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__v", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return both.withColumn(value, F.coalesce(before, after)).filter("__side = 1").drop("__v", "__side")


def first_in_interval(starts: DataFrame, marks: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """CIT-12: the first ``marks`` row after each ``starts`` row and before the next one."""
    tag = F.lit(None).cast(marks.schema[value].dataType)
    both = starts.select("*", tag.alias("__v"), F.lit(0).alias("__side")).unionByName(marks.select(group, at, F.col(value).alias("__v"), F.lit(1).alias("__side")), allowMissingColumns=True)
    order = Window.partitionBy(group).orderBy(at, "__side")
    block = both.withColumn("__block", F.sum(F.when(F.col("__side") == 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first("__v", ignorenulls=True).over(Window.partitionBy(group, "__block").orderBy(at, "__side").rowsBetween(0, Window.unboundedFollowing))
    return block.withColumn(value, first).filter("__side = 0").drop("__v", "__side", "__block")


def overlapping_heads(df: DataFrame, key: str, group: str, head: str, same: int = 40) -> DataFrame:
    """JON-13: the (group, head) of ``df`` whose head equals that of another key, begins it, begins with it, or shares its first ``same`` characters.

    Equality joins only: distinct heads meet by their first ``same`` characters, shorter ones by the prefixes of longer ones, so a common beginning
    costs its rows once and no two rows of a group are compared.
    """
    heads = df.groupBy(group, head).agg(F.count_distinct(key).alias("n"))
    start = F.left(head, F.lit(same))
    long = heads.filter(F.length(head) >= same)
    shared = long.groupBy(group, start.alias("start")).agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    alike = long.withColumn("start", start).join(shared, [group, "start"], "left_semi").select(group, head)
    cuts = F.explode(F.sequence(F.lit(1), F.least(F.length(head) - 1, F.lit(same - 1))))
    longer = heads.filter(F.length(head) > 1).select(group, F.col(head).alias("whole"), cuts.alias("at")).select(group, "whole", F.left("whole", F.col("at")).alias(head))
    pairs = longer.join(heads.select(group, head), [group, head])
    return heads.filter("n > 1").select(group, head).union(alike).union(pairs.select(group, F.col("whole").alias(head))).union(pairs.select(group, head)).distinct()


def paired(a: DataFrame, b: DataFrame, query: str, value: str) -> DataFrame:
    """JON-15: two rankings' values side by side for each query."""
    return a.select(query, F.col(value).alias("a")).join(b.select(query, F.col(value).alias("b")), query)
