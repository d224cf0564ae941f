"""Mixing sources to target weights by Sainte-Lague apportionment (native).

Targets: sources in code-point order (null last) weigh ``weights`` in turn and share all words of the corpus;
a target stops at ``repeat`` times its source's words and the excess is shared again by weight. That is
water-filling: with the sources ordered by the level at which they fill up, one level solves for all.

Blocks and shards: within a source, documents lie end to end in seeded hash order on a line of words, cut into blocks of
equal length. Sainte-Lague seats the blocks of the mix: seats go to the highest quotients ``target / (2 s - 1)``, and a shard of the output is a run of
consecutive seats, so it has an integer quota of each source within a block of its share. For every shard's end only the seats whose quotient lies between two divisors that
bracket the answer are ranked (about three rows for each source); the seats above the upper divisor are counted in closed form.

Selection: a source's words are taken in the order of its selection line, pass after pass over its text line, whole
blocks in the order of a seeded permutation ``(a b + c) mod n``, the short block last. Its quotas cut the selection line among the shards. The
permutation is in closed form, so no block table is ever made: each document finds the places of its own blocks, and so which of its words go to which shard. A
source's words add up to its quota exactly.

Scale: positions on the line come from a two-level prefix sum, totals of hash buckets and then a running sum inside
each bucket, so a source with a third of all documents is spread over thousands of groups. ``mix_filter`` shuffles texts once, by bucket. Sources are ordered in one
task up to ``FEW`` of them (a row each), by ranges beyond; the seats of a shard meet in one task.

Edge cases: null text has size 0 and is never taken; null source is a source of its own, last in order; repeated rows
each have their own place on the line, in any order, since they are alike; the seeded hash covers doc_id, size and text, ties in it are such rows; an empty table gives
an empty result; a source without words has target 0. ``taken`` never exceeds ``repeat`` times the size. Columns besides doc_id, source and text are ignored by
``mix_table`` and kept by ``mix_filter``, whatever their names, but ``size``, ``target``, ``taken`` and ``parts``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checked_broadcast, let, materialize, text_or_empty

WEIGHTS = (1, 2, 3)
REPEAT = 3
SEED = 20_177
#: Hexadecimal digits of the hash that name a document's bucket: 4,096 buckets of each source.
BUCKET_DIGITS = 3
#: Words of a block: never fewer than this, and so many that a corpus has at most 2**30 blocks.
LEAST_BLOCK = 16
#: Blocks of a shard, at least, and shards, at most.
SHARD_BLOCKS, SHARDS = 4096, 256
#: Sources that one task may order.
FEW = 100_000
#: Primes above 2**30; one that does not divide a source's number of blocks permutes them.
PRIMES = (1073741827, 1073741831, 1073741833, 1073741839)


def _size() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def _order() -> Column:
    """The seeded hash that orders a source's documents."""
    return F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "size", F.md5(text_or_empty()), F.lit(str(SEED))))


def _named(source: Column) -> Column:
    """Sources as strings that are equal only if they are, null too."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the seeded hash ``o``."""
    return docs.select("doc_id", "source", "text", _size().alias("size")).select("doc_id", "source", "size", _order().alias("o"))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], few: int = FEW) -> DataFrame:
    """``df`` with sums over all rows before each, in ``order``: one window for few rows, beyond that windows within ranges and the ranges' totals."""
    before = Window.unboundedPreceding, -1
    if df.count() <= few:
        return df.select("*", *[F.coalesce(F.sum(v).over(Window.orderBy(*order).rowsBetween(*before)), F.lit(0)).alias(k) for k, v in sums.items()])
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = materialize(df.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    totals = df.groupBy("range").agg(*[F.sum(v).alias(f"{k}_of") for k, v in sums.items()])
    offsets = totals.select("range", *[F.coalesce(F.sum(f"{k}_of").over(Window.orderBy("range").rowsBetween(*before)), F.lit(0)).alias(f"{k}_to") for k in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(*before)
    df = df.join(checked_broadcast(offsets, ranges), "range")
    return df.select("*", *[(F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"{k}_to")).alias(k) for k, v in sums.items()]).drop("range", *[f"{k}_to" for k in sums])


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT, few: int = FEW) -> DataFrame:
    """``by_source`` (source, source_size) with ``weight`` and ``target``; one row for each source."""
    last = [F.col("source").isNull(), F.col("source")]
    table = running(by_source.select("source", "source_size"), last, {"place": F.lit(1)}, few)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))).cast("int"))
    full = F.col("source_size").cast("double") * repeat
    table = table.withColumn("weight", weight).withColumn("full", full).withColumn("fill", F.col("full") / F.col("weight"))
    table = materialize(running(table, [F.col("fill"), *last], {"weight_to": F.col("weight"), "full_to": F.col("full")}, few))
    totals = table.agg(F.sum("weight").alias("all_weight"), F.sum(F.col("source_size").cast("double")).alias("all_words"))
    table = table.join(F.broadcast(totals))
    # the level if all sources that fill up earlier are full: the right one is the first below its own fill mark
    left, open_weight = F.col("all_words") - F.col("full_to"), F.col("all_weight") - F.col("weight_to")
    first = F.min(F.when(left / open_weight <= F.col("fill"), F.struct("fill", F.col("source").isNull(), "source", left.alias("left"), open_weight.alias("open_weight"))))
    level = table.agg(first.alias("x")).select(F.col("x.left").alias("left"), F.col("x.open_weight").alias("open_weight"))
    table = table.join(F.broadcast(level))
    filled = F.coalesce(F.col("fill") < F.col("left") / F.col("open_weight"), F.lit(False))
    return table.select("source", "source_size", "weight", F.when(filled, F.col("full")).otherwise(F.col("left") * F.col("weight") / F.col("open_weight")).alias("target"))


def quotas(goal: DataFrame, repeat: int = REPEAT, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``goal`` with block length ``block``, number of blocks ``n``, quota ``q`` of each source, and ``upto``: its seats up to the end of each shard."""
    goal = materialize(goal)
    sums = goal.agg(F.sum("source_size").alias("total"), F.count("*").alias("sources"))
    block = F.greatest(F.lit(LEAST_BLOCK).cast("long"), F.ceil(F.col("total") / float(1 << 30)).cast("long"))
    sums = sums.withColumn("block", block).withColumn("seats", F.round(F.col("total") / F.col("block")).cast("long"))
    sums = sums.withColumn("shards", F.greatest(F.lit(1).cast("long"), F.least(F.lit(SHARDS).cast("long"), F.floor(F.col("seats") / shard_blocks))))
    table = goal.join(F.broadcast(sums)).withColumn("n", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    table = table.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    table = table.withColumn("end", F.when(F.col("shard") == F.col("shards") - 1, F.col("seats")).otherwise(F.floor(F.col("seats") * (F.col("shard") + 1) / F.col("shards"))))
    # seats with quotients above the upper divisor are certain; those below the lower one are out of reach
    share = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0)
    some = lambda seats: F.greatest(F.lit(0).cast("long"), F.least(F.col("n") * repeat, F.floor(share * seats + 0.5).cast("long")))
    table = table.withColumn("sure", some(F.greatest(F.col("end") - F.col("sources"), F.lit(0)))).withColumn("most", some(F.col("end") + F.col("sources") * 2))
    table = materialize(table.select("source", "source_size", "target", "block", "n", "shard", "end", "sure", "most"))
    free = table.groupBy(F.col("shard").alias("k")).agg((F.max("end") - F.sum("sure")).alias("free"))
    order = Window.partitionBy("shard").orderBy((F.col("target") / (2 * F.col("s") - 1)).desc(), F.col("source").isNull(), "source", "s")
    ranked = (
        table.filter("most > sure")
        .select("source", "target", "shard", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))).alias("s"))
        .withColumn("rank", F.row_number().over(order))
        .join(F.broadcast(free), F.col("shard") == F.col("k"))
        .filter("rank <= free")
        .groupBy(_named(F.col("source")).alias("t"), F.col("shard").alias("k"))
        .agg(F.count("*").alias("extra"))
    )
    seated = table.join(ranked, (_named(F.col("source")) == F.col("t")) & (F.col("shard") == F.col("k")), "left").withColumn("seat", F.col("sure") + F.coalesce("extra", F.lit(0)))
    one = seated.groupBy("source", "source_size", "target", "block", "n").agg(F.array_sort(F.collect_list(F.struct("shard", "seat"))).alias("x"))
    return one.select("source", "source_size", "target", "block", "n", F.transform("x", lambda v: v["seat"]).alias("upto")).withColumn("q", F.get("upto", F.size("upto") - 1))


def shard_quotas(quota: DataFrame) -> DataFrame:
    """Blocks of each source in each shard (source, shard, blocks), from the table of ``quotas``."""
    return quota.select("source", F.posexplode(F.transform("upto", lambda x, i: x - F.coalesce(F.get("upto", i - 1), F.lit(0)))).alias("shard", "blocks"))


def _parts(start: Column) -> Column:
    """(shard, start, end) for the words [``start``, ``start`` + size) of the source's line that the mix takes, relative to the document, by block and pass.

    ``words`` of the selection line are taken; a block lies on it, in each pass, at the place that the permutation gives it.
    """
    block, size = F.col("block"), F.col("source_size")
    full = F.floor(size / block).cast("long")

    def place(b: Column) -> Column:
        n = F.greatest(full, F.lit(1))
        prime = F.coalesce(*[F.when(n % p != 0, F.lit(p)) for p in PRIMES])
        return F.when(b < full, F.pmod(F.pmod(b, n) * F.pmod(prime, n) + F.pmod(F.lit(SEED), n), n)).otherwise(full)

    # the first shard whose seats end beyond a word, by halving
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(SHARDS.bit_length() - 1))])
    shard = lambda t: F.aggregate(steps, F.lit(0), lambda lo, k: lo + F.when(F.get("upto", lo + k - 1) * block <= t, k).otherwise(0))

    def piece(b: Column, turn: Column) -> Column:
        x0, x1 = F.greatest(start, b * block), F.least(start + F.col("size"), (b + 1) * block)
        at = turn * size + place(b) * block + x0 - b * block
        return F.struct((x0 - start).alias("a"), at.alias("t"), (F.least(at + x1 - x0, F.col("words")) - at).alias("n"))

    def split(x: Column) -> Column:
        """A piece is no longer than a block, so at most one shard ends inside it."""

        def halves(k: Column) -> Column:
            end = F.least(x["n"], F.get("upto", k) * block - x["t"])
            first = F.struct(k.alias("shard"), x["a"].alias("start"), (x["a"] + end).alias("end"))
            rest = F.struct(shard(x["t"] + x["n"] - 1).alias("shard"), (x["a"] + end).alias("start"), (x["a"] + x["n"]).alias("end"))
            return F.when(end < x["n"], F.array(first, rest)).otherwise(F.array(first))

        return let(shard(x["t"]), halves)

    blocks = F.sequence(F.floor(start / block).cast("long"), F.floor((start + F.col("size") - 1) / block).cast("long"))
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.col("words") - 1) / size).cast("long"))
    pieces = F.flatten(F.transform(turns, lambda turn: F.filter(F.transform(blocks, lambda b: piece(b, turn)), lambda x: x["n"] > 0)))
    return F.flatten(F.transform(pieces, split))


def mix_rows(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """``rows`` (source, size, o, and any others) with ``source_size``, ``target``, ``parts`` and ``taken``; ``summary`` holds source, size and o of the same rows."""
    bucket = F.left("o", F.lit(BUCKET_DIGITS))
    in_bucket = materialize(summary.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("words")))
    quota = materialize(quotas(targets(in_bucket.groupBy("source").agg(F.sum("words").alias("source_size")))))
    offsets = in_bucket.select(_named(F.col("source")).alias("s"), "b", (F.sum("words").over(Window.partitionBy("source").orderBy("b")) - F.col("words")).alias("from"))
    plan = quota.select(_named(F.col("source")).alias("s"), "source_size", "target", "block", "upto", F.least(F.col("q") * F.col("block"), F.col("source_size") * REPEAT).alias("words"))
    order = Window.partitionBy("s", "b").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("s", _named(F.col("source"))).withColumn("b", bucket).withColumn("upto_here", F.sum("size").over(order))
    joined = placed.join(offsets, ["s", "b"]).join(checked_broadcast(plan, quota.count(), 4 * FEW // SHARDS), "s")
    parts = F.when((F.col("size") > 0) & (F.col("words") > 0), let(F.col("from") + F.col("upto_here") - F.col("size"), _parts)).otherwise(F.array())
    return joined.withColumn("parts", parts).withColumn("taken", F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))


def mix_table(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every row of ``docs``, and ``shards``: shard:words that it takes, in order."""
    rows = materialize(sizes(docs))
    of = lambda k: F.aggregate(F.filter("parts", lambda x: x["shard"] == k), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    shards = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform("parts", lambda x: x["shard"]))), lambda k: F.concat_ws(":", k.cast("string"), of(k).cast("string"))), ",")
    return mix_rows(rows, rows).select("doc_id", "size", "source_size", "target", "taken", "source", shards.alias("shards"))


def mix_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which the mix takes any words, with ``size``, ``target``, ``taken`` and ``parts``: (shard, start, end) of the chosen word ranges."""
    keep = [c for c in docs.columns if c not in ("size", "target", "taken", "parts")]
    summary = materialize(sizes(docs).select("source", "size", "o"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "doc_id", "source", "text", _size().alias("size")).select("row", "source", "size", _order().alias("o"))
    return mix_rows(rows, summary).filter("taken > 0").select("row.*", "size", "target", "taken", "parts")
