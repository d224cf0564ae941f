"""Line dedup by winnowing over line hashes (native).

A document is its sequence of line hashes (white space collapsed, blank lines left out). A window begins at every line and is the shortest run from there that
has ``WORDS`` words or ``LINES`` lines: one long line is a window of its own, short lines count by threes. Every window selects the least hash in it, the rightmost
if there are several; the selected positions are the document's fingerprints. What a window is and selects hangs on its own lines alone, so two documents that share
a window's lines are guaranteed to share its fingerprint.

Join: only selected positions are written, each with the digests of the windows that selected it, and only positions whose hash is selected again
go on. Extension: around a joined position each of its windows, to the left and to the right, is compared by the digest of all its lines; a window that
occurred earlier (by doc_id, text hash and position) is a repeat, and overlapping or touching repeats merge into one run. Later runs are
deleted with the line numbers they had. The result is exactly: all lines inside any window that occurs earlier, so that no repeated passage of ``WORDS`` words
in whole lines is left, nor one of ``LINES`` lines.

Scale: the text is read once; lines travel as longs. Counting and the search for the first occurrence are partial aggregations and the
joins can split hot keys, so a line or passage in a third of all documents is not gathered anywhere, and no pairs are made.

Edge cases: null text has no lines; documents without a window are left alone; a repeat inside one document is deleted like any
other; rows equal in doc_id and text are one document and delete nothing in each other; null doc_id ranks first, texts of one id rank by hash; an empty table gives
an empty result; columns besides the text (and n_chars, if there is one) are kept by ``dedup_lines``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let, materialize, row_hash, text_or_empty

LINES, WORDS = 3, 20


def _lines(text: Column) -> Column:
    """(hash, line number, words) of the lines with a word."""
    tidy = F.transform(F.split(F.regexp_replace(text, r"[ \x09\x0B-\x0D]+", " "), "\n"), lambda x, i: F.struct(F.trim(x).alias("s"), i.alias("l")))
    return F.transform(F.filter(tidy, lambda x: x["s"] != ""), lambda x: F.struct(F.xxhash64(x["s"]).alias("h"), x["l"].alias("l"), F.regexp_count(x["s"], F.lit(WORD)).alias("n")))


def _windows(v: Column) -> Column:
    """Windows in order: first line's index, last line's index ``e``, their line numbers, selected position and hash, digest."""

    def window(i: Column) -> Column:
        n = lambda j: F.get(v, i + j)["n"]
        k = F.lit(LINES)
        for size in reversed(range(1, LINES)):
            k = F.when(sum((n(j) for j in range(1, size)), n(0)) >= WORDS, size).otherwise(k)
        return let(k, lambda k: F.when(i + k <= F.size(v), _window(v, i, k)))

    return F.when(F.size(v) > 0, F.array_compact(F.transform(F.sequence(F.lit(0), F.size(v) - 1), window))).otherwise(F.array())


def _window(v: Column, i: Column, k: Column) -> Column:
    inside = [F.when(k > j, F.get(v, i + j)["h"]) for j in range(LINES)]
    least = F.least(*inside)  # skips the nulls of shorter windows
    at = F.coalesce(*[F.when(inside[j] == least, i + j) for j in reversed(range(LINES))])
    return F.struct(i.alias("i"), (i + k - 1).alias("e"), F.get(v, i)["l"].alias("l0"), F.get(v, i + k - 1)["l"].alias("l1"), at.alias("p"), least.alias("a"), F.xxhash64(k, *inside).alias("d"))


def positions(docs: DataFrame) -> DataFrame:
    """One row for each selected position: doc_id, h (text hash), p, its line's hash a, and the windows that selected it (i, e, l0, l1, d)."""
    rows = docs.select("doc_id", row_hash().alias("h"), let(_lines(text_or_empty()), _windows).alias("w"))
    # the windows of a position follow each other: it is selected first where the position changes
    first = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda j: (j == 0) | (F.get("w", j)["p"] != F.get("w", F.greatest(j - 1, F.lit(0)))["p"]))
    rows = rows.filter(F.size("w") > 0).withColumn("f", first)
    mine = lambda j, n: F.slice("w", j + 1, F.coalesce(F.get("f", n + 1), F.size("w")) - j)
    cut = F.transform("f", lambda j, n: F.struct(F.get("w", j)["p"].alias("p"), F.get("w", j)["a"].alias("a"), F.transform(mine(j, n), lambda x: F.struct(*[x[c].alias(c) for c in ("i", "e", "l0", "l1", "d")])).alias("w")))
    return rows.select("doc_id", "h", F.explode(cut).alias("x")).select("doc_id", "h", "x.*")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Runs to delete: doc_id, h, start_line, end_line (both included, of the original text), first_doc_id, first_line."""
    every = materialize(positions(docs))
    rank = F.struct("doc_id", "h", "i")
    shared = materialize(every.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"))
    near = materialize(every.join(shared, "a", "left_semi").select("doc_id", "h", "a", F.explode("w").alias("w")).select("doc_id", "h", "a", "w.*"))
    # tables of their own: with an aggregation inside a join's stage, a hot fingerprint could not be split
    first = materialize(near.groupBy("a", "d").agg(F.min(rank).alias("first"), F.min_by("l0", rank).alias("first_line"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = (
        near.join(first, ["a", "d"])
        .filter(rank > F.col("first"))
        .groupBy("doc_id", "h", "i")
        .agg(*[F.first(c).alias(c) for c in ("e", "l0", "l1")], F.first("first.doc_id").alias("first_doc_id"), F.first("first_line").alias("first_line"))
    )
    order = Window.partitionBy("doc_id", "h").orderBy("i")
    fresh = F.coalesce((F.col("i") - F.lag("e").over(order) > 1).cast("int"), F.lit(1))
    return (
        later.withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(order))
        .groupBy("doc_id", "h", "run")
        .agg(F.min("l0").cast("long").alias("start_line"), F.max("l1").cast("long").alias("end_line"), F.min_by("first_doc_id", "i").alias("first_doc_id"), F.min_by("first_line", "i").cast("long").alias("first_line"))
        .drop("run")
    )


def line_table(docs: DataFrame) -> DataFrame:
    """The deleted runs: doc_id, start_line, end_line, n_lines, and where its first window occurred first."""
    return repeated_runs(docs).select("doc_id", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"), "first_doc_id", "first_line")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without later repeated runs of lines; rows of which no word is left are dropped.

    ``n_chars``, if there is such a column, becomes the length of a shortened text.
    """
    runs = (
        repeated_runs(docs)
        .groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k"))
        .agg(F.flatten(F.collect_list(F.sequence(F.col("start_line").cast("int"), F.col("end_line").cast("int")))).alias("x"))
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"), row_hash().alias("h"))
    joined = rows.join(runs, F.col("i").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left")
    rest = let(F.split("row.text", "\n"), lambda v: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(v) - 1), F.col("x")), lambda i: F.get(v, i)), "\n"))
    cut = joined.withColumn("t", F.when(F.col("x").isNotNull(), rest)).filter(F.col("t").isNull() | F.rlike("t", F.lit(r"[^ \x09-\x0D]")))
    new = {"text": F.coalesce("t", "row.text"), "n_chars": F.when(F.col("t").isNotNull(), F.length("t")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else None).cast("long")}
    return cut.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
