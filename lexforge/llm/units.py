"""Substring dedup by hashing units of text.

Texts are cut into units: lines (paragraphs), and inside a line at sentence ends, so that a passage is found also where it
stands within a longer line. Each unit is normalised (A-Z lowered, white space collapsed) and digested to 128 bits; digests
are grouped over the whole corpus; the occurrence with the smallest (doc_id, text hash, position) stays and every other one is marked.
Consecutive marked units form a run, and runs of ``MIN_WORDS`` words or more are removed, with the code points they
had in the original text. Shorter runs stay: sentences of a few words recur in unrelated documents.

Scale: units travel as two longs, a position and offsets, never as text. Grouping is a partial aggregation, so a unit in a
third of all documents is one row for each task; the join that marks occurrences can split a hot digest.

Units are found by forward search, so a text costs its length, whatever runs of marks it holds.

Edge cases: null text has no units; wordless units are skipped; a repeat inside one document is removed like any other; rows
equal in doc_id and text are one document and mark nothing in each other; null doc_id ranks first; a text of any length
is cut whole; an empty table gives an empty result; columns besides doc_id and text are kept by
``dedup_units``, whatever their names, but ``removed``, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, row_hash

MIN_WORDS = 20
#: Where a unit ends: after sentence marks that white space follows, or before a line end. A run of marks is looked at once, from its first mark.
ENDS = re.compile(r"(?<![.!?…。])[.!?…。]++(?=[ \t\n\x0b\f\r])|\n")
BLANK = " \t\n\x0b\f\r"


def cut(text: str) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units of ``text``; the ends exclude surrounding white space."""
    at = 0
    for end in chain((m.end() for m in ENDS.finditer(text)), (len(text),)):
        unit = text[at:end]
        body = unit.strip(BLANK)
        if words := body.encode("utf-8", "surrogatepass").lower().split():
            start = at + len(unit) - len(unit.lstrip(BLANK))
            yield start, start + len(body), len(words), xxhash.xxh3_128_digest(b" ".join(words))
        at = end


def units(docs: DataFrame) -> DataFrame:
    """One row for each unit: doc_id, h (text hash), i, start, end, words and the digest (d1, d2)."""
    rows = docs.select("doc_id", row_hash().alias("h"), "text").filter("text IS NOT NULL")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h bigint, i int, start int, end int, words int, d1 bigint, d2 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owner, index, found = [], [], []
                for k, x in enumerate(part.column("text")):
                    mine = list(cut(x.as_py()))
                    found += mine
                    owner += [k] * len(mine)
                    index += range(len(mine))
                digests = np.frombuffer(b"".join(f[3] for f in found), np.int64).reshape(-1, 2)
                take = pa.array(owner, pa.int32())
                numbers = np.array([f[:3] for f in found], np.int32).reshape(-1, 3)
                columns = [part.column("doc_id").take(take), part.column("h").take(take), pa.array(index, pa.int32()), *[pa.array(np.ascontiguousarray(numbers[:, j])) for j in range(3)], *[pa.array(np.ascontiguousarray(digests[:, j])) for j in range(2)]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "i", "start", "end", "words", "d1", "d2"])

    return rows.mapInArrow(run, schema)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs to remove: doc_id, h, start, end, n_units, n_words, first_doc_id (who keeps the run's first unit)."""
    every = materialize(units(docs))
    rank = F.struct("doc_id", "h", "i")
    # a table of its own: with the aggregation inside the join's stage, a hot digest could not be split
    first = materialize(every.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").select("d1", "d2", "first"))
    later = every.join(first, ["d1", "d2"]).filter(rank > F.col("first")).select("doc_id", "h", "i", "start", "end", "words", F.col("first.doc_id").alias("first_doc_id"))
    # rows equal in doc_id and text have the same units; one of each counts
    later = later.groupBy("doc_id", "h", "i").agg(*[F.first(c).alias(c) for c in ("start", "end", "words", "first_doc_id")])
    run = F.col("i") - F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("i"))
    return (
        later.withColumn("run", run)
        .groupBy("doc_id", "h", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("words").alias("n_words"), F.min_by("first_doc_id", "i").alias("first_doc_id"))
        .filter(F.col("n_words") >= min_words)
        .select("doc_id", "h", F.col("start").cast("long"), F.col("end").cast("long"), "n_units", "n_words", "first_doc_id")
    )


def unit_table(docs: DataFrame) -> DataFrame:
    """The removed passages: doc_id, start, end (code points of the original text), n_units, n_words, first_doc_id."""
    return repeated_runs(docs).drop("h")


def without(text: Column, spans: Column) -> Column:
    """``text`` without the sorted, disjoint ``spans`` (start, end)."""
    piece = lambda s, i: F.substring(
        text, (F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0) + 1).cast("int"), (s["start"] - F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)).cast("int")
    )
    last = F.get(spans, F.size(spans) - 1)["end"]
    return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, (last + 1).cast("int"), F.length(text)))


def dedup_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later repeats cut out of ``text``, and ``removed``: the spans they had in the original text."""
    spans = repeated_runs(docs, min_words).groupBy(F.col("doc_id").alias("__d"), F.col("h").alias("__k")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "first_doc_id"))).alias("__s"))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "removed")]
    rows = docs.select(F.struct(*rest, "doc_id", "text").alias("row"), F.col("doc_id").alias("__i"), row_hash().alias("__h"))
    joined = rows.join(spans, F.col("__i").eqNullSafe(F.col("__d")) & (F.col("__h") == F.col("__k")), "left")
    text = F.col("row.text")
    new = F.when(F.col("__s").isNull(), text).otherwise(without(F.coalesce(text, F.lit("")), F.col("__s")))
    return joined.select(*[F.col("row").getField(c).alias(c) if c != "text" else new.alias("text") for c in docs.columns if c != "removed"], F.col("__s").alias("removed"))
