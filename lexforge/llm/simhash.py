"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: words of the text with A-Z lowered, 3-word shingles with repeats, XXH64 (seed 42) of each; a bit is 1 if it
is set in over half of the hashes. Two fingerprints link at 3 or fewer differing bits.

Search: cut into two segments of 32 bits, three differing bits leave one segment with at most one. Each distinct
fingerprint is indexed under 64 signatures, one segment with one bit deleted; fingerprints that link share at least
one, an equality join brings them together and a comparison of all 64 bits decides. Inside a signature's bucket the
join does not emit pairs: a search starts from one fingerprint, takes away all it links to, and goes on from those, so
the bucket's links come out as one star for each connected part. That loses no connection and gives at most one row for
each member. Copies meet before the search: only distinct fingerprints enter it.

Hot buckets: a signature's bucket is made of the fingerprints with either value of the deleted bit, so counting the exact segments (two rows for each
fingerprint) tells which signatures are hot. In those the other segment is cut into ``CUTS`` parts; three differing bits leave one part equal, so the bucket
is split by part and value without losing a link. Distinct fingerprints of such a split differ in few free bits, and no other bucket holds more than ``HOT``.

Ties (equal ranks) are rows equal in id and text, of which one stays.

Edge cases: null or wordless text has fingerprint zero, linked like any other; texts of one or two words are
one shingle; texts of any length are hashed whole, in bounded chunks; null doc_ids join components but never name one unless
all of it are null; repeated rows get the same answer; an empty table gives an empty result; columns besides doc_id and text are ignored by ``simhash_table``
and kept by ``simhash_dedup``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, row_hash
from .components import connected

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Shingles hashed before their bits are added up.
CHUNK = 1 << 15
#: Buckets up to this size are compared pair by pair, many buckets at once.
SMALL = 8
#: Fingerprints that share a segment, beyond which its buckets are split, and the parts of the other segment.
HOT, CUTS = 20_000, 4


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # bytes: A-Z only, and the six separators only
    if not words:
        return 0
    k = min(SHINGLE, len(words))
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = len(words) - k + 1
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        upto = min(n, at + CHUNK)
        hashes = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts[at:upto], starts[at + k : upto + k])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text hash and fingerprint (as a signed long) of every row."""
    rows = docs.select("doc_id", row_hash().alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x.as_py() or b"") for x in batch.column("text").cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(prints.view(np.int64))], names=["doc_id", "h", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h bigint, fp bigint")


def signatures(nodes: DataFrame) -> DataFrame:
    """64 rows (key, fp) for each fingerprint: number of the deleted bit, and the rest of its segment; no two meanings share a key."""
    return nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select(_key(F.col("fp"), F.col("bit")).alias("key"), "fp")


def _key(fp: Column, bit: Column) -> Column:
    segment = F.when(bit < 32, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))
    rest = segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(32)))))
    return F.call_function("shiftleft", bit.cast("long"), F.lit(32)).bitwiseOR(rest)


def buckets(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of ``signatures`` with ``part``: null, or in hot buckets one row for each part of the other segment, numbered and with its value."""
    halves = nodes.select(F.explode(F.array(F.struct(F.lit(0).alias("half"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("s")), F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("fp", 32).alias("s")))).alias("x"))
    full = materialize(halves.groupBy("x.half", "x.s").agg(F.count("*").alias("n")).filter(F.col("n") > hot // 2))
    rows, n = signatures(nodes), full.count()
    if not n:
        return rows.withColumn("part", F.lit(None).cast("int"))
    bits = full.select("half", "s", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("b"))
    whole = F.when(F.col("half") == 0, F.col("s")).otherwise(F.call_function("shiftleft", F.col("s"), F.lit(32)))
    keys = bits.select(_key(whole, F.col("half") * 32 + F.col("b")).alias("hot")).distinct()
    other = F.when(F.shiftrightunsigned("key", 32) < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    width = 32 // CUTS
    cuts = F.array(*[F.lit(i << width) + F.shiftrightunsigned(other, i * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for i in range(CUTS)])
    marked = rows.join(checked_broadcast(keys, 32 * n), F.col("key") == F.col("hot"), "left")
    return marked.select("key", "fp", F.explode_outer(F.when(F.col("hot").isNotNull(), cuts)).alias("part"))


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def _stars(prints: np.ndarray) -> list[np.ndarray]:
    """Edges (first, member) of each connected part of one bucket: the search takes away all that it reaches."""
    out, rest = [], prints
    while rest.size > 1:
        first, rest = rest[0], rest[1:]
        front, members = np.array([first], np.uint64), []
        while front.size and rest.size:
            step = max(1, (1 << 20) // rest.size)
            now, front = front[:step], front[step:]
            hit = _near(rest[None, :], now[:, None]).any(axis=0)
            front = np.concatenate([front, rest[hit]])
            members.append(rest[hit])
            rest = rest[~hit]
        found = np.concatenate(members) if members else np.empty(0, np.uint64)
        if found.size:
            out.append(np.stack([np.full(found.size, first, np.uint64), found]))
    return out


def _bucket_edges(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Edges (2, n) inside runs of equal keys; ``keys`` are sorted."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(start, keys.size))
    edges = []
    for s in range(2, SMALL + 1):
        if (at := start[size == s]).size:
            for i in range(s):
                for j in range(i + 1, s):
                    a, b = prints[at + i], prints[at + j]
                    ok = _near(a, b)
                    edges.append(np.stack([a[ok], b[ok]]))
    for at, s in zip(start[size > SMALL], size[size > SMALL]):
        edges += _stars(prints[at : at + s])
    return np.unique(np.concatenate(edges, axis=1), axis=1) if edges else np.empty((2, 0), np.uint64)


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints of ``nodes`` (fp) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # the bucket that may go on in the next batch

        def edges() -> pa.RecordBatch:
            found = _bucket_edges(np.concatenate([k for k, _ in held]), np.concatenate([p for _, p in held])).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket begins here
            if cut or (held and held[-1][0][-1] != keys[0]):
                held.append((keys[:cut], prints[:cut]))
                held = [x for x in held if x[0].size]
                if held:
                    yield edges()
                held = []
            held.append((keys[cut:], prints[cut:]))
        if held:
            yield edges()

    rows = buckets(nodes, hot)
    # the part goes into the key's free upper bits: 6 bits number the deleted bit, 10 the part
    key = F.when(F.col("part").isNull(), F.col("key")).otherwise(F.col("key").bitwiseOR(F.call_function("shiftleft", (F.col("part") + 1).cast("long"), F.lit(38))))
    return rows.select(key.alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a bigint, b bigint")


def components(prints: DataFrame) -> DataFrame:
    """For each distinct fp of ``prints`` (doc_id, fp): label, equal within a component, and component_id, the smallest doc_id that links reach."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected(links(nodes.select("fp")))
    named = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    return named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "label", "component_id")


def simhash_table(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    prints = materialize(fingerprints(docs))
    return prints.join(components(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id (null last), then text hash; equal rows leave one."""
    prints = materialize(fingerprints(docs))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"))
    kept = prints.join(components(prints), "fp").groupBy("label").agg(F.min(rank).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("__d"), F.col("k.h").alias("__k"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"), row_hash().alias("h"))
    rows = rows.join(kept, F.col("i").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__k")), "left_semi")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("i", "h").orderBy(F.lit(0)))).filter("n = 1").select("row.*")
