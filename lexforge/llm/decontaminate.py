"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ten consecutive words of a benchmark item (or a whole shorter item) is a test string. For each window
length the searcher has a shift table over two-word blocks: it reads the block that would end a window and jumps as far
as no test string can end. A zero shift opens the bucket of test strings with that suffix, which is sorted, and a direct comparison of all
words confirms an occurrence. Words come from one byte table (A-Z lowered, separators blanked) and one C-level split; benchmark words are numbered, and windows
are compared by the bytes of their numbers.

Memory: the benchmark is cut into pieces of at most ``PIECE`` words (which overlap, so that no window is lost) and the pieces into slices of
about ``SLICE_WORDS`` words, whatever the benchmark holds. Building a slice takes at most about 300 bytes a word. A worker holds one slice at a time: a single slice is broadcast and used in
one pass; of several, each has a pass of its own that writes only the rows with hits, after which its broadcast is destroyed. The slices reach the
driver one after the other. Texts are shuffled only by ``decontaminate`` over several slices.

Edge cases: null text (document or item) has no words and so no windows; a null item_id counts as the empty string; repeated
items and windows count once for each item_id; repeated documents each get their own row; overlapping and touching hits merge; an empty benchmark hits nothing;
texts of any length are scanned whole, one at a time; columns besides doc_id and text are ignored by ``contamination_table`` and kept by ``decontaminate``, whatever their names.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialize, row_hash

WINDOW = 10
PIECE, SLICE_WORDS = 50_000, 500_000
#: A-Z to a-z; digits, a-z and every byte of a non-ASCII character stay; all else separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Searcher:
    """Wu-Manber tables for the test strings of one length, which begin at ``starts`` in the numbered words ``ids`` of the slice, at ``firsts`` those that begin an item.

    ``owner`` holds the number of the item of every start. Distinct windows are kept once, in order of suffix block and then of words; ``of`` tells
    where a window's items begin in ``items``. ``shift`` holds the jump of a block, or -1 - b if a test string can end there: then b is its bucket, whose
    windows begin at ``first[b]``.
    """

    def __init__(self, length: int, number: dict[bytes, int], words: list[bytes], ids: np.ndarray, starts: np.ndarray, firsts: np.ndarray, owner: np.ndarray) -> None:
        self.length, self.block, self.number = length, min(2, length), number
        windows = np.lib.stride_tricks.sliding_window_view(ids, length)
        order = np.lexsort((owner, *(ids[starts + j] for j in reversed(range(length))), *(ids[starts + length - 1 - j] for j in range(self.block))))
        starts, owner = starts[order], owner[order]
        new = np.ones(starts.size, bool)
        for at in range(1, starts.size, 1 << 16):  # a bounded part of the windows at a time
            part = slice(at, min(at + (1 << 16), starts.size))
            new[part] = (windows[starts[part]] != windows[starts[at - 1 : part.stop - 1]]).any(axis=1)
        again = np.concatenate([[False], owner[1:] == owner[:-1]]) & ~new
        self.items = owner[~again].astype(np.int32)
        self.of = np.append(np.flatnonzero(new[~again]), self.items.size).astype(np.int32)
        self.at, self.raw = starts[new].astype(np.int32), ids.tobytes()
        ends = self.at + length - self.block
        suffix = self._blocks(ids, ends)
        fresh = np.flatnonzero(np.concatenate([[True], suffix[1:] != suffix[:-1]]))
        self.first = np.append(fresh, suffix.size).astype(np.int32)
        # blocks before any window's end, from far to near, and then those at ends
        self.shift: dict[tuple[bytes, ...], int] = {}
        for j in range(length - self.block):
            near = firsts + j
            _, one = np.unique(self._blocks(ids, near), return_index=True)
            self.shift |= {self._names(words, ids, p): length - self.block - j for p in near[one].tolist()}
        self.shift |= {self._names(words, ids, p): -1 - b for b, p in enumerate(ends[fresh].tolist())}

    def _blocks(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ids[at].astype(np.int64) << 32 | ids[at + 1] if self.block == 2 else ids[at].astype(np.int64)

    def _names(self, words: list[bytes], ids: np.ndarray, at: int) -> tuple[bytes, ...]:
        return tuple(words[i] for i in ids[at : at + self.block])

    def _window(self, k: int) -> bytes:
        return self.raw[4 * self.at[k] : 4 * (self.at[k] + self.length)]

    def find(self, words: list[bytes], items: set[int]) -> Iterator[tuple[int, int]]:
        """[start, end) of every occurrence; item numbers go to ``items``."""
        length, block, shift, number = self.length, self.block, self.shift.get, self.number.get
        far = length - block + 1
        at, n = length - 1, len(words)
        while at < n:
            suffix = (words[at - 1], words[at]) if block == 2 else (words[at],)
            if (step := shift(suffix, far)) > 0:
                at += step
                continue
            begin, bucket = at - length + 1, -1 - step
            want = array("i", [number(w, -1) for w in words[begin : at + 1]])
            lo, hi = int(self.first[bucket]), int(self.first[bucket + 1])
            k = lo + bisect_left(range(lo, hi), want, key=lambda i: array("i", self._window(i)))
            if k < hi and self._window(k) == want.tobytes():
                items.update(self.items[self.of[k] : self.of[k + 1]].tolist())
                yield begin, at + 1
            at += 1


class Tables:
    """Everything built from a slice: numbers of words, names of items, and a searcher for each window length."""

    def __init__(self, rows: list[tuple[str, bytes]]) -> None:
        number: dict[bytes, int] = {}
        self.names = sorted({item for item, _ in rows})
        name = {item: i for i, item in enumerate(self.names)}
        ids, starts, firsts, owners = array("i"), {}, {}, {}
        for item, text in rows:
            words = split_words(text)
            if k := min(WINDOW, len(words)):
                at = len(ids)
                ids.extend(number.setdefault(w, len(number)) for w in words)
                firsts.setdefault(k, array("q")).append(at)
                starts.setdefault(k, array("q")).extend(range(at, at + len(words) - k + 1))
                owners.setdefault(k, array("i")).extend([name[item]] * (len(words) - k + 1))
        flat, spelled = np.array(ids, np.int32), list(number)
        self.searchers = [Searcher(k, number, spelled, flat, *(np.array(x[k], np.int64) for x in (starts, firsts, owners))) for k in sorted(starts)]

    def search(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, occurrences and item numbers."""
        words, items, hits = split_words(text), set(), []
        for s in self.searchers:
            hits += s.find(words, items)
        return len(words), hits, items


_built: tuple[str, Tables] | None = None


def _tables(key: str, shared) -> Tables:
    """The built slice; a worker process holds one."""
    global _built
    if _built is None or _built[0] != key:
        _built = None
        _built = (key, Tables(shared.value))
    return _built[1]


def _pieces(benchmark: DataFrame) -> DataFrame:
    """(item, text) pieces of at most ``PIECE`` words and the ``WINDOW - 1`` that follow, so that every window lies whole in one of them."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, _SEPARATORS), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)), F.lit(PIECE))
    rows = benchmark.filter("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")).filter(F.size("w") > 0)
    cut = rows.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.lit(PIECE + WINDOW - 1)), " "))).alias("text"))
    return cut.select("item", F.encode("text", "UTF-8").alias("text"), F.size(F.split("text", " ")).alias("n"))


def _slices(benchmark: DataFrame, limit: int) -> tuple[int, Callable[[int], list[tuple[str, bytes]]]]:
    """Number of slices of about ``limit`` words, and the rows of each."""
    pieces = materialize(_pieces(benchmark))
    n = int((pieces.agg(F.sum("n")).first()[0] or 0) // limit) + 1

    def rows(k: int) -> list[tuple[str, bytes]]:
        part = pieces if n == 1 else pieces.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        return [(r.item, bytes(r.text)) for r in part.select("item", "text").collect()]

    return n, rows


def _texts(batch: pa.RecordBatch, column: str | int = "text") -> Iterator[bytes]:
    for x in batch.column(column).cast(pa.binary()):
        yield x.as_py() or b""


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_words, spans (word ranges, merged) and items (item_ids with occurrences)."""
    rows = docs.select("doc_id", row_hash().alias("h"), "text")
    n, part = _slices(benchmark, slice_words)
    if n == 1:
        return _scanned(rows, docs.sparkSession.sparkContext.broadcast(part(0)), every=True).drop("h")
    found = _sliced(rows, n, part)
    merged = found.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k")).agg(F.flatten(F.collect_set("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = merged.select("d", "k", F.aggregate(F.array_sort("s"), F.array().cast("array<struct<a:bigint,b:bigint>>"), _joined).alias("spans"), "items")
    counted = _scanned(rows, docs.sparkSession.sparkContext.broadcast([]), every=True).select("doc_id", "h", "n_words")
    none = F.array().cast("array<string>")
    return counted.join(merged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("spans"), F.coalesce("items", none).alias("items")
    )


def _joined(done, x):
    """``done`` with the range ``x``, which begins no earlier than its last, put on or merged into it."""
    last = F.get(done, F.size(done) - 1)
    merge = (F.size(done) > 0) & (x["a"] <= last["b"])
    whole = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))
    return F.when(merge, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(whole))).otherwise(F.concat(done, F.array(x)))


def _sliced(rows: DataFrame, n: int, part: Callable) -> DataFrame:
    """doc_id, h, spans and items of the rows with hits, slice after slice; no more than one is broadcast at a time."""
    found = None
    for k in range(n):
        shared = rows.sparkSession.sparkContext.broadcast(part(k))
        hits = materialize(_scanned(rows, shared, every=False).select("doc_id", "h", "spans", "items"))
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found


def _scanned(rows: DataFrame, shared, every: bool) -> DataFrame:
    """``rows`` (doc_id, h, text) as doc_id, h, n_words, spans and items: all of them, or those with hits."""
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(key, shared)
        for batch in batches:
            keep, counts, spans, items = [], [], [], []
            for text in _texts(batch):
                n, hits, found = tables.search(text)
                keep.append(every or bool(hits))
                if keep[-1]:
                    counts.append(n)
                    spans.append([{"a": a, "b": b} for a, b in _merge(hits)])
                    items.append([tables.names[i] for i in sorted(found)])
            ids = [batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("doc_id", "h")]
            pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])
            yield pa.RecordBatch.from_arrays([*ids, pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pair)), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "h", "n_words", "spans", "items"])

    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h bigint, n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>")


def contamination_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["b"] - x["a"])
    return find_hits(docs, benchmark).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a test string, with all their columns."""
    n, part = _slices(benchmark, slice_words)
    if n == 1:
        return map_rows(docs, _clean(docs.sparkSession.sparkContext.broadcast(part(0)), docs.columns.index("text")))
    hit = _sliced(docs.select("doc_id", row_hash().alias("h"), "text"), n, part).select(F.col("doc_id").alias("d"), F.col("h").alias("k")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("i"), row_hash().alias("h"))
    return rows.join(hit, F.col("i").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left_anti").select("row.*")


def _clean(shared, place: int) -> Callable:
    key = uuid.uuid4().hex

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(key, shared)
        for batch in batches:
            keep = [not tables.search(text)[1] for text in _texts(batch, place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return clean
