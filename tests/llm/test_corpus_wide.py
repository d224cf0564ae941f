"""Corpus-wide operators and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from lexforge.llm import components, decontaminate, mixing, oracle, simhash, units, winnow
from lexforge.sources.shared import shared_root

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD = re.compile(r"[^ \t-\r]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def print_of(text: str | None) -> int:
    w = SPACE_WORD.findall((text or "").translate(LOW))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints: list[int]) -> dict[int, int]:
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {p: find(p) for p in distinct}


def test_simhash_over_hard_rows(hard, hard_rows, empty):
    prints = [print_of(r[1]) for r in hard_rows]
    comp = components_of(prints)
    least = defaultdict(list)
    for r, p in zip(hard_rows, prints):
        least[comp[p]].append(r[0])
    name = {c: min((i for i in ids if i is not None), default=None) for c, ids in least.items()}
    want = Counter((r[0], f"{p:016x}", name[comp[p]]) for r, p in zip(hard_rows, prints))
    assert Counter(tuple(r) for r in simhash.simhash_table(hard).collect()) == want
    kept = simhash.simhash_dedup(hard)
    assert kept.columns == hard.columns and kept.count() == len(least)
    assert simhash.simhash_table(empty).count() == 0 and simhash.simhash_dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [simhash.HOT, 8])
def test_links_lose_no_connection_in_dense_buckets(spark, hot):
    r = np.random.default_rng(3)
    prints = set(map(int, r.integers(0, 2**63, 150, np.uint64)))
    centre = int(r.integers(0, 2**63))
    for _ in range(600):  # a cloud of near copies shares most signatures
        p = centre
        for b in r.integers(0, 64, r.integers(1, 7)):
            p ^= 1 << int(b)
        prints.add(p)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    nodes = spark.createDataFrame(signed, "fp bigint")
    labels = {x.node: x.label for x in components.connected(simhash.links(nodes, hot)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    comp = components_of(sorted(prints))
    for (s,) in signed:
        p = s + (1 << 64) if s < 0 else s
        got[labels.get(s, s)].add(p)
        want[comp[p]].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_signatures_meet_exactly_when_a_segment_differs_by_a_bit(spark):
    a = 0x0123456789ABCDEF
    for flips, meets in (((), True), ((0,), True), ((40,), True), ((0, 40), True), ((0, 40, 41), True), ((0, 1, 40, 41), False)):
        b = a
        for f in flips:
            b ^= 1 << f
        keys = simhash.signatures(spark.createDataFrame([(a,), (b,)] if a != b else [(a,)], "fp bigint")).groupBy("key").count()
        assert (keys.filter("count > 1").count() > 0 or a == b) == meets


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(5, 1), (1, 5), (2, 2), (9, 7), (7, 5)]])
def test_components(spark, edges):
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent if find(x) != x}


ITEMS = [(1, "The quick brown Fox jumps over the lazy dog near the river bank today"), (2, "short item here"), (3, None), (4, "the lazy dog near the river bank today while birds sing songs"), (2, "other Text"), (None, "null id item"), (5, "")]


def contamination_of(text: str | None) -> tuple:
    words = lambda t: BENCH_WORD.findall((t or "").translate(LOW))
    w, hit, items = words(text), set(), set()
    for item, t in ITEMS:
        v = words(t)
        k = min(10, len(v))
        for i in range(len(v) - k + 1) if k else ():
            for j in range(len(w) - k + 1):
                if w[j : j + k] == v[i : i + k]:
                    hit |= set(range(j, j + k))
                    items.add("" if item is None else str(item))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("slice_words, piece", [(decontaminate.SLICE_WORDS, decontaminate.PIECE), (14, 3)])
def test_contamination(spark, hard_rows, slice_words, piece, monkeypatch):
    extra = [(500, "x THE quick; brown fox jumps over-the lazy dog near the river bank today while birds y"), (501, "a short item\nhere, short item here"), (502, "other text other text"), (503, "NULL ID ITEM"), (504, "lazy dog near the river bank today while birds sing")]
    rows = [(r[0], r[1], 7) for r in hard_rows] + [(i, t, 7) for i, t in extra]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, n_words long"), spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(decontaminate.find_hits, "__defaults__", (slice_words,))
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    got = decontaminate.contamination_table(docs, bench).collect()
    assert Counter(tuple(r) for r in got) == Counter((d, *contamination_of(t)) for d, t, _ in rows)
    clean = decontaminate.decontaminate(docs, bench, slice_words)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((d, t) for d, t, _ in rows if not contamination_of(t)[-1])
    assert decontaminate.contamination_table(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination_table(docs.limit(0), bench).count() == 0


def levels(sizes: dict, weights=(1, 2, 3)) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        left, open_w = total - sum(3 * sizes[s] for s in full), sum(w[s] for s in w if s not in full)
        new = {s for s in w if s not in full and open_w and left * w[s] / open_w > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in full else left * w[s] / open_w for s in w}
        full |= new


def test_mixing_over_hard_rows(hard, hard_rows, empty):
    size = lambda t: len(SPACE_WORD.findall(t or ""))
    got = mixing.mix_table(hard).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in hard_rows)
    sums = Counter()
    for r in hard_rows:
        sums[r[3]] += size(r[1])
    goal = levels(dict(sums))
    taken = Counter()
    for r in got:
        assert r.source_size == sums[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sums:
        assert abs(taken[s] - goal[s]) <= mixing.LEAST_BLOCK
    again = mixing.mix_table(hard.repartition(7)).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in got)
    kept = mixing.mix_filter(hard)
    assert sum(r.taken for r in kept.collect()) == sum(r.taken for r in got) and kept.count() == sum(r.taken > 0 for r in got)
    assert mixing.mix_table(empty).count() == 0 and mixing.mix_filter(empty).count() == 0


def seats_of(goal: dict, sizes: dict, seats: int, block: int) -> dict:
    """Sainte-Lague by giving one seat at a time to the highest quotient."""
    caps, got = {s: 3 * -(-n // block) for s, n in sizes.items()}, dict.fromkeys(goal, 0)
    for _ in range(seats):
        able = [s for s in goal if got[s] < caps[s]]
        got[min(able, key=lambda s: (-goal[s] / (2 * got[s] + 1), s is None, s or ""))] += 1
    return got


def test_mixing_takes_the_words_that_its_shards_ask_for(spark, hard, hard_rows, monkeypatch):
    """Word by word: lines, blocks, passes, permutation and shards laid out in plain lists."""
    monkeypatch.setattr(mixing.quotas, "__defaults__", (mixing.REPEAT, 20))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    size = {r: len(SPACE_WORD.findall(r[1] or "")) for r in hard_rows}
    lines = defaultdict(list)
    for r in hard_rows:
        o = md5(":".join([*([str(r[0])] if r[0] is not None else []), str(size[r]), md5(r[1] or ""), str(mixing.SEED)]))
        lines[r[3]].append((o, r[0], size[r]))
    sums = {s: sum(n for *_, n in rows) for s, rows in lines.items()}
    goal, block, total = levels(sums), mixing.LEAST_BLOCK, sum(sums.values())
    seats = round(total / block)
    shards = seats // 20
    ends = [seats if k == shards - 1 else seats * (k + 1) // shards for k in range(shards)]
    upto = [seats_of(goal, sums, e, block) for e in ends]
    assert shards > 5
    want = Counter()
    for s, rows in lines.items():
        line = [(d, n, w) for _, d, n in sorted(rows, key=lambda x: x[0]) for w in range(n)]
        full = len(line) // block
        if not line:
            continue
        prime = next(q for q in mixing.PRIMES if max(full, 1) % q)
        by_place = sorted(range(full), key=lambda b: (b * (prime % full) + mixing.SEED % full) % full)
        once = [x for b in by_place for x in line[b * block : (b + 1) * block]] + line[full * block :]
        for t, x in enumerate((once * 3)[: upto[-1][s] * block]):
            want[(*x, next(k for k in range(shards) if t < upto[k][s] * block))] += 1
    got = Counter()
    rows = mixing.mix_filter(hard).collect()
    for r in rows:
        for p in r.parts:
            got.update((r.doc_id, r.size, w, p.shard) for w in range(p.start, p.end))
    assert got == want and sum(r.taken for r in rows) == sum(want.values())


@pytest.mark.parametrize("sizes", [[1000, 10, 10, 10], [5, 5, 5], [0, 100], [1, 2, 3, 4, 5, 6, 7, 8], [10**6, 1, 1]])
def test_sainte_lague_quotas(spark, sizes):
    rows = [(f"s{i:02d}" if i else None, n) for i, n in enumerate(sizes)]
    by_source = spark.createDataFrame(rows, "source string, source_size long")
    table = mixing.targets(by_source)
    goal = levels(dict(rows))
    quota = mixing.quotas(table, shard_blocks=5)
    got = {r.source: r for r in quota.collect()}
    for s, n in rows:
        assert abs(got[s].target - goal[s]) < 1e-6 * max(1.0, goal[s])
    seats = round(sum(sizes) / mixing.LEAST_BLOCK + 1e-9)
    shards = max(1, min(mixing.SHARDS, seats // 5))
    ends = [seats if k == shards - 1 else seats * (k + 1) // shards for k in range(shards)]
    for k, end in list(enumerate(ends))[:: max(1, shards // 8)] + [(shards - 1, seats)] if sum(sizes) < 10**6 else []:
        assert {s: got[s].upto[k] for s in goal} == seats_of(goal, dict(rows), end, mixing.LEAST_BLOCK)
    blocks = mixing.shard_quotas(quota).groupBy("source").sum("blocks").collect()
    assert {r.source: r["sum(blocks)"] for r in blocks} == {s: got[s].q for s in goal}
    # many sources are ordered by ranges, with the same targets
    wide = {r.source: r.target for r in mixing.targets(by_source, few=0).collect()}
    assert wide == pytest.approx({s: r.target for s, r in got.items()})


def ranked(rows) -> list[tuple]:
    """Distinct (doc_id, text) in rank order: null ids first; one id's texts by their hash."""
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    return sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0, signed(d[1])))


def plain_units(text: str):
    """(start, end, words, lowered words) of the units, sought character by character."""
    at = 0
    for i in range(len(text) + 1):
        over = i == len(text) or text[i] == "\n" or (text[i] in " \t\x0b\f\r" and i > 0 and text[i - 1] in ".!?…。")
        if over:
            words = SPACE_WORD.findall(text[at:i])
            if words:
                start = at + re.search(r"[^ \t-\r]", text[at:i]).start()
                yield start, at + len(text[at:i].rstrip(" \t\n\x0b\f\r")), len(words), " ".join(words).translate(LOW)
            at = i


def test_units_are_linear_in_runs_of_marks():
    for text in ("." * 200_000, ". " * 100_000, ".!" * 100_000 + "x", "a." * 100_000, "\n" * 200_000, " " * 200_000 + "."):
        assert [u[:3] for u in units.cut(text)] == [u[:3] for u in plain_units(text)]


def unit_runs(rows) -> set:
    """Runs that repeat, over distinct (doc_id, text) in rank order."""
    docs = ranked(rows)
    seen, out = set(), set()
    for d, t in docs:
        run = []
        for u in [*plain_units(t), None]:
            if u and u[3] in seen:
                run.append(u)
                continue
            if run and sum(x[2] for x in run) >= units.MIN_WORDS:
                out.add((d, run[0][0], run[-1][1], len(run), sum(x[2] for x in run)))
            run = []
            if u:
                seen.add(u[3])
    return out


def test_unit_dedup(spark, hard_rows, empty):
    rows = [(r[0], r[1], r[2], "k") for r in hard_rows] + [(12, hard_rows[12][1] + "\nwith a tail", "en", "k")]  # one id with three texts
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string, __h string").repartition(3)
    got = {(r.doc_id, r.start, r.end, r.n_units, r.n_words) for r in units.unit_table(docs).collect()}
    assert got == unit_runs(rows) and got
    spans = defaultdict(list)
    for d, a, b, *_ in got:
        spans[d].append((a, b))
    for r in units.dedup_units(docs).filter("doc_id IS NULL OR doc_id <> 12").collect():
        original = next(t for i, t, *_ in rows if i == r.doc_id and (t is None) == (r.text is None))
        want, at = "", 0
        for a, b in sorted(spans[r.doc_id]) if original else ():
            want, at = want + original[at:a], b
        assert r.text == (None if original is None else want + original[at:])
    assert units.unit_table(empty).count() == 0 and units.dedup_units(empty).count() == 0


def line_runs(rows) -> dict:
    """Lines inside windows that occurred earlier, by trying every window."""
    seen, out = set(), {}
    for d, t in ranked(rows):
        lines = [(re.sub(r"[ \t\x0b-\r]+", " ", x).strip(" "), i) for i, x in enumerate(t.split("\n"))]
        lines = [(x, i) for x, i in lines if x]
        gone = set()
        for k in range(len(lines)):
            size = next((n for n in (1, 2) if k + n <= len(lines) and sum(len(x.split(" ")) for x, _ in lines[k : k + n]) >= winnow.WORDS), 3)
            if k + size <= len(lines):
                g = tuple(x for x, _ in lines[k : k + size])
                gone |= set(range(k, k + size)) if g in seen else set()
                seen.add(g)
        runs = []
        for k in sorted(gone):
            if runs and k == runs[-1][1] + 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        out[d, t] = [(lines[a][1], lines[b][1]) for a, b in runs]
    return out


def test_line_dedup(spark, hard_rows, empty):
    block = "\n".join(f"common line {i}" for i in range(5))
    long = "a passage of one line with more than fifty words " + " ".join(f"word{i}" for i in range(50))
    rows = [(r[0], r[1], r[4]) for r in hard_rows] + [(905, f"top\n{long}\nmid", 1), (906, f"{long}\nx", 1), (907, long, 1), (12, hard_rows[12][1] + "\nwith a tail", 1), (900, f"a\n{block}\nb", 1), (901, f"c\n\n{block}\n\nd", 1), (902, block, 1), (903, "\n".join(["x"] * 9), 1), (904, "p\ncommon line 1\ncommon line 2\nq", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    got, want = defaultdict(list), defaultdict(list)
    for r in winnow.line_table(docs).collect():
        got[r.doc_id].append((r.start_line, r.end_line))
    for (d, _), v in line_runs(rows).items():
        want[d] += v
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items() if v}
    assert 905 not in got and got[906] == [(0, 0)] and got[907] == [(0, 0)]
    assert got[901] and got[903] and 904 not in got
    kept = {(r.doc_id): r for r in winnow.dedup_lines(docs).collect()}
    assert 902 not in kept and 907 not in kept and kept[906].text == "x" and kept[901].text == "c\n\n\nd" and kept[901].n_chars == 5 and kept[900].text == f"a\n{block}\nb"
    assert winnow.line_table(empty).count() == 0 and winnow.dedup_lines(empty).columns == empty.columns


def test_winnowing_selects_from_every_window(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"line {i * 7919 % 101}" for i in range(60))), (2, ""), (3, "one\ntwo")], "doc_id long, text string")
    rows = winnow.positions(docs).orderBy("p").collect()
    assert sum(len(r.w) for r in rows) == 58 and len(rows) < 45 and len({r.p for r in rows}) == len(rows) and all(w.i <= r.p <= w.e for r in rows for w in r.w)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, sf_dir)
        assert out.columns[: len(columns)] == columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert 0 < len(ids) <= seen.count() and ids <= {r.doc_id for r in seen.select("doc_id").collect()}
        seen = spark.createDataFrame(out.collect(), out.schema)
    assert Counter(map(str, seen.collect())) == Counter(map(str, corpus_pipeline.run(spark, sf_dir).collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_the_pipeline_leaves_only_its_result_in_the_shared_folder(spark, sf_dir):
    root = Path(shared_root(spark).removeprefix("file://"))
    tables = lambda: {p for p in root.rglob("*") if (p / "_SUCCESS").exists()}
    before = tables()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [p.name for p in tables() - before] == ["4_mixing"]


def test_pipeline_equals_brute_force(spark, sf_dir):
    """Quality and mixing by DuckDB, the stages between in plain Python."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {i for i, ok in con.execute(f"SELECT doc_id, kept FROM ({oracle.quality_sql()})").fetchall() if ok}
    rows = [r for r in con.execute(f"SELECT {', '.join(columns)} FROM documents ORDER BY doc_id").fetchall() if r[0] in kept]
    runs, lines = line_runs(rows), []
    for d, t, *rest in rows:
        gone = {k for a, b in runs[d, t] for k in range(a, b + 1)}
        text = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or SPACE_WORD.search(text):
            lines.append((d, text, *rest[:2], len(text) if gone else rest[2]))
    prints = {r[0]: print_of(r[1]) for r in lines}
    comp, first = components_of(list(prints.values())), {}
    for d in sorted(prints):
        first.setdefault(comp[prints[d]], d)
    single = [r for r in lines if r[0] in set(first.values())]
    words = lambda t: BENCH_WORD.findall((t or "").translate(LOW))
    tests = {tuple(w[i : i + 10]) for (t,) in con.execute(f"SELECT text FROM '{sf_dir}/benchmark.parquet'").fetchall() for w in [words(t)] for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(t) for t in tests}
    clean = [r for r in single if not any(tuple(w[i : i + k]) in tests for w in [words(r[1])] for k in sizes for i in range(len(w) - k + 1))]
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", clean)
    want = con.execute(f"SELECT d.*, m.size, round(m.target, 6), m.taken FROM ({oracle.MIX}) m JOIN documents d USING (doc_id) WHERE taken > 0").fetchall()
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == [*columns, "size", "target", "taken", "parts"]
    rows = got.collect()
    assert Counter((*r[:6], round(r[6], 6), r[7]) for r in map(tuple, rows)) == Counter(map(tuple, want))
    assert all(r.taken == sum(p.end - p.start for p in r.parts) for r in rows)


def test_pipeline_survives_hard_rows(spark, hard, empty, sf_dir):
    for docs in (hard, empty):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf_dir).count() <= docs.count()
