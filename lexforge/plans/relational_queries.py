"""Joins (JON), ordered state (WIN), nearest and interval matches (CIT-02, 11, 12), set scores and reports (EVA-13 to 15, GRP) on the common tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import evaluation as E
from lexforge.operators import joins as J
from lexforge.operators import windows as W

from .base import catalog, frame, table, values

C = catalog()


def micros(c: str):
    return F.unix_micros(c)


@C.add(
    """SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried
       FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)"""
)
def last_value_inherit(spark, sf_dir):
    """WIN-01: the user's last purchase value at each event."""
    e = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return W.inherit(e, "user_id", "o", F.when(F.col("event_type") == "purchase", F.col("value")), "carried").select("event_id", "carried")


@C.add(
    """SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id, role) > 1 THEN conv_id || '-' || role || '-' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) ELSE conv_id || '-' || role END AS id FROM conversations"""
)
def assign_ids(spark, sf_dir):
    """WIN-02: turns named by conversation and role, numbered where a role repeats."""
    return W.assign_ids(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "id")


@C.add(
    """SELECT conv_id, turn, CAST(coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY start), total) - start AS BIGINT) AS span FROM (
       SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS start, sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations)"""
)
def next_slice(spark, sf_dir):
    """WIN-03: turns as slices of the conversation's text."""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("long"))
    w = Window.partitionBy("conv_id")
    c = c.withColumn("start", F.sum("n").over(w.orderBy("turn")) - F.col("n")).withColumn("total", F.sum("n").over(w))
    return W.next_start(c, "conv_id", "start", F.col("total")).select("conv_id", "turn", (F.col("end") - F.col("start")).alias("span"))


@C.add("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS rank FROM lineitem QUALIFY rank <= 5")
def ranked_lines(spark, sf_dir):
    """WIN-04: the five dearest lines of each return flag."""
    lines = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return W.ranked(lines, ["l_returnflag"], "l_extendedprice", "k").filter("rank <= 5").select("l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@C.add("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY best) AS place FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS best FROM orders)) WHERE place <= 2")
def first_t_groups(spark, sf_dir):
    """WIN-05: orders of a customer's first two priorities."""
    return W.first_groups(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey", 2).select("o_custkey", "o_orderkey", "o_orderpriority")


RUNS = [(1, "1,2,3,5"), (2, "2,1,2,2,3"), (3, "4"), (4, "1,1,2"), (5, "3,2,1")]


@C.add(f"SELECT id, CAST(list_reduce(list_prepend(0, list_transform(string_split(n, ','), lambda x: CAST(x AS INTEGER))), lambda a, x: CASE WHEN x = a + 1 THEN x ELSE a END) AS INTEGER) AS run FROM {values(RUNS, 'id long, n string')}")
def counting_run(spark, sf_dir):
    """WIN-07."""
    return frame(spark, RUNS, "id long, n string").select("id", W.counting_run(F.transform(F.split("n", ","), lambda x: x.cast("int"))).alias("run"))


@C.add("SELECT event_id FROM (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events) WHERE top IS NULL OR value > top")
def running_max_filter(spark, sf_dir):
    """WIN-08: events that set a user's record."""
    e = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return W.growing(e, ["user_id"], "o", "value").select("event_id")


@C.add(
    """SELECT o_orderkey, CASE WHEN a.k IS NOT NULL THEN a.v ELSE b.v END AS v FROM orders LEFT JOIN (SELECT l_orderkey AS k, min(l_shipdate) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a ON o_orderkey = a.k
       LEFT JOIN (SELECT l_orderkey AS k, max(l_shipdate) AS v FROM lineitem GROUP BY 1) b ON o_orderkey = b.k"""
)
def left_fallback_join(spark, sf_dir):
    """JON-02: first returned shipment, else the last shipment."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    first = lines.filter("l_returnflag = 'R'").groupBy("o_orderkey").agg(F.min("l_shipdate").alias("v"))
    second = lines.groupBy("o_orderkey").agg(F.max("l_shipdate").alias("v"))
    return J.left_with_fallback(table(spark, sf_dir, "orders").select("o_orderkey"), first, second, ["o_orderkey"], "v")


@C.add("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def semi_anti_redirect(spark, sf_dir):
    """JON-06: labelled documents that are not labelled bad."""
    labels = table(spark, sf_dir, "labels")
    return J.cited_and_absent(table(spark, sf_dir, "documents").select("doc_id", "text"), labels, labels.filter("quality = 0"), ["doc_id"])


_LEG = "(SELECT user_id, round(sum(value), 6) AS score FROM events WHERE event_type = '{0}' GROUP BY 1)"


@C.add(f"SELECT user_id, coalesce(a.score, 0) AS s0, coalesce(b.score, 0) AS s1, coalesce(c.score, 0) AS s2 FROM {_LEG.format('purchase')} a FULL JOIN {_LEG.format('click')} b USING (user_id) FULL JOIN {_LEG.format('view')} c USING (user_id)")
def full_outer_legs(spark, sf_dir):
    """JON-07: three scored legs merged, missing scores 0."""
    e = table(spark, sf_dir, "events")
    legs = [e.filter(F.col("event_type") == k).groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("score")) for k in ("purchase", "click", "view")]
    return J.outer_legs(legs, ["user_id"])


@C.add("SELECT user_id, coalesce(a.v, b.v) AS v FROM (SELECT user_id, 'p' || count(*) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1) a FULL JOIN (SELECT user_id, 'c' || count(*) AS v FROM events WHERE event_type = 'click' GROUP BY 1) b USING (user_id)")
def first_payload(spark, sf_dir):
    """JON-08."""
    e = table(spark, sf_dir, "events")
    leg = lambda k, p: e.filter(F.col("event_type") == k).groupBy("user_id").agg(F.concat(F.lit(p), F.count("*").cast("string")).alias("v"))
    return J.first_payload([leg("purchase", "p"), leg("click", "c")], ["user_id"], "v")


INDEX = [("10-5-1", "10", "5"), ("10-6", "10", "6"), ("11-1", "11", "1"), ("12-9", "12", "9"), ("10-7-2", "10", "7")]
CORPUS = [("10-5", "10", "5"), ("10-6", "10", "6"), ("10-7-1", "10", "7"), ("10-7-3", "10", "7"), ("11-1", "11", "1")]
ID_T = "madde_id string, mevzuat_id string, madde_no string"


@C.add(
    f"""WITH i AS (SELECT * FROM {values(INDEX, ID_T)}), c AS (SELECT * FROM {values(CORPUS, ID_T)}), s AS (SELECT mevzuat_id, madde_no, min(madde_id) AS single FROM c GROUP BY ALL HAVING count(*) = 1)
        SELECT i.*, CASE WHEN i.madde_id IN (SELECT madde_id FROM c) THEN i.madde_id ELSE coalesce(single, i.madde_id) END AS resolved_id FROM i LEFT JOIN s USING (mevzuat_id, madde_no)"""
)
def id_reconcile(spark, sf_dir):
    """JON-09."""
    return J.reconcile(frame(spark, INDEX, ID_T), frame(spark, CORPUS, ID_T), "madde_id", "mevzuat_id", "madde_no")


@C.add("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), n_name, '') AS c_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def fill_lookup(spark, sf_dir):
    """JON-10."""
    blank = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("c_name"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("c_name"))
    return J.fill(blank, names, "k", "c_name").select("c_custkey", "c_name")


@C.add(
    """SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.text <> n.text OR o.lang <> n.lang THEN 'changed' ELSE 'same' END AS state
       FROM (SELECT * FROM documents WHERE doc_id % 7 <> 0) o FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END AS text, lang FROM documents WHERE doc_id % 11 <> 0) n USING (doc_id)"""
)
def corpus_diff(spark, sf_dir):
    """JON-12: two versions of the documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    new = d.filter("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return J.diff(d.filter("doc_id % 7 <> 0"), new, "doc_id", ["text", "lang"])


@C.add(
    """WITH k AS (SELECT doc_id, lang, left(trim(regexp_replace(lower(left(text, 90)), '\\s+', ' ', 'g')), 80) AS k FROM documents)
       SELECT DISTINCT a.doc_id FROM k a JOIN k b ON a.lang = b.lang AND a.doc_id <> b.doc_id WHERE a.k <> '' AND b.k <> '' AND (starts_with(a.k, b.k) OR starts_with(b.k, a.k) OR (length(a.k) >= 40 AND length(b.k) >= 40 AND left(a.k, 40) = left(b.k, 40)))"""
)
def theta_overlap(spark, sf_dir):
    """JON-13, TXT-38: documents whose head overlaps another one's of the same language."""
    head = F.left(T.squeeze(F.lower(F.left("text", F.lit(90)))), F.lit(80))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", head.alias("head")).filter("head <> '' AND lang IS NOT NULL")
    return d.join(J.overlapping_heads(d, "doc_id", "lang", "head"), ["lang", "head"], "left_semi").select("doc_id")


@C.add(
    """WITH p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase')
       SELECT event_id, coalesce((SELECT max_by(value, ts) FROM p WHERE p.user_id = v.user_id AND p.ts <= v.ts), (SELECT min_by(value, ts) FROM p WHERE p.user_id = v.user_id AND p.ts > v.ts)) AS near FROM events v WHERE event_type = 'view'"""
)
def asof_nearest(spark, sf_dir):
    """CIT-11: the purchase at or before each view, else the next one."""
    e = table(spark, sf_dir, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("near"))
    return J.nearest(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "near").select("event_id", "near")


@C.add(
    """WITH v AS (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click')
       SELECT event_id, (SELECT min_by(value, c.ts) FROM c WHERE c.user_id = v.user_id AND c.ts >= v.ts AND (v.nxt IS NULL OR c.ts < v.nxt)) AS clicked FROM v"""
)
def interval_first_match(spark, sf_dir):
    """CIT-12: the first click after a view and before the next view."""
    e = table(spark, sf_dir, "events")
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", F.col("value").alias("clicked"))
    return J.first_in_interval(e.filter("event_type = 'view'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "clicked").select("event_id", "clicked")


@C.add(
    """WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS g, l_orderkey % 5000 AS bas, l_orderkey % 5000 + CAST(l_quantity AS BIGINT) AS son FROM lineitem)
       SELECT a.id AS a_id, b.id AS b_id FROM i a JOIN i b ON a.g = b.g AND a.id < b.id AND a.bas < b.son AND b.bas < a.son"""
)
def overlap_pairs(spark, sf_dir):
    """CIT-02: overlapping intervals of one supplier."""
    i = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("g"), (F.col("l_orderkey") % 5000).alias("bas"), (F.col("l_orderkey") % 5000 + F.col("l_quantity").cast("long")).alias("son")
    )
    return J.overlapping(i, i, "g", 64).filter("a_id < b_id").select("a_id", "b_id")


@C.add(
    """WITH b AS (SELECT * FROM (SELECT doc_id, quality, toxic, true AS in_t FROM labels WHERE doc_id % 3 <> 0) FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE quality END AS q2, toxic AS t2, true AS in_f FROM labels WHERE doc_id % 5 <> 0) USING (doc_id)),
       c AS (SELECT count(*) FILTER (WHERE in_t AND in_f) AS tp, count(*) FILTER (WHERE in_t IS NULL) AS fp, count(*) FILTER (WHERE in_f IS NULL) AS fn,
         count(*) FILTER (WHERE in_t AND in_f AND quality = q2) AS quality_match, count(*) FILTER (WHERE in_t AND in_f AND quality IS DISTINCT FROM q2) AS quality_mismatch, count(*) FILTER (WHERE in_t AND in_f AND quality IS NULL AND q2 IS NULL) AS quality_null FROM b)
       SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c"""
)
def set_prf1(spark, sf_dir):
    """EVA-13."""
    labels = table(spark, sf_dir, "labels")
    found = labels.filter("doc_id % 5 <> 0").withColumn("quality", F.when(F.col("doc_id") % 4 != 0, F.col("quality")))
    return E.set_scores(labels.filter("doc_id % 3 <> 0"), found, ["doc_id"], ["quality"])


LAWS = [(1, "1,2,3", "1,2,Ek 1", "3", False), (2, "1,2", "1,2", "", True), (3, "1,2,3,4", "1,5,4/A", "", False), (4, "", "", "", True)]
LAWS_T = "id long, gt string, pred string, ranges string, deg boolean"
_LAW_SQL = f"""WITH a AS (SELECT id, deg, list_filter(string_split(gt, ','), lambda x: x <> '') AS gt, list_filter(string_split(pred, ','), lambda x: x <> '') AS pred, list_filter(string_split(ranges, ','), lambda x: x <> '') AS ranges FROM {values(LAWS, LAWS_T)}),
        l AS (SELECT *, len(list_filter(pred, lambda x: list_contains(gt, x))) AS tp, list_filter(pred, lambda x: NOT list_contains(gt, x)) AS fpl, list_filter(gt, lambda x: NOT list_contains(pred, x)) AS fnl FROM a),
        s AS (SELECT id, deg, tp, len(fpl) AS fp, len(fnl) AS fn, len(list_filter(fpl, lambda x: NOT (starts_with(x, 'Ek') OR starts_with(x, 'Geçici') OR starts_with(x, 'Mükerrer') OR contains(x, '/')))) AS real_fp, len(list_filter(fnl, lambda x: NOT list_contains(ranges, x))) AS real_fn FROM l)"""
_SHARE = "round(CASE WHEN {0} + {1} > 0 THEN {0} / ({0} + {1}) ELSE 1.0 END, {2})"


def laws(spark):
    part = lambda c: F.filter(F.split(c, ","), lambda x: x != "").alias(c)
    return E.law_scores(frame(spark, LAWS, LAWS_T).select("id", "deg", *[part(c) for c in ("gt", "pred", "ranges")]))


_EACH = ", ".join(f"{_SHARE.format('tp', other, 4)} AS {name}" for name, other in (("prec_raw", "fp"), ("prec_adj", "real_fp"), ("rec", "fn"), ("rec_adj", "real_fn")))


@C.add(f"{_LAW_SQL} SELECT id, CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn, CAST(real_fp AS INTEGER) AS real_fp, CAST(real_fn AS INTEGER) AS real_fn, {_EACH} FROM s")
def law_scores(spark, sf_dir):
    """EVA-14, TXT-34."""
    return laws(spark).select("id", "tp", "fp", "fn", "real_fp", "real_fn", "prec_raw", "prec_adj", "rec", "rec_adj")


_SUM = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("tp", "fp", "fn", "real_fp", "real_fn"))


@C.add(f"{_LAW_SQL}, m AS (SELECT deg, {_SUM}, count(*) AS n FROM s GROUP BY ROLLUP (deg)) SELECT *, {_EACH.replace(', 4)', ', 6)')} FROM m")
def micro_agg_rollup(spark, sf_dir):
    """EVA-15."""
    return E.micro(laws(spark), "deg")


@C.add("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def facet_counts(spark, sf_dir):
    """GRP-06."""
    lines = table(spark, sf_dir, "lineitem")
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return lines.groupingSets([[a], [b], []], a, b).agg(F.count("*").alias("n"))


@C.add(
    """WITH w AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[a-zçğıöşü]{4,}')) AS w, list_distinct(regexp_extract_all(lower(left(text, 1500)), '[a-zçğıöşü]{4,}')) AS m FROM documents),
       s AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN len(list_filter(m, lambda x: list_contains(w, x))) / len(w) ELSE 0 END AS share FROM w)
       SELECT doc_id, round(share, 6) AS share, CASE WHEN share >= 0.95 THEN 'full' WHEN share >= 0.8 THEN 'partial' ELSE 'low' END AS bucket FROM s"""
)
def body_recall(spark, sf_dir):
    """EVA-16: share of a document's words in its first 1,500 characters."""
    d = table(spark, sf_dir, "documents")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-zçğıöşü]{4,}"), F.lit(0)))
    return E.body_recall(d, words(F.left("text", F.lit(1500))), words(F.col("text"))).select("doc_id", "share", "bucket")


@C.add("SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE quality = 1) AS BIGINT) AS good, CAST(count(*) FILTER (WHERE toxic = 0) AS BIGINT) AS clean, CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS BIGINT) AS valid FROM labels")
def gate_funnel(spark, sf_dir):
    """GRP-07."""
    return E.funnel(table(spark, sf_dir, "labels"), {"good": F.col("quality") == 1, "clean": F.col("toxic") == 0})


@C.add("SELECT doc_id, k AS word, CAST(n AS BIGINT) AS n FROM (SELECT doc_id, unnest(['the', 'und', 'le']) AS k, unnest([len(regexp_extract_all(text, 'the')), len(regexp_extract_all(text, 'und')), len(regexp_extract_all(text, 'le'))]) AS n FROM documents) WHERE n > 0")
def keyword_counts(spark, sf_dir):
    """GRP-08."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(E.keyword_counts(F.col("text"), ("the", "und", "le"))).alias("word", "n"))
    return d.select("doc_id", "word", F.col("n").cast("long").alias("n"))


@C.add("SELECT CAST(count(n) AS BIGINT) AS n, round(avg(n), 6) AS mean, median(n) AS median, CAST(max(n) AS BIGINT) AS max FROM (SELECT length(text) AS n FROM documents)")
def length_spread(spark, sf_dir):
    """GRP-02."""
    s = E.spread(table(spark, sf_dir, "documents").select(F.length("text").alias("n")), "n")
    return s.select("n", "mean", "median", F.col("max").cast("long").alias("max"))


_ORDER = f"CAST('0x' || left(md5(concat_ws(':', doc_id, {E.SEED})), 7) AS BIGINT), doc_id"


@C.add(
    f"""WITH d AS (SELECT doc_id, source, length(text) AS n, CASE WHEN length(text) < 400 THEN 'kisa' WHEN length(text) < 1200 THEN 'orta' ELSE 'uzun' END AS stratum FROM documents),
        g AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_ORDER}) <= 6)
        SELECT doc_id, source, CAST(n AS INTEGER) AS n, stratum FROM g QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY {_ORDER}) <= 40"""
)
def stratified_quota(spark, sf_dir):
    """GRP-05: quotas by source and length class, in an order drawn by MD5."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"))
    return E.stratified(d, "source", T.stratum(F.col("n")), 6, 40)


@C.add("SELECT CAST(user_id AS VARCHAR) AS mevzuat_id, min(event_id) AS pos FROM events GROUP BY 1")
def list_dedupe(spark, sf_dir):
    """SRC-01: first of equal ids by position."""
    from lexforge.sources.lists import first_of_each

    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("mevzuat_id"), F.col("event_id").alias("pos"))
    return first_of_each(e, "mevzuat_id", "pos").select("mevzuat_id", "pos")


@C.add("SELECT doc_id, text, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    """SNK-05, SRC-19: what has no result yet."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "text", "lang")
