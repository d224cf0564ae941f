"""Corpus build as one DataFrame pipeline (COR, JON-01 to JON-06, STA-03, WIN-01, WIN-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge import schema as Z
from lexforge.functions import fixed as X
from lexforge.functions import text as T
from lexforge.functions.status import rolled_up

from . import structure as S
from .windows import assign_ids, inherit


def is_redirect_note(body: Column) -> Column:
    """COR-01: nothing but a note that the provision moved; long sentences that do not open like one are real provisions."""
    b = T.strip(body)
    real = ~(b.startswith("(") | T.has(b, X.REDIRECT_PAREN)) & (F.length(b) > X.REDIRECT_LONG) & ~T.has(b, X.REDIRECT_START)
    return T.has(b, X.REDIRECT_NOTE) & ~real


def is_artefact(body: Column) -> Column:
    """COR-02: fewer than three characters besides numbers, marks and punctuation."""
    return F.length(T.drop(body, X.ARTEFACT)) < X.ARTEFACT_LEAST


def leak_markers(events: DataFrame) -> DataFrame:
    """BLD-05 (native): names between an article and the next (mevzuat_id, no, levels, titles).

    Every event is tagged with the article it follows by a running maximum, so the "range join" of articles to the events up to the
    next article is a window and a group-by; the closing article belongs to the range as well.
    """
    w = Window.partitionBy("mevzuat_id").orderBy("seq")
    is_article = F.col("kind") == "madde"
    at_or_before = F.max(F.when(is_article, F.col("seq"))).over(w)
    before = F.max(F.when(is_article, F.col("seq"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    name = lambda c, rank, level: F.struct((F.col("seq") * 2 + rank).alias("o"), F.col(c).alias("name"), F.lit(level).alias("level"))
    names = F.when(is_article, F.array(name("baslik", 0, False))).otherwise(F.array(name("label", 0, True), name("title", 1, True)))
    owner = F.when(is_article, before).otherwise(at_or_before)
    each = events.withColumn("owner", owner).filter("owner IS NOT NULL").select("mevzuat_id", "owner", F.explode(names).alias("n")).select("mevzuat_id", "owner", "n.*")
    sure = (F.length(T.strip(F.col("name"))) >= X.MARKER_LEAST) & F.rlike("name", F.lit("[A-Za-zÇĞİÖŞÜçğıöşü]"))
    level = F.col("level") & F.rlike(F.upper("name"), F.lit("|".join(X.LEVEL_WORDS)))
    grouped = each.filter(sure).groupBy("mevzuat_id", "owner").agg(F.array_sort(F.collect_list(F.struct("o", "name", level.alias("level")))).alias("n"))
    pick = lambda keep: F.transform(F.filter("n", lambda x: x["level"] if keep else ~x["level"]), lambda x: x["name"])
    first = events.filter(is_article).groupBy("mevzuat_id", "no").agg(F.min("seq").alias("owner"))
    return first.join(grouped, ["mevzuat_id", "owner"]).select("mevzuat_id", "no", pick(True).alias("levels"), pick(False).alias("titles"))


def enrich(laws: DataFrame) -> DataFrame:
    """COR-07: enriched articles of ``laws`` (mevzuat_id, kanun_no, kanun_ad, html, tree).

    The parse of a law is one narrow step; hierarchy, footnotes and tables come by joins on (mevzuat_id, no), inheritance and ids by
    windows on mevzuat_id, which all share one partitioning.
    """
    key = ["mevzuat_id", "no"]
    events = S.tree_table(laws)
    node = F.struct(*Z.LEVEL_FIELDS, "hiyerarsi_yolu", "baslik", "maddeId")
    nodes = events.filter("kind = 'madde'").groupBy(*key).agg(F.max_by(node, "seq").alias("node"))  # the last of equal numbers
    numbers = laws.select("mevzuat_id", "kanun_no")
    rows = S.article_table(laws).withColumn("f", S.footnote_appendix("body")).select(*key, "ord", F.col("f.body").alias("body"), F.col("f.notes").alias("notes"))
    rows = rows.withColumn("madde_tipi", T.article_kind(F.col("no"))).join(numbers, "mevzuat_id")
    rows = rows.join(nodes, key, "left").join(leak_markers(events), key, "left")  # JON-01
    own = (F.col("madde_tipi") == "asil") & F.col("node").isNotNull()
    rows = rows.withColumn("node", F.when(own, F.col("node")))
    for c in ("levels", "titles"):
        rows = rows.withColumn(c, F.when(own, F.col(c)))
    body = S.drop_leading_redirect(S.drop_leaks("body", "levels", "titles", "kanun_no"))
    rows = rows.withColumn("body", body).withColumn("fikralar", S.paragraphs("body"))
    rows = inherit(rows, "mevzuat_id", "ord", F.col("node"), "level")  # WIN-01
    rows = rows.withColumn("yurutluk", rolled_up(F.col("fikralar"), F.col("body")))
    rows = link_footnotes(rows, laws)
    rows = link_tables(rows, laws)
    rows = assign_ids(rows, "mevzuat_id", "ord", "no")
    return rows.select(
        "mevzuat_id", "ord", "id", "no", "madde_tipi", "body", "body_temiz", "yurutluk", "fikralar", S.amendments("body").alias("degisiklik_gecmisi"), "dipnotlar", "tablolar",
        F.col("node.baslik").alias("madde_baslik"), F.col("node.maddeId").alias("maddeId"), *[F.col(f"level.{c}").alias(c) for c in (*Z.LEVEL_FIELDS, "hiyerarsi_yolu")],
    )


def link_footnotes(rows: DataFrame, laws: DataFrame) -> DataFrame:
    """JON-02 and JON-04: footnotes by the page's anchors, else by marks in the body joined to the law's definitions."""
    anchored = laws.select("mevzuat_id", F.explode(S.html_footnotes("html")).alias("x")).select("mevzuat_id", "x.no", F.col("x.notes").alias("anchored"))
    defined = rows.select("mevzuat_id", "ord", F.posexplode("notes").alias("k", "n"))
    defined = defined.groupBy("mevzuat_id", F.col("n.no").alias("mark")).agg(F.max_by("n", F.struct("ord", "k")).alias("note"))
    marks = F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda m: m.cast("int")))
    used = rows.select("mevzuat_id", "ord", F.posexplode(marks).alias("k", "mark")).join(defined, ["mevzuat_id", "mark"])
    used = used.groupBy("mevzuat_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "note"))), lambda x: x["note"]).alias("marked"))
    empty = F.array().cast(Z.T.ArrayType(Z.FOOTNOTE))
    return (
        rows.join(anchored, ["mevzuat_id", "no"], "left").join(used, ["mevzuat_id", "ord"], "left").withColumn("dipnotlar", F.coalesce("anchored", "marked", empty)).drop("anchored", "marked", "notes")
    )


def link_tables(rows: DataFrame, laws: DataFrame) -> DataFrame:
    """JON-03: an article's tables, which its clean body ends with."""
    tables = laws.select("mevzuat_id", F.explode(S.html_tables("html")).alias("x")).select("mevzuat_id", "x.no", F.col("x.tables").alias("tables"))
    joined = rows.join(tables, ["mevzuat_id", "no"], "left").withColumn("tablolar", F.coalesce("tables", F.array().cast("array<string>"))).drop("tables")
    clean = T.strip_amendments(F.col("body"))
    return joined.withColumn("body_temiz", T.strip(F.concat_ws("\n\n", F.array(clean), F.col("tablolar"))))


def chunks(rows: DataFrame, laws: DataFrame, records: DataFrame) -> DataFrame:
    """COR-03 and COR-04: corpus rows; empty, moved, table-only and (in force) artefact articles go."""
    body = T.strip(F.coalesce(F.nullif("body_temiz", F.lit("")), "body"))
    wide = with_law(rows, laws, records).withColumn("govde", body).withColumn("metin", T.without_tables(body, F.col("tablolar")))
    kept = wide.filter((F.col("govde") != "") & ~is_redirect_note(F.col("govde")) & (F.col("metin") != "") & ((F.col("yurutluk") == X.REPEALED) | ~is_artefact(F.col("metin"))))
    return _project(kept, T.embed_text(F.col("madde_baslik"), F.col("metin")))


def redirects(rows: DataFrame, laws: DataFrame, records: DataFrame, cited: DataFrame, present: DataFrame) -> DataFrame:
    """COR-05 and JON-06: rows for cited articles (kanun_no, madde_key) that moved to another law and are not in the corpus."""
    body = T.strip(F.coalesce(F.nullif("body_temiz", F.lit("")), "body"))
    wide = with_law(rows, laws, records).withColumn("hedef", T.redirect_target(body)).filter(is_redirect_note(body) & F.col("hedef").isNotNull())
    keyed = wide.withColumn("__law", T.law_number(F.col("kanun_no"))).withColumn("__key", T.build_key(F.col("no")))
    wanted = cited.select(T.law_number(F.col("kanun_no")).alias("__law"), T.build_key(F.col("madde_no")).alias("__key"))
    known = present.select("metadata.mevzuat_id", T.build_key(F.col("metadata.madde_no")).alias("__key"))
    first = Window.partitionBy("mevzuat_id", "__key").orderBy("ord")
    moved = keyed.join(wanted, ["__law", "__key"], "left_semi").join(known, ["mevzuat_id", "__key"], "left_anti").withColumn("__r", F.row_number().over(first)).filter("__r = 1")
    for c, kind in (("fikralar", Z.PARAGRAPH), ("degisiklik_gecmisi", Z.AMENDMENT), ("dipnotlar", Z.FOOTNOTE), ("tablolar", Z.S)):
        moved = moved.withColumn(c, F.array().cast(Z.T.ArrayType(kind)))
    path = T.path_of(F.col("hiyerarsi_yolu"), F.col("madde_tipi"), F.col("no"))
    moved = moved.withColumn("hiyerarsi_yolu", path).withColumn("madde_tipi", F.lit(X.REDIRECT_KIND)).withColumn("madde_baslik", F.lit(None).cast("string"))
    return _project(moved, F.lit(""), F.lit(True), F.col("hedef"))


def with_law(rows: DataFrame, laws: DataFrame, records: DataFrame) -> DataFrame:
    """JON-05: law-level fields; ``records`` has (mevzuat_id, resmi_gazete_tarihi, resmi_gazete_sayisi)."""
    return rows.join(laws.select("mevzuat_id", "kanun_no", "kanun_ad"), "mevzuat_id").join(records, "mevzuat_id", "left")


def _project(rows: DataFrame, text: Column, moved: Column | None = None, target: Column | None = None) -> DataFrame:
    own = {
        "mevzuat_tur": F.lit(X.DOCUMENT_TYPE),
        "madde_no": F.col("no"),
        "hiyerarsi_yolu": T.path_of(F.col("hiyerarsi_yolu"), F.col("madde_tipi"), F.col("no")) if moved is None else F.col("hiyerarsi_yolu"),
        "fikralar": T.strip_marks_tree(F.col("fikralar")),
        "yerine_islenmistir": F.lit(None).cast("boolean") if moved is None else moved,
        "tasindigi_kanun": F.lit(None).cast("string") if target is None else target,
        "mevzuat_id": F.split_part("id", F.lit("-"), F.lit(1)),
    }
    return rows.select("id", text.alias("text"), F.struct(*[own.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in Z.METADATA.fields]).alias("metadata"))


def build_corpus(laws: DataFrame, records: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """COR-06: the corpus of ``laws``; ``cited`` adds rows for cited articles that moved."""
    rows = enrich(laws)
    main = chunks(rows, laws, records)
    return main if cited is None else main.unionByName(redirects(rows, laws, records, cited, main))


def payload(corpus: DataFrame) -> DataFrame:
    """COR-08: madde_id and the payload fields."""
    return corpus.select(F.col("id").alias("madde_id"), *[F.col(f"metadata.{c}").alias(c) for c in X.PAYLOAD])


def in_force(df: DataFrame, column: str = "yurutluk") -> DataFrame:
    """COR-09: belongs below every top-k."""
    return df.filter(F.col(column) == X.IN_FORCE)
