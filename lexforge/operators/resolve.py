"""Citation resolution and routing as joins (RES-01 to RES-06, MOD-01, MOD-02, JON-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge import schema as Z
from lexforge.functions import citation_values as V
from lexforge.functions import fixed as X
from lexforge.functions import text as N

from . import citation as C

#: Law names are broadcast to the parser up to this many; a larger dictionary is an error, not a silent cut.
NAMES_LIMIT = 200_000


def index(corpus: DataFrame) -> DataFrame:
    """RES-01: slim rows keyed by (law, kind, number), in corpus order ``sira``."""
    m = lambda c: F.col(f"metadata.{c}")
    key = N.article_key(m("madde_no"))
    return corpus.select(
        "sira", F.col("id").alias("madde_id"), F.coalesce(m("mevzuat_id"), F.split_part("id", F.lit("-"), F.lit(1))).alias("mevzuat_id"), m("kanun_no"), F.coalesce(m("kanun_ad"), F.lit("")).alias("kanun_ad"),
        m("madde_no"), m("yurutluk"), m("tasindigi_kanun"), m("fikralar"), N.law_number(m("kanun_no")).alias("law"), key["kind"].alias("kind"), key["number"].alias("number"),
    )


def law_names(idx: DataFrame) -> DataFrame:
    """RES-01: folded names of eight characters or more with their law numbers."""
    name = N.squeeze(N.fold(F.col("kanun_ad")))
    return idx.select(name.alias("name"), "law").filter(F.length("name") >= V.NAME_LEAST).groupBy("name").agg(F.sort_array(F.collect_set("law")).alias("laws"))


def parse_queries(queries: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """CIT-01: ``queries`` (query_id, text) with ``parsed`` (citations and diagnosis); a failing query has none."""
    known: list[tuple[str, tuple[str, ...]]] = []
    if names is not None:
        rows = names.limit(NAMES_LIMIT + 1).collect()
        if len(rows) > NAMES_LIMIT:
            raise ValueError(f"more than {NAMES_LIMIT} law names: narrow the index first")
        known = sorted(((r["name"], tuple(r["laws"])) for r in rows), key=lambda x: (-len(x[0]), x[0]))
    shared = queries.sparkSession.sparkContext.broadcast(known)

    def run(text: str | None):
        try:
            got = C.parse(text or "", shared.value)
        except (ValueError, KeyError, IndexError):
            return {"atiflar": [], "tani": "parser_error"}
        return {"atiflar": got.citations, "tani": got.diagnosis()}

    return queries.withColumn("parsed", F.udf(run, Z.PARSED, useArrow=True)("text"))


sub_part = F.udf(lambda tree, p, c: C.sub_part([_plain(x) for x in tree or []], p, c), Z.SUBPART)


def _plain(p) -> dict:
    return p.asDict(recursive=True)


def resolve(parsed: DataFrame, idx: DataFrame) -> DataFrame:
    """RES-02, RES-03, RES-05: one row for each citation and match; unmatched citations have one row with a null madde_id.

    Readings become rows with their place; all are joined on the three-column key at once, and the first place that succeeds wins. Only the
    first reading may match inexactly.
    """
    cites = parsed.select("query_id", F.posexplode("parsed.atiflar").alias("cite", "a"))
    laws = cites.select("query_id", "cite", "a", F.posexplode("a.kanun_nolari").alias("law_pos", "law_raw")).withColumn("law", N.law_number(F.col("law_raw")))
    present = idx.select("law").distinct().withColumn("known", F.lit(True))
    tried = laws.join(present, "law").select("query_id", "cite", "law", F.col("a.kanun_ipucu").alias("hint"), F.col("a.yorumlar").alias("all"), F.posexplode("a.yorumlar").alias("place", "y"))
    hits = tried.join(idx, (tried["law"] == idx["law"]) & (F.col("y.madde_tipi") == idx["kind"]) & (F.col("y.madde_numara") == idx["number"])).drop(idx["law"])
    hits = _disambiguate(hits)
    part = sub_part("fikralar", "y.fikra", "y.bent")
    hits = hits.withColumn("p", part).filter((F.col("place") == 0) | F.col("p.tam"))
    first = F.min("place").over(Window.partitionBy("query_id", "cite"))
    hits = hits.withColumn("best", first).filter("place = best")
    same = Window.partitionBy("query_id", "cite", "mevzuat_id")
    laws_in = F.size(F.collect_set("mevzuat_id").over(Window.partitionBy("query_id", "cite")))
    warn = lambda cond, said: F.when(cond, said)
    own = F.array_compact(
        F.array(
            warn(F.col("y.aciklama").isNotNull(), F.concat(F.lit("read_as:"), F.col("y.aciklama"))),
            F.lit(None).cast("string"),
        )
    )
    state = F.array_compact(
        F.array(
            warn(F.col("yurutluk") == X.REPEALED, F.lit("repealed")),
            warn(F.col("tasindigi_kanun").isNotNull(), F.concat(F.lit("moved_to:"), F.col("tasindigi_kanun"))),
            warn(F.count("*").over(same) > 1, F.lit("same_number_twice")),
        )
    )
    hits = hits.withColumn("uyarilar", F.concat(own, F.col("p.uyarilar"), state)).withColumn("coklu_mevzuat", F.col("several") & (laws_in > 1))
    matched = hits.select("query_id", "cite", "sira", "madde_id", "mevzuat_id", "kanun_no", "madde_no", "place", F.col("p.parca").alias("parca"), F.col("p.tam").alias("tam"), "uyarilar", "coklu_mevzuat", F.lit("eslesti").alias("durum"))
    known = laws.join(present, "law", "left").groupBy("query_id", "cite").agg(F.max(F.coalesce("known", F.lit(False))).alias("known"))
    missed = known.join(matched.select("query_id", "cite").distinct(), ["query_id", "cite"], "left_anti").select("query_id", "cite", F.when(F.col("known"), "madde_yok").otherwise("kanun_yok").alias("durum"))
    return matched.unionByName(missed, allowMissingColumns=True)


def _disambiguate(hits: DataFrame) -> DataFrame:
    """RES-03: of several laws with one number, the one whose name shares most stems with the hint, if it is alone in that."""
    score = F.when(F.col("hint").isNull(), 0).otherwise(F.size(F.array_intersect(N.name_stems(F.col("hint")), N.name_stems(F.col("name0")))))
    group = Window.partitionBy("query_id", "cite", "place")
    first_name = F.first("kanun_ad").over(Window.partitionBy("query_id", "cite", "place", "mevzuat_id").orderBy("sira"))
    scored = hits.withColumn("name0", first_name).withColumn("score", score)
    best = F.max("score").over(group)
    ahead = F.size(F.collect_set(F.when(F.col("score") == F.col("best_score"), F.col("mevzuat_id"))).over(group))
    laws = F.size(F.collect_set("mevzuat_id").over(group))
    decided = scored.withColumn("best_score", best).withColumn("ahead", ahead).withColumn("laws", laws).withColumn("sure", (F.col("best_score") > 0) & (F.col("ahead") == 1))
    kept = decided.filter((F.col("laws") == 1) | ~F.col("sure") | (F.col("score") == F.col("best_score")))
    return kept.withColumn("several", (F.col("laws") > 1) & ~F.col("sure")).drop("name0", "score", "best_score", "ahead", "laws", "sure")


def route(parsed: DataFrame, resolved: DataFrame, mode: str = "otomatik") -> DataFrame:
    """MOD-01: for each query the path (atif or dogal) and its status; citations that match nothing fall back to the ranked search."""
    if mode not in ("otomatik", "atif", "dogal"):
        raise ValueError(f"unknown mode {mode!r}")
    counts = resolved.groupBy("query_id").agg(F.count_distinct("cite").alias("cites"), F.count_distinct(F.when(F.col("durum") == "eslesti", F.col("cite"))).alias("hits"))
    q = parsed.join(counts, "query_id", "left")
    none = F.size("parsed.atiflar") == 0
    found = F.coalesce("hits", F.lit(0))
    status = F.when(none, F.lit("ayristirilamadi" if mode == "atif" else None)).when(found == 0, "eslesme_yok").when(found < F.col("cites"), "kismi").otherwise("eslesti")
    if mode == "dogal":
        return q.select("query_id", F.lit("dogal").alias("mod"), F.lit(None).cast("string").alias("durum"))
    return q.select("query_id", F.when(none | (found == 0), "dogal").otherwise("atif").alias("mod"), status.cast("string").alias("durum"))


def citation_rows(resolved: DataFrame, top_k: int = X.TOP) -> DataFrame:
    """MOD-02 and RES-06: matches without repeats, in the order of the citations, repealed ones included, each with score 1."""
    matched = resolved.filter("madde_id IS NOT NULL")
    key = Window.partitionBy("query_id", "madde_id", "parca.fikra", "parca.bent").orderBy("cite", "sira")
    once = matched.withColumn("r", F.row_number().over(key)).filter("r = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("cite", "sira"))
    return once.withColumn("rank", place).filter(F.col("rank") <= top_k).withColumn("score", F.lit(1.0)).drop("r")


def version(path_rows: DataFrame) -> DataFrame:
    """STR-04: file and modification time of a corpus table, to tell whether it changed since an index was built."""
    return path_rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified")).distinct()


