"""Law lists, record caches and page directories (SRC-01 to SRC-07, SRC-11 to SRC-21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge import schema as Z
from lexforge.functions.text import build_key, law_number, law_record

LAW_LIST = "kanun_no STRING, mevzuat_id STRING, kanun_ad STRING"


def first_of_each(df: DataFrame, key: str, position: str) -> DataFrame:
    """SRC-01: of equal keys the first by position."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(position))).filter("__r = 1").drop("__r")


def law_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: a cached list of laws (tab-separated: number, id, name); the first line of an id counts."""
    rows = spark.read.csv(path, sep="\t", schema=LAW_LIST).withColumn("pos", F.col("_metadata.file_block_start") + F.monotonically_increasing_id())
    return first_of_each(rows, "mevzuat_id", "pos")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


RECORD = Z.row("mevzuatId", "mevzuatNo", "mevzuatAdi", "resmiGazeteTarihi", "resmiGazeteSayisi")


def law_records(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02, SRC-03, SRC-18: gazette fields by law from a JSON object {id: record}; nothing without the file, an error if it is malformed."""
    out = "mevzuat_id STRING, resmi_gazete_tarihi STRING, resmi_gazete_sayisi STRING"
    if not exists(spark, path):
        return spark.createDataFrame([], out)
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", T.MapType(T.StringType(), RECORD), {"mode": "FAILFAST"}).alias("m"))
    r = law_record(F.col("v.resmiGazeteTarihi"), F.col("v.resmiGazeteSayisi"))
    return raw.select(F.explode("m").alias("mevzuat_id", "v")).select("mevzuat_id", r.alias("r")).select("mevzuat_id", "r.*")


def checked_response(rows: DataFrame, status: str = "metadata.FMTY") -> DataFrame:
    """SRC-02: a response that does not say SUCCESS fails the query, even if it holds an empty list."""
    ok = F.coalesce(F.col(status) == "SUCCESS", F.lit(False))
    return rows.filter(F.assert_true(ok, F.concat(F.lit("source reported: "), F.coalesce(F.col(status).cast("string"), F.lit("nothing")))).isNull())


def decoded(content):
    """SRC-05, SRC-07: base64 text, invalid bytes replaced; anything else as it is."""
    raw = F.try_to_binary(content, F.lit("base64"))
    return F.coalesce(F.make_valid_utf8(F.decode(raw, "UTF-8")), content)


def _files(spark: SparkSession, path: str, prefix: str, ending: str, name: str) -> DataFrame:
    rows = spark.read.option("pathGlobFilter", f"{prefix}*{ending}").text(path, wholetext=True)
    key = F.regexp_extract("_metadata.file_name", rf"^\Q{prefix}\E(.*)\Q{ending}\E$", 1)
    return rows.select(key.alias("mevzuat_id"), F.col("value").alias(name))


def page_cache(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: (mevzuat_id, html) of a directory of html_<id>.html."""
    return _files(spark, path, "html_", ".html", "html")


def tree_cache(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04, SRC-06: (mevzuat_id, tree) of a directory of treejson_<id>.json."""
    return _files(spark, path, "treejson_", ".json", "tree")


def laws(spark: SparkSession, list_path: str, cache: str, only: str | None = None) -> DataFrame:
    """The laws of a list with their pages and trees; ``only`` prunes to one (CORPUS_MID)."""
    rows = law_list(spark, list_path)
    rows = rows if only is None else rows.filter(F.col("mevzuat_id") == only)
    return rows.join(page_cache(spark, cache), "mevzuat_id").join(tree_cache(spark, cache), "mevzuat_id", "left").select("mevzuat_id", "kanun_no", "kanun_ad", "html", "tree")


def cited_articles(spark: SparkSession, *paths: str) -> DataFrame:
    """SRC-17: (kanun_no, madde_no) keys from the first path that exists; none without any."""
    found = next((p for p in paths if exists(spark, p)), None)
    if found is None:
        return spark.createDataFrame([], "kanun_no STRING, madde_no STRING")
    rows = spark.read.schema("kanun_no STRING, madde_no STRING").json(found, multiLine=True).filter(F.coalesce("madde_no", F.lit("")) != "")
    return rows.select(law_number(F.col("kanun_no")).alias("kanun_no"), build_key(F.col("madde_no")).alias("madde_no")).distinct()


def missing(wanted: DataFrame, done: DataFrame, negative: DataFrame | None = None, key: str = "mevzuat_id") -> DataFrame:
    """SRC-19, SRC-21, STR-01: what is in neither the cache nor the list of known failures."""
    left = wanted.join(done, key, "left_anti")
    return left if negative is None else left.join(negative, key, "left_anti")


def shares(wanted: DataFrame, workers: int, order: str) -> DataFrame:
    """SRC-21: round-robin shares of a worklist."""
    rank = F.row_number().over(Window.orderBy(order)) - 1
    return wanted.withColumn("worker", F.pmod(rank, F.lit(workers)))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11, SRC-12: a JSON-lines corpus with the order of its rows (``sira``); blank lines are skipped, broken ones fail."""
    rows = spark.read.schema(Z.CHUNK).option("mode", "FAILFAST").json(path)
    return rows.withColumn("sira", F.monotonically_increasing_id())


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14, SRC-15: (madde_id, dense, sparse, payload) points; ids without a vector fail the query."""
    rows = spark.read.parquet(path)
    return rows.filter(F.assert_true(F.col("dense").isNotNull() & F.col("sparse").isNotNull(), F.lit("a point lacks a vector")).isNull())


def gold(spark: SparkSession, gold_path: str, corpus_rows: DataFrame, n: int, seed: int = 4721) -> DataFrame:
    """SRC-16, JON-14: the first ``n`` gold queries in seeded order whose target is in force; the last corpus row of a target counts."""
    from lexforge.functions import fixed as X

    rows = spark.read.schema("ilgi STRING, kanun_no STRING, madde_no STRING").json(gold_path)
    state = corpus_rows.groupBy(F.col("metadata.kanun_no").alias("kanun_no"), F.col("metadata.madde_no").alias("madde_no")).agg(F.max_by("metadata.yurutluk", "sira").alias("yurutluk"))
    eligible = rows.join(state, ["kanun_no", "madde_no"]).filter(F.col("yurutluk") != X.REPEALED)
    return eligible.orderBy(F.md5(F.concat_ws(":", "ilgi", "kanun_no", "madde_no", F.lit(str(seed)))), "ilgi").limit(n)
