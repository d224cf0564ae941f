"""Parsing kernels as Arrow functions and table functions, and the tables they make (SPL, HTM, FIK, TEB, BLD)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge import schema as Z
from lexforge.functions import text as X

from . import kernels as K


def arrow(function, returns: T.DataType):
    """A kernel over one string as a column function; null stays null."""
    return F.udf(lambda *a: None if a[0] is None else function(*a), returns, useArrow=True)


def pairs(rows: list[tuple], *names: str) -> list[dict]:
    return [dict(zip(names, r)) for r in rows]


STRINGS = T.ArrayType(Z.S)
strip_html = arrow(K.strip_html, Z.S)
strip_page = arrow(K.strip_page, Z.S)
articles = arrow(lambda t: pairs(K.split_articles(t), "no", "body"), T.ArrayType(Z.ARTICLE))
paragraphs = arrow(K.paragraphs, T.ArrayType(Z.PARAGRAPH))
amendments = arrow(K.amendments, T.ArrayType(Z.AMENDMENT))
footnote_appendix = arrow(
    lambda t: (lambda r: {"body": r[0], "notes": pairs(r[1], "no", "text")})(K.footnote_appendix(t)), Z.row("body", ("notes", T.ArrayType(Z.FOOTNOTE)))
)
merged_ranges = arrow(lambda t: sorted(K.merged_ranges(t)), STRINGS)
html_articles = arrow(lambda h: pairs(list(K.html_articles(h).items()), "no", "html"), T.ArrayType(Z.row("no", "html")))
html_tables = arrow(lambda h: pairs(list(K.html_tables(h).items()), "no", "tables"), T.ArrayType(Z.row("no", ("tables", STRINGS))))
html_footnotes = arrow(
    lambda h: [{"no": no, "notes": pairs(n, "no", "text")} for no, n in K.html_footnotes(h).items()], T.ArrayType(Z.row("no", ("notes", T.ArrayType(Z.FOOTNOTE))))
)
tree_events = arrow(K.tree_from_json, T.ArrayType(Z.TREE_EVENT))
tree_text_events = arrow(K.parse_tree, T.ArrayType(Z.TREE_EVENT))
tree_as_text = arrow(lambda j: K.tree_text(K.json.loads(j)), Z.S)
units = arrow(K.communique_units, T.ArrayType(Z.UNIT))
drop_annex = arrow(K.drop_annex, Z.S)
drop_leaks = arrow(lambda body, levels, titles, law: K.drop_leaks(body, list(levels or []), list(titles or []), law), Z.S)
drop_law_end = arrow(K.drop_law_end, Z.S)


def split_paragraphs(c: Column) -> Column:
    """SPL-03 (native): the plain split before ``(n) ``."""
    return F.filter(F.transform(F.split(X.strip(c), rf"(?=\(\d+\)[{X.SPACE}])"), X.strip), lambda p: p != "")


def drop_leading_redirect(c: Column) -> Column:
    """BLD-09 (native)."""
    from lexforge.functions import fixed

    return X.strip(X.drop(c, fixed.LEADING_REDIRECT))


def article_table(laws: DataFrame) -> DataFrame:
    """Articles (mevzuat_id, ord, no, body) of ``laws`` (mevzuat_id, html)."""
    text = X.normalize_text(strip_html("html"))
    return laws.select("mevzuat_id", F.posexplode(articles(text)).alias("ord", "a")).select("mevzuat_id", "ord", "a.*")


def tree_table(laws: DataFrame) -> DataFrame:
    """Hierarchy events (mevzuat_id, seq and the fields of an event) of ``laws`` (mevzuat_id, tree)."""
    return laws.select("mevzuat_id", F.posexplode(tree_events("tree")).alias("seq", "e")).select("mevzuat_id", "seq", "e.*")


def exploded_tree(chunks: DataFrame) -> DataFrame:
    """FIK-07 (native): a row for each paragraph, clause and sub-clause of ``chunks`` (id, fikralar), with its path of positions."""
    p = chunks.select("id", F.posexplode("fikralar").alias("i", "p"))
    c = p.select("id", "i", F.posexplode("p.bentler").alias("j", "c"))
    s = c.select("id", "i", "j", F.posexplode("c.alt_bentler").alias("k", "s"))
    none = F.lit(None).cast("int")
    row = lambda level, mark, x, j, k: ("id", F.lit(level).alias("level"), F.col("i"), j.alias("j"), k.alias("k"), F.col(mark).alias("mark"), F.col(f"{x}.text").alias("text"), F.col(f"{x}.yurutluk").alias("yurutluk"))
    return (
        p.select(*row("fikra", "p.no", "p", none, none))
        .unionByName(c.select(*row("bent", "c.isaret", "c", F.col("j"), none)))
        .unionByName(s.select(*row("alt_bent", "s.isaret", "s", F.col("j"), F.col("k"))))
    )


@F.udtf(returnType=T.StructType([T.StructField("ord", T.IntegerType()), *Z.ARTICLE.fields]))
class SplitArticles:
    """SELECT * FROM split_articles(text)."""

    def eval(self, text: str):
        for i, (no, body) in enumerate(K.split_articles(text or "")):
            yield i, no, body


@F.udtf(returnType=T.StructType([T.StructField("ord", T.IntegerType()), *Z.PARAGRAPH.fields]))
class SplitParagraphs:
    """SELECT * FROM split_paragraphs(body)."""

    def eval(self, body: str):
        for i, p in enumerate(K.paragraphs(body or "")):
            yield i, p["no"], p["text"], p["bentler"], p["yurutluk"]


def register(spark: SparkSession) -> None:
    """Make the functions available to SQL under the names used here."""
    for name, function in {
        "strip_html": strip_html, "articles": articles, "paragraphs": paragraphs, "amendments": amendments, "merged_ranges": merged_ranges, "communique_units": units,
    }.items():
        spark.udf.register(name, function)
    spark.udtf.register("split_articles", SplitArticles)
    spark.udtf.register("split_paragraphs", SplitParagraphs)
