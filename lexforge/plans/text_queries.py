"""Text functions (TXT), status predicates (STA), corpus predicates (COR-01, COR-02) and tag stripping (HTM-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import fixed as X
from lexforge.functions import status as S
from lexforge.functions import text as T
from lexforge.operators import corpus, evaluation, structure

from .base import TOKENS, TR_LOWER, WORDS, catalog, frame, texts, values

C = catalog()

SAID = [(1, "İstanbul IĞDIR Şişli"), (2, "ıssız Çiğdem ÖĞÜT"), (3, "TCK’nın – 5. Maddesi"), (4, ""), (5, "Kâğıt  hîkâye"), (6, None)]
SAID_T = "id long, s string"


@C.add(f"SELECT id, {TR_LOWER.format('s')} AS low, upper(translate(s, 'iı', 'İI')) AS up FROM {values(SAID, SAID_T)}")
def tr_case(spark, sf_dir):
    """TXT-02, TXT-03."""
    return frame(spark, SAID, SAID_T).select("id", T.tr_lower(F.col("s")).alias("low"), T.tr_upper(F.col("s")).alias("up"))


@C.add(f"SELECT id, lower(translate(s, '{X.FOLD_FROM}', '{X.FOLD_TO.replace(chr(39), chr(39) * 2)}')) AS folded FROM {values(SAID, SAID_T)}")
def fold_text(spark, sf_dir):
    """TXT-06."""
    return frame(spark, SAID, SAID_T).select("id", T.fold(F.col("s")).alias("folded"))


_BREAKS = "replace(regexp_replace(replace({0}, chr(10) || chr(10), chr(1) || chr(1)), chr(1) || chr(10), chr(1) || chr(1), 'g'), chr(10), ' ')"
_DASHED = f"translate({{0}}, '{X.DASHES}{X.SOFT_HYPHEN}', '{'-' * len(X.DASHES)}')"


@C.add(
    f"SELECT doc_id, sha256(x) AS digest, length(x) AS n FROM (SELECT doc_id, trim(replace(regexp_replace({_BREAKS.format(_DASHED.format('text'))}, '[ \t]+', ' ', 'g'), chr(1), chr(10)), chr(10) || ' ') AS x FROM documents)"
)
def normalize_text(spark, sf_dir):
    """TXT-01 over whole documents."""
    x = T.normalize_text(F.col("text"))
    return texts(spark, sf_dir).select("doc_id", F.sha2(x, 256).alias("digest"), F.length(x).cast("long").alias("n"))


@C.add(
    f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_terms, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, sha256(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents)"
)
def tokenize_terms(spark, sf_dir):
    """TXT-04 over whole documents."""
    w = texts(spark, sf_dir).select("doc_id", T.tokenize(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_terms"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.sha2(F.array_join("w", " "), 256).alias("digest"))


@C.add(
    f"""SELECT doc_id, CAST(len(list_distinct({WORDS.format('text')})) AS BIGINT) AS turkish,
        CAST(len(list_distinct(regexp_extract_all(lower(text), '{X.TOKEN}'))) AS BIGINT) AS plain,
        CAST(len(list_distinct(list_transform({WORDS.format('text')}, lambda w: CASE WHEN regexp_full_match(w, '[0-9]+') THEN w ELSE left(w, 4) END))) AS BIGINT) AS stem4 FROM documents"""
)
def tokenizer_variants(spark, sf_dir):
    """TXT-05: vocabulary of a document under three tokenizers."""
    n = lambda c: F.size(F.array_distinct(c)).cast("long")
    text = F.col("text")
    return texts(spark, sf_dir).select("doc_id", n(T.tokenize(text, stem=None)).alias("turkish"), n(T.tokenize(text, "plain", None)).alias("plain"), n(T.tokenize(text, stem=4)).alias("stem4"))


NUMBERS = [(1, "Geçici 1"), (2, "0141"), (3, "123/a"), (4, "Mükerrer 298"), (5, "Ek  7"), (6, "5/B-x"), (7, "000"), (8, " 0213 "), (9, "tek madde")]
_PLAIN = "trim(regexp_replace(no, '\\s+', ' ', 'g'))"
_FORM = r"^(?:(gecici|ek|mukerrer)\s+)?0*([0-9]+)(?:\s*/\s*(\S+))?$"
_FOLDED = f"lower(translate({_PLAIN}, '{X.FOLD_FROM}', '{X.FOLD_TO.replace(chr(39), chr(39) * 2)}'))"
_UP = "upper(translate({0}, 'iı', 'İI'))"


@C.add(
    f"""SELECT id, kind, number, CASE kind WHEN 'asil' THEN number WHEN 'gecici' THEN 'Geçici ' || number WHEN 'ek' THEN 'Ek ' || number ELSE 'Mükerrer ' || number END AS label, law, slug, build_key, prefix_kind
        FROM (SELECT id, CASE WHEN regexp_matches(f, '{_FORM}') AND regexp_extract(f, '{_FORM}', 1) <> '' THEN regexp_extract(f, '{_FORM}', 1) ELSE 'asil' END AS kind,
          CASE WHEN NOT regexp_matches(f, '{_FORM}') THEN {_UP.format("replace(p, ' ', '')")} WHEN regexp_extract(f, '{_FORM}', 3) <> '' THEN regexp_extract(f, '{_FORM}', 2) || '/' || {_UP.format("regexp_extract(p, '/\\s*(\\S+)$', 1)")}
               ELSE regexp_extract(f, '{_FORM}', 2) END AS number,
          coalesce(nullif(ltrim(trim(no), '0'), ''), trim(no)) AS law, regexp_replace(translate(no, '{X.SLUG_FROM}', '{X.SLUG_TO}'), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS slug,
          regexp_replace(replace(upper(trim(no)), 'İ', 'I'), '[\\s\\-]+', '', 'g') AS build_key,
          CASE WHEN starts_with(no, 'Geçici ') THEN 'gecici' WHEN starts_with(no, 'Ek ') THEN 'ek' WHEN starts_with(no, 'Mükerrer ') THEN 'mukerrer' ELSE 'asil' END AS prefix_kind
        FROM (SELECT id, no, {_PLAIN} AS p, {_FOLDED} AS f FROM {values(NUMBERS, 'id long, no string')}))"""
)
def article_keys(spark, sf_dir):
    """TXT-07 to TXT-11, TXT-13."""
    no = F.col("no")
    key = T.article_key(no)
    return frame(spark, NUMBERS, "id long, no string").select(
        "id", key["kind"].alias("kind"), key["number"].alias("number"), T.article_label(key["kind"], key["number"]).alias("label"), T.law_number(no).alias("law"), T.slug(no).alias("slug"),
        T.build_key(no).alias("build_key"), T.article_kind(no).alias("prefix_kind"),
    )


DATES = [(1, "2001-05-06", "24394"), (2, "2016-04-07T00:00:00", " 29677 "), (3, "2025-02-30", ""), (4, "07.04.2016", None), (5, None, "  "), (6, " 1999-12-31 ", "1 mük.")]


@C.add(
    f"""SELECT id, CASE WHEN regexp_matches(trim(d), '^\\d{{4}}-\\d{{2}}-\\d{{2}}(T|$)') THEN strftime(TRY_CAST(left(trim(d), 10) AS DATE), '%Y-%m-%d') END AS day, nullif(trim(n), '') AS number
        FROM {values(DATES, 'id long, d string, n string')}"""
)
def gazette_fields(spark, sf_dir):
    """TXT-21 to TXT-23."""
    r = T.law_record(F.col("d"), F.col("n"))
    return frame(spark, DATES, "id long, d string, n string").select("id", r["resmi_gazete_tarihi"].alias("day"), r["resmi_gazete_sayisi"].alias("number"))


@C.add(
    f"""SELECT doc_id, CASE WHEN len > 0 THEN round(CAST(caps AS DOUBLE) / len, 6) END AS ratio, artefact, stratum FROM (
        SELECT doc_id, length(regexp_replace(w, '[^\\p{{L}}]', '', 'g')) AS len, length(regexp_replace(w, '[^\\p{{Lu}}]', '', 'g')) AS caps, artefact, stratum FROM (
        SELECT doc_id, regexp_replace(left(text, {X.RATIO_WINDOW}), '{X.RATIO_SKIP}', '', 'g') AS w, length(regexp_replace(text, '{X.ARTEFACT}', '', 'g')) < 3 AS artefact,
               CASE WHEN length(text) < 400 THEN 'kisa' WHEN length(text) < 1200 THEN 'orta' ELSE 'uzun' END AS stratum FROM documents))"""
)
def text_measures(spark, sf_dir):
    """TXT-28, TXT-36, COR-02."""
    text = F.col("text")
    return texts(spark, sf_dir).select("doc_id", F.round(T.upper_ratio(text), 6).alias("ratio"), corpus.is_artefact(text).alias("artefact"), T.stratum(F.length(text)).alias("stratum"))


MARKED = [(1, "Metin [1] devam  eder [12] ."), (2, "işaretsiz  metin"), (3, "[3]"), (4, "a [x] b"), (5, None)]


@C.add(f"SELECT id, CASE WHEN regexp_matches(s, '\\[\\d+\\]') THEN trim(regexp_replace(regexp_replace(s, '\\s*\\[\\d+\\]', '', 'g'), '\\s{{2,}}', ' ', 'g')) ELSE s END AS clean FROM {values(MARKED, SAID_T)}")
def strip_footnote_marks(spark, sf_dir):
    """TXT-14."""
    return frame(spark, MARKED, SAID_T).select("id", T.strip_marks(F.col("s")).alias("clean"))


@C.add(
    "SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, sha256(array_to_string(list_sort(w), ' ')) AS digest FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zçğıöşü]{4,}')) AS w FROM documents)"
)
def content_word_sets(spark, sf_dir):
    """TXT-37."""
    w = texts(spark, sf_dir).select("doc_id", T.content_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.sha2(F.array_join(F.sort_array("w"), " "), 256).alias("digest"))


LAW_NAMES = [(1, "Türk Ceza Kanunu"), (2, "Bazı Kanunlarda Değişiklik Yapılmasına Dair Kanun"), (3, "Vergi Usul Kanunu ve Ek Hükümler"), (4, None)]
_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@C.add(
    f"""SELECT id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(translate(coalesce(s, ''), '{X.FOLD_FROM}', '{X.FOLD_TO.replace(chr(39), chr(39) * 2)}')), '[a-z0-9]+'),
        lambda w: length(w) >= 3 AND w NOT IN ({_STOPS})), lambda w: left(w, 5)))), ' ') AS stems, coalesce(contains(upper(s), 'DEĞİŞİKLİK YAPILMASINA') OR contains(upper(s), 'BAZI KANUNLARDA') OR contains(upper(s), 'DEĞİŞİKLİK YAPILMASI HAKKINDA'), NULL) AS amending FROM {values(LAW_NAMES, SAID_T)}"""
)
def law_name_stems(spark, sf_dir):
    """TXT-31, TXT-33."""
    return frame(spark, LAW_NAMES, SAID_T).select("id", F.array_join(F.sort_array(T.name_stems(F.col("s"))), " ").alias("stems"), T.is_amending(F.col("s")).alias("amending"))


ASKED = [
    (1, "2918 sayılı kanunda ceza nedir", "2918", "Karayolları Trafik Kanunu"),
    (2, "5 inci madde ne der", "657", "Devlet Memurları Kanunu"),
    (3, "Devlet memurları kanunu izin", "657", "Devlet Memurları Kanunu"),
    (4, "yıllık izin kaç gündür", "4857", "İş Kanunu"),
    (5, "ek 3 uygulanır", "x", "İş Kanunu"),
    (6, "iş kanunu nedir", "4857", "İş Kanunu"),
]
_Q = TR_LOWER.format("q")
_LEAKS = " OR ".join(f"regexp_matches(q, '{p}')" for p in X.ARTICLE_LEAKS)


@C.add(
    f"""SELECT id, regexp_matches(trim(n), '^[0-9]+$') AND regexp_matches({_Q}, '\\b' || trim(n) || '\\b\\s*(sayılı|s\\.|numaralı|say)') AS by_number, ({_LEAKS}) AS by_article,
        CASE WHEN len(w) < 3 THEN contains({_Q}, low) ELSE len(list_filter(range(1, len(w) - 1), lambda i: contains({_Q}, array_to_string(w[i:i + 2], ' ')))) > 0 END AS by_name
        FROM (SELECT *, {TR_LOWER.format('name')} AS low, list_filter(regexp_split_to_array({TR_LOWER.format('name')}, '\\s+'), lambda x: length(x) > 2) AS w FROM {values(ASKED, 'id long, q string, n string, name string')})"""
)
def leakage_flags(spark, sf_dir):
    """TXT-35, GRP-04."""
    q = F.col("q")
    return frame(spark, ASKED, "id long, q string, n string, name string").select(
        "id", T.leaks_law_number(q, F.col("n")).alias("by_number"), T.leaks_article(q).alias("by_article"), T.leaks_law_name(q, F.col("name")).alias("by_name")
    )


BODIES = [
    (1, "(1) Kayıtlar tutulur."),
    (2, "(Mülga: 1/1/2010-5999/1 md.)"),
    (3, "(Mülga son cümle: 2/2/2012-6300/4 md.) Kayıtlar saklanır."),
    (4, "Kayıtlar saklanır. (Mülga: 1/1/2010-5999/1 md.) Devam eder."),
    (5, "(Değişik: 9/4/2003-4842/3 md.) (İptal: Anayasa Mahkemesi)"),
    (6, "(1) A (2) B; mülga"),
]
#: RE2 does not fold the dotted capital.
_MARK, _NOTES = (p.replace("iptal", "[iİ]ptal") for p in (X.REPEAL_MARK, X.OPENING_NOTES))
_REST = f"regexp_replace(body, '{X.PARTIAL_REPEAL}', '', 'g')"


@C.add(
    f"""SELECT id, CASE WHEN regexp_matches(r, '{_MARK}') THEN 'mülga' ELSE 'yürürlükte' END AS unit,
        CASE WHEN regexp_matches(r, '{_MARK}') AND length(regexp_split_to_array(r, '{_MARK}')[1]) < greatest(length(regexp_extract(r, '{_NOTES}')), 1) THEN 'mülga' ELSE 'yürürlükte' END AS article
        FROM (SELECT id, {_REST} AS r FROM {values(BODIES, 'id long, body string')})"""
)
def status_flags(spark, sf_dir):
    """STA-01, STA-02."""
    return frame(spark, BODIES, "id long, body string").select("id", S.status(F.col("body")).alias("unit"), S.article_status(F.col("body")).alias("article"))


NOTES = [
    (1, "(Kayıtlar yerine işlenmiştir.)"),
    (2, "4/1/2001 tarihli ve 4567 sayılı Kanun ile ilgili olup yerine işlenmiştir."),
    (3, "Kayıtlar tutulur."),
    (4, "Vergi daireleri tarafından tutulan kayıtlar mükelleflerin beyanları ile ilgili olup bu kayıtların düzenlenmesi saklanması ve ilgililere verilmesi hakkında uygulanacak usul ve esaslar Bakanlıkça çıkarılacak yönetmelikle belirlenir ve yayımlanır."),
]


@C.add(
    f"""SELECT id, regexp_matches(b, '{X.REDIRECT_NOTE}') AND NOT (NOT (starts_with(b, '(') OR regexp_matches(b, '{X.REDIRECT_PAREN}')) AND length(b) > 200 AND NOT regexp_matches(b, '{X.REDIRECT_START}')) AS moved,
        nullif(regexp_extract(b, '{X.REDIRECT_TARGET}', 1), '') AS target FROM {values(NOTES, 'id long, b string')}"""
)
def redirect_notes(spark, sf_dir):
    """COR-01, TXT-20."""
    return frame(spark, NOTES, "id long, b string").select("id", corpus.is_redirect_note(F.col("b")).alias("moved"), T.redirect_target(F.col("b")).alias("target"))


PATHS = [(1, "BİRİNCİ BÖLÜM › Madde 4", "asil", "4"), (2, "BİRİNCİ BÖLÜM › Madde 4", "gecici", "Geçici 1"), (3, None, "ek", "Ek 2"), (4, "Madde 12", "mukerrer", "Mükerrer 20")]


@C.add(
    f"""SELECT id, CASE WHEN k = 'asil' THEN p ELSE regexp_replace(p, 'Madde \\S+$', CASE k WHEN 'gecici' THEN 'Geçici' WHEN 'ek' THEN 'Ek' ELSE 'Mükerrer' END || ' Madde ' || regexp_replace(n, '^\\S+\\s+', '')) END AS path
        FROM {values(PATHS, 'id long, p string, k string, n string')}"""
)
def inherited_paths(spark, sf_dir):
    """TXT-19."""
    return frame(spark, PATHS, "id long, p string, k string, n string").select("id", T.path_of(F.col("p"), F.col("k"), F.col("n")).alias("path"))


@C.add(
    r"""SELECT page_id, sha256(x) AS digest, CAST(len(string_split(x, chr(31))) AS BIGINT) AS n_blocks FROM (SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(31)),
        lambda b: array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10))), lambda b: b <> ''), chr(31)) AS x FROM (
        SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</?(?:p|div|li)\b[^>]*>', chr(31), 'g'), '<[^>]+>', '', 'g'),
        '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '&amp', '&') AS t FROM pages))"""
)
def html_strip(spark, sf_dir):
    """HTM-01 over whole pages."""
    x = texts(spark, sf_dir, "pages").select("page_id", structure.strip_page("html").alias("x"))
    return x.select("page_id", F.sha2("x", 256).alias("digest"), F.size(F.split("x", X.PARAGRAPH)).cast("long").alias("n_blocks"))


@C.add(
    "SELECT lang, mark, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, unnest(['sira_N_nokta', 'fikra_paren', 'Madde_N_tire']) AS mark, unnest([len(regexp_extract_all(text, '(?m)^\\s*\\d+\\.\\s+[A-ZÇĞİÖŞÜ]')), len(regexp_extract_all(text, '\\(\\d+\\)\\s')), len(regexp_extract_all(text, '\\bMadde\\s+\\d+\\s*[-–—]'))]) AS n FROM documents) GROUP BY ALL"
)
def structure_survey(spark, sf_dir):
    """GRP-03: headings of three kinds by language."""
    marks = texts(spark, sf_dir).select("lang", F.explode(evaluation.structure_marks(F.col("text"))).alias("mark", "n"))
    return marks.filter(F.col("mark").isin("sira_N_nokta", "fikra_paren", "Madde_N_tire")).groupBy("lang", "mark").agg(F.sum("n").cast("long").alias("n"))
