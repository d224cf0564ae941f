"""Parsing (SPL, HTM, BLD, FIK, TEB), corpus build (COR) and citations (CIT, RES, MOD) on literal texts.

The common tables hold no statutes, so inputs are literals here and the SQL lists the rows that the rules demand, written out by hand.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import corpus as B
from lexforge.operators import evaluation as E
from lexforge.operators import resolve as R
from lexforge.operators import structure as S

from .base import catalog, expected, frame

C = catalog()
MARK = "\x1f"

STATUTES = [
    (1, "Amaç MADDE 1- (1) Bu Kanunun amacı kayıttır. Kapsam ve istisnalar: MADDE 2- Kayıtlar tutulur. Geçici Madde 1- Eski kayıtlar geçerlidir. MADDE 3 - Bu Kanun hükümlerini Cumhurbaşkanı yürütür."),
    (2, "MADDE 428 İşyerinin devri sonuçları. Madde 7 hükmü uygulanır. MADDE 15[14] - Gümrük kaydı. İKİNCİ BÖLÜM Ceza Hükümleri MADDE 16/A- Ceza verilir. EK MADDE 2- Ek hüküm."),
    (3, "MADDE 131- (1) Yönetim şartları belirlenir. Üyelerin seçilme şartlarıMADDE 132-(1) Üyeler seçilir. MADDE 133- Son hüküm."),
    (4, "MADDE 5- Bu Kanun hükümlerini Bakanlar Kurulu yürütür. (I) SAYILI CETVEL Kadro unvanı ve sayısı aşağıda gösterilmiştir"),
    (5, "MADDE 1- Hüküm. 1/1/1990 tarihli ve 3600 sayılı Kanuna işlenemeyen hükümler MADDE 9- Ek metin."),
    (6, "Maddesiz metin."),
]
STATUTE_T = "id long, s string"
ARTICLES = [
    (1, 0, "1", "(1) Bu Kanunun amacı kayıttır."), (1, 1, "2", "Kayıtlar tutulur."), (1, 2, "Geçici 1", "Eski kayıtlar geçerlidir."), (1, 3, "3", "Bu Kanun hükümlerini Cumhurbaşkanı yürütür."),
    (2, 0, "428", "İşyerinin devri sonuçları. Madde 7 hükmü uygulanır."), (2, 1, "15", "Gümrük kaydı."), (2, 2, "16/A", "Ceza verilir."), (2, 3, "Ek 2", "Ek hüküm."),
    (3, 0, "131", "(1) Yönetim şartları belirlenir."), (3, 1, "132", "(1) Üyeler seçilir."), (3, 2, "133", "Son hüküm."),
    (4, 0, "5", "Bu Kanun hükümlerini Bakanlar Kurulu yürütür."), (5, 0, "1", "Hüküm."),
]


@C.add(expected(ARTICLES, "id long, ord int, no string, body string"))
def split_articles(spark, sf_dir):
    """SPL-01, SPL-02, BLD-01 to BLD-04, WIN-03."""
    rows = frame(spark, STATUTES, STATUTE_T).select("id", F.posexplode(S.articles("s")).alias("ord", "a"))
    return rows.select("id", "ord", "a.no", "a.body")


PROVISIONS = [
    (1, "(1) Kayıtlar tutulur. (2) Şunlar aranır: a) Dilekçe, b) Kimlik. (3) Beşinci fıkranın (2) numaralı bendi saklıdır."),
    (2, f"Kayıtlar şunlardır:{MARK}a) Doğum,{MARK}b) Ölüm.{MARK}Bu Kanunda yazılı süreler uygulanır."),
    (3, "(1) Gelirler: 1. Kira. a) Konut, b) İşyeri. 2. Faiz."),
    (4, "Esaslar: a) Birinci: 1) Alt bir. 2) Alt iki. b) (Mülga: 1/1/2010-5999/1 md.)"),
    (5, "(1) Tarife uygulanır. (2) SAYILI LİSTE 1. Et 2. Süt"),
    (6, "Hüküm: а) Kiril işaretli, b) Latin."),
    (7, ""),
]
TREE = [
    (1, "fikra", 0, None, None, "(1)", "(1) Kayıtlar tutulur.", "yürürlükte"),
    (1, "fikra", 1, None, None, "(2)", "(2) Şunlar aranır: a) Dilekçe, b) Kimlik.", "yürürlükte"), (1, "bent", 1, 0, None, "a)", "a) Dilekçe,", "yürürlükte"), (1, "bent", 1, 1, None, "b)", "b) Kimlik.", "yürürlükte"),
    (1, "fikra", 2, None, None, "(3)", "(3) Beşinci fıkranın (2) numaralı bendi saklıdır.", "yürürlükte"),
    (2, "fikra", 0, None, None, "(1)", "Kayıtlar şunlardır: a) Doğum, b) Ölüm.", "yürürlükte"), (2, "bent", 0, 0, None, "a)", "a) Doğum,", "yürürlükte"), (2, "bent", 0, 1, None, "b)", "b) Ölüm.", "yürürlükte"),
    (2, "fikra", 1, None, None, "(2)", "Bu Kanunda yazılı süreler uygulanır.", "yürürlükte"),
    (3, "fikra", 0, None, None, "(1)", "(1) Gelirler: 1. Kira. a) Konut, b) İşyeri. 2. Faiz.", "yürürlükte"), (3, "bent", 0, 0, None, "1.", "1. Kira. a) Konut, b) İşyeri.", "yürürlükte"),
    (3, "alt_bent", 0, 0, 0, "a)", "a) Konut,", "yürürlükte"), (3, "alt_bent", 0, 0, 1, "b)", "b) İşyeri.", "yürürlükte"), (3, "bent", 0, 1, None, "2.", "2. Faiz.", "yürürlükte"),
    (4, "fikra", 0, None, None, None, "Esaslar: a) Birinci: 1) Alt bir. 2) Alt iki. b) (Mülga: 1/1/2010-5999/1 md.)", "yürürlükte"),
    (4, "bent", 0, 0, None, "a)", "a) Birinci: 1) Alt bir. 2) Alt iki.", "yürürlükte"), (4, "alt_bent", 0, 0, 0, "1)", "1) Alt bir.", "yürürlükte"), (4, "alt_bent", 0, 0, 1, "2)", "2) Alt iki.", "yürürlükte"),
    (4, "bent", 0, 1, None, "b)", "b) (Mülga: 1/1/2010-5999/1 md.)", "mülga"),
    (5, "fikra", 0, None, None, "(1)", "(1) Tarife uygulanır. (2) SAYILI LİSTE 1. Et 2. Süt", "yürürlükte"),
    (6, "fikra", 0, None, None, None, "Hüküm: a) Kiril işaretli, b) Latin.", "yürürlükte"), (6, "bent", 0, 0, None, "a)", "a) Kiril işaretli,", "yürürlükte"), (6, "bent", 0, 1, None, "b)", "b) Latin.", "yürürlükte"),
]


@C.add(expected(TREE, "id long, level string, i int, j int, k int, mark string, text string, yurutluk string"))
def paragraph_tree(spark, sf_dir):
    """FIK-01 to FIK-05, FIK-07, STA-01, STA-04, TXT-26, WIN-07."""
    return S.exploded_tree(frame(spark, PROVISIONS, STATUTE_T).select("id", S.paragraphs("s").alias("fikralar")))


CLOSING = [(1, "Aşağıdakiler muaftır: a) Dernekler, b) Vakıflar, c) Kooperatifler. Bunlar hakkında beyanname verilmez."), (2, "Şunlar: a) Uzun bir cümle. Devam eder, b) Kısa. Bunlar ayrıdır.")]


@C.add(expected([(1, "c) Kooperatifler."), (2, "b) Kısa. Bunlar ayrıdır.")], "id long, last string"))
def closing_sentence(spark, sf_dir):
    """FIK-06: the closing sentence leaves the last clause only under the narrow signature."""
    tree = frame(spark, CLOSING, STATUTE_T).select("id", S.paragraphs("s")[0]["bentler"].alias("b"))
    return tree.select("id", F.element_at("b", -1)["text"].alias("last"))


@C.add(expected([(1, 0, "(1) Bir."), (1, 1, "(2) İki (3 kez)."), (2, 0, "Tek.")], "id long, i int, part string"))
def plain_paragraphs(spark, sf_dir):
    """SPL-03."""
    rows = [(1, "(1) Bir. (2) İki (3 kez)."), (2, " Tek. ")]
    return frame(spark, rows, STATUTE_T).select("id", F.posexplode(S.split_paragraphs(F.col("s"))).alias("i", "part"))


NOTED = [
    (1, "(Değişik birinci fıkra: 9/4/2003-4842/3 md.) Metin. (Mülga: 1/1/2010-5999/12 md.)"),
    (2, "(İptal: Anayasa Mahkemesinin kararı) (Ek: Anayasa Mahkemesi E. 2)"),
    (3, "Notsuz metin."),
]


@C.add(
    expected(
        [(1, 0, "degisik", "2003-04-09", "4842", "3", "birinci fıkra", "Metin."), (1, 1, "mulga", "2010-01-01", "5999", "12", None, "Metin."), (2, 0, "iptal", None, None, None, None, ""), (2, 1, "iptal", None, None, None, None, "")],
        "id long, i int, tip string, tarih string, kanun_no string, madde string, kapsam string, clean string",
    )
)
def amendments(spark, sf_dir):
    """SPL-06, TXT-24, TXT-25."""
    rows = frame(spark, NOTED, STATUTE_T).select("id", T.strip_amendments(F.col("s")).alias("clean"), F.posexplode(S.amendments("s")).alias("i", "a"))
    return rows.select("id", "i", "a.tip", "a.tarih", "a.kanun_no", "a.madde", "a.kapsam", "clean")


FOOTED = [(1, "Kayıtlar [2] tutulur. [1] Birinci not. [2] İkinci not. [3] Üçüncü not."), (2, "Kayıt [1] ve [2] saklanır."), (3, "[1] A. [2] B. " + "x" * 500)]


@C.add(
    expected(
        [(1, "Kayıtlar [2] tutulur.", "1:Birinci not.|2:İkinci not.|3:Üçüncü not.", "2:İkinci not."), (2, "Kayıt [1] ve [2] saklanır.", "", ""), (3, FOOTED[2][1], "", "")],
        "id long, body string, notes string, linked string",
    )
)
def footnote_appendix(spark, sf_dir):
    """SPL-05, JON-04."""
    r = frame(spark, FOOTED, STATUTE_T).withColumn("f", S.footnote_appendix("s"))
    said = lambda c: F.array_join(F.transform(c, lambda n: F.concat_ws(":", n["no"].cast("string"), n["text"])), "|")
    marks = F.array_distinct(F.transform(F.regexp_extract_all("f.body", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.cast("int")))
    used = F.flatten(F.transform(marks, lambda m: F.filter("f.notes", lambda n: n["no"] == m)))
    return r.select("id", "f.body", said("f.notes").alias("notes"), said(used).alias("linked"))


RANGED = [(1, "MADDE 1 ilâ 3 - İşlenmiştir."), (2, "MADDE 9- 11- 12 - (işlenmiştir) MADDE 5 ve 6- Metin"), (3, "MADDE 4 - Metin")]


@C.add(expected([(1, "1,2,3"), (2, "11,12,5,6,9")], "id long, numbers string"))
def merged_ranges(spark, sf_dir):
    """SPL-04."""
    return frame(spark, RANGED, STATUTE_T).select("id", F.array_join(S.merged_ranges("s"), ",").alias("numbers")).filter("numbers <> ''")


@C.add(expected([(1, "Metin burada."), (2, "Metin burada uzunca yer alır. Yürürlük maddesi önemlidir."), (3, "Hüküm."), (4, "Hüküm. Diğer hükümler"), (5, "Son söz.")], "id long, body string"))
def leak_trimming(spark, sf_dir):
    """BLD-06 to BLD-09."""
    rows = [
        (1, "Metin burada. İKİNCİ BÖLÜM Ceza Hükümleri", ["İKİNCİ BÖLÜM"], [], "1"),
        (2, "Metin burada uzunca yer alır. Yürürlük maddesi önemlidir. Yürürlük", [], ["Yürürlük"], "1"),
        (3, "Hüküm. Diğer hükümler", [], [], "1"),
        (4, "Hüküm. Diğer hükümler", [], [], "4721"),
        (5, "11- (1/1/1990 tarihli ve 5 sayılı Kanuna işlenmiştir) Son söz. IV.", [], [], "1"),
    ]
    r = spark.createDataFrame(rows, "id long, s string, levels array<string>, titles array<string>, law string")
    return r.select("id", S.drop_leading_redirect(S.drop_leaks("s", "levels", "titles", "law")).alias("body"))


PAGE = (
    '<p>MADDE 1 – Vergi<a href="#_ftn1" name="_ftnref1">[1]</a> alınır.</p><table><tr><td>Oran</td><td>Gelir&nbsp;TL</td></tr><tr><td>%15</td></tr></table>'
    "<p>Madde 2<b> </b>- Kayıt.</p><table><tr><th>Değiştiren Kanun</th></tr></table><p>madde 1 hükmü saklıdır.</p>"
    '<p>MADDE 1 – Tekrar<a name="_ftnref2">[2]</a>.</p><div><a href="#_ftnref1" name="_ftn1">[1]</a> Birinci &amp; not.</div><div><a href="#_ftnref2" name="_ftn2">[2]</a> [2] İkinci not.</div>'
)


@C.add(expected([("html", "1", "MADDE 1 – Tekrar"), ("html", "2", "Madde 2"), ("note", "1", "2:İkinci not.")], "kind string, no string, said string"))
def html_articles(spark, sf_dir):
    """HTM-02, HTM-06: of equal numbers the last fragment counts."""
    p = frame(spark, [(1, PAGE)], STATUTE_T)
    parts = p.select(F.explode(S.html_articles("s")).alias("x")).select(F.lit("html").alias("kind"), "x.no", F.split("x.html", "<")[0].alias("said"))
    notes = p.select(F.explode(S.html_footnotes("s")).alias("x")).select(F.lit("note").alias("kind"), "x.no", F.explode("x.notes").alias("n")).select("kind", "no", F.concat_ws(":", F.col("n.no").cast("string"), "n.text").alias("said"))
    return parts.unionByName(notes)


@C.add(expected([("3", "| Oran | Gelir TL |\n| --- | --- |\n| %15 |  |", "Oran Gelir TL %15")], "no string, markdown string, plain string"))
def html_tables(spark, sf_dir):
    """HTM-03 to HTM-05, TXT-16."""
    page = PAGE.replace("MADDE 1 – Vergi", "MADDE 3 – Vergi")
    t = frame(spark, [(1, page)], STATUTE_T).select(F.explode(S.html_tables("s")).alias("x")).select("x.no", F.explode("x.tables").alias("markdown"))
    return t.select("no", "markdown", T.table_plain(F.col("markdown")).alias("plain"))


API_TREE = [
    {"title": "BAŞLANGIÇ KISIM", "maddeBaslik": "BAŞLANGIÇ KISIM", "maddeId": 9, "children": [
        {"maddeNo": 1, "maddeBaslik": "Madde No: 1 - Amaç:", "maddeId": 10},
        {"title": "BİRİNCİ KİTAP", "maddeBaslik": "BİRİNCİ KİTAP - Kişiler", "maddeId": 11, "children": [
            {"title": "İKİNCİ AYRIM", "maddeBaslik": "İKİNCİ AYRIM", "maddeId": 12, "children": [{"maddeNo": "2", "maddeId": 13}]},
            {"title": "Not", "maddeBaslik": "Not", "maddeId": 14, "children": [{"maddeNo": "3", "maddeBaslik": "Ad", "maddeId": 15}]}]}]},
]
TREE_ROWS = [
    (0, "level", "BAŞLANGIÇ KISIM", None, None, None, None, None, None, None), (1, "madde", None, None, "1", "Amaç", None, None, None, "BAŞLANGIÇ KISIM › Madde 1"),
    (2, "level", "BİRİNCİ KİTAP", "Kişiler", None, None, None, None, None, None), (3, "level", "İKİNCİ AYRIM", None, None, None, None, None, None, None),
    (4, "madde", None, None, "2", None, "BİRİNCİ KİTAP", "Kişiler", "İKİNCİ AYRIM", "BİRİNCİ KİTAP - Kişiler › İKİNCİ AYRIM › Madde 2"),
    (5, "madde", None, None, "3", "Ad", "BİRİNCİ KİTAP", "Kişiler", "İKİNCİ AYRIM", "BİRİNCİ KİTAP - Kişiler › İKİNCİ AYRIM › Madde 3"),
]


@C.add(expected(TREE_ROWS, "seq int, kind string, label string, title string, no string, baslik string, kitap_no string, kitap_baslik string, ayirim_no string, hiyerarsi_yolu string"))
def tree_parse(spark, sf_dir):
    """SPL-07, SPL-08, SRC-06, TXT-27: the opening part and a first book are siblings whatever the nesting; only levels end levels."""
    t = frame(spark, [("7", json.dumps(API_TREE))], "mevzuat_id string, tree string")
    return S.tree_table(t).select("seq", "kind", "label", "title", "no", "baslik", "kitap_no", "kitap_baslik", "ayirim_no", "hiyerarsi_yolu")


@C.add("SELECT CAST(3 AS BIGINT) AS counted, CAST(3 AS BIGINT) AS distinct_numbers")
def tree_article_set(spark, sf_dir):
    """SPL-09, TXT-40."""
    t = frame(spark, [("7", json.dumps(API_TREE))], "mevzuat_id string, tree string")
    counted = t.select(T.tree_articles(S.tree_as_text("tree")).cast("long").alias("counted"), F.lit(1).alias("k"))
    return counted.join(S.tree_table(t).filter("kind = 'madde'").agg(F.count_distinct("no").alias("distinct_numbers"), F.lit(1).alias("k")), "k").drop("k")


LONG = "Metin cümlesi uzundur ve bölümün gövdesini doldurur. " * 6
COMMUNIQUES = [
    (1, "MADDE 1- Amaç metni. MADDE 2- Bu Tebliğ hükümlerini Hazine ve Maliye Bakanı yürütür. EK-1 BİLDİRİM FORMU VE EKLERİ LİSTESİ"),
    (2, MARK.join([f"I- AMAÇ{MARK}{LONG}", f"II- KAPSAM{MARK}1- Konu{MARK}{LONG}", f"2- Oran{MARK}{LONG}"])),
    (3, MARK.join([f"1. Genel{MARK}{LONG}", f"2. Usul{MARK}Kısa giriş.", f"2.1. Başvuru{MARK}{LONG}", f"2.2. İnceleme{MARK}{LONG}"])),
    (4, "Bölümsüz düz metin."),
]
UNITS = [(1, "1", "madde", None, ""), (1, "2", "madde", None, ""), (2, "I", "bolum", "AMAÇ", ""), (2, "1", "bolum", "Konu", "II"), (2, "2", "bolum", "Oran", "II"), (3, "1", "bolum", "Genel", ""), (3, "2.1", "bolum", "Başvuru", "2"), (3, "2.2", "bolum", "İnceleme", "2")]


@C.add(expected(UNITS, "id long, no string, tip string, baslik string, ust string"))
def communique_units(spark, sf_dir):
    """TEB-01 to TEB-06, BLD-10, D22."""
    u = frame(spark, COMMUNIQUES, STATUTE_T).select("id", F.explode(S.units("s")).alias("u"))
    return u.select("id", "u.no", "u.tip", "u.baslik", F.array_join(F.transform("u.ust", lambda x: x["no"]), "/").alias("ust"))


LAW_HTML = (
    "<div><p>ÖRNEK KANUNU</p><p>MADDE 1 – (1) Bu Kanunun amacı kayıtları düzenlemektir. [1]</p><p>(2) Bu Kanun şunları kapsar: a) bir, b) iki.</p>"
    "<p>MADDE 2 – (Değişik: 9/4/2003-4842/3 md.) Kayıtlar tutulur.</p><p>Kayıtlar saklanır.</p><p>MADDE 3 – (4/1/2001 tarihli ve 4567 sayılı Kanun ile ilgili olup yerine işlenmiştir.)</p>"
    "<p>GEÇİCİ MADDE 1 – Eski kayıtlar bir yıl geçerlidir.</p><p>Geçici Madde 1 – İkinci geçici hüküm.</p><p>MADDE 4 – (Mülga: 1/1/2010-5999/1 md.)</p><p>MADDE 5 – Bu Kanun hükümlerini Cumhurbaşkanı yürütür.</p></div>"
)
LAW_TREE = [
    {"title": "BİRİNCİ BÖLÜM", "maddeBaslik": "BİRİNCİ BÖLÜM - Genel Hükümler", "maddeId": 1, "children": [{"maddeNo": "1", "maddeBaslik": "Amaç ve kapsam", "maddeId": 2}, {"maddeNo": "2", "maddeBaslik": "Kayıtlar", "maddeId": 3}]},
    {"title": "İKİNCİ BÖLÜM", "maddeBaslik": "İKİNCİ BÖLÜM - Son Hükümler", "maddeId": 4, "children": [{"maddeNo": "3", "maddeId": 5}, {"maddeNo": "4", "maddeId": 6}, {"maddeNo": "5", "maddeBaslik": "Yürütme", "maddeId": 7}]},
]
FIRST, SECOND = "BİRİNCİ BÖLÜM - Genel Hükümler › ", "İKİNCİ BÖLÜM - Son Hükümler › "
CHUNKS = [
    ("100-1", "Amaç ve kapsam\n(1) Bu Kanunun amacı kayıtları düzenlemektir. (2) Bu Kanun şunları kapsar: a) bir, b) iki.", "asil", "yürürlükte", f"{FIRST}Madde 1", 2, None),
    ("100-2", "Kayıtlar\nKayıtlar tutulur. Kayıtlar saklanır.", "asil", "yürürlükte", f"{FIRST}Madde 2", 2, None),
    ("100-3", "", "islenmistir_yonlendirme", "yürürlükte", f"{SECOND}Madde 3", 0, "4567"),
    ("100-Gecici1-1", "Eski kayıtlar bir yıl geçerlidir.", "gecici", "yürürlükte", f"{SECOND}Geçici Madde 1", 1, None),
    ("100-Gecici1-2", "İkinci geçici hüküm.", "gecici", "yürürlükte", f"{SECOND}Geçici Madde 1", 1, None),
    ("100-4", "(Mülga: 1/1/2010-5999/1 md.)", "asil", "mülga", f"{SECOND}Madde 4", 1, None),
    ("100-5", "Yürütme\nBu Kanun hükümlerini Cumhurbaşkanı yürütür.", "asil", "yürürlükte", f"{SECOND}Madde 5", 1, None),
]


def build(spark):
    laws = frame(spark, [("100", "1234", "Örnek Kanunu", LAW_HTML, json.dumps(LAW_TREE))], "mevzuat_id string, kanun_no string, kanun_ad string, html string, tree string").coalesce(1)  # one law: more tasks would only start workers
    records = frame(spark, [("100", "2001-05-06", "24000")], "mevzuat_id string, resmi_gazete_tarihi string, resmi_gazete_sayisi string")
    cited = frame(spark, [("01234", "3"), ("1234", "1")], "kanun_no string, madde_no string")
    return B.build_corpus(laws, records, cited)


@C.add(expected(CHUNKS, "id string, text string, madde_tipi string, yurutluk string, yol string, n int, hedef string"))
def corpus_build(spark, sf_dir):
    """COR-03 to COR-07, JON-01 to JON-06, WIN-01, WIN-02, STA-03, TXT-14 to TXT-20, BLD-05 to BLD-09."""
    return build(spark).select(
        "id", "text", "metadata.madde_tipi", "metadata.yurutluk", F.col("metadata.hiyerarsi_yolu").alias("yol"), F.size("metadata.fikralar").alias("n"), F.col("metadata.tasindigi_kanun").alias("hedef")
    )


@C.add(expected([("100-1", "1234", "Örnek Kanunu", "1", "2001-05-06", "24000")], "madde_id string, kanun_no string, kanun_ad string, madde_no string, resmi_gazete_tarihi string, resmi_gazete_sayisi string"))
def corpus_payload(spark, sf_dir):
    """COR-08, COR-09, JON-05."""
    p = B.in_force(B.payload(build(spark))).filter("madde_id = '100-1'")
    return p.select("madde_id", "kanun_no", "kanun_ad", "madde_no", "resmi_gazete_tarihi", "resmi_gazete_sayisi")


@C.add(expected([(7, 6, 1, 0, 0, 1, 8, 2)], "rows long, in_force long, repealed long, with_empty_clause long, with_broken_letters long, without_paragraphs long, paragraphs long, clauses long"))
def corpus_health(spark, sf_dir):
    """GRP-01."""
    h = E.health(build(spark))
    return h.select(*[F.col(c).cast("long") for c in ("rows", "in_force", "repealed", "with_empty_clause", "with_broken_letters", "without_paragraphs", "paragraphs", "clauses")])


@C.add(expected([("100-1", "same", False), ("100-2", "changed", False), ("100-3", "same", False), ("100-4", "changed", True), ("100-5", "removed", None), ("100-Gecici1-1", "same", False), ("100-Gecici1-2", "same", False), ("100-9", "added", None)], "id string, state string, flip boolean"))
def corpus_versions(spark, sf_dir):
    """GRP-02, JON-12: ignored fields do not count as changes."""
    old = build(spark)
    m = F.col("metadata")
    new = old.filter("id <> '100-5'").withColumn("text", F.when(F.col("id") == "100-2", "Yeni.").otherwise(F.col("text")))
    new = new.withColumn("metadata", m.withField("yurutluk", F.when(F.col("id") == "100-4", "yürürlükte").otherwise(m["yurutluk"])).withField("mevzuat_tur", F.lit("X")))
    new = new.unionByName(old.filter("id = '100-5'").withColumn("id", F.lit("100-9")))
    return E.corpus_diff(old, new, ("mevzuat_tur",)).select("id", "state", "flip")


HEALTH = [(1, "a) Bir, b) İki, b) Dört"), (2, "a) Bir, f) Altı"), (3, "a) Bir, b) İki"), (4, "a) b) İki")]


@C.add(expected([(1, True, False), (2, True, False), (3, False, False), (4, False, True)], "id long, broken boolean, empty boolean"))
def clause_checks(spark, sf_dir):
    """GRP-01: letters out of order and clauses without text."""
    t = frame(spark, HEALTH, STATUTE_T).select("id", S.paragraphs("s")[0]["bentler"].alias("b"))
    return t.select("id", E.letters_broken(F.col("b")).alias("broken"), F.exists("b", lambda c: E.clause_is_empty(c["text"])).alias("empty"))


ASKED = [
    (1, "TCK m. 141/2-a"), (2, "5237 sayılı Türk Ceza Kanununun 141. maddesinin ikinci fıkrasının (b) bendi"), (3, "VUK 359/a"), (4, "TCK 166/I"), (5, "375 sayılı KHK ek 9. madde"), (6, "eski TCK m. 491"),
    (7, "Anayasanın 10. maddesi son fıkra"), (8, "TCK'nın 6545 sayılı Kanunla değişik 141. maddesi"), (9, "TCK 2 yıl hapis"), (10, "geçici 3. madde 193 sayılı Kanun"), (11, "izin süresi kaç gün"), (12, "TCK'nın 141 ve 142. maddeleri"),
]
PARSED = [
    (1, 0, "5237", "asil", "141", 2, "a", 1, "kisaltma"), (2, 0, "5237", "asil", "141", 2, "b", 1, "numara"), (3, 0, "213", "asil", "359/A", None, None, 2, "kisaltma"), (4, 0, "5237", "asil", "166/I", None, None, 3, "kisaltma"),
    (7, 0, "2709", "asil", "10", -1, None, 1, "ad"), (8, 0, "5237", "asil", "141", None, None, 1, "kisaltma"), (10, 0, "193", "gecici", "3", None, None, 1, "numara"),
    (12, 0, "5237", "asil", "141", None, None, 1, "kisaltma"), (12, 1, "5237", "asil", "142", None, None, 1, "kisaltma"),
]


@C.add(expected(PARSED, "query_id long, i int, law string, kind string, number string, fikra int, bent string, readings int, source string"))
def citation_parse(spark, sf_dir):
    """CIT-01 to CIT-13, TXT-06, TXT-07."""
    p = R.parse_queries(frame(spark, ASKED, "query_id long, text string")).select("query_id", F.posexplode("parsed.atiflar").alias("i", "a"))
    y = F.col("a.yorumlar")[0]
    return p.select(
        "query_id", "i", F.array_join("a.kanun_nolari", "/").alias("law"), y["madde_tipi"].alias("kind"), y["madde_numara"].alias("number"), y["fikra"].alias("fikra"), y["bent"].alias("bent"), F.size("a.yorumlar").alias("readings"), F.col("a.kanun_kaynak").alias("source")
    )


@C.add(expected([(5, "other_document"), (6, "qualified_law"), (9, "law_only"), (11, "nothing")], "query_id long, why string"))
def citation_diagnosis(spark, sf_dir):
    """CIT-14."""
    p = R.parse_queries(frame(spark, ASKED, "query_id long, text string")).filter(F.size("parsed.atiflar") == 0)
    return p.select("query_id", F.split("parsed.tani", ":")[0].alias("why"))


@C.add(expected([("5237 s. K. m. 141 f. 2 b. a",), ("2709 s. K. m. 10 son f.",), ("193 s. K. m. Geçici 3",)], "label string"))
def citation_labels(spark, sf_dir):
    """TXT-39, TXT-09."""
    p = R.parse_queries(frame(spark, [ASKED[0], ASKED[6], ASKED[9]], "query_id long, text string")).select(F.explode("parsed.atiflar").alias("a"))
    y = F.col("a.yorumlar")[0]
    return p.select(T.citation_label(F.col("a.kanun_nolari"), T.article_label(y["madde_tipi"], y["madde_numara"]), y["fikra"], y["bent"]).alias("label"))


def p_(no, text, *marks):
    return {"no": no, "text": text, "bentler": [{"isaret": m, "text": f"{m} {m}metin", "yurutluk": "yürürlükte", "alt_bentler": []} for m in marks], "yurutluk": "yürürlükte"}


#: id, law, name, article, status, moved to, paragraphs.
INDEXED = [
    ("1-1", "6551", "Finansal Kiralama Kanunu", "1", "yürürlükte", None, [p_("(1)", "(1) A"), p_("(2)", "(2) B", "a)", "b)")]),
    ("2-1", "6551", "Terörün Önlenmesi Kanunu", "1", "yürürlükte", None, [p_(None, "Tek")]),
    ("3-359", "213", "Vergi Usul Kanunu", "359", "yürürlükte", None, [p_(None, "Kaçakçılık", "a)", "b)")]),
    ("3-7", "213", "Vergi Usul Kanunu", "7", "mülga", None, [p_(None, "Eski", "1.", "2.")]),
    ("3-Gecici1-1", "213", "Vergi Usul Kanunu", "Geçici 1", "yürürlükte", None, []),
    ("3-Gecici1-2", "213", "Vergi Usul Kanunu", "Geçici 1", "yürürlükte", None, []),
    ("3-8", "213", "Vergi Usul Kanunu", "8", "yürürlükte", "5520", []),
]
TEXTS = {"1-1": "kira sözleşmesi kurulur", "2-1": "suçun önlenmesi ve kira", "3-359": "kaçakçılık cezası"}
SOUGHT = [
    (1, "6551 sayılı Kanun m. 1"), (2, "6551 sayılı Finansal Kiralama Kanunu m. 1 f. 2 b. b"), (3, "VUK 359/a"), (4, "VUK m. 7 f. 2"), (5, "VUK geçici m. 1"), (6, "VUK m. 999"), (7, "9999 sayılı Kanun m. 1"), (8, "VUK m. 8 ve VUK m. 999"), (9, "vergi nedir"),
]


def corpus_of(spark):
    from lexforge import schema as Z

    rows = []
    for sira, (madde_id, law, name, no, state, moved, tree) in enumerate(INDEXED):
        meta = dict.fromkeys(Z.METADATA.fieldNames()) | {"mevzuat_id": madde_id.split("-")[0], "kanun_no": law, "kanun_ad": name, "madde_no": no, "yurutluk": state, "tasindigi_kanun": moved, "fikralar": tree}
        rows.append((sira, madde_id, TEXTS.get(madde_id, f"vergi hükmü {no}"), meta))
    schema = Z.row(("sira", Z.T.LongType()), "id", "text", ("metadata", Z.METADATA))
    return spark.createDataFrame(rows, schema)


def resolved(spark):
    idx = R.index(corpus_of(spark))
    parsed = R.parse_queries(frame(spark, SOUGHT, "query_id long, text string"), R.law_names(idx))
    return parsed, R.resolve(parsed, idx)


RESOLVED = [
    (1, 0, "1-1", None, None, True, "", True, "eslesti"), (1, 0, "2-1", None, None, True, "", True, "eslesti"), (2, 0, "1-1", "(2)", "b)", True, "", False, "eslesti"),
    (3, 0, "3-359", None, "a)", True, "read_as:harf->bent", False, "eslesti"), (4, 0, "3-7", None, "2.", True, "paragraph_as_clause:2|repealed", False, "eslesti"),
    (5, 0, "3-Gecici1-1", None, None, True, "same_number_twice", False, "eslesti"), (5, 0, "3-Gecici1-2", None, None, True, "same_number_twice", False, "eslesti"),
    (6, 0, None, None, None, None, None, None, "madde_yok"), (7, 0, None, None, None, None, None, None, "kanun_yok"), (8, 0, "3-8", None, None, True, "moved_to:5520", False, "eslesti"), (8, 1, None, None, None, None, None, None, "madde_yok"),
]


@C.add(expected(RESOLVED, "query_id long, cite int, madde_id string, fikra string, bent string, tam boolean, uyarilar string, coklu boolean, durum string"))
def citation_resolve(spark, sf_dir):
    """RES-01 to RES-06, JON-11, TXT-29 to TXT-31."""
    _, r = resolved(spark)
    return r.select("query_id", "cite", "madde_id", "parca.fikra", "parca.bent", "tam", F.array_join("uyarilar", "|").alias("uyarilar"), F.col("coklu_mevzuat").alias("coklu"), "durum")


@C.add(expected([(1, "atif", "eslesti"), (2, "atif", "eslesti"), (3, "atif", "eslesti"), (4, "atif", "eslesti"), (5, "atif", "eslesti"), (6, "dogal", "eslesme_yok"), (7, "dogal", "eslesme_yok"), (8, "atif", "kismi"), (9, "dogal", None)], "query_id long, mod string, durum string"))
def citation_route(spark, sf_dir):
    """MOD-01, O9."""
    return R.route(*resolved(spark))


@C.add(expected([(1, 1, "1-1"), (1, 2, "2-1"), (5, 1, "3-Gecici1-1"), (5, 2, "3-Gecici1-2"), (8, 1, "3-8")], "query_id long, rank int, madde_id string"))
def citation_top(spark, sf_dir):
    """MOD-02."""
    rows = R.citation_rows(resolved(spark)[1], 2)
    return rows.filter(F.col("query_id").isin(1, 5, 8)).select("query_id", "rank", "madde_id")
