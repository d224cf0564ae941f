"""Parsing kernels and native functions: literal cases, and each native form against its kernel."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexforge.functions import fixed as X
from lexforge.functions import status as S
from lexforge.functions import text as T
from lexforge.operators import citation as C
from lexforge.operators import kernels as K
from lexforge.operators import retrieval, structure


@pytest.mark.parametrize(
    ("text", "numbers"),
    [
        ("MADDE 1- Metin", ["1"]),
        ("Madde 5 – Metin", []),  # dashes are normalised before splitting
        ("Madde 10 hükmü uygulanır", []),
        ("MADDE 10 hükmü uygulanır", []),
        ("MADDE 428 İşyerinin devri", ["428"]),
        ("Madde 32 Tebliğ", []),
        ("Madde 3 (Değişik: x)", ["3"]),
        ("MADDE 61. - Metin", ["61"]),
        ("Madde 15[14][15] - Metin", ["15"]),
        ("EK MADDE 3- Metin", ["Ek 3"]),
        ("MÜKERRER MADDE 20/A- Metin", ["Mükerrer 20/A"]),
        ("GEÇİCİ MADDE 1- a Geçici Madde 2- b", ["Geçici 1", "Geçici 2"]),
    ],
)
def test_article_markers(text, numbers):
    assert [n for n, _ in K.split_articles(text)] == numbers


def test_heading_of_the_next_article_goes_but_lists_stay():
    cut = K.split_articles("MADDE 1- Metin biter. Yeni başlık adı: MADDE 2- Son.")
    kept = K.split_articles("MADDE 1- Metin biter. İstenen belgeler şunlardır: MADDE 2- Son.")
    assert cut[0][1] == "Metin biter." and kept[0][1].endswith("şunlardır:")


def test_paragraph_numbers_in_references_do_not_split():
    assert len(K.paragraphs("(1) Bu maddenin birinci fıkrasının (2) numaralı bendi uygulanır.")) == 1
    assert [p["no"] for p in K.paragraphs("(1) A biter. (2) B biter.\x1f(3) C")] == ["(1)", "(2)", "(3)"]


def test_roman_clauses_are_not_letters():
    tree = K.paragraphs("(1) 1. Grup: a) Bir i) roma i) roma iki b) İki 2. Son")
    assert [c["isaret"] for c in tree[0]["bentler"][0]["alt_bentler"]] == ["a)", "b)"]


def test_footnote_block_gates():
    gap = "x" * 900
    for body in (f"a [1] {gap} [2] {gap} [3] b", "a [1] b [2] c", "ön [1] a [2] b [3] " + "c" * 500, "kısa [1] a [2] b [3] c" + " " * 1300):
        assert K.footnote_appendix(body) == (body, [])
    long = "y" * 400 + " " + "z" * 900
    assert K.footnote_appendix(f"{long} [1] Bir. [2] İki. [3] Üç.")[1] == [(1, "Bir."), (2, "İki."), (3, "Üç.")]


def test_sections():
    body = "Gövde metni. " * 30
    mark = X.PARAGRAPH
    assert K.sections("düz metin") == []
    assert [u["no"] for u in K.sections(mark.join(f"{i}- Başlık{mark}{body}" for i in range(1, 5)))] == ["1", "2", "3", "4"]
    assert K.sections(mark.join(f"{i}- Başlık{mark}{body}" for i in (7, 12, 31, 40))) == []
    assert K.sections(mark.join(f"{i}. Kısa" for i in range(1, 9))) == []
    assert [u["no"] for u in K.sections(mark.join(f"{i}- BAŞLIK{mark}{body}" for i in ("I", "II", "III")))] == ["I", "II", "III"]


def test_runs():
    assert K.longest_run(["1", "2", "3"]) == 3 and K.longest_run(["1", "2", "1", "2", "3"]) == 3 and K.longest_run(["2", "3"]) == 0
    assert K.longest_run(["1.1", "2.1", "1.2", "2.2", "2.3"]) == 3


BODIES = [
    "(1) Kayıt.", "(Mülga: 1/1/2010-5999/1 md.)", "(Mülga son cümle: 2/2/2012-6300/4 md.) Kayıt.", "Kayıt. (MÜLGA: x)", "(Değişik: 1/1/2001-5/1 md.) [3] (İptal: AYM)", "(İPTAL fıkra: x)", "; mülga", "(12 sayılı Kanun) (mülga)", "",
    "(Mülga\x1fikinci fıkra) a; iptal:", "(3/3/2003) Mülga değil",
]


def test_native_status_equals_the_kernel(spark):
    rows = spark.createDataFrame([(b,) for b in BODIES], "b string").select("b", S.status(F.col("b")).alias("s")).collect()
    assert {r.b: r.s for r in rows} == {b: K.status(b) for b in BODIES}


def random_text(r: random.Random) -> str:
    return "".join(r.choice("abcİIıiŞşÇçĞğÖöÜüâ’–­ \t\n\x1f1290.,:;()[]-/éß") for _ in range(r.randint(0, 40)))


def test_native_text_equals_python(spark):
    r = random.Random(1)
    texts = [random_text(r) for _ in range(400)] + ["", " ", "\x1f", "(1) a [2]"]
    c = F.col("t")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", T.tokenize(c).alias("tokens"), T.fold(c).alias("fold"), T.strip(c).alias("strip"), T.squeeze(c).alias("squeeze"), T.strip_amendments(c).alias("clean"), T.tr_upper(c).alias("up"), T.latin_marks(c).alias("latin")
    ).collect()
    for x in got:
        assert x.tokens == retrieval.terms_of(x.t) and x.fold == C.fold(x.t) and x.strip == x.t.strip() and x.squeeze == " ".join(x.t.split()) and x.clean == K.clean_body(x.t) and x.up == C.upper(x.t)


def test_flat_tables_leave_the_body_once(spark):
    md = "| Sıra | İl | Nüfus sayısı |\n| --- | --- | --- |\n| 1 | ANKARA | 5.000.000 |"
    flat = "Sıra İl Nüfus sayısı 1 ANKARA 5.000.000"
    rows = [(f"Önce {flat.replace(' ', '  ')} sonra", "Önce   sonra"), (f"Metin\n\n{md}", "Metin"), ("Başka", "Başka"), (f"{flat} ve {flat}", f"ve {flat}")]
    df = spark.createDataFrame([(b, [md]) for b, _ in rows], "b string, t array<string>").select(T.without_tables(F.col("b"), F.col("t")).alias("x"))
    assert [" ".join(r.x.split()) for r in df.collect()] == [" ".join(w.split()) for _, w in rows]


def test_utf8_and_titles(spark):
    row = spark.createDataFrame([(bytearray(b"a\xffb"), " Başlık: ", "( 2 )", "(x)")], "b binary, t string, p string, q string").select(
        T.valid_utf8(F.col("b").cast("string")).alias("b"), T.clean_title(F.col("t")).alias("t"), T.paragraph_number(F.col("p")).alias("p"), T.paragraph_number(F.col("q")).alias("q"), T.mark_of(F.lit("Ç)")).alias("m"), T.prefix_name(F.lit("GEÇİCİ")).alias("g")
    ).first()
    assert (row.b, row.t, row.p, row.q, row.m, row.g) == ("a�b", "Başlık", 2, None, "ç", "Geçici")


def test_sql_functions(spark):
    structure.register(spark)
    assert [r.no for r in spark.sql("SELECT no FROM split_articles('MADDE 1- a. MADDE 2- b.') ORDER BY ord").collect()] == ["1", "2"]
    assert spark.sql("SELECT count(*) FROM split_paragraphs('(1) A biter. (2) B biter.')").first()[0] == 2
    assert spark.sql("SELECT strip_html('<p>a</p>b')").first()[0] == "a\x1fb"


LAW = [
    ("TCK m. 141", "5237"), ("T.C.K. 141. madde", "5237"), ("TCK'nın 141. maddesi", "5237"), ("Türk Ceza Kanunu 141. maddesi", "5237"), ("5237 s. K. m. 141", "5237"), ("5237 sayılı Kanunun 141. maddesi", "5237"),
    ("Kanun No: 5237 madde 141", "5237"), ("05237 sayılı kanun m. 141", None), ("İŞ KANUNU madde 141", "4857"), ("Basın-İş Kanunu m. 141", "5953"), ("Deniz İş Kanunu m. 141", None), ("AY m. 141", "2709"), ("ay m. 141", None),
    ("1961 Anayasası m. 141", None), ("1982 Anayasası m. 141", "2709"), ("İsviçre Borçlar Kanunu m. 141", None), ("375 sayılı KHK m. 141", None), ("2023/15 sayılı karar m. 141", None), ("anayasal hak m. 141", None),
    ("765 sayılı eski TCK m. 141", "765"), ("1 sayılı Cumhurbaşkanlığı Teşkilatı Hakkında Cumhurbaşkanlığı Kararnamesi m. 141", None), ("KVKK md 141", "6698"), ("5510 sayılı Sosyal Sigortalar Kanunu m. 141", "5510"),
]


@pytest.mark.parametrize(("query", "law"), LAW)
def test_laws(query, law):
    found = C.parse(query).citations
    assert [c["kanun_nolari"] for c in found] == ([[law]] if law else []) and all(c["yorumlar"][0]["madde_numara"] == "141" for c in found)


PARTS = [
    ("TCK 141/2", ("asil", "141", 2, None)), ("TCK 141/2-ğ", ("asil", "141", 2, "ğ")), ("TCK 141/II", ("asil", "141", 2, None)), ("TCK 141/1(b)", ("asil", "141", 1, "b")), ("TCK m. 141 f. 2 b. a", ("asil", "141", 2, "a")),
    ("TCK 141. maddenin on birinci fıkrası", ("asil", "141", 11, None)), ("TCK m. 141 son fıkra", ("asil", "141", -1, None)), ("TCK 141. maddesi (3) numaralı fıkrası", ("asil", "141", 3, None)), ("TCK geçici m. 5", ("gecici", "5", None, None)),
    ("VUK mük. 298. madde", ("asil", "298", None, None)), ("VUK mükerrer 298", ("mukerrer", "298", None, None)), ("VUK ek madde 7", ("ek", "7", None, None)), ("VUK ek 3 ay", None), ("TCK 18 yaşındaki", None), ("TCK 2-5 yıl", None), ("TCK 1 Haziran 2005", None),
    ("TCK madde 3 ton", None), ("TCK m. 53 yıllık", ("asil", "53", None, None)), ("TCK 5 maddede", None), ("TCK m. 0", None), ("TCK 141. maddesinin b bendi", ("asil", "141", None, "b")), ("TCK 141. maddesi 4. bent", ("asil", "141", None, "4")),
    ("TCK m. 141 alt bendi a", ("asil", "141", None, None)), ("TCK 18 m2", None), ("TCK 141/IIII", None),
]


@pytest.mark.parametrize(("query", "part"), PARTS)
def test_parts(query, part):
    found = C.parse(query).citations
    first = found[0]["yorumlar"][0] if found else None
    assert (first and (first["madde_tipi"], first["madde_numara"], first["fikra"], first["bent"])) == part


def test_corpus_names_and_repeats():
    names = [("ornek kayit kanunu", ("9991", "9992"))]
    found = C.parse("Örnek Kayıt Kanununun 3. maddesi ve örnek kayıt kanunu m. 3", names).citations
    assert [(c["kanun_nolari"], c["kanun_kaynak"]) for c in found] == [(["9991", "9992"], "korpus_adi")]


def tree(*paragraphs):
    return [{"no": no, "text": f"t{no}", "yurutluk": X.IN_FORCE, "bentler": [{"isaret": m, "text": m, "yurutluk": X.IN_FORCE} for m in marks]} for no, *marks in paragraphs]


@pytest.mark.parametrize(
    ("paragraphs", "asked", "found"),
    [
        ([("(1)",), ("(2)", "a)", "b)")], (2, "b"), ("(2)", "b)", True)),
        ([("(1)",), ("(2)",)], (-1, None), ("(2)", None, True)),
        ([("(1)",)], (7, None), (None, None, False)),
        ([(None, "1.", "2.")], (2, None), (None, "2.", True)),
        ([(None,), (None,)], (2, None), (None, None, True)),
        ([("(1)", "a)")], (1, "z"), ("(1)", None, False)),
        ([("(1)", "Ç)")], (None, "ç"), ("(1)", "Ç)", True)),
        ([], (None, None), (None, None, True)),
    ],
)
def test_sub_parts(paragraphs, asked, found):
    r = C.sub_part(tree(*paragraphs), *asked)
    p = r["parca"] or {"fikra": None, "bent": None}
    assert (p["fikra"], p["bent"], r["tam"]) == found
