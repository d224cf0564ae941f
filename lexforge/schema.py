"""Schemas of the corpus, the parsing kernels' results and the search results."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()


def row(*fields: str | tuple[str, T.DataType]) -> T.StructType:
    """A struct; bare names are strings."""
    return T.StructType([T.StructField(f, S) if isinstance(f, str) else T.StructField(*f) for f in fields])


SUBCLAUSE = row("isaret", "text", "yurutluk")
CLAUSE = row("isaret", "text", "yurutluk", ("alt_bentler", T.ArrayType(SUBCLAUSE)))
PARAGRAPH = row("no", "text", ("bentler", T.ArrayType(CLAUSE)), "yurutluk")
AMENDMENT = row("tip", "tarih", "kanun_no", "madde", "kapsam", "ham_metin")
FOOTNOTE = row(("no", T.IntegerType()), "text")
ARTICLE = row("no", "body")
LEVEL_FIELDS = tuple(f"{k}_{f}" for k in ("kitap", "kisim", "bolum", "ayirim") for f in ("no", "baslik"))
TREE_EVENT = row("kind", "label", "title", "no", "baslik", *LEVEL_FIELDS, "hiyerarsi_yolu", "maddeId")
UNIT = row("no", "body", "tip", "baslik", ("ust", T.ArrayType(row("no", "baslik"))))
METADATA = row(
    "mevzuat_id", "mevzuat_tur", "kanun_no", "kanun_ad", "resmi_gazete_tarihi", "resmi_gazete_sayisi", "madde_no", "madde_baslik", "madde_tipi", "yurutluk", "maddeId",
    *LEVEL_FIELDS, "hiyerarsi_yolu", ("fikralar", T.ArrayType(PARAGRAPH)), ("degisiklik_gecmisi", T.ArrayType(AMENDMENT)), ("dipnotlar", T.ArrayType(FOOTNOTE)), ("tablolar", T.ArrayType(S)),
    ("yerine_islenmistir", T.BooleanType()), "tasindigi_kanun",
)
CHUNK = row("id", "text", ("metadata", METADATA))
READING = row("madde_tipi", "madde_numara", ("fikra", T.IntegerType()), "bent", "aciklama")
CITATION = row(("kanun_nolari", T.ArrayType(S)), ("yorumlar", T.ArrayType(READING)), "kanun_kaynak", "kanun_ipucu", "ham")
PARSED = row(("atiflar", T.ArrayType(CITATION)), "tani")
PART = row("fikra", "bent", "metin", "yurutluk", "tolerans")
SUBPART = row(("parca", PART), ("tam", T.BooleanType()), ("uyarilar", T.ArrayType(S)))
