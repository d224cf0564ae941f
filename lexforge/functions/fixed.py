"""Fixed values of Turkish legislative writing.

Everything in this module is data that results depend on: patterns, word lists, lookup tables, thresholds and formats. They are
written for Python's ``re``; ``lexforge.functions.text.java`` rewrites them for the JVM. There is no logic here.
"""

# -- letters, characters ---------------------------------------------------------------------------------------------
UPPER = "A-ZÇĞİÖŞÜ"
LOWER = "a-zçğıöşü"
PARAGRAPH = "\x1f"
#: Character references of pages, in the order in which they are decoded.
PAGE_REFERENCES = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&"), ("&amp", "&"))
#: Unicode's space separators (Zs), which DuckDB's trim removes.
SPACE_SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
DASHES = "‐‑‒–—―−"
SOFT_HYPHEN = "­"
TOKEN = r"[0-9a-zçğıöşü]+"
STEM = 5
FOLD_FROM = "İIıŞşÇçĞğÖöÜüÂâÎîÛû’‘`´–—‐‑ \t\n\r"
FOLD_TO = "iiissccggoouuaaiiuu''''----    "
SLUG_FROM = "çÇğĞıİşŞüÜöÖ"
SLUG_TO = "cCgGiIsSuUoO"
CYRILLIC_FROM = "асеорухАСЕОРУХ"
CYRILLIC_TO = "aceopyxACEOPYX"
CYRILLIC_MARK = r"(?:(?<=\s)|^)([асеорухАСЕОРУХ])\)"

# -- article markers -------------------------------------------------------------------------------------------------
ARTICLE_WORD = r"[Mm][Aa][Dd][Dd][Ee]"
ARTICLE_PREFIX = r"(?:[Ee][Kk]|[Gg][Ee][Çç][İIiı][Cc][İIiı]|[Mm][Üü][Kk][Ee][Rr][Rr][Ee][Rr])\s+"
ARTICLE_NUMBER = r"\d+(?:/[A-Za-zÇĞİÖŞÜçğıöşü]+)?"
TEXT_TAIL = r"(?:\[\d+\])*\s*\.?"
TEXT_SEPARATOR_ANY = r"(?:\s*-\s*|\s+(?=[(]))"
TEXT_SEPARATOR_CAPS = r"(?:\s*-\s*|\s+(?=[(]|[A-ZÇĞİÖŞÜ][a-zçğıöşü]))"
HTML_NOISE = r"(?:\[\d+\]|<[^>]+>|\.|\s)*"
HTML_SEPARATOR_ANY = r"(?:-|–|—|(?=[(]))"
HTML_SEPARATOR_CAPS = r"(?:-|–|—|(?=[(]|[A-ZÇĞİÖŞÜ][a-zçğıöşü]))"
GLUED_ARTICLE = rf"(?<=[\wçğıöşüâîÇĞİÖŞÜ])MADDE\s+({ARTICLE_NUMBER})-\s*(?=\()"
SENTENCE_END = r"[.!?]\s+(?=[A-ZÇĞİÖŞÜ0-9])"
NOT_INCORPORATED = r"(?i)(?:\d+/\d+/\d+\s+)?(?:tarihli\s+ve\s+\d+\s+)?sayılı\s+.{0,40}?kanun[ua]?\s+işlenemeyen"
PREFIX_KINDS = (("Geçici", "gecici"), ("Ek", "ek"), ("Mükerrer", "mukerrer"))

# -- text that leaks into an article's end ---------------------------------------------------------------------------
ORDINAL_WORD = (
    r"(?:on|yirmi)?\s*(?:bir[il]nci|ik[il]nci|üçüncü|dördüncü|beşinci|alt[il]ncı|yed[il]nci|sek[il]z[il]nci|dokuzuncu|onuncu)|son"
)
LEVEL_TAIL = rf"(?i)(?<=[.!?:)\]])\s+(?:{ORDINAL_WORD})\s+(?:bölüm|kısım|kitap|ayrım|ayirim|fasıl)\b.*$"
LAW_END = r"(?i)(?:(?:bakanlar\s+kurulu|cumhurbaşkanı)|(?:\w+\s+)?(?:\w+\s+ve\s+)?\w+\s+bakan(?:ı|ları))\s+yürütür\s*\.?"
SCHEDULE_HEAD = r"(?i)^\(?\s*[IVXLC0-9]+\s*\)?\s*SAYILI\s+(?:TABLO|CETVEL|LİSTE|LISTE)"
RATIO_SKIP = r"(?i)\((?:değişik|ek(?:\s+cetvel|\s+kroki\b[^:)]*)?|mülga|iptal|ekleme|yeniden\s+düzenleme|aynen\s+kabul)\s*:[^)]*\)?"
RATIO_WINDOW, RATIO_LIMIT, LEAST_TAIL = 80, 0.85, 30
HEADING_TAIL = r"(?<=[.!?])\s+[A-ZÇĞİÖŞÜ][\wçğıöşüâî,]*(?:\s+[\wçğıöşüâî,]+){0,9}:\s*$"
ROMAN_HEADING_TAIL = r"(?<=[.!?])\s+[IVX]{1,4}\s*-\s+[A-ZÇĞİÖŞÜ][\wçğıöşüâî,]*(?:\s+[\wçğıöşüâî,]+){0,9}:\s*$"
ROMAN_SIGN = r"(?:(?<=[.!?])|(?<=^))\s*[IVX]{1,4}\s*-\s+[A-ZÇĞİÖŞÜ]"
LIST_OPENER = (
    r"(?i)(?:şunlardır|şöyledir|gibidir|aşağıdakidir|aşağıdakilerdir|şu\s+şekildedir|"
    r"aşağıda\s+(?:belirtilmiştir|gösterilmiştir|sayılmıştır))\s*:?\s*$"
)
CLOSING_TITLES = (
    "Yürürlük", "Yürütme", "Geçiş hükümleri", "Geçici hükümler", "Yürürlükten kaldırılan hükümler", "Değiştirilen hükümler",
    "Çeşitli hükümler", "Son hükümler", "Tanımlar", "Kapsam", "Yönetmelik", "Yönetmelikler", "Atıflar", "Ortak hükümler",
    "Uygulanmayacak hükümler",
)
NEIGHBOUR_TITLES = (
    "Değiştirilen ve yürürlükten kaldırılan hükümler", "Yürürlükten kaldırılan ve değiştirilen hükümler",
    "Uygulanmayacak ve yürürlükten kaldırılan hükümler", "Kaldırılan ve uygulanmayacak hükümler",
    "Kaldırılan ve uygulanmayacak olan hükümler", "Diğer kanunların değiştirilen hükümleri", "Diğer kanunlara eklenen hükümler",
    "Kaldırılan ve değiştirilen hükümler", "Uygulanmayacak kanun hükümleri", "Yürürlükten kaldırılan hükümler",
    "Diğer geçiş hükümleri", "Diğer kanun hükümleri", "Diğer hükümler", "Kaldırılan hükümler", "Saklı hükümler",
    "Uygulanmayacak hükümler",
)
SUBJECT_TITLE = (
    r"(?<=[.!?])(?:\s*\[\d+\])?\s+[A-ZÇĞİÖŞÜ][^.,;:]{3,80}?"
    r"(?:ilişkin\s+geçiş\s+hükümleri|ile\s+ilgili\s+hükümler(?:i)?)(?:\s*\[\d+\])?\s*$"
)
MARGIN_NUMBER = r"(?<=[.!?])\s+(?:\d+|[IVX]+)\.\s*$"
PROTECTED_LAWS = ("4721", "6098", "6102", "5846", "2709")
LEADING_REDIRECT = (
    r"(?i)^\s*\d+\s*-\s*\([^)]*?(?:işlenmiş|ilgili\s+olup)[^)]*\)(?:\s*MADDE\s+\d+\s+il[aâ]\s+\d+\s*-\s*\([^)]*\))*\s*"
)
MARKER_ZONE, MARKER_LEAST = 0.85, 5
LEVEL_WORDS = ("KİTAP", "KISIM", "BÖLÜM", "AYIRIM", "AYRIM", "FASIL")
OPENING_WORD = "BAŞLANGIÇ"

# -- status and amendments -------------------------------------------------------------------------------------------
IN_FORCE, REPEALED = "yürürlükte", "mülga"
PARTIAL_REPEAL = (
    r"(?i)\(\s*mülga\s+(?:son|birinci|ikinci|üçüncü|dördüncü|beşinci|altıncı|yedinci|sekizinci|dokuzuncu|onuncu|"
    r"\d+\s*(?:\.|inci|ıncı|uncu|üncü|nci))\s+(?:fıkra|cümle|bent|paragraf)"
)
REPEAL_MARK = (
    r"(?i)\(\s*mülga|;\s*mülga|\(\s*iptal\s*:|;\s*iptal\s*:|\(\s*iptal\s+(?:\w+\s+)?(?:fıkra|bent|madde)\s*:"
    r"|;\s*iptal\s+(?:\w+\s+)?(?:fıkra|bent|madde)\s*:"
)
OPENING_NOTES = (
    r"(?i)^\s*(?:\(\s*(?:(?:değişik|ek|mülga|iptal|yeniden\s+düzenleme|mülga\s+ve\s+yeniden)|\d+/\d+/\d+|\d+\s+sayılı)"
    r"[^)]*\)(?:\s*\[\d+\])?\s*)+"
)
AMENDMENT = r"\((Değişik|Ek|Mülga|Ekleme|İptal)([^:)]*?):\s*([^)]*)\)"
AMENDMENT_SOURCE = r"(\d{1,2})/(\d{1,2})/(\d{4})-(\d+)/(\d+)\s*md\."
COURT = r"Anayasa\s+Mahkemesi"
AMENDMENT_KINDS = {"Değişik": "degisik", "Ek": "ek", "Ekleme": "ek", "Mülga": "mulga", "İptal": "iptal"}

# -- paragraphs and clauses ------------------------------------------------------------------------------------------
REFERENCE_WORDS = (
    r"(?:Birinci|İkinci|Üçüncü|Dördüncü|Beşinci|Altıncı|Yedinci|Sekizinci|Dokuzuncu|Onuncu|Bu|Aynı|Söz|Sözü|Yukarıdaki|"
    r"Anılan|İlgili|Bir|SAYILI|Sayılı|Numaralı)\b"
)
PARAGRAPH_STARTS = (
    r"(?:(?<=[.:!?]\s)|(?<=\n))\(\d+\)\s",
    r"(?<=\]\s)\(\d+\)\s(?=[A-ZÇĞİÖŞÜ])",
    r"(?<=\)\s)\(\d+\)\s(?=\()",
    r"(?<=\)\s)\(\d+\)\s(?=[A-ZÇĞİÖŞÜ])",
    rf"(?<=[\wçğıöşüÇĞİÖŞÜ]\s)\(\d+\)\s(?=[A-ZÇĞİÖŞÜ])(?!{REFERENCE_WORDS})",
)
PARAGRAPH_NUMBER = r"^(\(\d+\))"
APPENDED_SCHEDULE = r"\(\d+\)\s+SAYILI\s+(?:LİSTE|CETVEL|TARİFE|ÇİZELGE|KROKİ)"
CLAUSE_NUMBER = r"(?:(?<=\s)|^)(\d+)\.\s"
CLAUSE_LETTER = r"(?:(?<=\s)|^)([a-zçğıöşü])\)\s"
SUBCLAUSE_NUMBER = r"(?:(?<=\s)|^)(\d+)\)\s"
CLAUSE_HEAD = r"^\s*(?:[a-zçğıöşüA-ZÇĞİÖŞÜ]\)|\d+[.)])\s"
OPEN_LIST = r"(?:(?<=[:\s])|^)(?:[a-zçğıöşüA-ZÇĞİÖŞÜ]\)|\d+[.)])\s"
NEW_PARAGRAPH = (
    r"^(?:Bu [Kk]anun(?:da|un)|Bu madde(?:nin|de)?\s|Yukarıda|Bunlar|Bu fıkra(?:da)?\s|Şu kadar ki|Söz konusu|Bu bent(?:te|lerde)?\s)"
)
CLOSING_SENTENCE = r"^(?:Bu [Kk]anun(?:da|un)|Yukarıda|yukarıda|Bunlar|Bu fıkra(?:da)?\s|Şu kadar ki|Söz konusu)"
LAST_ITEM = r"^([0-9a-zçğıöşü]+[.)]\s*.{0,75}?[,;.]?)\s*\.\s+(.{10,})$"
ITEM_MARK = r"^[0-9a-zçğıöşü]+[.)]\s*"
SHORT_ITEM = 70

# -- footnotes, tables, ranges ---------------------------------------------------------------------------------------
FOOTNOTE_MARK = r"\[(\d+)\]"
FOOTNOTES_LEAST, FOOTNOTE_GAP, FOOTNOTE_LAST, FOOTNOTE_LONG, FOOTNOTE_BEFORE = 3, 800, 400, 1200, 300
FOOTNOTE_REF_ANCHOR = r'(?i)name="_ftnref(\d+)"'
FOOTNOTE_ANCHOR = r'(?is)name="_ftn(\d+)"[^>]*>.*?</a>(?P<text>.*?)(?=<a [^>]*name="_ftn(?:ref)?\d+"|</div>|</td>|$)'
APPENDIX_HEADERS = ("Değiştiren", "Yürürlüğe Giriş", "Değişiklik Yapan", "Resmî Gazete")
TABLE_RULE = r"^\s*\|?[\s:|-]*\|?\s*$"
FLAT_TABLE_LEAST = 20
RANGE = r"(?i)MADDE\s+(\d+)\s+il[âa]\s+(?:MADDE\s+)?(\d+)"
DASH_CHAIN = r"(?i)MADDE\s+(\d+)\s*-\s*((?:\d+\s*-\s*)+)"
TWO_ARTICLES = r"(?i)MADDE\s+(\d+)\s+ve\s+(\d+)\s*-"

# -- corpus rows -----------------------------------------------------------------------------------------------------
DOCUMENT_TYPE = "KANUN"
REDIRECT_KIND = "islenmistir_yonlendirme"
REDIRECT_NOTE = r"(?i)^\(?\s*[^)]*?(?:yerine\s+işlenmiş|ile\s+ilgili\s+olup)[^)]*?\)?\.?\s*$"
REDIRECT_START = r"(?i)^\s*(?:\d+[-\s]*)*\(?\s*(?:\d{1,2}[./]\d{1,2}[./]\d{2,4}|MADDE\s+\d+|\d+\s+sayılı)"
REDIRECT_PAREN = r"^[\d\s.,-]*\("
REDIRECT_LONG = 200
REDIRECT_TARGET = r"(?i)(\d{3,5})\s+say[ıi]l[ıi]"
ARTEFACT = r"\(\d+\)|\[\d+\]|\d+|[\s.;,\-]"
ARTEFACT_LEAST = 3
PREFIX_LABELS = {"gecici": "Geçici", "ek": "Ek", "mukerrer": "Mükerrer"}
PATH_JOIN = " › "

# -- ranked retrieval ------------------------------------------------------------------------------------------------
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
CANDIDATES, TOP, RERANK_HEAD, RERANK_CHARS, RRF_K = 50, 10, 20, 3000, 60
WEIGHTS = (0.65, 0.20, 0.15)
QUERY_LIMIT, TOP_LIMIT = 2000, 50
PAYLOAD = ("kanun_no", "kanun_ad", "madde_no", "yurutluk", "mevzuat_tur", "resmi_gazete_tarihi", "resmi_gazete_sayisi")
STOP_WORDS = (
    "kanun", "kanunu", "kanunun", "kanuna", "kanunda", "hakkinda", "ile", "ve", "dair", "bazi", "kanunlarda", "degisiklik",
    "yapilmasina", "iliskin", "sayili", "turk", "turkiye",
)
ALPHABET = "abcçdefgğhıijklmnoöprsştuüvyz"
TITLE_LEAK = r"[.!?]\s+([A-ZÇĞİÖŞÜ][a-zçğıöşü]+(?:\s+[a-zçğıöşü]+){0,3})\s*$"
AMENDING_TITLES = ("DEĞİŞİKLİK YAPILMASINA", "BAZI KANUNLARDA", "DEĞİŞİKLİK YAPILMASI HAKKINDA")
ARTICLE_LEAKS = (
    r"(?i)\bmadde\s*\d+",
    r"(?i)\b\d+\s*[./]\s*[a-zçğıöşü]\b",
    r"(?i)\b\d+\s*\.?\s*(inci|nci|ncı|uncu|üncü|ıncı)\s*madde",
    r"(?i)\b\d+\s*\.\s*madde",
    r"(?i)\b(geçici|ek)\s*\d+",
    r"(?i)\bmükerrer\s*\d+",
)
STRUCTURE_MARKS = {
    "MADDE_N_tire": r"MADDE\s+\d+\s*[-–—]",
    "Madde_N_tire": r"\bMadde\s+\d+\s*[-–—]",
    "MADDE_N_duz": r"MADDE\s+\d+\s+[A-ZÇĞİÖŞÜ]",
    "sira_N_nokta": r"(?m)^\s*\d+\.\s+[A-ZÇĞİÖŞÜ]",
    "sira_N_tire": r"(?m)^\s*\d+\s*-\s*[A-ZÇĞİÖŞÜ]",
    "roma_baslik": r"(?m)^\s*[IVX]+\s*[-.]\s",
    "fikra_paren": r"\(\d+\)\s",
}

# -- communiques -----------------------------------------------------------------------------------------------------
COMMUNIQUE_END = r"(?i)bu\s+tebli[ğg]\s+h[üu]k[üu]mlerini[^.]{0,90}?y[üu]r[üu]t[üu]r\s*\.?"
ANNEX_HEAD = r"(?i)^\s*EK\s*[-–]?\s*\d+[A-Z]?\b"
DECIMAL_SECTION = rf"(?:(?:^|{PARAGRAPH})[ \t]*|(?<=[\wçğıöşüÇĞİÖŞÜ]) )(\d{{1,2}}(?:\.\d{{1,2}})*)\.[ \t]+(?=[A-ZÇĞİÖŞÜ])"
ROMAN_SECTION = rf"(?:^|{PARAGRAPH})[ \t]*([IVX]{{1,5}})[ \t]*[-–][ \t]*(?=[A-ZÇĞİÖŞÜ])"
DASH_SECTION = rf"(?:^|{PARAGRAPH})[ \t]*(\d{{1,3}})[ \t]*[-–][ \t]*(?=[A-ZÇĞİÖŞÜ])"
UNDER_ROMAN = rf"(?:^|{PARAGRAPH})[ \t]*(\d{{1,3}})[ \t]*(?:[-–][ \t]*|\.[ \t]+)(?=[A-ZÇĞİÖŞÜ])"
SECTIONS_LEAST, HEADING_MOST, BODY_LEAST, INTRO_LEAST, BODY_MOST, RUN_SHARE = 2, 120, 200, 200, 25_000, 0.5
