"""Fixed values of written citations: abbreviations, names, and patterns over folded text. There is no logic here."""

LAST = -1

#: Abbreviation, law number, official name.
ABBREVIATIONS = (
    ("tck", "5237", "Türk Ceza Kanunu"), ("cmk", "5271", "Ceza Muhakemesi Kanunu"), ("tmk", "4721", "Türk Medeni Kanunu"),
    ("tbk", "6098", "Türk Borçlar Kanunu"), ("hmk", "6100", "Hukuk Muhakemeleri Kanunu"), ("iik", "2004", "İcra ve İflas Kanunu"),
    ("ttk", "6102", "Türk Ticaret Kanunu"), ("vuk", "213", "Vergi Usul Kanunu"), ("gvk", "193", "Gelir Vergisi Kanunu"),
    ("kvk", "5520", "Kurumlar Vergisi Kanunu"), ("kdvk", "3065", "Katma Değer Vergisi Kanunu"),
    ("aatuhk", "6183", "Amme Alacaklarının Tahsil Usulü Hakkında Kanun"), ("dmk", "657", "Devlet Memurları Kanunu"),
    ("kvkk", "6698", "Kişisel Verilerin Korunması Kanunu"), ("iyuk", "2577", "İdari Yargılama Usulü Kanunu"),
    ("fsek", "5846", "Fikir ve Sanat Eserleri Kanunu"), ("tkhk", "6502", "Tüketicinin Korunması Hakkında Kanun"),
    ("kmk", "634", "Kat Mülkiyeti Kanunu"), ("otvk", "4760", "Özel Tüketim Vergisi Kanunu"), ("dvk", "488", "Damga Vergisi Kanunu"),
    ("evk", "1319", "Emlak Vergisi Kanunu"), ("vivk", "7338", "Veraset ve İntikal Vergisi Kanunu"),
    ("mtvk", "197", "Motorlu Taşıtlar Vergisi Kanunu"), ("bgk", "2464", "Belediye Gelirleri Kanunu"),
    ("spkn", "6362", "Sermaye Piyasası Kanunu"), ("ssgssk", "5510", "Sosyal Sigortalar ve Genel Sağlık Sigortası Kanunu"),
    ("pvsk", "2559", "Polis Vazife ve Salahiyet Kanunu"), ("ay", "2709", "Türkiye Cumhuriyeti Anayasası"),
)
#: Words of common names (before "kanunu" or "k."), law number.
NAMES = (
    ("turk ceza", "5237"), ("ceza muhakemesi", "5271"), ("turk medeni", "4721"), ("medeni", "4721"), ("turk borclar", "6098"),
    ("borclar", "6098"), ("hukuk muhakemeleri", "6100"), ("icra ve iflas", "2004"), ("icra iflas", "2004"), ("turk ticaret", "6102"),
    ("vergi usul", "213"), ("gelir vergisi", "193"), ("kurumlar vergisi", "5520"), ("katma deger vergisi", "3065"), ("kdv", "3065"),
    ("amme alacaklarinin tahsil usulu hakkinda", "6183"), ("devlet memurlari", "657"), ("kisisel verilerin korunmasi", "6698"),
    ("idari yargilama usulu", "2577"), ("basin is", "5953"),
)
LABOUR, CONSTITUTION, CONSTITUTION_YEAR = "4857", "2709", "1982"
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx")
ORDINALS = ("birinci", "ikinci", "ucuncu", "dorduncu", "besinci", "altinci", "yedinci", "sekizinci", "dokuzuncu")
QUALIFIERS = ("eski", "mulga", "onceki", "evvelki", "isvicre", "alman", "fransiz", "italyan", "avusturya")
NAME_LEAST, HINT_WORDS, HINT_CHARS = 8, 16, 240

NUMBERED_LAW = r"(?<![0-9/.,])(?P<no>[0-9]{1,4})(?![0-9])\s?(?P<how>sayili|sy\.|s\s?\.|numarali|no\.?\s?'?\s?l[iu]|nolu)"
LAW_NUMBER_LABEL = r"(?<![a-z0-9])(?:kanun|k\.)\s?(?:no|numarasi|numara|nr)\.?\s?:?\s?(?P<no>[0-9]{1,4})(?![0-9/])"
CASE_ENDING = r"(?:'[a-z]{1,6}|nin|nun|in|un|da|de|ta|te|ya|ye|den|dan|ten|tan)?(?![a-z0-9])"
NAME_ENDING = r"\s+k(?:anun[a-z']*|\.)"
LABOUR_LAW = r"(?<![a-z0-9])(?<!deniz )(?<!basin )is\s?k(?:anun[a-z']*|\.|(?![a-z]))"
CONSTITUTION_WORD = r"(?<![a-z0-9])anayasa(?!l)[a-z']*(?!\s*mahkeme)"
STRONG_ARTICLE = r"\s?(?:m\.|md\.?|mad\.|madde)"
NAME_HYPHEN = r"(?<=[a-z])-(?=[a-z])"
WORD = r"[a-z0-9'][a-z0-9']*\.?"
NOT_LAW_PREFIXES = (
    "khk", "cbk", "karar", "yonetmelik", "teblig", "genelge", "tuzuk", "liste", "cetvel", "tablo", "cizelge", "kroki", "harita", "bent",
    "bend", "fikra", "madde", "sirkuler", "ozelge", "protokol", "sozlesme", "anlasma", "dosya",
)
NOT_LAW_WORDS = ("ek", "eki", "ekli", "ekte", "alt", "esas")
NOT_LAW_PAIRS = (("kanun", "hukmunde"), ("resmi", "gazete"), ("cumhurbaskanligi", "karar"))
NOT_LAW_TITLES = ("karar", "khk", "cbk", "teblig", "yonetmeli", "genelge", "tuzu", "yonerge")
LAST_WORD = r"([a-z]+)[\s,]*$"
LAST_YEAR = r"(?<![0-9])(1[89][0-9]{2}|20[0-9]{2})[\s,]*$"
AMENDED = r"(?:degisik|degistiril|eklen|ihdas|yapilan\sdegisiklik)"
WITH_ENDING = r"'?(?:yla|yle|la|le)$"

ORDINAL_END = r"(?:\s?\.(?![0-9])|\s?'?\s?(?:inci|nci|uncu|ncu)(?![a-z]))"
NUMBER = r"(?P<no>[0-9]{1,4})(?![0-9])"
SLASH = (
    r"(?:\s?/\s?(?P<part>[0-9]{1,2}(?![0-9])|[ivx]{2,5}(?![a-z])|[a-z](?![a-z]))"
    r"(?:\s?-\s?(?P<sub1>[a-z]|[0-9]{1,2})(?![a-z0-9])|\s?\(\s?(?P<sub2>[a-z]|[0-9]{1,2})\s?\))?)?"
)
ARTICLE_BEFORE = rf"(?<![a-z0-9])(?:(?P<kind>gecici|gec\.|ek|mukerrer|muk\.)\s?)?(?P<word>madde(?:si)?|md\.?|mad\.?|m\.?)\s?(?:no\s?[.:]?\s?)?{NUMBER}{SLASH}"
ARTICLE_PREFIXED = rf"(?<![a-z0-9])(?P<kind>gecici|ek|mukerrer)\s{NUMBER}{SLASH}(?P<ord>{ORDINAL_END})?(?P<word>\s?madde[a-z]*)?"
ARTICLE_AFTER = rf"(?<![0-9/.,a-z]){NUMBER}{SLASH}(?P<ord>{ORDINAL_END})?\s?madde(?P<tail>[a-z]*)"
ARTICLE_BARE = rf"(?:'[a-z]{{1,6}})?[\s,:]{{1,3}}{NUMBER}{SLASH}"
ARTICLE_WORD = r"\s?madde"
NUMBERED = r"(?:(?:numarali|nolu|no'?lu|sayili)\s)?"
PARAGRAPH_WORD = (
    r"(?<![a-z])(?P<ten>on\s?)?(?P<word>birinci|ikinci|ucuncu|dorduncu|besinci|altinci|yedinci|sekizinci|dokuzuncu|onuncu|yirminci|son)\s?fikra[a-z]*"
)
PARAGRAPH_NUMBERS = (
    rf"(?<![0-9/.,a-z])(?P<n>[0-9]{{1,2}})(?![0-9]){ORDINAL_END}\s?fikra[a-z]*",
    rf"\(\s?(?P<n>[0-9]{{1,2}})\s?\)\s?{NUMBERED}fikra[a-z]*",
    r"(?<![a-z])(?:fikra(?:si)?|fik\.|fkr\.|f\.)\s?(?:no\s?[.:]?\s?)?\(?\s?(?P<n>[0-9]{1,2})(?![0-9])\s?\)?",
)
CLAUSES = (
    rf"\(\s?(?P<n>[a-z]|[0-9]{{1,2}})\s?\)\s?{NUMBERED}ben[dt][a-z]*",
    r"(?<![a-z0-9(])(?P<n>[a-z])(?:\)\s?|\s)ben[dt][a-z]*",
    rf"(?<![0-9/.,a-z])(?P<n>[0-9]{{1,2}})(?![0-9])(?:{ORDINAL_END}|\s?(?:numarali|nolu|no'?lu))\s?ben[dt][a-z]*",
    r"(?<![a-z])(?<!alt )(?:bent|bendi|bnt\.?|b\.)\s?\(?\s?(?P<n>[a-z]|[0-9]{1,2})(?![a-z0-9])\s?\)?",
)

DOCUMENT_AFTER = r"%|sayili|sy\.|s\s?\.\s?k|numarali|nolu|no\s?'?\s?lu"
QUANTITY = (
    r"tl|lira(?:si|ya|lik)?|kurus|adet|metre|km|kg|ton|(?:kilo|mili)?gram(?:dan|a|i|lik)?|litre|m2|m3|m²|m³|metrekare|metrekup|dekar"
    r"|donum|hektar|yuzde|bin|milyon|milyar"
)
COUNTED = (
    r"yil(?:a|i|in|ina|inda|da|dan|lik|lar[a-z]*)?|sene(?:si|ye|de|den|lik)?|gun(?:u|un|e|de|den|luk|ler[a-z]*)?|hafta(?:si|ya|da|dan|lik)?"
    r"|saat(?:i|e|te|ten|lik)?|dakika(?:si|ya|da|dan|lik)?|saniye(?:si|ye|de|den|lik)?|ay(?:a|da|dan|i|in|lik)?"
    r"|is\s?gun(?:u|un|e|de|den|luk|ler[a-z]*)?|kez|defa|kere|kat(?:i|ina|ini|inda|indan|lik)?|tane|kisi(?:ye|yle|nin|den|de|ler[a-z]*)?"
    r"|cocuk(?:lu|u|un|a|lar[a-z]*)?|kardes(?:i|ler[a-z]*)?|isci(?:ye|nin|den|ler[a-z]*)?|taksit(?:le|li|te)?|donem(?:de|lik)?"
    r"|yas(?:i|ini|inin|inda|indaki[a-z]*|indan|ina)?|puan|derece|sayfa"
)
MONTHS = r"ocak|subat|mart|nisan|mayis|haziran|temmuz|agustos|eylul|ekim|kasim|aralik"
AMOUNT_AFTER = (
    rf"(?:\s?(?:{MONTHS})(?![a-z])|(?:\s?-\s?|\s(?:ila|ile|veya|ya da)\s)[0-9]+(?:[.,][0-9]+)?\s?(?:{QUANTITY}|{COUNTED})(?![a-z])"
    r"|'?\s?(?:dan|den|tan|ten)\s(?:daha\s)?(?:fazla|az|cok|ziyade|buyuk|kucuk|yuksek|dusuk|uzun|kisa)(?![a-z])"
    r"|\s(?:ve|veya|ya da)\s(?:daha\s)?(?:fazla|az|uzeri|ustu|alti)(?![a-z])|\s?(?:oran|nispet)[a-z]*"
    rf"|{ORDINAL_END}\s?(?:kitap|kitab|kisim|kism|bolum|ayirim|fasil|derece|sinif|kusak|daire|donem)[a-z]*)"
)
#: What may not follow an article number, by how strong the sign before it is.
NOT_ARTICLE = {
    "strong": rf"\s?(?:{DOCUMENT_AFTER})|[.,/][0-9]",
    "word": rf"\s?(?:{DOCUMENT_AFTER}|(?:{QUANTITY})(?![a-z]))|[.,/][0-9]",
    "weak": rf"\s?(?:{DOCUMENT_AFTER}|(?:{QUANTITY}|{COUNTED})(?![a-z]))|[.,/][0-9]|{AMOUNT_AFTER}",
}
FRACTION_AFTER = (
    r"(?:'?(?:u|i|si|su|unu|ini|sini|sunu)(?![a-z]))?\s(?:[a-z]+\s)?(?:indiri|artiri|tevkifat|cogunlu|pay|hisse|hacz|haciz|kesinti)"
)
OTHER_DOCUMENT = (
    r"(?<![a-z0-9])(?:yonetmeli[gk]|teblig|tuzu[gk]|genelge|yonerge|karar|khk|cbk|sozlesme|anlasma|protokol|sartname|aihs|teklif|tasari)"
    r"[a-z']*(?:\s(?:ilgili|anilan|soz konusu|ayni|bu|mezkur))?[\s,]*$"
)
