"""Texts made ready to be read aloud: sentences, chunks, words for short forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import MONTHS
from .languages import SPOKEN_MONTHS, natural_dates, replace_each

# Short forms whose full stop ends no sentence.
SHORT_FORMS = ["Dr", "Mr", "Mrs", "Ms", "Rs", "No", "St", "Prof", "Shri", "Smt", "vs", "etc"]
_DOT = "\u0001"


def sentences(t: Column) -> Column:
    """Sentences of a text: stops in numbers, short forms, initials, e.g. and i.e. end none; danda marks do."""
    t = F.regexp_replace(t, r"(?<=\d)\.(?=\d)", _DOT)
    t = F.regexp_replace(t, rf"\b({'|'.join(SHORT_FORMS)})\.", f"$1{_DOT}")
    t = F.regexp_replace(t, r"(?i)\b(e|i)\.(g|e)\.", f"$1{_DOT}$2{_DOT}")
    t = F.regexp_replace(t, r"\b([A-Z])\.(?=\s*[A-Z])", f"$1{_DOT}")
    parts = F.transform(F.split(t, r"(?<=[.!?।॥\n])\s+"), lambda s: F.trim(F.replace(s, F.lit(_DOT), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def up_to(parts: Column, n: int) -> Column:
    """The first sentences, joined by blanks, that fit in n characters; stops at the first that does not."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def add(a: Column, s: Column) -> Column:
        longer = F.trim(F.concat_ws(" ", a["out"], s))
        stop = a["full"] | (F.length(longer) > n)
        return F.struct(F.when(stop, a["out"]).otherwise(longer).alias("out"), stop.alias("full"))

    return F.aggregate(parts, start, add)["out"]


def chunks(t: Column, n: int = 180) -> Column:
    """Words gathered into chunks of at most n characters; a longer word is a chunk of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(a: Column, w: Column) -> Column:
        longer = F.when(a["open"] == "", w).otherwise(F.concat_ws(" ", a["open"], w))
        fits = (F.length(longer) <= n) | (a["open"] == "")
        return F.struct(F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"), F.when(fits, longer).otherwise(w).alias("open"))

    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    return F.aggregate(words, start, add, lambda a: F.filter(F.concat(a["done"], F.array(a["open"])), lambda x: x != ""))


# Words for rupees, lakh, crore and doctor, by language.
RUPEES = {"en": "rupees", "ta": "ரூபாய்", "hi": "रुपये", "te": "రూపాయలు", "ml": "രൂപ", "kn": "ರೂಪಾಯಿ"}
LAKH = {"en": "lakh", "ta": "லட்சம்", "hi": "लाख", "te": "లక్ష", "ml": "ലക്ഷം", "kn": "ಲಕ್ಷ"}
CRORE = {"en": "crore", "ta": "கோடி", "hi": "करोड़", "te": "కోటి", "ml": "കോടി", "kn": "ಕೋಟಿ"}
DOCTOR = {"en": "Doctor", "ta": "டாக்டர்", "hi": "डॉक्टर", "te": "డాక్టర్", "ml": "ഡോക്ടർ", "kn": "ಡಾಕ್ಟರ್"}
_SIGN = r"(?:Rs\.?|INR|₹|ரூ\.?|रु\.?)"


def spoken(t: Column, lang: str = "en") -> Column:
    """Titles, amounts and dates in full words of a language; dates keep their digits where months are not spoken."""
    code = lang.lower().split("-")[0]
    word = lambda words: words.get(code, words["en"])
    rupees = word(RUPEES)
    t = F.regexp_replace(t, r"\bDr\.?(?=\s+\p{L})", word(DOCTOR))
    t = F.regexp_replace(t, r"\b([A-Z])\.(?=\s+[A-Z][a-z])", "$1")
    for unit, name in (("lacs?|lakhs?", word(LAKH)), (r"crores?|cr\b", word(CRORE))):
        t = F.regexp_replace(t, rf"(?i){_SIGN}\s*(\b\d+(?:\.\d+)?)\s*(?:{unit})", f"$1 {name} {rupees}")
    for unit, name in (("lacs?|lakhs?", word(LAKH)), ("crores?", word(CRORE))):
        t = F.regexp_replace(t, rf"(?i)\b(\d+(?:\.\d+)?)\s*(?:{unit})\b(?! {rupees})", f"$1 {name} {rupees}")
    t = F.regexp_replace(t, rf"(?i){_SIGN}\s*([\d,]+(?:\.\d+)?)", f"$1 {rupees}")
    t = F.regexp_replace(t, r"(?i)([\d,]+(?:\.\d+)?)\s*(?:Rs\.?|INR|ரூ\.?|रु\.?)(?!\p{L})", f"$1 {rupees}")
    months = {"en": [m.capitalize() for m in MONTHS]} | {k: SPOKEN_MONTHS[k] for k in ("ta", "hi")}

    def day(m: Column) -> Column:
        part = lambda i: F.get(F.split(m, "[./-]"), F.lit(i)).cast("int")
        fine = part(0).between(1, 31) & part(1).between(1, 12) & part(2).between(1900, 2100)
        named = F.concat_ws(" ", part(0).cast("string"), F.get(F.array(*map(F.lit, months.get(code, months["en"]))), part(1) - 1), part(2).cast("string"))
        plain = F.format_string("%02d-%02d-%d", part(0), part(1), part(2))
        return F.when(fine, named if code in months else plain).otherwise(m)

    t = replace_each(t, r"\b\d{1,2}[./-]\d{1,2}[./-]\d{4}\b", day)
    return F.trim(F.regexp_replace(natural_dates(t, code), r"[ \t]+", " "))
