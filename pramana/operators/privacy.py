"""Which fields are personal, and what a shared result may show."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.terms import replaced, replaced_each, within
from ..functions.text import bind

# Words of roles, identifiers and amounts that tell personal fields.
ROLES = ["patient", "customer", "policyholder", "owner", "pensioner", "insured", "attendee", "beneficiary"]
TITLED = r"(?i)\b(dr\.|mr\.|mrs\.|ms\.|shri|smt\.|sri)\s+[A-Za-z\x{0900}-\x{0D7F}]"
ISSUED = ["referred by", "signed by", "consultant", "pathologist", "issued to", "addressed to", "beneficiary name", "beneficiary is", "name is"]
NUMBERED = ["pension", "policy", "claim", "notice", "challan", "invoice", "order", "receipt", "tax demand"]
REGISTERED = ["property id", "ward", "door no", "vehicle", "two-wheeler", "reg no", "registration", "imei", "sample id", "aadhaar", "pan", "account", "upi", "utr", "chassis", "engine"]
REGISTERED_TO_CLIENTS = ["folio", "case no"]
REFERRED = ["ref:", "reference:", "id:", "id is", "id number"]
HINDI = ["पेंशन", "पॉलिसी", "दावा", "चालान", "पहचान", "खाता", "पंजीकरण", "वाहन", "लाभार्थी"]
TAMIL = ["ஓய்வூதிய", "பாலிசி", "கோரிக்கை", "விலாசம்", "அடையாள", "வங்கி கணக்கு", "வாகன", "பயனாளி"]
TELUGU = ["పెన్షన్", "పాలసీ", "క్లెయిమ్", "చలాన్", "ఖాతా", "రిజిస్ట్రేషన్", "లబ్ధిదారు"]
MARATHI = ["पेन्शन", "पॉलिसी", "दावा", "नोंदणी", "खाते"]
AMOUNTS = ["monthly pension", "pension", "amount", "total", "due", "rebate", "fine", "fee", "tax"]
REFERENCES = ["id", "no", "number", "num", "ref", "oap", "sh/", "clm", "anm", "ech", "sme", "cd-", "smt", r"mr\.", r"mrs\."]
# What client devices count besides (places of samples left out).
ADDRESSED = ["address", "cross", "ward", "door no", "pincode"]
CALLED = [r"\+91", "ph:", "phone:", "tel:", "mobile:", r"080\s*\d{4}\s*\d{4}"]
PHONES = [r"\b\d{4}[-\s]\d{3}[-\s]\d{4}\b", r"\b\d{10}\b"]
AGED = [r"\b\d{2}\s*y\s*/\s*[mf]\b", r"\b\d{2}\s*/\s*[mf]\b"]
BORN = ["date of birth", "birth date", r"d\.o\.b\.", "dob", "born on", r"जन्म\s*तिथि", "जन्मतिथि", r"பிறந்த\s*தேதி"]
MAILED = r"@\w+\.\w+"
ID_TOKEN = (
    r"(?i)\b(?!(?:19|20)\d{2}[-/]\d{2}[-/]\d{2}\b)(?!\d{1,2}[-/]\d{1,2}[-/](?:19|20)\d{2}\b)(?!(?:\d{1,2}[-/])?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*[-/]\d{2,4}\b)"
    r"(?=(?:[A-Za-z0-9/_-]*\d){3,})(?=[A-Za-z0-9/_-]*[A-Za-z])[A-Za-z0-9]+(?:[/-][A-Za-z0-9_-]+)+\b"
)


def _words(words: list[str]) -> str:
    return rf"\b({'|'.join(words)})\b"


#: The rules of a personal field: what it looks at (text, or text and quote in lower case), a pattern, and whether a plain amount or date outweighs it.
RULES = [
    ("both", _words(ROLES), False), ("text", TITLED, False), ("both", _words(ISSUED), False), ("both", _words(NUMBERED), True), ("both", _words(REGISTERED), True),
    ("both", rf"\b({'|'.join(REFERRED)})", True), ("text", "|".join([*HINDI, *TAMIL, *TELUGU, *MARATHI]), True), ("text", ID_TOKEN, False), ("quote", ID_TOKEN, False), ("text", r"\b\d{8,}\b", False),
]
CLIENT_RULES = [
    *RULES, ("both", _words(REGISTERED_TO_CLIENTS), True), ("both", _words(ADDRESSED), False), ("both", _words(CALLED), False), *(("text", p, False) for p in PHONES), *(("both", p, False) for p in AGED),
    ("both", _words(BORN), False), ("text", MAILED, False),
]
PLAIN = rf"^\s*({'|'.join(AMOUNTS)})\s*(amount|is|of)?\s*:?\s*(rs\.?|₹|\d|due date|date)"


def personal_field(text: Column, quote: Column, explicit: Column | None = None, rules: list[tuple[str, str, bool]] = RULES) -> Column:
    """Whether a field names a person or a number of theirs; plain amounts do not count. `explicit`: marked so already."""
    quote = F.coalesce(quote, F.lit(""))
    parts = {"text": text, "quote": quote, "both": F.lower(F.concat_ws(" ", text, quote))}
    hit = lambda weak: reduce(or_, (parts[of].rlike(p) for of, p, may_yield in rules if may_yield is weak))
    begins = parts["both"] if rules is RULES else F.lower(text)
    plain = begins.rlike(PLAIN) & ~parts["both"].rlike("|".join(REFERENCES))
    found = F.when(F.coalesce(text, F.lit("")) == "", False).otherwise(hit(False) | (hit(True) & ~plain))
    return found if explicit is None else F.coalesce(explicit, F.lit(False)) | found


def expanded_terms(terms: Column, rendered: Column, institutions: Column) -> Column:
    """Protected terms with their renderings, each once, in order, without institutions."""
    all_ = F.array_distinct(F.concat(terms, F.flatten(F.map_values(rendered))))
    return F.filter(all_, lambda t: ~F.array_contains(institutions, t) & (F.trim(t) != ""))


def dates_and_amounts(texts: Column) -> Column:
    """The different dates and amounts of all texts, in order of appearance."""
    pattern = r"(?i)\d{4}-\d{2}-\d{2}|\d{1,2}[./-]\d{1,2}[./-]\d{4}|(?:₹|Rs\.?|INR)\s*\d[\d,]*(?:\.\d+)?"
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))))


def mask_name(t: Column) -> Column:
    """Each word of a name by its first letter; titles and initials stay."""
    word = lambda w: F.when(w.rlike(r"(?i)^(mr|mrs|ms|dr|shri|smt)\.?$|^[A-Z]\.?$"), w).otherwise(F.concat(F.regexp_extract(w, r"^\X", 0), F.repeat(F.lit("*"), F.greatest(F.length(w) - F.length(F.regexp_extract(w, r"^\X", 0)), F.lit(1)))))
    return F.array_join(F.transform(F.split(F.trim(t), r"\s+"), word), " ")


def with_names_masked(t: Column, names: Column) -> Column:
    """The text with every name masked, longest first; the text is walked once for all names."""
    return replaced(t, F.filter(names, lambda n: F.trim(n) != ""), lambda p: mask_name(p["term"]))


def with_all_names_masked(texts: Column, names: Column) -> Column:
    """Every text of an array with every name masked."""
    return replaced_each(texts, F.filter(names, lambda n: F.trim(n) != ""), lambda p: mask_name(p["term"]))


def leaks(secrets: Column, *channels: Column) -> Column:
    """How many of a document's secrets (an array) stand in its channels (texts), counted for each channel: one pass a text, within the row."""
    there = {f"c{i}": within(text, secrets) for i, text in enumerate(channels)}
    one = lambda x, c: F.size(F.filter(x["all"], lambda s: F.array_contains(x[c], s)))
    return bind(lambda x: reduce(add, (one(x, c) for c in there)), all=secrets, **there)
