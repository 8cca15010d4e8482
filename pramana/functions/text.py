"""Text and number kernels as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The digit sets that evidence matching folds (five scripts).
EVIDENCE_DIGITS = ["०१२३४५६७८९", "௦௧௨௩௪௫௬௭௮௯", "౦౧౨౩౪౫౬౭౮౯", "೦೧೨೩೪೫೬೭೮೯", "൦൧൨൩൪൫൬൭൮൯"]
# The digit sets that masking folds (seven scripts).
MASKING_DIGITS = [*EVIDENCE_DIGITS, "০১২৩৪৫৬৭৮৯", "୦୧୨୩୪୫୬୭୮୯"]
# Code points of the scripts of the languages with a script check.
SCRIPTS = {"ta": (0x0B80, 0x0BFF), "hi": (0x0900, 0x097F), "mr": (0x0900, 0x097F), "te": (0x0C00, 0x0C7F), "ml": (0x0D00, 0x0D7F), "kn": (0x0C80, 0x0CFF), "bn": (0x0980, 0x09FF)}
# Words of offices and posts that are no names by themselves.
OFFICE_WORDS = [
    "department", "cell", "manager", "officer", "office", "division", "clause", "section", "desk", "team", "dept", "claim", "claims", "grievance",
    "grievances", "redressal", "complaint", "complaints", "service", "services", "support", "care", "customer", "helpdesk", "helpline", "unit",
    "branch", "center", "centre", "committee", "board", "group", "bureau", "wing", "agency", "council", "admin", "administration", "executive",
    "supervisor", "lead", "head", "director", "assistant", "associate", "coordinator", "representative", "agent", "specialist", "advisor", "clerk",
    "staff", "operations", "audit", "billing", "legal", "finance", "accounts", "underwriting", "subclause", "part", "page", "and", "of", "the", "for",
    "in", "at", "to",
]
# Patterns of amounts, dates and phone numbers in running text (Java syntax).
AMOUNT = r"(?i)(?:Rs\.?|₹|INR)\s*[\p{Nd},]+(?:\.\p{Nd}+)?"
DATE_IN_TEXT = r"(?i)(?:\b\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}\b)"
PHONE_IN_TEXT = r"(?:\+91[\s-]?)?(?:1800[\s-]?\d{3}[\s-]?\d{3,4}|\b\d{2,4}[-\s]\d{3,4}[-\s]\d{4}\b)"


def collapse(t: Column) -> Column:
    """Runs of white space (of any script) to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def _fold(t: Column, sets: list[str]) -> Column:
    return F.translate(t, "".join(sets), "0123456789" * len(sets))


def fold_evidence_digits(t: Column) -> Column:
    """The five digit sets of evidence matching to 0-9."""
    return _fold(t, EVIDENCE_DIGITS)


def fold_masking_digits(t: Column) -> Column:
    """The seven digit sets of masking to 0-9."""
    return _fold(t, MASKING_DIGITS)


@lru_cache(maxsize=1)
def _decimal_digits() -> tuple[str, str]:
    found = [c for i in range(128, 0x110000) if unicodedata.category(c := chr(i)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def fold_all_digits(t: Column) -> Column:
    """Every decimal digit of Unicode to 0-9."""
    return F.translate(t, *_decimal_digits())


def bind(make, **values: Column) -> Column:
    """make(x), where x holds the values by name: each is computed once, also if `make` uses it inside a function of array elements."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), make), F.lit(0))


def strip_grouping(t: Column) -> Column:
    """Commas between digits removed."""
    return F.regexp_replace(t, r"(?<=\d),(?=\d)", "")


@F.pandas_udf(StringType())
def _nfkc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _nfc(t: pd.Series) -> pd.Series:
    return t.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def evidence_form(t: Column, unicode_forms: bool = True) -> Column:
    """The form in which quotes are looked up in pages.

    unicode_forms: also apply NFKC, which Spark has only as a pandas UDF; leave
    it out for texts known to be in that form.
    """
    t = F.coalesce(t, F.lit(""))
    if unicode_forms:
        t = _nfkc(t)
    t = fold_evidence_digits(F.regexp_replace(t, "[­​‌‍﻿]", ""))
    t = F.regexp_replace(t, r"([\p{L}\p{N}_])-\s*[\r\n]+\s*([\p{L}\p{N}_])", "$1$2")
    t = F.regexp_replace(t, r"(?i)(?:\bRs\.?|\bINR|₹|ரூ\.?|रु\.?)(?=\s*\d|\b)", "₹")
    t = F.regexp_replace(t, r"₹\s+", "₹")
    t = F.regexp_replace(strip_grouping(t), r"(?<=\d)\.00(?!\d)", "")
    t = F.regexp_replace(t, r"(?<=\d)/(?=\d)", "-")
    return F.lower(collapse(F.regexp_replace(t, r"(?i)\b(lacs?|lakhs?)\b", "lakh")))


def guard_form(t: Column) -> Column:
    """The form in which translations are compared: digits folded, currency signs made one, grouping removed."""
    t = fold_all_digits(F.coalesce(t, F.lit("")))
    t = F.regexp_replace(t, r"(?i)(?:\bRs\.?|\bINR|₹|ரூ\.?|रु\.?|రూ\.?|ರೂ\.?|രൂ\.?|৳)(?=\s*\d|\b)", "₹")
    return strip_grouping(t)


def term_form(t: Column) -> Column:
    """The form in which protected terms are compared."""
    return F.lower(collapse(_nfc(F.coalesce(t, F.lit("")))))


def _all(t: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(pattern), F.lit(0))


def critical_tokens(t: Column) -> Column:
    """Amounts, then dates, then phone numbers of a text."""
    found = F.concat(_all(t, AMOUNT), _all(t, DATE_IN_TEXT), _all(t, PHONE_IN_TEXT))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def numbers(t: Column) -> Column:
    """All numbers, after folding and without grouping."""
    return _all(strip_grouping(fold_evidence_digits(t)), r"\b\d+(?:\.\d+)?\b")


def digit_runs(t: Column) -> Column:
    """Runs of digits in the form that guards compare."""
    return _all(guard_form(t), r"\d+")


def protected_terms(terms: Column) -> Column:
    """Terms that are more than office words: trimmed, blank ones dropped."""
    words = F.array(*map(F.lit, OFFICE_WORDS))

    def kept(term: Column) -> Column:
        found = _all(F.lower(term), "[a-z]+")
        office = (F.size(found) > 0) & F.forall(found, lambda w: F.array_contains(words, w))
        return (F.trim(term) != "") & (term.rlike(r"\p{Nd}") | ~office)

    return F.transform(F.filter(F.coalesce(terms, F.array().cast("array<string>")), kept), lambda x: F.trim(x))


def terms_form(terms: Column) -> Column:
    """An array of terms, each in the form in which terms are compared."""
    return F.split(term_form(F.array_join(terms, "\u0001")), " ?\u0001 ?")


def script_share(t: Column, lang: str) -> Column:
    """Share of letters in the script of `lang`; 1 without letters or without a script to check."""
    if lang not in SCRIPTS:
        return F.lit(1.0)
    low, high = SCRIPTS[lang]
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    own = F.regexp_count(t, F.lit(f"(?=[\\x{{{low:x}}}-\\x{{{high:x}}}])\\p{{L}}"))
    return F.when(letters == 0, F.lit(1.0)).otherwise(own / letters)


def title_heading(t: Column) -> Column:
    """A heading in capitals (three letters, 70 % capitals) with only first letters capital."""
    letters, capitals = F.regexp_count(t, F.lit("[A-Za-z]")), F.regexp_count(t, F.lit("[A-Z]"))
    words = F.split(F.lower(t), "(?<=[^a-z0-9])(?=[a-z])")
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
    return F.when((letters < 3) | (capitals / letters < 0.7), t).otherwise(titled)


def indian_grouping(n: Column) -> Column:
    """Digits grouped as 12,34,567."""
    return F.regexp_replace(n, r"(?<=\d)(?=(\d\d)*\d{3}$)", ",")


def shorten(t: Column, n: int = 60) -> Column:
    """At most n characters, an ellipsis for what is left out."""
    t = F.trim(t)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…")))


def rolling_hash(t: Column) -> Column:
    """A 32-bit hash (times 31 plus code) as 8 hex digits."""
    codes = F.transform(F.split(t, ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + c, F.lit(1 << 32)))
    return F.lower(F.lpad(F.hex(total), 8, "0"))


def client_address(forwarded: Column, peer: Column) -> Column:
    """The last entry of a forwarding header that is not blank, else the peer, else unknown."""
    entries = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x)), lambda e: e != "")
    return F.coalesce(F.try_element_at(entries, F.lit(-1)), F.nullif(peer, F.lit("")), F.lit("unknown"))


def phone_digits(t: Column) -> Column:
    """The trimmed text if it holds 7 to 13 digits, else null."""
    n = F.length(F.regexp_replace(fold_evidence_digits(t), r"\D", ""))
    return F.when(n.between(7, 13), F.trim(t))


def money_value(kind: Column, value: Column) -> Column:
    """Whether a printed value is an amount of money."""
    signed = value.rlike(r"(?i)[₹]|Rs\.?|INR")
    plain = F.regexp_replace(value, r"(?i)Rs\.?|INR", "")
    number = F.regexp_replace(value, r"[^\d.]", "").try_cast("double")
    return (kind != "date") & ((kind == "amount") | signed) & ~plain.rlike("[A-Za-z]") & (F.regexp_count(value, F.lit(",")) <= 2) & F.coalesce(number > 0, F.lit(False))


def mask_id(t: Column) -> Column:
    """An id with only its last three letters or digits in sight; separators and a leading word stay."""
    lead = F.regexp_extract(t, r"^[A-Za-z]+[^A-Za-z0-9]", 0)
    rest = F.substr(t, F.length(lead) + 1)
    return F.concat(lead, F.regexp_replace(rest, "[A-Za-z0-9](?=(?:[^A-Za-z0-9]*[A-Za-z0-9]){3})", "*"))


def mask_email(t: Column) -> Column:
    """The first letter and the last part of the domain."""
    return F.concat(F.regexp_extract(t, r"^\X", 0), F.lit("***@****."), F.regexp_extract(t, r"([^.]*)$", 1))
