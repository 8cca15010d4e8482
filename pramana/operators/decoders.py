"""Decoders of prescriptions, lab ranges and document kinds, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bind

# When a medicine is taken.
FOOD_TIMINGS = ["before_food", "after_food", "at_bedtime"]
# Frequency codes, their words and dose times, in the order of precedence.
FREQUENCIES = [
    ("SOS", "SOS|PRN|AS NEEDED|WHEN REQUIRED", []),
    ("HS", "HS|BEDTIME|AT BEDTIME|AT NIGHT", ["bedtime"]),
    ("QID", "QID|FOUR TIMES A DAY|4 TIMES A DAY", ["morning", "afternoon", "evening", "night"]),
    ("TDS", "TDS|TID|THRICE DAILY|THREE TIMES A DAY|3 TIMES A DAY", ["morning", "afternoon", "night"]),
    ("BD", "BD|BID|TWICE DAILY|TWICE A DAY|2 TIMES A DAY", ["morning", "night"]),
    ("OD", "OD|QD|ONCE DAILY|ONCE A DAY|1 TIME A DAY", ["morning"]),
]
# Frequencies that are not daily, and doses written as 1-0-1.
NOT_DAILY = r"\b(ONCE\s+A\s+WEEK|WEEKLY|ALTERNATE\s+DAYS?|EVERY\s+OTHER\s+DAY)\b"
DOSES = r"\b(\d+)\s*[-/]\s*(\d+)\s*[-/]\s*(\d+)(?:\s*[-/]\s*(\d+))?\b"
# Words of each kind of document, in the order in which they are tried.
CUES = [
    ("lab_report", ["lab report", "reference range", "pathologist", "haemoglobin", "hemoglobin", "cbc"]),
    ("prescription", ["prescription", " rx", "tab.", "cap.", "bd", "tds", "1-0-1"]),
    ("discharge_summary", ["discharge summary", "advice on discharge", "admission"]),
    ("hospital_bill", ["hospital bill", "room charges", "ip bill", "op bill"]),
    ("utility_bill", ["electricity", "units consumed", "water bill", "gas bill"]),
    ("telecom_bill", ["broadband", "mobile bill", "data plan"]),
    ("pension_notice", ["pension", "life certificate", "jeevan pramaan", "ppo"]),
    ("tax_notice", ["property tax", "demand notice", "assessment", "rebate"]),
    ("challan", ["e-challan", "echallan", "offence", "virtual court"]),
    ("court_legal", ["summons", "plaintiff", "defendant", "hearing", "case no"]),
    ("invoice", ["tax invoice", "gstin", "hsn", "cgst", "warranty"]),
    ("insurance", ["sum insured", "premium", "claim", "policy"]),
    ("investment", ["mutual fund", "folio", "nav", "sip", "demat", "ppf"]),
    ("loan", ["emi", "sanction", "interest rate", "foreclosure", "tenure"]),
    ("bank_statement", ["account statement", "opening balance", "closing balance"]),
    ("salary_slip", ["salary", "net pay", "earnings", "deductions"]),
    ("agreement", ["rental", "lease", "lock-in", "notice period", "tenant", "lessor"]),
    ("form", ["fill in", "block letters", "application form", "account opening"]),
    ("school", ["school", "college", "report card", "tuition"]),
    ("receipt", ["received with thanks", "payment receipt"]),
    ("government_notice", ["hereby informed", "government of"]),
]


def medicine_frequency(raw: Column, printed_food: Column | None = None, printed_days: Column | None = None) -> Column:
    """(code, slots, food, days, decoded) of a printed frequency; food and days that are printed elsewhere may be given."""
    text, upper = F.trim(raw), F.upper(F.trim(raw))
    texts = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    food = (
        F.when(text.rlike(r"(?i)\b(before\s+(food|meals?)|ac|empty\s+stomach)\b"), "before_food")
        .when(text.rlike(r"(?i)\b(after\s+(food|meals?)|pc)\b"), "after_food")
        .when(text.rlike(r"(?i)\b(at\s+bedtime|bedtime)\b"), "at_bedtime")
    )
    if printed_food is not None:
        food = F.when(printed_food.isin(FOOD_TIMINGS), printed_food).when(F.contains(F.lower(printed_food), F.lit("bedtime")), "at_bedtime").otherwise(food)
    span = r"(?i)(?:x\s*|for\s*)(\d+)\s*(days?|d\b|weeks?|w\b|months?|m\b)"
    n, unit = F.regexp_extract(text, span, 1).try_cast("int"), F.lower(F.substring(F.regexp_extract(text, span, 2), 1, 1))
    days = F.when(unit == "w", n * 7).when(unit == "m", n * 30).otherwise(n)
    if printed_days is not None:
        days = F.coalesce(days, printed_days)
    doses = [F.regexp_extract(text, DOSES, i) for i in range(1, 5)]
    taken = [d.try_cast("int") > 0 for d in doses]
    last = F.when(text.rlike(r"(?i)\b(bedtime|hs)\b") | (food == "at_bedtime"), "bedtime").otherwise("night")
    three = F.array(F.when(taken[0], "morning"), F.when(taken[1], "afternoon"), F.when(taken[2], last))
    four = F.array(*(F.when(t, name) for t, name in zip(taken, ["morning", "afternoon", "evening", "night"], strict=True)))
    by_doses = F.filter(F.when(doses[3] == "", three).otherwise(four), lambda x: x.isNotNull())
    code = F.when(upper.rlike(NOT_DAILY), text).when(doses[0] != "", F.array_join(F.filter(F.array(*doses), lambda d: d != ""), "-"))
    slots = F.when(upper.rlike(NOT_DAILY), texts([])).when(doses[0] != "", by_doses)
    decoded = F.when(upper.rlike(NOT_DAILY), False).when(doses[0] != "", True)
    for name, words, times in FREQUENCIES:
        hit = upper.rlike(rf"\b({words.replace(' ', chr(92) + 's+')})\b")
        code, slots, decoded = code.when(hit, name), slots.when(hit, texts(times)), decoded.when(hit, True)
    blank = F.coalesce(text, F.lit("")) == ""
    return F.struct(
        F.when(blank, "").otherwise(code.otherwise(text)).alias("code"),
        F.when(blank, texts([])).otherwise(slots.otherwise(texts([]))).alias("slots"),
        F.when(~blank, food).alias("food"),
        (F.when(~blank, days) if printed_days is None else F.when(blank, printed_days).otherwise(days)).alias("days"),
        F.when(blank, False).otherwise(decoded.otherwise(False)).alias("decoded"),
    )


# Numbers, names of bands and bounds of printed ranges.
_NUMBER = r"\d[\d,]*(?:\.\d+)?"
_BAND = r"very\s+high|borderline(?:\s+high)?|near(?:\s+to)?(?:\s+above)?\s*optimal|desirable|optimal|normal|sufficiency|sufficient|deficiency|deficient|insufficiency|toxicity|toxic|high|low"
_UPPER, _LOWER = r"(?i)(<=|≤|<|below|less than)\s*(" + _NUMBER + ")", r"(?i)(>=|≥|>|above|more than)\s*(" + _NUMBER + ")"
_INTERVAL = rf"(?i)({_NUMBER})\s*(?:–|-|to)\s*({_NUMBER})"


def _number(t: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(t, ",", ""), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def _bound(clause: Column) -> Column:
    """(low, high, low_open, high_open) of a printed range; null if there is none."""
    part = lambda p, i: F.regexp_extract(clause, p, i)
    none, no = F.lit(None).cast("double"), F.lit(False)

    def bound(low: Column, high: Column, low_open: Column, high_open: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"), low_open.alias("low_open"), high_open.alias("high_open"))

    return (
        F.when(part(_INTERVAL, 1) != "", bound(_number(part(_INTERVAL, 1)), _number(part(_INTERVAL, 2)), no, no))
        .when(part(_UPPER, 2) != "", bound(none, _number(part(_UPPER, 2)), no, F.lower(part(_UPPER, 1)).isin("<", "below", "less than")))
        .when(part(_LOWER, 2) != "", bound(_number(part(_LOWER, 2)), none, F.lower(part(_LOWER, 1)).isin(">", "above", "more than"), no))
    )


def _over(v: Column, b: Column) -> Column:
    return F.coalesce(F.when(b["high_open"], v >= b["high"]).otherwise(v > b["high"]), F.lit(False))


def _under(v: Column, b: Column) -> Column:
    return F.coalesce(F.when(b["low_open"], v <= b["low"]).otherwise(v < b["low"]), F.lit(False))


def lab_value(value: Column, range_: Column, flag: Column) -> Column:
    """(label, outside): the printed flag, else the narrowest of two or more named bands, else the plain range; null without a decision."""
    made = lambda label, outside: F.struct(label.alias("label"), outside.alias("outside"))
    mark = F.lower(F.trim(F.coalesce(flag, F.lit(""))))
    printed = (
        F.when(mark.isin("high", "h", "↑", "⬆"), made(F.lit("High"), F.lit(True)))
        .when(mark.isin("low", "l", "↓", "⬇"), made(F.lit("Low"), F.lit(True)))
        .when(mark.rlike(r"^in\s*range$"), made(F.lit("In range"), F.lit(False)))
    )
    prose = lambda t: t.rlike("(?i)impairment|indicative|suggestive") & ~t.rlike(f"(?i){_BAND}")
    pattern = F.lit(rf"(?i)({_BAND})\s*:?\s*([^\n;]+)")
    width = lambda b: F.coalesce(F.greatest(b["high"] - b["low"], F.lit(0.0)) + (b["low"] * 0), F.lit(1e6))

    def by_band(x: Column) -> Column:
        """x: the value v and the bands (name, b)."""
        fitting = F.filter(x["bands"], lambda y: ~_over(x["v"], y["b"]) & ~_under(x["v"], y["b"]))
        best = F.array_min(F.transform(fitting, lambda y: F.struct(width(y["b"]).alias("w"), y["i"].alias("i"), y["name"].alias("name"))))
        odd = lambda name: name.rlike("(?i)high|low|deficien|insufficien|toxic|borderline") & ~name.rlike("(?i)near")
        return bind(lambda y: F.when(y["best"].isNotNull() & (F.size(x["bands"]) >= 2), made(y["best"]["name"], odd(y["best"]["name"]))), best=best)

    def by_range(x: Column) -> Column:
        """x: the value v, the text of the range, and its bound b."""
        decided = F.when(_over(x["v"], x["b"]), made(F.lit("Above range"), F.lit(True))).when(_under(x["v"], x["b"]), made(F.lit("Below range"), F.lit(True))).otherwise(made(F.lit(""), F.lit(False)))
        return F.when(~prose(x["text"]) & x["b"].isNotNull(), decided)

    def decide(x: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(x["text"], pattern, F.lit(1)).alias("name"), F.regexp_extract_all(x["text"], pattern, F.lit(2)).alias("clause"))
        bands = F.transform(F.filter(pairs, lambda y: ~prose(y["clause"])), lambda y, i: F.struct(F.initcap(F.trim(y["name"])).alias("name"), i.alias("i"), _bound(y["clause"]).alias("b")))
        found = F.coalesce(bind(by_band, v=x["v"], bands=F.filter(bands, lambda y: y["b"].isNotNull())), bind(by_range, v=x["v"], text=x["text"], b=_bound(x["text"])))
        return F.coalesce(x["printed"], F.when((x["text"] != "") & x["v"].isNotNull(), found))

    return bind(decide, printed=printed, v=_number(value), text=F.trim(F.coalesce(range_, F.lit(""))))


def _cue(text: Column, word: str) -> Column:
    if " " in word or len(word) > 4:
        return F.contains(text, F.lit(word))
    plain = "".join(f"\\{c}" if not c.isalnum() else c for c in word)
    return text.rlike(rf"(?:^|[^a-z0-9]){plain}(?:[^a-z0-9]|$)")


# The kind that a coarse document type stands for.
TYPE_KINDS = {
    "utility_bill": "utility_bill", "telecom_bill": "telecom_bill", "tax_receipt": "tax_notice", "insurance": "insurance", "bank": "bank_statement", "government_notice": "government_notice", "court_legal": "court_legal", "challan": "challan",
    "medical": "lab_report", "lab_report": "lab_report", "receipt": "receipt", "agreement": "agreement", "corporate": "corporate", "school": "school", "form": "form", "prescription": "prescription", "investment": "investment",
}


def document_kind(given: Column, text: Column, medicines: Column, sections: Column, type_: Column | None = None) -> Column:
    """The kind of a document: as given, else by what it holds, else by its words in order, else by its coarse type, else other."""
    text = F.lower(F.coalesce(text, F.lit("")))
    known = F.lower(F.coalesce(given, F.lit("")))
    kind = (
        F.when(known.isin([k for k, _ in CUES] + ["corporate", "other"]), known)
        .when(F.contains(text, F.lit("discharge summary")) | F.contains(text, F.lit("advice on discharge")), "discharge_summary")
        .when((medicines > 0) & (sections == 0), "prescription")
        .when(sections > 0, "lab_report")
    )
    for name, words in CUES:
        hit = _cue(text, words[0])
        for word in words[1:]:
            hit = hit | _cue(text, word)
        kind = kind.when(hit, name)
    if type_ is not None:
        coarse = F.lower(F.coalesce(type_, F.lit("")))
        kind = kind.when((medicines > 0) & (coarse == "medical"), "prescription")
        for name, found in TYPE_KINDS.items():
            kind = kind.when(coarse == name, found)
    return kind.otherwise("other")


def filter_group(kind: Column, title: Column) -> Column:
    """The library group of a document type."""
    kind = F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(kind.isin("medical", "lab_report", "prescription"), "health")
        .when(kind.isin("insurance", "bank", "receipt", "investment") | F.coalesce(title, F.lit("")).rlike("(?i)pension"), "money")
        .when(kind.isin("utility_bill", "telecom_bill", "tax_receipt", "challan"), "bills")
        .when(kind == "government_notice", "notices")
        .when(kind.isin("court_legal", "agreement"), "legal")
        .when(kind == "form", "forms")
    )
