"""Which blocks and layout a result shows, by its kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coarse type, specific blocks, family of starter questions, and layout of each kind of document.
COMMON = ["simpleWords", "actions", "watchOut", "places", "facts"]
SPECIFIC = {
    "government_notice": ["directions"], "pension_notice": [], "tax_notice": ["waysToPay"], "challan": ["howToContest"], "court_legal": ["consequence"], "utility_bill": [], "telecom_bill": [],
    "invoice": ["items", "warranty"], "receipt": [], "insurance": [], "lab_report": ["sections", "notADiagnosis"], "prescription": ["medicines"], "discharge_summary": ["diagnosis", "medicines", "advice"],
    "hospital_bill": ["items"], "investment": [], "bank_statement": [], "salary_slip": [], "loan": ["nextEmi", "loanTerms"], "agreement": ["keyTerms", "timeline"], "form": ["formSteps"], "school": [], "corporate": [], "other": [],
}
ASK_FAMILIES = {
    "lab": ["lab_report", "discharge_summary"], "rx": ["prescription"], "bill": ["utility_bill", "telecom_bill", "receipt"], "gov": ["government_notice", "pension_notice", "tax_notice"],
    "legal": ["court_legal", "challan"], "money": ["bank_statement", "insurance", "investment", "loan", "salary_slip"], "invoice": ["invoice"], "form": ["form"],
}
#: Fields of a profile that hold a text, those that hold lists, and lists of a result: what `presence` looks at.
TEXTS = ["consequence", "warranty_until", "diagnosis_as_written", "tenure", "loan_account", "outstanding", "interest_rate", "next_emi_date", "emi_amount", "rent_or_price", "deposit", "lock_in", "notice_period", "term", "start_date", "end_date", "follow_up", "premium", "paid_or_due"]
LISTS = ["directions", "how_to_pay", "line_items", "advice_lines", "charges", "form_fields", "deduction_reasons", "summary", "actions", "warnings", "places", "contacts", "facts", "medicines"]


def ask_family(kind: Column) -> Column:
    """The family of starter questions."""
    found = F.lit("generic")
    for family, kinds in ASK_FAMILIES.items():
        found = F.when(kind.isin(kinds), family).otherwise(found)
    return found


def starter_chips(kind: Column) -> Column:
    """The three starter questions of a kind, as keys of words: askLab1 and so on."""
    family = F.concat(F.lit("ask"), F.initcap(ask_family(kind)))
    return F.transform(F.array(*map(F.lit, "123")), lambda i: F.concat(family, i))


def reading_variant(photo: Column, files: Column, lang: Column, before: Column, forced: Column) -> Column:
    """Which reading screen (A to D) is shown: the forced one, else by upload and language, and never the one shown last."""
    pick = F.when(photo | (files > 1), "B").when(~F.coalesce(lang, F.lit("")).isin("", "en", "auto"), "C").otherwise(F.when(before == "A", "D").otherwise("A"))
    following = F.translate(pick, "ABCD", "BCDA")
    return F.when(forced.isin("A", "B", "C", "D"), forced).when(before == pick, following).otherwise(pick)


def block_shown(block: str, has: Column, kind: Column, section_values: Column, dated_action: Column) -> Column:
    """Whether a block has something to show. has: names of the fields that are not empty (of TEXTS and LISTS)."""
    any_of = lambda *names: F.arrays_overlap(has, F.array(*map(F.lit, names)))
    rules = {
        "directions": any_of("directions") & ~dated_action, "waysToPay": any_of("how_to_pay"), "howToContest": any_of("how_to_pay"), "consequence": any_of("consequence"), "items": any_of("line_items"),
        "warranty": any_of("warranty_until"), "sections": section_values > 0, "notADiagnosis": (kind == "lab_report") | (section_values > 0), "medicines": any_of("medicines"), "diagnosis": any_of("diagnosis_as_written"),
        "advice": any_of("advice_lines"), "loanTerms": any_of("tenure", "loan_account", "outstanding", "interest_rate", "charges"), "nextEmi": any_of("next_emi_date", "emi_amount"),
        "keyTerms": any_of("rent_or_price", "deposit", "lock_in", "notice_period", "term"), "timeline": any_of("start_date", "end_date"), "formSteps": any_of("form_fields"), "simpleWords": any_of("summary"),
        "actions": any_of("actions"), "watchOut": any_of("warnings", "deduction_reasons"), "places": any_of("places", "contacts"), "facts": any_of("facts"),
    }
    return rules.get(block, F.lit(False))


def blocks(has: Column, kind: Column, section_values: Column, dated_action: Column) -> Column:
    """The visible blocks in order: those of the kind, then the common ones."""
    shown = lambda names: F.filter(F.array(*(F.when(block_shown(b, has, kind, section_values, dated_action), F.lit(b)) for b in names)), lambda b: b.isNotNull()) if names else F.array().cast("array<string>")
    own = F.array().cast("array<string>")
    for name, specific in SPECIFIC.items():
        if specific:
            own = F.when(kind == name, shown(specific)).otherwise(own)
    return F.concat(own, shown(COMMON))


def layout(kind: Column, parts: Column, section_values: Column, generic: Column, has: Column, dated_action: Column, money: Column, due: Column) -> Column:
    """The layout of the first screen by kind; `generic` is what the values alone would give, money: a value is money, due: an amount is due."""
    any_of = lambda *names: F.arrays_overlap(has, F.array(*map(F.lit, names)))
    pick = lambda c, yes, no: F.when(c, yes).otherwise(no)
    return (
        F.when(parts > 1, "multi").when(kind == "lab_report", pick(section_values > 4, "Dplus", "D")).when(kind.isin("prescription", "form", "agreement", "corporate", "other"), "E")
        .when(kind == "discharge_summary", pick(any_of("follow_up"), "C", "E")).when(kind.isin("hospital_bill", "investment", "salary_slip", "bank_statement"), "F")
        .when(kind == "loan", pick(any_of("emi_amount", "next_emi_date"), "B", "F")).when(kind == "invoice", pick(due, "B", "F"))
        .when(kind == "insurance", pick(any_of("premium"), "B", pick(generic == "A", "A", "F"))).when(kind.isin("challan", "tax_notice"), "B")
        .when(kind == "school", pick(dated_action & ~money, "C", "B")).when(kind.isin("court_legal", "pension_notice"), "C").when(kind == "government_notice", pick(dated_action, "C", "E"))
        .when(kind == "utility_bill", pick(generic == "A", "A", "B")).when(kind == "receipt", pick(generic == "B", "B", "F")).otherwise(generic)
    )


def part_as_result(part: Column, parent_lang: Column, parent_kind: Column) -> Column:
    """A part (title, document_type, document_kind, date_iso, summary_lines) as a result of its own."""
    return F.struct(
        F.coalesce(part["document_type"], parent_kind, F.lit("other")).alias("doc_type"), part["document_kind"].alias("document_kind"), part["title"].alias("title"), F.coalesce(parent_lang, F.lit("en")).alias("language"),
        part["title"].alias("report_title"), F.nullif(part["date_iso"], F.lit("")).alias("report_date"), F.nullif(part["date_iso"], F.lit("")).alias("letter_date"),
        F.coalesce(part["summary_lines"], F.array().cast("array<string>")).alias("summary"),
    )
