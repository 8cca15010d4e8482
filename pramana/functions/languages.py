"""Languages: which one is meant, whether a text is written in it, and words that depend on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import MONTHS as ENGLISH
from .text import bind, indian_grouping

# Languages of the interface, and the code points of their scripts.
LANGUAGES = ["en", "ta", "hi", "te", "ml", "kn", "mr", "bn", "or"]
SCRIPTS = {"ta": (0x0B80, 0x0BFF), "hi": (0x0900, 0x097F), "mr": (0x0900, 0x097F), "te": (0x0C00, 0x0C7F), "kn": (0x0C80, 0x0CFF), "ml": (0x0D00, 0x0D7F), "bn": (0x0980, 0x09FF), "or": (0x0B00, 0x0B7F)}
INDIC = (0x0900, 0x0D7F)
# Words of questions about health, and of questions that ask for reasons.
HEALTH_QUESTION = r"(?i)vitamin|hba1c|haemoglobin|hemoglobin|anemia|anaemia|dose|medicine|tablet|cholesterol|sugar|blood|symptom|diagnos|\bmg\b|prescription|lab|report"
GENERAL_QUESTION = r"(?i)\b(why|what does|what do|mean|means|generally|usually)\b|क्यों|ஏன்|ఎందుకు|ಏಕೆ|എന്തുകൊണ്ട്|কেন|କାହିଁକି"
HEALTH_KINDS = ["lab_report", "prescription", "discharge_summary"]
LEGAL_KINDS = ["court_legal", "challan", "government_notice", "tax_notice"]
MONEY_KINDS = ["insurance", "investment", "bank_statement", "loan", "salary_slip"]
# Notes that close an answer, by language.
LEGAL_NOTE = {
    "en": "For legal advice, talk to a lawyer or the office named in the document.",
    "hi": "कानूनी सलाह के लिए किसी वकील या दस्तावेज़ में लिखे कार्यालय से बात करें।",
    "ta": "சட்ட ஆலோசனைக்கு ஒரு வழக்கறிஞரிடமோ ஆவணத்தில் உள்ள அலுவலகத்திடமோ பேசுங்கள்.",
    "te": "చట్టపరమైన సలహా కోసం న్యాయవాదిని లేదా పత్రంలో ఉన్న కార్యాలయాన్ని అడగండి.",
    "ml": "നിയമ ഉപദേശത്തിന് ഒരു അഭിഭാഷകനോടോ രേഖയിലുള്ള ഓഫീസിനോടോ സംസാരിക്കുക.",
    "kn": "ಕಾನೂನು ಸಲಹೆಗೆ ವಕೀಲರನ್ನು ಅಥವಾ ದಾಖಲೆಯಲ್ಲಿರುವ ಕಚೇರಿಯನ್ನು ಕೇಳಿ.",
    "mr": "कायदेशीर सल्ल्यासाठी वकील किंवा दस्तऐवजातील कार्यालयाशी बोला.",
    "bn": "আইনি পরামর্শের জন্য একজন আইনজীবী বা নথিতে থাকা অফিসের সঙ্গে কথা বলুন।",
    "or": "ଆଇନଗତ ପରାମର୍ଶ ପାଇଁ ଜଣେ ଓକିଲ କିମ୍ବା ଦଲିଲରେ ଥିବା କାର୍ଯ୍ୟାଳୟ ସହିତ କଥା ହୁଅନ୍ତୁ।",
}
MONEY_NOTE = {
    "en": "This is not financial advice.", "hi": "यह वित्तीय सलाह नहीं है।", "ta": "இது நிதி ஆலோசனை அல்ல.", "te": "ఇది ఆర్థిక సలహా కాదు.", "ml": "ഇത് സാമ്പത്തിക ഉപദേശമല്ല.",
    "kn": "ಇದು ಹಣಕಾಸಿನ ಸಲಹೆಯಲ್ಲ.", "mr": "हा आर्थिक सल्ला नाही.", "bn": "এটি আর্থিক পরামর্শ নয়।", "or": "ଏହା ଆର୍ଥିକ ପରାମର୍ଶ ନୁହେଁ।",
}
DOCTOR_NOTE = {
    "en": "Please check with your doctor.", "hi": "कृपया अपने डॉक्टर से पूछ लें।", "ta": "தயவுசெய்து உங்கள் மருத்துவரிடம் கேளுங்கள்.", "te": "దయచేసి మీ వైద్యుడిని అడగండి.", "ml": "ദയവായി നിങ്ങളുടെ ഡോക്ടറോട് ചോദിക്കുക.",
    "kn": "ದಯವಿಟ್ಟು ನಿಮ್ಮ ವೈದ್ಯರನ್ನು ಕೇಳಿ.", "mr": "कृपया तुमच्या डॉक्टरांना विचारा.", "bn": "অনুগ্রহ করে আপনার ডাক্তারকে জিজ্ঞাসা করুন।", "or": "ଦୟାକରି ଆପଣଙ୍କ ଡାକ୍ତରଙ୍କୁ ପଚାରନ୍ତୁ।",
}
# What stands for hidden text, and the note that something was removed, by language.
HIDDEN = {"en": "[hidden]", "ta": "[மறைக்கப்பட்டது]", "hi": "[छिपाया गया]", "te": "[దాచబడింది]", "ml": "[മറച്ചിരിക്കുന്നു]", "kn": "[ಮರೆಮಾಡಲಾಗಿದೆ]", "mr": "[लपविलेले]", "bn": "[লুকানো]", "or": "[ଲୁକ୍କାୟିତ]"}
REMOVED = {
    "en": "Some details were removed to protect privacy.", "hi": "गोपनीयता की रक्षा के लिए कुछ विवरण हटा दिए गए हैं।", "ta": "தனியுரிமையைக் காக்க சில விவரங்கள் நீக்கப்பட்டன.", "te": "గోప్యత కోసం కొన్ని వివరాలు తీసివేయబడ్డాయి.",
    "ml": "സ്വകാര്യത സംരക്ഷിക്കാൻ ചില വിവരങ്ങൾ നീക്കം ചെയ്തു.", "kn": "ಗೌಪ್ಯತೆಗಾಗಿ ಕೆಲವು ವಿವರಗಳನ್ನು ತೆಗೆದುಹಾಕಲಾಗಿದೆ.", "mr": "गोपनीयता राखण्यासाठी काही तपशील काढून टाकले आहेत.", "bn": "গোপনীয়তা রক্ষায় কিছু বিবরণ সরিয়ে দেওয়া হয়েছে।", "or": "ଗୋପନୀୟତା ପାଇଁ କିଛି ବିବରଣୀ ହଟାଇ ଦିଆଯାଇଛି।",
}
# Names of document types, by type and language.
DOCUMENT_TITLES = {
    "insurance": {"en": "Insurance letter", "ta": "காப்பீட்டு கடிதம்", "hi": "बीमा पत्र"},
    "medical": {"en": "Medical document", "ta": "மருத்துவ ஆவணம்", "hi": "चिकित्सा दस्तावेज़"},
    "lab_report": {"en": "Medical document", "ta": "மருத்துவ ஆவணம்", "hi": "चिकित्सा दस्तावेज़"},
    "government_notice": {"en": "Government notice", "ta": "அரசு அறிவிப்பு", "hi": "सरकारी नोटिस"},
    "challan": {"en": "Traffic e-challan", "ta": "போக்குவரத்து சலான்", "hi": "ट्रैफ़िक ई-चालान"},
    "court_legal": {"en": "Court notice", "ta": "நீதிமன்ற அறிவிப்பு", "hi": "अदालत का नोटिस"},
    "tax_receipt": {"en": "Property tax notice", "ta": "சொத்து வரி அறிவிப்பு", "hi": "संपत्ति कर नोटिस"},
    "telecom_bill": {"en": "Bill", "ta": "கட்டண ரசீது", "hi": "बिल"},
    "utility_bill": {"en": "Bill", "ta": "கட்டண ரசீது", "hi": "बिल"},
    "receipt": {"en": "Receipt", "ta": "ரசீது", "hi": "रसीद"},
    "other": {"en": "Document", "ta": "ஆவணம்", "hi": "दस्तावेज़"},
}
# Month names as they are spoken.
SPOKEN_MONTHS = {
    "hi": ["जनवरी", "फरवरी", "मार्च", "अप्रैल", "मई", "जून", "जुलाई", "अगस्त", "सितंबर", "अक्टूबर", "नवंबर", "दिसंबर"],
    "ta": ["ஜனவரி", "பிப்ரவரி", "மார்ச்", "ஏப்ரல்", "மே", "ஜூன்", "ஜூலை", "ஆகஸ்ட்", "செப்டம்பர்", "அக்டோபர்", "நவம்பர்", "டிசம்பர்"],
    "te": ["జనవరి", "ఫిబ్రవరి", "మార్చి", "ఏప్రిల్", "మే", "జూన్", "జూలై", "ఆగస్టు", "సెప్టెంబరు", "అక్టోబరు", "నవంబరు", "డిసెంబరు"],
    "ml": ["ജനുവരി", "ഫെബ്രുവരി", "മാർച്ച്", "ഏപ്രിൽ", "മേയ്", "ജൂൺ", "ജൂലൈ", "ഓഗസ്റ്റ്", "സെപ്റ്റംബർ", "ഒക്ടോബർ", "നവംബർ", "ഡിസംബർ"],
    "kn": ["ಜನವರಿ", "ಫೆಬ್ರವರಿ", "ಮಾರ್ಚ್", "ಏಪ್ರಿಲ್", "ಮೇ", "ಜೂನ್", "ಜುಲೈ", "ಆಗಸ್ಟ್", "ಸೆಪ್ಟೆಂಬರ್", "ಅಕ್ಟೋಬರ್", "ನವೆಂಬರ್", "ಡಿಸೆಂಬರ್"],
}
# Words in capitals that are spoken letter by letter.
ACRONYMS = [
    "GST", "UPI", "EMI", "PAN", "OTP", "IMEI", "TDS", "IRDAI", "EPFO", "PDF", "SMS", "INR", "UID", "IFSC", "MICR", "NEFT", "RTGS", "IMPS", "ICICI", "HDFC", "SBI", "LIC", "ATM", "PIN", "NOC", "FIR", "KYC",
    "OAP", "PPO", "DOB", "ID", "DL", "RC", "AI", "ML", "TTS", "API", "HTTP", "HTTPS", "JSON", "URL", "POL", "CLM", "REF", "INV", "DOC", "MRN",
]


def base_code(lang: Column, default: str = "en") -> Column:
    """The language of a code with a region: en of en-IN or en_IN."""
    return F.get(F.split(F.lower(F.coalesce(F.nullif(lang, F.lit("")), F.lit(default))), "[-_]"), F.lit(0))


def resolved_language(chosen: Column, device: Column) -> Column:
    """The chosen language if it is known and not auto, else the first known one of the device, else English."""
    known = lambda c: c.isin(LANGUAGES)
    own = F.when((F.coalesce(chosen, F.lit("")) != "") & (chosen != "auto") & known(base_code(chosen)), base_code(chosen))
    others = F.filter(F.transform(F.filter(F.coalesce(device, F.array().cast("array<string>")), lambda d: F.coalesce(d, F.lit("")) != ""), lambda d: base_code(d)), known)
    return F.coalesce(own, F.get(others, F.lit(0)), F.lit("en"))


def by_language(words: dict[str, str], lang: Column) -> Column:
    """A word in a language, in English where there is none."""
    found = F.lit(words["en"])
    for code, word in words.items():
        found = F.when(base_code(lang) == code, word).otherwise(found)
    return found


def document_title(kind: Column, lang: Column, brand: str | None = None) -> Column:
    """The name of a document type in a language, with a brand behind it if one is given."""
    found = by_language(DOCUMENT_TITLES["other"], lang)
    for name, words in DOCUMENT_TITLES.items():
        found = F.when(kind == name, by_language(words, lang)).otherwise(found)
    return F.concat(found, F.lit(f" · {brand}")) if brand else found


def _count(t: Column, low: int, high: int) -> Column:
    return F.regexp_count(t, F.lit(f"[\\x{{{low:x}}}-\\x{{{high:x}}}]"))


def needs_translation(t: Column, written: Column, target: Column) -> Column:
    """Whether a reading is not in the target language: 20 % of Indic letters are too many for English, 35 % of its own too few for another.

    Under 8 letters the stated language decides, as it does for languages without a script to check.
    """
    lang, letters = base_code(target, ""), F.regexp_replace(F.coalesce(t, F.lit("")), r"[^\p{L}]", "")
    n = F.length(letters)
    share = F.lit(None).cast("double")
    for code, span in SCRIPTS.items():
        share = F.when(lang == code, _count(letters, *span) / n).otherwise(share)
    other = F.coalesce(F.nullif(written, F.lit("")), lang) != lang
    return (
        F.when(lang.isin("", "auto"), False)
        .when(n < 8, other)
        .when(lang == "en", _count(letters, *INDIC) / n > 0.2)
        .otherwise(F.coalesce(share < 0.35, F.coalesce(written, F.lit("")) != lang))
    )


def not_english(t: Column) -> Column:
    """Whether over 20 % of at least 8 letters are Indic."""
    letters = F.regexp_replace(F.coalesce(t, F.lit("")), r"[^\p{L}]", "")
    return (F.length(letters) >= 8) & (_count(letters, *INDIC) / F.length(letters) > 0.2)


def ask_settings(question: Column) -> Column:
    """(temperature, thinking): some room for questions after reasons, none for questions after facts."""
    general = F.coalesce(question, F.lit("")).rlike(GENERAL_QUESTION)
    return F.struct(F.when(general, 0.3).otherwise(0.0).alias("temperature"), F.when(general, 512).otherwise(0).alias("thinking"))


def closing_note(question: Column, kind: Column, lang: Column) -> Column:
    """The note that an answer ends with: of a doctor, a lawyer, or on money; blank for other documents."""
    health = F.coalesce(kind.isin(HEALTH_KINDS), F.lit(False)) | F.coalesce(question, F.lit("")).rlike(HEALTH_QUESTION)
    return F.when(health, by_language(DOCTOR_NOTE, lang)).when(kind.isin(LEGAL_KINDS), by_language(LEGAL_NOTE, lang)).when(kind.isin(MONEY_KINDS), by_language(MONEY_NOTE, lang)).otherwise("")


def speak_timeout(t: Column) -> Column:
    """Milliseconds allowed for speaking a text: 8 s up to 80 characters, 25 s from 900 on, a line between."""
    n = F.length(t)
    return F.when(n >= 900, 25_000).when(n <= 80, 8_000).otherwise(F.floor(8_000 + (n - 80) / 820 * 17_000 + 0.5).cast("int"))


def token_cap(n_keys: Column) -> Column:
    """Tokens allowed for a translation of so many texts."""
    return F.least(F.lit(8192), F.greatest(F.lit(1024), 400 + 120 * n_keys))


def replace_each(t: Column, pattern: str, make) -> Column:
    """The text with make(match) in the place of each match."""
    put = lambda x: F.array_join(F.transform(x["gaps"], lambda g, i: F.concat(g, F.coalesce(make(F.get(x["hits"], i)), F.lit("")))), "")
    return bind(put, gaps=F.split(t, pattern, -1), hits=F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))


def natural_dates(t: Column, lang: str = "en") -> Column:
    """ISO dates written out as 30 November 2026, with the month's name in one of six languages."""
    months = F.array(*map(F.lit, SPOKEN_MONTHS.get(lang.lower().split("-")[0], [m.capitalize() for m in ENGLISH])))

    def natural(m: Column) -> Column:
        part = lambda i: F.get(F.split(m, "-"), F.lit(i)).cast("int")
        fine = part(2).between(1, 31) & part(1).between(1, 12) & part(0).between(1900, 2100)
        return F.when(fine, F.concat_ws(" ", part(2).cast("string"), F.get(months, part(1) - 1), part(0).cast("string"))).otherwise(m)

    return replace_each(t, r"(?<!\d)\d{4}-\d{1,2}-\d{1,2}(?!\d)", natural)


def spoken_capitals(t: Column) -> Column:
    """Blanks between letters and digits of ids; words in capitals, but for acronyms, with a first capital only."""
    t = F.regexp_replace(F.regexp_replace(t, r"([A-Za-z]{2,})(\d+)", "$1 $2"), r"(\d+)([A-Za-z]{2,})", "$1 $2")
    return replace_each(t, r"\b[A-Z]{3,}\b", lambda w: F.when(w.isin(ACRONYMS), w).otherwise(F.concat(F.left(w, F.lit(1)), F.lower(F.substr(w, F.lit(2))))))


def grouped_number(n: Column) -> Column:
    """A number with or without commas, its whole part grouped as 12,34,567."""
    bare = F.trim(F.replace(n, F.lit(","), F.lit("")))
    return F.concat(indian_grouping(F.regexp_extract(bare, r"^\d*", 0)), F.regexp_extract(bare, r"\.\d+", 0))


def amounts_in_text(t: Column) -> Column:
    """Amounts in running text with one sign and Indian grouping; other numbers stay."""
    return replace_each(t, r"(?i)(?:Rs\.?|₹|INR)\s*[\d,]+(?:\.\d+)?", lambda m: F.concat(F.lit("₹"), grouped_number(F.regexp_extract(m, r"[\d,]+(?:\.\d+)?$", 0))))


def amount_value(t: Column) -> Column:
    """A printed amount, alone or within words, with one sign and Indian grouping."""
    alone = F.regexp_extract(t, r"(?i)^(?:Rs\.?|₹|INR|\s)*([\d,]+(?:\.\d+)?)\s*$", 1)
    return F.when(F.coalesce(t, F.lit("")) == "", "").when(alone != "", F.concat(F.lit("₹"), grouped_number(alone))).otherwise(amounts_in_text(t))
