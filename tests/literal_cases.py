"""Literal cases of rules on single texts and results: inputs, and the result that the rule gives for them."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pramana.functions import dates, languages, names, speech
from pramana.functions.text import bind
from pramana.operators import admission, answers, blocks, calendar, decoders, dues, evidence, guards, masking, overview, privacy, results, sharing, stores

#: name, fields, rows (inputs and, last, the result as text), and the rule.
CASES = []
_STR = "array<string>"
_ENV = "Amount Rs. 31,200 on 30.11.2026. ID 4401."
_UP = ["rating", "lang", "docType", "sample", "appVersion", "createdAt"]
_HEAD = "BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//pramana//EN\r\nCALSCALE:GREGORIAN\r\nMETHOD:PUBLISH\r\n"
_ONE = "BEGIN:VEVENT\r\nUID:u@example.org\r\nDTSTAMP:20261006T000000Z\r\n"


def cases(name, fields, rows, make):
    CASES.append((name, fields, rows, make))


def _day():
    return F.lit("2026-10-06").cast("date")


cases("email_checks", "t string", [("a.b+c@mail.example.com", "true|true"), ("no mail", "false|false"), (" x@y.in ", "true|true"), ("x@y", "false|false"), ("98765 43210", "false|true"), ("१८०० २०० ३०००", "false|true"), ("12345", "false|false"), (None, "false|false")],
      lambda t: F.concat_ws("|", admission.email_valid(t).cast("string"), admission.contact_valid(t).cast("string")))
cases("sample_uploads", f"names {_STR}", [(["sample-a.pdf", "sample-b.png"], "true"), (["sample-a.pdf", "mine.pdf"], "false"), ([], "false"), (None, "false"), (["Sample-a.pdf"], "false")], admission.sample_traffic)
cases("photo_files", "name string, mime string", [("a.HEIC", "", "true|true"), ("b.jpg", "application/pdf", "false|true"), ("c.pdf", "application/pdf", "false|false"), ("d", "image/heif-sequence", "true|true"), ("e.webp", None, "false|true"), ("f.heif", "", "true|false")],
      lambda n, m: F.concat_ws("|", admission.heic_file(n, m).cast("string"), admission.photo_file(n, m).cast("string")))
cases("photo_uploads", "files array<struct<name:string,mime:string>>", [([("a.jpg", ""), ("b", "image/png")], "true"), ([("a.jpg", ""), ("b.pdf", "")], "false"), ([], "false"), (None, "false")], admission.photo_upload)
cases("thread_turns", f"doc string, saved {_STR}, owner string, live {_STR}", [("d", ["s"], "d", ["l"], "l"), ("d", ["s"], "e", ["l"], "s"), ("d", ["s"], "d", [], "s"), ("", ["s"], "", ["l"], ""), (None, ["s"], None, ["l"], ""), ("d", [], "e", ["l"], "")],
      lambda d, s, o, l: F.array_join(admission.asks_of_document(d, s, o, l), ","))
cases(
    "feedback_admitted", f"keys {_STR}, rating string, lang string, kind string, reasons {_STR}, sample_type string, version string, signed boolean, made long",
    [
        (_UP, "up", "ta", "bank", None, "boolean", "1.2.3", True, 5, "true"), ([*_UP, "reasons"], "up", "ta", "bank", ["other"], "boolean", "1.2.3", True, 5, "false"),
        ([*_UP, "reasons"], "down", "or", "unknown", ["other", "wrong_date"], "boolean", "1.2.3", True, 5, "true"), ([*_UP, "reasons"], "down", "or", "unknown", ["bad"], "boolean", "1.2.3", True, 5, "false"),
        (_UP, "down", "or", "unknown", None, "boolean", "1", True, 5, "false"), (_UP, "up", "fr", "bank", None, "boolean", "1", True, 5, "false"), (_UP, "up", "en", "lab_report", None, "boolean", "1", True, 5, "false"),
        (_UP, "up", "en", "bank", None, "string", "1", True, 5, "false"), (_UP, "up", "en", "bank", None, "boolean", "a b", True, 5, "false"), (_UP, "up", "en", "bank", None, "boolean", "1", False, 5, "false"),
        (_UP, "up", "en", "bank", None, "boolean", "1", True, 6, "false"), ([*_UP, "text"], "up", "en", "bank", None, "boolean", "1", True, 5, "false"), ([*_UP, "reasons"], "down", "en", "bank", ["other"] * 6, "boolean", "1", True, 5, "false"),
    ],
    lambda k, r, l, d, x, s, v, a, m: admission.feedback_allowed(k, r, l, d, x, s, v, a, m, F.lit(5)),
)
cases("wrong_language", "t string, written string, target string", [
    ("This is plain English text", "en", "en", "false"), ("यह हिंदी में लिखा गया एक वाक्य है", "en", "en", "true"), ("This is plain English text", "en", "ta", "true"), ("இது தமிழில் எழுதப்பட்ட வாக்கியம்", "ta", "ta-IN", "false"),
    ("short", "en", "hi", "true"), ("short", "hi", "hi", "false"), ("short", None, "hi", "false"), ("whatever is written here", "en", "auto", "false"), ("whatever is written here", "fr", "de", "true"), ("whatever is written here", "de", "de", "false"), (None, "en", "", "false"),
], languages.needs_translation)
cases("english_readings", "t string", [("This is plain English text", "false"), ("यह हिंदी में लिखा गया एक वाक्य है", "true"), ("यह", "false"), ("Pay the bill बिल by Monday evening please", "false"), (None, "false")], languages.not_english)
cases("resolved_languages", f"chosen string, device {_STR}", [("ta-IN", ["hi"], "ta"), ("auto", ["fr-FR", "kn_IN"], "kn"), ("xx", ["mr"], "mr"), (None, [None, "", "bn-BD"], "bn"), ("", [], "en"), ("EN-us", None, "en"), ("auto", None, "en")], languages.resolved_language)
cases("question_settings", "q string", [("Why is it high?", "0.3|512"), ("What is the due date?", "0.0|0"), ("यह क्यों है", "0.3|512"), ("meaning of this", "0.0|0"), ("what does it mean", "0.3|512"), (None, "0.0|0")],
      lambda q: bind(lambda x: F.concat_ws("|", x["s"]["temperature"].cast("string"), x["s"]["thinking"].cast("string")), s=languages.ask_settings(q)))
cases("closing_notes", "q string, kind string, lang string", [("Is my sugar fine?", "other", "en-IN", "Please check with your doctor."), ("When?", "challan", "hi", "कानूनी सलाह के लिए किसी वकील या दस्तावेज़ में लिखे कार्यालय से बात करें।"), ("When?", "loan", "xx", "This is not financial advice."), ("When?", "school", "en", ""), ("When?", "prescription", "ta", "தயவுசெய்து உங்கள் மருத்துவரிடம் கேளுங்கள்.")], languages.closing_note)
cases("localised_words", "kind string, lang string", [("insurance", "ta-IN", "[மறைக்கப்பட்டது]|காப்பீட்டு கடிதம்|தனியுரிமையைக் காக்க சில விவரங்கள் நீக்கப்பட்டன."), ("lab_report", "hi", "[छिपाया गया]|चिकित्सा दस्तावेज़|गोपनीयता की रक्षा के लिए कुछ विवरण हटा दिए गए हैं।"), ("bank", None, "[hidden]|Document|Some details were removed to protect privacy."), ("receipt", "bn", "[লুকানো]|Receipt|গোপনীয়তা রক্ষায় কিছু বিবরণ সরিয়ে দেওয়া হয়েছে।"), (None, "xx", "[hidden]|Document|Some details were removed to protect privacy.")],
      lambda k, l: F.concat_ws("|", languages.by_language(languages.HIDDEN, l), languages.document_title(k, l), languages.by_language(languages.REMOVED, l)))
cases("spoken_dates", "t string", [("Due 2026-11-30, not 2026-13-01.", "Due 30 November 2026, not 2026-13-01."), ("on 2026-2-31 and 1899-01-01", "on 31 February 2026 and 1899-01-01"), ("12026-11-30", "12026-11-30"), ("", "")], languages.natural_dates)
cases("spoken_dates_in_hindi", "t string", [("2026-11-30 तक", "30 नवंबर 2026 तक"), ("no date", "no date")], lambda t: languages.natural_dates(t, "hi-IN"))
cases("spoken_capitals", "t string", [("PAY THE GST for CLM2026 now", "Pay The GST for CLM 2026 now"), ("ID AB12cd", "ID AB 12 cd"), ("ok", "ok")], languages.spoken_capitals)
cases("amounts_in_text", "t string", [("Pay Rs. 1234567.89 by 2026", "Pay ₹12,34,567.89 by 2026"), ("INR 500 and ₹1,00,000", "₹500 and ₹1,00,000"), ("no money 12345", "no money 12345"), ("Rs 48,500", "₹48,500")], languages.amounts_in_text)
cases("amount_values", "t string", [("Rs. 48,500", "₹48,500"), ("1234567.5", "₹12,34,567.5"), ("Rs. 5 of Rs. 10000", "₹5 of ₹10,000"), ("", ""), (None, "")], languages.amount_value)
cases("speaking_limits", "n int", [(10, "8000|1600"), (80, "8000|8192"), (490, "16500|8192"), (900, "25000|8192"), (2000, "25000|8192"), (5, "8000|1024")], lambda n: F.concat_ws("|", languages.speak_timeout(F.repeat(F.lit("x"), n)).cast("string"), languages.token_cap(n).cast("string")))
cases("resolved_deadlines", "quote string, text string, anchor string", [
    ("within 48 hours", "", "2026-10-08", "computed 2026-10-10 2"), ("४८ घंटों के भीतर", "Reply within 7 days", "2026-10-08", "computed 2026-10-15 7"), ("within 48 hours", "", None, "drop"), ("within the hour", "", "2026-10-08", "drop"), ("pay on 10 October 2026", "within 3 days", "2026-10-08", "computed 2026-10-11 3"),
    ("pay on 10 October 2026", "தேதி 3 நாட்களுக்குள்", "2026-10-08", "skip"), ("", "within 2 weeks", "08.10.2026", "computed 2026-10-22 14"), ("within 1 month", "other", "31 January 2026", "computed 2026-02-28 28"), (None, None, "2026-10-08", "skip"), ("within 0 days", "within 5 days", "2026-10-08", "computed 2026-10-13 5"),
], lambda q, t, a: bind(lambda x: F.concat_ws(" ", x["r"]["verdict"], x["r"]["due"].cast("string"), x["r"]["days"].cast("string")), r=dates.resolved_deadline(q, t, a)))
cases("action_days", "rec string, quote string, text string, days int, anchor string, printed string, letter string", [
    ("every month", "within 2 days", "", None, None, "2026-11-01", "2026-10-08", "recurring"), (None, "within 2 days", "", None, None, "2026-12-01", "2026-10-08", "2026-10-10 calculated 2"), (None, "within 2 days", "", 9, None, "2026-12-01", None, "none"),
    (None, "pay soon", "", 30, "letter_date", "x", "2026-10-01", "2026-10-31 calculated 30"), (None, "pay soon", "", 30, "receipt", "2026-11-30", "2026-10-01", "2026-11-30 upcoming 30"), (None, "pay", "", None, None, "2026-09-01", "2026-10-01", "2026-09-01 passed"), (None, "pay", "", None, None, None, "2026-10-01", "none"),
], lambda r, q, t, n, a, p, l: bind(lambda x: F.concat_ws(" ", x["d"]["due"], x["d"]["status"], x["d"]["days"].cast("string")), d=dates.action_day(r, q, t, n, a, p, l, F.lit("2026-10-06").cast("date"))))
cases("letter_dates", "given string, pages string", [("1 Oct 2026", "Date: 02.10.2026", "2026-10-01"), ("sometime", "Date: 02.10.2026", "sometime"), (None, "To you. DATE:  3 October 2026 Re", "2026-10-03"), ("", "Date: 31.02.2026", None), (None, None, None)], dates.letter_date)
cases("passed_days", "t string", [("2026-10-05", "true"), ("2026-10-06", "false"), ("2026-10-05T10:00", "true"), ("31/02/2026", "true"), ("31.09.2026", "true"), ("06-10-2026", "false"), ("soon", "false"), (None, "false"), ("2026-13-01", "false"), ("2025-13-01", "true")], lambda t: dates.is_passed(t, F.lit("2026-10-06").cast("date")))
cases("calculated_chips", "due string, days int", [("2026-10-31", 30, "Calculated: 31 Oct 2026 (30 days from the letter date)"), ("2026-10-31", None, "Calculated: 31 Oct 2026"), (None, 5, "Calculated (5 days from the letter date)"), ("", 0, "Calculated"), ("mid-November", 3, "Calculated: mid-November (3 days from the letter date)")], dates.calculated_chip)
cases("birth_date_keys", "t string", [("DOB: 14/05/1980", "[19800514]"), ("born on 14 May 1980, Date of Birth 1980-05-15", "[19800514, 19800515]"), ("जन्म तिथि: १४ मई १९८०", "[19800514]"), ("d.o.b. 14/05/49 and dob 14/05/50", "[19500514, 20490514]"), ("14/05/1980", "[]")], lambda t: masking.birth_keys(F.array(t)))
cases("role_names", "t string", [("Registered Owner: Smt. Lakshmi Devi shall pay", "Lakshmi Devi"), ("Patient Ravi Kumar Das Gupta", "Ravi Kumar Das"), ("शिकायतकर्ता रवि ने कहा", "रवि"), ("Respondent The Court", ""), ("the patient is fine", ""), ("Owner Notice Ravi", ""), (None, "")], lambda t: F.array_join(names.after_roles(t), ","))
cases("person_terms", "t string", [("Mr. Rao", "true"), ("Asha Rao", "true"), ("Asha", "false"), ("Anand Nagar", "false"), ("City Hospital", "false"), ("CLM 12", "false"), ("a@b c", "false"), ("रवि कुमार", "true"), ("Dr.", "false"), (None, "false")], names.is_person)
cases("missing_people", f"terms {_STR}, texts {_STR}", [(["Asha Rao", "Claims Department", "Mr. Das"], ["Asha Rao pays"], "Mr. Das|true"), (["Asha Rao"], ["நோயாளி ஆஷா ராவ்"], "|false"), (["CLM-1"], ["x"], "|false"), ([], [], "|false")],
      lambda t, x: F.concat_ws("|", F.array_join(names.names_left_out(t, F.create_map(F.lit("Asha Rao"), F.array(F.lit("ஆஷா ராவ்"))), x), ","), names.mask_fallback(t, F.create_map(F.lit("Asha Rao"), F.array(F.lit("ஆஷா ராவ்"))), x).cast("string")))
cases("name_renderings", f"terms {_STR}, texts {_STR}", [(["CLM-7", "gone"], ["Dr. Asha Rao on CLM-7", "Patient Ravi Das"], "CLM-7,Asha Rao,Ravi Das"), ([], ["nothing here"], ""), (["x1"], ["x1", None], "x1")], lambda t, x: F.array_join(F.map_keys(names.renderings(t, x)), ","))
cases("merged_renderings", f"texts {_STR}", [(["ஆஷா pays"], "Asha Rao=A R+ஆஷா"), (["none"], "Asha Rao=A R")],
      lambda x: F.array_join(F.transform(F.map_entries(names.merged_renderings(F.create_map(F.lit("Asha Rao"), F.array(F.lit("A R"))), F.create_map(F.lit("Asha Rao"), F.array(F.lit(" ஆஷா "), F.lit("Q")), F.lit("Z"), F.array(F.lit("zz"))), x)), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ";"))
cases("number_guard", "a string, b string", [
    (_ENV, "₹ ௩௧,௨௦௦ ௩௦.௧௧.௨௦௨௬ ID ௪௪௦௧", "true"), (_ENV, "₹ 31201 on 30.11.2026 ID 4401", "false"), (_ENV, "₹ 31,000 on 30.11.2026 ID 4401", "false"), (_ENV, "₹ 31200 ID 4401", "false"), (_ENV, "31200 on 30.11.2026 ID 4401", "false"), (_ENV, "", "false"), (_ENV, None, "false"),
    ("05 and 05", "5", "false"), ("05 and 05", "5 and 5", "true"), ("5 of 15", "15", "true"), ("05 and 5", "5", "true"), ("5 and 05", "5", "false"), ("no digits", None, "true"), (None, "x", "true"), ("30 November", "30 नवंबर", "true"),
], guards.translation_keeps_numbers)
cases("protected_term_guard", f"a string, b string, terms {_STR}", [
    ("Claim  no 4 here", "claim no 4 यहाँ", ["Claim  no 4"], "true"), ("Claim no 4", "other", ["claim no 4"], "false"), ("Claims Department", "विभाग", ["Claims Department"], "true"), ("Asha Rao", None, ["Ravi"], "false"), ("Asha Rao", "x", [], "true"), (None, None, ["Asha"], "true"),
    ("Café 9", "café 9 x", ["Café 9"], "true"), ("Asha", "", ["  "], "false"), ("Asha Rao", "asha rao", ["Asha Rao"], "true"),
], guards.translation_keeps_terms)
cases("list_guards", f"a {_STR}, b {_STR}", [(["pay 5", "on 7"], ["5 दें", "7 को"], "true|true"), (["pay 5", "on 7"], ["5 दें"], "false|true"), (["pay 5"], ["7 दें"], "false|false"), ([], [], "true|true")], lambda a, b: F.concat_ws("|", guards.lists_keep_numbers(a, b).cast("string"), guards.lists_keep_numbers(a, b, cut=True).cast("string")))
cases("kept_labels", "a string, b string", [("Vitamin B12", "विटामिन B12", "विटामिन B12"), ("Vitamin B12", "विटामिन", "Vitamin B12"), ("Iron", "", "Iron"), ("Iron", None, "Iron"), ("Iron", "लोहा", "लोहा")], guards.kept_label)
cases("guarded_answers", "answer string, general boolean", [("It is 500.", False, "a=500,b=20|true"), ("It is 20.", False, "a=500,b=20|true"), ("It is 20.", True, "c=none|false"), ("It is 77.", True, "c=none|true")],
      lambda a, g: bind(lambda x: F.concat_ws("|", F.array_join(F.transform(x["r"]["facts"], lambda f: F.concat_ws("=", f["label"], f["value"])), ","), x["r"]["invented"].cast("string")),
                        r=answers.guarded_numbers(a, F.when(g, F.array(F.struct(F.lit("a").alias("label"), F.lit("500").alias("value")), F.struct(F.lit("c").alias("label"), F.lit("none").alias("value")))).otherwise(F.array(F.struct(F.lit("a").alias("label"), F.lit("500").alias("value")), F.struct(F.lit("x").alias("label"), F.lit("99").alias("value")), F.struct(F.lit(" ").alias("label"), F.lit("1").alias("value")), F.struct(F.lit("b").alias("label"), F.lit("20").alias("value")))), F.lit("500 and 020 and 20"), g)))
cases("answer_sources", "said string, gone boolean, quote string, files boolean, pages boolean, invented boolean", [
    (" General ", True, "q", True, True, True, "general|none"), ("document", True, "q", True, False, False, "document|none"), ("document", True, None, False, False, False, "summary|none"), ("document", False, "q", False, True, False, "document|matched"), ("document", False, "q", False, True, True, "document|check_original"),
    ("document", False, None, True, False, False, "document|check_original"), (None, False, "q", False, False, False, "summary|none"), ("summary", True, None, False, False, True, "summary|check_original"),
], lambda a, n, q, f, p, i: bind(lambda x: F.concat_ws("|", x["r"]["answered_from"], x["r"]["evidence"]), r=answers.answer_evidence(a, n, q, F.lit("matched"), f, p, i)))
cases("short_lists", f"a {_STR}", [(["a  b", " ", None, "c", "d", "e", "f"], "a b|c|d|e"), ([], ""), (None, "")], lambda a: F.array_join(answers.short_list(a, 4), "|"))
cases("keyed_payloads", "raw string", [('{"strings": {"a": "x", "n": 5}, "b": "y"}', "a=x"), ('{"a": "x", "n": 5, "l": ["q"], "strings": {"n": 1}, "protected_terms_rendered": {"k": ["v"]}}', "a=x"), ("[1]", ""), ("broken", ""), (None, "")], lambda r: F.array_join(F.transform(F.map_entries(answers.keyed_payload(r)), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))
cases("spoken_summaries", f"spoken string, lines {_STR}", [("Pay 500 soon.", ["x"], "Pay 500 soon."), ("Pay 777.", ["Pay 500", " by Monday "], "Pay 500 by Monday"), ("Pay 777.", ["Pay 778"], "This is an official document regarding Bill. Please review the key details. Pay now by 2026-11-30."), (None, ["Pay 9"], "This is an official document regarding Bill. Please review the key details. Pay now by 2026-11-30."), ("Pay 9.", [], "Pay 9.")],
      lambda s, l: answers.spoken_summary(s, l, F.lit("Bill"), F.lit("Pay now"), F.lit("2026-11-30"), F.lit("amount 500 due"), F.array(F.lit("9"))))
cases("place_evidence", "address string, quote string", [("12 main road", "", "matched"), ("13 main road", "city centre", "matched"), ("13 main road", None, "check_original"), ("", "", "check_original")], lambda a, q: evidence.place(a, q, F.lit("at 12 main road, city centre")))
cases("glance_evidence", "value string, kind string", [("Rs. 31,200", "amount", "matched"), ("INR 31200.00", "amount", "matched"), ("31,200", "text", "matched"), ("₹ 99", "amount", "check_original"), ("01 october 2026", "date", "matched"), ("01/10/2027", "date", "check_original"), ("", "amount", "check_original"), (None, "text", "check_original")],
      lambda v, k: evidence.glance(v, k, F.lit("Amount approved: ₹ 31,200. Date: 01 October 2026.")))
cases("part_glance_evidence", "value string", [("₹ 31,200", "matched"), ("₹31,200", "check_original"), (None, "check_original")], lambda v: evidence.part_glance(v, F.lit("Amount approved: ₹ 31,200.")))
cases("client_personal_fields", "t string, q string, marked boolean", [("anything", "", True, "true"), ("Folio 12", "", False, "true"), ("Total amount: Rs. 500", "", None, "false"), ("call 9876543210", "", False, "true"), ("45 Y / M", "", False, "true"), ("12, 4th cross", "", False, "true"), ("Date of Birth", "", False, "true"), ("mail a@b.co", "", False, "true"), ("just words", "", False, "false"), ("", "", False, "false"), (None, None, None, "false"), ("Pension amount: Rs. 900", "", False, "false")],
      lambda t, q, m: privacy.personal_field(t, q, m, privacy.CLIENT_RULES))
cases("outside_spans", "t string", [("Ravi Kumar called 98765 43210 twice, Ravi Kumar", "R*** K**** called ********** twice, R*** K****"), ("Kumar of Ravi Kumar at Main Road", "K**** of R*** K**** at [hidden]"), ("", ""), (None, "")],
      lambda t: sharing.with_spans_masked(t, F.array(*(F.struct(F.lit(a).alias("text"), F.lit(b).alias("type")) for a, b in [("Kumar", "person"), ("Ravi Kumar", "person"), ("98765 43210", "phone"), ("Main Road", "address"), ("called", "verb")])), F.lit("en")))
cases("redacted_results", "fallback boolean, lang string", [(False, "en", "Asha's bill; born [hidden]|Pay Rs. 500 to R*** K****|on [hidden] and 15/05/1980|"), (True, "en", "Some details were removed to protect privacy.|Pay Rs. 500 to R*** K****||14/05/1980,Rs. 500,14.05.1980,15/05/1980"), (None, "xx", "Asha's bill; born [hidden]|Pay Rs. 500 to R*** K****|on [hidden] and 15/05/1980|")],
      lambda f, l: bind(lambda x: F.concat_ws("|", *(F.array_join(x["r"][c], ",") for c in ("summary", "actions", "facts", "dates_and_amounts"))), r=sharing.redacted(F.array(F.lit("Asha's bill; born 14/05/1980")), F.array(F.lit("Pay Rs. 500 to Ravi Kumar")), F.array(F.lit("on 14.05.1980 and 15/05/1980")), F.array(F.lit("Ravi Kumar")), f, l)))
cases("share_texts", f"actions {_STR}, instruction string", [
    (["a", "b"], "after food", "📄 T\n\n📌 In simple words:\n• s\n\n✅ What you need to do:\n1. a\n2. b\n\n💊 Prescribed medicines:\n• M 5 mg — after food\n\n📑 Documents:\n\n--- P ---\n• l\n"), ([], None, "📄 T\n\n📌 In simple words:\n• s\n\n💊 Prescribed medicines:\n• M 5 mg (OD)\n\n📑 Documents:\n\n--- P ---\n• l\n"),
], lambda a, i: sharing.share_text(F.lit("T"), F.struct(F.array(F.lit("s")).alias("summary"), a.alias("actions"), F.array(sharing.medicine_line(F.struct(F.lit("M").alias("name"), F.lit("5 mg").alias("strength"), i.alias("instruction"), F.lit("OD").alias("frequency")))).alias("medicines")), ["summary", "actions", "medicines"],
                                   F.array(F.struct(F.lit("P").alias("title"), F.array(F.lit("l")).alias("lines")))))
cases("shared_titles", "title string, hide boolean", [("Mine", True, "Insurance letter"), ("Mine", False, "Mine"), ("", False, "Document")], lambda t, h: sharing.shared_title(t, F.lit("insurance"), F.lit("en"), h))
cases("spoken_texts", "t string", [("Dr. Rao paid Rs. 1,200 on 30.11.2026", "Doctor Rao paid 1,200 rupees on 30 November 2026"), ("Rs.5 Lac or 2 crore and ₹ 31,200", "5 lakh rupees or 2 crore rupees and 31,200 rupees"), ("A. Rao owes 500 INR by 2026-10-01, 31.13.2026", "A Rao owes 500 rupees by 1 October 2026, 31.13.2026"), ("", "")], speech.spoken)
cases("spoken_texts_in_telugu", "t string", [("₹ 500 on 5.1.2026", "500 రూపాయలు on 05-01-2026")], lambda t: speech.spoken(t, "te-IN"))
cases("presented_dates", "due string, status string, rec string, evidence string, quote string, photo boolean", [("2026-10-05", "upcoming", None, "matched", "q", False, "true|matched|false"), ("2026-10-07", "upcoming", None, None, "q", False, "false|check_original|true"), (None, "recurring", "monthly", "calculated", None, True, "false|calculated|true"), ("2026-11-01", "passed", None, None, "q", True, "true|false")],
      lambda d, s, r, e, q, p: bind(lambda x: F.concat_ws("|", x["d"]["passed"].cast("string"), x["d"]["chip"], x["d"]["in_calendar"].cast("string")), d=results.presented_date(d, s, r, e, q, p, _day())))
cases("typed_kinds", "t string, medicines int, type string", [("", 0, "tax_receipt", "tax_notice"), ("", 0, "medical", "lab_report"), ("", 0, "zzz", "other"), ("the premium", 0, "bank", "insurance"), ("", 0, None, "other"), ("", 2, "medical", "prescription")], lambda t, m, y: decoders.document_kind(F.lit(None).cast("string"), t, m, F.lit(0), y))
cases("due_days", "printed string, emi string, status string", [("2026-10-01", "x", "upcoming", "2026-10-01"), ("", "2026-11-05", "upcoming", "2026-11-05"), (None, None, "upcoming", "2026-12-01"), (None, "", "passed", "")], lambda p, e, s: dues.due_day(p, e, F.array(F.struct(F.lit(None).cast("string").alias("due"), F.lit("none").alias("status")), F.struct(F.lit("2026-12-01").alias("due"), s.alias("status")))))
cases("headlines", "t string", [("one two three four five six seven eight nine ten eleven twelve thirteen", "one two three four five six seven eight nine ten eleven twelve"), (" a  b ", "a b"), (None, "")], results.headline)
cases("feedback_reasons", f"rating string, reasons {_STR}", [("down", ["other", "wrong_date", "other"], "[other, wrong_date]"), ("up", ["other"], None), ("down", [], "[]")], results.feedback_reasons)
cases("checked_shares", "ok boolean", [(True, "R*** pays|false"), (False, "closed|true"), (None, "closed|true")], lambda ok: bind(lambda x: F.concat_ws("|", x["r"]["text"], x["r"]["closed"].cast("string")), r=sharing.checked_share(ok, F.array(F.struct(F.lit("Ravi").alias("text"), F.lit("person").alias("type"))), F.lit("Ravi pays"), F.lit("closed"), F.lit("en"))))
cases("check_keys", "id string, lang string", [("a", "ta", "a|ta|hide"), (None, None, "|en|hide"), ("b", "", "b|en|hide")], sharing.check_key)
cases("question_families", "kind string", [("lab_report", "lab"), ("receipt", "bill"), ("challan", "legal"), ("school", "generic"), (None, "generic"), ("tax_notice", "gov")], blocks.ask_family)
cases("parts_alone", "title string, kind string", [("Part 1", "loan", "bank|loan|Part 1|ta|2026-10-01|a,b"), ("Part 2", None, "bank|Part 2|ta|2026-10-01|a,b")],
      lambda t, k: bind(lambda x: F.concat_ws("|", x["r"]["doc_type"], x["r"]["document_kind"], x["r"]["title"], x["r"]["language"], x["r"]["letter_date"], F.array_join(x["r"]["summary"], ",")),
                        r=blocks.part_as_result(F.struct(t.alias("title"), F.lit(None).cast("string").alias("document_type"), k.alias("document_kind"), F.lit("2026-10-01").alias("date_iso"), F.array(F.lit("a"), F.lit("b")).alias("summary_lines")), F.lit("ta"), F.lit("bank"))))
cases("calendar_eligible", "due string, status string, rec string", [("2026-10-07", "upcoming", None, "true"), ("2026-10-05", "upcoming", None, "false"), (None, "recurring", "monthly", "true"), (None, "none", None, "false"), ("2026-10-07", "passed", None, "false")], lambda d, s, r: calendar.eligible(d, s, r, _day()))
cases("calendar_drafts", "title string, date string, time string, alert string", [("  Pay   the bill ", "2026-10-07T00:00", "09:30:00", "1d", "Pay the bill|2026-10-07T09:30:00|false|-P1D|Reminder."), ("Pay", "2026-10-07", "", "x", "Pay|2026-10-07|true|PT9H|Reminder."), ("x" * 70, "2026-10-07", "9:30", "0", "x" * 59 + "…|2026-10-07|true|-PT0S|Reminder.")],
      lambda t, d, h, a: bind(lambda x: F.concat_ws("|", x["e"]["title"], x["e"]["start"], x["e"]["all_day"].cast("string"), x["e"]["alarm"], x["e"]["description"]), e=calendar.draft(F.lit("u"), t, F.lit(None).cast("string"), d, h, a)))
cases("calendar_files", "time string, rule string", [
    ("09:30", "FREQ=MONTHLY", _HEAD + _ONE + "DTSTART:20261007T093000\r\nSUMMARY:Pay\\; now\r\nDESCRIPTION:Reminder.\r\nRRULE:FREQ=MONTHLY\r\nBEGIN:VALARM\r\nACTION:DISPLAY\r\nDESCRIPTION:Pay\\; now\r\nTRIGGER:-P1W\r\nEND:VALARM\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"),
    (None, None, _HEAD + _ONE + "DTSTART;VALUE=DATE:20261007\r\nSUMMARY:Pay\\; now\r\nDESCRIPTION:Reminder.\r\nBEGIN:VALARM\r\nACTION:DISPLAY\r\nDESCRIPTION:Pay\\; now\r\nTRIGGER:-P1W\r\nEND:VALARM\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"),
], lambda t, r: calendar.calendar_file(F.array(calendar.draft(F.lit("u"), F.lit("Pay; now"), F.lit(""), F.lit("2026-10-07"), t, F.lit("1w"), r)), F.lit("20261006T000000Z"), "pramana", "example.org"))
cases("action_events", "single boolean", [(True, "t-act-0:Pay:2026-11-01T09:00:00:|t-act-1:Rent:2026-10-06T09:00:00:FREQ=MONTHLY"), (False, "t-act-all-0:Pay:2026-11-01T09:00:00:|t-act-all-1:Rent:2026-10-06T09:00:00:")],
      lambda s: bind(lambda x: F.array_join(F.transform(F.when(s, x["one"]).otherwise(x["all"]), lambda e: F.concat_ws(":", e["uid"], e["title"], e["start"], F.coalesce(e["rrule"], F.lit("")))), "|"), **{
          k: calendar.action_events(F.array(*(F.struct(F.lit(a).alias("text"), F.lit(b).cast("string").alias("due"), F.lit(c).alias("status"), F.lit(d).cast("string").alias("recurrence")) for a, b, c, d in [("Pay", "2026-11-01", "upcoming", None), ("Late", "2026-09-01", "passed", None), ("Rent", None, "recurring", "monthly")])), F.lit("t"), F.lit("1d"), _day(), lambda c: c, single=v) for k, v in (("one", True), ("all", False))}))
cases("dose_calendars", "days int", [(5, "r-med-0-night:2026-10-06T21:00:00:FREQ=DAILY;COUNT=5"), (None, "r-med-0-night:2026-10-06T21:00:00:")],
      lambda n: F.array_join(F.transform(calendar.dose_calendar(F.array(F.struct(F.lit(0).alias("medicine"), F.lit("night").alias("slot"), F.lit("21:00").alias("time"))), F.array(F.struct(n.alias("duration_days"))), F.lit("Take it"), F.lit("2026-10-06"), F.lit("1d"), F.lit("r")), lambda e: F.concat_ws(":", e["uid"], e["start"], F.coalesce(e["rrule"], F.lit("")))), "|"))
cases("dates_lists", "note string", [("now", "• Pay: 2026-10-07 (now)\n• Rent: 2026-11-01"), ("", "• Pay: 2026-10-07\n• Rent: 2026-11-01")],
      lambda n: calendar.dates_text(F.array(F.struct(F.lit("Pay").alias("title"), F.lit("2026-10-07").alias("start"), n.alias("description")), F.struct(F.lit("Rent").alias("title"), F.lit("2026-11-01").alias("start"), F.lit(None).cast("string").alias("description")))))
cases("calendar_links", "note string", [("by me", "https://calendar.example.org/render?action=TEMPLATE&text=Pay%20%26%20go&dates=20261007/20261007&details=by%20me|https://message.example.org/?text=by%20me"), ("", "https://calendar.example.org/render?action=TEMPLATE&text=Pay%20%26%20go&dates=20261007/20261007|https://message.example.org/?text=")],
      lambda n: F.concat_ws("|", calendar.calendar_link("https://calendar.example.org/render", F.lit("Pay & go"), F.lit("2026-10-07"), n), calendar.message_link("https://message.example.org/?text=", n)))
cases("result_titles", "kind string, issuer string, day string, title string", [("Lab report", "Green Leaf, City", "2026-10-01", "T", "Lab report · Green Leaf · 1 Oct"), ("", "", "", "T", "T"), ("", "Dr. Rao", "", "", "Document")], overview.result_title)
cases("asks_kept", "n int", [(3, "4:1,4"), (39, "40:1,40"), (45, "40:7,46")], lambda n: bind(lambda x: F.concat(F.size(x["a"]).cast("string"), F.lit(":"), F.get(x["a"], F.lit(0)).cast("string"), F.lit(","), F.element_at(x["a"], -1).cast("string")), a=stores.asks_appended(F.sequence(F.lit(1), n), F.array(n + 1))))
cases("translations_put", "lang string", [("ta", "hi=a,ta=new"), ("hi", "hi=new")], lambda l: F.array_join(F.transform(F.array_sort(F.map_entries(stores.translation_put(F.create_map(F.lit("hi"), F.lit("a")), l, F.lit("new")))), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))
cases("starter_questions", "kind string", [("lab_report", "askLab1,askLab2,askLab3"), ("school", "askGeneric1,askGeneric2,askGeneric3"), ("loan", "askMoney1,askMoney2,askMoney3")], lambda k: F.array_join(blocks.starter_chips(k), ","))
cases("reading_variants", "photo boolean, files int, lang string, before string, forced string", [(True, 1, "en", None, None, "B"), (False, 3, "en", "B", None, "C"), (False, 1, "ta", None, None, "C"), (False, 1, "en", "A", None, "D"), (False, 1, "auto", None, None, "A"), (False, 1, "en", "D", "B", "B"), (False, 1, None, "D", "x", "A")], blocks.reading_variant)
cases("document_names", "name string, title string", [(" Mine ", "T", "Mine|Mine"), ("", " T ", "T| T "), (None, None, "|"), ("x" * 70, "T", "x" * 60 + "|" + "x" * 60)], lambda n, t: F.concat_ws("|", results.renamed(n, t), results.visible_title(n, t)))
cases("ask_contexts", "raw string", [('{"document_kind": "loan", "source_text": "secret", "title": "T"}', 'loan|{"document_kind": "loan", "title": "T"}'), ('{"doc_type": "bank", "parts": [{"source_text": "s", "title": "é"}, "x"]}', 'bank|{"doc_type": "bank", "parts": [{"title": "é"}, "x"]}'), ("not json", "|not json"), ("[1]", "|[1]"), (None, "|{}"), ("", "|{}"), ("null", "|null"), ('{"document_kind": "", "doc_type": 5}', '5|{"document_kind": "", "doc_type": 5}')],
      lambda r: bind(lambda x: F.concat_ws("|", x["c"]["kind"], x["c"]["context"]), c=answers.ask_context(r)))


def _parse(ddl):
    return StructType.fromDDL(ddl.removeprefix("struct<").removesuffix(">"))


def _activity(key, done, rating, lang, report):
    some = lambda kind: F.create_map(F.lit(key), F.lit(done).cast(kind))
    flags = [some("boolean").alias(n) for n in ("done", "added", "slots")]
    return F.struct(*flags, some("string").alias("times"), some("int").alias("durations"), F.lit(rating).cast("string").alias("rating"), F.lit(lang).alias("lang"), F.lit(report).cast("int").alias("report"))


_NESTED = "struct<title:string,n:int,parts:array<struct<heading:string,lines:array<string>>>,notes:map<string,string>>"
cases("activity_patches", f"has {_STR}", [([], "d=true|up|en|3"), (["done", "rating"], "x=false||en|3"), (["medicine", "report", "lang"], "d=true|up|ta|")],
      lambda h: bind(lambda x: F.concat_ws("|", F.array_join(F.transform(F.map_entries(x["r"]["done"]), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","), x["r"]["rating"], x["r"]["lang"], F.coalesce(x["r"]["report"].cast("string"), F.lit(""))), r=dues.activity_with(_activity("d", True, "up", "en", 3), _activity("x", False, None, "ta", None), h)))
cases("shown_blocks", f"has {_STR}, kind string, n int, dated boolean", [
    (["summary", "actions", "contacts"], "loan", 0, False, "simpleWords,actions,places"), (["tenure", "emi_amount"], "loan", 0, False, "nextEmi,loanTerms"), (["directions"], "government_notice", 0, False, "directions"), (["directions", "actions"], "government_notice", 0, True, "actions"),
    ([], "lab_report", 0, False, "notADiagnosis"), (["facts"], "lab_report", 6, False, "sections,notADiagnosis,facts"), (["line_items", "warranty_until", "deduction_reasons"], "invoice", 0, False, "items,warranty,watchOut"), ([], "other", 0, False, ""),
], lambda h, k, n, d: F.array_join(blocks.blocks(h, k, n, d), ","))
cases("kind_layouts", f"kind string, parts int, n int, generic string, has {_STR}, dated boolean", [
    ("loan", 2, 0, "E", [], False, "multi"), ("lab_report", 1, 5, "E", [], False, "Dplus"), ("lab_report", 0, 4, "E", [], False, "D"), ("loan", 0, 0, "E", ["emi_amount"], False, "B"), ("insurance", 0, 0, "A", [], False, "A"), ("insurance", 0, 0, "B", [], False, "F"), ("court_legal", 0, 0, "E", [], False, "C"),
    ("government_notice", 0, 0, "E", [], True, "C"), ("school", 0, 0, "E", [], False, "B"), ("receipt", 0, 0, "B", [], False, "B"), ("telecom_bill", 0, 0, "F", [], False, "F"), ("discharge_summary", 0, 0, "E", ["follow_up"], False, "C"),
], lambda k, p, n, g, h, d: blocks.layout(k, p, n, g, h, d, F.lit(False), F.lit(False)))
cases("masked_results", "born string", [("DOB: 14/05/1980", "Mr. R***|7|DOB: [hidden]|on [hidden], call **********|kept"), ("no date", "Mr. R***|7|no date|on 14 May 1980, call **********|kept")],
      lambda b: bind(lambda x: F.concat_ws("|", x["r"]["title"], x["r"]["n"].cast("string"), x["r"]["parts"][0]["heading"], x["r"]["parts"][0]["lines"][0], x["r"]["notes"]["k"]),
                     r=sharing.masked_result(F.struct(F.lit("Mr. Ravi").alias("title"), F.lit(7).alias("n"), F.array(F.struct(b.alias("heading"), F.array(F.lit("on 14 May 1980, call 9876543210")).alias("lines"))).alias("parts"), F.create_map(F.lit("k"), F.lit("kept")).alias("notes")), _parse(_NESTED), F.array(F.lit("Ravi")))))
cases("printed_medicine_times", "raw string, food string, days int", [("1-0-1", "after_food", 5, "morning,night|after_food|5"), ("0-0-1 x 2 weeks", "At Bedtime", 5, "bedtime|at_bedtime|14"), ("BD before food", "unknown", None, "morning,night|before_food"), ("", "after_food", 3, "|3"), ("OD", None, None, "morning")],
      lambda r, f, d: bind(lambda x: F.concat_ws("|", F.array_join(x["m"]["slots"], ","), x["m"]["food"], x["m"]["days"].cast("string")), m=decoders.medicine_frequency(r, f, d)))
