"""Many terms in texts, masking that is linear in the text, texts that stay apart."""

import random
import re
import time

from pyspark.sql import functions as F

from pramana.functions import names, terms
from pramana.operators import masking, privacy, sharing
from pramana.operators.terms import occurrences


def plain_replaced(text, given):
    """Longest first, then the one that stands first; no overlaps: tried place by place."""
    taken = [None] * len(text)
    for term in sorted(dict.fromkeys(t for t in given if t), key=len, reverse=True):
        at = text.find(term)
        while at >= 0:
            if all(x is None for x in taken[at : at + len(term)]):
                taken[at : at + len(term)] = [(term, at)] * len(term)
            at = text.find(term, at + 1)
    out, i = [], 0
    while i < len(text):
        out.append(text[i] if taken[i] is None else f"<{taken[i][0]}>")
        i += 1 if taken[i] is None else len(taken[i][0])
    return "".join(out)


def test_cut_like_plain_python(spark):
    rng = random.Random(1)
    rows = [("", ["a"]), (None, ["a"]), ("abc", None), ("abc", []), ("abc", [None, "", "b", "b"]), ("नमस्ते 🙂🙂", ["🙂", "मस्"])]
    for _ in range(300):
        word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randrange(n)))
        text, given = word(40), [word(5) for _ in range(rng.randrange(6))]
        of_one_length = {}
        for t in given:  # equal lengths that overlap are taken by place, which the plain version does term by term
            of_one_length.setdefault(len(t), t)
        rows.append((text, list(of_one_length.values())))
    table = spark.createDataFrame(rows, "t string, terms array<string>")
    found = table.select("t", "terms", terms.replaced(F.col("t"), F.col("terms"), lambda p: F.concat(F.lit("<"), p["term"], F.lit(">"))).alias("r"), terms.within(F.col("t"), F.col("terms")).alias("w"), terms.replaced_each(F.array("t", F.lit("ab")), F.col("terms"), lambda p: F.lit("_")).alias("e")).collect()
    for r in found:
        given = [x for x in r["terms"] or [] if x]
        assert r["r"] == (None if r["t"] is None else plain_replaced(r["t"], given))
        assert r["w"] == [x for x in dict.fromkeys(given) if x in (r["t"] or "")]
        assert r["e"][1] == ("_" if "ab" in given else re.sub("a|b", lambda m: "_" if m[0] in given else m[0], "ab"))


def test_ten_thousand_terms_are_linear():
    words = [f"name{i:05d}" for i in range(10_000)]
    machine = terms.automaton(tuple(words))
    text = " and ".join(words)
    begun = time.time()
    short = terms.chosen(terms.hits(text, machine))
    middle = time.time()
    long = terms.chosen(terms.hits(text * 8, machine))
    spent, spent_long = middle - begun, time.time() - middle
    assert len(short) == 10_000 and len(long) == 80_000
    assert spent_long < 24 * max(spent, 0.01)


def test_occurrences_in_parts(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["aa", "ab", "ba b", "ca"]) for _ in range(rng.randrange(30)))) for i in range(60)] + [(900, None), (901, ""), (None, "aa ab")]
    given = ["aa", "a b", "b", "ca aa", "zz", "", None, "aa"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, term string").repartition(3)
    table = spark.createDataFrame([(t, 1) for t in given], "term string, places int")
    wanted = sorted(((str(i), t, len(re.findall(f"(?={t})", x))) for i, x in texts if x for t in {"aa", "a b", "b", "ca aa", "zz"} if t in x))
    for part_bytes in (1 << 20, 3):
        found = occurrences(docs, table, part_bytes=part_bytes)
        assert found.columns == ["doc_id", "term", "places"]
        assert sorted((str(r["doc_id"]), r["term"], r["places"]) for r in found.collect()) == wanted
    assert occurrences(docs, table.limit(0)).count() == 0 and occurrences(docs.limit(0), table).count() == 0


def test_names_and_spans(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    given = F.array(F.lit("Rao"), F.lit("Asha Rao"), F.lit(" "), F.lit("Asha"))
    assert value(privacy.with_names_masked(F.lit("Asha Rao met Rao and Asha"), given)) == "A*** R** met R** and A***"
    spans = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(k).alias("type")) for t, k in [("98765 43210", "phone"), ("98765", "id"), ("a", "person"), ("x", "none"), ("Asha", "person")]))
    shown = value(sharing.with_spans_masked(F.lit("Asha 98765 43210, 98765"), spans, F.lit("en")))
    assert shown.startswith("A*** **********, ") and "98765" not in shown
    assert value(sharing.with_spans_masked(F.lit(None).cast("string"), spans, F.lit("en"))) == ""
    rendered = F.create_map(F.lit("Rao"), F.array(F.lit("ராவ்")), F.lit("Asha"), F.array().cast("array<string>"))
    assert value(names.rendered_missing(rendered, F.lit("இது ராவ்"))) == ["Asha"]
    assert value(privacy.leaks(F.array(F.lit("12"), F.lit("9"), F.lit("12")), F.lit("a 12"), F.lit("9 12"))) == 5


def test_texts_of_a_result_stay_apart(spark):
    """A text that holds any sign, also the one that once parted texts, stays in its own place."""
    texts = F.array(F.lit("born on 02.03.1961 \u0001 here"), F.lit("call 9876543210"), F.lit(""), F.lit("on 02.03.1961 and 1 May 2020"))
    found = spark.range(1).select(sharing.masked_texts(texts, F.array(F.lit("here"))).alias("x")).first()["x"]
    assert len(found) == 4 and found[0].count("\u0001") == 1 and found[1] == "call **********" and found[2] == ""
    assert "1961" not in found[0] and "1961" not in found[3] and "1 May 2020" in found[3]


def test_long_runs_of_address_characters():
    begun = time.time()
    assert masking.spans_in("a" * 1_000_000 + " x@y.org " + "b" * 1_000_000)[0][1] == "x@y.org"
    assert time.time() - begun < 10
    assert [x for _, x, _ in masking.spans_in("a@b.co.x@y.zz a@b@c.com .@. @")] == ["a@b.co", ".x@y.zz", "b@c.com"]
