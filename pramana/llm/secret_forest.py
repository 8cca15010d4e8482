"""Secret scans: candidates by pattern, false positives removed by a random forest.

All of it is DataFrame work. Candidates are runs of at least 16 token characters
with a digit or of 20 without; what follows a secret word (6 characters behind an
assignment, 8 with a digit behind blanks) in any signs; passwords in URLs; runs
behind known prefixes; private keys in PEM. Its features are length, character classes and changes between
them, common letter pairs, coverage by dictionary words, whether it stands in a
path, and the words beside it. The forest is trained on labelled findings:
a table of (before, value, after, label); `labelled_findings` makes one by rule.

Null and empty texts have no findings. A value that occurs several times gives
a finding for each place, and each is judged by itself. Rows that share a key, or
have none, are scanned each. Texts are scanned whole, whatever their length. An
empty table gives an empty result. Other columns, of any name, are not looked at.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import unused

CONTEXT = 48
TREES, DEPTH, SEED = 40, 7, 11
LABELLED = 6000
MASK = "[SECRET]"

# Words that make a run of letters readable, letter pairs of ordinary words, and words beside findings.
WORDS = ["version", "release", "default", "number", "object", "order", "image", "index", "model", "table", "build", "linux", "local", "share", "cache", "test", "data", "file", "name", "page", "user", "item", "code", "type", "list", "text", "main", "html", "json", "www", "com", "the", "and", "for", "ion", "ing", "ent", "que", "est", "les", "des", "eur", "ment", "und", "der", "die", "sch", "ung", "ein", "los", "las", "del", "con", "por", "ado"]
PAIRS = ["th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "is", "it", "al", "ar", "st", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "me", "de", "ch", "qu", "ue", "ei", "ie", "el", "la", "ra", "ne", "un"]
SECRET_WORDS = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "auth", "bearer", "credential", "key"]
OTHER_WORDS = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "etag", "revision", "blob", "order", "invoice", "phone", "card", "isbn", "request", "session-id", "id"]
_CHARS = "A-Za-z0-9_+/=-"
_PREFIX = "AKIA|ASIA|gh[pousr]_|github_pat_|sk_live_|sk-|xox[abp]-|AIza|eyJ|glpat-"
_SECRET = "|".join(sorted(SECRET_WORDS, key=len, reverse=True))
_PEM = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
_RUN = rf"(?<![A-Za-z0-9_+/-])(?=[{_CHARS}]{{16}})(?![A-Za-z0-9_+/-]{{1,40}}+=[^=\s])"  # long enough; at a name before an assignment no run begins
_SHAPES = [
    rf"{_PEM}(?:[\s\S]{{0,8000}}?-----END [A-Z ]{{0,20}}PRIVATE KEY-----|[A-Za-z0-9+/=\s]{{16,}})",
    r"(?<=:)(?<=://[^\s:/@]{0,64}:)[^\s/@]{3,}(?=@)",
    rf"(?<=[=:>\s\"'`])(?<=(?:[=:>]|\bis)\s{{0,3}}[\"'`]?)(?<=(?i:{_SECRET})[\"'`]?\s{{0,3}}(?::=|=>|=|:|is\b)\s{{0,3}}[\"'`]?)[^\s\"'`=:>][^\s\"'`]{{5,}}",
    rf"(?<=[\s\"'`])(?<=(?i:{_SECRET})\s{{1,3}}[\"'`]?)(?=[^\s\"'`]*[0-9])[^\s\"'`=:>][^\s\"'`]{{7,}}",
    rf"(?<![{_CHARS}])(?:{_PREFIX})[A-Za-z0-9_-][.{_CHARS}]{{7,}}",
    rf"{_RUN}(?=[A-Za-z_+/=-]*+[0-9])[{_CHARS}]{{16,}}",
    rf"{_RUN}[{_CHARS}]{{20,}}",
]
CANDIDATE = "|".join(_SHAPES)
#: What can match in a text without a secret word: all but the third and fourth shape, which look back at every word. And what secret words have in common.
PLAIN_CANDIDATE, WORD_PARTS = "|".join(_SHAPES[:2] + _SHAPES[4:]), ["token", "secret", "passw", "pwd", "key", "auth", "bearer", "credential"]
FEATURES = ["length", "digits", "uppers", "signs", "kinds", "changes", "hex", "pairs", "words", "path", "near_secret", "near_other", "assigned", "quoted", "prefix", "others", "url", "pem", "placeholder"]


def _any(words: list[str]) -> str:
    return "|".join(words)


def with_features(found: DataFrame) -> DataFrame:
    """`found` (before, value, after) with the columns of FEATURES."""
    v, low = F.col("value"), F.lower("value")
    before = F.lower(F.col("before"))
    n = F.length(v).cast("double")

    def share(pattern: str, of: Column = v) -> Column:
        return F.regexp_count(of, F.lit(pattern)) / n

    return found.withColumns(
        {
            "length": n,
            "digits": share("[0-9]"),
            "uppers": share("[A-Z]"),
            "signs": share("[_+/=-]"),
            "kinds": F.size(F.array_distinct(F.split(v, ""))) / n,
            "changes": share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[_+/=-](?=[A-Za-z0-9])"),
            "hex": v.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
            "pairs": share(f"(?=({_any(PAIRS)}))", low),
            "words": (n - F.length(F.regexp_replace(low, _any(WORDS), ""))) / n,
            "path": (v.rlike("/[A-Za-z_-]+/|^/|/.*/") | before.rlike(r"(https?:|www\.|[/\\.~])$") | F.col("after").rlike(r"^(\.[a-z]{2,4}\b|[\\?#])")).cast("double"),
            "near_secret": before.rlike(rf"({_any(SECRET_WORDS)})[^a-z]*$|({_any(SECRET_WORDS)})\W+(is|of|value)?\W*$").cast("double"),
            "near_other": before.rlike(rf"\b({_any(OTHER_WORDS)})[^a-z]*$").cast("double"),
            "assigned": before.rlike(r"[=:]\s*[\"'`]?$").cast("double"),
            "quoted": (before.rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).cast("double"),
            "prefix": v.rlike(f"^({_PREFIX})").cast("double"),
            "others": share(r"[^A-Za-z0-9_+/=\-]"),
            "url": (before.rlike(r"://[^\s:/@]*:$") & F.col("after").startswith("@")).cast("double"),
            "pem": v.rlike(_PEM).cast("double"),
            "placeholder": v.rlike(r"^[<{$%\[(]|^(?i:your|example|changeme|xxx|none|null|true|false|env|os\.)|^\*+|\($").cast("double"),
        }
    )


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """(before, value, after, label): findings made by rule, half of them secrets, with and without a secret word before. `n` bounds the table."""
    i = F.col("id")
    digest = lambda salt: F.sha2(F.concat(i.cast("string"), F.lit(salt)), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(digest("mixed"))), "=", "")
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    draw = lambda k, salt: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(k))
    word = F.concat_ws("-", pick(WORDS[:20], "a"), pick(WORDS[:20], "b"), pick(WORDS[:20], "c"))
    filler = F.concat(pick(["the ", "and with ", "see ", "on the ", "est le ", "der die ", "para la "], "f"))
    quote = pick(['"', "'", "", '"'], "q")
    equals = pick([" = ", "=", ": ", " := "], "e")
    letters = F.translate(mixed, "0123456789+/", "qZxWkVjYwKgH")
    short = F.concat(F.substring(mixed, 1, 4), pick(["&", "!", "#", "@1", "$", "9", "7x", "%", "?2", "*"], "g"), F.substring(mixed, 6, 3), F.substring(mixed, 12, draw(7, "m").cast("int")))
    prefix = pick(["AKIA", "AKIA1", "ghp_", "ghp_1", "sk_live_", "sk_live_1", "glpat-", "glpat-1", "AIza", "xoxb-", "eyJ", "github_pat_"], "p")
    key = F.concat(prefix, F.substring(F.when(draw(3, "l") == 0, letters).otherwise(mixed), 1, 24))
    told = F.concat(filler, pick(SECRET_WORDS, "t"), equals, quote)
    spaced = F.concat(filler, pick(SECRET_WORDS, "t"), pick([" ", " is ", " "], "sp"))
    closed, plain = F.concat(quote, F.lit(" ")), pick([" ", ", ", ". "], "pl")
    pem = F.concat(F.lit("-----BEGIN "), pick(["", "RSA ", "EC "], "pk"), F.lit("PRIVATE KEY-----\n"), mixed, mixed, F.lit("\n-----END PRIVATE KEY-----"))
    secrets = [
        (told, F.substring(digest("x"), 1, 40), closed),
        (told, F.substring(digest("x"), 1, 32), closed),
        (told, F.substring(mixed, 1, 36), closed),
        (told, key, closed),
        (filler, key, plain),
        (told, short, closed),
        (F.concat(filler, pick(["https://", "postgres://", "ftp://"], "u"), pick(["admin:", "root:", "me:"], "us")), short, pick(["@host", "@db.example.com/x"], "ho")),
        (told, F.concat(pick(WORDS, "h1"), draw(90, "h2").cast("string"), pick(WORDS, "h3"), pick(["!", "#", "$", "!!", "?"], "h4")), closed),
        (told, F.substring(letters, 1, F.lit(24) + draw(16, "le").cast("int")), closed),
        (filler, F.substring(letters, 1, F.lit(28) + draw(14, "le").cast("int")), plain),
        (spaced, short, plain),
        (filler, pem, plain),
    ]
    kinds = [
        (F.concat(filler, pick(OTHER_WORDS, "o"), pick([" ", ": ", "="], "n")), F.substring(digest("c"), 1, 40), F.lit(" ")),
        (F.concat(filler, F.lit("/usr/")), F.concat(word, F.lit("/lib"), draw(1000, "v").cast("string"), F.lit("/"), pick(WORDS, "d")), F.lit(".html")),
        (filler, F.lpad((draw(1_000_000_000, "n") * 7_654_321).cast("string"), 17, "4"), F.lit(" ")),
        (filler, F.concat(word, F.lit("-"), draw(100, "w").cast("string")), F.lit(" ")),
        (F.concat(pick(SECRET_WORDS, "t"), equals), F.concat(F.lit("your_"), F.translate(word, "-", "_"), F.lit("_0"), draw(10, "y").cast("string")), F.lit(" ")),
        (filler, F.concat_ws("-", F.substring(digest("u"), 1, 8), F.substring(digest("u"), 9, 4), F.substring(digest("u"), 13, 4), F.substring(digest("u"), 17, 12)), F.lit(" ")),
        (filler, F.repeat(F.concat(pick(["=", "-", "x", "0", "ab"], "r"), draw(10, "z").cast("string")), 12), F.lit(" ")),
        (told, pick(["required", "optional", "missing", "string,", "unknown", "contraseña", "Passwort", "obligatoire", "the-name", "deleted", "accepted.", "richtig", "nombre", "valeur"], "w1"), closed),
        (told, F.concat(pick(["<", "${", "{{", "%(", "os.environ[", "getenv("], "ph"), F.translate(word, "-", "_"), pick([">", "}", "}}", ")s", "]", ")"], "ph")), closed),
        (filler, F.concat(pick(["fahrzeug", "bundes", "ent", "anti", "über"], "c1"), F.translate(word, "-", ""), pick(["schaftung", "mentalisation", "lichkeit", "amiento", "izations"], "c2"), pick(["", "en", "que"], "c3")), plain),
        (filler, F.concat(pick(["get", "set", "make", "is"], "d1"), F.translate(F.initcap(F.translate(word, "-", " ")), " ", ""), pick(["Listener", "Handler", "FromCache", "ForOrder"], "d2")), plain),
        (F.concat(filler, F.lit("https://user:")), pick(["<password>", "{password}", "${PASSWORD}", "password"], "up"), F.lit("@host")),
        (spaced, F.concat(pick(["version", "number", "order", "page-", "chapter"], "v1"), draw(100, "v2").cast("string")), plain),
    ]
    made = lambda of, salt: F.get(F.array(*(F.struct(x.alias("before"), y.alias("value"), z.alias("after")) for x, y, z in of)), draw(len(of), salt).cast("int"))
    label = (i % 2).cast("double")
    one = F.when(label == 1, made(secrets, "s")).otherwise(made(kinds, "kind"))
    # Exploded, so that Spark does not write the expression of a value into each of its features.
    rows = spark.range(n).select(label.alias("label"), F.explode(F.array(one)).alias("x"))
    return rows.select("x.before", "x.value", "x.after", "label")


def train(labelled: DataFrame) -> RandomForestClassificationModel:
    """The forest, from findings (before, value, after, label)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(labelled.where("value <> ''")))
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows.select("features", "label"))


def _found(t: Column) -> Column:
    """All candidates of a text, in order."""
    worded = reduce(or_, (F.contains(F.lower(t), F.lit(w)) for w in WORD_PARTS))
    return F.when(worded, F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))).otherwise(F.regexp_extract_all(t, F.lit(PLAIN_CANDIDATE), F.lit(0)))


def _rest(t: Column) -> Column:
    """What stands before, between and behind the candidates of a text that has some."""
    return F.split(t, CANDIDATE, -1)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, finding (from 0), start (in code points), value, before, after for each candidate."""
    t = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.col(key).alias("key"), _found(t).alias("found"), t.alias("t")).where(F.size("found") > 0)
    cut = cut.select("key", "found", _rest(F.col("t")).alias("rest"), F.monotonically_increasing_id().alias("row"))
    one = F.transform(
        F.sequence(F.lit(0), F.size("found") - 1),
        lambda i: F.struct(
            F.get("found", i).alias("value"),
            F.right(F.get("rest", i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get("rest", i + 1), F.lit(CONTEXT)).alias("after"),
            (F.length(F.get("rest", i)) + F.coalesce(F.length(F.get("found", i - 1)), F.lit(0))).alias("step"),
        ),
    )
    rows = cut.select("key", "row", F.posexplode(one).alias("finding", "x"))
    order = Window.partitionBy("row").orderBy("finding")
    return rows.select(F.col("key").alias(key), "finding", F.sum("x.step").over(order).alias("start"), "x.value", "x.before", "x.after")


def scan(docs: DataFrame, model: RandomForestClassificationModel, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Candidates with probability and is_secret (probability of at least `least`)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(candidates(docs, key, text)))
    scored = model.transform(rows).withColumn("probability", F.get(vector_to_array("probability"), 1))
    return scored.select(key, "finding", "start", "value", "before", "after", F.round("probability", 6).alias("probability"), (F.col("probability") >= least).alias("is_secret"))


def redact(docs: DataFrame, model: RandomForestClassificationModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with every accepted finding in its text replaced by MASK at its place, and so are findings of the same text with the same value; all rows and columns stay.

    What is found depends on the text alone, so a row is told by two hashes of its text,
    not by its key: rows that share a key, or have none, do not meet. Only the numbers of
    accepted findings come back to the text, which is cut at its candidates once more.
    """
    name, hidden = unused(docs, "text_name", "hidden")
    of = F.struct(F.xxhash64(text), F.xxhash64(F.lit("text"), text))
    named = docs.select(of.alias("of"), F.col(text).alias("text"))
    secrets = scan(named, model, "of", "text").where("is_secret").groupBy(F.col("of").alias(name)).agg(F.collect_set("finding").alias(hidden))
    joined = docs.withColumn(unused(docs, "of")[0], of)
    joined = joined.join(secrets, joined[unused(docs, "of")[0]] == secrets[name], "left")
    accepted = lambda found: F.filter(found, lambda x, i: F.array_contains(F.col(hidden), i))
    once = lambda value, make: F.get(F.transform(F.array(value), make), 0)
    both = once(_found(F.col(text)), lambda found: F.struct(found.alias("all"), accepted(found).alias("accepted")))
    shown = once(both, lambda b: F.transform(b["all"], lambda x: F.when(F.array_contains(b["accepted"], x), MASK).otherwise(x)))
    pieces = F.zip_with(_rest(F.col(text)), shown, lambda r, f: F.concat(r, F.coalesce(f, F.lit(""))))
    clean = F.when(F.col(hidden).isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))
    return joined.withColumn(text, clean).select(*docs.columns)
