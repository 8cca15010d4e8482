"""Lexical search, the Jaccard join and periodic runs against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from pramana.llm import entry_queries, lexical_scan, parity_join, periodic_runs

DATA = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", "  \t\n", "one", "One two", "é É x", "\x1ca\x1c a", "x" * 70000, "a " * 30000, "\n" * 1000000, " " * 1000000, "🙂 b🙂 🙂", "the end. The END; the-end"]
SCHEMA = "doc_id long, text string, n long, score double, item string, component_id string, rank string, runs string"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, texts, parts=3, first=0):
    rows = [(i + first, t, 1, 2.0, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def made_texts(seed, n=150):
    """Texts over few words, some of them copies, near-copies or parts of each other."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out).split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randrange(2)] = [rng.choice("Abcdefgh") * rng.randrange(1, 4)] * rng.randrange(2)
        else:
            words = [rng.choice("abcdEfgh") * rng.randrange(1, 4) for _ in range(rng.choice([1, 2, 3, 4, 8, 20, 60, 200]))]
        out.append(rng.choice([" ", "\t", "  "]).join(words))
    return out


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_jaccard_join"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = entry_queries.queries()[name](spark, DATA)
    wanted = con.sql(entry_queries.oracle_sql()[name])
    assert found.columns == wanted.columns
    assert sorted(map(tuple, found.collect())) == sorted(wanted.fetchall())


def plain_ranks(docs, items, k=10):
    """(item, rank, doc, score) in plain Python; docs and items are lists of (id, text)."""
    held = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(TERM.findall(low(t)))
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=lambda x: x[:2])


@pytest.mark.parametrize("part_bytes", [1 << 20, 60])
def test_lexical_scan_like_plain_python(spark, part_bytes):
    texts = [*ODD, *made_texts(1), *made_texts(1)[:20], "unseen"]
    items = [(1, "a bb ccc"), (2, "ONE, two; é 🙂"), (3, None), (4, "..."), (5, "nowhere"), (6, " ".join(made_texts(2, 10))), (7, "the end the end"), (7, "one"), (None, "a"), (8, "É x")]
    docs = documents(spark, texts).unionByName(documents(spark, ["a bb", "a bb", "one"]).selectExpr("CAST(NULL AS long) AS doc_id", *SCHEMA.replace("doc_id long, ", "").replace(" long", "").replace(" double", "").replace(" string", "").split(", ")))
    table = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    found = lexical_scan.rank(docs, table, part_bytes=part_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    given = [(i, t) for i, t in enumerate(texts)] + [(None, t) for t in ("a bb", "a bb", "one")]
    assert sorted(map(tuple, found.collect()), key=lambda x: x[:2]) == plain_ranks(given, items)
    assert lexical_scan.rank(docs.limit(0), table).count() == 0 and lexical_scan.rank(docs, table.limit(0)).count() == 0


def plain_sets(texts):
    words = [WORD.findall(low(t)) for t in texts]
    return [{" ".join(w)} if 0 < len(w) < 3 else {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} for w in words]


def plain_components(sets, keys):
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    return [least.get(top(i)) for i in range(len(sets))]


@pytest.mark.parametrize("unit", [parity_join.UNIT, 40])
def test_jaccard_join_like_plain_python(spark, unit):
    texts = [*ODD, *ODD, *made_texts(3, 200)]
    keys = [None if i in (15, 40, 41) else i // 2 if i > 190 else i for i in range(len(texts))]
    rows = [(k, t, 1, 2.0, "c", "c", "c", "c") for k, t in zip(keys, texts, strict=True)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = parity_join.near_sets(docs.unionByName(docs.where("doc_id in (3, 30)")), unit=unit)
    sets = plain_sets(texts)
    wanted = list(zip(keys, map(len, sets), plain_components(sets, keys), strict=True))
    wanted += [w for w in wanted if w[0] in (3, 30)]
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    assert len({w[2] for w in wanted}) < len(wanted) - 30
    assert parity_join.near_sets(docs.limit(0)).count() == 0


def test_bands_and_sketches():
    edges = parity_join.bands(most=100_000)
    for size in range(1, 3000):
        band = np.searchsorted(edges, size, side="right") - 1
        assert size * 100 // 90 < edges[band + 2]  # the largest partner is in the next band at most
        for union in (size, size * 100 // 90):
            assert union - -(-90 * union // 100) <= parity_join.scheme(int(band))[0]
    rng = np.random.default_rng(1)
    for _ in range(200):
        one = rng.integers(0, 1 << 62, rng.integers(1, 400)).astype(np.uint64)
        two = np.unique(np.r_[one[rng.random(len(one)) > 0.1], rng.integers(0, 1 << 62, 20).astype(np.uint64)])
        one = np.unique(one)
        differ = len(np.setxor1d(one, two))
        bits = len(np.setxor1d(parity_join.sketch(one, 9), parity_join.sketch(two, 9)))
        assert bits <= differ and (differ - bits) % 2 == 0


def test_linked_sets_share_a_segment():
    """Any two linked sets meet: one by its band, the other by its own or the one before."""
    rng = np.random.default_rng(2)
    edges = parity_join.bands()
    met = 0
    for _ in range(600):
        n = int(rng.choice([1, 5, 9, 10, 30, 100, 450]))
        one = rng.integers(0, 1 << 62, n).astype(np.uint64)
        two = one.copy()
        union = n * 100 // 90
        for _ in range(int(rng.integers(0, union // 10 + 1))):  # take out or put in, as far as a link allows
            two = two[1:] if rng.random() < 0.5 and len(two) > 1 else np.r_[two, rng.integers(0, 1 << 62, 1).astype(np.uint64)]
        both, shared = len(np.union1d(one, two)), len(np.intersect1d(one, two))
        if 100 * shared < 90 * both:
            continue
        small, large = sorted((one, two), key=len)
        a, b = (int(np.searchsorted(edges, len(x), side="right")) - 1 for x in (small, large))
        assert b - a in (0, 1)
        assert len(np.intersect1d(parity_join.segment_keys(small, a), parity_join.segment_keys(large, a)))
        met += 1
    assert met > 300


def plain_runs(words, shortest=12):
    """Every stretch of period q that nothing extends, for the least q of each stretch."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(shortest, 2 * q):
                found.setdefault((start, i + q - start), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_like_brute_force():
    rng = random.Random(4)
    for trial in range(400):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            words = [b"abcde"[c : c + 1] for c in (rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.choice([0, 1, 5, 11, 12, 13, 30, 60, 120])))]
            if words and rng.random() < 0.5:
                a = rng.randrange(len(words))
                p = 1 + (len(words) - a) // (3 + rng.randrange(8))
                words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
            texts.append(words)
        shortest = (12, 6, 5)[trial % 3]
        assert periodic_runs.runs_of(texts, shortest) == [plain_runs(w, shortest) for w in texts]


def test_runs_of_long_texts():
    assert periodic_runs.runs_of([[b"a"] * 300000, [b"a", b"b"] * 50000]) == [[(0, 300000, 1)], [(0, 100000, 2)]]
    words = [str(i).encode() for i in range(40000)]
    assert periodic_runs.runs_of([words + words + words[:5]]) == [[(0, 80005, 40000)]]


def planted(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def plain_digest(doc_id, text):
    words = planted(doc_id, text)
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    exponent = best[1] * 1000 // best[2] if found else None
    return (doc_id, len(found), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_query(spark, tmp_path):
    """Odd texts, every planted document of the smallest table and many more, the registered query against plain Python."""
    texts = [t if not t or len(t) < 9000 else t[:3000] for t in ODD]
    texts += ["so it goes on " * 9 + "and ends", "a b " * 7 + "c " * 14, *made_texts(5, 60)]
    texts += [t * 5 for t in made_texts(6, 30)]
    docs = documents(spark, texts * 2).unionByName(documents(spark, ["x y " * 8]).selectExpr("CAST(NULL AS long) AS doc_id", *SCHEMA.replace("doc_id long, ", "").replace(" long", "").replace(" double", "").replace(" string", "").split(", ")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = entry_queries.queries()["op13_periodic_runs"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    wanted = [plain_digest(i, t) for i, t in enumerate(texts * 2)] + [plain_digest(None, "x y " * 8)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    assert sum(w[1] > 0 for w in wanted) > 20
    given = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: tuple(r) for r in entry_queries.queries()["op13_periodic_runs"](spark, DATA).collect()}
    assert len(rows) == len(given)
    for d, t in given:
        if len(planted(d, t)) < 1500:
            assert rows[d] == plain_digest(d, t)


def test_rows_that_may_be_members(spark):
    from pramana.llm.common import likely_in

    rows = spark.range(0, 20000).selectExpr("CASE WHEN id % 50 = 0 THEN NULL ELSE id END AS key", "id AS tie", "'x' AS bucket_", "id")
    members = rows.where("id % 37 = 0").select("key", "tie")
    found = {r["id"] for r in likely_in(rows, members, ["key", "tie"], 1 << 22).collect()}
    assert {i for i in range(20000) if i % 37 == 0} <= found and len(found) < 1000
    assert likely_in(rows, members.limit(0), ["key", "tie"]).count() == 0 and likely_in(rows, members, ["key"]).columns == rows.columns
