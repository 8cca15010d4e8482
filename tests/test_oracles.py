"""Every registered query against its SQL, on the smallest tables."""

import datetime

import duckdb
import pyarrow as pa
import pytest

from pramana import plans
from pramana.operators import masking

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows(table: pa.Table) -> list[tuple]:
    """Rows as text, in order. Arrow keeps whole numbers beside nulls whole, where pandas makes them floats."""

    def plain(x):
        if isinstance(x, datetime.datetime):
            return str(x.replace(tzinfo=None))
        return f"{x:.6f}" if isinstance(x, float) else "-" if x is None else str(x)

    return sorted(tuple(map(plain, r.values())) for r in table.select(sorted(table.column_names)).to_pylist())


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = plans.QUERIES[name](spark, DATA).toArrow(), duck.sql(plans.SQL[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours) == rows(theirs)


def test_masked_spans_like_plain_python(spark):
    """Every span of every document, found text by text, and none that overlap."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    wanted = sorted((d, a, len(x), kind) for d, t in docs.items() if t for a, x, kind in masking.spans_in(t))
    found = sorted((r["doc_id"], r["start"], r["length"], r["kind"]) for r in plans.QUERIES["masked_spans"](spark, DATA).collect())
    assert found == wanted and len(found) > 10
    for (d, a, n, _), (e, b, _, _) in zip(found, found[1:], strict=False):
        assert d != e or a + n <= b


def test_queries_without_sql():
    """All others are compared with SQL above."""
    assert set(plans.QUERIES) - set(plans.SQL) == {"masked_spans"}


def test_role_names_reach_every_case_of_the_rule(spark):
    """Three words of four, another script with a particle, stop words and a title are met in the table."""
    from pramana import plans

    found = {r["c_custkey"] % 10: r["result"] for r in plans.QUERIES["role_names"](spark, "/root/testdata/sf0.001").where("c_custkey < 50").collect()}
    assert found[5].startswith("Ravi Kumar ") and len(found[5].split(" ")) == 3
    assert (found[6], found[9]) == ("रवि", "Lakshmi Devi") and {found[i] for i in (2, 3, 4, 7, 8)} == {""}
