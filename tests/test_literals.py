"""Rules on literal cases that tell their branches apart."""

import pytest
from literal_cases import CASES


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_literal_cases(spark, case):
    _, fields, rows, make = case
    given = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], f"case_number int, {fields}")
    names = [c for c in given.columns if c != "case_number"]
    found = {r["case_number"]: r["result"] for r in given.select("case_number", make(*(given[n] for n in names)).cast("string").alias("result")).collect()}
    assert found == {i: None if r[-1] is None else str(r[-1]) for i, r in enumerate(rows)}
