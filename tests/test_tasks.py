"""Into how many tasks queries over small files deal their rows."""

import pytest

from pramana import plans
from pramana.sources.tables import SPREAD

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["glance_evidence", "leaks_after_masking", "masked_results", "name_renderings", "redacted_results"])
def test_rows_are_dealt_out(spark, name):
    assert plans.QUERIES[name](spark, DATA).rdd.getNumPartitions() == SPREAD * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["evidence_labels", "page_owners"])
def test_rows_are_dealt_out_before_they_grow(spark, name):
    assert "REPARTITION_BY_NUM" in plans.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
