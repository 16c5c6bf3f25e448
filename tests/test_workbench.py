import os

import pytest

from caliperlake import registry
from caliperlake.operators import workbench as W
from caliperlake.sources import adapters

DATA = "/root/testdata/sf0.001"


def test_export_counts_compare_multisets(spark):
    rows = [(1, 1), (1, 1), (1, 2), (2, 5), (3, 1), (5, 1)]
    balloons = [(1, 1), (1, 2), (1, 2), (2, 5), (4, 1), (5, 1), (5, 1)]
    given = [spark.createDataFrame(x, "doc_id long, number int") for x in (rows, balloons)]
    assert sorted(map(tuple, W.export_counts(*given).collect())) == [(1, 3, 3, False), (2, 1, 1, True), (3, 1, 0, False), (4, 0, 1, False), (5, 1, 2, False)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_whole_queries_count_every_line(spark):
    lines = adapters.table(spark, DATA, "lineitem")
    counted = registry.QUERIES["agg11_set06_export_counts"](spark, DATA).agg({"n_rows": "sum"}).first()[0]
    assert counted == lines.count()
    opened = {r[0] for r in lines.join(lines.where("l_returnflag = 'R'").select("l_orderkey").distinct(), "l_orderkey").select("l_partkey").collect()}
    got = registry.QUERIES["evt10_cls26_requirement_coverage"](spark, DATA).where("requires_confirmation").collect()
    assert {r.entry_id for r in got} == opened
