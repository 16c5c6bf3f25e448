import os

import pytest

from caliperlake.operators import titleblocks as B
from caliperlake.plans import titleblocks as plans

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, page_index int, observation_id string, raw_text string, text string, x0 double, y0 double, x1 double, y1 double, page_width double"


def line(page, ident, text, x0, y0, x1, y1):
    return 1, page, ident, text, text, float(x0), float(y0), float(x1), float(y1), 1000.0


PAGE_0 = [line(0, "c", "物料编码", 660, 900, 700, 912), line(0, "d", "图样代号", 660, 930, 700, 942), line(0, "dv", "DWG.1", 710, 930, 790, 942), line(0, "cv", "AB-7", 710, 901, 760, 911), line(0, "n", "支架", 715, 880, 785, 890)]


def test_fields_names_and_what_is_ambiguous(spark):
    found, many = B.suggestions(spark.createDataFrame(PAGE_0, COLUMNS))
    assert {(r.field, r.value, r.label_id) for r in found.collect()} == {("material_code", "AB-7", "c"), ("drawing_number", "DWG.1", "d"), ("material_name", "支架", "d")}
    assert many.count() == 0
    twice = [*PAGE_0, line(0, "d2", "图样代号", 660, 840, 700, 852), line(0, "cv2", "XX-9", 765, 900, 800, 912)]
    found, many = B.suggestions(spark.createDataFrame(twice, COLUMNS))
    assert found.count() == 0 and {r.field for r in many.collect()} == {"material_code", "drawing_number"}


def test_a_field_is_unique_over_all_pages(spark):
    second = [line(1, "c1", "物料编码", 660, 900, 700, 912), line(1, "r1", "版本号", 850, 960, 880, 970), line(1, "cv1", "AB-7", 710, 901, 760, 911), line(1, "cv3", "XX-9", 765, 900, 800, 912)]
    got = {(r.field, r.value) for r in B.unique_suggestions(spark.createDataFrame(PAGE_0 + second, COLUMNS)).collect()}
    assert got == {("drawing_number", "DWG.1"), ("material_name", "支架")}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_lines_are_made_once_and_nothing_is_joined(spark):
    for query in (plans.agg08_unique_suggestions, plans.join05_06_07_title_suggestions):
        plan = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("FileScan") == 1
