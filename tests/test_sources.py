import json

from caliperlake.sources import documents as S


def test_inventory_is_flattened(spark, tmp_path):
    box = {"x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0}
    page = {"page_index": 0, "width": 10.0, "height": 20.0, "rotation": 0, "observations": [{"observation_id": "a", "source_type": "native", "observation_level": "line", "raw_text": "M6", "bbox": box, "confidence": 1.0}], "visual_observations": [{"observation_id": "v", "bbox": box, "text_ids": ["a"]}]}
    (tmp_path / "x.json").write_text(json.dumps({"doc_id": 7, "pages": [page, page | {"page_index": 1, "observations": []}]}) + "\n{broken\n")
    inv = S.inventories(spark, str(tmp_path / "x.json")).cache()
    assert inv.where("_corrupt_record is not null").count() == 1
    assert {(r.doc_id, r.page_index, r.width) for r in S.pages_of(inv).collect()} == {(7, 0, 10.0), (7, 1, 10.0)}
    assert [(r.page_index, r.observation_id, r.bbox.x1) for r in S.observations_of(inv).collect()] == [(0, "a", 3.0)]
    assert {(r.page_index, tuple(r.text_ids)) for r in S.visual_observations_of(inv).collect()} == {(0, ("a",)), (1, ("a",))}


def test_responses_keep_bad_rows_with_a_reason(spark):
    square = [{"X": 0, "Y": 0}, {"X": 4, "Y": 0}, {"X": 4, "Y": 2}, {"X": 0, "Y": 2}]
    one = lambda **k: {"DetectedText": "25", "Confidence": 90, "Polygon": square} | k
    bodies = [
        {"RequestId": "r1", "TextDetections": [one(), one(DetectedText=" "), one(Confidence=101), one(Polygon=square[:3])]},
        {"TextDetections": [one()]},
        {"RequestId": "r3", "TextDetections": []},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(3, "nonsense"), (4, None)], "i int, body string")
    rows = S.recognised(df).collect()
    assert sorted((r.i, r.reason or "") for r in rows) == [(0, ""), (0, "blank_text"), (0, "confidence_out_of_range"), (0, "polygon_not_four_points"), (1, "missing_request_id"), (2, "no_detection"), (3, "missing_request_id"), (4, "missing_request_id")]
    (good,) = [r for r in rows if r.reason is None]
    assert (good.x0, good.y0, good.x1, good.y1, good.raw_text) == (0, 0, 4, 2, "25")


def test_call_records(spark):
    lines = ['{"a": 1, "b": 2}', '{"a": 1}', '{"a": 1, "b": 2, "c": 3}', '{"a": 1, "b": 2, "API_Key": "x"}', '{"a": -1, "b": 2}', "x"]
    df = spark.createDataFrame([(t,) for t in lines], "body string")
    assert [r.reason for r in S.call_records(df, ["a", "b"]).collect()] == [None, "missing_field", "unknown_field", "forbidden_field", "negative_counter", "not_json"]


def test_sheets_hold_no_formulas(spark, tmp_path):
    rows = spark.createDataFrame([(1, "=1+1"), (2, "25")], "doc_id long, size string")
    S.write_sheet_rows(rows, str(tmp_path / "csv"), "csv")
    got = {r.size for r in spark.read.option("header", "true").csv(str(tmp_path / "csv")).collect()}
    assert got == {"'=1+1", "25"}
    S.write_sheet_rows(rows, str(tmp_path / "parquet"))
    assert {r.size for r in spark.read.parquet(str(tmp_path / "parquet")).collect()} == {"=1+1", "25"}


def test_one_rule_is_a_projection_and_gives_what_many_give(spark):
    from caliperlake.sources import adapters as S

    df = spark.range(6).selectExpr("CASE WHEN id < 5 THEN id END AS a")
    rule = ("a % 2 = 0", {"k": "a + 1", "t": "'x' || CAST(a AS STRING)"})
    one, many = S.derived(df, [rule]), S.derived(df, [rule, ("false", rule[1])])
    assert sorted(one.collect()) == sorted(many.collect()) and len(one.collect()) == 3
    assert "Generate" not in one._jdf.queryExecution().optimizedPlan().toString()
