from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from caliperlake.functions import annotations as A
from caliperlake.functions import geometry as G
from caliperlake.functions import text as T
from caliperlake.operators import documents, ledger, ordered, reports, spatial


def parse(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_text string")
    return A.parsed(df.withColumn("normalized_text", T.normalised(F.col("raw_text")))).orderBy("i").collect()


@pytest.mark.parametrize(
    "text,upper,lower",
    [("25±0.02", "0.02", "-0.02"), ("25+0.03/-0.01", "0.03", "-0.01"), ("25+0.03/0", "0.03", "0"), ("25+0.03/+0.01", "0.03", "0.01"), ("25-0.01/-0.03", "-0.01", "-0.03"), ("45°±0.5°", "0.5", "-0.5")],
)
def test_tolerances(spark, text, upper, lower):
    (r,) = parse(spark, text)
    assert (r.upper_tolerance, r.lower_tolerance) == (Decimal(upper), Decimal(lower))


def test_annotation_types(spark):
    rows = parse(spark, "25", "12.50", "Φ20", "⌀20", "∅20", "ø20", "M6深10", "M6×1通", "M8贯穿", "R5", "R2.5", "45°", "", "技术要求", "25 mm", "16 × M5", "4 x M6通", "4-25", "4-M6", None)
    assert [r.item_type for r in rows] == ["linear_dimension"] * 2 + ["diameter_dimension"] * 4 + ["thread"] * 3 + ["radius"] * 2 + ["angle"] + [None] * 3 + ["thread"] * 2 + [None, "thread", None]
    assert [r.nominal_raw for r in rows[:3]] == ["25", "12.50", "20"]
    assert [(r.thread_spec, r.depth_raw, r.through) for r in rows[6:9]] == [("M6", "10", False), ("M6×1", None, True), ("M8", None, True)]
    assert [r.quantity for r in rows[15:19]] == [16, 4, None, 4]


def test_normalising(spark):
    df = spark.createDataFrame([("ＡＢ  １２",), (" a　b ",), ("⌀5",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normalised(F.col("t"))).collect()] == ["AB 12", "a b", "Φ5", None]


def test_decimal_texts(spark):
    df = spark.createDataFrame([(Decimal("12.500000"), "12.5"), (Decimal("-0.000000"), "0"), (Decimal("100.000000"), "100"), (Decimal("0.010000"), "0.01")], "d decimal(20,6), want string")
    assert df.where(T.decimal_text(F.col("d")) != F.col("want")).isEmpty()


def test_tolerance_values(spark):
    rows = [(Decimal(10), Decimal("0.1"), Decimal("-0.1"), "±0.1", None), (Decimal(10), Decimal("0.3"), Decimal("0.1"), "+0.3/+0.1", None), (Decimal(10), Decimal(1), None, "", "one_sided_tolerance"), (Decimal(10), Decimal(0), Decimal(1), "", "inverted_tolerance"), (Decimal(1), None, None, "", None)]
    df = spark.createDataFrame(rows, "b decimal(20,6), u decimal(20,6), l decimal(20,6), text string, error string")
    got = df.select("text", "error", T.tolerance_values(F.col("b"), F.col("u"), F.col("l")).alias("v")).collect()
    assert all((r.v.text, r.v.error) == (r.text, r.error) for r in got)


def test_names(spark):
    df = spark.createDataFrame([("../../工件:<A1>?*.xlsx",), ("...",), ("测" * 200,)], "n string")
    a, b, c = (r[0] for r in df.select(T.safe_stem(F.col("n"))).collect())
    assert a.startswith("工件") and not set(a) & set('<>:"/\\|?*') and b == "inspection" and len(c) == 120
    sheets = spark.createDataFrame([(1, 1, "inspection"), (1, 2, "Inspection"), (1, 3, "other")], "doc int, i int, n string")
    assert [r.unique_name for r in documents.unique_names(sheets, "doc", F.col("n"), "i").orderBy("i").collect()] == ["inspection", "Inspection_2", "other"]


def test_stable_ids_frame_their_parts(spark):
    import hashlib

    def plain(*parts):
        h = hashlib.sha256()
        for p in parts:
            h.update(len(p.encode()).to_bytes(8, "big") + p.encode())
        return h.hexdigest()[:24]

    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("Φ", "")], "x string, y string")
    assert [r[0] for r in df.select(T.stable_id(F.col("x"), F.col("y"))).collect()] == [plain("a", "bc"), plain("ab", "c"), plain("Φ", "")]


def test_wrapped_text_and_numbers(spark):
    df = spark.createDataFrame([(["ab", "cd"],), (["零件", "表面"],), (["a", "表"],)], "p array<string>")
    assert [r[0] for r in df.select(T.joined_wrapped(F.col("p"))).collect()] == ["ab cd", "零件表面", "a表"]
    one = spark.createDataFrame([("3 x 4.5, 4.5 and 1.2.3",)], "t string")
    assert one.select(T.standalone_decimals(F.col("t"))).first()[0] == ["3", "4.5"]


def test_page_classes(spark):
    df = spark.createDataFrame([(900, 0.0, 400), (900, 0.95, 400), (0, 1.0, 0), (10, 0.45, 0)], "c int, v double, d int")
    assert [r[0].page_type for r in df.select(A.page_class(F.col("c"), F.col("v"), F.col("d"))).collect()] == ["vector", "hybrid", "scanned", "ambiguous"]


def test_usage_costs(spark):
    rows = [(32768, 1, "0.032778"), (32769, 1, "0.049169"), (131072, 1, "0.196623"), (131073, 1, "0.393249"), (1, 0, "0.000001"), (1, 32768, "0.327681"), (260096, 32768, "1.763328"), (260097, 0, None), (-1, 0, None), (None, 1, None)]
    df = spark.createDataFrame(rows, "p long, c long, want string")
    assert all(r.cost == (Decimal(r.want) if r.want else None) for r in df.select("want", ledger.usage_cost(F.col("p"), F.col("c")).alias("cost")).collect())


def test_touching_boxes_do_not_intersect(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 10.0, 0.0, 20.0, 10.0, False), (0.0, 0.0, 10.0, 10.0, 9.0, 9.0, 20.0, 20.0, True)], "x0 double, y0 double, x1 double, y1 double, rx0 double, ry0 double, rx1 double, ry1 double, want boolean")
    assert df.where(G.intersect(G.Box.of(), G.Box.of("r")) != F.col("want")).isEmpty()


def test_segments(spark):
    one = spark.range(1)
    pt = lambda x, y: G.Point(F.lit(float(x)), F.lit(float(y)))
    box = G.Box(*(F.lit(float(v)) for v in (2, 2, 4, 4)))
    got = one.select(
        G.segments_cross(pt(0, 0), pt(4, 4), pt(0, 4), pt(4, 0)), G.segments_cross(pt(0, 0), pt(4, 4), pt(4, 4), pt(8, 0)), G.segment_meets_box(pt(0, 3), pt(6, 3), box), G.segment_meets_box(pt(0, 0), pt(0, 9), box), G.angles_equal(F.lit(359.0), F.lit(1.0), 2.0)
    ).first()
    assert list(got) == [True, False, True, False, True]


def lines(spark, *rows):
    return spark.createDataFrame([(1, 0, f"o{i}", t, 0.0, float(y), 30.0, float(y + 8)) for i, (t, y) in enumerate(rows)], "doc_id long, page_index int, observation_id string, raw_text string, x0 double, y0 double, x1 double, y1 double")


def test_composites(spark):
    got = {r.head_id: (r.kind, r.members, r.modifiers) for r in ordered.composites(lines(spark, ("Φ10", 10), ("深20", 20), ("通", 30), ("深5", 90), ("R5", 100), ("↓3", 110))).collect()}
    assert got == {"o0": ("composite", 3, "深20 通"), "o3": ("orphan", 1, "深5"), "o4": ("radius", 1, ""), "o5": ("orphan", 1, "↓3")}


def test_numbers_follow_reading_order(spark):
    rows = [(1, 1, "i2", "a", 20.0, 10.0, 30.0, 20.0), (1, 0, "i1", "a", 10.0, 10.0, 20.0, 20.0)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "doc_id long, page_index int, observation_id string, raw_text string, x0 double, y0 double, x1 double, y1 double")
        assert {r.observation_id: r.number for r in ordered.numbered(df).collect()} == {"i1": 1, "i2": 2}


def test_groups_are_transitive(spark):
    boxes = spark.createDataFrame([(1, 0, n, x, 0.0, x + 10, 10.0) for n, x in (("a", 10.0), ("b", 11.0), ("c", 12.1), ("d", 60.0))], "doc_id long, page_index int, observation_id string, x0 double, y0 double, x1 double, y1 double")
    a, b = G.Box.of(), G.Box.of("r_")
    pairs = spatial.page_pairs(boxes, boxes, (F.col("observation_id") < F.col("r_observation_id")) & (G.overlap_fraction(a, b) >= 0.8))
    groups = spatial.page_groups(pairs.select("doc_id", "page_index", F.col("observation_id").alias("left_id"), F.col("r_observation_id").alias("right_id")))
    assert {(r.node, r.group_id) for r in groups.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_duplicates_across_views(spark):
    df = spark.createDataFrame([(1, "a", "M6", 1), (1, "b", "M6", 2), (1, "c", "M6", 3), (1, "d", "M8", 2), (1, "e", "M6", 1), (2, "f", "M6", 2)], "doc_id long, id string, t string, view int")
    got = {(r.left_id, r.right_id) for r in reports.cross_view_duplicates(df, "t", "view", "id").collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "e"), ("c", "e")}


def test_admission(spark):
    calls = spark.createDataFrame([(1, p, 10 * p + i) for p in range(3) for i in range(5)], "doc_id long, page_index int, call_id int")
    rows = ordered.admitted(calls, spark.createDataFrame([(1, 16)], "doc_id long, capacity int")).where("admitted").groupBy("page_index").count().collect()
    assert {r.page_index: r["count"] for r in rows} == {0: 4, 1: 4}


def test_requirement_classes(spark):
    rows = [
        ("未标注倒角C0.5", "default_chamfer", "C0.5"),
        ("锐边去除毛刺", "deburr", None),
        ("零件表面不应有划痕、擦伤等损伤零件外观的缺陷", "surface_integrity", None),
        ("表面阳极氧化黑色处理", "surface_treatment", None),
        ("未注公差按GB/T 1804-m级执行", "general_dimensional_tolerance", "GB/T 1804-m"),
        ("未标注尺寸公差按 GB / T 1804 - M 执行", "general_dimensional_tolerance", "GB/T 1804-m"),
        ("未注形位公差按GB/T1184-K执行", "general_geometric_tolerance", "GB/T 1184-k"),
        ("未注尺寸公差按企业标准执行", "unsupported", None),
        ("检查倒角尺寸应为1 x 45°", "default_chamfer", "1×45°"),
        ("检查平面度不大于0.1", "ambiguous", None),
        ("说明", "ambiguous", None),
    ]
    df = spark.createDataFrame(rows, "t string, subtype string, parameter string")
    got = df.select("*", A.requirement_class(F.col("t"), F.lit(None).cast("int")).alias("c")).collect()
    assert [(r.c.subtype, r.c.parameter) for r in got] == [(r.subtype, r.parameter) for r in got]
    assert {r.t: r.c.category for r in got}["检查平面度不大于0.1"] == "standalone_check"
