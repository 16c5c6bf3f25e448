"""Queries of the layout-profile operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlake.functions import annotations as A
from caliperlake.operators import profiles as P
from caliperlake.plans.register import query
from caliperlake.sources import adapters as S

_MM, _PT = "0.35277777777777775e0", "72e0 / 25.4e0"
_LINES, _CELLS = P.expected_lines(), P.roles()
_LINE_COLUMNS = "profile, grid, axis, position, span_start, span_end"
_CELL_COLUMNS = "profile, region, role, cell, cx0, cy0, cx1, cy1, expected_text, expected_x"
_LINES_SQL = S.fixed_sql("expected", _LINE_COLUMNS + ", line", [(*r, k) for k, r in enumerate(_LINES)])
_CELLS_SQL = S.fixed_sql("cells", _CELL_COLUMNS, _CELLS)


def _expected(spark: SparkSession) -> DataFrame:
    return S.fixed_rows(spark, [(*r, k) for k, r in enumerate(_LINES)], "profile string, grid string, axis string, position double, span_start double, span_end double, line int")


def _by_form(key: str, a: str, b: str, c: str, d: str) -> str:
    return f"CASE {key} % 4 WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} ELSE {d} END"


_PAGE = {"doc_id": "c_custkey", "page_index": "CAST(0 AS INT)"}
_PAGES = [("true", {**_PAGE, "width_pt": f"{_by_form('c_custkey', '420e0', '210e0', '297e0', '250e0')} * {_PT}", "height_pt": f"{_by_form('c_custkey', '297e0', '297e0', '420e0', '250e0')} * {_PT}", "rotation": "CASE WHEN c_custkey % 41 = 0 THEN 90 ELSE 0 END"})]
_NAME = _by_form("c_custkey", "'a3-landscape/1'", "'a4-portrait/1'", "'a3-portrait/1'", "'none'")
_AT = "(position + (c_custkey % 5 - 2) * 0.1e0)"


def _segment(cond: str, at: str) -> tuple[str, dict[str, str]]:
    pick = lambda x, y: f"CASE WHEN axis = 'x' THEN {x} ELSE {y} END * {_PT}"
    return cond, {"doc_id": "c_custkey", "page_index": "CAST(0 AS INT)", "x0": pick(at, "span_start"), "y0": pick("span_start", at), "x1": pick(at, "span_end"), "y1": pick("span_end", at)}


_SEGMENTS = [_segment("(c_custkey * 7 + line) % 211 <> 0", _AT), _segment("(c_custkey + line) % 307 = 0", f"({_AT} + 0.5e0)")]
_TEXTS = [(cond, {**_PAGE, "text": f"'{t}'"}) for t, cond in (("物料编码", "true"), ("图样代号", "c_custkey % 7 <> 0"), ("比例", "true"), ("重量", "c_custkey % 11 <> 0"), ("标记", "c_custkey % 3 <> 0"), ("更改描述", "true"), ("旧底图总号", "c_custkey % 5 <> 0"))]
_MATCHED = f"""WITH {_LINES_SQL}, base AS (SELECT c_custkey, expected.* FROM customer JOIN expected ON profile = {_NAME}), {S.derived_sql('pages', 'customer', _PAGES)}, {S.derived_sql('segs', 'base', _SEGMENTS)}, {S.derived_sql('texts', 'customer', _TEXTS)},
known AS (SELECT *, CASE WHEN rotation <> 0 THEN NULL WHEN abs(width_pt * {_MM} - 420) <= 0.5 AND abs(height_pt * {_MM} - 297) <= 0.5 THEN 'a3-landscape/1' WHEN abs(width_pt * {_MM} - 210) <= 0.5 AND abs(height_pt * {_MM} - 297) <= 0.5 THEN 'a4-portrait/1'
  WHEN abs(width_pt * {_MM} - 297) <= 0.5 AND abs(height_pt * {_MM} - 420) <= 0.5 THEN 'a3-portrait/1' END AS profile FROM pages),
mm AS (SELECT doc_id, x0 * {_MM} AS x0, y0 * {_MM} AS y0, x1 * {_MM} AS x1, y1 * {_MM} AS y1 FROM segs),
ax AS (SELECT doc_id, 'x' AS axis, (x0 + x1) / 2 AS pos, least(y0, y1) AS s, greatest(y0, y1) AS e FROM mm WHERE abs(x1 - x0) <= 0.05 UNION ALL SELECT doc_id, 'y', (y0 + y1) / 2, least(x0, x1), greatest(x0, x1) FROM mm WHERE abs(y1 - y0) <= 0.05),
hits AS (SELECT k.doc_id, k.profile, grid, line, list_sort(list(DISTINCT pos)) AS p FROM ax JOIN known k USING (doc_id) JOIN expected x ON x.profile = k.profile AND x.axis = ax.axis AND abs(pos - position) <= 1 AND least(e, span_end) - greatest(s, span_start) >= 1 GROUP BY ALL),
good AS (SELECT * FROM hits WHERE len(list_filter(p, lambda v, i: i > 1 AND v - p[i - 1] > 0.1)) = 0),
need AS (SELECT profile, grid, count(*) AS need FROM expected GROUP BY ALL), g AS (SELECT doc_id, profile, grid FROM (SELECT doc_id, profile, grid, count(*) AS have FROM good GROUP BY ALL) JOIN need USING (profile, grid) WHERE have = need),
d AS (SELECT doc_id, profile, string_agg(grid, ',' ORDER BY grid) AS geometry FROM g GROUP BY ALL HAVING count(*) >= 3 AND bool_or(grid = 'body_frame')),
t AS (SELECT doc_id, concat_ws(',', CASE WHEN bool_or(text = '旧底图总号') THEN 'archive_anchor' END, CASE WHEN bool_or(text = '标记') AND bool_or(text = '更改描述') THEN 'revision_anchor_quorum' END, CASE WHEN count(DISTINCT text) FILTER (text IN ('物料编码', '图样代号', '比例', '重量')) >= 3 THEN 'title_anchor_quorum' END) AS labels FROM texts GROUP BY ALL)"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = S.dealt(S.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    drawn = c.withColumn("profile", F.expr(_NAME)).join(F.broadcast(_expected(spark)), "profile")
    return S.derived(c, _PAGES), S.derived(drawn, _SEGMENTS), S.derived(c, _TEXTS)


@query(f"{_MATCHED} SELECT doc_id, profile, geometry, labels FROM d JOIN t USING (doc_id) WHERE labels LIKE '%,%'")
def agg09_10_layout_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.matched_profiles(*_tables(spark, sf_dir), _expected(spark))
    return found.select("doc_id", "profile", F.array_join("geometry", ",").alias("geometry"), F.array_join("labels", ",").alias("labels"))


_W, _H = _by_form("o_custkey", "420e0", "210e0", "297e0", "250e0"), _by_form("o_custkey", "297e0", "297e0", "420e0", "250e0")
_CX = f"CASE WHEN o_orderkey % 8 = 0 THEN {_W} * (1 + 2 * (o_orderkey % 3 % 2)) / 4e0 ELSE (o_orderkey * 7) % 101 / 100e0 * {_W} END"
_CY = f"CASE WHEN o_orderkey % 8 = 0 THEN CASE WHEN o_orderkey % 16 = 0 THEN 1.5e0 ELSE {_H} - 2.5e0 END WHEN o_orderkey % 8 = 1 THEN {_H} - 5e0 - (o_orderkey * 13) % 101 ELSE (o_orderkey * 13) % 101 / 100e0 * {_H} END"
_SAID = S.pick_sql(("设计", "标记", "1", "2", "日期", "25±0.1", "abc", "更改描述", "检查尺寸应为5"), "o_orderkey % 9")
_WORDS = {"text": "CASE o_orderkey % 9 WHEN 0 THEN '设计' WHEN 1 THEN '标记' WHEN 2 THEN '1' WHEN 3 THEN '2' WHEN 4 THEN '日期' WHEN 5 THEN '25±0.1' WHEN 6 THEN 'abc' WHEN 7 THEN '更改描述' ELSE '检查尺寸应为5' END"}
_OBS = [("true", {"doc_id": "o_custkey", "page_index": "CAST(0 AS INT)", "observation_id": "o_orderkey", **_WORDS, "x0": f"(({_CX}) - 4) * {_PT}", "y0": f"(({_CY}) - 1.5e0) * {_PT}", "x1": f"(({_CX}) + 4) * {_PT}", "y1": f"(({_CY}) + 1.5e0) * {_PT}", "angle": "CASE WHEN o_orderkey % 15 = 0 THEN 90e0 ELSE 0e0 END", "visual": "o_orderkey % 10 = 0"})]
_ASSIGNED = f"""WITH {_CELLS_SQL}, {S.derived_sql('obs', 'orders', _OBS)}, m AS (SELECT doc_id, observation_id, text, visual, x0 * {_MM} AS x0, y0 * {_MM} AS y0, x1 * {_MM} AS x1, y1 * {_MM} AS y1, {_by_form('doc_id', "'a3-landscape/1'", "'a4-portrait/1'", "'a3-portrait/1'", "'none'")} AS profile, {_by_form('doc_id', '297e0', '297e0', '420e0', '250e0')} AS h FROM obs WHERE angle = 0),
f AS (SELECT doc_id, observation_id, text, visual, region, role, cell, least(x0 - cx0, y0 - cy0, cx1 - x1, cy1 - y1) AS distance, region = 'page_frame' AND ((cy0 = 0 AND abs(y0) <= 1e-9) OR (cy1 = h AND abs(y1 - h) <= 1e-9)) AS outer_edge, count(*) OVER (PARTITION BY observation_id) AS n
  FROM m JOIN cells USING (profile) WHERE (x0 + x1) / 2 BETWEEN cx0 AND cx1 AND (y0 + y1) / 2 BETWEEN cy0 AND cy1 AND least(x0 - cx0, y0 - cy0, cx1 - x1, cy1 - y1) >= 0 AND (expected_text IS NULL OR (text = expected_text AND abs((x0 + x1) / 2 - expected_x) <= 1))),
a AS (SELECT * FROM f WHERE n = 1), own AS (SELECT *, (distance < 1 AND NOT outer_edge) OR (role = 'revision_description' AND (visual OR text IN ('25±0.1', '1', '2', '检查尺寸应为5'))) AS own FROM a),
kept AS (SELECT *, own OR (role = 'revision_description' AND bool_or(role = 'revision_description' AND own) OVER (PARTITION BY doc_id, CASE WHEN role = 'revision_description' THEN cell END)) AS preserved FROM own)"""


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs = S.derived(S.table(spark, sf_dir, "orders"), _OBS)
    pages = obs.select("doc_id", "page_index").distinct().selectExpr("*", f"{_by_form('doc_id', repr('a3-landscape/1'), repr('a4-portrait/1'), repr('a3-portrait/1'), repr('none'))} AS profile", f"{_by_form('doc_id', '297e0', '297e0', '420e0', '250e0')} AS height_mm")
    cells = S.fixed_rows(spark, _CELLS, "profile string, region string, role string, cell string, cx0 double, cy0 double, cx1 double, cy1 double, expected_text string, expected_x double")
    return P.assignments(obs, pages, cells), obs


def _preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, obs = _assigned(spark, sf_dir)
    both = assigned.join(obs.select("doc_id", "observation_id", "visual"), ["doc_id", "observation_id"])
    return P.preserved(both, A.engineering(F.col("text")), F.col("visual"))


@query(f"{_ASSIGNED} SELECT doc_id, observation_id, region, role, cell, CAST(floor(distance * 1000 + 0.5) AS BIGINT) AS distance_um, outer_edge FROM a")
def join03_geo19_cell_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir)[0].select("doc_id", "observation_id", "region", "role", "cell", F.floor(F.col("distance") * 1000 + 0.5).cast("bigint").alias("distance_um"), "outer_edge")


@query(f"{_ASSIGNED} SELECT doc_id, observation_id, preserved FROM kept")
def cls28_preserved_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preserved(spark, sf_dir).select("doc_id", "observation_id", "preserved")


_NUMBERED = "regexp_extract(cell, '[0-9]$')"


@query(f"""{_ASSIGNED}, r AS (SELECT doc_id, observation_id, CASE WHEN role = 'page_frame_number' AND text = {_NUMBERED} AND (distance >= 1 OR outer_edge) THEN 'non_inspection:page_frame_number' WHEN distance < 1 THEN NULL WHEN role = 'revision_marker' AND text = {_NUMBERED} THEN 'reference_context:revision_marker'
  WHEN preserved THEN NULL WHEN region = 'title_block' AND text = '设计' THEN 'non_inspection:title_fixed_label' WHEN role = 'title_metadata_value' THEN 'reference_context:title_metadata_value' WHEN role = 'title_approval_context' THEN 'reference_context:title_approval_context'
  WHEN role = 'revision_header' AND text IN ('标记', '更改描述') THEN 'non_inspection:revision_header' WHEN role = 'revision_description' THEN 'reference_context:revision_description' WHEN cell = 'archive-label-6' AND text = '日期' THEN 'non_inspection:archive_label' WHEN role = 'archive_record' THEN 'reference_context:archive_record' END AS v FROM kept)
  SELECT doc_id, observation_id, split_part(v, ':', 1) AS disposition, split_part(v, ':', 2) AS reason FROM r WHERE v IS NOT NULL""")
def cls04_layout_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = _preserved(spark, sf_dir).withColumn("d", P.layout_disposition(F.col("text"), F.col("preserved")))
    return decided.where("d is not null").select("doc_id", "observation_id", "d.disposition", "d.reason")


_SX, _SY = _by_form("c_custkey", "100e0", "65e0", "100e0", "50e0"), _by_form("c_custkey", "80e0", "80e0", "90e0", "50e0")
_MARKS = [
    (f"NOT (c_custkey % 6 = 0 AND {k} > 7)", {**_PAGE, "observation_id": f"CAST(c_custkey AS STRING) || ':{k}'", "text": "'样张'", "cx": f"20e0 + {k % 3} * {_SX} + ((c_custkey + {k}) % 3) * 0.5e0", "cy": f"30e0 + {k // 3} * {_SY} - ((c_custkey + {k}) % 4) * 0.25e0", "angle": "CASE WHEN c_custkey % 19 = 0 THEN 0e0 ELSE 329e0 END"})
    for k in range(12)
] + [("c_custkey % 5 = 0", {**_PAGE, "observation_id": "CAST(c_custkey AS STRING) || ':x'", "text": "'样张'", "cx": "20.2e0", "cy": "30.1e0", "angle": "330e0"})]
_SPACING = [("true", {**_PAGE, "sx": _SX, "sy": _SY})]


@query(f"""WITH {S.derived_sql('marks', 'customer', _MARKS)}, {S.derived_sql('sp', 'customer', _SPACING)}, t AS (SELECT * FROM marks JOIN sp USING (doc_id, page_index) WHERE abs((((angle + 30 + 180) % 360) + 360) % 360 - 180) <= 2 QUALIFY count(*) OVER (PARTITION BY doc_id, text) >= 9),
p AS (SELECT a.doc_id, a.observation_id, round_even((b.cx - a.cx) / a.sx, 0) AS c, round_even((b.cy - a.cy) / a.sy, 0) AS r FROM t a JOIN t b USING (doc_id, text) WHERE abs(b.cx - a.cx - round_even((b.cx - a.cx) / a.sx, 0) * a.sx) <= 2 AND abs(b.cy - a.cy - round_even((b.cy - a.cy) / a.sy, 0) * a.sy) <= 2),
g AS (SELECT doc_id FROM p GROUP BY doc_id, observation_id HAVING count(*) = count(DISTINCT (c, r)) AND count(*) >= 9 AND count(DISTINCT c) >= 2 AND count(DISTINCT r) >= 3) SELECT doc_id, observation_id FROM t WHERE doc_id IN (SELECT doc_id FROM g)""")
def agg29_join27_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.dealt(S.table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return P.watermarks(S.derived(c, _MARKS), S.derived(c, _SPACING)).select("doc_id", "observation_id")


@query(f"""WITH {S.TITLE_SQL} SELECT observation_id, raw_text IN ('12', '25±0.1') AS engineering FROM texts""")
def cls29_engineering_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.title_texts(spark, sf_dir).select("observation_id", A.engineering(F.trim("raw_text")).alias("engineering"))
