"""Queries of the title-block operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlake.operators import titleblocks as B
from caliperlake.plans.register import query
from caliperlake.sources import adapters as S


def _line(page: int, slot: int, cond: str, text: str, box: tuple[int, int, int, int], angle: str = "0e0") -> tuple[str, dict[str, str]]:
    place = {c: f"CAST({v} AS DOUBLE)" for c, v in zip(("x0", "y0", "x1", "y1"), box, strict=True)}
    return cond, {"doc_id": "o_orderkey", "page_index": f"CAST({page} AS INT)", "observation_id": f"CAST(o_orderkey AS STRING) || ':{page}.{slot}'", "raw_text": text, **place, "angle": f"CAST({angle} AS DOUBLE)", "page_width": "1000e0", "page_height": "1000e0"}


_SECOND = "o_orderkey % 4 = 0"
_SPECS = [
    _line(0, 1, "true", "CASE WHEN o_orderkey % 23 = 0 THEN '备注' ELSE '物料编码' END", (660, 900, 700, 912), "CASE WHEN o_orderkey % 19 = 0 THEN 90 ELSE 361 END"),
    _line(0, 2, "o_orderkey % 5 <> 0", "'AB-' || CAST(o_custkey AS STRING)", (710, 901, 760, 911)),
    _line(0, 3, "o_orderkey % 7 = 0", "'XX-99'", (765, 900, 800, 912)),
    _line(0, 4, "true", "CASE WHEN o_orderkey % 29 = 0 THEN '备注' ELSE '图样 代号' END", (660, 930, 700, 942)),
    _line(0, 5, "true", "' DWG.' || CAST(o_orderkey AS STRING)", (710, 930, 790, 942)),
    _line(0, 6, "true", "'材料'", (660, 960, 700, 972)),
    _line(0, 7, "true", "'Q235 '", (710, 961, 750, 971)),
    _line(0, 8, "true", "'版本号'", (850, 960, 880, 970)),
    _line(0, 9, "true", "'B1'", (852, 930, 878, 940)),
    _line(0, 10, "o_orderkey % 11 = 0", "'C2'", (855, 941, 875, 951)),
    _line(0, 11, "o_orderkey % 3 <> 0", "CASE WHEN o_orderkey % 13 = 0 THEN '第1页' ELSE '支架' END", (715, 880, 785, 890)),
    _line(0, 12, "o_orderkey % 17 = 0", "'图样代号'", (660, 840, 700, 852)),
    _line(0, 13, "true", "'out of the corner'", (10, 10, 90, 20)),
    _line(1, 1, _SECOND, "'物料编码'", (660, 900, 700, 912)),
    _line(1, 2, f"{_SECOND} AND o_orderkey % 3 = 0", "'AB-7'", (710, 901, 760, 911)),
    _line(1, 3, _SECOND, "'版本号'", (850, 960, 880, 970)),
    _line(1, 4, f"{_SECOND} AND o_orderkey % 5 = 0", "'D4/2'", (852, 930, 878, 940)),
]
_LINES = S.derived_sql("lines", "orders", _SPECS)
_TITLE = f"""{_LINES}, kept AS (SELECT *, regexp_replace(raw_text, '\\s+', '', 'g') AS t FROM lines WHERE abs(((angle + 180) % 360 + 360) % 360 - 180) <= 2 AND x0 >= 0 AND y0 >= 0 AND x1 <= 1000 AND y1 <= 1000 AND (x0 + x1) / 2 >= 650 AND (y0 + y1) / 2 >= 800)"""
_FOUND = f"""WITH {_TITLE}, a AS (SELECT doc_id, page_index FROM kept WHERE t IN ('物料编码', '图样代号', '版本号') GROUP BY ALL HAVING count(DISTINCT t) >= 2), o AS (SELECT kept.* FROM kept SEMI JOIN a USING (doc_id, page_index)),
l AS (SELECT *, CASE t WHEN '物料编码' THEN 'material_code' WHEN '图样代号' THEN 'drawing_number' WHEN '材质' THEN 'material' WHEN '材料' THEN 'material' WHEN '版本号' THEN 'revision' END AS field, count(*) OVER (PARTITION BY doc_id, page_index, field) AS n FROM o WHERE field IS NOT NULL),
v AS (SELECT * FROM o WHERE t NOT IN ('物料编码', '图样代号', '材质', '材料', '版本号')),
c AS (SELECT l.doc_id, l.page_index, field, l.observation_id AS label_id, v.observation_id, v.raw_text, v.x0, v.y0, v.x1 FROM l JOIN v USING (doc_id, page_index) WHERE l.n = 1 AND (
  (field <> 'revision' AND v.x0 - l.x1 BETWEEN 1 AND 170 AND abs((v.y0 + v.y1) / 2 - (l.y0 + l.y1) / 2) <= greatest(2, least(l.y1 - l.y0, v.y1 - v.y0) * 0.4)
    AND CASE WHEN field = 'material' THEN length(v.t) <= 64 AND regexp_matches(v.t, '[\\p{{L}}\\p{{N}}]') ELSE regexp_full_match(v.t, '[A-Za-z0-9][A-Za-z0-9._/-]{{2,63}}') END)
  OR (field = 'revision' AND l.y0 - v.y1 BETWEEN 0 AND 45 AND regexp_full_match(v.t, '[A-Za-z0-9]{{1,4}}([./-][A-Za-z0-9]{{1,4}})?') AND greatest(0, least(l.x1, v.x1) - greatest(l.x0, v.x0)) / least(l.x1 - l.x0, v.x1 - v.x0) >= 0.65))),
c1 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_index, field) AS n FROM c), d AS (SELECT * FROM c1 WHERE n = 1 AND field = 'drawing_number'),
m AS (SELECT d.doc_id, d.page_index, 'material_name' AS field, d.label_id, v.observation_id, v.raw_text, v.x0, v.y0, v.x1 FROM d JOIN v USING (doc_id, page_index) WHERE v.observation_id <> d.observation_id AND d.y0 - v.y1 BETWEEN 10 AND 90 AND abs((v.x0 + v.x1) / 2 - (d.x0 + d.x1) / 2) <= 80
  AND greatest(0, least(d.x1, v.x1) - greatest(d.x0, v.x0)) / least(d.x1 - d.x0, v.x1 - v.x0) >= 0.5 AND regexp_matches(v.t, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]') AND NOT regexp_full_match(v.t, '[0-9第共年月日页张./\\-()（）]+')),
f AS (SELECT * FROM c1 UNION ALL SELECT *, count(*) OVER (PARTITION BY doc_id, page_index) FROM m), amb AS (SELECT doc_id, field FROM l WHERE n > 1 UNION SELECT doc_id, field FROM f WHERE n > 1)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.derived(S.table(spark, sf_dir, "orders"), _SPECS)


@query(f"WITH {_TITLE} SELECT doc_id, observation_id, t AS text FROM kept")
def cls31_title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.title_lines(_lines(spark, sf_dir)).select("doc_id", "observation_id", "text")


@query(f"{_FOUND} SELECT doc_id, page_index, field, trim(raw_text) AS value, observation_id, label_id FROM f WHERE n = 1")
def join05_06_07_title_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.suggestions(B.title_lines(_lines(spark, sf_dir)))[0]


@query(f"{_FOUND} SELECT doc_id, field, any_value(page_index) AS page_index, any_value(trim(raw_text)) AS value, any_value(observation_id) AS observation_id FROM f ANTI JOIN amb USING (doc_id, field) WHERE n = 1 GROUP BY doc_id, field HAVING count(*) = 1")
def agg08_unique_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.unique_suggestions(B.title_lines(_lines(spark, sf_dir)))


@query(f"""WITH {_TITLE} SELECT observation_id, regexp_full_match(t, '[A-Za-z0-9][A-Za-z0-9._/-]{{2,63}}') AS is_code, length(t) <= 64 AND t NOT IN ('物料编码', '图样代号', '材质', '材料', '版本号') AND regexp_matches(t, '[\\p{{L}}\\p{{N}}]') AS is_material,
  regexp_full_match(t, '[A-Za-z0-9]{{1,4}}([./-][A-Za-z0-9]{{1,4}})?') AS is_revision, regexp_matches(t, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]') AND NOT regexp_full_match(t, '[0-9第共年月日页张./\\-()（）]+') AS is_name FROM kept""")
def par10_value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return B.title_lines(_lines(spark, sf_dir)).select("observation_id", B.is_code(t).alias("is_code"), B.is_material(t).alias("is_material"), B.is_revision(t).alias("is_revision"), B.is_name(t).alias("is_name"))
