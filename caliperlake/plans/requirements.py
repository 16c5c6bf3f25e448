"""Queries of the requirement operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlake.functions import annotations as A
from caliperlake.operators import requirements as R
from caliperlake.plans.register import query
from caliperlake.sources import adapters as S


def _row(slot: int, cond: str, text: str, page: int, x0: str, y0: str, tall: int = 12, dx: str = "1e0", dy: str = "0e0") -> tuple[str, dict[str, str]]:
    return cond, {
        "doc_id": "o_orderkey", "page_index": f"CAST({page} AS INT)", "observation_id": f"CAST(o_orderkey AS STRING) || ':{slot}'", "raw_text": text, "x0": f"CAST({x0} AS DOUBLE)", "y0": f"CAST({y0} AS DOUBLE)", "x1": f"CAST({x0} AS DOUBLE) + 60", "y1": f"CAST({y0} AS DOUBLE) + {tall}",
        "dx": f"CAST({dx} AS DOUBLE)", "dy": f"CAST({dy} AS DOUBLE)", "place": f"CAST({slot} AS INT)",
    }


_LINES = [
    _row(0, "true", "CASE WHEN o_orderkey % 13 = 0 THEN 'other text' ELSE '技术要求：' END", 0, "100", "100"),
    _row(1, "true", "'1. 未注公差按GB/T 1804-m执行'", 0, "100", "116"),
    _row(2, "true", "'2、锐边去除' || chr(10) || '毛刺'", 0, "100", "132", 24),
    _row(3, "true", "'表面abc'", 0, "100", "CASE WHEN o_orderkey % 7 = 0 THEN 198 ELSE 158 END", 12, "CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END", "CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END"),
    _row(4, "true", "'def 123'", 0, "100", "172"),
    _row(5, "true", "'3) 检查倒角尺寸应为1 x 45°'", 0, "CASE WHEN o_orderkey % 5 = 0 THEN 300 ELSE 104 END", "188"),
    _row(6, "o_orderkey % 3 = 0", "'技术要求'", 1, "100", "100"),
    _row(7, "o_orderkey % 3 = 0", "CASE WHEN o_orderkey % 2 = 0 THEN '1.表面不应有划痕' ELSE '没有编号' END", 1, "110", "118"),
    _row(8, "true", "'检查平面度不大于0.1'", 1, "400", "500"),
]
_SEGS = f"""{S.derived_sql('obs', 'orders', _LINES)}, cut AS (SELECT *, string_split(raw_text, chr(10)) AS parts FROM obs), e AS (SELECT * EXCLUDE (parts, y0, y1), unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS segment, (y1 - y0) / len(parts) AS h, y0 AS top FROM cut),
segs AS (SELECT doc_id, page_index, observation_id, place, segment, trim(part) AS text, replace(trim(part), '：', ':') AS norm, x0, x1, top + h * segment AS y0, top + h * segment + h AS y1, dx, dy FROM e WHERE trim(part) <> '')"""
_HEAD, _NUM = "regexp_full_match(s.norm, '技术要求\\s*:?')", "regexp_full_match(s.norm, '[1-9][0-9]*\\s*[.、)]\\s*.+')"
_COLUMN = "s.page_index = r.hp AND abs(s.dx - r.hdx) <= 0.05 AND abs(s.dy - r.hdy) <= 0.05 AND abs(s.x0 - r.hx) <= greatest(8.0, 0.75 * greatest(r.hw, 1.0), 2.0 * greatest(r.hh, 1.0))"
_NEXT = "s.page_index = r.lp AND abs(s.dx - r.ldx) <= 0.05 AND abs(s.dy - r.ldy) <= 0.05 AND s.y0 - r.ly BETWEEN -0.35 * r.lt AND greatest(4.0, 0.75 * r.lt)"
_ENTRIES = f"""WITH RECURSIVE {_SEGS}, ns AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, segment) AS n FROM segs),
z AS (SELECT doc_id, 0::BIGINT AS n, 'none' AS act, 0 AS eid, false AS cur, CAST(NULL AS VARCHAR) AS hid, CAST(NULL AS INT) AS hp, 0.0::DOUBLE AS hdx, 0.0::DOUBLE AS hdy, 0.0::DOUBLE AS hx, 0.0::DOUBLE AS hw, 0.0::DOUBLE AS hh, 0 AS lp, 0.0::DOUBLE AS ldx, 0.0::DOUBLE AS ldy, 0.0::DOUBLE AS ly, 0.0::DOUBLE AS lt FROM (SELECT DISTINCT doc_id FROM segs)),
r AS (SELECT * FROM z UNION ALL SELECT doc_id, n, act, CASE WHEN act = 'num' THEN eid + 1 ELSE eid END, CASE WHEN act IN ('head', 'end') THEN false WHEN act = 'num' THEN true ELSE cur END,
  CASE act WHEN 'head' THEN observation_id WHEN 'end' THEN NULL ELSE hid END, CASE act WHEN 'head' THEN page_index ELSE hp END, CASE act WHEN 'head' THEN dx ELSE hdx END, CASE act WHEN 'head' THEN dy ELSE hdy END, CASE act WHEN 'head' THEN x0 ELSE hx END, CASE act WHEN 'head' THEN x1 - x0 ELSE hw END, CASE act WHEN 'head' THEN y1 - y0 ELSE hh END,
  CASE WHEN act IN ('num', 'cont') THEN page_index ELSE lp END, CASE WHEN act IN ('num', 'cont') THEN dx ELSE ldx END, CASE WHEN act IN ('num', 'cont') THEN dy ELSE ldy END, CASE WHEN act IN ('num', 'cont') THEN y1 ELSE ly END, CASE WHEN act IN ('num', 'cont') THEN greatest(y1 - y0, 1.0) ELSE lt END
  FROM (SELECT s.doc_id, s.n, s.observation_id, s.page_index, s.dx, s.dy, s.x0, s.x1, s.y0, s.y1, r.* EXCLUDE (doc_id, n, act), CASE WHEN {_HEAD} THEN 'head' WHEN r.hid IS NULL THEN 'none' WHEN NOT ({_COLUMN}) THEN 'none' WHEN {_NUM} THEN 'num' WHEN NOT r.cur OR NOT ({_NEXT}) THEN 'end' ELSE 'cont' END AS act FROM r JOIN ns s ON s.doc_id = r.doc_id AND s.n = r.n + 1)),
p AS (SELECT r.doc_id, r.eid, r.n, r.act, r.hid, s.observation_id, s.page_index, s.place, CASE WHEN r.act = 'num' THEN trim(regexp_extract(s.norm, '^[1-9][0-9]*\\s*[.、)]\\s*(.+)$', 1)) ELSE s.text END AS t, regexp_extract(s.norm, '^[1-9][0-9]*') AS o FROM r JOIN ns s USING (doc_id, n) WHERE r.act IN ('num', 'cont')),
g AS (SELECT *, CASE WHEN regexp_matches(lag(t) OVER (PARTITION BY doc_id, eid ORDER BY n), '[A-Za-z0-9]$') AND regexp_matches(t, '^[A-Za-z0-9]') THEN ' ' ELSE '' END || t AS glued FROM p),
listed AS (SELECT doc_id, eid, CAST(first(o ORDER BY n) AS INT) AS ordinal, string_agg(glued, '' ORDER BY n) AS raw_text, list_distinct(list(observation_id)) AS ids, count(*) AS n_segments, first(page_index ORDER BY n) AS page_index, first(hid ORDER BY n) AS heading_id, min(place) AS place FROM g GROUP BY ALL),
used AS (SELECT doc_id, unnest(list_append(ids, heading_id)) AS observation_id FROM listed), alone AS (SELECT * FROM obs WHERE regexp_matches(raw_text, '检查|检验|检测|测量|确认|验证') AND regexp_matches(raw_text, '不得|不允许|应为|应达到|应符合|符合|不大于|不小于|≤|≥|无(毛刺|裂纹|缺陷|损伤)') AND (doc_id, observation_id) NOT IN (SELECT (doc_id, observation_id) FROM used)),
every AS (SELECT doc_id, eid, ordinal, raw_text, list_sort(ids) AS ids, CAST(n_segments AS INT) AS n_segments, page_index, heading_id, place FROM listed UNION ALL SELECT doc_id, -1, NULL, raw_text, [observation_id], 1, page_index, NULL, place FROM alone)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.derived(S.table(spark, sf_dir, "orders"), _LINES)


@query(f"WITH {_SEGS} SELECT doc_id, observation_id, CAST(segment AS INT) AS segment, text, y0, y1 FROM segs")
def txt05_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.segments(_lines(spark, sf_dir)).select("doc_id", "observation_id", "segment", "text", "y0", "y1")


@query(f"{_ENTRIES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place, eid) AS INT) AS entry, ordinal, raw_text, array_to_string(ids, ',') AS sources, n_segments, page_index, heading_id FROM every")
def win03_requirement_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.entries(_lines(spark, sf_dir))
    return out.select("doc_id", "entry", "ordinal", "raw_text", F.array_join(F.array_sort("source_ids"), ",").alias("sources"), "n_segments", "page_index", "heading_id")


# Sample requirements, and what each is.
_SAID = (
    ("未标注倒角C0.5", "applicability_rule", "default_chamfer", "C0.5", "未标注倒角", None, "C0.5"),
    ("锐边去除毛刺", "standalone_check", "deburr", None, "去毛刺与锐边检查", "锐边去除毛刺", None),
    ("零件表面不应有划痕", "standalone_check", "surface_integrity", None, "外观检查", "零件表面不应有划痕", None),
    ("表面阳极氧化黑色处理", "standalone_check", "surface_treatment", None, "表面处理检查", "表面阳极氧化黑色处理", None),
    ("未注公差按GB/T 1804-m级执行", "applicability_rule", "general_dimensional_tolerance", "GB/T 1804-m", "未注尺寸公差", "GB/T 1804-m", None),
    ("未注尺寸公差按GB/T1804-F执行", "applicability_rule", "general_dimensional_tolerance", "GB/T 1804-f", "未注尺寸公差", "GB/T 1804-f", None),
    ("未注形位公差按GB/T1184-K执行", "applicability_rule", "general_geometric_tolerance", "GB/T 1184-k", "未注形位公差", "GB/T 1184-k", None),
    ("未注尺寸公差按企业标准执行", "unsupported", "unsupported", None, None, None, None),
    ("检查倒角尺寸应为1 x 45°", "standalone_check", "default_chamfer", "1×45°", "倒角检查", None, "1×45°"),
    ("检查平面度不大于0.1", "standalone_check", "ambiguous", None, "技术要求检查", "检查平面度不大于0.1", None),
    ("说明", "ambiguous", "ambiguous", None, None, None, None),
)
_TEXT = "CASE o_orderkey * 5 % 11 " + " ".join(f"WHEN {k} THEN '{r[0]}'" for k, r in enumerate(_SAID)) + " END"
_REQ = [("o_orderkey % 3 <> 0", {"doc_id": "o_custkey", "requirement_id": "'r' || CAST(o_orderkey AS STRING)", "text": _TEXT, "ordinal": "CASE WHEN o_orderkey % 4 = 0 THEN CAST(1 AS INT) END", "place": "o_orderkey"})]
# What is said by hand, not by the library's patterns.  A numbered check that no rule knows stays ambiguous.
_CLASSES = f"""{S.fixed_sql('said', 'text, category, subtype, parameter, inspection_item, inspection_standard, key_dimension', list(_SAID))}, {S.derived_sql('reqs', 'orders', _REQ)},
req AS (SELECT doc_id, requirement_id, place, ordinal, text, CASE WHEN text = '检查平面度不大于0.1' AND ordinal IS NOT NULL THEN 'ambiguous' ELSE category END AS category, subtype, parameter, CASE WHEN text = '检查平面度不大于0.1' AND ordinal IS NOT NULL THEN NULL ELSE inspection_item END AS inspection_item,
  CASE WHEN text = '检查平面度不大于0.1' AND ordinal IS NOT NULL THEN NULL ELSE inspection_standard END AS inspection_standard, key_dimension FROM reqs JOIN said USING (text))"""


def _requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.derived(S.table(spark, sf_dir, "orders"), _REQ)
    return df.withColumn("c", A.requirement_class(F.col("text"), F.col("ordinal"))).withColumn("s", A.requirement_suggestion(F.col("c"), F.col("text"))).select("*", "c.*", "s.*").drop("c", "s")


@query(f"WITH {_CLASSES} SELECT requirement_id, category, subtype, parameter, inspection_item, inspection_standard, key_dimension FROM req")
def par08_requirement_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requirements(spark, sf_dir).select("requirement_id", "category", "subtype", "parameter", "inspection_item", "inspection_standard", "key_dimension")


_TYPES = ("linear_dimension", "diameter_dimension", "radius", "angle", "thread", "composite")
_CAND = [
    ("o_orderkey % 3 = 0", {"doc_id": "o_custkey", "candidate_id": "'c' || CAST(o_orderkey AS STRING)", "item_type": "CASE o_orderkey % 6 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TYPES)) + " END", "upper_tolerance": "CASE WHEN o_orderkey % 2 = 0 THEN 0.1e0 END", "lower_tolerance": "CASE WHEN o_orderkey % 5 = 0 THEN -0.1e0 END", "old": "CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'r' || CAST(o_orderkey + 1 AS STRING) END"})
]
_ID = lambda x: f"substr(sha256(unhex('000000000000001f') || encode('technical-requirement-candidate') || unhex(lpad(printf('%x', strlen({x})), 16, '0')) || encode({x})), 1, 24)"
_MATCH = f"""{_CLASSES}, {S.derived_sql('cand', 'orders', _CAND)}, k AS (SELECT *, category IN ('unsupported', 'ambiguous') OR (subtype LIKE 'general_%' AND count(DISTINCT parameter) OVER (PARTITION BY doc_id, subtype) > 1) AS open FROM req),
b AS (SELECT doc_id, list_sort(list(candidate_id)) AS ids FROM cand WHERE item_type IN ('linear_dimension', 'diameter_dimension', 'radius', 'angle') AND upper_tolerance IS NULL AND lower_tolerance IS NULL GROUP BY ALL),
m AS (SELECT k.*, CASE WHEN NOT open AND subtype = 'general_dimensional_tolerance' THEN coalesce(ids, []) ELSE [] END AS matched FROM k LEFT JOIN b USING (doc_id)),
o AS (SELECT *, CASE WHEN open THEN 'unresolved' WHEN len(matched) > 0 THEN 'matched_items' ELSE 'global_scope' END AS outcome, CASE WHEN NOT open AND len(matched) = 0 THEN {_ID('requirement_id')} END AS generated FROM m)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.derived(S.table(spark, sf_dir, "orders"), _CAND)


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.matched(_requirements(spark, sf_dir), _candidates(spark, sf_dir))


@query(f"WITH {_MATCH} SELECT doc_id, requirement_id, outcome, array_to_string(matched, ',') AS matched, generated FROM o")
def join21_agg07_requirement_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("doc_id", "requirement_id", "outcome", F.array_join("matched", ",").alias("matched"), "generated")


# Stored decisions, some of them spoiled.
_SPOIL = {"twice": "place % 31 = 0", "order": "place % 29 = 0", "lost": "place % 23 = 0", "empty": "place % 19 = 0"}


@query(f"""WITH {_MATCH}, known AS (SELECT doc_id, candidate_id FROM cand UNION SELECT doc_id, generated FROM o WHERE generated IS NOT NULL AND place % 17 <> 0),
d AS (SELECT doc_id, requirement_id, place, outcome, generated, CASE WHEN place % 19 = 0 THEN [] WHEN place % 23 = 0 THEN list_append(matched, 'zz') WHEN place % 29 = 0 THEN list_reverse(matched) ELSE matched END AS matched FROM o), t AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE place % 31 = 0),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, requirement_id) AS times FROM t) SELECT doc_id, requirement_id, CASE WHEN times > 1 THEN 'duplicate_requirement_id' WHEN matched <> list_sort(list_distinct(matched)) THEN 'targets_not_canonical' WHEN list_contains(matched, 'zz') THEN 'missing_candidate'
  WHEN outcome = 'matched_items' AND (len(matched) = 0 OR generated IS NOT NULL) THEN 'matched_items_rule' WHEN outcome = 'global_scope' AND (len(matched) > 0 OR generated IS NULL OR place % 17 = 0) THEN 'global_scope_rule' WHEN outcome = 'unresolved' AND (len(matched) > 0 OR generated IS NOT NULL) THEN 'unresolved_rule' END AS code FROM n""")
def chk02_requirement_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matched(spark, sf_dir)
    spoiled = F.when(F.expr(_SPOIL["empty"]), F.array().cast("array<string>")).when(F.expr(_SPOIL["lost"]), F.concat("matched", F.array(F.lit("zz")))).when(F.expr(_SPOIL["order"]), F.reverse("matched")).otherwise(F.col("matched"))
    stored = found.withColumn("matched", spoiled)
    stored = stored.unionByName(stored.where(_SPOIL["twice"]))
    known = _candidates(spark, sf_dir).select("doc_id", "candidate_id").unionByName(found.where("generated is not null and place % 17 <> 0").select("doc_id", F.col("generated").alias("candidate_id")))
    return R.problems(stored, known)


@query(f"""WITH {_MATCH}, hit AS (SELECT doc_id, unnest(matched) AS candidate_id, requirement_id FROM o WHERE outcome = 'matched_items'), h AS (SELECT doc_id, candidate_id, list(requirement_id) AS ids FROM hit GROUP BY ALL),
kept AS (SELECT c.doc_id, c.candidate_id, list_sort(list_distinct(list_concat(CASE WHEN EXISTS (SELECT 1 FROM req q WHERE q.doc_id = c.doc_id AND q.requirement_id = c.old) THEN [] ELSE [c.old] END, coalesce(ids, [])))) AS refs FROM cand c LEFT JOIN h ON h.doc_id = c.doc_id AND h.candidate_id = c.candidate_id)
  SELECT doc_id, candidate_id, array_to_string(refs, ',') AS refs FROM kept UNION ALL SELECT doc_id, generated, requirement_id FROM o WHERE outcome = 'global_scope'""")
def chk03_reconciled_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that hold old references, and the generated ones of an earlier run, matched anew."""
    req = _requirements(spark, sf_dir)
    before = _candidates(spark, sf_dir).withColumn("refs", F.array("old")).drop("old")
    earlier = req.select("doc_id", R.generated_id(F.col("requirement_id")).alias("candidate_id"), F.lit("general_requirement").alias("item_type"), F.lit(None).cast("double").alias("upper_tolerance"), F.lit(None).cast("double").alias("lower_tolerance"), F.array("requirement_id").alias("refs"))
    return R.reconciled(req, before.unionByName(earlier)).select("doc_id", "candidate_id", F.array_join("refs", ",").alias("refs"))


_TARGETS = f"""{_MATCH}, items AS (SELECT doc_id, generated AS item_id, place % 5 <> 0 AS active, CASE WHEN place % 7 = 0 THEN 'item' ELSE 'global_requirement' END AS scope, CASE WHEN place % 11 = 0 THEN true WHEN place % 13 = 0 THEN NULL ELSE false END AS balloon_required FROM o WHERE generated IS NOT NULL)"""


@query(f"""WITH {_TARGETS} SELECT doc_id, item_id AS subject, 'item' AS kind FROM items WHERE active AND scope = 'global_requirement' AND balloon_required IS DISTINCT FROM false
  UNION ALL SELECT doc_id, requirement_id, 'requirement' FROM o WHERE outcome = 'global_scope' AND NOT EXISTS (SELECT 1 FROM items i WHERE i.doc_id = o.doc_id AND i.item_id = o.generated AND active AND scope = 'global_requirement' AND balloon_required = false)""")
def chk04_global_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matched(spark, sf_dir)
    place = F.col("place")
    items = found.where("generated is not null").select("doc_id", F.col("generated").alias("item_id"), (place % 5 != 0).alias("active"), F.when(place % 7 == 0, "item").otherwise("global_requirement").alias("scope"), F.when(place % 11 == 0, True).when(place % 13 == 0, None).otherwise(False).alias("balloon_required"))
    return R.broken_global_targets(items, found)


_ITEMS = [("o_orderkey % 3 = 0", {"doc_id": "o_custkey", "item_id": "'c' || CAST(o_orderkey AS STRING)", "manual": "o_orderkey % 4 = 0", "active": "o_orderkey % 10 <> 0", "inspection_item": "CASE WHEN o_orderkey % 5 = 0 THEN 'own' WHEN o_orderkey % 7 = 0 THEN '' END", "inspection_standard": "CAST(NULL AS STRING)", "key_dimension": "CAST(NULL AS STRING)"})]
_PROJECTED = f"""{_MATCH}, {S.derived_sql('its', 'orders', _ITEMS)}, al AS (SELECT * FROM its UNION ALL SELECT doc_id, generated, false, true, NULL, NULL, NULL FROM o WHERE generated IS NOT NULL),
e AS (SELECT doc_id, requirement_id, inspection_item, inspection_standard, key_dimension, unnest(CASE WHEN generated IS NULL THEN matched ELSE list_append(matched, generated) END) AS item_id FROM o),
f AS (SELECT doc_id, item_id, list_sort(list(requirement_id)) AS refs, arg_min(inspection_item, requirement_id) FILTER (inspection_item IS NOT NULL) AS i, min(requirement_id) FILTER (inspection_item IS NOT NULL) AS ri, arg_min(inspection_standard, requirement_id) FILTER (inspection_standard IS NOT NULL) AS s, min(requirement_id) FILTER (inspection_standard IS NOT NULL) AS rs,
  arg_min(key_dimension, requirement_id) FILTER (key_dimension IS NOT NULL) AS k, min(requirement_id) FILTER (key_dimension IS NOT NULL) AS rk FROM e GROUP BY ALL),
p AS (SELECT a.doc_id, a.item_id, a.manual, a.active, coalesce(f.refs, []) AS refs, CASE WHEN NOT manual AND coalesce(inspection_item, '') = '' AND i IS NOT NULL THEN i ELSE inspection_item END AS inspection_item, CASE WHEN NOT manual AND s IS NOT NULL THEN s END AS inspection_standard, CASE WHEN NOT manual AND k IS NOT NULL THEN k END AS key_dimension,
  CASE WHEN NOT manual AND coalesce(inspection_item, '') = '' AND i IS NOT NULL THEN ri END AS source_inspection_item, CASE WHEN NOT manual AND s IS NOT NULL THEN rs END AS source_inspection_standard, CASE WHEN NOT manual AND k IS NOT NULL THEN rk END AS source_key_dimension FROM al a LEFT JOIN f ON f.doc_id = a.doc_id AND f.item_id = a.item_id)"""


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _matched(spark, sf_dir)
    none = F.lit(None).cast("string")
    made = found.where("generated is not null").select("doc_id", F.col("generated").alias("item_id"), F.lit(False).alias("manual"), F.lit(True).alias("active"), *(none.alias(c) for c in R.SUGGESTED))
    items = S.derived(S.table(spark, sf_dir, "orders"), _ITEMS).unionByName(made)
    return R.projected(items, found).join(items.select("doc_id", "item_id", "manual", "active"), ["doc_id", "item_id"])


@query(f"WITH {_PROJECTED} SELECT doc_id, item_id, array_to_string(refs, ',') AS refs, inspection_item, inspection_standard, key_dimension, source_inspection_item, source_inspection_standard, source_key_dimension FROM p")
def join35_projected_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _projected(spark, sf_dir).withColumn("refs", F.array_join("refs", ","))
    return out.select("doc_id", "item_id", "refs", *R.SUGGESTED, *(f"source_{c}" for c in R.SUGGESTED))


@query(f"""WITH {_PROJECTED}, gone AS (SELECT doc_id, min(requirement_id) AS g FROM req WHERE doc_id % 2 = 0 GROUP BY ALL), j AS (SELECT p.*, g, NOT manual AND coalesce(source_inspection_item = g, false) AS hi, NOT manual AND coalesce(source_inspection_standard = g, false) AS hs, NOT manual AND coalesce(source_key_dimension = g, false) AS hk, coalesce(item_id = {_ID('g')}, false) AS own FROM p LEFT JOIN gone USING (doc_id))
  SELECT doc_id, item_id, array_to_string(CASE WHEN g IS NULL THEN refs ELSE list_filter(refs, lambda x: x <> g) END, ',') AS refs, CASE WHEN NOT hi THEN inspection_item END AS inspection_item, CASE WHEN NOT hs THEN inspection_standard END AS inspection_standard, CASE WHEN NOT hk THEN key_dimension END AS key_dimension,
    (hi OR hs OR hk) AND active AND NOT own AS regeneration_required, active AND NOT own AS active FROM j""")
def evt06_withdrawn_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every other document the first requirement is withdrawn."""
    gone = _requirements(spark, sf_dir).where("doc_id % 2 = 0").groupBy("doc_id").agg(F.min("requirement_id").alias("requirement_id"))
    return R.withdrawn(_projected(spark, sf_dir), gone).withColumn("refs", F.array_join("refs", ","))


@query(f"""WITH {_MATCH}, s AS (SELECT doc_id, unnest(['s' || (place % 5), 't' || place]) AS observation_id, outcome, generated, ordinal, outcome <> 'matched_items' AS rr, CASE WHEN place % 3 = 1 THEN 'confirmed' ELSE 'suggested' END AS st FROM o), g AS (SELECT doc_id, observation_id, bool_or(outcome = 'unresolved') AS open, min(generated) AS made, bool_and(ordinal IS NULL) AS alone, bool_or(rr) AS rr, bool_or(st = 'confirmed') AS c FROM s GROUP BY ALL)
  SELECT doc_id, observation_id, CASE WHEN open THEN 'ambiguous' WHEN made IS NOT NULL THEN 'candidate' ELSE 'reference_context' END AS disposition, CASE WHEN NOT open THEN made END AS candidate_id, rr AS requires_confirmation, CASE WHEN NOT rr THEN c END AS confirmation_accepted, CASE WHEN NOT alone THEN 'technical_requirement' END AS reason FROM g""")
def cls26_evt10_requirement_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("place")
    found = _matched(spark, sf_dir).withColumns({"source_ids": F.array(F.concat(F.lit("s"), (place % 5).cast("string")), F.concat(F.lit("t"), place.cast("string"))), "review_required": F.col("outcome") != "matched_items", "review_status": F.when(place % 3 == 1, "confirmed").otherwise("suggested")})
    observations = found.select("doc_id", F.explode("source_ids").alias("observation_id")).distinct()
    return R.requirement_coverage(observations, found)
