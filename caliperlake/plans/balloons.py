"""Queries of the balloon operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caliperlake.operators import balloons as B
from caliperlake.plans.register import query
from caliperlake.sources import adapters as S

_ID = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)"
_X, _Y = "CAST(l_partkey % 50 * 10 AS DOUBLE)", "CAST(l_orderkey % 40 * 15 AS DOUBLE)"
_PLACE = {"doc_id": "l_suppkey", "page_index": "CAST(l_linenumber - 1 AS INT)"}
_ITEMS = [("true", {**_PLACE, "item_id": _ID, "active": "l_quantity > 3", "required": "l_returnflag <> 'R'", "source": f"'s' || {_ID}"})]
_BALLOONS = [
    (
        "l_quantity > 2 AND l_returnflag <> 'R' AND l_partkey % 53 <> 0",
        {
            **_PLACE, "balloon_id": f"'b' || {_ID}", "item_id": _ID, "source_id": f"CASE WHEN l_partkey % 97 = 0 THEN 'x' ELSE 's' || {_ID} END", "status": "CASE WHEN l_partkey % 13 = 0 THEN 'deleted' ELSE 'active' END",
            "placement_status": "CASE WHEN l_partkey % 89 = 0 THEN 'manual_required' ELSE 'placed' END", "part": "l_partkey", "flag": "CASE WHEN l_partkey % 71 = 0 THEN 'forbidden_overlap' WHEN l_partkey % 67 = 0 THEN 'outside_cropbox' ELSE 'none' END",
            "cx": f"{_X} + 36 + l_orderkey % 7 * 3", "cy": f"{_Y} + 14 + l_partkey % 3", "a_x0": _X, "a_y0": _Y, "a_x1": f"{_X} + 20", "a_y1": f"{_Y} + 10", "tx": f"{_X} + CASE WHEN l_partkey % 79 = 0 THEN 25 ELSE 10 END", "ty": f"{_Y} + 5",
            "sort_order": "CAST(l_orderkey % 1000 AS INT)", "version": "CAST(1 AS INT)",
        },
    )
]
_TEXTS = [("true", {**_PLACE, "observation_id": _ID, "raw_text": "CASE WHEN l_partkey % 61 = 0 THEN '审核 x' ELSE 'x' END", "x0": _X, "y0": _Y, "x1": f"{_X} + 20", "y1": f"{_Y} + 10"})]
_TABLES = f"""{S.derived_sql('items', 'lineitem', _ITEMS)}, {S.derived_sql('raw', 'lineitem', _BALLOONS)}, {S.derived_sql('texts', 'lineitem', _TEXTS)},
bal AS (SELECT *, CASE WHEN status <> 'active' OR part % 83 = 0 THEN NULL ELSE CAST(row_number() OVER (PARTITION BY doc_id, status ORDER BY page_index, balloon_id) + CASE WHEN part % 73 = 0 THEN 1000 ELSE 0 END AS INT) END AS formal_number FROM raw),
live AS (SELECT *, greatest(5, length(CAST(formal_number AS VARCHAR)) * 5.724) / 2 AS gw, 5.238 AS gh FROM bal WHERE status = 'active')"""
_NEAR = lambda c, b: f"sqrt(pow({c}.cx - least(greatest({c}.cx, {b}.x0), {b}.x1), 2) + pow({c}.cy - least(greatest({c}.cy, {b}.y0), {b}.y1), 2)) < 12"
_GLYPH = lambda c, b: f"({c}.cx - {c}.gw < {b}.x1 AND {b}.x0 < {c}.cx + {c}.gw AND {c}.cy - {c}.gh < {b}.y1 AND {b}.y0 < {c}.cy + {c}.gh)"
_INTO = lambda c, g: f"sqrt(pow({c}.cx - least(greatest({c}.cx, {g}.cx - {g}.gw), {g}.cx + {g}.gw), 2) + pow({c}.cy - least(greatest({c}.cy, {g}.cy - {g}.gh), {g}.cy + {g}.gh), 2)) < 12"
_HITS = f"""{_TABLES}, boxes AS (SELECT DISTINCT doc_id, page_index, 'strip' AS box_id, 0.0::DOUBLE AS x0, 553.0::DOUBLE AS y0, 600.0::DOUBLE AS x1, 700.0::DOUBLE AS y1 FROM texts UNION ALL SELECT doc_id, page_index, observation_id, x0, y0, x1, y1 FROM texts WHERE raw_text LIKE '%审核%'),
ht AS (SELECT l.doc_id, l.page_index, balloon_id, b.observation_id AS box_id FROM live l JOIN texts b ON b.doc_id = l.doc_id AND b.page_index = l.page_index WHERE ({_NEAR('l', 'b')}) OR (formal_number IS NOT NULL AND {_GLYPH('l', 'b')})),
hp AS (SELECT l.doc_id, l.page_index, balloon_id, b.box_id FROM live l JOIN boxes b ON b.doc_id = l.doc_id AND b.page_index = l.page_index WHERE ({_NEAR('l', 'b')}) OR (formal_number IS NOT NULL AND {_GLYPH('l', 'b')})),
num AS (SELECT * FROM live WHERE formal_number IS NOT NULL),
pr AS (SELECT a.doc_id, a.page_index, a.balloon_id AS left_id, b.balloon_id AS right_id, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) < 24 AS circle_overlap,
  a.cx - a.gw < b.cx + b.gw AND b.cx - b.gw < a.cx + a.gw AND a.cy - a.gh < b.cy + b.gh AND b.cy - b.gh < a.cy + a.gh AS glyph_overlap, ({_INTO('b', 'a')}) OR ({_INTO('a', 'b')}) AS glyph_circle_overlap
  FROM num a JOIN num b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.balloon_id < b.balloon_id), pairs AS (SELECT * FROM pr WHERE circle_overlap OR glyph_overlap OR glyph_circle_overlap)"""
_FOUND = f"""{_HITS}, kinds AS (SELECT id, bool_or(c) AS c, bool_or(g) AS g, bool_or(m) AS m FROM (SELECT left_id AS id, circle_overlap AS c, glyph_overlap AS g, glyph_circle_overlap AS m FROM pairs UNION ALL SELECT right_id, circle_overlap, glyph_overlap, glyph_circle_overlap FROM pairs) GROUP BY ALL),
f AS (SELECT l.doc_id, l.balloon_id, concat_ws(',', CASE WHEN i.item_id IS NULL OR NOT i.required OR l.source_id <> i.source THEN 'item_balloon_disconnect' END, CASE WHEN placement_status = 'manual_required' THEN 'manual_required' END,
  CASE WHEN formal_number IS NULL OR sqrt(gw * gw + gh * gh) > 11 THEN 'unreadable_number' END, CASE WHEN cx > 600 OR cy > 700 OR flag = 'outside_cropbox' THEN 'outside_cropbox' END, CASE WHEN formal_number IS NOT NULL AND sqrt(gw * gw + gh * gh) > 11 THEN 'owner_glyph_outside_circle' END,
  CASE WHEN formal_number IS NOT NULL AND balloon_id IN (SELECT balloon_id FROM hp) THEN 'protected_overlap' END, CASE WHEN flag = 'forbidden_overlap' OR (formal_number IS NOT NULL AND balloon_id IN (SELECT balloon_id FROM ht)) THEN 'source_text_overlap' END,
  CASE WHEN NOT (tx BETWEEN a_x0 AND a_x1 AND ty BETWEEN a_y0 AND a_y1) OR (tx = cx AND ty = cy) THEN 'invalid_leader' END, CASE WHEN c THEN 'circle_overlap' END, CASE WHEN g THEN 'glyph_overlap' END, CASE WHEN m THEN 'glyph_circle_overlap' END) AS codes
  FROM live l LEFT JOIN (SELECT * FROM items WHERE active) i ON i.doc_id = l.doc_id AND i.item_id = l.item_id LEFT JOIN kinds ON id = balloon_id)"""


def _balloons(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = S.derived(S.table(spark, sf_dir, "lineitem"), _BALLOONS)
    number = F.row_number().over(Window.partitionBy("doc_id", "status").orderBy("page_index", "balloon_id")) + F.when(F.col("part") % 73 == 0, 1000).otherwise(0)
    known = (F.col("status") == "active") & (F.col("part") % 83 != 0)
    return raw.withColumns({"formal_number": F.when(known, number).cast("int"), "flags": F.array("flag")})


def _rest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    li = S.table(spark, sf_dir, "lineitem")
    items = S.derived(li, _ITEMS).withColumn("source_ids", F.array("source"))
    texts = S.derived(li, _TEXTS)
    pages = texts.select("doc_id", "page_index").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(700.0)})
    return items, texts.withColumn("box_id", F.col("observation_id")), pages, B.protected_boxes(texts, pages)


@query(f"WITH {_HITS} SELECT * FROM hp")
def join15_join28_protected_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    protected = _rest(spark, sf_dir)[3]
    return B.covered_boxes(_balloons(spark, sf_dir).where("status = 'active'"), protected)


@query(f"WITH {_HITS} SELECT * FROM ht")
def join15_text_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.covered_boxes(_balloons(spark, sf_dir).where("status = 'active'"), _rest(spark, sf_dir)[1])


@query(f"WITH {_HITS} SELECT * FROM pairs")
def join14_balloon_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.collisions(_balloons(spark, sf_dir).where("status = 'active'"))


@query(f"WITH {_FOUND} SELECT * FROM f")
def chk01_win19_balloon_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, texts, pages, protected = _rest(spark, sf_dir)
    found = B.findings(items, _balloons(spark, sf_dir), texts, protected, pages)
    return found.select("doc_id", "balloon_id", F.array_join("codes", ",").alias("codes"))


@query(f"""WITH {_FOUND}, n AS (SELECT doc_id, formal_number, row_number() OVER (PARTITION BY doc_id ORDER BY formal_number) AS k FROM live), c AS (SELECT DISTINCT doc_id, unnest(string_split(codes, ',')) AS code FROM f UNION
  SELECT doc_id, 'missing_required_balloon' FROM items i WHERE active AND required AND NOT EXISTS (SELECT 1 FROM live l WHERE l.doc_id = i.doc_id AND l.item_id = i.item_id) UNION SELECT doc_id, 'duplicate_or_gapped_number' FROM n WHERE formal_number IS DISTINCT FROM k)
  SELECT doc_id, coalesce(string_agg(code, ',' ORDER BY list_position({list(B.BLOCKERS)}, code)) FILTER (code <> ''), '') AS blockers FROM (SELECT DISTINCT doc_id FROM items) LEFT JOIN c USING (doc_id) GROUP BY ALL""")
def chk01_balloon_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, texts, pages, protected = _rest(spark, sf_dir)
    balloons = _balloons(spark, sf_dir)
    return B.blockers(items, balloons, B.findings(items, balloons, texts, protected, pages))


@query(f"""WITH {_TABLES}, n AS (SELECT DISTINCT doc_id, item_id FROM items WHERE active AND required), h AS (SELECT DISTINCT doc_id, item_id FROM live),
b AS (SELECT coalesce(n.doc_id, h.doc_id) AS doc_id, n.item_id AS i, h.item_id AS k FROM n FULL JOIN h ON n.doc_id = h.doc_id AND n.item_id = h.item_id) SELECT doc_id, count(*) FILTER (k IS NULL) AS missing, count(*) FILTER (i IS NULL) AS unexpected, count(*) FILTER (k IS NULL OR i IS NULL) = 0 AS equal FROM b GROUP BY ALL""")
def set07_balloon_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.set_differences(_rest(spark, sf_dir)[0], _balloons(spark, sf_dir))


_ORDER = [("NOT (l_suppkey % 5 = 0 AND l_partkey % 37 = 0)", {"doc_id": "l_suppkey", "balloon_id": f"'b' || {_ID}", "position": "CAST(l_orderkey * 7 % 1009 AS INT)"}), ("l_suppkey % 7 = 0 AND l_partkey % 211 = 0", {"doc_id": "l_suppkey", "balloon_id": f"'b' || {_ID}", "position": "CAST(l_orderkey * 7 % 1009 AS INT)"})]


@query(f"""WITH {_TABLES}, {S.derived_sql('o', 'lineitem', _ORDER)}, ord AS (SELECT o.* FROM o SEMI JOIN live USING (doc_id, balloon_id)), g AS (SELECT doc_id, balloon_id, count(*) AS t, min(position) AS p FROM ord GROUP BY ALL),
d AS (SELECT doc_id, CASE WHEN max(t) > 1 THEN 'not_distinct' WHEN bool_or(t IS NULL) THEN 'not_the_active_set' END AS reason FROM live LEFT JOIN g USING (doc_id, balloon_id) GROUP BY ALL)
  SELECT l.doc_id, l.balloon_id, CASE WHEN reason IS NULL THEN CAST(row_number() OVER (PARTITION BY l.doc_id ORDER BY p, l.balloon_id) AS INT) END AS number, reason FROM live l LEFT JOIN g USING (doc_id, balloon_id) JOIN d ON d.doc_id = l.doc_id""")
def win20_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    balloons = _balloons(spark, sf_dir)
    live = balloons.where("status = 'active'").select("doc_id", "balloon_id")
    order = S.derived(S.table(spark, sf_dir, "lineitem"), _ORDER).join(live, ["doc_id", "balloon_id"], "left_semi")
    return B.renumbered(balloons, order)


_COMMANDS = [
    ("l_partkey % 3 = 0", {"doc_id": "l_suppkey", "balloon_id": f"'b' || {_ID}", "version": "CAST(2 AS INT)", "kind": "'move'", "cx": "CAST(l_partkey % 600 AS DOUBLE)", "cy": "50e0", "sort_order": "CAST(NULL AS INT)"}),
    ("l_partkey % 5 = 0", {"doc_id": "l_suppkey", "balloon_id": f"'b' || {_ID}", "version": "CAST(3 AS INT)", "kind": "'delete'", "cx": "CAST(NULL AS DOUBLE)", "cy": "CAST(NULL AS DOUBLE)", "sort_order": "CAST(NULL AS INT)"}),
    ("l_partkey % 10 = 0", {"doc_id": "l_suppkey", "balloon_id": f"'b' || {_ID}", "version": "CAST(4 AS INT)", "kind": "'rebuild'", "cx": "77e0", "cy": "88e0", "sort_order": "CAST(NULL AS INT)"}),
    ("l_suppkey % 3 = 0 AND l_partkey % 41 = 0", {"doc_id": "l_suppkey", "balloon_id": f"'b' || {_ID}", "version": "CAST(5 AS INT)", "kind": "'reorder'", "cx": "CAST(NULL AS DOUBLE)", "cy": "CAST(NULL AS DOUBLE)", "sort_order": "CAST(7 AS INT)"}),
]
_AFTER = f"""{_TABLES}, {S.derived_sql('c', 'lineitem', _COMMANDS)}, g AS (SELECT doc_id, balloon_id, count(*) AS n, arg_max(cx, version) FILTER (kind IN ('move', 'rebuild')) AS mx, arg_max(cy, version) FILTER (kind IN ('move', 'rebuild')) AS my, arg_max(kind, version) FILTER (kind IN ('delete', 'rebuild')) AS st,
  max(sort_order) AS so, bool_or(kind = 'reorder') AS ro, bool_or(kind = 'rebuild') AS rb FROM c GROUP BY ALL),
a AS (SELECT b.doc_id, b.balloon_id, CASE st WHEN 'delete' THEN 'deleted' WHEN 'rebuild' THEN 'active' ELSE status END AS status, coalesce(mx, cx) AS cx, coalesce(my, cy) AS cy, coalesce(so, sort_order) AS sort_order, formal_number, version + coalesce(n, 0) AS version, coalesce(ro, false) AS ro, coalesce(rb, false) AS rb FROM bal b LEFT JOIN g USING (doc_id, balloon_id)),
u AS (SELECT *, rb AND status = 'active' AND (formal_number IS NULL OR count(*) FILTER (status = 'active' AND NOT rb) OVER (PARTITION BY doc_id, formal_number) > 0) AS reused FROM a)"""


def _commanded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return B.after_commands(_balloons(spark, sf_dir), S.derived(S.table(spark, sf_dir, "lineitem"), _COMMANDS))


@query(f"WITH {_AFTER} SELECT doc_id, balloon_id, status, cx, cy, sort_order, CASE WHEN NOT reused THEN formal_number END AS formal_number, version FROM u")
def evt05_balloon_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commanded(spark, sf_dir)[0]


@query(f"WITH {_AFTER} SELECT doc_id, bool_or(reused OR ro) AS numbering_stale FROM u GROUP BY ALL")
def evt05_stale_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commanded(spark, sf_dir)[1]


@query(f"WITH {_TABLES} SELECT i.doc_id, i.item_id, balloon_id, CAST(row_number() OVER (PARTITION BY i.doc_id ORDER BY formal_number NULLS LAST, i.item_id, balloon_id) AS INT) AS position FROM items i LEFT JOIN (SELECT * FROM bal WHERE status <> 'deleted') b ON b.doc_id = i.doc_id AND b.item_id = i.item_id")
def join32_item_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.listed_items(_rest(spark, sf_dir)[0], _balloons(spark, sf_dir)).select("doc_id", "item_id", "balloon_id", "position")


@query(f"WITH {_TABLES} SELECT doc_id, item_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY item_id) AS INT) AS number FROM items WHERE active")
def win12_candidate_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.candidate_numbers(_rest(spark, sf_dir)[0], "item_id").select("doc_id", "item_id", "number")
