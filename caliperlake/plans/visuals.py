"""Queries of the operators on visual observations over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlake.functions.geometry import Box, Point
from caliperlake.operators import frames
from caliperlake.operators import visuals as V
from caliperlake.plans.balloons import _ID as ID
from caliperlake.plans.inspection import OBS
from caliperlake.plans.register import QUERIES, query
from caliperlake.sources import adapters as S
from caliperlake.sources.documents import polygon_box

_X, _Y = "CAST(l_partkey % 50 * 10 AS DOUBLE)", "CAST(l_orderkey % 40 * 15 AS DOUBLE)"
_PLACE = {"doc_id": "l_suppkey", "page_index": "CAST(l_linenumber - 1 AS INT)"}


def _item(cond: str, x0: str, y0: str, x1: str, y1: str, fill: str) -> tuple[str, dict[str, str]]:
    return cond, {**_PLACE, "opcode": "'re'", "x0": x0, "y0": y0, "x1": x1, "y1": y1, "fill": fill, "thick": "CAST(l_partkey % 4 AS DOUBLE) / 2e0"}


_ITEMS = [
    _item("true", f"{_X} + 22", f"{_Y} - 3", f"{_X} + 40", f"{_Y} + 9", "l_partkey % 2 = 0"),
    _item("l_partkey % 3 = 0", _X, f"{_Y} + 12", f"{_X} + l_partkey % 90", f"{_Y} + 12.5e0", "false"),
    _item("l_partkey % 11 = 0", f"{_X} + 10", f"{_Y} + 2", f"{_X} + 14", f"{_Y} + 45", "l_orderkey % 2 = 0"),
    _item("l_partkey % 13 = 0", f"{_X} - 90", _Y, f"{_X} + 20", f"{_Y} + 2", "false"),
]
_TEXTS = [("true", {**_PLACE, "observation_id": ID, "raw_text": "CASE WHEN l_partkey % 6 = 0 THEN 'a1 ' ELSE 'Text' END", "x0": _X, "y0": _Y, "x1": f"{_X} + 20", "y1": f"{_Y} + 10"})]
_F = lambda v: f"printf('%.3f', round_even({v}, 3))"
_CONTENT = f"""'{{"coordinates":["' || {_F('x0')} || '","' || {_F('y0')} || '","' || {_F('x1')} || '","' || {_F('y1')} || '"],"opcode":"re","style":{{"color":null,"fill":' || CASE WHEN fill THEN '"1"' ELSE 'null' END || ',"width":"' || {_F('thick')} || '"}}}}'"""
_ITEMS_SQL = f"{S.derived_sql('items', 'lineitem', _ITEMS)}, ci AS (SELECT *, {_CONTENT} AS content FROM items)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.derived(S.table(spark, sf_dir, "lineitem"), _ITEMS)
    style = {"color": F.lit(None).cast("string"), "fill": F.when(F.col("fill"), '"1"'), "width": F.concat(F.lit('"'), F.format_string("%.3f", F.bround("thick", 3)), F.lit('"'))}
    return df.withColumn("content", V.canonical_item(F.col("opcode"), [F.col(c) for c in ("x0", "y0", "x1", "y1")], style))


@query(f"WITH {_ITEMS_SQL} SELECT doc_id, page_index, content, sha256(content) AS sha256 FROM ci")
def src11_canonical_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("doc_id", "page_index", "content", F.sha2("content", 256).alias("sha256"))


def _branch(p: str) -> str:
    mean, token = f"{p}sum / nullif({p}n, 0)", "tok"
    return f"CASE WHEN {mean} <= 34 AND {p}h > 2 AND {p}fill <= 1 AND {p}w <= 60 AND {p}area <= 6000 THEN 'geometry_compact' WHEN {mean} <= 34 AND {p}h > 2 AND {p}fill <= 1 AND {p}w > 60 AND {p}n > 3 THEN 'geometry_wide_multi_item' WHEN {mean} <= 34 AND {p}h > 2 AND {p}fill > 1 AND {p}area > 5800 AND {p}h <= 42 THEN 'geometry_filled' WHEN {token} AND {p}area <= 6000 THEN 'short_token_rescue' END"


def _sums(p: str, cond: str) -> str:
    return f"""count(*) FILTER ({cond}) AS {p}n, count(*) FILTER (fill AND {cond}) AS {p}fill, max(w) FILTER ({cond}) AS {p}w, max(h) FILTER ({cond}) AS {p}h, sum(h) FILTER ({cond}) AS {p}sum, least(tx0, min(x0) FILTER ({cond})) AS {p}x0, least(ty0, min(y0) FILTER ({cond})) AS {p}y0, greatest(tx1, max(x1) FILTER ({cond})) AS {p}x1, greatest(ty1, max(y1) FILTER ({cond})) AS {p}y1,
    sha256(coalesce(string_agg(content, '' ORDER BY y0, x0, y1, x1, content) FILTER ({cond}), '')) AS {p}sha"""


@query(f"""WITH {_ITEMS_SQL}, {S.derived_sql('texts', 'lineitem', _TEXTS)}, near AS (SELECT t.doc_id, t.page_index, t.observation_id AS text_id, regexp_full_match(upper(trim(t.raw_text)), '[A-Z0-9]{{1,3}}') AS tok, t.x0 AS tx0, t.y0 AS ty0, t.x1 AS tx1, t.y1 AS ty1, i.x0, i.y0, i.x1, i.y1, i.x1 - i.x0 AS w, i.y1 - i.y0 AS h, fill, content
  FROM texts t JOIN ci i ON t.doc_id = i.doc_id AND t.page_index = i.page_index AND greatest(0.0, i.x0 - t.x1, t.x0 - i.x1) <= 12 AND greatest(0.0, i.y0 - t.y1, t.y0 - i.y1) <= 12 AND i.x1 - i.x0 <= 96 AND i.y1 - i.y0 <= 96),
g AS (SELECT doc_id, page_index, text_id, tok, tx0, ty0, tx1, ty1, {_sums('a', 'true')}, {_sums('c', '(w <= 60 AND h <= 42)')} FROM near GROUP BY doc_id, page_index, text_id, tok, tx0, ty0, tx1, ty1), k AS (SELECT *, (ax1 - ax0) * (ay1 - ay0) AS aarea, CASE WHEN cn > 0 THEN (cx1 - cx0) * (cy1 - cy0) END AS carea FROM g),
s AS (SELECT *, {_branch('a')} AS base, CASE WHEN cn > 0 THEN {_branch('c')} END AS alone, aarea > 5400 AS large FROM k), r AS (SELECT *, coalesce(CASE WHEN large THEN carea <= 5400 AND carea <= 6000 AND cn > 40 AND alone = 'short_token_rescue' ELSE base = 'geometry_wide_multi_item' AND carea <= 5400 AND alone = 'geometry_compact' END, false) AS replaced FROM s)
  SELECT doc_id, page_index, text_id, CASE WHEN replaced THEN alone ELSE base END AS reason, replaced, CASE WHEN replaced THEN cn ELSE an END AS n_items, greatest(0.0, CASE WHEN replaced THEN cx0 ELSE ax0 END) AS x0, greatest(0.0, CASE WHEN replaced THEN cy0 ELSE ay0 END) AS y0, least(600.0, CASE WHEN replaced THEN cx1 ELSE ax1 END) AS x1, least(900.0, CASE WHEN replaced THEN cy1 ELSE ay1 END) AS y1,
    CASE WHEN replaced THEN csha ELSE asha END AS geometry_sha256 FROM r WHERE replaced OR (NOT large AND base IS NOT NULL)""")
def cls05_cls06_agg04_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.proposals(S.derived(S.table(spark, sf_dir, "lineitem"), _TEXTS), _items(spark, sf_dir), 600.0, 900.0)


_IMAGES = [
    ("l_partkey % 5 = 0", {**_PLACE, "x0": f"{_X} + 1", "y0": f"{_Y} + 1", "x1": f"{_X} + 19", "y1": f"{_Y} + 9"}),
    ("l_partkey % 3 = 0", {**_PLACE, "x0": f"{_X} - 5", "y0": f"{_Y} - 30", "x1": f"{_X} + 40", "y1": f"{_Y} + 40"}),
    ("l_partkey % 97 = 0", {**_PLACE, "x0": "-10e0", "y0": "0e0", "x1": "610e0", "y1": "800e0"}),
]
_REGIONS = f"""{S.derived_sql('img', 'lineitem', _IMAGES)}, {S.OBSERVATIONS_SQL}, cut AS (SELECT doc_id, page_index, greatest(x0, 0) AS x0, greatest(y0, 0) AS y0, least(x1, 600) AS x1, least(y1, 900) AS y1 FROM img),
q AS (SELECT doc_id, page_index, unnest(CASE WHEN (x1 - x0) * (y1 - y0) / 540000 < 0.8 THEN [[x0, y0, x1, y1]] ELSE [[x0, y0, (x0 + x1) / 2, (y0 + y1) / 2], [(x0 + x1) / 2, y0, x1, (y0 + y1) / 2], [x0, (y0 + y1) / 2, (x0 + x1) / 2, y1], [(x0 + x1) / 2, (y0 + y1) / 2, x1, y1]] END) AS b FROM cut WHERE x1 > x0 AND y1 > y0),
reg AS (SELECT DISTINCT doc_id, page_index, b[1] AS x0, b[2] AS y0, b[3] AS x1, b[4] AS y1, printf('%.3f,%.3f,%.3f,%.3f', b[1], b[2], b[3], b[4]) AS region_id FROM q),
inn AS (SELECT r.doc_id, r.page_index, region_id, greatest(r.x0, o.x0) AS x0, greatest(r.y0, o.y0) AS y0, least(r.x1, o.x1) AS x1, least(r.y1, o.y1) AS y1 FROM reg r JOIN obs o ON o.doc_id = r.doc_id AND o.page_index = r.page_index AND r.x1 > o.x0 AND o.x1 > r.x0 AND r.y1 > o.y0 AND o.y1 > r.y0),
ed AS (SELECT DISTINCT doc_id, page_index, region_id, unnest([x0, x1]) AS l FROM inn), sl AS (SELECT *, lead(l) OVER (PARTITION BY doc_id, page_index, region_id ORDER BY l) AS r FROM ed), si AS (SELECT s.doc_id, s.page_index, s.region_id, l, r, y0, y1 FROM sl s JOIN inn i ON i.doc_id = s.doc_id AND i.page_index = s.page_index AND i.region_id = s.region_id AND x0 <= l AND x1 >= r WHERE r IS NOT NULL),
nw AS (SELECT *, CASE WHEN y0 <= max(y1) OVER (PARTITION BY doc_id, page_index, region_id, l ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM si), isl AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_index, region_id, l ORDER BY y0, y1) AS k FROM nw),
ar AS (SELECT doc_id, page_index, region_id, sum((r - l) * (b - a)) AS covered FROM (SELECT doc_id, page_index, region_id, l, r, min(y0) AS a, max(y1) AS b FROM isl GROUP BY doc_id, page_index, region_id, l, r, k) GROUP BY ALL),
sh AS (SELECT reg.*, least(1.0, coalesce(covered, 0) / ((x1 - x0) * (y1 - y0))) AS share FROM reg LEFT JOIN ar USING (doc_id, page_index, region_id))"""


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.covered_shares(V.image_regions(S.derived(S.table(spark, sf_dir, "lineitem"), _IMAGES), 600.0, 900.0), S.observations(spark, sf_dir))


@query(f"WITH {_REGIONS} SELECT doc_id, page_index, region_id, CAST(floor(share * 1000000 + 0.5) AS BIGINT) AS share_ppm FROM sh")
def join08_covered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shares(spark, sf_dir).select("doc_id", "page_index", "region_id", F.floor(F.col("share") * 1000000 + 0.5).cast("bigint").alias("share_ppm"))


@query(f"WITH {_REGIONS} SELECT doc_id, page_index, region_id, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y0, x0, y1, x1) AS INT) AS place FROM sh WHERE share < 0.8 QUALIFY place <= 16")
def win09_regions_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.regions_to_read(_shares(spark, sf_dir)).select("doc_id", "page_index", "region_id", "place")


_SEEN = [("true", {"doc_id": "l_suppkey", "visual_id": f"'v' || {ID}", "a": ID, "b": "'p' || CAST(l_partkey AS STRING)"})]
_SAID = [
    ("l_partkey % 3 = 0", {"doc_id": "l_suppkey", "observation_id": ID, "disposition": "CASE WHEN l_partkey % 5 = 0 THEN 'candidate' ELSE 'ambiguous' END", "text": "CASE l_orderkey % 4 WHEN 0 THEN 'abc' WHEN 1 THEN 'M' WHEN 2 THEN 'a1' ELSE 'xM' END"}),
]
_WAITING = [("l_linenumber = 2", {"doc_id": "l_suppkey", "source": "'p' || CAST(l_partkey AS STRING)", "requires_confirmation": "l_orderkey % 2 = 0"})]


@query(f"""WITH {S.derived_sql('v', 'lineitem', _SEEN)}, {S.derived_sql('t', 'lineitem', _SAID)}, {S.derived_sql('c', 'lineitem', _WAITING)} SELECT doc_id, visual_id, CASE WHEN (doc_id, a) IN (SELECT (doc_id, observation_id) FROM t WHERE disposition = 'ambiguous' AND text IN ('M', 'a1')) THEN 0 WHEN (doc_id, b) IN (SELECT (doc_id, source) FROM c WHERE requires_confirmation) THEN 1 ELSE 2 END AS priority FROM v""")
def win25_visual_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return V.priorities(S.derived(li, _SEEN).withColumn("text_ids", F.array("a", "b")), S.derived(li, _SAID), S.derived(li, _WAITING).withColumn("source_ids", F.array("source")))


def win16_packed_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First fit depends on all earlier choices of its page; a test holds it against brute force."""
    obs = S.observations(spark, sf_dir).select("doc_id", "page_index", F.col("observation_id").alias("visual_id"), (F.length("raw_text") % 3).alias("priority"), "x0", "y0", "x1", "y1")
    return V.packed_crops(obs, 600.0, 900.0)


QUERIES["win16_packed_crops"] = win16_packed_crops

_OWNED = [("true", {"doc_id": "l_suppkey", "visual_id": f"'v' || {ID}", "page_index": "CAST(CASE WHEN l_linenumber = 4 THEN 9 ELSE l_partkey % 3 END AS INT)", "a": "l_partkey", "b": "l_partkey + 3"})]


@query(f"""WITH {S.derived_sql('v', 'lineitem', _OWNED)}, l AS (SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS line_id, CAST(l_partkey % 3 AS INT) AS page_index, l_partkey % 7 <> 0 AS resolved, CASE l_partkey % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'reference_context' ELSE 'non_inspection' END AS disposition FROM lineitem),
e AS (SELECT v.doc_id, visual_id, coalesce(resolved AND l.page_index = v.page AND disposition <> 'candidate', false) AS ok, coalesce(disposition, '') = 'non_inspection' AS none FROM (SELECT doc_id, visual_id, page_index AS page, unnest([a, b]) AS line_id FROM v) v LEFT JOIN l USING (doc_id, line_id)) SELECT doc_id, visual_id, CASE WHEN bool_and(none) THEN 'non_inspection' ELSE 'reference_context' END AS disposition FROM e GROUP BY ALL HAVING bool_and(ok)""")
def cls25_inherited_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    part = F.col("line_id")
    lines = li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("line_id")).distinct().withColumns({"page_index": (part % 3).cast("int"), "resolved": part % 7 != 0, "disposition": S.pick(("candidate", "reference_context", "non_inspection", "non_inspection", "non_inspection"), part % 5)})
    return V.inherited_coverage(S.derived(li, _OWNED).withColumn("line_ids", F.array("a", "b")), lines)


@query(f"""{OBS}, p AS (SELECT observation_id, page_index % 4 AS r, unnest([[2 * x0, 2 * y0], [2 * x1 + 3, 2 * y0], [2 * x1, 2 * y1], [2 * x0 - 1, 2 * y1]]) AS q FROM obs), i AS (SELECT observation_id, r, q[1] + 10 AS u, q[2] - 20 AS v FROM p),
b AS (SELECT observation_id, CASE r WHEN 0 THEN u / 2 WHEN 1 THEN v / 2 WHEN 2 THEN 600 - u / 2 ELSE 600 - v / 2 END AS x, CASE r WHEN 0 THEN v / 2 WHEN 1 THEN 900 - u / 2 WHEN 2 THEN 900 - v / 2 ELSE u / 2 END AS y FROM i), g AS (SELECT observation_id, greatest(0.0, min(x)) AS x0, greatest(0.0, min(y)) AS y0, least(600.0, max(x)) AS x1, least(900.0, max(y)) AS y1 FROM b GROUP BY ALL)
  SELECT * FROM g WHERE x0 < x1 AND y0 < y1""")
def src04_polygon_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons in pixels of crops of the rendered page, at twice its size."""
    obs = S.observations(spark, sf_dir)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (2 * F.col(c) for c in ("x0", "y0", "x1", "y1"))
    polygon = F.array(corner(x0, y0), corner(x1 + 3, y0), corner(x1, y1), corner(x0 - 1, y1))
    b = polygon_box(polygon, Point(F.lit(10.0), F.lit(-20.0)), F.col("page_index") % 4 * 90, F.lit(600.0), F.lit(900.0), 2.0)
    return obs.select("observation_id", *(v.alias(n) for v, n in zip(b, ("x0", "y0", "x1", "y1"), strict=True))).where("x0 is not null")


@query(f"{OBS} SELECT observation_id, x0 + 0.25 * (x1 - x0) AS bx0, y0 + 0.5 * (y1 - y0) AS by0, x0 + 0.75 * (x1 - x0) AS bx1, y0 + 1.0 * (y1 - y0) AS by1 FROM obs")
def src13_page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = frames.page_box(Box(*(F.lit(v) for v in (0.25, 0.5, 0.75, 1.0))), Box.of())
    return S.observations(spark, sf_dir).select("observation_id", *(v.alias(f"b{n}") for v, n in zip(b, ("x0", "y0", "x1", "y1"), strict=True)))
