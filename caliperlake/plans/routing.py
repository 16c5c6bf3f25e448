"""Queries of the routing operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlake.operators import marks as M
from caliperlake.operators import routing as R
from caliperlake.plans.balloons import _ID as ID
from caliperlake.plans.register import query
from caliperlake.plans.releases import _case
from caliperlake.sources import adapters as S

_DOC = {"doc_id": "l_suppkey", "page_index": "CAST(l_linenumber - 1 AS INT)"}
_X, _Y = "CAST(l_partkey % 50 * 10 AS DOUBLE)", "CAST(l_orderkey % 40 * 15 AS DOUBLE)"
_KIND = _case("l_partkey", "diameter", "depth", "diameter", "depth", "datum_reference")

_BODY = """CASE WHEN event_id % 29 = 0 THEN 'no json' ELSE '{' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '"schema_version":"' || CASE WHEN event_id % 31 = 0 THEN 'old' ELSE 'visual-symbol-review/3' END || '",' END || CASE WHEN event_id % 37 = 0 THEN '"extra":1,' ELSE '' END
  || '"detections":[' || CASE WHEN event_id % 7 = 0 THEN '' ELSE '{"visual_observation_id":"' || CASE WHEN event_id % 11 = 0 THEN '' ELSE 'v' || CAST(event_id AS STRING) END || '","symbol_kind":"' || CASE WHEN event_id % 13 = 0 THEN 'zzz' ELSE 'depth' END || '","bbox_normalized":['
  || CASE event_id % 5 WHEN 0 THEN '0,125,500,1000' WHEN 1 THEN '0.25,0.5,0.75,1.0' WHEN 2 THEN '0,0,1,1' WHEN 3 THEN '0.5,0.5,2.5,1' ELSE '0.1,0.2,0.3' END || '],"confidence_signal":' || CASE WHEN event_id % 17 = 0 THEN '1.5' ELSE '0.75' END || ',"associated_text_observation_ids":["a","b"]}' END || ']}' END"""
_RESPONSES = [("true", {"event_id": "event_id", "body": _BODY})]


@query(f"""WITH r AS (SELECT event_id, event_id % 29 = 0 AS bad, event_id % 7 = 0 AS empty FROM events), b AS (SELECT *, CASE WHEN bad OR empty THEN NULL ELSE CASE event_id % 5 WHEN 0 THEN [0, 0.125, 0.5, 1.0] WHEN 1 THEN [0.25, 0.5, 0.75, 1.0] WHEN 2 THEN [0.0, 0, 1, 1] WHEN 3 THEN [0.5, 0.5, 2.5, 1] ELSE [0.1, 0.2, 0.3] END END AS box FROM r)
  SELECT event_id, CASE WHEN NOT bad AND NOT empty THEN CASE WHEN event_id % 11 = 0 THEN '' ELSE 'v' || event_id END END AS visual_id, CAST(box[1] AS DOUBLE) AS x0, CAST(box[3] AS DOUBLE) AS x1, CASE WHEN bad THEN 'json_invalid' WHEN event_id % 37 = 0 THEN 'unknown_field' WHEN event_id % 31 = 0 AND event_id % 3 <> 0 THEN 'schema_version' WHEN empty THEN 'no_detection' WHEN event_id % 11 = 0 THEN 'visual_observation_id' WHEN event_id % 13 = 0 THEN 'symbol_kind'
    WHEN event_id % 5 IN (3, 4) THEN 'bbox_normalized' WHEN event_id % 17 = 0 THEN 'confidence_signal' END AS reason FROM b""")
def src12_chk05_model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.detections(S.derived(S.table(spark, sf_dir, "events"), _RESPONSES))
    return found.select("event_id", "visual_id", F.try_element_at("box", F.lit(1)).alias("x0"), F.try_element_at("box", F.lit(3)).alias("x1"), "reason")


@query("SELECT event_id, CAST(round(value * 100) AS BIGINT) AS prompt_tokens, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id AS BIGINT) END AS completion_tokens, 1 + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS entries FROM events")
def src12_usage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    usage = F.create_map(F.lit("prompt_tokens"), F.round(F.col("value") * 100).cast("bigint").cast("string"), F.lit("completion_tokens"), F.when(k % 3 == 0, "1.5").otherwise(k.cast("string")), F.lit("model"), F.lit("x"))
    u = R.usage_counts(usage)
    return S.table(spark, sf_dir, "events").select("event_id", F.try_element_at(u, F.lit("prompt_tokens")).alias("prompt_tokens"), F.try_element_at(u, F.lit("completion_tokens")).alias("completion_tokens"), F.size(u).alias("entries"))


_DETECTED = [
    (
        "true",
        {
            "call_id": "l_orderkey", "place": ID, "visual_id": "'v' || CAST(l_partkey % 3 AS STRING)", "kind": _case("l_partkey", "depth", "diameter"), "b0": "CASE WHEN l_partkey % 13 = 0 THEN 0.9e0 ELSE 0.25e0 END", "b1": "0.5e0", "b2": "CASE WHEN l_partkey % 17 = 0 THEN 1.5e0 ELSE 0.75e0 END", "b3": "CASE WHEN l_partkey % 4 = 0 THEN 1e0 ELSE 0.875e0 END",
            "text": "CASE WHEN l_partkey % 11 = 0 THEN 'z' ELSE 'a' END",
        },
    )
]


@query(f"""WITH {S.derived_sql('d', 'lineitem', _DETECTED)}, n AS (SELECT *, count(*) OVER (PARTITION BY call_id, visual_id) AS n FROM d), b AS (SELECT *, CASE WHEN b2 <= b0 OR b2 > 1 THEN 'visual_bbox_invalid' WHEN visual_id = 'v2' AND call_id % 2 = 0 OR n > 4 OR text = 'z' THEN 'visual_source_mismatch' END AS bad FROM n)
  SELECT call_id, place, coalesce(bad, CASE WHEN row_number() OVER (PARTITION BY call_id, visual_id, kind, b0, b1, b2, b3, bad IS NULL ORDER BY place) > 1 THEN 'visual_duplicate_detection' END) AS reason, 100 + b0 * 40 AS x0, 50 + b3 * 20 AS y1 FROM b""")
def cls15_checked_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.derived(S.table(spark, sf_dir, "lineitem"), _DETECTED)
    crop = F.struct(F.lit(100.0).alias("x0"), F.lit(50.0).alias("y0"), F.lit(140.0).alias("x1"), F.lit(70.0).alias("y1"))
    d = d.withColumns({"box": F.array("b0", "b1", "b2", "b3"), "text_ids": F.array("text"), "crop": crop})
    known = d.select("call_id").distinct().select("call_id", F.explode(F.when(F.col("call_id") % 2 == 0, F.array(F.lit("v0"), F.lit("v1"))).otherwise(F.array(F.lit("v0"), F.lit("v1"), F.lit("v2")))).alias("visual_id"), F.array(F.lit("a"), F.lit("b")).alias("allowed"))
    return R.checked_detections(d, known).select("call_id", "place", "reason", "x0", "y1")


_SYMBOLS = [("true", {**_DOC, "detection_id": ID, "visual_id": "'v' || CAST(l_partkey % 20 AS STRING)", "kind": _KIND, "x0": _X, "y0": _Y, "x1": f"{_X} + 20", "y1": f"{_Y} + 10 + l_partkey % 3", "signal": "CAST(l_quantity AS DOUBLE) / 50e0", "text": "'t' || CAST(l_orderkey % 5 AS STRING)"})]
_SHARED = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))"
_GROUPED = f"""WITH RECURSIVE {S.derived_sql('s', 'lineitem', _SYMBOLS)}, e AS (SELECT a.doc_id, a.page_index, a.detection_id AS u, b.detection_id AS v FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.kind = b.kind AND a.detection_id <> b.detection_id WHERE {_SHARED} >= 0.8),
r AS (SELECT u AS node, u AS reach FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach), gid AS (SELECT node, min(reach) AS g FROM r GROUP BY ALL), k AS (SELECT s.*, coalesce(g, detection_id) AS g FROM s LEFT JOIN gid ON node = detection_id),
grp AS (SELECT doc_id, page_index, kind, g, first(detection_id ORDER BY y0, x0, visual_id, detection_id) AS detection_id, min(signal) AS signal, list_sort(list(DISTINCT text)) AS texts, list_sort(list(DISTINCT visual_id)) AS visuals FROM k GROUP BY ALL)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.symbol_groups(S.derived(S.table(spark, sf_dir, "lineitem"), _SYMBOLS).withColumn("text_ids", F.array("text")))


@query(f"{_GROUPED} SELECT doc_id, page_index, kind, detection_id, signal, array_to_string(texts, ',') AS texts, array_to_string(visuals, ',') AS visuals FROM grp")
def join19_agg25_symbol_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _groups(spark, sf_dir)
    return g.select("doc_id", "page_index", "kind", "detection_id", "signal", F.array_join("text_ids", ",").alias("texts"), F.array_join("visual_ids", ",").alias("visuals"))


@query(f"""{_GROUPED}, pe AS (SELECT DISTINCT doc_id, page_index, a.unnest AS u, b.unnest AS v FROM grp, unnest(visuals) a, unnest(visuals) b), pr AS (SELECT doc_id, page_index, u AS node, u AS reach FROM pe UNION SELECT pr.doc_id, pr.page_index, pr.node, pe.v FROM pr JOIN pe ON pe.doc_id = pr.doc_id AND pe.page_index = pr.page_index AND pe.u = pr.reach),
c AS (SELECT doc_id, page_index, node, min(reach) AS c FROM pr GROUP BY ALL), v AS (SELECT doc_id, page_index, visual_id, min(y0) AS y0, min(x0) AS x0 FROM s GROUP BY ALL)
  SELECT v.doc_id, v.page_index, visual_id, first_value(visual_id) OVER (PARTITION BY v.doc_id, v.page_index, c ORDER BY y0, x0, visual_id) AS owner_id, count(*) OVER (PARTITION BY v.doc_id, v.page_index, c) AS members FROM v JOIN c ON c.doc_id = v.doc_id AND c.page_index = v.page_index AND c.node = visual_id""")
def grp03_projection_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.derived(S.table(spark, sf_dir, "lineitem"), _SYMBOLS)
    visuals = s.groupBy("doc_id", "page_index", "visual_id").agg(F.min("y0").alias("y0"), F.min("x0").alias("x0"))
    return R.projection_components(visuals, _groups(spark, sf_dir))


_DEPTHS = [("true", {**_DOC, "symbol_id": ID, "depth": "CAST(l_partkey % 4 AS STRING)", "x0": f"{_X} + 5", "y0": _Y, "x1": f"{_X} + 15", "y1": f"{_Y} + 8"})]
_PRIMARIES = [("true", {**_DOC, "candidate_id": f"'c' || {ID}", "item_type": _case("l_orderkey", "thread", "radius", "diameter_dimension", "composite"), "depth": "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(l_partkey % 5 AS STRING) || '.0' END", "x0": _X, "y0": _Y, "x1": f"{_X} + 20", "y1": f"{_Y} + 10"})]


@query(f"""WITH {S.derived_sql('a', 'lineitem', _DEPTHS)}, {S.derived_sql('b', 'lineitem', _PRIMARIES)}, p AS (SELECT a.symbol_id, count(*) AS n, min(candidate_id) AS c, arg_min(b.depth, candidate_id) AS d1, any_value(b.depth) AS d FROM a JOIN b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND item_type <> 'radius' AND {_SHARED} >= 0.5 GROUP BY ALL)
  SELECT doc_id, a.symbol_id, CASE WHEN n IS NULL THEN 'no_primary' WHEN n > 1 THEN 'ambiguous' WHEN d IS NULL THEN 'enriched' WHEN CAST(d AS DOUBLE) = CAST(depth AS DOUBLE) THEN 'agrees' ELSE 'conflict' END AS outcome, CASE WHEN n = 1 THEN c END AS candidate_id FROM a LEFT JOIN p USING (symbol_id)""")
def join18_depth_primaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return R.depth_primaries(S.derived(li, _DEPTHS), S.derived(li, _PRIMARIES))


_VIS = [("true", {"doc_id": "l_suppkey", "visual_id": f"'v' || {ID}", "a": "l_partkey", "b": "CASE WHEN l_orderkey % 2 = 0 THEN l_partkey + 1 ELSE l_partkey END"})]
_OWN = [("true", {"doc_id": "l_suppkey", "candidate_id": f"'c' || {ID}", "s": "l_partkey", "t": "CASE WHEN l_orderkey % 3 = 0 THEN l_partkey + 1 END", "x0": "CAST(l_partkey % 7 AS DOUBLE)", "x1": "CAST(l_partkey % 7 + CASE WHEN l_linenumber = 2 THEN 9 ELSE 5 END AS DOUBLE)"})]
_BOX = "CAST(%s %% 7 AS DOUBLE)"


@query(f"""WITH {S.derived_sql('v', 'lineitem', _VIS)}, {S.derived_sql('c', 'lineitem', _OWN)}, t AS (SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS source_id, CAST(l_partkey % 7 AS DOUBLE) AS x0, CAST(l_partkey % 7 + 5 AS DOUBLE) AS x1 FROM lineitem), va AS (SELECT *, list_sort(list_distinct([a, b])) AS ids FROM v), ca AS (SELECT *, list_sort(list_filter([s, t], lambda q: q IS NOT NULL)) AS ids FROM c),
u AS (SELECT doc_id, candidate_id, bool_and(t.x0 IS NOT NULL) AS every, min(t.x0) AS u0, max(t.x1) AS u1 FROM (SELECT doc_id, candidate_id, unnest(ids) AS source_id FROM ca) e LEFT JOIN t USING (doc_id, source_id) GROUP BY ALL)
  SELECT va.doc_id, visual_id, ca.candidate_id, va.ids = ca.ids AS exact, coalesce(every AND ca.x0 = u0 AND ca.x1 = u1, false) AS coordinates_agree FROM va JOIN ca ON va.doc_id = ca.doc_id AND list_has_any(va.ids, ca.ids) JOIN u ON u.doc_id = ca.doc_id AND u.candidate_id = ca.candidate_id""")
def join17_overlapping_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    flat = {"y0": F.lit(0.0), "y1": F.lit(1.0)}
    candidates = S.derived(li, _OWN).withColumn("source_ids", F.array_compact(F.array("s", "t"))).withColumns(flat)
    part = F.col("source_id")
    texts = li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("source_id")).distinct().withColumns({"x0": (part % 7).cast("double"), "x1": (part % 7 + 5).cast("double"), **flat})
    return R.overlapping_sources(S.derived(li, _VIS).withColumn("text_ids", F.array("a", "b")), candidates, texts)


_LOCAL = [
    (
        "true",
        {
            "event_id": "event_id", "boxed": "event_id % 23 <> 0", "geometry_matches": "event_id % 29 <> 0", "n_texts": "CASE WHEN event_id % 31 = 0 THEN 0 ELSE 2 END", "n_distinct": "CASE WHEN event_id % 31 = 0 THEN 0 WHEN event_id % 37 = 0 THEN 1 ELSE 2 END", "n_known": "CASE WHEN event_id % 31 = 0 THEN 0 WHEN event_id % 41 = 0 THEN 1 ELSE 2 END",
            "n_doubled": "CASE WHEN event_id % 43 = 0 THEN 1 ELSE 0 END", "same_page": "event_id % 19 <> 0", "k": "event_id % 8", "n_overlapping": "CASE WHEN event_id % 17 = 0 THEN 2 ELSE 1 END", "n_exact": "CASE WHEN event_id % 13 = 0 THEN 0 ELSE 1 END", "n_coarse": "CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END",
            "exact_type": "CASE event_id % 8 WHEN 0 THEN 'diameter_dimension' WHEN 1 THEN 'thread' WHEN 2 THEN 'roughness' ELSE 'radius' END", "coordinates_agree": "event_id % 11 <> 0", "source_value": "CASE WHEN event_id % 14 = 0 THEN NULL ELSE '5' END", "candidate_value": "CASE WHEN event_id % 9 = 0 THEN '6' ELSE '5' END", "projection_conflict": "event_id % 47 = 0",
        },
    )
]
# Drawings around the text of each event, of nine kinds, with sides of 6 to 35 points: a square of lines, a box, both in one place, two boxes, a triangle around two characters, one around a letter, a square
# with a diagonal, a triangle in a box, a square beside a broken line.
_KIND, _SIDE, _LEFT = "CAST(floor(abs(value) * 7) AS BIGINT) % 9", "CAST(6 + event_id % 30 AS DOUBLE)", "CAST(event_id % 50 AS DOUBLE)"


def _stroke(place: int, kinds: str, opcode: str, ax: str, ay: str, bx: str, by: str) -> tuple[str, dict[str, str]]:
    return f"{_KIND} IN ({kinds})", {"doc_id": "user_id", "visual_id": "event_id", "place": f"CAST({place} AS INT)", "opcode": f"'{opcode}'", "ax": ax, "ay": ay, "bx": bx, "by": by}


_RIGHT, _ZERO = f"{_LEFT} + {_SIDE}", "0e0"
_MARK_PATHS = [
    _stroke(0, "0, 2, 4, 5, 6, 7, 8", "l", _LEFT, _ZERO, _RIGHT, _ZERO), _stroke(1, "0, 2, 6, 8", "l", _RIGHT, _ZERO, _RIGHT, _SIDE), _stroke(2, "0, 2, 6, 8", "l", _RIGHT, _SIDE, _LEFT, _SIDE),
    _stroke(3, "0, 2, 4, 5, 6, 7, 8", "l", _LEFT, _SIDE, _LEFT, "25e-2"), _stroke(4, "4, 5, 6, 7", "l", _RIGHT, _ZERO, _LEFT, _SIDE), _stroke(5, "1, 2, 3, 7", "re", _LEFT, _ZERO, _RIGHT, _SIDE),
    _stroke(6, "3", "re", f"{_LEFT} - 1e0", "-1e0", f"{_RIGHT} + 1e0", f"{_SIDE} + 1e0"), _stroke(7, "8", "l", _LEFT, "CAST(NULL AS DOUBLE)", _RIGHT, _ZERO),
]
_MARK_TEXTS = [("true", {"doc_id": "user_id", "visual_id": "event_id", "raw_text": f"CASE WHEN {_KIND} = 4 THEN 'A1' ELSE ' A' END", "x0": f"{_LEFT} + {_SIDE} / 3 - 1", "y0": f"{_SIDE} / 3 - 1", "x1": f"{_LEFT} + {_SIDE} / 3 + 1", "y1": f"{_SIDE} / 3 + 1"})]
_MARKED = {"n_boxes": f"CASE WHEN {_KIND} IN (0, 1, 2, 6, 7) THEN 1 WHEN {_KIND} = 3 THEN 2 ELSE 0 END", "n_triangles": f"CASE WHEN event_id % 30 > 18 THEN 0 WHEN {_KIND} IN (4, 5, 7) THEN 1 WHEN {_KIND} = 6 THEN 2 ELSE 0 END"}


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events")
    visuals = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("visual_id"))
    return M.reference_marks(visuals, S.derived(e, _MARK_TEXTS), S.derived(e, _MARK_PATHS)).withColumnRenamed("visual_id", "event_id").drop("doc_id")


@query(f"SELECT event_id, n_boxes, n_triangles, n_boxes = 1 AS datum_ok, n_triangles = 1 AS revision_ok FROM (SELECT event_id, {', '.join(f'{e} AS {c}' for c, e in _MARKED.items())} FROM events)")
def cls13_reference_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir)


_LOCAL_SQL = [(_LOCAL[0][0], _LOCAL[0][1] | {"datum_ok": f"{_MARKED['n_boxes']} = 1", "revision_ok": f"{_MARKED['n_triangles']} = 1"})]
_HYPOTHESES = (("diameter",), ("depth",), ("surface_roughness",), ("datum_reference",), ("counterbore",), (), ("depth", "diameter"), ("zzz",))
_GUARDS = "WHEN NOT boxed THEN 'visual_geometry_invalid' WHEN NOT geometry_matches THEN 'source_reconstruction_mismatch' WHEN n_texts = 0 OR n_distinct <> n_texts OR n_known <> n_texts OR n_doubled > 0 THEN 'coverage_lineage_incomplete' WHEN NOT same_page THEN 'local_evidence_conflict'"
_TYPED = "WHEN n_overlapping > 1 THEN 'local_evidence_conflict' WHEN n_exact <> 1 THEN 'local_parse_incomplete' WHEN NOT coordinates_agree THEN 'local_evidence_conflict' WHEN source_value IS NULL THEN 'local_parse_incomplete' WHEN source_value <> candidate_value THEN 'local_evidence_conflict' WHEN projection_conflict THEN 'local_evidence_conflict'"
_RESOLVED = f"""{S.derived_sql('l', 'events', _LOCAL_SQL)}, r AS (SELECT *, CASE {_GUARDS} WHEN k IN (5, 7) THEN 'unknown_symbol_pattern' WHEN k = 6 THEN 'local_evidence_conflict' WHEN k = 4 THEN CASE WHEN n_coarse > 1 THEN 'local_evidence_conflict' ELSE 'missing_local_discriminator' END WHEN k = 3 THEN CASE WHEN revision_ok THEN 'local_evidence_conflict' WHEN datum_ok THEN 'deterministic_geometry_complete,local_projection_complete' ELSE 'local_parse_incomplete' END
  {_TYPED} ELSE 'local_projection_complete,native_symbol_explicit' END AS reasons FROM l)"""


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.derived(S.table(spark, sf_dir, "events"), _LOCAL)
    h = F.element_at(F.array(*(F.array(*(F.lit(c) for c in hs)).cast("array<string>") for hs in _HYPOTHESES)), (F.col("k") + 1).cast("int"))
    return e.withColumn("hypotheses", h).join(_marks(spark, sf_dir), "event_id")


@query(f"WITH {_RESOLVED} SELECT event_id, CASE WHEN reasons LIKE '%local_projection_complete%' THEN CASE k WHEN 0 THEN 'diameter' WHEN 1 THEN 'depth' WHEN 2 THEN 'surface_roughness' ELSE 'datum_reference' END END AS family, reasons FROM r")
def cls13_local_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _local(spark, sf_dir).select("event_id", R.resolution(F.col).alias("r")).select("event_id", "r.family", F.array_join("r.reasons", ",").alias("reasons"))


@query(f"""WITH {S.derived_sql('l', 'events', _LOCAL_SQL)}, g AS (SELECT *, CASE {_GUARDS} {_TYPED} END AS typed, CASE {_GUARDS} END AS guard FROM l)
  SELECT event_id, concat_ws(',', CASE WHEN guard IS NULL AND datum_ok AND NOT revision_ok THEN 'datum_reference' END, CASE WHEN typed IS NULL AND exact_type = 'thread' THEN 'depth' END, CASE WHEN typed IS NULL AND exact_type = 'diameter_dimension' THEN 'diameter' END, CASE WHEN guard IS NULL AND revision_ok AND NOT datum_ok THEN 'revision_marker' END, CASE WHEN typed IS NULL AND exact_type = 'roughness' THEN 'surface_roughness' END) AS families FROM g""")
def cls32_completed_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _local(spark, sf_dir).select("event_id", F.array_join(R.completed_families(F.col), ",").alias("families"))


_MIXED = (("local_projection_complete", "native_symbol_explicit"), ("local_projection_complete",), ("local_parse_incomplete",), ("visual_geometry_invalid",), ("local_parse_incomplete", "visual_geometry_invalid"), ())


def _reasons(values: tuple[tuple[str, ...], ...], key) -> "F.Column":
    return F.element_at(F.array(*(F.array(*(F.lit(c) for c in v)).cast("array<string>") for v in values)), (key % len(values) + 1).cast("int"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 THEN 'locally_resolved' WHEN event_id % 6 = 2 AND event_id % 5 = 0 AND event_id % 7 = 0 THEN 'escalate' WHEN event_id % 6 = 3 AND event_id % 5 = 0 AND event_id % 7 = 0 THEN 'block' ELSE 'contract_invalid' END AS route FROM events")
def cls14_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return S.table(spark, sf_dir, "events").select("event_id", R.route(F.when(k % 5 != 0, "depth"), k % 7 != 0, _reasons(_MIXED, k)).alias("route"))


_L, _E, _B = (("local_projection_complete", "native_symbol_explicit"), ("native_symbol_explicit", "local_projection_complete"), ()), (("local_parse_incomplete",), ("zzz",), ()), (("routing_contract_invalid",), ("visual_geometry_invalid",), ())


@query("""WITH e AS (SELECT event_id, ['locally_resolved', 'escalate', 'block'][CAST(event_id % 3 + 1 AS INT)] AS d, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN ' v' ELSE 'v' END AS v, event_id % 17 <> 0 AS sha, CAST(CASE WHEN event_id % 3 = 0 OR event_id % 29 = 0 THEN event_id % 2 ELSE 2 END AS INT) AS l, CAST(CASE WHEN event_id % 3 = 1 THEN event_id // 3 % 3 ELSE 2 END AS INT) AS s, CAST(CASE WHEN event_id % 3 = 2 THEN event_id // 3 % 3 ELSE 2 END AS INT) AS b, event_id % 19 <> 0 AS c FROM events),
  f AS (SELECT *, (l < 2)::INT + (s < 2)::INT + (b < 2)::INT = 1 AS one FROM e) SELECT event_id, sha AND CASE WHEN v = '' THEN d = 'block' AND one AND b = 0 AND c ELSE v = 'v' AND one AND CASE d WHEN 'locally_resolved' THEN l = 0 WHEN 'escalate' THEN s = 0 AND c ELSE b < 2 AND c END END AS valid FROM f""")
def chk10_routing_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    third = F.floor(k / 3) % 3
    chosen = lambda values, at: F.element_at(F.array(*(F.array(*(F.lit(c) for c in v)).cast("array<string>") for v in values)), (at + 1).cast("int"))
    sha = F.when(k % 17 == 0, "XY").otherwise(F.sha2(k.cast("string"), 256))
    local = chosen(_L, F.when((k % 3 == 0) | (k % 29 == 0), k % 2).otherwise(2))
    valid = R.decision_valid(S.pick(("locally_resolved", "escalate", "block"), k % 3), F.when(k % 11 == 0, "").when(k % 13 == 0, " v").otherwise("v"), sha, local, chosen(_E, F.when(k % 3 == 1, third).otherwise(2)), chosen(_B, F.when(k % 3 == 2, third).otherwise(2)), k % 19 != 0)
    return S.table(spark, sf_dir, "events").select("event_id", valid.alias("valid"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'legacy' WHEN 3 THEN NULL ELSE 'symbol-uncertainty-router/1' END AS router FROM events")
def chk10_router_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = S.pick(("legacy_high_recall", "shadow_uncertainty", "production_uncertainty", "zzz"), F.col("event_id") % 4)
    return S.table(spark, sf_dir, "events").select("event_id", R.router_version(mode).alias("router"))


_ASKED = [("true", {**_DOC, "visual_id": ID, "geometry": "'g' || CAST(l_partkey % 9 AS STRING)", "text": "'t' || CAST(l_orderkey % 2 AS STRING)", "reason": _case("l_partkey", "local_parse_incomplete", "local_parse_incomplete", "unknown_symbol_pattern"), "x0": _X, "y0": _Y, "x1": f"{_X} + 40", "y1": f"{_Y} + 20", "seconds": "CAST(l_quantity AS DOUBLE)"})]
_JSON = """'{"bbox":[' || CAST(x0 AS VARCHAR) || ',' || CAST(y0 AS VARCHAR) || ',' || CAST(x1 AS VARCHAR) || ',' || CAST(y1 AS VARCHAR) || '],"families":["depth"],"geometry":"' || geometry || '","page_index":' || page_index || ',"reasons":["' || reason || '"],"text_ids":["' || text || '"]}'"""
_BATCHED = f"""WITH RECURSIVE {S.derived_sql('q', 'lineitem', _ASKED)}, h AS (SELECT *, sha256({_JSON}) AS content FROM q), x AS (SELECT doc_id, page_index, content, geometry, text, reason, x0, y0, x1, y1, list_sort(list(DISTINCT visual_id)) AS ids, max(seconds) AS seconds FROM h GROUP BY ALL),
e AS (SELECT a.doc_id, a.page_index, a.content AS u, b.content AS v FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.text = b.text AND a.reason = b.reason AND a.x1 > b.x0 AND b.x1 > a.x0 AND a.y1 > b.y0 AND b.y1 > a.y0),
r AS (SELECT doc_id, page_index, u AS node, u AS reach FROM e UNION SELECT r.doc_id, r.page_index, r.node, e.v FROM r JOIN e ON e.doc_id = r.doc_id AND e.page_index = r.page_index AND e.u = r.reach), g AS (SELECT doc_id, page_index, node, min(reach) AS batch_id FROM r GROUP BY ALL),
b AS (SELECT x.doc_id, x.page_index, batch_id, reason, list_sort(list_distinct(flatten(list(ids)))) AS ids, list_sort(list(DISTINCT geometry)) AS geos, list_sort(list(DISTINCT content)) AS members, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(seconds) AS seconds FROM x JOIN g ON g.doc_id = x.doc_id AND g.page_index = x.page_index AND g.node = x.content GROUP BY ALL),
c AS (SELECT *, CASE WHEN len(members) = 1 THEN members[1] ELSE sha256(array_to_string(members, ',') || '|' || array_to_string(geos, ',')) END AS content FROM b)"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = S.derived(S.table(spark, sf_dir, "lineitem"), _ASKED)
    return R.escalation_batches(q.withColumns({"text_ids": F.array("text"), "reasons": F.array("reason"), "families": F.array(F.lit("depth"))}))


@query(f"{_BATCHED} SELECT doc_id, page_index, batch_id, array_to_string(ids, ',') AS visuals, x0, y0, x1, y1, seconds, content AS content_sha256, sha256(content || '|' || page_index || '|' || array_to_string(ids, ',')) AS lineage_sha256 FROM c")
def grp02_join20_agg31_escalation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).select("doc_id", "page_index", "batch_id", F.array_join("visual_ids", ",").alias("visuals"), "x0", "y0", "x1", "y1", "seconds", "content_sha256", "lineage_sha256")


_LIMITED = [("true", {"doc_id": "l_orderkey", "page_index": "CAST(l_linenumber % 2 AS INT)", "place": "CAST(l_linenumber AS INT)", "batch_id": ID, "seconds": "CAST(l_partkey % 24 AS DOUBLE)", "capacity": "CAST(1 + l_orderkey % 3 AS INT)"})]
_OVER = "s.n0 + 1 > 4, s.total + 1 > 8"


@query(f"""WITH RECURSIVE {S.derived_sql('q', 'lineitem', _LIMITED)}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, place, batch_id) AS n FROM q), z AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, CAST('' AS VARCHAR) AS batch_id, CAST('' AS VARCHAR) AS reasons, 0 AS c0, 0 AS c1, 0.0::DOUBLE AS s0, 0.0::DOUBLE AS s1 FROM o),
w AS (SELECT * FROM z UNION ALL SELECT doc_id, n, batch_id, reasons, CASE WHEN reasons = '' AND p = 0 THEN c0 + 1 ELSE c0 END, CASE WHEN reasons = '' AND p = 1 THEN c1 + 1 ELSE c1 END, CASE WHEN reasons = '' AND p = 0 THEN s0 + seconds ELSE s0 END, CASE WHEN reasons = '' AND p = 1 THEN s1 + seconds ELSE s1 END FROM (
  SELECT o.doc_id, o.n, o.batch_id, o.page_index AS p, o.seconds, w.c0, w.c1, w.s0, w.s1, concat_ws(',', CASE WHEN CASE WHEN o.page_index = 0 THEN c0 ELSE c1 END + 1 > 4 THEN 'primary_page_budget_exceeded' END, CASE WHEN c0 + c1 + 1 > 8 THEN 'primary_project_budget_exceeded' END, CASE WHEN CASE WHEN o.page_index = 0 THEN c0 ELSE c1 END + 1 > o.capacity THEN 'unified_page_actual_call_budget_exceeded' END,
    CASE WHEN CASE WHEN o.page_index = 0 THEN s0 ELSE s1 END + o.seconds > 45 THEN 'page_wall_budget_exceeded' END, CASE WHEN s0 + s1 + o.seconds > 90 THEN 'project_wall_budget_exceeded' END) AS reasons FROM w JOIN o ON o.doc_id = w.doc_id AND o.n = w.n + 1))
  SELECT doc_id, batch_id, reasons = '' AS admitted, reasons FROM w WHERE n > 0""")
def win10_admitted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.admitted_batches(S.derived(S.table(spark, sf_dir, "lineitem"), _LIMITED))


_KEPT = [("true", {"doc_id": "o_orderkey", "p0": "CAST(CASE WHEN o_orderkey % 11 = 0 THEN 3 ELSE 0 END AS INT)", "c0": "CAST(CASE WHEN o_orderkey % 13 = 0 THEN -1 WHEN o_orderkey % 17 = 0 THEN 5 ELSE 2 END AS INT)", "c1": "CAST(o_orderkey % 4 AS INT)", "s0": "CASE WHEN o_orderkey % 19 = 0 THEN 60e0 ELSE 10e0 END", "off": "CAST(CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS INT)", "off_s": "CASE WHEN o_orderkey % 29 = 0 THEN 0.5e0 ELSE 0e0 END", "n_retried": "CAST(CASE WHEN o_orderkey % 31 = 0 THEN 2 ELSE o_orderkey % 2 END AS INT)", "off_a": "CAST(CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS INT)"})]


@query(f"""WITH {S.derived_sql('k', 'orders', _KEPT)} SELECT doc_id, CASE WHEN p0 > 1 THEN 'pages_order' WHEN c0 < 0 THEN 'negative' WHEN off <> 0 THEN 'call_total' WHEN off_s > 0 THEN 'second_total' WHEN c0 > 4 OR c0 + c1 > 8 THEN 'call_limit' WHEN s0 > 45 OR s0 + 20 > 90 THEN 'second_limit' WHEN n_retried > 1 THEN 'retries' WHEN off_a <> 0 THEN 'actual_calls' END AS code FROM k""")
def chk11_budget_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages a document; a retry is of the second one."""
    k = S.derived(S.table(spark, sf_dir, "orders"), _KEPT)
    page = lambda p, c, a, s: F.struct(p.alias("page"), c.alias("calls"), a.alias("actual"), s.alias("seconds"))
    pages = F.array(page(F.col("p0"), F.col("c0"), F.col("c0") + F.col("off_a"), F.col("s0")), page(F.lit(1), F.col("c1"), F.col("c1") + F.col("n_retried"), F.lit(20.0)))
    code = R.budget_problem(pages, F.col("c0") + F.col("c1") + F.col("off"), F.col("s0") + 20.0 + F.col("off_s"), F.array_repeat(F.lit(1), F.col("n_retried")))
    return k.select("doc_id", code.alias("code"))


_SHA = lambda x: f"sha2({x}, 256)"
_EVENTS_SQL = f"""ev AS (SELECT l_suppkey AS doc_id, 'g' || (l_orderkey % 50) AS group_id, CAST(l_linenumber % 2 AS INT) AS attempt, [{', '.join(repr(c) for c in R.EVENT_ORDER)}][CAST(l_partkey % 21 + 1 AS INT)] AS code, sha256({ID}) AS sha, l_orderkey, l_partkey FROM lineitem)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("g"), (F.col("l_orderkey") % 50).cast("string")).alias("group_id"), (F.col("l_linenumber") % 2).cast("int").alias("attempt"), S.pick(R.EVENT_ORDER, F.col("l_partkey") % 21).alias("code"), F.sha2(F.expr(ID), 256).alias("sha"), "l_orderkey", "l_partkey")


@query(f"WITH {_EVENTS_SQL} SELECT doc_id, group_id, string_agg(sha, ',' ORDER BY attempt, l_partkey % 21, sha) AS shas FROM ev GROUP BY ALL")
def win11_attempt_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.attempt_order(_events(spark, sf_dir)).withColumn("shas", F.array_join("shas", ","))


_PAIRS = [
    ("true", {"doc_id": "o_custkey", "group_id": "CAST(o_orderkey AS STRING)", "decision_sha": "'d'", "attempt": "CAST(1 AS INT)", "code": "'provider_schema_invalid'", "request_id": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'r' END", "sha": "'f' || CAST(o_orderkey AS STRING)", "failure_sha": "CAST(NULL AS STRING)", "retry_decision": "CASE WHEN o_orderkey % 11 = 0 THEN 'not_authorized' ELSE 'authorized_schema_retry' END"}),
    ("true", {"doc_id": "o_custkey", "group_id": "CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(o_orderkey AS STRING) END", "decision_sha": "CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE 'd' END", "attempt": "CAST(CASE WHEN o_orderkey % 19 = 0 THEN 2 ELSE 1 END AS INT)", "code": "'retry_scheduled'", "request_id": "CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 9 <> 0 THEN NULL ELSE 'r' END", "sha": "'t' || CAST(o_orderkey AS STRING)", "failure_sha": "CASE WHEN o_orderkey % 23 = 0 THEN 'zzz' ELSE 'f' || CAST(o_orderkey AS STRING) END", "retry_decision": "CAST(NULL AS STRING)"}),
]


@query("SELECT o_custkey AS doc_id, 't' || o_orderkey AS sha, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 9 <> 0 AS valid FROM orders")
def win14_retry_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retry_pairs(S.derived(S.table(spark, sf_dir, "orders"), _PAIRS))


_BLOCKING = [("true", {"doc_id": "o_custkey", "sha": "'b' || CAST(o_orderkey AS STRING)", "group_id": "'g' || CAST(o_orderkey AS STRING)", "code": _case("o_orderkey", "provider_timeout", "advisor_result_missing", "cache_miss"), "schema": "CASE WHEN o_orderkey % 3 = 0 THEN 'visual-symbol-provider-failure/1' ELSE 'visual-symbol-advisor-boundary-failure/1' END", "scope": "CASE WHEN o_orderkey % 11 = 0 THEN 'roi_localized' ELSE 'project_blocking' END"})]
_STOPPED = [("true", {"doc_id": "o_custkey", "sha": "'s' || CAST(o_orderkey AS STRING)", "group_id": "CASE WHEN o_orderkey % 13 = 0 THEN 'g' || CAST(o_orderkey AS STRING) ELSE 'other' END", "stop_reason": "CASE WHEN o_orderkey % 3 = 0 THEN 'project_blocking_provider_failure' WHEN o_orderkey % 17 = 0 THEN 'zzz' ELSE 'project_blocking_advisor_boundary_failure' END", "blocking_sha": "'b' || CAST(o_orderkey AS STRING)"})]
_ENDED = [("o_orderkey % 19 <> 0", {"doc_id": "o_custkey", "group_id": "'g' || CAST(o_orderkey AS STRING)", "terminal": "o_orderkey % 23 <> 0", "own": "CASE WHEN o_orderkey % 29 = 0 THEN 'zzz' ELSE 'b' || CAST(o_orderkey AS STRING) END"})]


@query("SELECT o_custkey AS doc_id, 's' || o_orderkey AS sha, o_orderkey % 3 <> 2 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 17 <> 0) AND o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0 AS valid FROM orders")
def join29_stop_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    return R.stop_references(S.derived(o, _STOPPED), S.derived(o, _BLOCKING), S.derived(o, _ENDED).withColumn("shas", F.array("own")))


_H64 = "'" + "a1" * 32 + "'"
_DIAG = [
    (
        "true",
        {
            "event_id": "event_id",
            "body": f"""CASE event_id % 6 WHEN 0 THEN '{{"schema_version":"visual-symbol-retry-control/1","retry_reason":"schema_invalid","authorization_owner":"production_retry_coordinator","failure_event_sha256":"' || CASE WHEN event_id % 12 = 0 THEN 'x' ELSE {_H64} END || '"}}' WHEN 1 THEN '{{"schema_version":"visual-symbol-budget-control/1","budget_origin":"' || CASE WHEN event_id % 5 = 0 THEN 'zzz' ELSE 'routing_plan' END || '"}}'
  WHEN 2 THEN '{{"schema_version":"visual-symbol-scheduler-stop/1","stop_reason":"project_blocking_provider_failure","blocking_event_sha256":"' || {_H64} || '","provider_work_started":' || CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END || '}}' WHEN 3 THEN '{{"schema_version":"visual-symbol-advisor-boundary-failure/1","failure_stage":"provider_factory_failed","scope":"project_blocking","pipeline_cause_category":"processing_defect","provider_work_started":false' || CASE WHEN event_id % 5 = 0 THEN ',"more":1' ELSE '' END || '}}'
  WHEN 4 THEN '{{"schema_version":"visual-symbol-provider-failure/1","failure_category":"' || CASE WHEN event_id % 5 = 0 THEN 'timeout' ELSE 'schema' END || '","failure_stage":"provider_schema_invalid","scope":"roi_localized","origin":"sdk","http_status":null,"request_id_state":"accepted","pipeline_cause_category":null,"retry_decision":"authorized_schema_retry"}}' ELSE CASE WHEN event_id % 5 = 0 THEN '[' ELSE '{{"schema_version":"zzz"}}' END END""",
            "code": _case("event_id", "retry_scheduled", "not_started_budget_exhausted", "cancelled_after_project_failure", "provider_factory_failed", "provider_schema_invalid", "cache_miss"),
            "attempt": "CAST(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS INT)",
            "request_id": "CASE WHEN event_id % 6 = 4 AND event_id % 11 <> 0 THEN 'r' WHEN event_id % 13 = 0 THEN 'r' END",
        },
    )
]


@query(f"""WITH {S.derived_sql('d', 'events', _DIAG)} SELECT event_id, CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 12 = 0 THEN 'rule' END WHEN 1 THEN CASE WHEN event_id % 5 = 0 OR attempt <> 0 OR request_id IS NOT NULL THEN 'rule' END WHEN 2 THEN CASE WHEN event_id % 5 = 0 OR attempt <> 0 OR request_id IS NOT NULL THEN 'rule' END WHEN 3 THEN CASE WHEN event_id % 5 = 0 THEN 'fields' WHEN request_id IS NOT NULL THEN 'rule' END
  WHEN 4 THEN CASE WHEN event_id % 5 = 0 OR request_id IS NULL THEN 'rule' END ELSE CASE WHEN event_id % 5 = 0 THEN 'not_json' ELSE 'kind' END END AS code FROM d""")
def chk08_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.derived(S.table(spark, sf_dir, "events"), _DIAG)
    return d.select("event_id", R.diagnostic_problem(F.col("body"), F.col("code"), F.col("attempt"), F.col("request_id")).alias("code"))


_RECORDS = [("true", {"doc_id": "l_suppkey", "group_id": "CAST(l_orderkey AS STRING)", "member": "CAST(l_linenumber - CASE WHEN l_orderkey % 11 = 0 THEN 0 ELSE 1 END AS INT)", "visual_id": ID, "sha": ID}), ("l_orderkey % 13 = 0", {"doc_id": "l_suppkey", "group_id": "CAST(l_orderkey AS STRING)", "member": "CAST(l_linenumber - 1 AS INT)", "visual_id": ID, "sha": f"'x' || {ID}"})]


@query(f"""WITH {S.derived_sql('r', 'lineitem', _RECORDS)}, {_EVENTS_SQL}, g AS (SELECT doc_id, group_id, max(k) AS k, bool_and(member = n) AS ok, string_agg(visual_id, ',' ORDER BY member, visual_id, sha) AS ids, sha256(string_agg(sha, ',' ORDER BY member, visual_id, sha)) AS h FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, group_id ORDER BY member, visual_id, sha) - 1 AS n FROM (SELECT doc_id, group_id, visual_id, count(DISTINCT sha) AS k, min(member) AS member, min(sha) AS sha FROM r GROUP BY ALL)) GROUP BY ALL)
  SELECT doc_id, group_id, CASE WHEN k > 1 THEN 'replay_conflict' WHEN NOT ok THEN 'member_order' WHEN CAST(group_id AS BIGINT) % 5 = 0 THEN NULL WHEN CAST(group_id AS BIGINT) % 7 = 0 THEN 'group_hash' WHEN CAST(group_id AS BIGINT) % 17 = 0 THEN 'outcome_visuals' WHEN CAST(group_id AS BIGINT) % 19 = 0 THEN 'outcome_attempts' END AS code FROM g""")
def chk09_set06_decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt a group, and outcomes of most groups, some of them changed."""
    records = S.derived(S.table(spark, sf_dir, "lineitem"), _RECORDS)
    one = records.groupBy("doc_id", "group_id", "visual_id").agg(F.min("member").alias("member"), F.min("sha").alias("sha"))
    listed = F.array_sort(F.collect_list(F.struct("member", "visual_id", "sha")))
    key = F.col("group_id").cast("bigint")
    o = one.groupBy("doc_id", "group_id").agg(listed.alias("m")).where(key % 5 != 0)
    ids = F.transform("m", lambda x: x["visual_id"])
    outcomes = o.select("doc_id", "group_id", F.when(key % 7 == 0, "x").otherwise(F.sha2(F.array_join(F.transform("m", lambda x: x["sha"]), ","), 256)).alias("claimed_sha"), F.when(key % 17 == 0, F.concat(ids, F.array(F.lit("x")))).otherwise(ids).alias("visual_ids"), F.array(F.when(key % 19 == 0, "x").otherwise(F.col("group_id"))).alias("shas"))
    events = o.select("doc_id", "group_id", F.lit(1).alias("attempt"), F.lit("cache_miss").alias("code"), F.col("group_id").alias("sha"))
    return R.decision_log_problems(records, outcomes, events)


_REVISIONS = [("true", {"doc_id": "l_orderkey", "revision_id": "l_orderkey * 100 + l_linenumber", "parent_id": "CASE WHEN l_linenumber = 1 THEN NULL WHEN l_partkey % 13 = 0 THEN -1 ELSE l_orderkey * 100 + l_linenumber - 1 END", "revision": "CAST(l_linenumber + CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 0 END AS INT)", "final_at": "CAST(CASE WHEN l_orderkey % 3 = 0 THEN 4 END AS INT)"})]
_ONE = "SELECT doc_id, revision_id, any_value(parent_id) AS parent_id, min(revision) AS revision, any_value(final_at) AS final_at FROM v GROUP BY ALL"


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.derived(S.table(spark, sf_dir, "lineitem"), _REVISIONS)
    return v.groupBy("doc_id", "revision_id").agg(F.min("parent_id").alias("parent_id"), F.min("revision").alias("revision"), F.min("final_at").alias("final_at"))


@query(f"""WITH {S.derived_sql('v', 'lineitem', _REVISIONS)}, o AS (SELECT doc_id, revision_id, min(parent_id) AS parent_id, min(revision) AS revision, min(final_at) AS final_at FROM v GROUP BY ALL) SELECT a.doc_id, a.revision_id, CASE WHEN a.parent_id IS NULL AND a.revision <> 1 THEN 'first_revision' WHEN a.parent_id IS NOT NULL AND b.revision IS NULL THEN 'lost_parent' WHEN a.revision <> b.revision + 1 THEN 'revision_step' WHEN a.revision > a.final_at THEN 'after_final' END AS code
  FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id AND b.revision_id = a.parent_id""")
def win24_revision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.revision_problems(_revisions(spark, sf_dir))


@query(f"""WITH {S.derived_sql('v', 'lineitem', _REVISIONS)}, o AS (SELECT doc_id, revision_id, min(revision) AS revision, min(final_at) AS final_at FROM v GROUP BY ALL) SELECT doc_id, max(revision) AS revision, max(final_at) IS NOT NULL AS terminal FROM o WHERE final_at IS NULL OR revision <= final_at GROUP BY ALL""")
def str03_preview_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.preview_heads(_revisions(spark, sf_dir)).drop("revision_id")


# Small drawings: a square with a diagonal, or a chain, with ends that miss each other by little.
_STROKES = [("true", {"doc_id": "l_suppkey", "drawing_id": "l_orderkey", "place": "CAST(l_linenumber AS INT)", "ax": "CASE l_linenumber % 6 WHEN 0 THEN 0e0 WHEN 1 THEN 10e0 WHEN 2 THEN 10.25e0 WHEN 3 THEN 0e0 WHEN 4 THEN 0e0 ELSE 20e0 END", "ay": "CASE l_linenumber % 6 WHEN 0 THEN 0e0 WHEN 1 THEN 0.25e0 WHEN 2 THEN 10e0 WHEN 3 THEN 10.25e0 WHEN 4 THEN 0.25e0 ELSE 0e0 END", "bx": "CASE l_linenumber % 6 WHEN 0 THEN 10e0 WHEN 1 THEN 10e0 WHEN 2 THEN 0e0 WHEN 3 THEN 0e0 WHEN 4 THEN 10e0 ELSE 10e0 END", "by": "CASE l_linenumber % 6 WHEN 0 THEN 0e0 WHEN 1 THEN 10e0 WHEN 2 THEN 10e0 WHEN 3 THEN 0e0 WHEN 4 THEN 10e0 ELSE 0e0 END"})]
_ENDS = "CASE l_linenumber % 6 WHEN 0 THEN 'ab' WHEN 1 THEN 'bc' WHEN 2 THEN 'cd' WHEN 3 THEN 'ad' WHEN 4 THEN 'ac' ELSE 'be' END"


@query(f"""WITH e AS (SELECT l_suppkey AS doc_id, l_orderkey AS drawing_id, list(DISTINCT {_ENDS}) AS k FROM lineitem GROUP BY ALL) SELECT doc_id, drawing_id, CAST(list_has_all(k, ['ab', 'bc', 'ac']) AS BIGINT) + CAST(list_has_all(k, ['cd', 'ad', 'ac']) AS BIGINT) AS triangles, CAST(list_has_all(k, ['ab', 'bc', 'cd', 'ad']) AS BIGINT) AS squares FROM e""")
def grp04_drawing_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cycles(R.clustered_edges(S.derived(S.table(spark, sf_dir, "lineitem"), _STROKES)))
