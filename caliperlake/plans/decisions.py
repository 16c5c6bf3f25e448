"""Queries of the decision operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlake.functions import annotations as A
from caliperlake.functions import text as T
from caliperlake.operators import decisions as D
from caliperlake.operators import documents, ordered
from caliperlake.plans.balloons import _ID as ID
from caliperlake.plans.register import query
from caliperlake.sources import adapters as S

_CID = f"CASE WHEN l_partkey % 53 = 0 THEN 'd' || CAST(l_partkey AS STRING) ELSE 'c' || {ID} END"
_TYPE = "CASE l_orderkey % 7 WHEN 0 THEN 'linear_dimension' WHEN 1 THEN 'diameter_dimension' WHEN 2 THEN 'thread' WHEN 3 THEN 'radius' WHEN 4 THEN 'angle' WHEN 5 THEN 'general_requirement' ELSE 'composite' END"
_CAND = [
    (
        "true",
        {
            "doc_id": "l_suppkey", "row_id": ID, "candidate_id": _CID, "payload_id": f"CASE WHEN l_orderkey % 59 = 0 THEN 'other' ELSE {_CID} END", "item_type": _TYPE, "coarse": "l_partkey % 31 = 0",
            "nominal": "CASE WHEN l_partkey % 37 = 0 THEN -1e0 WHEN l_partkey % 41 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END", "feature_kind": "CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'shaft' ELSE 'hole' END",
            "thread_spec": "CASE l_partkey % 9 WHEN 0 THEN 'M08' WHEN 1 THEN 'x' WHEN 2 THEN 'M8×1.5' ELSE 'M8' END", "through": "CASE WHEN l_partkey % 15 = 0 THEN NULL ELSE l_partkey % 2 = 0 END", "thread_depth": "CASE WHEN l_partkey % 26 = 0 THEN -2e0 WHEN l_partkey % 6 = 1 THEN 3e0 END",
            "radius": "CASE WHEN l_partkey % 33 = 0 THEN NULL ELSE 4e0 END", "angle": "CAST(l_quantity * 8 AS DOUBLE)", "scope": "CASE WHEN l_orderkey % 7 = 5 AND l_partkey % 8 <> 0 THEN 'global_requirement' ELSE 'item' END", "balloon_required": "CASE WHEN l_partkey % 21 = 0 THEN NULL ELSE l_orderkey % 7 <> 5 END",
            "raw_text": "CASE WHEN l_partkey % 43 = 0 THEN ' ' ELSE 'text' END", "normalized_text": "CASE WHEN l_partkey % 47 = 0 THEN '' ELSE 'text' END", "boxed": "l_partkey % 29 <> 0", "source_truth": "l_partkey % 11 <> 0", "requires_confirmation": "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_partkey % 25 = 0 END",
            "review_code": "CASE WHEN l_orderkey % 101 = 0 THEN 'visual_projection_conflict' END", "part_shift": "CASE WHEN l_partkey % 19 = 0 THEN CAST(1 AS INT) ELSE CAST(0 AS INT) END", "part_depth": "CASE WHEN l_partkey % 14 = 0 THEN -5e0 ELSE 5e0 END", "part_flag": "l_partkey % 16 <> 0",
            "s1": f"'s' || {ID}", "s2": "CASE WHEN l_orderkey % 4 = 0 THEN 'o' || CAST(l_orderkey AS STRING) END", "s3": f"CASE WHEN l_partkey % 61 = 0 THEN 's' || {ID} END", "s4": "CASE WHEN l_partkey % 67 = 0 THEN '' END", "none": "l_partkey % 71 = 0",
        },
    )
]
_KIND = "CASE WHEN l_partkey % 23 = 0 THEN 'other' WHEN l_orderkey % 3 = 0 THEN 'native' WHEN l_orderkey % 3 = 1 THEN 'ocr' ELSE 'visual' END"
_VALUE = "CASE l_orderkey % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.5e0 + CAST(l_quantity AS DOUBLE) / 100e0 ELSE CAST(l_partkey % 104 AS DOUBLE) / 100e0 END"
_SIGNALS = [
    ("l_partkey % 17 <> 0", {"doc_id": "l_suppkey", "source": f"'s' || {ID}", "source_type": _KIND, "value": _VALUE}),
    ("l_partkey % 39 = 0", {"doc_id": "l_suppkey", "source": f"'s' || {ID}", "source_type": _KIND, "value": _VALUE}),
    ("l_orderkey % 4 = 0", {"doc_id": "l_suppkey", "source": "'o' || CAST(l_orderkey AS STRING)", "source_type": "'native'", "value": "1e0"}),
]
_E = {"doc_id": "l_suppkey", "candidate_id": _CID, "requires_confirmation": "l_partkey % 79 = 0", "review_code": "CASE WHEN l_orderkey % 89 = 0 THEN 'local_parse_failed' WHEN l_orderkey % 97 = 0 THEN 'cross_view_x' END"}
_ENTRIES = [
    ("l_partkey % 7 <> 0", {**_E, "observation_id": f"'s' || {ID}", "source_location_id": f"CASE WHEN l_partkey % 103 = 0 THEN NULL ELSE 's' || {ID} END", "disposition": "CASE WHEN l_partkey % 83 = 0 THEN 'ambiguous' ELSE 'candidate' END"}),
    ("l_orderkey % 4 = 0", {**_E, "observation_id": "'o' || CAST(l_orderkey AS STRING)", "source_location_id": "'o' || CAST(l_orderkey AS STRING)", "disposition": "'candidate'"}),
]
_DUPLICATES = [("l_partkey % 73 = 0", {"doc_id": "l_suppkey", "candidate_id": _CID})]
_COVERAGE = [("true", {"doc_id": "s_suppkey", "checked": "s_suppkey % 7 <> 0", "blocking": "CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END"})]
_INPUT = f"""{S.derived_sql('c0', 'lineitem', _CAND)}, {S.derived_sql('sig', 'lineitem', _SIGNALS)}, {S.derived_sql('ent', 'lineitem', _ENTRIES)}, {S.derived_sql('dup', 'lineitem', _DUPLICATES)}, {S.derived_sql('cov', 'supplier', _COVERAGE)},
c AS (SELECT *, CASE WHEN none THEN [] ELSE list_filter([s1, s2, s3, s4], lambda x: x IS NOT NULL) END AS ids FROM c0)"""
_THREAD_OK = "regexp_full_match(thread_spec, 'M(0|[1-9][0-9]*)(\\.[0-9]+)?(×(0|[1-9][0-9]*)(\\.[0-9]+)?)?') AND through IS NOT NULL AND coalesce(thread_depth, 0) >= 0"
_COMPLETE = f"""CASE item_type WHEN 'linear_dimension' THEN coalesce(nominal >= 0, false) WHEN 'diameter_dimension' THEN coalesce(nominal >= 0 AND feature_kind IN ('hole', 'shaft', 'cylindrical_feature'), false) WHEN 'thread' THEN {_THREAD_OK} WHEN 'radius' THEN coalesce(radius >= 0, false) WHEN 'angle' THEN angle BETWEEN 0 AND 360
  WHEN 'general_requirement' THEN scope = 'global_requirement' AND balloon_required IS NOT DISTINCT FROM false AND coalesce(proxy, false) ELSE part_shift = 0 AND {_THREAD_OK} AND part_depth >= 0 AND part_flag END"""
_DECIDED = f"""{_INPUT}, src AS (SELECT doc_id, row_id, candidate_id, unnest(list_distinct(ids)) AS source FROM c), own AS (SELECT doc_id, source, count(*) AS owners FROM src GROUP BY ALL),
told AS (SELECT doc_id, source, count(*) AS n, bool_and(source_type IN ('native', 'ocr', 'visual') AND value BETWEEN 0 AND 1) AS ok, min(value) AS least, bool_or(source_type = 'native' AND value = 1) AS proxy FROM sig GROUP BY ALL), named AS (SELECT doc_id, source_location_id AS source, candidate_id, count(*) AS named FROM ent WHERE disposition = 'candidate' GROUP BY ALL),
per AS (SELECT s.doc_id, s.row_id, bool_or(n IS NULL) AS missing, bool_or(coalesce(n > 1, false)) AS twice, bool_and(coalesce(ok, false)) AS ok, min(least) AS least, bool_or(proxy) AS proxy, bool_or(owners > 1) AS shared, bool_and(coalesce(named = 1, false)) AS assoc
  FROM src s JOIN own USING (doc_id, source) LEFT JOIN told USING (doc_id, source) LEFT JOIN named m ON m.doc_id = s.doc_id AND m.source = s.source AND m.candidate_id = s.candidate_id GROUP BY ALL),
fl AS (SELECT *, disposition = 'ambiguous' AS amb, coalesce(review_code LIKE '%local_parse%', false) AS lp, coalesce(review_code LIKE '%projection_conflict%', false) AS pc, coalesce(review_code LIKE '%cross_view%', false) AS cv, review_code IS NOT NULL AS rej FROM ent),
lk AS (SELECT c.doc_id, c.row_id, f.* EXCLUDE (doc_id) FROM c JOIN fl f ON f.doc_id = c.doc_id AND f.candidate_id = c.candidate_id UNION ALL SELECT s.doc_id, s.row_id, f.* EXCLUDE (doc_id) FROM src s JOIN fl f ON f.doc_id = s.doc_id AND (f.source_location_id = s.source OR f.observation_id = s.source)),
l AS (SELECT doc_id, row_id, bool_or(amb) AS amb, bool_or(requires_confirmation) AS conf, bool_or(lp) AS lp, bool_or(pc) AS pc, bool_or(cv) AS cv, bool_or(rej) AS rej FROM lk GROUP BY ALL),
j AS (SELECT c.*, p.* EXCLUDE (doc_id, row_id), coalesce(amb, false) AS amb, coalesce(conf, false) AS conf, coalesce(lp, false) AS lp, coalesce(pc, false) OR coalesce(c.review_code LIKE '%projection_conflict%', false) AS pc, coalesce(cv, false) AS cv, coalesce(rej, false) OR c.review_code IS NOT NULL AS rej,
  (c.doc_id, c.candidate_id) IN (SELECT (doc_id, candidate_id) FROM dup) AS copy, coalesce(checked, false) AS checked, coalesce(blocking, 0) > 0 AS blocked, count(*) OVER (PARTITION BY c.doc_id, c.candidate_id) > 1 AS several FROM c LEFT JOIN per p ON p.doc_id = c.doc_id AND p.row_id = c.row_id LEFT JOIN l ON l.doc_id = c.doc_id AND l.row_id = c.row_id LEFT JOIN cov ON cov.doc_id = c.doc_id),
k AS (SELECT *, len(ids) = 0 OR list_contains(ids, '') AS blank, NOT (len(ids) = 0 OR list_contains(ids, '')) AND len(ids) <> len(list_distinct(ids)) AS rep, coalesce(shared, false) AS sh, NOT coalesce(missing, false) AS found,
  NOT coarse AND payload_id = candidate_id AND NOT several AND ({_COMPLETE}) AND trim(raw_text) <> '' AND trim(normalized_text) <> '' AND boxed AS typed, trim(normalized_text) <> '' AND source_truth AS truth, len(ids) > 0 AND coalesce(assoc, false) AS asso, requires_confirmation IS DISTINCT FROM false OR conf AS confirm, amb OR rej OR copy AS conflict FROM j),
v AS (SELECT *, len(ids) > 0 AND found AND NOT rep AND NOT blank AND coalesce(ok, false) AND NOT coalesce(twice, false) AS sok FROM k), w AS (SELECT *, CASE WHEN NOT sok THEN NULL WHEN least >= 0.95 THEN 'high' WHEN least >= 0.70 THEN 'medium' ELSE 'low' END AS level FROM v),
d AS (SELECT doc_id, row_id, CASE WHEN NOT blank AND NOT rep AND NOT sh AND typed AND truth AND asso AND checked AND NOT blocked AND NOT conflict AND NOT confirm AND balloon_required IS NOT NULL THEN coalesce(level, 'low') ELSE 'low' END AS band,
  concat_ws(',', CASE WHEN typed THEN 'typed_schema_complete' ELSE 'typed_schema_incomplete' END, CASE WHEN NOT coarse AND item_type = 'diameter_dimension' AND feature_kind IS NULL THEN 'feature_kind_unknown' END, CASE WHEN coarse THEN 'coarse_fallback' END, CASE WHEN lp THEN 'local_projection_failed' END,
    CASE WHEN truth THEN 'source_truth_preserved' ELSE 'normalized_value_invalid' END, CASE WHEN NOT blank AND NOT rep AND NOT sh THEN 'single_source_owner' END, CASE WHEN blank THEN 'source_location_missing' END, CASE WHEN rep OR sh OR coalesce(twice, false) THEN 'source_owner_conflict' END,
    CASE WHEN asso THEN 'local_association_complete' ELSE 'local_association_missing' END, CASE WHEN checked AND NOT blocked THEN 'coverage_clear' END, CASE WHEN NOT checked THEN 'coverage_unchecked' END, CASE WHEN blocked THEN 'coverage_blocking' END, CASE WHEN amb THEN 'ambiguous_source' END, CASE WHEN NOT conflict THEN 'no_conflict' END,
    CASE WHEN copy THEN 'possible_duplicate' END, CASE WHEN cv OR copy THEN 'cross_view_conflict' END, CASE WHEN pc THEN 'projection_conflict' END, CASE WHEN rej THEN 'provider_schema_rejected' END, CASE WHEN confirm THEN 'semantic_confirmation_required' ELSE 'semantic_confirmation_clear' END,
    CASE WHEN balloon_required IS NULL THEN 'balloon_requirement_unknown' ELSE 'balloon_requirement_known' END, CASE WHEN sok THEN 'source_signal_valid' WHEN NOT found THEN 'source_signal_missing' ELSE 'source_signal_invalid' END, 'source_signal_' || level) AS codes FROM w)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.derived(S.table(spark, sf_dir, "lineitem"), _CAND)
    none, lit = F.lit(None), F.lit
    part = lambda order, kind, value=None, flag=None: F.struct(
        (order + F.col("part_shift") if order else lit(0)).alias("order"), lit(kind).alias("kind"), none.cast("double").alias("nominal"), none.cast("string").alias("feature_kind"), (F.col("thread_spec") if not order else none.cast("string")).alias("thread_spec"), (F.col("through") if not order else none.cast("boolean")).alias("through"),
        (F.col("thread_depth") if not order else none.cast("double")).alias("thread_depth"), (none if value is None else value).cast("double").alias("value"), (none if flag is None else flag).cast("boolean").alias("flag"),
    )
    ids = F.when(F.col("none"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array("s1", "s2", "s3", "s4")))
    return c.withColumns({"source_ids": ids, "parts": F.array(part(0, "thread"), part(1, "depth", F.col("part_depth")), part(2, "through", None, F.col("part_flag")))})


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return D.confidence_decisions(_candidates(spark, sf_dir), S.derived(li, _ENTRIES), S.derived(li, _DUPLICATES), S.derived(li, _SIGNALS), S.derived(S.table(spark, sf_dir, "supplier"), _COVERAGE))


@query(f"WITH {_DECIDED} SELECT doc_id, row_id, band, CASE WHEN band = 'high' THEN 'auto_accepted' ELSE 'review_required' END AS review_disposition, codes FROM d")
def cls09_cls30_join09_confidence_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("doc_id", "row_id", "band", "review_disposition", F.array_join("evidence_codes", ",").alias("codes"))


@query(f"WITH {_INPUT}, told AS (SELECT doc_id, source, bool_or(source_type = 'native' AND value = 1) AS proxy FROM sig GROUP BY ALL) SELECT doc_id, row_id, {_COMPLETE} AS complete FROM c LEFT JOIN told USING (doc_id) WHERE told.source IS NULL OR told.source = s1 UNION ALL SELECT doc_id, row_id, {_COMPLETE.replace('coalesce(proxy, false)', 'false')} FROM c WHERE (doc_id, s1) NOT IN (SELECT (doc_id, source) FROM told)")
def cls08_complete_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the first source's own signal as the proxy."""
    told = S.derived(S.table(spark, sf_dir, "lineitem"), _SIGNALS).groupBy("doc_id", F.col("source").alias("s1")).agg(F.bool_or((F.col("source_type") == "native") & (F.col("value") == 1)).alias("proxy"))
    c = _candidates(spark, sf_dir).join(told, ["doc_id", "s1"], "left")
    return c.select("doc_id", "row_id", D.semantics_complete(F.col("item_type"), F.col, F.col("parts"), F.coalesce("proxy", F.lit(False))).alias("complete"))


@query("""WITH e AS (SELECT event_id, ['native', 'ocr', 'visual'][CAST(event_id % 3 + 1 AS INT)] AS t, event_id % 4 = 0 AS x, CAST(round(value * 100) AS BIGINT) % 13000 / 100.0 - 5 AS raw FROM events)
  SELECT event_id, CASE WHEN t = 'native' THEN CASE WHEN x THEN 1 ELSE 0 END WHEN t = 'ocr' THEN CASE WHEN raw BETWEEN 0 AND 100 THEN CAST(round(raw * 10000) AS BIGINT) / 1000000.0 END WHEN raw BETWEEN 0 AND 1 THEN CAST(round(raw * 10000) AS BIGINT) / 10000.0 END AS signal FROM e""")
def dec04_signal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events")
    raw = F.round(F.col("value") * 100).cast("bigint") % 13000 / 100 - 5
    kind = S.pick(("native", "ocr", "visual"), F.col("event_id") % 3)
    return e.select("event_id", D.signal_value(kind, F.col("event_id") % 4 == 0, raw).cast("double").alias("signal"))


_LISTS = (("typed_schema_complete", "no_conflict"), ("no_conflict", "typed_schema_complete"), ("no_conflict", "no_conflict"), ("no_conflict", "zzz"), ())
_STORED = [("true", {"event_id": "event_id", "band": "CASE event_id % 11 WHEN 0 THEN 'huge' WHEN 1 THEN NULL WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END", "disposition": "CASE WHEN event_id % 11 = 2 AND event_id % 3 <> 0 THEN 'auto_accepted' WHEN event_id % 17 = 0 THEN NULL ELSE 'review_required' END", "version": "CASE WHEN event_id % 13 = 0 THEN 'old' ELSE 'candidate-confidence/1' END", "kind": "event_id % 9"})]


@query(f"""WITH {S.derived_sql('s', 'events', _STORED)} SELECT event_id, CASE WHEN coalesce(band, 'huge') = 'huge' THEN 'band' WHEN disposition IS DISTINCT FROM CASE WHEN band = 'high' THEN 'auto_accepted' ELSE 'review_required' END THEN 'review_disposition' WHEN version = 'old' THEN 'policy_version'
  WHEN kind IN (4, 5) THEN 'evidence_missing' WHEN kind = 2 THEN 'evidence_repeated' WHEN kind = 3 THEN 'evidence_unknown' WHEN kind = 1 THEN 'evidence_order' END AS code FROM s""")
def cls10_stored_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.derived(S.table(spark, sf_dir, "events"), _STORED)
    codes = F.array(*(F.lit(c) for c in _LISTS[0]))
    for k, listed in enumerate(_LISTS[1:], 1):
        codes = F.when(F.col("kind") == k, F.array(*(F.lit(c) for c in listed)).cast("array<string>")).otherwise(codes)
    codes = F.when(F.col("kind") != 5, codes)
    return s.select("event_id", D.decision_problem(F.col("band"), F.col("disposition"), F.col("version"), codes).alias("code"))


_KINDS = (("diameter",), ("depth", "diameter"), ("datum_reference",), ("revision_marker",), ("gdt_flatness",), (), ("diameter", "depth"))
_VISUAL = [("true", {"event_id": "event_id", "disposition": "CASE event_id % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'reference_context' WHEN 2 THEN 'non_inspection' WHEN 3 THEN 'ambiguous' ELSE 'other' END", "candidate": "CASE WHEN event_id % 5 = 0 AND event_id % 8 <> 0 THEN 'c' WHEN event_id % 19 = 0 THEN 'c' END", "confirm": "event_id % 5 IN (2, 3) OR event_id % 23 = 0", "k": "event_id % 7", "code": "CASE WHEN event_id % 5 = 3 THEN CASE event_id % 4 WHEN 0 THEN 'gdt_value_missing' WHEN 1 THEN 'visual_no_detection' WHEN 2 THEN 'visual_bbox_invalid' ELSE 'zzz' END WHEN event_id % 29 = 0 THEN 'visual_bbox_invalid' END", "signal": "CASE WHEN event_id % 3 = 0 THEN 0.9e0 END", "local": "event_id % 6 = 1"})]


@query(f"""WITH {S.derived_sql('v', 'events', _VISUAL)} SELECT event_id, coalesce(CASE disposition WHEN 'candidate' THEN candidate IS NOT NULL AND code IS NULL AND (signal IS NOT NULL OR local) AND k IN (0, 1, 4) WHEN 'reference_context' THEN candidate IS NULL AND NOT confirm AND code IS NULL AND (signal IS NOT NULL OR local) AND k = 2
  WHEN 'non_inspection' THEN candidate IS NULL AND confirm AND code IS NULL AND (signal IS NOT NULL OR local) AND k = 3 WHEN 'ambiguous' THEN candidate IS NULL AND confirm AND NOT local AND ((code = 'gdt_value_missing' AND k = 4) OR code = 'visual_bbox_invalid' OR (code = 'visual_no_detection' AND k = 5)) END, false) AS valid FROM v""")
def cls11_visual_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.derived(S.table(spark, sf_dir, "events"), _VISUAL)
    kinds = F.element_at(F.array(*(F.array(*(F.lit(c) for c in ks)).cast("array<string>") for ks in _KINDS)), (F.col("k") + 1).cast("int"))
    return v.select("event_id", D.visual_coverage_valid(*(F.col(c) for c in ("disposition", "candidate", "confirm")), kinds, *(F.col(c) for c in ("code", "signal", "local"))).alias("valid"))


_REASONS = (("local_projection_complete", "native_symbol_explicit"), ("deterministic_geometry_complete", "local_projection_complete"), ("local_projection_complete",), ("native_symbol_explicit", "local_projection_complete"), ("local_projection_complete", "zzz"), ())
_JSON = """'{"block_reason_codes":[],"disposition":"locally_resolved","escalation_group_id":null,"escalation_group_member_index":null,"escalation_reason_codes":[],"input_sha256":"' || i || '","local_resolution_reason_codes":' || r || ',"local_resolution_ref":"sha256:' || i || '","requires_confirmation":' || c || ',"router_version":"' || rv || '","schema_version":"symbol-routing-decision/1","visual_observation_id":"v' || event_id || '"}'"""


@query(f"""WITH e AS (SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS i, event_id % 6 AS k, event_id % 2 = 0 AS confirm, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS c, CASE WHEN event_id % 31 = 0 THEN 'old' ELSE 'symbol-uncertainty-router/1' END AS rv,
    {S.pick_sql(tuple('[' + ','.join(f'"{x}"' for x in rs) + ']' for rs in _REASONS), 'event_id % 6')} AS r FROM events), d AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'XY' WHEN event_id % 13 = 0 THEN i ELSE sha256({_JSON}) END AS decision FROM e)
  SELECT event_id, decision, rv <> 'old' AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND k IN (0, 1) AS valid FROM d""")
def cls12_local_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = S.table(spark, sf_dir, "events").select("event_id", F.sha2(k.cast("string"), 256).alias("i"), (k % 2 == 0).alias("confirm"), F.when(k % 31 == 0, "old").otherwise(D.ROUTER).alias("router"), F.concat(F.lit("v"), k.cast("string")).alias("observation"), F.lit(D.ROUTING_SCHEMA).alias("schema"))
    reasons = F.element_at(F.array(*(F.array(*(F.lit(c) for c in rs)).cast("array<string>") for rs in _REASONS)), (k % 6 + 1).cast("int"))
    e = e.withColumn("reasons", reasons)
    args = [F.col(c) for c in ("observation", "i")], [F.col(c) for c in ("reasons", "confirm", "schema", "router")]
    e = e.withColumn("decision", F.when(k % 11 == 0, "XY").when(k % 13 == 0, F.col("i")).otherwise(D.local_decision_sha(*args[0], *args[1])))
    return e.select("event_id", "decision", D.local_evidence_valid(*args[0], F.col("decision"), *args[1]).alias("valid"))


# Sample texts beside title blocks and modifiers.
_MORE = ("⌖ 0.1", "Ra 3.2", "焊缝", "note", "Φ12深5", "CONFIDENTIAL")


@query(f"""WITH {S.TITLE_SQL}, {S.MODIFIER_SQL}, t AS (SELECT 't' || observation_id AS id, trim(raw_text) AS text, doc_id, page_index, round_even(cx / 0.05, 0) AS gx, round_even(cy / 0.05, 0) AS gy, cx, cy FROM texts UNION ALL
  SELECT 'p' || p_partkey, {S.pick_sql(_MORE, 'p_partkey % 6')}, p_partkey % 50, CAST(p_partkey % 3 AS INT), 1, 1, 0.5, 0.5 FROM part), g AS (SELECT doc_id, text, gx, gy FROM t GROUP BY ALL HAVING count(DISTINCT page_index) > 1), u AS (SELECT t.*, g.text IS NOT NULL AS rep FROM t LEFT JOIN g USING (doc_id, text, gx, gy))
  SELECT id, CASE WHEN text IN ('设计', '1:10', '2 : 15', 'A-A', 'B - B') THEN 'decided' WHEN text = '12' AND (cy <= 0.02 OR cy >= 0.98 OR (cx >= 0.65 AND cy >= 0.82)) THEN 'decided' WHEN text IN ('12', '25±0.1', 'Φ12深5') THEN 'parsed' WHEN text = 'II' THEN 'decided' WHEN text IN ('Ra 3.2', '焊缝') THEN 'coarse' WHEN text = '⌖ 0.1' THEN 'tolerance_unknown' WHEN rep THEN 'decided' ELSE 'uncovered' END AS kind,
    CASE WHEN text = '12' AND NOT (cy <= 0.02 OR cy >= 0.98 OR (cx >= 0.65 AND cy >= 0.82)) THEN 'linear_dimension' WHEN text = '25±0.1' THEN 'linear_dimension' WHEN text = 'Φ12深5' THEN 'diameter_dimension' WHEN text = 'Ra 3.2' THEN 'roughness' WHEN text = '焊缝' THEN 'weld' WHEN text = '⌖ 0.1' THEN 'geometric_tolerance' END AS item_type FROM u""")
def cls07_assembled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = lambda c: F.bround(F.col(c) / 0.05)
    titles = S.title_texts(spark, sf_dir).select(F.concat(F.lit("t"), F.col("observation_id").cast("string")).alias("id"), F.trim("raw_text").alias("text"), "doc_id", "page_index", grid("cx").alias("gx"), grid("cy").alias("gy"), "cx", "cy")
    key = F.col("p_partkey")
    parts = S.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), key.cast("string")).alias("id"), S.pick(_MORE, key % 6).alias("text"), (key % 50).alias("doc_id"), (key % 3).cast("int").alias("page_index"), F.lit(1.0).alias("gx"), F.lit(1.0).alias("gy"), F.lit(0.5).alias("cx"), F.lit(0.5).alias("cy"))
    df = titles.unionByName(parts)
    repeated = documents.repeated_overlays(df, "text", "gx", "gy").select(F.col("id").alias("_id"))
    df = df.join(repeated, F.col("id") == F.col("_id"), "left")
    decide = lambda rep: documents.primary_disposition(F.col("text"), F.col("cx"), F.col("cy"), repeated=rep)
    df = A.parsed(df, "text").withColumns({"first": decide(F.lit(False)), "second": decide(F.col("_id").isNotNull())})
    made = D.assembled(F.col("first"), F.lit(False), F.col("item_type"), A.coarse_type(F.col("text")), F.col("text"), F.col("second"))
    return df.select("id", made.alias("m")).select("id", "m.*")


_ROUTED = [("true", {"doc_id": "l_suppkey", "candidate_id": f"'c' || {ID}", "source": f"'s' || {ID}", "coarse_type": "CASE WHEN l_partkey % 9 = 0 THEN 'roughness' WHEN l_partkey % 9 = 1 THEN 'other' END", "item_type": f"CASE WHEN l_partkey % 9 > 1 THEN {_TYPE} END", "requires_confirmation": "l_partkey % 8 = 0", "recognised": "l_partkey % 5 = 0"})]
_OPEN = [("true", {"doc_id": "l_suppkey", "observation_id": f"CASE WHEN l_partkey % 3 = 0 THEN 's' ELSE 'x' END || {ID}", "disposition": "CASE WHEN l_partkey % 20 = 0 THEN 'candidate' ELSE 'ambiguous' END"})]


@query(f"""WITH {S.derived_sql('c', 'lineitem', _ROUTED)}, {S.derived_sql('e', 'lineitem', _OPEN)}, r AS (SELECT doc_id, candidate_id AS subject, CASE WHEN coarse_type = 'roughness' THEN 'coarse_type' WHEN item_type = 'composite' THEN 'composite' WHEN requires_confirmation THEN 'confirmation' WHEN recognised THEN 'ocr_source' END AS reason, CASE WHEN coarse_type = 'roughness' THEN coarse_type WHEN item_type = 'composite' OR requires_confirmation THEN item_type ELSE coalesce(coarse_type, item_type) END AS expected_type FROM c)
  SELECT * FROM r WHERE reason IS NOT NULL UNION ALL SELECT doc_id, observation_id, 'parser_failed', NULL FROM e WHERE disposition = 'ambiguous' AND (doc_id, observation_id) NOT IN (SELECT (doc_id, source) FROM c)""")
def cls18_review_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return D.review_routes(S.derived(li, _ROUTED).withColumn("source_ids", F.array("source")), S.derived(li, _OPEN))


_SUGGESTED = [("true", {"event_id": "event_id", "route_text": "'Φ12 深5'", "text": "CASE event_id % 4 WHEN 0 THEN 'Φ12  深5' WHEN 1 THEN 'ø12 深5' WHEN 2 THEN 'Φ12 深5 ' ELSE 'Φ13' END", "expected": "CASE WHEN event_id % 3 = 0 THEN 'thread' END", "item_type": "CASE event_id % 5 WHEN 0 THEN 'thread' WHEN 1 THEN 'zzz' WHEN 2 THEN NULL ELSE 'radius' END", "must_confirm": "event_id % 2 = 0", "confirm": "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END"})]


@query(f"""WITH {S.derived_sql('s', 'events', _SUGGESTED)} SELECT event_id, CASE WHEN text = 'Φ13' THEN 'raw_text_mismatch' WHEN item_type IS NULL OR item_type = 'zzz' THEN 'unknown_type' WHEN expected IS NOT NULL AND item_type <> expected THEN 'type_mismatch' WHEN must_confirm AND confirm IS NOT DISTINCT FROM false THEN 'confirmation_downgrade' END AS code FROM s""")
def cls33_suggestion_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.derived(S.table(spark, sf_dir, "events"), _SUGGESTED)
    return s.select("event_id", D.suggestion_problem(T.normalised(F.col("route_text")), F.col("expected"), F.col("must_confirm"), T.normalised(F.col("text")), F.col("item_type"), F.col("confirm")).alias("code"))


_LISTED = [
    (
        "true",
        {
            "event_id": "event_id", "active": "event_id % 9 <> 0", "status": "CASE event_id % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'pending' ELSE 'auto_accepted' END", "requires_confirmation": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 7 = 1 END", "acceptance_source": "CASE WHEN event_id % 5 <> 0 THEN 'confidence_policy' END",
            "band": "CASE WHEN event_id % 11 = 0 THEN 'low' ELSE 'high' END", "review_disposition": "'auto_accepted'", "policy_version": "CASE WHEN event_id % 13 = 0 THEN 'old' ELSE 'candidate-confidence/1' END", "sheet_confirmed": "event_id % 6 = 0", "balloon_required": "CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 8 > 2 END",
            "placement_status": "CASE WHEN event_id % 17 = 0 THEN 'manual_required' WHEN event_id % 17 < 9 THEN 'placed' END", "n_flags": "CASE WHEN event_id % 17 < 3 THEN 1 WHEN event_id % 17 < 9 THEN 0 END",
        },
    )
]
_AUTO = "(active AND status = 'auto_accepted' AND requires_confirmation IS NOT DISTINCT FROM false AND acceptance_source IS NOT NULL AND band = 'high' AND policy_version <> 'old')"
_PENDING = f"(active AND NOT coalesce(requires_confirmation, false) AND (status = 'kept' OR sheet_confirmed OR {_AUTO}) AND balloon_required IS NULL)"


@query(f"""WITH {S.derived_sql('i', 'events', _LISTED)} SELECT event_id, CASE WHEN NOT active THEN 'excluded' WHEN placement_status = 'manual_required' THEN 'manual' WHEN n_flags > 0 THEN 'collision' WHEN coalesce(requires_confirmation, false) OR status = 'pending' OR {_PENDING} THEN 'pending' WHEN {_AUTO} THEN 'auto_accepted' WHEN status = 'kept' OR sheet_confirmed THEN 'confirmed' ELSE 'pending' END AS status,
  concat_ws(',', 'all', CASE WHEN active THEN 'active' ELSE 'excluded' END, CASE WHEN {_AUTO} THEN 'auto_accepted' END, CASE WHEN active AND (coalesce(requires_confirmation, false) OR {_PENDING} OR (NOT {_AUTO} AND status <> 'kept')) THEN 'review_required' END, CASE WHEN placement_status = 'manual_required' THEN 'manual_required' END, CASE WHEN n_flags > 0 THEN 'hard_collision' END) AS views FROM i""")
def cls20_cls27_item_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = S.derived(S.table(spark, sf_dir, "events"), _LISTED)
    return i.select("event_id", D.item_status(F.col).alias("status"), F.array_join(D.list_views(F.col), ",").alias("views"))


_DEFAULTS = [("true", {"doc_id": "l_suppkey", "entry_id": ID, "source_location_id": "CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 's' || CAST(l_partkey AS STRING) END", "candidate_id": "CASE WHEN l_partkey % 4 = 0 THEN 'c' END", "requires_confirmation": "l_linenumber % 3 <> 0", "disposition": "CASE WHEN l_partkey % 5 = 0 THEN 'candidate' ELSE 'ambiguous' END", "failure_stage": "CASE WHEN l_linenumber = 2 THEN 'provider_timeout' WHEN l_linenumber = 4 THEN 'other' END"})]
_THEIRS = [("l_partkey % 9 = 2", {"doc_id": "l_suppkey", "source_location_id": "'s' || CAST(l_partkey AS STRING)"})]


@query(f"""WITH {S.derived_sql('e', 'lineitem', _DEFAULTS)}, {S.derived_sql('q', 'lineitem', _THEIRS)}, d AS (SELECT *, requires_confirmation AND candidate_id IS NULL AND trim(coalesce(source_location_id, '')) <> '' AND NOT (failure_stage IS NOT DISTINCT FROM 'provider_timeout' AND disposition = 'ambiguous') AND (doc_id, source_location_id) NOT IN (SELECT (doc_id, source_location_id) FROM q) AS dflt FROM e)
  SELECT doc_id, entry_id, CASE WHEN dflt THEN 'non_inspection' ELSE disposition END AS disposition, requires_confirmation AND NOT dflt AS requires_confirmation, CASE WHEN dflt THEN 'system_default' END AS resolution_source FROM d""")
def cls24_default_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return D.default_dispositions(S.derived(li, _DEFAULTS), S.derived(li, _THEIRS))
