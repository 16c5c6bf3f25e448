"""Queries of the release operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlake.operators import ledger, logs, ordered
from caliperlake.operators import releases as R
from caliperlake.plans.balloons import _ID as ID
from caliperlake.plans.inspection import _MICRO
from caliperlake.plans.register import query
from caliperlake.sources import adapters as S


def _case(key: str, *values: str | None) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {'NULL' if v is None else repr(v)}" for k, v in enumerate(values)) + " END"


_STATUS = [
    (
        "true",
        {
            "doc_id": "o_orderkey", "working": "o_orderkey % 4 = 0", "completeness": _case("o_custkey", "complete", "partial_review_required"), "state": _case("o_orderkey * 5", "processing", "processing_failed", "editing", "unsupported_input", "processing", "processing", "processing"),
            "job_status": _case("o_orderkey * 3", "pending", "processing", "succeeded", "failed", None, "other"), "job_stage": _case("o_custkey", "coverage", "candidate_advisor"), "error_code": f"CASE WHEN o_orderkey % 5 = 1 THEN {_case('o_custkey', 'redis_unavailable', 'coverage_blocking', 'zzz')} END",
            "error_cause": f"CASE WHEN o_orderkey % 5 = 1 THEN {_case('o_orderkey', 'transient_provider_failure', 'processing_defect', None)} END",
        },
    )
]


@query(f"""WITH {S.derived_sql('d', 'orders', _STATUS)}, p AS (SELECT *, NOT working AND error_code IS NOT NULL AS err, NOT working AND error_code IS NULL AND (state IN ('processing_failed', 'unsupported_input') OR job_status IN ('failed', 'other')) AS gen FROM d)
  SELECT doc_id, CASE WHEN working AND completeness = 'complete' THEN 'ready_for_review' WHEN working THEN 'partial_review_required' WHEN err OR gen THEN 'failed' WHEN job_status IS NULL THEN 'queued' ELSE 'processing' END AS phase, CASE WHEN working OR err OR gen THEN NULL WHEN job_status IS NULL THEN 'queued' ELSE job_stage END AS stage, working AS workbench_ready,
    err AND coalesce(error_cause = 'transient_provider_failure', false) AS retryable, CASE WHEN gen OR (err AND error_code = 'zzz') THEN 'project_processing_failed' WHEN err THEN error_code END AS error_code, CASE WHEN gen OR (err AND error_code = 'zzz') THEN 'processing' WHEN err AND error_code = 'redis_unavailable' THEN 'preflight' WHEN err THEN 'coverage' END AS error_stage FROM p""")
def cls21_project_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.derived(S.table(spark, sf_dir, "orders"), _STATUS).select("doc_id", R.document_status().alias("s")).select("doc_id", "s.*")


_META = [("true", {"doc_id": "c_custkey", "material_code": "CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE 'M1' END", "material_name": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'n' END", "drawing_number": "'d'", "material": "CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN ' none ' ELSE ' Q235' END", "revision": "'A'"})]
_SHEET = [
    (
        "true",
        {
            "doc_id": "o_custkey", "item_id": "o_orderkey", "active": "o_orderkey % 3 <> 0", "requires_confirmation": "o_orderkey % 37 = 0", "balloon_required": "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE true END", "detail_confirmed": "o_orderkey % 43 <> 0", "n_exceptions": "CASE WHEN o_orderkey % 47 = 0 THEN 1 ELSE 0 END",
            "source_page": "CASE WHEN o_orderkey % 53 = 0 THEN 0 ELSE 1 END", "inspection_item": "CASE WHEN o_orderkey % 59 = 0 THEN '' ELSE 'x' END", "inspection_standard": "'s'", "inspection_method": "CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE 'm' END", "key_dimension": "'k'", "inspection_role": "'r'",
        },
    )
]
_COVERED = [("true", {"doc_id": "o_custkey", "valid": "o_orderkey % 67 <> 0", "requires_confirmation": "o_orderkey % 71 = 0"})]
_SHEET_SQL = f"""{S.derived_sql('m', 'customer', _META)}, {S.derived_sql('i', 'orders', _SHEET)}, {S.derived_sql('e', 'orders', _COVERED)},
sh AS (SELECT m.doc_id, concat_ws(',', CASE WHEN m.material IS NULL OR trim(coalesce(material_code, '')) = '' OR material_name IS NULL THEN 'sip_metadata_unconfirmed' END, CASE WHEN coalesce(o, false) THEN 'sip_detail_fields_unconfirmed' END) AS blockers FROM m LEFT JOIN (SELECT doc_id, bool_or(NOT detail_confirmed OR n_exceptions > 0 OR source_page < 1 OR inspection_item = '' OR inspection_method IS NULL) AS o FROM i WHERE active GROUP BY ALL) x ON x.doc_id = m.doc_id)"""


def _sheet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    metadata, items = S.derived(S.table(spark, sf_dir, "customer"), _META), S.derived(S.table(spark, sf_dir, "orders"), _SHEET)
    return R.sheet_blockers(metadata, items), items


@query(f"WITH {_SHEET_SQL} SELECT * FROM sh")
def cls23_sheet_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sheet(spark, sf_dir)[0]


@query(f"""WITH {_SHEET_SQL}, a AS (SELECT doc_id, bool_or(requires_confirmation) AS r, bool_or(balloon_required IS NULL) AS b FROM i WHERE active GROUP BY ALL), c AS (SELECT doc_id, bool_or(NOT valid) AS bad, bool_or(requires_confirmation) AS r FROM e GROUP BY ALL)
  SELECT m.doc_id, concat_ws(',', CASE WHEN m.doc_id % 13 = 0 OR coalesce(c.bad, false) THEN 'coverage_blocking' END, CASE WHEN coalesce(a.r, false) OR (coalesce(c.r, false) AND NOT coalesce(c.bad, false)) OR sh.blockers <> '' THEN 'unresolved_confirmation' END, CASE WHEN coalesce(a.b, false) THEN 'balloon_required_unconfirmed' END) AS blockers
  FROM m JOIN sh ON sh.doc_id = m.doc_id LEFT JOIN a ON a.doc_id = m.doc_id LEFT JOIN c ON c.doc_id = m.doc_id""")
def cls22_freeze_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet, items = _sheet(spark, sf_dir)
    coverage = sheet.select("doc_id", F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0).alias("blocking"))
    return R.freeze_blockers(items, S.derived(S.table(spark, sf_dir, "orders"), _COVERED), coverage, sheet)


_ACCESSED = [("true", {"o_orderkey": "o_orderkey", "status": _case("o_orderkey", "unlisted", "active", "reprocessing", "reprocess_failed", "superseded", "deleted"), "kind": _case("o_custkey", "active", "processing_read", "status_read")})]


@query(f"WITH {S.derived_sql('r', 'orders', _ACCESSED)} SELECT * FROM r WHERE status IN ('active', 'unlisted') OR (status = 'reprocessing' AND kind <> 'active') OR (status = 'reprocess_failed' AND kind = 'status_read')")
def cls34_allowed_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = S.fixed_rows(spark, list(R.ACCESS), "status string, kind string")
    return S.derived(S.table(spark, sf_dir, "orders"), _ACCESSED).join(F.broadcast(rules), ["status", "kind"], "left_semi").select("o_orderkey", "status", "kind")


_LOG = [("true", {"user_id": "user_id", "event_id": "event_id", "state": _case("(event_id * 7 + user_id)", *R.STATES)})]


@query(f"""WITH {S.derived_sql('l', 'events', _LOG)}, s AS (SELECT user_id, event_id, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS a, state AS b FROM l) SELECT user_id, event_id, a AS from_state, b AS to_state FROM s WHERE a IS NOT NULL AND NOT ((a = 'processing' AND b IN ('ready_for_edit', 'processing_failed', 'unsupported_input'))
  OR (a = 'ready_for_edit' AND b = 'editing') OR (a = 'editing' AND b = 'reviewed') OR (a = 'reviewed' AND b = 'exporting') OR (a = 'exporting' AND b IN ('export_succeeded', 'export_failed')) OR (a = 'export_failed' AND b = 'exporting'))""")
def evt02_invalid_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = S.fixed_rows(spark, list(R.STEPS), "from_state string, to_state string")
    return logs.invalid_transitions(S.derived(S.table(spark, sf_dir, "events"), _LOG), "user_id", ["event_id"], "state", allowed).select("user_id", "event_id", "from_state", "to_state")


_DOCS = [("true", {"doc_id": "o_orderkey", "name": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 'x.pdf' END", "lifecycle": _case("o_orderkey * 3", "active", "active", "reprocessing", "superseded", "deleted", "active", "active"), "predecessor": "CASE WHEN o_orderkey % 31 = 0 THEN o_orderkey WHEN o_orderkey % 3 = 0 THEN o_orderkey - o_orderkey % 12 + 1 END", "deleted_at": "CASE WHEN (o_orderkey * 3) % 7 = 4 AND o_orderkey % 5 <> 0 OR o_orderkey % 41 = 0 THEN 1 END"})]


@query(f"""WITH {S.derived_sql('d', 'orders', _DOCS)}, r AS (SELECT predecessor AS p, count(*) AS n FROM d WHERE lifecycle = 'reprocessing' AND predecessor IS NOT NULL GROUP BY ALL), c AS (SELECT doc_id, concat_ws(',', CASE WHEN (lifecycle = 'deleted') <> (deleted_at IS NOT NULL) THEN 'deleted_timestamp' END, CASE WHEN predecessor = doc_id THEN 'predecessor_self' END, CASE WHEN lifecycle = 'reprocessing' AND n > 1 THEN 'several_successors' END) AS codes FROM d LEFT JOIN r ON p = predecessor)
  SELECT * FROM c WHERE codes <> ''""")
def evt03_lifecycle_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lifecycle_problems(S.derived(S.table(spark, sf_dir, "orders"), _DOCS))


@query(f"""WITH {S.derived_sql('d', 'orders', _DOCS)}, o AS (SELECT l_orderkey AS doc_id, max(l_linenumber) AS t FROM lineitem GROUP BY ALL), h AS (SELECT l_orderkey AS doc_id, max(l_partkey) AS x FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), s AS (SELECT DISTINCT predecessor AS doc_id FROM d WHERE lifecycle = 'reprocessing')
  SELECT d.doc_id, o.t AS last_opened, CASE WHEN d.doc_id IN (SELECT doc_id FROM s WHERE doc_id IS NOT NULL) THEN 'reprocessing' WHEN h.x > 100 THEN 'locked' END AS refused, CAST(row_number() OVER (ORDER BY o.t DESC NULLS LAST, d.doc_id DESC) AS INT) AS position FROM d LEFT JOIN o USING (doc_id) LEFT JOIN h USING (doc_id) WHERE lifecycle = 'active' AND name IS NOT NULL""")
def evt12_srt01_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's order needs no single task: places are counted within ranges of the last opening, then added up."""
    li = S.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    live = R.catalogue_actions(S.derived(S.table(spark, sf_dir, "orders"), _DOCS), li.select("doc_id", F.col("l_linenumber").alias("ts")), li.where("l_linenumber = 1").select("doc_id", F.col("l_partkey").alias("expires_at")), F.lit(100))
    return ordered.ranked(live, "last_opened", "doc_id")


_FIRST = [("true", {"doc_id": "l_suppkey", "item_id": ID, "decided": "l_partkey % 5 <> 0", "status": "CASE WHEN l_partkey % 5 = 1 THEN 'auto_accepted' ELSE 'pending' END", "requires_confirmation": "l_partkey % 5 <> 1", "acceptance_source": "CASE WHEN l_partkey % 5 = 1 THEN 'confidence_policy' END", "active": "true", "text": "'t' || CAST(l_partkey AS STRING)", "balloon_required": "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE true END"})]


def _command(cond: str, version: int, kind: str, accepted: str = "CAST(NULL AS BOOLEAN)", text: str = "CAST(NULL AS STRING)", moved: str = "CAST(NULL AS BOOLEAN)", balloon: str = "CAST(NULL AS BOOLEAN)") -> tuple[str, dict[str, str]]:
    return cond, {"doc_id": "l_suppkey", "item_id": ID, "version": f"CAST({version} AS INT)", "expected_version": f"CAST(CASE WHEN l_orderkey % 17 = {version} THEN {version - 3} ELSE {version - 1} END AS INT)", "kind": f"'{kind}'", "accepted": accepted, "text": text, "moved": moved, "balloon": balloon}


_COMMANDS = [
    _command("l_linenumber = 1", 2, "keep"), _command("l_partkey % 4 = 0", 3, "edit", text="'first'", moved="l_partkey % 8 = 0"), _command("l_partkey % 6 = 0", 4, "set_balloon", balloon="false"), _command("l_partkey % 7 = 0", 5, "exclude"), _command("l_partkey % 12 = 0", 6, "edit", text="'second'", moved="false"),
    _command("l_partkey % 9 = 0", 7, "resolve", accepted="l_partkey % 2 = 0"), _command("l_partkey % 10 = 0", 8, "set_balloon", balloon="true"), _command("l_partkey % 11 = 0", 9, "set_fields"),
]
_REPLAYED = f"""{S.derived_sql('i', 'lineitem', _FIRST)}, {S.derived_sql('c', 'lineitem', _COMMANDS)}, f AS (SELECT *, kind = 'exclude' OR (kind = 'resolve' AND NOT coalesce(accepted, false)) AS against FROM c WHERE expected_version = version - 1),
g AS (SELECT * FROM f QUALIFY min(CASE WHEN against THEN version END) OVER (PARTITION BY item_id) IS NULL OR version <= min(CASE WHEN against THEN version END) OVER (PARTITION BY item_id)),
d AS (SELECT item_id, bool_or(kind <> 'set_fields') AS done, bool_or(against) AS out, arg_max(text, version) FILTER (kind = 'edit') AS txt, arg_max(balloon, version) FILTER (kind = 'set_balloon') AS bal, bool_or(kind = 'edit') AS edited, bool_or(kind = 'set_balloon') AS st, bool_or(against OR kind = 'set_balloon' OR (kind = 'edit' AND coalesce(moved, false))) AS stale FROM g GROUP BY ALL),
r AS (SELECT i.doc_id, i.item_id, CASE WHEN coalesce(out, false) THEN 'excluded' WHEN coalesce(done, false) THEN 'kept' ELSE status END AS status, NOT coalesce(out, false) AS active, requires_confirmation AND NOT coalesce(done, false) AS requires_confirmation, CASE WHEN coalesce(done, false) THEN CASE WHEN decided THEN 'manual_override' ELSE 'manual' END ELSE acceptance_source END AS acceptance_source,
  CASE WHEN coalesce(done, false) THEN NOT out END AS confirmation_accepted, coalesce(txt, text) AS text, CASE WHEN coalesce(edited, false) THEN 'manual' ELSE 'automatic' END AS source_type, CASE WHEN coalesce(st, false) THEN bal ELSE balloon_required END AS balloon_required, coalesce(stale, false) AS numbering_stale FROM i LEFT JOIN d USING (item_id))"""


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return R.after_commands(S.derived(li, _FIRST), S.derived(li, _COMMANDS))


@query(f"WITH {_REPLAYED} SELECT * FROM r")
def evt04_review_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir)


_MINE = [("true", {"doc_id": "l_suppkey", "entry_id": f"'e' || {ID}", "candidate_id": f"CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE {ID} END", "requires_confirmation": "l_partkey % 2 = 0"})]


@query(f"WITH {_REPLAYED}, {S.derived_sql('e', 'lineitem', _MINE)} SELECT e.doc_id, entry_id, e.requires_confirmation AND r.confirmation_accepted IS NULL AS requires_confirmation, r.confirmation_accepted FROM e LEFT JOIN r ON r.item_id = candidate_id")
def evt09_closed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.closed_entries(S.derived(S.table(spark, sf_dir, "lineitem"), _MINE), _replayed(spark, sf_dir))


_STORED = [("true", {"doc_id": "l_suppkey", "candidate_id": ID, "problem": "CASE WHEN l_partkey % 7 = 0 THEN 'band' END", "review_disposition": "CASE WHEN l_partkey % 3 = 0 THEN 'auto_accepted' WHEN l_partkey % 3 = 1 THEN 'review_required' END"})]


@query(f"WITH {S.derived_sql('c', 'lineitem', _STORED)}, g AS (SELECT *, problem IS NULL AND coalesce(review_disposition = 'auto_accepted', false) AS ok FROM c) SELECT doc_id, candidate_id AS item_id, CASE WHEN ok THEN 'auto_accepted' ELSE 'pending' END AS status, NOT ok AS requires_confirmation, CASE WHEN ok THEN 'confidence_policy' END AS acceptance_source, problem IS NULL AS decided, true AS active FROM g")
def evt07_first_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_items(S.derived(S.table(spark, sf_dir, "lineitem"), _STORED))


# Every line goes on to one or two further lines of its document of four orders, or ends; some orders go back to an earlier line.
_ROW = "(l_orderkey % 4) * 8 + l_linenumber"
_LINEAGE = [
    ("true", {"doc_id": "l_orderkey - l_orderkey % 4", "item_id": _ROW, "into_id": f"CASE WHEN l_orderkey % 37 = 5 AND l_linenumber = 6 THEN {_ROW} - 3 WHEN l_partkey % 9 = 0 THEN 100 + l_linenumber ELSE {_ROW} + 1 + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END END"}),
    ("l_partkey % 5 = 0", {"doc_id": "l_orderkey - l_orderkey % 4", "item_id": _ROW, "into_id": f"{_ROW} + 2"}),
]
_TARGETS = [("true", {"doc_id": "l_orderkey - l_orderkey % 4", "requirement_id": "l_orderkey % 4", "outcome": "CASE WHEN l_orderkey % 3 = 0 THEN 'global_scope' ELSE 'matched_items' END", "item_id": _ROW})]
_EXCLUDED = [("l_partkey % 3 = 0", {"doc_id": "l_orderkey - l_orderkey % 4", "item_id": f"{_ROW} + 1"})]
_ENDS = f"""WITH RECURSIVE {S.derived_sql('li', 'lineitem', _LINEAGE)}, e AS (SELECT DISTINCT * FROM li), w AS (SELECT * FROM e UNION SELECT w.doc_id, w.item_id, e.into_id FROM w JOIN e ON e.doc_id = w.doc_id AND e.item_id = w.into_id),
  src AS (SELECT DISTINCT doc_id, item_id FROM e), ring AS (SELECT doc_id, item_id AS into_id FROM w WHERE item_id = into_id),
  ends AS (SELECT w.doc_id, w.item_id, w.into_id, false AS cyclic FROM w ANTI JOIN src s ON s.doc_id = w.doc_id AND s.item_id = w.into_id UNION ALL SELECT DISTINCT w.doc_id, w.item_id, NULL, true FROM w JOIN ring USING (doc_id, into_id))"""


@query(f"{_ENDS} SELECT * FROM ends")
def grp06_final_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.final_items(S.derived(S.table(spark, sf_dir, "lineitem"), _LINEAGE))


@query(f"""{_ENDS}, {S.derived_sql('t', 'lineitem', _TARGETS)}, {S.derived_sql('x', 'lineitem', _EXCLUDED)}, m AS (SELECT DISTINCT t.doc_id, requirement_id, outcome, CASE WHEN cyclic IS NULL THEN t.item_id ELSE into_id END AS item_id FROM t LEFT JOIN ends USING (doc_id, item_id)),
  l AS (SELECT doc_id, requirement_id, outcome, coalesce(list_sort(list(item_id) FILTER (item_id IS NOT NULL AND (doc_id, item_id) NOT IN (SELECT (doc_id, item_id) FROM x))), []) AS ids FROM m GROUP BY ALL), z AS (SELECT *, len(ids) = 0 OR (outcome = 'global_scope' AND len(ids) <> 1) AS lost FROM l)
  SELECT doc_id, requirement_id, CASE WHEN lost THEN 'unresolved' ELSE outcome END AS outcome, CASE WHEN lost THEN '' ELSE array_to_string(ids, ',') END AS targets FROM z""")
def grp06_remapped_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    out = R.remapped_targets(S.derived(li, _TARGETS), S.derived(li, _LINEAGE), S.derived(li, _EXCLUDED))
    return out.withColumn("targets", F.array_join(F.transform("targets", lambda t: t.cast("string")), ","))


_RESULTS = [
    (
        "true",
        {
            "doc_id": "o_orderkey", "checked": "o_orderkey % 23 <> 0", "blocking": "CASE WHEN o_orderkey % 29 = 0 THEN 2 ELSE 0 END", "completeness": "CASE WHEN o_orderkey % 31 = 0 THEN 'zzz' WHEN o_orderkey % 4 = 0 THEN 'partial_review_required' ELSE 'complete' END", "mode": _case("o_custkey", "legacy_high_recall", "shadow_uncertainty", "production_uncertainty"),
            "document_mode": f"CASE WHEN o_orderkey % 37 = 0 THEN 'zzz' ELSE {_case('o_custkey', 'legacy_high_recall', 'shadow_uncertainty', 'production_uncertainty')} END", "router": "'r'", "document_router": "CASE WHEN o_orderkey % 41 = 0 THEN 'q' ELSE 'r' END", "n_candidates": "5", "n_ids": "CASE WHEN o_orderkey % 43 = 0 THEN 4 ELSE 5 END",
            "n_bad_decisions": "CASE WHEN o_orderkey % 47 = 0 THEN 1 ELSE 0 END", "n_bad_requirements": "CASE WHEN o_orderkey % 53 = 0 THEN 1 ELSE 0 END", "unresolved": "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN -1 WHEN o_orderkey % 4 = 0 THEN 3 WHEN o_orderkey % 19 = 0 THEN 2 ELSE 0 END",
            "evidence_ref": "CASE WHEN o_custkey % 3 = 2 AND o_orderkey % 17 <> 0 THEN 'symbol-routing-evidence://' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 61 = 0 THEN 'x' END",
        },
    )
]


@query(f"""WITH {S.derived_sql('r', 'orders', _RESULTS)}, q AS (SELECT *, mode <> 'legacy_high_recall' OR completeness = 'partial_review_required' OR unresolved IS NOT NULL AS routed FROM r)
  SELECT doc_id, CASE WHEN blocking > 0 OR NOT checked THEN 'coverage_blocking' WHEN completeness = 'zzz' THEN 'completeness' WHEN n_bad_decisions > 0 THEN 'confidence_decision' WHEN n_ids <> n_candidates THEN 'candidate_identity' WHEN n_bad_requirements > 0 THEN 'technical_requirements' WHEN mode <> document_mode THEN 'recognition_mode' WHEN router <> document_router THEN 'router_version'
    WHEN routed AND (unresolved IS NULL OR unresolved < 0) THEN 'recognition_summary' WHEN routed AND (completeness = 'partial_review_required') <> (unresolved > 0) THEN 'completeness_summary' WHEN evidence_ref IS DISTINCT FROM CASE WHEN mode = 'production_uncertainty' THEN 'symbol-routing-evidence://' || doc_id END THEN 'evidence_ref' END AS problem FROM q""")
def evt08_result_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.derived(S.table(spark, sf_dir, "orders"), _RESULTS)
    return r.select("doc_id", R.result_gate(r).alias("problem"))


_REVIEWED = [("true", {"doc_id": "o_orderkey", "reviewed_id": "o_orderkey * 10", "working_id": "o_orderkey + o_orderkey % 50"})]
_WORKING = [("true", {"working_id": "o_orderkey", "w_doc": "o_orderkey - o_orderkey % 7 % 2", "result_id": "o_orderkey"})]
_RES = [("o_orderkey % 19 <> 0", {"result_id": "o_orderkey", "r_doc": "CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE o_orderkey END", "file_id": "o_orderkey"})]
_FILES = [("true", {"file_id": "o_orderkey", "mime": "CASE WHEN o_orderkey % 29 = 0 THEN 'text/plain' ELSE 'application/pdf' END", "sha256": "CAST(o_custkey AS STRING)", "size": "o_custkey", "found_sha256": "CASE WHEN o_orderkey % 31 = 0 THEN 'x' ELSE CAST(o_custkey AS STRING) END", "found_size": "CASE WHEN o_orderkey % 37 = 0 THEN o_custkey + 1 ELSE o_custkey END"})]


@query(f"""WITH {S.derived_sql('v', 'orders', _REVIEWED)}, {S.derived_sql('w', 'orders', _WORKING)}, {S.derived_sql('r', 'orders', _RES)}, {S.derived_sql('f', 'orders', _FILES)}, j AS (SELECT v.doc_id, reviewed_id, f.file_id, CASE WHEN w_doc IS DISTINCT FROM v.doc_id THEN 'working_copy' WHEN r_doc IS DISTINCT FROM v.doc_id THEN 'automatic_result' WHEN mime IS DISTINCT FROM 'application/pdf' THEN 'source_file' WHEN sha256 <> found_sha256 OR size <> found_size THEN 'source_identity' END AS problem
  FROM v LEFT JOIN w USING (working_id) LEFT JOIN r USING (result_id) LEFT JOIN f USING (file_id)) SELECT doc_id, reviewed_id, CASE WHEN problem IS NULL THEN file_id END AS file_id, problem FROM j""")
def join25_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    return R.lineage_problem(*(S.derived(o, x) for x in (_REVIEWED, _WORKING, _RES, _FILES)))


_EXPORTS = [("true", {"export_id": "o_orderkey", "doc_id": "o_custkey", "reviewed_id": "o_orderkey * 10", "manifest_reviewed_id": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey * 10 END", "status": _case("o_orderkey", "success", "running", "failed")})]
_ARTIFACTS = [("true", {"export_id": "l_orderkey", "artifact_id": ID, "kind": _case("l_linenumber", "ballooned_pdf", "sip_excel", "manifest", "log"), "reviewed_id": "CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE l_orderkey * 10 END", "published_ref": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'asset://x' END"})]
_INSIDE = [("l_linenumber % 2 = 0", {"export_id": "l_orderkey", "reviewed_id": "CASE WHEN l_partkey % 19 = 0 THEN 1 ELSE l_orderkey * 10 END"})]


@query(f"""WITH {S.derived_sql('e', 'orders', _EXPORTS)}, {S.derived_sql('a', 'lineitem', _ARTIFACTS)}, {S.derived_sql('l', 'lineitem', _INSIDE)} SELECT export_id, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.export_id = e.export_id AND a.reviewed_id <> e.reviewed_id) THEN 'artifacts_differ'
  WHEN manifest_reviewed_id IS NULL OR EXISTS (SELECT 1 FROM l WHERE l.export_id = e.export_id AND l.reviewed_id <> e.reviewed_id) THEN 'manifest_differs' END AS code FROM e""")
def chk06_artifact_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return R.artifact_identity(S.derived(S.table(spark, sf_dir, "orders"), _EXPORTS), S.derived(li, _ARTIFACTS), S.derived(li, _INSIDE))


@query(f"WITH {S.derived_sql('e', 'orders', _EXPORTS)}, {S.derived_sql('a', 'lineitem', _ARTIFACTS)} SELECT a.* FROM a JOIN e USING (export_id) WHERE status = 'success' AND kind <> 'log' AND published_ref IS NOT NULL")
def join34_published_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.published(S.derived(S.table(spark, sf_dir, "orders"), _EXPORTS), S.derived(S.table(spark, sf_dir, "lineitem"), _ARTIFACTS), ("ballooned_pdf", "sip_excel", "manifest"))
    return found


_ERRORS = [("true", {"doc_id": "o_custkey", "error_id": "o_orderkey", "severity": _case("o_orderkey", "blocking", "warning"), "code": _case("o_orderkey", "coverage_blocking", "zzz", "unsupported_input")})]


@query(f"WITH {S.derived_sql('e', 'orders', _ERRORS)} SELECT doc_id, error_id, code FROM e WHERE severity = 'blocking' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY error_id DESC) = 1")
def srt05_latest_blocking_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = S.derived(S.table(spark, sf_dir, "orders"), _ERRORS).where("severity = 'blocking'")
    return ordered.latest(errors.select("doc_id", "error_id", "code"), ["doc_id"], ["error_id"])


@query(f"""WITH {S.derived_sql('m', 'customer', _META)} SELECT doc_id, CASE WHEN trim(material) = 'none' THEN '' ELSE trim(material) END AS material, material IS NOT NULL AND trim(coalesce(material_code, '')) <> '' AND material_name IS NOT NULL AS complete FROM m""")
def chk12_sheet_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sheet_metadata(S.derived(S.table(spark, sf_dir, "customer"), _META)).select("doc_id", "material", "complete")


@query("SELECT l_suppkey AS doc_id, count(*) AS n_rows, count(*) > 512 AS over_capacity FROM lineitem WHERE l_quantity > 5 GROUP BY ALL")
def chk13_sheet_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.over_capacity(S.table(spark, sf_dir, "lineitem").where("l_quantity > 5").withColumnRenamed("l_suppkey", "doc_id"))


_COUNTED = [("true", {"doc_id": "l_suppkey", "active": "l_quantity > 3", "balloon_required": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_partkey % 7 > 2 END", "acceptance_source": _case("l_partkey", "confidence_policy", "manual", "manual_override", None), "policy_version": _case("l_suppkey", "", "candidate-confidence/1", None, "candidate-confidence/0")})]
_MARKS = [("l_partkey % 7 > 2", {"doc_id": "l_suppkey", "status": "CASE WHEN l_partkey % 13 = 0 THEN 'deleted' ELSE 'active' END"})]


@query(f"""WITH {S.derived_sql('i', 'lineitem', _COUNTED)}, {S.derived_sql('b', 'lineitem', _MARKS)}, c AS (SELECT doc_id, count(*) AS balloon_count FROM b WHERE status = 'active' GROUP BY ALL) SELECT doc_id, count(*) FILTER (active) AS reviewed_item_count, count(*) FILTER (active AND balloon_required) AS balloon_required_count, count(*) FILTER (active AND acceptance_source = 'confidence_policy') AS auto_accepted_item_count,
  count(*) FILTER (active AND acceptance_source = 'manual_override') AS manual_override_item_count, coalesce(string_agg(DISTINCT policy_version, ',' ORDER BY policy_version) FILTER (policy_version <> ''), '') AS policy_versions, coalesce(any_value(balloon_count), 0) AS balloon_count FROM i LEFT JOIN c USING (doc_id) GROUP BY doc_id""")
def agg14_manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return R.manifest_counts(S.derived(li, _COUNTED), S.derived(li, _MARKS))


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS d, l_partkey AS s FROM lineitem), n AS (SELECT DISTINCT l_suppkey AS d, l_partkey AS s FROM lineitem WHERE l_partkey % 5 <> 0), b AS (SELECT c.d, c.s, n.s AS n, CASE WHEN n.s IS NOT NULL THEN 'kept' ELSE coalesce(['revision_marker', 'title_metadata_value', NULL][CAST(c.s % 3 + 1 AS INT)], 'none') END AS reason FROM c LEFT JOIN n ON c.d = n.d AND c.s = n.s)
  SELECT d AS doc_id, reason, count(*) AS control_sources, count(n) AS current_sources, count(*) FILTER (n IS NULL) AS rerouted FROM b GROUP BY ROLLUP (d, reason)""")
def agg21_layout_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("source_id"))
    reasons = li.distinct().withColumn("reason", S.pick(("revision_marker", "title_metadata_value", None), F.col("source_id") % 3))
    return R.layout_report(li, li.where("source_id % 5 <> 0"), reasons)


_SHAPES = [("true", {"doc_id": "l_suppkey", "observation_id": "CASE WHEN l_partkey % 31 = 0 THEN ' ' ELSE 'o' END", "disposition": "CASE WHEN l_partkey % 37 = 0 THEN '' WHEN l_partkey % 2 = 0 THEN 'candidate' END", "source_location_id": "CASE WHEN l_partkey % 41 = 0 THEN '' WHEN l_partkey % 3 = 0 THEN 's' END", "candidate_id": "CASE WHEN l_partkey % 43 = 0 THEN ' ' WHEN l_partkey % 5 = 0 THEN 'c' END", "n": "CASE WHEN l_partkey % 47 = 0 THEN 3 ELSE 4 END", "requires_confirmation": "CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE l_partkey % 4 = 0 END"})]


@query(f"WITH {S.derived_sql('e', 'lineitem', _SHAPES)}, b AS (SELECT *, observation_id = ' ' OR coalesce(disposition = '', false) OR coalesce(source_location_id = '', false) OR coalesce(candidate_id = ' ', false) OR n <> 4 OR requires_confirmation IS NULL AS bad FROM e) SELECT doc_id, count(*) FILTER (bad) AS malformed, count(*) FILTER (bad OR requires_confirmation) AS review_required FROM b GROUP BY ALL")
def agg30_review_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.derived(S.table(spark, sf_dir, "lineitem"), _SHAPES)
    return R.review_required_count(e.withColumn("coordinates", F.array_repeat(F.lit(0.0), F.col("n"))))


_WORK = [("true", {"doc_id": "l_suppkey", "item_id": ID, "active": "l_quantity > 3", "page_index": "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_linenumber AS INT) END", "s1": "'p' || CAST(l_partkey AS STRING)", "s2": f"CASE WHEN l_partkey % 9 = 0 THEN 'manual:' || {ID} END"})]
_WENT = [("true", {"doc_id": "l_suppkey", "source_location_id": "'p' || CAST(l_partkey + 1 AS STRING)", "requires_confirmation": "l_linenumber % 2 = 0", "candidate_id": "CASE WHEN l_partkey % 4 = 0 THEN 'c' END", "disposition": "CASE WHEN l_partkey % 5 = 0 THEN 'reference_context' ELSE 'ambiguous' END"})]


@query(f"""WITH {S.derived_sql('i', 'lineitem', _WORK)}, {S.derived_sql('e', 'lineitem', _WENT)}, g AS (SELECT DISTINCT l_suppkey AS doc_id, 'p' || l_partkey AS source_id, CAST(l_partkey % 4 AS INT) AS page FROM lineitem WHERE l_partkey % 7 <> 0), x AS (SELECT doc_id, item_id, page_index, unnest(list_filter([s1, s2], lambda s: s IS NOT NULL)) AS source_id FROM i WHERE active),
f AS (SELECT x.doc_id, x.source_id, item_id, coalesce(page, CASE WHEN x.source_id LIKE 'manual:%' THEN page_index END) AS page FROM x LEFT JOIN g USING (doc_id, source_id)), s AS (SELECT doc_id, source_id, string_agg(item_id, ',' ORDER BY item_id) AS item_ids, min(page) AS page_index FROM f WHERE page IS NOT NULL GROUP BY ALL),
p AS (SELECT DISTINCT doc_id, source_location_id AS source_id FROM e WHERE requires_confirmation AND candidate_id IS NULL AND disposition <> 'reference_context') SELECT * FROM s UNION ALL SELECT p.doc_id, p.source_id, '', page FROM p JOIN g USING (doc_id, source_id) WHERE (p.doc_id, p.source_id) NOT IN (SELECT (doc_id, source_id) FROM s)""")
def join31_set04_workbench_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    items = S.derived(li, _WORK).withColumn("source_ids", F.array_compact(F.array("s1", "s2")))
    geometry = li.where("l_partkey % 7 <> 0").select(F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source_id"), (F.col("l_partkey") % 4).cast("int").alias("page_index")).distinct()
    return R.workbench_sources(items, S.derived(li, _WENT), geometry).withColumn("item_ids", F.array_join("item_ids", ","))


@query(f"""WITH a AS (SELECT l_suppkey AS doc_id, 'item' AS kind, {ID} AS key, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS number FROM lineitem), b AS (SELECT DISTINCT l_suppkey, 'source', 'p' || l_partkey, NULL FROM lineitem WHERE l_returnflag = 'R'), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
  SELECT doc_id, kind, key, number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY kind, number NULLS LAST, key) AS INT) AS position FROM u""")
def set05_list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    items = li.select(F.col("l_suppkey").alias("doc_id"), F.expr(ID).alias("item_id"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey")).alias("number"))
    pending = li.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source_id")).distinct()
    return R.list_entries(items, pending)


@query(f"""WITH {S.CALLS_SQL}, k AS (SELECT doc_id, call_id, CASE WHEN call_id % 9 = 0 THEN 'reserved_only' WHEN call_id % 9 = 1 THEN 'submission_started' WHEN {_MICRO} IS NULL THEN 'reserved_unknown' ELSE 'settled_verified' END AS state, {_MICRO} AS c FROM calls) SELECT doc_id, call_id AS attempt, state, CASE WHEN state = 'settled_verified' THEN c ELSE 1763328 END AS charged FROM k""")
def evt11_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _charged(spark, sf_dir)


def _charged(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = S.calls(spark, sf_dir)
    cost = (ledger.usage_cost(F.col("prompt_tokens"), F.col("completion_tokens")) * 1000000).cast("bigint")
    return R.settlements(calls.select("doc_id", F.col("call_id").alias("attempt"), (F.col("call_id") % 9 != 0).alias("started"), (F.col("call_id") % 9 > 1).alias("reported"), cost.alias("cost"), F.lit(1763328).cast("bigint").alias("reservation")))


@query(f"""WITH {S.CALLS_SQL}, k AS (SELECT doc_id, CASE WHEN call_id % 9 = 0 THEN 'r' WHEN call_id % 9 = 1 THEN 's' ELSE 'd' END AS state, CASE WHEN call_id % 9 < 2 THEN 1763328 ELSE coalesce({_MICRO}, 1763328) END AS c FROM calls)
  SELECT doc_id, CAST(sum(c) AS BIGINT) AS committed, CAST(100000000 - sum(c) AS BIGINT) AS remaining, count(*) AS reservations, count(*) FILTER (state = 'r') AS reserved_only, count(*) FILTER (state <> 'r') AS started, count(*) FILTER (state = 's') AS unsettled, count(*) FILTER (state = 'd') AS settled FROM k GROUP BY ALL""")
def agg19_ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ledger_totals(_charged(spark, sf_dir), 100_000_000)


@query("""WITH c AS (SELECT l_suppkey AS doc_id, count(*) AS local_resolved FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), v AS (SELECT l_suppkey AS doc_id, l_partkey % 4 AS k FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT doc_id, count(*) FILTER (k = 0) AS cache_resolved, count(*) FILTER (k = 1) AS vlm_pending, count(*) FILTER (k = 2) AS vlm_resolved, count(*) FILTER (k = 3) AS unresolved FROM v GROUP BY ALL)
  SELECT doc_id, coalesce(local_resolved, 0) AS local_resolved, coalesce(cache_resolved, 0) AS cache_resolved, coalesce(vlm_pending, 0) AS vlm_pending, coalesce(vlm_resolved, 0) AS vlm_resolved, coalesce(unresolved, 0) AS unresolved FROM c FULL JOIN g USING (doc_id)""")
def agg18_preview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "doc_id")
    visuals = li.where("l_returnflag = 'R'").select("doc_id", S.pick(("cache", "pending", "vlm", "none"), F.col("l_partkey") % 4).alias("resolution"))
    return R.preview_counts(li.where("l_returnflag = 'A'"), visuals)


_TIERS = [("true", {"table_id": "p_partkey", "place": "CAST(1 AS INT)", "most_prompt": "CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size * 100 END AS INT)", "per_prompt": "CASE WHEN p_partkey % 5 = 0 THEN '1.5e0' ELSE '1' END", "per_completion": "'10'"}), ("true", {"table_id": "p_partkey", "place": "CAST(2 AS INT)", "most_prompt": "CAST(CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 6000 + p_size END AS INT)", "per_prompt": "'1.5'", "per_completion": "'15'"}), ("p_partkey % 3 <> 0", {"table_id": "p_partkey", "place": "CAST(3 AS INT)", "most_prompt": "CAST(260096 AS INT)", "per_prompt": "'3'", "per_completion": "CASE WHEN p_partkey % 13 = 0 THEN '030' ELSE '30' END"})]


@query("SELECT p_partkey AS table_id, CASE WHEN p_partkey % 3 = 0 THEN 'tier_count' WHEN p_partkey % 5 = 0 OR p_partkey % 13 = 0 THEN 'price_form' WHEN p_partkey % 7 = 0 THEN 'limit' WHEN p_partkey % 11 = 0 AND p_size * 100 >= 1 THEN 'tier_order' END AS code FROM part")
def chk07_price_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.price_table_problem(S.derived(S.table(spark, sf_dir, "part"), _TIERS))


_FAILED = [("true", {"event_id": "event_id", "category": _case("event_id", *R.FAILURES, "zzz"), "request_id": "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'req-' || CAST(event_id AS STRING) WHEN 2 THEN 'has space' WHEN 3 THEN 'My-API-Key-1' WHEN 4 THEN '-lead' WHEN 5 THEN 'a:b.c_d' ELSE '' END"})]


@query(f"""WITH {S.derived_sql('f', 'events', _FAILED)} SELECT event_id, CASE category WHEN 'timeout' THEN 'provider_timeout' WHEN 'transport' THEN 'provider_transport_failure' WHEN 'schema' THEN 'provider_schema_invalid' WHEN 'authentication' THEN 'provider_authentication_failed' WHEN 'request_rejected' THEN 'provider_request_rejected' WHEN 'rate_limited' THEN 'provider_rate_limited' WHEN 'service_failure' THEN 'provider_service_failure'
    WHEN 'metadata_invalid' THEN 'provider_metadata_invalid' WHEN 'unclassified' THEN 'provider_unclassified_failure' END AS event, CASE WHEN category IN ('timeout', 'transport', 'schema') THEN 'roi_localized' WHEN category <> 'zzz' THEN 'project_blocking' END AS scope,
  CASE WHEN category = 'authentication' THEN 'invalid_configuration' WHEN category IN ('rate_limited', 'service_failure') THEN 'transient_provider_failure' WHEN category IN ('request_rejected', 'metadata_invalid', 'unclassified') THEN 'processing_defect' END AS cause, CASE event_id % 7 WHEN 0 THEN 'absent' WHEN 1 THEN 'accepted' WHEN 5 THEN 'accepted' ELSE 'rejected' END AS request_id_state FROM f""")
def par11_par12_failure_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.derived(S.table(spark, sf_dir, "events"), _FAILED)
    return f.select("event_id", R.failure_meaning(F.col("category")).alias("m"), R.request_id_state(F.col("request_id")).alias("request_id_state")).select("event_id", "m.*", "request_id_state")
