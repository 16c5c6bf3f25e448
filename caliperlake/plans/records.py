"""Queries of sources, text rules, sheet fields, metrics and logs over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlake.functions import annotations as A
from caliperlake.functions import geometry as G
from caliperlake.functions import text as T
from caliperlake.operators import logs, releases, reports
from caliperlake.operators import workbench as W
from caliperlake.plans.inspection import OBS
from caliperlake.plans.register import query
from caliperlake.plans.releases import _COUNTED, _MARKS, _case
from caliperlake.sources import adapters as S
from caliperlake.sources import documents as sources

_OCR = [
    (
        "true",
        {
            "event_id": "event_id",
            "body": """CASE WHEN event_id % 23 = 0 THEN 'x' ELSE '{' || CASE WHEN event_id % 7 = 0 THEN '' ELSE '"RequestId":"' || CASE WHEN event_id % 11 = 0 THEN ' ' ELSE 'r1' END || '",' END || '"TextDetections":[' || CASE WHEN event_id % 13 = 0 THEN '' ELSE '{"DetectedText":"' || CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'T' || CAST(event_id AS STRING) END || '","Confidence":' || CASE WHEN event_id % 3 = 0 THEN '100.5' ELSE '99.5' END
  || ',"Polygon":[{"X":1,"Y":2},{"X":' || CAST(event_id % 50 + 2 AS STRING) || ',"Y":2.5},{"X":9,"Y":8}' || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',{"X":0.5,"Y":7}' END || ']}' END || ']}' END""",
        },
    )
]


@query("""WITH e AS (SELECT event_id, event_id % 23 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 AS noid, event_id % 13 = 0 AS none FROM events), r AS (SELECT *, CASE WHEN noid THEN 'missing_request_id' WHEN none THEN 'no_detection' WHEN event_id % 5 = 0 THEN 'blank_text' WHEN event_id % 3 = 0 THEN 'confidence_out_of_range' WHEN event_id % 4 = 0 THEN 'polygon_not_four_points' END AS reason FROM e)
  SELECT event_id, reason, CASE WHEN event_id % 23 <> 0 AND NOT none THEN CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'T' || event_id END END AS raw_text, CASE WHEN reason IS NULL THEN 0.5::DOUBLE END AS x0, CASE WHEN reason IS NULL THEN CAST(greatest(event_id % 50 + 2, 9) AS DOUBLE) END AS x1, CASE WHEN reason IS NULL THEN 8.0::DOUBLE END AS y1 FROM r""")
def src03_recognised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.recognised(S.derived(S.table(spark, sf_dir, "events"), _OCR)).select("event_id", "reason", "raw_text", "x0", "x1", "y1")


_CALLS = [("true", {"event_id": "event_id", "body": """CASE WHEN event_id % 29 = 0 THEN '[1' ELSE '{"call_id":"c' || CAST(event_id AS STRING) || '",' || CASE WHEN event_id % 7 = 0 THEN '"API_KEY":"k",' WHEN event_id % 11 = 0 THEN '"extra":"1",' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN '' ELSE '"prompt_tokens":' || CASE WHEN event_id % 3 = 0 THEN '-4' ELSE '12' END || ',' END || '"mode":"m"}' END"""})]


@query("SELECT event_id, CASE WHEN event_id % 29 = 0 THEN 'not_json' WHEN event_id % 7 = 0 THEN 'forbidden_field' WHEN event_id % 5 = 0 THEN 'missing_field' WHEN event_id % 11 = 0 THEN 'unknown_field' WHEN event_id % 3 = 0 THEN 'negative_counter' END AS reason FROM events")
def src07_call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.call_records(S.derived(S.table(spark, sf_dir, "events"), _CALLS), ["call_id", "prompt_tokens", "mode"]).select("event_id", "reason")


# Said by hand: a text, compact, whether it is a short token, its standalone decimals, its roughness, its depth, whether a sheet would run it.
_SAID = (
    ("A 1 ", "A1", False, "1", None, None, False),
    (" AB1  ", "AB1", True, "", None, None, False),
    ("ABCD", "ABCD", False, "", None, None, False),
    ("Ra 3.2 / Ra6.3", "Ra3.2/Ra6.3", False, "3.2", "3.2", None, False),
    ("深 12.5", "深12.5", False, "12.5", None, "12.5", False),
    ("↓7", "↓7", False, "7", None, "7", False),
    ("=1+2", "=1+2", False, "1,2", None, None, True),
    ("@x 4 and 4 or 1.2.3", "@x4and4or1.2.3", False, "4", None, None, True),
    ("ＡＢ　９", "AB9", False, "", None, None, False),
    ("- 5 5.50", "-55.50", False, "5,5.50", None, None, True),
)


@query(f"WITH {S.fixed_sql('said', 'raw, compact, short, decimals, roughness, depth, formula', list(_SAID))} SELECT p_partkey, compact, short, decimals, roughness, depth, formula FROM part JOIN said ON raw = {S.pick_sql(tuple(r[0] for r in _SAID), f'p_partkey % {len(_SAID)}')}")
def txt02_txt03_txt06_par04_snk03_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = S.pick(tuple(r[0] for r in _SAID), F.col("p_partkey") % len(_SAID))
    return S.table(spark, sf_dir, "part").select(
        "p_partkey", T.compact(text).alias("compact"), T.short_token(text).alias("short"), F.array_join(T.standalone_decimals(text), ",").alias("decimals"), A.roughness_value(text).alias("roughness"), A.explicit_depth(text).alias("depth"), T.formula_like(text).alias("formula")
    )


_WRAPPED = (("abc", "def"), ("表面", "abc"), ("1.5", "mm"), ("x", ""), ("", "y"), ("end.", "Next"), ("孔", "深"), ("A", "1", "b"))
_GLUED = ("abc def", "表面abc", "1.5 mm", "x", "y", "end.Next", "孔深", "A 1 b")


@query(f"SELECT p_partkey, {S.pick_sql(_GLUED, f'p_partkey % {len(_GLUED)}')} AS text FROM part")
def txt04_wrapped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.element_at(F.array(*(F.array(*(F.lit(p) for p in w)) for w in _WRAPPED)), (F.col("p_partkey") % len(_WRAPPED) + 1).cast("int"))
    return S.table(spark, sf_dir, "part").select("p_partkey", T.joined_wrapped(parts).alias("text"))


@query(f"""{OBS}, s AS (SELECT observation_id, x0 AS px, y0 AS py, x1 + 100 AS qx, y1 - 200 AS qy FROM obs), t AS (SELECT *, (100 - px) / (qx - px) AS a, (300 - px) / (qx - px) AS b, (100 - py) / (qy - py) AS c, (300 - py) / (qy - py) AS d FROM s)
  SELECT observation_id, (px BETWEEN 100 AND 300 AND py BETWEEN 100 AND 300) OR (qx BETWEEN 100 AND 300 AND qy BETWEEN 100 AND 300) OR (a BETWEEN 0 AND 1 AND py + a * (qy - py) BETWEEN 100 AND 300) OR (b BETWEEN 0 AND 1 AND py + b * (qy - py) BETWEEN 100 AND 300) OR (c BETWEEN 0 AND 1 AND px + c * (qx - px) BETWEEN 100 AND 300) OR (d BETWEEN 0 AND 1 AND px + d * (qx - px) BETWEEN 100 AND 300) AS meets,
    CAST(floor(degrees(atan2(qy - py, qx - px)) * 1000000 + 0.5) AS BIGINT) AS angle_micro FROM t""")
def geo10_geo20_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = G.Point(F.col("x0"), F.col("y0")), G.Point(F.col("x1") + 100, F.col("y1") - 200)
    box = G.Box(F.lit(100.0), F.lit(100.0), F.lit(300.0), F.lit(300.0))
    return S.observations(spark, sf_dir).select("observation_id", G.segment_meets_box(p, q, box).alias("meets"), F.floor(G.degrees_of(q.x - p.x, q.y - p.y) * 1000000 + 0.5).cast("bigint").alias("angle_micro"))


@query("SELECT l_suppkey AS doc_id, 'c' || l_partkey AS candidate_id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def agg06_duplicated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("doc_id"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("candidate_id")).agg(F.count("*").alias("n")).where("n > 1")


_READ = [("true", {"doc_id": "p_size", "kind": _case("p_partkey", "thread", "radius", "angle"), "truth": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END", "found": "CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN p_name || 'x' WHEN 3 THEN replace(p_name, 'a', 'e') ELSE p_name END"})]


@query(f"""WITH {S.derived_sql('p', 'part', _READ)}, g AS (SELECT doc_id, kind, count(truth) AS expected, count(*) FILTER (truth IS NOT NULL AND found IS NOT NULL) AS found, count(*) FILTER (truth IS NULL AND found IS NOT NULL) AS extra, count(*) FILTER (truth = found) AS exact, CAST(sum(length(truth)) AS BIGINT) AS chars, CAST(sum(CASE WHEN truth IS NOT NULL THEN coalesce(levenshtein(truth, found), length(truth)) END) AS BIGINT) AS edits FROM p GROUP BY ROLLUP (doc_id, kind))
  SELECT *, CASE WHEN expected > 0 THEN round(found / expected, 6) END AS recall, CASE WHEN expected > 0 THEN round(exact / expected, 6) END AS exact_match, CASE WHEN chars > 0 THEN round(edits / chars, 6) END AS character_error_rate, CASE WHEN found + extra > 0 THEN round(extra / (found + extra), 6) END AS false_selection FROM g""")
def agg22_recognition_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recognition_metrics(S.derived(S.table(spark, sf_dir, "part"), _READ), "doc_id", "kind")


_KINDS = ("linear_dimension", "diameter_dimension", "thread", "radius", "angle", "general_requirement", "roughness", "composite", "weld")
_SHEET = [
    (
        "true",
        {
            "item_id": "p_partkey", "item_type": _case("p_partkey", *_KINDS), "text": "CASE WHEN p_partkey % 13 = 0 THEN ' ' ELSE ' Φ12 ' END", "quantity": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size % 3 END", "critical": "p_size % 2 = 0", "page_index": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size % 5 END", "rule": "p_partkey % 5 = 0",
            "inspection_item": "CASE WHEN p_partkey % 10 = 0 THEN 'old' WHEN p_partkey % 7 = 0 THEN ' mine ' END", "inspection_standard": "CASE WHEN p_partkey % 6 = 0 THEN 'GB' END", "inspection_method": "CASE WHEN p_partkey % 10 = 5 THEN 'old' WHEN p_partkey % 8 = 0 THEN 'eye' END", "key_dimension": "CASE WHEN p_partkey % 11 = 0 THEN 'C1' END",
            "inspection_role": "CASE WHEN p_partkey % 3 = 0 THEN 'QC' END", "source_page": "CASE WHEN p_partkey % 9 = 0 THEN 7 WHEN p_partkey % 9 = 1 THEN 0 END", "remarks": "CASE WHEN p_partkey % 2 = 0 THEN 'r' END",
        },
    )
]


@query(f"""WITH {S.derived_sql('i', 'part', _SHEET)}, k AS (SELECT *, CASE item_type WHEN 'linear_dimension' THEN '线性尺寸' WHEN 'diameter_dimension' THEN '直径尺寸' WHEN 'thread' THEN '螺纹' WHEN 'radius' THEN '半径' WHEN 'angle' THEN '角度' WHEN 'general_requirement' THEN '通用要求' WHEN 'roughness' THEN '粗糙度' ELSE '检验项目' END || CASE WHEN trim(text) <> '' THEN '：Φ12' ELSE '' END || CASE WHEN quantity >= 1 THEN '（' || quantity || '处）' ELSE '' END AS made,
  coalesce(CASE WHEN NOT rule THEN inspection_method END, CASE item_type WHEN 'linear_dimension' THEN '游标卡尺' WHEN 'diameter_dimension' THEN '游标卡尺' WHEN 'thread' THEN '螺纹规' WHEN 'radius' THEN '半径规' WHEN 'angle' THEN '万能角度尺' WHEN 'general_requirement' THEN '目视' WHEN 'roughness' THEN '粗糙度仪' END) AS m, CASE WHEN source_page >= 1 THEN source_page ELSE page_index + 1 END AS pg FROM i)
  SELECT item_id, coalesce(CASE WHEN NOT rule THEN nullif(trim(inspection_item), '') END, made) AS inspection_item, coalesce(inspection_standard, '图纸要求') AS inspection_standard, m AS inspection_method, coalesce(key_dimension, CASE WHEN critical THEN '是' ELSE '否' END) AS key_dimension, coalesce(inspection_role, '检验员') AS inspection_role, pg AS source_page, CASE WHEN remarks IS NULL OR rule THEN '' ELSE remarks END AS remarks,
    concat_ws(',', CASE WHEN item_type = 'composite' AND m IS NULL THEN 'composite_method_required' END, CASE WHEN item_type <> 'composite' AND m IS NULL THEN 'unsupported_item_type' END, CASE WHEN pg IS NULL THEN 'missing_source_page' END) AS exceptions FROM k""")
def cls19_sheet_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_rule = F.when(F.col("rule"), F.array(F.lit("inspection_item"), F.lit("inspection_method"), F.lit("remarks"))).otherwise(F.array().cast("array<string>"))
    return W.sheet_fields(S.derived(S.table(spark, sf_dir, "part"), _SHEET).withColumn("by_rule", by_rule), "检验员")


_VERSIONS = {"schema_version": "export-manifest/2", "template_version": "sip-v1", "renderer_version": "balloon-pdf/1"}


@query(f"""WITH {S.derived_sql('i', 'lineitem', _COUNTED)}, {S.derived_sql('b', 'lineitem', _MARKS)}, c AS (SELECT doc_id, count(*) AS n FROM b WHERE status = 'active' GROUP BY ALL), g AS (SELECT doc_id, count(*) FILTER (active) AS a, count(*) FILTER (active AND balloon_required) AS r, count(*) FILTER (active AND acceptance_source = 'confidence_policy') AS p, count(*) FILTER (active AND acceptance_source = 'manual_override') AS m,
  coalesce(string_agg(DISTINCT policy_version, ',' ORDER BY policy_version) FILTER (policy_version <> ''), '') AS v, coalesce(any_value(n), 0) AS n FROM i LEFT JOIN c USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, '{{"artifacts":[{{"kind":"ballooned_pdf","filename":"d' || doc_id || '.pdf","sha256":"' || sha256(doc_id || 'pdf') || '","size_bytes":' || (1000 + doc_id) || '}},{{"kind":"sip_excel","filename":"d' || doc_id || '.xlsx","sha256":"' || sha256(doc_id || 'xlsx') || '","size_bytes":' || (2000 + doc_id) || '}}],"auto_accepted_item_count":' || p || ',"balloon_count":' || n || ',"balloon_required_count":' || r || ',"manual_override_item_count":' || m
    || ',"policy_versions":"' || v || '","renderer_version":"balloon-pdf/1","reviewed_item_count":' || a || ',"schema_version":"export-manifest/2","template_version":"sip-v1"}}' AS manifest FROM g JOIN supplier ON s_suppkey = doc_id""")
def snk02_full_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    doc = F.col("s_suppkey")
    one = lambda kind, end, base: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit("d"), doc.cast("string"), F.lit("." + end)).alias("filename"), F.sha2(F.concat(doc.cast("string"), F.lit(end)), 256).alias("sha256"), (doc + base).alias("size_bytes"))
    artifacts = S.table(spark, sf_dir, "supplier").select(doc.alias("doc_id"), F.explode(F.array(one("ballooned_pdf", "pdf", 1000), one("sip_excel", "xlsx", 2000))).alias("a")).select("doc_id", "a.*")
    return reports.full_manifest(releases.manifest_counts(S.derived(li, _COUNTED), S.derived(li, _MARKS)), artifacts, _VERSIONS)


@query("""WITH e AS (SELECT user_id AS doc_id, event_id % 2 AS operator, ts, CASE WHEN event_id % 5 = 0 THEN 'release' ELSE 'renew' END AS kind, event_id FROM events), n AS (SELECT *, CASE WHEN lag(kind) OVER w = 'release' OR lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 300 SECOND THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY doc_id, operator ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, operator ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM n)
  SELECT doc_id, operator, min(ts) AS start, CASE WHEN arg_max(kind, ts) = 'release' THEN max(ts) ELSE max(ts) + INTERVAL 300 SECOND END AS "end", count(*) AS renewals FROM s GROUP BY doc_id, operator, k""")
def str04_editor_tenures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = S.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (k % 2).alias("operator"), "ts", F.when(k % 5 == 0, "release").otherwise("renew").alias("kind"))
    return logs.tenures(e).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


_WRITTEN = [("event_id % 3 <> 0", {"user_id": "user_id", "event_type": "event_type", "written": "event_id", "identity": "CASE WHEN event_id % 7 = 0 THEN 'old' ELSE 'i' END", "response_sha": "'a'", "stored_sha": "CASE WHEN event_id % 11 = 0 THEN 'b' ELSE 'a' END", "provenance_ok": "event_id % 13 <> 0"})]
_LOOKED = [("event_id % 2 = 0", {"user_id": "user_id", "event_type": "CASE WHEN event_id % 10 = 0 THEN 'zzz' ELSE event_type END", "lookup_id": "event_id", "identity": "'i'"})]


@query(f"""WITH {S.derived_sql('w', 'events', _WRITTEN)}, {S.derived_sql('l', 'events', _LOOKED)}, f AS (SELECT user_id, event_type, arg_min(identity = 'i' AND stored_sha = 'a' AND provenance_ok, written) AS good FROM w GROUP BY ALL) SELECT lookup_id, CASE WHEN good IS NULL THEN 'cache_miss' WHEN good THEN 'cache_hit_valid' ELSE 'cache_provenance_invalid' END AS result FROM l LEFT JOIN f USING (user_id, event_type)""")
def str05_cache_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events")
    return logs.cache_lookups(S.derived(e, _LOOKED), S.derived(e, _WRITTEN), ["user_id", "event_type"])
