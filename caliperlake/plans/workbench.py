"""Queries of the workbench operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlake.operators import workbench as W
from caliperlake.operators.merges import merge_outcomes
from caliperlake.plans.balloons import _ID as ID
from caliperlake.plans.register import query
from caliperlake.sources import adapters as S


@query("""WITH i AS (SELECT l_suppkey AS doc_id, l_linestatus = 'F' AS r, l_quantity > 5 AS a, l_returnflag = 'R' AS e FROM lineitem)
  SELECT doc_id, count(*) FILTER (a) AS active, count(*) FILTER (a AND r) AS reviewed, count(*) FILTER (a AND r AND NOT e) AS ready, count(*) FILTER (a AND e) AS exceptions, coalesce(bool_and(CASE WHEN a THEN r END), true) AS resolved FROM i GROUP BY ALL""")
def agg16_agg17_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = S.table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "doc_id")
    return W.progress(items, F.col("l_linestatus") == "F", F.col("l_quantity") > 5, F.col("l_returnflag") == "R")


@query("""SELECT l_orderkey AS k, CASE WHEN count(DISTINCT l_returnflag) <= 1 THEN min(l_returnflag) END AS l_returnflag, CASE WHEN count(DISTINCT l_linestatus) <= 1 THEN min(l_linestatus) END AS l_linestatus, count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1 AS conflict FROM lineitem GROUP BY ALL""")
def agg26_merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.merged_fields(S.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k"), ["k"], ["l_returnflag", "l_linestatus"])


# Decisions on the candidates of a part, each of one of five visuals, the last of which has no place; the fields are spelled out as one column, as all of them change the depth only.
_N = "CAST(l_quantity AS INT)"
_DECIDED = [
    (
        "true",
        {
            "doc_id": "l_suppkey", "decision": ID, "visual_id": "'v' || CAST(l_orderkey % 5 AS STRING)", "existing": "CASE WHEN l_linenumber = 6 THEN NULL ELSE 'p' || CAST(l_partkey AS STRING) END", "own_text": "'t' || CAST(l_linenumber % 2 AS STRING)",
            "x0": "CAST(l_orderkey % 50 AS DOUBLE)", "y0": "CAST(l_linenumber AS DOUBLE)", "x1": f"CAST(l_orderkey % 50 + {_N} AS DOUBLE)", "y1": "CAST(l_linenumber + 5 AS DOUBLE)", "disposition": f"CASE WHEN {_N} = 1 THEN 'ambiguous' ELSE 'candidate' END",
            "code": f"CASE WHEN {_N} = 1 THEN 'visual_local_parse_failed' END", "candidate_id": f"CASE WHEN {_N} = 1 THEN NULL ELSE 'p' || CAST(l_partkey AS STRING) END", "requires_confirmation": f"{_N} > 45", "signal": f"CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST({_N} AS DOUBLE) / 64 END",
            "depth": f"CASE WHEN l_tax = 0 THEN NULL WHEN {_N} = 2 THEN '9' WHEN l_returnflag = 'A' THEN '7' ELSE '5' END",
        },
    )
]
_SEEN_AT = [("l_orderkey % 5 < 4", {"doc_id": "l_suppkey", "visual_id": "'v' || CAST(l_orderkey % 5 AS STRING)", "page_index": "CAST(l_orderkey % 5 % 2 AS INT)", "y0": "CAST((l_suppkey + l_orderkey % 5) % 3 AS DOUBLE)", "x0": "CAST(l_orderkey % 5 AS DOUBLE)"})]
_BASES = [("l_partkey % 11 <> 0", {"doc_id": "l_suppkey", "candidate_id": "'p' || CAST(l_partkey AS STRING)"})]


@query(f"""WITH {S.derived_sql('d', 'lineitem', _DECIDED)}, {S.derived_sql('w', 'lineitem', _SEEN_AT)}, {S.derived_sql('k', 'lineitem', _BASES)}, v AS (SELECT DISTINCT doc_id, visual_id, page_index AS page, y0 AS vy, x0 AS vx FROM w), b AS (SELECT DISTINCT doc_id, candidate_id AS existing, true AS known FROM k),
  m AS (SELECT doc_id, existing, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM d WHERE existing IS NOT NULL GROUP BY ALL HAVING count(DISTINCT visual_id || own_text) > 1),
  r AS (SELECT d.*, row_number() OVER (PARTITION BY d.doc_id, d.existing ORDER BY page IS NULL, page, vy, vx, d.visual_id, decision) AS rk FROM d JOIN m ON d.doc_id = m.doc_id AND d.existing = m.existing LEFT JOIN v ON v.doc_id = d.doc_id AND v.visual_id = d.visual_id),
  s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, existing, visual_id, own_text ORDER BY depth IS NULL, decision) = 1),
  f AS (SELECT doc_id, existing, bool_and(disposition = 'candidate' AND depth IS NOT NULL AND coalesce(known, false)) AND count(DISTINCT depth) FILTER (depth <> '5') < 2 AS good, max(depth) AS deepest, bool_or(requires_confirmation) AS unsure, min(signal) AS least FROM s LEFT JOIN b USING (doc_id, existing) GROUP BY ALL),
  e AS (SELECT doc_id, existing, source, min(2 * rk + pos) AS first FROM (SELECT doc_id, existing, rk, unnest([visual_id, own_text]) AS source, unnest([0, 1]) AS pos FROM r) GROUP BY ALL),
  o AS (SELECT e.doc_id, existing, string_agg(source, ',' ORDER BY page IS NULL, page, vy, vx, CASE WHEN page IS NOT NULL THEN source END, first) AS sources FROM e LEFT JOIN v ON v.doc_id = e.doc_id AND v.visual_id = e.source GROUP BY ALL)
  SELECT d.doc_id, d.decision, CASE WHEN NOT good THEN 'ambiguous' ELSE d.disposition END AS disposition, CASE WHEN NOT good THEN 'visual_projection_conflict' ELSE d.code END AS code, CASE WHEN good IS NOT false THEN d.candidate_id END AS candidate_id, CASE WHEN good THEN unsure WHEN NOT good THEN true ELSE d.requires_confirmation END AS requires_confirmation,
    CASE WHEN good THEN least ELSE d.signal END AS signal, coalesce(sources, d.visual_id || ',' || d.own_text) AS sources, coalesce(m.x0, d.x0) AS x0, coalesce(m.y0, d.y0) AS y0, coalesce(m.x1, d.x1) AS x1, coalesce(m.y1, d.y1) AS y1,
    CASE WHEN good THEN CASE WHEN r.rk = 1 THEN 'depth=' || deepest || ',kind=hole' END WHEN good IS NULL THEN 'depth=' || d.depth || ',kind=hole' END AS fields, coalesce(good AND r.rk = 1, false) AS is_primary, CASE WHEN good AND r.rk = 1 THEN NOT unsure END AS truth_preserved
  FROM d LEFT JOIN m ON m.doc_id = d.doc_id AND m.existing = d.existing LEFT JOIN f ON f.doc_id = d.doc_id AND f.existing = d.existing LEFT JOIN o ON o.doc_id = d.doc_id AND o.existing = d.existing LEFT JOIN r ON r.doc_id = d.doc_id AND r.decision = d.decision""")
def agg26_merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    fields = lambda depth: F.create_map(F.lit("depth"), depth, F.lit("kind"), F.lit("hole"))
    decisions = S.derived(li, _DECIDED).withColumns({"source_ids": F.array("visual_id", "own_text"), "fields": F.when(F.col("depth").isNotNull(), fields(F.col("depth")))})
    out = merge_outcomes(decisions, S.derived(li, _SEEN_AT), S.derived(li, _BASES).withColumn("fields", fields(F.lit("5"))))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return out.withColumns({"sources": F.array_join("source_ids", ","), "fields": text}).drop("source_ids", "visual_id").withColumnRenamed("primary", "is_primary")


@query("""WITH a AS (SELECT l_orderkey AS v, list_sort(list_distinct(list(l_linenumber))) AS k FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_orderkey AS c, list_sort(list_distinct(list(l_linenumber))) AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
  SELECT v AS visual_id, c AS candidate_id FROM a JOIN b ON a.k = b.k AND v % 100 = c % 100 AND v // 1000 = c // 1000""")
def join16_same_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    # A drawing is an order group here; it leads the source ids, as ids are unique in a drawing only.
    doc = F.concat_ws("/", (F.col("l_orderkey") % 100).cast("string"), F.floor(F.col("l_orderkey") / 1000).cast("string"))
    ids = F.concat(F.collect_set(F.col("l_linenumber").cast("string")), F.array(F.concat(F.lit("doc:"), F.first(doc))))
    part = lambda flag, name: li.where(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias(name)).agg(ids.alias("source_ids"))
    return W.same_sources(part("A", "visual_id"), part("R", "candidate_id"))


@query("""WITH r AS (SELECT event_id AS attempt, md5(CAST(event_id AS VARCHAR)) AS h FROM events), s AS (SELECT event_id AS attempt, md5(CAST(CASE WHEN event_id % 50 = 0 THEN event_id + 1 ELSE event_id END AS VARCHAR)) AS p FROM events WHERE event_id % 7 <> 0),
  t AS (SELECT event_id AS attempt, md5(CAST(event_id AS VARCHAR)) AS p, value AS cost FROM events WHERE event_id % 3 = 0)
  SELECT r.attempt, CASE WHEN t.cost IS NOT NULL THEN 'settled' WHEN s.p IS NOT NULL THEN 'started' ELSE 'reserved' END AS state, t.cost, CASE WHEN t.p IS NOT NULL AND s.p IS NULL THEN 'settled_before_start' WHEN s.p <> r.h OR t.p <> r.h THEN 'broken_link' END AS reason
  FROM r LEFT JOIN s USING (attempt) LEFT JOIN t USING (attempt)""")
def join22_ledger_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events").withColumnRenamed("event_id", "attempt")
    key = lambda c: F.md5(c.cast("string").cast("binary"))
    k = F.col("attempt")
    reserved = e.select("attempt", key(k).alias("hash"))
    started = e.where(k % 7 != 0).select("attempt", key(F.when(k % 50 == 0, k + 1).otherwise(k)).alias("parent"))
    return W.ledger_facts(reserved, started, e.where(k % 3 == 0).select("attempt", key(k).alias("parent"), F.col("value").alias("cost")))


@query("SELECT CAST(round(value * 10) AS BIGINT) AS request_id, any_value(event_id) AS charge FROM events GROUP BY ALL HAVING count(*) = 1")
def agg32_single_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.table(spark, sf_dir, "events").select(F.round(F.col("value") * 10).cast("bigint").alias("request_id"), "event_id")
    return W.single_charges(e, "request_id", "event_id")


@query("""WITH a AS (SELECT l_suppkey AS doc_id, list_sort(list(l_linenumber)) AS a FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey AS doc_id, list_sort(list(l_linenumber)) AS b FROM lineitem WHERE l_quantity > 2 GROUP BY ALL)
  SELECT doc_id, coalesce(len(a), 0) AS n_rows, coalesce(len(b), 0) AS n_balloons, a IS NOT DISTINCT FROM b AS equal FROM a FULL JOIN b USING (doc_id)""")
def agg11_set06_export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("number"), "l_quantity")
    return W.export_counts(li, li.where("l_quantity > 2"))


@query("""WITH a AS (SELECT o_custkey AS doc_id, o_orderkey, ['manifest', 'pdf', 'xlsx', 'log'][CAST(o_orderkey % 4 + 1 AS INT)] AS kind FROM orders)
  SELECT doc_id, o_orderkey, kind, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'pdf' THEN 1 WHEN 'xlsx' THEN 2 WHEN 'manifest' THEN 3 ELSE 4 END, o_orderkey) AS INT) AS position FROM a""")
def srt03_artifact_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(k) for k in ("manifest", "pdf", "xlsx", "log"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return W.artifact_order(S.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", kind.alias("kind")), "kind", "o_orderkey")


@query("""WITH i AS (SELECT p_partkey AS item_id, ['thread', 'angle', 'radius', 'linear_dimension'][CAST(p_partkey % 4 + 1 AS INT)] AS item_type, p_size AS size, p_partkey % 3 AS quantity, CASE WHEN p_partkey % 10 = 0 THEN p_name END AS m, p_retailprice > 1000 AS key, p_size % 4 AS page_index FROM part)
  SELECT item_id, coalesce(m, item_type || '：' || size || CASE WHEN quantity > 1 THEN '（' || quantity || '处）' ELSE '' END) AS inspection_item, CASE WHEN m IS NOT NULL THEN 'manual' ELSE 'generated' END AS provenance,
    CASE item_type WHEN 'thread' THEN '螺纹规' WHEN 'angle' THEN '角度尺' WHEN 'radius' THEN '半径规' ELSE '游标卡尺' END AS method, CASE WHEN key THEN '是' ELSE '否' END AS key_flag, page_index + 1 AS page FROM i""")
def cls19_item_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("thread", "angle", "radius", "linear_dimension"))), (k % 4 + 1).cast("int"))
    df = S.table(spark, sf_dir, "part").select(k.alias("item_id"), kind.alias("item_type"), kind.alias("label"), F.col("p_size").cast("string").alias("size"), (k % 3).alias("quantity"), F.when(k % 10 == 0, F.col("p_name")).alias("manual_label"), (F.col("p_retailprice") > 1000).alias("key"), (F.col("p_size") % 4).alias("page_index"))
    return W.item_fields(df)


@query("""WITH r AS (SELECT l_orderkey, list(l_partkey) AS ids, bool_or(l_returnflag = 'R') AS u FROM lineitem GROUP BY ALL), s AS (SELECT k, bool_or(u) AS open FROM (SELECT unnest(ids) AS k, u FROM r) GROUP BY ALL)
  SELECT p_partkey AS entry_id, coalesce(open, false) AS requires_confirmation FROM part LEFT JOIN s ON k = p_partkey""")
def evt10_cls26_requirement_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    req = S.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("source_ids"), F.bool_or(F.col("l_returnflag") == "R").alias("unconfirmed"))
    return W.needs_confirmation(S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_partkey").alias("source_id")), req)
