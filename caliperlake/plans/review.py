"""Queries of the review operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlake.functions import annotations as A
from caliperlake.operators import review as R
from caliperlake.plans.inspection import OBS
from caliperlake.plans.register import query
from caliperlake.sources import adapters as S

# Sample requirements.
REQUIREMENTS = ("未标注倒角C0.5", "锐边去除毛刺", "零件表面不应有划痕", "表面阳极氧化黑色处理", "未注公差按GB/T 1804-m级执行", "未注形位公差按GB/T1184-K执行", "未注尺寸公差按企业标准执行", "检查倒角尺寸应为1 x 45°", "检查平面度不大于0.1", "说明")
_REQ_SQL = f"req AS (SELECT o_orderkey AS requirement_id, o_custkey AS doc_id, [{', '.join(f"'{t}'" for t in REQUIREMENTS)}][CAST(o_orderkey % {len(REQUIREMENTS)} + 1 AS INT)] AS text, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 9 AS INT) END AS ordinal FROM orders)"


def _requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.element_at(F.array(*(F.lit(t) for t in REQUIREMENTS)), (key % len(REQUIREMENTS) + 1).cast("int"))
    return S.table(spark, sf_dir, "orders").select(key.alias("requirement_id"), F.col("o_custkey").alias("doc_id"), text.alias("text"), F.when(key % 3 == 0, (key % 9).cast("int")).alias("ordinal"))


_CLASS_SQL = f"""CASE WHEN regexp_matches(text, '{A.DIMENSION_STANDARD}') THEN 'general_dimensional_tolerance' WHEN regexp_matches(text, '{A.GEOMETRY_STANDARD}') THEN 'general_geometric_tolerance'
  WHEN regexp_matches(text, '{A.DEFAULT_CHAMFER}') OR regexp_matches(text, '{A.EXPLICIT_CHAMFER}') THEN 'default_chamfer' WHEN regexp_matches(text, '{A.DEBURR}') THEN 'deburr' WHEN regexp_matches(text, '{A.SURFACE}') THEN 'surface_integrity'
  WHEN regexp_matches(text, '{A.TREATMENT}') THEN 'surface_treatment' WHEN ordinal IS NULL AND regexp_matches(text, '{A.VERB}') AND regexp_matches(text, '{A.CRITERION}') THEN 'ambiguous' WHEN regexp_matches(text, '{A.UNKNOWN_STANDARD}') THEN 'unsupported' ELSE 'ambiguous' END"""


@query(f"WITH {_REQ_SQL}, c AS (SELECT doc_id, {_CLASS_SQL} AS subtype FROM req) SELECT doc_id, subtype, count(*) AS requirements FROM c GROUP BY ALL")
def par08_requirement_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _requirements(spark, sf_dir).withColumn("c", A.requirement_class(F.col("text"), F.col("ordinal")))
    return df.groupBy("doc_id", F.col("c.subtype").alias("subtype")).agg(F.count("*").alias("requirements"))


@query(f"""WITH {_REQ_SQL}, c AS (SELECT doc_id, regexp_extract(text, '{A.DIMENSION_STANDARD}', 1) AS d, regexp_extract(text, '{A.GEOMETRY_STANDARD}', 1) AS g FROM req)
  SELECT doc_id, count(DISTINCT nullif(lower(d), '')) AS dimensional, count(DISTINCT nullif(lower(g), '')) AS geometric, count(DISTINCT nullif(lower(d), '')) > 1 OR count(DISTINCT nullif(lower(g), '')) > 1 AS conflict FROM c GROUP BY ALL""")
def agg07_agg13_tolerance_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda p: F.nullif(F.lower(F.regexp_extract("text", p, 1)), F.lit(""))
    out = _requirements(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct(one(A.DIMENSION_STANDARD)).alias("dimensional"), F.count_distinct(one(A.GEOMETRY_STANDARD)).alias("geometric"))
    return out.withColumn("conflict", (F.col("dimensional") > 1) | (F.col("geometric") > 1))


@query(f"""{OBS}, e AS (SELECT doc_id, observation_id, CASE WHEN x0 = 30 THEN 'uncovered' ELSE 'candidate' END AS d, CASE WHEN y0 = 30 THEN NULL ELSE x0 = 40 END AS rc FROM obs WHERE y0 <> 60 UNION ALL SELECT doc_id, observation_id, 'candidate', false FROM obs WHERE x0 = 70),
  s AS (SELECT doc_id, observation_id, count(*) AS n, bool_or(d = 'uncovered') AS u, bool_or(coalesce(rc, true)) AS r FROM e GROUP BY ALL), x AS (SELECT doc_id, observation_id FROM obs WHERE x0 <> 90),
  j AS (SELECT doc_id, x.observation_id AS xe, s.* EXCLUDE (doc_id) FROM x FULL JOIN s USING (doc_id, observation_id))
  SELECT doc_id, count(xe) AS expected, count(*) FILTER (xe IS NOT NULL AND n IS NULL) AS missing, count(*) FILTER (xe IS NULL) AS unexpected, count(*) FILTER (n > 1) AS duplicated, count(*) FILTER (u) AS blocking, count(*) FILTER (r) AS review_required,
    count(*) FILTER (xe IS NOT NULL AND n IS NULL) + count(*) FILTER (xe IS NULL) + count(*) FILTER (n > 1) + count(*) FILTER (u) = 0 AS passed FROM j GROUP BY doc_id""")
def agg02_coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = S.observations(spark, sf_dir)
    one = obs.where("y0 <> 60").select("doc_id", "observation_id", F.when(F.col("x0") == 30, "uncovered").otherwise("candidate").alias("disposition"), F.when(F.col("y0") == 30, F.lit(None)).otherwise(F.col("x0") == 40).alias("requires_confirmation"))
    two = obs.where("x0 = 70").select("doc_id", "observation_id", F.lit("candidate").alias("disposition"), F.lit(False).alias("requires_confirmation"))
    return R.coverage_report(one.unionByName(two), obs.where("x0 <> 90"))


_CANDIDATES_SQL = "cand AS (SELECT l_suppkey AS doc_id, l_orderkey AS candidate_id, list_distinct(list(l_partkey ORDER BY l_partkey)) AS source_ids FROM lineitem GROUP BY ALL)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("candidate_id")).agg(F.sort_array(F.collect_set("l_partkey")).alias("source_ids"))


@query(f"WITH {_CANDIDATES_SQL}, e AS (SELECT doc_id, candidate_id, unnest(source_ids) AS source_id FROM cand) SELECT doc_id, source_id, count(DISTINCT candidate_id) AS owners FROM e GROUP BY ALL HAVING owners > 1")
def agg06_owner_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.owner_conflicts(_candidates(spark, sf_dir))


@query("""WITH s AS (SELECT l_orderkey AS item_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY ALL), e AS (SELECT item_id, unnest(ids) AS k, generate_subscripts(ids, 1) AS pos FROM s),
  f AS (SELECT item_id, min_by(k, pos) AS observation_id FROM e JOIN part ON p_partkey = k WHERE p_size > 25 GROUP BY ALL) SELECT s.item_id, f.observation_id, CAST(f.observation_id % 50 AS DOUBLE) AS x0, CAST(p_size AS DOUBLE) AS y0 FROM s LEFT JOIN f USING (item_id) LEFT JOIN part ON p_partkey = f.observation_id""")
def join12_join33_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    items = li.groupBy(F.col("l_orderkey").alias("item_id")).agg(ids.alias("source_ids"))
    geometry = S.table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("observation_id"), (F.col("p_partkey") % 50).cast("double").alias("x0"), F.col("p_size").cast("double").alias("y0"))
    return R.first_source_geometry(items, geometry)


@query("""WITH e AS (SELECT l_orderkey AS visual_id, p_brand AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey), d AS (SELECT visual_id, t, min(pos) AS pos FROM e GROUP BY ALL)
  SELECT visual_id, string_agg(t, ' ' ORDER BY pos) AS text FROM d GROUP BY ALL""")
def join30_associated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    visuals = li.groupBy(F.col("l_orderkey").alias("visual_id")).agg(ids.alias("text_ids"))
    return R.associated_text(visuals, S.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("observation_id"), F.col("p_brand").alias("raw_text")))


@query(f"""WITH {_CANDIDATES_SQL}, g AS (SELECT p_partkey AS source_id, 1 AS n, p_size / 45.0 AS v FROM part WHERE p_partkey % 11 <> 0), e AS (SELECT doc_id, candidate_id, unnest(source_ids) AS source_id FROM cand),
  w AS (SELECT doc_id, candidate_id, CAST(min(p_size) AS INT) AS least, bool_or(g.n IS NULL OR v > 1) AS invalid FROM e LEFT JOIN g USING (source_id) LEFT JOIN part ON p_partkey = g.source_id GROUP BY ALL)
  SELECT doc_id, candidate_id, least, invalid, CASE WHEN invalid OR least IS NULL OR least / 45.0 < 0.7 THEN 'low' WHEN least / 45.0 >= 0.95 THEN 'high' ELSE 'medium' END AS band FROM w""")
def join10_cls09_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cand = _candidates(spark, sf_dir).withColumn("candidate_id", F.struct("doc_id", "candidate_id"))
    signals = S.table(spark, sf_dir, "part").where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("source_id"), (F.col("p_size") / F.lit(45.0)).alias("value"))
    w = R.weakest_signal(cand, signals)
    band = R.confidence(F.col("signal"), ~F.col("invalid"), F.lit(True))["band"]
    return w.select("candidate_id.doc_id", "candidate_id.candidate_id", F.round(F.col("signal") * 45).cast("int").alias("least"), "invalid", band.alias("band"))


@query("""WITH l AS (SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS predecessor FROM orders), c AS (SELECT predecessor AS p, count(*) AS n FROM l WHERE predecessor IS NOT NULL GROUP BY ALL)
  SELECT o_orderkey, o_custkey, predecessor, coalesce(n, 0) AS successors FROM l LEFT JOIN c ON o_orderkey = p""")
def join24_evt03_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.predecessors(S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("SELECT o_custkey AS doc_id, count(DISTINCT o_orderkey) FILTER (o_orderstatus <> 'F') + count(DISTINCT o_orderdate) FILTER (o_orderstatus = 'F') AS review_count, bool_and(o_orderstatus <> 'P') AS resolved FROM orders GROUP BY ALL")
def agg15_agg27_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders")
    done = F.col("o_orderstatus") == "F"
    return o.groupBy(F.col("o_custkey").alias("doc_id")).agg((F.count_distinct(F.when(~done, F.col("o_orderkey"))) + F.count_distinct(F.when(done, F.col("o_orderdate")))).alias("review_count"), F.bool_and(F.col("o_orderstatus") != "P").alias("resolved"))


@query(f"{OBS} SELECT substr(sha256(unhex(lpad(printf('%x', strlen(observation_id)), 16, '0')) || encode(observation_id) || unhex(lpad(printf('%x', strlen(raw_text)), 16, '0')) || encode(raw_text)), 1, 24) AS candidate_id, observation_id FROM obs")
def id_stable_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caliperlake.functions.text import stable_id

    return S.observations(spark, sf_dir).select(stable_id(F.col("observation_id"), F.col("raw_text")).alias("candidate_id"), "observation_id")
