"""Queries of the inspection operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlake.functions import annotations as A
from caliperlake.functions import geometry as G
from caliperlake.functions import text as T
from caliperlake.operators import documents as D
from caliperlake.operators import ledger, logs, ordered, reports, spatial
from caliperlake.plans.register import query
from caliperlake.sources import adapters as S

def _x(text: str, pattern: str, k: int) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {k}), '')"


PARSED_SQL = f"""bodies AS (SELECT *, ({_x("raw_text", A.QUANTITY, 2)} IS NOT NULL AND NOT ({_x("raw_text", A.QUANTITY, 2)} = '-' AND regexp_matches({_x("raw_text", A.QUANTITY, 3)}, '^[0-9]'))) AS counted FROM obs),
parsed AS (SELECT *, CASE WHEN counted THEN CAST({_x("raw_text", A.QUANTITY, 1)} AS INT) END AS quantity,
    CASE WHEN regexp_matches(body, '{A.THREAD}') THEN 'thread' WHEN regexp_matches(body, '{A.DIAMETER}') THEN 'diameter_dimension' WHEN regexp_matches(body, '{A.RADIUS}') THEN 'radius'
      WHEN regexp_matches(body, '{A.ANGLE}') THEN 'angle' WHEN regexp_matches(body, '{A.LINEAR}') THEN 'linear_dimension' END AS item_type
  FROM (SELECT *, CASE WHEN counted THEN {_x("raw_text", A.QUANTITY, 3)} ELSE raw_text END AS body FROM bodies))"""
OBS = f"WITH {S.OBSERVATIONS_SQL}"
PARSED = f"{OBS}, {PARSED_SQL}"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.parsed(S.observations(spark, sf_dir).withColumn("normalized_text", T.normalised(F.col("raw_text"))))


@query(f"{PARSED} SELECT doc_id, observation_id, item_type, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_index, y0, x0, observation_id) AS INT) AS number FROM parsed WHERE item_type IS NOT NULL")
def win01_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.numbered(_parsed(spark, sf_dir), counting="item_type").select("doc_id", "observation_id", "item_type", "number")


@query(f"""{PARSED} SELECT observation_id, item_type, quantity,
  CASE item_type WHEN 'diameter_dimension' THEN {_x("body", A.DIAMETER, 1)} WHEN 'linear_dimension' THEN {_x("body", A.LINEAR, 1)} END AS nominal_raw,
  CASE item_type WHEN 'radius' THEN {_x("body", A.RADIUS, 1)} WHEN 'angle' THEN {_x("body", A.ANGLE, 1)} END AS value_raw,
  CASE item_type WHEN 'thread' THEN {_x("body", A.THREAD, 2)} WHEN 'diameter_dimension' THEN {_x("body", A.DIAMETER, 2)} END AS depth_raw,
  CASE WHEN item_type = 'thread' THEN {_x("body", A.THREAD, 1)} END AS thread_spec,
  CAST(CAST(CASE item_type WHEN 'linear_dimension' THEN {_x("body", A.LINEAR, 2)} END AS DECIMAL(20,6)) AS VARCHAR) AS upper_tolerance FROM parsed""")
def par01_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("observation_id", "item_type", "quantity", "nominal_raw", "value_raw", "depth_raw", "thread_spec", F.col("upper_tolerance").cast("string").alias("upper_tolerance"))


@query(f"{PARSED} SELECT doc_id, coalesce(item_type, 'unparsed') AS item_type, count(*) AS items, CAST(sum(coalesce(quantity, 1)) AS BIGINT) AS pieces FROM parsed GROUP BY ALL")
def agg_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).groupBy("doc_id", F.coalesce("item_type", F.lit("unparsed")).alias("item_type")).agg(F.count("*").alias("items"), F.sum(F.coalesce("quantity", F.lit(1))).alias("pieces"))


@query(f"{OBS} SELECT a.doc_id, a.observation_id AS left_id, b.observation_id AS right_id FROM obs a JOIN obs b ON a.doc_id = b.doc_id AND a.raw_text = b.raw_text AND a.observation_id < b.observation_id AND a.page_index <> b.page_index")
def join01_cross_view_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cross_view_duplicates(S.observations(spark, sf_dir), "raw_text", "page_index", "observation_id")


_MEETS = "a.x1 > b.x0 AND b.x1 > a.x0 AND a.y1 > b.y0 AND b.y1 > a.y0"


@query(f"{OBS} SELECT a.doc_id, a.page_index, a.observation_id AS left_id, b.observation_id AS right_id FROM obs a JOIN obs b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.observation_id < b.observation_id AND {_MEETS}")
def join14_box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.overlapping_pairs(S.observations(spark, sf_dir))


_SHARED = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_AREA = lambda p: f"(({p}.x1 - {p}.x0) * ({p}.y1 - {p}.y0))"


@query(f"""WITH RECURSIVE {S.OBSERVATIONS_SQL}, e AS (SELECT a.doc_id, a.page_index, a.observation_id AS u, b.observation_id AS v FROM obs a JOIN obs b
    ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.observation_id < b.observation_id AND {_MEETS} WHERE {_SHARED} / least({_AREA("a")}, {_AREA("b")}) >= 0.8),
  s AS (SELECT doc_id, page_index, u, v FROM e UNION SELECT doc_id, page_index, v, u FROM e),
  r AS (SELECT doc_id, page_index, u AS node, u AS reach FROM s UNION SELECT r.doc_id, r.page_index, r.node, s.v FROM r JOIN s ON s.doc_id = r.doc_id AND s.page_index = r.page_index AND s.u = r.reach)
  SELECT doc_id, page_index, node, min(reach) AS group_id FROM r GROUP BY ALL""")
def grp01_detection_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.overlap_groups(S.observations(spark, sf_dir), 0.8)


@query(f"""{OBS} SELECT observation_id, CASE page_index % 4 WHEN 0 THEN x0 WHEN 1 THEN 900 - y0 WHEN 2 THEN 600 - x0 ELSE y0 END AS rx,
  CASE page_index % 4 WHEN 0 THEN y0 WHEN 1 THEN x0 WHEN 2 THEN 900 - y0 ELSE 600 - x0 END AS ry FROM obs""")
def geo01_02_rotated_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = S.observations(spark, sf_dir)
    m = G.page_matrix(F.col("page_index") % 4 * 90, F.lit(600.0), F.lit(900.0))
    p = G.affine(m, G.Point(F.col("x0"), F.col("y0")))
    return obs.select("observation_id", p.x.alias("rx"), p.y.alias("ry"))


@query(f"""{OBS}, c AS (SELECT *, greatest(x0, 100.0) AS cx0, greatest(y0, 100.0) AS cy0, least(x1, 400.0) AS cx1, least(y1, 500.0) AS cy1 FROM obs)
  SELECT observation_id, CASE WHEN cx1 > cx0 AND cy1 > cy0 THEN cx0 END AS cx0, CASE WHEN cx1 > cx0 AND cy1 > cy0 THEN cy1 END AS cy1, x0 / 600 AS nx0, (x0 + x1) / 2 AS mx, (x1 - x0) * (y1 - y0) AS area,
    x0 - 6 AS wide_x0, CAST(round((x1 - x0) * 25.4 / 72 * 1000) AS BIGINT) AS width_um, greatest(0.0, x0 - least(greatest((x1 - x0) / 10, 6.0), 24.0)) AS crop_x0, true AS valid FROM c""")
def geo03_06_21_22_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, page = G.Box.of(), G.Box(F.lit(100.0), F.lit(100.0), F.lit(400.0), F.lit(500.0))
    cut = G.clip(b, page)
    return S.observations(spark, sf_dir).select(
        "observation_id", cut.x0.alias("cx0"), cut.y1.alias("cy1"), G.normalised(b, F.lit(600.0), F.lit(900.0)).x0.alias("nx0"), G.centre(b).x.alias("mx"), G.area(b).alias("area"), G.expanded(b, 6.0).x0.alias("wide_x0"),
        F.round((b.x1 - b.x0) * F.lit(25.4) / F.lit(72) * 1000).cast("bigint").alias("width_um"), G.crop(b, F.lit(600.0), F.lit(900.0)).x0.alias("crop_x0"), G.valid(b).alias("valid"),
    )


_NEIGHBOURS = f"""{OBS}, p AS (SELECT observation_id, x0, y0, x1, y1, lead(x0) OVER w AS bx0, lead(y0) OVER w AS by0, lead(x1) OVER w AS bx1, lead(y1) OVER w AS by1
  FROM obs WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY y0, x0, observation_id)),
q AS (SELECT *, greatest(0.0, least(x1, bx1) - greatest(x0, bx0)) * greatest(0.0, least(y1, by1) - greatest(y0, by0)) AS shared, (x1 - x0) * (y1 - y0) AS a, (bx1 - bx0) * (by1 - by0) AS b FROM p WHERE bx0 IS NOT NULL)"""


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id", "page_index").orderBy("y0", "x0", "observation_id")
    df = S.observations(spark, sf_dir)
    return df.select("observation_id", "x0", "y0", "x1", "y1", *(F.lead(c).over(w).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1"))).where("bx0 is not null")


@query(f"""{_NEIGHBOURS} SELECT observation_id, shared / (a + b - shared) AS iou, shared / least(a, b) AS fraction, greatest(0.0, least(x1, bx1) - greatest(x0, bx0)) / least(x1 - x0, bx1 - bx0) AS x_overlap,
  greatest(0.0, bx0 - x1, x0 - bx1) AS gap_x, greatest(0.0, by0 - y1, y0 - by1) AS gap_y, (x1 > bx0 AND bx1 > x0 AND y1 > by0 AND by1 > y0) AS meets,
  (((x0 + x1) / 2 BETWEEN bx0 - 2 AND bx1 + 2 AND (y0 + y1) / 2 BETWEEN by0 - 2 AND by1 + 2) OR greatest(0.0, least(x1, bx1 + 2) - greatest(x0, bx0 - 2)) * greatest(0.0, least(y1, by1 + 2) - greatest(y0, by0 - 2)) >= 0.5 * a) AS in_frame FROM q""")
def geo07_12_18_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = G.Box.of(), G.Box.of("b")
    gap = G.axis_gaps(a, b)
    return _neighbours(spark, sf_dir).select(
        "observation_id", G.iou(a, b).alias("iou"), G.overlap_fraction(a, b).alias("fraction"), G.interval_overlap(a.x0, a.x1, b.x0, b.x1).alias("x_overlap"), gap.x.alias("gap_x"), gap.y.alias("gap_y"), G.intersect(a, b).alias("meets"), G.belongs_to_frame(a, b, 2.0).alias("in_frame")
    )


@query(f"""{_NEIGHBOURS} SELECT observation_id, sqrt(pow(x0 - least(greatest(x0, bx0), bx1), 2) + pow(y0 - least(greatest(y0, by0), by1), 2)) < 12 AS circle_meets,
  (abs(x1 - x0) <= 1e9 AND sqrt(pow((x1 - x0) / 2, 2) + pow((y1 - y0) / 2, 2)) <= 20) AS corners_inside,
  sign((x1 - x0) * (by0 - y0) - (y1 - y0) * (bx0 - x0)) * sign((x1 - x0) * (by1 - y0) - (y1 - y0) * (bx1 - x0)) < 0
   AND sign((bx1 - bx0) * (y0 - by0) - (by1 - by0) * (x0 - bx0)) * sign((bx1 - bx0) * (y1 - by0) - (by1 - by0) * (x1 - bx0)) < 0
   AND NOT ((x0 = bx0 AND y0 = by0) OR (x0 = bx1 AND y0 = by1) OR (x1 = bx0 AND y1 = by0) OR (x1 = bx1 AND y1 = by1)) AS diagonals_cross FROM q""")
def geo08_09_11_circles_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = G.Box.of(), G.Box.of("b")
    p, q, r, s = G.Point(a.x0, a.y0), G.Point(a.x1, a.y1), G.Point(b.x0, b.y0), G.Point(b.x1, b.y1)
    return _neighbours(spark, sf_dir).select("observation_id", G.circle_meets_box(p, 12.0, b).alias("circle_meets"), G.corners_inside_circle(a, G.centre(a), 20.0).alias("corners_inside"), G.segments_cross(p, q, r, s).alias("diagonals_cross"))


@query(f"""{OBS} SELECT observation_id, CAST(round_even((x0 / 600 + x1 / 600) / 2 / 0.05, 0) AS INT) AS bx, CAST(round_even((y0 / 900 + y1 / 900) / 2 / 0.05, 0) AS INT) AS by,
  abs((((x0 - y0 + 180) % 360) + 360) % 360 - 180) <= 5 AS same_angle FROM obs""")
def geo16_17_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = G.position_bucket(G.normalised(G.Box.of(), F.lit(600.0), F.lit(900.0)))
    return S.observations(spark, sf_dir).select("observation_id", at.x.alias("bx"), at.y.alias("by"), G.angles_equal(F.col("x0"), F.col("y0"), 5.0).alias("same_angle"))


@query(f"""{OBS}, s AS (SELECT doc_id, page_index, CAST(sum(length(raw_text)) AS BIGINT) AS native_char_count, count(*) AS native_span_count, max((x1 - x0) / 60) AS max_image_coverage, count(*) FILTER (x0 > 200) AS vector_drawing_count FROM obs GROUP BY ALL)
  SELECT *, CASE WHEN native_char_count >= 20 AND max_image_coverage >= 0.8 THEN 'hybrid' WHEN native_char_count >= 20 THEN 'vector' WHEN max_image_coverage >= 0.8 THEN 'scanned' ELSE 'ambiguous' END AS page_type,
    CASE WHEN native_char_count >= 20 AND max_image_coverage >= 0.8 THEN 'hybrid' WHEN native_char_count >= 20 THEN 'native' WHEN max_image_coverage >= 0.8 THEN 'unsupported' ELSE 'hybrid' END AS route,
    CASE WHEN native_char_count >= 20 THEN 'supported' WHEN max_image_coverage >= 0.8 THEN 'unsupported' ELSE 'review_required' END AS support FROM s""")
def agg01_cls01_page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.page_signals(S.observations(spark, sf_dir), F.col("x0") > 200, (F.col("x1") - F.col("x0")) / 60)


_GRID = "CAST(floor(cx / 0.25) AS BIGINT) AS gx, CAST(floor(cy / 0.25) AS BIGINT) AS gy"
_REPEATED = f"""WITH {S.TITLE_SQL}, t AS (SELECT doc_id, page_index, observation_id, trim(raw_text) AS text, cx, cy, {_GRID} FROM texts),
g AS (SELECT doc_id, text, gx, gy FROM t GROUP BY ALL HAVING count(DISTINCT page_index) >= 2)"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.title_texts(spark, sf_dir).withColumn("text", T.collapsed(F.col("raw_text")))
    return df.select("doc_id", "page_index", "observation_id", "text", "cx", "cy", F.floor(F.col("cx") / 0.25).alias("gx"), F.floor(F.col("cy") / 0.25).alias("gy"))


@query(f"{_REPEATED} SELECT t.doc_id, t.observation_id FROM t SEMI JOIN g USING (doc_id, text, gx, gy)")
def agg03_repeated_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.repeated_overlays(_titles(spark, sf_dir), "text", "gx", "gy").select("doc_id", "observation_id")


_EDGES = "(cy <= 0.02 OR cy >= 0.98)"


@query(f"""{_REPEATED}, r AS (SELECT t.*, g.text IS NOT NULL AS rep, t.observation_id % 6 = 0 AS visual, t.observation_id % 11 = 0 AS mark, t.observation_id % 22 = 0 AS kept FROM t LEFT JOIN g USING (doc_id, text, gx, gy)),
v AS (SELECT observation_id, CASE WHEN text = '设计' THEN 'non_inspection:exact_metadata_label:false' WHEN regexp_full_match(text, '[1-9][0-9]*\\s*:\\s*[1-9][0-9]*') THEN 'non_inspection:drawing_scale:false' WHEN text IN ('A-A', 'B - B') THEN 'non_inspection:section_view_label:false' WHEN mark AND kept THEN NULL WHEN mark THEN 'non_inspection:same_page_watermark:false'
  WHEN text = '12' THEN CASE WHEN visual THEN NULL WHEN {_EDGES} THEN 'non_inspection:page_frame_number:false' WHEN cx >= 0.65 AND cy >= 0.82 THEN 'ambiguous:title_block_number:true' END WHEN text = 'II' THEN CASE WHEN NOT visual THEN 'ambiguous:standalone_roman_label:true' END
  WHEN rep AND text = 'CONFIDENTIAL' THEN 'non_inspection:repeated_page_overlay:false' WHEN rep THEN 'ambiguous:repeated_page_text:true' END AS v FROM r)
  SELECT observation_id, nullif(split_part(v, ':', 1), '') AS disposition, nullif(split_part(v, ':', 2), '') AS reason, CASE WHEN v IS NOT NULL THEN split_part(v, ':', 3) = 'true' END AS requires_confirmation FROM v""")
def cls02_03_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _titles(spark, sf_dir)
    marked = D.repeated_overlays(texts, "text", "gx", "gy").select(F.col("observation_id").alias("_id"))
    df = texts.join(marked, F.col("observation_id") == F.col("_id"), "left")
    k = F.col("observation_id")
    said = D.primary_disposition(F.col("text"), F.col("cx"), F.col("cy"), visual=k % 6 == 0, repeated=F.col("_id").isNotNull(), watermark=k % 11 == 0, preserved=k % 22 == 0)
    return df.withColumn("d", said).select("observation_id", "d.*")


@query(f"""WITH {S.MODIFIER_SQL}, m AS (SELECT *, regexp_matches(raw_text, '{A.DEPTH_MODIFIER}') OR regexp_matches(raw_text, '{A.THROUGH_MODIFIER}') AS mod FROM lines),
f AS (SELECT *, mod AND lag(true) OVER w AND (y0 - lag(y1) OVER w BETWEEN -4.0 AND 12.0) AND abs(x0 - lag(x0) OVER w) <= 16 AS follows FROM m WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY y0, x0, observation_id)),
i AS (SELECT *, sum(CASE WHEN coalesce(follows, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_index ORDER BY y0, x0, observation_id ROWS UNBOUNDED PRECEDING) AS island FROM f),
g AS (SELECT doc_id, page_index, island, first(observation_id ORDER BY y0, x0, observation_id) AS head_id, first(mod ORDER BY y0, x0, observation_id) AS orphan, first(raw_text ORDER BY y0, x0, observation_id) AS head, count(*) AS members,
  coalesce(string_agg(CASE WHEN mod THEN raw_text END, ' ' ORDER BY y0, x0, observation_id), '') AS modifiers FROM i GROUP BY ALL)
SELECT doc_id, head_id, CASE WHEN orphan THEN 'orphan' WHEN members > 1 THEN 'composite' WHEN head[1] = 'M' THEN 'thread' ELSE 'diameter_dimension' END AS kind, members, modifiers, orphan FROM g""")
def win02_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.composites(S.modifier_lines(spark, sf_dir))


@query(f"""{OBS}, n AS (SELECT doc_id, page_index, x0, CASE WHEN x0 - lag(x0) OVER w <= 10 THEN 0 ELSE 1 END AS new FROM obs WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY x0)),
c AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id, page_index ORDER BY x0) AS BIGINT) AS cluster FROM n) SELECT doc_id, page_index, cluster, count(*) AS members, avg(x0) AS mean FROM c GROUP BY ALL""")
def win05_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.clusters(S.observations(spark, sf_dir).select("doc_id", "page_index", "x0"), ["doc_id", "page_index"], "x0", 10.0)


@query(f"""{OBS}, n AS (SELECT doc_id, page_index, x0, x1, CASE WHEN x0 <= max(x1) OVER (PARTITION BY doc_id, page_index ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM obs),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_index ORDER BY x0, x1) AS island FROM n) SELECT doc_id, page_index, min(x0) AS x0, max(x1) AS x1 FROM c GROUP BY doc_id, page_index, island""")
def win06_merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.merged_intervals(S.observations(spark, sf_dir).select("doc_id", "page_index", "x0", "x1"), ["doc_id", "page_index"], "x0", "x1")


@query(f"""{OBS}, e AS (SELECT DISTINCT doc_id, page_index, unnest([x0, x1]) AS l FROM obs), s AS (SELECT *, lead(l) OVER (PARTITION BY doc_id, page_index ORDER BY l) AS r FROM e),
i AS (SELECT s.doc_id, s.page_index, l, r, y0, y1 FROM s JOIN obs USING (doc_id, page_index) WHERE r IS NOT NULL AND x0 <= l AND x1 >= r),
n AS (SELECT *, CASE WHEN y0 <= max(y1) OVER (PARTITION BY doc_id, page_index, l ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_index, l ORDER BY y0, y1) AS island FROM n),
m AS (SELECT doc_id, page_index, l, r, min(y0) AS y0, max(y1) AS y1 FROM c GROUP BY doc_id, page_index, l, r, island) SELECT doc_id, page_index, sum((r - l) * (y1 - y0)) AS covered_area FROM m GROUP BY ALL""")
def agg05_covered_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.covered_area(S.observations(spark, sf_dir))


@query(f"{OBS} SELECT observation_id FROM obs QUALIFY row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y0, x0, observation_id) <= 16")
def win08_page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.capped(S.observations(spark, sf_dir), ["doc_id", "page_index"], ["y0", "x0", "observation_id"], 16).select("observation_id")


@query(f"""WITH {S.CALLS_SQL}, c AS (SELECT *, doc_id % 5 + 1 AS capacity, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY call_id) AS pr FROM calls),
d AS (SELECT *, sum(CASE WHEN pr <= least(4, capacity) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_index, call_id ROWS UNBOUNDED PRECEDING) AS dr FROM c),
e AS (SELECT *, CASE WHEN pr > capacity THEN 'call_capacity' WHEN pr > 4 THEN 'page_limit' WHEN dr > 8 THEN 'document_limit' END AS reason FROM d) SELECT doc_id, call_id, reason, reason IS NULL AS admitted FROM e""")
def win10_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = S.calls(spark, sf_dir)
    capacity = calls.select("doc_id").distinct().withColumn("capacity", F.col("doc_id") % 5 + 1)
    return ordered.admitted(calls, capacity).select("doc_id", "call_id", "reason", "admitted")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def win13_latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.latest(S.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


_COST_SQL = """CASE WHEN prompt_tokens > 260096 OR completion_tokens > 32768 THEN NULL WHEN prompt_tokens <= 32768 THEN CAST(prompt_tokens + completion_tokens * 10 AS DECIMAL(20,6)) / 1000000
  WHEN prompt_tokens <= 131072 THEN CAST((prompt_tokens * 3 + 1) // 2 + completion_tokens * 15 AS DECIMAL(20,6)) / 1000000 ELSE CAST(prompt_tokens * 3 + completion_tokens * 30 AS DECIMAL(20,6)) / 1000000 END"""
_MICRO = f"CAST(round(({_COST_SQL}) * 1000000) AS BIGINT)"


@query(f"WITH {S.CALLS_SQL} SELECT call_id, {_MICRO} AS cost_micro FROM calls")
def agg20_join23_usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = ledger.usage_cost(F.col("prompt_tokens"), F.col("completion_tokens"))
    return S.calls(spark, sf_dir).select("call_id", (cost * 1000000).cast("bigint").alias("cost_micro"))


@query(f"""WITH {S.CALLS_SQL}, k AS (SELECT *, {_MICRO} AS c FROM calls), r AS (SELECT *, CAST(sum(coalesce(c, 0)) OVER (PARTITION BY doc_id ORDER BY call_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS committed FROM k)
  SELECT doc_id, call_id, committed, committed > 5000000 AND committed - coalesce(c, 0) <= 5000000 AS over FROM r""")
def win21_running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = F.coalesce((ledger.usage_cost(F.col("prompt_tokens"), F.col("completion_tokens")) * 1000000).cast("bigint"), F.lit(0))
    return ordered.running_budget(S.calls(spark, sf_dir).withColumn("cost", cost), ["doc_id"], ["call_id"], "cost", 5_000_000).select("doc_id", "call_id", "committed", "over")


@query(f"WITH {S.CALLS_SQL}, k AS (SELECT *, {_MICRO} AS c FROM calls) SELECT doc_id, CAST(sum(coalesce(c, 1763328)) AS BIGINT) AS committed, CAST(100000000 - sum(coalesce(c, 1763328)) AS BIGINT) AS remaining, count(c) AS settled, count(*) - count(c) AS unknown FROM k GROUP BY ALL")
def agg19_ledger_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = S.calls(spark, sf_dir).select("doc_id", ledger.usage_cost(F.col("prompt_tokens"), F.col("completion_tokens")).alias("cost"), F.lit("1.763328").cast(ledger.MONEY).alias("reservation"))
    micro = lambda c: (F.col(c) * 1000000).cast("bigint").alias(c)
    return ledger.snapshot(facts, "100").select("doc_id", micro("committed"), micro("remaining"), "settled", "unknown")


@query(f"WITH {S.CALLS_SQL}, p AS (SELECT doc_id, page_index, sum(duration_ms) AS ms FROM calls GROUP BY ALL) SELECT doc_id, CAST(sum(ms) AS BIGINT) AS doc_ms, count(*) FILTER (ms > 45000) AS pages_over, sum(ms) > 90000 AS doc_over FROM p GROUP BY ALL")
def agg28_wall_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.wall_time(S.calls(spark, sf_dir), 45, 90)


@query(f"WITH {S.CALLS_SQL} SELECT mode, page_index, count(*) AS calls, round(quantile_cont(duration_ms, 0.5), 3) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 3) AS p95_ms FROM calls GROUP BY CUBE (mode, page_index)")
def agg24_mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.mode_comparison(S.calls(spark, sf_dir))


@query(f"WITH {S.CALLS_SQL} SELECT mode, page_index, count(*) AS calls, true AS p50_within, true AS p95_within FROM calls GROUP BY CUBE (mode, page_index)")
def agg24_latency_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from mergeable sketches, held against the ranks that they have among all calls."""
    calls = S.calls(spark, sf_dir)
    return ledger.sketch_errors(calls, ledger.latency_sketches(calls))


@query("SELECT sha256(text) AS content_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY ALL")
def src06_unique_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.unique_documents(S.table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn, text) AS text, count(*) AS n_spans, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations WHERE trim(text) <> '' GROUP BY ALL")
def src02_lines_from_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.lines_from_spans(S.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(f"""{OBS}, s AS (SELECT *, CASE WHEN x0 > 250 THEN 'ocr' ELSE 'native' END AS source_type, CASE WHEN y0 > 50 THEN 'span' ELSE 'line' END AS level FROM obs), g AS (SELECT *, NOT (source_type = 'native' AND level <> 'line') AS good FROM s)
  SELECT observation_id FROM g QUALIFY good OR count(*) FILTER (good) OVER (PARTITION BY doc_id, page_index) = 0""")
def src05_selected_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = S.observations(spark, sf_dir).withColumn("source_type", F.when(F.col("x0") > 250, "ocr").otherwise("native")).withColumn("level", F.when(F.col("y0") > 50, "span").otherwise("line"))
    return D.selected_observations(obs).select("observation_id")


_STEM = r"""coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g'), ''), 'inspection')"""


@query(f"SELECT page_id, left({_STEM}, 120) AS stem FROM pages")
def src08_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "pages").select("page_id", T.safe_stem(F.col("url")).alias("stem"))


@query("""WITH n AS (SELECT p_partkey, p_size, p_name, row_number() OVER (PARTITION BY p_size, lower(left(p_name, 31)) ORDER BY p_partkey) AS k FROM part)
  SELECT p_partkey, CASE WHEN k = 1 THEN left(p_name, 31) ELSE left(p_name, CAST(31 - length('_' || k) AS INT)) || '_' || k END AS unique_name FROM n""")
def src09_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.unique_names(S.table(spark, sf_dir, "part"), "p_size", F.col("p_name"), "p_partkey").select("p_partkey", "unique_name")


@query("""WITH s AS (SELECT event_id, CAST(400 + CAST(round(value * 100) AS BIGINT) % 200 AS INT) AS status FROM events)
  SELECT event_id, status, CASE WHEN status = 408 THEN 'timeout' WHEN status IN (401, 403) THEN 'authentication' WHEN status = 429 THEN 'rate_limited' WHEN status BETWEEN 500 AND 599 THEN 'service_failure' ELSE 'request_rejected' END AS category FROM s""")
def par12_failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.table(spark, sf_dir, "events").select("event_id", (F.round(F.col("value") * 100).cast("bigint") % 200 + 400).cast("int").alias("status"))
    return df.withColumn("category", A.failure_category(F.col("status")))


_SHEET_SQL = f"""{PARSED}, v AS (SELECT *, CASE item_type WHEN 'diameter_dimension' THEN {_x("body", A.DIAMETER, 1)} WHEN 'linear_dimension' THEN {_x("body", A.LINEAR, 1)} WHEN 'radius' THEN {_x("body", A.RADIUS, 1)} WHEN 'angle' THEN {_x("body", A.ANGLE, 1)} END AS num,
    CASE WHEN item_type = 'linear_dimension' THEN CAST({_x("body", A.LINEAR, 2)} AS DECIMAL(20,6)) END AS tol FROM parsed),
sheet AS (SELECT doc_id, observation_id, page_index + 1 AS page,
  CASE WHEN regexp_matches(raw_text, 'Ra\\s*[0-9]') THEN '粗糙度' WHEN item_type = 'linear_dimension' THEN '线性' WHEN item_type = 'diameter_dimension' THEN '直径' WHEN item_type = 'radius' THEN '半径' WHEN item_type = 'angle' THEN '角度' WHEN item_type = 'thread' THEN '螺纹' ELSE '复合' END AS type_label,
  CASE item_type WHEN 'diameter_dimension' THEN 'Φ' || num WHEN 'radius' THEN 'R' || num WHEN 'angle' THEN num || '°' WHEN 'linear_dimension' THEN num WHEN 'thread' THEN {_x("body", A.THREAD, 1)} ELSE raw_text END AS size,
  CASE WHEN tol IS NULL THEN '' ELSE '±' || regexp_replace(CAST(tol AS VARCHAR), '\\.?0+$', '') END AS tolerance,
  CAST(CAST(num AS DECIMAL(20,6)) + tol AS VARCHAR) AS upper_limit, CAST(CAST(num AS DECIMAL(20,6)) - tol AS VARCHAR) AS lower_limit, CAST(NULL AS VARCHAR) AS error FROM v)"""


@query(f"{_SHEET_SQL} SELECT * FROM sheet")
def snk01_par13_dec01_03_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sheet_rows(_parsed(spark, sf_dir))


@query(f"""{_SHEET_SQL}, m AS (SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS n, sha256(string_agg(concat_ws('|', observation_id, type_label, size, tolerance), chr(10) ORDER BY concat_ws('|', observation_id, type_label, size, tolerance))) AS sha, count(*) FILTER (tolerance <> '') AS t FROM sheet GROUP BY ALL)
  SELECT doc_id, '{{"pages":' || pages || ',"rows":' || n || ',"rows_sha256":"' || sha || '","toleranced":' || t || '}}' AS manifest FROM m""")
def snk02_agg12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.manifest(reports.sheet_rows(_parsed(spark, sf_dir)))


@query("SELECT user_id, event_type, max_by(value, struct_pack(a := ts, b := event_id)) AS value, count(*) AS commands FROM events GROUP BY ALL")
def evt04_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.last_writer(S.table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@query("SELECT user_id, event_type, min_by(value, struct_pack(a := ts, b := event_id)) AS value, count(*) AS writes FROM events GROUP BY ALL")
def str05_first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.first_writer(S.table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@query("SELECT user_id, event_type, date_trunc('minute', ts) AS minute, count(*) AS n_rows, count(DISTINCT sha256(props)) AS kinds, count(DISTINCT sha256(props)) > 1 AS conflict FROM events GROUP BY ALL")
def str01_replay_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.table(spark, sf_dir, "events").withColumn("minute", F.date_trunc("minute", "ts"))
    return logs.replay_check(events, ["user_id", "event_type", "minute"], F.sha2("props", 256)).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("""WITH n AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 300 SECOND THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM n) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 300 SECOND AS "end", count(*) AS renewals FROM s GROUP BY user_id, k""")
def str04_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.leases(S.table(spark, sf_dir, "events"), ["user_id"], "ts")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""SELECT user_id, min_by(CASE WHEN event_type IN ('purchase', 'error') THEN event_type END, CASE WHEN event_type IN ('purchase', 'error') THEN event_id END) AS outcome,
  count(*) FILTER (event_type IN ('purchase', 'error')) AS terminals, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS attempts FROM events GROUP BY ALL""")
def evt01_job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.job_outcomes(S.table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type", "purchase", "error")


@query("""WITH d AS (SELECT lang, source, quality = 1 AS t, n_chars >= 500 AS p FROM documents JOIN labels USING (doc_id)), a AS (SELECT lang, source, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) AS n FROM d GROUP BY ROLLUP (lang, source))
  SELECT *, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision FROM a""")
def agg22_quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(S.table(spark, sf_dir, "labels"), "doc_id")
    return reports.binary_metrics(df, F.col("quality") == 1, F.col("n_chars") >= 500, "lang", "source")


@query(f"""{OBS}, a AS (SELECT doc_id, observation_id AS k, raw_text, x0 FROM obs WHERE y0 <> 15), b AS (SELECT doc_id, observation_id AS k, CASE WHEN x0 = 100 THEN raw_text || '!' ELSE raw_text END AS raw_text, x0 + CASE WHEN y0 = 30 THEN 1 ELSE 0 END AS x0 FROM obs WHERE y0 <> 45)
  SELECT doc_id, count(*) FILTER (a.k IS NULL) AS added, count(*) FILTER (b.k IS NULL) AS removed, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND (a.raw_text <> b.raw_text OR a.x0 <> b.x0)) AS changed,
    CAST(sum(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN (a.raw_text <> b.raw_text)::INT + (a.x0 <> b.x0)::INT ELSE 0 END) AS BIGINT) AS fields FROM a FULL JOIN b USING (doc_id, k) GROUP BY doc_id""")
def agg23_review_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = S.observations(spark, sf_dir).withColumn("k", F.col("observation_id"))
    after = obs.where("y0 <> 45").withColumn("raw_text", F.when(F.col("x0") == 100, F.concat("raw_text", F.lit("!"))).otherwise(F.col("raw_text"))).withColumn("x0", F.col("x0") + F.when(F.col("y0") == 30, 1).otherwise(0))
    return reports.difference(obs.where("y0 <> 15"), after, ["doc_id", "k"], ["raw_text", "x0"])


@query("""WITH i AS (SELECT l_suppkey AS doc_id, l_partkey AS item_id, count(*) AS items FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_suppkey AS doc_id, l_partkey AS item_id, count(*) AS balloons FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
  SELECT doc_id, item_id, coalesce(items, 0) AS items, coalesce(balloons, 0) AS balloons, CASE WHEN coalesce(balloons, 0) = 0 THEN 'missing_required_balloon' WHEN coalesce(items, 0) = 0 THEN 'item_balloon_disconnect' WHEN balloons > 1 THEN 'duplicate_balloon' END AS reason FROM i FULL JOIN b USING (doc_id, item_id)""")
def join13_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("item_id"), "l_returnflag", "l_linestatus")
    return reports.reconciled(li.where("l_returnflag = 'A'"), li.where("l_linestatus = 'F'"), ["doc_id", "item_id"])


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def join11_set01_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = S.table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return S.table(spark, sf_dir, "part").select("p_partkey").join(seen, "p_partkey", "left_anti")


@query("SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F'")
def set02_multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey").exceptAll(li.where("l_linestatus = 'F'").select("l_partkey", "l_suppkey"))


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set03_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = S.table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'A'").select("l_partkey").intersect(li.where("l_returnflag = 'R'").select("l_partkey"))


@query("SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS position FROM orders QUALIFY position BETWEEN 6 AND 10")
def srt02_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return D.list_page(o, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], 2, 5).select("o_orderkey", "o_custkey", "position")


@query("SELECT o_custkey, count(*) AS n, bool_and(o_orderkey % 100 = k) AS contiguous FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 100) AS k FROM orders) GROUP BY ALL")
def win22_number_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.gaps(S.table(spark, sf_dir, "orders").withColumn("number", F.col("o_orderkey") % 100), "o_custkey", "number")


@query("""WITH v AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), w AS (SELECT user_id, event_id, k + 1 AS after_version, CASE WHEN event_id % 97 = 0 THEN k + 5 ELSE k END AS before_version FROM v),
  x AS (SELECT *, lag(after_version) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_after FROM w) SELECT user_id, event_id, before_version, previous_after FROM x WHERE previous_after IS NOT NULL AND before_version <> previous_after""")
def win23_broken_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    log = S.table(spark, sf_dir, "events").select("user_id", "event_id", k.alias("k"))
    log = log.withColumn("after_version", F.col("k") + 1).withColumn("before_version", F.when(F.col("event_id") % 97 == 0, F.col("k") + 5).otherwise(F.col("k")))
    return ordered.broken_chain(log, "user_id", ["event_id"], "before_version", "after_version").select("user_id", "event_id", "before_version", "previous_after")
