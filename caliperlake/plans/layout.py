"""Queries of the layout operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlake.operators import layout as L
from caliperlake.operators import ordered
from caliperlake.plans.inspection import OBS
from caliperlake.plans.register import QUERIES, query
from caliperlake.sources import adapters as S

# Rectangles of page roles, in points.
ROLES = (("title_block", 400.0, 400.0, 600.0, 600.0), ("revision_table", 0.0, 0.0, 150.0, 100.0), ("archive_strip", 0.0, 80.0, 60.0, 600.0), ("drawing", 150.0, 100.0, 400.0, 400.0))


@query(f"""{OBS}, i AS (SELECT * FROM obs WHERE x0 >= 250 AND x1 - x0 <= 96 AND y1 - y0 <= 96) SELECT t.doc_id, t.page_index, t.observation_id AS text_id, i.observation_id AS item_id FROM obs t JOIN i ON t.doc_id = i.doc_id AND t.page_index = i.page_index
  AND greatest(0.0, i.x0 - t.x1, t.x0 - i.x1) <= 12 AND greatest(0.0, i.y0 - t.y1, t.y0 - i.y1) <= 12 WHERE t.x0 < 250""")
def join02_items_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = S.observations(spark, sf_dir)
    return L.items_near(obs.where("x0 < 250"), obs.where("x0 >= 250"))


@query(f"""{OBS}, r(role, rx0, ry0, rx1, ry1) AS (VALUES {', '.join(map(str, ROLES))}), h AS (SELECT doc_id, observation_id, count(*) AS n, min(role) AS role FROM obs JOIN r ON (x0 + x1) / 2 BETWEEN rx0 AND rx1 AND (y0 + y1) / 2 BETWEEN ry0 AND ry1 GROUP BY ALL)
  SELECT doc_id, observation_id, CASE WHEN n = 1 THEN role ELSE 'ambiguous' END AS role FROM h""")
def join03_layout_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.roles_of(S.observations(spark, sf_dir), spark.createDataFrame(ROLES, "role string, rx0 double, ry0 double, rx1 double, ry1 double"))


@query(f"""{OBS}, p AS (SELECT l.doc_id, l.observation_id, v.observation_id AS v FROM obs l JOIN obs v USING (doc_id, page_index) WHERE l.raw_text LIKE 'R%' AND v.raw_text LIKE 'M%' AND v.x0 >= l.x1 AND greatest(0.0, least(l.y1, v.y1) - greatest(l.y0, v.y0)) / 10 >= 0.5)
  SELECT doc_id, observation_id AS label_id, count(*) AS n, CASE WHEN count(*) = 1 THEN min(v) END AS value_id FROM p GROUP BY doc_id, observation_id""")
def join05_values_beside_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = S.observations(spark, sf_dir)
    return L.values_beside(obs.where(F.col("raw_text").startswith("R")), obs.where(F.col("raw_text").startswith("M")))


# Box by box in reading order, with the boxes kept so far as a list.
@query(f"""WITH RECURSIVE {OBS[5:]}, o AS (SELECT doc_id, page_index, observation_id, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} AS b, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY y0, x0, observation_id) AS k FROM obs),
  g AS (SELECT doc_id, page_index, k, [b] AS kept, observation_id AS id FROM o WHERE k = 1 UNION ALL
    SELECT o.doc_id, o.page_index, o.k, CASE WHEN hit THEN kept ELSE list_append(kept, b) END, CASE WHEN NOT hit THEN observation_id END FROM (SELECT o.*, g.kept, len(list_filter(g.kept, lambda q: greatest(0, least(q.x1, o.b.x1) - greatest(q.x0, o.b.x0)) * greatest(0, least(q.y1, o.b.y1) - greatest(q.y0, o.b.y0)) /
      ((q.x1 - q.x0) * (q.y1 - q.y0) + (o.b.x1 - o.b.x0) * (o.b.y1 - o.b.y0) - greatest(0, least(q.x1, o.b.x1) - greatest(q.x0, o.b.x0)) * greatest(0, least(q.y1, o.b.y1) - greatest(q.y0, o.b.y0))) >= 0.8)) > 0 AS hit
    FROM g JOIN o ON o.doc_id = g.doc_id AND o.page_index = g.page_index AND o.k = g.k + 1) o)
  SELECT doc_id, page_index, id AS observation_id FROM g WHERE id IS NOT NULL""")
def win15_greedy_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.suppressed(S.observations(spark, sf_dir))


def win17_marker_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.placed_markers(ordered.numbered(S.observations(spark, sf_dir)), 620.0, 620.0)


def win17_protected_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, off boxes beside the first text of every line of three, which hold no text themselves."""
    obs = S.observations(spark, sf_dir)
    guarded = obs.where(F.col("x0") % 30 == 0).select("doc_id", "page_index", (F.col("x1") + 10).alias("x0"), (F.col("y0") - 20).alias("y0"), (F.col("x1") + 40).alias("x1"), (F.col("y0") + 5).alias("y1"))
    return L.placed_markers(ordered.numbered(obs), 620.0, 620.0, guarded)


def win18_marker_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.candidate_markers(ordered.numbered(S.observations(spark, sf_dir)), 620.0, 620.0)


@query(f"""{OBS} SELECT a.doc_id, a.page_index, a.observation_id AS left_id, b.observation_id AS right_id FROM obs a JOIN obs b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.observation_id < b.observation_id
  AND sqrt(pow(a.x0 - b.x0, 2) + pow(a.y0 - b.y0, 2)) < 24""")
def win19_marker_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers that an operator put at the corner of each text."""
    return L.marker_overlaps(S.observations(spark, sf_dir).withColumnsRenamed({"x0": "cx", "y0": "cy"}))


# Order-dependent within a page, so SQL has no short form; tests hold them against brute force.  Placement compares every candidate place with the whole page.
QUERIES.update({f.__name__: f for f in (win17_marker_placement, win17_protected_placement, win18_marker_choice)})
