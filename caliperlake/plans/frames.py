"""Queries of the tolerance-frame operators over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlake.operators import frames as R
from caliperlake.plans.inspection import OBS
from caliperlake.plans.register import query
from caliperlake.sources import adapters as S

_SEGMENTS = f"""{S.PATHS_SQL}, lines AS (SELECT doc_id, page_index, ax, ay, bx, "by" FROM paths WHERE op = 'l' UNION ALL SELECT doc_id, page_index, unnest([ax, bx, bx, ax]), unnest([ay, ay, "by", "by"]), unnest([bx, bx, ax, ax]), unnest([ay, "by", "by", ay]) FROM paths WHERE op = 're' AND ax <= bx AND ay <= "by"),
segs AS (SELECT doc_id, page_index, 'horizontal' AS o, (ay + "by") / 2 AS c, least(ax, bx) AS s, greatest(ax, bx) AS e FROM lines WHERE abs("by" - ay) <= 0.25 AND abs(bx - ax) > 0.25
  UNION ALL SELECT doc_id, page_index, 'vertical', (ax + bx) / 2, least(ay, "by"), greatest(ay, "by") FROM lines WHERE abs(bx - ax) <= 0.25 AND abs("by" - ay) > 0.25)"""
_JOINED = f"""WITH RECURSIVE {_SEGMENTS}, ns AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, o ORDER BY c, s, e) AS n FROM segs),
j AS (SELECT doc_id, page_index, o, n, 1 AS g, c, s, e FROM ns WHERE n = 1 UNION ALL
  SELECT x.doc_id, x.page_index, x.o, x.n, CASE WHEN abs(j.c - x.c) <= 0.25 AND x.s <= j.e + 1.5 THEN j.g ELSE j.g + 1 END, CASE WHEN abs(j.c - x.c) <= 0.25 AND x.s <= j.e + 1.5 THEN (j.c + x.c) / 2 ELSE x.c END,
    CASE WHEN abs(j.c - x.c) <= 0.25 AND x.s <= j.e + 1.5 THEN least(j.s, x.s) ELSE x.s END, CASE WHEN abs(j.c - x.c) <= 0.25 AND x.s <= j.e + 1.5 THEN greatest(j.e, x.e) ELSE x.e END
  FROM j JOIN ns x ON x.doc_id = j.doc_id AND x.page_index = j.page_index AND x.o = j.o AND x.n = j.n + 1),
joined AS (SELECT doc_id, page_index, o, arg_max(c, n) AS c, arg_max(s, n) AS s, arg_max(e, n) AS e FROM j GROUP BY doc_id, page_index, o, g)"""
_FRAMES = f"""{_JOINED}, h AS (SELECT * FROM joined WHERE o = 'horizontal'), v AS (SELECT * FROM joined WHERE o = 'vertical'),
pairs AS (SELECT t.doc_id, t.page_index, t.c AS y0, t.s AS ts, t.e AS te, b.c AS y1, b.s AS bs, b.e AS be FROM h t JOIN h b ON t.doc_id = b.doc_id AND t.page_index = b.page_index AND b.c - t.c BETWEEN 6 AND 48),
found AS (SELECT p.doc_id, p.page_index, y0, y1, ts, te, bs, be, list(v.c ORDER BY v.c) AS xs, bool_or(v.s < y0 - 0.25 OR v.e > y1 + 0.25) AS outside FROM pairs p JOIN v ON v.doc_id = p.doc_id AND v.page_index = p.page_index AND v.s <= y0 + 0.25 AND v.e >= y1 - 0.25 GROUP BY ALL),
cells AS (SELECT *, list_reduce(list_transform(xs, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] > 0.25 THEN list_concat(a, b) ELSE list_concat(a[:-2], [(a[-1] + b[1]) / 2]) END) AS cells FROM found WHERE NOT outside),
fits AS (SELECT DISTINCT doc_id, page_index, cells[1] AS x0, y0, cells[-1] AS x1, y1, cells FROM cells WHERE len(cells) >= 3 AND cells[-1] - cells[1] BETWEEN 12 AND 240 AND ts <= cells[1] + 0.25 AND te >= cells[-1] - 0.25 AND bs <= cells[1] + 0.25 AND be >= cells[-1] - 0.25),
framed AS (SELECT f.*, left(sha256(page_index || ':' || list_aggregate(list_transform(list_concat([x0, y0, x1, y1], cells), lambda q: CAST(CAST(round(q * 1000) AS BIGINT) AS VARCHAR)), 'string_agg', ',')), 24) AS frame_id FROM fits f
  WHERE (SELECT count(*) FROM h WHERE h.doc_id = f.doc_id AND h.page_index = f.page_index AND h.c BETWEEN y0 - 0.25 AND y1 + 0.25 AND h.s <= x0 + 0.25 AND h.e >= x1 - 0.25) = 2)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frames(R.axis_segments(S.path_items(spark, sf_dir)))


@query(f"WITH {_SEGMENTS} SELECT doc_id, page_index, o AS orientation, count(*) AS segments, sum(c) AS coordinates, sum(e - s) AS length FROM segs GROUP BY ALL")
def src10_axis_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.axis_segments(S.path_items(spark, sf_dir)).groupBy("doc_id", "page_index", "orientation").agg(F.count("*").alias("segments"), F.sum("coordinate").alias("coordinates"), F.sum(F.col("end") - F.col("start")).alias("length"))


@query(f'{_JOINED} SELECT doc_id, page_index, o AS orientation, c AS coordinate, s AS start, e AS "end" FROM joined')
def win04_joined_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.joined_segments(R.axis_segments(S.path_items(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_SEGMENTS}, d AS (SELECT doc_id, page_index, list(c ORDER BY c) AS xs FROM segs WHERE o = 'vertical' GROUP BY ALL)
  SELECT doc_id, page_index, len(r) AS positions, r[-1] AS last FROM (SELECT doc_id, page_index, list_reduce(list_transform(xs, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] > 0.25 THEN list_concat(a, b) ELSE list_concat(a[:-2], [(a[-1] + b[1]) / 2]) END) AS r FROM d)""")
def win07_deduped_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    steep = R.axis_segments(S.path_items(spark, sf_dir)).where("orientation = 'vertical'")
    kept = steep.groupBy("doc_id", "page_index").agg(R.deduped_positions(F.collect_list("coordinate")).alias("kept"))
    return kept.select("doc_id", "page_index", F.size("kept").alias("positions"), F.element_at("kept", -1).alias("last"))


@query(f"{_FRAMES} SELECT doc_id, page_index, frame_id, x0, y0, x1, y1, len(cells) - 1 AS n_cells FROM framed")
def grp05_join26_tolerance_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("doc_id", "page_index", "frame_id", "x0", "y0", "x1", "y1", (F.size("cells") - 1).alias("n_cells"))


_PLACED = f"""{_FRAMES}, {S.OBSERVATIONS_SQL}, inside AS (SELECT f.doc_id, f.page_index, frame_id, observation_id, t.x0 AS tx, t.y0 AS ty, coalesce(list_filter(range(len(cells) - 1), lambda i: (t.x0 + t.x1) / 2 <= cells[i + 2])[1], len(cells) - 2) AS cell
  FROM framed f JOIN obs t ON t.doc_id = f.doc_id AND t.page_index = f.page_index AND (((t.x0 + t.x1) / 2 BETWEEN f.x0 - 1.5 AND f.x1 + 1.5 AND (t.y0 + t.y1) / 2 BETWEEN f.y0 - 1.5 AND f.y1 + 1.5)
    OR greatest(0.0, least(t.x1, f.x1 + 1.5) - greatest(t.x0, f.x0 - 1.5)) * greatest(0.0, least(t.y1, f.y1 + 1.5) - greatest(t.y0, f.y0 - 1.5)) >= 0.5 * (t.x1 - t.x0) * (t.y1 - t.y0)))"""


@query(f"{_PLACED} SELECT doc_id, page_index, frame_id, observation_id AS text_id, CAST(cell AS INT) AS cell, CAST(row_number() OVER (PARTITION BY doc_id, page_index, frame_id ORDER BY cell, ty, tx, observation_id) AS INT) AS place FROM inside")
def join04_frame_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frame_texts(_frames(spark, sf_dir), S.observations(spark, sf_dir))


@query(f"{_PLACED} SELECT doc_id, page_index, frame_id FROM framed f WHERE NOT EXISTS (SELECT 1 FROM inside i JOIN obs o ON o.doc_id = i.doc_id AND o.observation_id = i.observation_id WHERE i.doc_id = f.doc_id AND i.page_index = f.page_index AND i.frame_id = f.frame_id AND o.x0 >= 400)")
def join36_frames_outside_administration(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs, found = S.observations(spark, sf_dir), _frames(spark, sf_dir)
    administrative = obs.where("x0 >= 400").withColumnRenamed("observation_id", "text_id")
    return R.without_administrative(found, R.frame_texts(found, obs), administrative).select("doc_id", "page_index", "frame_id")


# Tokens of sample frames; the sixteenth symbol has no meaning.
_SYMBOLS = ("⏤", "⏥", "○", "⌭", "⌒", "⌓", "∠", "⊥", "∥", "⌖", "◎", "⌯", "↗", "⌰", "▱", "X")
_TYPES = (
    "straightness", "flatness", "circularity", "cylindricity", "profile_of_line", "profile_of_surface", "angularity", "perpendicularity",
    "parallelism", "position", "concentricity_or_coaxiality", "symmetry", "circular_runout", "total_runout", "flatness", "position",
)
_VALUES, _LETTERS, _DATUMS = ("0.05", "⌀0.1", "Ø 0.02", "abc", "+.5"), ("M", "L", "S", "⌀", "Q", " M "), ("A", "B", "AB", "C")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, part, qty = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity").cast("int")
    cell = lambda role, token: F.struct(F.lit(role).alias("role"), token.alias("token"))
    cells = F.array(
        cell("symbol", S.pick(_SYMBOLS, part % 16)), F.when(key % 2 == 0, cell("separator", F.lit("|"))), cell("tolerance", S.pick(_VALUES, qty % 5)), F.when(key % 3 == 0, cell("modifier", S.pick(_LETTERS, part % 6))),
        F.when(key % 5 != 0, cell("datum", S.pick(_DATUMS, key % 4))), F.when(key % 7 == 0, cell("datum", F.lit("D"))), F.when(key % 13 == 0, cell("modifier", F.lit("M"))),
    )
    signal = F.when(part % 17 == 0, "unknown").when(part % 19 == 0, "flatness").otherwise(S.pick(_TYPES, part % 16))
    return S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), key.alias("frame"), part.alias("part"), S.row_ident().alias("segment_id"), F.array_compact(cells).alias("cells"), signal.alias("signal"))


_SEGMENT_SQL = f"""e AS (SELECT l_suppkey AS doc_id, l_orderkey AS frame, l_partkey AS part, {S.IDENT_SQL} AS segment_id, list_filter([{{'role': 'symbol', 'token': {S.pick_sql(_SYMBOLS, 'l_partkey % 16')}}}, CASE WHEN l_orderkey % 2 = 0 THEN {{'role': 'separator', 'token': '|'}} END,
    {{'role': 'tolerance', 'token': {S.pick_sql(_VALUES, 'CAST(l_quantity AS INT) % 5')}}}, CASE WHEN l_orderkey % 3 = 0 THEN {{'role': 'modifier', 'token': {S.pick_sql(_LETTERS, 'l_partkey % 6')}}} END, CASE WHEN l_orderkey % 5 <> 0 THEN {{'role': 'datum', 'token': {S.pick_sql(_DATUMS, 'l_orderkey % 4')}}} END,
    CASE WHEN l_orderkey % 7 = 0 THEN {{'role': 'datum', 'token': 'D'}} END, CASE WHEN l_orderkey % 13 = 0 THEN {{'role': 'modifier', 'token': 'M'}} END], lambda c: c IS NOT NULL) AS cells,
    CASE WHEN l_partkey % 17 = 0 THEN 'unknown' WHEN l_partkey % 19 = 0 THEN 'flatness' ELSE {S.pick_sql(_TYPES, 'l_partkey % 16')} END AS signal, CASE WHEN l_partkey % 16 < 15 THEN {S.pick_sql(_TYPES, 'l_partkey % 16')} END AS kind FROM lineitem),
f AS (SELECT *, list_filter(cells, lambda c: c.role <> 'separator') AS c2 FROM e), g AS (SELECT *, c2[3:] AS rest, list_transform(c2[3:], lambda c: c.role) AS roles, translate(trim(c2[2].token), '∅Ø', '⌀⌀') AS t FROM f),
k AS (SELECT *, starts_with(t, '⌀') AS lead, nullif(regexp_extract(trim(ltrim(t, '⌀')), '^\\+?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)$', 1), '') AS num,
  list_filter(list_transform(rest, lambda c, i: CASE WHEN c.role = 'modifier' AND list_contains(roles[:i - 1], 'datum') THEN 'gdt_projection_conflict' WHEN c.role = 'modifier' AND trim(c.token) IN ('⌀', '∅', 'Ø', 'M', 'L', 'S') THEN NULL WHEN c.role = 'modifier' THEN 'gdt_modifier_unknown'
    WHEN c.role <> 'datum' THEN 'gdt_projection_conflict' WHEN NOT regexp_full_match(trim(c.token), '[A-Z]') THEN 'gdt_datum_association_ambiguous' END), lambda x: x IS NOT NULL)[1] AS bad FROM g),
seg AS (SELECT *, CASE WHEN kind IS NULL OR signal = 'unknown' THEN 'gdt_symbol_unknown' WHEN kind <> signal THEN 'gdt_projection_conflict' WHEN num IS NULL OR CAST(num AS DOUBLE) <= 0 THEN 'gdt_value_missing' ELSE bad END AS code,
  lead OR len(list_filter(rest, lambda c: c.role = 'modifier' AND trim(c.token) IN ('⌀', '∅', 'Ø'))) > 0 AS dia, list_transform(list_filter(rest, lambda c: c.role = 'modifier' AND trim(c.token) NOT IN ('⌀', '∅', 'Ø')), lambda c: trim(c.token)) AS mods,
  list_transform(list_filter(rest, lambda c: c.role = 'datum'), lambda c: trim(c.token)) AS dats FROM k),
txt AS (SELECT *, CASE WHEN dia THEN '⌀' ELSE '' END || num || CASE WHEN len(mods) > 0 THEN ' ' || array_to_string(mods, ' ') ELSE '' END AS v FROM seg)"""


@query(f"WITH {_SEGMENT_SQL} SELECT doc_id, segment_id, code, CASE WHEN code IS NULL THEN kind END AS tolerance_type, CASE WHEN code IS NULL THEN num END AS value, CASE WHEN code IS NULL THEN dia END AS diameter, CASE WHEN code IS NULL THEN array_to_string(mods, ' ') END AS modifiers, CASE WHEN code IS NULL THEN array_to_string(dats, ' ') END AS datums FROM seg")
def par05_06_tolerance_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.tolerance_segments(_evidence(spark, sf_dir))
    return found.select("doc_id", "segment_id", "code", "tolerance_type", "value", "diameter", F.array_join("modifiers", " ").alias("modifiers"), F.array_join("datums", " ").alias("datums"))


_LABELS = ("直线度", "平面度", "圆度", "圆柱度", "线轮廓度", "面轮廓度", "倾斜度", "垂直度", "平行度", "位置度", "同心度 / 同轴度", "对称度", "圆跳动", "全跳动")


@query(f"""WITH {_SEGMENT_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, frame ORDER BY segment_id) AS n, array_to_string(list_concat([v], dats), ' | ') AS plain, CASE WHEN len(dats) = 1 THEN v || ' | 基准 ' || dats[1] ELSE array_to_string(list_concat([v], dats), ' | ') END AS sheet FROM txt),
p AS (SELECT *, coalesce(code, CASE WHEN len(list_filter(list(CASE WHEN code IS NULL THEN kind END) OVER (PARTITION BY doc_id, frame ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda q: q <> kind)) > 0 THEN 'gdt_projection_conflict' END) AS c FROM o),
q AS (SELECT doc_id, frame, arg_min(c, n) FILTER (c IS NOT NULL) AS code, arg_min(kind, n) AS kind, string_agg(plain, ' / ' ORDER BY n) AS plain, string_agg(sheet, ' / ' ORDER BY n) AS sheet FROM p GROUP BY ALL)
SELECT doc_id, frame, code, CASE WHEN code IS NULL THEN kind END AS tolerance_type, CASE WHEN code IS NULL THEN {S.pick_sql(_SYMBOLS[:14], f"list_position({list(_TYPES[:14])}, kind) - 1")} || ' | ' || plain END AS normalized_text, CASE WHEN code IS NULL THEN {S.pick_sql(_LABELS, f"list_position({list(_TYPES[:14])}, kind) - 1")} || ' | ' || sheet END AS sheet_text FROM q""")
def par07_tolerance_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tolerance_texts(R.tolerance_segments(_evidence(spark, sf_dir)), "frame", "segment_id")


@query(f"""WITH {_SEGMENT_SQL} SELECT segment_id, CASE WHEN part % 23 = 0 THEN 'tolerance_symbol' WHEN frame % 11 = 0 THEN 'tolerance_value' WHEN frame % 17 = 0 AND NOT dia THEN 'diameter_modifier' WHEN frame % 29 = 0 AND len(mods) > 0 THEN 'modifiers' WHEN part % 31 = 0 THEN 'datum_references' WHEN part % 37 = 0 THEN 'normalized_text' END AS code FROM txt WHERE code IS NULL""")
def chk14_tolerance_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tolerances, some of them tampered with, against what their segment says."""
    from caliperlake.functions import tolerances as T

    key, part = F.col("frame"), F.col("part")
    good = R.tolerance_segments(_evidence(spark, sf_dir)).where("code is null")
    good = good.withColumn("normalized_text", F.concat(T.symbol_of(F.col("tolerance_type")), F.lit(" | "), T.segment_text(F.struct("value", "diameter", "modifiers", "datums"))))
    stored = good.withColumns({
        "symbol": F.when(part % 23 == 0, "?").otherwise(T.symbol_of(F.col("tolerance_type"))), "stored_value": F.when(key % 11 == 0, F.concat("value", F.lit("0"))).otherwise(F.col("value")), "stored_diameter": F.col("diameter") | (key % 17 == 0),
        "stored_modifiers": F.when(key % 29 == 0, F.array().cast("array<string>")).otherwise(F.col("modifiers")), "stored_datums": F.when(part % 31 == 0, F.concat("datums", F.array(F.lit("Z")))).otherwise(F.col("datums")), "stored_text": F.when(part % 37 == 0, F.lit("")).otherwise(F.col("normalized_text")),
    })
    return stored.select("segment_id", R.envelope_code(stored).alias("code"))


@query(f"""WITH r AS (SELECT {S.IDENT_SQL} AS frame_id, l_orderkey AS k, l_partkey AS p, CAST(l_quantity AS INT) AS q, 2 + l_linenumber % 2 AS n FROM lineitem), c AS (SELECT *, CASE WHEN k % 11 = 0 THEN n - 1 ELSE n END AS m FROM r)
SELECT frame_id, CASE WHEN k % 23 = 0 THEN 'frame_id_not_found' WHEN p % 41 = 0 THEN 'crop_bbox_invalid' WHEN k % 19 = 0 THEN 'frame_bbox_invalid' WHEN k % 17 = 0 THEN 'frame_bbox_out_of_bounds' WHEN k % 13 = 0 THEN 'cell_index_not_contiguous' WHEN k % 11 = 0 THEN 'cell_count_mismatch'
  WHEN p % 11 = 0 THEN 'cell_bbox_out_of_frame' WHEN q % 10 = 0 THEN 'text_id_not_allowlisted' WHEN k % 5 = 0 THEN 'cell_token_invalid' WHEN p % 13 = 0 THEN 'cell_bbox_invalid' WHEN p % 7 = 0 THEN 'cell_bbox_mismatch' END AS code FROM c""")
def cls17_frame_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised frames, some with one thing wrong: the first two kinds of faults in the first cell, others in the second."""
    key, part, qty = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity").cast("int")
    n = (2 + F.col("l_linenumber") % 2).cast("int")
    x, y = (part % 50 * 10).cast("double"), (key % 40 * 15).cast("double")
    box = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    lit, places = (lambda v: F.lit(float(v))), F.sequence(F.lit(0), n - 1)
    crop = box(x, y, F.when(part % 41 == 0, x).otherwise(x + 100), y + 50)
    proposal = F.struct(box(x + 10, y + 10, x + 90, y + 40).alias("box"), F.transform(places, lambda i: box(x + 10 + 80 * i / n, y + 10, x + 10 + 80 * (i + 1) / n, y + 40)).alias("cells"), F.array(F.lit("a"), F.lit("b")).alias("text_ids"))

    def cell(i):
        left = F.when((part % 7 == 0) & (i == 1), lit(0.1)).otherwise(0.1 + 0.8 * i / n)
        return F.struct(
            (i + F.when(key % 13 == 0, 1).otherwise(0)).alias("index"),
            box(left, F.when((part % 11 == 0) & (i == 0), lit(0.1)).otherwise(lit(0.2)), 0.1 + 0.8 * (i + 1) / n, F.when((part % 13 == 0) & (i == 1), lit(-1)).otherwise(lit(0.8))).alias("box"),
            F.when(i == 0, "datum").otherwise("symbol").alias("role"),
            F.when(key % 5 == 0, " ").otherwise("A").alias("token"),
            F.when(qty % 10 == 0, F.array(F.lit("zz"))).otherwise(F.array(F.lit("b"))).alias("text_ids"),
        )

    cells = F.transform(F.slice(places, F.lit(1), F.when(key % 11 == 0, n - 1).otherwise(n)), cell)
    frame = box(lit(0.1), F.when(key % 17 == 0, lit(0.05)).otherwise(lit(0.2)), F.when(key % 19 == 0, lit(1.5)).otherwise(lit(0.9)), lit(0.8))
    rows = S.table(spark, sf_dir, "lineitem").select(S.row_ident().alias("frame_id"), (key % 23 != 0).alias("found"), F.struct(frame.alias("box"), cells.alias("cells")).alias("evidence"), proposal.alias("proposal"), crop.alias("crop"))
    return rows.select("frame_id", R.evidence_code(F.col("found"), F.col("evidence"), F.col("proposal"), F.col("crop")).alias("code"))


@query(f"{OBS} SELECT doc_id, page_index, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM obs GROUP BY ALL")
def geo05_union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caliperlake.operators.spatial import union_boxes

    return union_boxes(S.observations(spark, sf_dir), ["doc_id", "page_index"])
