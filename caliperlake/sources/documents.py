"""Sources and sinks: nested inventories, recognition responses, call records, sheet rows on disk.

Schemas are closed and given, never inferred.  Rows that break a rule come back beside the good ones, with a reason, instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caliperlake.functions.geometry import Box, Point, clip, from_rendered
from caliperlake.functions.text import formula_like

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
INVENTORY = (
    "doc_id bigint, pages array<struct<page_index:int,width:double,height:double,rotation:int,"
    f"observations:array<struct<observation_id:string,source_type:string,observation_level:string,raw_text:string,bbox:{BOX},confidence:double>>,"
    f"visual_observations:array<struct<observation_id:string,bbox:{BOX},text_ids:array<string>>>>>"
)
RESPONSE = "struct<RequestId:string,TextDetections:array<struct<DetectedText:string,Confidence:double,Polygon:array<struct<X:double,Y:double>>>>>"
#: Names that a call record must not hold.
FORBIDDEN = ("authorization", "api_key", "secret", "base64")


def inventories(spark: SparkSession, path: str) -> DataFrame:
    """Nested page inventories; lines that are not such JSON keep their text in ``_corrupt_record``."""
    return spark.read.schema(INVENTORY + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def pages_of(inventory: DataFrame) -> DataFrame:
    return inventory.select("doc_id", F.inline("pages")).drop("observations", "visual_observations")


def observations_of(inventory: DataFrame) -> DataFrame:
    each = inventory.select("doc_id", F.explode("pages").alias("p"))
    return each.select("doc_id", F.col("p.page_index").alias("page_index"), F.explode("p.observations").alias("o")).select("doc_id", "page_index", "o.*")


def visual_observations_of(inventory: DataFrame) -> DataFrame:
    each = inventory.select("doc_id", F.explode("pages").alias("p"))
    return each.select("doc_id", F.col("p.page_index").alias("page_index"), F.explode("p.visual_observations").alias("v")).select("doc_id", "page_index", "v.*")


def recognised(responses: DataFrame, body: str = "body") -> DataFrame:
    """One row per detected text, or one with a reason where the response or the detection is not valid.

    Kept columns: all of responses but the body, then request_id, raw_text, confidence, x0, y0, x1, y1, reason.
    """
    rest = [c for c in responses.columns if c != body]
    df = responses.withColumn("_r", F.from_json(body, RESPONSE))
    df = df.select(*rest, F.col("_r.RequestId").alias("request_id"), F.explode_outer("_r.TextDetections").alias("_d"))
    xs, ys = F.transform("_d.Polygon", lambda p: p["X"]), F.transform("_d.Polygon", lambda p: p["Y"])
    reason = (
        F.when(F.col("request_id").isNull() | (F.trim("request_id") == ""), "missing_request_id")
        .when(F.col("_d").isNull(), "no_detection")
        .when(F.col("_d.DetectedText").isNull() | (F.trim("_d.DetectedText") == ""), "blank_text")
        .when(F.col("_d.Confidence").isNull() | ~F.col("_d.Confidence").between(0, 100), "confidence_out_of_range")
        .when(F.coalesce(F.size("_d.Polygon"), F.lit(0)) != 4, "polygon_not_four_points")
    )
    good = reason.isNull()
    return df.select(*rest, "request_id", F.col("_d.DetectedText").alias("raw_text"), F.col("_d.Confidence").alias("confidence"), *(F.when(good, v).alias(n) for n, v in (("x0", F.array_min(xs)), ("y0", F.array_min(ys)), ("x1", F.array_max(xs)), ("y1", F.array_max(ys)))), reason.alias("reason"))


def page_box(x: Column, y: Column, origin_x: Column, origin_y: Column, scale: Column) -> tuple[Column, Column]:
    """A point of a rendered crop on the page."""
    return origin_x + x / scale, origin_y + y / scale


def polygon_box(polygon: Column, origin: Point, rotation: Column, width: Column, height: Column, scale: float) -> Box:
    """The box on the page of a polygon (array of x, y) in pixels of a crop of the rendered page, cut to the page; null where nothing is left."""
    point = lambda p: from_rendered(rotation, width, height, Point((p["x"] + origin.x) / scale, (p["y"] + origin.y) / scale))
    xs, ys = F.transform(polygon, lambda p: point(p).x), F.transform(polygon, lambda p: point(p).y)
    zero = F.lit(0.0)
    return clip(Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)), Box(zero, zero, width, height))


def call_records(lines: DataFrame, fields: list[str], body: str = "body") -> DataFrame:
    """Records as maps with a reason where a field is missing, unknown or forbidden, or a counter negative."""
    df = lines.withColumn("record", F.from_json(body, "map<string,string>"))
    keys = F.map_keys("record")
    wanted = F.array(*(F.lit(f) for f in fields))
    bad = F.exists(keys, lambda k: F.lower(k).rlike("|".join(FORBIDDEN)))
    reason = (
        F.when(F.col("record").isNull(), "not_json")
        .when(bad, "forbidden_field")
        .when(F.size(F.array_except(wanted, keys)) > 0, "missing_field")
        .when(F.size(F.array_except(keys, wanted)) > 0, "unknown_field")
        .when(F.exists(F.map_values("record"), lambda v: v.rlike("^-[0-9]+$")), "negative_counter")
    )
    return df.withColumn("reason", reason)


def write_sheet_rows(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Detail rows, one folder for each document.  In text formats a text that a sheet would run as a formula gets a quote before it."""
    if fmt != "parquet":
        rows = rows.select(*(F.when(formula_like(F.col(c)), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes))
    rows.repartition("doc_id").write.partitionBy("doc_id").format(fmt).option("header", "true").save(path)
