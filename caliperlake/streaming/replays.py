"""Append of a stream to a stored log without replays, however late they come: no watermark bounds it.

Each batch writes a folder of its own number, so a batch that was killed and comes again replaces what it left; it compares
itself with the folders of earlier batches only.  The log is laid out by key buckets, and a batch reads just the buckets that its keys fall into.  A key's
first content is accepted, the same content again is a replay, any other a conflict; of two contents in one batch the one with the least hash counts as the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("accepted", "conflicts", "replays")


def _hash_schema(keys: str) -> str:
    return f"{keys}, content_sha string, n bigint, batch_id bigint, bucket int"


def stored(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """Rows of one part of the log over all batches; an empty table where nothing was written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{part}").parquet(f"{path}/{part}")


def append_once(path: str, keys: list[str], content: Column, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that adds the batch's rows to the log at ``path``; rows with a null key are ignored.

    The log holds, by batch and bucket, each new key with its rows (``accepted``), and keys, hash and count of all others (``conflicts``, ``replays``).
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        present = batch.where(" and ".join(f"{k} is not null" for k in keys))
        kinds = ", ".join(f"{k} {batch.schema[k].dataType.simpleString()}" for k in keys)
        key = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        # Columns only: the batch's contents are hashed once, and only keys, hashes and counts are compared.
        hashed = present.select(*keys, F.sha2(content.cast("string"), 256).alias("content_sha"), F.struct(*batch.columns).alias("row"))
        found = hashed.groupBy(*keys, "content_sha").agg(F.count("*").alias("n"), F.first("row").alias("row")).withColumn("bucket", key).persist()
        try:
            touched = [r.bucket for r in found.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            schema = _hash_schema(kinds)
            before = stored(spark, path, "accepted", schema).where((F.col("batch_id") < batch_id) & F.col("bucket").isin(touched)).select(*keys, F.col("content_sha").alias("_first"))
            own = found.groupBy(*keys).agg(F.min("content_sha").alias("_least"))
            judged = found.join(own, keys).join(before, keys, "left").withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            first = F.coalesce("_first", "_least")
            new = F.col("_first").isNull() & (F.col("content_sha") == F.col("_least"))
            rows = {
                "accepted": judged.where(new).select(*keys, "content_sha", F.lit(1).cast("bigint").alias("n"), "batch_id", "bucket", "row"),
                "conflicts": judged.where(F.col("content_sha") != first).select(*keys, "content_sha", "n", "batch_id", "bucket"),
                "replays": judged.where(F.col("content_sha") == first).withColumn("n", F.col("n") - new.cast("int")).where("n > 0").select(*keys, "content_sha", "n", "batch_id", "bucket"),
            }
            # The accepted rows come last: a batch killed before them is whole again when it comes again, and its own folders are never read for it.
            for part in reversed(PARTS):
                rows[part].drop("batch_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{part}/batch_id={batch_id}")
        finally:
            found.unpersist()

    return run


def replay_result(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """Each key of the log with n_rows, kinds and conflict: what the batch operator says of all rows together.  keys: columns with their types."""
    names, schema = [k.split()[0] for k in keys.split(", ")], _hash_schema(keys)
    whole = stored(spark, path, PARTS[0], schema)
    for part in PARTS[1:]:
        whole = whole.unionByName(stored(spark, path, part, schema))
    return whole.groupBy(*names).agg(F.sum("n").alias("n_rows"), F.count_distinct("content_sha").alias("kinds")).withColumn("conflict", F.col("kinds") > 1)
