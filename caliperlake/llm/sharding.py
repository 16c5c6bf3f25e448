"""Sharding by extendible hashing, in DataFrame operations only.

A document's address is the bits of a hash of its id.  The directory starts at depth 0; a bucket
over the byte limit, and no other, is split on one more bit.  The bytes are summed once on
prefixes of ``grain`` bits; all shallower buckets are sums of those cells, and only cells still over the
limit are looked at again with more bits.

Defined results: a null text has 0 bytes; a null id hashes as the empty string; rows with equal ids
always share a shard, so a shard of one id alone may pass the limit: it ends at the last bit with
``over_limit`` true.  An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, same, text_or_empty

BITS = 56  # of the MD5 digest; fits a positive long


def address(key: Column) -> Column:
    """The leading bits of the MD5 of the id's text, as a long that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def prefix(code: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", code, (F.lit(BITS) - depth).cast("int"))


def _leaves(cells: DataFrame, fine: int, low: int, limit: int) -> DataFrame:
    """cells (cell, bytes) on ``fine`` bits -> (cell, depth) with the least depth >= low whose bucket fits; null where none does.

    Each round halves nothing but the addresses: a roll-up over all depths at once, on sums only.
    """
    every = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(fine))).alias("depth"))
    every = every.withColumn("bucket", F.call_function("shiftright", F.col("cell"), (F.lit(fine) - F.col("depth")).cast("int")))
    fits = every.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bucket_bytes")).where(F.col("bucket_bytes") <= limit).drop("bucket_bytes")
    least = every.join(fits, ["depth", "bucket"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.join(least, "cell", "left").select("cell", "depth")


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", step: int = 6) -> DataFrame:
    """``id_col``, n_bytes, depth, shard (bits of the address, as text), shard_bytes and over_limit of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.octet_length(text_or_empty(text_col)).cast("bigint").alias("n_bytes")).withColumn("_code", address(F.col("_id")))
    rows = materialise(rows, "shard_rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    fine = min(BITS, max(step, math.ceil(math.log2(max(2.0, total / limit))) + step))
    # The directory: (fine bits, cell, depth).  Its first part has about 2**step cells a shard.
    directory, low, open_rows = None, 0, rows
    while True:
        cells = open_rows.groupBy(prefix(F.col("_code"), fine).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        found = materialise(_leaves(cells, fine, low, limit), "shard_leaves")
        last = fine >= BITS
        done = found if last else found.where("depth is not null")
        part = done.select(F.lit(fine).alias("fine"), "cell", F.coalesce("depth", F.lit(BITS)).alias("depth"))
        directory = part if directory is None else directory.unionByName(part)
        rest = found.where("depth is null").select(F.col("cell").alias("_open"))
        if last or rest.isEmpty():
            break
        open_rows = open_rows.join(rest, prefix(F.col("_code"), fine) == F.col("_open"), "left_semi")
        low, fine = fine + 1, min(BITS, fine + step)
    # Each row meets its directory entry at the entry's own grain, a column of the directory itself.
    grains = sorted(r[0] for r in directory.select("fine").distinct().collect())  # at most BITS / step values
    looked = rows.withColumn("_fine", F.explode(F.array(*(F.lit(g) for g in grains)))) if len(grains) > 1 else rows.withColumn("_fine", F.lit(grains[0] if grains else fine))
    looked = looked.withColumn("_cell", prefix(F.col("_code"), F.col("_fine")))
    placed = looked.join(directory, (F.col("_fine") == F.col("fine")) & (F.col("_cell") == F.col("cell")), "inner")
    placed = placed.select("_id", "n_bytes", "depth", prefix(F.col("_code"), F.col("depth")).alias("_bucket"))
    sizes = placed.groupBy("depth", "_bucket").agg(F.sum("n_bytes").alias("shard_bytes"))
    out = placed.join(sizes, ["depth", "_bucket"])
    shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("_bucket"), F.col("depth"), F.lit("0")))
    return out.select(F.col("_id").alias(id_col), "n_bytes", F.col("depth").cast("int").alias("depth"), shard.alias("shard"), "shard_bytes", (F.col("shard_bytes") > limit).alias("over_limit"))


def oracle(limit: int) -> str:
    """The same directory in SQL: for each row the least depth at which its bucket fits."""
    return f"""
WITH r AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}) AS BIGINT) AS code FROM documents),
e AS (SELECT r.*, d.depth, code >> ({BITS} - d.depth) AS bucket FROM r, (SELECT CAST(range AS INT) AS depth FROM range(0, 41)) d),
s AS (SELECT depth, bucket, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM e GROUP BY ALL),
p AS (SELECT e.*, s.shard_bytes, row_number() OVER (PARTITION BY e.doc_id ORDER BY e.depth) AS k
      FROM e JOIN s USING (depth, bucket) WHERE s.shard_bytes <= {limit})
SELECT doc_id, n_bytes, depth, CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 64) || bin(bucket), depth) END AS shard,
       shard_bytes, false AS over_limit FROM p WHERE k = 1"""


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows, one folder for each shard; a shard fits its limit, so one task holds it.  A column named shard gives way to the shard's own."""
    shards = assign_shards(docs.select(id_col, text_col), limit, id_col, text_col).select(F.col(id_col).alias("_sharded_id"), F.col("shard").alias("_shard")).dropDuplicates(["_sharded_id"])
    joined = docs.join(shards, same(docs[id_col], shards["_sharded_id"]), "inner")
    joined.select(*(docs[c] for c in docs.columns if c != "shard"), shards["_shard"].alias("shard")).repartition("shard").write.partitionBy("shard").parquet(path)
