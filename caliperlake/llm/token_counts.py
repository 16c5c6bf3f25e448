"""Token counts through a digest cache.

A text's key is the digest of its normalised content together with the digest of the
tokenizer file.  Keys are joined to the stored counts; only distinct keys without a count are
encoded, once each, and appended to the cache, a Parquet table that later runs read.  The cache may hold a digest more than once (two
writers at a time, a retried append); it counts once.

The registered query keeps its cache at the path that ``CACHE_SETTING`` names; without that setting each run has a cache of its own.

Defined results: a null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty
table; repeated rows each get their row, and their text is encoded once; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, materialise, same, scratch_path, slices, text_or_empty

CACHE_SETTING = "spark.caliperlake.tokenCache"
CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens bigint"
_ENCODED = "content_digest string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """SHA-256 of the normalised content.

    The tokenizer drops white space and folds case, so runs of white space become one space and
    ASCII texts are lower-cased.  Texts that may hold a special token's string stay as they are, under a
    prefix of their own.
    """
    plain = F.regexp_replace(F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(text), "[ \\n\\r\\t]+", " ")
    return F.sha2(F.when(F.instr(text, "<|") > 0, F.concat(F.lit("r:"), text)).otherwise(F.concat(F.lit("n:"), plain)), 256)


def _encoder(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo.of(path)
        for b in slices(batches):
            ids = memo.encode(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("_digest").cast(pa.string()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["content_digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", detail: bool = False) -> DataFrame:
    """``id_col``, n_bytes and n_tokens of every row, and with ``detail`` also cached: the count was stored before this run.  ``cache`` is the path of the stored counts."""
    spark, version, run = docs.sparkSession, tokenizer_digest(tokenizer), uuid.uuid4().hex
    cache = cache or scratch_path(spark, "token_cache")
    spark.createDataFrame([], CACHE_SCHEMA).coalesce(1).write.mode("append").parquet(cache)
    text = text_or_empty(text_col)
    # The only pass that digests texts.  A plain hash is enough to find the chosen row of an id again.
    keyed = docs.select(F.col(id_col).alias("_id"), content_digest(text).alias("_digest"), F.xxhash64(text).alias("_hash"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    keyed = materialise(keyed, "token_keys", compression="zstd")

    def stored() -> DataFrame:
        kept = spark.read.schema(CACHE_SCHEMA + ", run string").parquet(cache).where(F.col("tokenizer_digest") == version)
        return kept.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"), F.bool_or(~same(F.col("run"), F.lit(run))).alias("cached"))

    # One row for each distinct digest without a count, pre-aggregated before the shuffle, so a
    # text that a third of all rows share is one row here.
    missing = keyed.groupBy("_digest").agg(F.min(F.struct("_id", "_hash")).alias("_first"))
    missing = missing.join(stored(), F.col("_digest") == F.col("content_digest"), "left_anti")
    missing = missing.select("_digest", F.col("_first._id").alias("_first_id"), F.col("_first._hash").alias("_first_hash"))
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    chosen = texts.join(missing.hint("shuffle_hash"), (F.col("_hash") == F.col("_first_hash")) & same(F.col("_id"), F.col("_first_id")), "inner").select("_digest", "_text")
    encoded = chosen.mapInArrow(_encoder(tokenizer), _ENCODED).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    encoded.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens", F.lit(run).alias("run")).write.mode("append").parquet(cache)

    counts = stored().withColumnRenamed("content_digest", "_content")
    return keyed.join(counts, F.col("_digest") == F.col("_content"), "left").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", *(["cached"] if detail else []))
