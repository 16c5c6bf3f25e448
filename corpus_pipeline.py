"""A training corpus from the documents table, in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caliperlake.llm import near_dedup, packing, pii, repeats, toxicity
from caliperlake.llm.common import materialise, same, tokenizer_path


def _with_text(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs, with the length that the changed text has."""
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return changed.select(*(length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier accepts; it is fitted on the labelled ones among docs."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.toxic_score(F.col("text"), model) < toxicity.THRESHOLD)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates; where rows repeat this id, the one whose text has the least hash, once.

    Documents without words are in no group and stay, and so do those without an id, which cannot be the least; repeated rows of one count once.
    """
    found = near_dedup.near_duplicates(docs, detail=True)
    own = F.when(F.col("doc_id").isNull() | F.col("group_key").isNull(), F.col("text_hash"))
    kept = found.where("kept").groupBy("doc_id", "group_key", own.alias("own")).agg(F.min("text_hash").alias("_hash"))
    kept = kept.select(F.col("doc_id").alias("_kept"), "_hash").distinct().hint("shuffle_hash")
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(kept, same(docs["doc_id"], kept["_kept"]) & (text == kept["_hash"]), "left_semi")
    row = joined.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("id"), text.alias("hash"))
    first = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(0)))
    return row.withColumn("k", first).where("k = 1").select("row.*")


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings that occur more than once."""
    return _with_text(docs, repeats.remove_repeats(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each piece of personal data in its place."""
    return _with_text(docs, docs.withColumn("text", pii.redact(F.col("text"))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and the sequences that they fill."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("suffix_array_dedup", drop_repeated_strings),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
