"""Review state: coverage, sources, signals, lineage, status and access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage_report(entries: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts and a verdict for each document: every expected observation has one entry, and none is unresolved.

    entries (doc_id, observation_id, disposition, requires_confirmation), expected (doc_id, observation_id).
    """
    seen = entries.groupBy("doc_id", "observation_id").agg(
        F.count("*").alias("n"), F.max((F.col("disposition") == "uncovered").cast("int")).alias("unresolved"), F.max(F.coalesce("requires_confirmation", F.lit(True)).cast("int")).alias("review")
    )
    both = expected.select("doc_id", "observation_id", F.lit(1).alias("_e")).join(seen, ["doc_id", "observation_id"], "full_outer")
    out = both.groupBy("doc_id").agg(
        F.count("_e").alias("expected"),
        F.count_if(F.col("_e").isNotNull() & F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("_e").isNull()).alias("unexpected"),
        F.count_if(F.col("n") > 1).alias("duplicated"),
        F.count_if(F.col("unresolved") == 1).alias("blocking"),
        F.count_if(F.col("review") == 1).alias("review_required"),
    )
    return out.withColumn("passed", (F.col("missing") + F.col("unexpected") + F.col("duplicated") + F.col("blocking")) == 0)


def owner_conflicts(candidates: DataFrame) -> DataFrame:
    """Sources that more than one candidate of a document claims."""
    each = candidates.select("doc_id", "candidate_id", F.explode("source_ids").alias("source_id"))
    return each.groupBy("doc_id", "source_id").agg(F.count_distinct("candidate_id").alias("owners")).where("owners > 1")


def first_source_geometry(items: DataFrame, geometry: DataFrame) -> DataFrame:
    """Each item's geometry: that of the first of its sources, in list order, that exists; null where none does."""
    each = items.select("item_id", F.posexplode("source_ids").alias("pos", "observation_id"))
    found = each.join(geometry, "observation_id").groupBy("item_id").agg(F.min_by(F.struct("observation_id", "x0", "y0"), "pos").alias("g"))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", "g.*")


def associated_text(visuals: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct texts of a visual's associated ids, in list order, joined by spaces."""
    each = visuals.select("visual_id", F.posexplode("text_ids").alias("pos", "observation_id")).join(texts, "observation_id")
    first = each.groupBy("visual_id", "raw_text").agg(F.min("pos").alias("pos"))
    return first.groupBy("visual_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw_text"))), lambda x: x["raw_text"]), " ").alias("text"))


def weakest_signal(candidates: DataFrame, signals: DataFrame) -> DataFrame:
    """The least signal of a candidate's sources, and whether one is missing, doubled or out of range."""
    per_source = signals.groupBy("source_id").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    each = candidates.select("candidate_id", F.explode("source_ids").alias("source_id")).join(per_source, "source_id", "left")
    bad = F.col("n").isNull() | (F.col("n") > 1) | ~F.col("value").between(0, 1)
    return each.groupBy("candidate_id").agg(F.min("value").alias("signal"), F.bool_or(F.coalesce(bad, F.lit(True))).alias("invalid"))


# Lower limits of the confidence bands.
HIGH, MEDIUM = 0.95, 0.70


def confidence(signal: Column, eligible: Column, clean: Column) -> Column:
    """Struct (band, disposition): high or medium need an eligible candidate with a valid signal, medium nothing else against it."""
    band = F.when(~eligible | signal.isNull() | (signal < MEDIUM), "low").when((signal >= HIGH) & clean, "high").when(clean, "medium").otherwise("low")
    return F.struct(band.alias("band"), F.when(band == "high", "auto_accepted").otherwise("review_required").alias("disposition"))


def predecessors(docs: DataFrame, key: str, order: list[str], id_col: str) -> DataFrame:
    """Each document's predecessor under its key, and how many successors it has (self-join on the link)."""
    linked = docs.withColumn("predecessor", F.lag(id_col).over(Window.partitionBy(key).orderBy(*order)))
    counts = linked.where("predecessor is not null").groupBy(F.col("predecessor").alias("_p")).agg(F.count("*").alias("successors"))
    return linked.join(counts, F.col(id_col) == F.col("_p"), "left").select(id_col, key, "predecessor", F.coalesce("successors", F.lit(0)).alias("successors"))
