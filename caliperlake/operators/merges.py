"""Outcome of a document's decisions that change one candidate: put together if they agree, all open if they do not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caliperlake.scratch import written

# Code of decisions that contradict one another, field that is the union of boxes and so never in conflict.
CONFLICT, PLACE_FIELD = "visual_projection_conflict", "coordinates"
_KEY, _BOX = ["doc_id", "existing"], ("x0", "y0", "x1", "y1")


def merge_outcomes(decisions: DataFrame, visuals: DataFrame, candidates: DataFrame) -> DataFrame:
    """All decisions: doc_id, decision, visual_id, disposition, code, candidate_id, requires_confirmation, signal, source_ids, x0 .. y1, fields, primary, truth_preserved.

    decisions: doc_id, decision (their order, unique in a document), visual_id, existing (id of the candidate that it changes; null: none), source_ids, x0 .. y1, disposition, code, candidate_id,
    requires_confirmation, signal, fields (names and JSON values; null: none); visuals: doc_id, visual_id, page_index, y0, x0; candidates: doc_id, candidate_id, fields.

    Decisions of one candidate with one list of sources are one projection, and its first decision with fields speaks for it.  Candidates with one projection keep their decisions as they are.  Several agree if each
    speaker is a candidate without a code, names that very candidate, and no field is changed to two values; a null value is a value.  The decision that is read first is primary and carries the candidate's fields
    with all changes; all carry the union of boxes and of sources: visuals in reading order, then texts in the order of their decisions.  Otherwise all are ambiguous.  Decisions whose visual is not known are read last.
    Fields agree by counts for each name, so nothing grows with a candidate's decisions but its list of sources.  Decisions with an existing candidate become one row for each projection, written once;
    what is said of a candidate is made from these rows, which stay where their candidate is.
    """
    own = decisions.select("doc_id", "decision", "visual_id", "existing", "source_ids", *_BOX, "disposition", "code", "candidate_id", "requires_confirmation", "signal", "fields")
    places = visuals.select("doc_id", "visual_id", F.struct(F.lit(0).alias("late"), "page_index", "y0", "x0").alias("_place")).dropDuplicates(["doc_id", "visual_id"])
    late = F.struct(F.lit(1).alias("late"), F.lit(None).cast("int").alias("page_index"), F.lit(None).cast("double").alias("y0"), F.lit(None).cast("double").alias("x0"))
    read = own.where("existing IS NOT NULL").join(places, ["doc_id", "visual_id"], "left").withColumn("_read", F.struct(F.coalesce("_place", late).alias("place"), "visual_id", "decision"))

    speaker = F.min_by(F.struct("disposition", "code", "candidate_id", "requires_confirmation", "signal", "fields"), F.struct(F.col("fields").isNull(), "decision"))
    edges = list(zip(_BOX, (F.min, F.min, F.max, F.max), strict=True))
    each = read.repartition(*_KEY).groupBy(*_KEY, "source_ids").agg(speaker.alias("s"), F.min("_read").alias("_read"), *(f(c).alias(f"_{c}") for c, f in edges))
    each = written(each.withColumn("_n", F.count("source_ids").over(Window.partitionBy(*_KEY))).where("_n > 1").drop("_n"), "projections")

    base = candidates.select("doc_id", F.col("candidate_id").alias("existing"), F.col("fields").alias("_base")).dropDuplicates(_KEY)
    sound = (F.col("existing") != "") & (F.col("s.disposition") == "candidate") & F.col("s.code").isNull() & F.col("s.candidate_id").eqNullSafe(F.col("existing")) & F.col("s.fields").isNotNull()
    said = each.groupBy(*_KEY).agg(
        F.bool_and(F.coalesce(sound, F.lit(False))).alias("_sound"), F.coalesce(F.bool_or("s.requires_confirmation"), F.lit(False)).alias("_unsure"), F.min("s.signal").alias("_signal"), F.min("_read")["decision"].alias("_first"), *(f(f"_{c}").alias(f"_{c}") for c, f in edges)
    )
    new = each.select(*_KEY, F.explode("s.fields").alias("name", "value")).where(F.col("name") != PLACE_FIELD).distinct()
    new = new.join(base, _KEY, "left").where(~F.col("value").eqNullSafe(F.try_element_at("_base", F.col("name"))))
    values = new.groupBy(*_KEY, "name").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    changed = values.groupBy(*_KEY).agg((F.max("n") > 1).alias("_split"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("_changed"))

    listed = each.select(*_KEY, "_read", F.posexplode("source_ids").alias("at", "source")).groupBy(*_KEY, "source").agg(F.min(F.struct("_read", "at")).alias("first"))
    seen = listed.join(places.withColumnRenamed("visual_id", "source"), ["doc_id", "source"], "left")
    order = F.when(F.col("_place").isNotNull(), F.struct(F.lit(0).alias("text"), F.col("_place").alias("place"), F.col("source").alias("visual_id"), F.col("first._read.decision").alias("decision"), F.lit(0).alias("at")))
    order = order.otherwise(F.struct(F.lit(1).alias("text"), F.col("first._read.place").alias("place"), F.col("first._read.visual_id").alias("visual_id"), F.col("first._read.decision").alias("decision"), F.col("first.at").alias("at")))
    sources = seen.groupBy(*_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "source"))), lambda s: s["source"]).alias("_sources"))

    facts = said.join(changed, _KEY, "left").join(sources, _KEY, "left").join(base, _KEY, "left")
    agreed = F.col("_sound") & F.col("_base").isNotNull() & ~F.coalesce("_split", F.lit(False))
    kept = F.map_filter("_base", lambda k, _: ~F.coalesce(F.map_contains_key("_changed", k), F.lit(False)))
    merged = F.when(F.col("_changed").isNull(), F.col("_base")).otherwise(F.map_concat(kept, "_changed"))
    facts = facts.select(*_KEY, *(f"_{c}" for c in _BOX), agreed.alias("_agreed"), "_unsure", "_signal", "_sources", "_first", F.when(agreed, merged).alias("_merged"))
    df = own.join(facts, _KEY, "left")
    good, lost = F.coalesce("_agreed", F.lit(False)), F.coalesce(~F.col("_agreed"), F.lit(False))
    primary = good & (F.col("decision") == F.col("_first"))
    return df.select(
        "doc_id", "decision", "visual_id", F.when(lost, "ambiguous").otherwise(F.col("disposition")).alias("disposition"), F.when(lost, CONFLICT).otherwise(F.col("code")).alias("code"), F.when(~lost, F.col("candidate_id")).alias("candidate_id"),
        F.when(lost, True).when(good, F.col("_unsure")).otherwise(F.col("requires_confirmation")).alias("requires_confirmation"), F.when(good, F.col("_signal")).otherwise(F.col("signal")).alias("signal"), F.coalesce("_sources", "source_ids").alias("source_ids"),
        *(F.when(good | lost, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in _BOX), F.when(primary, F.col("_merged")).when(~(good | lost), F.col("fields")).alias("fields"), primary.alias("primary"), F.when(primary, ~F.col("_unsure")).alias("truth_preserved"),
    )
