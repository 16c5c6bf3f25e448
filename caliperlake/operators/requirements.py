"""Technical requirements: entries from text blocks, matches with candidates, and what follows for items and coverage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliperlake.functions.annotations import executable
from caliperlake.functions.text import normalised, stable_id
from caliperlake.operators.spatial import by_group

# Heading of a block, a numbered entry, types that a general tolerance covers, subtypes of which a document has one.
HEADING, NUMBERED = r"^技术要求\s*:?$", r"^([1-9][0-9]*)\s*[.、)]\s*(.+)$"
COVERED_TYPES = ("linear_dimension", "diameter_dimension", "radius", "angle")
GENERAL = ("general_dimensional_tolerance", "general_geometric_tolerance")
SUGGESTED = ("inspection_item", "inspection_standard", "key_dimension")


def segments(obs: DataFrame) -> DataFrame:
    """Lines of observations that hold several, each with its share of the box's height; blank lines count for the height only."""
    parts = F.split("raw_text", r"\r\n|\n|\r")
    each = obs.select("*", F.posexplode(parts).alias("segment", "part"), F.size(parts).alias("_n"))
    height = (F.col("y1") - F.col("y0")) / F.col("_n")
    top = F.col("y0") + height * F.col("segment")
    each = each.withColumns({"text": F.trim("part"), "_y0": top, "_y1": top + height}).where("text <> ''")
    return each.drop("part", "_n", "y0", "y1", "raw_text").withColumnsRenamed({"_y0": "y0", "_y1": "y1"})


_ENTRY = "doc_id bigint, entry int, ordinal int, raw_text string, source_ids array<string>, n_segments int, page_index int, heading_id string, first int"


def _entries(rows: list) -> list[tuple]:
    """Entries under the headings of one document, from its segments in reading order.

    A block starts at a heading; lines out of its column are passed over; it ends at a line that is neither numbered nor a continuation.
    """
    heading = re.compile(HEADING)
    numbered = re.compile(NUMBERED, re.DOTALL)
    found: list[dict] = []
    head = entry = last = None
    aligned = lambda a, b: a.page_index == b.page_index and abs(a.dx - b.dx) <= 0.05 and abs(a.dy - b.dy) <= 0.05
    for r in rows:
        if heading.match(r.norm):
            head, entry = r, None
            continue
        if head is None:
            continue
        reach = max(8.0, 0.75 * max(head.x1 - head.x0, 1.0), 2.0 * max(head.y1 - head.y0, 1.0))
        if not aligned(head, r) or abs(r.x0 - head.x0) > reach:
            continue
        if m := numbered.match(r.norm):
            entry = {"ordinal": int(m[1]), "parts": [m[2].strip()], "ids": [r.observation_id], "page": r.page_index, "head": head.observation_id, "first": r.place}
            found.append(entry)
            last = r
            continue
        tall = max(last.y1 - last.y0, 1.0) if entry else 0.0
        if entry is None or not aligned(last, r) or not -0.35 * tall <= r.y0 - last.y1 <= max(4.0, 0.75 * tall):
            head = entry = None
            continue
        entry["parts"].append(r.text)
        entry["ids"].append(r.observation_id)
        last = r
    out = []
    for k, e in enumerate(found):
        text = e["parts"][0]
        for part in e["parts"][1:]:
            space = text[-1].isascii() and text[-1].isalnum() and part[0].isascii() and part[0].isalnum()
            text += " " * space + part
        out.append((rows[0].doc_id, k, e["ordinal"], text, list(dict.fromkeys(e["ids"])), len(e["parts"]), e["page"], e["head"], e["first"]))
    return out


def entries(obs: DataFrame) -> DataFrame:
    """Requirement entries of each document: numbered ones under a heading, and executable lines that no entry used.

    obs: doc_id, page_index, observation_id, raw_text, x0 .. y1, dx, dy and place (order of reading).  A document is one group.
    """
    cut = segments(obs).withColumn("norm", normalised(F.col("text")))
    listed = by_group(cut, ["doc_id"], ["place", "segment"], _entries, _ENTRY)
    used = listed.select("doc_id", F.explode(F.concat("source_ids", F.array("heading_id"))).alias("observation_id")).distinct()
    alone = obs.where(executable(normalised(F.col("raw_text")))).join(used, ["doc_id", "observation_id"], "left_anti")
    single = alone.select("doc_id", F.lit(-1).alias("entry"), F.lit(None).cast("int").alias("ordinal"), "raw_text", F.array("observation_id").alias("source_ids"), F.lit(1).alias("n_segments"), "page_index", F.lit(None).cast("string").alias("heading_id"), F.col("place").alias("first"))
    both = listed.unionByName(single)
    return both.withColumn("entry", F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "entry")))


def matched(requirements: DataFrame, candidates: DataFrame) -> DataFrame:
    """Requirements (doc_id, requirement_id, category, subtype, parameter) with outcome, matched (sorted candidate ids) and generated id.

    A general dimensional tolerance covers a document's dimensions without tolerances; without any it, like all other rules, holds for
    the whole document.  Rules that are not understood, or contradict one another in a document, stay open.
    """
    several = F.size(F.collect_set(F.when(F.col("subtype").isin(*GENERAL), F.coalesce("parameter", F.lit("")))).over(Window.partitionBy("doc_id", "subtype"))) > 1
    df = requirements.withColumn("_open", F.col("category").isin("unsupported", "ambiguous") | several)
    bare = candidates.where(F.col("item_type").isin(*COVERED_TYPES) & F.col("upper_tolerance").isNull() & F.col("lower_tolerance").isNull())
    covered = bare.groupBy("doc_id").agg(F.array_sort(F.collect_list("candidate_id")).alias("_ids"))
    wants = ~F.col("_open") & (F.col("subtype") == GENERAL[0])
    df = df.join(covered, "doc_id", "left").withColumn("matched", F.when(wants, F.coalesce("_ids", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    outcome = F.when(F.col("_open"), "unresolved").when(F.size("matched") > 0, "matched_items").otherwise("global_scope")
    df = df.withColumn("outcome", outcome)
    made = F.when(F.col("outcome") == "global_scope", generated_id(F.col("requirement_id")))
    return df.withColumn("generated", made).drop("_open", "_ids")


def generated_id(requirement_id: Column) -> Column:
    return stable_id(F.lit("technical-requirement-candidate"), requirement_id)


def problems(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """The first rule that each stored decision (doc_id, requirement_id, outcome, matched, generated) breaks; null if none."""
    keys = ["doc_id", "requirement_id"]
    twice = decisions.groupBy(*keys).agg(F.count("*").alias("_times"))
    known = candidates.select("doc_id", F.col("candidate_id").alias("_id")).distinct()
    lost = decisions.select(*keys, F.explode("matched").alias("_id")).join(known, ["doc_id", "_id"], "left_anti").select(*keys).distinct().withColumn("_lost", F.lit(True))
    made = known.withColumnRenamed("_id", "generated").withColumn("_made", F.lit(True))
    df = decisions.join(twice, keys).join(lost, keys, "left").join(made, ["doc_id", "generated"], "left")
    some, own = F.size("matched") > 0, F.col("generated").isNotNull()
    code = (
        F.when(F.col("_times") > 1, "duplicate_requirement_id")
        .when(F.col("matched") != F.array_sort(F.array_distinct("matched")), "targets_not_canonical")
        .when(F.col("_lost"), "missing_candidate")
        .when((F.col("outcome") == "matched_items") & (~some | own), "matched_items_rule")
        .when((F.col("outcome") == "global_scope") & (some | ~own | F.col("_made").isNull()), "global_scope_rule")
        .when(~F.col("outcome").isin("matched_items", "global_scope") & (some | own), "unresolved_rule")
    )
    return df.select(*keys, code.alias("code"))


def reconciled(requirements: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (doc_id, candidate_id, refs) after matching anew: generated ones and references of these requirements go first, so that running it twice changes nothing."""
    stale = requirements.select("doc_id", generated_id(F.col("requirement_id")).alias("candidate_id"))
    ours = requirements.groupBy("doc_id").agg(F.collect_set("requirement_id").alias("_ours"))
    base = candidates.join(stale, ["doc_id", "candidate_id"], "left_anti").join(ours, "doc_id", "left")
    base = base.withColumn("refs", F.array_except(F.coalesce("refs", F.array().cast("array<string>")), F.coalesce("_ours", F.array().cast("array<string>")))).drop("_ours")
    found = matched(requirements, base)
    hit = found.where("outcome = 'matched_items'").select("doc_id", F.explode("matched").alias("candidate_id"), "requirement_id").groupBy("doc_id", "candidate_id").agg(F.collect_set("requirement_id").alias("_new"))
    kept = base.join(hit, ["doc_id", "candidate_id"], "left").select("doc_id", "candidate_id", F.array_sort(F.array_union("refs", F.coalesce("_new", F.array().cast("array<string>")))).alias("refs"))
    made = found.where("outcome = 'global_scope'").select("doc_id", F.col("generated").alias("candidate_id"), F.array("requirement_id").alias("refs"))
    return kept.unionByName(made)


def broken_global_targets(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Active items that are global but may get a number, and global requirements without an active, global, unnumbered target."""
    unnumbered = F.col("balloon_required").eqNullSafe(F.lit(False))
    live = items.where("active")
    wrong = live.where((F.col("scope") == "global_requirement") & ~unnumbered).select("doc_id", F.col("item_id").alias("subject"), F.lit("item").alias("kind"))
    good = live.where((F.col("scope") == "global_requirement") & unnumbered).select("doc_id", F.col("item_id").alias("generated"))
    lost = decisions.where("outcome = 'global_scope'").join(good, ["doc_id", "generated"], "left_anti").select("doc_id", F.col("requirement_id").alias("subject"), F.lit("requirement").alias("kind"))
    return wrong.unionByName(lost)


def projected(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with the requirements that refer to them, and the fields that the first of these (by id) fills.

    A field that has a value keeps it; items that an operator filled keep all.  source_<field> names the requirement of a filled field.
    """
    targets = F.when(F.col("generated").isNotNull(), F.concat("matched", F.array("generated"))).otherwise(F.col("matched"))
    each = decisions.select("doc_id", "requirement_id", *SUGGESTED, F.explode(targets).alias("item_id"))
    first = {f: F.min_by(F.struct(F.col(f).alias("value"), "requirement_id"), F.when(F.col(f).isNotNull(), F.col("requirement_id"))) for f in SUGGESTED}
    per_item = each.groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_set("requirement_id")).alias("_refs"), *(c.alias(f"_{f}") for f, c in first.items()))
    df = items.join(per_item, ["doc_id", "item_id"], "left")
    fills = {f: ~F.col("manual") & (F.coalesce(F.col(f), F.lit("")) == "") & F.col(f"_{f}.value").isNotNull() for f in SUGGESTED}
    return df.select(
        "doc_id", "item_id", F.coalesce("_refs", F.array().cast("array<string>")).alias("refs"), *(F.when(fills[f], F.col(f"_{f}.value")).otherwise(F.col(f)).alias(f) for f in SUGGESTED), *(F.when(fills[f], F.col(f"_{f}.requirement_id")).alias(f"source_{f}") for f in SUGGESTED)
    )


def withdrawn(items: DataFrame, removed: DataFrame) -> DataFrame:
    """Items after their document withdrew a requirement (doc_id, requirement_id): references go, fields that it filled are empty again and ask for a new sheet,
    and the item that it generated is superseded.  Fields of items that an operator filled stay."""
    df = items.join(removed.withColumnRenamed("requirement_id", "_gone"), "doc_id", "left")
    theirs = {f: F.coalesce(~F.col("manual") & (F.col(f"source_{f}") == F.col("_gone")), F.lit(False)) for f in SUGGESTED}
    hit = theirs[SUGGESTED[0]] | theirs[SUGGESTED[1]] | theirs[SUGGESTED[2]]
    own = F.coalesce(F.col("item_id") == generated_id(F.col("_gone")), F.lit(False))
    return df.select(
        "doc_id", "item_id", F.when(F.col("_gone").isNull(), F.col("refs")).otherwise(F.array_remove("refs", F.col("_gone"))).alias("refs"), *(F.when(~theirs[f], F.col(f)).alias(f) for f in SUGGESTED),
        (hit & F.col("active") & ~own).alias("regeneration_required"), (F.col("active") & ~own).alias("active"),
    )


def requirement_coverage(observations: DataFrame, decisions: DataFrame) -> DataFrame:
    """What the requirements of a text say of its coverage: open, a candidate of its own, or context; and whether it still needs confirmation."""
    each = decisions.select("doc_id", F.explode("source_ids").alias("observation_id"), "outcome", "generated", "ordinal", "review_required", "review_status")
    per = each.groupBy("doc_id", "observation_id").agg(
        F.bool_or(F.col("outcome") == "unresolved").alias("open"), F.min("generated").alias("_made"), F.bool_and(F.col("ordinal").isNull()).alias("alone"), F.bool_or("review_required").alias("requires_confirmation"), F.bool_or(F.col("review_status") == "confirmed").alias("_confirmed")
    )
    state = F.when(F.col("open"), "ambiguous").when(F.col("_made").isNotNull(), "candidate").otherwise("reference_context")
    return observations.join(per, ["doc_id", "observation_id"]).select(
        "doc_id", "observation_id", state.alias("disposition"), F.when(~F.col("open"), F.col("_made")).alias("candidate_id"), "requires_confirmation", F.when(~F.col("requires_confirmation"), F.col("_confirmed")).alias("confirmation_accepted"), F.when(~F.col("alone"), F.lit("technical_requirement")).alias("reason")
    )
