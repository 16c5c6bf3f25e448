"""Decisions on candidates: assembly, complete semantics, confidence, coverage rules, routes and list states."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliperlake.functions.text import canonical_sha
from caliperlake.functions.tolerances import OTHER_FLATNESS, SYMBOLS

# Limits and version of the confidence policy, its codes in order, forms of a thread, features of a diameter.
HIGH, MEDIUM, POLICY = 0.95, 0.70, "candidate-confidence/1"
CODES = (
    "typed_schema_complete", "typed_schema_incomplete", "feature_kind_unknown", "coarse_fallback", "local_projection_failed", "source_truth_preserved", "normalized_value_invalid", "single_source_owner",
    "source_location_missing", "source_owner_conflict", "local_association_complete", "local_association_missing", "coverage_clear", "coverage_unchecked", "coverage_blocking", "ambiguous_source", "no_conflict",
    "possible_duplicate", "cross_view_conflict", "projection_conflict", "provider_schema_rejected", "semantic_confirmation_clear", "semantic_confirmation_required", "balloon_requirement_known",
    "balloon_requirement_unknown", "source_signal_valid", "source_signal_missing", "source_signal_invalid", "source_signal_high", "source_signal_medium", "source_signal_low",
)
THREAD, FEATURES = r"\AM(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:×(?:0|[1-9][0-9]*)(?:\.[0-9]+)?)?\z", ("hole", "shaft", "cylindrical_feature")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def signal_value(source_type: Column, exact: Column, raw: Column) -> Column:
    """A source's signal between 0 and 1: an exact native match, a percentage of recognition, a visual share; null where it is out of range."""
    share = raw.cast("decimal(14,4)")
    percent = F.when((share >= 0) & (share <= 100), (share * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(14,6)"))
    return F.when(source_type == "native", F.when(exact, 1).otherwise(0).cast("decimal(14,6)")).when(source_type == "ocr", percent).when((source_type == "visual") & (share >= 0) & (share <= 1), share.cast("decimal(14,6)"))


def _simple(kind: Column, get: Callable[[str], Column], proxy: Column) -> Column:
    good = lambda name: _yes(get(name) >= 0)
    return _yes(
        F.when(kind == "linear_dimension", good("nominal"))
        .when(kind == "diameter_dimension", good("nominal") & _yes(get("feature_kind").isin(*FEATURES)))
        .when(kind == "thread", get("thread_spec").rlike(THREAD) & get("through").isNotNull() & (get("thread_depth").isNull() | good("thread_depth")))
        .when(kind == "radius", good("radius"))
        .when(kind == "angle", good("angle") & (get("angle") <= 360))
        .when(kind == "general_requirement", (get("scope") == "global_requirement") & get("balloon_required").eqNullSafe(F.lit(False)) & proxy)
    )


def semantics_complete(item_type: Column, get: Callable[[str], Column], parts: Column, proxy: Column) -> Column:
    """Whether an item has all that its type needs.  A composite's parts are a primary and its depth and through modifiers, numbered from 0."""
    first = F.try_element_at(parts, F.lit(1))
    numbered = F.forall(F.transform(parts, lambda p, i: _yes(p["order"] == i)), lambda ok: ok)
    modifier = lambda p: _yes(F.when(p["kind"] == "depth", p["value"] >= 0).when(p["kind"] == "through", p["flag"]))
    primary = _simple(first["kind"], lambda n: first[n] if n in ("nominal", "feature_kind", "thread_spec", "through", "thread_depth") else F.lit(None), F.lit(False))
    composite = _yes((F.size(parts) > 0) & numbered & primary & F.forall(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), modifier))
    return F.when(item_type == "composite", composite).otherwise(_simple(item_type, get, proxy))


_REVIEW = {"local_projection_failed": "local_parse", "projection_conflict": "projection_conflict", "cross_view_conflict": "cross_view"}


def review_codes(code: Column) -> dict[str, Column]:
    """What a rejected review (its code; null if not rejected) is evidence of."""
    return {name: _yes(F.instr(code, said) > 0) for name, said in _REVIEW.items()} | {"provider_schema_rejected": code.isNotNull()}


# What is said of a candidate, each a bit of one number: by itself, and by its sources, entries and duplicates.  A review says the same things of both.
_FACTS = (
    "blank", "repeated", "sourced", "typed", "complete", "complete_by_proxy", "coarse", "unknown", "truth", "known", "confirm", "local_projection_failed", "projection_conflict", "cross_view_conflict", "provider_schema_rejected",
    "missing", "twice", "invalid", "proxy", "shared", "unassociated", "ambiguous", "copy",
)


def _facts(**said: Column) -> Column:
    return reduce(Column.bitwiseOR, (F.when(c, F.lit(1 << _FACTS.index(n))).otherwise(F.lit(0)) for n, c in said.items()))


def _said(facts: Column, name: str) -> Column:
    return facts.bitwiseAND(F.lit(1 << _FACTS.index(name))) != 0


def confidence_decisions(candidates: DataFrame, entries: DataFrame, duplicates: DataFrame, signals: DataFrame, coverage: DataFrame) -> DataFrame:
    """doc_id, row_id, band, review_disposition and evidence_codes of every candidate.

    candidates: doc_id, row_id, candidate_id, payload_id, source_ids, item_type, the fields of ``semantics_complete``, parts, coarse, raw_text, normalized_text,
    boxed (its coordinates are a box), source_truth, requires_confirmation, balloon_required, review_code.  entries: doc_id, observation_id,
    source_location_id, candidate_id, disposition, requires_confirmation, review_code.  duplicates: doc_id, candidate_id.  signals: doc_id, source, source_type, value.
    coverage: doc_id, checked, blocking.

    A candidate becomes a number of facts before it is dealt.  What concerns a source is dealt once, by source, and what concerns a candidate once, by its id; entries that say nothing are left out.
    """
    text = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    none, sources = F.lit(None), F.array_compact(F.array_distinct("source_ids"))
    ids = F.col("source_ids")
    blank = (F.size(ids) == 0) | F.exists(ids, lambda s: ~text(s))
    complete = lambda proxy: semantics_complete(F.col("item_type"), F.col, F.col("parts"), F.lit(proxy))
    identity = text(F.col("candidate_id")) & (F.col("payload_id") == F.col("candidate_id"))
    reviews = review_codes(F.col("review_code"))
    own = _facts(
        blank=blank, repeated=~blank & (F.size(ids) != F.size(F.array_distinct(ids))), sourced=F.size(ids) > 0, typed=~F.col("coarse") & identity & text(F.col("raw_text")) & text(F.col("normalized_text")) & F.col("boxed"),
        complete=complete(False), complete_by_proxy=complete(True), coarse=F.col("coarse"), unknown=~F.col("coarse") & (F.col("item_type") == "diameter_dimension") & ~_yes(F.col("feature_kind").isin(*FEATURES)),
        truth=text(F.col("normalized_text")) & F.col("source_truth"), known=F.col("balloon_required").isNotNull(), confirm=~F.col("requires_confirmation").eqNullSafe(F.lit(False)), **reviews,
    )
    narrow = candidates.select("doc_id", "row_id", "candidate_id", sources.alias("_sources"), own.alias("own"))
    alone = narrow.where(~_yes(F.size("_sources") > 0))
    marked = entries.withColumn("found", _facts(ambiguous=F.col("disposition") == "ambiguous", confirm=F.col("requires_confirmation"), **reviews))

    # By source: its owners, its signals, the entries that name it.
    place = F.col("source_location_id")
    by_source = marked.select("doc_id", F.explode(F.array_distinct(F.array_compact(F.array("source_location_id", "observation_id")))).alias("source"), F.when(F.col("disposition") == "candidate", F.col("candidate_id")).alias("candidate_id"), place.alias("_place"), "found")
    by_source = by_source.withColumn("candidate_id", F.when(F.col("source") == F.col("_place"), F.col("candidate_id"))).where("candidate_id is not null or found <> 0")
    valid = _yes(F.col("source_type").isin("native", "ocr", "visual") & F.col("value").between(0, 1))
    signal = _facts(invalid=~valid, proxy=(F.col("source_type") == "native") & (F.col("value") == 1))
    kind = lambda name: F.lit(name).alias("kind")
    dealt = (
        narrow.select("doc_id", kind("owner"), "row_id", "candidate_id", "own", F.posexplode("_sources").alias("place", "source")).select("doc_id", "source", "kind", "row_id", "candidate_id", "own", (F.col("place") == 0).alias("first"), F.lit(0).alias("found"), none.cast("double").alias("least"))
        .unionByName(signals.select("doc_id", "source", kind("signal"), signal.alias("found"), F.col("value").cast("double").alias("least")), allowMissingColumns=True)
        .unionByName(by_source.select("doc_id", "source", kind("entry"), "candidate_id", "found"), allowMissingColumns=True)
        .repartition("doc_id", "source")
    )
    of = lambda name: F.col("kind") == name
    dealt = dealt.withColumn("_named", F.count(F.when(of("entry"), F.col("candidate_id"))).over(Window.partitionBy("doc_id", "source", "candidate_id")))
    source = Window.partitionBy("doc_id", "source")
    n, owners = (F.count(F.when(of(k), True)).over(source) for k in ("signal", "owner"))
    dealt = dealt.select("doc_id", "kind", "row_id", "candidate_id", "own", "first", "_named", n.alias("_n"), owners.alias("_owners"), F.bit_or("found").over(source).alias("_found"), F.min("least").over(source).alias("least"))
    linked = _facts(missing=F.col("_n") == 0, twice=F.col("_n") > 1, shared=F.col("_owners") > 1, unassociated=F.col("_named") != 1)
    owned = dealt.where(of("owner")).select("doc_id", "candidate_id", "row_id", "own", "first", F.col("_found").bitwiseOR(linked).alias("found"), "least")

    # By candidate: all that its sources say, its entries, its duplicates, and whether its id is another's too.
    listed = marked.where("candidate_id is not null and found <> 0").select("doc_id", "candidate_id", "found")
    copies = duplicates.where("candidate_id is not null").select("doc_id", "candidate_id", _facts(copy=F.lit(True)).alias("found"))
    dealt = (
        owned.unionByName(alone.select("doc_id", "candidate_id", "row_id", "own", F.lit(True).alias("first"), F.lit(0).alias("found")), allowMissingColumns=True)
        .unionByName(listed, allowMissingColumns=True).unionByName(copies, allowMissingColumns=True).repartition("doc_id", "candidate_id")
    )
    row, candidate = Window.partitionBy("doc_id", "candidate_id", "row_id"), Window.partitionBy("doc_id", "candidate_id")
    dealt = dealt.withColumns({"_of_row": F.bit_or("found").over(row), "_least": F.min("least").over(row)})
    dealt = dealt.withColumns({"_of_id": F.bit_or(F.when(F.col("row_id").isNull(), F.col("found"))).over(candidate), "_rows": F.count(F.when(F.col("first"), True)).over(candidate)})
    facts = F.col("own").bitwiseOR(F.col("_of_row")).bitwiseOR(F.coalesce("_of_id", F.lit(0)))
    df = dealt.where("first").select("doc_id", "row_id", facts.alias("facts"), (F.col("_rows") > 1).alias("_several"), "_least").join(coverage, "doc_id", "left")

    said = {n: _said(F.col("facts"), n) for n in _FACTS}
    found, truth, copy, ambiguous = ~said["missing"], said["truth"], said["copy"], said["ambiguous"]
    signals_ok = said["sourced"] & found & ~said["repeated"] & ~said["blank"] & ~said["invalid"] & ~said["twice"]
    typed = said["typed"] & ~F.col("_several") & F.when(said["proxy"], said["complete_by_proxy"]).otherwise(said["complete"])
    associated = said["sourced"] & ~said["unassociated"]
    checked, blocked = _yes(F.col("checked")), F.coalesce("blocking", F.lit(0)) > 0
    conflict = ambiguous | said["provider_schema_rejected"] | copy
    least = F.col("_least")
    level = F.when(~signals_ok, F.lit(None)).when(least >= HIGH, "high").when(least >= MEDIUM, "medium").otherwise("low")
    owner = ~said["blank"] & ~said["repeated"] & ~said["shared"]
    evidence = {
        "typed_schema_complete": typed, "typed_schema_incomplete": ~typed, "feature_kind_unknown": said["unknown"], "coarse_fallback": said["coarse"], "local_projection_failed": said["local_projection_failed"], "source_truth_preserved": truth, "normalized_value_invalid": ~truth,
        "single_source_owner": owner, "source_location_missing": said["blank"], "source_owner_conflict": said["repeated"] | said["shared"] | said["twice"], "local_association_complete": associated, "local_association_missing": ~associated,
        "coverage_clear": checked & ~blocked, "coverage_unchecked": ~checked, "coverage_blocking": blocked, "ambiguous_source": ambiguous, "no_conflict": ~conflict, "possible_duplicate": copy, "cross_view_conflict": said["cross_view_conflict"] | copy, "projection_conflict": said["projection_conflict"],
        "provider_schema_rejected": said["provider_schema_rejected"], "semantic_confirmation_clear": ~said["confirm"], "semantic_confirmation_required": said["confirm"], "balloon_requirement_known": said["known"], "balloon_requirement_unknown": ~said["known"],
        "source_signal_valid": signals_ok, "source_signal_missing": ~found, "source_signal_invalid": found & ~signals_ok, **{f"source_signal_{b}": _yes(level == b) for b in ("high", "medium", "low")},
    }
    eligible = owner & typed & truth & associated & checked & ~blocked & ~conflict & ~said["confirm"] & said["known"]
    band = F.when(eligible, F.coalesce(level, F.lit("low"))).otherwise("low")
    return df.select("doc_id", "row_id", band.alias("band"), F.when(band == "high", "auto_accepted").otherwise("review_required").alias("review_disposition"), F.array_compact(F.array(*(F.when(evidence[c], c) for c in CODES))).alias("evidence_codes"))


def decision_problem(band: Column, disposition: Column, version: Column, codes: Column) -> Column:
    """The first rule that a stored decision breaks; null if none."""
    order = F.transform(codes, lambda c: F.array_position(F.array(*(F.lit(k) for k in CODES)), c))
    return (
        F.when(~_yes(band.isin("high", "medium", "low")), "band")
        .when(~disposition.eqNullSafe(F.when(band == "high", "auto_accepted").otherwise("review_required")), "review_disposition")
        .when(~version.eqNullSafe(F.lit(POLICY)), "policy_version")
        .when(codes.isNull() | (F.size(codes) == 0), "evidence_missing")
        .when(F.size(F.array_distinct(codes)) != F.size(codes), "evidence_repeated")
        .when(F.array_contains(order, F.lit(0).cast("bigint")), "evidence_unknown")
        .when(F.array_sort(order) != order, "evidence_order")
    )


# Kinds of visual symbols that are inspected together, and codes of rejected reviews.
KIND_SETS = ("diameter", "depth", "depth,diameter", "counterbore,depth,diameter", "surface_roughness", "gdt_parallelism", "gdt_perpendicularity", "gdt_flatness")
GDT_CODES = ("gdt_composite_truncated", "gdt_datum_association_ambiguous", "gdt_frame_not_found", "gdt_frame_segmentation_ambiguous", "gdt_projection_conflict", "gdt_value_missing")
VISUAL_CODES = ("visual_bbox_invalid", "visual_source_mismatch", "visual_duplicate_detection", "visual_local_parse_failed", "visual_projection_conflict", "visual_no_detection")


def visual_coverage_valid(disposition: Column, candidate: Column, confirm: Column, kinds: Column, code: Column, signal: Column, local: Column) -> Column:
    """Whether a visual's coverage entry agrees with its kinds, its rejection and its evidence."""
    has, known, joined = candidate.isNotNull(), signal.isNotNull() | local, F.array_join(kinds, ",")
    clean = code.isNull() & known
    gdt = code.isin(*GDT_CODES) & (F.size(kinds) == 1) & F.coalesce(F.try_element_at(kinds, F.lit(1)), F.lit("")).startswith("gdt_")
    seen = code.isin(*VISUAL_CODES) & ((code != "visual_no_detection") | (F.size(kinds) == 0))
    return _yes(
        F.when(disposition == "candidate", has & clean & joined.isin(*KIND_SETS))
        .when(disposition == "reference_context", ~has & ~confirm & clean & (joined == "datum_reference"))
        .when(disposition == "non_inspection", ~has & confirm & clean & (joined == "revision_marker"))
        .when(disposition == "ambiguous", ~has & confirm & ~local & (gdt | seen))
    )


LOCAL_REASONS, FAMILY_REASONS = ("deterministic_geometry_complete", "local_projection_complete", "native_symbol_explicit"), ("deterministic_geometry_complete", "native_symbol_explicit")
ROUTING_SCHEMA, ROUTER = "symbol-routing-decision/1", "symbol-uncertainty-router/1"


def local_decision_sha(observation: Column, input_sha: Column, reasons: Column, confirm: Column, schema: Column, router: Column) -> Column:
    """Digest of a locally resolved routing decision."""
    none = F.array().cast("array<string>")
    nothing = F.lit(None).cast("string")
    return canonical_sha(
        ("schema_version", schema), ("router_version", router), ("visual_observation_id", observation), ("input_sha256", input_sha), ("disposition", F.lit("locally_resolved")), ("local_resolution_reason_codes", reasons), ("escalation_reason_codes", none),
        ("block_reason_codes", none), ("requires_confirmation", confirm), ("escalation_group_id", nothing), ("escalation_group_member_index", nothing), ("local_resolution_ref", F.concat(F.lit("sha256:"), input_sha)),
    )


def local_evidence_valid(observation: Column, input_sha: Column, decision_sha: Column, reasons: Column, confirm: Column, schema: Column, router: Column) -> Column:
    """Versions, digests and reasons of a local resolution, and its recomputed digest."""
    hexed = lambda c: c.rlike(r"\A[0-9a-f]{64}\z")
    said = (F.size(reasons) > 0) & (F.array_sort(F.array_distinct(reasons)) == reasons) & (F.size(F.array_except(reasons, F.array(*(F.lit(r) for r in LOCAL_REASONS)))) == 0)
    enough = F.array_contains(reasons, "local_projection_complete") & F.arrays_overlap(reasons, F.array(*(F.lit(r) for r in FAMILY_REASONS)))
    return _yes((schema == ROUTING_SCHEMA) & (router == ROUTER) & hexed(input_sha) & hexed(decision_sha) & said & enough & (local_decision_sha(observation, input_sha, reasons, confirm, schema, router) == decision_sha))


def assembled(decision: Column, composite: Column, parsed_type: Column, coarse: Column, text: Column, fallback: Column) -> Column:
    """Struct (kind, item_type) of an observation: a disposition first, then a composite, a parsed annotation, a coarse type, an unread tolerance symbol; else
    the disposition that repetition gives, or uncovered."""
    signs = "[" + "".join((*SYMBOLS.values(), OTHER_FLATNESS)) + "]"
    made = lambda kind, item=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if item is None else item).alias("item_type"))
    return (
        F.when(decision.isNotNull(), made("decided"))
        .when(composite, made("composite", F.lit("composite")))
        .when(parsed_type.isNotNull(), made("parsed", parsed_type))
        .when(coarse.isNotNull(), made("coarse", coarse))
        .when(text.rlike(signs), made("tolerance_unknown", F.lit("geometric_tolerance")))
        .when(fallback.isNotNull(), made("decided"))
        .otherwise(made("uncovered"))
    )


def review_reason(coarse: Column, item_type: Column, confirm: Column, recognised: Column) -> Column:
    """Struct (reason, expected_type) why a candidate goes to review; null if it does not."""
    made = lambda reason, kind: F.struct(F.lit(reason).alias("reason"), kind.alias("expected_type"))
    return (
        F.when(coarse.isin("geometric_tolerance", "roughness", "weld"), made("coarse_type", coarse))
        .when(item_type == "composite", made("composite", item_type))
        .when(_yes(confirm), made("confirmation", item_type))
        .when(recognised, made("ocr_source", F.coalesce(coarse, item_type)))
    )


def review_routes(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidates with a reason for review, and open entries that no candidate owns: doc_id, subject, reason, expected_type.

    candidates: doc_id, candidate_id, source_ids, coarse_type, item_type, requires_confirmation, recognised.  entries: doc_id, observation_id, disposition.
    """
    reason = review_reason(F.col("coarse_type"), F.col("item_type"), F.col("requires_confirmation"), F.col("recognised"))
    routed = candidates.withColumn("r", reason).where("r is not null").select("doc_id", F.col("candidate_id").alias("subject"), "r.*")
    owned = candidates.select("doc_id", F.explode("source_ids").alias("observation_id")).distinct()
    alone = entries.where("disposition = 'ambiguous'").join(owned, ["doc_id", "observation_id"], "left_anti")
    return routed.unionByName(alone.select("doc_id", F.col("observation_id").alias("subject"), F.lit("parser_failed").alias("reason"), F.lit(None).cast("string").alias("expected_type")))


SUGGESTED_TYPES = ("linear_dimension", "diameter_dimension", "thread", "radius", "angle", "general_requirement", "composite", "geometric_tolerance", "roughness", "weld")


def suggestion_problem(route_text: Column, expected: Column, must_confirm: Column, text: Column, item_type: Column, confirm: Column) -> Column:
    """Why a suggestion is not taken; texts are normalised."""
    return (
        F.when(~text.eqNullSafe(route_text), "raw_text_mismatch")
        .when(~_yes(item_type.isin(*SUGGESTED_TYPES)), "unknown_type")
        .when(expected.isNotNull() & (item_type != expected), "type_mismatch")
        .when(must_confirm & confirm.eqNullSafe(F.lit(False)), "confirmation_downgrade")
    )


def auto_accepted(get: Callable[[str], Column]) -> Column:
    """Accepted by the confidence policy, with the decision that says so."""
    return _yes(
        get("active") & (get("status") == "auto_accepted") & get("requires_confirmation").eqNullSafe(F.lit(False)) & (get("acceptance_source") == "confidence_policy") & (get("band") == "high") & (get("review_disposition") == "auto_accepted") & (get("policy_version") == POLICY)
    )


def balloon_decision_pending(get: Callable[[str], Column]) -> Column:
    settled = _yes(get("status") == "kept") | _yes(get("sheet_confirmed")) | auto_accepted(get)
    return _yes(get("active")) & ~_yes(get("requires_confirmation")) & settled & get("balloon_required").isNull()


def review_required(get: Callable[[str], Column]) -> Column:
    return _yes(get("active")) & (_yes(get("requires_confirmation")) | balloon_decision_pending(get) | (~auto_accepted(get) & ~_yes(get("status") == "kept")))


def item_status(get: Callable[[str], Column]) -> Column:
    """What the list shows of an item and its balloon (placement_status, n_flags)."""
    return (
        F.when(~_yes(get("active")), "excluded")
        .when(get("placement_status") == "manual_required", "manual")
        .when(get("n_flags") > 0, "collision")
        .when(_yes(get("requires_confirmation")) | _yes(get("status") == "pending") | balloon_decision_pending(get), "pending")
        .when(auto_accepted(get), "auto_accepted")
        .when(_yes(get("status") == "kept") | _yes(get("sheet_confirmed")), "confirmed")
        .otherwise("pending")
    )


def list_views(get: Callable[[str], Column]) -> Column:
    """The filters of the list that show an item, in order."""
    views = {"active": _yes(get("active")), "excluded": ~_yes(get("active")), "auto_accepted": auto_accepted(get), "review_required": review_required(get), "manual_required": _yes(get("placement_status") == "manual_required"), "hard_collision": _yes(get("n_flags") > 0)}
    return F.array_compact(F.array(F.lit("all"), *(F.when(c, n) for n, c in views.items())))


# Failures of one region that leave its source open.
LOCAL_FAILURES = ("provider_timeout", "provider_transport_failure", "provider_schema_invalid")


def default_dispositions(entries: DataFrame, requirement_sources: DataFrame) -> DataFrame:
    """Open entries without a candidate are no inspection by default, unless they are part of a requirement or their recognition failed.

    entries: doc_id, entry_id, source_location_id, candidate_id, requires_confirmation, disposition, failure_stage; requirement_sources: doc_id, source_location_id.
    """
    theirs = requirement_sources.select("doc_id", "source_location_id").distinct().withColumn("_part", F.lit(True))
    df = entries.join(theirs, ["doc_id", "source_location_id"], "left")
    failed = _yes(F.col("failure_stage").isin(*LOCAL_FAILURES)) & (F.col("disposition") == "ambiguous")
    open_ = _yes(F.col("requires_confirmation")) & F.col("candidate_id").isNull() & (F.coalesce(F.trim("source_location_id"), F.lit("")) != "")
    default = open_ & ~failed & F.col("_part").isNull()
    return df.select("doc_id", "entry_id", F.when(default, "non_inspection").otherwise(F.col("disposition")).alias("disposition"), (_yes(F.col("requires_confirmation")) & ~default).alias("requires_confirmation"), F.when(default, "system_default").alias("resolution_source"))
