"""Review and release of documents: command replay, gates, status, lineage, artifacts and charges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliperlake.scratch import written

# Stages of known errors, transient causes, states of a document and the steps between them, kinds of access by lifecycle status.
ERROR_STAGES = {
    "project_dispatch_failed": "dispatch", "storage_unavailable": "preflight", "redis_unavailable": "preflight", "celery_worker_unavailable": "preflight", "ocr_provider_unavailable": "preflight", "vision_provider_unavailable": "preflight",
    "vision_provider_call_failed": "candidate_advisor", "symbol_routing_evidence_failed": "candidate_advisor", "unsupported_input": "page_inventory", "inventory_processing_failed": "page_inventory", "coverage_blocking": "coverage", "review_bootstrap_failed": "review_bootstrap",
}
TRANSIENT = ("transient_dependency_unavailable", "transient_dispatch_failure", "transient_provider_failure")
STATES = ("processing", "ready_for_edit", "editing", "reviewed", "exporting", "export_succeeded", "processing_failed", "export_failed", "unsupported_input")
STEPS = (
    ("processing", "ready_for_edit"), ("processing", "processing_failed"), ("processing", "unsupported_input"), ("ready_for_edit", "editing"), ("editing", "reviewed"), ("reviewed", "exporting"), ("exporting", "export_succeeded"), ("exporting", "export_failed"), ("export_failed", "exporting"),
)
ACCESS = (
    ("active", "active"), ("active", "processing_read"), ("active", "status_read"), ("unlisted", "active"), ("unlisted", "processing_read"), ("unlisted", "status_read"), ("reprocessing", "processing_read"), ("reprocessing", "status_read"), ("reprocess_failed", "status_read"),
)
# Fields of the sheet and its head.
DETAILS, METADATA, REQUIRED_METADATA, CAPACITY = ("inspection_item", "inspection_standard", "inspection_method", "key_dimension", "inspection_role"), ("material_code", "material_name", "drawing_number", "material", "revision"), ("material_code", "material_name", "drawing_number", "revision"), 512


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _codes(**named: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*(F.when(_yes(c), n) for n, c in named.items()))), ",")


def document_status() -> Column:
    """Struct (phase, stage, workbench_ready, retryable, error_code, error_stage): a working copy first, then a blocking error, a failed state or job, the running job.

    Uses working, completeness, state, job_status, job_stage, error_code, error_cause.
    """
    nothing = F.lit(None).cast("string")
    made = lambda phase, stage=nothing, ready=False, retry=F.lit(False), code=nothing, at=nothing: F.struct(F.lit(phase).alias("phase"), stage.alias("stage"), F.lit(ready).alias("workbench_ready"), retry.alias("retryable"), code.alias("error_code"), at.alias("error_stage"))
    stage = F.lit("processing")
    known = F.col("error_code").isin(*ERROR_STAGES)
    for code, at in ERROR_STAGES.items():
        stage = F.when(F.col("error_code") == code, at).otherwise(stage)
    failed = made("failed", code=F.lit("project_processing_failed"), at=F.lit("processing"))
    job = F.col("job_status")
    return (
        F.when(F.col("working") & (F.col("completeness") == "partial_review_required"), made("partial_review_required", ready=True))
        .when(F.col("working"), made("ready_for_review", ready=True))
        .when(F.col("error_code").isNotNull(), made("failed", retry=_yes(F.col("error_cause").isin(*TRANSIENT)), code=F.when(known, F.col("error_code")).otherwise("project_processing_failed"), at=stage))
        .when(F.col("state").isin("processing_failed", "unsupported_input"), failed)
        .when(job.isNull(), made("queued", stage=F.lit("queued")))
        .when(job.isin("pending", "processing", "succeeded"), made("processing", stage=F.col("job_stage")))
        .otherwise(failed)
    )


def sheet_blockers(metadata: DataFrame, items: DataFrame) -> DataFrame:
    """Of each document, whether its sheet's head and the details of its active items are complete."""
    head = F.col("material").isNull()
    for f in REQUIRED_METADATA:
        head = head | _blank(F.col(f))
    open_ = ~_yes(F.col("detail_confirmed")) | (F.col("n_exceptions") > 0) | ~_yes(F.col("source_page") >= 1)
    for f in DETAILS:
        open_ = open_ | _blank(F.col(f))
    details = items.where("active").groupBy("doc_id").agg(F.bool_or(open_).alias("_open"))
    return metadata.join(details, "doc_id", "left").select("doc_id", _codes(sip_metadata_unconfirmed=head, sip_detail_fields_unconfirmed=F.col("_open")).alias("blockers"))


def freeze_blockers(items: DataFrame, entries: DataFrame, coverage: DataFrame, sheet: DataFrame) -> DataFrame:
    """What keeps each document's items from being frozen.

    coverage: doc_id, blocking; entries: doc_id, valid, requires_confirmation; sheet: the result of ``sheet_blockers``.
    """
    i = items.where("active").groupBy("doc_id").agg(F.bool_or(_yes(F.col("requires_confirmation"))).alias("_i"), F.bool_or(F.col("balloon_required").isNull()).alias("_b"))
    e = entries.groupBy("doc_id").agg(F.bool_or(~F.col("valid")).alias("_m"), F.bool_or(_yes(F.col("requires_confirmation"))).alias("_e"))
    df = coverage.join(i, "doc_id", "left").join(e, "doc_id", "left").join(sheet.withColumnRenamed("blockers", "_s"), "doc_id", "left")
    malformed = _yes(F.col("_m"))
    unresolved = _yes(F.col("_i")) | (_yes(F.col("_e")) & ~malformed) | (F.coalesce("_s", F.lit("")) != "")
    return df.select("doc_id", _codes(coverage_blocking=(F.col("blocking") > 0) | malformed, unresolved_confirmation=unresolved, balloon_required_unconfirmed=F.col("_b")).alias("blockers"))


def review_required_count(entries: DataFrame) -> DataFrame:
    """Entries of each document that are malformed or still need confirmation."""
    bad = _blank(F.col("observation_id")) | (F.col("disposition").isNotNull() & _blank(F.col("disposition"))) | (F.col("source_location_id").isNotNull() & _blank(F.col("source_location_id"))) | (F.col("candidate_id").isNotNull() & _blank(F.col("candidate_id")))
    bad = bad | (F.col("coordinates").isNotNull() & (F.size("coordinates") != 4)) | F.col("requires_confirmation").isNull()
    return entries.groupBy("doc_id").agg(F.count_if(bad).alias("malformed"), F.count_if(bad | _yes(F.col("requires_confirmation"))).alias("review_required"))


def first_items(candidates: DataFrame) -> DataFrame:
    """Review items as candidates begin: accepted where the stored decision is valid and says so, else pending."""
    good = F.col("problem").isNull() & (F.col("review_disposition") == "auto_accepted")
    return candidates.select("doc_id", F.col("candidate_id").alias("item_id"), F.when(_yes(good), "auto_accepted").otherwise("pending").alias("status"), (~_yes(good)).alias("requires_confirmation"), F.when(_yes(good), "confidence_policy").alias("acceptance_source"), F.col("problem").isNull().alias("decided"), F.lit(True).alias("active"))


COMPLETING = ("keep", "exclude", "edit", "resolve", "set_balloon")


def after_commands(items: DataFrame, commands: DataFrame) -> DataFrame:
    """Items after their commands (doc_id, item_id, version, expected_version, kind, accepted, text, moved, balloon).

    Commands that expected another version are stale.  The last writer of each field counts; an item that was excluded, or whose confirmation was refused, takes no
    further command.  Every command but that completes the item by hand.
    """
    key = ["doc_id", "item_id"]
    fresh = commands.where(F.col("expected_version") == F.col("version") - 1)
    against = (F.col("kind") == "exclude") | ((F.col("kind") == "resolve") & ~_yes(F.col("accepted")))
    fresh = fresh.withColumn("_end", F.min(F.when(against, F.col("version"))).over(Window.partitionBy(*key))).where(F.col("_end").isNull() | (F.col("version") <= F.col("_end")))
    done = F.col("kind").isin(*COMPLETING)
    last = lambda value, kind: F.max_by(value, F.when(F.col("kind") == kind, F.col("version")))
    folded = fresh.groupBy(*key).agg(
        F.bool_or(done).alias("_done"), F.bool_or(against).alias("_out"), last(F.col("text"), "edit").alias("_text"), last(F.col("balloon"), "set_balloon").alias("_balloon"), F.bool_or(F.col("kind") == "edit").alias("_edited"),
        F.bool_or(against | (F.col("kind") == "set_balloon") | ((F.col("kind") == "edit") & _yes(F.col("moved")))).alias("_stale"), F.bool_or(F.col("kind") == "set_balloon").alias("_set"),
    )
    df = items.join(folded, key, "left")
    completed, out = _yes(F.col("_done")), _yes(F.col("_out"))
    return df.select(
        *key, F.when(out, "excluded").when(completed, "kept").otherwise(F.col("status")).alias("status"), (F.col("active") & ~out).alias("active"), (F.col("requires_confirmation") & ~completed).alias("requires_confirmation"),
        F.when(completed, F.when(F.col("decided"), "manual_override").otherwise("manual")).otherwise(F.col("acceptance_source")).alias("acceptance_source"), F.when(completed, ~out).alias("confirmation_accepted"), F.coalesce("_text", "text").alias("text"),
        F.when(_yes(F.col("_edited")), "manual").otherwise("automatic").alias("source_type"), F.when(_yes(F.col("_set")), F.col("_balloon")).otherwise(F.col("balloon_required")).alias("balloon_required"), _yes(F.col("_stale")).alias("numbering_stale"),
    )


def closed_entries(entries: DataFrame, items: DataFrame) -> DataFrame:
    """Coverage entries after manual decisions: an entry of a completed item needs no confirmation and shares the item's verdict."""
    done = items.where("confirmation_accepted is not null").select("doc_id", F.col("item_id").alias("candidate_id"), F.col("confirmation_accepted").alias("_ok"))
    df = entries.join(done, ["doc_id", "candidate_id"], "left")
    return df.select("doc_id", "entry_id", (F.col("requires_confirmation") & F.col("_ok").isNull()).alias("requires_confirmation"), F.col("_ok").alias("confirmation_accepted"))


def final_items(lineage: DataFrame) -> DataFrame:
    """Merged and split items (doc_id, item_id, into_id) -> each item that went into others with the items that came of it in the end: doc_id, item_id, into_id, cyclic.

    Pointer doubling: after round k a pair spans 2**k links, or ends at an item that went no further.  Each round is one join of the written table with itself,
    so a plan never grows.  A walk of more links than a document has items goes in circles: items whose pairs are still open then
    lead into a cycle and give one row with a null into_id and ``cyclic`` true, beside the ends that they reach on other ways.  Links with a null are ignored.
    """
    links = lineage.select("doc_id", "item_id", "into_id").where("doc_id is not null and item_id is not null and into_id is not null").distinct()
    source = links.select("doc_id", F.col("item_id").alias("into_id")).distinct().withColumn("open", F.lit(True))
    pairs = written(links.join(source, ["doc_id", "into_id"], "left").select("doc_id", "item_id", "into_id", F.col("open").isNotNull().alias("open")), "lineage")
    longest = pairs.groupBy("doc_id").agg(F.count_distinct("item_id").alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach <= longest and not pairs.where("open").isEmpty():
        onward = pairs.select("doc_id", F.col("item_id").alias("into_id"), F.col("into_id").alias("_next"), F.col("open").alias("_open"))
        moved = pairs.where("open").drop("open").join(onward, ["doc_id", "into_id"]).select("doc_id", "item_id", F.col("_next").alias("into_id"), F.col("_open").alias("open"))
        pairs = written(pairs.where("not open").unionByName(moved).distinct(), "lineage")
        reach *= 2
    item = lineage.schema["into_id"].dataType
    return pairs.select("doc_id", "item_id", F.when(~F.col("open"), F.col("into_id")).cast(item).alias("into_id"), F.col("open").alias("cyclic")).distinct()


def remapped_targets(targets: DataFrame, lineage: DataFrame, excluded: DataFrame) -> DataFrame:
    """Requirement targets (doc_id, requirement_id, outcome, item_id) after merges, splits and exclusions; a requirement that loses all of them, or a global one that
    does not keep exactly one, is open again.  A target that only leads into a cycle is lost."""
    ends = final_items(lineage)
    moved = targets.join(ends, ["doc_id", "item_id"], "left").select("doc_id", "requirement_id", "outcome", F.when(F.col("cyclic").isNull(), F.col("item_id")).otherwise(F.col("into_id")).alias("item_id")).distinct()
    gone = excluded.select("doc_id", "item_id").distinct().withColumn("_out", F.lit(True))
    left = moved.join(gone, ["doc_id", "item_id"], "left").groupBy("doc_id", "requirement_id", "outcome").agg(F.array_sort(F.collect_list(F.when(F.col("_out").isNull(), F.col("item_id")))).alias("ids"))
    lost = (F.size("ids") == 0) | ((F.col("outcome") == "global_scope") & (F.size("ids") != 1))
    return left.select("doc_id", "requirement_id", F.when(lost, "unresolved").otherwise(F.col("outcome")).alias("outcome"), F.when(lost, F.array().cast("array<string>")).otherwise(F.col("ids")).alias("targets"))


def result_gate(results: DataFrame) -> Column:
    """Why an automatic result is not taken, the first rule that it breaks; null if it is.  Uses checked, blocking, completeness, mode, document_mode, router, document_router,
    n_candidates, n_ids, n_bad_decisions, n_bad_requirements, unresolved and evidence_ref."""
    c = F.col
    routed = c("mode").isin("shadow_uncertainty", "production_uncertainty") | (c("completeness") == "partial_review_required") | c("unresolved").isNotNull()
    expected = F.when(c("mode") == "production_uncertainty", F.concat(F.lit("symbol-routing-evidence://"), c("doc_id").cast("string")))
    return (
        F.when((c("blocking") > 0) | ~c("checked"), "coverage_blocking")
        .when(~c("completeness").isin("complete", "partial_review_required"), "completeness")
        .when(c("n_bad_decisions") > 0, "confidence_decision")
        .when(c("n_ids") != c("n_candidates"), "candidate_identity")
        .when(c("n_bad_requirements") > 0, "technical_requirements")
        .when(~c("mode").eqNullSafe(c("document_mode")), "recognition_mode")
        .when(~c("router").eqNullSafe(c("document_router")), "router_version")
        .when(routed & (c("unresolved").isNull() | (c("unresolved") < 0)), "recognition_summary")
        .when(routed & ((c("completeness") == "partial_review_required") != (c("unresolved") > 0)), "completeness_summary")
        .when(~c("evidence_ref").eqNullSafe(expected), "evidence_ref")
    )


def lifecycle_problems(documents: DataFrame) -> DataFrame:
    """doc_id and codes of documents (doc_id, lifecycle, predecessor, deleted_at) that break a rule of their lifecycle."""
    running = documents.where("lifecycle = 'reprocessing' and predecessor is not null").groupBy(F.col("predecessor").alias("_p")).agg(F.count("*").alias("_n"))
    df = documents.join(running, F.col("predecessor") == F.col("_p"), "left")
    codes = _codes(deleted_timestamp=(F.col("lifecycle") == "deleted") != F.col("deleted_at").isNotNull(), predecessor_self=F.col("predecessor") == F.col("doc_id"), several_successors=(F.col("lifecycle") == "reprocessing") & (F.col("_n") > 1))
    return df.select("doc_id", codes.alias("codes")).where("codes <> ''")


def catalogue_actions(documents: DataFrame, opened: DataFrame, leases: DataFrame, now: Column) -> DataFrame:
    """Active named documents by last opening, and whether each may be deleted: not while a successor is processed or an editor's lease runs.

    documents: doc_id, name, lifecycle, predecessor; opened: doc_id, ts; leases: doc_id, expires_at.
    """
    touched = opened.groupBy("doc_id").agg(F.max("ts").alias("last_opened"))
    held = leases.groupBy("doc_id").agg(F.max("expires_at").alias("_expires"))
    successor = documents.where("lifecycle = 'reprocessing'").select(F.col("predecessor").alias("doc_id")).distinct().withColumn("_successor", F.lit(True))
    live = documents.where("lifecycle = 'active' and name is not null").join(touched, "doc_id", "left").join(held, "doc_id", "left").join(successor, "doc_id", "left")
    refused = F.when(F.col("_successor"), "reprocessing").when(F.col("_expires") > now, "locked")
    return live.select("doc_id", "last_opened", refused.alias("refused"))


def lineage_problem(reviewed: DataFrame, working: DataFrame, results: DataFrame, files: DataFrame) -> DataFrame:
    """Reviewed results with the source file that they go back to, and where the chain of identities breaks.

    reviewed: doc_id, reviewed_id, working_id; working: working_id, w_doc, result_id; results: result_id, r_doc, file_id; files: file_id, mime, sha256, size, found_sha256, found_size.
    """
    df = reviewed.join(working, "working_id", "left").join(results, "result_id", "left").join(files, "file_id", "left")
    problem = (
        F.when(~_yes(F.col("w_doc") == F.col("doc_id")), "working_copy")
        .when(~_yes(F.col("r_doc") == F.col("doc_id")), "automatic_result")
        .when(~_yes(F.col("mime") == "application/pdf"), "source_file")
        .when(~_yes((F.col("sha256") == F.col("found_sha256")) & (F.col("size") == F.col("found_size"))), "source_identity")
    )
    return df.select("doc_id", "reviewed_id", F.when(problem.isNull(), F.col("file_id")).alias("file_id"), problem.alias("problem"))


def artifact_identity(exports: DataFrame, artifacts: DataFrame, listed: DataFrame) -> DataFrame:
    """Whether an export's artifacts, its manifest and the manifest's list all name its reviewed result: exports (export_id, reviewed_id, manifest_reviewed_id)."""
    own = lambda df, name: df.join(exports.select("export_id", F.col("reviewed_id").alias("_r")), "export_id").groupBy("export_id").agg(F.bool_and(F.col("reviewed_id").eqNullSafe(F.col("_r"))).alias(name))
    df = exports.join(own(artifacts, "_a"), "export_id", "left").join(own(listed, "_l"), "export_id", "left")
    code = F.when(~F.coalesce("_a", F.lit(True)), "artifacts_differ").when(~_yes(F.col("manifest_reviewed_id") == F.col("reviewed_id")) | ~F.coalesce("_l", F.lit(True)), "manifest_differs")
    return df.select("export_id", code.alias("code"))


def published(exports: DataFrame, artifacts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Artifacts that can be fetched: of a known kind, published, of an export that succeeded."""
    return artifacts.where(F.col("kind").isin(*kinds) & F.col("published_ref").isNotNull()).join(exports.where("status = 'success'").select("export_id"), "export_id", "left_semi")


def sheet_metadata(df: DataFrame) -> DataFrame:
    """Heads of sheets with their material tidied (none is empty), and whether nothing is missing."""
    tidy = F.when(F.trim("material") == "none", "").otherwise(F.trim("material"))
    complete = F.col("material").isNotNull()
    for f in REQUIRED_METADATA:
        complete = complete & ~_blank(F.col(f))
    return df.withColumn("complete", complete).withColumn("material", tidy)


def over_capacity(rows: DataFrame, most: int = CAPACITY) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), (F.count("*") > most).alias("over_capacity"))


def manifest_counts(items: DataFrame, balloons: DataFrame) -> DataFrame:
    """Counts of a manifest: active, required, accepted by policy, overridden by hand, balloons, and the policies' versions."""
    active = F.col("active")
    i = items.groupBy("doc_id").agg(
        F.count_if(active).alias("reviewed_item_count"), F.count_if(active & _yes(F.col("balloon_required"))).alias("balloon_required_count"), F.count_if(active & _yes(F.col("acceptance_source") == "confidence_policy")).alias("auto_accepted_item_count"),
        F.count_if(active & _yes(F.col("acceptance_source") == "manual_override")).alias("manual_override_item_count"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("policy_version") != "", F.col("policy_version")))), ",").alias("policy_versions"),
    )
    b = balloons.where("status = 'active'").groupBy("doc_id").agg(F.count("*").alias("balloon_count"))
    return i.join(b, "doc_id", "left").withColumn("balloon_count", F.coalesce("balloon_count", F.lit(0)))


def layout_report(control: DataFrame, current: DataFrame, reasons: DataFrame) -> DataFrame:
    """Candidate sources with and without layout rules, and where the lost ones went: for each document, for each reason of a document, and for the corpus.

    control, current: doc_id, source_id of candidates; reasons: doc_id, source_id, reason of today's coverage.
    """
    side = lambda df, name: df.select("doc_id", "source_id").distinct().withColumn(name, F.lit(1))
    both = side(control, "_c").join(side(current, "_n"), ["doc_id", "source_id"], "full_outer").join(reasons, ["doc_id", "source_id"], "left")
    lost = F.col("_n").isNull()
    both = both.withColumn("reason", F.when(lost, F.coalesce("reason", F.lit("none"))).otherwise("kept"))
    return both.rollup("doc_id", "reason").agg(F.count("_c").alias("control_sources"), F.count("_n").alias("current_sources"), F.count_if(lost).alias("rerouted"))


def workbench_sources(items: DataFrame, entries: DataFrame, geometry: DataFrame) -> DataFrame:
    """Every source that an active item or an open entry shows, with the items on it (none for a pending source).

    items: doc_id, item_id, active, source_ids, page_index; entries: doc_id, source_location_id, requires_confirmation, candidate_id, disposition; geometry: doc_id, source_id, page_index.
    """
    each = items.where("active").select("doc_id", "item_id", F.col("page_index").alias("_own"), F.explode("source_ids").alias("source_id"))
    found = each.join(geometry, ["doc_id", "source_id"], "left").withColumn("page_index", F.coalesce("page_index", F.when(F.col("source_id").startswith("manual:"), F.col("_own")))).where("page_index is not null")
    shown = found.groupBy("doc_id", "source_id").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.min("page_index").alias("page_index"))
    open_ = entries.where(_yes(F.col("requires_confirmation")) & F.col("candidate_id").isNull() & ~_yes(F.col("disposition") == "reference_context")).select("doc_id", F.col("source_location_id").alias("source_id")).distinct()
    pending = open_.join(shown, ["doc_id", "source_id"], "left_anti").join(geometry, ["doc_id", "source_id"]).select("doc_id", "source_id", F.array().cast("array<string>").alias("item_ids"), "page_index")
    return shown.unionByName(pending)


def list_entries(items: DataFrame, pending: DataFrame) -> DataFrame:
    """Items and pending sources as one list, sources after all items."""
    a = items.select("doc_id", F.lit("item").alias("kind"), F.col("item_id").alias("key"), "number")
    b = pending.select("doc_id", F.lit("source").alias("kind"), F.col("source_id").alias("key"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = [F.col("kind"), F.col("number").asc_nulls_last(), F.col("key")]
    return both.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def settlements(attempts: DataFrame) -> DataFrame:
    """Charge of each attempt: the computed cost of usage that can be verified, the whole reservation while it cannot, and that of attempts not settled.

    attempts: doc_id, attempt, started, reported, cost (null: usage is not valid), reservation.
    """
    state = F.when(~F.col("started"), "reserved_only").when(~F.col("reported"), "submission_started").when(F.col("cost").isNull(), "reserved_unknown").otherwise("settled_verified")
    df = attempts.withColumn("state", state)
    return df.select("doc_id", "attempt", "state", F.when(F.col("state") == "settled_verified", F.col("cost")).otherwise(F.col("reservation")).alias("charged"))


def ledger_totals(charged: DataFrame, budget: int) -> DataFrame:
    """Committed and remaining amounts of each document, and its attempts by state."""
    is_ = lambda *s: F.count_if(F.col("state").isin(*s))
    return charged.groupBy("doc_id").agg(
        F.sum("charged").alias("committed"), (F.lit(budget) - F.sum("charged")).alias("remaining"), F.count("*").alias("reservations"), is_("reserved_only").alias("reserved_only"), is_("submission_started", "reserved_unknown", "settled_verified").alias("started"),
        is_("submission_started").alias("unsettled"), is_("reserved_unknown", "settled_verified").alias("settled"),
    )


def preview_counts(candidates: DataFrame, visuals: DataFrame) -> DataFrame:
    """Counts of a preview: local candidates, and visuals by how they were resolved (cache, remote or pending)."""
    v = visuals.groupBy("doc_id").agg(*(F.count_if(F.col("resolution") == k).alias(n) for k, n in (("cache", "cache_resolved"), ("pending", "vlm_pending"), ("vlm", "vlm_resolved"), ("none", "unresolved"))))
    c = candidates.groupBy("doc_id").agg(F.count("*").alias("local_resolved"))
    return c.join(v, "doc_id", "full_outer").fillna(0)


def price_table_problem(tiers: DataFrame) -> DataFrame:
    """Of each price table (table_id, place, most_prompt, per_prompt, per_completion as text), the first rule that its tiers break: three tiers, whole and rising limits, plain decimals."""
    plain = lambda c: F.col(c).rlike(r"\A(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z")
    rising = F.lag("most_prompt").over(Window.partitionBy("table_id").orderBy("place"))
    df = tiers.withColumn("_up", rising.isNull() | (F.col("most_prompt") > rising)).withColumn("_plain", _yes(plain("per_prompt") & plain("per_completion")))
    g = df.groupBy("table_id").agg(F.count("*").alias("n"), F.bool_and(_yes(F.col("most_prompt") > 0)).alias("whole"), F.bool_and(_yes(F.col("_up"))).alias("up"), F.bool_and("_plain").alias("plain"))
    code = F.when(F.col("n") != 3, "tier_count").when(~F.col("plain"), "price_form").when(~F.col("whole"), "limit").when(~F.col("up"), "tier_order")
    return g.select("table_id", code.alias("code"))


# What a failed call means, by kind: event, scope, cause.
FAILURES = {
    "timeout": ("provider_timeout", "roi_localized", None), "transport": ("provider_transport_failure", "roi_localized", None), "schema": ("provider_schema_invalid", "roi_localized", None),
    "authentication": ("provider_authentication_failed", "project_blocking", "invalid_configuration"), "request_rejected": ("provider_request_rejected", "project_blocking", "processing_defect"), "rate_limited": ("provider_rate_limited", "project_blocking", "transient_provider_failure"),
    "service_failure": ("provider_service_failure", "project_blocking", "transient_provider_failure"), "metadata_invalid": ("provider_metadata_invalid", "project_blocking", "processing_defect"), "unclassified": ("provider_unclassified_failure", "project_blocking", "processing_defect"),
}


def failure_meaning(category: Column) -> Column:
    """Struct (event, scope, cause) of a kind of failure."""
    out = F.lit(None)
    for name, (event, scope, cause) in FAILURES.items():
        out = F.when(category == name, F.struct(F.lit(event).alias("event"), F.lit(scope).alias("scope"), F.lit(cause).cast("string").alias("cause"))).otherwise(out)
    return out


SECRET_WORDS = "authorization|api[_-]?key|secret|credential|bearer|token|password|passwd|cookie|session"


def request_id_state(value: Column) -> Column:
    """Whether a request's id can be kept: up to 128 plain characters without a word that names a secret."""
    good = value.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z") & ~F.lower(value).rlike(SECRET_WORDS)
    return F.when(value.isNull(), "absent").when(good, "accepted").otherwise("rejected")
