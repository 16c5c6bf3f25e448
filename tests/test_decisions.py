from caliperlake import registry
from caliperlake.operators import decisions as D

CANDIDATE = (
    "doc_id long, row_id string, candidate_id string, payload_id string, source_ids array<string>, item_type string, nominal double, feature_kind string, thread_spec string, through boolean, thread_depth double, radius double, angle double, scope string, "
    "parts array<struct<order int, kind string, nominal double, feature_kind string, thread_spec string, through boolean, thread_depth double, value double, flag boolean>>, coarse boolean, raw_text string, normalized_text string, boxed boolean, source_truth boolean, "
    "requires_confirmation boolean, balloon_required boolean, review_code string"
)
ENTRY = "doc_id long, observation_id string, source_location_id string, candidate_id string, disposition string, requires_confirmation boolean, review_code string"


def candidate(row, name, sources, kind="radius", **other):
    said = dict(doc_id=1, row_id=row, candidate_id=name, payload_id=name, source_ids=sources, item_type=kind, radius=4.0, scope="global_requirement", coarse=False, raw_text="t", normalized_text="t", boxed=True, source_truth=True, requires_confirmation=False, balloon_required=True)
    return tuple((said | other).get(c.split(" ")[0]) for c in fields())


def fields():
    depth, out = 0, [""]
    for c in CANDIDATE:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [c.strip() for c in out]


def entry(source, name, disposition="candidate", confirm=False, code=None, observation=None):
    return (1, observation or source, source, name, disposition, confirm, code)


def decided(spark, candidates, entries, duplicates=(), signals=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    found = D.confidence_decisions(
        frame(candidates, CANDIDATE), frame(entries, ENTRY), frame([(1, d) for d in duplicates], "doc_id long, candidate_id string"),
        frame([(1, s, k, float(v)) for s, k, v in signals], "doc_id long, source string, source_type string, value double"), frame([(1, True, 0)], "doc_id long, checked boolean, blocking int"),
    )
    return sorted((r.row_id, r.band, set(r.evidence_codes)) for r in found.collect())


def test_candidates_without_an_id_are_decided_and_meet_nothing_that_has_none(spark):
    """A candidate without an id was lost; it is not tied to entries and duplicates that have none either."""
    rows = decided(spark, [candidate("r1", None, ["a"]), candidate("r2", None, None), candidate("r3", "c", [])], [entry("a", None), entry("b", None, "ambiguous", True)], [None], [("a", "native", 1)])
    assert [r[:2] for r in rows] == [("r1", "low"), ("r2", "low"), ("r3", "low")]
    assert {"local_association_missing", "no_conflict", "source_signal_high", "typed_schema_incomplete"} <= rows[0][2]
    assert {"source_location_missing", "semantic_confirmation_clear"} <= rows[2][2]


def test_owners_signals_entries_and_reviews_meet(spark):
    sure = [("a", "native", 1), ("b", "ocr", 0.8), ("c", "ocr", 0.9), ("c", "ocr", 0.9), ("d", "visual", 0.5), ("e", "other", 1), ("f", "ocr", 0.97)]
    rows = decided(
        spark,
        [
            candidate("r1", "k1", ["a"]), candidate("r2", "k2", ["a", "b", None]), candidate("r3", "k3", ["c", "c"]), candidate("r4", "k4", ["d", "f"]), candidate("r5", "k5", ["e"]), candidate("r6", "k6", ["x"]),
            candidate("r7", "k7", ["f2"]), candidate("r8", "k7", ["f3"]), candidate("r9", "k9", ["g"], "general_requirement", balloon_required=False),
        ],
        [entry("a", "k1"), entry("a", "k2"), entry("b", "k2"), entry("c", "k3"), entry("d", "k4"), entry("f", "k4"), entry(None, "zz", "ambiguous", False, "projection_conflict", "e"), entry(None, "k6", "x", True, "cross_view", "q"), entry("g", "k9"), entry("f2", "k7"), entry("f3", "k7")],
        ["k4"], [*sure, ("f2", "native", 1), ("f3", "native", 1), ("g", "native", 1)],
    )
    by = {r[0]: r for r in rows}
    assert len(rows) == 9 and by["r9"][1] == "high"  # complete by its native source
    assert {"source_owner_conflict", "local_association_complete", "source_signal_high"} <= by["r1"][2]
    assert {"source_location_missing", "local_association_complete"} <= by["r2"][2]
    assert {"source_owner_conflict", "source_signal_invalid"} <= by["r3"][2]
    assert {"possible_duplicate", "source_signal_low", "cross_view_conflict"} <= by["r4"][2]
    assert {"ambiguous_source", "projection_conflict", "provider_schema_rejected", "source_signal_invalid"} <= by["r5"][2]
    assert {"source_signal_missing", "cross_view_conflict", "semantic_confirmation_required", "local_association_missing"} <= by["r6"][2]
    assert "typed_schema_incomplete" in by["r7"][2] and "typed_schema_incomplete" in by["r8"][2]


def test_rows_are_dealt_by_source_and_by_candidate_once(spark):
    plan = registry.QUERIES["cls09_cls30_join09_confidence_decisions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 4  # by source, by candidate, and two by document for its coverage
