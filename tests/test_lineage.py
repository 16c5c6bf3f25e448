from caliperlake.operators import releases

LINKS = "doc_id long, item_id long, into_id long"


def ends(spark, links):
    return {(r.doc_id, r.item_id, r.into_id, r.cyclic) for r in releases.final_items(spark.createDataFrame(links, LINKS)).collect()}


def test_a_chain_of_100_000_steps_takes_18_rounds(spark, monkeypatch):
    rounds, real = [], releases.written
    monkeypatch.setattr(releases, "written", lambda df, name: rounds.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation")) or real(df, name))
    links = spark.range(100_000).selectExpr("0L AS doc_id", "id AS item_id", "id + 1 AS into_id")
    found = releases.final_items(links)
    assert found.count() == found.where("into_id = 100000 AND NOT cyclic").count() == 100_000
    assert len(rounds) <= 1 + 17 and max(rounds) <= 3  # the first table and its rounds, each over written tables only


def test_merges_and_splits(spark):
    got = ends(spark, [(1, 1, 3), (1, 2, 3), (1, 3, 4), (1, 3, 5), (1, 5, 6), (1, 5, 6), (2, 1, 9), (1, None, 1), (None, 1, 2), (1, 7, None)])
    assert got == {(1, 1, 4, False), (1, 1, 6, False), (1, 2, 4, False), (1, 2, 6, False), (1, 3, 4, False), (1, 3, 6, False), (1, 5, 6, False), (2, 1, 9, False)}


def test_cycles_are_reported_and_leave_other_ends_alone(spark):
    got = ends(spark, [(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 0, 1), (1, 0, 9), (1, 5, 5), (1, 7, 8), (2, 1, 2)])
    assert got == {(1, 1, None, True), (1, 2, None, True), (1, 3, None, True), (1, 0, None, True), (1, 0, 9, False), (1, 5, None, True), (1, 7, 8, False), (2, 1, 2, False)}
    assert ends(spark, []) == set()


def test_targets_of_a_cycle_are_lost(spark):
    links = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 4), (1, 3, 5)], LINKS)
    targets = spark.createDataFrame([(1, 1, "matched_items", 1), (1, 2, "matched_items", 3), (1, 3, "global_scope", 3), (1, 4, "matched_items", 9)], "doc_id long, requirement_id long, outcome string, item_id long")
    out = releases.remapped_targets(targets, links, spark.createDataFrame([(1, 5)], "doc_id long, item_id long")).collect()
    assert {(r.requirement_id, r.outcome, *r.targets) for r in out} == {(1, "unresolved"), (2, "matched_items", 4), (3, "global_scope", 4), (4, "matched_items", 9)}
