import random

from pyspark.sql import functions as F


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(1)
    filler = [f"word{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    passage = text(60)
    rows = [(i, text(80)) for i in range(40)]
    rows += [(100, rows[3][1]), (101, text(40) + " " + passage + " " + text(40)), (102, passage + " " + text(60)), (103, "write to a.b@c.org please " + text(20)), (104, None), (105, "")]
    rows += [(200 + i, text(30) + " idiot moron stupid trash scum " + text(30)) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(40)] + [(200 + i, 1, 1) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, seen = docs, {}
    for name, stage in P.STAGES:
        at = P.materialise(stage(spark, at, str(tmp_path)), "t")
        seen[name] = at
        if name != "best_fit_packing":
            assert at.columns == docs.columns
    ids = lambda n: {r.doc_id for r in seen[n].collect()}
    assert ids("toxicity") == {i for i, _ in rows if i < 200}
    assert ids("near_dedup") == ids("toxicity") - {100}
    assert ids("pii") == ids("near_dedup") == {r.doc_id for r in seen["best_fit_packing"].collect()}
    cut = {r.doc_id: r.text for r in seen["suffix_array_dedup"].collect()}
    assert passage not in cut[101] and passage not in cut[102] and cut[5] == rows[5][1]
    masked = {r.doc_id: r for r in seen["pii"].collect()}
    assert masked[103].text.startswith("write to [EMAIL] please") and masked[103].n_chars == len(masked[103].text)
    assert {(r.doc_id, r.piece) for r in P.run(spark, str(tmp_path)).collect()} == {(r.doc_id, r.piece) for r in seen["best_fit_packing"].collect()}
    assert seen["pii"].where(F.col("text").contains("@")).isEmpty()


def test_near_copies_with_repeated_ids_and_empty_tables(spark):
    import corpus_pipeline as P

    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (1, a), (1, b), (2, a), (2, b + " x"), (3, b), (None, "no id here at all today"), (None, a), (4, None), (4, None), (5, ""), (6, " ")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, _kept int")
    got = sorted(map(str, P.keep_one_of_near_copies(spark, docs, "").collect()))
    want = [(1, a), (1, b), (None, "no id here at all today"), (4, None), (5, ""), (6, " ")]
    assert got == sorted(str(r) for r in spark.createDataFrame([(i, t, 7) for i, t in want], docs.schema).collect())
    none = docs.limit(0)
    for stage in (P.keep_one_of_near_copies, P.drop_repeated_strings, P.mask_personal_data):
        out = stage(spark, none, "")
        assert out.count() == 0 and out.columns == docs.columns
