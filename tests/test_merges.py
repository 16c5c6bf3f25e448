import random

from caliperlake.operators.merges import merge_outcomes

DECISIONS = "doc_id long, decision long, visual_id string, existing string, source_ids array<string>, x0 double, y0 double, x1 double, y1 double, disposition string, code string, candidate_id string, requires_confirmation boolean, signal double, fields map<string,string>, note string"


def naive(decisions, visuals, candidates):
    """The outcome of one document, candidate by candidate."""
    out = {d["decision"]: {**d, "primary": False, "truth_preserved": None} for d in decisions}
    place = lambda v: (0, *visuals[v]) if v in visuals else (1,)
    for c in sorted({d["existing"] for d in decisions if d["existing"] is not None}):
        mine = [d for d in decisions if d["existing"] == c]
        if len({tuple(d["source_ids"]) for d in mine}) < 2:
            continue
        order = sorted(mine, key=lambda d: (place(d["visual_id"]), d["visual_id"], d["decision"]))
        sources = list(dict.fromkeys(s for d in order for s in d["source_ids"]))
        sources = sorted((s for s in sources if s in visuals), key=lambda s: (place(s), s)) + [s for s in sources if s not in visuals]
        speakers = []
        for key in dict.fromkeys(tuple(d["source_ids"]) for d in mine):
            group = [d for d in mine if tuple(d["source_ids"]) == key]
            speakers.append(next((d for d in group if d["fields"] is not None), group[0]))
        base, changed = candidates.get(c), {}
        good = base is not None and c != "" and all(d["disposition"] == "candidate" and d["code"] is None and d["candidate_id"] == c and d["fields"] is not None for d in speakers)
        if good:
            for d in speakers:
                for k, v in d["fields"].items():
                    if k != "coordinates" and v != base.get(k):
                        good = good and changed.setdefault(k, v) == v
        unsure = any(d["requires_confirmation"] for d in speakers)
        for d in mine:
            o = out[d["decision"]]
            o["source_ids"] = sources
            o.update({k: f(m[k] for m in mine) for k, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))}, fields=None)
            if good:
                o.update(requires_confirmation=unsure, signal=min((s["signal"] for s in speakers if s["signal"] is not None), default=None))
            else:
                o.update(disposition="ambiguous", code="visual_projection_conflict", candidate_id=None, requires_confirmation=True)
        if good:
            out[order[0]["decision"]].update(primary=True, truth_preserved=not unsure, fields={**base, **changed})
    return out


def test_outcomes_of_random_documents(spark):
    rng, rows, seen, known, want = random.Random(8), [], [], [], {}
    for doc in range(40):
        visuals = {f"v{k}": (rng.randrange(2), float(rng.randrange(3)), float(rng.randrange(3))) for k in range(6)}
        candidates = {c: {"depth": "5", "kind": "hole", "coordinates": "[]"} for c in ("a", "b", "")}
        decisions = []
        for k in range(rng.randrange(0, 12)):
            c = rng.choice(["a", "a", "a", "b", "c", "", None])
            fields = rng.choice([None, {"depth": "5", "kind": "hole"}, {"depth": "7", "coordinates": "[1]"}, {"depth": "7", "size": None}, {"depth": rng.choice("789")}])
            good = rng.random() < 0.9
            decisions.append({
                "decision": k, "visual_id": f"v{rng.randrange(8)}", "existing": c, "source_ids": rng.sample(["v0", "v1", "v5", "v6", "t1", "t2", "t3"], rng.randrange(0, 4)), "x0": float(rng.randrange(9)), "y0": 1.0, "x1": float(rng.randrange(9, 20)), "y1": 2.0,
                "disposition": "candidate" if good else "ambiguous", "code": None if good else "visual_local_parse_failed", "candidate_id": c if good else None, "requires_confirmation": rng.random() < 0.3, "signal": rng.choice([None, 0.25, 0.5]), "fields": fields,
            })
        want |= {(doc, k): v for k, v in naive(decisions, visuals, candidates).items()}
        rows += [(doc, *d.values(), "x") for d in decisions]
        seen += [(doc, v, *p) for v, p in visuals.items()] * (1 + doc % 2)
        known += [(doc, c, f) for c, f in candidates.items()]
    d = spark.createDataFrame(rows, DECISIONS)
    v = spark.createDataFrame(seen, "doc_id long, visual_id string, page_index int, y0 double, x0 double")
    c = spark.createDataFrame(known, "doc_id long, candidate_id string, fields map<string,string>")
    got = {(r.doc_id, r.decision): r.asDict() for r in merge_outcomes(d.repartition(3), v, c).collect()}
    assert len(got) == len(want) == len(rows) and sum(w["primary"] for w in want.values()) > 5 and sum(w["code"] == "visual_projection_conflict" for w in want.values()) > 20
    for k, w in want.items():
        assert {n: got[k][n] for n in w if n != "existing"} == {n: x for n, x in w.items() if n != "existing"}, k
    assert merge_outcomes(d.limit(0), v, c).count() == 0


def test_decisions_are_read_for_their_projections_and_for_the_result_only(spark, tmp_path):
    spark.createDataFrame([(1, k, f"v{k}", "a", [f"v{k}"], 0.0, 0.0, 1.0, 1.0, "candidate", None, "a", False, None, {"depth": "7"}, "x") for k in range(4)], DECISIONS).write.parquet(str(tmp_path / "d"))
    out = merge_outcomes(spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame([], "doc_id long, visual_id string, page_index int, y0 double, x0 double"), spark.createDataFrame([(1, "a", {"depth": "5"})], "doc_id long, candidate_id string, fields map<string,string>"))
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Relation [" in line and "disposition#" in line for line in plan) == 1  # the projections are a table of their own
    assert {(r.decision, r.primary, str(r.fields)) for r in out.collect()} == {(0, True, "{'depth': '7'}"), *((k, False, "None") for k in (1, 2, 3))}
