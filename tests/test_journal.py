import hashlib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from caliperlake.operators import journal, releases
from caliperlake.streaming import journal as running

COLUMNS = [c.split()[0] for c in journal.FACT_SCHEMA.split(", ")]
BUDGET = 100_000_000


def facts_of(rng, docs, attempts):
    """Journals with every problem, replays and conflicts."""
    rows = []
    sha = lambda *x: hashlib.sha256(repr(x).encode()).hexdigest()
    for d in range(docs):
        for a in range(1, attempts + 1):
            k = rng.randrange(24)
            reading = k % 3 == 0
            provider, amount = ("reading", journal.READING_PRICE) if reading else ("vision", journal.VISION_RESERVATION)
            base = dict.fromkeys(COLUMNS) | {"doc_id": d, "attempt": a, "provider": provider, "page_index": a % 3, "subject": f"s{a % 4}"}
            reserved = base | {"fact": "reserved", "hash": sha(d, a, 0), "amount": amount + (k == 7)}
            started = base | {"fact": "submission_started", "hash": sha(d, a, 1), "parent": sha(d, a, 0 if k != 8 else 9)}
            usage = None if reading or k == 1 else (1000 * k, 10 * k)
            claim = "reserved_unknown" if k in (1, 13) else "settled_verified" if k != 10 else "paid"
            charge = amount if claim == "reserved_unknown" else journal.READING_PRICE if reading else running.usage_micros(*usage) if usage else 0
            settled = base | {"fact": "settled", "hash": sha(d, a, 2), "parent": sha(d, a, 1), "claim": claim, "amount": charge + (k == 11), "request_id": "r" if k != 14 else None, "request_state": "accepted"}
            if usage:
                settled |= {"prompt_tokens": usage[0], "completion_tokens": usage[1]}
            chosen = [reserved] * (k != 4) + [started] * (k not in (5, 6)) + [settled] * (k not in (6, 16, 17))
            if k == 19:
                chosen.append(started | {"hash": sha(d, a, 7)})
            if k == 20:
                chosen.append(dict(settled))
            rows += chosen
    return [tuple(r[c] for c in COLUMNS) for r in rows]


@pytest.fixture(scope="module")
def facts(spark):
    rows = facts_of(random.Random(4), 12, 30)
    return rows, spark.createDataFrame(rows, journal.FACT_SCHEMA).cache()


def stream(spark, tmp, name, parts, kill_after=None):
    """Runs the parts as files through the stream, in two runs if told so; the changes as a table."""
    schema, made = journal.FACT_SCHEMA, tmp / name
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(made / "in" / f"p={k}"))
        if k + 1 == kill_after or k + 1 == len(parts):
            source = spark.readStream.schema(schema + ", p int").option("maxFilesPerTrigger", 1).parquet(str(made / "in"))
            with running.keyed_state(spark):
                q = running.running_entries(source, BUDGET).writeStream.outputMode("update").option("checkpointLocation", str(made / "state")).trigger(availableNow=True)
                q = q.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(made / "out" / f"batch={n}"))).start()
                assert q.awaitTermination(240) and q.exception() is None
    return spark.read.parquet(str(made / "out"))


def rows(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def test_all_problems_occur_and_totals_are_those_of_the_settlements(facts):
    _, df = facts
    found = journal.entries(df)
    problems = {r.problem for r in found.select("problem").distinct().collect()}
    assert problems == {None, "conflict", "reservation_missing", "reservation_amount", "settled_before_start", "broken_link", "settlement_state", "request_identity", "unknown_settlement", "verified_settlement"}
    good = found.where("problem is null")
    started = F.col("state") != "reserved_only"
    same = releases.settlements(good.select("doc_id", "attempt", started.alias("started"), F.col("state").isin(*journal.SETTLED_STATES).alias("reported"), F.when(F.col("state") == "settled_verified", F.col("charged")).alias("cost"), F.when(F.col("provider") == "reading", journal.READING_PRICE).otherwise(journal.VISION_RESERVATION).cast("bigint").alias("reservation")))
    assert rows(releases.ledger_totals(same, BUDGET).select("doc_id", "committed", "remaining")) == rows(journal.totals(good, BUDGET).select("doc_id", "committed", "remaining"))


@pytest.mark.parametrize(("name", "pieces", "kill_after"), [("one", 1, None), ("shuffled", 4, 2)])
def test_any_split_and_a_restart_give_the_batch_result(spark, facts, tmp_path, name, pieces, kill_after):
    made, df = facts
    order = list(made)
    if pieces > 1:
        random.Random(pieces).shuffle(order)  # settlements before their starts, replays far apart
    changes = stream(spark, tmp_path, name, [order[k::pieces] for k in range(pieces)], kill_after)
    batch = journal.entries(df)
    assert rows(running.latest_entries(changes).drop("was_overdue")) == rows(batch)
    assert rows(running.latest_totals(changes)) == rows(journal.totals(batch, BUDGET))


def test_a_timer_tells_of_calls_not_settled_in_time(spark, tmp_path):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    base = dict.fromkeys(COLUMNS) | {"doc_id": 1, "attempt": 1, "provider": "vision", "page_index": 0, "subject": "s"}
    first = [base | {"fact": "reserved", "hash": sha("a"), "amount": journal.VISION_RESERVATION}, base | {"fact": "submission_started", "hash": sha("b"), "parent": sha("a")}]
    later = [r | {"doc_id": 2} for r in first[:1]]
    for k, part in enumerate((first, later)):
        spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in part], journal.FACT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
    source = spark.readStream.schema(journal.FACT_SCHEMA + ", p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with running.keyed_state(spark):
        q = running.running_entries(source, BUDGET, patience_ms=0).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second")
        q = q.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={n}"))).start()
        try:
            for _ in range(60):
                done = [p for p in q.recentProgress if p["batchId"] >= 3]
                if done or q.awaitTermination(2):
                    break
        finally:
            q.stop()
        assert q.exception() is None and done
    got = {r.doc_id: r for r in running.latest_entries(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert (got[1].state, got[1].was_overdue, got[2].state, got[2].was_overdue) == ("submission_started_unknown", True, "reserved_only", False)


def test_limits_of_pages_and_subjects(spark):
    base = dict.fromkeys(COLUMNS) | {"doc_id": 1, "fact": "reserved", "provider": "vision", "page_index": 0, "amount": journal.VISION_RESERVATION}
    made = [base | {"attempt": a, "hash": f"h{a}", "subject": f"s{a if a < 18 else 1}"} for a in range(1, 20)]
    found = journal.entries(spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in made], journal.FACT_SCHEMA))
    assert {(r.attempt, r.limit) for r in journal.over_limits(found).collect()} == {(17, "page"), (18, "page"), (19, "page")}


class Held(dict):
    """A state variable in memory that counts the calls to the store."""

    calls = 0

    def _called(self):
        Held.calls += 1
        return self

    def containsKey(self, k):  # noqa: N802
        return k in self._called()

    def getValue(self, k):  # noqa: N802
        return self._called()[k]

    def updateValue(self, k, v):  # noqa: N802
        self._called()[k] = v

    def removeKey(self, k):  # noqa: N802
        del self._called()[k]

    def exists(self):
        return "v" in self._called()

    def get(self):
        return self._called()["v"]

    def update(self, v):
        self._called()["v"] = v


def run_journal(batches):
    """The state machine of one document over batches of facts: its last table for each attempt, sums, entries and the calls that the last batch made."""
    machine = running._Journal(BUDGET, None)
    machine.chunks, machine.due, machine.sums = Held(), Held(), Held()
    last = {}
    for batch in batches:
        Held.calls = 0
        for table in machine.handleInputRows((0,), iter([pd.DataFrame(batch, columns=COLUMNS)]), None):
            last |= {r.attempt: (r.state, r.charged, r.problem) for r in table.itertuples()}
    return last, machine.sums["v"], machine.chunks, Held.calls


def test_attempts_that_are_far_apart_share_entries_and_full_entries_are_split():
    rng = random.Random(7)
    step = COLUMNS.index("attempt")
    made = [tuple(v * 1500 + 3 if k == step else v for k, v in enumerate(r)) for r in facts_of(rng, 1, 700)]
    whole, sums, chunks, calls = run_journal([made])
    assert len(whole) == 700 and len(chunks) <= 16 and calls <= 24  # one entry for each attempt would be 700, and 1400 calls
    order = list(made)
    rng.shuffle(order)
    parts = [order[:5], *(order[5 + k :: 9] for k in range(9)), order[:40]]  # grows from one entry; the last part is replays
    again, later, pieces, _ = run_journal(parts)
    assert again == whole and later[1:] == sums[1:]
    assert sorted(pieces) == sorted(chunks)
    assert sorted(a for (v,) in pieces.values() for a in running.json.loads(v)) == sorted(str(a) for a in whole)
