"""Queries of the journal of paid calls, as a batch and as a stream, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caliperlake.operators import journal as J
from caliperlake.plans.register import query
from caliperlake.scratch import new_path
from caliperlake.sources import adapters as S
from caliperlake.streaming import journal as running

_BUDGET = 100_000_000
_N = "CAST(event_id AS STRING)"
_PROVIDER, _RESERVED = "CASE WHEN event_id % 3 = 0 THEN 'reading' ELSE 'vision' END", "CASE WHEN event_id % 3 = 0 THEN 150000 ELSE 1763328 END"
_PROMPT, _DONE = "CAST(round(value * 100) AS BIGINT) % 1000 * 300", "CAST(round(value * 100) AS BIGINT) % 331 * 100"
_COST = f"CASE WHEN {_PROMPT} > 260096 OR {_DONE} > 32768 THEN 0 WHEN {_PROMPT} <= 32768 THEN {_PROMPT} + {_DONE} * 10 WHEN {_PROMPT} <= 131072 THEN CAST(ceil(({_PROMPT} * 3 + {_DONE} * 30) / 2.0) AS BIGINT) ELSE {_PROMPT} * 3 + {_DONE} * 30 END"
_CLAIM = "CASE event_id % 13 WHEN 1 THEN 'reserved_unknown' WHEN 2 THEN 'paid' ELSE 'settled_verified' END"
_COUNTED = "event_id % 3 <> 0 AND (event_id % 13 <> 1 OR event_id % 2 = 0)"


def _fact(kind: str, **columns: str) -> dict[str, str]:
    base = {c.split()[0]: f"CAST(NULL AS {c.split()[1]})" for c in J.FACT_SCHEMA.split(", ")}
    own = {"doc_id": "user_id", "attempt": "event_id", "fact": f"'{kind}'", "provider": _PROVIDER, "page_index": "CAST(event_id % 3 AS INT)", "subject": "event_type"}
    return base | own | columns


_FACTS = [
    ("event_id % 23 <> 4", _fact("reserved", hash=f"md5('r' || {_N})", amount=f"CAST(CASE WHEN event_id % 19 = 7 THEN 5 ELSE {_RESERVED} END AS BIGINT)")),
    ("event_id % 23 NOT IN (5, 6)", _fact("submission_started", hash=f"md5('s' || {_N})", parent=f"CASE WHEN event_id % 29 = 8 THEN 'x' ELSE md5('r' || {_N}) END", provider=f"CASE WHEN event_id % 31 = 0 THEN 'other' ELSE {_PROVIDER} END")),
    ("event_id % 23 NOT IN (6, 16, 17)", _fact("settled", hash=f"md5('t' || {_N})", parent=f"CASE WHEN event_id % 41 = 0 THEN md5('r' || {_N}) ELSE md5('s' || {_N}) END", claim=_CLAIM, prompt_tokens=f"CASE WHEN {_COUNTED} THEN {_PROMPT} END", completion_tokens=f"CASE WHEN {_COUNTED} THEN {_DONE} END",
        amount=f"CAST(CASE WHEN event_id % 13 = 1 THEN {_RESERVED} WHEN event_id % 3 = 0 THEN 150000 ELSE {_COST} END + CASE WHEN event_id % 17 = 3 THEN 1 ELSE 0 END AS BIGINT)", request_id="CASE WHEN event_id % 11 <> 0 THEN 'q' END", request_state="CASE WHEN event_id % 43 = 0 THEN 'lost' WHEN event_id % 11 <> 0 OR event_id % 22 = 0 THEN 'accepted' ELSE 'absent' END")),
    ("event_id % 37 = 0", _fact("submission_started", hash=f"md5('u' || {_N})")),
]

# The rules once more, on the three facts of an attempt side by side.
_ENTRIES = f"""{S.derived_sql('f', 'events', _FACTS)}, g AS (SELECT attempt, fact, count(DISTINCT hash) AS kinds, arg_min(f, hash) AS b FROM f GROUP BY ALL), k AS (SELECT attempt, max(kinds) AS kinds FROM g GROUP BY ALL),
j AS (SELECT k.attempt, k.kinds, r.b AS r, s.b AS s, t.b AS t, coalesce(r.b.doc_id, s.b.doc_id, t.b.doc_id) AS doc_id FROM k LEFT JOIN g r ON r.attempt = k.attempt AND r.fact = 'reserved' LEFT JOIN g s ON s.attempt = k.attempt AND s.fact = 'submission_started' LEFT JOIN g t ON t.attempt = k.attempt AND t.fact = 'settled'),
p AS (SELECT *, t.prompt_tokens AS pt, t.completion_tokens AS ct FROM j),
c AS (SELECT *, CASE WHEN pt IS NULL OR ct IS NULL OR pt > 260096 OR ct > 32768 THEN NULL WHEN pt <= 32768 THEN pt + ct * 10 WHEN pt <= 131072 THEN (pt * 3 + ct * 30 + 1) // 2 ELSE pt * 3 + ct * 30 END AS cost FROM p),
w AS (SELECT *, CASE WHEN kinds > 1 THEN 'conflict' WHEN r IS NULL THEN 'reservation_missing' WHEN r.amount <> CASE r.provider WHEN 'reading' THEN 150000 ELSE 1763328 END THEN 'reservation_amount' WHEN t IS NOT NULL AND s IS NULL THEN 'settled_before_start'
  WHEN s IS NOT NULL AND (coalesce(s.parent, '') <> r.hash OR s.provider <> r.provider) THEN 'broken_link' WHEN t IS NOT NULL AND t.parent <> s.hash THEN 'broken_link' WHEN t.claim NOT IN ('settled_verified', 'reserved_unknown') THEN 'settlement_state'
  WHEN t.request_state NOT IN ('absent', 'accepted', 'rejected') OR (t.request_id IS NULL) = (t.request_state = 'accepted') THEN 'request_identity' WHEN t.claim = 'reserved_unknown' AND (pt IS NOT NULL OR ct IS NOT NULL OR t.amount <> r.amount) THEN 'unknown_settlement'
  WHEN t.claim = 'settled_verified' AND CASE WHEN r.provider = 'reading' THEN pt IS NOT NULL OR ct IS NOT NULL OR t.amount <> 150000 ELSE cost IS NULL OR t.amount <> cost OR t.amount > r.amount END THEN 'verified_settlement' END AS problem FROM c),
e AS (SELECT doc_id, attempt, r.provider AS provider, r.page_index AS page_index, r.subject AS subject, problem, CASE WHEN problem IS NOT NULL THEN 'invalid' WHEN t IS NOT NULL THEN t.claim WHEN s IS NOT NULL THEN 'submission_started_unknown' ELSE 'reserved_only' END AS state,
  CASE WHEN problem IS NULL AND t IS NOT NULL THEN t.amount ELSE coalesce(r.amount, 0) END AS charged FROM w)"""
_TOTALS = f"""SELECT doc_id, CAST(sum(charged) AS BIGINT) AS committed, CAST({_BUDGET} - sum(charged) AS BIGINT) AS remaining, count(*) AS attempts, count(*) FILTER (state = 'reserved_only') AS reserved_only, count(*) FILTER (state = 'submission_started_unknown') AS unsettled,
  count(*) FILTER (state IN ('settled_verified', 'reserved_unknown')) AS settled, count(*) FILTER (state = 'invalid') AS invalid, min(attempt) = 1 AND max(attempt) = count(*) AS contiguous FROM e GROUP BY doc_id"""


@query(f"WITH {_ENTRIES} SELECT * FROM e")
def join22_journal_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.entries(S.derived(S.table(spark, sf_dir, "events"), _FACTS))


@query(f"WITH {_ENTRIES} {_TOTALS}")
def agg19_journal_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.totals(join22_journal_entries(spark, sf_dir), _BUDGET)


@query(f"WITH {_ENTRIES}, q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, provider, page_index ORDER BY attempt) AS a, row_number() OVER (PARTITION BY doc_id, provider, subject ORDER BY attempt) AS b FROM e WHERE problem IS DISTINCT FROM 'reservation_missing') SELECT doc_id, attempt, CASE WHEN a > 16 THEN 'page' ELSE 'subject' END AS \"limit\" FROM q WHERE a > 16 OR provider = 'vision' AND b > 2")
def join22_journal_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.over_limits(join22_journal_entries(spark, sf_dir))


@query(f"WITH {_ENTRIES}, z AS ({_TOTALS}) SELECT e.*, z.* EXCLUDE (doc_id) FROM e JOIN z USING (doc_id)")
def str02_running_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, through the state machine until all are read; the last word on each attempt and document."""
    facts = S.derived(spark.readStream.schema(S.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet"), _FACTS)  # a stream's path is a folder or a pattern, never one file
    at = new_path(spark, "str02")
    with running.keyed_state(spark):
        q = running.running_entries(facts, _BUDGET).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
        q.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/changes/batch={n}")).start().awaitTermination()
    changes = spark.read.parquet(f"{at}/changes")
    return running.latest_entries(changes).drop("was_overdue").join(running.latest_totals(changes), "doc_id")
