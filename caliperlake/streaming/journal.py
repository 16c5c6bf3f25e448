"""The journal of paid calls as running state: one state machine for each document, fed with facts in any order.

The end state is that of ``operators.journal.entries`` and ``totals`` over the same rows, however they are cut into batches: a fact that comes before the one that it
follows waits in the state, a replay changes nothing, a second hash makes a conflict.  State lives in the state store (RocksDB), one map entry for some
64 attempts, so a document's journal may be larger than a task's memory.  Attempts are dealt to entries by a hash, whose first bits are taken, as many as the journal needs: numbers that are far apart
share entries too, as every entry is a call to the store and back.  A timer tells of calls that were started and not settled in time.
"""

from __future__ import annotations

import contextlib
import json
from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caliperlake.operators.journal import READING_PRICE, REQUEST_STATES, SETTLED_STATES, VISION_RESERVATION
from caliperlake.operators.ledger import MOST_COMPLETION, MOST_PROMPT, TIERS

_BODY = "hash string, provider string, page_index int, subject string, parent string, amount bigint, claim string, prompt_tokens bigint, completion_tokens bigint, request_id string, request_state string"
_FIELDS = [c.split()[0] for c in _BODY.split(", ")]
_COUNTS = ("attempts", "reserved_only", "unsettled", "settled", "invalid")
OUTPUT = "doc_id bigint, attempt bigint, provider string, page_index int, subject string, state string, charged bigint, problem string, overdue boolean, version bigint, committed bigint, remaining bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", contiguous boolean"
_WHOLE = ("attempt", "page_index", "amount", "prompt_tokens", "completion_tokens")
_GROUP = {"reserved_only": "reserved_only", "submission_started_unknown": "unsettled", "settled_verified": "settled", "reserved_unknown": "settled", "invalid": "invalid"}


def usage_micros(prompt: int | None, completion: int | None) -> int | None:
    """Cost in millionths by the smallest tier that holds the prompt; None for invalid usage."""
    if prompt is None or completion is None or not (0 <= prompt <= MOST_PROMPT and 0 <= completion <= MOST_COMPLETION):
        return None
    _, a, b = next(t for t in TIERS if prompt <= t[0])
    return ceil(prompt * Decimal(a) + completion * Decimal(b))


def judged(facts: dict[str, dict]) -> tuple[str, int, str | None]:
    """State, charge and problem of an attempt from what is known of it, in the order of the batch operator's rules."""
    r, s, t = (facts.get(k) for k in ("reserved", "submission_started", "settled"))

    def problem() -> str | None:
        if any(f["conflict"] for f in facts.values()):
            return "conflict"
        if r is None:
            return "reservation_missing"
        reading = r["provider"] == "reading"
        if r["amount"] != (READING_PRICE if reading else VISION_RESERVATION):
            return "reservation_amount"
        if t and not s:
            return "settled_before_start"
        if s and (s["parent"] is None or s["parent"] != r["hash"] or s["provider"] is None or s["provider"] != r["provider"]):
            return "broken_link"
        if not t:
            return None
        if t["parent"] is None or t["parent"] != s["hash"]:
            return "broken_link"
        if t["claim"] not in SETTLED_STATES:
            return "settlement_state"
        if t["request_state"] not in REQUEST_STATES or (t["request_id"] is not None) != (t["request_state"] == "accepted"):
            return "request_identity"
        counted = t["prompt_tokens"] is not None or t["completion_tokens"] is not None
        if t["claim"] == "reserved_unknown":
            return "unknown_settlement" if counted or t["amount"] != r["amount"] else None
        expected = READING_PRICE if reading else usage_micros(t["prompt_tokens"], t["completion_tokens"])
        wrong = (reading and counted) or t["amount"] is None or t["amount"] != expected or t["amount"] > r["amount"]
        return "verified_settlement" if wrong else None

    found = problem()
    state = "invalid" if found else t["claim"] if t else "submission_started_unknown" if s else "reserved_only"
    charged = t["amount"] if state in SETTLED_STATES else (r["amount"] or 0) if r else 0
    return state, charged, found


_M64 = (1 << 64) - 1


def _chunk_of(attempt: int, level: int) -> int:
    """The chunk of an attempt among 2**level: a one and the first bits of a hash (splitmix64), so chunks of two levels never share a number."""
    x = (attempt + 0x9E3779B97F4A7C15) & _M64
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _M64
    return 1 << level | (x ^ x >> 31) >> 64 - level


class _Journal(StatefulProcessor):
    """State of a document: its sums, and its attempts in chunks of 64 on average at most, so that a batch reads and writes few entries.  Where they fill, all are split, one at a time."""

    CHUNK = 64

    def __init__(self, budget: int, patience_ms: int | None) -> None:
        self.budget, self.patience_ms = budget, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "chunk bigint", "attempts string")  # JSON: attempt -> fact -> columns, and when it is overdue
        self.due = handle.getMapState("due", "chunk bigint", "ms bigint")  # the first of each chunk
        self.sums = handle.getValueState("sums", "version bigint, committed bigint, last bigint, least bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", level bigint")

    def _chunk(self, number: int) -> dict[str, dict]:
        return json.loads(self.chunks.getValue((number,))[0]) if self.chunks.containsKey((number,)) else {}

    @staticmethod
    def _take(facts: dict[str, dict], row: dict) -> bool:
        """Whether the fact says something new.  Of two hashes the least is kept, so the order does not matter."""
        old, new = facts.get(row["fact"]), {c: row[c] for c in _FIELDS}
        if old is None:
            facts[row["fact"]] = new | {"conflict": False}
        elif old["hash"] == new["hash"]:
            return False
        else:
            facts[row["fact"]] = min(old, new, key=lambda f: f["hash"]) | {"conflict": True}
        return True

    def _table(self, key: tuple, found: list[tuple[int, dict]], sums: list[int], overdue: bool) -> pd.DataFrame:
        version, committed, last, least, *counts, _ = sums
        tail = (overdue, version, committed, self.budget - committed, *counts, least == 1 and last == counts[0])
        rows = []
        for attempt, facts in found:
            r = facts.get("reserved") or {}
            rows.append((key[0], attempt, r.get("provider"), r.get("page_index"), r.get("subject"), *judged(facts), *tail))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")], dtype=object)

    def _keep(self, number: int, attempts: dict[str, dict]) -> None:
        self.chunks.updateValue((number,), (json.dumps(attempts),))
        if self.patience_ms is None:
            return
        first = min((a["due"] for a in attempts.values() if a.get("due")), default=None)
        if first is not None:
            self.due.updateValue((number,), (first,))
            self.handle.registerTimer(first)
        elif self.due.containsKey((number,)):
            self.due.removeKey((number,))

    def _split(self, number: int, before: bool, attempts: dict[str, dict], level: int) -> None:
        """Puts the attempts of a chunk into those of a higher level."""
        parts: dict[int, dict] = defaultdict(dict)
        for attempt, held in attempts.items():
            parts[_chunk_of(int(attempt), level)][attempt] = held
        for part, held in parts.items():
            self._keep(part, held)
        if before:
            self.chunks.removeKey((number,))
            if self.patience_ms is not None and self.due.containsKey((number,)):
                self.due.removeKey((number,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        given: dict[int, list[dict]] = defaultdict(list)
        for part in rows:
            columns = {c: [None if v is None or v != v else int(v) if c in _WHOLE else v for v in part[c].tolist()] for c in ("attempt", "fact", *_FIELDS)}
            for values in zip(*columns.values(), strict=True):
                row = dict(zip(columns, values, strict=True))
                given[row["attempt"]].append(row)
        known_doc = self.sums.exists()
        sums = list(self.sums.get()) if known_doc else [0, 0, 0, 0, *(0 for _ in _COUNTS), 0]
        level = sums[-1]
        while sums[4] + len(given) > self.CHUNK << sums[-1]:
            sums[-1] += 1
        if not known_doc:
            level = sums[-1]
        grown = sums[-1] > level
        by_chunk: dict[int, list[int]] = defaultdict(list)
        for attempt in given:
            by_chunk[_chunk_of(attempt, level)].append(attempt)
        changed: dict[int, dict] = {}
        for number in range(1 << level, 2 << level) if grown else by_chunk:
            attempts = self._chunk(number) if known_doc else {}
            before, touched = bool(attempts), False
            for attempt in by_chunk.get(number, ()):
                known = str(attempt) in attempts
                held = attempts.setdefault(str(attempt), {"facts": {}})
                was = judged(held["facts"]) if known else None
                if not sum([self._take(held["facts"], r) for r in given[attempt]]):
                    continue
                touched = True
                state, charged, _ = judged(held["facts"])
                if was is not None:
                    sums[4 + _COUNTS.index(_GROUP[was[0]])] -= 1
                    sums[1] -= was[1]
                else:
                    sums[4] += 1
                    sums[2], sums[3] = max(sums[2], attempt), attempt if sums[4] == 1 else min(sums[3], attempt)
                sums[4 + _COUNTS.index(_GROUP[state])] += 1
                sums[1] += charged
                waits = self.patience_ms is not None and state == "submission_started_unknown"
                held["due"] = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms if waits else None
                changed[attempt] = held["facts"]
            if grown:
                self._split(number, before, attempts, sums[-1])
            elif touched:
                self._keep(number, attempts)
        if changed:
            sums[0] += 1
        if changed or grown:
            self.sums.update(tuple(sums))
        if changed:
            yield self._table(key, list(changed.items()), sums, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        late: list[tuple[int, dict]] = []
        for number in [n for (n,), (ms,) in self.due.iterator() if ms <= now]:
            attempts = self._chunk(number)
            for attempt, held in attempts.items():
                if held.get("due") and held["due"] <= now:
                    held["due"] = None
                    late.append((int(attempt), held["facts"]))
            self._keep(number, attempts)
        if late:
            sums = list(self.sums.get())
            sums[0] += 1
            self.sums.update(tuple(sums))
            yield self._table(key, late, sums, True)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which this kind of state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def running_entries(facts: DataFrame, budget: int, patience_ms: int | None = None) -> DataFrame:
    """A stream of facts (columns of ``FACT_SCHEMA``) -> a stream of changes: each attempt that changed, with its document's totals then.  Facts without a hash are ignored.

    Start it in update mode inside ``keyed_state``.  With ``patience_ms`` a timer reports calls that were started and not settled for so long (``overdue``); such a query runs
    a batch at every trigger, data or not, so give it an interval and stop it yourself.
    """
    good = facts.where("hash is not null and attempt is not null and fact in ('reserved', 'submission_started', 'settled')")
    columns = ["doc_id", "attempt", "fact", *_FIELDS]
    return good.select(*columns).groupBy("doc_id").transformWithStateInPandas(_Journal(budget, patience_ms), OUTPUT, "update", "None" if patience_ms is None else "ProcessingTime")


def latest_entries(changes: DataFrame) -> DataFrame:
    """The last word on each attempt, as the batch operator's entries, and whether a timer ever ran out."""
    row = F.struct("provider", "page_index", "subject", "state", "charged", "problem")
    return changes.groupBy("doc_id", "attempt").agg(F.max_by(row, "version").alias("r"), F.bool_or("overdue").alias("was_overdue")).select("doc_id", "attempt", "r.*", "was_overdue")


def latest_totals(changes: DataFrame) -> DataFrame:
    """The last totals of each document, as the batch operator's."""
    row = F.struct("committed", "remaining", *_COUNTS, "contiguous")
    return changes.groupBy("doc_id").agg(F.max_by(row, "version").alias("r")).select("doc_id", "r.*")
