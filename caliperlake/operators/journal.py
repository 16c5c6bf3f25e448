"""The journal of paid calls: reserved, started and settled facts of each attempt, joined and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliperlake.operators.ledger import usage_cost

KEY = ("doc_id", "attempt")
# Kinds of facts, states of a settlement, what became of a request's identity, and amounts in millionths.
FACTS = ("reserved", "submission_started", "settled")
SETTLED_STATES, REQUEST_STATES = ("settled_verified", "reserved_unknown"), ("absent", "accepted", "rejected")
VISION_RESERVATION, READING_PRICE = 1_763_328, 150_000
MOST_ON_PAGE, MOST_ON_SUBJECT = 16, 2

FACT_SCHEMA = "doc_id bigint, attempt bigint, fact string, provider string, page_index int, subject string, hash string, parent string, amount bigint, claim string, prompt_tokens bigint, completion_tokens bigint, request_id string, request_state string"
_BODY = ("provider", "page_index", "subject", "parent", "amount", "claim", "prompt_tokens", "completion_tokens", "request_id", "request_state")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def entries(facts: DataFrame) -> DataFrame:
    """One row for each attempt: doc_id, attempt, provider, page_index, subject, state, charged and the first rule that its facts break.

    Facts that repeat a hash are replays; two hashes for one fact of an attempt are a conflict, and its whole reservation counts.  An attempt without a reservation is charged nothing.
    """
    each = facts.groupBy(*KEY, "fact").agg(F.count_distinct("hash").alias("kinds"), F.min_by(F.struct("hash", *_BODY), "hash").alias("body"))
    of = lambda fact, value: F.max(F.when(F.col("fact") == fact, value))
    df = each.groupBy(*KEY).agg(F.max("kinds").alias("kinds"), *(of(f, F.col("body")).alias(f) for f in FACTS))
    r, s, t = (F.col(f) for f in FACTS)
    cost = (usage_cost(t["prompt_tokens"].cast("int"), t["completion_tokens"].cast("int")) * 1_000_000).cast("bigint")
    reading = r["provider"] == "reading"
    expected = F.when(reading, F.lit(READING_PRICE)).otherwise(cost)
    counted = t["prompt_tokens"].isNotNull() | t["completion_tokens"].isNotNull()
    problem = (
        F.when(F.col("kinds") > 1, "conflict")
        .when(r.isNull(), "reservation_missing")
        .when(~_yes(r["amount"] == F.when(reading, READING_PRICE).otherwise(VISION_RESERVATION)), "reservation_amount")
        .when(t.isNotNull() & s.isNull(), "settled_before_start")
        .when(s.isNotNull() & ~_yes((s["parent"] == r["hash"]) & (s["provider"] == r["provider"])), "broken_link")
        .when(t.isNotNull() & ~_yes(t["parent"] == s["hash"]), "broken_link")
        .when(t.isNotNull() & ~_yes(t["claim"].isin(*SETTLED_STATES)), "settlement_state")
        .when(t.isNotNull() & (~_yes(t["request_state"].isin(*REQUEST_STATES)) | (t["request_id"].isNotNull() != _yes(t["request_state"] == "accepted"))), "request_identity")
        .when((t["claim"] == "reserved_unknown") & (counted | ~_yes(t["amount"] == r["amount"])), "unknown_settlement")
        .when((t["claim"] == "settled_verified") & ((reading & counted) | ~_yes((t["amount"] == expected) & (t["amount"] <= r["amount"]))), "verified_settlement")
    )
    state = F.when(problem.isNotNull(), "invalid").when(t.isNotNull(), t["claim"]).when(s.isNotNull(), "submission_started_unknown").otherwise("reserved_only")
    df = df.withColumn("problem", problem).withColumn("state", state)
    charged = F.when(F.col("state").isin(*SETTLED_STATES), t["amount"]).otherwise(F.coalesce(r["amount"], F.lit(0))).cast("bigint")
    return df.select(*KEY, r["provider"].alias("provider"), r["page_index"].alias("page_index"), r["subject"].alias("subject"), "state", charged.alias("charged"), "problem")


def totals(found: DataFrame, budget: int) -> DataFrame:
    """Of each document: money committed and left, attempts by state, attempts with a problem, and whether the attempts are 1 .. n."""
    is_ = lambda *s: F.count_if(F.col("state").isin(*s))
    return found.groupBy("doc_id").agg(
        F.sum("charged").alias("committed"), (F.lit(budget) - F.sum("charged")).cast("bigint").alias("remaining"), F.count("*").alias("attempts"), is_("reserved_only").alias("reserved_only"), is_("submission_started_unknown").alias("unsettled"),
        is_(*SETTLED_STATES).alias("settled"), is_("invalid").alias("invalid"), ((F.min("attempt") == 1) & (F.max("attempt") == F.count("*"))).alias("contiguous"),
    )


def over_limits(found: DataFrame) -> DataFrame:
    """Attempts beyond the calls that a page, or a subject of the vision provider, may have: doc_id, attempt, limit; in the order of attempts."""
    df = found.where("problem is null or problem <> 'reservation_missing'")
    page = F.row_number().over(Window.partitionBy("doc_id", "provider", "page_index").orderBy("attempt"))
    subject = F.row_number().over(Window.partitionBy("doc_id", "provider", "subject").orderBy("attempt"))
    df = df.withColumns({"_p": page, "_s": subject})
    limit = F.when(F.col("_p") > MOST_ON_PAGE, "page").when((F.col("provider") == "vision") & (F.col("_s") > MOST_ON_SUBJECT), "subject")
    return df.select(*KEY, limit.alias("limit")).where("limit is not null")
