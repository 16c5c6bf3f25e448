"""Usage costs, budgets and call accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(20,6)"
# Tiers (most prompt tokens, price of a million prompt tokens, of a million completion tokens) and limits.
TIERS = ((32768, 1, 10), (131072, "1.5", 15), (260096, 3, 30))
MOST_PROMPT, MOST_COMPLETION = 260096, 32768


def usage_cost(prompt: Column, completion: Column, total: Column | None = None) -> Column:
    """Cost by the smallest tier that holds the prompt, rounded up to a millionth; null for invalid usage."""
    wrong = prompt.isNull() | completion.isNull() | (prompt < 0) | (completion < 0) | (prompt > MOST_PROMPT) | (completion > MOST_COMPLETION)
    if total is not None:
        wrong = wrong | (total.isNotNull() & (total != prompt + completion))
    priced = F.lit(None).cast("decimal(38,6)")
    for most, per_prompt, per_completion in reversed(TIERS):
        amount = prompt.cast("decimal(18,0)") * F.lit(per_prompt).cast("decimal(6,2)") + completion.cast("decimal(18,0)") * F.lit(per_completion).cast("decimal(6,2)")
        # Prices are of a million tokens, so the amount in millionths is the product itself.
        priced = F.when(prompt <= most, F.ceil(amount).cast("decimal(38,6)") * F.lit("0.000001").cast("decimal(7,6)")).otherwise(priced)
    return F.when(~wrong, priced).cast(MONEY)


def snapshot(facts: DataFrame, budget: str) -> DataFrame:
    """Committed and remaining money and the attempts by state, for each document; facts have cost (null: unknown) and reservation."""
    charge = F.coalesce("cost", "reservation")
    return facts.groupBy("doc_id").agg(
        F.sum(charge).cast(MONEY).alias("committed"),
        (F.lit(budget).cast(MONEY) - F.sum(charge)).cast(MONEY).alias("remaining"),
        F.count_if(F.col("cost").isNotNull()).alias("settled"),
        F.count_if(F.col("cost").isNull()).alias("unknown"),
    )


def wall_time(calls: DataFrame, page_limit_s: float, doc_limit_s: float) -> DataFrame:
    """Milliseconds by page and document, and whether they pass the limits."""
    by_page = calls.groupBy("doc_id", "page_index").agg(F.sum("duration_ms").alias("page_ms"))
    by_doc = by_page.groupBy("doc_id").agg(F.sum("page_ms").alias("doc_ms"), F.count_if(F.col("page_ms") > page_limit_s * 1000).alias("pages_over"))
    return by_doc.withColumn("doc_over", F.col("doc_ms") > doc_limit_s * 1000)


def mode_comparison(calls: DataFrame) -> DataFrame:
    """Calls and latency percentiles for each mode and page, each mode, each page, and all.

    Durations are counted first, so a percentile holds different values with their counts and not every call.
    """
    counted = calls.groupBy("mode", "page_index", "duration_ms").agg(F.count("*").alias("_n"))
    share = lambda p: F.round(F.percentile("duration_ms", p, F.col("_n")), 3)
    return counted.cube("mode", "page_index").agg(F.sum("_n").alias("calls"), share(0.5).alias("p50_ms"), share(0.95).alias("p95_ms"))


SKETCH_K, RANK_ERROR = 800, 0.02  # the sketch's own error at this size is about 0.4 % of the rows; the bound leaves room for merges


def latency_sketches(calls: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """Calls and KLL sketches of the durations for each mode and page, each mode, each page, and all: mode, page_index, calls, sketch, p50_ms, p95_ms.

    Durations meet the sketches of mode and page only; the wider groups merge those, so no group ever holds all durations, and tables of later days can be merged the same way.
    Percentiles are values that occur, with a rank within ``RANK_ERROR`` of the stated one.
    """
    each = calls.where("duration_ms is not null").groupBy("mode", "page_index").agg(F.count("*").alias("calls"), F.kll_sketch_agg_bigint(F.col("duration_ms").cast("bigint"), k).alias("sketch"))
    return merged_sketches(each, k)


def merged_sketches(sketches: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """Sketches (mode, page_index, calls, sketch) of any number of tables -> the cube."""
    df = sketches.cube("mode", "page_index").agg(F.sum("calls").alias("calls"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))
    at = lambda p: F.kll_sketch_get_quantile_bigint("sketch", F.lit(p))
    return df.withColumns({"p50_ms": at(0.5), "p95_ms": at(0.95)})


def sketch_errors(calls: DataFrame, found: DataFrame) -> DataFrame:
    """mode, page_index, calls, and whether each percentile's rank among all durations is within the stated error."""
    counted = calls.where("duration_ms is not null").groupBy("mode", "page_index", "duration_ms").agg(F.count("*").alias("n"))
    own, none = (F.col("mode"), F.col("page_index")), (F.lit(None).cast(calls.schema["mode"].dataType), F.lit(None).cast(calls.schema["page_index"].dataType))
    groups = [F.struct(m.alias("mode"), p.alias("page_index")) for m in (own[0], none[0]) for p in (own[1], none[1])]
    spread = counted.select(F.explode(F.array(*groups)).alias("g"), "duration_ms", "n").select(F.col("g.mode").alias("_m"), F.col("g.page_index").alias("_p"), "duration_ms", "n")
    both = found.join(spread, F.col("mode").eqNullSafe(F.col("_m")) & F.col("page_index").eqNullSafe(F.col("_p")))
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    parts = [share(F.col("duration_ms") < F.col(f"{p}_ms")).alias(f"{p}_low") for p in ("p50", "p95")] + [share(F.col("duration_ms") <= F.col(f"{p}_ms")).alias(f"{p}_high") for p in ("p50", "p95")]
    ranks = both.groupBy("mode", "page_index", "calls").agg(*parts)
    within = lambda p, q: ((F.col(f"{p}_low") <= q + RANK_ERROR) & (F.col(f"{p}_high") >= q - RANK_ERROR)).alias(f"{p}_within")
    return ranks.select("mode", "page_index", "calls", within("p50", 0.5), within("p95", 0.95))
