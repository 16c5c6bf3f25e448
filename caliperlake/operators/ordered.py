"""Ordered operators: numbering, islands, caps, budgets, chains, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliperlake.functions.annotations import modifier, parsed
from caliperlake.scratch import written

READING = ("page_index", "y0", "x0", "observation_id")


def numbered(df: DataFrame, start: int = 1, counting: str | None = None) -> DataFrame:
    """Reading-order numbers of each document's rows; with ``counting``, of the rows that have a value in this column, and no others.

    Such rows are counted in the window and chosen behind it: a filter ahead of it would be pushed below the columns that it depends on, and work them all out twice.
    """
    w = Window.partitionBy("doc_id").orderBy(*READING)
    if counting is None:
        return df.withColumn("number", F.row_number().over(w) + (start - 1))
    so_far = F.count(counting).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return df.withColumn("number", so_far + (start - 1)).where(F.col(counting).isNotNull())


def composites(lines: DataFrame) -> DataFrame:
    """Islands of a diameter or thread and the adjacent modifiers that follow it.

    doc_id, head_id, kind, members, modifiers (texts in order) and orphan (modifiers without a head that can take them).
    """
    w = Window.partitionBy("doc_id", "page_index").orderBy("y0", "x0", "observation_id")
    df = parsed(lines.withColumn("normalized_text", F.col("raw_text"))).withColumn("_mod", modifier(F.col("raw_text")))
    scale = F.greatest(F.col("y1") - F.col("y0"), F.lag(F.col("y1") - F.col("y0")).over(w), F.lit(1.0))
    gap = F.col("y0") - F.lag("y1").over(w)
    near = gap.between(-0.5 * scale, 1.5 * scale) & (F.abs(F.col("x0") - F.lag("x0").over(w)) <= 2 * scale)
    takes = F.lag(F.col("_mod").isNotNull() | F.coalesce(F.col("item_type").isin("diameter_dimension", "thread"), F.lit(False))).over(w)
    follows = F.coalesce(F.col("_mod").isNotNull() & near & takes, F.lit(False))
    df = df.withColumn("_new", (~follows).cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_place", F.row_number().over(Window.partitionBy("doc_id", "page_index", "_island").orderBy("y0", "x0", "observation_id")))
    grouped = df.groupBy("doc_id", "page_index", "_island").agg(
        F.max(F.when(F.col("_place") == 1, F.col("observation_id"))).alias("head_id"),
        F.max(F.when(F.col("_place") == 1, F.col("item_type"))).alias("head_type"),
        F.count("*").alias("members"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_mod").isNotNull(), F.struct("_place", "raw_text")))), lambda m: m["raw_text"]), " ").alias("modifiers"),
        F.bool_or((F.col("_place") == 1) & F.col("_mod").isNotNull()).alias("orphan"),
    )
    kind = F.when(F.col("orphan"), "orphan").when(F.col("members") > 1, "composite").otherwise(F.col("head_type"))
    return grouped.select("doc_id", "head_id", kind.alias("kind"), "members", "modifiers", "orphan")


def capped(df: DataFrame, keys: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows of each group in the order given."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= most).drop("_rank")


def admitted(requests: DataFrame, capacity: DataFrame, page_most: int = 4, doc_most: int = 8) -> DataFrame:
    """First-come admission with one projected time for every request: each page's cap, then the document's.

    capacity has a row for each document.  Result: requests with admitted and reason.
    """
    df = requests.join(capacity, "doc_id")
    df = df.withColumn("_page_rank", F.row_number().over(Window.partitionBy("doc_id", "page_index").orderBy("call_id")))
    df = df.withColumn("_in_page", F.col("_page_rank") <= F.least(F.lit(page_most), F.col("capacity")))
    df = df.withColumn("_doc_rank", F.sum(F.col("_in_page").cast("int")).over(Window.partitionBy("doc_id").orderBy("page_index", "call_id").rowsBetween(Window.unboundedPreceding, 0)))
    reason = F.when(F.col("_page_rank") > F.col("capacity"), "call_capacity").when(F.col("_page_rank") > page_most, "page_limit").when(F.col("_doc_rank") > doc_most, "document_limit")
    return df.withColumn("reason", reason).withColumn("admitted", F.col("reason").isNull()).drop("_page_rank", "_in_page", "_doc_rank")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group, by a map-side aggregate."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*order, *(c for c in rest if c not in order))
    best = df.groupBy(*keys).agg(F.max(packed).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def running_budget(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """committed (running cost) and over (the first row at which it passes the budget)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("committed", F.sum(cost).over(w))
    return df.withColumn("over", (F.col("committed") > budget) & (F.col("committed") - F.col(cost) <= budget))


def gaps(df: DataFrame, key: str, number: str) -> DataFrame:
    """Whether each group's numbers are exactly 1 .. n."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(number)))
    return ranked.groupBy(key).agg(F.count("*").alias("n"), F.bool_and(F.col(number) == F.col("_rank")).alias("contiguous"))


def broken_chain(df: DataFrame, key: str, order: list[str], before: str, after: str) -> DataFrame:
    """Rows whose ``before`` is not the ``after`` of the row before them."""
    previous = F.lag(after).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("previous_after", previous).where(F.col("previous_after").isNotNull() & (F.col(before) != F.col("previous_after")))


def ranked(df: DataFrame, by: str, id_col: str) -> DataFrame:
    """Places over a whole table, the greatest ``by`` first (nulls last), then the greatest id.

    Ranges of (by, id) are dealt to partitions by Spark's own sampling and written with the partition's number; the partitions' counts, one number each, are added up on the
    driver, and rows are ranked within their partition.  A value that many rows share is cut by the id.
    """
    spark = df.sparkSession
    order = [F.col(by).desc_nulls_last(), F.col(id_col).desc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranks")
    before, starts = 0, []
    for part, n in sorted(tuple(r) for r in rows.groupBy("_part").count().collect()):  # at most ``parts`` rows
        starts.append((part, before))
        before += n
    offsets = spark.createDataFrame(starts, "_part int, _before bigint")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return rows.withColumn("_k", within).join(F.broadcast(offsets), "_part").withColumn("position", (F.col("_before") + F.col("_k")).cast("int")).drop("_part", "_k", "_before")
