"""Inspection tables derived from the driver's tables with plain column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows in as many partitions as the session shuffles to, by key.

    A table of few megabytes is read in one task, and whatever is exploded from a row would be made there too.  The number is given, so adaptive execution leaves these small partitions apart.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_index, observation_id, raw_text and a box of every text line of all drawings."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    key, size, qty = F.col("l_orderkey"), F.col("p_size").cast("string"), F.col("l_quantity").cast("int").cast("string")
    number = F.col("l_linenumber")
    form = (
        F.when(key % 7 == 0, F.concat(F.lit("M"), size))
        .when(key % 7 == 1, F.concat(F.lit("Φ"), size, F.lit("深"), qty))
        .when(key % 7 == 2, F.concat(size, F.lit("±0.0"), number.cast("string")))
        .when(key % 7 == 3, F.concat(F.lit("R"), size))
        .when(key % 7 == 4, F.concat(size, F.lit("°")))
        .when(key % 7 == 5, F.concat(qty, F.lit("×M"), size))
        .otherwise(F.concat(F.lit("Ra "), size))
    )
    x, y = (F.col("l_partkey") % 50).cast("double") * 10, (key % 40).cast("double") * 15
    ident = F.concat_ws("-", key.cast("string"), number.cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("doc_id"), (number - 1).cast("int").alias("page_index"), ident.alias("observation_id"), form.alias("raw_text"), x.alias("x0"), y.alias("y0"), (x + 20 + number * 5).alias("x1"), (y + 10).alias("y1")
    )


OBSERVATIONS_SQL = """obs AS (
  SELECT l_suppkey AS doc_id, CAST(l_linenumber - 1 AS INT) AS page_index,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS observation_id,
    CASE l_orderkey % 7 WHEN 0 THEN 'M' || p_size WHEN 1 THEN 'Φ' || p_size || '深' || CAST(l_quantity AS INT)
      WHEN 2 THEN p_size || '±0.0' || l_linenumber WHEN 3 THEN 'R' || p_size WHEN 4 THEN p_size || '°'
      WHEN 5 THEN CAST(l_quantity AS INT) || '×M' || p_size ELSE 'Ra ' || p_size END AS raw_text,
    CAST(l_partkey % 50 AS DOUBLE) * 10 AS x0, CAST(l_orderkey % 40 AS DOUBLE) * 15 AS y0,
    CAST(l_partkey % 50 AS DOUBLE) * 10 + 20 + l_linenumber * 5 AS x1, CAST(l_orderkey % 40 AS DOUBLE) * 15 + 10 AS y1
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def title_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short texts as title blocks have them, with normalised centres, from orders."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    text = F.element_at(F.array(*(F.lit(t) for t in TITLE_TEXTS)), (key % len(TITLE_TEXTS) + 1).cast("int"))
    return o.select(F.col("o_custkey").alias("doc_id"), (key % 4).cast("int").alias("page_index"), key.alias("observation_id"), text.alias("raw_text"), ((key * 7) % 101 / F.lit(100.0)).alias("cx"), ((key * 13) % 101 / F.lit(100.0)).alias("cy"))


# Sample texts.
TITLE_TEXTS = ("设计", " 1:10", "A-A", "II", "12", "25±0.1", "B - B", "审核人", "CONFIDENTIAL", "2 : 15")
TITLE_SQL = f"""texts AS (SELECT o_custkey AS doc_id, CAST(o_orderkey % 4 AS INT) AS page_index, o_orderkey AS observation_id,
    [{", ".join(f"'{t}'" for t in TITLE_TEXTS)}][CAST(o_orderkey % {len(TITLE_TEXTS)} + 1 AS INT)] AS raw_text,
    CAST((o_orderkey * 7) % 101 AS DOUBLE) / 100 AS cx, CAST((o_orderkey * 13) % 101 AS DOUBLE) / 100 AS cy FROM orders)"""


def modifier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary dimensions and the modifiers that may follow them, in columns of ten rows, from lineitem."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_partkey").alias("p"), F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    n, q = F.col("l_orderkey"), F.col("q").cast("string")
    text = F.when(n % 3 == 0, F.concat(F.lit("Φ"), q)).when((n % 3 == 1) & (F.col("q") % 2 == 0), F.concat(F.lit("深"), q)).when(n % 3 == 1, F.lit("通")).otherwise(F.concat(F.lit("M"), q))
    return li.select(F.col("l_suppkey").alias("doc_id"), (n % 2).cast("int").alias("page_index"), n.alias("observation_id"), text.alias("raw_text"), (F.col("p") % 2 * 12).cast("double").alias("x0"), (n % 300 * 8).cast("double").alias("y0")).withColumns({"x1": F.col("x0") + 30, "y1": F.col("y0") + 8})


MODIFIER_SQL = """lines AS (SELECT l_suppkey AS doc_id, CAST(l_orderkey % 2 AS INT) AS page_index, l_orderkey AS observation_id,
    CASE WHEN l_orderkey % 3 = 0 THEN 'Φ' || q WHEN l_orderkey % 3 = 1 AND q % 2 = 0 THEN '深' || q WHEN l_orderkey % 3 = 1 THEN '通' ELSE 'M' || q END AS raw_text,
    CAST(p % 2 * 12 AS DOUBLE) AS x0, CAST(l_orderkey % 300 * 8 AS DOUBLE) AS y0, CAST(p % 2 * 12 AS DOUBLE) + 30 AS x1, CAST(l_orderkey % 300 * 8 AS DOUBLE) + 8 AS y1
  FROM (SELECT l_suppkey, l_orderkey, CAST(sum(l_partkey) AS BIGINT) AS p, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY ALL))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote calls with token usage, from events."""
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("call_id"), "ts", F.col("event_type").alias("mode"), (cents % 1000 * 300).alias("prompt_tokens"), (cents % 331 * 100).alias("completion_tokens"), (cents % 7000 + 1).alias("duration_ms"), (F.col("event_id") % 3).cast("int").alias("page_index"))


CALLS_SQL = """calls AS (SELECT user_id AS doc_id, event_id AS call_id, ts, event_type AS mode,
    CAST(round(value * 100) AS BIGINT) % 1000 * 300 AS prompt_tokens, CAST(round(value * 100) AS BIGINT) % 331 * 100 AS completion_tokens,
    CAST(round(value * 100) AS BIGINT) % 7000 + 1 AS duration_ms, CAST(event_id % 3 AS INT) AS page_index FROM events)"""


def row_ident() -> "F.Column":
    """Identity of a lineitem row."""
    return F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))


IDENT_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT))"


def pick(values: tuple, index: "F.Column") -> "F.Column":
    """The value at a place from 0 of a fixed tuple."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def pick_sql(values: tuple, index: str) -> str:
    return f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][CAST({index} + 1 AS INT)]"


def path_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path items of small framed tables, one for each line of an order: doc_id, page_index, op, ax, ay, bx, by."""
    li = table(spark, sf_dir, "lineitem")
    x, y, n = (F.col("l_partkey") % 50 * 10).cast("double"), (F.col("l_orderkey") % 40 * 15).cast("double"), 2 + F.col("l_linenumber") % 2
    off = F.when(F.col("l_partkey") % 9 == 0, 0.125).otherwise(0.0)
    item = lambda op, ax, ay, bx, by: F.struct(F.lit(op).alias("op"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    verticals = [F.when(n >= k, item("l", x + 20 * k, y, x + 20 * k, y + 10)) for k in range(4)]
    parts = [item("l", x, y, x + 20, y), item("l", x + 21, y + off, x + n * 20, y + off), item("l", x + n * 20, y + 10, x, y + 10), F.when(F.col("l_partkey") % 3 == 0, item("re", x + 200, y, x + 230, y + 10)), item("c", x, y, x + 5, y + 5), item("l", x, y, x + 7, y + 9)]
    each = li.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_linenumber") - 1).cast("int").alias("page_index"), F.explode(F.array_compact(F.array(*parts, *verticals))).alias("i"))
    return each.select("doc_id", "page_index", "i.*")


PATHS_SQL = """paths AS (SELECT doc_id, page_index, i.op AS op, i.ax AS ax, i.ay AS ay, i.bx AS bx, i."by" AS "by" FROM (SELECT doc_id, page_index, unnest(list_filter([
    {'op': 'l', 'ax': x, 'ay': y, 'bx': x + 20, 'by': y}, {'op': 'l', 'ax': x + 21, 'ay': y + o, 'bx': x + n * 20, 'by': y + o}, {'op': 'l', 'ax': x + n * 20, 'ay': y + 10, 'bx': x, 'by': y + 10},
    CASE WHEN l_partkey % 3 = 0 THEN {'op': 're', 'ax': x + 200, 'ay': y, 'bx': x + 230, 'by': y + 10} END, {'op': 'c', 'ax': x, 'ay': y, 'bx': x + 5, 'by': y + 5}, {'op': 'l', 'ax': x, 'ay': y, 'bx': x + 7, 'by': y + 9},
    {'op': 'l', 'ax': x, 'ay': y, 'bx': x, 'by': y + 10}, {'op': 'l', 'ax': x + 20, 'ay': y, 'bx': x + 20, 'by': y + 10}, {'op': 'l', 'ax': x + 40, 'ay': y, 'bx': x + 40, 'by': y + 10},
    CASE WHEN n >= 3 THEN {'op': 'l', 'ax': x + 60, 'ay': y, 'bx': x + 60, 'by': y + 10} END], lambda i: i IS NOT NULL)) AS i
  FROM (SELECT l_suppkey AS doc_id, CAST(l_linenumber - 1 AS INT) AS page_index, l_partkey, CAST(l_partkey % 50 * 10 AS DOUBLE) AS x, CAST(l_orderkey % 40 * 15 AS DOUBLE) AS y, 2 + l_linenumber % 2 AS n, CASE WHEN l_partkey % 9 = 0 THEN 0.125::DOUBLE ELSE 0.0::DOUBLE END AS o FROM lineitem)))"""


Specs = list[tuple[str, dict[str, str]]]


def derived(source: DataFrame, specs: Specs) -> DataFrame:
    """Rows by fixed rules: each source row gives one row for each (condition, columns) whose condition holds.  Expressions are plain SQL.

    One rule is a filter and a projection, so columns that are not asked for are never made.
    """
    if len(specs) == 1:
        [(cond, cols)] = specs
        return source.where(cond).select(*(F.expr(e).alias(c) for c, e in cols.items()))
    parts = [F.when(F.expr(cond), F.struct(*(F.expr(e).alias(c) for c, e in cols.items()))) for cond, cols in specs]
    return source.select(F.explode(F.array_compact(F.array(*parts))).alias("r")).select("r.*")


def derived_sql(name: str, source: str, specs: Specs) -> str:
    """The same rows as a named subquery."""
    parts = (f"SELECT {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {source} WHERE {cond}" for cond, cols in specs)
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def fixed_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of fixed rules."""
    return spark.createDataFrame(rows, schema)


def fixed_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """The same table as a named subquery."""
    value = lambda v: "NULL" if v is None else f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)})"
