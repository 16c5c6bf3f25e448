"""Sheet rows, manifests, metrics and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caliperlake.functions.annotations import DECIMAL, basic_size, coarse_type, type_label
from caliperlake.functions.text import tolerance_values


def sheet_rows(items: DataFrame) -> DataFrame:
    """Detail rows of an inspection sheet from parsed annotations."""
    base = F.coalesce("nominal_raw", "value_raw").cast(DECIMAL)
    df = items.withColumn("_t", tolerance_values(base, F.col("upper_tolerance"), F.col("lower_tolerance")))
    return df.select(
        "doc_id",
        "observation_id",
        (F.col("page_index") + 1).alias("page"),
        type_label(F.col("item_type"), coarse_type(F.col("raw_text"))).alias("type_label"),
        basic_size(df).alias("size"),
        F.col("_t.text").alias("tolerance"),
        F.col("_t.upper_limit").cast("string").alias("upper_limit"),
        F.col("_t.lower_limit").cast("string").alias("lower_limit"),
        F.col("_t.error").alias("error"),
    )


def manifest(rows: DataFrame) -> DataFrame:
    """One JSON document for each drawing: counts and the digest of its rows in order."""
    line = F.concat_ws("|", "observation_id", "type_label", "size", "tolerance")
    ordered = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    by_doc = rows.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(F.col("tolerance") != "").alias("toleranced"), F.count_distinct("page").alias("pages"), F.sha2(ordered, 256).alias("rows_sha256"))
    return by_doc.select("doc_id", F.to_json(F.struct("pages", "rows", "rows_sha256", "toleranced")).alias("manifest"))


def binary_metrics(df: DataFrame, truth: Column, predicted: Column, *grains: str) -> DataFrame:
    """Counts, recall and precision at each level of a rollup."""
    t, p = truth, predicted
    agg = df.rollup(*grains).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count("*").alias("n"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return agg.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))


def difference(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows added, removed and changed, and how many fields changed, for each document."""
    a = before.select(*keys, *(F.col(f).alias(f"a_{f}") for f in fields), F.lit(True).alias("_a"))
    b = after.select(*keys, *(F.col(f).alias(f"b_{f}") for f in fields), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    paired = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    changed = sum(((~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}"))).cast("int") for f in fields), F.lit(0))
    marked = both.withColumn("_fields", F.when(paired, changed).otherwise(0))
    return marked.groupBy("doc_id").agg(
        F.count_if(F.col("_a").isNull()).alias("added"), F.count_if(F.col("_b").isNull()).alias("removed"), F.count_if(F.col("_fields") > 0).alias("changed"), F.sum("_fields").cast("bigint").alias("fields")
    )


def reconciled(items: DataFrame, balloons: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer match of required items and active balloons, with a reason where one side is missing or doubled."""
    i = items.groupBy(*keys).agg(F.count("*").alias("items"))
    b = balloons.groupBy(*keys).agg(F.count("*").alias("balloons"))
    both = i.join(b, keys, "full_outer").fillna(0, ["items", "balloons"])
    reason = F.when(F.col("balloons") == 0, "missing_required_balloon").when(F.col("items") == 0, "item_balloon_disconnect").when(F.col("balloons") > 1, "duplicate_balloon")
    return both.withColumn("reason", reason)


MANY = 4096  # rows of one text that one task takes


def cross_view_duplicates(df: DataFrame, text: str, view: str, id_col: str, salts: int = 8) -> DataFrame:
    """Pairs of a document's rows with equal texts in different views, the lesser id first.

    The result has a row for each pair, so a text of n rows makes up to n * n / 2.  The rows of a text that more than ``MANY`` rows of a document share are salted on one side, ``salts`` ways or more as it grows,
    and copied on the other, so no task gets all of them; all other rows are dealt once.  There is one such text for ``MANY`` rows at most, so they are broadcast.
    """
    rows = df.select("doc_id", F.col(text).alias("t"), F.col(view).alias("v"), F.col(id_col).alias("id")).where(F.col("doc_id").isNotNull() & F.col(text).isNotNull())
    often = rows.groupBy("doc_id", "t").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("doc_id", "t", F.greatest(F.lit(salts), F.ceil(F.col("n") / (MANY // 4))).cast("int").alias("parts"))
    known = rows.join(F.broadcast(often), ["doc_id", "t"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = known.select("doc_id", "t", F.col("v").alias("lv"), F.col("id").alias("left_id"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("salt"))
    right = known.select("doc_id", "t", F.col("v").alias("rv"), F.col("id").alias("right_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    pairs = left.join(right, ["doc_id", "t", "salt"]).where((F.col("left_id") < F.col("right_id")) & (F.col("lv") != F.col("rv")))
    return pairs.select("doc_id", "left_id", "right_id")


def recognition_metrics(pairs: DataFrame, *grains: str) -> DataFrame:
    """Recall, wrong selection, exact match and character error rate of recognised texts at each level of a rollup.

    pairs: truth and found texts of one item; null truth: nothing should be there, null found: it was missed.
    """
    t, f = F.col("truth"), F.col("found")
    edits = F.when(t.isNotNull(), F.when(f.isNull(), F.length(t)).otherwise(F.levenshtein(t, f)))
    g = pairs.rollup(*grains).agg(
        F.count(t).alias("expected"), F.count_if(t.isNotNull() & f.isNotNull()).alias("found"), F.count_if(t.isNull() & f.isNotNull()).alias("extra"), F.count_if(t == f).alias("exact"), F.sum(F.length(t)).cast("bigint").alias("chars"), F.sum(edits).cast("bigint").alias("edits")
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return g.withColumns({"recall": ratio("found", "expected"), "exact_match": ratio("exact", "expected"), "character_error_rate": ratio("edits", "chars"), "false_selection": F.when(F.col("found") + F.col("extra") > 0, F.round(F.col("extra") / (F.col("found") + F.col("extra")), 6))})


def full_manifest(counts: DataFrame, artifacts: DataFrame, versions: dict[str, str]) -> DataFrame:
    """One JSON document for each export, its keys sorted: counts, versions and the digests of its artifacts by kind.

    counts: doc_id and counts; artifacts: doc_id, kind, filename, sha256, size_bytes.
    """
    listed = artifacts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("kind", "filename", "sha256", "size_bytes"))).alias("artifacts"))
    names = sorted([*(c for c in counts.columns if c != "doc_id"), *versions, "artifacts"])
    df = counts.join(listed, "doc_id").withColumns({k: F.lit(v) for k, v in versions.items()})
    return df.select("doc_id", F.to_json(F.struct(*names)).alias("manifest"))
