"""Workbench and export rules: progress, blockers, agreement, lineage, settlement, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def progress(items: DataFrame, reviewed: Column, active: Column, exception: Column) -> DataFrame:
    """Reviewed, active, ready and exceptional items of each document, and whether all active ones are reviewed."""
    return items.groupBy("doc_id").agg(
        F.count_if(active).alias("active"), F.count_if(active & reviewed).alias("reviewed"), F.count_if(active & reviewed & ~exception).alias("ready"), F.count_if(active & exception).alias("exceptions"), F.coalesce(F.bool_and(F.when(active, reviewed)), F.lit(True)).alias("resolved")
    )


def merged_fields(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A field's value where all rows of a key agree on it, else null, and whether any field is in conflict."""
    agg = [F.count_distinct(f).alias(f"_n_{f}") for f in fields] + [F.min(f).alias(f) for f in fields]
    out = rows.groupBy(*keys).agg(*agg)
    conflict = sum(((F.col(f"_n_{f}") > 1).cast("int") for f in fields), F.lit(0)) > 0
    return out.select(*keys, *(F.when(F.col(f"_n_{f}") <= 1, F.col(f)).alias(f) for f in fields), conflict.alias("conflict"))


def same_sources(visuals: DataFrame, candidates: DataFrame) -> DataFrame:
    """Visuals and candidates whose sets of sources are equal, whatever their order; equality of sorted arrays is a hash join."""
    key = lambda c: F.array_sort(F.array_distinct(c))
    a = visuals.select("visual_id", key("source_ids").alias("k"))
    b = candidates.select("candidate_id", key("source_ids").alias("k"))
    return a.join(b, "k").select("visual_id", "candidate_id")


def ledger_facts(reserved: DataFrame, started: DataFrame, settled: DataFrame) -> DataFrame:
    """Reserved attempts with their start and settlement, and what is wrong with the chain."""
    joined = reserved.join(started.select("attempt", F.col("parent").alias("start_parent")), "attempt", "left").join(settled.select("attempt", F.col("parent").alias("settle_parent"), "cost"), "attempt", "left")
    reason = F.when(F.col("settle_parent").isNotNull() & F.col("start_parent").isNull(), "settled_before_start").when(F.col("start_parent") != F.col("hash"), "broken_link").when(F.col("settle_parent") != F.col("hash"), "broken_link")
    state = F.when(F.col("cost").isNotNull(), "settled").when(F.col("start_parent").isNotNull(), "started").otherwise("reserved")
    return joined.select("attempt", state.alias("state"), "cost", reason.alias("reason"))


def single_charges(settled: DataFrame, request: str, cost: str) -> DataFrame:
    """Charges of requests that were settled exactly once."""
    return settled.groupBy(request).agg(F.count("*").alias("n"), F.sum(cost).alias("charge")).where("n = 1").drop("n")


def export_counts(rows: DataFrame, balloons: DataFrame) -> DataFrame:
    """Whether each document's sheet rows and balloons have the same numbers, as multisets."""
    side = lambda df, a, b: df.select("doc_id", "number", F.lit(a).alias("a"), F.lit(b).alias("b"))
    each = side(rows, 1, 0).unionByName(side(balloons, 0, 1)).groupBy("doc_id", "number").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    known = F.col("number").isNotNull()
    count = lambda c: F.sum(F.when(known, F.col(c)).otherwise(0)).cast("int")
    equal = F.bool_and(~known | (F.col("a") == F.col("b"))) & ((F.sum("a") > 0) == (F.sum("b") > 0))
    return each.groupBy("doc_id").agg(count("a").alias("n_rows"), count("b").alias("n_balloons"), equal.alias("equal"))


# Order of artifact kinds.
KINDS = ("pdf", "xlsx", "manifest")


def artifact_order(artifacts: DataFrame, kind: str, id_col: str) -> DataFrame:
    """Artifacts with their place by kind and id in each document."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col(kind))
    rank = F.when(rank == 0, len(KINDS) + 1).otherwise(rank)
    return artifacts.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, id_col)))


# Rule that fills the sheet, labels and methods by type of item.
SHEET_RULE = "sip-auto-map/1"
SHEET_LABELS = {"linear_dimension": "线性尺寸", "diameter_dimension": "直径尺寸", "thread": "螺纹", "radius": "半径", "angle": "角度", "general_requirement": "通用要求", "roughness": "粗糙度"}
SHEET_METHODS = {"linear_dimension": "游标卡尺", "diameter_dimension": "游标卡尺", "thread": "螺纹规", "radius": "半径规", "angle": "万能角度尺", "general_requirement": "目视", "roughness": "粗糙度仪"}


def sheet_fields(df: DataFrame, role: str) -> DataFrame:
    """Sheet fields of items, and what is still missing.

    A value that an operator set stays; one that this rule made before (its field is in ``by_rule``) is made anew.  df: item_id, item_type, text, quantity, critical, page_index, by_rule and the fields.
    """
    ours = lambda f: F.array_contains("by_rule", f)
    own = lambda f: F.when(~ours(f), F.nullif(F.trim(f), F.lit("")))
    label, method = F.lit("检验项目"), F.lit(None).cast("string")
    for kind, said in SHEET_LABELS.items():
        label = F.when(F.col("item_type") == kind, said).otherwise(label)
    for kind, said in SHEET_METHODS.items():
        method = F.when(F.col("item_type") == kind, said).otherwise(method)
    text = F.nullif(F.trim("text"), F.lit(""))
    made = F.concat(label, F.when(text.isNotNull(), F.concat(F.lit("："), text)).otherwise(""), F.when(F.col("quantity") >= 1, F.concat(F.lit("（"), F.col("quantity").cast("string"), F.lit("处）"))).otherwise(""))
    kept_method = own("inspection_method")
    page = F.coalesce(F.when(~ours("source_page") & (F.col("source_page") >= 1), F.col("source_page")), F.when(F.col("page_index") >= 0, F.col("page_index") + 1))
    said_role = F.coalesce(own("inspection_role"), F.nullif(F.lit(role.strip()), F.lit("")))
    composite = F.col("item_type").eqNullSafe(F.lit("composite"))
    final = F.coalesce(kept_method, F.when(~composite, method))
    exceptions = F.array_compact(F.array(F.when(kept_method.isNull() & composite, "composite_method_required"), F.when(final.isNull() & ~composite, "unsupported_item_type"), F.when(said_role.isNull(), "missing_inspection_role"), F.when(page.isNull(), "missing_source_page")))
    remarks = F.when(F.col("remarks").isNull() | ours("remarks"), "").otherwise(F.col("remarks"))
    return df.select(
        "item_id", F.coalesce(own("inspection_item"), made).alias("inspection_item"), F.coalesce(own("inspection_standard"), F.lit("图纸要求")).alias("inspection_standard"), final.alias("inspection_method"),
        F.coalesce(own("key_dimension"), F.when(F.col("critical"), "是").otherwise("否")).alias("key_dimension"), said_role.alias("inspection_role"), page.alias("source_page"), remarks.alias("remarks"), F.array_join(exceptions, ",").alias("exceptions"),
    )


def item_fields(df: DataFrame) -> DataFrame:
    """Sheet fields of an item: label with its count, standard, method, key flag, page; what an operator set stays."""
    count = F.when(F.col("quantity") > 1, F.concat(F.lit("（"), F.col("quantity").cast("string"), F.lit("处）"))).otherwise("")
    method = F.when(F.col("item_type") == "thread", "螺纹规").when(F.col("item_type") == "angle", "角度尺").when(F.col("item_type") == "radius", "半径规").otherwise("游标卡尺")
    made = F.concat(F.col("label"), F.lit("："), F.col("size"), count)
    return df.select(
        "item_id", F.coalesce("manual_label", made).alias("inspection_item"), F.when(F.col("manual_label").isNotNull(), "manual").otherwise("generated").alias("provenance"), method.alias("method"), F.when(F.col("key"), "是").otherwise("否").alias("key_flag"), (F.col("page_index") + 1).alias("page")
    )


def needs_confirmation(entries: DataFrame, requirements: DataFrame) -> DataFrame:
    """Entries with whether any requirement of one of their sources is still unconfirmed."""
    each = requirements.select(F.explode("source_ids").alias("source_id"), "unconfirmed").groupBy("source_id").agg(F.bool_or("unconfirmed").alias("open"))
    return entries.join(each, "source_id", "left").select("entry_id", F.coalesce("open", F.lit(False)).alias("requires_confirmation"))
