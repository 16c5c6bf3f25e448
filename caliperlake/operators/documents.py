"""Documents and pages: duplicates, lines from spans, selection of observations, names, page classes, catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caliperlake.functions.annotations import page_class


def unique_documents(docs: DataFrame, id_col: str, content: Column) -> DataFrame:
    """The least id of each content, with the number of its copies; only hashes are shuffled."""
    return docs.select(F.col(id_col), F.sha2(content, 256).alias("content_sha256")).groupBy("content_sha256").agg(F.min(id_col).alias(id_col), F.count("*").alias("copies"))


def lines_from_spans(spans: DataFrame, line: str, order: str, text: str) -> DataFrame:
    """Spans that are not blank, joined in their order."""
    good = spans.where(F.trim(text) != "")
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return good.groupBy(line).agg(F.array_join(F.transform(parts, lambda s: s[text]), "").alias("text"), F.count("*").alias("n_spans"), F.sum(F.char_length(text)).alias("n_chars"))


def selected_observations(obs: DataFrame) -> DataFrame:
    """Native lines and everything that is not native; all of a page that has neither."""
    good = ~((F.col("source_type") == "native") & (F.col("level") != "line"))
    has = F.count_if(good).over(Window.partitionBy("doc_id", "page_index"))
    return obs.withColumn("_has", has).where((F.col("_has") == 0) | good).drop("_has")


def unique_names(df: DataFrame, key: str, name: str, id_col: str, most: int = 31) -> DataFrame:
    """Names cut to a length and made unique without regard to case, by a numbered suffix."""
    base = F.coalesce(F.nullif(F.substring(F.regexp_replace(name, r"[\\/*?:\[\]]", "_"), 1, most), F.lit("")), F.lit("Sheet"))
    df = df.withColumn("_base", base)
    df = df.withColumn("_k", F.row_number().over(Window.partitionBy(key, F.lower("_base")).orderBy(id_col)))
    marker = F.concat(F.lit("_"), F.col("_k").cast("string"))
    return df.withColumn("unique_name", F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat(F.substring("_base", F.lit(1), F.lit(most) - F.length(marker)), marker))).drop("_base", "_k")


def page_signals(obs: DataFrame, drawing: Column, coverage: Column) -> DataFrame:
    """Characters, spans, greatest image coverage and drawings of each page, and the class that follows."""
    signals = obs.groupBy("doc_id", "page_index").agg(F.sum(F.char_length("raw_text")).alias("native_char_count"), F.count("*").alias("native_span_count"), F.max(coverage).alias("max_image_coverage"), F.count_if(drawing).alias("vector_drawing_count"))
    return signals.withColumn("_c", page_class(F.col("native_char_count"), F.col("max_image_coverage"), F.col("vector_drawing_count"))).select("*", "_c.*").drop("_c")


def repeated_overlays(texts: DataFrame, text: str, bx: str, by: str) -> DataFrame:
    """Rows whose text stands in the same grid cell on two pages or more of its document."""
    repeated = texts.groupBy("doc_id", text, bx, by).agg(F.count_distinct("page_index").alias("pages")).where("pages >= 2").drop("pages")
    return texts.join(repeated, ["doc_id", text, bx, by], "left_semi")


# Labels and forms of texts that are not inspected, words of watermarks, edges of the page and of the title block.
METADATA_LABELS = ("设计", "校对", "审核", "批准", "签名", "日期", "重量", "比例", "图样代号", "物料编码")
WATERMARK_LABELS = ("CONFIDENTIAL", "DRAFT", "SAMPLE", "作废", "仅供参考", "仅供审阅", "受控", "机密", "样本", "样张")
SCALE, SECTION, NUMBER, ROMAN = r"\A[1-9][0-9]*\s*:\s*[1-9][0-9]*\z", r"\A([A-Z])\s*-\s*([A-Z])\z", r"\A[0-9]+(?:\.[0-9]+)?\z", r"\A(?:I|II|III|IV|V|VI|VII|VIII|IX|X)\z"
EDGE, TITLE_X, TITLE_Y = 0.02, 0.65, 0.82


def primary_disposition(text: Column, cx: Column, cy: Column, visual: Column | bool = False, repeated: Column | bool = False, layout: Column | None = None, watermark: Column | bool = False, preserved: Column | bool = False) -> Column:
    """Struct (disposition, reason, requires_confirmation) of a normalised text, or null: the first rule that holds.

    visual: a drawing beside the text needs it; repeated: it stands in the same place on other pages; layout: what the page's form says of it
    (a struct of disposition and reason, or null); watermark: part of the page's watermark; preserved: of an engineering meaning.
    """
    held = lambda c: F.lit(c) if isinstance(c, bool) else c
    made = lambda d, r, confirm=False: F.struct(F.lit(d).alias("disposition"), F.lit(r).alias("reason"), F.lit(confirm).alias("requires_confirmation"))
    upper, none = F.upper(text), F.lit(None)
    section = upper.rlike(SECTION) & (F.regexp_extract(upper, SECTION, 1) == F.regexp_extract(upper, SECTION, 2))
    number, frame = text.rlike(NUMBER), (cy <= EDGE) | (cy >= 1 - EDGE)
    said = F.when(text.isin(*METADATA_LABELS), made("non_inspection", "exact_metadata_label")).when(text.rlike(SCALE), made("non_inspection", "drawing_scale")).when(section, made("non_inspection", "section_view_label"))
    if layout is not None:
        said = said.when(layout.isNotNull(), F.struct(layout["disposition"].alias("disposition"), layout["reason"].alias("reason"), F.lit(False).alias("requires_confirmation")))
    return (
        said.when(held(watermark) & held(preserved), none)
        .when(held(watermark), made("non_inspection", "same_page_watermark"))
        .when(number & held(visual), none)
        .when(number & frame, made("non_inspection", "page_frame_number"))
        .when(number & (cx >= TITLE_X) & (cy >= TITLE_Y), made("ambiguous", "title_block_number", True))
        .when(number, none)
        .when(upper.rlike(ROMAN) & held(visual), none)
        .when(upper.rlike(ROMAN), made("ambiguous", "standalone_roman_label", True))
        .when(held(repeated) & ~upper.isin(*WATERMARK_LABELS), made("ambiguous", "repeated_page_text", True))
        .when(held(repeated), made("non_inspection", "repeated_page_overlay"))
    )


def catalogue(docs: DataFrame, opened: str, id_col: str) -> DataFrame:
    """Documents by last opening, the latest first."""
    return docs.orderBy(F.desc(opened), F.desc(id_col))


def list_page(df: DataFrame, key: str, order: list[Column], page: int, size: int = 50) -> DataFrame:
    """One page of each document's list."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("position", rank).where(F.col("position").between((page - 1) * size + 1, page * size))
