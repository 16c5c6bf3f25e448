"""Annotations of drawings: parsing, coarse types, requirement classes, labels.

Rules are tried in a fixed order and the first that matches decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NUMBER, collapsed, decimal_text, group

# Forms of annotations.
QUANTITY = r"^([1-9][0-9]*)\s*([×xX-])\s*(.+)$"
DEPTH_OR_THROUGH = rf"(?:\s*(?:深|↓)\s*({NUMBER}))?(?:\s*(通|贯穿))?$"
THREAD = rf"^(M{NUMBER}(?:\s*[×xX]\s*{NUMBER})?)" + DEPTH_OR_THROUGH
DIAMETER = rf"^Φ\s*({NUMBER})" + DEPTH_OR_THROUGH
RADIUS = rf"^R\s*({NUMBER})$"
ANGLE = rf"^({NUMBER})\s*°(?:\s*±\s*({NUMBER})\s*°?)?$"
SIGNED = rf"(?:[+-]{NUMBER}|0(?:\.0+)?)"
LINEAR = rf"^({NUMBER})(?:\s*±\s*({NUMBER})|\s*({SIGNED})\s*/\s*({SIGNED}))?$"
DEPTH_MODIFIER, THROUGH_MODIFIER = rf"^(?:深|↓)\s*({NUMBER})$", r"^(?:通|贯穿)$"
TYPE_LABELS = {"linear_dimension": "线性", "diameter_dimension": "直径", "radius": "半径", "angle": "角度", "thread": "螺纹", "general_requirement": "技术要求"}
OTHER_LABEL, ROUGHNESS_LABEL = "复合", "粗糙度"
DECIMAL = "decimal(20,6)"


def _bound(value: Column, made) -> Column:
    """made(value), with the value worked out once and not copied into each use, which keeps generated code small."""
    return F.transform(F.array(value), made)[0]


def _body(whole: Column) -> Column:
    sign, rest = group(whole, QUANTITY, 2), group(whole, QUANTITY, 3)
    counted = sign.isNotNull() & ~((sign == "-") & rest.rlike("^[0-9]"))
    return F.struct(F.when(counted, rest).otherwise(whole).alias("body"), F.when(counted, group(whole, QUANTITY, 1).cast("int")).alias("quantity"))


def _kind(b: Column) -> Column:
    return F.when(b.rlike(THREAD), "thread").when(b.rlike(DIAMETER), "diameter_dimension").when(b.rlike(RADIUS), "radius").when(b.rlike(ANGLE), "angle").when(b.rlike(LINEAR), "linear_dimension")


_CUT = "\u0001"


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All groups of a text that the pattern matches whole, from one run of it: an array of n texts, empty where a group has no part."""
    return F.split(F.regexp_replace(text, pattern, _CUT.join(f"${k}" for k in range(1, n + 1))), _CUT)


def parsed(df: DataFrame, text: str = "normalized_text") -> DataFrame:
    """df with item_type (null: not parsed), body, quantity, nominal, value, upper, lower, depth, through and thread_spec.

    Each step is a column of its own that the next one uses, and a form is run once to find its type and once to cut it, so all of it stays in generated code.
    """
    rest, whole = df.columns, F.col(text)
    df = df.withColumn("_q", F.when(whole.rlike(QUANTITY), _groups(whole, QUANTITY, 3)))
    sign, after = F.try_element_at("_q", F.lit(2)), F.try_element_at("_q", F.lit(3))
    df = df.withColumn("_counted", F.col("_q").isNotNull() & ~((sign == "-") & after.rlike("^[0-9]")))
    df = df.withColumns({"body": F.when(F.col("_counted"), after).otherwise(whole), "quantity": F.when(F.col("_counted"), F.try_element_at("_q", F.lit(1)).cast("int"))})
    df = df.withColumn("item_type", _kind(F.col("body")))
    kind = F.col("item_type")
    cut = F.lit(None).cast("array<string>")
    for name, pattern, n in (("thread", THREAD, 3), ("diameter_dimension", DIAMETER, 3), ("radius", RADIUS, 1), ("angle", ANGLE, 2), ("linear_dimension", LINEAR, 4)):
        cut = F.when(kind == name, _groups(F.col("body"), pattern, n)).otherwise(cut)
    df = df.withColumn("_g", cut)
    part = lambda k: F.nullif(F.try_element_at("_g", F.lit(k)), F.lit(""))
    thread, diameter, radius, angle, linear = (kind == k for k in ("thread", "diameter_dimension", "radius", "angle", "linear_dimension"))
    symmetric = F.when(angle | linear, part(2)).cast(DECIMAL)
    return df.select(
        *rest,
        "body",
        "quantity",
        "item_type",
        F.when(diameter | linear, part(1)).alias("nominal_raw"),
        F.when(radius | angle, part(1)).alias("value_raw"),
        F.coalesce(symmetric, F.when(linear, part(3)).cast(DECIMAL)).cast(DECIMAL).alias("upper_tolerance"),
        F.coalesce(-symmetric, F.when(linear, part(4)).cast(DECIMAL)).cast(DECIMAL).alias("lower_tolerance"),
        F.when(thread | diameter, part(2)).alias("depth_raw"),
        F.when(thread | diameter, part(3).isNotNull()).otherwise(False).alias("through"),
        F.when(thread, F.regexp_replace(part(1), r"\s*[xX×]\s*", "×")).alias("thread_spec"),
    )


# Forms of technical requirements.
DIMENSION_STANDARD = r"未(?:注|标注)(?:尺寸)?公差按\s*GB\s*/\s*T\s*1804\s*[-—]?\s*([FfMmCcVv])(?:级)?\s*执行"
GEOMETRY_STANDARD = r"未(?:注|标注)形位公差按\s*GB\s*/\s*T\s*1184\s*[-—]?\s*([HhKkLl])\s*执行"
DEFAULT_CHAMFER = r"未(?:注|标注)(?:的)?倒角\s*[Cc]\s*([0-9]+(?:\.[0-9]+)?)"
EXPLICIT_CHAMFER = r"(?:检查|检验|测量|确认|验证).*?倒角.*?(?:尺寸)?应为\s*([0-9]+(?:\.[0-9]+)?\s*[×xX]\s*[0-9]+(?:\.[0-9]+)?\s*°?)"
DEBURR = r"锐边.*?(?:去除?|清除)毛刺|去除?毛刺"
SURFACE, TREATMENT = r"(?:表面|外观).*?(?:划痕|擦伤|损伤|裂纹)", r"表面.*?阳极氧化.*?处理"
VERB, CRITERION = r"检查|检验|检测|测量|确认|验证", r"不得|不允许|应为|应达到|应符合|符合|不大于|不小于|≤|≥|无(?:毛刺|裂纹|缺陷|损伤)"
UNKNOWN_STANDARD = r"未(?:注|标注)(?:尺寸|形位)公差按.+执行"


def executable(text: Column) -> Column:
    """An inspection verb and a criterion to verify."""
    return text.rlike(VERB) & text.rlike(CRITERION)


def engineering(text: Column) -> Column:
    """A number, an executable requirement, or an annotation that can be parsed."""
    parsable = lambda b: _kind(b["body"]).isNotNull()
    return text.rlike(rf"\A{NUMBER}\z") | executable(text) | _bound(_body(text), parsable)


def requirement_class(text: Column, ordinal: Column) -> Column:
    """Struct (category, subtype, parameter) of a technical requirement: the first rule that holds."""
    made = lambda category, subtype, parameter=None: F.struct(F.lit(category).alias("category"), F.lit(subtype).alias("subtype"), (F.lit(None).cast("string") if parameter is None else parameter).alias("parameter"))
    return (
        F.when(text.rlike(DIMENSION_STANDARD), made("applicability_rule", "general_dimensional_tolerance", F.concat(F.lit("GB/T 1804-"), F.lower(F.regexp_extract(text, DIMENSION_STANDARD, 1)))))
        .when(text.rlike(GEOMETRY_STANDARD), made("applicability_rule", "general_geometric_tolerance", F.concat(F.lit("GB/T 1184-"), F.lower(F.regexp_extract(text, GEOMETRY_STANDARD, 1)))))
        .when(text.rlike(DEFAULT_CHAMFER), made("applicability_rule", "default_chamfer", F.concat(F.lit("C"), F.regexp_extract(text, DEFAULT_CHAMFER, 1))))
        .when(text.rlike(EXPLICIT_CHAMFER), made("standalone_check", "default_chamfer", F.regexp_replace(F.regexp_extract(text, EXPLICIT_CHAMFER, 1), r"\s*[xX×]\s*", "×")))
        .when(text.rlike(DEBURR), made("standalone_check", "deburr"))
        .when(text.rlike(SURFACE), made("standalone_check", "surface_integrity"))
        .when(text.rlike(TREATMENT), made("standalone_check", "surface_treatment"))
        .when(ordinal.isNull() & executable(text), made("standalone_check", "ambiguous"))
        .when(text.rlike(UNKNOWN_STANDARD), made("unsupported", "unsupported"))
        .otherwise(made("ambiguous", "ambiguous"))
    )


# Sheet items of the requirement classes.
REQUIREMENT_ITEMS = {"general_dimensional_tolerance": "未注尺寸公差", "general_geometric_tolerance": "未注形位公差", "deburr": "去毛刺与锐边检查", "surface_integrity": "外观检查", "surface_treatment": "表面处理检查"}


def requirement_suggestion(found: Column, text: Column) -> Column:
    """Struct (inspection_item, inspection_standard, key_dimension) that a classified requirement puts on the sheet; found is its class."""
    subtype, check = found["subtype"], found["category"] == "standalone_check"
    item = F.when(subtype == "default_chamfer", F.when(check, "倒角检查").otherwise("未标注倒角")).when((subtype == "ambiguous") & check, "技术要求检查")
    for name, said in REQUIREMENT_ITEMS.items():
        item = item.when(subtype == name, said)
    standard = F.when(subtype.startswith("general_"), found["parameter"]).when(check & (subtype != "default_chamfer"), text)
    return F.struct(item.alias("inspection_item"), standard.alias("inspection_standard"), F.when(subtype == "default_chamfer", found["parameter"]).alias("key_dimension"))


def modifier(text: Column) -> Column:
    """Struct (kind, value) of a depth or through modifier; null for any other text."""
    depth = group(text, DEPTH_MODIFIER, 1)
    return F.when(depth.isNotNull(), F.struct(F.lit("depth").alias("kind"), depth.alias("value"))).when(text.rlike(THROUGH_MODIFIER), F.struct(F.lit("through").alias("kind"), F.lit("true").alias("value")))


def coarse_type(text: Column) -> Column:
    return F.when(text.rlike(r"Ra\s*[0-9]") | text.contains(ROUGHNESS_LABEL), "roughness").when(text.contains("焊"), "weld")


def roughness_value(text: Column) -> Column:
    return group(text, rf"Ra\s*({NUMBER})", 1)


def explicit_depth(text: Column) -> Column:
    """Number of a text that is a depth and nothing else."""
    return group(text, DEPTH_MODIFIER, 1)


def type_label(item_type: Column, coarse: Column) -> Column:
    label = F.when(coarse == "roughness", ROUGHNESS_LABEL)
    for name, said in TYPE_LABELS.items():
        label = label.when(item_type == name, said)
    return label.otherwise(OTHER_LABEL)


def basic_size(df: DataFrame) -> Column:
    """Size text of a sheet row: sign and number of a dimension, a thread's own text, else the text as reviewed."""
    number = decimal_text(F.coalesce("nominal_raw", "value_raw").cast(DECIMAL))
    kind = F.col("item_type")
    return (
        F.when(kind == "diameter_dimension", F.concat(F.lit("Φ"), number))
        .when(kind == "radius", F.concat(F.lit("R"), number))
        .when(kind == "angle", F.concat(number, F.lit("°")))
        .when(kind == "linear_dimension", number)
        .when(kind == "thread", F.col("thread_spec"))
        .otherwise(collapsed(F.col("raw_text")))
    )


def failure_category(status: Column) -> Column:
    """Kind of a failed remote call by its HTTP status."""
    return F.when(status == 408, "timeout").when(status.isin(401, 403), "authentication").when(status == 429, "rate_limited").when(status.between(500, 599), "service_failure").otherwise("request_rejected")


def page_class(chars: Column, coverage: Column, drawings: Column) -> Column:
    """Struct (page_type, route, support) of a page from its signals."""
    made = lambda *v: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, ("page_type", "route", "support"), strict=True)))
    text, image = chars >= 20, coverage >= 0.8
    return F.when(text & image, made("hybrid", "hybrid", "supported")).when(text & ((drawings > 0) | ~image), made("vector", "native", "supported")).when(~text & image, made("scanned", "unsupported", "unsupported")).otherwise(made("ambiguous", "hybrid", "review_required"))
