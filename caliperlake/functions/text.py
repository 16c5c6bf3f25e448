"""Text and decimal rules as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that mean a diameter.
DIAMETER_SIGNS, DIAMETER = "∅ø⌀", "Φ"
NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def _nfkc(s):
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility form; Spark has no function for it, so one Arrow batch function, and only for texts beyond ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, text).otherwise(F.pandas_udf(_nfkc, "string")(text))


def collapsed(text: Column) -> Column:
    """Diameter signs made one, white space made single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(text, DIAMETER_SIGNS, DIAMETER * len(DIAMETER_SIGNS)), r"(?U)\s+", " "))


def normalised(text: Column) -> Column:
    return collapsed(nfkc(text))


def compact(text: Column) -> Column:
    return F.regexp_replace(nfkc(text), r"(?U)\s+", "")


def short_token(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, "[ ]+", " ")).rlike(r"\A[A-Z0-9]{1,3}\z"), F.lit(False))


def group(text: Column, pattern: str, k: int) -> Column:
    """The k-th group of a match, null where it has none."""
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def joined_wrapped(parts: Column) -> Column:
    """Parts in order; a space only between two ASCII letters or digits."""

    def glue(done: Column, part: Column) -> Column:
        space = done.rlike("[A-Za-z0-9]$") & part.rlike("^[A-Za-z0-9]")
        return F.when(done == "", part).when(part == "", done).otherwise(F.concat(done, F.when(space, " ").otherwise(""), part))

    return F.aggregate(parts, F.lit(""), glue)


def standalone_decimals(text: Column) -> Column:
    """Distinct numbers that touch no letter, digit or point, in the order of their first place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z.])([0-9]+(?:\.[0-9]+)?)(?![0-9A-Za-z.])"), F.lit(1)))


def decimal_text(value: Column) -> Column:
    """Without trailing zeros, and no negative zero."""
    text = value.cast("string")
    bare = F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(bare.isin("-0", ""), "0").otherwise(bare)


def tolerance_text(upper: Column, lower: Column) -> Column:
    """±x where the limits are symmetric, else upper/lower with signs."""
    signed = lambda v: F.concat(F.when(v > 0, "+").otherwise(""), decimal_text(v))
    return F.when(upper == -lower, F.concat(F.lit("±"), decimal_text(upper))).otherwise(F.concat(signed(upper), F.lit("/"), signed(lower)))


def tolerance_values(base: Column, upper: Column, lower: Column) -> Column:
    """Struct of text, upper_limit, lower_limit and error: both limits or none, the upper one not below the lower."""
    error = F.when(upper.isNull() != lower.isNull(), "one_sided_tolerance").when(upper < lower, "inverted_tolerance")
    good = error.isNull() & upper.isNotNull()
    return F.struct(
        F.when(good, tolerance_text(upper, lower)).otherwise(F.lit("")).alias("text"),
        F.when(good, base + upper).alias("upper_limit"),
        F.when(good, base + lower).alias("lower_limit"),
        error.alias("error"),
    )


def safe_stem(name: Column, fallback: str = "inspection") -> Column:
    """File stem: last path part, without suffix, characters that file systems refuse as underscores, at most 120."""
    stem = F.regexp_replace(F.substring_index(name, "/", -1), r"\.[^.]*$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", "")
    return F.substring(F.coalesce(F.nullif(stem, F.lit("")), F.lit(fallback)), 1, 120)


def formula_like(text: Column) -> Column:
    """Text that a sheet would take for a formula."""
    return F.coalesce(text.rlike(r"^[=+\-@]"), F.lit(False))


def stable_id(*parts: Column) -> Column:
    """24 hexadecimal digits of the SHA-256 over each part's byte length (eight bytes) and bytes."""
    framed = []
    for p in parts:
        framed += [F.unhex(F.lpad(F.hex(F.octet_length(p).cast("bigint")), 16, "0")), F.encode(p, "UTF-8")]
    return F.substring(F.sha2(F.concat(*framed), 256), 1, 24)


def canonical_sha(*fields: tuple[str, Column]) -> Column:
    """SHA-256 of the JSON of the fields in alphabetical order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields, key=lambda f: f[0]))), {"ignoreNullFields": "false"}), 256)
