"""Scalar column expressions (X-*): names, text, periods, intervals, typed parsing, units."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_nan(df: DataFrame, *cols: str) -> DataFrame:
    """Missing values are NULL inside the library; NaN is normalised on the way in."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


# -- names ------------------------------------------------------------------------------
def identifier_name(s: Column) -> Column:
    """A valid identifier: runs of other characters become ``_``, a non-letter start gets ``id_``."""
    starts_ok = s.rlike(r"^\p{L}")
    return F.when(
        starts_ok, F.concat(F.substring(s, 1, 1), F.regexp_replace(F.substr(s, F.lit(2)), r"[^0-9a-zA-Z_]+", "_"))
    ).otherwise(F.concat(F.lit("id_"), F.regexp_replace(s, r"[^0-9a-zA-Z_]+", "_")))


def last_part(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def name_variants(path: Column) -> Column:
    """Names under which an object may be referred to: the full path, then its last part."""
    return F.array_distinct(F.array(path, last_part(path)))


def wildcard_regex(pattern: Column) -> Column:
    """``A..B``, ``..B``, ``A.B`` as an anchored-at-start regular expression over dotted names."""
    quoted = F.regexp_replace(pattern, r"([^A-Za-z0-9_.*])", r"\\$1")
    marked = F.regexp_replace(F.regexp_replace(quoted, r"\*", ""), r"\.\.", "\u0001")
    dotted = F.replace(marked, F.lit("."), F.lit(r"\."))
    leading = F.regexp_replace(dotted, "^\u0001(?=.)", r".*\\.")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(leading, "^\u0001$", ".*"), "\u0001", r"\\..*"))


# -- text -------------------------------------------------------------------------------
# Characters replaced before a formula is read.
CLEAN_FROM = "“”‘’–—"
CLEAN_TO = "\"\"''--"
CURRENCY_WORDS = {"€": "eur", "$": "usd"}


def clean_text(s: Column) -> Column:
    out = F.translate(s, CLEAN_FROM, CLEAN_TO)
    for sign, word in CURRENCY_WORDS.items():
        out = F.replace(out, F.lit(sign), F.lit(word))
    return out


def replace_words(s: Column, words: Mapping[str, str]) -> Column:
    """Replace whole words, shortest replacement first."""
    out = s
    for old, new in sorted(words.items(), key=lambda kv: len(kv[1])):
        out = F.regexp_replace(out, rf"\b\Q{old}\E\b", new.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def key_value_map(s: Column) -> Column:
    """``a=1, b="x"`` as ``map<string,string>``; NULL and blank text give an empty map."""
    cleaned = F.regexp_replace(F.trim(F.coalesce(s, F.lit(""))), r"\s*([,=])\s*", "$1")
    unquoted = F.regexp_replace(cleaned, r"[\"']", "")
    return F.when(unquoted == "", F.create_map().cast("map<string,string>")).otherwise(
        F.str_to_map(unquoted, F.lit(","), F.lit("="))
    )


# -- arithmetic -------------------------------------------------------------------------
def add_absent(a: Column, b: Column) -> Column:
    """An absent operand of a sum counts as 0."""
    return F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))


def multiply_absent(a: Column, b: Column) -> Column:
    """An absent operand of a product counts as 1."""
    return F.coalesce(a, F.lit(1.0)) * F.coalesce(b, F.lit(1.0))


def multiply_text(a: Column, b: Column) -> Column:
    """Product of two weights given as text that keeps symbolic parts: ``(a)*(b)``."""
    na, nb = a.try_cast("double"), b.try_cast("double")
    return (
        F.when(a.isNull(), b)
        .when(b.isNull(), a)
        .when(na.isNotNull() & nb.isNotNull(), (na * nb).cast("string"))
        .otherwise(F.concat(F.lit("("), a, F.lit(")*("), b, F.lit(")")))
    )


def first_true(branches: list[tuple[str, str]], default: str | None = None) -> Column:
    """Conditional list: value of the first true condition, all given as SQL expressions."""
    out = None
    for cond, value in branches:
        out = F.when(F.expr(cond), F.expr(value)) if out is None else out.when(F.expr(cond), F.expr(value))
    return out if default is None else out.otherwise(F.expr(default))


# -- periods ----------------------------------------------------------------------------
YEAR = r"^\d{4}$"
MONTH_YEAR = r"^(\d{1,2})[-/](\d{4})$"
YEAR_MONTH = r"^(\d{4})[-/](\d{1,2})$"
DATE_SPAN = r"^(\d{4}-\d{2}-\d{2})\s*[-/]\s*(\d{4}-\d{2}-\d{2})$"


def period_kind(p: Column) -> Column:
    low = F.lower(F.trim(p))
    return (
        F.when(low.rlike(YEAR), F.lit("year"))
        .when(low.rlike(MONTH_YEAR) | low.rlike(YEAR_MONTH), F.lit("month"))
        .when(low.rlike(DATE_SPAN), F.lit("span"))
        .when(low.isin("year", "month", "quarter", "semester"), F.concat(F.lit("generic "), low))
    )


def period_start(p: Column) -> Column:
    t = F.trim(p)
    year_month = F.make_date(
        F.regexp_extract(t, YEAR_MONTH, 1).try_cast("int"),
        F.regexp_extract(t, YEAR_MONTH, 2).try_cast("int"),
        F.lit(1),
    )
    month_year = F.make_date(
        F.regexp_extract(t, MONTH_YEAR, 2).try_cast("int"),
        F.regexp_extract(t, MONTH_YEAR, 1).try_cast("int"),
        F.lit(1),
    )
    return (
        F.when(t.rlike(YEAR), F.make_date(t.try_cast("int"), F.lit(1), F.lit(1)))
        .when(t.rlike(YEAR_MONTH), year_month)
        .when(t.rlike(MONTH_YEAR), month_year)
        .when(t.rlike(DATE_SPAN), F.regexp_extract(t, DATE_SPAN, 1).try_cast("date"))
    )


# -- intervals --------------------------------------------------------------------------
INTERVAL = r"^\s*([\[(])\s*([-+.0-9eE]+)\s*,\s*([-+.0-9eE]+)\s*([\])])\s*$"


def parse_interval(s: Column) -> Column:
    """``[a,b)`` as struct<lo,lo_incl,hi,hi_incl>; NULL when malformed."""
    return F.when(
        s.rlike(INTERVAL),
        F.struct(
            F.regexp_extract(s, INTERVAL, 2).try_cast("double").alias("lo"),
            (F.regexp_extract(s, INTERVAL, 1) == "[").alias("lo_incl"),
            F.regexp_extract(s, INTERVAL, 3).try_cast("double").alias("hi"),
            (F.regexp_extract(s, INTERVAL, 4) == "]").alias("hi_incl"),
        ),
    )


def in_interval(v: Column, lo: Column, lo_incl: Column, hi: Column, hi_incl: Column) -> Column:
    return ((v > lo) | (lo_incl & (v == lo))) & ((v < hi) | (hi_incl & (v == hi)))


# -- typed parsing ----------------------------------------------------------------------
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]+"


def attribute_type(s: Column) -> Column:
    """First type that fits, in the order Boolean, Integer, Float, Datetime, URL, UUID, String."""
    return (
        F.when(F.lower(s).isin("true", "false"), F.lit("Boolean"))
        .when(s.rlike(r"^\s*[-+]?\d+\s*$"), F.lit("Integer"))
        .when(s.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), F.lit("Float"))
        .when(s.try_cast("timestamp").isNotNull(), F.lit("Datetime"))
        .when(s.rlike(URL), F.lit("URL"))
        .when(s.rlike(UUID), F.lit("UUID"))
        .when(s.isNotNull(), F.lit("String"))
    )


def same_value(a: Column, b: Column) -> Column:
    """Case-insensitive text equality or, when both are numbers, numeric equality."""
    na, nb = a.try_cast("double"), b.try_cast("double")
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(False)) | F.coalesce(na == nb, F.lit(False))


# -- units ------------------------------------------------------------------------------
def convert_units(df: DataFrame, units: DataFrame, value: str, from_unit: str, to_unit: str, out: str) -> DataFrame:
    """``out`` = value in the target unit; ``<out>_missing`` marks pairs absent from ``units(from,to,ratio)``."""
    ratio = units.select(F.col("from").alias(from_unit), F.col("to").alias(to_unit), F.col("ratio").alias("_ratio"))
    same = F.col(from_unit) == F.col(to_unit)
    factor = F.when(same | F.col(from_unit).isNull(), F.lit(1.0)).otherwise(F.col("_ratio"))
    return (
        df.join(ratio, [from_unit, to_unit], "left")
        .withColumn(out, F.col(value) * factor)
        .withColumn(f"{out}_missing", factor.isNull())
        .drop("_ratio")
    )


def scaled_transform_weight(weight: Column, source_ratio: Column, target_ratio: Column) -> Column:
    """Weight of a type transform with the unit ratios of both sides (absent ratio = 1)."""
    return weight * F.coalesce(source_ratio, F.lit(1.0)) * F.coalesce(target_ratio, F.lit(1.0))


# -- pedigree ---------------------------------------------------------------------------
def pedigree_modes(df: DataFrame, code: str, phases: DataFrame) -> DataFrame:
    """Digit i of ``code`` selects mode of phase i; one row per digit.

    ``phases(phase int, mode int, label string)``; phases are numbered from 0.
    """
    each = F.transform(F.sequence(F.lit(1), F.length(code)), lambda i: F.substring(F.col(code), i, F.lit(1)))
    digits = df.filter(F.length(code) > 0).select("*", F.posexplode(each).alias("phase", "_d"))
    return digits.withColumn("mode", F.col("_d").try_cast("int")).drop("_d").join(phases, ["phase", "mode"], "left")
