"""Row selection over cubes, results and model tables (Q-*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.functions.scalar import wildcard_regex
from tallyflow.operators.dictionary import CodeDictionary
from tallyflow.runtime import skew_join


def resolve_column(df: DataFrame, name: str) -> str | None:
    """Column of ``df`` with that name, ignoring case."""
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def _codes(codes) -> list[str]:
    return [str(c) for c in (codes if isinstance(codes, (list, tuple, set, frozenset)) else [codes])]


def is_value(code: str, kind: T.DataType) -> bool:
    """Is the text a value of the column type, written as a cast of the column to text would write it?"""
    try:
        if isinstance(kind, T.IntegralType):
            return str(int(code)) == code and -(1 << 63) <= int(code) < 1 << 63
        if isinstance(kind, (T.FractionalType,)):
            return float(code) is not None
        if isinstance(kind, T.DateType):
            return date.fromisoformat(code).isoformat() == code
    except ValueError:
        return False
    return False


def filter_dims(
    df: DataFrame, where: Mapping[str, Sequence], case_sensitive: bool = False, dictionary: CodeDictionary | None = None
) -> DataFrame:
    """AND over dimensions, IN over codes; an empty list does not restrict. Codes with letters reach the scan for dimensions of ``dictionary``."""
    for dim, codes in where.items():
        codes = _codes(codes)
        name = resolve_column(df, dim)
        if not codes or name is None:
            continue
        if case_sensitive:
            df = df.filter(F.col(name).cast("string").isin(codes))
        elif dictionary is not None and name in dictionary:
            df = dictionary.restrict(df, name, codes)
        elif any(c.lower() != c.upper() for c in codes):
            df = df.filter(F.lower(F.col(name).cast("string")).isin(sorted({c.lower() for c in codes})))
        elif (kind := df.schema[name].dataType).simpleString() == "string":
            # codes without letters: the plain comparison can be pushed to the scan
            df = df.filter(F.col(name).isin(codes))
        elif isinstance(kind, (T.IntegralType, T.FractionalType, T.DateType)):
            # codes of the column's own type can be pushed; a code that is no such value selects nothing
            df = df.filter(F.col(name).isin([c for c in codes if is_value(c, kind)]))
        else:
            df = df.filter(F.col(name).cast("string").isin(codes))
    return df


def filter_periods(df: DataFrame, start, end=None, period: str = "period") -> DataFrame:
    """Years start..end, both included; ``end`` defaults to ``start``.

    ``period`` may hold years (number or text) or dates; on a date column the range is written
    so that the scan can prune with it.
    """
    if start is None:
        return df
    lo, hi = int(start), int(end if end is not None else start)
    name = resolve_column(df, period)
    kind = dict(df.dtypes)[name]
    if kind.startswith(("date", "timestamp")):
        day = lambda y: F.lit(f"{y:04d}-01-01").cast(kind)
        return df.filter((F.col(name) >= day(lo)) & (F.col(name) < day(hi + 1)))
    if kind == "string":
        return df.filter(F.col(name).try_cast("int").between(lo, hi))
    return df.filter(F.col(name).between(lo, hi))


def filter_mapped(
    df: DataFrame,
    mapping: DataFrame,
    origin_dim: str,
    dest_dim: str,
    dest_codes: Sequence[str],
    dictionary: CodeDictionary | None = None,
) -> DataFrame:
    """Rows whose origin code maps to one of ``dest_codes``: a semi-join written before any other
    work, or a filter on the origin's own values if ``dictionary`` has the origin dimension."""
    wanted = sorted({c.lower() for c in dest_codes})
    origins = (
        mapping.filter(
            (F.lower("origin_dim") == origin_dim.lower())
            & (F.lower("dest_dim") == dest_dim.lower())
            & F.lower("dest_code").isin(wanted)
        )
        .select(F.lower("origin_code").alias("_code"))
        .distinct()
    )
    name = resolve_column(df, origin_dim)
    if dictionary is not None and name in dictionary:
        return dictionary.restrict(df, name, origins)
    return (
        df.withColumn("_code", F.lower(F.col(origin_dim).cast("string")))
        .join(origins, "_code", "left_semi")
        .drop("_code")
    )


def select_results(
    results: DataFrame,
    scope: str | None = None,
    processors: Sequence[str] | DataFrame | None = None,
    interfaces: Sequence[str] | None = None,
    indicators: Sequence[str] | None = None,
) -> DataFrame:
    """Result rows of a scope, a set of processors, interfaces or indicators (any case)."""
    if scope:
        results = results.filter(F.lower("scope") == scope.lower())
    for col, names in (("interface", interfaces), ("indicator", indicators)):
        if names:
            results = results.filter(F.lower(col).isin(sorted({n.strip().lower() for n in names})))
    if isinstance(processors, DataFrame):
        wanted = processors.select(F.lower("processor").alias("_p")).distinct()
        results = results.withColumn("_p", F.lower("processor")).join(wanted, "_p", "left_semi").drop("_p")
    elif processors:
        results = results.filter(F.lower("processor").isin(sorted({p.lower() for p in processors})))
    return results


def without_dismissed(results: DataFrame) -> DataFrame:
    return results.filter(F.col("conflict").isin("No", "Taken")).drop("conflict")


def select_processors(
    processors: DataFrame, predicate: str | Column, ancestor: str | None = None, closure: DataFrame | None = None
) -> DataFrame:
    """Processors meeting a SQL predicate, optionally below an ancestor (``closure(ancestor, descendant)``)."""
    picked = processors.filter(F.expr(predicate) if isinstance(predicate, str) else predicate)
    if ancestor is None:
        return picked
    below = closure.filter(F.col("ancestor") == ancestor).select(F.col("descendant").alias("processor"))
    return picked.join(below, "processor", "left_semi")


def match_names(processors: DataFrame, pattern: str, name: str = "processor") -> DataFrame:
    """Names matching ``A..B`` / ``..B`` / ``A..`` from their start."""
    regex = processors.sparkSession.range(1).select(wildcard_regex(F.lit(pattern)).alias("r")).first()["r"]
    return processors.filter(F.col(name).rlike(regex))


def resolve_names(processors: DataFrame, paths: DataFrame, names: DataFrame) -> DataFrame:
    """Resolve partial hierarchical names: ``names(name)`` against the tails of ``paths(node, path)``.

    Every tail of a path is a usable name. One row per name with the number of matches and,
    when unique, the matched path.
    """
    parts = F.split("path", r"\.")
    tails = paths.select(
        "node",
        "path",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(parts)),
                lambda i: F.lower(F.array_join(F.slice(parts, i, F.size(parts)), ".")),
            )
        ).alias("_key"),
    )
    # a multi-parent node has several paths but is one match
    hits = (
        skew_join(tails, names.select("name", F.lower("name").alias("_key")), ["_key"])
        .join(processors.select(F.col("processor").alias("node")), "node", "left_semi")
        .groupBy("name", "node")
        .agg(F.min("path").alias("path"))
    )
    found = hits.groupBy("name").agg(F.count(F.lit(1)).alias("matches"), F.min("path").alias("path"))
    return (
        names.select("name")
        .join(found, "name", "left")
        .select(
            "name",
            F.coalesce("matches", F.lit(0)).cast("long").alias("matches"),
            F.when(F.col("matches") == 1, F.col("path")).alias("path"),
        )
    )


def lookup_by_attr(df: DataFrame, attr: str, values: DataFrame, name: str) -> DataFrame:
    """First name (in name order) whose attribute equals each wanted ``values(value)``.

    Text is compared ignoring case, numbers by value; both keys are hashed so that the match
    stays an equi-join.
    """
    key = lambda c: F.coalesce(c.try_cast("double").cast("string"), F.lower(c))
    attribute = F.coalesce(
        *([F.col(attr).cast("string")] if attr in df.columns else []),
        *([F.col("attributes")[attr]] if "attributes" in df.columns else []),
    )
    have = df.select(F.col(name).alias("found"), key(attribute).alias("_key"))
    want = values.select(F.col("value").cast("string").alias("value")).withColumn("_key", key(F.col("value")))
    first = have.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("found").alias("found"))
    return want.join(first, "_key", "left").drop("_key")


def flatten_paths(paths: DataFrame, flows: DataFrame, levels: Sequence[str]) -> DataFrame:
    """One row per flow with each enclosing level as a column; the value is coerced to a number."""
    parts = F.split("path", r"\.")
    cols = [F.get(parts, F.lit(i)).alias(level) for i, level in enumerate(levels)]
    return (
        paths.select("node", *cols)
        .join(flows, "node")
        .withColumn("value", F.col("value").cast("string").try_cast("double"))
    )


def end_use_matrix(
    results: DataFrame, units: Mapping[str, str], processors: Sequence[str] | DataFrame | None = None
) -> DataFrame:
    """Input rows of the given interfaces as columns named ``<interface> (<unit>)``."""
    picked = select_results(results, processors=processors, interfaces=list(units))
    picked = picked.filter(F.lower("orientation") == "input")
    names = sorted(units)
    wide = picked.groupBy("scenario", "period", "processor", "level").pivot("interface", names).agg(F.avg("value"))
    return wide.withColumnsRenamed({n: f"{n} ({units[n]})" for n in names})


