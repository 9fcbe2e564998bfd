"""Aggregate expressions (A-01..A-07, A-17, A-18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_sum(v: Column) -> Column:
    """NULL as soon as one value is missing."""
    return F.when(F.count(v) == F.count(F.lit(1)), F.sum(v))


def strict_avg(v: Column) -> Column:
    return F.when(F.count(v) == F.count(F.lit(1)), F.avg(v))


def count_rows(v: Column) -> Column:
    return F.count(F.lit(1))


def sum_present(v: Column) -> Column:
    return F.coalesce(F.sum(v), F.lit(0.0))


def count_present(v: Column) -> Column:
    return F.count(v)


def avg_present(v: Column) -> Column:
    return F.avg(v)


def pct_missing(v: Column) -> Column:
    return F.lit(100.0) * F.avg(F.when(v.isNull(), F.lit(1.0)).otherwise(F.lit(0.0)))


# The aggregation names users write.
CUBE_AGGREGATES = {
    "avg": strict_avg,
    "average": strict_avg,
    "sum": strict_sum,
    "count": count_rows,
    "sumna": sum_present,
    "countav": count_present,
    "avgna": avg_present,
    "avgav": avg_present,
    "pctna": pct_missing,
}

PIVOT_AGGREGATES = {
    "sum": F.sum,
    "mean": F.avg,
    "avg": F.avg,
    "std": F.stddev_samp,
    "max": F.max,
    "min": F.min,
}


def weighted_sum(value: Column, weight: Column) -> Column:
    """Sum of weight x value; an absent weight counts as 1."""
    return F.sum(value * F.coalesce(weight, F.lit(1.0)))


def missing_count(v: Column) -> Column:
    return F.count_if(v.isNull())


def case_aggregate(kind: str, field: str, scope: str = "Total", where: Column | None = None) -> Column:
    """Whole-case aggregate over result rows (columns scope, interface, orientation, value).

    ``field`` may end in ``_input`` / ``_output``. NULL when no row qualifies.
    """
    name = field.lower()
    orientations = ["input", "output"]
    for o in ("input", "output"):
        if name.endswith("_" + o):
            name, orientations = name[: -len(o) - 1], [o]
    pred = (
        (F.lower("scope") == scope.lower())
        & (F.lower("interface") == name)
        & F.lower("orientation").isin(orientations)
    )
    if where is not None:
        pred = pred & where
    v = F.when(pred, F.col("value"))
    rows = F.count_if(pred)
    picked = {
        "sum": F.coalesce(F.sum(v), F.lit(0.0)),
        "avg": F.avg(v),
        "max": F.max(v),
        "min": F.min(v),
        "count": rows.cast("double"),
        "nancount": F.count_if(pred & F.col("value").isNull()).cast("double"),
    }[kind.lower()]
    return F.when(rows > 0, picked)
