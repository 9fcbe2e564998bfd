"""Where computed values come from (G-12 over several steps, G-16 ``expression``).

``solve.contributions`` tells for each computed value the values that entered it directly. Together these steps are a weighted graph
without cycles. Its closure multiplies weights along a path and adds them up over paths, so that a value is a weighted sum of what was observed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyflow.runtime import Scratch, skew_join, union_all

KEYS = ["scenario", "period"]
MOST_TABLES = 8  # of a closure, before they are added up


def direct_steps(contributions: DataFrame) -> DataFrame:
    """(scenario, period, origin, destination, weight): parallel contributions added up."""
    return contributions.groupBy(*KEYS, "origin", "destination").agg(F.sum("weight").alias("weight"))


class _Closure:
    """Paths of a length give those that are a step longer; sums of finished lengths are kept in few tables."""

    def __init__(self, scratch: Scratch, ends: list[str], most_steps: int):
        self.scratch, self.ends, self.most = scratch, [*KEYS, *ends], most_steps
        self.found: list[DataFrame] = []
        self.length = 0

    def summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.ends).agg(F.sum("weight").alias("weight"))

    def next(self, rows: DataFrame, label: str) -> DataFrame | None:
        self.length += 1
        if self.length > self.most:
            raise ValueError(f"derivations of more than {self.most} steps: are there cycles?")
        table, n = self.scratch.save_counted(self.summed(rows), label)
        return table if n else None

    def keep(self, rows: DataFrame) -> None:
        self.found.append(rows)
        if len(self.found) > MOST_TABLES:
            self.found = [self.scratch.save(self.summed(union_all(self.found)), "sums")]


def provenance(contributions: DataFrame, values: DataFrame, targets: DataFrame | None = None, most_steps: int = 1_000) -> DataFrame:
    """(scenario, period, origin, destination, weight, quantity): observed origins of computed values.

    ``values(scenario, period, node, value)`` holds the values in force (``Solution.values``); quantity = weight x value of the origin, and the
    quantities of a destination add up to its value. An origin is a value that nothing contributes to. A round joins the paths of one length
    with the steps: all rows that it writes are results, or, if ``targets(scenario, period, node)`` names the values wanted, it walks from these
    back to the origins and touches nothing else. There are as many rounds as steps in the longest derivation.
    """
    scratch = Scratch(contributions.sparkSession, "provenance")
    steps = scratch.save(direct_steps(contributions), "steps")
    made = steps.select(*KEYS, F.col("destination").alias("origin")).distinct()
    if targets is None:
        total = _from_origins(scratch, steps, made, most_steps)
    else:
        total = _from_targets(scratch, steps, made, targets, most_steps)
    value = values.select(*KEYS, F.col("node").alias("origin"), F.col("value").alias("_v"))
    # an origin may enter every value of its scenario
    out = skew_join(total, value, [*KEYS, "origin"])
    return out.select(*KEYS, "origin", "destination", "weight", (F.col("weight") * F.col("_v")).alias("quantity"))


def _from_origins(scratch: Scratch, steps: DataFrame, made: DataFrame, most_steps: int) -> DataFrame:
    paths = _Closure(scratch, ["origin", "destination"], most_steps)
    ahead = steps.select(*KEYS, F.col("origin").alias("_at"), F.col("destination").alias("_to"), F.col("weight").alias("_w"))
    frontier = paths.next(skew_join(steps, made, [*KEYS, "origin"], "left_anti"), "first")
    while frontier is not None:
        paths.keep(frontier)
        moved = skew_join(frontier.withColumnRenamed("destination", "_at"), ahead, [*KEYS, "_at"])
        frontier = paths.next(moved.select(*KEYS, "origin", F.col("_to").alias("destination"), (F.col("weight") * F.col("_w")).alias("weight")), "paths")
    return paths.summed(union_all(paths.found or [steps.limit(0)]))


def _from_targets(scratch: Scratch, steps: DataFrame, made: DataFrame, targets: DataFrame, most_steps: int) -> DataFrame:
    paths = _Closure(scratch, ["origin", "destination"], most_steps)
    back = steps.select(*KEYS, F.col("destination").alias("_at"), F.col("origin").alias("_from"), F.col("weight").alias("_w"))
    wanted = targets.select(*KEYS, F.col("node").alias("destination")).distinct()
    frontier = paths.next(skew_join(steps, wanted, [*KEYS, "destination"], "left_semi"), "first")
    while frontier is not None:
        paths.keep(skew_join(frontier, made, [*KEYS, "origin"], "left_anti"))
        moved = skew_join(frontier.withColumnRenamed("origin", "_at"), back, [*KEYS, "_at"])
        frontier = paths.next(moved.select(*KEYS, F.col("_from").alias("origin"), "destination", (F.col("weight") * F.col("_w")).alias("weight")), "paths")
    return paths.summed(union_all(paths.found or [steps.limit(0)]))


def with_expression(results: DataFrame, contributions: DataFrame, terms: int = 5, digits: int = 6) -> DataFrame:
    """Adds ``expression``: of a computed value in force the weighted sum it was made by, as ``weight*origin + ...``; null for others.

    The ``terms`` largest quantities are named, equal ones in the order of their names; what remains is told by its number and its sum, as in ``+ 12
    more (3.5)``. The full sums are the table of contributions. Rows beyond the ``terms`` first ones are left out before the shuffle.
    """
    group = [*KEYS, "destination"]
    rows = contributions.groupBy(*group, "origin").agg(F.sum("weight").alias("weight"), F.sum("quantity").alias("quantity"))
    rows = Scratch(results.sparkSession, "expression").save(rows, "terms")
    order = W.partitionBy(*group).orderBy(F.abs("quantity").desc_nulls_last(), "origin")
    first = rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= terms)
    text = F.concat(F.round("weight", digits).cast("string"), F.lit("*"), "origin")
    named = first.groupBy(*group).agg(  # at most ``terms`` rows each
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", text.alias("t")))), lambda x: x["t"]), " + ").alias("_text"),
        F.sum("quantity").alias("_named"),
    )
    whole = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum("quantity").alias("_all"))
    rest = F.concat(
        F.lit(" + "), (F.col("_n") - terms).cast("string"), F.lit(" more ("), F.round(F.col("_all") - F.col("_named"), digits).cast("string"), F.lit(")")
    )
    made = named.join(whole, group).select(
        *KEYS, F.col("destination").alias("node"), F.concat("_text", F.when(F.col("_n") > terms, rest).otherwise("")).alias("_expression")
    )
    in_force = F.col("computed")
    if "conflict" in results.columns:
        in_force = in_force & (F.col("conflict") != "Dismissed")
    return skew_join(results, made, [*KEYS, "node"], "left").withColumn("expression", F.when(in_force, F.col("_expression"))).drop("_expression")
