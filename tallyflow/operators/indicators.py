"""Indicators, benchmarks, matrices (I-*, J-10..J-12, J-14, A-16, A-17, M-01, M-04, Q-13).

Results are long rows (scenario, period, scope, processor, interface, orientation, value);
``interface`` holds the interface type.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.scalar import in_interval
from tallyflow.operators.filters import select_results
from tallyflow.functions.formulas import names_in
from tallyflow.operators.scenarios import parameter_maps
from tallyflow.runtime import skew_join, union_all

LOCAL_KEYS = ["scenario", "period", "scope", "processor"]


# -- local indicators -------------------------------------------------------------------
def local_indicators(
    results: DataFrame, formulas: Mapping[str, str], params: DataFrame | None = None, keys: Sequence[str] = LOCAL_KEYS
) -> DataFrame:
    """(keys, indicator, value) of SQL formulas over ``<type>``, ``<type>_<orientation>`` and
    parameters; parameters win. A formula that cannot be computed gives no row.

    All formulas are computed in one pass: the variables they use are picked by conditional
    aggregates (one shuffle), never by a general pivot. ``<type>`` takes the first row of that
    type in orientation order, ``<type>_<orientation>`` the last one.
    """
    keys = list(keys)
    used = sorted(set().union(*[names_in(f) for f in formulas.values()]))
    known = set()
    maps = None
    if params is not None:
        maps = parameter_maps(params)
        names = [r["n"] for r in params.select(F.lower("name").alias("n")).distinct().collect()]  # declared
        known = set(names)
    iface, orient = F.lower("interface"), F.lower("orientation")
    wanted = [u for u in used if u not in known]
    relevant = iface.isin(wanted) | F.concat_ws("_", iface, orient).isin(wanted)
    order = [c for c in ("interface_name",) if c in results.columns]
    sort_key = F.struct("orientation", *order)
    picked = {}
    for u in wanted:
        is_type, is_oriented = iface == u, F.concat_ws("_", iface, orient) == u
        first = F.min_by("value", F.when(is_type, sort_key))
        last = F.max_by("value", F.when(is_oriented, sort_key))
        picked[u] = F.coalesce(last, first)
    rows = results.filter(relevant).groupBy(*keys).agg(*[e.alias(u) for u, e in picked.items()])
    if maps is not None:
        rows = rows.join(maps, "scenario", "left")
        rows = rows.withColumns({u: F.element_at("vars", F.lit(u)) for u in used if u in known}).drop("vars")
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("indicator"), F.expr(f).try_cast("double").alias("value"))
            for n, f in formulas.items()
        ]
    )
    return (
        rows.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*").filter("value is not null")
    )


def characterize(
    values: DataFrame, methods: DataFrame, keys: Sequence[str] = LOCAL_KEYS, indicators: Sequence[str] | None = None
) -> DataFrame:
    """Weighted sum of interface values per (indicator, method, horizon); no match gives 0.

    ``methods(method, indicator, horizon, interface, coefficient)``. The indicator is named
    ``<indicator>_<method>_<horizon>``.
    """
    keys = list(keys)
    if indicators:
        methods = methods.filter(F.col("indicator").isin(list(indicators)))
    named = methods.select(
        F.concat_ws("_", "indicator", "method", "horizon").alias("indicator"),
        F.lower("interface").alias("_i"),
        F.col("coefficient").cast("double").alias("coefficient"),
    )
    labels = [r["indicator"] for r in named.select("indicator").distinct().orderBy("indicator").collect()]  # declared
    rows = skew_join(values.withColumn("_i", F.lower("interface")), named, ["_i"], "left")
    term = F.col("value") * F.col("coefficient")
    sums = rows.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("indicator") == n, term)), F.lit(0.0)).alias(f"_s{i}") for i, n in enumerate(labels)]
    )
    cells = F.array(
        *[F.struct(F.lit(n).alias("indicator"), F.col(f"_s{i}").alias("value")) for i, n in enumerate(labels)]
    )
    return sums.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


# -- global indicators ------------------------------------------------------------------
def global_indicators(
    results: DataFrame,
    definitions: Mapping[str, tuple[Mapping[str, Column], str]],
    params: DataFrame | None = None,
    keys: Sequence[str] = ("scenario", "period"),
) -> DataFrame:
    """(keys, indicator, value) per scenario and period.

    A definition is (named whole-case aggregates, SQL formula over those names and parameters);
    build the aggregates with ``functions.aggregates.case_aggregate``. All of them share one
    pass over the results.
    """
    keys = list(keys)
    aggs, formulas = [], {}
    for i, (name, (cols, formula)) in enumerate(definitions.items()):
        aggs += [c.alias(f"_a{i}_{n}") for n, c in cols.items()]
        formulas[name] = (i, list(cols), formula)
    rows = results.groupBy(*keys).agg(*aggs)
    if params is not None:
        rows = rows.join(parameter_maps(params), "scenario", "left")
        names = [r["n"] for r in params.select(F.lower("name").alias("n")).distinct().collect()]  # declared
        used = set().union(*[names_in(f) for _, _, f in formulas.values()])
        rows = rows.withColumns({n: F.element_at("vars", F.lit(n)) for n in names if n in used}).drop("vars")
    frames = []
    for name, (i, cols, formula) in formulas.items():
        one = rows.withColumnsRenamed({f"_a{i}_{c}": c for c in cols})
        frames.append(one.select(*keys, F.lit(name).alias("indicator"), F.expr(formula).try_cast("double").alias("value")))
    return union_all(frames).filter("value is not null")


# -- benchmarks -------------------------------------------------------------------------
def frame_benchmarks(
    indicators: DataFrame, links: DataFrame, ranges: DataFrame
) -> DataFrame:
    """Category of every indicator value in each of its benchmarks.

    ``links(indicator, benchmark)``, ``ranges(benchmark, ord, lo, lo_incl, hi, hi_incl, category)``.
    The first declared range that holds the value wins, else ``<out (v)>``. The ranges of a
    benchmark travel as one array (a benchmark is a short declared scale), so values are not
    multiplied by ranges. Indicators without benchmark give no row.
    """
    scale = ranges.groupBy("benchmark").agg(
        F.array_sort(F.collect_list(F.struct("ord", "lo", "lo_incl", "hi", "hi_incl", "category"))).alias("_ranges")
    )
    rows = skew_join(indicators, links, ["indicator"])
    rows = skew_join(rows, scale, ["benchmark"], "left")
    v = F.col("value")
    hit = F.filter(
        F.coalesce("_ranges", F.array()),
        lambda r: in_interval(v, r["lo"], r["lo_incl"], r["hi"], r["hi_incl"]),
    )
    return rows.withColumn(
        "category",
        F.coalesce(F.get(hit, F.lit(0))["category"], F.concat(F.lit("<out ("), v.cast("string"), F.lit(")>"))),
    ).drop("_ranges")


def benchmark_stakeholders(benchmarks: DataFrame) -> DataFrame:
    """One row per benchmark and stakeholder; ``stakeholders`` is comma-separated text or an array."""
    col = F.col("stakeholders")
    if dict(benchmarks.dtypes)["stakeholders"] == "string":
        col = F.transform(F.split(col, ","), lambda s: F.trim(s))
    return benchmarks.select("benchmark", F.explode(col).alias("stakeholder")).filter("stakeholder <> ''")


# -- matrices ---------------------------------------------------------------------------
def matrix(
    results: DataFrame,
    columns: Sequence[tuple[str, str]],
    indicators: DataFrame | None = None,
    indicator_names: Sequence[str] = (),
    scope: str | None = None,
    processors: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Wide matrix: mean value per (interface, orientation) plus mean of each indicator.

    Rows are (scenario, period, processor[, scope]). ``columns`` are the (interface,
    orientation) pairs wanted; columns are named ``<interface> <orientation>``. Interface and
    indicator rows are stacked and aggregated together, which equals their outer join with one
    shuffle less.
    """
    keys = ["scenario", "period", "processor"] + (["scope"] if scope else [])
    cols = {f"{i} {o}": (F.lower("interface") == i.lower()) & (F.lower("orientation") == o.lower()) for i, o in columns}
    picked = select_results(results, scope, processors, sorted({i for i, _ in columns}))
    picked = picked.select(*keys, "interface", "orientation", "value")
    if indicators is not None and indicator_names:
        extra = select_results(indicators, scope, processors, indicators=indicator_names)
        picked = picked.unionByName(extra.select(*keys, "indicator", "value"), allowMissingColumns=True)
        cols |= {n: F.lower("indicator") == n.lower() for n in indicator_names}
    wanted = None
    for c in cols.values():
        wanted = c if wanted is None else (wanted | c)
    return (
        picked.filter(F.coalesce(wanted, F.lit(False)))
        .groupBy(*keys)
        .agg(*[F.avg(F.when(c, F.col("value"))).alias(n) for n, c in cols.items()])
    )


# -- intensive to extensive -------------------------------------------------------------
def to_extensive(flows: DataFrame, funds: DataFrame, units: DataFrame) -> DataFrame:
    """Flows per unit of a fund, multiplied by the fund.

    ``flows(node, flow, value, unit)`` with units such as ``kg/ha``; ``funds(node, value, unit)``;
    ``units(from, to, ratio)`` converts the fund unit to the denominator. Flows whose
    denominator is not convertible are left alone.
    """
    num, den = F.trim(F.substring_index("unit", "/", 1)), F.trim(F.substring_index("unit", "/", -1))
    rows = skew_join(
        flows.withColumn("_num", num).withColumn("_den", F.when(F.col("unit").contains("/"), den)),
        funds.select("node", F.col("value").alias("_fund"), F.col("unit").alias("_fund_unit")),
        ["node"],
        "left",
    )
    ratio = units.select(F.col("from").alias("_fund_unit"), F.col("to").alias("_den"), F.col("ratio").alias("_ratio"))
    rows = rows.join(ratio, ["_fund_unit", "_den"], "left")
    factor = F.col("_fund") * F.when(F.col("_fund_unit") == F.col("_den"), F.lit(1.0)).otherwise(F.col("_ratio"))
    return rows.select(
        *[c for c in flows.columns if c not in ("value", "unit")],
        F.coalesce(F.col("value") * factor, F.col("value")).alias("value"),
        F.when(factor.isNotNull(), F.col("_num")).otherwise(F.col("unit")).alias("unit"),
        F.when(factor.isNotNull(), F.col("value")).alias("value_intensive"),
        F.when(factor.isNotNull(), F.col("unit")).alias("unit_intensive"),
    )


