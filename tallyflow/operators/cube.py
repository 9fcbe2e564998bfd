"""Cube queries: group, aggregate, densify, pivot, describe, label (A-*, J-06, K-04, K-05, S-16, W-05)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyflow.functions.aggregates import CUBE_AGGREGATES, PIVOT_AGGREGATES
from tallyflow.operators.dictionary import CodeDictionary
from tallyflow.operators.filters import filter_dims, filter_mapped, filter_periods, resolve_column
from tallyflow.operators.mapping import apply_mappings
from tallyflow.runtime import ROWS_PER_TASK, small_table, union_all

PIVOT_CELL_LIMIT = 40_000  # fixed value: guard on the size of a pivot shown to a user


# -- roles ------------------------------------------------------------------------------
def with_roles(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Record dimension / measure / attribute / time roles in the column metadata."""
    return df.select(
        *[F.col(c).alias(c, metadata={"role": roles[c]}) if c in roles else F.col(c) for c in df.columns]
    )


def role_of(field: T.StructField) -> str:
    return field.metadata.get("role") or (
        "measure" if isinstance(field.dataType, T.NumericType) else "dimension"
    )


def describe_cube(df: DataFrame) -> DataFrame:
    """One row per concept: name, role, type, number of codes of a dimension; a time dimension
    adds StartPeriod / EndPeriod."""
    rows = [(f.name, role_of(f), f.dataType.simpleString()) for f in df.schema.fields]
    dims = [r[0] for r in rows if r[1] in ("dimension", "time")]
    if any(r[1] == "time" for r in rows):
        rows += [("StartPeriod", "time", "string"), ("EndPeriod", "time", "string")]
    concepts = small_table(df.sparkSession, rows, "concept string, role string, data_type string")
    if not dims:
        return concepts.withColumn("codes", F.lit(None).cast("long"))
    counts = code_lists(df, dims).groupBy("concept").agg(F.count(F.lit(1)).alias("codes"))
    return concepts.join(counts, "concept", "left")


def code_lists(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Distinct non-null codes of each dimension as (concept, code), in one pass over the data."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(d).alias("concept"), F.col(d).cast("string").alias("code")) for d in dims])
    ).alias("_p")
    return df.select(pairs).select("_p.concept", "_p.code").filter("code is not null").distinct()


def distinct_tuples(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    return df.select(*dims).distinct()


# -- query ------------------------------------------------------------------------------
def pair_aggregates(
    measures: Sequence[str], aggs: Sequence[str], names: Sequence[str] | None
) -> list[tuple[str, str, str]]:
    """(measure, aggregate, output name): as many aggregates as measures are zipped, otherwise
    every aggregate is applied to every measure; none means ``avg``."""
    aggs = list(aggs) or ["avg"]
    if len(aggs) == len(measures):
        chosen = list(zip(measures, aggs))
        given = list(names) if names and len(names) == len(measures) else [None] * len(chosen)
    else:
        chosen = [(m, a) for m in measures for a in aggs]
        given = list(names) if names and len(names) == len(chosen) else [None] * len(chosen)
    return [(m, a, n or f"{m}_{a.lower()}") for (m, a), n in zip(chosen, given)]


def query_cube(
    df: DataFrame,
    where: Mapping[str, Sequence] | None = None,
    group_by: Sequence[str] = (),
    measures: Sequence[str] = (),
    aggs: Sequence[str] = (),
    names: Sequence[str] | None = None,
    mapping: DataFrame | None = None,
    pairs: Sequence[tuple[str, str]] = (),
    period: str = "period",
    warnings: list[str] | None = None,
    dictionary: CodeDictionary | None = None,
) -> DataFrame:
    """Filter, re-code, group, aggregate and rename, as one lazy plan (with a ``dictionary``, codes are looked up there at once).

    ``where`` may name native dimensions, mapped dimensions of ``pairs`` and
    StartPeriod / EndPeriod. Rows with a NULL group key are dropped. Without ``group_by`` the
    filtered and re-coded rows are returned.
    """
    warnings = warnings if warnings is not None else []
    where = dict(where or {})
    low = {k.lower(): k for k in where}
    start = where.pop(low["startperiod"]) if "startperiod" in low else None
    end = where.pop(low["endperiod"]) if "endperiod" in low else None
    first = lambda v: v[0] if isinstance(v, (list, tuple)) else v
    if start is not None:
        df = filter_periods(df, first(start), first(end) if end is not None else None, period)
    native = {k: v for k, v in where.items() if resolve_column(df, k)}
    df = filter_dims(df, native, dictionary=dictionary)
    for dim, codes in where.items():
        via = next((p for p in pairs if p[1].lower() == dim.lower()), None)
        if dim not in native and via and codes:
            df = filter_mapped(df, mapping, via[0], via[1], codes, dictionary)
    if pairs:
        df = apply_mappings(df, mapping, measures, pairs)
    if not group_by:
        return df
    keys = []
    for dim in group_by:
        name = resolve_column(df, dim)
        fixed = next((v for k, v in where.items() if k.lower() == dim.lower()), None)
        if name is None and fixed is not None and len(fixed) == 1:
            df, name = df.withColumn(dim, F.lit(fixed[0])), dim
        if name is None:
            warnings.append(f"dimension {dim} is not in the data and was removed from the grouping")
        else:
            keys.append(name)
    if not aggs:
        warnings.append("no aggregate given, avg assumed")
    chosen = pair_aggregates([resolve_column(df, m) or m for m in measures], aggs, names)
    return (
        df.dropna(subset=keys)
        .groupBy(*keys)
        .agg(*[CUBE_AGGREGATES[a.lower()](F.col(m).cast("double")).alias(n) for m, a, n in chosen])
    )


# -- densify ----------------------------------------------------------------------------
def code_grid(lists: Sequence[DataFrame]) -> DataFrame:
    """All combinations of the rows of several tables, the longest first.

    The result is the full grid by definition. It is built as equi-joins on a block number,
    so that both sides stay distributed: left codes are spread over blocks, right codes are
    repeated once per block. There are as many blocks as keep the cells of one at ``ROWS_PER_TASK``.
    """
    grid = lists[0]
    for right in lists[1:]:
        rows, width = grid.count(), right.count()
        blocks = max(1, min(rows, -(-rows * width // ROWS_PER_TASK)))
        plain = [c for c, t in grid.dtypes if "map<" not in t]
        left = grid.withColumn("_b", F.pmod(F.xxhash64(*(plain or [F.lit(0)])), F.lit(blocks)).cast("long"))
        right = right.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        grid = left.join(right, "_b").drop("_b")
    return grid


def densify(df: DataFrame, dims: Sequence[str], codes: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Every combination of the selected codes; cells without data have NULL measures.

    Dimensions without given codes use the codes present in the data. Rows of the data outside
    the selected codes are left out.
    """
    codes = dict(codes or {})
    spark = df.sparkSession
    kept = filter_dims(df, {d: codes[d] for d in codes}, case_sensitive=True)
    lists = []
    for d in dims:
        field = df.schema[d]
        if codes.get(d):
            lists.append(small_table(spark, [(c,) for c in codes[d]], T.StructType([T.StructField(d, field.dataType)])))
        else:
            lists.append(df.select(d).filter(F.col(d).isNotNull()).distinct())
    rest = [c for c in df.columns if c not in dims]
    return code_grid(lists).join(kept, list(dims), "left").select(*dims, *rest)


# -- pivots -----------------------------------------------------------------------------
def pivot_size(df: DataFrame, rows: Sequence[str], cols: Sequence[str], n_values: int = 1) -> DataFrame:
    """Cells of the pivot and whether it is over the display limit."""
    r = df.select(*rows).distinct().agg(F.count(F.lit(1)).alias("n_rows")).withColumn("_k", F.lit(1))
    c = df.select(*cols).distinct().agg(F.count(F.lit(1)).alias("n_cols")).withColumn("_k", F.lit(1))
    return r.join(c, "_k").select(
        "n_rows",
        "n_cols",
        (F.col("n_rows") * F.col("n_cols") * n_values).alias("cells"),
        (F.col("n_rows") * F.col("n_cols") * n_values > PIVOT_CELL_LIMIT).alias("too_large"),
    )


def pivot_table(
    df: DataFrame,
    rows: Sequence[str],
    col: str,
    col_values: Sequence,
    value: str,
    aggs: Sequence[str],
    totals: bool = False,
) -> DataFrame:
    """Wide pivot with the column values given; ``totals`` adds a ``Total`` row and column.

    The totals come from the same pass: rows are expanded to the grand-total groupings by
    ``GROUPING SETS`` before the aggregation, never from already rounded cells.
    """
    data = df.filter(F.col(col).isin(list(col_values)))
    fns = lambda: [PIVOT_AGGREGATES[a](F.col(value)).alias(a) for a in aggs]
    if not totals:
        wide = data.groupBy(*rows).pivot(col, list(col_values)).agg(*fns())
        return wide.withColumnsRenamed({str(v): f"{v}_{aggs[0]}" for v in col_values}) if len(aggs) == 1 else wide
    keys = [F.col(r).cast("string").alias(r) for r in rows] + [F.col(col).cast("string").alias(col)]
    base = data.select(*keys, F.col(value))
    sets = [list(rows) + [col], list(rows), [col], []]
    cubed = base.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*rows, col)]).agg(
        *fns(), *[F.grouping(c).alias(f"_g_{c}") for c in (*rows, col)]
    )
    for c in (*rows, col):
        cubed = cubed.withColumn(c, F.when(F.col(f"_g_{c}") == 1, F.lit("Total")).otherwise(F.col(c)))
    names = [str(v) for v in col_values] + ["Total"]
    cells = {f"{n}_{a}": F.max(F.when(F.col(col) == n, F.col(a))) for n in names for a in aggs}
    return cubed.groupBy(*rows).agg(*[e.alias(n) for n, e in cells.items()])


# -- labels and metadata ----------------------------------------------------------------
def add_labels(df: DataFrame, labels: DataFrame, dataset: str, cols: Sequence[str]) -> DataFrame:
    """Append ``<col>_desc`` from ``labels(hierarchy, code, label)``.

    The hierarchy ``<dataset>_<col>`` is looked up first, then ``<col>``.
    """
    out = df
    for c in cols:
        specific, general = f"{dataset}_{c}".lower(), c.lower()
        side = (
            labels.filter(F.lower("hierarchy").isin(specific, general))
            .groupBy(F.lower("code").alias("_code"))
            .agg(F.min_by("label", F.when(F.lower("hierarchy") == specific, 0).otherwise(1)).alias(f"{c}_desc"))
        )
        out = out.withColumn("_code", F.lower(F.col(c).cast("string"))).join(side, "_code", "left").drop("_code")
    return out


def structure_codes(df: DataFrame) -> DataFrame:
    """One row per code of every dimension, with the place of the dimension."""
    place = concepts_table(df).select("position", "concept", "role")
    dims = [f.name for f in df.schema.fields if role_of(f) in ("dimension", "time")]
    return code_lists(df, dims).join(place, "concept").select("position", "concept", "role", "code")


def concepts_table(df: DataFrame) -> DataFrame:
    """One row per column with its place in a structure definition."""
    place = {"dimension": "Dimension", "time": "TimeDimension", "measure": "Measure", "attribute": "Attribute"}
    rows = [(i, f.name, place[role_of(f)]) for i, f in enumerate(df.schema.fields)]
    return small_table(df.sparkSession, rows, "position int, concept string, role string")


def usage_matrix(datasets: Mapping[str, DataFrame], dim: str) -> DataFrame:
    """Dataset x code table of the codes of one dimension: one row per code, a flag per dataset."""
    seen = union_all(
        [
            d.select(F.lit(n).alias("dataset"), F.col(dim).cast("string").alias("code")).distinct()
            for n, d in datasets.items()
        ]
    )
    flags = [F.max(F.when(F.col("dataset") == n, 1).otherwise(0)).alias(n) for n in datasets]
    return seen.filter("code is not null").groupBy("code").agg(*flags)


def column_usage(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """Dataset x column table."""
    names = sorted({c for d in datasets.values() for c in d.columns})
    spark = next(iter(datasets.values())).sparkSession
    rows = [(n, *[int(n in d.columns) for d in datasets.values()]) for n in names]
    return small_table(spark, rows, ", ".join(["`column` string"] + [f"`{n}` int" for n in datasets]))


# -- fill down --------------------------------------------------------------------------
def fill_down(
    df: DataFrame, cols: Sequence[str], order: str, group: Sequence[str] = (), block: int = 65_536
) -> DataFrame:
    """Replace blanks by the last non-blank value above, in ``order`` (a whole-number row position).

    Rows are cut in blocks of ``block`` positions. Each block is filled on its own, then the
    last value of every block is handed to the following ones by the same operator on the
    (much shorter) block table, so that no task holds a whole sheet.
    """
    group = list(group)
    blk = f"_{order}_block"
    clean = {c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)) for c in cols}
    rows = df.withColumns(clean).withColumn(blk, F.floor(F.col(order) / block))
    inside = W.partitionBy(*group, blk).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in cols})
    tails = rows.groupBy(*group, blk).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols]
    )
    span = tails.agg((F.max(blk) - F.min(blk)).alias("s")).first()["s"]
    if span is None or span == 0:
        return rows.drop(blk).select(*df.columns)
    if span >= block:
        tails = fill_down(tails, cols, blk, group, block)
    else:
        upto = W.partitionBy(*group).orderBy(blk).rowsBetween(W.unboundedPreceding, 0)
        tails = tails.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in cols})
    # blocks can be absent, so the carried value is looked up over the blocks that exist
    following = W.partitionBy(*group).orderBy(blk)
    carried = tails.select(
        *group, F.lead(blk).over(following).alias(blk), *[F.col(c).alias("_c_" + c) for c in cols]
    ).filter(F.col(blk).isNotNull())
    return (
        rows.join(carried, group + [blk], "left")
        .withColumns({c: F.coalesce(F.col(c), F.col("_c_" + c)) for c in cols})
        .select(*df.columns)
    )
