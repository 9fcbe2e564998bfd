"""Data checks (V-*). Each returns issues(level, rule, key, message)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.scalar import attribute_type, in_interval, parse_interval, period_kind
from tallyflow.operators.cube import pivot_size
from tallyflow.runtime import small_table

ISSUES = "level string, rule string, key string, message string"


def issue(level: str, rule: str, key: Column, message: Column) -> list[Column]:
    return [
        F.lit(level).alias("level"),
        F.lit(rule).alias("rule"),
        key.cast("string").alias("key"),
        message.cast("string").alias("message"),
    ]


def _key(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def duplicate_keys(df: DataFrame, keys: Sequence[str], rule: str = "duplicate key") -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select(*issue("error", rule, _key(keys), F.concat(F.col("_n").cast("string"), F.lit(" rows"))))
    )


def unknown_codes(values: DataFrame, col: str, codes: DataFrame, rule: str = "code not in code list") -> DataFrame:
    """Distinct values of ``col`` absent from ``codes(code)``, ignoring case."""
    known = codes.select(F.lower("code").alias("_k")).distinct()
    return (
        values.select(F.col(col).cast("string").alias("_v"))
        .filter("_v is not null")
        .distinct()
        .withColumn("_k", F.lower("_v"))
        .join(known, "_k", "left_anti")
        .select(*issue("error", rule, F.col("_v"), F.lit("not found")))
    )


def unknown_columns(df: DataFrame, dims: Sequence[str], measures: Sequence[str]) -> DataFrame:
    have = {c.lower() for c in df.columns}
    rows = [("error", "unknown dimension", d, "not in the dataset") for d in dims if d.lower() not in have]
    rows += [("error", "unknown measure", m, "not in the dataset") for m in measures if m.lower() not in have]
    return small_table(df.sparkSession, rows, ISSUES)


def mandatory_fields(df: DataFrame, rules: Mapping[str, str | None], key: Sequence[str]) -> DataFrame:
    """Fields that must be filled; a rule is a SQL condition under which the field is mandatory."""
    checks = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f).isNull() & (F.coalesce(F.expr(cond), F.lit(False)) if cond else F.lit(True)), F.lit(f)
                )
                for f, cond in rules.items()
            ]
        )
    )
    return df.select(_key(key).alias("_k"), F.explode(checks).alias("_f")).select(
        *issue("error", "mandatory field", F.col("_k"), F.col("_f"))
    )


def allowed_values(df: DataFrame, allowed: Mapping[str, Sequence[str]], key: Sequence[str]) -> DataFrame:
    checks = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.lower(F.col(f).cast("string")).isin([v.lower() for v in values]),
                    F.concat(F.lit(f + "="), F.col(f).cast("string")),
                )
                for f, values in allowed.items()
            ]
        )
    )
    return df.select(_key(key).alias("_k"), F.explode(checks).alias("_f")).select(
        *issue("error", "value not allowed", F.col("_k"), F.col("_f"))
    )


def parameter_domain(params: DataFrame, codes: DataFrame) -> DataFrame:
    """Number parameters outside their interval, Code parameters outside their hierarchy.

    ``params(name, type, domain, value)``, ``codes(hierarchy, code)``.
    """
    typed = params.withColumn("_i", parse_interval(F.col("domain"))).withColumn("_v", F.col("value").try_cast("double"))
    inside = in_interval(F.col("_v"), F.col("_i.lo"), F.col("_i.lo_incl"), F.col("_i.hi"), F.col("_i.hi_incl"))
    numbers = typed.filter((F.lower("type") == "number") & F.col("_i").isNotNull() & ~F.coalesce(inside, F.lit(False)))
    known = codes.select(F.lower("hierarchy").alias("_h"), F.lower("code").alias("_c")).distinct()
    coded = (
        typed.filter((F.lower("type") == "code") & F.col("domain").isNotNull())
        .withColumn("_h", F.lower("domain"))
        .withColumn("_c", F.lower("value"))
        .join(known, ["_h", "_c"], "left_anti")
    )
    cols = issue("error", "value outside domain", F.col("name"), F.concat_ws(" not in ", "value", "domain"))
    return numbers.select(*cols).unionByName(coded.select(*cols))


def mixed_periods(df: DataFrame, period: str) -> DataFrame:
    """Periods must be all years or all months; unreadable periods are errors too."""
    kinds = df.select(F.col(period).alias("_p")).distinct().withColumn("_kind", period_kind(F.col("_p")))
    bad = kinds.filter("_kind is null").select(*issue("error", "invalid period", F.col("_p"), F.lit("not a period")))
    family = F.when(F.col("_kind").like("%year%"), "year").when(F.col("_kind").like("%month%"), "month")
    mixed = (
        kinds.agg(F.count_distinct(family).alias("_n"), F.array_sort(F.collect_set(family)).alias("_f"))
        .filter("_n > 1")
        .select(*issue("error", "mixed period kinds", F.array_join("_f", ","), F.col("_n").cast("string")))
    )
    return bad.unionByName(mixed)


def repeated_observations(obs: DataFrame, node: Sequence[str] = ("node",)) -> DataFrame:
    """Two observations of one interface with the same time and observer."""
    keyed = obs.withColumn("observer", F.lower(F.coalesce("observer", F.lit("")))).withColumn(
        "period", F.lower("period")
    )
    return duplicate_keys(keyed, [*node, "period", "observer"], "repeated observation")


def attribute_types(df: DataFrame, col: str, expected: str, key: Sequence[str]) -> DataFrame:
    """Attribute values whose inferred type is not the expected one (an Integer is also a Float)."""
    kind = attribute_type(F.col(col).cast("string"))
    wider = {"Float": ["Float", "Integer"], "String": None}.get(expected, [expected])
    if wider is None:
        return df.limit(0).select(*issue("error", "attribute type", F.lit(""), F.lit("")))
    return df.filter(F.col(col).isNotNull() & ~kind.isin(wider)).select(
        *issue("error", "attribute type", _key(key), F.concat(F.lit("found "), kind))
    )


def flow_orientation(flows: DataFrame, interfaces: DataFrame, part_of: DataFrame) -> DataFrame:
    """A flow leaves an Output and enters an Input; equal orientations only between parent and child.

    ``flows(src, dst)`` and ``interfaces(node, processor, orientation)``, ``part_of(parent, child)``.
    """
    side = lambda end: interfaces.select(
        F.col("node").alias(end), F.col("processor").alias(f"_p_{end}"), F.lower("orientation").alias(f"_o_{end}")
    )
    joined = flows.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")
    kin = part_of.select(F.col("parent").alias("_parent"), F.col("child").alias("_child"), F.lit(True).alias("_kin"))
    same = F.col("_o_src") == F.col("_o_dst")
    upward = F.col("_o_src") == "output"
    joined = joined.withColumn(
        "_parent", F.when(same, F.when(upward, F.col("_p_dst")).otherwise(F.col("_p_src")))
    ).withColumn("_child", F.when(same, F.when(upward, F.col("_p_src")).otherwise(F.col("_p_dst"))))
    joined = joined.join(kin.distinct(), ["_parent", "_child"], "left")
    message = F.when(same & F.col("_kin").isNull(), F.lit("same orientation but not parent and child")).when(
        ~same & (F.col("_o_src") != "output"), F.lit("source orientation must be output")
    )
    return joined.withColumn("_m", message).filter("_m is not null").select(
        *issue("error", "flow orientation", F.concat_ws(" -> ", "src", "dst"), F.col("_m"))
    )


# The sources a computed value can come from.
COMPUTATION_SOURCES = ("Flow", "Scale", "ScaleChange", "PartOfAggregation", "InterfaceTypeAggregation")


def source_priority(names: Sequence[str]) -> list[str]:
    """Problems of a source priority list: it must hold every source exactly once."""
    found = []
    found += [f"unknown source {n}" for n in names if n not in COMPUTATION_SOURCES]
    found += [f"missing source {n}" for n in COMPUTATION_SOURCES if n not in names]
    found += [f"repeated source {n}" for n in dict.fromkeys(names) if list(names).count(n) > 1]
    return found


def missing_refs(df: DataFrame, col: str, known: DataFrame, known_col: str, rule: str = "reference not found") -> DataFrame:
    """Distinct references without a target."""
    have = known.select(F.lower(F.col(known_col).cast("string")).alias("_k")).distinct()
    return (
        df.select(F.col(col).cast("string").alias("_v"))
        .filter("_v is not null")
        .distinct()
        .withColumn("_k", F.lower("_v"))
        .join(have, "_k", "left_anti")
        .select(*issue("warning", rule, F.col("_v"), F.lit("not declared")))
    )


def ambiguous_names(matches: DataFrame) -> DataFrame:
    """Names resolved to no object or to several (output of ``resolve_names``)."""
    return matches.filter("matches <> 1").select(
        *issue(
            "error",
            "ambiguous or unknown name",
            F.col("name"),
            F.concat(F.col("matches").cast("string"), F.lit(" matches")),
        )
    )


def pivot_too_large(df: DataFrame, rows: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return pivot_size(df, rows, cols).filter("too_large").select(
        *issue("error", "pivot too large", F.lit(",".join([*rows, *cols])), F.col("cells").cast("string"))
    )


def behave_as_gaps(behave_as: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Interfaces of the BehaveAs processor that the child lacks.

    ``behave_as(parent, child, behave_as)``, ``interfaces(processor, interface)``.
    """
    wanted = behave_as.join(
        interfaces.select(F.col("processor").alias("behave_as"), "interface"), "behave_as"
    )
    have = interfaces.select(F.col("processor").alias("child"), "interface")
    return wanted.join(have, ["child", "interface"], "left_anti").select(
        *issue("error", "behave-as interface missing", F.concat_ws(":", "child", "interface"), F.col("behave_as"))
    )
