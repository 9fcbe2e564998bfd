"""Code mappings between dimensions (J-01..J-05, J-20, A-20).

``mapping(origin_dim, origin_code, dest_dim, dest_code, weight)``; an absent weight is 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.runtime import POSITION, declared_first, skew_join

MAPPING_KEY = ["origin_dim", "origin_code", "dest_dim", "dest_code"]


def build_mapping(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mapping table and the repeated (origin, destination) pairs, compared ignoring case: the first declaration counts."""
    place = [POSITION] if POSITION in rows.columns else []
    keyed = rows.select(
        *[F.lower(c).alias("_" + c) for c in MAPPING_KEY], *MAPPING_KEY, F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"), *place
    )
    counted = declared_first(keyed, ["_" + c for c in MAPPING_KEY])
    repeated = counted.filter("_n > 1").select(
        F.lit("error").alias("level"),
        F.lit("repeated mapping").alias("rule"),
        F.concat_ws(" -> ", "origin_code", "dest_code").alias("key"),
        F.concat(F.col("_n").cast("string"), F.lit(" declarations")).alias("message"),
    )
    return counted.select(*MAPPING_KEY, "weight"), repeated


def mapped_pairs(mapping: DataFrame) -> list[tuple[str, str]]:
    """(origin, destination) dimensions of the table: one entry per declared mapping."""
    rows = mapping.select("origin_dim", "dest_dim").distinct().collect()
    return sorted((r["origin_dim"], r["dest_dim"]) for r in rows)


def complete_mapping(mapping: DataFrame, codes: DataFrame, origin_dim: str, dest_dim: str) -> DataFrame:
    """Add ``codes(code)`` that the mapping leaves out, to the placeholder '' with weight 1."""
    one = mapping.filter((F.lower("origin_dim") == origin_dim.lower()) & (F.lower("dest_dim") == dest_dim.lower()))
    known = one.select(F.lower("origin_code").alias("_k")).distinct()
    missing = (
        codes.select(F.col("code").cast("string").alias("origin_code"))
        .distinct()
        .withColumn("_k", F.lower("origin_code"))
        .join(known, "_k", "left_anti")
        .select(
            F.lit(origin_dim).alias("origin_dim"),
            "origin_code",
            F.lit(dest_dim).alias("dest_dim"),
            F.lit("").alias("dest_code"),
            F.lit(1.0).alias("weight"),
        )
    )
    return one.select(*MAPPING_KEY, F.coalesce("weight", F.lit(1.0)).alias("weight")).unionByName(missing)


def apply_mappings(
    df: DataFrame,
    mapping: DataFrame,
    measures: Sequence[str],
    pairs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Weighted many-to-many re-coding.

    Each row becomes the product of the destinations of its codes over all mapped dimensions
    and its measures are multiplied by the product of the weights. A code without a mapping
    goes to the placeholder '' with weight 1. One join per mapped dimension; hot codes are
    spread over tasks.
    """
    pairs = list(pairs) if pairs is not None else mapped_pairs(mapping)
    factor = F.lit(1.0)
    out = df
    for i, (origin, dest) in enumerate(pairs):
        side = mapping.filter(
            (F.lower("origin_dim") == origin.lower()) & (F.lower("dest_dim") == dest.lower())
        ).select(
            F.lower("origin_code").alias("_code"),
            F.col("dest_code").alias(dest),
            F.coalesce(F.col("weight"), F.lit(1.0)).alias(f"_w{i}"),
        )
        out = skew_join(out.withColumn("_code", F.lower(F.col(origin).cast("string"))), side, ["_code"], "left")
        out = out.withColumn(dest, F.coalesce(F.col(dest), F.lit(""))).drop("_code")
        factor = factor * F.coalesce(F.col(f"_w{i}"), F.lit(1.0))
    out = out.withColumns({m: F.col(m).cast("double") * factor for m in measures})
    origins = [o for o, _ in dict.fromkeys(pairs)]
    dests = [d for _, d in pairs]
    rest = [c for c in df.columns if c not in origins and c not in measures]
    return out.select(*dict.fromkeys(origins), *dests, *rest, *measures)


def map_many_to_one(df: DataFrame, mapping: DataFrame, origin: str, dest: str) -> DataFrame:
    """Left join that keeps unmatched rows; of several rows of an origin in
    ``mapping(origin_code, dest_code)`` the first counts."""
    place = [POSITION] if POSITION in mapping.columns else []
    side = declared_first(mapping.select(F.lower("origin_code").alias("_code"), F.col("dest_code").alias(dest), *place), ["_code"]).select("_code", dest)
    keyed = df.withColumn("_code", F.lower(F.col(origin).cast("string")))
    return skew_join(keyed, side, ["_code"], "left").drop("_code")


def map_codelists(
    source: DataFrame, destination: DataFrame, pairs: DataFrame, source_tree: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Correspondence ``pairs(origin_code, dest_code)`` restricted to codes known on both sides.

    With ``source_tree(ancestor, descendant)`` a mapped code carries its descendants along.
    Returns (mapped pairs, unmapped source codes).
    """
    known = pairs.join(source.select(F.col("code").alias("origin_code")), "origin_code", "left_semi").join(
        destination.select(F.col("code").alias("dest_code")), "dest_code", "left_semi"
    )
    mapped = known.select("origin_code", "dest_code")
    if source_tree is not None:
        below = (
            skew_join(source_tree.withColumnRenamed("ancestor", "origin_code"), known, ["origin_code"])
            .select(F.col("descendant").alias("origin_code"), "dest_code")
        )
        mapped = mapped.unionByName(below)
    mapped = mapped.distinct()
    unmapped = source.select("code").distinct().join(
        mapped.select(F.col("origin_code").alias("code")), "code", "left_anti"
    )
    return mapped, unmapped


def resolve_referred(codes: DataFrame, reference: DataFrame) -> DataFrame:
    """Codes that refer to another hierarchy inherit its label and description.

    ``codes(hierarchy, code, ref_hierarchy, label, description)``, ``reference`` alike.
    """
    ref = reference.select(
        F.col("hierarchy").alias("ref_hierarchy"),
        F.lower("code").alias("_code"),
        F.col("label").alias("_label"),
        F.col("description").alias("_description"),
    )
    return (
        codes.withColumn("_code", F.lower("code"))
        .join(ref, ["ref_hierarchy", "_code"], "left")
        .withColumn("label", F.coalesce("_label", "label"))
        .withColumn("description", F.coalesce("_description", "description"))
        .select(*codes.columns)
    )


def container_side(matrix: DataFrame, row: str, col: str, weight: str, tolerance: float = 0.01) -> DataFrame:
    """Which side of a weight matrix is the container: the one whose sums are all about 1.

    One output row: ``rows_are_one``, ``cols_are_one`` and ``situation``.
    """

    def all_one(side: str, name: str) -> DataFrame:
        sums = matrix.groupBy(side).agg(F.sum(weight).alias("_s"))
        return sums.agg(F.coalesce(F.every(F.abs(F.col("_s") - 1) < tolerance), F.lit(False)).alias(name))

    both = all_one(row, "rows_are_one").withColumn("_one", F.lit(1)).join(
        all_one(col, "cols_are_one").withColumn("_one", F.lit(1)), "_one"
    )
    situation = (
        F.when(F.col("rows_are_one") & F.col("cols_are_one"), F.lit("ambiguous"))
        .when(F.col("rows_are_one"), F.lit("in_rows"))
        .when(F.col("cols_are_one"), F.lit("in_columns"))
        .otherwise(F.lit("none"))
    )
    return both.select("rows_are_one", "cols_are_one", situation.alias("situation"))
