"""Dictionaries of the codes of a cube (Q-01, Q-03).

Codes are compared in any case and through mappings, which no scan can do. A dictionary lists, for each dimension, the values
that occur, beside their text in lower case. Codes are looked up there first, and the cube is then filtered by the values themselves, as its files
hold them: a filter that reaches the scan and leaves out row groups and partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.runtime import Scratch, checkpointed, small_table

MAX_LITERALS = 1_000  # values that are written into a filter one by one
MAX_RANGES = 200  # beyond them: ranges of the sorted values


class CodeDictionary:
    """Tables (value, folded) of the distinct values of dimensions.

    It describes the rows it was made from: rows that are added to a cube later need it to be made again (``of`` or ``write``), else their new
    spellings are not found. Null is no code.
    """

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = dict(tables)

    @classmethod
    def of(cls, cube: DataFrame, dims: Sequence[str]) -> CodeDictionary:
        """From the rows of a cube: a scan of one column and a hash aggregate for each dimension."""
        scratch = Scratch(cube.sparkSession, "codes")
        return cls({d: scratch.save(cls._spellings(cube, d), "codes") for d in dims})

    @classmethod
    def write(cls, cube: DataFrame, dims: Sequence[str], path: str) -> CodeDictionary:
        """The same, kept below ``path`` beside the cube, in a folder for each dimension."""
        for d in dims:
            cls._spellings(cube, d).write.mode("overwrite").parquet(f"{path}/{d}")
        return cls.read(cube.sparkSession, dims, path)

    @classmethod
    def read(cls, spark: SparkSession, dims: Sequence[str], path: str) -> CodeDictionary:
        return cls({d: spark.read.parquet(f"{path}/{d}") for d in dims})

    @staticmethod
    def _spellings(cube: DataFrame, dim: str) -> DataFrame:
        values = cube.select(F.col(dim).alias("value")).filter("value is not null").distinct()
        return values.withColumn("folded", F.lower(F.col("value").cast("string")))

    def __contains__(self, dim: str) -> bool:
        return dim in self.tables

    def spellings(self, dim: str, codes: Sequence[str] | DataFrame) -> DataFrame:
        """(value): what the dimension holds of ``codes``, which are texts in any case or a table of texts in lower case."""
        if not isinstance(codes, DataFrame):
            lowered = sorted({c.lower() for c in codes})
            codes = small_table(self.tables[dim].sparkSession, [(c,) for c in lowered], "folded string")
        return self.tables[dim].join(codes.toDF("folded"), "folded", "left_semi").select("value")

    def restrict(self, cube: DataFrame, dim: str, codes: Sequence[str] | DataFrame) -> DataFrame:
        """Rows of ``cube`` whose ``dim`` is one of ``codes``, by a filter on exact values.

        Up to ``MAX_LITERALS`` values are named in the filter. More are written as a table: the filter then names at most ``MAX_RANGES`` ranges
        between values that follow each other in the sorted table, and a semi-join with the table picks the rows within them."""
        found = self.spellings(dim, codes)
        values = [r["value"] for r in found.limit(MAX_LITERALS + 1).collect()]
        if len(values) <= MAX_LITERALS:
            # an empty list keeps nothing
            return cube.filter(F.col(dim).isin(sorted(values)))
        found = checkpointed(found, "spellings")
        return cube.filter(self._within(found, dim)).join(found.withColumnRenamed("value", dim), dim, "left_semi").select(*cube.columns)

    @staticmethod
    def _within(found: DataFrame, dim: str):
        ranges = (
            found.repartitionByRange(MAX_RANGES, "value")
            .groupBy(F.spark_partition_id().alias("_range"))
            .agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
            .collect()  # at most MAX_RANGES rows
        )
        inside = F.lit(False)
        for r in ranges:
            inside = inside | F.col(dim).between(r["lo"], r["hi"])
        return inside
