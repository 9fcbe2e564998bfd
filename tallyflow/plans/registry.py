"""Registry of named queries and the SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.runtime import small_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


class Tables:
    """The provided tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


#: Every customer with one supplier, the suppliers in turn.
PAIRED_SQL = "(SELECT * FROM (SELECT *, c_custkey % (SELECT count(*) FROM supplier) AS pick FROM customer) JOIN supplier ON s_suppkey = pick)"


def paired(t: Tables) -> DataFrame:
    n = t.supplier.count()
    return t.customer.withColumn("_pick", F.col("c_custkey") % n).join(t.supplier, F.col("_pick") == F.col("s_suppkey")).drop("_pick")


def rounded(df: DataFrame, digits: int = 4, *cols: str) -> DataFrame:
    names = cols or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return small_table(spark, rows, schema)


def year_of(col: str) -> Column:
    return F.year(col).cast("int")
