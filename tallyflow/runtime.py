"""Lineage cuts and skew handling shared by the operators.

* ``Scratch`` writes intermediate tables under the shared folder named by
  ``spark.checkpoint.dir``; the written table survives the loss of executors, has
  exact size statistics for the planner and ends the lineage of a driver loop.
* ``skew_join`` splits the rows of a hot key over several tasks; ``pair_join`` deals the
  pairs of keys that have many rows on both sides.
* No operator hints a broadcast: Spark broadcasts a side only after it has
  measured it below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_local_roots: dict[str, str] = {}
_written: dict[str, list[str]] = {}  # folders of intermediate tables, by application

ROWS_PER_TASK = 2_000_000  # rows of one key that one task should hold at most


def checkpoint_root(spark: SparkSession) -> str:
    """Folder shared by all executors; a temporary folder is accepted in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _local_roots:
        _local_roots[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tallyflow-")
    return _local_roots[sc.applicationId]


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Definition rows as a local relation: the planner knows their exact size, which a table made
    from a Python list through an RDD would hide."""
    st = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(st)
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), st)


class Scratch:
    """Written intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        _written.setdefault(spark.sparkContext.applicationId, []).append(self.path)
        self._n = 0

    def new_path(self, label: str = "t") -> str:
        self._n += 1
        return f"{self.path}/{self._n:05d}-{label}"

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.new_path(label)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_by(self, df: DataFrame, label: str, column: str) -> DataFrame:
        """Written in one folder for each value of ``column``: a filter on it reads these folders only."""
        path = self.new_path(label)
        df.write.mode("overwrite").partitionBy(column).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_counted(self, df: DataFrame, label: str, counted: Column | None = None) -> tuple[DataFrame, int]:
        """The written table and how many of its rows ``counted`` holds for (all by default), counted while they are written. A repeated
        task may be counted twice: take the number for its order of magnitude, and for exact only where it is 0."""
        seen = Observation()
        rows = F.count(F.lit(1)) if counted is None else F.count_if(counted)
        return self.save(df.observe(seen, rows.alias("rows")), label), seen.get["rows"]


def clean_up(spark: SparkSession) -> int:
    """Delete the intermediate tables of this application and return the number of folders. DataFrames that
    operators have returned read from them: write what is wanted first."""
    folders = _written.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def checkpointed(df: DataFrame, label: str) -> DataFrame:
    return Scratch(df.sparkSession, label).save(df, label)


def estimated_bytes(df: DataFrame) -> int:
    """Size the planner expects, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def will_broadcast(df: DataFrame) -> bool:
    """Is the side small enough for Spark to broadcast it by its own threshold?"""
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760b")
    number = re.match(r"^\s*(-?\d+)\s*([kmg]?)b?\s*$", text.lower())
    limit = int(number[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[number[2]] if number else 10 << 20
    return 0 <= estimated_bytes(df) <= limit


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """(keys, _buckets) of the key values with more than ``rows_per_task`` rows, or None.

    The budget is absolute: a key is split in as many pieces as its rows need, whatever its share of the table. The
    count is a partial aggregation, so a hot key never reaches one task row by row, and the result has at most rows of the
    table / ``rows_per_task`` rows; it is written, not collected.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows_per_task)
    if counts.isEmpty():
        return None
    return checkpointed(counts.select(*keys, F.ceil(F.col("_rows") / rows_per_task).cast("long").alias("_buckets")), "hot")


def skew_join(
    big: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None | bool = True,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi-join (inner / left / left_semi / left_anti) that spreads the hot keys of ``big``.

    A side that Spark broadcasts by its own measure moves no row of ``big``; otherwise keys over the budget are looked for.
    Where there are any, the rows get a running number that is written with them, so that rows that are equal in all columns are
    told apart and a repeated task sees the same number; rows of a hot key are salted by it and the matching rows of
    ``other`` are repeated once per salt. Cold keys are joined as usual. Pass ``hot`` to reuse a previous search.
    """
    on = list(on)
    if hot is True:
        hot = None if will_broadcast(other) else hot_keys(big, on, rows_per_task)
    if hot is None or hot is False:
        return big.join(other, on, how)
    numbered = checkpointed(big.withColumn("_row", F.monotonically_increasing_id()), "salted")
    unmatched = F.lit(False)
    for k in on:
        unmatched = unmatched | F.col(k).isNull()
    salt = F.when(unmatched, F.col("_row")).when(F.col("_buckets").isNotNull(), F.pmod("_row", "_buckets")).otherwise(F.lit(0))
    left = numbered.join(hot, on, "left").withColumn("_salt", salt).drop("_buckets", "_row")
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_buckets") - 1, F.lit(0)))
    right = other.join(hot, on, "left").withColumn("_salt", F.explode(salts)).drop("_buckets")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


SPREAD_ROWS = 250_000  # rows that a task should sort or aggregate at once


def spread(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """``df`` dealt by ``cols`` to as many tasks as ``rows`` need, so that what a task holds does not grow with the table. Without it the
    pieces of a shuffle are put together up to a number of bytes, which many rows of compressible texts stay below. Tables that need
    far fewer tasks than a shuffle has are left to Spark: there the tasks would cost more than their rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows // SPREAD_ROWS
    return df if n <= max(1, parts // 8) else df.repartition(max(n, parts), *cols)


def pair_join(left: DataFrame, right: DataFrame, on: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Inner equi-join that has far more pairs than rows, as ``on`` has few values: rows are moved, pairs never.

    Both sides are written with a running number and counted by key. The pairs of a key are cut in tiles of ``rows_per_task``, as near to squares as its
    rows allow: a row on the left is repeated once for each column of tiles, one on the right once for each row of tiles, and the tiles are dealt to as
    many tasks as there are pairs / ``rows_per_task``. No side is broadcast: the planner does not expect so many repeated rows.
    """
    on = list(on)
    scratch = Scratch(left.sparkSession, "pairs")
    left, right = (scratch.save(df.withColumn("_number", F.monotonically_increasing_id()), s) for df, s in ((left, "left"), (right, "right")))
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_a")).join(right.groupBy(*on).agg(F.count(F.lit(1)).alias("_b")), on)
    width = F.least(F.col("_b").cast("double"), F.greatest(F.lit(rows_per_task**0.5), rows_per_task / F.col("_a")))  # of a tile: rows on the right
    down, across = F.ceil(F.col("_a") * width / rows_per_task), F.ceil(F.col("_b") / width)
    sizes = sizes.select(*on, "_a", "_b", down.cast("long").alias("_down"), across.cast("long").alias("_across"), F.monotonically_increasing_id().alias("_key"))
    sizes = scratch.save(sizes, "sizes")
    pairs, a, b = sizes.agg(*[F.coalesce(F.sum(F.col(x) * F.col(y)), F.lit(0)) for x, y in (("_a", "_b"), ("_a", "_across"), ("_b", "_down"))]).first()
    if pairs <= rows_per_task:
        return left.drop("_number").join(right.drop("_number"), on)
    tile = ["_key", "_i", "_j"]
    cut = lambda df, rows: spread(skew_join(df, sizes.drop("_a", "_b"), on), rows, "_number")
    one_of = lambda n: F.pmod(F.xxhash64("_number"), n)
    each_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = cut(left, a).withColumn("_i", one_of("_down")).withColumn("_j", each_of("_across"))
    right = cut(right, b).withColumn("_j", one_of("_across")).withColumn("_i", each_of("_down")).drop(*on)
    left, right = (df.drop("_number", "_down", "_across").repartition(1 + pairs // rows_per_task, *tile) for df in (left, right))
    return left.join(right.hint("merge"), tile).drop(*tile)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


SORT_PARTS = 4_096  # ranges of a sorted numbering: 12 bits, beside 33 bits of places inside a range
NUMBER_BITS = 45


def sorted_numbers(df: DataFrame, col: str, name: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """(``col``, ``name``): the distinct values with numbers below 2^45 in their order, and how many there are.

    The values are sorted across the cluster in ranges; numbers have gaps between the ranges, so that no range waits for another. They are
    written, so that every reader sees the same. A number takes the place of a text wherever only the order matters: it has a
    fixed width, and aggregates over it stay hash aggregates."""
    parts = min(SORT_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    ordered = values.repartitionByRange(parts, col).sortWithinPartitions(col)
    return scratch.save_counted(ordered.withColumn(name, F.monotonically_increasing_id()), f"{name}-numbers")


POSITION = "position"  # of a row in its source, see ``sources.readers.with_position``


def declared_first(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of each key that is declared first, whole, with the number of declarations as ``_n``.

    Rows with a ``position`` are compared by it: a hash aggregate over one long for each key, and one join that brings the winner's columns. Rows without
    one have no order: the smallest row, column by column, stands for the first."""
    keys = list(keys)
    if POSITION not in rows.columns:
        rest = [c for c in rows.columns if c not in keys]
        one = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"), F.count(F.lit(1)).alias("_n"))
        return one.select(*keys, "_row.*", "_n")
    first = rows.groupBy(*keys).agg(F.min(POSITION).alias(POSITION), F.count(F.lit(1)).alias("_n"))
    return skew_join(rows, first, [*keys, POSITION])


def first_value(rows: DataFrame, col: str) -> Column:
    """Aggregate: the value of ``col`` that is declared first, nulls left out."""
    if POSITION not in rows.columns:
        return F.min(col)
    return F.min_by(col, F.when(F.col(col).isNotNull(), F.col(POSITION)))


def dense_index(df: DataFrame, group: Sequence[str], col: str, name: str) -> DataFrame:
    """Number the distinct values of ``col`` 0..n-1 inside each group without a one-task window.

    Values are ordered by their md5; the first four digits give 65 536 blocks per group. Only
    the block sizes are summed in sequence, values are numbered inside their block.
    """
    from pyspark.sql import Window as W

    group = list(group)
    values = df.select(*group, col).distinct().withColumn("_h", F.md5(F.col(col).cast("string")))
    values = values.withColumn("_b", F.substring("_h", 1, 4))
    sizes = values.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*group, "_b").orderBy("_h", col)
    return (
        values.withColumn("_i", F.row_number().over(inside))
        .join(offsets, group + ["_b"])
        .select(*group, col, (F.col("_off") + F.col("_i") - 1).cast("long").alias(name))
    )
