import pytest
from pyspark.sql import functions as F

from tallyflow import runtime as R


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, how):
    """A third of all rows share one key, some have none."""
    big = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") < 1000, F.lit(7)).when(F.col("id") < 1100, F.lit(None)).otherwise(F.col("id") % 300).cast("long").alias("k"),
    )
    other = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(
        spark.range(5, 9).select(F.col("id").alias("k"), F.lit(-1).cast("long").alias("v"))
    )
    if how in ("left_semi", "left_anti"):
        other = other.select("k")
    hot = R.hot_keys(big, ["k"], rows_per_task=100)
    assert [(r["k"], r["_buckets"]) for r in hot.collect()] == [(7, 11)]
    salted = R.skew_join(big, other, ["k"], how, hot=hot)
    key = lambda r: tuple((x is None, x) for x in r)
    cols = big.join(other, ["k"], how).columns
    want = sorted((tuple(r) for r in big.join(other, ["k"], how).select(*cols).collect()), key=key)
    assert sorted((tuple(r) for r in salted.select(*cols).collect()), key=key) == want


@pytest.mark.parametrize("wide", [False, True])
def test_equal_rows_and_small_shares_are_split(spark, wide, monkeypatch):
    """One key with 60 % of the rows and one with 0.3 %, all rows of a key equal in all columns; maps are no hindrance."""
    shape = lambda df: df.withColumn("m", F.create_map(F.lit("a"), "k")) if wide else df
    rows = spark.range(10_000).select(F.when(F.col("id") < 6000, 1).when(F.col("id") < 6030, 2).otherwise(F.col("id")).cast("long").alias("k"))
    big = shape(rows.withColumn("x", F.lit(0)))
    other = spark.range(1, 9000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    hot = R.hot_keys(big, ["k"], rows_per_task=10)
    assert {r["k"]: r["_buckets"] for r in hot.collect()} == {1: 600, 2: 3}
    seen = []
    written = R.checkpointed
    monkeypatch.setattr(R, "checkpointed", lambda df, label: seen.append(written(df, label)) or seen[-1])
    joined = R.skew_join(big, other, ["k"], hot=hot)
    pieces = seen[-1].join(hot, "k").groupBy("k", F.pmod("_row", "_buckets").alias("s")).count()
    sizes = {k: (n, most) for k, n, most in pieces.groupBy("k").agg(F.count(F.lit(1)), F.max("count")).collect()}
    assert sizes[1][0] == 600 and sizes[1][1] <= 20 and sizes[2][0] == 3
    plain = big.join(other, ["k"])
    total = lambda df: df.agg(F.count(F.lit(1)), F.sum("v"), F.sum("x")).first()
    assert total(joined) == total(plain) and joined.columns == plain.columns


@pytest.mark.parametrize("wide", [False, True])
def test_pair_join_equals_join_and_deals_the_pairs(spark, wide):
    """Keys with many rows on both sides, on one of them, on one side only, and no key; some rows are equal in all columns."""
    key = lambda many, few: F.when(F.col("id") < many, 1).when(F.col("id") < many + few, 2).when(F.col("id") % 2 == 0, F.col("id")).cast("long").alias("k")
    left = spark.range(250).select(key(150, 80), (F.col("id") % 7).alias("x"))
    right = spark.range(180).select(key(60, 3), (F.col("id") % 5).alias("y"))
    left, right = (df.withColumn("g", F.lit("a")) if wide else df for df in (left, right))
    on = ["k", "g"] if wide else ["k"]
    joined, plain = R.pair_join(left, right, on, rows_per_task=100), left.join(right, on)
    assert joined.columns == plain.columns
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, plain.collect()))
    tasks = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) > 9_200 and len(tasks) > 30 and max(tasks) <= 1_000
    small, empty = R.pair_join(left, right, on), R.pair_join(left.filter("x > 9"), right, on, rows_per_task=1)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, plain.collect())) and small.columns == plain.columns
    assert empty.columns == plain.columns and empty.count() == 0


def test_tables_below_the_budget_have_no_hot_keys(spark):
    df = R.small_table(spark, [(1,)] * 50, "k long")
    assert R.hot_keys(df, ["k"]) is None


def test_grids_take_map_columns(spark):
    from tallyflow.operators.cube import code_grid

    left = spark.range(3).select(F.create_map(F.lit("a"), "id").alias("m"))
    assert code_grid([left, spark.range(4).select(F.col("id").alias("n"))]).count() == 12


def test_dense_index(spark):
    df = spark.createDataFrame([("g", x) for x in "abcabc"] + [("h", "z")], "g string, x string")
    got = R.dense_index(df, ["g"], "x", "n").collect()
    assert sorted(r["n"] for r in got if r["g"] == "g") == [0, 1, 2]
    assert [r["n"] for r in got if r["g"] == "h"] == [0]


def test_scratch_keeps_the_schema_of_empty_tables(spark):
    s = R.Scratch(spark, "t")
    saved = s.save(spark.range(5).filter("id > 9"))
    assert saved.count() == 0 and saved.columns == ["id"]
    assert s.path.startswith(R.checkpoint_root(spark))


def test_clean_up_leaves_no_table(spark):
    import os

    scratch = R.Scratch(spark, "t")
    scratch.save(spark.range(3))
    folder = scratch.path.removeprefix("file://")
    assert os.path.isdir(folder) and R.clean_up(spark) >= 1
    assert not os.path.exists(folder) and R.clean_up(spark) == 0
