"""Source shapes and sinks: tables are written in a published shape and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.operators.network import geo_join
from tallyflow.plans.registry import Tables, inline, query, rounded, year_of
from tallyflow.runtime import Scratch
from tallyflow.sources import readers as R
from tallyflow.sources import sinks as K


def yearly(t: Tables):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority", year_of("o_orderdate").cast("string").alias("year")).agg(
        F.round(F.sum(F.when(F.col("o_totalprice") > 400000, F.col("o_totalprice"))), 2).alias("v")
    )


YEARLY = """SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(year(o_orderdate) AS VARCHAR) AS TIME_PERIOD,
  round(sum(o_totalprice) FILTER (o_totalprice > 400000), 2) AS value FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY 1, 2, 3"""
YEARS = [str(y) for y in range(1995, 2002)]


@query(
    "wide_periods",
    f"""WITH y AS ({YEARLY}), k AS (SELECT DISTINCT status, priority FROM y), p AS (SELECT CAST(unnest(range(1995, 2002)) AS VARCHAR) AS TIME_PERIOD)
    SELECT k.status, k.priority, p.TIME_PERIOD, y.value FROM k CROSS JOIN p LEFT JOIN y ON y.status = k.status AND y.priority = k.priority AND y.TIME_PERIOD = p.TIME_PERIOD""",
)
def wide_periods(spark, sf):
    """A wide TSV with flags and ``:`` for missing, read back and turned to rows."""
    wide = yearly(Tables(spark, sf)).groupBy("o_orderstatus", "o_orderpriority").pivot("year", YEARS).agg(F.first("v"))
    text = lambda y: F.coalesce(F.concat(F.format_string("%.2f", F.col(y)), F.lit(" p ")), F.lit(": ")).alias(y + " ")
    raw = wide.select(F.concat_ws(",", "o_orderstatus", "o_orderpriority").alias("status,priority\\time"), *[text(y) for y in YEARS])
    path = Scratch(spark, "tsv").new_path()
    raw.write.option("sep", "\t").option("header", True).csv(path)
    return R.unpivot_periods(R.read_wide_tsv(spark, path), ["status", "priority"])


@query(
    "trade_csv",
    """SELECT l_returnflag AS PRODUCT, CAST(year(l_shipdate) AS VARCHAR) AS PERIOD, round(sum(l_extendedprice), 2) AS VALUE FROM lineitem GROUP BY 1, 2""",
)
def trade_csv(spark, sf):
    li = Tables(spark, sf).lineitem.select(
        F.col("l_returnflag").alias("PRODUCT"), F.concat(F.year("l_shipdate").cast("string"), F.lit("52")).alias("PERIOD"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("VALUE"), F.lit("x").alias("UNUSED"),
    )
    path = Scratch(spark, "trade").new_path()
    li.write.option("header", True).csv(path)
    df = R.read_trade_csv(spark, path, ["PRODUCT", "PERIOD"], ["VALUE"])
    return rounded(df.groupBy("PRODUCT", "PERIOD").agg(F.sum("VALUE").alias("VALUE")), 2)


def _normalized(t: Tables):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("Area Code"), F.col("n_name").alias("Area"), F.col("r_regionkey").alias("Region Code"), F.col("r_name").alias("Region"),
        F.lit(2020).alias("Year"), F.col("s_suppkey").alias("Item"), F.col("s_acctbal").alias("Value"),
    )


@query(
    "normalized_csv",
    """SELECT CAST(n_nationkey AS VARCHAR) AS "Area_id", CAST(n_regionkey AS VARCHAR) AS "Region_id", '2020' AS "Year_id", CAST(s_suppkey AS VARCHAR) AS "Item",
      CAST(s_acctbal AS DOUBLE) AS "Value" FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def normalized_csv(spark, sf):
    path = Scratch(spark, "normalized").new_path()
    _normalized(Tables(spark, sf)).write.option("header", True).option("encoding", "iso-8859-1").csv(path)
    return R.read_normalized(spark, path).withColumn("Value", F.col("Value").cast("double"))


@query(
    "extract_codes",
    """SELECT DISTINCT 'Area' AS concept, CAST(n_nationkey AS VARCHAR) AS code, n_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION SELECT DISTINCT 'Region', CAST(r_regionkey AS VARCHAR), r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def extract_codes(spark, sf):
    df = _normalized(Tables(spark, sf))
    return R.extract_codes(df, R.code_pairs(df.columns))


@query(
    "split_code_label",
    """SELECT c_custkey, lower(c_mktsegment) AS segment, c_name AS segment_desc FROM customer WHERE c_acctbal >= 0""",
)
def split_code_label(spark, sf):
    c = Tables(spark, sf).customer.select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("("), "c_mktsegment", F.lit(") "), "c_name")).alias("segment")
    )
    return R.split_code_label(c, ["segment"])


@query(
    "stack_and_recode",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'f1' WHEN o_orderstatus = 'O' THEN 'o1' ELSE o_orderstatus END AS status, CAST(year(o_orderdate) AS INT) AS year, round(sum(o_totalprice), 2) AS value
    FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 2001 GROUP BY 1, 2""",
)
def stack_and_recode(spark, sf):
    days = [f"{y}-12-31" for y in YEARS]
    o = Tables(spark, sf).orders.withColumn("d", F.concat(F.year("o_orderdate").cast("string"), F.lit("-12-31")))
    wide = o.groupBy(F.col("o_orderstatus").alias("status")).pivot("d", days).agg(F.sum("o_totalprice"))
    codes = inline(spark, [("status", "F1", "F"), ("status", "O1", "O"), ("other", "X", "P")], "concept string, code string, description string")
    return rounded(R.stack_and_recode(wide, ["status"], codes), 2)


@query("dims_lower", "SELECT lower(c_mktsegment) AS c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def dims_lower(spark, sf):
    path = Scratch(spark, "lower").new_path()
    Tables(spark, sf).customer.select("c_mktsegment", "c_custkey").write.option("header", True).csv(path)
    return R.read_dims_lower(spark, path, ["c_mktsegment"]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "trade_extracts",
    """SELECT DISTINCT l_linenumber AS cmdCode, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS period, l_returnflag AS flow,
      CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem WHERE l_linenumber IN (1, 3, 5) AND year(l_shipdate) IN (1997, 1999)""",
)
def trade_extracts(spark, sf):
    li = Tables(spark, sf).lineitem.select(
        F.col("l_linenumber").alias("cmdCode"), (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("int").alias("period"), F.col("l_returnflag").alias("flow")
    )
    scratch = Scratch(spark, "extracts")
    paths = [scratch.new_path("a"), scratch.new_path("b")]
    li.filter("flow <> 'R'").write.option("header", True).csv(paths[0])
    li.filter("flow <> 'A'").write.option("header", True).csv(paths[1])
    return R.load_trade_extracts(spark, paths, "cmdCode int, period int, flow string", [1, 3, 5], [1997, 1999], "M")


@query(
    "local_source",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, o_orderstatus FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND o_orderstatus IN ('F', 'P')""",
)
def local_source(spark, sf):
    Tables(spark, sf).orders.select("o_orderkey", year_of("o_orderdate").alias("year"), "o_orderstatus").createOrReplaceTempView("local_orders")
    return R.read_local(spark, "local_orders", {"O_OrderStatus": ["f", "p"], "StartPeriod": ["1996"], "EndPeriod": ["1998"]})


@query(
    "bind_schema",
    """SELECT CAST(l_orderkey AS VARCHAR) AS Order_Key, l_returnflag AS Flag, CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity END AS Quantity FROM lineitem""",
)
def bind_schema(spark, sf):
    li = Tables(spark, sf).lineitem.select(
        F.col("l_orderkey").alias("ORDER_KEY"), F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("quantity"), "l_tax",
    )
    path = Scratch(spark, "bind").new_path()
    li.write.option("header", True).csv(path)
    return R.read_cube(spark, path, {"Order_Key": "dimension", "Flag": "dimension", "Quantity": "measure"})


@query(
    "split_by_name",
    """SELECT 'click' AS name, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type = 'click'
    UNION ALL SELECT 'view', count(*), round(sum(value), 2) FROM events WHERE event_type = 'view'""",
)
def split_by_name(spark, sf):
    parts = R.split_by_name(Tables(spark, sf).events.select(F.upper("event_type").alias("dataset"), "value"), "dataset", ["click", "view"])
    frames = [d.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.lit(n).alias("name"), "n", "total") for n, d in parts.items()]
    return rounded(frames[0].unionByName(frames[1]), 2)


@query("cache_cube", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def cache_cube(spark, sf):
    cube = R.cache_cube(Tables(spark, sf).orders.select("o_orderpriority", "o_totalprice"), Scratch(spark, "cache").new_path())
    return cube.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "csv_round_trip",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS note FROM orders""",
)
def csv_round_trip(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("note"))
    path = Scratch(spark, "csv").new_path()
    K.to_csv(o, path)
    return spark.read.option("header", True).csv(path)


@query(
    "json_records",
    """SELECT '{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_name":"' || c_name || '","note":' || CASE WHEN c_acctbal < 0 THEN 'null' ELSE '"ok"' END || '}' AS value FROM customer""",
)
def json_records(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.lit("ok")).alias("note"))
    path = Scratch(spark, "json").new_path()
    K.to_json(c, path)
    return spark.read.text(path)


@query("json_split", """SELECT '["' || CAST(c_custkey AS VARCHAR) || '","' || c_mktsegment || '"]' AS value FROM customer""")
def json_split(spark, sf):
    c = Tables(spark, sf).customer.select("c_custkey", "c_mktsegment")
    path = Scratch(spark, "json").new_path()
    K.to_json(c, path, "split")
    return spark.read.text(f"{path}/data")


@query(
    "geo_join",
    """SELECT c_custkey, 'nations' AS geo_ref, CAST(c_nationkey AS VARCHAR) AS geo_code, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3""",
)
def geo_join_query(spark, sf):
    t = Tables(spark, sf)
    procs = t.customer.select("c_custkey", F.lit("nations").alias("geo_ref"), F.col("c_nationkey").cast("string").alias("geo_code"))
    features = t.nation.filter("n_regionkey < 3").select(
        F.lit("nations").alias("reference"), F.col("n_nationkey").cast("string").alias("code"), F.create_map(F.lit("name"), F.col("n_name")).alias("properties")
    )
    return geo_join(procs, features).select("c_custkey", "geo_ref", "geo_code", F.col("properties")["name"].alias("name"))
