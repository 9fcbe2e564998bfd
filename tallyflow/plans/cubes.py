"""Cube queries, mappings, labels and pivots over orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions.aggregates import missing_count
from tallyflow.operators import cube as C
from tallyflow.operators import filters as Q
from tallyflow.operators import mapping as M
from tallyflow.operators.dictionary import CodeDictionary
from tallyflow.plans.registry import Tables, inline, query, rounded, year_of
from tallyflow.runtime import declared_first
from tallyflow.sources.readers import with_position

# A discount of 0 is taken as "not reported": it gives the cubes missing values.
LINES = """
WITH lines AS (
  SELECT l_returnflag, l_linestatus, CAST(year(l_shipdate) AS INT) AS period, l_quantity,
         CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS discount
  FROM lineitem)
"""


def lines(t: Tables):
    return t.lineitem.select(
        "l_returnflag",
        "l_linestatus",
        year_of("l_shipdate").alias("period"),
        F.col("l_shipdate").alias("date"),
        "l_quantity",
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount"),
    )


ALL_AGGS = ["sum", "avg", "count", "sumna", "countav", "avgna", "pctna"]


def _agg_sql(m: str) -> str:
    whole = f"count({m}) = count(*)"
    return f"""
      round(CASE WHEN {whole} THEN sum({m}) END, 3) AS {m}_sum,
      round(CASE WHEN {whole} THEN avg({m}) END, 6) AS {m}_avg,
      count(*) AS {m}_count,
      round(coalesce(sum({m}), 0.0), 3) AS {m}_sumna,
      count({m}) AS {m}_countav,
      round(avg({m}), 6) AS {m}_avgna,
      round(100.0 * avg(CASE WHEN {m} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS {m}_pctna"""


@query(
    "cube_filter_agg",
    LINES
    + f"""SELECT l_returnflag, l_linestatus, {_agg_sql('l_quantity')}, {_agg_sql('discount')}
    FROM lines WHERE lower(l_returnflag) IN ('a', 'r') AND period BETWEEN 1996 AND 1999
    GROUP BY l_returnflag, l_linestatus""",
)
def cube_filter_agg(spark, sf):
    out = C.query_cube(
        lines(Tables(spark, sf)),
        where={"L_RETURNFLAG": ["a", "R"], "L_LINESTATUS": [], "StartPeriod": [1996], "EndPeriod": [1999]},
        group_by=["l_returnflag", "l_linestatus"],
        measures=["l_quantity", "discount"],
        aggs=ALL_AGGS,
        period="date",
    )
    for suffix, digits in (("sum", 3), ("sumna", 3), ("avg", 6), ("avgna", 6), ("pctna", 6)):
        out = rounded(out, digits, f"l_quantity_{suffix}", f"discount_{suffix}")
    return out


@query(
    "cube_zipped_aggs",
    LINES
    + """SELECT period, l_linestatus, round(sum(l_quantity), 3) AS quantity, round(avg(discount), 6) AS mean_discount
    FROM lines WHERE period = 1998 GROUP BY period, l_linestatus""",
)
def cube_zipped_aggs(spark, sf):
    out = C.query_cube(
        lines(Tables(spark, sf)),
        where={"StartPeriod": 1998},
        group_by=["period", "l_linestatus"],
        measures=["l_quantity", "discount"],
        aggs=["sum", "avgna"],
        names=["quantity", "mean_discount"],
        period="date",
    )
    return rounded(rounded(out, 3, "quantity"), 6, "mean_discount")


@query(
    "cube_default_average",
    """SELECT o_orderstatus, round(avg(o_totalprice), 3) AS o_totalprice_avg
    FROM orders GROUP BY o_orderstatus""",
)
def cube_default_average(spark, sf):
    t = Tables(spark, sf)
    return rounded(C.query_cube(t.orders, {}, ["O_ORDERSTATUS"], ["o_totalprice"]), 3)


@query(
    "cube_numeric_codes",
    """SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 3) GROUP BY l_linenumber""",
)
def cube_numeric_codes(spark, sf):
    """Codes of a numeric dimension; what is no such number selects nothing."""
    t = Tables(spark, sf).lineitem
    return C.query_cube(t, {"l_linenumber": ["1", "3", "2-3", "1.5"]}, ["l_linenumber"], ["l_quantity"], ["count"], ["n"])


@query(
    "cube_null_keys",
    """SELECT o_orderpriority AS priority, count(*) AS n FROM orders
    WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY o_orderpriority""",
)
def cube_null_keys(spark, sf):
    o = Tables(spark, sf).orders.withColumn(
        "priority", F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    )
    return C.query_cube(o, {}, ["priority"], ["o_totalprice"], ["count"], ["n"])


@query(
    "cube_constant_dim",
    """SELECT o_orderstatus, 'EUR' AS unit, round(sum(o_totalprice), 2) AS total
    FROM orders GROUP BY o_orderstatus""",
)
def cube_constant_dim(spark, sf):
    out = C.query_cube(
        Tables(spark, sf).orders,
        {"unit": ["EUR"], "market": ["a", "b"]},
        ["o_orderstatus", "unit", "market"],
        ["o_totalprice"],
        ["sum"],
        ["total"],
    )
    return rounded(out, 2)


@query(
    "cube_missing_count",
    LINES + "SELECT count(*) FILTER (discount IS NULL) AS discount_missing, count(*) AS n FROM lines",
)
def cube_missing_count(spark, sf):
    return lines(Tables(spark, sf)).agg(
        missing_count(F.col("discount")).alias("discount_missing"), F.count(F.lit(1)).alias("n")
    )


@query("cube_distinct_tuples", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def cube_distinct_tuples(spark, sf):
    return C.distinct_tuples(Tables(spark, sf).orders, ["o_orderstatus", "o_orderpriority"])


@query(
    "cube_code_lists",
    """SELECT DISTINCT 'o_orderstatus' AS concept, o_orderstatus AS code FROM orders
    UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders""",
)
def cube_code_lists(spark, sf):
    return C.code_lists(Tables(spark, sf).orders, ["o_orderstatus", "o_orderpriority"])


# -- mappings ---------------------------------------------------------------------------
# Every nation of AFRICA, AMERICA and ASIA is shared between its region and a common pool; the
# other nations are left unmapped on purpose.
NATION_MAP = """
SELECT n_name AS origin_code, r_name AS dest_code, 0.8 AS weight FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA')
UNION ALL
SELECT n_name, 'POOL', 0.2 FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA')
"""
PRIORITY_MAP = """
SELECT * FROM (VALUES ('1-URGENT', 'fast', 1.0), ('2-HIGH', 'fast', 0.5), ('2-HIGH', 'normal', 0.5),
('3-MEDIUM', 'normal', NULL), ('5-LOW', 'slow', 1.0)) AS v(origin_code, dest_code, weight)
"""
PRIORITY_ROWS = [
    ("priority", "1-URGENT", "speed", "fast", 1.0),
    ("priority", "2-HIGH", "speed", "fast", 0.5),
    ("priority", "2-high", "speed", "normal", 0.5),
    ("priority", "3-MEDIUM", "speed", "normal", None),
    ("priority", "5-LOW", "speed", "slow", 1.0),
]
MAP_SCHEMA = "origin_dim string, origin_code string, dest_dim string, dest_code string, weight double"


def nation_map(t: Tables):
    shared = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).filter(
        F.col("r_name").isin("AFRICA", "AMERICA", "ASIA")
    )
    dests = F.explode(
        F.array(
            F.struct(F.col("r_name").alias("d"), F.lit(0.8).alias("w")),
            F.struct(F.lit("POOL").alias("d"), F.lit(0.2).alias("w")),
        )
    ).alias("_t")
    return shared.select("n_name", dests).select(
        F.lit("nation").alias("origin_dim"),
        F.col("n_name").alias("origin_code"),
        F.lit("bloc").alias("dest_dim"),
        F.col("_t.d").alias("dest_code"),
        F.col("_t.w").alias("weight"),
    )


def priority_map(spark):
    return inline(spark, PRIORITY_ROWS, MAP_SCHEMA)


def order_cube(t: Tables):
    """orders with the nation of the customer: nation, priority, period, value."""
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("nation"),
            F.col("o_orderpriority").alias("priority"),
            year_of("o_orderdate").alias("period"),
            F.col("o_orderdate").alias("date"),
            F.col("o_totalprice").alias("value"),
        )
    )


ORDER_CUBE = """
oc AS (SELECT n_name AS nation, o_orderpriority AS priority, CAST(year(o_orderdate) AS INT) AS period,
       o_totalprice AS value
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


@query(
    "cube_map_m2m",
    f"""WITH m AS ({NATION_MAP})
    SELECT coalesce(m.dest_code, '') AS bloc, round(sum(s_acctbal * coalesce(m.weight, 1.0)), 3) AS balance,
           count(*) AS n
    FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN m ON lower(n_name) = lower(m.origin_code)
    GROUP BY 1""",
)
def cube_map_m2m(spark, sf):
    t = Tables(spark, sf)
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("nation"), "s_acctbal"
    )
    mapped = M.apply_mappings(s, nation_map(t), ["s_acctbal"], [("nation", "bloc")])
    return rounded(mapped.groupBy("bloc").agg(F.sum("s_acctbal").alias("balance"), F.count(F.lit(1)).alias("n")), 3)


@query(
    "cube_map_two_dims",
    f"""WITH {ORDER_CUBE}, m AS ({NATION_MAP}), p AS ({PRIORITY_MAP})
    SELECT coalesce(m.dest_code, '') AS bloc, coalesce(p.dest_code, '') AS speed,
      round(sum(value * coalesce(m.weight, 1.0) * coalesce(p.weight, 1.0)), 3) AS value_sum, count(value) AS value_countav
    FROM oc LEFT JOIN m ON lower(nation) = lower(m.origin_code) LEFT JOIN p ON lower(priority) = lower(p.origin_code)
    WHERE period BETWEEN 1996 AND 1997
    GROUP BY 1, 2""",
)
def cube_map_two_dims(spark, sf):
    t = Tables(spark, sf)
    mapping = nation_map(t).unionByName(priority_map(spark))
    out = C.query_cube(
        order_cube(t),
        {"StartPeriod": "1996", "EndPeriod": "1997"},
        ["bloc", "speed"],
        ["value"],
        ["sum", "countav"],
        mapping=mapping,
        pairs=[("nation", "bloc"), ("priority", "speed")],
        period="date",
    )
    return rounded(out, 3)


@query(
    "cube_filter_mapped",
    f"""WITH p AS ({PRIORITY_MAP})
    SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE lower(o_orderpriority) IN (SELECT lower(origin_code) FROM p WHERE dest_code IN ('normal', 'slow'))
    GROUP BY 1""",
)
def cube_filter_mapped(spark, sf):
    o = Tables(spark, sf).orders.withColumnRenamed("o_orderpriority", "priority")
    kept = Q.filter_mapped(o, priority_map(spark), "priority", "speed", ["NORMAL", "slow"])
    return rounded(
        kept.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2
    )


@query(
    "cube_by_dictionary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 3) AS quantity FROM lineitem
    WHERE lower(l_returnflag) IN ('a', 'n') AND lower(l_linestatus) = 'f' GROUP BY 1, 2""",
)
def cube_by_dictionary(spark, sf):
    """Codes in any case, looked up in a dictionary of the cube: the scan filters by the values themselves."""
    cube = Tables(spark, sf).lineitem
    known = CodeDictionary.of(cube, ["l_returnflag", "l_linestatus"])
    return rounded(
        C.query_cube(cube, {"L_RETURNFLAG": ["a", "N", "absent"], "l_linestatus": ["f"]}, ["l_returnflag", "l_linestatus"], ["l_quantity"], ["sum"], ["quantity"], dictionary=known), 3
    )


@query(
    "cube_mapped_by_dictionary",
    """SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1""",
)
def cube_mapped_by_dictionary(spark, sf):
    """A filter on a mapped dimension with as many origin codes as customers: ranges of the dictionary."""
    cube = Tables(spark, sf).customer
    code = lambda c: F.lit(c).cast("string")
    segments = cube.select(code("c_name").alias("origin_dim"), F.upper("c_name").alias("origin_code"), code("segment").alias("dest_dim"), F.col("c_mktsegment").alias("dest_code"))
    wanted = ["automobile", "FURNITURE", "household", "Machinery"]
    kept = Q.filter_mapped(cube, segments, "c_name", "segment", wanted, CodeDictionary.of(cube, ["c_name"]))
    return kept.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cube_rows",
    f"""WITH {ORDER_CUBE}, p AS ({PRIORITY_MAP})
    SELECT priority, coalesce(dest_code, '') AS speed, nation, period, round(value * coalesce(weight, 1.0), 4) AS value
    FROM oc LEFT JOIN p ON lower(priority) = lower(origin_code)
    WHERE lower(nation) IN ('nation_1', 'nation_7') AND lower(priority) IN
      (SELECT lower(origin_code) FROM p WHERE dest_code = 'fast')""",
)
def cube_rows(spark, sf):
    out = C.query_cube(
        order_cube(Tables(spark, sf)).drop("date"),
        {"nation": ["Nation_1", "NATION_7"], "speed": ["fast"]},
        measures=["value"],
        mapping=priority_map(spark),
        pairs=[("priority", "speed")],
    )
    return rounded(out, 4)


@query(
    "mapping_complete",
    f"""WITH p AS ({PRIORITY_MAP})
    SELECT 'priority' AS origin_dim, origin_code, 'speed' AS dest_dim, dest_code, CAST(coalesce(weight, 1.0) AS DOUBLE) AS weight FROM (
      SELECT CASE WHEN origin_code = '2-HIGH' AND dest_code = 'normal' THEN '2-high' ELSE origin_code END AS origin_code,
             dest_code, weight FROM p) q
    UNION ALL
    SELECT DISTINCT 'priority', o_orderpriority, 'speed', '', 1.0 FROM orders
    WHERE lower(o_orderpriority) NOT IN (SELECT lower(origin_code) FROM p)""",
)
def mapping_complete(spark, sf):
    codes = Tables(spark, sf).orders.select(F.col("o_orderpriority").alias("code"))
    return M.complete_mapping(priority_map(spark), codes, "priority", "speed")


@query(
    "mapping_many_to_one",
    """SELECT coalesce(r_name, 'none') AS area, count(*) AS n, round(sum(c_acctbal), 2) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'EUROPE' GROUP BY 1""",
)
def mapping_many_to_one(spark, sf):
    t = Tables(spark, sf)
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    regions = t.region.filter("r_name <> 'EUROPE'")
    m = t.nation.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.upper("n_name").alias("origin_code"), F.col("r_name").alias("dest_code")
    )
    out = M.map_many_to_one(c, m, "n_name", "area")
    return rounded(
        out.groupBy(F.coalesce("area", F.lit("none")).alias("area")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("balance")
        ),
        2,
    )


@query(
    "mapping_repeated_pairs",
    """SELECT 'error' AS level, 'repeated mapping' AS rule, lower(p_type) || ' -> ' || lower(p_brand) AS key,
      CAST(count(*) AS VARCHAR) || ' declarations' AS message
    FROM part GROUP BY lower(p_type), lower(p_brand) HAVING count(*) > 1""",
)
def mapping_repeated_pairs(spark, sf):
    rows = Tables(spark, sf).part.select(
        F.lit("type").alias("origin_dim"),
        F.lower("p_type").alias("origin_code"),
        F.lit("brand").alias("dest_dim"),
        F.lower("p_brand").alias("dest_code"),
        F.lit(None).cast("double").alias("weight"),
    )
    return M.build_mapping(rows)[1]


@query(
    "mapping_first_declared",
    """WITH p AS (SELECT *, row_number() OVER () AS place FROM part),
    f AS (SELECT lower(p_type) AS k, min(place) AS place FROM p GROUP BY 1)
    SELECT p_type AS origin_code, p_brand AS dest_code, p_size * 1.0::DOUBLE AS weight FROM p JOIN f USING (place)""",
)
def mapping_first_declared(spark, sf):
    """Of the brands that a type of part has been mapped to, the one in the table's first row counts, with its weight."""
    rows = with_position(spark.read.parquet(f"{sf}/part.parquet")).select(
        F.lit("type").alias("origin_dim"), F.col("p_type").alias("origin_code"), F.lit("brand").alias("dest_dim"), F.col("p_brand").alias("dest_code"),
        F.col("p_size").cast("double").alias("weight"), "position",
    )
    first = declared_first(rows.withColumn("_k", F.lower("origin_code")), ["_k"]).drop("_k", "_n")
    return M.build_mapping(first)[0].select("origin_code", "dest_code", "weight")


CODE_PAIRS = """
src AS (SELECT DISTINCT n_name AS code FROM nation), dst AS (SELECT DISTINCT r_name AS code FROM region WHERE r_name <> 'ASIA'),
pairs AS (SELECT n_name AS o, r_name AS d FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


def _code_lists(t: Tables):
    src = t.nation.select(F.col("n_name").alias("code"))
    dst = t.region.filter("r_name <> 'ASIA'").select(F.col("r_name").alias("code"))
    pairs = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("origin_code"), F.col("r_name").alias("dest_code")
    )
    return src, dst, pairs


@query("mapping_codelists", f"WITH {CODE_PAIRS} SELECT o AS origin_code, d AS dest_code FROM pairs JOIN dst ON d = code")
def mapping_codelists(spark, sf):
    return M.map_codelists(*_code_lists(Tables(spark, sf)))[0]


@query(
    "mapping_unmapped_codes",
    f"WITH {CODE_PAIRS} SELECT code FROM src WHERE code NOT IN (SELECT o FROM pairs JOIN dst ON d = code)",
)
def mapping_unmapped_codes(spark, sf):
    return M.map_codelists(*_code_lists(Tables(spark, sf)))[1]


@query(
    "mapping_container_side",
    """WITH q AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
    w AS (SELECT l_orderkey, l_linenumber, q / sum(q) OVER (PARTITION BY l_orderkey) AS w FROM q),
    r AS (SELECT bool_and(abs(s - 1) < 0.01) AS b FROM (SELECT sum(w) AS s FROM w GROUP BY l_orderkey)),
    c AS (SELECT bool_and(abs(s - 1) < 0.01) AS b FROM (SELECT sum(w) AS s FROM w GROUP BY l_linenumber))
    SELECT r.b AS rows_are_one, c.b AS cols_are_one,
      CASE WHEN r.b AND c.b THEN 'ambiguous' WHEN r.b THEN 'in_rows' WHEN c.b THEN 'in_columns' ELSE 'none' END AS situation
    FROM r, c""",
)
def mapping_container_side(spark, sf):
    q = Tables(spark, sf).lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    total = q.groupBy("l_orderkey").agg(F.sum("q").alias("t"))
    w = q.join(total, "l_orderkey").withColumn("w", F.col("q") / F.col("t"))
    return M.container_side(w, "l_orderkey", "l_linenumber", "w")


@query(
    "codes_referred",
    """SELECT 'customers' AS hierarchy, n_name AS code, 'world' AS ref_hierarchy, r_name AS label, 'seen from ' || r_name AS description
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def codes_referred(spark, sf):
    t = Tables(spark, sf)
    text = F.lit(None).cast("string")
    codes = t.nation.select(
        F.lit("customers").alias("hierarchy"), F.col("n_name").alias("code"), F.lit("world").alias("ref_hierarchy"),
        text.alias("label"), text.alias("description"),
    )
    ref = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit("world").alias("hierarchy"), F.lower("n_name").alias("code"), F.col("r_name").alias("label"),
        F.concat(F.lit("seen from "), "r_name").alias("description"),
    )
    return M.resolve_referred(codes, ref)


# -- densify, pivots, labels ------------------------------------------------------------
@query(
    "cube_densify",
    """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS period FROM orders),
    s AS (SELECT unnest(['F', 'O', 'X']) AS o_orderstatus), p AS (SELECT DISTINCT o_orderpriority FROM orders),
    d AS (SELECT CAST(year(o_orderdate) AS INT) AS period, o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS value, count(*) AS n
          FROM orders GROUP BY 1, 2, 3)
    SELECT y.period, s.o_orderstatus, p.o_orderpriority, d.value, d.n FROM y CROSS JOIN s CROSS JOIN
      (SELECT DISTINCT o_orderpriority FROM d) p
      LEFT JOIN d ON y.period = d.period AND s.o_orderstatus = d.o_orderstatus AND p.o_orderpriority = d.o_orderpriority
    WHERE y.period IN (SELECT period FROM d)""",
)
def cube_densify(spark, sf):
    o = Tables(spark, sf).orders
    data = o.groupBy(year_of("o_orderdate").alias("period"), "o_orderstatus", "o_orderpriority").agg(
        F.round(F.sum("o_totalprice"), 2).alias("value"), F.count(F.lit(1)).alias("n")
    )
    return C.densify(data, ["period", "o_orderstatus", "o_orderpriority"], {"o_orderstatus": ["F", "O", "X"]})


def _pivot_cells() -> str:
    cells = []
    for name, cond in (("F", "l_linestatus = 'F'"), ("O", "l_linestatus = 'O'"), ("Total", "TRUE")):
        for a, f in (("sum", "sum"), ("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")):
            cells.append(f"round({f}(l_quantity) FILTER ({cond}), 6) AS {name}_{a}")
    return ", ".join(cells)


@query(
    "pivot_totals",
    f"""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'Total' ELSE l_returnflag END AS l_returnflag, {_pivot_cells()}
    FROM lineitem GROUP BY ROLLUP (l_returnflag)""",
)
def pivot_totals(spark, sf):
    out = C.pivot_table(
        Tables(spark, sf).lineitem, ["l_returnflag"], "l_linestatus", ["F", "O"], "l_quantity",
        ["sum", "mean", "std", "max", "min"], totals=True,
    )
    return rounded(out, 6)


@query(
    "pivot_plain",
    """SELECT CAST(year(o_orderdate) AS INT) AS period, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F_sum,
      round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O_sum, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P_sum
    FROM orders GROUP BY 1""",
)
def pivot_plain(spark, sf):
    o = Tables(spark, sf).orders.withColumn("period", year_of("o_orderdate"))
    return rounded(C.pivot_table(o, ["period"], "o_orderstatus", ["F", "O", "P"], "o_totalprice", ["sum"]), 2)


@query(
    "pivot_size",
    """WITH s AS (SELECT count(DISTINCT l_orderkey) AS r, count(DISTINCT l_suppkey) AS c FROM lineitem)
    SELECT r AS n_rows, c AS n_cols, r * c AS cells, r * c > 40000 AS too_large FROM s""",
)
def pivot_size(spark, sf):
    return C.pivot_size(Tables(spark, sf).lineitem, ["l_orderkey"], ["l_suppkey"])


@query(
    "labels",
    """SELECT s_suppkey, n_name AS nation, r_name AS region, 'in ' || r_name AS nation_desc, 'Area ' || CAST(r_regionkey AS VARCHAR) AS region_desc
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def labels(spark, sf):
    t = Tables(spark, sf)
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    s = t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )
    specific = nations.select(F.lit("sup_nation").alias("hierarchy"), F.lower("n_name").alias("code"), F.concat(F.lit("in "), "r_name").alias("label"))
    general = nations.select(F.lit("nation").alias("hierarchy"), F.col("n_name").alias("code"), F.lit("hidden by the specific one").alias("label"))
    areas = t.region.select(F.lit("region").alias("hierarchy"), F.col("r_name").alias("code"), F.concat(F.lit("Area "), F.col("r_regionkey").cast("string")).alias("label"))
    return C.add_labels(s, specific.unionByName(general).unionByName(areas), "sup", ["nation", "region"])


@query(
    "usage_matrix",
    """WITH a AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS code FROM customer), b AS (SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS code FROM supplier)
    SELECT coalesce(a.code, b.code) AS code, CAST(a.code IS NOT NULL AS INT) AS customer, CAST(b.code IS NOT NULL AS INT) AS supplier
    FROM a FULL JOIN b ON a.code = b.code""",
)
def usage_matrix(spark, sf):
    t = Tables(spark, sf)
    return C.usage_matrix(
        {"customer": t.customer.withColumnRenamed("c_nationkey", "k"), "supplier": t.supplier.withColumnRenamed("s_nationkey", "k")}, "k"
    )


@query(
    "describe_cube",
    """SELECT concept, role, data_type, CASE concept WHEN 'o_orderstatus' THEN (SELECT count(DISTINCT o_orderstatus) FROM orders)
      WHEN 'o_orderpriority' THEN (SELECT count(DISTINCT o_orderpriority) FROM orders)
      WHEN 'period' THEN (SELECT count(DISTINCT year(o_orderdate)) FROM orders) END AS codes
    FROM (VALUES ('o_orderstatus', 'dimension', 'string'), ('o_orderpriority', 'dimension', 'string'),
    ('period', 'time', 'int'), ('o_totalprice', 'measure', 'double'), ('StartPeriod', 'time', 'string'), ('EndPeriod', 'time', 'string'))
    AS v(concept, role, data_type)""",
)
def describe_cube(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderstatus", "o_orderpriority", year_of("o_orderdate").alias("period"), "o_totalprice")
    return C.describe_cube(C.with_roles(o, {"period": "time"}))


@query(
    "structure_codes",
    """SELECT DISTINCT 0 AS position, 'o_orderstatus' AS concept, 'Dimension' AS role, o_orderstatus AS code FROM orders
    UNION ALL SELECT DISTINCT 1, 'period', 'TimeDimension', CAST(year(o_orderdate) AS VARCHAR) FROM orders""",
)
def structure_codes(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderstatus", year_of("o_orderdate").alias("period"), "o_totalprice", "o_custkey")
    return C.structure_codes(C.with_roles(o, {"period": "time", "o_custkey": "attribute"}))


@query(
    "fill_down",
    """SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS)
      OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS kind FROM events""",
)
def fill_down(spark, sf):
    e = Tables(spark, sf).events.select(
        "event_id", "user_id", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(F.lit(" ")).alias("kind")
    )
    return C.fill_down(e, ["kind"], "event_id", ["user_id"], block=1024)


@query(
    "fill_down_sheet",
    """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
      OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""",
)
def fill_down_sheet(spark, sf):
    e = Tables(spark, sf).events.select(
        "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase")
    )
    return C.fill_down(e, ["last_purchase"], "event_id", block=4096)
