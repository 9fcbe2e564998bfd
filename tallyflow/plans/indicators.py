"""Results, indicators, benchmarks and matrices over events; observer priority; text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions import scalar as X
from tallyflow.functions.aggregates import case_aggregate, weighted_sum
from tallyflow.operators import filters as Q
from tallyflow.operators import indicators as I
from tallyflow.operators import scenarios as P
from tallyflow.operators import solve as S
from tallyflow.plans.registry import Tables, inline, query, rounded

# Results: user = processor, event type = interface type, day = period, mean value; clicks and
# views enter, the rest leaves. All rows have the scope Total; errors are External as well.
RESULTS = """
res AS (
  SELECT 'base' AS scenario, strftime(ts, '%Y-%m-%d') AS period, 'Total' AS scope, 'U' || CAST(user_id AS VARCHAR) AS processor, event_type AS interface,
    CASE WHEN event_type IN ('click', 'view') THEN 'Input' ELSE 'Output' END AS orientation, avg(value) AS value
  FROM events GROUP BY ALL
  UNION ALL
  SELECT 'base', strftime(ts, '%Y-%m-%d'), 'External', 'U' || CAST(user_id AS VARCHAR), event_type, 'Output', avg(value)
  FROM events WHERE event_type = 'error' GROUP BY ALL)
"""


def results(t: Tables):
    e = t.events.select(
        F.lit("base").alias("scenario"),
        F.date_format("ts", "yyyy-MM-dd").alias("period"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("processor"),
        F.col("event_type").alias("interface"),
        F.when(F.col("event_type").isin("click", "view"), "Input").otherwise("Output").alias("orientation"),
        "value",
    )
    scopes = F.when(F.col("interface") == "error", F.array(F.lit("Total"), F.lit("External"))).otherwise(F.array(F.lit("Total")))
    e = e.withColumn("scope", F.explode(scopes))
    return e.groupBy("scenario", "period", "scope", "processor", "interface", "orientation").agg(F.avg("value").alias("value"))


PARAMS = [("base", "k", 2.0), ("base", "purchase_weight", 3.0)]


def params(spark):
    return inline(spark, PARAMS, "scenario string, name string, value double")


PIVOTED = f"""{RESULTS},
v AS (SELECT scenario, period, scope, processor,
  max(value) FILTER (interface = 'click') AS click, max(value) FILTER (interface = 'view') AS view_,
  max(value) FILTER (interface = 'purchase') AS purchase, max(value) FILTER (interface = 'error') AS error
  FROM res GROUP BY ALL)
"""


@query(
    "local_indicator",
    f"""WITH {PIVOTED}
    SELECT scenario, period, scope, processor, 'conversion' AS indicator, round(purchase / view_, 6) AS value FROM v WHERE purchase / view_ IS NOT NULL
    UNION ALL SELECT scenario, period, scope, processor, 'effort', round(2.0 * click + coalesce(view_, 0), 6) FROM v WHERE click IS NOT NULL
    UNION ALL SELECT scenario, period, scope, processor, 'faults', round(error - 1, 6) FROM v WHERE error IS NOT NULL""",
)
def local_indicator(spark, sf):
    formulas = {
        "conversion": "try_divide(purchase_output, View_input)",
        "effort": "K * click + coalesce(view, 0)",
        "faults": "error - 1",
    }
    return rounded(I.local_indicators(results(Tables(spark, sf)), formulas, params(spark)), 6)


@query(
    "global_indicator",
    f"""WITH {RESULTS}, g AS (SELECT scenario, period,
      sum(value) FILTER (interface = 'purchase' AND scope = 'Total') AS p, avg(value) FILTER (interface = 'view' AND scope = 'Total') AS v,
      max(value) FILTER (interface = 'click' AND scope = 'Total') AS c, min(value) FILTER (interface = 'click' AND scope = 'Total') AS c0,
      count(*) FILTER (interface = 'error' AND scope = 'External') AS e, count(*) FILTER (interface = 'error' AND scope = 'External' AND value IS NULL) AS e0
      FROM res GROUP BY ALL)
    SELECT scenario, period, 'intensity' AS indicator, round(3.0 * p / v, 4) AS value FROM g WHERE p / v IS NOT NULL
    UNION ALL SELECT scenario, period, 'spread', round(c - c0, 4) FROM g WHERE c IS NOT NULL
    UNION ALL SELECT scenario, period, 'faults', round(e + e0, 4) FROM g WHERE e > 0""",
)
def global_indicator(spark, sf):
    defs = {
        "intensity": ({"p": case_aggregate("sum", "Purchase"), "v": case_aggregate("avg", "view_input")}, "purchase_weight * try_divide(p, v)"),
        "spread": ({"hi": case_aggregate("max", "click"), "lo": case_aggregate("min", "click")}, "hi - lo"),
        "faults": ({"n": case_aggregate("count", "error_output", "External"), "m": case_aggregate("nancount", "error", "External")}, "n + m"),
    }
    return rounded(I.global_indicators(results(Tables(spark, sf)), defs, params(spark)), 4)


METHOD_ROWS = [
    ("m1", "gwp", "100y", "click", 0.5), ("m1", "gwp", "100y", "ERROR", 4.0), ("m2", "gwp", "20y", "view", 1.25), ("m1", "ap", "10y", "nothing", 7.0),
]
METHOD_SCHEMA = "method string, indicator string, horizon string, interface string, coefficient double"


@query(
    "characterize",
    f"""WITH {RESULTS}, k AS (SELECT DISTINCT scenario, period, scope, processor FROM res),
    m AS (SELECT * FROM (VALUES ('gwp_m1_100y', 'click', 0.5), ('gwp_m1_100y', 'error', 4.0), ('gwp_m2_20y', 'view', 1.25), ('ap_m1_10y', 'nothing', 7.0)) AS x(indicator, i, c))
    SELECT k.*, n.indicator, round(coalesce((SELECT 0.0), 0.0) + coalesce(s.v, 0.0), 6) AS value
    FROM k CROSS JOIN (SELECT DISTINCT indicator FROM m) n LEFT JOIN
      (SELECT scenario, period, scope, processor, indicator, sum(value * c) AS v FROM res JOIN m ON interface = i GROUP BY ALL) s
      ON s.scenario = k.scenario AND s.period = k.period AND s.scope = k.scope AND s.processor = k.processor AND s.indicator = n.indicator""",
)
def characterize(spark, sf):
    return rounded(I.characterize(results(Tables(spark, sf)), inline(spark, METHOD_ROWS, METHOD_SCHEMA)), 6)


RANGE_ROWS = [
    ("size", 1, 0.0, True, 2500.0, False, "small"), ("size", 2, 2500.0, True, 7500.0, True, "medium"), ("size", 3, 7000.0, False, 9500.0, False, "large"),
    ("sign", 1, -1e9, True, 0.0, False, "debt"), ("sign", 2, 0.0, True, 1e9, True, "credit"),
]
RANGE_SCHEMA = "benchmark string, ord int, lo double, lo_incl boolean, hi double, hi_incl boolean, category string"


@query(
    "benchmark_ranges",
    """WITH b AS (SELECT * FROM (VALUES ('size', 1, 0.0, true, 2500.0, false, 'small'), ('size', 2, 2500.0, true, 7500.0, true, 'medium'), ('size', 3, 7000.0, false, 9500.0, false, 'large'),
      ('sign', 1, -1e9, true, 0.0, false, 'debt'), ('sign', 2, 0.0, true, 1e9, true, 'credit')) AS v(benchmark, ord, lo, lo_incl, hi, hi_incl, category)),
    hit AS (SELECT c_custkey, benchmark, category, row_number() OVER (PARTITION BY c_custkey, benchmark ORDER BY ord) AS r FROM customer JOIN b
      ON (c_acctbal > lo OR (lo_incl AND c_acctbal = lo)) AND (c_acctbal < hi OR (hi_incl AND c_acctbal = hi)))
    SELECT c.c_custkey, 'balance' AS indicator, c_acctbal AS value, n.benchmark, coalesce(category, '<out (' || CAST(c_acctbal AS VARCHAR) || ')>') AS category
    FROM customer c CROSS JOIN (SELECT DISTINCT benchmark FROM b) n LEFT JOIN hit ON hit.c_custkey = c.c_custkey AND hit.benchmark = n.benchmark AND r = 1""",
)
def benchmark_ranges(spark, sf):
    ind = Tables(spark, sf).customer.select("c_custkey", F.lit("balance").alias("indicator"), F.col("c_acctbal").alias("value"))
    links = inline(spark, [("balance", "size"), ("balance", "sign"), ("other", "sign")], "indicator string, benchmark string")
    return I.frame_benchmarks(ind, links, inline(spark, RANGE_ROWS, RANGE_SCHEMA))


@query(
    "benchmark_stakeholders",
    """SELECT r_name AS benchmark, n_name AS stakeholder FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def benchmark_stakeholders(spark, sf):
    t = Tables(spark, sf)
    # the nations of a region are its stakeholders, declared as comma-separated text
    b = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("benchmark"), F.concat(F.lit(" , "), "n_name", F.lit(" ,")).alias("stakeholders")
    )
    return I.benchmark_stakeholders(b)


@query(
    "matrix",
    f"""WITH {RESULTS}, e AS (SELECT scenario, period, scope, processor, 2.0 * max(value) FILTER (interface = 'click') AS effort FROM res GROUP BY ALL)
    SELECT r.scenario, r.period, r.processor, r.scope, round(avg(value) FILTER (interface = 'click'), 6) AS "click Input",
      round(avg(value) FILTER (interface = 'purchase'), 6) AS "purchase Output", round(max(e.effort), 6) AS effort
    FROM res r LEFT JOIN e ON r.scenario = e.scenario AND r.period = e.period AND r.scope = e.scope AND r.processor = e.processor
    WHERE r.scope = 'Total' AND interface IN ('click', 'purchase') GROUP BY ALL""",
)
def matrix(spark, sf):
    r = results(Tables(spark, sf))
    ind = I.local_indicators(r, {"effort": "2.0 * click"})
    return rounded(I.matrix(r, [("click", "Input"), ("purchase", "Output")], ind, ["Effort"], scope="total").withColumnRenamed("Effort", "effort"), 6)


@query(
    "end_use_matrix",
    f"""WITH {RESULTS} SELECT scenario, period, processor, 'n' AS level, round(avg(value) FILTER (interface = 'click'), 6) AS "click (h)",
      round(avg(value) FILTER (interface = 'view'), 6) AS "view (ha)"
    FROM res WHERE scope = 'Total' AND orientation = 'Input' GROUP BY ALL""",
)
def end_use_matrix(spark, sf):
    r = results(Tables(spark, sf)).filter("scope = 'Total'").withColumn("level", F.lit("n"))
    return rounded(Q.end_use_matrix(r, {"click": "h", "view": "ha"}), 6)


@query(
    "select_results",
    f"""WITH {RESULTS}, big AS (SELECT 'U' || CAST(user_id AS VARCHAR) AS p FROM events GROUP BY 1 HAVING max(value) > 90)
    SELECT scenario, period, scope, processor, interface, orientation, round(value, 6) AS value FROM res
    WHERE scope = 'Total' AND interface IN ('click', 'error') AND processor IN (SELECT p FROM big)""",
)
def select_results(spark, sf):
    t = Tables(spark, sf)
    big = t.events.groupBy("user_id").agg(F.max("value").alias("m")).filter("m > 90").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("processor")
    )
    return rounded(Q.select_results(results(t), "TOTAL", big, ["Click", " error "]), 6)


@query(
    "weighted_addition",
    """SELECT l_returnflag, round(sum(l_quantity * CASE WHEN l_discount = 0 THEN 1.0 ELSE l_discount END), 2) AS total FROM lineitem GROUP BY 1""",
)
def weighted_addition(spark, sf):
    w = F.when(F.col("l_discount") != 0, F.col("l_discount"))
    return rounded(Tables(spark, sf).lineitem.groupBy("l_returnflag").agg(weighted_sum(F.col("l_quantity"), w).alias("total")), 2)


@query(
    "to_extensive",
    """WITH f AS (SELECT l_orderkey AS node, l_linenumber AS flow, l_quantity AS value, CASE l_returnflag WHEN 'R' THEN 'kg/ha' WHEN 'A' THEN 'kg/h' ELSE 'kg' END AS unit FROM lineitem)
    SELECT f.node, flow, round(CASE WHEN unit = 'kg/ha' THEN value * o_totalprice * 0.0001 ELSE value END, 6) AS value,
      CASE WHEN unit = 'kg/ha' THEN 'kg' ELSE unit END AS unit, CASE WHEN unit = 'kg/ha' THEN value END AS value_intensive, CASE WHEN unit = 'kg/ha' THEN unit END AS unit_intensive
    FROM f JOIN orders ON o_orderkey = f.node""",
)
def to_extensive(spark, sf):
    t = Tables(spark, sf)
    unit = F.when(F.col("l_returnflag") == "R", "kg/ha").when(F.col("l_returnflag") == "A", "kg/h").otherwise("kg")
    flows = t.lineitem.select(F.col("l_orderkey").alias("node"), F.col("l_linenumber").alias("flow"), F.col("l_quantity").alias("value"), unit.alias("unit"))
    funds = t.orders.select(F.col("o_orderkey").alias("node"), F.col("o_totalprice").alias("value"), F.lit("m2").alias("unit"))
    return rounded(I.to_extensive(flows, funds, inline(spark, [("m2", "ha", 0.0001)], "from string, to string, ratio double")), 6, "value")


# -- observations -----------------------------------------------------------------------
@query(
    "observer_priority",
    """WITH o AS (SELECT strftime(ts, '%Y-%m-%d') AS period, user_id AS node, event_type AS observer, value FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY period, node ORDER BY CASE observer WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 9 END, value, observer) AS k FROM o)
    SELECT period, node, value, observer FROM r WHERE k = 1""",
)
def observer_priority(spark, sf):
    return S.pick_observations(_observations(Tables(spark, sf)), ["purchase", "click", "view"], ["period", "node"])[0]


def _observations(t: Tables):
    return t.events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("period"), F.col("user_id").alias("node"), "value", F.col("event_type").alias("observer")
    )


@query(
    "observer_issues",
    """SELECT DISTINCT 'error' AS level, 'observer not in the priority list' AS rule, event_type AS key, 'purchase,click,view' AS message FROM events
    WHERE event_type NOT IN ('purchase', 'click', 'view')""",
)
def observer_issues(spark, sf):
    return S.pick_observations(_observations(Tables(spark, sf)), ["purchase", "click", "view"], ["period", "node"])[1]


# -- scenarios --------------------------------------------------------------------------
SCENARIO_PARAMS = [("tax", "Number", "0.2"), ("boost", "Number", "1 + tax"), ("name", "String", "x"), ("total", "Number", "boost * 10")]
OVERRIDES = [("high", "Tax", "0.5"), ("high", "total", "boost * 100")]


def scenario_values(spark):
    p = inline(spark, SCENARIO_PARAMS, "name string, type string, value string")
    o = inline(spark, OVERRIDES, "scenario string, parameter string, value string")
    return P.eval_params(P.scenario_params(p, o, ["base", "high"]))


SCENARIO_SQL = """s AS (SELECT * FROM (VALUES ('base', 0.2, 1.2, 12.0), ('high', 0.5, 1.5, 150.0)) AS v(scenario, tax, boost, total))"""


@query(
    "eval_observations",
    f"""WITH {SCENARIO_SQL} SELECT s.scenario, o_orderstatus AS kind, o_orderkey AS node,
      round(CASE o_orderstatus WHEN 'F' THEN boost * 2 WHEN 'O' THEN total - tax ELSE o_totalprice END, 6) AS value FROM orders CROSS JOIN s""",
)
def eval_observations(spark, sf):
    """Some orders carry formulas over parameters instead of numbers; two scenarios."""
    text = F.when(F.col("o_orderstatus") == "F", "boost * 2").when(F.col("o_orderstatus") == "O", "TOTAL - tax").otherwise(F.col("o_totalprice").cast("string"))
    o = Tables(spark, sf).orders.select(F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("node"), text.alias("expr"))
    done, _ = P.eval_observations(o, scenario_values(spark), ["base", "high"])
    return rounded(done.select("scenario", "kind", "node", "value"), 6)


@query(
    "eval_weights",
    f"""WITH {SCENARIO_SQL} SELECT s.scenario, l_orderkey AS src, l_suppkey AS dst, round(CASE l_returnflag WHEN 'R' THEN boost / 4 ELSE l_tax END, 8) AS weight
    FROM lineitem CROSS JOIN s""",
)
def eval_weights(spark, sf):
    li = Tables(spark, sf).lineitem
    e = li.select(
        F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"),
        F.when(F.col("l_returnflag") == "R", "boost / 4").otherwise(F.col("l_tax").cast("string")).alias("weight"),
    )
    return rounded(P.eval_weights(e, scenario_values(spark), ["base", "high"]).select("scenario", "src", "dst", "weight"), 8)


@query(
    "generic_periods",
    """WITH o AS (SELECT CASE WHEN event_type = 'signup' THEN 'Year' ELSE strftime(ts, '%Y-%m-%d') END AS period, event_id, value FROM events),
    p AS (SELECT DISTINCT period FROM o WHERE period <> 'Year')
    SELECT period, event_id, value FROM o WHERE period <> 'Year'
    UNION ALL SELECT p.period, event_id, value FROM o CROSS JOIN p WHERE o.period = 'Year'""",
)
def generic_periods(spark, sf):
    o = Tables(spark, sf).events.select(
        F.when(F.col("event_type") == "signup", "Year").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("period"), "event_id", "value"
    )
    return P.generic_periods(o)


# -- text functions ---------------------------------------------------------------------
@query(
    "text_functions",
    """SELECT c_custkey, regexp_replace(c_name, '[^0-9a-zA-Z_]+', '_', 'g') AS ident, 'id_' || CAST(c_custkey AS VARCHAR) || '_x' AS ident2,
      split_part('a.b.' || c_name, '.', 3) AS last, '"' || c_mktsegment || '" 5eur 3usd' AS half,
      c_mktsegment || ' cost' AS words, 'k=' || c_mktsegment AS pair,
      CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS wealth
    FROM customer""",
)
def text_functions(spark, sf):
    c = Tables(spark, sf).customer
    cleaned = X.clean_text(F.concat(F.lit("“"), "c_mktsegment", F.lit("” 5€ 3$")))
    kv = X.key_value_map(F.concat(F.lit(" k = '"), "c_mktsegment", F.lit("', z=1")))
    return c.select(
        "c_custkey",
        X.identifier_name(F.col("c_name")).alias("ident"),
        X.identifier_name(F.concat(F.col("c_custkey").cast("string"), F.lit("-x"))).alias("ident2"),
        X.last_part(F.concat(F.lit("a.b."), "c_name")).alias("last"),
        cleaned.alias("half"),
        X.replace_words(F.concat("c_mktsegment", F.lit(" price")), {"price": "cost"}).alias("words"),
        F.concat(F.lit("k="), kv["k"]).alias("pair"),
        X.first_true([("c_acctbal < 0", "'debt'"), ("c_acctbal < 5000", "'some'")], "'rich'").alias("wealth"),
    )


@query(
    "period_functions",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'month' ELSE 'year' END AS kind,
      CASE WHEN o_orderstatus = 'P' THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(date_trunc('year', o_orderdate) AS DATE) END AS start FROM orders""",
)
def period_functions(spark, sf):
    o = Tables(spark, sf).orders
    p = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return o.select("o_orderkey", X.period_kind(p).alias("kind"), X.period_start(p).alias("start"))


@query(
    "interval_functions",
    """SELECT c_custkey, c_acctbal >= 100 AND c_acctbal < 5000 AS inside FROM customer""",
)
def interval_functions(spark, sf):
    c = Tables(spark, sf).customer.withColumn("_i", X.parse_interval(F.lit("[100, 5e3)")))
    i = F.col("_i")
    return c.select("c_custkey", X.in_interval(F.col("c_acctbal"), i["lo"], i["lo_incl"], i["hi"], i["hi_incl"]).alias("inside"))


@query(
    "arithmetic_functions",
    """SELECT l_orderkey, l_linenumber, round(l_quantity + CASE WHEN l_discount = 0 THEN 0 ELSE l_discount END, 4) AS plus,
      round(l_quantity * CASE WHEN l_discount = 0 THEN 1 ELSE l_discount END, 4) AS times FROM lineitem""",
)
def arithmetic_functions(spark, sf):
    d = F.when(F.col("l_discount") != 0, F.col("l_discount"))
    return rounded(
        Tables(spark, sf).lineitem.select(
            "l_orderkey", "l_linenumber", X.add_absent(F.col("l_quantity"), d).alias("plus"), X.multiply_absent(F.col("l_quantity"), d).alias("times")
        ),
        4,
    )


@query(
    "unit_conversion",
    """SELECT l_orderkey, l_linenumber, round(CASE l_returnflag WHEN 'R' THEN l_quantity * 1000 WHEN 'A' THEN l_quantity END, 4) AS grams, l_returnflag = 'N' AS grams_missing FROM lineitem""",
)
def unit_conversion(spark, sf):
    unit = F.when(F.col("l_returnflag") == "R", "kg").when(F.col("l_returnflag") == "A", "g").otherwise("m")
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", unit.alias("unit"), F.lit("g").alias("target"))
    units = inline(spark, [("kg", "g", 1000.0), ("t", "g", 1e6)], "from string, to string, ratio double")
    return rounded(X.convert_units(li, units, "l_quantity", "unit", "target", "grams").select("l_orderkey", "l_linenumber", "grams", "grams_missing"), 4)


@query(
    "attribute_types",
    """SELECT k AS kind, count(*) AS n FROM (SELECT unnest(['Integer', 'Float', 'String', 'Datetime', 'Boolean']) AS k, o_orderkey FROM orders) GROUP BY 1""",
)
def attribute_types(spark, sf):
    o = Tables(spark, sf).orders
    texts = F.array(
        F.col("o_orderkey").cast("string"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")), F.col("o_orderpriority"),
        F.date_format("o_orderdate", "yyyy-MM-dd"), (F.col("o_orderstatus") == "F").cast("string"),
    )
    kinds = o.select(F.explode(texts).alias("t")).select(X.attribute_type(F.col("t")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pedigree_modes",
    """SELECT p_partkey, CAST(i AS INT) AS phase, 'phase ' || CAST(i AS VARCHAR) || ' mode ' || substr(lpad(CAST(p_size AS VARCHAR), 2, '0'), i + 1, 1) AS label
    FROM part, (SELECT unnest([0, 1]) AS i)""",
)
def pedigree_modes(spark, sf):
    p = Tables(spark, sf).part.select("p_partkey", F.lpad(F.col("p_size").cast("string"), 2, "0").alias("code"))
    phases = inline(spark, [(i, m, f"phase {i} mode {m}") for i in (0, 1) for m in range(10)], "phase int, mode int, label string")
    return X.pedigree_modes(p, "code", phases).select("p_partkey", "phase", "label")
