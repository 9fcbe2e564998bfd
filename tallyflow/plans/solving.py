"""Solver runs with conflicts, missing values, types and weights per scenario; formulas by shape; cycles by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.operators import network as N
from tallyflow.operators import provenance as O
from tallyflow.operators import scenarios as P
from tallyflow.operators import solve as S
from tallyflow.operators.cycles import cycle_issues
from tallyflow.plans.registry import Tables, inline, query, rounded
from tallyflow.plans.trees import tag


def _part_of(t: Tables):
    nations = t.nation.select(tag("R", "n_regionkey").alias("parent"), tag("N", "n_nationkey").alias("child"), F.lit(1.0).alias("weight"))
    return nations.unionByName(t.customer.select(tag("N", "c_nationkey").alias("parent"), tag("C", "c_custkey").alias("child"), F.lit(1.0).alias("weight")))


def _spending(t: Tables):
    """Spending per customer and year, observed by a census."""
    year = F.year("o_orderdate").cast("string").alias("period")
    return t.orders.groupBy(year, tag("C", "o_custkey").alias("node")).agg(F.sum("o_totalprice").alias("value")).withColumn("observer", F.lit("census"))


SPENDING = """
cv AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS period, o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
place AS (SELECT c_custkey, c_mktsegment, c_nationkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
"""


@query(
    "solve_conflicts",
    f"""WITH {SPENDING}, sc AS (SELECT unnest(['upper', 'lower']) AS scenario),
    nv AS (SELECT period, c_nationkey AS n, n_regionkey AS r, sum(v) AS v FROM cv JOIN place ON c_custkey = o_custkey GROUP BY 1, 2, 3),
    ov AS (SELECT DISTINCT period, n_nationkey AS n, n_regionkey AS r, 1000.0 * n_nationkey AS v FROM (SELECT DISTINCT period FROM cv) CROSS JOIN nation WHERE n_nationkey % 2 = 0),
    both_ AS (SELECT scenario, coalesce(nv.period, ov.period) AS period, coalesce(nv.n, ov.n) AS n, coalesce(nv.r, ov.r) AS r, nv.v AS a, ov.v AS o
              FROM sc CROSS JOIN (nv FULL JOIN ov ON nv.period = ov.period AND nv.n = ov.n)),
    force AS (SELECT *, CASE WHEN o IS NULL OR (a IS NOT NULL AND scenario = 'lower') THEN a ELSE o END AS v FROM both_),
    res AS (
      SELECT scenario, period, 'C' || CAST(o_custkey AS VARCHAR) AS node, v AS value, false AS computed, NULL AS source, 'census' AS observer, 'No' AS conflict FROM cv CROSS JOIN sc
      UNION ALL SELECT scenario, period, 'N' || CAST(n AS VARCHAR), a, true, 'PartOfAggregation', NULL, CASE WHEN o IS NULL THEN 'No' WHEN scenario = 'lower' THEN 'Taken' ELSE 'Dismissed' END FROM force WHERE a IS NOT NULL
      UNION ALL SELECT scenario, period, 'N' || CAST(n AS VARCHAR), o, false, NULL, 'survey', CASE WHEN a IS NULL THEN 'No' WHEN scenario = 'lower' THEN 'Dismissed' ELSE 'Taken' END FROM force WHERE o IS NOT NULL
      UNION ALL SELECT scenario, period, 'R' || CAST(r AS VARCHAR), sum(v), true, 'PartOfAggregation', NULL, 'No' FROM force GROUP BY scenario, period, r)
    SELECT scenario, period, node, round(value, 2) AS value, computed, source, observer, conflict FROM res""",
)
def solve_conflicts(spark, sf):
    """Nations with even numbers are surveyed as well as added up: one scenario keeps the survey, the other the sum."""
    t = Tables(spark, sf)
    spent = _spending(t)
    survey = t.nation.filter("n_nationkey % 2 = 0").select(tag("N", "n_nationkey").alias("node"), (F.col("n_nationkey") * 1000.0).alias("value"), F.lit("survey").alias("observer"))
    survey = survey.join(spent.select("period").distinct())
    obs = P.scenario_grid(spent.unionByName(survey), ["upper", "lower"])
    net = S.Network(part_of=_part_of(t))
    out = S.solve(net, obs, {"lower": S.Policy(aggregation="TakeLowerAggregation")}).results
    return rounded(out.select("scenario", "period", "node", "value", "computed", "source", "observer", "conflict"), 2)


@query(
    "solve_missing",
    """WITH li AS (SELECT l_orderkey AS o, l_linenumber AS l, sum(l_quantity) FILTER (l_returnflag <> 'N') AS q FROM lineitem GROUP BY 1, 2),
    sums AS (SELECT o, sum(q) AS q, bool_and(q IS NOT NULL) AS complete FROM li GROUP BY o),
    sc AS (SELECT unnest(['strict', 'zero']) AS scenario)
    SELECT scenario, 'O' || CAST(o AS VARCHAR) || '.' || CAST(l AS VARCHAR) AS node, CAST(q AS DOUBLE) AS value, false AS computed FROM li CROSS JOIN sc WHERE q IS NOT NULL
    UNION ALL SELECT scenario, 'O' || CAST(o AS VARCHAR), CAST(q AS DOUBLE), true FROM sums CROSS JOIN sc WHERE q IS NOT NULL AND (complete OR scenario = 'zero')""",
)
def solve_missing(spark, sf):
    """Lines that were not returned have no observation: an order with such a line stays unknown, or takes the others."""
    li = Tables(spark, sf).lineitem
    line = F.concat_ws(".", tag("O", "l_orderkey"), F.col("l_linenumber").cast("string"))
    part_of = li.select(tag("O", "l_orderkey").alias("parent"), line.alias("child")).distinct()
    obs = li.filter("l_returnflag <> 'N'").groupBy(line.alias("node")).agg(F.sum("l_quantity").cast("double").alias("value")).withColumn("period", F.lit("1"))
    strict = S.Policy(missing="Invalidate")
    out = S.solve(S.Network(part_of=part_of), P.scenario_grid(obs, ["strict", "zero"]), {"strict": strict}).results
    return out.select("scenario", "node", "value", "computed")


@query(
    "solve_types",
    """WITH c AS (SELECT o_custkey AS c, 'P' || left(o_orderpriority, 1) AS p, count(*) AS n FROM orders GROUP BY 1, 2),
    g AS (SELECT c, CASE WHEN p IN ('P1', 'P2') THEN 'Fast' ELSE 'Slow' END AS g, sum(n) AS n FROM c GROUP BY 1, 2),
    a AS (SELECT c, sum(n) AS n FROM c GROUP BY 1),
    r AS (SELECT c, ':' || p AS t, n, NULL AS source FROM c UNION ALL SELECT c, ':' || g || ':Input', n, 'InterfaceTypeAggregation' FROM g
      UNION ALL SELECT c, ':All:Input', n, 'InterfaceTypeAggregation' FROM a UNION ALL SELECT c, ':Cost', n * 2.5, 'ScaleChange' FROM a
      UNION ALL SELECT c, ':Tax', n * 2.5 * 0.2, 'Scale' FROM a)
    SELECT 'C' || CAST(c AS VARCHAR) || t AS node, CAST(round(n, 6) AS DOUBLE) AS value, source FROM r""",
)
def solve_types(spark, sf):
    """Types add up to their parent types; the total changes its scale, the cost is taxed."""
    t = Tables(spark, sf)
    priority = F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1))
    counts = t.orders.groupBy(tag("C", "o_custkey").alias("processor"), priority.alias("type")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    counts = counts.withColumn("node", F.concat_ws(":", "processor", "type"))
    types = inline(spark, [("P1", "Fast"), ("P2", "Fast"), ("P3", "Slow"), ("P4", "Slow"), ("P5", "Slow"), ("Fast", "All"), ("Slow", "All"), ("All", None)], "type string, parent_type string")
    faces = counts.select("node", "processor", F.col("type").alias("interface"), "type", F.lit("Input").alias("orientation"))
    edges = N.type_edges(types, faces)[0].select("parent", "child")
    face = lambda i: F.concat("processor", F.lit(":" + i))
    each = counts.select("processor").distinct()
    change = each.select(face("All:Input").alias("src"), face("Cost").alias("dst"), F.lit(2.5).alias("weight"))
    tax = each.select(face("Cost").alias("src"), face("Tax").alias("dst"), F.lit(0.2).alias("weight"))
    obs = counts.select(F.lit("s").alias("scenario"), F.lit("1").alias("period"), "node", "value")
    out = S.solve(S.Network(scale=tax, scale_change=change, type_edges=edges), obs).results
    return rounded(out.select("node", "value", "source"), 6)


@query(
    "solve_scenario_weights",
    f"""WITH {SPENDING}, sc AS (SELECT * FROM (VALUES ('base', 1.0), ('half', 0.5)) AS v(scenario, w)),
    nv AS (SELECT scenario, period, c_nationkey AS n, n_regionkey AS r, sum(v * CASE WHEN c_mktsegment = 'BUILDING' THEN w ELSE 1 END) AS v FROM cv JOIN place ON c_custkey = o_custkey CROSS JOIN sc GROUP BY ALL)
    SELECT scenario, period, 'N' || CAST(n AS VARCHAR) AS node, round(v, 3) AS value FROM nv
    UNION ALL SELECT scenario, period, 'R' || CAST(r AS VARCHAR), round(sum(v), 3) FROM nv GROUP BY scenario, period, r""",
)
def solve_scenario_weights(spark, sf):
    """The weight of one segment is a parameter of the scenario: all other edges are common to the scenarios."""
    t = Tables(spark, sf)
    segment = t.customer.select(tag("C", "c_custkey").alias("child"), (F.col("c_mktsegment") == "BUILDING").alias("building"))
    edges = _part_of(t).join(segment, "child", "left")
    edges = edges.withColumn("weight", F.when(F.col("building"), "share").otherwise("1")).drop("building")
    params = inline(spark, [("base", "share", 1.0), ("half", "share", 0.5)], "scenario string, name string, value double")
    edges = P.eval_weights(edges, params, ["base", "half"], shared=True)
    out = S.solve(S.Network(part_of=edges), P.scenario_grid(_spending(t), ["base", "half"])).results
    return rounded(out.filter("computed").select("scenario", "period", "node", "value"), 3)


@query(
    "formula_shapes",
    """WITH s AS (SELECT * FROM (VALUES ('base', 0.2, 3.0), ('high', 0.5, 4.0)) AS v(scenario, tax, cap))
    SELECT scenario, l_orderkey, l_linenumber, round(CASE l_linenumber % 5 WHEN 0 THEN tax * l_quantity + l_discount WHEN 1 THEN greatest(cap, l_quantity) / 2 WHEN 2 THEN (cap + l_quantity) * tax
      WHEN 3 THEN l_quantity - cap / 4 ELSE cos(tax) * l_quantity + sin(cap) END, 6) AS value FROM lineitem CROSS JOIN s""",
)
def formula_shapes(spark, sf):
    """A formula with numbers of its own in every line: some hundred thousand texts of five shapes."""
    q, d = F.col("l_quantity").cast("string"), F.col("l_discount").cast("string")
    kinds = [
        F.concat(F.lit("tax * "), q, F.lit(" + "), d), F.concat(F.lit("greatest(cap, "), q, F.lit(") / 2")), F.concat(F.lit("(CAP + "), q, F.lit(") * tax")),
        F.concat(q, F.lit(" - cap / 4")), F.concat(F.lit("cos(tax) * "), q, F.lit(" + sin(cap)")),
    ]
    kind = F.col("l_linenumber") % 5
    text = F.when(kind == 0, kinds[0]).when(kind == 1, kinds[1]).when(kind == 2, kinds[2]).when(kind == 3, kinds[3]).otherwise(kinds[4])
    rows = P.scenario_grid(Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", text.alias("expr")), ["base", "high"])
    params = inline(spark, [("base", "tax", 0.2), ("base", "cap", 3.0), ("high", "Tax", 0.5), ("high", "cap", 4.0)], "scenario string, name string, value double")
    return rounded(P.evaluate_texts(rows, "expr", params, "value").select("scenario", "l_orderkey", "l_linenumber", "value"), 6)


@query(
    "parameter_issues",
    """SELECT 'error' AS level, CASE WHEN c_custkey % 6 < 3 THEN 'parameter in a cycle' WHEN c_custkey % 6 = 3 THEN 'parameter depends on one without value' ELSE 'parameter uses an unknown name' END AS rule,
      's:p' || CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey % 6 < 5""",
)
def parameter_issues(spark, sf):
    """Parameters in rings of three, one that hangs on each ring, one that names nobody and one that is well."""
    k, m = F.col("c_custkey"), F.col("c_custkey") % 6
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    expr = (
        F.when(m < 2, F.concat(name(k + 1), F.lit(" + 1"))).when(m == 2, F.concat(name(k - 2), F.lit(" * 2")))
        .when(m == 3, F.concat(name(k - 1), F.lit(" - 1"))).when(m == 4, F.lit("nobody / 3")).otherwise(F.concat(k.cast("string"), F.lit(" * 2")))
    )
    grid = Tables(spark, sf).customer.select(F.lit("s").alias("scenario"), name(k).alias("name"), F.lit("Number").alias("type"), expr.alias("expr"))
    return P.solve_params(grid)[1].select("level", "rule", "key")


@query(
    "hierarchy_cycles",
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey % 40 AS a, (o_orderkey * 7 + o_custkey) % 997 % 40 + 20 * (o_custkey % 40 // 20) AS b FROM orders WHERE o_custkey % 40 < 20 OR o_orderkey % 3 = 0),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    m AS (SELECT r.a AS node, min(lpad(CAST(r.b AS VARCHAR), 3, '0')) AS part FROM r JOIN r k ON k.a = r.b AND k.b = r.a GROUP BY r.a)
    SELECT 'error' AS level, 'hierarchy cycle' AS rule, lpad(CAST(node AS VARCHAR), 3, '0') AS key, part AS message FROM m""",
)
def hierarchy_cycles(spark, sf):
    """A graph of rings: one half of the nodes leads to the other, but not back."""
    o = Tables(spark, sf).orders.filter("o_custkey % 40 < 20 or o_orderkey % 3 = 0")
    a, b = F.expr("o_custkey % 40"), F.expr("(o_orderkey * 7 + o_custkey) % 997 % 40 + 20 * (o_custkey % 40 div 20)")
    word = lambda c: F.lpad(c.cast("string"), 3, "0")
    return cycle_issues(o.select(word(a).alias("parent"), word(b).alias("child")), "parent", "child", "hierarchy cycle")


def _levied(t: Tables) -> S.Network:
    """Customers count for their nation and region; a levy takes a share of the region's spending and another of the nations'."""
    half = F.when(F.col("c_mktsegment") == "BUILDING", 0.5).otherwise(1.0)
    customers = t.customer.select(tag("N", "c_nationkey").alias("parent"), tag("C", "c_custkey").alias("child"), half.alias("weight"))
    nations = t.nation.select(tag("R", "n_regionkey").alias("parent"), tag("N", "n_nationkey").alias("child"), F.lit(1.0).alias("weight"))
    regions = t.nation.select(tag("R", "n_regionkey").alias("src"), tag("L", "n_regionkey").alias("dst"), F.lit(0.25).alias("weight")).distinct()
    levy = regions.unionByName(t.nation.select(tag("N", "n_nationkey").alias("src"), tag("L", "n_regionkey").alias("dst"), F.lit(0.125).alias("weight")))
    return S.Network(part_of=customers.unionByName(nations), scale=levy)


def _levied_solution(t: Tables) -> tuple[S.Network, S.Solution]:
    net = _levied(t)
    return net, S.solve(net, _spending(t).withColumn("scenario", F.lit("base")))


LEVIED = f"""WITH {SPENDING},
    leaf AS (SELECT period, 'C' || CAST(o_custkey AS VARCHAR) AS origin, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5 ELSE 1.0 END AS w, v, c_nationkey AS n, n_regionkey AS r FROM cv JOIN place ON c_custkey = o_custkey)"""


@query(
    "provenance",
    f"""{LEVIED}
    SELECT period, origin, 'N' || CAST(n AS VARCHAR) AS destination, CAST(w AS DOUBLE) AS weight, round(w * v, 6) AS quantity FROM leaf
    UNION ALL SELECT period, origin, 'R' || CAST(r AS VARCHAR), CAST(w AS DOUBLE), round(w * v, 6) FROM leaf
    UNION ALL SELECT period, origin, 'L' || CAST(r AS VARCHAR), CAST(w * 0.375 AS DOUBLE), round(w * 0.375 * v, 6) FROM leaf""",
)
def provenance(spark, sf):
    """Observed origins of all computed values: the levy meets a customer on two paths of different lengths."""
    net, out = _levied_solution(Tables(spark, sf))
    found = O.provenance(S.contributions(out, net), out.values)
    return rounded(found.select("period", "origin", "destination", "weight", "quantity"), 6, "quantity")


@query(
    "provenance_of_targets",
    f"""{LEVIED} SELECT period, origin, 'L' || CAST(r AS VARCHAR) AS destination, round(w * 0.375 * v, 6) AS quantity FROM leaf""",
)
def provenance_of_targets(spark, sf):
    """The same for the levies only, walked back from them."""
    net, out = _levied_solution(Tables(spark, sf))
    levies = out.values.filter("node LIKE 'L%'").select("scenario", "period", "node")
    found = O.provenance(S.contributions(out, net), out.values, levies)
    return rounded(found.select("period", "origin", "destination", "quantity"), 6, "quantity")


@query(
    "result_expressions",
    f"""{LEVIED},
    nv AS (SELECT period, n, r, sum(w * v) AS v FROM leaf GROUP BY ALL), rv AS (SELECT period, r, sum(v) AS v FROM nv GROUP BY ALL),
    steps AS (SELECT period, origin, 'N' || CAST(n AS VARCHAR) AS node, w, w * v AS q FROM leaf
      UNION ALL SELECT period, 'N' || CAST(n AS VARCHAR), 'R' || CAST(r AS VARCHAR), 1.0, v FROM nv
      UNION ALL SELECT period, 'N' || CAST(n AS VARCHAR), 'L' || CAST(r AS VARCHAR), 0.125, v * 0.125 FROM nv
      UNION ALL SELECT period, 'R' || CAST(r AS VARCHAR), 'L' || CAST(r AS VARCHAR), 0.25, v * 0.25 FROM rv),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY period, node ORDER BY abs(q) DESC, origin) AS k, count(*) OVER (PARTITION BY period, node) AS n FROM steps),
    made AS (SELECT period, node, string_agg(CAST(CAST(w AS DOUBLE) AS VARCHAR) || '*' || origin, ' + ' ORDER BY k) FILTER (k <= 3) AS named, any_value(n) AS n FROM ranked GROUP BY period, node)
    SELECT period, node, 'Yes' AS computed, named || CASE WHEN n > 3 THEN ' + ' || CAST(n - 3 AS VARCHAR) || ' more' ELSE '' END AS expression FROM made
    UNION ALL SELECT period, origin, 'No', NULL FROM leaf""",
)
def result_expressions(spark, sf):
    """The result table tells how each value was made (the sum of what is not named is rounded differently by each engine: left out)."""
    net, out = _levied_solution(Tables(spark, sf))
    told = O.with_expression(out.results, S.contributions(out, net), terms=3)
    told = told.withColumn("computed", F.when(F.col("computed"), F.lit("Yes")).otherwise(F.lit("No")))
    return told.select("period", "node", "computed", F.regexp_replace("expression", r" \(.*\)$", "").alias("expression"))
