"""Hierarchies, links and flow graphs over region / nation / customer, parts and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.operators import graph as G
from tallyflow.operators import hierarchy as H
from tallyflow.operators.solve import Policy, resolve_conflicts
from tallyflow.plans.registry import PAIRED_SQL, Tables, inline, paired, query, rounded
from tallyflow.runtime import union_all

# World tree: region R<k>, nation N<k>, customer C<k>.
TREE = """
tree AS (
  SELECT 'R' || CAST(n_regionkey AS VARCHAR) AS parent, 'N' || CAST(n_nationkey AS VARCHAR) AS child, 1.0::DOUBLE AS weight FROM nation
  UNION ALL
  SELECT 'N' || CAST(c_nationkey AS VARCHAR), 'C' || CAST(c_custkey AS VARCHAR),
    CASE c_mktsegment WHEN 'BUILDING' THEN 0.5 WHEN 'MACHINERY' THEN 2.0 ELSE 1.0 END::DOUBLE FROM customer),
vals AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS node, c_acctbal AS value FROM customer WHERE c_acctbal >= 0
  UNION ALL
  SELECT 'N' || CAST(s_nationkey AS VARCHAR), sum(s_acctbal) FROM supplier WHERE s_acctbal > 9000 GROUP BY 1)
"""


def tag(letter: str, col: str):
    return F.concat(F.lit(letter), F.col(col).cast("string"))


def tree(t: Tables):
    nations = t.nation.select(tag("R", "n_regionkey").alias("parent"), tag("N", "n_nationkey").alias("child"), F.lit(1.0).alias("weight"))
    w = F.when(F.col("c_mktsegment") == "BUILDING", 0.5).when(F.col("c_mktsegment") == "MACHINERY", 2.0).otherwise(1.0)
    customers = t.customer.select(tag("N", "c_nationkey").alias("parent"), tag("C", "c_custkey").alias("child"), w.alias("weight"))
    return nations.unionByName(customers)


def tree_values(t: Tables):
    """Negative balances are taken as missing; some nations have a value of their own."""
    leaves = t.customer.filter("c_acctbal >= 0").select(tag("C", "c_custkey").alias("node"), F.col("c_acctbal").alias("value"))
    own = t.supplier.filter("s_acctbal > 9000").groupBy(tag("N", "s_nationkey").alias("node")).agg(F.sum("s_acctbal").alias("value"))
    return leaves.unionByName(own)


@query(
    "hierarchy_paths",
    f"""WITH RECURSIVE {TREE}, p(node, path, depth) AS (
      SELECT DISTINCT parent, parent, 0 FROM tree WHERE parent NOT IN (SELECT child FROM tree)
      UNION ALL SELECT child, path || '.' || child, depth + 1 FROM p JOIN tree ON parent = node)
    SELECT node, path, CAST(depth AS INT) AS depth FROM p""",
)
def hierarchy_paths(spark, sf):
    return H.paths(tree(Tables(spark, sf)))


@query(
    "hierarchy_closure",
    f"""WITH RECURSIVE {TREE}, c(ancestor, descendant, distance) AS (
      SELECT parent, child, 1 FROM tree UNION ALL SELECT ancestor, child, distance + 1 FROM c JOIN tree ON parent = descendant)
    SELECT ancestor, descendant, CAST(min(distance) AS INT) AS distance FROM c GROUP BY 1, 2""",
)
def hierarchy_closure(spark, sf):
    return H.closure(tree(Tables(spark, sf)))


@query(
    "hierarchy_heights",
    f"""WITH RECURSIVE {TREE}, c(ancestor, descendant, distance) AS (
      SELECT parent, child, 1 FROM tree UNION ALL SELECT ancestor, child, distance + 1 FROM c JOIN tree ON parent = descendant)
    SELECT node, CAST(max(d) AS INT) AS height FROM (
      SELECT ancestor AS node, distance AS d FROM c UNION ALL SELECT child, 0 FROM tree) GROUP BY node""",
)
def hierarchy_heights(spark, sf):
    return H.heights(tree(Tables(spark, sf)))


def _rollup_sql(policy: str, conflict: str) -> str:
    # nations first, then regions: two levels written out, NULL standing for unknown
    ok = "count(v) = count(*)" if policy == "Invalidate" else "count(v) > 0"
    own, pick = ("own IS NULL", "coalesce(own, s)") if conflict == "TakeUpper" else ("s IS NOT NULL", "coalesce(s, own)")
    return f"""WITH {TREE},
    leaf AS (SELECT t.parent, t.child AS node, t.weight, v.value AS v FROM tree t LEFT JOIN vals v ON v.node = t.child WHERE t.child LIKE 'C%'),
    ns AS (SELECT parent AS node, CASE WHEN {ok} THEN sum(weight * v) END AS s FROM leaf GROUP BY parent),
    n AS (SELECT c.child AS node, ns.s, o.value AS own FROM (SELECT child FROM tree WHERE child LIKE 'N%') c
          LEFT JOIN ns ON ns.node = c.child LEFT JOIN vals o ON o.node = c.child),
    nv AS (SELECT node, {pick} AS v, {own} AS computed FROM n),
    r AS (SELECT t.parent AS node, CASE WHEN {ok} THEN sum(t.weight * nv.v) END AS v FROM tree t JOIN nv ON nv.node = t.child GROUP BY 1)
    SELECT node, round(v, 3) AS value, false AS computed FROM leaf WHERE v IS NOT NULL
    UNION ALL SELECT node, round(v, 3), computed FROM nv WHERE v IS NOT NULL
    UNION ALL SELECT node, round(v, 3), true FROM r WHERE v IS NOT NULL"""


@query("rollup_zero", _rollup_sql("UseZero", "TakeUpper"))
def rollup_zero(spark, sf):
    t = Tables(spark, sf)
    return rounded(H.rollup(tree(t), tree_values(t), "UseZero"), 3)


@query("rollup_invalidate", _rollup_sql("Invalidate", "TakeUpper"))
def rollup_invalidate(spark, sf):
    t = Tables(spark, sf)
    return rounded(H.rollup(tree(t), tree_values(t), "Invalidate"), 3)


@query("rollup_lower_aggregation", _rollup_sql("UseZero", "TakeLowerAggregation"))
def rollup_lower_aggregation(spark, sf):
    t = Tables(spark, sf)
    return rounded(H.rollup(tree(t), tree_values(t), "UseZero", conflict="TakeLowerAggregation"), 3)


@query(
    "rollup_per_period",
    """WITH v AS (SELECT CAST(year(o_orderdate) AS INT) AS period, o_custkey, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
    n AS (SELECT period, c_nationkey, sum(value) AS value FROM v JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT period, 'R' || CAST(n_regionkey AS VARCHAR) AS node, round(sum(value), 2) AS value FROM n JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def rollup_per_period(spark, sf):
    t = Tables(spark, sf)
    v = t.orders.groupBy(F.year("o_orderdate").cast("int").alias("period"), tag("C", "o_custkey").alias("node")).agg(
        F.sum("o_totalprice").alias("value")
    )
    out = H.rollup(tree(t).drop("weight"), v, "UseZero", keys=["period"])
    return rounded(out.filter(F.col("node").startswith("R")).drop("computed"), 2)


@query(
    "hierarchy_build",
    """SELECT 'geo' AS hierarchy, 'R' || CAST(n_regionkey AS VARCHAR) AS parent, 'N' || CAST(n_nationkey AS VARCHAR) AS child, 1.0::DOUBLE AS weight
    FROM nation WHERE n_regionkey <> 3""",
)
def hierarchy_build(spark, sf):
    return H.build_hierarchy(_geo_rows(Tables(spark, sf)))[0]


def _geo_rows(t: Tables):
    """Code rows in which one region was forgotten."""
    regions = t.region.filter("r_regionkey <> 3").select(
        F.lit("geo").alias("hierarchy"), tag("R", "r_regionkey").alias("code"), F.lit(None).cast("string").alias("parent_code")
    )
    nations = t.nation.select(F.lit("geo").alias("hierarchy"), tag("N", "n_nationkey").alias("code"), F.lower(tag("R", "n_regionkey")).alias("parent_code"))
    return regions.unionByName(nations)


@query(
    "hierarchy_orphans",
    "SELECT 'error' AS level, 'parent code not found' AS rule, 'r3' AS key, 'geo' AS message FROM region WHERE r_regionkey = 3",
)
def hierarchy_orphans(spark, sf):
    return H.build_hierarchy(_geo_rows(Tables(spark, sf)))[1]


@query(
    "code_list_prefix",
    """WITH c AS (SELECT DISTINCT regexp_replace(p_brand, '^Brand#', '') AS code FROM part
      UNION SELECT DISTINCT lpad(CAST(p_partkey AS VARCHAR), 6, '0') FROM part)
    SELECT a.code, max(b.code) AS parent_code FROM c a LEFT JOIN c b
      ON b.code < a.code AND starts_with(a.code, rtrim(b.code, '0'))
    GROUP BY a.code""",
)
def code_list_prefix(spark, sf):
    p = Tables(spark, sf).part
    codes = p.select(F.regexp_replace("p_brand", "^Brand#", "").alias("code")).unionByName(
        p.select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("code"))
    )
    return H.infer_hierarchy(codes)


@query(
    "code_list_total",
    """WITH c AS (SELECT DISTINCT lpad(CAST(p_partkey * 10 AS VARCHAR), 7, '0') AS code FROM part UNION SELECT '0000000')
    SELECT a.code, max(b.code) AS parent_code FROM c a LEFT JOIN c b ON b.code < a.code AND starts_with(a.code, rtrim(b.code, '0'))
    GROUP BY a.code""",
)
def code_list_total(spark, sf):
    """A code of zeros alone is the total above all others."""
    p = Tables(spark, sf).part
    codes = p.select(F.lpad((F.col("p_partkey") * 10).cast("string"), 7, "0").alias("code"))
    return H.infer_hierarchy(codes.unionByName(inline(spark, [("0000000",)], "code string")))


@query(
    "hierarchy_codes",
    """SELECT 'geo' AS codelist, n_name AS code, 'nation of ' || r_name AS description, 1 AS level, r_name AS parent_code
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def hierarchy_codes(spark, sf):
    t = Tables(spark, sf)
    codes = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit("geo").alias("codelist"), F.col("n_name").alias("code"), F.concat(F.lit("nation of "), "r_name").alias("description"),
        F.lit(1).alias("level"), F.col("r_name").alias("parent_code"),
    )
    return H.hierarchy_to_codes(H.codes_to_hierarchy(codes))


@query(
    "with_depth",
    f"WITH {TREE} SELECT DISTINCT node, CAST(CASE left(node, 1) WHEN 'R' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS INT) AS depth FROM (SELECT parent AS node FROM tree UNION ALL SELECT child FROM tree)",
)
def with_depth(spark, sf):
    e = tree(Tables(spark, sf))
    nodes = e.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    return H.with_depth(nodes, "node", e).select("node", F.col("depth").cast("int").alias("depth"))


@query(
    "contain",
    """WITH f AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS node, 'N' || CAST(s_nationkey AS VARCHAR) AS parent, s_acctbal FROM supplier),
    flows AS (SELECT node, 'balance' AS flow, s_acctbal AS value, parent FROM f
      UNION ALL SELECT node, 'credit', s_acctbal, parent FROM f WHERE s_acctbal > 5000),
    copies AS (SELECT parent || '.' || node AS node, flow, 0.5 * value AS value, parent FROM flows)
    SELECT node, flow, round(value, 4) AS value FROM copies
    UNION ALL SELECT node, flow, round(sum(value), 4) FROM (
      SELECT parent AS node, flow, value FROM copies
      UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), 'balance', 1000.0 FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)) GROUP BY 1, 2""",
)
def contain(spark, sf):
    t = Tables(spark, sf)
    s = t.supplier
    pairs = s.select(tag("N", "s_nationkey").alias("parent"), tag("S", "s_suppkey").alias("child"), F.lit(0.5).alias("factor"))
    flows = union_all(
        [
            s.select(tag("S", "s_suppkey").alias("node"), F.lit("balance").alias("flow"), F.col("s_acctbal").alias("value")),
            s.filter("s_acctbal > 5000").select(tag("S", "s_suppkey").alias("node"), F.lit("credit").alias("flow"), F.col("s_acctbal").alias("value")),
            t.nation.select(tag("N", "n_nationkey").alias("node"), F.lit("balance").alias("flow"), F.lit(1000.0).alias("value")),
        ]
    )
    return rounded(H.contain(pairs, flows), 4)


@query(
    "scale_subtree",
    """SELECT 'C' || CAST(c_custkey AS VARCHAR) AS node, round(c_acctbal * CASE WHEN n_regionkey = 1 THEN 3.0 ELSE 1.0 END
      * CASE WHEN n_name = 'NATION_1' THEN 0.5 ELSE 1.0 END, 4) AS value
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def scale_subtree(spark, sf):
    t = Tables(spark, sf)
    v = t.customer.select(tag("C", "c_custkey").alias("node"), F.col("c_acctbal").alias("value"))
    k = t.region.filter("r_regionkey = 1").select(tag("R", "r_regionkey").alias("node"), F.lit(3.0).alias("factor")).unionByName(
        t.nation.filter("n_name = 'NATION_1'").select(tag("N", "n_nationkey").alias("node"), F.lit(0.5).alias("factor"))
    )
    return rounded(H.scale_subtree(v, tree(t), k), 4)


# Links: every customer has a supplier; both sit below their nation.
LINK_HOPS = f"""
place AS (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS node, 'N' || CAST(c_nationkey AS VARCHAR) AS n, 'R' || CAST(n_regionkey AS VARCHAR) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'N' || CAST(s_nationkey AS VARCHAR), 'R' || CAST(n_regionkey AS VARCHAR) FROM supplier JOIN nation ON s_nationkey = n_nationkey),
link AS (SELECT c_custkey AS link, 'S' || CAST(s_suppkey AS VARCHAR) AS src, 'C' || CAST(c_custkey AS VARCHAR) AS dst, abs(s_acctbal) AS extension FROM {PAIRED_SQL}),
stops AS (SELECT link, extension, CASE WHEN a.n = b.n THEN [src, dst] WHEN a.r = b.r THEN [src, a.n, b.n, dst] ELSE [src, a.n, a.r, b.r, b.n, dst] END AS s
  FROM link JOIN place a ON a.node = src JOIN place b ON b.node = dst),
hops AS (SELECT link, extension, CAST(i AS INT) AS hop, s[i] AS src, s[i + 1] AS dst FROM (SELECT link, extension, s, unnest(range(1, len(s))) AS i FROM stops))
"""


def _links(t: Tables):
    links = paired(t).select(
        F.col("c_custkey").alias("link"), tag("S", "s_suppkey").alias("src"), tag("C", "c_custkey").alias("dst"),
        F.abs("s_acctbal").alias("extension"),
    )
    part_of = tree(t).select("parent", "child").unionByName(
        t.supplier.select(tag("N", "s_nationkey").alias("parent"), tag("S", "s_suppkey").alias("child"))
    )
    return links, part_of


@query("link_hops", f"WITH {LINK_HOPS} SELECT link, hop, src, dst FROM hops")
def link_hops(spark, sf):
    return H.link_hops(*_links(Tables(spark, sf)))


@query("link_flows", f"WITH {LINK_HOPS} SELECT src, dst, round(sum(extension), 3) AS extension FROM hops GROUP BY 1, 2")
def link_flows(spark, sf):
    links, part_of = _links(Tables(spark, sf))
    return rounded(H.impute_links(links, H.link_hops(links, part_of)), 3)


@query(
    "components",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, -1 - o_custkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    cc(node, component) USING KEY (node) AS (
      SELECT a, a FROM both_ways GROUP BY a
      UNION SELECT w.b, min(cc.component) FROM cc JOIN both_ways w ON w.a = cc.node JOIN recurring.cc AS k ON k.node = w.b
      WHERE cc.component < k.component GROUP BY w.b)
    SELECT node, component FROM cc""",
)
def components(spark, sf):
    t = Tables(spark, sf)
    e = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("src"), (-1 - F.col("o_custkey")).alias("dst")
    )
    return H.components(e)


# -- flow graphs ------------------------------------------------------------------------
# Flows from orders to suppliers with the share of the order; the share of the returned lines
# is unknown, and an edge whose lines were all open has no weight either.
SHARES = """
pairs AS (SELECT l_orderkey AS o, l_suppkey AS s, sum(l_quantity) AS q, bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS unknown FROM lineitem GROUP BY 1, 2),
tot AS (SELECT o, sum(q) AS t FROM pairs GROUP BY o),
e AS (SELECT 'O' || CAST(o AS VARCHAR) AS src, 'S' || CAST(s AS VARCHAR) AS dst, CASE WHEN NOT unknown THEN q / t END AS weight FROM pairs JOIN tot USING (o))
"""

WEIGHTS = f"""
{SHARES},
d0 AS (SELECT src, count(*) AS n, count(weight) AS have, coalesce(sum(weight), 0.0) AS total FROM e GROUP BY src),
d AS (SELECT src, dst, CASE WHEN weight IS NOT NULL THEN weight WHEN n = 1 THEN 1.0
        WHEN n - have = 1 AND total <= 1.0 THEN 1.0 - total END AS weight,
      (n > 1 AND ((n - have = 1 AND total <= 1.0) OR (n = have AND abs(total - 1.0) <= 1e-9))) AS src_split FROM e JOIN d0 USING (src)),
r0 AS (SELECT dst, count(*) AS n FROM d GROUP BY dst),
w AS (SELECT src, dst, weight, CASE WHEN n = 1 AND weight IS NOT NULL THEN CASE WHEN weight = 0 THEN 0.0 ELSE 1.0 / weight END WHEN n = 1 THEN 1.0 END AS reverse_weight,
      src_split, false AS dst_split FROM d JOIN r0 USING (dst))
"""


def shares(t: Tables):
    pairs = t.lineitem.groupBy("l_orderkey", "l_suppkey").agg(
        F.sum("l_quantity").alias("q"), F.max((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("unknown")
    )
    total = pairs.groupBy("l_orderkey").agg(F.sum("q").alias("t"))
    return pairs.join(total, "l_orderkey").select(
        tag("O", "l_orderkey").alias("src"), tag("S", "l_suppkey").alias("dst"),
        F.when(~F.col("unknown"), F.col("q") / F.col("t")).alias("weight"),
    )


@query(
    "weights_infer",
    f"WITH {WEIGHTS} SELECT src, dst, round(weight, 8) AS weight, round(reverse_weight, 6) AS reverse_weight, src_split, dst_split FROM w",
)
def weights_infer(spark, sf):
    done, _ = G.complete_weights(shares(Tables(spark, sf)))
    return rounded(rounded(done, 8, "weight"), 6, "reverse_weight")


@query(
    "weights_missing",
    f"WITH {WEIGHTS} SELECT 'warning' AS level, 'edges without weight' AS rule, src AS key, CAST(count(*) AS VARCHAR) AS message FROM w WHERE weight IS NULL GROUP BY src",
)
def weights_missing(spark, sf):
    return G.complete_weights(shares(Tables(spark, sf)))[1]


@query(
    "computation_edges",
    f"""WITH {WEIGHTS}, c AS (
      SELECT dst AS node, src AS input, weight, true AS direct, dst_split AS split FROM w
      UNION ALL SELECT src, dst, reverse_weight, false, src_split FROM w),
    n AS (SELECT node, direct, count(*) AS n_inputs FROM c GROUP BY 1, 2)
    SELECT node, input, round(weight, 6) AS weight, direct, split, n_inputs FROM c JOIN n USING (node, direct)""",
)
def computation_edges(spark, sf):
    done, _ = G.complete_weights(shares(Tables(spark, sf)))
    return rounded(G.computation_edges(done), 6, "weight")


# Money flows region -> nation -> customer; nations get a share by customers, customers by balance.
FLOW = """
cn AS (SELECT c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1),
rn AS (SELECT n_regionkey AS r, n_nationkey AS n, k FROM nation JOIN cn ON n = n_nationkey),
rt AS (SELECT r, sum(k) AS t FROM rn GROUP BY r),
bal AS (SELECT c_nationkey AS n, sum(abs(c_acctbal)) AS t FROM customer GROUP BY 1),
e1 AS (SELECT 'R' || CAST(r AS VARCHAR) AS src, 'N' || CAST(n AS VARCHAR) AS dst, k / t AS weight FROM rn JOIN rt USING (r)),
e2 AS (SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS src, 'C' || CAST(c_custkey AS VARCHAR) AS dst, abs(c_acctbal) / t AS weight FROM customer JOIN bal ON n = c_nationkey),
start AS (SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS node, (1000.0 * (r_regionkey + 1))::DOUBLE AS value FROM region)
"""


def money_edges(t: Tables):
    cn = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"), F.sum(F.abs("c_acctbal")).alias("t"))
    rn = t.nation.join(cn, F.col("n_nationkey") == F.col("c_nationkey"))
    rt = rn.groupBy("n_regionkey").agg(F.sum("k").alias("rt"))
    first = rn.join(rt, "n_regionkey").select(tag("R", "n_regionkey").alias("src"), tag("N", "n_nationkey").alias("dst"), (F.col("k") / F.col("rt")).alias("weight"))
    second = t.customer.join(cn, "c_nationkey").select(tag("N", "c_nationkey").alias("src"), tag("C", "c_custkey").alias("dst"), (F.abs("c_acctbal") / F.col("t")).alias("weight"))
    return first.unionByName(second)


@query(
    "propagate_fixpoint",
    f"""WITH {FLOW}, n AS (SELECT dst AS node, weight * value AS value FROM e1 JOIN start ON node = src),
    c AS (SELECT e2.dst AS node, e2.weight * n.value AS value FROM e2 JOIN n ON n.node = e2.src)
    SELECT node, round(value, 6) AS value, false AS computed FROM start
    UNION ALL SELECT node, round(value, 6), true FROM n UNION ALL SELECT node, round(value, 6), true FROM c""",
)
def propagate_fixpoint(spark, sf):
    t = Tables(spark, sf)
    start = t.region.select(tag("R", "r_regionkey").alias("node"), (F.lit(1000.0) * (F.col("r_regionkey") + 1)).alias("value"))
    done, _ = G.complete_weights(money_edges(t))
    return rounded(G.compute_values(G.computation_edges(done), start), 6)


@query(
    "propagate_backwards",
    f"""WITH {FLOW}, c AS (SELECT e2.src AS node, e2.dst AS input, 100.0 / e2.weight AS v FROM e2),
    n AS (SELECT node, min_by(v, input) AS value FROM c GROUP BY node),
    r AS (SELECT e1.src AS node, min_by(n.value / e1.weight, e1.dst) AS value FROM e1 JOIN n ON n.node = e1.dst GROUP BY 1)
    SELECT node, round(value, 4) AS value FROM n UNION ALL SELECT node, round(value, 4) FROM r""",
)
def propagate_backwards(spark, sf):
    """Every customer is known: nations and regions are split nodes and take one of them."""
    t = Tables(spark, sf)
    done, _ = G.complete_weights(money_edges(t))
    known = t.customer.select(tag("C", "c_custkey").alias("node"), F.lit(100.0).alias("value"))
    out = G.compute_values(G.computation_edges(done), known).filter("computed").drop("computed")
    return rounded(out, 4)


@query(
    "known_conflicts",
    f"""WITH {FLOW}, e AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2),
    prev AS (SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS node FROM region),
    fresh AS (SELECT 'N' || CAST(s_nationkey AS VARCHAR) AS node FROM supplier WHERE s_acctbal > 5000 GROUP BY 1
      UNION SELECT 'C' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 5000),
    dn AS (SELECT src AS node, dst AS conflicting FROM e UNION SELECT a.src, b.dst FROM e1 a JOIN e2 b ON b.src = a.dst)
    SELECT node, conflicting FROM dn WHERE conflicting IN (SELECT node FROM fresh) AND (node IN (SELECT node FROM prev) OR node IN (SELECT node FROM fresh))""",
)
def known_conflicts(spark, sf):
    t = Tables(spark, sf)
    inputs = G.computation_edges(money_edges(t))
    prev = t.region.select(tag("R", "r_regionkey").alias("node"))
    fresh = t.supplier.filter("s_acctbal > 5000").select(tag("N", "s_nationkey").alias("node")).distinct().unionByName(
        t.customer.filter("c_acctbal > 5000").select(tag("C", "c_custkey").alias("node"))
    )
    return G.known_conflicts(inputs, prev, fresh)


@query(
    "cascade",
    """SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS node, round(0.1 * (n_nationkey + 1) * 50.0 * (n_regionkey + 1), 6) AS value FROM nation
    UNION ALL SELECT 'R' || CAST(r_regionkey AS VARCHAR), round(50.0 * (r_regionkey + 1), 6) FROM region
    UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), round(0.1 * (n_nationkey + 1) * 50.0 * (n_regionkey + 1) - c_acctbal, 6) FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'B' || CAST(c_custkey AS VARCHAR), round(c_acctbal, 6) FROM customer""",
)
def cascade(spark, sf):
    """Nation = k x region; nation = customer + balance, solved for the customer."""
    t = Tables(spark, sf)
    defs = union_all(
        [
            t.nation.select(tag("N", "n_nationkey").alias("code"), tag("R", "n_regionkey").alias("term"), (F.lit(0.1) * (F.col("n_nationkey") + 1)).alias("coefficient")),
            t.customer.select(tag("C", "c_custkey").alias("code"), tag("N", "c_nationkey").alias("term"), F.lit(1.0).alias("coefficient")),
            t.customer.select(tag("C", "c_custkey").alias("code"), tag("B", "c_custkey").alias("term"), F.lit(-1.0).alias("coefficient")),
        ]
    )
    known = t.region.select(tag("R", "r_regionkey").alias("node"), (F.lit(50.0) * (F.col("r_regionkey") + 1)).alias("value")).unionByName(
        t.customer.select(tag("B", "c_custkey").alias("node"), F.col("c_acctbal").alias("value"))
    )
    return rounded(G.cascade(defs, known), 6)


@query(
    "unresolved",
    """SELECT s AS scenario, CAST(y AS VARCHAR) AS period, 'C' || CAST(c_custkey AS VARCHAR) AS node, 'warning' AS level, 'unresolved in Flow' AS rule,
      'C' || CAST(c_custkey AS VARCHAR) AS key, s || '/' || CAST(y AS VARCHAR) AS message
    FROM customer, (SELECT unnest(['base', 'high']) AS s), (SELECT DISTINCT year(o_orderdate) AS y FROM orders)
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = y)""",
)
def unresolved(spark, sf):
    t = Tables(spark, sf)
    years = t.orders.select(F.year("o_orderdate").cast("string").alias("period")).distinct()
    grid = years.withColumn("scenario", F.explode(F.array(F.lit("base"), F.lit("high")))).select("scenario", "period")
    have = t.orders.select(F.year("o_orderdate").cast("string").alias("period"), tag("C", "o_custkey").alias("node")).distinct()
    have = have.withColumn("scenario", F.explode(F.array(F.lit("base"), F.lit("high"))))
    edges = t.customer.select(tag("C", "c_custkey").alias("src"))
    return G.unresolved(edges, have, grid, "Flow")


@query(
    "conflicts",
    """WITH rolled AS (SELECT c_nationkey AS n, sum(c_acctbal) AS v FROM customer GROUP BY 1),
    seen AS (SELECT s_nationkey AS n, sum(s_acctbal) AS v, count(*) AS k FROM supplier GROUP BY 1),
    c AS (SELECT 'N' || CAST(n AS VARCHAR) AS node, rolled.v AS new_value, seen.v AS old_value, CASE WHEN k > 4 THEN 'Flow' WHEN k > 3 THEN 'Scale' END AS old_source FROM rolled JOIN seen USING (n))
    SELECT node, round(new_value, 2) AS value, 'PartOfAggregation' AS source, CASE WHEN old_source = 'Flow' THEN 'Taken' ELSE 'Dismissed' END AS conflict FROM c
    UNION ALL SELECT node, round(old_value, 2), old_source, CASE WHEN old_source = 'Flow' THEN 'Dismissed' ELSE 'Taken' END FROM c""",
)
def conflicts(spark, sf):
    t = Tables(spark, sf)
    rolled = t.customer.groupBy(tag("N", "c_nationkey").alias("node")).agg(F.sum("c_acctbal").alias("new_value"))
    seen = t.supplier.groupBy(tag("N", "s_nationkey").alias("node")).agg(F.sum("s_acctbal").alias("existing_value"), F.count(F.lit(1)).alias("k"))
    cands = rolled.join(seen, "node").select(
        "node", "new_value", F.lit("PartOfAggregation").alias("new_source"), "existing_value",
        F.when(F.col("k") > 4, "Flow").when(F.col("k") > 3, "Scale").alias("existing_source"),
    )
    return rounded(resolve_conflicts(cands, Policy()), 2)
