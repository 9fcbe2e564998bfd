"""Queries of outputs that stand beside the main ones: graph tables, selections, helper columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.functions import scalar as X
from tallyflow.operators import export as E
from tallyflow.operators import filters as Q
from tallyflow.operators import hierarchy as H
from tallyflow.plans.registry import Tables, inline, query
from tallyflow.plans.trees import TREE, tag, tree


def _faces(t: Tables):
    """Two interfaces a customer (money, and debt relative to it) and one per nation."""
    face = lambda df, letter, key, kind: df.select(
        tag(letter, key).alias("processor"), F.lit(kind).alias("type"), F.concat(tag(letter, key), F.lit(f":{kind}")).alias("node")
    )
    customers = face(t.customer, "C", "c_custkey", "Money").unionByName(face(t.customer, "C", "c_custkey", "Debt"))
    return customers.unionByName(face(t.nation, "N", "n_nationkey", "Pool"))


def _interface_graph(t: Tables):
    c = t.customer
    observed = c.select(
        F.concat(tag("C", "c_custkey"), F.lit(":Money")).alias("node"), F.lit("2020").alias("period"), F.col("c_mktsegment").alias("observer"),
        F.col("c_nationkey").cast("string").alias("value"), F.lit(None).cast("string").alias("relative_to"),
    ).unionByName(
        c.filter("c_acctbal < 0").select(
            F.concat(tag("C", "c_custkey"), F.lit(":Debt")).alias("node"), F.lit("2020").alias("period"), F.lit(None).cast("string").alias("observer"),
            F.lit("0.5").alias("value"), F.lit("Money").alias("relative_to"),
        )
    )
    to_nation = lambda: F.concat(tag("N", "c_nationkey"), F.lit(":Pool"))
    flows = c.select(F.concat(tag("C", "c_custkey"), F.lit(":Money")).alias("src"), to_nation().alias("dst"), F.lit(None).cast("string").alias("weight"))
    scales = c.filter("c_acctbal > 9000").select(to_nation().alias("src"), F.concat(tag("C", "c_custkey"), F.lit(":Debt")).alias("dst"), F.lit("2").alias("weight"))
    transforms = inline(t.spark, [("Money", "Debt", "0.1")], "source_type string, target_type string, weight string")
    return E.interface_graph(_faces(t), observed, flows, scales, transforms)


@query(
    "interface_graph_edges",
    """WITH c AS (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS p, 'N' || CAST(c_nationkey AS VARCHAR) || ':Pool' AS pool, * FROM customer)
    SELECT p || ':Money@2020@' || c_mktsegment AS src, p || ':Money' AS dst, 'value' AS kind, '' AS label FROM c
    UNION ALL SELECT p || ':Money', p || ':Debt', 'relative_to', '0.5' FROM c WHERE c_acctbal < 0
    UNION ALL SELECT p || ':Money', pool, 'flow', '' FROM c
    UNION ALL SELECT pool, p || ':Debt', 'scale', '2' FROM c WHERE c_acctbal > 9000
    UNION ALL SELECT p || ':Money', p || ':Debt', 'transform', '0.1' FROM c""",
)
def interface_graph_edges(spark, sf):
    return _interface_graph(Tables(spark, sf))[1]


@query(
    "interface_graph_nodes",
    """WITH c AS (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS p, * FROM customer)
    SELECT p || ':Money' AS id, 'observed' AS kind, p || ':Money' AS label FROM c
    UNION ALL SELECT p || ':Debt', CASE WHEN c_acctbal < 0 THEN 'observed' ELSE 'unobserved' END, p || ':Debt' FROM c
    UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR) || ':Pool', 'unobserved', 'N' || CAST(n_nationkey AS VARCHAR) || ':Pool' FROM nation
    UNION ALL SELECT p || ':Money@2020@' || c_mktsegment, 'value', CAST(c_nationkey AS VARCHAR) FROM c""",
)
def interface_graph_nodes(spark, sf):
    return _interface_graph(Tables(spark, sf))[0]


def _processor_graph(t: Tables):
    path = F.concat(F.lit("World."), tag("N", "c_nationkey"), F.lit("."), tag("C", "c_custkey"))
    parts = t.customer.select(path.alias("child"), F.concat(F.lit("World."), tag("N", "c_nationkey")).alias("parent"))
    nodes = parts.select(F.col("child").alias("processor")).unionByName(parts.select(F.col("parent").alias("processor")).distinct())
    at = lambda c, kind: F.concat(c, F.lit(f":{kind}"))
    nation = lambda: F.concat(F.lit("World."), tag("N", "c_nationkey"))
    scales = t.customer.filter("c_acctbal > 0").select(at(nation(), "Pool").alias("src"), at(path, "Money").alias("dst"), F.lit("3").alias("weight"))
    sent = t.customer.select(
        at(path, "Money").alias("src"), at(nation(), "Pool").alias("dst"), F.explode(F.array(F.lit("0.1"), F.when(F.col("c_acctbal") < 0, "0.2"))).alias("weight")
    ).filter("weight is not null")
    return E.processor_graph(nodes, parts, scales, sent)


@query(
    "processor_graph_nodes",
    """SELECT 'World.N' || CAST(c_nationkey AS VARCHAR) || '.C' || CAST(c_custkey AS VARCHAR) AS id, 'C' || CAST(c_custkey AS VARCHAR) AS label FROM customer
    UNION ALL SELECT DISTINCT 'World.N' || CAST(c_nationkey AS VARCHAR), 'N' || CAST(c_nationkey AS VARCHAR) FROM customer""",
)
def processor_graph_nodes(spark, sf):
    return _processor_graph(Tables(spark, sf))[0]


@query(
    "processor_graph_edges",
    """WITH c AS (SELECT 'World.N' || CAST(c_nationkey AS VARCHAR) AS n, 'World.N' || CAST(c_nationkey AS VARCHAR) || '.C' || CAST(c_custkey AS VARCHAR) AS p, c_acctbal AS b FROM customer)
    SELECT p AS src, n AS dst, 'part_of' AS kind, 1::BIGINT AS relations, '' AS label FROM c
    UNION ALL SELECT n, p, 'scale', 1, '3' FROM c WHERE b > 0
    UNION ALL SELECT p, n, 'flow', CASE WHEN b < 0 THEN 2 ELSE 1 END, CASE WHEN b < 0 THEN '2' ELSE '0.1' END FROM c""",
)
def processor_graph_edges(spark, sf):
    """Two flows between the same processors are one edge, labelled with their number."""
    return _processor_graph(Tables(spark, sf))[1]


@query(
    "results_without_dismissed",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'No' ELSE 'Taken' END AS kept FROM orders WHERE o_orderstatus IN ('F', 'O')""",
)
def results_without_dismissed(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "No").when(F.col("o_orderstatus") == "O", "Taken").otherwise("Dismissed")
    rows = Tables(spark, sf).orders.select("o_orderkey", state.alias("conflict"), state.alias("kept"))
    return Q.without_dismissed(rows)


@query(
    "match_names",
    """SELECT 'R' || CAST(n_regionkey AS VARCHAR) || '.N' || CAST(n_nationkey AS VARCHAR) || '.C' || CAST(c_custkey AS VARCHAR) AS processor
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND starts_with('C' || CAST(c_custkey AS VARCHAR), 'C1')""",
)
def match_names(spark, sf):
    """Names below a region whose last part starts with a literal."""
    t = Tables(spark, sf)
    names = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws(".", tag("R", "n_regionkey"), tag("N", "c_nationkey"), tag("C", "c_custkey")).alias("processor")
    )
    return Q.match_names(names, "R2..C1")


@query(
    "hierarchy_roots",
    f"WITH {TREE} SELECT DISTINCT parent AS node FROM tree WHERE parent NOT IN (SELECT child FROM tree) UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR) FROM supplier",
)
def hierarchy_roots(spark, sf):
    """Tops of the tree and nodes that are in no tree."""
    t = Tables(spark, sf)
    edges = tree(t)
    nodes = edges.select(F.explode(F.array("parent", "child")).alias("node")).unionByName(t.supplier.select(tag("S", "s_suppkey").alias("node")))
    return H.roots_or_isolated(nodes, edges)


@query(
    "value_helpers",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_discount END AS known,
      l_linenumber = 1 OR l_returnflag = 'R' AS same, round(l_tax * 2 * CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 1 END, 6) AS weight,
      len(list_distinct(['a.' || l_returnflag, l_returnflag]))::INTEGER AS names FROM lineitem""",
)
def value_helpers(spark, sf):
    """NaN as missing, equality of texts and numbers, transform weights with absent ratios, names of a path."""
    line = Tables(spark, sf).lineitem.withColumn("known", F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount").cast("double")))
    number = F.when(F.col("l_linenumber") == 1, "1.0").otherwise(F.lower("l_returnflag"))
    other = F.when(F.col("l_linenumber") == 1, "1").otherwise("R")
    half = F.when(F.col("l_returnflag") == "R", 0.5)
    return X.null_nan(line, "known").select(
        "l_orderkey", "l_linenumber", "known", X.same_value(number, other).alias("same"),
        F.round(X.scaled_transform_weight(F.col("l_tax").cast("double"), F.lit(2.0), half), 6).alias("weight"),
        F.size(X.name_variants(F.concat(F.lit("a."), "l_returnflag"))).alias("names"),
    )
