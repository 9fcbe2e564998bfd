"""Data checks as queries: every check returns level, rule, key, message."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyflow.operators import filters as Q
from tallyflow.operators import hierarchy as H
from tallyflow.operators import issues as V
from tallyflow.plans.registry import PAIRED_SQL, Tables, inline, paired, query
from tallyflow.plans.trees import TREE, tag, tree
from tallyflow.runtime import union_all


def _sql(level: str, rule: str, key: str, message: str, rest: str) -> str:
    return f"SELECT '{level}' AS level, '{rule}' AS rule, {key} AS key, {message} AS message {rest}"


@query(
    "issues_duplicates",
    _sql("error", "duplicate key", "CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)", "CAST(count(*) AS VARCHAR) || ' rows'",
         "FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1"),
)
def issues_duplicates(spark, sf):
    return V.duplicate_keys(Tables(spark, sf).lineitem, ["l_orderkey", "l_suppkey"])


@query(
    "issues_unknown_codes",
    _sql("error", "code not in code list", "n_name", "'not found'",
         "FROM (SELECT DISTINCT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE n_name NOT IN (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000)"),
)
def issues_unknown_codes(spark, sf):
    t = Tables(spark, sf)
    used = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    codes = t.supplier.filter("s_acctbal > 5000").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lower("n_name").alias("code"))
    return V.unknown_codes(used, "n_name", codes)


@query(
    "issues_mandatory",
    _sql("error", "mandatory field", "CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)", "'discount'",
         "FROM lineitem WHERE l_discount = 0 AND l_returnflag = 'R' UNION ALL "
         "SELECT 'error', 'mandatory field', CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR), 'tax' FROM lineitem WHERE l_tax = 0"),
)
def issues_mandatory(spark, sf):
    li = Tables(spark, sf).lineitem.select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount"), F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("tax")
    )
    return V.mandatory_fields(li, {"discount": "l_returnflag = 'R'", "tax": None}, ["l_orderkey", "l_linenumber"])


@query(
    "issues_allowed_values",
    _sql("error", "value not allowed", "CAST(o_orderkey AS VARCHAR)", "'o_orderstatus=' || o_orderstatus", "FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"),
)
def issues_allowed_values(spark, sf):
    return V.allowed_values(Tables(spark, sf).orders, {"o_orderstatus": ["f", "o"]}, ["o_orderkey"])


@query(
    "issues_parameter_domain",
    _sql("error", "value outside domain", "c_name", "CAST(c_acctbal AS VARCHAR) || ' not in [0,9000)'",
         "FROM customer WHERE c_acctbal < 0 OR c_acctbal >= 9000 UNION ALL "
         "SELECT 'error', 'value outside domain', n_name, r_name || ' not in areas' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
)
def issues_parameter_domain(spark, sf):
    t = Tables(spark, sf)
    numbers = t.customer.select(F.col("c_name").alias("name"), F.lit("Number").alias("type"), F.lit("[0,9000)").alias("domain"), F.col("c_acctbal").cast("string").alias("value"))
    codes = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("name"), F.lit("Code").alias("type"), F.lit("areas").alias("domain"), F.col("r_name").alias("value")
    )
    known = t.region.filter("r_name <> 'ASIA'").select(F.lit("Areas").alias("hierarchy"), F.lower("r_name").alias("code"))
    return V.parameter_domain(numbers.unionByName(codes), known)


@query(
    "issues_periods",
    _sql("error", "mixed period kinds", "'month,year'", "'2'", "FROM region WHERE r_regionkey = 0 UNION ALL "
         "SELECT DISTINCT 'error', 'invalid period', 'week ' || CAST(year(o_orderdate) AS VARCHAR), 'not a period' FROM orders WHERE o_orderstatus = 'P'"),
)
def issues_periods(spark, sf):
    o = Tables(spark, sf).orders
    p = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM")).when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy"))
    return V.mixed_periods(o.select(p.otherwise(F.concat(F.lit("week "), F.date_format("o_orderdate", "yyyy"))).alias("period")), "period")


@query(
    "issues_repeated_observations",
    _sql("error", "repeated observation", "CAST(user_id AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d') || '|' || event_type", "CAST(count(*) AS VARCHAR) || ' rows'",
         "FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d'), event_type HAVING count(*) > 1"),
)
def issues_repeated_observations(spark, sf):
    e = Tables(spark, sf).events.select(F.col("user_id").alias("node"), F.date_format("ts", "yyyy-MM-dd").alias("period"), F.upper("event_type").alias("observer"))
    return V.repeated_observations(e)


@query(
    "issues_attribute_types",
    _sql("error", "attribute type", "CAST(o_orderkey AS VARCHAR)", "'found String'", "FROM orders WHERE o_orderstatus = 'P'"),
)
def issues_attribute_types(spark, sf):
    o = Tables(spark, sf).orders
    v = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")).otherwise(F.col("o_totalprice").cast("string"))
    return V.attribute_types(o.select("o_orderkey", v.alias("v")), "v", "Float", ["o_orderkey"])


@query(
    "issues_flow_orientation",
    f"""WITH RECURSIVE {TREE}, f AS (SELECT 'N' || CAST(s_nationkey AS VARCHAR) AS src, 'N' || CAST(c_nationkey AS VARCHAR) AS dst FROM {PAIRED_SQL} WHERE s_nationkey <> c_nationkey
      UNION SELECT parent, child FROM tree WHERE parent LIKE 'R%'),
    o AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS node, CASE WHEN n_regionkey < 2 THEN 'Input' ELSE 'Output' END AS o FROM nation UNION ALL SELECT 'R' || CAST(r_regionkey AS VARCHAR), 'Input' FROM region),
    j AS (SELECT f.*, a.o AS ao, b.o AS bo, EXISTS (SELECT 1 FROM tree t WHERE (a.o = 'Output' AND t.parent = f.dst AND t.child = f.src) OR (a.o = 'Input' AND t.parent = f.src AND t.child = f.dst)) AS kin
      FROM f JOIN o a ON a.node = src JOIN o b ON b.node = dst)
    SELECT 'error' AS level, 'flow orientation' AS rule, src || ' -> ' || dst AS key, CASE WHEN ao = bo THEN 'same orientation but not parent and child' ELSE 'source orientation must be output' END AS message
    FROM j WHERE (ao = bo AND NOT kin) OR (ao <> bo AND ao <> 'Output')""",
)
def issues_flow_orientation(spark, sf):
    t = Tables(spark, sf)
    f = paired(t).filter("s_nationkey <> c_nationkey").select(
        tag("N", "s_nationkey").alias("src"), tag("N", "c_nationkey").alias("dst")
    )
    part_of = tree(t).select("parent", "child")
    f = f.unionByName(part_of.filter(F.col("parent").startswith("R")).select(F.col("parent").alias("src"), F.col("child").alias("dst"))).distinct()
    faces = t.nation.select(tag("N", "n_nationkey").alias("node"), F.when(F.col("n_regionkey") < 2, "Input").otherwise("Output").alias("orientation")).unionByName(
        t.region.select(tag("R", "r_regionkey").alias("node"), F.lit("Input").alias("orientation"))
    )
    return V.flow_orientation(f, faces.withColumn("processor", F.col("node")), part_of)


@query(
    "issues_missing_refs",
    _sql("warning", "reference not found", "CAST(c_custkey + 1000000000 AS VARCHAR)", "'not declared'", "FROM customer WHERE c_custkey % 7 = 0"),
)
def issues_missing_refs(spark, sf):
    """Every seventh reference leads nowhere."""
    t = Tables(spark, sf)
    known = t.customer.select("c_custkey")
    refs = known.withColumn("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey") + 1_000_000_000).otherwise(F.col("c_custkey")))
    return V.missing_refs(refs, "c_custkey", known, "c_custkey")


# Partial names: every nation number, some alone and some below their region.
NAMES = """names AS (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS name FROM nation UNION ALL SELECT 'r' || CAST(n_regionkey AS VARCHAR) || '.N' || CAST(n_nationkey AS VARCHAR) FROM nation
  UNION ALL SELECT 'Building' FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'nobody' FROM region WHERE r_regionkey = 0)"""


def _names(t: Tables):
    """Nations below regions; below every nation one node per market segment of its customers."""
    segments = t.customer.select(
        tag("N", "c_nationkey").alias("parent"), F.concat(tag("N", "c_nationkey"), F.lit("/"), F.initcap("c_mktsegment")).alias("child")
    ).distinct()
    regions = t.nation.select(tag("R", "n_regionkey").alias("parent"), tag("N", "n_nationkey").alias("child"))
    edges = regions.unionByName(segments)
    p = H.paths(edges).withColumn("path", F.regexp_replace("path", r"\.N\d+/", "."))
    names = union_all(
        [
            t.nation.select(tag("N", "n_nationkey").alias("name")),
            t.nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("."), tag("N", "n_nationkey")).alias("name")),
            t.region.filter("r_regionkey = 0").select(F.explode(F.array(F.lit("Building"), F.lit("nobody"))).alias("name")),
        ]
    )
    procs = p.select(F.col("node").alias("processor")).distinct()
    return Q.resolve_names(procs, p, names)


RESOLVED = f"""{NAMES}, found AS (SELECT name, CASE WHEN name = 'nobody' THEN 0 WHEN name = 'Building' THEN (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_mktsegment = 'BUILDING') ELSE 1 END AS matches FROM names)"""


@query(
    "resolve_names",
    f"""WITH {RESOLVED} SELECT found.name, matches, CASE WHEN matches = 1 THEN 'R' || CAST(n_regionkey AS VARCHAR) || '.N' || CAST(n_nationkey AS VARCHAR) END AS path
    FROM found LEFT JOIN nation ON 'N' || CAST(n_nationkey AS VARCHAR) = split_part(upper(found.name), '.', -1)""",
)
def resolve_names(spark, sf):
    return _names(Tables(spark, sf))


@query(
    "issues_ambiguous_names",
    f"WITH {RESOLVED} SELECT 'error' AS level, 'ambiguous or unknown name' AS rule, name AS key, CAST(matches AS VARCHAR) || ' matches' AS message FROM found WHERE matches <> 1",
)
def issues_ambiguous_names(spark, sf):
    return V.ambiguous_names(_names(Tables(spark, sf)))


@query(
    "issues_pivot_too_large",
    """WITH s AS (SELECT count(DISTINCT l_orderkey) * count(DISTINCT l_suppkey) AS n FROM lineitem)
    SELECT 'error' AS level, 'pivot too large' AS rule, 'l_orderkey,l_suppkey' AS key, CAST(n AS VARCHAR) AS message FROM s WHERE n > 40000""",
)
def issues_pivot_too_large(spark, sf):
    return V.pivot_too_large(Tables(spark, sf).lineitem, ["l_orderkey"], ["l_suppkey"])


@query(
    "issues_behave_as",
    """WITH i AS (SELECT DISTINCT user_id AS p, event_type || '_' || CAST(event_id % 10 AS VARCHAR) AS e FROM events),
    b AS (SELECT user_id AS child, max(u2) AS other FROM (SELECT DISTINCT user_id, user_id + 1 AS u2 FROM events) GROUP BY 1)
    SELECT 'error' AS level, 'behave-as interface missing' AS rule, CAST(child AS VARCHAR) || ':' || e AS key, CAST(other AS VARCHAR) AS message
    FROM b JOIN i ON i.p = other WHERE NOT EXISTS (SELECT 1 FROM i k WHERE k.p = child AND k.e = i.e)""",
)
def issues_behave_as(spark, sf):
    e = Tables(spark, sf).events
    interface = F.concat_ws("_", "event_type", (F.col("event_id") % 10).cast("string"))
    faces = e.select(F.col("user_id").alias("processor"), interface.alias("interface")).distinct()
    b = e.select(F.lit("all").alias("parent"), F.col("user_id").alias("child"), (F.col("user_id") + 1).alias("behave_as")).distinct()
    return V.behave_as_gaps(b, faces)


@query(
    "lookup_by_attr",
    """SELECT CAST(v AS VARCHAR) AS value, (SELECT min(p_name || '#' || CAST(p_partkey AS VARCHAR)) FROM part WHERE p_size = v) AS found FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS v FROM lineitem)""",
)
def lookup_by_attr(spark, sf):
    t = Tables(spark, sf)
    parts = t.part.select(
        F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("name"),
        F.create_map(F.lit("size"), F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("attributes"),
    )
    wanted = t.lineitem.select(F.col("l_quantity").cast("long").cast("string").alias("value")).distinct()
    return Q.lookup_by_attr(parts, "size", wanted, "name")


@query(
    "select_processors",
    f"""WITH {TREE} SELECT 'C' || CAST(c_custkey AS VARCHAR) AS processor, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE n_regionkey = 2 AND c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_acctbal > 0""",
)
def select_processors(spark, sf):
    t = Tables(spark, sf)
    procs = t.customer.select(tag("C", "c_custkey").alias("processor"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    picked = Q.select_processors(procs, "segment in ('BUILDING', 'HOUSEHOLD') and c_acctbal > 0", "R2", H.closure(tree(t), inline(spark, [("R2",)], "node string")))
    return picked.select("processor", "segment")


@query(
    "flatten_paths",
    """SELECT 'C' || CAST(c_custkey AS VARCHAR) AS node, 'R' || CAST(n_regionkey AS VARCHAR) AS region, 'N' || CAST(n_nationkey AS VARCHAR) AS nation, 'C' || CAST(c_custkey AS VARCHAR) AS customer,
      c_mktsegment AS flow, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS value FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def flatten_paths(spark, sf):
    t = Tables(spark, sf)
    flows = t.customer.select(
        tag("C", "c_custkey").alias("node"), F.col("c_mktsegment").alias("flow"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("value"),
    )
    return Q.flatten_paths(H.paths(tree(t)), flows, ["region", "nation", "customer"])
