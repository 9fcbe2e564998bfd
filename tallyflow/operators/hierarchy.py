"""Hierarchies: building, paths, closure, roll-up, links (H-*, K-07, G-17..G-19, M-05).

Edges are ``(parent, child[, weight])``. Driver loops run one round per level; each round is
a distributed join whose result is written before the next one starts.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyflow.operators.cube import code_grid
from tallyflow.operators.cycles import cyclic_parts
from tallyflow.operators.issues import issue
from tallyflow.runtime import POSITION, Scratch, declared_first, hot_keys, skew_join, union_all

NAMED = 20  # members of cycles that an error names; ``cycle_issues`` lists all


# -- building ---------------------------------------------------------------------------
def build_hierarchy(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(hierarchy, code, parent_code, ...)`` to edges plus the parents that do not exist."""
    place = [POSITION] if POSITION in rows.columns else []
    spelled = rows.select("hierarchy", F.lower("code").alias("_k"), F.col("code").alias("parent"), *place)
    codes = declared_first(spelled, ["hierarchy", "_k"]).select("hierarchy", "_k", "parent")
    with_parent = rows.filter(F.trim(F.coalesce("parent_code", F.lit(""))) != "").withColumn(
        "_k", F.lower("parent_code")
    )
    orphans = (
        with_parent.join(codes, ["hierarchy", "_k"], "left_anti")
        .select("hierarchy", "parent_code")
        .distinct()
        .select(*issue("error", "parent code not found", F.col("parent_code"), F.col("hierarchy")))
    )
    weight = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
    # case does not matter for the match; the edge carries the spelling under which the parent is declared
    edges = with_parent.join(codes, ["hierarchy", "_k"]).select(
        "hierarchy",
        "parent",
        F.col("code").alias("child"),
        F.coalesce(weight, F.lit(1.0)).alias("weight"),
    )
    return edges, orphans


def codes_to_hierarchy(codes: DataFrame) -> DataFrame:
    """``codes(codelist, code, description, level, parent_code)`` as hierarchy rows."""
    return codes.select(
        F.col("codelist").alias("hierarchy"),
        "code",
        "parent_code",
        F.lit(1.0).alias("weight"),
        "level",
        F.col("description").alias("label"),
    )


def hierarchy_to_codes(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("hierarchy").alias("codelist"), "code", F.col("label").alias("description"), "level", "parent_code"
    )


def infer_hierarchy(codes: DataFrame, code: str = "code") -> DataFrame:
    """Parent of each code by prefix, trailing zeros of the parent ignored.

    A parent sorts before the code and its stripped text starts the code; the last such code in
    sort order wins. A code of zeros alone is stripped to nothing and starts every code: it is the total.
    Codes are expanded to their prefixes, the empty one included, so that the match is an equi-join.
    """
    all_codes = codes.select(F.col(code).alias("code")).distinct()
    stripped = all_codes.select(
        F.col("code").alias("_p"), F.regexp_replace("code", "0+$", "").alias("_prefix")
    )
    prefixes = all_codes.select(
        "code",
        F.explode(F.transform(F.sequence(F.lit(0), F.length("code")), lambda i: F.substring("code", F.lit(1), i))).alias(
            "_prefix"
        ),
    )
    found = (
        skew_join(prefixes, stripped, ["_prefix"])
        .filter(F.col("_p") < F.col("code"))
        .groupBy("code")
        .agg(F.max("_p").alias("parent_code"))
    )
    return all_codes.join(found, "code", "left")


# -- traversal --------------------------------------------------------------------------
def roots(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.col("parent").alias("node"))
        .distinct()
        .join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti")
    )


def roots_or_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are nobody's child."""
    return nodes.select("node").distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def paths(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, path, depth): full dotted names; a node with several parents has several paths."""
    scratch = Scratch(edges.sparkSession, "paths")
    edges = edges.select("parent", "child").distinct()
    start = roots(edges) if nodes is None else roots_or_isolated(nodes, edges)
    frontier = scratch.save(
        start.select("node", F.col("node").cast("string").alias("path"), F.lit(0).alias("depth")), "level"
    )
    levels = [frontier]
    step = edges.withColumnRenamed("parent", "node")
    hot = hot_keys(step, ["node"])
    while True:  # a path does not pass a node twice, so that cycles end
        open_ended = frontier.filter(
            ~F.array_contains(F.slice(F.split("path", r"\."), 1, F.col("depth")), F.col("node"))
        )
        nxt = (
            skew_join(step, open_ended, ["node"], hot=hot if hot is not None else False)
            .select(
                F.col("child").alias("node"),
                F.concat_ws(".", "path", F.col("child").cast("string")).alias("path"),
                (F.col("depth") + 1).alias("depth"),
            )
        )
        frontier = scratch.save(nxt, "level")
        if frontier.isEmpty():
            return union_all(levels)
        levels.append(frontier)


def with_depth(df: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """Add the depth of ``node`` (0 for roots and free nodes): parents sort before children."""
    # the longest way up, level by level: the number of paths of a node may be far larger than its depth
    depth = heights(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")))
    return (
        df.join(depth.select(F.col("node").alias(node), F.col("height").alias("depth")), node, "left")
        .withColumn("depth", F.coalesce("depth", F.lit(0)))
    )


def closure(edges: DataFrame, starts: DataFrame | None = None, up: bool = False) -> DataFrame:
    """(ancestor, descendant, distance): every pair once, with the shortest distance.

    With ``starts(node)`` only the pairs below these nodes are walked, or with ``up`` those above them.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    here, there = ("child", "parent") if up else ("parent", "child")
    step = edges.select(F.col(here).alias("_from"), F.col(there).alias("_to")).distinct()
    hot = hot_keys(step, ["_from"])
    first = step
    if starts is not None:
        first = step.join(starts.select(F.col("node").alias("_from")).distinct(), "_from", "left_semi")
    frontier = scratch.save(first.select(F.col("_from").alias("start"), F.col("_to").alias("end"), F.lit(1).alias("distance")), "pairs")
    frames = [frontier]
    for i in count(2):
        nxt = (
            skew_join(step, frontier.select("start", F.col("end").alias("_from")), ["_from"], hot=hot if hot is not None else False)
            .select("start", F.col("_to").alias("end"))
            .distinct()
            .join(union_all(frames).select("start", "end"), ["start", "end"], "left_anti")
            .withColumn("distance", F.lit(i))
        )
        frontier = scratch.save(nxt, "pairs")
        if frontier.isEmpty():
            break
        frames.append(frontier)
    ancestor, descendant = ("end", "start") if up else ("start", "end")
    return union_all(frames).select(F.col(ancestor).alias("ancestor"), F.col(descendant).alias("descendant"), "distance")


def heights(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, height): longest way down to a leaf. A cycle raises ``ValueError`` that names members of cycles."""
    scratch = scratch or Scratch(edges.sparkSession, "heights")
    step = edges.select("parent", "child")
    level, n = scratch.save_counted(step.select(F.col("parent").alias("node")).distinct(), "above-1")
    # only nodes that are no parents are leaves; the others are few and get their height from the levels
    children = step.select(F.col("child").alias("node")).distinct()
    leaves = children.join(level, "node", "left_anti").withColumn("height", F.lit(0))
    levels, size = [level.withColumn("height", F.lit(0))], -1
    while n:
        if n == size:
            members = [r["node"] for r in cyclic_parts(step.distinct(), "parent", "child").orderBy("node").limit(NAMED).collect()]
            raise ValueError("the hierarchy has a cycle: " + ", ".join(map(str, members)))
        size = n
        levels.append(level.withColumn("height", F.lit(len(levels))))
        above = step.join(level.withColumnRenamed("node", "child"), "child", "left_semi").select(F.col("parent").alias("node")).distinct()
        level, n = scratch.save_counted(above, f"above-{len(levels)}")
    tops = union_all(levels).groupBy("node").agg(F.max("height").alias("height"))
    return scratch.save(tops.unionByName(leaves), "heights")


# -- roll-up ----------------------------------------------------------------------------
class Levels:
    """A hierarchy by height, with what its sweeps share: the height of every node and edges that know the heights of both ends.

    Edges may carry a ``scenario``: rows without one are common to all scenarios, rows with one hold in their scenario, beside the common ones or,
    for the same parent and child, instead of them. They are kept as differences to the common edge, so that a scenario costs as
    much as it differs. Heights are those of all edges together, an order that suits every scenario."""

    def __init__(self, edges: DataFrame, scratch: Scratch, label: str = "tree"):
        self.scratch, self.label, self.differ = scratch, label, "scenario" in edges.columns
        # written: read by the heights, the counts of children and the edges
        weighted = scratch.save(edges.withColumn("weight", F.coalesce("weight", F.lit(1.0))), f"{label}-given")
        self.tops = heights(weighted, scratch)
        self.top = self.tops.agg(F.max("height")).first()[0] or 0
        over = self.tops.select(F.col("node").alias("parent"), "height")
        # a child without a height of its own is a leaf
        under = self.tops.filter("height > 0").select(F.col("node").alias("child"), F.col("height").alias("below"))
        common = weighted.filter("scenario is null") if self.differ else weighted
        rows = with_child_counts(common.select("parent", "child", "weight")).withColumn("one", F.lit(1).cast("long"))
        if self.differ:
            there = common.select("parent", "child", F.col("weight").alias("_common"))
            own = weighted.filter("scenario is not null").join(there, ["parent", "child"], "left")
            own = own.select(
                "parent", "child", (F.col("weight") - F.coalesce("_common", F.lit(0.0))).alias("weight"), F.lit(0).cast("long").alias("n_children"),
                F.col("_common").isNull().cast("long").alias("one"), "scenario",
            )
            rows = rows.withColumn("scenario", F.lit(None).cast("string")).unionByName(own)
        self.edges = scratch.save_by(rows.join(over, "parent").join(under, "child", "left").fillna(0, "below"), f"{label}-edges", "below")
        self.hot = hot_keys(self.edges, ["child"])
        if self.differ:
            self.added = scratch.save(
                self.edges.filter("scenario is not null").groupBy("scenario", F.col("parent").alias("node")).agg(F.sum("one").alias("_added")), f"{label}-added"
            )
            self.common = scratch.save(self.edges.filter("scenario is null").groupBy(F.col("parent").alias("node")).agg(F.max("n_children").alias("_common")), f"{label}-common")

    def sweep(self, keys: Sequence[str], policy: str) -> Sweep:
        if self.differ and "scenario" not in keys:
            raise ValueError("edges that differ between scenarios need values with a scenario")
        return Sweep(self, keys, policy)


class Sweep:
    """One bottom-up pass. The values of a level are read once, when they are added: they leave their share of every parent's
    sum, addressed to the parent's height, where the level of that height finds it."""

    def __init__(self, tree: Levels, keys: Sequence[str], policy: str):
        if policy not in ("Invalidate", "UseZero"):
            raise ValueError(f"unknown missing value policy {policy}")
        self.tree, self.keys, self.policy = tree, list(keys), policy
        self.shares: list[DataFrame] = []

    def add(self, height: int, values: DataFrame) -> None:
        """Values (keys, node, value) of all nodes of a height."""
        edges = self.tree.edges.filter(F.col("below") == height).drop("below").withColumnRenamed("child", "node")
        hot = self.tree.hot.withColumnRenamed("child", "node") if self.tree.hot is not None else False
        values = values.select(*self.keys, "node", "value")
        if self.tree.differ:
            rows = skew_join(edges.filter("scenario is null").drop("scenario"), values, ["node"], hot=hot)
            rows = rows.unionByName(skew_join(edges.filter("scenario is not null"), values, ["scenario", "node"], hot=False))
        else:
            rows = skew_join(edges, values, ["node"], hot=hot)
        shares = rows.groupBy(*self.keys, F.col("parent").alias("node"), "height").agg(
            F.sum(F.col("value") * F.col("weight")).alias("value"), F.sum("one").alias("known"), F.max("n_children").alias("n")
        )
        self.shares.append(self.tree.scratch.save_by(shares, f"{self.tree.label}-shares", "height"))

    def sums(self, height: int | None = None) -> DataFrame:
        """(keys, node, value) of the parents of a height, or of all; Invalidate keeps a parent only when all its children are known."""
        rows = [s if height is None else s.filter(F.col("height") == height) for s in self.shares]
        sums = union_all(rows).groupBy(*self.keys, "node").agg(F.sum("value").alias("value"), F.sum("known").alias("_known"), F.max("n").alias("_n"))
        if self.policy == "Invalidate" and self.tree.differ:
            sums = sums.join(self.tree.common, "node", "left").join(self.tree.added, ["scenario", "node"], "left")
            zero = F.lit(0).cast("long")
            sums = sums.filter(F.col("_known") == F.coalesce("_common", zero) + F.coalesce("_added", zero)).drop("_common", "_added")
        elif self.policy == "Invalidate":
            sums = sums.filter("_known = _n")
        return sums.filter("_known > 0").drop("_known", "_n")


def scenario_edges(edges: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every edge in every scenario where it holds: (scenario, parent, child, weight) from common and differing edges."""
    if "scenario" not in edges.columns:
        return edges
    own = edges.filter("scenario is not null")
    common = code_grid([edges.filter("scenario is null").drop("scenario"), scenarios.select("scenario").distinct()])
    common = common.join(own.select("scenario", "parent", "child"), ["scenario", "parent", "child"], "left_anti")
    return common.unionByName(own.select(*common.columns))


def with_child_counts(edges: DataFrame) -> DataFrame:
    counts = edges.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    return edges.join(counts, "parent")


def rollup(
    edges: DataFrame,
    values: DataFrame,
    policy: str = "Invalidate",
    keys: Sequence[str] = (),
    conflict: str = "TakeUpper",
) -> DataFrame:
    """Weighted bottom-up roll-up of ``values(keys..., node, value)``, all keys at once.

    A parent gets the weighted sum of its children. A missing child makes the parent unknown
    (``Invalidate``) or is skipped (``UseZero``). A node that has both a sum and a value of its
    own keeps its own (``TakeUpper``) or the sum (``TakeLowerAggregation``).
    Returns (keys..., node, value, computed).
    """
    keys = list(keys)
    scratch = Scratch(edges.sparkSession, "rollup")
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    edges = edges.select("parent", "child", "weight", *(["scenario"] if "scenario" in edges.columns else []))
    tree = Levels(edges, scratch)
    own = values.filter("value is not null").select(*keys, "node", F.col("value").cast("double").alias("value"))
    own = own.join(tree.tops, "node", "left").withColumn("height", F.coalesce("height", F.lit(0)))
    own = scratch.save_by(own, "own", "height")
    sweep = tree.sweep(keys, policy)

    def level(h: int) -> DataFrame:
        sums = sweep.sums(h)
        mine = own.filter(F.col("height") == h).select(*keys, "node", F.col("value").alias("_own"))
        first, second = ("_own", "value") if conflict == "TakeUpper" else ("value", "_own")
        computed = F.col("_own").isNull() if conflict == "TakeUpper" else F.col("value").isNotNull()
        both = sums.join(mine, keys + ["node"], "full_outer")
        return both.select(*keys, "node", F.coalesce(first, second).alias("value"), computed.alias("computed"))

    done = [own.filter("height = 0").select(*keys, "node", "value", F.lit(False).alias("computed"))]
    for h in range(1, tree.top + 1):
        sweep.add(h - 1, done[-1])
        done.append(scratch.save(level(h), f"level-{h}"))
    return union_all(done)


def contain(pairs: DataFrame, flows: DataFrame) -> DataFrame:
    """Put children in parents: child flows x factor, parent flow = own + sum of the child flows.

    ``pairs(parent, child, factor)``, ``flows(node, flow, value)``. A parent inherits the flows
    it lacks. Each placement is a copy named ``parent.child``.
    """
    copies = skew_join(flows.withColumnRenamed("node", "child"), pairs, ["child"]).select(
        "parent",
        F.concat_ws(".", "parent", "child").alias("node"),
        "flow",
        (F.col("value") * F.col("factor")).alias("value"),
    )
    parents = pairs.select(F.col("parent").alias("node")).distinct()
    own = flows.join(parents, "node", "left_semi")
    up = copies.select(F.col("parent").alias("node"), "flow", "value").unionByName(own)
    return copies.drop("parent").unionByName(up.groupBy("node", "flow").agg(F.sum("value").alias("value")))


def scale_subtree(values: DataFrame, edges: DataFrame, factors: DataFrame) -> DataFrame:
    """Multiply the values of a node and everything below it by ``factors(node, factor)``.

    Factors of nested subtrees multiply.
    """
    pairs = closure(edges, factors.select("node")).select(F.col("ancestor").alias("node"), F.col("descendant"))
    logs = factors.unionByName(
        pairs.join(factors, "node").select(F.col("descendant").alias("node"), "factor")
    )
    total = logs.groupBy("node").agg(F.product("factor").alias("_f"))
    return values.join(total, "node", "left").withColumn(
        "value", F.col("value") * F.coalesce("_f", F.lit(1.0))
    ).drop("_f")


# -- links between nested nodes ---------------------------------------------------------
def link_hops(links: DataFrame, part_of: DataFrame) -> DataFrame:
    """Decompose ``links(link, src, dst)`` in hops through the nearest common ancestor.

    Two nodes of different branches are joined by a hop between the siblings below the common
    ancestor; on one branch the way goes straight up or down. (link, hop, src, dst).
    """
    ends = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    above = closure(part_of, ends, up=True).select(F.col("descendant").alias("node"), "ancestor", "distance")
    chain = ends.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")).unionByName(above)
    up = links.join(chain.withColumnRenamed("node", "src"), "src").select(
        "link", "ancestor", F.col("distance").alias("_ds")
    )
    down = links.join(chain.withColumnRenamed("node", "dst"), "dst").select(
        "link", "ancestor", F.col("distance").alias("_dd")
    )
    nearest = (
        up.join(down, ["link", "ancestor"])
        .groupBy("link")
        .agg(F.min(F.struct("_ds", "_dd")).alias("_n"))
        .select("link", F.col("_n._ds").alias("_ns"), F.col("_n._dd").alias("_nd"))
    )
    # the common ancestor itself is a stop only when it is one of the two ends
    single = (F.col("_ns") == 0) | (F.col("_nd") == 0)
    within = lambda d, n: F.coalesce(F.col(d) <= F.when(single, F.col(n)).otherwise(F.col(n) - 1), F.lit(True))
    src_stops = up.join(nearest, "link", "left").filter(within("_ds", "_ns")).select(
        "link", "ancestor", F.lit(0).alias("_side"), F.col("_ds").alias("_pos")
    )
    keep_down = F.when(F.coalesce(single, F.lit(False)), F.col("_dd") < F.col("_nd")).otherwise(within("_dd", "_nd"))
    dst_stops = down.join(nearest, "link", "left").filter(keep_down).select(
        "link", "ancestor", F.lit(1).alias("_side"), (-F.col("_dd")).alias("_pos")
    )
    # a link has at most twice the depth of the tree in stops
    order = W.partitionBy("link").orderBy("_side", "_pos")
    stops = src_stops.unionByName(dst_stops)
    return (
        stops.select(
            "link",
            F.row_number().over(order).alias("hop"),
            F.col("ancestor").alias("src"),
            F.lead("ancestor").over(order).alias("dst"),
        )
        .filter("dst is not null")
    )


def impute_links(links: DataFrame, hops: DataFrame) -> DataFrame:
    """Flow through every hop: the sum over the links that use it."""
    return (
        hops.join(links.select("link", "extension"), "link")
        .groupBy("src", "dst")
        .agg(F.sum("extension").alias("extension"))
    )


# -- components -------------------------------------------------------------------------
def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): weakly connected components, named by their smallest node.

    Alternating large-star / small-star rounds (Kiveris et al., 2014): the number of rounds
    grows with the logarithm of the size, not with the diameter.
    """
    scratch = Scratch(edges.sparkSession, "components")

    def star(pairs: DataFrame, low: DataFrame) -> DataFrame:
        return skew_join(pairs, low, ["u"])

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return star(both.filter("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = star(down, low).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    def signature(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    nodes = edges.select(F.explode(F.array(src, dst)).alias("node")).distinct()
    current = scratch.save(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v").distinct(), "edges")
    before = signature(current)
    while True:
        current = scratch.save(small(scratch.save(large(current), "large")), "small")
        after = signature(current)
        if after == before:
            break
        before = after
    found = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
