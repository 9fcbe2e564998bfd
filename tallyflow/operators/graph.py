"""Weighted flow graphs: weight inference, computation edges, propagation, conflicts
(G-01..G-06, G-09, G-11, H-12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.cube import code_grid
from tallyflow.operators.incremental import MOST_TABLES, KeptState
from tallyflow.operators.issues import issue
from tallyflow.runtime import (
    Scratch,
    checkpointed,
    hot_keys,
    skew_join,
    sorted_numbers,
    spread,
    union_all,
)

SUM_ONE_TOLERANCE = 1e-9  # fixed value: relative tolerance under which weights sum to one


def edge_keys(edges: DataFrame) -> list[str]:
    """Edges may be common to all results or belong to a scenario and / or a period."""
    return [k for k in ("scenario", "period") if k in edges.columns]


# -- weights ----------------------------------------------------------------------------
def _complete(edges: DataFrame, node: str, weight: str, opposite: str) -> DataFrame:
    """Infer the missing ``weight`` of the edges leaving ``node``; adds ``_split`` per edge row."""
    keys = edge_keys(edges)
    stats = edges.groupBy(*keys, node).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(weight).alias("_have"),
        F.coalesce(F.sum(weight), F.lit(0.0)).alias("_sum"),
    )
    joined = skew_join(edges, stats, keys + [node])
    missing = F.col("_n") - F.col("_have")
    lone = (F.col("_n") == 1) & (missing == 1)
    rest = (F.col("_n") > 1) & (missing == 1) & (F.col("_sum") <= 1.0)
    inferred = (
        F.when(lone & F.col(opposite).isNotNull(), F.when(F.col(opposite) == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col(opposite))))
        .when(lone & ~F.col("_structural"), F.lit(1.0))
        .when(rest, F.lit(1.0) - F.col("_sum"))
    )
    near_one = F.abs(F.col("_sum") - 1.0) <= SUM_ONE_TOLERANCE * F.greatest(F.abs(F.col("_sum")), F.lit(1.0))
    split = rest | ((F.col("_n") > 1) & (missing == 0) & near_one)
    return (
        joined.withColumn(weight, F.coalesce(F.col(weight), inferred))
        .withColumn("_split", split)
        .drop("_n", "_have", "_sum")
    )


def complete_weights(
    edges: DataFrame, scale_edges: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Missing direct weights, then missing reverse weights, of ``edges(src, dst, weight[, reverse_weight])``.

    Per node and direction: one edge without a weight of one edge takes 1 / opposite weight
    (0 when that is 0), or 1 when there is none and no scale edge links the pair; one of several
    takes 1 - sum of the others when that sum is at most 1 (the node is then *split*); all
    given with a sum of 1 also marks the node as split; two or more missing stay missing.
    Returns (edges with weight, reverse_weight, src_split, dst_split; issues).
    """
    if "reverse_weight" not in edges.columns:
        edges = edges.withColumn("reverse_weight", F.lit(None).cast("double"))
    keys = edge_keys(edges)
    edges = edges.select(*keys, "src", "dst", F.col("weight").cast("double").alias("weight"), "reverse_weight")
    if scale_edges is None:
        edges = edges.withColumn("_structural", F.lit(False))
    else:
        linked = (
            scale_edges.select("src", "dst")
            .unionByName(scale_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            .distinct()
            .withColumn("_structural", F.lit(True))
        )
        edges = edges.join(linked, ["src", "dst"], "left").withColumn(
            "_structural", F.coalesce("_structural", F.lit(False))
        )
    # written: each is read by the sums and by the join of the next step, the last one by the results and their readers
    scratch = Scratch(edges.sparkSession, "weights")
    edges = scratch.save(edges, "given")
    direct = _complete(edges, "src", "weight", "reverse_weight").withColumnRenamed("_split", "src_split")
    direct = scratch.save(direct, "direct")
    both = _complete(direct, "dst", "reverse_weight", "weight").withColumnRenamed("_split", "dst_split")
    done = scratch.save(both.select(*keys, "src", "dst", "weight", "reverse_weight", "src_split", "dst_split"), "reverse")
    gaps = (
        done.filter("weight is null")
        .groupBy(*keys, "src")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*issue("warning", "edges without weight", F.col("src"), F.col("_n").cast("string")))
    )
    return done, gaps


def computation_edges(edges: DataFrame) -> DataFrame:
    """Inputs of every node in both directions.

    (node, input, weight, direct, n_inputs, split): ``split`` tells that one known input is
    enough. A reverse row without weight still counts as an input that is never known.
    """
    keys = edge_keys(edges)
    for flag in ("src_split", "dst_split"):
        if flag not in edges.columns:
            edges = edges.withColumn(flag, F.lit(False))
    if "reverse_weight" not in edges.columns:
        edges = edges.withColumn("reverse_weight", F.lit(None).cast("double"))
    forward = edges.select(
        *keys, F.col("dst").alias("node"), F.col("src").alias("input"), "weight", F.lit(True).alias("direct"),
        F.col("dst_split").alias("split"),
    )
    back = edges.select(
        *keys, F.col("src").alias("node"), F.col("dst").alias("input"), F.col("reverse_weight").alias("weight"),
        F.lit(False).alias("direct"), F.col("src_split").alias("split"),
    )

    def counted(rows: DataFrame) -> DataFrame:  # a direction by itself: the side with few nodes need not be shuffled
        counts = rows.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("n_inputs"))
        return skew_join(rows, counts, keys + ["node"]).select(*keys, "node", "direct", "input", "weight", "split", "n_inputs")

    return counted(forward).unionByName(counted(back))


# -- propagation ------------------------------------------------------------------------
def propagate(
    inputs: DataFrame, known: DataFrame, keys: Sequence[str] = (), hot: DataFrame | bool | None = None
) -> DataFrame:
    """One step: (keys, node, value, direct) of every node that its inputs determine.

    All direct inputs known and weighted, otherwise the same over the reverse inputs; a split
    node takes its first known input in name order.
    """
    keys = list(keys)
    on = [k for k in edge_keys(inputs) if k in keys]
    # inputs without weight can never contribute; they only count in n_inputs
    usable = inputs.filter("weight is not null").withColumnRenamed("input", "_input")
    right = known.select(*keys, F.col("node").alias("_input"), F.col("value").alias("_v"))
    joined = skew_join(usable, right, on + ["_input"], hot=hot if hot is not None else False)
    term = F.col("weight") * F.col("_v")
    sides = joined.groupBy(*keys, "node").agg(
        *[
            e
            for side, cond in (("d", F.col("direct")), ("r", ~F.col("direct")))
            for e in (
                F.sum(F.when(cond, term)).alias(f"_sum_{side}"),
                F.count_if(cond).alias(f"_have_{side}"),
                F.max(F.when(cond, F.col("n_inputs"))).alias(f"_n_{side}"),
                F.max(F.when(cond, F.col("split"))).alias(f"_split_{side}"),
                F.min_by(term, F.when(cond, F.col("_input"))).alias(f"_one_{side}"),
            )
        ]
    )

    def solved(side: str):
        return F.when(F.col(f"_split_{side}"), F.col(f"_one_{side}")).when(
            F.col(f"_have_{side}") == F.col(f"_n_{side}"), F.col(f"_sum_{side}")
        )

    return (
        sides.withColumn("value", F.coalesce(solved("d"), solved("r")))
        .withColumn("direct", solved("d").isNotNull())
        .filter("value is not null")
        .select(*keys, "node", "value", "direct")
    )


SIDES = ("d", "r")
VERSION_BITS = 18  # beside the 45 of a sorted number: a later value of the same input comes first


class Propagation:
    """Semi-naive propagation: a round reads the edges that leave the frontier and the kept state of the nodes that they reach.

    The state of a node holds for its direct and its reverse inputs the sum of the known terms, how many are known, and the first known
    term in name order (by sorted numbers of the input names, so that all of it has a fixed width). A row of the
    frontier brings its value, the difference to the value brought before and whether it is known for the first time (``fresh``), so that
    replaced values correct the sums. Nodes get a value once: rows of a determined or given node are let go. The number of the round travels with the
    rows, so that all rounds run the same compiled code.
    """

    def __init__(self, inputs: DataFrame, keys: Sequence[str], scratch: Scratch, label: str = "propagate"):
        self.keys, self.scratch, self.label = list(keys), scratch, label
        self.on = [k for k in edge_keys(inputs) if k in self.keys]
        # inputs without weight can never contribute; they only count in n_inputs
        usable = inputs.filter("weight is not null").withColumnRenamed("input", "_input")
        usable = usable.select(*self.on, "_input", "node", "weight", "direct", "n_inputs", "split")
        usable, splits = scratch.save_counted(usable, f"{label}-edges", F.col("split"))
        if splits:
            numbers, _ = sorted_numbers(usable.filter("split"), "_input", "_place", scratch)
            usable = usable.join(numbers, "_input", "left").withColumn("_place", F.when(F.col("split"), F.col("_place")))
            self.edges = scratch.save(usable, f"{label}-numbered")
        else:
            self.edges = usable.withColumn("_place", F.lit(None).cast("long"))
        self.hot = hot_keys(self.edges, [*self.on, "_input"])
        columns: dict[str, tuple[str, Column]] = {}
        for s in SIDES:
            columns |= {f"sum_{s}": ("double", F.sum(f"sum_{s}")), f"have_{s}": ("long", F.sum(f"have_{s}")), f"n_{s}": ("long", F.max(f"n_{s}"))}
            columns |= {f"split_{s}": ("boolean", F.max(f"split_{s}")), f"place_{s}": ("long", F.min(f"place_{s}"))}
            columns[f"one_{s}"] = ("double", F.min_by(f"one_{s}", f"place_{s}"))
        columns |= {"seen": ("double", F.max_by("seen", "at")), "at": ("long", F.max("at")), "known": ("boolean", F.max("known"))}
        self.state = KeptState(scratch, [*self.keys, "node"], columns, label)
        self.found: list[DataFrame] = []
        self.round = 0

    def give(self, known: DataFrame, rows: int) -> None:
        """Nodes (keys, node) that have a value already and are not to be determined."""
        self.state.append(known.select(*self.keys, "node", F.lit(True).alias("known")), rows)

    def bring(self, values: DataFrame, rows: int) -> None:
        """Remember (keys, node, value) as seen; a node that is determined later tells its difference to it."""
        self.state.append(values.select(*self.keys, "node", F.col("value").alias("seen"), F.col("round").alias("at")), rows)

    def _delta(self, frontier: DataFrame) -> DataFrame:
        right = frontier.select(*self.keys, F.col("node").alias("_input"), "value", "diff", "fresh", "round")
        rows = skew_join(self.edges, right, [*self.on, "_input"], hot=self.hot if self.hot is not None else False)
        place = F.shiftleft("_place", VERSION_BITS) + F.lit((1 << VERSION_BITS) - 1) - F.col("round") % (1 << VERSION_BITS)
        sums = [F.max(F.col("round") + 1).alias("round")]
        for s, side in (("d", F.col("direct")), ("r", ~F.col("direct"))):
            first = F.when(side & F.col("split"), place)
            sums += [
                F.sum(F.when(side, F.col("weight") * F.col("diff"))).alias(f"sum_{s}"),
                F.sum(F.when(side, F.col("fresh"))).alias(f"have_{s}"),
                F.max(F.when(side, F.col("n_inputs"))).alias(f"n_{s}"),
                F.max(F.when(side, F.col("split"))).alias(f"split_{s}"),
                F.min_by(F.col("weight") * F.col("value"), first).alias(f"one_{s}"),
                F.min(first).alias(f"place_{s}"),
            ]
        return rows.groupBy(*self.keys, "node").agg(*sums)

    def step(self, frontier: DataFrame) -> DataFrame | None:
        """One round: the next frontier, or None when nothing new is determined. ``frontier`` (keys, node, value, diff, fresh)."""
        self.round += 1
        delta, reached = self.scratch.save_counted(self._delta(frontier), f"{self.label}-delta")
        if not reached:
            return None
        both = self.state.beside(delta)

        def solved(s: str) -> Column:
            new, old = F.col(f"place_{s}"), F.col(f"old_place_{s}")
            one = F.when(old.isNull() | (new < old), F.col(f"one_{s}")).otherwise(F.col(f"old_one_{s}"))
            have = F.coalesce(f"have_{s}", F.lit(0)) + F.coalesce(f"old_have_{s}", F.lit(0))
            total = F.coalesce(f"sum_{s}", F.lit(0.0)) + F.coalesce(f"old_sum_{s}", F.lit(0.0))
            split = F.coalesce(f"split_{s}", f"old_split_{s}")
            return F.when(split, one).when(have == F.coalesce(f"n_{s}", f"old_n_{s}"), total)

        open_ = ~F.coalesce("old_known", F.lit(False))
        rows = both.filter(open_).withColumn("value", F.coalesce(*map(solved, SIDES))).withColumn("direct", solved("d").isNotNull())
        kept = [f"{c}_{s}" for s in SIDES for c in ("sum", "have", "n", "split", "one", "place")]
        diff = F.col("value") - F.coalesce("old_seen", F.lit(0.0))
        rows = rows.select(
            *self.keys, "node", *kept, F.when(F.col("value").isNotNull(), True).alias("known"), "value", "direct", diff.alias("diff"),
            F.col("old_seen").isNull().cast("long").alias("fresh"), "round",
        )
        table, n = self.scratch.save_counted(rows, self.label)
        if not n:
            return None
        self.state.append(table.drop("value", "direct", "diff", "fresh", "round"), n)
        new = table.filter("known")
        self.found.append(new)
        return new

    def run(self, frontier: DataFrame) -> list[DataFrame]:
        """Rounds until nothing new is determined: rows (keys, node, value, direct, round) of each."""
        self.found = []
        while frontier is not None:
            if len(self.found) > MOST_TABLES:
                self.found = [self.scratch.save(union_all(self.found), f"{self.label}-found")]
            frontier = self.step(frontier)
        return self.found


def fresh(values: DataFrame, at: int = 0) -> DataFrame:
    """A frontier of values that are known for the first time."""
    more = {"diff": F.col("value"), "fresh": F.lit(1).cast("long"), "round": F.lit(at).cast("long")}
    return values.withColumns(more)


def compute_values(
    inputs: DataFrame, known: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Repeat the step until nothing new is known. Given values are never replaced.

    Level-synchronous: a node stays unknown until the inputs it needs are known, so a cycle
    without a given value stays unknown. A round reads the edges beside the values found in the previous
    round and the kept state of the nodes there. (keys, node, value, computed).
    """
    keys = list(keys)
    scratch = Scratch(inputs.sparkSession, "propagate")
    work = Propagation(inputs, keys, scratch)
    given = known.filter("value is not null").select(*keys, "node", F.col("value").cast("double").alias("value"))
    given, n = scratch.save_counted(given, "given")
    work.give(given, n)
    found = work.run(fresh(given)) if n else []
    computed = [f.select(*keys, "node", "value", F.lit(True).alias("computed")) for f in found]
    return union_all([given.withColumn("computed", F.lit(False)), *computed])


def cascade(definitions: DataFrame, values: DataFrame) -> DataFrame:
    """Linear definitions between codes: ``definitions(code, term, coefficient)`` reads
    code = sum of coefficient x term. A definition with one unknown term is solved for it.

    What is kept of an equation is the sum of its known terms, their number and the exclusive or of their variables' hashes: when one variable
    is left, the exclusive or of all names it. A round reads the equations that hold a variable found in the round before.
    """
    scratch = Scratch(definitions.sparkSession, "cascade")
    # every equation as one row per variable: sum of coefficient x variable = 0
    terms = definitions.select(F.col("code").alias("eq"), F.col("term").alias("node"), F.col("coefficient").cast("double"))
    lhs = definitions.select(F.col("code").alias("eq"), F.col("code").alias("node"), F.lit(-1.0).alias("coefficient")).distinct()
    rows = terms.unionByName(lhs).groupBy("eq", "node").agg(F.sum("coefficient").alias("coefficient"))
    rows = rows.withColumn("_hash", F.xxhash64("node"))
    sizes = rows.groupBy("eq").agg(F.count(F.lit(1)).alias("size"), F.bit_xor("_hash").alias("all"))
    rows = scratch.save(skew_join(rows, sizes, ["eq"]), "equations")
    hot = hot_keys(rows, ["node"])
    columns = {"sum": ("double", F.sum("sum")), "have": ("long", F.sum("have")), "seen": ("long", F.bit_xor("seen"))}
    state = KeptState(scratch, ["eq"], columns, "equation")
    names = KeptState(scratch, ["node"], {"known": ("boolean", F.max("known"))}, "variable")
    given, n = scratch.save_counted(values.select("node", F.col("value").cast("double").alias("value")), "given")
    done, frontier = [given], given
    while n:
        names.append(frontier.select("node", F.lit(True).alias("known")), n)
        near = skew_join(rows, frontier, ["node"], hot=hot if hot is not None else False)
        delta = near.groupBy("eq").agg(
            F.sum(F.col("coefficient") * F.col("value")).alias("sum"), F.count(F.lit(1)).alias("have"), F.bit_xor("_hash").alias("seen"),
            F.max("size").alias("size"), F.max("all").alias("all"),
        )
        delta, reached = scratch.save_counted(delta, "delta")
        if not reached:
            break
        both = state.beside(delta)
        none = F.lit(0).cast("long")
        both = both.select(
            "eq", "sum", "have", "seen",
            (F.col("sum") + F.coalesce("old_sum", F.lit(0.0))).alias("_sum"),
            (F.col("size") - F.col("have") - F.coalesce("old_have", none)).alias("_left"),
            F.col("all").bitwiseXOR(F.col("seen")).bitwiseXOR(F.coalesce("old_seen", none)).alias("_hash"),
        )
        both, touched = scratch.save_counted(both, "touched")
        state.append(both.select("eq", "sum", "have", "seen"), touched)
        last = rows.select("eq", "_hash", "node", "coefficient").join(both.filter("_left = 1"), ["eq", "_hash"]).filter("coefficient <> 0")
        # several equations may name one variable: the first in name order gives its value
        new = last.groupBy("node").agg(F.min_by(F.try_divide(-F.col("_sum"), F.col("coefficient")), F.col("eq")).alias("value"))
        new = names.beside(scratch.save(new, "ready")).filter("old_known is null").select("node", "value")
        frontier, n = scratch.save_counted(new, "round")
        if n:
            done.append(frontier)
        if len(done) > MOST_TABLES:
            done = [scratch.save(union_all(done), "found")]
    return union_all(done)


# -- checks -----------------------------------------------------------------------------
def known_conflicts(inputs: DataFrame, previous: DataFrame, new: DataFrame) -> DataFrame:
    """Known nodes that can be computed from another known node: (node, conflicting).

    A previously known node conflicts with reachable new ones, a new node with every reachable
    known one. Only weighted inputs count. Reachability starts at the known nodes instead of
    closing the whole graph.
    """
    step = inputs.filter("weight is not null").select(F.col("input").alias("parent"), F.col("node").alias("child"))
    marks = previous.select("node", F.lit(False).alias("_new")).unionByName(new.select("node", F.lit(True).alias("_new")))
    marks = marks.groupBy("node").agg(F.max("_new").alias("_new"))
    reach = reachable(step, marks.select("node"))
    return (
        reach.join(marks, "node")
        .join(marks.select(F.col("node").alias("conflicting"), F.col("_new").alias("_new_c")), "conflicting")
        .filter((F.col("_new") | F.col("_new_c")) & (F.col("node") != F.col("conflicting")))
        .select("node", "conflicting")
    )


def reachable(step: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, conflicting) for everything reachable from the start nodes."""
    scratch = Scratch(step.sparkSession, "reach")
    step = scratch.save(step.distinct(), "step")
    hot = hot_keys(step, ["parent"])
    frontier = scratch.save(starts.select("node", F.col("node").alias("parent")), "starts")
    seen = []
    while True:
        nxt = skew_join(step, frontier, ["parent"], hot=hot if hot is not None else False).select(
            "node", F.col("child").alias("parent")
        ).distinct()
        if seen:
            nxt = nxt.join(union_all(seen), ["node", "parent"], "left_anti")
        frontier = scratch.save(nxt, "round")
        if frontier.isEmpty():
            break
        seen.append(frontier)
    if not seen:
        return frontier.select("node", F.col("parent").alias("conflicting"))
    return union_all(seen).select("node", F.col("parent").alias("conflicting"))


def unresolved(edges: DataFrame, results: DataFrame, grid: DataFrame, graph: str) -> DataFrame:
    """Nodes of a graph without a result in a (scenario, period) of ``grid``.

    Every graph node is expected in every combination, which is the size of the result table.
    """
    keys = grid.columns
    nodes = edges.select(F.explode(F.array(*[c for c in ("src", "dst", "parent", "child") if c in edges.columns])).alias("node")).distinct()
    expected = code_grid([nodes, grid.distinct()])
    return (
        expected.join(results.select(*keys, "node").distinct(), [*keys, "node"], "left_anti")
        .select(*keys, "node", *issue("warning", f"unresolved in {graph}", F.col("node"), F.concat_ws("/", *keys)))
    )


# -- flow edges from relations ----------------------------------------------------------
def flow_edges_for_solve(flows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Solver edges of the flow table, archetypes left out.

    ``flows(src, dst, weight, back, scale_change_weight)`` and
    ``nodes(node, processor, type, orientation, accounted)``. A flow with a change of type or a
    back interface goes through a hidden node ``<src processor>-<dst processor>``: the flow
    reaches the hidden node, a scale-change edge with reverse weight 1/w leads on to the
    destination and to the back interface, and a plain flow between the same processors is
    re-routed through it. Returns (flow edges, scale-change edges, hidden nodes).
    """
    info = lambda end: nodes.select(
        F.col("node").alias(end),
        *[F.col(c).alias(f"_{end}_{c}") for c in ("processor", "type", "orientation", "accounted")],
    )
    scratch = Scratch(flows.sparkSession, "flow-edges")
    flows, n = scratch.save_counted(flows, "flows")
    nodes = scratch.save(nodes, "interfaces")
    rows = spread(flows, n, "src").join(spread(info("src"), n, "src"), "src")
    rows = spread(rows, n, "dst").join(spread(info("dst"), n, "dst"), "dst")
    # flows without a back interface would all meet under one key
    none = [F.lit(None).cast(t).alias(f"_back_{c}") for c, t in nodes.dtypes if c in ("processor", "type", "orientation", "accounted")]
    rows = rows.filter("back is not null").join(info("back"), "back", "left").unionByName(rows.filter("back is null").select("*", *none))
    rows = rows.filter("_src_accounted and _dst_accounted and coalesce(_back_accounted, true)")
    rows = scratch.save(rows, "accounted")  # read by every kind of edge below
    changed = F.col("scale_change_weight").isNotNull() | F.col("back").isNotNull()
    plain = rows.filter(~changed).select("src", "dst", F.col("weight").cast("double").alias("weight"))
    typed = rows.filter(changed).withColumn(
        "hidden",
        F.concat(
            F.concat_ws("-", "_src_processor", "_dst_processor"), F.lit(":"), F.col("_src_type"), F.lit(":Input/Output")
        ),
    )
    w = F.coalesce(F.col("scale_change_weight").cast("double"), F.lit(1.0))
    reverse = F.try_divide(F.lit(1.0), w)
    ahead = typed.select(F.col("hidden").alias("src"), "dst", w.alias("weight"), reverse.alias("reverse_weight"))
    back = typed.filter("back is not null").select(
        F.col("hidden").alias("src"), F.col("back").alias("dst"), w.alias("weight"), reverse.alias("reverse_weight")
    )
    change_edges = ahead.unionByName(back).distinct().withColumn("src_split", F.lit(True)).withColumn("dst_split", F.lit(False))
    to_hidden = typed.select("src", F.col("hidden").alias("dst"), "weight")
    to_hidden = spread(to_hidden, n, "src", "dst").groupBy("src", "dst").agg(F.min(F.col("weight").cast("double")).alias("weight"))
    # the interface of the destination processor with the type of the source
    opposite = F.when(F.lower("_src_orientation") == "output", F.lit("Input")).otherwise(F.lit("Output"))
    place = ["processor", "type", "orientation"]
    twins = (
        spread(typed.select("src", "hidden", F.col("_dst_processor").alias("processor"), F.col("_src_type").alias("type"), opposite.alias("orientation")), n, *place)
        .join(spread(nodes.select(F.col("node").alias("dst"), *place), n, *place), place)
        .select("src", "hidden", "dst")
        .distinct()
    )
    twins = scratch.save(twins, "twins")
    rerouted = plain.join(twins, ["src", "dst"]).select(F.col("hidden").alias("src"), "dst", F.lit(1.0).alias("weight"))
    kept = plain.join(twins.select("src", "dst"), ["src", "dst"], "left_anti")
    flow = union_all([kept, to_hidden, rerouted.distinct()])
    hidden = typed.select(F.col("hidden").alias("node")).distinct()
    return flow, change_edges, hidden


def relative_edges(observations: DataFrame) -> DataFrame:
    """Observations relative to a sibling interface as period-dependent scale edges."""
    return observations.filter("relative_to is not null").select(
        "period",
        F.concat_ws(":", "processor", "relative_to").alias("src"),
        F.concat_ws(":", "processor", "interface").alias("dst"),
        F.col("value").alias("weight"),
    )
