"""Solving a flow network for all scenarios and periods at once (G-07, G-08, G-10..G-12, G-16, W-01, W-04).

State rows: scenario, period, node, value, computed, source, observer, direct, seq. ``seq`` is
the number of the round that produced the value; observations have 0.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.graph import Propagation, computation_edges, edge_keys, fresh
from tallyflow.operators.hierarchy import Levels, scenario_edges
from tallyflow.operators.incremental import MOST_TABLES, KeptState
from tallyflow.operators.issues import issue, source_priority
from tallyflow.runtime import Scratch, hot_keys, skew_join, spread, union_all

KEYS = ["scenario", "period"]
STATE = KEYS + ["node", "value", "computed", "source", "observer", "direct", "seq"]
AGGREGATIONS = ("InterfaceTypeAggregation", "PartOfAggregation")


@dataclass(frozen=True)
class Policy:
    """Solver settings of a scenario. The default settings and their names."""

    missing: str = "UseZero"
    aggregation: str = "TakeUpper"
    sources: tuple[str, ...] = (
        "Scale",
        "PartOfAggregation",
        "InterfaceTypeAggregation",
        "ScaleChange",
        "Flow",
    )
    observers: tuple[str, ...] = ()

    def __post_init__(self):
        problems = source_priority(self.sources)
        if problems:
            raise ValueError("; ".join(problems))


@dataclass
class Network:
    """Edge tables of a model. Graph edges are ``(src, dst, weight[, reverse_weight, src_split,
    dst_split])``, hierarchy edges ``(parent, child[, weight])``; scenario / period are optional. Hierarchy edges
    without a scenario are common to all; those with one hold in it, instead of a common edge between the same nodes."""

    flow: DataFrame | None = None
    scale: DataFrame | None = None
    scale_change: DataFrame | None = None
    type_edges: DataFrame | None = None
    part_of: DataFrame | None = None


@dataclass
class Solution:
    results: DataFrame  # state rows plus conflict (No / Taken / Dismissed)
    values: DataFrame  # state rows, one per node: the value in force
    pending: DataFrame | None = field(default=None)  # observations that could not be evaluated


# -- observations -----------------------------------------------------------------------
def pick_observations(
    obs: DataFrame, priority: Sequence[str] = (), keys: Sequence[str] = ("scenario", "period", "node")
) -> tuple[DataFrame, DataFrame]:
    """One observation per interface and period, by observer priority.

    Observations without observer come last. Issues: unknown observers, several observations
    without observer, several observations without a priority list. Every group is reduced by
    partial aggregation, so a heavily observed interface stays distributed.
    """
    keys = [k for k in keys if k in obs.columns]
    last = len(priority) + 1  # observers that are not listed; rows without observer come after them
    rank = F.when(F.col("observer").isNull(), F.lit(last + 1))
    if priority:
        order = F.array(*[F.lit(p) for p in priority])
        rank = rank.when(F.array_position(order, F.col("observer")) > 0, F.array_position(order, F.col("observer")))
    ranked = obs.withColumn("_rank", rank.otherwise(F.lit(last)).cast("long"))
    rest = [c for c in obs.columns if c not in keys]
    best = ranked.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct("_rank", *[c for c in rest if c in ("observer", "value")])).alias("_best"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("observer").isNull()).alias("_anonymous"),
    )
    key = F.concat_ws("|", *keys)
    issues = best.filter("_anonymous > 1").select(
        *issue("error", "several observations without observer", key, F.col("_anonymous").cast("string"))
    )
    if priority:
        unknown = obs.filter(F.col("observer").isNotNull() & ~F.col("observer").isin(list(priority)))
        issues = issues.unionByName(
            unknown.select("observer").distinct().select(
                *issue("error", "observer not in the priority list", F.col("observer"), F.lit(",".join(priority)))
            )
        )
    else:
        issues = issues.unionByName(
            best.filter("_n > 1 and _anonymous <= 1").select(
                *issue("error", "several observations but no observer priority", key, F.col("_n").cast("string"))
            )
        )
    return best.select(*keys, "_best.*"), issues


# -- conflicts --------------------------------------------------------------------------
def _per_scenario(policies: Mapping[str, Policy], default: Policy, pick: Callable[[Policy], Column]) -> Column:
    out = pick(default)
    for name, p in policies.items():
        out = F.when(F.col("scenario") == name, pick(p)).otherwise(out)
    return out


def _position(sources: Sequence[str], col: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in sources]), col)


def candidate_wins(policy: Policy, source: Column, existing_computed: Column, existing_source: Column) -> Column:
    """Does a new computed value replace the existing one?

    Two computed values: the source earlier in the priority list. Observation against an
    aggregation: the aggregation policy. Observation against anything else: the observation.
    """
    both = _position(policy.sources, source) < _position(policy.sources, existing_source)
    upper = source.isin(*AGGREGATIONS) & F.lit(policy.aggregation == "TakeLowerAggregation")
    return F.when(existing_computed, both).otherwise(upper)


def resolve_conflicts(candidates: DataFrame, policy: Policy = Policy(), keys: Sequence[str] = ("node",)) -> DataFrame:
    """Two values per node, ``existing`` (value, source or NULL for an observation) and ``new``:
    rows (keys, value, source, conflict) with conflict Taken / Dismissed.

    ``candidates(keys, new_value, new_source, existing_value, existing_source)``.
    """
    wins = candidate_wins(
        policy, F.col("new_source"), F.col("existing_source").isNotNull(), F.col("existing_source")
    )
    new = F.struct(F.col("new_value").alias("value"), F.col("new_source").alias("source"))
    old = F.struct(F.col("existing_value").alias("value"), F.col("existing_source").alias("source"))
    pair = F.array(
        F.struct(F.when(wins, new).otherwise(old).alias("v"), F.lit("Taken").alias("conflict")),
        F.struct(F.when(wins, old).otherwise(new).alias("v"), F.lit("Dismissed").alias("conflict")),
    )
    return candidates.select(*keys, F.explode(pair).alias("_p")).select(*keys, "_p.v.*", "_p.conflict")


# -- fix-point --------------------------------------------------------------------------
class _Solver:
    def __init__(self, spark, policies: Mapping[str, Policy], default: Policy):
        self.scratch = Scratch(spark, "solve")
        self.policies, self.default = policies, default
        self.seq = 0
        self.own: dict[str, list[DataFrame]] = {}  # values computed by each source
        self.told: dict[str, DataFrame] = {}  # values in force at the last pass of each graph
        self.clashed = False
        self.replaced = False  # may a value in force have been replaced?
        self.conflicts: list[DataFrame] = []

    # every new row: state columns of the value in force, has_conflict, dismissed struct
    def settle(self, candidates: DataFrame, existing: DataFrame, source: str) -> DataFrame:
        """Candidates (keys, node, value, direct, seq) against the values in force."""
        old = F.struct(*STATE[3:])
        have = existing.select(*KEYS, "node", old.alias("_old"))
        joined = candidates.withColumn("seq", F.col("seq").cast("int")).join(have, KEYS + ["node"], "left")
        new = F.struct(
            F.col("value"),
            F.lit(True).alias("computed"),
            F.lit(source).alias("source"),
            F.lit(None).cast("string").alias("observer"),
            F.col("direct"),
            F.col("seq"),
        )
        wins = _per_scenario(
            self.policies,
            self.default,
            lambda p: candidate_wins(p, F.lit(source), F.col("_old.computed"), F.col("_old.source")),
        )
        clash = F.col("_old").isNotNull()
        taken = F.when(clash & ~wins, F.col("_old")).otherwise(new)
        lost = F.when(clash & wins, F.col("_old")).when(clash, new)
        return joined.select(*KEYS, "node", taken.alias("_t"), lost.alias("lost")).select(
            *KEYS, "node", "_t.*", "lost"
        )

    def overlay(self, base: DataFrame, top: Sequence[DataFrame]) -> DataFrame:
        if not top:
            return base
        over = union_all([t.select(*STATE) for t in top])
        return base.join(over.select(*KEYS, "node"), KEYS + ["node"], "left_anti").unionByName(over)

    def without(self, new: DataFrame, tables: Sequence[DataFrame]) -> DataFrame:
        """Rows for nodes that none of the tables holds: one anti-join, however many there are."""
        if not tables:
            return new
        return new.join(union_all([t.select(*KEYS, "node") for t in tables]), KEYS + ["node"], "left_anti")

    def graph_pass(
        self, source: str, work: Propagation, results: DataFrame, changed: list[DataFrame], active: DataFrame
    ) -> list[DataFrame]:
        """Rounds over one graph. What the source knows of its nodes is kept from pass to pass; it is told the values that
        were set since its last pass, or, once values in force may be replaced, those that differ from what it was told."""
        mine = self.own[source]
        if self.replaced:
            now = self.without(results.select(*KEYS, "node", "value"), mine)
            before = self.told.get(source, results.limit(0)).select(*KEYS, "node", F.col("value").alias("_before"))
            told = now.join(before, KEYS + ["node"], "left").filter("_before is null or _before <> value")
            told = told.withColumn("diff", F.col("value") - F.coalesce("_before", F.lit(0.0))).withColumn("fresh", F.col("_before").isNull().cast("long"))
            told, n = self.scratch.save_counted(told.drop("_before").withColumn("round", F.lit(work.round).cast("long")), f"{source}-told")
            if not n:
                return []
        else:  # written tables as they are
            told = fresh(union_all([c.select(*KEYS, "node", "value") for c in changed]).join(active, KEYS, "left_semi"), work.round)
            n = 1
        self.told[source] = results
        work.bring(told, n)
        since = self.seq - work.round
        found = work.run(told)
        if not found:
            return []
        new = union_all(found).select(*KEYS, "node", "value", "direct", (F.lit(since) + F.col("round")).alias("seq"))
        self.seq = since + work.round
        return [self.scratch.save(self.settle(new, results, source), source)]

    def level_pass(
        self, source: str, tree: Levels, results: DataFrame, phase: str, changed: list[DataFrame] | None
    ) -> list[DataFrame]:
        """One bottom-up sweep; left out when no changed value lies in the hierarchy."""
        if changed is not None:
            moved = union_all([c.select("node") for c in changed])
            if moved.join(tree.tops, "node", "left_semi").isEmpty():
                return []
        mine = self.own[source]
        # values outside the hierarchy stand among the leaves, where no edge leads on from them
        base = self.overlay(results, mine).join(tree.tops.filter("height > 0"), "node", "left").fillna(0, "height")
        base = self.scratch.save_by(base, f"{source}-base", "height")
        sweep = tree.sweep(KEYS, phase)
        sweep.add(0, base.filter("height = 0").select(*KEYS, "node", "value"))
        found: list[DataFrame] = []
        for h in range(1, tree.top + 1):
            self.seq += 1
            here = base.filter(F.col("height") == h).drop("height")
            fresh_ = self.without(sweep.sums(h).withColumns({"direct": F.lit(True), "seq": F.lit(self.seq)}), mine)
            new, n = self.scratch.save_counted(self.settle(fresh_, here, source), source)
            if n:
                found.append(new)
                here = self.overlay(here, [new])
            if h < tree.top:
                sweep.add(h, here.select(*KEYS, "node", "value"))
        return found


def solve(
    network: Network,
    observations: DataFrame,
    policies: Mapping[str, Policy] | None = None,
    default: Policy = Policy(),
    sibling: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    pending: DataFrame | None = None,
) -> Solution:
    """Fix-point over Flow, Scale, ScaleChange, InterfaceTypeAggregation, PartOfAggregation.

    ``observations(scenario, period, node, value[, observer])`` holds one value per node. First
    without assuming anything for missing children (Invalidate), then, for the scenarios that ask
    for it, with UseZero. Only scenario x period groups that still gained values in the last
    iteration take part in the next one. ``pending`` observations (see
    ``scenarios.sibling_evaluator``) are evaluated after every iteration.
    """
    spark = observations.sparkSession
    s = _Solver(spark, policies or {}, default)
    observer = F.col("observer") if "observer" in observations.columns else F.lit(None)
    first = observations.filter("value is not null").select(
        *KEYS,
        "node",
        F.col("value").cast("double").alias("value"),
        F.lit(False).alias("computed"),
        F.lit(None).cast("string").alias("source"),
        observer.cast("string").alias("observer"),
        F.lit(None).cast("boolean").alias("direct"),
        F.lit(0).alias("seq"),
    )
    results = s.scratch.save(first, "observations")
    groups = s.scratch.save(results.select(*KEYS).distinct(), "groups")

    passes: list[tuple[str, Callable[[DataFrame, str, list[DataFrame] | None], list[DataFrame]]]] = []
    for source, edges in (("Flow", network.flow), ("Scale", network.scale), ("ScaleChange", network.scale_change)):
        if edges is not None:
            work = Propagation(computation_edges(edges), KEYS, s.scratch, source)
            passes.append((source, lambda r, phase, changed, active, a=source, b=work: s.graph_pass(a, b, r, changed, active)))
    for source, edges in (("InterfaceTypeAggregation", network.type_edges), ("PartOfAggregation", network.part_of)):
        if edges is not None:
            if "weight" not in edges.columns:
                edges = edges.withColumn("weight", F.lit(1.0))
            edges = edges.select("parent", "child", "weight", *(["scenario"] if "scenario" in edges.columns else []))
            tree = Levels(edges, s.scratch, source)
            passes.append((source, lambda r, phase, changed, active, a=source, b=tree: s.level_pass(a, b, r, phase, changed)))
    s.own = {source: [] for source, _ in passes}
    # values set since the last pass of each source: a pass without any is skipped
    changed: dict[str, list[DataFrame]] = {source: [results] for source, _ in passes}

    zero = [n for n, p in s.policies.items() if p.missing == "UseZero"]
    strict = [n for n, p in s.policies.items() if p.missing != "UseZero"]
    phases = ["Invalidate"]
    if zero or default.missing == "UseZero":
        phases.append("UseZero")
    # values in force as written tables: nothing is copied while no value is replaced
    frames: list[DataFrame] = [results]
    for phase in phases:
        active = groups
        if phase == "UseZero":
            active = (
                groups.filter(~F.col("scenario").isin(strict)) if default.missing == "UseZero" and strict
                else groups if default.missing == "UseZero"
                else groups.filter(F.col("scenario").isin(zero))
            )
        first_round, left = True, 0 if active.isEmpty() else 1
        while left:
            live = union_all(frames).join(active, KEYS, "left_semi")
            grown: list[DataFrame] = []  # groups with a node that had no value
            for source, run in passes:
                # a new policy concerns every node of a hierarchy, not only changed ones
                sweep = first_round and source in AGGREGATIONS
                seen, changed[source] = changed[source], []
                found = run(live, phase, None if sweep else seen, active) if seen or sweep else []
                if found:
                    for other in changed:
                        if other != source:
                            changed[other] = changed[other] + found
                    new = union_all(found)
                    grown.append(new.filter("lost is null").select(*KEYS))
                    lost = new.filter("lost is not null")
                    if not lost.isEmpty():
                        s.clashed = s.replaced = True
                        s.conflicts.append(lost)
                    s.own[source] = s.own[source] + [f.select(*STATE) for f in found]
                if s.clashed:
                    # values of this source are in force again, as after each of its passes
                    mine = [m.join(active, KEYS, "left_semi") for m in s.own[source]]
                    live = s.scratch.save(s.overlay(live, mine), "live")
                elif found and s.replaced:
                    live = live.unionByName(union_all([f.select(*STATE) for f in found]))
                elif found:
                    frames += [f.select(*STATE) for f in found]
                    live = union_all(frames).join(active, KEYS, "left_semi")
            if pending is not None and sibling is not None:
                evaluated, n = s.scratch.save_counted(
                    sibling(pending.join(active, KEYS, "left_semi"), live)
                    .filter("value is not null")
                    .select(
                        *KEYS, "node", "value", F.lit(False).alias("computed"), F.lit(None).cast("string").alias("source"),
                        "observer", F.lit(None).cast("boolean").alias("direct"), F.lit(s.seq).alias("seq"),
                    ),
                    "siblings",
                )
                if n:
                    s.replaced = True
                    grown.append(evaluated.join(live.select(*KEYS, "node"), KEYS + ["node"], "left_anti").select(*KEYS))
                    live = s.overlay(live, [evaluated])
                    changed = {source: frames_ + [evaluated] for source, frames_ in changed.items()}
                    pending = s.scratch.save(
                        pending.join(evaluated.select(*KEYS, "node"), KEYS + ["node"], "left_anti"), "pending"
                    )
            first_round = False
            if s.replaced:
                frames = [s.scratch.save(union_all(frames).join(active, KEYS, "left_anti").unionByName(live), "results")]
            elif len(frames) > MOST_TABLES:
                frames = [s.scratch.save(union_all(frames), "results")]
            if not grown or not any(changed.values()):
                break
            active, left = s.scratch.save_counted(union_all(grown).distinct(), "active")
    results = union_all(frames)

    if s.conflicts:
        log = union_all(s.conflicts)
        # the last conflict of a node is the one reported
        last = log.withColumn("_at", F.greatest("seq", "lost.seq")).groupBy(*KEYS, "node").agg(
            F.max_by(F.struct(*STATE[3:]), "_at").alias("_t"), F.max_by("lost", "_at").alias("_l")
        )
        last = s.scratch.save(last, "conflicts")
        free = results.join(last.select(*KEYS, "node"), KEYS + ["node"], "left_anti").withColumn(
            "conflict", F.lit("No")
        )
        taken = last.select(*KEYS, "node", "_t.*", F.lit("Taken").alias("conflict"))
        dismissed = last.select(*KEYS, "node", "_l.*", F.lit("Dismissed").alias("conflict"))
        full = union_all([free, taken, dismissed])
    else:
        full = results.withColumn("conflict", F.lit("No"))
    return Solution(full, results, pending)


# -- scope ------------------------------------------------------------------------------
# Subsystem types counted as internal.
INTERNAL_SUBSYSTEMS = ("local", "environment")


class _ScopeSums:
    """What is known of the internal and external parts of each node's children in one structure, kept between the rounds."""

    def __init__(self, scratch: Scratch, label: str, edges: DataFrame, totals: DataFrame):
        self.scratch, self.label = scratch, label
        on = edge_keys(edges) + ["child"]
        total = totals.select(*KEYS, F.col("node").alias("child"), F.col("value").alias("total"))
        rows = skew_join(edges, total, on, hot=hot_keys(edges, on) or False)
        self.rows = scratch.save(rows.select(*KEYS, "node", "child", "weight", "same", "total"), f"{label}-children")
        self.hot = hot_keys(self.rows, [*KEYS, "child"]) or False
        columns = {"n": ("long", F.max("n")), "have": ("long", F.sum("have")), "internal": ("double", F.sum("internal")), "external": ("double", F.sum("external"))}
        self.state = KeptState(scratch, [*KEYS, "node"], columns, f"scope-{label}")
        self.told: int | None = None

    def tell(self, done: list[DataFrame]) -> DataFrame | None:
        """Nodes (keys, node, internal, external, source) all of whose children are settled, after the parts of ``done``."""
        frames = []
        if self.told is None:  # children in another system count as external from the start
            self.told = 0
            other = F.when(~F.col("same"), 1).otherwise(0).cast("long")
            frames.append(self.rows.select(*KEYS, "node", other.alias("have"), F.lit(None).cast("double").alias("internal"), F.when(~F.col("same"), F.col("weight") * F.col("total")).alias("external")))
        if done[self.told :]:
            parts = union_all(done[self.told :]).select(*KEYS, F.col("node").alias("child"), "internal", "external")
            near = skew_join(self.rows.filter("same").select(*KEYS, "node", "child", "weight"), parts, [*KEYS, "child"], hot=self.hot)
            one = F.lit(1).cast("long").alias("have")
            frames.append(near.select(*KEYS, "node", one, (F.col("weight") * F.col("internal")).alias("internal"), (F.col("weight") * F.col("external")).alias("external")))
        self.told = len(done)
        if not frames:
            return None
        first = not self.state.tables
        delta = union_all(frames).groupBy(*KEYS, "node").agg(F.sum("have").alias("have"), F.sum("internal").alias("internal"), F.sum("external").alias("external"))
        if first:
            delta = delta.join(self.rows.groupBy(*KEYS, "node").agg(F.count(F.lit(1)).alias("n")), [*KEYS, "node"])
        delta, n = self.scratch.save_counted(delta, f"scope-{self.label}-delta")
        if not n:
            return None
        both = self.state.beside(delta)
        self.state.append(delta, n)

        def total(c: str) -> Column:
            return F.when(F.col(c).isNull(), F.col(f"old_{c}")).otherwise(F.col(c) + F.coalesce(f"old_{c}", F.lit(0.0)))

        have = F.col("have") + F.coalesce("old_have", F.lit(0))
        ready = both.filter(have == (F.col("n") if first else F.col("old_n")))
        ready = ready.select(*KEYS, "node", total("internal").alias("internal"), total("external").alias("external"), F.lit(self.label).alias("source"))
        return self.scratch.save(ready.filter("internal is not null or external is not null"), f"scope-{self.label}-ready")


def scope_split(values: DataFrame, network: Network, nodes: DataFrame) -> DataFrame:
    """Internal and external part of every result.

    Observed and scaled values are internal. A child in another system, or on the other side of
    the internal / external border, counts as external; other children pass their own parts on.
    ``nodes(node, system, subsystem)``. Rows (scenario, period, node, value, scope, source).
    """
    scratch = Scratch(values.sparkSession, "scope")
    side = F.lower(F.coalesce("subsystem", F.lit("local"))).isin(*INTERNAL_SUBSYSTEMS)
    place = scratch.save(
        nodes.groupBy("node").agg(F.min(F.coalesce("system", F.lit(""))).alias("_sys"), F.min(side).alias("_in")),
        "places",
    )
    ends = lambda n: place.select(F.col("node").alias(n), F.col("_sys").alias(f"_sys_{n}"), F.col("_in").alias(f"_in_{n}"))

    def structure(df: DataFrame | None, parent: str, child: str, weight: str, label: str):
        if df is None:
            return None
        if "parent" in df.columns:
            df = scenario_edges(df, values)
        w = F.col(weight) if weight in df.columns else F.lit(1.0)
        e = df.select(
            *[k for k in KEYS if k in df.columns],
            F.col(parent).alias("node"),
            F.col(child).alias("child"),
            F.coalesce(w, F.lit(1.0)).alias("weight"),
        )
        same = (F.col("_sys_node") == F.col("_sys_child")) & (F.col("_in_node") == F.col("_in_child"))
        e = e.join(ends("node"), "node", "left").join(ends("child"), "child", "left")
        e = scratch.save(
            e.withColumn("same", F.coalesce(same, F.lit(False))).select(
                *edge_keys(df), "node", "child", "weight", "same"
            ),
            label,
        )
        return _ScopeSums(scratch, label, e, totals)

    totals = scratch.save(values.select(*KEYS, "node", "value", "computed", "source"), "totals")
    normal = [
        structure(network.flow, "dst", "src", "weight", "Flow"),
        structure(network.part_of, "parent", "child", "weight", "PartOfAggregation"),
        structure(network.type_edges, "parent", "child", "weight", "InterfaceTypeAggregation"),
    ]
    normal = [n for n in normal if n is not None]
    backward = structure(network.flow, "src", "dst", "reverse_weight", "Flow")

    marked = totals.filter(~F.col("computed") | (F.col("source") == "Scale")).select(
        *KEYS, "node", F.col("value").alias("internal"), F.lit(None).cast("double").alias("external"), "source"
    )
    known = KeptState(scratch, [*KEYS, "node"], {"known": ("boolean", F.max("known"))}, "scope-known")
    done: list[DataFrame] = []

    def settle(parts: DataFrame, n: int) -> None:
        done.append(parts)
        known.append(parts.select(*KEYS, "node", F.lit(True).alias("known")), n)

    settle(*scratch.save_counted(marked, "marked"))

    def advance(sums: _ScopeSums) -> bool:
        """Tell a structure the parts that were found since it was asked last; does it determine new ones?"""
        ready = sums.tell(done)
        if ready is None:
            return False
        new = known.beside(ready).filter("old_known is null").drop("old_known")
        new, n = scratch.save_counted(new, "round")
        if n:
            settle(new, n)
        return n > 0

    def run(structures) -> bool:
        moved_any = False
        moved = True
        while moved:
            moved = False
            for sums in structures:
                while advance(sums):
                    moved = moved_any = True
        return moved_any

    run(normal)
    # stuck: read the flow graph backwards, then go on
    while backward is not None and run([backward]):
        if not run(normal):
            break
    parts = union_all(done)
    return (
        parts.select(
            *KEYS,
            "node",
            "source",
            F.explode(
                F.array(
                    F.struct(F.lit("Internal").alias("scope"), F.col("internal").alias("value")),
                    F.struct(F.lit("External").alias("scope"), F.col("external").alias("value")),
                )
            ).alias("_p"),
        )
        .select(*KEYS, "node", "_p.scope", "_p.value", "source")
        .filter("value is not null")
    )


# -- derived tables ---------------------------------------------------------------------
def contributions(solution: Solution, network: Network) -> DataFrame:
    """Origins of every computed value in force: (scenario, period, origin, destination, source,
    weight, quantity) with quantity = weight x origin value."""
    values = solution.results.filter("conflict <> 'Dismissed'").select(*STATE)
    values, n = Scratch(values.sparkSession, "contributions").save_counted(values, "values")  # read for every graph
    made = values.filter("computed").select(*KEYS, "node", "source", "direct", F.col("seq").alias("_seq"))
    origin = values.select(
        *KEYS, F.col("node").alias("input"), F.col("value").alias("_v"), F.col("seq").alias("_at")
    )
    frames = []
    for source, edges in (("Flow", network.flow), ("Scale", network.scale), ("ScaleChange", network.scale_change)):
        if edges is None:
            continue
        inputs = computation_edges(edges).filter("weight is not null")
        rows = skew_join(inputs, made.filter(F.col("source") == source), edge_keys(inputs) + ["node", "direct"])
        rows = skew_join(spread(rows, n, *KEYS, "input"), spread(origin, n, *KEYS, "input"), KEYS + ["input"])
        whole = rows.filter(~F.col("split")).select(*KEYS, "input", "node", "source", "weight", "_v")
        one = (
            rows.filter("split and _at < _seq")
            .groupBy(*KEYS, "node", "source")
            .agg(F.min(F.struct("input", "weight", "_v")).alias("_o"))
            .select(*KEYS, "_o.input", "node", "source", "_o.weight", "_o._v")
        )
        frames += [whole, one]
    for source, edges in (("InterfaceTypeAggregation", network.type_edges), ("PartOfAggregation", network.part_of)):
        if edges is None:
            continue
        w = F.coalesce(F.col("weight"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
        edges = scenario_edges(edges.withColumn("weight", w), values)
        inputs = edges.select(*edge_keys(edges), F.col("parent").alias("node"), F.col("child").alias("input"), "weight")
        rows = skew_join(inputs, made.filter(F.col("source") == source), [*edge_keys(edges), "node"])
        rows = skew_join(spread(rows, n, *KEYS, "input"), spread(origin, n, *KEYS, "input"), KEYS + ["input"]).filter("_at < _seq")
        frames.append(rows.select(*KEYS, "input", "node", "source", "weight", "_v"))
    return union_all(frames).select(
        *KEYS,
        F.col("input").alias("origin"),
        F.col("node").alias("destination"),
        "source",
        "weight",
        (F.col("weight") * F.col("_v")).alias("quantity"),
    )


def result_table(results: DataFrame, nodes: DataFrame, digits: int | None = 3) -> DataFrame:
    """Results with the description of their interface, rounded for output.

    ``nodes(node, processor, interface, type, orientation, roegen_type, unit, level, system,
    subsystem, sphere)``.
    """
    value = F.round("value", digits) if digits is not None else F.col("value")
    out = results.withColumn("value", value).withColumn(
        "computed", F.when(F.col("computed"), F.lit("Yes")).otherwise(F.lit("No"))
    )
    return skew_join(out.drop("direct", "seq"), nodes, ["node"], "left")
