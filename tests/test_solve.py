"""Fix-point, conflicts and scope on small networks with hand-computed results."""

import pytest

from tallyflow.operators import solve as S

OBS = "scenario string, period string, node string, value double"
FLOW = "src string, dst string, weight double, reverse_weight double"
TREE = "parent string, child string, weight double"


def table(sol, conflict=None):
    rows = sol.results.collect()
    return {
        (r["scenario"], r["node"]): (r["value"], r["source"])
        for r in rows
        if conflict is None or r["conflict"] == conflict
    }


def test_chain_of_sources(spark):
    net = S.Network(
        flow=spark.createDataFrame([("B", "C", 0.5, None)], FLOW),
        scale=spark.createDataFrame([("C", "D", 10.0)], "src string, dst string, weight double"),
        part_of=spark.createDataFrame([("B", "b1", 1.0), ("B", "b2", 2.0), ("E", "D", 1.0), ("E", "b3", 1.0)], TREE),
    )
    obs = spark.createDataFrame(
        [("s", "2020", "b1", 1.0), ("s", "2020", "b2", 3.0), ("t", "2020", "b1", 4.0)], OBS
    )
    policies = {"t": S.Policy(missing="Invalidate")}
    sol = S.solve(net, obs, policies)
    got = table(sol)
    assert got["s", "B"] == (7.0, "PartOfAggregation")
    assert got["s", "C"] == (3.5, "Flow")
    assert got["s", "D"] == (35.0, "Scale")
    assert got["s", "E"] == (35.0, "PartOfAggregation")  # b3 counts as zero
    assert set(got) == {("s", n) for n in ["b1", "b2", "B", "C", "D", "E"]} | {("t", "b1")}
    assert sol.results.filter("conflict <> 'No'").count() == 0
    c = {(r["origin"], r["destination"]): r["quantity"] for r in S.contributions(sol, net).collect()}
    assert c == {("b1", "B"): 1.0, ("b2", "B"): 6.0, ("B", "C"): 3.5, ("C", "D"): 35.0, ("D", "E"): 35.0}


def test_conflict_policies_per_scenario(spark):
    """N is reached by Flow (from X) and by aggregation (from c); P is observed and aggregated."""
    net = S.Network(
        flow=spark.createDataFrame([("X", "N", 2.0, None)], FLOW),
        part_of=spark.createDataFrame([("N", "c", 1.0), ("P", "a", 1.0), ("P", "b", 1.0), ("Q", "P", 1.0)], TREE),
    )
    known = [("X", 5.0), ("c", 7.0), ("a", 1.0), ("b", 2.0), ("P", 10.0)]
    obs = spark.createDataFrame([(s, "1", n, v) for s in ("upper", "lower") for n, v in known], OBS)
    flow_first = ("Flow", "Scale", "PartOfAggregation", "InterfaceTypeAggregation", "ScaleChange")
    sol = S.solve(net, obs, {"lower": S.Policy(aggregation="TakeLowerAggregation", sources=flow_first)})
    taken, lost, free = (table(sol, c) for c in ("Taken", "Dismissed", "No"))
    assert taken["upper", "P"] == (10.0, None) and lost["upper", "P"] == (3.0, "PartOfAggregation")
    assert taken["lower", "P"] == (3.0, "PartOfAggregation") and lost["lower", "P"] == (10.0, None)
    assert free["upper", "Q"][0] == 10.0 and free["lower", "Q"][0] == 3.0
    assert ("upper", "P") not in free
    assert taken["upper", "N"] == (7.0, "PartOfAggregation") and lost["upper", "N"] == (10.0, "Flow")
    assert taken["lower", "N"] == (10.0, "Flow") and lost["lower", "N"] == (7.0, "PartOfAggregation")


def test_reverse_flow_meets_observation(spark):
    net = S.Network(flow=spark.createDataFrame([("A", "B", 0.5, 2.0)], FLOW))
    obs = spark.createDataFrame([("s", "1", "A", 4.0)], OBS)
    sol = S.solve(net, obs)
    assert table(sol, "No")["s", "B"] == (2.0, "Flow")
    assert table(sol, "Taken")["s", "A"] == (4.0, None)
    assert table(sol, "Dismissed")["s", "A"] == (4.0, "Flow")


def test_scope_split(spark):
    net = S.Network(part_of=spark.createDataFrame([("P", "a", 1.0), ("P", "e", 2.0), ("Q", "P", 1.0)], TREE))
    obs = spark.createDataFrame([("s", "1", "a", 1.0), ("s", "1", "e", 3.0)], OBS)
    nodes = spark.createDataFrame(
        [("a", "X", "Local"), ("e", "X", "External"), ("P", "X", "Local"), ("Q", "X", "Environment")],
        "node string, system string, subsystem string",
    )
    sol = S.solve(net, obs)
    got = {(r["node"], r["scope"]): r["value"] for r in S.scope_split(sol.values, net, nodes).collect()}
    assert got == {
        ("a", "Internal"): 1.0, ("e", "Internal"): 3.0,
        ("P", "Internal"): 1.0, ("P", "External"): 6.0,
        ("Q", "Internal"): 1.0, ("Q", "External"): 6.0,
    }


def test_observer_priority(spark):
    obs = spark.createDataFrame(
        [("1", "n", 1.0, "b"), ("1", "n", 2.0, "a"), ("1", "n", 9.0, None), ("1", "m", 3.0, "z"), ("1", "k", 1.0, None), ("1", "k", 2.0, None)],
        "period string, node string, value double, observer string",
    )
    best, issues = S.pick_observations(obs, ["a", "b"])
    got = {r["node"]: (r["value"], r["observer"]) for r in best.collect()}
    assert got["n"] == (2.0, "a") and got["m"] == (3.0, "z")
    assert {(r["rule"], r["key"]) for r in issues.collect()} == {
        ("several observations without observer", "1|k"),
        ("observer not in the priority list", "z"),
    }


def test_source_priority_is_checked():
    with pytest.raises(ValueError):
        S.Policy(sources=("Flow", "Flow", "Scale", "ScaleChange", "PartOfAggregation"))


def test_hierarchy_weights_per_scenario_in_one_run(spark):
    """Common and differing edges solved at once give what one solve for each scenario gives."""
    tree = "scenario string, parent string, child string, weight double"
    edges = [
        (None, "P", "a", 1.0), (None, "P", "b", 2.0), (None, "Q", "P", 1.0), (None, "Q", "c", 1.0),
        ("s", "P", "a", 3.0), ("t", "P", "d", 1.0), ("t", "Q", "c", 0.5), ("u", "R", "Q", 1.0), ("t", "R", "d", 2.0),
    ]
    obs = [(s, "1", n, v) for s in "stu" for n, v in (("a", 1.0), ("b", 10.0), ("c", 100.0))] + [("t", "1", "d", 7.0)]
    for missing, drop in (("UseZero", ()), ("Invalidate", ("c",))):
        rows = [o for o in obs if o[2] not in drop]
        one = S.solve(S.Network(part_of=spark.createDataFrame(edges, tree)), spark.createDataFrame(rows, OBS), default=S.Policy(missing=missing))
        expected = {}
        for s in "stu":
            own = {(p, c): w for k, p, c, w in edges if k is None} | {(p, c): w for k, p, c, w in edges if k == s}
            net = S.Network(part_of=spark.createDataFrame([(p, c, w) for (p, c), w in own.items()], TREE))
            expected |= table(S.solve(net, spark.createDataFrame([o for o in rows if o[0] == s], OBS), default=S.Policy(missing=missing)))
        assert table(one) == expected
        if not drop:
            assert expected["s", "P"][0] == 23.0 and expected["t", "R"][0] == 14.0 and expected["u", "R"][0] == 121.0
