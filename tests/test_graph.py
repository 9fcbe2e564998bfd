"""Small graphs with known results (weights, propagation, conflicts)."""

import pytest

from tallyflow.operators import graph as G

EDGES = "src string, dst string, weight double, reverse_weight double"


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), EDGES)


def values(spark, **known):
    return spark.createDataFrame([(k, float(v)) for k, v in known.items()], "node string, value double")


def solve(spark, comp, *cases):
    """All cases in one run: the case is a key like a scenario."""
    known = spark.createDataFrame(
        [(i, k, float(v)) for i, c in enumerate(cases) for k, v in c.items()], "case int, node string, value double"
    )
    out = [{} for _ in cases]
    for r in G.compute_values(comp, known, ["case"]).collect():
        out[r["case"]][r["node"]] = r["value"]
    return out


def test_flow_weight_inference(spark):
    e = edges(
        spark,
        ("D", "A", 1.0, None), ("E", "A", 1.0, None), ("A", "B", 2.0, None), ("B", "C", 0.7, 0.1),
        ("F", "C", 1.0, None), ("C", "G", None, None), ("H", "G", 0.5, 0.9), ("I", "G", 0.4, 0.1),
    )
    done, _ = G.complete_weights(e)
    got = {(r["src"], r["dst"]): r for r in done.collect()}
    assert got["A", "B"]["reverse_weight"] == pytest.approx(0.5)
    assert got["F", "C"]["reverse_weight"] == pytest.approx(0.9)
    assert got["C", "G"]["weight"] == pytest.approx(1.0)
    assert got["C", "G"]["reverse_weight"] == pytest.approx(0.0)
    assert {r["dst"] for r in got.values() if r["dst_split"]} == {"C", "G"}
    assert not any(r["src_split"] for r in got.values())


def test_scale_edge_blocks_inference(spark):
    e = edges(spark, ("A", "B", None, None))
    s = spark.createDataFrame([("B", "A")], "src string, dst string")
    assert G.complete_weights(e, s)[0].first()["weight"] is None
    assert G.complete_weights(e)[0].first()["weight"] == 1.0


def test_chain(spark):
    comp = G.computation_edges(edges(spark, ("A", "B", 2.0, 0.5), ("B", "C", 0.7, 0.1)))
    one, two = solve(spark, comp, {"B": 5}, {"C": 10})
    assert one["A"] == 2.5
    assert two["A"] == 0.5


def test_simple(spark):
    comp = G.computation_edges(
        edges(spark, ("A", "B", 2.0, 0.5), ("B", "C", 0.7, 1.4285714), ("C", "D", 0.1, None), ("E", "D", 0.1, None))
    )
    a, b, c = solve(spark, comp, {"A": 5, "E": 8}, {"B": 10, "E": 8}, {"C": 4, "E": 8})
    assert a["D"] == pytest.approx(1.5)
    assert b["D"] == pytest.approx(1.5)
    assert c["D"] == pytest.approx(1.2)


def test_star_split(spark):
    e = edges(
        spark, ("A", "B", 0.05, 20.0), ("A", "C", 0.7, 1.4285714), ("A", "D", 0.1, 10.0), ("A", "E", 0.15, 6.66666667)
    )
    done, _ = G.complete_weights(e)
    comp = G.computation_edges(done)
    b, c, d, e5, a, b10 = solve(spark, comp, {"B": 5}, {"C": 10}, {"D": 8}, {"E": 12}, {"A": 5}, {"B": 10})
    assert b["A"] == pytest.approx(100)
    assert c["A"] == pytest.approx(14.285714)
    assert d["A"] == pytest.approx(80)
    assert e5["A"] == pytest.approx(80)
    assert (a["B"], a["C"]) == (pytest.approx(0.25), pytest.approx(3.5))
    assert (b10["A"], b10["C"]) == (pytest.approx(200), pytest.approx(140))


def test_star_without_weights(spark):
    e = edges(spark, *[("A", x, None, None) for x in "BCDE"])
    done, gaps = G.complete_weights(e)
    assert {r["reverse_weight"] for r in done.collect()} == {1.0}
    assert gaps.count() == 1
    assert solve(spark, G.computation_edges(done), {"B": 5, "C": 10, "D": 8, "E": 12})[0]["A"] == 35


def test_reverse(spark):
    e = edges(
        spark,
        ("A", "B", 2.0, 0.5), ("B", "C", 0.7, 0.1), ("C", "D", 0.7, 0.1), ("C", "E", 0.3, 0.1),
        ("F", "G", 0.7, 0.1), ("G", "E", 0.7, 0.1), ("B", "G", 0.7, 0.1),
    )
    done, _ = G.complete_weights(e)
    comp = G.computation_edges(done)
    one, two = solve(spark, comp, {"B": 5}, {"C": 10})
    assert one["A"] == 2.5
    assert "A" not in two
    b, c = values(spark, B=1), values(spark, C=1)
    pairs = {tuple(r) for r in G.known_conflicts(comp, b, c).collect()}
    assert pairs == {("B", "C"), ("C", "B")}


def test_cascade(spark):
    d = spark.createDataFrame([("T1", "T2", 1.0), ("T3", "T1", 0.5)], "code string, term string, coefficient double")
    v = spark.createDataFrame([("T2", 3.0)], "node string, value double")
    assert {r["node"]: r["value"] for r in G.cascade(d, v).collect()} == {"T1": 3.0, "T2": 3.0, "T3": 1.5}


def test_hidden_node_of_type_change(spark):
    nodes = spark.createDataFrame(
        [
            ("P:X", "P", "X", "Output", True), ("Q:Y", "Q", "Y", "Input", True), ("Q:X", "Q", "X", "Input", True),
            ("P:Y", "P", "Y", "Input", True), ("Z:X", "Z", "X", "Input", False),
        ],
        "node string, processor string, type string, orientation string, accounted boolean",
    )
    flows = spark.createDataFrame(
        [("P:X", "Q:Y", 0.5, "P:Y", 4.0), ("P:X", "Q:X", 1.0, None, None), ("P:X", "Z:X", 1.0, None, None)],
        "src string, dst string, weight double, back string, scale_change_weight double",
    )
    flow, change, hidden = G.flow_edges_for_solve(flows, nodes)
    h = "P-Q:X:Input/Output"
    assert {tuple(r) for r in flow.select("src", "dst", "weight").collect()} == {("P:X", h, 0.5), (h, "Q:X", 1.0)}
    assert {(r["src"], r["dst"], r["weight"], r["reverse_weight"]) for r in change.collect()} == {
        (h, "Q:Y", 4.0, 0.25), (h, "P:Y", 4.0, 0.25),
    }
    assert [r["node"] for r in hidden.collect()] == [h]


def test_hidden_nodes_with_and_without_back_interface(spark, monkeypatch):
    import tallyflow.runtime as runtime

    monkeypatch.setattr(runtime, "SPREAD_ROWS", 1)  # every table is dealt to many tasks
    face = "node string, processor string, type string, orientation string, accounted boolean"
    nodes = spark.createDataFrame([("a:x", "a", "X", "Output", True), ("b:y", "b", "Y", "Input", True), ("c:y", "c", "Y", "Input", True), ("a:r", "a", "R", "Input", False)], face)
    flows = [("a:x", "b:y", 0.5, None, 4.0), ("a:x", "c:y", 0.25, "b:y", None), ("a:x", "c:y", 0.25, "a:r", None), ("a:x", "c:y", 0.75, None, None)]
    flows = spark.createDataFrame(flows, "src string, dst string, weight double, back string, scale_change_weight double")
    flow, change, hidden = G.flow_edges_for_solve(flows, nodes)
    assert sorted((r["src"], r["dst"], r["weight"]) for r in flow.collect()) == [
        ("a:x", "a-b:X:Input/Output", 0.5), ("a:x", "a-c:X:Input/Output", 0.25), ("a:x", "c:y", 0.75),
    ]
    assert sorted((r["src"], r["dst"], r["weight"]) for r in change.collect()) == [
        ("a-b:X:Input/Output", "b:y", 4.0), ("a-c:X:Input/Output", "b:y", 1.0), ("a-c:X:Input/Output", "c:y", 1.0),
    ]


def test_completed_weights_are_written_for_their_readers(spark):
    done, _ = G.complete_weights(edges(spark, ("A", "B", None, None), ("A", "C", 0.25, None)))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(done) and "Aggregate" not in plan(done)
    got = {(r["node"], r["input"], r["direct"]): (r["weight"], r["n_inputs"]) for r in G.computation_edges(done).collect()}
    assert got["B", "A", True] == (0.75, 1) and got["A", "C", False][1] == 2
