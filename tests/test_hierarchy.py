import random

import pytest

from tallyflow.operators import hierarchy as H


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_paths_and_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c")], "parent string, child string")
    assert rows(H.paths(e), "node", "path") == [
        ("a", "a"), ("b", "a.b"), ("c", "a.b.c"), ("c", "x.c"), ("x", "x"),
    ]
    assert rows(H.closure(e), "ancestor", "descendant", "distance") == [
        ("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("x", "c", 1),
    ]


def test_heights_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "parent string, child string")
    with pytest.raises(ValueError):
        H.heights(e)


def test_infer_hierarchy(spark):
    c = spark.createDataFrame([("A00",), ("A10",), ("A11",), ("A15",), ("B00",), ("B12",)], "code string")
    got = dict(rows(H.infer_hierarchy(c), "code", "parent_code"))
    assert got == {"A00": None, "A10": "A00", "A11": "A10", "A15": "A10", "B00": None, "B12": "B00"}


def python_rollup(children, values, policy):
    """Plain recursion used as the expected result."""
    memo = {}

    def val(n):
        if n not in memo:
            total, seen, bad = 0.0, False, False
            for c, w in children.get(n, []):
                v = val(c)
                if v is None:
                    bad = True
                else:
                    total, seen = total + w * v, True
            s = total if seen and not (bad and policy == "Invalidate") else None
            memo[n] = values.get(n) if values.get(n) is not None else s
        return memo[n]

    return {n: val(n) for n in set(children) | {c for cs in children.values() for c, _ in cs}}


@pytest.mark.parametrize("policy", ["Invalidate", "UseZero"])
def test_rollup_random_dag(spark, policy):
    rnd = random.Random(7)
    edges, children = [], {}
    for c in range(1, 80):
        for p in rnd.sample(range(c), min(c, rnd.choice([1, 1, 2]))):
            w = rnd.choice([0.0, 0.5, 1.0, 2.0])
            edges.append((p, c, w))
            children.setdefault(p, []).append((c, w))
    values = {n: float(n) for n in range(80) if n not in children and rnd.random() < 0.8}
    values[3] = 5.0
    e = spark.createDataFrame(edges, "parent long, child long, weight double")
    v = spark.createDataFrame(list(values.items()), "node long, value double")
    got = {r["node"]: r["value"] for r in H.rollup(e, v, policy).collect()}
    want = {n: x for n, x in python_rollup(children, values, policy).items() if x is not None}
    assert got == pytest.approx(want)


def test_link_hops(spark):
    part_of = spark.createDataFrame(
        [("r", "a"), ("r", "b"), ("a", "a1"), ("b", "b1"), ("b1", "b2")], "parent string, child string"
    )
    links = spark.createDataFrame(
        [(1, "a1", "b2", 2.0), (2, "b2", "b", 3.0), (3, "b", "b2", 4.0), (4, "a1", "z", 1.0)],
        "link int, src string, dst string, extension double",
    )
    hops = H.link_hops(links, part_of)
    got = rows(hops, "link", "hop", "src", "dst")
    assert got == [
        (1, 1, "a1", "a"), (1, 2, "a", "b"), (1, 3, "b", "b1"), (1, 4, "b1", "b2"),
        (2, 1, "b2", "b1"), (2, 2, "b1", "b"),
        (3, 1, "b", "b1"), (3, 2, "b1", "b2"),
        (4, 1, "a1", "a"), (4, 2, "a", "r"), (4, 3, "r", "z"),
    ]
    flows = {(r["src"], r["dst"]): r["extension"] for r in H.impute_links(links, hops).collect()}
    assert flows[("b", "b1")] == 6.0 and flows[("a1", "a")] == 3.0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rnd.randrange(30), 100 + rnd.randrange(30)) for _ in range(25)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {n: find(n) for n in list(parent)}
    e = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in H.components(e).collect()} == want


def test_contain_and_scale(spark):
    pairs = spark.createDataFrame([("P", "A", 2.0), ("P", "B", 0.5)], "parent string, child string, factor double")
    flows = spark.createDataFrame(
        [("P", "x", 1.0), ("A", "x", 3.0), ("A", "y", 4.0), ("B", "y", 10.0)], "node string, flow string, value double"
    )
    got = {(r["node"], r["flow"]): r["value"] for r in H.contain(pairs, flows).collect()}
    assert got == {("P.A", "x"): 6.0, ("P.A", "y"): 8.0, ("P.B", "y"): 5.0, ("P", "x"): 7.0, ("P", "y"): 13.0}
    e = spark.createDataFrame([("P", "A"), ("A", "B")], "parent string, child string")
    k = spark.createDataFrame([("A", 3.0)], "node string, factor double")
    scaled = {(r["node"], r["flow"]): r["value"] for r in H.scale_subtree(flows, e, k).collect()}
    assert scaled[("B", "y")] == 30.0 and scaled[("P", "x")] == 1.0


def test_heights_of_repeated_edges_and_inner_nodes(spark):
    from tallyflow.operators.hierarchy import heights

    e = spark.createDataFrame([("r", "a"), ("r", "a"), ("a", "b"), ("r", "c"), ("x", "c")], "parent string, child string")
    got = sorted(map(tuple, heights(e).select("node", "height").collect()))
    assert got == [("a", 1), ("b", 0), ("c", 0), ("r", 2), ("x", 1)]
