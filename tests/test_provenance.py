import pytest
from pyspark.sql import functions as F

from tallyflow.operators import provenance as O
from tallyflow.operators import solve as S
from tallyflow.runtime import small_table

STEP = "scenario string, period string, origin string, destination string, source string, weight double, quantity double"
VALUE = "scenario string, period string, node string, value double"


def steps(spark, edges):
    return small_table(spark, [("s", p, a, b, "Flow", w, 0.0) for p, a, b, w in edges], STEP)


def found(df):
    return {(r["period"], r["origin"], r["destination"]): (r["weight"], r["quantity"]) for r in df.collect()}


def brute(edges):
    """Sum over all paths that start where nothing ends."""
    made = {(p, b) for p, _, b, _ in edges}
    out = {}

    def walk(p, start, at, w):
        for q, a, b, x in edges:
            if (q, a) == (p, at):
                out[p, start, b] = out.get((p, start, b), 0.0) + w * x
                walk(p, start, b, w * x)

    for p, a in {(p, a) for p, a, _, _ in edges} - made:
        walk(p, a, a, 1.0)
    return out


EDGES = [
    ("1", "a", "x", 2.0), ("1", "b", "x", 0.5), ("1", "x", "y", 3.0), ("1", "a", "y", 1.0), ("1", "y", "z", 1.0), ("1", "x", "z", -1.0),
    ("1", "a", "x", 0.25),  # a second edge beside the first
    ("2", "x", "a", 4.0), ("2", "a", "y", 0.0),
]


def test_paths_are_multiplied_and_added(spark):
    values = small_table(spark, [("s", p, n, float(i)) for p in "12" for i, n in enumerate("abxyz", 1)], VALUE)
    c = steps(spark, EDGES)
    want = brute(EDGES)
    got = found(O.provenance(c, values))
    assert {k: w for k, (w, _) in got.items()} == pytest.approx(want)
    assert got["1", "b", "z"][1] == pytest.approx(2.0 * want["1", "b", "z"])
    targets = small_table(spark, [("s", "1", "z"), ("s", "1", "z"), ("s", "2", "a"), ("s", "9", "z")], "scenario string, period string, node string")
    part = found(O.provenance(c, values, targets))
    assert {k: w for k, (w, _) in part.items()} == pytest.approx({k: w for k, w in want.items() if (k[0], k[2]) in {("1", "z"), ("2", "a")}})
    assert O.provenance(c.limit(0), values).count() == O.provenance(c.limit(0), values, targets).count() == 0


def test_long_chains_and_cycles(spark):
    chain = [("1", f"n{i}", f"n{i + 1}", 2.0) for i in range(12)]
    values = small_table(spark, [("s", "1", "n0", 1.0)], VALUE)
    got = found(O.provenance(steps(spark, chain), values))
    assert len(got) == 12 and got["1", "n0", "n12"] == (4096.0, 4096.0)
    with pytest.raises(ValueError, match="cycles"):
        O.provenance(steps(spark, [("1", "o", "a", 1.0), ("1", "a", "b", 1.0), ("1", "b", "a", 1.0)]), values, most_steps=5)


def test_quantities_add_up_to_the_value(spark):
    obs = small_table(spark, [("s", "1", "a", 5.0), ("s", "1", "b", 7.0), ("s", "1", "c", 11.0)], VALUE)
    part_of = small_table(spark, [("m", "a", 1.0), ("m", "b", 0.5), ("top", "m", 1.0), ("top", "c", 2.0)], "parent string, child string, weight double")
    scale = small_table(spark, [("top", "tax", 0.1)], "src string, dst string, weight double")
    net = S.Network(part_of=part_of, scale=scale)
    out = S.solve(net, obs)
    steps_ = S.contributions(out, net)
    sums = {r["destination"]: r["q"] for r in O.provenance(steps_, out.values).groupBy("destination").agg(F.sum("quantity").alias("q")).collect()}
    made = {r["node"]: r["value"] for r in out.values.filter("computed").collect()}
    assert sums == pytest.approx(made) and set(made) == {"m", "top", "tax"}
    told = {r["node"]: r["expression"] for r in O.with_expression(out.results, steps_, terms=1).collect()}
    assert told["m"] == "1.0*a + 1 more (3.5)" and told["tax"] == "0.1*top" and told["a"] is None
    full = {r["node"]: r["expression"] for r in O.with_expression(out.results, steps_).collect()}
    assert full["top"] == "2.0*c + 1.0*m"
