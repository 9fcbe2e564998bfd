"""Formula shapes, parameters with their issues, and cycles named by their members."""

import random

import pytest
from pyspark.sql import functions as F

from tallyflow.functions import formulas
from tallyflow.operators import hierarchy as H
from tallyflow.operators import scenarios as P
from tallyflow.operators.cycles import cyclic_parts


def shapes(spark, *texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(formulas.shape(F.col("t")).alias("s")).select("s.*").collect()
    return [(formulas.shape_sql(r["shape"], "n", "v"), r["numbers"], r["names"]) for r in rows]


def test_shapes(spark):
    got = shapes(spark, "Tax * 0.2 + base", "vat*.35+net", "round(a * 2, 1) + 3", "sqrt(A) - 1e-3", "case when x > 1 then 'a' else y end", "cast(x as double) / 4", "'text'", "1")
    assert got[0] == ("v[0] * n[0] + v[1]", [0.2], ["tax", "base"])
    assert got[1] == ("v[0] * n[0] + v[1]", [0.35], ["vat", "net"])
    assert got[2] == ("round( v[0] * 2 , 1 ) + 3", [], ["a"])  # round needs a constant: the numbers stay
    assert got[3] == ("sqrt( v[0] ) - n[0]", [0.001], ["a"])
    assert got[4] == ("case when v[0] > n[0] then 'a' else v[1] end", [1.0], ["x", "y"])
    assert got[5] == ("cast( v[0] as double ) / 4", [], ["x"])
    assert got[6][0] is None and got[7] == ("n[0]", [1.0], [])
    assert formulas.names_in("case when x > 1 then sqrt(Y) else cast(z as double) end") == {"x", "y", "z"}


def test_linear_formulas_are_coefficient_tables(spark):
    texts = ["2 * a + b", "a - b / 4", "-a*3 + 1.5", "7", "a * b", "sqrt(a)", "a + case", "a + 2 * a - 1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", formulas.is_linear(F.col("t")).alias("l"), formulas.linear_terms(F.col("t")).alias("x")).collect()
    got = {r["t"]: [(x["name"], x["coefficient"]) for x in r["x"]] for r in rows if r["l"]}
    assert got == {
        "2 * a + b": [("a", 2.0), ("b", 1.0)], "a - b / 4": [("a", 1.0), ("b", -0.25)], "-a*3 + 1.5": [("a", -3.0), (None, 1.5)], "7": [(None, 7.0)],
        "a + 2 * a - 1": [("a", 1.0), ("a", 2.0), (None, -1.0)],
    }


def params(spark, *rows):
    return spark.createDataFrame([(s, n, float(v)) for s, n, v in rows], "scenario string, name string, value double")


def test_texts_are_evaluated_once_for_each_scenario(spark):
    rng = random.Random(3)
    names = {f"p{k}": rng.randrange(1, 50) / 4 for k in range(30)}
    kinds = ["{a} * {x} + {b}", "{a} / {x}", "greatest({a}, {b}) - {x}", "({a} + {b}) * {x}", "{x} * {a} - {b} / {y}", "case when {a} > {b} then {x} else {y} end", "{a} + nobody"]
    rows, expected = [], {}
    for k in range(400):
        a, b = rng.sample(sorted(names), 2)
        x, y = rng.randrange(1, 9), rng.randrange(1, 9) / 2
        kind = rng.choice(kinds)
        text = kind.format(a=a.upper(), b=b, x=x, y=y)
        A, B = names[a], names[b]
        value = [A * x + B, A / x, max(A, B) - x, (A + B) * x, x * A - B / y, x if A > B else y, None][kinds.index(kind)]
        rows.append(("s", k, text))
        expected[k] = None if value is None else pytest.approx(value)
    rows += [("s", 1000, "3.5"), ("s", 1001, None), ("s", 1002, "(("), ("s", 1003, "'quoted'")]
    expected |= {1000: 3.5, 1001: None, 1002: None, 1003: None}
    df = spark.createDataFrame(rows, "scenario string, id long, expr string")
    out = P.evaluate_texts(df, "expr", params(spark, *(("s", n, v) for n, v in names.items())), "value").collect()
    assert {r["id"]: r["value"] for r in out} == expected


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_plans_grow_with_shapes_and_not_with_texts(spark):
    def plan(n):
        texts = spark.range(n).select(F.lit("s").alias("scenario"), F.expr("concat('p', id % 7, case id % 3 when 0 then ' * ' when 1 then ' / ' else ' - sqrt(p1) * ' end, id + 1)").alias("expr"))
        rows = texts.withColumn("_f", formulas.shape(F.col("expr"))).withColumn("_values", F.array(F.lit(1.0), F.lit(2.0)))
        return plan_size(P.compute(rows, "value"))

    assert plan(20_000) <= plan(20) + 40


def test_parameter_issues_name_just_the_members(spark):
    rows = [("s", n, "Number", e) for n, e in (("a", "b + 1"), ("b", "c * 2"), ("c", "A - 1"), ("d", "a + 1"), ("e", "nobody"), ("f", "2"), ("g", "f * 3"), ("h", "h + 1"), ("i", "sqrt(-f) + g / e"))]
    grid = spark.createDataFrame([*rows, ("t", "a", "Number", "1"), ("t", "x", "String", "text")], "scenario string, name string, type string, expr string")
    solved, issues = P.solve_params(grid)
    assert {(r["scenario"], r["name"]): r["value"] for r in solved.collect()} == {("s", "f"): 2.0, ("s", "g"): 6.0, ("t", "a"): 1.0, ("t", "x"): None}
    got = {r["key"]: (r["rule"], r["message"]) for r in issues.collect()}
    circle = ("parameter in a cycle", "s:a")
    assert got == {
        "s:a": circle, "s:b": circle, "s:c": circle, "s:h": ("parameter in a cycle", "s:h"), "s:e": ("parameter uses an unknown name", "nobody"),
        "s:d": ("parameter depends on one without value", "a + 1"), "s:i": ("parameter depends on one without value", "sqrt(-f) + g / e"),
    }
    with pytest.raises(ValueError, match="parameter in a cycle: s:a"):
        P.eval_params(grid)


def plain_parts(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for _ in nodes:
        reach = {n: r | {y for x in r for y in reach[x]} for n, r in reach.items()}
    return {n: min(m for m in nodes if m == n or (m in reach[n] and n in reach[m])) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_are_the_components_of_a_plain_search(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(50)}
    edges |= {(f"x{k:02}", f"x{(k + 1) % 12:02}") for k in range(12)} | {(f"x{k:02}", f"y{k:02}") for k in range(12)} | {(f"y{k:02}", f"y{k + 1:02}") for k in range(30)} | {("z", "z")}
    got = cyclic_parts(spark.createDataFrame(sorted(edges), "src string, dst string"))
    assert {r["node"]: r["part"] for r in got.collect()} == plain_parts(edges)


def test_no_cycles(spark):
    assert cyclic_parts(spark.createDataFrame([("a", "b"), ("b", "c"), (None, "a")], "src string, dst string")).count() == 0
    assert cyclic_parts(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_heights_name_the_cycle(spark):
    tree = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("b", "c")], "parent string, child string")
    with pytest.raises(ValueError, match="cycle: a, b$"):
        H.heights(tree).collect()


def test_formulas_are_taken_apart_once_for_each_text(spark):
    rows = spark.createDataFrame([(i, t, {"a": float(i)}) for i in range(30) for t in ("a * 2", "a - 1", " 7 ", "1e2", "nope(", None)], "i int, t string, v map<string,double>")
    texts = P.shaped_texts(rows, "t")
    assert sorted(r["t"] for r in texts.collect()) == ["a * 2", "a - 1", "nope("]
    got = {(r["i"], r["t"]): r["x"] for r in P.evaluate(rows, "t", "v", "x").collect()}
    assert len(got) == 180 and got[3, "a * 2"] == 6.0 and got[3, "a - 1"] == 2.0
    assert got[0, " 7 "] == 7.0 and got[0, "1e2"] == 100.0 and got[5, "nope("] is None and got[5, None] is None
