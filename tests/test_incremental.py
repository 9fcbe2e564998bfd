"""Rounds that read what changed: the state kept between them against plain recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from tallyflow.operators import graph as G
from tallyflow.operators import hierarchy as H
from tallyflow.operators import incremental as I
from tallyflow.runtime import Scratch, sorted_numbers

INPUTS = "node string, input string, weight double, direct boolean, n_inputs long, split boolean"


def plain_values(inputs, known):
    """Level-synchronous: every round evaluates every node from all that is known."""
    values = dict(known)
    while True:
        new = {}
        for node in {r[0] for r in inputs} - set(values):
            for direct in (True, False):
                mine = [r for r in inputs if r[0] == node and r[3] == direct and r[2] is not None and r[1] in values]
                if mine and mine[0][5]:
                    first = min(mine, key=lambda r: r[1])
                    new[node] = first[2] * values[first[1]]
                elif mine and len(mine) == mine[0][4]:
                    new[node] = sum(r[2] * values[r[1]] for r in mine)
                if node in new:
                    break
        if not new:
            return values
        values |= new


def random_inputs(rng, n):
    rows = []
    for k in range(n):
        node = f"n{k}"
        for direct in (True, False):
            inputs = rng.sample([f"n{j}" for j in range(n) if j != k], rng.choice([0, 0, 1, 2, 3]))
            split = len(inputs) > 1 and rng.random() < 0.4
            rows += [(node, i, rng.choice([None, 0.5, 2.0, 3.0, 0.25]), direct, len(inputs), split) for i in inputs]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_kept_state_gives_the_plain_fixpoint(spark, monkeypatch, small):
    if small:  # merged and bucketed at every turn
        monkeypatch.setattr(I, "MOST_TABLES", 1)
        monkeypatch.setattr(I, "BUCKET_ROWS", 3)
    rng = random.Random(11)
    cases, rows, known = [], [], []
    for case in range(6):
        inputs = random_inputs(rng, 14)
        given = {f"n{k}": float(rng.randrange(1, 9)) for k in rng.sample(range(14), 3)}
        cases.append(plain_values(inputs, given))
        rows += [(f"{case}:{a}", f"{case}:{b}", *more) for a, b, *more in inputs]
        known += [(f"{case}:{n}", v) for n, v in given.items()]
    found = G.compute_values(spark.createDataFrame(rows, INPUTS), spark.createDataFrame(known, "node string, value double"))
    got = {r["node"]: r["value"] for r in found.collect()}
    assert got == {f"{c}:{n}": pytest.approx(v) for c, values in enumerate(cases) for n, v in values.items()}
    assert len(got) > len(known)


def test_a_round_reads_the_kept_state_of_the_nodes_it_reaches(spark, monkeypatch):
    """A chain beside a mass of known nodes: the state that a late round looks at has one row, not the mass."""
    looked_at = []
    beside = I.KeptState.beside

    def counted(self, delta):
        if "known" in self.types and "sum_d" in self.types:
            looked_at.append(delta.count())
        return beside(self, delta)

    monkeypatch.setattr(I.KeptState, "beside", counted)
    chain = [(f"c{k + 1}", f"c{k}", 1.0, True, 1, False) for k in range(10)]
    mass = [(f"m{k}", f"g{k % 50}", 2.0, True, 1, False) for k in range(500)]
    given = [("c0", 1.0), *((f"g{k}", 1.0) for k in range(50))]
    out = G.compute_values(spark.createDataFrame(chain + mass, INPUTS), spark.createDataFrame(given, "node string, value double"))
    assert out.count() == 11 + 550
    assert looked_at[0] == 501 and set(looked_at[1:]) == {1}


def test_replaced_values_correct_the_sums(spark):
    rows = [("t", "a", 2.0, True, 2, False), ("t", "b", 3.0, True, 2, False), ("s", "b", 1.0, True, 2, True), ("s", "c", 5.0, True, 2, True)]
    work = G.Propagation(spark.createDataFrame(rows, INPUTS), [], Scratch(spark, "t"))
    frame = lambda *r: spark.createDataFrame(list(r), "node string, value double, diff double, fresh long, round long")
    assert work.step(frame(("a", 1.0, 1.0, 1, 0))).count() == 0
    assert work.step(frame(("a", 4.0, 3.0, 0, 1))).count() == 0
    assert {(r["node"], r["value"]) for r in work.step(frame(("b", 1.0, 1.0, 1, 2))).collect()} == {("t", 11.0), ("s", 1.0)}


def test_sorted_numbers_keep_the_order(spark):
    words = [f"w{random.Random(k).random()}" for k in range(300)] + [None, "", "Ä", "a"]
    numbers, n = sorted_numbers(spark.createDataFrame([(w,) for w in words * 2], "word string"), "word", "place", Scratch(spark, "t"))
    rows = numbers.orderBy("place").collect()
    assert n == len(rows) == 303 and [r["word"] for r in rows] == sorted((w for w in words if w is not None), key=lambda w: w.encode())


def test_rollup_reads_every_level_once(spark, monkeypatch):
    added = []
    add = H.Sweep.add
    monkeypatch.setattr(H.Sweep, "add", lambda self, h, values: (added.append(h), add(self, h, values))[1])
    edges = [("r", "a"), ("r", "b"), ("a", "c"), ("a", "d"), ("c", "e"), ("r", "f"), ("b", "f")]
    tree = spark.createDataFrame(edges, "parent string, child string")
    values = spark.createDataFrame([("e", 1.0), ("d", 2.0), ("f", 4.0), ("b", 100.0)], "node string, value double")
    got = {r["node"]: (r["value"], r["computed"]) for r in H.rollup(tree, values, "UseZero").collect()}
    assert got == {"e": (1.0, False), "d": (2.0, False), "f": (4.0, False), "b": (100.0, False), "c": (1.0, True), "a": (3.0, True), "r": (107.0, True)}
    assert added == [0, 1, 2]
    assert "r" in {r["node"] for r in H.rollup(tree, values.filter("node <> 'e'"), "UseZero").collect()}
    assert "r" not in {r["node"] for r in H.rollup(tree, values.filter("node <> 'e'"), "Invalidate").collect()}


def test_cascade_solves_for_any_variable(spark):
    d = [("x", "a", 2.0), ("x", "b", 1.0), ("y", "x", 1.0), ("y", "c", -1.0), ("z", "z2", 0.0), ("w", "y", 0.5), ("w", "x", 0.5)]
    out = G.cascade(spark.createDataFrame(d, "code string, term string, coefficient double"), spark.createDataFrame([("x", 10.0), ("a", 3.0), ("y", 7.0)], "node string, value double"))
    assert {r["node"]: r["value"] for r in out.collect()} == {"x": 10.0, "a": 3.0, "y": 7.0, "b": 4.0, "c": 3.0, "w": 8.5}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "node string, value double")
    assert G.compute_values(spark.createDataFrame([], INPUTS), none).count() == 0
    assert G.compute_values(spark.createDataFrame([("a", "b", 1.0, True, 1, False)], INPUTS), none.filter(F.lit(False))).count() == 0
    assert G.cascade(spark.createDataFrame([("a", "b", 1.0)], "code string, term string, coefficient double"), none).count() == 0
