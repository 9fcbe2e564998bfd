import pytest
from pyspark.sql import functions as F

from tallyflow.functions.scalar import wildcard_regex
from tallyflow.operators import export as E
from tallyflow.operators import filters as Q
from tallyflow.operators import network as N
from tallyflow.operators import scenarios as P
from tallyflow.operators import solve as S


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_wildcard_regex(spark):
    got = spark.createDataFrame([("A..B",), ("..B",), ("A.B",), ("..",), ("A..",)], "p string").select(
        "p", wildcard_regex(F.col("p")).alias("r")
    )
    assert dict(tuple(r) for r in got.collect()) == {
        "A..B": r"^A\..*B", "..B": r"^.*\.B", "A.B": r"^A\.B", "..": "^.*", "A..": r"^A\..*",
    }


def test_expand_relations(spark):
    procs = spark.createDataFrame([(n,) for n in ["A", "A.x", "A.x.Bz", "C.B", "D"]], "processor string")
    rel = spark.createDataFrame(
        [(1, "A..B", "D"), (2, "..B", "A..")], "relation int, source string, target string"
    )
    assert rows(N.expand_relations(rel, procs), "relation", "source", "target") == [
        (1, "A.x.Bz", "D"),
        (2, "A.x.Bz", "A.x"), (2, "A.x.Bz", "A.x.Bz"), (2, "C.B", "A.x"), (2, "C.B", "A.x.Bz"),
    ]


def test_template_rows(spark):
    ds = spark.createDataFrame([("es", "x", 1.5), ("pt", " ", 2.0)], "geo string, item string, v double")
    out = N.template_rows(ds, "d", {"processor": "P_{upper(d.geo)}_{d.item}", "value": "{d.v}", "kind": "k"}, ["geo", "item"], ["v"])
    assert [tuple(r) for r in out.collect()] == [("P_ES_x", "1.5", "k")]
    assert rows(N.template_rows(ds, "d", {"p": "{d.geo}"}, ["geo", "item"], ["v"]), "p") == [("es",), ("pt",)]
    with pytest.raises(ValueError):
        N.template_rows(ds, "d", {"p": "{d.geo}{d.v}"}, ["geo", "item"], ["v"])
    with pytest.raises(ValueError):
        N.template_rows(ds, "d", {"p": "{other.geo}"}, ["geo", "item"], ["v"])


def test_build_processors(spark):
    r = spark.createDataFrame(
        [("P", None, "Yes", None, None), ("c", "P", "No", "0.5", None), ("P", None, "Yes", None, None),
         ("a.b", None, "Yes", None, None), ("d", "Q", "Yes", None, None)],
        "processor string, parent string, accounted string, parent_weight string, behave_as string",
    )
    procs, part_of, issues = N.build_processors(r)
    assert rows(procs, "processor", "accounted") == [("P", True), ("c", False), ("d", True)]
    assert rows(part_of, "parent", "child", "weight") == [("P", "c", "0.5")]
    assert rows(issues, "rule", "key") == [
        ("name must be simple", "a.b"), ("parent processor not found", "Q"), ("repeated declaration", "P"),
    ]


def interfaces(spark, *items):
    return spark.createDataFrame(
        [(f"{p}:{i}", p, i, t, o) for p, i, t, o in items],
        "node string, processor string, interface string, type string, orientation string",
    )


def test_partof_and_type_edges(spark):
    faces = interfaces(spark, ("c", "W", "Blue", "Input"), ("c", "E", "Power", "Output"), ("p", "W", "Blue", "Input"), ("b", "W", "Blue", "Input"))
    part_of = spark.createDataFrame([("p", "c", "b"), ("q", "p", None)], "parent string, child string, behave_as string")
    edges, nodes, issues = N.partof_edges(part_of, faces)
    assert rows(edges, "parent", "child") == [("p:W", "c:W"), ("q:W", "p:W")]
    assert rows(nodes, "node") == [("b:W",), ("c:E",), ("c:W",), ("p:W",), ("q:W",)]
    assert issues.count() == 0
    types = spark.createDataFrame([("Blue", "Water"), ("Green", "Water"), ("Water", "All"), ("All", None)], "type string, parent_type string")
    t_edges, t_nodes = N.type_edges(types, interfaces(spark, ("c", "W", "Blue", "Input"), ("c", "T", "Water", "Input"), ("d", "G", "Green", "Input")))
    assert rows(t_edges, "parent", "child") == [
        ("c:All:Input", "c:T"), ("c:T", "c:W"), ("d:All:Input", "d:Water:Input"), ("d:Water:Input", "d:G"),
    ]
    assert t_nodes.count() == 6


def test_best_transform(spark):
    t = spark.createDataFrame(
        [("a", "b", None, None, 1.0), ("a", "b", "X", None, 2.0), ("a", "b", None, "Y", 3.0), ("a", "b", "X", "Y", 4.0)],
        "source_type string, target_type string, source_context string, target_context string, weight double",
    )
    pairs = spark.createDataFrame(
        [("a", "b", "X", "Y"), ("a", "b", "X", "Z"), ("a", "b", "Z", "Y"), ("a", "b", "Z", "Z")],
        "source_type string, target_type string, source_context string, target_context string",
    )
    assert rows(N.best_transform(pairs, t), "source_context", "target_context", "weight") == [
        ("X", "Y", 4.0), ("X", "Z", 2.0), ("Z", "Y", 3.0), ("Z", "Z", 1.0),
    ]


def model(spark):
    procs = spark.createDataFrame(
        [("I", "S", "Local", True), ("R", "T", "External", False), ("k", "T", "External", False)],
        "processor string, system string, subsystem string, accounted boolean",
    )
    part_of = spark.createDataFrame([("R", "k", None)], "parent string, child string, weight double")
    faces = interfaces(spark, ("I", "LU", "LU", "Input"), ("R", "LU", "LU", "Input"), ("k", "W", "W", "Input"))
    obs = spark.createDataFrame([("R:LU", "R", "LU", "2020", None, "3", None), ("k:W", "k", "W", "2020", None, "5", "LU")],
        "node string, processor string, interface string, period string, observer string, value string, relative_to string")
    return procs, part_of, faces, obs


def test_scalings(spark):
    procs, part_of, faces, obs = model(spark)
    req = spark.createDataFrame(
        [("I", "R", "LU", "LU", "CloneAndScale", "0.4", "N1"), ("I", "k", "LU", "LU", "CloneScaled", "2", "N2"), ("I", "I", "LU", "LU", "Scale", "2", None)],
        "invoking string, requested string, invoking_interface string, requested_interface string, scaling_type string, scale string, new_name string",
    )
    out = N.apply_scalings(req, procs, part_of, faces, obs)
    assert ("I.N1.k", "S", "Local", True) in rows(out["processors"], "processor", "system", "subsystem", "accounted")
    assert rows(out["scales"], "src", "dst", "weight") == [("I:LU", "I.N1:LU", "0.4")]
    assert ("I.N2:W", "10.0", None) in [tuple(r) for r in out["observations"].select("node", "value", "relative_to").collect()]
    assert {("I", "I.N1"), ("I.N1", "I.N1.k"), ("I", "I.N2")} <= set(rows(out["part_of"], "parent", "child"))
    assert rows(out["issues"], "rule") == [("scaling of a processor by itself",)]


def test_upscale(spark):
    procs, part_of, faces, obs = model(spark)
    parents = spark.createDataFrame([("I", "es")], "processor string, geo string")
    children = spark.createDataFrame([("R", "wheat")], "processor string, crop string")
    cells = spark.createDataFrame([("es", "wheat", 0.7), ("es", "rye", 0.1), ("es", "zero", 0.0)], "geo string, crop string, weight double")
    out = N.upscale(cells, parents, children, ["geo"], ["crop"], "LU", {"processors": procs, "part_of": part_of, "interfaces": faces, "observations": obs})
    assert rows(out["scales"], "src", "dst", "weight") == [("I:LU", "I.R:LU", "0.7")]
    assert rows(out["issues"], "rule", "key") == [("negligible weights left out", "LU"), ("requested not matched once", "rye")]


def test_counterparts(spark):
    procs = spark.createDataFrame([("p", "S", "Local", True)], "processor string, system string, subsystem string, accounted boolean")
    faces = interfaces(spark, ("p", "w", "Water", "Input"), ("p", "o", "Waste", "Output")).withColumns(
        {"opposite_subsystem": F.lit("Environment"), "roegen_type": F.lit("Flow"), "unit": F.lit("m3"), "sphere": F.lit("Technosphere")}
    )
    flows = spark.createDataFrame([("p:o", "z:Waste")], "src string, dst string")
    new_p, new_i, new_f = N.add_default_counterparts(procs, faces, flows)
    assert rows(new_p, "processor", "subsystem") == [("S_Environment", "Environment")]
    assert rows(new_i, "node", "orientation", "sphere", "opposite_subsystem") == [("S_Environment:Water", "Output", "Biosphere", "Local")]
    assert rows(new_f, "src", "dst") == [("S_Environment:Water", "p:w")]


def test_interfaces_and_relations(spark):
    procs = spark.createDataFrame([("p", "Local"), ("q", "External")], "processor string, subsystem string")
    types = spark.createDataFrame(
        [("Water", "m3", "Biosphere", "Flow", "environment"), ("Power", "MW", "Technosphere", "Fund", None)],
        "type string, unit string, sphere string, roegen_type string, opposite_subsystem string",
    )
    units = spark.createDataFrame([("l", "m3", 0.001)], "from string, to string, ratio double")
    tr = spark.createDataFrame([("Power", "Water", None, None, 7.0)], "source_type string, target_type string, source_context string, target_context string, weight double")
    r = spark.createDataFrame(
        [("p", None, "Power", "Output", "10", None, None, "2020", None), ("p", "w", "Water", "Input", None, None, "Power", "2020", None),
         ("q", None, "Water", "Input", "500", "l", None, "2020", "obs"), ("z", None, "Water", "Input", None, None, None, None, None),
         ("q", None, "Water", "Input", "5", "kg", None, "2021", None)],
        "processor string, interface string, type string, orientation string, value string, unit string, relative_to string, period string, observer string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("sphere", "roegen_type", "opposite_subsystem")})
    faces, obs, issues = N.build_interfaces(r, procs, types, units, tr)
    assert rows(faces, "node", "type", "opposite_subsystem") == [
        ("p:Power", "Power", None), ("p:w", "Water", "environment"), ("q:Water", "Water", "externalenvironment"),
    ]
    assert {(x["node"], float(x["value"]), x["relative_to"]) for x in obs.collect()} == {
        ("p:Power", 10.0, None), ("p:w", 7.0, "Power"), ("q:Water", 0.5, None),
    }
    assert rows(issues, "rule", "key") == [("processor not declared", "z"), ("units not convertible", "q:Water")]
    rel = spark.createDataFrame(
        [("p", "Power", "q", "Water", None, "Flow", "0.5", None), ("q", "Water", "p", "w", None, "Scale", None, None), ("p", "nope", "q", "Water", None, "Flow", None, None)],
        "source_processor string, source_interface string, target_processor string, target_interface string, back_interface string, relation_type string, weight string, change_type_scale string",
    )
    good, bad = N.build_relations(rel, faces, tr)
    assert rows(good, "src", "dst") == [("p:Power", "q:Water"), ("q:Water", "p:w")]
    assert {r["scale_change_weight"] for r in good.collect()} == {7.0, None}
    assert rows(bad, "rule", "key") == [("interface not found", "p:nope")]


def test_parameters_and_formulas(spark):
    params = spark.createDataFrame([("a", "Number", "2"), ("b", "Number", "a * 3"), ("c", "Number", "b + a"), ("t", "Code", "x")], "name string, type string, value string")
    over = spark.createDataFrame([("hi", "A", "10")], "scenario string, parameter string, value string")
    ev = P.eval_params(P.scenario_params(params, over, ["lo", "hi"]))
    got = {(r["scenario"], r["name"]): r["value"] for r in ev.collect()}
    assert got["lo", "c"] == 8.0 and got["hi", "c"] == 40.0 and got["hi", "t"] is None
    loop = spark.createDataFrame([("a", "Number", "b"), ("b", "Number", "a")], "name string, type string, value string")
    with pytest.raises(ValueError):
        P.eval_params(P.scenario_params(loop, over.limit(0), ["lo"]))
    obs = spark.createDataFrame(
        [("2020", "p:x", "p", "a * 2", None), ("2020", "p:y", "p", "x + b", None), ("2020", "p:z", "p", "1.5", None)],
        "period string, node string, processor string, expr string, observer string",
    )
    done, pending = P.eval_observations(obs, ev, ["lo", "hi"])
    assert rows(done, "scenario", "node", "value") == [("hi", "p:x", 20.0), ("hi", "p:z", 1.5), ("lo", "p:x", 4.0), ("lo", "p:z", 1.5)]
    faces = interfaces(spark, ("p", "x", "X", "Input"), ("p", "y", "Y", "Input"), ("p", "z", "Z", "Input"))
    sol = S.solve(S.Network(), done, sibling=P.sibling_evaluator(ev, faces), pending=pending)
    vals = {(r["scenario"], r["node"]): r["value"] for r in sol.values.collect()}
    assert vals["lo", "p:y"] == 10.0 and vals["hi", "p:y"] == 50.0
    e = spark.createDataFrame([("p:x", "p:q", "a / 4")], "src string, dst string, weight string")
    assert rows(P.eval_weights(e, ev, ["lo", "hi"]), "scenario", "weight") == [("hi", 2.5), ("lo", 0.5)]


def test_sankey_and_graphs(spark):
    e = spark.createDataFrame([("s", "1", "a:x", "b:x", 2.0), ("s", "1", "b:x", "c:x", 1.0)], "scenario string, period string, origin string, destination string, quantity double")
    nodes, links = E.sankey(e)
    assert sorted(r["node"] for r in nodes.collect()) == [0, 1, 2]
    names = {r["node"]: r["label"] for r in nodes.collect()}
    assert {(names[r["source"]], names[r["target"]], r["value"]) for r in links.collect()} == {("a:x", "b:x", 2.0), ("b:x", "c:x", 1.0)}


def test_export_tables(spark):
    text = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = E.export_tables(
        {
            "parameters": text([("k", "Number", "2")], "name string, type string, value string"),
            "hierarchies": text([("h", "b", "a"), ("h", "a", None)], "hierarchy string, code string, parent_code string"),
            "interface_types": text([("Blue", "Water"), ("Water", None)], "type string, parent_type string"),
            "processors": text([("c", True), ("p", True)], "processor string, accounted boolean"),
            "part_of": text([("p", "c", 0.5)], "parent string, child string, weight double"),
            "interfaces": interfaces(spark, ("c", "W", "Blue", "Input")),
            "observations": text([("c:W", "2020", None, 3.0, None)], "node string, period string, observer string, value double, relative_to string"),
            "flows": text([("c:W", "p:W", 1.0)], "src string, dst string, weight double"),
        }
    )
    assert rows(tables["hierarchies"], "code", "depth") == [("a", 0), ("b", 1)]
    assert rows(tables["interface_types"], "type", "depth") == [("Blue", 1), ("Water", 0)]
    assert rows(tables["processors"].filter("parent is not null"), "processor", "parent", "parent_weight", "accounted", "depth") == [("c", "p", "0.5", "Yes", 1)]
    assert rows(tables["interfaces"], "processor", "interface", "period", "value") == [("c", "W", "2020", "3.0")]
    assert rows(tables["flows"], "source_processor", "target_interface", "relation_type", "weight") == [("c", "W", "Flow", "1.0")]
    assert tables["parameters"].columns == ["name", "type", "domain", "value", "group", "description"]


def test_match_names_and_selection(spark):
    procs = spark.createDataFrame([("A.x.B",), ("A.B",), ("C.B",)], "processor string")
    assert rows(Q.match_names(procs, "A..B"), "processor") == [("A.B",), ("A.x.B",)]
    assert rows(Q.match_names(procs, "..B"), "processor") == [("A.B",), ("A.x.B",), ("C.B",)]


def test_weights_per_scenario(spark):
    tree = spark.createDataFrame([("s", "P", "a", 2.0), ("t", "P", "a", 5.0)], "scenario string, parent string, child string, weight double")
    obs = spark.createDataFrame([("s", "1", "a", 1.0), ("t", "1", "a", 1.0)], "scenario string, period string, node string, value double")
    values = S.solve(S.Network(part_of=tree), obs).values
    assert {(r["scenario"], r["value"]) for r in values.filter("node = 'P'").collect()} == {("s", 2.0), ("t", 5.0)}


def test_flow_edges_reach_every_supplier_of_the_nation(spark, tmp_path):
    from tallyflow.plans import QUERIES

    spark.createDataFrame([(3, 1, "A"), (4, 1, "B"), (5, 2, "A")], "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    orders = [(3, "1995-01-01", 2.0), (3, "1995-05-01", 1.0), (4, "1996-01-01", 4.0), (5, "1996-01-01", 8.0)]
    orders = spark.createDataFrame(orders, "o_custkey long, day string, o_totalprice double").select("o_custkey", F.to_date("day").alias("o_orderdate"), "o_totalprice")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["flow_edges"](spark, str(tmp_path)).select("period", "source", "target", "value").collect()
    assert sorted(map(tuple, found)) == [
        ("1995", "C3:Money", "S10:Money", 3.0), ("1995", "C3:Money", "S11:Money", 3.0),
        ("1996", "C4:Money", "S10:Money", 4.0), ("1996", "C4:Money", "S11:Money", 4.0), ("1996", "C5:Money", "S12:Money", 8.0),
    ]


def test_flow_edges_by_their_ends_equal_flow_rows(spark):
    """Groups without a partner and without a name, equal ends, ends without a place, results in several periods."""
    from tallyflow.operators import export as E

    results = spark.createDataFrame(
        [("s", p, f"w.{n}" if n else None, "M", v) for n, p, v in [("a", "1", 1.0), ("a", "2", 2.0), ("b", "1", 4.0), ("c", "1", 8.0), (None, "1", 16.0)]],
        "scenario string, period string, processor string, interface string, value double",
    )
    ends = [(1, "x.a", "M"), (1, "b", "M"), (1, "b", "M"), (1, None, "M"), (2, "c", "M"), (3, "a", "M"), (None, "a", "M"), (1, "d", "M")]
    flows = spark.createDataFrame(ends, "g int, source_processor string, source_interface string")
    targets = [(1, "y.t", "N"), (1, "y.t", "N"), (1, "u", "N"), (2, None, "N"), (4, "t", "N"), (None, "t", "N")]
    targets = spark.createDataFrame(targets, "g int, target_processor string, target_interface string")
    places = [("w.a", "L", "S", None, "Q"), ("z.a", "K", "T", None, "Q"), ("t", "M", None, "B", None)]
    places = spark.createDataFrame(places, "processor string, level string, system string, subsystem string, sphere string")
    by_rows = E.flow_edges(results, flows.join(targets, "g").drop("g"), places)
    by_ends = E.flow_edges(results, flows, places, targets)
    assert sorted(by_ends.columns) == sorted(by_rows.columns)
    found = sorted(map(str, by_ends.select(*by_rows.columns).collect()))
    assert len(found) == 16 and found == sorted(map(str, by_rows.collect()))


def test_flow_edges_move_no_pairs(spark, tmp_path):
    """The rows that the query's shuffles write grow with customers and suppliers, not with their pairs."""
    from tallyflow.plans import QUERIES

    spark.range(40).selectExpr("id AS c_custkey", "1 AS c_nationkey", "'A' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(30).selectExpr("id AS s_suppkey", "1 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(40).selectExpr("id AS o_custkey", "date'1995-01-01' AS o_orderdate", "2.0D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")

    def written(plan) -> int:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            return written(plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan())
        rows = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return rows + sum(written(plan.children().apply(i)) for i in range(plan.children().size()))

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = QUERIES["flow_edges"](spark, str(tmp_path))
        assert len(found.collect()) == 40 * 30
        assert 0 < written(found._jdf.queryExecution().executedPlan()) <= 40 + 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
