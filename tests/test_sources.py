import json

import pytest
from pyspark.sql import functions as F

from tallyflow.functions import scalar as X
from tallyflow.operators import cube as C
from tallyflow.operators import export as E
from tallyflow.operators import issues as V
from tallyflow.operators import mapping as M
from tallyflow.runtime import small_table
from tallyflow.sources import readers as R
from tallyflow.sources import sinks as K


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


CATS = [("c11", 4.0), ("c12", 3.0), ("c13", 1.5)]
MAP = "origin_dim string, origin_code string, dest_dim string, dest_code string, weight double"


def test_mapping_shapes(spark):
    one = small_table(spark, CATS, "cat_o_1 string, value double")
    m1 = [("cat_o_1", "c11", "d1", "c21", 1.0), ("cat_o_1", "c12", "d1", "c23", 1.0), ("cat_o_1", "c13", "d1", "c23", 1.0)]
    out = M.apply_mappings(one, small_table(spark, m1, MAP), ["value"])
    assert (out.count(), out.columns) == (3, ["cat_o_1", "d1", "value"])
    m2 = [("cat_o_1", "c11", "d1", "c21", 0.6), ("cat_o_1", "C11", "d1", "c22", 0.4), *m1[1:]]
    out = M.apply_mappings(one, small_table(spark, m2, MAP), ["value"])
    assert out.count() == 4
    assert out.agg(F.sum("value")).first()[0] == pytest.approx(8.5)  # weights sum to one: nothing is lost
    two = small_table(spark, [("c11", "c31", 4.0), ("c12", "c32", 3.0), ("c13", "c31", 1.5)], "cat_o_1 string, cat_o_2 string, value double")
    m3 = m2 + [("cat_o_2", "c31", "d2", "c41", 0.3), ("cat_o_2", "c31", "d2", "c42", 0.7), ("cat_o_2", "c32", "d2", "c43", 1.0), ("cat_o_2", "c33", "d2", "c43", 1.0)]
    out = M.apply_mappings(two, small_table(spark, m3, MAP), ["value"])
    assert (out.count(), out.columns) == (7, ["cat_o_1", "cat_o_2", "d1", "d2", "value"])


def test_cube_query_case(spark):
    """Two filtered dimensions and one year, averaged."""
    data = small_table(
        spark,
        [("A", "THS_HW", "T", "EMP_DC", "ES", "2012", 2.0), ("A", "THS_HW", "T", "EMP_DC", "ES", "2012", 4.0), ("A", "THS_HW", "T", "EMP_DC", "FR", "2012", 9.0),
         ("A", "THS_HW", "T", "SAL_DC", "PT", "2011", 9.0), ("A", "PC", "T", "SAL_DC", "PT", "2012", 9.0)],
        "FREQ string, UNIT string, NACE_R2 string, NA_ITEM string, GEO string, TIME_PERIOD string, OBS_VALUE double",
    )
    warnings = []
    out = C.query_cube(
        data,
        {"FREQ": ["A"], "GEO": ["ES", "pt", "IT"], "NA_ITEM": ["EMP_DC", "SAL_DC", "SELF_DC"], "UNIT": ["THS_HW"], "StartPeriod": ["2012"], "EndPeriod": ["2012"]},
        ["NACE_R2", "GEO", "NA_ITEM", "absent"], ["OBS_VALUE"], ["average"], period="TIME_PERIOD", warnings=warnings,
    )
    assert [tuple(r) for r in out.collect()] == [("T", "ES", "EMP_DC", 3.0)]
    assert out.columns[-1] == "OBS_VALUE_average" and len(warnings) == 1


def test_aggregates_with_missing_values(spark):
    df = small_table(spark, [("a", 1.0), ("a", None), ("b", None), ("c", 3.0)], "k string, v double")
    out = {r["k"]: r for r in C.query_cube(df, {}, ["k"], ["v"], ["sum", "avg", "count", "sumna", "countav", "avgna", "pctna"]).collect()}
    assert (out["a"]["v_sum"], out["a"]["v_avg"], out["a"]["v_sumna"], out["a"]["v_countav"], out["a"]["v_pctna"]) == (None, None, 1.0, 1, 50.0)
    assert (out["b"]["v_sumna"], out["b"]["v_avgna"], out["c"]["v_sum"]) == (0.0, None, 3.0)


def test_densify_and_fill_down(spark):
    df = small_table(spark, [("a", "x", 1.0), ("b", "y", 2.0), ("z", "x", 9.0)], "d string, e string, v double")
    got = rows(C.densify(df, ["d", "e"], {"d": ["a", "b"]}), "d", "e", "v")
    assert got == [("a", "x", 1.0), ("a", "y", None), ("b", "x", None), ("b", "y", 2.0)]
    sheet = small_table(spark, [(i, v) for i, v in enumerate([None, "p", "", None, "q", None, " ", None, None])], "n int, c string")
    want = [(0, None)] + [(i, "p") for i in (1, 2, 3)] + [(i, "q") for i in range(4, 9)]
    assert rows(C.fill_down(sheet, ["c"], "n", block=2), "n", "c") == want
    assert rows(C.fill_down(sheet, ["c"], "n"), "n", "c") == want


def test_wide_tsv(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("freq,geo\\time\t2019 \t2020 \nA,ES\t1.5 b\t: \nA,PT\t: c\t-2e3 ep\n")
    df = R.read_wide_tsv(spark, str(tmp_path / "w.tsv"))
    assert df.columns == ["freq", "geo", "2019", "2020"]
    assert rows(df, "geo", "2019", "2020") == [("ES", 1.5, None), ("PT", None, -2000.0)]
    assert R.unpivot_periods(df, ["freq", "geo"]).count() == 4


def test_custom_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Geo,Surface,SurfaceUnit\nC11,10000,km2\nC12,6000,km2\nC21,4000,km2\nC22,300,km2\n")
    df = R.read_cube(spark, str(tmp_path / "c.csv"), {"geo": "dimension", "SURFACE": "measure", "SurfaceUnit": "attribute"})
    assert df.columns == ["geo", "SURFACE", "SurfaceUnit"] and df.agg(F.sum("SURFACE")).first()[0] == 20300.0
    _, issues = R.bind_schema(df, {"geo": "dimension", "missing": "measure"})
    assert {r["rule"] for r in issues.collect()} == {"declared column absent", "column not declared"}


def test_normalized_encoding(spark, tmp_path):
    (tmp_path / "n.csv").write_bytes("Area Code,Area,Year,Value\n1,Côte d’Ivoire,2020,5\n".encode("cp1252"))
    df = R.read_normalized(spark, str(tmp_path / "n.csv"))
    assert df.columns == ["Area_id", "Year_id", "Value"]
    raw = spark.read.option("header", True).option("encoding", "iso-8859-1").csv(str(tmp_path / "n.csv"))
    old, new = R._cp1252_chars()
    assert raw.select(F.translate("Area", old, new)).first()[0] == "Côte d’Ivoire"


def test_features(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "es", "properties": {"name": "Spain"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": {"id": "pt", "name": "Portugal"}, "geometry": {"type": "Point", "coordinates": [3, 4]}},
    ]}
    (tmp_path / "f.json").write_text(json.dumps(doc, indent=1))
    f = R.read_features(spark, str(tmp_path / "f.json"))
    assert rows(f.select("code", F.col("properties")["name"].alias("name")), "code", "name") == [("es", "Spain"), ("pt", "Portugal")]


def test_sinks(spark, tmp_path):
    df = small_table(spark, [(1, None), (2, "x")], "a int, b string")
    K.to_csv(df, str(tmp_path / "csv"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "csv")), "a", "b") == [("1", None), ("2", "x")]
    K.to_json(df, str(tmp_path / "j"), "split")
    assert sorted(json.loads(r[0]) for r in spark.read.text(str(tmp_path / "j/data")).collect()) == [["1", None], ["2", "x"]]
    R.write_by_name(df.withColumn("dataset", F.lit("d")), "dataset", str(tmp_path / "p"))
    assert (tmp_path / "p" / "dataset=d").is_dir()
    E.write_tables({"t": df.withColumn("depth", F.col("a"))}, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m/t")).count() == 2
    assert [r["a"] for r in E.sorted_output(df.orderBy(F.desc("a"))).collect()] == [1, 2]


def test_schema_checks(spark):
    df = small_table(spark, [(1, "x")], "a int, b string")
    assert rows(V.unknown_columns(df, ["B", "geo"], ["v"]), "rule", "key") == [("unknown dimension", "geo"), ("unknown measure", "v")]
    assert rows(C.column_usage({"t": df, "u": df.select("a")}), "column", "t", "u") == [("a", 1, 1), ("b", 1, 0)]
    assert V.source_priority(["Flow", "Flow", "Other"])[0] == "unknown source Other"


def test_text_functions(spark):
    df = small_table(spark, [("2", "3"), ("a", "3"), (None, "b"), ("1.5", None)], "x string, y string")
    got = [r[0] for r in df.select(X.multiply_text(F.col("x"), F.col("y"))).collect()]
    assert got == ["6.0", "(a)*(3)", "b", "1.5"]
    p = small_table(spark, [("2020",), ("2020-05",), ("5/2020",), ("Year",), ("2020-01-01/2020-06-30",), ("soon",)], "p string")
    got = [(r[0], str(r[1])) for r in p.select(X.period_kind(F.col("p")), X.period_start(F.col("p"))).collect()]
    assert got == [("year", "2020-01-01"), ("month", "2020-05-01"), ("month", "2020-05-01"), ("generic year", "None"), ("span", "2020-01-01"), (None, "None")]
    s = small_table(spark, [("a=1, b = 'x y'",), (None,), ("",)], "s string")
    assert [r[0] for r in s.select(X.key_value_map(F.col("s"))).collect()] == [{"a": "1", "b": "x y"}, {}, {}]
    n = small_table(spark, [("9 lives-x",), ("good name",)], "s string")
    assert [r[0] for r in n.select(X.identifier_name(F.col("s"))).collect()] == ["id_9_lives_x", "good_name"]


def test_codes_without_letters_on_a_timestamp(spark):
    from tallyflow.operators.filters import filter_dims

    stamps = spark.sql("SELECT timestamp(x) AS ts FROM VALUES ('2024-01-01 00:00:00'), ('2024-01-02 03:04:05') AS t(x)")
    assert filter_dims(stamps, {"ts": ["2024-01-01 00:00:00", "7"]}).count() == 1
    assert filter_dims(stamps, {"TS": ["2024-01-03 00:00:00"]}).count() == 0


def test_the_first_declaration_counts(spark, tmp_path):
    """Position follows the files' names and the rows in them: the first row is neither the smallest nor the first to be read."""
    from tallyflow.operators import hierarchy, mapping, network
    from tallyflow.runtime import declared_first
    from tallyflow.sources.readers import with_position

    (tmp_path / "b.csv").write_text("code,dest,weight\nX,late,9\n")
    (tmp_path / "a.csv").write_text("code,dest,weight\n" + "".join(f"c{k},d{k},1\n" for k in range(500)) + "x,zebra,3\nX,apple,1\nY,only,\n")
    rows = with_position(spark.read.option("header", True).csv(str(tmp_path)), "csv")
    got = declared_first(rows.withColumn("k", F.lower("code")), ["k"]).filter("k in ('x', 'y')").orderBy("k").collect()
    assert [(r["code"], r["dest"], r["weight"], r["_n"]) for r in got] == [("x", "zebra", "3", 3), ("Y", "only", None, 1)]
    spark.createDataFrame([("m", 3), ("a", 1), ("z", 2)], "v string, n int").coalesce(1).write.parquet(str(tmp_path / "p"))
    parquet = with_position(spark.read.parquet(str(tmp_path / "p")))
    assert [r["v"] for r in parquet.orderBy("position").collect()] == ["m", "a", "z"]

    def placed(values, schema):
        return spark.createDataFrame([(*v, k) for k, v in enumerate(values)], schema + ", position long").repartition(3)

    pairs = placed([("g", "X", "h", "Q", 2.0), ("g", "x", "h", "q", 1.0)], "origin_dim string, origin_code string, dest_dim string, dest_code string, weight double")
    table, repeated = mapping.build_mapping(pairs)
    assert [tuple(r) for r in table.collect()] == [("g", "X", "h", "Q", 2.0)] and repeated.count() == 1
    side = placed([("A", "z"), ("a", "b")], "origin_code string, dest_code string")
    assert mapping.map_many_to_one(spark.createDataFrame([("a",)], "o string"), side, "o", "d").first()["d"] == "z"
    types = placed([(None, "Zinc", None, "kg"), (None, "zinc", None, "g")], "hierarchy string, type string, parent_type string, unit string")
    assert network.build_interface_types(types)[0].first()["unit"] == "kg"
    tree = placed([("h", "b", "zeta"), ("h", "zeta", None), ("h", "ZETA", None)], "hierarchy string, code string, parent_code string")
    assert hierarchy.build_hierarchy(tree)[0].first()["parent"] == "zeta"
    procs = placed([("P", None, "Yes", None, None), ("C", "p", "No", "2", None), ("C", "P", "Yes", "1", None)], "processor string, parent string, accounted string, parent_weight string, behave_as string")
    processors, part_of, _ = network.build_processors(procs)
    assert {r["processor"]: r["accounted"] for r in processors.collect()} == {"P": True, "C": False}
    assert [(r["parent"], r["child"], r["weight"]) for r in part_of.collect()] == [("P", "C", "2")]


@pytest.mark.parametrize("literals", [1_000, 2])
def test_codes_by_dictionary(spark, tmp_path, monkeypatch, literals):
    from tallyflow.operators import dictionary as D
    from tallyflow.operators.filters import filter_dims, filter_mapped

    monkeypatch.setattr(D, "MAX_LITERALS", literals)
    monkeypatch.setattr(D, "MAX_RANGES", 2)
    cells = [("ES", 1), ("es", 2), ("Pt", 3), ("FR", 4), ("it", 5), (None, 6), ("ES", 7)]
    path = str(tmp_path / "cube")
    small_table(spark, cells, "geo string, n int").write.parquet(path)
    cube = spark.read.parquet(path)
    known = D.CodeDictionary.write(cube, ["geo"], str(tmp_path / "codes"))
    for codes in (["Es"], ["eS", "PT", "fr", "none"], ["none"]):
        out = filter_dims(cube, {"GEO": codes}, dictionary=known)
        assert rows(out, "geo", "n") == rows(filter_dims(cube, {"GEO": codes}), "geo", "n")
        assert out.columns == cube.columns
    assert rows(filter_dims(cube, {"geo": []}, dictionary=known), "n") == [(i,) for i in range(1, 8)]
    plan = filter_dims(cube, {"geo": ["es", "pt"]}, dictionary=known)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert ("In(geo, [ES,Pt,es])" if literals > 2 else "GreaterThanOrEqual(geo,ES)") in pushed
    mapping = small_table(spark, [("geo", "es", "bloc", "south", 1.0), ("geo", "PT", "bloc", "South", 1.0), ("geo", "fr", "bloc", "west", 1.0)], MAP)
    for wanted in (["SOUTH"], ["west", "south"], ["north"]):
        plain = filter_mapped(cube, mapping, "geo", "bloc", wanted)
        assert rows(filter_mapped(cube, mapping, "geo", "bloc", wanted, known), "geo", "n") == rows(plain, "geo", "n")
    days = spark.sql("SELECT DATE'2024-01-01' AS day, 1 AS n UNION ALL SELECT DATE'2024-01-02', 2")
    assert rows(filter_dims(days, {"day": ["2024-01-02", "x"]}, dictionary=D.CodeDictionary.of(days, ["day"])), "n") == [(2,)]
    none = cube.limit(0)
    assert filter_dims(none, {"geo": ["es"]}, dictionary=D.CodeDictionary.of(none, ["geo"])).count() == 0
