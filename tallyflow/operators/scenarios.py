"""Scenario parameters and expressions (J-16, J-17, P-01..P-05).

Formulas are Spark SQL expression texts. They are grouped by their shape (``functions.formulas``): a shape becomes one branch of
a projection, evaluated by the JVM, whatever the number of texts that have it. What formulas over parameters give depends on the
scenario and the text only: it is computed once for each distinct text of a scenario.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.formulas import is_linear, linear_terms, shape, shape_sql
from tallyflow.operators.cube import code_grid
from tallyflow.operators.cycles import cyclic_parts
from tallyflow.runtime import Scratch, skew_join, union_all

SHAPES = 200  # shapes evaluated by one projection; further ones go to further projections


def scenario_grid(df: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """Every row once per scenario of the problem statement (a short list of names)."""
    return df.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in scenarios])))


def scenario_params(params: DataFrame, overrides: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """(scenario, name, type, expr): the default unless the scenario overrides it.

    ``params(name, type, value)``, ``overrides(scenario, parameter, value)``.
    """
    over = overrides.select("scenario", F.lower("parameter").alias("_k"), F.col("value").alias("_v"))
    return (
        scenario_grid(params, scenarios)
        .withColumn("_k", F.lower("name"))
        .join(over, ["scenario", "_k"], "left")
        .select("scenario", "name", "type", F.coalesce("_v", "value").alias("expr"))
        .filter("expr is not null")
    )


def _number(text: str) -> Column:
    return F.col(text).try_cast("double")


NO_NUMBER = r"[*/()_=<>]|[0-9A-Za-z)]\s+[-+0-9A-Za-z(]"  # found in no text that is a number: spares the cast, which is slow where it fails


def _is_formula(text: str) -> Column:
    return F.when(F.col(text).rlike(NO_NUMBER), True).otherwise(F.col(text).isNotNull() & _number(text).isNull())


def compute(shaped: DataFrame, out: str, texts: DataFrame | None = None) -> DataFrame:
    """Add ``out`` to rows with ``_f`` (a shape, see ``formulas.shape``) and ``_values``, the values of its names. The shapes are looked up
    in ``texts``, a written table with ``_f``, if there is one."""
    known = shaped if texts is None else texts
    shapes = [r["s"] for r in known.select(F.col("_f.shape").alias("s")).distinct().orderBy("s").toLocalIterator()]  # few, whatever the texts
    if not shapes:
        return shaped.withColumn(out, F.lit(None).cast("double"))

    def value(page: list[str]) -> Column:
        chosen = F.when(F.lit(False), F.lit(None).cast("double"))
        for s in page:
            sql = shape_sql(s, "_f.numbers", "_values")
            if sql is None:
                continue
            branch = F.expr(sql).try_cast("double")
            try:
                shaped.select(branch)
            except AnalysisException:  # no formula, or a function that nobody knows: it cannot be computed
                continue
            chosen = chosen.when(F.col("_f.shape") == s, branch)
        return chosen

    pages = [shapes[at : at + SHAPES] for at in range(0, len(shapes), SHAPES)]
    if len(pages) == 1:
        return shaped.withColumn(out, value(shapes))
    rest = [] if texts is None else [shaped.filter("_f is null").withColumn(out, F.lit(None).cast("double"))]
    return union_all([shaped.filter(F.col("_f.shape").isin(page)).withColumn(out, value(page)) for page in pages] + rest)


def shaped_texts(df: DataFrame, text: str) -> DataFrame:
    """(``text``, _f): the distinct formulas of a column and their shapes. Taking a text apart costs far more than
    joining it, and few texts stand in many rows; the table is written."""
    texts = df.filter(_is_formula(text)).select(text).distinct().withColumn("_f", shape(F.col(text)))
    return Scratch(df.sparkSession, "shapes").save(texts, "shapes")


def evaluate(df: DataFrame, text: str, variables: str, out: str, texts: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the number given by the formula in column ``text``.

    ``variables`` is a ``map<string,double>`` column with lower-case names. A name that is not
    in the map makes the result NULL, as does a formula that cannot be computed. Pass ``texts`` to reuse ``shaped_texts`` of the column.
    """
    texts = shaped_texts(df, text) if texts is None else texts
    rows = skew_join(df, texts, [text], "left").select(*df.columns, "_f")
    rows = rows.withColumn("_values", F.transform("_f.names", lambda n: F.element_at(F.col(variables), n)))
    value = F.when(F.col("_f").isNull(), _number(text)).otherwise(F.col(out))
    return compute(rows, out, texts).withColumn(out, value).drop("_f", "_values")


def text_values(texts: DataFrame, params: DataFrame) -> DataFrame:
    """(scenario, text, value) of distinct formulas ``texts(scenario, text)`` over ``params(scenario, name, value)``.

    Linear formulas are coefficient tables: one row for each term, joined with the parameters and summed up. Of the others each is joined with the
    parameters that it names. No scenario's parameters ever stand in one row. A name without a value gives NULL.
    """
    known = params.filter("value is not null").select("scenario", F.lower("name").alias("_n"), F.col("value").alias("_x"))
    linear = texts.filter(is_linear(F.col("text")))
    terms = linear.select("scenario", "text", F.explode(linear_terms(F.col("text"))).alias("_t")).select("scenario", "text", F.col("_t.name").alias("_n"), "_t.coefficient")
    joined = skew_join(terms, known, ["scenario", "_n"], "left")
    x = F.when(F.col("_n").isNull(), F.lit(1.0)).otherwise(F.col("_x"))
    sums = joined.groupBy("scenario", "text").agg(F.sum(F.col("coefficient") * x).alias("_s"), F.every(x.isNotNull()).alias("_all"))
    linear = sums.select("scenario", "text", F.when(F.col("_all"), F.col("_s")).alias("value"))

    rest = texts.filter(~is_linear(F.col("text"))).withColumn("_f", shape(F.col("text")))
    named = rest.select("scenario", "text", F.posexplode("_f.names").alias("_i", "_n"))
    named = skew_join(named, known, ["scenario", "_n"], "left").groupBy("scenario", "text").agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_v"))
    rest = rest.join(named, ["scenario", "text"], "left").withColumn("_values", F.coalesce(F.transform("_v", lambda p: p["_x"]), F.array().cast("array<double>")))
    return linear.unionByName(compute(rest, "value").select("scenario", "text", "value"))


def evaluate_texts(df: DataFrame, text: str, params: DataFrame, out: str) -> DataFrame:
    """Add ``out`` to rows with ``scenario``: a number, or the value of a formula over the scenario's parameters."""
    texts = df.filter(_is_formula(text)).select("scenario", F.col(text).alias("text")).distinct()
    values = Scratch(df.sparkSession, "formulas").save(text_values(texts, params), "values").withColumnRenamed("value", "_formula")
    rows = skew_join(df, values.withColumnRenamed("text", text), ["scenario", text], "left")
    return rows.withColumn(out, F.coalesce("_formula", F.when(~_is_formula(text), _number(text)))).drop("_formula")


def eval_params(grid: DataFrame) -> DataFrame:
    """(scenario, name, value, text): parameters that depend on parameters, level by level.

    Raises ``ValueError`` that names the members of cycles, and the parameters that use an unknown name or depend on one of both.
    """
    solved, issues = solve_params(grid)
    found = [(r["rule"], r["key"]) for r in issues.select("rule", "key").distinct().orderBy("rule", "key").collect()]
    if found:
        raise ValueError("parameters: " + "; ".join(f"{rule}: {key}" for rule, key in found))
    return solved


def solve_params(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parameters with their values, issue rows): a parameter in a cycle, one that uses a name nobody declares or that cannot be computed,
    and one that waits for such a one are told apart. Issues (level, rule, key, message) are one row a parameter and scenario."""
    scratch = Scratch(grid.sparkSession, "params")
    is_text = F.lower("type").isin("code", "string")
    texts = grid.filter(is_text).select("scenario", "name", F.lit(None).cast("double").alias("value"), F.col("expr").alias("text"))
    numeric = grid.filter(~is_text).withColumn("_k", F.lower("name"))
    needs = F.array_distinct(F.when(_is_formula("expr"), shape(F.col("expr"))["names"]).otherwise(F.array().cast("array<string>")))
    numeric = scratch.save(numeric.withColumn("_needs", needs), "todo")
    todo, solved = numeric, []
    while True:
        values = union_all(solved) if solved else numeric.select("scenario", "name", F.lit(None).cast("double").alias("value")).limit(0)
        ready = todo.filter(F.size("_needs") == 0)
        if solved:  # only parameters all of whose names are known are computed
            have = todo.select("scenario", "name", "expr", F.explode("_needs").alias("_k"), F.size("_needs").alias("_n"))
            have = have.join(values.select("scenario", F.lower("name").alias("_k")), ["scenario", "_k"])
            counts = have.groupBy("scenario", "name", "expr").agg(F.count(F.lit(1)).alias("_have"), F.max("_n").alias("_n")).filter("_have = _n")
            ready = counts.select("scenario", "name", "expr")
        rows = evaluate_texts(ready.select("scenario", "name", "expr"), "expr", values, "value")
        found, n = scratch.save_counted(rows.filter("value is not null").select("scenario", "name", "value"), "solved")
        if not n:
            break
        solved.append(found)
        todo = scratch.save(todo.join(found.select("scenario", "name"), ["scenario", "name"], "left_anti"), "todo")
    numbers = [s.withColumn("text", F.lit(None).cast("string")) for s in solved]
    return union_all([texts, *numbers]), _param_issues(todo, numeric, scratch)


def _param_issues(todo: DataFrame, declared: DataFrame, scratch: Scratch) -> DataFrame:
    key = lambda c: F.concat_ws(":", "scenario", c)
    uses = todo.select("scenario", "_k", F.explode("_needs").alias("_u"))
    waits = uses.join(todo.select("scenario", F.col("_k").alias("_u")), ["scenario", "_u"])
    parts = cyclic_parts(waits.select(key("_u").alias("src"), key("_k").alias("dst")))
    circle = scratch.save(parts.select(F.col("node").alias("_id"), F.lit(True).alias("_circle"), F.col("part").alias("_part")), "circles")
    unknown = uses.join(declared.select("scenario", F.col("_k").alias("_u")).distinct(), ["scenario", "_u"], "left_anti")
    unknown = unknown.groupBy("scenario", "_k").agg(F.min("_u").alias("_unknown"))
    rows = todo.withColumn("_id", key("_k")).join(circle, "_id", "left").join(unknown, ["scenario", "_k"], "left")
    waiting = waits.select("scenario", "_k").distinct().withColumn("_waits", F.lit(True))
    rows = rows.join(waiting, ["scenario", "_k"], "left")
    rule = (
        F.when(F.col("_circle"), F.lit("parameter in a cycle"))
        .when(F.col("_unknown").isNotNull(), F.lit("parameter uses an unknown name"))
        .when(F.col("_waits"), F.lit("parameter depends on one without value"))
        .otherwise(F.lit("parameter cannot be computed"))
    )
    message = F.coalesce(F.when(F.col("_circle"), F.col("_part")), F.col("_unknown"), F.col("expr"))
    return rows.select(F.lit("error").alias("level"), rule.alias("rule"), key("name").alias("key"), message.alias("message"))


def parameter_maps(params: DataFrame) -> DataFrame:
    """(scenario, vars): numeric parameters of each scenario as one map (definition-sized)."""
    entries = params.filter("value is not null").select(
        "scenario", F.struct(F.lower("name"), "value").alias("_e")
    )
    return entries.groupBy("scenario").agg(F.map_from_entries(F.collect_list("_e")).alias("vars"))


def generic_periods(obs: DataFrame, generic: Sequence[str] = ("year", "month")) -> DataFrame:
    """Observations of a generic period are copied to every specific period of the table."""
    low = F.lower(F.trim("period"))
    specific = obs.filter(~low.isin(*generic))
    periods = specific.select("period").distinct()
    rows = obs.filter(low.isin(*generic)).drop("period")
    copies = code_grid([rows, periods])
    return specific.unionByName(copies.select(*specific.columns))


def eval_observations(
    obs: DataFrame, params: DataFrame, scenarios: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Observation values in every scenario: (evaluated, pending).

    ``obs(period, node, processor, expr, observer)``. Numbers and formulas over parameters are
    evaluated; what is left refers to sibling interfaces and is ``pending``.
    """
    done = evaluate_texts(scenario_grid(obs, scenarios), "expr", params, "value")
    done = Scratch(obs.sparkSession, "observed").save(done, "evaluated")  # both results read it, several times
    return done.filter("value is not null"), done.filter("value is null and expr is not null").drop("value")


def sibling_evaluator(params: DataFrame, interfaces: DataFrame) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Evaluator of pending observations for ``solve``: formulas over the interfaces of the same
    processor. ``interfaces(node, processor, interface)``; parameters keep priority."""
    sides = interfaces.select("node", F.col("processor").alias("_proc"), F.lower("interface").alias("_i"))

    def run(pending: DataFrame, values: DataFrame) -> DataFrame:
        place = ["scenario", "period", "_proc"]
        texts = shaped_texts(pending, "expr")
        used = skew_join(pending.select("scenario", "period", F.col("processor").alias("_proc"), "expr"), texts, ["expr"])
        used = used.select(*place, F.explode("_f.names").alias("_i")).distinct()
        known = (
            values.select("scenario", "period", "node", "value")
            .join(sides, "node")
            .join(used, [*place, "_i"], "left_semi")
            .groupBy("scenario", "period", F.col("_proc").alias("processor"))
            # at most one entry per name that occurs in the processor's formulas, however large it is
            .agg(F.map_from_entries(F.collect_list(F.struct("_i", "value"))).alias("_near"))
        )
        named = params.withColumn("_i", F.lower("name")).join(used.select("_i").distinct(), "_i", "left_semi").drop("_i")
        empty = F.create_map().cast("map<string,double>")
        rows = pending.join(known, ["scenario", "period", "processor"], "left").join(parameter_maps(named), "scenario", "left")
        near, far = F.coalesce("_near", empty), F.coalesce("vars", empty)
        near = F.map_filter(near, lambda k, v: ~F.map_contains_key(far, k))
        rows = rows.withColumn("_all", F.map_concat(near, far)).drop("_near", "vars")
        return evaluate(rows, "expr", "_all", "value", texts).drop("_all")

    return run


def eval_weights(
    edges: DataFrame, params: DataFrame, scenarios: Sequence[str], weight: str = "weight", shared: bool = False
) -> DataFrame:
    """Edge weights given as text. Edges get a ``scenario`` column only when a formula needs it; with ``shared``
    the edges whose weight is a number stay common to all scenarios (scenario NULL)."""
    text = F.col(weight).cast("string")
    if edges.filter(text.isNotNull() & text.try_cast("double").isNull()).isEmpty():
        return edges.withColumn(weight, text.try_cast("double"))
    rows = edges.withColumn(weight, text)
    plain = rows.filter(~_is_formula(weight))
    rows = scenario_grid(rows.filter(_is_formula(weight)) if shared else rows, scenarios)
    done = evaluate_texts(rows, weight, params, "_w").withColumn(weight, F.col("_w")).drop("_w")
    if not shared:
        return done
    return done.unionByName(plain.withColumn(weight, _number(weight)).withColumn("scenario", F.lit(None).cast("string")))
