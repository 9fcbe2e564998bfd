"""Building the flow network from tables (B-*, F-04, F-05, H-06, H-07, H-09..H-11, J-07, J-08,
J-13, J-15, J-18, J-19, A-21).

Nodes are named ``processor:interface``; a node made only by type aggregation is
``processor:type:orientation``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.scalar import multiply_text, wildcard_regex
from tallyflow.operators.issues import issue
from tallyflow.runtime import POSITION, ROWS_PER_TASK, Scratch, declared_first, first_value, hot_keys, skew_join, union_all

NODE = lambda p="processor", i="interface": F.concat_ws(":", F.col(p), F.col(i))


# -- template rows ----------------------------------------------------------------------
PLACEHOLDER = re.compile(r"\{([^{}]+)\}")


def template_rows(
    dataset: DataFrame, name: str, template: Mapping[str, str | None], dims: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """One output row per dataset row from a template row.

    Fields hold ``{name.column}`` or ``{function(name.column)}`` placeholders (SQL functions).
    Rows with a blank used dimension are skipped; a measure needs all dimensions; when only
    some dimensions are used, their distinct tuples are expanded.
    """
    refs = [m for t in template.values() if t for m in PLACEHOLDER.findall(t)]
    column = re.compile(rf"\b{re.escape(name)}\.(\w+)", re.IGNORECASE)
    others = {d for r in refs for d in re.findall(r"\b(\w+)\.\w+", r) if d.lower() != name.lower()}
    if others:
        raise ValueError(f"only one dataset can be expanded, found also {sorted(others)}")
    used = {c.lower() for r in refs for c in column.findall(r)}
    used_dims = [d for d in dims if d.lower() in used]
    used_measures = [m for m in measures if m.lower() in used]
    unknown = used - {c.lower() for c in (*dims, *measures)}
    if unknown:
        raise ValueError(f"not in the dataset: {sorted(unknown)}")
    if used_measures and len(used_dims) < len(dims):
        raise ValueError("a measure can be used only together with all the dimensions")
    data = dataset.select(*dims, *measures)
    if len(used_dims) < len(dims):
        data = data.select(*used_dims).distinct()
    for d in used_dims:
        data = data.filter(F.trim(F.col(d).cast("string")) != "")
    out = []
    for fld, text in template.items():
        if not text or not PLACEHOLDER.search(text):
            out.append(F.lit(text).cast("string").alias(fld))
            continue
        parts: list[Column] = []
        at = 0
        for m in PLACEHOLDER.finditer(text):
            if m.start() > at:
                parts.append(F.lit(text[at : m.start()]))
            parts.append(F.coalesce(F.expr(column.sub(r"\1", m.group(1))).cast("string"), F.lit("")))
            at = m.end()
        if at < len(text):
            parts.append(F.lit(text[at:]))
        out.append(F.concat(*parts).alias(fld))
    return data.select(*out)


def expand_columns(dataset: DataFrame, row: Mapping[str, str], name_from: Sequence[str]) -> DataFrame:
    """Fields written ``#column`` take the dataset column; the processor is named by its attributes."""
    cols = [
        (F.col(v[1:]).cast("string") if v.startswith("#") else F.lit(v)).alias(k) for k, v in row.items()
    ]
    return dataset.select(F.concat_ws("_", *[F.col(c).cast("string") for c in name_from]).alias("processor"), *cols)


# -- types and processors ---------------------------------------------------------------
def build_interface_types(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Interface types: default hierarchy ``_default``, one row per (hierarchy, type), the parent
    in the same hierarchy."""
    base = rows.withColumn("hierarchy", F.coalesce("hierarchy", F.lit("_default")))
    rest = [c for c in base.columns if c not in ("hierarchy", "type")]
    types = declared_first(base.withColumn("_k", F.lower("type")).select("hierarchy", "_k", "type", *rest), ["hierarchy", "_k"])
    repeated = types.filter("_n > 1").select(*issue("warning", "repeated interface type", F.col("type"), F.col("hierarchy")))
    known = types.select("hierarchy", F.col("_k").alias("_p"), F.col("type").alias("_parent"))
    orphans = (
        types.filter("parent_type is not null")
        .withColumn("_p", F.lower("parent_type"))
        .join(known, ["hierarchy", "_p"], "left_anti")
        .select(*issue("error", "parent type not found", F.col("parent_type"), F.col("hierarchy")))
    )
    valid = types.withColumn("_p", F.lower("parent_type")).join(
        known, ["hierarchy", "_p"], "left"
    )
    # the parent is named as it is declared, whatever its case in the row of the child
    valid = valid.filter("parent_type is null or _parent is not null").withColumn("parent_type", F.col("_parent"))
    valid = valid.select("hierarchy", "type", *rest)
    return valid, repeated.unionByName(orphans)


def build_processors(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(processors, part_of, issues) from declaration rows.

    ``rows(processor, parent, accounted, parent_weight, behave_as, ...)``. A simple name is
    created once, and hung from its parent when one is given; a repeated declaration without
    parent, a dotted name without parent, an unknown parent and a repeated part-of are issues.
    Accounted Yes / No means instance / archetype.
    """
    r = rows.withColumn("_k", F.lower("processor")).withColumn("_pk", F.lower("parent"))
    simple = ~F.col("processor").contains(".")
    rest = [c for c in rows.columns if c not in ("processor", "parent", "parent_weight", "behave_as")]
    created = r.filter(simple)
    first = declared_first(created.select("_k", "processor", *rest), ["_k"]).drop("_n")
    bare = created.groupBy("_k").agg(F.count_if(F.col("parent").isNull()).alias("_bare")).filter("_bare > 1")
    processors = first.withColumn(
        "accounted", ~F.coalesce(F.lower("accounted").isin("no", "archetype"), F.lit(False))
    )
    names = processors.select(F.col("_k").alias("_pk"), F.col("processor").alias("_parent"))
    own = processors.select("_k", F.col("processor").alias("child"))
    with_parent = r.filter("parent is not null")
    known_parent = with_parent.join(names, "_pk")
    bad_parent = with_parent.join(names, "_pk", "left_anti")
    place = [POSITION] if POSITION in rows.columns else []
    hung = known_parent.filter(simple).select(
        "_pk", "_k", F.col("_parent").alias("parent"), F.col("parent_weight").alias("weight"), "behave_as", *place
    )
    links = declared_first(hung, ["_pk", "_k"]).join(own, "_k")
    issues = union_all(
        [
            first.join(bare, "_k").select(*issue("warning", "repeated declaration", F.col("processor"), F.lit("skipped"))),
            r.filter(~simple & F.col("parent").isNull()).select(
                *issue("warning", "name must be simple", F.col("processor"), F.lit("skipped"))
            ),
            bad_parent.select(*issue("error", "parent processor not found", F.col("parent"), F.col("processor"))),
            links.filter("_n > 1").select(
                *issue("warning", "already part of", F.concat_ws(".", "parent", "child"), F.lit("skipped"))
            ),
        ]
    )
    return processors.drop("_k"), links.select("parent", "child", "weight", "behave_as"), issues


# -- interfaces -------------------------------------------------------------------------
# Opposite subsystem seen from an external or external-environment processor.
INVERTED_SUBSYSTEM = {
    "local": "external",
    "environment": "externalenvironment",
    "external": "local",
    "externalenvironment": "environment",
}


def opposite_subsystem(own: Column, declared: Column) -> Column:
    """Correct the opposite subsystem of a type for the subsystem of the processor."""
    low = F.lower(declared)
    inverted = F.lit(None).cast("string")
    for k, v in INVERTED_SUBSYSTEM.items():
        inverted = F.when(low == k, F.lit(v)).otherwise(inverted)
    return F.when(F.lower(own).isin("local", "environment"), low).otherwise(inverted)


def build_interfaces(
    rows: DataFrame,
    processors: DataFrame,
    types: DataFrame,
    units: DataFrame,
    transforms: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(interfaces, observations, issues) from interface rows.

    ``rows(processor, interface, type, orientation, sphere, roegen_type, opposite_subsystem, value,
    unit, relative_to, period, observer)``. The interface takes the name of its type when
    unnamed; attributes default to the type; values are converted to the unit of the type; a
    value missing beside ``relative_to`` is the weight of the best type transform, else 0.
    """
    r = rows.withColumn("interface", F.coalesce("interface", "type"))
    p = processors.select("processor", F.col("subsystem").alias("_sub"))
    t = types.select(
        F.lower("type").alias("_t"), F.col("type").alias("_type"), F.col("unit").alias("_unit"),
        F.col("sphere").alias("_sphere"), F.col("roegen_type").alias("_roegen"),
        F.col("opposite_subsystem").alias("_opp"),
    )
    # a later row of an interface may leave type and orientation out
    declared = r.groupBy("processor", "interface").agg(
        first_value(r, "type").alias("_t0"),
        F.count_distinct(F.lower("type")).alias("_nt"),
        first_value(r, "orientation").alias("orientation"),
        *[first_value(r, c).alias(c) for c in ("sphere", "roegen_type", "opposite_subsystem")],
    )
    declared = declared.withColumn("_t", F.lower(F.coalesce("_t0", "interface")))
    full = declared.join(p.withColumn("_p", F.lit(True)), "processor", "left").join(t, "_t", "left")
    key = NODE()
    issues = [
        full.filter("_p is null").select(*issue("error", "processor not declared", F.col("processor"), key)),
        full.filter("_type is null").select(*issue("error", "interface type not declared", F.col("_t"), key)),
        full.filter("orientation is null").select(*issue("error", "orientation missing", key, F.lit("needed for new interfaces"))),
        full.filter("_nt > 1").select(*issue("warning", "interface with several types", key, F.col("_nt").cast("string"))),
    ]
    ok = full.filter("_p and _type is not null and orientation is not null")
    interfaces = ok.select(
        key.alias("node"), "processor", "interface", F.col("_type").alias("type"), "orientation",
        F.coalesce("sphere", "_sphere").alias("sphere"),
        F.coalesce("roegen_type", "_roegen").alias("roegen_type"),
        F.coalesce("opposite_subsystem", opposite_subsystem(F.col("_sub"), F.col("_opp"))).alias("opposite_subsystem"),
        F.col("_unit").alias("unit"),
    )
    info = interfaces.select("processor", "interface", F.col("type").alias("_ty"), F.col("unit").alias("_to"))
    obs = skew_join(
        r.filter("value is not null or relative_to is not null").select(
            "processor", "interface", F.col("value").cast("string").alias("_v"), F.coalesce("unit", F.lit("")).alias("_from"),
            "relative_to", "period", "observer",
        ),
        info,
        ["processor", "interface"],
    )
    ratio = units.select(F.col("from").alias("_from"), F.col("to").alias("_to"), F.col("ratio").alias("_ratio"))
    obs = obs.join(ratio, ["_from", "_to"], "left")
    same = F.col("_from").isin("") | (F.col("_from") == F.col("_to"))
    lost = F.col("_v").isNotNull() & ~same & F.col("_ratio").isNull()
    issues.append(
        obs.filter(lost).select(*issue("error", "units not convertible", NODE(), F.concat_ws(" to ", "_from", "_to")))
    )
    obs = obs.filter(~lost)
    converted = F.when(same, F.col("_v")).otherwise(multiply_text(F.col("_v"), F.col("_ratio").cast("string")))
    obs = obs.withColumn("value", converted)
    if transforms is not None:
        source_type = info.select("processor", F.col("interface").alias("relative_to"), F.col("_ty").alias("source_type"))
        asked = obs.filter("_v is null").join(source_type, ["processor", "relative_to"]).select(
            "source_type", F.col("_ty").alias("target_type"), F.col("processor").alias("source_context"),
            F.col("processor").alias("target_context"),
        ).distinct()
        best = best_transform(asked, transforms).select(
            F.col("source_type").alias("_st"), F.col("target_type").alias("_ty"),
            F.col("source_context").alias("processor"), F.col("weight").cast("string").alias("_tw"),
        )
        named = source_type.select("processor", "relative_to", F.col("source_type").alias("_st"))
        obs = obs.join(named, ["processor", "relative_to"], "left").join(best, ["_st", "_ty", "processor"], "left")
        obs = obs.withColumn("value", F.when(F.col("_v").isNull(), F.coalesce("_tw", F.lit("0"))).otherwise(F.col("value")))
    else:
        obs = obs.withColumn("value", F.coalesce("value", F.when(F.col("_v").isNull(), F.lit("0"))))
    issues.append(obs.filter("period is null").select(*issue("error", "observation without time", NODE(), F.lit("mandatory"))))
    observations = obs.filter("period is not null and value is not null").select(
        NODE().alias("node"), "processor", "interface", "period", "observer", "value", "relative_to", F.col("_to").alias("unit")
    )
    return interfaces, observations, union_all(issues)


# -- type transforms --------------------------------------------------------------------
def best_transform(pairs: DataFrame, transforms: DataFrame) -> DataFrame:
    """Best transform for each (source_type, target_type, source_context, target_context).

    A row with both contexts wins, then the source context, then the target context, then none.
    ``transforms(source_type, target_type, source_context, target_context, weight)``.
    """
    keys = ["source_type", "target_type", "source_context", "target_context"]
    t = transforms.select(
        F.col("source_type"), F.col("target_type"), F.col("source_context").alias("_sc"),
        F.col("target_context").alias("_tc"), "weight",
    )
    fits = (F.col("_sc").isNull() | (F.col("_sc") == F.col("source_context"))) & (
        F.col("_tc").isNull() | (F.col("_tc") == F.col("target_context"))
    )
    rank = (
        F.when(F.col("_sc").isNotNull() & F.col("_tc").isNotNull(), 1)
        .when(F.col("_sc").isNotNull(), 2)
        .when(F.col("_tc").isNotNull(), 3)
        .otherwise(4)
    )
    return (
        skew_join(pairs.select(*keys), t, ["source_type", "target_type"])
        .filter(fits)
        .groupBy(*keys)
        .agg(F.min_by(F.struct("weight"), F.struct(rank.alias("r"), F.col("weight").cast("string"))).alias("_b"), F.min(rank).alias("match_rank"))
        .select(*keys, "_b.weight", "match_rank")
    )


def type_transforms(rows: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows(source_types array, target_types array, weight, ...)`` to one row per type pair; pairs
    declared before are reported and left out."""
    pairs = rows.withColumn("source_type", F.explode("source_types")).withColumn("target_type", F.explode("target_types"))
    pairs = pairs.drop("source_types", "target_types")
    if existing is None:
        return pairs, pairs.limit(0).select(*issue("warning", "transform exists", F.lit(""), F.lit("")))
    known = existing.select("source_type", "target_type").distinct()
    old = pairs.join(known, ["source_type", "target_type"], "left_semi").select(
        *issue("warning", "transform exists", F.concat_ws(" -> ", "source_type", "target_type"), F.lit("skipped"))
    )
    return pairs.join(known, ["source_type", "target_type"], "left_anti"), old


# -- relations --------------------------------------------------------------------------
def match_patterns(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(pattern, name) for wildcard patterns such as ``A..B``.

    A pattern that starts with a literal part is matched by an equi-join on the first part of
    the name; the literal that follows a leading ``..`` is matched by an equi-join on the starts of the later
    parts of the names, cut at the lengths that occur in the patterns.
    """
    p = patterns.select("pattern").distinct().withColumn("_re", wildcard_regex(F.col("pattern")))
    n = names.select("name").distinct()
    fixed = p.filter(~F.col("pattern").startswith("..") & F.col("pattern").contains("..")).withColumn(
        "_head", F.substring_index("pattern", ".", 1)
    )
    headed = n.withColumn("_head", F.substring_index("name", ".", 1))
    by_head = skew_join(headed, fixed, ["_head"]).filter("name rlike _re").select("pattern", "name")
    exact = p.filter(~F.col("pattern").contains("..")).join(n, F.col("pattern") == F.col("name")).select("pattern", "name")
    free = p.filter(F.col("pattern").startswith(".."))
    # what follows the wildcard is literal: it must be one of the later parts of the name
    tails = n.select(
        "name", F.explode(F.array_distinct(F.slice(F.split("name", r"\."), F.lit(2), F.size(F.split("name", r"\."))))).alias("_tail")
    ).unionByName(n.select("name", F.lit("").alias("_tail")))
    free = free.withColumn("_tail", F.regexp_extract("pattern", r"^\.\.([^.]*)", 1))
    # a name part matches when it starts with the literal: the parts are cut at the lengths of the literals
    lengths = sorted(r["n"] for r in free.select(F.length("_tail").alias("n")).distinct().collect())
    cuts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: (n > 0) & (n <= F.length("_tail")))
    starts = tails.filter("_tail <> ''").select(
        "name", F.explode(F.transform(cuts, lambda n: F.substring("_tail", F.lit(1), n))).alias("_tail")
    )
    prefixes = starts.unionByName(tails.filter("_tail = ''")).distinct()
    loose = skew_join(prefixes, free, ["_tail"]).filter("name rlike _re").select("pattern", "name")
    return union_all([by_head, exact, loose]).distinct()


def expand_relations(relations: DataFrame, processors: DataFrame) -> DataFrame:
    """Relations with wildcards at both ends to all matching (source, target) pairs.

    ``relations(relation, source, target, ...)``. All pairs are what such a relation means; the
    sources of one relation are spread over as many pieces as keep the pairs of a piece at ``ROWS_PER_TASK``.
    """
    names = processors.select(F.col("processor").alias("name"))
    patterns = relations.select(F.explode(F.array("source", "target")).alias("pattern")).distinct()
    found = match_patterns(patterns, names)
    rest = [c for c in relations.columns if c not in ("source", "target")]
    sizes = found.groupBy("pattern").agg(F.count(F.lit(1)).alias("_n"))
    pieces = relations.join(sizes.select(F.col("pattern").alias("source"), F.col("_n").alias("_ns")), "source").join(
        sizes.select(F.col("pattern").alias("target"), F.col("_n").alias("_nt")), "target"
    )
    pieces = pieces.select("relation", F.ceil(F.col("_ns") * F.col("_nt") / ROWS_PER_TASK).cast("long").alias("_pieces"))
    cut = relations.join(pieces, "relation")
    left = (
        cut.join(found.select(F.col("pattern").alias("source"), F.col("name").alias("_s")), "source")
        .select(*rest, F.col("_s").alias("source"), F.pmod(F.xxhash64("_s"), "_pieces").alias("_b"))
    )
    right = cut.join(
        found.select(F.col("pattern").alias("target"), F.col("name").alias("_t")), "target"
    ).select("relation", F.col("_t").alias("target"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)).alias("_b"))
    return left.join(right, ["relation", "_b"]).select(*rest, "source", "target")


# Relation types in which a weight or a back interface may be given.
FLOW_RELATIONS = ("flow", "reverse_flow", "flow_back")


def build_relations(
    rows: DataFrame, interfaces: DataFrame, transforms: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Interface relations from rows: (relations, issues).

    ``rows(source_processor, source_interface, target_processor, target_interface, back_interface,
    relation_type, weight, change_type_scale)``. A missing interface takes the name of the other
    end; flows between different types need a transform (or ``change_type_scale``), whose weight
    becomes ``scale_change_weight``.
    """
    r = rows.withColumn("source_interface", F.coalesce("source_interface", "target_interface")).withColumn(
        "target_interface", F.coalesce("target_interface", "source_interface")
    )
    r = r.withColumn("relation_type", F.when(F.col("back_interface").isNotNull(), F.lit("flow_back")).otherwise(F.lower("relation_type")))
    r = r.withColumn("src", NODE("source_processor", "source_interface")).withColumn(
        "dst", NODE("target_processor", "target_interface")
    ).withColumn("back", F.when(F.col("back_interface").isNotNull(), NODE("source_processor", "back_interface")))
    side = lambda n: interfaces.select(F.col("node").alias(n), F.col("type").alias(f"_{n}_type"))
    full = r.join(side("src"), "src", "left").join(side("dst"), "dst", "left").join(side("back"), "back", "left")
    key = F.concat_ws(" -> ", "src", "dst")
    allowed = F.col("relation_type").isin(*FLOW_RELATIONS)
    issues = [
        full.filter("_src_type is null").select(*issue("warning", "interface not found", F.col("src"), key)),
        full.filter("_dst_type is null").select(*issue("warning", "interface not found", F.col("dst"), key)),
        full.filter(F.col("back").isNotNull() & ~allowed).select(*issue("error", "back interface not allowed", key, F.col("relation_type"))),
        full.filter(F.col("weight").isNotNull() & ~allowed & (F.col("relation_type") != "scale")).select(
            *issue("error", "weight not allowed", key, F.col("relation_type"))
        ),
        full.filter("back is not null and _src_type = _dst_type").select(*issue("error", "back flow needs different types", key, F.col("_src_type"))),
        full.filter("back is not null and _back_type <> _dst_type").select(*issue("error", "back and target types differ", key, F.col("_back_type"))),
    ]
    ok = full.filter("_src_type is not null and _dst_type is not null").filter(
        "back is null or (_src_type <> _dst_type and _back_type = _dst_type)"
    )
    changed = F.col("_src_type") != F.col("_dst_type")
    if transforms is not None:
        asked = ok.filter(changed & F.col("change_type_scale").isNull()).select(
            F.col("_src_type").alias("source_type"), F.col("_dst_type").alias("target_type"),
            F.col("source_processor").alias("source_context"), F.col("target_processor").alias("target_context"),
        ).distinct()
        best = best_transform(asked, transforms).select(
            F.col("source_type").alias("_src_type"), F.col("target_type").alias("_dst_type"),
            F.col("source_context").alias("source_processor"), F.col("target_context").alias("target_processor"),
            F.col("weight").alias("_tw"),
        )
        ok = ok.join(best, ["_src_type", "_dst_type", "source_processor", "target_processor"], "left")
    else:
        ok = ok.withColumn("_tw", F.lit(None).cast("double"))
    ok = ok.withColumn("scale_change_weight", F.when(changed, F.coalesce(F.col("change_type_scale").cast("double"), F.col("_tw"))))
    issues.append(ok.filter(changed & F.col("scale_change_weight").isNull()).select(*issue("error", "no type transform", key, F.concat_ws(" -> ", "_src_type", "_dst_type"))))
    good = ok.filter(~changed | F.col("scale_change_weight").isNotNull())
    # a reverse flow is written from its target
    flip = F.col("relation_type") == "reverse_flow"
    return (
        good.select(
            "relation_type",
            F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"),
            F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"),
            "back",
            F.col("weight"),
            "scale_change_weight",
        ),
        union_all(issues),
    )


# -- roll-up structures -----------------------------------------------------------------
def partof_edges(
    part_of: DataFrame, interfaces: DataFrame, processors: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Interfaces of a child surface on every ancestor: (edges, all nodes, issues).

    ``part_of(parent, child[, weight, behave_as])``, ``interfaces(node, processor, interface, type,
    orientation)``. A child that behaves as another processor passes on only the interfaces of
    that one. Archetypes (``accounted`` false) take no part.
    """
    scratch = Scratch(part_of.sparkSession, "partof")
    for c, t in (("weight", "double"), ("behave_as", "string")):
        if c not in part_of.columns:
            part_of = part_of.withColumn(c, F.lit(None).cast(t))
    if processors is not None:
        counted = processors.filter("accounted").select("processor")
        for end in ("parent", "child"):
            part_of = part_of.join(counted.withColumnRenamed("processor", end), end, "left_semi")
    links = scratch.save(part_of.select("parent", "child", "weight", "behave_as"), "links")
    own = interfaces.select("processor", "interface", "type", "orientation")
    masked = links.filter("behave_as is not null")
    cut = (
        masked.join(own.select(F.col("processor").alias("child"), "interface"), "child")
        .join(own.select(F.col("processor").alias("behave_as"), "interface"), ["behave_as", "interface"], "left_anti")
        .select("parent", "child", "interface", F.lit(True).alias("_cut"))
    )
    cut = scratch.save(cut, "cut")
    hot = hot_keys(links, ["child"])
    frontier = scratch.save(own.distinct(), "own")
    known, edges = [frontier], []
    while True:
        moved = skew_join(
            links.drop("behave_as"), frontier.withColumnRenamed("processor", "child"), ["child"],
            hot=hot if hot is not None else False,
        ).join(cut, ["parent", "child", "interface"], "left").filter("_cut is null")
        moved = scratch.save(moved.select("parent", "child", "interface", "type", "orientation", "weight"), "moved")
        if moved.isEmpty():
            break
        edges.append(moved)
        up = moved.groupBy(F.col("parent").alias("processor"), "interface").agg(
            F.min(F.struct("type", "orientation")).alias("_t")
        ).select("processor", "interface", "_t.*")
        frontier = scratch.save(
            up.join(union_all(known).select("processor", "interface"), ["processor", "interface"], "left_anti"), "surfaced"
        )
        known.append(frontier)
        if frontier.isEmpty():
            break
    nodes = union_all(known).withColumn("node", NODE())
    if not edges:
        empty = links.select(F.col("parent"), F.col("child"), F.col("weight").cast("double")).limit(0)
        return empty, nodes, links.limit(0).select(*issue("error", "", F.lit(""), F.lit("")))
    all_edges = union_all(edges)
    target = union_all(known).select(
        F.col("processor").alias("parent"), "interface", F.col("type").alias("_pt"), F.col("orientation").alias("_po")
    )
    clash = all_edges.join(target, ["parent", "interface"]).filter("type <> _pt or orientation <> _po")
    issues = clash.select(
        *issue("error", "interface redefined by aggregation", NODE("parent", "interface"), NODE("child", "interface"))
    ).distinct()
    return (
        all_edges.select(
            NODE("parent", "interface").alias("parent"), NODE("child", "interface").alias("child"),
            F.col("weight").cast("double").alias("weight"),
        ).distinct(),
        nodes,
        issues,
    )


def type_edges(types: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Subtype to supertype inside a processor and orientation: (edges, all nodes).

    The supertype node is the only interface of that type and orientation, else a synthetic
    ``processor:type:orientation``. ``nodes(node, processor, type, orientation)``.
    """
    scratch = Scratch(types.sparkSession, "types")
    up = types.filter("parent_type is not null").select("type", "parent_type").distinct()
    frontier = scratch.save(nodes.select("node", "processor", "type", "orientation").distinct(), "nodes")
    named = (
        frontier.groupBy("processor", F.col("type").alias("parent_type"), "orientation")
        .agg(F.min("node").alias("_node"), F.count(F.lit(1)).alias("_n"))
        .filter("_n = 1")
        .drop("_n")
    )
    known, edges = [frontier], []
    while True:
        rows = skew_join(frontier, up, ["type"])
        rows = skew_join(rows, named, ["processor", "parent_type", "orientation"], "left", hot=False)
        rows = rows.withColumn(
            "parent", F.coalesce("_node", F.concat_ws(":", "processor", "parent_type", "orientation"))
        )
        rows = scratch.save(rows.select("parent", F.col("node").alias("child"), "processor", "parent_type", "orientation"), "level")
        if rows.isEmpty():
            break
        edges.append(rows)
        frontier = scratch.save(
            rows.select(F.col("parent").alias("node"), "processor", F.col("parent_type").alias("type"), "orientation")
            .distinct()
            .join(union_all(known).select("node"), "node", "left_anti"),
            "synthetic",
        )
        if frontier.isEmpty():
            break
        known.append(frontier)
    if not edges:
        return frontier.select(F.col("node").alias("parent"), F.col("node").alias("child")).limit(0), union_all(known)
    return union_all(edges).select("parent", "child").distinct(), union_all(known)


# -- cloning and scaling ----------------------------------------------------------------
def clone_subtrees(
    requests: DataFrame, processors: DataFrame, part_of: DataFrame, interfaces: DataFrame, observations: DataFrame
) -> dict[str, DataFrame]:
    """Copies of processor subtrees under new parents.

    ``requests(invoking, requested, new_name)``: the copy of ``requested`` hangs from
    ``invoking`` as ``invoking.new_name``; descendants keep their place below it. Copies take
    system, subsystem and accounted from the new parent. Returns only the new rows of each table.
    """
    scratch = Scratch(requests.sparkSession, "clone")
    parent = processors.select(F.col("processor").alias("invoking"), "system", "subsystem", "accounted")
    tops = requests.select(
        "invoking", "requested", F.col("requested").alias("old"),
        F.concat_ws(".", "invoking", F.coalesce("new_name", "requested")).alias("new"),
    )
    level = scratch.save(tops, "tops")
    levels, links = [level], [level.select(F.col("invoking").alias("parent"), F.col("new").alias("child"), F.lit(None).cast("double").alias("weight"))]
    tree = part_of.select(F.col("parent").alias("old"), F.col("child").alias("_c"), *( [F.col("weight").cast("double").alias("_w")] if "weight" in part_of.columns else [F.lit(None).cast("double").alias("_w")]))
    while True:
        nxt = skew_join(tree, level, ["old"], hot=False).select(
            "invoking", "requested", F.col("_c").alias("old"), F.concat_ws(".", "new", F.substring_index("_c", ".", -1)).alias("new"),
            F.col("new").alias("_parent"), "_w",
        )
        nxt = scratch.save(nxt, "level")
        if nxt.isEmpty():
            break
        links.append(nxt.select(F.col("_parent").alias("parent"), F.col("new").alias("child"), F.col("_w").alias("weight")))
        level = nxt.drop("_parent", "_w")
        levels.append(level)
    copies = union_all(levels)
    placed = copies.join(parent, "invoking")
    inherited = ("processor", "system", "subsystem", "accounted")
    rest = [c for c in processors.columns if c not in inherited]
    new_processors = placed.join(processors.select(F.col("processor").alias("old"), *rest), "old").select(
        F.col("new").alias("processor"), "system", "subsystem", "accounted", *rest
    )

    def moved(df: DataFrame) -> DataFrame:
        rows = skew_join(df.withColumnRenamed("processor", "old"), copies.select("old", "new"), ["old"])
        rows = rows.withColumnRenamed("new", "processor").drop("old")
        if "node" in df.columns:
            rows = rows.withColumn("node", NODE())
        return rows.select(*df.columns)

    return {
        "processors": new_processors,
        "part_of": union_all(links),
        "interfaces": moved(interfaces),
        "observations": moved(observations),
        "copies": copies.select("invoking", "requested", "old", "new"),
    }


def apply_scalings(
    rows: DataFrame,
    processors: DataFrame,
    part_of: DataFrame,
    interfaces: DataFrame,
    observations: DataFrame,
    transforms: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """CloneAndScale, Clone, CloneScaled and Scale rows: whole tables after the operation plus
    ``scales(src, dst, weight)`` and ``issues``.

    ``rows(invoking, requested, invoking_interface, requested_interface, scaling_type, scale,
    new_name)``. CloneAndScale and Scale tie the requested interface to the invoking one;
    CloneScaled multiplies the observations of the copy that are relative to the requested
    interface and makes them absolute.
    """
    kind = F.lower("scaling_type")
    same = rows.filter(F.col("invoking") == F.col("requested"))
    rows = rows.filter(F.col("invoking") != F.col("requested"))
    cloned = rows.filter(kind.isin("cloneandscale", "clone", "clonescaled"))
    new = clone_subtrees(
        cloned.select("invoking", "requested", "new_name"), processors, part_of, interfaces, observations
    )
    target = F.concat_ws(".", "invoking", F.coalesce("new_name", "requested"))
    ties = rows.filter(kind.isin("cloneandscale", "scale")).select(
        NODE("invoking", "invoking_interface").alias("src"),
        F.when(kind == "scale", NODE("requested", "requested_interface"))
        .otherwise(F.concat_ws(":", target, F.col("requested_interface")))
        .alias("dst"),
        F.col("scale").cast("string").alias("weight"),
        F.col("invoking").alias("source_context"),
        F.when(kind == "scale", F.col("requested")).otherwise(target).alias("target_context"),
    )
    all_interfaces = interfaces.unionByName(new["interfaces"])
    side = lambda n: all_interfaces.select(F.col("node").alias(n), F.col("type").alias(f"{n}_type"))
    typed = ties.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    lost = typed.filter("src_type is null or dst_type is null").select(
        *issue("error", "interface of scaling not found", F.concat_ws(" -> ", "src", "dst"), F.lit("skipped"))
    )
    ok = typed.filter("src_type is not null and dst_type is not null")
    if transforms is not None:
        asked = ok.filter("src_type <> dst_type").select(
            F.col("src_type").alias("source_type"), F.col("dst_type").alias("target_type"), "source_context", "target_context"
        ).distinct()
        best = best_transform(asked, transforms).select(
            F.col("source_type").alias("src_type"), F.col("target_type").alias("dst_type"), "source_context",
            "target_context", F.col("weight").cast("string").alias("_tw"),
        )
        ok = ok.join(best, ["src_type", "dst_type", "source_context", "target_context"], "left").withColumn(
            "weight", multiply_text(F.col("weight"), F.col("_tw"))
        )
    fixed = cloned.filter(kind == "clonescaled").select(
        target.alias("processor"), F.lower("requested_interface").alias("_rel"), F.col("scale").cast("double").alias("_k")
    )
    obs = new["observations"].withColumn("_rel", F.lower("relative_to")).join(fixed, ["processor", "_rel"], "left")
    scaled = (
        obs.withColumn("value", F.when(F.col("_k").isNotNull(), (F.col("value").cast("double") * F.col("_k")).cast("string")).otherwise(F.col("value").cast("string")))
        .withColumn("relative_to", F.when(F.col("_k").isNull(), F.col("relative_to")))
        .select(*observations.columns)
    )
    if dict(observations.dtypes)["value"] != "string":
        scaled = scaled.withColumn("value", F.col("value").cast(dict(observations.dtypes)["value"]))
    return {
        "processors": processors.unionByName(new["processors"]),
        "part_of": part_of.unionByName(new["part_of"], allowMissingColumns=True),
        "interfaces": all_interfaces,
        "observations": observations.unionByName(scaled),
        "scales": ok.select("src", "dst", "weight"),
        "issues": lost.unionByName(
            same.select(*issue("error", "scaling of a processor by itself", F.col("invoking"), F.lit("use relative_to")))
        ),
    }


NEGLIGIBLE_WEIGHT = 1e-6  # fixed value: matrix cells at or below it create nothing


def match_by_attributes(cells: DataFrame, processors: DataFrame, attributes: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Processor of every attribute tuple: (cells with column ``name``, issues for none / several)."""
    found = processors.groupBy(*attributes).agg(F.min("processor").alias(name), F.count(F.lit(1)).alias("_n"))
    rows = skew_join(cells, found, list(attributes), "left")
    key = F.concat_ws("|", *attributes)
    bad = rows.filter("_n is null or _n > 1").select(*attributes, "_n").distinct()
    issues = bad.select(
        *issue("error", f"{name} not matched once", key, F.concat(F.coalesce("_n", F.lit(0)).cast("string"), F.lit(" matches")))
    )
    return rows.filter("_n = 1").drop("_n"), issues


def upscale(
    cells: DataFrame,
    parents: DataFrame,
    children: DataFrame,
    parent_attributes: Sequence[str],
    child_attributes: Sequence[str],
    scaled_interface: str,
    model: Mapping[str, DataFrame],
    negligible: float = NEGLIGIBLE_WEIGHT,
) -> dict[str, DataFrame]:
    """Weight matrix over attribute tuples: each weight clones the matching child under the
    matching parent and ties the scaled interface of both.

    ``cells(<parent attributes>, <child attributes>, weight)``; ``model`` holds processors,
    part_of, interfaces, observations.
    """
    used = cells.filter(F.abs("weight") > negligible)
    left_out = cells.filter(F.abs("weight") <= negligible).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0")
    left_out = left_out.select(*issue("warning", "negligible weights left out", F.lit(scaled_interface), F.col("_n").cast("string")))
    with_parent, issues_p = match_by_attributes(used, parents, parent_attributes, "invoking")
    matched, issues_c = match_by_attributes(with_parent, children, child_attributes, "requested")
    # one copy per cell: the name tells the copies of a child under one parent apart
    rows = matched.select(
        "invoking",
        "requested",
        F.lit(scaled_interface).alias("invoking_interface"),
        F.lit(scaled_interface).alias("requested_interface"),
        F.lit("CloneAndScale").alias("scaling_type"),
        F.col("weight").cast("string").alias("scale"),
        F.col("requested").alias("new_name"),
    )
    out = apply_scalings(rows, model["processors"], model["part_of"], model["interfaces"], model["observations"])
    out["issues"] = union_all([out["issues"], issues_p, issues_c, left_out])
    return out


# -- counterparts -----------------------------------------------------------------------
def add_default_counterparts(
    processors: DataFrame, interfaces: DataFrame, flows: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New (processors, interfaces, flows) for interfaces that point to another subsystem but
    have no flow on that side.

    The processor is ``<system>_<opposite subsystem>``; its interface carries the type with the
    opposite orientation; the flow follows the orientations.
    """
    place = processors.select("processor", "system", "subsystem", "accounted")
    lone = interfaces.join(place, "processor").filter(
        F.col("accounted")
        & F.col("opposite_subsystem").isNotNull()
        & (F.lower("opposite_subsystem") != F.lower("subsystem"))
    )
    is_input = F.lower("orientation") == "input"
    fed = flows.select(F.col("dst").alias("node")).distinct()
    drained = flows.select(F.col("src").alias("node")).distinct()
    lone = lone.filter(is_input).join(fed, "node", "left_anti").unionByName(
        lone.filter(~is_input).join(drained, "node", "left_anti")
    )
    other = F.concat_ws("_", "system", "opposite_subsystem")
    rows = lone.select(
        "node", "type", "roegen_type", "unit", "system", "subsystem", "opposite_subsystem", other.alias("_p"),
        F.concat_ws(":", other, F.col("type")).alias("_n"), is_input.alias("_in"),
    )
    new_processors = (
        rows.groupBy("_p").agg(F.min("system").alias("system"), F.min("opposite_subsystem").alias("subsystem"))
        .select(F.col("_p").alias("processor"), "system", "subsystem", F.lit(True).alias("accounted"), F.lit("Functional").alias("functional"))
        .join(processors.select("processor"), "processor", "left_anti")
    )
    sphere = F.when(F.lower("_o").isin("local", "external"), F.lit("Technosphere")).otherwise(F.lit("Biosphere"))
    new_interfaces = (
        rows.groupBy("_n").agg(
            F.min("_p").alias("processor"), F.min("type").alias("interface"), F.min("type").alias("type"),
            F.min(F.when(F.col("_in"), F.lit("Output")).otherwise(F.lit("Input"))).alias("orientation"),
            F.min("opposite_subsystem").alias("_o"), F.min("roegen_type").alias("roegen_type"),
            F.min("subsystem").alias("opposite_subsystem"), F.min("unit").alias("unit"),
        )
        .select(
            F.col("_n").alias("node"), "processor", "interface", "type", "orientation", sphere.alias("sphere"),
            "roegen_type", "opposite_subsystem", "unit",
        )
        .join(interfaces.select("node"), "node", "left_anti")
    )
    new_flows = rows.select(
        F.when(F.col("_in"), F.col("_n")).otherwise(F.col("node")).alias("src"),
        F.when(F.col("_in"), F.col("node")).otherwise(F.col("_n")).alias("dst"),
        F.lit(None).cast("double").alias("weight"),
    ).distinct()
    return new_processors, new_interfaces, new_flows


# -- places and attributes --------------------------------------------------------------
def geo_join(processors: DataFrame, features: DataFrame) -> DataFrame:
    """Processors with the feature of their (geo_ref, geo_code)."""
    return skew_join(
        processors, features.withColumnRenamed("reference", "geo_ref").withColumnRenamed("code", "geo_code"), ["geo_ref", "geo_code"]
    )


def attribute_values(processors: DataFrame, group: str = "group") -> DataFrame:
    """Distinct attribute values per processor group, one row each: (group, attribute, value)."""
    return processors.select(group, F.explode("attributes").alias("attribute", "value")).distinct()


# The nine kinds of version-1 data rows as (roegen type, internal, incoming).
DATA_KINDS = {
    "int_in_flow": ("Flow", True, True),
    "int_in_fund": ("Fund", True, True),
    "int_out_flow": ("Flow", True, False),
    "ext_in_flow": ("Flow", False, True),
    "ext_in_fund": ("Fund", False, True),
    "ext_out_flow": ("Flow", False, False),
    "env_in_flow": ("Flow", False, True),
    "env_in_fund": ("Fund", False, True),
    "env_out_flow": ("Flow", False, False),
}


def classify_data_kind(kind: Column) -> Column:
    """struct<roegen_type, internal, incoming> of a version-1 flow / fund kind (NULL when unknown)."""
    out = None
    for k, (roegen, internal, incoming) in DATA_KINDS.items():
        s = F.struct(F.lit(roegen).alias("roegen_type"), F.lit(internal).alias("internal"), F.lit(incoming).alias("incoming"))
        out = F.when(F.lower(kind) == k, s) if out is None else out.when(F.lower(kind) == k, s)
    return out


def structure_rows(rows: DataFrame) -> DataFrame:
    """``rows(origin, destinations array<struct<destination, relation_type, weight>>)`` to one row each."""
    return rows.select("origin", F.explode("destinations").alias("_d")).select("origin", "_d.*")
