"""Cycles of a directed graph, named by just their members: strongly connected components.

Nodes without a way in or out are trimmed. Then every node takes the smallest node that reaches it as its colour (forward), and the nodes that
reach the colour's own node inside it (backward) are one component; what is left is looked at again. Each step is a join of
the nodes that changed in the step before with the edges that are left; colours are kept in a log (``KeptState``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.operators.incremental import KeptState
from tallyflow.operators.issues import issue
from tallyflow.runtime import Scratch, skew_join, sorted_numbers

WORTH_TRIMMING = 0.1  # share of the edges that a trimming must remove for another one to follow


def cyclic_parts(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, part): every node that lies on a cycle, with the smallest node of its component. A node with an edge to
    itself is a cycle of its own. Nodes that only lead to a cycle, or are only reached from one, are not listed."""
    scratch = Scratch(edges.sparkSession, "cycles")
    named = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).filter("_s is not null and _d is not null").distinct()
    named = scratch.save(named, "edges")
    numbers, _ = sorted_numbers(named.select(F.explode(F.array("_s", "_d")).alias("name")), "name", "id", scratch)
    rows = skew_join(named, numbers.select(F.col("name").alias("_s"), F.col("id").alias("u")), ["_s"])
    rows = skew_join(rows, numbers.select(F.col("name").alias("_d"), F.col("id").alias("v")), ["_d"]).select("u", "v")
    rows = scratch.save(rows, "numbered")
    found = [rows.filter("u = v").select(F.col("u").alias("id"), F.col("u").alias("part"))]
    left, n = scratch.save_counted(rows.filter("u <> v"), "left")
    while n:
        left, n = _trim(left, n, scratch)
        if n:
            part = scratch.save(_parts(left, scratch), "parts")
            size = part.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("part")
            found.append(skew_join(part, size, ["part"], "left_semi"))
            gone = part.select("id")
            left = left.join(gone.withColumnRenamed("id", "u"), "u", "left_anti").join(gone.withColumnRenamed("id", "v"), "v", "left_anti")
            left, n = scratch.save_counted(left, "left")
    members = found[0]
    for more in found[1:]:
        members = members.unionByName(more)
    members = members.groupBy("id").agg(F.min("part").alias("part"))
    names = numbers.select(F.col("id"), F.col("name").alias("node"))
    out = members.join(names, "id").join(numbers.select(F.col("id").alias("part"), F.col("name").alias("_part")), "part")
    return scratch.save(out.select("node", F.col("_part").alias("part")), "members")


def _trim(left: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Edges whose start has a way in and whose end has a way out, as long as it pays."""
    while n:
        kept = left.join(left.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        kept = kept.join(left.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        left, now = scratch.save_counted(kept, "trimmed")
        n, before = now, n
        if before - now < WORTH_TRIMMING * before:
            break
    return left, n


def _parts(left: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, part): the components that hold the smallest node of their colour."""
    nodes, n = scratch.save_counted(left.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("colour", F.col("id")), "nodes")
    colours = KeptState(scratch, ["id"], {"colour": ("long", F.min("colour"))}, "colour")
    colours.append(nodes, n)
    frontier = nodes
    while True:
        reached = skew_join(left, frontier.withColumnRenamed("id", "u"), ["u"]).groupBy(F.col("v").alias("id")).agg(F.min("colour").alias("colour"))
        better = colours.beside(scratch.save(reached, "reached")).filter("colour < old_colour").drop("old_colour")
        frontier, n = scratch.save_counted(better, "recoloured")
        if not n:
            break
        colours.append(frontier, n)
    colour = nodes.select("id")
    colour = scratch.save(colours.beside(colour).select("id", F.col("old_colour").alias("colour")), "colours")
    inside = left.join(colour.withColumnRenamed("id", "u"), "u").join(colour.select(F.col("id").alias("v"), F.col("colour").alias("_c")), "v")
    inside = scratch.save(inside.filter("colour = _c").select("u", "v"), "inside")  # edges within a colour
    part, n = scratch.save_counted(colour.filter("id = colour").select("id", F.col("colour").alias("part")), "roots")
    known = KeptState(scratch, ["id"], {"part": ("long", F.min("part"))}, "part")
    frontier = part
    while n:
        known.append(frontier, n)
        before = skew_join(inside, frontier.withColumnRenamed("id", "v"), ["v"]).select(F.col("u").alias("id"), "part").distinct()
        new = known.beside(scratch.save(before, "before")).filter("old_part is null").drop("old_part")
        frontier, n = scratch.save_counted(new, "joined")
    return known.beside(nodes.select("id")).filter("old_part is not null").select("id", F.col("old_part").alias("part"))


def cycle_issues(edges: DataFrame, src: str, dst: str, rule: str) -> DataFrame:
    """One issue row for each node on a cycle: the node as key, the cycle (its smallest node) as message."""
    return cyclic_parts(edges, src, dst).select(*issue("error", rule, F.col("node").cast("string"), F.col("part").cast("string")))
