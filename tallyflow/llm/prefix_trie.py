"""Prefix trie of conversations, by burst tries.

Turns are rows throughout: no conversation, however long, is gathered in one task.

* ``numbered``: rows are sorted across the cluster by conversation and turn; a task numbers its part and sums the hash of every prefix (two
  polynomials modulo 2^64, whose multipliers can be shifted, so that a prefix continues in another task or conversation). A turn is from here on
  its hash and the bytes of its text; a prefix of d turns is its hash, which names a node of depth d.
* ``rebuilt``: the first turns of another conversation stand before the rest of a conversation's own; the hashes follow by arithmetic.
* ``burst``: a container holds the suffixes of all conversations below one prefix. Containers of more than ``CAPACITY`` turns burst by the next turn id:
  their top becomes a node of the trie head, and the suffixes go to containers one turn deeper. As many levels burst in a round as the window is wide, and windows
  widen eightfold, so that a chain of n turns takes log8(n) rounds. Copies of one conversation, or one endless conversation, burst to their end.
* ``swept``: a container that remains is sorted and swept in one task: neighbours share nodes as far as their prefixes agree.
* ``trie``: nodes of the head are summed up row by row before the shuffle. What lies below a node (leaves, saved tokens) is what the smallest members of the nodes
  below it bring, summed from the end of each conversation in blocks of ``BLOCK`` turns. The ids of the members that end
  at a node are sorted across the cluster, joined in pieces, and the pieces are hashed one after another.

Null roles and texts are empty; turns are ordered by number (null first), then role and text, so that repeated numbers have one order; repeated
rows count as turns of their own. Rows with a null conv_id belong to no conversation and are dropped. No conversation: no node, not even the root.
Further columns are kept out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.texts import slices
from tallyflow.runtime import Scratch, skew_join, union_all

CAPACITY = 512  # turns of a container that is not burst: small, so that a common first turn is dealt out
FIRST_WINDOW, WIDER = 8, 8
BLOCK = 65_536  # turns of a conversation that are summed up together
PIECE = 1 << 20  # bytes of joined ids that are handed on together
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd: they have inverses modulo 2^64
WORD = 1 << 64
FAMILY, SHARED = 5, 9  # c - c % 5 lends up to 8 turns
PREFIX = ["p1", "p2"]


def powers(base: int, first: int, n: int) -> np.ndarray:
    """base ** first .. base ** (first + n - 1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[0] = pow(base, first, WORD)
    return np.multiply.accumulate(out)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def unsigned(column: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(column.to_numpy(zero_copy_only=False)).view(np.uint64)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def fields(ddl: str) -> pa.Schema:
    """Arrow schema of a DDL of plain columns, without a session."""
    return pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


NUMBERED = "conv_id long, part int, pos long, p1 long, p2 long, bytes long"


def _number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    arrow = fields(NUMBERED)
    part = TaskContext.get().partitionId()
    last, pos, sums = None, 0, [0, 0]
    for whole in parts:
        for rows in slices(iter([whole]), "text"):
            conv = rows.column("conv_id").to_numpy()
            texts = rows.column("text").to_pylist()
            digests = [hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest() for r, t in zip(rows.column("role").to_pylist(), texts, strict=True)]
            turns = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
            places, p = np.empty(len(conv), np.int64), np.empty((2, len(conv)), np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(conv)) + 1).tolist(), len(conv)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b == a:
                    continue
                if conv[a] != last:
                    last, pos, sums = conv[a], 0, [0, 0]
                places[a:b] = np.arange(pos + 1, pos + 1 + b - a)
                for k, base in enumerate(BASES):
                    p[k, a:b] = np.add.accumulate(turns[a:b, k] * powers(base, pos + 1, b - a)) + np.uint64(sums[k])
                    sums[k] = int(p[k, b - 1])
                pos += b - a
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("conv_id"), pa.array(np.full(len(conv), part, np.int32)), pa.array(places), pa.array(signed(p[0])),
                    pa.array(signed(p[1])), pa.array([len(t.encode()) for t in texts], pa.int64()),
                ],
                schema=arrow,
            )


def _continued(ends: pd.DataFrame) -> pd.DataFrame:
    """For each part of a conversation what stands before it: turns and prefix sums."""
    ends = ends.sort_values("part")
    rows, n, sums = [], 0, [0, 0]
    for r in ends.itertuples():
        rows.append((r.conv_id, r.part, n, *(s - WORD if s >= WORD // 2 else s for s in sums)))
        for k, base in enumerate(BASES):
            sums[k] = (sums[k] + pow(base, n, WORD) * (int((r.p1, r.p2)[k]) % WORD)) % WORD
        n += r.pos
    return pd.DataFrame(rows, columns=["conv_id", "part", "n", "b1", "b2"])


def with_prefix(rows: DataFrame, columns: str, change: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> DataFrame:
    """Rows with the columns of the DDL ``columns``, of which ``change`` makes some anew from the batch's arrays (prefixes unsigned)."""
    arrow = fields(columns)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                arrays = {n: unsigned(c) if n[0] in "pbo" and n[1:].isdigit() else c.to_numpy() for n, c in zip(part.schema.names, part.columns, strict=True)}
                made = change(arrays)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(made[f.name]) if f.name in ("p1", "p2") else made[f.name], f.type) if f.name in made else part.column(f.name).cast(f.type) for f in arrow],
                    schema=arrow,
                )

    return rows.mapInArrow(run, columns)


def _shift(base: int, by: np.ndarray) -> np.ndarray:
    """base ** by modulo 2^64; negative powers are those of the inverse."""
    values, back = np.unique(by, return_inverse=True)
    return np.array([pow(base, int(v), WORD) for v in values], np.uint64)[back]


def numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos from 1, p1, p2, bytes): place and prefix hash of every turn."""
    clean = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    parts = scratch.save(
        clean.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(_number, NUMBERED), "numbered"
    )
    ends = parts.groupBy("conv_id", "part").agg(F.max_by(F.struct("pos", "p1", "p2"), "pos").alias("e")).select("conv_id", "part", "e.*")
    ends = scratch.save(ends, "ends")
    split = ends.groupBy("conv_id").count().filter("count > 1").select("conv_id")  # no more than there are tasks
    before = ends.join(split, "conv_id").groupBy("conv_id").applyInPandas(_continued, "conv_id long, part int, n long, b1 long, b2 long")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "b1", "b2")}
    rows = parts.join(scratch.save(before, "before"), ["conv_id", "part"], "left").withColumns(zero)

    def join_up(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {"pos": x["pos"] + x["n"], **{f"p{k + 1}": x[f"b{k + 1}"] + _shift(b, x["n"]) * x[f"p{k + 1}"] for k, b in enumerate(BASES)}}

    return scratch.save(with_prefix(rows, "conv_id long, pos long, p1 long, p2 long, bytes long", join_up), "turns")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows conv_id, pos, p1, p2, bytes, n; conversations conv_id, n) with n turns each: the first h turns of the family's first
    conversation, then the own turns after the first h."""
    zero = F.lit(0).cast("long")
    talks = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY)
    talks = scratch.save(talks.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % SHARED), "talks")
    early = scratch.save(turns.filter(F.col("pos") < SHARED), "early")  # at most 8 rows of a conversation
    at_h = early.select("conv_id", F.col("pos").alias("h"), F.col("p1").alias("o1"), F.col("p2").alias("o2"))
    firsts = talks.select(F.col("conv_id").alias("first"), F.col("own").alias("lent"))
    info = talks.join(firsts, "first", "left").withColumn("lent", F.least("h", F.coalesce("lent", zero)))
    info = info.join(at_h, ["conv_id", "h"], "left")  # a conversation that is shorter has no turn of its own left
    lender = at_h.select(F.col("conv_id").alias("first"), F.col("h").alias("lent"), F.col("o1").alias("b1"), F.col("o2").alias("b2"))
    info = info.join(lender, ["first", "lent"], "left").withColumns({c: F.coalesce(c, zero) for c in ("o1", "o2", "b1", "b2")})
    info = scratch.save(info.withColumn("n", F.col("lent") + F.greatest(zero, F.col("own") - F.col("h"))), "info")

    lent = early.withColumnRenamed("conv_id", "first").join(info.filter("lent > 0").select("first", "conv_id", "lent", "n"), "first")
    lent = lent.filter("pos <= lent").select("conv_id", "pos", "p1", "p2", "bytes", "n")
    own = skew_join(turns, info.select("conv_id", "h", "lent", "o1", "o2", "b1", "b2", "n"), ["conv_id"]).filter("pos > h")

    def join_up(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        by = x["lent"] - x["h"]
        return {"pos": x["pos"] + by, **{f"p{k + 1}": x[f"b{k + 1}"] + (x[f"p{k + 1}"] - x[f"o{k + 1}"]) * _shift(b, by) for k, b in enumerate(BASES)}}

    rows = lent.unionByName(with_prefix(own, "conv_id long, pos long, p1 long, p2 long, bytes long, n long", join_up))
    return scratch.save(rows, "rebuilt"), info.select("conv_id", "n")


def burst(rows: DataFrame, scratch: Scratch, capacity: int) -> DataFrame:
    """Nodes (p1, p2, pos) of the trie head: prefixes with more than ``capacity`` turns at or below them."""
    heads, live, low, width = [], rows, 1, FIRST_WINDOW
    size = F.sum(F.col("n") - F.col("pos") + 1).alias("size")
    while True:
        high = low + width - 1
        found = live.filter(F.col("pos").between(low, high)).groupBy(*PREFIX, "pos").agg(size).filter(F.col("size") > capacity)
        found = scratch.save(found.select(*PREFIX, "pos"), "head")
        heads.append(found)
        deepest = found.filter(F.col("pos") == high)
        if deepest.isEmpty():
            return union_all(heads)
        through = rows.filter((F.col("pos") == high) & (F.col("n") > high)).join(deepest, [*PREFIX, "pos"], "left_semi").select("conv_id")
        live = skew_join(rows.filter(F.col("pos") > high), scratch.save(through, "through"), ["conv_id"], "left_semi")
        low, width = high + 1, width * WIDER


def placed(rows: DataFrame, heads: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with ``head`` (is the prefix a node of the head?) and ``top``, the place of the conversation's first turn in a container."""
    marked = skew_join(rows, heads.withColumn("head", F.lit(True)), [*PREFIX, "pos"], "left").withColumn("head", F.coalesce("head", F.lit(False)))
    marked = scratch.save(marked, "marked")
    depth = scratch.save(marked.filter("head").groupBy("conv_id").agg((F.max("pos") + 1).alias("top")), "depth")
    return skew_join(marked, depth, ["conv_id"], "left").withColumn("top", F.coalesce("top", F.lit(1).cast("long")))


SWEPT = (
    "p1 long, p2 long, depth long, conv_id long, up long, up1 long, up2 long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)


def joined_ids(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class Container:
    """The suffixes below one prefix, sorted, and swept into nodes."""

    def __init__(self, above: tuple[int | None, int | None], first: int):
        self.above, self.first = above, first  # prefix of the node above, depth of the first turn here
        self.suffixes: list[tuple[list[tuple[int, int]], int, list[int]]] = []  # prefixes, conversation, bytes

    def nodes(self) -> Iterator[tuple]:
        """Rows of SWEPT; ``up`` is the parent's smallest member, null at the top, where (up1, up2) is the parent's prefix."""
        made: list[list] = []  # prefix, depth, parent's place, bytes, members, smallest, children, leaves, saved, ends; parents first
        path: list[int] = []
        before: list[tuple[int, int]] = []
        for prefixes, conv, sizes in sorted(self.suffixes):
            same = 0
            while same < min(len(before), len(prefixes)) and before[same] == prefixes[same]:
                same += 1
            del path[same:]
            for k in range(same, len(prefixes)):
                made.append([prefixes[k], self.first + k, path[-1] if path else None, sizes[k], 0, conv, 0, 0, 0, []])
                path.append(len(made) - 1)
            node = made[path[-1]]
            node[9].append(conv)
            node[4] += 1
            node[5] = min(node[5], conv)
            before = prefixes
        for node in reversed(made):
            _, _, up, size, members, least, _, leaves, saved, _ = node
            node[7], node[8] = leaves or 1, saved + (members - 1) * size
            if up is not None:
                parent = made[up]
                parent[4] += members
                parent[5] = min(parent[5], least)
                parent[6] += 1
                parent[7] += node[7]
                parent[8] += node[8]
        for prefix, depth, up, _, members, least, children, leaves, saved, ends in made:
            above = self.above if up is None else (None, None)
            yield *prefix, depth, least, None if up is None else made[up][5], *above, members, children, leaves, saved, joined_ids(sorted(ends))


def _sweep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by container, conversation and place to nodes, one container at a time."""
    arrow = fields(SWEPT)
    key, container, conv, out = None, None, None, []

    def packed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        out.clear()
        return made

    for part in parts:
        for c1, c2, top, a1, a2, c, p1, p2, size in zip(*(x.to_pylist() for x in part.columns), strict=True):
            if (c1, c2, top) != key:
                if container is not None:
                    out.extend(container.nodes())
                    if len(out) >= 10_000:
                        yield packed()
                key, container, conv = (c1, c2, top), Container((a1, a2), top), None
            if c != conv:
                conv = c
                container.suffixes.append(([], c, []))
            container.suffixes[-1][0].append((p1, p2))
            container.suffixes[-1][2].append(size)
    if container is not None:
        out.extend(container.nodes())
    if out:
        yield packed()


def swept(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes of all containers from ``placed`` rows."""
    inside = rows.filter("NOT head")
    tops = inside.filter("pos = top").select("conv_id", F.col("p1").alias("c1"), F.col("p2").alias("c2"))
    above = rows.filter("pos = top - 1").select("conv_id", F.col("p1").alias("a1"), F.col("p2").alias("a2"))
    tops = scratch.save(tops.join(above, "conv_id", "left"), "tops")
    keyed = inside.join(tops, "conv_id").select("c1", "c2", "top", "a1", "a2", "conv_id", *PREFIX, "bytes", "pos")
    near = keyed.repartition("c1", "c2", "top").sortWithinPartitions("c1", "c2", "top", "conv_id", "pos").drop("pos")
    return scratch.save(near.mapInArrow(_sweep, SWEPT), "swept")


def _pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (p1, p2, depth, conv_id) to joined ids, in pieces."""
    arrow = fields(PIECES)
    key, first, ids, size = None, 0, [], 0

    def packed() -> pa.RecordBatch:
        row = (*key, first, ",".join(ids))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    for part in parts:
        for *node, conv in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if node != key or size > PIECE:
                if ids:
                    yield packed()
                key, first, ids, size = node, conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield packed()


DIGESTS = "p1 long, p2 long, depth long, ends_sha256 string"
PIECES = "p1 long, p2 long, depth long, first long, ids string"


def _hash_pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow = fields(DIGESTS)
    key, state, out = None, None, []

    def packed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        out.clear()
        return made

    for part in parts:
        for *node, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if node != key:
                if state is not None:
                    out.append((*key, state.hexdigest()))
                    if len(out) >= 10_000:
                        yield packed()
                key, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield packed()


def end_digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, depth, ends_sha256) of rows (p1, p2, depth, conv_id): a node with many ends is joined by many tasks."""
    key = [*PREFIX, "depth"]
    pieces = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(_pieces, PIECES)
    near = pieces.repartition(*key).sortWithinPartitions(*key, "first").drop("first")
    return near.mapInArrow(_hash_pieces, DIGESTS)


def from_the_end(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (conv_id, pos, leaves, saved, ...) with the sums of a conversation's rows at ``pos`` and beyond, block by block."""
    blocked = scratch.save(rows.withColumn("block", F.expr(f"pos div {BLOCK}")), "brought")
    sums = blocked.groupBy("conv_id", "block").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    beyond = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", *(F.coalesce(F.sum(c).over(beyond), F.lit(0).cast("long")).alias(c) for c in ("l", "s")))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    run = blocked.withColumns({c: F.sum(c).over(inside) for c in ("leaves", "saved")})
    whole = {"leaves": F.col("leaves") + F.col("l"), "saved": F.col("saved") + F.col("s")}
    return run.join(sums, ["conv_id", "block"]).withColumns(whole).drop("block", "l", "s")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODE = [*PREFIX, "depth"]
EMPTY = joined_ids([])


def head_nodes(rows: DataFrame, inner: DataFrame, talks: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes of the head and the root, smallest members of these as p1, p2, depth, conv_id)."""
    zero = F.lit(0).cast("long")
    head_rows = rows.filter("head").withColumnRenamed("pos", "depth")
    nodes = head_rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"))
    before = head_rows.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"))
    nodes = scratch.save(nodes.join(before, ["conv_id", "depth"], "left"), "outer")  # the prefix before, of the smallest member
    tops = scratch.save(inner.filter("up IS NULL").drop("up", "ends_sha256"), "inner-tops")

    above = [F.col("up1").alias("p1"), F.col("up2").alias("p2"), (F.col("depth") - 1).alias("depth")]
    children = tops.select(*above).unionByName(nodes.select(*above)).filter("depth > 0").groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = scratch.save(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "outer-children")

    own = nodes.select("conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    below = tops.select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    brought = scratch.save(own.unionByName(below).groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "brings")
    with_any = head_rows.join(brought.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", *NODE)
    steps = with_any.join(brought, ["conv_id", "depth"], "left").withColumns({c: F.coalesce(c, zero) for c in ("leaves", "saved")})
    sums = from_the_end(steps.withColumnRenamed("depth", "pos"), scratch).withColumnRenamed("pos", "depth")
    sums = sums.groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    ends = head_rows.filter("depth = n").select(*NODE, "conv_id")
    ends = end_digests(ends.unionByName(talks.filter("n = 0").select(zero.alias("p1"), zero.alias("p2"), zero.alias("depth"), "conv_id")))
    ends = scratch.save(ends, "digests")

    first = F.count_if(F.col("depth") == 1)
    totals = brought.agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    starts = tops.select("depth").unionByName(nodes.select("depth")).agg(first.alias("n_children"))
    root = talks.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    root = root.withColumn("one", F.lit(1))
    root = root.join(totals.withColumn("one", F.lit(1)), "one").join(starts.withColumn("one", F.lit(1)), "one").drop("one").filter("n_convs > 0")
    root = root.withColumns({"p1": zero, "p2": zero, "depth": zero, "parent_conv_id": F.lit(None).cast("long"), "saved_tokens": F.coalesce("saved_tokens", zero)})
    root = root.withColumn("n_leaves", F.greatest(F.coalesce("n_leaves", zero), F.lit(1).cast("long")))  # alone, the root is its leaf
    root = scratch.save(root, "root")

    least = scratch.save(nodes.select(*NODE, "conv_id").unionByName(root.select(*NODE, "conv_id")), "least")
    found = with_parent(nodes.join(sums, NODE), least)
    whole = found.unionByName(root, allowMissingColumns=True).join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return whole.select(*RESULT), least


def with_parent(nodes: DataFrame, least: DataFrame) -> DataFrame:
    """Adds parent_conv_id, the smallest member of the node (up1, up2, depth - 1)."""
    zero = F.lit(0).cast("long")
    parents = least.select(
        F.col("p1").alias("up1"), F.col("p2").alias("up2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id")
    )
    nodes = nodes.withColumns({c: F.coalesce(c, zero) for c in ("up1", "up2")})  # nothing stands before the first turn
    return skew_join(nodes, parents, ["up1", "up2", "depth"])


def trie(turns: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node; c % 5 has the sign of c."""
    scratch = Scratch(turns.sparkSession, "trie")
    rows, talks = rebuilt(numbered(turns, scratch), scratch)
    heads = scratch.save(burst(rows, scratch, capacity), "heads")
    rows = scratch.save(placed(rows, heads, scratch), "placed")
    inner = swept(rows, scratch)
    outer, least = head_nodes(rows, inner, talks, scratch)
    below = inner.filter("up IS NOT NULL").withColumn("parent_conv_id", F.col("up")).select(*RESULT)
    tops = with_parent(inner.filter("up IS NULL"), least).select(*RESULT)
    return outer.unionByName(below).unionByName(tops)
