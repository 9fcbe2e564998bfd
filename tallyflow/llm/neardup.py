"""Near-duplicate documents by MinHash and an LSH forest.

1. Each text becomes its set of distinct word shingles; one 64-bit digest pair stands for the whole set, so that
   equal sets fall together before anything is compared. A text under the smallest id of a set represents it.
2. A signature of ``TREES * DEPTH`` minima, one byte each, is taken of each representative. Tree ``t`` of the forest is the
   order of all signatures rotated by ``t * DEPTH``: a range-partitioned sort of the whole table by the whole label.
3. Rows that share a prefix in one order are a region. The depth of the prefix adapts: a region of more than ``REGION`` rows at a depth of
   ``LEVELS[0]`` bytes is split by the next bytes until its parts have no more (or their labels are equal). In a region every row is compared by its whole
   signature with the ``REGION`` rows before it, its neighbours with the longest common prefixes; a forest of near pairs joins what near
   pairs join. Where a region was split, one row of each part stands for it in the region above, whose order is walked in the same way: what
   belongs together but was cut meets again, and no region is compared with all pairs.
4. Candidates are confirmed on the full sets, and links give components.
5. What the forest may have left apart is looked at again. A group of candidates that links do not join is compared whole on the full sets, in blocks,
   if it has at most ``WHOLE`` rows. Rows of larger groups, and rows of a split region that holds several groups, are put under the first ``n - ceil(threshold * n) + 1`` of
   their ``n`` shingles in the order of their frequency (two sets that are alike enough share one of these): rows under one shingle that are
   apart and near by their signatures are candidates, all of them, and are confirmed. Nothing is united but by a link.

``threshold`` is in hundredths: a link needs 100 * intersection >= threshold * union. A text without words has the
empty set and no links. Rows with a null id are never linked: their component is null and they are
kept. Rows with the same id and text share a component; other texts under the same id are documents of their own. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.texts import arrow_schema, let_go, slices
from tallyflow.runtime import Scratch, skew_join

TREES, DEPTH = 16, 8
LEVELS = (4, 5, 6, 8, 12, 16, 24, 32, 64, TREES * DEPTH)  # depths of a region, in bytes of the label
REGION = 256  # rows before it that a row is compared with, and the most that a region holds if its depth can grow
GROUP = 256  # rows of a group whose full sets are compared at once
WHOLE = 4_096  # rows of a group that is compared whole, in blocks
COLUMNS = 4096  # shingles counted at once
POSTINGS = 2_048  # rows under one shingle that are compared at once
COUNTERS = 1 << 18  # of the sketch that orders shingles by frequency
ROWS_A_TASK = 500_000  # rows of the forest, 150 bytes each
FILTER_BITS = 26  # a filter of keys has 2^26 bits at most: 8 MB in a worker
MARGIN = 0.13  # about four standard deviations of the estimate from 128 minima

_random = np.random.default_rng(20240501)
MULTIPLIERS = _random.integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _random.integers(0, 1 << 62, TREES * DEPTH, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of each text of an Arrow column."""

    def __init__(self, width: int, cached: int = 300_000):
        self.width, self.cached, self.known = width, cached, {}

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
        flat = split.flatten().dictionary_encode()
        words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(words) > self.cached:
            self.known.clear()
        known, hashes = self.known, np.empty(len(words), np.uint64)
        for k, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashes[k] = h
        empty = words.index("") if "" in words else -1
        codes = flat.indices.to_numpy()
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        real = codes != empty
        ends = np.concatenate([[0], np.cumsum(real)])[np.cumsum(counts)]
        h = hashes[codes[real]]
        n = self.width
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(h) - n + 1), np.uint64)
            for k in range(n):
                rolled = mixed(rolled + h[k : len(h) - n + 1 + k]) if len(rolled) else rolled
        start = 0
        for stop in ends.tolist():
            if stop - start >= n:
                yield np.unique(rolled[start : stop - n + 1])
            elif stop > start:  # fewer words than a shingle has: the whole sequence is the one element
                one = np.full(1, stop - start, np.uint64)
                for k in range(start, stop):
                    one = mixed(one + h[k : k + 1])
                yield one
            else:
                yield np.empty(0, np.uint64)
            start = stop


def signature(shingles: np.ndarray, block: int = 1024) -> bytes:
    """Low bytes of the minima under each hash function."""
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), block):  # bounded memory for very long texts
            h = MULTIPLIERS[:, None] * shingles[None, at : at + block] + OFFSETS[:, None]
            least = np.minimum(least, h.min(axis=1))
    return mixed(least).astype(np.uint8).tobytes()


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles binary): sorted 64-bit hashes."""
    st, schema = arrow_schema("doc_id long, shingles binary")

    def run(batches):
        let_go()
        shingler = Shingler(width)
        for part in slices(batches, "text"):
            found = [s.tobytes() for s in shingler.sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, st)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest, signature); digest and signature are null for an empty set."""
    st, schema = arrow_schema("doc_id long, text_key string, n_shingles long, digest string, signature binary")

    def run(batches):
        let_go()
        shingler = Shingler(width)
        for part in slices(batches, "text"):
            n, digest, signed = [], [], []
            for s in shingler.sets(part.column("text")):
                n.append(len(s))
                digest.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                signed.append(signature(s) if len(s) else None)
            columns = [*map(part.column, ("doc_id", "text_key")), *(pa.array(c, f.type) for c, f in zip((n, digest, signed), list(schema)[2:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, st)


def key_filter(keys: DataFrame, *cols: str) -> Callable[..., Column]:
    """Predicate on as many columns: true for the values of ``cols`` in ``keys``, and for few others (a Bloom filter of 16 bits a key, less selective beyond
    four million keys). What it refuses is in ``keys`` for certain not, and need not be moved to be joined; what it lets pass is joined as ever."""
    bits = 1 << min(FILTER_BITS, max(16, (16 * keys.count()).bit_length()))

    def places(key: Column) -> Column:
        return F.array(key.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(bits - 1)))

    placed = keys.select(F.explode(places(F.xxhash64(*cols))).alias("place"))
    words = placed.groupBy(F.expr("place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("set")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("set").to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def held(key: pa.Array) -> pa.Array:
        h = key.to_numpy(zero_copy_only=False).view(np.uint64)
        found = np.ones(len(h), bool)
        for place in (h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)):
            found &= (shared.value.view(np.uint64)[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pa.array(found)

    return lambda *values: held(F.xxhash64(*values))


def agreement(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of signatures, corrected for bytes that agree by chance."""
    same = (rows == row).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


class Walk:
    """A region's rows in the order of their labels, each compared with the ``most`` rows before it."""

    def __init__(self, threshold: float, most: int):
        self.least, self.most = threshold - MARGIN, most
        self.start()

    def start(self) -> None:
        self.ids: list[int] = []
        self.signed = np.empty((2 * self.most, TREES * DEPTH), np.uint8)
        self.label = np.empty(2 * self.most, np.int64)  # rows that near pairs join have one label
        self.n = 0

    def take(self, doc_id: int, row: np.ndarray) -> Iterator[tuple[int, int]]:
        """Near pairs of the row, the likest one of each group that it joins."""
        if self.n == len(self.signed):  # what lies further back has no say any more
            self.ids = self.ids[self.most :]
            self.signed[: self.most], self.label[: self.most] = self.signed[self.most :], self.label[self.most :]
            self.n = self.most
        low, here = max(0, self.n - self.most), self.n
        likeness = agreement(self.signed[low:here], row) if here > low else np.empty(0)
        near = np.flatnonzero(likeness >= self.least)
        self.ids.append(doc_id)
        self.signed[here], self.label[here] = row, doc_id
        self.n += 1
        if len(near):
            near = near[np.argsort(-likeness[near], kind="stable")]
            others, at = np.unique(self.label[low:here][near], return_index=True)
            for j in near[at].tolist():
                yield self.ids[low + j], doc_id
            self.label[:here][np.isin(self.label[:here], others)] = doc_id


def forest_rows(representatives: DataFrame) -> DataFrame:
    """(doc_id, tree, label) of each representative in each tree."""
    trees = F.array(*(
        F.struct(
            F.lit(t).cast("byte").alias("tree"),
            F.concat(F.substring("signature", t * DEPTH + 1, (TREES - t) * DEPTH), F.substring("signature", 1, t * DEPTH)).alias("label"),
        )
        for t in range(TREES)
    ))
    return representatives.select("doc_id", F.explode(trees).alias("r")).select("doc_id", "r.tree", "r.label")


def prefix_of(depth: int) -> Column:
    return F.substring("label", 1, depth)


def prefix_counts(rows: DataFrame, depth: int) -> DataFrame:
    return rows.groupBy("tree", prefix_of(depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def shared_rows(forest: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows that share a prefix of ``LEVELS[0]`` bytes with another one (and a few that do not), and the number of rows (tree, prefix, n) under each
    shared prefix. A row without company has nothing to be compared with: its label is not moved, only its prefix is counted."""
    counts = scratch.save(prefix_counts(forest, LEVELS[0]).filter("n > 1"), "shared")
    return forest.filter(key_filter(counts, "tree", "prefix")(F.col("tree"), prefix_of(LEVELS[0]))), counts


def split_prefixes(forest: DataFrame, scratch: Scratch, most: int, counted: DataFrame | None = None) -> tuple[list[DataFrame], DataFrame | None]:
    """For each level the prefixes (tree, prefix) that more than ``most`` rows share, and the rows of the first of them as a table: only
    these are looked at again. ``counted`` has the rows (tree, prefix, n) of the first level, if they are counted already."""
    found: list[DataFrame] = []
    rows, inside = forest, None
    for depth in LEVELS[:-1]:
        counts = counted if counted is not None and not found else prefix_counts(rows, depth)
        crowded, n = scratch.save_counted(counts.filter(F.col("n") > most).select("tree", "prefix"), f"split-{depth}")
        if not n:
            break
        found.append(crowded)
        rows = rows.withColumn("prefix", prefix_of(depth)).join(crowded, ["tree", "prefix"], "left_semi").drop("prefix")
        if inside is None:
            rows = inside = scratch.save(rows, "inside")
    return found, inside


def with_regions(rows: DataFrame, splits: list[DataFrame]) -> DataFrame:
    """Adds ``region`` to rows of split regions: the shortest prefix, of the levels' depths, that is not split."""
    region = prefix_of(LEVELS[len(splits)])
    for k in range(len(splits) - 1, 0, -1):
        crowded = splits[k].withColumn(f"_split{k}", F.lit(True))
        rows = rows.withColumn("prefix", prefix_of(LEVELS[k])).join(crowded, ["tree", "prefix"], "left").drop("prefix")
        region = F.when(F.col(f"_split{k}"), region).otherwise(prefix_of(LEVELS[k]))
    return rows.withColumn("region", region).drop(*(f"_split{k}" for k in range(1, len(splits))))


def parts_of_splits(rows: DataFrame, splits: list[DataFrame]) -> list[DataFrame]:
    """One row, the first, of each part of a split region, under the region's prefix."""
    out = []
    for k, crowded in enumerate(splits):
        inside = rows.withColumn("prefix", prefix_of(LEVELS[k])).join(crowded, ["tree", "prefix"], "left_semi")
        first = inside.groupBy("tree", "prefix", prefix_of(LEVELS[k + 1]).alias("part")).agg(F.min(F.struct("label", "doc_id")).alias("r"))
        out.append(first.select("r.doc_id", "tree", "r.label", F.concat(F.lit(bytearray([LEVELS[k]])), "prefix").alias("region"), F.lit(True).alias("stands")))
    return out


def forest_pairs(representatives: DataFrame, threshold: float, region: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs (a < b) of (doc_id, signature) rows from all trees, and the rows (doc_id, tree, prefix) of regions that were split."""
    most = region or REGION
    scratch = Scratch(representatives.sparkSession, "forest")
    st, schema = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, mark = Walk(threshold, most), None
        pairs: list[tuple[int, int]] = []

        def packed() -> pa.RecordBatch:
            low, high = (np.array([f(p) for p in pairs], np.int64) for f in (min, max))
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], schema=schema)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, tree, stands = (batch.column(c).to_pylist() for c in ("doc_id", "tree", "stands"))
            regions, labels = batch.column("region").to_pylist(), batch.column("label").to_pylist()
            keys = list(zip(tree, stands, regions, strict=True))
            for k in range(n):
                if keys[k] != mark:
                    alone = k + 1 < n and keys[k + 1] != keys[k]  # a region of one row has nothing to compare
                    mark = keys[k]
                    if alone:
                        mark = None
                        continue
                    walk.start()
                pairs.extend(walk.take(ids[k], np.frombuffer(labels[k], np.uint8)))
            if len(pairs) > 50_000:
                yield packed()
        if pairs:
            yield packed()

    forest, counts = shared_rows(forest_rows(representatives), scratch)
    splits, inside = split_prefixes(forest, scratch, most, counts)
    place = ("tree", "stands", "region")
    columns = ["doc_id", "tree", "label", "region", F.lit(False).alias("stands")]
    plain = forest.withColumn("prefix", prefix_of(LEVELS[0])).withColumn("region", F.col("prefix"))
    if splits:
        plain = plain.join(splits[0], ["tree", "prefix"], "left_anti")
    rows = plain.select(*columns)
    if splits:
        rows = rows.unionByName(with_regions(inside, splits).select(*columns))
        for part in parts_of_splits(inside, splits):
            rows = rows.unionByName(part)
    parts = -(-representatives.count() * TREES // ROWS_A_TASK)
    parts = max(parts, int(representatives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, *place).sortWithinPartitions(*place, "label", "doc_id")
    pairs = ordered.select("doc_id", "tree", "label", "region", "stands").mapInArrow(run, st).distinct()
    if not splits:
        return pairs, None
    return pairs, inside.select("doc_id", "tree", prefix_of(LEVELS[0]).alias("prefix"))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) of ``wanted`` (node), numbers of ``nodes``."""
    scratch = Scratch(docs.sparkSession, "shingles")
    # merge joins at every size: what is a broadcast for a small table is none for a large one
    wanted = scratch.save(nodes.join(wanted.hint("merge"), "node").select("node", F.col("first").alias("doc_id"), "text_key"), "wanted")
    asked = docs.filter(key_filter(wanted, "doc_id", "text_key")("doc_id", "text_key"))  # other texts stay where they are
    texts = asked.join(wanted.hint("merge"), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    return scratch.save(shingle_sets(texts.select(F.col("node").alias("doc_id"), "text"), width))


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full shingle sets are alike enough."""
    st, schema = arrow_schema("a long, b long")
    sides = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")).hint("merge"), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")).hint("merge"), "b"
    )

    def run(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema=schema)

    return sides.select("a", "b", "left", "right").mapInArrow(run, st)


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over links (a, b), for every id with a link.

    Each round hooks every label to the smallest label beside it and halves the chains of labels; the tables of a round
    are written below ``spark.checkpoint.dir``, so that lineage stays short. The number of rounds grows with the logarithm of the diameter. What is
    looked up by label has one row a label and is written first: where Spark finds it small no row moves, else hot labels are split."""
    scratch = Scratch(links.sparkSession, "components")
    edges = scratch.save(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct())
    labels = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"))
    labels = scratch.save(labels)
    while True:
        # smallest label among the neighbours of all members of a label
        near = skew_join(edges, labels.select(F.col("id").alias("b"), F.col("component").alias("other")), ["b"]).groupBy("a").agg(F.min("other").alias("other"))
        seen = scratch.save(labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "component", F.least("component", "other").alias("other")))
        hook = scratch.save(seen.groupBy("component").agg(F.min("other").alias("to")))
        moved = skew_join(seen, hook, ["component"]).select("id", F.col("component").alias("was"), F.least("to", "other").alias("component"))
        moved = scratch.save(moved)
        # one jump: the label of the label
        used = moved.select(F.col("component").alias("id")).distinct()
        jump = scratch.save(moved.join(used, "id", "left_semi").select(F.col("id").alias("component"), F.col("component").alias("to")))
        stepped = skew_join(moved, jump, ["component"], "left").select("id", "was", F.least("component", F.coalesce("to", "component")).alias("component"))
        new, changed = scratch.save_counted(stepped, "labels", F.col("was") != F.col("component"))
        if not changed:
            return new.select("id", "component")
        labels = new.select("id", "component")


def frequencies(sets: DataFrame) -> np.ndarray:
    """A sketch of how many sets hold a shingle: counters by the shingle's low bits, summed in the tasks, then by a few tasks, then here."""
    st, schema = arrow_schema("counts binary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for s in batch.column("shingles"):
                np.add.at(total, np.frombuffer(s.as_buffer(), np.uint64).astype(np.int64) & (COUNTERS - 1), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for c in batch.column("counts"):
                total += np.frombuffer(c.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=schema)

    rows = sets.select("shingles").mapInArrow(count, st).repartition(4).mapInArrow(add, st).collect()  # four sketches of 2 MB
    return sum((np.frombuffer(r["counts"], np.int64) for r in rows), np.zeros(COUNTERS, np.int64))


def rare_postings(sets: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, shingle): the rarest shingles of each set, of which two sets that are alike enough share one."""
    st, schema = arrow_schema("doc_id long, shingle long")
    often = sets.sparkSession.sparkContext.broadcast(frequencies(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), batch.column("shingles"), strict=True):
                h = np.frombuffer(s.as_buffer(), np.uint64)
                n = len(h) - -(-threshold * len(h) // 100) + 1
                order = np.lexsort((h, often.value[h.astype(np.int64) & (COUNTERS - 1)]))[:n]
                found.append(h[order].view(np.int64))
                ids.append(np.full(len(order), doc_id, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found))], schema=schema)

    return sets.select("doc_id", "shingles").mapInArrow(run, st)


def in_blocks(rows: DataFrame, blocks: Column, key: str = "doc_id") -> DataFrame:
    """Each row once for each pair of ``blocks`` blocks that has its own, with the number of the pair as ``block``."""
    mine = F.pmod(F.xxhash64(key), blocks)
    pair = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.least(k, mine) * blocks + F.greatest(k, mine))
    return rows.withColumn("block", F.explode(pair))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each two of the sets."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1  # what only one set has is common to none
    row, code = row[often[code]], (np.cumsum(often) - 1)[code[often[code]]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    both, columns = np.zeros((len(sets), len(sets))), int(often.sum())
    for at in range(0, columns, COLUMNS):  # bounded memory for very long texts
        start, stop = np.searchsorted(code, [at, at + COLUMNS])
        has = np.zeros((len(sets), min(COLUMNS, columns - at)), np.float32)
        has[row[start:stop], code[start:stop] - at] = 1
        both += has @ has.T
    return both.astype(np.int64)


def group_links(ids: np.ndarray, apart: np.ndarray, sets: list[np.ndarray], threshold: int) -> Iterator[tuple[int, int]]:
    """Links (a < b) that join all components ``apart`` of the rows which links between the rows join."""
    both, size = shared_counts(sets), np.array([len(s) for s in sets])
    link = 100 * both >= threshold * (size[:, None] + size[None, :] - both)
    label = np.unique(apart, return_inverse=True)[1]
    for i in range(1, len(ids)):
        near = np.flatnonzero(link[i, :i] & (label[:i] != label[i]))
        others, at = np.unique(label[near], return_index=True)
        for j in near[at].tolist():
            yield min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))
        label[np.isin(label, others)] = label[i]


def group_pairs(rows: DataFrame, sets: DataFrame, threshold: int, group: int | None = None) -> DataFrame:
    """Links between components (``apart``) of the rows (doc_id, group, apart, n) of groups of at most ``WHOLE`` rows, from all pairs of a group:
    a row meets the blocks of its group, ``WHOLE / GROUP`` at most."""
    most = group or GROUP
    st, schema = arrow_schema("a long, b long")
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / most)).join(sets.hint("merge"), "doc_id")
    rows = in_blocks(rows, F.col("blocks")).select("group", "block", "doc_id", "apart", "shingles")

    def run(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        new = list(group_links(*(table.column(c).to_numpy() for c in ("doc_id", "apart")), found, threshold))
        return pa.Table.from_arrays([pa.array([x[k] for x in new], pa.int64()) for k in (0, 1)], schema=schema)

    return rows.groupBy("group", "block").applyInArrow(run, st).distinct()


def apart_pairs(ids: np.ndarray, apart: np.ndarray, signed: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """All pairs (a < b) of rows of different components whose signatures are near."""
    for i in range(1, len(ids)):
        other = np.flatnonzero(apart[:i] != apart[i])
        if len(other):
            for j in other[agreement(signed[other], signed[i]) >= threshold - MARGIN].tolist():
                yield min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))


def missing_pairs(postings: DataFrame, rows: DataFrame, nodes: DataFrame, threshold: int, most: int = POSTINGS) -> DataFrame:
    """Candidate pairs of rows (doc_id, apart) that are ``apart``: all that share one of their rarest shingles (``postings``) and have near signatures."""
    scratch = Scratch(rows.sparkSession, "rare")
    st, schema = arrow_schema("a long, b long")
    listed = scratch.save(postings.join(rows, "doc_id"), "listed")
    lists = listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("apart").alias("low"), F.max("apart").alias("high")).filter("low < high")
    lists = scratch.save(lists.select("shingle", F.ceil(F.col("n") / most).alias("blocks")), "lists")
    met = skew_join(listed, lists, ["shingle"]).join(nodes.select(F.col("node").alias("doc_id"), "signature"), "doc_id")
    met = in_blocks(met, F.col("blocks")).select("shingle", "block", "doc_id", "apart", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, ids, apart, signed = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            sides = np.frombuffer(b"".join(signed), np.uint8).reshape(len(ids), -1)
            for found in batched(apart_pairs(np.array(ids, np.int64), np.array(apart, np.int64), sides, threshold / 100), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            for shingle, block, doc_id, component, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shingle, block) != mark:
                    if len(ids) > 1:
                        yield from close()
                    for side in (ids, apart, signed):
                        side.clear()
                    mark = (shingle, block)
                ids.append(doc_id)
                apart.append(component)
                signed.append(s)
        if len(ids) > 1:
            yield from close()

    return met.repartition("shingle", "block").sortWithinPartitions("shingle", "block", "doc_id").mapInArrow(run, st).distinct()


def all_links(pairs: DataFrame, crowd: DataFrame | None, sets: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """Links from the candidates, and from looks at what they leave apart (step 5)."""
    scratch = Scratch(pairs.sparkSession, "links")
    links = scratch.save(confirmed(pairs, sets, threshold), "first")
    own = components(links).select(F.col("id").alias("doc_id"), F.col("component").alias("apart"))
    rows = components(pairs).select(F.col("id").alias("doc_id"), F.col("component").alias("group"))
    rows = scratch.save(rows.join(own, "doc_id", "left").withColumn("apart", F.coalesce("apart", "doc_id")), "grouped")
    sizes = scratch.save(rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), (F.min("apart") < F.max("apart")).alias("split")), "sizes")
    rows = scratch.save(skew_join(rows, sizes, ["group"]), "sized")
    found = scratch.save(group_pairs(rows.filter((F.col("n") <= WHOLE) & F.col("split")).drop("split"), sets, threshold), "groups")
    links = links.unionByName(found)
    # groups that were compared whole are settled: only what lies between them, or in larger ones, is left
    label = F.when(F.col("n") <= WHOLE, F.col("group")).otherwise(F.col("apart"))
    rest = rows.filter((F.col("n") > WHOLE) & F.col("split")).select("doc_id", "apart")
    if crowd is not None:
        inside = crowd.join(rows.select("doc_id", label.alias("apart")), "doc_id", "left").withColumn("apart", F.coalesce("apart", "doc_id"))
        inside = scratch.save(inside, "crowd")
        mixed_ = inside.groupBy("tree", "prefix").agg(F.min("apart").alias("low"), F.max("apart").alias("high")).filter("low < high").select("tree", "prefix")
        rest = rest.unionByName(skew_join(inside, scratch.save(mixed_, "mixed"), ["tree", "prefix"], "left_semi").select("doc_id", "apart"))
    rest, n = scratch.save_counted(rest.distinct(), "rest")
    if not n:
        return links
    mine = scratch.save(sets.join(rest.select("doc_id").distinct(), "doc_id", "left_semi"), "sets")
    near = scratch.save(missing_pairs(rare_postings(mine, threshold), rest, nodes, threshold), "near")
    return links.unionByName(confirmed(near, sets, threshold))


def judged(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) of each row; ``text_key`` is the digest of the text."""
    scratch = Scratch(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_key"), "text")
    signed = scratch.save(signatures(docs, width))
    real = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
    full = signed.filter(real)
    groups = full.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("k"), F.first("signature").alias("signature"))
    nodes = groups.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("k.doc_id").alias("first"), "k.text_key", "signature")
    nodes = scratch.save(nodes)
    pairs, crowd = forest_pairs(nodes.select(F.col("node").alias("doc_id"), "signature"), threshold / 100)
    pairs = scratch.save(pairs)
    ends = ends_of(pairs)
    if crowd is not None:
        crowd = scratch.save(crowd)
        ends = ends.unionByName(crowd.select(F.col("doc_id").alias("node"))).distinct()
    sets = sets_of(ends, nodes, docs, width)
    linked = components(scratch.save(all_links(pairs, crowd, sets, nodes, threshold)))
    # the smallest id leads a component; of its texts, one
    sides = scratch.save(nodes.select("node", "digest", "first").join(linked.withColumnRenamed("id", "node"), "node", "left"))
    lead = scratch.save(sides.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("first", "digest")).alias("lead")))
    sides = skew_join(sides, lead, ["component"], "left").select(
        "digest", F.coalesce("lead.first", "first").alias("component_id"), F.coalesce(F.col("lead.digest") == F.col("digest"), F.lit(True)).alias("leads")
    )
    names = ["doc_id", "text_key", "n_shingles", "component_id"]
    found = full.join(sides, "digest").select(*names, ((F.col("component_id") == F.col("doc_id")) & F.col("leads")).alias("kept"))
    rest = signed.filter(~real).withColumn("component_id", F.col("doc_id"))
    return found.unionByName(rest.select(*names, F.lit(True).alias("kept")))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    return judged(docs, width, threshold).drop("text_key")


def keep_one(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns, without the documents of a component but the one that leads it."""
    gone = judged(docs, width, threshold).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    gone = Scratch(docs.sparkSession, "dropped").save(gone)
    doc_id, text_key = F.col("doc_id").cast("long"), F.md5("text")
    maybe = key_filter(gone, "_id", "_key")(doc_id, text_key)
    left = docs.filter(maybe).join(gone, (doc_id == F.col("_id")) & (text_key == F.col("_key")), "left_anti")
    return docs.filter(~maybe).unionByName(left.select(*docs.columns))
