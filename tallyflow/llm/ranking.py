"""Ranked lexical search: the best documents of every item, by an exact dual-tree search.

An item is a sparse vector of term weights, a document one of term scores; the score of a pair is their product. Both sides stand in
hierarchies: items in groups of 8, 64 and 512 that share their commonest terms, the documents of a batch in leaves of 16 and in groups of 128 and
1 024 that share their heaviest term. A node holds the largest value of each coordinate below it, so that the product of two nodes bounds every pair
below them. Both trees are walked together: a pair of nodes whose bound is less than the weakest k-th score of the items below it is left
out, with all its pairs. All values are 64-bit integers, so that nothing is lost by rounding.

* One pass turns texts into rows of numbered terms (a written table); every task also writes what it counted (documents, terms, documents
  of each term), so that corpus statistics need no second look at the texts.
* Rows whose id's CRC is divisible by 64 are searched first. The k-th scores found there hold for all rows, as lower bounds: they go to
  the tasks of the second search, which looks at every row and therefore drops most node pairs early.
* Tasks return their best rows of every item; the best of these are the result.

Items are searched in batches of ``ITEM_BYTES`` of text (at least one item), which is what goes to every task. Null and empty item texts match nothing; repeated
items are answered each. Documents with null or empty text have no term and no rank. Equal scores are ordered by ascending doc_id, null ids
last; repeated rows are ranked each. Further columns of either table are kept out. No item or no document: no row.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.texts import arrow_schema, slices
from tallyflow.runtime import Scratch, union_all

BEST = 20
ITEM_BYTES = 1 << 20
FANOUT = 8
LEAF, MIDDLE, BATCH = 16, 128, 1024
FIRST_LOOK = 64  # one row in so many is searched first
NO_ID = 1 << 63  # after all ids
_SPACES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII, with A-Z in lower case, of a text in UTF-8."""
    return text.translate(_SPACES).split()


def weight(n_docs: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency + 1)))


class Items:
    """A batch of items: their terms, numbered, and how often each occurs in each item."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in rows]
        self.counts = [Counter(terms_of((t or "").encode())) for _, t in rows]
        self.number = {t: k for k, t in enumerate(sorted(set().union(*self.counts)))}


def batches(items: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """Items, ordered by id and text, in lists of at most ``ITEM_BYTES`` of text; one list at a time is held."""
    part, size = [], 0
    for r in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len((r["text"] or "").encode())
        if part and size + n > ITEM_BYTES:
            yield part
            part, size = [], 0
        part.append((r["item_id"], r["text"]))
        size += n
    if part:
        yield part


FORWARD = "counted boolean, doc_id long, n_terms long, terms array<int>, counts array<long>"


def forward_index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """A row (doc_id, n_terms, terms, counts) for each document with a term of ``number``, and for each task a row
    ``counted`` = true with the documents that have a term at all as doc_id, all their terms as n_terms, and the documents of each term."""
    st, arrow = arrow_schema(FORWARD)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = total = 0
        frequency: Counter[int] = Counter()
        get = number.get

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for whole in parts:
            for part in slices(iter([whole]), "text"):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    terms = terms_of(text or b"")
                    if not terms:
                        continue
                    n_docs, total = n_docs + 1, total + len(terms)
                    counts = Counter(map(get, terms))
                    counts.pop(None, None)
                    if counts:
                        frequency.update(counts.keys())
                        rows.append((False, doc_id, len(terms), list(counts), list(counts.values())))
                if rows:
                    yield packed(rows)
        yield packed([(True, n_docs, total, list(frequency), list(frequency.values()))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, st)


class ItemTree:
    """Levels of nodes over the items, finest first; a level is a list of terms and values, cut at ``starts``.

    Items stand ordered by their terms from the commonest in the corpus to the rarest, so that neighbours share terms."""

    def __init__(self, items: Items, n_docs: int, n_terms: int, frequency: dict[int, int]):
        df = [frequency.get(k, 0) for k in range(len(items.number))]
        weights = [weight(n_docs, n) for n in df]
        vectors = []
        for place, counts in enumerate(items.counts):
            vector = {items.number[t]: n * weights[items.number[t]] for t, n in counts.items()}
            vector = {t: v for t, v in vector.items() if df[t] and v}
            if vector:
                vectors.append((sorted(vector, key=lambda t: (-df[t], t)), place, vector))
        vectors.sort(key=lambda x: x[:2])
        self.places = [place for _, place, _ in vectors]  # of the batch
        self.n_docs, self.n_terms, self.n_coordinates = n_docs, n_terms, len(df)
        self.best = np.zeros(len(df), np.int64)  # largest weight of each term
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        nodes = [v for _, _, v in vectors]
        while nodes:
            sizes = [len(v) for v in nodes]
            self.levels.append(
                (
                    np.concatenate([np.fromiter(v.keys(), np.int64, len(v)) for v in nodes]),
                    np.concatenate([np.fromiter(v.values(), np.int64, len(v)) for v in nodes]),
                    np.concatenate([[0], np.cumsum(sizes)]),
                )
            )
            for v in nodes if len(self.levels) == 1 else ():
                for t, x in v.items():
                    self.best[t] = max(self.best[t], x)
            if len(self.levels) == 4:
                break
            grouped = []
            for at in range(0, len(nodes), FANOUT):
                top: dict[int, int] = {}
                for v in nodes[at : at + FANOUT]:
                    for t, x in v.items():
                        top[t] = max(x, top.get(t, 0))
                grouped.append(top)
            nodes = grouped

    def products(self, level: int, nodes: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Products of ``nodes`` of a level with each column of (coordinates, columns)."""
        terms, values, starts = self.levels[level]
        lengths = starts[nodes + 1] - starts[nodes]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(starts[nodes] - (ends - lengths), lengths)
        return np.add.reduceat(columns[terms[at]] * values[at][:, None], ends - lengths, axis=0)


class Search:
    """Walks the item tree against one batch of documents after another and keeps the best of each item."""

    def __init__(self, tree: ItemTree, known: np.ndarray | None = None, best: int = BEST):
        self.tree, self.best = tree, best
        n = len(tree.places)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.least = np.maximum(1, known if known is not None else np.ones(n, np.int64))  # lower scores are of no use

    def weakest(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """Weakest k-th score of the items below each node."""
        width = FANOUT**level
        starts = nodes * width
        return np.array([self.least[s : s + width].min() for s in starts]) if width > 1 else self.least[nodes]

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The nodes of the next finer level below ``nodes``."""
        children = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return children[children < len(self.tree.levels[level - 1][2]) - 1]

    def documents(self, ids: list[int], n_terms: np.ndarray, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """One batch: document k has ``terms`` and ``counts`` from starts[k] to starts[k + 1]."""
        tree = self.tree
        if not tree.levels or not len(ids):
            return
        owner = np.repeat(np.arange(len(ids)), np.diff(starts))
        length = 100 - 25 + (25 * n_terms * tree.n_docs) // tree.n_terms
        scores = (1_000_000_000 * counts) // (1000 * counts + 12 * length[owner])
        gain = scores * tree.best[terms]
        heaviest = np.full(len(ids), -1, np.int64)
        order = np.lexsort((terms, gain, owner))
        last = np.flatnonzero(np.diff(owner[order], append=len(ids)))
        heaviest[owner[order[last]]] = terms[order[last]]
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((n_terms, heaviest))] = np.arange(len(ids))
        place = rank[owner]
        at_place = np.argsort(rank)
        n_leaves = -(-len(ids) // LEAF)
        leaves = np.zeros((tree.n_coordinates, n_leaves), np.int64)
        np.maximum.at(leaves, (terms, place // LEAF), scores)
        wide = MIDDLE // LEAF
        middles = np.maximum.reduceat(leaves, np.arange(0, n_leaves, wide), axis=1)
        root = middles.max(axis=1, keepdims=True)
        by_place = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by_place], np.arange(0, n_leaves + 1) * LEAF)
        block = np.zeros((tree.n_coordinates, LEAF), np.int64)

        top = len(tree.levels) - 1
        nodes = np.arange(len(tree.levels[top][2]) - 1)
        nodes = nodes[tree.products(top, nodes, root)[:, 0] >= self.weakest(top, nodes)]
        while top > 2 and len(nodes):
            nodes, top = self.below(top, nodes), top - 1
            nodes = nodes[tree.products(top, nodes, root)[:, 0] >= self.weakest(top, nodes)]
        for m in range(middles.shape[1]):
            level, active = top, nodes
            while len(active):
                active = active[tree.products(level, active, middles[:, m : m + 1])[:, 0] >= self.weakest(level, active)]
                if level == 0 or level == 1 or not len(active):
                    break
                active, level = self.below(level, active), level - 1
            for leaf in range(m * wide, min((m + 1) * wide, n_leaves)):
                found, at = active, level
                while len(found):
                    found = found[tree.products(at, found, leaves[:, leaf : leaf + 1])[:, 0] >= self.weakest(at, found)]
                    if at == 0 or not len(found):
                        break
                    found, at = self.below(at, found), at - 1
                if len(found):
                    rows = by_place[cuts[leaf] : cuts[leaf + 1]]
                    inside = place[rows] - leaf * LEAF
                    block[terms[rows], inside] = scores[rows]
                    self.take(found, tree.products(0, found, block), ids, at_place[leaf * LEAF : (leaf + 1) * LEAF])
                    block[terms[rows], inside] = 0

    def take(self, items: np.ndarray, scores: np.ndarray, ids: list[int], members: np.ndarray) -> None:
        for i, j in zip(*np.nonzero(scores >= self.least[items][:, None]), strict=True):
            if j >= len(members):
                continue
            item = int(items[i])
            heap, entry = self.heaps[item], (int(scores[i, j]), -ids[members[j]])
            if len(heap) < self.best:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.best:
                self.least[item] = max(self.least[item], heap[0][0])

    def found(self) -> Iterator[tuple[int, int | None, int]]:
        for place, heap in zip(self.tree.places, self.heaps, strict=True):
            for score, key in heap:
                yield place, None if -key == NO_ID else -key, score


PARTIAL = "place int, doc_id long, score long"


def search(rows: DataFrame, tree, known=None, best: int = BEST) -> DataFrame:
    """(place, doc_id, score): the best of each task's rows of the forward index; ``tree`` and ``known`` are broadcast variables."""
    st, arrow = arrow_schema(PARTIAL)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Search(tree.value, known.value if known is not None else None, best)
        for whole in parts:
            for at in range(0, whole.num_rows, BATCH):
                part = whole.slice(at, BATCH)
                terms, counts = part.column("terms"), part.column("counts")
                starts = np.concatenate([[0], np.cumsum(np.diff(terms.offsets.to_numpy()))])
                ids = [NO_ID if i is None else i for i in part.column("doc_id").to_pylist()]
                walk.documents(
                    ids, part.column("n_terms").to_numpy(), starts, terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy()
                )
        found = list(walk.found())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    return rows.select("doc_id", "n_terms", "terms", "counts").mapInArrow(run, st)


def best_rows(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def rank_documents(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents with a score above 0 of every item."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranking")
    out = []
    for rows in batches(items):
        batch = Items(rows)
        index = scratch.save(forward_index(docs, batch.number), "forward")
        counted, texts = index.filter("counted"), index.filter("NOT counted")
        n_docs, n_terms = counted.agg(F.sum("doc_id"), F.sum("n_terms")).first()
        pairs = counted.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n"))
        frequency = {r["terms"]: r["n"] for r in pairs.collect()}  # at most the terms of the batch
        if not n_docs:
            continue
        tree = ItemTree(batch, n_docs, n_terms, frequency)
        shared = spark.sparkContext.broadcast(tree)
        early = texts.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % FIRST_LOOK == 0)
        kth = best_rows(search(early, shared, best=best), best).filter(F.col("rank") == best).select("place", "score").collect()  # one row an item
        where = {place: k for k, place in enumerate(tree.places)}
        known = np.zeros(len(tree.places), np.int64)
        for r in kth:
            known[where[r["place"]]] = r["score"]
        partial = scratch.save(search(texts, shared, spark.sparkContext.broadcast(known), best), "partial")
        names = spark.createDataFrame(pa.table({"place": pa.array(range(len(rows)), pa.int32()), "item_id": pa.array(batch.ids, pa.int64())}))
        out.append(best_rows(partial, best).join(names, "place").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return union_all(out)
