"""Quality rules and an isolation forest on their statistics.

Every text gets counts (words, symbols, repeated lines, repeated five-word windows); two base rules fail documents
outright. The forest isolates documents by random splits on the rates of these counts: anomalies need few
splits, so that their mean path is short. The forest is grown on ``TREES`` samples of ``SAMPLE`` rows each, chosen by a hash over the
whole table; every row is scored. The threshold is calibrated on labelled rows: it rejects as many bad ones as it can while a lost
good row costs ten times a kept bad one, and never more than ``MAX_LOSS`` of the good (without bad labels nothing is rejected by score).

A null or empty text has no words and fails the base rules. Repeated rows are scored one by one, further columns are not read; a
doc_id with several labels is good if one says so. Rows whose crc32(doc_id as text) is divisible by 5 are left out of the
calibration, so that it can be measured on them.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.texts import arrow_schema, map_rows, slices, words_of
from tallyflow.llm.toxicity import held_out
from tallyflow.runtime import Scratch

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words
TREES, SAMPLE = 64, 256
MAX_LOSS = 0.01  # share of the good labelled rows
LOSS_WEIGHT = 10
STEPS = 1000  # scores are calibrated in thousandths
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RATES = ("symbols_a_word", "symbols_a_letter", "symbols_a_line", "repeated", "word_length")
USUAL_LENGTH = 5.5  # code points a word; short texts are drawn to it


def rule_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, lines, repeated lines, words in repeated windows)."""
    text = text or ""
    words = words_of(text)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x and not x.isspace() or words_of(x)]
    repeated = 0
    grams = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(grams)) < len(grams):
        often, reach = Counter(grams), 0
        for k, g in enumerate(grams):
            if often[g] > 1:
                repeated += k + WINDOW - max(reach, k)
                reach = k + WINDOW
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), repeated


def rule_statistics(docs: DataFrame) -> DataFrame:
    def make():
        return lambda doc_id, text: ((doc_id, *rule_counts(text)),)

    return map_rows(
        docs, ["doc_id", "text"], make,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long",
    )


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rate_values(n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) -> tuple:
    """Rates of the counts (columns or numbers), damped so that a short text is not odd by its shortness alone."""
    return (
        n_symbols / (n_words + 20),
        n_symbols / (word_chars + 100),
        n_symbols / (n_lines + 3),
        n_repeat_words / (n_words + 50),
        (word_chars + 50 * USUAL_LENGTH) / (n_words + 50),
    )


def rates() -> list:
    values = rate_values(*map(F.col, COUNTS))
    return [v.alias(name) for v, name in zip(values, RATES, strict=True)]


def mean_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary search tree of n values."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Trees as arrays: split column (or -1), split value, children, path length at leaves."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7):
        random = np.random.default_rng(seed)
        self.norm = mean_path(min(sample, max(2, len(rows)))) or 1.0
        limit = math.ceil(math.log2(max(2, sample)))
        self.trees = []
        for t in range(trees):
            # every tree has rows of its own; a small table gives each tree a draw from all of it
            part = rows[t::trees] if len(rows) >= trees * sample else rows[random.choice(len(rows), min(sample, len(rows)), replace=False)]
            nodes: list[list[float]] = []  # column, value, left, right, path

            def grow(x: np.ndarray, depth: int) -> int:
                at = len(nodes)
                nodes.append([-1, 0.0, 0, 0, depth + mean_path(len(x))])
                low, high = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(1), np.zeros(1))
                columns = np.flatnonzero(high > low)
                if depth < limit and len(x) > 1 and len(columns):
                    c = int(random.choice(columns))
                    v = float(random.uniform(low[c], high[c]))
                    nodes[at][:2] = [c, v]
                    nodes[at][2] = grow(x[x[:, c] <= v], depth + 1)
                    nodes[at][3] = grow(x[x[:, c] > v], depth + 1)
                return at

            grow(part, 0)
            self.trees.append(np.array(nodes))
        self.depth = limit

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / mean path of a random tree): near 1 for anomalies."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for nodes in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                column = nodes[at, 0].astype(np.int64)
                left = rows[every, np.maximum(column, 0)] <= nodes[at, 1]
                at = np.where(column < 0, at, np.where(left, nodes[at, 2], nodes[at, 3]).astype(np.int64))
            total += nodes[at, 4]
        return 2.0 ** -(total / len(self.trees) / self.norm)


def grow_forest(stats: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> IsolationForest | None:
    """Forest on ``trees * sample`` rows of the whole table, chosen by hash; None for an empty table."""
    spread = F.xxhash64("doc_id", "n_words", "word_chars")
    chosen = stats.orderBy(spread, "doc_id").limit(trees * sample).select(*rates()).collect()
    return IsolationForest(np.array(chosen, float), trees, sample) if chosen else None


def thousandths(scores: np.ndarray) -> np.ndarray:
    return np.round(scores * STEPS).astype(np.int32)


def anomaly_scores(stats: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """``stats`` with ``anomaly``, in whole thousandths."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    kept = stats.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema)
    st, schema = arrow_schema(f"{ddl}, anomaly int")

    def run(batches):
        for batch in batches:
            rows = np.stack([batch.column(r).to_numpy() for r in RATES], axis=1)
            score = thousandths(shared.value.scores(rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], schema=schema)

    return stats.select("*", *rates()).mapInArrow(run, st)


def calibrated_threshold(scored: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS) -> int:
    """Score (thousandths) above which documents are rejected: of those that lose at most ``max_loss`` of the good labelled
    rows, the one with the least share of bad rows kept, where a lost good row weighs ``LOSS_WEIGHT`` times as much."""
    told = labels.filter(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = scored.filter(~base_failed()).join(told, "doc_id").groupBy("anomaly").agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")
    )
    rows = sorted(((r["anomaly"], r["good"], r["bad"]) for r in counts.collect()), reverse=True)  # at most STEPS rows
    good, bad = max(1, sum(r[1] for r in rows)), max(1, sum(r[2] for r in rows))
    threshold, least, lost, caught = STEPS, 1.0, 0, 0
    for score, g, b in rows:
        lost, caught = lost + g, caught + b
        if lost > max_loss * good:
            break
        cost = LOSS_WEIGHT * lost / good + 1 - caught / bad
        if cost < least:
            threshold, least = score - 1, cost
    return threshold


def fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, IsolationForest | None, int]:
    """(counts and anomaly of every row, forest, threshold)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats = Scratch(docs.sparkSession, "rules").save(rule_statistics(docs))
    forest = grow_forest(stats)
    scored = anomaly_scores(stats, forest)
    return scored, forest, calibrated_threshold(scored, labels)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, counts, anomaly, base_failed, kept) of every row."""
    scored, _, threshold = fit(docs, labels)
    return scored.select(
        "*", base_failed().alias("base_failed"), (~base_failed() & (F.col("anomaly") <= threshold)).alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that pass; judged where they are, nothing is shuffled."""
    _, forest, threshold = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for part in slices(batches, "text"):
            counts = np.array([rule_counts(t) for t in part.column("text").to_pylist()], float).reshape(-1, len(COUNTS)).T
            score = thousandths(shared.value.scores(np.stack(rate_values(*counts), axis=1)))
            failed = (counts[0] < LEAST_WORDS) | (100 * counts[5] > MOST_REPEATED * counts[0])
            yield part.filter(pa.array(~failed & (score <= threshold)))

    return docs.mapInArrow(run, docs.schema)
