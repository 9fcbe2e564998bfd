"""Toxicity from the nearest labelled examples.

* Terms are words and the 5-letter windows of words (with their borders), so that inflected forms of a
  stem meet. The terms that tell toxic examples from others (chi-square over a bounded sample of training rows) are
  the vocabulary; a term's inverse document frequency is counted over all documents.
* An example is a unit TF-IDF vector. ``BlockMaxIndex`` is an inverted index whose postings are cut into blocks of examples and carry
  each block's largest weight: blocks are scored in the order of their bounds until no bound reaches the k-th
  similarity, so that the k nearest are exact.
* Votes weighted by similarity squared are mapped to probabilities by a monotone fit over the examples, each left out of its own vote.

``MAX_EXAMPLES``, ``MAX_CANDIDATES`` and ``MAX_TERMS`` bound the classifier, which goes to every task; scoring covers every row and its whole
text. A text without vocabulary terms (null and empty ones too) gets the rate of toxic examples among
those without terms. Only ``label`` rows whose crc32(doc_id as text) is not divisible by 5 are learned; a doc_id with
several labels counts as toxic if one says so; without any usable label all scores are 0. Further columns of the documents are kept out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.texts import keep_rows, kept_in_worker, map_rows
from tallyflow.runtime import Scratch

MAX_EXAMPLES = 16_384
MAX_CANDIDATES = 32_768
MAX_TERMS = 2_048
LEAST_LIFT = 10  # times as frequent among toxic examples: what is common everywhere tells little
LEAST_CHI2 = 40.0  # of some 30 000 unrelated terms about none goes so far
NEIGHBOURS = 16
BLOCK = 64
PRIOR_MASS = 0.25
THRESHOLD = 0.5
CACHED_WORDS = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
GRAM = 5


def word_terms(chunk: str) -> set[str]:
    """Terms of the letter runs of a chunk: the run itself and its windows of five letters."""
    terms = set()
    for run in LETTERS.findall(chunk.lower()):
        terms.add("=" + run)
        framed = f"^{run}$"
        terms.update(framed[k : k + GRAM] for k in range(len(framed) - GRAM + 1))
    return terms


def held_out(col: str = "doc_id"):
    """Is the row kept for evaluation? A null id never is."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str = "toxic", most: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, label) of at most ``most`` training rows, chosen by the hash of their id."""
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def term_counts(texts: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """(term, n): number of texts with the term, summed in the tasks first."""

    def make():
        seen: Counter[str] = Counter()
        known: dict[str, tuple[str, ...]] = {}

        def row(text):
            terms: set[str] = set()
            for chunk in set((text or "").split()):
                got = known.get(chunk)
                if got is None:
                    got = word_terms(chunk)
                    got = tuple(got if wanted is None else got & wanted)
                    if len(known) < CACHED_WORDS // 4:
                        known[chunk] = got
                terms.update(got)
            seen.update(terms)
            return ()

        row.rest = seen.items
        return row

    return map_rows(texts, ["text"], make, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def choose_terms(examples: DataFrame) -> list[str]:
    """Terms over-represented among toxic examples, by chi-square."""
    sizes = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    least = max(2, toxic // 500)
    counts = term_counts(examples.filter("label = 1").select("text")).filter(F.col("n") >= least)
    positive = {r["term"]: r["n"] for r in counts.orderBy(F.desc("n"), "term").limit(MAX_CANDIDATES).collect()}
    negative = {r["term"]: r["n"] for r in term_counts(examples.filter("label = 0").select("text"), frozenset(positive)).collect()}
    scored = []
    for term, a in positive.items():
        b = negative.get(term, 0)
        c, d, n = toxic - a, clean - b, toxic + clean
        bottom = (a + b) * (c + d) * (a + c) * (b + d)
        chi2 = n * (a * d - b * c) ** 2 / bottom if bottom else 0.0
        if a * clean >= LEAST_LIFT * b * toxic and chi2 >= LEAST_CHI2:
            scored.append((-chi2, term))
    return [t for _, t in sorted(scored)[:MAX_TERMS]]


class TermCounter:
    """Numbers of the vocabulary terms in a text and how often each occurs."""

    def __init__(self, terms: list[str]):
        self.number = {t: k for k, t in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[list[int], list[int]]:
        counts: dict[int, int] = {}
        known, number = self.known, self.number
        chunks = (text or "").split()
        for chunk, got in zip(chunks, map(known.get, chunks), strict=True):
            if got is None:
                got = tuple(sorted(number[t] for t in word_terms(chunk) if t in number))
                if len(known) >= CACHED_WORDS:
                    known.clear()
                known[chunk] = got
            if got:
                for t in got:
                    counts[t] = counts.get(t, 0) + 1
        keys = sorted(counts)
        return keys, [counts[k] for k in keys]


def worker_counter(terms: list[str]) -> TermCounter:
    """The worker's counter: the words that it has met serve all tasks that the worker runs over these terms."""
    return kept_in_worker(("terms", *terms), lambda: TermCounter(terms))


def term_vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, terms, counts) of each row."""

    def make():
        counter = worker_counter(terms)
        return lambda doc_id, text: ((doc_id, *counter(text)),)

    return map_rows(docs, ["doc_id", "text"], make, "doc_id long, terms array<int>, counts array<int>")


class BlockMaxIndex:
    """Exact k nearest unit vectors by cosine.

    Examples that share their heaviest term stand together, in blocks. A block holds the postings of the terms that occur in it
    (a row of weights for each), and the index each block's largest weight of each term: their product with a query bounds
    the similarity of everything in the block."""

    def __init__(self, ids: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int], n_terms: int, block: int = BLOCK):
        order = sorted(range(len(ids)), key=lambda k: (vectors[k][0][int(np.argmax(vectors[k][1]))], ids[k]))
        self.ids, self.labels = np.array([ids[k] for k in order], np.int64), np.array([labels[k] for k in order], np.int8)
        self.block, self.n_terms = block, n_terms
        self.maxima = np.zeros((-(-len(ids) // block), n_terms))
        self.terms, self.postings = [], []
        for b in range(len(self.maxima)):
            members = [vectors[k] for k in order[b * block : (b + 1) * block]]
            terms = np.unique(np.concatenate([t for t, _ in members]))
            rows = np.zeros((len(terms), len(members)))
            for place, (t, w) in enumerate(members):
                rows[np.searchsorted(terms, t), place] = w
            self.terms.append(terms)
            self.postings.append(rows)
            self.maxima[b, terms] = rows.max(axis=1)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) of the k nearest, ties by place; ``without`` is the id of an example left out."""
        query = np.zeros(self.n_terms)
        query[terms] = weights
        bound = self.maxima[:, terms] @ weights
        places, found, least = np.empty(0, np.int64), np.empty(0), 0.0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(places) >= k and bound[b] < least - 1e-12:
                break
            score = query[self.terms[b]] @ self.postings[b]
            hit = np.flatnonzero(score > 0)
            at = hit + b * self.block
            if without is not None:
                other = self.ids[at] != without
                hit, at = hit[other], at[other]
            places, found = np.concatenate([places, at]), np.concatenate([found, score[hit]])
            if len(places) > k:
                best = np.lexsort((places, -found))[:k]
                places, found = places[best], found[best]
            if len(places) >= k:
                least = found.min()
        best = np.lexsort((places, -found))
        return places[best], found[best]


def monotone(x: list[float], y: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Steps (vote, probability) of a non-decreasing least-squares fit; each step is drawn a little to the middle."""
    groups: list[list[float]] = []  # last vote, sum of labels, size
    for v, label in sorted(zip(x, y, strict=True)):
        if groups and groups[-1][0] == v:
            groups[-1][1] += label
            groups[-1][2] += 1
        else:
            groups.append([v, label, 1])
    out: list[list[float]] = []
    for g in groups:
        out.append(list(g))
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            last = out.pop()
            out[-1] = [last[0], out[-1][1] + last[1], out[-1][2] + last[2]]
    return np.array([g[0] for g in out]), np.array([(g[1] + 0.5) / (g[2] + 1) for g in out])


class Model:
    """Terms, weights, index and calibration: a few megabytes at most."""

    def __init__(self, terms: list[str], n_docs: int, frequency: dict[int, int], examples: list[tuple[int, list[int], list[int], int]]):
        self.terms = terms
        self.idf = np.array([math.log((n_docs + 1) / (frequency.get(k, 0) + 1)) + 1 for k in range(len(terms))])
        empty = [e[3] for e in examples if not e[1]]
        self.without_terms = (sum(empty) + 0.5) / (len(empty) + 1) if empty else 0.0
        self.prior = sum(e[3] for e in examples) / max(1, len(examples))
        full = [(e[0], self.unit(e[1], e[2]), e[3]) for e in examples if e[1]]
        self.index = BlockMaxIndex([e[0] for e in full], [e[1] for e in full], [e[2] for e in full], len(terms)) if full else None
        self.votes, self.rates = np.array([0.0]), np.array([self.prior])
        if full:
            raw = [self.vote(*self.index.nearest(*v, NEIGHBOURS, without=i)) for i, v, _ in full]
            self.votes, self.rates = monotone(raw, [e[2] for e in full])

    def unit(self, terms: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.asarray(terms, np.int64)
        w = (1 + np.log(np.asarray(counts, float))) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def vote(self, places: np.ndarray, similarities: np.ndarray) -> float:
        w = similarities**2
        return float(((w * self.index.labels[places]).sum() + PRIOR_MASS * self.prior) / (w.sum() + PRIOR_MASS))

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, list[dict]]:
        """(probability, evidence: nearest examples with their similarity and label)."""
        if not terms or self.index is None:
            return self.without_terms, []
        places, similarities = self.index.nearest(*self.unit(terms, counts), NEIGHBOURS)
        rate = float(np.interp(self.vote(places, similarities), self.votes, self.rates))
        evidence = [
            {"doc_id": int(self.index.ids[p]), "similarity": round(float(s), 6), "toxic": int(self.index.labels[p])}
            for p, s in zip(places[:3], similarities[:3], strict=True)
        ]
        return min(1.0, max(0.0, rate)), evidence


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """(model, term vectors of all rows of ``docs`` as a written table)."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = F.broadcast(scratch.save(training_labels(labels)))  # at most MAX_EXAMPLES narrow rows
    examples = scratch.save(docs.join(chosen, "doc_id").dropDuplicates(["doc_id"]))
    terms = choose_terms(examples)
    vectors = scratch.save(term_vectors(docs, terms))
    rows = vectors.count()
    frequency = {r["t"]: r["count"] for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    known = vectors.join(chosen, "doc_id").dropDuplicates(["doc_id"]).collect()
    return Model(terms, rows, frequency, sorted((r["doc_id"], r["terms"], r["counts"], r["label"]) for r in known)), vectors


class Scorer:
    """Scores of term vectors; equal vectors are looked up once in a while."""

    def __init__(self, model: Model, most: int = 20_000):
        self.model, self.most, self.seen = model, most, {}

    def __call__(self, terms: list[int], counts: list[int]) -> tuple[float, list[dict]]:
        key = (*terms, -1, *counts)
        if key not in self.seen:
            if len(self.seen) >= self.most:
                self.seen.clear()
            self.seen[key] = self.model.score(terms, counts)
        return self.seen[key]


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of ``docs``."""
    model, vectors = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda doc_id, terms, counts: ((doc_id, *scorer(terms, counts)),)

    scored = map_rows(
        vectors, ["doc_id", "terms", "counts"], make,
        "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>", text=None,
    )
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence"
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, whose score is below the threshold; judged where they are, nothing is shuffled."""
    model, _ = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        counter, scorer = worker_counter(shared.value.terms), Scorer(shared.value)
        return lambda text: scorer(*counter(text))[0] < THRESHOLD

    return keep_rows(docs, make)
