"""Operator 3: toxicity by weak supervision.

1. Voters are found on a bounded sample of labelled rows (``SAMPLE`` rows, the smallest by a hash of doc_id): words and
   word beginnings that, from one, two or three occurrences on, stand in toxic documents far more often than in others
   (lexicon voters); shares of capitals, of "!" and of repeated words (pattern voters); and one clean voter, which votes
   against when no lexicon voter speaks.
2. A generative label model estimates the voters' accuracies and correlations: voters whose residuals correlate form a
   clique, and how many of a clique speak (up to ``STATES``) is one vote, whose rate on toxic and on clean documents
   expectation maximisation finds; silence says nothing. Each sampled document gets a posterior label from the votes
   alone: the given labels don't vote. They calibrate the voters: the rates and residuals counted on them are where the
   model starts, and count as much as the documents in each round.
3. A linear classifier over the voters' counts is trained on the posterior labels.
4. Every whole text is scored in one scan: an Aho-Corasick automaton finds the terms, the classifier adds up.

Labels, lang, source and doc_id are never inputs of a score. Defined results: null or empty text has the score of a text
without any term or pattern; a null doc_id is scored and not held out; repeated rows are each scored; several labels of one doc_id
count as toxic if one does; without any toxic or any clean label in the sample the scores are the share of toxic labels;
an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import blocks, bounded, crc_mod, stored, texts_of

SAMPLE = 20_000
#: Bounds of the lexicon: terms that are counted, ranked and chosen.
COUNTED, CANDIDATES, TERMS = 400_000, 4000, 160
#: The weight of the calibration against the documents' own in each round.
CALIBRATION = 1.0
LENGTHS = (4, 5, 6, 7)
LEVELS = (1, 2, 3)
MIN_DOCS, MIN_PRECISION = 4, 0.7
#: A term must stand in toxic documents at least so often even at the lower end of a 90 % interval (Wilson), as terms are
#: chosen on the rows that calibrate them.
LEAST_PRECISION = 0.5
#: Voters whose residuals correlate more than this are of one clique, of which so many votes count at most.
CORRELATED, STATES = 0.15, 3
_WORD = re.compile(r"[^\W\d_]+")


# --------------------------------------------------------------------------- voters


def terms_of(text: str) -> Counter:
    """How often each whole word (with "$" after it) and each word beginning stands in the text."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        out[word + "$"] += n
        for k in LENGTHS:
            if len(word) >= k:
                out[word[:k]] += n
    return out


def _toxic_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of these (toxic) documents each term stands at each level."""
    for batch in blocks(batches):
        found: Counter = Counter()
        for text in texts_of(batch):
            found.update((t, k) for t, n in terms_of(text).items() for k in LEVELS if n >= k)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], ["term", "level", "toxic"])


def _every_counts(batches: Iterator[pa.RecordBatch], index: dict[tuple[str, int], int]) -> Iterator[pa.RecordBatch]:
    """In how many documents each of the terms in index stands at its level."""
    every = np.zeros(len(index), np.int64)
    for batch in blocks(batches):
        for text in texts_of(batch):
            for t, n in terms_of(text).items():
                for k in LEVELS:
                    if n >= k and (at := index.get((t, k))) is not None:
                        every[at] += 1
    used = np.flatnonzero(every)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(every[used], pa.int64())], ["at", "every"])


def unlike(candidates: list[tuple[str, int, int, int]]) -> list[tuple[str, int]]:
    """Of candidates (term, level, toxic, every), best first, those that no better one of the same word stands for."""
    chosen: list[tuple[str, int, int, int]] = []
    for term, level, toxic, every in candidates:
        stem = term.rstrip("$")
        for t, k, x, n in chosen:
            other = t.rstrip("$")
            wider = stem.startswith(other) and k <= level and x / n >= toxic / every - 0.02
            narrower = other.startswith(stem) and toxic <= 1.15 * x and level >= k
            if wider or narrower:
                break
        else:
            chosen.append((term, level, toxic, every))
    return [(t, k) for t, k, _, _ in chosen]


def surely(toxic: int, every: int, z: float = 1.645) -> float:
    """The lower end of Wilson's interval of toxic / every."""
    share = toxic / every
    return (share + z * z / (2 * every) - z * (share * (1 - share) / every + z * z / (4 * every * every)) ** 0.5) / (1 + z * z / every)


class Matcher:
    """Counts terms in texts."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.index = {t: k for k, t in enumerate(terms)}
        self.automaton = ahocorasick.Automaton()
        for term in {t.rstrip("$") for t in terms}:
            self.automaton.add_word(term, term)
        if terms:
            self.automaton.make_automaton()

    def counts(self, text: str) -> np.ndarray:
        out = np.zeros(len(self.index), np.int32)
        low = text.lower()
        if not self.index or not low:
            return out
        for end, term in self.automaton.iter(low):
            start = end - len(term) + 1
            if start and (low[start - 1].isalpha()):
                continue
            if (k := self.index.get(term)) is not None:
                out[k] += 1
            if (k := self.index.get(term + "$")) is not None and not (end + 1 < len(low) and low[end + 1].isalpha()):
                out[k] += 1
        return out


def patterns_of(text: str) -> tuple[float, float, float]:
    """Shares of capitals among letters and of "!" among characters; the share of words that repeat their predecessor."""
    if not text:
        return 0.0, 0.0, 0.0
    words = text.split()
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words) - 1)
    return sum(map(str.isupper, text)) / len(text), text.count("!") / len(text), repeated


_PATTERN_BOUNDS = (0.3, 0.02, 0.3)


@lru_cache(2)
def matcher(terms: tuple[str, ...]) -> Matcher:
    return Matcher(list(terms))


# --------------------------------------------------------------------------- label model


def cliques(votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The clique of each voter: voters are linked if their votes, less the mean of the row's class, correlate."""
    votes = votes.astype(float)
    rest = votes - np.stack([votes[labels == k].mean(0) if (labels == k).any() else np.zeros(votes.shape[1]) for k in (0, 1)])[labels]
    size = np.sqrt((rest**2).sum(0)) + 1e-9
    linked = rest.T @ rest / np.outer(size, size) > CORRELATED
    np.fill_diagonal(linked, True)
    least = np.arange(len(linked))
    while (now := np.where(linked, least, len(linked)).min(1)).tolist() != least.tolist():
        least = now
    return np.unique(least, return_inverse=True)[1]


def label_model(votes: np.ndarray, polarity: np.ndarray, labels: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row; rate of each clique's states (clean or toxic x clique x number that speak); the clique of
    each voter.

    votes: rows x voters, whether a voter speaks. polarity: 1 for voters for toxic, 0 against; a voter never counts
    against its own. labels: 0 or 1, by which the voters are calibrated; rows of equal votes have equal posteriors."""
    of = cliques(votes, labels)
    n, m = len(votes), int(of.max()) + 1
    spoke = np.zeros((n, m), np.int64)
    np.add.at(spoke.T, of, votes.T.astype(np.int64))
    state = np.minimum(spoke, STATES)[:, :, None] == np.arange(STATES + 1)
    for_toxic = np.array([polarity[of == k].max() for k in range(m)])[:, None] == 1
    prior = float(np.clip(labels.mean(), 0.01, 0.99))

    def rates_of(mass: np.ndarray, held: float = 0.0, first: np.ndarray | float = 0.0) -> np.ndarray:
        return (np.einsum("n,nms->ms", mass, state) + 0.5 + held * first) / (mass.sum() + 0.5 * (STATES + 1) + held)

    first = np.stack([rates_of((labels == k).astype(float)) for k in (0, 1)])
    rates, q = first, np.full(n, prior)
    held = CALIBRATION * n * np.array([1 - prior, prior])
    for _ in range(rounds):
        ratio = np.log(rates[1] / rates[0])
        ratio = np.where(for_toxic, np.maximum(ratio, 0), np.minimum(ratio, 0))
        ratio[:, 0] = 0  # silence
        logit = np.log(prior / (1 - prior)) + np.einsum("nms,ms->n", state, ratio)
        q = np.clip(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 1e-4, 1 - 1e-4)
        rates = np.stack([rates_of(mass, h, f) for mass, h, f in zip((1 - q, q), held, first, strict=True)])
    return q, rates, of


def fit_linear(x: np.ndarray, q: np.ndarray, steps: int = 800, decay: float = 1e-5, rate: float = 0.5) -> np.ndarray:
    """Logistic regression on soft labels by Adam; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - q) / len(x) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


# --------------------------------------------------------------------------- the model


class Model:
    """terms and voters (term index, level); weights of the linear classifier, or a constant score."""

    def __init__(self, terms: list[str], voters: list[tuple[int, int]], weights: np.ndarray | None, constant: float = 0.0):
        self.terms, self.voters, self.weights, self.constant = tuple(terms), voters, weights, constant
        self.term = np.array([t for t, _ in voters], np.int64)
        self.level = np.array([k for _, k in voters], np.int64)

    def features(self, counts: np.ndarray, patterns: np.ndarray) -> np.ndarray:
        fired = counts[:, self.term] >= self.level
        return np.concatenate([fired, np.log1p(fired.sum(1))[:, None], fired.any(1)[:, None], patterns > _PATTERN_BOUNDS], 1).astype(float)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        found = matcher(self.terms)
        counts = np.stack([found.counts(t) for t in texts])
        x = self.features(counts, np.array([patterns_of(t) for t in texts], float).reshape(-1, 3))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _counts(batches: Iterator[pa.RecordBatch], terms: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    found = matcher(terms)
    for batch in blocks(batches):
        rows = [(y, np.minimum(found.counts(t), 255).astype(np.uint8).tobytes(), list(patterns_of(t))) for t, y in zip(texts_of(batch), batch["toxic"].to_pylist(), strict=True)]
        kinds = (pa.int32(), pa.binary(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["toxic", "counts", "patterns"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learn=None) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic). learn: a condition on labels; rows without it are not learned from."""
    spark = docs.sparkSession
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows if learn is None else rows.filter(learn)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so few rows that they can be broadcast
    # of rows that share a doc_id one is learned from, so that the sample has no more rows than ids
    texts = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = F.min_by(F.struct("text", "toxic"), F.struct(F.xxhash64("text"), F.col("text"))).alias("row")
    picked = stored(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(one).select("row.text", "row.toxic"), "labelled")
    size = chosen.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    total, positive = size[0], size[1] or 0
    if not positive or positive == total:
        return Model([], [], None, positive / total if total else 0.0)
    # terms of several toxic documents of the sample: their number is bounded by the sample's size
    toxic = picked.filter("toxic = 1").select("text").mapInArrow(_toxic_counts, "term string, level int, toxic long").groupBy("term", "level").agg(F.sum("toxic").alias("toxic"))
    likely = toxic.filter(F.col("toxic") >= MIN_DOCS).orderBy(F.desc("toxic"), "term", "level").limit(COUNTED).collect()
    likely.sort(key=lambda r: (r.term, r.level))
    index = spark.sparkContext.broadcast({(r.term, r.level): k for k, r in enumerate(likely)})
    every = {r.at: r.every for r in picked.select("text").mapInArrow(lambda it: _every_counts(it, index.value), "at long, every long").groupBy("at").agg(F.sum("every").alias("every")).collect()}

    def gain(r, n: int) -> float:
        return r.toxic * float(np.log(((r.toxic + 0.5) / (positive + 1)) / ((n - r.toxic + 0.5) / (total - positive + 1))))

    scored = [(-gain(r, every[k]), r.term, r.level, r.toxic, every[k]) for k, r in enumerate(likely) if r.toxic >= MIN_PRECISION * every[k] and surely(r.toxic, every[k]) >= LEAST_PRECISION]
    top = [r[1:] for r in sorted(scored)[:CANDIDATES]]
    voters_named = unlike(top)[:TERMS]
    terms = sorted({t for t, _ in voters_named})
    voters = [(terms.index(t), k) for t, k in voters_named]
    if not voters:
        return Model([], [], None, positive / total)
    data = picked.mapInArrow(lambda it: _counts(it, tuple(terms)), "toxic int, counts binary, patterns array<double>").collect()
    y = np.array([r.toxic for r in data], float)
    counts = np.stack([np.frombuffer(r.counts, np.uint8) for r in data])
    patterns = np.array([r.patterns for r in data])
    model = Model(terms, voters, None)
    fired = counts[:, model.term] >= model.level
    votes = np.concatenate([fired, patterns > _PATTERN_BOUNDS, ~fired.any(1)[:, None]], 1)
    polarity = np.append(np.ones(votes.shape[1] - 1), 0)
    posterior, _, _ = label_model(votes, polarity, y.astype(np.int64))
    model.weights = fit_linear(model.features(counts, patterns), posterior)
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.scores(texts_of(batch)), pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""
    held = bounded(docs).sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _scored(it, held.value), "doc_id long, score double")


def _kept(batches: Iterator[pa.RecordBatch], model: Model, below: float) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        yield batch.filter(pa.array(model.scores(texts_of(batch)) < below, pa.bool_()))


def keep(docs: DataFrame, model: Model, below: float) -> DataFrame:
    """The rows of docs that score below so much."""
    held = bounded(docs).sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _kept(it, held.value, below), docs.schema)


def learn_fold():
    return crc_mod("doc_id", 3) != 1
