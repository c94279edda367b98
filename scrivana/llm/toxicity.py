"""Toxicity: a counterfactually regularised linear classifier.

Trained on the driver with numpy, on a bounded sample of labelled rows (SAMPLE_ROWS). A document's label holds
for the document, not for each of its sentences, so training alternates between choosing, for each toxic
document, the sentence that looks worst (clean documents give sentences that look worst and others) and fitting
a logistic regression on hashed words and word beginnings. For every chosen sentence counterfactuals are made:
an identity term is swapped for another one of its group, and where there is none, one is put in. The fit
penalises the squared change of the score, so terms of identity carry no weight of their own and neutral
mentions of a group aren't flagged. A document's score is that of its worst sentence, calibrated on the sample.

Scoring reads each text once. A word's weight is found once per task and kept (bounded), so a document costs a
look-up per word. Sentences longer than LONGEST words are judged in parts.

Defined cases: null and empty texts have the score of a document without sentences; labels, lang, source and
doc_id are no inputs of a score, so equal texts have equal scores; a very long text is as many sentences, in parts of
LONGEST words; repeated rows are scored alike; null labels are not learned from; without labelled rows of both classes every score is the share of toxic labels, or 0 without labels; an empty table
gives an empty result; other columns are carried along whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import lean, packed
from scrivana.llm.training import Sample, doc_texts, fold, sample_of

#: The most labelled rows that the classifier is fitted on.
SAMPLE_ROWS = 8_000
BUCKETS, PREFIXES, LONGEST = 1 << 19, (4, 5, 6, 7, 8), 40
#: Buckets that fewer documents have, or whose log odds are nearer to 0 in standard errors, get no weight.
LEAST_DOCS, LEAST_Z = 4, 3.0
ROUNDS, STEPS, RIDGE, COUNTERFACTUAL, PARTS = 2, 60, 1e-4, 1.0, 3
THRESHOLD, FOLDS, HELD_OUT = 0.5, 5, 0
_EDGE = ".,;:!?\"'()[]{}#$%&*|<>«»„“”"

#: Identity terms by group and language; a term is swapped for another one of its row.
IDENTITY = (
    "women men girls boys",
    "muslims christians jews buddhists hindus atheists catholics protestants",
    "black white asian latino arab indigenous",
    "gay straight lesbian bisexual transgender",
    "immigrants refugees foreigners natives",
    "mujeres hombres niñas niños",
    "musulmanes cristianos judíos budistas ateos católicos",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs bouddhistes athées catholiques",
    "frauen männer mädchen jungen",
    "muslime christen juden buddhisten atheisten katholiken",
    "inmigrantes refugiados immigrés réfugiés einwanderer flüchtlinge",
)


def features(word: str) -> np.ndarray:
    """Buckets of a word and of its beginnings."""
    parts = [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return np.array([xxhash.xxh3_64_intdigest(p.encode()) % BUCKETS for p in parts], dtype=np.int64)


def clean(token: str) -> str:
    return token.strip(_EDGE)


@dataclass
class Model:
    """Weights of the buckets, of a sentence as such, and the calibration of a document's worst sentence."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None


class Scorer:
    """Scores texts; keeps what it has found about up to MOST words."""

    MOST = 500_000

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def token(self, token: str) -> complex:
        """A token's weight, and 1j if a sentence ends with it."""
        word = clean(token)
        found = complex(float(self.model.weights[features(word)].sum()) if word else 0.0, token[-1] in ".!?")
        if len(self.known) >= self.MOST:
            self.known.clear()
        self.known[token] = found
        return found

    def worst(self, text: str) -> float:
        """The logit of the worst sentence; 0 without sentences."""
        tokens = text.lower().split()
        if not tokens:
            return 0.0
        known, look = self.known, self.token
        found = np.array([known[t] if t in known else look(t) for t in tokens])
        ends = sentence_starts(found.imag > 0)
        return float(np.add.reduceat(found.real, ends).max()) + self.model.bias

    def score(self, text: str) -> float:
        if self.model.constant is not None:
            return self.model.constant
        z = self.model.slope * self.worst(text) + self.model.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def sentence_starts(ends: np.ndarray) -> np.ndarray:
    """Where sentences start, given whether each token ends one; long ones are cut every LONGEST tokens."""
    n = len(ends)
    starts = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
    lengths = np.diff(np.append(starts, n))
    if lengths.max() <= LONGEST:
        return starts
    parts = -(-lengths // LONGEST)
    first = np.repeat(starts, parts)
    within = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
    return first + within * LONGEST


_ROW = {term: row.split() for row in IDENTITY for term in row.split()}


def counterfactuals(words: list[str], turn: int) -> list[tuple[str, str]]:
    """(term, other term) of each identity term swapped; without one, a term put in ('' for none)."""
    swaps = [(w, row[(row.index(w) + 1 + turn) % len(row)]) for w in words if (row := _ROW.get(w))]
    if swaps:
        return swaps
    row = IDENTITY[turn % len(IDENTITY)].split()
    return [("", row[turn // len(IDENTITY) % len(row)])]


class Corpus:
    """Texts as word numbers: tokens of all texts in a row, where their sentences start, and each word's buckets."""

    def __init__(self, texts: list[str]):
        self.number: dict[str, int] = {"": 0}
        tokens, starts, owner, held, at = [], [], [], [], 0
        for k, text in enumerate(texts):
            raw = text.lower().split()
            if not raw:
                continue
            first = sentence_starts(np.array([t[-1] in ".!?" for t in raw]))
            tokens.append(np.array([self.of(clean(t)) for t in raw], dtype=np.int32))
            held.append(np.unique(tokens[-1]))
            starts.append((first + at).astype(np.int32))
            owner.append(np.full(len(first), k, dtype=np.int32))
            at += len(raw)
        for row in IDENTITY:
            for term in row.split():
                self.of(term)
        self.tokens, self.starts, self.owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tokens, starts, owner))
        #: (text, word) of the words that each text has, once each.
        self.pairs = (np.repeat([o[0] for o in owner], [len(h) for h in held]).astype(np.int32), np.concatenate(held)) if held else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        del tokens, held
        self.words = list(self.number)
        # A word without some of its beginnings has the bucket BUCKETS there, whose weight is 0.
        self.buckets = np.full((len(self.words), 1 + len(PREFIXES)), BUCKETS, dtype=np.int32)
        for k, word in enumerate(self.words):
            if word:
                found = features(word)
                self.buckets[k, : len(found)] = found

    def of(self, word: str) -> int:
        return self.number.setdefault(word, len(self.number))

    def sentence(self, k: int) -> np.ndarray:
        return self.tokens[self.starts[k] : self.starts[k + 1] if k + 1 < len(self.starts) else len(self.tokens)]

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Of every sentence."""
        weights, each = np.append(weights, 0), np.zeros(len(self.words))
        for column in self.buckets.T:
            each += weights[column]
        return np.add.reduceat(each.astype(np.float32)[self.tokens], self.starts, dtype=np.float64)


def train(sample: Sample, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Fit on the sample; calibrate on the scores that each part of it gets from a fit on the other parts."""
    model, marks = Model(), sample.marks
    if len(set(marks.tolist())) < 2:
        model.constant = float(marks.mean()) if len(marks) else 0.0
        return model
    corpus = Corpus(sample.texts)
    if not len(corpus.starts):
        model.constant = float(np.average(marks, weights=sample.weights))
        return model
    # By text, so that copies are in one part.
    part = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % PARTS for t in sample.texts])
    worst = np.zeros(len(marks))
    for k in range(PARTS):
        weights, bias = fitted(corpus, marks, part != k, counterfactual)
        worst[part == k] = worst_sentences(corpus, weights, bias, len(marks))[part == k]
    weights, model.bias = fitted(corpus, marks, np.ones(len(marks), bool), counterfactual)
    model.weights = weights.astype(np.float32)
    model.slope, model.shift = calibrated(worst, marks, sample.weights)
    return model


def worst_sentences(corpus: Corpus, weights: np.ndarray, bias: float, texts: int) -> np.ndarray:
    out = np.zeros(texts)
    out[np.unique(corpus.owner)] = np.maximum.reduceat(corpus.logits(weights), np.flatnonzero(np.diff(corpus.owner, prepend=-1))) + bias
    return out


def fitted(corpus: Corpus, marks: np.ndarray, learn: np.ndarray, counterfactual: float) -> tuple[np.ndarray, float]:
    """(weights, bias) from the texts in `learn`."""
    of_doc, learned, bias = marks[corpus.owner], learn[corpus.owner], 0.0
    weights = first_weights(corpus, marks, learn)
    use = weights != 0
    rng = np.random.default_rng(11)
    for _ in range(ROUNDS):
        z = corpus.logits(weights)
        rank = ranks_within(corpus.owner, -z)
        chance = rng.random(len(z)) * np.bincount(corpus.owner)[corpus.owner] < 2
        chosen = np.flatnonzero(learned & np.where(of_doc == 1, rank == 0, (rank < 2) | chance))
        weights, bias = fit(corpus, chosen, of_doc[chosen].astype(np.float64), use, counterfactual)
    return weights, bias


def ranks_within(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The rank of each key within its group; groups are adjacent."""
    order = np.lexsort((key, group))
    first = np.flatnonzero(np.diff(group, prepend=-1))
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return out


def first_weights(corpus: Corpus, marks: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """Smoothed log odds of the documents that have a bucket; 0 where they can't be told from 0."""
    doc, word = corpus.pairs
    held = np.zeros((2, BUCKETS + 1))
    for y in (0, 1):
        use = (marks[doc] == y) & learn[doc]
        for column in corpus.buckets.T:
            held[y] += np.bincount(column[word[use]], minlength=BUCKETS + 1)
    held, totals = held[:, :-1], np.bincount(marks[learn], minlength=2)
    odds = np.log((held[1] + 0.5) / (totals[1] + 1)) - np.log((held[0] + 0.5) / (totals[0] + 1))
    error = np.sqrt(1 / (held[0] + 0.5) + 1 / (held[1] + 0.5))
    return np.where((held.sum(0) >= LEAST_DOCS) & (np.abs(odds) >= LEAST_Z * error), odds, 0)


def fit(corpus: Corpus, chosen: np.ndarray, labels: np.ndarray, use: np.ndarray, counterfactual: float) -> tuple[np.ndarray, float]:
    """Logistic regression on the chosen sentences with the counterfactual penalty."""
    index, row, plus, minus = [], [], [], []
    for k, s in enumerate(chosen):
        tokens = corpus.sentence(s)
        found = corpus.buckets[tokens].ravel()
        index.append(found)
        row.append(np.full(len(found), k, np.int32))
        for a, b in counterfactuals([corpus.words[t] for t in tokens], k):
            plus.append(corpus.of(a))
            minus.append(corpus.of(b))
    index, row, use = np.concatenate(index), np.concatenate(row), np.append(use, False)
    kept = use[index]
    index, row = index[kept], row[kept]
    both, times = np.unique(np.array([plus, minus]), axis=1, return_counts=True)
    plus, minus = corpus.buckets[both[0]], corpus.buckets[both[1]]
    share = times / times.sum()
    w, bias = np.zeros(BUCKETS + 1), 0.0
    # Both classes weigh the same: a toxic sentence is one of many in its document.
    weight = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    squares, bias_squares = np.full(BUCKETS + 1, 1e-12), 1e-12
    for step in range(STEPS):
        rate = 0.1 * (1 - step / STEPS) + 0.005
        z = np.bincount(row, w[index], len(chosen)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        change = w[plus].sum(1) - w[minus].sum(1)
        slope = 2 * counterfactual * share * change
        grad = np.bincount(index, error[row], BUCKETS + 1) + RIDGE * w
        np.add.at(grad, plus, slope[:, None])
        np.add.at(grad, minus, -slope[:, None])
        grad[~use] = 0
        squares = 0.9 * squares + 0.1 * grad**2
        w -= rate * grad / (np.sqrt(squares) + 1e-6)
        bias_squares = 0.9 * bias_squares + 0.1 * error.sum() ** 2
        bias -= rate * error.sum() / (np.sqrt(bias_squares) + 1e-6)
    return w[:-1], float(bias)


def calibrated(worst: np.ndarray, marks: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of label over worst sentence, with a little smoothing of the labels."""
    goal = np.where(marks > 0, 1 - 1 / (marks.sum() + 2), 1 / ((1 - marks).sum() + 2))
    mean, spread = worst.mean(), worst.std() + 1e-9
    x, a, b, weights = (worst - mean) / spread, 1.0, 0.0, weights / weights.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h, miss = weights * np.maximum(p * (1 - p), 1e-6), weights * (p - goal)
        grad = np.array([(miss * x).sum() + 1e-3 * a, miss.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
    return max(a, 1e-3) / spread, b - max(a, 1e-3) * mean / spread


def scored(spark: SparkSession, rows: DataFrame, model: Model, keep: str = "doc_id") -> DataFrame:
    """(keep, score) of rows with a column text."""
    sent = spark.sparkContext.broadcast(model)

    def work(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            column = b.column("text")
            scores = [scorer.score(column[k].as_py() or "") for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(scores, pa.float64())], names=[keep, "score"])

    return rows.select(keep, "text").mapInArrow(lean(work), f"{keep} bigint, score double")


def model_for(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return train(sample_of(spark, docs, sf_dir, "toxic", FOLDS, HELD_OUT, SAMPLE_ROWS, even=True))


def op1(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The contract's columns."""
    found = scored(spark, doc_texts(docs), model_for(spark, docs, sf_dir))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score THRESHOLD or more; the columns are those of docs.

    The score is a column of the pass that reads the rows, so nothing is shuffled.
    """
    sent = spark.sparkContext.broadcast(model_for(spark, docs, sf_dir))

    def work(batches):
        scorer = Scorer(sent.value)
        for text in batches:
            yield text.map(lambda t: scorer.score(t or ""))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return lean(work)(batches)

    rows = packed(spark, docs).select("row")
    return rows.where(score(F.coalesce(F.col("row.text"), F.lit(""))) < THRESHOLD).select("row.*")
