"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Every word has a sparse ternary index vector from its hash. A word's context vector is the sum of the index
vectors of its neighbours within REACH places, over all documents: words are hashed to WORDS rows and their shapes
(case, digits, last characters) to SHAPES more, each task sums its own part of the table, and the parts are added by
groups of rows, those of TASKS tasks first, so that no task adds the parts of all. Sums are whole numbers, so the order of adding makes no difference. Words whose row is met fewer
than LEAST times share the vector of their shape. A document is the mean of its words' vectors and the
mean of its shapes' vectors, with a few figures on repetition and length; a network with one hidden layer,
trained on the driver by gradient steps on a bounded sample of labelled rows (SAMPLE_ROWS), scores it. Its
probabilities are calibrated by a temperature on a part of the sample that it was not trained on.

Both passes read each text once; which rows a word has is found once per worker and kept (bounded).

Defined cases: null and empty texts have the score of a document without words; labels, lang, source and
doc_id are no inputs of a score, so equal texts have equal scores; a very long text is summed and pooled in pieces;
repeated rows are scored alike; null labels are not learned from; without labelled rows of both classes every score is the share of good labels, or 0 without labels; an empty table
gives an empty result; other columns are carried along whole.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivana.llm.common import LOC, packed
from scrivana.llm.training import Sample, doc_texts, fold, sample_of

#: The most labelled rows that the network is fitted on.
SAMPLE_ROWS = 6_000
#: Rows of the table of vectors: for words, and for shapes.
WORDS, SHAPES = 1 << 15, 1 << 12
SIZE, NONZERO, REACH, LEAST = 48, 6, 2, 5
#: Words that a task sums at a time; groups of rows that are added up apart; tasks whose sums are added up first.
FLUSH, GROUPS, TASKS = 500_000, 32, 256
HIDDEN, EPOCHS, RATE, DECAY = 24, 60, 3e-3, 1e-4
THRESHOLD, FOLDS, HELD_OUT = 0.5, 3, 1
_FIGURES = 6


def shape(word: str) -> str:
    """Case and kind of the characters, and what the word ends with."""
    bare = word.rstrip(".,;:!?#$%&*|\"')")
    tail = word[len(bare) :][:4]
    if not bare:
        kind = "mark"
    elif bare.isdigit():
        kind = "digits"
    elif any(c.isdigit() for c in bare):
        kind = "mixed"
    elif bare.islower():
        kind = "lower"
    elif bare.isupper():
        kind = "upper" if len(bare) > 1 else "letter"
    else:
        kind = "title" if bare[:1].isupper() and bare[1:].islower() else "odd"
    length = "1" if len(bare) < 2 else "s" if len(bare) < 5 else "m" if len(bare) < 12 else "l" if len(bare) < 25 else "x"
    return f"\x00{kind}{length}{tail}"


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def index_places() -> np.ndarray:
    """The places of each row's nonzero numbers: +1 at the even ones, -1 at the odd ones."""
    rng = np.random.default_rng(14)
    return np.argsort(rng.random((WORDS + SHAPES, SIZE)), axis=1)[:, :NONZERO].astype(np.int32)


class Rows:
    """The rows of words: own << 32 | that of the shape; keeps what it has found about up to MOST words."""

    MOST = 1_000_000

    def __init__(self, enough: np.ndarray | None = None):
        self.enough, self.known = enough, {}

    def find(self, word: str) -> int:
        of_shape = WORDS + _hash(shape(word)) % SHAPES
        own = _hash(word) % WORDS
        found = (own if self.enough is None or self.enough[own] else of_shape) << 32 | of_shape
        if len(self.known) >= self.MOST:
            self.known.clear()
        self.known[word] = found
        return found

    def of(self, words: list[str]) -> np.ndarray:
        known, find = self.known, self.find
        return np.array([known[w] if w in known else find(w) for w in words], dtype=np.int64)


def contexts(found: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """(rows, 1 + SIZE): how often each row is met, and the sum of its neighbours' index vectors."""
    n = WORDS + SHAPES
    both = np.concatenate(found)
    own, of_shape = both >> 32, both & 0xFFFFFFFF
    doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
    out = np.zeros((n, 1 + SIZE), np.int64)
    out[:, 0] = np.bincount(own, minlength=n) + np.bincount(of_shape, minlength=n)
    total = np.zeros(n * SIZE, np.int64)
    for reach in range(1, REACH + 1):
        near = np.flatnonzero(doc[reach:] == doc[:-reach])
        for a, b in ((near, near + reach), (near + reach, near)):
            near_by = places[own[b]]
            for rows in (own[a], of_shape[a]):
                at = rows[:, None] * SIZE + near_by
                total += np.bincount(at[:, ::2].ravel(), minlength=n * SIZE) - np.bincount(at[:, 1::2].ravel(), minlength=n * SIZE)
    out[:, 1:] = total.reshape(n, SIZE)
    return out


def _sums(texts) -> np.ndarray | None:
    """contexts() of an iterable of texts, FLUSH words at a time; a longer text goes in pieces."""
    rows, places, held, size, out = Rows(), index_places(), [], 0, None
    for text in texts:
        words = (text or "").split()
        for at in range(0, len(words), FLUSH):
            found = rows.of(words[at : at + FLUSH])
            held.append(found)
            size += len(found)
            if size >= FLUSH:
                out = contexts(held, places) if out is None else out + contexts(held, places)
                held, size = [], 0
    if held:
        out = contexts(held, places) if out is None else out + contexts(held, places)
    return out


def corpus_contexts(docs: DataFrame) -> np.ndarray:
    """The sums over all texts. What comes to the driver is the table, whatever the number of documents."""
    n, size = WORDS + SHAPES, 1 + SIZE
    edges = np.linspace(0, n, GROUPS + 1).astype(int)

    def packed_sums(g: int, part: int, of: np.ndarray):
        rows = np.flatnonzero(of[:, 0])
        # Bytes of equal weight together, which the shuffle's compression makes small.
        values = np.ascontiguousarray(of[rows].view(np.uint8).reshape(-1, 8).T).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([part], pa.int32()), pa.array([rows.astype(np.int32).tobytes()]), pa.array([values])], names=["g", "part", "rows", "sums"])

    def summed(batches):
        out = _sums(t for b in batches for t in b.column("text").to_pylist())
        if out is not None:
            task = TaskContext.get().partitionId()
            for g in range(GROUPS):
                yield packed_sums(g, task // TASKS, out[edges[g] : edges[g + 1]])

    def added(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for g, part, rows, sums in zip(*(b.column(c).to_pylist() for c in ("g", "part", "rows", "sums")), strict=True):
                of = held.setdefault((g, part), np.zeros((edges[g + 1] - edges[g], size), np.int64))
                of[np.frombuffer(rows, np.int32)] += np.ascontiguousarray(np.frombuffer(sums, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1, size)
        for (g, part), of in held.items():
            yield packed_sums(g, part // TASKS, of)

    schema = "g int, part int, rows binary, sums binary"
    parts = docs.mapInArrow(summed, schema).repartition("g", "part").mapInArrow(added, schema)
    parts = parts.repartition(GROUPS, "g", "part").mapInArrow(added, schema)
    out = np.zeros((n, size), np.int64)
    for r in parts.collect():
        of = np.ascontiguousarray(np.frombuffer(r.sums, np.uint8).reshape(8, -1).T).view(np.int64).reshape(-1, size)
        out[edges[r.g] + np.frombuffer(r.rows, np.int32)] += of
    return out


@dataclass
class Model:
    """The vectors by row, which rows are met often enough, and the network."""

    vectors: np.ndarray | None = None
    enough: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    layers: tuple | None = None
    temperature: float = 1.0
    constant: float | None = None


def with_vectors(sums: np.ndarray) -> Model:
    """A model with the vectors of these sums. Its own index vector tells a word from others in the same contexts."""
    length = np.linalg.norm(sums[:, 1:], axis=1, keepdims=True)
    vectors = (sums[:, 1:] / np.maximum(length, 1e-9)).astype(np.float32)
    places = index_places()
    for k in range(NONZERO):
        vectors[np.arange(len(vectors)), places[:, k]] += (-1) ** k / np.sqrt(NONZERO)
    return Model(vectors=vectors, enough=sums[:, 0] >= LEAST)


class Pooler:
    """Pools texts with a model's vectors."""

    def __init__(self, model: Model):
        self.model, self.rows = model, Rows(model.enough)

    def pooled(self, text: str) -> np.ndarray:
        words = text.split()
        n = len(words)
        if not n:
            return np.zeros(2 * SIZE + _FIGURES, np.float32)
        both = self.rows.of(words)
        own, shapes = both >> 32, both & 0xFFFFFFFF
        vectors = self.model.vectors
        top = Counter(words).most_common(1)[0][1]
        same = sum(map(eq, words, words[1:]))
        figures = [np.log1p(n), len(set(words)) / n, len(set(words)) / n**0.8, same / n, top / n, len(text) / n / 10]
        return np.concatenate([mean_rows(vectors, own), mean_rows(vectors, shapes), np.array(figures, np.float32)])


def mean_rows(vectors: np.ndarray, rows: np.ndarray, piece: int = 20_000) -> np.ndarray:
    """The mean of the rows, a piece at a time, so that a very long text needs no more memory."""
    total = np.zeros(vectors.shape[1], np.float64)
    for at in range(0, len(rows), piece):
        total += vectors[rows[at : at + piece]].sum(0)
    return (total / len(rows)).astype(np.float32)


def forward(layers: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, bias, second, shift = layers
    hidden = np.tanh(x @ first + bias)
    return hidden, hidden @ second + shift


def train(sample: Sample, sums: np.ndarray | None = None) -> Model:
    """Network and temperature, on the vectors of the sums, or of the sample's own texts without any."""
    y = sample.marks.astype(np.float64)
    if len(set(sample.marks.tolist())) < 2:
        return Model(constant=float(y.mean()) if len(y) else 0.0)
    if sums is None:
        sums = _sums(sample.texts)
    model = with_vectors(np.zeros((WORDS + SHAPES, 1 + SIZE), np.int64) if sums is None else sums)
    pooler = Pooler(model)
    x = np.array([pooler.pooled(t) for t in sample.texts], dtype=np.float64)
    judge = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) % 5 == 0 for t in sample.texts])
    if len(set(y[judge].tolist())) < 2 or len(set(y[~judge].tolist())) < 2:
        judge[:] = False
    model.mean, model.spread = x[~judge].mean(0), x[~judge].std(0) + 1e-3
    z = np.clip((x - model.mean) / model.spread, -8, 8)
    model.layers = fit(z[~judge], y[~judge])
    if judge.any():
        logits = forward(model.layers, z[judge])[1]
        temperatures = np.exp(np.linspace(-1.5, 2.5, 81))
        losses = [np.logaddexp(0, np.where(y[judge] > 0, -1, 1) * logits / t).mean() for t in temperatures]
        model.temperature = float(temperatures[int(np.argmin(losses))])
    return model


def fit(x: np.ndarray, y: np.ndarray) -> tuple:
    """Adam on the logistic loss, in small batches."""
    rng = np.random.default_rng(5)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + 1e-5
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows = order[at : at + 64]
            hidden, logits = forward(layers, x[rows])
            error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y[rows]) / len(rows)
            back = error[:, None] * layers[2] * (1 - hidden**2)
            grads = [x[rows].T @ back + DECAY * layers[0], back.sum(0), hidden.T @ error + DECAY * layers[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                layers[k] = layers[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.pooler = model, Pooler(model)

    def score(self, text: str) -> float:
        m = self.model
        if m.constant is not None:
            return m.constant
        x = np.clip((self.pooler.pooled(text) - m.mean) / m.spread, -8, 8)
        logit = float(forward(m.layers, x[None])[1][0]) / m.temperature
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def scored(spark: SparkSession, rows: DataFrame, model: Model, keep: str = "doc_id") -> DataFrame:
    """(keep, score) of rows with a column text; keep is doc_id or loc."""
    sent = spark.sparkContext.broadcast(model)

    def work(batches):
        scorer = Scorer(sent.value)
        for b in batches:
            column = b.column("text")
            scores = [scorer.score(column[k].as_py() or "") for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(keep), pa.array(scores, pa.float64())], names=[keep, "score"])

    return rows.select(keep, "text").mapInArrow(work, f"{keep} {LOC if keep == 'loc' else 'bigint'}, score double")


def model_for(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """Vectors from all of docs, the network from the labelled sample."""
    sample = sample_of(spark, docs, sf_dir, "quality", FOLDS, HELD_OUT, SAMPLE_ROWS)
    if len(set(sample.marks.tolist())) < 2:
        return train(sample)
    return train(sample, corpus_contexts(doc_texts(docs).select("text")))


def op6(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The contract's columns."""
    found = scored(spark, doc_texts(docs), model_for(spark, docs, sf_dir))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = THRESHOLD) -> DataFrame:
    """docs that score `least` or more; the columns are those of docs."""
    model = model_for(spark, docs, sf_dir)
    rows = packed(spark, docs)
    found = scored(spark, rows.select("loc", F.coalesce(F.col("row.text"), F.lit("")).alias("text")), model, "loc").where(F.col("score") < least)
    return rows.join(found, "loc", "left_anti").select("row.*")
