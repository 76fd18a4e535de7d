"""A counterfactual-regularised toxicity classifier.

Method: logistic regression on the presence of words and of word beginnings (PREFIXES characters), which inflected and compound
forms share. In each labelled sentence that names a group of people, each identity term in turn is swapped for each other of its
list, and the squared change of the sentence's score (log odds) is a penalty beside the L2 one: the model may not tell "women" from
"men", so neutral mentions of a group add nothing. The swaps of one term in one sentence weigh 1 together.

Labels are learned from a bounded sample (MAX_TRAIN documents, least hash of the id first). Features are all words and beginnings whose
document counts in the two classes differ by a likelihood ratio (G2) of LEAST_G2 or more, in any language, and the identity terms; their
number is bounded by the sample only. Counts run on the executors; the driver gets the features, the sample's lists of feature numbers and
the distinct changes that swaps make.

Edge cases: a null or empty text is scored by the intercept; without labels of both classes every score is the
share of label 1 (0 if there are no labels); several labels of one id count as their maximum, null ids and null labels are no labels; a
null doc_id is scored and never held out; repeated rows are scored each; very long texts are scored whole; other columns are kept, whatever
their names, and not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sink, fresh, map_arrow, staged, table, unstage

MAX_TRAIN = 20_000
#: By chance alone a word reaches this about once in two thousand; three toxic documents and no other make 12.9 at a tenth of toxic labels.
LEAST_G2 = 12.0
PREFIXES = (3, 4, 5, 6)
L2, FAIRNESS = 0.1, 10.0
THRESHOLD = 0.7
#: Features that a task counts before it gives them on; words whose features a worker remembers.
HELD = 150_000
#: Groups of interchangeable identity terms, in the languages of the corpus. A parameter.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("mexican", "chinese", "american", "indian", "russian", "german", "french", "spanish"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "réfugiés"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "refugiados"),
)

_words = re.compile(r"[^\W\d_]+").findall
_sentences = re.compile(r"[^.!?\n]+").findall


def words_of(text: str | None) -> set[str]:
    return set(_words(text.lower())) if text else set()


def features_of(words: set[str]) -> set[str]:
    """The words, and the beginnings of those that are longer, marked by a caret."""
    return words.union(["^" + w[:k] for w in words for k in PREFIXES if len(w) > k])


@dataclass
class Model:
    intercept: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)  # words met -> the numbers of their features that have weights
    numbers: dict[str, int] = field(default_factory=dict)
    values: list[float] = field(default_factory=list)

    def features(self, word: str) -> tuple[int, ...]:
        if len(self.numbers) != len(self.weights):
            self.numbers, self.values = {f: i for i, f in enumerate(self.weights)}, list(self.weights.values())
        if len(self.known) > HELD:
            self.known.clear()
        found = self.known[word] = tuple([self.numbers[f] for f in features_of({word}) if f in self.numbers])
        return found

    def logit(self, text: str | None) -> float:
        known, found = self.known, set()
        for w in words_of(text):
            f = known.get(w)
            if f is None:
                f = self.features(w)
            if f:
                found.update(f)
        return self.intercept + math.fsum([self.values[i] for i in found])

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.logit(text)))))


def swaps(groups: tuple[tuple[str, ...], ...]) -> dict[str, tuple[str, ...]]:
    """For each identity term, those that may stand in its place."""
    return {t: tuple(o for o in group if o != t) for group in groups for t in group}


class Rows:
    """A sparse matrix by rows."""

    def __init__(self, rows: list, values: list | None = None):
        self.ends = np.cumsum([0, *map(len, rows)])
        self.at = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.empty(0, np.int64)
        self.values = np.concatenate(values) if values else np.ones(len(self.at))

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros(1), np.cumsum(w[self.at] * self.values)))
        return np.diff(total[self.ends])

    def back(self, v: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.at, np.repeat(v, np.diff(self.ends)) * self.values, n)


def fit_weights(rows: list, y: np.ndarray, changes: list[tuple[list[int], list[int], float]], n: int, l2: float = L2, fairness: float = FAIRNESS) -> np.ndarray:
    """Newton steps, each by conjugate gradients, on the log loss + l2/2 |w|^2 + fairness/2 * sum weight (w . (x - x'))^2. rows: feature numbers
    present; changes: feature numbers that a swap takes away and brings, and its weight; n: features. Returns the intercept, then the weights."""
    x = Rows([np.r_[0, np.asarray(r, np.int64) + 1] for r in rows])
    d = Rows([np.asarray([*gone, *come], np.int64) + 1 for gone, come, _ in changes], [np.r_[np.ones(len(gone)), -np.ones(len(come))] for gone, come, _ in changes])
    heavy = fairness * np.array([c[2] for c in changes])
    ridge = np.r_[1e-6, np.full(n, l2)]

    def loss(w: np.ndarray) -> float:
        z = x.dot(w)
        return float((np.logaddexp(0, z) - y * z).sum() + (ridge * w * w).sum() / 2 + (heavy * d.dot(w) ** 2).sum() / 2)

    w = np.zeros(n + 1)
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w), -500, 500)))
        gradient = x.back(p - y, n + 1) + ridge * w + d.back(heavy * d.dot(w), n + 1)
        curve = p * (1 - p)
        scale = x.back(curve, n + 1) + ridge + np.bincount(d.at, np.repeat(heavy, np.diff(d.ends)), n + 1)  # the diagonal
        step, rest = np.zeros(n + 1), gradient.copy()
        eased = rest / scale
        way, size = eased.copy(), float(rest @ eased)
        enough = size * min(0.01, size)  # far from the minimum a rough step does
        for _ in range(100):
            if size <= enough or size <= 1e-24:
                break
            image = x.back(curve * x.dot(way), n + 1) + ridge * way + d.back(heavy * d.dot(way), n + 1)
            length = size / float(way @ image)
            step += length * way
            rest -= length * image
            eased = rest / scale
            size, before = float(rest @ eased), size
            way = eased + size / before * way
        t = 1.0
        while t > 1e-6 and loss(w - t * step) > now - 1e-4 * t * float(gradient @ step):
            t /= 2
        if t <= 1e-6:
            break
        w = w - t * step
        now = loss(w)
        if np.abs(t * step).max() < 1e-6:
            break
    return w


def changes_of(text: str | None, features: dict[str, int], identity: dict[str, tuple[str, ...]]) -> Iterator[tuple[tuple[int, ...], tuple[int, ...], float]]:
    """The features that each swap in each sentence takes away and brings, with its weight."""
    for sentence in _sentences(text.lower()) if text else ():
        words = set(_words(sentence))
        for term in sorted(words & identity.keys()):
            here = features.keys() & features_of(words)
            for other in identity[term]:
                there = features.keys() & features_of((words - {term}) | {other})
                if here != there:
                    yield tuple(sorted(features[f] for f in here - there)), tuple(sorted(features[f] for f in there - here)), 1 / len(identity[term])


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, groups=IDENTITY_TERMS, train_on=None, fairness: float = FAIRNESS) -> Model:
    """labels: doc_id and toxic. train_on: a condition on doc_id for the labels to learn from."""
    chosen = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("__y")).dropna()
    if train_on is not None:
        chosen = chosen.where(train_on)
    chosen = chosen.groupBy("doc_id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # at most max_train rows of two numbers: a proven bound for a broadcast
    sample = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("__y").alias("y"), "text"), "toxicity-train")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def drain():
            for y, counter in enumerate(held):
                names, counts = list(counter), list(counter.values())
                for low in range(0, len(names), 50_000):
                    n = pa.array(counts[low : low + 50_000], pa.int64())
                    none = pa.array(np.zeros(len(n), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(names[low : low + 50_000], pa.string()), n if y else none, none if y else n], names=["word", "positive", "negative"])
                counter.clear()

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[int(y == 1)].update(features_of(words_of(text)))
                if len(held[0]) + len(held[1]) > HELD:
                    yield from drain()
        yield from drain()

    totals = sample.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") != 1)).first()
    positives, negatives = totals
    if not positives or not negatives:
        unstage(sample)
        share = positives / (positives + negatives) if positives + negatives else 0.0
        return Model(math.log((share + 1e-9) / (1 - share + 1e-9)))
    identity = swaps(groups)
    words = map_arrow(sample, count, "word string, positive long, negative long").groupBy("word").agg(F.sum("positive").alias("p"), F.sum("negative").alias("n"))
    absent = [F.lit(positives) - F.col("p"), F.lit(negatives) - F.col("n")]
    share = (F.col("p") + F.col("n")) / F.lit(positives + negatives)
    g2 = F.lit(0.0)
    for seen, expected in ((F.col("p"), share * positives), (F.col("n"), share * negatives), (absent[0], (1 - share) * positives), (absent[1], (1 - share) * negatives)):
        g2 = g2 + F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    top = words.where((g2 >= LEAST_G2) | F.col("word").isin(sorted(identity))).select("word").toArrow()
    features = {word: i for i, word in enumerate(sorted(top.column("word").to_pylist()))}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Sink(y=pa.int32(), present=pa.list_(pa.int32()))
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sink.add(y, sorted(features[f] for f in features.keys() & features_of(words_of(text))), size=400):
                    yield from sink.drain()
        yield from sink.drain()

    def swapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        sink = Sink(gone=pa.list_(pa.int32()), come=pa.list_(pa.int32()), weight=pa.float64())
        for batch in batches:
            for text in batch.column(1).to_pylist():
                for gone, come, weight in changes_of(text, features, identity):
                    held[gone, come] += weight
        for (gone, come), weight in held.items():
            if sink.add(gone, come, weight):
                yield from sink.drain()
        yield from sink.drain()

    rows = map_arrow(sample, vectors, "y int, present array<int>").toArrow()
    changed = map_arrow(sample, swapped, "gone array<int>, come array<int>, weight double").groupBy("gone", "come").agg(F.sum("weight").alias("weight")).toArrow()
    unstage(sample)
    changes = sorted(zip(*(changed.column(c).to_pylist() for c in ("gone", "come", "weight")), strict=True))
    w = fit_weights([r.values.to_numpy() for r in rows.column("present")], (rows.column("y").to_numpy() == 1).astype(float), changes, len(features), fairness=fairness)
    return Model(float(w[0]), {t: float(w[i + 1]) for t, i in features.items()})


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), as_name: str = "score") -> DataFrame:
    """The columns of `keep` and the score of the whole text. No shuffle; the model is one weight a feature."""
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    at, kept = source.columns.index("text"), [source.columns.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(scores, pa.float64())], names=[*keep, as_name])

    types = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    return map_arrow(source, run, f"{types}`{as_name}` double")


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), train_on=remainder(3) != 1)
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, with all their columns, without those that the classifier scores THRESHOLD or more."""
    (name,) = fresh(docs.columns, "score")
    return score(docs, train(docs, labels), keep=tuple(docs.columns), as_name=name).where(F.col(name) < THRESHOLD).drop(name)
