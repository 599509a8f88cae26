"""Toxicity by a counterfactual-regularised classifier.

A text's features are the words and word beginnings that it has; a logistic model scores them. Training texts that
name an identity group get counterfactual twins, in which the group's term is swapped for others of the same list;
beside the usual loss, the squared change of the model's output between a text and its twins is penalised, so that
a group's name alone moves the score little and neutral mentions aren't taken for toxicity.

The model is fitted on a bounded sample of labelled texts outside the held-out fold: at most PER_CLASS texts of
each label, those whose hashed ids are smallest. How common either label is is counted over all of them, and the
model's offset is corrected to that. Every text is scored whole, where it is; nothing but the sample is moved.

Defined results: null and empty texts have no features and get the score of the offset alone; unlabelled rows, and
labels other than 0 and 1, teach nothing; of several texts with one id the least is learned from; without labels of both kinds every score is the share of toxic labels (0
without any); texts of any length are read whole; repeated rows each get their own result; further columns are left
out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.holdout import held_out

#: Texts of each label in the training sample, features, and documents that a feature must be in.
PER_CLASS, FEATURES, MIN_TEXTS = 2500, 4096, 4
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
WORDS = re.compile(r"[^\W\d_]+")

#: Identity terms: within a list, terms can stand for each other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("disabled", "deaf", "blind", "autistic"),
    ("immigrants", "refugees", "natives", "citizens"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)


def text_words(text: str | None) -> set[str]:
    """The different words of a text, in lower case."""
    return set(WORDS.findall((text or "").lower()))


def word_features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def twins(words: set[str], terms: Iterable[tuple[str, ...]]) -> list[set[str]]:
    """The text's words with each identity term that it has swapped for each of the others in its list."""
    return [(words - {t}) | {u} for group in terms for t in group if t in words for u in group if u != t]


@dataclass
class Model:
    """weights of features, and the offset."""

    offset: float
    weights: dict[str, float] = field(default_factory=dict)

    def margins(self, texts: Iterable[str | None]) -> np.ndarray:
        """The log-odds of each text. Words recur, so those of a batch are looked up once."""
        weigh, known, found = self.weights.get, {}, []
        for text in texts:
            features: set[str] = set()
            for w in text_words(text):
                own = known.get(w)
                if own is None:
                    own = known[w] = tuple(x for x in word_features(w) if weigh(x))
                if own:
                    features.update(own)
            found.append(self.offset + sum(sorted(map(self.weights.__getitem__, features))))
        return np.array(found, dtype=np.float64)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -500, 500)))


def choose_features(texts: list[set[str]], labels: np.ndarray, terms: Iterable[tuple[str, ...]]) -> list[str]:
    """Identity terms that occur, and the features whose shares in the two classes differ most for their spread."""
    seen = {0: Counter(), 1: Counter()}
    for words, y in zip(texts, labels, strict=True):
        seen[int(y)].update({x for w in words for x in word_features(w)})
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    ranked = []
    for x in seen[0].keys() | seen[1].keys():
        a, b = seen[1][x], seen[0][x]
        if a + b >= MIN_TEXTS:
            share = (a + b) / (n0 + n1)
            ranked.append((-abs(a / n1 - b / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-9), x))
    named = [t for group in terms for t in group if seen[0][t] + seen[1][t]]
    return list(dict.fromkeys([*named, *(x for _, x in sorted(ranked)[:FEATURES])]))


def matrix(texts: list[set[str]], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the features that are there."""
    found = [sorted({place[x] for w in words for x in word_features(w) if x in place}) for words in texts]
    return np.repeat(np.arange(len(texts), dtype=np.int32), [len(f) for f in found]), np.fromiter((c for f in found for c in f), dtype=np.int32)


@dataclass
class Task:
    """What is minimised: the logistic loss of the rows, each times its weight, plus the penalty of all changes between
    rows and twins, plus the ridge. rows, columns: the features that the texts have; twin_rows, twin_columns: those of
    their twins, twin k being that of text origin[k]."""

    rows: np.ndarray
    columns: np.ndarray
    per_row: np.ndarray
    labels: np.ndarray
    origin: np.ndarray
    twin_rows: np.ndarray
    twin_columns: np.ndarray
    features: int
    penalty: float
    ridge: float

    def loss(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        """The loss, and its gradient by the weights and then the offset."""
        n, m, d = len(self.labels), len(self.origin), self.features
        z = np.bincount(self.rows, w[self.columns], n)
        found = float(self.per_row @ (np.logaddexp(0, z + b) - self.labels * (z + b))) + self.ridge * float(w @ w) / 2
        pull = (1 / (1 + np.exp(-z - b)) - self.labels) * self.per_row
        grad = np.bincount(self.columns, pull[self.rows], d) + self.ridge * w
        if m:
            change = z[self.origin] - np.bincount(self.twin_rows, w[self.twin_columns], m)
            found += self.penalty * float(change @ change)
            push = 2 * self.penalty * change
            grad += np.bincount(self.columns, np.bincount(self.origin, push, n)[self.rows], d) - np.bincount(self.twin_columns, push[self.twin_rows], d)
        return found, np.append(grad, pull.sum())


def fit(texts: list[str], labels: np.ndarray, *, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, prior: float | None = None, counterfactual: float = 5.0, ridge: float = 0.005, rounds: int = 300, rate: float = 0.1) -> Model:
    """The model that minimises the mean logistic loss of balanced classes, plus counterfactual times the mean squared
    change between texts and twins, plus ridge, by the root of the number of features, times half the squared weights; by Adam over all rows in each round.
    prior: share of label 1 to which the offset is corrected."""
    labels = np.asarray(labels, dtype=np.float64)
    n1 = labels.sum()
    if not 0 < n1 < len(labels):
        share = prior if prior is not None else (n1 / len(labels) if len(labels) else 0.0)
        return Model(float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    known: dict[str, str] = {}
    words = [{known.setdefault(w, w) for w in text_words(t)} for t in texts]  # each different word is held once
    del texts, known
    names = choose_features(words, labels, terms)
    place = {x: k for k, x in enumerate(names)}
    r, c = matrix(words, place)
    pairs = [(i, twin) for i, w in enumerate(words) for twin in twins(w, terms)]
    origin = np.array([i for i, _ in pairs], dtype=np.int64)
    tr, tc = matrix([t for _, t in pairs], place)
    n, m, d = len(labels), len(pairs), len(names)
    per_row = np.where(labels == 1, 0.5 / n1, 0.5 / (n - n1))
    task = Task(r, c, per_row, labels, origin, tr, tc, d, counterfactual / m if m else 0.0, ridge / max(d, 1) ** 0.5)
    w, b = np.zeros(d), 0.0
    mean, square = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, rounds + 1):
        _, g = task.loss(w, b)
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    if prior is not None:
        b += np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    return Model(float(b), {x: float(v) for x, v in zip(names, w, strict=True) if abs(v) > 1e-6})


def learn(documents: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", per_class: int = PER_CLASS, **options) -> Model:
    """A model from the labelled documents outside the held-out fold: at most per_class texts of each label reach the driver."""
    told = labels.select(F.col(id_column).alias("_id"), F.col(label_column).alias("label")).filter("_id is not null and label in (0, 1)")
    told = told.groupBy("_id").agg(F.max("label").alias("label")).filter(~held_out(F.col("_id")))
    shares = {x["label"]: x["count"] for x in told.groupBy("label").count().collect()}
    order = (F.xxhash64("_id"), F.col("_id"))
    chosen = None
    for y in (0, 1):
        part = told.filter(F.col("label") == y).orderBy(*order).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.select(F.col(id_column).alias("_doc"), F.col(text_column).alias("text")).filter("text is not null")
    sample = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "label").agg(F.min("text").alias("text"))  # 2 * per_class ids
    rows = sample.toPandas().sort_values("_id", kind="stable")
    total = sum(shares.values())
    return fit(rows["text"].tolist(), rows["label"].to_numpy(), prior=shares.get(1, 0) / total if total else 0.0, **options)


def score_column(model: Model, text: Column) -> Column:
    def judge(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts), index=texts.index, dtype="float64")

    return F.pandas_udf(judge, "double")(text)


def toxicity(documents: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD up) of every row."""
    model = learn(documents, labels, id_column=id_column, text_column=text_column, **options)
    held = documents.select(F.col(id_column).alias("doc_id"), held_out(F.col(id_column)).alias("held_out"), score_column(model, F.col(text_column)).alias("score"))
    return held.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def without_toxic(documents: DataFrame, labels: DataFrame, *, text_column: str = "text", **options) -> DataFrame:
    """The documents with all their columns, without those predicted toxic."""
    model = learn(documents, labels, text_column=text_column, **options)
    return documents.filter(score_column(model, F.col(text_column)) < THRESHOLD)
