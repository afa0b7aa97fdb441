"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

One weight per feature (a word, or the first letters of one) is shared by all thresholds: P(grade >= k) = sigmoid(w.x - theta_k), with
rising thetas. Labels are whole numbers, zero or below for clean texts; the different ones above zero are the grades 1, 2, ... in
their order, so labels of 0 and 1 give one threshold. The features are those whose document frequency tells clean and other texts apart most, by the pooled
two-proportion z, which does not punish words that no document of a class holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import by_bytes, text_function
from .langid import letters_only
from .sampling import fold, labelled_sample
from .store import materialize
from .tokens import coded_words

#: Words kept at most and the least documents that hold one.
FEATURES, LEAST_DOCS = 4_096, 8
STEPS, RATE, DECAY = 400, 0.1, 3e-4
#: How much more it costs to call a share of clean documents toxic than to miss the same share of toxic ones.
CLEAN_COSTS = 2.0


@dataclass
class ToxicityModel:
    words: list[str]
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, strength: np.ndarray) -> np.ndarray:
        """P(grade >= k) by document and k = 1, 2, ... up to the highest grade."""
        return 1 / (1 + np.exp(-np.clip(strength[:, None] - self.thresholds, -40, 40)))


def features(word: str) -> tuple[str, ...]:
    """The word and its first four and five letters, which its inflections share."""
    return (word, word[:4] + "*", word[:5] + "*")


def coded_features(texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A number for the document and feature of every occurrence, and the features."""
    codes, words, begins = coded_words(letters_only(pc.utf8_lower(texts.fill_null(""))))
    names = {f: i for i, f in enumerate(dict.fromkeys(f for w in words for f in features(w)))}
    of = np.array([[names[f] for f in features(w)] for w in words], dtype=np.int64).reshape(-1, 3)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    pair = (owner[:, None] * max(1, len(names)) + of[codes]).ravel() if len(codes) else np.zeros(0, np.int64)
    return pair, list(names)


def hits(texts: pa.Array, id_of: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, feature and count of every model feature that a document holds."""
    codes, words, begins = coded_words(letters_only(pc.utf8_lower(texts.fill_null(""))))
    of = np.array([[id_of.get(f, -1) for f in features(w)] for w in words], dtype=np.int64).reshape(-1, 3)
    some = (of >= 0).any(axis=1)
    at = np.flatnonzero(some[codes]) if len(codes) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[at]
    feature = of[codes[at]] if len(at) else np.zeros((0, 3), np.int64)
    doc = np.repeat(owner[:, None], 3, axis=1)[feature >= 0]
    size = max(1, len(id_of))
    pair, n = np.unique(doc * size + feature[feature >= 0], return_counts=True)
    return pair // size, pair % size, n


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice's features the number of clean and of toxic documents that hold them."""
    for b in by_bytes(batches, "text"):
        pair, names = coded_features(b.column("text"))
        size = max(1, len(names))
        pair = np.unique(pair)
        toxic = (b.column("label").to_numpy() > 0)[pair // size]
        n = [np.bincount((pair % size)[toxic == t], minlength=len(names)) for t in (False, True)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n[0]), pa.array(n[1])], names=["word", "n0", "n1"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 8_000, folds: int = 5, held_out: int = 0) -> ToxicityModel | None:
    """Fit on about ``rows`` labelled documents, as many of each label, outside fold ``held_out``; None without clean and other ones.

    The driver gets at most FEATURES words that at least LEAST_DOCS documents of the sample hold, those that part the labels best, and the features of ``rows`` documents; ``label``
    is a closed set of grades. The thresholds are moved so that probability 0.5 is where toxic and clean documents part best, as models of four fifths of the sample tell of the fifth.
    """
    sample = materialize(labelled_sample(docs, labels, label, rows, folds, held_out), "toxicity-sample")
    total = {bool(r["label"]): r["n"] for r in sample.groupBy((F.col("label") > 0).alias("label")).agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return None
    of0, of1 = float(total[False]), float(total[True])
    share = (F.col("n0") + F.col("n1")) / (of0 + of1)
    error = F.sqrt(share * (1 - share) * (1 / of0 + 1 / of1))
    z = F.when(error > 0, (F.col("n1") / of1 - F.col("n0") / of0) / error).otherwise(0.0)  # all documents hold the word: no difference
    found = (
        sample.select("text", "label").mapInArrow(_frequencies, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .filter(F.col("n0") + F.col("n1") >= LEAST_DOCS).withColumn("z", z)
        .orderBy(F.abs("z").desc(), "word").limit(FEATURES).toPandas()
    )
    words = found["word"].tolist()
    id_of = {w: i for i, w in enumerate(words)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            doc, feature, _ = hits(b.column("text"), id_of)
            cut = np.searchsorted(doc, np.arange(1, b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([x.tolist() for x in np.split(feature, cut)], pa.list_(pa.int32()))], names=["doc_id", "label", "f"])

    got = sample.select(F.col("doc_id").cast("string").alias("doc_id"), "label", "text").mapInArrow(counted, "doc_id string, label int, f array<int>")
    got = got.toPandas().sort_values("doc_id").reset_index(drop=True)
    row = np.repeat(np.arange(len(got)), got["f"].map(len))
    col = np.concatenate([*got["f"], []]).astype(np.int64)
    values = got["label"].to_numpy()
    grade = np.searchsorted(np.unique(values[values > 0]), values, side="right")
    whole = train(words, row, col, grade)
    # each fifth of the sample is graded by a model of the rest; where these strengths part clean from toxic best is probability 0.5
    part = np.array([zlib.crc32(f"part {i}".encode()) % 5 for i in got["doc_id"]], dtype=np.int64)
    strength = np.zeros(len(grade))
    for k in range(5):
        kept = part != k
        if len(np.unique(grade[kept])) < len(np.unique(grade)):
            return whole
        rest = train(words, (np.cumsum(kept) - 1)[row[kept[row]]], col[kept[row]], grade[kept])
        strength[~kept] = (np.bincount(row, rest.weights[col], minlength=len(grade)) - rest.thresholds[0])[~kept]
    whole.thresholds += best_cut(strength, grade > 0)
    return whole


def best_cut(strength: np.ndarray, toxic: np.ndarray) -> float:
    """The strength from which on documents are called toxic so that the share of toxic ones caught less CLEAN_COSTS times that of clean ones is highest, halfway between two documents; of equal ones that nearest to 0."""
    order = np.argsort(-strength, kind="stable")
    s, y = strength[order], toxic[order].astype(float)
    gain = np.cumsum(y) / max(1.0, y.sum()) - CLEAN_COSTS * np.cumsum(1 - y) / max(1.0, (1 - y).sum())
    last = np.append(s[1:] < s[:-1], True)  # documents of equal strength fall on one side
    cuts = np.append((s[:-1] + s[1:]) / 2, s[-1] - 1.0)
    best = np.flatnonzero(last & (gain >= gain[last].max() - 1e-12))
    return float(cuts[best[np.abs(cuts[best]).argmin()]])


def train(words: list[str], row: np.ndarray, col: np.ndarray, grade: np.ndarray) -> ToxicityModel:
    """Adam on the log loss of all thresholds, every grade weighing alike; the thetas are a first one and positive steps to the next ones.

    ``row`` and ``col`` name the document and feature of each hit, ``grade`` (0, 1, ...) is by document.
    """
    grades = int(grade.max(initial=1))
    params = [np.zeros(len(words)), np.zeros(grades)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    target = grade[:, None] >= np.arange(1, grades + 1)
    counts = np.bincount(grade, minlength=grades + 1)
    weight = (1 / (np.count_nonzero(counts) * np.maximum(counts, 1)))[grade][:, None]

    def cuts(theta: np.ndarray) -> np.ndarray:
        return theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])

    for t in range(1, STEPS + 1):
        w, theta = params
        s = np.bincount(row, w[col], minlength=len(grade))
        d = (ToxicityModel(words, w, cuts(theta)).at_least(s) - target) * weight
        back = d.sum(axis=1)
        later = -np.cumsum(d.sum(axis=0)[::-1])[::-1]  # a step moves its own threshold and all above it
        grads = [np.bincount(col, back[row], minlength=len(words)) + DECAY * w, later * np.concatenate([[1.0], np.exp(theta[1:])])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-9)
    return ToxicityModel(words, params[0], cuts(params[1]))


def grader(docs: DataFrame, model: ToxicityModel | None) -> Callable[[Column], Column]:
    """A function of a text column: struct of ``score``, ``expected_severity``, ``grade`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[pa.Array], pa.Array]:
        m = shared.value
        id_of = {w: i for i, w in enumerate(m.words)} if m else {}

        def run(texts: pa.Array) -> pa.Array:
            p = np.zeros((len(texts), 1))
            if m:
                doc, feature, _ = hits(texts, id_of)
                p = m.at_least(np.bincount(doc, m.weights[feature], minlength=len(texts)) if len(doc) else np.zeros(len(texts)))
            grade = (p >= 0.5).sum(axis=1).astype(np.int32)
            return pa.StructArray.from_arrays(
                [pa.array(p[:, 0]), pa.array(p.sum(axis=1)), pa.array(grade), pa.array((grade > 0).astype(np.int32))], names=["score", "expected_severity", "grade", "predicted"])

        return run

    return text_function("score double, expected_severity double, grade int, predicted int", start)


def predict(docs: DataFrame, model: ToxicityModel | None, keep: tuple[str, ...] = ("doc_id",), folds: int = 5, held_out: int = 0) -> DataFrame:
    """``keep`` columns, ``held_out``, ``score`` (P(grade >= 1)), ``expected_severity`` (0 to the highest grade), ``grade`` and ``predicted``.

    Every row of ``docs`` is graded from its whole text. ``grade`` is the number of thresholds
    passed with probability 0.5, ``predicted`` is 1 if that is at least 1. Null and empty
    texts have no feature; without a model (no clean and other labels) all scores are 0. Repeated rows are each graded; other columns are
    left out, and columns of ``keep`` that have the name of a result are replaced by it.
    """
    results = ("held_out", "score", "expected_severity", "grade", "predicted")
    kept = [F.col(f"`{c}`") for c in keep if c not in results]
    p = grader(docs, model)(F.col("text"))
    return docs.select(*kept, (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), p.alias("__p")).select(*kept, "held_out", *[f"__p.{r}" for r in results[1:]])
