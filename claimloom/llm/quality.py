"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every symbol has a sparse index vector of +1 and -1 (from a digest). A symbol's context vector
sums the index vectors of its neighbours in all documents; documents pool the vectors of their symbols. A
network of two layers, trained by numpy, gives a probability; a temperature fitted on rows
that training didn't see calibrates it.
A word gives two symbols: its letters and its shape (THE!! -> A!, thing. -> a.); a word equal to
the one before it has a shape of its own.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import by_bytes, text_function
from .probminhash import mix
from .sampling import fold, labelled_sample
from .store import materialize
from .tokens import coded_words, sums_by_text

#: Symbols share this many context vectors of so many numbers; an index vector has this many non-zeros.
BUCKETS, DIM, NONZEROS, WINDOW = 1 << 15, 32, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.004, 1e-4
#: Bytes of text pooled at once, as a slice holds DIM numbers for each word.
SLICE = 1 << 20
REPEATED = zlib.crc32(b"\x00repeated") % BUCKETS

#: Base of the digests of sequences of code points.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _code_points() -> np.ndarray:
    """Three columns by code point, filled in as code points are met: known or not, its lower-case letter or 0, its sign in a shape."""
    return np.zeros((3, 0x110000), np.uint32)


def _classify(codes: np.ndarray) -> None:
    table = _code_points()
    for code in np.unique(codes[table[0, codes] == 0]).tolist():
        c = chr(code)
        sign = "A" if c.isupper() or c.istitle() else "a" if c.isalpha() else "0" if c.isdigit() else c
        table[:, code] = 1, ord(c.lower()[0]) if c.isalpha() else 0, ord(sign)


def _digests(codes: np.ndarray, owner: np.ndarray, words: int, seed: int) -> np.ndarray:
    """A bucket for each word's sequence of codes; ``owner`` (rising) is the word of each."""
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    power = np.cumprod(np.full(int(nth.max(initial=0)) + 1, GOLDEN | np.uint64(1)))
    total = np.full(words, seed, np.uint64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    if len(first):
        total[owner[first]] += np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * power[nth], first)
    return ((mix(total) >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64)


def symbols_of(words: list[str]) -> np.ndarray:
    """Buckets of the letters and of the whole shape of every word: runs of one sign count as one there."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    _classify(codes)
    _, lower, sign = _code_points()
    letter, shape = lower[codes], sign[codes]
    some = letter > 0
    new = np.ones(len(codes), bool)
    new[1:] = (shape[1:] != shape[:-1]) | (owner[1:] != owner[:-1])
    return np.stack([_digests(letter[some], owner[some], len(words), 1), _digests(shape[new], owner[new], len(words), 2)], axis=1)


def symbols(word: str) -> tuple[int, int]:
    """Buckets of one word's letters and shape."""
    return tuple(symbols_of([word])[0].tolist())


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two symbols for each word of a slice of texts, and where each text begins."""
    codes, words, begins = coded_words(texts)
    out = symbols_of(words)[codes] if len(codes) else np.zeros((0, 2), np.int64)
    same = np.zeros(len(codes), bool)
    same[1:] = codes[1:] == codes[:-1]
    same[begins[:-1][np.diff(begins) > 0]] = False
    out[same, 1] = REPEATED
    return out, begins


def index_vectors() -> np.ndarray:
    """Every bucket's index vector: NONZEROS of +1 or -1 at places that may coincide, else zero."""
    rng = np.random.default_rng(20240229)
    place, sign = rng.integers(0, DIM, (BUCKETS, NONZEROS)), rng.choice([-1, 1], (BUCKETS, NONZEROS))
    out = np.zeros((BUCKETS, DIM), np.int8)
    np.add.at(out, (np.arange(BUCKETS)[:, None], place), sign.astype(np.int8))
    return out


def contexts(slices: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sum of the index vectors of all neighbours within the window, letters with letters and shapes with shapes."""
    index = np.concatenate([index_vectors(), np.zeros((1, DIM), np.int8)])  # the last one stands between documents
    out = np.zeros((BUCKETS, DIM), np.int64)
    for syms, begins in slices:
        if not len(syms):
            continue
        at = np.arange(len(syms)) + WINDOW * (1 + np.repeat(np.arange(len(begins) - 1), np.diff(begins)))
        for side in (0, 1):
            row = np.full(at[-1] + WINDOW + 1, BUCKETS, np.int64)
            row[at] = syms[:, side]
            vectors = index[row]
            near = sum((vectors[at + step] for step in range(-WINDOW, WINDOW + 1) if step), np.zeros((len(at), DIM), np.int8))
            order = np.argsort(syms[:, side].astype(np.uint16), kind="stable")
            bucket = syms[order, side]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            out[bucket[first]] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)
    return out


@dataclass
class QualityModel:
    """Word vectors, the pooled features' mean and spread, two layers and the temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        hidden = np.tanh((pooled - self.mean) / self.spread @ w1 + b1)
        return 1 / (1 + np.exp(-np.clip((hidden @ w2 + b2) / self.temperature, -40, 40)))


def pooled(vectors: np.ndarray, syms: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Mean vector of a document's letters and of its shapes, and the log of its number of words."""
    n = np.maximum(np.diff(begins), 1)[:, None]
    sides = [sums_by_text(vectors[syms[:, s]], begins) / n for s in (0, 1)]
    return np.concatenate([*sides, np.log1p(np.diff(begins))[:, None]], axis=1)


def unit(counts: np.ndarray) -> np.ndarray:
    """Context vectors of length 1, each with a share of the symbol's own index vector."""
    own = index_vectors().astype(float)
    size = lambda x: np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return (counts / size(counts.astype(float)) + own / size(own)).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[np.ndarray, ...]:
    """Two layers by Adam on the log loss, classes weighted alike."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            at = order[a : a + BATCH]
            h = np.tanh(x[at] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[at]) / len(at)
            back = d[:, None] * p[2] * (1 - h * h)
            grads = [x[at].T @ back + DECAY * p[0], back.sum(0), h.T @ d + DECAY * p[2], d.sum(keepdims=True)]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def context_counts(docs: DataFrame) -> np.ndarray:
    """Context sums of all buckets over all of ``docs``: each task adds up its texts, so at most BUCKETS rows leave it."""
    cols = [f"c{j}" for j in range(DIM)]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = contexts(coded(b.column("text")) for b in by_bytes(batches, "text", SLICE))
        some = np.flatnonzero(counts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *[pa.array(counts[some, j]) for j in range(DIM)]], names=["bucket", *cols])

    sums = docs.select("text").mapInArrow(summed, ", ".join(["bucket long", *[f"{c} long" for c in cols]])).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()
    counts = np.zeros((BUCKETS, DIM), np.int64)
    counts[sums["bucket"].to_numpy(np.int64)] = sums[cols].to_numpy(np.int64)
    return counts


def fit(docs: DataFrame, labels: DataFrame, rows: int = 8_000, folds: int = 5, held_out: int = 0) -> QualityModel | None:
    """Word vectors from all texts; the network on about ``rows`` labelled documents, half of each class, outside fold ``held_out``.

    None without both classes. The bound keeps what the driver gets fixed: ``rows`` pooled vectors and BUCKETS context vectors.
    """
    sample = materialize(labelled_sample(docs, labels, "quality", rows, folds, held_out).coalesce(6), "quality-sample")
    classes = sample.agg(F.countDistinct(F.col("label") > 0)).head()[0]
    if classes < 2:
        return None
    vectors = unit(context_counts(docs))
    got = score_rows(sample, vectors).toPandas().sort_values("doc_id")
    x, y = np.stack(got["pooled"].to_numpy()), (got["label"].to_numpy() > 0).astype(float)
    apart = np.arange(len(x)) % 5 == 0  # for the temperature
    if len(set(y[~apart])) < 2:
        apart[:] = False
    mean, spread = x[~apart].mean(0), x[~apart].std(0) + 1e-6
    layers = train((x[~apart] - mean) / spread, y[~apart])
    best, least = 1.0, np.inf
    for t in np.geomspace(0.25, 8, 41) if apart.any() else ():
        p = QualityModel(vectors, mean, spread, layers, t).probability(x[apart])
        loss = -np.mean(np.log(np.where(y[apart] > 0, p, 1 - p) + 1e-12))
        if loss < least:
            best, least = float(t), loss
    return QualityModel(vectors, mean, spread, layers, best)


def score_rows(sample: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, label and pooled vector of the sampled rows."""
    shared = sample.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", SLICE):
            x = pooled(shared.value, *coded(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "pooled"])

    return sample.select(F.col("doc_id").cast("string").alias("doc_id"), "label", "text").mapInArrow(run, "doc_id string, label int, pooled array<double>")


def scorer(docs: DataFrame, model: QualityModel | None, threshold: float = 0.3) -> Callable[[Column], Column]:
    """A function of a text column: struct of ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[pa.Array], pa.Array]:
        m = shared.value

        def run(texts: pa.Array) -> pa.Array:
            syms, begins = coded(texts)
            p = m.probability(pooled(m.vectors, syms, begins)) if m else np.full(len(texts), 0.5)
            p = np.where(np.diff(begins) > 0, p, 0.0)
            return pa.StructArray.from_arrays([pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["score", "predicted"])

        return run

    return text_function("score double, predicted int", start, SLICE)


def predict(docs: DataFrame, model: QualityModel | None, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",), folds: int = 5, held_out: int = 0) -> DataFrame:
    """``keep`` columns, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``, from its whole text alone.

    Texts that are null or have no word score 0. Without a model (no labels of both
    classes) every other text scores 0.5. Repeated rows are each scored; other columns are left out, and
    columns of ``keep`` that have the name of a result are replaced by it.
    """
    results = ("held_out", "score", "predicted")
    kept = [F.col(f"`{c}`") for c in keep if c not in results]
    p = scorer(docs, model, threshold)(F.col("text"))
    return docs.select(*kept, (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), p.alias("__p")).select(*kept, "held_out", "__p.score", "__p.predicted")
