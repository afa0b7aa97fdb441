"""Language identification by unigram pieces, summed over all segmentations of a word.

Each language has a probability for every piece of a fixed public vocabulary, taken as it
is published. Texts are runs of letters in their own case, each behind a start sign. A run's likelihood is
the sum over all ways to cut it into pieces, found by the forward algorithm in logarithms for
many runs, all their places and all languages at once; runs and pieces may have any length.
Where no piece reaches over a place, the sums on its two sides are independent, so a run falls
into stretches. The probabilities are fitted by expectation maximisation (forward and
backward sums) over word counts that Spark gathers.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import CACHE_BYTES, by_bytes, remembered, text_function
from .sampling import fold, place
from .store import materialize
from .tokens import coded_words, sums_by_text

#: Least probability of a letter that no piece holds, or of a piece unseen in a language.
FLOOR = 1e-7
#: Letters whose pieces are laid out at once; a longer run is laid out alone.
LETTERS = 1 << 17
START = "▁"
#: Places that one code point takes in the key of a step from a prefix to a longer one.
CODES = 1 << 21


def vocabulary(model_path: str) -> list[str]:
    """All pieces of a public sentencepiece model but its control, unknown and byte pieces, in the model's order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return list(dict.fromkeys(sp.id_to_piece(i) for i in ids))


def letters_only(texts: pa.Array) -> pa.Array:
    """Letters and their marks; everything else is a space."""
    return pc.replace_substring_regex(texts.fill_null(""), r"[^\pL\pM]+", " ")


@dataclass
class Lattice:
    """Pieces that lie in some words: where each starts and ends among all letters, and the stretches between cuts."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    word: np.ndarray  # of each piece
    first: np.ndarray  # where the stretch of each piece starts
    last: np.ndarray  # and ends
    stretch_end: np.ndarray  # of all stretches
    stretch_of_word: np.ndarray  # the first one of each word
    letters: int


@dataclass
class PieceModel:
    """Languages, pieces and their probabilities (pieces + 1 for unknown letters, by language)."""

    langs: list[str]
    pieces: list[str]
    prob: np.ndarray

    @functools.cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of all steps (prefix, next letter), the prefix each leads to, and the piece that a prefix is or -1."""
        node, steps, piece_of = {"": 0}, {}, {}
        for i, p in enumerate(self.pieces):
            for k in range(1, len(p) + 1):
                to = node.setdefault(p[:k], len(node))
                steps[node[p[: k - 1]] * CODES + ord(p[k - 1])] = to
            piece_of[node[p]] = i
        keys = np.array(sorted(steps) or [-1], dtype=np.int64)
        pieces = np.full(len(node), -1, dtype=np.int64)
        pieces[list(piece_of)] = list(piece_of.values())
        return keys, np.array([steps.get(k, 0) for k in keys.tolist()], dtype=np.int64), pieces

    def lattice(self, words: list[str]) -> Lattice:
        """All pieces in ``words``, which bring their start signs; a letter that is no piece counts as the unknown one."""
        keys, target, piece_of = self.trie
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        begins, n = np.cumsum(sizes) - sizes, len(codes)
        word = np.repeat(np.arange(len(words)), sizes)
        limit = np.repeat(begins + sizes, sizes)
        start, node, at = np.arange(n), np.zeros(n, np.int64), np.arange(n)
        found, single = [], np.zeros(n, bool)
        while len(start):
            key = node * CODES + codes[at]
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            on = keys[i] == key
            start, node, at = start[on], target[i[on]], at[on] + 1
            piece = piece_of[node]
            some = piece >= 0
            found.append((start[some], at[some], piece[some]))
            single[start[some & (at == start + 1)]] = True
            on = at < limit[start]
            start, node, at = start[on], node[on], at[on]
        other = np.flatnonzero(~single)
        found.append((other, other + 1, np.full(len(other), len(self.pieces))))
        start, end, piece = (np.concatenate([f[c] for f in found]) for c in range(3))
        wide = end - start > 1
        inside = np.cumsum(np.bincount(start[wide] + 1, minlength=n + 2) - np.bincount(end[wide], minlength=n + 2))[: n + 1] > 0
        cuts = np.flatnonzero(~inside)
        stretch = np.cumsum(~inside)[:n] - 1  # of each letter
        return Lattice(start, end, piece, word[start], cuts[stretch[start]], cuts[stretch[start] + 1], cuts[1:], stretch[begins], n)

    def _sums(self, order: np.ndarray, steps: np.ndarray, to: np.ndarray, base: Callable[[np.ndarray], np.ndarray], lp: np.ndarray, out: np.ndarray) -> None:
        """Adds up (in logarithms) what the pieces bring to the places ``to``, step by step from an end of the stretches."""
        steps, to = steps[order], to[order]
        bounds = np.searchsorted(steps, np.arange(1, steps[-1] + 2)) if len(steps) else np.zeros(1, np.int64)
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            value = base(order[a:z]) + lp[order[a:z]]
            first = np.flatnonzero(np.diff(to[a:z], prepend=-1))
            most = np.maximum.reduceat(value, first)
            value = np.exp(value - np.repeat(most, np.diff(np.append(first, z - a)), axis=0))
            out[to[a:z][first]] = most + np.log(np.add.reduceat(value, first))

    def forward(self, x: Lattice, lp: np.ndarray) -> np.ndarray:
        """By place the logarithm of the summed probability of what leads there from its stretch's start."""
        alpha = np.zeros((x.letters + 1, lp.shape[1]))
        steps = x.end - x.first
        inner = (x.start > x.first)[:, None]
        self._sums(np.lexsort((x.end, steps)), steps, x.end, lambda i: np.where(inner[i], alpha[x.start[i]], 0.0), lp, alpha)
        return alpha

    def backward(self, x: Lattice, lp: np.ndarray) -> np.ndarray:
        """The same from each place to its stretch's end."""
        beta = np.zeros((x.letters + 1, lp.shape[1]))
        steps = x.last - x.start
        inner = (x.end < x.last)[:, None]
        self._sums(np.lexsort((x.start, steps)), steps, x.start, lambda i: np.where(inner[i], beta[x.end[i]], 0.0), lp, beta)
        return beta

    def _parts(self, words: list[str]) -> Iterator[slice]:
        """Neighbouring words of about ``LETTERS`` letters."""
        if not words:
            return
        ends = np.cumsum([len(w) for w in words])
        starts = np.flatnonzero(np.diff((ends - 1) // LETTERS, prepend=-1)).tolist()
        yield from (slice(a, b) for a, b in zip(starts, [*starts[1:], len(words)], strict=True))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each run of letters, with its start sign, in each language."""
        out, log = np.zeros((len(words), len(self.langs))), np.log(self.prob)
        for part in self._parts(words):
            x = self.lattice(words[part])
            alpha = self.forward(x, log[x.piece])
            out[part] = np.add.reduceat(alpha[x.stretch_end], x.stretch_of_word)
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in each language; ``counts`` by word and language."""
        out, log = np.zeros_like(self.prob), np.log(self.prob)
        for part in self._parts(words):
            x = self.lattice(words[part])
            lp = log[x.piece]
            alpha, beta = self.forward(x, lp), self.backward(x, lp)
            ahead = np.where((x.start > x.first)[:, None], alpha[x.start], 0.0)
            after = np.where((x.end < x.last)[:, None], beta[x.end], 0.0)
            uses = np.exp(ahead + lp + after - alpha[x.last]) * counts[part][x.word]
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(x.piece, uses[:, j], minlength=len(out))
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice and language the counts of its distinct runs of letters."""
    for batch in by_bytes(batches, "text"):
        langs = np.array(batch.column("lang").to_pylist())
        codes, words, begins = coded_words(letters_only(batch.column("text")))
        owner = np.repeat(np.arange(len(langs)), np.diff(begins))
        for lang in sorted(set(langs.tolist())):
            n = np.bincount(codes[langs[owner] == lang], minlength=len(words))
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([START + words[i] for i in some]), pa.array(n[some], pa.int64())], names=["lang", "word", "n"])


def fit(docs: DataFrame, vocabulary_path: str, per_lang: int = 1_500, rounds: int = 3, folds: int = 4, held_out: int = 2) -> PieceModel:
    """Fit on about ``per_lang`` documents of each language (chosen by a digest of the id) outside fold ``held_out``.

    Only documents with text and language count. The driver holds pieces x languages numbers;
    ``lang`` is taken to be a closed set of labels, which may hold any characters.
    """
    train = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    counts = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, pieces = sorted(counts), vocabulary(vocabulary_path)
    model = PieceModel(langs, pieces, np.full((len(pieces) + 1, len(langs)), 1.0 / (len(pieces) + 1)))
    if not langs:
        return model
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(per_lang / n)).otherwise(share)
    cols = [f"c{j}" for j in range(len(langs))]
    sample = train.filter(place(F.col("doc_id")) < share).select("lang", "text")
    by_word = sample.mapInArrow(_counted, "lang string, word string, n long").groupBy("word")
    words = materialize(by_word.agg(*[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(c) for lang, c in zip(langs, cols, strict=True)]), "langid-words")
    for _ in range(rounds):
        def gathered(batches: Iterator[pa.RecordBatch], m: PieceModel = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(m.prob)
            for b in batches:
                if b.num_rows:
                    total += m.expected(b.column("word").to_pylist(), np.stack([b.column(c).to_numpy().astype(float) for c in cols], axis=1))
            some = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *[pa.array(total[some, j]) for j in range(len(cols))]], names=["piece", *cols])

        sums = words.mapInArrow(gathered, ", ".join(["piece long", *[f"{c} double" for c in cols]])).groupBy("piece").agg(*[F.sum(F.round(c, 6)).alias(c) for c in cols]).toPandas()
        total = np.zeros_like(model.prob)
        total[sums["piece"].to_numpy(), :] = sums[cols].to_numpy()
        prob = (total + 0.01) / (total + 0.01).sum(axis=0)
        model = PieceModel(langs, pieces, np.maximum(prob, FLOOR))
    return model


class Scorer:
    """Scores slices of texts with a model and remembers the words it has seen."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.row_of: dict[str, int] = {}
        self.rows, self.held = np.zeros((1 << 12, len(self.model.langs))), 0

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of the words, of known ones from memory."""
        at = np.array([self.row_of.get(w, -1) for w in words], dtype=np.int64)
        out, new = self.rows[at], np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new]
            out[new] = self.model.word_scores([START + w for w in fresh])
            self.held += remembered(fresh, 8 * out.shape[1])
            if self.held > CACHE_BYTES:
                self.forget()
            else:
                base = len(self.row_of)
                while base + len(fresh) > len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[base : base + len(fresh)] = out[new]
                self.row_of.update((w, base + i) for i, w in enumerate(fresh))
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability (equal priors) of each whole text."""
        codes, words, begins = coded_words(letters_only(texts))
        some = np.asarray(pc.match_substring_regex(texts.fill_null(""), r"\pL"))
        if not self.model.langs:
            return ["und"] * len(some), np.zeros(len(some))
        total = sums_by_text(self.scores(words)[codes] if len(codes) else np.zeros((0, len(self.model.langs))), begins)
        best = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        score = odds[np.arange(len(best)), best] / odds.sum(axis=1)
        return [self.model.langs[b] if s else "und" for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0)


def recognizer(docs: DataFrame, model: PieceModel) -> Callable[[Column], Column]:
    """A function of a text column: struct of ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[pa.Array], pa.Array]:
        scorer = Scorer(shared.value)

        def run(texts: pa.Array) -> pa.Array:
            langs, score = scorer.predict(texts)
            return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

        return run

    return text_function("lang_pred string, score double", start)


def predict(docs: DataFrame, model: PieceModel, keep: tuple[str, ...] = ("doc_id",), folds: int = 4, held_out: int = 2) -> DataFrame:
    """``keep`` columns, ``held_out``, ``lang_pred`` and ``score`` for every row of ``docs``, from its whole text alone.

    Texts that are null or hold no letter (marks alone are none), and all texts if there was nothing to learn from,
    are ``und`` with score 0. Repeated rows are each scored; other columns are left out, and
    columns of ``keep`` that have the name of a result are replaced by it.
    """
    results = ("held_out", "lang_pred", "score")
    p = recognizer(docs, model)(F.col("text"))
    kept = [F.col(f"`{c}`") for c in keep if c not in results]
    return docs.select(*kept, (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), p.alias("__p")).select(*kept, "held_out", "__p.lang_pred", "__p.score")
