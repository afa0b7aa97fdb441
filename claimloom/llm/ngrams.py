"""Smoothed n-grams as a weighted backoff automaton.

Tokens are the words of a text, A-Z in lower case, and one end. A state is a known sequence of
up to ``order`` - 1 words; it has an arc for every word that followed it in training, weighted with the
smoothed log-probability, and a failure arc, weighted with the log of what is left for other words, to
the state without its first word. A text is read once from left to right: a word without an arc
takes failure arcs until there is one; the root has an arc for every word.

Smoothing is Bayesian: p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), where h' is h without its first word
and p(w) the additive base. So both kinds of arc need only counts, and m, one for each length, is where
the expected share of unseen continuations equals the share of n-grams seen once.

No task holds the model. Texts are packed once into chunks of a few MB of numbered words. A chunk
deals its distinct n-grams with their counts, packed and sorted, to buckets by ranges of the hash; a bucket adds up all
chunks and answers each with what the others counted, in the order in which the chunk asked; a
chunk then builds the part of the automaton that its texts can reach. An n-gram is at most one entry
per chunk, so a frequent one doesn't fill a bucket. N-grams are told apart by 63-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .batches import by_bytes
from .sampling import fold
from .store import materialize, release

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20
#: N-grams that a bucket holds, about, before its chunks' entries are added up.
BUCKET_GRAMS = 2_000_000
#: Tokens of a piece of a text that is read in one go; the next piece starts in the state that the last words lead to.
PIECE = 4096
#: Classes of counts in a factor of two, for the shares of unseen continuations.
STEPS = 8

_CODEC = "zstd"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _packed(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpacked(b: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], decompressed_size=n, codec=_CODEC, asbytes=True), dtype=kind)


def _packed_sorted(a: np.ndarray) -> bytes:
    """Rising 64-bit numbers as their steps, bytes of like weight side by side."""
    steps = np.diff(a, prepend=np.uint64(0))
    return _packed(steps.view(np.uint8).reshape(-1, 8).T)


def _unpacked_sorted(b: bytes) -> np.ndarray:
    planes = _unpacked(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A scrambling of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code of every token, hashes of the distinct ones (the end comes last), number of tokens of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    begins = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    begins, codes, words = begins - begins[0], np.asarray(flat.indices), flat.dictionary.to_pylist()
    if "" in words:
        empty = words.index("")
        keep = codes != empty
        begins = np.concatenate([[0], np.cumsum(keep)])[begins]
        codes = codes[keep]
        codes = codes - (codes > empty)
        del words[empty]
    lengths = np.diff(begins)
    out = np.full(len(codes) + len(lengths), len(words), dtype=np.int32)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(lengths)), lengths)] = codes
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)) & ~np.uint64(1)
    return out, np.append(hashes, np.uint64(1)), (lengths + 1).astype(np.int32)


class Grams:
    """The distinct n-grams of a chunk: by length, their hashes, last words, shorter n-grams and counts in training texts."""

    def __init__(self, codes: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, train: np.ndarray, order: int):
        self.codes, self.begins = codes.astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])
        here = np.repeat(train, lengths)
        place = np.arange(len(codes)) - np.repeat(self.begins[:-1], lengths)
        width = len(hashes)
        self.hashes, self.last, self.history, self.shorter, self.counts = [hashes], [np.arange(width)], [None], [None], [np.bincount(codes[here], minlength=width)]
        ids = self.codes
        for n in range(1, order):
            at = np.flatnonzero(place >= n)
            keys, first, inverse = np.unique(ids[at - 1] * width + self.codes[at], return_index=True, return_inverse=True)
            history, last = keys // width, keys % width
            shorter = ids[at[first]]
            gram = _mixed(self.hashes[-1][history] * _ODD + np.uint64(n) + self.hashes[0][last])
            self.hashes.append((gram & ~np.uint64(1)) | (last == width - 1).astype(np.uint64))
            self.last.append(last)
            self.history.append(history)
            self.shorter.append(shorter)
            self.counts.append(np.bincount(inverse[here[at]], minlength=len(keys)))
            ids = np.full(len(codes), -1, dtype=np.int64)
            ids[at] = inverse


class Automaton:
    """States, arcs and failure arcs for all n-grams of a chunk, by their counts in the whole training text."""

    def __init__(self, grams: Grams, base: Callable[[np.ndarray], np.ndarray], priors: list[float]):
        self.width, end = len(grams.hashes[0]), len(grams.hashes[0]) - 1
        known = [c > 0 for c in grams.counts]
        logs = [base(grams.counts[0])]
        # state 0 is the root; then known n-grams that can be continued, shorter ones first
        states, total = [], 1
        for n in range(len(known) - 1):
            open_ = known[n] & (grams.last[n] != end)
            states.append(np.where(open_, total - 1 + np.cumsum(open_), 0))
            total += int(open_.sum())
        self.fail, self.fail_log = np.zeros(total, dtype=np.int64), np.zeros(total)
        keys, targets, weights = [grams.last[0]], [states[0] if states else np.zeros(self.width, dtype=np.int64)], [logs[0]]
        for n in range(1, len(known)):
            m, before = priors[n - 1], grams.counts[n - 1][grams.history[n]].astype(np.float64)
            logs.append(np.log10((grams.counts[n] + m * 10.0 ** logs[n - 1][grams.shorter[n]]) / (before + m)))
            k = known[n]
            keys.append(states[n - 1][grams.history[n][k]] * self.width + grams.last[n][k])
            targets.append((states[n] if n < len(states) else states[n - 1][grams.shorter[n]])[k])
            weights.append(logs[n][k])
            live = states[n - 1] > 0
            self.fail_log[states[n - 1][live]] = np.log10(m / (grams.counts[n - 1][live] + m))
            if n > 1:
                self.fail[states[n - 1][live]] = states[n - 2][grams.shorter[n - 1][live]]
        keys, targets, weights = map(np.concatenate, (keys, targets, weights))
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.targets, self.weights, self.order = keys[by_key], targets[by_key], weights[by_key], len(known)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the log-probabilities of words read in these states."""
        log = np.zeros(len(state))
        to = np.zeros(len(state), dtype=np.int64)
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo] * self.width + word[todo]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            done, arc = todo[hit], arc[hit]
            log[done] += self.weights[arc]
            to[done] = self.targets[arc]
            todo = todo[~hit]
            if len(todo):
                log[todo] += self.fail_log[state[todo]]
                state = state.copy()
                state[todo] = self.fail[state[todo]]
        return to, log

    def read(self, codes: np.ndarray, begins: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """Log-probability of every text: all are read side by side, a word of each at a time.

        A piece that isn't a text's first starts in the state that the ``order`` - 1 words before it lead to; longer
        histories have no states.
        """
        sizes = np.diff(begins)
        pieces = np.maximum(1, -(-sizes // piece))
        owner = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begins[:-1][owner] + nth * piece
        stop = np.minimum(start + piece, begins[1:][owner])
        state = np.zeros(len(owner), dtype=np.int64)
        later = np.flatnonzero(nth)
        for back in range(self.order - 1, 0, -1):
            some = later[start[later] - back >= begins[:-1][owner[later]]]
            if len(some):
                state[some], _ = self.step(state[some], codes[start[some] - back])
        longest = np.argsort(start - stop, kind="stable")
        state, start, count = state[longest], start[longest], (stop - start)[longest]
        out = np.zeros(len(owner))
        live = len(owner)
        for t in range(int(count[0]) if len(count) else 0):
            while count[live - 1] <= t:
                live -= 1
            state[:live], log = self.step(state[:live], codes[start[:live] + t])
            out[:live] += log
        logs = np.zeros(len(sizes))
        np.add.at(logs, owner[longest], out)
        return logs


def _chunks(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, text) packed into chunks of numbered words; written once, so every later step sees the same chunks."""
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("held_out", T.ArrayType(T.BooleanType())),
        T.StructField("tokens", T.LongType()), T.StructField("lengths", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("hashes", T.BinaryType()),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for b in by_bytes(batches, "text", CHUNK_BYTES):
            codes, hashes, lengths = tokens(b.column("text"))
            one = lambda column: pa.ListArray.from_arrays([0, b.num_rows], column)
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk]), one(b.column("doc_id")), one(b.column("held_out")), pa.array([len(codes)]),
                *[pa.array([_packed(x)], pa.binary()) for x in (lengths, codes, hashes)],
            ], names=[f.name for f in schema.fields])
            chunk += 1

    return materialize(rows.mapInArrow(pack, schema), "ngram-chunks")


def _grams(row: dict, order: int) -> Grams:
    codes, hashes, lengths = (_unpacked(row[k], kind) for k, kind in (("codes", np.int32), ("hashes", np.uint64), ("lengths", np.int32)))
    return Grams(codes, hashes, lengths, ~np.asarray(row["held_out"], dtype=bool), order)


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins among sorted hashes, and the end."""
    high = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(high, np.arange(buckets + 1, dtype=np.uint64))


def _dealt(chunks: DataFrame, order: int, buckets: int) -> DataFrame:
    """Every chunk's n-grams and counts, by length and bucket of the hash; sorted and packed."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                g = _grams(row, order)
                for n in range(order):
                    by_hash = np.argsort(g.hashes[n])
                    hashes, counts = g.hashes[n][by_hash], g.counts[n][by_hash]
                    cuts = _cuts(hashes, buckets)
                    some = np.flatnonzero(np.diff(cuts))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(some * order + n, pa.int64()), pa.array([row["chunk"]] * len(some), pa.int64()),
                        pa.array([_packed_sorted(hashes[cuts[k]:cuts[k + 1]]) for k in some], pa.binary()),
                        pa.array([_packed(counts[cuts[k]:cuts[k + 1]]) for k in some], pa.binary()),
                    ], names=["bucket", "chunk", "hashes", "counts"])

    return chunks.select("chunk", "held_out", "lengths", "codes", "hashes").mapInArrow(deal, "bucket long, chunk long, hashes binary, counts binary")


ANSWER = "chunk long, n int, bucket long, others binary, tokens long, distinct long, once long, classes array<struct<class:int,histories:long,tokens:long>>"


def _added(order: int) -> Callable[[pa.Table], pa.Table]:
    schema = to_arrow_schema(T.StructType.fromDDL(ANSWER))

    def add(table: pa.Table) -> pa.Table:
        bucket, n = divmod(table.column("bucket")[0].as_py(), order)
        chunks = table.column("chunk").to_numpy()
        hashes = [_unpacked_sorted(x) for x in table.column("hashes").to_pylist()]
        counts = [_unpacked(x, np.int64) for x in table.column("counts").to_pylist()]
        sizes = [len(h) for h in hashes]
        every, own = np.concatenate(hashes), np.concatenate(counts)
        distinct, inverse = np.unique(every, return_inverse=True)
        totals = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(totals, inverse, own)
        # histories are what doesn't end with the end
        histories = totals[(totals > 0) & ((distinct & np.uint64(1)) == 0)]
        classes = np.floor(STEPS * np.log2(histories)).astype(np.int64)
        per, words = np.bincount(classes), np.bincount(classes, weights=histories)
        stats = [{"class": int(c), "histories": int(per[c]), "tokens": int(words[c])} for c in np.flatnonzero(per)]
        out = [{"chunk": None, "n": n, "tokens": int(own.sum()), "distinct": int((totals > 0).sum()), "once": int((totals == 1).sum()), "classes": stats}]
        at = 0
        for chunk, size in zip(chunks, sizes, strict=True):
            part = slice(at, at + size)
            at += size
            others = totals[inverse[part]] - own[part]
            if others.any():
                out.append({"chunk": int(chunk), "n": n, "bucket": bucket, "others": _packed(others)})
        return pa.Table.from_pylist(out, schema=schema)

    return add


def prior(classes: list[tuple[int, int]], once: int, tokens: int) -> float:
    """The m at which histories leave as large a share to unseen words as the n-grams seen once have.

    ``classes``: number and tokens of histories of like frequency. The share grows with m; found by halving between 0.01 and 10 to the 12th.
    """
    if not tokens or not classes:
        return 1.0
    n, total = np.array(classes, dtype=np.float64).T
    low, high = -2.0, 12.0
    for _ in range(60):
        mid = (low + high) / 2
        share = float((total * 10**mid / (total / n + 10**mid)).sum())
        low, high = (mid, high) if share < once else (low, mid)
    return 10 ** ((low + high) / 2)


def _constants(answers: DataFrame, order: int) -> tuple[int, int, list[float]]:
    """Tokens and distinct tokens of the training texts, and m for each length; what comes to the driver is bounded by the classes."""
    stats = answers.filter("chunk is null")
    sums = {r["n"]: r for r in stats.groupBy("n").agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct"), F.sum("once").alias("once")).collect()}
    per = stats.select("n", F.explode("classes").alias("c")).groupBy("n", "c.class").agg(F.sum("c.histories").alias("histories"), F.sum("c.tokens").alias("tokens")).collect()
    if not sums:
        return 0, 0, [1.0] * (order - 1)
    priors = []
    for n in range(1, order):
        classes = sorted((r["class"], r["histories"], r["tokens"]) for r in per if r["n"] == n - 1)
        priors.append(prior([c[1:] for c in classes], sums[n]["once"] if n in sums else 0, sums[n]["tokens"] if n in sums else 0))
    return sums[0]["tokens"], sums[0]["distinct"], priors


def score(docs: DataFrame, order: int = 2, held_out: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's log10 probability under n-grams of the texts that aren't held out.

    Columns: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens that training texts have), ``train_tokens``, ``base_score`` (additive
    unigrams) and ``score`` (the automaton). ``held_out``: by default, a crc32 of the id as text that 10 divides; a null counts as held out. A
    null text is empty, a text without a word has one token, the end. Rows that repeat an id are texts of their own; a null id counts as the empty text.
    Without training texts every token has probability 1 (the base's value there); an empty table gives no rows. Other columns are ignored. The
    automaton knows every n-gram of the training texts, however many there are.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    out = fold(F.col(doc_id), 10) == 0 if held_out is None else F.coalesce(held_out, F.lit(True))
    rows = docs.select(F.col(doc_id).alias("doc_id"), out.alias("held_out"), F.col(text).cast("string").alias("text"))
    chunks = _chunks(rows)
    count = chunks.agg(F.sum("tokens")).head()[0] or 0
    buckets = max(1, -(-count // BUCKET_GRAMS))
    answers = materialize(_dealt(chunks, order, buckets).groupBy("bucket").applyInArrow(_added(order), ANSWER), "ngram-counts")
    total, distinct, priors = _constants(answers, order)
    floor = total + 0.1 * (distinct + 1)
    base = lambda c: np.log10((c + 0.1) / floor)
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        g = _grams(row, order)
        for n in range(order):
            by_hash = np.argsort(g.hashes[n])
            cuts = _cuts(g.hashes[n][by_hash], buckets)
            mine = right.filter(pc.equal(right.column("n"), n))
            for k, others in zip(mine.column("bucket").to_pylist(), mine.column("others").to_pylist(), strict=True):
                g.counts[n][by_hash[cuts[k]:cuts[k + 1]]] += _unpacked(others, np.int64)
        known = (g.counts[0] > 0)[g.codes]
        sizes = np.diff(g.begins)
        logs = Automaton(g, base, priors).read(g.codes, g.begins)
        result = [
            left.column("doc_ids").combine_chunks().flatten(), left.column("held_out").combine_chunks().flatten(), pa.array(sizes), pa.array(np.add.reduceat(known.astype(np.int64), g.begins[:-1])),
            pa.array(np.full(len(sizes), total)), pa.array(np.add.reduceat(base(g.counts[0])[g.codes], g.begins[:-1])), pa.array(logs),
        ]
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays(result, names=schema.names)

    mine = answers.filter("chunk is not null").select("chunk", "n", "bucket", "others")
    return chunks.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(scored, schema)
