"""BPE encoding and decoding by batched numpy merge rounds.

A text is cut into special tokens and pre-tokens. The distinct pre-tokens of a slice
of documents lie as one flat array of symbols with the word each symbol belongs to.
Every round computes the keys of neighbouring pairs, finds their merge ranks by binary
search over the sorted keys of the merge table, takes each word's lowest rank and merges
all its places at once. Words without a mergeable pair leave the array.
Whole texts are encoded where they lie: there is no shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import CACHE_BYTES, remembered, text_function, texts

#: Fixed value: the byte-level pre-tokenizer's pattern, white space as Unicode names it.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ByteBpe:
    """One vocabulary file: encodes lists of texts and decodes lists of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *special.values()]) + 1
        chars = byte_characters()
        to_byte = {c: b for b, c in enumerate(chars)}
        self.first = np.array([vocab[c] for c in chars], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        self.bytes_of.update({i: token.encode() for token, i in special.items()})
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, tuple[str, bytes]] = {}
        self.held = 0

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens and special tokens in order; joined they give the text."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        found: list[str] = []
        for part in self.cut.split(text):
            found += [part] if part in self.special else self.words.findall(part)
        return found

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; the number of merges where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.ranks))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one flat array, and how many belong to each word."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        wid = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_wid = [], []
        none = len(self.ranks)
        rank = np.append(np.where(wid[:-1] == wid[1:], self.rank(sym[:-1], sym[1:]), none), none)[: len(sym)]
        while len(sym):
            starts = np.flatnonzero(np.diff(wid, prepend=-1))
            lengths = np.diff(np.append(starts, len(sym)))
            lowest = np.minimum.reduceat(rank, starts)
            keep = np.repeat(lowest < none, lengths)
            if not keep.all():
                done_sym.append(sym[~keep])
                done_wid.append(wid[~keep])
            # of neighbouring places of one pair ("aaa") every second one merges, from the left
            place = np.flatnonzero((rank == np.repeat(lowest, lengths)) & keep)
            run = np.flatnonzero(np.diff(place, prepend=-2) != 1)
            nth = np.arange(len(place)) - np.repeat(run, np.diff(np.append(run, len(place))))
            place = place[nth % 2 == 0]
            sym[place] = self.merged[rank[place]]
            keep[place + 1] = False
            at = (np.cumsum(keep) - 1)[place]
            sym, wid, rank = sym[keep], wid[keep], rank[keep]
            # only pairs beside a new symbol have another rank now
            changed = np.zeros(len(sym), bool)
            changed[at] = changed[np.maximum(at - 1, 0)] = True
            at = np.flatnonzero(changed)
            last = at == len(sym) - 1
            rank[at[last]] = none
            at = at[~last]
            rank[at] = np.where(wid[at] == wid[at + 1], self.rank(sym[at], sym[at + 1]), none)
        if not done_sym:
            return np.empty(0, np.int64), sizes * 0
        sym, wid = np.concatenate(done_sym), np.concatenate(done_wid)
        order = np.argsort(wid, kind="stable")
        return sym[order], np.bincount(wid, minlength=len(words))

    def encoded(self, words: list[str]) -> tuple[list[str], list[bytes]]:
        """Of each pre-token: its ids, joined by commas, and the bytes they decode to."""
        plain = [b"" if w in self.special else w.encode() for w in words]
        flat, counts = self.merge(plain)
        flat = flat.tolist()
        names, raw = list(map(str, flat)), list(map(self.bytes_of.__getitem__, flat))
        ends = np.cumsum(counts).tolist()
        begins = [0, *ends][: len(ends)]
        ids = [",".join(names[a:b]) for a, b in zip(begins, ends, strict=True)]
        out = [b"".join(raw[a:b]) for a, b in zip(begins, ends, strict=True)]
        for i, w in enumerate(words):
            if w in self.special:
                ids[i], out[i] = str(self.special[w]), self.bytes_of[self.special[w]]
        return ids, out

    def coded(self, texts_: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each text's ids, joined by commas, and the bytes they decode to.

        Pre-tokens never reach over a space that a visible character follows, so a text is
        split there and each distinct chunk is cut by the pattern once. A text with another
        white space behind a space, or with a special token, is cut as a whole.
        """
        split = [t.split(" ") for t in texts_]
        distinct = set().union(*[p[1:] for p in split])
        odd = {c for c in distinct if not c or c[0].isspace()}
        special = [any(s in t for s in self.special) for t in texts_]
        whole = [s or not odd.isdisjoint(p[1:]) for s, p in zip(special, split, strict=True)]
        if self.held > CACHE_BYTES:
            self.known, self.held = {}, 0
        fresh = [c for c in distinct - self.known.keys() if c not in odd]
        cut = [self.words.findall(" " + c) for c in fresh]
        first = [self.pretokens(t if w else p[0]) for t, w, p in zip(texts_, whole, split, strict=True)]
        words = list(set(itertools.chain(*cut, *first)))
        coded = dict(zip(words, zip(*self.encoded(words), strict=True), strict=True))

        def joined(parts: list[tuple[str, bytes]]) -> tuple[str, bytes]:
            return ",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

        new = [joined([coded[w] for w in ws]) for ws in cut]
        self.held += remembered(fresh, 150) + sum(len(ids) + len(raw) for ids, raw in new)
        self.known.update(zip(fresh, new, strict=True))
        for w, p, ws in zip(whole, split, first, strict=True):
            yield joined([coded[x] for x in ws] + ([] if w else list(map(self.known.__getitem__, p[1:]))))

    def encode(self, text: str) -> list[int]:
        listed, _ = next(self.coded([text]))
        return [int(i) for i in listed.split(",")] if listed else []

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(
    docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    with_ids: bool = False,
) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns ``keep`` columns, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, on request,
    the ``ids`` themselves and the ``decoded`` text. A null text counts as empty (no tokens,
    digests of the empty string); repeated rows are each encoded; other columns are left out, and columns of
    ``keep`` that have the name of a result are replaced by it.
    ``vocabulary`` is the path of a byte-level BPE file that every executor can open.
    """
    results = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    kinds = ["long", "string", "string", "array<int>", "string"]

    def start() -> Callable[[pa.Array], pa.Array]:
        bpe = load(vocabulary)

        def run(column: pa.Array) -> pa.Array:
            counts, id_hash, text_hash, ids, decoded = [], [], [], [], []
            for listed, raw in bpe.coded(texts(column)):
                counts.append(listed.count(",") + 1 if listed else 0)
                id_hash.append(hashlib.sha256(listed.encode()).hexdigest())
                text_hash.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
                if with_ids:
                    ids.append([int(i) for i in listed.split(",")] if listed else [])
                    decoded.append(raw.decode("utf-8", "replace"))
            columns = [pa.array(counts, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_ids else []
            return pa.StructArray.from_arrays(columns, names=results)

        return run

    kept = [F.col(f"`{c}`") for c in keep if c not in results]
    coded = text_function(", ".join(f"{n} {k}" for n, k in zip(results, kinds, strict=False)), start)(docs[text])
    return docs.select(*kept, coded.alias("__p")).select(*kept, *[f"__p.{n}" for n in results])
