"""MinHash near-dedup for weighted shingles: ProbMinHash, banding, exact verification, components.

Every shingle of five words has the weight 1 + ln(times in the text). It sends arrivals of a
Poisson process of that rate to random registers; a register keeps its earliest arrival. A
shingle stops once its next arrival is later than every register's. Two texts share a
register's shingle with the probability J_P (probability Jaccard), which is the plain Jaccard
similarity where no shingle repeats. Texts that share a band are candidates; links are
pairs with an exact J_P of at least ``similarity``.

Texts with the same words are one class from the start. In a bucket of candidates all members
are compared with a leader first; what ends in one component needs no further comparison.
Members of buckets with different components are then compared block by block, which finds
every link left among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_bytes
from .components import components
from .joins import salted_join
from .store import columns_of, materialize, row_digest
from .tokens import coded_words

WORDS = 5
BANDS, ROWS = 20, 4
#: Texts and bytes of text in a block of a bucket, and shingles in a matrix product.
BLOCK_TEXTS, BLOCK_BYTES, COLUMNS = 256, 1 << 20, 8192
SLICE = 2 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of the lower-cased words of all texts, and where each text begins."""
    codes, words, begins = coded_words(pc.utf8_lower(texts.fill_null("")))
    of = np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], dtype=np.uint64)
    return (of[codes] if len(codes) else np.zeros(0, np.uint64)), begins


def shingles(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of one text's words and their weights; a shorter text is one shingle."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0)
    n = min(WORDS, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total = mix(total * GOLDEN + h[i : len(h) - n + 1 + i])
    s, times = np.unique(total, return_counts=True)
    return s, 1 + np.log(times)


def signatures(s: np.ndarray, w: np.ndarray, owner: np.ndarray, texts: int, m: int) -> np.ndarray:
    """The shingle in each of ``m`` registers of every text; all zero for texts without shingles."""
    first, holder = np.full(texts * m, np.inf), np.zeros(texts * m, np.uint64)
    limit = np.full(texts, np.inf)
    x, t = np.zeros(len(s)), 0
    while len(s):
        t += 1
        r = mix(s + np.array([t], np.uint64) * GOLDEN)
        x = x - np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / w
        going = x < limit[owner]
        s, w, owner, x = s[going], w[going], owner[going], x[going]
        register = owner * m + (mix(r[going] ^ GOLDEN) % np.uint64(m)).astype(np.int64)
        better = np.flatnonzero(x < first[register])
        better = better[np.argsort(-x[better], kind="stable")]  # the earliest is written last
        first[register[better]], holder[register[better]] = x[better], s[better]
        limit = first.reshape(texts, m).max(axis=1)
    return holder.reshape(texts, m)


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text two numbers for its sequence of words, and a number for each band."""
    m = BANDS * ROWS
    for b in by_bytes(batches, "text", SLICE):
        h, begins = word_hashes(b.column("text"))
        n = np.diff(begins)
        nth = (np.arange(len(h)) - np.repeat(begins[:-1], n)).astype(np.uint64)
        keys = []
        for salt in (1, 2):
            mixed = mix(h + mix(nth * np.uint64(2) + np.uint64(salt)))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
            keys.append((sums[begins[1:]] - sums[begins[:-1]]).view(np.int64))
        parts = [shingles(h[a:z]) for a, z in zip(begins[:-1], begins[1:], strict=True)]
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        sig = signatures(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), owner, len(parts), m)
        band = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(parts), axis=0)
        for i in range(ROWS):
            band = mix(band * GOLDEN + sig[:, i::ROWS])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(parts) + 1) * BANDS, BANDS), pa.int32()), pa.array(band.ravel().view(np.int64)))
        empty = n == 0
        kept = [b.column(c) for c in ("n", "doc_id", "digest")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(keys[0], mask=empty), pa.array(keys[1], mask=empty), flat], names=["n", "doc_id", "digest", "k1", "k2", "bands"])


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d)."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    wa, wb = a[1][ia], b[1][ib]
    order = np.argsort(wa / wb, kind="stable")
    wa, wb = wa[order], wb[order]
    # elements in rising order of a / b: those before d count by b, it and those after by a
    over = np.cumsum(wa[::-1])[::-1] + (a[1].sum() - wa.sum())
    under = np.cumsum(wb) - wb + (b[1].sum() - wb.sum())
    return float((1 / (over / wa + under / wb)).sum())


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for b in by_bytes(batches, "text_b", SLICE):
            out = []
            h, begins = word_hashes(b.column("text_b"))
            for i, a in enumerate(b.column("a").to_pylist()):
                if a != last:
                    last, kept = a, shingles(word_hashes(b.column("text_a").slice(i, 1))[0])
                out.append(probability_jaccard(kept, shingles(h[begins[i] : begins[i + 1]])) >= similarity - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    return run


def linked_pairs(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: whether their ``texts`` (id, text) are similar enough, exactly computed."""
    pairs = materialize(pairs, "minhash-pairs")
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    full = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    # a leader meets all texts of its bucket, in as many tasks as these need
    full = salted_join(full, texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), ["a"], F.xxhash64("b"), sizes=sizes, total=pairs.count())
    return materialize(full.select("a", "b", "text_a", "text_b").mapInArrow(_verify(similarity), "a long, b long, linked boolean"), "minhash-links")


def _common_weights(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of two blocks the share of either text's weight on shingles of both."""
    shared = np.intersect1d(np.concatenate([x[0] for x in a]), np.concatenate([x[0] for x in b]))
    of_a, of_b = np.zeros((len(a), len(b)), np.float32), np.zeros((len(a), len(b)), np.float32)
    if not len(shared):
        return of_a, of_b
    flat = []
    for side in (a, b):
        s, w = np.concatenate([x[0] for x in side]), np.concatenate([x[1] / x[1].sum() for x in side])
        row = np.repeat(np.arange(len(side)), [len(x[0]) for x in side])
        at = np.minimum(np.searchsorted(shared, s), len(shared) - 1)
        hit = shared[at] == s
        flat.append((row[hit], at[hit], w[hit]))
    for low in range(0, len(shared), COLUMNS):
        dense = []
        for (row, at, w), side in zip(flat, (a, b), strict=True):
            here = (at >= low) & (at < low + COLUMNS)
            m = np.zeros((len(side), min(COLUMNS, len(shared) - low)), np.float32)
            m[row[here], at[here] - low] = w[here]
            dense.append(m)
        of_a += dense[0] @ (dense[1] > 0).astype(np.float32).T
        of_b += (dense[0] > 0).astype(np.float32) @ dense[1].T
    return np.minimum(of_a, 1), np.minimum(of_b, 1)


def _block_links(bucket: int, rows: dict[str, list], similarity: float) -> list[tuple[int, int]]:
    """Links that join what was apart between two blocks of a bucket (or inside one block)."""
    ids, comp, block = (np.array(rows[c]) for c in ("id", "component", "block"))
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    apart = comp[left][:, None] != comp[right][None, :]
    if block.min() == block.max():
        apart &= ids[left][:, None] < ids[right][None, :]
    if not apart.any():
        return []
    bands = np.stack(rows["bands"])
    same = bands[left][:, None, :] == bands[right][None, :, :]
    apart &= bands[left][np.arange(len(left))[:, None], same.argmax(axis=2)] == bucket  # a pair is compared in the first band it shares
    left, right, apart = left[apart.any(axis=1)], right[apart.any(axis=0)], apart[apart.any(axis=1)][:, apart.any(axis=0)]
    if not len(left):
        return []
    some = np.union1d(left, right)
    h, begins = word_hashes(pa.array([rows["text"][i] for i in some], pa.large_string()))
    parts = {i: shingles(h[a:z]) for i, a, z in zip(some, begins[:-1], begins[1:], strict=True)}
    of_a, of_b = _common_weights([parts[i] for i in left], [parts[i] for i in right])
    with np.errstate(divide="ignore"):
        most = 2 / ((2 - of_a) / of_a + (2 - of_b) / of_b)
    x, y = np.nonzero(apart & (most >= similarity - 1e-4))
    top = {c: c for c in comp.tolist()}

    def root(c: int) -> int:
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    found = []
    for k in np.argsort(-most[x, y], kind="stable"):
        i, j = left[x[k]], right[y[k]]
        u, v = root(int(comp[i])), root(int(comp[j]))
        if u != v and probability_jaccard(parts[i], parts[j]) >= similarity - 1e-12:
            top[max(u, v)] = min(u, v)
            found.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
    return found


def _compare_blocks(similarity: float):
    columns = ("id", "component", "block", "bands", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {c: [] for c in columns}

        def flush() -> Iterator[pa.RecordBatch]:
            found = _block_links(key[0], rows, similarity) if len(rows["id"]) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

        for b in batches:
            keys = [b.column(c).to_numpy() for c in ("h", "lo", "hi")]
            bands = np.asarray(b.column("bands").flatten()).reshape(-1, BANDS)
            ends = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
            for start, end in zip([0, *ends], [*ends, b.num_rows], strict=True):
                if start == end:
                    continue
                now = tuple(int(k[start]) for k in keys)
                if now != key:
                    if key is not None:
                        yield from flush()
                    key, rows = now, {c: [] for c in columns}
                part = b.slice(start, end - start)
                for c in ("id", "component", "block", "text"):
                    rows[c] += part.column(c).to_pylist()
                rows["bands"] += list(bands[start:end])
        if key is not None:
            yield from flush()

    return run


def bucket_links(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different components among ``members`` (h, id, component) of the same bucket; ``texts`` are id, text and bands.

    A bucket is cut into blocks of about ``BLOCK_TEXTS`` texts and ``BLOCK_BYTES`` bytes by a digest of the id; a task compares two
    blocks at a time. Let a and b be the shares of two texts' weights on shingles the other lacks. J_P is at most the harmonic
    mean of (1 - a) / (1 + a) and (1 - b) / (1 + b). Matrix products give these bounds for all pairs of two blocks;
    what they allow is computed exactly. Of links between the same two components one is enough, so
    fewer rows than texts leave a task.
    """
    sized = members.join(texts.select("id", F.octet_length("text").cast("long").alias("bytes")), "id")
    blocks = sized.groupBy("h").agg(F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    placed = salted_join(members, blocks, ["h"], F.xxhash64("id")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("h", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "component")
    pairs = placed.join(texts, "id").repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")
    return pairs.mapInArrow(_compare_blocks(similarity), "a long, b long").distinct()


def classified(base: DataFrame, similarity: float) -> DataFrame:
    """n, doc_id, class_id, copy_of and kept for every row of ``base`` (n, doc_id, digest, text).

    ``n`` is a stored number, different for each row; ``digest`` decides between rows of one id and one text. The least one of the rows with the same words stands for their text
    among bands, links and components, so neither a missing id nor an id of several texts matters there.
    """
    s = base.select("n", "doc_id", "digest", "text")
    s = materialize(s.mapInArrow(sketch, "n long, doc_id long, digest long, k1 long, k2 long, bands array<long>"), "minhash-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "n")).alias("first")
    classes = s.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("n").alias("id"), F.min("doc_id").alias("least"), first, F.any_value("bands").alias("bands"))
    classes = materialize(classes, "minhash-classes")
    entries = classes.select("id", F.explode("bands").alias("h"))
    sizes = materialize(entries.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "minhash-sizes")
    of_bucket = {"sizes": sizes, "total": sizes.agg(F.sum("n")).head()[0] or 0}  # a bucket's members lie in many tasks if they are many
    buckets = materialize(salted_join(entries, sizes.select("h"), ["h"], F.xxhash64("id"), **of_bucket), "minhash-buckets")
    ids = materialize(buckets.select("id").distinct(), "minhash-members")
    of_ids = classes.select("id", "bands").join(ids, "id", "left_semi")
    texts = materialize(base.select(F.col("n").alias("id"), "text").join(of_ids, "id"), "minhash-texts")
    lead = buckets.groupBy("h").agg(F.min("id").alias("l"))
    pairs = salted_join(buckets, lead, ["h"], F.xxhash64("id"), **of_bucket).filter("id <> l").select(F.col("l").alias("a"), F.col("id").alias("b")).distinct()
    links = linked_pairs(pairs, texts, similarity).filter("linked").select("a", "b")
    named = ids.join(components(links), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    members = materialize(buckets.join(named, "id"), "minhash-components")
    unlike = members.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("h")
    more = bucket_links(materialize(salted_join(members, unlike, ["h"], F.xxhash64("id"), "left_semi", **of_bucket).select("h", "id", "component"), "minhash-open"), texts, similarity)
    links = materialize(links.union(more), "minhash-all-links")
    comp = materialize(components(links), "minhash-classes-linked")
    best = F.min(F.struct("first.no_id", "first.doc_id", "k1", "k2", "first.digest", "first.n"))
    groups = classes.join(comp, "id").groupBy("component").agg(F.min("least").alias("class_id"), best["n"].alias("best"))
    linked = salted_join(comp, groups, ["component"], F.xxhash64("id"))
    named = classes.select("k1", "k2", "id", "least", F.col("first.n").alias("own")).join(linked, "id", "left")
    named = named.select("k1", "k2", F.col("least").alias("copy_of"), F.coalesce("class_id", "least").alias("class_id"), F.coalesce("best", "own").alias("best"))
    out = salted_join(s.select("n", "doc_id", "k1", "k2"), named, ["k1", "k2"], F.xxhash64("n"), "left")
    return out.select(
        "n", "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"),
        F.coalesce(F.col("best") == F.col("n"), F.lit(True)).alias("kept"),
    )


def _rows(rows: DataFrame) -> DataFrame:
    return rows.select("n", F.col("doc_id").cast("long").alias("doc_id"), "digest", "text")


def near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id reachable by links), copy_of (smallest id with the same words), kept.

    Words are lower-cased and separated by white space. Texts that are null or without a
    word link with nothing and are kept. ``kept`` marks exactly one row of each class: the one with the smallest id, rows without
    an id last, then by the numbers of the words. Links belong to texts, so texts without an id and all texts
    of a repeated id are compared; class_id and copy_of are null where no row of the class or text has an id.
    """
    base = materialize(_rows(docs.select(F.monotonically_increasing_id().alias("n"), "doc_id", F.xxhash64("text").alias("digest"), "text")), "minhash-rows")
    return classified(base, similarity).drop("n")


def one_of_each_class(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` marks as kept, with all their columns.

    Of rows that agree in id and words the one with the least digest of all columns stays, whatever their order.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("n"), row_digest(docs).alias("digest"), F.struct(*columns_of(docs)).alias("row")), "minhash-rows")
    kept = classified(_rows(rows.select("n", "digest", "row.doc_id", "row.text")), similarity).filter("kept").select("n")
    return rows.join(kept, "n", "left_semi").select("row.*")
