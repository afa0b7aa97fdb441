"""Nulls, repeated rows, long texts, ties, empty tables and clashing columns for every operator, and slow versions of the learned ones."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.llm import bpe, chat, hnsw, langid, mixing, probminhash, quality, topk, toxicity, warc
from claimloom.llm.queries import tokenizer_path

PIECES = "piece_bpe_32k.model"


def captured(spark, tmp_path, pages):
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), str(tmp_path / "w"))
    return warc.resolve(warc.assemble(warc.read_records(spark, str(tmp_path / "w"))))


def test_warc_keeps_rows_that_repeat_an_id(spark, tmp_path):
    got = captured(spark, tmp_path, [(5, "u", "AAAA"), (5, "u", "BBBBBBBB"), (7, "u", "AAAA"), (7, "u", "AAAA"), (None, "u", "CC"), (None, None, None), (9, None, "CC"), (8, "http://x/", "D" * 3_000_000)]).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == Counter({
        (5, "response", None, 4): 1, (5, "response", None, 8): 1, (7, "revisit", 5, 4): 2, (9, "response", None, 2): 1, (None, "revisit", 9, 2): 1, (None, "response", None, 0): 1, (8, "response", None, 3_000_000): 1,
    })


def test_warc_of_an_empty_table(spark, tmp_path):
    assert captured(spark, tmp_path, []).count() == 0


def test_warc_reads_archives_with_a_member_for_each_record():
    import gzip

    texts = [b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in (b"one", b"", b"x\r\n\r\ny" * 400_000)]
    whole = b"".join(texts)
    for data in (whole, gzip.compress(whole), b"".join(map(gzip.compress, texts))):
        assert [len(block) for _, block in warc.parse_records(warc.unpacked(memoryview(data)))] == [3, 0, 2_400_000]
    assert [len(block) for _, block in warc.parse_records(warc.unpacked(memoryview(gzip.compress(whole)[:-9])))][:2] == [3, 0]


def segmentations(word, model, lang, known=None):
    """The sum over all ways to cut ``word`` into pieces, by listing every way."""
    if not word:
        return 1.0
    known = known or {p: i for i, p in enumerate(model.pieces)}
    total = 0.0
    for k in range(1, len(word) + 1):
        i = known.get(word[:k], len(known) if k == 1 else None)
        if i is not None:
            total += model.prob[i, lang] * segmentations(word[k:], model, lang, known)
    return total


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    pieces = [langid.START, "a", "b", "ab", "ba", "aba", "bab", "c", "abc", "ccc", langid.START + "a", "aaaa"]
    prob = rng.random((len(pieces) + 1, 3))
    return langid.PieceModel(["de", "en", "zh.tw"], pieces, prob / prob.sum(axis=0))


def test_forward_sums_are_those_of_all_segmentations():
    m, r = small_model(), random.Random(2)
    words = [langid.START + "".join(r.choices("abcd", k=r.randint(1, 11))) for _ in range(60)]
    got = m.word_scores(words)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, [math.log(segmentations(w, m, j)) for j in range(3)])


def test_expected_uses_are_the_slope_of_the_forward_sums():
    m, words, counts = small_model(), [langid.START + "abab", langid.START + "cccabca", langid.START + "d"], np.array([[2.0, 0, 1], [1, 3, 0], [1, 1, 1]])
    got = m.expected(words, counts)
    for i, j in itertools.product(range(len(m.pieces) + 1), range(3)):
        up, down = (langid.PieceModel(m.langs, m.pieces, m.prob.copy()) for _ in range(2))
        up.prob[i, j] *= 1 + 1e-5
        down.prob[i, j] *= 1 - 1e-5
        slope = ((up.word_scores(words) - down.word_scores(words)) * counts).sum() / 2e-5
        assert math.isclose(got[i, j], slope, abs_tol=1e-4)


def test_long_runs_of_letters_are_summed_whole():
    m = small_model()
    long = langid.START + "ab" * 40_000
    log = np.log(m.prob)
    known = {p: i for i, p in enumerate(m.pieces)}
    alpha = [np.zeros(3)]
    for end in range(1, 400):
        ways = [alpha[end - k] + log[known.get(long[end - k : end], len(known) if k == 1 else -1)] for k in range(1, min(end, 4) + 1) if k == 1 or long[end - k : end] in known]
        alpha.append(np.logaddexp.reduce(ways))
    assert np.allclose(m.word_scores([long[:399]])[0], alpha[399])
    assert np.isfinite(m.word_scores([long])).all()


LANG = [(i, " ".join(random.Random(i).choices(["fluss", "das", "haus", "grün"] if i % 2 else ["river", "the", "house", "green"], k=12)), "zh.tw" if i % 2 else "en`x", "s") for i in range(120)]


def test_language_query_is_brute_force(spark):
    docs = spark.createDataFrame([*LANG, (500, None, "zh.tw", "s"), (501, "12 %", "en`x", "s"), (3, LANG[3][1], None, "s"), (502, "the " * 30_000, None, None)], "doc_id long, text string, lang string, score string").repartition(3)
    m = langid.fit(docs, tokenizer_path(PIECES))
    assert m.langs == ["en`x", "zh.tw"] and len(m.pieces) > 31_000
    got = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.predict(docs, m, keep=("doc_id", "score")).collect()}
    want, known = set(), {p: i for i, p in enumerate(m.pieces)}
    for doc_id, text, *_ in docs.collect():
        words = "".join(c if c.isalpha() else " " for c in text or "").split()
        by = [sum(n * math.log(segmentations(langid.START + w, m, j, known)) for w, n in Counter(words).items()) for j in range(2)]
        best = max(range(2), key=lambda j: by[j])
        want.add((doc_id, m.langs[best] if words else "und", round(1 / sum(math.exp(b - by[best]) for b in by), 9) if words else 0.0))
    assert got == want
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0), tokenizer_path(PIECES))).count() == 0


def slow_contexts(docs):
    index, out = quality.index_vectors().astype(int), np.zeros((quality.BUCKETS, quality.DIM), int)
    for syms in docs:
        for side in (0, 1):
            for i in range(len(syms)):
                for j in range(max(0, i - quality.WINDOW), min(len(syms), i + quality.WINDOW + 1)):
                    if i != j:
                        out[syms[i][side]] += index[syms[j][side]]
    return out


def slow_symbols(text):
    words, out = (text or "").split(), []
    for i, w in enumerate(words):
        letters, shape = quality.symbols(w)
        out.append((letters, quality.REPEATED if i and words[i - 1] == w else shape))
    return out


def test_quality_query_is_brute_force(spark):
    r = random.Random(7)
    rows = [(i, " ".join(w + "!?*" * (i % 3 == 0) for w in r.choices(["river", "stone", "The", "and", "a1b2c3d4e5f6g7h8"], k=r.randint(3, 15)))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (4, rows[4][1]), (70, None), (71, " "), (72, "x " * 50_000)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(60)], "doc_id long, quality int")
    m = quality.fit(docs, labels)
    texts = [(d, t) for d, t in docs.collect()]
    assert np.allclose(m.vectors, quality.unit(slow_contexts([slow_symbols(t) for _, t in texts])))
    w1, b1, w2, b2 = m.layers
    for d in quality.predict(docs, m).collect():
        syms = slow_symbols(next(t for i, t in texts if i == d.doc_id))
        x = [sum(m.vectors[s[side]][k] for s in syms) / max(1, len(syms)) for side in (0, 1) for k in range(quality.DIM)] + [math.log1p(len(syms))]
        x = [(v - a) / s for v, a, s in zip(x, m.mean, m.spread, strict=True)]
        hidden = [math.tanh(sum(v * w1[i][h] for i, v in enumerate(x)) + b1[h]) for h in range(quality.HIDDEN)]
        p = 1 / (1 + math.exp(-max(-40, min(40, (sum(v * w2[h] for h, v in enumerate(hidden)) + b2[0]) / m.temperature)))) if syms else 0.0
        assert math.isclose(d.score, p, abs_tol=1e-5) and d.predicted == int(d.score >= 0.3)
        assert d.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)


def test_shapes_of_long_words_differ_to_their_end():
    a, b = "a1" * 20 + "!", "a1" * 20 + "?"
    assert quality.symbols(a)[1] != quality.symbols(b)[1]


def test_toxicity_learns_ordered_grades(spark):
    r = random.Random(3)
    mild, strong, plain = ["silly", "daft"], ["vile", "foul"], ["house", "river", "stone", "tree", "green"]
    rows = []
    for i in range(600):
        grade = (0, 2, 5)[i % 3]
        rows.append((i, " ".join(r.choices(plain, k=20) + (r.choices(mild, k=2) if grade == 2 else r.choices(strong, k=3) if grade == 5 else [])), grade))
    docs = spark.createDataFrame([*[x[:2] for x in rows], (700, None), (701, ""), (1, rows[1][1]), (702, "house " * 40_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, severity int")
    m = toxicity.fit(docs, labels, label="severity")
    assert len(m.thresholds) == 2 and m.thresholds[0] < m.thresholds[1]
    got = {d.doc_id: d for d in toxicity.predict(docs, m).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert np.mean([got[i].grade == i % 3 for i in held]) > 0.95
    mean = [np.mean([got[i].expected_severity for i in held if i % 3 == g]) for g in range(3)]
    assert mean[0] < 0.5 < mean[1] < 1.5 < mean[2] and got[700].grade == got[702].grade == 0
    for i in held[:20]:  # slowly: every feature of every word once or more
        s = sum(m.weights[m.words.index(f)] for f in {f for w in rows[i][1].split() for f in toxicity.features(w)} if f in m.words)
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-(s - m.thresholds[0]))), abs_tol=1e-9)


def test_classifiers_replace_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "old", "old"), (2, None, "old", "old")], "doc_id long, text string, score string, `odd.name` string")
    for got in (quality.predict(docs, None, keep=("doc_id", "score", "odd.name")), toxicity.predict(docs, None, keep=("doc_id", "score", "odd.name")), bpe.encode_documents(docs, tokenizer_path("byte_bpe_50k.json"), keep=("doc_id", "score", "odd.name"))):
        assert len(set(got.columns)) == len(got.columns) and {r["odd.name"] for r in got.collect()} == {"old"}
    assert bpe.encode_documents(docs.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def brute_links(rows, threshold=0.93):
    ok = [i for i, (d, e, l) in enumerate(rows) if d is not None and l is not None and e and all(map(math.isfinite, e)) and any(e)]
    n, top = [0] * len(rows), list(range(len(rows)))
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    pairs = [(a, b) for a in ok for b in ok if a < b and rows[a][2] == rows[b][2] and cos(rows[a][1], rows[b][1]) >= threshold]
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    for _ in rows:
        for a, b in pairs:
            top[a] = top[b] = min(top[a], top[b])
    least = [min((rows[j][0] for j in range(len(rows)) if top[j] == top[i] and rows[j][0] is not None), default=None) for i in range(len(rows))]
    return Counter((rows[i][0], n[i], least[i] if rows[i][0] is not None else None) for i in range(len(rows)))


def test_embeddings_that_repeat_an_id(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=8), rng.normal(size=8)
    near = (a + 0.05 * rng.normal(size=8)).astype(np.float32).astype(float)
    a, b = a.astype(np.float32).astype(float), b.astype(np.float32).astype(float)
    rows = [(5, a.tolist(), 1), (5, near.tolist(), 1), (5, near.tolist(), 1), (5, b.tolist(), 1), (3, b.tolist(), 1), (3, b.tolist(), 2), (None, a.tolist(), 1), (9, a.tolist(), None), (2, [], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = hnsw.near_duplicates(df)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == brute_links(rows)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0


def test_topk_of_repeated_ids_unequal_lengths_and_huge_components(spark):
    rows = [(100, [1.0, 2.0]), (100, [2.0, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (200, [4.0]), (9, [1.0e12, 1.0]), (300, None), (None, [1.0, 2.0]), (11, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    f = [(d, [math.floor(1024 * x) for x in e]) for d, e in rows if d is not None and e]
    want = Counter()
    for i, (d, q) in enumerate(f):
        if d % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), o) for j, (o, c) in enumerate(f) if j != i and len(c) == len(q))[:3]
            want.update((d, n + 1, o, -s) for n, (s, o) in enumerate(scores))
    assert Counter(map(tuple, topk.top_k(df, k=3, block=2).collect())) == want
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["dense", "sparse"])
def test_topk_scores_come_from_lists_read_until_only_k_are_left(kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3_000, 24)) * 1024
    if kind == "sparse":  # few large components: the lists decide early
        x = x * (rng.random(x.shape) < 0.08) * 40
    x = np.floor(x).astype(np.int64)
    lists, reads = topk.Lists(np.arange(3_000), np.arange(3_000), x), []
    for q in range(0, 3_000, 300):
        at, scores, depth, left = lists.best(x[q], q, 10)
        true = x @ x[q]
        true[q] = -(1 << 60)
        best = np.lexsort((np.arange(3_000), -true))[:10]
        assert lists.rows[at].tolist() == best.tolist() and scores.tolist() == true[best].tolist()
        assert left <= 10 or depth == 3_000 or not x[q].any()
        reads.append(depth / 3_000)
    assert max(reads) <= 1 and (kind == "dense" or np.mean(reads) < 0.9)


def test_mixing_with_clashing_columns_hot_ids_and_ties(spark):
    rows = [(None, "w w w", "a")] * 300 + [(i, "w " * (i % 4), ["a", "b", None][i % 3]) for i in range(200)] + [(7, "x " * 20_000, "b")] + [(1, None, "a")]
    docs = spark.createDataFrame([(*r, "s", "t", i) for i, r in enumerate(rows)], "doc_id long, text string, source string, size string, taken string, n long").repartition(5)
    got = mixing.mix(docs, rows_per_bucket=40).collect()
    size = [len((t or "").split()) for _, t, _ in rows]
    total = {s: sum(x for x, r in zip(size, rows, strict=True) if r[2] == s) for s in ("a", "b", None)}
    assert len(got) == len(rows) and all(r["size"] == size[r.n] and r.source_size == total[r.source] and r.taken % max(1, r["size"]) == 0 and r.taken <= 2 * r["size"] for r in got)
    taken = {s: sum(r.taken for r in got if r.source == s) for s in total}
    # slowly: every offer in order of its finish
    key = lambda d: __import__("hashlib").md5(("null" if d is None else str(d)).encode()).hexdigest()
    weight, offers = {"a": 5.0, "b": 2.0, None: 1.0}, []
    for s in total:
        end = 0
        for k, x in sorted((key(r[0]), x) for x, r in zip(size, rows, strict=True) if r[2] == s):
            end += x
            offers += [((end + p * total[s]) / weight[s], (s is None, s or ""), k, x, s) for p in (0, 1) if x]
    want, run = dict.fromkeys(total, 0), 0
    for *_, x, s in sorted(offers, key=lambda o: o[:4]):
        run += x
        if run > 1.5 * sum(size):
            break
        want[s] += x
    assert taken == want
    assert mixing.mixed_documents(docs, rows_per_bucket=40).count() == sum(r.taken // r["size"] for r in got if r["size"])
    assert mixing.mixed_documents(docs).columns == docs.columns


@pytest.mark.parametrize("sizes", [
    {"a": 500, "b": 200, "c": 100}, {"a": 100, "b": 1000, "c": 5000, "d": 40, None: 3000}, {"": 70, "a": 700, "b": 30, "\U00010000": 900, "\uffff": 20}, {"a": 0, "b": 10, None: 10}, {"a": 0}, {None: 9}, {"a": 300, "b": 300, "c": 300, "d": 300},
], ids=str)
def test_mixing_targets_share_the_excess_by_weight(spark, sizes):
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2).collect()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    # slowly: whoever is above the cap stops there, the rest share what is left
    open_, want = set(sizes), {}
    while open_:
        left = 1.5 * sum(sizes.values()) - sum(want.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        want |= {s: 2.0 * sizes[s] for s in over} if over else share
        open_ -= over or open_
    assert {s: r.target for s, r in got.items()} == pytest.approx(want) and all(got[s].source_size == n for s, n in sizes.items())


def test_chat_of_empty_tables_long_texts_and_other_columns(spark):
    turns = [(1, 0, "u", "x" * 2_000_000, "a"), (2, 0, "u", "x" * 2_000_000, "a"), (2, 1, "a", "", "b"), (3, 0, None, None, "b"), (3, 0, None, None, "c")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, rendered string")
    assert {(r.conv_id, r.n_turns, len(r.rendered)) for r in chat.collapse(df).collect()} == {(2, 2, 2_000_014), (3, 2, 12)}
    assert chat.collapse(df).columns == ["conv_id", "n_turns", "rendered"]
    assert chat.collapse(df.limit(0)).count() == 0


def test_near_duplicate_query_is_brute_force(spark):
    """All pairs of a few hundred texts with near copies of many similarities: no wrong link, and at least nine in ten true ones."""
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(900)]
    rows = []
    for group in range(40):
        base = r.choices(vocabulary, k=r.choice([4, 30, 120, 260]))
        for copy in range(r.choice([1, 2, 3, 6])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(words + (base[:25] * (copy % 2) if len(base) > 200 else []))))
    got = {d.doc_id: d.class_id for d in probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    parts = [probminhash.shingles(probminhash.word_hashes(pa.array([t]))[0]) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if probminhash.probability_jaccard(parts[a], parts[b]) >= 0.8]
    near = [(a, b) for a, b in links if rows[a][1] != rows[b][1]]
    assert len(near) > 20 and np.mean([got[a] == got[b] for a, b in near]) >= 0.9
    top = list(range(len(rows)))
    for _ in rows:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    assert all(top[a] == top[b] for a in range(len(rows)) for b in range(a) if got[a] == got[b])


def test_texts_of_marks_alone_have_no_language(spark):
    docs = spark.createDataFrame([(i, w * 40, lang) for i in range(40) for w, lang in [("the then and ", "en"), ("der die und ", "de")]], "doc_id long, text string, lang string")
    model = langid.fit(docs, tokenizer_path("piece_bpe_32k.model"))
    marks = spark.createDataFrame([(1, "́̂"), (2, "12 ́ !"), (3, "á"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(marks, model).collect()}
    assert [got[i] for i in (1, 2, 4, 5)] == [("und", 0.0)] * 4 and got[3][0] in ("de", "en")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_joins_are_plain_joins(spark, how):
    from claimloom.llm.joins import salted_join

    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 == 1, None).otherwise(F.col("id") % 900).alias("k"), (F.col("id") % 2).alias("j"))
    right = spark.range(0, 800).select(F.col("id").alias("k"), (F.col("id") % 2).alias("j"), (F.col("id") * 2).alias("v"))
    plain = left.join(right, ["k", "j"], how)
    for share in (1, 10, 1000):
        found = salted_join(left, right, ["k", "j"], F.xxhash64("id"), how, share=share)
        assert sorted(map(str, found.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    empty = left.limit(0)
    assert salted_join(empty, right, ["k", "j"], F.xxhash64("id"), how).count() == 0


def test_a_key_with_a_third_of_the_rows_is_dealt_to_many_tasks(spark):
    from claimloom.llm.joins import salted_join

    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(keep, ("false", "-1", "32"), strict=True):
            spark.conf.set(k, v)
        left = spark.range(60_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 5).otherwise(F.col("id")).alias("k"))
        right = spark.range(60_000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        rows = salted_join(left, right, ["k"], F.xxhash64("id"), "left").groupBy(F.spark_partition_id()).count().collect()
        counts = sorted(r["count"] for r in rows)
        assert sum(counts) == 60_000 and counts[-1] < 3 * counts[len(counts) // 2]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_the_cut_between_clean_and_toxic_is_the_best_of_all(spark):
    rng = np.random.default_rng(3)
    for n in (2, 5, 60):
        strength, toxic = np.round(rng.normal(size=n), 1), rng.random(n) < 0.4
        toxic[0], toxic[1] = True, False
        gain = lambda c: (strength >= c)[toxic].mean() - toxicity.CLEAN_COSTS * (strength >= c)[~toxic].mean()  # noqa: E731, B023
        cut = toxicity.best_cut(strength, toxic)
        assert gain(cut) >= max(gain(c) for c in [*strength, *(strength + 0.01)] if (strength >= c).any()) - 1e-9
