"""The training-data operators against brute force, libraries and planted cases on small tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from claimloom.llm import bpe, chat, components, hnsw, langid, mixing, probminhash, quality, topk, toxicity, warc
from claimloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n)]


def documents(spark):
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    rows = [
        (0, " ".join(base), "en", "a", 1), (1, " ".join(base).upper(), "en", "a", 1), (2, " ".join(near), "en", "b", 1), (3, " ".join(words(2, 90)), "de", None, 1),
        (4, "", "de", "b", 0), (5, None, None, None, None), (6, "kurz", "de", "c", 4), (7, "kurz", None, "c", 4), (7, "kurz", None, "c", 4), (8, "12 34 !!", "en", "a", 3), (9, " ".join(words(3, 30_000)), "en", "b", 9),
    ]
    return spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", score string")


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "<p>é\r\n\r\nWARC/1.1</p>"), (2, None, None), (3, "http://b/\r\nX: y", ""), (4, "http://c/", "<p>é\r\n\r\nWARC/1.1</p>"), (None, "http://d/", "z")]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"), with_payload=True)
    captures = warc.assemble(records)
    got = {r.page_id: r for r in warc.resolve(captures).collect()}
    size = len(pages[0][2].encode())
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in got.items()} == {1: ("response", None, size), 2: ("response", None, 0), 3: ("revisit", 2, 0), 4: ("revisit", 1, size), None: ("response", None, 1)}
    assert got[1].payload_digest == got[4].payload_digest and len(got[1].payload_digest) == 32
    assert got[2].payload_digest == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    nested = captures.filter("metadata.page_id = 1").head()
    assert nested.response.payload.decode() == pages[0][2] and nested.request.record_id == nested.capture_id


def test_chat_keeps_maximal_conversations(spark):
    turns = [(1, 0, "u", "hi"), (2, 0, "u", "hi"), (2, 1, "a", "yo"), (3, 0, "u", "hi"), (3, 1, "a", "yo"), (4, 0, "u", None), (5, 0, "uh", "i"), (None, 0, "u", "q"), (6, None, None, None), (6, 2, "u", "x")]
    got = chat.collapse(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.n_turns) for r in got} == {(2, 2), (4, 1), (5, 1), (6, 2)}
    assert next(r.rendered for r in got if r.conv_id == 2) == "<|u|>\nhi\n<|a|>\nyo\n"


def test_components(spark):
    edges = [(5, 4), (4, 3), (9, 8), (3, 9), (20, 21), (7, 7), (None, 1)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 8: 3, 9: 3, 20: 20, 21: 20, 7: 7}


def test_mixing_reaches_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), f"s{0 if i % 3 else i % 7}") for i in range(600)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, rows_per_bucket=50).collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert math.isclose(sum(t for t, _ in by.values()), 1.5 * total)
    assert all(abs(t - n) <= 12 for t, n in by.values())
    empty = mixing.mix(docs.limit(0))
    assert empty.count() == 0


@pytest.mark.parametrize("every", [1, 3])
def test_topk_is_brute_force(spark, every):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6)).astype(np.float32)
    x[10] = x[11]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [1.0] * 5 + [float("nan")]), (202, [0.0] * 6)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=every, k=4, block=40, query_block=20).collect()
    ids = [i for i in range(90)] + [202]
    f = {i: np.floor(1024 * np.array(r, float)).astype(int) for i, r in rows if i in ids}
    want = set()
    for q in (i for i in ids if i % every == 0):
        best = sorted(((-int(f[q] @ f[c]), c) for c in ids if c != q))[:4]
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    assert {tuple(r) for r in got} == want


def test_embedding_links_are_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    x = [(c + rng.normal(size=16) * s).tolist() for c in centres for s in (0, 0.05, 0.2, 0.3) for _ in range(3)]
    rows = [(i, v, i % 2 if i % 17 else None) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("inf")] * 16, 1), (903, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    kept = {r.vec_id: (np.array(r.embedding, float), r.label) for r in df.collect() if r.vec_id < 900 and r.label is not None}
    n, link = {i: 0 for i, *_ in rows}, {i: {i} for i, *_ in rows}
    for a, (u, la) in kept.items():
        for b, (v, lb) in kept.items():
            if a != b and la == lb and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.93:
                n[a] += 1
                link[a].add(b)
    changed = True
    while changed:
        changed = False
        for a in link:
            new = set().union(*(link[b] for b in link[a]))
            changed |= new != link[a]
            link[a] = new
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(df).collect()}
    assert got == {a: (n[a], min(link[a]), min(link[a]) == a) for a in n}


def test_audit_widens_beams_that_miss_sparse_links_beside_a_large_group():
    rng = np.random.default_rng(6)
    centre, base = rng.normal(size=32), rng.normal(size=(300, 32))
    x = np.concatenate([centre + 0.1 * rng.normal(size=(300, 32)), base, base + 0.1 * rng.normal(size=base.shape)])

    class Blind(hnsw.Graph):
        """Scans, but finds beside a sparse member only the member itself until the beam is 64 wide."""

        def search(self, q, width):
            sims = q @ self.v.T
            if width < 64:
                lone = (sims >= 0.93).sum(axis=1) < 32
                sims[lone[:, None] & (sims < sims.max(axis=1, keepdims=True))] = -2
            ids = np.argsort(-sims, axis=1)[:, :width]
            return ids, np.take_along_axis(sims, ids, axis=1)

    graph = Blind.__new__(Blind)
    graph.v = hnsw.unit(x).astype(np.float32)
    assert graph.audited_width(0.93) == 64


def slow_jp(a, b):
    return sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in {*a} & {*b})


def test_probability_jaccard():
    r = random.Random(4)
    for _ in range(30):
        a, b = ({k: r.choice([1, 1.7, 2.1]) for k in r.sample(range(12), 7)} for _ in range(2))
        pack = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))
        assert math.isclose(probminhash.probability_jaccard(pack(a), pack(b)), slow_jp(a, b), abs_tol=1e-12)


def test_signatures_estimate_probability_jaccard():
    m = 4096
    s = np.arange(1, 31, dtype=np.uint64) * np.uint64(2654435761)
    w = 1 + (np.arange(30) % 3).astype(float)
    sig = probminhash.signatures(np.concatenate([s[:24], s[6:]]), np.concatenate([w[:24], w[6:]]), np.repeat([0, 1], 24), 2, m)
    true = probminhash.probability_jaccard((np.sort(s[:24]), w[:24][np.argsort(s[:24])]), (np.sort(s[6:]), w[6:][np.argsort(s[6:])]))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_near_duplicates(spark):
    got = {(r.doc_id, r.class_id, r.kept) for r in probminhash.near_duplicates(documents(spark)).collect()}
    assert got == {(0, 0, True), (1, 0, False), (2, 0, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 6, False), (8, 8, True), (9, 9, True)}
    assert probminhash.near_duplicates(documents(spark).limit(0)).count() == 0


def test_near_duplicates_find_all_links_in_a_chain(spark):
    text, rows = words(8, 150), []
    for i in range(12):  # each differs from the one before in one word
        text = [*text[: 12 * i], f"new{i}", *text[12 * i + 1 :]]
        rows.append((i, " ".join(text)))
    got = probminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0}


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["", " ", "a  b\n\n c's <|endoftext|>x", "ÜberÉ 12  3 日本語 \x00 ok", "aaaa" * 50, "x  y", " ".join(words(6, 500))]
    ours = bpe.load(path)
    for text in texts:
        assert ours.encode(text) == t.encode(text, add_special_tokens=False).ids
        assert ours.decode(ours.encode(text)) == t.decode(ours.encode(text), skip_special_tokens=False)
    rows = bpe.encode_documents(documents(spark), path, with_ids=True).collect()
    assert len(rows) == 11 and all(r.decoded == t.decode(r.ids, skip_special_tokens=False) for r in rows)


def test_forward_sums_all_segmentations():
    m = langid.PieceModel(["x"], ["a", "ab", "b", langid.START], np.array([[0.2], [0.3], [0.1], [0.4], [0.01]]))
    total = math.exp(m.word_scores([langid.START + "aab"])[0, 0])
    assert math.isclose(total, 0.4 * (0.2 * 0.2 * 0.1 + 0.2 * 0.3))
    assert math.isclose(m.expected([langid.START + "aab"], np.array([[3.0]]))[3, 0], 3.0)


def labelled(spark, n=240):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 3 == 0
        ws = [r.choice(["the", "house", "of", "river", "stone", "and", "tree"]) for _ in range(40)]
        ws = [w.upper() + "!!" for w in ws] if bad else ws
        rows.append((i, " ".join(ws + ["moronic"] * 3 if toxic else ws), "en" if i % 2 else "de", "s", 1))
        if i % 2:
            rows[-1] = (i, rows[-1][1].replace("river", "fluss").replace("the", "das"), "de", "s", 1)
        else:
            rows[-1] = (*rows[-1][:2], "en", "s", 1)
        labels.append((i, 0 if bad else 1, int(toxic)))
    return spark.createDataFrame(rows + [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "123 %%", None, "s", 1)], DOCS), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    q = {r.doc_id: r for r in quality.predict(docs, quality.fit(docs, labels)).collect()}
    assert len(q) == 243 and q[900].score == 0 and q[901].predicted == 0
    held = [i for i in range(240) if q[i].held_out]
    assert np.mean([q[i].predicted == int(i % 4 != 0) for i in held]) > 0.95
    t = {r.doc_id: r for r in toxicity.predict(docs, toxicity.fit(docs, labels)).collect()}
    assert np.mean([t[i].predicted == int(i % 3 == 0) for i in held]) > 0.95
    assert all(0 <= r.expected_severity <= 2 for r in t.values()) and t[900].predicted == 0
    l = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs, tokenizer_path("piece_bpe_32k.model"))).collect()}
    assert np.mean([l[i].lang_pred == ("de" if i % 2 else "en") for i in range(240) if l[i].held_out]) > 0.95
    assert all(l[i].lang_pred == "und" and l[i].score == 0 for i in (900, 901, 902))


def test_toxicity_learns_words_that_no_clean_document_holds(spark):
    r = random.Random(12)
    plain = ["the", "house", "of", "river", "stone", "and", "tree"]
    rows = [(i, " ".join(r.choices(plain, k=30) + [f"{'abcdefghij'[i // 2 % 10] * 6}"] * (i % 2))) for i in range(400)]  # each word in 20 of 200 toxic documents
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = [g for g in toxicity.predict(docs, toxicity.fit(docs, labels)).collect() if g.held_out]
    assert len(got) > 40 and np.mean([g.predicted == g.doc_id % 2 for g in got]) > 0.95


def test_classifiers_without_labels(spark):
    docs, labels = labelled(spark, 8)
    assert quality.fit(docs, labels.limit(0)) is None and toxicity.fit(docs, labels.limit(0)) is None
    assert quality.predict(docs, None).count() == toxicity.predict(docs, None).count() == docs.count()


@pytest.mark.parametrize("blocks", [1, 2])
def test_block_links_join_what_brute_force_links(blocks):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 60, 120)]
    texts = []
    for edits in (0, 0, 1, 1, 2, 2, 3, 4, 6, 9, 14, 20):
        words = list(base)
        for at in rng.integers(0, len(words), edits):
            words[at] = f"x{rng.integers(0, 9)}"
        texts.append(" ".join(words))
    texts.append("")
    n = len(texts)
    rows = {"id": list(range(n)), "component": list(range(n)), "block": [i % blocks for i in range(n)], "bands": [np.array([7, i]) for i in range(n)], "text": texts}
    found = probminhash._block_links(7, rows, 0.8)
    parts = [probminhash.shingles(probminhash.word_hashes(pa.array([t]))[0]) for t in texts]
    true = {(i, j) for i in range(n) for j in range(i + 1, n) if (blocks == 1 or i % 2 != j % 2) and probminhash.probability_jaccard(parts[i], parts[j]) >= 0.8}

    def classes(edges):
        top = list(range(n))
        for a, b in list(edges) * n:
            top[a] = top[b] = min(top[a], top[b])
        return top

    assert true and set(found) <= true and classes(found) == classes(true)
    assert probminhash._block_links(8, rows, 0.8) == []
