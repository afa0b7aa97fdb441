"""N-gram automata, conversation tries and conversation repair against plain versions in Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.llm import ngrams, repair, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- n-grams

def words_of(text):
    return [w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(text or "")] + ["\n"]


def slow_scores(rows, order):
    """p(w | h) by its recursion over whole histories, word by word."""
    counts, tokens = [Counter() for _ in range(order)], 0
    for i, text in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            w = words_of(text)
            tokens += len(w)
            for n in range(order):
                counts[n].update(tuple(w[k:k + n + 1]) for k in range(len(w) - n))
    floor = tokens + 0.1 * (len(counts[0]) + 1)
    priors = []
    for n in range(1, order):
        per = Counter()
        total = Counter()
        for gram, c in counts[n - 1].items():
            if gram[-1] != "\n":
                per[math.floor(8 * math.log2(c))] += 1
                total[math.floor(8 * math.log2(c))] += c
        priors.append(ngrams.prior([(per[k], total[k]) for k in sorted(per)], sum(c == 1 for c in counts[n].values()), sum(counts[n].values())))

    def p(history, word):
        if not history:
            return (counts[0][(word,)] + 0.1) / floor
        n = len(history)
        return (counts[n][(*history, word)] + priors[n - 1] * p(history[1:], word)) / (counts[n - 1][history] + priors[n - 1])

    out = []
    for i, text in rows:
        w = words_of(text)
        out.append((i, len(w), sum((x,) in counts[0] for x in w), tokens, sum(math.log10(p((), x)) for x in w), sum(math.log10(p(tuple(w[max(0, k - order + 1):k]), x)) for k, x in enumerate(w))))
    return out, counts, p


def same_scores(found, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    found, wanted = sorted(found, key=key), sorted(wanted, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    np.testing.assert_allclose([r[4:] for r in found], [r[4:] for r in wanted], rtol=1e-9)


def columns(df):
    return [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in df.collect()]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_ngrams_of_whole_texts_are_the_recursion(spark, order, monkeypatch):
    monkeypatch.setattr(ngrams, "CHUNK_BYTES", 400)  # many chunks, and a text longer than one
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choice("a b c d E é".split()) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(7, rows[7][1]), (7, "x \x0b y\x1c\xa0z Ａ"), (None, "no id"), (100, None), (101, " \t\n"), (102, "a b " * 600)]
    wanted, _, _ = slow_scores(rows, order)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same_scores(columns(ngrams.score(df, order)), wanted)


def test_ngram_buckets_and_pieces_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 50)))) for i in range(80)]
    wanted, _, _ = slow_scores(rows, 3)
    monkeypatch.setattr(ngrams, "BUCKET_GRAMS", 200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    same_scores(columns(ngrams.score(df, 3)), wanted)
    codes, hashes, lengths = ngrams.tokens(pa.array([t for _, t in rows]))
    grams = ngrams.Grams(codes, hashes, lengths, np.ones(len(rows), dtype=bool), 3)
    machine = ngrams.Automaton(grams, lambda c: np.log10((c + 0.1) / (c.sum() + 1)), [3.0, 2.0])
    whole = machine.read(grams.codes, grams.begins)
    for piece in (1, 2, 7):
        np.testing.assert_allclose(machine.read(grams.codes, grams.begins, piece), whole)


def test_ngram_probabilities_of_a_history_add_up_to_one():
    rows = [(i, "a b a c a b d") for i in range(3)] + [(11, "b b d a")]
    _, counts, p = slow_scores(rows, 3)
    vocabulary = [w for (w,) in counts[0]]
    for history in [(), ("a",), ("a", "b"), ("d", "a"), ("zz", "a"), ("zz", "zz")]:
        assert sum(p(history, w) for w in vocabulary) + p(history, "never seen") == pytest.approx(1.0)


def test_ngrams_of_empty_tables_other_columns_and_no_training_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngrams.score(empty).collect() == []
    clash = spark.createDataFrame([("a", "x y", 1, b"q"), ("b", None, 2, None)], "doc_id string, text string, chunk int, codes binary")
    got = {r["doc_id"]: r for r in ngrams.score(clash.withColumn("held_out_", F.lit(1)), held_out=F.lit(True)).collect()}
    assert (got["a"]["n_tokens"], got["b"]["n_tokens"], got["a"]["n_known"], got["a"]["train_tokens"]) == (3, 1, 0, 0)
    assert got["a"]["score"] == got["a"]["base_score"] == pytest.approx(0.0)
    with pytest.raises(ValueError):
        ngrams.score(clash, order=0)


def test_longer_histories_predict_held_out_texts_better(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = [ngrams.score(docs, n).filter("held_out").agg(F.sum("score"), F.sum("base_score")).head() for n in (1, 2, 3)]
    assert sums[0][0] == pytest.approx(sums[0][1])
    assert sums[2][0] > sums[1][0] > sums[0][0]


# --- tries

def slow_nodes(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    convs = {c: [y[2] for y in sorted(v)] for c, v in convs.items()}
    again = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        again[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members = {}
    for c, v in again.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children.get(p, [])]
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        sums[p] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(again[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made_conversations(seed):
    """Few different turns, so prefixes are shared; one conversation under many ids; nulls, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(-20, 120):
        n = rng.randint(1, 12)
        rows += [(c, i, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", ""])) for i in range(n)]
    for c in range(200, 400):
        rows += [(c, i, "user", "same") for i in range(10)]
    rows += [(3, 0, "user", "tie"), (3, 0, "user", "tie"), (4, None, None, None), (None, 1, "user", "x"), (1000, 0, None, "y" * 10_000), (1001, 5, "user", "only")]
    return rows


@pytest.mark.parametrize("per_range, run", [(100_000, 2000), (60, 3), (9, 1)])
def test_trie_of_any_ranges_is_the_plain_one(spark, per_range, run):
    rows = made_conversations(run)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1)).withColumn("range", F.lit(2))
    got = sorted((tuple(r) for r in trie.nodes(trie.rebuilt(df), per_range, run).collect()), key=str)
    assert got == slow_nodes(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert trie.nodes(trie.rebuilt(spark.createDataFrame([], kind))).collect() == []
    assert trie.nodes(trie.rebuilt(spark.createDataFrame([(None, 1, "user", "a")], kind))).collect() == []
    rows = [(c, 0, "user", "a") for c in range(1, 5)]  # 0 is absent, so most have no turn left
    got = sorted((tuple(r) for r in trie.nodes(trie.rebuilt(spark.createDataFrame(rows, kind))).collect()), key=str)
    assert got == slow_nodes(rows)
    assert got[-1][2] is None or got[0][2] is None


def test_loser_tree_merges_and_keeps_shared_prefixes():
    rng = random.Random(2)
    turns = [bytes([k]) * trie.WIDTH for k in range(3)]
    rows = [(b"".join(rng.choice(turns) for _ in range(rng.randint(0, 9))), i, []) for i in range(500)]
    for cut in (1, 7, 100, 500):
        got = list(trie.merged([trie.sorted_run(rows[k:k + cut]) for k in range(0, len(rows), cut)]))
        assert [tuple(e[1:3]) for e in got] == sorted(r[:2] for r in rows)
        assert [e[0] for e in got] == [0] + [trie.shared(a[1], b[1]) for a, b in zip(got, got[1:], strict=False)]
    assert list(trie.merged([])) == list(trie.merged([[]])) == []


def test_merging_compares_no_shared_turn_again(monkeypatch):
    rng = random.Random(3)
    deep = b"d" * trie.WIDTH * 200
    runs = [trie.sorted_run([(deep + bytes([rng.randrange(256)]) * trie.WIDTH, i * 50 + j, []) for j in range(50)]) for i in range(8)]
    looked, plain = [0], trie.shared

    def counted(a, b, start=0):
        n = plain(a, b, start)
        looked[0] += n - start
        return n

    monkeypatch.setattr(trie, "shared", counted)
    assert len(list(trie.merged(runs))) == 400
    assert looked[0] < 8 * 202 * 2  # the deep prefix is read for the first matches only, not for each of 400 entries


# --- repair

@lru_cache(None)
def slow_solution(signature):
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def go(i, last, inserted):
        found = [(0, "")] if i == len(signature) and last in ("", "a") else []

        def add(price, letter, rest):
            if rest:
                found.append((price + rest[0], letter + rest[1]))

        if inserted < 3:
            add(5, "I", go(i, follows[last], inserted + 1))
        if i < len(signature):
            x = signature[i]
            add(2, "D", go(i + 1, last, 0))
            if x != "x":
                late, role = 5 * x.isupper(), x.lower()
                if role == follows[last] or (role == "s" and last == ""):
                    add(late, "K", go(i + 1, role, 0))
                add(1 + late, "R", go(i + 1, follows[last], 0))
        return min(found) if found else None

    return go(0, "", 0)


def test_solutions_are_the_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(4000):
        letters = "xsuaoSUAO"[:rng.randint(2, 9)]
        signature = "".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))
        assert repair.solve(signature) == slow_solution(signature), signature
    cost, audit = repair.solve("uaU" * 30_000)
    assert len(audit.replace("I", "")) == 90_000 and cost > 0


def slow_repairs(rows):
    convs, ids = {}, {r[0] for r in rows if r[0] is not None}
    for c, t, r, x in rows:
        if c is None:
            continue
        fate = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if fate:
            x = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
            convs.setdefault(c, []).extend([(t is not None, t or 0, "user" if fate == 4 else r, x)] * (1 + (fate == 3)))
    out = []
    for c in ids:
        turns, seen, signature, faults = sorted(convs.get(c, [])), set(), "", [0, 0, 0]
        for _, _, r, x in turns:
            body = x.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (r, x) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((r, x))
            if fault is not None:
                faults[fault] += 1
            letter = r[:1] if r[:1] in ("s", "u", "a") else "o"
            signature += "x" if fault in (0, 1) else letter.upper() if fault == 2 else letter
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit = slow_solution(signature)
        left, last, said = iter(turns), "", []
        for edit in audit:
            if edit == "D":
                next(left)
                continue
            _, _, r, x = (0, 0, "", "") if edit == "I" else next(left)
            if edit != "K":
                r = "assistant" if last == "u" else "user"
            last = r[:1]
            said.append(f"{r}:{x}")
        numbers = [t for some, t, _, _ in turns if some]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((c, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out)


KIND = "conv_id long, turn long, role string, text string"


def test_repairs_of_odd_conversations_are_the_plain_ones(spark):
    rng = random.Random(4)
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["system", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "no", "No! \n", "", " \t", None, "é?", "a b.\x0b"])) for c in range(150) for _ in range(rng.randint(1, 9))]
    rows += rows[:40] + [(None, 1, "user", "lost."), (500, 0, "user", "w. " * 100_000)]
    df = spark.createDataFrame(rows, KIND).withColumn("audit", F.lit("clash")).withColumn("signature", F.lit(0))
    assert sorted(tuple(r) for r in repair.repair(repair.damaged(df), df).collect()) == slow_repairs(rows)


def test_a_signature_that_most_conversations_have_is_joined_either_way(spark):
    rows = [(c, i, "ua"[i % 2] and ["user", "assistant"][i % 2], f"t{i}.") for c in range(300) for i in range(4)]
    df = spark.createDataFrame(rows, KIND)
    assert sorted(tuple(r) for r in repair.repair(repair.damaged(df), df).collect()) == slow_repairs(rows)
    signed = spark.createDataFrame([(i, "ua" if i % 3 else "u" * (i % 50)) for i in range(600)], "conv_id long, signature string")
    for most, most_bytes in ((10_000, 1 << 20), (5, 1 << 20), (5, 0), (1, 1 << 20)):
        got = repair.with_audits(signed, most, most_bytes).collect()
        assert len(got) == 600
        assert all((r["cost"], r["audit"]) == repair.solve(r["signature"]) for r in got)


def test_repair_of_nothing_and_of_conversations_without_rows(spark):
    empty = spark.createDataFrame([], KIND)
    assert repair.repair(repair.damaged(empty), empty).collect() == []
    ids = spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")
    assert [tuple(r) for r in repair.repair(empty, ids).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
