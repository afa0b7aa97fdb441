"""The near-duplicate stage of the pipeline against a comparison of all pairs."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa

import corpus_pipeline
from claimloom.llm import probminhash


def text(seed, changed=None):
    words = ["".join(random.Random(seed * 1000 + i).choices("abcdefgh", k=6)) for i in range(150)]
    return " ".join(words if changed is None else [*words[:changed], "changed", *words[changed + 1 :]])


ROWS = [
    (1, text(1)), (2, text(1, 70)), (3, text(2)),
    (None, text(3)), (None, text(3, 20)), (None, text(4)), (None, text(4)), (None, text(5)), (None, text(1, 30)),  # without an id: near copies, equal ones, a unique one, a copy of 1
    (7, text(6)), (7, text(7)), (8, text(6, 40)), (9, text(7, 40)),  # one id on two texts, each with a copy
    (10, text(8)), (10, text(8, 90)), (11, text(9)), (11, text(9)), (11, text(9).upper()),  # one id on two near copies, repeated rows
    (12, ""), (None, ""), (None, None), (12, "  "), (12, None),
]


def expected():
    b = pa.RecordBatch.from_pydict({"n": range(len(ROWS)), "doc_id": [r[0] for r in ROWS], "digest": [0] * len(ROWS), "text": [r[1] for r in ROWS]})
    key = {r["n"]: (r["k1"], r["k2"]) for part in probminhash.sketch(iter([b])) for r in part.to_pylist()}
    parts = [probminhash.shingles(probminhash.word_hashes(pa.array([t or ""]))[0]) for _, t in ROWS]
    top = list(range(len(ROWS)))
    for _ in ROWS:
        for i in range(len(ROWS)):
            for j in range(i):
                if key[i][0] is not None and key[j][0] is not None and probminhash.probability_jaccard(parts[i], parts[j]) >= 0.8:
                    top[i] = top[j] = min(top[i], top[j])
    kept = []
    for c in set(top):
        members = [i for i, t in enumerate(top) if t == c]
        kept.append(min(members, key=lambda i: (ROWS[i][0] is None, ROWS[i][0] or 0, key[i])))
    return Counter((ROWS[i][0], (ROWS[i][1] or "").lower()) for i in kept)


def test_near_duplicate_stage_is_brute_force(spark):
    docs = spark.createDataFrame([(*r, "en") for r in ROWS], "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r.doc_id, (r.text or "").lower()) for r in got.collect()) == expected()


def test_rows_of_one_id_and_text_end_alike_in_any_order(spark):
    """Which of them stays, and what the mix takes, doesn't depend on the order in which rows are read."""
    said = [text(s) for s in range(6)]
    rows = [(i % 7 if i % 7 else None, said[i % 3 + 3 * (i % 2)], f"s{i % 5}", {"k": i % 4}) for i in range(60)]
    seen = set()
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra map<string,int>").repartition(seed + 1)
        got = [corpus_pipeline.drop_near_duplicates(spark, docs, ""), corpus_pipeline.mix_sources(spark, docs, "")]
        seen.add(tuple(tuple(sorted(repr(r) for r in g.collect())) for g in got))
    assert len(seen) == 1


def test_stages_are_brute_force_and_keep_every_column(spark, tmp_path):
    """All stages on documents with columns of clashing names, null and repeated ids, against their rules applied one by one."""
    from tokenizers import Tokenizer

    from claimloom.llm import langid, mixing, quality
    from claimloom.llm.queries import tokenizer_path

    r = random.Random(5)
    plain = {"en": ["the", "house", "river", "green", "stone"], "de": ["das", "haus", "fluss", "stein", "und"]}
    rows = []
    for i in range(160):
        lang = "de" if i % 2 else "en"
        said = r.choices(plain[lang], k=40)
        rows.append((i, " ".join(w.upper() + "!!" for w in said) if i % 5 == 0 else " ".join(said), lang, f"s{i % 3}"))
    rows += [(None, rows[1][1], "de", "s0"), (1, rows[2][1] + " more", "en", None), (161, None, None, None), (162, "12 34", None, "s1"), (3, rows[3][1], "de", "s2"), (163, "the house " * 20_000, "en", "s0")]
    docs = spark.createDataFrame([(*x, len(x[1] or ""), "old", "old", i) for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, score string, size string, n long")
    folder = tmp_path / "tables"
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(folder))
        assert out.columns == docs.columns, name
        before, after = now.collect(), out.collect()
        if name == "quality classifier":
            model = quality.fit(now, spark.read.parquet(f"{folder}/labels.parquet"))
            good = {(x.doc_id, x.score) for x in quality.predict(now, model).collect() if x.predicted}
            assert {x.doc_id for x in after} == {d for d, _ in good} and not any(x.doc_id is not None and x.doc_id < 160 and x.n < 160 and x.n % 5 == 0 for x in after)
        elif name == "language id":
            model = langid.fit(now, tokenizer_path("piece_bpe_32k.model"))
            sure = langid.predict(now, model, keep=("n",)).collect()
            assert {x.n for x in after} == {x.n for x in sure if x.score >= 0.5} and all(x.text for x in after)
        elif name == "minhash near-dedup":
            assert {x.text.lower() for x in after} <= {x.text.lower() for x in before} and len({x.text.lower() for x in after}) == len(after)
        else:
            taken = {x.n: x.taken // max(1, x["size"]) for x in mixing.mix(now.drop("size")).collect()}
            assert Counter(x.n for x in after) == Counter({n: t for n, t in taken.items() if t})
        now = out
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    last = corpus_pipeline.STAGES[-1][1](spark, now, str(folder)).collect()
    assert Counter((x.doc_id, x.n_tokens) for x in last) == Counter((x.doc_id, len(t.encode(x.text, add_special_tokens=False).ids)) for x in now.collect())
    assert corpus_pipeline.run(spark, str(folder)).count() == len(last)


def test_pipeline_of_empty_tables_has_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == 0
