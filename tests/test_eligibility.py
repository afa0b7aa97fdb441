"""Views kept up to date from changes equal views computed anew, and read only what a change touches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import deltas, eligibility

SCHEMAS = {
    "sources": "source_id long, url_hash string, eligibility string", "mappings": "source_id long, url_hash string, eligibility string, domain string, is_active boolean",
    "domains": "domain string, status string, domain_active boolean", "evidence": "fact_id long, source_id long, is_ranking boolean",
}


def made(rng, name):
    i = rng.randrange(8)
    kind = rng.choice(["OFFICIAL", "AUTHORIZED_RANKING"]) if i else "TARGET_SCOPE_ONLY"
    return {
        "sources": (i, "a", kind), "mappings": (i, rng.choice("aaab"), kind, rng.choice("xyz"), rng.random() < 0.8), "domains": (rng.choice("xyz"), rng.choice(["VERIFIED_OFFICIAL", "VERIFIED_OFFICIAL", "CANDIDATE"]), rng.random() < 0.8),
        "evidence": (rng.randrange(12), rng.choice([i, None]), rng.random() < 0.4),
    }[name]


@pytest.mark.parametrize("seed", [1, 2])
def test_views_after_random_changes_are_those_computed_anew(spark, tmp_path, seed):
    rng = random.Random(seed)
    base = {n: [made(rng, n) for _ in range(k)] for n, k in (("sources", 12), ("mappings", 30), ("domains", 4), ("evidence", 40))}
    frame = lambda rows, n, more="": spark.createDataFrame(rows, SCHEMAS[n] + more)
    e = eligibility.Eligibility(spark, str(tmp_path / "e"), {n: frame(r, n) for n, r in base.items()}, 4)
    seen = 0
    for _ in range(3):
        changes = {}
        for n in rng.sample(list(SCHEMAS), rng.randint(1, 4)):
            rows = []
            for _ in range(rng.randint(1, 5)):
                if rng.random() < 0.5 and base[n]:
                    rows.append((*base[n].pop(rng.randrange(len(base[n]))), -1))
                else:
                    base[n].append(made(rng, n))
                    rows.append((*base[n][-1], 1))
            changes[n] = frame(rows, n, ", w long")
        e.apply(changes)
        t = {n: frame(r, n) for n, r in base.items()}
        earned = eligibility.earned(t["sources"], t["mappings"], t["domains"])
        for name, want in (("earned", earned), ("supported", eligibility.supported(t["evidence"], earned))):
            got = e.store.table(name).select(*want.columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
            seen += want.count()
    assert seen > 10


def test_a_withdrawal_undoes_only_what_nothing_else_supports(spark, tmp_path):
    f = lambda n, *rows: spark.createDataFrame(list(rows), SCHEMAS[n])
    tables = {
        "sources": f("sources", (1, "a", "OFFICIAL"), (2, "b", "OFFICIAL")), "mappings": f("mappings", (1, "a", "OFFICIAL", "x", True), (1, "a", "OFFICIAL", "y", True), (2, "b", "OFFICIAL", "x", True)),
        "domains": f("domains", ("x", "VERIFIED_OFFICIAL", True), ("y", "VERIFIED_OFFICIAL", True)), "evidence": f("evidence", (10, 1, False), (10, 2, False), (11, 2, False), (12, 1, True)),
    }
    e = eligibility.Eligibility(spark, str(tmp_path / "e"), tables, 8)
    facts = lambda: {(r.fact_id, r.n) for r in e.store.table("supported").collect()}
    assert facts() == {(10, 2), (11, 1)}
    gone = spark.createDataFrame([("x", "VERIFIED_OFFICIAL", True, -1)], SCHEMAS["domains"] + ", w long")
    e.apply({"domains": gone})
    assert facts() == {(10, 1)}  # source 1 still rests on y
    e.apply({"domains": gone.withColumn("w", F.lit(1).cast("long"))})
    assert facts() == {(10, 2), (11, 1)}
    assert set(e.apply({}).values()) == {0}


def test_a_change_reads_and_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    b = deltas.Buckets(spark, str(tmp_path / "b"), 32)
    b.create("t", spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), ["k"])
    change = spark.createDataFrame([(5, 10, -1), (5, 11, 1), (3000, 1, 1)], "k long, v long, w long")
    buckets = b.touched("t", change)
    assert len(buckets) <= 2
    files = b.at("t", change).select(F.input_file_name().alias("f")).distinct().collect()
    assert len(files) <= 2 and all(any(f"bucket={n}/" in r.f for n in buckets) for r in files)
    assert b.apply("t", change) == len(buckets)
    assert b.table("t").count() == 2001 and [r.v for r in b.table("t").filter("k = 5").collect()] == [11]


def test_changes_of_joins_and_counts(spark):
    z = lambda rows, c: spark.createDataFrame(rows, c + ", w long")
    left, right = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, l string"), spark.createDataFrame([(1, "x"), (None, "y")], "k long, r string")
    d = deltas.join_change(left, right, z([(1, "a", -1), (2, "b", 1), (3, "c", 1)], "k long, l string"), z([(2, "q", 1), (1, "x", -1), (3, "z", 1)], "k long, r string"), ["k"])
    assert {(r.k, r.l, r.r, r.w) for r in d.collect()} == {(1, "a", "x", -2), (2, "b", "q", 2), (3, "c", "z", 1)}
    c = deltas.count_change(spark.createDataFrame([(1, 2), (2, 1)], "k long, n long"), z([(1, -1), (1, 1), (2, -1), (4, 1)], "k long"), ["k"])
    assert {(r.k, r.before, r.after) for r in c.collect()} == {(2, 1, 0), (4, 0, 1)}
    assert {(r.k, r.w) for r in deltas.turned(c, ["k"]).collect()} == {(2, -1), (4, 1)}
