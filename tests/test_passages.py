"""Passages in texts against a search of every text for every passage."""

from __future__ import annotations

import random

from claimloom.operators import passages, registers


def test_passages_found_are_those_of_a_full_search(spark):
    rng = random.Random(8)
    some = ["a", "b", "cc", "dd.", "é"]
    quotes = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(1, 9)))) for i in range(60)] + [(100, None), (101, ""), (102, "  a \t b\n cc ")]
    docs = [(i, rng.choice([" ", "\n", "  "]).join(rng.choice(some) for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(500, None), (501, "xa b ccy")]
    fold = lambda t: " ".join(t.split())
    want = {}
    for item, q in quotes:
        if q and len(fold(q).split()) >= 3:
            holds = [d for d, t in docs if t is not None and fold(q) in fold(t)]
            if holds:
                want[item] = (len(holds), min(holds))
    q, t = spark.createDataFrame(quotes, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for gram in (1, 3, 5):
        assert {r.item_id: (r.documents, r.first_doc) for r in passages.quoted(q, t, gram).collect()} == want
    assert passages.quoted(q.limit(0), t).count() == 0 and passages.quoted(q, t.limit(0)).count() == 0


def test_hosts_find_their_domains_by_whole_labels(spark):
    hosts = spark.createDataFrame([(1, "www.a.edu"), (2, "a.edu"), (3, "xa.edu"), (4, "b.c.a.edu"), (5, None), (6, "local"), (7, "www.a.edu"), (8, "z.org")], "id long, host string")
    states = list(registers.STATE_ORDER)
    domains = spark.createDataFrame([("a.edu", states[1], True), ("c.a.edu", states[0], False), ("b.c.a.edu", states[2], True), ("edu", states[-1], True), ("local", states[0], False), ("org", states[0], False)], "host string, status string, covers_subdomains boolean")
    got = {r.id: (r.domain_host, r.domain_status) for r in registers.best_domain(hosts, domains).collect()}
    assert got == {1: ("a.edu", states[1]), 2: ("a.edu", states[1]), 3: ("edu", states[-1]), 4: ("a.edu", states[1]), 5: (None, None), 6: ("local", states[0]), 7: ("a.edu", states[1]), 8: (None, None)}
