"""Constructions over roles against a walk over every word, and statements that name places without being about applicants."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from claimloom.operators import scopes

SAID = {
    "Chinese applicants need 90%": [("China", "DEMONYM")], "Applicants from mainland China": [("China", "APPLICANT_ORIGIN")], "students who are based in the United States": [("United States", "APPLICANT_ORIGIN")],
    "qualifications obtained in India": [("India", "QUALIFICATION_ORIGIN")], "If you are from Hong Kong, send it": [("Hong Kong", "CONDITIONAL_ORIGIN")], "the Malaysia Higher School Certificate": [("Malaysia", "NATIONAL_QUALIFICATION")],
    "EU students and US citizens": [("EU", "DEMONYM"), ("United States", "DEMONYM")], "Hong Kong Diploma": [("Hong Kong", "NATIONAL_QUALIFICATION")],
    "non-US citizens": [], "students from outside the EU": [], "not Chinese applicants": [], "other than Indian students": [], "contact us and study with us": [], "Chinese medicine": [], "a campus in Beijing, China": [], "India Street 5": [], "us students": [], "": [],
    "applicants except Singaporean nationals": [],
}


@pytest.mark.parametrize("text", SAID)
def test_scopes_of_sentences(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(scopes.jurisdictions(F.col("t")).alias("j")).head().j
    assert sorted((x.place, x.construction) for x in got) == sorted(SAID[text])


def slow(text):
    """Every place, every construction, every distance between words, by loops."""
    for pattern, one in scopes.JOINED:
        text = re.sub(pattern, one, text)
    w = re.findall(r"[^\W_]+", text)
    low = [x.lower() for x in w]
    is_ = lambda k, role: 0 <= k < len(w) and low[k] in scopes.ROLES[role]
    name = lambda k: 0 <= k < len(w) and (scopes.ABBREVIATIONS.get(w[k]) or scopes.NAMES.get(low[k]) or scopes.BOTH.get(low[k]))
    adjective = lambda k: 0 <= k < len(w) and (scopes.ABBREVIATIONS.get(w[k]) or scopes.ADJECTIVES.get(low[k]) or scopes.BOTH.get(low[k]))
    out = set()
    for k in range(len(w)):
        if adjective(k) and any(is_(k + 1, r) for r in "WQA") and not is_(k - 1, "n"):
            out.add((adjective(k), "DEMONYM", k))
        if name(k):
            for gap in range(3):
                if is_(k + 1 + gap, "C") and not any(is_(j, "n") for j in range(k + 1, k + 1 + gap)) and not is_(k - 1, "n"):
                    out.add((name(k), "NATIONAL_QUALIFICATION", k))
            before = k - 1 if not is_(k - 1, "t") else k - 2
            begins = [before] if is_(before, "f") else [before - 1] if is_(before, "i") and (is_(before - 1, "l") or is_(before - 1, "A")) else []
            for b in begins:
                for start in {b - 1} | ({b - 2} if is_(b - 1, "b") else set()) | ({b - 3} if is_(b - 1, "b") and is_(b - 2, "w") else set()):
                    if is_(start, "W") and not is_(start - 1, "n"):
                        out.add((name(k), "APPLICANT_ORIGIN", k))
                if is_(b - 1, "c") and not is_(b - 2, "n"):
                    out.add((name(k), "CONDITIONAL_ORIGIN", k))
            if is_(before, "f") or is_(before, "i"):
                for start in {before - 1} | ({before - 2} if is_(before - 1, "o") else set()):
                    if is_(start, "Q") and not is_(start - 1, "n"):
                        out.add((name(k), "QUALIFICATION_ORIGIN", k))
    return out


def test_constructions_are_those_of_a_walk_over_all_words(spark):
    rng = random.Random(11)
    some = ["US", "us", "EU", "Hong Kong", "China", "chinese", "India", "Indian", "not", "non", "other than", "outside", "the", "in", "from", "who", "are", "based", "resident", "if you are", "students", "results", "obtained", "certificate", "school", "and", "of"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    texts += [f"{n} {a} {f} {p}" for n, a, f, p in itertools.product(["", "non", "all"], ["students", "students who are", "results", "if you are"], ["from", "based in", "in", "from the"], ["China", "US", "Hong Kong"])]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scopes.jurisdictions(F.col("t")).alias("j")).collect()
    differ = [(r.t, {(x.place, x.construction, x.word) for x in r.j}, slow(r.t)) for r in got if not {(x.place, x.construction, x.word) for x in r.j} <= slow(r.t)]
    assert not differ, differ[:3]
    # matches of one construction don't overlap, so of two that share words the first counts; places that the walk alone finds lie in such a one
    missed = [(r.t, slow(r.t) - {(x.place, x.construction, x.word) for x in r.j}) for r in got]
    missed = [(t, m) for t, m in missed if any(c != "NATIONAL_QUALIFICATION" for _, c, _ in m)]
    assert not missed, missed[:3]
    assert sum(len(r.j) for r in got) > 300


def test_requirements_need_something_asked_and_someone_it_is_asked_of(spark):
    rows = [(1, "A levels at AAA are required", "Computer Science BSc"), (2, "Applicants from India must have 80%", None), (3, "Applicants from India are welcome", None), (4, "You need a bachelor's degree in economics", "Master of Finance"), (5, "You must hurry", None), (6, None, None)]
    df = spark.createDataFrame([(i, 0, t, h) for i, t, h in rows], "page_id long, place int, text string, heading string")
    got = {r.page_id: (r.scope, r.systems, r.level, r.discipline, [x.code for x in r.jurisdictions]) for r in scopes.admission_requirements(df).collect()}
    assert got == {1: ("QUALIFICATION_SYSTEM", ["A-level"], "BACHELOR", "COMPUTER_AND_DATA", []), 2: ("JURISDICTION", [], None, None, ["IN"]), 4: ("UNSTATED", [], "BACHELOR", "BUSINESS", [])}
