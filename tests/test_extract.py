"""Claims that the rules find in blocks, and those they must not find."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from claimloom.functions import matches
from claimloom.operators import documents, extract

SCHEMA = "page_id long, place int, kind string, text string, heading string, column_header string, row_label string"


def page(spark, *texts, heading="About", kind="p", header=None, label=None):
    return spark.createDataFrame([(1, i + 1, kind, t, heading, header, label) for i, t in enumerate(texts)], SCHEMA)


def read(spark, html):
    return documents.documents(spark.createDataFrame([(1, "https://a.edu/", html)], "page_id long, url string, html string"))


FEES = {
    "Tuition fee: £23,500 per year for international students": ("EXACT", 23500.0, 23500.0, "GBP", "PER_YEAR", "INTERNATIONAL"),
    "Fees are $12,000 to $15,000 per semester": ("RANGE", 12000.0, 15000.0, "USD", "PER_SEMESTER", None),
    "The fee was $90,574 - $83,000": ("AMBIGUOUS", 90574.0, 83000.0, "USD", None, None),
    "Fee up to €9000 in total": ("UP_TO", None, 9000.0, "EUR", "TOTAL_PROGRAM", None),
    "Tuition from HK$42,100 for non-local students": ("FROM", 42100.0, None, "HKD", None, "NON_LOCAL"),
    "The fee varies by course": ("VARIABLE", None, None, None, None, None),
}


def test_fees_of_each_shape(spark):
    got = extract.fees(page(spark, *FEES)).orderBy("place").collect()
    assert [(r.shape, r.amount_min, r.amount_max, r.currency, r.unit, r.students) for r in got] == list(FEES.values())
    assert got[2].unresolved == ["AMOUNT_SHAPE_AMBIGUOUS", "BILLING_UNIT_UNRESOLVED", "STUDENT_CATEGORY_UNRESOLVED"]


def test_fees_name_all_groups_of_students(spark):
    got = extract.fees(page(spark, "Fee £9,000 for home and international students", "Fee £9,000", "Fee £9,000 for non-local students")).orderBy("place").collect()
    assert [r.student_categories for r in got] == [["INTERNATIONAL", "HOME"], [], ["NON_LOCAL"]]


def test_fees_need_an_amount_that_stands_alone_outside_chrome(spark):
    assert extract.fees(page(spark, "Fees: Evanston, IL 60208", "The fee code is 122,0,223", "Costs in 2027")).count() == 0
    assert extract.fees(documents.statements(read(spark, "<nav><p>Fee £9,000</nav><footer><table><tr><th>Fee<tr><td>£9,000</table></footer>"))).count() == 0
    assert [r.band for r in extract.fees(page(spark, "Fee £9,000", heading="Fees")).collect()] == ["MEDIUM"]
    assert [r.band for r in extract.fees(page(spark, "£9,000", heading="Fees", kind="td")).collect()] == ["HIGH"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("IELTS 7.0 overall with no component below 6.5", [("IELTS", "OVERALL", None, "AT_LEAST", 7.0), ("IELTS", "COMPONENT_MINIMUM", None, "AT_LEAST", 6.5)]),
        ("7.0 in IELTS, 100 in TOEFL, or 76 in PTE", [("IELTS", "OVERALL", None, "AT_LEAST", 7.0), ("TOEFL", "OVERALL", None, "AT_LEAST", 100.0), ("PTE", "OVERALL", None, "AT_LEAST", 76.0)]),
        ("A minimum IELTS of 6 or TOEFL of 80", [("IELTS", "OVERALL", None, "AT_LEAST", 6.0), ("TOEFL", "OVERALL", None, "AT_LEAST", 80.0)]),
        ("IELTS above 6.5; writing 7.0", [("IELTS", "OVERALL", None, "ABOVE", 6.5), ("IELTS", "COMPONENT", "writing", "AT_LEAST", 7.0)]),
        ("English proficiency is required", []), ("IELTS is accepted", []), ("IELTS, Toronto M5R 0A3", []), ("TOEFL code 08541-6151", []), ("IELTS 1.0", []), ("", []),
    ],
)
def test_scores(text, expected):
    assert [s[:5] for s in extract.scores_in(text)] == expected


def test_english_scores_have_bands(spark):
    got = extract.english_scores(page(spark, "IELTS 7.0 overall", "Nothing", heading="English language")).collect()
    assert [(r.place, r.test, r.value, r.band) for r in got] == [(1, "IELTS", 7.0, "HIGH")]


def test_deadlines_take_wording_before_dates(spark):
    texts = ["Deadline: 15 January 2027", "Applications are closed. The deadline was 3 May 2026", "Admission on a rolling basis", "The term begins on January 5, 2027", "We apply until all places are filled"]
    got = extract.deadlines(page(spark, *texts)).orderBy("place").collect()
    assert [(r.place, r.state, r.year, r.month, r.day) for r in got] == [(1, "DATE", 2027, 1, 15), (2, "CLOSED", None, None, None), (3, "ROLLING", None, None, None), (5, "UNTIL_FILLED", None, None, None)]


def test_calendar_dates(spark):
    got = extract.calendar_dates(page(spark, "From 1 Sep to 20 December 2026, again January 2027", "Winter term 2026-27 December 4", "31 April", "Maybe 12 mice")).orderBy("place", "nth").collect()
    assert [(r.place, r.nth, r.year, r.month, r.day) for r in got] == [(1, 0, None, 9, 1), (1, 1, 2026, 12, 20), (1, 2, 2027, 1, None), (2, 0, None, 12, 4), (3, 0, None, 4, None)]


def test_programmes_once_per_name(spark):
    html = "<h2>MSc Data Science</h2><h3>msc data science</h3><h3>MSc Data Science</h3><h2>News</h2><nav><h2>PhD Law</h2></nav>"
    got = extract.programmes(documents.headings(read(spark, html))).collect()
    assert [(r.name, r.award, r.place) for r in got] == [("msc data science", "MASTER", 0)]


def test_no_statements(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [f(none).count() for f in (extract.fees, extract.english_scores, extract.deadlines, extract.calendar_dates)] == [0] * 4
    nulls = spark.createDataFrame([(1, 0, "p", None, None, None, None)], SCHEMA)
    assert [f(nulls).count() for f in (extract.fees, extract.english_scores, extract.deadlines, extract.calendar_dates)] == [0] * 4


def test_a_malformed_page_is_a_row_with_an_error_and_states_nothing(spark):
    docs = read(spark, "<![foo<p>Fee £9,000")
    assert docs.head().error.startswith("AssertionError") and documents.statements(docs).count() == 0


def test_fees_of_cells_under_spans(spark):
    html = "<h2>Fees</h2><table><tr><th>Level<th>Student<th>Fee a year<tr><td rowspan=2>BSc<td>Home<td>£9,000<tr><td>Overseas<td>£20,000</table>"
    got = {r.amount_min: (r.students, r.unit, r.band) for r in extract.fees(documents.statements(read(spark, html))).collect()}
    assert got == {9000.0: ("HOME", "PER_YEAR", "HIGH"), 20000.0: ("OVERSEAS", "PER_YEAR", "HIGH")}


MONEY = [
    ("Tuition", "Rent", "£1,000 for food", "£1,000", ["Housing"], "TUITION_FEE"), (None, "Rent", "£1,000 for food", "£1,000", [], "HOUSING"), ("Amount", "2027", "£1,000 for food, £2,000 for books", "2,000", [], "MEAL_PLAN"),
    (None, None, "x £1,000", "£1,000", ["Total cost", "Housing", "Other"], "HOUSING"), (None, None, "£1,000", "£1,000", [], "UNKNOWN_FINANCIAL_AMOUNT"), (None, None, None, None, None, "UNKNOWN_FINANCIAL_AMOUNT"),
    (None, None, "housing and food", "£1", [], "HOUSING"), (None, None, "Application fee is £50", "£50", ["Tuition"], "OTHER_MANDATORY_FEE"), ("personal expenses", None, "1", "1", [], "COST_OF_ATTENDANCE_COMPONENT"),
]


def test_what_money_is_for(spark):
    df = spark.createDataFrame(MONEY, "c string, r string, t string, a string, h array<string>, expected string")
    for r in df.withColumn("got", extract.money_kind(F.col("c"), F.col("r"), F.col("t"), F.col("a"), F.col("h"))).collect():
        assert r.got == r.expected, r


def test_places_of_matches_are_those_of_a_scan(spark):
    import random
    import re

    rng = random.Random(7)
    texts = ["".join(rng.choice("ab é\n.") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", "ab" * 500]
    for pattern in ("ab+", "a|b", r"(?<!a)b", "é."):
        got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", matches.places(F.col("t"), pattern).alias("p")).collect()
        for r in got:
            assert [(m.start, m.end, m.match) for m in r.p] == [(m.start(), m.end(), m.group()) for m in re.finditer(pattern, texts[r.i] or "")], (pattern, texts[r.i])


def test_score_cells_need_a_labelled_column_and_a_test(spark):
    html = "<table><caption>PTE scores</caption><tr><th>Level<th>Overall band score<th>Each component<th>Fee<tr><td>Master<td>65<td>58<td>70<tr><td>Bachelor<td>9<td>91<td>1</table><table><tr><td>IELTS<td>7.0</table>"
    got = extract.score_cells(documents.cells(read(spark, html))).collect()
    assert [(r.table_index, r.row_index, r.test, r.kind, r.value) for r in sorted(got)] == [(0, 0, "PTE", "OVERALL", 65.0), (0, 0, "PTE", "COMPONENT", 58.0)]
