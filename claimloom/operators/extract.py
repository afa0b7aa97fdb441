"""Claims found by rules in what pages state: fees, English scores, deadlines, calendar dates, programmes.

Statements have the columns of :func:`claimloom.operators.documents.statements`: a text with the heading over it and, in a table, the labels of
its cell. Rules are column expressions over words; scores in sentences need the distance between names and numbers and use a
small function a text, which gets nothing but the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.matches import all_kinds, first_kind, let, nearest_kind, words_pattern

# Signs and codes of currencies.
SIGNS = [("£", "GBP"), ("HK$", "HKD"), ("US$", "USD"), ("A$", "AUD"), ("C$", "CAD"), ("S$", "SGD"), ("MOP$", "MOP"), ("NT$", "TWD"), ("RMB", "CNY"), ("¥", "CNY"), ("€", "EUR"), ("$", "USD")]
CODES = "GBP|USD|EUR|HKD|AUD|CAD|SGD|CNY|RMB|MOP|TWD|NZD|JPY|CHF"

#: What is charged for, who pays, and how applications stand, each with words that say so; of several the first counts.
UNITS = {
    "PER_SEMESTER": ["a semester", "per semester", "each semester", "per term", "every term", "termly"],
    "PER_CREDIT": ["a credit", "per credit", "per credit point", "for every credit"],
    "PER_MODULE": ["a module", "per module", "for every module"],
    "TOTAL_PROGRAM": ["altogether", "in total", "for the complete programme", "for the complete course", "all years together"],
    "PER_YEAR": ["a year", "annual", "annually", "every year", "per annum", "per year", "yearly"],
}
STUDENTS = {
    "INTERNATIONAL": ["international"], "OVERSEAS": ["overseas", "abroad"], "HOME": ["home students", "home fee", "home status", "home and", "home"], "DOMESTIC": ["domestic"],
    "EU": ["EU", "European Union"], "NON_LOCAL": ["non-local", "non local", "nonlocal"], "LOCAL": ["local"],
}
#: Words that speak of money asked, of amounts that can't be told, and of days by which to apply.
FEE_WORDS = ["fee", "fees", "tuition", "price", "prices", "to be paid", "payable"]
OPEN_AMOUNT = ["varies", "vary", "depends on", "depend on", "is set individually", "on request"]
DEADLINE_WORDS = ["apply by", "apply before", "closing date", "closing dates", "deadline", "deadlines", "last day to apply", "must reach us by"]
APPLICATIONS = {
    "CLOSED": ["applications are closed", "applications closed", "applications have closed", "applications are no longer taken", "intake is closed"],
    "UNTIL_FILLED": ["as long as places are left", "until all places are filled", "until places are filled", "until we are full"],
    "NO_FIXED": ["apply at any time", "there is no deadline", "without a deadline", "no fixed deadline"],
    "ROLLING": ["rolling"],
}
#: Words right before an amount that make it a bound.
AT_MOST = ["at most", "capped at", "not more than", "up to"]
AT_LEAST = ["at least", "from", "starting at", "starts at"]

#: What money is for; of wordings at the same place the first kind counts.
MONEY = {
    "MEAL_PLAN": ["board", "catering", "dining", "food", "meal plan", "meals"],
    "HOUSING": ["accommodation", "dormitory", "hall of residence", "housing", "lodging", "rent", "room"],
    "ESTIMATED_TOTAL_COST": ["all costs", "cost of attendance", "estimated cost", "student budget", "sum of all costs", "total budget", "total cost", "total costs"],
    "TUITION_FEE": ["course fee", "course fees", "programme fee", "programme fees", "teaching fee", "tuition"],
    "OTHER_MANDATORY_FEE": ["administration fee", "application fee", "compulsory", "enrolment fee", "health insurance", "mandatory", "registration fee", "student services"],
    "COST_OF_ATTENDANCE_COMPONENT": ["books", "daily life", "insurance", "living costs", "living expenses", "personal expenses", "supplies", "travel", "transport"],
}

# Tests of English with the ends of their scales and the least overall score that is a requirement.
TESTS = {"IELTS": (0, 9, 4), "TOEFL": (0, 120, 30), "PTE": (10, 90, 30), "DUOLINGO": (10, 160, 50), "CAE": (80, 230, 140), "CPE": (80, 230, 140)}
TEST_NAMES = {"IELTS": r"\bIELTS\b", "TOEFL": r"\bTOEFL\b", "PTE": r"\bPTE\b", "DUOLINGO": r"\bDuolingo\b", "CAE": r"\bC1\s+Advanced\b|\bCAE\b", "CPE": r"\bC2\s+Proficiency\b|\bCPE\b"}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# Awards that a programme's name states, the first that fits gives the level.
AWARDS = [("DOCTORATE", r"\b(PhD|DPhil|Doctor of)\b"), ("MASTER", r"\b(MSc|MA|MBA|MPhil|LLM|MEng|Master of)\b"), ("BACHELOR", r"\b(BSc|BA|BEng|LLB|Bachelor of)\b")]

_SIGN = "|".join(re.escape(s) for s, _ in sorted(SIGNS, key=lambda s: -len(s[0])))
_MONEY = rf"(?<![\d,.])({_SIGN})?\s?(?<![\d,.-])([1-9]\d{{0,2}}(?:,\d{{3}})+(?:\.\d{{2}})?|(?<=(?:{_SIGN})\s?)[1-9]\d{{3,6}}(?:\.\d{{2}})?)(?![\d,]*\d)"
_MONTH = "(?i:" + "|".join(f"{m}|{m[:3]}" if m != "may" else m for m in MONTHS) + ")"
_DATE = rf"(?<![\w/-])(?:\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTH}\b(?:\s+\d{{4}})?|{_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?\b(?!\d)(?:,?\s+\d{{4}})?|{_MONTH}\s+\d{{4}})\b"


def says(text: Column, wordings: list[str]) -> Column:
    """Whether ``text`` holds one of the wordings as whole words; a null doesn't."""
    return F.coalesce(text.rlike(words_pattern(wordings)), F.lit(False))


def _labels(text: str = "text") -> Column:
    """A statement's text behind the labels of its cell; "non local" becomes a compound, so that it isn't taken for "local"."""
    return F.regexp_replace(F.concat_ws(" ", "column_header", "row_label", text), r"(?i)\b(non) (?=local)", "$1-")


def first_award(text: Column) -> Column:
    """Name of the first award that ``text`` states, or null."""
    return F.coalesce(*[F.when(text.rlike(p), name) for name, p in AWARDS])


def fees(statements: DataFrame) -> DataFrame:
    """One row per statement of a fee: amounts, their shape, currency, unit, students, what the money is for, band, and what is open.

    An amount needs a sign or a comma between thousands, and stands alone. Two amounts that are joined
    are a range if they rise and ambiguous if not; both are kept. A sum that is said to vary has no amount.
    ``student_categories`` are all groups of students that text or labels name, ``students`` the first of them. A cell without words is understood by its labels.
    """
    number = lambda c: F.regexp_replace(c, ",", "").cast("double")
    pair = rf"({_MONEY})\s*(?:-|–|—|\bto\b|\band\b)\s*({_MONEY})"
    t, said, h = F.col("text"), F.col("said"), F.coalesce("heading", F.lit(""))
    some = statements.filter(t.rlike(r"\d") | says(t, OPEN_AMOUNT))  # the others state no amount
    b = some.withColumn("said", _labels()).withColumns({
        "raw": F.regexp_extract(t, _MONEY, 0), "first": F.regexp_extract(t, _MONEY, 2), "left": F.regexp_extract(t, pair, 3), "right": F.regexp_extract(t, pair, 6),
    })
    before = F.split_part(t, F.col("raw"), F.lit(1))
    ends_in = lambda wordings: before.rlike(words_pattern(wordings)[:-len(r"(?!\p{L})")] + r"\s*\S{0,4}\s*$")
    two = F.col("right") != ""
    shape = (
        F.when(F.col("first") == "", "VARIABLE").when(two & (number(F.col("left")) < number(F.col("right"))), "RANGE").when(two, "AMBIGUOUS")
        .when(ends_in(AT_MOST), "UP_TO").when(ends_in(AT_LEAST), "FROM").otherwise("EXACT")
    )
    code = F.upper(F.regexp_extract(said, rf"(?i)\b({CODES})\b", 1))
    sign = F.coalesce(*[F.when(t.contains(s), iso) for s, iso in SIGNS])
    currency = F.when(code == "RMB", "CNY").when(code != "", code).otherwise(sign)
    b = b.withColumns({"shape": shape, "currency": currency, "unit": first_kind(said, UNITS), "student_categories": all_kinds(said, STUDENTS), "fee_said": says(said, FEE_WORDS), "fee_headed": says(h, FEE_WORDS)})
    b = b.filter((F.col("fee_said") | F.col("fee_headed")) & ((F.col("first") != "") | (says(t, OPEN_AMOUNT) & F.col("fee_said"))))
    s, low, high = F.col("shape"), number(F.when(two, F.col("left")).otherwise(F.col("first"))), number(F.when(two, F.col("right")).otherwise(F.col("first")))
    students = F.get("student_categories", F.lit(0))
    return b.select(
        "page_id", "place", "shape", F.when(~s.isin("VARIABLE", "UP_TO"), low).alias("amount_min"), F.when(~s.isin("VARIABLE", "FROM"), high).alias("amount_max"), "currency", "unit", students.alias("students"), "student_categories",
        money_kind(F.col("column_header"), F.col("row_label"), t, F.col("raw"), F.array(h)).alias("money_kind"),
        F.when((F.col("kind") == "td") & (s != "AMBIGUOUS"), "HIGH").when(F.col("fee_said") & F.col("fee_headed"), "MEDIUM").otherwise("LOW").alias("band"),
        F.array_compact(F.array(
            F.when(s == "AMBIGUOUS", "AMOUNT_SHAPE_AMBIGUOUS"), F.when(F.col("currency").isNull(), "CURRENCY_ABSENT"),
            F.when(F.col("unit").isNull(), "BILLING_UNIT_UNRESOLVED"), F.when(students.isNull(), "STUDENT_CATEGORY_UNRESOLVED"),
        )).alias("unresolved"),
    )


def money_kind(column_header: Column, row_label: Column, text: Column, amount: Column, headings: Column) -> Column:
    """What an amount is for: what its column says, else its row, else the wording nearest to it in ``text``, else the innermost of ``headings`` (outermost first) that says it; else UNKNOWN_FINANCIAL_AMOUNT.

    An amount that isn't in the text stands at its beginning.
    """
    at = F.greatest(F.position(F.trim(amount), text) - 1, F.lit(0))
    inner = F.transform(F.reverse(headings), lambda h: first_kind(h, MONEY))
    named = F.coalesce(first_kind(column_header, MONEY), first_kind(row_label, MONEY), nearest_kind(text, at, MONEY)["kind"], F.get(F.array_compact(inner), F.lit(0)))
    return F.coalesce(named, F.lit("UNKNOWN_FINANCIAL_AMOUNT"))


_NUMBER = re.compile(r"(?<![\w.,-])\d{1,3}(?:\.\d{1,2})?(?![\w-]|[.,]\d)")
_NAMES = [(code, re.compile(p, re.I)) for code, p in TEST_NAMES.items()]
_PARTS = re.compile(r"[,;/\d]|\b(?:or|and|either|alternatively)\b", re.I)
_SKILL = re.compile(r"\b(reading|writing|listening|speaking)\b\s*[:–—-]?\s*$", re.I)
_FLOOR_BEFORE = re.compile(r"\b(?:no|not)\s+(?:\w+[ -]){0,2}?(?:below|less\s+than|lower\s+than|under)\s*$", re.I)
_EACH_AFTER = re.compile(r"^\s*(?:in|for)\s+(?:each|every|all|any)\b", re.I)
_ABOVE_BEFORE = re.compile(r"\b(?:above|over|greater\s+than)\s*$", re.I)
NEAR, FAR = 24, 80


def scores_in(text: str) -> list[tuple[str, str, str | None, str, float, bool]]:
    """(test, kind, skill, operator, value, bound) of a text's scores; a number without a test near it is none.

    A number belongs to the test that is bound to it (``NEAR`` characters at most, nothing that parts a
    list between them; a name after it wins a tie), else to the nearest within ``FAR``. The first
    plain number of a test is its overall score.
    """
    names = [(m.start(), m.end(), code) for code, p in _NAMES for m in p.finditer(text)]
    inside, out, overall = [(a, z) for a, z, _ in names], [], set()
    for m in _NUMBER.finditer(text) if names else ():
        if any(a <= m.start() < z for a, z in inside):
            continue
        near = []
        for a, z, code in names:
            gap = text[m.end() : a] if a >= m.end() else text[z : m.start()]
            near.append((len(gap) > NEAR or bool(_PARTS.search(gap)), len(gap), a < m.start(), code))
        loose, far, _, test = min(near)
        value, (least, most, floor) = float(m.group()), TESTS[test]
        if far > FAR or not least <= value <= most:
            continue
        before, after = text[: m.start()], text[m.end() :]
        skill = _SKILL.search(before)
        if skill:
            kind = "COMPONENT"
        elif _FLOOR_BEFORE.search(before) or _EACH_AFTER.search(after):
            kind = "COMPONENT_MINIMUM"
        elif test not in overall and value >= floor:
            kind = "OVERALL"
            overall.add(test)
        else:
            continue
        out.append((test, kind, skill.group(1).lower() if skill else None, "ABOVE" if _ABOVE_BEFORE.search(before) else "AT_LEAST", value, not loose))
    return out


_SCORE = "struct<test:string,kind:string,skill:string,operator:string,value:double,bound:boolean>"


def _scores(text: Column) -> Column:
    @F.arrow_udf(f"array<{_SCORE}>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("test", "kind", "skill", "operator", "value", "bound")
        kind = pa.list_(pa.struct([pa.field(n, t) for n, t in zip(names, (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_()), strict=True)]))
        for t in texts:
            yield pa.array([[dict(zip(names, s, strict=True)) for s in scores_in(x or "")] for x in t.to_pylist()], kind)

    return run(text)


def english_scores(statements: DataFrame) -> DataFrame:
    """One row per score of a test of English that a sentence states: page_id, place, test, kind, skill, operator, value, band. Cells are read by :func:`score_cells`."""
    names = "|".join(TEST_NAMES.values())
    some = statements.filter((F.col("kind") != "td") & F.col("text").rlike(f"(?i){names}"))
    s = some.select("page_id", "place", "heading", "text", F.explode(_scores(F.col("text"))).alias("s")).select("page_id", "place", "heading", "text", "s.*")
    sure = (F.col("kind") == "OVERALL") & F.lower("text").contains("overall") & F.coalesce(F.col("heading"), F.lit("")).rlike("(?i)english|language|proficiency|ielts|toefl")
    return s.select("page_id", "place", "test", "kind", "skill", "operator", "value", F.when(F.col("bound") & sure, "HIGH").when(F.col("bound"), "MEDIUM").otherwise("LOW").alias("band"))


#: Words of a score column's header; a header of both kinds is one of overall scores.
OVERALL_WORDS = ["composite", "minimum score", "overall", "required score", "score", "total"]
PART_WORDS = ["band", "bands", "component", "components", "each", "listening", "reading", "section", "sections", "skill", "skills", "speaking", "subscore", "writing"]


def score_cells(cells: DataFrame) -> DataFrame:
    """One row per score in a table whose header labels the column and whose row, or else caption, names a test: page_id, table_index, row_index, column_index, test, kind, skill, value.

    ``cells``: of :func:`claimloom.operators.documents.cells`. The cell is a number alone and lies on the test's scale; an overall score also
    reaches the least that is a requirement. A column whose header speaks of parts but not of the overall score has component scores, with the skill that header or row name.
    """
    head, number = F.col("column_header"), r"^(\d{1,3}(?:\.\d{1,2})?)$"
    named = lambda c: F.coalesce(*[F.when(c.rlike(f"(?i){p}"), code) for code, p in TEST_NAMES.items()])
    ends = F.create_map(*[x for code, e in TESTS.items() for x in (F.lit(code), F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("least", "most", "floor"), e, strict=True)]))])
    skill = let(F.lower(F.regexp_extract(F.concat_ws(" ", head, "row_label"), r"(?i)\b(reading|writing|listening|speaking)\b", 1)), lambda s: F.when(s != "", s))

    def scored(x: Column, component: Column) -> Column:
        scale = ends[x["test"]]
        kept = x["value"].between(scale["least"], scale["most"]) & (component | (x["value"] >= scale["floor"]))
        return F.when(kept, F.struct(x["test"].alias("test"), F.when(component, "COMPONENT").otherwise("OVERALL").alias("kind"), F.when(component, skill).alias("skill"), x["value"].alias("value")))

    # every search once a cell: a filter on what is found would repeat them
    whole = says(head, ["composite", "overall", "total"])
    about = lambda x: F.when(x["part"] | says(head, OVERALL_WORDS), let(x["part"] & ~whole, lambda component: scored(x, component)))
    value = F.regexp_extract(F.trim("text"), number, 1).try_cast("double")
    test = F.coalesce(named(F.col("row_text")), named(F.col("caption")))
    found = let(test, lambda t: F.when(t.isNotNull(), let(F.struct(t.alias("test"), value.alias("value"), says(head, PART_WORDS).alias("part")), about)))
    c = cells.filter("origin and column_header is not null").filter(F.trim("text").rlike(number))
    return c.select("page_id", "table_index", "row_index", "column_index", F.inline(F.array_compact(F.array(found))))


def date_parts(found: Column) -> dict[str, Column]:
    """``year``, ``month`` and ``day`` of a written date; null where it doesn't state them or no calendar has them."""
    name = F.lower(F.substring(F.regexp_extract(found, "[A-Za-z]{3,}", 0), 1, 3))
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), name).cast("int")
    year = F.regexp_extract(found, r"(\d{4})", 1).try_cast("int")
    day = F.regexp_extract(found, r"(?<!\d)(\d{1,2})(?!\d)", 1).try_cast("int")
    longest = F.element_at(F.array(*[F.lit(n) for n in (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]), F.greatest(month, F.lit(1)))
    return {"year": year, "month": month, "day": F.when(day.between(1, longest), day)}


def calendar_dates(statements: DataFrame) -> DataFrame:
    """Every date written in the body: page_id, place, nth (in the statement, from 0), date_text, year, month, day."""
    b = statements.select("page_id", "place", F.posexplode(F.regexp_extract_all("text", F.lit(_DATE), F.lit(0))).alias("nth", "date_text"))
    return b.withColumns(date_parts(F.col("date_text")))


def deadlines(statements: DataFrame) -> DataFrame:
    """One row per statement about closing dates: how it says applications stand, else DATE with the first date it writes."""
    t = F.col("text")
    about = says(_labels(), DEADLINE_WORDS) | says(F.col("heading"), DEADLINE_WORDS)
    state = F.coalesce(first_kind(t, APPLICATIONS), F.when(t.rlike(_DATE) & about, "DATE"))
    b = statements.withColumn("state", state).filter("state is not null")
    b = b.withColumn("date_text", F.when(F.col("state") == "DATE", F.regexp_extract(t, _DATE, 0)))
    return b.withColumns(date_parts(F.col("date_text"))).select("page_id", "place", "state", "date_text", "year", "month", "day")


def programmes(headings: DataFrame) -> DataFrame:
    """Headings that name an award (of at most 200 characters), once per page and name: page_id, name, award level. ``headings``: of :func:`claimloom.operators.documents.headings`."""
    h = headings.filter(F.length("text") <= 200).withColumn("award", first_award(F.col("text"))).filter("award is not null")
    return h.groupBy("page_id", F.lower("text").alias("name")).agg(F.min("place").alias("place"), F.min("award").alias("award"))
