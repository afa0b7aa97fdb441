"""Whom a statement is about: applicants' places by constructions of words, the qualifications they hold, level and discipline.

A text becomes a string of roles, one letter a word: places, applicants, what says that they come from somewhere, qualifications, negations. A construction is a
pattern over roles, so it is looked for once however many places there are, and where its match lies tells which word is the place and whether a
negation stands right before it. A place alone is no scope: campuses, subjects and addresses name places too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.matches import first_kind, let, places

# The places that are told apart, their codes, and their names and adjectives; capitals count in abbreviations.
PLACES = {"China": "CN", "Hong Kong": "HK", "India": "IN", "Singapore": "SG", "Malaysia": "MY", "United States": "US", "EU": "EU"}
NAMES = {"china": "China", "india": "India", "singapore": "Singapore", "malaysia": "Malaysia", "unitedstates": "United States"}
ADJECTIVES = {"chinese": "China", "indian": "India", "singaporean": "Singapore", "malaysian": "Malaysia", "american": "United States"}
BOTH = {"hongkong": "Hong Kong", "europeanunion": "EU"}
ABBREVIATIONS = {"US": "United States", "USA": "United States", "EU": "EU"}

#: Words of several parts, written as one.
JOINED = [(r"(?i)\bmainland\s+china\b", "China"), (r"(?i)\bhong\s*kong\b", "HongKong"), (r"(?i)\bunited\s+states(?:\s+of\s+america)?\b", "UnitedStates"), (r"(?i)\beuropean\s+union\b", "EuropeanUnion"), (r"(?i)\bother\s+than\b", "otherthan"), (r"(?i)\bapart\s+from\b", "apartfrom"), (r"(?i)\bif\s+you\s+(?:are|were)\b", "ifyouare")]
#: What words do: W applicants, Q what they hold, A what else belongs to a country's people or schools, C a certificate's own words, f from, i in, l being there, o obtained, w who, b be, t the, c "if you are", n not.
ROLES = {
    "W": ["applicant", "applicants", "candidate", "candidates", "student", "students", "learner", "learners", "pupil", "pupils"],
    "Q": ["qualification", "qualifications", "result", "results", "grade", "grades", "degree", "degrees", "award", "awards"],
    "A": ["citizen", "citizens", "national", "nationals", "resident", "residents", "curriculum", "curricula", "passport", "school", "schools"],
    "C": ["certificate", "certificates", "diploma", "diplomas", "matriculation", "baccalaureate"],
    "f": ["from"], "i": ["in"], "l": ["based", "educated", "living", "schooled", "studying"], "o": ["awarded", "completed", "earned", "gained", "issued", "obtained", "taken"],
    "w": ["who"], "b": ["are", "were"], "t": ["the"], "c": ["ifyouare"], "n": ["apartfrom", "except", "excluding", "non", "not", "otherthan", "outside"],
}
_LETTERS = {w: r for r, words in ROLES.items() for w in words} | dict.fromkeys(NAMES, "P") | dict.fromkeys(ADJECTIVES, "D") | dict.fromkeys(BOTH, "B")

#: Constructions as patterns over roles, and whether the place is their first word or their last. "Resident" (A) before "in" is living there too.
_FROM = "(?:f|[lA]i)"
CONSTRUCTIONS = [
    ("DEMONYM", "(?<!n)[DB][WQA]", True), ("APPLICANT_ORIGIN", f"(?<!n)W(?:w?b)?{_FROM}t?[PB]", False), ("QUALIFICATION_ORIGIN", "(?<!n)Qo?[fi]t?[PB]", False), ("CONDITIONAL_ORIGIN", f"(?<!n)c{_FROM}t?[PB]", False),
    ("NATIONAL_QUALIFICATION", "(?<!n)[PB][^n]{0,2}?C", True),
]

#: Qualifications that name themselves, degree levels and disciplines, each with words that say so.
SYSTEMS = {"A-level": ["A level", "A levels", "A-level", "A-levels"], "IB": ["IB Diploma", "International Baccalaureate"], "Gaokao": ["gaokao", "college entrance examination of China"], "AP": ["Advanced Placement"]}
LEVELS = {"DOCTORATE": ["doctoral", "doctorate", "DPhil", "PhD"], "MASTER": ["MA", "master", "masters", "master's", "MBA", "MPhil", "MSc"], "BACHELOR": ["BA", "bachelor", "bachelors", "bachelor's", "BEng", "BSc"]}
DISCIPLINES = {
    "COMPUTER_AND_DATA": ["computer science", "computing", "data science", "informatics", "machine learning", "software"], "ENGINEERING": ["engineer", "engineering"],
    "BUSINESS": ["accounting", "business", "economics", "finance", "management", "marketing"],
}
#: Words that make a statement one of what is asked for.
ASKED = {"REQUIREMENT": ["at least", "entry requirement", "entry requirements", "minimum", "must", "need", "required", "requirement", "requires", "should have"]}


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def words(text: Column) -> Column:
    """The words of a text, those of several parts as one."""
    for pattern, one in JOINED:
        text = F.regexp_replace(text, pattern, one)
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def roles(tokens: Column) -> Column:
    """One letter for each word; a point for those without a role."""
    return F.array_join(F.transform(tokens, lambda w: F.coalesce(_map(dict.fromkeys(ABBREVIATIONS, "B"))[w], _map(_LETTERS)[F.lower(w)], F.lit("."))), "")


def jurisdictions(text: Column) -> Column:
    """Places whose applicants or qualifications a text speaks of: array of (place, code, construction, word), ordered; ``word`` is the place's number among the words, from 0.

    A construction with a negation right before it gives nothing: what is not meant doesn't tell what is. A null text gives an empty array.
    """
    label = lambda w: F.coalesce(_map(ABBREVIATIONS)[w], _map(NAMES | ADJECTIVES | BOTH)[F.lower(w)])

    def of(tokens: Column, r: Column, name: str, pattern: str, first: bool) -> Column:
        def found(m: Column) -> Column:
            at = m["start"] if first else m["end"] - 1
            place = label(F.get(tokens, at))
            return F.struct(place.alias("place"), _map(PLACES)[place].alias("code"), F.lit(name).alias("construction"), at.alias("word"))

        return F.transform(places(r, pattern), found)

    every = lambda tokens: let(roles(tokens), lambda r: F.array_sort(F.concat(*[of(tokens, r, *c) for c in CONSTRUCTIONS])))
    none = F.array().cast("array<struct<place:string,code:string,construction:string,word:int>>")
    return F.coalesce(let(words(F.coalesce(text, F.lit(""))), every), none)


def admission_requirements(statements: DataFrame) -> DataFrame:
    """Statements of what is asked of applicants, with whom they are about: page_id, place, jurisdictions, systems, level, discipline, scope.

    A statement counts if it asks for something and names a qualification, a level or an applicant's place; levels and disciplines are read from it, else from the heading over it.
    ``scope``: JURISDICTION if it names places, QUALIFICATION_SYSTEM if it only names systems, else UNSTATED.
    """
    t, h = F.col("text"), F.col("heading")
    systems = F.array_compact(F.array(*[F.when(first_kind(t, {k: v}).isNotNull(), k) for k, v in SYSTEMS.items()]))
    s = statements.withColumns({"jurisdictions": jurisdictions(t), "systems": systems, "own_level": first_kind(t, LEVELS), "level": F.coalesce(first_kind(t, LEVELS), first_kind(h, LEVELS)), "discipline": F.coalesce(first_kind(t, DISCIPLINES), first_kind(h, DISCIPLINES))})
    s = s.filter(first_kind(t, ASKED).isNotNull() & ((F.size("jurisdictions") > 0) | (F.size("systems") > 0) | F.col("own_level").isNotNull()))
    scope = F.when(F.size("jurisdictions") > 0, "JURISDICTION").when(F.size("systems") > 0, "QUALIFICATION_SYSTEM").otherwise("UNSTATED")
    return s.select("page_id", "place", "jurisdictions", "systems", "level", "discipline", scope.alias("scope"))
