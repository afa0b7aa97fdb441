"""Matches of patterns with their places, and token distances, as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def places(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` in ``text``, in order: array of (start, end, match), characters counted from 0.

    What lies between matches is what splitting leaves, so lengths give the places. An empty match isn't found; a null text has none.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
    return F.coalesce(F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda s: s["out"])), none)


def words_pattern(wordings: list[str]) -> str:
    """A pattern for any of the wordings as whole words, without case and not as a compound's last part; blanks stand for any white space, longer wordings come first."""
    parts = sorted(wordings, key=lambda w: (-len(w), w))
    return r"(?i)(?<!\p{L})(?<!\p{L}-)(?:" + "|".join(r"\s+".join(p.split()) for p in parts) + r")(?!\p{L})"


def kind_patterns(kinds: dict[str, list[str]]) -> list[tuple[str, str]]:
    return [(name, words_pattern(wordings)) for name, wordings in kinds.items()]


def _any(text: Column, kinds: dict[str, list[str]]) -> Column:
    """Whether ``text`` speaks of any kind: one search, so that texts that speak of none need no more."""
    return text.rlike(words_pattern(list(dict.fromkeys(w for wordings in kinds.values() for w in wordings))))


def first_kind(text: Column, kinds: dict[str, list[str]]) -> Column:
    """Name of the first kind, in the order given, that ``text`` speaks of, or null."""
    return F.when(_any(text, kinds), F.coalesce(*[F.when(text.rlike(p), name) for name, p in kind_patterns(kinds)]))


def all_kinds(text: Column, kinds: dict[str, list[str]]) -> Column:
    found = F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in kind_patterns(kinds)]))
    return F.when(_any(text, kinds), found).otherwise(F.array().cast("array<string>"))


def nearest_kind(text: Column, at: Column, kinds: dict[str, list[str]]) -> Column:
    """Struct (distance, rank, kind) of the kind whose wording stands nearest to the character ``at``, of several the first in the order given; null without one."""
    gap = lambda m: F.when((m["start"] <= at) & (at <= m["end"]), 0).otherwise(F.least(F.abs(at - m["start"]), F.abs(at - m["end"])))

    def of(rank: int, name: str, pattern: str) -> Column:
        return F.transform(places(text, pattern), lambda m: F.struct(gap(m).alias("distance"), F.lit(rank).alias("rank"), F.lit(name).alias("kind")))

    return F.when(_any(text, kinds), F.array_min(F.concat(*[of(i, *kind) for i, kind in enumerate(kind_patterns(kinds))])))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is written out, and computed, once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
