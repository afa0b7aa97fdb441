"""Which sources may support published facts, and which facts are supported, kept up to date from changes.

A source earns its class through a mapping that is active, vouches for the source's own address and derives the same class, on a
domain that is trusted and active. Ranking facts need a source authorised for rankings, which supports nothing else. A fact is supported while
any piece of evidence rests on an earned source; a withdrawal anywhere undoes only what no other row supports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.operators.deltas import Buckets, consolidated, count_change, join_change, turned

# Classes that may support facts, states of a domain that are trusted, the class for rankings.
EVIDENCE_CLASSES = ("OFFICIAL", "AUTHORIZED_RANKING", "AUTHORIZED_EXTERNAL", "GOVERNMENT")
TRUSTED = ("VERIFIED_OFFICIAL", "AUTHORIZED_EXTERNAL")
RANKING = "AUTHORIZED_RANKING"

#: Base tables with the columns that a row must have.
BASE = {
    "sources": ["source_id", "url_hash", "eligibility"], "mappings": ["source_id", "url_hash", "eligibility", "domain", "is_active"], "domains": ["domain", "status", "domain_active"], "evidence": ["fact_id", "source_id", "is_ranking"],
}


def _live_mappings(m: DataFrame) -> DataFrame:
    return m.filter(F.col("is_active") & F.col("eligibility").isin(*EVIDENCE_CLASSES)).drop("is_active")


def _live_domains(d: DataFrame) -> DataFrame:
    return d.filter(F.col("domain_active") & F.col("status").isin(*TRUSTED)).drop("status", "domain_active")


def _fits(eligibility: Column, is_ranking: Column) -> Column:
    return (eligibility == RANKING) == is_ranking


def earned(sources: DataFrame, mappings: DataFrame, domains: DataFrame) -> DataFrame:
    """Sources that earn their class, computed anew: source_id, eligibility, n (mappings that vouch for it)."""
    v = _live_mappings(mappings).join(_live_domains(domains), "domain").join(sources, ["source_id", "url_hash", "eligibility"])
    return v.groupBy("source_id", "eligibility").agg(F.count("*").alias("n"))


def supported(evidence: DataFrame, earned_sources: DataFrame) -> DataFrame:
    """Facts with support, computed anew: fact_id, n (pieces of evidence that count)."""
    e = evidence.join(earned_sources.select("source_id", "eligibility").distinct(), "source_id").filter(_fits(F.col("eligibility"), F.col("is_ranking")))
    return e.groupBy("fact_id").agg(F.count("*").alias("n"))


class Eligibility:
    """The base tables, the join of live mappings and domains, and both views, in buckets under a path."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, DataFrame], buckets: int = 64):
        """Start from ``tables`` (those of ``BASE``). Sources are laid down by what mappings name, mappings also by domain, evidence by source."""
        b = self.store = Buckets(spark, path, buckets)
        t = {name: rows.select(*BASE[name]) for name, rows in tables.items()}
        live = _live_mappings(t["mappings"])
        b.create("sources", t["sources"], ["source_id", "url_hash", "eligibility"])
        b.create("live_mappings", live, ["domain"])
        b.create("live_domains", _live_domains(t["domains"]), ["domain"])
        b.create("vouchers", live.join(_live_domains(t["domains"]), "domain").select("source_id", "url_hash", "eligibility"), ["source_id", "url_hash", "eligibility"])
        b.create("evidence", t["evidence"], ["source_id"])
        b.create("earned", earned(t["sources"], t["mappings"], t["domains"]), ["source_id"])
        b.create("supported", supported(t["evidence"], b.table("earned")), ["fact_id"])

    def apply(self, changes: dict[str, DataFrame]) -> dict[str, int]:
        """Apply ``changes`` of base tables (their columns and ``w``); the number of buckets rewritten of each table."""
        b, spark = self.store, self.store.spark
        none = lambda name: spark.createDataFrame([], T.StructType([*b.schemas[name].fields, T.StructField("w", T.LongType())]))
        given = lambda name, stored, keep: b.kept(consolidated(keep(changes[name].select(*BASE[name], "w")))) if name in changes else none(stored)
        dm, dd = given("mappings", "live_mappings", _live_mappings), given("domains", "live_domains", _live_domains)
        ds, de = given("sources", "sources", lambda x: x), given("evidence", "evidence", lambda x: x)
        voucher = ["source_id", "url_hash", "eligibility"]
        dv, vouched = none("vouchers"), None
        if "mappings" in changes or "domains" in changes:
            dv = b.kept(consolidated(join_change(b.at("live_mappings", dd), b.at("live_domains", dm), dm, dd, ["domain"]).select(*voucher, "w")))
        if changes.keys() & {"mappings", "domains", "sources"}:
            vouched = b.kept(join_change(b.at("vouchers", ds), b.at("sources", dv), dv, ds, voucher))
        earn, di = None, none("earned").select("source_id", "eligibility", "w")
        if vouched is not None:
            earn = b.kept(count_change(b.at("earned", vouched), vouched, ["source_id", "eligibility"]))
            di = b.kept(turned(earn, ["source_id", "eligibility"]))
        # who was an earned source before, for the changed evidence
        was = b.at("earned", de).join(de.select("source_id").distinct(), "source_id", "left_semi").select("source_id", "eligibility")
        pieces = join_change(b.at("evidence", di), was, de, di, ["source_id"]).filter(_fits(F.col("eligibility"), F.col("is_ranking")))
        support = b.kept(pieces.select("fact_id", "w"))
        facts = b.kept(count_change(b.at("supported", support), support, ["fact_id"]))
        out = {"supported": b.set_counts("supported", facts), "earned": 0 if earn is None else b.set_counts("earned", earn)}
        return out | {name: b.apply(name, d) for name, d in (("sources", ds), ("live_mappings", dm), ("live_domains", dd), ("vouchers", dv), ("evidence", de))}
