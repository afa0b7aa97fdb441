"""Web pages to hosts and technical classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions.urls import authority, host, registrable, title

def page_hosts(pages: DataFrame) -> DataFrame:
    h = host(F.col("url"))
    return pages.select("page_id", h.alias("host"), authority(F.col("url")).alias("authority"), registrable(h).alias("domain"))


def pages_per_domain(pages: DataFrame) -> DataFrame:
    return page_hosts(pages).groupBy("domain").agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts")).orderBy(F.desc("pages"), "domain")


def page_shape(pages: DataFrame) -> DataFrame:
    """Title, body digest and counts of shapes in the markup, and a technical class."""
    html = F.coalesce("html", F.lit(""))
    visible = F.length(F.trim(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", "")))
    n = lambda p: F.regexp_count(html, F.lit(p)).cast("long")
    return pages.select(
        "page_id", title(html).alias("title"), F.sha2(html, 256).alias("body_sha256"), n("<a ").alias("links"), n("<p>").alias("paragraphs"),
        n("<script").alias("scripts"), F.when(visible >= 400, "STATIC_HTML").when(n("<script") > 0, "POSSIBLE_BROWSER").otherwise("THIN").alias("technical_class"),
    )
