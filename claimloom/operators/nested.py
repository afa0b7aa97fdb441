"""Values inside JSON at any depth, walked level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.sources.scratch import scratch

#: Characters of a string that may be a text of the page (fixed value).
LONG = 40


def json_values(rows: DataFrame, id_: str, json: str) -> DataFrame:
    """Every value in the JSON of each row: ``id_``, path, depth, kind (object, array, string, number, boolean, null), text.

    Paths begin with ``$``; names stand in brackets and quotes, places in brackets. ``text`` is what a string, number or boolean reads as, null for the
    rest. A null or malformed JSON has no values (:func:`malformed` tells them). A level is taken apart as a table, so what one task holds is a row; there are as many rounds
    as the deepest value has levels. Of equal names in one object the last counts.
    """
    spark = rows.sparkSession
    level = rows.select(F.col(id_), F.lit("$").alias("path"), F.try_parse_json(F.col(json)).alias("v")).filter("v is not null")
    parts, depth = [], 0
    while True:
        schema = F.schema_of_variant("v")
        kind = (
            F.when(F.is_variant_null("v") | (schema == "VOID"), "null").when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean").otherwise("number")
        )
        held = level.withColumn("kind", kind)
        path = scratch(spark, f"json-{depth}")
        inner = F.col("kind").isin("object", "array")
        held.select(F.col(id_), "path", F.lit(depth).alias("depth"), "kind", F.when(~inner, F.try_variant_get("v", "$", "string")).alias("text"), F.when(inner, F.to_json("v")).alias("rest")).write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path)
        parts.append(stored.drop("rest"))
        open_ = stored.filter("rest is not null")
        if open_.isEmpty():
            break
        v = open_.select(F.col(id_), "path", F.parse_json("rest").alias("v"))
        each = v.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "value"))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("['"), F.replace("key", F.lit("'"), F.lit("\\'")), F.lit("']"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = each.select(F.col(id_), F.concat("path", step).alias("path"), F.col("value").alias("v"))
        depth += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def malformed(rows: DataFrame, id_: str, json: str) -> DataFrame:
    """Ids of rows whose JSON is there and can't be read."""
    return rows.filter(F.col(json).isNotNull() & F.try_parse_json(F.col(json)).isNull()).select(id_)


def embedded_texts(rows: DataFrame, id_: str, json: str, least: int = LONG) -> DataFrame:
    """Per row of whose JSON anything can be read the strings of at least ``least`` characters at any depth: ``id_``, texts (their number), characters."""
    long_ = (F.col("kind") == "string") & (F.length("text") >= least)
    return json_values(rows, id_, json).groupBy(id_).agg(F.count_if(long_).alias("texts"), F.coalesce(F.sum(F.when(long_, F.length("text"))), F.lit(0)).cast("long").alias("characters"))
