"""Passages that texts hold word for word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.matches import let

#: Words of a passage by whose hash it is looked up, at most; passages that may be broadcast.
GRAM, BROADCAST_PASSAGES = 5, 200_000


def folded(text: Column) -> Column:
    """A text with single blanks for white space and none at its ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def _grams(words: Column, n: int) -> Column:
    """Hashes of all ``n`` words in a row; ``words`` is looked at often, so it must be a value that is at hand."""
    last = F.size(words) - n + 1
    each = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(*[F.element_at(words, (i + k).cast("int")) for k in range(n)]))
    return F.when(last >= 1, each).otherwise(F.array().cast("array<bigint>"))


def quoted(passages: DataFrame, docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """Per passage of three words or more (item_id, text) that a document (doc_id, text) holds: item_id, documents, first_doc.

    A passage is looked up by the hash of its first words but one, ``gram`` of them or as many as it has without the first and last (those may touch other signs in a document);
    what is found is compared whole. A few words in a row are rarer than any one word, and only hashes that some passage has leave a document's task.
    """
    b = passages.select("item_id", folded(F.col("text")).alias("quote")).filter("quote is not null")
    words = F.split("quote", " ")
    b = b.withColumn("n", F.least(F.lit(gram), F.size(words) - 2)).filter("n >= 1")
    key = F.lit(None).cast("long")
    for n in range(1, gram + 1):
        key = F.when(F.col("n") == n, F.xxhash64(*[F.element_at(words, k + 2) for k in range(n)])).otherwise(key)
    b = b.withColumn("key", key)
    lengths = sorted(r[0] for r in b.select("n").distinct().collect())
    if not lengths:
        return passages.limit(0).select("item_id", F.lit(0).cast("long").alias("documents"), F.lit(0).cast("long").alias("first_doc"))
    few = b.limit(BROADCAST_PASSAGES + 1).count() <= BROADCAST_PASSAGES
    t = docs.select("doc_id", folded(F.col("text")).alias("body"))
    every = let(F.split("body", " "), lambda said: F.array_distinct(F.concat(*[_grams(said, n) for n in lengths])))
    keys = t.select("doc_id", F.explode(every).alias("key"))
    side = b.select("item_id", "quote", "key")
    hits = keys.join(F.broadcast(side) if few else side, "key").select("doc_id", "item_id", "quote").distinct()
    found = hits.join(t, "doc_id").filter(F.contains(F.col("body"), F.col("quote")))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
