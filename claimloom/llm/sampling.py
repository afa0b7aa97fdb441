"""Bounded, reproducible samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % folds


def place(id_column: Column) -> Column:
    """A reproducible number in [0, 1) for each id, unrelated to its folds."""
    return (F.xxhash64(F.lit("sample"), id_column).bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int, held_out: int) -> DataFrame:
    """About ``rows`` labelled documents (``rows`` / classes of each class) outside fold ``held_out``.

    Chosen by a digest of the id, so reruns agree. A document that is labelled more than once
    counts with its largest label, an id that stands on several texts with the least of them; null labels and ids
    don't count. Columns: doc_id, label, text.
    """
    l = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    l = l.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in l.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(rows / max(1, len(counts)) / n)).otherwise(share)
    chosen = l.filter(place(F.col("doc_id")) < share)
    # about ``rows`` ids and labels, whatever the input's size, so the texts needn't be shuffled
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
