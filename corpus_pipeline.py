"""The corpus pipeline: quality, language, near-duplicates, mixing, then BPE, over whole documents.

Each stage takes the rows its predecessor kept and returns the columns of ``documents``; the last returns
the digests of the encoded texts. ``run`` writes every stage's rows to the shared folder and reads
them again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import bpe, langid, mixing, probminhash, quality
from claimloom.llm.queries import table, tokenizer_path
from claimloom.llm.store import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; texts that are null or without a word go. Columns stay as they are, whatever their names."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.scorer(docs, model)(F.col("text"))["predicted"] == 1)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a probability of at least 0.5; texts without a letter (score 0) go. Columns stay as they are."""
    model = langid.fit(docs, tokenizer_path("piece_bpe_32k.model"))
    return docs.filter(langid.recognizer(docs, model)(F.col("text"))["score"] >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: the smallest id, rows without an id last, then by the numbers of the words.

    Every row whose text is unique or without a word stays, with an id or without.
    """
    return probminhash.one_of_each_class(docs, 0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice; those without a word go. Columns stay as they are."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix; repeated rows are each encoded, null texts count as empty."""
    return bpe.encode_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("language id", keep_known_language),
    ("minhash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("bpe", encode),
]

#: Learned models and near-duplicate classes are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
