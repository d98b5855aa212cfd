"""A pipeline over documents: language identification, near duplicates, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last give the columns of documents.

1. language: documents whose language cannot be told (null text, no letter, or a score under MIN_SCORE) go;
   lang becomes the prediction. Fitted on this stage's own labelled documents.
2. near duplicates: of each group linked by n-gram Jaccard similarity over five-word shingles of at least
   0.8, the document with the smallest id stays; documents without words are groups of their own.
3. personal data: spans are replaced by their kind.
4. mixing: small sources are repeated up to MAX_REPEATS times; none loses a document.
5. token ids of the SentencePiece vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvane.llm import jaccard_join, langid, mixing, pii, piece_codec
from kelvane.llm.common import staged
from kelvane.llm.queries import vocabulary

MIN_SCORE, MAX_REPEATS = 0.5, 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.relabel(docs, langid.fit(docs)).where(F.col("__score") >= MIN_SCORE).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_of_each(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    per, _ = mixing.plan(docs, max_repeats=MAX_REPEATS)
    return mixing.realise(docs, per).drop("__epoch", "__block", "__block_key")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_codec.encode(docs, vocabulary())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixture), ("token_ids", token_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
