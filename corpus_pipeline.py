"""A pipeline over `documents`: STAGES in order, each on all that the one before kept.

Each stage's function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, whatever
these are besides doc_id and text, and an empty result for empty docs. Rows without an id are documents like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, pii, quality_classifier, sentencepiece_codec
from tidemark.llm.shared import settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; null and empty texts get the constant's score, equal texts equal ones. Without labels
    all score 0.5 and stay."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.scored(docs, model).where("quality_predicted = 1").select(*(f"`{c}`" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a Jaccard similarity of 0.8 or more, over five words, stays: the
    least id, and of repeated rows one. Null and empty texts are in no group and stay."""
    return jaccard_join.deduplicated(docs, n=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row (or all of a shorter item) with a benchmark item go; null and empty texts stay, repeated
    rows go or stay together, and without items all stay."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts; n_chars follows. Null texts stay null; every row comes out."""
    done = pii.redacted(docs).select(*(f"`{c}`" for c in docs.columns))
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, how many there are, and whether they decode to the text. A null text counts as empty and doesn't; every row
    comes out."""
    model = sentencepiece_codec.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    done = sentencepiece_codec.encoded(docs, model)
    return done.withColumn("round_trip", F.coalesce(F.col("decoded") == F.col("text"), F.lit(False))).drop("decoded")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("PII", personal_data), ("SentencePiece encoding and decoding", tokens)]

#: A trained classifier and a tokenizer aren't SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
