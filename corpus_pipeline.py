"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns what its predecessor's documents become.

toxicity: documents that the classifier rejects go. ngram_jaccard: one document of each group of near copies stays.
decontamination: documents that hold a benchmark passage go. secrets: secret spans become a mark in the text. byte_bpe: the
last stage returns the token ids of each document beside its columns without the text. Further columns of documents pass through
all stages, whatever their names; nulls, empty texts, repeated rows and empty tables are defined by each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covertile.llm import bpe, decontam, jaccard, secrets, toxicity
from covertile.llm.common import free, held_out, saved

#: No SQL for the trained classifier, so none for the whole; tests run it against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of this stage's documents outside the held-out fold."""
    labels = _table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    return toxicity.reject(docs, model)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 0.8 of their sets of five words."""
    return jaccard.representatives(docs, size=5, num=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # beside a column of the documents that is called so
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, free(docs.columns, "ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_group),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a Parquet table before the next one reads them."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
