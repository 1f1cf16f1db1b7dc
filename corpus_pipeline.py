"""The corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read
again. A stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.

Defined cases: null texts count as empty; an empty table passes through as one; without labels of both
classes a filter keeps what its prior favours; further columns of ``docs`` are dropped by name, the five
of ``documents`` are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formulary.llm import ngram_join, packing, quality, secrets, toxicity
from formulary.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the multiple-instance model scores below a half stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.learnable())
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores a half or more stay."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.learnable())
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five words, 0.8) the document of least id stays; documents
    without words are no one's duplicates."""
    return ngram_join.survivors(docs.select(*COLUMNS), width=5, num=80, den=100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the secret scan finds becomes ``[SECRET]``."""
    found = secrets.secret_spans(docs.select(*COLUMNS))
    text = F.when(F.size("spans") > 0, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of the packed sequences of 1,024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", one_of_each_group),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
#: Trained models and the packing order are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
