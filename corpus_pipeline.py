"""A corpus pipeline of five stages over ``documents``: toxicity, near-duplicates, secrets, mixture, packing.

Each stage gets the rows that its predecessor kept, written as Parquet and read again. The first four return the columns of
documents; the last one the packing plan. Clean documents pass all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import mixing, neardup, packing, secrets, toxicity
from docmill.llm.common import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, calls toxic (score of 0.5 and more) go.

    Null and empty texts get the model's bias, like any text without known n-grams; repeated rows go or stay together; documents
    without a label are judged like the others; without labels of both kinds all get one score. Nothing gives nothing.
    """
    model = toxicity.fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out="__toxic").where("__toxic < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8) stays: that with the smallest id.

    Texts without words and rows with a null id all stay; of rows that repeat an id one stays. Nothing gives nothing.
    """
    return neardup.drop_copies(docs, neardup.near_duplicates(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts by a mark, and n_chars follows; every document stays, null texts stay null."""
    forest = secrets.train_forest(secrets.labelled_findings(spark))
    out = secrets.redact(secrets.find_secrets(_beside_row(docs, "text", "source"), forest))
    row = F.col("__row").withField("text", F.col("text")).withField("n_chars", F.length("text").cast("bigint"))
    return out.select(row.alias("__row")).select("__row.*")


def _beside_row(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and, as one struct, the whole row: no column that an operator adds can meet one of the same name."""
    return docs.select(*columns, F.struct(*docs.columns).alias("__row"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: the files that are written hold its slots one after another.

    A null source is a source of its own; null texts have size 1; rows that repeat an id are rows of their own.
    """
    rows = _beside_row(docs, "doc_id", "source").withColumn("size", F.length(F.coalesce("__row.text", F.lit(""))) + 1)
    return mixing.mix(rows, size=F.col("size")).orderBy("round", "slot", "place").select("__row.*")


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan: pieces of documents and their places in bins. Groups of bins are consecutive runs of the mixture's slots;
    the packer gets these by the same call as :func:`mix_sources`, as the columns of documents have no place for them."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates), ("secret_scan", redact_secrets), ("source_mixing", mix_sources), ("best_fit_packing", pack_bins)]

#: The classifier and the packing search are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
