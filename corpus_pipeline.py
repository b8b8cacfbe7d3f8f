"""From raw documents to token ids: the text operators in a row, each stage written and read again.

Rows are told apart by doc_id and text, so repeated and missing ids are safe in
every stage. A null text counts as empty; an empty table gives an empty result;
extra columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optionlake.llm import bpe, decontam, jaccard, quality, secrets
from optionlake.llm.common import table, work_folder
from optionlake.session import tune


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from ``labels``, predicts to be good.

    Each row is decided by its own text: repeated rows go or stay together, and
    a score of exactly 0.5 stays.
    """
    return quality.accepted(docs, table(tune(spark), sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the least doc_id, then of the least text digest, one of repeated rows.

    Rows without words are in no group and stay, each of them.
    """
    return jaccard.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, by their own text; items without words have no passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a credential that looks live: one held by fewer owners than a copied example.

    A null source or language is an owner or repository like any other; repeated rows go or stay together.
    """
    return secrets.withhold_live(docs, F.concat_ws("/", "source", "lang"), F.col("source"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with the digest of the text they decode to; a row in, a row out."""
    return bpe.round_trip(docs, bpe.tokenizer_path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", decontaminated),
    ("secret scans", harmless),
    ("BPE encoding and decoding", tokens),
]

#: A learned stage is not expressible in SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    folder = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
