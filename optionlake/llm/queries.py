"""The registered query of each text operator, over whole tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from . import align, bpe, conversations, decontam, fingerprints, jaccard, langid, licenses, pii, quality, repair, secrets, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run):
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(tune(spark), sf_dir)

    tuned.__doc__ = run.__doc__
    QUERIES[run.__name__] = tuned
    return tuned


@query
def op1_quality(spark, sf):
    return quality.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op2_jaccard(spark, sf):
    return jaccard.label(table(spark, sf, "documents"))


@query
def op2_links(spark, sf):
    """The whole join, as the number of links of every document."""
    return jaccard.count_links(table(spark, sf, "documents"))


@query
def op3_pii(spark, sf):
    """The key is a parameter of the run; this one is for comparison only."""
    return pii.pseudonymize(table(spark, sf, "documents"), key="a key for comparison")


@query
def op4_secrets(spark, sf):
    """Owners are the sources, repositories the languages of a source."""
    return secrets.scan(table(spark, sf, "documents"), F.concat_ws("/", "source", "lang"), F.col("source"))


@query
def op5_bpe(spark, sf):
    return bpe.round_trip(table(spark, sf, "documents"), bpe.tokenizer_path("byte_bpe_50k.json"))


@query
def op6_licenses(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


@query
def op7_token_files(spark, sf):
    return repair.listed(repair.write(table(spark, sf, "documents"), bpe.tokenizer_path("word_bpe_49k.json")))


@query
def op8_language(spark, sf):
    return langid.identify(table(spark, sf, "documents"))


@query
def op9_fingerprints(spark, sf):
    return fingerprints.compare(table(spark, sf, "documents"))


@query
def op10_decontamination(spark, sf):
    return decontam.mark(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op10_near_matches(spark, sf):
    return decontam.mark_near(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op11_warc(spark, sf):
    return warc.round_trip(table(spark, sf, "pages"))


@query
def op12_conversation_repair(spark, sf):
    return conversations.repair(table(spark, sf, "conversations"))


@query
def op13_alignment(spark, sf):
    return align.compare(table(spark, sf, "documents"), bpe.tokenizer_path("byte_bpe_50k.json"), bpe.tokenizer_path("piece_bpe_32k.model"))
