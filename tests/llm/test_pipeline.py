"""The pipeline stage by stage: each works on all its predecessor kept, and decides as a plain version does."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from optionlake.llm import quality  # noqa: E402

from .test_text_operators import plain_components, plain_hits, plain_secrets  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stages_decide_as_plain_versions_do(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    names = docs.columns

    good = stages[0](spark, docs, SF).persist()
    scores = {r.doc_id: r.predicted for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert good.columns == names and {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p}

    single = stages[1](spark, good, SF).persist()
    kept = [i for i, _, c in plain_components(rows_of(good)) if i == c]
    assert single.columns == names and sorted(r.doc_id for r in single.collect()) == sorted(kept)

    clean = stages[2](spark, single, SF).persist()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [r[0] for r in plain_hits(rows_of(single), items) if not r[-1]]
    assert clean.columns == names and sorted(r.doc_id for r in clean.collect()) == sorted(kept)

    harmless = stages[3](spark, clean, SF).persist()
    # Fewer than three owners: what is not a copied example goes with its document.
    kept = [r[0] for r in plain_secrets(rows_of(clean)) if not r[5]]
    assert harmless.columns == names and sorted(r.doc_id for r in harmless.collect()) == sorted(kept)

    tokens = stages[4](spark, harmless, SF)
    assert tokens.where("not exact or size(ids) <> n_tokens").count() == 0 and tokens.count() == len(kept)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in whole.select("doc_id").collect()) == sorted(kept)


def test_an_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


def test_extra_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").withColumns(
        {"words": F.lit(1), "block": F.lit("b"), "d_text": F.lit("d"), "_id": F.lit(2), "_kept": F.lit(3), "_bad": F.lit(4), "_digest": F.lit(5)}
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.where("words = 1 and block = 'b' and d_text = 'd'").count() == kept.count()
