import importlib.util
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def load():
    spec = importlib.util.spec_from_file_location("entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_entry_and_a_few_queries_match_sql(spark):
    entry = load()
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 50
    text = {*entry.TEXT}  # the text operators may be left out
    assert set(queries) - set(oracles) - text == {"expiry_estimates", "estimate_summary"}
    assert entry.entry(spark).count() == 32
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    for name in ("captures_view", "attrition_totals", "freshness_verdicts", "calendar_arbitrage", "manifest_check", "subset_tally", "health_ages", "stream_verdicts", "backfill_resumed"):
        mine = queries[name](spark, SF)
        theirs = con.execute(oracles[name])
        columns = [d[0] for d in theirs.description]
        assert sorted(columns) == sorted(mine.columns)
        rows = sorted(repr(r) for r in theirs.fetchall())
        assert sorted(repr(tuple(r)) for r in mine.select(*columns).collect()) == rows, name
