import gzip
import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from optionlake.operators import gate, health, ordered
from optionlake.plans import collect
from optionlake.sources import archive, payloads
from optionlake.streaming import gate_stream

# Capture instant (UTC), index print (Eastern), spot, seqno, verdict.
TIMELINE = [
    ("2026-08-09T22-38-43Z", "2026-08-07T16:14:59", 7757.6401, 47142571940, "stale_feed"),
    ("2026-08-10T23-57-37Z", "2026-08-10T16:14:59", 7753.1099, 8260038979, "stale_feed"),
    ("2026-08-11T00-07-40Z", "2026-08-10T16:14:59", 7753.1099, 8260038979, "stale_feed"),
    ("2026-08-11T16-11-33Z", "2026-08-11T11:56:26", 7741.3999, 12769171861, "accept"),
    ("2026-08-11T20-37-03Z", "2026-08-11T16:14:59", 7728.2002, 16938026517, "accept"),
    ("2026-08-11T20-47-05Z", "2026-08-11T16:14:59", 7728.2002, 16938026517, "duplicate_print"),
    ("2026-08-11T20-57-15Z", "2026-08-11T16:14:59", 7728.2002, 16947306680, "duplicate_print"),
    ("2026-08-11T21-07-17Z", "2026-08-11T16:14:59", 7728.2002, 16947306680, "duplicate_print"),
    ("2026-08-11T23-57-57Z", "2026-08-11T16:14:59", 7728.2002, 16947306680, "duplicate_print"),
]


def instant(stamp):
    return datetime.strptime(stamp, "%Y-%m-%dT%H-%M-%SZ").replace(tzinfo=UTC)


def body(print_time="2026-08-11T16:14:59", spot=7728.2, seqno=16938026517, options=(), **top):
    data = {"symbol": "^SPX", "current_price": spot, "last_trade_time": print_time, "seqno": seqno, "iv30": 12.5, "options": list(options)}
    return {"timestamp": "2026-08-11 20:36:41", "symbol": "_SPX", "data": data, **top}


def timeline_bodies(spark):
    rows = [("_SPX", instant(t), json.dumps(body(p, s, q))) for t, p, s, q, _ in TIMELINE]
    return spark.createDataFrame(rows, "ticker string, capture_utc timestamp, body string")


def test_timeline_verdicts_and_details(spark):
    got = collect.screen(timeline_bodies(spark)).orderBy("capture_utc").collect()
    assert [r.verdict for r in got] == [v for *_, v in TIMELINE]
    assert [round(r.age_minutes, 2) for r in got[:3]] == [3023.73, 222.63, 232.68]
    assert got[4].detail == "new data: index last printed 2026-08-11T16:14:59 ET (22.1 min ago), spot 7728.2002, 0 options"
    assert "advanced from 16938026517" in got[6].detail and "advanced" not in got[5].detail
    assert "over the 27 min limit" in got[0].detail


def test_stream_agrees_with_batch(spark, tmp_path):
    land = tmp_path / "landing" / "ticker=_SPX"
    land.mkdir(parents=True)
    out, state = str(tmp_path / "out"), str(tmp_path / "ck")
    for part in (TIMELINE[:5], TIMELINE[5:]):
        for t, p, s, q, _ in part:
            (land / f"{t}.json").write_text(json.dumps(body(p, s, q)))
        gate_stream.start(gate_stream.landed(spark, str(tmp_path / "landing")), out, state).awaitTermination()
    got = spark.read.parquet(out).orderBy("capture_utc").collect()
    assert [r.verdict for r in got] == [v for *_, v in TIMELINE]


def test_archive_sink_and_stream_agree_with_the_batch(spark, tmp_path):
    """Captures archived by the sink, streamed under their own names over two starts and a repeated batch."""
    raw, out, state = (str(tmp_path / n) for n in ("raw", "out", "state"))
    rows, rng = [], random.Random(8)
    for i in range(40):
        at, ticker = instant(TIMELINE[3][0]) + timedelta(minutes=5 * i), rng.choice(["_SPX", "SPY"])
        printed = (at - timedelta(hours=4, minutes=rng.choice([0, 10, 50]))).replace(minute=at.minute // 15 * 15)
        text = json.dumps(body(f"{printed:%Y-%m-%dT%H:%M:%S}", 7000.0 + i, 100 + i // 2)) if i % 9 else json.dumps({"data": None})
        rows.append((ticker, at, text))
    frame = spark.createDataFrame(rows, "ticker string, capture_utc timestamp, body string")
    for part in (frame.where(F.minute("capture_utc") < 30), frame.where(F.minute("capture_utc") >= 30)):
        archive.write(part, raw)
    want = {(r.ticker, r.capture_utc): r for r in collect.screen(frame).collect()}
    assert archive.scan(spark, raw).count() == 40

    later = tmp_path / "later"
    later.mkdir()
    for f in sorted((tmp_path / "raw").glob("*.gz"), key=lambda f: archive.capture_key(f.name))[25:]:
        f.rename(later / f.name)
    gate_stream.start(gate_stream.archived(spark, raw), out, state).awaitTermination()
    (tmp_path / "raw" / "2026" / "08").mkdir(parents=True)
    for f in later.glob("*.gz"):
        f.rename(tmp_path / "raw" / "2026" / "08" / f.name)
    gate_stream.start(gate_stream.archived(spark, raw), out, state).awaitTermination()
    newest = max((f for f in (tmp_path / "state" / "commits").glob("*") if f.name.isdigit()), key=lambda f: int(f.name))
    newest.unlink()  # as if the query had stopped before its last batch was committed
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    gate_stream.start(gate_stream.archived(spark, raw), out, state).awaitTermination()

    got = spark.read.parquet(out).collect()
    assert len(got) == 40 and {r.verdict for r in got} >= {"accept", "duplicate_print", "stale_feed", None}
    for r in got:
        w = want[r.ticker, r.capture_utc]
        assert (r.verdict, r.detail, r.error, r.last_print) == (w.verdict, w.detail, w.error, w.last_print)


def test_one_ticker_of_a_micro_batch_is_spread_over_tasks(spark, tmp_path):
    """4,000 attempts of one ticker, in two micro-batches: no task judges most of them, and the verdicts are the batch gate's."""
    start, landing, out = instant(TIMELINE[3][0]), str(tmp_path / "landing"), str(tmp_path / "out")
    attempts = spark.range(4000).select(
        F.lit("_SPX").alias("ticker"), F.timestamp_seconds(F.lit(start.timestamp()) + F.col("id") * 300).alias("capture_utc"), F.col("id").alias("seqno"),
        F.timestamp_seconds(F.lit(start.timestamp()) + F.col("id") * 300 - F.col("id") % 7 * 300).alias("index_last_trade"), (F.col("id") % 50 == 0).alias("force"),
    )
    for part in ("seqno < 2500", "seqno >= 2500"):
        attempts.where(part).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 1000).parquet(landing)
        gate_stream.verdicts(stream, out, str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(out)
    shares = {r.f: r["count"] for r in got.groupBy(F.input_file_name().alias("f")).count().collect()}
    assert sum(shares.values()) == 4000 and max(shares.values()) < 1000
    shown = ["seqno", "print", "last_print", "verdict"]
    assert sorted(got.select(*shown).collect(), key=lambda r: r.seqno) == sorted(gate.judge(attempts).select(*shown).collect(), key=lambda r: r.seqno)


def test_archive_sink_writes_all_or_nothing(spark, tmp_path):
    raw = tmp_path / "raw"
    rows = [("_SPX", instant(t), json.dumps(body(p, s, q), indent=2)) for t, p, s, q, _ in TIMELINE]
    schema = "ticker string, capture_utc timestamp, body string"
    archive.write(spark.createDataFrame(rows, schema), str(raw))
    first = {f.name: f.read_bytes() for f in raw.glob("*")}
    assert sorted(first) == [f"_SPX_{t}.json.gz" for t, *_ in TIMELINE]
    assert all(gzip.decompress(b) == json.dumps(json.loads(text), separators=(",", ":")).encode() for (_, _, text), b in zip(rows, (first[n] for n in sorted(first)), strict=True))
    archive.write(spark.createDataFrame(rows[::-1], schema).repartition(3), str(raw))
    assert {f.name: f.read_bytes() for f in raw.glob("*")} == first  # reproducible
    for wrong in ([("SPY", instant(TIMELINE[0][0]), "{}"), ("SPY", instant(TIMELINE[1][0]), "not json")], [("SPY", instant(TIMELINE[0][0]), "{}")] * 2):
        with pytest.raises(Exception, match="JSONDecodeError|more than once"):
            archive.write(spark.createDataFrame(wrong, schema).repartition(2), str(raw))
        assert {f.name for f in raw.glob("*")} == {*first}


def test_bodies_streamed_into_the_archive(spark, tmp_path):
    land, raw = tmp_path / "landing" / "ticker=_SPX", str(tmp_path / "raw")
    land.mkdir(parents=True)
    for t, p, s, q, _ in TIMELINE:
        (land / f"{t}.json").write_text(json.dumps(body(p, s, q)))
    bodies = gate_stream.landed(spark, str(tmp_path / "landing"), max_files=4)
    archive.write_stream(bodies, raw, str(tmp_path / "state")).awaitTermination()
    assert [r.stem for r in archive.oldest_first(archive.scan(spark, raw)).collect()] == [f"_SPX_{t}" for t, *_ in TIMELINE]


def test_arrivals_hold_back_what_may_still_be_overtaken(tmp_path):
    for stamp in ("2026-08-11T20-00-00Z", "2026-08-11T20-10-00Z", "2026-08-11T20-12-00Z"):
        (tmp_path / f"SPY_{stamp}.json").write_text("{}")
    (tmp_path / "SPY_2026-02-31T20-10-00Z.json").write_text("{}")
    source = archive._Arrivals(str(tmp_path), lag=120)
    end = source.latestOffset()
    taken = sorted(name for p in source.partitions(source.initialOffset(), end) for name, _, _ in source.read(p))
    assert taken == ["SPY_2026-08-11T20-00-00Z.json", "SPY_2026-08-11T20-10-00Z.json"]
    assert source.partitions(end, end) == []


def test_gate_equals_the_sequential_rule(spark):
    rng = random.Random(5)
    start = datetime(2026, 8, 11, 13, 0)
    rows, last, want = [], {"A": "p0", "B": None}, []
    prints = {"p0": start - timedelta(hours=9)}
    for i in range(300):
        at = start + timedelta(minutes=7 * i)
        ticker = "A" if rng.random() < 0.9 else "B"
        printed = at - timedelta(minutes=rng.choice([0, 5, 26, 27, 28, 60]))
        printed = printed.replace(minute=printed.minute // 20 * 20, second=0)
        force = rng.random() < 0.05
        age = at - printed
        key = printed.isoformat()
        if force:
            v = "forced"
        elif last[ticker] == key:
            v = "duplicate_print"
        else:
            v = "stale_feed" if age > timedelta(minutes=27) else "accept"
        if v in ("accept", "forced"):
            last[ticker] = key
        rows.append((ticker, at, printed, force))
        want.append(v)
    df = spark.createDataFrame(rows, "ticker string, capture_utc timestamp, index_last_trade timestamp, force boolean")
    seed = spark.createDataFrame([("A", "nothing", 1)], "ticker string, print string, seqno bigint")
    for tasks in (1, 3, 40):
        got = gate.judge(df, seed, tasks=tasks).orderBy("capture_utc").collect()
        assert [r.verdict for r in got] == want
    assert {"forced", "duplicate_print", "stale_feed", "accept"} == set(want)
    assert prints


BROKEN = {
    "malformed JSON": "{bad",
    "payload is not an object": "[1]",
    "payload has no 'data' object": json.dumps({"timestamp": "x"}),
    "payload has no top-level 'timestamp'": json.dumps({**body(), "timestamp": ""}),
    "empty timestamp": json.dumps(body("")),
    "expected a naive US/Eastern timestamp, got an aware one: '2026-08-11T16:14:59+00:00'": json.dumps(body("2026-08-11T16:14:59+00:00")),
    "unparseable timestamp 'soon'": json.dumps(body("soon")),
    "unusable current_price: 0.0": json.dumps(body(spot=0)),
    "unusable current_price: None": json.dumps(body(spot="7728")),
    "unusable seqno": json.dumps(body(seqno=1.5)),
    "payload has no 'options' list": json.dumps({**body(), "data": {**body()["data"], "options": {}}}),
}


def test_every_missing_field_is_an_error(spark):
    rows = [("_SPX", instant(TIMELINE[0][0]), want, text) for want, text in BROKEN.items()] + [("_SPX", instant(TIMELINE[0][0]), None, json.dumps(body()))]
    df = spark.createDataFrame(rows, "ticker string, capture_utc timestamp, want string, body string")
    for r in payloads.snapshots(df).select("want", "error").collect():
        assert r.error == r.want


def test_option_fields_are_coerced_not_guessed(spark):
    options = [
        {"option": "SPXW260821C01400000", "bid": 12, "ask": "12.5", "iv": 0, "delta": True, "tick": "up", "last_trade_time": ""},
        {"option": "SPX260821P01400000", "bid": None, "tick": 5},
        {"option": "garbage"}, {"option": 7}, {},
    ]
    df = spark.createDataFrame([("_SPX", instant(TIMELINE[4][0]), json.dumps(body(options=options)))], "ticker string, capture_utc timestamp, body string")
    snaps = payloads.snapshots(df)
    q = payloads.quotes(payloads.option_rows(snaps)).orderBy("root").collect()
    assert len(q) == 2 and len(q[0]) == 33
    assert (q[1].bid, q[1].ask, q[1].iv, q[1].delta, q[1].tick, q[1].last_trade_time) == (12.0, None, 0.0, None, "up", None)
    assert (q[0].bid, q[0].tick, q[0].option_right, q[0].underlying_ticker) == (None, None, "put", "_SPX")
    report = payloads.conversion_report(snaps).first()
    assert (report.rows, report.unparsed, report.error) == (2, 3, None)
    assert payloads.capture_meta(snaps).first().iv30 == 12.5


def test_health_fold_matches_the_running_record(spark):
    rng, rows = random.Random(2), []
    at = datetime(2026, 8, 11, tzinfo=UTC)
    want = {"consecutive_failures": 0, "total_writes": 0, "total_skips": 0, "total_failures": 0}
    for i in range(200):
        at += timedelta(minutes=10)
        kind = rng.choice(["accept", "stale_feed", "fail", "fail", "skipped_locked"]) if i < 195 else "fail"
        error = f"e{i}" if kind == "fail" else None
        rows.append(("T", at, "FeedError" if error else kind, kind == "accept", error))
        if kind == "skipped_locked":
            continue
        want |= {"last_verdict": rows[-1][2], "last_error": error}
        want["consecutive_failures"] = want["consecutive_failures"] + 1 if error else 0
        want["total_failures"] += error is not None
        want["total_writes"] += kind == "accept"
        want["total_skips"] += kind == "stale_feed"
        if kind == "accept":
            written = at
    got = health.fold(spark.createDataFrame(rows, "ticker string, at timestamp, verdict string, written boolean, error string"), ["ticker"], ["at"]).first()
    assert {f: got[f] for f in want} == want and got.consecutive_failures >= 5
    assert got.last_write.replace(tzinfo=UTC) == written


def test_health_of_many_keys_is_the_same_however_it_is_cut(spark, monkeypatch):
    rng, rows = random.Random(9), []
    start = datetime(2026, 8, 11)
    for i in range(900):
        key = rng.choice(["hot"] * 6 + ["a", "b", None]) if i > 30 else "early"
        kind = rng.choice(["accept", "stale_feed", "fail", "fail", "fail", "skipped_locked"])
        rows.append((key, start + timedelta(seconds=i // 2), i, "FeedError" if kind == "fail" else kind, kind == "accept", f"e{i}" if kind == "fail" else None))
    rows += [("never", start, 1000 + i, "FeedError", None, f"n{i}") for i in range(5)]
    want = {}
    for key, at, _, verdict, written, error in rows:
        if verdict == "skipped_locked":
            continue
        r = want.setdefault(key, [None, None, None, None, None, 0, 0, 0, 0])
        r[0], r[3], r[4] = at, verdict, error
        r[1], r[2] = (r[1], r[2]) if error else (at, at if written else r[2])
        r[5:] = [r[5] + 1 if error else 0, r[6] + bool(written and not error), r[7] + bool(not written and not error), r[8] + bool(error)]
    frame = spark.createDataFrame(rows, "ticker string, at timestamp, id long, verdict string, written boolean, error string")
    names = ["last_attempt", "last_ok", "last_write", "last_verdict", "last_error", "consecutive_failures", "total_writes", "total_skips", "total_failures"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        for tasks in (1, 7):
            got = health.fold(frame.repartition(5), ["ticker"], ["at", "id"], tasks)
            assert {r.ticker: [r[n] for n in names] for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1  # one pass over the log
    aged = health.with_ages(got, F.lit("2026-08-11 01:00:00").cast("timestamp")).where("ticker = 'never'").first()
    assert aged.attempt_age == timedelta(hours=1) and aged.ok_age is None and aged.write_age is None
    late = health.stale(got, F.lit("2026-08-11 00:08:00").cast("timestamp"), "5 minutes")
    assert {r.ticker for r in late.collect()} >= {"never", "early"}


def test_last_before_carries_over_tasks_and_batches(spark):
    rng, rows = random.Random(4), []
    for i in range(600):
        rows.append((rng.choice(["hot"] * 8 + ["a", None]), i // 3, i, f"v{i}" if rng.random() < 0.04 else None))
    frame = spark.createDataFrame(rows, "k string, at int, id int, v string")
    last, want = {}, {}
    for k, _, i, v in rows:
        want[i] = last.get(k)
        last[k] = v or last.get(k)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        for tasks in (1, 5, 60):
            got = ordered.last_before(frame.repartition(4), ["k"], ["at", "id"], F.col("v"), "before", tasks)
            assert {r.id: r.before for r in got.collect()} == want and got.columns == ["k", "at", "id", "v", "before"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ordered.last_before(frame.limit(0), ["k"], ["at"], F.col("v"), "before").count() == 0


def test_bodies_reach_python_in_batches_of_bounded_size(spark):
    """Rows of 20 KB: a batch holds some 16 MB of them, not the 10,000 rows that small ones would be."""
    bodies = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 20000) AS body")

    def measured(frames):
        for frame in frames:
            yield frame.assign(size=frame["body"].str.len().sum(), n=len(frame))[["size", "n"]].head(1)

    got = bodies.mapInPandas(measured, "size long, n long").collect()
    assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 20 << 20
