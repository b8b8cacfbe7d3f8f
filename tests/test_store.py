import gzip
import hashlib
import json
import math
from datetime import date

import pytest

from optionlake import cli
from optionlake.plans import curate
from optionlake.sources import archive, curated
from test_ingest import body


def option(root, expiry, right, k, mid, half=0.25):
    return {"option": f"{root}{expiry:%y%m%d}{right}{int(k * 1000):08d}", "bid": round(mid - half, 4), "ask": round(mid + half, 4), "iv": 0.2}


def chain_options():
    """A parity-consistent logistic chain on two expiries."""
    out = []
    for expiry, width, f, d in ((date(2026, 9, 18), 260.0, 7760.0, 0.995), (date(2026, 10, 16), 340.0, 7780.0, 0.992)):
        for k in range(6000, 9500, 50):
            for right, s in (("C", 1), ("P", -1)):
                out.append(option("SPXW", expiry, right, k, d * width * math.log1p(math.exp(s * (f - k) / width))))
    return [o for o in out if o["bid"] > 0]


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    base = tmp_path_factory.mktemp("data")
    raw = base / "raw"
    raw.mkdir()
    chain = json.dumps(body(options=[*chain_options(), {"option": "junk"}]))
    (raw / "_SPX_2026-08-11T20-37-03Z.json").write_text(chain)
    (raw / "_SPX_2026-08-11T20-47-05Z.json.gz").write_bytes(gzip.compress(chain.encode()))
    (raw / "_SPX_2026-08-12T20-37-03Z.json").write_text(json.dumps(body()))
    (raw / "_SPX_2026-08-13T20-37-03Z.json").write_text("{}")
    (raw / "_SPX_2026-08-13T20-47-03Z.json.gz").write_bytes(b"not gzip")
    (raw / ".DS_Store").write_text("x")
    (raw / "_SPX_2026-08-13T20-57-03Z.json.gz.tmp").write_text("x")
    return base


def test_underscore_files_are_listed_read_and_hashed(spark, data):
    found = archive.oldest_first(archive.scan(spark, str(data / "raw"))).collect()
    assert [r.stem[5:] for r in found] == ["2026-08-11T20-37-03Z", "2026-08-11T20-47-05Z", "2026-08-12T20-37-03Z", "2026-08-13T20-37-03Z", "2026-08-13T20-47-03Z"]
    bodies = {r.stem: r for r in archive.with_bodies(archive.scan(spark, str(data / "raw"))).collect()}
    assert bodies[found[0].stem].body == bodies[found[1].stem].body
    assert bodies[found[4].stem].read_error.startswith("BadGzipFile")
    digest = {r.name: r.digest for r in archive.digests(archive.scan(spark, str(data / "raw"))).collect()}
    assert digest[found[0].name] == hashlib.sha256((data / "raw" / found[0].name).read_bytes()).hexdigest()
    assert archive.scan(spark, str(data / "nowhere")).count() == 0
    assert [s for s, _ in archive.iter_payloads(spark, str(data / "raw"))] == [r.stem for r in found]


def test_backfill_isolates_failures_and_resumes(spark, data):
    raw, out = str(data / "raw"), str(data / "curated")
    with pytest.raises(FileNotFoundError, match="run backfill"):
        curated.open_catalog(spark, out)
    done = curated.backfill(spark, raw, out)
    t, n = done.totals(), len(chain_options())
    assert (t.written, t.skipped, t.failed, t.rows, t.unparsed) == (3, 0, 2, 2 * n, 2) and done.total_bytes > 0
    errors = {r.stem[5:]: r.error for r in done.outcomes.where("status = 'failed'").collect()}
    assert errors["2026-08-13T20-37-03Z"] == "payload has no 'data' object" and "BadGzipFile" in errors["2026-08-13T20-47-03Z"]
    again = curated.backfill(spark, raw, out).totals()
    assert (again.written, again.rows) == (3, 2 * n)
    resumed = curated.backfill(spark, raw, out, overwrite=False).totals()
    assert (resumed.written, resumed.skipped, resumed.failed) == (0, 3, 2)
    one = curated.backfill(spark, raw, out, stems=["_SPX_2026-08-11T20-37-03Z"]).totals()
    assert (one.written, one.rows) == (1, n)
    sides = curated.divergence(spark, raw, out).collect()
    assert {(r.stem[5:], r.side) for r in sides} == {("2026-08-13T20-37-03Z", "missing_curated"), ("2026-08-13T20-47-03Z", "missing_curated")}


def test_sql_over_the_catalog(spark, data):
    quotes = curated.open_catalog(spark, str(data / "curated"))
    assert len(quotes.columns) == 34 and quotes.count() == 2 * len(chain_options())
    rows = spark.sql("select capture_utc, n_options, n_expiries, n_roots from captures order by 1").collect()
    assert [(r.n_options, r.n_expiries, r.n_roots) for r in rows] == [(len(chain_options()), 2, 1)] * 2
    captures = spark.table("captures")
    read = captures._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,capture)" in read and "EqualTo(kind,quote)" not in read and "strike" not in read  # no quote is read
    assert sorted(map(tuple, captures.collect())) == sorted(map(tuple, curated.captures_view(quotes).collect()))
    assert curated.resolve_capture(captures) == rows[1].capture_utc
    assert curated.resolve_capture(captures, "20-37") == rows[0].capture_utc
    with pytest.raises(LookupError, match="newest is 2026-08-11T20-47-05Z"):
        curated.resolve_capture(captures, "1999")
    plan = quotes.where("capture_utc = timestamp'2026-08-11 20:37:03'").select("strike")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(kind), IsNotNull(capture_utc), EqualTo(kind,quote)" in plan
    assert "rho" not in plan.split("ReadSchema")[1]
    one = curate.from_catalog(quotes, rows[0].capture_utc).flagged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(capture_date" in one  # one day is read


def test_command_line_end_to_end(spark, data, capsys):
    where, manifest = ["--dir", str(data)], str(data / "m.sha256")
    assert cli.main(["verify", *where, "--manifest", manifest]) == cli.ATTENTION
    assert cli.main(["verify", *where, "--manifest", manifest, "--write"]) == cli.OK
    assert cli.main([*where, "verify", "--manifest", manifest]) == cli.OK
    target = data / "raw" / "_SPX_2026-08-12T20-37-03Z.json"
    kept = target.read_text()
    target.write_text(kept + " ")
    assert cli.main(["verify", *where, "--manifest", manifest]) == cli.ATTENTION
    assert "corrupted" in capsys.readouterr().out
    target.write_text(kept)
    assert cli.main(["captures", *where, "--list"]) == cli.ATTENTION
    assert cli.main(["status", *where]) == cli.ATTENTION
    assert cli.main(["curate", *where, "--capture", "20-37"]) == cli.OK
    assert "[forwards]" in capsys.readouterr().out
    csv = data / "t.csv"
    assert cli.main(["estimate", *where, "--csv", str(csv), "--term-structure"]) in (cli.OK, cli.ATTENTION)
    assert csv.read_text().startswith("expiry,root,tenor_years,days,forward,n_quotes") and len(csv.read_text().splitlines()) == 3
    assert "[term structure]" in capsys.readouterr().out
    assert cli.main(["curate", *where, "--capture", "1999"]) == cli.FAILED
    assert cli.main(["backfill", *where, "--resume"]) == cli.ATTENTION


def test_folders_of_any_depth_are_listed(spark, tmp_path):
    deep = tmp_path / "2026" / "08" / "11"
    deep.mkdir(parents=True)
    for k, folder in enumerate((tmp_path, deep.parent.parent, deep.parent, deep)):
        (folder / f"_SPX_2026-08-11T20-0{k}-05Z.json").write_text("{}")
    assert archive.scan(spark, str(tmp_path)).count() == 4
    read = [r.stem for r in archive.iter_payloads(spark, str(tmp_path))]
    assert read == [f"_SPX_2026-08-11T20-0{k}-05Z" for k in range(4)]


def test_compression_proves_itself_first(spark, data):
    raw = data / "raw"
    plain = {p.name: p.read_bytes() for p in raw.glob("*.json")}
    listed = archive.scan(spark, str(raw))
    dry = {r.stem: r for r in archive.compress_archive(listed, dry_run=True).collect()}
    assert sorted(p.name for p in raw.glob("*.json")) == sorted(plain) and dry["_SPX_2026-08-11T20-37-03Z"].ratio > 3
    done = archive.compress_archive(archive.scan(spark, str(raw))).collect()
    assert sum(r.skipped for r in done) == 2 and not list(raw.glob("*.json"))
    for name, content in plain.items():
        assert gzip.decompress((raw / f"{name}.gz").read_bytes()) == content
