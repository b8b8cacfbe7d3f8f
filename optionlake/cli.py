"""Command line: every command prints frames and returns 0 (worked), 1 (failed) or 2 (needs attention)."""

from __future__ import annotations

import argparse
import csv
import sys
from pathlib import Path

from pyspark.sql import functions as F

from .operators import health, reconcile
from .plans import collect, reports
from .plans import curate as curation
from .plans import estimate as estimation
from .session import get_spark
from .sources import archive, curated

OK, FAILED, ATTENTION = 0, 1, 2


class Place:
    """The folders of one data directory."""

    def __init__(self, args):
        self.spark = get_spark()
        self.raw, self.curated = (str(Path(args.dir) / name) for name in ("raw", "curated"))

    def divergence(self):
        return curated.divergence(self.spark, self.raw, self.curated).groupBy("side").agg(F.count(F.lit(1)).alias("captures"))

    def chain(self, pattern: str | None) -> curation.CuratedChain:
        quotes = curated.open_catalog(self.spark, self.curated)
        return curation.from_catalog(quotes, curated.resolve_capture(self.spark.table("captures"), pattern))


def status(place: Place, args) -> int:
    """The health record that screening the archive leaves, per ticker, and how long ago each of its clocks moved."""
    screened = collect.screen(archive.with_bodies(archive.scan(place.spark, place.raw)))
    record = health.with_ages(health.fold(collect.outcomes(screened), ["ticker"], ["at"]), F.now()).persist()
    known = reports.show("health", record, "ticker")
    return OK if known and record.where("consecutive_failures > 0").isEmpty() else ATTENTION


def verify(place: Place, args) -> int:
    code = ATTENTION
    if Path(args.manifest).exists():
        checked = archive.verify(place.spark, place.raw, args.manifest).persist()
        reports.show("manifest", checked.groupBy("status").agg(F.count(F.lit(1)).alias("captures")), "status")
        broken = checked.where(F.col("status").isin(reconcile.CORRUPTED, reconcile.MISSING))
        code = ATTENTION if reports.show("broken", broken, "status", "name") else OK
    elif args.write:
        code = OK
    if args.write:
        print(archive.write_manifest(place.spark, place.raw, args.manifest), "captures in", args.manifest)
    return code


def captures(place: Place, args) -> int:
    found = archive.scan(place.spark, place.raw)
    size = found.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("captures"), F.sum("size").alias("bytes"), F.min("capture_utc").alias("first"), F.max("capture_utc").alias("last")
    )
    known = reports.show("archive", size, "ticker")
    if args.list:
        reports.show("captures", found.select("ticker", "capture_utc", "size", "compressed"), "capture_utc", "ticker")
    return ATTENTION if reports.show("out of step", place.divergence(), "side") or not known else OK


def backfill(place: Place, args) -> int:
    done = curated.backfill(place.spark, place.raw, place.curated, overwrite=not args.resume)
    reports.show("backfill", done.outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("captures"), F.sum("rows").alias("rows"), F.sum("unparsed").alias("unparsed")), "status")
    failed = reports.show("failed", done.outcomes.where("status = 'failed'").select("stem", "error"), "stem")
    return ATTENTION if failed + reports.show("out of step", place.divergence(), "side") else OK


def curate(place: Place, args) -> int:
    chain = place.chain(args.capture)
    reports.show("quotes", chain.totals, "capture_utc")
    reports.show("rules", chain.by_rule, "capture_utc", F.desc("flagged"))
    reports.show("forwards", chain.forward_summary(), "capture_utc")
    reports.show("excluded", chain.forwards.where("excluded is not null").select("capture_utc", "expiry", "root", "excluded"), "capture_utc", "expiry", "root")
    return OK


def estimate(place: Place, args) -> int:
    frame = estimation.estimate_all(place.chain(args.capture).quotes).persist()  # a row per (expiry, root)
    reports.show("estimates", estimation.summary(frame), "capture_utc")
    reports.show("doubtful", frame.where("not trustworthy").select("expiry", "root", "n_quotes", "failures", "excluded"), "expiry", "root")
    if args.term_structure:
        kept = frame.where("trustworthy").select("expiry", "root", "days", "n_quotes", "annualised_vol", "skewness", "kurtosis")
        reports.show("term structure", kept, "days", "root")
    if args.csv:
        rows = frame.drop("capture_utc").orderBy("tenor_years", "root")
        with open(args.csv, "w", newline="") as out:
            sheet = csv.writer(out, lineterminator="\n")
            sheet.writerow(rows.columns)
            sheet.writerows(rows.toLocalIterator())
    return ATTENTION if frame.where("trustworthy").isEmpty() else OK


SWITCH = {"action": "store_true"}
#: Command: what it is for, and its options.
COMMANDS = {
    status: ("health of the captures", {}),
    verify: ("archive against manifest", {"--manifest": {"default": "manifests/raw_archive.sha256"}, "--write": SWITCH}),
    captures: ("archive and curated layer", {"--list": SWITCH}),
    backfill: ("curated layer from the archive", {"--resume": SWITCH}),
    curate: ("quality of one capture", {"--capture": {}}),
    estimate: ("densities of one capture", {"--capture": {}, "--csv": {}, "--term-structure": SWITCH}),
}


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="optionlake", description=__doc__)
    top.add_argument("--dir", default="data")
    choices = top.add_subparsers(required=True)
    for run, (purpose, options) in COMMANDS.items():
        sub = choices.add_parser(run.__name__, help=purpose)
        sub.add_argument("--dir", default=argparse.SUPPRESS)
        for flag, settings in options.items():
            sub.add_argument(flag, **settings)
        sub.set_defaults(run=run)
    args = top.parse_args(argv)
    try:
        return args.run(Place(args), args)
    except (FileNotFoundError, LookupError) as exc:
        print(exc, file=sys.stderr)
        return FAILED


if __name__ == "__main__":
    sys.exit(main())
