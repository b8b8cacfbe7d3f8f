"""The raw archive: one JSON body per capture, named by ticker and instant.

Capture names start with an underscore, and every built-in file source silently
skips such files. Listing is therefore a Python data source and bodies are read
by tasks from the listed paths. Paths may be any URI pyarrow can open, so the
archive can live on a shared file system or object store.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    InputPartition,
)

from ..functions import symbols
from ..operators import reconcile
from .files import DRAFTS, Drafted, Drafts

FORMAT = "capture_files"
LISTING = "name string, path string, size bigint"
CHUNK = 1 << 20
GZIP_LEVEL = 6

def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _children(path: str, deep: bool = False) -> list[pafs.FileInfo]:
    fs, root = _open(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=deep))
    return [f for f in found if f"/{DRAFTS}" not in f.path]


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _Lister(DataSourceReader):
    """One partition for the root's own files and one per folder in it, which a task lists to any depth."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        below = [f.path for f in _children(self.root) if f.type == pafs.FileType.Directory]
        return [_Folder(self.root, False), *(_Folder(p, True) for p in below)]

    def read(self, partition):
        for info in _children(partition.path, partition.deep):
            if info.type == pafs.FileType.File:
                yield info.base_name, info.path, info.size


# --- arrivals ------------------------------------------------------------------

_NAME = re.compile(symbols.CAPTURE_FILE)
_STAMP = "%Y-%m-%dT%H-%M-%SZ"  # fixed value: how a capture instant is written in a name


def capture_key(name: str) -> tuple[str, str] | None:
    """(stamp, ticker) of a capture's file name, the order in which captures are streamed."""
    found = _NAME.match(name)
    if not found:
        return None
    try:
        datetime.strptime(found[2], _STAMP)
    except ValueError:
        return None
    return found[2], found[1]


class _Range(_Folder):
    """The captures of one folder after one key and up to another."""

    def __init__(self, path: str, deep: bool, after: tuple[str, str], upto: tuple[str, str]):
        super().__init__(path, deep)
        self.after, self.upto = after, upto


class _Arrivals(DataSourceStreamReader):
    """Captures in order of (stamp, ticker): an offset is the last key taken.

    Files are found by tasks, a folder each; the driver keeps one key while it
    looks for the newest. ``lag`` seconds hold the newest captures back, for
    archives whose writers may finish out of order: a capture that lands later
    than that is not streamed.
    """

    def __init__(self, root: str, lag: float = 0.0):
        self.root, self.lag = root, timedelta(seconds=lag)

    def initialOffset(self) -> dict:
        return {"stamp": "", "ticker": ""}

    def latestOffset(self) -> dict:
        keys = (capture_key(info.base_name) for p in _Lister(self.root).partitions() for info in _children(p.path, p.deep))
        newest = max((k for k in keys if k), default=("", ""))
        if self.lag and newest[0]:
            held = (datetime.strptime(newest[0], _STAMP).replace(tzinfo=UTC) - self.lag).strftime(_STAMP)
            newest = (held, "\U0010ffff")  # every ticker of that instant
        return {"stamp": newest[0], "ticker": newest[1]}

    def partitions(self, start: dict, end: dict):
        after, upto = ((o["stamp"], o["ticker"]) for o in (start, end))
        return [_Range(p.path, p.deep, after, upto) for p in _Lister(self.root).partitions()] if after < upto else []

    def read(self, partition):
        for info in _children(partition.path, partition.deep):
            key = capture_key(info.base_name)
            if key and partition.after < key <= partition.upto:
                yield info.base_name, info.path, info.size


# --- the archive as a sink -----------------------------------------------------


def packed(body: str, compressed: bool = True) -> bytes:
    """A body as it is archived: compact JSON, gzip without a time, so equal bodies give equal bytes."""
    plain = json.dumps(json.loads(body), separators=(",", ":")).encode()
    return gzip.compress(plain, compresslevel=GZIP_LEVEL, mtime=0) if compressed else plain


class _Sink(DataSourceWriter):
    """(ticker, capture_utc, body) rows as one file each: drafts by the tasks, renamed together at the commit."""

    def __init__(self, target: str, name: str | None = None, compressed: bool = True):
        self.drafts, self.compressed = Drafts(target, name), compressed

    def write(self, iterator):
        files = []
        for row in iterator:
            at = row.capture_utc if row.capture_utc.tzinfo is None else row.capture_utc.astimezone(UTC)
            name = f"{row.ticker}_{at.strftime(_STAMP)}.json{'.gz' if self.compressed else ''}"
            files.append((self.drafts.write(packed(row.body, self.compressed)), name))
        return Drafted(files)

    def commit(self, messages):
        counted = Counter(name for m in messages if m is not None for _, name in m.files)
        twice = sorted(name for name, n in counted.items() if n > 1)
        if twice:
            self.drafts.abort()
            raise ValueError(f"{len(twice)} names are written more than once, the first is {twice[0]}; nothing was archived")
        self.drafts.commit(messages)

    def abort(self, messages):
        self.drafts.abort()


class _StreamSink(DataSourceStreamWriter):
    """The same per micro-batch; one that is repeated writes the same names and bytes.

    Tasks and commits of a stream use instances of their own, so the drafts folder has a name given with the query.
    """

    def __init__(self, target: str, name: str):
        self.sink = _Sink(target, name)

    def write(self, iterator):
        return self.sink.write(iterator)

    def commit(self, messages, batchId):
        self.sink.commit(messages)

    def abort(self, messages, batchId):
        self.sink.abort(messages)


class CaptureFiles(DataSource):
    """``spark.read.format("capture_files").load(dir)``: every file, hidden or not.

    As a stream, the captures that arrive; as a sink, an archive of bodies.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _Lister(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Arrivals(self.options["path"], float(self.options.get("lag", "0")))

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Sink(self.options["path"], compressed=self.options.get("compressed", "true") == "true")

    def streamWriter(self, schema, overwrite) -> DataSourceStreamWriter:
        return _StreamSink(self.options["path"], self.options.get("drafts", "stream"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(name, path, size) of every file below a folder."""
    spark.dataSource.register(CaptureFiles)
    return spark.read.format(FORMAT).load(str(folder))


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("_c", symbols.capture_file(F.col("name"))).where("_c is not null").select("_c.*", "name", "path", "size")


def scan(spark: SparkSession, raw_dir: str) -> DataFrame:
    """Captures of an archive folder; other files in it are none of our business."""
    return _named(listing(spark, raw_dir))


def arrivals(spark: SparkSession, raw_dir: str, lag_seconds: float = 0.0) -> DataFrame:
    """The same as a stream: each capture once, under its own name, whatever folder it lands in."""
    spark.dataSource.register(CaptureFiles)
    return _named(spark.readStream.format(FORMAT).option("lag", lag_seconds).load(str(raw_dir)))


def _to_sink(bodies: DataFrame) -> DataFrame:
    bodies.sparkSession.dataSource.register(CaptureFiles)
    return bodies.select("ticker", "capture_utc", "body")


def write(bodies: DataFrame, raw_dir: str, compressed: bool = True) -> None:
    """Archive (ticker, capture_utc, body) rows, all of them or none; a name that occurs twice stops the write."""
    _to_sink(bodies).write.format(FORMAT).option("path", str(raw_dir)).option("compressed", compressed).mode("append").save()


def write_stream(bodies: DataFrame, raw_dir: str, checkpoint_dir: str):
    """Archive streamed bodies, a micro-batch at a time; returns the query."""
    writer = _to_sink(bodies).writeStream.format(FORMAT).option("path", str(raw_dir)).option("drafts", uuid.uuid4().hex)
    writer = writer.option("checkpointLocation", checkpoint_dir)
    return writer.trigger(availableNow=True).start()


def oldest_first(captures: DataFrame) -> DataFrame:
    return captures.orderBy("capture_utc", "ticker")


def _content(path: str) -> bytes:
    fs, name = _open(path)
    with fs.open_input_stream(name, compression=None) as stream:
        return stream.read()


def _tasks(captures: DataFrame) -> int:
    """A listing is a few bytes per file; the work behind a row is not."""
    spark = captures.sparkSession
    return max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _spread(captures: DataFrame) -> DataFrame:
    return captures.repartition(_tasks(captures))


def _in_order(captures: DataFrame) -> DataFrame:
    """Oldest first over and within partitions, put in order while a row is still only a name."""
    return captures.repartitionByRange(_tasks(captures), "capture_utc", "ticker").sortWithinPartitions("capture_utc", "ticker")


def _read_bodies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        # One body at a time leaves the task: a batch of them could be large.
        for row in frame.itertuples(index=False):
            body, problem = None, None
            try:
                raw = _content(row.path)
                body = (gzip.decompress(raw) if row.compressed else raw).decode("utf-8")
            except (OSError, EOFError, ValueError, zlib.error) as exc:
                problem = f"{type(exc).__name__}: {exc}"
            yield pd.DataFrame(
                {"ticker": [row.ticker], "capture_utc": [row.capture_utc], "stem": [row.stem],
                 "body": [body], "read_error": [problem]}
            )


def with_bodies(captures: DataFrame, in_order: bool = False) -> DataFrame:
    """Read each capture once, compressed or not. An unreadable file is a row, not a crash."""
    return (_in_order if in_order else _spread)(captures).mapInPandas(
        _read_bodies,
        "ticker string, capture_utc timestamp, stem string, body string, read_error string",
    )


def iter_payloads(spark: SparkSession, raw_dir: str) -> Iterator:
    """Stream (stem, body) rows to the driver, oldest first, a partition at a time."""
    return with_bodies(scan(spark, raw_dir), in_order=True).select("stem", "body").toLocalIterator()


# --- checksums ---------------------------------------------------------------


def _digest(path: str) -> str:
    fs, name = _open(path)
    sha = hashlib.sha256()
    with fs.open_input_stream(name, compression=None) as stream:
        while chunk := stream.read(CHUNK):
            sha.update(chunk)
    return sha.hexdigest()


def _read_digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.assign(digest=[_digest(p) for p in frame["path"]])


def digests(captures: DataFrame, in_order: bool = False) -> DataFrame:
    """(ticker, capture_utc, name, digest), hashed in chunks by the tasks."""
    chosen = (_in_order if in_order else _spread)(captures.select("ticker", "capture_utc", "name", "path"))
    return chosen.mapInPandas(
        _read_digests, "ticker string, capture_utc timestamp, name string, path string, digest string"
    ).drop("path")


def write_manifest(spark: SparkSession, raw_dir: str, manifest: str) -> int:
    """A checksum manifest over the archive, oldest first; returns how many captures.

    A text dataset: each task hashes its captures and writes their lines, and
    the files in order of name are one ``shasum -c`` list.
    """
    lines = digests(scan(spark, raw_dir), in_order=True).select(F.concat_ws("  ", "digest", "name").alias("value"))
    lines.write.mode("overwrite").text(str(manifest))
    return spark.read.text(str(manifest)).count()


def manifest_entries(lines: DataFrame) -> DataFrame:
    """(name, digest) from manifest text in a ``value`` column."""
    parts = F.split("value", "  ", 2)
    return (
        lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
        .select(F.trim(F.get(parts, F.lit(1))).alias("name"), F.trim(F.get(parts, F.lit(0))).alias("digest"))
        .where("name != '' and digest != ''")
    )


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    return manifest_entries(spark.read.text(str(manifest)))


def verify(spark: SparkSession, raw_dir: str, manifest: str) -> DataFrame:
    return reconcile.verify(read_manifest(spark, manifest), digests(scan(spark, raw_dir)))


# --- compression -------------------------------------------------------------


def _compress_one(path: str, level: int, dry_run: bool) -> tuple[int, int]:
    fs, name = _open(path)
    target = f"{name}.gz"
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        # A retried task whose first attempt finished: the original is gone and
        # its proven replacement stands.
        with fs.open_input_stream(target, compression=None) as f:
            done = f.read()
        return len(gzip.decompress(done)), len(done)
    original = _content(path)
    packed = gzip.compress(original, compresslevel=level, mtime=0)
    if dry_run:
        return len(original), len(packed)
    draft = f"{target}.{uuid.uuid4().hex}.tmp"
    try:
        with fs.open_output_stream(draft, compression=None) as out:
            out.write(packed)
        with fs.open_input_stream(draft, compression=None) as f:
            if gzip.decompress(f.read()) != original:
                raise OSError(f"{name}: the compressed copy does not restore the original, which stays")
        fs.move(draft, target)
    except BaseException:
        if fs.get_file_info(draft).type != pafs.FileType.NotFound:
            fs.delete_file(draft)
        raise
    fs.delete_file(name)
    return len(original), len(packed)


def compress_archive(captures: DataFrame, level: int = GZIP_LEVEL, dry_run: bool = False) -> DataFrame:
    """Gzip every plain capture, proving each copy before its original goes.

    Output bytes are reproducible, so a retried task finds or makes the same
    file. One row per capture: before, after, skipped, ratio.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                size = (row.size, row.size) if row.compressed else _compress_one(row.path, level, dry_run)
                rows.append((row.stem, *size, bool(row.compressed)))
            yield pd.DataFrame(rows, columns=["stem", "before", "after", "skipped"])

    chosen = captures.select("stem", "path", "size", "compressed")
    done = _spread(chosen).mapInPandas(run, "stem string, before bigint, after bigint, skipped boolean")
    return done.withColumn("ratio", F.coalesce(F.try_divide("before", "after"), F.lit(0.0)))
