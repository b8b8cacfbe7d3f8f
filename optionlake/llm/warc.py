"""WARC archives compressed with Zstandard, one frame per record, and their reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a
dictionary, itself a frame or as it is; every frame after it is one record,
compressed with that dictionary. Other skippable frames are passed over. The
reader streams: it holds one record, whatever the size of the archive.

A record's block is an HTTP response. A revisit has the headers of the response
but no payload; its HTTP Content-Length is the full payload's. ``Page-Id`` and
``Refers-To-Page-Id`` are extension fields with the rows' own ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter

from ..sources.files import Drafted, Drafts, opened
from .common import parts, stored, work_folder

# Frame magics, little-endian, and the lines that every record has.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, range(0x184D2A50, 0x184D2A60), 0x184D2A5D
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SUFFIX = ".warc.zst"
#: Payloads of at least this many bytes can be revisits.
LEAST = 0
LEVEL, DICTIONARY_BYTES = 3, 1 << 16
#: Bytes of records a dictionary is fitted to, the first of each archive; an archive ends beyond ROLL bytes.
SAMPLE, ROLL = 4 << 20, 256 << 20
READ = 1 << 20
WRITTEN = "page_id bigint, url string, html string, sha string, bytes bigint, kind string, refers_to bigint, copy bigint"


# --- records -------------------------------------------------------------------


def digest_text(sha: bytes) -> str:
    return base64.b32encode(sha).decode()


def _line(value: str) -> str:
    """A header value: one line, whatever the row holds."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def record(page_id: int | None, url: str | None, payload: bytes, sha: bytes, size: int, kind: str, refers_to: int | None, copy: int, date: str) -> bytes:
    """The bytes of one record; equal rows give equal bytes."""
    target = _line(url or "")
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{url}\n{sha.hex()}\n{kind}\n{copy}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", date), ("WARC-Target-URI", target),
        ("Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{digest_text(sha)}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("Refers-To-Page-Id", refers_to)]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None and v != "").encode()
    return head + b"\r\n" + block + END


@dataclass
class Record:
    fields: dict[str, str]
    payload: bytes
    #: What is wrong with it, or None.
    problem: str | None = None

    @property
    def kind(self) -> str:
        return self.fields.get("warc-type", "")

    @property
    def digest(self) -> str | None:
        return self.fields.get("warc-payload-digest", "").partition(":")[2] or None

    @property
    def size(self) -> int | None:
        """Length of the full payload: its own, or what a revisit's HTTP header says."""
        if self.kind != "revisit":
            return len(self.payload)
        said = self.fields.get("http content-length", "")
        return int(said) if said.isdecimal() else None


def _headers(head: bytes) -> dict[str, str]:
    """Field names in lower case; a line that starts with white space continues the one before."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif line:
            name, colon, value = line.partition(":")
            if not colon or not name.strip():
                raise ValueError(f"malformed header line {line[:60]!r}")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parse(data: bytes) -> Record:
    """A record from the bytes of its frame; what is malformed becomes its ``problem``."""
    head, found, rest = data.partition(END)
    first, _, lines = head.partition(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/\d+\.\d+", first):
        return Record({}, b"", "no WARC header")
    try:
        fields = _headers(lines)
    except ValueError as wrong:
        return Record({}, b"", str(wrong))
    said = fields.get("content-length", "")
    if not said.isdecimal():
        return Record(fields, b"", "no Content-Length")
    missing = [n for n in ("warc-type", "warc-record-id", "warc-date") if n not in fields]
    if missing:
        return Record(fields, b"", f"no {missing[0]}")
    if len(rest) != int(said) + len(END) or not rest.endswith(END):
        return Record(fields, b"", f"Content-Length {said}, but the block has {max(len(rest) - len(END), 0)} bytes")
    block = rest[: -len(END)]
    if not fields.get("content-type", "").startswith("application/http"):
        return Record(fields, block)
    http, found, payload = block.partition(END)
    if not found:
        return Record(fields, b"", "no end of the HTTP header")
    try:
        fields |= {f"http {k}": v for k, v in _headers(http.partition(b"\r\n")[2]).items()}
    except ValueError as wrong:
        return Record(fields, b"", str(wrong))
    made = Record(fields, payload)
    if made.kind == "revisit":
        if payload or made.size is None or made.digest is None:
            made.problem = "a revisit needs a digest, a length and no payload"
    elif fields.get("http content-length", str(len(payload))) != str(len(payload)):
        made.problem = f"HTTP Content-Length {fields['http content-length']}, but the payload has {len(payload)} bytes"
    elif made.digest not in (None, digest_text(hashlib.sha1(payload).digest())):
        made.problem = "the payload does not have its digest"
    return made


# --- archives ------------------------------------------------------------------


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Fitted to the records given; none where they are too few or too small for one."""
    if sum(map(len, samples)) < 8 * DICTIONARY_BYTES or len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:
        return None


def leading_frame(words: zstandard.ZstdCompressionDict) -> bytes:
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(words.as_bytes())
    return DICTIONARY.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


class _Source:
    """A stream with what was read of it but not used."""

    def __init__(self, stream):
        self.stream, self.held = stream, b""

    def more(self) -> bytes:
        out, self.held = self.held or self.stream.read(READ), b""
        return out

    def take(self, n: int) -> bytes:
        got = b""
        while len(got) < n and (part := self.more()):
            got += part
        self.held = got[n:]
        return got[:n]


def records(stream) -> Iterator[Record]:
    """Every record of an archive; one whose frame is damaged ends it, as a record with a problem."""
    source, words, first = _Source(stream), None, True
    while head := source.take(4):
        magic = int.from_bytes(head, "little")
        if magic in SKIPPABLE:
            size = source.take(4)
            body = source.take(int.from_bytes(size, "little"))
            if len(size) < 4 or len(body) < int.from_bytes(size, "little"):
                yield Record({}, b"", "a skippable frame is cut short")
                return
            if first and magic == DICTIONARY:
                if body[:4] == FRAME.to_bytes(4, "little"):
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                words = zstandard.ZstdCompressionDict(body)
            first = False
            continue
        first = False
        if magic != FRAME:
            yield Record({}, b"", "not a Zstandard frame")
            return
        source.held = head + source.held
        frame, out = zstandard.ZstdDecompressor(dict_data=words).decompressobj(), []
        try:
            while not frame.eof and (part := source.more()):
                out.append(frame.decompress(part))
        except zstandard.ZstdError as wrong:
            yield Record({}, b"", f"a frame cannot be decoded: {wrong}")
            return
        if not frame.eof:
            yield Record({}, b"", "a frame is cut short")
            return
        source.held = frame.unused_data
        yield parse(b"".join(out))


class _Writer(DataSourceArrowWriter):
    """One task's rows as archives; names carry the task's place, so a committed write has no two alike."""

    def __init__(self, drafts: Drafts, date: str):
        self.drafts, self.date = drafts, date

    def _records(self, batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                payload = row["html"].encode() if row["html"] else b""
                yield record(
                    row["page_id"], row["url"], payload, bytes.fromhex(row["sha"]), row["bytes"], row["kind"], row["refers_to"], row["copy"], self.date
                )

    def write(self, iterator):
        from pyspark import TaskContext

        task, files, source = TaskContext.get().partitionId(), [], self._records(iterator)
        left = next(source, None)
        while left is not None:
            samples, size = [left], len(left)
            left = None
            while size < SAMPLE and (data := next(source, None)) is not None:
                samples.append(data)
                size += len(data)
            words = dictionary(samples)
            press = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True)
            name = uuid.uuid4().hex
            with self.drafts.stream(name) as out:
                done = out.write(leading_frame(words)) if words else 0
                for data in samples:
                    done += out.write(press.compress(data))
                samples.clear()
                for data in source:
                    if done > ROLL:
                        left = data
                        break
                    done += out.write(press.compress(data))
            files.append((name, f"pages-{task:06d}-{len(files):04d}{SUFFIX}"))
        return Drafted(files)

    def commit(self, messages):
        self.drafts.commit(messages)

    def abort(self, messages):
        self.drafts.abort()


class WarcArchive(DataSource):
    """``df.write.format("warc_archive").option("path", folder).mode("append").save()``"""

    @classmethod
    def name(cls) -> str:
        return "warc_archive"

    def writer(self, schema, overwrite):
        return _Writer(Drafts(self.options["path"]), self.options.get("date", "1970-01-01T00:00:00Z"))


def planned(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """The record of every page, in the columns of WRITTEN.

    Of pages with equal payloads of at least ``least`` bytes the one with the
    smallest page_id (null last, then the smallest url) is a response, the rest
    are revisits. Who comes first is found on digests; payloads are shuffled
    only where the first of them occurs as several equal rows.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"sha": F.sha1("html"), "bytes": F.octet_length("html").cast("bigint")})
    counted = rows.where(F.col("bytes") >= least).groupBy("sha", "bytes", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")
    seen = stored(counted, "payloads")
    repeated = stored(
        seen.groupBy("sha").agg(F.min(F.struct(place.alias("place"), "n")).alias("first"), F.sum("n").alias("total")).where("total > 1")
        .select("sha", F.col("first.place.page_id").alias("first_id"), F.col("first.place.url").alias("first_url"), F.col("first.n").alias("first_n")),
        "repeated",
    )
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    met = rows.join(repeated, "sha", "left")
    response = {"kind": F.lit("response"), "refers_to": F.lit(None).cast("bigint"), "copy": F.lit(0).cast("bigint")}
    columns = [c.split()[0] for c in WRITTEN.split(", ")]
    out = met.where(F.col("first_n").isNull() | (is_first & (F.col("first_n") == 1))).withColumns(response).select(columns)
    if not repeated.where("first_n > 1").isEmpty():
        alike = met.where(is_first & (F.col("first_n") > 1)).groupBy("sha", "bytes", "page_id", "url").agg(F.first("html").alias("html"))
        out = out.unionByName(alike.withColumns(response).select(columns))
    # Copies are numbered in blocks, so that no array grows with them.
    left = seen.join(repeated, "sha").withColumn("left", F.col("n") - is_first.cast("int")).where("left > 0")
    block = 10_000
    blocks = left.withColumn("low", F.explode(F.expr(f"sequence(0L, (left - 1) div {block})"))).withColumn("low", F.col("low") * block)
    copies = blocks.withColumn("copy", F.explode(F.sequence("low", F.least(F.col("low") + block, "left") - 1)))
    revisits = copies.select(
        "page_id", "url", F.lit(None).cast("string").alias("html"), "sha", "bytes", F.lit("revisit").alias("kind"), F.col("first_id").alias("refers_to"), "copy"
    )
    return out.unionByName(revisits)


def write(pages: DataFrame, folder: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of all pages in a folder, all of them or none. Bytes depend on the rows and ``date`` alone."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcArchive)
    planned(pages, least).write.format("warc_archive").option("path", folder).option("date", date).mode("append").save()


READS = (
    "archive string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, problem string"
)


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?\d{1,19}", text) else None


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of every archive in a folder; ``problem`` says what is wrong with one (and with ``payload`` if asked for)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path")
    schema = READS + ", payload binary" * payloads
    arrow = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payloads
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = opened(path)
                held, size = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for r in records(stream):
                        held.append((
                            name.rpartition("/")[2], _number(r.fields.get("page-id")), r.fields.get("warc-target-uri"), r.kind or None, r.size, r.digest,
                            _number(r.fields.get("refers-to-page-id")), r.problem, r.payload,
                        )[: len(names)])
                        size += len(r.payload) * payloads + 200
                        if size > READ:
                            yield _batch(held, arrow, names)
                            held, size = [], 0
                if held:
                    yield _batch(held, arrow, names)

    return files.repartition(parts(spark)).mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], names=names)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact of every page, from archives written for it.

    A null html is an empty payload. Rows with one page_id and one payload are
    a response and revisits of it, which refer to that same id; null ids come
    last and refer to nothing that has a number. Other columns play no part; an
    empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    found = read(spark, folder) if _any(spark, folder) else spark.createDataFrame([], READS)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("problem").isNull().alias("intact"))


def _any(spark: SparkSession, folder: str) -> bool:
    fs, path = opened(folder)
    from pyarrow.fs import FileSelector

    return any(f.base_name.endswith(SUFFIX) for f in fs.get_file_info(FileSelector(path, allow_not_found=True)))
