"""Token ids in files compressed by a grammar of repeated pairs (Re-Pair).

Ids are cut into shards of whole documents in ascending doc_id order. In each
shard the pairs that repeat most are replaced by new symbols, again and again,
until none repeats enough. A shard keeps its rules, the length every symbol
stands for, the last sequence, and the documents' lengths: with them any
document is read without unfolding the rest. Shards are rows of a Parquet table,
so a write commits as a whole and any Spark reader can open it.

Columns of a shard: part and shard (its place), docs and size (documents, ids),
start (ids before it), letters (the ids used, ascending, u4), rules (pairs of
symbols, u4), spans (ids each rule stands for, u4), sequence (symbols, u4),
has_id (u1), doc_ids (i8) and lengths (u4) of the documents; all little-endian,
all but the first six deflated.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, per_worker, stored

#: The id appended to each document; ids of a shard; a pair is replaced if it repeats this often; pairs replaced at a time.
END, SHARD_IDS, REPEATS, AT_ONCE = 1, 1_000_000, 16, 4096
#: Bytes of text whose distinct words are looked up together.
TOGETHER = 8 << 20

SHARDS = (
    "part int, shard int, docs bigint, size bigint, letters binary, rules binary, spans binary, sequence binary, "
    "has_id binary, doc_ids binary, lengths binary"
)


def _mark(pairs: np.ndarray) -> np.ndarray:
    return ((pairs >> np.uint64(32)) * np.uint64(40503) + pairs) & np.uint64(0xFFFF)


def _ranked(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, all below ``bound``, ascending, and the rank of each."""
    seen = np.zeros(bound, bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.uint32)[values]


def compress(ids: np.ndarray, repeats: int = REPEATS, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, rules, spans, sequence): symbol k below len(letters) is that id, the rest are rules in order.

    A round counts all pairs of neighbours and replaces the most frequent ones
    together; where two chosen pairs overlap, the left one wins along the run.
    Rounds go on while a pair repeats ``repeats`` times and the last round took
    a hundredth off the sequence.
    """
    letters, sequence = _ranked(ids, int(ids.max(initial=0)) + 1)
    rules: list[np.ndarray] = []
    spans = np.ones(len(letters), np.int64)
    total, before = len(letters), np.inf
    while 1 < len(sequence) < 0.99 * before:
        before = len(sequence)
        pairs = (sequence[:-1].astype(np.uint64) << np.uint64(32)) | sequence[1:]
        ordered = np.sort(pairs)
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(counts >= repeats)
        if not len(often):
            break
        if len(often) > at_once:  # the most frequent; ties go to the smaller pair
            often = often[np.argsort(-counts[often], kind="stable")[:at_once]]
        chosen = np.sort(ordered[first[often]])
        # A small table names a chosen pair for each mark; only pairs that share a mark with another are searched for.
        marks = np.full(1 << 16, -1, np.int32)
        marks[_mark(chosen)] = np.arange(len(chosen))
        at = marks[_mark(pairs)]
        place = np.flatnonzero(at >= 0)
        at, found = at[place], pairs[place]
        other = np.flatnonzero(chosen[at] != found)
        at[other] = np.minimum(np.searchsorted(chosen, found[other]), len(chosen) - 1)
        hit = chosen[at] == found
        place, at = place[hit], at[hit]
        # In a run of overlapping hits every other one counts, from the first.
        fresh = np.concatenate(([True], np.diff(place) > 1))
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
        turn = (np.arange(len(place)) - run) % 2 == 0
        place = place[turn]
        used, named = _ranked(at[turn], len(chosen))
        sequence[place] = total + named
        keep = np.ones(len(sequence), bool)
        keep[place + 1] = False
        sequence = sequence[keep]
        new = np.stack(((chosen[used] >> np.uint64(32)), chosen[used] & np.uint64(0xFFFFFFFF)), 1).astype(np.int64)
        rules.append(new)
        spans = np.concatenate((spans, spans[new[:, 0]] + spans[new[:, 1]]))
        total += len(new)
    flat = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return letters.astype(np.uint32), flat.astype(np.uint32), spans[len(letters) :].astype(np.uint32), sequence


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Shard:
    """A stored shard, opened for reading."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(zlib.decompress(row[name]), kind)
        self.letters, self.rules = read("letters", "<u4"), read("rules", "<u4").reshape(-1, 2).astype(np.int64)
        self.sequence = read("sequence", "<u4").astype(np.int64)
        self.spans = np.concatenate((np.ones(len(self.letters), np.int64), read("spans", "<u4").astype(np.int64)))
        self.ends = np.cumsum(self.spans[self.sequence])
        self.has, self.doc_ids, self.lengths = read("has_id", "u1").astype(bool), read("doc_ids", "<i8"), read("lengths", "<u4").astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def whole(self) -> np.ndarray:
        """All ids: every rule is unfolded once, and what the sequence names is copied."""
        flat = np.concatenate((self.letters, self.unfold(np.arange(len(self.letters), len(self.spans)))))
        starts = np.cumsum(self.spans) - self.spans
        return flat[_spread(starts[self.sequence], self.spans[self.sequence])]

    def unfold(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for: the newest rules first, until only letters are left."""
        while len(symbols) and symbols.max() >= len(self.letters):
            rule = symbols >= len(self.letters)
            at = np.cumsum(1 + rule) - (1 + rule)
            out = np.empty(len(symbols) + int(rule.sum()), np.int64)
            out[at[~rule]] = symbols[~rule]
            two = self.rules[symbols[rule] - len(self.letters)]
            out[at[rule]], out[at[rule] + 1] = two[:, 0], two[:, 1]
            symbols = out
        return self.letters[symbols]

    def document(self, k: int) -> np.ndarray:
        """The ids of one document: only the symbols that cover it are unfolded."""
        a, b = int(self.starts[k]), int(self.starts[k] + self.lengths[k])
        first, last = np.searchsorted(self.ends, a, "right"), np.searchsorted(self.ends, b - 1, "right")
        before = int(self.ends[first] - self.spans[self.sequence[first]]) if b > a else 0
        return self.unfold(self.sequence[first : last + 1])[a - before : b - before] if b > a else self.letters[:0]


class ByteLevel(dict):
    """Characters as the vocabulary writes them: a letter for each byte of UTF-8."""

    def __init__(self):
        kept = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))  # bytes that stand for themselves
        self.moved = {b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in kept)}

    def __missing__(self, c: int) -> str:
        self[c] = chr(c) if c < 0x80 else "".join(chr(self.moved.get(b, b)) for b in chr(c).encode())
        return self[c]


class Words(dict):
    """Places of pieces in a store of ids; the ids are the tokenizers library's, remembered up to a number of pieces and characters.

    The vocabulary's normaliser and piece pattern never join across ASCII white
    space, and drop it, so the ids of a text are those of its stretches in a row.
    The distinct stretches of many texts are looked at together: those of plain
    characters (neither they nor their lower case ever join a neighbour) are cut
    into pieces here and each new piece goes to the library's model; any other
    is one piece and goes through the library as it is.
    """

    MOST, MOST_CHARACTERS = 800_000, 32_000_000
    # Plain letters beyond ASCII (Latin, Cyrillic) and marks, and the vocabulary's piece pattern over them.
    LETTERS = "\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f\u0400-\u045f"
    MARKS = "\xab\xbb\u2010-\u2027"
    PIECE = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^\sa-z0-9{LETTERS}]+")
    ODD = re.compile(rf"[^!-~{LETTERS}{MARKS}\n]|<\|")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.byte_level = ByteLevel()
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self["\n"] = 0
        self.fresh: list[str] = []
        self.characters = 0
        self.flat, self.sizes, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        self[piece] = place = len(self)
        return place

    def _learn(self) -> None:
        """Ids of the pieces met since the last time, at the end of the store."""
        joined = "\n".join(self.fresh)
        self.characters += len(joined)
        if self.ODD.search(joined):
            lists = [
                self.library.encode(piece, add_special_tokens=False).ids if self.ODD.search(piece) else self._modelled(piece.translate(self.byte_level))
                for piece in self.fresh
            ]
        else:
            lists = list(map(self._modelled, joined.translate(self.byte_level).split("\n")))
        self.fresh = []
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _modelled(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def _places(self, stretches: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pieces of stretches, each ended by a line feed, and where each stretch's pieces begin, the end included."""
        if self.ODD.search(stretches):
            pieces: list[str] = []
            for stretch in stretches.split("\n")[:-1]:
                pieces += [stretch] if self.ODD.search(stretch) else self.PIECE.findall(stretch.lower())
                pieces.append("\n")
        else:
            pieces = self.PIECE.findall(stretches.lower())
        place = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        ends = np.flatnonzero(place == 0)
        return place[place > 0], np.concatenate(([0], ends - np.arange(len(ends))))

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text; null texts are empty."""
        if len(self) >= self.MOST or self.characters >= self.MOST_CHARACTERS:
            self._reset()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), "\n")[0].as_py()
        place, cut = self._places(joined + "\n" if len(distinct) else "")
        if self.fresh:
            self._learn()
        # The ids of each distinct stretch in a row, then those of every stretch.
        own = _spread(self.starts[place], self.sizes[place])
        ids = self.flat[own]
        at = np.concatenate(([0], np.cumsum(self.sizes[place])))[cut]
        which = coded.indices.to_numpy()
        sizes = np.diff(at)[which]
        flat = ids[_spread(at[which], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return np.split(flat, ends[1:-1]) if len(texts) else []

    def ids(self, text: str | None) -> np.ndarray:
        return self.batch(pa.array([text], pa.string()))[0]


def _slices(texts: pa.Array, most: int):
    """Runs of texts of about ``most`` bytes in all, a text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, texts.slice(a, b - a)
        a = b


def write(docs: DataFrame, path: str, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode whole texts, append ``end`` to each, and store the shards; the stored table is returned.

    Rows are range-partitioned by doc_id before they are encoded, so ids are
    shuffled never and texts once. Null texts are empty; null ids come first.
    Rows that share an id keep the order of their text's hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(parts(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def pack(part: int, shard: int, ids: list, held: list[np.ndarray]) -> dict:
        flat = np.concatenate(held)
        letters, rules, spans, sequence = compress(flat)
        pressed = lambda a, kind: zlib.compress(np.ascontiguousarray(a, kind).tobytes(), 1)
        return {
            "part": part, "shard": shard, "docs": len(ids), "size": len(flat), "letters": pressed(letters, "<u4"), "rules": pressed(rules, "<u4"),
            "spans": pressed(spans, "<u4"), "sequence": pressed(sequence, "<u4"), "has_id": pressed([i is not None for i in ids], "u1"),
            "doc_ids": pressed([i or 0 for i in ids], "<i8"), "lengths": pressed([len(h) for h in held], "<u4"),
        }

    def run(batches):
        words = per_worker(("words", path), lambda: Words(path))
        part, shard, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("docs", pa.int64()), ("size", pa.int64())] + [(c, pa.binary()) for c in (
            "letters", "rules", "spans", "sequence", "has_id", "doc_ids", "lengths")])
        tail = np.array([end], np.uint32)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, texts in _slices(batch.column(1), TOGETHER):
                for doc_id, found in zip(doc_ids[a : a + len(texts)], words.batch(texts), strict=True):
                    ids.append(doc_id)
                    held.append(np.concatenate((found, tail)))
                    size += len(held[-1])
                    if size >= shard_ids:
                        yield pa.RecordBatch.from_pylist([pack(part, shard, ids, held)], schema)
                        shard, ids, held, size = shard + 1, [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([pack(part, shard, ids, held)], schema)

    made = stored(ordered.mapInArrow(run, SHARDS), "ids")
    # Ids before each shard: first per part, then within it; both windows are over shards, not documents.
    sizes = made.groupBy("part").agg(F.sum("size").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("part").orderBy("shard")) - F.col("size")
    place = made.select("part", "shard", inside.alias("inside")).join(before, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("start"))
    return made.join(place, ["part", "shard"])


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document, read back from the stored shards."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                flat = s.whole().astype(np.int32)
                cut = pa.array(np.append(s.starts, len(flat)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, mask=~s.has), pa.array(s.starts + row["start"]), pa.ListArray.from_arrays(cut, pa.array(flat))],
                    names=["doc_id", "start", "ids"],
                )

    return shards.mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")


def listed(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored shards; ids stay in the task."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                flat = s.whole().astype("<u4").tobytes()
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(s.starts.tolist(), (s.starts + s.lengths).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, mask=~s.has), pa.array(s.starts + row["start"]), pa.array(s.lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
