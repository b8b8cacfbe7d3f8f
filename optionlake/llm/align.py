"""Alignment of two tokenizers on the same bytes, and how often their tokens end together.

Side A is a byte-level ``tokenizers`` file, which gets a space before the text;
side B a ``sentencepiece`` model, which adds that space itself. Both cut the same
bytes, so each side is an array of ascending end offsets. ``diagonal`` walks the
two arrays: while tokens are one to one, entries agree at a constant shift
between the indexes, and runs of that are jumped by comparing slices of doubling
length; where they stop agreeing, the irregular group is resolved token by token
and the walk goes on at the shift it ends with.

A and B tokens that end together are linked. The bytes of the one are then a
suffix of the bytes of the other, so the vocabularies alone bound how many
different id pairs can ever be linked (about 324,000 for the two given files);
counts over the whole corpus are a table of that size at most, however many
documents there are.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import per_worker, stored

#: Characters of text handled at a time; longest word remembered, in characters, and words remembered per worker.
BATCH, SHORT, REMEMBERED = 1 << 20, 48, 400_000
#: A single space between two characters that are not white space: no token of either side lies across.
_GAP = re.compile(r"(?<=\S) (?=\S)")

PARTS = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "links binary, pairs binary, counts binary"
)
_ARROW = pa.schema([
    *[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
    ("links", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary()),
])


def diagonal(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int]]:
    """Where both sides end, as runs (i, j, n): ``ends_a[i + t] == ends_b[j + t]`` for t below n.

    Both lists ascend strictly and have the same last entry (or are empty).
    """
    runs, i, j, n, m = [], 0, 0, len(ends_a), len(ends_b)
    while i < n and j < m:
        a, b = ends_a[i], ends_b[j]
        while a != b:  # an irregular group: the side that is behind takes its next token
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
        length, step, left = 1, 1, min(n - i, m - j)
        while length < left:
            step = min(step, left - length)
            if ends_a[i + length : i + length + step] != ends_b[j + length : j + length + step]:
                break
            length += step
            step *= 2
        else:
            step = 1
        while step > 1:  # the run ends within the last step: halve it down to the place
            step = (step + 1) // 2
            if ends_a[i + length : i + length + step] == ends_b[j + length : j + length + step]:
                length += step
        # Halving rounds up, so up to a few tokens of the run may be left; they are the next run, at the same shift.
        runs.append((i, j, length))
        i += length
        j += length
    return runs


def cuts(runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the last A token and of the last B token of every group."""
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, n = np.array(runs, np.int64).T
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(i, n) + within, np.repeat(j, n) + within


class Pair:
    """Both tokenizers, their tokens' bytes, and the text forms of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        size = max(vocab.values()) + 1
        self.bytes_a = [b""] * size
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("side B has tokens across words")
        self.length_a, self.length_b = (np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.size_a, self.size_b = len(self.bytes_a), len(self.bytes_b)
        forms = ((self.size_a, ","), (self.size_a, "|"), (self.size_b, ","), (self.size_b, ";"))
        self.decimal = np.array([f"{i}{end}".encode() for size, end in forms for i in range(size)])
        #: Ids (u4) of both sides by word; None where a side does not give the bytes back.
        self.known_a: dict[str, bytes | None] = {}
        self.known_b: dict[str, bytes | None] = {}

    def _learn(self, words: list[str]) -> None:
        """Encode words not known yet: side A as one text, cut again at the words' lengths."""
        data = (" " + " ".join(words)).encode()
        a = self.a.encode(data.decode(), add_special_tokens=False).ids
        b = self.b.encode(words, num_threads=1)
        flat = [*chain.from_iterable(b)]
        if b"".join(map(self.bytes_a.__getitem__, a)) == data == b"".join(map(self.bytes_b.__getitem__, flat)):
            a = np.array(a, np.int64)
            ends = np.cumsum([1 + len(w.encode()) for w in words])
            stops = np.searchsorted(np.cumsum(self.length_a[a]), ends) + 1
            self._keep(self.known_a, words, a, stops)
            self._keep(self.known_b, words, np.array(flat, np.int64), np.cumsum([*map(len, b)]))
            return
        for word, right in zip(words, b, strict=True):  # some word is not given back
            data = (" " + word).encode()
            left = self.a.encode(" " + word, add_special_tokens=False).ids
            same = b"".join(map(self.bytes_a.__getitem__, left)) == data == b"".join(map(self.bytes_b.__getitem__, right))
            self.known_a[word] = np.array(left, "<u4").tobytes() if same else None
            self.known_b[word] = np.array(right, "<u4").tobytes() if same else None

    @staticmethod
    def _keep(known: dict[str, bytes | None], words: list[str], ids: np.ndarray, stops: np.ndarray) -> None:
        packed, start = ids.astype("<u4").tobytes(), 0
        for word, stop in zip(words, (4 * stops).tolist(), strict=True):
            known[word] = packed[start:stop]
            start = stop

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides for every text; a text whose bytes are not given back by both has none."""
        split = [_GAP.split(t) if t else [] for t in texts]
        if len(self.known_a) > REMEMBERED:
            self.known_a.clear(), self.known_b.clear()
        fresh = [w for w in {w: None for words in split for w in words} if w not in self.known_a]
        if fresh:
            self._learn(fresh)
        out, none = [], np.zeros(0, np.int64)
        for words in split:
            a, b = ([*map(known.__getitem__, words)] for known in (self.known_a, self.known_b))
            if None in a:
                out.append((none, none))
            else:
                out.append(tuple(np.frombuffer(b"".join(side), "<u4").astype(np.int64) for side in (a, b)))
        for word in fresh:
            if len(word) > SHORT:
                del self.known_a[word], self.known_b[word]
        return out

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return cuts(diagonal(np.cumsum(self.length_a[a]).tolist(), np.cumsum(self.length_b[b]).tolist()))

    def written(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the groups, A ids before B ids."""
        closes_a, closes_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        closes_a[last_a], closes_b[last_b] = 1, 1
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        form = np.empty(len(a) + len(b), np.int64)
        form[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = a + self.size_a * closes_a
        form[np.arange(len(b)) + last_a[group_b] + 1] = 2 * self.size_a + b + self.size_b * closes_b
        return self.decimal[form].tobytes().replace(b"\0", b"")[:-1]


def pair_of(path_a: str, path_b: str) -> Pair:
    return per_worker(("align", path_a, path_b), lambda: Pair(path_a, path_b))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    pairs, counts = (np.concatenate(side) for side in zip(*held, strict=True))
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    return [(pairs[first], np.add.reduceat(counts, first))] if len(pairs) else [(pairs, counts)]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every document aligned, and a last row of each task with its pair counts; stored in the shared folder.

    ``links`` holds a document's pairs (A id times B's size plus B id, u4,
    ascending, one per link). Only bytes of one document batch and one table of
    pairs are in a task's memory.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        both = pair_of(path_a, path_b)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids, texts, size = [], [], 0
            for k in range(batch.num_rows):
                ids.append(batch.column(0)[k].as_py())
                texts.append(batch.column(1)[k].as_py())
                size += len(texts[-1])
                if size >= BATCH or k + 1 == batch.num_rows:
                    columns, counted = _rows(both, ids, texts)
                    yield columns
                    held.append(counted)
                    if sum(len(p) for p, _ in held) > 1 << 20:
                        held = _merged(held)
                    ids, texts, size = [], [], 0
        if held:
            (pairs, counts), = _merged(held)
            yield pa.RecordBatch.from_pylist([{"pairs": pairs.astype("<u4").tobytes(), "counts": counts.astype("<i8").tobytes()}], _ARROW)

    return stored(rows.mapInArrow(run, PARTS), "align")


def _rows(both: Pair, ids: list, texts: list[str]):
    out, every = [], []
    for doc_id, (a, b) in zip(ids, both.encode(texts), strict=True):
        last_a, last_b = both.align(a, b)
        links = np.sort((a[last_a] * both.size_b + b[last_b]).astype("<u4"))
        every.append(links)
        digest = hashlib.sha256(both.written(a, b, last_a, last_b)).hexdigest() if len(a) else ""
        out.append((doc_id, len(a), len(b), len(last_a), len(links), digest, links.tobytes(), None, None))
    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW), np.unique(np.concatenate(every), return_counts=True)


def pair_counts(parts: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): links of every id pair over the whole corpus, and the most that its B id has with any A id."""

    def run(batches):
        for batch in batches:
            for pairs, counts in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(pairs.as_py(), "<u4").astype(np.int64)), pa.array(np.frombuffer(counts.as_py(), "<i8"))],
                    names=["pair", "n"],
                )

    every = parts.where("pairs is not null").select("pairs", "counts").mapInArrow(run, "pair bigint, n bigint")
    summed = every.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % size_b)
    best = summed.groupBy("b").agg(F.max("n").alias("best"))
    return summed.join(best, "b").select("pair", "n", "best")


def compare(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    Null and empty texts, and those whose bytes one of the sides does not give
    back, have zeros and an empty digest. A null or repeated doc_id is carried;
    repeated rows count each. Extra columns play no part. An empty table gives
    an empty result.

    The counts sent to the tasks are one row per id pair that can be linked at
    all, so their size is bounded by the two vocabularies.
    """
    spark = docs.sparkSession
    parts = aligned(docs, path_a, path_b)
    size_b = vocabulary_size(path_b)
    found = pair_counts(parts, size_b).toArrow().sort_by("pair")
    pairs, n, best = (found.column(c).to_numpy() for c in ("pair", "n", "best"))
    counts = spark.sparkContext.broadcast((pairs.astype(np.uint32), n, n == best))

    def run(batches):
        known, n, top = counts.value
        for batch in batches:
            sums = []
            for links in batch.column("links"):
                at = np.searchsorted(known, np.frombuffer(links.as_buffer(), "<u4"))
                sums.append((int(top[at].sum()), int(n[at].sum())))
            tops, total = zip(*sums, strict=True) if sums else ((), ())
            keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, keep), pa.array(tops, pa.int64()), pa.array(total, pa.int64()), batch.column("groups_sha256")],
                names=[*keep, "n_best", "count_sum", "groups_sha256"],
            )

    return parts.where("links is not null").drop("pairs", "counts").mapInArrow(
        run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    )


def vocabulary_size(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
