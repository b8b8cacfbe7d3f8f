"""Benchmark decontamination over a positional inverted index of the training text.

``build`` cuts the documents into blocks and stores, for each, the distinct
terms, where each term stands (ascending positions, as gaps) and the documents
with their places. ``search`` takes the benchmark in groups of bounded size,
orders the terms of each window by their count in the whole corpus, and in every
block takes the places of the rarest term, moved by its offset, and keeps those
at which the next rarer terms stand too. The index is partitioned by document,
so a phrase never crosses blocks and nothing but hits leaves a block.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, stored, text_digest

#: Words of a window; words of a block of the index; words of the benchmark taken at a time.
WINDOW, BLOCK_WORDS, ITEM_WORDS = 10, 1_000_000, 500_000
#: Words by which a term of a near window may stand off its place; words from which a near window may lack one; candidates taken at a time.
SLACK, LACKING, CANDIDATES = 2, 5, 2_000_000

INDEX = (
    "block bigint, n_rows int, terms binary, counts binary, gaps binary, has_id binary, doc_ids binary, digests binary, starts binary, lengths binary"
)
FOUND = (
    "block bigint, row int, doc_id bigint, digest bigint, n_words bigint, spans array<struct<a:int,b:int>>, items array<bigint>, near array<bigint>"
)


def _pack(array, kind) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


def build(docs: DataFrame, block_words: int = BLOCK_WORDS, gap: int = WINDOW + SLACK + 1) -> DataFrame:
    """The index of doc_id and text, a row per block; a block takes whole documents until it has ``block_words`` words.

    A null text has no words, a null doc_id is kept, repeated rows are indexed
    each for itself. Documents lie ``gap`` positions apart, so no window spans two.
    """

    def flush(block: int, ids: list, digests: list[int], texts: list[list[bytes]]):
        names: dict[bytes, int] = {}
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate(([0], np.cumsum(lengths + gap)[:-1])).astype(np.int64)
        total = int(lengths.sum())
        seen = names.setdefault
        coded = np.fromiter((seen(w, len(names)) for w in chain.from_iterable(texts)), np.int32, total)
        order = sorted(names)  # terms in order, so that a search finds them by bisection
        rank = np.empty(len(names), np.int32)
        rank[np.fromiter((names[w] for w in order), np.int64, len(order))] = np.arange(len(order), dtype=np.int32)
        coded = rank[coded]
        shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        keys = np.sort((coded.astype(np.int64) << 36) | (np.arange(total) + shift))
        places = keys & ((1 << 36) - 1)
        gaps = np.diff(places, prepend=0)
        first = np.flatnonzero(np.diff(keys >> 36, prepend=-1))
        gaps[first] = places[first]
        counts = np.bincount(coded, minlength=len(order))
        return (
            block, len(texts), b" ".join(order), _pack(counts, "<i4"), _pack(gaps, "<i4"), _pack([i is not None for i in ids], "u1"),
            _pack([i or 0 for i in ids], "<i8"), _pack(digests, "<i8"), _pack(starts, "<i8"), _pack(lengths, "<i4"),
        )

    def run(batches):
        schema = pa.schema(
            [("block", pa.int64()), ("n_rows", pa.int32())]
            + [(c, pa.binary()) for c in ("terms", "counts", "gaps", "has_id", "doc_ids", "digests", "starts", "lengths")]
        )
        at, ids, digests, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            for doc_id, text, digest in zip(*batch.columns, strict=True):
                words = alnum_words(text.as_py())
                ids.append(doc_id.as_py())
                digests.append(digest.as_py())
                texts.append(words)
                size += len(words) + gap
                if size >= block_words:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, flush(at, ids, digests, texts), strict=True))], schema)
                    at, ids, digests, texts, size = at + 1, [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, flush(at, ids, digests, texts), strict=True))], schema)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), text_digest(text).alias("digest")).mapInArrow(run, INDEX)


class Block:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.id, self.counts = row["block"], read("counts", "<i4").astype(np.int64)
        self.terms = row["terms"].split(b" ") if row["terms"] else []
        self.starts, self.lengths, self.ids, self.has, self.digests = (
            read("starts", "<i8"), read("lengths", "<i4").astype(np.int64), read("doc_ids", "<i8"), read("has_id", "u1").astype(bool), read("digests", "<i8")
        )
        gaps = read("gaps", "<i4").astype(np.int64)
        self.ends = np.cumsum(self.counts)
        firsts = self.ends - self.counts
        run = np.cumsum(gaps)
        before = np.where(firsts > 0, run[np.maximum(firsts, 1) - 1], 0) if len(firsts) else run[:0]
        self.places = run - np.repeat(before, self.counts)
        #: Term and place in one number, ascending: all postings of the block in one searchable array.
        self.keys = (np.repeat(np.arange(len(self.terms), dtype=np.int64), self.counts) << 36) | self.places

    def has_near(self, term: np.ndarray, place: np.ndarray, slack: int) -> np.ndarray:
        """Whether the term stands within ``slack`` of the place."""
        low = (term << 36) | np.maximum(place - slack, 0)
        at = np.searchsorted(self.keys, low)
        inside = at < len(self.keys)
        at = np.minimum(at, max(len(self.keys) - 1, 0))
        return inside & (self.keys[at] <= ((term << 36) | (place + slack))) & (place + slack >= 0) if len(self.keys) else inside


def windows_of(items: Iterable[tuple[int, str | None]], width: int = WINDOW) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, and per distinct (item, window): the item, its length and the term numbers padded with -1."""
    number: dict[bytes, int] = {}
    rows: dict[tuple, None] = {}
    for item, text in items:
        words = [number.setdefault(w, len(number)) for w in alnum_words(text)]
        n = min(width, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            rows[(item, *words[k : k + n], *[-1] * (width - n))] = None
    table = np.array([*rows], np.int64).reshape(len(rows), width + 1)
    return [*number], table[:, 0], (table[:, 1:] >= 0).sum(1), table[:, 1:]


def _matches(block: Block, local: np.ndarray, order: np.ndarray, lengths: np.ndarray, terms: np.ndarray):
    """(window, place of its first word) of all windows in the block: places of the rarest term, thinned term by term."""
    rows = np.arange(len(terms))
    there = np.where(terms >= 0, local[np.maximum(terms, 0)], 0) >= 0
    alive = np.flatnonzero(there.all(1) & (lengths > 0))
    rarest = order[alive, 0]
    anchor = local[terms[alive, rarest]]
    n = block.counts[anchor]
    window = np.repeat(rows[alive], n)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place = block.places[np.repeat(block.ends[anchor] - n, n) + inner] - np.repeat(rarest, n)
    keep = place >= 0
    window, place = window[keep], place[keep]
    for k in range(1, terms.shape[1]):
        due = lengths[window] > k
        column = order[window, k]
        term = local[np.maximum(terms[window, column], 0)]
        keep = ~due | block.has_near(np.where(due, term, 0), place + column, 0)
        window, place = window[keep], place[keep]
    return window, place


def _near(block: Block, local: np.ndarray, order: np.ndarray, lengths: np.ndarray, terms: np.ndarray, slack: int):
    """(window, place of its anchor) of near windows: for some place of the window, every term stands within ``slack`` of its own.

    A window of LACKING words or more may lack one. One of its two rarest terms
    then is there, so both are anchors, at every shift the slack allows.
    """
    here = np.where(terms >= 0, local[np.maximum(terms, 0)], -1)
    spare = (lengths >= LACKING).astype(np.int64)
    fits = ((terms >= 0) & (here < 0)).sum(1) <= spare
    shifts = np.arange(-slack, slack + 1)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a in range(min(2, terms.shape[1])):
        anchor = here[np.arange(len(terms)), order[:, a]]
        alive = np.flatnonzero(fits & (lengths > a) & (spare >= a) & (anchor >= 0))
        n = block.counts[anchor[alive]]
        cuts = np.flatnonzero(np.diff(np.cumsum(n * len(shifts)) // CANDIDATES)) + 1
        for rows in np.split(alive, cuts):
            n = block.counts[anchor[rows]]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            spot = np.repeat(block.places[np.repeat(block.ends[anchor[rows]] - n, n) + inner], len(shifts))
            window = np.repeat(rows, n * len(shifts))
            place = spot - order[window, a] + np.tile(shifts, int(n.sum()))
            lacks = np.zeros(len(window), np.int64)
            for k in range(terms.shape[1]):
                if k == a:
                    continue
                column = order[window, k]
                term = here[window, column]
                held = (lengths[window] <= k) | ((term >= 0) & block.has_near(np.maximum(term, 0), place + column, slack))
                lacks = lacks + ~held
                keep = lacks <= spare[window]
                window, place, spot, lacks = window[keep], place[keep], spot[keep], lacks[keep]
            found.append((window, spot))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def term_counts(index: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """Count in the whole corpus of each given term (a bounded set)."""

    def run(batches):
        for batch in batches:
            found: dict[bytes, int] = {}
            for names, counts in zip(batch.column(0), batch.column(1), strict=True):
                n = np.frombuffer(counts.as_py(), "<i4")
                for k, name in enumerate(names.as_py().split(b" ")):
                    if name in terms:
                        found[name] = found.get(name, 0) + int(n[k])
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.binary()), pa.array([*found.values()], pa.int64())], names=["term", "n"])

    counted = index.select("terms", "counts").mapInArrow(run, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r.term): r.n for r in counted.collect()}


def _search(index: DataFrame, items: list[tuple[int | None, str]], slack: int | None) -> DataFrame:
    """Hits of a bounded group of items in every block; a row per document."""
    number = {i: k for k, i in enumerate(dict.fromkeys(i for i, _ in items))}
    ids = [*number]
    terms, item, lengths, words = windows_of((number[i], text) for i, text in items)
    counts = term_counts(index, set(terms))
    total = np.array([counts.get(t, 0) for t in terms] or [0], np.int64)
    rarity = np.where(words >= 0, total[np.maximum(words, 0)], 1 << 60)
    order = np.argsort(rarity, axis=1, kind="stable") if len(words) else np.zeros((0, WINDOW), np.int64)

    def hits(block: Block):
        from bisect import bisect_left

        spots = [bisect_left(block.terms, t) for t in terms]
        local = np.array([k if k < len(block.terms) and block.terms[k] == t else -1 for t, k in zip(terms, spots, strict=True)] or [-1])
        window, place = _matches(block, local, order, lengths, words)
        row = np.searchsorted(block.starts, place, "right") - 1
        inside = place - block.starts[row]
        keep = inside + lengths[window] <= block.lengths[row]
        near = np.zeros((0, 2), np.int64)
        if slack is not None:
            near_window, spot = _near(block, local, order, lengths, words, slack)
            near = np.unique(np.stack([np.searchsorted(block.starts, spot, "right") - 1, item[near_window]], 1), axis=0)
        return (row[keep], inside[keep], window[keep]), near

    def run(batches):
        for batch in batches:
            for record in batch.to_pylist():
                block = Block(record)
                (row, at, window), nearby = hits(block)
                spans: list[list] = [[] for _ in block.starts]
                order_by = np.lexsort((at, row))
                for r, a, b in zip(row[order_by].tolist(), at[order_by].tolist(), (at + lengths[window])[order_by].tolist(), strict=True):
                    if spans[r] and a <= spans[r][-1]["b"]:
                        spans[r][-1]["b"] = max(b, spans[r][-1]["b"])
                    else:
                        spans[r].append({"a": a, "b": b})
                found: list[list] = [[] for _ in block.starts]
                near: list[list] = [[] for _ in block.starts]
                for target, pairs in ((found, zip(row.tolist(), item[window].tolist(), strict=True)), (near, map(tuple, nearby.tolist()))):
                    for r, i in dict.fromkeys(pairs):
                        target[r].append(ids[i])
                n = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block.id] * n, pa.int64()), pa.array(range(n), pa.int32()),
                        pa.array([int(i) if h else None for i, h in zip(block.ids, block.has, strict=True)], pa.int64()), pa.array(block.digests), pa.array(block.lengths, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                        pa.array(found, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64())),
                    ],
                    names=["block", "row", "doc_id", "digest", "n_words", "spans", "items", "near"],
                )

    return index.mapInArrow(run, FOUND)


def search(index: DataFrame, benchmark: DataFrame, slack: int | None = None, item_words: int = ITEM_WORDS) -> DataFrame:
    """Of a stored index, a row per document: n_words, the word spans inside exact windows, items with an exact and with a near window.

    The benchmark goes to the blocks in groups of about ``item_words`` words, so
    what a task holds is bounded however long it is; each group is another pass
    over the index, and spans are joined afterwards. A null text has no windows,
    a null item_id is an id like any other. ``near``, the items of which the
    terms of a window stand within ``slack`` words of their place (a window of
    LACKING words may lack one), is empty unless a slack is given (SLACK is a
    good one).
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    groups = int(words // item_words) + 1
    dealt = items.withColumn("group", F.pmod(F.hash("item_id", "text"), F.lit(groups)))
    found = None
    for k in range(groups):
        part = _search(index, [(r.item_id, r.text) for r in dealt.where(F.col("group") == k).collect()], slack)
        found = part if found is None else found.unionAll(part)
    if groups == 1:
        return found
    joined = lambda c: F.flatten(F.collect_list(c))  # noqa: E731  a list per group
    return found.groupBy("block", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("n_words").alias("n_words"),
        joined("spans").alias("spans"), *[F.array_distinct(joined(c)).alias(c) for c in ("items", "near")],
    )


def mark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contamination of every document: n_words, n_hit, n_items, items_sha256, contaminated.

    Items without an id count, as one, but are not in the digest of the ids.
    """
    index = stored(build(docs), "postings")
    found = search(index, benchmark)
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")
        ),
    )["n"]
    return found.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def mark_near(docs: DataFrame, benchmark: DataFrame, slack: int = SLACK) -> DataFrame:
    """Near matches of every document, exact ones among them: doc_id, n_near, near_items (ascending ids, without the null one n_near counts)."""
    found = search(stored(build(docs, gap=WINDOW + slack + 1), "postings"), benchmark, slack)
    return found.select("doc_id", F.size("near").cast("bigint").alias("n_near"), F.array_sort(F.array_compact("near")).alias("near_items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an exact window of a benchmark item, all columns kept.

    A row goes by its own text: others that share its doc_id, or have none either, stay.
    """
    index = stored(build(docs), "postings")
    bad = search(index, benchmark).where(F.size("spans") > 0).select(F.col("doc_id").alias("_bad"), F.col("digest").alias("_bad_digest")).distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(bad["_bad"]) & (text_digest(docs["text"].cast("string")) == bad["_bad_digest"])
    return docs.join(bad, same, "left_anti")
