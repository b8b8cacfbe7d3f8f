"""N-gram Jaccard join: prefix-tree search within groups that frequency-ordered prefixes bring together.

A document is the set of its distinct five-word shingles; equal sets form one
class. Two classes link at a Jaccard similarity of 0.8 or more. Work in steps:

1. ``blocks``: one pass over the texts. Of each class keep the set size and its
   head, the shingles of least hash; linked classes share a known number of head
   shingles, whatever the rest.
2. ``repeated``: a class that several blocks have counts in the first of them.
3. ``shared``: how many classes hold each head shingle, counted per block first,
   so that a shingle of every document costs one entry per block.
4. ``routes``: classes with too few shared head shingles drop out. The head in
   order of that count gives the prefix in which linked classes must meet;
   classes that meet are put into one group, by components of the meetings.
5. ``meetings``: chance meetings chain classes that have nothing else in common
   into one group that grows faster than the corpus. In a group of over
   GROUP_MEMBERS classes or GROUP_SHINGLES shingles only those count that share as
   many shingles of a longer prefix as linked classes must, and whose sketches do
   not show too many differences; it falls into the components of these.
6. ``search``: each group stores its sets, globally ordered, in a prefix tree and
   walks it for each set still open, adding up overlaps along shared paths and
   leaving a subtree once what remains cannot reach the needed overlap. A group
   still over GROUP_SHINGLES is dealt into parts and every two parts are searched together.
7. Components of the links found, by ``components``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, spaced_words, stored, text_digest
from .components import components

#: Words of a shingle; head shingles of a block, of a counting bucket, shingles of a searched part, classes of a group that needs no second look.
WIDTH, BLOCK, BUCKET, GROUP_SHINGLES, GROUP_MEMBERS = 5, 400_000, 2_000_000, 3_000_000, 2_000
#: Shingles that classes of a large group must share, if they need as many; classes up to which those of a shingle are taken two by two; bits of a sketch.
MEET, FEW, SKETCH = 8, 32, (64, 1024)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """64-bit hash of a word, remembered up to a number of words."""

    MOST = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_HASHES = WordHashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Ascending distinct 64-bit shingle hashes of a whole text; a text of fewer words is one shingle, none gives none."""
    words = spaced_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(WIDTH, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mix(total + h[k : len(h) - n + 1 + k] * _SEEDS[k])
    return np.unique(total)


def need(n: np.ndarray | int):
    """Least size of a set, and least overlap, that links with a set of n shingles: ceil(0.8 n)."""
    return -(-4 * n // 5)


def spare(n):
    """Head shingles kept beyond the bare prefix; grows with n."""
    return np.maximum(1, n // 10)


def head_size(n):
    return n - need(n) + spare(n)


def apart(x, y):
    """Most shingles that only one of two linked sets of x and y shingles has."""
    return x + y - 2 * -(-4 * (x + y) // 9)


def sketch_words(n):
    """64-bit words of the sketch of a set of n shingles: the least power of two of at least 2 n bits, within SKETCH."""
    return 1 << ((min(SKETCH[1], max(SKETCH[0], 2 * int(n))) - 1).bit_length() - 6)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each bit: two sketches differ in at most as many bits as their sets in shingles."""
    bits = 64 * sketch_words(len(s))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """The sketch of the same set in fewer words, a power of two."""
    return np.bitwise_xor.reduce(words.reshape(-1, width), axis=0)


def _blob(array, kind) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


def _joined(blobs, kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


BLOCKS = (
    "block bigint, shingles bigint, has binary, doc_ids binary, digests binary, sizes binary, classes binary, "
    "own binary, lengths binary, heads binary, sketches binary"
)


def blocks(docs: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """One row per run of documents: ids, set sizes and class digests of all, heads and sketches of the distinct classes (``own``: their rows)."""

    def pack(block, rows, heads):
        ids, sizes, classes, digests = zip(*rows, strict=True)
        own = sorted(heads.values(), key=lambda x: x[0])
        return {
            "block": block, "shingles": sum(len(h) for _, h, _ in own), "has": _blob([i is not None for i in ids], "u1"),
            "doc_ids": _blob([i or 0 for i in ids], "<i8"), "digests": _blob(digests, "<i8"), "sizes": _blob(sizes, "<i8"), "classes": b"".join(classes),
            "own": _blob([k for k, _, _ in own], "<i4"), "lengths": _blob([len(h) for _, h, _ in own], "<i4"),
            "heads": _blob(np.concatenate([h for _, h, _ in own]) if own else [], "<u8"), "sketches": b"".join(w for _, _, w in own),
        }

    def run(batches):
        fields = [("block", pa.int64()), ("shingles", pa.int64())]
        schema = pa.schema(fields + [(c, pa.binary()) for c in ("has", "doc_ids", "digests", "sizes", "classes", "own", "lengths", "heads", "sketches")])
        at, rows, heads, size = TaskContext.get().partitionId() << 32, [], {}, 0
        for batch in batches:
            for doc_id, text, digest in zip(*batch.columns, strict=True):
                s = shingles(text.as_py())
                name = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if len(s) and name not in heads:
                    heads[name] = (len(rows), s[: int(head_size(len(s)))], sketch(s).tobytes())
                    size += len(heads[name][1])
                rows.append((doc_id.as_py(), len(s), name, digest.as_py()))
                if size >= block_size or len(rows) >= block_size:
                    yield pa.RecordBatch.from_pylist([pack(at, rows, heads)], schema)
                    at, rows, heads, size = at + 1, [], {}, 0
        if rows:
            yield pa.RecordBatch.from_pylist([pack(at, rows, heads)], schema)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), text_digest(text).alias("digest")).mapInArrow(run, BLOCKS)


def members(made: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class, digest (of the text) of every document."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                has, ids = np.frombuffer(r["has"], "u1"), np.frombuffer(r["doc_ids"], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=has == 0), pa.array(np.frombuffer(r["sizes"], "<i8")),
                        pa.array([r["classes"][k : k + 16] for k in range(0, len(r["classes"]), 16)], pa.binary()),
                        pa.array(np.frombuffer(r["digests"], "<i8")),
                    ],
                    names=["doc_id", "n_shingles", "class", "digest"],
                )

    return made.select("has", "doc_ids", "digests", "sizes", "classes").mapInArrow(run, "doc_id bigint, n_shingles bigint, class binary, digest bigint")


def _cut(key: np.ndarray, n: int):
    """(k, places of key k) for each key from 0 to n - 1 that occurs."""
    order = np.argsort(key, kind="stable")
    ends = np.cumsum(np.bincount(key.astype(np.int64), minlength=n))
    return [(k, order[a:b]) for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if b > a]


def repeated(made: DataFrame, buckets: int) -> DataFrame:
    """Per block, the places in ``own`` of classes that an earlier block has too: block, gone."""

    def send(batches):
        for batch in batches:
            for r in batch.to_pylist():
                own = np.frombuffer(r["own"], "<i4")
                names = np.frombuffer(r["classes"], "S16")[own]
                for k, at in _cut(names.view("<u8")[::2] % np.uint64(buckets), buckets):
                    yield pa.RecordBatch.from_pylist([{"bucket": k, "block": r["block"], "names": names[at].tobytes(), "places": _blob(at, "<i4")}], schema)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        names = _joined(group["names"], "S16")
        first = np.zeros(len(names), bool)
        first[np.unique(names, return_index=True)[1]] = True
        out, at = [], 0
        for block, places in zip(group["block"], group["places"], strict=True):
            places = np.frombuffer(places, "<i4")
            gone = places[~first[at : at + len(places)]]
            at += len(places)
            if len(gone):
                out.append((block, gone))
        return pd.DataFrame(out, columns=["block", "gone"])

    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("names", pa.binary()), ("places", pa.binary())])
    sent = made.select("block", "classes", "own").mapInArrow(send, "bucket int, block bigint, names binary, places binary")
    found = sent.groupBy("bucket").applyInPandas(answer, "block bigint, gone array<int>")
    return found.groupBy("block").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def _held(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: which of its classes count here, and the rows, head lengths and heads of those."""
    own, lengths, heads = np.frombuffer(r["own"], "<i4"), np.frombuffer(r["lengths"], "<i4"), np.frombuffer(r["heads"], "<u8")
    here = np.ones(len(own), bool)
    if r["gone"] is not None:
        here[np.asarray(r["gone"], np.int64)] = False
    return here, own[here], lengths[here], heads[np.repeat(here, lengths)]


def shared(made: DataFrame, buckets: int) -> DataFrame:
    """Per block, its head shingles that several classes hold, and how many do: block, hashes, counts. ``gone`` (see ``repeated``) does not count."""

    def count(batches):
        for batch in batches:
            for r in batch.to_pylist():
                tokens, n = np.unique(_held(r)[3], return_counts=True)
                cut = _cut((tokens >> np.uint64(20)) % np.uint64(buckets), buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, _ in cut], pa.int32()), pa.array([r["block"]] * len(cut), pa.int64()),
                        pa.array([_blob(tokens[at], "<u8") for _, at in cut], pa.binary()), pa.array([_blob(n[at], "<u4") for _, at in cut], pa.binary()),
                    ],
                    names=["bucket", "block", "hashes", "counts"],
                )

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        tokens = [np.frombuffer(x, "<u8") for x in group["hashes"]]
        names, where = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(where, np.concatenate([np.frombuffer(x, "<u4") for x in group["counts"]])).astype(np.int64)
        out, at = [], 0
        for block, own in zip(group["block"], tokens, strict=True):
            n = total[where[at : at + len(own)]]
            at += len(own)
            if (n > 1).any():
                out.append((block, _blob(own[n > 1], "<u8"), _blob(n[n > 1], "<u4")))
        return pd.DataFrame(out, columns=["block", "hashes", "counts"])

    sent = made.select("block", "own", "lengths", "heads", "gone").mapInArrow(count, "bucket int, block bigint, hashes binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(answer, "block bigint, hashes binary, counts binary")


class Forest:
    """Union-find over 0..n-1; the root is the least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def routes(made: DataFrame, known: DataFrame) -> DataFrame:
    """(class, n, root, token, prefix, counts, sketch): classes that may link; with a token, that the classes under this root meet there.

    ``prefix`` is for ``meetings``: as many shared shingles of the head, rarest
    first, as hold MEET of those that linked classes share, or all that they
    must; ``counts`` their classes, at most 255.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["class", "n", "root", "token", "prefix", "counts", "sketch"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=columns)
        r = left.iloc[0]
        tokens = np.concatenate([np.frombuffer(x, "<u8") for x in right["hashes"]])
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in right["counts"]])
        order = np.argsort(tokens)
        tokens, counts = tokens[order], counts[order]
        here, own, lengths, heads = _held(r)
        sizes = np.frombuffer(r["sizes"], "<i8")
        words = [sketch_words(n) for n in sizes[np.frombuffer(r["own"], "<i4")]]
        past = np.cumsum(words)
        sketches = [r["sketches"][8 * (a - w) : 8 * a] for a, w, k in zip(past.tolist(), words, here, strict=True) if k]
        at = np.minimum(np.searchsorted(tokens, heads), len(tokens) - 1)
        df = np.where(tokens[at] == heads, counts[at], 1).astype(np.int64)
        ends = np.cumsum(lengths)
        alive, kept = [], []
        for k, end in enumerate(ends):
            span = slice(end - lengths[k], end)
            n = int(sizes[own[k]])
            least = int(spare(need(n)))
            held = df[span] > 1
            if int(held.sum()) < least:
                continue
            order = np.lexsort((heads[span], df[span]))
            prefix, longer = order[: lengths[k] - least + 1], order[: lengths[k] - least + min(least, MEET)]
            prefix, longer = prefix[held[prefix]], longer[held[longer]]
            if len(prefix):
                more = _blob(heads[span][longer], "<u8"), _blob(np.minimum(df[span][longer], 255), "u1"), sketches[k]
                alive.append((r["classes"][16 * own[k] : 16 * own[k] + 16], n, more))
                kept.append(at[span][prefix])
        forest, first = Forest(len(alive)), {}
        for k, met in enumerate(kept):
            for t in met.tolist():
                forest.join(k, first.setdefault(t, k))
        out = [(c, n, alive[forest.find(k)][0], None, *more) for k, (c, n, more) in enumerate(alive)]
        signed = tokens.view(np.int64)
        out += [(None, 0, alive[forest.find(k)][0], int(signed[t]), None, None, None) for t, k in first.items()]
        frame = pd.DataFrame(out, columns=columns)
        frame["token"] = frame["token"].astype("Int64")
        return frame

    narrow = made.select("block", "sizes", "classes", "own", "lengths", "heads", "sketches", "gone")
    schema = "class binary, n bigint, root binary, token bigint, prefix binary, counts binary, sketch binary"
    return narrow.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(run, schema)


def _sums(a, b, lack, n):
    """Of (a, b, lack, n) each pair a, b once, with the sum of its n."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)])
    return a[start], b[start], lack[order][start], np.add.reduceat(n[order], start) if len(a) else n


def alike(codes: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that connect the classes whose sizes and sketches leave a link possible."""
    order = np.argsort(sizes, kind="stable")
    codes, sizes, words = codes[order], sizes[order], words[order]
    out, left = [], np.arange(len(codes))
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            n = int(sizes[x])
            a, b = np.searchsorted(sizes[left], [need(n), 5 * n // 4 + 1])
            near = left[a:b]
            met = np.bitwise_count(words[near] ^ words[x]).sum(axis=1, dtype=np.int64) <= apart(n, sizes[near])
            if met.any():
                out += [(int(codes[x]), y) for y in codes[near[met]].tolist()]
                todo += near[met].tolist()
                left = np.concatenate((left[:a], near[~met], left[b:]))
    return out


_MET = {"tokens": "<u8", "codes": "<i8", "sizes": "<i4", "k": "u1", "hubs": "u1", "words": "<u8"}
_PAIRS = {"a": "<i8", "b": "<i8", "lack": "u1", "n": "u1"}


def _rows(bucket: np.ndarray, buckets: int, columns: dict, kinds: dict, **more: int):
    """A record batch with a row per bucket: the bucket's part of every column."""
    cut = _cut(bucket, buckets)
    values = {"bucket": pa.array([k for k, _ in cut], pa.int32())} | {c: pa.array([v] * len(cut), pa.int32()) for c, v in more.items()}
    values |= {c: pa.array([_blob(columns[c][at], kind) for _, at in cut], pa.binary()) for c, kind in kinds.items()}
    return pa.RecordBatch.from_pydict(values)


def meetings(classes: DataFrame, buckets: int) -> DataFrame:
    """(a, b): codes, as pairs that connect all among ``classes`` (of ``routes``, each with a code) that may link.

    Linked classes share k shingles of their prefixes, k the lesser of MEET and
    of what their heads must share. Those that share half of k among the shingles
    of over FEW classes meet in one of the first of these, and their sketches are
    compared there. Shingles of FEW classes or less are taken pair by pair, where
    sketches allow a link; a pair needs the rest of k of them.
    """

    def send(batches):
        rows, size = {}, 0
        for batch in batches:
            for code, n, prefix, counts, bits in zip(*batch.columns, strict=True):
                code, n = code.as_py(), n.as_py()
                tokens, bits = np.frombuffer(prefix.as_py(), "<u8"), np.frombuffer(bits.as_py(), "<u8")
                light = int(np.searchsorted(np.frombuffer(counts.as_py(), "u1"), FEW, "right"))
                k, hubs = min(int(spare(need(n))), MEET), len(tokens) - light
                rows.setdefault(-1, []).append((tokens[:light], code, n, k, min(hubs, 255), folded(bits, 1)))
                band, half = n.bit_length() - 1, max(1, k // 2)
                # Linked classes are of one band, or the less of them is within a quarter of the next.
                for at in (band, band + 1)[: 1 + (5 * n >= 4 << (band + 1))] if hubs >= half else ():
                    rows.setdefault(at, []).append((tokens[light : len(tokens) - half + 1], code, n, k, min(hubs, 255), folded(bits, sketch_words(1 << at))))
                size += len(tokens)
                if size >= BLOCK:
                    yield from pack(rows)
                    rows, size = {}, 0
        yield from pack(rows)

    def pack(rows):
        for band, found in rows.items():
            tokens, *rest = zip(*found, strict=True)
            lengths = [len(t) for t in tokens]
            columns = {"tokens": np.concatenate(tokens)} | {c: np.repeat(np.array(v), lengths, axis=0) for c, v in zip(list(_MET)[1:], rest, strict=True)}
            yield _rows((columns["tokens"] >> np.uint64(20)) % np.uint64(buckets), buckets, columns, _MET, band=band)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        found = [tuple(np.empty(0, np.int64) for _ in _PAIRS)]
        for band, part in group.groupby("band"):
            tokens = _joined(part["tokens"], "<u8")
            order = np.argsort(tokens, kind="stable")
            tokens = tokens[order]
            codes, sizes, k, hubs = (_joined(part[c], _MET[c])[order].astype(np.int64) for c in ("codes", "sizes", "k", "hubs"))
            words = _joined(part["words"], "<u8").reshape(len(tokens), -1)[order]
            if band >= 0:
                ends = np.flatnonzero(np.concatenate((tokens[1:] != tokens[:-1], [True]))) + 1
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    pairs = np.array(alike(codes[a:b], sizes[a:b], words[a:b]), np.int64).reshape(-1, 2)
                    found.append((pairs.min(axis=1), pairs.max(axis=1), np.ones(len(pairs), np.int64), np.full(len(pairs), MEET)))
                continue
            for step in range(1, len(tokens)):
                x = np.flatnonzero(tokens[step:] == tokens[:-step])
                if not len(x):
                    break
                y = x + step
                differ = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64)
                near = (np.minimum(sizes[x], sizes[y]) >= need(np.maximum(sizes[x], sizes[y]))) & (differ <= apart(sizes[x], sizes[y]))
                x, y = x[near], y[near]
                half = np.maximum(1, np.maximum(k[x], k[y]) // 2)
                lack = np.minimum(k[x], k[y]) - np.minimum(np.minimum(hubs[x], hubs[y]), half - 1)
                found.append((np.minimum(codes[x], codes[y]), np.maximum(codes[x], codes[y]), np.maximum(lack, 1), np.ones(len(x), np.int64)))
        a, b, lack, n = _sums(*(np.concatenate(x) for x in zip(*found, strict=True)))
        bucket = ((a.view(np.uint64) ^ (b.view(np.uint64) * _SEEDS[0])) >> np.uint64(20)) % np.uint64(buckets)
        return _rows(bucket, buckets, {"a": a, "b": b, "lack": lack, "n": np.minimum(n, MEET)}, _PAIRS).to_pandas()

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        a, b, lack, n = _sums(*(_joined(group[c], kind).astype(np.int64) for c, kind in _PAIRS.items()))
        return pd.DataFrame({"a": a[n >= lack], "b": b[n >= lack]})

    sent = classes.select("code", "n", "prefix", "counts", "sketch").mapInArrow(send, "bucket int, band int, " + ", ".join(f"{c} binary" for c in _MET))
    found = sent.groupBy("bucket").applyInPandas(meet, "bucket int, " + ", ".join(f"{c} binary" for c in _PAIRS))
    return found.groupBy("bucket").applyInPandas(settle, "a bigint, b bigint")


class PrefixTree:
    """Sets in one order of all tokens, commonest first, as paths of a tree whose nodes carry runs of tokens."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], np.int64)
        _, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.empty(len(counts), np.int64)
        place[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        self.vocabulary = int((counts > 1).sum())  # those that one set alone holds come last and never add to an overlap
        ends = np.cumsum(size)
        paths = []
        for a, b in zip(ends - size, ends, strict=True):
            path = np.sort(place[where[a:b]])
            paths.append(path[: np.searchsorted(path, self.vocabulary)].astype(">u4"))
        #: Commonest paths first: sum of counts on the path.
        by_place = np.sort(counts)[::-1].astype(np.int64)
        weight = [int(by_place[p.astype(np.int64)].sum()) for p in paths]
        order = sorted(range(len(sets)), key=lambda k: paths[k].tobytes())
        self.order = np.array(order)
        self.size = size[order]
        self.paths = [paths[k].astype(np.int64) for k in order]
        self.by_weight = sorted(range(len(order)), key=lambda k: -weight[order[k]])
        self._link()

    def _link(self) -> None:
        m = len(self.paths)
        depth, low, high, parent, doc = [0], [0], [m], [-1], [-1]

        def add(at: int, first: int, own: int) -> int:
            depth.append(at), low.append(first), high.append(m), parent.append(-1), doc.append(own)
            return len(depth) - 1

        stack = [0]
        for k, path in enumerate([*self.paths, None]):
            common = -1 if path is None else 0
            if k and path is not None:
                before = self.paths[k - 1]
                n = min(len(before), len(path))
                differ = np.flatnonzero(before[:n] != path[:n])
                common = int(differ[0]) if len(differ) else n
            while len(stack) > 1 and depth[stack[-1]] > common:
                last = stack.pop()
                high[last] = k
                if depth[stack[-1]] < common:
                    stack.append(add(common, low[last], -1))
                parent[last] = stack[-1]
            if path is not None:
                stack.append(add(len(path), k, k))
        length = np.array([len(p) for p in self.paths], np.int64)
        self.low, self.high, self.doc, self.stop, up = (np.array(x, np.int64) for x in (low, high, doc, depth, parent))
        self.start = np.where(up >= 0, self.stop[np.maximum(up, 0)], 0)
        self.kids = np.argsort(up, kind="stable")[1:]
        n_kids = np.bincount(up[1:], minlength=len(up))
        self.kid_end = np.cumsum(n_kids)
        self.kid_start = self.kid_end - n_kids
        self.tokens = np.concatenate([*self.paths, np.zeros(1, np.int64)])
        self.offset = np.cumsum(length) - length
        self.least = np.array([self.size[a:b].min() for a, b in zip(low, high, strict=True)])
        self.most = np.array([self.size[a:b].max() for a, b in zip(low, high, strict=True)])
        self.longest = np.array([length[a:b].max() for a, b in zip(low, high, strict=True)])

    def probe(self, x: int, open_to: np.ndarray) -> np.ndarray:
        """Positions among ``open_to`` (a mask) of the sets that link with set x."""
        path, n = self.paths[x], int(self.size[x])
        held = np.zeros(self.vocabulary + 1, bool)
        held[path] = True
        wanted = np.concatenate(([0], np.cumsum(open_to)))
        nodes, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(nodes):
            at = self.doc[nodes]
            ends = np.flatnonzero((at >= 0) & open_to[np.maximum(at, 0)])
            if len(ends):
                y = at[ends]
                found.append(y[9 * overlap[ends] >= 4 * (n + self.size[y])])
            count = self.kid_end[nodes] - self.kid_start[nodes]
            total = int(count.sum())
            if not total:
                break
            inner = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            kids = self.kids[np.repeat(self.kid_start[nodes], count) + inner]
            overlap = np.repeat(overlap, count)
            useful = (wanted[self.high[kids]] > wanted[self.low[kids]]) & (5 * self.most[kids] >= 4 * n) & (4 * self.least[kids] <= 5 * n)
            kids, overlap = kids[useful], overlap[useful]
            run = self.stop[kids] - self.start[kids]
            total = int(run.sum())
            inner = np.arange(total) - np.repeat(np.cumsum(run) - run, run)
            first = self.offset[self.low[kids]] + self.start[kids]
            sums = np.concatenate(([0], np.cumsum(held[self.tokens[np.repeat(first, run) + inner]])))
            edge = np.cumsum(run)
            overlap = overlap + sums[edge] - sums[edge - run]
            # What is left on either side after the last token of the run, and the least overlap any set below needs.
            last = np.where(self.stop[kids] > 0, self.tokens[np.maximum(self.offset[self.low[kids]] + self.stop[kids] - 1, 0)], -1)
            left = np.minimum(len(path) - np.searchsorted(path, last, "right"), self.longest[kids] - self.stop[kids])
            least = -(-4 * (n + np.maximum(self.least[kids], need(n))) // 9)
            useful = overlap + left >= least
            nodes, overlap = kids[useful], overlap[useful]
        return np.concatenate(found) if found else np.empty(0, np.int64)


def linked(sets: list[np.ndarray], side: np.ndarray | None = None, every: bool = False) -> list[tuple[int, int]]:
    """Links that connect what all links connect: pairs of positions; with ``side``, between the two sides only.

    A set that has been probed against everything is closed. Sets that are
    already connected need no probe against each other, so once all open sets
    are connected the rest is known. With ``every``, all links, each once.
    """
    sided = side is not None
    if len(sets) < 2 or (sided and len(np.unique(side)) < 2):
        return []
    tree = PrefixTree(sets)
    m = len(sets)
    side = np.asarray(side)[tree.order] if sided else np.zeros(m, np.int64)
    if every:
        left = np.ones(m, bool)
        found = []
        for x in range(m):
            left[x] = False
            found += [(int(tree.order[x]), int(tree.order[y])) for y in tree.probe(x, left & (side != side[x]) if sided else left).tolist()]
        return found
    forest, out = Forest(m), []
    closed, root, count = np.zeros(m, bool), np.arange(m), np.ones(m, np.int64)
    heart = tree.by_weight[0]
    while True:
        todo = [x for x in tree.by_weight if not closed[x] and root[x] != root[heart]]
        if not todo:
            break
        for x in todo if closed[heart] else [heart, *todo]:
            if closed[x] or (root[x] == root[heart] and x != heart):
                continue
            open_to = ~closed & (root != root[x])
            if sided:
                open_to &= side != side[x]
            for y in tree.probe(x, open_to).tolist():
                if forest.find(x) != forest.find(y):
                    out.append((int(tree.order[x]), int(tree.order[y])))
                    a, b = forest.find(x), forest.find(y)
                    forest.join(a, b)
                    keep, gone = min(a, b), max(a, b)
                    root[root == gone] = keep
                    count[keep] += count[gone]
            closed[x] = True
            if count[root[x]] > count[root[heart]]:
                heart = x
    return out


def tally(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Per set the weight of all sets that link with it, and links that connect what all links connect; every link is found, none is listed."""
    total, out = np.zeros(len(sets), np.int64), []
    if len(sets) < 2 or (side is not None and len(np.unique(side)) < 2):
        return total, out
    tree = PrefixTree(sets)
    m = len(sets)
    weight = np.asarray(weight, np.int64)[tree.order]
    side = np.asarray(side)[tree.order] if side is not None else None
    left, root, n = np.ones(m, bool), np.arange(m), np.zeros(m, np.int64)
    for x in range(m):
        left[x] = False
        met = tree.probe(x, left if side is None else left & (side != side[x]))
        n[x] += weight[met].sum()
        n[met] += weight[x]
        fresh, first = np.unique(root[met], return_index=True)
        for r, y in zip(fresh.tolist(), met[first].tolist(), strict=True):
            if r != root[x]:
                out.append((int(tree.order[x]), int(tree.order[y])))
                root[root == r] = root[x]
    total[tree.order] = n
    return total, out


def search(docs: DataFrame, groups: DataFrame, every: bool = False, count: bool = False) -> DataFrame:
    """Links (a, b) within groups, all of them or enough to connect the same: rows of ``groups`` are doc_id, digest, class, members, group, part_a, part_b, part.

    The text of a class comes by the id and digest of one row that has it.
    With ``count``, links that connect the same, and rows of a class alone (b is
    null) with n, the documents in other classes that it links with there.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets, names, side, weight = [], [], [], []
        seen = set()
        for text, name, part, held in zip(group["text"], group["class"], group["part"], group["members"], strict=True):
            s = shingles(text)
            if name not in seen and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(name):
                seen.add(name), sets.append(s), names.append(bytes(name)), side.append(part), weight.append(held)
        same = group["part_a"].iloc[0] == group["part_b"].iloc[0]
        sides = None if same else np.array(side)
        if not count:
            return pd.DataFrame([(names[a], names[b]) for a, b in linked(sets, sides, every)], columns=["a", "b"])
        total, pairs = tally(sets, np.array(weight), sides)
        rows = [(names[a], names[b], 0) for a, b in pairs] + [(names[k], None, int(total[k])) for k in np.flatnonzero(total)]
        return pd.DataFrame(rows, columns=["a", "b", "n"])

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), text.alias("text"), text_digest(text).alias("_digest"))
    return (
        groups.join(texts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
        .select("group", "part_a", "part_b", "part", "class", "members", "text")
        .groupBy("group", "part_a", "part_b").applyInPandas(run, "a binary, b binary" + ", n bigint" * count)
    )


def join(
    docs: DataFrame, every: bool = True, block_size: int = BLOCK, group_size: int = GROUP_SHINGLES, count: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(documents with their class, links between classes): the join as pairs of classes plus membership.

    Without ``every``, only enough of the links to connect the same classes;
    with ``count``, those and the number of all links, as ``search`` gives them.
    """
    spark = docs.sparkSession
    made = stored(blocks(docs, block_size), "sets")
    total = made.agg(F.sum("shingles")).first()[0] or 0
    owning = made.join(stored(repeated(made, parts(spark)), "gone"), "block", "left")
    known = shared(owning, max(parts(spark), int(total // BUCKET) + 1))
    routed = stored(routes(owning, known), "routes")
    met = routed.where("token is not null").select("token", "root").distinct()
    lead = met.groupBy("token").agg(F.min("root").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    group = components(met.join(lead, "token").select(F.col("root").alias("a"), F.col("lead").alias("b")))
    nodes = routed.where("token is null").drop("token")
    grouped = nodes.join(group.toDF("root", "label"), "root", "left").withColumn("group", F.coalesce("label", "root"))
    grouped = grouped.select("class", "n", "group", "prefix", "counts", "sketch")
    size = _size(grouped)
    large = stored(size.where((F.col("members") > GROUP_MEMBERS) | (F.col("shingles") > group_size)), "large")
    if not large.isEmpty():
        # Two classes of one code would only be searched together.
        again = stored(grouped.join(large.select("group"), "group", "left_semi").withColumn("code", F.xxhash64("class")), "again")
        label = components(meetings(again, parts(spark))).select("node", F.unhex(F.hex("label")))
        grouped = grouped.join(large.select("group"), "group", "left_anti").select("class", "n", "group")
        grouped = grouped.unionAll(again.select("class", "n", "code").join(label.toDF("code", "group"), "code").select("class", "n", "group"))
        size = _size(grouped)
    split = size.select("group", F.ceil(F.col("shingles") / group_size).cast("int").alias("parts"))
    dealt = (
        grouped.select("class", "group").join(split, "group").withColumn("part", F.pmod(F.hash("class"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("class", "group", "part", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"))
    )
    owned = members(made)
    holder = owned.where("n_shingles > 0").groupBy("class").agg(F.min(F.struct("doc_id", "digest")).alias("held"), F.count(F.lit(1)).alias("members"))
    holder = holder.select("class", "held.*", "members")
    return owned, stored(search(docs, dealt.join(holder, "class"), every, count), "pairs")


def _size(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where("members > 1")


def label(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, copies and singles included.

    The component is named by its least doc_id; null ids take part but name none
    (a component of null ids only has a null name). Null and blank texts are
    empty sets, each by itself. Rows that repeat an id count each for itself.
    """
    owned, links = join(docs, every=False, **sizes)
    by_class = stored(_named(owned, links), "named")
    held = owned.where("n_shingles > 0").join(by_class, "class").select("doc_id", "n_shingles", "component_id")
    return held.unionAll(owned.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def count_links(docs: DataFrame, **sizes: int) -> DataFrame:
    """What ``label`` gives, and n_links: how many other documents each one links with, copies of its text included.

    The whole join: every link is found and counted, but the pairs, whose number
    grows with the square of a group, are not written; ``join`` returns them.
    """
    owned, found = join(docs, count=True, **sizes)
    held = owned.where("n_shingles > 0")
    copies = held.groupBy("class").agg(F.count(F.lit(1)).alias("members"))
    others = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n")).toDF("class", "n")
    counted = copies.join(others, "class", "left").select("class", (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    by_class = stored(_named(owned, found.where("b is not null").select("a", "b")).join(counted, "class"), "named")
    out = held.join(by_class, "class").select("doc_id", "n_shingles", "component_id", "n_links")
    empty = owned.where("n_shingles = 0")
    return out.unionAll(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links")))


def _named(owned: DataFrame, links: DataFrame) -> DataFrame:
    """(class, component_id) of every class with shingles."""
    least = owned.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    named = least.join(components(links).toDF("class", "label"), "class", "left").select("class", "least", F.coalesce("label", "class").alias("label"))
    first = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return named.join(first, "label").select("class", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns kept; rows without words stay, each for itself.

    The row of the least doc_id stays, one without an id only where none has
    one; of rows with that id the one with the least digest of its text, and of
    rows with equal id and text any one.
    """
    owned, links = join(docs, every=False)
    alike = owned.where("n_shingles > 0").groupBy("class", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    labelled = alike.join(components(links).toDF("class", "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    first = labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n")).alias("f"))
    empty = owned.where("n_shingles = 0").select("doc_id", "digest", F.lit(False)).distinct()
    kept = first.select("f.doc_id", "f.digest", F.col("f.n") > 1).unionAll(empty).toDF("_kept", "_kept_digest", "_repeated")
    kept = stored(kept, "kept")

    def held(by: DataFrame) -> DataFrame:
        same = docs["doc_id"].cast("bigint").eqNullSafe(by["_kept"]) & (text_digest(docs["text"].cast("string")) == by["_kept_digest"])
        return docs.join(by, same, "left_semi")

    out, repeated = held(kept.where("not _repeated")), kept.where("_repeated")
    if not repeated.isEmpty():
        again = held(repeated)
        row = F.struct(*[again[c] for c in again.columns])
        one = again.groupBy(again["doc_id"].cast("bigint"), text_digest(again["text"].cast("string"))).agg(F.first(row).alias("_row"))
        out = out.unionAll(one.select("_row.*"))
    return out
