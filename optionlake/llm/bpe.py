"""BPE encoding as a streaming transducer with bounded lookahead, decoding as a byte-to-text state machine.

The vocabulary is a byte-level ``tokenizers`` file. A text is cut at special
tokens and then into pieces between which no merge can happen. A piece runs
through ``Transducer``: for every end position it knows the last token of the
encoding of the bytes so far, which is the one token that may follow the last
token before it. A piece shorter than the lookahead is settled at its end. Tokens leave as soon as every way the piece can go on agrees on
them; ``lookahead`` bounds, from the merge list alone, how many bytes that can
take, so the state stays the same size however long a piece is.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import per_worker

# White space (Unicode White_Space) and the piece pattern of byte-level files.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
PIECE = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: The same for texts of Latin-1 without its six odd numerals, in which word characters and digits are letters and digits.
WESTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w{SPACE}]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces up to this length are remembered, as many as fit REMEMBERED; longer ones are streamed each time.
SHORT, REMEMBERED, CHUNK = 48, 300_000, 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter a byte-level file writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """What the transducer needs of a vocabulary file, built once per worker."""

    def __init__(self, spec: dict):
        letters = byte_letters()
        as_bytes = lambda t: bytes(letters[c] for c in t)
        model = spec["model"]
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.rank = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in reversed([*enumerate(pairs)])}
        self.lookahead = lookahead(pairs)
        self.longest = max(map(len, self.ids))
        #: Tokens that encode as themselves; the others never come out.
        self.whole = {token: i for token, i in self.ids.items() if self.merge(token) == [i]}
        self._follows: dict[int, bool] = {}

    @cached_property
    def suffix(self) -> dict[bytes, int]:
        """Every suffix of a token, and the token it is, or -1."""
        return {token[k:]: -1 for token in self.whole for k in range(1, len(token))} | self.whole

    @cached_property
    def prefix(self) -> dict[bytes, int]:
        """Every prefix of a token, and the token it is, or -1."""
        return {token[:k]: -1 for token in self.whole for k in range(1, len(token))} | self.whole

    def settle(self, piece: bytes) -> list[int]:
        """The encoding of a piece known to its end, shorter than the lookahead: longest tokens that can stand side by side.

        Tokens each of which may follow the one before are the encoding of
        their bytes, so a place is reached in one way only; one that leads
        nowhere is not tried again.
        """
        prefix, known, follows, n = self.prefix.get, self._follows.get, self.follows, len(piece)
        starts, path, left, dead = [], [], [], set()
        at, ways = 0, None
        while at < n:
            if ways is None:
                ways, end = [], at + 1
                while end <= n:
                    token = prefix(piece[at:end])
                    if token is None:
                        break
                    if token >= 0:
                        ways.append((end, token))
                    end += 1
            while ways:
                end, token = ways.pop()
                if end in dead:
                    continue
                if path:
                    fits = known(path[-1] << 32 | token)
                    if not (fits or (fits is None and follows(path[-1], token))):
                        continue
                starts.append(at), path.append(token), left.append(ways)
                at, ways = end, None
                break
            else:
                dead.add(at)
                at, ways = starts.pop(), left.pop()
                path.pop()
        return path

    def merge(self, piece: bytes) -> list[int]:
        """Merges in order of rank, leftmost first: the definition, for short pieces."""
        ids = [self.ids[piece[k : k + 1]] for k in range(len(piece))]
        while len(ids) > 1:
            best = min((self.rank.get(p, (1 << 60, -1)) for p in zip(ids, ids[1:], strict=False)))
            if best[1] < 0:
                break
            k, out = 0, []
            while k < len(ids):
                if k + 1 < len(ids) and self.rank.get((ids[k], ids[k + 1]), (1 << 60, -1)) == best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens can stand side by side: their joined bytes encode as just them."""
        key = left << 32 | right
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= REMEMBERED:
                self._follows.clear()
            known = self._follows[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known


def lookahead(pairs: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token boundary that can still move it.

    A merge changes what stands to its left only by taking, as its left part, a
    token that a later merge wants as its right part, or by making such a token.
    So the reach to the left is the longest chain of merges, each later than the
    one before, linked in one of these two ways; one sweep from the last merge finds it.
    """
    reach: dict[bytes, int] = {}  # by right part, over the merges already seen
    most = 1
    for left, right in reversed(pairs):
        beyond = max(reach.get(left, 0), reach.get(left + right, 0))
        most = max(most, len(left) + len(right) + beyond)
        reach[right] = max(reach.get(right, 0), len(left) + beyond)
    return most


class Transducer:
    """Encodes one piece, fed in any number of chunks."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.buffer = b""
        self.last = [-1]  # last token of the encoding of buffer[:k], by k; at 0 what was emitted before
        self.wait = 2 * (merges.lookahead + merges.longest)

    def feed(self, chunk: bytes) -> list[int]:
        out: list[int] = []
        for k in range(0, len(chunk), self.wait):
            self._extend(chunk[k : k + self.wait])
            if len(self.buffer) >= self.wait:
                out += self._emit()
        return out

    def _extend(self, chunk: bytes) -> None:
        suffix, known, follows = self.merges.suffix.get, self.merges._follows.get, self.merges.follows
        data, last = self.buffer + chunk, self.last
        for end in range(len(self.buffer) + 1, len(data) + 1):
            start = end - 1
            while start >= 0:
                token = suffix(data[start:end])
                if token is None:
                    break
                if token >= 0:
                    before = last[start]
                    if before < 0:
                        if before == -1:
                            break
                    else:
                        fits = known(before << 32 | token)
                        if fits or (fits is None and follows(before, token)):
                            break  # the only token that can end here
                start -= 1
            else:
                token = None
            last.append(-2 if token is None else token)
        self.buffer = data

    def _chain(self, end: int) -> list[int]:
        cuts = [end]
        while end > 0:
            end -= len(self.merges.bytes_of[self.last[end]])
            cuts.append(end)
        return cuts[::-1]

    def _emit(self) -> list[int]:
        """Tokens that every continuation shares: a token yet to come starts within the longest token from the end."""
        end = len(self.buffer)
        shared = set(self._chain(end))
        for k in range(max(1, end - self.merges.longest + 1), end):
            shared &= set(self._chain(k)) | set(range(k + 1, end + 1))
        stable = max((c for c in shared if c <= end - self.merges.longest), default=0)
        if not stable:
            return []
        out = [self.last[c] for c in self._chain(stable)[1:]]
        self.buffer = self.buffer[stable:]
        self.last = [self.last[stable], *self.last[stable + 1 :]]
        return out

    def finish(self) -> list[int]:
        out = [self.last[c] for c in self._chain(len(self.buffer))[1:]]
        self.buffer, self.last = b"", [-1]
        return out


class Codec:
    """Encodes and decodes whole texts; remembers short pieces."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f))
        self.pieces = regex.compile(PIECE)
        self.western = re.compile(WESTERN)
        self.newer, self.pieces_newer = newer_letters(path, regex)
        names = sorted(self.merges.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.seen: dict[str, list[int]] = {}
        size = max(self.merges.bytes_of) + 1
        self.token_bytes = [self.merges.bytes_of.get(i, b"") for i in range(size)]
        self.decimal = [str(i) for i in range(size)]

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode()
        if len(data) > min(SHORT, self.merges.lookahead):
            machine = Transducer(self.merges)
            return [t for k in range(0, len(data), CHUNK) for t in machine.feed(data[k : k + CHUNK])] + machine.finish()
        ids = self.merges.settle(data)
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[piece] = ids
        return ids

    def _spans(self, text: str) -> Iterator[str]:
        if western(text):
            pieces = self.western
        else:
            pieces = self.pieces if self.newer is None or not self.newer.search(text) else self.pieces_newer
        return (m[0] for m in pieces.finditer(text)) if len(text) > CHUNK else iter(pieces.findall(text))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.merges.special:
                out.append(self.merges.special[part])
                continue
            known = self.seen.get
            for piece in self._spans(part):
                out += known(piece) or self._piece(piece)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        machine = TextMachine()
        ids = ids if isinstance(ids, list) else [*ids]
        texts = [
            machine.feed(b"".join(map(self.token_bytes.__getitem__, ids[k : k + CHUNK]))) for k in range(0, len(ids), CHUNK)
        ]
        return "".join(texts) + machine.finish()


def western(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in text for c in "\xb2\xb3\xb9\xbc\xbd\xbe")


def newer_letters(path: str, regex):
    """Letters and digits that ``regex`` knows and the tokenizers library does not yet, and the piece pattern without them.

    Both follow Unicode, in different versions. Only code points that are not
    assigned in Python's own tables can be such, so only those are tried.
    """
    import sys
    import unicodedata

    from tokenizers import Tokenizer

    cut, known = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str, regex.compile(r"[\p{L}\p{N}]")
    late = [
        c for c in map(chr, range(0x80, sys.maxunicode + 1))
        if unicodedata.category(c) == "Cn" and known.match(c) and len(cut("!" + c)) == 1
    ]
    if not late:
        return None, None
    ranges, start = [], 0
    for k in range(1, len(late) + 1):
        if k == len(late) or ord(late[k]) != ord(late[k - 1]) + 1:
            ranges.append(f"{late[start]}-{late[k - 1]}")
            start = k
    newer = "".join(ranges)
    pattern = (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{newer}]]+| ?[\p{{N}}--[{newer}]]+"
        rf"| ?(?:[^{SPACE}\p{{L}}\p{{N}}]|[{newer}])+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )
    return regex.compile(f"[{newer}]"), regex.compile(pattern, regex.V1)


class TextMachine:
    """Bytes in, text out; between two chunks it keeps the at most three bytes of an unfinished character."""

    def __init__(self):
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._state.decode(data)

    def finish(self) -> str:
        return self._state.decode(b"", True)


def codec(path: str) -> Codec:
    return per_worker(("bpe", path), lambda: Codec(path))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _batches(column, code: Codec, most: int = 1 << 19):
    """Runs of rows with about ``most`` tokens: first row, ids of each row."""
    first, held, size = 0, [], 0
    for k, text in enumerate(column):
        held.append(code.encode(text.as_py()))
        size += len(held[-1])
        if size >= most:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids``, the token ids of every whole text (null: none). Other columns pass through, but for one named ids."""
    keep = [c for c in docs.columns if c != "ids"]
    schema = T.StructType([f for f in docs.schema.fields if f.name != "ids"] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        code = codec(path)
        for batch in batches:
            for first, ids in _batches(batch.column(text), code):
                part = [batch.column(c).slice(first, len(ids)) for c in keep]
                yield pa.RecordBatch.from_arrays([*part, pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the text of every ``ids`` array (null: empty)."""
    keep = [c for c in tokens.columns if c != "decoded"]
    schema = T.StructType([f for f in tokens.schema.fields if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        code = codec(path)
        for batch in batches:
            texts = pa.array([code.decode(t.as_py() or []) for t in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], texts], names=[*keep, "decoded"])

    return tokens.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, exact (and ids) of every document, each text encoded and decoded once.

    A null text counts as empty; a null or repeated doc_id is just carried.
    Unless asked for, ids leave the task as a digest only.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<int>" * with_ids

    def run(batches):
        code = codec(path)
        for batch in batches:
            for first, listed in _batches(batch.column("text"), code):
                rows = []
                for k, ids in enumerate(listed):
                    decoded = code.decode(ids)
                    decimal = ",".join(map(code.decimal.__getitem__, ids)).encode()
                    exact = decoded == (batch.column("text")[first + k].as_py() or "")
                    rows.append((len(ids), hashlib.sha256(decimal).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), exact))
                n, a, b, same = zip(*rows, strict=True)
                columns = [batch.column("doc_id").slice(first, len(rows)), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(same)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"]
                if with_ids:
                    columns, names = [*columns, pa.array(listed, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, schema)
