"""Repair of conversation structure at least cost, over a grammar of role and fault sequences.

A conversation is a sequence of symbols, one per row: its role's initial and
whether it must go or is cut short. Repair walks four states (nothing yet, after
system, after user, after assistant); a symbol is a 4 by 4 matrix over (min, +)
whose entry (i, j) is the cheapest way from i to j across that row, inserts
before the row included. Sequences that repeat are named by Re-Pair, and each
rule gets one matrix, the product of its two parts, whoever uses it.

An entry keeps no text but the state its two parts meet in; read down the rules,
that is the rope of its audit. Of two entries of one row of a matrix neither
audit is a prefix of the other (both end with the same number of rows handled,
and an insert never comes last), so ties between equal costs are decided within
the left part wherever the states differ, and a rank per entry is all that
comparing audits takes.

Rows are put in order by a range exchange, which cuts a very long conversation
over many tasks. Each task folds its part to a matrix; parts are joined by costs
and ranks alone. Only hashing the repaired text passes through a conversation
in one task, row by row.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stored

# Costs of the edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Symbol 0 must be deleted; others are 1 + 2 * (place in INITIALS, or 3 for another role) + 1 if cut short.
INITIALS = "sua"
GONE, LETTERS = 0, 9
#: Rows compressed at a time.
SHARD = 100_000
FAR = 1 << 29


def _next(state: int) -> int:
    return ASSISTANT if state == USER else USER


@cache
def _step(symbol: int) -> list[list[tuple[int, str]]]:
    """Cheapest (cost, audit) from each state to each across one row, spelled out."""
    table = [[(FAR, "")] * 4 for _ in range(4)]
    role, cut = (symbol - 1) // 2, CUT_SHORT * ((symbol - 1) % 2)
    for start in range(4):
        state, cost, audit = start, 0, ""
        for _ in range(4):  # so many inserts visit every state that they can reach
            ways = [(state, cost + DELETE, audit + "D")]
            if symbol != GONE:
                if role == 0 and state == NOTHING:
                    ways.append((SYSTEM, cost + KEEP + cut, audit + "K"))
                if INITIALS[role : role + 1] == "_sua"[_next(state)]:
                    ways.append((_next(state), cost + KEEP + cut, audit + "K"))
                ways.append((_next(state), cost + REROLE + cut, audit + "R"))
            for end, price, text in ways:
                table[start][end] = min(table[start][end], (price, text))
            state, cost, audit = _next(state), cost + INSERT, audit + "I"
    return table


def letters() -> tuple[np.ndarray, np.ndarray]:
    """Costs and ranks of the symbols' matrices, (9, 4, 4) each."""
    cost = np.full((LETTERS, 4, 4), FAR, np.int32)
    rank = np.zeros((LETTERS, 4, 4), np.int8)
    for symbol in range(LETTERS):
        for i, row in enumerate(_step(symbol)):
            order = sorted({text for _, text in row})
            for j, (price, text) in enumerate(row):
                cost[symbol, i, j], rank[symbol, i, j] = price, order.index(text)
    return cost, rank


def joined(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of matrices, (n, 4, 4) each: costs, ranks, and the state in which the parts of each entry meet."""
    (cost_a, rank_a), (cost_b, rank_b) = left, right
    total = np.minimum(cost_a[:, :, :, None] + cost_b[:, None, :, :], FAR)  # from i over k to j
    cost = total.min(2)
    tied = np.where(total == cost[:, :, None, :], rank_a[:, :, :, None], np.int8(4))
    via = tied.argmin(2).astype(np.int8)
    lead = np.take_along_axis(rank_a, via, 2)
    rows = np.arange(len(via))[:, None, None]
    rest = rank_b[rows, via, np.arange(4)[None, None, :]]
    key = np.where(cost < FAR, lead * 4 + rest, 99)
    rank = (key[:, :, None, :] < key[:, :, :, None]).sum(3, dtype=np.int8)
    return cost, rank, via


class Grammar:
    """Re-Pair over many sequences at once, a matrix per symbol."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray):
        """``sequences`` holds the symbols of all sequences in a row, none of them empty."""
        self.cost, self.rank = letters()
        self.via = np.zeros((LETTERS, 4, 4), np.int8)
        self.rules = np.zeros((0, 2), np.int64)
        self.spelled: dict[tuple[int, int, int], str] = {}
        own = np.repeat(np.arange(len(lengths)), lengths)
        run = sequences.astype(np.int64)
        while True:
            run, own, found = self._round(run, own, shared=True)
            if not found:
                break
        # What is left of each sequence is folded two by two; such rules have one use.
        while len(run) > len(lengths):
            run, own, _ = self._round(run, own, shared=False)
        self.roots = run

    def _round(self, run: np.ndarray, own: np.ndarray, shared: bool):
        """Name pairs of neighbours within a sequence: the most frequent and those at least half as frequent, or any."""
        pair = run[:-1] << 32 | run[1:]
        at = np.flatnonzero(own[:-1] == own[1:])
        if shared:
            kinds, place, often = np.unique(pair[at], return_inverse=True, return_counts=True)
            if not len(kinds) or often.max() < 2:
                return run, own, False
            at = at[often[place] >= max(2, often.max() // 2)]
        # Of neighbouring places every other one counts, from the first of each stretch.
        fresh = np.append(True, np.diff(at) > 1)
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        kinds, named = np.unique(pair[at], return_inverse=True)
        new = np.stack((kinds >> 32, kinds & 0xFFFFFFFF), 1)
        cost, rank, via = joined(*((self.cost[s], self.rank[s]) for s in new.T))
        base = len(self.cost)
        self.cost, self.rank, self.via = (np.concatenate(x) for x in ((self.cost, cost), (self.rank, rank), (self.via, via)))
        self.rules = np.concatenate((self.rules, new))
        run = run.copy()
        run[at] = base + named
        keep = np.ones(len(run), bool)
        keep[at + 1] = False
        return run[keep], own[keep], True

    def audit(self, symbol: int, i: int, j: int) -> str:
        """The audit an entry stands for, read off its rope; short ones are remembered."""
        out, todo = [], [(symbol, i, j)]
        while todo:
            s, a, b = todo.pop()
            if s < LETTERS:
                out.append(_step(s)[a][b][1])
                continue
            k = int(self.via[s, a, b])
            left, right = self.rules[s - LETTERS].tolist()
            todo += [(right, k, b), (left, a, k)]
        return "".join(out)

    def entry(self, symbol: int, i: int, j: int) -> str:
        key = (symbol, i, j)
        if key not in self.spelled:
            self.spelled[key] = self.audit(*key)
        return self.spelled[key]


#: Inserts that end a conversation well, by the state it is in.
CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


# --- rows ----------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """The rows that training for repair damages: conv_id, turn, role, text, nulls in the last two as one space.

    What happens depends on the row's own key; a repeated row is damaged alike.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.where(kind != 0).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def faults(rows: DataFrame) -> DataFrame:
    """Equal rows as one with ``copies``, and the ``fault`` of the first of them: blank, duplicate, truncated or null.

    Needs conv_id, turn, role, text, copies. Copies beyond the first are
    duplicates (blank ones blank). Rows of one turn are ordered by role, then
    by the digest of the text.
    """
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("bigint").alias("copies")).withColumn(
        "digest", F.sha2("text", 256)
    )
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(last == "", "blank").when(F.row_number().over(same) > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    )
    return once.select("*", fault.alias("fault"))


def symbols(rows: DataFrame) -> DataFrame:
    """Add ``symbol``, that of the first of equal rows."""
    place = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), _initial(F.col("role"))), F.lit(0)) - 1, F.lit(3))
    place = F.when(F.col("role") == "", 3).otherwise(place)
    gone = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    cut = F.when(F.col("fault") == "truncated", 1).otherwise(0)
    return rows.withColumn("symbol", F.when(gone, GONE).otherwise(1 + 2 * place + cut).cast("int"))


# --- the dynamic program -------------------------------------------------------

PIECES = "conv_id bigint, part int, piece int, cost array<bigint>, rank array<bigint>, audit array<string>"
_PIECES = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()),
    ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int64())), ("audit", pa.list_(pa.string())),
])
ORDER = ["conv_id", "turn", "role", "digest"]


def _pieces(batches):
    """Fold the rows of one task, in order, to one matrix per conversation and shard.

    A conversation that lies within a shard needs only its way from the first
    state; one that touches an edge keeps all sixteen entries.
    """
    part, piece = TaskContext.get().partitionId(), 0
    codes, convs, sizes = bytearray(), [], []

    def fold():
        grammar = Grammar(np.frombuffer(codes, np.uint8), np.array(sizes))
        out = []
        for k, (conv, root) in enumerate(zip(convs, grammar.roots.tolist(), strict=True)):
            edge = (k == 0) or (k + 1 == len(convs))
            cost, rank = grammar.cost[root], grammar.rank[root]
            if edge:
                audit = [grammar.entry(root, i, j) if cost[i, j] < FAR else None for i in range(4) for j in range(4)]
            else:
                best = closed(cost[0].tolist(), rank[0].tolist())
                audit = [grammar.entry(root, 0, j) if j == best else None for j in range(4)] + [None] * 12
            out.append((conv, part, piece, cost.ravel().tolist(), rank.ravel().tolist(), audit))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    for batch in batches:
        for conv, symbol, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "symbol", "copies")), strict=True):
            while copies > 0:  # the copies beyond the first are deleted
                take = min(copies, SHARD - len(codes))
                if not convs or conv != convs[-1]:
                    convs.append(conv)
                    sizes.append(0)
                codes += bytes([symbol]) + bytes(take - 1)
                sizes[-1] += take
                copies, symbol = copies - take, GONE
                if len(codes) == SHARD:
                    yield fold()
                    piece, codes, convs, sizes = piece + 1, bytearray(), [], []
    if convs:
        yield fold()


def closed(cost: list[int], rank: list[int]) -> int:
    """State in which to stop, of the costs and ranks to reach each."""
    return min(range(4), key=lambda j: (cost[j] + INSERT * len(CLOSING[j]), rank[j]))


def _route(frames):
    """Choose, per conversation, the entry of each of its parts: costs to go backwards, then the least audit forwards."""
    for frame in frames:
        out = []
        for conv, pieces in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
            cost = np.array([p["cost"] for p in pieces]).reshape(-1, 4, 4)
            rank = np.array([p["rank"] for p in pieces]).reshape(-1, 4, 4)
            go = np.empty((len(pieces) + 1, 4), np.int64)
            go[-1] = [INSERT * len(CLOSING[j]) for j in range(4)]
            for k in range(len(pieces) - 1, -1, -1):
                go[k] = (cost[k] + go[k + 1]).min(1)
            state, entries = NOTHING, []
            for k in range(len(pieces)):
                total = cost[k, state] + go[k + 1]
                end = int(np.where(total == total.min(), rank[k, state], 9).argmin())
                entries.append(4 * state + end)
                state = end
            for p, entry in zip(pieces, entries, strict=True):
                out.append((conv, p["part"], p["piece"], entry, CLOSING[state] if p is pieces[-1] else "", int(go[0, 0])))
        names = ["conv_id", "part", "piece", "entry", "closing", "cost"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=names)


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, part, piece, cost, audit): the cheapest repair of every conversation, its audit in pieces.

    A conversation within one shard has one piece; a long one has one per
    shard it crosses. Needs the columns of ``faults``.
    """
    spark = rows.sparkSession
    ordered = symbols(rows).select(*ORDER, "symbol", "copies").repartitionByRange(parts(spark), *ORDER).sortWithinPartitions(*ORDER)
    pieces = stored(ordered.select("conv_id", "symbol", "copies").mapInArrow(_pieces, PIECES), "pieces")
    # A row here is a conversation's part, not its rows: at most one per shard of rows.
    listed = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "piece", "cost", "rank"))).alias("pieces"))
    route = listed.mapInArrow(_route, "conv_id bigint, part int, piece int, entry int, closing string, cost bigint")
    way = route.withColumnRenamed("conv_id", "c").withColumnsRenamed({"part": "p", "piece": "q", "cost": "total"})
    met = pieces.join(way, pieces["conv_id"].eqNullSafe(way["c"]) & (pieces["part"] == way["p"]) & (pieces["piece"] == way["q"]))
    return met.select("conv_id", "part", "piece", F.col("total").alias("cost"), F.concat(F.element_at("audit", F.col("entry") + 1), "closing").alias("audit"))


# --- what is returned ----------------------------------------------------------

RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)
LEGAL = {"su", "ua", "au"}


class _Reader:
    """One conversation as its rows go by; it keeps its audit, a hash and counters."""

    def __init__(self, conv):
        self.conv, self.cost, self.audit, self.at = conv, 0, [], 0
        self.seen = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before = 0, None
        self.low = self.high = self.turn = None
        self.turns, self.state, self.some = 0, NOTHING, False
        self.sha = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = _next(self.state)
            self._line(ROLE[self.state], "")
            self.at += 1

    def row(self, turn, role: str, text: str, fault, copies: int) -> None:
        if isinstance(self.audit, list):
            self.audit = "".join(self.audit)
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        if initial + initial not in LEGAL:
            self.illegal += copies - 1
        self.before = initial
        if turn is not None:
            if turn != self.turn:
                self.turns += 1
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        if fault:
            self.seen[fault] += 1
        self.seen["blank" if fault == "blank" else "duplicate"] += copies - 1
        for _ in range(copies):
            self._inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "D":
                continue
            self.state = SYSTEM if edit == "K" and self.state == NOTHING and initial == "s" else _next(self.state)
            self._line(role if edit == "K" else ROLE[self.state], text)

    def result(self) -> tuple:
        self.audit = "".join(self.audit)
        self._inserts()
        gaps = min(self.high - self.low + 1 - self.turns, (1 << 63) - 1) if self.turns else 0
        return (self.conv, gaps, *self.seen.values(), self.illegal, self.cost, self.audit, self.sha.hexdigest())


def _read(batches):
    names = ["conv_id", "kind", "turn", "role", "text", "fault", "copies", "cost", "audit"]
    reader, out = None, []
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[
            "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

    for batch in batches:
        for conv, kind, turn, role, text, fault, copies, cost, audit in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if reader is None or reader.conv != conv:
                if reader is not None:
                    out.append(reader.result())
                reader = _Reader(conv)
            if kind == 1:
                reader.cost = cost
                reader.audit.append(audit)
            elif kind == 2:
                reader.row(turn, role, text, fault, copies)
        if len(out) > 1000:
            yield batch_of(out)
            out = []
    if reader is not None:
        yield batch_of([*out, reader.result()])


def repair(conversations: DataFrame) -> DataFrame:
    """The columns of the contract for every conv_id, its rows damaged and then repaired.

    A null conv_id is a conversation of its own; rows without a turn come
    first; equal rows count each; rows of one turn are ordered by role, then by
    the digest of the text. A conversation with no rows left has zeros, an empty
    audit and the empty text's hash. Other columns play no part; an empty table
    gives an empty result.

    Texts pass through a conversation's task one by one: its hash needs them in
    order. That task keeps the audit, a letter per row, which it also returns.
    """
    spark = conversations.sparkSession
    rows = stored(faults(damage(conversations)), "conversations")
    none = {"turn": "bigint", "role": "string", "text": "string", "digest": "string", "fault": "string", "copies": "bigint", "cost": "bigint", "audit": "string"}
    names = ["conv_id", "kind", "part", "piece", *none]

    def filled(df: DataFrame, kind: int) -> DataFrame:
        have = df.withColumn("kind", F.lit(kind))
        for name in ("part", "piece"):
            have = have if name in df.columns else have.withColumn(name, F.lit(0))
        return have.select("conv_id", "kind", "part", "piece", *[
            (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in none.items()])

    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    lines = filled(every, 0).unionByName(filled(audits(rows), 1)).unionByName(filled(rows, 2))
    order = ["conv_id", "kind", "part", "piece", "turn", "role", "digest"]
    ordered = lines.repartition(parts(spark), "conv_id").sortWithinPartitions(*order)
    return ordered.select(*(c for c in names if c not in ("part", "piece", "digest"))).mapInArrow(_read, RESULT)
