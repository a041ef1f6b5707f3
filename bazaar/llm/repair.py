"""Conversation structure repair with a run-length dynamic programme.

A conversation should read ``(s?(ua)+)?`` by its roles' initials: an optional
system turn, then user and assistant in turn.  Faulty rows go or are mended at
the least cost: Keep 0, Rerole (to user or assistant) 1, Delete 2, Insert (an
empty user or assistant turn) 5; a truncated row that stays costs 5; blank and
duplicate rows must go.  Of equally cheap repairs the one whose edits' initials
(D, I, K, R) are least in ASCII order is taken.

A row is a symbol (role initial and fault), a symbol is a 4 x 4 min-plus matrix
over what was emitted last (nothing, s, u, a), and a run of n equal symbols is the
matrix's n-th power, put together from cached binary powers.  Costs-to-go come
from the end of a conversation backwards; the choices are then unrolled forwards:
as each letter leads to one state only, the least letter that keeps the optimum is
the least audit.

How it runs, whatever one conversation's share of the rows:

1. Rows without their texts (hashes and flags stand for these) are range-sorted by
   conversation and place and stored with their partition and row number.
2. First occurrences per (conversation, role, text) by aggregation; joined back,
   they tell the duplicates.
3. Every partition multiplies the matrices of its first and last conversation,
   the only ones that can go on elsewhere.  From these two rows a partition, the
   driver finds the cost-to-go at each partition's edge.
4. Every partition unrolls its conversations; one that began before gets a variant
   for each of the four states that it may start in.  The variants' end states
   (at most eight rows a partition) name the one that counts.
5. Rows that stay meet their texts, sorted by conversation and place, and are hashed
   as they pass.  SHA-256 has no parallel form, so the kept texts of one
   conversation do pass one task, as a stream: it holds one batch at a time.

Defined results: a null role or text, and a null id or turn in the damage's key,
counts as one space (so a null text is blank, a null role cannot be kept); rows of
equal turn go by role, then the text's first 64 characters, then its hashes; rows
equal in all four columns are copies of each other; a null conv_id is a
conversation of its own; roles go by their first character; extra columns are
passed over; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm.common import cut, table

#: Costs of the edits, and of keeping a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\f\r"
#: States: nothing emitted, then s, u or a emitted last; what an emitted u or a leads to.
START, S, U, A = range(4)
FOLLOWS = {START: U, S: U, U: A, A: U}
NAMES = {U: "user", A: "assistant"}
#: Cost to finish from each state: only the empty conversation or an assistant may end it.
FINISH = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60
#: Symbols: 0 must go; else 1 + 2 * initial + truncated, with initials s, u, a, other.
GONE = 0
INITIALS = "sua"


# -- min-plus programme --------------------------------------------------------------

def _kept(symbol: int, state: int) -> tuple[int, int] | None:
    """(cost, state) of keeping a row, if the pattern allows."""
    initial, truncated = divmod(symbol - 1, 2)
    if symbol == GONE or initial > 2:
        return None
    to = {0: S, 1: U, 2: A}[initial]
    if (state == START if to == S else FOLLOWS[state] == to):
        return truncated * TRUNCATED, to
    return None


def _reroled(symbol: int, state: int) -> tuple[int, int] | None:
    if symbol == GONE:
        return None
    return REROLE + (symbol - 1) % 2 * TRUNCATED, FOLLOWS[state]


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> tuple[tuple[int, ...], ...]:
    """Transition costs (inserts before each row included) of 2**k rows of one symbol."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    out = []
    for state in range(4):
        row, cost, at = [NEVER] * 4, 0, state
        for _ in range(3):  # no, one or two inserts before the row
            for move in ((DELETE, at), _kept(symbol, at), _reroled(symbol, at)):
                if move:
                    row[move[1]] = min(row[move[1]], cost + move[0])
            cost, at = cost + INSERT, FOLLOWS[at]
        out.append(tuple(row))
    return tuple(out)


def times(a, b):
    """Min-plus product of two matrices."""
    return tuple(tuple(min(NEVER, *(row[k] + b[k][j] for k in range(4))) for j in range(4)) for row in a)


def before(matrix, ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Costs-to-go before some rows, from those behind them."""
    return tuple(min(c + v for c, v in zip(row, ahead)) for row in matrix)


def before_run(symbol: int, n: int, ahead: tuple[int, ...]) -> tuple[int, ...]:
    k = 0
    while n:
        if n & 1:
            ahead = before(power(symbol, k), ahead)
        n, k = n >> 1, k + 1
    return ahead


def run_matrix(runs: list[tuple[int, int]]):
    """The matrix of a sequence of runs; None stands for that of no rows."""
    out = None
    for symbol, n in runs:
        k = 0
        while n:
            if n & 1:
                out = power(symbol, k) if out is None else times(out, power(symbol, k))
            n, k = n >> 1, k + 1
    return out


@lru_cache(maxsize=1 << 16)
def _earlier(symbol: int, ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Costs-to-go before one row, less their minimum (there are few different ones)."""
    out = before(power(symbol, 0), ahead)
    low = min(out)
    return tuple(v - low for v in out)


@lru_cache(maxsize=1 << 16)
def choose(symbol: int, state: int, ahead: tuple[int, ...]) -> tuple[str, int]:
    """The least edits of one row that keep the optimum, and the state behind it."""
    best, letters = before(power(symbol, 0), ahead), ""
    while True:
        if DELETE + ahead[state] == best[state]:
            return letters + "D", state
        if INSERT + best[FOLLOWS[state]] == best[state]:
            letters, state = letters + "I", FOLLOWS[state]
            continue
        for letter, move in (("K", _kept(symbol, state)), ("R", _reroled(symbol, state))):
            if move and move[0] + ahead[move[1]] == best[state]:
                return letters + letter, move[1]


def finish(state: int) -> tuple[str, int]:
    """The inserts that end a conversation."""
    letters = ""
    while FINISH[state]:
        letters, state = letters + "I", FOLLOWS[state]
    return letters, state


def normal(costs: tuple[int, ...]) -> tuple[int, ...]:
    low = min(costs)
    return tuple(v - low for v in costs)


def unroll(runs: list[tuple[int, int]], state: int, ahead: tuple[int, ...]) -> tuple[str, list[tuple[str, int] | None], int]:
    """Audit of a sequence of runs, each symbol's letters and state (None: it goes), and the state behind.

    Symbols that must go have no entry of their own: they cost a D each.
    """
    ends = [normal(ahead)]
    for symbol, n in reversed(runs):
        ends.append(normal(before_run(symbol, n, ends[-1])))
    audit, moves = [], []
    for (symbol, n), behind in zip(runs, reversed(ends[:-1])):
        if symbol == GONE:
            audit.append("D" * n)
            continue
        within = [behind]
        for _ in range(n - 1):
            within.append(_earlier(symbol, within[-1]))
        while within:
            letters, state = choose(symbol, state, within.pop())
            audit.append(letters)
            moves.append(None if letters[-1] == "D" else (letters, state))
    return "".join(audit), moves, state


def collapse(symbols: list[int], copies: list[int]) -> list[tuple[int, int]]:
    """Runs of equal symbols; the further copies of a row must go."""
    runs: list[list[int]] = []
    for symbol, n in zip(symbols, copies):
        for part, m in ((symbol, 1), (GONE, n - 1)) if symbol else ((GONE, n),):
            if m and runs and runs[-1][0] == part:
                runs[-1][1] += m
            elif m:
                runs.append([part, m])
    return [(s, n) for s, n in runs]


# -- partitions of sorted rows ----------------------------------------------------------

def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one stored partition after the other; they arrive in that order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = batch.column("part").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                if held and held[0].column("part")[0].as_py() != int(part[a]):
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _segments(t: pa.Table) -> list[tuple[int, int]]:
    """Row ranges of the conversations of a partition."""
    code = t.column("conv_id").combine_chunks().dictionary_encode()
    code = np.asarray((code if isinstance(code, pa.DictionaryArray) else code.chunk(0)).indices.fill_null(-1))
    edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
    return list(zip(edges, edges[1:]))


def _edge_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last conversation of each partition, with the product of its matrices."""
    for t in _parts(batches):
        segments = _segments(t)
        part = t.column("part")[0].as_py()
        for at in sorted({0, len(segments) - 1}):
            a, b = segments[at]
            rows = t.slice(a, b - a)
            matrix = run_matrix(collapse(rows.column("symbol").to_pylist(), rows.column("copies").to_pylist()))
            flat = [v for row in matrix for v in row]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([at == 0]), pa.array([at == len(segments) - 1]), rows.column("conv_id").combine_chunks().slice(0, 1), pa.array([flat], pa.list_(pa.int64()))],
                ["part", "is_first", "is_last", "conv_id", "matrix"])


_EDGES = "part int, is_first boolean, is_last boolean, conv_id {kind}, matrix array<long>"


def chains(edges: list) -> dict[tuple[int, bool], tuple[tuple[int, ...], bool, bool]]:
    """For each piece of a conversation that spans partitions: costs-to-go behind it, whether it begins and ends it.

    Pieces are named by partition and whether they are its first conversation.
    """
    edges = sorted(edges, key=lambda e: (e["part"], not e["is_first"]))
    out, chain = {}, []

    def close():
        ahead = FINISH
        if len(chain) > 1:
            for i, e in reversed(list(enumerate(chain))):
                out[e["part"], e["is_first"]] = normal(ahead), i == 0, i == len(chain) - 1
                flat = e["matrix"]
                ahead = normal(before([flat[j:j + 4] for j in range(0, 16, 4)], ahead))

    for e in edges:
        if chain and not (e["is_first"] and chain[-1]["conv_id"] == e["conv_id"]):
            close()
            chain = []
        chain.append(e)
    close()
    return out


_NUMBERS = ("blank", "duplicate", "truncated", "illegal", "cost", "low", "high", "turns", "first_turn", "last_turn", "first_initial", "last_initial")
_PIECES = ("conv_id {kind}, variant long, ends int, part int, audit string, tail string, numbers array<long>, "
           "row long, lead string, as_role string")


def _pieces(spans: dict):
    """A row for each conversation of a partition, and one for each of its rows that stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _parts(batches):
            part, segments = t.column("part")[0].as_py(), _segments(t)
            symbols, copies, blank, initial, turn, role = (t.column(c).to_pylist() for c in ("symbol", "copies", "blank", "initial", "turn", "role"))
            rows = t.column("row").to_numpy()
            out: list[tuple] = []
            for at, (a, b) in enumerate(segments):
                span = spans.get((part, at == 0)) if at in (0, len(segments) - 1) else None
                ahead, begins, ends = span or (FINISH, True, True)
                runs = collapse(symbols[a:b], copies[a:b])
                fresh = [i for i in range(a, b) if symbols[i]]
                counts = _counts(symbols[a:b], copies[a:b], blank[a:b], initial[a:b], turn[a:b])
                for state in (START,) if begins else range(4):
                    variant = ((part * 2 + (at == 0)) * 4 + state) if span else -1
                    audit, moves, last = unroll(runs, state, ahead)
                    tail = ""
                    if ends:
                        letters, _ = finish(last)
                        audit, tail = audit + letters, _inserted(last, len(letters))
                    cost = DELETE * audit.count("D") + REROLE * audit.count("R") + INSERT * audit.count("I")
                    cost += TRUNCATED * sum(1 for i, move in zip(fresh, moves) if move and (symbols[i] - 1) % 2)
                    out.append((a, variant, last, audit, tail, [counts[0], counts[1], counts[2], counts[3], cost, *counts[4:]], None, None, None))
                    came = state
                    for i, move in zip(fresh, moves):
                        if move:
                            letters, to = move
                            out.append((a, variant, None, None, None, None, int(rows[i]), _inserted(came, len(letters) - 1), NAMES[to] if letters[-1] == "R" else role[i]))
                            came = to
                if len(out) > 20_000:
                    yield _pack(out, t, part)
                    out = []
            if out:
                yield _pack(out, t, part)

    def _pack(out, t, part):
        first, *cols = zip(*out)
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string()]
        variant, ends, audit, tail, numbers, row, lead, as_role = (pa.array(c, k) for c, k in zip(cols, kinds))
        conv = t.column("conv_id").combine_chunks().take(pa.array(first))
        return pa.RecordBatch.from_arrays([conv, variant, ends, pa.array([part] * len(out), pa.int32()), audit, tail, numbers, row, lead, as_role],
                                          ["conv_id", "variant", "ends", "part", "audit", "tail", "numbers", "row", "lead", "as_role"])

    return run


def _inserted(state: int, n: int) -> str:
    """Initials of n turns inserted in a state."""
    out = ""
    for _ in range(n):
        state = FOLLOWS[state]
        out += NAMES[state][0]
    return out


def _counts(symbols, copies, blank, initial, turn) -> list:
    """Faults and turns of a conversation's rows in one partition."""
    n_blank = sum(n for n, empty in zip(copies, blank) if empty)
    fresh = sum(1 for s in symbols if s)
    duplicate = sum(copies) - n_blank - fresh
    truncated = sum(1 for s in symbols if s and (s - 1) % 2)
    illegal = sum(n - 1 for n in copies) + sum(1 for pair in zip(initial, initial[1:]) if pair not in LEGAL)
    known = [x for x in turn if x is not None]
    turns = sum(1 for x, y in zip(known, known[1:]) if x != y) + bool(known)
    return [n_blank, duplicate, truncated, illegal, *((known[0], known[-1]) if known else (None, None)), turns,
            turn[0], turn[-1], initial[0], initial[-1]]


LEGAL = {(0, 1), (1, 2), (2, 1)}


# -- hashing as rows pass --------------------------------------------------------------

_RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Reader:
    """One conversation's result from its sorted rows: id, pieces, then kept rows each followed by their text."""

    def __init__(self):
        self.audit, self.tail, self.sums = [], "", [0] * 5
        self.low = self.high = self.last = None
        self.turns, self.hash, self.lines, self.waiting = 0, hashlib.sha256(), 0, None

    def piece(self, audit, tail, numbers):
        n = dict(zip(_NUMBERS, numbers))
        if self.last is not None:
            turn, initial = self.last
            self.sums[3] += (initial, n["first_initial"]) not in LEGAL
            self.turns -= turn is not None and turn == n["first_turn"]
        self.sums = [x + n[c] for x, c in zip(self.sums, _NUMBERS)]
        self.turns += n["turns"]
        if n["low"] is not None:
            self.low = n["low"] if self.low is None else min(self.low, n["low"])
            self.high = n["high"] if self.high is None else max(self.high, n["high"])
        self.audit.append(audit)
        self.tail += tail
        self.last = n["last_turn"], n["last_initial"]

    def line(self, role: str, text: str):
        self.hash.update((("\n" if self.lines else "") + role + ":").encode("utf-8", "surrogatepass"))
        self.hash.update(text.encode("utf-8", "surrogatepass"))
        self.lines += 1

    def inserts(self, initials: str):
        for x in initials:
            self.line("user" if x == "u" else "assistant", "")

    def result(self) -> tuple:
        self.inserts(self.tail)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.sums, "".join(self.audit), self.hash.hexdigest())


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = object()
    ids, results, now, reader, kind = [], [], nothing, None, None

    def packed():
        cols = list(zip(*results))
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.string()), pa.array(cols[7], pa.string())],
                                          ["conv_id", *_RESULT, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for i in range(0, len(batch), 1000):
            part = batch.slice(i, 1000)
            columns = (part.column(c).to_pylist() for c in ("conv_id", "sort", "audit", "tail", "numbers", "row", "lead", "as_role", "text"))
            for conv, sort, audit, tail, numbers, row, lead, as_role, text in zip(*columns):
                if reader is None or conv != now:
                    if reader is not None:
                        ids.append(now)
                        results.append(reader.result())
                    now, reader = conv, _Reader()
                if sort == 1:
                    reader.piece(audit, tail, numbers)
                elif sort == 2:
                    reader.inserts(lead)
                    reader.line(as_role, text)
        if len(ids) > 5000:
            yield packed()
            ids, results = [], []
    if reader is not None:
        ids.append(now)
        results.append(reader.result())
    if ids:
        yield packed()


# -- Spark -------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after damage by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and
    question marks, 3 repeats it (two copies), 4 makes it the user's.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = spaced("text")
    return rows.select("conv_id", "turn", spaced("role").alias("role"), text.alias("text"), hit.alias("hit")).where("hit <> 0").select(
        "conv_id", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("hit") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"))


_PLACE = ("turn", "role", "start", "h1", "h2")


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with what they are ordered by inside a conversation (null turns first)."""
    return rows.withColumns({"start": F.substring("text", 1, 64), "h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def _in_order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in _PLACE]


def marked(rows: DataFrame) -> DataFrame:
    """Sorted rows without texts: part and row (where they lie), conv_id, the columns of their place, symbol, initial, blank, copies.

    ``rows`` as ``damaged`` gives them, without nulls in role and text.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == x, F.lit(i)) for i, x in enumerate(INITIALS)], F.lit(3))
    narrow = _placed(rows).select("conv_id", *_PLACE, "copies", (F.length(trimmed) == 0).alias("blank"), initial.alias("initial"),
                                  (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).cast("int").alias("open"), F.monotonically_increasing_id().alias("_tie"))
    order = [F.col("conv_id").asc_nulls_first(), *_in_order(), F.col("_tie")]
    lying = cut(narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
                .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}))
    # Stored, so that the join's two sides are plain shuffles and Spark can split a hot text.
    name = ["conv_id", "role", "h1", "h2"]
    again = cut(lying.where("NOT blank").groupBy(*name).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
                .select(*(F.col(c).alias(f"_{c}") for c in name), "first"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    goes = F.col("blank") | F.coalesce(F.col("row") != F.col("first"), F.lit(False))
    symbol = F.when(goes, F.lit(GONE)).otherwise(1 + 2 * F.col("initial") + F.col("open")).cast("int")
    return lying.join(again, same, "left").select("part", "row", "conv_id", *_PLACE, symbol.alias("symbol"), "initial", "blank", "copies")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, copies): the faults and the cheapest repair.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    symbols = cut(marked(rows))
    in_parts = symbols.repartition("part").sortWithinPartitions("part", "row")
    edges = in_parts.select("part", "conv_id", "symbol", "copies").mapInArrow(_edge_matrices, _EDGES.format(kind=kind)).collect()  # two rows a partition
    spans = chains(edges)
    numbered = in_parts.select("part", "row", "conv_id", F.col("turn").cast("long").alias("turn"), "role", "symbol", "initial", "blank", "copies")
    pieces = cut(numbered.mapInArrow(_pieces(spans), _PIECES.format(kind=kind)))

    # Which variant of each piece counts: its start is the end of the piece before.
    ends = {r["variant"]: r["ends"] for r in pieces.where("variant >= 0 AND row IS NULL").select("variant", "ends").collect()}  # at most eight rows a partition
    state, taken = START, [-1]
    for (part, first), (_, begins, _) in sorted(spans.items(), key=lambda x: (x[0][0], not x[0][1])):
        variant = (part * 2 + first) * 4 + (START if begins else state)
        taken.append(variant)
        state = ends[variant]
    counted = pieces.where(F.array_contains(F.lit(taken).cast("array<bigint>"), F.col("variant")))

    # A kept row meets its text under the same name; equal rows share one kept row at most.
    stays = counted.where("row IS NOT NULL").select("row", "lead", "as_role")
    named = symbols.select("row", "conv_id", *_PLACE).join(stays, "row")
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    kept = named.select("conv_id", *_PLACE, F.lit(0).alias("of"), "lead", "as_role", none("text", "string"))
    texts = _placed(rows).select("conv_id", *_PLACE, F.lit(1).alias("of"), none("lead", "string"), none("as_role", "string"), "text")
    met = kept.unionByName(texts).select("conv_id", F.lit(2).alias("sort"), none("part", "int"), *_PLACE, "of", none("audit", "string"), none("tail", "string"), none("numbers", "array<long>"), none("row", "long"), "lead", "as_role", "text")
    whole = counted.where("row IS NULL").select("conv_id", F.lit(1).alias("sort"), "part", *(F.lit(None).cast(rows.schema[c].dataType if c in rows.columns else {"start": "string"}.get(c, "long")).alias(c) for c in _PLACE),
                                                F.lit(0).alias("of"), "audit", "tail", "numbers", none("row", "long"), none("lead", "string"), none("as_role", "string"), none("text", "string"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("sort"), F.col("part"), *_in_order(), F.col("of")]
    streamed = whole.unionByName(met).repartition("conv_id").sortWithinPartitions(*order)
    result = ", ".join(f"{c} long" for c in _RESULT)
    return streamed.mapInArrow(_paired, f"conv_id {kind}, {result}, audit string, repaired_sha256 string")


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hands each kept row the first text that follows it; the other texts are passed over."""
    waiting: list = [None]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sort, of = batch.column("sort").to_numpy(), batch.column("of").to_numpy()
        lead, as_role = batch.column("lead").to_pylist(), batch.column("as_role").to_pylist()
        keep = np.ones(len(batch), dtype=bool)
        for i in np.flatnonzero(sort == 2):
            if of[i] == 0:
                waiting[0], keep[i] = (lead[i], as_role[i]), False
            elif waiting[0] is None:
                keep[i] = False
            else:
                lead[i], as_role[i] = waiting[0]
                waiting[0] = None
        names = ["conv_id", "sort", "audit", "tail", "numbers", "row", "lead", "as_role", "text"]
        new = {"lead": pa.array(lead, pa.string()), "as_role": pa.array(as_role, pa.string())}
        return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names).filter(pa.array(keep))

    return _finished(run(b) for b in batches)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``conversations`` after damage."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair(damaged(rows))
    # Conversations that lost all their rows have nothing to repair.
    ids = rows.select(F.col("conv_id").alias("_id")).distinct()
    joined = ids.join(done, F.col("_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("_id", "conv_id")
    empty = hashlib.sha256().hexdigest()
    return joined.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _RESULT), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
