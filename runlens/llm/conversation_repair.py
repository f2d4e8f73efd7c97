"""Least repair of conversations by dynamic programming over grammar-compressed sequences.

A conversation must read `(s?(ua)+)?`: nothing, or user and assistant in turn to an answer, after
one system turn at most. Each row may be kept, given another role, or deleted, and empty turns may be
put in; the cheapest edits win, at equal cost those whose letters come first in ASCII.

A row is a symbol: what its role and fault allow. Its transfer matrix holds, for each state before
and after it, the least cost and the letters of the edits, insertions before the row included; a
conversation is the min-plus product of its rows' matrices. Re-Pair replaces the most frequent pair
of neighbours in all sequences at hand by a new symbol, again and again; a rule's matrix is the
product of its two parts', computed once, bottom-up, and shared by all conversations that use it.
Letters are ropes that share their parts. Letters of equal cost between the same two states are never
a beginning of each other, as insertions come before a row and each costs, so the order of ropes
holds under joining, and products may be taken in any order.

Rows of a conversation are worked on together up to `MAX_ROWS` rows and `MAX_BYTES` of text. A larger
one is cut into chunks by range: each chunk gives its matrix, as costs and ranks of letters, and its
counts; these few numbers are joined in order, which fixes the states at all cuts; then each chunk
is repaired between its states, and the pieces are put together in a stream.

Rows that share a turn follow each other by role and MD5 of the text. Null turns come first and do
not count for gaps; a null conversation id, role or text stands for one space, and rows without an
id are one conversation. A role is known by its first letter; one that is neither of s, u and a must
change or go. A text is never cut. Empty tables give no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from runlens.session import stage

#: Rows and bytes of text of a conversation that one task holds at once.
MAX_ROWS = 20_000
MAX_BYTES = 64 << 20
#: Rules of one grammar, and rules whose matrices a worker keeps.
RULES = 256
KEPT_RULES = 1 << 14
#: Deeper rules stand for too many rows to be met again by name.
NAMED_DEPTH = 6
#: Rows whose sequences share a grammar, with their texts held meanwhile.
SHARED_ROWS = 4096
SHARED_BYTES = 8 << 20

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
_RENAME, _REMOVE, _ADD, _UNFINISHED = 2, 3, 2, 1
#: States: nothing yet, after a system, a user, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: Symbols: 0 must go; else one more than the role's place here, and four more when truncated.
_ROLES = "sua"
_SPACE = " \t\n\v\f\r"
NONE = -1


# --- ropes ---------------------------------------------------------------------------------------

class Rope:
    """Letters as a tree of shared parts."""

    __slots__ = ("left", "right", "text", "size")

    def __init__(self, left: Rope | None, right: Rope | None, text: str = "") -> None:
        self.left, self.right, self.text = left, right, text
        self.size = len(text) if left is None else left.size + right.size

    def __add__(self, other: Rope) -> Rope:
        if not self.size:
            return other
        if not other.size:
            return self
        if self.size + other.size <= 32:
            return Rope(None, None, str(self) + str(other))
        return Rope(self, other)

    def __str__(self) -> str:
        if self.left is None:
            return self.text
        parts, rest = [], [self]
        while rest:
            rope = rest.pop()
            if rope.left is None:
                parts.append(rope.text)
            else:
                rest += (rope.right, rope.left)
        return "".join(parts)


EMPTY = Rope(None, None)


def before(a: Rope, b: Rope) -> bool:
    """Whether the letters of `a` come before those of `b`; shared parts are passed over whole."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if x.left is not None and (x.size >= y.size or y.left is None):
            left += (x.right, x.left)
            right.append(y)
        elif y.left is not None:
            right += (y.right, y.left)
            left.append(x)
        else:
            n = min(x.size, y.size)
            if x.text[:n] != y.text[:n]:
                return x.text[:n] < y.text[:n]
            if x.size > n:
                left.append(Rope(None, None, x.text[n:]))
            if y.size > n:
                right.append(Rope(None, None, y.text[n:]))
    return bool(right)


# --- transfer matrices ---------------------------------------------------------------------------

#: Least cost and letters from state to state, row after row; None where there is no way.
Matrix = tuple


def _least(ways: Iterable[tuple[int, Rope] | None]) -> tuple[int, Rope] | None:
    best = None
    for way in ways:
        if way is not None and (best is None or way[0] < best[0] or (
                way[0] == best[0] and before(way[1], best[1]))):
            best = way
    return best


def _then(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    return None if a is None or b is None else (a[0] + b[0], a[1] + b[1])


def product(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product; `a` may have fewer rows, such as one for a known state."""
    return tuple(tuple(_least(_then(row[m], b[m][q]) for m in range(STATES))
                       for q in range(STATES)) for row in a)


def _inserted() -> Matrix:
    """Turns put in between two states: never a whole round, which would change nothing."""
    after = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
    rows = []
    for start in range(STATES):
        row: list = [None] * STATES
        row[start] = (0, EMPTY)
        at = start
        for n in range(1, STATES):
            at = after[at]
            if row[at] is None:
                row[at] = (_ADD * n, Rope(None, None, INSERT * n))
        rows.append(tuple(row))
    return tuple(rows)


INSERTED = _inserted()


def _edit(symbol: int) -> Matrix:
    """One row's own edit."""
    def way(cost: int, letter: str) -> tuple[int, Rope]:
        return cost, Rope(None, None, letter)

    rows = []
    for state in range(STATES):
        row: list = [None] * STATES
        row[state] = way(_REMOVE, DELETE)
        if symbol:
            rest = _UNFINISHED if symbol > STATES else 0
            role = (symbol - 1) % STATES
            to = ASSISTANT if state == USER else USER
            row[to] = way(_RENAME + rest, REROLE)
            kept = {0: SYSTEM, 1: USER, 2: ASSISTANT}.get(role)
            if kept == to or (kept == SYSTEM and state == NOTHING):
                row[kept] = way(rest, KEEP)
        rows.append(tuple(row))
    return tuple(rows)


TERMINALS = [product(INSERTED, _edit(symbol)) for symbol in range(1 + 2 * STATES)]
START: Matrix = (((0, EMPTY), None, None, None),)


def finished(row: Sequence) -> tuple[int, Rope]:
    """Cheapest way to an end, of ways to all states after the last row."""
    closed = product((tuple(row),), INSERTED)[0]
    return _least((closed[NOTHING], closed[ASSISTANT]))


class Grammar:
    """Rules met so far and their matrices; the least used rules are forgotten.

    Symbols are numbers: below `len(TERMINALS)` a row, above a pair of symbols.
    """

    def __init__(self, keep: int = KEPT_RULES) -> None:
        self.keep = keep
        self.matrices: OrderedDict[tuple, Matrix] = OrderedDict()

    def evaluated(self, rules: list[tuple[int, int]]) -> list[Matrix]:
        """Matrices of the terminals and of `rules`, bottom-up.

        A rule is known by the rows it stands for, so grammars of different sequences share it.
        """
        found = list(TERMINALS)
        names: list = list(range(len(TERMINALS)))
        depths = [0] * len(names)
        for a, b in rules:
            depth = 1 + max(depths[a], depths[b])
            name = (names[a], names[b]) if depth <= NAMED_DEPTH else None
            matrix = self.matrices.get(name) if name else None
            if matrix is None:
                matrix = product(found[a], found[b])
                if name:
                    self.matrices[name] = matrix
                    if len(self.matrices) > self.keep:
                        self.matrices.popitem(last=False)
            else:
                self.matrices.move_to_end(name)
            found.append(matrix)
            names.append(name)
            depths.append(depth)
        return found


def re_pair(sequences: list[np.ndarray], most: int = RULES) -> tuple[
        list[tuple[int, int]], list[np.ndarray]]:
    """Rules, and the sequences written with them: the most frequent pair first, again and again."""
    rules: list[tuple[int, int]] = []
    first = len(TERMINALS)
    text = np.concatenate([np.append(s, NONE) for s in sequences]) if sequences else (
        np.empty(0, np.int64))
    base = first + most + 1
    while len(rules) < most:
        inner = (text[:-1] >= 0) & (text[1:] >= 0)
        pairs = np.where(inner, text[:-1] * base + text[1:], NONE)
        values, counts = np.unique(pairs[inner], return_counts=True)
        if not len(values) or counts.max() < 2:
            break
        best = int(values[counts.argmax()])
        at = np.flatnonzero(pairs == best)
        if best // base == best % base and len(at):  # in a run of equal symbols, every other one
            run = np.cumsum(np.concatenate([[True], np.diff(at) != 1])) - 1
            starts = at[np.concatenate([[True], np.diff(run) > 0])]
            at = at[(at - starts[run]) % 2 == 0]
        if len(at) < 2:
            break
        text[at] = first + len(rules)
        text = np.delete(text, at + 1)
        rules.append((best // base, best % base))
    ends = np.flatnonzero(text == NONE)
    return rules, [part[part >= 0] for part in np.split(text, ends + 1)[:-1]]


def tree_product(matrices: list[Matrix]) -> Matrix:
    """Product in order, as a balanced tree."""
    while len(matrices) > 1:
        matrices = [product(*matrices[at:at + 2]) if at + 1 < len(matrices) else matrices[at]
                    for at in range(0, len(matrices), 2)]
    return matrices[0]


def repaired_row(symbols: np.ndarray, matrices: list[Matrix], start: Matrix = START) -> tuple:
    """Ways from a start to all states after the sequence."""
    if len(symbols) > 64:
        return product(start, tree_product([matrices[s] for s in symbols]))[0]
    for symbol in symbols:
        start = product(start, matrices[symbol])
    return start[0]


# --- conversations -------------------------------------------------------------------------------

def symbol_of(role: str, text: str, again: bool) -> tuple[int, int]:
    """Symbol of a row, and its fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    said = text.rstrip(_SPACE)
    if not said:
        return 0, 1
    if again:
        return 0, 2
    kind = 1 + (_ROLES.find(role[0]) if role and role[0] in _ROLES else 3)
    if said[-1] in ".!?":
        return kind, 0
    return kind + STATES, 3


_LEGAL = {"su", "ua", "au"}


@dataclass
class Part:
    """A conversation, or a chunk of one."""

    key: tuple
    id: object
    rows: list = field(default_factory=list)
    symbols: list = field(default_factory=list)
    faults: list = field(default_factory=lambda: [0, 0, 0, 0])
    seen: set = field(default_factory=set)
    illegal: int = 0
    turns: list = field(default_factory=lambda: [None, None, 0])
    initials: list = field(default_factory=lambda: [None, None])

    def add(self, turn: int | None, role: str, text: str, again: bool | None) -> None:
        """Take the next row; `again` is None where this part must tell itself."""
        data = text.encode()
        if again is None:
            digest = hashlib.blake2b(role.encode() + b"\0" + data, digest_size=16).digest()
            again = digest in self.seen
            self.seen.add(digest)
        symbol, fault = symbol_of(role, text, again)
        self.faults[fault] += 1
        self.symbols.append(symbol)
        self.rows.append((role, data if symbol else b""))
        initial = role[:1]
        if self.initials[0] is None:
            self.initials[0] = initial
        elif self.initials[1] + initial not in _LEGAL:
            self.illegal += 1
        self.initials[1] = initial
        if turn is not None:
            if self.turns[0] is None:
                self.turns[0] = turn
            if self.turns[1] != turn:
                self.turns[2] += 1
            self.turns[1] = turn

    @property
    def gaps(self) -> int:
        low, high, distinct = self.turns
        return 0 if low is None else high - low + 1 - distinct


def edited(rows: Iterable[tuple[str, bytes]], audit: str, state: int = NOTHING) -> Iterator[bytes]:
    """Lines `role:text` that the edits make of the rows, from a state."""
    rows = iter(rows)
    for letter in audit:
        if letter == DELETE:
            next(rows)
            continue
        to = ASSISTANT if state == USER else USER
        name, text = ("assistant" if to == ASSISTANT else "user"), b""
        if letter != INSERT:
            role, text = next(rows)
            if letter == KEEP:
                name = role
                to = SYSTEM if role[:1] == "s" else to
        state = to
        yield name.encode() + b":" + text


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """Conversations, or chunks, of rows that come sorted."""
    part = None
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in (
            "key", "part", "conv_id", "turn", "role", "text", "again", "gone")]
        for key, chunk, id_, turn, role, text, again, gone in zip(*columns):
            if part is None or part.key != (key, chunk):
                if part is not None:
                    yield part
                part = Part((key, chunk), id_)
            if not gone:
                part.add(turn, role, text, again)
    if part is not None:
        yield part


def _shared(parts: Iterator[Part], grammar: Grammar) -> Iterator[tuple[Part, np.ndarray, list]]:
    """Parts with their sequences in a grammar made of all that are at hand together."""

    def solved(held: list[Part]):
        distinct = list(dict.fromkeys(tuple(part.symbols) for part in held))
        rules, written = re_pair([np.array(s, np.int64) for s in distinct])
        matrices = grammar.evaluated(rules)
        by_rows = dict(zip(distinct, written))
        for part in held:
            yield part, by_rows[tuple(part.symbols)], matrices

    held, rows, size = [], 0, 0
    for part in parts:
        held.append(part)
        rows += len(part.symbols)
        size += sum(len(text) for _, text in part.rows)
        if rows >= SHARED_ROWS or size >= SHARED_BYTES:
            yield from solved(held)
            held, rows, size = [], 0, 0
    if held:
        yield from solved(held)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _whole(id_type: pa.DataType):
    """Repair of whole conversations."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(3 + len(_COUNTS))]
        solved: dict[tuple, tuple[int, str]] = {}
        last = None
        for part, written, matrices in _shared(_parts(batches), Grammar()):
            if matrices is not last:
                solved, last = {}, matrices
            sequence = tuple(written.tolist())
            if sequence not in solved:
                cost, rope = finished(repaired_row(written, matrices))
                solved[sequence] = cost, str(rope)
            cost, audit = solved[sequence]
            digest = hashlib.sha256(b"\n".join(edited(part.rows, audit))).hexdigest()
            for column, value in zip(out, (part.id, part.gaps, *part.faults[1:], part.illegal,
                                           cost, audit, digest)):
                column.append(value)
            if len(out[0]) >= SHARED_ROWS:
                yield _batch(out, id_type)
                out = [[] for _ in out]
        if out[0]:
            yield _batch(out, id_type)

    return repair


def _batch(columns: list[list], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(columns, kinds)],
        ["conv_id", *_COUNTS, "audit", "repaired_sha256"])


# --- conversations in chunks ---------------------------------------------------------------------

_CHUNK = ("key string, part int, blank long, duplicate long, truncated long, illegal long, "
          "first string, last string, low long, high long, turns long, n long, "
          "cost array<long>, place array<int>")
_CUTS = "key string, part int, entry int, leave int, closing string, " + ", ".join(
    f"{name} long" for name in _COUNTS)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, costs and places of the letters of each chunk's ways from state to state."""
    for part, written, matrices in _shared(_parts(batches), Grammar()):
        whole = tree_product([matrices[s] for s in written]) if len(written) else INSERTED
        cost, place = [], []
        for row in whole:
            order = sorted((str(way[1]), q) for q, way in enumerate(row) if way and len(written))
            rank = {q: at for at, (_, q) in enumerate(order)}
            cost += [way[0] if way else NONE for way in row]
            place += [rank.get(q, 0) for q in range(STATES)]
        yield pa.RecordBatch.from_pylist([{
            "key": part.key[0], "part": part.key[1], "blank": part.faults[1],
            "duplicate": part.faults[2], "truncated": part.faults[3], "illegal": part.illegal,
            "first": part.initials[0], "last": part.initials[1], "low": part.turns[0],
            "high": part.turns[1], "turns": part.turns[2], "n": len(part.symbols), "cost": cost,
            "place": place}], pa.schema([
                ("key", pa.string()), ("part", pa.int32()),
                *[(name, pa.int64()) for name in ("blank", "duplicate", "truncated", "illegal")],
                ("first", pa.string()), ("last", pa.string()),
                *[(name, pa.int64()) for name in ("low", "high", "turns", "n")],
                ("cost", pa.list_(pa.int64())), ("place", pa.list_(pa.int32()))]))


def cuts(chunks: pd.DataFrame) -> pd.DataFrame:
    """States at both ends of every chunk of a conversation, and its counts, beside each chunk.

    From the end, the cost to finish from each state; from the start, the chunk's way of least cost
    in all, at equal cost the one whose letters come first. These never begin alike to the end, so
    the choice within a chunk is final. Chunks without rows are passed over.
    """
    chunks = chunks.sort_values("part")
    held = chunks[chunks["n"] > 0]
    closing = [finished([(0, EMPTY) if q == state else None for q in range(STATES)])
               for state in range(STATES)]
    to_go = [[way[0] for way in closing]]
    costs = [np.array(cost).reshape(STATES, STATES) for cost in held["cost"]]
    for cost in reversed(costs):
        to_go.append([min(cost[p, q] + to_go[-1][q] for q in range(STATES) if cost[p, q] >= 0)
                      for p in range(STATES)])
    to_go.reverse()
    state, entry, leave = NOTHING, [], []
    for at, (cost, place) in enumerate(zip(costs, held["place"])):
        place = np.array(place).reshape(STATES, STATES)
        entry.append(state)
        state = min((int(cost[state, q]) + to_go[at + 1][q], int(place[state, q]), q)
                    for q in range(STATES) if cost[state, q] >= 0)[2]
        leave.append(state)
    seen = held[held["turns"] > 0]
    low, high = list(seen["low"]), list(seen["high"])
    distinct = int(seen["turns"].sum()) - sum(a == b for a, b in zip(high, low[1:]))
    joints = sum(a + b not in _LEGAL for a, b in zip(held["last"], held["first"].iloc[1:]))
    figures = {
        "gaps": int(high[-1] - low[0] + 1 - distinct) if low else 0,
        **{name: int(held[name].sum()) for name in ("blank", "duplicate", "truncated")},
        "illegal": int(held["illegal"].sum()) + joints, "cost": int(to_go[0][NOTHING])}
    out = pd.DataFrame({"key": chunks["key"], "part": chunks["part"]})
    out["entry"], out["leave"] = NOTHING, NOTHING
    out.loc[held.index, "entry"], out.loc[held.index, "leave"] = entry, leave
    out["closing"] = ""
    if len(held):
        out.loc[held.index[-1], "closing"] = str(closing[state][1])
    return out.assign(**figures)


def _pieces(id_type: pa.DataType):
    """Letters and repaired lines of each chunk between its states, in pieces of bounded size."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = ("key", "part", "entry", "leave", "closing", *_COUNTS)
                for row in zip(*[batch.column(name).to_pylist() for name in names]):
                    states[row[:2]] = row[2:]
                yield batch

        for part, written, matrices in _shared(_parts(noted()), Grammar()):
            entry, leave, closing, *figures = states.pop(part.key)
            audit = ""
            if len(written):
                start = (tuple((0, EMPTY) if q == entry else None for q in range(STATES)),)
                audit = str(repaired_row(written, matrices, start)[leave][1])
            audit += closing
            lines, size, no = [], 0, 0
            for line in edited(part.rows, audit, entry):
                lines.append(line)
                size += len(line) + 1
                if size >= SHARED_BYTES:
                    yield _piece(part, no, "", lines, figures, id_type)
                    lines, size, no = [], 0, no + 1
            yield _piece(part, no, audit, lines, figures, id_type)

    return repair


def _piece(part: Part, no: int, audit: str, lines: list[bytes], figures: list[int],
           id_type: pa.DataType) -> pa.RecordBatch:
    values = [part.key[0], part.key[1], no, part.id, *figures, audit,
              b"\n".join(lines) if lines else None]
    kinds = [pa.string(), pa.int32(), pa.int32(), id_type, *[pa.int64()] * len(_COUNTS),
             pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array([value], kind) for value, kind in zip(values, kinds)],
        ["key", "part", "no", "conv_id", *_COUNTS, "audit", "lines"])


def _joined(id_type: pa.DataType):
    """Conversations of pieces that come in order: the digest runs on, the letters are joined."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, audit, row, empty = None, None, [], (), True

        def done() -> pa.RecordBatch:
            return _batch([[value] for value in (*row, "".join(audit), digest.hexdigest())],
                          id_type)

        for batch in batches:
            names = ("key", "conv_id", *_COUNTS, "audit", "lines")
            for key, *rest, letters, lines in zip(*[batch.column(x).to_pylist() for x in names]):
                if key != now:
                    if now is not None:
                        yield done()
                    now, digest, audit, empty = key, hashlib.sha256(), [], True
                row = rest
                audit.append(letters)
                if lines is not None:
                    digest.update(lines if empty else b"\n" + lines)
                    empty = False
        if now is not None:
            yield done()

    return join


# --- Spark ---------------------------------------------------------------------------------------

def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows damaged by the CRC-32 of `conv_id:turn`, modulo 20: 0 drops, 1 empties, 2 takes the
    marks `.!?`, 3 repeats, 4 sets role user. Dropped rows stay, marked `gone`."""
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(spaced(id_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    text = spaced(text_col)
    return rows.select(
        F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(spaced(role_col)).alias("role"),
        F.when(fate <= 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(
            text).alias("text"),
        (fate == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def repair(rows: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Faults and least repair of conversations: rows of conv_id, turn, role, text, maybe `gone`.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    kind = rows.schema["conv_id"].dataType
    id_type = to_arrow_type(kind)
    out = f"conv_id {kind.simpleString()}, " + ", ".join(
        f"{name} long" for name in _COUNTS) + ", audit string, repaired_sha256 string"
    rows = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.coalesce(gone, F.lit(False)).alias("gone"))
    rows = stage(rows.withColumn("digest", F.md5(F.col("text").cast("binary"))), "turns")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"),
                                    F.sum(F.octet_length("text")).alias("bytes"))
    large = sizes.filter((F.col("n") > max_rows) | (F.col("bytes") > max_bytes))
    total = large.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    order = [F.asc_nulls_first("turn"), "role", "digest"]
    blank = {"part": F.lit(0), "again": F.lit(None).cast("boolean")}
    if total["n"] is None:
        together = rows.withColumns(blank).repartition("key").sortWithinPartitions("key", *order)
        return together.mapInArrow(_whole(id_type), out)

    keys = stage(large.select("key"), "large")
    small = rows.join(keys, "key", "left_anti").withColumns(blank).repartition("key")
    whole = small.sortWithinPartitions("key", *order).mapInArrow(_whole(id_type), out)
    pieces = 1 + max(ceil(2 * total["n"] / max_rows), ceil(2 * total["bytes"] / max_bytes))
    cut = rows.join(keys, "key", "left_semi").repartitionByRange(
        pieces, "key", *order).withColumns({
            "part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    cut = stage(cut, "chunks")
    # The first row of a role and text is that of least turn; of its copies, any one.
    firsts = cut.filter("not gone").groupBy("key", "role", "digest").agg(F.min(F.struct(
        F.col("turn").isNotNull().alias("dated"), "turn", "part", "row")).alias("first"))
    firsts = firsts.select("key", "role", "digest", F.col("first.row").alias("first_row"))
    cut = stage(cut.join(firsts, ["key", "role", "digest"], "left").withColumn(
        "again", F.coalesce(F.col("row") != F.col("first_row"), F.lit(False))).drop("first_row"),
        "chunks")
    order = ["key", "part", *order, "row"]
    chunks = cut.repartition("key", "part").sortWithinPartitions(*order).mapInArrow(
        _matrices, _CHUNK)
    ends = stage(chunks.groupBy("key").applyInPandas(cuts, _CUTS), "cuts")
    made = cut.join(ends, ["key", "part"]).repartition("key", "part").sortWithinPartitions(
        *order).mapInArrow(_pieces(id_type), "key string, part int, no int, " + out.replace(
            "repaired_sha256 string", "lines binary"))
    joined = made.repartition("key").sortWithinPartitions("key", "part", "no").mapInArrow(
        _joined(id_type), out)
    return whole.unionByName(joined)
