"""Conversation structure repair: cheapest edits by integers that hold cost and audit at once.

Rows of a conversation are kept, given another role, deleted, or joined by inserted empty
turns until the initials of the roles read ``(s?(ua)+)?``. A path of edits weighs one integer:
its high digits are the cost, below them stands one base-8 digit per edit at the edit's place,
the first edit highest, and zeros after the last. The smaller integer is therefore the cheaper
path and, among equal costs, the one whose letters come first in ASCII order. The graph of
(rows done, role last given) is acyclic and its shortest path is an integer minimum per node.
Paths compared at a node have taken the same rows and do not end in an insertion they could
share, so neither's letters begin the other's: the smaller stays the smaller whatever follows.

Rows are dealt out by ranges of (conversation, turn, place), so a conversation of any size is
spread over as many tasks as its rows need. One that lies inside a task is solved there. Of
the others each task reduces its part to the cost from any first to any last state, with the order of
the letters behind them (32 numbers); these are chained from the end, one row per task and
conversation, and every part is then solved on its own between its two states, in slices.
Nothing holds a whole conversation but the audit itself.

Defined cases: null roles and texts are one space, as is a null conversation or turn in the key of
``damaged``; rows of a null conversation are one conversation; rows of one turn stay in the
order in which the table is read; a conversation without rows has no edits; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quantloom.llm.common import SPACES, partitions, shield
from quantloom.session import stored

#: Costs of the edits, and of leaving a truncated row; letters in ASCII order.
DELETE, RENAME, INSERT, TRUNCATED = 3, 2, 2, 1
LETTERS = "\0DIKR"
DIGIT = {c: i for i, c in enumerate(LETTERS)}
BITS = 3

#: States: nothing given yet, after system, after user, after assistant. A conversation may end in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The state that the role alternating from each state leads to; inserted and renamed rows take that role.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INITIALS = "sua-"
LEGAL = {"su", "ua", "au"}
#: A row's code is its initial's place in INITIALS plus four times its fault.
SOUND, CUT, DUPLICATE, BLANK = range(4)
GONE = 255

#: Rows, and characters, of a slice of a conversation that does not lie in one task.
SLICE_ROWS, SLICE_CHARS = 256, 1 << 20
#: Characters of an output batch.
BATCH_CHARS = 4 << 20


def moves(code: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state: letter, cost and the state after."""
    initial, fault = code % 4, code // 4
    out = [("D", DELETE, state)]
    if fault < DUPLICATE:
        more = TRUNCATED if fault == CUT else 0
        if INITIALS[initial] == "s" and state == START:
            out.append(("K", more, SYSTEM))
        if INITIALS[initial] == "ua"[NEXT[state] == ASSISTANT]:
            out.append(("K", more, NEXT[state]))
        out.append(("R", RENAME + more, NEXT[state]))
    return out


def paths(codes: bytes, start: int, ending: bool) -> dict[int, tuple[int, str]]:
    """Per last state the cost and letters of the best edits of ``codes`` from state ``start``.

    With ``ending`` rows may be inserted after the last, else the last edit is a row's.
    """
    width = BITS * (3 * len(codes) + 2)
    weight = lambda letter, cost, place: (cost << width) + (DIGIT[letter] << (width - BITS * (place + 1)))
    here = {start: (0, 0)}
    for i in range(len(codes) + 1):
        if i == len(codes) and not ending:
            break
        # Insertions: two lead to every state that can be reached without going round.
        for _ in range(2):
            for state, (value, place) in list(here.items()):
                found = (value + weight("I", INSERT, place), place + 1)
                if NEXT[state] not in here or found < here[NEXT[state]]:
                    here[NEXT[state]] = found
        if i == len(codes):
            break
        after: dict[int, tuple[int, int]] = {}
        for state, (value, place) in here.items():
            for letter, cost, to in moves(codes[i], state):
                found = (value + weight(letter, cost, place), place + 1)
                if to not in after or found < after[to]:
                    after[to] = found
        here = after
    out = {}
    for state, (value, place) in here.items():
        letters = "".join(LETTERS[value >> (width - BITS * (k + 1)) & 7] for k in range(place))
        out[state] = (value >> width, letters)
    return out


@lru_cache(maxsize=1 << 16)
def solve(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the best edits of a whole conversation."""
    return min(v for state, v in paths(codes, START, True).items() if state in ENDS)


@lru_cache(maxsize=1 << 12)
def table(codes: bytes) -> dict[int, dict[int, tuple[int, str]]]:
    """``paths`` of a slice from every state."""
    return {state: paths(codes, state, False) for state in range(4)}


#: The ways to end from each state: cost and letters.
TAILS = {state: min(v for s, v in paths(b"", state, True).items() if s in ENDS) for state in range(4)}

Matrix = dict[int, dict[int, tuple[int, int]]]


def ranked(entries: dict[int, tuple[int, object]]) -> dict[int, tuple[int, int]]:
    """Letters, or what orders like them, replaced by their rank among the last states."""
    order = {state: k for k, state in enumerate(sorted(entries, key=lambda s: entries[s][1]))}
    return {state: (cost, order[state]) for state, (cost, _) in entries.items()}


def chained(left: Matrix, right: Matrix) -> Matrix:
    """Best cost and rank of letters over two parts, one after the other."""
    out: Matrix = {}
    for start, middles in left.items():
        best: dict[int, tuple[int, tuple[int, int]]] = {}
        for middle, (cost, rank) in middles.items():
            for end, (more, then) in right[middle].items():
                found = (cost + more, (rank, then))
                if end not in best or found < best[end]:
                    best[end] = found
        out[start] = ranked(best)
    return out


def pick(entries: dict[int, tuple[int, object]], after: dict[int, int]) -> int:
    """The last state of a part from which the rest costs ``after``."""
    return min((cost + after[s], order, s) for s, (cost, order) in entries.items() if s in after)[2]


def flat(matrix: Matrix) -> list[int]:
    return [x for a in range(4) for b in range(4) for x in matrix[a].get(b, (-1, -1))]


def unflat(values: list[int]) -> Matrix:
    cells = {(a, b): (int(values[8 * a + 2 * b]), int(values[8 * a + 2 * b + 1])) for a in range(4) for b in range(4)}
    return {a: {b: cells[a, b] for b in range(4) if cells[a, b][0] >= 0} for a in range(4)}


def applied(letters: str, start: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """The rows that edits leave of ``roles`` and ``texts``."""
    state, row = start, 0
    out_roles, out_texts = [], []
    for letter in letters:
        if letter in "IR":
            state = NEXT[state]
            out_roles.append("assistant" if state == ASSISTANT else "user")
            out_texts.append("" if letter == "I" else texts[row])
        elif letter == "K":
            state = SYSTEM if roles[row][:1] == "s" else NEXT[state]
            out_roles.append(roles[row])
            out_texts.append(texts[row])
        row += letter != "I"
    return out_roles, out_texts


class Tally:
    """Counts over consecutive rows of a conversation."""

    def __init__(self) -> None:
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = ""
        self.low = self.high = None

    def add(self, code: int, turn: int | None) -> None:
        initial = INITIALS[code % 4]
        self.faults[code // 4] += 1
        if self.last:
            self.illegal += self.last + initial not in LEGAL
        self.first, self.last = self.first or initial, initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def join(self, p: pd.Series) -> None:
        """Add the tally ``p`` of the rows that follow."""
        for fault, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated")):
            self.faults[fault] += int(p[name])
        self.illegal += int(p["illegal"])
        if p["first"]:
            if self.last:
                self.illegal += self.last + p["first"] not in LEGAL
            self.first, self.last = self.first or p["first"], p["last"]
        if int(p["turns"]):
            low, high = int(p["low"]), int(p["high"])
            self.turns += int(p["turns"]) - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def values(self) -> dict:
        # Turns at both ends of the 64-bit numbers leave more gaps than a long holds.
        return {"gaps": min(self.gaps, 2**63 - 1), "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[CUT], "illegal": self.illegal}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
#: Rows of ``_sweep`` after the conversation: a whole one, the tally and matrix of a task's part of one, or a slice of its rows.
SWEPT = (
    "kind string, part int, slice int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "first string, last string, low long, high long, turns long, matrix array<long>, codes binary, roles array<string>, texts array<string>"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id``, ``turn``, ``role``, ``text``, ``place``, ``copy`` and ``gone``, damaged by the rule of their key.

    The CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row (``gone``: its conversation stays known),
    1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes it the user's.
    """
    space = F.lit(" ")
    inner, names = shield(conversations, "conv_id", "turn", "role", "text")
    conv, turn, role, text = map(F.col, names)
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    rows = inner.select(
        conv.alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text"),
        F.monotonically_increasing_id().alias("place"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("fate"),
    )
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "place", F.explode(copies).alias("copy"), (F.col("fate") == 0).alias("gone"))


def _codes(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``code`` of each: its initial and its first fault."""
    size = F.octet_length("role").cast("string")
    rows = rows.withColumn("same", F.unhex(F.sha2(F.concat(size, F.lit(":"), "role", "text"), 256)))
    order = F.struct("turn", "place", "copy")
    firsts = rows.filter(~F.col("gone")).groupBy(F.col("conv_id").alias("of"), F.col("same").alias("alike")).agg(F.min(order).alias("first"))
    met = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("same") == F.col("alike")), "left")
    bare = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(F.length(bare) == 0, BLANK).when(~order.eqNullSafe(F.col("first")), DUPLICATE)
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    )
    initial = F.substring("role", 1, 1)
    place: Column = F.lit(INITIALS.index("-"))
    for k, c in enumerate(INITIALS[:3]):
        place = F.when(initial == c, k).otherwise(place)
    gone = F.col("gone")
    return met.select(
        "conv_id", "turn", "place", "copy", F.when(gone, GONE).otherwise(place + 4 * fault).cast("int").alias("code"),
        F.when(gone, "").otherwise(F.col("role")).alias("role"), F.when(gone, "").otherwise(F.col("text")).alias("text"),
    )


def _sweep(schema: pa.Schema, slice_rows: int):
    """One pass over sorted rows: whole conversations solved, those at the borders of a task reduced and cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        chars = 0

        def emit(conv, kind: str, **values) -> None:
            out.append({"conv_id": conv, "kind": kind, "part": part} | values)

        def flush() -> pa.RecordBatch:
            nonlocal chars
            batch = pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in schema], schema=schema)
            out.clear()
            chars = 0
            return batch

        class Open:
            """The conversation that is being read."""

            def __init__(self, conv):
                self.conv, self.tally, self.slices, self.size, self.matrix = conv, Tally(), 0, 0, None
                self.codes, self.roles, self.texts = bytearray(), [], []

            def cut(self) -> None:
                codes = bytes(self.codes)
                matrix = {state: ranked(found) for state, found in table(codes).items()}
                self.matrix = matrix if self.matrix is None else chained(self.matrix, matrix)
                emit(self.conv, "slice", slice=self.slices, codes=codes, roles=self.roles, texts=self.texts)
                self.slices += 1
                self.size, self.codes, self.roles, self.texts = 0, bytearray(), [], []

            def close(self, border: bool) -> None:
                if not border and not self.slices:
                    codes = bytes(self.codes)
                    cost, audit = solve(codes)
                    roles, texts = applied(audit, START, self.roles, self.texts)
                    emit(self.conv, "whole", slice=0, cost=cost, audit=audit, roles=roles, texts=texts, **self.tally.values())
                    return
                self.cut()
                t = self.tally
                emit(self.conv, "part", matrix=flat(self.matrix), first=t.first, last=t.last, low=t.low, high=t.high, turns=t.turns, **t.values())

        now: Open | None = None
        seen = 0
        for batch in batches:
            convs, turns, codes = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "code"))
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            for conv, turn, code, role, text in zip(convs, turns, codes, roles, texts, strict=True):
                if now is None or conv != now.conv:
                    if now is not None:
                        now.close(border=seen == 1)
                    now = Open(conv)
                    seen += 1
                if code != GONE:
                    if len(now.codes) == slice_rows or now.size > SLICE_CHARS:
                        now.cut()
                    now.tally.add(code, turn)
                    now.codes.append(code)
                    now.roles.append(role)
                    now.texts.append(text)
                    now.size += len(text)
                chars += len(text) + 50
                if chars > BATCH_CHARS:
                    if out:
                        yield flush()
        if now is not None:
            now.close(border=True)
        if out:
            yield flush()

    return run


def _chain(parts: pd.DataFrame) -> pd.DataFrame:
    """The parts of one conversation, a row per task: their states, and the conversation's counts on the first."""
    parts = parts.sort_values("part")
    matrices = [unflat(m) for m in parts["matrix"]]
    after = {s: TAILS[s][0] for s in range(4)}
    behind = [after]
    for m in reversed(matrices):
        behind.append({s: min(cost + behind[-1][e] for e, (cost, _) in m[s].items()) for s in range(4)})
    behind.reverse()
    state, starts, ends = START, [], []
    for m, rest in zip(matrices, behind[1:], strict=True):
        starts.append(state)
        state = pick(m[state], rest)
        ends.append(state)
    tally = Tally()
    for _, p in parts.iterrows():
        tally.join(p)
    n = len(parts)
    out = pd.DataFrame({"conv_id": parts["conv_id"].array, "part": parts["part"].array, "start": starts, "end": ends, "tail": [""] * (n - 1) + [TAILS[state][1]], "cost": behind[0][START], "first_part": [True] + [False] * (n - 1)})
    return out.assign(**tally.values())


def _between(slices: pd.DataFrame) -> pd.DataFrame:
    """One task's part of a conversation, solved between its two states."""
    slices = slices.sort_values("slice")
    tables = [table(bytes(c)) for c in slices["codes"]]
    first = slices.iloc[0]
    behind = [{int(first["end"]): 0}]
    for t in reversed(tables):
        rest = behind[-1]
        values = {s: [cost + rest[e] for e, (cost, _) in t[s].items() if e in rest] for s in range(4)}
        behind.append({s: min(v) for s, v in values.items() if v})
    behind.reverse()
    state, rows = int(first["start"]), []
    for k, (t, rest) in enumerate(zip(tables, behind[1:], strict=True)):
        r = slices.iloc[k]
        end = pick(t[state], rest)
        letters = t[state][end][1] + (first["tail"] if k == len(tables) - 1 else "")
        roles, texts = applied(letters, state, list(r["roles"]), list(r["texts"]))
        rows.append((r["conv_id"], r["part"], r["slice"], letters, roles, texts))
        state = end
    return pd.DataFrame(rows, columns=["conv_id", "part", "slice", "audit", "roles", "texts"])


class Repaired(NamedTuple):
    """``reports``: per conversation its counts, ``cost`` and ``audit``. ``messages``: per slice of a conversation, in
    order of ``part`` and ``slice``, the ``roles`` and ``texts`` that stand after repair; ``whole`` where it is the only one."""

    reports: DataFrame
    messages: DataFrame


def repair(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> Repaired:
    """Repair conversations given as rows like those of ``damaged``."""
    spark = rows.sparkSession
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("place"), F.col("copy")]
    ranges = _codes(rows).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    conv = rows.schema["conv_id"]
    schema = T.StructType([conv, *T.StructType.fromDDL(SWEPT)])
    swept = stored(ranges.mapInArrow(_sweep(to_arrow_schema(schema), slice_rows), schema), "conversations")
    whole = swept.filter(F.col("kind") == "whole")

    key = T.StructType([conv])
    more = T.StructType.fromDDL("part int, start int, end int, tail string, cost long, first_part boolean, gaps long, blank long, duplicate long, truncated long, illegal long")
    parts = swept.filter(F.col("kind") == "part").select("conv_id", "part", "matrix", "first", "last", "low", "high", "turns", *COUNTS)
    # Turns travel as text: pandas would hold nullable ones as floats.
    parts = parts.withColumns({c: F.col(c).cast("string") for c in ("low", "high")})
    chain = stored(parts.groupBy("conv_id").applyInPandas(_chain, T.StructType([*key, *more])), "conversation-parts")

    states = chain.select(F.col("conv_id").alias("of"), F.col("part").alias("at"), "start", "end", "tail")
    slices = swept.filter(F.col("kind") == "slice").select("conv_id", "part", "slice", "codes", "roles", "texts")
    slices = slices.join(states, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at"))).drop("of", "at")
    found = T.StructType.fromDDL("part int, slice int, audit string, roles array<string>, texts array<string>")
    solved = stored(slices.groupBy("conv_id", "part").applyInPandas(_between, T.StructType([*key, *found])), "conversation-slices")

    audits = solved.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "slice", "audit"))).alias("a"))
    audits = audits.select(F.col("conv_id").alias("of"), F.array_join(F.transform("a", lambda x: x["audit"]), "").alias("audit"))
    cut = chain.filter("first_part").join(audits, F.col("conv_id").eqNullSafe(F.col("of")))
    columns = ["conv_id", *COUNTS, "cost", "audit"]
    reports = whole.select(columns).unionByName(cut.select(columns))
    shown = ["conv_id", "part", "slice", "roles", "texts"]
    messages = whole.select(*shown, F.lit(True).alias("whole")).unionByName(solved.select(*shown, F.lit(False).alias("whole")))
    return Repaired(reports, messages)


def digests(messages: DataFrame) -> DataFrame:
    """Per conversation ``repaired_sha256`` of its ``role:text`` lines. Slices of one are read in order as a stream."""
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    whole = messages.filter("whole").select("conv_id", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("part"), F.col("slice")]
    text = F.when(F.size("roles") > 0, F.array_join(lines, "\n"))
    ordered = messages.filter(~F.col("whole")).select("conv_id", "part", "slice", text.alias("lines"))
    ordered = ordered.repartition(partitions(messages.sparkSession), "conv_id").sortWithinPartitions(*order)

    schema = to_arrow_schema(whole.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = digest = None
        any_row = any_line = False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], schema[0].type), pa.array([digest.hexdigest()])], schema=schema)

        for batch in batches:
            for conv, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if not any_row or conv != now:
                    if any_row:
                        yield row()
                    now, digest, any_row, any_line = conv, hashlib.sha256(), True, False
                if lines is not None:
                    digest.update(("\n" + lines if any_line else lines).encode())
                    any_line = True
        if any_row:
            yield row()

    return whole.unionByName(ordered.mapInArrow(run, whole.schema))
