"""Conversation repair against a search that holds cost and letters as a pair."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quantloom.llm import repair
from quantloom.llm.queries import QUERIES

BARE = " \t\n\x0b\x0c\r"


def damage(conv, turn, role, text):
    """Rows that the rule of the key leaves of one row."""
    name = lambda x: " " if x is None else x
    fate = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
    role, text = name(role), name(text)
    if fate == 0:
        return []
    text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
    return [("user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)


def judged(rows):
    """First fault of each (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(BARE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def searched(rows, faults):
    """Cost, letters and rows of the cheapest edits, ASCII-least among equal ones: best-first search."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, last, made = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, letters, list(made)
        if (i, last) in done and not letters.endswith("I"):
            continue
        done.add((i, last))
        nexts = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant"}[nexts]
        if cost + 2 <= 3 * len(rows):
            heapq.heappush(heap, (cost + 2, letters + "I", i, nexts, (*made, f"{name}:")))
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, last, made))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] == nexts or role[:1] == "s" and last == "":
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, role[:1], (*made, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + more, letters + "R", i + 1, nexts, (*made, f"{name}:{text}")))
    raise AssertionError


def expected(table):
    """Result rows by conversation; ``table`` in reading order."""
    out = {}
    for conv in dict.fromkeys(r[0] for r in table):
        mine = sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        rows, turns = [], []
        for _, turn, role, text in mine:
            left = damage(conv, turn, role, text)
            rows += left
            turns += [turn] * len(left)
        faults = judged(rows)
        cost, letters, made = searched(rows, faults)
        known = {t for t in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        initials = [r[0][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def found(spark, conversations, slice_rows):
    r = repair.repair(repair.damaged(conversations), slice_rows)
    rows = r.reports.alias("r").join(repair.digests(r.messages).alias("d"), F.col("r.conv_id").eqNullSafe(F.col("d.conv_id"))).select("r.*", "d.repaired_sha256").collect()
    assert len({x.conv_id for x in rows}) == len(rows)
    return {x.conv_id: tuple(x[c] for c in (*repair.COUNTS, "cost", "audit", "repaired_sha256")) for x in rows}


def random_conversation(rnd, conv, n):
    texts = ["Yes.", "No", "", " \t", "Why?", "a long answer.\nwith lines", "é!", None, "x. "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "userx"]
    turn = -2
    for _ in range(n):
        turn += rnd.choice([0, 1, 1, 1, 1, 1, 3])
        text = rnd.choice(texts) if rnd.random() < 0.5 else f"line {rnd.randrange(10**6)}{rnd.choice(['.', '', '?'])}"
        yield conv, None if rnd.random() < 0.05 else turn, rnd.choice(roles), text


@pytest.mark.parametrize("codes", range(3))
def test_integers_decide_like_pairs(codes):
    rnd = random.Random(codes)
    roles, faults = ["system", "user", "assistant", "-"], ["", "truncated", "duplicate", "blank"]
    for _ in range(400):
        row = bytes(rnd.choice([0, 1, 1, 2, 2, 3]) + 4 * rnd.choice([0, 0, 0, 1, 2, 3]) for _ in range(rnd.randrange(8)))
        cost, letters, _ = searched([(roles[c % 4], "t") for c in row], [faults[c // 4] for c in row])
        assert repair.solve(row) == (cost, letters), row


def test_parts_chain_to_the_whole():
    rnd = random.Random(5)
    for _ in range(200):
        row = bytes(rnd.choice([0, 1, 1, 2, 2, 3]) + 4 * rnd.choice([0, 0, 1, 2]) for _ in range(rnd.randrange(1, 12)))
        at = sorted(rnd.randrange(len(row) + 1) for _ in range(2))
        parts = [row[: at[0]], row[at[0] : at[1]], row[at[1] :]]
        whole = repair.chained(repair.chained(*({s: repair.ranked(v) for s, v in repair.table(p).items()} for p in parts[:2])), {s: repair.ranked(v) for s, v in repair.table(parts[2]).items()})
        direct = {s: repair.ranked(v) for s, v in repair.table(row).items()}
        assert whole == direct
        assert repair.unflat(repair.flat(whole)) == whole


@pytest.mark.parametrize("slice_rows", [3, repair.SLICE_ROWS])
def test_conversations(spark, slice_rows):
    rnd = random.Random(1)
    table = [r for k in range(60) for r in random_conversation(rnd, k, rnd.choice([1, 2, 3, 5, 8]))]
    table += random_conversation(rnd, 1000, 70)
    table += random_conversation(rnd, None, 6)
    table += [(2000, None, "user", "Hi."), (2000, None, None, None), (2001, 7, "user", "again."), (2001, 7, "user", "again."), (2002, 0, "user", "x" * 50_000 + ".")]
    table += [(-1, -(2**62), "user", "Hi."), (-1, 2**62, "assistant", "Hi.")]
    frame = spark.createDataFrame([(*r, "extra", 0) for r in table], "conv_id long, turn long, role string, text string, TEXT string, place int")
    assert found(spark, frame, slice_rows) == expected(table)


def test_one_conversation_holds_the_table(spark):
    """Its rows are spread over all tasks and chained."""
    rnd = random.Random(2)
    table = list(random_conversation(rnd, 5, 400))
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    found_rows = found(spark, frame, 16)
    rows = sum((damage(*r) for r in sorted(table, key=lambda r: (r[1] is not None, r[1] or 0))), [])
    codes = bytes("sua-".index(role[:1] if role[:1] in ("s", "u", "a") else "-") + 4 * ["", "truncated", "duplicate", "blank"].index(f) for (role, _), f in zip(rows, judged(rows)))
    cost, letters = repair.solve(codes)
    assert found_rows[5][5:7] == (cost, letters)
    roles, texts = repair.applied(letters, repair.START, [r for r, _ in rows], [t for _, t in rows])
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r in roles))
    assert found_rows[5][7] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in zip(roles, texts)).encode()).hexdigest()


def test_empty_table_and_lost_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert found(spark, spark.createDataFrame([], schema), 4) == {}
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = found(spark, spark.createDataFrame([(lost, 0, "user", "Hi.")], schema), 4)
    assert rows == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    given = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = QUERIES["op12_conversation_repair"](spark, folder).collect()
    assert {r.conv_id: tuple(r[c] for c in (*repair.COUNTS, "cost", "audit", "repaired_sha256")) for r in rows} == expected(given)
