"""Repairs against exhaustive search, against a forward table, and whole results against a plain reading of the contract."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from trialstats.llm import conversations as c
from trialstats.llm import registered

LEGAL = re.compile("(s?(ua)+)?")
CLOSINGS = {s: cost for s, (cost, _) in c.CLOSING.items()}


def exhaustive(turns):
    """All edits with up to two turns put in anywhere."""
    inserted = ["", "u", "a", "uu", "ua", "au", "aa"]
    best = None
    choices = []
    for fault, initial in turns:
        own = [("D", 3, "")]
        if fault not in (c.BLANK, c.DUPLICATE):
            spoilt = int(fault == c.TRUNCATED)
            own += [("K", spoilt, initial or "?"), ("R", 2 + spoilt, "u"), ("R", 2 + spoilt, "a")]
        choices.append([("I" * len(i) + e, 2 * len(i) + cost, i + role) for i in inserted for e, cost, role in own])
    choices.append([("I" * len(i), 2 * len(i), i) for i in inserted])
    for picked in itertools.product(*choices):
        if LEGAL.fullmatch("".join(p[2] for p in picked)):
            found = (sum(p[1] for p in picked), "".join(p[0] for p in picked))
            best = found if best is None else min(best, found)
    return best


def by_table(turns):
    """The least (cost, audit) of every state after every turn."""
    held = {c.START: (0, "")}

    def with_inserts(held):
        for _ in range(2):
            for s, (cost, audit) in list(held.items()):
                after = c.USER if s != c.USER else c.ASSISTANT
                held[after] = min(held.get(after, (10**9, "")), (cost + 2, audit + "I"))
        return held

    for fault, initial in turns:
        new = {}
        for s, (cost, audit) in with_inserts(held).items():
            want, after = ("a", c.ASSISTANT) if s == c.USER else ("u", c.USER)
            moves = [("D", 3, s)]
            if fault not in (c.BLANK, c.DUPLICATE):
                spoilt = int(fault == c.TRUNCATED)
                moves += [("R", 2 + spoilt, after)] + [("K", spoilt, after)] * (initial == want) + [("K", spoilt, c.SYSTEM)] * (initial == "s" and s == c.START)
            for e, more, to in moves:
                new[to] = min(new.get(to, (10**9, "")), (cost + more, audit + e))
        held = new
    held = with_inserts(held)
    return min(held[s] for s in (c.START, c.ASSISTANT) if s in held)


def searched(turns, **more):
    found = c.search(turns, c.START, CLOSINGS, **more)
    return found.cost + c.CLOSING[found.state][0], found.audit + "I" * len(c.CLOSING[found.state][1])


def made(rng, n):
    return [(rng.choices(range(4), [8, 1, 1, 2])[0], rng.choice(["s", "u", "a", "u", "a", "x", ""])) for _ in range(n)]


def test_search_is_exhaustive():
    rng = random.Random(1)
    for _ in range(150):
        turns = made(rng, rng.randint(0, 3))
        assert searched(turns) == exhaustive(turns) == by_table(turns)


def test_search_of_longer_ones():
    rng = random.Random(2)
    for _ in range(200):
        turns = made(rng, rng.randint(4, 60))
        assert searched(turns) == by_table(turns)
    assert searched([(c.FINE, "s")] * 700) == by_table([(c.FINE, "s")] * 700)


def test_branch_and_bound_needs_no_tight_bounds():
    """With bounds that know of no role, incumbents and tables alone prove the same repair."""

    def loose(turns, closing):
        out = [[min(closing.values())] * 4]
        for fault, _ in reversed(turns):
            least = {c.BLANK: 3, c.DUPLICATE: 3, c.TRUNCATED: 1}.get(fault, 0)
            out.append([least + out[-1][0]] * 4)
        return out[::-1]

    rng = random.Random(3)
    for _ in range(100):
        turns = made(rng, rng.randint(0, 12))
        assert searched(turns, bounds_of=loose) == by_table(turns)


def test_bounds_hold():
    rng = random.Random(4)
    for _ in range(100):
        turns = made(rng, rng.randint(1, 8))
        bounds = c.suffix_bounds(turns, CLOSINGS)
        for i in range(len(turns)):
            for state in range(4):
                found = c.search(turns[i:], state, CLOSINGS)
                assert bounds[i][state] <= found.cost + CLOSINGS[found.state]


def test_chain_of_pieces():
    rng = random.Random(5)
    for _ in range(100):
        turns = made(rng, rng.randint(1, 40))
        cuts = sorted({0, len(turns), *(rng.randint(0, len(turns)) for _ in range(4))})
        pieces = []
        for a, b in zip(cuts, cuts[1:]):
            ways = {}
            for entry in range(4):
                for goal in range(4):
                    f = c.search(turns[a:b], entry, {goal: 0})
                    if f is not None:
                        ways.setdefault(entry, []).append((f.state, f.cost, f.audit))
            pieces.append(ways)
        cost, steps, last = c.chain(pieces)
        assert (cost, "".join(a for _, a in steps) + "I" * len(c.CLOSING[last][1])) == by_table(turns)


# --- whole results ----------------------------------------------------------------------------------------------------


def damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def brute(rows):
    """Everything that the contract asks of each conversation, read literally."""
    out = {}
    after = list(damage(rows))
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in after if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, turns = set(), []
        for _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = c.BLANK if not solid else c.DUPLICATE if (role, text) in seen else c.TRUNCATED if solid[-1] not in ".!?" else c.FINE
            seen.add((role, text))
            turns.append((fault, role[:1]))
        numbers = [r[0] for r in own if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults = [f for f, _ in turns]
        illegal = sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = by_table(turns)
        lines, rest, state = [], iter(own), c.START
        for e in audit:
            _, role, text = (None, None, "") if e == "I" else next(rest)
            if e == "D":
                continue
            if e == "K" and role[:1] == "s":
                state = c.SYSTEM
            else:
                name, state = ("assistant", c.ASSISTANT) if state == c.USER else ("user", c.USER)
                role = role if e == "K" else name
            lines.append(f"{role}:{text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count(c.BLANK), faults.count(c.DUPLICATE), faults.count(c.TRUNCATED), illegal, cost, audit, sha)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(df):
    assert df.columns == ["conv_id", *COLUMNS]
    got = df.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[k] for k in COLUMNS) for r in got}


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(registered.QUERIES["op13_conversations"](spark, small)) == brute(rows)


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("segment", [1, 7, 1024])
def test_odd_conversations(spark, monkeypatch, segment):
    rng = random.Random(segment)
    roles = ["system", "user", "assistant", "user", "assistant", None, "", "tool", "user "]
    said = ["Yes.", "no", "", None, " \t", "What?", "a! ", "long " * 3000 + ".", "Ünd\n."]
    rows = [(conv, rng.choice([None, *range(-3, 12)]), rng.choice(roles), rng.choice(said)) for conv in [None, 1, 2, 3, 2**60, 2**60 + 1] for _ in range(rng.randint(1, 25))]
    rows += [(9, t, ("user", "assistant")[t % 2], f"Line {t}.") for t in range(900)] + [(9, 5, "user", "Line 5.")] * 40 + [(10, 1, None, None)] * 30
    rows += [(20 + i, 0, "user", "Hi.") for i in range(40)] + [(70, 2**62 + 1, "user", "Far."), (70, 2**62 + 3, "assistant", "So.")]
    monkeypatch.setattr(c.repair, "__defaults__", ("conv_id", segment))
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(c.report(table, c.damaged(table))) == brute(rows)


def test_nothing_and_clashing_columns(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert c.report(table, c.damaged(table)).collect() == []
    rows = [(1, 0, "user", "Hi.", 4, "x", "y", 1, "z"), (1, 1, "user", "Bye.", 5, "x", "y", 1, "z")]
    clash = spark.createDataFrame(rows, SCHEMA + ", at bigint, conv string, digest string, step int, _kind string")
    fixed = c.repair(clash)
    got = [(r.edit, r.role, r.text) for r in fixed.turns.orderBy("conv", "at", "step").collect()]
    # Another role for the second turn costs as much as two turns put in would not.
    assert got == [("K", "user", "Hi."), ("R", "assistant", "Bye.")]
    assert fixed.conversations.select("cost", "audit", "illegal").first() == (2, "KR", 1)


def test_no_task_holds_a_long_conversation(spark):
    """Ranges cut a conversation that has all rows, also where its rows are alike in all columns."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.lit(3).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    placed = c._placed(turns.select(c.conversation_key(F.col("conv_id")).alias("conv"), "turn", "role", "text"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in placed.groupBy(F.shiftright("at", 33)).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 5_000
