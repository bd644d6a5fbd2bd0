"""Repair of the structure of conversations at least cost, by depth-first branch and bound.

The turns of a conversation have to read ``system`` or not, then ``user`` and ``assistant`` in turn, ended by an ``assistant``. Each turn is
kept, given another role or deleted, and empty turns may be put in anywhere. A node of the search is a turn and what came last
before it. It branches into the edits, which wait on an explicit stack; a prefix is given up when its cost and the least
that the rest can cost exceed the incumbent, when it equals the incumbent's cost with letters that come later, or when the
table of its node holds a prefix that is no worse. What is left when the stack is empty is proved to be best.

Turns are sorted over ranges of all tasks, and a range is cut into segments of a bounded number of turns. A conversation inside
one segment is searched at once. One that goes on beyond its segment is searched from each state to each other in every segment it
touches, and these results are chained. So no task holds the texts of a conversation, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.llm.common import join_same
from trialstats.session import stored_table

# Turns that are searched together at most.
SEGMENT = 1024

# What was put out last: nothing, or a role.
START, SYSTEM, USER, ASSISTANT = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

# Costs of the edits, and of keeping a truncated turn.
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1

# The role that has to follow, and what it leads to.
_NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
# Turns put in at the end: their cost and their roles.
CLOSING = {START: (0, ""), SYSTEM: (2 * INSERT, "ua"), USER: (INSERT, "a"), ASSISTANT: (0, "")}
_LEGAL = ("su", "ua", "au")
_FAR = 1 << 60

Closing = dict[int, int]


class Found(NamedTuple):
    """A repair: its cost, its edits, and the state that it ends in."""

    cost: int
    audit: str
    state: int


def edits_of(fault: int, initial: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of what may be done with a turn itself."""
    yield "D", DELETE, state
    if fault in (BLANK, DUPLICATE):
        return
    spoilt = CUT_OFF if fault == TRUNCATED else 0
    role, after = _NEXT[state]
    if initial == role:
        yield "K", spoilt, after
    elif initial == "s" and state == START:
        yield "K", spoilt, SYSTEM
    yield "R", REROLE + spoilt, after


def suffix_bounds(turns: Sequence[tuple[int, str]], closing: Closing) -> list[list[int]]:
    """The least that the turns from each on, and the end, can cost from each state; of their audits nothing is known."""
    bounds = [[closing.get(s, _FAR) for s in range(4)]]
    for fault, initial in reversed(turns):
        behind = bounds[-1]
        own = [min(cost + behind[after] for _, cost, after in edits_of(fault, initial, s)) for s in range(4)]
        once = [min(own[s], INSERT + own[_NEXT[s][1]]) for s in range(4)]
        bounds.append([min(once[s], INSERT + once[_NEXT[s][1]]) for s in range(4)])
    return bounds[::-1]


def search(turns: Sequence[tuple[int, str]], state: int, closing: Closing, bounds_of: Callable = suffix_bounds) -> Found | None:
    """The cheapest edits of ``turns`` (fault, initial of the role) from a state, of equal costs the least audit.

    ``closing`` has what it costs to end in a state; others are no end. The cost found leaves it out.
    """
    bounds = bounds_of(turns, closing)
    best: tuple[int, str] = (_FAR, "")
    found = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, state, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        least = cost + bounds[i][state]
        if least > best[0] or least == best[0] and audit > best[1][: len(audit)] or table.get((i, state), (cost, audit)) < (cost, audit):
            continue
        if i == len(turns):
            if (cost + closing[state], audit) < best:
                best, found = (cost + closing[state], audit), Found(cost, audit, state)
            continue
        ahead = [(cost + INSERT, audit + "I", i, _NEXT[state][1])]
        ahead += [(cost + c, audit + letter, i + 1, after) for letter, c, after in edits_of(*turns[i], state)]
        # The most promising branch goes on top of the stack.
        for cost, audit, i, state in sorted(ahead, key=lambda a: (a[0] + bounds[a[2]][a[3]], a[1]), reverse=True):  # noqa: PLW2901
            if bounds[i][state] < _FAR and (cost, audit) < table.get((i, state), (_FAR, "")):
                table[i, state] = (cost, audit)
                stack.append((i, state, cost, audit))
    return found


def whole(turns: Sequence[tuple[int, str]]) -> Found:
    """The repair of a conversation that is all there; its end is not in the audit."""
    return search(turns, START, {s: c for s, (c, _) in CLOSING.items()})


def roles_put_out(audit: str, initials: Sequence[str], state: int) -> tuple[list[str], list[str]]:
    """For each turn, its letters of the audit, and the initials of the roles that they put out."""
    letters, roles, at = [], [], 0
    own, out = "", ""
    for letter in audit:
        own += letter
        if letter == "K" and initials[at] == "s":
            out, state = out + "s", SYSTEM
        elif letter != "D":
            role, state = _NEXT[state]
            out += role
        if letter != "I":
            letters.append(own)
            roles.append(out)
            own, out, at = "", "", at + 1
    return letters, roles


# --- pieces: the turns of one conversation in one segment ------------------------------------------------------------

_PIECE = (
    "conv string, first_at bigint, n int, open boolean, first_initial string, last_initial string, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, min_turn string, max_turn string, n_turns bigint, initials array<string>, ways array<struct<entry:int,exit:int,cost:bigint,audit:string>>"
)
_PIECE_NAMES = [c.split()[0] for c in _PIECE.split(", ")]


def _piece(rows: list, open_before: bool, open_after: bool) -> tuple:
    turns, initials = [(r.fault, r.initial) for r in rows], [r.initial for r in rows]
    if open_before or open_after:
        entries = range(4) if open_before else (START,)
        found = [(entry, search(turns, entry, {goal: 0})) for entry in entries for goal in range(4)]
    else:
        found = [(START, whole(turns))]
    ways = [{"entry": entry, "exit": f.state, "cost": f.cost, "audit": f.audit} for entry, f in found if f is not None]
    known = [r.turn for r in rows if r.turn is not None]
    faults = [r.fault for r in rows]
    return (
        rows[0].conv, rows[0].at, len(rows), open_before or open_after, initials[0], initials[-1],
        faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
        sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        *([str(min(known)), str(max(known))] if known else [None, None]), len(set(known)), initials, ways,
    )


def _exact_rows(batch: pd.DataFrame) -> Iterator:
    """Rows with plain numbers; ``turn`` comes as text, so that nulls leave no rounded numbers behind."""
    for row in batch.itertuples(index=False):
        yield row._replace(turn=None if row.turn is None else int(row.turn))


def _search_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of segments, whose turns come in order; holds one segment and one batch."""

    def pieces(rows: list) -> pd.DataFrame:
        starts = [k for k in range(len(rows)) if k == 0 or rows[k].conv != rows[k - 1].conv]
        ends = [*starts[1:], len(rows)]
        out = [_piece(rows[s:e], s == 0, e == len(rows)) for s, e in zip(starts, ends, strict=True)]
        return pd.DataFrame(out, columns=_PIECE_NAMES)

    held: list = []
    for batch in batches:
        for row in _exact_rows(batch):
            if held and held[0].segment != row.segment:
                yield pieces(held)
                held = []
            held.append(row)
    if held:
        yield pieces(held)


# --- chains: the pieces of one conversation ---------------------------------------------------------------------------

_SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_CHAINED = f"conv string, first_at bigint, last_at bigint, letters array<string>, roles array<string>, closing string, is_first boolean, {_SUMMARY}"
_CHAINED_NAMES = [c.split()[0] for c in _CHAINED.split(", ")]


def chain(pieces: Sequence[dict[int, list[tuple[int, int, str]]]]) -> tuple[int, list[tuple[int, str]], int]:
    """Cost, then entry and audit of each piece, and last state; ``pieces`` map an entry to its (exit, cost, audit).

    Edits before a turn belong to its piece, so audits of one piece are never beginnings of each other, and the order
    of two prefixes is the order of the pieces before, then of this one's audit: ``rank`` is that order.
    """
    held = {START: (0, 0)}
    steps = []
    for ways in pieces:
        reached: dict[int, tuple[int, int, str, int]] = {}
        for entry, (cost, rank) in held.items():
            for after, more, audit in ways.get(entry, ()):
                reached[after] = min(reached.get(after, (_FAR, 0, "", 0)), (cost + more, rank, audit, entry))
        order = {key: r for r, key in enumerate(sorted({(rank, audit) for _, rank, audit, _ in reached.values()}))}
        held = {s: (cost, order[rank, audit]) for s, (cost, rank, audit, _) in reached.items()}
        steps.append(reached)
    cost, _, last = min((cost + CLOSING[s][0], rank, s) for s, (cost, rank) in held.items())
    out, state = [], last
    for reached in reversed(steps):
        _, _, audit, entry = reached[state]
        out.append((entry, audit))
        state = entry
    return cost, out[::-1], last


def _chain_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repairs of conversations, whose pieces come in order; holds the letters of one conversation, no texts."""

    def conversation(rows: list) -> list[tuple]:
        ways = []
        for r in rows:
            own: dict[int, list] = {}
            for w in r.ways:
                own.setdefault(w["entry"], []).append((w["exit"], w["cost"], w["audit"]))
            ways.append(own)
        cost, steps, last = chain(ways)
        closing = CLOSING[last][1]
        known = [(int(r.min_turn), int(r.max_turn), r.n_turns) for r in rows if r.min_turn is not None]
        met = sum(a[1] == b[0] for a, b in zip(known, known[1:], strict=False))
        gaps = known[-1][1] - known[0][0] + 1 - (sum(n for _, _, n in known) - met) if known else 0
        joints = sum(a.last_initial + b.first_initial not in _LEGAL for a, b in zip(rows, rows[1:], strict=False))
        audit = "".join(a for _, a in steps) + "I" * len(closing)
        counts = [sum(getattr(r, c) for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")]
        out = []
        for k, (r, (entry, own)) in enumerate(zip(rows, steps, strict=True)):
            ends = closing if k == len(rows) - 1 else ""
            summary = (gaps, *counts[:3], counts[3] + joints, cost, audit) if k == 0 else (None,) * 7
            out.append((r.conv, r.first_at, r.first_at + r.n - 1, *roles_put_out(own, r.initials, entry), ends, k == 0, *summary))
        return out

    def frame(out: list[tuple]) -> pd.DataFrame:
        # Whole numbers with nulls, which only the first piece of a conversation has not.
        return pd.DataFrame(out, columns=_CHAINED_NAMES).astype({c: "Int64" for c in _CHAINED_NAMES[7:13]})

    held: list = []
    for batch in batches:
        out: list[tuple] = []
        for row in batch.itertuples(index=False):
            if held and held[0].conv != row.conv:
                out += conversation(held)
                held = []
            held.append(row)
        yield frame(out)
    if held:
        yield frame(conversation(held))


# --- tables -----------------------------------------------------------------------------------------------------------

_ANY = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def conversation_key(conv: Column) -> Column:
    """A text for each conversation, null included."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("-"))


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with their place ``at``, which rises through each conversation; stored in ranges that no conversation can fill alone."""
    keyed = turns.select("conv", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"), F.monotonically_increasing_id().alias("_deal"))
    order = ("conv", "turn", "role", "digest")
    # Rows that are equal in all are dealt over ranges too.
    ranged = keyed.repartitionByRange(*order, "_deal").sortWithinPartitions(*order).drop("_deal")
    return stored_table(ranged.withColumn("at", F.monotonically_increasing_id()))


def _with_faults(placed: DataFrame) -> DataFrame:
    """Places, initials and first faults, without the texts."""
    same = ["conv", "role", "digest"]
    # Combined before the shuffle: one row for each text that a conversation repeats.
    firsts = placed.groupBy(*same).agg(F.min("at").alias("_first"), F.max("at").alias("_last")).filter("_first < _last").drop("_last")
    marked = join_same(placed, stored_table(firsts), same, "left")
    fault = (
        F.when(~F.col("text").rlike(_ANY), BLANK)
        .when(F.col("at") > F.col("_first"), DUPLICATE)
        .when(~F.col("text").rlike(_ENDED), TRUNCATED)
        .otherwise(FINE)
    )
    return marked.select("conv", F.col("turn").cast("string").alias("turn"), "at", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


@dataclass(frozen=True)
class Repair:
    """``conversations`` has a row for each that has turns, ``turns`` all turns after the repair; ``conv`` is a ``conversation_key``."""

    conversations: DataFrame
    turns: DataFrame


def _role(initial: Column) -> Column:
    return F.when(initial == "u", "user").otherwise("assistant")


def repair(turns: DataFrame, conv_col: str = "conv_id", segment: int = SEGMENT) -> Repair:
    """The cheapest repair of every conversation; ``turns`` has a conversation id and ``turn``, ``role``, ``text``.

    Turns are taken by number, nulls first; those of one number by role and then by the SHA-256 of their texts, so repeated rows lie side by
    side. Null roles and texts count as one space, and null ids as one conversation; a role that starts with neither s, u nor a (an empty one too) is given
    another or deleted. The first fault of a turn counts: blank, duplicate of an earlier turn of its conversation (role and
    text), or truncated. Costs and ties are those of ``search``. Other columns are not read. An empty table gives no rows.

    ``turns``: conv, at, step (their order), edit (K, R or I), role, text. ``conversations``: conv, gaps, blank, duplicate,
    truncated, illegal, cost, audit. An audit has a letter for each turn of a conversation, so it fits into a row.
    """
    space = F.lit(" ")
    plain = turns.select(
        conversation_key(F.col(f"`{conv_col}`")).alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
    )
    placed = _placed(plain)
    # The upper bits of a place are its range, the lower 33 the row in it.
    number = F.concat_ws("/", F.shiftright("at", 33), F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / segment))
    dealt = _with_faults(placed).withColumn("segment", number).repartition("segment").sortWithinPartitions("segment", "at")
    pieces = stored_table(dealt.mapInPandas(_search_rows, _PIECE))
    chained = stored_table(pieces.repartition("conv").sortWithinPartitions("conv", "first_at").mapInPandas(_chain_rows, _CHAINED))

    each = chained.select("first_at", F.posexplode(F.arrays_zip("letters", "roles")).alias("_k", "_e"))
    each = each.select((F.col("first_at") + F.col("_k")).alias("at"), F.col("_e.letters").alias("letters"), F.col("_e.roles").alias("roles"))
    edited = placed.join(each.filter("roles <> ''"), "at")
    put_out = edited.select("*", F.posexplode(F.split("roles", "")).alias("step", "_i")).withColumn("edit", F.substring(F.expr("letters"), F.col("step") + 1, F.lit(1)))
    put_out = put_out.select(
        "conv", "at", "step", "edit",
        F.when(F.col("edit") == "K", F.col("role")).otherwise(_role(F.col("_i"))).alias("role"),
        F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"),
    )
    ends = chained.filter("closing <> ''").select("conv", F.col("last_at").alias("at"), F.posexplode(F.split("closing", "")).alias("_k", "_i"))
    # After all that the last turn itself puts out: two turns before it at most, and itself.
    ends = ends.select("conv", "at", (F.col("_k") + 9).alias("step"), F.lit("I").alias("edit"), _role(F.col("_i")).alias("role"), F.lit("").alias("text"))
    summary = chained.filter("is_first").select("conv", *[c.split()[0] for c in _SUMMARY.split(", ")])
    return Repair(summary, put_out.unionByName(ends))


def _hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the lines of each conversation, which come in order; holds no more than a batch."""
    conv, digest = None, None
    for batch in batches:
        out = []
        for c, line in zip(batch["conv"], batch["line"], strict=True):
            if c != conv:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256(line.encode())
            else:
                digest.update(b"\n" + line.encode())
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
    if digest is not None:
        yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "repaired_sha256"])


def repaired_digests(turns: DataFrame) -> DataFrame:
    """``conv, repaired_sha256`` of the ``turns`` of a repair: their ``role:text``, joined by line breaks.

    The hash of a text can only be taken in order: the lines of one conversation stream through one task, which keeps none.
    """
    lines = turns.select("conv", "at", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition("conv").sortWithinPartitions("conv", "at", "step").select("conv", "line")
    return dealt.mapInPandas(_hash_rows, "conv string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults made by a hash of ``conv_id:turn``: one in twenty each dropped, emptied, cut off, repeated, or set to user."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def report(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Counts, cost, audit and digest of the repair of ``turns``, for each conversation id of ``conversations``; zeros where no turn is left."""
    fixed = repair(turns)
    nothing = hashlib.sha256(b"").hexdigest()
    ids = conversations.select("conv_id").distinct().withColumn("conv", conversation_key(F.col("conv_id")))
    rows = ids.join(fixed.conversations, "conv", "left").join(repaired_digests(fixed.turns), "conv", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return rows.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
