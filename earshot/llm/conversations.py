"""Repair of conversation structure: cheapest edits by a cost program, least audit by prefix doubling.

A conversation is sound if its role initials are ``(s?(ua)+)?``. Each turn is kept (cost 0),
re-roled to user or assistant (3) or deleted (4; blank and repeated turns have to go), and empty turns
of user or assistant can be inserted anywhere (3); a truncated turn that stays costs 3 more. Of the cheapest repairs
the one whose audit (the initials of its edits) is least in ASCII is taken.

The program's nodes are (turn, state of the pattern). A turn is a 4 x 4 table of costs between
states, and tables multiply in (min, +), so conversations are cut into blocks of ``BLOCK`` turns that are handled
by themselves, wherever their turns lie:

1. Turns are sorted by range over (conversation, turn), so one with a third of all rows is spread
   over many tasks; each block yields the product of its tables and its counts of faults.
2. A sorted pass over the blocks of each conversation, last first, gives every block the cost
   from its end to the conversation's end.
3. Inside a block the arcs on cheapest paths are then known. Their nodes are ranked by their audits of
   1, 2, 4, .. edits: equal ranks mean equal audits so far, and a node's pointer leads to the node behind
   as many edits on its least audit. Following doubled pointers gives the audit's edits
   in place, from each state a block may be entered in.
4. One sorted pass per conversation picks the edits of the state it is in and streams
   the texts through. It holds one turn at a time; a digest over a whole conversation admits no split.

Texts travel once, in step 4; until then a turn is its keys and two 64-bit hashes of its text, and equal
rows of one turn are counted before they are shuffled.

Null roles and texts are one space (a blank turn), null turns come first, null ids are one conversation. Rows of
one turn are taken by role, then by the hash of their text; equal rows stand side by side and all but the first are
repeated. Turns of one role and text anywhere in a conversation are repeated but for the first. Very
long texts are hashed whole. An empty table has no conversations. Only ``conv_id, turn, role, text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import per_row
from earshot.session import via_table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 1024
# Turns whose audits are ranked together: whole blocks, so that small conversations share the work.
_RANKED = 4096
SALTS = 16

# States of the pattern: nothing yet, after s, after u, after a. What an initial leads to, where it may stand.
_AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
# The next user or assistant is fixed by the state.
_NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
_STATES = range(4)
_FAR = 1 << 50
# Cost from behind the last turn: the pattern is completed by insertions.
_CLOSE = (0, 2 * INSERT, INSERT, 0)
_FOLLOW = {"su", "ua", "au"}
_LABELS = "DIKR"  # in ASCII order

_KEY = ["conv_id", "turn", "role", "h1", "h2"]
_BLANKS = " \t\n\x0b\x0c\r"


def damage(conversations: DataFrame) -> DataFrame:
    """The query's damage: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped, emptied, cut, repeated or re-roled."""
    def spelled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", "role", "text",
                       F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def _keyed(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, h1, h2, text`` with nulls of role and text as one space."""
    text = F.coalesce("text", F.lit(" "))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))


def marked_turns(turns: DataFrame) -> DataFrame:
    """One row per different turn: its keys, ``n`` copies, and whether it is blank, truncated or seen ``again``."""
    seen = F.rtrim(F.col("text"), F.lit(_BLANKS))
    light = _keyed(turns).select(*_KEY, (seen == "").alias("blank"), (~F.right(seen, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    rows = via_table(light.groupBy(*_KEY).agg(
        F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")), "turns")
    said = [c for c in _KEY if c != "turn"]
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    repeated = rows.groupBy(*said).agg(F.min(place).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    firsts = repeated.select(*(F.col(c).alias(f"{c}_first") for c in said), F.col("first.turn").alias("first_turn"),
                             F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    same = F.pmod(F.xxhash64("turn"), F.lit(SALTS)) == F.col("salt")
    for c in said:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_first"))
    again = F.col("salt").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    return rows.join(firsts, same, "left").select(*_KEY, "n", "blank", "truncated", again.alias("again"))


def _moves(initial: str, truncated: bool, forced: bool) -> list[list[int]]:
    """Costs of a turn's first copy from state to state, insertions before it included."""
    table = [[_FAR] * 4 for _ in _STATES]
    for start in _STATES:
        state, spent = start, 0
        for _ in range(3):
            for _, to, cost in _arcs(state, initial, truncated, forced):
                table[start][to] = min(table[start][to], spent + cost)
            state, spent = _NEXT[state][1], spent + INSERT
    return table


def _arcs(state: int, initial: str, truncated: bool, forced: bool) -> list[tuple[str, int, int]]:
    """``label, next state, cost`` of what may be done with a turn."""
    arcs = [("D", state, DELETE)]
    if not forced:
        more = TRUNCATED if truncated else 0
        arcs.append(("R", _NEXT[state][1], REROLE + more))
        to = _AFTER.get(initial, {}).get(state)
        if to is not None:
            arcs.append(("K", to, more))
    return arcs


class _Tables:
    """The cost tables of the few kinds of turns."""

    def __init__(self) -> None:
        self.known: dict[tuple, list[list[int]]] = {}

    def of(self, initial: str, truncated: bool, forced: bool) -> list[list[int]]:
        kind = initial if initial in _AFTER else "", truncated, forced
        if kind not in self.known:
            self.known[kind] = _moves(*kind)
        return self.known[kind]


def _product(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[min(min(x + y for x, y in zip(row, column)), _FAR) for column in zip(*b)] for row in a]


# Counts of a block: turns with copies, faults, steps that follow each other wrongly, different turn numbers.
# ``ends``: first and last initial; ``turns``: least and greatest turn number, null where there is none.
_STATS = ("n", "blank", "duplicate", "truncated", "illegal", "numbers")
_BLOCK_ROWS = ("conv_id {id}, turn long, role string, h1 long, h2 long, n long, truncated boolean, forced boolean, "
               "block long, place long, table array<long>, stats array<long>, ends array<string>, turns array<long>")


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """The turns in order, with block and place; the last one of a block carries the block's table and counts."""
    id_type = turns.schema["conv_id"].dataType.simpleString()
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = turns.repartitionByRange(n, *_KEY).sortWithinPartitions(*_KEY)

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        tables, at = _Tables(), TaskContext.get().partitionId() << 40
        held: tuple | None = None
        table, stats, first, low, before = None, [0] * len(_STATS), None, None, None

        def closed() -> tuple:
            return (*held, [x for line in table for x in line], stats, [first, before[0]], [low, before[1]])

        for conv, turn, role, h1, h2, copies, blank, cut, again in source:
            initial = role[:1]
            if held is not None and (held[0] != conv or held[-1] + 1 >= block):
                yield closed()
                held = None
            elif held is not None:
                yield (*held, None, None, None, None)
            if held is None:
                at += 1
                table, stats, first, low, before, place = None, [0] * len(_STATS), initial, turn, None, 0
            else:
                place = held[-1] + 1
            forced = blank or again
            mine = tables.of(initial, cut, forced)
            if copies > 1:
                mine = [[min(x + DELETE * (copies - 1), _FAR) for x in line] for line in mine]
            table = mine if table is None else _product(table, mine)
            steps = copies - 1 + (before is not None and before[0] + initial not in _FOLLOW)
            for i, x in enumerate((copies, copies if blank else 0, 0 if blank else copies - (not again),
                                   cut and not forced, steps, turn is not None and (before is None or before[1] != turn))):
                stats[i] += int(x)
            before, low = (initial, turn), turn if low is None else low
            held = (conv, turn, role, h1, h2, copies, cut, forced, at, place)
        if held is not None:
            yield closed()

    return per_row(ordered, _BLOCK_ROWS.format(id=id_type), rows)


def _ends(blocks: DataFrame) -> DataFrame:
    """For every block the cost from each state at its end; a conversation's first block carries its counts.

    ``facts``: gaps, blank, duplicate, truncated, illegal, cost.
    """
    id_type = blocks.schema["conv_id"].dataType.simpleString()
    closed = blocks.filter("table IS NOT NULL").select("conv_id", "block", "table", "stats", "ends", "turns")
    backward = closed.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        conv, none, togo, total, low, high, initial, held = None, True, [], [], None, None, "", ()
        for id_, block, table, stats, ends, turns in source:
            if none or id_ != conv:
                if held:
                    yield held
                conv, none, togo, total, low, high = id_, False, _CLOSE, stats, *turns
            else:
                yield (*held[:3], None)
                total = [x + y for x, y in zip(total, stats)]
                total[4] += ends[1] + initial not in _FOLLOW  # the step over the border
                total[5] -= turns[1] is not None and turns[1] == low  # a turn number on both sides of it
                low = low if turns[0] is None else turns[0]
            initial, after = ends[0], togo
            togo = [min(min(x + y for x, y in zip(table[4 * q:4 * q + 4], after)), _FAR) for q in _STATES]
            gaps = 0 if low is None else high - low + 1 - total[5]
            held = (id_, block, list(after), [gaps, *total[1:5], togo[0]])
        if held:
            yield held

    return per_row(backward, f"conv_id {id_type}, block long, togo array<long>, facts array<long>", rows)


def least_paths(moves: list[list[list[tuple[str, int, int]]]], togo: list[list[int]]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Nodes on cheapest paths, ranked by audits of 1, 2, 4, .. edits, with the pointers behind as many edits.

    ``moves[i][q]``: arcs ``label, next node, cost`` of node 4 i + q; ``togo``: cheapest costs from
    every node on. Returns the label of each node's first edit, the ranks and the pointers of every length.
    """
    nodes = len(togo) * 4
    label = np.full(nodes, -1, dtype=np.int64)
    pointer = np.arange(nodes)
    flat = [x for line in togo for x in line]
    for i, states in enumerate(moves):
        for q, arcs in enumerate(states):
            here = 4 * i + q
            best = min(((_LABELS.index(name), to) for name, to, cost in arcs if flat[to] + cost == flat[here] < _FAR), default=None)
            if best:  # a node's arcs have different labels, so one edit tells them apart
                label[here], pointer[here] = best
    ranks, pointers = [label + 1], [pointer]
    while True:
        pointer = pointers[-1]
        behind = ranks[-1][pointer]
        if (pointer[pointer] == pointer).all():
            return label, ranks, pointers
        # Where an audit has ended there is rank 0 behind it: it comes before those that go on.
        ranks.append(np.unique(ranks[-1] * (nodes + len(_LABELS) + 1) + behind, return_inverse=True)[1])
        pointers.append(pointer[pointer])


def path_from(start: np.ndarray, pointers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(path, node)`` of all nodes on the paths from ``start``, in order, by their doubled pointers."""
    length = np.zeros(len(start), dtype=np.int64)
    node = start.copy()
    for k in range(len(pointers) - 1, -1, -1):  # how many edits until a path ends
        far = pointers[k][node]
        goes_on = pointers[0][far] != far
        length[goes_on] += 1 << k
        node = np.where(goes_on, far, node)
    length += pointers[0][node] != node
    path = np.repeat(np.arange(len(start)), length)
    step = np.arange(len(path)) - np.repeat(np.cumsum(length) - length, length)
    node = start[path]
    for k, pointer in enumerate(pointers):
        node = np.where(step >> k & 1, pointer[node], node)
    return path, node


def _edits_of_blocks(blocks: list[tuple[list[tuple], list[int]]]) -> Iterator[tuple]:
    """For every turn of some blocks the edits from each state its block may be entered in."""
    moves, togo, base = [], [], []
    for turns, after in blocks:
        base.append(len(togo))
        costs = [list(after)]
        arcs_of: list[list[list[tuple[str, int, int]]]] = []
        for turn in reversed(turns):
            initial, cut, forced, copies = turn[2][:1], turn[6], turn[7], turn[5]
            later, tail = costs[-1], DELETE * (copies - 1)
            consumed = [[(name, to, cost + tail) for name, to, cost in _arcs(q, initial, cut, forced)] for q in _STATES]
            here = [min(later[to] + cost for _, to, cost in arcs) for arcs in consumed]
            for _ in range(3):  # insertions lead from state to state in front of the turn
                here = [min(here[q], here[_NEXT[q][1]] + INSERT) for q in _STATES]
            costs.append([min(x, _FAR) for x in here])
            arcs_of.append(consumed)
        first = len(togo)
        for i, consumed in enumerate(reversed(arcs_of)):
            moves.append([[("I", 4 * (first + i) + _NEXT[q][1], INSERT),
                           *((name, 4 * (first + i + 1) + to, cost) for name, to, cost in consumed[q])] for q in _STATES])
        moves.append([[] for _ in _STATES])
        togo.extend(reversed(costs))
    label, _, pointers = least_paths(moves, togo)
    starts = np.array([4 * b + q for b in base for q in _STATES])
    path, node = path_from(starts, pointers)
    names = np.array(list(_LABELS))[label[node]]
    edits = [[""] * 4 for _ in togo]
    for p, at, name in zip(path.tolist(), (node // 4).tolist(), names.tolist()):
        edits[at][p % 4] += name
    for b, (turns, _) in zip(base, blocks):
        for i, turn in enumerate(turns):
            yield (*turn[:6], turn[8], turn[9], edits[b + i])


_EDITS = "conv_id {id}, turn long, role string, h1 long, h2 long, n long, block long, place long, edits array<string>"


def _edits(blocks: DataFrame, ends: DataFrame) -> DataFrame:
    """Every turn with the edits up to it, one string for each state its block may be entered in."""
    id_type = blocks.schema["conv_id"].dataType.simpleString()
    own = [c for c in blocks.columns if c not in ("table", "stats", "ends", "turns")]
    none = {c: F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in own}
    costs = ends.select(*(F.col(c) if c == "block" else F.lit(-1).cast("long").alias(c) if c == "place" else none[c] for c in own), "togo")
    turns = blocks.select(*own, F.lit(None).cast("array<long>").alias("togo"))
    met = turns.unionByName(costs).repartition("block").sortWithinPartitions("block", "place")

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple[list[tuple], list[int]]] = []
        n = 0
        for *turn, togo in source:
            if turn[9] < 0:
                if n >= _RANKED:
                    yield from _edits_of_blocks(held)
                    held, n = [], 0
                held.append(([], togo))
            else:
                held[-1][0].append(turn)
                n += 1
        if held:
            yield from _edits_of_blocks(held)

    return per_row(met, _EDITS.format(id=id_type), rows)


def _plan(turns: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The written edits of all turns, and the counts of each conversation."""
    blocks = via_table(_blocks(marked_turns(turns), block), "blocks")
    ends = via_table(_ends(blocks), "block-ends")
    return _edits(blocks, ends), ends.filter("facts IS NOT NULL").select("conv_id", "facts")


_SORTED = ["conv_id", "part", "turn", "role", "h1", "h2"]


def _met(turns: DataFrame, block: int, ids: DataFrame | None) -> DataFrame:
    """Edits, texts, counts and bare ids of each conversation in one sorted sequence (``part`` 0: counts and ids)."""
    plan, facts = _plan(turns, block)
    columns = {"conv_id": None, "part": "int", "turn": "long", "role": "string", "h1": "long", "h2": "long", "kind": "int",
               "n": "long", "place": "long", "edits": "array<string>", "text": "string", "facts": "array<long>"}

    def aligned(df: DataFrame, part: int, kind: int) -> DataFrame:
        df = df.withColumn("part", F.lit(part)).withColumn("kind", F.lit(kind))
        return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))

    parts = [aligned(facts, 0, 0), aligned(plan, 1, 1), aligned(_keyed(turns), 1, 2)]
    if ids is not None:
        parts.append(aligned(ids.select("conv_id").distinct(), 0, 0))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.repartition("conv_id").sortWithinPartitions(*_SORTED, "kind")


def _followed(source: Iterator[tuple]) -> Iterator[tuple]:
    """The edits of each conversation: ``conv_id, label, role, text, times``; first ``conv_id, "", None, facts, 0``."""
    conv, none, state, entry, due = None, True, 0, 0, None

    def insert(times: int) -> Iterator[tuple]:
        nonlocal state
        for _ in range(times):
            role, state = _NEXT[state]
            yield conv, "I", role, "", 1

    for id_, part, _, role, _, _, kind, n, place, edits, text, facts in source:
        if none or id_ != conv:
            yield from insert(_CLOSE[state] // INSERT)
            conv, none, state, due = id_, False, 0, None
            yield conv, "", None, None, 0
        if part == 0:
            if facts is not None:
                yield conv, "", None, facts, 0
        elif kind == 1:
            entry = state if place == 0 else entry
            yield from insert(len(edits[entry]) - 1)
            last = edits[entry][-1]
            if last == "D":
                yield conv, "D", role, None, n
            else:
                due = last, n
        elif due is not None:  # the first text of the turn
            last, n = due
            due = None
            role, state = _NEXT[state] if last == "R" else (role, _AFTER[role[:1]][state])
            yield conv, last, role, text, 1
            if n > 1:
                yield conv, "D", role, None, n - 1
    yield from insert(_CLOSE[state] // INSERT)


def report(turns: DataFrame, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``turns`` (and of ``ids``): counts of faults, cost, audit, digest of the repaired text."""
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        conv, none, facts, audit, digest, empty = None, True, None, [], sha256(), True

        def told() -> tuple:
            return (conv, *(facts or [0] * 6), "".join(audit), digest.hexdigest())

        for id_, label, role, text, times in _followed(source):
            if none or id_ != conv:
                if not none:
                    yield told()
                conv, none, facts, audit, digest, empty = id_, False, None, [], sha256(), True
            if not label:
                facts = text or facts
                continue
            audit.append(label * times)
            if label != "D":
                digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
        if not none:
            yield told()

    return per_row(_met(turns, block, ids), f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, "
                   "illegal long, cost long, audit string, repaired_sha256 string", rows, 256)


def repaired(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The turns after repair: ``conv_id, place, edit, role, text`` in order, places from 0. ``edit`` is K, R or I."""
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        conv, none, place = None, True, 0
        for id_, label, role, text, _ in _followed(source):
            if none or id_ != conv:
                conv, none, place = id_, False, 0
            if label and label != "D":
                yield id_, place, label, role, text
                place += 1

    return per_row(_met(turns, block, None), f"conv_id {id_type}, place long, edit string, role string, text string", rows)
