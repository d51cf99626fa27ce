import hashlib
import heapq
import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from earshot.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def in_order(rows):
    """Rows of one turn by role and the hash of their text, as the operator takes them; texts of the tests tie on purpose."""
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], HASHES[r[3]]))


def brute(conv, rows):
    """Search over all edits by (cost, audit): the first repair that comes out is the cheapest with the least audit."""
    rows = in_order(rows)
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    pattern = {"": "su", "s": "u", "u": "a", "a": "u"}  # what may follow
    todo, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, at, roles = heapq.heappop(todo)
        if i == len(rows) and at in ("", "a"):
            break
        if (i, at) in done:
            continue
        done.add((i, at))
        for role in ("user", "assistant"):
            if role[0] in pattern[at]:
                heapq.heappush(todo, (cost + 3, audit + "I", i, role[0], (*roles, (role, ""))))
        if i < len(rows):
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, at, roles))
            if faults[i] not in ("blank", "duplicate"):
                more, (_, _, role, text) = 3 * (faults[i] == "truncated"), rows[i]
                if initials[i] and initials[i] in pattern[at]:
                    heapq.heappush(todo, (cost + more, audit + "K", i + 1, initials[i], (*roles, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in pattern[at]:
                        heapq.heappush(todo, (cost + 3 + more, audit + "R", i + 1, new[0], (*roles, (new, text))))
    left = "\n".join(f"{r}:{t}" for r, t in roles)
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256(left.encode()).hexdigest())


HASHES = {}


def all_brute(spark, rows, ids):
    texts = spark.createDataFrame([(t,) for t in {" " if r[3] is None else r[3] for r in rows}], "text string")
    HASHES.update({r.text: (r.h1, r.h2) for r in texts.selectExpr("text", "xxhash64(text) AS h1", "xxhash64(1, text) AS h2").collect()})
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((conv, turn, " " if role is None else role, " " if text is None else text))
    return sorted((brute(c, by[c]) for c in {*by, *ids}), key=repr)


TEXTS = ["Hello.", "Yes!", "no end", "  ", "", None, "Is it so?", "So. it goes", "é \U0001f600.", "ok. \n"]


def talk(rng, conv, n):
    rows = []
    for i in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "s", ""]) if rng.random() < 0.4 else ["user", "assistant"][i % 2]
        turn = None if rng.random() < 0.05 else i + rng.randint(0, 2)
        text = rng.choice(TEXTS) if rng.random() < 0.5 else f"text {rng.randint(0, 10**6)}" + rng.choice([".", "", "?"])
        rows += [(conv, turn, role, text)] * (2 if rng.random() < 0.05 else 1)
    return rows


@pytest.mark.parametrize("block", [cv.BLOCK, 3, 1])
def test_equals_a_search_over_all_edits(spark, block, monkeypatch):
    monkeypatch.setattr(cv, "_RANKED", 40)
    rng = random.Random(block)
    rows = [r for c in range(60) for r in talk(rng, rng.choice([c, c, None]) if c % 10 == 0 else c, rng.randint(1, 14))]
    rows += [(900, None, "user", "Hi."), (900, None, "user", "Hi."), (901, 5, "system", "Be good."), (902, 1, "user", None)]
    rng.shuffle(rows)
    got = cv.report(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS part", "1 AS kind", "'y' AS n"), block=block).collect()
    assert sorted(map(tuple, got), key=repr) == all_brute(spark, rows, set())


def test_damaged_conversations(spark):
    rng = random.Random(9)
    rows = [r for c in range(150) for r in talk(rng, c, rng.randint(1, 5))] + [(None, None, None, None)]
    rows += [(next(c for c in range(200, 400) if crc32(f"{c}:0".encode()) % 20 == 0), 0, "user", "All of it is dropped.")]
    table = spark.createDataFrame(rows, SCHEMA)
    want = damaged(rows)
    assert sorted(map(tuple, cv.damage(table).collect()), key=repr) == sorted(want, key=repr)
    got = sorted(map(tuple, cv.report(cv.damage(table), ids=table).collect()), key=repr)
    assert got == all_brute(spark, want, {r[0] for r in rows})
    assert any(r[7] == "" for r in got) and {c for r in got for c in r[7]} == set("DIKR")


def test_one_conversation_holds_nearly_all_rows(spark):
    rng = random.Random(3)
    rows = [(7, i // 2, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"turn {i}."])) for i in range(900)]
    rows += [(7, 5, "user", "Often.")] * 300 + [(8, i, "ua"[i % 2] + "x", "Fine.") for i in range(4)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, cv.report(table, block=16).collect()), key=repr)
    assert got == all_brute(spark, rows, set())
    blocks = cv._blocks(cv.marked_turns(table), 16)
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert max(sizes) <= 16 and len(sizes) > 30


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hi."), (1, 2, "tool", "A call."), (1, 3, "user", "Bye."), (1, 3, "user", " ")]
    got = cv.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, "K", "system", "Be brief."), (1, 1, "I", "user", ""), (1, 2, "K", "assistant", "Hi."),
        (1, 3, "R", "user", "A call."), (1, 4, "R", "assistant", "Bye.")]
    told = cv.report(spark.createDataFrame(rows, SCHEMA)).first()
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in got).encode()).hexdigest() == told.repaired_sha256
    empty = spark.createDataFrame([], SCHEMA)
    assert cv.report(empty, ids=empty).count() == 0 and cv.repaired(empty).count() == 0


def test_ranks_order_audits():
    """Ranks of the last length order the nodes as their audits do, and pointers lead along them."""
    rng = random.Random(2)
    turns = [(1, i, rng.choice(["user", "assistant", "system", "tool"]), 0, 0, 1, rng.random() < 0.3, rng.random() < 0.2, 0, i) for i in range(30)]
    moves, togo = [], [list(cv._CLOSE)]
    for turn in reversed(turns):
        arcs = [cv._arcs(q, turn[2][:1], turn[6], turn[7]) for q in range(4)]
        here = [min(togo[-1][to] + c for _, to, c in arcs[q]) for q in range(4)]
        for _ in range(3):
            here = [min(here[q], here[cv._NEXT[q][1]] + cv.INSERT) for q in range(4)]
        togo.append(here)
        moves.append(arcs)
    togo, moves = togo[::-1], moves[::-1]
    moves = [[[("I", 4 * i + cv._NEXT[q][1], cv.INSERT), *((n, 4 * (i + 1) + to, c) for n, to, c in arcs[q])] for q in range(4)]
             for i, arcs in enumerate(moves)] + [[[]] * 4]
    label, ranks, pointers = cv.least_paths(moves, togo)
    path, node = cv.path_from(np.arange(4 * len(togo)), pointers)
    audit = ["".join("DIKR"[label[x]] for x in node[path == p]) for p in range(4 * len(togo))]

    def slow(i, q):
        best = min(((n, to) for n, to, c in moves[i][q] if togo[to // 4][to % 4] + c == togo[i][q]), default=None)
        return best[0] + slow(*divmod(best[1], 4)) if best else ""

    assert audit == [slow(*divmod(x, 4)) for x in range(4 * len(togo))]
    size = 1 << (len(ranks) - 1)
    for a in range(0, len(audit), 3):
        for b in range(len(audit)):
            assert (ranks[-1][a] < ranks[-1][b]) == (audit[a][:size] < audit[b][:size])
