import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from ledgerlight.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, uid string, part long"
SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) by a forward table over (row, state), strings compared as they are."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def closed(table):
        for _ in range(4):
            for state, (cost, audit, out) in list(table.items()):
                role = due[state]
                new = (cost + 5, audit + "I", out + ((name[role], ""),))
                if role not in table or new[:2] < table[role][:2]:
                    table[role] = new
        return table

    best = closed(best)
    for role, text, fault in rows:
        after = {}

        def offer(state, cost, audit, out):
            if state not in after or (cost, audit) < after[state][:2]:
                after[state] = (cost, audit, out)

        for state, (cost, audit, out) in best.items():
            offer(state, cost + 2, audit + "D", out)
            if fault in ("blank", "duplicate"):
                continue
            late = 5 if fault == "truncated" else 0
            if role[:1] in ({"s", "u"} if state == "" else {due[state]}):
                offer(role[0], cost + late, audit + "K", out + ((role, text),))
            offer(due[state], cost + 1 + late, audit + "R", out + ((name[due[state]], text),))
        best = closed(after)
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows):
    by = defaultdict(list)
    for r in damage(rows):
        by[r[0]].append(r[1:])
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, told, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            fault = ("blank" if not text.strip(SPACES) else "duplicate" if (role, text) in seen
                     else "truncated" if text.rstrip(SPACES)[-1] not in ".!?" else None)
            seen.add((role, text))
            told.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, fixed = cheapest(told)
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    out = repair.damage_report(df).collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


def random_rows(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        length = rng.randint(1, longest)
        for turn in range(length):
            role = rng.choices(["user", "assistant", "system", "tool", "", None, "aide", "User"], [8, 8, 2, 1, 0.3, 0.3, 0.3, 0.3])[0]
            if rng.random() < 0.6:
                role = ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "Why?  ", "", " \t", None, "cut off", "word. and", "a\x0b", "Été. ", f"t{turn}.", f"t{turn}?"])
            rows.append((conv, None if rng.random() < 0.03 else turn + (turn > 5), role, text))
    return rows


def test_against_brute_force(spark):
    rows = random_rows(3, 250, 14) + [(None, None, None, None), (None, 1, "user", "x."), (900, 2, "system", "only."), (901, 1, "assistant", "a?")]
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize("size", [3, 7, 40])
def test_pieces_of_conversations(spark, monkeypatch, size):
    """Parts of a few rows: nearly every conversation lies in several."""
    monkeypatch.setattr(repair, "PART_ROWS", size)
    rows = random_rows(size, 8, 45)
    assert got(spark, rows) == expected(rows)


def test_one_long_conversation_of_equal_rows(spark, monkeypatch):
    """All rows but a few the same, at the same turn: they are spread over parts, and one stays."""
    monkeypatch.setattr(repair, "PART_ROWS", 200)
    rows = [(5, 3, "user", "same."), (5, 4, "assistant", "x" * 200_000 + "!"), (6, None, "system", "s."), (6, 1, "user", "q?")] + [(5, 3, "user", "same.")] * 1500
    assert got(spark, rows) == expected(rows)


def test_all_dropped_and_empty(spark):
    dropped = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone.")]
    assert got(spark, rows) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} == expected(rows)
    assert got(spark, []) == {}


def test_repaired_messages(spark):
    """The operator's own rows: edits in order, with roles and texts."""
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (1, 2, "assistant", "Yes."), (1, 3, "user", " ")], "conv_id long, turn long, role string, text string")
    numbered = repair.numbered_messages(repair.messages(rows))
    edits, _ = repair.edited(repair.in_order(numbered))
    out = [(r.edit, r.role, r.text) for r in repair.repaired(numbered, edits).orderBy("place", "nth").collect()]
    assert out == [("D", None, None), ("K", "user", "There?"), ("K", "assistant", "Yes."), ("D", None, None)]


def test_ranks_choose_among_equal_costs():
    """Two deletions or a new role cost alike in places: the string of edits decides, compared over its whole length."""
    for seed in range(200):
        rng = random.Random(seed)
        roles = rng.choices("uas-", k=rng.randint(1, 9))
        faults = rng.choices([None, "truncated", "blank"], [6, 2, 1], k=len(roles))
        rows = repair.pa.table({"place": list(range(len(roles))), "part": [0] * len(roles), "uid": list(range(len(roles))), "conv_id": [1] * len(roles),
                                "initial": repair.pa.array([" sua".find(r) if r in "sua" else 0 for r in roles], repair.pa.int32()), "fault": repair.pa.array(faults, repair.pa.string())})
        none = repair.pa.table({c: repair.pa.array([], t) for c, t in (("conv_id", repair.pa.int64()), ("after", repair.pa.list_(repair.pa.int64())), ("final", repair.pa.bool_()), ("entry", repair.pa.int32()))})
        out = repair.edits_of(rows, none)
        cost, audit, _ = cheapest([(r, "t", f) for r, f in zip(roles, faults)])
        assert ("".join(out["edit"].to_pylist()), sum(out["cost"].to_pylist())) == (audit, cost)
