import hashlib
import random

from ledgerlight.llm import chats

TREE = "tree long, node long, parent long, role string, text string, score double"


def formatted(spark, rows, **kw):
    return chats.conversations(spark.createDataFrame(rows, TREE), **kw)


def test_paths_of_a_tree(spark):
    rng = random.Random(3)
    parents = {(t, n): (rng.randrange(max(0, n - 4), n) if n else None) for t in range(3) for n in range(25)}
    rows = [(t, n, p, "user" if n % 2 else "assistant", f"{t}.{n}", float(n % 5)) for (t, n), p in parents.items()]
    want = {}
    for t, n in parents:
        if (t, n) not in {(t2, p) for (t2, _), p in parents.items()}:
            path, at = [], n
            while at is not None:
                path.append(at)
                at = parents[t, at]
            want[t, n] = path[::-1]
    got = {(r.tree, r.leaf): r for r in formatted(spark, rows).collect()}
    assert set(got) == set(want)
    for (t, leaf), r in got.items():
        assert [text for _, text, _, _ in chats.turns(r.formatted)] == [f"{t}.{n}" for n in want[t, leaf]]
        assert r.score == sum(n % 5 for n in want[t, leaf])
    for t in range(3):
        order = sorted((leaf for tree, leaf in got if tree == t), key=lambda leaf: (-got[t, leaf].score, leaf))
        assert [got[t, leaf]["rank"] for leaf in order] == list(range(1, len(order) + 1))
    best = formatted(spark, rows, branches=2).collect()
    assert sorted((r.tree, r.leaf) for r in best) == sorted(k for k, r in got.items() if r["rank"] <= 2)


def test_deep_chain(spark):
    rows = [(1, n, n - 1 if n else None, "user", str(n), None) for n in range(300)]
    [r] = formatted(spark, rows).collect()
    assert [text for _, text, _, _ in chats.turns(r.formatted)] == [str(n) for n in range(300)]


def test_any_text_comes_back(spark):
    rng = random.Random(7)
    parts = [*chats.CONTROL, "\\", "-", "\\-", "<", "[", "]", ">", " ", "\n", "é", "😀", "s>", "INST]", "|role|>", "/"]
    rows = []
    for t in range(200):
        for n in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "", None, "a</s>b", "<|/role|>"])
            rows.append((t, n, n - 1 if n else None, role, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))), 0.0))
    told = {}
    for t, n, _, role, text, _ in rows:
        told.setdefault(t, []).append((role or "", text))
    out = formatted(spark, rows)
    for r in out.collect():
        assert [x[:2] for x in chats.turns(r.formatted)] == told[r.tree]
        loss = [chats.restored(r.formatted[s.start:s.end]) for s in r.loss]
        assert loss == [text for role, text in told[r.tree] if role == "assistant"]
    for r in chats.digests(out).collect():
        mine = told[r.tree]
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        loss = "".join(text for role, text in mine if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_odd_rows(spark):
    rows = [(1, 1, None, "user", None, None), (1, 2, 99, "assistant", "orphan", 1.0), (None, 1, None, "user", "x", 0.0), (1, None, None, "user", "x", 0.0),
            (5, 1, 2, "user", "a", 0.0), (5, 2, 1, "user", "b", 0.0)]
    got = {(r.tree, r.leaf): [x[:2] for x in chats.turns(r.formatted)] for r in formatted(spark, rows).collect()}
    assert got == {(1, 1): [("user", "")], (1, 2): [("assistant", "orphan")]}     # a cycle has no path
    assert formatted(spark, rows[:0]).count() == 0
    table = spark.createDataFrame([(1, 2, "user", "b", 0), (1, None, "user", None, 0), (1, 2, "user", "a", 0), (1, 2, "user", "a", 0)],
                                  "conv_id long, turn long, role string, text string, node int")
    [r] = chats.conversations(chats.as_tree(table)).collect()
    assert [x[1] for x in chats.turns(r.formatted)] == ["", "a", "a", "b"]
