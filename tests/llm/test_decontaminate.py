import random

import numpy as np
import pytest

from ledgerlight.llm import decontaminate as dc


def edits(a, b):
    """Least edits between a and any stretch of b, by the full table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def word(rng):
    return "".join(rng.choice(["th", "on", "er", "in", "ou", "é"]) for _ in range(rng.randrange(1, 5)))


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at:at + rng.randrange(2)] = rng.choice(["x", "", " "])
    return "".join(out)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12)))
        b = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 20)))
        want = edits(a, b)
        assert dc.best_edits(a, b, len(a)) == want
        assert want == 0 or dc.best_edits(a, b, want - 1) is None


def test_against_brute_force(spark):
    """Every leak of up to half the allowed edits is found, at least 95 % of all, and nothing that isn't one."""
    rng = random.Random(2)
    items = [(i, " ".join(word(rng) for _ in range(rng.randrange(12, 40)))) for i in range(30)]
    docs = []
    for d in range(150):
        text = " ".join(word(rng) for _ in range(60))
        if d % 3:
            item = rng.choice(items)[1]
            text += " " + edited(rng, item, rng.randrange(0, len(item) // 9)) + "\n\t " + " ".join(word(rng) for _ in range(20))
        docs.append((d, text.upper() if d % 7 == 0 else text))
    want = {}
    for d, text in docs:
        for i, item in items:
            a, b = dc.normal(item), dc.normal(text)
            if (n := dc.best_edits(a, b, int(dc.RATE * len(a)))) is not None:
                want[d, i] = n / len(a)
    got = {(r.doc_id, r.item_id): r.edits for r in dc.leaks(
        spark.createDataFrame([(0, *x) for x in docs], "edits int, doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want) and len(want) > 60
    assert {k for k, share in want.items() if share <= dc.RATE / 2} <= set(got)


def test_item_blocks_and_batches_agree(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(word(rng) for _ in range(20))) for i in range(9)]
    docs = spark.createDataFrame([(d, "a b c " + items[d % 9][1]) for d in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, dc.leaks(docs, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_BYTES", 200)
    assert len(list(dc.blocks(bench))) > 2 and sorted(map(tuple, dc.leaks(docs, bench).collect())) == whole
    assert [(d, d % 9, 0) for d in range(20)] == whole


def test_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank today"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "short one"), (None, item), (6, "exactly 20 characters")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, item, 0), (3, item, 0), (None, "x " + item, 0), (5, "short one", 0),
                                  (6, "THE  quick\nbrown fox jumps over the lazy dog near the river bank today", 0),
                                  (7, "z " * 300_000 + item, 0), (8, "it is exactly 20 characters long", 0)], "doc_id long, text string, leaks int")
    got = sorted(map(tuple, dc.leaks(docs, bench).collect()), key=repr)
    assert got == sorted([(3, 1, 0), (6, 1, 0), (7, 1, 0), (8, 6, 0), (None, 1, 0)], key=repr)
    left = dc.without_leaks(docs, bench)
    assert left.columns == docs.columns and sorted((r.doc_id, r.leaks) for r in left.collect()) == [(1, 0), (2, 0), (5, 0)]
    assert dc.leaks(docs.limit(0), bench).count() == 0 and dc.leaks(docs, bench.limit(0)).count() == 0


def test_windows_see_no_neighbour_text():
    data = "abc def".encode() + "ghi".encode()
    text, begin = dc.normalised(np.frombuffer(data, np.uint8), np.array([0, 7, 7, 10]))
    assert text.tobytes() == b"abc def\0\0ghi\0" and begin.tolist() == [0, 8, 9]
    assert dc.starts_of(text).tolist() == [0, 4, 9]


@pytest.mark.parametrize("rate", [0.02, 0.05])
def test_expected_recall_is_a_lower_estimate(rate):
    assert dc.expected_recall(15, rate) >= 0.95


def test_every_leak_is_found_at_any_length(spark):
    """Recall 1 at the full tenth of edits, by item length, with the least edits of the whole text."""
    rng = random.Random(11)
    items, docs = [], []
    for n in (16, 19, 20, 21, 29, 30, 44, 50, 60, 80, 120, 233, 600):
        for _ in range(12):
            item = " ".join(word(rng) for _ in range(n))[:n].encode()[:n].decode("utf-8", "ignore").strip().ljust(n, "q")
            item = item if len(item.encode()) == n else "w" * (n - 5) + " aeio"
            leak = edited(rng, item, int(dc.RATE * n))
            docs.append((len(items), " ".join(word(rng) for _ in range(25)) + " " + leak + " " + " ".join(word(rng) for _ in range(9))))
            items.append((len(items), item))
    got = {(r.doc_id, r.item_id): r.edits for r in dc.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for (i, text), (_, item) in zip(docs, items):
        a = dc.normal(item)
        want = dc.best_edits(a, dc.normal(text), int(dc.RATE * len(a)))
        assert want is None or got.get((i, i)) == want
    assert sum((i, i) in got for i, _ in items) > 0.9 * len(items)


def test_parts_cover_an_item_and_outnumber_its_edits():
    for n in range(dc.MIN_ITEM, 1500):
        parts = dc.parts_of(n)
        assert len(parts) == int(dc.RATE * n) + 1 and [p[0] for p in parts] == [0, *(p[1] for p in parts[:-1])] and parts[-1][1] == n
        assert min(p[1] - p[0] for p in parts) >= dc.LEVELS[0] and max(p[5] - p[4] for p in parts) <= 64
        assert sum(most + 1 for *_, most in {p[4:] for p in parts}) == len(parts)


@pytest.mark.parametrize("before, after", [('say "', '" now'), ("see (", ") then"), ("x=[", "]"), ("glued", "on"), ("「", "」と"), ("", "")])
def test_unedited_leaks_are_found_whatever_stands_around(spark, before, after):
    rng = random.Random(17)
    items = [(n, " ".join(word(rng) for _ in range(n))[:n].strip().ljust(n, "q")) for n in (16, 17, 25, 39, 40, 46, 90)]
    chinese = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    items += [(101, chinese(6)), (102, chinese(30)), (103, "https://example.org/a/b?c=" + chinese(3)), (104, "for(i=0;i<n;i++){s+=a[i];}")]
    docs = [(i, f"{word(rng)} {chinese(9)}{before}{item}{after}{chinese(9)} {word(rng)}") for i, item in items]
    got = {tuple(r) for r in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                      spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, i, 0) for i, _ in items} <= got


def test_a_plan_holds_one_block(spark, monkeypatch):
    items = [(i, f"item number {i} of a benchmark of several blocks") for i in range(4)]
    monkeypatch.setattr(dc, "BLOCK_BYTES", 50)
    out = dc.marked(spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert all(r.doc_id in [x.item_id for x in r.leaks if x.edits == 0] for r in out.collect())


def test_short_items_are_found_verbatim_between_word_boundaries(spark):
    items = [(1, "a"), (2, "42"), (3, "café au lait"), (4, "用户"), (5, "x = y;"), (6, "fifteen bytes !"), (6, "Fifteen  BYTES\n!"), (7, "  "), (8, "caf"),
             (9, "a long item that is embedded as before")]
    docs = [(1, "A cat"), (2, "b42 420 4-2"), (3, "(42)"), (4, "un CAFé AU LAIT?"), (5, "un café au laité"), (6, "我用户名"), (7, "if(x = y;)"),
            (8, "fifteen bytes !fifteen bytes !"), (9, None), (10, ""), (11, "4"), (12, "2 a long item that is embedded as before"), (13, "z" * 200_000 + " 42"), (42, "4")]
    got = sorted((r.doc_id, r.item_id, r.edits) for r in dc.leaks(
        spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"), short=True).collect())
    assert got == [(1, 1, 0), (3, 2, 0), (4, 3, 0), (6, 4, 0), (7, 5, 0), (8, 6, 0), (12, 1, 0), (12, 9, 0), (13, 2, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_short_items_against_every_place(spark, seed):
    rng = random.Random(seed)
    pick = lambda n: "".join(rng.choice("ab 1é,") for _ in range(n))
    items, docs = [(i, pick(rng.randrange(1, 6))) for i in range(40)], [(d, pick(rng.randrange(0, 60))) for d in range(60)]
    letter = lambda c: c in "ab1é"
    want = set()
    for d, text in docs:
        t = dc.normal(text).decode()
        for i, item in items:
            x = dc.normal(item).decode()
            for at in range(len(t) - len(x) + 1) if x else ():
                end = at + len(x)
                if t[at:end] == x and not (at and letter(t[at - 1]) and letter(x[0])) and not (end < len(t) and letter(t[end]) and letter(x[-1])):
                    want.add((d, i, 0))
    got = {tuple(r) for r in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), short=True).collect()}
    assert got == want and len(want) > 30
