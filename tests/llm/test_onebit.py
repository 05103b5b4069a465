import numpy as np

from ledgerlight.llm import onebit


def brute(rows, k=onebit.NEAREST):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = min(v, good.get(i, v))
    out = {}
    for q, v in good.items():
        if q % 20 == 0:
            scores = [(-float(np.dot(v, w)), i) for i, w in good.items() if i != q and len(w) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def search(spark, rows, kind="float"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS v", "2 AS rank", "'x' AS dim", "'y' AS code", "0 AS norm")
    index = onebit.indexed(onebit.fit_to_search(table)).cache()
    found = onebit.searched(index.where("vec_id % 20 = 0").select("vec_id", "v", "dim"), index).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def data(n=1500, dim=48, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.2, 3, (n, 1))
    x[200:260] = x[200] + rng.normal(size=(60, dim)) * 0.05
    x[300:420] = x[300]                            # many copies of one vector
    return [(i, [float(np.float32(y)) for y in row]) for i, row in enumerate(x)]


def test_recall_and_exact_scores(spark, monkeypatch):
    rows = data()
    want = brute(rows)
    for numbers in (onebit.CELL_NUMBERS, 48 * 100):    # one cell, and many
        monkeypatch.setattr(onebit, "CELL_NUMBERS", numbers)
        got = search(spark, rows)
        hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
        assert set(got) == set(want) and hits >= 0.97 * 20 * len(want)
        exact = dict(rows)
        assert all(abs(s - np.dot(exact[q], exact[i])) < 1e-9 for q in got for i, s in got[q])
    assert [i for i, _ in got[320]] == [i for i, _ in want[320]]   # ties go to smaller ids


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]),
            (7, []), (None, [1.0, 1.0]), (8, [2.0, 0.0, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 3.0]), (40, [1.0, 1.0, 1.0]), (60, [9.0])]
    got = search(spark, rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [1, 20], 20: [1, 0], 40: [8]}
    assert search(spark, rows[:0]) == {} and search(spark, [(1, [1.0])]) == {}


def test_estimates_are_close_and_bounded():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(4000, 64)), rng.normal(size=(8, 64))
    codes, norms, own = onebit.coded(x)
    true = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / norms[:, None]).T
    spread = onebit.BOUND * np.sqrt((1 - own * own) / (own * own) / 63)
    error = np.abs(onebit.estimates(codes, own, onebit.planes(q)) - true)
    assert (error <= spread).mean() > 0.98 and abs((onebit.estimates(codes, own, onebit.planes(q)) - true).mean()) < 0.01


def test_very_small_and_very_large_numbers(spark):
    """Squares and norms beyond the range of doubles lose no neighbour."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 16))
    size = 10.0 ** rng.choice([-200.0, -170.0, 0.0, 120.0], 400)
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, size))]
    rows += [(400, [1e170] * 16), (401, [1e-200] + [0.0] * 15), (420, [1e-160] * 16), (440, [5e-324] * 16), (441, [1e200] * 16)]
    got, want = search(spark, rows, "double"), brute(rows)
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in want)
    for q in want:
        mine, best = [s for _, s in got[q]], [s for _, s in want[q]]
        assert all(a == b or abs(a - b) <= 1e-9 * abs(b) for a, b in zip(mine, best))
