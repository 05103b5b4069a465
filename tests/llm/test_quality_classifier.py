import random
import zlib

import numpy as np

from ledgerlight.llm import quality


def text(rng, good):
    words = ["".join(rng.choice(["th", "on", "er", "in", "re", "an"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 80))]
    return " ".join(words) if good else " ".join(w + "%%%" for w in words)


def test_learns_and_holds_out(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, i % 4 > 0), "s", 0.5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 400 and all(0 <= r.score <= 1 for r in got.values())
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) >= 0.95 * len(held)


def test_whole_text_counts(spark):
    """A mark after a million bytes changes the score as one at the start does."""
    net = quality.fit([text(random.Random(i), i % 2 == 1).encode() for i in range(60)], [i % 2 for i in range(60)])
    clean = "on the rein an " * 70_000
    docs = spark.createDataFrame([(1, clean), (2, clean + " " + "thon%%% er%%% in%%% " * 50)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in quality.scored(docs, net).collect()}
    assert scores[1] > 0.5 > scores[2]


def test_pooling_matches_plain_loops():
    rng = np.random.default_rng(3)
    table = quality.Network().table()
    for n in (0, 1, 7, 8, 9, 127, 128, 129, 1000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        padded = [*data.tolist(), *[0] * 64]
        windows = max(1, -(-max(0, n - quality.WIDTH) // quality.STRIDE) + 1)
        answers = np.array([sum(table[k][padded[w * quality.STRIDE + k]] for k in range(quality.WIDTH)) for w in range(windows)])
        half = quality.CHUNK // 2
        means = [answers[lo:lo + quality.CHUNK].sum(axis=0) / quality.CHUNK for lo in range(0, windows, half)]
        want = np.concatenate([answers.max(axis=0), (np.array(means) ** 2).max(axis=0)])
        assert np.allclose(quality.pooled(table, data)[0], want, rtol=1e-3, atol=1e-4)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x"), (2, "y"), (2, "y")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality_scores(docs, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5} and [r.held_out for r in got if r.doc_id is None] == [True]
    one = spark.createDataFrame([(2, 1), (None, 0), (1, None), (7, 3)], "doc_id long, quality int")
    assert len({r.score for r in quality.quality_scores(docs, one).collect()}) == 1
    assert quality.quality_scores(docs.limit(0), one).count() == 0
