import random
import re

import numpy as np
from pyspark.sql import functions as F

from ledgerlight.llm import jaccard, shingles
from ledgerlight.llm.components import components
from ledgerlight.llm.storage import sieved

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and None not in (rows[i][0], rows[j][0]) and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted(((d, len(sets[i]), (least[top(i)] if sets[i] else d) if d is not None else None) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed=4):
    """Families of edited copies whose members are often linked only through others, shared passages, exact copies, odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["on", "th", "er", "in"]) for _ in range(3))
    passage, texts = [word() for _ in range(30)], []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(20, 120))]
        chain = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy = list(chain if rng.random() < 0.5 else base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            chain = copy
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(n)]) for n in (3, 5, 8, 8, 20, 40)] + [texts[0]] * 5
    texts += ["One two three", "one  two\tTHREE", "one", "", "  \n", "w " * 3000, "w " * 2000, "a b c d e", "a b c d e f"]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    rows = corpus() + [(900, None), (None, "a b c d e"), (None, None), (3, "a b c d e"), (3, "a b c d e")]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n int, key string")
    got = [tuple(r) for r in jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_tiles_lose_no_link(spark, monkeypatch):
    """Small tiles, and no centres, so that every link comes out of the trees."""
    monkeypatch.setattr(jaccard, "TILE", 3)
    monkeypatch.setattr(jaccard, "centred", lambda shared: shared.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0))
    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_rules_out_only_what_cannot_link():
    rng = np.random.default_rng(2)
    points = rng.poisson(0.4, (700, 64)).astype(np.uint16)
    points[100:160] = points[100] + (rng.random((60, 64)) < 0.05)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = jaccard.RTree(points, sizes)
    for q in range(0, 700, 23):
        overlap = np.minimum(points, points[q]).sum(axis=1)
        want = (7 * overlap >= 3 * (sizes + sizes[q])) & (4 * sizes >= 3 * sizes[q]) & (3 * sizes <= 4 * sizes[q])
        assert sorted(tree.search(points[q], sizes[q])) == list(np.flatnonzero(want))


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(5, 60), (70, 71), (71, 70), (70, 70), (None, 3)] + [(200, j) for j in range(201, 260)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in (*range(10, 61), 5)} == {5} and got[70] == got[71] == 70 and {got[j] for j in range(200, 260)} == {200}


def test_sieve_keeps_what_is_wanted(spark):
    rows, wanted = spark.range(20_000).withColumn("id2", F.col("id") * 7), spark.range(50).selectExpr("id * 100 AS w")
    kept = [r.id for r in sieved(rows, F.col("id"), wanted).collect()]
    assert set(range(0, 5000, 100)) <= set(kept) and len(kept) < 100


def test_long_text_is_one_chunk():
    import pyarrow as pa
    text = " ".join(f"w{i}" for i in range(100_000))
    sets = list(shingles.shingle_sets(pa.array(["a b c d e", text, None, "x"])))
    assert [len(s) for s in sets] == [1, 99_996, 0, 1]


def repeated_ids():
    """Rows that share doc_id 5 but not the text: one is like document 1, one like 9, one like none, and two of 3 are alike."""
    rng = random.Random(12)
    a, b, c, d = (" ".join("".join(rng.choice(["on", "th", "er", "in"]) for _ in range(4)) for _ in range(40)) for _ in range(4))
    return [(1, a), (5, a + " more"), (5, b), (9, b + " more"), (5, c), (3, d), (3, d + " more"), (3, d.upper()), (3, ""), (3, " ")]


def test_rows_that_share_an_id_are_separate_members(spark):
    rows = repeated_ids()
    got = [tuple(r) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == brute(rows)
