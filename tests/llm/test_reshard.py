import itertools
import random
import zlib
from collections import Counter

from ledgerlight.llm import reshard as rs


def test_flow_is_cheapest():
    """Small transport problems against all ways to fill them."""
    rng = random.Random(1)
    for _ in range(40):
        supply, room = [rng.randrange(1, 4) for _ in range(2)], [rng.randrange(0, 4) for _ in range(3)]
        price = [[rng.randrange(0, 9) for _ in room] for _ in supply]
        arcs = [(0, 1 + i, s, 0) for i, s in enumerate(supply)] + [(3 + j, 6, r, 0) for j, r in enumerate(room)]
        arcs += [(1 + i, 3 + j, 9, price[i][j]) for i in range(2) for j in range(3)]
        flow = rs.min_cost_flow(7, arcs, 0, 6)
        amount, cost = sum(flow[:2]), sum(f * a[3] for f, a in zip(flow, arcs))
        best = min((-sum(w), sum(n * p for n, p in zip(w, sum(price, [])))) for w in itertools.product(range(4), repeat=6)
                   if sum(w[:3]) <= supply[0] and sum(w[3:]) <= supply[1] and all(w[j] + w[3 + j] <= room[j] for j in range(3)))
        assert (-amount, cost) == best


def test_transfers_even_out():
    rng = random.Random(2)
    for old, new in ((4, 6), (6, 4), (5, 5), (1, 3)):
        blocks = [rs.Block(s, b, n := rng.randrange(0, 40), n * rng.randrange(20, 200)) for s in range(old) for b in range(7)]
        count = Counter()
        for b in blocks:
            count[b.shard] += b.rows
        seen = Counter()
        for shard, bucket, first, stop, target in rs.transfers(blocks, new):
            assert stop > first == seen[shard, bucket] and target != shard
            seen[shard, bucket] = stop
            count[shard] -= stop - first
            count[target] += stop - first
        assert all(count[s] == 0 for s in range(new, old))
        counts = [count[s] for s in range(new)]
        assert max(counts) - min(counts) <= 1
        even = sum(b.rows for b in blocks) // new
        least = sum(max(0, sum(b.rows for b in blocks if b.shard == s) - (even + 1 if s < new else 0)) for s in range(old))
        assert sum(seen.values()) <= least + new                  # no more rows than the counts need


def test_rows_law(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(0, 3000) + "ü") for i in range(700)] + [(5, "same")] * 40 + [(None, "n"), (9, None), (10, "")]
    docs = spark.createDataFrame([(a, b, a, "y") for a, b in rows], "doc_id long, text string, size long, shard string")
    got = rs.resharded(docs, 5, 7).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_only_files_with_moves_are_rewritten(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * (i % 50)) for i in range(400)], "doc_id long, text string")
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    rs.write_old(docs, old, 4)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "old").rglob("*.parquet")}
    schema = spark.read.parquet(old).schema
    layout = rs.reshard(spark, old, new, schema, 5)
    assert layout.count() == 400 and {p: p.stat().st_mtime_ns for p in before} == before
    assert len(list((tmp_path / "new").rglob("*.parquet"))) < len(before)


def test_empty_table(spark):
    assert rs.resharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
