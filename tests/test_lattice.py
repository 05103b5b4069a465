import random
from collections import defaultdict
from itertools import combinations

import pytest

from ledgerlight.operators import lattice

DIMS = ["a", "b", "c", "d", "e", "f", "g", "ident"]
SUMS = {"n": "bigint", "usd": "decimal(18,2)"}


def brute(data, dims):
    out = defaultdict(int)
    for size in (0, 1, 2):
        for pick in combinations(range(len(dims)), size):
            for row in data:
                out[",".join(dims[i] for i in pick), tuple(row[i] for i in pick)] += row[-1]
    return dict(out)


@pytest.fixture
def store(spark, tmp_path):
    def keep(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))
    return keep


def test_every_pair_against_brute_force(spark, store, tmp_path):
    """Seven dimensions of a few values, one of them hot and one with nulls, and an id; also that pairs come from unions."""
    rnd = random.Random(3)
    data = [(*(rnd.choice("xxxxyz"[:k]) for k in (5, 6, 6, 4, 6, 6)), rnd.choice([None, "p,q"]), str(i), rnd.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(data, ", ".join(f"{d} string" for d in DIMS) + ", n long").selectExpr("*", "cast(n as decimal(18,2)) as usd")
    got = lattice.groupings(df, DIMS, SUMS, store).collect()
    found = {(r["grouping"], tuple(r["labels"])): r["n"] for r in got}
    assert len(found) == len(got) and found == brute(data, DIMS) and all(r["usd"] == r["n"] for r in got)
    unions = lattice._sizes(spark.read.parquet(str(tmp_path / "unions")))
    assert len(unions) == 3 and not any("ident" in u for u in unions) and max(unions.values()) < 400


def test_smallest_parent():
    sizes = {("a", "b", "c"): 9, ("a", "b"): 9, ("b", "c"): 4}
    assert lattice.smallest_parents([("a",), ("b",), ("a", "c")], sizes) == {("a", "b"): [("a",)], ("b", "c"): [("b",)], ("a", "b", "c"): [("a", "c")]}


@pytest.mark.parametrize("dims", [["a"], ["a", "b"], ["a", "b", "c"]])
def test_few_dimensions_repeats_and_no_rows(spark, store, tmp_path, dims):
    data = [(*"xyz"[:len(dims)], 2), (*"xyz"[:len(dims)], 2), (*"xxx"[:len(dims)], 1)]
    df = spark.createDataFrame(data, ", ".join(f"{d} string" for d in dims) + ", n long")
    found = {(r["grouping"], tuple(r["labels"])): r["n"] for r in lattice.groupings(df, dims, {"n": "bigint"}, store).collect()}
    assert found == brute(data, dims)

    def other(rows, name):
        rows.write.parquet(str(tmp_path / f"empty-{name}"))
        return spark.read.parquet(str(tmp_path / f"empty-{name}"))
    assert [tuple(r) for r in lattice.groupings(df.limit(0), dims, {"n": "bigint"}, other).collect()] == [("", [], None)]
