import random

from helpers import rows
from ledgerlight.operators import distinct


def test_unions_equal_count_distinct(spark):
    """Sparse and large ids, negative ones, ranges beyond SPARSE ids, repeats and nulls."""
    rng = random.Random(4)
    ids = [None, -1, -(1 << 62), (1 << 62) + 5, 0, 32767, 32768, *range(100_000, 101_200), *(rng.randrange(1 << 40) for _ in range(200))]
    data = [(rng.choice([1, 2, 3, None]), rng.randrange(1, 60), i) for i in ids * 3]
    df = spark.createDataFrame(data, "agent long, day int, client long")
    sets = distinct.id_sets(df, ["agent", "day"], "client").cache()
    wide = distinct.id_sets(df.selectExpr("agent", "client"), ["agent"], "client")
    assert wide.where("bitmap is not null").count() and wide.where("places is not null").count()
    for source in (sets, wide):
        want = df.selectExpr("agent", "client").distinct().where("client is not null").groupBy("agent").count()
        assert rows(distinct.counted(source, ["agent"]), "agent", "clients") == rows(want, "agent", "count")
    month = sets.selectExpr("agent", "floor(day / 30) AS month", "id_range", "places", "bitmap")
    want = df.selectExpr("floor(day / 30) AS month", "client").distinct().where("client is not null").groupBy("month").count()
    assert rows(distinct.counted(month, ["month"]), "month", "clients") == rows(want, "month", "count")
    assert distinct.counted(sets, []).first().clients == df.select("client").distinct().count() - 1


def test_empty(spark):
    none = spark.createDataFrame([], "agent long, client long")
    sets = distinct.id_sets(none, ["agent"], "client")
    assert distinct.counted(sets, ["agent"]).count() == 0 and distinct.counted(sets, []).first().clients == 0
