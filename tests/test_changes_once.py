from pyspark.sql import functions as F

from ledgerlight.operators import changes as ch
from ledgerlight.schemas import _schema
from ledgerlight.sources.kept import ChangeLog, KeptTable

SCHEMA = _schema("id:long v:int name:str")
OLD = [(1, 1, "a"), (2, 1, None), (3, 1, "c"), (None, 1, "none"), (5, None, "e")]
NEW = [(1, 1, "a"), (2, 2, None), (4, 1, "d"), (None, 1, "other"), (5, None, "e")]


def listed(df):
    return sorted(map(str, df.select("id", "before", "after").collect()))


def test_differing_gives_the_change_set(spark):
    old, new = spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA)
    got = listed(ch.differing(old, new, ["id"]))
    assert got == listed(ch.change_set(old, new, ["id"])) and len(got) == 4


def test_a_merge_reads_the_stored_rows_once(spark, tmp_path, monkeypatch):
    table = KeptTable(spark, str(tmp_path / "t"), ["id"], SCHEMA, "part", lambda c: c("id") % 2)
    table.merged(1, spark.createDataFrame(OLD, SCHEMA), ["v"])
    table.apply(1)
    plans, write = [], ChangeLog.write
    monkeypatch.setattr(ChangeLog, "write", lambda self, n, df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(self, n, df)))
    gone = spark.createDataFrame([(3,), (4,), (9,), (None,)], "id long")
    changes = table.merged(2, spark.createDataFrame(NEW, SCHEMA), ["v"], gone=gone)
    assert plans[0].count("Relation [") == 1
    assert listed(changes) == ["Row(id=2, before=Row(id=2, v=1, name=None), after=Row(id=2, v=2, name=None))", "Row(id=3, before=Row(id=3, v=1, name='c'), after=None)"]
    table.apply(2)
    assert sorted(r[0] for r in table.read().where(F.col("id").isNotNull()).select("id").collect()) == [1, 2, 5]
