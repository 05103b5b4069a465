from datetime import datetime

from ledgerlight.schemas import SCHEMAS


def ts(text):
    return datetime.fromisoformat(text)


def frame(spark, name, rows):
    """Rows given as dicts over the full schema of a table; missing columns are NULL."""
    schema = SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
