"""The pipeline stage by stage against plain Python versions, on a small corpus with all kinds of planted cases."""

import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as cp
import test_jaccard
import test_line_chunks
from ledgerlight.llm import decontaminate, quality, queries

pytestmark = pytest.mark.skipif(not os.path.exists(queries.PIECE_MODEL), reason="vocabulary file missing")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, leaks int"


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["th", "on", "er", "in", "ou"]) for _ in range(3))
    line = lambda n=12: " ".join(word() for _ in range(n))
    passage, items = [line(), line(55), line(20), line()], [line(30) for _ in range(5)]
    docs = []
    for i in range(160):
        lines = [line(rng.randrange(5, 30)) for _ in range(rng.randrange(2, 6))]
        if i % 8 == 1:
            lines = [" ".join(w + "%%%" for w in x.split()) for x in lines]
        if i % 5 == 2:
            lines[1:1] = passage
        if i % 11 == 3:
            lines.append(f"start {items[i % 5]} end")
        docs.append("\n".join(lines))
    docs += [docs[0]] * 6 + [docs[4].replace(docs[4].split()[7], "changed", 1), docs[6] + " tail", None, "", "one word"]
    rows = [(i, t, "en", "s0", None if t is None else len(t), "own", 7) for i, t in enumerate(docs)] + [(None, "no id here", None, None, 10, "own", 7)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 8 == 1 else 1) for i in range(160)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def stage(spark, name, docs, folder):
    return cp.stored(dict(cp.STAGES)[name](spark, docs, folder), name)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    key = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=repr)

    good = stage(spark, "quality_classifier", docs, tables)
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs.drop("score"), queries.table(spark, tables, "labels")).collect()}
    assert key(good.collect()) == key(r for r in docs.collect() if scores[r.doc_id] >= 0.3)
    kept = {r.doc_id for r in good.collect()}
    assert all((i in kept) == (i % 8 != 1) for i in range(160))

    cut = stage(spark, "line_dedup", good, tables)
    want = test_line_chunks.brute([(r.doc_id if r.doc_id is not None else -1, r.text) for r in good.collect()])
    rows = cut.collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in rows), key=repr) == sorted((w[:2] for w in want), key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)

    single = stage(spark, "ngram_jaccard", cut, tables)
    groups = test_jaccard.brute([(r.doc_id, r.text) for r in rows])
    assert sorted((r.doc_id for r in single.collect()), key=repr) == sorted((d for d, _, c in groups if d == c), key=repr)

    clean = stage(spark, "decontamination", single, tables)
    items = [decontaminate.normal(r.text) for r in queries.table(spark, tables, "benchmark").collect()]
    leaks = lambda t: any(decontaminate.best_edits(i, decontaminate.normal(t), int(0.1 * len(i))) is not None for i in items)
    assert key(clean.collect()) == key(r for r in single.collect() if not leaks(r.text))
    for df in (good, cut, single, clean):
        assert df.columns == docs.columns and {(r.score, r.leaks) for r in df.collect()} == {("own", 7)}

    last = stage(spark, "sentencepiece", clean, tables).collect()
    assert sorted((r.doc_id for r in last), key=repr) == sorted((r.doc_id for r in clean.collect()), key=repr)
    whole = entry.queries()["pipeline"](spark, tables)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, last))


def test_jaccard_stage_chooses_rows_and_not_ids(spark, tmp_path):
    rows = test_jaccard.repeated_ids()
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t), "own", 7) for i, t in rows], COLUMNS)
    got = sorted((r.doc_id, r.text) for r in stage(spark, "ngram_jaccard", docs, str(tmp_path)).collect())
    three = [r for r in got if r[0] == 3 and r[1].strip()]
    assert len(three) == 1 and three[0] in rows
    assert [r for r in got if r not in three] == sorted([rows[0], rows[2], rows[4], (3, ""), (3, " ")])


def test_empty_documents(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, run in cp.STAGES:
        docs = cp.stored(run(spark, docs, tables), name)
        assert docs.count() == 0


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
