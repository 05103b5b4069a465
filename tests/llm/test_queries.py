"""The subpackage's queries on the smallest driver tables: against their SQL, or against what their contracts say."""

import os
import zlib
from collections import Counter

import pytest

import __spark_entry__ as entry
from ledgerlight.llm import queries
from oracle import check

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables missing")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    _, problem = check.compare(spark, check.connect(FOLDER), FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert not problem


@pytest.mark.parametrize("name, columns", [
    ("op2_quality_classifier", ["doc_id", "held_out", "score", "predicted"]), ("op4_ngram_jaccard_join", ["doc_id", "n_shingles", "component_id"]),
    ("op5_onebit_neighbours", ["query_id", "rank", "vec_id", "score"]), ("op8_token_counts", ["doc_id", "n_tokens"]),
    ("op3_sentencepiece_wfst", ["doc_id", "n_tokens", "n_bytes", "ids", "decoded_sha256"]),
    ("op13_bpe_merge_rounds", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])])
def test_columns_and_rows(spark, name, columns):
    out = entry.queries()[name](spark, FOLDER)
    docs = queries.table(spark, FOLDER, "documents").count()
    asked = queries.table(spark, FOLDER, "embeddings").where("vec_id % 20 = 0").count()
    assert out.columns == columns and out.count() == (asked * 20 if "op5" in name else docs)


def test_resharding_keeps_every_document(spark):
    got = entry.queries()["op7_resharding"](spark, FOLDER).collect()
    want = {r.doc_id: (r.text or "").encode() for r in queries.table(spark, FOLDER, "documents").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {d: (len(t) + 16, zlib.crc32(t)) for d, t in want.items()}
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1


def test_quality_on_held_out_rows(spark):
    """Most of the labelled held-out rows of a larger table are right."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("driver tables missing")
    got = {r.doc_id: r for r in entry.queries()["op2_quality_classifier"](spark, folder).collect()}
    held = [r for r in queries.table(spark, folder, "labels").collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.quality for r in held) >= 0.93 * len(held)


def test_conversation_repair_of_the_table(spark):
    """The whole table against the plain Python version of the operator's own tests."""
    from test_repair import expected
    rows = [tuple(r) for r in queries.table(spark, FOLDER, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in entry.queries()["op11_conversation_repair"](spark, FOLDER).collect()}
    assert got == expected(rows)
