import os
import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerlight.llm import token_files as tf

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_scan_over_flat_files(spark, tmp_path, block, monkeypatch):
    """Documents of all lengths, empty ones too, whatever the blocks; a rest without a mark is no document."""
    rng, files = random.Random(block), {}
    for f in range(4):
        lengths = [rng.choice([0, 0, 1, 2, 5, 40]) for _ in range(rng.randrange(0, 30))]
        ids = np.array([i for n in lengths for i in [*[rng.randrange(50256) for _ in range(n)], tf.END]] + [7] * (f % 3), "<u2")
        (tmp_path / f"part-{f}.txt").write_bytes(ids.tobytes())
        files[f"part-{f}.txt"] = lengths
    scan = tf.blocks_of
    monkeypatch.setattr(tf, "blocks_of", lambda batches: scan(batches, tf.END, block))
    got = {}
    for r in tf.counted(spark, str(tmp_path)).collect():
        got.setdefault(os.path.basename(r.path), {})[r.ordinal] = r.n_tokens
    assert got == {name: dict(enumerate(lengths)) for name, lengths in files.items() if lengths}


@pytest.mark.skipif(not os.path.exists(RANKS), reason="vocabulary file missing")
def test_against_direct_counts(spark):
    ranks = open(RANKS, "rb").read()
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "<|endoftext|>", "naïve", "日本", "\n\n", "x1"]) for _ in range(rng.randrange(0, 200)))) for i in range(300)]
    rows += [(5, "twice"), (5, "twice"), (None, "no id"), (7, None), (8, ""), (9, "long " * 200_000)]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, shard int")
    got = tf.token_counts(docs, ranks).collect()
    encode = tf.encoder(ranks).encode_ordinary
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(((d, len(encode(t or ""))) for d, t in rows), key=repr)
    assert tf.token_counts(docs.limit(0), ranks).count() == 0


def test_one_block():
    inner, head, tail = tf.scan_block(np.array([1, 2, 9, 9, 3, 9, 4], "<u2"), 9)
    assert inner.tolist() == [0, 1] and (head, tail) == (2, 1)
    assert [x if isinstance(x, int) else x.tolist() for x in tf.scan_block(np.array([1, 2], "<u2"), 9)] == [[], 2, 0]
    batch = next(tf.blocks_of(iter([pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([b""], pa.binary())], ["path", "content"])])))
    assert len(batch) == 0
