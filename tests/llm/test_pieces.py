import os
import random
import struct

import pytest

from ledgerlight.llm import pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
given = pytest.mark.skipif(not os.path.exists(MODEL), reason="vocabulary file missing")
PARTS = ["the ", "  ", "   ", " ", "a", "bb", "aaa", "日本", "執", "\n", "\t", "x1", "23", "é", "😀", ".", "-", "==", "ing", "    ", "0000", "▁", "ation"]


@given
def test_equals_the_library(spark):
    import sentencepiece
    data = open(MODEL, "rb").read()
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 25))) for _ in range(600)] + ["", " ", "word " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.tokenised(docs, pieces.model_bytes(spark, MODEL)).collect()}
    for i, text in enumerate(texts):
        assert got[i].ids == library.encode(text) and got[i].n_tokens == len(got[i].ids)
        assert got[i].decoded == library.decode(got[i].ids)
        if "▁" not in text:
            assert got[i].decoded == text
        assert got[i].n_bytes == sum(library.is_byte(t) for t in got[i].ids)


@given
def test_odd_rows(spark):
    model = pieces.model_bytes(spark, MODEL)
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, "a b"), (1, "a b")], "doc_id long, text string").selectExpr("*", "'x' ids", "0 decoded")
    got = pieces.tokenised(docs, model).collect()
    assert sorted(r.n_tokens for r in got) == [0, 2, 2, 2] and {r.decoded for r in got} == {"", "a b"}
    assert pieces.tokenised(docs.limit(0), model).count() == 0


def field(number, kind, value):
    if kind == 0:
        return bytes([number << 3, value])
    return bytes([number << 3 | kind]) + (bytes([len(value)]) if kind == 2 else b"") + value


def test_unigram_takes_the_cheapest_path():
    scores = {"<unk>": (0.0, 2), "▁": (-2.0, 1), "a": (-1.0, 1), "b": (-1.5, 1), "ab": (-2.0, 1), "ba": (-3.0, 1), "▁a": (-2.2, 1)}
    body = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, t)) for p, (s, t) in scores.items())
    model = pieces.Model(body + field(2, 2, field(3, 0, 1)) + field(3, 2, field(4, 0, 0)))
    names = list(scores)

    def best(run):
        ways = [(0.0, ())] if not run else []
        for n in range(1, len(run) + 1):
            if run[:n] in scores:
                cost, rest = best(run[n:])
                ways.append((cost - scores[run[:n]][0], (names.index(run[:n]), *rest)))
        return min(ways)

    for text in ("ab", "aba", "abab", "bba ab", "a", " ab"):
        run = "▁" + text.replace(" ", "▁")
        ids = model.encode(text)
        assert [model.pieces[i] for i in ids] and "".join(model.pieces[i] for i in ids) == run
        assert sum(-scores[model.pieces[i]][0] for i in ids) == pytest.approx(best(run)[0])
    assert model.encode("c") == [1, 0] and model.decode(model.encode("ab a")) == "ab a"


@given
def test_a_common_segment_is_found_once(monkeypatch):
    """Its path stays when rare ones fill the room for paths; ids and room are as before."""
    monkeypatch.setattr(pieces, "REMEMBERED", 8)
    data = open(MODEL, "rb").read()
    model, fresh, seen = pieces.Model(data), pieces.Model(data), []
    only = model.only
    model.only = lambda run: seen.append(run) or only(run)
    for n in range(40):
        text = f"the {'word' * (n % 3)}ing{n} Thation ²x the 執日本 ​{n}"
        assert model.encode(text) == fresh.merged(fresh.normalised(text))
        assert len(model.paths) + len(model.paths.old) <= 8
    assert sum(run in ("the", "▁the") for run in seen) <= 2
