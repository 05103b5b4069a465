import hashlib
import json
import random

import pytest

from ledgerlight.llm import merges
from ledgerlight.llm.queries import QUERIES, WORD_MERGES

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def data():
    with open(WORD_MERGES, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(data):
    t = tokenizers.Tokenizer.from_str(data.decode())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own(data):
    return merges.Tokenizer(data)


def lists(ids, counts):
    ids, out, at = ids.tolist(), [], 0
    for n in counts.tolist():
        out.append(ids[at:at + n])
        at += n
    return out


def expected(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


ODD = ["", "   \n\t", "'s", "''s't", "don't WE'LL you'RE'd", "a" * 3000, "ab" * 2000, "aΣ ΣΑΣ", "İI", "é ²½Ⅷ", "z\x1cq\x85r​s　t",
       "<|endoftext|>", "x<|startoftext|>Y<|ENDOFTEXT|><|endoftext|><|endoftext", "日本語のテキスト。", "👩‍👩‍👧 \U0001F600!!", "snake_case 3.14"]


def test_equals_the_library(own, library):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("aaabcdeestrnio'''  .,!12²éÉßœ日<|>\n", k=rng.randint(0, 80))) for _ in range(500)]
    assert lists(*own.encode(texts)) == expected(library, texts)
    assert lists(*own.encode(texts)) == expected(library, texts)       # now from the table of known words


def test_long_words_and_small_table(own, library, monkeypatch):
    monkeypatch.setattr(merges, "REMEMBERED_WORDS", 10)
    word = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    for texts in ([word, "one two three"], ["four five six seven eight nine ten"] * 2, ["a b c d e f g h i j k l"], ["one " + word]):
        assert lists(*own.encode(texts)) == expected(library, texts)


def test_merge_list_without_order(data, library):
    """A symbol made by two merges, and ranks that fall along a path: one merge a round equals the library."""
    spec = json.loads(data)
    vocab = {k: v for k, v in spec["model"]["vocab"].items() if len(k.removesuffix("</w>")) == 1}
    vocab |= {t["content"]: t["id"] for t in spec["added_tokens"]}
    for token in ("bc", "abc", "ab", "abca", "abcab", "cab"):
        vocab[token] = max(vocab.values()) + 1
    spec["model"] |= {"vocab": vocab, "merges": [["b", "c"], ["abc", "ab"], ["abc", "a"], ["a", "b"], ["ab", "c"], ["c", "ab"], ["a", "bc"]]}
    small = json.dumps(spec).encode()
    own, lib = merges.Tokenizer(small), tokenizers.Tokenizer.from_str(small.decode())
    assert not own.in_order
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc", k=n)) for n in range(1, 60) for _ in range(10)]
    assert lists(*own.encode(texts)) == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_other_tokenizers_are_refused():
    with open("/opt/tokenizers/byte_bpe_50k.json", "rb") as f, pytest.raises(ValueError):
        merges.Tokenizer(f.read())


def test_frames(spark, data, library):
    rows = [(1, t, "x") for t in ODD] + [(None, "null id", "x"), (2, None, "x"), (2, None, "x"), (3, "long text, " * 150_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = merges.encoded(docs, data, decode=True).collect()
    want = {t or "": e for t, e in zip([r[1] for r in rows], expected(library, [r[1] or "" for r in rows]))}
    assert sorted((r.doc_id or -1, r.ids, r.decoded) for r in got) == sorted(
        (i or -1, want[t or ""], library.decode(want[t or ""], skip_special_tokens=False)) for i, t, _ in rows)
    assert merges.encoded(docs.limit(0), data, decode=True).collect() == []


def test_decoding_passes_over_unknown_numbers(spark, data, library):
    rows = spark.createDataFrame([(1, [320, 49407, 1 << 20, -3]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in merges.decoded(rows, data).collect()}
    assert got == {1: library.decode([320, 49407], skip_special_tokens=False), 2: "", 3: ""}


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op13_bpe_merge_rounds"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for row, ids in zip(docs, expected(library, [d.text or "" for d in docs])):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[row.doc_id][1:] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
