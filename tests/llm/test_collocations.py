import random
import re
from collections import Counter, defaultdict

import pytest

from ledgerlight.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, id long, phrase string"


def brute(rows, longest=3, least=10, within=50, top=2000):
    n, f, out = Counter(), defaultdict(Counter), []
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {p[i:i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                  if 100 * a >= within * c[p[i:i + k]]}
        found = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, lang, 0, "x") for i, (t, lang) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in C.collocations(docs, **options).collect())


def some_texts(seed, count, words):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(words)] + ["Été", "ΣΑ", "don't", "\x00", "ab\xa0cd", "A", "aa"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    texts = []
    for _ in range(count):
        drawn = rng.choices(pool, weights, k=rng.randint(0, 120))
        texts.append("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\x0b", "? "]) for w in drawn))
    return [(t, rng.choice(["en", "en", "de", None, "und"])) for t in texts]


def test_against_brute_force(spark):
    rows = some_texts(1, 300, 200) + [(None, "en"), ("", "en"), (" . ", None)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("longest, least, within, top", [(2, 5, 50, 2000), (4, 3, 50, 2000), (5, 2, 80, 7), (3, 4, 0, 10), (3, 1, 101, 50)])
def test_parameters(spark, longest, least, within, top):
    rows = some_texts(longest, 40, 12)
    assert got(spark, rows, longest=longest, least=least, within=within, top=top) == brute(rows, longest, least, within, top)


@pytest.mark.parametrize("name, value", [("DENSE_CELLS", 0), ("CHUNK_BYTES", 200), ("TILE_BYTES", 60), ("TILE_PAIRS", 10)])
def test_small_bounds_change_nothing(spark, monkeypatch, name, value):
    """Sorted cells only, many chunks, tiles cut further, many bands."""
    monkeypatch.setattr(C, "FIRST_BAND", 16)
    monkeypatch.setattr(C, name, value)
    rows = some_texts(7, 120, 90)
    assert got(spark, rows, least=4) == brute(rows, least=4)


def test_repeats_overlaps_and_long_texts(spark):
    rows = [("a a a a a a a a a a a a", "en")] * 3 + [("New York city hall " * 40_000, "en"), ("x" * 300_000 + " y", "en")] * 2
    assert got(spark, rows) == brute(rows)


def test_ties_in_score_take_the_shorter_first_part(spark):
    rows = [("p q r.", "en")] * 12 + [("q p.", "en")] * 3
    assert got(spark, rows) == brute(rows)


def test_empty_tables(spark):
    assert got(spark, []) == [] and got(spark, [("one two", "en"), (None, None)]) == []


def test_counts_beyond_64_bit_products(spark):
    """The score's arithmetic on counts whose products need 70 bits and more."""
    from pyspark.sql import functions as F
    for a, l, r in ((4 * 10**12, 5 * 10**12, 9 * 10**12), (10**12 + 1, 10**12 + 3, 10**12 + 7), (3, 3, 3)):
        row = spark.range(1).select(C.score(F.lit(a), F.lit(l), F.lit(r)).alias("s")).first()
        assert row.s == 1_000_000 * a * a // (l * r)


def test_bands_cover_all_numbers():
    for size in (0, 1, 5, 511, 512, 513, 5000, 10**6):
        for pairs in (0, 10**6, 10**12):
            b = C.bands(size, pairs)
            assert b[0] == 0 and b[-1] == max(size, 1) and (b[1:] > b[:-1]).all()
