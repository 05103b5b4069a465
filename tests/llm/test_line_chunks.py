import hashlib
import random

from ledgerlight.llm import line_chunks as lc


def spans(text):
    """(first line, lines) of each chunk, by plain loops."""
    lines = text.split("\n")
    codes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    words = [0 if not x.strip(" ") else x.count(" ") + 1 for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        rolled = sum(codes[i - b] * lc.BASE ** b for b in range(lc.WINDOW)) if i >= lc.WINDOW - 1 else 1
        following = words[i + 1] if i + 1 < len(lines) else lc.LONG_WORDS
        if rolled % lc.MODULUS % lc.DIVISOR == 0 or words[i] >= lc.LONG_WORDS or following >= lc.LONG_WORDS:
            own = words[start:i + 1]
            passage = sum(own) >= lc.LONG_WORDS or (sum(own) >= lc.MIN_WORDS and sum(w > 0 for w in own) >= 2)
            out.append(("\n".join(lines[start:i + 1]), passage))
            start = i + 1
    return out


def brute(rows):
    seen, out = set(), {}
    for doc, text in sorted({r for r in rows if r[1] is not None}):
        kept, gone = [], 0
        for chunk, passage in spans(text):
            if passage and chunk in seen:
                gone += 1
            else:
                kept.append(chunk)
            if passage:
                seen.add(chunk)
        out[doc, text] = ("\n".join(kept), gone)
    return sorted(((d, *(out[d, t] if t is not None else (None, 0))) for d, t in rows), key=repr)


def corpus():
    rng = random.Random(8)
    line = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(n))
    shared = [[line(rng.choice([2, 6, 9, 12, 60])) for _ in range(rng.randrange(2, 9))] for _ in range(6)]
    rows = []
    for i in range(60):
        lines = [line(rng.choice([0, 1, 3, 8, 70])) for _ in range(rng.randrange(0, 9))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = rng.choice(shared)
        rows.append((i, "\n".join(lines)))
    return rows


def run(spark, rows):
    docs = spark.createDataFrame([(d, 3, t, "x") for d, t in rows], "doc_id long, k int, text string, lines string")
    out = lc.drop_repeated_chunks(docs)
    assert out.columns == ["doc_id", "k", "text", "lines", "removed_chunks"]
    return sorted(((r.doc_id, r.text, r.removed_chunks) for r in out.collect()), key=repr)


def test_against_brute_force(spark):
    rows = corpus()
    got = run(spark, rows)
    assert got == brute(rows) and sum(r[2] for r in got) > 20


def test_odd_rows(spark):
    text = "one two three four five six\nseven eight nine ten eleven"
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "\n\n\n"), (5, text), (5, text), (6, text), (7, "x"), (None, text), (8, "y\n" * 5000), (9, "y\n" * 5000)]
    got = run(spark, rows)
    first = sum(p for _, p in spans(text))
    assert len(got) == len(rows)
    assert [r for r in got if r[0] is None] == [(None, text, 0)]           # comes first in the order, so it stays
    assert [r[2] for r in got if r[0] in (5, 6)] == [first] * 3
    assert run(spark, [(1, None)]) == [(1, None, 0)]
    assert lc.drop_repeated_chunks(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_shared_line_is_found_in_any_surroundings(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    got = run(spark, [(i, f"head {i}\n{passage}\ntail of {i}") for i in range(20)])
    assert all((passage in t) == (d == 0) and f"head {d}" in t and f"tail of {d}" in t for d, t, _ in got)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    plan = lc.drop_repeated_chunks(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
