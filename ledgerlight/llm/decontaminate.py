"""Benchmark decontamination: CGK embedding of parts, LSH over windows at every byte, exact edit distance.

A text leaks an item if a stretch of it is within RATE * (length of the item) edits of the item, both with A-Z
lower-cased, white space runs as one blank, in UTF-8 bytes. A CGK walk reads a string from its start and at each step
either stays or goes on, as a random function of step and byte says. Over a whole item with a tenth of its bytes edited the
outputs of two walks differ at so many steps that no sample of them is both equal and telling, so parts are embedded:
with k = RATE * length edits allowed an item is cut into k + 1 parts that cover it, and its walks end where a part ends.
k edits leave one part of k + 1 untouched, wherever they are; its walk has the same outputs in the text, and as windows of
a text start at every byte, it is met. So one walk and all of its outputs give recall 1 at any length and up to the full
RATE: number of parts and steps follow from length and RATE, and fewer sampled outputs would only add candidates.

Candidates are narrowed by the same count without losing any: parts form pairs (at most one edit) and pairs form groups of
up to 64 bytes (an edit less than parts); if every group had more edits than that, the item would have more than k. What
is left is compared by the whole item's edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerlight.llm.shingles import LOWER, SPACE, buffers, chunks, stream
from ledgerlight.llm.storage import stored

RATE = 0.1
LEVELS = (6, 8, 10, 12)  # steps of a walk; a part takes the most that stay inside it, and no part is shorter than the least
ALONE = 1.3              # length of a part without a partner, in other parts
MIN_ITEM = 16            # bytes; shorter items allow no edit that leaves a part to embed, see Short
BLOCK_BYTES = 8 << 20    # of items in one pass over the texts
TEXT_BYTES = 1 << 17     # of text whose walks are computed at a time
NODES = 4096             # groups whose bit tables are held at a time

CODE = stream(256, 100)  # of a byte that a walk puts out
STEP = stream(1, 101)[0] | np.uint64(1)
GOES_ON = (stream(256 * LEVELS[-1], 102).reshape(LEVELS[-1], 256) >> np.uint64(62)) > 0   # three times in four
GOES_ON[:, 0] = False    # the end of a text stays


def expected_recall(words: int, rate: float = RATE) -> float:
    """Least recall for items of so many words: 1 up to RATE, as one part is free of edits; what has more is no leak."""
    return float(rate <= RATE)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, each ended by a zero byte, and where each row begins."""
    space = SPACE[data] | (data == 0)
    again = np.zeros(len(data), bool)
    again[1:] = space[1:] & space[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    again[firsts] = False
    keep = np.flatnonzero(~again)
    out = np.where(space[keep], 32, LOWER[data[keep]]).astype(np.uint8)
    begin = np.searchsorted(keep, offsets)
    row = np.arange(len(offsets) - 1)
    text = np.zeros(len(out) + len(row), np.uint8)
    text[np.arange(len(out)) + np.repeat(row, np.diff(begin))] = out
    return text, begin[:-1] + row


def starts_of(text: np.ndarray) -> np.ndarray:
    """Where words begin."""
    solid = (text != 32) & (text != 0)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    return np.flatnonzero(first)


def walks(text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(steps, key of the walk from each byte of `text`) for each of LEVELS; the first step of a longer walk is the newest.

    A walk of s steps is one step, then a walk of s - 1 steps from where that leads: one pass over the text a step.
    """
    code, key = CODE[text], np.zeros(len(text) + 1, np.uint64)
    for s in range(1, LEVELS[-1] + 1):
        new = np.where(GOES_ON[s - 1][text], key[1:], key[:-1])
        new *= STEP
        new += code
        key[:-1] = new
        if s in LEVELS:
            yield s, new


def steps_inside(part: bytes) -> int:
    """The most steps of LEVELS whose walk reads no byte beyond `part`."""
    for steps in reversed(LEVELS):
        place = 0
        for s in range(steps, 0, -1):
            if place >= len(part):
                break
            place += int(GOES_ON[s - 1][part[place]])
        else:
            return steps
    raise ValueError(f"a part of {len(part)} bytes is shorter than the shortest walk")


def parts_of(n: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(begin, end, begin and end of the partner, begin and end of the group, edits of the group) of each part of an item.

    Without partner: an empty one.
    """
    k = int(RATE * n)
    weights = np.array([1.0] * (k + 1 - (k + 1) % 2) + [ALONE] * ((k + 1) % 2))
    cuts = [0, *np.floor(np.cumsum(weights) / weights.sum() * n + 1e-9).astype(int).tolist()]
    units = [(i, i + 2) for i in range(0, k, 2)] + ([(k, k + 1)] if k % 2 == 0 else [])
    out = []
    for group in np.array_split(np.array(units), max(1, len(units) // 2)):
        first, last = int(group[0][0]), int(group[-1][1])
        for lo, hi in group.tolist():
            for i in range(lo, hi):
                other = lo + hi - 1 - i if hi - lo == 2 else None
                partner = (cuts[other], cuts[other + 1]) if other is not None else (cuts[i], cuts[i])
                out.append((cuts[i], cuts[i + 1], *partner, cuts[first], cuts[last], last - first - 1))
    return out


class Items:
    """Keys of the parts of a block of items."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.rows = rows
        self.bytes = np.frombuffer(b"".join(item for _, item in rows) + b"\0" * 64, np.uint8)
        base, parts, levels, shapes = 0, [], [], {}
        for i, (_, item) in enumerate(rows):
            if not item:                # a place kept for a short item
                continue
            shape = shapes.setdefault(len(item), None) or parts_of(len(item))
            shapes[len(item)] = shape
            for part in shape:
                parts.append((i, base, *part))
                levels.append(steps_inside(item[part[0]:part[1]]))
            base += len(item)
        table = np.array(parts, np.int64).reshape(-1, 9)
        level = np.array(levels, np.int64)
        self.known = {}
        for steps, keys in walks(self.bytes):
            own = table[level == steps]
            if len(own):
                found = keys[own[:, 1] + own[:, 2]]
                order = np.argsort(found, kind="stable")
                bits = min(24, max(12, int(len(own) * 32).bit_length()))
                sieve = np.zeros(1 << bits, bool)
                sieve[found >> np.uint64(64 - bits)] = True
                self.known[steps] = sieve, np.uint64(64 - bits), found[order], own[order]

    def candidates(self, text: np.ndarray) -> np.ndarray:
        """Rows (item, where it would begin in `text`, a place inside): every leak has one within its edits of its begin."""
        ends = np.concatenate([np.zeros(64, np.uint8), text, np.zeros(192, np.uint8)])
        found = [np.zeros((0, 3), np.int64)]
        for lo in range(0, len(text), TEXT_BYTES):
            n = min(TEXT_BYTES, len(text) - lo)
            for steps, keys in walks(text[lo:lo + n + LEVELS[-1]]):
                if steps in self.known:
                    sieve, shift, known, table = self.known[steps]
                    some = np.flatnonzero(sieve[keys[:n] >> shift])
                    which, at = met(keys[some], some + lo, known)
                    which, at = close_pairs(self.bytes, ends, table, which, at)
                    which, at = close_groups(self.bytes, ends, table, which, at)
                    part = table[which]
                    found.append(np.stack([part[:, 0], at - part[:, 2], at], 1))
        return np.unique(np.concatenate(found), axis=0)


class Short:
    """Items of fewer than MIN_ITEM bytes, which allow one edit at most: found verbatim, as whole words."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.rows = rows
        self.known = {}
        for n in sorted({len(item) for _, item in rows}):
            own = np.array([i for i, (_, item) in enumerate(rows) if len(item) == n], np.int64)
            items = np.frombuffer(b"".join(rows[i][1] for i in own), np.uint8).reshape(-1, n)
            keys = keys_of(items.reshape(-1), n)[::n]
            order = np.argsort(keys, kind="stable")
            self.known[n] = keys[order], own[order], items[order]

    def found(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, place in `text`) wherever an item stands between word boundaries."""
        word = in_words(text)
        edge = np.ones(len(text) + 1, bool)
        edge[1:-1] = ~(word[1:] & word[:-1])
        for n, (known, own, items) in self.known.items():
            if len(text) < n:
                continue
            at = np.flatnonzero(edge[:len(text) - n + 1] & edge[n:])
            which, at = met(keys_of(text, n)[at], at, known)
            same = (text[at[:, None] + np.arange(n)] == items[which]).all(1)
            yield from zip(own[which[same]].tolist(), at[same].tolist())


def keys_of(text: np.ndarray, n: int) -> np.ndarray:
    """A key of the `n` bytes from each place of `text` that has so many."""
    key = np.zeros(max(0, len(text) - n + 1), np.uint64)
    for j in range(n):
        key = key * STEP + CODE[text[j:j + len(key)]]
    return key


def in_words(text: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters, digits, underscores and of letters of two bytes (Latin, Greek, Cyrillic and the like).

    Characters of three bytes and more stand mostly in scripts without blanks and are words of their own.
    """
    ascii_word = (text >= 97) & (text <= 122) | (text >= 48) & (text <= 57) | (text == 95)
    lead = (text >= 0xC3) & (text <= 0xDF)
    return ascii_word | lead | np.concatenate([[False], lead[:-1]])


def met(keys: np.ndarray, starts: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in `known`, start) of all equal keys."""
    lo, hi = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
    n = hi - lo
    at = np.repeat(np.arange(len(keys)), n)
    return np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + lo[at], starts[at]


def close_pairs(items: np.ndarray, ends: np.ndarray, table: np.ndarray, which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those whose partner is within one edit next to the part; parts without partner stay. `ends` is the text after 64 bytes."""
    if not len(which):
        return which, at
    _, base, begin, end, other, stop = table[which, :6].T
    length = stop - other
    right = other >= end
    way = np.where(right, 1, -1)
    own = base + np.where(right, other, stop - 1)
    there = at + 64 + np.where(right, end - begin, -1)
    straight = np.ones(len(which), bool)              # no edit so far
    inserted = substituted = deleted = np.zeros(len(which), bool)
    before, here = np.zeros(len(which), np.uint8), ends[there]
    for j in range(int(length.max(initial=0))):
        inside = j < length
        byte, after = items[np.where(inside, own + way * j, 0)], ends[there + way * (j + 1)]
        # the edit is at this byte, or was before it and the rest goes on in step
        next_inserted = (inserted | straight) & (byte == after)
        next_substituted = substituted & (byte == here) | straight
        next_deleted = deleted & (byte == before) | straight
        next_straight = straight & (byte == here)
        inserted, substituted = np.where(inside, next_inserted, inserted), np.where(inside, next_substituted, substituted)
        deleted, straight = np.where(inside, next_deleted, deleted), np.where(inside, next_straight, straight)
        before, here = here, after
    keep = straight | inserted | substituted | deleted
    return which[keep], at[keep]


def close_groups(items: np.ndarray, ends: np.ndarray, table: np.ndarray, which: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those whose group is within its edits around the part, by bit-parallel columns over all at once."""
    keep = np.zeros(len(which), bool)
    if not len(which):
        return which, at
    _, base, begin, _, _, _, first, last, most = table[which].T
    groups, own = np.unique(np.stack([base + first, last - first], 1), axis=0, return_inverse=True)
    own = own.reshape(-1)
    order = np.argsort(own, kind="stable")
    one = np.uint64(1)
    for low in range(0, len(groups), NODES):
        some = groups[low:low + NODES]
        rows = order[np.searchsorted(own[order], low):np.searchsorted(own[order], low + NODES)]
        where = np.zeros((len(some), 256), np.uint64)
        for j in range(int(some[:, 1].max())):
            inside = np.flatnonzero(j < some[:, 1])
            where[inside, items[some[inside, 0] + j]] |= one << np.uint64(j)
        where, node = where.reshape(-1), (own[rows] - low) * 256
        n, q = (last - first)[rows], most[rows]
        place = np.maximum(at[rows] - (begin - first)[rows] - q + 64, 0)
        columns = n + 2 * q
        top = (n - 1).astype(np.uint64)
        plus, minus = np.full(len(rows), ~np.uint64(0)), np.zeros(len(rows), np.uint64)
        score, best = n.copy(), n.copy()
        for j in range(int(columns.max())):
            same = where[node + ends[np.minimum(place + j, len(ends) - 1)]]
            vertical = same | minus
            diagonal = (((same & plus) + plus) ^ plus) | same
            up, down = minus | ~(diagonal | plus), plus & diagonal
            score += (up >> top & one).astype(np.int64) - (down >> top & one).astype(np.int64)
            up, down = up << one, down << one
            plus, minus = down | ~(vertical | up), up & vertical
            np.minimum(best, score, out=best)
        keep[rows] = best <= q
    return which[keep], at[keep]


def best_edits(item: bytes, text: bytes, most: int) -> int | None:
    """Least edits between `item` and any stretch of `text`, by bit-parallel columns; None if more than `most`."""
    if item in text:
        return 0
    n = len(item)
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    all_ones, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = all_ones, 0, n, n
    for c in text:
        same = where.get(c, 0)
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        up, down = minus | (all_ones & ~(diagonal | plus)), plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & all_ones, (down << 1) & all_ones
        plus, minus = down | (all_ones & ~(diagonal | up)), up & diagonal
        best = min(best, score)
    return best if best <= most else None


def stretches(found: np.ndarray, rows: list[tuple[int, bytes]], begin: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, from, to) of the stretches of text that can hold an item; those of an item that overlap are one."""
    row = np.searchsorted(begin, found[:, 2], side="right") - 1
    last = None
    for j in np.lexsort((found[:, 1], found[:, 0], row)).tolist():
        (i, at, _), r = found[j].tolist(), int(row[j])
        n = len(rows[i][1])
        most = int(RATE * n)
        low, high = max(int(begin[r]), at - most), min(int(ends[r]), at + n + most)
        if last and last[:2] == (r, i) and low <= last[3]:
            last = r, i, last[2], max(high, last[3])
        else:
            if last:
                yield last
            last = r, i, low, high
    if last:
        yield last


def normal(text: str | None) -> bytes:
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return normalised(data, np.array([0, len(data)]))[0].tobytes()[:-1].strip()


def blocks(benchmark: DataFrame, least: int = MIN_ITEM) -> Iterator[list[tuple[int, bytes]]]:
    """Normalised items of `least` bytes or more in blocks of BLOCK_BYTES; at least one block, which may be empty."""
    block, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        item = normal(row["text"])
        if len(item) >= least:
            if block and size + len(item) > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append((int(row["item_id"]), item))
            size += len(item)
    yield block


LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("edits", T.LongType())]))


def marked(docs: DataFrame, benchmark: DataFrame, name: str = "leaks", short: bool = False) -> DataFrame:
    """`docs` (a column text, any others) with a column `name`: (item_id, edits) of each item that the text leaks, by item.

    `edits` is the least number seen. Null and empty texts leak nothing; items without id or text or with no character
    but blanks are left out. Items of fewer than MIN_ITEM bytes count with `short`, where they stand verbatim between word
    boundaries (edits 0); without it they are left out, as in without_leaks(): a document isn't dropped for one
    common word. Repeated items count once. Items are taken in blocks of BLOCK_BYTES, one pass over the
    texts for each, with the result stored in between, so that a task holds the index of one block at a time. Rows are neither dropped nor added; an own column of that
    name is replaced.
    """
    out = docs.drop(name).withColumn(name, F.lit(None).cast(LEAKS))
    for n, block in enumerate(blocks(benchmark, 1 if short else MIN_ITEM)):
        out = marked_by(stored(out, "leaks") if n else out, block)
    return out


def marked_by(docs: DataFrame, rows: list[tuple[int, bytes]]) -> DataFrame:
    place = docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items([row if len(row[1]) >= MIN_ITEM else (row[0], b"") for row in rows])
        short = Short([(i, item) for i, (_, item) in enumerate(rows) if len(item) < MIN_ITEM])
        for batch in batches:
            data, offsets = buffers(batch.column(place))
            found: list[list[tuple[int, int]]] = [list(map(tuple, (x.values() for x in old or ()))) for old in batch.column(len(batch.columns) - 1).to_pylist()]
            for lo, hi in chunks(offsets):
                text, begin = normalised(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                ends = np.append(begin[1:], len(text)) - 1
                least: dict[tuple[int, int], int] = {}
                for r, i, low, high in stretches(items.candidates(text), rows, begin, ends):
                    item = rows[i][1]
                    edits = best_edits(item, text[low:high].tobytes(), int(RATE * len(item)))
                    if edits is not None:
                        least[r, i] = min(edits, least.get((r, i), edits))
                for own, at in short.found(text) if short.rows else ():
                    least[int(np.searchsorted(begin, at, side="right")) - 1, short.rows[own][0]] = 0
                for (r, i), edits in sorted(least.items()):
                    found[lo + r].append((rows[i][0], edits))
            marks = [[{"item_id": i, "edits": e} for i, e in row] for row in found]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks, kind)], batch.schema.names)

    return docs.mapInArrow(of, docs.schema)


def leaks(docs: DataFrame, benchmark: DataFrame, short: bool = False) -> DataFrame:
    """(doc_id, item_id, edits) for each text of `docs` (doc_id, text) that leaks an item of `benchmark` (item_id, text).

    One row for each pair of ids, with the least edits; see marked(). Other columns are ignored; repeated rows count
    once; a null doc_id is reported as null. An empty table gives an empty result.
    """
    found = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, short=short)
    pairs = found.select("doc_id", F.explode_outer("leaks").alias("leak")).where("leak is not null")
    return pairs.groupBy("doc_id", "leak.item_id").agg(F.min("leak.edits").alias("edits"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` whose text leaks no item."""
    return marked(docs, benchmark, "_benchmark_leaks").where(F.size("_benchmark_leaks") == 0).drop("_benchmark_leaks")
