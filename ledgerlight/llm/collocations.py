"""Phrases whose words occur together more often than their parts do, by direct-address tiling.

Words are numbered by falling frequency, so that frequent words have small numbers. The matrix of (left number, right
number) is cut into tiles by bands of numbers: a first band, then as many bands for each doubling as the corpus needs to
keep a tile's share bounded. Each chunk of text counts its pairs once and sends each tile its cells. A tile of few cells is
summed by a dense `bincount`, addressed directly; a sparse one by sorting its cells (COO). Tiles that get too much are cut
further by ranges of cells. Frequent pairs are then numbered by frequency in their turn and take the place of the left
word, which gives the phrases of three words, and so on up to `longest`.

A phrase of at least `least` occurrences consists of phrases of at least as many, so words and pairs below that are no
part of a longer one and no count is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlight.llm.storage import stored

CHUNK_BYTES = 1 << 23    # of text that is counted together
FIRST_BAND = 512         # numbers in the first band
TILE_PAIRS = 1 << 22     # pairs of words a tile gets on average, at most
DENSE_CELLS = 1 << 22
SHARES = 32              # of a language's phrases, ranked on their own before they are ranked together
TILE_BYTES = 1 << 26     # of packed cells that one task sums
#: Characters that end a piece become a line feed, a tab (between words, like a space) a space
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs; the first byte tells how many."""
    width = np.min_scalar_type(int(numbers.max()) if len(numbers) else 0).itemsize
    return bytes([width]) + numbers.astype(f"u{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def pack_rising(numbers: np.ndarray) -> bytes:
    """Rising numbers as the first one and the steps between them."""
    return int(numbers[0]).to_bytes(8, "little") + pack(np.diff(numbers)) if len(numbers) else b""


def unpack_rising(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    return np.cumsum(np.append(int.from_bytes(data[:8], "little"), unpack(data[8:])))


class Numbering(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Chunk:
    """Texts of one language as word numbers; number 1 ends a piece."""

    def __init__(self):
        self.words, self.parts = Numbering({b"": 0, b"\n": 1}), []

    def add(self, text: bytes) -> None:
        # bytes.lower() changes A-Z only
        words = text.lower().translate(ENDS).replace(b"\n", b" \n ").split(b" ")
        words.append(b"\n")
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
        self.parts.append(numbers[numbers > 0])

    def row(self, chunk: int, lang: str) -> tuple:
        numbers = np.concatenate(self.parts)
        counts = np.bincount(numbers, minlength=len(self.words))[2:]
        return chunk, lang, int(counts.sum()), pack(numbers), [w.decode() for w in self.words][2:], counts.tolist()


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, lang, n, numbers, words, counts): the texts of a task in chunks of one language each."""
    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("numbers", pa.binary()),
                        ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, open_chunks = TaskContext.get().partitionId() << 33, 0, {}

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, chunk in open_chunks.items():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(chunk.row(made, lang), schema.types)], schema=schema)
                made += 1
            open_chunks.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                text = (text.as_py() or "").encode()
                open_chunks.setdefault(lang.as_py(), Chunk()).add(text)
                held += len(text)
                if held >= CHUNK_BYTES:
                    yield from done()
                    held = 0
        yield from done()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(
        of, "chunk long, lang string, n long, numbers binary, words array<string>, counts array<long>")


def numbered(rows: DataFrame, name: str, ties: list[str]) -> DataFrame:
    """`rows` with id: 0, 1, ... by falling f. Sorted in ranges; only the number of rows in each range is summed up."""
    ordered = stored(rows.repartitionByRange(F.desc("f"), *ties).sortWithinPartitions(F.desc("f"), *ties).withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return stored(ordered.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(
        "id", F.col("_before") + F.col("_place") - F.shiftleft("_part", 33)).drop("_part", "_place", "_before"), name)


def bands(size: int, pairs: int) -> np.ndarray:
    """Bounds of the bands of 0 .. size - 1: a first band, then each doubling in equal pieces, more of them for more pairs."""
    doublings = max(1, int(np.ceil(np.log2(max(size, 1) / FIRST_BAND))) + 1) if size > FIRST_BAND else 1
    pieces = max(1, int(np.ceil(np.sqrt(pairs / TILE_PAIRS) / doublings)))
    out = [*np.linspace(0, min(size, FIRST_BAND), pieces + 1)]
    at = FIRST_BAND
    while at < size:
        out += [*np.linspace(at, min(size, 2 * at), pieces + 1)][1:]
        at *= 2
    return np.unique(np.round(out).astype(np.int64)) if size else np.array([0, 1])


class Tiles:
    """Places of (left, right) in tiles: tile = band of left * bands of right + band of right, cell = place within it."""

    def __init__(self, lefts: int, rights: int, pairs: int):
        self.left, self.right = bands(lefts, pairs), bands(rights, pairs)

    def place(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.left, left, "right") - 1, np.searchsorted(self.right, right, "right") - 1
        return a * (len(self.right) - 1) + b, (left - self.left[a]) * (self.right[b + 1] - self.right[b]) + right - self.right[b]

    def cells(self, tile: int) -> int:
        a, b = divmod(tile, len(self.right) - 1)
        return int((self.left[a + 1] - self.left[a]) * (self.right[b + 1] - self.right[b]))

    def numbers(self, tile: int, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = divmod(tile, len(self.right) - 1)
        left, right = np.divmod(cell, self.right[b + 1] - self.right[b])
        return left + self.left[a], right + self.right[b]


def joined(words: np.ndarray, phrases: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, left, right) where a phrase of `size` words is followed by a word that ends another such phrase."""
    if len(words) <= size:
        return (np.zeros(0, np.int64),) * 3
    at = np.flatnonzero((phrases[:-1] >= 0) & (phrases[1:] >= 0))
    at = at[at + size < len(words)]
    return at, phrases[at], words[at + size]


def counted(texts: DataFrame, size: int, tiles: Tiles) -> DataFrame:
    """(tile, part, chunk, cells, counts): what each chunk of `texts` (chunk, words, phrases of `size` words) has for each tile."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, phrases in zip(*(batch.column(c) for c in range(3))):
                words = unpack(words.as_py()) - 1
                _, left, right = joined(words, unpack(phrases.as_py()) - 1 if size > 1 else words, size)
                tile, cell = tiles.place(left, right)
                order = np.lexsort((cell, tile))
                tile, cell = tile[order], cell[order]
                first = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]) | (cell[1:] != cell[:-1]))) if len(tile) else np.zeros(0, np.int64)
                count, tile, cell = np.diff(np.append(first, len(order))), tile[first], cell[first]
                starts = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])) if len(tile) else np.zeros(0, np.int64)
                spans = list(zip(starts, np.append(starts[1:], len(tile))))
                if spans:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tile[starts]), pa.array(np.zeros(len(spans), np.int64)), pa.array([chunk.as_py()] * len(spans), pa.int64()),
                         pa.array([pack_rising(cell[a:b]) for a, b in spans], pa.binary()), pa.array([pack(count[a:b]) for a, b in spans], pa.binary())],
                        ["tile", "part", "chunk", "cells", "counts"])

    return texts.select("chunk", "words", "phrases" if size > 1 else F.lit(None).cast("binary")).mapInArrow(
        of, "tile long, part long, chunk long, cells binary, counts binary")


def divided(rows: DataFrame, tiles: Tiles) -> DataFrame:
    """`rows` of counted(), those of tiles beyond TILE_BYTES cut by ranges of cells. The driver sees the tiles that are cut."""
    large = rows.groupBy("tile").agg(F.sum(F.length("cells") + F.length("counts")).alias("size")).where(F.col("size") > TILE_BYTES)
    parts = {r.tile: -(-r.size // TILE_BYTES) for r in large.collect()}
    if not parts:
        return rows

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for tile, _, chunk, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
                cell, count = unpack_rising(cells), unpack(counts)
                part = cell // -(-tiles.cells(tile) // parts[tile]) if tile in parts else np.zeros(len(cell), np.int64)
                starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                for a, b in zip(starts, np.append(starts[1:], len(part))):
                    out.append((tile, int(part[a]), chunk, pack_rising(cell[a:b]), pack(count[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), batch.schema.types)], names=batch.schema.names)

    return rows.mapInArrow(of, rows.schema)


def summed(rows: DataFrame, tiles: Tiles, least: int) -> DataFrame:
    """(tile, part, cell, left, right, f) of all cells of f >= `least`: a bincount where a tile is dense, sorted cells elsewhere."""
    def of(table: pa.Table) -> pa.Table:
        tile, part = table["tile"][0].as_py(), table["part"][0].as_py()
        cell = np.concatenate([unpack_rising(c.as_py()) for c in table["cells"]])
        count = np.concatenate([unpack(c.as_py()) for c in table["counts"]])
        if tiles.cells(tile) <= DENSE_CELLS and tiles.cells(tile) <= 16 * len(cell):
            total = np.bincount(cell, count).astype(np.int64)    # sums stay far below 2^53
            cell = np.flatnonzero(total >= least)
            total = total[cell]
        else:
            order = np.argsort(cell, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0))
            total, cell = np.add.reduceat(count[order], first), cell[order][first]
            cell, total = cell[total >= least], total[total >= least]
        left, right = tiles.numbers(tile, cell)
        same = [pa.array(np.full(len(cell), x)) for x in (tile, part)]
        return pa.table([*same, *map(pa.array, (cell, left, right, total))], names=["tile", "part", "cell", "left", "right", "f"])

    return rows.groupBy("tile", "part").applyInArrow(of, "tile long, part long, cell long, left long, right long, f long")


def told(rows: DataFrame, frequent: DataFrame, tiles: Tiles, rights: int) -> DataFrame:
    """(chunk, keys, ids): for each chunk the keys (left * rights + right) of its frequent pairs and their numbers, tile by tile."""
    def of(rows: pa.Table, frequent: pa.Table) -> pa.Table:
        cell, ids = frequent["cell"].to_numpy(), frequent["id"].to_numpy()
        order = np.argsort(cell)
        cell, ids = cell[order], ids[order]
        chunks, keys, found = [], [], []
        for chunk, cells in zip(rows["chunk"].to_pylist() if len(cell) else [], rows["cells"]):
            mine = unpack_rising(cells.as_py())
            at = np.minimum(np.searchsorted(cell, mine), len(cell) - 1)
            met = cell[at] == mine
            if met.any():
                left, right = tiles.numbers(rows["tile"][0].as_py(), mine[met])
                chunks.append(chunk)
                keys.append(pack_rising(left * rights + right))
                found.append(pack(ids[at[met]]))
        return pa.table([pa.array(chunks, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.binary())], names=["chunk", "keys", "ids"])

    by = ["tile", "part"]
    return rows.drop("counts").groupBy(*by).cogroup(frequent.select(*by, "cell", "id").groupBy(*by)).applyInArrow(of, "chunk long, keys binary, ids binary")


def extended(texts: DataFrame, size: int, known: DataFrame, rights: int) -> DataFrame:
    """`texts` with the numbers of phrases of one word more at each place, after told()."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, phrases, keys, ids in zip(*(batch.column(c) for c in range(1, 5))):
                word = unpack(words.as_py()) - 1
                at, left, right = joined(word, unpack(phrases.as_py()) - 1 if size > 1 else word, size)
                key, own = (np.concatenate([np.zeros(0, np.int64), *map(read, x.as_py() or [])]) for x, read in ((keys, unpack_rising), (ids, unpack)))
                order = np.argsort(key)
                key, own = key[order], own[order]
                longer = np.full(len(word), -1)
                if len(key):
                    mine = left * rights + right
                    place = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                    longer[at] = np.where(key[place] == mine, own[place], -1)
                out.append(pack(longer + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["chunk", "words", "phrases"])

    lists = known.groupBy("chunk").agg(F.collect_list("keys").alias("keys"), F.collect_list("ids").alias("ids"))
    phrases = F.col("phrases") if size > 1 else F.lit(None).cast("binary").alias("phrases")
    return texts.join(lists, "chunk", "left").select("chunk", "words", phrases, "keys", "ids").mapInArrow(of, "chunk long, words binary, phrases binary")


def as_numbers(cut: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk, words): each chunk's word numbers over all texts plus 1, and 0 for rare words and ends of pieces."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for numbers, own, ids in zip(*(batch.column(c) for c in range(1, 4))):
                numbers = unpack(numbers.as_py())
                table = np.zeros(int(numbers.max(initial=0)) + 1, np.int64)
                if ids.is_valid:
                    table[own.values.to_numpy() + 2] = ids.values.to_numpy() + 1
                out.append(pack(table[numbers]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["chunk", "words"])

    own = cut.select("chunk", "lang", F.posexplode("words").alias("own", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    lists = own.groupBy("chunk").agg(F.collect_list(F.struct("own", "id")).alias("known"))
    return cut.select("chunk", "numbers").join(lists, "chunk", "left").select(
        "chunk", "numbers", F.col("known.own").alias("own"), F.col("known.id").alias("ids")).mapInArrow(of, "chunk long, words binary")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts under 10^13; never beyond 1000000, as no part is rarer than a."""
    wide = "decimal(13,0)"
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a.cast(wide) * a.cast(wide)), left.cast(wide) * right.cast(wide))


def scored(phrases: DataFrame, size: int) -> DataFrame:
    """`phrases` with l, r and score of the lowest-scoring cut (of equals the one after fewer words)."""
    cuts = []
    for k in range(1, size):
        left, right = F.element_at("heads", k), F.element_at("tails", size - k)
        cuts.append(F.struct(score(F.col("f"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    cut = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return phrases.withColumn("cut", cut).select("id", "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, within: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words by score.

    `docs` has text and lang; other columns are ignored. A null text counts as empty, a null lang as `und`, repeated rows
    count each time, an empty table gives an empty result. Phrases don't reach across ends of pieces or texts; equal scores
    rank by a, then by phrase in byte order. A phrase inside a longer candidate of at least `within` percent of its
    occurrences is left out. Counts are exact at any size.
    """
    cut = stored(chunks(docs), "chunks")
    totals = cut.groupBy("lang").agg(F.sum("n").alias("n"))
    words = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    words = numbered(words.where(F.col("f") >= least), "words", ["lang", "word"])
    pairs = cut.agg(F.sum("n")).first()[0] or 0
    rights = lefts = words.count()
    texts = stored(as_numbers(cut, words), "texts")
    none = F.array().cast("array<long>")
    shorter = words.select("id", "lang", F.col("word").alias("phrase"), "f", none.alias("heads"), none.alias("tails"), F.lit(None).cast("long").alias("suffix"))
    found: list[DataFrame] = []
    for size in range(1, longest):
        tiles = Tiles(lefts, rights, pairs)
        rows = divided(stored(counted(texts, size, tiles), "cells"), tiles)
        frequent = numbered(summed(rows, tiles, least), "phrases", ["left", "right"])
        lefts = frequent.count()
        if size > 1:   # the phrase less its first word is that of the left part's own suffix and the last word
            suffix = before.select(F.col("left").alias("suffix"), "right", F.col("id").alias("end"))
            parts = frequent.join(shorter.select(F.col("id").alias("left"), "suffix"), "left").join(suffix, ["suffix", "right"]).drop("suffix")
        else:
            parts = frequent.withColumn("end", F.col("right"))
        head = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("start"), F.array_append("heads", F.col("f")).alias("heads"))
        tail = shorter.select(F.col("id").alias("end"), F.array_append("tails", F.col("f")).alias("tails"))
        last = words.select(F.col("id").alias("right"), "word")
        longer = stored(parts.join(head, "left").join(tail, "end").join(last, "right").select(
            "id", "lang", F.concat_ws(" ", "start", "word").alias("phrase"), "f", "heads", "tails", F.col("end").alias("suffix"), "left"), "phrases")
        if found:      # a phrase is the start or the end of the longer ones around it
            around = longer.select(F.col("left").alias("id"), "f").unionByName(longer.select(F.col("suffix").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("around"))
            found[-1] = found[-1].join(around, "id", "left").where("around is null or 100 * around < " + f"{int(within)} * a").drop("around")
        found.append(scored(longer, size + 1))
        if size + 1 < longest:
            texts = stored(extended(texts, size, told(rows, frequent, tiles, rights), rights), "texts")
        shorter, before = longer, frequent
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # the best of each share first, as one language may have most phrases
    best = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    some = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*best))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
