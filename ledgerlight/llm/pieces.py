"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled to three transducers: the normaliser (dummy prefix, blanks to U+2581), the pieces (a trie whose
arcs read a piece and write its id) and the byte fallback (a character that no piece has is read and its UTF-8 bytes'
ids are written). Composed with an input they give a lattice over its positions, and the encoding is the shortest path
in the tropical semiring (weights add along a path, the least path wins).

Weights of a unigram model are the negative scores. For a merge (BPE) model the state also holds the last piece, and a
piece after it weighs 0 if merging the two pieces' text by the model's ranks gives back just the two, else infinity:
a sequence of pieces is what the merges make of a text exactly if that holds for each adjacent pair, so one path of
finite weight is left. Where pieces are of equal rank, as runs of blanks are, pairs don't tell, and the merges
themselves decide.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlight.llm.storage import worker_cache

BLANK = "▁"
STOPS = ".,;:!?"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)   # piece types of the model file
REMEMBERED = 600_000     # segments whose paths a worker keeps,
REMEMBERED_CHARS = 8_000_000   # of so many characters together
REMEMBERED_PAIRS = 250_000     # pairs of pieces whose weight it keeps
REMEMBERED_STARTS = 50_000     # beginnings of four characters whose pieces it keeps
SHORT = 64               # characters of a segment that is kept
BATCH_TOKENS = 1 << 18


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message in the protocol buffer wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at:at + size]
            at += size


class Pieces:
    """The pieces and rules of a model file's bytes: enough to read ids back."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.types = [], [], []
        self.kind, self.prefix, self.squeeze, escape = UNIGRAM, True, True, True
        for field, value in fields(data):
            if field == 1:
                piece = dict(fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif field == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif field == 3:
                rules = dict(fields(value))
                self.prefix, self.squeeze, escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
                if rules.get(2):
                    raise ValueError("models with a character map in the normaliser are not supported")
        if self.kind not in (UNIGRAM, BPE) or not escape:
            raise ValueError("only unigram and merge models that escape blanks are supported")
        self.decoded = [self.written(i) for i in range(len(self.pieces))]

    def written(self, i: int) -> bytes:
        kind = self.types[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else self.pieces[i].replace(BLANK, " ").encode()

    def decode(self, ids) -> str:
        text = b"".join([self.decoded[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Paths(dict):
    """Paths of the segments met lately, found when first asked for.

    Half of the room is for new segments; when it is full, they become the old ones and those before them are dropped, so
    a segment that is met all the time stays.
    """

    def __init__(self, find: Callable[[str], list[int]]):
        super().__init__()
        self.find, self.old, self.held = find, {}, 0

    def __missing__(self, segment: str) -> tuple[int, ...]:
        path = self.old.get(segment)
        if path is None:
            path = tuple(self.find(segment))
        if len(segment) <= SHORT:
            if len(self) >= REMEMBERED // 2 or self.held >= REMEMBERED_CHARS // 2:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[segment] = path
            self.held += len(segment)
        return path


class Model(Pieces):
    """Transducers of a model file's bytes."""

    def __init__(self, data: bytes):
        super().__init__(data)
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER)}
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.known = {c for p in self.ids for c in p}
        self.inside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.lengths: dict[str, list[int] | tuple[int, ...]] = {}   # of the longer pieces that begin with four characters, negative, longest first
        for p in self.ids:
            if len(p) > 4:
                self.lengths.setdefault(p[:4], []).append(-len(p))
        self.lengths = {k: tuple(sorted(set(v))) for k, v in self.lengths.items()}
        self.sizes = [*map(len, self.pieces)]
        self.starts: dict[str, tuple[int, ...]] = {}
        self.singles = all(c in self.ids for c in self.known)
        self.floor = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        # a text may be cut where no piece reaches across: before a blank that follows something else, around characters that
        # no piece has, and between a letter and a stop, but for letters that some piece joins with a stop
        inner = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids)
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in self.known)
        joined = "".join(re.escape(c) for c in sorted({p[0] for p in self.inside if p[1] in STOPS and p[0].isalnum()}))
        word = f"{BLANK}*+[^\\W_{joined}]++(?=[{re.escape(STOPS)}])|"
        self.cut = re.compile(r"(?s).+" if inner else f"{word}[{alone}]|{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" if alone else f"{word}{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.fits: dict[int, bool] = {}     # by left piece * pieces + right piece
        self.grown: dict[int, tuple[list[tuple[float, str, str]], bool]] = {}
        self.paths = Paths(self.path)

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.paths.__getitem__, self.cut.findall(self.normalised(text)))))

    def path(self, segment: str) -> list[int]:
        """Shortest path of a segment, between places that no piece reaches across."""
        if self.kind == BPE and len(segment) <= SHORT and self.known.issuperset(segment):
            return self.only(segment)
        out, at = [], 0
        for end in range(1, len(segment) + 1):
            if end == len(segment) or segment[end - 1:end + 1] not in self.inside:
                out += self.run(segment) if end - at == len(segment) else self.paths[segment[at:end]]
                at = end
        return out

    def run(self, run: str) -> list[int]:
        """Shortest path of a segment that some piece may reach across at each place."""
        if run[0] not in self.known:
            return self.fallback(run)
        return self.least(run) if self.kind == UNIGRAM else self.only(run)

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if len(self.bytes) == 256 else [self.unknown]

    def least(self, run: str) -> list[int]:
        """Tropical shortest path with one state for each position."""
        cost, back = [0.0] + [float("inf")] * len(run), [(0, -1)] * (len(run) + 1)
        for start in range(len(run)):
            single = False
            for end in range(start + 1, min(len(run), start + self.longest) + 1):
                i = self.ids.get(run[start:end])
                if i is not None:
                    single |= end == start + 1
                    weight = cost[start] - self.scores[i]
                    if weight < cost[end]:
                        cost[end], back[end] = weight, (start, i)
            if not single and cost[start] - self.floor < cost[start + 1]:
                cost[start + 1], back[start + 1] = cost[start] - self.floor, (start, -1)
        out, at = [], len(run)
        while at:
            start, i = back[at]
            out.append([i] if i >= 0 else self.fallback(run[start]))
            at = start
        return [i for part in reversed(out) for i in part]

    def only(self, run: str) -> list[int]:
        """Shortest path over states (position, last piece), depth first along arcs of finite weight, longest first.

        All such paths weigh 0, so the first complete one is shortest; a position from which none is complete is dead.
        """
        if BLANK + BLANK in run or not (self.singles or all(c in self.ids for c in run)):
            return self.merged(run)
        ids, sizes, starts, fits, many, n = self.ids, self.sizes, self.starts, self.fits, len(self.pieces), len(run)
        path: list[int] = []
        ends, dead, at, last, below = [0], set(), 0, -1, self.longest + 1
        while at < n:
            key = run[at:at + 4]
            left = last * many
            for i in starts.get(key) or self.start(key):
                if i < 0:
                    i = ids.get(run[at:at - i])
                    if i is None:
                        continue
                size = sizes[i]
                if size < below and at + size not in dead:
                    fit = fits.get(left + i)
                    if fit is None:
                        if len(fits) >= REMEMBERED_PAIRS:
                            fits.clear()
                        fit = fits[left + i] = self.stays(last, i)
                    if fit:
                        path.append(i)
                        at += size
                        ends.append(at)
                        last, below = i, self.longest + 1
                        break
            else:
                if not path:
                    return self.merged(run)
                dead.add(ends.pop())
                below, at = at - ends[-1], ends[-1]
                path.pop()
                last = path[-1] if path else -1
        return path

    def start(self, key: str) -> tuple[int, ...]:
        """For the next four characters: negative lengths of the longer pieces that begin so, then the pieces within, longest first."""
        if len(self.starts) >= REMEMBERED_STARTS:
            self.starts.clear()
        within = [self.ids.get(key[:size]) for size in range(len(key), 0, -1)]
        self.starts[key] = out = (*self.lengths.get(key, ()), *[i for i in within if i is not None])
        return out

    def stays(self, a: int, b: int) -> bool:
        """Whether piece b after piece a (-1: none) weighs 0, as merging both texts by rank leaves the two.

        Both grow merge by merge, always the better rank first (the left one of equals), until done or merged across.
        """
        right, whole = self.growth(b)
        if a < 0 or not whole:
            return whole
        left, whole = self.growth(a)
        if not whole:
            return False
        x, y, i, j = self.pieces[a][-1], self.pieces[b][0], 0, 0
        none = (float("inf"), "", "")
        while True:
            across = self.ids.get(x + y)
            rank = float("inf") if across is None else -self.scores[across]
            own, other = (left[i] if i < len(left) else none), (right[j] if j < len(right) else none)
            if across is not None and rank < own[0] and rank <= other[0]:
                return False
            if own is none and other is none:
                return True
            if own[0] <= other[0]:
                x, i = own[2], i + 1
            else:
                y, j = other[1], j + 1

    def growth(self, i: int) -> tuple[list[tuple[float, str, str]], bool]:
        """(rank, first symbol, last symbol) after each merge of a piece's own text, and whether one symbol is left."""
        if i not in self.grown:
            steps: list[tuple[float, str, str]] = []
            self.grown[i] = steps, self.merged(self.pieces[i], steps) == [i]
        return self.grown[i]

    def merged(self, run: str, steps: list | None = None) -> list[int]:
        """What the ranked merges make of a run: best score first, then leftmost."""
        symbols: list[str | None] = list(run)
        after, before = list(range(1, len(run) + 1)), list(range(-1, len(run) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < len(run):
                both = symbols[left] + symbols[after[left]]
                if both in self.ids:
                    heapq.heappush(queue, (-self.scores[self.ids[both]], left, both))

        for left in range(len(run)):
            offer(left)
        while queue:
            _, left, both = heapq.heappop(queue)
            right = after[left]
            if symbols[left] is None or right >= len(run) or symbols[left] + symbols[right] != both:
                continue
            symbols[left], symbols[right] = both, None
            after[left] = after[right]
            if after[left] < len(run):
                before[after[left]] = left
            offer(left)
            offer(before[left])
            if steps is not None:
                last = left
                while after[last] < len(run):
                    last = after[last]
                steps.append((-self.scores[self.ids[both]], symbols[0], symbols[last]))
        return [i for s in symbols if s is not None for i in ([self.ids[s]] if s in self.ids else self.fallback(s))]


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """A model file, read by Spark so that any store will do."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def compiled(data: bytes, kind: type[Pieces] = Model) -> Pieces:
    """The worker's tables for a model file; compiled once, a Model with the paths found so far."""
    known = worker_cache(kind.__name__)
    if data not in known:
        known.clear()
        known[data] = kind(data)
    return known[data]


def id_lists(parts: list[list[int]]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(parts), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encoded(docs: DataFrame, model: bytes, decode: bool = False) -> DataFrame:
    """(doc_id, ids) for each row of `docs` (doc_id, text; other columns are ignored); null and empty texts have no ids.

    With `decode` also the ids read back, in column decoded, by the same task.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = compiled(model)
        for batch in batches:
            parts, start, waiting = [], 0, 0
            for row, text in enumerate(batch.column(1)):
                parts.append(transducer.encode(text.as_py() or ""))
                waiting += len(parts[-1])
                if waiting >= BATCH_TOKENS or row == len(batch) - 1:
                    out = [batch.column(0).slice(start, len(parts)), id_lists(parts)]
                    if decode:
                        out.append(pa.array(map(transducer.decode, parts), pa.string()))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][:len(out)])
                    parts, start, waiting = [], row + 1, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        of, "doc_id long, ids array<int>" + ", decoded string" * decode)


def decoded(rows: DataFrame, model: bytes) -> DataFrame:
    """`rows` (doc_id, ids) with the text that the ids stand for, in column decoded; null ids count as none."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = compiled(model, Pieces)
        for batch in batches:
            column = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *column.value_lengths().to_pylist()])
            texts = [pieces.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(of, "doc_id long, ids array<int>, decoded string")


def tokenised(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, n_bytes, ids, decoded): ids of each text, how many are fallback bytes, and the ids read back.

    One row for each row of `docs`: repeated rows are encoded alike, a null doc_id stays null, an empty table gives an
    empty result. `decoded` equals the text (null: empty) unless it holds U+2581, which like in the
    model's own library comes back as a blank.
    """
    fallback = [i for i, t in enumerate(compiled(model, Pieces).types) if t == BYTE]
    low, high = (min(fallback), max(fallback)) if fallback else (0, -1)
    return encoded(docs, model, decode=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.size(F.filter("ids", lambda i: i.between(low, high))).cast("long").alias("n_bytes"), "ids", "decoded")
