"""BPE encoding and decoding by batched merge rounds.

The symbols of many words lie in one flat array. In each round the keys of all adjacent pairs are looked up by binary
search among the sorted keys of the merge list, each word's lowest rank is taken, and all its pairs of that rank are
merged at once (of overlapping ones every second, from the left). Merging all of a rank at once equals merging one by one
if every symbol is made by one merge, and only of symbols made before; a list without that order is merged one pair a
word and round. Words met before are taken from a table of bounded size.

Words are cut by the tokenizer's own pattern, after NFC and lower case. Letters, digits and the order of combining marks
follow Python's Unicode tables (15.1). Only characters that a library's tables don't know yet, or that Python's don't, can
come out otherwise: letters taken in after 15.1, and two late combining marks after one letter.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ledgerlight.llm.storage import worker_cache

REMEMBERED_WORDS = 200_000
REMEMBERED_SYMBOLS = 4_000_000
LONG_WORD = 64           # characters; longer words are not remembered
BATCH_CHARS = 1 << 20    # texts are worked off in groups of about so many characters
NONE = np.iinfo(np.int32).max
#: Characters with the Unicode property White_Space
BLANKS = "\t-\r \x85\xa0  -     　"


def class_of(general: str, below: int) -> str:
    """The characters under `below` whose general category begins with `general`, as ranges of a pattern's class."""
    runs: list[list[int]] = []
    for code in range(below):
        if unicodedata.category(chr(code))[0] == general:
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def pattern_of(source: str, below: int) -> re.Pattern:
    """The tokenizer's pattern for texts whose characters are all under `below`."""
    for name in "LN":
        source = source.replace(f"\\p{{{name}}}", class_of(name, below))
    return re.compile(re.sub(r"\\s", lambda _: BLANKS, source))


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where Latin-1 prints it, else the next free one from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


class Tokenizer:
    """A byte-level BPE tokenizer with word ends, from the bytes of its JSON file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, ends = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        steps, cuts = [spec["normalizer"]], [spec["pre_tokenizer"]]
        steps = steps[0]["normalizers"] if steps[0] and steps[0]["type"] == "Sequence" else steps
        cuts = cuts[0]["pretokenizers"] if cuts[0] and cuts[0]["type"] == "Sequence" else cuts
        blanks = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        by_bytes = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        if not (steps in ([{"type": "NFC"}, blanks, {"type": "Lowercase"}], [{"type": "NFC"}, {"type": "Lowercase"}])
                and len(cuts) == 2 and cuts[0]["type"] == "Split" and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
                and cuts[1].items() >= by_bytes.items() and spec["decoder"] is None and model["type"] == "BPE"
                and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
                and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))):
            raise ValueError("only byte-level BPE tokenizers of lower-case words without a decoder are supported")
        source = cuts[0]["pattern"]["Regex"]
        # a run of blanks becomes one blank: no word holds either, so that step has nothing to do
        self.narrow, self.wide = pattern_of(source, 0x100), pattern_of(source, sys.maxunicode + 1)
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.added = {" " + content: i for content, i in added.items()}   # no other word has a blank
        self.size = max([*vocab.values(), *added.values()]) + 1
        names: list[str | None] = [None] * self.size
        for token, i in [*vocab.items(), *added.items()]:
            names[i] = token
        self.names = pa.array(names, pa.string())
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + ends] for s in symbols], np.int64)
        made, order, keys, products = {*symbols, *(s + ends for s in symbols)}, True, [], []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            order &= a in made and b in made and a + b not in made
            made.add(a + b)
            keys.append(vocab[a] * self.size + vocab[b])
            products.append(vocab[a + b])
        self.in_order = order
        sort = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks = np.array(keys, np.int64)[sort], sort.astype(np.int32)
        self.products = np.array(products, np.int64)
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts, self.lengths, self.symbols = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def words(self, text: str) -> list[str]:
        """The words of a text; an added token's string, after a blank, counts as one."""
        if self.specials is None or not self.specials.search(text):
            return self.plain_words(text)
        out, at = [], 0
        for met in self.specials.finditer(text):
            out += [*self.plain_words(text[at:met.start()]), " " + met.group()]
            at = met.end()
        return out + self.plain_words(text[at:])

    def plain_words(self, text: str) -> list[str]:
        # letter by letter: str.lower() alone would write a sigma at a word's end otherwise
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide.findall(text)
        return self.narrow.findall(text)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; NONE where they don't merge or the right one is missing (-1)."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], NONE)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each word has), by merge rounds over all words at once."""
        raw = [w.encode() for w in words]
        counts = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(counts) - 1
        found = self.inner[flat]
        found[ends] = self.last[flat[ends]]
        kept = np.ones(len(flat), bool)
        place, word, symbol = np.arange(len(flat)), np.repeat(np.arange(len(words)), counts), found.copy()
        while len(symbol):
            # the symbols of words that are not done yet, linked within each word; one more place stands for none
            n = len(symbol)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(first, n))
            symbol, after, before = np.append(symbol, -1), np.arange(1, n + 2), np.arange(-1, n)
            after[np.append(first[1:], n) - 1], before[first] = n, n
            rank, alive, live = self.rank(symbol[:n], symbol[after[:n]]), np.ones(n, bool), n
            while live > n // 2:
                least = np.repeat(np.minimum.reduceat(rank, first), sizes)
                hit = np.flatnonzero((rank == least) & (rank < NONE))
                if not len(hit):
                    break
                if self.in_order:
                    run = np.flatnonzero(np.append(True, after[hit[:-1]] != hit[1:]))
                    hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
                else:
                    hit = hit[np.append(True, word[hit][1:] != word[hit][:-1])]
                gone = after[hit]
                symbol[hit] = self.products[rank[hit]]
                after[hit], rank[gone], alive[gone] = after[gone], NONE, False
                before[after[hit]] = hit
                redo = np.concatenate([hit, before[hit]])
                redo = redo[redo < n]
                rank[redo] = self.rank(symbol[redo], symbol[after[redo]])
                found[place[hit]], kept[place[gone]] = symbol[hit], False
                live -= len(hit)
            stay = alive & (np.repeat(np.minimum.reduceat(rank, first), sizes) < NONE)
            symbol, place, word = symbol[:n][stay], place[stay], word[stay]
        left = np.add.reduceat(kept, ends - counts + 1, dtype=np.int64) if len(words) else counts
        return found[kept].astype(np.int32), left

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each text has)."""
        cut = [self.words(t) for t in texts]
        slots = self.slots
        met = set().union(*cut)
        new = [w for w in met if w not in slots]
        if slots and (len(slots) + len(new) > REMEMBERED_WORDS or len(self.symbols) > REMEMBERED_SYMBOLS):
            self.forget()
            slots, new = self.slots, list(met)
        own = [w for w in new if w in self.added]
        new = [w for w in new if w not in self.added]
        ids, counts = self.merged(new)
        slots.update(zip(new + own, range(len(self.starts), len(self.starts) + len(new) + len(own))))
        counts = np.append(counts, np.ones(len(own), np.int64))
        self.starts = np.append(self.starts, len(self.symbols) + np.cumsum(counts) - counts)
        self.lengths = np.append(self.lengths, counts)
        self.symbols = np.concatenate([self.symbols, ids, np.array([self.added[w] for w in own], np.int32)])
        at = np.fromiter((slots[w] for c in cut for w in c), np.int64, sum(map(len, cut)))
        length = self.lengths[at]
        stop = np.cumsum(length)
        out = self.symbols[np.repeat(self.starts[at] - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)]
        through = np.append(0, stop)[np.cumsum([0, *map(len, cut)])]
        if any(len(w) > LONG_WORD for w in new) or len(slots) > REMEMBERED_WORDS:
            self.forget()
        return out, np.diff(through)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each list joined by one blank; numbers that stand for no token are passed over."""
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        known = (flat >= 0) & (flat < self.size)
        names = self.names.take(pa.array(np.where(known, flat, 0)))
        known &= names.is_valid().to_numpy(zero_copy_only=False)
        offsets = np.append(0, np.cumsum(known))[np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy()))]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), names.filter(pa.array(known))), " ")


def tokenizer(data: bytes) -> Tokenizer:
    """The worker's tokenizer for a file's bytes, with the words met so far."""
    known = worker_cache("merges")
    if data not in known:
        known.clear()
        known[data] = Tokenizer(data)
    return known[data]


def grouped(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in groups of about BATCH_CHARS characters; a longer text is a group of its own."""
    start, group, held = 0, [], 0
    for row, text in enumerate(texts):
        text = text.as_py() or ""
        if group and held + len(text) > BATCH_CHARS:
            yield start, group
            start, group, held = row, [], 0
        group.append(text)
        held += len(text)
    if group:
        yield start, group


def encoded(docs: DataFrame, data: bytes, decode: bool = False) -> DataFrame:
    """(doc_id, ids) for each row of `docs` (doc_id, text; other columns are ignored), with `decode` also the ids read
    back, in column decoded. Null and empty texts have no ids; repeated rows are encoded alike; a null doc_id stays null;
    an empty table gives an empty result.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(data)
        for batch in batches:
            for start, texts in grouped(batch.column(1)):
                ids, counts = known.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))
                out = [batch.column(0).slice(start, len(texts)), lists]
                yield pa.RecordBatch.from_arrays(out + [known.decode(lists)] * decode, ["doc_id", "ids", "decoded"][:2 + decode])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        of, "doc_id long, ids array<int>" + ", decoded string" * decode)


def decoded(rows: DataFrame, data: bytes) -> DataFrame:
    """`rows` (doc_id, ids) with the tokens that the ids stand for, joined by one blank, in column decoded; null ids are none."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizer(data)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, known.decode(lists)], ["doc_id", "ids", "decoded"])

    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(of, "doc_id long, ids array<int>, decoded string")
