"""Quality classifier: a byte-level convolutional network in numpy.

Windows of WIDTH bytes, STRIDE apart, cover the whole text, and chunks of CHUNK windows overlap by half. Each learned
filter answers for each window. Two things are max-pooled over the text and combined into one probability: a filter's
answers, which see marks of a few bytes, and the squared mean of its answers in a chunk, which sees monotony (in varied
text the answers of a chunk average out). Byte embedding and filter multiply out to one table (offset, byte) -> answers,
so scoring is table look-ups and sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ledgerlight.llm import shingles

WIDTH, STRIDE, FILTERS, EMBEDDING = 8, 4, 16, 8
CHUNK = 32                   # windows
SAMPLE_ROWS = 3000           # labelled rows for training at most
SAMPLE_TEXT_BYTES = 1 << 16  # longer texts are scored but not used for training
STEPS, BATCH, RATE, DECAY = 500, 32, 0.02, 1e-4
KEEP = 0.3                   # predicted 1 from this score on
BLOCK = 1 << 15              # windows answered at once, whole half chunks


class Network:
    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.bytes = draw.normal(0, 0.5, (256, EMBEDDING))
        self.filters = draw.normal(0, (WIDTH * EMBEDDING) ** -0.5, (WIDTH, EMBEDDING, FILTERS))
        self.shift = np.zeros(FILTERS)
        self.out = np.concatenate([draw.normal(0, 0.5, FILTERS), np.full(FILTERS, -0.5)])
        self.bias = np.zeros(1)

    def table(self) -> np.ndarray:
        table = np.einsum("be,kef->kbf", self.bytes, self.filters)
        table[0] += self.shift
        return table.astype(np.float32)


def pooled(table: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pooled values (answers, then squared means), the windows and the half chunks that gave them, and the signed means.

    The text is padded with zero bytes to whole windows; windows that a chunk lacks count as 0 in its mean.
    """
    windows = max(1, -(-max(0, len(text) - WIDTH) // STRIDE) + 1)
    padded = np.zeros((windows - 1) * STRIDE + WIDTH, np.uint8)
    padded[:len(text)] = text
    half, parts, best, at = CHUNK // 2, [], None, None
    for lo in range(0, windows, BLOCK):
        hi = min(windows, lo + BLOCK)
        answers = np.zeros((hi - lo, table.shape[2]), np.float32)
        for k in range(WIDTH):
            answers += table[k].take(padded[lo * STRIDE + k:(hi - 1) * STRIDE + k + 1:STRIDE], axis=0)
        where = answers.argmax(axis=0)
        top = answers[where, np.arange(answers.shape[1])]
        best, at = (top, where) if best is None else (np.maximum(best, top), np.where(top > best, where + lo, at))
        parts.append(np.add.reduceat(answers, np.arange(0, hi - lo, half), axis=0))
    sums = np.concatenate(parts)
    sums[:-1] += sums[1:]
    means = sums / CHUNK
    where = (means * means).argmax(axis=0)
    mean = means[where, np.arange(means.shape[1])]
    return np.concatenate([best, mean * mean]), np.stack([at, where]), mean


def probability(best: np.ndarray, out: np.ndarray, bias: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(float(best @ out) + bias, -30, 30))))


def fit(texts: list[bytes], labels: list[int]) -> Network:
    """Adam on the logistic loss; the gradient of a pooled value goes to the window or chunk that gave it."""
    net, draw = Network(), np.random.default_rng(1)
    rate = (sum(labels) + 1) / (len(labels) + 2)
    net.bias[0] = np.log(rate / (1 - rate))
    if len(set(labels)) < 2:
        net.out[:] = 0
        return net
    rows = [np.frombuffer(t or b"\0", np.uint8) for t in texts]
    weights = [net.bytes, net.filters, net.out, net.bias, net.shift]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    filters, inside = np.arange(FILTERS), np.arange(CHUNK)
    for step in range(1, STEPS + 1):
        table, grad_table = net.table(), np.zeros((WIDTH, 256, FILTERS))
        grads = [np.zeros_like(w) for w in weights]
        for r in draw.integers(0, len(rows), BATCH):
            text = rows[r]
            best, (window, chunk), mean = pooled(table, text)
            miss = (probability(best, net.out, net.bias[0]) - labels[r]) / BATCH
            grads[2] += miss * best
            grads[3] += miss
            windows = max(1, -(-max(0, len(text) - WIDTH) // STRIDE) + 1)
            spread = chunk[:, None] * (CHUNK // 2) + inside
            share = np.where(spread < windows, (miss * net.out[FILTERS:] * 2 * mean / CHUNK)[:, None], 0)
            for k in range(WIDTH):
                for places, which, grad in ((window, filters, miss * net.out[:FILTERS]),
                                            (spread, np.broadcast_to(filters[:, None], spread.shape), share)):
                    place = places * STRIDE + k
                    seen = np.where(place < len(text), text[np.minimum(place, len(text) - 1)], 0)
                    np.add.at(grad_table[k], (seen, which), grad)
        grads[0] = np.einsum("kbf,kef->be", grad_table, net.filters)
        grads[1] = np.einsum("kbf,be->kef", grad_table, net.bytes)
        grads[4] = grad_table[0].sum(axis=0)
        pace = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        for w, g, m, v in zip(weights, grads, first, second):
            g = g + DECAY * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text leaves no remainder by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """Fit on at most `sample_rows` labelled rows that aren't held out, of texts up to SAMPLE_TEXT_BYTES.

    Labels other than 0 and 1, null ids, and ids with different labels are left out.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    chosen = known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = (docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .where(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
            .join(F.broadcast(chosen), "doc_id")   # sample_rows rows at most
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
            .orderBy("doc_id").collect())
    return fit([r["text"].encode() for r in rows], [int(r["quality"]) for r in rows])


def scored(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """`docs` (with a column text) and a column `name`, which replaces an own one; null and empty texts have a score as well."""
    docs = docs.drop(name)
    table, out, bias = net.table(), net.out.copy(), float(net.bias[0])
    place = docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = shingles.buffers(batch.column(place))
            scores = [probability(pooled(table, data[offsets[r]:offsets[r + 1]])[0], out, bias) for r in range(len(batch))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(of, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs` (doc_id, text; other columns are ignored).

    The network learns `labels.quality` (doc_id, quality) from rows that aren't held out. Without labels each score is
    0.5; with one class only, a constant. Repeated rows get equal scores; a null id counts as held out.
    """
    net = trained(docs, labels)
    return scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), net).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
