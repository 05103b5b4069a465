"""Token counts from flat token files: little-endian 16-bit ids, one end-of-document id after each text, no index.

A file is cut into blocks. In each block a vectorised search finds the end-of-document ids; a block knows the lengths of
the documents that begin and end in it, the ids before its first mark and those after its last. A prefix scan over the
blocks of a file (running count of marks, ids carried since the last mark) stitches documents that cross blocks.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerlight.llm.storage import shared_folder, stored, worker_cache

END = 50256                  # free in the vocabulary of ranks
BLOCK_IDS = 1 << 18
FILE_BYTES = 16 << 20        # in one file, about
#: words, numbers, signs and blanks as the public byte-level vocabularies cut them; fixed value
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(ranks: bytes):
    """The worker's byte-level encoder for a vocabulary file of (base64 token, rank) lines."""
    import tiktoken

    known = worker_cache("ranks")
    if ranks not in known:
        known.clear()
        pairs = (line.split() for line in ranks.splitlines() if line)
        known[ranks] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return known[ranks]


def write_token_files(docs: DataFrame, ranks: bytes, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Texts of `docs` (doc_id, text) as flat files in `folder`; returns which document is where: (doc_id, file, ordinal).

    Each task writes its texts in the order it reads them, so nothing is shuffled, and starts a new file after
    `file_bytes`. A file has a name of its own for each attempt of a task; only names that a finished attempt returns
    count, so what a lost executor left behind is ignored. `folder` must be a path or URI that pyarrow opens on every
    executor, as a shared mount or HDFS is.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(ranks).encode_ordinary, np.array([END], "<u2").tobytes()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        out, name, ordinal = None, "", 0
        for batch in batches:
            names, ordinals = [], []
            for text in batch.column(1):
                if out is None or out.tell() >= file_bytes:
                    if out is not None:
                        out.close()
                    name, ordinal = f"part-{uuid.uuid4().hex}.bin", 0
                    out = store.open_output_stream(f"{root}/{name}")
                out.write(np.array(encode(text.as_py() or ""), "<u2").tobytes() + end)
                names.append(name)
                ordinals.append(ordinal)
                ordinal += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(ordinals, pa.int64())], ["doc_id", "file", "ordinal"])
        if out is not None:
            out.close()

    return stored(docs.select("doc_id", "text").mapInArrow(of, "doc_id long, file string, ordinal long"), "documents")


def scan_block(ids: np.ndarray, end: int = END) -> tuple[np.ndarray, int, int]:
    """Lengths of the documents that begin after one mark of the block and end at the next; ids before the first mark; ids after the last.

    Without a mark all ids count as before.
    """
    marks = np.flatnonzero(ids == end)
    if not len(marks):
        return np.zeros(0, np.int64), len(ids), 0
    return np.diff(marks) - 1, int(marks[0]), int(len(ids) - marks[-1] - 1)


def blocks_of(batches: Iterator[pa.RecordBatch], end: int = END, block_ids: int = BLOCK_IDS) -> Iterator[pa.RecordBatch]:
    names = ["path", "block", "marks", "head", "tail", "inner"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            ids, rows = np.frombuffer(content.as_buffer(), "<u2"), []
            for block, lo in enumerate(range(0, len(ids), block_ids)):
                inner, head, tail = scan_block(ids[lo:lo + block_ids], end)
                marked = len(inner) or (ids[lo:lo + block_ids] == end).any()
                rows.append((path.as_py(), block, len(inner) + 1 if marked else 0, head, tail, inner))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def counted(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ordinal, n_tokens) of each document in the flat files of a folder, in the order in which they stand.

    Ids after the last mark of a file are no document.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    found = files.select("path", "content").mapInArrow(blocks_of, "path string, block long, marks long, head long, tail long, inner array<long>")
    along = Window.partitionBy("path").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # how many ids up to here, and up to the last mark before: their difference is what is carried into a block
    scanned = (found.withColumn("ended", F.coalesce(F.sum("marks").over(before), F.lit(0)))
               .withColumn("group", F.sum(F.when(F.col("marks") > 0, 1).otherwise(0)).over(along)))
    open_after = scanned.withColumn("rest", F.when(F.col("marks") > 0, F.col("tail")).otherwise(F.col("head")))
    carried = open_after.withColumn("sofar", F.sum("rest").over(Window.partitionBy("path", "group").orderBy("block")))
    ready = carried.withColumn("carry", F.coalesce(F.lag("sofar").over(along), F.lit(0))).where("marks > 0")
    lengths = F.concat(F.array(F.col("head") + F.col("carry")), F.col("inner"))
    return ready.select("path", "ended", F.posexplode_outer(lengths).alias("place", "n_tokens")).select(
        "path", (F.col("ended") + F.col("place")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal) for each row of `docs` (doc_id, text; other columns are ignored), counted in the files.

    Null and empty texts have 0 tokens; repeated rows and null ids have rows of their own; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    placed = write_token_files(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ranks, folder)
    if placed.isEmpty():
        return placed.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), "file", "ordinal")
    counts = counted(spark, folder).withColumn("file", F.substring_index("path", "/", -1)).drop("path")
    return placed.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
