"""Resharding by minimum-cost flow: from OLD shards to NEW ones with row counts at most one apart, moving few bytes.

A shard is a folder of blocks, each a file of bounded size. The driver sees one line for each block (rows, bytes). Its
flow network sends the rows of each block either to the shard they are in, at no cost, or through a hub to any shard, at
the block's mean bytes a row; shards take the even share, and the rest takes one row more in as many shards as needed.
The optimal flow says how many rows of which block move. Only files of such blocks are rewritten: rows that move are the
smallest of their block, so the optimum is over mean sizes (and groups of blocks beyond SUPPLIES a shard), not over the
bytes that move. All other files stay untouched.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlight.llm.storage import shared_folder

OLD, NEW = 36, 40
OVERHEAD = 16                # bytes of a document besides its text
FILE_BYTES = 32 << 20
LEAST_BLOCKS = 8             # in a shard
SUPPLIES = 32                # groups of blocks of similar mean size in a shard, for the network


def min_cost_flow(nodes: int, arcs: list[tuple[int, int, int, float]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a largest flow at least cost, by shortest augmenting paths."""
    to, left, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, capacity, price in arcs:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            left.append(c)
            cost.append(p)
    while True:
        distance, via, waiting, queued = [float("inf")] * nodes, [-1] * nodes, deque([source]), [False] * nodes
        distance[source] = 0
        while waiting:
            x = waiting.popleft()
            queued[x] = False
            for arc in out[x]:
                if left[arc] and distance[x] + cost[arc] < distance[to[arc]] - 1e-9:
                    distance[to[arc]], via[to[arc]] = distance[x] + cost[arc], arc
                    if not queued[to[arc]]:
                        queued[to[arc]] = True
                        waiting.append(to[arc])
        if distance[sink] == float("inf"):
            return [left[2 * i + 1] for i in range(len(arcs))]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(left[arc] for arc in path)
        for arc in path:
            left[arc] -= amount
            left[arc ^ 1] += amount


@dataclass(frozen=True)
class Block:
    shard: int
    bucket: int
    rows: int
    bytes: int


def transfers(blocks: list[Block], new: int) -> list[tuple[int, int, int, int, int]]:
    """(shard, bucket, first rank, rank after the last, target) of the rows that move; ranks go by size within the block.

    After it the shards 0 to new - 1 hold counts at most one apart; shards beyond are emptied.
    """
    supplies: list[list[Block]] = []
    for shard in sorted({b.shard for b in blocks}):
        own = sorted((b for b in blocks if b.shard == shard and b.rows), key=lambda b: (b.bytes / b.rows, b.bucket))
        width = -(-len(own) // SUPPLIES) or 1
        supplies += [own[i:i + width] for i in range(0, len(own), width)]
    total = sum(b.rows for b in blocks)
    share, more = divmod(total, new)
    hub, source, sink, extra = (len(supplies) + new + i for i in range(4))
    arcs = []
    for i, group in enumerate(supplies):
        rows, size, shard = sum(b.rows for b in group), sum(b.bytes for b in group), group[0].shard
        arcs += [(source, i, rows, 0), (i, len(supplies) + shard if shard < new else hub, rows, 0 if shard < new else size / rows), (i, hub, rows, size / rows)]
    first = len(arcs)
    for j in range(new):
        arcs += [(hub, len(supplies) + j, total, 0), (len(supplies) + j, sink, share, 0), (len(supplies) + j, extra, 1, 0)]
    flow = min_cost_flow(extra + 1, [*arcs, (extra, sink, more, 0)], source, sink)
    wanted = deque((j, flow[first + 3 * j]) for j in range(new) if flow[first + 3 * j])
    moves = []
    for i, group in enumerate(supplies):
        moving = flow[3 * i + 2] + (flow[3 * i + 1] if group[0].shard >= new else 0)
        for block in group:
            rank, stop = 0, min(block.rows, moving)
            moving -= stop
            while rank < stop:
                target, lack = wanted.popleft()
                n = min(lack, stop - rank)
                moves.append((block.shard, block.bucket, rank, rank + n, target))
                rank += n
                if lack > n:
                    wanted.appendleft((target, lack - n))
    return moves


def sized(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, others) with size, text_crc32 and mark, a hash that orders the rows of a block."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                      (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"))
    return own.withColumn("mark", F.xxhash64("doc_id", "row.text"))


def write_old(docs: DataFrame, folder: str, old: int = OLD, file_bytes: int = FILE_BYTES) -> None:
    """The layout to start from: documents by a hash of id and text in folders shard=, bucket= of files of about `file_bytes`."""
    rows = sized(docs)
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(LEAST_BLOCKS, -(-total // (old * file_bytes)))
    placed = rows.withColumn("shard", F.pmod("mark", F.lit(old)).cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64("mark"), F.lit(buckets)).cast("int"))
    placed.repartition("shard", "bucket").sortWithinPartitions("shard", "bucket").write.partitionBy("shard", "bucket").parquet(folder)


def reshard(spark, old_folder: str, new_folder: str, schema, new: int = NEW) -> DataFrame:
    """Moves rows between the blocks of `old_folder`; the layout after it, as (shard, origin, bucket, doc_id, size, text_crc32, mark).

    Rewritten files go to `new_folder`; blocks without a move keep their files.
    """
    old = spark.read.schema(schema).parquet(old_folder)
    stats = old.groupBy("shard", "bucket").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()  # a line for each file
    moves = transfers([Block(r["shard"], r["bucket"], r["rows"], r["bytes"]) for r in stats], new)
    plan = spark.createDataFrame(moves, "shard int, bucket int, first long, stop long, target int")
    touched = plan.select("shard", "bucket").distinct()
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("size", "mark")) - 1
    # lines of plan and touched: one for each moved block and a few for each shard
    opened = old.join(F.broadcast(touched), ["shard", "bucket"]).withColumn("rank", rank)
    hit = opened.alias("r").join(F.broadcast(plan.alias("p")), (F.col("r.shard") == F.col("p.shard")) & (F.col("r.bucket") == F.col("p.bucket"))
                                 & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("stop")), "left")
    moved = hit.select("r.row", "r.doc_id", "r.size", "r.text_crc32", "r.mark", F.coalesce("p.target", "r.shard").alias("shard"),
                       F.col("r.shard").alias("origin"), F.col("r.bucket").alias("bucket"))
    moved.write.partitionBy("shard", "origin", "bucket").parquet(new_folder)
    keys = ["shard", "origin", "bucket", "doc_id", "size", "text_crc32", "mark"]
    kept = old.join(F.broadcast(touched), ["shard", "bucket"], "left_anti").withColumn("origin", F.col("shard")).select(keys)
    return kept.unionByName(spark.read.schema(moved.schema).parquet(new_folder).select(keys)) if moves else kept


def slotted(layout: DataFrame) -> DataFrame:
    """`layout` with slot: gapless from 0 in each shard, by counting whole blocks first and rows within a block then."""
    block = ["shard", "origin", "bucket"]
    counts = layout.groupBy(block).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("origin", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(block).orderBy("doc_id", "mark")).cast("long") - 1
    return layout.withColumn("within", within).join(starts, block).withColumn("slot", F.col("start") + F.col("within")).drop("start", "within")


def resharded(docs: DataFrame, old: int = OLD, new: int = NEW) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of `docs` (doc_id, text, others) after resharding.

    The law is `rows`: counts at most one apart. Size is the text's UTF-8 bytes (null: none) and OVERHEAD. Null ids,
    null texts and repeated rows are rows like others; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    before, after = shared_folder(spark, "shards"), shared_folder(spark, "shards")
    write_old(docs, before, old)
    schema = sized(docs).withColumn("shard", F.lit(0)).withColumn("bucket", F.lit(0)).schema
    return slotted(reshard(spark, before, after, schema, new)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
