"""Chat formatting of reply trees.

Messages (tree, node, parent, role, text, score) form trees. Iterative self-joins by doubling find, for each leaf, all
nodes up to the root: after round k a table of 2 ** k-th ancestors exists, and the paths known so far are extended by it,
so a path of d messages takes log2(d) rounds. Branches are ranked by the sum of scores along the path, and each chosen
path becomes one conversation in a template that marks turns and escapes control strings inside texts reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlight.llm.storage import stored

BEGIN, END = "<s>", "</s>"
INSTRUCT, INSTRUCTED = "[INST]", "[/INST]"
ROLE, ROLE_END = "<|role|>", "<|/role|>"
CONTROL = (BEGIN, END, INSTRUCT, INSTRUCTED, ROLE, ROLE_END)


def escaped(text: Column) -> Column:
    """Backslashes doubled, and a backslash and a dash after the first character of each control string; restored() is the inverse."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        doubled = F.replace(doubled, F.lit(control), F.lit(control[0] + "\\-" + control[1:]))
    return doubled


def restored(text: str) -> str:
    return re.sub(r"\\(\\|-)", lambda m: "\\" if m[1] == "\\" else "", text)


def turn(role: Column, text: Column) -> Column:
    """A user's turn, an assistant's turn, or any other role by name."""
    return (F.when(role == "user", F.concat(F.lit(INSTRUCT + " "), text, F.lit(" " + INSTRUCTED)))
            .when(role == "assistant", F.concat(F.lit(" "), text, F.lit(" " + END)))
            .otherwise(F.concat(F.lit(ROLE), escaped(F.coalesce(role, F.lit(""))), F.lit(ROLE_END + " "), text, F.lit(" " + ROLE_END))))


TURN = re.compile(
    f"(?s){re.escape(INSTRUCT)} (?P<user>.*?) {re.escape(INSTRUCTED)}|{re.escape(ROLE)}(?P<role>.*?){re.escape(ROLE_END)} (?P<other>.*?) {re.escape(ROLE_END)}"
    f"| (?P<assistant>.*?) {re.escape(END)}")


def turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of a formatted conversation; the span is that of the escaped text."""
    at = len(BEGIN)
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if found is None:
            raise ValueError("not a formatted conversation")
        kind = next(k for k in ("user", "other", "assistant") if found[k] is not None)
        role = restored(found["role"]) if kind == "other" else kind
        yield role, restored(found[kind]), found.start(kind), found.end(kind)
        at = found.end()


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): every node on the way from each leaf to its root, `up` steps above the leaf.

    Nodes without a parent, or whose parent is missing, are roots. Cycles have no leaf and so no path, and a branch that
    hangs on a cycle ends where the doubling has passed the number of nodes; parents must form trees.
    """
    links = messages.select("tree", "node", "parent").distinct()
    known = links.select("tree", F.col("node").alias("parent")).distinct()
    jump = stored(links.where("parent is not null").join(known, ["tree", "parent"], "left_semi").select(
        "tree", "node", F.col("parent").alias("above")), "ancestors")
    leaves = links.join(jump.select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")).distinct()
    found, step, limit = stored(leaves, "paths"), 1, links.count()
    while step <= limit and not jump.isEmpty():
        further = found.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        found = stored(found.unionByName(further), "paths")
        twice = jump.alias("a").join(jump.alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.above") == F.col("b.node")))
        jump = stored(twice.select("a.tree", "a.node", "b.above"), "ancestors")
        step *= 2
    return found


def conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss) of the best paths of each tree, all of them unless `branches` says how many.

    `messages`: (tree, node, parent, role, text, score); null texts are empty, null scores 0, a null role has no name.
    Paths rank by the sum of their scores, ties by leaf. A node must be unique in its tree; rows without tree or node
    are left out. `loss` holds the spans (start, end), in characters of `formatted`, of the assistants' escaped texts.
    """
    rows = messages.where("tree is not null and node is not null")
    found = paths(rows)
    met = found.join(rows.select("tree", "node", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "node"])
    each = met.withColumn("written", turn(F.col("role"), escaped(F.col("text"))))
    joined = each.groupBy("tree", "leaf").agg(
        F.sum("score").alias("score"),
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "written", F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss")))).alias("path"))
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    whole = ranked.withColumn("formatted", F.concat(F.lit(BEGIN), F.array_join("path.written", "")))
    return whole.select("tree", "leaf", "rank", "score", "formatted", F.col("path").alias("turns")).mapInArrow(
        with_spans, "tree long, leaf long, rank int, score double, formatted string, loss array<struct<start:long,end:long>>")


def with_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = []
        for path in batch.column("turns").to_pylist():
            at, own = len(BEGIN), []
            for x in path:
                if x["loss"]:
                    own.append({"start": at + 1, "end": at + len(x["written"]) - len(END) - 1})
                at += len(x["written"])
            spans.append(own)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tree", "leaf", "rank", "score", "formatted")), pa.array(spans, kind)],
                                         ["tree", "leaf", "rank", "score", "formatted", "loss"])


def digests(formatted: DataFrame) -> DataFrame:
    """(tree, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted conversations."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("formatted"), batch.column("loss").to_pylist()):
                text, whole, count = text.as_py(), hashlib.sha256(), 0
                for role, said, _, _ in turns(text):
                    whole.update(f"{role}\n{said}\n".encode())
                    count += 1
                loss = [restored(text[s["start"]:s["end"]]) for s in spans]
                out.append((count, whole.hexdigest(), sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("tree"), batch.column("leaf"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))],
                ["tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree", "leaf", "formatted", "loss").mapInArrow(
        of, "tree long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_tree(turns_table: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each row answers the one before by turn, then role and text."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = turns_table.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("tree"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
