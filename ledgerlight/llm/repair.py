"""Repair of conversations: the cheapest edits that give user and assistant in turns, after an optional system message.

A message is kept (K), given the role that is due (R) or deleted (D), and messages without text can be put in (I). With
the state of the dialogue (start, after s, u or a) these edits are arcs of a graph over (message, state); costs to the end
come from a backward DP. Among cheapest paths the one with the ASCII-least string of edits is taken by prefix doubling: the
nodes of optimal arcs are ranked by their next 1, 2, 4, ... edits, each round joining a node's rank with that of the node
its pointer has reached, and following the doubled pointers gives the path. In any state an edit leads to one state only,
so a node's arcs all differ in their first letter.

Messages without their texts are sorted in ranges, so a conversation of any length is spread over tasks. A task works on
the pieces of conversations in its range; what lies beyond a piece's end is known from the pieces' cost matrices, and the
state at its beginning from the states in which the pieces before end. Only the SHA-256 of a conversation, which can't be
taken in parts, runs through one task, message by message.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlight.llm.storage import stored

PART_ROWS = 50_000
BLANKS = " \t\n\x0b\x0c\r"
START, S, U, A = range(4)                 # states; S, U, A are codes of a role's initial too, 0 of any other
NEXT = np.array([U, U, A, U])             # the state after the role that is due
KEPT = np.array([[-1, S, U, -1], [-1, -1, U, -1], [-1, -1, -1, A], [-1, -1, U, -1]])   # by state and initial
NAMES = np.array([None, None, "user", "assistant"], object)
NONE, DELETE, INSERT, KEEP, REROLE = range(5)
LETTERS = np.array(["", "D", "I", "K", "R"], object)
COSTS = {"rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
NEVER = 1 << 60


def messages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a space for each null role or text; other columns are left out."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """messages() with faults by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its full stops,
    exclamation and question marks, 3 repeats it, 4 makes the user say it."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    out = messages(rows).withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(0)


def in_order(numbered: DataFrame) -> DataFrame:
    """(place, part, uid, conv_id, turn, initial, fault) of (uid, conv_id, turn, role, text), in the order of place.

    fault is blank, duplicate (role and text seen earlier in the conversation), truncated or null, the first that holds.
    """
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = numbered.select("uid", "conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), (end == "").alias("blank"),
                            (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("truncated"))
    first = light.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "uid")).alias("first")).select(F.col("first.uid").alias("uid"), F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    keys = ["conv_id", "turn", "role", "digest", "uid"]
    parts = -(-max(1, numbered.count()) // PART_ROWS)
    ordered = light.join(first, "uid", "left").withColumn("fault", fault).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = ordered.withColumn("place", F.monotonically_increasing_id())
    return stored(ordered.select("place", F.shiftright("place", 33).alias("part"), "uid", "conv_id", "turn", initial(F.col("role")).alias("initial"), "fault"), "ordered")


class Part:
    """The pieces of conversations in one range of messages, as arrays."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows["place"].to_numpy())
        rows = rows.take(pa.array(order))
        self.part = rows["part"][0].as_py()
        self.place, self.uid, self.initial = (rows[c].to_numpy() for c in ("place", "uid", "initial"))
        fault = rows["fault"].fill_null("").to_numpy(zero_copy_only=False).astype(str)
        self.gone, self.late = np.isin(fault, ("blank", "duplicate")), np.where(fault == "truncated", COSTS["truncated"], 0)
        known = rows["conv_id"].is_valid().to_numpy(zero_copy_only=False)
        conv = rows["conv_id"].fill_null(0).to_numpy()
        self.start = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (known[1:] != known[:-1])))
        self.size = np.diff(np.append(self.start, len(conv)))
        self.conv = [int(conv[i]) if known[i] else None for i in self.start]

    def costs(self, pieces: np.ndarray, end: np.ndarray, each: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Least costs from each state before the given pieces on, `end` (piece, state, column) being those after them.

        With `each` also those before every row, by piece; all steps run over all pieces that are as long.
        """
        order = np.argsort(-self.size[pieces], kind="stable")
        size, stop = self.size[pieces][order], (self.start + self.size)[pieces][order]
        now = end[order].astype(np.int64)
        inner = np.full((len(self.place), 4, end.shape[2]), NEVER) if each else None
        for t in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -t))        # pieces of more than t rows
            i = stop[:k] - 1 - t
            after, late, gone = now[:k], self.late[i][:, None, None], self.gone[i][:, None, None]
            to = KEPT[:, self.initial[i]].T
            kept = np.where((to >= 0)[:, :, None], np.take_along_axis(after, np.maximum(to, 0)[:, :, None], 1), NEVER)
            best = np.minimum(kept, after[:, NEXT] + COSTS["rerole"]) + late
            best = np.minimum(np.where(gone, NEVER, best), after + COSTS["delete"])
            now[:k] = np.minimum(inserted(best), NEVER)
            if each:
                inner[i] = now[:k]
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[back], inner

    def paths(self, pieces: np.ndarray, end: np.ndarray, last: np.ndarray, entry: np.ndarray) -> dict[str, np.ndarray]:
        """The ASCII-least cheapest edits through each piece from its entry state (columns: state, -1 for none).

        Nodes are (row, state) and, after a piece's last row, (end, state); only after a conversation's last piece edits
        can follow there.
        """
        _, inner = self.costs(pieces, end[:, :, None], each=True)
        n, p = len(self.place), len(pieces)
        cost = np.concatenate([inner[:, :, 0], end])                        # nodes of rows, then of ends
        row = np.repeat(np.arange(n + p), 4)
        state = np.tile(np.arange(4), n + p)
        following = np.arange(1, n + 1)
        following[(self.start + self.size)[pieces] - 1] = n + np.arange(p)
        inside = np.zeros(n + p, bool)
        for a, b in zip(self.start[pieces], (self.start + self.size)[pieces]):
            inside[a:b] = True
        own, r = inside[row], np.minimum(row, n - 1)
        after = np.where(own, following[r], 0)
        kept = KEPT[state, self.initial[r]]
        here, late = cost.reshape(-1), self.late[r]
        alive = here < NEVER
        ends = np.append(np.zeros(n, bool), last)[row]
        arcs = []                                                           # (letter, head, whether it is optimal)
        for letter, head, weight, can in (
                (DELETE, after * 4 + state, COSTS["delete"], own), (INSERT, row * 4 + NEXT[state], COSTS["insert"], own | ends),
                (KEEP, after * 4 + np.maximum(kept, 0), late, own & (kept >= 0) & ~self.gone[r]), (REROLE, after * 4 + NEXT[state], COSTS["rerole"] + late, own & ~self.gone[r])):
            arcs.append((letter, head, can & alive & (here == here[head] + weight)))
        heads, letters = np.array([h for _, h, _ in arcs]), np.array([x for x, _, _ in arcs])
        optimal = np.array([o for _, _, o in arcs])
        nodes = np.arange(len(here))

        def chosen(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(letter, head) of each node's optimal arc of the least key; an end points at itself."""
            at = np.argmin(np.where(optimal, key, NEVER), axis=0)
            any_arc = optimal.any(axis=0)
            return np.where(any_arc, letters[at], NONE), np.where(any_arc, heads[at, nodes], nodes)

        rank, pointer = chosen(np.broadcast_to(letters[:, None], optimal.shape))
        while (pointer[pointer] != pointer).any():                          # ranks of 1, 2, 4, ... edits
            _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)
            pointer = pointer[pointer]
        letter, pointer = chosen(letters[:, None] * (int(rank.max(initial=0)) + 1) + rank[heads])
        doubled, length = [pointer.astype(np.int32)], (letter != NONE).astype(np.int64)
        while (pointer[pointer] != pointer).any():
            length = length + length[pointer]
            pointer = pointer[pointer]
            doubled.append(pointer.astype(np.int32))
        length = length + np.where(pointer != nodes, length[pointer], 0)
        begin = self.start[pieces][:, None] * 4 + entry
        run, which = np.nonzero((entry >= 0) & alive[np.maximum(begin, 0)])
        begin = begin[run, which]
        count = length[begin]
        stop = np.cumsum(count)
        nth = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - count, count)
        node = np.repeat(begin, count)
        for bit, jump in enumerate(doubled):
            on = (nth >> bit) & 1 == 1
            node[on] = jump[node[on]]
        exits = np.full(entry.shape, -1)
        exits[run, which] = pointer[begin] % 4
        return {"exits": exits, "piece": np.repeat(run, count), "nth": nth, "letter": letter[node], "row": node // 4, "state": node % 4}


def inserted(costs: np.ndarray) -> np.ndarray:
    """Costs (piece, state, column) where messages can be put in first."""
    for _ in range(3):
        costs = np.minimum(costs, costs[:, NEXT] + COSTS["insert"])
    return costs


def finish() -> np.ndarray:
    """Costs of each state after the last message: none at the start or after an answer."""
    return inserted(np.array([0, NEVER, NEVER, 0], np.int64)[None, :, None])[0, :, 0]


def edges(rows: pa.Table) -> pa.Table:
    """First and last piece of a part, which alone may go on in other parts: initials and costs from state to state."""
    part = Part(rows)
    pieces = np.unique([0, len(part.start) - 1])
    through, _ = part.costs(pieces, np.broadcast_to(np.where(np.eye(4) > 0, 0, NEVER), (len(pieces), 4, 4)))
    first, last = part.initial[part.start[pieces]], part.initial[(part.start + part.size)[pieces] - 1]
    return pa.table([pa.array([part.part] * len(pieces), pa.int64()), pa.array([part.conv[p] for p in pieces], pa.int64()), pa.array(first, pa.int32()),
                     pa.array(last, pa.int32()), pa.array(through.reshape(len(pieces), 16).tolist(), pa.list_(pa.int64()))], names=["part", "conv_id", "first", "last", "costs"])


def ends_of(pieces: pa.Table) -> pa.Table:
    """The costs after each piece of a conversation, from the last piece back."""
    pieces = pieces.sort_by("part")
    after, out = finish(), []
    for costs in reversed(pieces["costs"].to_pylist()):
        out.append(after.tolist())
        after = np.minimum((np.array(costs).reshape(4, 4) + after).min(axis=1), NEVER)
    final = [i == len(out) - 1 for i in range(len(out))]
    return pa.table([pieces["part"], pieces["conv_id"], pa.array(out[::-1], pa.list_(pa.int64())), pa.array(final)], names=["part", "conv_id", "after", "final"])


def entries_of(pieces: pa.Table) -> pa.Table:
    """The state before each piece of a conversation, from the first piece on."""
    pieces = pieces.sort_by("part")
    state, out = START, []
    for exits in pieces["exits"].to_pylist():
        out.append(state)
        state = exits[state]
    return pieces.select(["part", "conv_id", "after", "final"]).append_column("entry", pa.array(out, pa.int32()))


def exits_of(rows: pa.Table, known: pa.Table) -> pa.Table:
    """The state after each piece of `known` for each state before it."""
    part = Part(rows)
    at = {c: i for i, c in enumerate(part.conv)}
    pieces = np.array([at[c] for c in known["conv_id"].to_pylist()])
    exits = part.paths(pieces, np.array(known["after"].to_pylist()), known["final"].to_numpy(zero_copy_only=False), np.tile(np.arange(4), (len(pieces), 1)))["exits"]
    return known.append_column("exits", pa.array(exits.tolist(), pa.list_(pa.int32())))


EDITS = "conv_id long, place long, nth long, uid long, edit string, role string, cost long"


def edits_of(rows: pa.Table, known: pa.Table) -> pa.Table:
    """The edits of a part, in the order (place, nth); those that put a message in have no uid."""
    part = Part(rows)
    at, n = {c: i for i, c in enumerate(part.conv)}, len(part.start)
    after, last, entry = np.tile(finish(), (n, 1)), np.ones(n, bool), np.full((n, 1), START)
    for conv, costs, final, state in zip(*(known[c].to_pylist() for c in ("conv_id", "after", "final", "entry"))):
        after[at[conv]], last[at[conv]], entry[at[conv]] = costs, final, state
    found = part.paths(np.arange(n), after, last, entry)
    letter, piece = found["letter"], found["piece"]
    row = np.where(found["row"] < len(part.place), found["row"], (part.start + part.size)[piece] - 1)   # at an end: after the last row
    takes = letter != INSERT
    price = np.select([letter == DELETE, letter == INSERT], [COSTS["delete"], COSTS["insert"]], part.late[row] + np.where(letter == REROLE, COSTS["rerole"], 0))
    role = np.where(np.isin(letter, (INSERT, REROLE)), NAMES[NEXT[found["state"]]], None)
    conv = pa.array(part.conv, pa.int64()).take(pa.array(piece))
    return pa.table([conv, pa.array(part.place[row]), pa.array(found["nth"]), pa.array(part.uid[row], mask=~takes), pa.array(LETTERS[letter], pa.string()),
                     pa.array(role, pa.string()), pa.array(price, pa.int64())], names=["conv_id", "place", "nth", "uid", "edit", "role", "cost"])


def edited(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits of in_order(), and the pieces of conversations that lie in several parts."""
    costs = "after array<long>, final boolean"
    tips = stored(ordered.groupBy("part").applyInArrow(edges, "part long, conv_id long, first int, last int, costs array<long>"), "edges")
    split = stored(tips.withColumn("pieces", F.count("*").over(Window.partitionBy("conv_id"))).where("pieces > 1").drop("pieces"), "edges")
    after = stored(split.groupBy("conv_id").applyInArrow(ends_of, f"part long, conv_id long, {costs}"), "ends")
    shared = ordered.join(after.select("part").distinct(), "part", "left_semi")
    exits = shared.groupBy("part").cogroup(after.groupBy("part")).applyInArrow(exits_of, f"part long, conv_id long, {costs}, exits array<int>")
    entry = stored(stored(exits, "exits").groupBy("conv_id").applyInArrow(entries_of, f"part long, conv_id long, {costs}, entry int"), "entries")
    return stored(ordered.groupBy("part").cogroup(entry.groupBy("part")).applyInArrow(edits_of, EDITS), "edits"), split


def repaired(numbered: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, place, nth, edit, role, text, cost): every edit in the order (place, nth); deleted messages have no text."""
    columns = ["conv_id", "place", "nth", "edit", "role", "text", "cost"]
    own = numbered.select("uid", F.col("role").alias("own"), "text")
    kept = edits.where("edit in ('K', 'R')").join(own, "uid").withColumn("role", F.coalesce("role", "own")).select(columns)
    return kept.unionByName(edits.where("edit in ('D', 'I')").withColumn("text", F.when(F.col("edit") == "I", F.lit(""))).select(columns))


def digested(edits: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, repaired_sha256) of repaired(): each conversation's rows pass through a task one by one."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha, audit, cost, none = None, None, [], 0, True

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([cost]), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])],
                                              ["conv_id", "cost", "audit", "repaired_sha256"])

        for batch in batches:
            for conv, edit, role, text, price in zip(*(c for c in batch.columns)):
                if sha is None or conv.as_py() != current:
                    if sha is not None:
                        yield row()
                    current, sha, audit, cost, none = conv.as_py(), hashlib.sha256(), [], 0, True
                edit = edit.as_py()
                audit.append(edit)
                cost += price.as_py()
                if edit != "D":
                    sha.update(("" if none else "\n").encode() + role.as_py().encode() + b":" + text.as_py().encode())
                    none = False
        if sha is not None:
            yield row()

    by = ["conv_id", "place", "nth"]
    return edits.repartition("conv_id").sortWithinPartitions(*by).select("conv_id", "edit", "role", "text", "cost").mapInArrow(
        of, "conv_id long, cost long, audit string, repaired_sha256 string")


def adjacent(first: Column, second: Column) -> Column:
    """Whether two initials must not follow each other."""
    return ~((first == S) & (second == U) | (first == U) & (second == A) | (first == A) & (second == U))


def numbered_messages(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) with a number of their own, uid, stored."""
    return stored(rows.withColumn("uid", F.monotonically_increasing_id()), "messages")


def repair_report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of messages().

    Rows of a conversation count in the order of turn (nulls first), then role, then SHA-256 of the text; a null conv_id
    is a conversation of its own. Repeated rows are duplicates. An empty table gives an empty result.
    """
    numbered = numbered_messages(rows)
    ordered = in_order(numbered)
    edits, split = edited(ordered)
    fault = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    turns = ordered.groupBy("conv_id", "turn").agg(*(fault(x) for x in ("blank", "duplicate", "truncated")))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = turns.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated")))
    before = Window.partitionBy("part").orderBy("place")
    same = F.lag("conv_id").over(before).eqNullSafe(F.col("conv_id")) & (F.row_number().over(before) > 1)
    inside = ordered.select("conv_id", (same & adjacent(F.lag("initial").over(before), F.col("initial"))).cast("long").alias("illegal"))
    across = split.withColumn("previous", F.lag("last").over(Window.partitionBy("conv_id").orderBy("part"))).where("previous is not null").select(
        "conv_id", adjacent(F.col("previous"), F.col("first")).cast("long").alias("illegal"))
    illegal = inside.unionByName(across).groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))
    out = counts
    for more in (illegal, digested(repaired(numbered, edits))):
        more = more.withColumnRenamed("conv_id", "_conv")
        out = out.join(more, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage_report(rows: DataFrame) -> DataFrame:
    """repair_report() of damaged() rows, one row for every conv_id of `rows`; nothing left: zeros and empty strings' values."""
    report = repair_report(damaged(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(report, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
