"""Conversation structure repair: cheapest edits by a min-plus DP, least audit by prefix-doubling ranks of optimal arcs.

Rows of a conversation are read by turn (null turns first; equal turns by role, then text; null roles and texts are one space). Each
row gets its first fault: blank (nothing but spaces), duplicate (role and text seen before), truncated (its last character that is no
space is none of ``.!?``). Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4 (the only edit of blank and duplicate rows),
Insert of an empty user or assistant message anywhere 3; a truncated row that stays costs 3 more. The role initials of the result must
be ``(s?(ua)+)?``. Of the cheapest edit lists the one whose initials (K, R, D, I) come first in ASCII order is taken.

The automaton has four places: nothing yet, after a system row, after a user row, after an assistant row. Reading a row is a 4 x 4
min-plus matrix, so a conversation is cut into blocks of at most ``BLOCK`` rows along one global sort, and however many rows one
conversation has, they lie in many blocks on many tasks: blocks multiply their matrices; a pass over matrices alone, latest block
first, brings each block the costs behind it; each block then ranks its optimal arcs. An arc's rank after round k orders the audits of
2^k letters that begin with it, its pointer leads 2^k letters on, and both double each round; the least-ranked arc out of each entry
place starts the block's least path, whose letters are read off through the doubled pointers. (No two optimal arcs out of one node
have the same letter, so the arc that follows another is settled by the first round and the later ranks agree with it.)

A last pass reads the blocks of each conversation in order and holds one block and the audit: SHA-256 of a whole conversation can't be
split. Equal rows of one turn are one row with a count throughout. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import staged
from tapeloom.runtime import ship

BLOCK = 256
SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
FAR = 1 << 50
USER, ASSISTANT = 2, 3  # places after a user and an assistant row; 0: nothing yet, 1: after a system row
FORCED = 8  # kind of a row that must go; other kinds: 2 * initial (s, u, a, other) + truncated
INITIALS = ["s", "u", "a"]
NEXT = np.array([USER, USER, ASSISTANT, USER])  # where an inserted or reroled message leads from each place
KEPT = np.array([[1, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1, -1, -1, -1]])  # by initial and place
AT_END = np.array([0, 2 * INSERT, INSERT, 0])  # what still has to be inserted after the last row
LETTERS = b"DIKR"
D, I, K, R = range(4)  # noqa: E741


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of stacks of matrices (or of matrices and columns)."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), FAR)


def _matrices() -> np.ndarray:
    """Cost from place to place over the inserts before a row and the row itself, by kind of row."""
    inserts = np.full((4, 4), FAR)
    for place in range(4):
        inserts[place, place] = 0
        inserts[place, NEXT[place]] = INSERT
    inserts = _product(inserts, inserts)
    out = np.full((FORCED + 1, 4, 4), FAR)
    for kind in range(FORCED + 1):
        for place in range(4):
            out[kind, place, place] = DELETE
            if kind != FORCED:
                stays = CUT * (kind % 2)
                out[kind, place, NEXT[place]] = min(out[kind, place, NEXT[place]], REROLE + stays)
                if (to := KEPT[kind // 2, place]) >= 0:
                    out[kind, place, to] = min(out[kind, place, to], stays)
    return _product(inserts, out)


STEP = _matrices()


def block_matrices(kinds: np.ndarray, counts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cost from place to place over each block of rows."""
    out = np.full((len(sizes), 4, 4), FAR)
    out[:, range(4), range(4)] = 0
    for at in range(int(sizes.max(initial=0)) - 1, -1, -1):
        on = np.flatnonzero(sizes > at)
        row = starts[on] + at
        out[on] = np.minimum(_product(STEP[kinds[row]], out[on]) + DELETE * (counts[row] - 1)[:, None, None], FAR)
    return out


def block_audits(kinds: np.ndarray, counts: np.ndarray, sizes: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """For each block and entry place: cost to the end of the conversation, least audit within the block, exit place."""
    blocks = len(sizes)
    starts = np.cumsum(sizes) - sizes  # first row
    first = starts + np.arange(blocks)  # first position; a block of n rows has n + 1
    value = np.zeros((len(kinds) + blocks, 4), np.int64)
    value[first + sizes] = behind
    for at in range(int(sizes.max(initial=0)) - 1, -1, -1):
        on = np.flatnonzero(sizes > at)
        row, place = starts[on] + at, first[on] + at
        value[place] = _product(STEP[kinds[row]], value[place + 1][:, :, None])[:, :, 0] + DELETE * (counts[row] - 1)[:, None]
    # Arcs: every step that a cheapest edit list can take, one slot per position, place and letter.
    position = np.arange(len(kinds)) + np.repeat(np.arange(blocks), sizes)
    kind, here, after = kinds[:, None], value[position], value[position + 1]
    more = DELETE * (counts - 1)[:, None]
    stays, rows, places = CUT * (kind % 2), np.arange(len(kinds))[:, None], np.arange(4)[None]
    kept = np.where(kind == FORCED, -1, KEPT[np.minimum(kind // 2, 3), places])
    optimal = np.stack([here == after + DELETE + more, here == here[rows, NEXT[places]] + INSERT,
                        (kept >= 0) & (here == after[rows, kept] + stays + more),
                        (kind != FORCED) & (here == after[rows, NEXT[places]] + REROLE + stays + more)], axis=2)
    ends = position[:, None, None] * 4 + np.stack(np.broadcast_arrays(places + 4, NEXT[places], kept + 4, NEXT[places] + 4), axis=2)
    slot = np.flatnonzero(optimal)
    letter = slot % 4
    node = position[slot // 16] * 4 + slot // 4 % 4
    end = ends.reshape(-1)[slot]
    last = len(slot)  # stands for the end of the block: no letter, leads to itself
    letter = np.append(letter, -1)

    def least(rank: np.ndarray) -> np.ndarray:
        """The least-ranked arc out of each node."""
        out = np.full(len(value) * 4, last)
        order = np.lexsort((rank[:last], node))
        head = order[np.flatnonzero(np.diff(node[order], prepend=-1))]
        out[node[head]] = head
        return out

    rank = letter + 1
    leads = [np.append(least(rank)[end], last)]
    length = (letter >= 0).astype(np.int64)
    while (leads[-1] != last).any():
        length = length + length[leads[-1]]
        _, rank = np.unique(rank * (len(letter) + 1) + rank[leads[-1]], return_inverse=True)
        leads.append(leads[-1][leads[-1]])
    entry = least(rank)[(first[:, None] * 4 + np.arange(4)).ravel()]
    sizes_out = length[entry]
    arc = np.repeat(entry, sizes_out)
    step = np.arange(len(arc)) - np.repeat(np.cumsum(sizes_out) - sizes_out, sizes_out)
    for k, lead in enumerate(leads):
        arc = np.where(step >> k & 1, lead[arc], arc)
    text = np.frombuffer(LETTERS, np.uint8)[letter[arc]].tobytes()
    cuts = np.cumsum(sizes_out)
    exits = np.where(sizes_out > 0, end[arc[np.maximum(cuts - 1, 0)]] % 4, 0).reshape(blocks, 4)
    audits = [text[b - n:b] for b, n in zip(cuts.tolist(), sizes_out.tolist())]
    return value[first], audits, exits


def faults(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """Distinct rows with their number and kind, in one global order of conversation, turn, role and text."""
    missing = F.lit(" ")
    plain = rows.select(conv.alias("conv"), F.when(conv.isNull(), "n").otherwise(F.concat(F.lit("k"), conv.cast("string"))).alias("key"),
                        turn.cast("long").alias("turn"), F.coalesce(role, missing).alias("role"), F.coalesce(text, missing).alias("text"))
    distinct = plain.groupBy("key", "conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("late"), F.col("turn"))
    seen = distinct.groupBy("key", "role", "text").agg(F.min(place).alias("seen"))
    shown = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = (F.when(shown == "", 1).when(place != F.col("seen"), 2).when(F.substring(shown, -1, 1).isin(".", "!", "?"), 0).otherwise(3))
    return (distinct.join(seen, ["key", "role", "text"])
            .select("key", "conv", "turn", "role", "text", "n", code.cast("int").alias("code"), fault.cast("int").alias("fault"))
            .repartitionByRange("key", F.asc_nulls_first("turn"), "role", "text").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")
            .withColumn("chunk", F.spark_partition_id()))


def _blocks(size: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in it:
            m = batch.num_rows
            if not m:
                continue
            col = {f: batch.column(f) for f in batch.schema.names}
            keys = col["key"].to_numpy(zero_copy_only=False)
            new = np.append(True, keys[1:] != keys[:-1])
            run_start = np.maximum.accumulate(np.where(new, np.arange(m), 0))
            starts = np.flatnonzero((np.arange(m) - run_start) % size == 0)
            bounds = np.append(starts, m)
            sizes = np.diff(bounds)
            n = col["n"].to_numpy()
            code, fault = col["code"].to_numpy().astype(np.int64), col["fault"].to_numpy()
            kinds = np.where((fault == 1) | (fault == 2), FORCED, 2 * code + (fault == 3))
            totals = [np.add.reduceat(x, starts) for x in ((fault == 1) * n, np.where(fault == 2, n, np.where(fault == 1, 0, n - 1)), (fault == 3) * 1)]
            # Legal neighbours: su, ua, au; a pair that spans two blocks is counted when blocks are read in order.
            pair = np.append((code[:-1] * 4 + code[1:] != 1) & (code[:-1] * 4 + code[1:] != 6) & (code[:-1] * 4 + code[1:] != 9), False)
            pair[bounds[1:] - 1] = False
            illegal = np.add.reduceat(pair + n - 1, starts)
            turns = [[t for t in col["turn"].slice(a, k).to_pylist() if t is not None] for a, k in zip(starts.tolist(), sizes.tolist())]
            matrix = block_matrices(kinds, n, starts, sizes)
            def per_row(values, type_=None, offsets=pa.array(bounds, pa.int32())):
                return pa.ListArray.from_arrays(offsets, values if type_ is None else pa.array(values, type_))

            out = {"key": col["key"].take(pa.array(starts)), "conv": col["conv"].take(pa.array(starts)), "chunk": col["chunk"].take(pa.array(starts)),
                   "idx": pa.array(np.arange(made, made + len(starts))), "kinds": per_row(kinds, pa.int32()), "codes": per_row(code, pa.int32()),
                   "counts": per_row(n, pa.int64()),
                   "roles": per_row(col["role"]), "texts": per_row(col["text"]), "low": pa.array([t[0] if t else None for t in turns], pa.int64()),
                   "high": pa.array([t[-1] if t else None for t in turns], pa.int64()), "different": pa.array([len(set(t)) for t in turns], pa.int64()),
                   "blank": pa.array(totals[0], pa.int64()), "duplicate": pa.array(totals[1], pa.int64()), "truncated": pa.array(totals[2], pa.int64()),
                   "illegal": pa.array(illegal, pa.int64()), "matrix": pa.array(list(matrix.reshape(-1, 16)), pa.list_(pa.int64()))}
            made += len(starts)
            yield pa.RecordBatch.from_arrays([out[k] for k in names], names=names)

    return run


def _behind(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices of each conversation, latest block first, to the costs behind each block."""
    key, costs = None, AT_END
    for batch in it:
        out = []
        for k, m in zip(batch.column("key").to_pylist(), batch.column("matrix").to_pylist()):
            if k != key:
                key, costs = k, AT_END
            out.append(costs)
            costs = (np.array(m).reshape(4, 4) + costs).min(axis=1)
        keep = [n for n in batch.schema.names if n != "matrix"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(out, pa.list_(pa.int64()))], names=[*keep, "behind"])


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _audits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        if batch.num_rows:
            sizes = np.array(batch.column("kinds").value_lengths().to_pylist(), np.int64)
            cost, audits, exits = block_audits(_flat(batch.column("kinds")), _flat(batch.column("counts")), sizes, _flat(batch.column("behind")).reshape(-1, 4))
            audits = [a.decode() for a in audits]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("chunk"), batch.column("idx"), pa.array(cost[:, 0].tolist(), pa.int64()),
                 pa.array([audits[a:a + 4] for a in range(0, len(audits), 4)], pa.list_(pa.string())), pa.array(exits.tolist(), pa.list_(pa.int32()))],
                names=["key", "chunk", "idx", "cost", "audits", "exits"])


class Reader:
    """The blocks of one conversation, in order: its digest, and its repaired messages if ``keep``."""

    def __init__(self, conv, cost: int, keep: bool):
        self.conv, self.cost, self.place, self.last = conv, cost, 0, None
        self.totals, self.illegal, self.low, self.high, self.different = [0, 0, 0], 0, None, None, 0
        self.audit: list[str] = []
        self.hash, self.lines, self.keep = hashlib.sha256(), 0, keep

    def _message(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def _insert(self) -> tuple[str, str, str]:
        self.place = int(NEXT[self.place])
        return "I", "user" if self.place == USER else "assistant", ""

    def block(self, row: dict) -> Iterator[tuple[int, str, str, str]]:
        """Place, edit, role and text of the messages that stay."""
        at = 0
        start = self.place
        for letter in row["audits"][start]:
            if letter == "I":
                made = self._insert()
                self.audit.append("I")
            else:
                more = "D" * (row["counts"][at] - 1)
                self.audit.append(letter + more)
                made = None
                if letter == "R":
                    self.place = int(NEXT[self.place])
                    made = "R", "user" if self.place == USER else "assistant", row["texts"][at]
                elif letter == "K":
                    self.place = int(KEPT[row["codes"][at], self.place])
                    made = "K", row["roles"][at], row["texts"][at]
                at += 1
            if made:
                self._message(*made[1:])
                if self.keep:
                    yield self.lines - 1, *made
        assert self.place == row["exits"][start] and at == len(row["counts"])
        self.totals = [a + row[k] for a, k in zip(self.totals, ("blank", "duplicate", "truncated"))]
        self.illegal += row["illegal"] + (self.last is not None and (self.last, row["codes"][0]) not in ((0, 1), (1, 2), (2, 1)))
        self.last = row["codes"][-1]
        if row["low"] is not None:
            self.different += row["different"] - (self.high == row["low"])
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]

    def close(self) -> Iterator[tuple[int, str, str, str]]:
        while self.place in (1, USER):
            made = self._insert()
            self.audit.append("I")
            self._message(*made[1:])
            if self.keep:
                yield self.lines - 1, *made

    def digest(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.different
        return (self.conv, gaps, *self.totals, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


DIGEST = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _read(keep: bool, names: list[str], schema: pa.Schema):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader, plan, out = None, None, None, []

        def batches(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()

        def closed() -> None:
            rest = [(reader.conv, *m) for m in reader.close()]
            out.extend(rest if keep else [reader.digest()])

        for batch in it:
            for row in (r for a in range(0, batch.num_rows, 64) for r in batch.slice(a, 64).to_pylist()):
                if row["audits"] is not None:  # sorts before the rows of its block
                    plan = row
                    continue
                if row["key"] != key:
                    if reader:
                        closed()
                    key, reader = row["key"], Reader(row["conv"], plan["cost"], keep)
                row |= {"audits": plan["audits"], "exits": plan["exits"]}
                for made in reader.block(row):
                    out.append((reader.conv, *made))
                yield from batches(1000)
        if reader:
            closed()
        yield from batches(1)

    return run


def _plan(rows: DataFrame, conv: str, turn: str, role: str, text: str, block: int) -> DataFrame:
    """Blocks and their audits, each conversation in one task and in order."""
    ship(rows.sparkSession)
    marked = faults(rows, F.col(conv), F.col(turn), F.col(role), F.col(text))
    types = {"key": "string", "conv": marked.schema["conv"].dataType.simpleString(), "chunk": "int", "idx": "long", "kinds": "array<int>", "codes": "array<int>",
             "counts": "array<long>", "roles": "array<string>", "texts": "array<string>", "low": "long", "high": "long", "different": "long", "blank": "long",
             "duplicate": "long", "truncated": "long", "illegal": "long", "matrix": "array<long>"}
    blocks = staged(marked.mapInArrow(_blocks(block, list(types)), ", ".join(f"{k} {t}" for k, t in types.items())), "blocks")
    behind = (blocks.select("key", "chunk", "idx", "kinds", "counts", "matrix").repartition("key").sortWithinPartitions("key", F.desc("chunk"), F.desc("idx"))
              .mapInArrow(_behind, "key string, chunk int, idx long, kinds array<int>, counts array<long>, behind array<long>"))
    audits = behind.repartition("chunk", "idx").mapInArrow(_audits, "key string, chunk int, idx long, cost long, audits array<string>, exits array<int>")
    both = blocks.drop("matrix", "kinds").unionByName(audits, allowMissingColumns=True)
    return both.repartition("key").sortWithinPartitions("key", "chunk", "idx", F.col("audits").isNull())


def digests(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per conversation: gaps, faults, illegal neighbours, cost, audit and hash of the repaired messages."""
    plan = _plan(rows, conv, turn, role, text, block)
    kind = plan.schema["conv"].dataType
    schema = f"`{conv}` {kind.simpleString()}, " + ", ".join(f"{n} {'long' if k < 6 else 'string'}" for k, n in enumerate(DIGEST))
    return plan.mapInArrow(_read(False, DIGEST, _arrow(schema)), schema)


def messages(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The repaired conversations: place (from 0), edit that made it (K, R or I), role and text of every message."""
    plan = _plan(rows, conv, turn, role, text, block)
    schema = f"`{conv}` {plan.schema['conv'].dataType.simpleString()}, place long, edit string, role string, text string"
    return plan.mapInArrow(_read(True, [], _arrow(schema)), schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32 of conv_id:turn: rows dropped, emptied, cut off, repeated or given to the user."""
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id",)], F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(name) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return (rows.where(fault != 0)
            .select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
                    F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                    F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")))


def repaired(conversations: DataFrame) -> DataFrame:
    """Digest of every conversation after ``damage``; one without rows left has zeros and the hash of nothing."""
    found = digests(damage(conversations)).withColumnRenamed("conv_id", "found")
    every = conversations.select("conv_id").distinct()
    nothing = hashlib.sha256().hexdigest()
    values = [F.coalesce(F.col(n), F.lit(0).cast("long") if k < 6 else F.lit("" if n == "audit" else nothing)).alias(n) for k, n in enumerate(DIGEST)]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left").select("conv_id", *values)
