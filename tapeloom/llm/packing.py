"""Packing of token sequences into as few fixed-size sequences as possible: bin completion.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt by a hash into groups of about ``group_pieces``;
a task packs one group. Best-fit decreasing gives the first incumbent. Branch and bound then fills one sequence at a time:
around the largest piece left it enumerates undominated fillings (a filling is dominated if its parts fit into the places of
another one), least waste first, and gives up a branch whose waste exceeds what a solution with one sequence less could afford.
A node gives its best few fillings first and all others, in ever wider rounds, as the search comes back to it; where it ends by
itself the packing of the group is the best there is. It also ends at the lower bound, after ``nodes_per_bin`` nodes a sequence or
``steps_per_piece`` steps a piece, whichever comes first; the incumbent is always complete, so every piece is packed once.
Packings do not cross groups: against one packing of everything that costs at most about one sequence a group.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import fresh, staged
from tapeloom.llm.word_table import word_table
from tapeloom.runtime import ship

Filling = tuple[int, ...]


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the lengths in each bin."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r: a bin with room r exists
    for x in sorted(lengths, reverse=True):
        fits = rooms >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(x)
        if room - x:
            by_room[room - x].append(k)
            rooms |= 1 << (room - x)
    return bins


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Sequences that any packing needs: pieces over half stand alone, the rest fills what is left (over all small sizes)."""
    count = np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1)
    sizes = np.arange(capacity + 1)
    number, volume = np.cumsum(count), np.cumsum(count * sizes)
    best = -(-int(volume[-1]) // capacity)
    for k in range(0, capacity // 2 + 1):
        alone = int(number[capacity] - number[capacity - k])  # over capacity - k: nothing of k or more fits beside
        middle = int(number[capacity - k] - number[capacity // 2])
        room = middle * capacity - int(volume[capacity - k] - volume[capacity // 2])
        small = int(volume[capacity // 2] - (volume[k - 1] if k else 0))
        best = max(best, alone + middle + max(0, -(-(small - room) // capacity)))
    return best


def dominated(a: Filling, b: Filling) -> bool:
    """True if the parts of ``a`` (falling) go first-fit into the places of ``b``, so that ``a`` is never the better filling."""
    rooms = list(b)
    for x in a:
        for i, room in enumerate(rooms):
            if room >= x:
                rooms[i] = room - x
                break
        else:
            return False
    return True


class Search:
    """Depth-first bin completion over the lengths that are left, within a number of steps."""

    def __init__(self, lengths: list[int], capacity: int, steps: int):
        self.capacity, self.steps = capacity, steps
        self.count = [0] * (capacity + 1)
        for x in lengths:
            self.count[x] += 1
        self.mask = sum(1 << x for x in range(1, capacity + 1) if self.count[x])
        self.left = len(lengths)

    def take(self, parts: Filling, step: int) -> None:
        for x in parts:
            self.count[x] -= step
            self.mask = self.mask | (1 << x) if self.count[x] else self.mask & ~(1 << x)
        self.left -= step * len(parts)

    def _grow(self, parts: Filling, room: int, top: int, width: int, slack: int, found: list[tuple[int, Filling]]) -> bool:
        """Add the fillings that extend ``parts`` and waste at most ``slack``; whether none was left out by ``width`` or for lack of steps."""
        self.steps -= 1
        here = self.mask & ((1 << (min(room, top) + 1)) - 1)
        tried, whole = 0, True
        while here:
            a = here.bit_length() - 1
            here ^= 1 << a
            if parts.count(a) == self.count[a]:
                continue
            if tried == width or self.steps <= 0:
                return False
            tried += 1
            if a == room:  # holds whatever else would go there
                found.append((0, (*parts, a)))
                return whole
            whole &= self._grow((*parts, a), room - a, a, max(1, width // 2) if width < self.capacity else width, slack, found)
        if not tried and room <= slack:
            found.append((room, parts))
        return whole

    def fillings(self, room: int, slack: int) -> Iterator[Filling]:
        """Undominated ways to fill ``room``, least waste first; few at first, then twice as wide, until all have been given."""
        kept: list[Filling] = []
        width = 4
        whole = False
        while not whole and self.steps > 0:
            found: list[tuple[int, Filling]] = []
            whole = self._grow((), room, room, width, slack, found)
            new = sorted(set(found), key=lambda f: (f[0], len(f[1]), f[1]))
            for _, parts in new:
                if parts in kept:
                    continue
                self.steps -= len(kept) // 8
                if not any(dominated(parts, k) for k in kept):
                    kept.append(parts)
                    yield parts
                if self.steps <= 0:
                    return
            width = min(self.capacity, 4 * width)


def complete_bins(lengths: list[int], capacity: int, nodes_per_bin: int = 8, steps_per_piece: int = 48) -> list[list[int]]:
    """The lengths in each bin of the best packing found."""
    best = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    total = sum(lengths)
    nodes = nodes_per_bin * len(best)
    search = Search(lengths, capacity, steps_per_piece * len(lengths) + 10_000)
    bins: list[Filling] = []
    choices: list[tuple[int, Iterator[Filling]]] = []  # the largest piece and the fillings around it, at each depth
    waste = 0
    while len(best) > bound:
        slack = (len(best) - 1) * capacity - total - waste
        if not search.left:
            best = [list(b) for b in bins]
        elif len(choices) == len(bins):
            if nodes <= 0 or search.steps <= 0:
                break
            nodes -= 1
            x = search.mask.bit_length() - 1
            choices.append((x, search.fillings(capacity - x, slack)))
        # The next choice at this depth, or back by one.
        slack = (len(best) - 1) * capacity - total - waste
        while len(choices) > len(bins):
            x, options = choices[-1]
            search.take((x,), 1)
            filling = next(options, None)
            search.take((x,), -1)
            if filling is None:
                choices.pop()
            elif capacity - x - sum(filling) <= slack:
                parts = (x, *filling)
                search.take(parts, 1)
                bins.append(parts)
                waste += capacity - sum(parts)
                break
        else:
            if not bins:
                break
            parts = bins.pop()
            search.take(parts, -1)
            waste -= capacity - sum(parts)
    return best


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", max_words: int = 300_000) -> DataFrame:
    """Pieces of every document: its ids, then id 0, cut every ``capacity`` tokens. Null text counts as empty text."""
    ship(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32"]

    def run(it):
        enc = word_table(path, max_words)
        end = struct.pack("<I", 0)
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, rows = part.column("id"), []
                for k, packed in enumerate(enc.encode(part.column("text").to_pylist())):
                    view = memoryview(packed + end)
                    n = len(view) // 4
                    rows += [(k, p, s, min(capacity, n - s), zlib.crc32(view[4 * s:4 * (s + capacity)])) for p, s in enumerate(range(0, n, capacity))]
                k, p, s, n, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()),
                                                  pa.array(crc, pa.int64())], names=names)

    return kept.mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int, group_pieces: int = 8192, nodes_per_bin: int = 8) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Rows may repeat; each is packed on its own.

    ``pieces`` should be a staged table: its rows get numbers by file position, and groups are drawn from them.
    """
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    group = fresh(pieces, "group")
    dealt = pieces.withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        rows: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(lengths.tolist()):
            rows[x].append(i)
        part = [x for x in lengths.tolist() if x < capacity]
        bins = complete_bins(part, capacity, nodes_per_bin) + [[capacity]] * len(rows[capacity])
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        base = int(pdf[group].iloc[0]) << 32
        for k, b in enumerate(bins):
            at = 0
            for x in b:
                i = rows[x].pop()
                sequence[i], offset[i] = base + k, at
                at += x
        return pdf.drop(columns=group).assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    return dealt.groupBy(group).applyInPandas(one, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                   group_pieces: int = 8192, nodes_per_bin: int = 8) -> DataFrame:
    """Whole texts to packed pieces: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(staged(pieces(docs, path, capacity, id_col, text_col), "pieces"), capacity, group_pieces, nodes_per_bin)
