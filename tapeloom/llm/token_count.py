"""Token counts by finite-state transducers, without making the tokens.

Two deterministic machines are compiled from a byte-level BPE file:

* the *splitter*, over character classes: where the pre-tokens of the pattern start. A text is cut into equal chunks,
  each chunk becomes a map from entry state to exit state, and a parallel prefix scan composes the maps; every chunk is
  then replayed from its true entry state. Decisions that wait for the next character mark the previous one.
* the *counter*, over bytes: each transition carries the change of the token count. Its state holds what later bytes
  may still depend on: the open text that begins some token and the last token at each place in it (see :mod:`bpe`).
  Transitions are compiled when first met and kept by the Python worker. A pre-token start resets the machine, so
  chunks that are cut at such starts have constant maps and their counts simply add up.

Whole texts are read. Strings of special tokens count as one token each, as the tokenizers library does by default.
Null text counts as empty text, ids may be null or repeated (rows are independent), other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.bpe import Merges, byte_symbols
from tapeloom.runtime import ship

CLASSES = ["letter", "c1", "r", "e", "v", "l", "number", "apostrophe", "other", "blank", "space", "end"]
LETTER, C1, R, E, V, L, NUMBER, APOSTROPHE, OTHER, BLANK, SPACE, END = range(12)
LETTERS = (LETTER, C1, R, E, V, L)
START, WORD, DIGITS, SIGNS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, BLANK_1, SPACE_1, BLANK_N, SPACE_N = range(12)
HERE, BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks (``HERE``: a pre-token starts at this character, ``BEFORE``: at the one before), by class and state."""
    to, mark = np.zeros((12, 12), np.int8), np.zeros((12, 12), np.int8)

    def fresh(c: int) -> int:
        """State after the first character of a match."""
        if c in LETTERS:
            return WORD
        return {NUMBER: DIGITS, APOSTROPHE: QUOTE, OTHER: SIGNS, BLANK: BLANK_1, SPACE: SPACE_1, END: START}[c]

    def runs(s: int, c: int) -> int | None:
        """State if ``c`` goes on with the run of state ``s``."""
        if s == WORD and c in LETTERS or s == DIGITS and c == NUMBER or s == SIGNS and c in (OTHER, APOSTROPHE):
            return s
        return None

    for c in range(12):
        for s in range(12):
            nxt, m = fresh(c), HERE
            if c == END:
                m = BEFORE if s in (QUOTE_R, QUOTE_V, QUOTE_L) else 0
            elif runs(s, c) is not None:
                nxt, m = s, 0
            elif s == QUOTE:
                if c in (OTHER, APOSTROPHE):
                    nxt, m = SIGNS, 0
                elif c == C1:
                    nxt, m = START, 0
                elif c in (R, V, L):
                    nxt, m = {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
            elif s in (QUOTE_R, QUOTE_V, QUOTE_L):
                if c == (L if s == QUOTE_L else E):
                    nxt, m = START, 0
                elif c in LETTERS:
                    nxt, m = WORD, BEFORE
                else:
                    m = BEFORE | HERE
            elif s in (BLANK_1, SPACE_1, BLANK_N, SPACE_N):
                many = s in (BLANK_N, SPACE_N)
                if c in (BLANK, SPACE):
                    nxt, m = (BLANK_N if c == BLANK else SPACE_N), 0
                elif s in (BLANK_1, BLANK_N):
                    nxt, m = (SIGNS if c == APOSTROPHE else fresh(c)), BEFORE if many else 0
                else:
                    m = HERE | (BEFORE if many else 0)
            to[c, s], mark[c, s] = nxt, m
    return to, mark


def classes() -> np.ndarray:
    """Class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            at = np.frombuffer(m[0].encode("utf-32-le"), np.uint32)
            table[at] = kind
    table[ord(" ")], table[ord("'")] = BLANK, APOSTROPHE
    for ch in "stmd":
        table[ord(ch)] = C1
    for ch, kind in (("r", R), ("e", E), ("v", V), ("l", L)):
        table[ord(ch)] = kind
    return table


def split_marks(kinds: np.ndarray, to: np.ndarray, mark: np.ndarray, chunk: int) -> np.ndarray:
    """True where a pre-token starts. ``kinds``: classes of all characters, each text ended by ``END``."""
    n = len(kinds)
    lanes = max(1, -(-n // chunk))
    padded = np.full(lanes * chunk, END, np.uint8)
    padded[:n] = kinds
    steps = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
    flat_to, flat_mark = to.ravel().astype(np.int16), mark.ravel()
    maps = np.tile(np.arange(12, dtype=np.int16), (lanes, 1))
    for kind in steps:
        maps = flat_to[maps + (kind.astype(np.int16) * 12)[:, None]]
    gap = 1
    while gap < lanes:  # inclusive prefix scan: afterwards map k goes from the first chunk's entry to chunk k's exit
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].astype(np.int64), axis=1)
        gap *= 2
    state = np.full(lanes, START, np.int16)
    state[1:] = maps[:-1, START]
    marks = np.empty((chunk, lanes), np.int8)
    for i, kind in enumerate(steps):
        at = kind.astype(np.int16) * 12 + state
        marks[i] = flat_mark[at]
        state = flat_to[at]
    marks = np.ascontiguousarray(marks.T).ravel()[:n]
    starts = (marks & HERE) > 0
    starts[:-1] |= (marks[1:] & BEFORE) > 0
    return starts


class Counter:
    """Lazily compiled byte transducer: packed transitions ``(next state << 8) | (count change + 128)``, -1 where not compiled."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.symbols = byte_symbols()
        self.open = {t[:i] for t in merges.ids for i in range(1, len(t))}
        self.reset()

    def reset(self) -> None:
        self.column = np.full(256, -1, np.int16)
        self.bytes: list[int] = []
        self.states: list[tuple] = [("", ((0, None, 0),))]
        self.number = {self.states[0]: 0}
        self.table = np.full((1 << 14, 96), -1, np.int32)

    def columns(self, data: np.ndarray) -> np.ndarray:
        """Table columns of the bytes; new byte values get new columns."""
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.column[b] < 0:
                self.column[b] = len(self.bytes)
                self.bytes.append(int(b))
        if len(self.bytes) > self.table.shape[1]:
            wider = np.full((self.table.shape[0], 256), -1, np.int32)
            wider[:, : self.table.shape[1]] = self.table
            self.table = wider
        return self.column[data]

    def compile(self, state: int, column: int) -> None:
        text, live = self.states[state]
        text += self.symbols[self.bytes[column]]
        m = self.merges
        for place, last, count in live:
            token = text[place:]
            if token in m.ids and m.reachable(token) and (last is None or m.compatible(last, token)):
                break
        change = count + 1
        still = [(p, t, c - change) for p, t, c in live if text[p:] in self.open]
        cut = still[0][0] if still else len(text)
        after = (text[cut:], (*((p - cut, t, c) for p, t, c in still), (len(text) - cut, token, 0)))
        k = self.number.get(after)
        if k is None:
            k = self.number[after] = len(self.states)
            self.states.append(after)
            if k >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        self.table[state, column] = (k << 8) | (change + 128)

    def changes(self, data: np.ndarray, starts: np.ndarray, chunk: int) -> np.ndarray:
        """Change of the token count at each byte. ``starts``: where pre-tokens start, the first byte included."""
        out = np.zeros(len(data), np.int16)
        if not len(data):
            return out
        cols = self.columns(data)
        heads = np.flatnonzero(starts)
        begin = np.unique(heads[np.searchsorted(heads, np.arange(0, heads[-1] + 1, chunk))])
        length = np.diff(begin, append=len(data))
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # lanes longer than t
        state = np.zeros(len(begin), np.int32)
        for t, a in enumerate(active):
            at = begin[:a] + t
            now = np.where(starts[at], 0, state[:a])
            col = cols[at]
            packed = self.table[now, col]
            new = np.flatnonzero(packed < 0)
            if len(new):
                for key in np.unique(now[new].astype(np.int64) * 256 + col[new]):
                    self.compile(int(key) >> 8, int(key) & 255)
                packed = self.table[now, col]
            state[:a] = packed >> 8
            out[at] = (packed & 255) - 128
        return out


class TokenCounter:
    """Counts of many texts at once."""

    def __init__(self, path: str, chunk: int = 128, max_states: int = 200_000):
        self.merges = Merges(path)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True))) or r"(?!)")
        self.to, self.mark = splitter()
        self.kinds = classes()
        self.counter = Counter(self.merges)
        self.chunk, self.max_states = chunk, max_states

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. The compiled states are dropped when they have grown past ``max_states``; counts stay the same."""
        if len(self.counter.states) > self.max_states:
            self.counter.reset()
        parts: list[str] = []
        owner: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            cut = self.special.split(text)
            counts[i] += len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        kinds = np.full(len(points) + len(parts), END, np.uint8)
        real = np.ones(len(kinds), bool)
        real[ends + np.arange(len(parts))] = False
        kinds[real] = self.kinds[points]
        starts = split_marks(kinds, self.to, self.mark, self.chunk)[real]
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(width)])
        data = np.frombuffer(joined.encode(), np.uint8)
        byte_starts = np.zeros(len(data), bool)
        byte_starts[offset[:-1][starts]] = True
        total = np.concatenate([[0], np.cumsum(self.counter.changes(data, byte_starts, self.chunk), dtype=np.int64)])
        edge = offset[np.concatenate([[0], ends])]
        np.add.at(counts, owner, total[edge[1:]] - total[edge[:-1]])
        return counts


_counters: dict[tuple, TokenCounter] = {}


def batches(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` characters in all; a longer text comes alone."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= most:
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
                 batch_chars: int = 2_000_000, max_states: int = 200_000) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    No shuffle; memory is bounded by ``batch_chars``, the longest text and ``max_states`` compiled states.
    """
    ship(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()

    def run(it):
        key = (path, max_states)
        if key not in _counters:
            gc.disable()  # many small objects without cycles: the collector would only walk them again and again
            _counters[key] = TokenCounter(path, max_states=max_states)
        counter = _counters[key]
        for batch in it:
            texts = batch.column("text").to_pylist()
            n = np.zeros(len(texts), np.int64)
            for a, b in batches(texts, batch_chars):
                n[a:b] = counter(texts[a:b])
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array(n), pa.array(n > limit)],
                                             names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return kept.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
