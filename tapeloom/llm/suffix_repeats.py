"""Repeated byte strings across documents: a suffix array over anchored suffixes and its common-prefix intervals.

A repeat of ``length`` bytes or more contains, wherever it occurs, the same anchors: k-grams whose hash is the smallest of
all k-grams in some window of ``length`` bytes. So only suffixes that start at anchors are sorted, and only at anchors
whose k-gram occurs elsewhere too.

1. Anchors of every text; those whose k-gram has more than one occurrence stay.
2. Their suffixes (``length`` bytes), with the bytes before them read backwards, are sorted by k-gram and suffix.
3. A k-gram's suffixes have two orders, by what stands to the right and by what stands to the left, each with the common
   prefixes of neighbours. Neighbours that share p bytes or more form an interval; an occurrence belongs to a repeat if another
   one is in its interval for p bytes to the right and in its interval for ``length`` - p to the left. Intervals are walked from
   long prefixes to short ones and an occurrence is looked at again only where its interval grows, until its longest reach is
   known, first to the right and then to the left. All repeats around a k-gram hold it, so together they are one span.
4. Occurrences of one text whose contexts (``length`` bytes to the right, ``length`` minus a k-gram to the left) are equal are
   one row with further places: a long periodic text has few contexts, however often its k-gram recurs.
5. A k-gram with more than ``group_rows`` such rows is not held in one task: all its windows of ``length`` bytes are
   counted by hash instead, which is exact too.

Texts are identified by a 128-bit hash of their bytes; of exact copies the first by id takes part, and a text with copies repeats
as a whole. Null text counts as empty text. Ids may be null or repeated; other columns are ignored.

:func:`remove_passages` also cuts passages of more than ``words`` whole words, however short: every such passage has at least
2 ``words`` + 1 bytes, so it lies within a repeat of that length, and within those the windows of ``words`` + 1 words are counted.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import discard, staged
from tapeloom.runtime import ship, staged_scope

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Powers:
    """Powers of the hash base and of its inverse, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.full(n, base, np.uint64) for base in (BASE, INVERSE))
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up, self.down


_powers = _Powers()


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k-gram."""
    n = len(data)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: n - k + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, k: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are smallest in some window of ``length`` bytes (all of them where equal)."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data, k)
    width = length - k + 1
    low = sliding(h, width, np.minimum)
    # A k-gram is an anchor if a window around it has no smaller one: the largest minimum of its windows is its own hash.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(sliding(padded, width, np.maximum) == h)
    return at, h[at]


def by_context(data: bytes, at: np.ndarray, grams: np.ndarray, back: int, length: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Indexes of the anchors that stand for all those of equal k-gram and context, and the further places of each."""
    _, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[inverse] > 1)
    if not len(again):
        return np.arange(len(at)), {}
    first: dict[tuple[int, bytes], int] = {}
    more: dict[int, list[int]] = {}
    kept = np.ones(len(at), bool)
    for i, p in zip(again.tolist(), at[again].tolist()):
        head = first.setdefault((min(p, back), data[max(0, p - back):p + length]), i)
        if head != i:
            kept[i] = False
            more.setdefault(head, []).append(p)
    return np.flatnonzero(kept), more


def _whole_grams(it, least: int = 1 << 14) -> Iterator[pa.Table]:
    """Tables of whole k-grams, of ``least`` rows or more, from batches sorted by k-gram."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        grams = batch.column(0).to_numpy()
        cut = int(np.argmax(grams == grams[-1]))  # the last k-gram may go on in the next batch
        whole = cut or held and held[-1].column(0)[-1].as_py() != grams[0]
        if whole and sum(b.num_rows for b in held) + cut >= least:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Strings:
    """Byte strings as rows of one matrix, zeros behind them."""

    def __init__(self, listed: list[bytes]):
        self.listed = listed
        self.sizes = np.fromiter(map(len, listed), np.int32, len(listed))
        self.width = max(8, -(-int(self.sizes.max(initial=0)) // 8) * 8)
        self.bytes = np.zeros((len(listed), self.width), np.uint8)
        for at in range(0, len(listed), 4096):
            flat = np.frombuffer(b"".join(listed[at:at + 4096]), np.uint8)
            self.bytes[at:at + 4096][np.arange(self.width) < self.sizes[at:at + 4096, None]] = flat

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of strings ``i`` and ``j``."""
        words, out = self.bytes.view(np.uint64), np.zeros(len(i), np.int32)
        for at in range(0, len(i), 4096):
            a, b = i[at:at + 4096], j[at:at + 4096]
            differ = words[a] != words[b]
            word = differ.argmax(1)
            place = 8 * word[:, None] + np.arange(8)
            byte = (self.bytes[a[:, None], place] != self.bytes[b[:, None], place]).argmax(1)
            n = np.where(differ[np.arange(len(a)), word], 8 * word + byte, self.width)
            out[at:at + 4096] = np.minimum(n, np.minimum(self.sizes[a], self.sizes[b]))  # the zeros don't count
        return out


class _Sorted:
    """Entries in the order of their strings, k-gram by k-gram, with the common prefixes of neighbours (-1 between k-grams)."""

    def __init__(self, strings: _Strings, group: np.ndarray, order: np.ndarray):
        n = len(order)
        self.order, self.rank = order, np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        same = group[order[1:]] == group[order[:-1]]
        self.near = np.where(same, strings.common(order[:-1], order[1:]), np.int32(-1))
        edges = np.concatenate([[-1], self.near, [-1]]).astype(np.int32)
        self.longest = np.maximum(edges[:-1], edges[1:])[self.rank]

    def intervals(self, prefix: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each entry in which neighbours share ``prefix`` bytes, and the longest shorter prefix at which each interval grows."""
        ends = self.near < prefix
        number = np.zeros(len(self.order), np.int64)
        np.cumsum(ends, out=number[1:])
        edges = np.concatenate([[-1], self.near[ends], [-1]])
        return number[self.rank], np.maximum(edges[:-1], edges[1:])


def farthest(p: _Sorted, q: _Sorted, asked: np.ndarray, length: int) -> np.ndarray:
    """For each asked entry the longest prefix by ``p`` that it shares with another one with which it shares the rest of ``length`` by ``q``; else -1.

    Intervals are walked from long prefixes to short ones. As a prefix gets shorter the rest gets longer, so an entry has to
    be looked at again only where its interval by ``p`` grows. Entries that are not asked have their answer, but others meet them.
    """
    out = np.full(len(asked), -1, np.int32)
    goal = np.where(asked & (p.longest + q.longest >= length), p.longest, np.int32(-1))
    while (prefix := int(goal.max(initial=-1))) >= 0:
        now = np.flatnonzero(goal == prefix)
        interval, grows = p.intervals(prefix)
        touched = np.zeros(len(grows), bool)
        touched[interval[now]] = True
        met = np.flatnonzero(touched[interval] & (q.longest >= length - prefix))
        rest = q.intervals(length - prefix)[0]
        both = interval * len(asked) + rest
        keys = np.sort(both[met])
        hit = np.searchsorted(keys, both[now], "right") - np.searchsorted(keys, both[now]) > 1
        out[now[hit]] = prefix
        goal[now[hit]] = -1
        missed = now[~hit]
        later = grows[interval[missed]]
        goal[missed] = np.where(later + q.longest[missed] >= length, later, -1)
    return out


def reaches(right: _Strings, left: _Strings, group: np.ndarray, several: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry (``right`` sorted within its group, ``left`` read backwards) goes to the left and right in repeats of ``length``; -1 if in none.

    All repeats around a k-gram hold the k-gram, so together they are one run. Entries of ``several`` occurrences repeat whole.
    """
    n = len(group)
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
    order = [i for a, b in zip(edges.tolist(), edges[1:].tolist()) for i in sorted(range(a, b), key=left.listed.__getitem__)]
    by_right, by_left = _Sorted(right, group, np.arange(n)), _Sorted(left, group, np.array(order, np.int64))
    for side, strings in ((by_right, right), (by_left, left)):
        side.longest = np.where(several, strings.sizes, side.longest)
    to_right = farthest(by_right, by_left, ~several, length)
    to_left = farthest(by_left, by_right, to_right >= 0, length)
    return np.where(several, left.sizes, to_left), np.where(several, right.sizes, to_right)


SPAN = "k1 long, k2 long, start long, stop long"
SPAN_NAMES = ["k1", "k2", "start", "stop"]


def _joined_runs(places: list[int], left: int, right: int) -> list[tuple[int, int]]:
    """Runs from ``left`` before to ``right`` after each place, overlapping ones as one."""
    runs: list[tuple[int, int]] = []
    for p in sorted(places):
        if runs and p - left <= runs[-1][1]:
            runs[-1] = (runs[-1][0], p + right)
        else:
            runs.append((p - left, p + right))
    return runs


def repeated_runs(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Spans (k1, k2, start, stop) of the repeats of whole k-grams, from contexts sorted by k-gram, right and left."""
    gram, k1, k2, pos = (table.column(c).to_numpy() for c in ("gram", "k1", "k2", "pos"))
    right, left, more = (table.column(c).to_pylist() for c in ("right", "left", "more"))
    # Equal contexts of a k-gram are one entry.
    head = np.ones(len(gram), bool)
    head[1:] = [g or r != s or l != m for g, r, s, l, m in zip((gram[1:] != gram[:-1]).tolist(), right, right[1:], left, left[1:])]
    first, entry = np.flatnonzero(head), np.cumsum(head) - 1
    further = np.array([m is not None for m in more], bool)
    other = further.copy()
    for one in (k1, k2, pos):
        other |= one != one[first][entry]
    several = np.zeros(len(first), bool)
    several[entry[other]] = True
    group = np.cumsum(np.diff(gram[first], prepend=gram[:1]) != 0)
    to_left, to_right = reaches(_Strings([right[i] for i in first.tolist()]), _Strings([left[i] for i in first.tolist()]), group, several, length)
    a, b = to_left[entry], to_right[entry]
    plain = np.flatnonzero((b >= 0) & ~further)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[plain], k2[plain], pos[plain] - a[plain], pos[plain] + b[plain])], names=SPAN_NAMES)
    rows = [(k1[i], k2[i], *run) for i in np.flatnonzero(further).tolist() for run in _joined_runs([int(pos[i]), *more[i]], int(a[i]), int(b[i]))]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=SPAN_NAMES)


def _merged() -> Column:
    """All rows' spans of a group, sorted and disjoint."""
    return F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "stop"))), F.array().cast("array<struct<start:bigint,stop:bigint>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["stop"] >= s["start"]), F.concat(
            F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.get(done, F.size(done) - 1)["start"].alias("start"),
                                                                 F.greatest(F.get(done, F.size(done) - 1)["stop"], s["stop"]).alias("stop")))))
        .otherwise(F.concat(done, F.array(s))))


class Repeats:
    """One run over a table."""

    def __init__(self, docs: DataFrame, length: int = 400, gram: int = 64, id_col: str = "doc_id", text_col: str = "text", group_rows: int = 250_000):
        if not 0 < gram <= length:
            raise ValueError("gram must be between 1 and length")
        ship(docs.sparkSession)
        self.length, self.gram, self.group_rows = length, gram, group_rows
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.keys = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
        self.docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), text.alias("text"), *self.keys)

    def anchor_rows(self, copies: DataFrame) -> DataFrame:
        """gram, k1, k2, pos and more of every anchor. Rows may still repeat, where rows of equal id and text do: an occurrence is told by its hash."""
        k, length = self.gram, self.length
        # Only classes of several rows are joined, so that neither texts nor anchors need a shuffle to take part once.
        several = staged(copies.where("copies > 1").select("k1", "k2", "first"), "several")
        once = self.docs.join(several, ["k1", "k2"], "left").where("first IS NULL OR id = first")

        def run(it):
            for batch in it:
                texts, k1, k2 = batch.column("text"), batch.column("k1"), batch.column("k2")
                which, grams, places, further = [], [], [], []
                for i, text in enumerate(texts):
                    data = text.as_buffer() or b""
                    at, h = anchors(np.frombuffer(data, np.uint8), k, length)
                    kept, more = by_context(bytes(data), at, h, length - k, length)
                    which.append(np.full(len(kept), i))
                    places.append(at[kept])
                    grams.append(h[kept])
                    further += map(more.get, kept.tolist())
                if which:
                    take = pa.array(np.concatenate(which).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), k1.take(take), k2.take(take),
                                                      pa.array(np.concatenate(places).astype(np.int64)), pa.array(further, pa.list_(pa.int64()))],
                                                     names=["gram", "k1", "k2", "pos", "more"])

        return once.select("text", "k1", "k2").mapInArrow(run, "gram long, k1 long, k2 long, pos long, more array<long>")

    def _joined(self, places: DataFrame, copies: DataFrame) -> DataFrame:
        """One text of each class in ``places`` (k1, k2, lists), found by the smallest id of the class."""
        return self.docs.join(places.join(copies.select("k1", "k2", F.col("first").alias("id")), ["k1", "k2"]), ["k1", "k2", "id"])

    def spans(self, copies: DataFrame) -> DataFrame:
        """(k1, k2, start, stop) of all repeats; spans of one text may overlap."""
        k, length = self.gram, self.length
        every = staged(self.anchor_rows(copies), "anchors")
        occurrence = F.xxhash64("k1", "k2", "pos")
        many = (every.groupBy("gram").agg(F.min(occurrence).alias("a"), F.max(occurrence).alias("b"), F.count("*").alias("n"),
                                           F.max(F.col("more").isNotNull()).alias("within")).where("a <> b OR within")
                .select("gram", (F.col("n") > self.group_rows).alias("crowded")))
        grams = staged(many, "grams")
        again = staged(every.join(grams, "gram"), "repeated")
        discard(every, grams)
        # A text's anchors: bounded by its own length.
        places = again.groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "gram", "more", "crowded")).alias("at"))
        texts = self._joined(places, copies).select("k1", "k2", "text", "at")
        back = length - k

        def contexts(it):
            for batch in it:
                for part in range(0, batch.num_rows, 64):
                    out = []
                    rows = batch.slice(part, 64)
                    for k1, k2, text, at in zip(*(rows.column(c).to_pylist() for c in ("k1", "k2", "text", "at"))):
                        data = text.encode()
                        for a in at:
                            p = a["pos"]
                            out.append((a["gram"], data[p:p + length], data[max(0, p - back):p][::-1], k1, k2, p, a["more"], a["crowded"]))
                    if out:
                        g, r, l, k1, k2, p, m, c = zip(*out)
                        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(r, pa.binary()), pa.array(l, pa.binary()), pa.array(k1, pa.int64()),
                                                          pa.array(k2, pa.int64()), pa.array(p, pa.int64()), pa.array(m, pa.list_(pa.int64())),
                                                          pa.array(c, pa.bool_())], names=["gram", "right", "left", "k1", "k2", "pos", "more", "crowded"])

        made = texts.mapInArrow(contexts, "gram long, right binary, left binary, k1 long, k2 long, pos long, more array<long>, crowded boolean")
        spread = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = (made.where("NOT crowded").drop("crowded").repartition(spread, "gram").sortWithinPartitions("gram", "right", "left"))

        def scan(it):
            for table in _whole_grams(it):
                yield from repeated_runs(table, length)

        found = ordered.mapInArrow(scan, SPAN)
        if not again.where("crowded").isEmpty():
            found = found.unionByName(self._counted(made.where("crowded")))
        return found

    def _counted(self, contexts: DataFrame) -> DataFrame:
        """Spans of crowded k-grams: every window around them, counted by its hash. Windows of contexts with further places repeat anyway."""
        length = self.length

        def windows(it):
            for batch in it:
                for r, l, k1, k2, pos, more in zip(*(batch.column(c).to_pylist() for c in ("right", "left", "k1", "k2", "pos", "more"))):
                    data = np.frombuffer(l[::-1] + r, np.uint8)
                    if len(data) < length:
                        continue
                    h = gram_hashes(data, length).view(np.int64)
                    n = len(h)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array(np.arange(n) + pos - len(l)),
                                                      pa.array(np.full(n, more is not None))], names=["window", "k1", "k2", "start", "within"])

        contexts = staged(contexts, "crowded")
        every = staged(contexts.mapInArrow(windows, "window long, k1 long, k2 long, start long, within boolean"), "windows")
        occurrence = F.xxhash64("k1", "k2", "start")
        twice = (every.groupBy("window").agg(F.min(occurrence).alias("a"), F.max(occurrence).alias("b"), F.max("within").alias("within"))
                 .where("a <> b OR within").select("window"))
        found = every.join(twice, "window").select("k1", "k2", "start", (F.col("start") + length).alias("stop"))
        left, right = F.length("left"), F.length("right")
        within = (contexts.where(F.col("more").isNotNull() & (left + right >= length)).select("k1", "k2", "left", "right", F.explode("more").alias("at"))
                  .select("k1", "k2", (F.col("at") - left).alias("start"), (F.col("at") + right).alias("stop")))
        return found.unionByName(within)

    def covered(self) -> DataFrame:
        """k1, k2, copies (texts of the class) and spans (sorted, disjoint) of every class of equal texts that has any to remove."""
        copies = staged(self.docs.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("id").alias("first")), "copies")
        spans = self.spans(copies)
        # A text's spans: bounded by its own anchors.
        by_text = staged(spans.groupBy("k1", "k2").agg(_merged().alias("spans")), "spans")
        return copies.join(by_text, ["k1", "k2"], "left").where("copies > 1 OR spans IS NOT NULL").select("k1", "k2", "copies", "spans")


def removals(text: bytes, copies: int, spans: list, length: int) -> list[tuple[int, int]]:
    """Maximal removed runs of a text."""
    if copies > 1 and len(text) >= length:
        return [(0, len(text))]
    return [(s["start"], s["stop"]) for s in spans or []]


def _cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join(out) + data[at:]


def _with_runs(docs: DataFrame, length: int, text_col: str, extra: list[str], **options) -> DataFrame:
    run = Repeats(docs, length, text_col=text_col, **options)
    found = staged(run.covered(), "covered")
    keyed = docs.select(*extra, F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *run.keys)
    return keyed.join(found, ["k1", "k2"], "left").select(*extra, "_text", F.coalesce("copies", F.lit(1)).alias("_copies"), "spans")


def _numbered(docs: DataFrame, text_col: str, id_col: str) -> tuple[DataFrame, str, str]:
    """``docs`` with its columns named by number, whatever they are called, and the names of text and id."""
    names = [f"column{i}" for i in range(len(docs.columns))]
    name_of = dict(zip(docs.columns, names))
    return docs.toDF(*names), name_of[text_col], name_of[id_col]


def remove_repeats(docs: DataFrame, length: int = 400, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text_col``; characters that are only partly covered stay. Other columns stay as they are."""
    plain, text, key = _numbered(docs, text_col, id_col)
    rows = _with_runs(plain, length, text, [c for c in plain.columns if c != text], id_col=key, **options)
    return _without(plain, rows, text, lambda data, copies, spans: removals(data, copies, spans, length)).toDF(*docs.columns)


def _without(docs: DataFrame, rows: DataFrame, text_col: str, runs_of) -> DataFrame:
    """``docs`` with the runs of each of ``rows`` cut out, whole characters only."""
    others = [c for c in docs.columns if c != text_col]

    def run(it):
        for batch in it:
            texts = []
            for text, copies, spans in zip(*(batch.column(c).to_pylist() for c in ("_text", "_copies", "spans"))):
                data = text.encode()
                runs = []
                for a, b in runs_of(data, copies, spans):
                    while a < b and data[a] & 0xC0 == 0x80:
                        a += 1
                    while a < b < len(data) and data[b] & 0xC0 == 0x80:
                        b -= 1
                    runs.append((a, b))
                texts.append(_cut(data, runs).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], names=[*others, text_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col) + f", `{text_col}` string"
    return rows.mapInArrow(run, schema).select(*docs.columns)


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space, without punctuation around them (a word of punctuation alone is kept)."""
    starts, ends = [], []
    for m in WORD.finditer(data):
        a, b = m.span()
        word = m[0]
        if inner := word.strip(PUNCTUATION):
            a += len(word) - len(word.lstrip(PUNCTUATION))
            b = a + len(inner)
        starts.append(a)
        ends.append(b)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def _passages(run: Repeats, found: DataFrame, words: int, length: int) -> DataFrame:
    """(k1, k2, start, stop) of all repeated windows of ``words`` + 1 words, and of all repeats of ``length`` bytes.

    ``found``: the repeats of 2 ``words`` + 1 bytes. Both kinds lie within one of its spans, so only those are searched.
    """
    inside = staged(run.docs.join(found.where("spans IS NOT NULL").select("k1", "k2", "spans"), ["k1", "k2"]).select("k1", "k2", "text", "spans")
                    .dropDuplicates(["k1", "k2"]), "inside")

    def windows(it):
        for batch in it:
            for k1, k2, text, spans in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "spans"))):
                data = text.encode()
                starts, ends = word_bounds(data)
                rows = []
                for s in spans:
                    low, high = int(np.searchsorted(starts, s["start"])), int(np.searchsorted(ends, s["stop"], "right"))
                    for a, b in zip(starts[low:high - words].tolist(), ends[low + words:high].tolist()):
                        h = hashlib.blake2b(data[a:b], digest_size=16).digest()
                        rows.append((h, a, b))
                if rows:
                    h, a, b = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(np.full(len(h), k1)), pa.array(np.full(len(h), k2)), pa.array(a, pa.int64()),
                                                      pa.array(b, pa.int64())], names=["window", "k1", "k2", "start", "stop"])

    every = staged(inside.mapInArrow(windows, "window binary, k1 long, k2 long, start long, stop long"), "word-windows")
    occurrence = F.xxhash64("k1", "k2", "start")
    twice = every.groupBy("window").agg(F.min(occurrence).alias("a"), F.max(occurrence).alias("b")).where("a <> b").select("window")
    by_words = every.join(twice, "window").select("k1", "k2", "start", "stop")

    def pieces(it):
        for batch in it:
            rows = []
            for k1, k2, text, spans in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "spans"))):
                data = text.encode()
                for a, b in ((s["start"], s["stop"]) for s in spans if s["stop"] - s["start"] >= length):
                    while data[a] & 0xC0 == 0x80:  # whole characters: strings are at least the span
                        a -= 1
                    while b < len(data) and data[b] & 0xC0 == 0x80:
                        b += 1
                    rows.append((k1, k2, a, data[a:b].decode()))
            if rows:
                k1, k2, at, text = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(at, pa.int64()), pa.array(text, pa.string())],
                                                 names=["t1", "t2", "at", "text"])

    cut = staged(inside.mapInArrow(pieces, "t1 long, t2 long, at long, text string").withColumn("doc_id", F.monotonically_increasing_id()), "pieces")
    long = Repeats(cut, length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("stop")))
    spans = (cut.select("t1", "t2", "at", "text", *long.keys).join(long.covered(), ["k1", "k2"])
             .where((F.col("copies") > 1) | F.col("spans").isNotNull())
             .select("t1", "t2", "at", F.explode(F.when(F.col("copies") > 1, whole).otherwise(F.col("spans"))).alias("s")))
    by_bytes = spans.select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.stop")).alias("stop"))
    return by_words.unionByName(by_bytes)


def remove_passages(docs: DataFrame, words: int = 50, length: int = 400, text_col: str = "text", gram: int = 32, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without repeated strings of ``length`` bytes or more and without repeated passages of more than ``words`` whole words.

    Other columns stay as they are, whatever their names.
    """
    names = docs.columns
    docs, text_col, id_col = _numbered(docs, text_col, id_col)
    shortest = 2 * words + 1
    if length < shortest:
        raise ValueError("length must be at least 2 words + 1")
    run = Repeats(docs, shortest, min(gram, shortest), id_col=id_col, text_col=text_col, **options)
    with staged_scope(docs.sparkSession) as made:  # what the search leaves goes, its two results stay
        found = staged(run.covered(), "covered-short")
        made.pop()
        by_text = staged(_passages(run, found, words, length).groupBy("k1", "k2").agg(_merged().alias("spans")), "passages")
        made.pop()
    runs = found.select("k1", "k2", "copies").join(by_text, ["k1", "k2"], "left")
    others = [c for c in docs.columns if c != text_col]
    keyed = docs.select(*others, F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *run.keys)
    rows = keyed.join(runs, ["k1", "k2"], "left").select(*others, "_text", F.coalesce("copies", F.lit(1)).alias("_copies"), "spans")

    def runs_of(data: bytes, copies: int, spans: list) -> list[tuple[int, int]]:
        if copies > 1 and (len(data) >= length or len(WORD.findall(data)) > words):
            return [(0, len(data))]
        return [(s["start"], s["stop"]) for s in spans or []]

    return _without(docs, rows, text_col, runs_of).toDF(*names)


def digests(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows = _with_runs(docs, length, text_col, [id_col], **options)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(it):
        for batch in it:
            out = []
            for text, copies, spans in zip(*(batch.column(c).to_pylist() for c in ("_text", "_copies", "spans"))):
                data = text.encode()
                runs = removals(data, copies, spans, length)
                kept = _cut(data, runs)
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            if out:
                n, removed, count, sha = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)],
                                                 names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
