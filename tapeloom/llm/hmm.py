"""Hidden Markov language model over words, trained and applied across partitions.

Every training word has its own emission probability in every state: the expected count of (word, state), a row of a table
summed by word, smoothed by the word's share of the corpus (c + 0.1) / (N + 0.1 (V + 1)), which weighs as much as the distinct words V (Witten and
Bell) so that rare words seen in one state stay possible in the others; an unknown word has the share of c = 0. Only the way to
the tasks differs: the counts of the at most ``head_words`` most frequent words are broadcast, those of all others are joined to the
texts that hold them. Texts are coded once, in blocks of about ``block_bytes``; words outside the head are dealt by crc32 into buckets of
about ``bucket_words`` words. A block and a bucket that share words exchange one row of packed numbers a pass: expected counts in single
precision to the bucket, which sums them in double, and the sums back.

Baum-Welch: each pass computes expected counts per partition and sums them in one aggregation. Texts are cut into segments; the
transfer matrix of each segment is made for all segments at once, products along a text give the exact forward and
backward vectors at segment borders, and segments then run side by side. Scores use the same scaled forward recursion over
the whole text. The start of training is fitted on at most ``seed_texts`` texts; the passes over all training texts follow.

A text is a training text unless crc32 of its id's digits is divisible by ten. Null text is the end token alone; a null id
counts as the empty string. Rows are independent.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import discard, staged
from tapeloom.runtime import ship

END = b""  # no word is empty
SEGMENT = 64
BLOCK = 1 << 21
BUCKET = 1 << 16
PART = 1 << 17  # tokens that are worked on at once
HEAD_PART = 1 << 12  # words of the head whose counts are summed in one group


def tokens_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, words between ASCII white space, then the end token."""
    return [*(text or "").encode().lower().split(), END]


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


class Model:
    """Start, transition and emission probabilities of the states."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(states: int, share: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        emit = share[None, :] * rng.uniform(0.5, 1.5, (states, len(share)))
        move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @staticmethod
    def of_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
        """Maximum of the expected counts, smoothed towards ``prior`` (word shares of the corpus)."""
        emit = emit + 10.0 * prior[None, :]
        start, move = start + 0.1, move + 0.1
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _segments(texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Symbols by place and row, rows by falling length; how many rows reach each place; rows of each text, its first one, and where a row went."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = -(-sizes // SEGMENT)
    first = np.cumsum(rows) - rows
    out = np.zeros((int(rows.sum()), SEGMENT), np.int32)
    flat = out.ravel()
    for t, at in zip(texts, first * SEGMENT):
        flat[at:at + len(t)] = t
    fill = np.full(len(out), SEGMENT)
    fill[first + rows - 1] = sizes - (rows - 1) * SEGMENT
    order = np.argsort(-fill, kind="stable")
    place = np.empty(len(out), np.int64)
    place[order] = np.arange(len(out))
    return np.ascontiguousarray(out[order].T), (fill[:, None] > np.arange(SEGMENT)).sum(axis=0), rows, first, place


def forward(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
    """Natural log probability of each text, and what :func:`expected` goes on with."""
    seg, live, rows, first, place = _segments(texts)
    k, n = len(model.start), len(place)
    by_symbol = np.ascontiguousarray(model.emit.T)
    emitted = [by_symbol[seg[t, :m]] for t, m in enumerate(live)]
    # Transfer matrix of a segment: move and emit for each of its symbols. A text's first symbol uses the start vector instead.
    head = np.zeros(n, bool)
    head[place[first]] = True
    product = np.where(head[:, None, None], np.eye(k), model.move)
    scale = np.zeros(n)
    for t, m in enumerate(live):
        here = product[:m]
        if t:
            here = (here.reshape(-1, k) @ model.move).reshape(m, k, k)
        here = np.multiply(here, emitted[t][:, None, :], out=product[:m])
        if t % 4 == 3:
            top = here.reshape(m, k * k).max(axis=1)
            here /= top[:, None, None]
            scale[:m] += np.log(top)
    enter = np.empty((n, k))  # forward vector before each segment (for a first one: the start vector)
    logs = np.zeros(len(texts))
    vector = np.tile(model.start, (len(texts), 1))
    for j in range(int(rows.max(initial=0))):
        who = np.flatnonzero(rows > j)
        at = place[first[who] + j]
        enter[at] = vector[who]
        after = np.einsum("ni,nij->nj", vector[who], product[at])
        total = after.sum(axis=1)
        logs[who] += np.log(total) + scale[at]
        vector[who] = after / total[:, None]
    return logs, (seg, live, rows, first, place, emitted, product, enter, head)


def expected(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected start, transition and emission counts of whole texts, and their log probability."""
    logs, (seg, live, rows, first, place, emitted, product, enter, head) = forward(model, texts)
    k, n, width = len(model.start), len(place), model.emit.shape[1]
    ones = np.ones(k)
    beta = np.ones((n, k))  # backward vector after each segment
    back = np.ones((len(texts), k))
    for j in range(int(rows.max(initial=0)) - 1, -1, -1):
        who = np.flatnonzero(rows > j)
        at = place[first[who] + j]
        beta[at] = back[who]
        before = np.einsum("nij,nj->ni", product[at], back[who])
        back[who] = before / before.sum(axis=1, keepdims=True)
    # Forward and backward vectors are right up to a factor, which each place's total takes out.
    alpha, vector = [], enter
    for t, m in enumerate(live):
        moved = vector[:m] @ model.move
        if t == 0:
            moved = np.where(head[:, None], enter, moved)
        vector = moved * emitted[t]
        if t % 4 == 3:
            vector /= (vector @ ones)[:, None]
        alpha.append(vector)
    start, move = np.zeros(k), np.zeros((k, k))
    for t in range(SEGMENT - 1, -1, -1):
        m = live[t]
        after = beta[:m]
        gamma = alpha[t] * after
        gamma /= (gamma @ ones)[:, None]
        out = emitted[t] * after
        earlier = out @ model.move.T
        if t:
            before = alpha[t - 1][:m]
        else:
            start += gamma[head].sum(axis=0)
            before, out, earlier = enter[~head], out[~head], earlier[~head]
        move += (before / ((before * earlier) @ ones)[:, None]).T @ out
        if t:
            if t % 4 == 0:
                earlier /= (earlier @ ones)[:, None]
            beta[:m] = earlier
        alpha[t] = gamma
    symbols = np.concatenate([seg[t, :m] for t, m in enumerate(live)])
    weights = np.concatenate(alpha)
    emit = np.stack([np.bincount(symbols, weights[:, s], width) for s in range(k)])
    return start, model.move * move, emit, float(logs.sum())


def _parts(texts: list[np.ndarray]):
    """Places of texts that are worked on together: at most ``PART`` tokens, or one text."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > PART:
            yield slice(at, i)
            at, held = i, 0
        held += len(t)
    if held:
        yield slice(at, len(texts))


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte of their places, compressed: codes and counts are small."""
    raw = np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, dtype) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not size:
        return np.empty(0, dtype)
    raw = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order, and where each text ends among them (:func:`tokens_of` without the end tokens)."""
    # Copied, as pyarrow's text functions misread some slices.
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.take(pa.array(np.arange(len(texts))))))
    words = lists.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return words.filter(some).cast(pa.binary()), np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[ends]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training texts."""
    def run(it):
        for batch in it:
            texts = batch.column("text").filter(pa.array([not is_held_out(i) for i in batch.column("id").to_pylist()], pa.bool_()))
            for part in _by_bytes(texts, 2 * BLOCK):
                found = pc.value_counts(_words(texts[part])[0])
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([found.field(0), pa.array([END], pa.binary())]),
                                                  pa.concat_arrays([found.field(1), pa.array([len(texts[part])], pa.int64())])], names=["word", "c"])

    return docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _by_bytes(texts: pa.Array, most: int):
    """Places of neighbouring texts of at most ``most`` bytes, or one text."""
    at, held = 0, 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if i > at and held + size > most:
            yield slice(at, i)
            at, held = i, 0
        held += size
    if len(texts) > at:
        yield slice(at, len(texts))


class Emissions:
    """Expected emission counts of the head and totals of all words by state: what gives any word's probabilities with its own counts."""

    def __init__(self, head: np.ndarray, share: np.ndarray, sums: np.ndarray, unit: float, weight: float):
        self.head, self.share, self.sums, self.unit, self.weight = head, share, sums, unit, weight  # head: word, state

    def rows(self, codes: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Probabilities (symbol, state) of head codes, or of tail words (code - head size is a place in ``c`` and ``n``)."""
        size = len(self.head)
        head = codes < size
        out = np.empty((len(codes), len(self.sums)))
        out[head] = self.head[codes[head]] + self.weight * self.share[codes[head], None]
        at = codes[~head] - size
        out[~head] = n[at] + self.weight * self.unit * (c[at, None] + 0.1)
        return out / (self.sums + self.weight)


def _local(start: np.ndarray, move: np.ndarray, emissions: Emissions, codes: list[np.ndarray], c: list[np.ndarray], n: list[np.ndarray]):
    """A model over the words of some texts, the texts in its symbols, and the codes of the symbols (tail words: by text)."""
    size, at, moved = len(emissions.head), 0, []
    for text, tail in zip(codes, c):
        moved.append(np.where(text < size, text, text + at))
        at += len(tail)
    used, inverse = np.unique(np.concatenate(moved), return_inverse=True)
    probabilities = emissions.rows(used, np.concatenate(c), np.concatenate(n))
    texts = np.split(inverse, np.cumsum([len(t) for t in moved])[:-1])
    return Model(start, move, probabilities.T), texts, used


class Block:
    """Texts coded together: codes below the head's size, then places in the block's list of other words, which is ordered by bucket."""

    def __init__(self, batch: pa.RecordBatch, i: int, size: int, states: int):
        value = lambda name: batch.column(name)[i].as_py()
        self.block, self.held_out = value("block"), np.array(value("held_out"), bool)
        self.codes = _unpacked(value("codes"), np.int32)
        self.texts = np.split(self.codes, np.cumsum(value("sizes"))[:-1])
        tail = sorted(value("tail") or [], key=lambda x: x["bucket"])
        self.buckets = [x["bucket"] for x in tail]
        self.places = [_unpacked(x["places"], np.int32) for x in tail]
        join = lambda parts, dtype: np.concatenate([np.empty(0, dtype), *parts])
        self.c = join((_unpacked(x["c"], np.int64) for x in tail), np.int64)
        self.wids = join((np.where(p < 0, -1, (b << 32) + p.astype(np.int64)) for b, p in zip(self.buckets, self.places)), np.int64)
        self.n = np.zeros((len(self.c), states))
        if "counts" in batch.schema.names:
            counts = sorted(value("counts") or [], key=lambda x: x["bucket"])
            self.n[:] = join((_unpacked(x["counts"], np.float32) for x in counts), np.float32).reshape(-1, states)

    def model(self, start: np.ndarray, move: np.ndarray, emissions: Emissions) -> Model:
        return Model(start, move, emissions.rows(np.arange(len(emissions.head) + len(self.c)), self.c, self.n).T)


class Trained:
    """A model with what scoring joins: ``ready`` has the blocks of coded texts, with the counts of their words outside the head."""

    def __init__(self, start, move, emissions: Emissions, head: dict[bytes, int], ready: DataFrame, total: int, distinct: int):
        self.start, self.move, self.emissions, self.head, self.ready, self.total, self.distinct = start, move, emissions, head, ready, total, distinct


def coded(docs: DataFrame, head: dict[bytes, int], counts: DataFrame, buckets: int, block_bytes: int = BLOCK) -> DataFrame:
    """Blocks of texts: ids, draws, held_out, sizes, codes, and by bucket the places and counts of the words outside the head (place -1: unknown)."""
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(head)})
    id_type = docs.schema["id"].dataType.simpleString()
    names = ["ids", "draws", "held_out", "sizes", "codes", "words"]

    def run(it):
        code = sent.value
        size = len(code)
        for batch in it:
            for part in _by_bytes(batch.column("text"), block_bytes):
                ids = batch.column("id")[part]
                words, ends = _words(batch.column("text")[part])
                words = words.dictionary_encode()
                own = [*words.dictionary.to_pylist(), END]
                found = np.fromiter((code.get(w, -1) for w in own), np.int64, len(own))
                new = np.flatnonzero(found < 0)
                bucket = np.fromiter((zlib.crc32(own[i]) % buckets for i in new), np.int64, len(new))
                new, bucket = new[np.argsort(bucket, kind="stable")], np.sort(bucket)
                found[new] = size + np.arange(len(new))
                codes = np.insert(found[words.indices.to_numpy(zero_copy_only=False)], ends, found[-1]).astype(np.int32)
                held, at = np.unique(bucket, return_index=True)
                asked = [{"bucket": b, "words": b" ".join(own[i] for i in some)} for b, some in zip(held.tolist(), np.split(new, at[1:]))]
                values = [ids, batch.column("draw")[part], pa.array([is_held_out(i) for i in ids.to_pylist()], pa.bool_()), pa.array(np.diff(ends, prepend=0) + 1, pa.int64())]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([_packed(codes)], pa.binary()),
                                                  pa.array([asked], pa.list_(pa.struct([("bucket", pa.int64()), ("words", pa.binary())])))], names=names)

    half = docs.select("id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)).alias("draw")).mapInArrow(
        run, f"ids array<{id_type}>, draws array<long>, held_out array<boolean>, sizes array<long>, codes binary, words array<struct<bucket long, words binary>>")
    # Numbered once, in the staged table: rows may repeat.
    half = staged(half.withColumn("block", F.monotonically_increasing_id()), "coded")
    asked = half.select("block", F.explode("words").alias("w")).select("block", "w.bucket", "w.words")

    def look(known: pa.Table, asked: pa.Table) -> pa.Table:
        known = known.sort_by("wid")
        place = {w: i for i, w in enumerate(known.column("word").to_pylist())}
        c = np.append(known.column("c").to_numpy(), 0).astype(np.int64)  # place -1: no count
        found = [np.fromiter((place.get(w, -1) for w in words.split(b" ")), np.int32) for words in asked.column("words").to_pylist()]
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "places": pa.array([_packed(x) for x in found], pa.binary()),
                         "c": pa.array([_packed(c[x]) for x in found], pa.binary())})

    dealt = counts.withColumn("bucket", F.pmod(F.crc32("word"), F.lit(buckets)))
    answers = dealt.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(look, "block long, bucket long, places binary, c binary")
    ready = staged(half.drop("words").join(_listed(answers, "tail"), "block", "left"), "ready")
    discard(half)
    return ready


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """One list for each block: bounded by its own words."""
    return rows.groupBy("block").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "block"))).alias(name))


def _with_counts(ready: DataFrame, table: DataFrame | None) -> DataFrame:
    """``ready`` with the expected counts of its words outside the head."""
    if table is None:
        return ready
    return ready.join(_listed(table.where("bucket >= 0"), "counts"), "block", "left")


def _seed_rows(ready: DataFrame, size: int, bound: int) -> DataFrame:
    """Training texts drawn below ``bound``, each with its own list of words outside the head."""
    id_type = ready.schema["ids"].dataType.elementType.simpleString()

    def run(it):
        for batch in it:
            for i in range(batch.num_rows):
                draws = np.array(batch.column("draws")[i].as_py(), np.int64)
                if not (draws < bound).any():
                    continue
                block, ids = Block(batch, i, size, 1), batch.column("ids")[i].values
                some = np.flatnonzero((draws < bound) & ~block.held_out)
                rows = []
                for at in some:
                    text = block.texts[at]
                    tail, inverse = np.unique(text[text >= size] - size, return_inverse=True)
                    own = text.copy()
                    own[text >= size] = size + inverse
                    rows.append((own.tobytes(), block.c[tail].tobytes(), block.wids[tail].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(draws[some]), ids.take(pa.array(some)), pa.array(np.full(len(some), block.block)), pa.array(some),
                                                  *(pa.array([r[j] for r in rows], pa.binary()) for j in range(3))],
                                                 names=["draw", "id", "block", "place", "codes", "c", "wids"])

    return ready.mapInArrow(run, f"draw long, id {id_type}, block long, place long, codes binary, c binary, wids binary")


def _sums(found: DataFrame, states: int) -> DataFrame:
    """Sums by bucket: of a block's words as one row for the block, of the head and the model (bucket below 0) as one row."""
    def run(part: pa.Table) -> pa.Table:
        bucket, blocks = part.column("bucket")[0].as_py(), part.column("block").to_pylist()
        if bucket < 0:
            total = sum(_unpacked(x, np.float64) for x in part.column("counts").to_pylist())
            return pa.table({"block": [-1], "bucket": [bucket], "counts": pa.array([_packed(total)], pa.binary())})
        places = [_unpacked(x, np.int32) for x in part.column("places").to_pylist()]
        sums = np.zeros((max(p.max() for p in places) + 2, states))  # the last row: unknown words
        for p, x in zip(places, part.column("counts").to_pylist()):
            sums[p] += _unpacked(x, np.float32).reshape(-1, states)  # the places of a block are distinct, but for -1
        sums[-1] = 0
        sums = sums.astype(np.float32)
        return pa.table({"block": blocks, "bucket": [bucket] * len(blocks), "counts": pa.array([_packed(sums[p]) for p in places], pa.binary())})

    return found.groupBy("bucket").applyInArrow(run, "block long, bucket long, counts binary")


def train(docs: DataFrame, states: int = 4, symbols: int | None = None, head_words: int = 65_536, passes: int = 2, seed_texts: int = 400, seed_passes: int = 12,
          block_bytes: int = BLOCK, bucket_words: int = BUCKET) -> Trained:
    """``docs``: id, text. Bounded on the driver: counts of ``head_words`` words (or ``symbols``, if fewer) and ``seed_texts`` texts."""
    head_words = min(head_words, symbols or head_words)
    counts = staged(word_counts(docs), "counts")
    total, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    # Counts in steps of a sixteenth of an octave (a bounded histogram): whole steps from the top, as many as head_words holds.
    # So only rows of the head leave the tasks; all other words follow by the join.
    steps = counts.groupBy(F.floor(F.log2("c") * 16).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    held, least = 0, total + 1
    for r in sorted(steps, key=lambda r: -r["step"]):
        held += r["n"]
        if held > head_words:
            break
        least = r["c"]
    top = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "word").limit(head_words).collect()
    head = {bytes(r["word"]): r["c"] for r in top}
    size = len(head)
    unit = 1 / (total + 0.1 * (distinct + 1))
    share = (np.array(list(head.values()), float) + 0.1) * unit
    # Head words by their rank, all others by bucket and place there, in the order of the staged table.
    tail_words = counts.where(F.col("c") < least).select("word", "c", F.monotonically_increasing_id().alias("wid"))
    ready = coded(docs, head, tail_words, 1 + (distinct - size) // bucket_words, block_bytes)
    discard(counts)
    # About four times the rows that are needed leave the tasks, whatever the number of tasks.
    bound = int(min(1.0, 8 * seed_texts / max(1, docs.count())) * (1 << 40)) + 1
    seed = _seed_rows(ready, size, bound).orderBy("draw", "id", "block", "place").limit(seed_texts).toArrow()
    first = Model.first(states, np.ones(1))
    start, move, sums = first.start, first.move, np.zeros(states)
    emissions, known, tail_counts = Emissions(np.zeros((size, states)), share, sums, unit, 1.0), {}, np.zeros((0, states))
    if seed.num_rows:
        codes, c, wids = ([np.frombuffer(x, kind) for x in seed.column(name).to_pylist()] for name, kind in (("codes", np.int32), ("c", np.int64), ("wids", np.int64)))
        every = np.concatenate(wids)
        known = {w: i for i, w in enumerate(np.unique(every).tolist())}
        index = np.array([known[w] for w in every.tolist()], np.int64)
        tail_counts = np.zeros((len(known), states))
        shake = None
        for _ in range(seed_passes):
            model, texts, used = _local(start, move, emissions, codes, c, np.split(tail_counts[index], np.cumsum([len(x) for x in c])[:-1]))
            if shake is None:  # one and the same word has one factor a state
                rng = np.random.default_rng(5)
                shake = rng.uniform(0.5, 1.5, (size + len(known), states))
                at = used.copy()
                at[used >= size] = size + index[used[used >= size] - size]
                model.emit = model.emit * shake[at].T
            got_start, got_move, got, _ = expected(model, texts)
            start, move = (got_start + 0.1) / (got_start + 0.1).sum(), (got_move + 0.1) / (got_move + 0.1).sum(1, keepdims=True)
            counts_head, tail_counts = np.zeros((size, states)), np.zeros((len(known), states))
            counts_head[used[used < size]] = got.T[used < size]
            np.add.at(tail_counts, index[used[used >= size] - size], got.T[used >= size])
            emissions = Emissions(counts_head, share, got.sum(axis=1), unit, float(np.count_nonzero(counts_head.any(axis=1)) + len(known)))
    spark = docs.sparkSession
    table = None
    for _ in range(passes):
        # The seed texts' counts are the first table; words outside them have none yet.
        seen = (np.array(list(known), np.int64), tail_counts) if table is None else None
        sent = spark.sparkContext.broadcast((start, move, emissions, seen))

        def run(it):
            start, move, emissions, seen = sent.value
            size, sums = len(emissions.head), np.zeros((states + 2, states))
            heads = np.zeros_like(emissions.head)
            row = lambda block, bucket, places, counts: pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int64()), pa.array(bucket, pa.int64()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())],
                names=["block", "bucket", "places", "counts"])
            for batch in it:
                for i in range(batch.num_rows):
                    block = Block(batch, i, size, states)
                    if seen is not None and len(seen[0]):
                        at = np.minimum(np.searchsorted(seen[0], block.wids), len(seen[0]) - 1)
                        block.n = seen[1][at] * (seen[0][at] == block.wids)[:, None]
                    model = block.model(start, move, emissions)
                    counts = np.zeros((size + len(block.c), states))
                    texts = [t for t, out in zip(block.texts, block.held_out) if not out]
                    for part in _parts(texts):
                        got_start, got_move, got, _ = expected(model, texts[part])
                        counts += got.T
                        sums[:-1] += np.vstack([got_start, got_move])
                    sums[-1] += counts.sum(axis=0)
                    heads += counts[:size]
                    cuts = np.cumsum([len(p) for p in block.places])[:-1]
                    each = np.split(counts[size:].astype(np.float32), cuts) if block.places else []
                    yield row([block.block] * len(each), block.buckets, [_packed(p) for p in block.places], [_packed(x) for x in each])
            some = [-1, *(-2 - j for j in range(-(-size // HEAD_PART)))]
            yield row([-1] * len(some), some, [b""] * len(some), [_packed(x) for x in (sums, *(heads[j:j + HEAD_PART] for j in range(0, size, HEAD_PART)))])

        columns = ["block", "held_out", "sizes", "codes", "tail", *(["counts"] if table is not None else [])]
        found = _with_counts(ready, table).select(*columns).mapInArrow(run, "block long, bucket long, places binary, counts binary")
        # Staged before it is dealt by bucket, so that the files of the join are gone by then.
        found = staged(found, "found")
        if table is not None:
            discard(table)
        table = staged(_sums(found, states), "emissions")
        discard(found)
        small = {r["bucket"]: _unpacked(r["counts"], np.float64) for r in table.where("bucket < 0").select("bucket", "counts").collect()}
        extra = small.get(-1, np.zeros((states + 2) * states)).reshape(-1, states)
        heads = np.concatenate([np.zeros(0), *(small[b] for b in sorted(small, reverse=True) if b < -1)]).reshape(-1, states)
        start, move = (extra[0] + 0.1) / (extra[0] + 0.1).sum(), (extra[1:-1] + 0.1) / (extra[1:-1] + 0.1).sum(1, keepdims=True)
        emissions = Emissions(heads if len(heads) else np.zeros((size, states)), share, extra[-1], unit, float(distinct))
        sent.destroy()
    return Trained(start, move, emissions, head, _with_counts(ready, table), total, distinct)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    trained = train(rows, **options)
    total, states = trained.total, len(trained.start)
    base_log = math.log10(total + 0.1 * (trained.distinct + 1))
    sent = spark.sparkContext.broadcast((trained.start, trained.move, trained.emissions, np.array(list(trained.head.values()), float)))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(it):
        start, move, emissions, head = sent.value
        log_of = np.log10(head + 0.1)
        for batch in it:
            for i in range(batch.num_rows):
                block = Block(batch, i, len(head), states)
                model = block.model(start, move, emissions)
                logs = np.concatenate([forward(model, block.texts[part])[0] for part in _parts(block.texts)])
                sizes = np.array([len(t) for t in block.texts])
                first = np.cumsum(sizes) - sizes
                known = np.concatenate([np.ones(len(head), np.int64), block.c > 0])[block.codes]
                base = np.concatenate([log_of, np.log10(block.c + 0.1)])[block.codes]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, pa.array(block.held_out), pa.array(sizes, pa.int64()), pa.array(np.add.reduceat(known, first), pa.int64()),
                     pa.array(np.full(len(sizes), total)), pa.array(np.add.reduceat(base, first) - sizes * base_log, pa.float64()), pa.array(logs / math.log(10))],
                    names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return trained.ready.drop("draws").mapInArrow(
        run, f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
