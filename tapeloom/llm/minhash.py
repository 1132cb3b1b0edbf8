"""Near-duplicate groups: MinHash bands, sequential Bayesian pruning, exact confirmation.

1. Texts with equal shingle sets are one class, represented by the smallest id.
2. Representatives that share a band (``rows`` equal minima in a row, ``bands`` bands) meet. First everyone in a bucket is
   compared with the bucket's smallest id only. Components of the confirmed links show which buckets are settled; in the others,
   members outside the bucket's largest component are compared with all members of other components, in blocks of bounded
   size inside tasks. Pairs within a component are never looked at: they cannot change it.
3. A candidate pair is compared one batch of signature values at a time. With a uniform prior, m matches in n values give
   the posterior probability that the similarity reaches the threshold; a pair is dropped as soon as that falls below
   ``miss``. Survivors are confirmed on the shingle sets of their whole texts.

What may be missed: a link whose documents share no band ((1 - t^rows)^bands, below 5e-8 at the threshold of 0.8), or one
pruned wrongly (about ``miss`` for each of the four batches). Nothing is capped or sampled.

Null or blank texts have an empty set and are linked with nothing. Rows of one id are one document (its links add up). Rows
without an id take no part: component null, kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.components import connected
from tapeloom.llm.tables import discard, staged
from tapeloom.runtime import ship, staged_scope

MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Hash of a word, remembered for the first 300,000 words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = value
        return value


_words = _Hashes()


def words_of(text: str) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space."""
    return text.encode().lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; fewer words are one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    total = np.full(n, len(h) if len(h) < size else 0, np.uint64)
    for k in range(min(size, len(h))):
        total = total * MIX + h[k:k + n]
    return np.unique(_mixed(total))


def shingle_set(text: str, size: int) -> set:
    """The shingles themselves."""
    words = words_of(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def similar(a: set, b: set, percent: int) -> bool:
    """Jaccard similarity of ``percent`` or more."""
    shared = len(a & b)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 1 << 63, count, np.uint64)[:, None]


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation over the set (upper 32 bits)."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(low, (hashes[None, at:at + 1024] * a + b).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def fewest_matches(threshold: float, miss: float, sizes: list[int]) -> list[int]:
    """For each number of compared values, the fewest matches that keep a pair.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in sizes:
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                out.append(m)
                break
    return out


def plausible(left: np.ndarray, right: np.ndarray, batch: int, fewest: list[int]) -> np.ndarray:
    """Positions of the pairs of signatures (rows of ``left`` and ``right``) that survive all batches."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for k, least in enumerate(fewest):
        part = slice(k * batch, (k + 1) * batch)
        matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket key of each band of each signature."""
    sig = sig.astype(np.uint64).reshape(-1, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2])
    for k in range(rows):
        key = _mixed(key * MIX + sig[:, :, k])
    return key.astype(np.int64)


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<u4").reshape(len(values), -1)


def _asked(it, width: int, asks: int):
    """(own rows, asking row) for each asking row, from batches sorted by the first ``width`` columns and then by column ``asks``.

    Only a group's own rows, which come first, are held: a block of bounded size; the rows that ask pass by one at a time.
    """
    own, key = [], None
    for batch in it:
        for at in range(0, batch.num_rows, 1024):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                if row[:width] != key:
                    own, key = [], row[:width]
                if row[asks]:
                    yield own, row
                else:
                    own.append(row)


class NearDuplicates:
    """One run over a table; the parameters are those of the module text."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80,
                 bands: int = 32, rows: int = 4, miss: float = 1e-7, batch: int = 32, block_rows: int = 256):
        ship(docs.sparkSession)
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        self.size, self.percent, self.bands, self.rows, self.block_rows = shingle_words, percent, bands, rows, block_rows
        self.batch = batch
        count = bands * rows
        self.fewest = fewest_matches(percent / 100, miss, [min(count, n) for n in range(batch, count + batch, batch)])

    def signatures(self) -> DataFrame:
        """id, n_shingles, print (of the shingle set) and sig of every row."""
        size, count = self.size, self.bands * self.rows

        def run(it):
            a, b = permutations(count)
            for batch in it:
                n, prints, sigs = [], [], []
                for text in batch.column("text"):
                    h = shingle_hashes(text.as_py(), size)
                    n.append(len(h))
                    prints.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                    sigs.append(signature(h, a, b).tobytes() if len(h) else None)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())],
                                                 names=["id", "n_shingles", "print", "sig"])

        return self.docs.mapInArrow(run, "id long, n_shingles long, print binary, sig binary")

    def buckets(self, sigs: DataFrame) -> DataFrame:
        """(key, id) of each band of each representative."""
        bands, rows = self.bands, self.rows

        def run(it):
            for batch in it:
                if not batch.num_rows:
                    continue
                key = band_keys(_matrix(batch.column("sig")), bands, rows)
                ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), bands)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(ids)], names=["key", "id"])

        return sigs.select("id", "sig").mapInArrow(run, "key long, id long")

    def pruned(self, pairs: DataFrame, sigs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose signatures do not rule out a link."""
        batch_size, fewest = self.batch, self.fewest
        side = lambda key, name: sigs.select(F.col("id").alias(key), F.col("sig").alias(name))
        both = pairs.join(side("b", "sig_b"), "b").join(side("a", "sig_a"), "a").select("a", "b", "sig_a", "sig_b")

        def run(it):
            for batch in it:
                if batch.num_rows:
                    keep = pa.array(plausible(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), batch_size, fewest))
                    yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

        return both.mapInArrow(run, "a long, b long")

    def confirmed(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs whose full shingle sets are similar enough."""
        size, percent = self.size, self.percent
        side = lambda key, name: texts.select(F.col("id").alias(key), F.col("text").alias(name))
        both = pairs.join(side("b", "text_b"), "b").join(side("a", "text_a"), "a").select("a", "b", "text_a", "text_b")

        def run(it):
            last, own = None, set()
            for batch in it:
                keep = []
                for i in range(batch.num_rows):
                    text = batch.column("text_a")[i].as_py()
                    if text != last:
                        last, own = text, shingle_set(text, size)
                    other = shingle_set(batch.column("text_b")[i].as_py(), size)
                    if similar(own, other, percent):
                        keep.append(i)
                keep = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])

        return both.mapInArrow(run, "a long, b long")

    def outside_links(self, members: DataFrame, component: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
        """Links across components, in the buckets that hold more than one component.

        Signatures are compared in blocks of a bucket, each pair in the bucket of its first common band. What they leave is noted as
        one row for each asking document and block of a family; then the texts of these blocks meet and are compared in full, up to
        the first link of a row with each component.
        """
        labelled = members.join(component, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        labelled = staged(labelled, "members")
        sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
        # The struct is of two numbers over few rows: one row for each component of a bucket.
        mixed = (sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("kinds"))
                 .where("kinds > 1").select("key", F.col("top.component").alias("main"), F.ceil(F.col("n") / self.block_rows).cast("int").alias("blocks")))
        rows = staged(labelled.join(staged(mixed, "mixed"), "key"), "mixed-members")
        # Documents of one family, whatever their components, lie in the same few blocks: by the main component of their buckets.
        vertices = rows.groupBy("id", "component").agg(F.min("main").alias("home"))
        parts_of = vertices.groupBy("home").agg(F.ceil(F.count("*") / self.block_rows).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
        placed = staged(vertices.join(parts_of, "home").select("id", "component", "home", part), "placed")
        sig = placed.select("id", "home", "part").join(sigs, "id")
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        own = rows.select("key", block.alias("block"), "id", "component", "main", F.lit(False).alias("asks"))
        asking = rows.where("component <> main").select(
            "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "component", "main", F.lit(True).alias("asks"))
        dealt = own.unionByName(asking).join(sig, "id").select("key", "block", "asks", "id", "component", "main", "home", "part", "sig")
        dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", "asks")
        batch_size, fewest, size, percent, bands, width = self.batch, self.fewest, self.size, self.percent, self.bands, self.rows

        def candidates(it):
            """(home, part, asking id, ids there) of each block that an asking row has candidates in."""
            last = None
            for group, row in _asked(it, 2, 2):
                if group is not last:
                    last = group
                    ids, comp, home, part = (np.array([r[k] for r in group], np.int64) for k in (3, 4, 6, 7))
                    sigs = np.frombuffer(b"".join(r[8] for r in group), "<u4").reshape(len(group), -1)
                if not group:
                    continue
                mine = np.frombuffer(row[8], "<u4")
                # Two documents outside the main component both ask; the larger id asks for the pair.
                them = np.flatnonzero((comp != row[4]) & ((comp == row[5]) | (ids < row[3])))
                # A pair that shares several bands is compared in the bucket of the first one.
                first = (sigs[them] == mine).reshape(len(them), bands, width).all(axis=2).argmax(axis=1)
                them = them[band_keys(mine, bands, width)[0][first] == row[0]]
                them = them[plausible(np.broadcast_to(mine, (len(them), len(mine))), sigs[them], batch_size, fewest)]
                where: dict[tuple, list] = {}
                for m in them.tolist():
                    where.setdefault((int(home[m]), int(part[m])), []).append(int(ids[m]))
                for (h, p), who in where.items():
                    yield h, p, row[3], who

        def find(it):
            out = []

            def batch():
                h, p, q, who = zip(*out)
                out.clear()
                return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(p, pa.int32()), pa.array(q, pa.int64()),
                                                   pa.array(who, pa.list_(pa.int64()))], names=["home", "part", "id", "who"])

            for found in candidates(it):
                out.append(found)
                if len(out) == 4096:
                    yield batch()
            if out:
                yield batch()

        found = dealt.mapInArrow(find, "home long, part int, id long, who array<long>")
        # At most the ids of one block a list, each of them once: a pair comes from one band.
        open_ = staged(found.groupBy("home", "part", "id").agg(F.flatten(F.collect_list("who")).alias("who")), "open")
        held = placed.join(open_.select("home", "part").distinct(), ["home", "part"], "left_semi").select(
            "home", "part", "id", "component", F.lit(None).cast("array<long>").alias("who"))
        asked = open_.select("home", "part", "id", F.lit(None).cast("long").alias("component"), "who")
        meet = held.unionByName(asked).join(texts, "id").select("home", "part", F.col("who").isNotNull().alias("asks"), "id", "component", "who", "text")
        meet = meet.repartition("home", "part").sortWithinPartitions("home", "part", "asks")

        def confirm(it):
            last = None
            for group, row in _asked(it, 2, 2):
                if group is not last:
                    last = group
                    texts_of: dict[int, list] = {}
                    comp = {r[3]: r[4] for r in group}
                    for r in group:
                        texts_of.setdefault(r[3], []).append(r[6])  # an id may have several texts
                    sets: dict[int, list] = {}
                mine, linked, links = shingle_set(row[6], size), set(), []
                for m in row[5]:
                    if comp[m] in linked:
                        continue  # one link ties all of a component
                    if m not in sets:
                        sets[m] = [shingle_set(t, size) for t in texts_of[m]]
                    if any(similar(mine, other, percent) for other in sets[m] if mine and other):
                        linked.add(comp[m])
                        links.append((m, row[3]))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])

        return meet.mapInArrow(confirm, "a long, b long")

    def classes(self) -> DataFrame:
        """id, n_shingles, component_id and kept of every row. All tables on the way there are removed."""
        with staged_scope(self.docs.sparkSession) as made:
            out = staged(self._classes(), "near-duplicates")
            made.pop()  # this one stays
        return out

    def _classes(self) -> DataFrame:
        every = staged(self.signatures(), "signatures")
        sets = every.where("id IS NOT NULL AND n_shingles > 0")
        same = staged(sets.groupBy("print").agg(F.min("id").alias("first")), "classes")
        chosen = sets.join(same.select("print", F.col("first").alias("id")), ["print", "id"], "left_semi")
        sigs = staged(chosen.select("id", "sig", "print").dropDuplicates(["id", "print"]).select("id", "sig"), "representatives")
        leaders = staged(self.buckets(sigs).groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader"), "leaders")
        members = staged(self.buckets(sigs).join(leaders, "key"), "members")
        needed = members.select("id").distinct()
        texts = staged(self.docs.join(needed, "id", "left_semi"), "texts")
        stars = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
        links = staged(self.confirmed(staged(self.pruned(stars, sigs), "stars"), texts), "links")
        component = connected(links)
        more = staged(self.outside_links(members.select("key", "id"), component, sigs, texts), "more-links")
        # Texts with equal sets link to their representative; an id with several texts ties their classes together.
        own = every.where("id IS NOT NULL AND n_shingles > 0").join(same, "print").select(F.col("first").alias("a"), F.col("id").alias("b")).where("a <> b")
        final = connected(links.unionByName(more).unionByName(own))
        out = every.select("id", "n_shingles").join(final, "id", "left")
        out = out.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
        discard(texts, leaders, members, sigs)
        return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
