"""Bin completion: optimal on small sets, bounded work on large ones; the word table against the tokenizers library."""

from __future__ import annotations

import random
import struct
import time
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

from tapeloom.llm import packing
from tapeloom.llm.word_table import WordTable

WORD = public_tokenizers.path("word_bpe_49k.json")


def optimum(lengths, capacity):
    """Fewest bins, by trying every subset as the next bin."""
    n = len(lengths)
    weight = [0] * (1 << n)
    for s in range(1, 1 << n):
        weight[s] = weight[s & (s - 1)] + lengths[(s & -s).bit_length() - 1]

    @lru_cache(None)
    def bins(left):
        if not left:
            return 0
        first = left & -left
        rest = left ^ first
        best, sub = n, rest
        while True:
            if weight[sub | first] <= capacity:
                best = min(best, 1 + bins(rest ^ sub))
            if not sub:
                return best
            sub = (sub - 1) & rest

    return bins((1 << n) - 1)


def test_small_sets_are_optimal():
    rng = random.Random(1)
    beaten = 0
    for k in range(150):
        capacity = rng.choice([10, 30, 100])
        sizes = [rng.randint(1 if k % 2 else capacity // 5, max(2, capacity // (1 + k % 3))) for _ in range(rng.randint(0, 10))]
        bins = packing.complete_bins(sizes, capacity)
        assert sorted(x for b in bins for x in b) == sorted(sizes) and all(sum(b) <= capacity for b in bins)
        assert len(bins) == optimum(tuple(sizes), capacity)
        beaten += len(bins) < len(packing.best_fit(sizes, capacity))
    assert beaten > 0


def test_dominated_is_sound():
    """Whenever one filling counts as dominated its parts do fit, part by part, into the places of the other."""
    rng = random.Random(2)
    for _ in range(500):
        a, b = (tuple(sorted((rng.randint(1, 9) for _ in range(rng.randint(0, 4))), reverse=True)) for _ in range(2))
        if packing.dominated(a, b):
            assert sum(a) <= sum(b) and (not a or a[0] <= max(b))
    assert packing.dominated((3, 2, 2), (7,)) and not packing.dominated((4,), (3, 3))


def test_work_is_bounded():
    for seed in range(50):
        rng = random.Random(seed)
        sizes = [rng.randint(60, 500) for _ in range(200)]
        start = time.monotonic()
        bins = packing.complete_bins(sizes, 2048)
        assert time.monotonic() - start < 1
        assert packing.lower_bound(sizes, 2048) <= len(bins) <= len(packing.best_fit(sizes, 2048))


def test_word_table():
    tok = Tokenizer.from_file(WORD)
    rng = random.Random(3)
    parts = ["it's", "Ị̇ß", "K", "<|endoftext|>", "<|EndOfText|>", "<|endof", "text|>", "\x1c", "\x85", " ", "中文", "ﬁ", "a" * 50, "x,y;", "12345", "é", "é", "\n", "  ", "😀", "Ω"]
    texts = ["", " ", *("".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 12))) for _ in range(400))]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (300_000, 5):
        table = WordTable(WORD, most)
        got = [p for a in range(0, len(texts), 7) for p in table.encode(texts[a:a + 7])]
        assert [list(struct.unpack(f"<{len(p) // 4}I", p)) for p in got] == want


def test_words_before_marks_are_learned_once():
    tok = Tokenizer.from_file(WORD)
    words = ["house", "größe", "naïveté", "x", "über", "don't", "42", "ﬁne", "größe"]
    rng = random.Random(4)
    texts = [" ".join(rng.choice("([-\"#") * rng.randint(0, 2) + rng.choice(words) + rng.choice(["", ",", ".)", "...", "-a1b", "'s", "7,5%"]) for _ in range(60)) for _ in range(60)]
    want = [struct.pack(f"<{len(i)}I", *i) for i in (tok.encode(t, add_special_tokens=False).ids for t in texts)]
    table = WordTable(WORD, 300_000)
    sent: list[str] = []
    encode = table.pieces
    table.pieces = type("Seen", (), {"encode_batch_fast": lambda _, some, **o: sent.extend(x for s in some for x in s.split()) or encode.encode_batch_fast(some, **o)})()
    assert [p for a in range(0, 60, 7) for p in table.encode(texts[a:a + 7])] == want
    assert sent.count("house") == 1 and not any(w.startswith("house,") for w in sent)
    plain = WordTable(WORD, 300_000)
    plain.ends[:] = False  # as for a vocabulary that does not mark the ends of words
    assert plain.encode(texts) == want


def test_clashing_columns(spark):
    rows = [(k, k % 5, 0, 100 + k, 7, "x", "y") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, group string, _group string")
    out = packing.pack(df, 2048, group_pieces=16)
    assert out.columns == [*df.columns, "sequence_id", "offset"] and out.select(*df.columns).exceptAll(df).count() == 0
