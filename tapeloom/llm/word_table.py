"""Whole texts to ids for bulk work: each new piece of a text goes through the tokenizers library once.

A piece is what stands between white space in the normalised text (the pattern of the file never joins characters across white
space). Pieces met before are looked up. A new piece of Latin letters, ASCII digits and marks without apostrophes is cut as the pattern cuts it, so that
a word before a comma is one entry with the word alone; new words go to the library as one text, whose ids are cut at the tokens that end a word. The table has two generations of at most ``max_words`` pieces: when the younger one is
full it becomes the older one, and a piece found there moves back, so that frequent pieces stay. Results do not depend on it.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct

import numpy as np
import regex
from tokenizers import Tokenizer

from tapeloom.llm.trie_bpe import FOREIGN, SEPARATORS

# Where these alone stand in a piece, the pattern cuts it into runs of letters, single digits and runs of marks.
LETTERS, MARKS = "a-z\u00df-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"
SIMPLE = re.compile(f"[{LETTERS}0-9{MARKS}]+").fullmatch
WORDS = re.compile(f"[{LETTERS}]+|[0-9]|[{MARKS}]+").findall


class WordTable:
    def __init__(self, path: str, max_words: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker on each core
        self.normalizer = Tokenizer.from_file(path).normalizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: struct.pack("<I", t["id"]) for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        # Pieces are normalised and hold no special strings of the raw text: the same model without those two steps.
        self.pieces = Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "normalizer": None, "truncation": None, "padding": None}))
        suffix = spec["model"].get("end_of_word_suffix")
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.max_words = max_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        text = self.normalizer.normalize_str(text) if FOREIGN.search(text) else text.lower()
        if SEPARATORS.search(text):
            return [p for p in regex.split(r"\p{White_Space}+", text) if p]
        return text.split()

    def _learn(self, wanted: set[str]) -> None:
        """All of ``wanted`` in the younger generation."""
        missing = wanted.difference(self.young)
        if len(self.young) + len(missing) > self.max_words:
            self.old, self.young = self.young, {}
            missing = wanted
        words, mixed, other = set(), [], []
        for piece in missing:
            known = self.old.get(piece)
            if known is not None:
                self.young[piece] = known
            elif not SIMPLE(piece):
                other.append(piece)
            elif len(cut := WORDS(piece)) == 1:
                words.add(piece)
            else:
                mixed.append((piece, cut))
        for word in {w for _, cut in mixed for w in cut}.difference(self.young, words):
            known = self.old.get(word)
            if known is None:
                words.add(word)
            else:
                self.young[word] = known
        self._encode_words(list(words))
        get = self.young.__getitem__
        for piece, cut in mixed:
            self.young[piece] = b"".join(map(get, cut))
        self._encode_each(other)

    def _encode_words(self, words: list[str]) -> None:
        """Single words of the pattern: the ids of all of them, in order, are cut behind every token that ends a word."""
        if not words:
            return
        ids = np.array(self.pieces.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(words) or stops[-1] != 4 * len(ids):  # a vocabulary that does not mark the ends of words
            self._encode_each(words)
            return
        packed, at = ids.tobytes(), 0
        for word, stop in zip(words, stops):
            self.young[word] = packed[at:stop]
            at = stop

    def _encode_each(self, pieces: list[str]) -> None:
        for piece, made in zip(pieces, self.pieces.encode_batch_fast(pieces, add_special_tokens=False) if pieces else []):
            ids = made.ids
            self.young[piece] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        cut = []
        wanted: set[str] = set()
        for text in texts:
            parts = self.split(text) if self.split else [text]
            parts = [p if i % 2 else self._cut(p) for i, p in enumerate(parts)]
            for pieces in parts[::2]:
                wanted.update(pieces)
            cut.append(parts)
        self._learn(wanted)
        get = self.young.__getitem__
        return [b"".join([self.special[p] if i % 2 else b"".join(map(get, p)) for i, p in enumerate(parts)]) for parts in cut]


_tables: dict[tuple, WordTable] = {}


def word_table(path: str, max_words: int) -> WordTable:
    """The worker's table of a vocabulary file."""
    key = (path, max_words)
    if key not in _tables:
        _tables[key] = WordTable(*key)
        gc.freeze()  # the vocabulary stays for good: the collector need not walk it again
    return _tables[key]
