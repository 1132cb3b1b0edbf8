"""BPE encoding and decoding by a trie of distinct words.

Texts are normalised (NFC, lower case) and cut at white space; each distinct piece is encoded once. The new words of a batch,
in order, are the leaves of a trie of byte symbols that is walked depth first: every node gets its last-token state from its
parent (:class:`bpe.LastTokens`), so the encoding of a prefix that many words share is computed once. The end-of-word symbol is
a step of its own at the leaf. An encoding is read off backwards: the last token, then the last token of what stands before it.

Word table and states belong to a Python worker. They hold about ``max_words`` entries and start anew beyond that; results do
not depend on it.
"""

from __future__ import annotations

import gc
import hashlib
import re
import struct
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tapeloom.llm.bpe import LastTokens, Merges, byte_symbols
from tapeloom.runtime import ship

SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for str.split, not for the pattern
FOREIGN = re.compile("[^\x00-\u012f\u0131-\u024f]")  # beyond Latin letters that NFC leaves alone


def members(pattern: str, every: str) -> str:
    """Character ranges that the library's regular expressions put into ``pattern``, for use inside brackets."""
    at, out = 0, []
    for piece, _ in pre_tokenizers.Split(Regex(f"{pattern}+"), "isolated").pre_tokenize_str(every):
        if regex_is(pattern, piece[0]):
            out.append(f"{re.escape(piece[0])}-{re.escape(piece[-1])}")
        at += len(piece)
    return "".join(out)


def regex_is(pattern: str, char: str) -> bool:
    return len(pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(char)) == 0


def word_pattern() -> re.Pattern:
    """The word pattern of the vocabulary file, with the character classes of the library's Unicode tables."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    letters, numbers, spaces = (members(p, every) for p in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")


class Encoder:
    """Whole texts to packed ids (little-endian unsigned 32-bit) and decoded text."""

    def __init__(self, path: str, max_words: int = 300_000, texts: bool = True):
        self.merges = Merges(path)
        self.to_symbol = dict(enumerate(byte_symbols()))
        self.walk = LastTokens(self.merges, byte_symbols())
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words = word_pattern()
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.max_words, self.texts = max_words, texts
        self.ids: dict[str, bytes] = {}
        self.tokens: dict[str, str] = {}

    def trim(self) -> None:
        """Start anew once too many words or states are kept."""
        if len(self.ids) > self.max_words:
            self.ids = {}
            self.tokens = {}
        if len(self.walk.states) > self.max_words:
            self.walk.clear()

    def encode_words(self, words: list[str]) -> dict[str, list[str]]:
        """Tokens of distinct words: a depth-first walk over the trie of their byte symbols."""
        walk, end = self.walk, self.merges.end
        follow, final, token_of = walk.next, walk.final, walk.token
        spelled = sorted((w.encode().decode("latin-1").translate(self.to_symbol), w) for w in words)
        out: dict[str, list[str]] = {}
        path, before = [0], ""  # states of the nodes above the current one
        for symbols, word in spelled:
            n, inner = len(symbols), len(symbols) - bool(end)
            depth = 0
            for x, y in zip(symbols[:inner], before[:len(path) - 1]):
                if x != y:
                    break
                depth += 1
            del path[depth + 1:]
            state = path[-1]
            for symbol in symbols[depth:inner]:
                nxt = follow[state].get(symbol)
                state = walk.step(state, symbol) if nxt is None else nxt
                path.append(state)
            at, tokens = n, []
            if end:
                token = final[state].get(symbols[-1]) or walk.close(state, symbols[-1])
                tokens.append(token)
                at -= len(token) - len(end)
            while at:
                token = token_of[path[at]]
                tokens.append(token)
                at -= len(token)
            tokens.reverse()
            out[word] = tokens
            before = symbols
        return out

    def learn(self, pieces: set[str]) -> None:
        """Encode distinct pieces that are not in the tables yet."""
        find, ids = self.words.findall, self.merges.ids
        cut = {p: [p] if p.isascii() and p.isalpha() else find(p) for p in pieces}
        tokens = self.encode_words(list({w for words in cut.values() for w in words}))
        for piece, words in cut.items():
            made = tokens[words[0]] if len(words) == 1 else [t for w in words for t in tokens[w]]
            self.ids[piece] = struct.pack(f"<{len(made)}I", *map(ids.__getitem__, made))
            if self.texts:
                self.tokens[piece] = " ".join(made)

    def normalize(self, text: str) -> list[str]:
        """White-space separated pieces of the normalised text."""
        if text.isascii():
            text = text.lower()
        else:
            text = self._lower(text)
        if SEPARATORS.search(text):
            return [p for p in regex.split(r"\p{White_Space}+", text) if p]
        return text.split()

    def _lower(self, text: str) -> str:
        # Latin letters: Python agrees with the library. Anything else goes through the library's own normaliser.
        return self.normalizer.normalize_str(text) if FOREIGN.search(text) else text.lower()

    def cut(self, texts: list[str]) -> list[list[list[str] | str]]:
        """Each text as parts: pieces, or a special token's string; afterwards all pieces are in the tables."""
        self.trim()
        out, new = [], set()
        for text in texts:
            parts: list = self.special.split(text) if self.special else [text]
            for i in range(0, len(parts), 2):
                parts[i] = self.normalize(parts[i])
                new.update(parts[i])
            out.append(parts)
        self.learn(new.difference(self.ids))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        get, special = self.ids.__getitem__, self.merges.special
        cut = self.cut(texts)
        get = self.ids.__getitem__
        return [b"".join(map(get, parts[0])) if len(parts) == 1 else
                b"".join(struct.pack("<I", special[p]) if i % 2 else b"".join(map(get, p)) for i, p in enumerate(parts)) for parts in cut]

    def encode_decode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Packed ids of each text and what they decode to: without a decoder in the file, tokens are joined with blanks."""
        cut = self.cut(texts)
        ids, tokens, special = self.ids.__getitem__, self.tokens.__getitem__, self.merges.special
        out = []
        for parts in cut:
            packed, words = [], []
            for i, part in enumerate(parts):
                if i % 2:
                    packed.append(struct.pack("<I", special[part]))
                    words.append(part)
                else:
                    packed += map(ids, part)
                    words += map(tokens, part)
            out.append((b"".join(packed), " ".join(words)))
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, max_words: int, texts: bool = True) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    key = (path, max_words, texts)
    if key not in _encoders:
        gc.disable()  # millions of small objects without cycles: the collector would only walk them again and again
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_words: int = 300_000) -> DataFrame:
    """Id, ``ids`` (packed) and ``decoded`` of each row: the operator's real output."""
    return _apply(docs, path, id_col, text_col, max_words, "ids binary, decoded string",
                  lambda ids, text: (ids, text), [pa.binary(), pa.string()])


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", max_words: int = 300_000) -> DataFrame:
    """Id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each row, made where the texts are encoded so that ids need not leave the task.

    Null text counts as empty text; rows are independent; other columns are ignored.
    """
    def digest(ids: bytes, text: str):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _apply(docs, path, id_col, text_col, max_words, "n_tokens long, ids_sha256 string, decoded_sha256 string",
                  digest, [pa.int64(), pa.string(), pa.string()])


def _apply(docs: DataFrame, path: str, id_col: str, text_col: str, max_words: int, columns: str, result, types: list[pa.DataType]) -> DataFrame:
    ship(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()
    names = [id_col] + [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(it):
        enc = encoder(path, max_words)
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [result(*r) for r in enc.encode_decode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    return kept.mapInArrow(run, f"`{id_col}` {id_type}, {columns}")
