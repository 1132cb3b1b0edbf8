"""Byte-pair merges as a left-to-right process.

The encoding of a prefix is decided by its *last token* alone: it is the one token t that ends the prefix and is
compatible with the last token of the prefix before t. Two neighbours are compatible when no merge ever crosses their
border, which can be read off the merge ranks (:meth:`Merges.compatible`). Both the counting transducer and the word
trie propagate last tokens this way.

Requires a merge list in training order (every part of a merge is a base symbol or made by an earlier merge) with one
merge for each token; :class:`Merges` checks both when a file is loaded.
"""

from __future__ import annotations

import json


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (fixed rule of that format)."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(plain))
    return [table[b] for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.made: dict[str, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a + b in self.parts or max(self.made.get(a, -1), self.made.get(b, -1)) >= r:
                raise ValueError(f"merge {r} of {path} is not in training order")
            self.rank[a, b] = r
            self.parts[a + b] = (a, b)
            self.made[a + b] = r
        self.longest = max(map(len, self.ids))
        self._left: dict[str, list[tuple[str, int]]] = {}
        self._right: dict[str, list[tuple[str, int]]] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._own: dict[str, bool] = {}

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The symbols that stand at one edge of ``token`` while it is built, each with the rank that replaces it."""
        cache = self._left if side == 0 else self._right
        chain = cache.get(token)
        if chain is None:
            chain, until, at = [], 1 << 60, token
            while True:
                chain.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.made[at], self.parts[at][side]
            cache[token] = chain
        return chain

    def compatible(self, a: str, b: str) -> bool:
        """True if text made of token ``a``, then token ``b`` is encoded as just these two."""
        got = self._fits.get((a, b))
        if got is None:
            got = True
            for x, until_x in self._edge(a, 1):
                for y, until_y in self._edge(b, 0):
                    r = self.rank.get((x, y))
                    # Equal ranks go from left to right: a's own merge comes before one over the border, b's after it.
                    if r is not None and r < until_x and r <= until_y:
                        got = False
                        break
                if not got:
                    break
            self._fits[a, b] = got
        return got

    def reachable(self, token: str) -> bool:
        """True if the text of ``token`` is encoded as that token."""
        got = self._own.get(token)
        if got is None:
            pair = self.parts.get(token)
            got = pair is None or (self.reachable(pair[0]) and self.reachable(pair[1]) and self._joined(*pair))
            self._own[token] = got
        return got

    def _joined(self, a: str, b: str) -> bool:
        """The parts of a merge meet whole: nothing crosses their border before the merge itself."""
        r = self.rank[a, b]
        return not any((q := self.rank.get((x, y))) is not None and q < until_x and q <= until_y and q < r
                       for x, until_x in self._edge(a, 1) for y, until_y in self._edge(b, 0) if (x, y) != (a, b))

    def encode(self, symbols: list[str]) -> list[str]:
        """Merges applied lowest rank first: the plain definition, used by tests."""
        out = list(symbols)
        while len(out) > 1:
            r, i = min((self.rank.get((out[i], out[i + 1]), 1 << 60), i) for i in range(len(out) - 1))
            if r == 1 << 60:
                break
            out[i:i + 2] = [out[i] + out[i + 1]]
        return out


class LastTokens:
    """Prefixes of words as states, merged where they cannot differ later on.

    A state holds the open text (the longest end of the prefix that begins some token) and the last token at each place in
    it where a token may still start. Transitions are computed when first met.
    """

    def __init__(self, merges: Merges, symbols: list[str]):
        self.merges = merges
        end = merges.end
        self.open = {t[:i] for t in merges.ids for i in range(1, len(t) - len(end) + 1 if end and t.endswith(end) else len(t))}
        self.symbols = symbols
        self.clear()

    def clear(self) -> None:
        start = ("", ((0, ""),))
        self.states: list[tuple] = [start]
        self.token: list[str] = [""]
        self.next: list[dict[str, int]] = [{}]
        self.final: list[dict[str, str]] = [{}]
        self.number = {start: 0}

    def _token(self, state: int, symbol: str, end: str) -> tuple[str, str]:
        text, live = self.states[state]
        text += symbol
        m = self.merges
        for place, last in live:
            token = text[place:] + end
            if token in m.ids and m.reachable(token) and (not last or m.compatible(last, token)):
                return text, token
        raise ValueError("the vocabulary lacks a byte symbol")

    def step(self, state: int, symbol: str) -> int:
        """The state after one more symbol."""
        text, token = self._token(state, symbol, "")
        still = [(p, t) for p, t in self.states[state][1] if text[p:] in self.open]
        cut = still[0][0] if still else len(text)
        after = (text[cut:], (*((p - cut, t) for p, t in still), (len(text) - cut, token)))
        k = self.number.get(after)
        if k is None:
            k = self.number[after] = len(self.states)
            self.states.append(after)
            self.token.append(token)
            self.next.append({})
            self.final.append({})
        self.next[state][symbol] = k
        return k

    def close(self, state: int, symbol: str) -> str:
        """The last token of a word that ends with ``symbol``, its end-of-word mark included."""
        token = self.final[state][symbol] = self._token(state, symbol, self.merges.end)[1]
        return token
