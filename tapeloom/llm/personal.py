"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF over overlapping windows.

The patterns' spans always stay. The network reads whole texts in stretches: every place from which a span could not be missing (a
digit, an at sign, or ``at`` or ``dot`` in brackets) with ``CONTEXT`` characters on either side, joined where they meet; no kind has a
span without such a place. Windows of ``LENGTH`` characters, half a window apart, cover each stretch. The CRF decodes each window to the chances
of its tags; chances of overlapping windows are averaged, nearer the middle counting more, and one Viterbi path over the whole
stretch settles them. A span of the path counts if its mean chance reaches the threshold, if the written-out forms in it read as an
address, number or card under the patterns' own checks (parts, digits, Luhn), and if it meets the patterns' spans only by holding them whole.

Training, in numpy: windows around labelled spans (what the patterns match, before the checks of numbers) and around such places
without one, at most ``sample`` of each, chosen by the hash of their text among all distinct windows; each labelled window is also taken twice with its span
in another written form (``rewrite``). A quarter is held back; the threshold is the highest one that finds ``recall`` of the held-back
spans, and ``kinds`` has how many of each kind were found, with "clean" for held-back windows without a span that stayed so. Without
labelled spans the patterns stand alone.

Null texts count as empty; texts are read whole; rows are independent, repeated ids and extra columns too.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import staged
from tapeloom.runtime import ship

KINDS = ["email", "ip", "card", "phone"]
# The base patterns. Quantifiers that can give nothing back are possessive, so that long runs are read once.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

PLACE = re.compile(r"[0-9@０-９＠]|[(\[{<]\s{0,3}(?:at|dot)\s{0,3}[)\]}>]", re.IGNORECASE)
CONTEXT, LENGTH = 24, 64
TAGS = 1 + 2 * len(KINDS)  # outside, then beginning and inside of each kind
LEGAL = np.array([[t % 2 == 1 or t == 0 or s in (t, t - 1) for t in range(TAGS)] for s in range(TAGS)])
CLASSES = 131  # ASCII, other letters, other digits, all others


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses from their at signs: the local part is the run before, as far as the last address."""
    low = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and LOCAL.match(text[start - 1]):
            start -= 1
        end = DOMAIN.match(text, at) if start < at else None
        if end:
            yield start, end.end()
        low = end.end() if end else at + 1
        at = text.find("@", low)


def shapes(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Kind, start, end of the patterns' matches, leftmost and non-overlapping in each kind, and whether their numbers pass."""
    yield from (("email", a, b, True) for a, b in _emails(text))
    for m in IP.finditer(text):
        yield "ip", *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        yield "card", *m.span(), 12 <= len(d) <= 19 and luhn(d)
    for m in PHONE.finditer(text):
        yield "phone", *m.span(), 9 <= len(_digits(m[0])) <= 15


def _ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return _ordered(s[:3] for s in shapes(text) if s[3])


_AT = re.compile(r" ?[(\[{<] ?(?:at|@) ?[)\]}>] ?| ?@ ?", re.IGNORECASE)
_DOT = re.compile(r" ?[(\[{<] ?(?:dot|\.) ?[)\]}>] ?", re.IGNORECASE)
_EMAIL = re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)*\.[^\W\d_]{2,}")


def passes(kind: str, text: str) -> bool:
    """Whether a span of the network reads as its kind once written-out forms are undone."""
    plain = unicodedata.normalize("NFKC", text)
    if kind == "email":
        return bool(_EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", plain))))
    if kind == "ip":
        parts = _DOT.sub(".", plain).replace(" . ", ".").split(".")
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    digits = _digits(plain)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[ ./_-]{0,3}[0-9])+", plain)) and 12 <= len(digits) <= 19 and luhn(digits)
    # A number without its plus sign must begin as one in full does: 00, or the area in brackets.
    return bool(re.fullmatch(r"(?:\+|00|\()[0-9][ ()./0-9-]+[0-9]", plain)) and 9 <= len(digits) <= 15


def rewrite(kind: str, span: str, rng: random.Random) -> str:
    """The same span in another written form."""
    if kind == "email":
        local, domain = span.split("@", 1)
        way = rng.randrange(4)
        if way == 0:  # letters beyond ASCII
            return "".join(rng.choice("áéíóúäöüßñçèêà") if c.isalpha() and rng.random() < 0.4 else c for c in local) + "é@" + domain
        sign = [" (at) ", "[at]", " [at] ", "(at)"][rng.randrange(4)]
        dot = [".", " (dot) ", "[dot]", "."][rng.randrange(4)]
        return local + sign + domain.replace(".", dot)
    if kind == "ip":
        return span.replace(".", rng.choice(["[.]", "(.)", " . ", "[dot]"]))
    if kind == "card":
        d, sep = _digits(span), rng.choice([".", "/", "  ", " - ", "_"])
        return sep.join(d[k:k + 4] for k in range(0, len(d), 4))
    d = _digits(span)
    return rng.choice([f"00{d[0]} {d[1:4]} {d[4:7]} {d[7:]}", f"({d[1:4]}) {d[4:7]}-{d[7:]}", f"+{d[0]}/{d[1:4]}/{d[4:7]}/{d[7:]}", f"00{d[0]}.{d[1:4]}.{d[4:]}"])


_classes: dict[int, int] = {}


def encode(text: str) -> np.ndarray:
    """Class of each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wide = np.flatnonzero(codes >= 128)
    if len(wide):
        found, back = np.unique(codes[wide], return_inverse=True)
        if len(_classes) > 100_000:
            _classes.clear()
        for c in found.tolist():
            if c not in _classes:
                _classes[c] = 128 if chr(c).isalpha() else 129 if chr(c).isdigit() else 130
        codes[wide] = np.array([_classes[c] for c in found.tolist()])[back]
    return codes


class Tagger:
    """Bidirectional LSTM over character classes, and a CRF over its tag scores."""

    def __init__(self, embed: int = 10, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.h = hidden

        def draw(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)

        self.p = {"e": rng.normal(0, 0.5, (CLASSES, embed)).astype(np.float32), "x": draw(2, embed, 4 * hidden), "w": draw(2, hidden, 4 * hidden),
                  "b": np.zeros((2, 1, 4 * hidden), np.float32), "o": draw(2 * hidden, TAGS), "z": np.zeros(TAGS, np.float32),
                  "t": np.zeros((TAGS, TAGS), np.float32)}
        self.p["b"][:, :, hidden:2 * hidden] = 1  # forget little at first
        self.threshold = 2.0
        self.kinds: dict[str, tuple[int, int]] = {}

    def _states(self, x: np.ndarray, keep: bool):
        """Hidden states of both directions, time first; with ``keep`` also what the way back needs."""
        n, steps = x.shape
        h = self.h
        both = np.stack([x, x[:, ::-1]])
        table = self.p["e"] @ self.p["x"] + self.p["b"]  # direction, class, gates
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out, kept = np.empty((steps, 2, n, h), np.float32), []
        for t in range(steps):
            z = np.stack([table[0][both[0, :, t]], table[1][both[1, :, t]]]) + state @ self.p["w"]
            z[:, :, :3 * h] *= 0.5
            gate = np.tanh(z)
            gate[:, :, :3 * h] = 0.5 * gate[:, :, :3 * h] + 0.5
            i, f, o, g = (gate[:, :, k * h:(k + 1) * h] for k in range(4))
            before, cell = cell, f * cell + i * g
            top = np.tanh(cell)
            if keep:
                kept.append((state, before, gate, top))
            state = o * top
            out[t] = state
        return both, out, kept

    @staticmethod
    def _joined(out: np.ndarray) -> np.ndarray:
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2).transpose(1, 0, 2)

    def _crf(self, scores: np.ndarray):
        """Tag chances, expected steps between tags and the log of the sum over all paths."""
        n, steps, _ = scores.shape
        scores = scores.astype(float)
        peak = scores.max(axis=2, keepdims=True)
        m = np.exp(scores - peak)
        a = np.where(LEGAL, np.exp(np.clip(self.p["t"].astype(float), -30, 30)), 0)
        forward, scale = np.empty_like(m), np.empty((n, steps))
        now = m[:, 0]
        for t in range(steps):
            if t:
                now = (now @ a) * m[:, t]
            scale[:, t] = now.sum(axis=1)
            now = now / scale[:, t, None]
            forward[:, t] = now
        backward = np.ones_like(m)
        for t in range(steps - 1, 0, -1):
            backward[:, t - 1] = ((m[:, t] * backward[:, t]) @ a.T) / scale[:, t, None]
        steps_expected = a * np.einsum("nts,ntu->su", forward[:, :-1], m[:, 1:] * backward[:, 1:] / scale[:, 1:, None])
        return forward * backward, steps_expected, np.log(scale).sum(axis=1) + peak[:, :, 0].sum(axis=1)

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Chance of every tag at every character of each window."""
        out = []
        for at in range(0, len(x), 1024):
            _, states, _ = self._states(x[at:at + 1024], False)
            out.append(self._crf(self._joined(states) @ self.p["o"] + self.p["z"])[0])
        return np.concatenate(out) if out else np.zeros((0, LENGTH, TAGS))

    def gradients(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of the tags, a window on average, and its gradients."""
        n, steps = x.shape
        h = self.h
        both, out, kept = self._states(x, True)
        top = self._joined(out)
        scores = top @ self.p["o"] + self.p["z"]
        chance, expected, logs = self._crf(scores)
        rows, cols = np.arange(n)[:, None], np.arange(steps)[None]
        gold = scores[rows, cols, tags].sum() + self.p["t"][tags[:, :-1], tags[:, 1:]].sum()
        loss = (logs.sum() - gold) / n
        d = chance
        d[rows, cols, tags] -= 1
        d = (d / n).astype(np.float32)
        np.add.at(expected, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1.0)
        g = {"t": np.where(LEGAL, expected / n, 0).astype(np.float32), "o": np.einsum("nti,ntk->ik", top, d), "z": d.sum(axis=(0, 1))}
        d_top = d @ self.p["o"].T
        into = np.stack([d_top[:, :, :h].transpose(1, 0, 2), d_top[:, ::-1, h:].transpose(1, 0, 2)], axis=1)  # time, direction, window, unit
        g["w"], table = np.zeros_like(self.p["w"]), np.zeros((2, CLASSES, 4 * h), np.float32)
        d_state, d_cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            before_state, before_cell, gate, top_cell = kept[t]
            i, f, o, c = (gate[:, :, k * h:(k + 1) * h] for k in range(4))
            d_state = d_state + into[t]
            d_cell = d_cell + d_state * o * (1 - top_cell**2)
            dz = np.concatenate([d_cell * c * i * (1 - i), d_cell * before_cell * f * (1 - f), d_state * top_cell * o * (1 - o), d_cell * i * (1 - c**2)], axis=2)
            g["w"] += before_state.transpose(0, 2, 1) @ dz
            for k in range(2):
                np.add.at(table[k], both[k, :, t], dz[k])
            d_state = dz @ self.p["w"].transpose(0, 2, 1)
            d_cell = d_cell * f
        g["b"] = table.sum(axis=1, keepdims=True)
        g["x"] = self.p["e"].T @ table
        g["e"] = np.einsum("dcg,deg->ce", table, self.p["x"])
        return float(loss), g

    def fit(self, x: np.ndarray, tags: np.ndarray, steps: int = 450, rate: float = 0.02, batch: int = 48, seed: int = 4) -> list[float]:
        """Adam over shuffled batches, round after round, until ``steps`` are done; the mean loss of each round."""
        rng, losses = np.random.default_rng(seed), []
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        while t < steps:
            order, seen = rng.permutation(len(x)), []
            for at in range(0, min(len(x), (steps - t) * batch), batch):
                pick = order[at:at + batch]
                loss, g = self.gradients(x[pick], tags[pick])
                seen.append(loss)
                size = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
                t += 1
                for k in self.p:
                    step = g[k] * min(1.0, 5 / (size + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * step
                    v[k] = 0.99 * v[k] + 0.01 * step**2
                    self.p[k] = (self.p[k] - rate * (1 - 0.9 * t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
            losses.append(float(np.mean(seen)))
        return losses


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that the network reads."""
    out: list[tuple[int, int]] = []
    for m in PLACE.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def window_starts(start: int, end: int) -> range:
    return range(start, max(start + 1, end - LENGTH // 2), LENGTH // 2)


def _paths(parts: list[np.ndarray]) -> list[np.ndarray]:
    """Legal tag paths with the highest product of chances, one for each array of chances by place."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(parts)
    order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
    wall = np.where(LEGAL, 0.0, -1e9)
    for at in range(0, len(order), 256):
        group = order[at:at + 256]
        most = max(len(parts[k]) for k in group)
        logs = np.full((len(group), most, TAGS), -1e3)
        logs[:, :, 0] = 0
        for row, k in enumerate(group):
            logs[row, :len(parts[k])] = np.log(parts[k] + 1e-9)
        score = logs[:, 0] + np.where(np.arange(TAGS) % 2 == 0, -1e9, 0) * (np.arange(TAGS) > 0)  # a stretch can't begin inside a span
        back = np.zeros((len(group), most, TAGS), np.int8)
        for t in range(1, most):
            step = score[:, :, None] + wall
            back[:, t] = step.argmax(axis=1)
            score = step.max(axis=1) + logs[:, t]
        tag = score.argmax(axis=1)
        path = np.zeros((len(group), most), int)
        for t in range(most - 1, -1, -1):
            path[:, t] = tag
            tag = back[np.arange(len(group)), t, tag]
        for row, k in enumerate(group):
            out[k] = path[row, :len(parts[k])]
    return out


def network_spans(texts: list[str], net: Tagger) -> list[list[tuple[str, int, int, float]]]:
    """Kind, start, end and mean chance of the spans that the network sees in each text, windows reconciled."""
    parts = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
    codes = {i: encode(texts[i]) for i in {p[0] for p in parts}}
    sums = [np.zeros((b - a, TAGS + 1)) for _, a, b in parts]
    weight = np.minimum(np.arange(1, LENGTH + 1), np.arange(LENGTH, 0, -1)).astype(float)[:, None]
    queue = [(k, s) for k, (_, a, b) in enumerate(parts) for s in window_starts(a, b)]
    for at in range(0, len(queue), 4096):
        x = np.full((min(4096, len(queue) - at), LENGTH), 10)
        for row, (k, s) in enumerate(queue[at:at + 4096]):
            own = codes[parts[k][0]][s:s + LENGTH]
            x[row, :len(own)] = own
        for (k, s), chance in zip(queue[at:at + 4096], net.chances(x)):
            _, a, b = parts[k]
            size = min(LENGTH, b - s)
            sums[k][s - a:s - a + size, :TAGS] += chance[:size] * weight[:size]
            sums[k][s - a:s - a + size, TAGS] += weight[:size, 0]
    means = [s[:, :TAGS] / s[:, TAGS:] for s in sums]
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    for (i, a, _), chance, path in zip(parts, means, _paths(means)):
        head = np.flatnonzero(path % 2 == 1)
        for s in head.tolist():
            e = s + 1
            while e < len(path) and path[e] == path[s] + 1:
                e += 1
            found = texts[i][a + s:a + e]
            lead = len(found) - len(found.lstrip(" \n\t,;:"))
            tail = len(found) - len(found.rstrip(" \n\t,;:."))
            if lead + tail < len(found):
                mean = float(chance[np.arange(s, e), path[s:e]].mean())
                out[i].append((KINDS[path[s] // 2], a + s + lead, a + e - tail, mean))
    return out


def _ends_by(covered: list[tuple[int, int]], first: int, end: int) -> bool:
    """Whether the stretches from ``first`` on that begin before ``end`` also end by then."""
    last = bisect(covered, (end,)) - 1
    return last < first or covered[last][1] <= end


def scan(texts: list[str], net: Tagger) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Base spans, and the spans that the network adds, of each text."""
    base = [base_spans(t) for t in texts]
    if net.threshold > 1:
        return [(b, []) for b in base]
    out = []
    for text, own, seen in zip(texts, base, network_spans(texts, net)):
        covered: list[tuple[int, int]] = []  # by base spans, joined where they overlap
        for _, a, b in own:
            if covered and a < covered[-1][1]:
                covered[-1] = covered[-1][0], max(b, covered[-1][1])
            else:
                covered.append((a, b))
        found, added = {(a, b) for _, a, b in own}, []
        for kind, a, b, mean in seen:
            if mean >= net.threshold and (a, b) not in found and passes(kind, text[a:b]):
                at = bisect(covered, (a,))
                if (at == 0 or covered[at - 1][1] <= a) and _ends_by(covered, at, b):
                    added.append((kind, a, b))
        out.append((own, added))
    return out


def _labelled(text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows of a text with the labelled spans in them: kind number, start, end."""
    spans = [(KINDS.index(k), a, b) for k, a, b, good in shapes(text) if good or (k == "card" and 12 <= len(_digits(text[a:b])) <= 19)]
    # Of overlapping shapes (a phone's digits may look like a card) the longest, then the first kind, is the label.
    kept: list[tuple[int, int, int]] = []  # start, end, kind; in order
    for k, a, b in sorted(spans, key=lambda s: (s[1] - s[2], s[0], s[1])):
        at = bisect(kept, (a,))
        if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or b <= kept[at][0]):
            kept.insert(at, (a, b, k))
    out = []
    for low, high in stretches(text):
        for s in window_starts(low, high):
            part = text[s:s + LENGTH]
            at = bisect(kept, (s,))
            if at == 0 or kept[at - 1][1] <= s:  # a window that begins inside a span shows no beginning of it
                out.append((part, [(k, a - s, min(b, s + LENGTH) - s) for a, b, k in kept[at:bisect(kept, (s + len(part),))]]))
    return out


def _example(window: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    x, tags = np.full(LENGTH, 10), np.zeros(LENGTH, int)
    own = encode(window[:LENGTH])
    x[:len(own)] = own
    for k, a, b in spans:
        tags[a:b] = 2 * k + 2
        tags[a:a + 1] = 2 * k + 1
    return x, tags[:LENGTH]


def _other_form(window: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]] | None:
    """A window with its spans in other written forms; None where one is cut off."""
    out, made, at = "", [], 0
    for k, a, b in spans:
        if b == LENGTH:
            return None
        new = rewrite(KINDS[k], window[a:b], rng)
        out += window[at:a]
        made.append((k, len(out), len(out) + len(new)))
        out += new
        at = b
    out += window[at:]
    return (out, made) if made and made[-1][2] <= LENGTH else None


def train(docs: DataFrame, text_col: str = "text", sample: int = 1200, recall: float = 0.95, hidden: int = 20, steps: int = 450) -> Tagger:
    """A tagger fitted on at most ``sample`` windows with and ``sample`` without labelled spans."""
    ship(docs.sparkSession)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                found = {(w, ",".join(f"{k}:{a}:{b}" for k, a, b in s)) for t in batch.column(0).slice(at, 512).to_pylist() for w, s in _labelled(t)}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], names=["w", "s"])

    texts = docs.select(F.col(text_col).alias("t")).where("t IS NOT NULL")
    every = staged(texts.mapInArrow(cut, "w string, s string").distinct().withColumn("place", F.xxhash64("w")), "windows")
    by_label = [every.where(c).orderBy("place", "w", "s").limit(sample) for c in ("s <> ''", "s = ''")]
    rows = by_label[0].unionByName(by_label[1]).collect()
    net = Tagger(hidden=hidden)
    parsed = [(r["w"], [tuple(map(int, p.split(":"))) for p in r["s"].split(",")] if r["s"] else [], r["place"] % 4 == 0) for r in sorted(rows)]
    rng = random.Random(5)
    fitted, held = [], []
    for window, spans, back in parsed:
        forms = [(window, spans), *(other for _ in range(2 if spans else 0) if (other := _other_form(window, spans, rng)))]
        (held if back else fitted).extend(forms)
    if not any(s for _, s in fitted) or not any(s for _, s in held):
        return net
    x, tags = (np.stack(a) for a in zip(*(_example(w, s) for w, s in fitted)))
    net.fit(x, tags, steps)
    best, clean = [], []
    for (window, spans), seen in zip(held, network_spans([w for w, _ in held], net)):
        whole = [(KINDS[k], a, b) for k, a, b in spans if b < len(window) and a > 0 and b < LENGTH]
        best += [(kind, max([p for k, x, y, p in seen if (k, x, y) == (kind, a, b)], default=-1.0)) for kind, a, b in whole]
        if not spans:
            clean.append(max([p for k, a, b, p in seen if passes(k, window[a:b])], default=-1.0))
    ranked = sorted((p for _, p in best), reverse=True)
    if ranked:
        net.threshold = max(0.0, ranked[min(len(ranked) - 1, int(np.ceil(recall * len(ranked))) - 1)])
    for kind in KINDS:
        own = [p for k, p in best if k == kind]
        net.kinds[kind] = (sum(p >= net.threshold for p in own), len(own))
    net.kinds["clean"] = (sum(p < net.threshold for p in clean), len(clean))
    return net


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digests(docs: DataFrame, net: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, counts and hash of the base spans, all spans, and n_network of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_network"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = []
                for base, added in scan(part.column("text").to_pylist(), net):
                    out.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(),
                                joined(_ordered({*base, *added})), len(added)))
                cols = [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *cols], names=names)

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, "
                                "base_sha256 string, spans string, n_network long")


def redact(docs: DataFrame, net: Tagger, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (null texts stay null); overlapping spans give the first one's mark."""
    ship(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                texts = part.column(text_col).to_pylist()
                for i, (base, added) in enumerate(scan([t or "" for t in texts], net)):
                    at, out = 0, []
                    for kind, a, b in _ordered({*base, *added}):
                        if a >= at:
                            out += [texts[i][at:a], f"[{kind.upper()}]"]
                        at = max(at, b)
                    if out:
                        texts[i] = "".join(out) + texts[i][at:]
                k = part.schema.get_field_index(text_col)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == k else c for j, c in enumerate(part.columns)], names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)
