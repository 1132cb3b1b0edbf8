"""Conversation repair against a memoised search over all edit lists."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tapeloom.llm import queries, repair

WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row, row] if k == 3 else [row]
    return out


def solve(messages):
    """Cost, audit and lines of the cheapest edits; ``messages``: (initial, must go, truncated, role, text)."""

    @lru_cache(None)
    def best(i, place, inserts):
        """place: what may follow, as the role initials so far (s, u, a or nothing)."""
        out = [(0, "", ())] if i == len(messages) and place in ("", "a") else []
        want = "a" if place == "u" else "u"
        name = {"u": "user", "a": "assistant"}[want]

        def add(cost, letter, line, rest):
            if rest:
                out.append((cost + rest[0], letter + rest[1], line + rest[2]))
        if inserts < 2:
            add(3, "I", (name + ":",), best(i, want, inserts + 1))
        if i < len(messages):
            initial, gone, cut, role, text = messages[i]
            add(4, "D", (), best(i + 1, place, 0))
            if not gone:
                add(3 + 3 * cut, "R", (f"{name}:{text}",), best(i + 1, want, 0))
                if initial == want or (initial == "s" and place == ""):
                    add(3 * cut, "K", (f"{role}:{text}",), best(i + 1, initial, 0))
        return min(out, default=None)

    return best(0, "", 0)


def brute(rows, damage=damaged):
    out = {}
    held = {}
    for r in damage(rows):
        held.setdefault(r[0], []).append(tuple(" " if v is None and k > 1 else v for k, v in enumerate(r)))
    for conv in {r[0] for r in rows}:
        own = sorted(held.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, counts, messages = set(), [0, 0, 0], []
        for _, _, role, text in own:
            shown = WORD.findall(text)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            messages.append((role[:1], fault in (0, 1), fault == 2, role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(messages, messages[1:]))
        cost, audit, lines = solve(tuple(messages))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_dict(df):
    rows = df.collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_table(spark, sf_dir):
    for folder in (sf_dir, "/root/testdata/sf0.01"):
        df = spark.read.parquet(f"{folder}/conversations.parquet")
        assert as_dict(queries.op11_conversation_repair(spark, folder)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def random_rows(seed, convs):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "Ä"]
    texts = ["ok.", "no", "", " \n\t", None, "yes!  ", "what?\x0b", ". x", " ", "long " * 300 + "."]
    rows = []
    for conv in convs:
        for _ in range(rng.randint(0, 9)):
            rows.append((conv, rng.choice([None, *range(-2, 12)]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_edges(spark, block):
    rows = random_rows(block, [None, *range(60)]) + [(900, 5, "user", "same.")] * 40 + [(901, t, "user", "same.") for t in range(30)]
    rows += [(902, t, "user" if t % 2 == 0 else "assistant", f"m{t % 7}.") for t in range(70)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, n int")
    want = brute(rows, list)
    assert as_dict(repair.digests(df, block=block)) == want
    lines = {}
    for r in sorted(repair.messages(df, block=block).collect(), key=lambda r: (str(r["conv_id"]), r["place"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: v[-1] for c, v in want.items() if c in lines}
    assert all(v[-1] == hashlib.sha256().hexdigest() for c, v in want.items() if c not in lines)
    if block == 256:
        assert as_dict(repair.repaired(df)) == brute(rows)
        assert as_dict(repair.repaired(df.where("conv_id < 3"))) == brute([r for r in rows if r[0] is not None and r[0] < 3])
        assert repair.repaired(df.limit(0)).count() == repair.messages(df.limit(0)).count() == 0


def test_one_large_conversation(spark):
    """A third of all rows in one conversation: its blocks, not the conversation, are the unit of work."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", "c!", f"t{t}.", f"u{t}", ""])) for t in range(3000)] + random_rows(9, range(2, 500))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    small = as_dict(repair.digests(df, block=16))
    assert small == as_dict(repair.digests(df, block=1000))
    assert small[1][6].count("K") + small[1][6].count("D") + small[1][6].count("R") == 3000
