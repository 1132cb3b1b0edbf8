"""Personal data: base spans against plain expressions, the tagger against finite differences, held-out and planted written forms."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tapeloom.llm import personal, queries

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            check = sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and check, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(PLAIN).index(s[0])))


def test_base_spans():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "@", ".", "1", "25", "256", "0", "+", " ", "-", "(", "é", "4111111111111111", "a.b@c.d", "\n", "9"]) for _ in range(rng.randint(0, 30)))
        assert personal.base_spans(text) == brute(text), text


def test_long_runs_are_read_once():
    start = time.monotonic()
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" * 150_000, "a@" * 150_000, "a@b.c " * 20_000, "+1 " + "(" * 300_000):
        personal.base_spans(text)
        personal._labelled(text)
    assert time.monotonic() - start < 60


def test_gradients():
    rng = np.random.default_rng(0)
    net = personal.Tagger(4, 3)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    net.p["t"] = rng.normal(size=net.p["t"].shape) * 0.3
    x, tags = rng.integers(0, personal.CLASSES, (3, 12)), np.zeros((3, 12), int)
    tags[0, 3:6], tags[1, 5:9] = [1, 2, 2], [3, 4, 4, 4]
    _, g = net.gradients(x, tags)
    for name, value in net.p.items():
        flat, at = value.reshape(-1), int(np.abs(g[name]).argmax())
        old = flat[at]
        ends = []
        for step in (1e-3, -1e-3):
            flat[at] = old + step
            ends.append(net.gradients(x, tags)[0])
        flat[at] = old
        assert np.isclose((ends[0] - ends[1]) / 2e-3, g[name].reshape(-1)[at], rtol=1e-3)


def test_chances_sum_over_all_paths():
    rng = np.random.default_rng(2)
    net = personal.Tagger(4, 3)
    net.p["t"] = rng.normal(size=net.p["t"].shape)
    scores = rng.normal(size=(1, 4, personal.TAGS))
    chance, _, logs = net._crf(scores.copy())
    paths = [p for p in product(range(personal.TAGS), repeat=4) if all(personal.LEGAL[a, b] for a, b in zip(p, p[1:]))]
    weight = np.exp([sum(scores[0, t, s] for t, s in enumerate(p)) + sum(net.p["t"][a, b] for a, b in zip(p, p[1:])) for p in paths])
    assert np.isclose(np.log(weight.sum()), logs[0])
    for t in range(4):
        want = np.bincount([p[t] for p in paths], weight, personal.TAGS) / weight.sum()
        assert np.allclose(chance[0, t], want)


def test_paths_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(20):
        p = rng.dirichlet(np.ones(personal.TAGS), size=4)
        legal = [s for s in product(range(personal.TAGS), repeat=4) if (s[0] % 2 == 1 or s[0] == 0) and all(personal.LEGAL[a, b] for a, b in zip(s, s[1:]))]
        best = max(legal, key=lambda s: sum(np.log(p[t, k] + 1e-9) for t, k in enumerate(s)))
        assert tuple(personal._paths([p, p[:2]])[0]) == best


@pytest.fixture(scope="module")
def net(spark):
    return personal.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = queries.op13_personal_data(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = brute(texts[r["doc_id"]])
        counts = Counter(s[0] for s in base)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [counts[k] for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(",")) | {""}


def test_held_out_and_planted(net, spark):
    """Spans written in ways that no pattern matches are found; like-looking text without personal data is left alone."""
    assert all(found >= 0.8 * n for found, n in net.kinds.values()), net.kinds
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r["text"] and not personal.PLACE.search(r["text"])][:60]
    rng, found, planted = random.Random(7), Counter(), Counter()
    for n, text in enumerate(docs * 4):
        kind = personal.KINDS[n % 4]
        d = [rng.randrange(10) for _ in range(15)]
        card = next("".join(map(str, d + [k])) for k in range(10) if personal.luhn("".join(map(str, d + [k]))))
        value = {"email": f"ana.{rng.randrange(99)}@mail{n % 9}.example.com", "ip": ".".join(str(rng.randrange(1, 256)) for _ in range(4)), "card": card,
                 "phone": f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"}[kind]
        other = personal.rewrite(kind, value, rng)
        at = text.find(" ", min(len(text) // 2, rng.randrange(2000))) + 1
        whole = f"{text[:at]} {other} {text[at:]}"
        planted[kind] += 1
        (base, added), = personal.scan([whole], net)
        assert base == brute(whole)
        found[kind] += any(k == kind and whole[a:b] == other for k, a, b in [*base, *added])
    assert all(found[k] >= 0.75 * planted[k] for k in planted), (found, planted)
    clean = ["Section 4.0 of version 3.12, see 10/11/2024 and 2.718281828.", "id 4952935900253051 and 98079157628", "a @ b", "(at) the (dot)", "token = \"b44e15e09fd311c3cf31\"",
             "1.2.3.4.5.6.7", "300.400.500.600", *docs]
    for text, (base, added) in zip(clean, personal.scan(clean, net)):
        assert base == brute(text) and added == [], (text, added)


def test_edges(spark, net):
    long = "x y " * 50_000 + "a.b@c.de" + " 1" * 3000
    rows = [(1, None, "k"), (1, None, "k"), (2, "", "k"), (None, "a@b.c", None), (3, long, "k"), (4, "😀 +1 (017) 555-7713 ퟿", "k"), (5, "4111 1111 1111 1111" * 400, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(2)
    got = sorted(personal.digests(df, net).collect(), key=lambda r: str(r["doc_id"]))
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["spans"] == by_id[2]["spans"] == "" and by_id[None]["spans"] == "email:0:5"
    assert by_id[3]["n_email"] == 1 and by_id[4]["n_phone"] == 1 and by_id[4]["spans"] == "phone:2:19"
    out = personal.redact(df, net)
    assert out.schema == df.schema
    marked = {r["doc_id"]: r["text"] for r in out.collect()}
    assert marked[1] is None and marked[2] == "" and marked[None] == "[EMAIL]" and marked[4] == "😀 [PHONE] ퟿" and "c.de" not in marked[3]
    assert personal.digests(df.limit(0), net).count() == personal.redact(df.limit(0), net).count() == 0
    bare = personal.train(df.limit(0))
    assert bare.threshold > 1 and personal.digests(df, bare).where("n_network > 0").count() == 0


def test_windows_overlap():
    """Whatever its place against the windows, an address of up to half a window is read whole by one of them."""
    for start in range(0, 300):
        text = "w " * (start // 2) + "z" * (start % 2) + " 123456789012 " + "v " * 40
        for a, b in personal.stretches(text):
            covered = np.zeros(len(text), int)
            for s in personal.window_starts(a, b):
                covered[s:s + personal.LENGTH] += 1
            assert covered[a:b].all()
