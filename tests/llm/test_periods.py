"""Periodic runs against a comparison of all shifts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyweave.llm import periods


def brute(words, least=12):
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(2 * p, least):
                out.setdefault((i, j + p), p)
            i = j
    return sorted((a, b, p) for (a, b), p in out.items())


def found(docs):
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    lengths = np.array([len(docs[i]) for i in order])
    words = [w for k, i in enumerate(order) for w in [*docs[i], 10**6 + k]]
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    out = [[] for _ in docs]
    for a, b, p in zip(*periods.runs_of(np.array(words), lengths), strict=True):
        k = int(np.searchsorted(first, a, side="right")) - 1
        out[order[k]].append((int(a - first[k]), int(b - first[k]), int(p)))
    return [sorted(x) for x in out]


def sequence(rng):
    kind, n, top = rng.randint(0, 6), rng.randint(0, 400), rng.randint(1, 4)
    if kind == 0:
        return [rng.randint(0, top) for _ in range(n)]
    if kind == 1:
        return ([rng.randint(0, top) for _ in range(rng.randint(1, 40))] * 50)[:n]
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    out = []
    root = [rng.randint(0, 2) for _ in range(rng.randint(1, 5))]
    while len(out) < n:
        if kind == 3:
            # stretches of one root that touch out of step, or nearly touch
            turn = rng.randint(0, len(root) - 1)
            out += (root * 100)[turn : turn + rng.randint(1, 90)]
            out += [rng.randint(0, 2) for _ in range(rng.randint(0, 12) if rng.random() < 0.4 else 0)]
        elif kind == 4:
            out += ([0, 1] * 60)[: rng.randint(5, 60)]
        elif kind == 5:
            block = [x for _ in range(3) for x in ([rng.randint(0, 2) for _ in range(rng.randint(1, 3))] * 40)[: rng.randint(1, 40)]]
            out += (block * 5)[: rng.randint(1, len(block) * 4)]
        else:
            out += ([0] * rng.randint(10, 60) + [1]) * rng.randint(1, 6)
    return out[:n]


@pytest.mark.parametrize("seed", range(5))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    for _ in range(12):
        docs = [sequence(rng) for _ in range(12)]
        assert found(docs) == [brute(d) for d in docs]


def test_rows_of_documents(spark):
    rng = random.Random(7)
    words = ["a", "b", "ß", "c.", " "]
    texts = [" ".join(rng.choice(words[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += [None, "", " \t\n", "w\x0bw " * 20, "one two " * 3000]
    rows = [(i, t, "en", 5) for i, t in enumerate(texts)] + [(None, "x " * 30, None, None), (3, texts[3], "en", 5), (-40, "y z " * 9, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, starts string, n_runs int")
    got = periods.run_digest(periods.with_runs(docs, plant=True)).collect()
    expected = []
    for i, t, *_ in rows:
        own = (t or "").encode().split()
        n, h = len(own), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            own = [own[k] if k < a else own[a + (k - a) % p] for k in range(n)]
        if n > 4000:
            # the whole text repeats two words
            runs = [(0, n, 2)] if h % 10 else None
        else:
            runs = brute(own)
        runs = sorted((a, p, b) for a, b, p in runs)
        drop = {k for a, p, b in runs for k in range(a + p, b)}
        best = max(runs, key=lambda r: (r[2] - r[0], -r[0], -r[1]), default=None)
        lines = "".join(f"{a},{b - a},{p}\n" for a, p, b in runs)
        kept = b" ".join(w for k, w in enumerate(own) if k not in drop)
        top = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
        expected.append((i, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, expected))
    assert any(r.n_runs > 1 for r in got)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periods.run_digest(periods.with_runs(docs)).count() == 0
