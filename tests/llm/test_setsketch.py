"""SetSketch registers and near-duplicate components against all pairs."""

import random

import numpy as np
import pytest

from tallyweave.llm import setsketch


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words)} if len(words) == 1 else set(zip(words, words[1:], strict=False))


def components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, row in enumerate(rows):
        ids.setdefault(find(i), []).append(row[0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(str((row[0], len(sets[i]), low[find(i)], row[0] == low[find(i)])) for i, row in enumerate(rows))


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    return " ".join(words)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(4)
    shape = setsketch.Shape(bands=128)
    for n, common in ((900, 800), (300, 100), (5000, 4500), (40, 0)):
        pool = np.unique(rng.integers(-(2**63), 2**63 - 1, 2 * n, dtype=np.int64))[: 2 * n - common]
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(pool[n - common :])
        x, y, both = setsketch.sketches([a, b, np.union1d(a, b)], shape)
        assert (setsketch.merged(x, y) == both).all()
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sizes = np.array([float(len(a))]), np.array([float(len(b))])
        assert setsketch.estimated(x[None], y[None], *sizes)[0] == pytest.approx(truth, abs=0.08)
        assert setsketch.likely(x[None], y[None], *sizes)[0] or truth < 0.8
    assert not setsketch.sketches([np.zeros(0, np.int64)]).any()


@pytest.mark.parametrize(("block", "rows"), [(setsketch.BLOCK, setsketch.BROADCAST_ROWS), (8, 0)])
def test_components_are_those_of_all_pairs(spark, block, rows, monkeypatch):
    monkeypatch.setattr(setsketch, "BROADCAST_ROWS", rows)
    rng = random.Random(9)
    seed = [f"w{rng.randrange(400)}" for _ in range(90)]
    texts = [edited(rng, seed, rng.randint(0, 12)) for _ in range(150)]
    for _ in range(40):
        own = [f"u{rng.randrange(5000)}" for _ in range(rng.randint(1, 120))]
        texts += [edited(rng, own, rng.randint(0, 1 + len(own) // 12)) for _ in range(rng.randint(1, 4))]
    texts += ["Same TEXT here"] * 30 + ["same text HERE", None, None, "", " \n", "one", "ONE", "one two", "Ä b", "ä b", "x " * 5000]
    table = [(i * 3 - 50, t, "en", 1) for i, t in enumerate(texts)] + [(None, texts[0], "", 0), (None, "alone without id", "", 0), (7, texts[5], "", 0)]
    rng.shuffle(table)
    docs = spark.createDataFrame(table, "doc_id long, text string, digest string, rid int").repartition(3)
    got = setsketch.near_components(docs, block=block).collect()
    assert [f for f in got[0].asDict()] == ["doc_id", "n_shingles", "component_id", "kept"]
    plain = []
    for r in got:
        plain.append(str((r.doc_id, r.n_shingles, r.component_id, r.kept)))
    assert sorted(plain) == _with_kept(components(table))


def _with_kept(rows):
    return sorted(r.replace("None, False)", "None, True)") if r.startswith("(None") and "None, False" in r else r for r in rows)


def test_no_documents_and_no_words(spark):
    schema = "doc_id long, text string"
    assert setsketch.near_components(spark.createDataFrame([], schema)).count() == 0
    got = setsketch.near_components(spark.createDataFrame([(1, None), (2, "")], schema)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (2, 2, True)]
