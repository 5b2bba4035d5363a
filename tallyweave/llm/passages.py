"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

Every passage of a whole text is encoded from its bytes; gated attention (Ilse and others,
2018) weighs the passages, and the weighted mean of their codes is scored. Encoder, attention
and scorer are trained together in numpy from document labels, on a bounded number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.tables import chunks, labelled_sample

PASSAGE_BYTES = 512
#: Labelled documents of each class that training may read.
FIT_DOCS = 3000
FIT_ROUNDS = 1500
FIT_BATCH = 128
CODE = 16
ATTENTION = 12
CUT = 0.3
#: Values that the 8-byte strings of a passage are hashed to, to see how many differ.
_STRINGS = 256
_MARKS = b"#*$%&|<>!?.,;:'\"()-_/@="


def _classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, line break, beyond ASCII, each mark, other."""
    out = np.full(256, 6 + len(_MARKS), np.int64)
    out[97:123], out[65:91], out[48:58], out[32], out[10], out[128:] = 0, 1, 2, 3, 4, 5
    for i, mark in enumerate(_MARKS):
        out[mark] = 6 + i
    return out


_CLASS = _classes()
N_CLASSES = int(_CLASS.max()) + 1
N_FEATURES = N_CLASSES + 3


def passages_of(texts: list[str], size: int = PASSAGE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the number of the text of each. An empty text has one empty passage."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([max(1, -(-len(d) // size)) for d in data])
    owner = np.repeat(np.arange(len(texts)), counts)
    flat = np.frombuffer(b"".join(d.ljust(n * size, b"\0") for d, n in zip(data, counts.tolist(), strict=True)), np.uint8)
    rows = flat.reshape(-1, size)
    real = np.maximum((rows != 0).sum(axis=1), 1)
    at = np.arange(len(rows))[:, None]
    kinds = np.where(rows == 0, N_CLASSES, _CLASS[rows])
    share = np.bincount((at * (N_CLASSES + 1) + kinds).ravel(), minlength=len(rows) * (N_CLASSES + 1))
    share = share.reshape(len(rows), -1)[:, :N_CLASSES] / real[:, None]
    strings = np.lib.stride_tricks.sliding_window_view(rows, 8, axis=1)[:, ::1]
    with np.errstate(over="ignore"):
        key = np.ascontiguousarray(strings).view(np.uint64)[..., 0] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)
    seen = np.zeros((len(rows), _STRINGS), bool)
    seen[at, key.astype(np.int64)] = True
    expected = _STRINGS * (1 - np.exp(-np.maximum(real - 7, 1) / _STRINGS))
    differing = seen.sum(axis=1) / expected
    spaces = share[:, 3] + share[:, 4]
    more = np.stack([differing, np.log1p(real) / np.log1p(size), 1 / (1 + 20 * spaces)], axis=1)
    return np.concatenate([np.sqrt(share) * 3, more], axis=1).astype(np.float32), owner


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``passages_of`` any number of texts, worked on by the chunk: only the features of all are held together."""
    parts, before = [], 0
    for part in chunks(texts):
        x, owner = passages_of(part)
        parts.append((x, owner + before))
        before += len(part)
    return np.concatenate([x for x, _ in parts]), np.concatenate([owner for _, owner in parts])


class GatedAttention:
    """Encoder, gated attention and scorer; a bag is the passages of a document."""

    def __init__(self, features: int = N_FEATURES, code: int = CODE, attention: int = ATTENTION, seed: int = 29):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        zero = lambda n: np.zeros(n, np.float32)
        self.w = {
            "enc": draw(features, code), "enc_b": zero(code), "tan": draw(code, attention), "tan_b": zero(attention),
            "gate": draw(code, attention), "gate_b": zero(attention), "att": draw(attention, 1),
            "out": draw(code, 1), "out_b": zero(1),
        }

    def forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple:
        w = self.w
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        t = np.tanh(h @ w["tan"] + w["tan_b"])
        g = 1 / (1 + np.exp(-(h @ w["gate"] + w["gate_b"])))
        e = ((t * g) @ w["att"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        logit = (z @ w["out"])[:, 0] + w["out_b"][0]
        return h, t, g, a, z, 1 / (1 + np.exp(-logit))

    def gradients(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of the bags."""
        w = self.w
        h, t, g, a, z, p = self.forward(x, starts, sizes)
        d = ((p - y) / len(y)).astype(np.float32)
        dz = d[:, None] * w["out"].T
        up = np.repeat(dz, sizes, axis=0)
        da = (up * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dtg = de[:, None] * w["att"].T
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = up * a[:, None] + dt @ w["tan"].T + dg @ w["gate"].T
        dx = dh * (1 - h * h)
        return {
            "out": z.T @ d[:, None], "out_b": d.sum(keepdims=True), "att": (t * g).T @ de[:, None],
            "tan": h.T @ dt, "tan_b": dt.sum(axis=0), "gate": h.T @ dg, "gate_b": dg.sum(axis=0),
            "enc": x.T @ dx, "enc_b": dx.sum(axis=0),
        }

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, rounds: int = FIT_ROUNDS, batch: int = FIT_BATCH):
        """Adam over random documents; ``owner`` is sorted."""
        rng = np.random.default_rng(31)
        starts = np.searchsorted(owner, np.arange(len(y)))
        sizes = np.diff(np.append(starts, len(x)))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(u) for k, u in self.w.items()}
        for i in range(1, rounds + 1):
            bags = rng.choice(len(y), min(batch, len(y)), replace=False)
            own = sizes[bags]
            first = np.cumsum(own) - own
            rows = np.repeat(starts[bags] - first, own) + np.arange(own.sum())
            for k, g in self.gradients(x[rows], first, own, y[bags]).items():
                g = g + 1e-5 * self.w[k]
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                rate = 0.01 * min(1.0, 2 * (1 - i / (rounds + 1)))
                self.w[k] -= (rate * m[k] / (1 - 0.9**i) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return self

    def scores(self, texts: list[str]) -> np.ndarray:
        x, owner = passages_of(texts)
        starts = np.searchsorted(owner, np.arange(len(texts)))
        return self.forward(x, starts, np.diff(np.append(starts, len(x))))[-1].astype(np.float64)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = FIT_DOCS) -> GatedAttention | None:
    """Trained on at most ``limit`` labelled, not held-out documents of each class; None without any."""
    rows = labelled_sample(docs, labels, label, limit).toPandas().sort_values(["doc_id", "label"])
    if not len(rows):
        return None
    x, owner = features_of(rows["text"].tolist())
    return GatedAttention().fit(x, owner, rows["label"].to_numpy(np.float32))


def scored(model: GatedAttention | None, text: Column) -> Column:
    """Probability of label 1 for a whole text; a null text counts as empty; 0.5 without a model."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [model.scores(p) if model else np.full(len(p), 0.5) for p in chunks([t or "" for t in batch])]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0)).clip(0, 1)

    return score(text)
