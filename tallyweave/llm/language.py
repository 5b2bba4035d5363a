"""Language identification by a bidirectional gated recurrent network over bytes.

A text, in lower case and UTF-8, is cut into windows of ``STEPS`` bytes; a forward and a
backward recurrent layer read each window, every byte gets language probabilities from both
states, and a document's probabilities are the mean over all its bytes. The network is
trained in numpy by backpropagation through time on windows of a bounded number of labelled
documents; all texts are read whole when they are labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.tables import among_least, chunks, held_out

STEPS = 64
HIDDEN = 8
#: Documents of each language that training may read.
FIT_DOCS = 300
FIT_ROUNDS = 400
FIT_BATCH = 256
#: Windows that are read at once.
BLOCK = 512
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; fractions, superscripts and other number signs are none."""
    return any(map(str.isalpha, text or ""))


def windows_of(texts: list[str], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (windows, steps), zeros at the end of a text, and the text each window is from."""
    parts, owner = [], []
    for i, text in enumerate(texts):
        data = text.lower().encode("utf-8", "surrogatepass")
        n = -(-len(data) // steps)
        parts.append(data.ljust(n * steps, b"\0"))
        owner.append(np.full(n, i))
    flat = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, steps)
    return flat, np.concatenate(owner) if owner else np.zeros(0, np.int64)


class ByteGru:
    """Two recurrent layers, one in each direction, and one output layer over both states.

    ``table`` (2, 256, 3H) is the input part of the gates for each byte, ``state`` and ``bias``
    their part from the state before; the gates are update, reset and candidate.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        self.labels = labels
        self.weights = {
            "table": draw(2, 256, 3 * hidden) * 0.3,
            "state": draw(2, hidden, 3 * hidden) / np.float32(hidden**0.5),
            "bias": np.zeros((2, 1, 3 * hidden), np.float32),
            "out": draw(2 * hidden, len(labels)) * 0.3,
            "shift": np.zeros(len(labels), np.float32),
        }

    def states(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, windows, 2H) in reading order; ``keep`` collects what the backward pass needs."""
        w = self.weights
        hidden = w["state"].shape[1]
        n, steps = windows.shape
        both = np.stack([windows, windows[:, ::-1]])
        h = np.zeros((2, n, hidden), np.float32)
        out = np.empty((steps, n, 2 * hidden), np.float32)
        direction = np.arange(2)[:, None]
        for t in range(steps):
            gx = w["table"][direction, both[:, :, t]]
            gh = h @ w["state"] + w["bias"]
            gates = np.tanh((gx[..., : 2 * hidden] + gh[..., : 2 * hidden]) * np.float32(0.5))
            gates *= np.float32(0.5)
            gates += np.float32(0.5)
            z, r = gates[..., :hidden], gates[..., hidden:]
            new = np.tanh(gx[..., 2 * hidden :] + r * gh[..., 2 * hidden :])
            after = new + z * (h - new)
            if keep is not None:
                keep.append((h, z, r, new, gh[..., 2 * hidden :]))
            h = after
            out[t, :, :hidden] = h[0]
            out[steps - 1 - t, :, hidden:] = h[1]
        return out

    def position_probabilities(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.weights["out"] + self.weights["shift"]
        logits -= logits.max(axis=-1, keepdims=True)
        np.exp(logits, out=logits)
        return logits / logits.sum(axis=-1, keepdims=True)

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean cross-entropy over all bytes, by backpropagation through time."""
        w = self.weights
        hidden = w["state"].shape[1]
        n, steps = windows.shape
        kept: list = []
        states = self.states(windows, kept)
        p = self.position_probabilities(states)
        real = (windows.T != 0).astype(np.float32)
        weight = real / real.sum()
        loss = -float((np.log(p[:, np.arange(n), target] + 1e-9) * weight).sum())
        p[:, np.arange(n), target] -= 1
        p *= weight[..., None]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["out"] = np.tensordot(states, p, ([0, 1], [0, 1]))
        g["shift"] = p.sum(axis=(0, 1))
        ds = p @ w["out"].T
        both = np.stack([windows, windows[:, ::-1]])
        dh = np.zeros((2, n, hidden), np.float32)
        turned = w["state"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            h, z, r, new, ghn = kept[t]
            dh = dh + np.stack([ds[t, :, :hidden], ds[steps - 1 - t, :, hidden:]])
            dan = dh * (1 - z) * (1 - new * new)
            daz = dh * (h - new) * z * (1 - z)
            dar = dan * ghn * r * (1 - r)
            dgx = np.concatenate([daz, dar, dan], axis=2)
            dgh = np.concatenate([daz, dar, dan * r], axis=2)
            for d in range(2):
                np.add.at(g["table"][d], both[d, :, t], dgx[d])
            g["state"] += h.transpose(0, 2, 1) @ dgh
            g["bias"] += dgh.sum(axis=1, keepdims=True)
            dh = dh * z + dgh @ turned
        return g, loss

    def fit(self, windows: np.ndarray, target: np.ndarray, rounds: int = FIT_ROUNDS, batch: int = FIT_BATCH, seed: int = 5):
        """Adam over random windows, as many of each language."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(target == c) for c in range(len(self.labels))]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for i in range(1, rounds + 1):
            pick = np.concatenate([rng.choice(own, batch // len(of) + 1) for own in of if len(own)])
            g, _ = self.gradients(windows[pick], target[pick])
            rate = 0.02 * min(1.0, 2 * (1 - i / (rounds + 1)))
            for k, x in g.items():
                first[k] += (x - first[k]) * 0.1
                second[k] += (x * x - second[k]) * 0.01
                self.weights[k] -= (
                    rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)
                ).astype(np.float32)
        return self

    def document_probabilities(self, texts: list[str]) -> np.ndarray:
        """Mean over all bytes of each text; zeros for an empty text."""
        total = np.zeros((len(texts), len(self.labels)))
        count = np.zeros(len(texts))
        windows, owner = windows_of(texts)
        for at in range(0, len(windows), BLOCK):
            part = windows[at : at + BLOCK]
            p = self.position_probabilities(self.states(part))
            real = part.T != 0
            p *= real[..., None]
            np.add.at(total, owner[at : at + BLOCK], p.sum(axis=0))
            np.add.at(count, owner[at : at + BLOCK], real.sum(axis=0))
        return total / np.maximum(count, 1)[:, None]


def learn(docs: DataFrame, limit: int = FIT_DOCS) -> ByteGru | None:
    """A network trained on at most ``limit`` documents of each language, those with the smallest hashes.

    Held-out documents and those without an id, text or language take no part. None if nothing is left.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    ids = known.where(F.length("text") > 0).select("doc_id", "lang")
    value = F.xxhash64("doc_id", F.lit(3))
    # one row a language; a language of any number of documents sends about twice the limit of ids to its task
    sizes = ids.groupBy("lang").agg(F.count("*").alias("total"))
    ids = ids.join(sizes, "lang").where(among_least(value, F.col("total"), limit))
    order = Window.partitionBy("lang").orderBy(value, "doc_id")
    ids = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("doc_id").distinct()
    # limit ids for each language at most
    rows = known.join(F.broadcast(ids), "doc_id").select("doc_id", "lang", "text").toPandas().sort_values("doc_id")
    if not len(rows):
        return None
    labels = sorted(rows["lang"].unique())
    texts = rows["text"].fillna("").tolist()
    windows, owner = windows_of(texts)
    number = rows["lang"].map(labels.index).to_numpy()
    return ByteGru(labels).fit(windows, number[owner])


def _halfway(labels: int, least: float | None) -> float:
    return float((1 / labels + least) / 2) if labels > 1 and least is not None else 0.0


def least_score(probabilities: np.ndarray, number: np.ndarray) -> float:
    """Halfway between an even mixture and the least score of a row whose likeliest label is its own.

    0 with one label, or if no row is right.
    """
    right = probabilities[probabilities.argmax(axis=1) == number].max(axis=1)
    return _halfway(probabilities.shape[1], right.min() if len(right) else None)


def least_score_of_all(found: DataFrame, model: ByteGru | None, name: str = "language") -> float:
    """:func:`least_score` over every document that may be learnt from, of documents with the struct of :func:`predicted`.

    Held-out documents and those without an id, text or language take no part.
    """
    if model is None:
        return 0.0
    known = found.where(F.col("doc_id").isNotNull() & ~held_out() & (F.col(f"{name}.lang_pred") == F.col("lang")))
    # an empty text is like no language, also if a language has the name of none
    score = F.when(F.col(f"{name}.score") > 0, F.col(f"{name}.score"))
    return _halfway(len(model.labels), known.agg(F.min(score).alias("least")).first().least)


def predicted(model: ByteGru | None, text: Column) -> Column:
    """Struct lang_pred, score: the likeliest language and its mean probability.

    ``und`` and 0 for a null text, one without a letter, or if there was nothing to learn from.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if model is not None and has_letter(t) else "" for t in batch]
            lang, score = [], []
            for part in chunks(texts):
                p = model.document_probabilities(part) if model is not None else np.zeros((len(part), 1))
                best = p.argmax(axis=1)
                lang += [model.labels[b] if t else UNKNOWN for b, t in zip(best, part, strict=True)]
                score += np.where([bool(t) for t in part], p.max(axis=1), 0.0).clip(0, 1).tolist()
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return predict(text)


def with_language(docs: DataFrame, model: ByteGru | None, name: str = "language") -> DataFrame:
    """The documents, all columns, with the struct of :func:`predicted`."""
    return docs.withColumn(name, predicted(model, F.col("text")))
