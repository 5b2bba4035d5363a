"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nystroem landmarks.

Two strings are alike as far as they share subsequences of four characters, each weighted by
``DECAY`` to the length it spans; a span of up to ``SPAN`` characters lets letters in between
be missing, added or replaced. Strings begin and end with a mark, so the ends of a word count. A
kernel value is divided by the greatest value that strings of these lengths allow.

A sentence is judged by its worst word, a document by its worst sentence. The machine is
trained on sentences: every word of a sentence from a non-toxic document is a negative
string, and a sentence of a toxic document has at least one positive string, the one that the
machine so far finds worst (multiple-instance support vectors). A word of both classes is positive
if it is surely oftener toxic than clean, and then never a negative: one wrong label or one
quotation does not excuse an insult. Landmarks are words of the training sentences. A trained
machine is linear in the subsequences, so words are scored with one table of subsequence weights.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.tables import chunks, held_out, labelled_sample

#: Characters of a subsequence.
ORDER = 4
DECAY = 0.7
SPAN = 6
#: Labelled documents of each class that training may read.
FIT_DOCS = 2500
LANDMARKS = 800
NEGATIVE_WORDS = 9_000
#: Non-toxic words with the highest margins that join the negatives after each round.
MINED_WORDS = 3_000
ROUNDS = 4
#: A word of both classes is toxic if it is so many times likelier in toxic documents, and even odds are so many standard errors off.
LEAST_ODDS, SURE = 10.0, 2.5
#: Weight of errors against large weights. More follows labels that no word explains, less misses rare insults.
COST = 1e4
#: One in so many training documents is kept from a second machine, whose margins on them set the probabilities.
LINE_PART = 3
CUT = 0.5
#: Characters of a string; longer words are cut into overlapping strings.
LONGEST = 64
#: Scored words that a worker remembers; then it forgets all and starts again.
REMEMBERED = 1 << 20
_LETTERS = 32
_EDGE = ".,;:!?\"'()[]{}#$%&*|<>-_/\\@~`+="
_MARK = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)(?:\S[ ]){2,}\S(?!\S)")


def words_of(text: str) -> list[str]:
    """Lower-case words without marks at their ends.

    A word with marks inside comes without them too; single characters in a row form one word more.
    """
    low = text.lower()
    words = [w.strip(_EDGE) for w in low.split()]
    words += [_MARK.sub("", w) for w in words if not w.isalnum()]
    words += [m.group().replace(" ", "") for m in _SPACED.finditer(low)]
    return [w for w in words if w]


def sentences_of(text: str) -> list[list[str]]:
    return [w for s in re.split(r"[.!?]\s|\n", text) if (w := words_of(s))]


@cache
def _places(length: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Index tuples of a string within SPAN, their weights, and the root of the greatest self-similarity."""
    places = [
        (i, *rest) for i in range(length) for rest in combinations(range(i + 1, min(i + SPAN, length)), ORDER - 1)
    ]
    at = np.array(places, np.int64).reshape(-1, ORDER)
    weight = DECAY ** (at[:, -1] - at[:, 0] + 1.0 - ORDER)
    return at, weight.astype(np.float32), float(np.sqrt((weight**2).sum()) or 1.0)


def _coded(words: list[str], length: int) -> np.ndarray:
    """Words of one length as letter codes between two marks. Letters beyond ASCII share the upper codes."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)
    small = (points >= 97) & (points <= 122)
    codes = np.where(small, points - 96, 27 + points % (_LETTERS - 27))
    mark = np.zeros((len(words), 1), np.int64)
    return np.concatenate([mark, codes.astype(np.int64), mark], axis=1)


def _groups(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Numbers and codes of the words of each length."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for length, own in by.items():
        for at in range(0, len(own), 8192):
            part = own[at : at + 8192]
            yield part, _coded([words[i] for i in part], length)


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Codes of all subsequences of words of one length, the weight of each place, and the norm."""
    at, weight, norm = _places(codes.shape[1])
    code = codes[:, at[:, 0]]
    for place in range(1, ORDER):
        code = code * _LETTERS + codes[:, at[:, place]]
    return code, weight, norm


def features(words: list[str]) -> list[dict[int, float]]:
    """Normalised subsequence weights of each word."""
    out: list[dict[int, float]] = [{} for _ in words]
    for own, codes in _groups(words):
        coded_places, weight, norm = subsequences(codes)
        for i, row in zip(own, coded_places.tolist(), strict=True):
            d = out[i]
            for code, w in zip(row, weight.tolist(), strict=True):
                d[code] = d.get(code, 0.0) + w / norm
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of every word with every landmark."""
    own = features(landmarks)
    codes = np.array(sorted({c for d in own for c in d}), np.int64)
    table = np.zeros((len(codes) + 1, len(landmarks)), np.float32)
    for j, d in enumerate(own):
        for code, w in d.items():
            table[np.searchsorted(codes, code), j] = w
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for rows, coded in _groups(words):
        coded_places, weight, norm = subsequences(coded)
        if not coded_places.size or not len(codes):
            continue
        at = np.minimum(np.searchsorted(codes, coded_places), len(codes) - 1)
        at[codes[at] != coded_places] = len(codes)
        for a in range(0, len(rows), 256):
            part = at[a : a + 256]
            out[rows[a : a + 256]] = np.einsum("npl,p->nl", table[part], weight) / norm
    return out


def support_vectors(
    x: np.ndarray, y: np.ndarray, count: np.ndarray, cost: float = COST, steps: int = 30
) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps in the primal.

    A row weighs as ``count`` says, and both classes weigh the same.
    """
    share = count * np.where(y > 0, 0.5 / max(count[y > 0].sum(), 1), 0.5 / max(count[y < 0].sum(), 1))
    rows, x = x, np.ones((len(x), x.shape[1] + 1))
    x[:, :-1] = rows
    plain = np.eye(x.shape[1])
    plain[-1, -1] = 1e-6  # the bias is hardly held
    w, before = np.zeros(x.shape[1]), None
    for _ in range(steps):
        support = y * (x @ w) < 1
        if before is not None and (support == before).all():
            break
        before = support
        own = x[support] * (2 * cost * share[support])[:, None]
        w = w + 0.7 * (np.linalg.solve(plain + own.T @ x[support], own.T @ y[support]) - w)
    return w[:-1], float(w[-1])


class WordMachine:
    """Subsequence weights, bias, and the line from a document's worst margin to a probability."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for own, codes in _groups(words):
            coded_places, weight, norm = subsequences(codes)
            if coded_places.size:
                out[own] += self.weights[coded_places] @ weight / norm
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def _strings(word: str) -> list[str]:
    """The word, or overlapping parts of a long one, which cover it whole."""
    if len(word) <= LONGEST:
        return [word]
    return [word[a : a + LONGEST] for a in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def toxic_odds(bad: Counter, good: Counter, n_bad: int, n_good: int) -> tuple[dict[str, float], set[str]]:
    """Log odds of each word of the toxic documents, and the words of both classes that are surely toxic."""
    odds = {w: np.log((bad[w] + 0.5) / n_bad) - np.log((good[w] + 0.5) / n_good) for w in bad}
    error = {w: np.sqrt(1 / (bad[w] + 0.5) + 1 / (good[w] + 0.5)) for w in bad if w in good}
    return odds, {w for w, e in error.items() if odds[w] > max(np.log(LEAST_ODDS), SURE * e)}


def _fitted(seen: list[list[str]], toxic: np.ndarray, landmarks: int, negatives: int) -> WordMachine:
    """Machine from the words of each document, of both classes; its line is still plain."""
    rng = np.random.default_rng(37)
    bad, good = Counter(), Counter()
    for words, label in zip(seen, toxic, strict=True):
        (bad if label else good).update(words)
    n_bad, n_good = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    odds, both = toxic_odds(bad, good, n_bad, n_good)
    worst = sorted(odds, key=lambda w: (-odds[w] * np.sqrt(bad[w]), w))
    clean = sorted(good.keys() - both, key=lambda w: (-good[w], w))
    other = clean[: landmarks // 4] + rng.permutation(clean[landmarks // 4 :])[: landmarks // 4].tolist()
    chosen = list(dict.fromkeys(worst[: landmarks - len(other)] + other))
    values, vectors = np.linalg.eigh(kernel(chosen, chosen).astype(np.float64))
    keep = values > 1e-4 * max(values.max(), 1e-9)
    # Nystroem map: kernel with landmarks times this; in single precision, as the rows are many
    root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    negative = clean[: negatives // 2] + rng.permutation(clean[negatives // 2 :])[: negatives // 2].tolist()
    x_negative = kernel(negative, chosen) @ root
    toxic_words = [words for words, t in zip(seen, toxic, strict=True) if t and words]
    witness = [max(words, key=lambda w: (odds[w] * np.sqrt(bad[w]), w)) for words in toxic_words]
    own = features(chosen)
    for _ in range(ROUNDS):
        count = Counter(witness)
        positive = sorted(w for w in count if w not in good or w in both)
        x = np.concatenate([kernel(positive, chosen) @ root, x_negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = {w: count[w] * (bad[w] / n_bad) / (bad[w] / n_bad + good[w] / n_good) for w in positive}
        times = np.sqrt([*(weight[w] for w in positive), *(good[w] for w in negative)])
        w, b = support_vectors(x, y, times)
        weights = np.zeros(_LETTERS**ORDER)
        for alpha, d in zip(root @ w, own, strict=True):
            for code, value in d.items():
                weights[code] += alpha * value
        machine = WordMachine(weights, b)
        witness = [words[int(np.argmax(machine.margins(words)))] for words in toxic_words]
        margins = machine.margins(clean)
        mined = sorted({clean[i] for i in np.argsort(-margins, kind="stable")[:MINED_WORDS]}.difference(negative))
        negative = negative + mined
        x_negative = np.concatenate([x_negative, kernel(mined, chosen) @ root])
    return machine


def _line(top: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic line over the documents' worst margins, by Newton steps.

    Targets are drawn in by one row of each class, which keeps the line finite where a cut parts the classes.
    """
    n_bad, n_good = (toxic > 0).sum(), (toxic <= 0).sum()
    target = np.where(toxic > 0, (n_bad + 1) / (n_bad + 2), 1 / (n_good + 2))
    x = np.stack([top, np.ones(len(top))], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -50, 50)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-6 * line)
        line = line + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(line[0]), float(line[1])


def train(texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS, negatives: int = NEGATIVE_WORDS) -> WordMachine:
    """From labelled texts, of both classes.

    Margins of documents that a machine was trained on lie further apart than those of new ones,
    so the line comes from documents that a second machine has not seen. With too few of
    them to leave both classes on both sides, it comes from the training documents.
    """
    seen = [sorted({w for s in sentences_of(t) for v in s for w in _strings(v)}) for t in texts]
    machine = _fitted(seen, toxic, landmarks, negatives)
    apart = np.zeros(len(texts), bool)
    for value in (0, 1):
        apart[np.flatnonzero(toxic == value)[::LINE_PART]] = True
    other = machine
    if len(set(toxic[apart])) == len(set(toxic[~apart])) == 2:
        other = _fitted([w for w, out in zip(seen, apart, strict=True) if not out], toxic[~apart], landmarks, negatives)
    else:
        apart[:] = True
    judged = [w for w, out in zip(seen, apart, strict=True) if out]
    top = np.array([other.margins(words).max() if words else other.bias for words in judged])
    # beyond 1 a margin says no more: a few words far out would else tilt the line over all that lie at 1
    machine.slope, machine.shift = _line(np.clip(top, -1, 1), toxic[apart])
    return machine


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = FIT_DOCS) -> WordMachine | None:
    """Trained on at most ``limit`` labelled, not held-out documents of each class; None without both classes.

    The limit may thin out one class more than the other: the line's shift is set back by the
    shares of the classes among all labels.
    """
    rows = labelled_sample(docs, labels, label, limit).toPandas().sort_values(["doc_id", "label"])
    if rows["label"].nunique() < 2:
        return None
    machine = train(rows["text"].tolist(), rows["label"].to_numpy(np.int64))
    known = labels.where(F.col(label).isin(0, 1) & ~held_out())
    bad, good = known.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    own_bad, own_good = (rows["label"] == 1).sum(), (rows["label"] == 0).sum()
    machine.shift += float(np.log(max(bad, 1) * own_good / (max(good, 1) * own_bad)))
    return machine


def scored(machine: WordMachine | None, text: Column) -> Column:
    """Probability of label 1 for a whole text, from its worst word.

    A text without words, or null, has the score of the machine's bias; 0 without a machine.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for batch in batches:
            out: list[np.ndarray] = []
            for part in chunks([t or "" for t in batch]):
                if machine is None:
                    out.append(np.zeros(len(part)))
                    continue
                words = [words_of(t) for t in part]
                if len(known) > REMEMBERED:
                    known.clear()
                new = list({w for own in words for w in own}.difference(known))
                cut = [_strings(w) for w in new]
                values = machine.margins([s for own in cut for s in own])
                if new:
                    starts = np.cumsum([0, *map(len, cut[:-1])])
                    known.update(zip(new, np.maximum.reduceat(values, starts).tolist(), strict=True))
                worst = [max(map(known.__getitem__, own)) if own else machine.bias for own in words]
                out.append(machine.probability(np.array(worst)))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score(text)
