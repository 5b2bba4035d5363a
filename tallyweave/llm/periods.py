"""Periodic runs of words by string synchronising sets.

A run is a stretch of words that repeats with a smallest period q, is at least twice as long
as q, and that no neighbouring word extends. For every dyadic scale t, the positions that
Kempa and Kociumaka (2019) call synchronising are those whose window of t words, or the one t
words on, has the smallest hash of the t + 1 windows that start there. Whether a position is
chosen depends on the 2t words after it alone, and any t neighbouring positions hold a chosen
one, so a run of period 3t to 6t holds a chosen position whose copy a period later is chosen
too: pairs of chosen positions with equal contexts propose the period.

Positions inside highly periodic regions (a period of at most t/3 over 2t words) are left
out, as all of them could be chosen. What that omits is supplied by the regions themselves:
periods below 6 are found by comparing the words with themselves, and where a run begins with
such a region, its next copy with the same root gives the period by its ends, its starts, or,
where two regions touch, by every shift that aligns their roots. Every proposal is verified
by extending it to both sides over window hashes of all powers of two.

Whole texts are read; the documents of a chunk are laid out one after another, longest
first, with separators that equal nothing, so that numpy works on all of them at once.
Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.tables import chunks

#: Shortest run in words.
LEAST_WORDS = 12
#: Periods below this are found by comparing the words with themselves.
SMALL_PERIODS = 6
#: Characters of text that are searched together; a longer text is searched alone.
TOGETHER = 1 << 19

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of two numbers, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class _Windows:
    """Hashes of all windows of 1, 2, 4, … words of sequences laid out longest first.

    ``level(k)`` reaches as far as the sequences of at least 2**k words do: no other windows of
    that length can be equal.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        self.words, self.ends = words, np.cumsum(lengths + 1)
        self.lengths = lengths
        self.longest = int(lengths[0]) if len(lengths) else 0
        self.levels = [_mixed(words.astype(np.uint64), np.uint64(0x632BE59BD9B4E019))]
        while 2 << len(self.levels) - 1 <= self.longest:
            last, step = self.levels[-1], 1 << len(self.levels) - 1
            n = self.reach(2 * step)
            self.levels.append(_mixed(last[:n], np.concatenate([last[step:n], np.zeros(step, np.uint64)])))

    def reach(self, length: int) -> int:
        """Where the sequences of at least ``length`` words end."""
        at = int(np.searchsorted(-self.lengths, -length, side="right"))
        return int(self.ends[at - 1]) if at else 0

    def equal(self, k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        level = self.levels[k]
        inside = (x >= 0) & (y < len(level))
        top = max(len(level) - 1, 0)
        return inside & (level[np.clip(x, 0, top)] == level[np.clip(y, 0, top)]) if len(level) else inside

    def window(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hashes of windows of any length up to the longest, made of two that overlap."""
        out = np.zeros(len(at), np.uint64)
        k = np.frexp(length.astype(np.float64))[1] - 1
        for level in np.unique(k):
            own = k == level
            here, step = self.levels[level], 1 << int(level)
            out[own] = _mixed(here[at[own]], here[at[own] + length[own] - step])
        return out

    def stretched(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch around ``at`` whose words equal those a period later."""
        x, y = at.copy(), at + period
        right = np.zeros(len(at), np.int64)
        left = np.zeros(len(at), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = 1 << k
            # the highest level may fit more than once
            more = True
            while more:
                found = self.equal(k, x + right, y + right)
                right += found * step
                back = self.equal(k, x - left - step, y - left - step)
                left += back * step
                more = k == len(self.levels) - 1 and bool(found.any() or back.any())
        return at - left, at + period + right


def _small_runs(words: np.ndarray, least: int) -> Runs:
    """Stretches of period below SMALL_PERIODS and at least ``least`` words and two periods long, by comparison."""
    starts, ends, periods = [], [], []
    for p in range(1, min(SMALL_PERIODS, len(words))):
        same = np.concatenate([[0], (words[p:] == words[:-p]).astype(np.int8), [0]])
        edge = np.diff(same)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + p
        long = b - a >= max(least, 2 * p)
        starts.append(a[long])
        ends.append(b[long])
        periods.append(np.full(int(long.sum()), p))
    return _joined(starts), _joined(ends), _joined(periods)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def _once(runs: Runs) -> Runs:
    """Each stretch once, with its smallest period, by start and end."""
    a, b, p = runs
    order = np.lexsort((p, b, a))
    a, b, p = a[order], b[order], p[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first], p[first]


def _chosen(windows: _Windows, k: int, n: int) -> np.ndarray:
    """Synchronising positions of scale 2**k among the first ``n``."""
    scale = 1 << k
    ids = np.concatenate([windows.levels[k][:n], np.full(2 * scale, np.iinfo(np.uint64).max, np.uint64)])
    low = ids
    for j in range(k):
        low = np.minimum(low[: len(low) - (1 << j)], low[1 << j :])
    here, last = ids[:n], ids[scale : n + scale]
    low = np.minimum(low[:n], last)
    return np.flatnonzero((here == low) | (last == low))


def _regions(runs: Runs, scale: int) -> Runs:
    """Highly periodic regions of the scale, by start."""
    a, b, p = runs
    own = (3 * p <= scale) & (b - a >= 2 * scale)
    return a[own], b[own], p[own]


def _sync_pairs(windows: _Windows, k: int, regions: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Chosen positions outside the regions with the distance to each later one of equal context."""
    scale = 1 << k
    n = windows.reach(6 * scale)
    at = _chosen(windows, k, n)
    context = windows.levels[k + 1] if k + 1 < len(windows.levels) else np.zeros(0, np.uint64)
    at = at[at < len(context)]
    a, b, _ = regions
    if len(a):
        before = np.searchsorted(a, at, side="right") - 1
        at = at[(before < 0) | (b[np.maximum(before, 0)] < at + 2 * scale)]
    order = np.lexsort((at, context[at]))
    at, own = at[order], context[at[order]]
    froms, periods = [], []
    step = 1
    while step < len(at):
        near = (own[step:] == own[:-step]) & (at[step:] - at[:-step] < 6 * scale)
        if not near.any():
            break
        i = np.flatnonzero(near)
        p = at[i + step] - at[i]
        i, p = i[p >= 3 * scale], p[p >= 3 * scale]
        froms.append(at[i])
        periods.append(p)
        step += 1
    return _joined(froms), _joined(periods)


def _roots(windows: _Windows, regions: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the least rotation of each region's root, and where in the region it first begins."""
    a, _, p = regions
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(p)[:-1]])
    turn = np.arange(int(p.sum())) - np.repeat(first, p)
    hashes = windows.window(np.repeat(a, p) + turn, np.repeat(p, p))
    least = np.minimum.reduceat(hashes, first)
    hit = np.flatnonzero(hashes == np.repeat(least, p))
    _, where = np.unique(np.repeat(np.arange(len(a)), p)[hit], return_index=True)
    return least, a + turn[hit[where]]


def _region_pairs(windows: _Windows, scale: int, regions: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Proposals from regions and their next two with the same root: by ends, by starts, by all aligned shifts."""
    a, b, p = regions
    least, anchor = _roots(windows, regions)
    order = np.lexsort((a, least, p))
    froms, periods = [], []
    for step in (1, 2):
        x, y = order[:-step], order[step:]
        near = (p[x] == p[y]) & (least[x] == least[y]) & (a[y] - b[x] < 2 * scale)
        x, y = x[near], y[near]
        froms += [b[x] - p[x], a[x]]
        periods += [b[y] - b[x], a[y] - a[x]]
        touch = a[y] <= b[x]
        x, y = x[touch], y[touch]
        shift = (anchor[y] - anchor[x]) % p[x]
        low = shift + -(-(3 * scale - shift) // p[x]) * p[x]
        high = np.minimum(6 * scale - 1, np.minimum(b[x] - a[x], b[y] - a[y]) + scale)
        many = np.maximum((high - low) // p[x] + 1, 0)
        turn = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        froms.append(np.repeat(b[x], many) - 1)
        periods.append(np.repeat(low, many) + turn * np.repeat(p[x], many))
    at, period = _joined(froms), _joined(periods)
    own = (period >= 3 * scale) & (period < 6 * scale) & (at >= 0)
    return at[own], period[own]


def runs_of(words: np.ndarray, lengths: np.ndarray, least: int = LEAST_WORDS) -> Runs:
    """Start, end and smallest period of all runs of at least ``least`` words, by start and end.

    ``words`` holds sequences of numbers one after another, longest first, each ended by a
    number that occurs nowhere else; ``lengths`` are their lengths without it.
    """
    windows = _Windows(words, lengths)
    # regions of a scale of 4 words are 8 words long
    found = _once(_small_runs(words, min(least, 8)))
    k = 1
    while 6 << k <= windows.longest:
        scale = 1 << k
        regions = _regions(found, scale)
        pairs = [_sync_pairs(windows, k, regions), _region_pairs(windows, scale, regions)]
        at, period = _joined([x for x, _ in pairs]), _joined([x for _, x in pairs])
        if len(at):
            a, b = windows.stretched(at, period)
            long = b - a >= np.maximum(2 * period, least)
            found = _once(tuple(np.concatenate(x) for x in zip(found, (a[long], b[long], period[long]), strict=True)))
        k += 1
    a, b, p = found
    long = b - a >= np.maximum(2 * p, least)
    return a[long], b[long], p[long]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which of its n words stands at each place of a document that is made periodic from some word on; None for others.

    By h = crc32 of the decimal id, one document in ten repeats p words from word a to its end.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _rows(ids: list[int | None], texts: list[str], plant: bool) -> pd.DataFrame:
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    if plant:
        for i, (own, words) in enumerate(zip(ids, split, strict=True)):
            place = planted(own, len(words))
            if place is not None:
                split[i] = [words[j] for j in place.tolist()]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    order = np.argsort(-lengths, kind="stable")
    numbers, _ = pd.factorize(np.array([w for i in order for w in split[i]] or [b""], dtype=object))
    numbers = numbers[: int(lengths.sum())]
    ends = np.cumsum(lengths[order])
    # a separator after each document
    words = np.insert(numbers, ends, len(numbers) + np.arange(len(ends)))
    a, b, p = runs_of(words, lengths[order])
    first = np.concatenate([[0], np.cumsum(lengths[order] + 1)[:-1]])
    doc = np.searchsorted(first, a, side="right") - 1
    begin = np.searchsorted(doc, np.arange(len(split) + 1))
    out = []
    for rank, i in enumerate(order.tolist()):
        lo, hi = int(begin[rank]), int(begin[rank + 1])
        at, to, period = a[lo:hi] - first[rank], b[lo:hi] - first[rank], p[lo:hi]
        kept = split[i]
        if hi > lo:
            by = np.lexsort((period, at))
            at, to, period = at[by], to[by], period[by]
            cover = np.zeros(lengths[i] + 1, np.int64)
            np.add.at(cover, at + period, 1)
            np.add.at(cover, to, -1)
            kept = [w for w, c in zip(kept, np.cumsum(cover).tolist()) if not c]
        out.append((i, at.tolist(), (to - at).tolist(), period.tolist(), b" ".join(kept)))
    out.sort(key=lambda row: row[0])
    return pd.DataFrame(out, columns=["i", "starts", "lengths", "periods", "collapsed"])


def with_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """``doc_id`` with the runs of its words and the text that is left when each run keeps one period.

    Columns: doc_id; starts, lengths and periods, arrays by start and then period; collapsed, the
    kept words joined by a space. Words are what stands between ASCII blanks; ``plant`` makes one
    document in ten periodic first (see ``planted``). A null or wordless text has no run and an
    empty ``collapsed``; a null doc_id is never planted; equal rows stay as many as they are; of
    equal stretches the smallest period counts; columns other than doc_id and text are ignored.
    A very long text is searched alone, in memory of 8 bytes a word and level, of which there are
    the binary logarithm of its words.
    """
    schema = (
        f"{docs.select('doc_id').schema[0].simpleString().replace(':', ' ')}, starts array<long>, lengths array<long>, "
        "periods array<long>, collapsed string"
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [None if pd.isna(x) else int(x) for x in batch["doc_id"]]
            texts = ["" if x is None else x for x in batch["text"]]
            done = 0
            for part in chunks(texts, TOGETHER):
                found = _rows(ids[done : done + len(part)], part, plant)
                found.insert(0, "doc_id", pd.array(ids[done : done + len(part)], dtype="Int64"))
                done += len(part)
                found["collapsed"] = [x.decode("utf-8", "surrogatepass") for x in found["collapsed"]]
                yield found.drop(columns="i")

    return docs.select("doc_id", "text").mapInPandas(search, schema)


def run_digest(found: DataFrame) -> DataFrame:
    """One row a document: number of runs, the longest one, and digests of all runs and of the collapsed text.

    Of runs of one length the one that starts first counts, then the one of smaller period; a
    document without a run has nulls there and the digest of no text.
    """
    runs = F.arrays_zip("lengths", "starts", "periods")
    ordered = F.transform(
        runs, lambda r: F.struct((-r["lengths"]).alias("l"), r["starts"].alias("s"), r["periods"].alias("p"))
    )
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["starts"], r["lengths"], r["periods"]), F.lit("\n")))
    best = F.array_min(ordered)
    return found.select("doc_id", F.size("starts").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id",
        "n_runs",
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.floor(-F.col("best.l") * 1000 / F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", "lines"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
