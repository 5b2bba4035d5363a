"""Removal of long repeated substrings by sorting sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. The
suffixes that are sorted start at anchors: positions whose k-gram hash is the leftmost smallest
in some window of ``window`` positions. The first ``window`` positions of a string of ``length``
bytes choose one anchor, and equal strings choose it at the same place, so a string repeats
only where the ``length - window + 1`` bytes from its anchor repeat too.

1. The suffixes at anchors, held as their leading bytes and digests of their first ``length``
   bytes, are range-partitioned by splitters from a bounded sample of documents and sorted in
   each bucket. Neighbours with equal leading bytes and digests repeat. Equal keys always fall
   in one bucket, so no run crosses a boundary; strings that already occur twice in the sample
   are known to repeat and skip the sort, which keeps very common passages from filling a
   bucket.
2. Where repeated strings at anchors do not already cover all strings that choose an anchor,
   those strings decide where exactly the repeat begins or ends. They are sorted in the same
   way, against those of the same anchors in all other documents.
3. Covered bytes are joined into spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.tables import least_hashed, shuffle_partitions, stored

LENGTH = 400
WINDOW = 96
GRAM = 16
#: Documents from which splitters and the most common strings are learnt.
SAMPLE_DOCS = 256

_SUFFIX = "k1 long, k2 long, row long, ref long, tag int"


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[: len(x) - step], x[step:])
        step *= 2
    if step < width:
        x = np.minimum(x[: len(x) - (width - step)], x[width - step :])
    return x


def anchors(data: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, first, last): each anchor with the range of windows whose leftmost smallest gram hash it has.

    The ranges follow each other and hold every window of ``window`` positions once. ``gram`` is a power of two.
    """
    if len(data) < window + gram - 1:
        return (np.zeros(0, np.int64),) * 3
    with np.errstate(over="ignore"):
        h = np.frombuffer(data, np.uint8).astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
        step, factor = 1, 0x85EBCA6B
        while step < gram:
            h = h[: len(h) - step] * np.uint32(factor) + h[step:]
            h ^= h >> np.uint32(15)
            factor = factor * factor + 2 & 0xFFFFFFFF
            step *= 2
    placed = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    best = (_window_minima(placed, window) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(best, prepend=-1))
    return best[first], first, np.append(first[1:], len(best)) - 1


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _lead(data: bytes, at: list[int]) -> np.ndarray:
    """The four leading bytes of each suffix in the high half."""
    return np.array([int.from_bytes(data[a : a + 4], "big") for a in at], np.uint64) << np.uint64(32)


def suffixes(data: bytes, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k1, k2, ref) of the suffixes at anchors.

    k1: leading bytes, and a digest of the first ``length - window + 1`` bytes; k2: digest of
    ``length`` bytes, 0 if there are not as many; ref: position * 65536 + its distance from the
    first of its windows * 256 + from the last.
    """
    short = length - window + 1
    at, first, last = anchors(data, window)
    fits = at + short <= len(data)
    at, first, last = at[fits], first[fits], last[fits]
    where = at.tolist()
    digest = xxhash.xxh3_64_intdigest
    part = np.array([digest(data[a : a + short]) for a in where], np.uint64) & np.uint64(0xFFFFFFFF)
    k1 = (_lead(data, where) | part).view(np.int64)
    k2 = _signed([digest(data[a : a + length]) if a + length <= len(data) else 0 for a in where])
    return k1, k2, (at << 16) + ((at - first) << 8) + at - last


def strings(data: bytes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(k1, k2) of the strings of ``length`` bytes that start at the given positions."""
    where = at.tolist()
    digest = xxhash.xxh3_128_intdigest
    both = [digest(data[a : a + length]) for a in where]
    low = np.array([b & 0xFFFFFFFF for b in both], np.uint64)
    return (_lead(data, where) | low).view(np.int64), _signed([b >> 64 for b in both])


class Splitters:
    """Sorted keys that cut suffix order into buckets, and strings that the sample already shows twice."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray, buckets: int):
        ordered = np.sort(k1.view(np.uint64))
        self.buckets = buckets
        self.cuts = ordered[np.linspace(0, len(ordered) - 1, buckets + 1).astype(int)[1:-1]] if len(ordered) else ordered
        pairs = np.stack([k1, k2], axis=1)[k2 != 0]
        if len(pairs):
            twice, n = np.unique(pairs, axis=0, return_counts=True)
            self.known = {(int(a), int(b)) for a, b in twice[n > 1]}
        else:
            self.known = set()
        self.known_k1 = np.unique(np.array([a for a, _ in self.known], np.int64))
        self.known_k2 = np.unique(np.array([b for _, b in self.known], np.int64))

    def deal(self, k1: np.ndarray, k2: np.ndarray, ref: np.ndarray) -> np.ndarray:
        """Bucket * 4 + what is known of each string: 2 if it repeats, 1 if its k1 does.

        Strings that are known to repeat are spread at random.
        """
        known = np.zeros(len(k1), np.int32)
        if self.known:
            known[_among(self.known_k1, k1)] = 1
            for i in np.flatnonzero((known == 1) & _among(self.known_k2, k2)):
                if (int(k1[i]), int(k2[i])) in self.known:
                    known[i] = 2
        bucket = np.searchsorted(self.cuts, k1.view(np.uint64), side="right")
        return (np.where(known == 2, ref % 65521 % self.buckets, bucket) * 4 + known).astype(np.int32)


def _among(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _sampled(docs: DataFrame, keys, limit: int, buckets: int) -> Splitters:
    """Splitters from the ``limit`` documents with the smallest row keys; each sends 4096 keys at most."""
    sample = least_hashed(docs.select("row", "text").where(F.octet_length("text") >= LENGTH), limit, F.col("row"))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                k1, k2 = keys(text.encode("utf-8", "surrogatepass"))
                step = len(k1) // 4096 + 1
                yield pd.DataFrame({"k1": k1[::step], "k2": k2[::step]})

    rows = sample.mapInPandas(of, "k1 long, k2 long").toPandas()
    return Splitters(rows["k1"].to_numpy(np.int64), rows["k2"].to_numpy(np.int64), buckets)


def _bucketed(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartition(partitions, F.shiftright("tag", 2)).sortWithinPartitions("k1", "k2")


def _repeats(batches: Iterator[pd.DataFrame], weak: bool) -> Iterator[pd.DataFrame]:
    """Rows in sort order that equal a neighbour; ``full`` tells whether on both keys.

    With ``weak``, rows that equal a neighbour on k1 alone stay too.
    """
    held = None
    before = None

    def judged(rows: dict[str, np.ndarray], n: int, last: tuple | None) -> pd.DataFrame:
        """The first n rows, whose following row is known unless they are all there is."""
        k1, k2 = rows["k1"], rows["k2"]
        same1 = k1[1:] == k1[:-1]
        same2 = same1 & (k2[1:] == k2[:-1])
        part, full = np.zeros(len(k1), bool), np.zeros(len(k1), bool)
        part[1:] |= same1
        part[:-1] |= same1
        full[1:] |= same2
        full[:-1] |= same2
        if last is not None:
            part[0] |= k1[0] == last[0]
            full[0] |= (k1[0], k2[0]) == last
        known = rows["tag"] & 3
        part |= known > 0
        full = (full & (k2 != 0)) | (known == 2)
        keep = np.flatnonzero(((part | full) if weak else full)[:n])
        return pd.DataFrame({"k1": k1[keep], "row": rows["row"][keep], "ref": rows["ref"][keep], "full": full[keep]})

    for batch in batches:
        if not len(batch):
            continue
        rows = {c: batch[c].to_numpy() for c in ("k1", "k2", "row", "ref", "tag")}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        n = len(rows["k1"]) - 1
        if n:
            yield judged(rows, n, before)
            before = (rows["k1"][n - 1], rows["k2"][n - 1])
        held = {c: x[n:] for c, x in rows.items()}
    if held is not None:
        yield judged(held, 1, before)


_REPEAT = "k1 long, row long, ref long, full boolean"


def _spans(starts: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs [start, end) that the strings starting at ``starts`` cover."""
    starts = np.unique(starts)
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.concatenate([[0], new + 1])], starts[np.concatenate([new, [len(starts) - 1]])] + length], axis=1)


def repeated_starts(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """``row`` and ``starts``: start positions of repeated strings that together cover all repeated bytes.

    ``docs`` has ``row`` (a key of the id and the text, so that equal rows share it), ``text`` and
    ``rest``, which is not looked at: texts are shuffled by ``row`` with it, so that the shuffle
    can serve the caller's join too.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    long_docs = docs.where(F.octet_length("text") >= length)

    first = _sampled(docs, lambda b: suffixes(b, length, window)[:2], SAMPLE_DOCS, parts)
    found = _suffix_rows(spark, long_docs, spark.sparkContext.broadcast(first), length, window)
    near = _bucketed(found, parts).mapInPandas(lambda b: _repeats(b, True), _REPEAT)
    # equal rows of the input report the same anchors
    near = near.repartition(parts, "row").groupBy("row", "ref").agg(F.max("full").alias("full"), F.first("k1").alias("k1"))

    near = stored(_open_windows(near, length), "suffixes")
    # the distances from its anchor at which some document needs an answer
    edges = near.where("open").groupBy("k1").agg(
        F.min(F.col("at") - F.col("last_open")).alias("least"), F.max(F.col("at") - F.col("first_open")).alias("most")
    )
    member = near.select("k1", "row", "ref", "open").join(edges, "k1")
    member = member.groupBy("row").agg(F.collect_list(F.struct("ref", "open", "least", "most")).alias("anchors"))

    whole = _sampled(docs, lambda b: strings(b, np.arange(0, len(b) - length + 1, 7), length), SAMPLE_DOCS, parts)
    between = _edge_rows(docs.join(member, "row"), spark.sparkContext.broadcast(whole), length)
    exact = _bucketed(between, parts).mapInPandas(lambda b: _repeats(b, False), _REPEAT)
    # ref of a string at an open anchor is even
    at_edges = exact.where(F.col("ref").bitwiseAND(F.lit(1)) == 0).select("row", F.shiftright("ref", 8).alias("start"))
    starts = near.where("full").select("row", F.col("at").alias("start")).unionByName(at_edges)
    return starts.groupBy("row").agg(F.collect_set("start").alias("starts"))


def _open_windows(near: DataFrame, length: int, around: int = 8) -> DataFrame:
    """Adds ``at``, and ``open`` with ``first_open`` and ``last_open``: windows of the anchor still to be judged.

    Strings that start between two repeated ones not more than ``length`` apart cover nothing
    new. Only ``around`` anchors on either side are looked at, which leaves at worst more
    windows open.
    """
    near = near.withColumn("at", F.shiftright("ref", 16))
    first = F.col("at") - F.shiftright("ref", 8).bitwiseAND(F.lit(255))
    last = F.col("at") - F.col("ref").bitwiseAND(F.lit(255))
    order = Window.partitionBy("row").orderBy("ref")
    full_at = F.collect_list(F.when(F.col("full"), F.col("at")))
    near = near.withColumns(
        {
            "first": first,
            "last": last,
            "behind": full_at.over(order.rowsBetween(-around, 0)),
            "ahead": full_at.over(order.rowsBetween(0, around)),
        }
    )
    near = near.withColumns(
        {
            "left": F.array_max(F.filter("behind", lambda x: x <= F.col("first"))),
            "low": F.array_min(F.filter("behind", lambda x: x > F.col("first"))),
            "high": F.array_max(F.filter("behind", lambda x: x > F.col("first"))),
            "right": F.array_min(F.filter("ahead", lambda x: x >= F.col("last"))),
        }
    )
    meet = lambda a, b: F.coalesce(F.col(b) - F.col(a) <= length, F.lit(False))
    inner = F.col("low").isNotNull()
    before = ~F.when(inner, meet("left", "low")).otherwise(meet("left", "right"))
    after = F.when(inner, (F.col("last") > F.col("high")) & ~meet("high", "right")).otherwise(before)
    near = near.withColumns(
        {
            "first_open": F.when(before | ~inner, F.col("first")).otherwise(F.col("high") + 1),
            "last_open": F.when(after | ~inner, F.col("last")).otherwise(F.least(F.col("low") - 1, F.col("last"))),
            "open": before | after,
        }
    )
    return near.select("row", "ref", "k1", "full", "at", "open", "first_open", "last_open")


def _suffix_rows(
    spark: SparkSession, docs: DataFrame, splitters: Broadcast, length: int, window: int
) -> DataFrame:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["row"].tolist(), batch["text"], strict=True):
                k1, k2, ref = suffixes(text.encode("utf-8", "surrogatepass"), length, window)
                if len(k1):
                    tag = splitters.value.deal(k1, k2, ref)
                    yield pd.DataFrame({"k1": k1, "k2": k2, "row": row, "ref": ref, "tag": tag})

    return docs.select("row", "text").mapInPandas(_joined(of), _SUFFIX)


def _edge_rows(docs: DataFrame, splitters: Broadcast, length: int) -> DataFrame:
    """The strings at the asked distances before an anchor, as far as they choose it."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text, own in zip(batch["row"].tolist(), batch["text"], batch["anchors"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                starts, even = [], []
                for anchor in own:
                    at = anchor["ref"] >> 16
                    low = at - min(anchor["ref"] >> 8 & 255, anchor["most"])
                    high = min(at - max(anchor["ref"] & 255, anchor["least"]) + 1, at, len(data) - length + 1)
                    if low < high:
                        starts.append(np.arange(low, high))
                        even.append(np.full(high - low, not anchor["open"], np.int64))
                if starts:
                    at = np.concatenate(starts)
                    k1, k2 = strings(data, at, length)
                    ref = at * 256 + np.concatenate(even)
                    tag = splitters.value.deal(k1, k2, ref)
                    yield pd.DataFrame({"k1": k1, "k2": k2, "row": row, "ref": ref, "tag": tag})

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # of strings that need no answer themselves, one in a frame shows the others that there is one
        for frame in _joined(of, 500_000)(batches):
            asked = (frame["ref"] & 1) == 0
            shown = frame[~asked & ((frame["tag"] & 3) != 2)].drop_duplicates(["k1", "k2"])
            yield pd.concat([frame[asked], shown.assign(row=0, ref=1)])

    return docs.select("row", "text", "rest", "anchors").mapInPandas(once, _SUFFIX)


def _joined(of, rows: int = 100_000):
    """Frames of about as many rows, put together from the small ones of single documents."""

    def larger(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, size = [], 0
        for frame in of(batches):
            part.append(frame)
            size += len(frame)
            if size >= rows:
                yield pd.concat(part)
                part, size = [], 0
        if part:
            yield pd.concat(part)

    return larger


_CUT = "n_bytes long, n_removed long, spans array<array<long>>, kept binary"


def cut_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, with a struct ``cut``: n_bytes, n_removed, spans [start, end) and the kept bytes.

    Positions are UTF-8 bytes of the whole text; a null text counts as empty. Strings are judged
    on the input, not on what is left, and never cross documents. Texts shorter than ``length``
    keep all bytes. Equal rows are copies of each other like any other documents.
    """
    marked = _marked(docs, length, window)

    @F.pandas_udf(_CUT)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, marks in batches:
            out = []
            for text, mark in zip(texts, marks, strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                spans = _spans(np.asarray(mark if mark is not None else [], np.int64), length)
                kept = _without(data, spans)
                out.append((len(data), len(data) - len(kept), spans.tolist(), kept))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "spans", "kept"])

    return marked.withColumn("cut", cut("text", "starts")).select(*_columns_of(docs), "cut")


def without_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, without the bytes that :func:`cut_repeats` removes from their texts.

    Bytes of a character of which a part was removed go too. A text that loses nothing stays as it is, also a null one.
    Only texts that lose something meet Python, once: a second Python function after :func:`cut_repeats`
    would take a second worker for each running task, which executors then keep.
    """
    marked = _marked(docs, length, window)

    @F.pandas_udf("string")
    def whole_characters(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, marks in batches:
            out = []
            for text, mark in zip(texts, marks, strict=True):
                if text is None or mark is None or not len(mark):
                    out.append(None)
                else:
                    kept = _without(text.encode("utf-8", "surrogatepass"), _spans(np.asarray(mark, np.int64), length))
                    out.append(kept.decode("utf-8", "ignore"))
            yield pd.Series(out, dtype=object)

    cut = whole_characters(F.when(F.col("starts").isNotNull(), F.col("text")), "starts")
    return marked.withColumn("text", F.coalesce(cut, F.col("text"))).select(*_columns_of(docs))


def _marked(docs: DataFrame, length: int, window: int) -> DataFrame:
    """``row``, ``text`` and the other columns as ``rest``, with ``starts`` of the repeated strings, null if there is none."""
    rest = [c for c in docs.columns if c != "text"]
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text", F.struct(*rest).alias("rest"))
    return keyed.join(repeated_starts(keyed, length, window), "row", "left")


def _columns_of(docs: DataFrame) -> list[Column]:
    return [F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns]


def _without(data: bytes, spans: np.ndarray) -> bytes:
    """The bytes outside the spans."""
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept)
