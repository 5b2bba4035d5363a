"""Token pieces of documents and their best-fit packing into sequences of a fixed size.

Packing is bulk-synchronous. Lengths and gaps are integers up to the capacity, so both are
ordered by class: a round sweeps the gaps upwards, and each gap takes the longest open
length that fits, one document per gap and round. Gaps are then updated and the next round
begins; when nothing fits, as many sequences as the open tokens fill at least are opened with
the longest open documents. A sweep needs only the number of documents of each length, at
most ``capacity`` numbers, whatever the input. Rows meet their places by rank: documents of a
length are numbered in Spark, and the plan says which ranks of a length go where.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm.tables import chunks, stored

CAPACITY = 2048
END_ID = 0


class Encoder:
    """Ids of texts as little-endian uint32 bytes, those of the byte-level tokenizer in ``path``.

    ``ranks`` is the same vocabulary as a rank file, which is several times faster to encode
    with. Texts that hold the string of a special token go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


@cache
def _encoder(path: str, ranks: str, pattern: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, ranks, pattern)


_PIECE = "doc_id long, piece int, start long, length long, ids binary, part int, rank long"


def token_pieces(
    docs: DataFrame, tokenizer: tuple[str, str, str], capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids (little-endian uint32).

    A document is the ids of its whole text (a null text is empty) and ``end_id``. Documents of
    more ids are cut into pieces of ``capacity``, of which the first may be shorter. ``part`` and
    ``rank`` number the pieces of a length within a task, from 0. ``tokenizer``: the tokenizer
    file, its rank file and its pattern, which every executor can read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(*tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at = 0
            for texts in chunks(batch["text"].tolist()):
                out = []
                own = batch["doc_id"].iloc[at : at + len(texts)].tolist()
                for doc_id, text in zip(own, texts, strict=True):
                    ids = encode(text) + end
                    n, start, piece = len(ids) // 4, 0, 0
                    while start < n:
                        size = n % capacity if not start and n % capacity else capacity
                        out.append((doc_id, piece, start, size, ids[4 * start : 4 * (start + size)], part, seen[size]))
                        seen[size] += 1
                        start += size
                        piece += 1
                at += len(texts)
                frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids", "part", "rank"])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    return rows.mapInPandas(pieces, _PIECE)


def plan_places(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Which ranks of a length go where: length, low and high rank, first sequence, offset.

    The piece of rank r, low <= r < high, goes to sequence ``sequence + r - low``.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(capacity + 1, np.int64)
    lengths = np.arange(capacity + 1)
    groups: list[tuple[int, int, int]] = []  # gap, sequences, first sequence
    plan: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, n: int, first: int, offset: int) -> None:
        plan.append((length, used[length], used[length] + n, first, offset))
        used[length] += n
        left[length] -= n

    while left.any():
        placed = False
        groups.sort()
        after: list[tuple[int, int, int]] = []
        opened: list[int] = []  # lengths seen by the upward sweep, longest last
        seen = 0
        for gap, n, first in groups:
            opened.extend(x for x in range(seen + 1, gap + 1) if left[x])
            seen = max(seen, gap)
            while n:
                while opened and not left[opened[-1]]:
                    opened.pop()
                if not opened:
                    after.append((gap, n, first))
                    break
                length = opened[-1]
                take = int(min(n, left[length]))
                place(length, take, first, capacity - gap)
                placed = True
                if gap > length:
                    after.append((gap - length, take, first))
                n -= take
                first += take
        groups = after
        if not placed and left.any():
            need = int(-(-(left * lengths).sum() // capacity))
            for length in range(capacity, 0, -1):
                take = int(min(need, left[length]))
                if take:
                    place(length, take, sequences, 0)
                    if length < capacity:
                        groups.append((capacity - length, take, sequences))
                    sequences += take
                    need -= take
    return pd.DataFrame(plan, columns=["length", "low", "high", "sequence", "offset"]).astype("int64")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """All columns of the pieces but part and rank, with sequence_id and offset; every piece has one place.

    ``pieces`` is a written table with length, part and rank as :func:`token_pieces` gives
    them. Lengths lie between 1 and ``capacity``. No pieces give no rows.
    """
    sizes = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per length and task
    offsets = stored(
        sizes.select("part", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "offsets"
    )
    counts = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_places(counts, capacity)
    lows = {k: g for k, g in plan.groupby("length")}

    @F.pandas_udf("sequence_id long, offset long")
    def placed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for length, rank in batches:
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size, own in rank.groupby(length.to_numpy()).indices.items():
                ways = lows[size]
                ranks = rank.to_numpy()[own]
                at = np.searchsorted(ways["low"].to_numpy(), ranks, side="right") - 1
                sequence[own] = ways["sequence"].to_numpy()[at] + ranks - ways["low"].to_numpy()[at]
                offset[own] = ways["offset"].to_numpy()[at]
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # the offsets grow with the tasks: never broadcast
    ranked = pieces.join(offsets.select("part", "length", "before").hint("merge"), ["part", "length"])
    found = ranked.withColumn("place", placed("length", F.col("rank") + F.col("before")))
    return found.select(
        *[c for c in pieces.columns if c not in ("part", "rank")], "place.sequence_id", "place.offset"
    )
