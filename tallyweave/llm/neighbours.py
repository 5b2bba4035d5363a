"""Approximate nearest neighbours by several shifted Hilbert orderings.

Vectors are rotated at random, shifted and cut to a few coordinates, whose Hilbert key orders
them; Spark range-partitions every ordering into blocks of neighbouring keys. A query meets
its own block and those around it in every ordering, and its best candidates are merged. How
many blocks around are needed is measured: a bounded sample of queries is compared with all
vectors, and the window is the smallest that finds the wanted share of their true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.tables import least_hashed, stored

CURVES = 6
DIMENSIONS = 6
DEPTH = 10
BLOCK_ROWS = 2048
#: Queries compared with all vectors to set the window, and the share of their neighbours to be found.
MEASURED = 100
WANTED = 0.97
#: Cosines that agree to so many decimals tie.
TIE_DECIMALS = 12


def hilbert_keys(cells: np.ndarray, depth: int) -> np.ndarray:
    """Position on the Hilbert curve of cells (rows, dimensions) of ``depth`` bits (Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (depth - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (depth - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(depth - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


def _scaled(vectors: pd.Series) -> np.ndarray:
    """The vectors times a power of two each, which loses no bit, so that no square overflows."""
    x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 1))
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = _scaled(vectors)
    return x / _norms(x)[:, None]


def _top(query: pd.DataFrame, data: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` other ids of ``data`` for every query row; data rows may stand for several equal vectors.

    A block may hold one vector once for each curve: it counts once, so that ``k`` ids are ``k`` neighbours.
    """
    data = data[~data["ids"].map(lambda own: own[0]).duplicated()]
    a, b = _scaled(query["embedding"]), _scaled(data["embedding"])
    long_a, long_b = _norms(a), _norms(b)
    lists = [np.asarray(x) for x in data["ids"]]
    out = []
    for at in range(0, len(a), 256):
        s = (a[at : at + 256] / long_a[at : at + 256, None]) @ (b / long_b[:, None]).T
        few = min(k + 1, s.shape[1])
        best = np.argpartition(-s, few - 1, axis=1)[:, :few]
        # all that tie with the last one stay
        last = np.take_along_axis(s, best, 1).min(axis=1)
        for i, qid in enumerate(query["vec_id"].iloc[at : at + 256]):
            found = np.flatnonzero(s[i] >= last[i] - 4 * 10.0**-TIE_DECIMALS)
            # once more, each pair by itself: the last bits of a matrix product depend on its other rows
            score = (b[found] * a[at + i]).sum(axis=1) / (long_b[found] * long_a[at + i])
            rows = [(-round(c, TIE_DECIMALS), int(v), c) for j, c in zip(found, score.tolist()) for v in lists[j] if v != qid]
            out += [(qid, v, c) for _, v, c in sorted(rows)[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", TIE_DECIMALS)), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, every: int = 50, k: int = 5, curves: int = CURVES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest cosines found for ids divisible by ``every``.

    Equal vectors are one row with their ``k + 1`` smallest ids. Rows with a null id, or vectors
    that are null, empty, zero, of another length than most, or hold null or non-finite
    components, take no part. Repeated rows of an id and vector count once.
    """
    parts = F.col("embedding")
    good = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), parts.cast("array<double>").alias("embedding"))
    valid = valid.where(F.col("vec_id").isNotNull() & good & F.exists(parts, lambda x: x != 0)).distinct()
    sizes = valid.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = sizes[0]["n"]
    valid = valid.where(F.size("embedding") == width)
    order = Window.partitionBy("embedding").orderBy("vec_id")
    least = valid.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    data = stored(least.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    queries = stored(valid.where(F.col("vec_id") % every == 0), "queries")
    rng = np.random.default_rng(41)
    spins = [np.linalg.qr(rng.normal(size=(width, width)))[0][:, :DIMENSIONS] for _ in range(curves)]
    shifts = rng.uniform(0, 1, (curves, DIMENSIONS))
    cells = 1 << DEPTH

    @F.pandas_udf("array<long>")
    def keys(embedding: pd.Series) -> pd.Series:
        x = _unit(embedding)
        own = []
        for spin, shift in zip(spins, shifts, strict=True):
            at = (x @ spin) * np.sqrt(width) / 8 + 0.5 + shift / 4 - 0.125
            own.append(hilbert_keys(np.clip(at * cells, 0, cells - 1), DEPTH))
        return pd.Series(list(np.stack(own, axis=1)))

    rows = data.count()
    blocks = max(1, -(-rows * curves // block_rows))
    keyed = stored(data.select("embedding", "ids", F.posexplode(keys("embedding")).alias("curve", "key")), "keys")
    placed = keyed.repartitionByRange(blocks, "curve", "key", F.col("ids")[0]).withColumn("block", F.spark_partition_id())
    placed = stored(placed.select("curve", "block", "embedding", "ids"), "blocks")

    # the window: how far, in blocks of the best curve, true neighbours of the measured queries are
    sample = least_hashed(queries, MEASURED, F.xxhash64("vec_id"), "vec_id").toPandas()
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield _top(sample, batch, k)

    found = "query_id long, vec_id long, score double"
    true = _best(data.mapInPandas(compare, found), k).select("query_id", "vec_id")
    where = placed.select("curve", "block", F.explode("ids").alias("id"))
    near = true.join(where.select("curve", F.col("block").alias("to"), F.col("id").alias("vec_id")), "vec_id")
    own = queries.join(placed.select("embedding", "curve", F.col("block").alias("from")), "embedding")
    own = own.select("curve", "from", F.col("vec_id").alias("query_id"))
    apart = near.join(own, ["curve", "query_id"]).groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("to") - F.col("from"))).alias("d"))
    # no more rows than MEASURED times k
    distances = np.sort([r["d"] for r in apart.select("d").collect()])
    window = int(distances[min(len(distances) - 1, int(np.ceil(WANTED * len(distances))))]) if len(distances) else 0

    # a query goes to the blocks around its own; its vector is looked up there by block
    asked = queries.join(placed.select("embedding", F.col("block").alias("from")), "embedding")
    asked = asked.select(
        "vec_id", "embedding", F.explode(F.sequence(F.col("from") - window, F.col("from") + window)).alias("block")
    ).dropDuplicates(["vec_id", "block"])

    def meet(query: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(query) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return _top(query, block, k)

    met = asked.groupBy("block").cogroup(placed.groupBy("block")).applyInPandas(meet, found)
    return _best(met, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
