"""MinHash near-duplicates by SetSketch registers.

A SetSketch (Ertl, 2021) of a set keeps, for each register, the smallest of exponentially
distributed hashes of its elements, truncated to a power of a base near 1. The register of a
union is the greater of two registers, so parts of a long text are sketched apart and merged,
and registers of two sets agree with about the probability of their Jaccard similarity.

Bands of register values bring similar sets together. In each bucket the smallest set meets all
others; how many registers are smaller, equal and greater gives the likelihood of every
similarity, and pairs whose registers could hardly come from similar sets are dropped. The rest is
verified on whole sets. Where a bucket still holds several components, its members are compared
across components in blocks, first by registers, then those that may be similar by their sets, the
most similar pairs first. So no pair of a bucket is passed over, and of what belongs together only
links that connect it are listed, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.components import components
from tallyweave.llm.tables import chunks, shuffle_partitions, stored

SHINGLE = 2
#: Links have 100 times the intersection at least this often the union.
PERCENT = 80
#: Base and rate of the registers.
BASE = 1.001
RATE = 20.0
#: Bands of registers; four registers of 16 bits are one number.
BANDS = 40
ROWS = 4
#: A pair is dropped if similarities too small explain its registers better by this factor's logarithm.
SLACK = 20.0
#: Members of a bucket that are compared with as many others at once.
BLOCK = 1024
#: Up to so many documents are named to all tasks that read texts, beyond it texts and names are shuffled.
BROADCAST_ROWS = 100_000
#: Elements that are sketched at once.
ELEMENTS = 1 << 12


@dataclass(frozen=True)
class Shape:
    """Bands, and how the hashes of their registers are drawn."""

    bands: int = BANDS
    seed: int = 42

    @property
    def registers(self) -> int:
        return self.bands * ROWS

    def factors(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return rng.integers(1, 1 << 63, (2, self.registers), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


SHAPE = Shape()
Sets = Callable[[DataFrame], DataFrame]


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of ``shingle`` words, ASCII letters lowered; of all words if fewer, sorted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    found = [digest(joined[a:b]) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def sketches(sets: list[np.ndarray], shape: Shape = SHAPE) -> np.ndarray:
    """Registers of each set, a row of 16-bit numbers; zeros for an empty one."""
    first, second = shape.factors()
    out = np.zeros((len(sets), shape.registers), np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets).view(np.uint64) if len(owner) else np.zeros(0, np.uint64)
    for at in range(0, len(flat), ELEMENTS):
        own = owner[at : at + ELEMENTS]
        mixed = flat[at : at + ELEMENTS, None] * first[None, :]
        mixed ^= mixed >> np.uint64(31)
        mixed *= second[None, :]
        high = (mixed >> np.uint64(32)).astype(np.uint32)
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        # the greatest uniform number gives the smallest exponential one; a set cut in two is merged
        out[own[begin]] = np.maximum(out[own[begin]], np.maximum.reduceat(high, begin, axis=0))
    least = -np.log((out.astype(np.float64) + 0.5) / 2.0**32) / RATE
    values = np.floor(1 - np.log(least) / np.log(BASE))
    values[sizes == 0] = 0
    return np.clip(values, 0, 65535).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sketched sets."""
    return np.maximum(a, b)


def log_likelihood(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Logarithm of the likelihood of each similarity (a column each) for rows of registers of sets of known sizes."""
    more = (a > b).sum(axis=1)[:, None]
    less = (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (sizes_a / (sizes_a + sizes_b))[:, None]
    v = 1 - u
    j = np.minimum(similarity, np.minimum(u, v) / np.maximum(u, v))

    def share(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    p, q = share(u - v * j), share(v - u * j)
    tiny = 1e-12
    return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))


def estimated(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, steps: int = 200) -> np.ndarray:
    """The similarity of greatest likelihood among ``steps`` even ones."""
    grid = np.linspace(0, 1, steps + 1)
    return grid[np.argmax(log_likelihood(a, b, sizes_a, sizes_b, grid[None, :]), axis=1)]


def likely(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether registers may come from sets of a similarity of ``percent`` or more."""
    cut = percent / 100
    grid = np.concatenate([cut * np.linspace(0.5, 1, 6), np.linspace(cut, 1, 4)])
    found = log_likelihood(a, b, sizes_a, sizes_b, grid[None, :])
    return found[:, :6].max(axis=1) - found[:, 6:].max(axis=1) <= SLACK


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with hashes of both, by which a document is found again."""
    return docs.select(
        "doc_id",
        "text",
        F.xxhash64("doc_id").alias("k"),
        F.xxhash64(F.lit(1), "text").alias("a"),
        F.xxhash64("text", F.lit(2)).alias("b"),
    )


def with_sketch(docs: DataFrame, shingle: int = SHINGLE, shape: Shape = SHAPE) -> DataFrame:
    """doc_id, hashes of it and of the text (k, a, b), n_shingles, digest of the set and its registers, a row a document."""
    key = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = f"doc_id {key}, k long, a long, b long, n_shingles long, digest binary, registers binary"

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = 0
            for part in chunks(["" if t is None else t for t in batch["text"]]):
                sets = [shingle_set(t, shingle) for t in part]
                rows = batch.iloc[done : done + len(part)].drop(columns="text")
                done += len(part)
                yield rows.assign(
                    n_shingles=[len(s) for s in sets],
                    digest=[hashlib.md5(s.tobytes()).digest() for s in sets],
                    registers=[r.tobytes() for r in sketches(sets, shape)],
                )

    return _keyed(docs).select("doc_id", "k", "a", "b", "text").mapInPandas(sketch, schema)


def _sets_of(docs: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """rid and shingles of the asked documents (rid, k, a, b): their texts are read again, sets are kept for no others."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rid": batch["rid"], "shingles": [shingle_set(t, shingle) for t in batch["text"]]})

    # four numbers a row; more of them than this meet the texts in a shuffle
    near = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    texts = _keyed(docs).join(near, ["k", "a", "b"]).select("rid", "text")
    return texts.mapInPandas(build, "rid long, shingles array<long>").dropDuplicates(["rid"])


def _bands(sketched: DataFrame, shape: Shape) -> DataFrame:
    """band, key, rid: a row a band, whose registers are the key."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            keys = np.frombuffer(b"".join(batch["registers"]), np.int64)
            yield pd.DataFrame(
                {
                    "band": np.tile(np.arange(shape.bands), len(batch)),
                    "key": keys,
                    "rid": np.repeat(batch["rid"].to_numpy(), shape.bands),
                }
            )

    return sketched.select("rid", "registers").mapInPandas(spread, "band int, key long, rid long")


def _verified(pairs: DataFrame, sketched: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """The pairs (u, v) that reach the similarity, first by registers, then on whole sets."""

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (a, b))
        return pd.Series(likely(x, y, n.to_numpy(float), m.to_numpy(float), percent)) if len(a) else pd.Series([], dtype=bool)

    def side(name: str) -> DataFrame:
        return sketched.select(F.col("rid").alias(name), F.col("registers").alias(f"registers_{name}"), F.col("n").alias(f"n_{name}"))

    pairs = pairs.join(side("u"), "u").join(side("v"), "v")
    pairs = pairs.where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent)
    pairs = stored(pairs.where(may("registers_u", "registers_v", "n_u", "n_v")).select("u", "v"), "pairs")
    asked = stored(sets(pairs.select(F.explode(F.array("u", "v")).alias("rid")).distinct()), "sets")
    for name in ("u", "v"):
        pairs = pairs.join(asked.select(F.col("rid").alias(name), F.col("shingles").alias(f"shingles_{name}")), name)
    common = F.size(F.array_intersect("shingles_u", "shingles_v"))
    return pairs.where(common * 100 >= (F.size("shingles_u") + F.size("shingles_v") - common) * percent).select("u", "v")


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each value of the keys, from sorted rows."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        place = rows[keys].to_numpy()
        cut = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in zip(cut, cut[1:], strict=False):
            yield rows.iloc[a:b]
        # the last run may go on
        held = rows.iloc[cut[-1] :]
    if held is not None:
        yield held


def _likely_pairs(rows: pd.DataFrame, regs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of a pair of blocks that are of different components and that their registers allow."""
    ids, sizes, comps, blocks = (rows[c].to_numpy() for c in ("rid", "n", "comp", "block"))
    band, one, two = (int(rows[c].iloc[0]) for c in ("band", "one", "two"))
    values = regs.view(np.int64)
    left, right = np.flatnonzero(blocks == one), np.flatnonzero(blocks == two)
    found = [np.zeros((2, 0), np.int64)]
    for at in range(0, len(left), 64):
        i, j = (x.ravel() for x in np.meshgrid(left[at : at + 64], right, indexing="ij"))
        ok = (comps[i] != comps[j]) & (np.minimum(sizes[i], sizes[j]) * 100 >= np.maximum(sizes[i], sizes[j]) * percent)
        if one == two:
            ok &= ids[i] < ids[j]
        i, j = i[ok], j[ok]
        # a pair belongs to the first band in which it meets
        own = ~(values[i, :band] == values[j, :band]).any(axis=1)
        i, j = i[own], j[own]
        own = likely(regs[i], regs[j], sizes[i].astype(float), sizes[j].astype(float), percent)
        found.append(np.stack([i[own], j[own]]))
    i, j = np.concatenate(found, axis=1)
    return i, j


def _across(rows: pd.DataFrame, percent: int) -> pd.DataFrame | None:
    """The rows that are in some likely pair."""
    if len(rows) < 2 or (rows["comp"] == rows["comp"].iloc[0]).all():
        return None
    regs = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(len(rows), -1)
    places = np.unique(np.concatenate(_likely_pairs(rows, regs, percent)))
    return rows.iloc[places].drop(columns="registers") if len(places) else None


def _joined(rows: pd.DataFrame, percent: int) -> pd.DataFrame | None:
    """Verified links that connect all components of the rows that any link connects, the most similar pairs first."""
    regs = np.frombuffer(b"".join(rows["registers"]), np.uint16).reshape(len(rows), -1)
    i, j = _likely_pairs(rows, regs, percent)
    order = np.argsort(-(regs[i] == regs[j]).sum(axis=1), kind="stable")
    sets, ids = rows["shingles"].tolist(), rows["rid"].to_numpy()
    label = np.unique(rows["comp"].to_numpy(), return_inverse=True)[1]
    links = []
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if label[a] == label[b]:
            continue
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            links.append((ids[a], ids[b]))
            label[label == label[b]] = label[a]
    return pd.DataFrame(links, columns=["u", "v"]) if links else None


def near_links(sketched: DataFrame, sets: Sets, percent: int = PERCENT, shape: Shape = SHAPE, block: int = BLOCK) -> DataFrame:
    """Links (u, v) with the components of all pairs that share a band and reach the similarity.

    ``sketched`` has rid, n and registers of distinct non-empty sets; ``sets`` gives rid and shingles of a table of rids.
    """
    spread = _bands(sketched, shape)
    buckets = spread.groupBy("band", "key").agg(F.count("*").alias("members"), F.min("rid").alias("pivot")).where(F.col("members") > 1)
    members = stored(spread.join(buckets, ["band", "key"]), "members")
    pairs = members.where(F.col("rid") != F.col("pivot")).select(F.col("pivot").alias("u"), F.col("rid").alias("v")).distinct()
    first = stored(_verified(pairs, sketched, sets, percent), "links")
    found = components(first.select(F.col("u").alias("src"), F.col("v").alias("dst"))).select(F.col("node").alias("rid"), "root")
    # what has met its pivot need not meet it again
    named = members.where((F.col("members") > 2) & (F.col("rid") != F.col("pivot"))).join(found, "rid", "left")
    named = stored(named.select("band", "key", "rid", F.coalesce("root", "rid").alias("comp")), "named")
    mixed = named.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = mixed.where(F.col("lo") != F.col("hi")).select("band", "key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rows = named.join(mixed, ["band", "key"]).join(sketched, "rid")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["band", "key", "one", "two"]
    rows = rows.select(
        "band", "key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "rid", "n", "comp", "registers"
    )

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)

    def each(judge):
        return lambda batches: (out for run in _runs(batches, keys) if (out := judge(run, percent)) is not None)

    near = stored(dealt(rows).mapInPandas(each(_across), rows.drop("registers").schema), "near")
    asked = stored(sets(near.select("rid").distinct()), "sets")
    near = near.join(asked.join(sketched.select("rid", "registers"), "rid"), "rid")
    return first.unionByName(dealt(near).mapInPandas(each(_joined), "u long, v long"))


def near_components(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, shape: Shape = SHAPE, block: int = BLOCK
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept of every document.

    Documents link if ``percent`` of the union of their shingle sets is common. Equal sets are one
    set before any comparison. A null text or one without a word has no shingle and links with
    nothing, not even with its like. Repeated rows stay repeated; a null doc_id names a component
    only if no other id is in it. Columns other than doc_id and text are ignored.
    """
    own = stored(with_sketch(docs, shingle, shape).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    groups = own.where(F.col("n_shingles") > 0).groupBy("digest").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first"))
    groups = stored(groups, "groups")
    distinct = own.join(groups.select("rid"), "rid", "left_semi")
    distinct = stored(distinct.select("rid", "k", "a", "b", F.col("n_shingles").alias("n"), "registers"), "registers")

    def sets(rids: DataFrame) -> DataFrame:
        asked = stored(distinct.select("rid", "k", "a", "b").join(rids, "rid", "left_semi"), "asked")
        return _sets_of(docs, asked, shingle)

    links = near_links(distinct.select("rid", "n", "registers"), sets, percent, shape, block)
    found = components(links.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    groups = groups.join(found.select(F.col("node").alias("rid"), "root"), "rid", "left").select("digest", "first", F.coalesce("root", "rid").alias("root"))
    lowest = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    named = groups.join(lowest, "root").select("digest", "component_id")
    # a set without shingles has no group; its digest is no other's
    rows = own.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    return rows.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM split
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS other FROM sets
  UNION
  SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.other
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) r ON r.node = s.doc_id
"""
