"""Prefix trie of conversations by vertical bitmaps.

Conversations are dealt to shards of neighbouring ids, and long ones to bands of consecutive
positions. In a shard every (position, turn) has a posting, a bitset of the conversations that
hold the turn there. A node is the bitset of its members; walking depth first, the lowest member
that is left names a turn, and the parent's bitset intersected with that turn's posting is a
child. Popcounts, members and end lists of the shards meet under a 128-bit hash of the prefix.

Sums over subtrees need no second walk: what a node saves belongs to its smallest member, so a
node's sum is what all its members own, without what the smallest one owns above it.

Turns are told apart by two 64-bit hashes of role and text; the texts are read once and not
shuffled. No task holds more than a shard's band: a very long conversation is many bands, a
turn that very many conversations share is one row a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.tables import shuffle_partitions, stored



@dataclass(frozen=True)
class Sizes:
    """Conversations and turns of a shard, positions of a band. They place the work and change no result."""

    conversations: int = 2048
    turns: int = 1 << 15
    band: int = 512


SIZES = Sizes()
#: A parent of more than this share of all nodes is a hot one; there are at most so many.
HOT_PARENTS = 4096
#: Every conversation starts with up to three turns of the one whose id is the multiple of 20 below.
FAMILY = 20
WORD = r"[^\x20\x09-\x0D]+"


def ordered_turns(turns: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """conv_id, pos (from 0), two hashes of the turn, its words, and the shard (block, sub) of the conversation.

    Turns go by ``turn``, nulls first, then role and hash; repeated rows are repeated turns. They are
    range-partitioned by all of that and a random number fixed in a written table, so neither a
    long conversation nor copies of one row have to fit into a task. A conversation that goes on in
    further partitions is numbered on from the counts before; it belongs to the shard it began in.
    """
    spark = turns.sparkSession
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = stored(
        turns.where(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long").alias("conv_id"),
            "turn",
            role.alias("role"),
            F.xxhash64(F.lit(1), role, text).alias("a"),
            F.xxhash64(F.lit(2), text, role).alias("b"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
            F.rand(5).alias("any"),
        ),
        "turns",
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("a"), F.col("b"), F.col("any")]
    dealt = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    local = dealt.withColumn("pid", F.spark_partition_id()).select("conv_id", "a", "b", "words", "pid")
    local = stored(
        local.mapInPandas(
            lambda batches: _numbered(batches, sizes), "conv_id long, a long, b long, words long, pid int, pos long, sub long"
        ),
        "turns",
    )
    parts = local.groupBy("conv_id", "pid").agg(F.count("*").alias("n"), F.min("sub").alias("sub"))
    along = Window.partitionBy("conv_id").orderBy("pid")
    parts = parts.select(
        "conv_id",
        "pid",
        "n",
        F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("conv_id")).alias("total"),
        F.first("pid").over(along).alias("block"),
        F.first("sub").over(along).alias("first_sub"),
    )
    # only the first and the last conversation of a partition can span partitions
    spanning = parts.where(F.col("n") != F.col("total")).drop("n", "total")
    found = local.join(F.broadcast(spanning), ["conv_id", "pid"], "left")
    return found.select(
        "conv_id",
        (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"),
        "a",
        "b",
        "words",
        F.coalesce("block", "pid").alias("block"),
        F.coalesce("first_sub", "sub").alias("sub"),
    )


def _numbered(batches: Iterator[pd.DataFrame], sizes: Sizes) -> Iterator[pd.DataFrame]:
    """Positions of turns in their conversation and the shard of each, from sorted rows of one partition."""
    last, place, rows, convs, shard = None, 0, 0, -1, 0
    for batch in batches:
        if not len(batch):
            continue
        own = batch["conv_id"].to_numpy()
        fresh = np.ones(len(own), bool)
        fresh[1:] = own[1:] != own[:-1]
        fresh[0] = last is None or own[0] != last
        at = np.arange(len(own))
        begun = np.maximum.accumulate(np.where(fresh, at, -1))
        pos = np.where(begun < 0, at + place, at - begun)
        number = convs + np.cumsum(fresh)
        subs = np.where(begun < 0, shard, number // sizes.conversations + (rows + np.maximum(begun, 0)) // sizes.turns)
        last, place, convs, shard = own[-1], int(pos[-1]) + 1, int(number[-1]), int(subs[-1])
        rows += len(own)
        yield batch.assign(pos=pos, sub=subs)


def rebuilt(rows: DataFrame, sizes: Sizes = SIZES) -> tuple[DataFrame, DataFrame]:
    """The conversations, with the turns they are made of: up to h of their family's first, then their own after h.

    First result: conv_id, block, sub, length. Second: a row a turn, with length and the lanes x and y
    of a hash of position and turn.
    """
    first = rows.where((F.col("pos") < 3) & (F.col("conv_id") % FAMILY == 0))
    # three turns at most
    first = first.groupBy(F.col("conv_id").alias("family")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "a", "b", "words"))).alias("head")
    )
    convs = rows.groupBy("conv_id").agg(
        F.count("*").alias("total"), F.min("block").alias("block"), F.min("sub").alias("sub")
    )
    convs = convs.withColumns(
        {
            "family": F.col("conv_id") - F.col("conv_id") % FAMILY,
            "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"),
        }
    ).join(first, "family", "left")
    head = F.slice(F.coalesce("head", F.array().cast(first.schema["head"].dataType)), F.lit(1), F.col("h"))
    convs = convs.withColumn("head", head).withColumn("n_head", F.size("head"))
    convs = stored(convs.withColumn("length", F.col("n_head") + F.greatest(F.col("total") - F.col("h"), F.lit(0))), "convs")
    begun = convs.select("conv_id", "block", "sub", "length", F.explode("head").alias("t")).select(
        "conv_id", "block", "sub", "length", "t.pos", "t.a", "t.b", "t.words"
    )
    bands = F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / sizes.band))
    by_band = convs.select("conv_id", "length", (F.col("n_head") - F.col("h")).alias("shift"), F.explode(bands).alias("old"))
    own = rows.where(F.col("pos") >= F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4)
    own = own.withColumn("old", F.floor(F.col("pos") / sizes.band)).join(by_band, ["conv_id", "old"])
    own = own.select("conv_id", "block", "sub", "length", (F.col("pos") + F.col("shift")).alias("pos"), "a", "b", "words")
    turns = begun.unionByName(own).select(
        "conv_id",
        "block",
        "sub",
        "length",
        "pos",
        F.floor(F.col("pos") / sizes.band).alias("band"),
        F.xxhash64(F.lit(1), "pos", "a", "b").alias("x"),
        F.xxhash64(F.lit(2), "pos", "b", "a").alias("y"),
        "words",
    )
    return convs.select("conv_id", "block", "sub", "length"), stored(turns, "rebuilt")


def _with_starts(convs: DataFrame, turns: DataFrame, sizes: Sizes) -> DataFrame:
    """The turns and, before each conversation's first turn of a band, a row with the hash of its prefix up to there."""
    zero = F.lit(0).cast("long")
    root = convs.select("*", (zero - 1).alias("pos"), zero.alias("band"), zero.alias("x"), zero.alias("y"), zero.alias("words"))
    sums = turns.where(F.col("length") > sizes.band).groupBy("conv_id", "block", "sub", "length", "band")
    sums = sums.agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    above = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    later = sums.select(
        "conv_id", "block", "sub", "length", "band", F.bit_xor("x").over(above).alias("x"), F.bit_xor("y").over(above).alias("y")
    ).where(F.col("band") > 0)
    later = later.withColumns({"pos": F.col("band") * sizes.band - 1, "words": zero})
    return turns.unionByName(root).unionByName(later)


NODES = (
    "block int, sub long, x long, y long, px long, py long, depth long, words long, convs array<long>, ends array<long>"
)


def shard_nodes(unit: pd.DataFrame, sizes: Sizes = SIZES) -> pd.DataFrame:
    """Nodes of one band of one shard: prefix hash, parent's hash, members and the members that end there."""
    unit = unit.sort_values(["conv_id", "pos"], kind="stable")
    conv, pos, length = (unit[c].to_numpy() for c in ("conv_id", "pos", "length"))
    x, y, words = (unit[c].to_numpy() for c in ("x", "y", "words"))
    begin = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    end = np.append(begin[1:], len(conv))
    n = len(begin)
    ids, lengths = conv[begin], length[begin]
    base, limit = int(pos[begin[0]]) + 1, int(unit["band"].iloc[0] + 1) * sizes.band
    segment = np.repeat(np.arange(n), end - begin)

    def rolled(lane: np.ndarray) -> np.ndarray:
        total = np.bitwise_xor.accumulate(lane)
        return total ^ np.concatenate([[0], total])[begin][segment]

    px, py = rolled(x), rolled(y)
    # vertical bitmaps: the conversations that hold a turn at a position
    turn = np.flatnonzero(np.concatenate([[False], conv[1:] == conv[:-1]]))
    order = turn[np.lexsort((y[turn], x[turn], pos[turn]))]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1]) | (pos[order][1:] != pos[order][:-1])
    item = np.full(len(conv), -1)
    item[order] = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(order)))
    postings = {int(item[order[i]]): _bitset(segment[order[i : i + k]], n) for i, k in zip(first[size > 1], size[size > 1], strict=True)}
    stop: dict[int, int] = {}
    for d in np.unique(lengths[lengths < limit + 1]):
        stop[int(d)] = _bitset(np.flatnonzero(lengths == d), n)

    out, alone = [], []
    roots: dict[tuple[int, int], list[int]] = {}
    for c in range(n):
        roots.setdefault((int(px[begin[c]]), int(py[begin[c]])), []).append(c)
    stack = []
    for own in roots.values():
        members = _bitset(np.array(own), n)
        if base == 0:
            out.append((0, 0, None, None, 0, 0, members, members & stop.get(0, 0)))
        stack.append((members, base))
    while stack:
        members, depth = stack.pop()
        left = members & ~stop.get(depth, 0)
        if depth >= limit:
            continue
        while left:
            low = (left & -left).bit_length() - 1
            row = int(begin[low]) + 1 + depth - base
            child = left & postings.get(int(item[row]), 1 << low)
            left &= ~child
            if child & (child - 1):
                at = (int(px[row]), int(py[row]), int(px[row - 1]), int(py[row - 1]), depth + 1, int(words[row]))
                out.append((*at, child, child & stop.get(depth + 1, 0)))
                stack.append((child, depth + 1))
            else:
                alone.append((row, int(end[low])))
    # what only one conversation goes through: its remaining turns are its nodes
    spans = np.array(alone, np.int64).reshape(-1, 2)
    many = spans[:, 1] - spans[:, 0]
    rows = np.repeat(spans[:, 0] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    single = pd.DataFrame(
        {"x": px[rows], "y": py[rows], "px": px[rows - 1], "py": py[rows - 1], "depth": pos[rows] + 1, "words": words[rows]}
    )
    single["convs"] = conv[rows][:, None].tolist()
    single["ends"] = [own if last else [] for own, last in zip(single["convs"], length[rows] == pos[rows] + 1, strict=True)]
    names = ("x", "y", "px", "py", "depth", "words", "convs", "ends")
    # a column with a null must not pass through floating point
    shared = pd.DataFrame({c: pd.Series([row[i] for row in out], dtype=object) for i, c in enumerate(names)})
    for c in names[:-2]:
        shared[c] = pd.array(shared[c].tolist(), dtype="Int64")
        single[c] = single[c].astype("Int64")
    for c in ("convs", "ends"):
        shared[c] = [ids[_members(b, n)].tolist() for b in shared[c]]
    nodes = pd.concat([shared, single], ignore_index=True) if len(shared) else single
    nodes.insert(0, "sub", unit["sub"].iloc[0])
    nodes.insert(0, "block", unit["block"].iloc[0])
    return nodes


def _bitset(members: np.ndarray, n: int) -> int:
    mask = np.zeros(n, bool)
    mask[members] = True
    return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")


def _members(bits: int, n: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes(-(-n // 8), "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _end_digests(nodes: DataFrame) -> DataFrame:
    """SHA-256 of each node's end list: shards hold neighbouring ids, so their lists follow one another.

    The digest of one list is one sequence of steps: the lists of a node pass through one task as a stream,
    in rows of one shard's ids, and are never held together.
    """
    lists = nodes.where(F.size("ends") > 0).select("x", "y", "block", "sub", F.array_join(F.col("ends").cast("array<string>"), ",").alias("ends"))
    dealt = lists.repartition(shuffle_partitions(nodes.sparkSession), "x", "y").sortWithinPartitions("x", "y", "block", "sub")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, done = None, None, []
        for batch in batches:
            for a, b, text in zip(batch["x"].tolist(), batch["y"].tolist(), batch["ends"].tolist(), strict=True):
                if last == (a, b):
                    state.update(b"," + text.encode())
                    continue
                if last is not None:
                    done.append((*last, state.hexdigest()))
                last, state = (a, b), hashlib.sha256(text.encode())
            if done:
                yield pd.DataFrame(done, columns=["x", "y", "ends_sha256"])
                done = []
        if last is not None:
            yield pd.DataFrame([(*last, state.hexdigest())], columns=["x", "y", "ends_sha256"])

    return dealt.mapInPandas(digests, "x long, y long, ends_sha256 string")


def prefix_trie(turns: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """One row a node of the trie of all rebuilt conversations, the textless root at depth 0.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members),
    n_children, n_leaves (childless nodes in the subtree, itself included), saved_tokens (over the subtree,
    words of a node's last text times its members but one), ends_sha256 (digest of the ids that end there).
    A null role or text is empty; null turns come first; turns of one number are ordered by role and
    hash; repeated rows are repeated turns; rows without a conv_id are left out; equal conversations
    end at one node; other columns are ignored. Without conversations there is no node, not even a root.
    """
    convs, rows = rebuilt(ordered_turns(turns, sizes), sizes)
    units = _with_starts(convs, rows, sizes).groupBy("block", "sub", "band")
    local = stored(units.applyInPandas(lambda unit: shard_nodes(unit, sizes), NODES), "nodes")
    merged = local.groupBy("x", "y").agg(
        F.min(F.element_at("convs", 1)).alias("owner"),
        F.sum(F.size("convs").cast("long")).alias("n_convs"),
        *[F.max(c).alias(c) for c in ("depth", "words", "px", "py")],
    )
    merged = stored(merged, "merged")
    kids = merged.where(F.col("depth") > 0).groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = merged.join(kids, ["x", "y"], "left").withColumns(
        {
            "n_children": F.coalesce("n_children", F.lit(0).cast("long")),
            "saved": (F.col("n_convs") - 1) * F.col("words"),
            "band": F.floor(F.col("depth") / sizes.band),
        }
    )
    nodes = stored(nodes, "nodes")
    leaf = (F.col("n_children") == 0).cast("long")
    owned = nodes.where((F.col("saved") > 0) | (F.col("n_children") == 0)).groupBy(F.col("owner").alias("conv_id"))
    owned = owned.agg(F.sum("saved").alias("total"), F.sum(leaf).alias("leaves"))
    # by band too, so that a long conversation meets its nodes in many tasks
    owned = owned.join(convs, "conv_id").select(
        "conv_id", "total", "leaves", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / sizes.band))).alias("band")
    )
    shared = nodes.where(F.col("n_convs") > 1)
    through = local.join(shared.select("x", "y"), ["x", "y"], "left_semi")
    through = through.select("x", "y", F.floor(F.col("depth") / sizes.band).alias("band"), F.explode("convs").alias("conv_id"))
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    facts = through.join(owned, ["conv_id", "band"]).select("x", "y", "total", "leaves", zero.alias("above"), none.alias("ends_sha256"))
    own = Window.partitionBy("owner", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    bands = shared.groupBy("owner", "band").agg(F.sum("saved").alias("saved"))
    earlier = Window.partitionBy("owner").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("owner", "band", F.sum("saved").over(earlier).alias("earlier"))
    above = shared.select("x", "y", "owner", "band", F.sum("saved").over(own).alias("here")).join(bands, ["owner", "band"])
    above = above.select(
        "x",
        "y",
        zero.alias("total"),
        zero.alias("leaves"),
        (F.coalesce("here", zero) + F.coalesce("earlier", zero)).alias("above"),
        none.alias("ends_sha256"),
    )
    ended = _end_digests(local).select("x", "y", zero.alias("total"), zero.alias("leaves"), zero.alias("above"), "ends_sha256")
    facts = facts.unionByName(above).unionByName(ended).groupBy("x", "y").agg(
        F.sum("total").alias("total"), F.sum("leaves").alias("leaves"), F.sum("above").alias("above"), F.max("ends_sha256").alias("ends_sha256")
    )
    found = _with_parent(nodes).join(facts, ["x", "y"], "left")
    alone = F.col("n_convs") == 1
    return found.select(
        F.col("owner").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"),
        F.when(alone, zero).otherwise(F.col("total") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _with_parent(nodes: DataFrame) -> DataFrame:
    """The nodes with their parent's smallest member; the children of hot parents are not brought together."""
    parents = nodes.where(F.col("n_children") > 0).select(
        F.col("x").alias("px"), F.col("y").alias("py"), F.col("owner").alias("parent_conv_id"), "n_children"
    )
    least = max(HOT_PARENTS, -(-nodes.count() // HOT_PARENTS))
    hot = parents.where(F.col("n_children") > least).drop("n_children").withColumnRenamed("parent_conv_id", "hot")
    # each of them has more than one in HOT_PARENTS of all nodes as children
    marked = nodes.join(F.broadcast(hot), ["px", "py"], "left")
    rest = parents.where(F.col("n_children") <= least).drop("n_children")
    joined = marked.where(F.col("hot").isNull() & F.col("px").isNotNull()).join(rest, ["px", "py"])
    other = marked.where(F.col("hot").isNotNull() | F.col("px").isNull()).withColumn("parent_conv_id", F.col("hot"))
    return joined.unionByName(other).drop("hot")


ORACLE_SQL = r"""
WITH said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS family,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]),
        lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM said)
), heads AS (
  SELECT c.conv_id, s.pos, s.role, s.text FROM convs c JOIN said s ON s.conv_id = c.family AND s.pos < c.h
), n_heads AS (
  SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id
), rebuilt AS (
  SELECT * FROM heads
  UNION ALL
  SELECT s.conv_id, s.pos - c.h + coalesce(n.n, 0), s.role, s.text
  FROM said s JOIN convs c USING (conv_id) LEFT JOIN n_heads n USING (conv_id) WHERE s.pos >= c.h
), rolled AS (
  SELECT conv_id, pos + 1 AS depth, text,
    sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
      OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS node
  FROM rebuilt
), paths AS (
  SELECT conv_id, 0 AS depth, '' AS text, 'root' AS node, NULL AS parent FROM convs
  UNION ALL
  SELECT conv_id, depth, text, node, lag(node, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) FROM rolled
), nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words
  FROM paths GROUP BY node
), kids AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT p.node, sum((v.n_convs - 1) * v.words) AS saved_tokens, count(*) FILTER (v.node NOT IN (SELECT node FROM kids)) AS n_leaves
  FROM nodes v JOIN paths p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.node
), ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM paths) WHERE depth = last GROUP BY node
)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, q.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
  coalesce(k.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens,
  coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes q ON q.node = n.parent LEFT JOIN kids k ON k.node = n.node
  JOIN sums s ON s.node = n.node LEFT JOIN ends e ON e.node = n.node
"""
