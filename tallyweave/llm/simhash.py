"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. If two fingerprints differ in at most ``distance`` bits,
some segment differs in at most ``distance // segments`` of them, so every fingerprint
probes, for each segment, a table with all segment values in that small Hamming ball. Table
entries that a probe meets are verified on all bits.

Only distinct fingerprints are probed. A segment value with many table entries is split
into blocks of entries, each met by all probes of the value, and a block returns a spanning
forest of the links it has seen, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.components import components
from tallyweave.llm.tables import chunks, shuffle_partitions, stored

SHINGLE = 4
DISTANCE = 4
SEED = 42
BITS = 64
#: Table entries of a segment value that are compared in one block.
BLOCK = 1024
#: Up to this many rows of a segment value, all rows are compared at once with their neighbours.
SMALL_RUN = 8
#: Characters of text hashed at once: their words make about 50 bytes of numbers a character for a moment.
HASH_CHARS = 1 << 17


def shingle_hashes(text: str, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of every run of ``shingle`` words, ASCII letters lowered; of all words if fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit fingerprints; zero for a null text or one without a word."""
    out = np.zeros(len(texts), np.int64)
    done = 0
    for part in chunks([t or "" for t in texts], HASH_CHARS):
        hashes = [shingle_hashes(t, shingle) for t in part]
        sizes = np.fromiter(map(len, hashes), np.int64, len(part))
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.fromiter((h for own in hashes for h in own), np.uint64, int(sizes.sum()))
            bits = np.unpackbits(flat.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            set_bits = (2 * votes > sizes[full][:, None]).astype(np.uint8)
            out[done + full] = np.packbits(set_bits, axis=1, bitorder="little").view("<i8")[:, 0]
        done += len(part)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """The documents with their fingerprint as a long."""

    @F.pandas_udf("long")
    def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(fingerprints_of(batch.tolist(), shingle))

    return docs.withColumn(name, fingerprint(F.col(text)))


def segments_for(fingerprints: int, distance: int = DISTANCE) -> int:
    """Segments of about as many bits as the number of fingerprints has, at most one more than the distance.

    Every count finds all links; it only trades probes against chance matches.
    """
    return int(np.clip(round(BITS / max(np.log2(max(fingerprints, 2)), 1.0)), 2, min(3, distance + 1)))


def ball(segments: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(segment mask, bits to flip in it) of all probes of a fingerprint, as signed longs."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    out = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        mask = (1 << high) - (1 << low)
        for flips in range(distance // segments + 1):
            for bits in combinations(range(low, high), flips):
                out.append((signed(mask), signed(sum(1 << b for b in bits))))
    return out


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= distance


def _forest(table: np.ndarray, probes: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """Links that connect whatever probes and table entries of a block are near each other."""
    label = np.arange(len(table))
    for at in range(0, len(probes), 2048):
        part = probes[at : at + 2048]
        who, entry = np.nonzero(_near(part[:, None], table[None, :], distance))
        if not len(who):
            continue
        _, first = np.unique(who, return_index=True)
        keep = [np.stack([part[who[first]], table[entry[first]]], axis=1)]
        anchor = np.zeros(len(part), np.int64)
        anchor[who[first]] = entry[first]
        while len(who := who[(open_ := label[anchor[who]] != label[entry])]):
            entry = entry[open_]
            a, b = anchor[who[0]], entry[0]
            keep.append(np.array([[part[who[0]], table[b]]]))
            label[label == label[b]] = label[a]
        links = np.concatenate(keep)
        yield links[links[:, 0] != links[:, 1]]


def _links(batches: Iterator[pd.DataFrame], distance: int) -> Iterator[pd.DataFrame]:
    """Verified links from rows sorted by (key, block), table entries first."""
    held = None
    for batch in batches:
        rows = {c: batch[c].to_numpy() for c in ("key", "block", "fp", "entry")}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        key, block, fp, entry = rows["key"], rows["block"], rows["fp"], rows["entry"]
        cut = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        sizes = ends - starts
        found = []
        run = np.repeat(np.arange(len(starts)), sizes)
        few = sizes[run] <= SMALL_RUN
        for step in range(1, SMALL_RUN):
            if len(fp) <= step:
                break
            same = few[step:] & (run[step:] == run[:-step]) & (entry[step:] | entry[:-step])
            at = np.flatnonzero(same)
            at = at[_near(fp[at], fp[at + step], distance) & (fp[at] != fp[at + step])]
            found.append(np.stack([fp[at], fp[at + step]], axis=1))
        for i in np.flatnonzero(sizes > SMALL_RUN):
            own = fp[starts[i] : ends[i]]
            table = own[entry[starts[i] : ends[i]]]
            if len(table):
                found.extend(_forest(np.unique(table), own, distance))
        # the last run may go on in the next batch: its table entries stay
        stay = np.flatnonzero(entry[starts[-1] :]) + starts[-1] if len(key) else []
        held = {c: rows[c][stay] for c in rows}
        if found:
            pairs = np.concatenate(found)
            if len(pairs):
                yield pd.DataFrame({"src": pairs.max(axis=1), "dst": pairs.min(axis=1)}).drop_duplicates()


def near_links(fps: DataFrame, distance: int = DISTANCE, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links (``src``, ``dst``) whose components are those of all pairs of distinct ``fp`` at most ``distance`` apart."""
    segments = segments or segments_for(fps.count(), distance)
    masks = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(e).alias("flip")) for m, e in ball(segments, distance)])
    probes = fps.select("fp", F.explode(masks).alias("p")).select(
        F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("key"),
        "fp",
        (F.col("p.flip") == 0).alias("entry"),
    )
    values = list(dict.fromkeys(m for m, _ in ball(segments, distance)))
    tables = fps.select(F.explode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in values])).alias("key"))
    large = tables.groupBy("key").count().where(F.col("count") > block)
    large = large.select("key", F.ceil(F.col("count") / F.lit(block // 2)).cast("int").alias("blocks"))
    split = probes.join(large, "key", "left")
    own = F.when(F.col("entry"), F.array(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # an entry sits in one block as entry and meets the other blocks as a probe
    rows = (
        split.select("key", "fp", "entry", F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(every).alias("b"), F.coalesce(own[0], F.lit(0)).alias("mine"))
        .select("key", "fp", "entry", "mine", F.explode("b").alias("block"))
        .select("key", "block", "fp", (F.col("entry") & (F.col("mine") == F.col("block"))).alias("entry"))
    )
    dealt = rows.repartition(shuffle_partitions(fps.sparkSession), "key", "block")
    dealt = dealt.sortWithinPartitions("key", "block", F.desc("entry"))
    return dealt.mapInPandas(lambda batches: _links(batches, distance), "src long, dst long")


def _rooted(fps: DataFrame, distance: int, segments: int | None) -> DataFrame:
    """Distinct fingerprints with the smallest one of their component."""
    roots = components(near_links(fps.select("fp"), distance, segments))
    return fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )


def near_groups(
    docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, segments: int | None = None
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every document.

    Fingerprints link at ``distance`` or fewer differing bits; ``component_id`` is the
    smallest doc_id reachable over links. Null and empty texts have fingerprint zero and
    are linked like any other. Repeated rows stay repeated; a null doc_id never names a
    component unless no other id is in it. Columns other than doc_id and text are ignored.
    """
    own = stored(with_fingerprint(docs.select("doc_id", "text"), shingle=shingle).select("doc_id", "fp"), "fp")
    fps = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    member = _rooted(fps, distance, segments)
    lowest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = member.select("fp", "root").join(lowest, "root").select(F.col("fp").alias("of"), "component_id")
    return own.join(named, own["fp"] == named["of"], "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id"
    )


def one_per_group(
    docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, segments: int | None = None
) -> DataFrame:
    """One row of every component: that of the smallest doc_id, nulls last, then of the smallest digest.

    Rows meet by a digest of all their columns and never by doc_id, which may be null or
    repeated. Equal rows are one row before they meet.
    """
    marked = docs.withColumn("digest", _digest(docs))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    own = with_fingerprint(marked.select("doc_id", "text", "digest"), shingle=shingle)
    fps = stored(own.groupBy("fp").agg(F.min(first).alias("first")), "fps")
    best = _rooted(fps, distance, segments).groupBy("root").agg(F.min("first").alias("first"))
    kept = marked.dropDuplicates(["digest"]).join(best.select("first.digest"), "digest", "left_semi")
    return kept.select(docs.columns)


def _digest(docs: DataFrame) -> Column:
    """SHA-256 of all columns, told apart by their lengths and nulls."""
    parts = [F.col(c).cast("string") for c in docs.columns]
    marked = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*marked), 256)
