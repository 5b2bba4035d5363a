"""Small helpers that every operator of the subpackage uses."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.sources.workspace import stored

__all__ = [
    "among_least", "chunks", "held_out", "labelled_sample", "least_hashed", "read", "shuffle_partitions", "stored", "text_digest", "without_texts",
]

#: Characters of text that the numpy code works on at once.
CHUNK_CHARS = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept out of training: one in five, by crc32 of its id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def among_least(value: Column, total: Column | int, limit: int) -> Column:
    """Whether a 64-bit hash is one of the least of ``total``, by a bound that about ``2 * limit + 64`` of them stay below.

    The bound leaves fewer than ``limit`` only where few keys hold most of the rows.
    """
    return (value / F.lit(2.0**64) + 0.5) * total <= 2 * limit + 64


def least_hashed(rows: DataFrame, limit: int, value: Column, *ties: str) -> DataFrame:
    """The ``limit`` rows with the least hashes, ties by the named columns.

    Rows are counted first and those above a bound leave where they are, so that what meets
    in the sort grows neither with the input nor with its partitions.
    """
    return rows.where(among_least(value, rows.count(), limit)).orderBy(value, *ties).limit(limit)


def text_digest() -> Column:
    """SHA-256 of the column ``text``; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def without_texts(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows, all columns, whose text has none of the :func:`text_digest` in column ``digest``.

    For verdicts that a text alone decides: their table need not hold the texts, which stay on disk as long as
    the session does.
    """
    gone = stored(digests.select(F.col("digest").alias("__digest")).distinct(), "gone")
    return docs.withColumn("__digest", text_digest()).join(gone, "__digest", "left_anti").select(docs.columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """At most ``limit`` training rows (text, label) of each class, those with the smallest hashes.

    Rows without a text or a label and held-out documents take no part. Ids meet first and
    texts are fetched for the chosen ids alone.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()
    )
    chosen = None
    for value in (0, 1):
        of_class = least_hashed(known.where(F.col("label") == value), limit, F.xxhash64("doc_id", F.lit(7)), "doc_id")
        chosen = of_class if chosen is None else chosen.unionByName(of_class)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    # two times the limit of ids at most
    return texts.join(F.broadcast(chosen.dropDuplicates(["doc_id", "label"])), "doc_id").select("doc_id", "text", "label")


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about ``limit`` characters together; a longer text comes alone."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > limit:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part
