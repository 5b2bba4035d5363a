"""The corpus pipeline: documents in, packed training sequences out, one stage after another.

Every stage takes the rows its predecessor kept and all but the last return the columns of
``documents``. A null text is empty; rows without an id, or with an id that another
row has too, pass all stages like any other; near-deduplication goes by texts alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import language, quality, simhash, substrings
from tallyweave.llm.queries import packed
from tallyweave.llm.tables import read, stored, text_digest, without_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a repeated string that goes. Of passages of 51 words, 98 to 99 in 100 are longer in the languages at hand
#: (median 304 to 341 bytes), and what is shorter is mostly license lines and phrases.
PASSAGE_BYTES = 250


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay; those without a letter or with an even mixture go.

    A mixture is even if its score is nearer to that of chance than to the least of all rightly labelled documents
    that are not held out.
    """
    model = language.learn(docs)
    # scored once, read for the least score and for the texts that go
    scored = language.with_language(docs.select("doc_id", "text", "lang"), model)
    found = stored(scored.select("doc_id", "lang", "language", text_digest().alias("digest")), "scored")
    least = language.least_score_of_all(found, model)
    known = (F.col("language.lang_pred") != language.UNKNOWN) & (F.col("language.score") >= least)
    return without_texts(docs.select(COLUMNS), found.where(~known))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the isolation forest rejects go."""
    return quality.filtered(docs.select(COLUMNS), read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, one without an id only if no other has one."""
    return simhash.one_per_group(docs.select(COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of long repeated strings go from the texts; a character cut in two goes whole."""
    cut = substrings.without_repeats(docs.select(COLUMNS), PASSAGE_BYTES)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all texts, packed."""
    return packed(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has no SimHash, no trained model and no packing: the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
