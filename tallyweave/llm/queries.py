"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import (
    chat,
    language,
    neighbours,
    packing,
    passages,
    periods,
    pieces,
    quality,
    setsketch,
    simhash,
    substrings,
    toxicity,
    trie,
)
from tallyweave.llm.tables import held_out, read, stored

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = (
    public_tokenizers.path("byte_bpe_50k.json"),
    public_tokenizers.path("byte_bpe_50k.tiktoken"),
    public_tokenizers.PATTERN,
)

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.with_verdict(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*base, "kept", "anomaly")


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = passages.learn(docs, read(spark, sf_dir, "labels"))
    found = docs.select("doc_id", held_out().alias("held_out"), passages.scored(model, F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= passages.CUT).cast("int"))


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


@query
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal_conversations(read(spark, sf_dir, "conversations"))


ORACLES["op4_chat_formatting"] = chat.ORACLE_SQL


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    done = pieces.encoded_and_checked(F.col("text"), path).alias("done")
    return read(spark, sf_dir, "documents").select("doc_id", done).select(
        "doc_id",
        F.size("done.ids").cast("long").alias("n_ids"),
        F.xxhash64("done.ids").alias("ids_hash"),
        "done.round_trip",
    )


def packed(docs: DataFrame) -> DataFrame:
    """Digest rows of the packing: the ids stay in the written pieces, their crc32 goes on."""
    tokens = packing.token_pieces(docs, TOKENIZER)
    tokens = stored(tokens.withColumn("ids_crc32", F.crc32("ids")), "pieces")
    return packing.pack(tokens.drop("ids")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.with_language(docs.select("doc_id", "text"), language.learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")


@query
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.cut_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "cut.n_bytes",
        "cut.n_removed",
        F.size("cut.spans").cast("long").alias("n_spans"),
        F.sha2("cut.kept", 256).alias("kept_sha256"),
    )


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    machine = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    found = docs.select("doc_id", held_out().alias("held_out"), toxicity.scored(machine, F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= toxicity.CUT).cast("int"))


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))


ORACLES["op11_conversation_trie"] = trie.ORACLE_SQL


@query
def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_components(read(spark, sf_dir, "documents"))


ORACLES["op12_minhash_near_dedup"] = setsketch.ORACLE_SQL


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digest(periods.with_runs(read(spark, sf_dir, "documents"), plant=True))
