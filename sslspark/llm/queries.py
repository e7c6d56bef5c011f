"""The registered queries of the training-data operators: each applies one
operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sslspark.llm import chat, divergence, fingerprints, langid, lines, mixing, packing, periodic, secrets, sharding, simhash, substrings, vectors
from sslspark.session import table

TOKENIZER = "byte_bpe_50k.json"
#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20
#: Tempering of the observed token shares: large sources and languages give way a little.
MIX_POWER = {"source": 0.8, "lang": 0.8, "topic": 0.9}


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public vocabulary file; a parameter of the operators."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut into windows of 1024 tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, links at 3 or fewer differing bits."""
    found = simhash.simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries learned outside the held-out fold; every text predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    books = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs.drop("lang"), books).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in shards of at most 1 MiB of text."""
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates with the forest's answer; values as digests only."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", "kind", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, compared under equal labels, cosine 0.93 or more."""
    return vectors.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 35 words that occur again."""
    return substrings.digests(substrings.dedup_substrings(table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their probability and draw."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.withColumns({"topic": mixing.topic(), "tokens": mixing.tokens()}), MIX_POWER)
    return mixed.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "topic", "tokens",
                        F.round("probability", 6).alias("probability"), "kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents; the text left over as a digest."""
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), exact_chars=lines.EXACT_CHARS)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and its next document."""
    return fingerprints.edited_and_next(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text, of which every tenth gets the contract's repetition."""
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.planted().alias("text"))
    return periodic.digests(periodic.periodic_runs(docs))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against the other sources of its language, and its terms against the language's."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, read back from their pieces."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(r"\### Assistant: </turn> ok").alias("text"))
    pieces = chat.format_turns(given.unionByName(more), tokenizer_path())
    found = chat.digests(chat.read_back(pieces, tokenizer_path()))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_simhash, op3_language_id, op4_sharding, op5_secret_scan, op6_embedding_dedup,
                            op7_substring_dedup, op8_mixing, op9_line_dedup, op10_fingerprints, op11_periodic_runs,
                            op12_source_divergence, op13_chat_format)
}
#: The others have no SQL form: tokenizers, XXH64, compression, forests, graphs and edit joins; substring windows are too slow.
ORACLE: dict[str, str] = {
    "op4_sharding": sharding.oracle_sql(SHARD_BYTES),
    "op8_mixing": mixing.oracle_sql(MIX_POWER),
    "op12_source_divergence": divergence.oracle_sql(),
    "op13_chat_format": chat.oracle_sql(),
}
