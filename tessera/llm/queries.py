"""The operators' queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, table


def op1_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.wordpiece import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import without_repeated_lines

    return without_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_passages")


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.image_copies import image_copies, images_from_embeddings

    return image_copies(images_from_embeddings(table(spark, sf_dir, "embeddings")))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import score, train

    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents, table(spark, sf_dir, "labels")))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import score, train

    documents = table(spark, sf_dir, "documents")
    return score(documents, train(documents, table(spark, sf_dir, "labels")))


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(F.col("example_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("example_tokens").alias("doc_tokens"), "sequence_id", "offset")


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over conversations, where the three limits differ."""
    import public_tokenizers

    from tessera.llm.packing import pack_conversations

    pieces = pack_conversations(table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(F.col("example_id").alias("conv_id"), F.col("part").alias("first_turn"), "start", "length", "loss", "example_tokens", "sequence_id", "offset")


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import SHARDS, read_shards, row_size, shard_of, write_shards

    path = new_path(spark)
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path).select(
        "doc_id",
        row_size().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of("doc_id", SHARDS + 1).alias("grown_shard"),
    )


def op8_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.token_store import read_store, write_store

    path = new_path(spark)
    write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2, drops_space=True)
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash_dedup import hex_fingerprint, simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontamination import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")} | {"instruction_packing": instruction_packing}


def oracle_sql() -> dict[str, str]:
    return {}
