"""The registered queries of this folder; each is thin and takes its rows from the operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import (
    bpe_automaton,
    conversation_repair,
    decontaminate,
    fuzzy_hash,
    language_bits,
    packing,
    quality_cnn,
    repeated_bytes,
    secrets,
    superminhash,
    token_files,
    twins,
    warc,
    whitening,
)
from webloom.llm.batches import documents

END_ID = 1  # closes each document in the token files


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, folder), documents(spark, folder, "benchmark"))


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.read_files(token_files.write_files(documents(spark, folder), tokenizer_file(), END_ID))


def op3_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_automaton.encode_decode(documents(spark, folder), tokenizer_file())


def op4_superminhash(spark: SparkSession, folder: str) -> DataFrame:
    return superminhash.near_duplicates(documents(spark, folder))


def op5_fuzzy_hash(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy_hash.fingerprints(documents(spark, folder))


def op6_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_bytes.remove_repeats(documents(spark, folder))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    rules = secrets.BASE + secrets.MORE
    found = secrets.scan(documents(spark, folder), rules).select("doc_id", "found")
    base = F.filter("found", lambda s: s["kind"] < len(secrets.BASE))
    counts = [secrets.count_of("found", n).alias(f"n_{rule.name}") for n, rule in enumerate(secrets.BASE)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.described(base, rules), 256).alias("base_sha256"),
        secrets.described(F.col("found"), rules).alias("spans"),
    )


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.read_archives(warc.write_archives(documents(spark, folder, "pages")))
    return archives.filter("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


GOOD_SCORE = 0.3  # documents that score less are low quality


def id_fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % folds


def quality_model(spark: SparkSession, folder: str) -> quality_cnn.Network:
    labels = documents(spark, folder, "labels").filter(id_fold(5) != 0)
    return quality_cnn.fit(documents(spark, folder), labels)


def op9_quality_cnn(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality_cnn.score(documents(spark, folder), quality_model(spark, folder))
    return scored.select(
        "doc_id",
        (id_fold(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted"),
    )


def op10_language_bits(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    filters = language_bits.fit(docs.filter(id_fold(4) != 2))
    found = language_bits.predict(docs, filters)
    return found.select("doc_id", (id_fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after damage to its rows."""
    conversations = documents(spark, folder, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(conversations), conversations)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The first whitened components of every embedding."""
    return whitening.whiten(documents(spark, folder, "embeddings"))


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every piece of every document in a sequence."""
    return packing.pack_documents(documents(spark, folder), tokenizer_file(), END_ID)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_files": op2_token_files,
    "op3_bpe_automaton": op3_bpe_automaton,
    "op4_superminhash": op4_superminhash,
    "op5_fuzzy_hash": op5_fuzzy_hash,
    "op6_repeated_bytes": op6_repeated_bytes,
    "op7_secrets": op7_secrets,
    "op8_warc": op8_warc,
    "op9_quality_cnn": op9_quality_cnn,
    "op10_language_bits": op10_language_bits,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_whitening": op12_whitening,
    "op13_packing": op13_packing,
}

ORACLES = twins.ORACLES
