"""The operators' queries over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelkit.llm import ann, bpe, chat, chosenpath, convrepair, dedup, katz, mixing, secrets, simhash, toxicity, warc, whitening
from panelkit.llm.frames import crc_mod, table
from panelkit.session import work_path


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one made of control strings, formatted and read back from the output."""
    said = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    out = chat.format_conversations(rows.withColumn("parts", chat.text_parts(F.col("text"))))
    read = out.select(
        "conv_id", "attachments", "expanded_tokens", F.char_length("formatted").cast("long").alias("formatted_chars"),
        chat.read_back(F.col("formatted")).alias("turns"),
        chat.learned_text(F.col("formatted"), F.col("spans")).alias("learned"),
    )
    turns = F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
        F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens",
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back."""
    path = work_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).filter("kind = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stands for its text."""
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score, learned from the labels of two thirds of the ids."""
    docs, config = table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity.Config()
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), config=config)
    return toxicity.score(docs, model).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= config.threshold).cast("int").alias("predicted"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the secrets found in its blob, scanned through a ledger of its own."""
    found = secrets.scan_versions(table(spark, sf_dir, "documents"), work_path(spark, "secret-ledger"))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    joined = lambda rows: F.array_join(
        F.transform(rows, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ","
    )
    base = joined(F.filter("findings", lambda f: f["kind"].isin(*secrets.BASE)))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"),
    )


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all vectors."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it and its first training position."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.round(F.get("positions", F.lit(0)), 9).alias("first_position"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability under a Katz bigram model learned from four fifths of the ids."""
    docs = table(spark, sf_dir, "documents")
    out = katz.katz_scores(docs, crc_mod("doc_id", 5) != 1)
    return out.select(
        "doc_id", (crc_mod("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    return simhash.simhash_components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the eight leading components, whitened."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near copies."""
    return chosenpath.near_groups(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    return convrepair.repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_warc": op2_warc,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_nearest": op6_nearest,
    "op7_mixing": op7_mixing,
    "op8_bpe": op8_bpe,
    "op9_katz": op9_katz,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_chosen_path": op12_chosen_path,
    "op13_conversation_repair": op13_conversation_repair,
}
