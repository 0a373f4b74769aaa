"""The queries of this subpackage: each applies one operator to its whole table and derives digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, embed_dedup, langid, licenses, packing, simhash, substring, topk, warc
from tidemark.llm._shared import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.decode(bpe.encode(_read(spark, sf_dir, "documents")))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex64().alias("fingerprint"), F.col("component").alias("component_id"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


#: A conversation that consists of control strings.
CONTROL = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(rows.unionByName(more))
    parsed = made.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "state",
        "valid",
    )


def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path("warc")
    warc.write(_read(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = topk.more_like_these(docs, docs.where("doc_id % 100 = 0"))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("doc_id"), "score")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring.remove_repeats(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_packing": op3_packing,
    "op4_chat": op4_chat,
    "op5_embed_dedup": op5_embed_dedup,
    "op6_warc": op6_warc,
    "op7_topk": op7_topk,
    "op8_licenses": op8_licenses,
    "op9_substring": op9_substring,
    "op10_langid": op10_langid,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, sf_dir)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


QUERIES["pipeline"] = pipeline
