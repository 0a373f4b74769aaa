"""Corpus pipeline: language ID, near-deduplication, substring deduplication, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last return the columns they got, extra ones included, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import langid, packing, simhash, substring
from tidemark.llm._shared import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that have no language: null, empty and letterless texts, and those that the network takes for noise.

    Without a label in the table (or without the column lang) there is nothing to learn from: then only the former go.
    """
    # the network is learned from the labelled documents as the corpus has them, and from random strings
    labelled = docs.where(langid.fold_of() != 1).select("text", F.col("lang") if "lang" in docs.columns else F.lit(None).alias("lang"))
    net = langid.train(*langid.training_sample(labelled, "text", "lang"), noise=True)
    return langid.with_language(docs, net)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest id.

    A document is an id and a text, so unlike texts with one id are documents of their own; a row without id comes
    after all others. Of rows with equal id and text the one with the smallest hash of all its columns stays.
    """
    place = F.col("doc_id").isNull().alias("no_id")
    key = F.struct(place, F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    # the row is one column beside the key, so no column of the documents clashes with those added here
    keyed = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = simhash.near_duplicates(keyed.select("key", F.col("row.text").alias("text")), key="key")
    keep = Scratch(spark).keep(found.where("key = component").select("key").distinct(), "keep")
    hashable = [f"row.`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    # repeated rows collapse in each task before any row moves, and the join needs no further shuffle of them
    first = Window.partitionBy("key").orderBy(F.xxhash64(*hashable))
    once = keyed.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return once.join(keep, "key").select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the words of repeated passages; a text that lost words is the words left, joined by one space."""
    # the text moves once; the row beside it holds the other columns
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    out = substring.with_cut(docs.select(row, F.col("doc_id").alias("id"), F.col("text").alias("words")), "words", "id")
    lost = F.col("__cut.n_removed") > 0
    text = F.when(lost, F.col("__cut.kept")).otherwise(F.col("words"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences, a row per piece."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No stage but the digests of the third has a form in SQL: fingerprints, a trained network and a tokenizer decide.
ORACLE_SQL = None
