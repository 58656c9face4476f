"""Corpus preparation in stages, each over all that the stage before it kept.

All stages take any extra columns, whatever their names, and give them back unchanged; an empty table stays empty; a null
text counts as empty; rows are kept or dropped whole, and a row that repeats is judged like its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import quality as quality_model
from ledgerline.llm.common import Scratch
from ledgerline.llm.decontaminate import decontaminate
from ledgerline.llm.mixing import mix
from ledgerline.llm.near_dedup import near_duplicates
from ledgerline.llm.queries import fold, tokenizer
from ledgerline.llm.token_output import read_tokens, token_lengths, write_tokens

VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality score accepts, fit on the labels outside the held-out fold. Without labels of
    both kinds all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    model = quality_model.fit(docs, labels)
    return quality_model.score(docs.select(F.struct("*").alias("row"), "text"), model).where("predicted = 1").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies (five-word shingles, 0.8). Rows that share
    a doc_id are one document and stay or go together; rows without one stay."""
    gone = near_duplicates(docs, shingle=5, percent=80).where("NOT kept").select("doc_id").distinct()
    # A few bytes a document are hashed; the texts are not sorted.
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the stretches that a benchmark passage covers; ``n_chars`` follows the text."""
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), length=10)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, small sources up to 1.5 times, weighed by tokens, in the mix's order of blocks and
    slots (from file to file, and within one). Rows that share a doc_id are used as often as the one used most, each at
    the places of all; a row without one is used once, before all others."""
    path = Scratch(spark, "lengths")
    lengths = path.table(token_lengths(docs, tokenizer(VOCABULARY)), "lengths")
    uses = mix(lengths.where("doc_id IS NOT NULL"), F.col("n_tokens"), max_repeats=1.5)
    # One row for each use and id: rows that share an id come with all uses, numbered by copy.
    places = uses.groupBy("doc_id", "copy").agg(F.min(F.struct("block", "slot")).alias("place"))
    places = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))  # an id's repeats, 2 at most here
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    out = rows.join(places.hint("shuffle_hash"), "doc_id", "left").select("row", F.explode_outer("places").alias("place"))
    return out.orderBy("place.block", "place.slot", "row.doc_id").select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files with Elias-Fano boundaries, in the order of ``docs``, read back: one row a document use."""
    path = Scratch(spark, "corpus").path("tokens")
    write_tokens(placed(docs), path, tokenizer(VOCABULARY), end_id=1, key="place", name="doc_id")
    return read_tokens(spark, path)


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the place of each row: for a table in files the number in the file's name, then the row in it."""
    if not docs.inputFiles():
        return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    number = F.coalesce(F.nullif(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    return docs.select("doc_id", "text", (F.shiftleft(number, 40) + F.col("_metadata.row_index")).alias("place"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]

#: Training, sketches and vocabularies are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k:
            scratch.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
