"""The corpus pipeline: documents in, packed training windows out."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entityloom.llm import language, packing, simhash, substrings, winnowing
from entityloom.llm.workers import share_path
from entityloom.session import shared_folder

ROW = "_pipeline_row"
#: Columns that stages read; all others only pass through.
OWN = ("doc_id", "text", "lang", "n_chars")
#: Languages whose documents stay; empty: all that the samples teach.
WANTED: tuple[str, ...] = ()

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _passing_through(stage: Stage) -> Stage:
    """Other columns get neutral names within the stage, so that none clashes with its own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        plain = docs.toDF(*(c if c in OWN else f"extra_{i}" for i, c in enumerate(names)))
        return stage(spark, plain, sf_dir).toDF(*names)

    return run


@_passing_through
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Names the language of every document in ``lang``; drops what has none or an unwanted one.

    Without a language are null texts and texts without a letter, at any length
    and whatever their id; no text goes for a low score. ``WANTED`` is empty by
    default, so every learned language stays. A table without a labelled text
    keeps its ``lang`` and loses only texts without a letter.
    """
    share_path(spark)
    samples = language.learn(docs)
    if not samples:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = docs.withColumn("_language", language.identify(F.col("text"), samples)["lang"])
    kept = F.col("_language").isin(*WANTED) if WANTED else F.col("_language") != language.UNKNOWN
    return found.filter(kept).withColumn("lang", F.col("_language")).select(*docs.columns)


@_passing_through
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component: that with the smallest id, then text hash.

    A row is its id and text: unlike texts under one id are documents of their
    own, equal ones are one. Rows without id stand behind all that have one.
    Texts without words, null ones included, are one component.
    """
    share_path(spark)
    key = F.struct(  # nothing in it is missing, so keys compare by plain equality
        F.col("doc_id").isNull().alias("nameless"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64("text").alias("first"),
        F.xxhash64(F.reverse("text")).alias("second"),
    )
    rows = docs.withColumn(ROW, key)
    found = simhash.near_duplicates(rows, row=ROW)
    first = found.filter(F.col(ROW) == F.col("component")).select(ROW).distinct()
    return rows.join(first, ROW, "left_semi").dropDuplicates([ROW]).select(*docs.columns)


@_passing_through
def drop_duplicate_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; a document of which nothing is left goes.

    Texts without a repeated passage stay as they are, null and empty ones too;
    very long texts are cut word by word like others. Rows without id come
    behind all others, rows with one id share its place.
    """
    share_path(spark)
    found = substrings.with_removal(docs, "_removed")
    cut = F.size("_removed.spans") > 0
    text = F.when(cut, F.col("_removed.kept")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        length = F.char_length("_removed.kept").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(cut, length).otherwise(F.col("n_chars"))
    kept = found.filter(~(cut & (F.col("_removed.kept") == "")))
    return kept.select(*(changed[c].alias(c) if c in changed else c for c in docs.columns))


@_passing_through
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item.

    Ids do not matter, missing and repeated ones included; null texts stay.
    """
    share_path(spark)
    return winnowing.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: every remaining document in windows of 2,048 tokens.

    Rows with one id, or none, are packed each for itself; a null text gives the
    end id alone, a very long one fills windows of its own. Other columns go.
    """
    share_path(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_duplicate_spans),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express cross-parsing, SimHash and tokenizers; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
