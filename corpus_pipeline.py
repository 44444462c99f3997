"""A corpus cleaned in five stages, each written as Parquet and read again as the next one's documents.

Language identification drops what it rejects and fills in missing languages, line dedup cuts the texts down,
SimHash near-dedup keeps the first document of each class, decontamination drops documents with benchmark
passages, and mixing decides how many words are taken of each that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lang_id, line_dedup, mixing, simhash_dedup
from tidemark.llm.common import cut
from tidemark.storage import own_folder, remove

#: No SQL can express the first stage, which is a trained classifier.
ORACLE_SQL = None
#: The near-duplicate stage: shingles of so many words, and fingerprints of a text of which any may link it.
WORDS_PER_SHINGLE, FINGERPRINTS = 5, 8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = lang_id.identify(docs).filter((F.col("lang_pred") != lang_id.UNKNOWN) & ~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(docs)
    size = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", size).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_first(docs, words_per_shingle=WORDS_PER_SHINGLE, count=FINGERPRINTS)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for the documents of ``sf_dir``. A stage's folder is deleted when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    with own_folder(spark, "pipeline") as folder:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                remove(spark, before)
            before = f"{folder}/{name}"
        return cut(STAGES[-1][1](spark, docs, sf_dir))
