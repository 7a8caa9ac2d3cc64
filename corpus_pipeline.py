"""Documents to packed training sequences, in stages that each store their result."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hoplens.llm import decontaminate, exact_dedup, jaccard_join, language, packing
from hoplens.llm.common import read_documents
from hoplens.session import scratch_path
from hoplens.sources.folders import remove

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A text whose best language is less likely is rejected, as is one without letters. Of 2,000 held-out documents none is below it.
LEAST_SCORE = 0.3
#: Near copies: word n-grams and their Jaccard similarity, 4/5.
NGRAM, SIMILAR = 5, (4, 5)
CAPACITY = 2048
#: Rows of a batch that goes to Python. Documents are long, and a task holds a batch several times over, here and in the JVM.
BATCH_ROWS = 1000
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def _small_batches(spark: SparkSession) -> None:
    """For the whole session, as a stage's rows are read after it has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the table's labels."""
    _small_batches(spark)
    network = language.train(docs, ~language.held_out())
    return language.in_known_languages(docs, network, LEAST_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.unique_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts."""
    _small_batches(spark)
    return jaccard_join.one_of_each(docs, ngram=NGRAM, similar=SIMILAR)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    _small_batches(spark)
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    _small_batches(spark)
    return packing.pack(docs, CAPACITY, RANKS, public_tokenizers.PATTERN, SPECIAL)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_languages),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontaminate", benchmark_free),
    ("packing", packed),
]

#: No SQL has a trained network or a tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written as Parquet and read again; a stage's table goes once the next one is written."""
    docs, before = read_documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
