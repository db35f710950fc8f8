"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

Part of the subpackage ``paperloom.llm``. Every stage works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import codes, decontaminate, langid, mixing, nearcopies, queries
from paperloom.llm.shared import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those whose text is null or has no letter, or of which no language is likelier than the rest together."""
    sent = langid.predicted(docs.select(*COLUMNS), queries.language_model(docs))
    return sent.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= 0.5)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8 or more) stays: that of the smallest doc_id."""
    return nearcopies.one_of_each(docs.select(*COLUMNS))


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go; the others, those of null texts among them, stay."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weighted mix sends, whole, a row for each time it sends them, by finish time."""
    return mixing.served(docs.select(*COLUMNS))


def token_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix, written as directly addressable codes and read back."""
    path = scratch_path(spark, "codes")
    codes.write(docs, path, queries.tokenizer_path())
    return codes.documents(spark, path)


STAGES = [
    ("language identification", known_language),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", clean_of_benchmarks),
    ("source mixing", mix_sources),
    ("token codes", token_codes),
]
#: Shuffles by links of near copies and library tokens are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
