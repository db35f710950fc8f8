"""Provenance chains, ledgers, distributions and generated questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import extraction


def provenance_chain(ldus: DataFrame) -> DataFrame:
    """(document_id, chain_id, n_ldus, combined_hash, page_refs): the hash over the chunks' hashes in order."""
    held = F.array_sort(F.collect_list(F.struct("position", "content_hash")))
    return ldus.groupBy("document_id").agg(F.count("*").alias("n_ldus"), F.sha2(F.array_join(F.transform(held, lambda x: x["content_hash"]), ""), 256).alias("combined_hash"), F.array_sort(F.collect_set("page_num")).alias("page_refs")).withColumn("chain_id", F.concat("document_id", F.lit("_provenance")))


def chain_status(steps: DataFrame) -> DataFrame:
    """Rollup of steps (chain_id, status, seconds, quality): duration, completion, status and quality of each chain."""
    rows = steps.groupBy("chain_id").agg(F.sum("seconds").alias("total_duration"), F.count("*").alias("n_steps"), F.count_if(F.col("status") == "completed").alias("n_completed"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.avg("quality").alias("quality_avg"), F.min("quality").alias("quality_min"), F.max("quality").alias("quality_max"))
    return rows.withColumn("status", F.when(F.col("n_failed") > 0, "failed").when(F.col("n_completed") == F.col("n_steps"), "completed").otherwise("running")).withColumn("completion", F.col("n_completed") / F.col("n_steps") * 100)


def ledger(extractions: DataFrame) -> DataFrame:
    """Ledger rows from (document_id, strategy, average_confidence, pages_processed, seconds, escalated)."""
    return extractions.select("document_id", "strategy", F.bround("average_confidence", 3).alias("confidence"), "pages_processed", F.bround("seconds", 2).alias("processing_time"), F.lit(0.0).alias("cost"), "escalated", extraction.efficiency(F.col("seconds")).alias("efficiency"))


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key; order is total. One row a key is kept map-side."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")


def distribution(extractions: DataFrame, seconds: Column | None = None) -> DataFrame:
    """Documents and escalations by strategy."""
    return extractions.groupBy("strategy").agg(F.count("*").alias("n_documents"), F.count_if("escalated").alias("n_escalated"))


def qna(ldus: DataFrame, group: str) -> DataFrame:
    """One question for each group: about its chunk of most characters, 50 more for one with a digit; of equals the first.

    ldus: (group, document_id, page_num, position, section_title, text).
    """
    text = T.strip(F.col("text"))
    rows = ldus.filter(text != "").withColumn("score", F.length(text) + F.when(F.col("text").rlike(r"\d"), 50).otherwise(0))
    best = rows.groupBy(group).agg(F.max_by(F.struct("document_id", "page_num", "section_title", text.alias("text"), "score"), F.struct("score", -F.col("page_num"), -F.col("position"))).alias("b")).select(group, "b.*")
    title = T.human_id(F.col("document_id"))
    return best.select(group, "document_id", "page_num", "score", F.concat(F.lit("What does "), title, F.lit(" say in the section '"), F.col("section_title"), F.lit("'?")).alias("question"), T.first_sentence(F.col("text")).alias("answer"))


def section_hash(ldus: DataFrame, keys: list[str], joint: str = " ") -> DataFrame:
    """(keys, content_hash, n_ldus): the hash of a group's texts, joined in order of position."""
    held = F.array_sort(F.collect_list(F.struct("position", "text")))
    return ldus.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(held, lambda x: x["text"]), joint), 256).alias("content_hash"), F.count("*").alias("n_ldus"))
