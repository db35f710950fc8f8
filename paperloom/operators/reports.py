"""Views for people: batch summaries, page tables, reasons, topics, and the proxy of retrieval precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .search import precision_at_k

#: A document class and its files, where a corpus is listed by hand.
MANIFEST = "document_class string, filename string"


def manifest(spark, classes: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(c, f) for c, files in classes.items() for f in files], MANIFEST)


def batch_summary(results: DataFrame) -> DataFrame:
    """One row of results (document_id, strategy, escalated, error, seconds): counts and the mean time."""
    return results.agg(
        F.count("*").alias("n_documents"),
        F.count_if(F.col("error").isNull()).alias("n_successful"),
        F.count_if(F.col("error").isNotNull()).alias("n_failed"),
        F.count_if(F.col("escalated")).alias("n_escalated"),
        F.round(F.avg("seconds"), 2).alias("mean_seconds"),
    )


def page_table(pages: DataFrame) -> DataFrame:
    """Pages with a preview of 140 characters, their rounded confidence, and whether they hold made-up content."""
    text = T.collapsed(F.coalesce("text", F.lit("")))
    return pages.select("document_id", "page_num", F.concat(F.lit("p. "), F.col("page_num").cast("string")).alias("label"), F.bround("confidence", 3).alias("confidence"), F.substring(text, 1, 140).alias("preview"), F.lower(text).contains("mock").alias("mock"))


def strategy_reason(strategy: Column, escalated: Column) -> Column:
    why = F.when(strategy == "fast_text", "native text was read directly").when(strategy == "layout", "layout was analysed").when(strategy == "vision", "pages were read by OCR").otherwise("pages were read by several strategies")
    return F.when(escalated, F.concat(why, F.lit(" after a page fell below the gate"))).otherwise(why)


def topics(text: Column) -> Column:
    """Topics between commas, semicolons and line ends."""
    return F.filter(F.transform(F.split(text, r"[,;\n]"), lambda t: T.strip(t)), lambda t: t != "")


def topic_excerpt(text: Column, topic: Column) -> Column:
    """280 characters, from 80 before the topic, or from the start where it isn't there."""
    return T.excerpt(text, F.array(F.lower(topic)), 80, 280)


def first_match_precision(top: DataFrame, bodies: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    """(question_id, document_id, precision): of the first k sections of top, how many share a token with the question.

    bodies: (document_id, section_id, body). A stand-in for relevance labels.
    """
    rows = top.filter(F.col("nth") <= k).join(bodies.select("document_id", "section_id", "body"), ["document_id", "section_id"]).join(questions.select("question_id", "document_id", "question"), ["question_id", "document_id"])
    low = F.lower("body")
    shared = F.exists(T.tokens(F.col("question")), lambda t: F.contains(low, t))
    held = rows.groupBy("question_id", "document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "section_id"))), lambda x: x["section_id"]).alias("predicted"), F.collect_set(F.when(shared, F.col("section_id"))).alias("relevant"))
    return held.select("question_id", "document_id", precision_at_k(F.col("predicted"), F.col("relevant"), k).alias("precision"))
