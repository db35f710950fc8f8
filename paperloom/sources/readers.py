"""Sources: files of documents, page rows, rules, and the driver's tables.

PDF and OCR readers are plugged in as a function from a file's bytes to its pages; the
libraries they need are imported where they run, and a file that fails gives a row with
its error instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triage import RULES, Rule

#: bytes of a file to (page_num, text, n_images) of its pages
PageReader = Callable[[bytes], Iterable[tuple[int, str, int]]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """(path, length, modificationTime, content, document_id) of a folder's files; a document's id is its file's stem."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return rows.withColumn("document_id", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))


def pages_of_files(found: DataFrame, reader: PageReader) -> DataFrame:
    """(document_id, page_num, text, n_images, error): the pages that reader makes of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for document_id, content in zip(batch["document_id"], batch["content"], strict=True):
                try:
                    rows += [(document_id, n, text, images, None) for n, text, images in reader(bytes(content))]
                except Exception as failed:  # one bad file must not end the job: it is a row with its error
                    rows.append((document_id, None, None, None, f"{type(failed).__name__}: {failed}"))
            yield pd.DataFrame(rows, columns=["document_id", "page_num", "text", "n_images", "error"]).astype({"page_num": "Int32", "n_images": "Int32"})

    return found.select("document_id", "content").mapInPandas(run, "document_id string, page_num int, text string, n_images int, error string")


def text_pages(content: bytes) -> Iterator[tuple[int, str, int]]:
    """A reader of plain text: pages end at form feeds."""
    for n, page in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        yield n, page, 0


def first_source(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Native pages of the documents of which any is not blank, else all pages from OCR; confidence 0.99 for native text."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    good = native.filter(~blank).select("document_id").distinct()
    kept = native.join(good, "document_id", "left_semi").withColumn("confidence", F.when(blank, 0.0).otherwise(0.99))
    rest = ocr.join(good, "document_id", "left_anti")
    return kept.unionByName(rest, allowMissingColumns=True)


def resolve(names: DataFrame, found: DataFrame) -> DataFrame:
    """(name, path) for names of documents: the exact path, else the file of that name, else that of its stem in any case."""
    rows = found.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file")).withColumn("stem", F.lower(F.regexp_replace("file", r"\.[^.]*$", "")))
    exact = rows.groupBy(F.col("path").alias("name")).agg(F.min("path").alias("p1"))
    by_file = rows.groupBy(F.col("file").alias("name")).agg(F.min("path").alias("p2"))
    by_stem = rows.groupBy("stem").agg(F.min("path").alias("p3"))
    asked = names.select("name").withColumn("stem", F.lower(F.regexp_replace(F.regexp_extract("name", r"([^/]+)$", 1), r"\.[^.]*$", "")))
    return asked.join(exact, "name", "left").join(by_file, "name", "left").join(by_stem, "stem", "left").select("name", F.coalesce("p1", "p2", "p3").alias("path"))


def document_pages(docs: DataFrame) -> DataFrame:
    """Documents as documents of one page."""
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_num"), "text", "doc_id")


def conversation_pages(conversations: DataFrame) -> DataFrame:
    """Conversations as documents, a page for each turn."""
    return conversations.select(F.col("conv_id").cast("string").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_num"), "text", "conv_id", "role")


def json_rows(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def category_rules(path: str | None = None) -> tuple[Rule, ...]:
    """Rules of a YAML file (document_categories), or the built-in ones where there is no file; unknown keys are ignored."""
    if path is None:
        return RULES
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            found = (yaml.safe_load(f) or {}).get("document_categories") or {}
    except FileNotFoundError:
        return RULES
    names = {"avg_chars_per_page": "avg_chars_per_page", "image_area_ratio": "image_area_ratio", "detected_table_count": "table_count", "x_cluster_count": "column_count"}
    rules = []
    for category, body in found.items():
        criteria = body.get("criteria", body)
        least, most = ({own: criteria[f"{name}_{end}"] for name, own in names.items() if criteria.get(f"{name}_{end}") is not None} for end in ("min", "max"))
        rules.append(Rule(category, body.get("confidence_threshold", 0.7), body.get("recommended_strategy", "layout"), least, most))
    return tuple(rules) or RULES


def query(spark: SparkSession, sql: str, args: list | dict | None = None, **views: DataFrame) -> DataFrame:
    """A SELECT over views, with ? or named parameters."""
    if not sql.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only SELECT statements are run")
    for name, rows in views.items():
        rows.createOrReplaceTempView(name)
    return spark.sql(sql, args=args) if args else spark.sql(sql)
