"""Chunks of pages (LDUs): packing, numbering, validation and page nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.packing import ChunkRules, buffered, chunks


def _cut(pages: DataFrame, cut: Callable[[str | None, bool], list[str]]) -> DataFrame:
    """pages with nth and chunk: packing decides chunk by chunk inside a page, so it runs on Arrow batches, page by page."""
    extra = [c for c in pages.columns if c not in ("text", "has_table")]
    rows = pages.select(*extra, F.coalesce("text", F.lit("")).alias("text"), (F.col("has_table") if "has_table" in pages.columns else F.lit(False)).alias("has_table"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                found = [cut(t, bool(h)) for t, h in zip(part.column(len(extra)).to_pylist(), part.column(len(extra) + 1).to_pylist(), strict=True)]
                take = pa.array([k for k, c in enumerate(found) for _ in c], pa.int64())
                more = [pa.array([n for c in found for n in range(len(c))], pa.int32()), pa.array([x for c in found for x in c], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(take) for k in range(len(extra))), *more], names=[*extra, "nth", "chunk"])

    return rows.mapInArrow(run, rows.select(*extra, F.lit(0).alias("nth"), F.lit("").alias("chunk")).schema)


def _numbered(rows: DataFrame) -> DataFrame:
    """LDUs from (document_id, page_num, confidence, strategy, has_table, nth, chunk)."""
    position = F.row_number().over(Window.partitionBy("document_id").orderBy("page_num", "nth")) - 1
    rows = rows.withColumn("position", position)
    return rows.select(
        F.concat("document_id", F.lit("_ldu_"), (F.col("position") + 1).cast("string")).alias("ldu_id"),
        "document_id",
        "page_num",
        "position",
        F.col("chunk").alias("text"),
        F.length("chunk").alias("text_length"),
        F.sha2("chunk", 256).alias("content_hash"),
        "confidence",
        "strategy",
        F.concat("document_id", F.lit("_section_root")).alias("parent_section"),
    )


def _with_defaults(pages: DataFrame) -> DataFrame:
    for name, value in (("confidence", F.lit(0.99)), ("strategy", F.lit("fast_text"))):
        if name not in pages.columns:
            pages = pages.withColumn(name, value)
    return pages


def ldus(pages: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """LDUs of pages (document_id, page_num, text, and has_table, confidence, strategy if there). Null texts are blank, and blank pages have none."""
    return _numbered(_cut(_with_defaults(pages), lambda t, has_table: chunks(t, has_table, rules)))


def buffer_ldus(pages: DataFrame, least: int = 120) -> DataFrame:
    return _numbered(_cut(_with_defaults(pages), lambda t, _: buffered(t, least)))


def page_ldus(pages: DataFrame) -> DataFrame:
    """One LDU for each page that isn't blank."""
    rows = _with_defaults(pages).filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    return _numbered(rows.withColumn("nth", F.lit(0)).withColumn("chunk", T.strip(F.col("text"))))


def issues(found: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """(document_id, ldu_id, position, issue): a row for each test that an LDU fails; order is judged by position of arrival."""
    order = Window.partitionBy("document_id").orderBy("position", "ldu_id")
    text, trimmed = F.col("text"), T.strip(F.coalesce("text", F.lit("")))
    blocks = F.size(F.filter(F.split(text, "\n\n"), lambda p: T.strip(p) != ""))
    tests: dict[str, Column] = {
        "blank": trimmed == "",
        "too_short": F.length(trimmed) < rules.least,
        "too_long": F.length(text) > rules.hard,
        "starts_inside": trimmed.rlike(r'^[,.;:)"]'),
        "ends_inside": trimmed.rlike(r"[-/(\\]$"),
        "too_many_paragraphs": blocks > rules.paragraphs,
        "no_parent": F.coalesce("parent_section", F.lit("")) == "",
        "order": F.coalesce((F.col("position") <= F.col("last_position")) | (F.col("page_num") < F.col("last_page")), F.lit(False)),
        "hash": ~F.sha2("text", 256).eqNullSafe(F.col("content_hash")),
    }
    rows = found.withColumns({"last_position": F.lag("position").over(order), "last_page": F.lag("page_num").over(order)})
    named = F.filter(F.array(*[F.when(test, name) for name, test in tests.items()]), lambda x: x.isNotNull())
    return rows.select("document_id", "ldu_id", "position", F.explode(named).alias("issue"))


def valid(found: DataFrame, rules: ChunkRules = ChunkRules(), on_invalid: str = "fail_document") -> DataFrame:
    """LDUs of the documents without any issue (fail_document), or all (report)."""
    return found if on_invalid == "report" else found.join(issues(found, rules).select("document_id").distinct(), "document_id", "left_anti")


def page_nodes(pages: DataFrame) -> DataFrame:
    """The page index: types, counts, density and quality of each page."""
    text = F.coalesce("text", F.lit(""))
    n_words = F.size(T.words(text))
    tables = F.col("n_tables") if "n_tables" in pages.columns else F.lit(0)
    confidence = F.col("confidence") if "confidence" in pages.columns else F.lit(0.99)
    return pages.select(
        "document_id",
        "page_num",
        F.lit("content").alias("page_type"),
        F.when(tables > 0, "table_heavy").otherwise("text_only").alias("content_type"),
        n_words.alias("word_count"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("line_count"),
        F.least(F.lit(1.0), n_words / 1000).alias("text_density"),
        confidence.alias("ocr_confidence"),
        (1 - confidence).alias("noise"),
        F.substring(text, 1, 200).alias("summary"),
    )


def page_complexity(n_tables: Column, n_figures: Column, n_columns: Column, ocr: Column) -> Column:
    return F.least(F.lit(1.0), F.least(0.2 * n_tables, F.lit(0.4)) + F.least(0.15 * n_figures, F.lit(0.3)) + F.least(0.1 * n_columns, F.lit(0.2)) + 0.1 * (1 - ocr))
