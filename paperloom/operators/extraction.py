"""Routing of documents to extraction strategies, confidence gates, and what the readers compute from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

GATE = 0.7
STRATEGIES = ("fast_text", "layout", "vision")
TABLE = "struct<headers:array<string>,data:array<array<string>>,rows:int,columns:int,confidence:double>"


def routed(origin: Column, layout: Column, recommended: Column, forced: Column | None = None) -> Column:
    """The strategy that a document begins with; a forced one counts if it is known."""
    own = F.when(origin == "scanned_image", "vision").when(origin == "mixed", "layout").when(origin == "native_digital", F.when(layout == "multi_column", "layout").otherwise("fast_text")).otherwise(recommended)
    return own if forced is None else F.when(forced.isin(*STRATEGIES), forced).otherwise(own)


def next_strategy(current: Column) -> Column:
    return F.when(current == "fast_text", "layout").otherwise("vision")


def page_plan(text: Column, image_ratio: Column, n_x: Column, table_like: Column) -> Column:
    """The strategy of each page of a mixed document (the hybrid mode)."""
    return F.when((F.length(T.strip(text)) < 80) | (image_ratio > 0.7), "vision").when(table_like | (n_x >= 3) | (image_ratio > 0.3), "layout").otherwise("fast_text")


def noted_plan(chars: Column, whitespace: Column, has_tables: Column) -> Column:
    """The page decision of the domain notes: scans and near-empty pages to vision, airy ones to fast text."""
    return F.when((chars < 100) | (whitespace > 0.9), "vision").when(whitespace > 0.7, "fast_text").when(has_tables, "layout").otherwise("fast_text")


def fast_text_confidence(n_chars: Column, image_ratio: Column) -> Column:
    base = 0.2 + 0.85 * F.least(F.lit(1.0), n_chars / 200) - F.least(F.lit(0.6), 1.2 * F.greatest(F.lit(0.0), image_ratio - 0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n_chars < 100, 0.7 * base).otherwise(base)))


def layout_confidence(n_chars: Column, n_tables: Column) -> Column:
    return F.least(F.lit(1.0), F.when(n_chars > 100, 0.6).otherwise(0.3) + F.least(0.1 * n_tables, F.lit(0.3)) + F.when(n_tables > 0, 0.1).otherwise(0.05))


def ocr_confidence(confidences: Column) -> Column:
    """The mean of the positive confidences of words, of 100; a half if there are none."""
    good = F.filter(confidences, lambda c: c > 0)
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, c: a + c) / F.size(good) / 100).otherwise(0.5)


def escalated(pages: DataFrame, next_pages: DataFrame, gate: float = GATE) -> DataFrame:
    """pages (document_id, page_num, text, confidence, strategy), those below the gate replaced by next_pages' where there is one.

    One step only. next_pages has the same columns, from the next strategy. A page that the
    next strategy doesn't have keeps its text, and is marked as escalated all the same.
    """
    new = next_pages.select("document_id", "page_num", F.col("text").alias("new_text"), F.col("confidence").alias("new_confidence"), F.lit(True).alias("found"))
    low = F.col("confidence") < gate
    # pages at or above the gate need no partner: they don't enter the join
    passed = pages.filter(~low).withColumn("escalated", F.lit(False)).withColumn("escalated_from", F.lit(None).cast("string"))
    joined = pages.filter(low).join(new, ["document_id", "page_num"], "left")
    moved = joined.select(
        "document_id",
        "page_num",
        F.when(F.col("found"), F.col("new_text")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("found"), F.col("new_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        next_strategy(F.col("strategy")).alias("strategy"),
        F.lit(True).alias("escalated"),
        F.col("strategy").alias("escalated_from"),
    )
    return passed.select(moved.columns).unionByName(moved)


def extraction_rollup(pages: DataFrame) -> DataFrame:
    """One row per document of extracted pages."""
    return pages.groupBy("document_id").agg(F.count("*").alias("pages_processed"), F.sum(F.length("text")).alias("total_text_length"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"), F.bool_or("escalated").alias("escalated"), F.count_if("escalated").alias("n_escalated"))


def efficiency(seconds: Column) -> Column:
    return F.when(seconds < 30, "high").when(seconds < 60, "medium").otherwise("low")


def markdown_pages(markdown: Column) -> Column:
    """Pieces before headings that follow a blank line."""
    return F.filter(F.transform(F.split(markdown, r"(?U)\n\s*\n(?=#)"), T.strip), lambda p: p != "")


_TABLE = r"(?d)((?:^|\n)\|[^\n]*\|[ \t]*\n\|[ \t:|\-]+\|[ \t]*(?:\n\|[^\n]*\|[ \t]*)*)"


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(T.strip(line), r"^\||\|$", ""), r"\|"), T.strip)


def markdown_tables(markdown: Column) -> Column:
    """Tables of Markdown: arrays of struct(headers, data, rows, columns, confidence)."""
    blocks = F.regexp_extract_all(markdown, F.lit(_TABLE), F.lit(1))

    def table(block: Column) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda x: T.strip(x) != "")
        head = _cells(F.element_at(lines, 1))
        data = F.transform(F.slice(lines, 3, F.greatest(F.lit(1), F.size(lines))), _cells)
        return F.struct(head.alias("headers"), data.alias("data"), F.size(data).alias("rows"), F.size(head).alias("columns"), F.lit(0.8).alias("confidence"))

    return F.transform(blocks, table)


def without_tables(markdown: Column) -> Column:
    return T.strip(F.regexp_replace(markdown, _TABLE, "\n"))


def cell_table(grid: Column) -> Column:
    """A reader's grid of cells as struct(headers, data, rows, columns, confidence): cells trimmed, empty rows dropped."""
    clean = F.transform(grid, lambda row: F.transform(row, lambda c: T.strip(F.coalesce(c, F.lit("")))))
    data = F.filter(F.slice(clean, 2, F.greatest(F.lit(1), F.size(clean))), lambda row: F.exists(row, lambda c: c != ""))
    head = F.coalesce(F.try_element_at(clean, F.lit(1)), F.array().cast("array<string>"))
    return F.struct(F.filter(head, lambda c: c != "").alias("headers"), data.alias("data"), F.size(data).alias("rows"), F.size(head).alias("columns"), F.lit(0.75).alias("confidence"))


def spaced_table(text: Column) -> Column:
    """A table of lines whose cells stand two spaces or a tab apart: three such lines or more, two rows of two cells or more; else null."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("  ") | x.contains("\t"))
    rows = F.filter(F.transform(lines, lambda x: F.filter(F.transform(F.split(x, r"\s{2,}|\t"), T.strip), lambda c: c != "")), lambda r: F.size(r) > 1)
    return F.when((F.size(lines) >= 3) & (F.size(rows) >= 2), F.struct(rows[0].alias("headers"), F.slice(rows, 2, F.greatest(F.lit(1), F.size(rows))).alias("data"), (F.size(rows) - 1).alias("rows"), F.size(rows[0]).alias("columns"), F.lit(0.6).alias("confidence")))


def clean_header(name: Column) -> Column:
    clean = F.btrim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+", "_"), F.lit("_"))
    return T.let(clean, lambda c: F.when(c == "", "column").otherwise(c))


def numbered_headers(headers: Column) -> Column:
    """Clean headers of one table: repeats become name_2, name_3. Each is cleaned and counted once."""

    def numbered(clean: Column) -> Column:
        nth = lambda h, k: F.size(F.filter(F.slice(clean, F.lit(1), k + 1), lambda x: x == h))
        return F.transform(clean, lambda h, k: T.let(nth(h, k), lambda n: F.when(n > 1, F.concat(h, F.lit("_"), n.cast("string"))).otherwise(h)))

    return T.let(F.transform(headers, clean_header), numbered)


def row_map(headers: Column, row: Column) -> Column:
    """A row as a map by header: padded with empty cells, or cut."""
    padded = F.slice(F.concat(row, F.array_repeat(F.lit(""), F.size(headers))), F.lit(1), F.size(headers))
    return F.map_from_arrays(headers, F.transform(padded, lambda c: T.collapsed(F.coalesce(c, F.lit("")))))
