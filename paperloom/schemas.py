"""Schemas of the tables that the engine reads and writes, and their row checks as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BBOX = "struct<x:double,y:double,width:double,height:double,page_num:int,page_width:double,page_height:double>"
TABLES = "array<struct<table_id:string,page_num:int,rows:int,columns:int,headers:array<string>,data:array<array<string>>,confidence:double>>"

PAGES = f"document_id string, page_num int, text string, text_length int, confidence double, extraction_method string, escalated_from string, strategy_used string, tables {TABLES}, page_metadata string"
LDUS = f"ldu_id string, document_id string, ldu_type string, role string, text string, text_length int, content_hash string, confidence double, page_num int, page_refs array<int>, bbox {BBOX}, position_in_document int, parent_section string, extraction_method string"
FACTS = "id long, document_id string, ldu_id string, section string, page_num int, line_number int, key string, metric string, value double, unit string, date string, confidence double, description string, sentence string, content_hash string, bbox_json string, extraction_date string"
LEDGER = "document_id string, filename string, strategy string, confidence double, cost double, processing_time double, pages_processed int, escalated boolean, efficiency string, origin_type string, layout_complexity string, logged_at timestamp_ntz"
QUESTIONS = "question_id long, document_id string, question string"


def profile_issue() -> Column:
    """Why a document profile is refused, or null."""
    return F.when((F.col("total_pages") == 0) & (F.col("total_chars") > 0), "characters without pages")


def mended_average() -> Column:
    """avg_chars_per_page, recomputed where it is off by more than 1."""
    true = F.when(F.col("total_pages") > 0, F.col("total_chars") / F.col("total_pages")).otherwise(0.0)
    return F.when(F.abs(F.col("avg_chars_per_page") - true) > 1.0, true).otherwise(F.col("avg_chars_per_page"))


def bbox_issue(box: Column) -> Column:
    """Why a bounding box is refused, or null: it must lie inside its page, if the page's size is known."""
    return F.when(box["x"] + box["width"] > box["page_width"], "wider than the page").when(box["y"] + box["height"] > box["page_height"], "higher than the page")


def bbox_area(box: Column) -> Column:
    return box["width"] * box["height"]


def bbox_centre(box: Column) -> Column:
    return F.struct((box["x"] + box["width"] / 2).alias("x"), (box["y"] + box["height"] / 2).alias("y"))


def preview(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
