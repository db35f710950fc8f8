"""What extractors hand over, mended to one schema, and what the engine hands on as JSON: tables and page indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .sections import ROOT, grouped, placed, promoted, sections

#: One table as extractors write it. Any field may be missing, and data may hold headers and data itself.
_TABLE = "struct<table_id:string,page_num:int,rows:int,columns:int,headers:array<string>,data:string,confidence:double>"
_NESTED = "struct<headers:array<string>,data:array<array<string>>>"


def normal_tables(tables_json: Column, page_num: Column) -> Column:
    """array of tables (schemas.TABLES) from their JSON; none for a null or broken text.

    A missing id counts from 1 inside the page, missing sizes are those of headers and
    data, a missing page is the page's own, and a missing confidence is 0.6. Cells are
    texts; rows that are no lists are left out.
    """
    found = F.coalesce(F.from_json(tables_json, f"array<{_TABLE}>"), F.array().cast(f"array<{_TABLE}>"))

    def mended(t: Column, k: Column) -> Column:
        inner = F.from_json(t["data"], _NESTED)
        nested = F.ltrim(t["data"]).startswith("{")
        headers = F.coalesce(F.when(F.size(t["headers"]) > 0, t["headers"]), F.when(nested, inner["headers"]), F.array().cast("array<string>"))
        data = F.coalesce(F.when(nested, inner["data"]).otherwise(F.from_json(t["data"], "array<array<string>>")), F.array().cast("array<array<string>>"))
        data = F.filter(data, lambda row: row.isNotNull())
        return F.struct(
            F.coalesce(t["table_id"], F.concat(F.lit("table_"), page_num.cast("string"), F.lit("_"), (k + 1).cast("string"))).alias("table_id"),
            F.coalesce(F.nullif(t["page_num"], F.lit(0)), page_num).alias("page_num"),
            F.coalesce(t["rows"], F.size(data)).alias("rows"),
            F.coalesce(t["columns"], F.size(headers)).alias("columns"),
            headers.alias("headers"),
            data.alias("data"),
            F.coalesce(t["confidence"], F.lit(0.6)).alias("confidence"),
        )

    return F.transform(F.filter(found, lambda t: t.isNotNull()), mended)


def repaired(pages: DataFrame) -> DataFrame:
    """Pages (document_id, nth from 1, page_num, page_number, text, tables_json, confidence) with page_num, text, tables and confidence mended.

    A page's number is its page_num, else its page_number, else its place. Missing texts
    are empty, and confidences lie in 0 to 1.
    """
    number = F.coalesce("page_num", "page_number", "nth").cast("int")
    text = F.coalesce("text", F.lit(""))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    rows = pages.withColumn("page_num", number)
    return rows.withColumns({"text": text, "text_length": F.length(text), "tables": normal_tables(F.col("tables_json"), F.col("page_num")), "confidence": sure}).drop("tables_json", "page_number")


#: Metadata of an extraction that a document may bring itself.
METADATA = "total_pages int, total_text_length long, total_tables long, average_confidence double, extraction_cost string, processing_time_seconds double, pages_processed int, confidence_threshold double"


def with_metadata(given: DataFrame, pages: DataFrame, threshold: float = 0.7) -> DataFrame:
    """given (document_id, and any of METADATA) with what is missing or null set from its repaired pages; documents without pages have none of them."""
    names = [c.split()[0] for c in METADATA.split(", ")]
    for kind in METADATA.split(", "):
        if kind.split()[0] not in given.columns:
            given = given.withColumn(kind.split()[0], F.lit(None).cast(kind.split()[1]))
    sums = pages.groupBy("document_id").agg(F.count("*").cast("int").alias("n"), F.sum("text_length").alias("chars"), F.sum(F.size("tables")).alias("tables"))
    none = F.lit(0)
    defaults = {"total_pages": F.coalesce("n", none), "total_text_length": F.coalesce("chars", none), "total_tables": F.coalesce("tables", none), "average_confidence": F.lit(0.0)}
    defaults |= {"extraction_cost": F.lit("medium"), "processing_time_seconds": F.lit(0.0), "pages_processed": F.coalesce("n", none), "confidence_threshold": F.lit(threshold)}
    rows = given.join(sums, "document_id", "left")
    return rows.withColumns({k: F.coalesce(F.col(k), v) for k, v in defaults.items()}).select("document_id", *names)


def whole_page_box(page_num: Column) -> Column:
    """The box of a whole page, in shares of it, where none is known."""
    return F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), page_num.cast("int").alias("page_num"))


def table_json(tables: DataFrame, flatten: bool = False) -> DataFrame:
    """(document_id, value): JSON of tables (document_id, page, table_index, rows: array of maps), in order.

    Grouped by page and table, or flatten: one row for each row of a table.
    """
    if flatten:
        return tables.select("document_id", "page", "table_index", F.posexplode("rows").alias("place", "row")).orderBy("document_id", "page", "table_index", "place").select("document_id", F.to_json("row").alias("value"))
    each = F.array_sort(F.collect_list(F.struct("page", "table_index", F.to_json("rows").alias("rows"))))
    one = lambda t: F.concat(F.lit('{"page":'), t["page"].cast("string"), F.lit(',"table_index":'), t["table_index"].cast("string"), F.lit(',"rows":'), t["rows"], F.lit("}"))
    return tables.groupBy("document_id").agg(F.concat(F.lit("["), F.array_join(F.transform(each, one), ","), F.lit("]")).alias("value"))


_CHILDREN = "array<struct<section_id:string,title:string,page_refs:array<int>,ldu_ids:array<string>,summary:string>>"


def page_index_json(ldus: DataFrame) -> DataFrame:
    """(document_id, value): the nested page index of each document: its pages with their chunks, and its sections with their members.

    A page's section is that of its first chunk, if that belongs to a top section; chunks of
    none are of the root. A document's index is one value, as large as its own text.
    """
    nodes = grouped(promoted(sections(ldus))[1])
    lookup = placed(ldus).select("document_id", "ldu_id", "text", "position")
    member = nodes.filter("depth = 1").select("document_id", "section_id", "title", F.explode("ldu_ids").alias("ldu_id"))
    bodies = member.join(lookup, ["document_id", "ldu_id"]).groupBy("document_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("held"))
    bodies = bodies.select("document_id", "section_id", F.sha2(F.array_join(F.transform("held", lambda x: x["text"]), " "), 256).alias("content_hash"))
    child = nodes.filter("depth = 2").select("document_id", F.col("parent_id").alias("section_id"), F.struct("section_ord", "section_id", "title", "page_refs", "ldu_ids", "summary").alias("c"))
    children = child.groupBy("document_id", "section_id").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.dropFields("section_ord")).alias("children"))
    none = F.array().cast(_CHILDREN)
    tops = nodes.filter("depth = 1").withColumn("page_refs", F.col("page_refs").cast("array<int>")).join(bodies, ["document_id", "section_id"], "left").join(children, ["document_id", "section_id"], "left")
    section = F.struct("section_id", "title", F.col("title").alias("section_title"), "summary", "page_refs", "ldu_ids", F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.coalesce(F.col("children").cast(_CHILDREN), none).alias("children"))
    listed = tops.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "section_ord", section.alias("s")))), lambda x: x["s"]).alias("sections"))

    first = member.groupBy("document_id", "ldu_id").agg(F.min(F.struct("section_id", "title")).alias("m"))
    rows = ldus.join(first, ["document_id", "ldu_id"], "left")
    title = F.coalesce("m.title", F.lit(ROOT))
    page_id = F.concat("document_id", F.lit("_page_"), F.col("page_num").cast("string"))
    chunk = F.struct("position", "ldu_id", F.col("page_num").alias("page_number"), title.alias("section_title"), "text", "content_hash", F.array(page_id, F.col("ldu_id")).alias("provenance"), F.col("m.section_id").alias("section_id"))
    pages = rows.groupBy("document_id", "page_num").agg(F.array_sort(F.collect_list(chunk)).alias("held"))
    pages = pages.select(
        "document_id",
        F.struct(
            F.col("page_num").alias("page_number"),
            F.col("held")[0]["section_title"].alias("section_title"),
            F.col("held")[0]["section_id"].alias("section_id"),
            F.sha2(F.array_join(F.transform("held", lambda x: x["text"]), "\n\n"), 256).alias("content_hash"),
            F.array(page_id).alias("provenance"),
            F.transform("held", lambda x: x.dropFields("position", "section_id")).alias("ldus"),
        ).alias("p"),
    )
    pages = pages.groupBy("document_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))
    whole = pages.join(listed, "document_id", "left")
    return whole.select("document_id", F.to_json(F.struct("document_id", F.col("document_id").alias("title"), "pages", "sections", F.col("sections").alias("children")), {"ignoreNullFields": "false"}).alias("value"))


def summarised(text: Column, summarise: Callable[[str | None], str | None] | None = None) -> Column:
    """A summary by a function of text to text (an external service, called in batches), or the first 220 characters where it is absent or gives none."""
    if summarise is None:
        return T.summary(text)
    return F.coalesce(F.nullif(T.strip(F.pandas_udf(lambda s: s.map(summarise), "string")(text)), F.lit("")), T.summary(text))
