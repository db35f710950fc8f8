"""Section trees of documents, as adjacency rows: a titled chunk opens a section and the next ones belong to it.

All order is inside a document, by position; a document's chunks are bounded by its own
length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ROOT = "Document Root"

#: Known groups of financial reports: title of the group, and what titles of its members contain.
GROUPS = (
    ("Chairman's Message", ("chairman", "president", "message")),
    ("Financial Performance", ("profit or loss", "income statement", "financial position", "balance sheet", "cash flow")),
    ("Risk Management", ("risk",)),
    ("Corporate Governance", ("governance", "board")),
)


def placed(ldus: DataFrame) -> DataFrame:
    """ldus with title (of those that open a section) and section_ord: 0 before the first title, or 1 throughout if there is none."""
    order = Window.partitionBy("document_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = ldus.withColumn("title", T.title(F.col("text")))
    rows = rows.withColumn("section_ord", F.count("title").over(order).cast("int"))
    return rows.withColumn("untitled", F.max("section_ord").over(Window.partitionBy("document_id")) == 0)


def sections(ldus: DataFrame) -> DataFrame:
    """(document_id, section_ord, section_id, title, page_refs, ldu_ids, content_hash, summary), before promotion and grouping.

    Chunks before the first title belong to the root, not to a section. A document without
    titles has one section, "Document Body".
    """
    rows = placed(ldus).filter("untitled OR section_ord > 0").withColumn("section_ord", F.when(F.col("untitled"), 0).otherwise(F.col("section_ord")))
    held = F.array_sort(F.collect_list(F.struct("position", "ldu_id", "text", "page_num", "title")))
    rows = rows.groupBy("document_id", "section_ord").agg(held.alias("held"))
    texts = F.transform("held", lambda x: x["text"])
    return rows.select(
        "document_id",
        "section_ord",
        F.concat("document_id", F.lit("_section_"), F.col("section_ord").cast("string")).alias("section_id"),
        F.coalesce(F.element_at("held", 1)["title"], F.lit("Document Body")).alias("title"),
        F.array_sort(F.array_distinct(F.transform("held", lambda x: x["page_num"]))).alias("page_refs"),
        F.transform("held", lambda x: x["ldu_id"]).alias("ldu_ids"),
        F.sha2(F.array_join(texts, " "), 256).alias("content_hash"),
        T.summary(F.array_join(F.slice(texts, 1, 4), "\n\n")).alias("summary"),
    )


def promoted(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(titles, rest): the title of each document (its first section's, if that names the document), and the sections without it."""
    first = (F.col("section_ord") <= 1) & T.names_document(F.col("title"), F.col("document_id"))
    titles = found.filter(first).select("document_id", F.col("title").alias("document_title"))
    return titles, found.filter(~first)


def group_of(title: Column) -> Column:
    low = F.lower(title)
    out = F.lit(None).cast("string")
    for name, marks in reversed(GROUPS):
        out = F.when(T.has_any(low, marks), name).otherwise(out)
    return out


def grouped(found: DataFrame) -> DataFrame:
    """Sections with known ones under their group: rows of depth 1 (sections and groups) and 2 (members), in pre-order by (ord, depth, section_ord).

    A group stands where its first member stood and has its members' pages and chunks; a
    member of the group's own title is not repeated as its child.
    """
    rows = found.withColumn("parent", group_of(F.col("title")))
    kinds = Window.partitionBy("document_id", "parent")
    rows = rows.withColumn("ord", F.when(F.col("parent").isNull(), F.col("section_ord")).otherwise(F.min("section_ord").over(kinds)))
    groups = rows.filter("parent IS NOT NULL").groupBy("document_id", "parent", "ord").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("page_refs")))).alias("page_refs"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section_ord", "ldu_ids"))), lambda x: x["ldu_ids"])).alias("ldu_ids"),
        F.max_by("summary", -F.col("section_ord")).alias("summary"),
    )
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("ord"))
    groups = groups.withColumn("section_id", F.concat("document_id", F.lit("_root_"), number.cast("string")))
    tops = groups.select("document_id", "ord", F.lit(0).alias("section_ord"), F.lit(1).alias("depth"), "section_id", F.lit(None).cast("string").alias("parent_id"), F.col("parent").alias("title"), "page_refs", "ldu_ids", "summary")
    alone = rows.filter("parent IS NULL").select("document_id", "ord", "section_ord", F.lit(1).alias("depth"), "section_id", F.lit(None).cast("string").alias("parent_id"), "title", "page_refs", "ldu_ids", "summary")
    members = rows.filter("parent IS NOT NULL").join(groups.select("document_id", "parent", F.col("section_id").alias("parent_id")), ["document_id", "parent"])
    members = members.filter(T.normal_title(F.col("title")) != T.normal_title(F.col("parent"))).select("document_id", "ord", "section_ord", F.lit(2).alias("depth"), "section_id", "parent_id", "title", "page_refs", "ldu_ids", "summary")
    return tops.unionByName(alone).unionByName(members)


def tree(ldus: DataFrame) -> DataFrame:
    """The section tree of ldus: promotion, then grouping, under a root of depth 0 for each document.

    The root's title is the promoted one, or the document's id in words; it holds the
    chunks before the first title, or all of a document without titles.
    """
    titles, rest = promoted(sections(ldus))
    rows = placed(ldus)
    before = F.col("untitled") | (F.col("section_ord") == 0)
    roots = rows.groupBy("document_id").agg(
        F.array_sort(F.array_distinct(F.collect_list(F.when(before, F.col("page_num"))))).alias("page_refs"),
        F.transform(F.array_sort(F.collect_list(F.when(before, F.struct("position", "ldu_id")))), lambda x: x["ldu_id"]).alias("ldu_ids"),
    )
    root_id = F.concat("document_id", F.lit("_root"))
    named = F.coalesce("document_title", F.nullif(T.human_id(F.col("document_id")), F.lit("")), F.lit("Document"))
    roots = roots.join(titles, "document_id", "left").select("document_id", F.lit(0).alias("ord"), F.lit(0).alias("section_ord"), F.lit(0).alias("depth"), root_id.alias("section_id"), F.lit(None).cast("string").alias("parent_id"), named.alias("title"), "page_refs", "ldu_ids", F.lit("").alias("summary"))
    under = grouped(rest).withColumn("parent_id", F.coalesce("parent_id", root_id))
    return roots.unionByName(under)


def flattened(nodes: DataFrame) -> DataFrame:
    """The tree in pre-order: a document's root and sections with their place (from 0)."""
    order = Window.partitionBy("document_id").orderBy(F.col("depth") > 0, "ord", "depth", "section_ord")
    return nodes.withColumn("place", F.row_number().over(order) - 1)


def outline(nodes: DataFrame) -> DataFrame:
    """(document_id, outline): indented titles of the sections, a line each."""
    lines = F.array_sort(F.collect_list(F.struct("place", F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- "), F.col("title")).alias("line"))))
    return flattened(nodes).filter("depth > 0").groupBy("document_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("outline"))


def page_sections(ldus: DataFrame) -> DataFrame:
    """(document_id, page_num, section_title, content_hash, ldu_ids): a page's section is that of its first chunk."""
    rows = placed(ldus)
    current = F.last("title", ignorenulls=True).over(Window.partitionBy("document_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    named = rows.withColumn("section_title", F.coalesce(current, F.when(F.col("untitled"), F.lit("Document Body")), F.lit(ROOT)))
    held = F.array_sort(F.collect_list(F.struct("position", "text", "ldu_id")))
    return named.groupBy("document_id", "page_num").agg(
        F.min_by("section_title", "position").alias("section_title"),
        F.sha2(F.array_join(F.transform(held, lambda x: x["text"]), "\n\n"), 256).alias("content_hash"),
        F.transform(held, lambda x: x["ldu_id"]).alias("ldu_ids"),
    )
