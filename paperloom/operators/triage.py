"""Triage: page signals, origin, layout, language, domain, category, cost and quality of documents.

Every rule is an expression; what needs several pages of a document is one grouped
aggregate with map-side combine. Rules and keywords are literals of a few rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SAMPLED = 12

#: Keywords by domain; of equal counts the first domain counts.
DOMAINS: dict[str, tuple[str, ...]] = {
    "legal": ("contract", "agreement", "legal", "law", "court", "judge", "attorney"),
    "financial": ("invoice", "payment", "balance", "account", "bank", "financial", "tax"),
    "medical": ("patient", "medical", "diagnosis", "treatment", "prescription", "hospital"),
    "technical": ("specification", "manual", "technical", "engineering", "diagram"),
    "business": ("report", "meeting", "proposal", "business", "company", "corporate"),
    "academic": ("research", "study", "university", "paper", "journal", "academic"),
    "government": ("government", "official", "permit", "license", "regulation"),
    "personal": ("letter", "personal", "family", "individual", "private"),
}
#: Substrings that speak for English.
ENGLISH = ("the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")


@dataclass(frozen=True)
class Rule:
    """A category's criteria: least and most values by metric, both inclusive."""

    category: str
    threshold: float
    strategy: str
    least: Mapping[str, float]
    most: Mapping[str, float]


#: The categories that hold without calibration, in the order that decides ties.
RULES = (
    Rule("simple_text", 0.8, "fast_text", {}, {"avg_chars_per_page": 1000, "image_area_ratio": 0.1, "table_count": 1, "column_count": 2}),
    Rule("moderate_complexity", 0.7, "layout", {"avg_chars_per_page": 1000}, {"avg_chars_per_page": 2000, "image_area_ratio": 0.3, "table_count": 3, "column_count": 3}),
    Rule("high_complexity", 0.6, "vision", {"avg_chars_per_page": 2000, "image_area_ratio": 0.3, "table_count": 3, "column_count": 3}, {}),
)


def page_sample(total_pages: Column, most: int = SAMPLED) -> Column:
    """The pages (from 0) that triage reads: all, or the first three, the last, and an even spread between."""
    step = F.greatest(F.lit(1), F.floor((total_pages - 1) / (most - 4 + 1)).cast("int"))
    inner = F.filter(F.transform(F.sequence(F.lit(1), F.lit(4 * most)), lambda k: (k * step).cast("int")), lambda p: (p > 2) & (p < total_pages - 1))
    chosen = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), F.lit(1), F.lit(2), (total_pages - 1).cast("int")), F.slice(inner, 1, most - 4))))
    return F.when(total_pages <= 0, F.array().cast("array<int>")).when(total_pages <= most, F.sequence(F.lit(0), (total_pages - 1).cast("int"))).otherwise(F.slice(chosen, 1, most))


def page_signals(pages: DataFrame) -> DataFrame:
    """pages (document_id, page_num, text, and n_images if there) with chars, image_area_ratio, is_searchable, table_hit and keyword flags."""
    text = F.coalesce("text", F.lit(""))
    images = F.col("n_images") if "n_images" in pages.columns else F.lit(0)
    chars = F.length(T.strip(text))
    low = F.lower(text)
    return pages.select(
        "document_id",
        "page_num",
        chars.alias("chars"),
        F.when(chars < 50, 0.8).when((images > 0) & (chars < 200), 0.6).when(images > 0, 0.3).otherwise(0.0).alias("image_area_ratio"),
        (chars > 100).alias("is_searchable"),
        ((text.contains("  ") & (T.n_digits(text) > 30)) | text.contains("\t")).alias("table_hit"),
        T.has_any(low, ("watermark", "confidential")).alias("has_watermarks"),
        T.has_any(low, ("signature", "signed")).alias("has_signatures"),
    )


def document_metrics(signals: DataFrame, columns: Column | None = None, fonts: Column | None = None) -> DataFrame:
    """One row per document: sums and means over its (sampled) pages."""
    scanned = (F.col("chars") < 50) | ~F.col("is_searchable") | (F.col("image_area_ratio") > 0.65)
    rows = signals.groupBy("document_id").agg(
        F.count("*").alias("total_pages"),
        F.sum("chars").alias("total_chars"),
        F.avg("chars").alias("avg_chars_per_page"),
        F.avg("image_area_ratio").alias("image_area_ratio"),
        F.count_if("table_hit").alias("table_count"),
        (F.count_if("is_searchable") >= F.greatest(F.lit(1), F.floor(F.count("*") / 2))).alias("is_searchable"),
        F.count_if(scanned).alias("scanned_pages"),
        F.count_if((F.col("chars") >= 50) & (F.col("chars") < 200) & F.col("is_searchable")).alias("short_pages"),
        F.bool_or("has_watermarks").alias("has_watermarks"),
        F.bool_or("has_signatures").alias("has_signatures"),
    )
    # of a document that is mostly scanned, pages of little text count as scanned too
    mostly = F.col("scanned_pages") / F.col("total_pages") > 0.8
    rows = rows.withColumn("scanned_pages", F.col("scanned_pages") + F.when(mostly, F.col("short_pages")).otherwise(0)).drop("short_pages")
    return rows.withColumns({"column_count": F.lit(1) if columns is None else columns, "has_fonts": (F.col("total_chars") > 0) if fonts is None else fonts})


def origin_type(denominator: Column | None = None) -> Column:
    """native_digital, scanned_image or mixed, from the columns of document_metrics."""
    ratio = F.col("scanned_pages") / F.greatest(F.lit(1), denominator if denominator is not None else F.col("total_pages"))
    native = (F.col("scanned_pages") == 0) & (F.col("image_area_ratio") < 0.35) & F.col("has_fonts") & (F.col("avg_chars_per_page") > 300)
    scanned = (ratio == 1) | ((F.col("image_area_ratio") > 0.7) & (F.col("avg_chars_per_page") < 120) & ~F.col("has_fonts"))
    return F.when(native, "native_digital").when(scanned, "scanned_image").otherwise("mixed")


def origin_of_whole() -> Column:
    """Origin where pages have no metrics; needs file_size too."""
    avg, searchable = F.col("avg_chars_per_page"), F.col("is_searchable")
    return (
        F.when((avg < 100) | ((F.col("file_size") > 10 * 1024 * 1024) & (F.col("total_chars") < 1000) & ~searchable), "scanned_image")
        .when(searchable & (avg > 500), "native_digital")
        .when(~searchable & (avg < 50), "scanned_image")
        .otherwise("unknown")
    )


def layout_complexity() -> Column:
    return F.when(F.col("table_count") > 3, "table_heavy").when(F.col("image_area_ratio") > 0.3, "figure_heavy").when(F.col("column_count") > 2, "multi_column").otherwise("single_column")


def language_guess(low: Column) -> tuple[Column, Column]:
    """(language, confidence) of lower-case text."""
    english = T.n_contained(low, ENGLISH) >= 5
    return F.when(english, "en").otherwise("unknown"), F.when(english, 0.8).otherwise(0.5)


def domain_guess(low: Column, domains: Mapping[str, Sequence[str]] = DOMAINS) -> tuple[Column, Column]:
    """(domain, confidence): the domain of most keywords, each counted once; the first of equals; general if there are none."""
    hits = [(name, T.n_contained(low, tuple(some))) for name, some in domains.items()]
    most = F.greatest(*[n for _, n in hits])
    name = F.lit("general")
    for each, n in reversed(hits):
        name = F.when((n == most) & (most > 0), each).otherwise(name)
    return name, F.when(most > 0, F.least(most / 3.0, F.lit(1.0))).otherwise(0.5)


def share(rule: Rule) -> Column:
    """The share of a rule's criteria that hold, or -1 under its threshold."""
    tests = [F.col(m) >= v for m, v in rule.least.items()] + [F.col(m) <= v for m, v in rule.most.items()]
    out = sum((t.cast("int") for t in tests), F.lit(0)) / max(1, len(tests)) if tests else F.lit(0.0)
    return F.when(out >= rule.threshold, out).otherwise(F.lit(-1.0))


def category(rules: Sequence[Rule] = RULES, shares: Sequence[Column] = ()) -> tuple[Column, Column, Column]:
    """(category, confidence, strategy) from metrics, origin_type and layout_complexity: guards first, then the best share of met criteria.

    shares: those of the rules, if they are columns already.
    """
    ratio = F.col("scanned_pages") / F.greatest(F.lit(1), F.col("total_pages"))
    mixed = F.col("origin_type") == "mixed"
    guards = (
        (mixed & (ratio >= 0.5), "high_complexity", ratio, "hybrid"),
        (mixed, "moderate_complexity", F.greatest(F.lit(0.7), 1 - ratio), "layout"),
        (F.col("layout_complexity").isin("multi_column", "table_heavy") & (F.col("origin_type") != "scanned_image"), "moderate_complexity", F.lit(0.8), "layout"),
        (F.col("avg_chars_per_page") < 100, "high_complexity", F.lit(1.0), "vision"),
    )
    scored = list(zip(rules, shares or [share(r) for r in rules], strict=True))
    best = F.greatest(*[s for _, s in scored], F.lit(-1.0))
    out = [F.lit("moderate_complexity"), F.lit(0.5), F.lit("layout")]
    for rule, own in reversed(scored):
        wins = (own == best) & (best >= 0)
        out = [F.when(wins, x).otherwise(o) for x, o in zip((F.lit(rule.category), own, F.lit(rule.strategy or "layout")), out, strict=True)]
    for test, name, sure, strategy in reversed(guards):
        out = [F.when(test, x).otherwise(o) for x, o in zip((F.lit(name), sure.cast("double"), F.lit(strategy)), out, strict=True)]
    return out[0], out[1], out[2]


def categorised(rows: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """rows with category, category_confidence and strategy; the shares are computed once, which keeps the generated code small."""
    names = [f"__share{k}" for k in range(len(rules))]
    name, sure, strategy = category(rules, [F.col(n) for n in names])
    found = rows.withColumns({n: share(r) for n, r in zip(names, rules, strict=True)})
    return found.withColumns({"category": name, "category_confidence": sure, "strategy": strategy}).drop(*names)


def extraction_cost(strategy: Column) -> Column:
    return F.when(strategy == "fast_text", "fast_text").when(strategy == "vision", "needs_vision_model").otherwise("needs_layout_model")


def quality_scores() -> tuple[Column, Column, Column]:
    """(text, structure, overall)."""
    gain = lambda test, by: F.when(test, by).otherwise(0.0)
    text = F.least(F.lit(1.0), 0.5 + gain(F.col("is_searchable"), 0.3) + gain(F.col("avg_chars_per_page").between(100, 3000), 0.2))
    structure = F.least(F.lit(1.0), 0.5 + gain(F.col("image_area_ratio") < 0.3, 0.2) + gain(F.col("table_count").between(0, 5), 0.2) + gain(F.col("column_count").between(1, 3), 0.1))
    return text, structure, 0.6 * text + 0.4 * structure


def first_pages(pages: DataFrame, n: int = 3) -> DataFrame:
    """document_id and low: the lower-case text of each document's first n pages, joined by a space."""
    early = pages.filter(F.col("page_num") <= n)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"])
    return early.groupBy("document_id").agg(F.lower(F.array_join(texts, " ")).alias("low"))


def sampled(pages: DataFrame, most: int = SAMPLED) -> DataFrame:
    """The pages (document_id, page_num from 1, ...) that triage reads, with n_pages, the number of all pages of the document."""
    totals = pages.groupBy("document_id").agg(F.count("*").alias("n_pages"))
    return pages.join(totals, "document_id").filter(F.array_contains(page_sample(F.col("n_pages"), most), (F.col("page_num") - 1).cast("int")))


def profiles(pages: DataFrame, rules: Sequence[Rule] = RULES, domains: Mapping[str, Sequence[str]] = DOMAINS, most: int = SAMPLED) -> DataFrame:
    """The whole triage of pages: one row per document, from a sample of most pages of each.

    total_pages counts all pages, and total_chars is the sample's mean times that, rounded down.
    """
    read = sampled(pages, most)
    metrics = document_metrics(page_signals(read.drop("n_pages")))
    rows = metrics.join(first_pages(pages), "document_id", "left").withColumn("low", F.coalesce("low", F.lit("")))
    rows = rows.withColumn("origin_type", origin_type()).withColumn("layout_complexity", layout_complexity())
    rows = categorised(rows, rules)
    counts = read.groupBy("document_id").agg(F.max("n_pages").alias("n_pages"))
    rows = rows.join(counts, "document_id").withColumns({"total_pages": F.col("n_pages"), "total_chars": F.floor(F.col("avg_chars_per_page") * F.col("n_pages")).cast("long")})
    (text, structure, overall), (lang, lang_sure), (domain, domain_sure) = quality_scores(), language_guess(F.col("low")), domain_guess(F.col("low"), domains)
    return rows.select(
        *metrics.columns,
        "origin_type",
        "layout_complexity",
        lang.alias("language"),
        lang_sure.alias("language_confidence"),
        domain.alias("domain_hint"),
        domain_sure.alias("domain_confidence"),
        "category",
        "category_confidence",
        F.col("strategy").alias("recommended_strategy"),
        extraction_cost(F.col("strategy")).alias("extraction_cost"),
        text.alias("text_quality"),
        structure.alias("structure_quality"),
        overall.alias("overall_quality"),
    )


def domain_by_join(docs: DataFrame, keywords: DataFrame) -> DataFrame:
    """domain_guess for an open set of keywords (domain, ord, keyword), a small table: document_id, domain_hint, domain_confidence."""
    met = docs.alias("d").join(F.broadcast(keywords).alias("k"), F.expr("contains(d.low, k.keyword)"))
    hits = met.groupBy("document_id", "domain", "ord").agg(F.countDistinct("keyword").alias("n"))
    first = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("n"), "ord"))
    best = hits.withColumn("nth", first).filter("nth = 1")
    return docs.select("document_id").join(best, "document_id", "left").select("document_id", F.coalesce("domain", F.lit("general")).alias("domain_hint"), F.coalesce(F.least(F.col("n") / 3.0, F.lit(1.0)), F.lit(0.5)).alias("domain_confidence"))
