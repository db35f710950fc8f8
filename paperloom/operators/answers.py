"""Answers with citations, and the audit of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import facts, search
from .sections import sections as sections_of

MOST_CITATIONS = 10
NOTHING = "No grounded evidence found in the indexed document content."
#: Phrases of a page that support a numeric question which has them.
SUPPORTED = ("cash in hand", "total assets", "net profit", "general inflation", "food inflation", "revenue", "interest income")
_KEY = ["question_id", "document_id"]


def citations(pages: DataFrame, semantic: DataFrame, found: DataFrame, sections: DataFrame, limit: int = MOST_CITATIONS) -> DataFrame:
    """(question_id, document_id, nth, source, page_num, content_hash, excerpt): evidence in order of source, each (page, hash) once.

    pages: of search.page_search. semantic: (question_id, document_id, nth, page_num,
    content_hash, text). found: of facts.by_question, for numerical questions. sections: (question_id, document_id,
    nth, section_id, page_refs, summary), of which the first two pages count.
    """
    cols = [*_KEY, "source", "rank", "ord", "page_num", "content_hash", "excerpt"]
    one = pages.select(*_KEY, F.lit("page").alias("source"), F.lit(0).alias("rank"), F.col("nth").alias("ord"), "page_num", "content_hash", F.substring("excerpt", 1, 260).alias("excerpt"))
    two = semantic.select(*_KEY, F.lit("semantic").alias("source"), F.lit(1).alias("rank"), F.col("nth").alias("ord"), "page_num", "content_hash", F.substring("text", 1, 260).alias("excerpt"))
    three = found.select(*_KEY, F.lit("fact").alias("source"), F.lit(2).alias("rank"), F.col("nth").alias("ord"), "page_num", "content_hash", F.substring("sentence", 1, 260).alias("excerpt"))
    refs = sections.select(*_KEY, "nth", "section_id", "summary", F.posexplode(F.slice("page_refs", 1, 2)).alias("p", "page_num"))
    four = refs.select(*_KEY, F.lit("section").alias("source"), F.lit(3).alias("rank"), (F.col("nth") * 2 + F.col("p")).alias("ord"), "page_num", F.sha2(F.concat("section_id", F.lit("|"), F.col("page_num").cast("string")), 256).alias("content_hash"), F.col("summary").alias("excerpt"))
    every = one.select(cols).unionByName(two.select(cols)).unionByName(three.select(cols)).unionByName(four.select(cols))
    every = every.repartition(*_KEY)  # once, for both orders
    first = Window.partitionBy(*_KEY, "page_num", "content_hash").orderBy("rank", "ord")
    kept = every.withColumn("copy", F.row_number().over(first)).filter("copy = 1")
    order = Window.partitionBy(*_KEY).orderBy("rank", "ord", "page_num")
    return kept.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit).select(*_KEY, "nth", "source", "page_num", "content_hash", "excerpt")


def claim_words(text: Column) -> Column:
    """Words of over three characters, each once."""
    return F.array_distinct(F.filter(T.tokens(text), lambda w: F.length(w) > 3))


def overlap(claim: Column, excerpt: Column) -> Column:
    """Whether enough of the claim's words (claim_words) are among the excerpt's."""
    return F.size(F.array_intersect(claim, excerpt)) >= F.greatest(F.lit(1), F.least(F.lit(4), F.floor(F.size(claim) / 4)))


def verified(cited: DataFrame, questions: DataFrame, pages: DataFrame) -> DataFrame:
    """cited with status, from the cited page's whole text, or the citation's excerpt where the page is missing or blank. None is dropped."""
    # a page's words are found once, not for each citation of it
    seen = pages.select("document_id", "page_num", F.when(T.strip(F.coalesce("text", F.lit(""))) != "", claim_words(F.col("text"))).alias("page_words"))
    rows = cited.join(questions.select(*_KEY, claim_words(F.col("question")).alias("claim")), _KEY).join(seen, ["document_id", "page_num"], "left")
    supports = overlap(F.col("claim"), F.coalesce("page_words", claim_words(F.coalesce("excerpt", F.lit("")))))
    return rows.withColumn("status", F.when(F.coalesce(supports, F.lit(False)), "supports_claim").otherwise("weak_support")).drop("page_words", "claim")


#: What a fact is called in an answer, by the first of these that the question has.
LABELS = ("general inflation", "food inflation", "inflation", "net profit", "total assets", "revenue")


def fact_sentence(question: Column, metric: Column, value: Column, unit: Column, date: Column, page: Column) -> Column:
    """The answer that a fact gives: named by the question, else by its own metric; of its date, else the question's year."""
    low = facts.normal_question(question)
    label = T.strip(F.when(metric != "", metric).otherwise("metric"))
    for phrase in reversed(LABELS):
        label = F.when(F.contains(low, F.lit(phrase)), phrase).otherwise(label)
    of = F.coalesce(F.nullif(date, F.lit("")), T.year(question))
    when = F.when(of != "", F.concat(F.lit(" for "), of)).otherwise("")
    return F.concat(F.lit("The document reports "), label, F.lit(" of "), T.written(value), F.coalesce(unit, F.lit("")), when, F.lit(" on page "), page.cast("string"), F.lit("."))


REVENUE = "revenue from contracts with customers"
#: A cell of a year table.
_CELL = r"(?:\d{1,3}(?:,\d{3})*|\d+)"


def row_answer(question: Column, page_text: Column, page: Column) -> Column:
    """The answer that a financial row of the page gives, or null: the year's cell of a year table, else the first grouped number after its label."""
    has = lambda text, mark: F.contains(text, F.lit(mark))

    def by_target(low: Column) -> Column:
        target = F.when(has(low, "assets") & has(low, "total"), "total assets").when(has(low, "net profit"), "net profit").when(has(low, "revenue"), REVENUE)
        asking = F.struct(target.alias("target"), T.year(question).alias("asked"), T.full_date(low).alias("dated"))
        # of a question without a target no row is sought
        return T.let(target, lambda t: F.when(t.isNotNull(), T.let(asking, lambda a: T.let(T.collapsed(page_text), lambda flat: _row_of(a["target"], a["asked"], a["dated"], flat, F.lower(flat), page)))))

    return T.let(facts.normal_question(question), by_target)


def _row_of(target: Column, asked: Column, dated: Column, flat: Column, flat_low: Column, page: Column) -> Column:
    has = lambda text, mark: F.contains(text, F.lit(mark))
    # year, revenue, cost and profit of each row of a year table
    rows = F.regexp_extract_all(flat, F.lit(rf"\b(20\d\d\s+{_CELL}\s+{_CELL}\s+{_CELL})\b"), F.lit(1))
    row = F.split(F.try_element_at(F.filter(rows, lambda r: F.substring(r, 1, 4) == asked), F.lit(1)), r"\s+")
    cell = F.when(target == REVENUE, F.try_element_at(row, F.lit(2))).when(target == "net profit", F.try_element_at(row, F.lit(4)))
    in_table = (asked != "") & has(flat_low, "year revenue") & F.contains(flat_low, target) & cell.isNotNull()
    where = F.concat(F.lit(" on page "), page.cast("string"), F.lit("."))
    by_table = F.when(in_table, F.concat(F.lit("The document reports "), target, F.lit(" of "), cell, F.lit(" in "), asked, where))
    # a page without the question's date counts if it has both periods
    of_date = (dated == "") | F.contains(flat_low, dated) | has(flat_low, "30 june 2022") | ~has(dated, "2022")
    found = F.lit(None).cast("string")
    for mark in (REVENUE, "net profit", "total assets"):
        found = F.when(target == mark, F.regexp_extract(flat, rf"(?i){mark}.*?(\d{{1,3}}(?:,\d{{3}})+)", 1)).otherwise(found)
    label = F.when(target == REVENUE, "revenue").otherwise(target)
    as_of = F.when(dated != "", F.concat(F.lit(" as of "), dated)).otherwise("")
    return F.coalesce(by_table, F.when((found != "") & of_date, F.concat(F.lit("The document reports "), label, F.lit(" of "), found, as_of, where)))


#: What a page must have, in one of the spellings, if the question has the first.
_SUPPORT = (("approved", ("approved",)), ("authorised", ("authorised", "authorized")), ("issue", ("issue",)))


def supports_question(text: Column, question: Column) -> Column:
    """Whether a text has the approval, authorisation and issue that the question speaks of."""
    low, asked, out = F.lower(text), F.lower(question), F.lit(True)
    for mark, spellings in _SUPPORT:
        out = out & (~asked.contains(mark) | T.has_any(low, spellings))
    return out


def supports_number(text: Column, question: Column) -> Column:
    """Whether a text has one of the question's phrases, or, of a question without any, two of its keywords."""
    low, asked = F.lower(text), facts.normal_question(question)
    named = phrase = F.lit(False)
    for mark in SUPPORTED:
        named = named | asked.contains(mark)
        phrase = phrase | (asked.contains(mark) & low.contains(mark))
    return F.when(named, phrase).otherwise(F.size(F.filter(facts.keywords(question), lambda w: F.contains(low, w))) >= 2)


def date_near(text: Column, question: Column, radius: int = 140) -> Column:
    """The date near the question's first anchor in the text, else the first of the whole text; empty where there is none.

    Anchors are words of approval, then the question's keywords, in that order.
    """
    first = ("approved", "authorised", "authorized", "issue")
    anchors = F.concat(F.array(*map(F.lit, first)), F.filter(facts.keywords(question), lambda w: ~w.isin(*first)))
    places = T.let(F.lower(text), lambda low: F.filter(F.transform(anchors, lambda w: F.instr(low, w)), lambda p: p > 0))

    def near(at: Column) -> Column:
        start = F.greatest(F.lit(0), at - radius)
        return T.full_date(F.coalesce(F.substring(text, start + 1, at + radius - start), text))

    scoped = T.let(F.try_element_at(places, F.lit(1)) - 1, near)
    return T.let(scoped, lambda found: F.when(found != "", found).otherwise(T.full_date(text)))


def answers(questions: DataFrame, pages: DataFrame, hits: DataFrame, found: DataFrame, semantic: DataFrame, sections: DataFrame, cited: DataFrame) -> DataFrame:
    """(question_id, document_id, answer, status): the first rung of the ladder that holds; status is grounded or not_found.

    hits: of search.page_search, with the pages' texts. cited: whichever questions have a citation, any number of rows for each.

    Financial row; fact (of numerical questions); supported pages; date; refusal of an
    unsupported number; excerpt of a supported first page; other refusals; first semantic
    hit; first section. A question without citations finds nothing.
    """
    q = F.col("question")
    first = lambda rows, **cols: rows.filter("nth = 1").select(*_KEY, *[c.alias(n) for n, c in cols.items()])
    text = hits.join(questions.select(*_KEY, "question"), _KEY)
    supported = supports_question(F.col("page_text"), q)
    # dates are read by questions for one only
    dated = F.when(search.asks_for_date(q) & (~T.has_any(F.lower(q), ("approved", "authorised", "authorized", "issue")) | supported), T.let(date_near(F.col("page_text"), q), lambda d: F.when(d != "", d)))
    text = text.withColumns({"row": row_answer(q, F.col("page_text"), F.col("page_num")), "supported": supported, "dated": dated, "counts": supports_number(F.col("page_text"), q)})
    by = lambda name: F.min_by(name, F.when(F.col(name).isNotNull(), F.col("nth"))).alias(name)
    from_pages = text.groupBy(*_KEY).agg(
        by("row"),
        by("dated"),
        F.array_sort(F.collect_set(F.when(F.col("supported"), F.col("page_num")))).alias("page_nums"),
        F.min_by("supported", "nth").alias("first_supported"),
        F.min_by("counts", "nth").alias("first_counts"),
        F.min_by("excerpt", "nth").alias("excerpt"),
    )
    rows = questions.join(from_pages, _KEY, "left")
    rows = rows.join(first(found, metric=F.col("metric"), value=F.col("value"), unit=F.col("unit"), date=F.col("date"), fact_page=F.col("page_num")), _KEY, "left")
    rows = rows.join(first(semantic, chunk=F.substring("text", 1, 320)), _KEY, "left").join(first(sections, summary=F.substring("summary", 1, 320)), _KEY, "left")
    rows = rows.join(cited.select(*_KEY).distinct().withColumn("n_citations", F.lit(1)), _KEY, "left")
    numerical, date, page = search.is_numerical(q, facts.NUMERICAL), search.asks_for_date(q), search.asks_for_pages(q)
    listed = F.array_join(F.transform("page_nums", lambda p: p.cast("string")), ", ")
    no = lambda what: F.lit(f"No grounded {what} found in the extracted text for this question.")
    has_hits = F.col("excerpt").isNotNull()
    answer = F.coalesce(
        F.col("row"),
        F.when(numerical & F.col("value").isNotNull(), fact_sentence(q, F.col("metric"), F.col("value"), F.col("unit"), F.col("date"), F.col("fact_page"))),
        F.when(page & (F.size("page_nums") > 0), F.concat(F.when(F.size("page_nums") == 1, "The referenced notes appear on page ").otherwise("The referenced notes appear on pages "), listed, F.lit("."))),
        F.when(has_hits & date, F.coalesce(F.concat(F.lit("The financial statements were approved and authorised for issue on "), F.col("dated"), F.lit(".")), no("date"))),
        F.when(has_hits & numerical & ~F.col("first_counts"), no("numeric fact")),
        F.when(F.col("first_supported"), F.col("excerpt")),
        F.when(numerical, no("numeric fact")).when(date, no("date")).when(page, no("page references")),
        F.col("chunk"),
        F.col("summary"),
        F.lit("No grounded evidence found."),
    )
    answer = F.when(F.coalesce("n_citations", F.lit(0)) == 0, NOTHING).otherwise(answer)
    return rows.select(*_KEY, answer.alias("answer"), F.when(answer.startswith("No grounded"), "not_found").otherwise("grounded").alias("status"))


def audited(claims: DataFrame, cited: DataFrame, found: DataFrame) -> DataFrame:
    """(question_id, document_id, verdict) of claims: NOT_FOUND without citations, CONTRADICTED if facts of its topic disagree with its number, else VERIFIED.

    found: facts.by_topic of the claims' topics, up to ten each.
    """
    near = found.join(claims.select(*_KEY, T.first_number(F.col("question")).alias("claimed")), _KEY)
    judged = near.groupBy(*_KEY).agg(F.count("*").alias("n_facts"), F.coalesce(F.bool_or(facts.is_close(F.col("value"), F.col("claimed"))), F.lit(False)).alias("agrees"))
    counts = cited.groupBy(*_KEY).agg(F.count("*").alias("n"))
    rows = claims.join(counts, _KEY, "left").join(judged, _KEY, "left")
    against = T.first_number(F.col("question")).isNotNull() & (F.col("n_facts") > 0) & ~F.col("agrees")
    return rows.select(*_KEY, F.when(F.coalesce("n", F.lit(0)) == 0, "NOT_FOUND").when(F.coalesce(against, F.lit(False)), "CONTRADICTED").otherwise("VERIFIED").alias("verdict"))


def evidence(pages: DataFrame, ldus: DataFrame, questions: DataFrame) -> dict[str, DataFrame]:
    """What answers are made of, step by step: sections, chunks of the question's own document by hashed vectors, pages, facts, citations.

    pages (document_id, page_num, text), ldus (chunking) and questions (question_id,
    document_id, question); each is read several times: pass stored or kept tables.
    """
    hits = search.page_search(pages, questions)
    bodies = sections_of(ldus).withColumn("body", F.concat_ws(" ", "title", "summary")).withColumn("place", F.col("section_ord"))
    near = search.top_sections(bodies, questions, keep=("page_refs", "summary"))
    chunks = ldus.withColumnRenamed("ldu_id", "section_id").withColumn("place", F.col("position")).withColumn("body", F.col("text"))
    semantic = search.top_sections(chunks, questions, hashed=True, keep=("page_num", "content_hash")).join(ldus.select("document_id", F.col("ldu_id").alias("section_id"), "text"), ["document_id", "section_id"])
    found = facts.by_question(facts.extract(ldus), questions.filter(search.is_numerical(F.col("question"), facts.NUMERICAL)))
    return {"questions": questions, "pages": pages, "hits": hits, "found": found, "semantic": semantic, "sections": near, "cited": citations(hits, semantic, found, near)}


def with_citations(ldus: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, document_id) of the questions that evidence() finds a citation for, without finding it.

    They are those of documents with a chunk: the nearest chunk is cited whatever its
    score, and a page hit, a fact or a section there is only where there is a chunk.
    """
    return questions.select(*_KEY).join(ldus.select("document_id"), "document_id", "left_semi")


def ask(pages: DataFrame, ldus: DataFrame, questions: DataFrame) -> DataFrame:
    """The whole flow, navigate, search, look up, compose: (question_id, document_id, answer, status)."""
    return answers(**evidence(pages, ldus, questions) | {"cited": with_citations(ldus, questions)})
