"""Numeric facts of chunks, and their lookup by topic or question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Phrases that stand for a topic in questions, in order.
PHRASES = ("inflation", "general inflation", "food inflation", "net profit", "total assets", "revenue", "interest income")
#: Phrases that count three if both question and sentence have them.
STRONG = ("general inflation", "food inflation", "net profit", "total assets")
#: Question words that are no keywords.
STOP = ("what", "when", "were", "with", "that", "this", "from", "have", "been", "does")
TOPIC_STOP = ("what", "where", "when", "which", "with", "from", "that", "this", "have", "does", "show", "report", "states")
#: Spellings mended in questions.
TYPOS = (("assests", "assets"), ("assetts", "assets"), ("autorised", "authorised"), ("authroised", "authorised"))
#: Words by which a question is numerical.
NUMERICAL = ("revenue", "amount", "value", "rate", "percent", "inflation", "cpi", "q1", "q2", "q3", "q4")
MOST_TERMS = 6


def sentence_facts(sentence: Column, strict: bool = False) -> Column:
    """array of struct(nth, value, unit, metric, date) of the numbers of a sentence.

    The metric is up to four words before the number: those before the word in which it
    starts, counted over the sentence's words.
    """
    pattern = T.STRICT if strict else T.NUMERIC
    marked = F.regexp_replace(F.replace(sentence, F.lit("\u0001"), F.lit(" ")), pattern, "\u0001$0")
    # piece k (from 1) of the marked sentence begins with number k; what stands before it is the sentence's prefix
    values, units = F.regexp_extract_all(sentence, F.lit(pattern), F.lit(1)), F.regexp_extract_all(sentence, F.lit(pattern), F.lit(2))
    of = F.struct(F.split(marked, "\u0001").alias("pieces"), values.alias("numbers"), units.alias("units"), T.words(sentence).alias("words"), T.date_hint(sentence).alias("date"))

    def facts_of(s: Column) -> Column:
        def metric(before: Column) -> Column:
            first = F.greatest(F.lit(1), before - 3)
            return F.array_join(F.slice(s["words"], first, F.greatest(F.lit(0), before - first + 1)), " ")

        def fact(value: Column, k: Column) -> Column:
            before = F.size(T.words(F.array_join(F.slice(s["pieces"], F.lit(1), k + 1), "")))
            named = T.let(T.let(before, metric), lambda m: F.when(m == "", "numeric_fact").otherwise(F.substring(m, 1, 80)))
            return F.struct(k.alias("nth"), T.number(value).alias("value"), F.substring(F.element_at(s["units"], k + 1), 1, 20).alias("unit"), named.alias("metric"), s["date"].alias("date"))

        return F.transform(s["numbers"], fact)

    return T.let(of, facts_of)


def extract(ldus: DataFrame, strict: bool = False) -> DataFrame:
    """Facts of ldus (document_id, ldu_id, page_num, position, text): a row for each number.

    id orders facts by document, position, sentence and place in it, inside a document.
    """
    digits = ldus.filter(F.col("text").rlike("[0-9]"))  # most sentences have none: they never reach the pattern
    lines = digits.select("document_id", "ldu_id", "page_num", "position", F.posexplode(T.sentences(F.col("text"))).alias("sentence_ord", "sentence")).filter(F.col("sentence").rlike(r"\d"))
    rows = lines.select("*", F.explode(sentence_facts(F.col("sentence"), strict)).alias("f")).select("*", "f.*").drop("f")
    order = Window.partitionBy("document_id").orderBy("position", "sentence_ord", "nth")
    return rows.select(
        "document_id",
        F.row_number().over(order).alias("id"),
        "ldu_id",
        "page_num",
        F.lit(1).alias("line_number"),
        "metric",
        "value",
        "unit",
        "date",
        F.lit(0.75).alias("confidence"),
        F.substring("sentence", 1, 240).alias("description"),
        "sentence",
        F.sha2("sentence", 256).alias("content_hash"),
    )


def normal_question(question: Column) -> Column:
    low = F.lower(question)
    for wrong, right in TYPOS:
        low = F.replace(low, F.lit(wrong), F.lit(right))
    return low


def keywords(question: Column) -> Column:
    """Words of four letters or more that aren't stop words; repeats stay."""
    return F.filter(F.regexp_extract_all(normal_question(question), F.lit("([a-z]{4,})"), F.lit(1)), lambda w: ~w.isin(*STOP))


def terms(question: Column) -> Column:
    """Phrases, then keywords, each once, six at most."""
    low = normal_question(question)
    phrases = F.filter(F.array(*map(F.lit, PHRASES)), lambda p: F.contains(low, p))
    return F.slice(F.array_distinct(F.concat(phrases, keywords(question))), 1, MOST_TERMS)


def topic(text: Column) -> Column:
    """The first word of three letters or more that says something; else numeric."""
    some = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1)), lambda w: ~w.isin(*TOPIC_STOP))
    return F.coalesce(F.try_element_at(some, F.lit(1)), F.lit("numeric"))


def by_topic(facts: DataFrame, asked: DataFrame, limit: int = 5) -> DataFrame:
    """The newest facts of a document whose metric contains the topic of asked (question_id, document_id, topic)."""
    met = facts.join(asked, "document_id").filter(F.contains(F.lower("metric"), F.lower("topic")))
    newest = F.row_number().over(Window.partitionBy("question_id", "document_id").orderBy(F.desc("id")))
    return met.withColumn("nth", newest).filter(F.col("nth") <= limit)


def score(question: Column, found: Column) -> Column:
    """What a fact counts for a question; found: its terms."""
    return _scored(normal_question(question), F.lower("metric"), F.lower("sentence"), T.year(question), T.month(question), found)


def _scored(low: Column, metric: Column, sentence: Column, asked_year: Column, asked_month: Column, found: Column) -> Column:
    inflation = F.contains(low, F.lit("inflation"))
    out = F.aggregate(found, F.lit(0), lambda n, t: n + F.when(F.contains(metric, t), 2).otherwise(0) + F.when(F.contains(sentence, t), 1).otherwise(0))
    out = out + F.when((asked_year != "") & F.contains(F.col("date"), asked_year), 3).otherwise(0) + F.when((asked_month != "") & F.contains(sentence, asked_month), 2).otherwise(0)
    out = out + F.when(inflation, F.when(F.col("unit") == "%", 1).otherwise(-2) + F.when(F.col("value") > 100, -4).otherwise(0)).otherwise(0)
    for phrase in STRONG:
        out = out + F.when(F.contains(low, F.lit(phrase)) & F.contains(sentence, F.lit(phrase)), 3).otherwise(0)
    return out


def by_question(facts: DataFrame, questions: DataFrame, limit: int = 5) -> DataFrame:
    """Facts of the question's document that contain one of its terms, by score: one for each (page, hash, value).

    Of each term, the newest limit facts take part.
    """
    q = F.col("question")
    # what a question or a fact has of its own is worked out before they meet
    asked = questions.select("question_id", "document_id", "question", normal_question(q).alias("q_low"), T.year(q).alias("q_year"), T.month(q).alias("q_month"), terms(q).alias("q_terms"))
    asked = asked.select("*", F.posexplode("q_terms").alias("term_ord", "term"))
    low = facts.withColumns({"low_metric": F.lower("metric"), "low_sentence": F.lower("sentence")})
    met = low.join(asked, "document_id").filter(F.contains("low_metric", F.col("term")) | F.contains("low_sentence", F.col("term")))
    newest = Window.partitionBy("question_id", "document_id", "term_ord").orderBy(F.desc("id"))
    met = met.withColumn("newest", F.row_number().over(newest)).filter(F.col("newest") <= limit)
    rows = met.withColumn("score", _scored(*map(F.col, ("q_low", "low_metric", "low_sentence", "q_year", "q_month", "q_terms")))).filter("score > 0")
    once = Window.partitionBy("question_id", "document_id", "page_num", "content_hash", "value").orderBy(F.desc("score"), "term_ord", F.desc("id"))
    rows = rows.withColumn("copy", F.row_number().over(once)).filter("copy = 1")
    best = Window.partitionBy("question_id", "document_id").orderBy(F.desc("score"), "term_ord", F.desc("id"))
    return rows.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= limit).drop("copy", "newest", "q_low", "q_year", "q_month", "q_terms", "low_metric", "low_sentence")


def is_close(a: Column, b: Column, share: float = 0.03) -> Column:
    """Whether a lies within a share of b."""
    return F.when(b == 0, F.abs(a - b) < 1e-9).otherwise(F.abs(a - b) / F.abs(b) <= share)
