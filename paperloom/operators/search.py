"""Search: sections by term cosine, chunks by hashed vectors, pages by keywords.

Questions are a relation (question_id, document_id, question). Counts are whole numbers
and every score is one division, so results don't depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .facts import keywords, normal_question

DIM = 256


def bucket(token: Column, dim: int = DIM) -> Column:
    """A token's place in a hashed vector: the first 32 bits of its MD5, modulo dim."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim).cast("int")


def counted(rows: DataFrame, keys: list[str], text: Column, by: str = "term", hashed: bool = False) -> DataFrame:
    """(keys, by, n): how often each row's text has each token (or bucket of tokens)."""
    token = bucket(F.col(by)) if hashed else F.col(by)
    rows = rows.select(*keys, F.explode(T.tokens(text)).alias(by))
    return rows.groupBy(*keys, token.alias(by)).agg(F.count("*").alias("n"))


def hashed_vector(counts: DataFrame, key: str) -> DataFrame:
    """(key, vector): unit vectors of DIM floats, from counted(..., hashed=True)."""
    held = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return held.select(key, F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda k: (F.coalesce(F.try_element_at("m", k), F.lit(0)) / F.col("norm")).cast("float")).alias("vector"))


def _squares(terms: Column) -> Column:
    """The sum of the squared counts of an array's terms: the squared lengths of its runs, sorted."""

    def of_runs(held: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda k: F.coalesce(F.get(held, k - 1) != F.get(held, k), F.lit(True)))
        runs = lambda at: F.transform(at, lambda start, k: (F.coalesce(F.get(at, k + 1), F.size(held)) - start).cast("long"))
        return F.aggregate(T.let(starts, runs), F.lit(0).cast("long"), lambda n, run: n + run * run)

    return F.when(F.size(terms) > 0, T.let(F.sort_array(terms), of_runs)).otherwise(F.lit(0).cast("long"))


def _bucket_names(text: Column) -> Column:
    """Of each token, the two hexadecimal digits that name its bucket (bucket, DIM 256): the last of the MD5's first 32 bits."""
    return F.transform(T.tokens(text), lambda t: F.substring(F.md5(t), 7, 2))


def top_sections(sections: DataFrame, questions: DataFrame, k: int = 3, hashed: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The k sections of the question's document by cosine with the question; of equals the first in order. Zero scores are returned too.

    hashed: by hashed vectors, as chunks are searched, not by words. keep: further columns
    of sections, returned with each.

    sections: (document_id, section_id, place, body). A document's questions meet each of
    its sections as one array: a section's words are counted once, in its own row, and no
    word is a row of its own.
    """
    words = lambda text: F.coalesce((_bucket_names if hashed else T.tokens)(text), F.array().cast("array<string>"))
    each = questions.select("document_id", "question_id", words(F.col("question")).alias("terms"))
    each = each.select("document_id", F.struct("question_id", "terms", _squares(F.col("terms")).alias("b")).alias("q"))
    asked = each.groupBy("document_id").agg(F.collect_list("q").alias("asked")).withColumn("any", F.array_distinct(F.flatten(F.col("asked")["terms"])))
    mine = sections.select("document_id", "section_id", "place", *keep, words(F.col("body")).alias("terms"))
    mine = mine.select("document_id", "section_id", "place", *keep, "terms", _squares(F.col("terms")).alias("a"))
    met = mine.join(asked, "document_id")
    shared = T.let(F.array_intersect("terms", "any"), lambda some: F.when(F.size(some) > 0, F.filter("terms", lambda t: F.array_contains(some, t))))

    def cosine(terms: Column, q: Column) -> Column:
        dot = F.aggregate(terms, F.lit(0).cast("long"), lambda n, t: n + F.size(F.filter(q["terms"], lambda x: x == t)))
        return T.let(dot, lambda d: F.when(d > 0, d / F.sqrt((F.col("a") * q["b"]).cast("double"))).otherwise(0.0))

    scored = T.let(shared, lambda terms: F.transform("asked", lambda q: F.struct(q["question_id"].alias("question_id"), cosine(terms, q).alias("score"))))
    rows = met.select("document_id", "section_id", "place", *keep, F.explode(scored).alias("q")).select("document_id", "section_id", "place", *keep, "q.question_id", "q.score")
    best = Window.partitionBy("document_id", "question_id").orderBy(F.desc("score"), "place")
    return rows.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k).select("document_id", "question_id", "section_id", "nth", "score", *keep)


def _buckets(text: Column) -> Column:
    return F.transform(T.tokens(text), lambda t: bucket(t))


def _dense(held: pa.Array) -> np.ndarray:
    """Counts of buckets, a row for each list."""
    sizes = np.diff(held.offsets.to_numpy())
    counts = np.zeros((len(held), DIM))
    np.add.at(counts, (np.repeat(np.arange(len(held)), sizes), held.values.slice(held.offsets[0].as_py(), int(sizes.sum())).to_numpy()), 1)
    return counts


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows of each question, of equals the smallest ids."""
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(first, np.diff([*first, len(q)]))
    return q[nth < k], c[nth < k], s[nth < k]


def hashed_search(chunks: DataFrame, questions: DataFrame, k: int = 3, block: int = 4096) -> DataFrame:
    """The k chunks (chunk_id, text) of all by hashed cosine with each question (question_id, question); of equals the smallest chunk_id.

    Questions are a stated set, sent to the tasks in blocks of at most block; each block is
    one pass over the chunks in which a batch is one product of matrices, and a task sends
    on k chunks for each question: chunks are never shuffled. Chunks without a shared
    bucket or an id are not returned, nor are questions without an id or tokens.
    """
    asked = questions.select("question_id", _buckets(F.col("question")).alias("b")).filter("question_id IS NOT NULL AND size(b) > 0")
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), _buckets(F.col("text")).alias("b")).filter("chunk_id IS NOT NULL AND size(b) > 0")
    schema = pa.schema([("question_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])
    sent = asked.sparkSession.sparkContext.broadcast

    def searched(ids: np.ndarray, counts: np.ndarray) -> DataFrame:
        held = sent((ids, counts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = held.value
            b = (asked * asked).sum(axis=1)
            top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    mine, chunk = _dense(part.column(1)), part.column(0).to_numpy()
                    scores = mine @ asked.T / np.sqrt((mine * mine).sum(axis=1)[:, None] * b[None, :])
                    least = np.partition(scores, -k, axis=0)[-k] if len(scores) > k else np.zeros(len(ids))
                    c, q = np.nonzero((scores > 0) & (scores >= least))
                    top = _best(*(np.concatenate(x) for x in zip(top, (ids[q], chunk[c], scores[c, q]), strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in top], schema=schema)

        return rows.mapInArrow(run, "question_id long, chunk_id long, score double")

    found = chunks.sparkSession.createDataFrame([], "question_id long, chunk_id long, score double")
    waiting: list = []
    for row in [*asked.toLocalIterator(), None]:
        if row is not None:
            waiting.append(row)
        if waiting and (row is None or len(waiting) >= block):
            counts = np.zeros((len(waiting), DIM))
            for at, each in enumerate(waiting):
                np.add.at(counts[at], each.b, 1)
            found, waiting = found.union(searched(np.array([w.question_id for w in waiting], np.int64), counts)), []
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select("question_id", "chunk_id", "nth", "score")


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 3, block: int = 1024) -> DataFrame:
    """The k rows of vectors (vec_id, embedding) of the greatest dot product with each query (query_id, embedding).

    Queries are a stated set: blocks of them go to the tasks, each block is one pass in
    which a batch is one product of matrices, and a task sends on k rows for each query.
    Products count to nine decimals; of equals the smallest vec_id comes first. Vectors
    without an id, null, of another length than the query's or with a component that is
    null or not finite take no part, and neither do such queries.
    """
    doubles = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & ~F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")))
    rows = vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")
    asked = queries.filter(fine).select(F.col("query_id").cast("long").alias("query_id"), doubles.alias("v")).filter("query_id IS NOT NULL AND size(v) > 0")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def searched(held: list) -> DataFrame:
        wide = len(held[0].v)
        sent = vectors.sparkSession.sparkContext.broadcast((np.array([h.query_id for h in held], np.int64), np.array([h.v for h in held])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    scores = np.round(np.array(part.column(1).flatten()).reshape(part.num_rows, wide) @ q.T, 9)
                    least = np.partition(scores, -k, axis=0)[-k] if len(scores) > k else np.full(len(ids), -np.inf)
                    v, n = np.nonzero(scores >= least)
                    top = _best(*(np.concatenate(x) for x in zip(top, (ids[n], part.column(0).to_numpy()[v], scores[v, n]), strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in top], schema=schema)

        return rows.filter(F.size("v") == wide).select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double")

    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    waiting: list = []
    for row in [*asked.orderBy(F.size("v"), "query_id").toLocalIterator(), None]:
        if waiting and (row is None or len(waiting) >= block or len(row.v) != len(waiting[0].v)):
            found, waiting = found.union(searched(waiting)), []
        if row is not None:
            waiting.append(row)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select("query_id", "vec_id", "nth", "score")


def is_numerical(question: Column, marks: tuple[str, ...]) -> Column:
    return T.has_any(normal_question(question), marks)


def asks_for_date(question: Column) -> Column:
    """A question that names a date, or begins with when."""
    low = F.lower(question)
    return low.contains("date") | low.startswith("when ")


def asks_for_pages(question: Column) -> Column:
    return T.has_any(F.lower(question), ("which page", "what page"))


def page_score(low: Column, page: Column, asked: Column, dates: Column, dated: Column) -> Column:
    """Keywords of the question (asked) in the page's lower-case text, repeats counted, and what approvals, assets, revenue and dates add.

    low: of normal_question. dates: whether the question asks for a date. dated: whether the page has one.
    """
    out = F.size(F.filter(asked, lambda w: F.contains(page, w)))
    both = lambda mark, by, *there: F.when(F.contains(low, F.lit(mark)) & T.has_any(page, there or (mark,)), by).otherwise(0)
    out = out + both("approved", 3) + both("authorised", 3, "authorised", "authorized") + both("issue", 2) + both("total assets", 5) + both("revenue", 5, "revenue from contracts with customers")
    return out + F.when(dates & dated, 1).otherwise(0)


def page_search(pages: DataFrame, questions: DataFrame, limit: int = 3) -> DataFrame:
    """The pages of the question's document by page_score, over 0, with an excerpt and the page's text; of equals the first page.

    What a page or a question has of its own is worked out before they meet; pages meet
    questions for their scores, and only the best again for their texts.
    """
    q, low = F.col("question"), F.lower(F.coalesce("text", F.lit("")))
    asked = questions.select("question_id", "document_id", normal_question(q).alias("q_low"), keywords(q).alias("asked"), asks_for_date(q).alias("dates"))
    # of pages of one number, the place in their order tells which was found
    own = pages.select("document_id", "page_num", "text").withColumn("nth_page", F.row_number().over(Window.partitionBy("document_id").orderBy("page_num", "text")))
    met = own.select("document_id", "page_num", "nth_page", low.alias("low")).withColumn("dated", T.full_date(F.col("low")) != "").join(asked, "document_id")
    rows = met.withColumn("score", page_score(*map(F.col, ("q_low", "low", "asked", "dates", "dated")))).filter("score > 0").select("question_id", "document_id", "page_num", "nth_page", "score", "asked")
    best = Window.partitionBy("question_id", "document_id").orderBy(F.desc("score"), "page_num", "nth_page")
    rows = rows.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= limit)
    texts = own.select("document_id", "nth_page", F.col("text").alias("page_text"), F.sha2("text", 256).alias("content_hash"), T.collapsed(F.col("text")).alias("flat"))
    rows = rows.join(texts, ["document_id", "nth_page"])
    return rows.select("question_id", "document_id", "page_num", "nth", "score", "content_hash", T.excerpt(F.col("flat"), F.col("asked"), flat=True).alias("excerpt"), "page_text")


def precision_at_k(predicted: Column, relevant: Column, k: int = 3) -> Column:
    """Hits among the first k of predicted, over how many there are of those."""
    top = F.slice(predicted, 1, k)
    return F.when(F.size(top) > 0, F.size(F.array_intersect(top, relevant)) / F.size(top)).otherwise(0.0)
