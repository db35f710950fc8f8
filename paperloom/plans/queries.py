"""Queries over the driver's tables, one or more for each family of operators, and their SQL where SQL can say them.

Conversations are documents of several pages, a page for each turn; documents are
documents of one page. Questions are a relation: a stated set, ``QUESTIONS``, is asked of
every conversation, or of every document. The SQL is written from the described behaviour
with values of its own, not from the operators' constants.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, calibration, chunking, extraction, facts, records, reports, search, sections, triage
from ..sources import readers
from ..sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Asked of every document: for numbers, years, dates, pages and plain words, some of them in the invented prose.
QUESTIONS = (
    "What was the general inflation rate in 2024?",
    "What is the total value of payments on account?",
    "Which amount did the report state for revenue?",
    "How many days does the contract run from the date of issue?",
    "Which pages speak of tion, keit and ment?",
    "When was the tion approved?",
    "What rate of tion and ungen was there in March 2024?",
    "Tell of ment, thing and ungen",
)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WS = r"[ \t\n\x0B\f\r]+"


#: A text, or none.
_TEXT = "coalesce(text, '')"


def _strip(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}'), lambda w: w <> '')"


def _any(x: str, some: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{s}')" for s in some) + ")"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: length(w) > 2)"


_SIGNALS = rf"""
SELECT document_id, page_num, chars, (CASE WHEN chars < 50 THEN 0.8 ELSE 0.0 END)::DOUBLE AS image_area_ratio, chars > 100 AS is_searchable,
       (contains(t, '  ') AND length(regexp_replace(t, '[^0-9]', '', 'g')) > 30) OR contains(t, chr(9)) AS table_hit,
       {_any("lower(t)", ("watermark", "confidential"))} AS has_watermarks, {_any("lower(t)", ("signature", "signed"))} AS has_signatures, t
FROM (SELECT *, length({_strip("t")}) AS chars FROM (SELECT document_id, page_num, coalesce(text, '') AS t FROM pages_in))"""
_DOCS = "pages_in AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS page_num, text FROM documents)"
_CONVS = "pages_in AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn + 1 AS INTEGER) AS page_num, text FROM conversations)"
_METRICS = rf"""s AS ({_SIGNALS}),
g AS (
  SELECT document_id, count(*) AS total_pages, sum(chars)::BIGINT AS total_chars, avg(chars) AS avg_chars_per_page, avg(image_area_ratio) AS image_area_ratio,
         count(*) FILTER (table_hit) AS table_count, count(*) FILTER (is_searchable) >= greatest(1, count(*) // 2) AS is_searchable,
         count(*) FILTER (chars < 50 OR NOT is_searchable OR image_area_ratio > 0.65) AS first_scanned,
         first_scanned + CASE WHEN first_scanned / count(*) > 0.8 THEN count(*) FILTER (chars >= 50 AND chars < 200 AND is_searchable) ELSE 0 END AS scanned_pages, 1 AS column_count, sum(chars) > 0 AS has_fonts
  FROM s GROUP BY document_id),
m AS (
  SELECT *, scanned_pages / greatest(1, total_pages) AS ratio,
         CASE WHEN scanned_pages = 0 AND image_area_ratio < 0.35 AND has_fonts AND avg_chars_per_page > 300 THEN 'native_digital'
              WHEN scanned_pages = greatest(1, total_pages) OR (image_area_ratio > 0.7 AND avg_chars_per_page < 120 AND NOT has_fonts) THEN 'scanned_image' ELSE 'mixed' END AS origin_type,
         CASE WHEN table_count > 3 THEN 'table_heavy' WHEN image_area_ratio > 0.3 THEN 'figure_heavy' WHEN column_count > 2 THEN 'multi_column' ELSE 'single_column' END AS layout_complexity
  FROM g)"""


@query
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.page_signals(readers.document_pages(table(spark, sf_dir, "documents")))


ORACLE["page_signals"] = f"WITH {_DOCS} SELECT * EXCLUDE (t) FROM ({_SIGNALS})"


@query
def document_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin, layout and quality of conversations."""
    rows = triage.document_metrics(triage.page_signals(readers.conversation_pages(table(spark, sf_dir, "conversations"))))
    text, structure, overall = triage.quality_scores()
    return rows.select("document_id", "total_pages", "total_chars", F.round("avg_chars_per_page", 6).alias("avg_chars_per_page"), F.round("image_area_ratio", 6).alias("image_area_ratio"), "scanned_pages", triage.origin_type().alias("origin_type"), triage.layout_complexity().alias("layout_complexity"), F.round(text, 6).alias("text_quality"), F.round(structure, 6).alias("structure_quality"), F.round(overall, 6).alias("overall_quality"))


ORACLE["document_triage"] = f"""
WITH {_CONVS}, {_METRICS},
q AS (SELECT *, least(1.0, 0.5 + CASE WHEN is_searchable THEN 0.3 ELSE 0 END + CASE WHEN avg_chars_per_page BETWEEN 100 AND 3000 THEN 0.2 ELSE 0 END) AS tq,
             least(1.0, 0.5 + CASE WHEN image_area_ratio < 0.3 THEN 0.2 ELSE 0 END + CASE WHEN table_count BETWEEN 0 AND 5 THEN 0.2 ELSE 0 END + 0.1) AS sq FROM m)
SELECT document_id, total_pages, total_chars, round(avg_chars_per_page, 6) AS avg_chars_per_page, round(image_area_ratio, 6) AS image_area_ratio, scanned_pages, origin_type, layout_complexity,
       round(tq::DOUBLE, 6) AS text_quality, round(sq::DOUBLE, 6) AS structure_quality, round((0.6 * tq + 0.4 * sq)::DOUBLE, 6) AS overall_quality FROM q"""


@query
def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories, strategies and costs of conversations and documents by the rule engine."""
    pages = readers.conversation_pages(table(spark, sf_dir, "conversations")).select(F.concat(F.lit("c"), "document_id").alias("document_id"), "page_num", "text")
    pages = pages.unionByName(readers.document_pages(table(spark, sf_dir, "documents")).select("document_id", "page_num", "text"))
    rows = triage.document_metrics(triage.page_signals(pages)).withColumn("origin_type", triage.origin_type()).withColumn("layout_complexity", triage.layout_complexity())
    rows = triage.categorised(rows)
    return rows.select("document_id", "category", F.round("category_confidence", 6).alias("confidence"), "strategy", triage.extraction_cost(F.col("strategy")).alias("cost"))


ORACLE["category_rules"] = f"""
WITH pages_in AS (SELECT 'c' || CAST(conv_id AS VARCHAR) AS document_id, turn + 1 AS page_num, text FROM conversations UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, text FROM documents), {_METRICS},
r AS (
  SELECT *, ((avg_chars_per_page <= 1000)::INT + (image_area_ratio <= 0.1)::INT + (table_count <= 1)::INT + (column_count <= 2)::INT) / 4 AS a,
         ((avg_chars_per_page >= 1000)::INT + (avg_chars_per_page <= 2000)::INT + (image_area_ratio <= 0.3)::INT + (table_count <= 3)::INT + (column_count <= 3)::INT) / 5 AS b,
         ((avg_chars_per_page >= 2000)::INT + (image_area_ratio >= 0.3)::INT + (table_count >= 3)::INT + (column_count >= 3)::INT) / 4 AS c FROM m),
k AS (SELECT *, CASE WHEN a >= 0.8 THEN a ELSE -1 END AS a2, CASE WHEN b >= 0.7 THEN b ELSE -1 END AS b2, CASE WHEN c >= 0.6 THEN c ELSE -1 END AS c2 FROM r),
w AS (
  SELECT document_id,
         CASE WHEN origin_type = 'mixed' AND ratio >= 0.5 THEN ['high_complexity', ratio::VARCHAR, 'hybrid']
              WHEN origin_type = 'mixed' THEN ['moderate_complexity', greatest(0.7, 1 - ratio)::VARCHAR, 'layout']
              WHEN layout_complexity IN ('multi_column', 'table_heavy') AND origin_type <> 'scanned_image' THEN ['moderate_complexity', '0.8', 'layout']
              WHEN avg_chars_per_page < 100 THEN ['high_complexity', '1.0', 'vision']
              WHEN greatest(a2, b2, c2) < 0 THEN ['moderate_complexity', '0.5', 'layout']
              WHEN a2 = greatest(a2, b2, c2) THEN ['simple_text', a2::VARCHAR, 'fast_text']
              WHEN b2 = greatest(a2, b2, c2) THEN ['moderate_complexity', b2::VARCHAR, 'layout']
              ELSE ['high_complexity', c2::VARCHAR, 'vision'] END AS x FROM k)
SELECT document_id, x[1] AS category, round(x[2]::DOUBLE, 6) AS confidence, x[3] AS strategy,
       CASE x[3] WHEN 'fast_text' THEN 'fast_text' WHEN 'vision' THEN 'needs_vision_model' ELSE 'needs_layout_model' END AS cost FROM w"""


@query
def language_and_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = triage.first_pages(readers.document_pages(table(spark, sf_dir, "documents")))
    (lang, sure), (domain, most) = triage.language_guess(F.col("low")), triage.domain_guess(F.col("low"))
    return low.select("document_id", lang.alias("language"), sure.alias("language_confidence"), domain.alias("domain_hint"), F.round(most, 6).alias("domain_confidence"))


_HITS = ", ".join(f"{' + '.join(f'contains(low, {chr(39)}{w}{chr(39)})::INT' for w in some)} AS h{k}" for k, some in enumerate(triage.DOMAINS.values()))
ORACLE["language_and_domain"] = f"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, lower(coalesce(text, '')) AS low FROM documents),
h AS (SELECT *, {_HITS}, {" + ".join(f"contains(low, '{w}')::INT" for w in triage.ENGLISH)} AS en FROM d),
x AS (SELECT *, greatest({", ".join(f"h{k}" for k in range(len(triage.DOMAINS)))}) AS most FROM h)
SELECT document_id, CASE WHEN en >= 5 THEN 'en' ELSE 'unknown' END AS language, (CASE WHEN en >= 5 THEN 0.8 ELSE 0.5 END)::DOUBLE AS language_confidence,
       CASE WHEN most = 0 THEN 'general' {" ".join(f"WHEN h{k} = most THEN '{name}'" for k, name in enumerate(triage.DOMAINS))} END AS domain_hint,
       (CASE WHEN most = 0 THEN 0.5 ELSE round(least(most / 3, 1.0), 6) END)::DOUBLE AS domain_confidence FROM x"""


@query
def corpus_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("n_chars").alias("chars"), F.size(T.words(F.coalesce("text", F.lit("")))).alias("words"), T.n_digits(F.coalesce("text", F.lit(""))).alias("digits"))
    found = calibration.thresholds(docs, ["chars", "words", "digits"])
    return found.select("metric", *[F.round(c, 4).alias(c) for c in found.columns if c != "metric"])


ORACLE["corpus_thresholds"] = f"""
WITH d AS (SELECT n_chars AS chars, len({_words("coalesce(text, '')")}) AS words, length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) AS digits FROM documents),
l AS (SELECT 'chars' AS metric, chars::DOUBLE AS value FROM d UNION ALL SELECT 'words', words FROM d UNION ALL SELECT 'digits', digits FROM d)
SELECT metric, {", ".join(f"round(quantile_cont(value, {p / 100}), 4) AS p{p}" for p in calibration.PERCENTS)}, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM l WHERE value IS NOT NULL GROUP BY metric"""


@query
def char_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = readers.conversation_pages(table(spark, sf_dir, "conversations")).withColumn("chars", F.length(F.coalesce("text", F.lit(""))))
    return pages.groupBy("document_id").agg(F.round(calibration.char_variance("chars"), 6).alias("char_variance"))


ORACLE["char_variance"] = "SELECT CAST(conv_id AS VARCHAR) AS document_id, round(CASE WHEN count(*) < 2 OR avg(n) = 0 THEN 0 ELSE var_pop(n) / (avg(n) * avg(n)) END, 6) AS char_variance FROM (SELECT conv_id, length(coalesce(text, '')) AS n FROM conversations) GROUP BY conv_id"


@query
def column_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.column_estimate(table(spark, sf_dir, "events"), "user_id", "value")


ORACLE["column_estimate"] = """
WITH p AS (SELECT user_id, round_even(value / 20, 0) * 20 AS place, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM p)
SELECT user_id, CASE WHEN max(total) < 10 THEN 1 ELSE count(*) FILTER (n >= 0.05 * total) END::INTEGER AS column_count FROM t GROUP BY user_id"""


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as fast text, and by the layout reader."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_num"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.length(T.strip(F.col("text")))
    first = docs.select("document_id", "page_num", "text", extraction.fast_text_confidence(n, F.lit(0.0)).alias("confidence"), F.lit("fast_text").alias("strategy"))
    second = docs.select("document_id", "page_num", T.collapsed(F.col("text")).alias("text"), extraction.layout_confidence(n, F.lit(0)).alias("confidence"))
    return extraction.escalated(first, second)


@query
def route_and_escalate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select("document_id", "page_num", F.sha2("text", 256).alias("text_sha256"), F.round("confidence", 6).alias("confidence"), "strategy", "escalated", "escalated_from")


_FAST = "greatest(0.0, least(1.0, CASE WHEN n < 100 THEN 0.7 ELSE 1.0 END * (0.2 + 0.85 * least(1.0, n / 200))))"
_LAYOUT = "(CASE WHEN n > 100 THEN 0.65 ELSE 0.35 END)"
_ROUTED = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length({_strip("coalesce(text, '')")}) AS n FROM documents),
e AS (SELECT *, {_FAST} AS c FROM d),
x AS (SELECT doc_id, CASE WHEN c < 0.7 THEN {_strip(f"regexp_replace(t, '{_WS}', ' ', 'g')")} ELSE t END AS text,
             CASE WHEN c < 0.7 THEN {_LAYOUT} ELSE c END AS confidence, CASE WHEN c < 0.7 THEN 'layout' ELSE 'fast_text' END AS strategy, c < 0.7 AS escalated FROM e)"""
ORACLE["route_and_escalate"] = f"{_ROUTED} SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS page_num, sha256(text) AS text_sha256, round(confidence::DOUBLE, 6) AS confidence, strategy, escalated, CASE WHEN escalated THEN 'fast_text' END AS escalated_from FROM x"


@query
def strategy_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.distribution(_extracted(spark, sf_dir))


ORACLE["strategy_distribution"] = f"{_ROUTED} SELECT strategy, count(*) AS n_documents, count(*) FILTER (escalated) AS n_escalated FROM x GROUP BY strategy"


@query
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order written as a Markdown table, and read back."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))), lambda x: F.concat(F.lit("| "), x["l_linenumber"].cast("string"), F.lit(" | "), x["l_partkey"].cast("string"), F.lit(" | "), x["l_returnflag"], F.lit(" |")))
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("# Order\n\n| line | part | flag |\n|---|---|---|\n"), F.array_join(lines, "\n"), F.lit("\n\nend")).alias("page"))
    found = pages.select("l_orderkey", F.explode(extraction.markdown_tables(F.col("page"))).alias("t"))
    return found.select("l_orderkey", F.col("t.rows").alias("n_rows"), F.col("t.columns").alias("n_columns"), F.array_join("t.headers", ",").alias("headers"), F.array_join(F.transform("t.data", lambda r: r[1]), ",").alias("parts"))


ORACLE["markdown_tables"] = "SELECT l_orderkey, count(*) AS n_rows, 3 AS n_columns, 'line,part,flag' AS headers, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS parts FROM lineitem GROUP BY l_orderkey"


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are paragraphs."""
    return readers.document_pages(table(spark, sf_dir, "documents")).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


@query
def chunk_ldus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.ldus(_paragraphs(spark, sf_dir)).select("ldu_id", "document_id", "page_num", "position", "text_length", "content_hash")


@query
def buffer_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.buffer_ldus(_paragraphs(spark, sf_dir)).select("ldu_id", "document_id", "page_num", "position", "text_length", "content_hash")


ORACLE["buffer_chunks"] = f"""
WITH RECURSIVE p AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id, row_number() OVER () AS n, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') AS ps FROM documents),
r AS (
  SELECT document_id, n, ps, 0 AS i, CAST('' AS VARCHAR) AS held, CAST(NULL AS VARCHAR) AS done FROM p
  UNION ALL
  SELECT document_id, n, ps, i + 1, CASE WHEN length(cur) >= 120 THEN '' ELSE cur END, CASE WHEN length(cur) >= 120 OR i + 1 = len(ps) THEN cur END
  FROM (SELECT *, CASE WHEN held = '' THEN ps[i + 1] ELSE held || chr(10) || chr(10) || ps[i + 1] END AS cur FROM r WHERE i < len(ps))),
c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS position FROM r WHERE done IS NOT NULL)
SELECT document_id || '_ldu_' || CAST(position + 1 AS VARCHAR) AS ldu_id, document_id, 1 AS page_num, position, length(done) AS text_length, sha256(done) AS content_hash FROM c"""


@query
def chunk_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.issues(chunking.page_ldus(readers.conversation_pages(table(spark, sf_dir, "conversations"))))


_LDUS = f"""ldus AS (
  SELECT *, document_id || '_ldu_' || CAST(position + 1 AS VARCHAR) AS ldu_id FROM (
    SELECT document_id, page_num, {_strip("text")} AS text, row_number() OVER (PARTITION BY document_id ORDER BY page_num) - 1 AS position FROM pages_in WHERE {_strip("coalesce(text, '')")} <> ''))"""
ORACLE["chunk_issues"] = rf"""
WITH {_CONVS}, {_LDUS},
i AS (
  SELECT document_id, ldu_id, position, [CASE WHEN length(text) < 200 THEN 'too_short' END, CASE WHEN length(text) > 1400 THEN 'too_long' END, CASE WHEN regexp_matches(text, '^[,.;:)"]') THEN 'starts_inside' END,
         CASE WHEN regexp_matches(text, '[-/(\\]$') THEN 'ends_inside' END,
         CASE WHEN len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: {_strip("p")} <> '')) > 6 THEN 'too_many_paragraphs' END] AS found FROM ldus)
SELECT document_id, ldu_id, position, issue FROM (SELECT document_id, ldu_id, position, unnest(list_filter(found, lambda x: x IS NOT NULL)) AS issue FROM i)"""


@query
def section_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of conversations, with their pages and hashes."""
    rows = sections.sections(chunking.page_ldus(readers.conversation_pages(table(spark, sf_dir, "conversations"))))
    return rows.select("document_id", "section_id", "title", F.array_join(F.transform("page_refs", lambda p: p.cast("string")), ",").alias("page_refs"), F.size("ldu_ids").alias("n_ldus"), "content_hash")


_COLLAPSE = lambda x: _strip(f"regexp_replace({x}, '{_WS}', ' ', 'g')")
_ENTITIES = "{}"
for _entity, _plain in T.ENTITIES:
    _ENTITIES = f"replace({_ENTITIES}, '{_entity}', '{_plain.replace(chr(39), chr(39) * 2)}')"
_LINE = f"trim({_COLLAPSE('regexp_replace(' + _strip('regexp_replace(' + _strip(_ENTITIES.format('string_split(text, chr(10))[1]')) + ', ' + chr(39) + '^#+' + chr(39) + ', ' + chr(39) * 2 + ')') + ', ' + chr(39) + '^[-*]' + _WS + chr(39) + ', ' + chr(39) * 2 + ')')}, ' :-')"
_TITLES = rf"""titled AS (
  SELECT *, CASE WHEN line <> '' AND lower(line) NOT IN ('content', 'statistical bulletin')
                  AND (regexp_matches(line, '^[0-9]+([.:)-]|\s)') OR regexp_matches(lower(line), '^(chapter|section|appendix|glossary)([^\p{{L}}\p{{N}}_]|$)')
                       OR (len(w) BETWEEN 2 AND 14 AND ((regexp_matches(line, '[A-Za-z]') AND upper(line) = line)
                           OR (len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}'))) >= 0.7 * len(w) AND length(line) <= 110)))) THEN left(line, 120) END AS title
  FROM (SELECT *, {_words("line")} AS w FROM (SELECT *, {_LINE} AS line FROM ldus))),
placed AS (SELECT *, max(so) OVER (PARTITION BY document_id) = 0 AS untitled FROM (SELECT *, count(title) OVER (PARTITION BY document_id ORDER BY position) AS so FROM titled)),
sects AS (
  SELECT document_id, so AS section_ord, document_id || '_section_' || CAST(so AS VARCHAR) AS section_id, coalesce(max(title), 'Document Body') AS title,
         array_to_string(list_sort(list_distinct(list(page_num))), ',') AS page_refs, list_sort(list_distinct(list(page_num))) AS pages, count(*) AS n_ldus, string_agg(text, ' ' ORDER BY position) AS body,
         list(text ORDER BY position) AS texts
  FROM placed WHERE untitled OR so > 0 GROUP BY document_id, so)"""
ORACLE["section_index"] = f"WITH {_CONVS}, {_LDUS}, {_TITLES} SELECT document_id, section_id, title, page_refs, n_ldus, sha256(body) AS content_hash FROM sects"


@query
def section_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of each conversation in pre-order."""
    nodes = sections.flattened(sections.tree(chunking.page_ldus(readers.conversation_pages(table(spark, sf_dir, "conversations")))))
    return nodes.select("document_id", "place", "depth", "section_id", "parent_id", "title", F.size("ldu_ids").alias("n_ldus"))


def _normal(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({_strip(x)}), '^section\s+[0-9]+\s*[:.\-]?\s*', ''), '^[0-9]+\s*[:.\-]?\s*', ''), '[^a-z0-9]+', ' ', 'g'))"


_HUMAN = f"{_COLLAPSE('replace(replace(document_id, chr(95), chr(32)), chr(45), chr(32))')}"
ORACLE["section_tree"] = rf"""
WITH {_CONVS}, {_LDUS}, {_TITLES},
n AS (SELECT *, {_normal("title")} AS nt, {_normal(_HUMAN)} AS nd FROM sects),
p AS (SELECT *, section_ord <= 1 AND (nt = nd OR (nt <> '' AND contains(nd, nt)) OR regexp_matches(lower(title), 'report|statement|bulletin|review|plan')) AS promoted,
             CASE WHEN regexp_matches(lower(title), 'chairman|president|message') THEN 'Chairman''s Message' WHEN regexp_matches(lower(title), 'profit or loss|income statement|financial position|balance sheet|cash flow') THEN 'Financial Performance'
                  WHEN contains(lower(title), 'risk') THEN 'Risk Management' WHEN regexp_matches(lower(title), 'governance|board') THEN 'Corporate Governance' END AS parent FROM n),
r AS (SELECT *, CASE WHEN parent IS NULL THEN section_ord ELSE min(section_ord) OVER (PARTITION BY document_id, parent) END AS ord FROM p WHERE NOT promoted),
g AS (SELECT *, document_id || '_root_' || CAST(row_number() OVER (PARTITION BY document_id ORDER BY ord) AS VARCHAR) AS gid FROM (SELECT document_id, parent, ord, sum(n_ldus) AS n_ldus FROM r WHERE parent IS NOT NULL GROUP BY ALL)),
t AS (
  SELECT d.document_id, 0 AS ord, 0 AS section_ord, 0 AS depth, d.document_id || '_root' AS section_id, NULL AS parent_id,
         coalesce(p.title, CASE WHEN {_HUMAN.replace("document_id", "d.document_id")} = '' THEN 'Document' ELSE {_HUMAN.replace("document_id", "d.document_id")} END) AS title, d.n_ldus
  FROM (SELECT document_id, count(*) FILTER (untitled OR so = 0) AS n_ldus FROM placed GROUP BY document_id) d LEFT JOIN p ON p.document_id = d.document_id AND promoted
  UNION ALL SELECT document_id, ord, 0, 1, gid, document_id || '_root', parent, n_ldus FROM g
  UNION ALL SELECT document_id, ord, section_ord, 1, section_id, document_id || '_root', title, n_ldus FROM r WHERE parent IS NULL
  UNION ALL SELECT r.document_id, r.ord, section_ord, 2, section_id, gid, title, r.n_ldus FROM r JOIN g USING (document_id, parent) WHERE nt <> {_normal("parent")})
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY depth > 0, ord, depth, section_ord) - 1 AS place, depth, section_id, parent_id, title, n_ldus FROM t"""


@query
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = chunking.page_nodes(readers.document_pages(table(spark, sf_dir, "documents")))
    return nodes.select("document_id", "page_num", "content_type", "word_count", "line_count", F.round("text_density", 6).alias("text_density"), F.sha2("summary", 256).alias("summary_sha256"))


ORACLE["page_index"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS page_num, 'text_only' AS content_type, len({_words("t")}) AS word_count, length(t) - length(replace(t, chr(10), '')) + 1 AS line_count,
       round(least(1.0, len({_words("t")}) / 1000)::DOUBLE, 6) AS text_density, sha256(left(t, 200)) AS summary_sha256 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""


@query
def section_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.section_hash(chunking.page_ldus(readers.conversation_pages(table(spark, sf_dir, "conversations"))), ["document_id"])


ORACLE["section_hashes"] = f"WITH {_CONVS}, {_LDUS} SELECT document_id, sha256(string_agg(text, ' ' ORDER BY position)) AS content_hash, count(*) AS n_ldus FROM ldus GROUP BY document_id"


@query
def provenance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.provenance_chain(chunking.page_ldus(readers.conversation_pages(table(spark, sf_dir, "conversations"))))
    return rows.select("document_id", "chain_id", "n_ldus", "combined_hash", F.array_join(F.transform("page_refs", lambda p: p.cast("string")), ",").alias("page_refs"))


ORACLE["provenance_chain"] = f"WITH {_CONVS}, {_LDUS} SELECT document_id, document_id || '_provenance' AS chain_id, count(*) AS n_ldus, sha256(string_agg(sha256(text), '' ORDER BY position)) AS combined_hash, array_to_string(list_sort(list_distinct(list(page_num))), ',') AS page_refs FROM ldus GROUP BY document_id"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.extract(chunking.page_ldus(readers.document_pages(table(spark, sf_dir, "documents"))))


@query
def numeric_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("document_id", "id", "metric", "value", "unit", "date", "content_hash")


_NUMBER = r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?)((?:\s*(?i:%|USD|ETB|EUR|million|billion|thousand))?)"
_FACTS = rf"""
sent AS (SELECT document_id, page_num, sentence, nth FROM (
  SELECT document_id, page_num, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS nth FROM (
    SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_WS}', '\1' || chr(2), 'g'), chr(2)), lambda s: {_strip("s")}), lambda s: s <> '') AS ss FROM ldus)) WHERE regexp_matches(sentence, '[0-9]')),
num AS (
  SELECT *, generate_subscripts(vs, 1) AS k, unnest(vs) AS v, unnest(us) AS u FROM (
    SELECT *, regexp_extract_all(sentence, '(^|[^\p{{L}}\p{{N}}_]){_NUMBER}', 2) AS vs, regexp_extract_all(sentence, '(^|[^\p{{L}}\p{{N}}_]){_NUMBER}', 3) AS us,
           string_split(regexp_replace(sentence, '(^|[^\p{{L}}\p{{N}}_]){_NUMBER}', '\1' || chr(1) || '\2\3', 'g'), chr(1)) AS pieces, {_words("sentence")} AS ws FROM sent)),
pre AS (SELECT *, len({_words("array_to_string(pieces[1:k], '')")}) AS before FROM num),
fx AS (
  SELECT document_id, page_num, sentence, replace(v, ',', '')::DOUBLE AS value, left({_strip("u")}, 20) AS unit, CASE WHEN before = 0 THEN 'numeric_fact' ELSE left(array_to_string(ws[greatest(1, before - 3):before], ' '), 80) END AS metric,
         CASE WHEN regexp_extract(sentence, '(?i)\b(Q[1-4](?:\s+[0-9]{{4}})?)\b', 1) <> '' THEN regexp_extract(sentence, '(?i)\b(Q[1-4](?:\s+[0-9]{{4}})?)\b', 1) ELSE regexp_extract(sentence, '\b((?:19|20)[0-9]{{2}})\b', 1) END AS date,
         sha256(sentence) AS content_hash, row_number() OVER (PARTITION BY document_id ORDER BY page_num, nth, k) AS id FROM pre)"""
ORACLE["numeric_facts"] = f"WITH {_DOCS}, {_LDUS}, {_FACTS} SELECT document_id, id, metric, value, unit, date, content_hash FROM fx"


@query
def facts_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five facts of each document whose metric has a `th` (a topic that the invented prose has)."""
    found = _facts(spark, sf_dir)
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit("th").alias("topic"))
    return facts.by_topic(found, asked).select("document_id", "id", "metric", "value", "nth")


ORACLE["facts_by_topic"] = f"WITH {_DOCS}, {_LDUS}, {_FACTS} SELECT document_id, id, metric, value, nth FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY id DESC) AS nth FROM fx WHERE contains(lower(metric), 'th')) WHERE nth <= 5"


def _of_every(documents: DataFrame) -> DataFrame:
    """(question_id, document_id, question): QUESTIONS asked of each of documents (document_id)."""
    asked = F.array(*[F.struct(F.lit(k).cast("long").alias("question_id"), F.lit(q).alias("question")) for k, q in enumerate(QUESTIONS)])
    return documents.select("document_id", F.explode(asked).alias("q")).select("q.question_id", "document_id", "q.question")


@query
def facts_by_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _of_every(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id")))
    return facts.by_question(_facts(spark, sf_dir), asked).select("question_id", "document_id", "id", "value", "score", "nth")


_QUOTED = [q.replace("'", "''") for q in QUESTIONS]
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
_ASKING = rf"""
q_in(question_id, question) AS (VALUES {", ".join(f"({k}::BIGINT, '{q}')" for k, q in enumerate(_QUOTED))}),
q_low AS (SELECT *, lower(question) AS raw, replace(replace(replace(replace(lower(question), 'assests', 'assets'), 'assetts', 'assets'), 'autorised', 'authorised'), 'authroised', 'authorised') AS lq FROM q_in),
q_keys AS (
  SELECT *, list_filter(regexp_extract_all(lq, '[a-z]{{4,}}'), lambda w: w NOT IN ('what', 'when', 'were', 'with', 'that', 'this', 'from', 'have', 'been', 'does')) AS keys,
         regexp_extract(question, '\b((?:19|20)[0-9]{{2}})\b', 1) AS yr, lower(regexp_extract(question, '(?i)\b({_MONTH})\b', 1)) AS mo,
         regexp_matches(raw, 'revenue|amount|value|rate|percent|inflation|cpi|q1|q2|q3|q4') AS numerical, contains(raw, 'date') OR starts_with(raw, 'when ') AS dates, contains(raw, 'which page') OR contains(raw, 'what page') AS for_pages
  FROM q_low),
q_all AS (SELECT *, list_filter(['inflation', 'general inflation', 'food inflation', 'net profit', 'total assets', 'revenue', 'interest income'], lambda p: contains(lq, p)) || keys AS every FROM q_keys),
qs AS (SELECT *, list_filter(every, lambda v, i: list_position(every, v) = i)[1:6] AS terms FROM q_all)"""
_BY_QUESTION = """
met AS (SELECT f.*, lower(metric) AS lm, lower(sentence) AS ls, q.question_id, lq, yr, mo, terms, unnest(terms) AS term, generate_subscripts(terms, 1) AS term_ord FROM fx f, qs q WHERE numerical OR {every}),
late AS (SELECT *, row_number() OVER (PARTITION BY question_id, document_id, term_ord ORDER BY id DESC) AS late FROM met WHERE contains(lm, term) OR contains(ls, term)),
scored AS (
  SELECT *, (2 * len(list_filter(terms, lambda t: contains(lm, t))) + len(list_filter(terms, lambda t: contains(ls, t))) + CASE WHEN yr <> '' AND contains(date, yr) THEN 3 ELSE 0 END + CASE WHEN mo <> '' AND contains(ls, mo) THEN 2 ELSE 0 END
         + CASE WHEN contains(lq, 'inflation') THEN CASE WHEN unit = '%' THEN 1 ELSE -2 END + CASE WHEN value > 100 THEN -4 ELSE 0 END ELSE 0 END
         + 3 * len(list_filter(['general inflation', 'food inflation', 'net profit', 'total assets'], lambda p: contains(lq, p) AND contains(ls, p))))::INTEGER AS score FROM late WHERE late <= 5),
once AS (SELECT *, row_number() OVER (PARTITION BY question_id, document_id, page_num, content_hash, value ORDER BY score DESC, term_ord, id DESC) AS copy FROM scored WHERE score > 0),
fbq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, document_id ORDER BY score DESC, term_ord, id DESC) AS nth FROM once WHERE copy = 1) WHERE nth <= 5)"""
ORACLE["facts_by_question"] = f"WITH {_DOCS}, {_LDUS}, {_FACTS}, {_ASKING}, {_BY_QUESTION.format(every=True)} SELECT question_id, document_id, id, value, score, nth FROM fbq"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, document_id, question): QUESTIONS asked of every conversation."""
    return _of_every(table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id")).distinct())


_ASKED = f"{_ASKING}, asked AS (SELECT * FROM (SELECT DISTINCT document_id FROM pages_in) d, qs)"


def _section_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    ldus = chunking.page_ldus(readers.conversation_pages(table(spark, sf_dir, "conversations")))
    return sections.sections(ldus).withColumn("body", F.concat_ws(" ", "title", "summary")).withColumn("place", F.col("section_ord"))


@query
def top_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.top_sections(_section_bodies(spark, sf_dir), _asked(spark, sf_dir))
    return found.select("document_id", "question_id", "section_id", "nth", F.round("score", 9).alias("score"))


_TOP = rf"""
bodies AS (SELECT *, title || ' ' || left({_COLLAPSE("array_to_string(texts[1:4], chr(10) || chr(10))")}, 220) AS sbody FROM sects),
st AS (SELECT document_id, section_id, term, count(*) AS n FROM (SELECT document_id, section_id, unnest({_tokens("sbody")}) AS term FROM bodies) GROUP BY ALL),
qt AS (SELECT document_id, question_id, term, count(*) AS q FROM (SELECT document_id, question_id, unnest({_tokens("question")}) AS term FROM asked) GROUP BY ALL),
dots AS (SELECT document_id, section_id, question_id, sum(n * q)::BIGINT AS dot FROM st JOIN qt USING (document_id, term) GROUP BY ALL),
sn AS (SELECT document_id, section_id, sum(n * n)::BIGINT AS a FROM st GROUP BY ALL), qn AS (SELECT document_id, question_id, sum(q * q)::BIGINT AS b FROM qt GROUP BY ALL),
tops AS (SELECT *, row_number() OVER (PARTITION BY document_id, question_id ORDER BY score DESC, section_ord) AS nth FROM (
  SELECT document_id, question_id, section_id, section_ord, coalesce(dot / sqrt((a * b)::DOUBLE), 0.0) AS score FROM bodies JOIN asked USING (document_id) LEFT JOIN dots USING (document_id, section_id, question_id) LEFT JOIN sn USING (document_id, section_id) LEFT JOIN qn USING (document_id, question_id)))"""
ORACLE["top_sections"] = f"WITH {_CONVS}, {_LDUS}, {_TITLES}, {_ASKED}, {_TOP} SELECT document_id, question_id, section_id, nth, round(score, 9) AS score FROM tops WHERE nth <= 3"


@query
def page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strategy of each turn in the hybrid mode."""
    signals = triage.page_signals(readers.conversation_pages(table(spark, sf_dir, "conversations")))
    pages = readers.conversation_pages(table(spark, sf_dir, "conversations")).select("document_id", "page_num", "text")
    plan = extraction.page_plan(F.coalesce("text", F.lit("")), F.col("image_area_ratio"), F.lit(1), F.col("table_hit"))
    return pages.join(signals.select("document_id", "page_num", "image_area_ratio", "table_hit"), ["document_id", "page_num"]).select("document_id", "page_num", plan.alias("strategy"))


ORACLE["page_plan"] = f"WITH {_CONVS}, s AS ({_SIGNALS}) SELECT document_id, page_num, CASE WHEN chars < 80 OR image_area_ratio > 0.7 THEN 'vision' WHEN table_hit OR image_area_ratio > 0.3 THEN 'layout' ELSE 'fast_text' END AS strategy FROM s"


@query
def page_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = readers.document_pages(table(spark, sf_dir, "documents")).withColumn("confidence", F.lit(0.99))
    return reports.page_table(pages)


ORACLE["page_previews"] = f"SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS page_num, 'p. 1' AS label, 0.99::DOUBLE AS confidence, left(flat, 140) AS preview, contains(lower(flat), 'mock') AS mock FROM (SELECT doc_id, {_COLLAPSE(_TEXT)} AS flat FROM documents)"


@query
def retrieval_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, bodies = _asked(spark, sf_dir), _section_bodies(spark, sf_dir)
    found = reports.first_match_precision(search.top_sections(bodies, asked), bodies, asked)
    return found.select("question_id", "document_id", F.round("precision", 6).alias("precision"))


ORACLE["retrieval_precision"] = f"""
WITH {_CONVS}, {_LDUS}, {_TITLES}, {_ASKED}, {_TOP}
SELECT question_id, document_id, round(avg((len(list_filter({_tokens("question")}, lambda t: contains(lower(sbody), t))) > 0)::INT), 6) AS precision
FROM tops JOIN bodies USING (document_id, section_id) JOIN asked USING (document_id, question_id) WHERE nth <= 3 GROUP BY ALL"""


@query
def hashed_semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents nearest to each benchmark item by hashed vectors."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    found = search.hashed_search(docs, asked)
    return found.select("question_id", "chunk_id", "nth", F.round("score", 9).alias("score"))


_BUCKET = "CAST('0x' || substring(md5(term), 1, 8) AS BIGINT) % 256"
ORACLE["hashed_semantic_search"] = f"""
WITH c AS (SELECT chunk_id, {_BUCKET} AS term, count(*) AS n FROM (SELECT doc_id AS chunk_id, unnest({_tokens("text")}) AS term FROM documents) GROUP BY ALL),
q AS (SELECT question_id, {_BUCKET} AS term, count(*) AS q FROM (SELECT item_id AS question_id, unnest({_tokens("text")}) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT chunk_id, question_id, sum(n * q)::BIGINT AS dot FROM c JOIN q USING (term) GROUP BY ALL),
s AS (SELECT question_id, chunk_id, dot / sqrt((a * b)::DOUBLE) AS score FROM d JOIN (SELECT chunk_id, sum(n * n)::BIGINT AS a FROM c GROUP BY ALL) USING (chunk_id) JOIN (SELECT question_id, sum(q * q)::BIGINT AS b FROM q GROUP BY ALL) USING (question_id))
SELECT question_id, chunk_id, nth, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS nth FROM s) WHERE nth <= 3"""


@query
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three embeddings nearest to each one whose id is divisible by 50, of all."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.vector_topk(vectors, queries).select("query_id", "vec_id", "nth", F.round("score", 5).alias("score"))


ORACLE["vector_topk"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e), 9) AS score FROM v JOIN v q ON q.vec_id % 50 = 0)
SELECT query_id, vec_id, nth, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM s) WHERE nth <= 3"""


@query
def page_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.page_search(readers.conversation_pages(table(spark, sf_dir, "conversations")).select("document_id", "page_num", "text"), _asked(spark, sf_dir))
    return found.select("question_id", "document_id", "page_num", "nth", "score", F.sha2("excerpt", 256).alias("excerpt_sha256"))


_DATES = [rf"(?i)\b[0-9]{{1,2}}\s+(?:{names})\s+[0-9]{{4}}\b" for names in ("January|February|March|April|May|June|July|August|September|October|November|December", "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec")]


def _date(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{_DATES[0]}') THEN regexp_extract({x}, '{_DATES[0]}') ELSE regexp_extract({x}, '{_DATES[1]}') END"


_PAGES = rf"""
p_met AS (SELECT p.document_id, page_num, coalesce(text, '') AS text, lower(coalesce(text, '')) AS lp, a.* EXCLUDE (document_id) FROM pages_in p JOIN asked a ON p.document_id = a.document_id),
p_hits AS (SELECT *, row_number() OVER (PARTITION BY question_id, document_id ORDER BY score DESC, page_num) AS nth FROM (
  SELECT *, len(list_filter(keys, lambda w: contains(lp, w))) + CASE WHEN contains(lq, 'approved') AND contains(lp, 'approved') THEN 3 ELSE 0 END
         + CASE WHEN contains(lq, 'authorised') AND (contains(lp, 'authorised') OR contains(lp, 'authorized')) THEN 3 ELSE 0 END + CASE WHEN contains(lq, 'issue') AND contains(lp, 'issue') THEN 2 ELSE 0 END
         + CASE WHEN contains(lq, 'total assets') AND contains(lp, 'total assets') THEN 5 ELSE 0 END + CASE WHEN contains(lq, 'revenue') AND contains(lp, 'revenue from contracts with customers') THEN 5 ELSE 0 END
         + CASE WHEN dates AND {_date("text")} <> '' THEN 1 ELSE 0 END AS score FROM p_met) WHERE score > 0),
p_shown AS (SELECT *, {_COLLAPSE("text")} AS flat FROM p_hits WHERE nth <= 3),
exc AS (SELECT *, substring(flat, greatest(1, coalesce(list_min(list_filter(list_transform(keys, lambda w: instr(lower(flat), w)), lambda x: x > 0)), 1) - 60), 320) AS excerpt FROM p_shown)"""
ORACLE["page_search"] = f"WITH {_CONVS}, {_ASKED}, {_PAGES} SELECT question_id, document_id, page_num, nth, score, sha256(excerpt) AS excerpt_sha256 FROM exc"


def _evidence(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What answers are made of, for QUESTIONS asked of conversations."""
    pages = readers.conversation_pages(table(spark, sf_dir, "conversations")).select("document_id", "page_num", "text")
    # read by each kind of evidence; the test, which the optimiser drops, keeps Spark from answering a later call with it
    ldus = chunking.page_ldus(pages).filter(F.lit(uuid.uuid4().hex) != F.lit("")).persist(StorageLevel.DISK_ONLY)
    return answers.evidence(pages, ldus, _asked(spark, sf_dir))


@query
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _evidence(spark, sf_dir)
    return answers.verified(x["cited"], x["questions"], x["pages"]).select("question_id", "document_id", "nth", "source", "page_num", "content_hash", "status")


_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: length(w) > 3))"
_CITED = rf"""
lt AS (SELECT document_id, ldu_id, {_BUCKET} AS term, count(*) AS n FROM (SELECT document_id, ldu_id, unnest({_tokens("text")}) AS term FROM ldus) GROUP BY ALL),
lq2 AS (SELECT document_id, question_id, {_BUCKET} AS term, count(*) AS q FROM (SELECT document_id, question_id, unnest({_tokens("question")}) AS term FROM asked) GROUP BY ALL),
ld AS (SELECT document_id, ldu_id, question_id, sum(n * q)::BIGINT AS dot FROM lt JOIN lq2 USING (document_id, term) GROUP BY ALL),
la AS (SELECT document_id, ldu_id, sum(n * n)::BIGINT AS a FROM lt GROUP BY ALL), lb AS (SELECT document_id, question_id, sum(q * q)::BIGINT AS b FROM lq2 GROUP BY ALL),
sem AS (SELECT *, row_number() OVER (PARTITION BY document_id, question_id ORDER BY score DESC, position) AS nth FROM (
  SELECT l.document_id, question_id, l.ldu_id, page_num, position, l.text, coalesce(dot / sqrt((a * b)::DOUBLE), 0.0) AS score FROM ldus l JOIN asked USING (document_id) LEFT JOIN ld USING (document_id, ldu_id, question_id) LEFT JOIN la USING (document_id, ldu_id) LEFT JOIN lb USING (document_id, question_id))),
near AS (SELECT t.question_id, t.document_id, t.nth, t.section_id, s.pages, left({_COLLAPSE("array_to_string(s.texts[1:4], chr(10) || chr(10))")}, 220) AS summary FROM tops t JOIN sects s USING (document_id, section_id) WHERE t.nth <= 3),
cites AS (
  SELECT question_id, document_id, 0 AS rk, nth AS ord, 'page' AS source, page_num, sha256(text) AS content_hash, left(excerpt, 260) AS excerpt FROM exc
  UNION ALL SELECT question_id, document_id, 1, nth, 'semantic', page_num, sha256(text), left(text, 260) FROM sem WHERE nth <= 3
  UNION ALL SELECT question_id, document_id, 2, nth, 'fact', page_num, content_hash, left(sentence, 260) FROM fbq
  UNION ALL SELECT question_id, document_id, 3, nth * 2 + i, 'section', pages[i], sha256(section_id || '|' || CAST(pages[i] AS VARCHAR)), summary FROM near, (VALUES (1), (2)) AS v(i) WHERE i <= len(pages)),
cited AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, document_id ORDER BY rk, ord, page_num) AS nth FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id, document_id, page_num, content_hash ORDER BY rk, ord) AS copy FROM cites) WHERE copy = 1) WHERE nth <= 10)"""
_ALL = f"WITH {_CONVS}, {_LDUS}, {_TITLES}, {_FACTS}, {_ASKED}, {_TOP}, {_PAGES}, {_BY_QUESTION.format(every=False)}, {_CITED}"
ORACLE["citations"] = f"""{_ALL},
o AS (SELECT c.*, {_TERMS.format("q.question")} AS mine, {_TERMS.format(f"CASE WHEN {_strip('coalesce(p.text, chr(32))')} <> '' THEN p.text ELSE c.excerpt END")} AS theirs
      FROM cited c JOIN q_in q USING (question_id) LEFT JOIN pages_in p ON p.document_id = c.document_id AND p.page_num = c.page_num)
SELECT question_id, document_id, nth, source, page_num, content_hash,
       CASE WHEN len(list_intersect(mine, theirs)) >= greatest(1, least(4, len(mine) // 4)) THEN 'supports_claim' ELSE 'weak_support' END AS status FROM o"""


@query
def answers_with_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _evidence(spark, sf_dir)
    return answers.answers(**x | {"cited": answers.with_citations(chunking.page_ldus(x["pages"]), x["questions"])})


_SUPPORTED = "(NOT contains(raw, 'approved') OR contains(lp, 'approved')) AND (NOT contains(raw, 'authorised') OR contains(lp, 'authorised') OR contains(lp, 'authorized')) AND (NOT contains(raw, 'issue') OR contains(lp, 'issue'))"
_CELL = "(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)"
_ANCHORS = "['approved', 'authorised', 'authorized', 'issue'] || list_filter(keys, lambda w: w NOT IN ('approved', 'authorised', 'authorized', 'issue'))"
_IN_HITS = rf"""
h1 AS (
  SELECT *, {_SUPPORTED} AS supported, lower(flat) AS lf, CASE WHEN contains(lq, 'assets') AND contains(lq, 'total') THEN 'total assets' WHEN contains(lq, 'net profit') THEN 'net profit' WHEN contains(lq, 'revenue') THEN 'revenue from contracts with customers' END AS target,
         {_date("lq")} AS dated, list_filter(list_transform({_ANCHORS}, lambda w: instr(lp, w)), lambda x: x > 0)[1] - 1 AS anchor,
         list_filter(regexp_extract_all(flat, '\b20[0-9][0-9]\s+{_CELL}\s+{_CELL}\s+{_CELL}\b'), lambda r: left(r, 4) = yr)[1] AS cells, len(list_filter(keys, lambda w: contains(lp, w))) AS n_keys,
         list_filter(['cash in hand', 'total assets', 'net profit', 'general inflation', 'food inflation', 'revenue', 'interest income'], lambda p: contains(lq, p)) AS named FROM exc),
h2 AS (
  SELECT *, CASE WHEN anchor IS NULL THEN text ELSE substring(text, greatest(0, anchor - 140) + 1, anchor + 140 - greatest(0, anchor - 140)) END AS near_text,
         CASE WHEN len(named) > 0 THEN len(list_filter(named, lambda p: contains(lp, p))) > 0 ELSE n_keys >= 2 END AS counts,
         CASE target WHEN 'net profit' THEN regexp_split_to_array(cells, '\s+')[4] WHEN 'revenue from contracts with customers' THEN regexp_split_to_array(cells, '\s+')[2] END AS cell,
         CASE target WHEN 'total assets' THEN regexp_extract(flat, '(?i)total assets.*?([0-9]{{1,3}}(?:,[0-9]{{3}})+)', 1) WHEN 'net profit' THEN regexp_extract(flat, '(?i)net profit.*?([0-9]{{1,3}}(?:,[0-9]{{3}})+)', 1)
                     ELSE regexp_extract(flat, '(?i)revenue from contracts with customers.*?([0-9]{{1,3}}(?:,[0-9]{{3}})+)', 1) END AS amount FROM h1),
h3 AS (
  SELECT *, CASE WHEN yr <> '' AND contains(lf, 'year revenue') AND contains(lf, target) AND cell IS NOT NULL THEN 'The document reports ' || target || ' of ' || cell || ' in ' || yr || ' on page ' || page_num || '.'
                 WHEN target IS NOT NULL AND amount <> '' AND (dated = '' OR contains(lf, dated) OR contains(lf, '30 june 2022') OR NOT contains(dated, '2022'))
                 THEN 'The document reports ' || CASE WHEN target LIKE 'revenue%' THEN 'revenue' ELSE target END || ' of ' || amount || CASE WHEN dated <> '' THEN ' as of ' || dated ELSE '' END || ' on page ' || page_num || '.' END AS row_answer,
         CASE WHEN NOT regexp_matches(raw, 'approved|authorised|authorized|issue') OR supported THEN CASE WHEN {_date("near_text")} <> '' THEN {_date("near_text")} ELSE {_date("text")} END ELSE '' END AS found_date FROM h2),
h AS (
  SELECT question_id, document_id, min_by(row_answer, nth) FILTER (row_answer IS NOT NULL) AS row_answer, min_by(found_date, nth) FILTER (found_date <> '') AS found_date,
         list_sort(list_distinct(list(page_num) FILTER (supported))) AS page_nums, min_by(supported, nth) AS first_supported, min_by(counts, nth) AS first_counts, min_by(excerpt, nth) AS excerpt FROM h3 GROUP BY ALL)"""
ORACLE["answers_with_provenance"] = f"""{_ALL}, {_IN_HITS},
a AS (
  SELECT a.question_id, a.document_id, CASE
    WHEN (SELECT count(*) FROM cited c WHERE c.question_id = a.question_id AND c.document_id = a.document_id) = 0 THEN 'No grounded evidence found in the indexed document content.'
    WHEN row_answer IS NOT NULL THEN row_answer
    WHEN numerical AND f.value IS NOT NULL THEN 'The document reports ' || CASE WHEN contains(a.lq, 'general inflation') THEN 'general inflation' WHEN contains(a.lq, 'food inflation') THEN 'food inflation' WHEN contains(a.lq, 'inflation') THEN 'inflation'
         WHEN contains(a.lq, 'net profit') THEN 'net profit' WHEN contains(a.lq, 'total assets') THEN 'total assets' WHEN contains(a.lq, 'revenue') THEN 'revenue' ELSE {_strip("f.metric")} END || ' of ' || CAST(f.value AS VARCHAR) || f.unit
         || CASE WHEN f.date <> '' THEN ' for ' || f.date WHEN a.yr <> '' THEN ' for ' || a.yr ELSE '' END || ' on page ' || f.page_num || '.'
    WHEN for_pages AND len(page_nums) = 1 THEN 'The referenced notes appear on page ' || page_nums[1] || '.'
    WHEN for_pages AND len(page_nums) > 1 THEN 'The referenced notes appear on pages ' || array_to_string(page_nums, ', ') || '.'
    WHEN h.excerpt IS NOT NULL AND dates AND found_date IS NOT NULL THEN 'The financial statements were approved and authorised for issue on ' || found_date || '.'
    WHEN h.excerpt IS NOT NULL AND dates THEN 'No grounded date found in the extracted text for this question.'
    WHEN h.excerpt IS NOT NULL AND numerical AND NOT first_counts THEN 'No grounded numeric fact found in the extracted text for this question.'
    WHEN first_supported THEN h.excerpt
    WHEN numerical THEN 'No grounded numeric fact found in the extracted text for this question.'
    WHEN dates THEN 'No grounded date found in the extracted text for this question.'
    WHEN for_pages THEN 'No grounded page references found in the extracted text for this question.'
    WHEN s.text IS NOT NULL THEN left(s.text, 320) WHEN n.summary IS NOT NULL THEN left(n.summary, 320) ELSE 'No grounded evidence found.' END AS answer
  FROM asked a LEFT JOIN h USING (question_id, document_id) LEFT JOIN fbq f ON f.question_id = a.question_id AND f.document_id = a.document_id AND f.nth = 1
  LEFT JOIN sem s ON s.question_id = a.question_id AND s.document_id = a.document_id AND s.nth = 1 LEFT JOIN near n ON n.question_id = a.question_id AND n.document_id = a.document_id AND n.nth = 1)
SELECT question_id, document_id, answer, CASE WHEN starts_with(answer, 'No grounded') THEN 'not_found' ELSE 'grounded' END AS status FROM a"""


@query
def audit_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    ldus = chunking.page_ldus(readers.conversation_pages(table(spark, sf_dir, "conversations")).select("document_id", "page_num", "text"))
    asked = _asked(spark, sf_dir)
    topics = asked.select("question_id", "document_id", facts.topic(F.col("question")).alias("topic"))
    return answers.audited(asked, answers.with_citations(ldus, asked), facts.by_topic(facts.extract(ldus), topics, 10))


ORACLE["audit_claims"] = rf"""{_ALL},
topics AS (
  SELECT question_id, document_id, coalesce(list_filter(regexp_extract_all(raw, '[a-z]{{3,}}'), lambda w: w NOT IN ('what', 'where', 'when', 'which', 'with', 'from', 'that', 'this', 'have', 'does', 'show', 'report', 'states'))[1], 'numeric') AS topic,
         CAST(nullif(replace(regexp_extract(question, '(?:^|[^\p{{L}}\p{{N}}_])([0-9]{{1,3}}(?:,[0-9]{{3}})*(?:\.[0-9]+)?)', 1), ',', ''), '') AS DOUBLE) AS claimed FROM asked),
of_topic AS (SELECT t.question_id, t.document_id, claimed, value FROM (
  SELECT t.question_id, t.document_id, claimed, value, row_number() OVER (PARTITION BY t.question_id, t.document_id ORDER BY id DESC) AS nth FROM topics t JOIN fx f ON f.document_id = t.document_id AND contains(lower(metric), topic)) t WHERE nth <= 10),
judged AS (SELECT question_id, document_id, bool_or(CASE WHEN value = 0 THEN abs(claimed - value) < 1e-9 ELSE abs(claimed - value) / abs(value) <= 0.03 END) AS agrees FROM of_topic WHERE claimed IS NOT NULL GROUP BY ALL)
SELECT a.question_id, a.document_id, CASE WHEN (SELECT count(*) FROM cited c WHERE c.question_id = a.question_id AND c.document_id = a.document_id) = 0 THEN 'NOT_FOUND' WHEN agrees = false THEN 'CONTRADICTED' ELSE 'VERIFIED' END AS verdict
FROM asked a LEFT JOIN judged USING (question_id, document_id)"""


@query
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source, the three longest labelled documents against those of quality 1."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))  # a task sends three rows of a source at most
    rows = rows.withColumn("nth", nth).filter("nth <= 3")
    held = rows.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "doc_id"))), lambda x: x["doc_id"]).alias("predicted"), F.collect_set(F.when(F.col("quality") == 1, F.col("doc_id"))).alias("relevant"))
    return held.select("source", F.round(search.precision_at_k(F.col("predicted"), F.col("relevant")), 6).alias("precision"))


ORACLE["precision_at_k"] = "SELECT source, round(avg((quality = 1)::INT), 6) AS precision FROM (SELECT source, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS nth FROM labels JOIN documents USING (doc_id)) WHERE nth <= 3 GROUP BY source"


@query
def latest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user."""
    return records.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


ORACLE["latest_ledger"] = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1"


@query
def qna_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question for each source, about its longest document."""
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_num"), F.col("doc_id").alias("position"), F.lit("Document Root").alias("section_title"), F.coalesce("text", F.lit("")).alias("text"))
    return records.qna(docs, "source")


def _first_sentence(x: str) -> str:
    flat = _COLLAPSE(x)
    return f"CASE WHEN contains({flat}, '. ') THEN {_strip(f'string_split({flat}, {chr(39)}. {chr(39)})[1]')} || '.' WHEN contains({flat}, '? ') THEN {_strip(f'string_split({flat}, {chr(39)}? {chr(39)})[1]')} || '?' WHEN contains({flat}, '! ') THEN {_strip(f'string_split({flat}, {chr(39)}! {chr(39)})[1]')} || '!' ELSE left({flat}, 240) END"


ORACLE["qna_candidates"] = f"""
WITH d AS (SELECT coalesce(source, '') AS source, CAST(doc_id AS VARCHAR) AS document_id, doc_id, {_strip("coalesce(text, '')")} AS t FROM documents),
s AS (SELECT *, length(t) + CASE WHEN regexp_matches(t, '[0-9]') THEN 50 ELSE 0 END AS score FROM d WHERE t <> ''),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS nth FROM s)
SELECT source, document_id, 1 AS page_num, score, 'What does ' || document_id || ' say in the section ''Document Root''?' AS question, {_first_sentence("t")} AS answer FROM b WHERE nth = 1"""


@query
def normalized_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's texts, two of them twice, as the headers of a table."""
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", F.array_join(extraction.numbered_headers(F.array("p_name", "p_brand", "p_type", "p_brand", "p_name")), ",").alias("headers"))


_HEADER = "CASE WHEN trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_') = '' THEN 'column' ELSE trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_') END"
ORACLE["normalized_headers"] = f"""
WITH c AS (SELECT p_partkey, [{", ".join(_HEADER.format(x) for x in ("p_name", "p_brand", "p_type", "p_brand", "p_name"))}] AS h FROM part)
SELECT p_partkey, array_to_string(list_transform(h, lambda x, i: CASE WHEN len(list_filter(h[1:i], lambda y: y = x)) > 1 THEN x || '_' || len(list_filter(h[1:i], lambda y: y = x)) ELSE x END), ',') AS headers FROM c"""

_SELECT = """
SELECT c_mktsegment, count(*) AS n_orders, round(sum(revenue), 2) AS revenue
FROM (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey) l
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""


@query
def structured_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any SELECT over views."""
    return readers.query(spark, _SELECT.strip(), **{name: table(spark, sf_dir, name) for name in ("lineitem", "orders", "customer")})


ORACLE["structured_query"] = _SELECT
