"""The thin queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontaminate, langid, licenses, mixing, simhash, suffix, url_filter, vectors
from .shared import reused, scratch_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def tokenizer_path() -> str:
    return vocabulary_file("word_bpe_49k.json")


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs.filter(~F.coalesce(langid.held_out(), F.lit(False))), vocabulary_file("piece_bpe_32k.model"))


@query
def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as directly addressable codes and read back."""
    path = scratch_path(spark, "codes")
    codes.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return codes.documents(spark, path)


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predicted(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more between embeddings of one label, and their components."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


#: The dated events of the list that op4 applies.
LISTED = (
    ("host", "spam-farm.example.org", "spam", "add", "2024-02-01"),
    ("host", "spam-farm.example.org", "spam", "remove", "2024-09-01"),
    ("host", "spam-farm.example.org", "spam", "add", "2024-11-15"),
    ("domain", "tionsh.example.net", "malware", "add", "2024-03-10"),
    ("domain", "tionsh.example.net", "malware", "remove", "2024-05-20"),
    ("domain", "ththan.example.net", "adult", "add", "2024-01-20"),
    ("domain", "ththan.example.net", "gambling", "add", "2024-08-01"),
    ("domain", "example.com", "quarantine", "add", "2024-06-10"),
    ("domain", "example.com", "quarantine", "remove", "2024-07-10"),
    ("host", "blog.tionble.example.com", "plagiarism", "add", "2024-06-20"),
    ("prefix", "thther.example.org/en", "phishing", "add", "2024-04-01"),
    ("prefix", "thther.example.org/en", "phishing", "remove", "2024-10-01"),
    ("prefix", "tionsh.example.net/fr", "copied", "add", "2024-04-15"),
)


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page held against the list at its time of fetching: 2024-01-01 and page_id mod 366 days, page_id mod 24 hours."""
    fetched = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(pmod(page_id, 366) AS int), cast(pmod(page_id, 24) AS int))")
    events = spark.createDataFrame(LISTED, "kind string, key string, category string, action string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    found = url_filter.evaluate(table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at")), events)
    return found.select("page_id", "host", "blocked", F.col("kind").alias("entry_kind"), F.col("key").alias("entry_key"), "category", F.date_format("since", "yyyy-MM-dd").alias("active_since"))


ORACLE["op4_url_filter"] = rf"""
WITH ev(kind, key, category, action, ts) AS (VALUES {", ".join(str(x) for x in LISTED)}),
iv AS (
  SELECT * FROM (SELECT kind, key, category, action, CAST(ts AS TIMESTAMP) AS since, lead(CAST(ts AS TIMESTAMP)) OVER (PARTITION BY kind, key ORDER BY ts) AS until FROM ev)
  WHERE action = 'add'),
p AS (
  SELECT page_id, row_number() OVER () AS n, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 366 AS INTEGER)) + to_hours(page_id % 24) AS ts,
         coalesce(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s:]*)', 1)), '') AS host,
         coalesce(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*(/[^?#\s]*)?', 1), '') AS path
  FROM pages),
s AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS steps FROM p),
k AS (
  SELECT n, ts, 2 AS r, 'host' AS kind, host AS key FROM s
  UNION ALL SELECT n, ts, 1, 'domain', array_to_string(labels[i:], '.') FROM s, unnest(range(1, len(labels) + 1)) AS u(i)
  UNION ALL SELECT n, ts, 3, 'prefix', lower(host || '/' || array_to_string(steps[:i], '/')) FROM s, unnest(range(1, len(steps) + 1)) AS u(i)),
m AS (
  SELECT k.n, iv.*, row_number() OVER (PARTITION BY k.n ORDER BY r DESC, length(iv.key) DESC) AS nth
  FROM k JOIN iv ON k.kind = iv.kind AND k.key = iv.key AND k.ts >= since AND (until IS NULL OR k.ts < until))
SELECT page_id, host, m.key IS NOT NULL AS blocked, kind AS entry_kind, key AS entry_key, category, strftime(since, '%Y-%m-%d') AS active_since
FROM p LEFT JOIN m ON p.n = m.n AND m.nth = 1
"""


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted, written, and read back."""
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(stored(chat.format_messages(rows), "formatted"))


ORACLE["op5_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, 4 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h')) + 1
         + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) + 9 AS n
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op6_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at weights 5, 2, 1 over one and a half times their words."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(reused(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))))


ORACLE["op6_weighted_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM t),
o AS (
  SELECT *, sum(s) OVER () AS total,
         coalesce(sum(s) OVER (ORDER BY s / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY s / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing
  FROM w),
c AS (SELECT *, w * (3 * total - 4 * before) >= 4 * s * sharing AS capped FROM o),
g AS (SELECT *, 3 * total - 4 * sum(CASE WHEN capped THEN s ELSE 0 END) OVER () AS rest, sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS shared FROM c),
x AS (SELECT source, s, CASE WHEN capped THEN CAST(2 * s AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / CAST(2 * shared AS DOUBLE) END AS target FROM g),
q AS (
  SELECT d.*, x.s, x.target, row_number() OVER () AS n,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS done
  FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
f AS (SELECT n, source, size, done, turn, CAST(done + turn * s AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1)) AS v(turn) WHERE size > 0),
m AS (
  SELECT n, size, sum(size) OVER (ORDER BY finish, source ASC NULLS LAST, turn, done ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before,
         (SELECT CAST(floor(sum(size) * 3 / 2) AS BIGINT) FROM d) AS budget
  FROM f),
u AS (SELECT n, CAST(sum(greatest(0, least(size, budget - before))) AS BIGINT) AS taken FROM m GROUP BY n)
SELECT doc_id, size, s AS source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN u USING (n)
"""


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of the documents that may speak of a licence, with the family that stands."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 200 bytes that also start elsewhere."""
    found = suffix.deduplicated(table(spark, sf_dir, "documents"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
    return found.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that belong to an occurrence of a 13-word benchmark window."""
    found = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated(hit, F.col("n_words")).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op9_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS.format("text")}, []) AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, i, i + least(13, len(w)) - 1) AS win
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM p),
s AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
  FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
m AS (SELECT s.doc_id, s.i, s.n, p.item_id FROM s JOIN p ON s.n = p.n AND s.win = p.win),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM m, unnest(range(i, i + n)) AS u(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the classes they link."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")
