"""The queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import (
    _spans,
    chat_format,
    language_id,
    media,
    mixing,
    packing,
    pii,
    secret_scan,
    simhash,
    token_counts,
    vector_dedup,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _span_digests(spans: DataFrame, base: tuple[str, ...]) -> DataFrame:
    found = F.col("found")
    return spans.select(
        "doc_id",
        *(_spans.n_of(found, kind).alias(f"n_{kind}") for kind in base),
        F.sha2(_spans.digest(_spans.of_kinds(found, base)), 256).alias("base_sha256"),
        _spans.digest(found).alias("spans"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _span_digests(docs.select("doc_id", secret_scan.secret_spans(F.col("text")).alias("found")), secret_scan.BASE)


def op2_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), spark)


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), spark)


def op4_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.suffix_table(token_counts.length_histogram(docs, token_counts.token_count(F.col("text"), spark)), spark)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train_on(docs)
    return docs.select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), language_id.prediction(F.col("text"), model).alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.second", "p.ambiguous")


def op6_maximal_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.maximal_conversations(_table(spark, sf_dir, "conversations"), spark)


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_mix(_table(spark, sf_dir, "documents"), spark)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _span_digests(docs.select("doc_id", pii.personal_spans(F.col("text")).alias("found")), pii.BASE)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), spark)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_media_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    stored = docs.select("doc_id", n_bytes, media.stored_text(F.col("text")).alias("s"))
    read = stored.select("doc_id", "n_bytes", "s.media", "s.payload", F.col("s.index.tracks")[0].alias("i"))
    ranges = F.array_join(F.transform("i.keyframes", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -media.FRAME, media.FRAME)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(
            F.lit("codec="), F.trim("i.codec"), F.lit(";timescale="), F.col("i.timescale").cast("string"), F.lit(";duration="), F.col("i.duration").cast("string"),
            F.lit(";samples="), F.col("i.samples").cast("string"), F.lit(";keyframes="), ranges,
        ).alias("feature"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_vector_near_dedup,
        op3_length_buckets,
        op4_token_histogram,
        op5_language_id,
        op6_maximal_conversations,
        op7_fair_mix,
        op8_personal_data,
        op9_simhash,
        op10_media_index,
    )
}

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"


def packing_sql(context: int = packing.CONTEXT, buckets: int = packing.BUCKETS, budget: int = packing.BUDGET) -> str:
    """The dynamic programme as one common table expression for each bucket: ``k<n>``
    has the least padding of the first j lengths in n buckets and where the last starts."""
    steps = []
    for n in range(2, buckets + 1):
        steps.append(
            f"""k{n}_all AS (
  SELECT j.j, i.j AS start, p.cost + j.length * (j.docs - p.docs) - (j.tokens - p.tokens) AS cost
  FROM h j JOIN h i ON i.j <= j.j JOIN k{n - 1} p ON p.j = i.j - 1 WHERE i.j >= {n}),
k{n} AS (SELECT a.j, h.docs, h.tokens, min(a.cost) AS cost, min(a.start) FILTER (a.cost = m.cost) AS start
  FROM k{n}_all a JOIN (SELECT j, min(cost) AS cost FROM k{n}_all GROUP BY j) m USING (j) JOIN h USING (j) GROUP BY a.j, h.docs, h.tokens)"""
        )
    # The last bucket of n ends at the last length; the one before it ends where that one starts.
    backs = [f"b{buckets} AS (SELECT least({buckets}, (SELECT max(j) FROM h)) AS n, (SELECT max(j) FROM h) AS j)"]
    for n in range(buckets, 1, -1):
        backs.append(
            f"b{n - 1} AS (SELECT CASE WHEN b.n = {n} THEN {n - 1} ELSE b.n END AS n,"
            f" CASE WHEN b.n = {n} THEN (SELECT start - 1 FROM k{n} WHERE k{n}.j = b.j) ELSE b.j END AS j FROM b{n} b)"
        )
    tops = " UNION ALL ".join(f"SELECT {n} AS bucket, j FROM b{n} WHERE n = {n}" for n in range(1, buckets + 1))
    return f"""WITH sized AS (SELECT doc_id, {_WORDS} AS tokens FROM documents),
cut AS (SELECT doc_id, piece::INTEGER AS piece, least({context}, tokens - piece * {context})::BIGINT AS length
  FROM (SELECT doc_id, tokens, unnest(range(greatest(1, (tokens + {context - 1}) // {context}))) AS piece FROM sized)),
h AS (SELECT length, row_number() OVER (ORDER BY length) AS j, sum(n) OVER (ORDER BY length)::BIGINT AS docs,
  sum(n * length) OVER (ORDER BY length)::BIGINT AS tokens
  FROM (SELECT length, count(*) AS n FROM cut WHERE length > 0 GROUP BY length)),
k1 AS (SELECT j, docs, tokens, length * docs - tokens AS cost, 1::BIGINT AS start FROM h),
{", ".join(steps)},
{", ".join(backs)},
tops AS (SELECT t.bucket, h.length AS boundary FROM ({tops}) t JOIN h USING (j)),
placed AS (SELECT doc_id, piece, length, (SELECT min(boundary) FROM tops WHERE boundary >= length) AS boundary FROM cut WHERE length > 0),
ranked AS (SELECT p.*, t.bucket, row_number() OVER (PARTITION BY t.bucket
  ORDER BY md5(coalesce(doc_id::VARCHAR, '') || '|' || piece), doc_id, piece, length) - 1 AS rank FROM placed p JOIN tops t USING (boundary))
SELECT doc_id, piece, length, bucket::INTEGER AS bucket, boundary, rank // greatest(1, {budget} // boundary) AS batch FROM ranked
UNION ALL SELECT doc_id, piece, length, NULL, NULL, NULL FROM cut WHERE length = 0"""


CHAT_SQL = f"""WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id
  ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, string_agg(CASE WHEN role IS NULL THEN 'n' ELSE 'r' END || CASE WHEN text IS NULL THEN 'n' ELSE 't' END
  || length(coalesce(role, '')) || ':' || length(coalesce(text, '')) || ':' || coalesce(role, '') || coalesce(text, ''), '|')
  OVER (PARTITION BY conv_id ORDER BY place) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
w AS (SELECT n_turns, prefix, min(conv_id) AS conv_id FROM p WHERE place = n_turns - 1 GROUP BY n_turns, prefix),
kept AS (SELECT conv_id, n_turns FROM w WHERE NOT EXISTS
  (SELECT 1 FROM p WHERE p.place < p.n_turns - 1 AND p.place + 1 = w.n_turns AND p.prefix = w.prefix))
SELECT conv_id, kept.n_turns, (place // {chat_format.PART})::INTEGER AS part,
  string_agg('{chat_format.OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{chat_format.CLOSE}' || chr(10), '' ORDER BY place) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY conv_id, kept.n_turns, place // {chat_format.PART}"""

MIX_SQL = f"""WITH sizes AS (SELECT doc_id, source, {_WORDS} AS size, row_number() OVER () AS row FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sizes GROUP BY source),
ranked AS (SELECT source, source_size, {mixing.EPOCHS} * source_size AS most, [3, 1, 2][turn + 1] AS weight FROM per),
leveled AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0)::DOUBLE)
  / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM ranked WINDOW before AS (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size,
  least(most::DOUBLE, (max(CASE WHEN level * weight <= most THEN level END) OVER ()) * weight) AS target FROM leveled),
queued AS (SELECT s.doc_id, s.source, s.size, s.row, t.source_size, t.target, md5(coalesce(doc_id::VARCHAR, '')) AS o,
  coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size, row
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
uses AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - before - epoch * source_size)) AS served
  FROM queued, (SELECT unnest(range({mixing.EPOCHS})) AS epoch)),
timed AS (SELECT *, CASE WHEN served > 0 THEN (before + epoch * source_size + served)::DOUBLE / target END AS finish FROM uses),
placed AS (SELECT *, sum(served) OVER (ORDER BY finish, coalesce(source, ''), source IS NULL, epoch, o, doc_id NULLS FIRST, row
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto FROM timed)
SELECT min(doc_id) AS doc_id, min(size) AS size, min(source_size) AS source_size, min(target) AS target, sum(served)::BIGINT AS taken,
  min(CASE WHEN served > 0 THEN upto END) AS first_end FROM placed GROUP BY row"""

ORACLES: dict[str, str] = {
    "op3_length_buckets": packing_sql(),
    "op6_maximal_conversations": CHAT_SQL,
    "op7_fair_mix": MIX_SQL,
}
