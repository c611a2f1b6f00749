"""Registered queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import sizing
from tallyweave.functions.sizing import Grid
from tallyweave.operators import counters, exact, experiments, linear, metrics, sampling
from tallyweave.sources import pageviews, streams, synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PHI, K = 1e-3, 100
CMS, SKETCH, AMS = Grid(4, 2048), Grid(5, 2048), Grid(5, 64)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- pieces of SQL ---------------------------------------------------------------------

_SPLIT = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
WORDS = f"""s AS (SELECT key, 1::BIGINT AS weight, n * {streams.WORDS} + pos AS ord FROM
 (SELECT n, unnest(w) AS key, unnest(range(len(w))) AS pos FROM (SELECT doc_id AS n, {_SPLIT} AS w FROM documents)))"""
TALK = f"""t AS (SELECT key, count(*)::BIGINT AS total FROM (SELECT unnest({_SPLIT}) AS key FROM conversations) GROUP BY key)"""
USERS = "s AS (SELECT user_id::VARCHAR AS key, 1::BIGINT AS weight, event_id AS ord FROM events WHERE user_id IS NOT NULL)"
TYPED = "s AS (SELECT event_type || user_id::VARCHAR AS key, round(value)::BIGINT AS weight, event_id AS ord FROM events WHERE event_type || user_id::VARCHAR IS NOT NULL AND value IS NOT NULL)"
SUPPLIERS = "s AS (SELECT l_suppkey::VARCHAR AS key, l_quantity::BIGINT AS weight, l_orderkey * 16 + l_linenumber AS ord FROM lineitem)"
PARTS = SUPPLIERS.replace("l_suppkey", "l_partkey")
COUNT = "f AS (SELECT key, sum(weight)::BIGINT AS total FROM s GROUP BY key), n AS (SELECT coalesce(sum(total), 0)::BIGINT AS n FROM f)"
HEAVY = f"hh AS (SELECT key, total FROM f, n WHERE total >= ceil({PHI}::DOUBLE * n.n)::BIGINT)"


def _hash(text: str, first: int) -> str:
    return f"('0x' || substr(md5({text}), {first}, 15))::BIGINT"


def _places(grid: Grid, keys: str = "f", tag: str = "") -> str:
    text = "r || ':' || key"
    return (
        f"p{tag} AS (SELECT {keys}.*, r, {_hash(text, 1)} % {grid.width} AS b, 1 - 2 * ({_hash(text, 17)} & 1) AS sgn"
        f" FROM {keys}, (SELECT unnest(range({grid.rows})) AS r))"
    )


def _cms(grid: Grid, tag: str = "") -> str:
    """Cells ``c`` and estimates ``e`` of Count-Min over ``f``."""
    return f"""{_places(grid, tag=tag)}, c{tag} AS (SELECT r, b, sum(total)::BIGINT AS cell FROM p{tag} GROUP BY r, b),
e{tag} AS (SELECT key, min(cell)::BIGINT AS estimate FROM p{tag} JOIN c{tag} USING (r, b) GROUP BY key)"""


def _sketch(grid: Grid, tag: str = "") -> str:
    return f"""{_places(grid, tag=tag)}, c{tag} AS (SELECT r, b, sum(total * sgn)::BIGINT AS cell FROM p{tag} GROUP BY r, b),
e{tag} AS (SELECT key, (list_sort(list(sgn * cell))[len(list(cell)) // 2 + 1])::BIGINT AS estimate FROM p{tag} JOIN c{tag} USING (r, b) GROUP BY key)"""


def _ams(grid: Grid, copies: int) -> str:
    sign = _hash(f"(r * {grid.width} + c) || ':' || key", 17)
    return f"""a AS (SELECT f.*, r, c, 1 - 2 * ({sign} & 1) AS sgn FROM f, (SELECT unnest(range({grid.rows})) AS r), (SELECT unnest(range({grid.width})) AS c)),
x AS (SELECT r, c, sum(total * sgn)::BIGINT AS x FROM a GROUP BY r, c),
m AS (SELECT key, r, (sum(sgn * x)::BIGINT // {copies}) AS m FROM a JOIN x USING (r, c) WHERE c < {copies} GROUP BY key, r),
ae AS (SELECT key, list_sort(list(m))[len(list(m)) // 2 + 1] AS estimate FROM m GROUP BY key)"""


def _mg(capacity: int, tag: str = "", keys: str = "f") -> str:
    return f"""mg{tag} AS (SELECT key, total - cut AS estimate FROM {keys}, (SELECT coalesce(max(CASE WHEN k = {capacity} + 1 THEN total END), 0) AS cut
 FROM (SELECT total, row_number() OVER (ORDER BY total DESC) AS k FROM {keys})) WHERE total > cut)"""


def _lc(window: int, tag: str = "") -> str:
    return f"""o{tag} AS (SELECT key, min(ord) AS ord, sum(weight)::BIGINT AS weight FROM s GROUP BY key),
lc{tag} AS (SELECT key, weight AS estimate FROM (SELECT *, coalesce(sum(weight) OVER (ORDER BY ord, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM o{tag}), n
 WHERE weight + before // {window} > n.n // {window})"""


_TIMES = f"[{', '.join(f'{t!r}::DOUBLE' for t in sampling.TIMES)}]"


def _units(seeds: tuple[int, ...], size: int) -> str:
    """``ar`` (seed, key, tm, level): arrivals of units over ``f`` and ``n``."""
    text = "seed || ':' || piece || ':' || {j} || ':' || key"
    wait = "(-ln((" + _hash(text, 1) + f"::DOUBLE + 1.0::DOUBLE) / {float(1 << 60)!r}::DOUBLE) / (units - {{j}})::DOUBLE)"
    enough, most = sampling.enough(size), sampling.MOST
    return f"""ls AS (SELECT CASE WHEN n.n > {enough} THEN floor(log2(n.n::DOUBLE / {enough}::DOUBLE))::INTEGER ELSE 0 END AS lv FROM n),
bd AS (SELECT f.key, f.total, lv, 1::BIGINT << greatest(0, lv - 2) AS bound, CASE WHEN lv > 0 THEN {_TIMES}[lv] ELSE 'infinity'::DOUBLE END AS lim FROM f, ls WHERE total > 0),
pc AS (SELECT *, least(bound, total - piece * bound) AS units FROM (SELECT *, unnest(range((total - 1) // bound + 1)) AS piece FROM bd), (SELECT unnest([{", ".join(map(str, seeds))}]) AS seed)),
w0 AS (SELECT *, {wait.format(j="0")} AS first FROM pc),
w1 AS (SELECT *, CASE WHEN units > 1 THEN {wait.format(j="1")} ELSE 'infinity'::DOUBLE END AS second FROM w0 WHERE first < lim),
w2 AS (SELECT seed, key, piece, j, lim, {wait.format(j="j")} AS wait FROM (SELECT *, unnest(range(least(units, {most}))) AS j FROM w1 WHERE first + second < lim)),
ar AS (SELECT *, len(list_filter({_TIMES}, lambda t: tm < t))::INTEGER AS level FROM
 (SELECT seed, key, first AS tm, lim FROM w1 WHERE NOT first + second < lim UNION ALL SELECT seed, key, sum(wait) OVER (PARTITION BY seed, key, piece ORDER BY j) AS tm, lim FROM w2) WHERE tm < lim),
bl AS (SELECT seed, level, count(*) AS c FROM ar GROUP BY seed, level),
rk AS (SELECT seed, key, row_number() OVER (PARTITION BY seed ORDER BY tm, key) AS place FROM ar)"""


def _concise(size: int, tag: str = "") -> str:
    return f"""t{tag} AS (SELECT seed, min(k)::INTEGER AS least FROM (SELECT seed, k, sum(CASE WHEN level >= k THEN c ELSE 0 END) AS kept
 FROM bl, (SELECT unnest(range(61)) AS k), ls WHERE k >= lv GROUP BY seed, k) WHERE kept <= {size} GROUP BY seed),
cs{tag} AS (SELECT seed, key, count(*)::BIGINT AS sample_count, min(1::BIGINT << least) AS t FROM ar JOIN t{tag} USING (seed) WHERE level >= least GROUP BY seed, key),
ca{tag} AS (SELECT key, floor(sum(sample_count * t) / 5 + 0.5::DOUBLE)::BIGINT AS estimate FROM cs{tag} GROUP BY key)"""


def _reservoir(size: int, tag: str = "") -> str:
    return f"""rs{tag} AS (SELECT seed, key, count(*) AS sample_count FROM rk WHERE place <= {size} GROUP BY seed, key),
rm{tag} AS (SELECT seed, sum(sample_count)::BIGINT AS m FROM rs{tag} GROUP BY seed),
re{tag} AS (SELECT seed, key, sample_count, m, floor(sample_count::DOUBLE * n.n / m + 0.5::DOUBLE)::BIGINT AS estimate FROM rs{tag} JOIN rm{tag} USING (seed), n),
ra{tag} AS (SELECT key, floor(sum(estimate) / 5 + 0.5::DOUBLE)::BIGINT AS estimate FROM re{tag} GROUP BY key)"""


def _ss(capacity: int, tag: str = "") -> str:
    return f"ss{tag} AS (SELECT key, total AS estimate, 0::BIGINT AS error FROM f ORDER BY total DESC, key LIMIT {capacity})"


_REL = "100.0::DOUBLE * abs(estimate - total)::DOUBLE / total::DOUBLE"
_PCT = "CASE WHEN {1} = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * ({0})::DOUBLE / ({1})::DOUBLE END"


def _quality(reported: str, true: str, by: str = "") -> str:
    """SQL of ``metrics.set_quality``; ``by`` ends in a comma if it is given."""
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""SELECT {by} reported_count, true_count, tp, fp, true_count - tp AS fn, round(pr, 6) AS precision_pct, round(re, 6) AS recall_pct,
 round(CASE WHEN pr + re = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * pr * re / (pr + re) END, 6) AS f1_pct, mean_abs_error, max_abs_error, mean_rel_error_pct, max_rel_error_pct FROM
 (SELECT *, {_PCT.format("tp", "reported_count")} AS pr, {_PCT.format("tp", "true_count")} AS re FROM
 (SELECT {by} count(*) AS reported_count, count(total) AS tp, count(*) - count(total) AS fp, coalesce(max(abs(estimate - total)), 0)::BIGINT AS max_abs_error,
 coalesce(round(avg(abs(estimate - total)), 6), 0.0)::DOUBLE AS mean_abs_error, coalesce(round(avg({_REL}), 6), 0.0)::DOUBLE AS mean_rel_error_pct,
 coalesce(round(max({_REL}), 6), 0.0)::DOUBLE AS max_rel_error_pct FROM {reported} LEFT JOIN {true} USING (key) {group}), (SELECT count(*) AS true_count FROM {true}))"""


# --- exact -------------------------------------------------------------------------------


@query(f"WITH {WORDS}, {COUNT} SELECT key, total FROM f")
def exact_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return exact.frequencies(streams.document_words(spark, folder))


@query(f"WITH {SUPPLIERS}, {COUNT} SELECT n, (SELECT count(*) FROM f) AS keys, (SELECT max(total) FROM f) AS most FROM n")
def exact_total(spark: SparkSession, folder: str) -> DataFrame:
    counted = exact.frequencies(streams.suppliers(spark, folder))
    return counted.agg(F.sum("total").alias("n"), F.count("*").alias("keys"), F.max("total").alias("most"))


@query(f"WITH {WORDS}, {COUNT}, {HEAVY} SELECT * FROM hh")
def exact_heavy_hitters(spark: SparkSession, folder: str) -> DataFrame:
    return exact.heavy_hitters(exact.frequencies(streams.document_words(spark, folder)), PHI)


@query(f"WITH {PARTS}, {COUNT} SELECT key, total FROM f, n WHERE total >= ceil(0.01::DOUBLE * n.n)::BIGINT")
def exact_heavy_hitters_none(spark: SparkSession, folder: str) -> DataFrame:
    return exact.heavy_hitters(exact.frequencies(streams.parts(spark, folder)), 0.01)


@query(f"WITH {WORDS}, {COUNT} SELECT key, total FROM f ORDER BY total DESC, key LIMIT {K}")
def exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return exact.top_k(exact.frequencies(streams.document_words(spark, folder)), K)


@query(
    f"""WITH {WORDS}, {COUNT}, {HEAVY}, {TALK}, m AS (SELECT sum(total)::BIGINT AS n FROM t)
SELECT hh.key, hh.total AS baseline_total, coalesce(t.total, 0) AS stream_total, CASE WHEN t.total IS NULL THEN 'never'
 WHEN t.total < ceil({PHI}::DOUBLE * m.n)::BIGINT THEN 'below' ELSE 'heavy' END AS state FROM hh LEFT JOIN t USING (key), m"""
)
def key_diagnostic(spark: SparkSession, folder: str) -> DataFrame:
    true = exact.heavy_hitters(exact.frequencies(streams.document_words(spark, folder)), PHI)
    return exact.diagnose(true, exact.frequencies(streams.conversation_words(spark, folder)), PHI)


_LINES = """CASE page_id % 6 WHEN 0 THEN 'en ' || url || ' web all ' || page_id || ' x' WHEN 1 THEN '  de' || chr(9) || url || '  web' || chr(9) || 'u ' || page_id * 3 || ' y z'
 WHEN 2 THEN 'fr - web all 7 x' WHEN 3 THEN 'es ' || url || ' web all many x' WHEN 4 THEN 'it ' || url || ' web all' ELSE 'pt ' || url || ' app user 9 x' END"""


@query(
    f"""SELECT f[1] AS project, f[2] AS page, f[3] AS access, f[4] AS agent, try_cast(f[5] AS BIGINT) AS views, f[1] || '/' || f[2] AS key
FROM (SELECT regexp_extract_all({_LINES}, '[^\\x20\\x09-\\x0D]+') AS f FROM pages) WHERE len(f) >= 6 AND try_cast(f[5] AS BIGINT) IS NOT NULL AND f[2] <> '-'"""
)
def parse_pageviews(spark: SparkSession, folder: str) -> DataFrame:
    lines = streams.table(spark, folder, "pages").select(F.expr(_LINES).alias("value"))
    return pageviews.parse_pageviews(lines)


@query(
    """WITH h AS (SELECT sum(pow(i::DOUBLE, -1.2::DOUBLE)) AS h FROM range(1, 20001) r(i))
SELECT 'synth_' || i AS key, round(100000.0::DOUBLE / (pow(i::DOUBLE, 1.2::DOUBLE) * h))::BIGINT AS weight, i AS ord FROM range(1, 5001) r(i), h
WHERE round(100000.0::DOUBLE / (pow(i::DOUBLE, 1.2::DOUBLE) * h)) > 0"""
)
def zipf_stream(spark: SparkSession, folder: str) -> DataFrame:
    return synthetic.zipf_stream(spark, 1.2, 20_000, 100_000, 5_000)


# --- linear sketches ------------------------------------------------------------------------


def _words(spark: SparkSession, folder: str) -> DataFrame:
    return exact.frequencies(streams.document_words(spark, folder))


@query(f"WITH {WORDS}, {COUNT}, {_cms(CMS)} SELECT r::INTEGER AS row, b AS bucket, cell FROM c")
def cms_cells(spark: SparkSession, folder: str) -> DataFrame:
    return linear.count_min(_words(spark, folder), CMS).select("row", "bucket", "cell")


@query(f"WITH {WORDS}, {COUNT}, {_cms(CMS)} SELECT key, estimate, total FROM e JOIN f USING (key)")
def cms_estimates(spark: SparkSession, folder: str) -> DataFrame:
    counted = _words(spark, folder)
    found = linear.count_min_estimates(counted, linear.count_min(counted, CMS), CMS)
    return found.join(counted, "key").select("key", "estimate", "total")


@query(f"WITH {WORDS}, {COUNT}, {_cms(CMS)} SELECT key, estimate FROM e, n WHERE estimate >= ceil({PHI}::DOUBLE * n.n)::BIGINT")
def cms_heavy_hitters(spark: SparkSession, folder: str) -> DataFrame:
    counted = _words(spark, folder)
    found = linear.count_min_estimates(counted, linear.count_min(counted, CMS), CMS)
    return linear.heavy(found, counted, PHI).select("key", "estimate")


_SPLIT_PART = _hash("'part' || ':' || key", 1)


@query(
    f"""WITH {WORDS}, {COUNT}, {_cms(CMS)}, q AS (SELECT {_SPLIT_PART} % 4 AS part, key, sum(weight)::BIGINT AS total FROM s GROUP BY ALL),
{_places(CMS, "q", "q")}, m AS (SELECT r, b, sum(cell)::BIGINT AS cell FROM (SELECT part, r, b, sum(total) AS cell FROM pq GROUP BY part, r, b) GROUP BY r, b)
SELECT count(*) AS cells, max(abs(c.cell - m.cell))::BIGINT AS max_abs_diff FROM c FULL JOIN m USING (r, b)"""
)
def cms_merge_deviation(spark: SparkSession, folder: str) -> DataFrame:
    stream = streams.document_words(spark, folder)
    whole = linear.count_min(exact.frequencies(stream), CMS).withColumnRenamed("cell", "whole")
    merged = linear.by_partition(exact.frequencies(stream), 4, CMS)
    both = whole.join(merged, ["tag", "row", "bucket"], "full_outer")
    return both.agg(F.count("*").alias("cells"), F.max(F.abs(F.col("whole") - F.col("cell"))).alias("max_abs_diff"))


_POOL = Grid(3, 2048)


@query(
    f"""WITH {TYPED}, {_places(_POOL, "s")}, e AS (SELECT ord, min(up) AS estimate FROM (SELECT ord, sum(weight) OVER (PARTITION BY r, b ORDER BY ord) AS up FROM p) GROUP BY ord),
n AS (SELECT ord, key, sum(weight) OVER (ORDER BY ord) AS n FROM s)
SELECT DISTINCT key FROM n JOIN e USING (ord) WHERE estimate >= 0.002::DOUBLE * n"""
)
def cms_candidate_pool(spark: SparkSession, folder: str) -> DataFrame:
    return linear.candidate_pool(streams.typed_users(spark, folder), _POOL, 0.002, shift=10)


@query(
    f"""WITH {TYPED}, {_places(_POOL, "s")}, e AS (SELECT ord, list_sort(list(up * sgn))[2] AS estimate FROM (SELECT ord, sgn, sum(weight * sgn) OVER (PARTITION BY r, b ORDER BY ord) AS up FROM p) GROUP BY ord),
n AS (SELECT ord, key, sum(weight) OVER (ORDER BY ord) AS n FROM s)
SELECT DISTINCT key FROM n JOIN e USING (ord) WHERE estimate >= 0.002::DOUBLE * n"""
)
def countsketch_candidate_pool(spark: SparkSession, folder: str) -> DataFrame:
    return linear.candidate_pool(streams.typed_users(spark, folder), _POOL, 0.002, shift=10, signed=True)


@query(f"WITH {WORDS}, {COUNT}, {_sketch(SKETCH)} SELECT r::INTEGER AS row, b AS bucket, cell FROM c WHERE cell <> 0")
def countsketch_cells(spark: SparkSession, folder: str) -> DataFrame:
    return linear.count_sketch(_words(spark, folder), SKETCH).select("row", "bucket", "cell")


@query(f"WITH {WORDS}, {COUNT}, {_sketch(SKETCH)} SELECT key, estimate, total FROM e JOIN f USING (key)")
def countsketch_estimates(spark: SparkSession, folder: str) -> DataFrame:
    counted = _words(spark, folder)
    found = linear.count_sketch_estimates(counted, linear.count_sketch(counted, SKETCH), SKETCH)
    return found.join(counted, "key").select("key", "estimate", "total")


@query(f"WITH {WORDS}, {COUNT}, {_sketch(SKETCH)} SELECT key, estimate FROM e, n WHERE estimate >= ceil({PHI}::DOUBLE * n.n)::BIGINT")
def countsketch_heavy_hitters(spark: SparkSession, folder: str) -> DataFrame:
    counted = _words(spark, folder)
    found = linear.count_sketch_estimates(counted, linear.count_sketch(counted, SKETCH), SKETCH)
    return linear.heavy(found, counted, PHI).select("key", "estimate")


@query(
    f"""WITH {WORDS}, {COUNT}, {_sketch(SKETCH)}, q AS (SELECT r, sum(cell::DOUBLE * cell) AS s FROM c GROUP BY r)
SELECT list_sort(list(s))[len(list(s)) // 2 + 1] AS f2, (SELECT sum(total::DOUBLE * total) FROM f) AS exact_f2 FROM q"""
)
def countsketch_f2(spark: SparkSession, folder: str) -> DataFrame:
    counted = _words(spark, folder)
    true = counted.agg(F.sum(F.col("total").cast("double") * F.col("total")).alias("exact_f2"))
    return linear.second_moment(linear.count_sketch(counted, SKETCH)).select("f2").crossJoin(F.broadcast(true))  # one row


@query(f"WITH {USERS}, {COUNT}, {_ams(AMS, 64)} SELECT r::INTEGER AS row, c::INTEGER AS copy, x FROM x")
def ams_state(spark: SparkSession, folder: str) -> DataFrame:
    return linear.ams(exact.frequencies(streams.users(spark, folder)), AMS)


@query(
    f"""WITH {USERS}, {COUNT}, {_ams(AMS, 64)}, {_ams(AMS, 16).replace("a AS", "a2 AS").replace("x AS", "x2 AS").replace("m AS", "m2 AS").replace("ae AS", "ae2 AS").replace("FROM m ", "FROM m2 ")}
SELECT 64 AS copies, key, estimate FROM ae UNION ALL SELECT 16, key, estimate FROM ae2"""
)
def ams_estimates(spark: SparkSession, folder: str) -> DataFrame:
    counted = exact.frequencies(streams.users(spark, folder))
    return linear.ams_estimates(counted, linear.ams(counted, AMS), AMS, [16, 64])


@query(
    f"""WITH {USERS}, {COUNT}, {_ams(AMS, 64)}, q AS (SELECT r, sum(x)::BIGINT // 64 AS lm, sum(x::DOUBLE * x) / 64 AS sm FROM x GROUP BY r)
SELECT list_sort(list(lm))[len(list(lm)) // 2 + 1] AS linear_mean, list_sort(list(sm))[len(list(sm)) // 2 + 1] AS f2 FROM q"""
)
def ams_moments(spark: SparkSession, folder: str) -> DataFrame:
    state = linear.ams(exact.frequencies(streams.users(spark, folder)), AMS)
    mean = linear.ams_linear_mean(state, AMS).withColumnRenamed("estimate", "linear_mean")
    return mean.crossJoin(F.broadcast(linear.ams_second_moment(state, AMS)))  # one row each


_GATE = Grid(3, 64)


@query(
    f"""WITH {USERS}, {COUNT}, {_cms(_GATE)}, {_ams(AMS, 64)}
SELECT key, ae.estimate FROM ae JOIN e USING (key), n WHERE e.estimate >= ceil(0.006::DOUBLE * n.n)::BIGINT AND ae.estimate >= ceil(0.006::DOUBLE * n.n)::BIGINT"""
)
def ams_gated_heavy_hitters(spark: SparkSession, folder: str) -> DataFrame:
    return linear.gated_ams(exact.frequencies(streams.users(spark, folder)), _GATE, AMS, 0.006)


# --- counters ---------------------------------------------------------------------------------


@query(f"WITH {WORDS}, {COUNT}, {_mg(500)} SELECT key, estimate FROM mg")
def mg_offline(spark: SparkSession, folder: str) -> DataFrame:
    return counters.misra_gries_offline(_words(spark, folder), 500)


@query(
    f"""WITH {WORDS}, q AS (SELECT {_SPLIT_PART} % 2 AS part, key, sum(weight)::BIGINT AS total FROM s GROUP BY ALL),
q0 AS (SELECT * FROM q WHERE part = 0), q1 AS (SELECT * FROM q WHERE part = 1), {_mg(300, "0", "q0")}, {_mg(300, "1", "q1")},
b AS (SELECT key, sum(estimate)::BIGINT AS total FROM (SELECT * FROM mg0 UNION ALL SELECT * FROM mg1) GROUP BY key), {_mg(300, "", "b")} SELECT key, estimate FROM mg"""
)
def mg_merge(spark: SparkSession, folder: str) -> DataFrame:
    stream = streams.document_words(spark, folder)
    part = F.pmod(linear.hash_pair(F.lit("part"), F.col("key"))["hi"], F.lit(2))
    halves = [counters.misra_gries_offline(exact.frequencies(stream.filter(part == p)), 300) for p in (0, 1)]
    return counters.merge_misra_gries(halves[0].unionByName(halves[1]), 300)


# Arrivals one by one, as recursive SQL: a step for each row, the summary as a list.
HOSTS = "s AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS key, page_id % 7 AS weight, page_id AS ord FROM pages WHERE url IS NOT NULL AND page_id IS NOT NULL)"
_SIZE, _WINDOW, _POOL_SHARE = 12, 40, 0.03
_FIELDS = {"mg": "STRUCT(k VARCHAR, e BIGINT)", "ss": "STRUCT(c BIGINT, k VARCHAR, e BIGINT)", "lc": "STRUCT(k VARCHAR, c BIGINT, e BIGINT)"}
_HAS, _LEAST = "len(list_filter(st, lambda x: x.k = key)) > 0", "list_min(list_transform(st, lambda x: x.e))"
_STEPS = {
    "mg": f"""CASE WHEN weight = 0 THEN st WHEN {_HAS} THEN list_transform(st, lambda x: {{'k': x.k, 'e': x.e + CASE WHEN x.k = key THEN weight ELSE 0 END}})
 WHEN len(st) < {_SIZE} THEN list_append(st, {{'k': key, 'e': weight}})
 ELSE list_concat(list_filter(list_transform(st, lambda x: {{'k': x.k, 'e': x.e - least(weight, {_LEAST})}}), lambda x: x.e > 0), CASE WHEN weight > {_LEAST} THEN [{{'k': key, 'e': weight - {_LEAST}}}] ELSE [] END) END""",
    "ss": f"""CASE WHEN weight = 0 THEN st WHEN {_HAS} THEN list_transform(st, lambda x: {{'c': x.c + CASE WHEN x.k = key THEN weight ELSE 0 END, 'k': x.k, 'e': x.e}})
 WHEN len(st) < {_SIZE} THEN list_append(st, {{'c': weight, 'k': key, 'e': 0::BIGINT}})
 ELSE list_append(list_sort(st)[2:], {{'c': list_sort(st)[1].c + weight, 'k': key, 'e': list_sort(st)[1].c}}) END""",
    "lc": f"""CASE WHEN weight = 0 THEN st ELSE list_filter(CASE WHEN {_HAS} THEN list_transform(st, lambda x: {{'k': x.k, 'c': x.c + CASE WHEN x.k = key THEN weight ELSE 0 END, 'e': x.e}})
 ELSE list_append(st, {{'k': key, 'c': weight, 'e': n // {_WINDOW}}}) END, lambda x: (n + weight) // {_WINDOW} = n // {_WINDOW} OR x.c + x.e > (n + weight) // {_WINDOW}) END""",
}


def _fold_sql(kind: str) -> str:
    """``fd`` (i, key, n, st): the summary after each arrival."""
    empty = f"[]::{_FIELDS[kind]}[]"
    return f"""{HOSTS}, od AS (SELECT key, weight::BIGINT AS weight, row_number() OVER (ORDER BY ord, key) AS i FROM s),
fd AS (SELECT 0::BIGINT AS i, ''::VARCHAR AS key, 0::BIGINT AS n, {empty} AS st UNION ALL
 SELECT i, key, n + weight, ({_STEPS[kind]})::{_FIELDS[kind]}[] FROM (SELECT od.i, od.key, od.weight, fd.n, fd.st FROM fd JOIN od ON od.i = fd.i + 1))"""


def _entries(kind: str, fields: str) -> str:
    return f"WITH RECURSIVE {_fold_sql(kind)}, en AS (SELECT unnest(st) AS x FROM (SELECT st FROM fd ORDER BY i DESC LIMIT 1)) SELECT {fields} FROM en"


@query(_entries("mg", "x.k AS key, x.e AS estimate"))
def mg_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Misra-Gries of arrivals one by one: its own counters."""
    return counters.misra_gries(streams.page_hosts(spark, folder), _SIZE, 1).select("key", "estimate")


@query(_entries("ss", "x.k AS key, x.c AS estimate, x.e AS error, x.c - x.e AS guaranteed, x.c AS upper"))
def ss_fold(spark: SparkSession, folder: str) -> DataFrame:
    rows = counters.space_saving(streams.page_hosts(spark, folder), _SIZE, 1).select("key", "estimate", "error")
    return counters.with_bounds(rows, "space_saving")


@query(_entries("lc", "x.k AS key, x.c AS estimate, x.e AS error, x.c AS guaranteed, x.c + x.e AS upper"))
def lc_fold(spark: SparkSession, folder: str) -> DataFrame:
    rows = counters.lossy_counting(streams.page_hosts(spark, folder), _WINDOW, 1).select("key", "estimate", "error")
    return counters.with_bounds(rows, "lossy_counting")


def _pool_sql(kind: str, estimate: str) -> str:
    return f"""SELECT '{kind}' AS summary, key FROM (WITH RECURSIVE {_fold_sql(kind)}
SELECT DISTINCT key FROM fd WHERE i > 0 AND coalesce(list_filter(st, lambda x: x.k = key)[1].{estimate}, 0) >= {_POOL_SHARE}::DOUBLE * n)"""


@query(" UNION ALL ".join(_pool_sql(k, e) for k, e in (("mg", "e"), ("ss", "c"), ("lc", "c"))))
def counter_candidate_pools(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that a counter summary found heavy when they arrived."""
    hosts = streams.page_hosts(spark, folder)
    kinds = {"mg": lambda: counters.MisraGries(_SIZE), "ss": lambda: counters.SpaceSaving(_SIZE), "lc": lambda: counters.LossyCounting(_WINDOW)}
    found = [counters.arrival_pool(hosts, make, _POOL_SHARE).select(F.lit(name).alias("summary"), "key") for name, make in kinds.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


_EPSILON = PHI / 4


@query(
    f"""WITH {WORDS}, {COUNT} SELECT unnest(['misra_gries', 'space_saving', 'lossy_counting']) AS summary, n, 0::BIGINT AS above, 0::BIGINT AS below, 0::BIGINT AS missed, TRUE AS bounded FROM n"""
)
def fold_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """What folds of the partitions promise, held against exact weights: keys whose weight
    lies above or below their bounds, keys without an entry that weigh more than epsilon * n,
    and whether no part has more entries than its memory allows."""
    stream, counted = streams.document_words(spark, folder), _words(spark, folder)
    mg = counters.misra_gries(stream, sizing.misra_gries_capacity(_EPSILON))
    ss = counters.space_saving(stream, sizing.space_saving_capacity(_EPSILON))
    lc = counters.lossy_counting(stream, sizing.lossy_window(_EPSILON))
    lost = mg.select("part", "floor").distinct().agg(F.coalesce(F.sum("floor"), F.lit(0)).alias("error"))
    entries = {
        "misra_gries": (mg, counters.added(mg).crossJoin(F.broadcast(lost)), sizing.misra_gries_capacity(_EPSILON)),  # one row
        "space_saving": (ss, counters.merge_upper(ss), sizing.space_saving_capacity(_EPSILON)),
        "lossy_counting": (lc, counters.merge_lossy(lc).drop("upper"), None),
    }
    out = []
    for name, (parts, found, most) in entries.items():
        held = counters.with_bounds(found, name).join(counted, "key", "full_outer")
        off = exact.with_total(held, counted).agg(
            F.max("n").alias("n"),
            F.coalesce(F.sum((F.col("total") > F.col("upper")).cast("long")), F.lit(0)).alias("above"),
            F.coalesce(F.sum((F.col("total") < F.col("guaranteed")).cast("long")), F.lit(0)).alias("below"),
            F.coalesce(F.sum((F.col("upper").isNull() & (F.col("total") > F.lit(_EPSILON) * F.col("n"))).cast("long")), F.lit(0)).alias("missed"),
        )
        size = parts.groupBy("part").count().agg(F.coalesce(F.max("count") <= F.lit(most) if most else F.lit(True), F.lit(True)).alias("bounded"))
        out.append(off.crossJoin(F.broadcast(size)).select(F.lit(name).alias("summary"), "n", "above", "below", "missed", "bounded"))  # one row each
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {WORDS}, {COUNT}, {HEAVY} SELECT * FROM hh")
def mg_verified_hh(spark: SparkSession, folder: str) -> DataFrame:
    stream, counted = streams.document_words(spark, folder), _words(spark, folder)
    found = counters.added(counters.misra_gries(stream, sizing.misra_gries_capacity(_EPSILON)))
    return exact.verified(counters.heavy_lower(found, counted, PHI, _EPSILON), counted, PHI)


@query(f"WITH {WORDS}, {COUNT}, {HEAVY} SELECT * FROM hh")
def ss_verified_hh(spark: SparkSession, folder: str) -> DataFrame:
    stream, counted = streams.document_words(spark, folder), _words(spark, folder)
    found = counters.merge_upper(counters.space_saving(stream, sizing.space_saving_capacity(_EPSILON)))
    return exact.verified(counters.heavy_upper(found, counted, PHI), counted, PHI)


@query(f"WITH {WORDS}, {COUNT}, {_lc(2000)} SELECT key, estimate FROM lc")
def lc_preaggregated(spark: SparkSession, folder: str) -> DataFrame:
    stream = streams.document_words(spark, folder)
    once = stream.groupBy("key").agg(F.min("ord").alias("ord"), F.sum("weight").alias("weight"))
    return counters.lossy_counting_unique(once, 2000, 20)


@query(f"WITH {WORDS}, {COUNT}, {HEAVY} SELECT * FROM hh")
def lc_verified_hh(spark: SparkSession, folder: str) -> DataFrame:
    stream, counted = streams.document_words(spark, folder), _words(spark, folder)
    found = counters.added(counters.lossy_counting(stream, sizing.lossy_window(_EPSILON)))
    return exact.verified(counters.heavy_lower(found, counted, PHI, _EPSILON), counted, PHI)


_KINDS = {"misra_gries": 56, "space_saving": 80, "lossy_counting": 72, "concise": 56, "reservoir": 56}


@query(
    f"""WITH {WORDS}, {COUNT}, {_mg(500)}, {_ss(500)}, {_lc(2000)}, {_units((42,), 500)}, {_concise(500)}, {_reservoir(500)}
{" UNION ALL ".join(f"SELECT '{k}' AS summary, count(*) AS entries, ({4000 if k == 'reservoir' else 0} + coalesce(sum({_KINDS[k]} + 2 * length(key)), 0))::BIGINT AS bytes FROM {r}" for k, r in zip(_KINDS, ("mg", "ss", "lc", "cs", "rs"), strict=True))}"""
)
def summary_memory(spark: SparkSession, folder: str) -> DataFrame:
    """Entries and bytes of each summary that holds keys."""
    counted = _words(spark, folder)
    once = streams.document_words(spark, folder).groupBy("key").agg(F.min("ord").alias("ord"), F.sum("weight").alias("weight"))
    kept = {
        "misra_gries": counters.misra_gries_offline(counted, 500),
        "space_saving": counters.space_saving_offline(counted, 500),
        "lossy_counting": counters.lossy_counting_unique(once, 2000, 20),
        "concise": sampling.concise(counted, 500),
        "reservoir": sampling.reservoir(counted, 500),
    }
    out = [counters.memory_bytes(rows, kind, 500 if kind == "reservoir" else 0).withColumn("summary", F.lit(kind)) for kind, rows in kept.items()]
    return reduce(DataFrame.unionByName, out).select("summary", "entries", "bytes")


# --- samples ------------------------------------------------------------------------------------


@query(f"WITH {WORDS}, {COUNT}, {_units((42,), 4096)}, {_concise(4096)} SELECT key, sample_count, t FROM cs")
def concise_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.concise(_words(spark, folder), 4096).select("key", "sample_count", "t")


@query(f"WITH {TYPED}, {COUNT}, {_units((42,), 8192)}, {_concise(8192)} SELECT key, sample_count * t AS estimate FROM cs, n WHERE sample_count * t >= ceil({PHI}::DOUBLE * n.n)::BIGINT")
def concise_estimates(spark: SparkSession, folder: str) -> DataFrame:
    counted = exact.frequencies(streams.typed_users(spark, folder))
    found = sampling.concise_estimates(sampling.concise(counted, 8192))
    return sampling.heavy(found, counted, PHI).select("key", "estimate")


@query(f"WITH {WORDS}, {COUNT}, {_units((42,), 2000)}, {_reservoir(2000)} SELECT key, sample_count, m FROM re")
def reservoir_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.reservoir(_words(spark, folder), 2000).select("key", "sample_count", "m")


@query(f"WITH {SUPPLIERS}, {COUNT}, {_units((42,), 4096)}, {_reservoir(4096)} SELECT key, estimate FROM re")
def reservoir_estimates(spark: SparkSession, folder: str) -> DataFrame:
    counted = exact.frequencies(streams.suppliers(spark, folder))
    return sampling.reservoir_estimates(sampling.reservoir(counted, 4096), counted).select("key", "estimate")


@query(f"WITH {WORDS}, {COUNT}, {_units(sampling.SEEDS, 2048)}, {_concise(2048)} SELECT key, estimate FROM ca")
def seed_averaged_estimates(spark: SparkSession, folder: str) -> DataFrame:
    sample = sampling.concise(_words(spark, folder), 2048, sampling.SEEDS)
    return sampling.averaged(sampling.concise_estimates(sample), len(sampling.SEEDS)).select("key", "estimate")


_HUGE = 1_000_000_000


@query(
    f"""WITH {SUPPLIERS}, f AS (SELECT key, sum(weight * {_HUGE})::BIGINT AS total FROM s GROUP BY key), n AS (SELECT coalesce(sum(total), 0)::BIGINT AS n FROM f), {_units((42,), 1024)}, {_concise(1024)}, {_reservoir(1024)}
SELECT 'concise' AS sample, key, sample_count, sample_count * t AS estimate FROM cs UNION ALL SELECT 'reservoir', key, sample_count, estimate FROM re"""
)
def heavy_weight_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of a stream of some 10**15 units."""
    counted = exact.frequencies(streams.suppliers(spark, folder).withColumn("weight", F.col("weight") * _HUGE))
    concise = sampling.concise(counted, 1024).select(F.lit("concise").alias("sample"), "key", "sample_count", (F.col("sample_count") * F.col("t")).alias("estimate"))
    drawn = sampling.reservoir(counted, 1024)
    estimates = sampling.reservoir_estimates(drawn, counted).select("key", "estimate")
    return concise.unionByName(drawn.join(estimates, "key").select(F.lit("reservoir").alias("sample"), "key", "sample_count", "estimate"))


# --- experiments ----------------------------------------------------------------------------------


def _hashed(rows: int) -> str:
    """``hk``: the hashes of each key and row, taken once for all grids."""
    text = "r || ':' || key"
    return f"""hk AS MATERIALIZED (SELECT key, total, r, {_hash("d", 1).replace("md5(d)", "d")} AS hi, 1 - 2 * ({_hash("d", 17).replace("md5(d)", "d")} & 1) AS sgn
 FROM (SELECT key, total, r, md5({text}) AS d FROM f, (SELECT unnest(range({rows})) AS r)))"""


def _grid_parts(kb: int) -> str:
    """Estimates ``em<kb>`` of Count-Min and ``ek<kb>`` of Count-Sketch at a tier."""
    low, sketch = sizing.count_min_for(kb), sizing.count_sketch_for(kb)
    return f"""pm{kb} AS (SELECT key, total, r, hi % {low.width} AS b FROM hk WHERE r < {low.rows}), cm{kb} AS (SELECT r, b, sum(total)::BIGINT AS cell FROM pm{kb} GROUP BY r, b),
em{kb} AS (SELECT key, min(cell)::BIGINT AS estimate FROM pm{kb} JOIN cm{kb} USING (r, b) GROUP BY key),
pk{kb} AS (SELECT key, total, r, sgn, hi % {sketch.width} AS b FROM hk WHERE r < {sketch.rows}), ck{kb} AS (SELECT r, b, sum(total * sgn)::BIGINT AS cell FROM pk{kb} GROUP BY r, b),
ek{kb} AS (SELECT key, (list_sort(list(sgn * cell))[{sketch.rows // 2 + 1}])::BIGINT AS estimate FROM pk{kb} JOIN ck{kb} USING (r, b) GROUP BY key)"""


def _tier_parts(tiers: tuple[int, ...]) -> tuple[str, list[tuple[str, int, str, float]]]:
    """CTEs of all algorithms but AMS at some tiers; (algorithm, KB, relation, epsilon)."""
    ctes = [_hashed(max(sizing.COUNT_MIN_ROWS, sizing.COUNT_SKETCH_ROWS)), _units(sampling.SEEDS, max(map(sizing.sample_for, tiers)))]
    rows = []
    for kb in tiers:
        capacity, mg = sizing.misra_gries_for(kb)
        window, lc = sizing.lossy_for(kb)
        size = sizing.sample_for(kb)
        ctes += [_grid_parts(kb), _mg(capacity, f"{kb}"), _ss(sizing.space_saving_for(kb)[0], f"{kb}"), _lc(window, f"{kb}"), _concise(size, f"{kb}"), _reservoir(size, f"{kb}")]
        relations = ("em", "ek", "mg", "ss", "lc", "ca", "ra")
        epsilons = {"misra_gries": mg, "lossy_counting": lc}
        rows += [(name, kb, f"{r}{kb}", epsilons.get(name, 0.0)) for name, r in zip(experiments.ALL_BUT_AMS, relations, strict=True)]
    return ", ".join(ctes), rows


#: Share that makes a key heavy in the sweeps.
_SWEPT = sizing.PHI


def _sweep_sql(lowered: bool) -> str:
    ctes, rows = _tier_parts(sizing.TIERS_KB)
    parts = []
    for name, kb, relation, epsilon in rows:
        limit = f"ceil({_SWEPT!r}::DOUBLE * n.n)::BIGINT"
        if lowered and epsilon:
            limit = f"greatest(1, ceil(greatest(0.0::DOUBLE, {_SWEPT!r}::DOUBLE - {epsilon!r}::DOUBLE) * n.n)::BIGINT)"
        parts.append(f"SELECT '{name}' AS algorithm, {kb} AS memory_kb, key, estimate FROM {relation}, n WHERE estimate >= {limit}")
    return f"""WITH {WORDS}, {COUNT}, {HEAVY.replace(f"{PHI}::DOUBLE", f"{_SWEPT!r}::DOUBLE")}, {ctes},
rep AS ({" UNION ALL ".join(parts)}) {_quality("rep", "hh", "algorithm, memory_kb,")}"""


@query(_sweep_sql(True))
def memory_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return experiments.memory_sweep(streams.document_words(spark, folder))


@query(_sweep_sql(False))
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return experiments.threshold_sweep(streams.document_words(spark, folder))


_OWN_AMS, _OWN_GATE = Grid(3, 32), Grid(3, 4096)
_OWN = {"count_min": "e", "count_sketch": "eo", "misra_gries": "mg", "space_saving": "ss", "lossy_counting": "lc", "concise": "ca", "reservoir": "ra", "ams": "gt"}


def _own_sql() -> str:
    capacity, window = sizing.misra_gries_capacity(_EPSILON), sizing.lossy_window(_EPSILON)
    heavy = f"ceil({PHI}::DOUBLE * n.n)::BIGINT"
    lower = f"greatest(1, ceil(greatest(0.0::DOUBLE, {PHI - _EPSILON!r}::DOUBLE) * n.n)::BIGINT)"
    parts = [f"SELECT '{name}' AS algorithm, key, estimate FROM {r}, n WHERE estimate >= {lower if name in ('misra_gries', 'lossy_counting') else heavy}" for name, r in _OWN.items()]
    return f"""WITH {WORDS}, {COUNT}, {HEAVY}, {_cms(CMS)}, {_sketch(SKETCH, "o")}, {_mg(capacity)}, {_ss(sizing.space_saving_capacity(_EPSILON))}, {_lc(window)},
{_units(sampling.SEEDS, 4096)}, {_concise(4096)}, {_reservoir(4096)}, {_cms(_OWN_GATE, "g")}, {_ams(_OWN_AMS, _OWN_AMS.width)},
gt AS (SELECT key, ae.estimate FROM ae JOIN eg USING (key), n WHERE eg.estimate >= {heavy}),
rep AS ({" UNION ALL ".join(parts)}) {_quality("rep", "hh", "algorithm,")}"""


@query(_own_sql())
def baseline_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Each algorithm with parameters of its own against the exact heavy hitters."""
    stream, counted = streams.document_words(spark, folder), experiments.reused(_words(spark, folder))
    once = stream.groupBy("key").agg(F.min("ord").alias("ord"), F.sum("weight").alias("weight"))
    seeds = len(sampling.SEEDS)
    found = {
        "count_min": linear.heavy(linear.count_min_estimates(counted, linear.count_min(counted, CMS), CMS), counted, PHI),
        "count_sketch": linear.heavy(linear.count_sketch_estimates(counted, linear.count_sketch(counted, SKETCH), SKETCH), counted, PHI),
        "misra_gries": counters.heavy_lower(counters.misra_gries_offline(counted, sizing.misra_gries_capacity(_EPSILON)), counted, PHI, _EPSILON),
        "space_saving": counters.heavy_upper(counters.space_saving_offline(counted, sizing.space_saving_capacity(_EPSILON)), counted, PHI),
        "lossy_counting": counters.heavy_lower(counters.lossy_counting_unique(once, sizing.lossy_window(_EPSILON), 20), counted, PHI, _EPSILON),
        "concise": sampling.heavy(sampling.averaged(sampling.concise_estimates(sampling.concise(counted, 4096, sampling.SEEDS)), seeds), counted, PHI),
        "reservoir": sampling.heavy(sampling.averaged(sampling.reservoir_estimates(sampling.reservoir(counted, 4096, sampling.SEEDS), counted), seeds), counted, PHI),
        "ams": linear.gated_ams(counted, _OWN_GATE, _OWN_AMS, PHI),
    }
    reported = reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("algorithm"), "key", "estimate") for name, rows in found.items()])
    return metrics.set_quality(reported, exact.heavy_hitters(counted, PHI), ["algorithm"])


@query(f"WITH {WORDS}, {COUNT}, {HEAVY}, {_cms(CMS)}, rep AS (SELECT key, estimate FROM e, n WHERE estimate >= ceil({PHI}::DOUBLE * n.n)::BIGINT) {_quality('rep', 'hh')}")
def hh_quality(spark: SparkSession, folder: str) -> DataFrame:
    counted = _words(spark, folder)
    found = linear.heavy(linear.count_min_estimates(counted, linear.count_min(counted, CMS), CMS), counted, PHI)
    return metrics.set_quality(found, exact.heavy_hitters(counted, PHI))


_VARIANTS = {f"zipf{synthetic.tag(x)}": x for x in synthetic.EXPONENTS}
_ZIPF = (synthetic.KEYS, synthetic.TOTAL, synthetic.KEPT)
_TOP_KB, _TOP = 1024, 100


def _zipf_sql(exponent: float) -> str:
    keys, total, top = _ZIPF
    share = f"round({total}.0::DOUBLE / (pow(i::DOUBLE, {exponent}::DOUBLE) * h))"
    return f"""s AS (SELECT 'synth_' || i AS key, {share}::BIGINT AS weight, i AS ord FROM range(1, {top + 1}) r(i),
 (SELECT sum(pow(j::DOUBLE, -{exponent}::DOUBLE)) AS h FROM range(1, {keys + 1}) q(j)) WHERE {share} > 0)"""


def _topk_sql(kb: int, k: int) -> str:
    out = []
    for name, source in [*((n, _zipf_sql(s)) for n, s in _VARIANTS.items()), ("words", WORDS)]:
        ctes, rows = _tier_parts((kb,))
        best = " UNION ALL ".join(f"(SELECT '{a}' AS algorithm, key, estimate FROM (SELECT * FROM {r} ORDER BY estimate DESC, key LIMIT {k}) WHERE estimate > 0)" for a, _, r, _ in rows)
        quality = _quality("rep", "hh", "algorithm,")
        out.append(f"SELECT *, '{name}' AS variant FROM (WITH {source}, {COUNT}, hh AS (SELECT key, total FROM f ORDER BY total DESC, key LIMIT {k}), {ctes}, rep AS ({best}) {quality})")
    return f"""SELECT algorithm, variant, reported_count AS top_k, true_count AS true_k, tp AS overlap, precision_pct, recall_pct, f1_pct, mean_rel_error_pct, max_rel_error_pct
FROM ({" UNION ALL ".join(out)})"""


def _variants(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    made = {name: synthetic.zipf_stream(spark, s, *_ZIPF) for name, s in _VARIANTS.items()}
    return made | {"words": streams.document_words(spark, folder)}


@query(_topk_sql(_TOP_KB, _TOP))
def topk_quality(spark: SparkSession, folder: str) -> DataFrame:
    return experiments.topk_quality(_variants(spark, folder), _TOP, _TOP_KB)


@query(
    f"""WITH q AS ({_topk_sql(_TOP_KB, _TOP)}) SELECT algorithm, round(min(f1_pct) FILTER (variant <> 'words'), 6) AS min_f1_pct, round(avg(f1_pct) FILTER (variant <> 'words'), 6) AS mean_f1_pct,
 round(max(f1_pct) FILTER (variant <> 'words') - min(f1_pct) FILTER (variant <> 'words'), 6) AS f1_spread_pct, round(stddev_pop(f1_pct) FILTER (variant <> 'words'), 4) AS f1_std_pct,
 round(max(max_rel_error_pct) FILTER (variant <> 'words'), 6) AS max_rel_error_pct, round(max(f1_pct) FILTER (variant = 'words'), 6) AS real_f1_pct FROM q GROUP BY algorithm"""
)
def robustness_summary(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.robustness(topk_quality(spark, folder), "words")


_PARTITIONS = (1, 2, 4, 8, 16)


def _partition_sql(kb: int, k: int) -> str:
    grids = {"count_min": (sizing.count_min_for(kb), "total", "min(coalesce(cell, 0))"), "count_sketch": (sizing.count_sketch_for(kb), "total * sgn", "list_sort(list(coalesce(cell, 0) * sgn))[len(list(r)) // 2 + 1]")}
    ctes, parts = [], []
    for name, (grid, value, score) in grids.items():
        ctes.append(_places(grid, "best", name))
        for p in _PARTITIONS:
            tag = f"{name}{p}"
            ctes.append(f"q{tag} AS (SELECT {_SPLIT_PART} % {p} AS part, key, sum(weight)::BIGINT AS total FROM s GROUP BY ALL)")
            ctes.append(_places(grid, f"q{tag}", f"_{tag}"))
            ctes.append(f"c{tag} AS (SELECT r, b, sum(cell)::BIGINT AS cell FROM (SELECT part, r, b, sum({value}) AS cell FROM p_{tag} GROUP BY part, r, b) GROUP BY r, b)")
            parts.append(f"SELECT '{name}' AS algorithm, {p} AS partitions, key, ({score})::BIGINT AS estimate FROM p{name} LEFT JOIN c{tag} USING (r, b) GROUP BY key")
    return f"""WITH {WORDS}, {COUNT}, best AS (SELECT key, total FROM f ORDER BY total DESC, key LIMIT {k}), {", ".join(ctes)}, e AS ({" UNION ALL ".join(parts)})
SELECT e.algorithm, e.partitions, count(*) FILTER (e.estimate > 0) AS captured, round(avg(100.0::DOUBLE * abs(e.estimate - total)::DOUBLE / total), 6) AS mean_rel_error_pct,
 round(max(100.0::DOUBLE * abs(e.estimate - total)::DOUBLE / total), 6) AS max_rel_error_pct, max(abs(e.estimate - o.estimate))::BIGINT AS max_abs_diff
FROM e JOIN best USING (key) JOIN (SELECT * FROM e WHERE partitions = 1) o ON o.algorithm = e.algorithm AND o.key = e.key GROUP BY ALL"""


@query(_partition_sql(64, 100))
def partition_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return experiments.partition_sweep(streams.document_words(spark, folder), _PARTITIONS, 64)


def _counter_partition_sql(kb: int, k: int) -> str:
    capacity = sizing.misra_gries_for(kb)[0]
    cut = "total - coalesce(max(CASE WHEN place = {0} THEN total END) OVER (PARTITION BY {1}), 0)"
    place = "row_number() OVER (PARTITION BY {0} ORDER BY total DESC, key) AS place"
    local, whole = "p, part", "p"
    return f"""WITH {WORDS}, {COUNT}, best AS (SELECT key, total FROM f ORDER BY total DESC, key LIMIT {k}),
q AS (SELECT p, {_hash("'part' || ':' || ord", 1)} % p AS part, key, sum(weight)::BIGINT AS total FROM s, (SELECT unnest([{", ".join(map(str, _PARTITIONS))}]) AS p) GROUP BY ALL),
q2 AS (SELECT *, {cut.format(capacity + 1, local)} AS estimate FROM (SELECT *, {place.format(local)} FROM q)),
m AS (SELECT p, key, sum(estimate)::BIGINT AS total FROM q2 WHERE place <= {capacity + 1} AND estimate > 0 GROUP BY p, key),
m2 AS (SELECT *, {cut.format(capacity + 1, whole)} AS left_ FROM (SELECT *, {place.format(whole)} FROM m)),
e AS (SELECT a.p AS partitions, best.key, best.total, coalesce(m2.left_, 0)::BIGINT AS estimate FROM best CROSS JOIN (SELECT unnest([{", ".join(map(str, _PARTITIONS))}]) AS p) a
 LEFT JOIN m2 ON m2.p = a.p AND m2.key = best.key AND m2.left_ > 0)
SELECT 'misra_gries' AS algorithm, e.partitions, count(*) FILTER (e.estimate > 0) AS captured, round(avg(100.0::DOUBLE * abs(e.estimate - e.total)::DOUBLE / e.total), 6) AS mean_rel_error_pct,
 round(max(100.0::DOUBLE * abs(e.estimate - e.total)::DOUBLE / e.total), 6) AS max_rel_error_pct, max(abs(e.estimate - o.estimate))::BIGINT AS max_abs_diff
FROM e JOIN (SELECT key, estimate FROM e WHERE partitions = 1) o USING (key) GROUP BY e.partitions"""


@query(_counter_partition_sql(64, 100))
def counter_partition_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return experiments.counter_partition_sweep(streams.document_words(spark, folder), _PARTITIONS, 64)


@query(
    f"""WITH {TYPED}, {COUNT}, {HEAVY}, {", ".join(_ss(sizing.space_saving_for(kb)[0], str(kb)) for kb in (16, 64, 256))},
rep AS ({" UNION ALL ".join(f"SELECT 'space_saving' AS algorithm, {kb} AS memory_kb, key, estimate FROM ss{kb}, n WHERE estimate >= ceil({PHI}::DOUBLE * n.n)::BIGINT" for kb in (16, 64, 256))}) {_quality("rep", "hh", "algorithm, memory_kb,")}"""
)
def ss_memory_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return experiments.memory_sweep(streams.typed_users(spark, folder), (16, 64, 256), PHI, ("space_saving",))


@query(
    f"""WITH {SUPPLIERS}, {COUNT}, hh AS (SELECT key, total FROM f, n WHERE total >= ceil(0.01::DOUBLE * n.n)::BIGINT), {_units(sampling.SEEDS, 2048)}, {_reservoir(2048)},
rep AS (SELECT 'reservoir' AS algorithm, 256 AS memory_kb, key, estimate FROM ra, n WHERE estimate >= ceil(0.01::DOUBLE * n.n)::BIGINT) {_quality("rep", "hh", "algorithm, memory_kb,")}"""
)
def reservoir_memory_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return experiments.memory_sweep(streams.suppliers(spark, folder), (256,), 0.01, ("reservoir",))


_AMS_KB = 4


def _gated_sql(kb: int) -> str:
    gate, grid = sizing.gated_ams_for(kb)
    return f"{_cms(gate)}, {_ams(grid, grid.width)}"


@query(
    f"""WITH {USERS}, {COUNT}, hh AS (SELECT key, total FROM f, n WHERE total >= ceil(0.006::DOUBLE * n.n)::BIGINT), {_gated_sql(_AMS_KB)}, rep AS (
SELECT 'ams' AS algorithm, {_AMS_KB} AS memory_kb, key, ae.estimate FROM ae JOIN e USING (key), n WHERE e.estimate >= ceil(0.006::DOUBLE * n.n)::BIGINT AND ae.estimate >= ceil(0.006::DOUBLE * n.n)::BIGINT)
{_quality("rep", "hh", "algorithm, memory_kb,")}"""
)
def ams_memory_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return experiments.memory_sweep(streams.users(spark, folder), (_AMS_KB,), 0.006, ("ams",))


@query()
def ams_batched_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return experiments.memory_sweep(streams.users(spark, folder), (16, 64), 0.006, ("ams_batched",))
