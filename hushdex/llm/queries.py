"""Queries over the corpus tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hushdex.llm import bpe, fmindex, jpeg, langid, lmscore, nearjoin, pii, tokenbin, toxicity, urlfilter
from hushdex.llm.common import read_table


def op1_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(read_table(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_roundtrip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.stored_text_features(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op6_nearjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.lm_scores(read_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_urlfilter, op2_bpe, op3_tokenbin, op4_jpeg, op5_toxicity, op6_nearjoin, op7_lmscore, op8_decontamination, op9_pii, op10_langid)
    return {f.__name__: f for f in made}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(x: str) -> str:
    """Lower-cased runs of digits, letters and non-ASCII characters."""
    return rf"regexp_extract_all(translate(coalesce({x}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _op1_sql() -> str:
    rules = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in urlfilter.RULES)
    blocked = ", ".join(f"('{h}')" for h in urlfilter.BLOCKED_HOSTS)
    return rf"""
WITH a AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(rhost, rpath, verdict) AS (VALUES {rules}),
b(bhost) AS (VALUES {blocked}),
fit AS (SELECT n, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, rhost || rpath) AS k
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
listed AS (SELECT DISTINCT n FROM u JOIN b ON host = bhost OR ends_with(host, '.' || bhost))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed.n IS NULL THEN 'allow' ELSE 'block' END) AS verdict, listed.n IS NOT NULL AS listed
FROM u LEFT JOIN fit ON u.n = fit.n AND k = 1 LEFT JOIN listed ON u.n = listed.n"""


def _op6_sql() -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
c AS (SELECT array_to_string(w, ' ') AS key, any_value(w) AS w, count(*) AS n_copies, min(doc_id) AS rep FROM d WHERE len(w) > 0 GROUP BY 1),
s AS (SELECT rep, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g FROM c),
z AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN z a ON a.rep = x JOIN z b ON b.rep = y WHERE o >= 0.8 * (a.n + b.n - o)),
reach(x, y) AS (SELECT rep, rep FROM c UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
top AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies
FROM d LEFT JOIN c ON len(d.w) > 0 AND key = array_to_string(d.w, ' ') LEFT JOIN top ON top.x = rep LEFT JOIN k ON k.x = rep"""


def _op8_sql() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_words("text")} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_words("text")} AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(10, len(w)) AS m, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda k: array_to_string(w[k:k + least(10, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
m AS (SELECT DISTINCT m FROM q),
v AS (SELECT n, m, unnest(range(1, len(w) - m + 2)) AS k, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS g FROM d, m WHERE len(w) >= m),
o AS (SELECT n, v.m AS m, k, item FROM v JOIN q ON v.m = q.m AND v.g = q.g),
h AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT n, m, k FROM o)) GROUP BY n),
t AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item FROM o) GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (n) LEFT JOIN t USING (n)"""


def _crc32(x: str) -> str:
    """crc32 of an ASCII text; _CRC_TABLE is joined, its column is t."""
    return f"CASE WHEN {x} = '' THEN 0 ELSE xor(list_reduce(list_transform(string_split({x}, ''), lambda z: CAST(unicode(z) AS BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) END"


_CRC_TABLE = "crc AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce(range(0, 8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k) AS v FROM range(256) r(k)))"


def _op10_sql() -> str:
    top, own = langid.LANG_TOP, langid.DOC_TOP
    code = lambda w, i: f"CASE WHEN {i} BETWEEN 1 AND length({w}) THEN CAST(unicode(substr({w}, {i}, 1)) AS BIGINT) ELSE 0 END"
    return f"""
WITH {_CRC_TABLE},
a AS (SELECT row_number() OVER () AS n, doc_id, lang, coalesce(CAST(doc_id AS VARCHAR), '') AS id, regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+') AS ws FROM documents),
d AS (SELECT n, doc_id, lang, ws, ({_crc32("id")}) % 4 = 2 AS held_out FROM a, crc),
w AS (SELECT n, w, count(*) AS many FROM (SELECT n, unnest(ws) AS w FROM d) GROUP BY n, w),
p AS (SELECT n, w, many, unnest(range(0, length(w) + 1)) AS i FROM w),
c AS (SELECT n, many, i, {code("w", "i")} AS x, {code("w", "i + 1")} AS y, {code("w", "i + 2")} AS z FROM p),
g AS (SELECT n, sum(many) AS many, code FROM (
  SELECT n, many, -(CAST(1 AS BIGINT) << 50) - x AS code FROM c WHERE i > 0
  UNION ALL SELECT n, many, -1 - ((x << 21) | y) FROM c
  UNION ALL SELECT n, many, (x << 42) | (y << 21) | z FROM c WHERE y > 0) GROUP BY n, code),
l AS (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY sum(many) DESC, code) - 1 AS r FROM g JOIN d USING (n) WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, code QUALIFY r < {top}),
m AS (SELECT n, code, row_number() OVER (PARTITION BY n ORDER BY many DESC, code) - 1 AS r FROM g QUALIFY r < {own}),
s AS (SELECT n, count(*) AS size FROM m GROUP BY n),
f AS (SELECT n, lang, sum(abs(l.r - m.r) - {top}) AS gain FROM m JOIN l USING (code) GROUP BY n, lang),
o AS (SELECT s.n, k.lang, {top} * size + coalesce(gain, 0) AS far FROM s CROSS JOIN (SELECT DISTINCT lang FROM l) k LEFT JOIN f ON f.n = s.n AND f.lang = k.lang),
b AS (SELECT n, arg_min(lang, (far, lang)) AS lang_pred, list(CAST(far AS DOUBLE) ORDER BY far)[1:2] AS two FROM o GROUP BY n)
SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, CASE WHEN lang_pred IS NULL THEN 0.0 WHEN len(two) < 2 THEN 1.0 WHEN two[2] = 0 THEN 0.5 ELSE two[2] / (two[2] + two[1]) END AS score
FROM d LEFT JOIN b USING (n)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it expresses."""
    return {"op1_urlfilter": _op1_sql(), "op6_nearjoin": _op6_sql(), "op8_decontamination": _op8_sql(), "op10_langid": _op10_sql()}
