"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushdex.functions import blind, extract, tokens
from hushdex.operators import search as ops
from hushdex.operators.engine import Engine

#: Key of queries that show hashes, so that SQL can follow.
TEST_KEY = bytes(range(32))
WORDS_QUERY = "The thing, of that and RE this"
TRIGRAM_QUERY = "thering nation"
SHORT_QUERY = "is an of"
TIES_QUERY = "the"
TOP = 100

Query = Callable[[SparkSession, str], DataFrame]

_engines: dict[tuple[str, str], Engine] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index_root(spark: SparkSession) -> str:
    """A fresh folder that all machines see: below spark.checkpoint.dir. Only a session
    on a single machine may do without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{shared.rstrip('/') if shared else 'file://' + tempfile.gettempdir()}/hushdex-index-{uuid.uuid4().hex}"


def fresh_engine(spark: SparkSession) -> Engine:
    e = Engine(spark, index_root(spark))
    forget_at_exit(e)
    return e


def forget_at_exit(e: Engine) -> None:
    """Remove an engine's folder when the driver ends."""
    atexit.register(_forget, e)


def _forget(e: Engine) -> None:
    if e.spark.sparkContext._jsc is not None:
        e.store._drop(e.store.root)


def documents_engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose index ``docs`` holds the documents; made once for a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        e = fresh_engine(spark)
        e.create("docs")
        e.put_frame("docs", read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entry_id"), "text"))
        _engines[key] = e
    return _engines[key]


# -- tokens ----------------------------------------------------------------------


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(tokens.word_tokens(F.col("text")), " ").alias("words"))


def trigram_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(tokens.trigram_tokens(F.col("text")), " ").alias("trigrams"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", F.size(tokens.word_tokens(text)).cast("bigint").alias("words"), F.size(tokens.trigram_tokens(text)).cast("bigint").alias("trigrams"))


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(tokens.word_tokens(F.col("url")), " ").alias("words"))


def _blind_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.lit("parts").alias("index"))
    return blind.blinded(rows, tokens.token_set(F.col("p_name")), blind.key_table(spark, {"parts": TEST_KEY}))


def blind_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blind_parts(spark, sf_dir).select("p_partkey", F.array_join("tokens.words", ",").alias("words"), F.array_join("tokens.trigrams", ",").alias("trigrams"))


def wire_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _blind_parts(spark, sf_dir).select("p_partkey", blind.wire(F.col("tokens")).alias("data"))
    got = sent.select("p_partkey", blind.unwire(F.col("data")).alias("s"))
    return got.select("p_partkey", F.array_join("s.words", ",").alias("words"), F.size("s.trigrams").cast("bigint").alias("trigrams"), blind.well_formed(F.col("s")).alias("ok"))


# -- JSON ------------------------------------------------------------------------


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key")))
    return read(spark, sf_dir, "customer").select("c_custkey", F.encode(doc, "UTF-8").alias("data"))


def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("c_custkey", F.array_join(tokens.word_tokens(extract.extracted(F.col("data"), "segment")), " ").alias("words"))


def json_all_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("c_custkey", F.array_join(tokens.word_tokens(extract.extracted(F.col("data"))), " ").alias("words"))


def json_no_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract.extracted(F.encode("props", "UTF-8"), "k")
    return read(spark, sf_dir, "events").select("event_id", F.size(tokens.word_tokens(text)).cast("bigint").alias("words"))


# -- search ----------------------------------------------------------------------


def _search(query: str, mode: str, limit: int = TOP) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents_engine(spark, sf_dir).search("docs", query, mode, limit=limit).hits

    return run


def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_engine(spark, sf_dir).search("docs", TRIGRAM_QUERY, "fuzzy", limit=0).stats


def search_blind_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A client's blind query with a token sent twice."""
    key = blind.BlindKey(TEST_KEY)
    e = fresh_engine(spark)
    e.create("blind")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("entry_id"), "p_name", F.lit("blind").alias("index"))
    sets = blind.blinded(rows, tokens.token_set(F.col("p_name")), blind.key_table(spark, {"blind": TEST_KEY}))
    e.put_blind_frame("blind", sets.select("entry_id", blind.wire(F.col("tokens")).alias("data")))
    a, b = key.blind(["w:red", "w:widget"], [])[0]
    return e.search("blind", blind.encode_set([a, a, b], []), "contains", limit=TOP, is_blind=True).hits


def _batch(mode: str, limit: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(mode).alias("mode"))
        return documents_engine(spark, sf_dir).search_frame("docs", queries, limit)

    return run


# -- entries ---------------------------------------------------------------------


def _conversations_engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = fresh_engine(spark)
    e.create("talk")
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("entry_id"), "text", "turn")
    e.put_frame("talk", turns, order=F.col("turn"))
    return e


def state(e: Engine, name: str) -> DataFrame:
    m = e.store.load(name)
    return e.store.entries(m).select("entry_id", "version", "words", "trigrams")


def index_info_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = documents_engine(spark, sf_dir)
    e.seed(["empty"])
    return e.catalog().select("name", "entry_count", F.col("tokenizer_version").cast("bigint").alias("tokenizer_version"))


def put_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(_conversations_engine(spark, sf_dir), "talk")


def put_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, then the labelled ones again with their language as text."""
    e = fresh_engine(spark)
    e.create("over")
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entry_id"), "text", "lang")
    e.put_frame("over", docs.select("entry_id", "text"))
    again = docs.join(read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("entry_id")), "entry_id", "left_semi")
    e.put_frame("over", again.select("entry_id", F.col("lang").alias("text")))
    return state(e, "over")


def delete_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts without those of an odd size, then searched."""
    e = fresh_engine(spark)
    e.create("parts")
    parts = read(spark, sf_dir, "part")
    e.put_frame("parts", parts.select(F.col("p_partkey").cast("string").alias("entry_id"), F.col("p_name").alias("text")))
    e.delete_frame("parts", parts.where("p_size % 2 = 1").select(F.col("p_partkey").cast("string").alias("entry_id")))
    return e.search("parts", "red widget ring", "contains", limit=TOP).hits


def reconcile_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents reconciled with the labelled ids, then searched."""
    e = fresh_engine(spark)
    e.create("rec")
    e.put_frame("rec", read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entry_id"), "text"))
    e.reconcile("rec", read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("entry_id")))
    return e.search("rec", WORDS_QUERY, "contains", limit=TOP).hits


def queries() -> dict[str, Query]:
    plain = (word_tokens, trigram_tokens, token_counts, page_words, blind_words, wire_roundtrip, json_field, json_all_strings, json_no_strings, search_stats, search_blind_multiplicity, index_info_counts, put_last_wins, put_overwrite, delete_entries, reconcile_orphans)
    return {f.__name__: f for f in plain} | {
        "search_exact": _search(WORDS_QUERY, "exact"),
        "search_contains": _search(WORDS_QUERY, "contains"),
        "search_prefix": _search(TRIGRAM_QUERY, "prefix"),
        "search_fuzzy": _search(TRIGRAM_QUERY, "fuzzy"),
        "search_short_fallback": _search(SHORT_QUERY, "prefix"),
        "search_limit_ties": _search(TIES_QUERY, "contains", 10),
        "search_no_tokens": _search("!!!", "contains"),
        "batch_search": _batch("contains", 10),
        "batch_search_fuzzy": _batch("fuzzy", 5),
    }


# -- SQL -------------------------------------------------------------------------


def _split(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda y: y <> '')"


def sql_words(x: str) -> str:
    return f"list_sort(list_distinct(list_transform({_split(x)}, lambda y: 'w:' || y)))"


def sql_trigrams(x: str) -> str:
    long = f"list_filter({_split(x)}, lambda y: length(y) >= 3)"
    return f"list_sort(list_distinct(flatten(list_transform({long}, lambda y: list_transform(range(1, length(y) - 1), lambda i: 't:' || substr(y, i, 3))))))"


def sql_hmac(x: str) -> str:
    ipad = bytes(b ^ 0x36 for b in TEST_KEY.ljust(64, b"\0")).hex()
    opad = bytes(b ^ 0x5C for b in TEST_KEY.ljust(64, b"\0")).hex()
    return f"sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode({x}))))"


def sql_hits(source: str, query: str, kind: str, keep: str = "", limit: int = TOP) -> str:
    f = sql_words if kind == "w" else sql_trigrams
    return f"""
WITH q AS (SELECT unnest({f(f"'{query}'")}) AS tok),
p AS (SELECT id, unnest({f("text")}) AS tok FROM ({source})),
s AS (SELECT id AS entry_id, count(*)::DOUBLE / (SELECT count(*) FROM q)::DOUBLE AS score FROM p JOIN q USING (tok) GROUP BY id)
SELECT entry_id, score FROM s {keep} ORDER BY score DESC, entry_id LIMIT {limit}"""


DOCS_SQL = "SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents"


def _batch_sql(f: Callable[[str], str], least: float, limit: int) -> str:
    return f"""
WITH q AS (SELECT item_id, unnest({f("text")}) AS tok FROM benchmark),
t AS (SELECT item_id, count(*) AS total FROM q GROUP BY item_id),
p AS (SELECT id, unnest({f("text")}) AS tok FROM ({DOCS_SQL})),
s AS (SELECT item_id, id, count(*) AS n FROM p JOIN q USING (tok) GROUP BY item_id, id),
r AS (SELECT item_id AS query_id, id AS entry_id, n::DOUBLE / total::DOUBLE AS score FROM s JOIN t USING (item_id))
SELECT query_id, entry_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS INTEGER) AS rank
FROM r WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) <= {limit}"""


def oracle_sql() -> dict[str, str]:
    sizes = f"CAST(len({sql_words('text')}) AS BIGINT) AS words, CAST(len({sql_trigrams('text')}) AS BIGINT) AS trigrams"
    fuzzy = f"""
WITH q AS (SELECT unnest({sql_trigrams(f"'{TRIGRAM_QUERY}'")}) AS tok),
p AS (SELECT doc_id, unnest({sql_trigrams("text")}) AS tok FROM documents),
s AS (SELECT doc_id, count(*)::DOUBLE / (SELECT count(*) FROM q)::DOUBLE AS score FROM p JOIN q USING (tok) GROUP BY doc_id)
SELECT count(*) AS scanned, count(*) FILTER (WHERE score >= 0.3) AS matched FROM s"""
    doubled = f"""
WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, unnest({sql_words("p_name")}) AS tok FROM part),
q AS (SELECT unnest(['w:red', 'w:red', 'w:widget']) AS tok)
SELECT id AS entry_id, count(*)::DOUBLE / 3.0::DOUBLE AS score FROM p JOIN q USING (tok) GROUP BY id ORDER BY score DESC, entry_id LIMIT {TOP}"""
    return {
        "word_tokens": f"SELECT doc_id, array_to_string({sql_words('text')}, ' ') AS words FROM documents",
        "trigram_tokens": f"SELECT doc_id, array_to_string({sql_trigrams('text')}, ' ') AS trigrams FROM documents",
        "token_counts": f"SELECT p_partkey, {sizes} FROM (SELECT p_partkey, p_name AS text FROM part)",
        "page_words": f"SELECT page_id, array_to_string({sql_words('url')}, ' ') AS words FROM pages",
        "blind_words": f"SELECT p_partkey, array_to_string(list_transform({sql_words('p_name')}, lambda z: {sql_hmac('z')}), ',') AS words, array_to_string(list_transform({sql_trigrams('p_name')}, lambda z: {sql_hmac('z')}), ',') AS trigrams FROM part",
        "wire_roundtrip": f"SELECT p_partkey, array_to_string(list_transform({sql_words('p_name')}, lambda z: {sql_hmac('z')}), ',') AS words, CAST(len({sql_trigrams('p_name')}) AS BIGINT) AS trigrams, true AS ok FROM part",
        "json_field": f"SELECT c_custkey, array_to_string({sql_words('c_mktsegment')}, ' ') AS words FROM customer",
        "json_all_strings": f"SELECT c_custkey, array_to_string({sql_words('''c_name || ' ' || c_mktsegment''')}, ' ') AS words FROM customer",
        "json_no_strings": "SELECT event_id, CAST(0 AS BIGINT) AS words FROM events",
        "search_exact": sql_hits(DOCS_SQL, WORDS_QUERY, "w", "WHERE score = 1.0"),
        "search_contains": sql_hits(DOCS_SQL, WORDS_QUERY, "w"),
        "search_prefix": sql_hits(DOCS_SQL, TRIGRAM_QUERY, "t", "WHERE score >= 0.6"),
        "search_fuzzy": sql_hits(DOCS_SQL, TRIGRAM_QUERY, "t", "WHERE score >= 0.3"),
        "search_short_fallback": sql_hits(DOCS_SQL, SHORT_QUERY, "w"),
        "search_limit_ties": sql_hits(DOCS_SQL, TIES_QUERY, "w", "", 10),
        "search_no_tokens": "SELECT '' AS entry_id, CAST(0 AS DOUBLE) AS score WHERE false",
        "search_stats": fuzzy,
        "search_blind_multiplicity": doubled,
        "batch_search": _batch_sql(sql_words, 0.0, 10),
        "batch_search_fuzzy": _batch_sql(sql_trigrams, 0.3, 5),
        "index_info_counts": "SELECT 'docs' AS name, count(DISTINCT doc_id) AS entry_count, CAST(1 AS BIGINT) AS tokenizer_version FROM documents UNION ALL SELECT 'empty', 0, 1",
        "put_last_wins": f"SELECT CAST(conv_id AS VARCHAR) AS entry_id, CAST(1 AS BIGINT) AS version, {sizes} FROM (SELECT conv_id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)",
        "put_overwrite": f"SELECT CAST(doc_id AS VARCHAR) AS entry_id, CAST(CASE WHEN again THEN 2 ELSE 1 END AS BIGINT) AS version, {sizes} FROM (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS again, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN lang ELSE text END AS text FROM documents)",
        "delete_entries": sql_hits("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS text FROM part WHERE NOT (p_size % 2 = 1)", "red widget ring", "w"),
        "reconcile_orphans": sql_hits("SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)", WORDS_QUERY, "w"),
    }
