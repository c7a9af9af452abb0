"""Registered queries over what has no table of its own: commands, guards, settings,
front ends, keys and streams. Each runs the real thing and gives its answers as rows."""

from __future__ import annotations

import base64
import contextlib
import io
import json
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushdex.client import Client, ServerError
from hushdex.errors import HushError
from hushdex.functions import blind, extract, keys, tokens
from hushdex.operators import search as ops
from hushdex.operators.engine import Config, Engine, check_name
from hushdex.plans import queries as core
from hushdex.plans.command import FORMS, Session, shell_split
from hushdex.plans.guard import AuthContext, Capability, Decision, Grant, Guard
from hushdex.plans.serve import application, socket_server
from hushdex.sources import config
from hushdex.sources.local import frame
from hushdex.streaming.ingest import applier, ingest

#: Entries that the capacity query's index takes.
ROOM = 50
SECRET = b"a secret that two sides share"


def _b64(text: str) -> str:
    return base64.b64encode(text.encode()).decode()


def _refused(call: Callable[[], object]) -> str | None:
    """Class of the error that a call raises, if it raises one of ours."""
    try:
        call()
    except HushError as e:
        return type(e).__name__
    return None


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("entry_id"), F.col("p_name").alias("text"), "p_partkey", "p_size")


# -- catalogue and entries ---------------------------------------------------------


def index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nation names, plain and with blanks replaced, may name an index."""
    rows = [(r["n_nationkey"], form, _refused(lambda name=name: check_name(name)) is None) for r in core.read(spark, sf_dir, "nation").collect() for form, name in (("plain", r["n_name"]), ("joined", r["n_name"].replace(" ", "_")))]
    return frame(spark, rows, "n_nationkey bigint, form string, ok boolean")


def catalog_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes by name, as an engine that starts anew reads them; one that is there is refused."""
    e = core.fresh_engine(spark)
    names = [r["c_mktsegment"] for r in core.read(spark, sf_dir, "customer").select("c_mktsegment").distinct().collect()]
    again = {}
    for n in names:
        e.create(n)
        again[n] = _refused(lambda n=n: e.create(n))
    e.seed([*names, "seeded"])
    other = Engine(spark, e.store.root)
    return frame(spark, [(k + 1, n, other.info(n).entry_count, again.get(n)) for k, n in enumerate(other.names())], "place int, name string, entry_count bigint, again string")


def lifecycle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each step of an index's life counts."""
    e, parts, rows = core.fresh_engine(spark), _parts(spark, sf_dir), []
    info = e.create("life")
    e.put_frame("life", parts)
    rows.append(("put", e.info("life").entry_count))
    rows.append(("delete", e.delete_frame("life", parts.where("p_size % 2 = 1"))))
    rows.append(("reconcile", e.reconcile("life", parts.where("p_partkey % 3 = 0"))))
    rows.append(("left", e.info("life").entry_count))
    old = e.store.key("life")
    after, cleared = e.reindex("life")
    rows += [("reindex", cleared), ("same age and key", int(after.created_at == info.created_at and e.store.key("life") == old))]
    e.put_frame("life", parts.where("p_partkey % 3 = 0"))
    rows += [("rotate", e.rotate("life").entry_count), ("new key", int(e.store.key("life") != old))]
    e.put_frame("life", parts.where("p_partkey % 3 = 1"))
    rows += [("destroy", e.destroy("life")), ("gone", int(_refused(lambda: e.info("life")) == "IndexNotFound"))]
    return frame(spark, rows, "step string, n bigint")


def capacity_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, some without an id, put into an index with little room."""
    e = Engine(spark, core.index_root(spark), Config(max_entries_per_index=ROOM))
    core.forget_at_exit(e)
    e.create("small")
    return e.put_frame("small", _parts(spark, sf_dir).withColumn("entry_id", F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("entry_id"))))


def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that are refused, and by which error."""
    e = core.fresh_engine(spark)
    e.create("docs")
    e.create("old")
    m = e.store.load("old")
    m.tokenizer_version = 0
    e.store._save(m)
    table = lambda *rows: frame(spark, list(rows), "query_id int, query string, mode string")
    cases = [
        ("empty query", lambda: e.search("docs", "")),
        ("empty blind query", lambda: e.search("docs", blind.encode_set([], []), is_blind=True)),
        ("malformed blind query", lambda: e.search("docs", "%%%", is_blind=True)),
        ("unknown mode", lambda: e.search("docs", "x", "nearby")),
        ("negative limit", lambda: e.search("docs", "x", limit=-1)),
        ("unknown mode in a table", lambda: e.search_frame("docs", table((1, "x", "fuzzy"), (2, "x", "nearby")))),
        ("empty query in a table", lambda: e.search_frame("docs", table((1, "", "fuzzy")))),
        ("empty blind query in a table", lambda: e.search_frame("docs", table((1, blind.encode_set([], []), "fuzzy")), is_blind=True)),
        ("empty entry id", lambda: e.put("docs", "", _b64("x"))),
        ("payload not base64", lambda: e.put("docs", "a", "x=x")),
        ("blind token not hex", lambda: e.put("docs", "a", blind.encode_set(["xyz"], []), is_blind=True)),
        ("old token rules, search", lambda: e.search("old", "x")),
        ("old token rules, put", lambda: e.put("old", "a", _b64("x"))),
        ("old token rules, blind search", lambda: e.search("old", blind.encode_set(["x"], []), is_blind=True)),
        ("unknown index", lambda: e.search("none", "x")),
        ("absent entry", lambda: e.delete("docs", "a")),
        ("no valid ids", lambda: e.reconcile("docs", [])),
    ]
    return frame(spark, [(name, _refused(call)) for name, call in cases], "call string, error string")


def put_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers put by one member of their JSON, in one bulk call."""
    e = core.fresh_engine(spark)
    e.create("customers")
    e.put_frame("customers", core.customers(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("entry_id"), "data"), text="data", field="segment")
    return core.state(e, "customers")


# -- payloads ----------------------------------------------------------------------


def json_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that are JSON but no object."""
    size, name = F.col("p_size").cast("string"), F.col("text")
    kind = F.col("p_partkey") % 4
    doc = F.when(kind == 0, size).when(kind == 1, F.concat(F.lit('"'), name, F.lit('"'))).when(kind == 2, F.concat(F.lit("[ "), size, F.lit(' , "'), name, F.lit('"]'))).otherwise("true")
    return _parts(spark, sf_dir).select("p_partkey", extract.extracted(F.encode(doc, "UTF-8")).alias("text"))


def json_raw_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that are no JSON: all of them, whatever member is asked for."""
    return _parts(spark, sf_dir).select("p_partkey", extract.extracted(F.encode(F.concat("text", F.lit(" {")), "UTF-8"), "name").alias("text"))


def base64_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names out of base64, some without padding, with a blank, or behind a line break."""
    data, kind = blind.unbroken_base64(F.encode("text", "UTF-8")), F.col("p_partkey") % 4
    sent = F.when(kind == 0, data).when(kind == 1, F.rtrim(data, F.lit("="))).when(kind == 2, F.concat(data, F.lit(" "))).otherwise(F.concat(F.lit("\n"), data))
    return _parts(spark, sf_dir).select("p_partkey", F.decode(blind.strict_base64(sent), "UTF-8").alias("text"))


# -- keys and clients --------------------------------------------------------------


def key_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r["n_nationkey"], keys.derive(SECRET, r["n_name"].encode()).hex()) for r in core.read(spark, sf_dir, "nation").collect()]
    return frame(spark, rows, "n_nationkey bigint, key string")


def _in_python(rows: DataFrame, make: Callable[[str], str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([make(t or "") for t in b.column(1).to_pylist()], pa.string())], names=["id", "words"])

    return rows.mapInArrow(run, "id bigint, words string")


def client_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word tokens as clients make them, without Spark's expressions."""
    return _in_python(core.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text"), lambda t: " ".join(tokens.plain_tokens(t)[0]))


def client_blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = blind.BlindKey(core.TEST_KEY)
    return _in_python(core.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint"), "p_name"), lambda t: ",".join(key.tokenize(t)[0]))


def batch_blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of clients' token sets, searched in an index of clients' token sets."""
    e, key = core.fresh_engine(spark), blind.BlindKey(core.TEST_KEY)
    e.create("blind")
    # A table of one small file is one task: clients hash side by side.
    rows = core.read(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    rows = rows.select(F.col("p_partkey").cast("string").alias("entry_id"), "p_name", F.lit("blind").alias("index"))
    sets = blind.blinded(rows, tokens.token_set(F.col("p_name")), blind.key_table(spark, {"blind": core.TEST_KEY}))
    e.put_blind_frame("blind", sets.select("entry_id", blind.wire(F.col("tokens")).alias("data")))
    queries = frame(spark, [(1, blind.encode_set(*key.tokenize("red widget")), "contains"), (2, blind.encode_set(*key.tokenize("ring")), "EXACT")], "query_id int, query string, mode string")
    return e.search_frame("blind", queries, 20, is_blind=True)


# -- commands and front ends -------------------------------------------------------


def command_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions put, searched and tokenised by text commands."""
    s, rows = Session(core.fresh_engine(spark)), []
    s.call(["INDEX", "CREATE", "regions"])
    regions = sorted(core.read(spark, sf_dir, "region").collect(), key=lambda r: r["r_regionkey"])
    put = {r["r_regionkey"]: s.call(["PUT", "regions", str(r["r_regionkey"]), _b64(r["r_name"])]) for r in regions}
    for r in regions:
        found = s.call(["search", "regions", r["r_name"], "mode", "Exact", "LIMIT", "9"])
        made = s.call(["TOKENIZE", "regions", _b64(r["r_name"])])
        rows.append((r["r_regionkey"], put[r["r_regionkey"]]["version"], found["matched"], found["results"][0]["score"], made["words"], made["trigrams"]))
    return frame(spark, rows, "r_regionkey bigint, version bigint, matched bigint, score double, words bigint, trigrams bigint")


def command_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that depend on no data, as sent."""
    s = Session(core.fresh_engine(spark), {"t": AuthContext("ana", platform=True)})
    lines = ["PING", "HEALTH", "INDEX LIST", "AUTH t", "AUTH x", "INDEX INFO none", "INDEX CREATE {a b}", "NOPE", "SEARCH i", "command count"]
    rows = [(k, line, s.execute(shell_split(line))) for k, line in enumerate(lines)]
    hello = s.call(["HELLO"])
    rows.append((len(rows), "HELLO", ",".join(sorted(hello))))
    return frame(spark, [(k, line, "16 commands" if line.startswith("command") and json.loads(got)["count"] == len(FORMS) == 16 else got) for k, line, got in rows], "step int, command string, reply string")


def access_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which commands on the index docs callers of four kinds may give."""
    from hushdex.errors import AccessDenied
    from hushdex.plans.command import Command

    who = {
        "nobody": AuthContext("x"),
        "reader": AuthContext("x", grants=(Grant("hushdex.docs.*", ("read",)),)),
        "writer of all": AuthContext("x", grants=(Grant("*", ("read", "write")),)),
        "admin": AuthContext("x", grants=(Grant("hushdex.other.*", ("admin",)),)),
        "platform": AuthContext("x", platform=True),
        "switched off": None,
    }

    def may(name: str, context: AuthContext | None) -> bool:
        try:
            Command(name, {"index": "docs"}).need.check(context)
        except AccessDenied:
            return False
        return True

    return frame(spark, [(c, w, may(c, x)) for c in FORMS for w, x in who.items()], "command string, caller string, allowed boolean")


def http_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of requests to the HTTP front end."""
    e = core.fresh_engine(spark)
    app = application(e, {"a": AuthContext("ana", platform=True), "r": AuthContext("bob", grants=(Grant("hushdex.docs.*", ("read",)),))})

    def call(method: str, path: str, query: str, body: str, token: str | None) -> int:
        got: list[str] = []
        env = {"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_LENGTH": str(len(body)), "wsgi.input": io.BytesIO(body.encode())}
        app(env | ({"HTTP_AUTHORIZATION": token} if token else {}), lambda status, _: got.append(status))
        return int(got[0].split()[0])

    a = "Bearer a"
    calls = [
        ("POST", "/index/create", "", '{"name": "docs"}', a), ("POST", "/index/create", "", '{"name": "docs"}', a), ("POST", "/put", "", json.dumps({"index": "docs", "entry_id": "1", "data": _b64("red")}), a),
        ("GET", "/search", "index=docs&query=red", "", "Bearer r"), ("GET", "/index/info", "name=docs", "", a), ("GET", "/index/list", "", "", None), ("GET", "/health", "", "", None),
        ("POST", "/tokenize", "", json.dumps({"index": "docs", "data": _b64("red")}), a), ("DELETE", "/entry", "index=docs&entry_id=1", "", "Bearer r"), ("DELETE", "/entry", "index=docs&entry_id=1", "", a),
        ("DELETE", "/entry", "index=docs&entry_id=1", "", a), ("POST", "/index/reconcile", "", '{"name": "docs", "valid_ids": ["1"]}', a), ("POST", "/index/reindex", "", '{"name": "docs"}', a),
        ("POST", "/index/rotate", "", '{"name": "docs"}', a), ("POST", "/index/destroy", "", '{"name": "docs"}', a), ("GET", "/index/info", "name=docs", "", a), ("GET", "/search", "index=docs&query=red", "", None),
        ("GET", "/search", "index=docs&query=red", "", "Basic r"), ("GET", "/search", "index=docs&query=red", "", "Bearer zz"), ("POST", "/put", "", "{", a), ("GET", "/nowhere", "", "", a), ("GET", "/put", "", "", a),
    ]
    return frame(spark, [(k, f"{c[0]} {c[1]}", call(*c)) for k, c in enumerate(calls)], "step int, request string, status int")


def socket_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions put and searched through the socket server, plainly and blind."""
    e, key = core.fresh_engine(spark), blind.BlindKey(core.TEST_KEY)
    server = socket_server(e, ("127.0.0.1", 0), {"t": AuthContext("ana", platform=True)})
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = []
    try:
        with Client(*server.server_address, token="t") as c:
            c.create("plain")
            c.create("blind")
            for r in core.read(spark, sf_dir, "region").collect():
                name = r["r_name"].encode()
                done = (c.put("plain", r["r_name"], name)["version"], c.put_blind("blind", r["r_name"], key, name)["version"])
                hits = (c.search("plain", r["r_name"], "exact", 5)["results"], c.search_blind("blind", key, r["r_name"], "exact")["results"])
                rows.append((r["r_regionkey"], *done, *(h[0]["id"] for h in hits)))
            try:
                c.info("none")
                rows.append((-1, 0, 0, "", ""))
            except ServerError as error:
                rows.append((-1, 0, 0, str(error), c.ping()))
    finally:
        server.shutdown()
        server.server_close()
    return frame(spark, rows, "r_regionkey bigint, version bigint, blind_version bigint, hit string, blind_hit string")


def console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the console prints for single commands."""
    from hushdex.__main__ import main

    root, rows = core.fresh_engine(spark).store.root, []
    for k, line in enumerate(("PING", "INDEX LIST", "NOPE")):
        out, err = io.StringIO(), io.StringIO()
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
            code = main(["--data", root, *line.split()])
        rows.append((k, line, code, out.getvalue().strip(), err.getvalue().strip()))
    return frame(spark, rows, "step int, command string, code int, output string, errors string")


# -- guard and settings ------------------------------------------------------------


def guard_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What policy and audit hooks see of some calls, and what they refuse."""
    seen: list[tuple] = []
    policy = Capability.enabled(lambda r: seen.append(("policy", r.action, r.resource, r.principal)) or Decision(r.action != "index_rotate", "no-rotation"))
    audit = Capability.enabled(lambda a: seen.append(("audit", a.operation, a.resource, a.actor)))
    e = Engine(spark, core.index_root(spark), Config(require_audit=True, require_policy=True), Guard(policy, audit))
    core.forget_at_exit(e)
    e.create("docs", "ana")
    e.put("docs", "1", _b64("red"), actor="ana")
    e.search("docs", "red")
    seen.append(("refused", _refused(lambda: e.rotate("docs", "bob")) or "", "docs", "bob"))
    e.delete("docs", "1", "ana")
    for name, guard, need in (("no audit", Guard(policy, Capability.disabled("no sink")), Config(require_audit=True)), ("no policy", Guard(audit=audit), Config(require_policy=True))):
        seen.append(("refused", _refused(lambda guard=guard, need=need: Engine(spark, e.store.root, need, guard)) or "", name, ""))

    def broken(_: object) -> None:
        raise OSError

    failing = Engine(spark, e.store.root, guard=Guard(audit=Capability.enabled(broken)))
    seen.append(("refused", _refused(lambda: failing.search("docs", "red")) or "", "audit fails", ""))
    return frame(spark, [(k, *x) for k, x in enumerate(seen)], "step int, hook string, what string, resource string, who string")


SETTINGS = """
[server]
log_level = "debug"
[store]
mode = "remote"
uri = "s3a://bucket/indexes"
[engine]
indexes = ["one", "two"]
fuzzy_threshold = 0.5
require_audit = false
[auth.tokens.t]
actor = "ana"
grants = [{namespace = "hushdex.one.*", scopes = ["read"]}]
"""


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = config.read(SETTINGS)
    shown = {"root": s.root, "indexes": ",".join(s.indexes), "fuzzy": s.engine.fuzzy_threshold, "prefix": s.engine.prefix_threshold, "audit": s.engine.require_audit, "policy": s.engine.require_policy, "log": s.log_level, "actor": s.tokens["t"].actor, "scope": s.tokens["t"].grants[0].scopes[0]}
    shown["defaults"] = config.load(None).root
    shown |= {f"refused {k}": _refused(lambda t=t: config.read(t)) for k, t in (("mode", "[store]\nmode = 'odd'"), ("uri", "[store]\nmode = 'remote'"), ("text", "not toml"))}
    return frame(spark, [(k, str(v)) for k, v in shown.items()], "name string, value string")


def console_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Console lines cut into words, and names of modes."""
    lines = ["PING", '  PUT docs 1 {"a": "b c"}  FIELD a', "INDEX RECONCILE docs [1 2] 3", "", "a\tb"]
    rows = [("words", line, "|".join(shell_split(line))) for line in lines]
    for name in ("exact", "Contains", "PREFIX", "fuzzy", "near"):
        try:
            rows.append(("mode", name, ops.parse_mode(name)))
        except ValueError:
            rows.append(("mode", name, "refused"))
    return frame(spark, rows, "kind string, given string, got string")


# -- streams -----------------------------------------------------------------------


def _turns(df: DataFrame) -> DataFrame:
    return df.select(F.col("conv_id").cast("string").alias("entry_id"), F.when(F.col("turn") % 4 == 3, "delete").otherwise("put").alias("op"), "text", F.col("turn").cast("bigint").alias("seq"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as a stream of events; every fourth turn deletes."""
    e = core.fresh_engine(spark)
    e.create("talk")
    source = f"{e.store.root}/events"
    turns = core.read(spark, sf_dir, "conversations")
    _turns(turns).write.parquet(source)
    ingest(e, "talk", spark.readStream.schema(_turns(turns).schema).parquet(source), f"{e.store.root}/progress").awaitTermination()
    return core.state(e, "talk")


def stream_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events in batches that come late and twice."""
    e = core.fresh_engine(spark)
    e.create("talk")
    turns, apply = _turns(core.read(spark, sf_dir, "conversations")), applier(e, "talk")
    for k, part in enumerate(("seq >= 2", "seq < 2", "seq >= 2")):
        apply(turns.where(part), k)
    return core.state(e, "talk")


def search_default_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.documents_engine(spark, sf_dir).search("docs", core.TIES_QUERY).hits


MADE = (
    index_names, catalog_order, lifecycle_counts, capacity_refused, guards, put_field, json_scalars, json_raw_fallback, base64_strict, key_derivation, client_words, client_blind, batch_blind,
    command_session, command_replies, access_matrix, http_status, socket_client, console, guard_events, settings, console_words, stream_ingest, stream_late_events, search_default_limit,
)


def queries() -> dict[str, core.Query]:
    return {f.__name__: f for f in MADE}


# -- SQL -----------------------------------------------------------------------------


def _values(names: str, *rows: tuple) -> str:
    show = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, (bool, int)) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names})"


def oracle_sql() -> dict[str, str]:
    w, t = core.sql_words, core.sql_trigrams
    prk_in, prk_out = keys.pads(keys.derive_root(SECRET))
    bad = "InvalidArgument"
    commands = {"none": ("AUTH", "INDEX LIST", "HEALTH", "PING", "COMMAND", "HELLO"), "admin": ("INDEX CREATE", "INDEX ROTATE", "INDEX DESTROY", "INDEX REINDEX", "INDEX RECONCILE"), "read": ("INDEX INFO", "TOKENIZE", "SEARCH"), "write": ("PUT", "DELETE")}
    scopes = ", ".join(f"('{c}', '{s}')" for s, names in commands.items() for c in names)
    events = "SELECT conv_id, turn, text, turn % 4 = 3 AS gone FROM conversations"
    last = f"SELECT * FROM ({events}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"
    sizes = f"CAST(len({w('text')}) AS BIGINT) AS words, CAST(len({t('text')}) AS BIGINT) AS trigrams"
    blind_hits = lambda k, text, least: f"SELECT {k} AS query_id, id AS entry_id, n / total AS score, CAST(row_number() OVER (ORDER BY n DESC, id) AS INTEGER) AS rank FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(len(list_intersect({w('p_name')}, {w(repr(text))})) AS DOUBLE) AS n, CAST(len({w(repr(text))}) AS DOUBLE) AS total FROM part) WHERE n > {least} QUALIFY row_number() OVER (ORDER BY n DESC, id) <= 20"
    return {
        "index_names": "SELECT n_nationkey, 'plain' AS form, regexp_full_match(n_name, '[A-Za-z0-9_-]{1,255}') AS ok FROM nation UNION ALL SELECT n_nationkey, 'joined', regexp_full_match(replace(n_name, ' ', '_'), '[A-Za-z0-9_-]{1,255}') FROM nation",
        "catalog_order": "SELECT CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS place, name, CAST(0 AS BIGINT) AS entry_count, again FROM (SELECT DISTINCT c_mktsegment AS name, 'IndexExists' AS again FROM customer UNION ALL SELECT 'seeded', NULL)",
        "lifecycle_counts": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_size % 2 = 1) AS odd, count(*) FILTER (WHERE NOT (p_size % 2 = 1) AND p_partkey % 3 <> 0) AS orphans,
            count(*) FILTER (WHERE NOT (p_size % 2 = 1) AND p_partkey % 3 = 0) AS kept, count(*) FILTER (WHERE p_partkey % 3 = 1) AS ones FROM part)
            SELECT 'put' AS step, n FROM c UNION ALL SELECT 'delete', odd FROM c UNION ALL SELECT 'reconcile', orphans FROM c UNION ALL SELECT 'left', kept FROM c UNION ALL SELECT 'reindex', kept FROM c
            UNION ALL SELECT 'same age and key', 1 UNION ALL SELECT 'rotate', 0 UNION ALL SELECT 'new key', 1 UNION ALL SELECT 'destroy', ones FROM c UNION ALL SELECT 'gone', 1""",
        "capacity_refused": f"SELECT '' AS entry_id, 'entry id is empty' AS reason FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT id, 'index is full' FROM (SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey % 7 <> 0 QUALIFY row_number() OVER (ORDER BY id) > {ROOM})",
        "guards": _values("call, error", *((c, bad) for c in ("empty query", "empty blind query", "malformed blind query", "unknown mode", "negative limit", "unknown mode in a table", "empty query in a table", "empty blind query in a table", "empty entry id", "payload not base64", "blind token not hex", "old token rules, search", "old token rules, put")), ("old token rules, blind search", None), ("unknown index", "IndexNotFound"), ("absent entry", "EntryNotFound"), ("no valid ids", bad)),
        "put_field": f"SELECT CAST(c_custkey AS VARCHAR) AS entry_id, CAST(1 AS BIGINT) AS version, {sizes} FROM (SELECT c_custkey, c_mktsegment AS text FROM customer)",
        "json_scalars": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_name WHEN 2 THEN '[' || p_size || ',\"' || p_name || '\"]' ELSE 'true' END AS text FROM part",
        "json_raw_fallback": "SELECT p_partkey, p_name || ' {' AS text FROM part",
        "base64_strict": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN CASE WHEN ends_with(base64(encode(p_name)), '=') THEN NULL ELSE p_name END ELSE NULL END AS text FROM part",
        "key_derivation": f"SELECT n_nationkey, sha256(unhex('{prk_out.hex()}') || unhex(sha256(unhex('{prk_in.hex()}') || encode(n_name) || unhex('01')))) AS key FROM nation",
        "client_words": f"SELECT CAST(doc_id AS BIGINT) AS id, array_to_string({w('text')}, ' ') AS words FROM documents",
        "client_blind": f"SELECT CAST(p_partkey AS BIGINT) AS id, array_to_string(list_transform({w('p_name')}, lambda z: {core.sql_hmac('z')}), ',') AS words FROM part",
        "batch_blind": f"SELECT * FROM ({blind_hits(1, 'red widget', 0)}) UNION ALL SELECT * FROM ({blind_hits(2, 'ring', 0)})",
        "command_session": f"SELECT r_regionkey, CAST(1 AS BIGINT) AS version, (SELECT count(*) FROM region o WHERE len(list_intersect({w('o.r_name')}, {w('region.r_name')})) = len({w('region.r_name')})) AS matched, CAST(1 AS DOUBLE) AS score, CAST(len({w('r_name')}) AS BIGINT) AS words, CAST(len({t('r_name')}) AS BIGINT) AS trigrams FROM region",
        "command_replies": _values("step, command, reply", (0, "PING", '"PONG"'), (1, "HEALTH", '{"status": "ok"}'), (2, "INDEX LIST", "[]"), (3, "AUTH t", '{"status": "ok"}'), (4, "AUTH x", "ERR bad argument: unknown token"), (5, "INDEX INFO none", "ERR there is no index 'none'"), (6, "INDEX CREATE {a b}", "ERR bad argument: an index name has 1 to 255 letters, digits, - or _"), (7, "NOPE", "ERR bad argument: unknown command: NOPE"), (8, "SEARCH i", f"ERR bad argument: {FORMS['SEARCH'].usage}"), (9, "command count", "16 commands"), (10, "HELLO", "capabilities,commands,engine,protocol,version")),
        "access_matrix": f"SELECT command, caller, CASE caller WHEN 'nobody' THEN scope = 'none' WHEN 'reader' THEN scope IN ('none', 'read') WHEN 'writer of all' THEN scope IN ('none', 'read', 'write') WHEN 'admin' THEN scope IN ('none', 'admin') ELSE true END AS allowed FROM (VALUES {scopes}) c(command, scope), (VALUES ('nobody'), ('reader'), ('writer of all'), ('admin'), ('platform'), ('switched off')) p(caller)",
        "http_status": _values("step, request, status", *((k, *x) for k, x in enumerate((("POST /index/create", 200), ("POST /index/create", 409), ("POST /put", 200), ("GET /search", 200), ("GET /index/info", 200), ("GET /index/list", 200), ("GET /health", 200), ("POST /tokenize", 200), ("DELETE /entry", 403), ("DELETE /entry", 200), ("DELETE /entry", 404), ("POST /index/reconcile", 200), ("POST /index/reindex", 200), ("POST /index/rotate", 200), ("POST /index/destroy", 200), ("GET /index/info", 404), ("GET /search", 401), ("GET /search", 401), ("GET /search", 401), ("POST /put", 400), ("GET /nowhere", 404), ("GET /put", 405))))),
        "socket_client": "SELECT r_regionkey, CAST(1 AS BIGINT) AS version, CAST(1 AS BIGINT) AS blind_version, r_name AS hit, r_name AS blind_hit FROM region UNION ALL SELECT -1, 0, 0, 'there is no index ''none''', 'PONG'",
        "console": _values("step, command, code, output, errors", (0, "PING", 0, '"PONG"', ""), (1, "INDEX LIST", 0, "[]", ""), (2, "NOPE", 1, "", "ERR bad argument: unknown command: NOPE")),
        "guard_events": _values("step, hook, what, resource, who", *((k, *x) for k, x in enumerate((("policy", "index_create", "docs", "ana"), ("audit", "INDEX_CREATE", "docs", "ana"), ("policy", "put", "docs", "ana"), ("audit", "PUT", "docs/1", "ana"), ("policy", "search", "docs", ""), ("audit", "SEARCH", "docs", "anonymous"), ("policy", "index_rotate", "docs", "bob"), ("refused", "PolicyDenied", "docs", "bob"), ("policy", "delete", "docs", "ana"), ("audit", "DELETE", "docs/1", "ana"), ("refused", "InternalError", "no audit", ""), ("refused", "InternalError", "no policy", ""), ("refused", "InternalError", "audit fails", ""))))),
        "settings": _values("name, value", ("root", "s3a://bucket/indexes"), ("indexes", "one,two"), ("fuzzy", "0.5"), ("prefix", "0.6"), ("audit", "False"), ("policy", "True"), ("log", "debug"), ("actor", "ana"), ("scope", "read"), ("defaults", "./hushdex-data"), *((f"refused {k}", bad) for k in ("mode", "uri", "text"))),
        "console_words": _values("kind, given, got", ("words", "PING", "PING"), ("words", '  PUT docs 1 {"a": "b c"}  FIELD a', 'PUT|docs|1|{"a": "b c"}|FIELD|a'), ("words", "INDEX RECONCILE docs [1 2] 3", "INDEX|RECONCILE|docs|[1 2]|3"), ("words", "", ""), ("words", "a\tb", "a|b"), ("mode", "exact", "exact"), ("mode", "Contains", "contains"), ("mode", "PREFIX", "prefix"), ("mode", "fuzzy", "fuzzy"), ("mode", "near", "refused")),
        **{name: f"SELECT CAST(conv_id AS VARCHAR) AS entry_id, CAST(1 AS BIGINT) AS version, {sizes} FROM ({last}) WHERE NOT gone" for name in ("stream_ingest", "stream_late_events")},
        "search_default_limit": core.sql_hits(core.DOCS_SQL, core.TIES_QUERY, "w"),
    }
