import base64
import json

import pytest

from hushdex.errors import InvalidArgument
from hushdex.functions import blind
from hushdex.plans.command import FORMS, Session, parse, shell_split
from hushdex.plans.guard import AuthContext, Grant
from hushdex.sources import config
from hushdex.streaming.ingest import ingest


def b64(text):
    return base64.b64encode(text.encode()).decode()


def test_parse():
    c = parse(["search", "i", "some words", "mode", "fuzzy", "LIMIT", "5", "blind"])
    assert (c.name, c.values) == ("SEARCH", {"index": "i", "query": "some words", "mode": "fuzzy", "limit": 5, "blind": True})
    # Positional arguments that look like keywords stay arguments.
    assert parse(["SEARCH", "MODE", "BLIND"]).values == {"index": "MODE", "query": "BLIND"}
    assert parse(["put", "i", "id", "eA==", "FIELD", "f", "extra"]).values == {"index": "i", "id": "id", "data": "eA==", "field": "f"}
    assert parse(["INDEX", "reconcile", "i", "a", "b"]).values == {"index": "i", "ids": ["a", "b"]}


@pytest.mark.parametrize("words", [[], ["NOPE"], ["INDEX"], ["INDEX", "NOPE"], ["INDEX", "CREATE"], ["INDEX", "RECONCILE", "i"], ["PUT", "i", "a"], ["DELETE", "i"], ["SEARCH", "i"], ["TOKENIZE", "i"], ["AUTH"], ["SEARCH", "i", "q", "LIMIT", "x"], ["SEARCH", "i", "q", "LIMIT", "-1"]])
def test_parse_errors(words):
    with pytest.raises(InvalidArgument):
        parse(words)


def test_replies(engine):
    s = Session(engine)
    assert s.call(["INDEX", "CREATE", "i"])["tokenizer_version"] == 1
    assert s.call(["PUT", "i", "a", b64("red chair")]) == {"status": "ok", "id": "a", "version": 1}
    assert s.call(["SEARCH", "i", "red"]) == {"status": "ok", "scanned": 1, "matched": 1, "results": [{"id": "a", "score": 1.0}]}
    t = s.call(["TOKENIZE", "i", b64("red")])
    assert (t["words"], t["trigrams"], len(t["tokens"]["words"])) == (1, 1, 1)
    info = s.call(["INDEX", "INFO", "i"])
    assert set(info) == {"index", "created_at", "entry_count", "tokenizer_version"} and info["entry_count"] == 1
    assert s.call(["INDEX", "LIST"]) == ["i"]
    assert s.call(["INDEX", "RECONCILE", "i", "zzz"])["orphans_removed"] == 1
    assert s.call(["INDEX", "REINDEX", "i"])["entries_cleared"] == 0
    assert set(s.call(["INDEX", "ROTATE", "i"])) == {"status", "index", "rotated_at", "entry_count"}
    s.call(["PUT", "i", "a", b64("x")])
    assert s.call(["DELETE", "i", "a"]) == {"status": "ok", "id": "a"}
    assert s.call(["INDEX", "DESTROY", "i"]) == {"status": "ok", "index": "i", "deleted_entries": 0}
    assert s.call(["PING"]) == "PONG" and s.call(["HEALTH"]) == {"status": "ok"}
    assert s.call(["COMMAND", "LIST"])["count"] == len(FORMS) == 16
    assert set(s.call(["HELLO"])) == {"engine", "version", "protocol", "commands", "capabilities"}
    assert json.loads(s.execute(["PING"])) == "PONG" and s.execute(["INDEX", "INFO", "i"]) == "ERR there is no index 'i'"


def test_access(engine):
    grant = lambda *scopes: (Grant("hushdex.i.*", scopes),)
    tokens = {"r": AuthContext("ana", grants=grant("read")), "w": AuthContext("bob", grants=grant("write")), "a": AuthContext("root", platform=True), "m": AuthContext("max", grants=(Grant("*", ("admin",)),))}
    s = Session(engine, tokens)
    assert s.execute(["INDEX", "CREATE", "i"]).startswith("ERR access denied")
    assert s.execute(["PING"]) == '"PONG"' and s.execute(["AUTH", "zzz"]) == "ERR bad argument: unknown token"
    for token, allowed in (("a", "CPS"), ("w", "P"), ("r", "S"), ("m", "C")):
        s.execute(["AUTH", token])
        calls = {"C": ["INDEX", "CREATE", "i" if token == "a" else "j"], "P": ["PUT", "i", "x", b64("x")], "S": ["SEARCH", "i", "x"]}
        for kind, words in calls.items():
            assert s.execute(words).startswith("ERR access denied") == (kind not in allowed), (token, kind)
    s.execute(["AUTH", "r"])
    assert s.execute(["SEARCH", "j", "x"]).startswith("ERR access denied")


def test_blind_round_trip(engine):
    s, key = Session(engine), blind.BlindKey.derive(b"secret", b"docs")
    s.call(["INDEX", "CREATE", "i"])
    s.call(["PUT", "i", "a", blind.encode_set(*key.tokenize("planet earth")), "BLIND"])
    got = s.call(["SEARCH", "i", blind.encode_set(*key.tokenize("plane")), "MODE", "fuzzy", "BLIND"])
    assert got["results"] == [{"id": "a", "score": 1.0}]


def test_shell_split():
    assert shell_split('PUT i a {"x": "y z"} [1, 2]  BLIND') == ["PUT", "i", "a", '{"x": "y z"}', "[1, 2]", "BLIND"]
    assert shell_split("  ") == []


def test_config():
    s = config.read('[engine]\nindexes = ["a"]\nfuzzy_threshold = 0.5\n[store]\nmode = "remote"\nuri = "s3a://b/x"\n[auth.tokens.t]\nactor = "ana"\ngrants = [{namespace = "hushdex.a.*", scopes = ["read"]}]')
    assert (s.indexes, s.engine.fuzzy_threshold, s.engine.prefix_threshold, s.root) == (("a",), 0.5, 0.6, "s3a://b/x")
    assert s.engine.require_audit and s.engine.require_policy and s.tokens["t"].grants[0].covers("hushdex.a.*", "read")
    assert config.load(None).tokens is None
    for bad in ("[store]\nmode = 'odd'", "[store]\nmode = 'remote'", "not toml"):
        with pytest.raises(InvalidArgument):
            config.read(bad)


def test_streaming(engine, tmp_path):
    spark = engine.spark
    engine.create("i")
    src = f"{tmp_path}/events"

    def send(rows):
        spark.createDataFrame(rows, "entry_id string, op string, text string, seq bigint").coalesce(1).write.mode("append").json(src)
        q = ingest(engine, "i", spark.readStream.schema("entry_id string, op string, text string, seq bigint").json(src), f"file://{tmp_path}/cp")
        q.awaitTermination()

    send([("a", "put", "old", 1), ("a", "put", "new", 2), ("b", "put", "gone", 3), ("c", "put", "stays", 4)])
    send([("b", "delete", None, 5), ("c", "delete", None, 6), ("c", "put", "back", 7), ("zz", "delete", None, 8)])
    state = {r["entry_id"]: r["version"] for r in engine.store.entries(engine.store.load("i")).collect()}
    assert state == {"a": 1, "c": 2}
    assert engine.search("i", "new back", "contains").stats.first()["matched"] == 2
