import base64
import io
import json
import socket
import threading

import pytest

from hushdex.plans.guard import AuthContext, Grant
from hushdex.plans.serve import application, read_words, reply_bytes, socket_server


def b64(text):
    return base64.b64encode(text.encode()).decode()


def caller(app):
    def call(method, path, body=None, query="", token=None):
        data = b"" if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        env = {"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_LENGTH": str(len(data)), "wsgi.input": io.BytesIO(data)}
        if token:
            env["HTTP_AUTHORIZATION"] = token
        got = []
        out = b"".join(app(env, lambda status, headers: got.append(status)))
        return int(got[0].split()[0]), json.loads(out)

    return call


def test_http(engine):
    call = caller(application(engine))
    assert call("POST", "/index/create", {"name": "i"})[0] == 200
    assert call("POST", "/index/create", {"name": "i"})[0] == 409
    assert call("POST", "/put", {"index": "i", "entry_id": "a", "data": b64("red chair")}) == (200, {"status": "ok", "id": "a", "version": 1})
    assert call("GET", "/search", query="index=i&query=red+chair&mode=exact&limit=5")[1]["results"] == [{"id": "a", "score": 1.0}]
    assert call("POST", "/tokenize", {"index": "i", "data": b64("red")})[1]["words"] == 1
    assert call("GET", "/index/info", query="name=i")[1]["entry_count"] == 1
    assert call("GET", "/index/list") == (200, ["i"]) and call("GET", "/health") == (200, {"status": "ok", "indexes": 1})
    assert call("POST", "/index/reconcile", {"name": "i", "valid_ids": ["a"]})[1]["orphans_removed"] == 0
    assert call("DELETE", "/entry", query="index=i&entry_id=a")[0] == 200
    assert call("DELETE", "/entry", query="index=i&entry_id=a")[0] == 404
    assert call("POST", "/index/rotate", {"name": "i"})[0] == call("POST", "/index/reindex", {"name": "i"})[0] == 200
    assert call("POST", "/index/destroy", {"name": "i"})[1]["deleted_entries"] == 0
    assert call("GET", "/index/info", query="name=i")[0] == 404


@pytest.mark.parametrize(
    ("method", "path", "body", "query", "code"),
    [
        ("GET", "/nope", None, "", 404), ("GET", "/put", None, "", 405), ("POST", "/put", b"{", "", 400), ("POST", "/put", [], "", 400), ("POST", "/put", {"index": "i"}, "", 400),
        ("POST", "/index/create", {"name": "has space"}, "", 400), ("POST", "/index/create", {"name": 5}, "", 400), ("GET", "/search", None, "index=i&query=x&limit=no", 400), ("GET", "/search", None, "index=i&query=x&mode=odd", 400),
        ("POST", "/index/reconcile", {"name": "i", "valid_ids": "a"}, "", 400), ("GET", "/search", None, "index=i&query=x&blind=perhaps", 400), ("GET", "/search", None, "index=none&query=x", 404),
    ],
)
def test_http_errors(engine, method, path, body, query, code):
    assert caller(application(engine))(method, path, body, query)[0] == code


def test_http_access(engine):
    engine.create("i")
    call = caller(application(engine, {"r": AuthContext("ana", grants=(Grant("hushdex.i.*", ("read",)),))}))
    assert call("GET", "/health")[0] == call("GET", "/index/list")[0] == 200
    assert call("GET", "/search", query="index=i&query=x")[0] == 401
    assert call("GET", "/search", query="index=i&query=x", token="Basic r")[0] == 401
    assert call("GET", "/search", query="index=i&query=x", token="Bearer zzz")[0] == 401
    assert call("GET", "/search", query="index=i&query=x", token="Bearer r")[0] == 200
    assert call("POST", "/put", {"index": "i", "entry_id": "a", "data": b64("x")}, token="Bearer r")[0] == 403
    assert call("POST", "/index/create", {"name": "j"}, token="Bearer r")[0] == 403


def test_wire_form():
    assert read_words(io.BytesIO(b"*2\r\n$4\r\nPING\r\n$0\r\n\r\n")) == ["PING", ""] and read_words(io.BytesIO(b"")) is None
    assert reply_bytes('"PONG"') == b'$6\r\n"PONG"\r\n' and reply_bytes("ERR a\nb") == b"-ERR a b\r\n"
    for bad in (b"PING\r\n", b"*1\r\n:5\r\n"):
        with pytest.raises(Exception, match="expected"):
            read_words(io.BytesIO(bad))


def test_socket(engine):
    server = socket_server(engine, ("127.0.0.1", 0))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with socket.create_connection(server.server_address) as s:
            f = s.makefile("rwb")

            def call(*words):
                f.write(b"*%d\r\n" % len(words) + b"".join(b"$%d\r\n%s\r\n" % (len(w.encode()), w.encode()) for w in words))
                f.flush()
                head = f.readline()
                return head.decode().strip() if head[:1] == b"-" else json.loads(f.read(int(head[1:]) + 2))

            assert call("PING") == "PONG" and call("INDEX", "CREATE", "i")["status"] == "ok"
            assert call("PUT", "i", "a", b64("é x"))["version"] == 1 and call("SEARCH", "i", "é")["matched"] == 1
            assert call("NOPE") == "-ERR bad argument: unknown command: NOPE"
    finally:
        server.shutdown()
        server.server_close()


def test_client(engine):
    from hushdex.client import Client, ServerError
    from hushdex.functions.blind import BlindKey

    server = socket_server(engine, ("127.0.0.1", 0), {"t": AuthContext("ana", platform=True)})
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with Client(*server.server_address, token="t") as c:
            assert c.ping() == "PONG" and c.create("i")["status"] == "ok" and c.indexes() == ["i"]
            assert c.put("i", "a", b'{"t":"red chair","u":"x"}', "t")["version"] == 1
            assert c.search("i", "chair", "exact", 3)["results"] == [{"id": "a", "score": 1.0}]
            key = BlindKey.generate()
            c.put_blind("i", "b", key, "größer é".encode())
            assert c.search_blind("i", key, "é")["results"] == [{"id": "b", "score": 1.0}]
            assert c.info("i")["entry_count"] == 2 and c.reconcile("i", ["b"])["orphans_removed"] == 1
            with pytest.raises(ServerError, match="no index"):
                c.info("none")
            assert c.destroy("i")["deleted_entries"] == 1 and c.health() == {"status": "ok"}
        with pytest.raises(ServerError, match="token"):
            Client(*server.server_address, token="zz")
    finally:
        server.shutdown()
        server.server_close()


def test_other_errors_are_answers_too(engine, monkeypatch):
    from hushdex.plans.command import Session

    def broken(*_):
        raise RuntimeError("x")

    monkeypatch.setattr(engine, "info", broken)
    assert Session(engine).execute(["INDEX", "INFO", "i"]) == "ERR internal: RuntimeError"
    app = application(engine)
    assert caller(app)("GET", "/index/info", query="name=i") == (500, {"error": "internal: RuntimeError"})
    got = []
    app({"REQUEST_METHOD": "POST", "PATH_INFO": "/put", "CONTENT_LENGTH": "no"}, lambda status, _: got.append(status))
    assert got == ["400 Bad Request"]
