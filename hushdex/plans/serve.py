"""Front ends: a WSGI application and a socket server that speaks RESP."""

from __future__ import annotations

import json
import socketserver
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import parse_qsl

from hushdex.errors import AccessDenied, EntryNotFound, HushError, IndexExists, IndexNotFound, InternalError, InvalidArgument, PolicyDenied
from hushdex.operators.engine import Engine
from hushdex.plans.command import Command, Session, run
from hushdex.plans.guard import AuthContext

#: HTTP status by error class; anything else is 500.
STATUS = {AccessDenied: 403, PolicyDenied: 403, IndexNotFound: 404, EntryNotFound: 404, IndexExists: 409, InvalidArgument: 400}
REASON = {200: "OK", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 409: "Conflict", 413: "Content Too Large", 500: "Internal Server Error"}
MAX_BODY = 64_000_000


@dataclass(frozen=True)
class Route:
    """A method and path, its command, and which field feeds which of its values."""

    method: str
    command: str
    fields: dict[str, str]
    optional: tuple[str, ...] = ()


_NAME = {"name": "index"}
_ENTRY = {"index": "index", "entry_id": "id"}
ROUTES = {
    "/index/create": Route("POST", "INDEX CREATE", _NAME),
    "/index/destroy": Route("POST", "INDEX DESTROY", _NAME),
    "/index/rotate": Route("POST", "INDEX ROTATE", _NAME),
    "/index/reindex": Route("POST", "INDEX REINDEX", _NAME),
    "/index/reconcile": Route("POST", "INDEX RECONCILE", _NAME | {"valid_ids": "ids"}),
    "/index/info": Route("GET", "INDEX INFO", _NAME),
    "/index/list": Route("GET", "INDEX LIST", {}),
    "/put": Route("POST", "PUT", _ENTRY | {"data": "data"}, ("field", "blind")),
    "/entry": Route("DELETE", "DELETE", _ENTRY),
    "/search": Route("GET", "SEARCH", {"index": "index", "query": "query"}, ("mode", "field", "limit", "blind")),
    "/tokenize": Route("POST", "TOKENIZE", {"index": "index", "data": "data"}, ("field",)),
    "/health": Route("GET", "HEALTH", {}),
}


def _value(name: str, value: object) -> object:
    """A field's value in the type its command expects."""
    if name == "valid_ids":
        if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
            raise InvalidArgument("valid_ids is a list of strings")
        return value
    if name == "blind":
        if value not in (True, False, "true", "false"):
            raise InvalidArgument("blind is true or false")
        return value in (True, "true")
    if name == "limit":
        if not str(value).isdecimal():
            raise InvalidArgument(f"invalid LIMIT: {value}")
        return int(str(value))
    if not isinstance(value, str):
        raise InvalidArgument(f"{name} is a string")
    return value


def command_of(route: Route, given: dict) -> Command:
    missing = [f for f in route.fields if f not in given]
    if missing:
        raise InvalidArgument(f"missing {', '.join(missing)}")
    values = {to: _value(f, given[f]) for f, to in route.fields.items()}
    return Command(route.command, values | {f: _value(f, given[f]) for f in route.optional if given.get(f) is not None})


def application(engine: Engine, tokens: dict[str, AuthContext] | None = None) -> Callable:
    """WSGI application; without ``tokens`` access rules are off."""

    def answer(env: dict) -> tuple[int, object]:
        route = ROUTES.get(env.get("PATH_INFO", ""))
        if route is None:
            return 404, {"error": "no such path"}
        if env["REQUEST_METHOD"] != route.method:
            return 405, {"error": f"use {route.method}"}
        context = None
        if tokens is not None:
            header = env.get("HTTP_AUTHORIZATION")
            if header is not None:
                kind, _, token = header.partition(" ")
                if kind != "Bearer" or token not in tokens:
                    return 401, {"error": "unknown token" if kind == "Bearer" else f"{kind} is not a scheme of this server, Bearer is"}
                context = tokens[token]
            elif route.command not in ("HEALTH", "INDEX LIST"):
                return 401, {"error": "this call needs a token"}
        given: object = dict(parse_qsl(env.get("QUERY_STRING", ""), keep_blank_values=True))
        if route.method == "POST":
            length = env.get("CONTENT_LENGTH") or "0"
            if not length.isdecimal():
                return 400, {"error": "the length of the body is no number"}
            size = int(length)
            if size > MAX_BODY:
                return 413, {"error": "body too large"}
            try:
                given = json.loads(env["wsgi.input"].read(size))
            except ValueError:
                return 400, {"error": "invalid JSON"}
            if not isinstance(given, dict):
                return 400, {"error": "invalid body: an object is expected"}
        try:
            reply = run(engine, command_of(route, given), context)
        except HushError as e:
            return STATUS.get(type(e), 500), {"error": str(e)}
        except Exception as e:  # whatever Spark or the store raise is an answer too
            return 500, {"error": str(InternalError(type(e).__name__))}
        return 200, reply | {"indexes": len(engine.names())} if route.command == "HEALTH" else reply

    def app(env: dict, start: Callable) -> Iterable[bytes]:
        code, body = answer(env)
        data = json.dumps(body, ensure_ascii=False).encode()
        start(f"{code} {REASON[code]}", [("Content-Type", "application/json"), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*")])
        return [data]

    return app


# -- sockets ---------------------------------------------------------------------


def read_words(stream) -> list[str] | None:
    """One request: an array of bulk strings, or None at the end."""
    line = stream.readline()
    if not line:
        return None
    if line[:1] != b"*" or not line[1:].strip().isdigit():
        raise InvalidArgument("an array is expected")
    words = []
    for _ in range(int(line[1:])):
        head = stream.readline()
        if head[:1] != b"$" or not head[1:].strip().isdigit() or int(head[1:]) > MAX_BODY:
            raise InvalidArgument("a bulk string is expected")
        words.append(stream.read(int(head[1:])).decode())
        stream.read(2)
    return words


def reply_bytes(text: str) -> bytes:
    """``ERR ...`` as an error, everything else as a bulk string."""
    if text.startswith("ERR "):
        return b"-" + " ".join(text.splitlines()).encode() + b"\r\n"
    data = text.encode()
    return b"$%d\r\n%s\r\n" % (len(data), data)


def socket_server(engine: Engine, address: tuple[str, int], tokens: dict[str, AuthContext] | None = None) -> socketserver.ThreadingTCPServer:
    """A server whose connections are sessions; call ``serve_forever`` on it."""

    class Handler(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            session = Session(engine, tokens)
            while True:
                try:
                    words = read_words(self.rfile)
                except (HushError, ValueError) as e:
                    self.wfile.write(reply_bytes(f"ERR {e}"))
                    return
                if words is None:
                    return
                self.wfile.write(reply_bytes(session.execute(words)))

    class Server(socketserver.ThreadingTCPServer):
        allow_reuse_address = True
        daemon_threads = True

    return Server(address, Handler)
