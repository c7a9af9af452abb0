"""Client of the socket server. Needs no Spark; blind calls hash tokens on this side."""

from __future__ import annotations

import base64
import json
import socket
from types import TracebackType

from hushdex.errors import HushError
from hushdex.functions import blind


class ServerError(HushError):
    """The server's answer was an error."""


class Client:
    """One connection. ``prefix`` words go before every command, for servers that route by them."""

    def __init__(self, host: str, port: int, token: str | None = None, prefix: tuple[str, ...] = (), timeout: float | None = 60) -> None:
        self._socket = socket.create_connection((host, port), timeout)
        self._file = self._socket.makefile("rwb")
        self._prefix = prefix
        if token is not None:
            self.call("AUTH", token)

    def __enter__(self) -> Client:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.close()

    def close(self) -> None:
        self._file.close()
        self._socket.close()

    def call(self, *words: str) -> object:
        """Send one command; its reply as plain values, or ServerError."""
        raw = [w.encode() for w in (*self._prefix, *words)]
        self._file.write(b"*%d\r\n" % len(raw) + b"".join(b"$%d\r\n%s\r\n" % (len(w), w) for w in raw))
        self._file.flush()
        head = self._file.readline()
        if head[:1] == b"-":
            raise ServerError(head[1:].decode().strip().removeprefix("ERR "))
        if head[:1] != b"$":
            raise ServerError("the connection was closed" if not head else "not an answer")
        size = int(head[1:])
        return json.loads(self._file.read(size + 2)[:size])

    def health(self) -> dict:
        return self.call("HEALTH")

    def ping(self) -> str:
        return self.call("PING")

    def create(self, index: str) -> dict:
        return self.call("INDEX", "CREATE", index)

    def rotate(self, index: str) -> dict:
        return self.call("INDEX", "ROTATE", index)

    def destroy(self, index: str) -> dict:
        return self.call("INDEX", "DESTROY", index)

    def reindex(self, index: str) -> dict:
        return self.call("INDEX", "REINDEX", index)

    def reconcile(self, index: str, ids: list[str]) -> dict:
        return self.call("INDEX", "RECONCILE", index, *ids)

    def indexes(self) -> list[str]:
        return self.call("INDEX", "LIST")

    def info(self, index: str) -> dict:
        return self.call("INDEX", "INFO", index)

    def tokenize(self, index: str, data: bytes, field: str | None = None) -> dict:
        return self.call("TOKENIZE", index, _wire(data), *_option("FIELD", field))

    def put(self, index: str, entry: str, data: bytes, field: str | None = None) -> dict:
        return self.call("PUT", index, entry, _wire(data), *_option("FIELD", field))

    def put_blind(self, index: str, entry: str, key: blind.BlindKey, data: bytes, field: str | None = None) -> dict:
        return self.call("PUT", index, entry, blind.encode_set(*key.tokenize_field(data, field)), "BLIND")

    def delete(self, index: str, entry: str) -> dict:
        return self.call("DELETE", index, entry)

    def search(self, index: str, query: str, mode: str | None = None, limit: int | None = None, field: str | None = None) -> dict:
        return self.call("SEARCH", index, query, *_option("MODE", mode), *_option("FIELD", field), *_option("LIMIT", limit))

    def search_blind(self, index: str, key: blind.BlindKey, query: str, mode: str | None = None, limit: int | None = None) -> dict:
        return self.call("SEARCH", index, blind.encode_set(*key.tokenize(query)), *_option("MODE", mode), *_option("LIMIT", limit), "BLIND")


def _wire(data: bytes) -> str:
    return base64.b64encode(data).decode()


def _option(name: str, value: object) -> tuple[str, ...]:
    return () if value is None else (name, str(value))
