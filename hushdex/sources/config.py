"""Settings from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from hushdex.errors import InvalidArgument
from hushdex.operators.engine import Config
from hushdex.plans.guard import AuthContext, Grant

MODES = ("embedded", "remote")


@dataclass(frozen=True)
class Settings:
    engine: Config = Config(require_audit=True, require_policy=True)
    indexes: tuple[str, ...] = ()
    root: str = "./hushdex-data"
    #: None switches access rules off.
    tokens: dict[str, AuthContext] | None = None
    log_level: str | None = None
    audit: dict = field(default_factory=dict)
    policy: dict = field(default_factory=dict)


def _grants(rows: list[dict]) -> tuple[Grant, ...]:
    return tuple(Grant(r["namespace"], tuple(r["scopes"])) for r in rows)


def read(text: str) -> Settings:
    """Sections server, store, engine, auth, audit and policy, all optional."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise InvalidArgument(f"failed to parse config: {e}") from e
    engine = dict(raw.get("engine", {}))
    indexes = tuple(engine.pop("indexes", ()))
    known = {k: engine[k] for k in Config.__dataclass_fields__ if k in engine}
    store = raw.get("store", {})
    mode = store.get("mode", "embedded")
    if mode not in MODES:
        raise InvalidArgument(f"unknown store mode: {mode}")
    if mode == "remote" and not store.get("uri"):
        raise InvalidArgument("a remote store needs a uri")
    auth = raw.get("auth", {})
    tokens = None
    if auth.get("method", "none") != "none" or "tokens" in auth:
        tokens = {raw_token: AuthContext(t["actor"], t.get("tenant", "default"), t.get("platform", False), _grants(t.get("grants", []))) for raw_token, t in auth.get("tokens", {}).items()}
    config = Config(**({"require_audit": True, "require_policy": True} | known))
    return Settings(config, indexes, store["uri"] if mode == "remote" else store.get("data_dir", "./hushdex-data"), tokens, raw.get("server", {}).get("log_level"), raw.get("audit", {}), raw.get("policy", {}))


def load(path: str | None) -> Settings:
    if path is None:
        return Settings()
    with open(path, encoding="utf-8") as f:
        return read(f.read())
