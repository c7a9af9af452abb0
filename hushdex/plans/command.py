"""Text commands: parse, check access, run, answer with plain JSON values."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from hushdex.errors import HushError, InternalError, InvalidArgument
from hushdex.operators.engine import Engine
from hushdex.operators.search import parse_mode
from hushdex.plans.guard import ADMIN, READ, WRITE, AuthContext, Need

ENGINE_NAME, ENGINE_VERSION, PROTOCOL = "hushdex", "0.1.0", "hushdex/1"


@dataclass(frozen=True)
class Form:
    """Shape of a command: positional arguments, options that take a value, flags."""

    usage: str
    args: tuple[str, ...] = ()
    options: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    rest: str | None = None
    scope: str | None = None


#: Commands by name. Arguments beyond a form's own are ignored, options follow them.
FORMS = {
    "AUTH": Form("AUTH <token>", ("token",)),
    "INDEX CREATE": Form("INDEX CREATE <name>", ("index",), scope=ADMIN),
    "INDEX ROTATE": Form("INDEX ROTATE <name>", ("index",), scope=ADMIN),
    "INDEX DESTROY": Form("INDEX DESTROY <name>", ("index",), scope=ADMIN),
    "INDEX REINDEX": Form("INDEX REINDEX <name>", ("index",), scope=ADMIN),
    "INDEX RECONCILE": Form("INDEX RECONCILE <name> <id> [<id> ...]", ("index",), rest="ids", scope=ADMIN),
    "INDEX LIST": Form("INDEX LIST"),
    "INDEX INFO": Form("INDEX INFO <name>", ("index",), scope=READ),
    "TOKENIZE": Form("TOKENIZE <index> <base64> [FIELD <name>]", ("index", "data"), ("FIELD",), scope=READ),
    "PUT": Form("PUT <index> <id> <base64> [FIELD <name>] [BLIND]", ("index", "id", "data"), ("FIELD",), ("BLIND",), scope=WRITE),
    "DELETE": Form("DELETE <index> <id>", ("index", "id"), scope=WRITE),
    "SEARCH": Form("SEARCH <index> <query> [MODE exact|contains|prefix|fuzzy] [FIELD <name>] [LIMIT <n>] [BLIND]", ("index", "query"), ("MODE", "FIELD", "LIMIT"), ("BLIND",), scope=READ),
    "HEALTH": Form("HEALTH"),
    "PING": Form("PING"),
    "COMMAND": Form("COMMAND"),
    "HELLO": Form("HELLO"),
}


@dataclass(frozen=True)
class Command:
    name: str
    values: dict = field(default_factory=dict)

    @property
    def need(self) -> Need:
        scope = FORMS[self.name].scope
        return Need(scope, self.values.get("index") if scope in (READ, WRITE) else None)


def parse(words: list[str]) -> Command:
    """A command of its words; verbs and keywords in any case."""
    if not words:
        raise InvalidArgument("empty command")
    verb, rest = words[0].upper(), list(words[1:])
    if verb == "INDEX":
        if not rest:
            raise InvalidArgument("INDEX requires a subcommand")
        verb = f"INDEX {rest.pop(0).upper()}"
    form = FORMS.get(verb)
    if form is None:
        raise InvalidArgument(f"unknown command: {verb if ' ' in verb else words[0]}")
    if len(rest) < len(form.args) + bool(form.rest):
        raise InvalidArgument(form.usage)
    values: dict = dict(zip(form.args, rest, strict=False))
    tail = rest[len(form.args) :]
    if form.rest:
        return Command(verb, values | {form.rest: tail})
    k = 0
    while k < len(tail):
        key = tail[k].upper()
        if key in form.options and k + 1 < len(tail):
            values.setdefault(key.lower(), tail[k + 1])
            k += 1
        elif key in form.flags:
            values[key.lower()] = True
        k += 1
    if "limit" in values:
        if not values["limit"].removeprefix("+").isdecimal():
            raise InvalidArgument(f"invalid LIMIT: {values['limit']}")
        values["limit"] = int(values["limit"])
    return Command(verb, values)


def run(engine: Engine, command: Command, context: AuthContext | None = None) -> object:
    """Access check, then the command's reply."""
    command.need.check(context)
    v, actor = command.values, context.actor if context else None
    name = v.get("index", "")
    match command.name:
        case "AUTH":
            raise InvalidArgument("AUTH belongs to the session")
        case "INDEX CREATE":
            i = engine.create(name, actor)
            return {"status": "ok", "index": i.name, "created_at": i.created_at, "tokenizer_version": i.tokenizer_version}
        case "INDEX ROTATE":
            i = engine.rotate(name, actor)
            return {"status": "ok", "index": i.name, "rotated_at": i.created_at, "entry_count": i.entry_count}
        case "INDEX DESTROY":
            return {"status": "ok", "index": name, "deleted_entries": engine.destroy(name, actor)}
        case "INDEX REINDEX":
            i, cleared = engine.reindex(name, actor)
            return {"status": "ok", "index": i.name, "tokenizer_version": i.tokenizer_version, "entries_cleared": cleared}
        case "INDEX RECONCILE":
            return {"status": "ok", "index": name, "orphans_removed": engine.reconcile(name, v["ids"], actor)}
        case "INDEX LIST":
            return engine.names()
        case "INDEX INFO":
            i = engine.info(name)
            return {"index": i.name, "created_at": i.created_at, "entry_count": i.entry_count, "tokenizer_version": i.tokenizer_version}
        case "TOKENIZE":
            words, trigrams = engine.tokenize(name, v["data"], v.get("field"))
            return {"status": "ok", "words": len(words), "trigrams": len(trigrams), "tokens": {"words": words, "trigrams": trigrams}}
        case "PUT":
            return {"status": "ok", "id": v["id"], "version": engine.put(name, v["id"], v["data"], v.get("field"), v.get("blind", False), actor)}
        case "DELETE":
            engine.delete(name, v["id"], actor)
            return {"status": "ok", "id": v["id"]}
        case "SEARCH":
            try:
                mode = parse_mode(v.get("mode", "contains"))
            except ValueError as e:
                raise InvalidArgument(str(e)) from e
            got = engine.search(name, v["query"], mode, v.get("field"), v.get("limit"), v.get("blind", False), actor)
            n = got.stats.first()
            return {"status": "ok", "scanned": n["scanned"], "matched": n["matched"], "results": [{"id": r["entry_id"], "score": r["score"]} for r in got.hits.collect()]}
        case "HEALTH":
            return {"status": "ok"}
        case "PING":
            return "PONG"
        case "COMMAND":
            return {"count": len(FORMS), "commands": list(FORMS)}
        case _:
            return {"engine": ENGINE_NAME, "version": ENGINE_VERSION, "protocol": PROTOCOL, "commands": list(FORMS), "capabilities": []}


class Session:
    """One caller: remembers whom AUTH made it. Without ``tokens`` access rules are off."""

    def __init__(self, engine: Engine, tokens: dict[str, AuthContext] | None = None) -> None:
        self.engine, self.tokens, self.context = engine, tokens, None if tokens is None else AuthContext("anonymous")

    def call(self, words: list[str]) -> object:
        command = parse(words)
        if command.name == "AUTH":
            if self.tokens is not None:
                if command.values["token"] not in self.tokens:
                    raise InvalidArgument("unknown token")
                self.context = self.tokens[command.values["token"]]
            return {"status": "ok"}
        return run(self.engine, command, self.context)

    def execute(self, words: list[str]) -> str:
        """The wire form: JSON, or ``ERR`` and a message."""
        try:
            return json.dumps(self.call(words), ensure_ascii=False)
        except HushError as e:
            return f"ERR {e}"
        except Exception as e:  # whatever Spark or the store raise is an answer too
            return f"ERR {InternalError(type(e).__name__)}"


def shell_split(line: str) -> list[str]:
    """Words of a console line; blanks within braces or brackets do not separate."""
    out, word, depth = [], "", 0
    for c in line:
        if c in " \t" and depth == 0:
            out, word = out + [word] if word else out, ""
            continue
        depth += (c in "{[") - (c in "}]")
        word += c
    return out + [word] if word else out
