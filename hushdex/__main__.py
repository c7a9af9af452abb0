"""Console: ``python -m hushdex [--config FILE] [COMMAND ...]``; without a command, a prompt."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from hushdex.errors import HushError
from hushdex.operators.engine import Config, Engine
from hushdex.plans.command import Session, shell_split
from hushdex.sources import config


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="hushdex")
    ap.add_argument("--config")
    ap.add_argument("--data")
    ap.add_argument("command", nargs="*")
    args = ap.parse_args(argv)
    settings = config.load(args.config)
    # The console has no policy or audit service of its own; a file that demands one is refused.
    wanted = settings.engine if args.config else Config()
    engine = Engine(SparkSession.builder.appName("hushdex").getOrCreate(), args.data or settings.root, wanted)
    engine.seed(list(settings.indexes))
    session = Session(engine, settings.tokens)
    if args.command:
        reply = session.execute(args.command)
        print(reply, file=sys.stderr if reply.startswith("ERR ") else sys.stdout)
        return int(reply.startswith("ERR "))
    while True:
        print("hushdex> ", end="", file=sys.stderr, flush=True)
        line = sys.stdin.readline()
        if not line or line.strip() in ("quit", "exit"):
            return 0
        if words := shell_split(line.strip()):
            try:
                print(json.dumps(session.call(words), ensure_ascii=False, indent=2))
            except HushError as e:
                print(f"error: {e}", file=sys.stderr)


if __name__ == "__main__":
    sys.exit(main())
