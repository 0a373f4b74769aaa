"""Command line: schema check/fmt/diff, a log store's reads, writes and administration, and a node's verbs.

Exit codes: 0 done, 1 refused or failed, 2 wrong usage. Rows are printed as one JSON object per line.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from tidemark.functions.errors import Failure


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidemark").getOrCreate()


def _show(df) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def schema(args) -> int:
    from tidemark.schema.diff import BREAKING, diff_derivation, diff_domain
    from tidemark.schema.parser import check, parse
    from tidemark.schema.text import format_schema

    texts = [parse(Path(f).read_text(encoding="utf-8")) for f in args.files]
    if args.what == "fmt":
        print(format_schema(texts[0]), end="")
        return 0
    if args.what == "check":
        wrong = check(*texts[:2])
        print("\n".join(wrong))
        return int(bool(wrong))
    changes = (diff_domain if texts[0].layer == "domain" else diff_derivation)(*texts[:2])
    for c in changes:
        print(json.dumps(c.__dict__))
    return int(any(c.effect == BREAKING for c in changes))


def store(args) -> int:
    from tidemark.operators import log
    from tidemark.sources.store import Event, LogStore

    spark = _spark()
    if args.what == "init":
        print(LogStore.create(spark, args.path).manifest()["log_id"])
        return 0
    if args.what == "restore":
        print(LogStore.restore(spark, args.source, args.path).head)
        return 0
    s = LogStore(spark, args.path)
    if args.what == "append":
        expected = int(args.expected) if args.expected.isdigit() else args.expected
        print(s.append(args.stream, expected, [Event(args.family, json.loads(args.payload))], args.key))
    elif args.what == "all":
        log.check_from(s.events(), args.start)
        _show(log.read_all(s.events(args.start), args.start, args.limit))
    elif args.what == "stream":
        _show(log.read_stream(s.events(), args.stream, args.start, args.backward, args.limit))
    elif args.what == "type":
        _show(log.read_by_type(s.events(args.start), args.family, args.start, args.limit))
    elif args.what == "streams":
        _show(log.list_streams(s.events(), args.prefix))
    elif args.what == "heads":
        _show(log.stream_heads(s.events()))
    elif args.what == "truncate":
        s.truncate(args.cut)
    elif args.what == "fence":
        print(s.fence())
    elif args.what == "backup":
        print(json.dumps(s.backup(args.dest, args.base)))
    elif args.what == "health":
        _show(s.health())
    return 0


def node(args) -> int:
    from tidemark.streaming.node import load

    n = load(_spark(), args.node, args.path)
    if args.what == "exec":
        print(n.exec(args.command, args.key, json.loads(args.payload), args.idempotency))
    elif args.what == "get":
        row, at = n.get(args.name, json.loads(args.key), args.token)
        print(json.dumps({"row": row, "token": at}, default=str))
    elif args.what == "scan":
        _show(n.scan(args.name, json.loads(args.prefix), args.limit, args.token)[0])
    elif args.what == "aggregate":
        state, version, at = n.aggregate(args.name, args.key)
        print(json.dumps({"state": state, "version": version, "token": at}, default=str))
    elif args.what == "process":
        _show(n.process(args.name))
    elif args.what == "snapshots":
        for s in n.snapshots(args.name):
            print(json.dumps(s))
    elif args.what == "snapshot":
        print(json.dumps(n.snapshot(args.name)))
    elif args.what == "drop-snapshot":
        n.drop_snapshot(args.name, args.snapshot)
    elif args.what == "rebuild":
        print(n.rebuild(args.name, args.snapshot))
    elif args.what == "health":
        for row in n.health():
            print(json.dumps(row))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark")
    kinds = top.add_subparsers(dest="group", required=True)
    p = kinds.add_parser("schema")
    p.add_argument("what", choices=["check", "fmt", "diff"])
    p.add_argument("files", nargs="+")
    p.set_defaults(run=schema)
    p = kinds.add_parser("log")
    p.add_argument("path")
    whats = p.add_subparsers(dest="what", required=True)
    p.set_defaults(run=store)
    q = kinds.add_parser("node")
    q.add_argument("node", help="file.py:function")
    q.add_argument("path")
    verbs = q.add_subparsers(dest="what", required=True)
    q.set_defaults(run=node)
    _add(verbs, {
        "exec": {"command": str, "key": str, "payload": str, "--idempotency": None},
        "get": {"name": str, "key": str, "--token": None}, "scan": {"name": str, "--prefix": "{}", "--limit": 0, "--token": None},
        "aggregate": {"name": str, "key": str}, "process": {"name": str}, "health": {},
        "snapshots": {"name": str}, "snapshot": {"name": str}, "drop-snapshot": {"name": str, "snapshot": str}, "rebuild": {"name": str, "--snapshot": None},
    })
    _add(whats, {
        "init": {}, "heads": {}, "fence": {}, "health": {},
        "append": {"stream": str, "family": str, "payload": str, "--expected": "any", "--key": None},
        "all": {"--start": 0, "--limit": 100}, "stream": {"stream": str, "--start": 0, "--limit": 100, "--backward": False},
        "type": {"family": str, "--start": 0, "--limit": 100}, "streams": {"--prefix": ""},
        "truncate": {"cut": int}, "backup": {"dest": str, "--base": 0}, "restore": {"source": str},
    })
    return top


def _add(verbs, options: dict[str, dict]) -> None:
    """Sub-commands with their arguments: a type for those that are needed, a default for the others."""
    for what, own in options.items():
        q = verbs.add_parser(what)
        for name, kind in own.items():
            if not name.startswith("--"):
                q.add_argument(name, type=kind)
            elif kind is False:
                q.add_argument(name, action="store_true")
            else:
                q.add_argument(name, default=kind, type=type(kind) if kind is not None else str)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except Failure as e:
        print(f"{e.status}: {e}", file=sys.stderr)
        return 1
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
