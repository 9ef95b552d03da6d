"""Command line: ``python -m gridloom inspect | profile | export | codegen | apply``."""

from __future__ import annotations

import argparse
import json
import sys

from .plans import export
from .plans.view import View
from .session import session
from .sources import sinks
from .sources.registry import Engine


def steps(args: argparse.Namespace) -> list[dict]:
    """Operations from the flags; ``--filter`` is one predicate or a list of operations, as JSON."""
    ops: list[dict] = []
    if args.filter:
        raw = json.loads(args.filter)
        ops += raw if isinstance(raw, list) else [{"type": "filter", "predicate": raw}]
    if args.columns:
        ops.append({"type": "select", "columns": [c.strip() for c in args.columns.split(",")]})
    if args.sort:
        ops.append({"type": "sort", "keys": [{"column": args.sort, "descending": False, "nulls_last": True}]})
    if getattr(args, "limit", None) is not None:
        ops.append({"type": "limit", "n": args.limit})
    return ops


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridloom")
    top.add_argument("--master", default="local[*]")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("inspect", "profile"):
        sub.add_parser(name).add_argument("source")
    out = sub.add_parser("export")
    out.add_argument("--format", required=True, choices=sorted(sinks.CONTENT_TYPES))
    out.add_argument("-o", "--output", required=True)
    out.add_argument("--limit", type=int)
    code = sub.add_parser("codegen")
    code.add_argument("--target", required=True, choices=export.TARGETS)
    for p in (out, code):
        p.add_argument("source")
        for flag in ("--filter", "--columns", "--sort"):
            p.add_argument(flag)
    run = sub.add_parser("apply", help="a view file {source_id: URI, ops: [...]}")
    run.add_argument("view_file")
    run.add_argument("--format", required=True, choices=sorted(sinks.CONTENT_TYPES))
    run.add_argument("-o", "--output", required=True)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    engine = Engine(session(args.master))
    if args.command == "inspect":
        print(json.dumps(engine.inspect(args.source), indent=2))
    elif args.command == "profile":
        source = engine.register(args.source)
        for r in engine.profile(source.id).collect():
            print(json.dumps(r.asDict(), default=str))
    elif args.command == "apply":
        with open(args.view_file, encoding="utf-8") as f:
            raw = json.load(f)
        source = engine.register(raw["source_id"])
        engine.download(View.from_json(raw | {"source_id": source.id}), args.output, args.format)
    else:
        source = engine.register(args.source)
        view = View(source.id, steps(args))
        if args.command == "export":
            engine.download(view, args.output, args.format)
        else:
            print(engine.code(view, args.target))
    return 0


if __name__ == "__main__":
    sys.exit(main())
