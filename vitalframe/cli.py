"""Command line: analyze, history, drift, schema, compare, ask, glossary, sources, version."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from datetime import date

from . import session
from .operators import compare, contract, drift, profile, runs
from .operators.filters import flatten, run_query
from .plans import analyze, decide
from .sinks import history, notify, report
from .sources import connections, registry

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vitalframe")
    sub = p.add_subparsers(dest="command", required=True)
    source = argparse.ArgumentParser(add_help=False)
    source.add_argument("source", help="path, or the name of a connection with --connections")
    source.add_argument("--type", default="file")
    source.add_argument("--connections")
    source.add_argument("--objects", nargs="*")
    source.add_argument("--as-of", default=date.today().isoformat())
    a = sub.add_parser("analyze", parents=[source])
    a.add_argument("--schema", nargs="*", default=[])
    a.add_argument("--history")
    a.add_argument("--tag")
    a.add_argument("--out")
    a.add_argument("--rules", help="drift rules, JSON or YAML")
    a.add_argument("--compare-to", help="previous, baseline:<tag> or rolling; the rules' compare_to unless given")
    a.add_argument("--fail-on", default="never", choices=("never", "warn", "fail"))
    a.add_argument("--min-score")
    a.add_argument("--max-drop")
    a.add_argument("--notify", nargs="*", default=[])
    a.add_argument("--pii-ignore", nargs="*", default=[])
    h = sub.add_parser("history")
    h.add_argument("root")
    h.add_argument("--purge-days", type=int)
    d = sub.add_parser("drift")
    d.add_argument("root")
    d.add_argument("old")
    d.add_argument("new")
    s = sub.add_parser("schema", parents=[source])
    s.add_argument("--against", nargs="*", default=[])
    c = sub.add_parser("compare")
    c.add_argument("old")
    c.add_argument("new")
    c.add_argument("--key", nargs="+", required=True)
    q = sub.add_parser("ask", parents=[source])
    q.add_argument("sql")
    sub.add_parser("glossary")
    sub.add_parser("sources")
    sub.add_parser("version")
    return p


def _tables(spark, args) -> dict:
    spec = {"type": args.type, "path": args.source, "objects": args.objects}
    if args.connections:
        found = connections.load_connection(args.connections, args.source)
        spec = {"type": found["source_type"], **found.get("params", {})}
    return {d.name: d.frame for d in registry.open_source(spark, spec)}


def _config(path: str | None) -> dict:
    if not path:
        return {}
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f) or {}
        return json.load(f)


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return _run(args)
    except (ValueError, FileNotFoundError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return decide.EXIT_ERROR


def _run(args: argparse.Namespace) -> int:
    if args.command == "glossary":
        print(report.glossary(), end="")
        return 0
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "sources":
        print("\n".join(registry.available()))
        return 0
    spark = session.build()
    if args.command == "history":
        h = history.History(spark, args.root)
        if args.purge_days is not None:
            print("\n".join(h.purge(args.purge_days, date.today().isoformat())))
            return 0
        print("\n".join(f"{tag}\t{day}" for tag, day in h.runs()))
        return 0
    if args.command == "drift":
        h = history.History(spark, args.root)
        found = runs.findings(h.stored(args.new), runs.Past(h.stored(args.old), args.old))
        rows = [r.asDict() for r in drift.ordered(found).collect()]  # findings are few
        print(json.dumps(rows, indent=1, default=str))
        return decide.EXIT_FAIL if any(r["severity"] == "fail" for r in rows) else decide.EXIT_OK
    if args.command == "compare":
        a, b = (next(iter(registry.open_source(spark, {"path": p}))).frame for p in (args.old, args.new))
        print(json.dumps([r.asDict() for r in compare.record_summary(a, b, args.key).collect()], indent=1))
        return 0
    tables = _tables(spark, args)
    if args.command == "ask":
        print(json.dumps(run_query({k.replace("/", "_"): flatten(v) for k, v in tables.items()}, args.sql), default=str))
        return 0
    expected = contract.load(getattr(args, "schema", None) or getattr(args, "against", None) or [])
    if args.command == "schema":
        run = analyze.analyze(tables, args.as_of, expected)
        if expected:
            print(json.dumps(contract.summary(run.checks), indent=1))
            return decide.EXIT_FAIL if any(c["status"] == "fail" for c in run.checks) else decide.EXIT_OK
        print(json.dumps(contract.infer(run.profile, run.counts), indent=1))
        return 0
    rules = drift.Rules(contract.drift_config(expected, _config(args.rules)))
    tag = args.tag or args.as_of
    h = history.History(spark, args.history) if args.history else None
    past = h.past(args.compare_to or rules.mode, tag, args.as_of, int(rules.rolling["window"])) if h else None
    run = analyze.analyze(tables, args.as_of, expected, past, rules, pii_ignore=args.pii_ignore)
    summary = report.run_summary(run, tag, args.as_of)
    before: dict[str, float] = {}
    if h:
        if past and past.reference:
            old = past.reference.metrics.where("object = '' and metric in ('dqi', 'health')").collect()  # a row per dimension
            before = {("dqi" if not r["path"] else r["path"]) if r["metric"] == "dqi" else "health": r["value"] for r in old}
        h.save_run(tag, args.as_of, run.stored, run.findings, {"health": run.health})
    if args.out:
        report.write_artifacts(args.out, summary, run.findings, run.checks)
    print(json.dumps(summary, indent=1, default=str))
    code, why = decide.gates(summary["scores"], summary["drift"], summary["contract"], args.fail_on, decide.parse_gates(args.min_score), decide.parse_gates(args.max_drop), before)
    for line in why:
        print(line, file=sys.stderr)
    if args.notify:
        numbers = notify.context({"overall_dqi": summary["scores"]["dqi"] or 0}, run.pii, [r.asDict() for r in run.profile.collect()])
        for line in notify.notify(args.notify, notify.evaluate(numbers, source=tag)):
            print(line, file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
