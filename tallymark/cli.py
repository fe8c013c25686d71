"""The command line: diff, run, explain, connections test. Exit codes: 0 match, 1 different, 2 no verdict."""

from __future__ import annotations

import argparse
import sys
import traceback

from tallymark import __version__, report
from tallymark.errors import CouldNotCompare
from tallymark.plans import config
from tallymark.plans.compare import compare, explain
from tallymark.session import session
from tallymark.sources import open_table, parse_spec, probe, redact
from tallymark.sources.specs import ENGINES

OUTPUTS = ("terminal", "json", "html")


def _pair(p: argparse.ArgumentParser) -> None:
    p.add_argument("source")
    p.add_argument("target")
    for name, said in {"key": "unique columns, with commas", "columns": "compare these only", "exclude": "leave these out", "where": "SQL filter of both sides", "where-source": "filter of the source instead", "where-target": "filter of the target instead", "column-map": "source:target pairs, with commas"}.items():
        p.add_argument(f"--{name}", help=said)
    p.add_argument("--trim", action="store_true", help="ignore spaces at the end of texts")
    p.add_argument("--case-insensitive", action="store_true", help="ignore case in texts")
    p.add_argument("--exact-floats", action="store_true", help="round doubles by their binary value, as other engines do")
    p.add_argument("--float-precision", type=int, default=15, help="significant digits of floating-point numbers")
    p.add_argument("--assume-tz", default="UTC", help="time zone of timestamps without one")
    p.add_argument("--algorithm", choices=("auto", "hashdiff", "joindiff"), default="auto")
    p.add_argument("--config", help="job file whose connections may be named")
    for side in ("option", "source-option", "target-option"):
        p.add_argument(f"--{side}", action="append", metavar="NAME=VALUE", help="for the reader of " + {"option": "both sides", "source-option": "the source", "target-option": "the target"}[side])
    p.add_argument("--verbose", action="store_true", help="plans and tracebacks on standard error")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("tallymark", description="Proves whether two tables hold the same rows.")
    top.add_argument("--version", action="version", version=f"tallymark {__version__}")
    commands = top.add_subparsers(dest="command", required=True)
    diff = commands.add_parser("diff", help="compare two tables")
    _pair(diff)
    diff.add_argument("--row-threshold", type=int, default=1000)
    diff.add_argument("--max-diff-rows", type=int, default=10_000)
    diff.add_argument("--threads", type=int, default=4, help="accepted for compatibility: Spark schedules the work")
    some = diff.add_mutually_exclusive_group()
    some.add_argument("--sample", help="percentage of the rows, the same rows on both sides and every time")
    some.add_argument("--sample-rows", type=int)
    diff.add_argument("--output", action="append", choices=OUTPUTS)
    diff.add_argument("--json-path")
    diff.add_argument("--html-path")
    diff.add_argument("--fail-on", choices=("none", "any", "count"), default="any")
    _pair(commands.add_parser("explain", help="print the plans, run nothing"))
    run = commands.add_parser("run", help="compare all pairs of a job file")
    run.add_argument("config")
    run.add_argument("--verbose", action="store_true")
    connections = commands.add_parser("connections").add_subparsers(dest="what", required=True)
    test = connections.add_parser("test", help="whether a connection answers")
    test.add_argument("name")
    test.add_argument("--config", default="tallymark.yaml")
    test.add_argument("--verbose", action="store_true")
    return top


def deliver(result, outputs, json_path: str | None, html_path: str | None, fail_on: str) -> None:
    for output in outputs:
        text = {"terminal": report.terminal, "json": report.as_json, "html": report.as_html}[output](result, fail_on)
        path = {"json": json_path, "html": html_path}.get(output)
        if output == "html" and not path:
            raise CouldNotCompare("HTML needs --html-path")
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)


def one(spark, source: str, target: str, request, held: config.Config, options: tuple[dict, dict] = ({}, {})):
    """Both tables opened: each with its connection's options, then those of the pair."""
    tables = []
    for text, own in ((source, options[0]), (target, options[1])):
        text = config.with_environment(text)
        known = {} if "://" in text else held.connection_options.get(text.partition("/")[0], {})
        tables.append(open_table(spark, parse_spec(text, held.connections), {**known, **own}))
    return *tables, request


def options_of(args) -> tuple[dict, dict]:
    """The reader options of the source and of the target."""

    def read(said: list[str] | None) -> dict[str, str]:
        pairs = [x.partition("=") for x in said or ()]
        if any(not name or not sep for name, sep, _ in pairs):
            raise CouldNotCompare("options are written name=value")
        return {name: value for name, _, value in pairs}

    both = read(args.option)
    return {**both, **read(args.source_option)}, {**both, **read(args.target_option)}


def whole_source(dsn: str) -> str:
    """A connection's DSN as something to probe: a database's may lack the table, which isn't asked for."""
    scheme, _, rest = dsn.rstrip("/").partition("://")
    return f"{dsn.rstrip('/')}/none" if scheme.lower() in ENGINES and rest.count("/") == 1 else dsn


def fail(error: Exception, verbose: bool) -> int:
    if verbose:
        traceback.print_exc()
    print(f"error: {redact(str(error))}", file=sys.stderr)
    return 2


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "connections":
            held = config.load(args.config)
            if args.name not in held.connections:
                raise CouldNotCompare(f"{args.config} has no connection {args.name}")
            probe(spark or session(), parse_spec(whole_source(held.connections[args.name])), held.connection_options.get(args.name))
            print(f"{args.name}: ok")
            return 0
        spark = spark or session()
        if args.command == "run":
            return run(spark, config.load(args.config), args.verbose)
        held = config.load(args.config) if args.config else config.Config({}, ())
        a, b, request = one(spark, args.source, args.target, config.request_of({k: v for k, v in vars(args).items() if v is not None}), held, options_of(args))
        if args.command == "explain":
            print(explain(a, b, request))
            return 0
        if args.verbose:
            print(explain(a, b, request), file=sys.stderr)
        result = compare(a, b, request)
        deliver(result, args.output or ["terminal"], args.json_path, args.html_path, args.fail_on)
        return result.exit_code(args.fail_on)
    except CouldNotCompare as e:
        return fail(e, args.verbose)
    except Exception as e:  # any other failure is no verdict either, never a match
        return fail(e, args.verbose)


def run(spark, held: config.Config, verbose: bool = False) -> int:
    """All pairs, each on its own: a failing one doesn't stop the rest. The worst code counts."""
    worst = 0
    for job in held.jobs:
        try:
            result = compare(*one(spark, job.source, job.target, job.request, held, job.options))
            deliver(result, job.output, job.json_path, job.html_path, job.fail_on)
            worst = max(worst, result.exit_code(job.fail_on))
        except Exception as e:
            worst = max(worst, fail(e, verbose))
    return worst


if __name__ == "__main__":
    sys.exit(main())
