"""Command line: scan, sync, init, rules, describe.

Exit status: 0 clean, 1 findings at or above ``fail_on``, 2 an error, 130 interrupted."""

from __future__ import annotations

import argparse
import json
import stat
import sys
from dataclasses import asdict, fields
from pathlib import Path

from . import __version__
from .errors import ScanError
from .functions.severity import CONFIDENCES, SEVERITIES
from .operators import reports
from .sources import rules as rulesets
from .sources.config import ScanConfig

FORMATS = ("table", "json", "sarif", "csv", "markdown", "cache-json")


def _spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.appName("sparkwarden").config("spark.ui.showConsoleProgress", "false").config("spark.driver.extraJavaOptions", "-Xss16m").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def _scan_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--config")
    for name in ("exclude", "include", "rule-dirs", "select", "ignore-rules", "categories"):
        p.add_argument(f"--{name}", action="append", metavar=name.upper())
    p.add_argument("--severity", action="append", metavar="RULE=SEVERITY", help="override a rule's severity")
    p.add_argument("--min-severity")
    p.add_argument("--fail-on")
    p.add_argument("--min-confidence")
    p.add_argument("--entropy-threshold", type=float)
    p.add_argument("--max-file-bytes", type=int)
    p.add_argument("--max-findings", type=int)
    p.add_argument("--baseline")
    p.add_argument("--state-dir")
    for name in ("entropy", "suppressions", "respect-gitignore", "no-default-rules", "no-default-excludes"):
        p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--diff", metavar="REF")
    p.add_argument("--staged", action="store_true")
    p.add_argument("--audit", action="store_true", help="report suppressed findings with their reason")


def _run_scan(a: argparse.Namespace):
    from . import api

    names = {f.name for f in fields(ScanConfig)}
    given = {k: v for k, v in vars(a).items() if k in names and v is not None}
    given |= {"severity_overrides": dict(x.split("=", 1) for x in a.severity)} if a.severity else {}
    return api.scan(_spark(), a.path, config=a.config, diff=a.diff, staged=a.staged, audit=a.audit, **given)


def _emit(body: str, out: str | None) -> None:
    if out and out != "-":
        reports.put(out, body)
    else:
        sys.stdout.buffer.write(body.encode(sys.stdout.encoding or "utf-8", "replace") + b"\n")


def scan(a: argparse.Namespace) -> int:
    with _run_scan(a) as r:
        if a.write_baseline:
            reports.put(a.write_baseline, r.render("baseline"))
            return 0
        _emit(r.render(a.format), a.out)
        if a.emit_cache:
            r.write_cache()
        return int(r.failed())


def sync(a: argparse.Namespace) -> int:
    with _run_scan(a) as r:
        print(r.write_cache(merge=not a.replace), file=sys.stderr)
        return int(r.failed())


INIT = {
    ".sparkwarden.yml": "min_severity: low\nfail_on: high\nexclude:\n  - 'tests/fixtures/**'\n",
    ".github/workflows/scan.yml": "on: [push, pull_request]\njobs:\n  scan:\n    runs-on: ubuntu-latest\n    steps:\n      - uses: actions/checkout@v4\n      - run: python -m sparkwarden scan . --format sarif --out scan.sarif\n",
    ".git/hooks/pre-commit": "#!/bin/sh\nexec python -m sparkwarden scan . --staged\n",
}


def init(a: argparse.Namespace) -> int:
    root = Path(a.path)
    for name, body in INIT.items():
        p = root / name
        if name.startswith(".git/") and not (root / ".git").is_dir() or p.exists() and not a.force:
            print(f"left alone: {name}", file=sys.stderr)
            continue
        reports.put(p, body)
        if "hooks" in name:
            p.chmod(p.stat().st_mode | stat.S_IXUSR | stat.S_IXGRP | stat.S_IXOTH)
    baseline = root / ".sparkwarden-baseline.json"
    if a.baseline and (a.force or not baseline.exists()):
        from . import api

        reports.put(baseline, api.scan(_spark(), root).render("baseline"))
    return 0


def rules(a: argparse.Namespace) -> int:
    every = rulesets.load(tuple(a.rule_dirs or ()), bundled=not a.no_default_rules)
    if a.what == "validate":
        tests = rulesets.self_test(every)
        bad = [t for t in tests if t[2] != t[3]]
        for rule, example, want, _ in bad:
            print(f"{rule}: should {'' if want else 'not '}match: {example}", file=sys.stderr)
        missing = [(r.id, k) for r in every for k in ("cwe", "remediation", "description") if not getattr(r, k)]
        for rule, what in missing if not bad else ():
            print(f"warning: {rule}: no {what}", file=sys.stderr)
        print(f"{len({r.category for r in every})} categories, {len({x for r in every for x in r.languages})} languages, {len(missing)} warnings")
        print(f"{len(every)} rules, {len(tests)} examples over {len({t[0] for t in tests})} rules, {sum(not r.prefilters for r in every)} without prefilter, {len(bad)} failures")
        return 2 if bad else 0
    if a.what == "show":
        every = [r for r in every if r.id == a.id]
        if not every:
            raise ScanError(f"there is no rule {a.id}")
    every = [r for r in every if (not a.category or r.category == a.category) and (not a.language or a.language in r.languages) and (not a.severity or r.severity == a.severity)]
    every.sort(key=lambda r: (SEVERITIES.index(r.severity), r.id))
    print(json.dumps([asdict(r) for r in every], indent=2) if a.json or a.what == "show" else rule_table(every))
    return 0


def rule_table(every: list[rulesets.Rule]) -> str:
    """Columns as wide as what they hold, and a line with the number of rules."""
    head = ("severity", "rule", "languages", "cwe", "title")
    rows = [head, *((r.severity, r.id, ", ".join(r.languages), r.cwe or "-", r.title) for r in every)]
    width = [max(len(row[i]) for row in rows) for i in range(len(head) - 1)]
    lines = ["  ".join([*(c.ljust(w) for c, w in zip(row, width)), row[-1]]) for row in rows]
    return "\n".join([lines[0], "  ".join("-" * w for w in (*width, 5)), *lines[1:], f"{len(every)} rules"])


def contract() -> dict:
    every = rulesets.load()
    return {
        "tool": reports.TOOL, "version": __version__, "contract_version": reports.CONTRACT_VERSION, "formats": list(FORMATS), "severities": list(SEVERITIES), "confidences": list(CONFIDENCES),
        "exit_codes": {"0": "clean", "1": "findings at or above fail_on", "2": "error", "130": "interrupted"}, "fields": list(reports.JSON_FIELDS), "config_keys": sorted(f.name for f in fields(ScanConfig)),
        "rules": {"count": len(every), "categories": sorted({r.category for r in every}), "languages": sorted({x for r in every for x in r.languages})},
    }


def describe(a: argparse.Namespace) -> int:
    print(json.dumps(contract(), indent=2))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkwarden", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(required=True)
    s = sub.add_parser("scan")
    _scan_options(s)
    s.add_argument("--format", choices=FORMATS, default="table")
    s.add_argument("--out")
    s.add_argument("--write-baseline")
    s.add_argument("--emit-cache", action="store_true")
    s.set_defaults(run=scan)
    s = sub.add_parser("sync")
    _scan_options(s)
    s.add_argument("--replace", action="store_true")
    s.set_defaults(run=sync)
    s = sub.add_parser("init")
    s.add_argument("path", nargs="?", default=".")
    s.add_argument("--force", action="store_true")
    s.add_argument("--baseline", action="store_true")
    s.set_defaults(run=init)
    s = sub.add_parser("rules")
    s.add_argument("what", choices=("list", "show", "validate"))
    s.add_argument("id", nargs="?")
    for x in ("category", "language", "severity"):
        s.add_argument(f"--{x}")
    s.add_argument("--rule-dirs", action="append")
    s.add_argument("--no-default-rules", action="store_true")
    s.add_argument("--json", action="store_true")
    s.set_defaults(run=rules)
    s = sub.add_parser("describe")
    s.set_defaults(run=describe)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a)
    except KeyboardInterrupt:
        return 130
    except (ScanError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
