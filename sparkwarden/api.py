"""Scan a tree or a table from Python."""

from __future__ import annotations

import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import filters, match, native, reports, suppress
from .sources import config as configs
from .sources import files as sources
from .sources import git, known
from .sources import rules as rulesets
from .sources.config import ScanConfig
from .sources.rules import Rule


@dataclass
class ScanResult:
    """Lazy tables of a scan; ``stats`` and the reports run it."""

    spark: SparkSession
    config: ScanConfig
    files: DataFrame
    disposed: DataFrame
    rules_loaded: int
    rules_run: int
    at: str
    began: float

    @property
    def findings(self) -> DataFrame:
        """What is reported, in order, cut at the cap."""
        return filters.capped(self.disposed.where("disposition = 'kept'").drop("disposition"), self.config.max_findings)

    def stats(self) -> dict:
        walked = {r.reason: r.n for r in filters.walk_stats(self.files).collect()}
        went = filters.counts(self.disposed).first().asDict()
        kept = min(went["kept"], self.config.max_findings) if self.config.max_findings else went["kept"]
        names = {"excluded": "skipped_excluded", "ignored": "skipped_ignored", "unknown": "skipped_unknown", "large": "skipped_large", "binary": "skipped_binary", "unreadable": "unreadable"}
        return {
            "root": self.config.root, "files_considered": sum(walked.values()), "files_scanned": walked.get("", 0), **{v: walked.get(k, 0) for k, v in names.items()},
            "rules_loaded": self.rules_loaded, "rules_run": self.rules_run, "findings": kept, **{k: went[k] for k in ("suppressed", "baselined", "filtered")},
            "truncated": bool(self.config.max_findings) and went["kept"] >= self.config.max_findings, "scanned_at": self.at, "duration_ms": round(1000 * (time.monotonic() - self.began)),
        }

    def tally(self) -> dict[str, int]:
        return {r.severity: r.n for r in filters.tally(self.findings).collect()}

    def worst_severity(self) -> str | None:
        return filters.worst(self.disposed.where("disposition = 'kept'"))

    def close(self) -> None:
        """Let go of what ``scan`` keeps between reports."""
        self.disposed.unpersist()
        self.files.unpersist()

    def __enter__(self) -> ScanResult:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def failed(self) -> bool:
        return filters.fails(self.findings, self.config.fail_on)

    def cache_rows(self) -> DataFrame:
        return reports.cache_rows(self.findings, self.at)

    def render(self, fmt: str) -> str:
        if fmt == "json":
            return reports.to_json(self.findings, self.stats())
        if fmt == "sarif":
            return reports.to_sarif(self.findings, self.at)
        if fmt == "cache-json":
            import json

            return json.dumps(reports.to_cache(self.findings, self.stats(), self.at), indent=2)
        if fmt == "csv":
            return reports.to_csv(self.findings)
        if fmt == "markdown":
            return reports.to_markdown(self.findings, self.stats(), self.tally())
        if fmt == "table":
            return reports.to_terminal(self.findings, self.stats(), self.tally())
        if fmt == "baseline":
            return reports.baseline_document(self.findings)
        raise ValueError(f"unknown format: {fmt}")

    def write_cache(self, folder: str | Path | None = None, merge: bool = True) -> Path:
        return reports.write_cache(self.findings, self.stats(), folder or self.config.state_dir, self.at, merge)


def active_rules(config: ScanConfig) -> tuple[list[Rule], list[Rule]]:
    loaded = rulesets.load(config.rule_dirs, bundled=not config.no_default_rules)
    return loaded, rulesets.select(loaded, config.select, config.ignore_rules, config.categories)


def scan_files(spark: SparkSession, files: DataFrame, config: ScanConfig = ScanConfig(), audit: bool = False) -> ScanResult:
    """Scan rows of ``sources.files.SCHEMA``."""
    began = time.monotonic()
    loaded, active = active_rules(config)
    if config.match_engine == "native":
        safe = [r for r in active if r.engine == "native"]
        passed = native.may_match([r for r in active if r.engine != "native"], config.entropy)
        raw = with_native(files.where(~passed), safe, config).unionByName(match.raw_findings(files.where(passed), active, config))
    else:
        raw = match.raw_findings(files, active, config)
    findings = match.with_rule_texts(raw, active, config)
    baseline = known.baseline(spark, config.baseline) if config.baseline else None
    return ScanResult(spark, config, files, filters.disposed(findings, baseline, config, audit), len(loaded), len(active), reports.now(), began)


def with_native(files: DataFrame, rules: list[Rule], config: ScanConfig) -> DataFrame:
    """Findings of the expression engine in the columns of the pass.

    Secrets of a file are masked in all its findings, so a file must go to one
    engine as a whole: ``scan_files`` sends those that the other rules or the
    entropy search may match to the pass, with all rules."""
    x = native.findings(files, rules, config.number_by_line)
    comments = suppress.table(files.where("reason = ''").withColumn("path", F.col("relpath")))
    x = suppress.apply(x, comments) if config.suppressions else x.withColumn("suppressed", F.lit(False)).withColumn("suppressed_by", F.lit(""))
    return x.withColumn("name", F.lit("")).withColumn("bits", F.lit(0.0)).withColumn("size", F.lit(0)).select(*match.RAW.names)


def scan(spark: SparkSession, path: str | Path = ".", *, config: str | Path | None = None, diff: str | None = None, staged: bool = False, audit: bool = False, **options: object) -> ScanResult:
    """Scan a tree; ``diff`` and ``staged`` limit it to changed files, ``audit`` reports suppressed findings."""
    merged = configs.load(path, config).merge(**options).check()
    paths = git.changed(path, diff, staged) if diff is not None or staged else None
    result = scan_files(spark, sources.read_tree(spark, merged, paths).persist(), merged, audit)
    result.disposed = result.disposed.persist()  # stats, findings and tally share one matching pass; ``close`` lets go
    return result


def scan_table(spark: SparkSession, table: DataFrame, path: Column, text: Column, config: ScanConfig = ScanConfig()) -> ScanResult:
    return scan_files(spark, sources.from_table(table, path, text, config), config)


def scan_to_cache(spark: SparkSession, path: str | Path, folder: str | Path | None = None, *, merge: bool = True, **options: object) -> ScanResult:
    result = scan(spark, path, **options)
    result.write_cache(folder, merge)
    return result
