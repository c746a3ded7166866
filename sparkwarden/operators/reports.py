"""Reports: JSON, SARIF, CSV, Markdown, terminal, and the findings cache.

Rows are shaped by DataFrame expressions; only the envelope and the last
formatting are done on the driver, over an ordered iterator.  ``write_rows``
keeps everything on the executors for results too large for one file."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile
from collections.abc import Iterable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import __version__
from ..functions import text
from ..functions.severity import SEVERITIES, rank_column
from ..sources.known import cached_rows

TOOL = "sparkwarden"
CONTRACT_VERSION = 1

# Field order of the outputs, and how severities fold onto SARIF.
JSON_FIELDS = ("key", "fingerprint", "rule_id", "title", "severity", "confidence", "category", "cwe", "owasp", "path", "line", "end_line", "column", "language", "match", "snippet", "description", "remediation", "references", "tags", "suppressed_by")
CSV_FIELDS = ("key", "severity", "confidence", "rule_id", "path", "line", "title", "cwe", "category", "match")
LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SCORE = {"critical": "9.5", "high": "8.0", "medium": "5.5", "low": "3.0", "info": "1.0"}
STORE = "scan"


def _case(c: Column, values: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def json_rows(findings: DataFrame) -> DataFrame:
    return findings.select(*JSON_FIELDS)


def csv_rows(findings: DataFrame) -> DataFrame:
    return findings.select(*CSV_FIELDS)


def cache_rows(findings: DataFrame, at: str) -> DataFrame:
    """The 25 fields of a findings cache."""
    none = lambda t: F.lit(None).cast(t)
    about = F.concat_ws("\n\n", F.when(F.col("description") != "", F.col("description")).otherwise(F.col("title")), F.format_string("Found by local rule %s (%s confidence) at %s.", "rule_id", "confidence", "location"), F.lit("A static match, not a proven exploit: confirm that it can be reached."))
    shown = F.when(F.size("context") > 0, F.array_join("context", "\n")).when(F.col("snippet") != "", F.col("snippet"))
    extra = F.when((F.col("match") != "") & ~F.col("snippet").contains(F.col("match")), F.concat(F.lit("\nmatched: "), F.col("match")))
    fix = F.concat_ws("\n\n", F.when(F.col("remediation") != "", F.col("remediation")), F.when(F.size("references") > 0, F.concat(F.lit("References:\n"), F.array_join(F.transform("references", lambda r: F.concat(F.lit("- "), r)), "\n"))))
    return findings.select(
        F.col("key").alias("ref"), F.lit(STORE).alias("store"), text.cache_id(F.col("fingerprint")).alias("id"), "title", "severity", F.lit("open").alias("status"), F.col("location").alias("affected_asset"), "category", F.col("cwe").alias("cwe_id"),
        none("double").alias("cvss_score"), F.lit("").alias("cvss_vector"), none("long").alias("project_id"), about.alias("description"), F.concat_ws("\n", "location", F.lit(""), shown, extra).alias("evidence"), fix.alias("remediation"), F.lit(at).alias("discovered_at"),
        F.lit(TOOL).alias("source"), none("long").alias("engagement_id"), F.lit("sast").alias("vector"), "rule_id", "fingerprint", "confidence", "path", "line", "language",
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One row a rule that fired, numbered by its first finding in report order."""
    order = W.partitionBy("rule_id").orderBy(rank_column(F.col("severity")), "path", "line", "column")
    first = findings.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")  # one row a rule from here on
    index = F.row_number().over(W.orderBy(rank_column(F.col("severity")), "path", "line", "rule_id", "column")) - 1
    name = F.replace(F.initcap(F.regexp_replace("rule_id", r"[.\-]", " ")), F.lit(" "), F.lit(""))
    tags = F.array_distinct(F.filter(F.concat(F.array(F.lit("security"), F.col("category")), "tags", F.array(F.when(F.col("cwe") != "", F.concat(F.lit("external/cwe/"), F.lower("cwe"))).otherwise(""))), lambda t: t != ""))
    return first.select(index.cast("int").alias("rule_index"), "rule_id", name.alias("name"), "title", F.when(F.col("description") != "", F.col("description")).otherwise(F.col("title")).alias("description"), _case(F.col("severity"), LEVEL, "warning").alias("level"), tags.alias("tags"), _case(F.col("severity"), SCORE, "5.5").alias("score"), "confidence", "remediation", "references")


def sarif_results(findings: DataFrame) -> DataFrame:
    index = sarif_rules(findings).select("rule_id", "rule_index")
    return findings.join(index, "rule_id").select("rule_id", "rule_index", _case(F.col("severity"), LEVEL, "warning").alias("level"), "title", "severity", "path", F.greatest("line", F.lit(1)).alias("line"), F.greatest("end_line", F.lit(1)).alias("end_line"), F.greatest(F.col("column") + 1, F.lit(1)).alias("column"), "snippet", "fingerprint", "confidence", "category", "cwe")


def merged_cache(fresh: DataFrame, existing: DataFrame) -> DataFrame:
    """Fresh rows, and earlier ones of other stores."""
    return fresh.unionByName(existing.where(F.coalesce("store", F.lit("")) != STORE), allowMissingColumns=True)


def write_rows(findings: DataFrame, path: str, fmt: str = "json") -> None:
    """Part files written by the executors, nulls kept."""
    (json_rows(findings).write.option("ignoreNullFields", "false").json(path) if fmt == "json" else csv_rows(findings).write.option("header", True).csv(path))


# ---- documents -------------------------------------------------------------


def _dicts(rows: Iterable[Row]) -> list[dict]:
    return [r.asDict(recursive=True) for r in rows]


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def to_json(findings: DataFrame, stats: dict) -> str:
    return json.dumps({"tool": TOOL, "version": __version__, "contract_version": CONTRACT_VERSION, "scan": stats, "findings": _dicts(json_rows(findings).toLocalIterator())}, indent=2)


def to_cache(findings: DataFrame, stats: dict, at: str) -> dict:
    scan = {k: stats.get(k) for k in ("root", "files_scanned", "rules_run", "duration_ms")}
    return {"fetched_at": at, "source": TOOL, "scan": scan, "findings": _dicts(cache_rows(findings, at).toLocalIterator())}


def to_csv(findings: DataFrame) -> str:
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(CSV_FIELDS)
    w.writerows(csv_rows(findings).toLocalIterator())
    return out.getvalue()


def to_sarif(findings: DataFrame, at: str) -> str:
    rules = []
    for r in _dicts(sarif_rules(findings).orderBy("rule_index").collect()):
        d = {"id": r["rule_id"], "name": r["name"], "shortDescription": {"text": r["title"]}, "fullDescription": {"text": r["description"]}, "defaultConfiguration": {"level": r["level"]}, "properties": {"tags": r["tags"], "security-severity": r["score"], "precision": r["confidence"]}}
        if r["remediation"]:
            links = "".join(f"\n- {x}" for x in r["references"])
            d["help"] = {"text": r["remediation"], "markdown": f"**{r['title']}**\n\n{r['remediation']}" + (f"\n\nReferences:\n{links}" if links else "")}
        rules.append(d)
    results = [
        {
            "ruleId": r["rule_id"], "ruleIndex": r["rule_index"], "level": r["level"], "message": {"text": f"{r['title']} ({r['severity']})"},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}, "region": {"startLine": r["line"], "endLine": r["end_line"], "startColumn": r["column"], "snippet": {"text": r["snippet"]}}}}],
            "partialFingerprints": {"scanFingerprint/v1": r["fingerprint"]}, "properties": {k: r[k] for k in ("confidence", "category", "cwe")},
        }
        for r in _dicts(sarif_results(findings).orderBy(rank_column(F.col("severity")), "path", "line", "rule_id", "column").toLocalIterator())
    ]
    run = {"tool": {"driver": {"name": TOOL, "version": __version__, "rules": rules}}, "invocations": [{"executionSuccessful": True, "endTimeUtc": at}], "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, indent=2)


def to_markdown(findings: DataFrame, stats: dict, tally: dict[str, int]) -> str:
    head = [
        "# Security scan", "", f"**{stats['files_scanned']} files**, {stats['rules_run']} rules, {stats['duration_ms']} ms: **{stats['findings']}** findings.", "",
        "| " + " | ".join(s.title() for s in SEVERITIES) + " |", "|" + "---|" * len(SEVERITIES), "| " + " | ".join(str(tally.get(s, 0)) for s in SEVERITIES) + " |", "",
    ]
    row = F.concat(
        F.format_string("## %s — %s\n\n- **Where:** `%s`\n- **Rule:** `%s` (%s confidence)\n", F.upper("severity"), "title", "location", "rule_id", "confidence"),
        F.when(F.col("cwe") != "", F.format_string("- **CWE:** %s\n", "cwe")).otherwise(""),
        F.format_string("\n```%s\n%s\n```\n\n", _case(F.col("language"), text.LEXERS, "text"), "snippet"),
        F.when(F.col("description") != "", F.concat("description", F.lit("\n\n"))).otherwise(""),
        F.when(F.col("remediation") != "", F.concat(F.lit("**Fix:** "), "remediation", F.lit("\n\n"))).otherwise(""),
    )
    body = [r[0] for r in findings.select(row).toLocalIterator()]
    return "\n".join(head) + ("".join(body) if body else "No findings at or above the severity floor.\n")


def to_terminal(findings: DataFrame, stats: dict, tally: dict[str, int], width: int = 100) -> str:
    out = []
    for r in findings.toLocalIterator():
        out += [f"{r.severity.upper():<8} {r.title}", f"  {r.location}  {r.rule_id}  ({r.confidence} confidence)", f"  --- {text.LEXERS.get(r.language, 'text')}", *(f"  {c[:width]}" for c in r.context), "  ---"]
        out += [f"  fix: {r.remediation}" if r.remediation else "", ""]
    return "\n".join(out) + summary(stats, tally)


def summary(stats: dict, tally: dict[str, int]) -> str:
    found = ", ".join(f"{n} {s}" for s, n in tally.items() if n) or "no findings"
    hidden = [f"{stats[k]} {k}" for k in ("suppressed", "baselined", "filtered") if stats.get(k)]
    return f"{found} in {stats['files_scanned']} files, {stats['rules_run']} rules, {stats['duration_ms']} ms" + (f"; not shown: {', '.join(hidden)}" if hidden else "") + ("; cut at the cap" if stats.get("truncated") else "") + "\n"


def baseline_document(findings: DataFrame) -> str:
    rows = findings.select("fingerprint", "rule_id", "severity", "path", "line", "title").toLocalIterator()
    return json.dumps({"fingerprints": _dicts(rows)}, indent=2)


def put(path: str | Path, body: str) -> None:
    """Whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
        f.write(body)
    os.replace(name, path)


def write_cache(findings: DataFrame, stats: dict, folder: str | Path, at: str, merge: bool = True) -> Path:
    path = Path(folder) / "findings.json"
    document = to_cache(findings, stats, at)
    if merge:
        document["findings"] += [r for r in cached_rows(path) if (r.get("store") or "") != STORE]
    put(path, json.dumps(document, indent=2))
    return path
