"""Matching: one pass over files.

All that depends on the whole of one file - gates, match order, occurrence
numbers, one finding a line, masking of the file's secrets, suppression comments
- is done where the file's row is, so no shuffle by path is needed.  Rule texts
are joined afterwards from the broadcast catalogue (at most ``MAX_RULES`` rows)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import globs, text
from ..sources.config import ScanConfig
from ..sources.rules import ENTROPY_RULE, Rule, as_table
from . import entropy, suppress

MAX_RULES = 20_000
FEED = re.compile("\n")
S, I, L = pa.string(), pa.int32(), pa.list_(pa.string())
RAW = pa.schema(
    [("rule_id", S), ("path", S), ("language", S), ("line", I), ("column", I), ("match", S), ("snippet", S), ("context", L), ("occurrence", I), ("fingerprint", S), ("suppressed", pa.bool_()), ("suppressed_by", S), ("name", S), ("bits", pa.float64()), ("size", I)]
)


@dataclass
class Hit:
    rule_id: str
    line: int
    column: int
    match: str
    snippet: str
    context: list[str]
    occurrence: int = 0
    name: str = ""
    bits: float = 0.0
    size: int = 0


@dataclass
class Matcher:
    """The active rules, compiled once in each task."""

    rules: list[Rule]
    config: ScanConfig
    ready: list[tuple] = field(default_factory=list)

    def compile(self) -> Matcher:
        for r in sorted(self.rules, key=lambda r: r.id):
            c = r.compile
            self.ready.append((r, [c(p) for p in r.patterns], [c(p) for p in r.not_patterns], c(r.requires) if r.requires else None, c(r.not_requires) if r.not_requires else None))
        return self

    def applies(self, r: Rule, names: tuple[str, ...], language: str) -> bool:
        if "any" not in r.languages and language not in r.languages:
            return False
        fits = lambda g: any(globs.matches(n, g) for n in names)
        return (not r.paths or fits(r.paths)) and not (r.exclude_paths and fits(r.exclude_paths))

    def hits(self, names: tuple[str, ...], language: str, body: str) -> list[Hit]:
        """Findings of one file, in order of emission, masked, one a rule and line."""
        low, rows = body.lower(), body.splitlines()
        feeds: list[int] | None = None  # line feeds of the file, looked for once and only if something matches
        secrets: dict[str, None] = {}
        out: list[Hit] = []
        for r, patterns, vetoes, needs, spares in self.ready:
            if not self.applies(r, names, language) or r.prefilters and not any(p in low for p in r.prefilters):
                continue
            if needs and not needs.search(body) or spares and spares.search(body):
                continue
            for rx in patterns:
                for m in rx.finditer(body):
                    whole = m[0]
                    start = m.start() + len(whole) - len(whole.lstrip())
                    if feeds is None:
                        feeds = [x.start() for x in FEED.finditer(body)]
                    line = bisect_left(feeds, start) + 1
                    shown = rows[line - 1] if line <= len(rows) else ""
                    if not any(v.search(shown) for v in vetoes):
                        secret = text.secret_span_text(whole.strip()) if r.category == "secrets" else ""
                        out.append(self.build(r.id, rows, line, start - (feeds[line - 2] + 1 if line > 1 else 0), whole.strip(), secret, secrets))
        if self.config.entropy:
            for n, row in enumerate(rows, 1):
                for name, value, bits, column in entropy.candidates(row, self.config.entropy_threshold):
                    h = self.build(ENTROPY_RULE, rows, n, column, text.mask_text(value), value, secrets)
                    h.name, h.bits, h.size = name, bits, len(value)
                    out.append(h)
        return self.finish(out, secrets, self.config.number_by_line)

    @staticmethod
    def build(rule_id: str, rows: list[str], line: int, column: int, match: str, secret: str, secrets: dict[str, None]) -> Hit:
        """The secret is masked before the match is cut, so no part of it can stay."""
        first = max(1, line - text.CONTEXT)
        shown = rows[line - 1].strip() if line <= len(rows) else ""
        context = [f"{n:>5} | {rows[n - 1]}" for n in range(first, min(len(rows), line + text.CONTEXT) + 1)]
        flat = text.collapse(match)
        if secret:
            secrets[secret] = None
            for form in (secret, text.collapse(secret)):
                if form:
                    masked = text.mask_text(secret)
                    shown, flat, context = shown.replace(form, masked), flat.replace(form, masked), [c.replace(form, masked) for c in context]
        return Hit(rule_id, line, max(0, column), flat[: text.MAX_MATCH], shown, context)

    @staticmethod
    def finish(hits: list[Hit], secrets: dict[str, None], by_line: bool = False) -> list[Hit]:
        seen: dict[tuple[str, str], int] = {}
        best: dict[tuple[str, int], Hit] = {}
        for h in hits:
            h.occurrence = seen.get((h.rule_id, h.match), 0)
            seen[h.rule_id, h.match] = h.occurrence + 1
            kept = best.setdefault((h.rule_id, h.line), h)
            if len(h.match) > len(kept.match):
                best[h.rule_id, h.line] = h
        if by_line:  # numbered anew, without the matches that their line leaves out
            seen.clear()
            for h in sorted(best.values(), key=lambda h: h.line):
                h.occurrence = seen.get((h.rule_id, h.match), 0)
                seen[h.rule_id, h.match] = h.occurrence + 1
        forms = {f: text.mask_text(s) for s in secrets for f in (text.collapse(s), s) if f}
        for form in sorted(forms, key=lambda f: (-len(f), f)):
            for h in best.values():
                h.match, h.snippet = h.match.replace(form, forms[form]), h.snippet.replace(form, forms[form])
                h.context = [c.replace(form, forms[form]) for c in h.context]
        return list(best.values())


def raw_findings(files: DataFrame, rules: list[Rule], config: ScanConfig) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(rules, config).compile()
        for b in batches:
            out = []
            for path, project, language, body in zip(*(b.column(c).to_pylist() for c in ("relpath", "project_path", "language", "text"))):
                found = matcher.hits((path, project), language, body)
                marks = suppress.parse(body) if found and config.suppressions else suppress.Suppressions()
                for h in found:
                    reason = marks.find(h.line, h.rule_id)
                    out.append((h.rule_id, path, language, h.line, h.column, h.match, h.snippet, h.context, h.occurrence, text.fingerprint_text(h.rule_id, path, h.match, h.occurrence), reason is not None, reason or "", h.name, h.bits, h.size))
            cols = list(zip(*out)) or [[] for _ in RAW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, RAW)], schema=RAW)

    return files.where("reason = ''").select("relpath", "project_path", "language", "text").mapInArrow(run, from_arrow_schema(RAW))


ENTROPY_TEXT = {
    "category": "secrets", "cwe": "CWE-798", "owasp": "A07:2021 Identification and Authentication Failures", "confidence": "low",
    "remediation": "Rotate the credential: history keeps it. Then read it from the environment or a secret store.",
}
COLUMNS = (
    "rule_id", "title", "severity", "confidence", "category", "cwe", "owasp", "path", "line", "end_line", "column", "language", "match", "snippet", "context",
    "description", "remediation", "references", "tags", "occurrence", "fingerprint", "key", "location", "suppressed", "suppressed_by",
)


def with_rule_texts(raw: DataFrame, rules: list[Rule], config: ScanConfig) -> DataFrame:
    """Findings with their rule's texts, overridden severities, key and location."""
    catalogue = as_table(raw.sparkSession, rules).select(F.col("id").alias("rule_id"), "title", "severity", "confidence", "category", "cwe", "owasp", "description", "remediation", "references", "tags")
    x = raw.join(F.broadcast(catalogue) if len(rules) <= MAX_RULES else catalogue, "rule_id", "left")
    is_entropy = F.col("rule_id") == ENTROPY_RULE
    fixed = {k: F.when(is_entropy, v).otherwise(F.col(k)) for k, v in ENTROPY_TEXT.items()}
    fixed["title"] = F.when(is_entropy, F.concat(F.lit("Possible hardcoded secret in "), "name")).otherwise(F.col("title"))
    fixed["description"] = F.when(is_entropy, F.format_string("%s is assigned a literal of %d characters with %s bits of entropy each, as credentials have. It is masked here.", "name", "size", F.col("bits").cast("string"))).otherwise(F.col("description"))
    fixed["references"] = F.when(is_entropy, F.array(F.lit("https://cwe.mitre.org/data/definitions/798.html"))).otherwise(F.col("references"))
    fixed["tags"] = F.when(is_entropy, F.array(F.lit("secret"), F.lit("entropy"))).otherwise(F.col("tags"))
    severity = F.when(is_entropy, "high").otherwise(F.col("severity"))
    for rule_id, s in config.severity_overrides.items():
        severity = F.when(F.col("rule_id") == rule_id, s).otherwise(severity)
    x = x.withColumns(fixed | {"severity": severity, "end_line": F.col("line"), "key": F.concat(F.lit("scan-"), F.substring("fingerprint", 1, 10)), "location": F.concat_ws(":", "path", F.col("line").cast("string"))})
    return x.select(*COLUMNS)
