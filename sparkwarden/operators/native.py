"""The same findings from Catalyst expressions alone, for rules that Java can run safely.

Used for a few rules at a time, and to check the pass in ``match``: every
literal pattern is one branch of a single array per file, so the corpus is read
once however many rules there are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import globs, regex, text
from ..sources.rules import Rule
from . import entropy


def gate(r: Rule, low: Column | None = None) -> Column:
    """Language, path, prefilter and file conditions, cheapest first; CASE keeps the order.  ``low`` is the text in lower case."""
    low = F.lower("text") if low is None else low
    java = lambda p: regex.to_java(p, r.ignore_case, r.dotall)
    fits = lambda g: globs.matches_column(F.col("relpath"), g) | globs.matches_column(F.col("project_path"), g)
    tests = [] if "any" in r.languages else [F.col("language").isin(*r.languages)]
    tests += ([fits(r.paths)] if r.paths else []) + ([~fits(r.exclude_paths)] if r.exclude_paths else [])
    tests += [reduce(Column.__or__, [low.contains(p) for p in r.prefilters])] if r.prefilters else []
    tests += ([F.col("text").rlike(java(r.requires))] if r.requires else []) + ([~F.col("text").rlike(java(r.not_requires))] if r.not_requires else [])
    out = F.lit(True)
    for t in reversed(tests):
        out = F.when(t, out).otherwise(False)
    return out


def may_match(rules: list[Rule], assignments: bool) -> Column:
    """Whether a file meets the language, path and literal gates of any of the rules, or, with ``assignments``, holds a credential's assignment."""
    loose = [replace(r, requires="", not_requires="") for r in rules]
    holds = [F.col("text").rlike("(?i)" + entropy.ANY_NAME) & F.col("text").rlike(entropy.ASSIGNMENT)] if assignments else []
    return F.coalesce(regex.bound(F.lower("text"), lambda low: reduce(Column.__or__, [gate(r, low) for r in loose] + holds, F.lit(False))), F.lit(False))


def tagged(rule_id: str, pattern: int) -> Callable[[Column], Column]:
    """A match of the rule, anchored past its leading white space."""

    def hit(m: Column) -> Column:
        lead = F.regexp_extract(m["match"], f"(?U)\\A{text.BLANK}*", 0)
        feeds = F.length(lead) - F.length(F.replace(lead, F.lit("\n"), F.lit("")))
        column = F.when(feeds > 0, F.length(F.substring_index(lead, "\n", -1))).otherwise(m["column"] + F.length(lead))
        return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(pattern).alias("pattern_idx"), (m["start"] + F.length(lead)).alias("start"), (m["feeds"] + feeds + 1).alias("line"), column.alias("column"), text.strip(m["match"]).alias("match"))

    return hit


def raw_matches(files: DataFrame, rules: list[Rule], lines: bool = False) -> DataFrame:
    """``relpath, language, rule_id, pattern_idx, start, line, column, match``, and with ``lines`` the text of the line and its context.

    All that needs the text is worked out before a file's matches become rows, so no row carries it."""
    none = F.array().cast("array<struct<rule_id:string,pattern_idx:int,start:int,line:int,column:int,match:string>>")

    def matches(r: Rule, low: Column) -> Column:
        found = [F.transform(regex.finditer(F.col("text"), regex.to_java(p, r.ignore_case, r.dotall)), tagged(r.id, i)) for i, p in enumerate(r.patterns)]
        return F.when(gate(r, low), F.flatten(F.array(*found))).otherwise(none)

    rows = files.where("reason = ''")
    hits = regex.bound(F.lower("text"), lambda low: F.flatten(F.array(none, *[matches(r, low) for r in rules])))
    if not lines:
        return rows.select("relpath", "language", F.explode(hits).alias("h")).select("relpath", "language", "h.*")
    shown = lambda h, x: F.struct(*[h[c].alias(c) for c in ("rule_id", "pattern_idx", "start", "line", "column", "match")], F.coalesce(F.get(x, h["line"] - 1), F.lit("")).alias("shown"), text.context(x, h["line"]).alias("context"))
    with_lines = regex.bound(F.struct(hits.alias("h"), text.lines(F.col("text")).alias("l")), lambda z: F.transform(z["h"], lambda h: shown(h, z["l"])))
    return rows.select("relpath", "language", F.explode(with_lines).alias("h")).select("relpath", "language", "h.*")


def placed(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Matches with snippet and context; those vetoed by their line are gone."""
    veto = F.lit(False)
    for r in rules:
        for p in r.not_patterns:
            veto = veto | ((F.col("rule_id") == r.id) & F.col("shown").rlike(regex.to_java(p, r.ignore_case, r.dotall)))
    return raw_matches(files, rules, lines=True).where(~veto).withColumn("snippet", text.strip(F.col("shown"))).drop("shown")


def occurrences(x: DataFrame, *order: str) -> DataFrame:
    """Number of the same match of a rule in a file, among the given rows."""
    return x.withColumn("occurrence", (F.row_number().over(W.partitionBy("relpath", "rule_id", "match").orderBy(*order)) - 1).cast("int"))


def one_per_line(x: DataFrame) -> DataFrame:
    """The longest match of a rule on a line, the first of equals."""
    w = W.partitionBy("relpath", "rule_id", "line").orderBy(F.desc(F.length("match")), "pattern_idx", "start")
    return x.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def masked(x: DataFrame) -> DataFrame:
    """Every secret of the file masked in match, snippet and context; needs ``secrets``."""
    return x.withColumns({"match": text.mask_all(F.col("match"), F.col("secrets")), "snippet": text.mask_all(F.col("snippet"), F.col("secrets")), "context": F.transform("context", lambda c: text.mask_all(c, F.col("secrets")))}).drop("secrets")


def findings(files: DataFrame, rules: list[Rule], by_line: bool = False) -> DataFrame:
    """``rule_id, path, language, line, column, match, snippet, context, occurrence, fingerprint``."""
    x = placed(files, rules)
    credentials = [r.id for r in rules if r.category == "secrets"]
    secret = F.when(F.col("rule_id").isin(*credentials), text.secret_span(F.col("match"))) if credentials else F.lit(None).cast("string")
    x = x.withColumn("secret", secret)
    own = F.when(F.col("secret").isNull(), F.array().cast("array<string>")).otherwise(F.array("secret"))
    flat = F.substring(text.mask_all(text.flat(F.col("match")), own), 1, text.MAX_MATCH)
    x = x.withColumns({"match": flat, "snippet": text.mask_all(F.col("snippet"), own), "context": F.transform("context", lambda c: text.mask_all(c, own))})
    x = x.repartition("relpath")  # one exchange serves all windows
    x = x if by_line else occurrences(x, "pattern_idx", "start")
    x = one_per_line(x.withColumn("secrets", F.collect_set("secret").over(W.partitionBy("relpath"))))
    x = masked(occurrences(x, "line") if by_line else x)
    return x.withColumn("fingerprint", text.fingerprint(F.col("rule_id"), F.col("relpath"), F.col("match"), F.col("occurrence"))).select("rule_id", F.col("relpath").alias("path"), "language", "line", "column", "match", "snippet", "context", "occurrence", "fingerprint")
