"""Suppression comments: ``scan: ignore`` for a line, ``scan: ignore-file`` for a file."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import globs, text

#: Any tool name that ends in "scan", or this package's; then optional rules and a reason.
COMMENT = r"(?:sparkwarden|[A-Za-z0-9_\-]*scan)\s*[:\s]\s*ignore(-file)?(?:\s*\[([^\]]*)\])?(?:\s*(?:--|—|:)\s*(.+))?"
OPENERS = ("", "#", "//", "/*", "*", "<!--", "--", ";", "%", "'''", '"""', "*/")  # fixed value: what may stand before a comment alone on its line
_COMMENT = re.compile(COMMENT, re.I)


@dataclass
class Suppressions:
    """Of one file: rule globs and reason of each, an empty list meaning every rule."""

    file: list[tuple[tuple[str, ...], str]] = field(default_factory=list)
    lines: dict[int, tuple[tuple[str, ...], str]] = field(default_factory=dict)

    def find(self, line: int, rule_id: str) -> str | None:
        """The reason, which may be empty, or None."""
        for rules, reason in self.file:
            if not rules or globs.matches(rule_id, rules, paths=False):
                return reason
        rules, reason = self.lines.get(line, (None, ""))
        return reason if rules is not None and (not rules or globs.matches(rule_id, rules, paths=False)) else None


def parse(body: str) -> Suppressions:
    """A trailing comment covers its line; one alone on its line the next, unless that has its own."""
    out, below = Suppressions(), {}
    if "ignore" not in body.lower():
        return out
    for n, line in enumerate(body.splitlines(), 1):
        if not (m := _COMMENT.search(line)):
            continue
        entry = (tuple(x for x in map(str.strip, (m[2] or "").split(",")) if x), (m[3] or "").strip())
        if m[1]:
            out.file.append(entry)
        elif line[: m.start()].strip() in OPENERS:
            below.setdefault(n + 1, entry)
        else:
            out.lines[n] = entry
    out.lines = below | out.lines
    return out


def table(files: DataFrame) -> DataFrame:
    """``path, kind, comment_line, target_line, rules, reason`` of every comment, natively."""
    rx = "(?i)" + COMMENT
    rows = files.select("path", F.posexplode(text.lines(F.col("text"))).alias("i", "line")).where(F.col("line").rlike(rx))
    part = lambda k: F.regexp_extract("line", rx, k)
    before = text.strip(F.substring("line", F.lit(1), F.position(part(0), F.col("line")) - 1))
    return rows.select(
        "path",
        F.when(part(1) != "", "file").when(before.isin(*OPENERS), "below").otherwise("trailing").alias("kind"),
        (F.col("i") + 1).alias("comment_line"),
        F.filter(F.transform(F.split(part(2), ","), text.strip), lambda x: x != "").alias("rules"),
        text.strip(part(3)).alias("reason"),
    ).withColumn("target_line", F.when(F.col("kind") == "file", F.lit(None)).otherwise(F.col("comment_line") + (F.col("kind") == "below").cast("int")))


def name_glob(g: Column) -> Column:
    """A glob of rule ids as an expression, for globs that are data."""
    plain = F.regexp_replace(g, r"([.\\+(){}|^$])", r"\\$1")
    return F.concat(F.lit("\\A"), F.replace(F.regexp_replace(plain, r"\*", ".*"), F.lit("?"), F.lit(".")), F.lit("\\z"))


def apply(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """Adds ``suppressed, suppressed_by``: the first covering comment for the file, else the line's."""
    w = W.partitionBy("path", "target_line").orderBy(F.when(F.col("kind") == "trailing", 0).otherwise(1), "comment_line")
    per_line = comments.where("kind <> 'file'").withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("path").alias("p"), F.col("target_line").alias("t"), F.struct("rules", "reason").alias("of_line"))
    per_file = comments.where("kind = 'file'").groupBy(F.col("path").alias("q")).agg(F.array_sort(F.collect_list(F.struct("comment_line", "rules", "reason"))).alias("of_file"))
    x = findings.join(per_line, (F.col("path") == F.col("p")) & (F.col("line") == F.col("t")), "left").join(per_file, F.col("path") == F.col("q"), "left")
    covers = lambda rules: (F.size(rules) == 0) | F.exists(rules, lambda g: F.regexp(F.col("rule_id"), name_glob(g)))
    first = F.get(F.filter(F.col("of_file"), lambda c: covers(c["rules"])), F.lit(0))
    reason = F.coalesce(first["reason"], F.when(covers(F.col("of_line.rules")), F.col("of_line.reason")))
    return x.withColumn("suppressed", reason.isNotNull()).withColumn("suppressed_by", F.coalesce(reason, F.lit(""))).drop("p", "t", "q", "of_line", "of_file")
