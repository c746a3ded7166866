"""From findings to a result: one disposition a row, then counts, order and cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import CONFIDENCES, SEVERITIES, at_least, rank_column
from ..sources.config import ScanConfig


def disposed(findings: DataFrame, baseline: DataFrame | None, config: ScanConfig, audit: bool = False) -> DataFrame:
    """Adds ``disposition``: the first of suppressed, baselined, filtered that holds, else kept.

    ``audit`` reports suppressed findings too, with their reason."""
    x = findings
    known: Column = F.lit(False)
    if baseline is not None:
        marks = baseline.select("fingerprint").distinct().withColumn("known", F.lit(True))
        x = x.join(marks, "fingerprint", "left")  # broadcast or not by its size, which the planner knows
        known = F.coalesce("known", F.lit(False))
    low = ~at_least(F.col("severity"), config.min_severity) | ~at_least(F.col("confidence"), config.min_confidence, CONFIDENCES)
    hidden = F.col("suppressed") if not audit else F.lit(False)
    return x.withColumn("disposition", F.when(hidden, "suppressed").when(known, "baselined").when(low, "filtered").otherwise("kept")).drop("known")


def counts(disposed_rows: DataFrame) -> DataFrame:
    """One row: how many went which way."""
    return disposed_rows.agg(*[F.count_if(F.col("disposition") == d).alias(d) for d in ("kept", "suppressed", "baselined", "filtered")])


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(rank_column(F.col("severity")), "path", "line", "rule_id", "column")


def capped(findings: DataFrame, most: int) -> DataFrame:
    """Sorted first, then cut: the same rows on every run."""
    return ordered(findings).limit(most) if most else ordered(findings)


def tally(findings: DataFrame) -> DataFrame:
    """``severity, n`` of every severity, zeroes included, in order."""
    every = findings.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, rank int")
    return every.join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"), "rank").orderBy("rank").drop("rank")


def worst(findings: DataFrame) -> str | None:
    """The gravest severity there is, without sorting the findings."""
    return findings.agg(F.min_by("severity", rank_column(F.col("severity")))).first()[0]


def fails(findings: DataFrame, fail_on: str) -> bool:
    return fail_on != "never" and not findings.where(at_least(F.col("severity"), fail_on)).limit(1).isEmpty()


def walk_stats(files: DataFrame) -> DataFrame:
    """``reason, n`` of the files considered; an empty reason is a scanned file."""
    return files.groupBy("reason").agg(F.count("*").alias("n"))
