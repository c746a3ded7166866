"""High-entropy assignments: values too random to be words, under names of credentials."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# What an assignment, a credential's name, a placeholder, a reference and a harmless shape look like.
ASSIGNMENT = r"""([A-Za-z_][A-Za-z0-9_.\-]{2,40})\s*["']?\s*(?:[:=]{1,2}|=>)\s*(["'`]?)([A-Za-z0-9+/=_\-.~]{16,200})\2"""
NAME = (
    r"(?:^|[_.\-])(?:secret|passwd|password|passphrase|token|api[_.\-]?key|apikey|access[_.\-]?key|secret[_.\-]?key|private[_.\-]?key|client[_.\-]?secret|auth|credential|bearer|"
    r"session[_.\-]?key|encryption[_.\-]?key|signing[_.\-]?key|salt|master[_.\-]?key|refresh[_.\-]?token|webhook[_.\-]?secret)(?:$|[_.\-])"
)
ANY_NAME = "secret|passwd|password|passphrase|token|api|access|private|client|auth|credential|bearer|session|encryption|signing|salt|master|refresh|webhook"  # every name above holds one of them
PLACEHOLDER = (
    r"^(?:x{4,}|\.{3,}|-{4,}|(?:your|my|the|some|test|demo|sample|example|placeholder|dummy|fake|change|insert|replace|enter|todo|fixme|redacted|removed|hidden|none|null|nil|undefined|empty|default)[_.\-]?.*|"
    r".*(?:example|placeholder|changeme|change[_.\-]?me|yourkeyhere|xxxxx|notreal|dummy|redacted|<.*>))$"
)
REFERENCE = r"\$\{|\$\(|\{\{|%\(|<%|process\.env|os\.environ|getenv|ENV\["
HARMLESS = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"(?i)^[0-9a-f]{40}$", r"(?i)^[0-9a-f]{64}$", r"(?i)^sha(?:256|384|512)-",
    r"^(?:/|\./|\.\./|[a-z]+://)", r"^[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+){2,}$", r"^v?\d+\.\d+\.\d+",
)
MAX_REPEAT = 0.5

_ASSIGNMENT, _NAME, _PLACEHOLDER, _REFERENCE = re.compile(ASSIGNMENT), re.compile(NAME, re.I), re.compile(PLACEHOLDER, re.I), re.compile(REFERENCE)
_HARMLESS = tuple(map(re.compile, HARMLESS))


def rejected(name: str, value: str, line: str) -> str:
    """The first reason against a candidate, or an empty string."""
    if not _NAME.search(name):
        return "name"
    if _REFERENCE.search(line):
        return "reference"
    if _PLACEHOLDER.match(value):
        return "placeholder"
    if any(rx.match(value) for rx in _HARMLESS):
        return "shape"
    return "repeat" if max(map(value.count, set(value))) > MAX_REPEAT * len(value) else ""


def candidates(line: str, threshold: float) -> Iterator[tuple[str, str, float, int]]:
    """``(name, value, bits, column)`` of each value that passes."""
    if "=" not in line and ":" not in line:
        return
    for m in _ASSIGNMENT.finditer(line):
        if not rejected(m[1], m[3], line):
            bits = text.entropy_text(m[3])
            if bits >= threshold:
                yield m[1], m[3], round(bits, 2), m.start(3)


def assignments(files: DataFrame, pattern: str = ASSIGNMENT, groups: tuple[int, int] = (1, 3), split: Callable[[Column], Column] = text.lines) -> DataFrame:
    """``path, line, k, name, value, line_text`` of every assignment, natively: line by line, k-th on its line.

    ``groups`` of ``pattern`` hold name and value; ``split`` makes lines of a text."""
    lines = files.select("path", F.posexplode(split(F.col("text"))).alias("i", "line_text")).where(F.col("line_text").rlike(pattern))
    group = lambda k: F.regexp_extract_all("line_text", F.lit(pattern), F.lit(k))
    return lines.select("path", (F.col("i") + 1).alias("line"), "line_text", F.posexplode(F.arrays_zip(group(groups[0]).alias("name"), group(groups[1]).alias("value"))).alias("k", "z")).select("path", "line", "k", "z.name", "z.value", "line_text")


def gates(rows: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Adds ``reason`` (first gate that rejects, else empty) and ``entropy``."""
    shapes = F.lit(False)
    for rx in HARMLESS:
        shapes = shapes | F.col("value").rlike(rx)
    bits = text.entropy(F.col("value"))
    reason = (
        F.when(~F.col("name").rlike("(?i)" + NAME), "name")
        .when(F.col("line_text").rlike(REFERENCE), "reference")
        .when(F.col("value").rlike("(?i)" + PLACEHOLDER), "placeholder")
        .when(shapes, "shape")
        .when(text.repeat_share(F.col("value")) > MAX_REPEAT, "repeat")
        .when(bits < threshold, "entropy")
        .otherwise("")
    )
    return rows.withColumn("entropy", bits).withColumn("reason", reason)
