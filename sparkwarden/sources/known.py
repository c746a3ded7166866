"""Earlier results: baselines and findings caches, read with tolerance."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def _json(path: str | Path) -> object:
    try:
        return json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        return None


def fingerprints(path: str | Path | None) -> list[str]:
    """From a list, or from the key ``fingerprints`` or ``findings``; entries are strings or objects."""
    data = _json(path) if path else None
    if isinstance(data, dict):
        data = data.get("fingerprints") or data.get("findings")
    found = (x.get("fingerprint") if isinstance(x, dict) else x for x in data) if isinstance(data, list) else ()
    return sorted({x for x in found if isinstance(x, str) and x})


def baseline(spark: SparkSession, path: str | Path | None) -> DataFrame:
    return spark.createDataFrame([(x,) for x in fingerprints(path)], "fingerprint string")


def cached_rows(path: str | Path) -> list[dict]:
    """Rows of a findings cache: a list, or an envelope with ``findings``; anything else is dropped."""
    data = _json(path)
    if isinstance(data, dict):
        data = data.get("findings")
    return [x for x in data if isinstance(x, dict)] if isinstance(data, list) else []
