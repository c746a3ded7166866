"""Source files as rows: a tree on a shared disk, or any table with a path and a text.

Spark's own file index leaves out names that begin with '.' or '_', which are
just the files a scan is after, so trees have a data source of their own: the
driver lists and prunes, executors read."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import globs, text
from . import git
from .config import ScanConfig

SCHEMA = "path string, relpath string, project_path string, language string, length long, text string, reason string"
SNIFF = 8192
SPREAD_BELOW = 1 << 30  # bytes that a source is read from


@dataclass
class Candidate:
    relpath: str
    length: int
    reason: str = ""  # why it is not read; empty: it is


def walk(root: Path, excludes: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    """``(relative path, reason)`` depth first, names in order; excluded folders are not entered."""
    if root.is_file():
        yield root.name, ""
        return
    todo = [""]
    while todo:
        at = todo.pop()
        try:
            entries = sorted(os.scandir(root / at), key=lambda e: e.name)
        except OSError:
            yield at, "unreadable"
            continue
        folders = []
        for e in entries:
            rel = f"{at}/{e.name}" if at else e.name
            if e.is_symlink():
                continue
            if e.is_dir():
                if globs.matches(f"{rel}/x", excludes):
                    yield rel, "excluded"
                else:
                    folders.append(rel)
            elif e.is_file():
                yield rel, ""
        todo += reversed(folders)


def candidates(config: ScanConfig, paths: list[str] | None = None) -> list[Candidate]:
    """Every file considered, with the first reason against reading it."""
    root = Path(config.root)
    base = root.parent if root.is_file() else root
    hidden: set[str] = set()
    if paths is not None:
        names = [(p, "") for p in paths]
    else:
        known = git.listed(root) if config.respect_gitignore and root.is_dir() else None
        names = [(p, "") for p in known] if known is not None else list(walk(root, config.excludes))
        if known is None and config.respect_gitignore and (root / ".git").exists():
            hidden = git.ignored(root, [n for n, r in names if not r])
    out = []
    for name, reason in names:
        if reason:
            out.append(Candidate(name, 0, reason))
            continue
        p = base / name
        size = p.stat().st_size if p.is_file() else 0
        if globs.matches(name, config.excludes):
            reason = "excluded"
        elif name in hidden:
            reason = "ignored"
        elif config.include and not globs.matches(name, config.include):
            reason = "excluded"
        elif not text.language_of(name):
            reason = "unknown"
        elif p.is_symlink() or not p.is_file():
            reason = "unreadable"
        elif size > config.max_file_bytes:
            reason = "large"
        out.append(Candidate(name, size, reason))
    return out


@dataclass
class _Files(InputPartition):
    names: list[tuple[str, int, str]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.project = options["base"], options["project"]
        self.rows = [tuple(x.rsplit("\t", 2)) for x in options["files"].split("\0") if x]

    def partitions(self) -> list[InputPartition]:
        """Largest files first, about 16 files or 8 MB each."""
        out: list[list] = []
        files = size = 0
        for name, length, reason in sorted(((n, int(z), r) for n, z, r in self.rows), key=lambda x: (-x[1], x[0])):
            if not out or files >= 16 and size > 1 << 20 or size > 8 << 20 or files >= 512:
                out.append([])
                files = size = 0
            out[-1].append((name, length, reason))
            files, size = files + 1, size + length
        return [_Files(x) for x in out] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for name, length, reason in partition.names:
            path = os.path.join(self.base, name)
            body = None
            if not reason:
                try:
                    with open(path, "rb") as f:
                        raw = f.read()
                    if b"\0" in raw[:SNIFF]:
                        reason = "binary"
                    else:
                        body = raw.decode("utf-8", "replace")
                except OSError:
                    reason = "unreadable"
            yield path, name, self.project + name, text.language_of(name), length, body, reason


class SourceTree(DataSource):
    """``spark.read.format("source_tree")`` over a listing made by ``candidates``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_tree(spark: SparkSession, config: ScanConfig, paths: list[str] | None = None) -> DataFrame:
    """One row a file considered; ``text`` is null where ``reason`` says why."""
    root = Path(config.root).resolve()
    base = root.parent if root.is_file() else root
    top = git.toplevel(base)
    project = str(base.relative_to(top.resolve())) + "/" if top and base != top.resolve() and base.is_relative_to(top.resolve()) else ""
    spark.dataSource.register(SourceTree)
    listing = "\0".join(f"{c.relpath}\t{c.length}\t{c.reason}" for c in candidates(config, paths))
    return spark.read.format("source_tree").options(base=str(base), project=project, files=listing).load()


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: its one file or row group would be one task.

    Beyond ``SPREAD_BELOW`` bytes there are row groups for every core and nothing is moved."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism) if 1 << 20 < size < SPREAD_BELOW else df


def from_table(df: DataFrame, path: Column, body: Column, config: ScanConfig = ScanConfig()) -> DataFrame:
    """The same rows from a table; nothing but columns, so filters and pruning reach its scan."""
    some = spread(df.select(path.alias("path"), body.alias("text"))).withColumn("language", text.language(F.col("path"))).withColumn("length", F.octet_length("text").cast("long"))
    reason = (
        F.when(globs.matches_column(F.col("path"), config.excludes), "excluded")
        .when(~globs.matches_column(F.col("path"), config.include) if config.include else F.lit(False), "excluded")
        .when(F.col("language") == "", "unknown")
        .when(F.col("text").isNull(), "unreadable")
        .when(F.col("length") > config.max_file_bytes, "large")
        .when(F.locate("\0", F.substring("text", 1, SNIFF)) > 0, "binary")
        .otherwise("")
    )
    return some.select("path", F.col("path").alias("relpath"), F.col("path").alias("project_path"), "language", "length", "text", reason.alias("reason"))
