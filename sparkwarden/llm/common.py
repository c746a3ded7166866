"""What the operators share: reading, scratch tables, Arrow passes and connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
_local: dict[str, str] = {}  # temporary folders of local sessions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session of this machine alone gets a temporary folder; on
    a cluster no folder can be guessed, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='sparkwarden-')}")
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends there,
    and a lost executor costs no more than a read."""
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch() -> None:
    """Delete all scratch tables of this process; results read from them end."""
    while _made:
        spark, path = _made.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended before this process
            return


atexit.register(drop_scratch)


def arrow_map(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema) -> DataFrame:
    """Apply ``rows`` to each Arrow batch, given and giving columns as lists."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = rows(b.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, from_arrow_schema(schema))


def let_go() -> None:
    """Give freed memory back to the system: Spark keeps Python processes from stage to stage, with all they ever took."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` between two calls of ``let_go``."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from run(batches)
        let_go()

    return tidied


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """Smallest node reachable from each node of ``edges(a, b)``: ``(node, root)``.

    Star contraction: each node hooks onto the smallest neighbour, then parents
    are shortcut; every round is a written table, so it survives lost executors.
    Each round brings some node closer to its root, so the loop ends by itself; the
    number of rounds is about logarithmic in a component's diameter.  Smallest
    neighbours are partial sums before any shuffle, and a hub's edges are joined
    with its own in ``SPLIT`` hash pieces, so that no task holds them alone."""
    e = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    i = 0
    while True:
        both = e.union(e.select("b", "a"))
        # large star: strictly larger neighbours are tied to the smallest neighbour
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = in_pieces(both, low, "a").where("b > a").select(F.col("m").alias("a"), "b")
        large = large.where("a <> b").distinct()
        # small star: smaller neighbours and the node itself are tied to the smallest
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = in_pieces(large, low, "b")
        small = small.select(F.col("m").alias("x"), F.col("a").alias("y")).union(small.select(F.col("m").alias("x"), F.col("b").alias("y")))
        e = materialise(small.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"{name}-round{i}")
        i += 1
        # done when every node hangs off one root that is itself no child
        parents = e.groupBy("b").agg(F.count("*").alias("n"))
        if parents.where("n > 1").limit(1).count():
            continue
        if not e.select("a").distinct().join(parents.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count():
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


SPLIT = 16


def in_pieces(edges: DataFrame, low: DataFrame, key: str) -> DataFrame:
    """``edges`` joined with ``low`` on ``key``, the edges of one key in ``SPLIT`` pieces by their other end."""
    other = "b" if key == "a" else "a"
    left = edges.withColumn("_s", F.pmod(F.xxhash64(other), F.lit(SPLIT)))
    right = low.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1)).cast("array<bigint>")))
    return left.join(right, [key, "_s"]).drop("_s")
