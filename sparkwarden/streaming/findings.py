"""Scan a stream of files: the same pass, then known findings dropped batch by batch."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..api import active_rules
from ..operators import match
from ..sources.config import ScanConfig


def findings(files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Findings of streamed rows of ``sources.files.SCHEMA``; stateless, as a file is one row."""
    _, rules = active_rules(config)
    return match.with_rule_texts(match.raw_findings(files, rules, config), rules, config)


def first_seen(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Each fingerprint once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def sink(stream: DataFrame, table: str | Path, checkpoint: str | Path, baseline: DataFrame | None = None) -> StreamingQuery:
    """Append new findings to a Parquet table: an anti-join with the baseline and with what is there.

    The table is partitioned by the first two digits of the fingerprint, and a batch reads
    of it no more than the fingerprints of its own partitions; a batch that is run again
    does not see its own rows."""
    spark, path = stream.sparkSession, str(table)
    schema = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("part", T.StringType())])

    def there() -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def batch(df: DataFrame, batch_id: int) -> None:
        new = df.dropDuplicates(["fingerprint"]).withColumn("part", F.substring("fingerprint", 1, 2))
        if baseline is not None:
            new = new.join(baseline.select("fingerprint"), "fingerprint", "left_anti")
        if there():
            known = df.sparkSession.read.schema(schema).parquet(path).where(F.col("batch_id") != batch_id)
            new = new.join(known, ["part", "fingerprint"], "left_anti")
        new.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").partitionBy("part").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
