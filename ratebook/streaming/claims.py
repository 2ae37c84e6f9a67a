"""Claim totals maintained by Structured Streaming as snapshot files arrive.

The batch operator ``claims_by_policy`` is reused unchanged on a file
stream: every new claim-movement file updates the per-policy state (a
state store keyed by policy), and each micro-batch publishes the complete
per-policy table.  ``availableNow`` processes what has landed and stops, so
the same code serves a scheduled monthly run and a continuous one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.aggregates import claims_by_policy


def claims_stream(spark: SparkSession, path: str, schema: T.StructType, snapshot,
                  files_per_batch: int | None = None) -> DataFrame:
    """Streaming per-policy net claim at ``snapshot`` over Parquet files in ``path``."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return claims_by_policy(reader.parquet(path), snapshot)


def publish_available(sdf: DataFrame, out_path: str, checkpoint: str,
                      state_partitions: int | None = None) -> None:
    """Run the stream over all available input, then stop.

    Complete mode: each micro-batch rewrites the per-policy table; the
    checkpoint (in the shared folder) makes a restart resume exactly.  The
    state store gets ``state_partitions`` partitions (default: two per core);
    the number is fixed by the checkpoint at the first start, so it is set
    only around ``start()`` (the stream runs on a clone of the session).
    """
    def publish(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    spark = sdf.sparkSession
    parts = state_partitions or max(2, 2 * spark.sparkContext.defaultParallelism)
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(parts))
    try:
        q = (sdf.writeStream.outputMode("complete").foreachBatch(publish)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, before)
    q.awaitTermination()
