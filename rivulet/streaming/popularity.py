"""Item popularity over an append-only interaction source, as Structured
Streaming.

New order lines arrive as files; each micro-batch joins them to the order
table (stream-static join), drops (user, item) pairs already seen
(streaming deduplication state), and updates the distinct-user count per
item (streaming aggregation state).  The complete result is rewritten in place
to a table in the shared folder at each batch: it is whole once the query has
ended, a reader during a batch can find it missing or in part.  A line whose
order is not in the order table when it arrives is dropped and not looked at
again.  A restarted query resumes from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.session import shared_path


def popularity_stream(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Streaming (itemId, user_count) from a streaming lineitem frame."""
    pairs = (lines.join(orders.select("o_orderkey", "o_custkey"), lines.l_orderkey == orders.o_orderkey)
             .select(F.col("o_custkey").alias("userId"), F.col("l_partkey").alias("itemId"))
             .where(F.col("itemId").isNotNull() & F.col("userId").isNotNull())
             .dropDuplicates(["userId", "itemId"]))
    return pairs.groupBy("itemId").agg(F.count(F.lit(1)).alias("user_count"))


def run_popularity_stream(spark: SparkSession, source_dir: str, orders: DataFrame,
                          out_path: str | None = None, file_name: str = "lineitem.parquet",
                          state_partitions: int | None = None) -> str:
    """Process every file available under ``source_dir`` (availableNow
    trigger) and return the path of the result table."""
    # The de-duplication state holds every distinct (user, item) pair seen so
    # far: keep it in RocksDB (off-heap, spills to local disk, checkpointed to
    # the shared folder) unless the session already chose a provider.
    key = "spark.sql.streaming.stateStore.providerClass"
    current = spark.conf.get(key, None)
    if not current or current.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out_path = out_path or shared_path(spark, "popularity-stream")
    ckpt = out_path + "-checkpoint"
    schema = spark.read.parquet(f"{source_dir}/{file_name}").schema
    lines = (spark.readStream.schema(schema).option("pathGlobFilter", file_name)
             .option("maxFilesPerTrigger", 1).parquet(source_dir))
    agg = popularity_stream(lines, orders)

    def sink(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    # The number of state partitions is fixed by the first run of a query
    # (it is stored in the checkpoint): size it by the cluster's cores rather
    # than by whatever the session's batch setting is.  start() clones the
    # session conf, so the session's own value is restored right after.
    parts_key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(parts_key)
    spark.conf.set(parts_key, str(state_partitions or spark.sparkContext.defaultParallelism))
    try:
        q = (agg.writeStream.outputMode("complete").foreachBatch(sink)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    finally:
        spark.conf.set(parts_key, before)
    q.awaitTermination()
    return out_path
