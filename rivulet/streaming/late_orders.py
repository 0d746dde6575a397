"""Item popularity from two streams, order lines and orders, in any order of arrival.

Lines and orders are joined by a stream-stream join, so a line that comes
before its order waits in the state for it.  Pairs (user, item) seen before are
dropped by streaming deduplication; what is left of a micro-batch are new
pairs, and its counts per item are added to the last complete table.

Sink.  Each micro-batch writes the whole table to a folder of its own and then
replaces a small pointer file (batch number, folder) by rename.  Readers follow
the pointer: they see the table of one finished batch, also while the next is
being written.  A replayed batch finds its number in the pointer and writes
nothing, so every pair counts once across restarts.

State.  Without times the state holds all lines, orders and pairs (in RocksDB).
With ``times`` = (line time, order time, how late a line may be) watermarks and a
range condition let Spark drop what can't meet any more.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.session import shared_path
from rivulet.sources.commits import file_system, read_small_files, write_small_file

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "itemId bigint, user_count bigint"
#: Folders of earlier batches that stay for readers that still follow them.
KEPT = 2


def new_pairs(lines: DataFrame, orders: DataFrame, times: tuple[str, str, str] | None = None) -> DataFrame:
    """Streaming (userId, itemId), each once, as soon as both a line and its order have come."""
    li = lines.where("l_orderkey IS NOT NULL AND l_partkey IS NOT NULL")
    od = orders.where("o_orderkey IS NOT NULL AND o_custkey IS NOT NULL")
    on = F.col("l_orderkey") == F.col("o_orderkey")
    if times:
        line, order, late = times
        li, od = li.withWatermark(line, late), od.withWatermark(order, late)
        on = on & (F.col(line) >= F.col(order)) & (F.col(line) <= F.col(order) + F.expr(f"INTERVAL {late}"))
    pairs = li.join(od, on).select(F.col("o_custkey").cast("long").alias("userId"), F.col("l_partkey").cast("long").alias("itemId"))
    return pairs.dropDuplicates(["userId", "itemId"])


class PointedTable:
    """A table rewritten batch by batch, read through a pointer that names the last whole one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def pointer(self) -> dict | None:
        text = read_small_files(self.spark, f"{self.path}/pointer").get("current")
        return json.loads(text) if text else None

    def read(self) -> DataFrame:
        now = self.pointer()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{now['folder']}") if now else self.spark.createDataFrame([], SCHEMA)

    def add(self, counts: DataFrame, batch: int) -> bool:
        """Add (itemId, user_count) of one batch; False if that batch is in the table already."""
        now = self.pointer()
        if now and now["batch"] >= batch:
            return False
        folder = f"table-{batch:012d}-{uuid.uuid4().hex[:8]}"
        whole = self.read().unionByName(counts).groupBy("itemId").agg(F.sum("user_count").alias("user_count"))
        whole.write.parquet(f"{self.path}/{folder}")
        write_small_file(self.spark, f"{self.path}/pointer/current", json.dumps({"batch": batch, "folder": folder}), replace=True)
        self._drop_old(folder)
        return True

    def _drop_old(self, current: str) -> None:
        fs = file_system(self.spark, self.path)
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        old = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("table-"))
        for name in [n for n in old if n < current][:-KEPT]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_late_orders(spark: SparkSession, lines: DataFrame, orders: DataFrame, path: str | None = None,
                    times: tuple[str, str, str] | None = None, state_partitions: int | None = None) -> PointedTable:
    """Process what the two streams have now and return the table; the next run with the same ``path`` goes on from there."""
    path = path or shared_path(spark, "late-orders")
    table = PointedTable(spark, f"{path}/table")

    def sink(batch: DataFrame, number: int) -> None:
        table.add(batch.groupBy("itemId").agg(F.count(F.lit(1)).alias("user_count")), number)

    # start() copies the session's settings: the number of state partitions is fixed by the first run
    # without row counts a put needs no read before it; change logs spare a snapshot of the whole state per batch
    with _settings(spark, {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
                           "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
                           "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
                           "spark.sql.shuffle.partitions": str(state_partitions or spark.sparkContext.defaultParallelism)}):
        q = (new_pairs(lines, orders, times).writeStream.outputMode("append").foreachBatch(sink)
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return table


def file_stream(spark: SparkSession, folder: str, name: str, schema, files_a_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of ``folder`` whose names match ``name``."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", name)
    return (r.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else r).parquet(folder)
