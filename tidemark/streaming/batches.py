"""Structured Streaming: event-time batches and an incremental pattern table.

Late rows within the watermark go to the batch of their event time; later ones are
dropped.  The last window is flushed when the input ends (`availableNow`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import QUARTER_SECONDS
from tidemark.operators.itemsets import subsets
from tidemark.operators.transactions import canonical

#: A folder that was written whole holds a file that says so
_MARKED = "mapreduce.fileoutputcommitter.marksuccessfuljobs"


def folder(spark: SparkSession) -> str:
    """A new folder below the one that the session shares with its executors."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile
        from pathlib import Path

        shared = Path(tempfile.mkdtemp(prefix="tidemark-")).as_uri()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)
    files.deleteOnExit(path)  # results read it until the session ends
    return path.toString()


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = 1) -> DataFrame:
    """The events table, a file or a folder of them, as a stream of files; timestamps without a zone become instants.

    None takes all files that are there at once, so that no order of the files makes rows late.
    """
    table = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(table).schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory():
        rows = reader.parquet(table)
    else:  # a stream's path has to be a folder
        rows = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def quarter_counts(events: DataFrame, late: str = "15 minutes") -> DataFrame:
    """quarter, n_events by tumbling windows of a quarter of an hour."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", f"{QUARTER_SECONDS} seconds")).agg(F.count("*").alias("n_events"))
    return w.select(F.floor(F.unix_timestamp("window.start") / QUARTER_SECONDS).cast("long").alias("quarter"), "n_events")


def collected(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """Runs a stream over what is available and returns what it wrote.

    In append mode windows after the watermark would stay open at the end of the input;
    updates are written instead and the last one of each window counts.
    """
    top = folder(spark)
    key = stream.columns[0]

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{top}/out/batch={number}")

    query = stream.writeStream.outputMode("update" if mode == "append" else mode).option("checkpointLocation", f"{top}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{top}/out").parquet(f"{top}/out")
    return rows.groupBy(key).agg(*[F.max_by(c, "_batch").alias(c) for c in stream.columns[1:]])


class PatternStore:
    """A sparse pattern table that grows with each micro-batch.

    Every micro-batch writes its itemset supports by tick under its own number, so a
    batch that is repeated after a failure replaces itself.  Reading sums over batches.
    `compact` merges what is there into one table and drops ticks that no window reaches any
    more, so that the store stays in proportion to the distinct patterns of a year.
    """

    _SCHEMA = "tick long, items array<string>, support long"

    def __init__(self, spark: SparkSession, max_len: int = 3, path: str | None = None, tick_seconds: int = 86400):
        self.spark, self.max_len, self.tick_seconds = spark, max_len, tick_seconds
        self.path = path or folder(spark)

    def add(self, transactions: DataFrame, number: int) -> None:
        tick = F.floor(F.unix_timestamp("ts") / self.tick_seconds).cast("long").alias("tick")
        each = F.concat(*[subsets(canonical(F.col("items")), k) for k in range(1, self.max_len + 1)])
        found = transactions.select(tick, F.explode(each).alias("items")).groupBy("tick", "items").agg(F.count("*").alias("support"))
        found.write.mode("overwrite").option(_MARKED, "true").parquet(f"{self.path}/patterns/batch={number}")

    def run(self, stream: DataFrame, to_transactions: Callable[[DataFrame], DataFrame]) -> list[dict]:
        """Runs over what is there; returns the progress of each micro-batch (see `throughput`)."""
        query = stream.writeStream.option("checkpointLocation", f"{self.path}/checkpoint").foreachBatch(lambda batch, number: self.add(to_transactions(batch), number)).trigger(availableNow=True).start()
        query.awaitTermination()
        return throughput(query)

    def _folders(self, name: str) -> dict[int, object]:
        """Numbered folders `.../name=<number>` and their paths."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/patterns")
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found = [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
        done = [p for p in found if p.getName().startswith(f"{name}=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return {int(p.getName().split("=")[1]): p for p in done}

    def _rows(self) -> DataFrame:
        """The newest compacted table and the micro-batches after it."""
        merged, each = self._folders("upto"), self._folders("batch")
        last = max(merged, default=-1)
        paths = [p.toString() for k, p in each.items() if k > last] + [merged[k].toString() for k in merged if k == last]
        return self.spark.read.schema(self._SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self._SCHEMA)

    def compact(self, keep_ticks: int | None = None) -> None:
        """Merges all micro-batches; `keep_ticks` drops older ones than so many before the last."""
        each = self._folders("batch")
        if not each:
            return
        rows = self._rows()
        if keep_ticks is not None:
            newest = rows.agg(F.max("tick").alias("_newest"))
            rows = rows.join(F.broadcast(newest)).where(F.col("tick") > F.col("_newest") - keep_ticks).drop("_newest")
        upto = max(each)
        old = [p for k, p in self._folders("upto").items() if k < upto] + list(each.values())
        rows.groupBy("tick", "items").agg(F.sum("support").alias("support")).write.mode("errorifexists").option(_MARKED, "true").parquet(f"{self.path}/patterns/upto={upto}")
        for p in old:  # readers take the newest compacted table from here on
            p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def patterns(self, min_count: int = 1) -> DataFrame:
        """tick, items, support over all batches so far."""
        return self._rows().groupBy("tick", "items").agg(F.sum("support").alias("support")).where(F.col("support") >= min_count)


def throughput(query) -> list[dict]:
    """batch, rows, rows a second, milliseconds and bytes of state of each micro-batch."""
    out = []
    for p in query.recentProgress:
        p = p if isinstance(p, dict) else json.loads(p.json)
        out.append({"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond", 0.0), "ms": p.get("durationMs", {}).get("triggerExecution", 0), "state_bytes": sum(s.get("memoryUsedBytes", 0) for s in p.get("stateOperators", []))})
    return out
