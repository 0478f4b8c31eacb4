"""The row-level operators on arriving rows; a drained stream gives what the batch operator gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators.graph import shared_path
from shardloom.operators.grouping import hash_split


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream of files; its schema is that of the files there now.

    Timestamps without a zone become instants of the session's zone, which watermarks need.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    rows = reader.parquet(path) if folder else reader.option("pathGlobFilter", where.getName()).parquet(str(where.getParent()))
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def committed(spark: SparkSession, log: str) -> set[int]:
    """The batches that a commit log holds: one empty file for each."""
    where = spark._jvm.org.apache.hadoop.fs.Path(log)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return {int(f.getPath().getName()) for f in fs.listStatus(where)} if fs.exists(where) else set()


def _commit(spark: SparkSession, log: str, number: int) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{log}/{number}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True).close()


def stream_validate(rows: DataFrame, broken: Column, good: str, bad: str, checkpoint: str, log: str | None = None):
    """Start a query that appends the clean rows to one table and the broken ones to another.

    A batch counts once both writes are done and its number is in the commit log (beside the clean table unless given).  After a restart a batch that is replayed
    is left alone if the log has it, and otherwise overwrites what a lost try left, so rows appear once however often it stops between the two writes.
    """
    log = log or f"{good.rstrip('/')}-commits"

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in committed(spark, log):
            return
        for where, path in ((~F.coalesce(broken, F.lit(True)), good), (F.coalesce(broken, F.lit(True)), bad)):
            batch.where(where).write.mode("overwrite").parquet(f"{path}/batch={number}")
        _commit(spark, log, number)

    return rows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_committed(spark: SparkSession, path: str, log: str, schema) -> DataFrame:
    """The rows of the committed batches of one of the tables of `stream_validate`."""
    rows = spark.read.schema(schema).option("basePath", path)
    done = sorted(committed(spark, log))
    return rows.parquet(*[f"{path}/batch={n}" for n in done]).drop("batch") if done else spark.createDataFrame([], schema)


def stream_first_seen(rows: DataFrame, digest: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each digest; rows later than the watermark are dropped, which the batch form does not do."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(digest)


def stream_eligibility(rows: DataFrame, item: str, digest: str, time: str, rules: list[tuple[Column, str]], *, delay: str, keep: str) -> DataFrame:
    """item, status, reason of every arriving row: refused by the first of `rules` (condition, reason), late, a repeat of an earlier candidate, or eligible.

    State is one instant for each digest.  In a batch the row of smallest time and item comes first; a later batch's rows repeat it as long as it is kept,
    `keep` of event time after it was seen (a whole number of days or hours, as '30 days').  A row older than the watermark (`delay` behind the newest) leaves with the reason
    'late' and changes no state.  Rows with a null digest or time are 'no digest' or 'no time'.  On a drained stream without late rows the
    result is that of the batch form.
    """
    import numpy as np
    import pandas as pd

    early = F.when(F.col(digest).isNull(), "no digest").when(F.col(time).isNull(), "no time")
    for broken, reason in rules:
        early = early.when(F.coalesce(broken, F.lit(False)), reason)
    kind = rows.schema[item].dataType.simpleString()
    staged = rows.withWatermark(time, delay).select(F.col(item).alias("item"), F.col(digest).cast("string").alias("digest"), F.unix_millis(F.col(time).cast("timestamp")).alias("at"), F.col(time).alias("_time"), early.alias("early"))
    refused = staged.where("early is not null").select("item", F.lit("rejected").alias("status"), F.col("early").alias("reason"))
    # Spark drops rows whose event-time column is behind the watermark before the state sees them.  Here that column is one that never is; the watermark
    # itself still follows `time`, and `settle` compares.
    never = F.lit("2200-01-01 00:00:00").cast("timestamp").alias("_never_late", metadata={"spark.watermarkDelayMs": 0})
    passed = staged.where("early is null").select("item", "digest", "at", never)
    kept_for = int(pd.Timedelta(keep).total_seconds() * 1000)

    def settle(key, chunks, state):
        if state.hasTimedOut:
            state.remove()
            return
        # A digest has few rows and there are many digests: no pandas operation that plain arrays do as well.
        own = list(chunks)
        own = own[0] if len(own) == 1 else pd.concat(own)
        when, items, watermark = own["at"].to_numpy(), own["item"].to_numpy(), state.getCurrentWatermarkMs()
        late = when < watermark
        reason = np.where(late, "late", "exact duplicate of an earlier candidate").astype(object)
        if not state.exists and not late.all():
            least = int(when[~late].min())
            first = min(np.flatnonzero(~late & (when == least)), key=lambda k: items[k])
            reason[first] = ""
            state.update((least,))
        if state.exists:
            state.setTimeoutTimestamp(max(state.get[0] + kept_for, watermark + 1))
        yield pd.DataFrame({"item": items, "status": np.where(reason == "", "eligible", "rejected"), "reason": reason})

    settled = passed.groupBy("digest").applyInPandasWithState(settle, f"item {kind}, status string, reason string", "seen long", "append", "EventTimeTimeout")
    return settled.unionByName(refused).withColumnRenamed("item", item)


def stream_status(rows: DataFrame, label: str, usable: Column, time: str | None = None, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Running attempts and usable rows of each label, in tumbling windows if `time` is given."""
    counts = F.count(F.lit(1)).alias("attempted"), F.count_if(usable).alias("usable")
    if time is None:
        return rows.groupBy(label).agg(*counts)
    return rows.withWatermark(time, delay).groupBy(F.window(time, window), label).agg(*counts).select(F.col("window.start").cast("timestamp_ntz").alias("start"), label, "attempted", "usable")


def stream_hash_split(rows: DataFrame, key: str, version: str) -> DataFrame:
    return rows.withColumn("split", hash_split(F.col(key), version))


def drained(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of what is there, and read what it wrote.

    In `complete` mode every batch holds the whole result, so the last batch is the table.
    """
    spark = rows.sparkSession
    out, checkpoint = shared_path(spark, "stream"), shared_path(spark, "stream-state")
    if mode == "append":
        query = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    else:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)
