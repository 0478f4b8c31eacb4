"""Tables in the shared folder, and connected components by joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, which all machines share; only a session on one machine may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shardloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def star_links(rows: DataFrame, item: str, key: str) -> DataFrame:
    """Links (a, b) from every item to the smallest item of its key: as many links as items, never all pairs."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(item).alias("_first"))
    return rows.join(first, key).where(F.col(item) != F.col("_first")).select(F.col(item).alias("a"), F.col("_first").alias("b"))


def connected_components(items: DataFrame, item: str, links: DataFrame, rounds: int = 40) -> DataFrame:
    """item and component (the smallest item it is connected with) for every item.

    Each round ties the larger, then the smaller neighbours of every item to its smallest one; the
    smallest neighbour comes from a partial aggregation, so a hub is not gathered in one task.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    known = state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        edges, before, known = after, known, state(after)
        if known == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return items.select(item).distinct().join(edges, F.col(item) == F.col("u"), "left").select(item, F.coalesce("v", item).alias("component"))
