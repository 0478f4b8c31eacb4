"""Matched training tables: class pools, slot schedules, arms, heads and choices between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shardloom.functions.draws import draw, draw_below
from shardloom.operators.prefix import running_sums


def class_pools(rows: DataFrame, item: str, cls: str, rank: str) -> DataFrame:
    """cls, item, index (from 0 in order of rank and item), pool_size; a class is numbered range by range."""
    own = rows.select(cls, item, *([rank] if rank not in (cls, item) else []), F.lit(1).cast("long").alias("_one"))
    sizes = rows.groupBy(cls).agg(F.count(F.lit(1)).alias("pool_size"))
    return running_sums(own, [cls], [rank, item], {"index": "_one"}).join(sizes, cls).select(cls, item, "index", "pool_size")


def slot_schedule(spark: SparkSession, seeds: list[int], sizes: DataFrame, *, classes: int, updates: int, batch: int = 32, views: int = 4) -> DataFrame:
    """seed, slot, update, cls, real_idx, view, coin, synth_idx: every draw that the arms share.

    sizes: cls, pool_size, synth_size.  A batch is class-balanced; the shorter class rotates with the update.
    """
    base, extra = divmod(batch, classes)
    plan = spark.range(updates).withColumnRenamed("id", "update").withColumn("cls", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(classes - 1).cast("long"))))
    n = F.lit(base) + (F.pmod(F.col("cls") - F.col("update"), F.lit(classes)) < extra).cast("int")
    before = F.sum("_n").over(Window.partitionBy("update").orderBy("cls")) - F.col("_n")
    slots = plan.withColumn("_n", n).withColumn("_before", before).select("update", "cls", F.posexplode(F.sequence(F.lit(1), F.col("_n"))).alias("_k", "_x"), "_before")
    numbered = slots.select("update", "cls", (F.col("update") * batch + F.col("_before") + F.col("_k")).alias("slot"))
    seeded = numbered.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))).join(F.broadcast(sizes), "cls")
    s, k = F.col("seed"), F.col("slot")
    return seeded.select(
        "seed", "slot", "update", "cls", draw_below(F.col("pool_size"), "real", s, k).alias("real_idx"), draw_below(views, "view", s, k).alias("view"),
        draw("coin", s, k).alias("coin"), draw_below(F.greatest(F.lit(1), F.col("synth_size")), "synth", s, k).alias("synth_idx"), "synth_size",
    )


def arm_sources(schedule: DataFrame, probability: float = 0.5) -> DataFrame:
    """seed, arm, slot, cls, synthetic, index, view: A real without a view (-1), B real with one, C some defect slots synthetic."""
    arms = schedule.withColumn("arm", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))))
    synthetic = (F.col("arm") == "C") & (F.col("cls") > 0) & (F.col("synth_size") > 0) & (F.col("coin") < probability)
    return arms.select(
        "seed", "arm", "slot", "cls", synthetic.alias("synthetic"), F.when(synthetic, F.col("synth_idx")).otherwise(F.col("real_idx")).alias("index"),
        F.when(F.col("arm") == "A", F.lit(-1)).otherwise(F.col("view")).cast("long").alias("view"),
    )


def synthetic_share(sources: DataFrame) -> DataFrame:
    """arm, overall, defects: share of synthetic slots, of all and of the defect ones."""
    x = F.col("synthetic").cast("double")
    return sources.groupBy("arm").agg(F.round(F.avg(x), 6).alias("overall"), F.round(F.avg(F.when(F.col("cls") > 0, x)), 6).alias("defects"))


def slot_features(sources: DataFrame, features: DataFrame) -> DataFrame:
    """The slots with their vectors.  features: synthetic, cls, index, view, vector; a pool has hundreds of rows, Spark picks the join."""
    return sources.join(features, ["synthetic", "cls", "index", "view"])


def fit_head(rows: DataFrame, label: str, vector: str, **options) -> DataFrame:
    """class, weights, intercept of a multinomial linear head fitted by L-BFGS on frozen vectors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = rows.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector)).alias("features"))
    model = LogisticRegression(family="multinomial", **options).fit(data)
    w, b = model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist()
    return rows.sparkSession.createDataFrame([(i, x, y) for i, (x, y) in enumerate(zip(w, b, strict=True))], "class int, weights array<double>, intercept double")


def select_epoch(history: DataFrame, by: list[str], metric: str, *, highest: bool = True) -> DataFrame:
    """by, epoch, metric of the best epoch; the earlier one on ties."""
    value = F.col(metric) if highest else -F.col(metric)
    return history.groupBy(*by).agg(F.max_by(F.struct("epoch", metric), F.struct(value, -F.col("epoch"))).alias("_b")).select(*by, "_b.epoch", f"_b.{metric}")


def select_export(scores: DataFrame, seed: int, metric: str) -> DataFrame:
    """The arm of the canonical seed with the best metric, ties A, B, C."""
    return scores.where(F.col("seed") == seed).orderBy(F.desc(metric), "arm").limit(1)


def majority_baseline(train: DataFrame, label: str, items: DataFrame) -> DataFrame:
    """The items with the most frequent training class as prediction."""
    top = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), label).limit(1).select(F.col(label).alias("predicted"))
    return items.join(F.broadcast(top))
