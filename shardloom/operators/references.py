"""Scores of items against prompts and reference vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.vectors import dot, l2_normalise, mean_vector
from shardloom.operators.similarity import max_similarity


def score_generations(items: DataFrame, prompts: DataFrame, references: DataFrame, item: str, caption: str, vector: str) -> DataFrame:
    """item, caption, own (cosine x 100 with its own prompt), nearest (prompt of the highest cosine), label_ok, reference
    (cosine x 100 with the normalised mean reference vector of its caption, null without one).

    prompts: caption, vector, one row for each distinct caption.  The nearest prompt is searched in pairs of blocks of items and
    prompts (`max_similarity`), so neither side is gathered; ties go to the smaller caption.
    """
    i = items.select(item, F.col(caption).alias("_own"), l2_normalise(F.col(vector)).alias("_v"))
    p = prompts.select(F.col(caption).alias("_caption"), l2_normalise(F.col(vector)).alias("_p"))
    near = max_similarity(
        i.select(F.col(item).alias("_i"), F.transform("_v", lambda x: 100 * x).alias("_x")), p.select(F.col("_caption").alias("_i"), F.col("_p").alias("_x")), "_i", "_x"
    ).select(F.col("_i").alias(item), F.col("reference").alias("nearest"))
    unit = references.select(caption, l2_normalise(F.col(vector)).alias("_u"))
    means = mean_vector(unit, [caption], "_u", "_m").select(F.col(caption).alias("_own"), l2_normalise(F.col("_m")).alias("_m"))
    scored = i.join(p, F.col("_own") == F.col("_caption"), "left").join(means, "_own", "left").join(near, item, "left")
    score = lambda c: F.round(100 * dot(F.col("_v"), F.col(c)), 6)
    return scored.select(
        item, F.col("_own").alias(caption), score("_p").alias("own"), "nearest", (F.col("nearest") == F.col("_own")).alias("label_ok"), score("_m").alias("reference"),
    )


def generation_report(scored: DataFrame, by: list[str]) -> DataFrame:
    """Means of `score_generations` for each setting."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("own"), 3).alias("own"), F.round(F.avg(F.col("label_ok").cast("double")), 4).alias("label_accuracy"), F.round(F.avg("reference"), 3).alias("reference")
    )


def leave_one_out(items: DataFrame, item: str, caption: str, vector: str) -> DataFrame:
    """item, caption, reference: cosine x 100 with the normalised mean of the other items of the caption; null for a single one.

    The others' sum is the caption's sum less the item's own vector: no item is paired with another.
    """
    unit = items.select(item, caption, l2_normalise(F.col(vector)).alias("_u"))
    n = unit.groupBy(caption).agg(F.count(F.lit(1)).alias("_n"))
    means = mean_vector(unit, [caption], "_u", "_m").join(n, caption)
    both = unit.join(means, caption)
    rest = F.zip_with("_m", "_u", lambda m, u: m * F.col("_n") - u)
    return both.select(item, caption, F.when(F.col("_n") > 1, F.round(100 * dot(F.col("_u"), l2_normalise(rest)), 6)).alias("reference"))
