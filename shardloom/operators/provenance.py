"""Digests and frozen records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sha(c) -> Column:
    return F.sha2(c.cast("binary"), 256)


def line(*columns: str) -> Column:
    """The columns as one text that no other values have: length:value for each, - for null."""
    text = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def dataset_digest(rows: DataFrame, columns: list[str], by: list[str] | None = None, buckets: int = 256) -> DataFrame:
    """by, n, digest: SHA-256 over the rows whatever their order or partitioning.

    Three levels: row digests are sorted and hashed inside buckets * 256 hash ranges, the ranges inside `buckets` wider ones, and
    those at the top.  A range is gathered in one task: 65,536 of them hold 10^11 rows at 1.5 million rows each; raise `buckets` beyond.
    """
    by = by or []
    keyed = rows.select(*by, _sha(line(*columns)).alias("_d"))
    bucket = F.floor(F.conv(F.substring("_d", 1, 6), 16, 10).cast("long") * (buckets * 256) / (1 << 24)).cast("long")
    fine = keyed.groupBy(*by, bucket.alias("_f")).agg(F.count(F.lit(1)).alias("_n"), _sha(F.array_join(F.array_sort(F.collect_list("_d")), "")).alias("_h"))
    level = fine.groupBy(*by, F.floor(F.col("_f") / 256).alias("_b")).agg(
        F.sum("_n").alias("_n"), _sha(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_f", "_h"))), lambda x: x["_h"]), "")).alias("_h")
    )
    root = _sha(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda x: x["_h"]), ""))
    return level.groupBy(*by).agg(F.sum("_n").alias("n"), root.alias("digest"))


def freeze_record(inputs: DataFrame) -> DataFrame:
    """The inputs (name, sha256, bytes) with root, the digest of the whole record."""
    root = dataset_digest(inputs, ["name", "sha256", "bytes"]).select(F.col("digest").alias("root"))
    return inputs.select("name", "sha256", "bytes").join(F.broadcast(root))  # one row


def verify_frozen(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """name, status: record modified, input missing, input changed, not frozen or ok."""
    root = frozen.agg(F.max("root").alias("_root"))
    again = dataset_digest(frozen, ["name", "sha256", "bytes"]).join(root).select((F.col("digest") != F.col("_root")).alias("_modified"))  # one row each
    c = current.select("name", F.col("sha256").alias("_sha256"), F.lit(True).alias("_there"))
    both = frozen.select("name", "sha256", F.lit(True).alias("_frozen")).join(c, "name", "full_outer").join(F.broadcast(again))
    return both.select("name", F.when(F.col("_modified"), "record modified").when(F.col("_there").isNull(), "input missing").when(F.col("_frozen").isNull(), "not frozen").when(F.col("sha256") != F.col("_sha256"), "input changed").otherwise("ok").alias("status"))


def replay_check(before: DataFrame, after: DataFrame, key: str, value: str, decision: str, tolerance: float = 1e-5) -> DataFrame:
    """n, unmatched, max_difference, decisions_equal, passed of two runs; a key that only one of them has fails."""
    b = after.select(key, F.col(value).alias("_v"), F.col(decision).alias("_d"), F.lit(True).alias("_after"))
    both = before.select(key, value, decision, F.lit(True).alias("_before")).join(b, key, "full_outer")
    pair = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    agg = both.agg(F.count_if(pair).alias("n"), F.count_if(~pair).alias("unmatched"), F.max(F.abs(F.col(value) - F.col("_v"))).alias("max_difference"), F.coalesce(F.every(F.col(decision).eqNullSafe(F.col("_d"))), F.lit(False)).alias("decisions_equal"))
    return agg.withColumn("passed", F.coalesce((F.col("n") > 0) & (F.col("unmatched") == 0) & (F.col("max_difference") <= tolerance) & F.col("decisions_equal"), F.lit(False)))


def dataset_manifest(rows: DataFrame, split: str, columns: list[str]) -> DataFrame:
    """split, n, n_shared, digest for every split, and one row 'all' whose digest is over the splits' digests.

    n_shared: rows whose content digest (the last of `columns`) another split holds too; 0 everywhere if the splits are disjoint.
    """
    from shardloom.operators.grouping import split_disjoint

    shared = split_disjoint(rows, columns[-1], split).select(split, "n_shared")
    per = dataset_digest(rows, columns, [split]).join(shared, split, "left")
    whole = per.agg(F.sum("n").alias("n"), F.sum("n_shared").alias("n_shared"), _sha(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(split, "digest"))), lambda x: x["digest"]), "")).alias("digest"))
    return per.select(F.col(split).alias("split"), "n", "n_shared", "digest").unionByName(whole.select(F.lit("all").alias("split"), "n", "n_shared", "digest"))


def run_summary(log: DataFrame, stage: str, seconds: str, peak: str) -> DataFrame:
    """stage, seconds, peak, runs, and the total in a row with a null stage."""
    return log.rollup(stage).agg(F.round(F.sum(seconds), 3).alias("seconds"), F.max(peak).alias("peak"), F.count(F.lit(1)).alias("runs"))
