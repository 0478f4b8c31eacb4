"""The report of a whole audit, as one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.operators.graph import star_links
from shardloom.operators.grouping import group_counts, heldout_support, mixed_class_groups, unused_pool
from shardloom.operators.similarity import pairs_crossing_splits


def _line(rows: DataFrame, section: str, key: Column, value: Column) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), key.alias("key"), value.cast("string").alias("value"))


def group_evidence(rows: DataFrame, item: str, digest: str, group: str, *, pairs: DataFrame | None = None, declared: str | None = None) -> DataFrame:
    """key, n: links by equal digests and by declared groups, similar pairs, groups."""
    n = lambda df, key: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(key).alias("key"), "n")
    out = n(star_links(rows, item, digest), "digest links").unionByName(n(rows.select(group).distinct(), "groups"))
    if declared:
        out = out.unionByName(n(star_links(rows, item, declared), "declared links"))
    if pairs is not None:
        out = out.unionByName(n(pairs, "similar pairs"))
    return out


def audit_report(rows: DataFrame, selected: DataFrame, pairs: DataFrame, labels: DataFrame, *, item: str, product: str, official: str, group: str, label: str, split: str, digest: str) -> DataFrame:
    """section, key, value: inventory, grouping evidence, groups, support, similar pairs that cross splits, split transitions, unused pool, exemplars.

    selected: from `select_budget`; pairs: a, b; labels: one row for each label.
    """
    counts = group_counts(rows, group, label, split, labels)
    at = F.concat_ws("/", split, label)
    inventory = rows.groupBy(product, label).agg(F.count(F.lit(1)).alias("n"))
    evidence = group_evidence(rows, item, digest, group, pairs=pairs)
    mixed = mixed_class_groups(rows, group, label).agg(F.count(F.lit(1)).alias("n"))
    moved = rows.groupBy(official, split).agg(F.count(F.lit(1)).alias("n"))
    pool = unused_pool(rows, selected, item, label, split, digest)
    return (
        _line(inventory, "inventory", F.concat_ws("/", product, label), F.col("n"))
        .unionByName(_line(evidence, "evidence", F.col("key"), F.col("n")))
        .unionByName(_line(mixed, "evidence", F.lit("mixed groups"), F.col("n")))
        .unionByName(_line(counts, "groups", at, F.col("n_groups")))
        .unionByName(_line(heldout_support(counts, split), "support", at, F.col("support")))
        .unionByName(_line(pairs_crossing_splits(pairs, rows, item, split, label), "crossing pairs", F.col("labels"), F.col("pairs")))
        .unionByName(_line(moved, "transitions", F.concat_ws("/", official, split), F.col("n")))
        .unionByName(_line(pool, "unused pool", F.concat_ws("/", label, F.col("rank").cast("string")), F.col(item)))
        .unionByName(_line(selected.where("exemplar"), "exemplars", F.concat_ws("/", label, F.col("budget_rank").cast("string")), F.col(item)))
    )
