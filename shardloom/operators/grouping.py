"""Duplicates, groups, conflicts and the rules of a leakage-safe split."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shardloom.functions.draws import draw, rank_key
from shardloom.operators.graph import connected_components, star_links

FRACTIONS = (("train", 0.6), ("val", 0.2), ("test", 0.2))


def exact_duplicates(rows: DataFrame, item: str, digest: str, order: str) -> DataFrame:
    """dropped, kept: later rows of a digest and the first one, by `order`."""
    first = rows.groupBy(digest).agg(F.min_by(item, F.struct(order, item)).alias("kept"))
    return rows.join(first, digest).where(F.col(item) != F.col("kept")).select(F.col(item).alias("dropped"), "kept")


def assign_groups(rows: DataFrame, item: str, digest: str, *, pairs: DataFrame | None = None, declared: str | None = None) -> DataFrame:
    """item, group_id: components over equal digests, equal declared groups and similar pairs (a, b).

    A group is named after its smallest digest: 'g_' and 16 hex digits.
    """
    links = star_links(rows, item, digest)
    if declared:
        links = links.unionByName(star_links(rows, item, declared))
    if pairs is not None:
        links = links.unionByName(pairs.select("a", "b"))
    found = rows.select(item, digest).join(connected_components(rows, item, links), item)
    names = found.groupBy("component").agg(F.concat(F.lit("g_"), F.substring(F.min(digest), 1, 16)).alias("group_id"))
    return found.join(names, "component").select(item, "group_id")


def exclusions(rows: DataFrame, digest: str, label: str, decoded: str) -> DataFrame:
    """The rows with exclusion_reason: decode-failure, label-conflict-duplicate (a digest with several labels: all copies) or ''."""
    labels = rows.where(F.col(decoded)).groupBy(digest).agg((F.count_distinct(label) > 1).alias("_conflict"))
    reason = F.when(~F.col(decoded), "decode-failure").when(F.col("_conflict"), "label-conflict-duplicate").otherwise("")
    return rows.join(labels, digest, "left").withColumn("exclusion_reason", reason).drop("_conflict")


def quota_split(groups: DataFrame, group: str, size: str, stratum: str, version: str, *, buckets: int = 64) -> DataFrame:
    """group, split: in hash order, a stratum's groups fill train, val and test by cumulative size.

    The running total is two-level (buckets of the hash order, then inside a bucket), so no stratum has to be
    sorted in one task.
    """
    key = rank_key(version, "split", F.col(group))
    bucket = F.conv(F.substring("_key", 1, 4), 16, 10).cast("int") % 65536 * buckets / 65536
    g = groups.withColumn("_key", key).withColumn("_bucket", F.floor(bucket).cast("int"))
    totals = g.groupBy(stratum, "_bucket").agg(F.sum(size).alias("_n"))
    along = Window.partitionBy(stratum).orderBy("_bucket")
    base = totals.select(stratum, "_bucket", (F.sum("_n").over(along) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy(stratum)).alias("_all"))
    inner = Window.partitionBy(stratum, "_bucket").orderBy("_key")
    before = F.col("_base") + F.sum(size).over(inner) - F.col(size)
    share = before / F.col("_all")
    cut = F.lit(0.0)
    name = F.lit(FRACTIONS[-1][0])
    ends = []
    for split, f in FRACTIONS[:-1]:
        cut = cut + F.lit(f)
        ends.append((split, cut))
    for split, end in reversed(ends):
        name = F.when(share < end, split).otherwise(name)
    return g.join(base, [stratum, "_bucket"]).select(group, stratum, name.alias("split"))


def greedy_split(groups: DataFrame, group: str, label: str, size: str, version: str) -> DataFrame:
    """group, split: groups in hash order, each whole to the split with the largest shortfall of what it holds.

    groups: one row for each label that a group holds, with how many items.  A split's shortfall of a label is relative to what it should
    hold of it; a group of several labels weighs them by its counts; ties go to the earlier split.

    The rule depends on all earlier groups that share a label, so the groups of a connected set of labels are
    folded in one task; `quota_split` is the form without that limit and the one to use beyond some millions of groups.
    """
    rows = groups.groupBy(group, label).agg(F.sum(size).cast("long").alias("_n"))
    names = rows.select(label).distinct()
    sets = connected_components(names, label, star_links(rows, label, group))
    keyed = rows.join(F.broadcast(sets), label).groupBy("component", group).agg(F.map_from_entries(F.collect_list(F.struct(F.col(label).cast("string"), "_n"))).alias("_counts"))
    keyed = keyed.withColumn("_key", rank_key(version, "split", F.col(group)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key")
        vectors = [dict(x) for x in pdf["_counts"]]
        totals: dict[str, int] = {}
        for vector in vectors:
            for name, n in vector.items():
                totals[name] = totals.get(name, 0) + n
        have = {name: [0] * len(FRACTIONS) for name in totals}
        out = []
        for vector in vectors:
            short = [sum(n * ((f * totals[name] - have[name][i]) / (f * totals[name])) for name, n in sorted(vector.items())) for i, (_, f) in enumerate(FRACTIONS)]
            at = short.index(max(short))
            for name, n in vector.items():
                have[name][at] += n
            out.append(FRACTIONS[at][0])
        return pd.DataFrame({group: pdf[group], "split": out})

    kind = groups.schema[group].dataType.simpleString()
    return keyed.groupBy("component").applyInPandas(fold, f"`{group}` {kind}, split string")


def hash_split(key, version: str):
    """Split name by threshold on the hash: stateless, the same on a stream, fractions approximate."""
    u = draw(version, "split", key)
    return F.when(u < 0.6, "train").when(u < 0.8, "val").otherwise("test")


def group_leakage(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups in more than one of train, val and test, with their sorted splits."""
    live = rows.where(F.col(split).isin("train", "val", "test"))
    return live.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits")).where(F.col("splits").contains(","))


def split_disjoint(rows: DataFrame, digest: str, split: str) -> DataFrame:
    """split, n_rows, n_shared: rows of each split, and how many have a digest that another split holds too."""
    shared = rows.groupBy(digest).agg((F.count_distinct(split) > 1).alias("_shared"))
    return rows.join(shared, digest).groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("_shared").alias("n_shared"))


def ranked_within(rows: DataFrame, by: str, key: str, *, buckets: int = 64) -> DataFrame:
    """The rows with _rank (from 0) inside `by` in order of the hexadecimal hash `key`; no class has to be sorted in one task.

    Two levels: how many rows the hash ranges before hold, and the place inside a range.
    """
    bucket = F.floor(F.conv(F.substring(key, 1, 4), 16, 10).cast("long") * buckets / 65536).cast("int")
    r = rows.withColumn("_bucket", bucket)
    n = r.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    base = n.select(by, "_bucket", (F.sum("_n").over(Window.partitionBy(by).orderBy("_bucket")) - F.col("_n")).alias("_base"))
    inner = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(key))
    return r.join(base, [by, "_bucket"]).withColumn("_rank", (F.col("_base") + inner - 1).cast("long")).drop("_base", "_bucket")


def select_budget(rows: DataFrame, item: str, group: str, label: str, split: str, digest: str, budgets: DataFrame, version: str, exemplars: int = 3) -> DataFrame:
    """label, item, group, budget_rank, exemplar: per class the first training groups in hash order up to its budget, and in
    each the item with the smallest hash of its digest.  budgets: label, budget."""
    best = rows.where(F.col(split) == "train").groupBy(label, group).agg(F.min_by(item, F.struct(rank_key(version, "representative", F.col(digest)), item)).alias(item))
    ranked = ranked_within(best.withColumn("_key", rank_key(version, "budget", F.col(group))), label, "_key").withColumnRenamed("_rank", "budget_rank")
    return ranked.join(F.broadcast(budgets), label).where("budget_rank < budget").select(label, item, group, "budget_rank", (F.col("budget_rank") < exemplars).alias("exemplar"))


def split_shortfalls(rows: DataFrame, group: str, label: str, split: str, budgets: DataFrame, minimum: int = 5) -> DataFrame:
    """label, problem: too few training groups for a budget, or too few val or test items."""
    n = rows.groupBy(label).agg(
        F.count_distinct(F.when(F.col(split) == "train", F.col(group))).alias("g"), F.count_if(F.col(split) == "val").alias("v"), F.count_if(F.col(split) == "test").alias("t")
    )
    full = budgets.join(n, label, "left").na.fill(0)
    text = lambda c, what: F.when(F.col(c) < minimum, F.concat(F.col(label), F.lit(": "), F.col(c).cast("string"), F.lit(f" {what} items (minimum {minimum})")))
    first = F.when(F.col("g") < F.col("budget"), F.concat(F.col(label), F.lit(": "), F.col("g").cast("string"), F.lit(" training groups for a budget of "), F.col("budget").cast("string")))
    return full.select(label, F.explode(F.array_compact(F.array(first, text("v", "val"), text("t", "test")))).alias("problem"))


def mixed_class_groups(rows: DataFrame, group: str, label: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count_distinct(label).alias("labels")).where("labels > 1")


def group_counts(rows: DataFrame, group: str, label: str, split: str, labels: DataFrame) -> DataFrame:
    """split, label, n_groups for every split and label, zeros included.  labels: one row for each label."""
    n = rows.groupBy(split, label).agg(F.count_distinct(group).alias("n_groups"))
    grid = labels.select(label, F.explode(F.array(*[F.lit(s) for s, _ in FRACTIONS])).alias(split))
    return grid.join(n, [split, label], "left").na.fill(0, ["n_groups"])


def heldout_support(counts: DataFrame, split: str, minimum: int = 15, sparse: int = 30) -> DataFrame:
    """The val and test rows of `group_counts` with support: insufficient, sparse or sufficient."""
    n = F.col("n_groups")
    return counts.where(F.col(split) != "train").withColumn("support", F.when(n < minimum, "insufficient").when(n < sparse, "sparse").otherwise("sufficient"))


def fixed_split_refusals(rows: DataFrame, label: str, sizes: tuple[int, int, int] = (6, 2, 2)) -> DataFrame:
    """label, message of every label with fewer items than a fixed split takes."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < sum(sizes))
    return n.select(label, F.concat(F.lit("only "), F.col("_n").cast("string"), F.lit(f" items; {sum(sizes)} are needed")).alias("message"))


def stratified_fixed_split(rows: DataFrame, item: str, label: str, seed: int, sizes: tuple[int, int, int] = (6, 2, 2)) -> DataFrame:
    """label, source_id, split, id: per label in drawn order the first sizes[0] train, then val, then test.

    Labels that `fixed_split_refusals` names give what they have.
    """
    a, b, c = sizes
    ranked = ranked_within(rows.select(label, item, rank_key("fixed", seed, F.col(item)).alias("_key")), label, "_key").withColumn("_r", (F.col("_rank") + 1).cast("int")).where(F.col("_r") <= a + b + c)
    split = F.when(F.col("_r") <= a, "train").when(F.col("_r") <= a + b, "val").otherwise("test")
    named = ranked.withColumn("split", split)
    return named.select(label, F.col(item).alias("source_id"), "split", F.format_string("%s-%s-%03d", F.col("split"), F.col(label).cast("string"), F.col("_r")).alias("id"))


def stratified_fraction_split(rows: DataFrame, item: str, caption: str, seed: int, val: float = 0.2, test: float = 0.2, digest: str | None = None) -> DataFrame:
    """item, caption, split per caption in drawn order: n >= 3: at least one test item, round half to even; n < 3: all train.

    With `digest`, of items with one content digest only the smallest takes part.
    """
    if digest:
        rows = rows.join(rows.groupBy(digest).agg(F.min(item).alias(item)), [digest, item], "left_semi")
    ranked = ranked_within(rows.select(item, caption, rank_key("fraction", seed, F.col(item)).alias("_key")), caption, "_key")
    n = rows.groupBy(caption).agg(F.count(F.lit(1)).alias("_n"))
    t = F.when(F.col("_n") >= 3, F.greatest(F.lit(1), F.bround(F.col("_n") * test)).cast("long")).otherwise(0)
    v = F.when(F.col("_n") >= 3, F.bround(F.col("_n") * val).cast("long")).otherwise(0)
    return ranked.join(n, caption).select(item, caption, F.when(F.col("_rank") < t, "test").when(F.col("_rank") < t + v, "val").otherwise("train").alias("split"))


def fraction_split_refusals(split_rows: DataFrame, split: str = "split", minimum: int = 4) -> DataFrame:
    """message for a split without a test item, and for one with fewer than `minimum` training items; no row for a valid one."""
    n = split_rows.agg(F.count_if(F.col(split) == "test").alias("t"), F.count_if(F.col(split) == "train").alias("r"))
    none = F.when(F.col("t") == 0, "the split leaves no test item: a caption needs three or more items")
    few = F.when(F.col("r") < minimum, F.concat(F.lit("the split leaves "), F.col("r").cast("string"), F.lit(f" training items (minimum {minimum})")))
    return n.select(F.explode(F.array_compact(F.array(none, few))).alias("message"))


def split_crosstab(rows: DataFrame, label: str, split: str) -> DataFrame:
    """label and the number of rows in each split."""
    return rows.groupBy(label).pivot(split, [s for s, _ in FRACTIONS]).count().na.fill(0)


def unused_pool(rows: DataFrame, selected: DataFrame, item: str, label: str, split: str, digest: str, per_class: int = 2) -> DataFrame:
    """label, item, rank: the first `per_class` unused training items of each class in hash order."""
    free = rows.where(F.col(split) == "train").join(selected.select(item), item, "left_anti")
    order = Window.partitionBy(label).orderBy(rank_key("new", F.col(digest)), item)
    return free.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= per_class).select(label, item, "rank")


def first_per_class(rows: DataFrame, item: str, label: str, n: int = 3) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(item)).cast("long"))
    return ranked.where(F.col("rank") <= n).select(label, item, "rank")


def distinct_first_seen(rows: DataFrame, value: str, order: str, limit: int | None = None) -> DataFrame:
    """value, first_seen: the distinct values by where they first stand; with `limit`, the first of them."""
    found = rows.groupBy(value).agg(F.min(order).alias("first_seen"))
    return found if limit is None else found.orderBy("first_seen", value).limit(limit)
