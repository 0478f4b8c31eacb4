"""Classifier evaluation over a long table of predictions: arm, seed, item, group, true, pred, scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shardloom.functions.draws import draw_below, rank_key
from shardloom.functions.expressions import interval_side
from shardloom.operators.graph import written
from shardloom.operators.grouping import ranked_within
from shardloom.operators.prefix import running_sums

RUN = ["arm", "seed"]


def confusion(rows: DataFrame, classes: DataFrame, by: list[str] = RUN, weight: str | None = None) -> DataFrame:
    """by, true, pred, n for every pair of classes, zeros included.  classes: one row for each class, column cls."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    seen = rows.groupBy(*by, "true", "pred").agg(n.alias("n"))
    k = F.broadcast(classes.agg(F.collect_list("cls").alias("_c")))  # the classes, not the rows
    grid = rows.select(*by).distinct().join(k).select(*by, F.explode("_c").alias("true"), "_c").select(*by, "true", F.explode("_c").alias("pred"))
    return grid.join(seen, [*by, "true", "pred"], "left").na.fill(0, ["n"])


def class_metrics(cm: DataFrame, by: list[str] = RUN) -> DataFrame:
    """by, cls, support, predicted, precision, recall, f1; undefined values are null."""
    sides = cm.select(*by, F.explode(F.array(F.struct(F.col("true").alias("cls"), F.lit(1).alias("s")), F.struct(F.col("pred").alias("cls"), F.lit(0).alias("s")))).alias("x"), "true", "pred", "n")
    tp = F.sum(F.when((F.col("x.s") == 1) & (F.col("true") == F.col("pred")), F.col("n")).otherwise(0))
    agg = sides.groupBy(*by, F.col("x.cls").alias("cls")).agg(
        tp.alias("tp"), F.sum(F.when(F.col("x.s") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("x.s") == 0, F.col("n")).otherwise(0)).alias("predicted")
    )
    f1 = F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted"))
    return agg.select(
        *by, "cls", "support", "predicted", F.try_divide("tp", "predicted").alias("precision"), F.try_divide("tp", "support").alias("recall"), F.when(F.col("support") > 0, f1).alias("f1"), "tp"
    )


def run_metrics(per_class: DataFrame, by: list[str] = RUN) -> DataFrame:
    """by, macro_f1, balanced_accuracy (both over classes with support), accuracy, n, missing_classes, and as text missing (the
    classes without support) and undefined (metric:class of every value that has none), sorted and joined by commas."""
    names = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    undefined = F.flatten(F.collect_list(F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.concat(F.lit(f"{m}:"), F.col("cls").cast("string"))) for m in ("f1", "precision", "recall")]))))
    return per_class.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"), F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.sum("support").alias("n"), F.count_if(F.col("support") == 0).alias("missing_classes"),
        names(F.when(F.col("support") == 0, F.col("cls").cast("string"))).alias("missing"), F.array_join(F.array_sort(undefined), ",").alias("undefined"),
    )


def average_precision(rows: DataFrame, by: list[str] = RUN, weight: str | None = None) -> DataFrame:
    """by, cls, ap: one-vs-rest, step-wise over distinct scores; null if a class has no positive.  Needs the column scores.

    Equal scores are added up first, and distinct ones are summed range by range, so no task holds a class.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    flat = rows.select(*by, "true", w.alias("_w"), F.posexplode("scores").alias("cls", "score"))
    level = flat.groupBy(*by, "cls", "score").agg(F.sum(F.when(F.col("true") == F.col("cls"), F.col("_w")).otherwise(0)).alias("_p"), F.sum("_w").alias("_a"))
    steps = running_sums(level, [*by, "cls"], [F.col("score").desc()], {"_found": "_p", "_taken": "_a"})
    precision = F.try_divide(F.col("_found") + F.col("_p"), F.col("_taken") + F.col("_a"))
    return steps.groupBy(*by, "cls").agg(F.try_divide(F.sum(F.col("_p") * precision), F.sum("_p")).alias("ap"))


def macro_auprc(ap: DataFrame, by: list[str] = RUN) -> DataFrame:
    return ap.groupBy(*by).agg(F.avg("ap").alias("macro_auprc"))


def metric_summary(values: DataFrame, metrics: list[str]) -> DataFrame:
    """arm, metric, mean, min, max over seeds."""
    long = values.select("arm", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("x"))
    return long.groupBy("arm", "x.metric").agg(F.avg("x.value").alias("mean"), F.min("x.value").alias("min"), F.max("x.value").alias("max"))


def group_strata(rows: DataFrame, group: str = "group", label: str = "true") -> DataFrame:
    """group, stratum (the set of classes it holds), index in its stratum (from 0, in hash order), size of the stratum."""
    held = rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(F.col(label).cast("string"))), ",").alias("stratum"))
    ranked = ranked_within(held.withColumn("_key", rank_key("strata", F.col(group))), "stratum", "_key")
    size = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    return ranked.join(size, "stratum").select(group, "stratum", F.col("_rank").alias("index"), "size")


def bootstrap_draws(strata: DataFrame, resamples: int, seed: int, group: str = "group") -> DataFrame:
    """resample, group, multiplicity: in each stratum as many groups as it has, drawn with replacement.

    One draw serves all arms and metrics.  Rows are resamples x groups: strata go to a task for every few resamples, which are drawn and counted there.
    """
    step = max(1, -(-resamples // 100))
    blocks = strata.select("stratum", F.col("index").alias("_slot"), "size", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(step))).alias("_from"))
    slots = blocks.repartition(-(-resamples // step), "_from").withColumn("resample", F.explode(F.sequence("_from", F.least(F.col("_from") + (step - 1), F.lit(resamples - 1)))))
    drawn = slots.select("_from", "resample", "stratum", draw_below(F.col("size"), "bootstrap", seed, F.col("resample"), F.col("stratum"), F.col("_slot")).alias("index"))
    counted = drawn.groupBy("_from", "resample", "stratum", "index").agg(F.count(F.lit(1)).alias("multiplicity"))
    return counted.join(strata.select("stratum", F.col("index").cast("long").alias("index"), group), ["stratum", "index"]).select("resample", group, "multiplicity")


def resampled_metrics(rows: DataFrame, draws: DataFrame, classes: DataFrame, group: str = "group") -> DataFrame:
    """resample, arm, seed, macro_f1, balanced_accuracy from each group's counts times its multiplicity."""
    counts = rows.groupBy(*RUN, group, "true", "pred").agg(F.count(F.lit(1)).alias("_n"))
    weighted = draws.join(counts, group).withColumn("_w", F.col("_n") * F.col("multiplicity"))
    by = ["resample", *RUN]
    return run_metrics(class_metrics(confusion(weighted, classes, by, "_w"), by), by)


def _packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix of counts as bytes, in the narrowest type that holds them all; a row of zeros is empty."""
    x = np.ascontiguousarray(x, np.min_scalar_type(int(x.max(initial=0))))
    full = x.any(axis=1)
    ends = np.concatenate(([0], np.cumsum(full * (x.shape[1] * x.itemsize)))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x[full].tobytes())])


def _unpacked(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The matrix of `_packed` rows, whatever type each has."""
    out = np.zeros((len(column), width), np.int64)
    at = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].astype(np.int64) if len(chunk) else np.zeros(1, np.int64)
        data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        size = np.diff(ends)
        for n in np.unique(size[size > 0]):
            own = np.flatnonzero(size == n)
            out[at + own] = data[ends[own][:, None] + np.arange(n)].view(f"u{n // width}")
        at += len(chunk)
    return out


def resampled_auprc(rows: DataFrame, draws: DataFrame, group: str = "group", *, block: int = 250, range_rows: int = 1 << 13) -> DataFrame:
    """resample, arm, seed, macro_auprc: `average_precision` of every resample, each score counted with its group's multiplicity.

    The scores of a run and class are cut into ranges of about `range_rows`; a task takes one range with `block` resamples, whose running sums are
    columns of one matrix and begin with what the ranges above hold.  Equal scores are added up where they are met, so ties make no range large.
    Multiplicities travel as bytes, a row of a matrix for each score, mostly one byte a resample.
    """
    names = [*RUN, "_cls", "_block"]
    drawn = draws.groupBy(group, F.floor(F.col("resample") / block).alias("_block")).agg(F.collect_list((F.col("resample") % block).cast("int")).alias("_i"), F.collect_list(F.col("multiplicity").cast("long")).alias("_m"))

    def pack(batches):
        for batch in batches:
            i, m = batch.column(2), batch.column(3)
            weight = np.zeros((batch.num_rows, block), np.int64)
            weight[np.repeat(np.arange(batch.num_rows), i.value_lengths().to_numpy()), i.flatten().to_numpy()] = m.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed(weight)], names=[group, "_block", "_draws"])

    lists = written(drawn.mapInArrow(pack, f"`{group}` {draws.schema[group].dataType.simpleString()}, _block long, _draws binary"), "lists")
    most = rows.groupBy(*RUN).count().agg(F.max("count")).first()[0] or 0
    ranges = max(1, -(-most // range_rows))
    # A small table is few tasks, and every row becomes classes x blocks rows.
    flat = rows.repartition(max(8, most // 512), group).select(*RUN, group, "true", F.posexplode("scores").alias("_cls", "_score"))
    cuts = {}
    if ranges > 1:
        at = F.percentile_approx("_score", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(20 * ranges))
        cuts = {(*(r[c] for c in RUN), r["_cls"]): np.unique(r["at"]) for r in flat.groupBy(*RUN, "_cls").agg(at.alias("at")).collect()}
    keyed = flat.select(*RUN, "_cls", group, "_score", (F.col("true") == F.col("_cls")).alias("_hit")).join(lists, group).select(*names, "_score", "_hit", "_draws")

    def combine(batches):
        for batch in (whole.slice(k, 4096) for whole in batches for k in range(0, whole.num_rows, 4096)):
            code = np.zeros(batch.num_rows, np.int64)
            for c in range(len(names)):
                words = batch.column(c).dictionary_encode()
                code = code * len(words.dictionary) + words.indices.to_numpy()
            score = batch.column(len(names)).to_numpy()
            order = np.lexsort((-score, code))
            code, score = code[order], score[order]
            first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (score[1:] != score[:-1]))))
            weight = _unpacked(batch.column(len(names) + 2), block)[order]
            hit = batch.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(np.int64)[order]
            taken, found = np.add.reduceat(weight, first, axis=0), np.add.reduceat(weight * hit[:, None], first, axis=0)
            keys = [batch.column(c).take(pa.array(order[first])) for c in range(len(names))]
            span = np.zeros(len(first), np.int64)
            if cuts:
                new = np.flatnonzero(np.concatenate(([True], np.diff(code[first]) != 0)))
                for a, b in zip(new.tolist(), [*new[1:].tolist(), len(first)], strict=True):
                    own = cuts[tuple(k[a].as_py() for k in keys[:-1])]
                    span[a:b] = len(own) - np.searchsorted(own, score[first][a:b], side="right")
            yield pa.RecordBatch.from_arrays([*keys, pa.array(span), pa.array(score[first]), _packed(found), _packed(taken)], names=[*names, "_range", "_score", "p", "a"])

    kinds = ", ".join(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in names)
    weighed = keyed.mapInArrow(combine, f"{kinds}, _range long, _score double, p binary, a binary")
    matrix = lambda column: _unpacked(column, block)

    def totals(batches):
        held: dict[tuple, np.ndarray] = {}

        def batch_of():
            columns = list(zip(*held, strict=True))
            values = [_packed(np.stack([v[i] for v in held.values()])) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), *values], names=[*names, "_range", "p", "a"])

        for batch in batches:
            types = [batch.column(c).type for c in range(len(names) + 1)]
            both = np.stack((matrix(batch.column(len(names) + 2)), matrix(batch.column(len(names) + 3))), 1)
            place: dict[tuple, list] = {}
            for r, k in enumerate(zip(*(batch.column(c).to_pylist() for c in range(len(names) + 1)), strict=True)):
                place.setdefault(k, []).append(r)
            for k, own in place.items():
                v = both[own].sum(axis=0)
                held[k] = held[k] + v if k in held else v
            if len(held) > 2_000:
                yield batch_of()
                held = {}
        if held:
            yield batch_of()

    def carry(table: pa.Table) -> pa.Table:
        span, place = np.unique(table.column("_range").to_numpy(), return_inverse=True)
        p, a = np.zeros((len(span), block), np.int64), np.zeros((len(span), block), np.int64)
        np.add.at(p, place, matrix(table.column("p")))
        np.add.at(a, place, matrix(table.column("a")))
        own = {c: pa.array([table.column(c)[0].as_py()] * len(span), table.schema.field(c).type) for c in names}
        return pa.table({**own, "_range": span, "p0": _packed(np.cumsum(p, axis=0) - p), "a0": _packed(np.cumsum(a, axis=0) - a), "all": _packed(np.repeat(p.sum(axis=0)[None], len(span), axis=0))})

    def precision(table: pa.Table, carried: pa.Table) -> pa.Table:
        score = table.column("_score").to_numpy()
        order = np.argsort(-score, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], score[order][1:] != score[order][:-1])))
        p, a = (np.add.reduceat(matrix(table.column(c))[order], first, axis=0) for c in "pa")
        p0, a0, total = (matrix(carried.column(c))[0] for c in ("p0", "a0", "all"))
        ap = (p * (p0 + np.cumsum(p, axis=0)) / np.maximum(a0 + np.cumsum(a, axis=0), 1)).sum(axis=0) / np.maximum(total, 1)
        own = {c: pa.array([table.column(c)[0].as_py()] * block, table.schema.field(c).type) for c in names[:-1]}
        return pa.table({**own, "resample": pa.array(table.column("_block")[0].as_py() * block + np.arange(block)), "ap": pa.array(ap, mask=total == 0)})

    sums = weighed.mapInArrow(totals, f"{kinds}, _range long, p binary, a binary")
    carried = written(sums.groupBy(*names).applyInArrow(carry, f"{kinds}, _range long, p0 binary, a0 binary, all binary"), "carried")
    own = ", ".join(f"{c} {keyed.schema[c].dataType.simpleString()}" for c in names[:-1])
    parts = weighed.groupBy(*names, "_range").cogroup(carried.groupBy(*names, "_range")).applyInArrow(precision, f"{own}, resample long, ap double")
    ap = parts.where("ap is not null").groupBy("resample", *RUN, "_cls").agg(F.sum("ap").alias("ap"))
    return ap.groupBy("resample", *RUN).agg(F.avg("ap").alias("macro_auprc"))


def per_seed_contrast(observed: DataFrame, arm: str, reference: str, metrics: list[str]) -> DataFrame:
    """metric, seed, difference of arm - reference."""
    long = observed.where(F.col("arm").isin(arm, reference)).select("arm", "seed", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("x"))
    signed = F.when(F.col("arm") == arm, F.col("x.value")).otherwise(-F.col("x.value"))
    return long.groupBy("x.metric", "seed").agg(F.sum(signed).alias("difference"))


def paired_contrast(observed: DataFrame, resampled: DataFrame, arm: str, reference: str, metrics: list[str]) -> DataFrame:
    """metric, mean_difference, low, high, above_zero of arm - reference: mean over seeds, 95 % percentile interval."""

    def difference(values: DataFrame, by: list[str]) -> DataFrame:
        long = values.where(F.col("arm").isin(arm, reference)).select(*by, "arm", "seed", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("x"))
        signed = F.when(F.col("arm") == arm, F.col("x.value")).otherwise(-F.col("x.value"))
        per_seed = long.groupBy(*by, "x.metric", "seed").agg(F.sum(signed).alias("_d"))
        return per_seed.groupBy(*by, "metric").agg(F.avg("_d").alias("_d"))

    seen = difference(observed, []).withColumnRenamed("_d", "mean_difference")
    drawn = difference(resampled, ["resample"]).groupBy("metric").agg(
        F.percentile("_d", F.lit(0.025)).alias("low"), F.percentile("_d", F.lit(0.975)).alias("high"), F.avg((F.col("_d") > 0).cast("double")).alias("above_zero")
    )
    return seen.join(drawn, "metric")


def co_primary_verdict(contrast: DataFrame, support: DataFrame, primary: tuple[str, ...] = ("macro_f1", "balanced_accuracy"), valid: Column | None = None) -> DataFrame:
    """claim, insufficient, sparse: better or worse only if both co-primary intervals agree; withheld without support."""
    side = interval_side(F.col("low"), F.col("high"))
    sides = contrast.where(F.col("metric").isin(*primary)).agg(
        F.count_if(side == "above zero").alias("_up"), F.count_if(side == "below zero").alias("_down")
    )
    held = support.agg(F.count_if(F.col("support") == "insufficient").alias("insufficient"), F.count_if(F.col("support") == "sparse").alias("sparse"))
    ok = (F.lit(True) if valid is None else valid) & (F.col("insufficient") == 0)
    claim = F.when(~ok, "withheld").when(F.col("_up") == len(primary), "better").when(F.col("_down") == len(primary), "worse").otherwise("no co-primary claim")
    return sides.join(held).select(claim.alias("claim"), "insufficient", "sparse")  # one row each


def detection_counts(cm: DataFrame, normal: int = 0, by: list[str] = RUN) -> DataFrame:
    """Normal against any defect: by, defects, flagged_defects, normals, false_alarms, correct_subtype."""
    t, p, n = F.col("true"), F.col("pred"), F.col("n")
    total = lambda when: F.sum(F.when(when, n).otherwise(0))
    return cm.groupBy(*by).agg(
        total(t != normal).alias("defects"), total((t != normal) & (p != normal)).alias("flagged_defects"), total(t == normal).alias("normals"),
        total((t == normal) & (p != normal)).alias("false_alarms"), total((t != normal) & (t == p)).alias("correct_subtype"),
    )


def claim_table(per_seed: DataFrame, contrast: DataFrame, verdict: DataFrame, detection: DataFrame, arm: str, reference: str) -> DataFrame:
    """Five derived rows (ord, claim, level): sign on every seed, co-primary rule, ranking, detection trend, operational."""

    def trend(rows: DataFrame, value: str, alias: str) -> DataFrame:
        signed = F.when(F.col("arm") == arm, F.col(value)).when(F.col("arm") == reference, -F.col(value))
        d = rows.where(F.col("arm").isin(arm, reference)).groupBy("seed").agg(F.sum(signed).alias("_d"))
        return d.agg(F.when(F.min("_d") > 0, "higher").when(F.max("_d") < 0, "lower").otherwise("mixed").alias(alias))

    sign = trend(per_seed, "macro_f1", "s").select(F.lit(1).alias("ord"), F.lit("one sign of the macro-F1 change on every seed").alias("claim"), F.when(F.col("s") == "mixed", "not shown").otherwise("supported (signal)").alias("level"))
    rule = verdict.select(F.lit(2), F.lit("co-primary rule"), F.col("claim"))
    side = interval_side(F.col("low"), F.col("high"))
    rank = contrast.where("metric = 'macro_auprc'").join(verdict.select(F.col("claim").alias("_verdict"))).select(F.lit(3), F.lit("ranking without a threshold"), F.when(F.col("_verdict") == "withheld", "withheld").otherwise(side))  # one row each
    seen = trend(detection, "flagged_defects", "d").select(F.lit(4), F.lit("flags more defects"), F.concat(F.lit("descriptive only: "), "d"))
    rest = verdict.select(F.lit(5), F.lit("improves inspection in practice"), F.lit("not tested (operational)"))
    return sign.union(rule).union(rank).union(seen).union(rest)


def f1_decomposition(per_class: DataFrame, arm: str, reference: str) -> DataFrame:
    """seed, cls, change: per-class F1 changes and, by grouping sets, their means: a seed's is its macro-F1 change exactly."""
    signed = F.when(F.col("arm") == arm, F.col("f1")).otherwise(-F.col("f1"))
    d = per_class.where(F.col("arm").isin(arm, reference)).where("f1 is not null").groupBy("seed", "cls").agg(F.sum(signed).alias("_d"))
    return d.groupingSets([["seed", "cls"], ["seed"], ["cls"], []], "seed", "cls").agg(F.avg("_d").alias("change"))


def error_rows(rows: DataFrame, seed: int, majority: int, others: int = 6, most: int = 2) -> DataFrame:
    """Misclassified items of a seed: the first `others` of the other classes and `most` of the majority class per arm."""
    wrong = rows.where((F.col("seed") == seed) & (F.col("true") != F.col("pred"))).withColumn("is_majority", F.col("true") == majority)
    ranked = wrong.withColumn("rank", F.row_number().over(Window.partitionBy("arm", "is_majority").orderBy("item")).cast("long"))
    return ranked.where(F.col("rank") <= F.when(F.col("is_majority"), most).otherwise(others)).select("arm", "is_majority", "rank", "item", "true", "pred")


def mse_report(errors: DataFrame) -> DataFrame:
    """id, sigma, mse by grouping sets: per record (6 places), per level, and overall the mean of the rounded records."""
    record = errors.groupBy("id").agg(F.round(F.avg("mse"), 6).alias("mse"))
    level = errors.groupBy("sigma").agg(F.round(F.avg("mse"), 6).alias("mse"))
    overall = record.agg(F.round(F.avg("mse"), 6).alias("mse"))
    null = lambda kind: F.lit(None).cast(kind)
    kind = errors.schema["id"].dataType.simpleString()
    return record.select("id", null("double").alias("sigma"), "mse").unionByName(level.select(null(kind).alias("id"), "sigma", "mse")).unionByName(overall.select(null(kind).alias("id"), null("double").alias("sigma"), "mse"))


def inventory_counts(rows: DataFrame, product: str, label: str) -> DataFrame:
    """product, label, n by rollup: subtotals have null labels, the total two nulls."""
    return rows.rollup(product, label).agg(F.count(F.lit(1)).alias("n"))


def inventory_details(rows: DataFrame, path: str, split: str, mode: str, width: str, height: str, decoded: str) -> DataFrame:
    """section, key, n: items by official split, by mode and size, and every undecodable path."""
    count = lambda section, key, df: df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "key", "n")
    ok = rows.where(F.col(decoded))
    size = F.concat(F.col(mode), F.lit(" "), F.col(width).cast("string"), F.lit("x"), F.col(height).cast("string"))
    return count("official split", F.coalesce(F.col(split), F.lit("")), rows).unionByName(count("mode", size, ok)).unionByName(count("undecodable", F.col(path), rows.where(~F.col(decoded))))


def inventory_diff(measured: DataFrame, documented: DataFrame, by: list[str]) -> DataFrame:
    """by, measured, documented, difference; a missing count is 0."""
    both = measured.select(*by, F.col("n").alias("measured")).join(documented.select(*by, F.col("n").alias("documented")), by, "full_outer")
    return both.na.fill(0, ["measured", "documented"]).withColumn("difference", F.col("measured") - F.col("documented"))


def paired_compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after, change of two tables side by side; absent values stay null."""
    both = left.select(key, F.col(value).alias("before")).join(right.select(key, F.col(value).alias("after")), key, "full_outer")
    return both.withColumn("change", F.col("after") - F.col("before"))
