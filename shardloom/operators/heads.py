"""Matched linear heads on frozen vectors: training by mini-batches in slot order, history by epoch, choice, prediction.

Every run (seed, arm) is one sequence of updates, so it is one ordered stream of a task: slots are partitioned by run and sorted by
slot, and a task holds the weights and one mini-batch, however many slots a run has.  Runs train side by side.  Validation
and prediction are passes over the vectors, spread over all tasks, with the heads sent along in bounded parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.vectors import valid_vector
from shardloom.operators import metrics as M
from shardloom.operators.graph import written
from shardloom.operators.shipping import ship_code
from shardloom.operators.training import select_epoch

RUN = ["seed", "arm"]
#: AdamW, fixed values of the experiment.
LEARNING_RATE, WEIGHT_DECAY, BETAS, EPSILON = 1e-3, 1e-4, (0.9, 0.999), 1e-8
BATCH, UPDATES_PER_EPOCH = 32, 32
#: Bytes of heads sent to the tasks at once, and numbers that a task computes at once.
HEAD_BYTES, SLICE_NUMBERS = 32 << 20, 1 << 22


def start_weights(seed: int, classes: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights and biases that all arms of a seed start from: uniform within 1 / sqrt(size)."""
    r = np.random.default_rng([seed])
    limit = size**-0.5
    return r.uniform(-limit, limit, (classes, size)), r.uniform(-limit, limit, classes)


class AdamW:
    """Softmax cross-entropy on mini-batches; the decay acts on the weights, not through the gradient."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, learning_rate: float, weight_decay: float):
        self.head = [weights.copy(), bias.copy()]
        self.first, self.second = ([np.zeros_like(p) for p in self.head] for _ in range(2))
        self.steps, self.rate, self.decay = 0, learning_rate, weight_decay

    def update(self, x: np.ndarray, y: np.ndarray) -> float:
        """One step; the loss of the batch before it."""
        s = x @ self.head[0].T + self.head[1]
        s -= s.max(axis=1, keepdims=True)
        p = np.exp(s)
        total = p.sum(axis=1, keepdims=True)
        rows = np.arange(len(y))
        loss = float((np.log(total[:, 0]) - s[rows, y]).mean())
        p /= total
        p[rows, y] -= 1
        p /= len(y)
        self.steps += 1
        for i, g in enumerate((p.T @ x, p.sum(axis=0))):
            self.first[i] = BETAS[0] * self.first[i] + (1 - BETAS[0]) * g
            self.second[i] = BETAS[1] * self.second[i] + (1 - BETAS[1]) * g * g
            m, v = self.first[i] / (1 - BETAS[0] ** self.steps), self.second[i] / (1 - BETAS[1] ** self.steps)
            self.head[i] = self.head[i] * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + EPSILON)
        return loss


def _flat(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def fit_heads(
    slots: DataFrame, *, classes: int, size: int, batch: int = BATCH, updates_per_epoch: int = UPDATES_PER_EPOCH, learning_rate: float = LEARNING_RATE, weight_decay: float = WEIGHT_DECAY
) -> DataFrame:
    """seed, arm, epoch (from 1), train_loss, weights, bias after every epoch (a written table).

    slots: seed (whole number), arm, slot, cls, vector, as from `slot_features`; `batch` slots make an update and `updates_per_epoch` updates an epoch, in slot order.
    Equal slots are ordered by their vectors, so the result doesn't depend on partitioning.  Slots without a valid vector or class
    are left out of their batch; a batch without slots is no update.  Loss is the mean over an epoch's updates, to 5 places.
    """
    ship_code(slots.sparkSession)
    usable = slots.where(valid_vector(F.col("vector"), size) & F.col("cls").between(0, classes - 1))
    rows = usable.select(*RUN, F.col("slot").cast("long").alias("slot"), F.col("cls").cast("long").alias("cls"), F.col("vector").cast("array<double>").alias("vector"))
    runs = max(1, rows.select(*RUN).distinct().count())
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in RUN)
    types = [rows.select(c).limit(0).toArrow().schema.field(0).type for c in RUN]

    def task(batches):
        run, update, held, state, losses = None, None, [], None, []

        def step():
            losses.append(state.update(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])))
            held.clear()

        def epoch_done(epoch):
            w, b = state.head
            out = pa.RecordBatch.from_arrays(
                [*(pa.array([v], t) for v, t in zip(run, types, strict=True)), pa.array([epoch + 1], pa.int32()), pa.array([round(float(np.mean(losses)), 5)]), pa.array([w.tolist()], pa.list_(pa.list_(pa.float64()))), pa.array([b.tolist()], pa.list_(pa.float64()))],
                names=[*RUN, "epoch", "train_loss", "weights", "bias"],
            )
            losses.clear()
            return out

        for rows in batches:
            keys = list(zip(*(rows.column(i).to_pylist() for i in range(2)), strict=True))
            number = rows.column(2).to_numpy() // batch
            y, x = rows.column(3).to_numpy(), _flat(rows, "vector", size)
            new = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or number[i] != number[i - 1]]
            for a, b in zip(new, [*new[1:], len(keys)], strict=True):
                if (keys[a], number[a]) != (run, update):
                    if held:
                        step()
                        if keys[a] != run or number[a] // updates_per_epoch != update // updates_per_epoch:
                            yield epoch_done(int(update // updates_per_epoch))
                    if keys[a] != run:
                        state = AdamW(*start_weights(int(keys[a][0]), classes, size), learning_rate, weight_decay)
                    run, update = keys[a], number[a]
                held.append((x[a:b], y[a:b]))
        if held:
            step()
            yield epoch_done(int(update // updates_per_epoch))

    ordered = rows.repartition(runs, *RUN).sortWithinPartitions(*RUN, "slot", "cls", "vector")
    return written(ordered.mapInArrow(task, f"{kinds}, epoch int, train_loss double, weights array<array<double>>, bias array<double>"), "heads")


def _head_parts(heads: DataFrame, names: list[str]):
    """(rows with the named columns, weights, biases) in parts of at most HEAD_BYTES."""
    first = heads.select(F.size("weights").alias("k"), F.size(F.col("weights")[0]).alias("d")).first()
    if first is None:
        return
    per = max(1, HEAD_BYTES // (8 * first.k * (first.d + 1)))
    keys = heads.select(*names).orderBy(*names)
    many = keys.count()
    parts = -(-many // per)
    for p in range(parts):
        own = heads.where(F.pmod(F.xxhash64(*names), F.lit(parts)) == p).orderBy(*names).collect() if parts > 1 else heads.orderBy(*names).collect()
        if own:
            yield [tuple(r[n] for n in names) for r in own], np.array([r.weights for r in own]), np.array([r.bias for r in own])


def _scores(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logits: rows x heads x classes."""
    return (x @ w.reshape(-1, w.shape[2]).T).reshape(len(x), *b.shape) + b


def head_history(heads: DataFrame, validation: DataFrame, label: str = "label", vector: str = "vector") -> DataFrame:
    """seed, arm, epoch, train_loss, val_macro_f1, val_balanced_accuracy of every head; null metrics without validation rows.

    A task counts (true, predicted) pairs of its rows for all heads; vectors leave no task.
    """
    ship_code(heads.sparkSession)
    by = [*RUN, "epoch"]
    kinds = ", ".join(f"{c} {heads.schema[c].dataType.simpleString()}" for c in by)
    counts = heads.sparkSession.createDataFrame([], f"{kinds}, true long, pred long, n long")
    types = [heads.select(c).limit(0).toArrow().schema.field(0).type for c in by]
    for keys, w, b in _head_parts(heads, by):
        counts = counts.unionByName(_counted(validation, label, vector, keys, w, b, by, types, kinds))
    found = M.run_metrics(M.class_metrics(counts.groupBy(*by, "true", "pred").agg(F.sum("n").alias("n")), by), by)
    return heads.select(*by, "train_loss").join(found.select(*by, F.col("macro_f1").alias("val_macro_f1"), F.col("balanced_accuracy").alias("val_balanced_accuracy")), by, "left")


def _counted(rows: DataFrame, label: str, vector: str, keys: list, w: np.ndarray, b: np.ndarray, by: list[str], types: list, kinds: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast((keys, w, b))
    heads, classes, size = w.shape

    def task(batches):
        keys, w, b = sent.value
        n = np.zeros(heads * classes * classes, np.int64)
        step = max(1, SLICE_NUMBERS // (heads * classes))
        for batch in batches:
            x, y = _flat(batch, "_v", size), batch.column(0).to_numpy()
            for i in range(0, len(y), step):
                pred = _scores(x[i : i + step], w, b).argmax(axis=2)
                n += np.bincount(((np.arange(heads) * classes + y[i : i + step, None]) * classes + pred).reshape(-1), minlength=len(n))
        at = np.flatnonzero(n)
        own = [keys[i] for i in (at // classes**2).tolist()]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in own], t) for i, t in enumerate(types)), pa.array(at // classes % classes), pa.array(at % classes), pa.array(n[at])], names=[*by, "true", "pred", "n"]
        )

    usable = rows.where(valid_vector(F.col(vector), size) & F.col(label).between(0, classes - 1))
    return usable.select(F.col(label).cast("long").alias("_y"), F.col(vector).cast("array<double>").alias("_v")).mapInArrow(task, f"{kinds}, true long, pred long, n long")


def chosen_heads(heads: DataFrame, history: DataFrame) -> DataFrame:
    """The heads of each run's epoch with the highest validation macro-F1; the earlier epoch on ties."""
    return heads.join(select_epoch(history, RUN, "val_macro_f1"), [*RUN, "epoch"]).select(*heads.columns, "val_macro_f1")


def predict(heads: DataFrame, rows: DataFrame, keep: list[str], vector: str = "vector") -> DataFrame:
    """arm, seed, the kept columns, pred and scores (softmax) of every row with a valid vector for each of the heads (one a run)."""
    spark = rows.sparkSession
    ship_code(spark)
    kept = rows.select(*keep)
    run_kinds = ", ".join(f"{c} {heads.schema[c].dataType.simpleString()}" for c in RUN)
    types = [heads.select(c).limit(0).toArrow().schema.field(0).type for c in RUN]
    schema = f"{run_kinds}, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", pred long, scores array<double>"
    out = spark.createDataFrame([], schema)
    for keys, w, b in _head_parts(heads, RUN):
        sent = spark.sparkContext.broadcast((w, b))
        out = out.unionByName(_predicted(rows, keep, vector, sent, keys, w.shape, types, schema))
    return out


def _predicted(rows: DataFrame, keep: list[str], vector: str, sent, keys: list, shape: tuple, types: list, schema: str) -> DataFrame:
    heads, classes, size = shape
    names = [*RUN, *keep, "pred", "scores"]

    def task(batches):
        w, b = sent.value
        step = max(1, SLICE_NUMBERS // (heads * classes))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                s = _scores(_flat(batch, "_v", size), w, b)
                e = np.exp(s - s.max(axis=2, keepdims=True))
                e /= e.sum(axis=2, keepdims=True)
                for h in range(heads):
                    n = batch.num_rows
                    flat = pa.array(e[:, h].reshape(-1))
                    yield pa.RecordBatch.from_arrays([
                        *(pa.array([v] * n, t) for v, t in zip(keys[h], types, strict=True)), *(batch.column(j) for j in range(len(keep))),
                        pa.array(s[:, h].argmax(axis=1)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * classes, pa.int32()), flat),
                    ], names=names)

    usable = rows.where(valid_vector(F.col(vector), size))
    return usable.select(*keep, F.col(vector).cast("array<double>").alias("_v")).mapInArrow(task, schema)
