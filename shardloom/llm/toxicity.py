"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where x_i says whether a text
holds the word with hash i.  The pairwise part learns combinations (an insult beside a group name)
that additive weights miss.  The sum over pairs costs O(terms * rank) by the usual identity
    sum_{i<j} <v_i, v_j> = 1/2 * sum_f ((sum_i v_if)^2 - sum_i v_if^2).

Training reads at most `max_rows` labelled rows (those with the smallest hash of the id) and `max_bytes` of their texts, in one
task; terms in fewer than `min_df` of them are left out.  Scoring is a map over whole texts.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm import textnp as tn

_SLOTS = 22


@dataclass
class FactorModel:
    """keys: term hashes; w, v: linear and pairwise weights in their order; w0: bias."""

    keys: np.ndarray
    w: np.ndarray
    v: np.ndarray
    w0: float

    def raw(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid; row i holds the distinct terms[first[i]:first[i+1]]."""
        v = self.v[terms]
        s = tn.reduce_rows(v, first)
        pairs = 0.5 * (s**2 - tn.reduce_rows(v**2, first)).sum(axis=1)
        return self.w0 + tn.reduce_rows(self.w[terms], first) + pairs


def distinct_terms(rows: np.ndarray, terms: np.ndarray, n_rows: int, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    code = np.unique(rows.astype(np.int64) * n_terms + terms)
    return code % n_terms, np.searchsorted(code, np.arange(n_rows + 1, dtype=np.int64) * n_terms)


def fit_rows(texts: pa.Array, labels: np.ndarray, *, rank: int = 4, epochs: int = 15, rate: float = 0.1,
             l1: float = 5e-3, l1_pairs: float = 1e-3, unit_rows: int = 3200, min_df: int = 4, batch_rows: int = 128, seed: int = 7) -> FactorModel:
    """Mini-batch AdaGrad on the logistic loss, classes weighted equally, then a proximal step: l1 on each
    linear weight, so terms without evidence end at exactly 0, and l1_pairs on the norm of each pairwise vector.
    `epochs` passes fit the linear weights alone, as many more both parts: the vectors learn what is left.  Their
    gradient is a sum of vectors, so once all are 0 none comes back, and l1_pairs is small.
    Both penalties are those of `unit_rows` rows and shrink with the root of the rows, as the noise of the gradients does.
    No rows: a model that scores 0."""
    table = pa.table({"t": texts}).combine_chunks()
    rows, hashes, at = [], [], 0
    for part in tn.slices(table.to_batches(), "t"):
        words, h = tn.word_hashes(part.column(0))
        rows.append(words.rows() + at)
        hashes.append(h)
        at += part.num_rows
    n = at
    y = np.asarray(labels, np.float64)
    if not n or not len(np.concatenate(hashes)) or y.min() == y.max():
        bias = -30.0 if not n or y.max() < 1 else 30.0
        return FactorModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, rank)), bias)
    all_keys, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    code = np.unique(np.concatenate(rows) * len(all_keys) + inverse)
    df = np.bincount(code % len(all_keys), minlength=len(all_keys))
    kept = np.flatnonzero(df >= min_df)
    new = np.full(len(all_keys), -1)
    new[kept] = np.arange(len(kept))
    row, term = code // len(all_keys), new[code % len(all_keys)]
    row, term = row[term >= 0], term[term >= 0]
    first = np.searchsorted(row, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    m = FactorModel(all_keys[kept], np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), rank)), 0.0)
    noise = (unit_rows / n) ** 0.5
    l1, l1_pairs = l1 * noise, l1_pairs * noise
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    gw, gv, g0 = np.full(len(kept), 1e-4), np.full((len(kept), rank), 1e-4), 1e-4
    for epoch in range(2 * epochs):
        order = rng.permutation(n)
        for b in range(0, n, batch_rows):
            pick = order[b : b + batch_rows]
            size = first[pick + 1] - first[pick]
            cut = np.concatenate(([0], np.cumsum(size)))
            at_rows = np.repeat(np.arange(len(pick)), size)
            t = term[np.arange(cut[-1]) - np.repeat(cut[:-1], size) + np.repeat(first[pick], size)]
            raw = m.raw(t, cut)
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            used, back = np.unique(t, return_inverse=True)
            dw = np.bincount(back, weights=g[at_rows], minlength=len(used))
            gw[used] += dw**2
            g0 += g.sum() ** 2
            step = rate / np.sqrt(gw[used])
            w = m.w[used] - step * dw
            m.w[used] = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            m.w0 -= rate * g.sum() / np.sqrt(g0)
            if epoch < epochs:
                continue
            s = tn.reduce_rows(m.v[t], cut)
            dv = np.stack([np.bincount(back, weights=g[at_rows] * (s[at_rows, f] - m.v[t, f]), minlength=len(used)) for f in range(rank)], 1)
            gv[used] += dv**2
            step = 0.3 * rate / np.sqrt(gv[used].mean(axis=1, keepdims=True))
            v = m.v[used] - step * dv
            m.v[used] = v * np.maximum(1 - step * l1_pairs / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), 0)
    return m


def bounded(batches, text: str, max_bytes: int) -> list:
    """The batches up to the row whose text goes beyond `max_bytes` in all."""
    parts, left = [], max_bytes
    for batch in batches:
        size = np.cumsum(np.diff(tn.text_bytes(batch.column(batch.schema.get_field_index(text)))[1]))
        n = int(np.searchsorted(size, left, side="right"))
        parts.append(batch.slice(0, n))
        if n < batch.num_rows:
            break
        left -= int(size[-1]) if n else 0
    return [p for p in parts if p.num_rows]


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8000, max_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", **fit) -> FactorModel:
    """Fit on at most `max_rows` rows of `labels` with a label 0 or 1.

    The ids come from a top-k over their hash, so the broadcast side and the training task are bounded
    by `max_rows`; a repeated id gives one row (the smallest text and label).  Rows are taken in order of the hash until their texts reach
    `max_bytes`.  Null labels and ids are skipped; null texts count as empty.
    """
    tn.ship_code(docs.sparkSession)
    picked = (
        labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
        .where("k is not null and y in (0, 1)")
        .groupBy("k").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("k"), "k", "y")
        .limit(max_rows)
    )
    sample = (
        docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
        .join(F.broadcast(picked), "k")  # at most max_rows ids
        .groupBy("k", "y").agg(F.min("t").alias("t"))
        .repartition(1)
        .sortWithinPartitions(F.xxhash64("k"), "k")
        .select("t", "y")
    )

    def fit_task(batches):
        parts = bounded(batches, "t", max_bytes)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        model = fit_rows(table.column("t").combine_chunks(), table.column("y").to_numpy(), **fit)
        yield pa.RecordBatch.from_pydict({"model": tn.binary([pickle.dumps(model)])})

    found = sample.mapInArrow(fit_task, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else fit_rows(pa.array([], pa.string()), np.zeros(0), **fit)


def score(docs: DataFrame, model: FactorModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the columns of `keep`, score in [0, 1].

    Null and empty texts have no terms and get the bias alone.  Other columns are dropped, so names
    such as `score` in the input don't clash.  Repeated ids give repeated rows.
    """
    tn.ship_code(docs.sparkSession)
    source = docs.select(F.col(id_col), *[F.col(c) for c in keep if c != id_col], F.col(text_col).alias("_text"))
    out = source.drop("_text").withColumn("score", F.lit(0.0))

    def score_task(batches):
        index = tn.KeyIndex(model.keys, _SLOTS)
        for part in tn.slices(batches, "_text"):
            words, h = tn.word_hashes(part.column(part.num_columns - 1))
            at = index.find(h)
            hit = at >= 0
            terms, first = distinct_terms(words.rows()[hit], at[hit], part.num_rows, max(len(model.keys), 1))
            p = 1 / (1 + np.exp(-np.clip(model.raw(terms, first), -30, 30)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(p)], names=[*part.schema.names[:-1], "score"])

    return source.mapInArrow(score_task, out.schema)


def drop_toxic(docs: DataFrame, model: FactorModel, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows and columns of `docs` whose text scores below `threshold`; null and empty texts score the bias alone.

    Repeated rows stay or go together, since a score depends on the text alone; ids are not read."""
    tn.ship_code(docs.sparkSession)
    at = docs.columns.index(text_col)

    def drop_task(batches):
        index = tn.KeyIndex(model.keys, _SLOTS)
        for part in tn.slices(batches, text_col):
            words, h = tn.word_hashes(part.column(at))
            where = index.find(h)
            hit = where >= 0
            raw = model.raw(*distinct_terms(words.rows()[hit], where[hit], part.num_rows, max(len(model.keys), 1)))
            yield part.filter(pa.array(raw < np.log(threshold / (1 - threshold))))

    return docs.mapInArrow(drop_task, docs.schema)


def held_out(id_col: str = "doc_id"):
    """The fold that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
