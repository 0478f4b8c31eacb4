"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's features are its code-point n-grams (A-Z lower-cased), hashed to `2**bits` columns, with
x_c = SCALE * (share of the text's n-grams in column c) * idf_c.  The weights are learned by
follow-the-regularised-leader (proximal, per coordinate) with an elastic net, so most are exactly 0;
a temperature fitted on rows set aside then calibrates the probabilities.

Training reads at most `max_rows` rows (the smallest hashes of the id) and `max_bytes` of their texts in one task.  Because x is
linear in the n-gram counts, scoring adds one weight row per n-gram and never builds a feature vector.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm import textnp as tn
from shardloom.llm.toxicity import bounded, held_out

SCALE = 30.0
ORDERS = (1, 2, 3)
UNDETERMINED = "und"


@dataclass
class LangModel:
    """weights: (columns, classes), idf and scale included; temperature: divisor of the logits."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int
    orders: tuple[int, ...]


#: Bytes of a text that are turned into n-grams at once.
PART = 1 << 20


def gram_parts(column: pa.Array):
    """(first row, bytes, offsets, code points after each row that only complete its n-grams): rows together up to PART bytes, longer texts in parts."""
    buf, off = tn.text_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + PART, side="right")) - 1)
        if off[j] - off[i] <= PART or j > i + 1:
            yield i, buf[off[i] : off[j]], off[i : j + 1] - off[i], 0
        else:
            a, end = int(off[i]), int(off[j])
            while a < end:
                # A part ends before a code point; what follows it completes its last n-grams.
                starts = a + PART + np.flatnonzero((buf[a + PART : min(end, a + PART + 64)] & 0xC0) != 0x80)
                b = int(starts[0]) if len(starts) else end
                after = starts[1 : max(ORDERS)]
                stop = int(after[-1]) if len(after) == max(ORDERS) - 1 else end
                own = buf[a:stop]
                yield i, own, np.array([0, len(own)]), int(((buf[b:stop] & 0xC0) != 0x80).sum())
                a = b
        i = j


def gram_columns(buf: np.ndarray, off: np.ndarray, bits: int, orders: tuple[int, ...], beyond: int = 0):
    """For each n-gram order the column numbers in row order, and the rows' cuts into them; no n-gram starts in the last `beyond` code points."""
    buf = tn.lower(buf)
    prefix = tn.prefix_hash(buf)
    start = np.flatnonzero((buf & 0xC0) != 0x80)
    edge = np.append(start, len(buf))
    first = np.searchsorted(start, off)
    count = np.diff(first)
    for n in orders:
        have = np.maximum(np.minimum(count - n + 1, count - beyond), 0)
        cut = np.concatenate(([0], np.cumsum(have)))
        if cut[-1]:
            last = len(start) - n + 1
            h = tn.span_hash(prefix, start[:last], edge[n : n + last])
            inside = np.ones(last, bool)
            for a, b in ((first[1:] - k, first[1:]) for k in range(1, max(n, beyond + 1))):
                bad = a[(a >= 0) & (a < b) & (a < last)]
                inside[bad] = False
            yield (h[inside] >> tn.U64(64 - bits)).astype(np.int64), cut
        else:
            yield np.zeros(0, np.int64), cut


def _features(texts: pa.Array, bits: int, orders: tuple[int, ...]):
    """Row, column and share of each feature of each row."""
    table = pa.table({"t": texts}).combine_chunks()
    rows, cols, share, at = [], [], [], 0
    for part in tn.slices(table.to_batches(), "t"):
        keys, counts = [], []
        total = np.zeros(part.num_rows)
        for i, buf, off, beyond in gram_parts(part.column(0)):
            code = []
            for c, cut in gram_columns(buf, off, bits, orders, beyond):
                code.append((np.repeat(np.arange(i, i + len(off) - 1), np.diff(cut)) << bits) + c)
                total[i : i + len(off) - 1] += np.diff(cut)
            u, n = np.unique(np.concatenate(code), return_counts=True)
            keys.append(u)
            counts.append(n)
        u, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate(counts), minlength=len(u))
        r = u >> bits
        rows.append(r + at)
        cols.append(u & ((1 << bits) - 1))
        share.append(n / total[r])
        at += part.num_rows
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(share)


def fit_rows(texts: pa.Array, langs: list[str], *, bits: int = 16, orders: tuple[int, ...] = ORDERS, epochs: int = 4,
             alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, batch_rows: int = 32, seed: int = 11) -> LangModel:
    """FTRL over mini-batches of four fifths of the rows; the temperature comes from the last fifth."""
    classes = sorted(set(langs))
    k, n = len(classes), len(langs)
    width = 1 << bits
    if k < 2:
        return LangModel(classes, np.zeros((width, k), np.float32), np.zeros(k), 1.0, bits, orders)
    y = np.array([classes.index(x) for x in langs])
    row, col, share = _features(texts, bits, orders)
    first = np.searchsorted(row, np.arange(n + 1))
    idf = np.log((1 + n) / (1 + np.bincount(col, minlength=width))) + 1
    x = SCALE * share * idf[col]
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    cut = max(1, n - n // 5)
    z, g2 = np.zeros((width, k)), np.zeros((width, k))
    bias, bias2 = np.zeros(k), np.full(k, 1e-3)

    def weights(c):
        zc = z[c]
        w = -(zc - np.sign(zc) * l1) / ((beta + np.sqrt(g2[c])) / alpha + l2)
        return np.where(np.abs(zc) <= l1, 0.0, w)

    def gathered(pick):
        size = first[pick + 1] - first[pick]
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(first[pick], size)
        return at, ends, np.repeat(np.arange(len(pick)), size)

    for _ in range(epochs):
        for b in range(0, cut, batch_rows):
            pick = order[b : min(b + batch_rows, cut)]
            at, ends, r = gathered(pick)
            used, back = np.unique(col[at], return_inverse=True)
            w = weights(used)
            logits = tn.reduce_rows(w[back] * x[at, None], ends) + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            g = np.stack([np.bincount(back, weights=p[r, j] * x[at], minlength=len(used)) for j in range(k)], 1) / len(pick)
            sigma = (np.sqrt(g2[used] + g**2) - np.sqrt(g2[used])) / alpha
            z[used] += g - sigma * w
            g2[used] += g**2
            gb = p.mean(axis=0)
            bias2 += gb**2
            bias -= 0.1 * gb / np.sqrt(bias2)
    w = weights(np.arange(width))
    temperature = 1.0
    if cut < n:
        pick = order[cut:]
        at, ends, _ = gathered(pick)
        logits = tn.reduce_rows(w[col[at]] * x[at, None], ends) + bias

        def loss(t):
            s = logits / t
            s -= s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(pick)), y[pick]]).mean())

        temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    return LangModel(classes, (SCALE * idf[:, None] * w).astype(np.float32), bias, float(temperature), bits, orders)


def train(docs: DataFrame, *, max_rows: int = 3000, max_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit) -> LangModel:
    """Fit on at most `max_rows` rows with a language; empty and null texts and null languages are skipped.

    A repeated id gives one row (the smallest text and language).  Rows are taken in order of the id's hash until their texts reach `max_bytes`.
    """
    tn.ship_code(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    picked = (
        known.where("l is not null and k is not null").groupBy("k").agg(F.min("l").alias("l")).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    )
    sample = (
        known.where("length(t) > 0").join(F.broadcast(picked), ["k", "l"]).groupBy("k", "l").agg(F.min("t").alias("t"))  # at most max_rows ids
        .repartition(1).sortWithinPartitions(F.xxhash64("k"), "k").select("t", "l")
    )

    def fit_task(batches):
        parts = bounded(batches, "t", max_bytes)
        if parts:
            table = pa.Table.from_batches(parts)
            model = fit_rows(table.column("t").combine_chunks(), table.column("l").to_pylist(), **fit)
            yield pa.RecordBatch.from_pydict({"model": tn.binary([pickle.dumps(model)])})

    found = sample.mapInArrow(fit_task, "model binary").collect()
    return pickle.loads(bytes(found[0].model)) if found else fit_rows(pa.array([], pa.string()), [], **fit)


def identify(docs: DataFrame, model: LangModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (calibrated probability of lang_pred).

    A text that is null or has no letter, or any text when no language was learned, gets `und` and score 0.
    Repeated rows are answered each, a null id like any other; other columns are dropped.
    """
    tn.ship_code(docs.sparkSession)
    source = docs.select(
        F.col(id_col), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"), F.col(text_col).alias("_text")
    )
    out = source.select(id_col, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"))

    def identify_task(batches):
        names = np.array([*model.classes, UNDETERMINED], object)
        for part in tn.slices(batches, "_text", tn.SLICE_BYTES // 2):
            n = part.num_rows
            logits = np.zeros((n, len(model.classes)))
            total = np.zeros(n)
            for i, buf, off, beyond in gram_parts(part.column(2)):
                own = slice(i, i + len(off) - 1)
                for cols, cut in gram_columns(buf, off, model.bits, model.orders, beyond):
                    logits[own] += tn.reduce_rows(model.weights[cols], cut)
                    total[own] += np.diff(cut)
            best, p = np.full(n, len(model.classes)), np.zeros(n)
            if model.classes:
                s = (logits / np.maximum(total, 1)[:, None] + model.bias) / model.temperature
                e = np.exp(s - s.max(axis=1, keepdims=True))
                e /= e.sum(axis=1, keepdims=True)
                letters = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                best = np.where(letters, e.argmax(axis=1), best)
                p = np.where(letters, e.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(p)], names=[id_col, "lang_pred", "score"])

    return source.mapInArrow(identify_task, out.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
