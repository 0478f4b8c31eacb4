"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

With X the centred rows (n x d), the iteration builds orthonormal v_1 .. v_d and u_1 .. u_d with X V = U B, B upper bidiagonal:

    alpha_j u_j = X v_j - beta_(j-1) u_(j-1),        beta_j v_(j+1) = X'u_j - alpha_j v_j.

Every step is one distributed pass over packed blocks of rows, which takes w = X v_j and X'w at once; a block returns d
numbers.  Left vectors are as long as the table and are never stored: each is u_i = X t_i for a short t_i that the driver keeps, together with
X'u_i, so an inner product of a long vector with u_i is one of short ones, u_i'w = t_i'(X'w).  Both sides are fully reorthogonalised,
twice, in these terms, and once more from the rows where little is left.  The singular value decomposition of the small B = P S Q' yields the components, the columns
of V Q, and the deviations S / sqrt(n).  A step that breaks down (the start vector met all there is in its space)
goes on with a new direction, so repeated deviations are found as often as they occur.

Entries become whole numbers before anything is summed, so sums and distances from the mean are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm import textnp as tn
from shardloom.llm.graph import written

COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Numbers of a block.
BLOCK_NUMBERS = 1 << 19
#: Entries beyond this size count as this size, so that whole numbers stay exact.
LARGEST = float(1 << 50)
_MOST = np.iinfo(np.int64).max


def _whole(batch: pa.RecordBatch):
    """(dimension, row numbers, whole numbers as a matrix) of the usable vectors of a batch, by dimension."""
    column = batch.column(1)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    end = np.cumsum(size)
    bad = tn.reduce_rows((~np.isfinite(x)).astype(np.int64), np.concatenate(([0], end)))
    for d in np.unique(size[(size > 0) & (bad == 0)]).tolist():
        rows = np.flatnonzero((size == d) & (bad == 0))
        step = max(1, BLOCK_NUMBERS // d)
        for k in range(0, len(rows), step):
            own = rows[k : k + step]
            v = x[(end[own] - d)[:, None] + np.arange(d)]
            yield d, own, (np.clip(np.floor(SCALE * v), -LARGEST, LARGEST) + SHIFT).astype(np.int64)


def blocks_of(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows dim, n, ids, x: the usable vectors as blocks of whole numbers (a written table).

    Vectors that are null, empty, or hold a null or non-finite entry take no part.
    """
    tn.ship_code(vectors.sparkSession)
    kind = vectors.schema[id_col].dataType.simpleString()

    def task(batches):
        held: dict[int, list] = {}

        def block(d):
            parts = held.pop(d)
            ids, x = pa.concat_arrays([i for i, _ in parts]), np.concatenate([x for _, x in parts])
            x = x.astype(np.int32) if np.abs(x).max() < 1 << 31 else x
            return pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "n": pa.array([len(x)], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids), "x": tn.binary([x.tobytes()])})

        for batch in batches:
            for d, own, x in _whole(batch):
                held.setdefault(d, []).append((batch.column(0).take(pa.array(own)), x))
                if sum(len(p) for _, p in held[d]) * d >= BLOCK_NUMBERS:
                    yield block(d)
        for d in list(held):
            yield block(d)

    return written(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(task, f"dim int, n long, ids array<{kind}>, x binary"), "blocks")


def _matrix(data: pa.Scalar, n: int, d: int) -> np.ndarray:
    data = data.as_buffer()
    return np.frombuffer(data, np.int32 if data.size == 4 * n * d else np.int64).reshape(n, d)


class Centred:
    """The blocks of one dimension with their exact sums, and products with the centred rows."""

    def __init__(self, blocks: DataFrame, d: int):
        self.d = d
        self.blocks = blocks.where(F.col("dim") == d)

        def task(batches):
            total, n = np.zeros(d, object), 0
            for batch in batches:
                for size, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                    # A block's sums stay below 2**19 * 2**50 / d only in Python's numbers; halves of the entries do in 64 bits.
                    m = _matrix(x, size, d).astype(np.int64)
                    total = total + (m >> 26).sum(axis=0).astype(object) * (1 << 26) + (m & ((1 << 26) - 1)).sum(axis=0)
                    n += size
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d + 1), pa.int32()), "s": pa.array([str(v) for v in [*total, n]])})

        rows = self.blocks.select("n", "x").mapInArrow(task, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        sums = {r.i: int(r.s) for r in rows}
        self.n = sums.get(d, 0)
        self.sums = [sums.get(i, 0) for i in range(d)]
        # The mean as a whole number and the rest, so that no digit of a small deviation is lost.
        self.base = np.array([s // max(self.n, 1) for s in self.sums], np.int64)
        self.rest = np.array([s % max(self.n, 1) / max(self.n, 1) for s in self.sums])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest

    def sum(self, size: int, of) -> np.ndarray:
        """The sum over all blocks of the `size` numbers that `of` makes of a block's centred rows."""
        own, d = self, self.d
        base, rest = self.base, self.rest

        def task(batches):
            total = np.zeros(size)
            for batch in batches:
                for n, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                    total += of((_matrix(x, n, d) - base) - rest)
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "s": pa.array(total)})

        out = np.zeros(size)
        for r in own.blocks.select("n", "x").mapInArrow(task, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
            out[r.i] = r.s
        return out

    def product(self, v: np.ndarray) -> np.ndarray:
        """X'(Xv)."""
        return self.sum(self.d, lambda x: (x @ v) @ x)


def _away(x: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """x without its parts along the orthonormal basis, taken out twice."""
    if basis:
        q = np.array(basis)
        for _ in range(2):
            x = x - q.T @ (q @ x)
    return x


def bidiagonalise(rows: Centred, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): orthonormal columns v_1 .. v_d and the upper bidiagonal B with X V = U B for some orthonormal columns U."""
    d = rows.d
    random = np.random.default_rng(seed)
    right: list[np.ndarray] = []  # v_i
    left: list[np.ndarray] = []  # t_i with u_i = X t_i
    seen: list[np.ndarray] = []  # X'u_i
    bidiagonal = np.zeros((d, d))
    largest, fresh = 0.0, None
    for j in range(d):
        while fresh is None:
            x = _away(random.standard_normal(d), right)
            x = _away(x / np.linalg.norm(x), right)
            fresh = x / np.linalg.norm(x) if np.linalg.norm(x) > 0.1 else None
        v, fresh = fresh, None
        right.append(v)
        # w = X v_j is t = v_j in short terms, with X'w from the pass; u_1 .. u_(j-1) are taken out of it, twice.  Where little of w is left, another
        # pass takes the rest from the rows themselves, so that it does not drown in the rounding of what went.
        t, back = v, rows.product(v)
        before = float(np.sqrt(max(t @ back, 0.0)))
        own, backs = np.array(left).reshape(-1, d), np.array(seen).reshape(-1, d)
        for again in (True, True, False):
            for _ in range(2):
                c = own @ back
                t, back = t - own.T @ c, back - backs.T @ c
            alpha = float(np.sqrt(max(t @ back, 0.0)))
            if not again or alpha >= 1e-3 * before:
                break
            back = rows.product(t)
            before = float(np.sqrt(max(t @ back, 0.0)))
        largest = max(largest, alpha)
        if alpha <= 1e-12 * largest or alpha == 0:
            continue  # X v_j lies in the space of the left vectors; the next v is a new direction
        bidiagonal[j, j] = alpha
        left.append(t / alpha)
        seen.append(back / alpha)
        onward = _away(seen[-1] - alpha * v, right)
        beta = float(np.linalg.norm(onward))
        if beta > 1e-12 * largest and j + 1 < d:
            bidiagonal[j, j + 1] = beta
            fresh = _away(onward / beta, right)
            fresh = fresh / np.linalg.norm(fresh)
    return np.array(right).T, bidiagonal


def components(rows: Centred, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(components as columns, their deviations, the trace of the covariance): at most k, those of no deviation left out."""
    v, b = bidiagonalise(rows)
    _, s, q = np.linalg.svd(b)
    found = s > s[0] * 1e-9 if len(s) and s[0] > 0 else np.zeros(len(s), bool)
    keep = np.flatnonzero(found)[:k]
    trace = float((rows.sum(rows.d, lambda x: (x * x).sum(axis=0)) / rows.n).sum())
    return v @ q.T[:, keep], s[keep] / np.sqrt(rows.n), trace


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Rows id, component, n, deviation, whitened, explained, identity_error for every usable vector and each of up to k components.

    An entry c becomes x = floor(1024 c) + 100000 (|1024 c| beyond 2**50 counts as 2**50).  n: usable vectors; deviation: the exact sum over dimensions of
    (n x - S)**2, null where it leaves 64 bits; whitened: the centred x along the component over the component's deviation; explained:
    its share of the trace; identity_error: the largest entry of the covariance of `whitened` less the identity.  Vectors that are null, empty or hold
    a null or non-finite entry take no part.  Vectors of different lengths are fitted apart (lengths are few).  Components of no
    deviation (below 1e-9 of the largest) give no rows, so a single vector or equal vectors give none.  Ids may be null or repeated: every row
    counts.  Other columns are dropped.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    blocks = blocks_of(vectors, id_col=id_col, vector_col=vector_col)
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    parts = [_whitened(Centred(blocks, r.dim), k, id_col, schema) for r in blocks.select("dim").distinct().orderBy("dim").collect()]
    out = vectors.sparkSession.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out if len(parts) != 1 else parts[0]


def _whitened(rows: Centred, k: int, id_col: str, schema: str) -> DataFrame:
    axes, deviation, trace = components(rows, k)
    m, n, d, sums = len(deviation), rows.n, rows.d, rows.sums
    turn = axes / deviation
    explained = deviation**2 / trace if trace > 0 else deviation

    def moments(x):
        w = x @ turn
        return np.concatenate((w.sum(axis=0), (w.T @ w).reshape(-1)))

    sums_of = rows.sum(m + m * m, moments) / n if m else np.zeros(0)
    mean, square = sums_of[:m], sums_of[m:].reshape(m, m)
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(m)).max()) if m else 0.0
    base, rest = rows.base, rows.rest
    exact_sums = np.array(sums, object)

    def task(batches):
        for batch in batches:
            for size, ids, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                x = _matrix(data, size, d)
                near = np.abs(x - base).max(initial=0) + 1
                if n * float(near) < 2**31 / np.sqrt(d):
                    away = n * (x - base) - np.array([s % n for s in sums], np.int64)
                    far = pa.array((away * away).sum(axis=1))
                else:
                    whole = [int((v * v).sum()) for v in n * x.astype(object) - exact_sums]
                    far = pa.array([v if v <= _MOST else None for v in whole], pa.int64())
                w = ((x - base) - rest) @ turn
                at = np.repeat(np.arange(size), m)
                yield pa.RecordBatch.from_arrays([
                    ids.values.take(pa.array(at)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), size)), pa.array(np.full(size * m, n)), far.take(pa.array(at)),
                    pa.array(w.reshape(-1)), pa.array(np.tile(explained, size)), pa.array(np.full(size * m, error)),
                ], names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.blocks.select("n", "ids", "x").mapInArrow(task, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
