"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound.

For a node with centre c and radius r, no vector below it scores more than q.c + |q| r against query q.
A node whose bound is below the query's current kth score is skipped; of two children a query first
visits the one with the larger bound.  The kth scores start from an exact search over a bounded
sample of the candidates (a kth score over a part is a valid floor for the whole), which every
shard shares, and rise as a task goes from shard to shard, those with the largest bound first.

Vectors are dealt to shards by the nearest of a bounded sample of centres, so a shard is a small ball where the vectors have
clusters.  Queries come in blocks by the same centres, each with a ball of its own; a (block, shard) pair whose balls
show that no query can reach its floor is dropped before any vector moves.  Shards and blocks have a fixed size;
shard results meet per query, at most k rows from each.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shardloom.llm import textnp as tn
from shardloom.llm.graph import written

LEAF, TOGETHER = 64, 2048


class BallTree:
    """Median splits on the axis of largest spread; leaves hold at most LEAF vectors."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []
        self._build(x, 0, len(x))
        self.x = x[self.order]
        self.centres = np.array([n[0] for n in self.nodes])
        self.radii = np.array([n[1] for n in self.nodes])

    @classmethod
    def load(cls, x: np.ndarray, nodes: list[tuple]) -> BallTree:
        """A tree whose vectors are already in the order of its leaves."""
        tree = cls.__new__(cls)
        tree.order, tree.x, tree.nodes = np.arange(len(x)), x, nodes
        tree.centres, tree.radii = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        return tree

    def _build(self, x, lo, hi) -> int:
        own = x[self.order[lo:hi]]
        centre = own.mean(axis=0)
        # Rounding must not push a bound below a true score.
        radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-9
        at = len(self.nodes)
        self.nodes.append(None)
        left = right = -1
        spread = own.max(axis=0) - own.min(axis=0)
        if hi - lo > LEAF and spread.max() > 0:
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own[:, spread.argmax()], mid)]
            left = self._build(x, lo, lo + mid)
            right = self._build(x, lo + mid, hi)
        self.nodes[at] = (centre, radius, lo, hi, left, right)
        return at


class TopK:
    """The k best (score, id) of each query so far, ties to the smaller id; floor: kth scores known from elsewhere."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def bar(self, rows):
        return np.maximum(self.floor[rows], self.score[rows, -1])

    def add(self, rows, scores, ids):
        """scores: (rows, candidates); only those that reach a row's bar are merged."""
        keep = scores >= self.bar(rows)[:, None]
        need = np.flatnonzero(keep.any(axis=1))
        if not len(need):
            return
        rows, scores, keep = rows[need], scores[need], keep[need]
        if scores.shape[1] > self.k:
            part = np.partition(scores, -self.k, axis=1)[:, -self.k]
            keep &= scores >= part[:, None]
        width = int(keep.sum(axis=1).max())
        r, c = np.nonzero(keep)
        at = np.arange(len(r)) - np.searchsorted(r, np.arange(len(rows)))[r]
        s = np.full((len(rows), width), -np.inf)
        i = np.full((len(rows), width), np.iinfo(np.int64).max)
        s[r, at], i[r, at] = scores[r, c], ids[c]
        s, i = np.hstack((self.score[rows], s)), np.hstack((self.id[rows], i))
        best = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def search(tree: BallTree, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, top: TopK) -> int:
    """Branch and bound for a block of queries; returns how many (query, vector) scores were computed."""
    norms = np.sqrt((q**2).sum(axis=1)) * (1 + 1e-9)
    ids = ids[tree.order]
    done = 0

    def bound(node, rows):
        return (q[rows] @ tree.centres[node] + norms[rows] * tree.radii[node]) * (1 + 1e-12) + 1e-6

    stack = [(0, np.arange(len(q)), bound(0, np.arange(len(q))))]
    while stack:
        node, rows, ub = stack.pop()
        rows = rows[ub >= top.bar(rows)]
        if not len(rows):
            continue
        _, _, lo, hi, left, right = tree.nodes[node]
        if left < 0:
            for a in range(lo, hi, LEAF):
                b = min(a + LEAF, hi)
                scores = q[rows] @ tree.x[a:b].T
                scores[q_ids[rows][:, None] == ids[None, a:b]] = -np.inf
                top.add(rows, scores, ids[a:b])
                done += scores.size
            continue
        ul, ur = bound(left, rows), bound(right, rows)
        # Above TOGETHER vectors each query goes to its better child first; below, a group stays together and follows its sum.
        first = ul >= ur if hi - lo > TOGETHER else np.full(len(rows), ul.sum() >= ur.sum())
        # The stack is last in, first out: the preferred child of each group goes on last.
        for group, near, far, un, uf in ((first, left, right, ul, ur), (~first, right, left, ur, ul)):
            if group.any():
                stack.append((far, rows[group], uf[group]))
                stack.append((near, rows[group], un[group]))
    return done


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v = floor(64 x) per component; rows with a null or non-finite part, an empty vector or no id are left out."""
    x = F.col(vec_col).cast("array<double>")
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return (
        vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & whole)
        .select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * 64).cast("double")).alias("v"))
    )


def _packed(rows: DataFrame, key: str, schema: str, extra) -> DataFrame:
    """One row per value of `key` and vector length, a bounded number of vectors: dim, ids and components as bytes, and `extra` of (ids, vectors)."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        v, ids = _matrix(table.column("v").combine_chunks()), table.column("id").to_numpy().astype(np.int64)
        own = {key: pa.array([table.column(key)[0].as_py()], pa.int64()), "dim": pa.array([v.shape[1]], pa.int64())}
        return pa.table(own | extra(ids, v))

    # Vectors of another length score 0 against nothing: each length is a group of its own.
    return rows.groupBy(key, F.size("v").alias("_dim")).applyInArrow(pack, f"{key} long, dim long, {schema}")


def _ball(v: np.ndarray) -> tuple[np.ndarray, float]:
    centre = v.mean(axis=0)
    return centre, float(np.sqrt(((v - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-9


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding",
          block_rows: int = 2048, shard_rows: int = 16384, sample_rows: int = 2048) -> DataFrame:
    """Rows query_id, rank (from 1), vec_id, score: for each query the k candidates of highest integer inner product.

    Components are floor(64 x).  A query never meets a candidate with its own id; ties go to the
    smaller id; fewer candidates give fewer rows.  Vectors that are null, empty or hold a null or
    non-finite component take no part, nor do rows without an id; queries meet candidates of their own length only.  Every
    candidate row counts, repeated ones too; rows that repeat a query's id and vector are one query.  Sums are exact while they
    stay below 2**53; a component whose floor(64 x) leaves 64 bits counts as the nearest 64-bit number.  Ids are whole numbers.
    """
    spark = vectors.sparkSession
    tn.ship_code(spark)
    c = written(quantised(vectors, id_col, vec_col), "candidates")
    q = written(quantised(queries, id_col, vec_col).distinct(), "queries")
    n_c, n_q = c.count(), q.count()
    sample = c.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample_rows).collect()
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r.v) for r in sample}:
        own = [r for r in sample if len(r.v) == dim]
        seeds[dim] = (np.array([r.id for r in own], np.int64), np.array([r.v for r in own]))

    def dealt(rows: DataFrame, total: int, size: int, key: str) -> DataFrame:
        """`rows` with a shard number: the nearest of some sampled centres, and a part of those near it."""
        centres = max(1, min(sample_rows, -(-total // size)))

        def near_task(batches):
            for batch in batches:
                length = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                near = np.zeros(batch.num_rows, np.int64)
                for dim in np.unique(length).tolist():
                    if dim in seeds:
                        at = np.flatnonzero(length == dim)
                        s = seeds[dim][1][:centres]
                        near[at] = ((s**2).sum(axis=1) - 2 * _matrix(batch.column(1).take(pa.array(at))) @ s.T).argmin(axis=1)
                yield batch.append_column("near", pa.array(near))

        placed = rows.mapInArrow(near_task, "id long, v array<double>, near long")
        # At most sample_rows counts.
        parts = {r.near: -(-r["count"] // size) for r in placed.groupBy("near").count().collect()}
        wide = max([1, *parts.values()])
        many = F.create_map(*[F.lit(x) for pair in (parts or {0: 1}).items() for x in pair])
        return placed.withColumn(key, F.col("near") * wide + F.pmod(F.xxhash64("id", "v"), many[F.col("near")])).select("id", "v", key)

    def shard_columns(ids, v):
        tree = BallTree(v)
        state = pickle.dumps((ids[tree.order], tree.x.astype(np.int32) if np.abs(tree.x).max() < 2**31 else tree.x, tree.nodes))
        centre, radius = _ball(v)
        return {"tree": tn.binary([state]), "centre": tn.binary([centre.tobytes()]), "radius": pa.array([radius])}

    def block_columns(ids, v):
        floor = np.full(len(v), -np.inf)
        if v.shape[1] in seeds:
            own, x = seeds[v.shape[1]]
            top = TopK(len(v), k, floor)
            search(BallTree(x), own, v, ids, top)
            floor = top.score[:, -1]
        centre, radius = _ball(v)
        return {
            "q_ids": tn.binary([ids.tobytes()]), "q": tn.binary([v.tobytes()]), "floor": tn.binary([floor.tobytes()]), "q_centre": tn.binary([centre.tobytes()]), "q_radius": pa.array([radius]),
            "q_norm": pa.array([float(np.sqrt((v**2).sum(axis=1).max()))]), "lowest": pa.array([float(floor.min())]),
        }

    shard = written(_packed(dealt(c, n_c, shard_rows, "shard"), "shard", "tree binary, centre binary, radius double", shard_columns), "shards")
    block = written(_packed(dealt(q, n_q, block_rows, "block"), "block", "q_ids binary, q binary, floor binary, q_centre binary, q_radius double, q_norm double, lowest double", block_columns), "blocks")

    def bound_task(batches):
        for batch in batches:
            rows = batch.to_pylist()
            a = [np.frombuffer(r["q_centre"]) for r in rows]
            b = [np.frombuffer(r["centre"]) for r in rows]
            # The largest q.v over both balls, rounded up.
            top = [float(x @ y + r["q_radius"] * np.sqrt(y @ y) + r["q_norm"] * r["radius"]) * (1 + 1e-9) + 1e-3 for x, y, r in zip(a, b, rows, strict=True)]
            keep = [t >= r["lowest"] for t, r in zip(top, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in ("block", "shard", "dim")), pa.array(top)], names=["block", "shard", "dim", "top"]).filter(pa.array(keep))

    # Small rows, one for each pair of a block and a shard: the blocked search of a stated query set over all rows.
    # Blocks are dealt to groups, each with the balls of all shards, so the pairs of one dimension are many tasks.
    blocks = max(1, block.count())
    groups = min(blocks, 4096)
    dealt_blocks = block.select("block", "dim", "q_centre", "q_radius", "q_norm", "lowest").withColumn("_group", F.pmod("block", F.lit(groups)).cast("int"))
    met = shard.select("shard", "dim", "centre", "radius").withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    balls = met.join(dealt_blocks, ["dim", "_group"])
    pairs = written(balls.mapInArrow(bound_task, "block long, shard long, dim long, top double"), "pairs")
    spread = max(1, -(-spark.sparkContext.defaultParallelism * 2 // blocks))
    tasks = (
        pairs.join(shard.select("shard", "dim", "tree"), ["shard", "dim"]).join(block.select("block", "dim", "q_ids", "q", "floor"), ["block", "dim"])
        .repartition(max(1, min(blocks * spread, spark.sparkContext.defaultParallelism * 8)), "dim", "block", F.pmod(F.col("shard"), F.lit(spread))).sortWithinPartitions("dim", "block", F.desc("top"))
    )

    def emit(q_ids, q_keys, top):
        a, b = np.nonzero(np.isfinite(top.score))
        return pa.RecordBatch.from_pydict({"query_id": pa.array(q_ids[a]), "_key": pa.array(q_keys[a]), "vec_id": pa.array(top.id[a, b]), "score": pa.array(top.score[a, b].astype(np.int64))})

    def search_task(batches):
        # Rows come block by block: a block's kth scores pass from shard to shard, then its rows leave.
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                key = (r["dim"], r["block"])
                if held is None or held[0] != key:
                    if held is not None:
                        yield emit(*held[2:])
                    q_ids, qx = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q"]).reshape(-1, r["dim"])
                    held = (key, qx, q_ids, np.arange(len(q_ids)) + (r["block"] << 20), TopK(len(qx), k, np.frombuffer(r["floor"])))
                ids, x, nodes = pickle.loads(r["tree"])
                search(BallTree.load(x.astype(np.float64), nodes), ids, held[1], held[2], held[4])
        if held is not None:
            yield emit(*held[2:])

    found = tasks.mapInArrow(search_task, "query_id long, _key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
