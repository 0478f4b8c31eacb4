"""Connected components of a link table, by joins, and a bit filter of fixed size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.operators.graph import written

__all__ = ["bit_filter", "bits_for", "components", "is_set", "written"]


def bit_filter(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """2**bits bits as 64-bit words; the low bits of every key are set.  Its size does not depend on the keys."""
    rows = (
        keys.selectExpr(f"{column} & {(1 << bits) - 1}L AS s").selectExpr("s >> 6 AS w", "shiftleft(1L, cast(s & 63 AS int)) AS v")
        .groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    )
    out = np.zeros(1 << max(bits - 6, 0), np.int64)
    out[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return out


def bits_for(keys: int, least: int = 24, most: int = 28) -> int:
    """Bits of a filter with about 8 bits for each key: 2 MB at least, 32 MB at most, whatever the number of keys."""
    return min(most, max(least, (8 * keys).bit_length()))


def is_set(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    s = (keys & np.uint64(len(words) * 64 - 1)).astype(np.int64)
    return (words.view(np.uint64)[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """Rows id, component (the smallest id reachable) for every id of a link; no row for others.

    Alternates two steps until nothing changes: every id's larger neighbours, then its smaller ones, are
    tied to its smallest neighbour.  Smallest neighbours come from a partial aggregation and a join, so an id
    with very many links does not have to fit one task.
    """

    def smallest(edges):
        return edges.groupBy("u").agg(F.min("v").alias("m"))

    links = links.where(F.col(a) != F.col(b))
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    known = state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = smallest(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = smallest(large)
        tied = large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(tied.unionByName(m.select("u", F.col("m").alias("v"))).distinct(), "links")
        edges, before, known = after, known, state(after)
        if known == before:
            break
    else:
        raise RuntimeError("components did not settle")
    pairs = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("id"), "component")).distinct()
