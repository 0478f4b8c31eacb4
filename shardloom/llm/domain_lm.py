"""Language-model scoring by cross-entropy difference.

Two word bigram models, one of a target corpus and one of a background (all other texts), hold exact counts of every word
and every bigram, known by a 64-bit hash.  They share one vocabulary, and the larger corpus's counts are scaled to the total of
the smaller one, so both are smoothed alike.  With the loss of a token
    loss = -log((1 - mix) c(previous, word) / c(previous) + mix (c(word) + 1) / (N + words in use)),
a text's score is the mean over its tokens of the target's loss less the background's: the lower, the more
the text is like the target.  A text's own occurrences are taken out of the counts that it is scored with, so
neither model has seen it.

Counts are taken over every token of every text and grow with the corpus.  Texts are packed into blocks of about BLOCK_BYTES, written once, so
both passes meet the same blocks whatever cuts the input; a block sends each range of keys its own counts, once for each distinct key.  A range adds
them up and answers every block with the sums of the keys it sent, in the same order.  How many blocks and ranges there are follows from the input,
so a range's rows have one size; a frequent word or pair is one number for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm import textnp as tn
from shardloom.llm.blocks import packed, rows_of
from shardloom.llm.graph import bit_filter, is_set, written

MIX = 0.4
#: Text bytes of a block, and of the input for each range of keys.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 4 << 20


def _keys(column: pa.Array):
    """The words, and of each token the key of its word (even), and that of it and the token before (odd; 0 at the start of a row)."""
    words, h = tn.word_hashes(column)
    pair = np.zeros(len(h), np.uint64)
    if len(h) > 1:
        pair[1:] = tn.mix(h[:-1] * tn.U64(0x9E3779B97F4A7C15) + h[1:])
    pair |= tn.U64(1)
    pair[words.first[:-1][words.count > 0]] = 0
    return words, h & ~tn.U64(1), pair


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted keys begins, and the end."""
    return np.searchsorted(((keys >> tn.U64(32)) * tn.U64(buckets) >> tn.U64(32)).astype(np.int64), np.arange(buckets + 1))


def _pack(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: the upper planes are mostly zeros, which Spark's compression takes out."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _unpack(x: pa.Scalar, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(x.as_py(), np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=tn.U64(0)))


def _unpack_keys(x: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpack(x, np.uint64), dtype=np.uint64)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys and the sums of the rows of values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
    return keys[first], np.add.reduceat(values[order], first, axis=0) if len(first) else values


def _ranges(source: DataFrame) -> int:
    return max(1, -(-(source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // RANGE_BYTES))


def _flagged(source: DataFrame, target: DataFrame, id_type: str, filter_bits: int) -> DataFrame:
    """The rows with a column is_target.  Most others are told by a bit filter of the target's ids where they are; the rest are joined with them."""
    ids = target.select(F.col(target.columns[0]).cast(id_type).alias("id")).where("id is not null").distinct()
    sent = source.sparkSession.sparkContext.broadcast(bit_filter(ids.select(F.xxhash64("id").alias("h")), "h", filter_bits))
    hashed = source.withColumn("_h", F.xxhash64("id"))
    schema = f"id {id_type}, _text string"

    def rows_that(hit):
        def task(batches):
            for batch in batches:
                own = is_set(sent.value, batch.column(2).to_numpy().view(np.uint64)) == hit
                yield batch.select(["id", "_text"]).filter(pa.array(own))

        return hashed.mapInArrow(task, schema)

    near = rows_that(True).join(ids.withColumn("is_target", F.lit(True)).hint("shuffle_hash"), "id", "left").select("id", "_text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    return near.unionByName(rows_that(False).withColumn("is_target", F.lit(False)))


def score(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = 24) -> DataFrame:
    """Rows id, n_tokens, target_loss, background_loss, score (their difference), means over the tokens in nats.

    `target`: ids (first column) of the texts of the target corpus; all other rows are the background.  Null and empty texts have no
    tokens and three nulls.  Rows with a null id belong to the background; rows that repeat an id are texts of their own.
    Other columns are dropped.
    """
    spark = docs.sparkSession
    tn.ship_code(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    ranges = _ranges(plain)
    blocks = packed(_flagged(plain, target, id_type, filter_bits), "_text", lambda rows: rows.num_rows, BLOCK_BYTES)

    def count_task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from counts_of(batch.column(0)[i].as_py(), rows_of(batch.column(1)[i]))

    def counts_of(block, rows):
        found = []
        for part in tn.slices([rows], "_text"):
            words, word, pair = _keys(part.column("_text"))
            own = np.repeat(part.column("is_target").to_numpy(zero_copy_only=False).astype(bool), words.count)
            u, at = np.unique(np.concatenate((word, pair[pair > 0])), return_inverse=True)
            own = np.concatenate((own, own[pair > 0]))
            found.append((u, np.stack((np.bincount(at[own], minlength=len(u)), np.bincount(at, minlength=len(u))), 1)))
        keys = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.uint64)
        keys, n = _sums(keys, np.concatenate([v for _, v in found]) if found else np.zeros((0, 2), np.int64))
        cut = _cuts(keys, ranges)
        for k in np.flatnonzero(np.diff(cut)).tolist():
            at = slice(cut[k], cut[k + 1])
            t, b = (np.ascontiguousarray(n[at, c]) for c in (0, 1))
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "range": pa.array([k], pa.int64()), "keys": tn.binary([_pack_keys(keys[at])]), "t": tn.binary([_pack(t)]), "b": tn.binary([_pack(b)])})

    def answer_task(table: pa.Table) -> pa.Table:
        keys = [_unpack_keys(x) for x in table.column("keys")]
        n = np.concatenate([np.stack([_unpack(table.column(c)[i], np.int64) for c in "tb"], 1) for i in range(table.num_rows)])
        known, n = _sums(np.concatenate(keys), n)
        t, b = np.ascontiguousarray(n[:, 0]), np.ascontiguousarray(n[:, 1] - n[:, 0])
        at = [np.searchsorted(known, k) for k in keys]
        word = known & tn.U64(1) == 0
        first = np.arange(table.num_rows) == 0
        totals = {name: pa.array(np.where(first, int(x), 0)) for name, x in (("n_t", t[word].sum()), ("n_b", b[word].sum()), ("used", word.sum()))}
        return pa.table({"block": table.column("block"), "range": table.column("range"), "t": tn.binary([_pack(t[a]) for a in at]), "b": tn.binary([_pack(b[a]) for a in at]), **totals})

    def score_task(own: pa.Table, answers: pa.Table) -> pa.Table:
        rows = rows_of(own.column("data")[0])
        parts = [(p, *_keys(p.column("_text"))) for p in tn.slices([rows], "_text")]
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.concatenate((word, pair[pair > 0])) for _, _, word, pair in parts)]))
        order = np.argsort(answers.column("range").to_numpy()).tolist()
        n = [np.concatenate([np.zeros(0, np.int64), *(_unpack(answers.column(c)[i], np.int64) for i in order)]) for c in "tb"]
        if len(n[0]) != len(keys):
            raise ValueError("answers do not belong to this block")
        out = []
        for part, words, word, pair in parts:
            m = words.count
            target = part.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
            row = words.rows()
            w, p = np.searchsorted(keys, word), np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = pair > 0
            before = np.zeros_like(w)
            before[1:] = w[:-1]
            own_w, own_p = _occurrences(row * len(keys) + w), np.zeros_like(w)
            own_p[known] = _occurrences((row * len(keys) + p)[known])
            own_before = np.zeros_like(own_w)
            own_before[1:] = own_w[:-1]
            loss = []
            for side, counted in ((0, target), (1, ~target)):
                mine = counted[row]
                tokens = total[side] - np.where(counted, m, 0)[row]
                p1 = ((n[side][w] - mine * own_w) * scale[side] + 1) / (tokens * scale[side] + used)
                c = np.where(known, n[side][before] - mine * own_before, 0)
                joint = np.where(known, n[side][p] - mine * own_p, 0)
                p1 = np.where(c > 0, (1 - MIX) * np.minimum(joint, c) / np.maximum(c, 1) + MIX * p1, p1)
                loss.append(tn.reduce_rows(-np.log(p1), words.first))
            none = m == 0
            t, b = (np.where(none, np.nan, x / np.maximum(m, 1)) for x in loss)
            columns = [pa.array(x, pa.float64(), mask=none) for x in (t, b, t - b)]
            out.append(pa.RecordBatch.from_arrays([part.column("id"), pa.array(m, pa.int64()), *columns], names=["id", "n_tokens", "target_loss", "background_loss", "score"]))
        return pa.Table.from_batches(out)

    counted = blocks.select("block", "data").mapInArrow(count_task, "block long, range long, keys binary, t binary, b binary")
    answers = written(counted.groupBy("range").applyInArrow(answer_task, "block long, range long, t binary, b binary, n_t long, n_b long, used long"), "answers")
    sums = answers.agg(F.sum("n_t"), F.sum("n_b"), F.sum("used")).first()
    total, used = np.array([sums[0] or 0, sums[1] or 0], np.float64), float(sums[2] or 0)
    scale = np.where(total > 0, total[total > 0].min(initial=np.inf) / np.maximum(total, 1), 1.0)
    schema = f"id {id_type}, n_tokens long, target_loss double, background_loss double, score double"
    scored = blocks.select("block", "data").groupBy("block").cogroup(answers.select("block", "range", "t", "b").groupBy("block")).applyInArrow(score_task, schema)
    return scored.withColumnRenamed("id", id_col)


def _occurrences(code: np.ndarray) -> np.ndarray:
    """For each entry, how often its value occurs."""
    _, back, n = np.unique(code, return_inverse=True, return_counts=True)
    return n[back]


def query(spark, sf_dir: str) -> DataFrame:
    """Target: documents with a label quality = 1; background: all others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id"))
