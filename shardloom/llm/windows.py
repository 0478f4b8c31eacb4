"""Substring deduplication by windows of words, with a count-min prefilter.

A window is `length` consecutive words of one document.  A word goes if a window over it also starts in a document with a smaller id.

1. Texts are packed into blocks, written once.  Every block makes its own sketch: for each of LEVELS hash rows, which cells its windows
   fall into, and whether more than one does.  Sketches are merged by slabs of cells: a cell's count is that of all windows of all
   texts in it, so the smallest count of a window's cells is never below the window's own.  A slab answers every block with
   one bit for each cell that it sent: are there two or more?
2. Windows with a count of one in any row are unique and stay where they are.  The others, named by 96 bits, are grouped
   exactly: a block sends each distinct name once, with the smallest id that holds it there, and learns whether a smaller one is elsewhere.
3. Blocks mark the words of the windows that began earlier and join the rest.

Cells grow with the number of windows (LOAD to each), so the share of unique windows that pass the sketch is about 5 % at every
size.  What moves is a compressed text three times, two or three bytes for each window and row of the sketch, and some 13 bytes for each
repeated window of a block.  A window held by very many texts is one entry for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm import textnp as tn
from shardloom.llm.blocks import BLOCK_BYTES, packed, rows_of
from shardloom.llm.graph import written

LENGTH = 13
#: Hash rows of the sketch, cells for each window and row, cells of a slab (as bits), windows for each range of names.
LEVELS, LOAD, SLAB_BITS, RANGE_WINDOWS = 2, 4, 24, 1 << 22
_NONE = np.iinfo(np.int64).max
_SECOND = 0x2545F4914F6CDD1D


def _chain(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the windows that start at the given words."""
    x = h[at] * tn.U64(0x9E3779B97F4A7C15)
    for j in range(1, length):
        x = tn.mix(x) + h[at + j] * tn.U64(2 * j + 3)
    return tn.mix(x)


class Windows:
    """The windows of a block: `at` their first words, `row` their texts, `a` a 64-bit hash of each."""

    def __init__(self, rows: pa.RecordBatch, length: int):
        self.length = length
        self.buf, self.off = tn.text_bytes(rows.column(1))
        self.words = tn.Words(self.buf, self.off)
        row = self.words.rows()
        self.at = np.flatnonzero(np.arange(len(row)) + length <= self.words.first[1:][row])
        self.row = row[self.at]
        self.a = _chain(tn.keyed_hash(self.buf, self.words.start, self.words.end), self.at, length)
        self.ids = rows.column(0).cast(pa.int64()).fill_null(_NONE).to_numpy()

    def cells(self, level: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted distinct cells of a hash row, the place of each window in them, and how many windows a cell has."""
        return np.unique(tn.mix(self.a + tn.U64(level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> tn.U64(64 - bits), return_inverse=True, return_counts=True)

    def names(self, hit: np.ndarray):
        """Of the windows at `hit`: the distinct names (64 and 32 bits, sorted), the smallest id of each, each window's name and id."""
        a = self.a[hit]
        b = (_chain(tn.keyed_hash(self.buf, self.words.start, self.words.end, _SECOND), self.at[hit], self.length) >> tn.U64(32)).astype(np.uint32)
        own = self.ids[self.row[hit]]
        order = np.lexsort((own, b, a))
        first = _firsts(a[order], b[order])
        place = np.empty(len(hit), np.int64)
        place[order] = np.cumsum(first) - 1
        begin = order[first]
        return a[begin], b[begin], own[begin], place, own


def _firsts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a new (a, b) begins in sorted arrays."""
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return new


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: pa.Scalar, dtype) -> np.ndarray:
    data, size = data.as_py(), np.dtype(dtype).itemsize
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _range_of(a: np.ndarray, ranges: int) -> np.ndarray:
    return ((a >> tn.U64(32)) * tn.U64(ranges) >> tn.U64(32)).astype(np.int64)


def _bits(table: pa.Table, kind: int) -> np.ndarray:
    """The answers of one kind, slab by slab or range by range, as one array of 0 and 1."""
    own = table.filter(pa.array(table.column("kind").to_numpy() == kind))
    order = np.argsort(own.column("part").to_numpy()).tolist()
    n, data = own.column("n").to_numpy(), own.column("answer")
    return np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(np.frombuffer(data[i].as_py(), np.uint8), count=n[i]) for i in order)])


_ANSWER = "block long, kind int, part long, n long, answer binary"


def _answers(blocks: list, kind: int, part: int, flags: list[np.ndarray]) -> pa.Table:
    n = len(blocks)
    return pa.table({
        "block": pa.array(blocks, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "part": pa.array([part] * n, pa.int64()),
        "n": pa.array([len(f) for f in flags], pa.int64()), "answer": tn.binary([np.packbits(f).tobytes() for f in flags]),
    })


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES, load: int = LOAD, slab_bits: int = SLAB_BITS, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """Rows id, n_words, n_removed, kept: every text without the words of windows that also start in a document with a smaller id.

    Words are runs of bytes other than space and 0x09-0x0D; kept words are joined by one space.  `id_col` holds whole numbers.  A null id is larger
    than any other; rows that share an id are one document, so neither takes words from the other.  Null and empty texts have no words and keep an
    empty text.  Other columns are dropped.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    table = packed(source, "_text", lambda rows: int(np.maximum(tn.Words(*tn.text_bytes(rows.column(1))).count - length + 1, 0).sum()), block_bytes)
    total = table.agg(F.sum("size")).first()[0] or 0
    bits = max(8, (load * total - 1).bit_length()) if total else 8
    inner = min(bits, slab_bits)
    ranges = max(1, -(-total // range_windows))

    def sketch_task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                windows = Windows(rows_of(batch.column(1)[i]), length)
                for level in range(LEVELS):
                    cell, _, n = windows.cells(level, bits)
                    cut = np.searchsorted(cell >> tn.U64(inner), np.arange((1 << (bits - inner)) + 1).astype(np.uint64))
                    for slab in np.flatnonzero(np.diff(cut)).tolist():
                        at = slice(cut[slab], cut[slab + 1])
                        gaps = np.diff(cell[at] & tn.U64((1 << inner) - 1), prepend=tn.U64(0)).astype(np.uint32) * np.uint32(2) + (n[at] > 1)
                        yield pa.RecordBatch.from_pydict({"block": batch.column(0).slice(i, 1), "level": pa.array([level], pa.int32()), "slab": pa.array([slab], pa.int64()), "cells": tn.binary([_pack(gaps.astype(np.uint32))])})

    def merge_task(part: pa.Table) -> pa.Table:
        count, lists = np.zeros(1 << inner, np.uint8), []
        for x in part.column("cells"):
            gaps = _unpack(x, np.uint32)
            cell = np.cumsum(gaps >> 1, dtype=np.int64)
            count[cell] = np.minimum(count[cell] + 1 + (gaps & 1), 2)
            lists.append(x)
        flags = [count[np.cumsum(_unpack(x, np.uint32) >> 1, dtype=np.int64)] > 1 for x in lists]
        return _answers(part.column("block").to_pylist(), part.column("level")[0].as_py(), part.column("slab")[0].as_py(), flags)

    def repeated(rows: pa.RecordBatch, answers: pa.Table) -> tuple[Windows, np.ndarray]:
        """The windows of a block, and those that the sketch takes for repeated."""
        windows = Windows(rows, length)
        hit = np.ones(len(windows.a), bool)
        for level in range(LEVELS):
            cell, place, _ = windows.cells(level, bits)
            flags = _bits(answers, level)
            if len(flags) != len(cell):
                raise ValueError("answers do not belong to this block")
            hit &= flags[place].astype(bool)
        return windows, np.flatnonzero(hit)

    def name_task(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"block": [], "range": [], "a": [], "b": [], "ids": []}
        for i in range(own.num_rows):
            windows, hit = repeated(rows_of(own.column("data")[i]), answers)
            a, b, least, _, _ = windows.names(hit)
            cut = np.searchsorted(_range_of(a, ranges), np.arange(ranges + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                at = slice(cut[k], cut[k + 1])
                for name, x in (("block", own.column("block")[i].as_py()), ("range", k), ("a", _pack(np.diff(a[at], prepend=tn.U64(0)))), ("b", _pack(b[at])), ("ids", _pack(least[at]))):
                    out[name].append(x)
        return pa.table({k: tn.binary(v) if k in ("a", "b", "ids") else pa.array(v, pa.int64()) for k, v in out.items()})

    def group_task(part: pa.Table) -> pa.Table:
        a = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in part.column("a")]
        size = np.array([len(x) for x in a])
        a = np.concatenate(a)
        b, least = (np.concatenate([_unpack(x, t) for x in part.column(c)]) for c, t in (("b", np.uint32), ("ids", np.int64)))
        order = np.lexsort((least, b, a))
        first = _firsts(a[order], b[order])
        earlier = np.empty(len(a), bool)
        earlier[order] = least[order][first][np.cumsum(first) - 1] < least[order]
        return _answers(part.column("block").to_pylist(), LEVELS, part.column("range")[0].as_py(), np.split(earlier, np.cumsum(size)[:-1]))

    def cut_task(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for i in range(own.num_rows):
            rows = rows_of(own.column("data")[i])
            windows, hit = repeated(rows, answers)
            _, _, least, place, ids = windows.names(hit)
            flags = _bits(answers, LEVELS)
            if len(flags) != len(least):
                raise ValueError("answers do not belong to this block")
            late = windows.at[hit[flags[place].astype(bool) | (ids > least[place])]]
            words = windows.words
            cover = np.zeros(len(words.start) + 1, np.int32)
            np.add.at(cover, late, 1)
            np.add.at(cover, late + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            removed = tn.reduce_rows(gone.astype(np.int64), words.first)
            kept = _joined(windows.buf, words.start[~gone], words.end[~gone], words.count - removed)
            out.append(pa.RecordBatch.from_arrays([rows.column(0), pa.array(words.count.astype(np.int64)), pa.array(removed), kept], names=["id", "n_words", "n_removed", "kept"]))
        return pa.Table.from_batches(out)

    lists = table.select("block", "data").mapInArrow(sketch_task, "block long, level int, slab long, cells binary")
    counted = written(lists.groupBy("level", "slab").applyInArrow(merge_task, _ANSWER), "sketch")
    names = table.select("block", "data").groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(name_task, "block long, range long, a binary, b binary, ids binary")
    grouped = written(names.groupBy("range").applyInArrow(group_task, _ANSWER), "earlier")
    out = table.select("block", "data").groupBy("block").cogroup(counted.unionByName(grouped).groupBy("block")).applyInArrow(cut_task, f"id {id_type}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def _joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray) -> pa.Array:
    """Strings of `count` words each, joined by one space."""
    size = end - start + 1
    stop = np.cumsum(size)
    at = np.arange(stop[-1] if len(stop) else 0)
    at += np.repeat(start - (stop - size), size)
    padded = np.concatenate((buf, np.zeros(1, np.uint8)))
    data = padded[at]
    data[stop - 1] = 0x20
    last = np.cumsum(count)
    bounds = np.concatenate(([0], stop))[np.concatenate(([0], last))]
    raw = data.tobytes()
    return pa.array([raw[a : max(a, b - 1)].decode("utf-8") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
windows AS (
  SELECT r, doc_id, i, word, CASE WHEN count(*) OVER x = {LENGTH} THEN md5(string_agg(word, ' ') OVER x) END AS name FROM words
  WINDOW x AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING)),
firsts AS (SELECT name, min(doc_id) AS least FROM windows WHERE name IS NOT NULL GROUP BY name),
marked AS (SELECT r, i, word, coalesce(least < doc_id, false) AS late FROM windows LEFT JOIN firsts USING (name)),
gone AS (SELECT r, i, word, bool_or(late) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked),
found AS (SELECT r, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN found USING (r)
"""
