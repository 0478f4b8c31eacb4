"""Benchmark decontamination by spaced seeds.

A fixed mask such as 1100010111 hashes the words at its 1-positions and ignores the others, so a window of a
training text and one of a test item still meet when a word at an ignored position was replaced.  For items of
13 words or more, four masks of weight 6 together meet every stretch of 11 to 25 words with up to a fifth of its words replaced,
wherever these are (and so every longer one, a half of which has no more replaced); shorter items have masks of their own with the same property.

The hashes of the test items are a table.  Texts are read once for the windows that a bit filter of the table (of fixed size)
lets through; these are joined with the table, and each hit names a diagonal (text position minus item position).  The words
of the diagonals, cut from the few texts that have any, are then compared one by one: of all stretches
that are long enough and have the asked share of equal words, the one with most equal words is the overlap.
Neither side is collected or broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm import textnp as tn
from shardloom.llm.graph import bit_filter, bits_for, is_set, written

MASKS = ("1101111", "1100010111", "11111001", "1110100011")
#: Masks of items of fewer than 13 words.
SHORT = {
    1: ("1",), 2: ("11",), 3: ("111",), 4: ("1111",), 5: ("111", "1011"), 6: ("111", "1011"), 7: ("11011", "1111"), 8: ("110111", "11111", "111011"),
    9: ("1101111", "1111011", "111111"), 10: ("110111", "11001011", "11111"), 11: ("110111", "11001011", "11111"), 12: ("110111", "11001011", "11111"),
}
#: Diagonals of one text that are cut from it together.
BLOCK = 4096
#: Places that the windows of one seed go to.
SALTS = 8


def masks_of(n: int) -> tuple[str, ...]:
    return SHORT.get(n, MASKS)


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked words for every start of a window in h."""
    at = np.flatnonzero(np.frombuffer(mask.encode(), np.uint8) == ord("1"))
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, tn.U64(int("1" + mask, 2)), np.uint64)
    for j, o in enumerate(at.tolist()):
        out = tn.mix(out) + h[o : o + n] * tn.U64(2 * j + 3)
    return tn.mix(out)


def best_overlap(same: np.ndarray, least: float, share: float) -> tuple[int, int, int] | None:
    """Start, words and equal words of the stretch of a diagonal with most equal words, of those of at least `least`
    words that begin and end with an equal word and have at least `share` of equal words; of several the shortest, then the first."""
    at = np.flatnonzero(same)
    if len(at) < share * least - 1e-9:
        return None
    # With k equal words before one at x, the stretch from x to y passes if (k_y + 1 - k_x) >= share (y + 1 - x).
    # For an end, the first start whose value is high enough is the longest; a running maximum finds it.
    k = np.arange(len(at))
    begin = share * at - k
    finish = share * (at + 1) - (k + 1)
    i = np.minimum(np.searchsorted(np.maximum.accumulate(begin), finish - 1e-9), k)
    n, equal = at + 1 - at[i], k + 1 - i
    ok = np.flatnonzero(n >= least - 1e-9)
    if not len(ok):
        return None
    j = ok[np.lexsort((at[i[ok]], n[ok], -equal[ok]))[0]]
    return int(at[i[j]]), int(n[j]), int(equal[j])


def _names(batch) -> pa.Array:
    """A digest of id and text for each row; rows that repeat one another share it."""
    buf, off = tn.text_bytes(batch.column(1))
    ids = batch.column(0).to_pylist()
    return pa.array([hashlib.blake2b(str(i).encode() + b"\0" + buf[a:b].tobytes(), digest_size=16).digest() for i, a, b in zip(ids, off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())


def _overlaps(docs: DataFrame, tests: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, min_overlap: int, share: float, min_words: int, filter_bits: int | None):
    """(written rows doc, id of the texts with a seed; rows doc, item, doc_start, item_start, n_words, n_equal)."""
    spark = docs.sparkSession
    tn.ship_code(spark)
    source = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    id_type = source.schema[id_col].dataType.simpleString()

    def item_task(batches):
        for part in tn.slices(batches, "t"):
            words, h = tn.word_hashes(part.column(1))
            raw = h.tobytes()
            keep = np.flatnonzero(words.count >= min_words)
            cuts = [raw[8 * a : 8 * b] for a, b in zip(words.first[keep].tolist(), words.first[keep + 1].tolist(), strict=True)]
            names = [hashlib.blake2b(str(i).encode() + b"\0" + x, digest_size=16).digest() for i, x in zip(part.column(0).take(pa.array(keep)).to_pylist(), cuts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), part.column(0).take(pa.array(keep)), pa.array(words.count[keep]), tn.binary(cuts)], names=["name", "item", "size", "words"])

    items = tests.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("t")).where("t is not null and item is not null").distinct()
    items = written(items.mapInArrow(item_task, "name binary, item long, size long, words binary").dropDuplicates(["name"]), "items")

    def seed_task(batches):
        for batch in batches:
            for name, size, raw in zip(*(batch.column(c).to_pylist() for c in ("name", "size", "words")), strict=True):
                for mask in masks_of(size):
                    s = seed_hashes(np.frombuffer(raw, np.uint64), mask)
                    n = len(s)
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array([name] * n, pa.binary()), pa.array([size] * n, pa.int64()), pa.array(np.arange(n))], names=["seed", "name", "size", "at"])

    seeds = written(items.select("name", "size", "words").mapInArrow(seed_task, "seed long, name binary, size long, at long"), "seeds")
    # Which masks are in use; at most 13 numbers.
    sizes = [r[0] for r in items.select(F.least("size", F.lit(13))).distinct().collect()]
    masks = sorted({m for n in sizes for m in masks_of(n)})
    sent = spark.sparkContext.broadcast(bit_filter(seeds, "seed", filter_bits or bits_for(seeds.count())))

    def window_task(batches):
        for part in tn.slices(batches, "_text"):
            words, h = tn.word_hashes(part.column(1))
            rows, at, seed = [], [], []
            for mask in masks:
                s = seed_hashes(h, mask)
                hit = np.flatnonzero(is_set(sent.value, s))
                row = np.searchsorted(words.first, hit, side="right") - 1
                inside = hit + len(mask) <= words.first[row + 1]
                rows.append(row[inside])
                at.append(hit[inside] - words.first[row[inside]])
                seed.append(s[hit[inside]])
            row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            if not len(row):
                continue
            own, back = np.unique(row, return_inverse=True)
            names = _names(part.take(pa.array(own)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(back)), pa.array(np.concatenate(at)), pa.array(np.concatenate(seed).view(np.int64))], names=["doc", "at", "seed"])

    windows = source.mapInArrow(window_task, "doc binary, at long, seed long")
    # A seed of a common passage or word may be most windows: they go to SALTS places by where they stand, each with the seeds.
    placed = windows.withColumn("_salt", F.pmod("at", F.lit(SALTS)).cast("int"))
    spread = seeds.withColumnRenamed("at", "_at").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = written(
        placed.join(spread, ["seed", "_salt"]).select("doc", "name", "size", (F.col("at") - F.col("_at")).alias("diagonal")).distinct(), "hits",
    )
    low = F.conv(F.hex(F.substring("doc", 1, 7)), 16, 10).cast("long")
    named = hits.select(low.alias("h")).distinct()
    met = spark.sparkContext.broadcast(bit_filter(named, "h", filter_bits or bits_for(named.count())))

    def word_task(batches):
        for part in tn.slices(batches, "_text"):
            names = _names(part)
            pick = pa.array(is_set(met.value, np.array([int.from_bytes(x[:7], "big") for x in names.to_pylist()], np.uint64)))
            part, names = part.filter(pick), names.filter(pick)
            if not part.num_rows:
                continue
            words, h = tn.word_hashes(part.column(1))
            raw, cut = h.tobytes(), (8 * words.first).tolist()
            yield pa.RecordBatch.from_arrays([names, part.column(0), tn.binary([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])], names=["doc", id_col, "words"])

    texts = written(source.mapInArrow(word_task, f"doc binary, `{id_col}` {id_type}, words binary"), "texts")

    def cut_task(batches):
        for batch in batches:
            for doc, raw, found in zip(*(batch.column(c).to_pylist() for c in ("doc", "words", "found")), strict=True):
                n = len(raw) // 8
                lo = [max(0, f["diagonal"]) for f in found]
                hi = [min(n, f["diagonal"] + f["size"]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * len(found), pa.binary()), pa.array([f["name"] for f in found], pa.binary()), pa.array([f["diagonal"] for f in found], pa.int64()), pa.array(lo, pa.int64()), tn.binary([raw[8 * a : 8 * b] for a, b in zip(lo, hi, strict=True)])],
                    names=["doc", "name", "diagonal", "lo", "own"],
                )

    by_doc = hits.groupBy("doc", F.floor(F.col("diagonal") / BLOCK).alias("_block")).agg(F.collect_list(F.struct("name", "size", "diagonal")).alias("found"))
    cuts = by_doc.join(texts.select("doc", "words").dropDuplicates(["doc"]), "doc").select("doc", "words", "found").mapInArrow(cut_task, "doc binary, name binary, diagonal long, lo long, own binary")
    cuts = written(cuts, "cuts")  # few rows; a task then runs one Python step at a time

    def compare_task(batches):
        for batch in batches:
            out = []
            for doc, item, size, words, diagonal, lo, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a = lo - diagonal
                same = np.frombuffer(words, np.uint64)[a : a + len(own) // 8] == np.frombuffer(own, np.uint64)
                found = best_overlap(same, min(min_overlap, share * size), share)
                if found:
                    start, n, equal = found
                    out.append((doc, item, lo + start, a + start, n, equal))
            kinds = (pa.binary(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], k) for j, k in enumerate(kinds)], names=["doc", "item", "doc_start", "item_start", "n_words", "n_equal"])

    compared = cuts.join(items, "name").select("doc", "item", "size", "words", "diagonal", "lo", "own").mapInArrow(compare_task, "doc binary, item long, doc_start long, item_start long, n_words long, n_equal long")
    best = F.min(F.struct((-F.col("n_equal")).alias("e"), F.col("n_words").alias("n"), F.col("doc_start").alias("d"), F.col("item_start").alias("i"))).alias("b")
    found = compared.groupBy("doc", "item").agg(best).select("doc", "item", F.col("b.d").alias("doc_start"), F.col("b.i").alias("item_start"), F.col("b.n").alias("n_words"), (-F.col("b.e")).alias("n_equal"))
    return texts.select("doc", id_col), found


def find(docs: DataFrame, tests: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
         min_overlap: int = 13, share: float = 0.8, min_words: int = 1, filter_bits: int | None = None) -> DataFrame:
    """Rows id, item, doc_start, item_start, n_words, n_equal: the best overlap of a text with a test item.

    An overlap counts when it has at least `min_overlap` words (or `share` of the item's words, if fewer) and
    at least `share` of its words are equal; the best has most equal words, then fewest words, then the first place in text and item.
    Positions count words.  The masks meet every overlap at the default share and min_overlap; for lower ones some are missed.
    Items of fewer than `min_words` words, null and empty texts meet nothing.  An item of one word removes every text with that word: set
    `min_words` where tests may hold such items.  `item_col` holds whole numbers; repeated rows give repeated
    rows; items of one id with different texts are items of their own, and repeat the id.  Other columns are dropped.
    """
    texts, found = _overlaps(docs, tests, id_col, text_col, item_col, item_text, min_overlap, share, min_words, filter_bits)
    return texts.join(found, "doc").select(id_col, F.col("item").alias(item_col), "doc_start", "item_start", "n_words", "n_equal")


def drop_contaminated(docs: DataFrame, tests: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                      min_overlap: int = 13, share: float = 0.8, min_words: int = 1, filter_bits: int | None = None) -> DataFrame:
    """The rows and columns of `docs` whose text has no such overlap (see `find`) with any test item.

    Texts without a candidate are passed on where they are; only the others are joined with what was found.
    """
    _, found = _overlaps(docs, tests, id_col, text_col, item_col, item_text, min_overlap, share, min_words, filter_bits)
    found = written(found.select("doc").distinct(), "found")
    low = F.conv(F.hex(F.substring("doc", 1, 7)), 16, 10).cast("long")
    gone = docs.sparkSession.sparkContext.broadcast(bit_filter(found.select(low.alias("h")), "h", filter_bits or bits_for(found.count())))
    at = docs.columns.index(id_col), docs.columns.index(text_col)

    def named(batches):
        for batch in batches:
            names = _names(pa.RecordBatch.from_arrays([batch.column(i) for i in at], names=["id", "t"]))
            yield batch, names, is_set(gone.value, np.array([int.from_bytes(x[:7], "big") for x in names.to_pylist()], np.uint64))

    def clean_task(batches):
        for batch, _, hit in named(batches):
            yield batch.filter(pa.array(~hit))

    def doubtful_task(batches):
        for batch, names, hit in named(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, names], names=[*(f"c{i}" for i in range(batch.num_columns)), "_doc"]).filter(pa.array(hit))

    # Columns by place, so that no name of the input can clash.
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)) + ", _doc binary"
    kept = docs.mapInArrow(doubtful_task, schema).join(found.select(F.col("doc").alias("_doc")).hint("shuffle_hash"), "_doc", "left_anti").drop("_doc").toDF(*docs.columns)
    return docs.mapInArrow(clean_task, docs.schema).union(kept)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: Every pair of equal words, by diagonal; every stretch of a diagonal between two of its equal words is judged.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.format('text')} AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
i AS (SELECT row_number() OVER () AS q, item_id, {_SPLIT.format('text')} AS w FROM t),
dw AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS x FROM d),
iw AS (SELECT q, item_id, len(w) AS size, least(13, 0.8 * len(w)) AS least, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS y FROM i),
same AS (SELECT r, doc_id, q, item_id, least, x - y AS g, x, y FROM dw JOIN iw USING (word)),
rich AS (SELECT r, q, g FROM same GROUP BY ALL HAVING count(*) >= 0.8 * any_value(least) - 1e-9),
k AS (SELECT same.*, row_number() OVER (PARTITION BY r, q, g ORDER BY x) AS k FROM same JOIN rich USING (r, q, g)),
stretches AS (
  SELECT a.r, a.doc_id, a.q, a.item_id, a.x AS doc_start, a.y AS item_start, b.x - a.x + 1 AS n_words, b.k - a.k + 1 AS n_equal
  FROM k a JOIN k b ON a.r = b.r AND a.q = b.q AND a.g = b.g AND b.x >= a.x
  WHERE b.x - a.x + 1 >= a.least - 1e-9 AND b.k - a.k + 1 >= 0.8 * (b.x - a.x + 1) - 1e-9)
SELECT doc_id, item_id, doc_start::BIGINT AS doc_start, item_start::BIGINT AS item_start, n_words::BIGINT AS n_words, n_equal::BIGINT AS n_equal FROM stretches
QUALIFY row_number() OVER (PARTITION BY r, q ORDER BY n_equal DESC, n_words, doc_start, item_start) = 1
"""
