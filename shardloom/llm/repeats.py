"""Removal of repeated byte strings by sharded suffix arrays.

A byte is removed when it lies in a string of LENGTH bytes that also starts somewhere else.

Sharding.  In every window of LENGTH bytes the smallest hash of a K-byte gram (leftmost if there are several)
marks an anchor; it depends on the window's bytes alone, so equal windows have equal anchors at the same place.
Consecutive windows with one anchor make a context, about a quarter of LENGTH windows long.  Contexts of one
anchor gram form a shard: whatever repeats, repeats inside a shard.  Anchors that occur once are dropped
first (a bit filter of bounded size, then exact counts); equal contexts, by a 128-bit digest of their bytes, are one
context with a count.

Shards.  The contexts of a task's shards are joined into lanes of similar length, whose suffix arrays are induced
(`induced`); permuted common prefixes then tell which windows repeat.  Equal windows lie in one shard, so it does
not matter that a lane holds several.

A shard with more than `shard_contexts` different contexts (a passage that very many texts share) is split: windows are
dealt into `SPLIT` classes by where the anchor stands in them, a context into its parts of one class, and the parts
into sub-shards by the bytes that all windows of a class share.  Equal windows stay together, equal parts
become one, and a sub-shard that is still large is split again, down to classes of one window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shardloom.llm import textnp as tn
from shardloom.llm.graph import bit_filter, bits_for, is_set, written
from shardloom.llm.induced import repeated, suffix_arrays

LENGTH, K, SPLIT = 200, 48, 16
#: Bytes of text, symbols of lanes, and rows of shards, that a task handles at once.
SLICE, BATCH, ROWS = 3 << 18, 300_000, 12_000
_POS = 22  # a stretch has fewer than 2**22 bytes
_SPAN = 1 << 16  # a run inside a context has fewer windows


def stretches(batches, length: int):
    """(batch, row numbers, first byte of each row's part, bytes, offsets): texts whole, those over SLICE bytes in parts.

    Parts of one text overlap by length - 1 bytes, so every window lies in exactly one of them.
    """
    for batch in batches:
        buf, off = tn.text_bytes(batch.column(batch.schema.get_field_index("_text")))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, side="right")) - 1)
            if j > i + 1 or off[j] - off[i] <= SLICE:
                yield batch, np.arange(i, j), np.zeros(j - i, np.int64), buf[off[i] : off[j]], off[i : j + 1] - off[i]
            else:
                for a in range(0, max(1, int(off[j] - off[i]) - length + 1), SLICE):
                    part = buf[off[i] + a : min(off[j], off[i] + a + SLICE + length - 1)]
                    yield batch, np.array([i]), np.array([a]), part, np.array([0, len(part)])
            i = j


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = K):
    """Arrays (row, first window, windows, anchor minus first window, gram hash) of a text buffer.

    Windows are byte positions in the buffer.
    """
    n = len(buf)
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if n < length:
        return empty
    prefix = tn.prefix_hash(buf)
    start = np.arange(n - k + 1)
    gram = tn.span_hash(prefix, start, start + k)
    bits = max(_POS, int(n).bit_length())
    best = (gram >> tn.U64(bits) << tn.U64(bits)) | start.astype(np.uint64)
    width, have = length - k + 1, 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
    last = np.repeat(off[1:], np.diff(off))[: len(best)] - length  # the last window of each position's row
    window = np.flatnonzero(np.arange(len(best)) <= last)
    if not len(window):
        return empty
    at = (best[window] & tn.U64((1 << bits) - 1)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    w, a = window[first], at[first]
    return np.searchsorted(off, w, side="right") - 1, w, count, a - w, gram[a]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def repeated_windows(buf: np.ndarray, size: np.ndarray, shard: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every window of the contexts, one after another, whether it occurs again in its shard.

    buf: the contexts' bytes; size: bytes of each; shard: its shard (equal ones are neighbours).
    """
    start = np.concatenate(([0], np.cumsum(size)))
    cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True])))
    symbols = start[cut[1:]] - start[cut[:-1]] + np.diff(cut)  # each context is followed by a separator
    windows = np.concatenate(([0], np.cumsum(size - length + 1)))
    out = np.zeros(windows[-1], bool)
    order = np.argsort(symbols, kind="stable")
    bound = np.cumsum(symbols[order])
    a = 0
    while a < len(order):
        b = max(a + 1, int(np.searchsorted(bound, (bound[a - 1] if a else 0) + BATCH, side="right")))
        picked = order[a:b]
        # Lanes of the length of the longest shard, filled one after another.
        limit, lane_of, at, lane, used = int(symbols[picked].max()), np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), 0, 0
        for x, n in enumerate(symbols[picked].tolist()):
            if used + n > limit:
                lane, used = lane + 1, 0
            lane_of[x], at[x] = lane, used
            used += n
        lanes = lane + 1
        own = np.concatenate([np.arange(cut[g], cut[g + 1]) for g in picked])
        group = np.repeat(np.arange(b - a), np.diff(cut)[picked])
        # Place of each context: after those of its shard before it, and their separators.
        ahead = np.concatenate(([0], np.cumsum(size[own] + 1)))
        ahead = ahead[:-1] - ahead[np.searchsorted(group, np.arange(b - a))][group] + at[group]
        length_of = np.zeros(lanes, np.int64)
        np.maximum.at(length_of, lane_of, at + symbols[picked] + 1)
        text = np.zeros((int(length_of.max()), lanes), np.uint16)
        flat = text.reshape(-1)
        n = size[own]
        first = np.concatenate(([0], np.cumsum(n)))
        step = np.arange(first[-1]) - np.repeat(first[:-1], n)
        where = (step + np.repeat(ahead, n)) * lanes + np.repeat(lane_of[group], n)
        flat[where] = buf[step + np.repeat(start[own], n)].astype(np.uint16) + 2
        flat[(ahead + n) * lanes + lane_of[group]] = 1
        again = repeated(text, length_of, suffix_arrays(text, length_of, 258), length).reshape(-1)
        n = n - length + 1
        first = np.concatenate(([0], np.cumsum(n)))
        step = np.arange(first[-1]) - np.repeat(first[:-1], n)
        out[step + np.repeat(windows[own], n)] = again[(step + np.repeat(ahead, n)) * lanes + np.repeat(lane_of[group], n)]
        a = b
    return out


def filter_of(keys: DataFrame, column: str, bits: int | None) -> np.ndarray:
    """A bit filter in which every key sets two bits, so few others pass; `bits` by the number of keys, if not given."""
    two = keys.select(F.explode(F.array(column, F.shiftrightunsigned(column, 28))).alias(column))
    return bit_filter(two, column, bits or bits_for(keys.count()))


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return is_set(words, keys) & is_set(words, keys >> tn.U64(28))


def _words(digests: pa.Array) -> np.ndarray:
    """16-byte digests as rows of two numbers."""
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 2)


def _solved(table: pa.Table, length: int) -> pa.RecordBatch:
    """Rows key, piece, n, data by key and piece, for each piece its count and then its bytes: the runs of repeated windows."""
    key, piece = table.column("key").to_numpy(), _words(table.column("piece").combine_chunks())
    counted = table.column("n").is_valid().to_numpy(zero_copy_only=False)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (piece[1:] != piece[:-1]).any(axis=1)
    at = np.flatnonzero(new & counted)
    at = at[at + 1 < len(key)]
    at = at[~new[at + 1]]
    rows = table.take(pa.array(at + 1))
    n = table.column("n").take(pa.array(at)).to_numpy()
    data = rows.column("data").combine_chunks().cast(pa.large_binary())
    _, offsets, raw = data.buffers() if len(at) else (None, None, None)
    off = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(at) + 1] if len(at) else np.zeros(1, np.int64)
    buf = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if len(at) else np.zeros(0, np.uint8)
    size = np.diff(off)
    again = repeated_windows(buf, size, key[at], length) if len(at) else np.zeros(0, bool)
    count = size - length + 1
    first = np.concatenate(([0], np.cumsum(count)))
    again &= np.repeat(n == 1, count)  # a piece that occurs twice repeats as a whole, which is known
    # Runs: where a repeated window follows another kind, or the begin of a piece.
    head, tail = again.copy(), again.copy()
    edge = np.zeros(len(again) + 1, bool)
    edge[first] = True
    head[1:] &= ~again[:-1] | edge[1:-1]
    tail[:-1] &= ~again[1:] | edge[1:-1]
    a, b = np.flatnonzero(head), np.flatnonzero(tail)
    which = np.searchsorted(first, a, side="right") - 1
    have = np.unique(which)
    cuts = np.searchsorted(which, np.append(have, len(at)))
    structs = pa.StructArray.from_arrays([pa.array((x - first[which]).astype(np.int32)) for x in (a, b)], names=["a", "b"])
    runs = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), structs)
    return pa.RecordBatch.from_arrays([pa.array(key[at][have]), rows.column("piece").combine_chunks().take(pa.array(have)), runs], names=["key", "piece", "runs"])


_COVER = "key long, piece binary, runs array<struct<a:int,b:int>>"
_PIECES = "key long, piece binary, n long, uid long, windows int, lead int, up_key long, up_piece binary, skip int, data binary"


def cover(pieces: DataFrame, *, width: int, length: int, shard_contexts: int, filter_bits: int | None) -> DataFrame:
    """Rows key, piece, runs: which windows of each distinct piece repeat.

    pieces: written rows key (shard), piece (digest), n (how many rows it stands for), uid, windows, lead (anchor minus first window), data.
    """
    spark = pieces.sparkSession
    distinct = pieces.groupBy("key", "piece").agg(F.sum("n").alias("n"), F.min("uid").alias("uid"), F.max("windows").alias("windows"))
    shard = Window.partitionBy("key")
    known = distinct.withColumns({"different": F.count(F.lit(1)).over(shard), "least": F.min("n").over(shard)}).where("different > 1 or n > 1")
    known = written(known, "known")
    # A piece that occurs twice repeats as a whole; a shard of such pieces alone needs no array.
    whole = known.where("n > 1").select("key", "piece", F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") - 1).cast("int").alias("b"))).alias("runs"))
    mixed = known.where("different > 1 and least = 1")
    small, large = mixed.where(F.col("different") <= shard_contexts), mixed.where(F.col("different") > shard_contexts)

    none = lambda kind: F.lit(None).cast(kind)

    def with_data(some: DataFrame, columns: list[str]) -> DataFrame:
        """For each piece of `some` a row with its count and one with its columns, and perhaps a few that a fixed-size filter lets through."""
        wanted = spark.sparkContext.broadcast(filter_of(some, "uid", filter_bits))

        def pick_task(batches):
            for batch in batches:
                yield batch.filter(pa.array(passes(wanted.value, batch.column(2).to_numpy().view(np.uint64))))

        picked = pieces.select("key", "piece", "uid", *columns)
        picked = picked.mapInArrow(pick_task, picked.schema).select("key", "piece", none("long").alias("n"), *columns)
        return some.select("key", "piece", "n", *[none(picked.schema[c].dataType).alias(c) for c in columns]).unionByName(picked)

    def shard_task(batches):
        # Rows come by key and piece: first the one with the count, then the bytes.
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                key = table.column("key").to_numpy()
                cut = np.flatnonzero(key[1:] != key[:-1])
                if len(cut):
                    yield _solved(table.slice(0, cut[-1] + 1), length)
                    held, rows = table.slice(cut[-1] + 1).to_batches(), table.num_rows - int(cut[-1]) - 1
        if rows:
            yield _solved(pa.Table.from_batches(held).combine_chunks(), length)

    rows = with_data(small, ["data"]).repartition("key")
    solved = rows.sortWithinPartitions("key", "piece", F.col("n").desc_nulls_last()).mapInArrow(shard_task, _COVER)
    out = whole.unionByName(solved)
    if width == 1 or large.isEmpty():
        return out

    finer = -(-width // SPLIT)

    def split_task(batches):
        # Rows come by piece here too; of several with bytes the first one is taken.
        counted = None
        for batch in batches:
            out = {name: [] for name in ("key", "piece", "n", "uid", "windows", "lead", "up_key", "up_piece", "skip", "data")}
            for r in batch.to_pylist():
                if r["n"] is not None:
                    counted = r
                    continue
                if counted is None or (r["key"], r["piece"]) != (counted["key"], counted["piece"]):
                    continue
                n, counted = counted["n"], None
                lead, data = r["lead"], r["data"]
                for c in range(max(0, lead - r["windows"] + 1) // finer, lead // finer + 1):
                    # Windows of this class have the anchor low .. high bytes after their start.
                    low, high = c * finer, min(c * finer + finer - 1, length - K)
                    t0, t1 = max(0, lead - high), min(r["windows"] - 1, lead - low)
                    own = data[t0 : t1 + length]
                    core = hashlib.blake2b(data[lead - low : lead - high + length], digest_size=8, salt=c.to_bytes(4, "little"), person=finer.to_bytes(4, "little")).digest()
                    mark = digest(own + (lead - t0).to_bytes(4, "little"))
                    uid = digest(r["piece"] + mark + r["key"].to_bytes(8, "little", signed=True))[:8]
                    for name, value in zip(out, (int.from_bytes(core, "little", signed=True), mark, n, int.from_bytes(uid, "little", signed=True), t1 - t0 + 1, lead - t0, r["key"], r["piece"], t0, own), strict=True):
                        out[name].append(value)
            kinds = dict(key=pa.int64(), piece=pa.binary(), n=pa.int64(), uid=pa.int64(), windows=pa.int32(), lead=pa.int32(), up_key=pa.int64(), up_piece=pa.binary(), skip=pa.int32(), data=pa.binary())
            yield pa.RecordBatch.from_pydict({name: pa.array(values, kinds[name]) for name, values in out.items()})

    rows = with_data(large, ["windows", "lead", "data"]).repartition("key", "piece")
    parts = written(rows.sortWithinPartitions("key", "piece", F.col("n").desc_nulls_last()).mapInArrow(split_task, _PIECES), "parts")
    below = cover(parts, width=finer, length=length, shard_contexts=shard_contexts, filter_bits=filter_bits)
    moved = parts.select("key", "piece", "up_key", "up_piece", "skip").join(below.hint("merge"), ["key", "piece"]).select(
        F.col("up_key").alias("key"), F.col("up_piece").alias("piece"),
        F.transform("runs", lambda r: F.struct((r["a"] + F.col("skip")).alias("a"), (r["b"] + F.col("skip")).alias("b"))).alias("runs"),
    )
    return out.unionByName(moved)


def row_keys(batch) -> list[bytes]:
    """A digest of id and text for each row of a batch; rows that repeat one another share it."""
    buf, off = tn.text_bytes(batch.column(1))
    ids = batch.column(0).to_pylist()
    return [digest(str(i).encode() + b"\0" + buf[a:b].tobytes()) for i, a, b in zip(ids, off[:-1].tolist(), off[1:].tolist(), strict=True)]


def merge_runs(batches):
    """Rows row_key, starts (first window * _SPAN + further windows, in any order): each row's runs, those that meet or overlap joined."""
    for batch in batches:
        lists = batch.column(1)
        n, x = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        row, a = np.repeat(np.arange(len(n)), n), x // _SPAN
        order = np.lexsort((a, row))
        row, a, b = row[order], a[order], (a + x % _SPAN)[order]
        # The last window so far of each row: rows are set apart before the maximum runs along.
        apart = row * (int(b.max(initial=0)) + 2)
        last = np.maximum.accumulate(b + apart)
        first = np.ones(len(a), bool)
        first[1:] = (row[1:] != row[:-1]) | (a[1:] + apart[1:] > last[:-1] + 1)
        at = np.flatnonzero(first)
        end = (last - apart)[np.append(at[1:], len(a)) - 1] if len(at) else at
        cuts = np.searchsorted(row[at], np.arange(len(n) + 1)).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(a[at]), pa.array(end)], names=["a", "b"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), structs)], names=["row_key", "runs"])


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, filter_bits: int | None = None, shard_contexts: int = 8) -> DataFrame:
    """Rows row_key (see `row_keys`), runs: for each text with repeated windows the maximal runs (a, b) of their starts, byte offsets, b included.

    Texts shorter than `length`, null ones among them, have no windows.  Texts over SLICE bytes are taken in parts.
    """
    spark = docs.sparkSession
    tn.ship_code(spark)
    source = docs.select(F.col(id_col), F.col(text_col).alias("_text")).where(F.octet_length("_text") >= length)

    def gram_task(batches):
        for _, _, _, buf, off in stretches(batches, length):
            u, n = np.unique(anchors(buf, off, length, k)[-1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["gram", "n"])

    counted = source.select("_text").mapInArrow(gram_task, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1")
    # The filter has a bound; a set bit too many costs only time.
    counted = written(counted.select("gram"), "grams")
    sent = spark.sparkContext.broadcast(filter_of(counted, "gram", filter_bits))

    def context_task(batches):
        held, names = None, None
        for batch, rows, base, buf, off in stretches(batches, length):
            if batch is not held:
                held, names = batch, pa.array(row_keys(batch), pa.binary())
            row, w, count, lead, gram = anchors(buf, off, length, k)
            hit = np.flatnonzero(passes(sent.value, gram))
            row, w, count, lead, gram = (x[hit] for x in (row, w, count, lead, gram))
            raw = buf.tobytes()
            data = [raw[a:b] for a, b in zip(w.tolist(), (w + count + length - 1).tolist(), strict=True)]
            at = w - off[row] + base[row]
            keys = names.take(pa.array(rows[row]))
            uid = tn.mix(tn.mix(_words(keys)[:, 0] + at.astype(np.uint64) * tn.U64(0x9E3779B97F4A7C15)))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(at), pa.array(gram.view(np.int64)), pa.array([digest(d + n.to_bytes(4, "little")) for d, n in zip(data, lead.tolist(), strict=True)], pa.binary()), pa.array(uid.view(np.int64)),
                 pa.array(count.astype(np.int32)), pa.array(lead.astype(np.int32)), tn.binary(data)],
                names=["row", "at", "key", "piece", "uid", "windows", "lead", "data"],
            )

    contexts = written(source.mapInArrow(context_task, "row binary, at long, key long, piece binary, uid long, windows int, lead int, data binary"), "contexts")
    pieces = contexts.withColumn("n", F.lit(1).cast("long"))
    covered = cover(pieces, width=length - k + 1, length=length, shard_contexts=shard_contexts, filter_bits=filter_bits)
    placed = contexts.select("row", "at", "key", "piece").join(covered.hint("merge"), ["key", "piece"]).select("row", "at", F.explode("runs").alias("r"))
    starts = placed.select(F.col("row").alias("row_key"), ((F.col("at") + F.col("r.a")) * _SPAN + F.col("r.b") - F.col("r.a")).alias("start"))
    # A set: however many copies of one row there are, their runs are kept once.
    return starts.groupBy("row_key").agg(F.collect_set("start").alias("starts")).mapInArrow(merge_runs, "row_key binary, runs array<struct<a:long,b:long>>")


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    Null texts count as empty.  Repeated rows repeat each other's bytes, null ids among them.  Other columns are dropped.
    """
    tn.ship_code(docs.sparkSession)
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = source.schema[id_col].dataType.simpleString()
    runs = written(find(source, id_col=id_col, text_col="_text", length=length, **options), "runs")
    low = runs.select(F.conv(F.hex(F.substring("row_key", 1, 7)), 16, 10).cast("long").alias("h"))
    touched = source.sparkSession.sparkContext.broadcast(filter_of(low, "h", None))

    out = f"`{id_col}` {id_type}, n_bytes long, n_removed long, n_spans long, kept binary"
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept"]

    def touched_rows(batches, hit):
        for batch in batches:
            keys = row_keys(batch)
            h = np.array([int.from_bytes(x[:7], "big") for x in keys], np.uint64)
            yield batch.append_column("row_key", pa.array(keys, pa.binary())).filter(pa.array(passes(touched.value, h) == hit))

    def whole_task(batches):
        for part in tn.slices(touched_rows(batches, False), "_text", SLICE):
            buf, off = tn.text_bytes(part.column(1))
            zero, raw = np.zeros(part.num_rows, np.int64), buf.tobytes()
            kept = tn.binary([raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(zero), pa.array(zero), kept], names=names)

    def cut_task(batches):
        yield from touched_rows(batches, True)

    def remove_task(batches):
        for part in tn.slices(batches, "_text", SLICE):
            buf, off = tn.text_bytes(part.column(1))
            delta = np.zeros(len(buf) + 1, np.int32)
            lists = part.column(2)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            base = np.repeat(off[:-1], n)
            flat = lists.flatten()
            if len(flat):
                np.add.at(delta, flat.field(0).to_numpy() + base, 1)
                np.add.at(delta, flat.field(1).to_numpy() + base + length, -1)
            gone = np.cumsum(delta[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            edge = off[:-1][off[:-1] < len(buf)]
            begins[edge] = gone[edge]
            removed = tn.reduce_rows(gone.astype(np.int64), off)
            spans = tn.reduce_rows(begins.astype(np.int64), off)
            left = buf[~gone].tobytes()
            cut = np.concatenate(([0], np.cumsum(np.diff(off) - removed))).tolist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(removed), pa.array(spans), tn.binary([left[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])], names=names)

    # Texts without repeats stay where they are; only the others travel to their runs.
    cut = source.mapInArrow(cut_task, f"`{id_col}` {id_type}, _text string, row_key binary").join(runs.hint("shuffle_hash"), "row_key", "left").select(id_col, "_text", "runs")
    return source.mapInArrow(whole_task, out).unionByName(cut.mapInArrow(remove_task, out))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of every text as hexadecimal digits, counted; a byte goes if one of the 200 windows over it occurs again.
#: Blocks of 256 bytes only spare the engine from walking a long text for each of its windows.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sizes AS (SELECT r, doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
blocks AS (SELECT r, n, b * 256 AS first, substr(h, CAST(b * 512 + 1 AS BIGINT), {512 + 2 * LENGTH}) AS part FROM (SELECT r, h, n, unnest(range((n + 255) // 256)) AS b FROM sizes)),
places AS (SELECT r, n, first, part, unnest(range(least(256, n - first))) AS i FROM blocks),
windows AS (SELECT r, first + i AS i, CASE WHEN first + i + {LENGTH} <= n THEN md5(substr(part, CAST(2 * i + 1 AS BIGINT), {2 * LENGTH})) END AS w, substr(part, CAST(2 * i + 1 AS BIGINT), 2) AS byte FROM places),
twice AS (SELECT w FROM windows WHERE w IS NOT NULL GROUP BY w HAVING count(*) > 1),
marked AS (SELECT r, i, byte, t.w IS NOT NULL AS again FROM windows LEFT JOIN twice t USING (w)),
gone AS (SELECT r, i, byte, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked),
edges AS (SELECT r, i, byte, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM gone),
found AS (SELECT r, count(*) FILTER (gone) AS removed, count(*) FILTER (begins) AS spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM edges GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM sizes LEFT JOIN found USING (r)
"""
