"""Training-order materialisation of token ids.

Texts become token ids, each text ends with `end_id`, and the texts, one after another, are cut into sequences of `length` tokens.  Every
sequence gets a slot of the training order:

* texts stand in the order of a keyed hash of id and text (then id, text digest), whatever their partitions; a text's first token is
  numbered by the tokens of all texts before it, from sums of sorted ranges;
* a keyed Feistel network permutes the sequence numbers below the next power of 4; a result of n or more is put
  through the network again until it falls below n (cycle-walking), which makes a permutation of 0 .. n - 1;
* slots are range-partitioned into runs of shards of `shard_slots` slots.  A shard is one file with a fixed stride
  of `2 * length` bytes (16-bit ids; the last sequence is padded with `end_id`), so slot s is at byte (s % shard_slots) * stride of the
  file of shard s // shard_slots, and a reader resumes anywhere without an index.

So the order depends on the rows and the key alone.  Tokens are written once, bucketed by parts of a bounded size, so a part meets the numbers of its
texts without another move.  A task that is tried again writes another file, and the manifest, which Spark commits, names the one that counts.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import textnp as tn
from shardloom.operators.graph import shared_path, written

ROUNDS = 6
#: Text bytes of a part, and of a bucket of parts.
PART_BYTES, BUCKET_BYTES = 16 << 20, 64 << 20
#: Bytes of the shards that a task writes, unless one shard is larger.
TASK_BYTES = 32 << 20


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The keyed permutation of 0 .. n - 1 at x."""
    half = 1
    while 1 << (2 * half) < n:
        half += 1
    mask = tn.U64((1 << half) - 1)
    x = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> tn.U64(half), x[todo] & mask
        for r in range(ROUNDS):
            f = tn.mix(right + tn.U64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))
            left, right = right, left ^ (f & mask)
        x[todo] = (left << tn.U64(half)) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def byte_pair_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def text_key(key: int, name: str, digest: bytes) -> int:
    """Where a text stands: a signed 64-bit hash of the key, the id as text and the text's digest."""
    return int.from_bytes(hashlib.blake2b(name.encode() + b"|" + digest, digest_size=8, key=key.to_bytes(8, "little", signed=True)).digest(), "little", signed=True)


def tokenise(docs: DataFrame, ranks: dict[bytes, int], pattern: str, name: str, *, end_id: int, key: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, part, at (which tell rows apart), place, digest, n_tokens, ids: a text's 16-bit ids with the end token, as the bucketed table `name`.

    Null and empty texts are the end token alone.
    """
    spark = docs.sparkSession
    tn.ship_code(spark)
    source = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    id_type = source.schema[id_col].dataType.simpleString()
    table = spark.sparkContext.broadcast(ranks)  # a vocabulary of at most 2**16 entries
    total = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0

    def task(batches):
        import tiktoken
        from pyspark import TaskContext

        codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table.value, special_tokens={})
        part, at, held = TaskContext.get().partitionId() << 24, 0, 0
        for batch in tn.slices(batches, "_text"):
            n = batch.num_rows
            texts = [t or "" for t in batch.column(1).to_pylist()]
            size = sum(map(len, texts))
            if held and held + size > PART_BYTES:
                part, at, held = part + 1, 0, 0
            held += size
            digests = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
            places = [text_key(key, str(i), d) for i, d in zip(batch.column(0).to_pylist(), digests, strict=True)]
            ids = [np.array([*codec.encode_ordinary(t), end_id], "<u2") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n)), pa.array(places, pa.int64()), tn.binary(digests),
                    pa.array([len(x) for x in ids], pa.int64()), tn.binary([x.tobytes() for x in ids]),
                ],
                names=[id_col, "part", "at", "place", "digest", "n_tokens", "ids"],
            )
            at += n

    rows = source.mapInArrow(task, f"`{id_col}` {id_type}, part long, at long, place long, digest binary, n_tokens long, ids binary")
    rows.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").option("path", shared_path(spark, "tokens")).bucketBy(min(100_000, max(1, -(-total // BUCKET_BYTES))), "part").saveAsTable(name)
    return spark.table(name)


def token_numbers(tokens: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """part, at and first (the number of the text's first token) of every text, and the number of all tokens.

    Texts are sorted in ranges by place, id and digest; rows equal in all of them are the same text, so it doesn't matter which is first.
    """
    by = ["place", id_col, "digest", "part", "at"]

    def task(batches):
        from pyspark import TaskContext

        span, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(len(n), span, np.int64)), pa.array(before)], names=["part", "at", "n_tokens", "span", "before"])

    ordered = tokens.select("n_tokens", *by).repartitionByRange(*by).sortWithinPartitions(*by).select("part", "at", "n_tokens")
    runs = written(ordered.mapInArrow(task, "part long, at long, n_tokens long, span long, before long"), "runs")
    # One row for each range of the sort.
    spans = sorted((r.span, r.n) for r in runs.groupBy("span").agg(F.sum("n_tokens").alias("n")).collect())
    starts = np.cumsum([0, *(n for _, n in spans)]).tolist()
    base = tokens.sparkSession.createDataFrame([(s, b) for (s, _), b in zip(spans, starts, strict=False)], "span long, base long")
    return runs.join(F.broadcast(base), "span").select("part", "at", (F.col("base") + F.col("before")).alias("first")), starts[-1]


def _shards_a_task(shard_slots: int, length: int) -> int:
    return max(1, TASK_BYTES // (2 * length * shard_slots))


def cut(tokens: DataFrame, first: DataFrame, total: int, key: int, *, length: int, shard_slots: int, id_col: str = "doc_id") -> DataFrame:
    """Rows run, slot, at, id, chunk, n_tokens (lists), ids: the pieces of every text, chunk by chunk, and where they stand in their slots.

    A part of the tokens sends each run of shards one row: its pieces, their ids joined and compressed together.
    """
    sequences = -(-total // length)
    id_type = tokens.schema[id_col].dataType.simpleString()
    slots = shard_slots * _shards_a_task(shard_slots, length)

    def task(own: pa.Table, numbers: pa.Table) -> pa.Table:
        own, numbers = own.sort_by("at"), numbers.sort_by("at")
        a, n = numbers.column("first").to_numpy(), own.column("n_tokens").to_numpy()
        pieces = (a + n - 1) // length - a // length + 1
        row = np.repeat(np.arange(len(a)), pieces)
        chunk = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        where = np.maximum(a[row], (a[row] // length + chunk) * length)
        size = np.minimum(a[row] + n[row], (where // length + 1) * length) - where
        raw = memoryview(b"".join(x.as_py() for x in own.column("ids")))
        begin = 2 * (np.cumsum(size) - size)
        slot = feistel(where // length, sequences, key)
        order = np.lexsort((where % length, slot))
        run, bounds = np.unique(slot[order] // slots, return_index=True)
        bounds = np.append(bounds, len(order))
        codec = pa.Codec("zstd", compression_level=3)
        data = [codec.compress(b"".join(raw[begin[i] : begin[i] + 2 * size[i]] for i in order[x:y].tolist()), asbytes=True) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), x)
        number = lambda x, t: lists(pa.array(x[order], t))
        return pa.table({
            "run": run, "slot": number(slot, pa.int64()), "at": number(where % length, pa.int32()), "id": lists(own.column("id").combine_chunks().take(pa.array(row[order]))),
            "chunk": number(chunk, pa.int32()), "n_tokens": number(size, pa.int32()), "ids": tn.binary(data),
        })

    rows = tokens.select(F.col(id_col).alias("id"), "part", "at", "n_tokens", "ids")
    return rows.groupBy("part").cogroup(first.groupBy("part")).applyInArrow(task, f"run long, slot array<long>, at array<int>, id array<{id_type}>, chunk array<int>, n_tokens array<int>, ids binary")


def write_shards(pieces: DataFrame, total: int, path: str, *, length: int, pad_id: int, shard_slots: int) -> None:
    """Write the pieces (from `cut`) as files of `shard_slots` slots of 2 * length bytes, and beside them the table `order`: a row for each piece, and for
    each shard one with shard, first_slot, n_slots, stride, bytes, crc32 and file.

    Each try of a task writes files of its own, and the table, committed by Spark, names those that count.  A task holds the shards of one run.  `path` is a
    folder that Arrow's file systems and Spark both know (file, hdfs, s3, ...).
    """
    per_task = _shards_a_task(shard_slots, length)
    runs = max(1, -(-(-(-total // length)) // (shard_slots * per_task)))
    stride = 2 * length
    pad = np.uint16(pad_id).tobytes()
    names = ["slot", "at", "id", "chunk", "n_tokens", "crc32", "shard", "byte_offset", "first_slot", "n_slots", "stride", "bytes", "file"]
    id_kind = pieces.schema["id"].dataType.elementType.simpleString()
    kinds = dict.fromkeys(names, pa.int64()) | {"file": pa.string()}

    def task(batches):
        fs, _ = pa_fs.FileSystem.from_uri(path)
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        own = pa.Table.from_batches(rows)
        flat = {c: pa.concat_arrays([x.flatten() for x in own.column(c).chunks]) for c in names[:5]}
        slot, at, n = (flat[c].to_numpy().astype(np.int64) for c in ("slot", "at", "n_tokens"))
        sizes = own.column("n_tokens").combine_chunks()
        many = [2 * sum(x.as_py()) for x in sizes]
        raw = memoryview(b"".join(pa.decompress(x.as_py(), k, codec="zstd", asbytes=True) for x, k in zip(own.column("ids"), many, strict=True)))
        begin = 2 * (np.cumsum(n) - n)
        order = np.lexsort((at, slot))
        shard = slot[order] // shard_slots
        for s in np.unique(shard).tolist():
            at_shard = order[slice(*np.searchsorted(shard, [s, s + 1]).tolist())]
            texts = [raw[begin[i] : begin[i] + 2 * n[i]] for i in at_shard.tolist()]
            slots = int(slot[at_shard[-1]] - s * shard_slots + 1)
            # Pieces fill their slots without gaps; only the last sequence of all is short, wherever its slot is.
            data = bytearray().join(texts)
            short = np.flatnonzero(np.bincount(slot[at_shard] - s * shard_slots, weights=n[at_shard]) < length)
            for k in short.tolist():
                have = int(n[at_shard][slot[at_shard] - s * shard_slots == k].sum())
                data[k * stride + 2 * have : k * stride + 2 * have] = pad * (length - have)
            name = f"{path.rstrip('/')}/shard-{s:09d}-{uuid.uuid4().hex}.bin"
            _, target = pa_fs.FileSystem.from_uri(name)
            fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(target) as f:
                f.write(data)
            made = {"shard": s, "first_slot": s * shard_slots, "n_slots": slots, "stride": stride, "bytes": len(data), "crc32": zlib.crc32(data), "file": name}
            take = pa.array(at_shard)
            crc = pa.array([zlib.crc32(x) for x in texts], pa.int64())
            where = pa.array(slot[at_shard] % shard_slots * stride + 2 * at[at_shard])
            none = [pa.nulls(len(take), kinds[c]) for c in names[8:]]
            yield pa.RecordBatch.from_arrays([*(flat[c].take(take) if c == "id" else flat[c].take(take).cast(pa.int64()) for c in names[:5]), crc, pa.array(np.full(len(take), s)), where, *none], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([made.get(c)], flat["id"].type if c == "id" else kinds[c]) for c in names], names=names)

    ranged = pieces.repartitionById(runs, F.col("run").cast("int"))
    schema = ", ".join(f"{c} {id_kind if c == 'id' else 'string' if c == 'file' else 'long'}" for c in names)
    ranged.select(*names[:5], "ids").mapInArrow(task, schema).write.option("compression", "zstd").parquet(f"{path.rstrip('/')}/order")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """shard, first_slot, n_slots, stride, bytes, crc32, file of every shard."""
    return spark.read.parquet(f"{path.rstrip('/')}/order").where("file is not null").select("shard", "first_slot", "n_slots", "stride", "bytes", "crc32", "file")


def read_slots(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rows slot, ids (16-bit ids with padding) for first <= slot < last, slots beyond the end left out.

    Each shard of the range is one seek and sequential read; nothing else is read.
    """
    tn.ship_code(spark)

    def task(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lo, hi = max(first, r["first_slot"]), min(last, r["first_slot"] + r["n_slots"])
                fs, target = pa_fs.FileSystem.from_uri(r["file"])
                with fs.open_input_file(target) as f:
                    data = f.read_at((hi - lo) * r["stride"], (lo - r["first_slot"]) * r["stride"])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi)), tn.binary([data[i * r["stride"] : (i + 1) * r["stride"]] for i in range(hi - lo)])], names=["slot", "ids"])

    own = manifest(spark, path).where((F.col("first_slot") < last) & (F.col("first_slot") + F.col("n_slots") > first))
    return own.select("first_slot", "n_slots", "stride", "file").mapInArrow(task, "slot long, ids binary")


def materialise(docs: DataFrame, path: str, ranks: dict[bytes, int], pattern: str, *, length: int = 512, end_id: int = 50256, key: int = 1, shard_slots: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to `path`; return the order, a row for each piece of a text: slot, at (its first token in the slot), id, chunk (pieces of a text from
    0), n_tokens, crc32 of its ids, shard, byte_offset (in the shard's file).

    Null and empty texts are the end token alone; ids may be null or repeated, every row has tokens of its own.  Other columns are
    dropped.  The same rows and key give the same shards for any partitioning.
    """
    name = f"tokens_{uuid.uuid4().hex}"
    tokens = tokenise(docs, ranks, pattern, name, end_id=end_id, key=key, id_col=id_col, text_col=text_col)
    try:
        first, total = token_numbers(tokens, id_col)
        write_shards(cut(tokens, first, total, key, length=length, shard_slots=shard_slots, id_col=id_col), total, path, length=length, pad_id=end_id, shard_slots=shard_slots)
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")  # the name alone; its files stay in the shared folder
    order = docs.sparkSession.read.parquet(f"{path.rstrip('/')}/order").where("file is null")
    return order.select("slot", "at", F.col("id").alias(id_col), "chunk", "n_tokens", "crc32", "shard", "byte_offset")


def query(spark, sf_dir: str, folder: str = "/opt/tokenizers") -> DataFrame:
    """The training order of all documents; the shards go to the shared folder."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = shared_path(spark, "shards")
    return materialise(docs, path, byte_pair_ranks(f"{folder}/byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
