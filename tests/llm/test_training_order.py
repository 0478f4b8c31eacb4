import hashlib

import numpy as np
import pytest

from shardloom.llm import training_order as T

RANKS = {bytes([i]): i for i in range(256)}
TEXTS = [("a", "x" * 25), ("b", ""), ("c", None), ("d", "hello"), ("d", "hello"), ("d", "other"), (None, "no id"), ("e", "y" * 3000), *((f"f{i}", f"text {i} " * (i % 7)) for i in range(60))]


def docs_of(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, 1, 2) for k, t in texts], "doc_id string, text string, slot int, part int")


def plain_feistel(x, n, key):
    half = 1
    while 4**half < n:
        half += 1

    def mix(v):
        m = 2**64 - 1
        v ^= v >> 30
        v = v * 0xBF58476D1CE4E5B9 & m
        v ^= v >> 27
        v = v * 0x94D049BB133111EB & m
        return v ^ v >> 31

    while True:
        left, right = x >> half, x & (2**half - 1)
        for r in range(6):
            f = mix((right + key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (2**64 - 1))
            left, right = right, left ^ f & (2**half - 1)
        x = left << half | right
        if x < n:
            return x


def plain_slots(texts, length, end_id, key):
    """slot -> ids, and the pieces, from the rules alone."""

    def place(k, t):
        d = hashlib.blake2b((t or "").encode(), digest_size=16).digest()
        h = hashlib.blake2b(str(k).encode() + b"|" + d, digest_size=8, key=key.to_bytes(8, "little", signed=True)).digest()
        return int.from_bytes(h, "little", signed=True), "" if k is None else k, d

    stream, starts = [], []
    for k, t in sorted(texts, key=lambda x: place(*x)):
        starts.append((k, len(stream), len((t or "").encode()) + 1))
        stream += [*(t or "").encode(), end_id]
    n = -(-len(stream) // length)
    slots = {plain_feistel(s, n, key): stream[s * length : (s + 1) * length] for s in range(n)}
    pieces = []
    for k, a, m in starts:
        chunk, x = 0, a
        while x < a + m:
            y = min(a + m, (x // length + 1) * length)
            pieces.append((plain_feistel(x // length, n, key), x % length, k, chunk, y - x))
            chunk, x = chunk + 1, y
    return slots, pieces


def test_feistel_is_a_keyed_permutation():
    for n in (1, 2, 3, 16, 17, 1000):
        a = T.feistel(np.arange(n), n, 1)
        assert sorted(a.tolist()) == list(range(n)) and a.tolist() == [plain_feistel(x, n, 1) for x in range(n)]
    assert (T.feistel(np.arange(1000), 1000, 1) != T.feistel(np.arange(1000), 1000, 2)).any()


@pytest.mark.parametrize(("parts", "shuffles", "key"), [(1, "4", 1), (3, "2", 1), (7, "9", -5)])
def test_every_slot_follows_from_rows_and_key(spark, tmp_path, parts, shuffles, key):
    path = f"file://{tmp_path}/s"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        rows = T.materialise(docs_of(spark).repartition(parts), path, RANKS, r"[\s\S]", length=8, end_id=300, shard_slots=50, key=key).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    slots, pieces = plain_slots(TEXTS, 8, 300, key)
    assert sorted(((r.slot, r.at, r.doc_id, r.chunk, r.n_tokens) for r in rows), key=repr) == sorted(pieces, key=repr)
    read = lambda a, b: {r.slot: np.frombuffer(bytes(r.ids), "<u2").tolist() for r in T.read_slots(spark, path, a, b).collect()}
    found = read(0, len(slots) + 9)
    assert found == {s: x + [300] * (8 - len(x)) for s, x in slots.items()}
    assert read(45, 60) == {s: found[s] for s in range(45, 60)} and read(len(slots), len(slots) + 5) == {}
    files = {r.shard: (r.file.removeprefix("file://"), r.bytes, r.n_slots) for r in T.manifest(spark, path).collect()}
    assert sorted(files) == list(range(-(-len(slots) // 50))) and sum(n for _, _, n in files.values()) == len(slots)
    for r in rows:
        with open(files[r.shard][0], "rb") as f:
            f.seek(r.byte_offset)
            ids = np.frombuffer(f.read(2 * r.n_tokens), "<u2").tolist()
        assert ids == found[r.slot][r.at : r.at + r.n_tokens]


def test_a_second_try_leaves_the_files_of_the_first(spark, tmp_path):
    """A task that ran before it was lost leaves a file that no manifest names."""
    path = f"file://{tmp_path}/s"
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "shard-000000000-lost.bin").write_bytes(b"half")
    rows = T.materialise(docs_of(spark), path, RANKS, r"[\s\S]", length=8, end_id=300, shard_slots=1000).collect()
    assert len({r.slot for r in rows}) == T.read_slots(spark, path, 0, 10**6).count()


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = f"file://{tmp_path}/s"
    assert T.materialise(docs, path, RANKS, r"[\s\S]", length=8, end_id=300).count() == 0 and T.read_slots(spark, path, 0, 5).count() == 0
