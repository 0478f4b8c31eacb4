import random
import re

import numpy as np

from shardloom.llm import windows


def brute(docs, length=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    key = [float("inf") if i is None else i for i, _ in docs]
    first = {}
    for k, w in zip(key, words):
        for i in range(len(w) - length + 1):
            x = tuple(w[i : i + length])
            first[x] = min(first.get(x, k), k)
    out = []
    for (i, _), k, w in zip(docs, key, words):
        gone = set()
        for j in range(len(w) - length + 1):
            if first[tuple(w[j : j + length])] < k:
                gone |= set(range(j, j + length))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [some(n) for n in (12, 13, 14, 40, 60)]
    docs = []
    for i in range(90):
        w = some(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            w += r.choice(passages) + some(r.randint(0, 9))
        docs.append((r.randrange(80), r.choice([" ", "\t", " \n\x0b"]).join(w)))
    docs += [(200 + i, docs[0][1]) for i in range(30)]
    return docs + [(300, None), (301, ""), (302, " \t "), (None, docs[0][1]), (None, "a " * 40), (303, "x " * 3000), (304, "x " * 2999), (5, docs[0][1]), (305, " ".join(passages[4]).upper())]


def rows_of(spark, docs):
    return spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, n_words int, kept string")


def test_words_go_as_in_brute_force(spark):
    docs = corpus(1)
    got = windows.remove(rows_of(spark, docs)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs)


def test_small_blocks_slabs_and_ranges_give_the_same(spark):
    docs = corpus(2)
    got = windows.remove(rows_of(spark, docs).repartition(3), block_bytes=500, slab_bits=6, range_windows=100).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs)


def test_a_crowded_sketch_loses_nothing(spark, monkeypatch):
    docs = corpus(3)
    monkeypatch.setattr(windows, "LEVELS", 1)
    got = windows.remove(rows_of(spark, docs), load=0, slab_bits=4).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs)


def test_the_sketch_keeps_few_unique_windows(spark):
    import pyarrow as pa

    r = np.random.default_rng(1)
    rows = pa.RecordBatch.from_pydict({"id": pa.array([1], pa.int64()), "text": pa.array([" ".join(map(str, r.integers(0, 10**9, 50_000)))])})
    found = windows.Windows(rows, 13)
    bits = (4 * len(found.a) - 1).bit_length()
    passed = np.ones(len(found.a), bool)
    for level in range(windows.LEVELS):
        _, place, n = found.cells(level, bits)
        passed &= n[place] > 1
    assert passed.mean() < 0.06


def test_splits_of_the_input_between_passes_do_not_matter(spark):
    docs = corpus(4)
    table = rows_of(spark, docs).repartition(7)
    plan = windows.remove(table, block_bytes=300)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert sorted(map(tuple, plan.collect()), key=repr) == brute(docs)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_rows(spark):
    assert windows.remove(rows_of(spark, [(1, "a")]).limit(0)).count() == 0
    assert [tuple(r) for r in windows.remove(rows_of(spark, [(1, None)])).collect()] == [(1, 0, 0, "")]
