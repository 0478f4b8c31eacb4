import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from shardloom.llm import balltree, graph, induced, jaccard, repeats


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if b < a and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def family(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdef") for _ in range(3)) for _ in range(60)]
    base = [[r.choice(words) for _ in range(r.randint(1, 80))] for _ in range(15)]
    docs = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        docs.append((i, " ".join(w) if r.random() < 0.7 else "\t".join(w).upper()))
    return docs + [(1000, None), (1001, ""), (1002, "  "), (1003, "a b"), (1004, "A  B\n"), (1005, "x " * 3000), (1006, "x " * 3100)]


def test_jaccard_components_match_brute_force(spark):
    docs = family(220, 2)
    want = brute_components(docs)
    rows = spark.createDataFrame([(k, t, 1, "c") for k, t in docs], "doc_id long, text string, n int, component string")
    for options in ({}, {"short_list": 2, "block_sets": 5}):
        assert sorted(map(tuple, jaccard.join(rows, **options).collect())) == want
    kept = jaccard.drop_near_copies(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in want if i == c)


def test_jaccard_of_null_ids_repeated_rows_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "A b c d e")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(rows).collect()), key=repr) == [(2, 1, 2), (3, 1, 2), (3, 1, 2), (None, 1, None)]
    assert jaccard.join(rows.limit(0)).count() == 0


def test_texts_of_repetitive_words_are_told_apart(spark):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(rows).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_a_family_of_long_near_copies_is_compared_once_for_each_set(spark, monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    base = [r.choice(words) for _ in range(500)]
    docs = []
    for i in range(40):
        w = list(base)
        for _ in range(6):
            w[r.randrange(len(w))] = f"new{r.randrange(9999)}"
        docs.append((i, " ".join(w)))
    docs.append((40, " ".join(base[:250] + [r.choice(words) for _ in range(250)])))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    written_rows, real = {}, jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: written_rows.setdefault(name, real(df, name)))
    assert sorted(map(tuple, jaccard.join(rows, short_list=8).collect())) == brute_components(docs)
    assert written_rows["pairs"].count() < 4 * len(docs)  # of 780 pairs, each sharing hundreds of shingles


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in graph.components(links).collect()} == {0}


def windows(texts, length=repeats.LENGTH):
    """The contract by a dictionary of all windows: (n_bytes, n_removed, n_spans, sha256 of what is left)."""
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(t) else 0
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def test_repeats_match_brute_force(spark, monkeypatch):
    r = random.Random(5)
    words = ["the ", "a", "é", "b", "zz ", "\n"]
    base = ["".join(r.choice(words) for _ in range(r.randint(0, 300))) for _ in range(8)]
    docs = [(i, "".join(r.choice(base)[r.randint(0, 40) : r.randint(60, 400)] + "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 4)))) for i in range(40)]
    docs += [(100, None), (101, "x" * 500), (102, "ab" * 300), (5, docs[5][1]), (103, ""), (None, docs[7][1]), (None, docs[7][1])]
    rows = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, row_key int, runs int")
    want = sorted(((k, *w) for (k, _), w in zip(docs, windows([(t or "").encode() for _, t in docs]), strict=True)), key=repr)
    for options, cut in (({}, repeats.SLICE), ({"shard_contexts": 1}, 700)):
        monkeypatch.setattr(repeats, "SLICE", cut)  # texts over SLICE bytes are taken in parts
        got = repeats.remove(rows, **options).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)")
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert repeats.remove(rows.limit(0)).count() == 0


def test_one_passage_in_very_many_texts_is_split_into_sub_shards(spark):
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    shared = noise(330)
    docs = [(i, noise(r.randint(0, 250)) + shared[r.randint(0, 40) : r.randint(290, 330)] + noise(r.randint(0, 250))) for i in range(60)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    want = [(k, *w) for (k, _), w in zip(docs, windows([t.encode() for _, t in docs]), strict=True)]
    got = repeats.remove(rows, shard_contexts=4).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)")
    assert sorted(map(tuple, got.collect())) == want


def test_runs_of_a_copied_text_are_one(spark):
    """A copy is some 60 contexts, but one run; runs that only come near each other stay two."""
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    text, a, b = noise(5000), noise(260), noise(230)
    docs = [(1, text), (2, "-" + text), (3, a + "!" + b), (4, a), (5, b), (6, noise(900))]
    got = repeats.find(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted([tuple(x) for x in row.runs] for row in got.collect()) == sorted([[(0, 4800)], [(1, 4801)], [(0, 60), (261, 291)], [(0, 60)], [(0, 30)]])


def test_few_keys_pass_a_filter_that_does_not_hold_them(spark):
    keys = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    sent = repeats.filter_of(keys, "h", 21)
    own, other = (np.array([x.h for x in spark.range(a, a + 20_000).select(F.xxhash64("id").alias("h")).collect()], np.int64).view(np.uint64) for a in (0, 200_000))
    assert repeats.passes(sent, own).all() and repeats.passes(sent, other).mean() < 0.04  # one bit a key: 0.09


def test_suffix_arrays_and_repeated_prefixes():
    for seed in range(3):
        r = random.Random(seed)
        texts = [[r.choice([1, 2, 3][: r.randint(1, 3)]) for _ in range(r.randint(1, 40))] + [0] for _ in range(80)]
        t = np.zeros((max(map(len, texts)), 80), np.uint16)
        for i, s in enumerate(texts):
            t[: len(s), i] = s
        size = np.array(list(map(len, texts)))
        sa = induced.suffix_arrays(t, size, 4)
        for length in (1, 3):
            again = induced.repeated(t, size, sa, length)
            for i, s in enumerate(texts):
                assert (sa[: len(s), i] // 80).tolist() == sorted(range(len(s)), key=lambda p, s=s: s[p:])
                spans = [tuple(s[p : p + length]) for p in range(len(s))]
                assert all(again[p, i] == (spans.count(spans[p]) > 1) for p in range(len(s) - length))


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 6))
    v[5] = v[6] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(k, x, 1, 2) for k, x in rows], "vec_id long, embedding array<double>, rank int, block int")
    q = np.floor(64 * v)
    want = []
    for i in range(0, 300, 20):
        s = sorted(((-int(q[i] @ q[j]), j) for j in range(300) if j != i))[:20]
        want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    for options in ({}, {"block_rows": 4, "shard_rows": 50, "sample_rows": 30}):
        got = balltree.top_k(df, df.where("vec_id % 20 = 0"), 20, **options)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    twice = balltree.top_k(df.where("vec_id in (5, 6, 8)").unionByName(df.where("vec_id in (6, 8)")), df.where("vec_id = 5").unionByName(df.where("vec_id = 5")), 20).collect()
    assert sorted(r.vec_id for r in twice) == [6, 6, 8, 8]
    few = balltree.top_k(df.where("vec_id < 3"), df.where("vec_id < 3"), 20).collect()
    assert len(few) == 6 and balltree.top_k(df.limit(0), df, 20).count() == 0


def test_search_skips_what_its_bounds_exclude():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 24)) * 400
    x = np.floor(centres[rng.integers(0, 16, 8000)] + rng.normal(size=(8000, 24)) * 20)
    ids, q = np.arange(8000), x[:100]
    top = balltree.TopK(100, 10, np.full(100, -np.inf))
    done = balltree.search(balltree.BallTree(x), ids, q, ids[:100], top)
    want = q @ x.T
    want[np.arange(100), np.arange(100)] = -np.inf
    assert (top.score == np.sort(want, axis=1)[:, ::-1][:, :10]).all()
    assert done < 100 * 8000 / 4


def test_group_bound_is_never_above_what_a_linked_set_shares(spark):
    rows = []
    for n in range(1, 70):
        for y in range(1, 90):
            if 100 * min(n, y) >= 80 * max(n, y):
                rest = max(n - jaccard.prefix_size(n), y - jaccard.prefix_size(y))
                need = -(-80 * (n + y) // 180) - rest
                rows += [(n, lo, hi, need) for lo, hi in ((y, y), (max(1, y - 9), y), (y, y + 9), (1, 200))]
    table = spark.createDataFrame(rows, "n long, lo long, hi long, need long")
    assert table.where(jaccard.least_bound(table.n, table.lo, table.hi) > table.need).count() == 0
