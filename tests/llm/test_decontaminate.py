import itertools
import random

import numpy as np

from shardloom.llm import decontaminate as D

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions at midnight"


def brute(text, item, min_overlap=13, share=0.8):
    """The best (equal words, -words, -start in the text, -start in the item) of all stretches of all diagonals, or None."""
    t, q = text.lower().split(), item.lower().split()
    best = None
    for d in range(-len(q) + 1, len(t)):
        pairs = [(i, t[i + d] == q[i]) for i in range(len(q)) if 0 <= i + d < len(t)]
        for a in range(len(pairs)):
            s = n = 0
            for _, same in pairs[a:]:
                n += 1
                s += same
                if n >= min(min_overlap, share * len(q)) - 1e-9 and s >= share * n - 1e-9 and pairs[a][1] and same:
                    found = (s, -n, -(pairs[a][0] + d), -pairs[a][0])
                    best = max(best or found, found)
    return best


def expected(docs, items):
    out = []
    for k, t in docs:
        for i, q in items:
            b = brute(t or "", q or "")
            if b:
                out.append((k, i, -b[2], -b[3], -b[1], b[0]))
    return sorted(out, key=repr)


def test_overlaps_match_brute_force(spark):
    words = ITEM.split()
    changed = [w if i not in (4, 11) else "zzz" for i, w in enumerate(words)]
    far = [w if i % 3 else "zzz" for i, w in enumerate(words)]
    docs = [(1, f"before {ITEM.upper()} after"), (2, " ".join(["pad"] * 30 + changed)), (3, " ".join(far)), (4, " ".join(words[:6])), (5, None), (6, ""), (7, "unrelated words only " * 50), (1, ITEM), (None, ITEM), (None, ITEM)]
    docs += [(8, "x " * 60), (9, "one two"), (10, "say one two three four five six now"), (11, "one two zz four five six")]
    r = random.Random(5)
    item = [f"w{i}" for i in range(140)]
    # 13 exact words and then one replaced in four; three exact runs; 12 exact words and elsewhere 11 of 13.
    docs.append((20, " ".join(w if i < 13 or i % 4 else "zz" for i, w in enumerate(item))))
    docs.append((21, " ".join(w if i % 19 < 13 else "zz" for i, w in enumerate(item[:51]))))
    docs.append((22, " ".join(w if i < 12 or 40 <= i < 53 and i not in (44, 48) else "zz" for i, w in enumerate(item[:60]))))
    for k in range(60):
        n, kept = r.randint(20, 60), r.uniform(0.5, 0.9)
        docs.append((30 + k, " ".join(["pad"] * r.randint(0, 3) + [w if r.random() < kept else "zz" for w in item[:n]])))
    items = [(10, ITEM), (11, None), (12, "one two"), (13, "one two three four five six"), (14, " ".join(item[:60])), (15, " ".join(item)), (16, "x " * 20), (17, ""), (13, "one two three four five six")]
    rows = spark.createDataFrame([(k, t, 0, 0, "a", 1) for k, t in docs], "doc_id long, text string, n_words int, doc int, seed string, c0 int")
    tests = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, name int")
    want = expected(docs, items[:-1])
    assert sorted(map(tuple, D.find(rows, tests).collect()), key=repr) == want
    met = {(k, t) for k, t in docs if any(brute(t or "", q or "") for _, q in items)}
    kept = D.drop_contaminated(rows, tests)
    assert kept.columns == rows.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted((x for x in docs if x not in met), key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.find(none, items).count() == 0 and D.drop_contaminated(spark.createDataFrame([(1, "x")], "doc_id long, text string"), items).count() == 1


def met(n, gone, masks):
    same = ~np.isin(np.arange(n), gone)
    return any(same[o : o + len(m)][[c == "1" for c in m]].all() for m in masks for o in range(n - len(m) + 1))


def test_masks_meet_every_pattern_of_replaced_words():
    for size in range(1, 13):
        for n in range(int(np.ceil(0.8 * size - 1e-9)), size + 1):
            assert all(met(n, gone, D.masks_of(size)) for gone in itertools.combinations(range(n), n // 5)), (size, n)
    for n in range(11, 21):
        assert all(met(n, gone, D.MASKS) for gone in itertools.combinations(range(n), n // 5)), n
    r = random.Random(1)
    for _ in range(3000):
        n = r.randint(21, 25)
        assert met(n, r.sample(range(n), n // 5), D.MASKS)


def test_a_word_of_every_text_and_an_item_of_one_word(spark):
    """One seed in every window and every text: all are found, and `min_words` is what keeps such items out."""
    docs = spark.createDataFrame([(i, "the " * 50 + f"end{i}") for i in range(40)] + [(99, "other words")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "the"), (2, " ".join(["the"] * 20))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find(docs, tests).collect()}
    assert got == {(i, k) for i in range(40) for k in (1, 2)}
    assert [r.doc_id for r in D.drop_contaminated(docs, tests).collect()] == [99]
    one = tests.where("item_id = 1")
    assert D.drop_contaminated(docs, one, min_words=2).count() == 41 and D.find(docs, tests, filter_bits=8).count() == 80
