import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shardloom.llm import spelling

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def edited(r, w):
    i, c = r.randrange(len(w)), r.choice(LETTERS)
    return r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])


def vocabulary(seed, size):
    r = random.Random(seed)
    words = ["".join(r.choice(LETTERS[: r.choice((5, 26, 90))]) for _ in range(r.randint(7, 12))) for _ in range(size)]
    n = {w: r.choice((2, 5, 40, 900, 90_000)) for w in words}
    for _ in range(3 * size):
        w = r.choice(words)
        for _ in range(r.randint(1, 3)):
            w = edited(r, w)
            if len(w) >= 7:
                n.setdefault(w, r.choice((2, 3, 9, 90)))
    n |= {"a" * m: 10**m for m in range(7, 12)} | {"x" * 5000: 2, "x" * 5001: 20, "y" * 7: 20, "y" * 6 + "z": 2, "z" + "y" * 6: 20, "yyyayyy": 2}
    return n


def rows(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


def test_variants_match_brute_force(spark):
    n = vocabulary(1, 120)
    got = sorted(map(tuple, spelling.variants(rows(spark, n)).collect()))
    assert got == brute_variants(n)
    assert {r[0]: r[2] for r in got}["a" * 7] == "a" * 11


@pytest.mark.parametrize("options", [{"symbols": 2}, {"symbols": 12}, {"filter_bits": 6}])
def test_any_alphabet_and_filter_give_the_same_pairs(spark, options):
    n = vocabulary(2, 60)
    got = {(r.word, r.near) for r in spelling.near_words(rows(spark, n), **options).collect()}
    assert got == {(a, b) for a in n for b in n if one_edit(a, b)}


def test_neighbourhoods_hold_every_reduced_edit():
    r = random.Random(5)
    code = lambda w: spelling.Reduced(np.array([list(map(ord, w))], np.uint32), 5).codes()[0]
    for _ in range(200):
        w = "".join(r.choice(LETTERS) for _ in range(r.randint(2, 9)))
        codes = set(spelling.Reduced(np.array([list(map(ord, w))], np.uint32), 5).neighbourhood()[0].tolist())
        assert code(w) in codes and code(edited(r, w)) in codes


def test_words_of_whole_texts(spark):
    r = random.Random(7)
    base = ["".join(r.choice(LETTERS) for _ in range(r.randint(5, 11))) for _ in range(40)]
    docs = [(i, r.choice([" ", "-", "1", "Ā", "中"]).join(r.choice([w, w.upper(), w.title()]) for w in r.choices(base, k=30))) for i in range(60)]
    docs += [(1, docs[1][1]), (None, docs[2][1]), (61, None), (62, ""), (63, "long" * 50_000), (64, "long" * 50_000), (65, "no words 12345")]
    table = spark.createDataFrame([(i, t, "w", 3) for i, t in docs], "doc_id long, text string, word string, n int")
    want = brute_words(docs)
    assert {r.word: r.n for r in spelling.words_of(table).collect()} == want and any(len(w) > 1000 for w in want)
    assert sorted(map(tuple, spelling.group(table).collect())) == brute_variants(want)
    assert spelling.group(table.limit(0)).count() == 0
