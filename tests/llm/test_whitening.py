import math

import numpy as np
import pytest

from shardloom.llm import whitening


def exact(vectors):
    """ids, whole numbers, by the rules of the docstring."""
    keep = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    return [i for i, _ in keep], [x for _, x in keep]


def check(got, vectors, k=8, tolerance=1e-8):
    ids, x = exact(vectors)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[float(c - s // n) - (s % n) / n for c, s in zip(r, sums)] for r in x])
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    e, axes = s**2 / n, axes.T
    m = min(k, int((s > s[0] * 1e-9).sum()))
    want = centred @ axes[:, :m] / np.sqrt(e[:m])
    far = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    rows = {}
    for r in got:
        rows.setdefault(r.component, {}).setdefault(r[0], []).append(r)
    assert sorted(rows) == list(range(1, m + 1))
    for c in range(m):
        flat = {i: rows[c + 1][i] for i in ids}
        assert len(got) == n * m
        if len(set(ids)) == n:
            w = np.array([flat[i][0].whitened for i in ids])
            gap = min(abs(e[c] - e[j]) for j in range(len(e)) if j != c) / e[0] if len(e) > 1 else 1
            sign = np.sign(w @ want[:, c])
            if gap > 1e-6:
                assert np.abs(w - sign * want[:, c]).max() < tolerance / gap
            assert [flat[i][0].deviation for i in ids] == [f if f < 2**63 else None for f in far]
        assert all(r.n == n and abs(r.explained - e[c] / e.sum()) <= 1e-9 and r.identity_error < 1e-8 for x in flat.values() for r in x)


def frame(spark, vectors, kind="double"):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for i, v in vectors], f"vec_id long, embedding array<{kind}>, n int, component string")


def test_components_match_an_eigenvalue_solver(spark):
    r = np.random.default_rng(1)
    spread = np.linspace(0.2, 5, 20)
    mixed = r.standard_normal((20, 20))
    vectors = [(i, (r.standard_normal(20) * spread @ mixed).tolist()) for i in range(700)]
    vectors += [(900, None), (901, []), (902, [1.0] * 19 + [None]), (903, [1.0] * 19 + [float("nan")]), (904, [float("inf")] * 20)]
    check(whitening.whiten(frame(spark, vectors).repartition(5)).collect(), vectors)


def test_equal_deviations_and_flat_directions(spark):
    vectors = [(10 * i + s, [(1 - 2 * s) * (2.0 if i < 6 else 1.0) * (j == i) for j in range(9)] + [0.5, 7.0]) for i in range(9) for s in (0, 1)]
    got = whitening.whiten(frame(spark, vectors)).collect()
    assert len(got) == 18 * 8 and all(r.identity_error < 1e-9 for r in got)
    share = {r.component: r.explained for r in got}
    want = sorted([4 * 2 / 54] * 6 + [2 / 54] * 3)[::-1]
    assert [round(share[c + 1] * 54 / 54, 9) for c in range(8)] == pytest.approx(sorted([8 / (8 * 6 + 2 * 3)] * 6 + [2 / 54] * 3, reverse=True)[:8]) and want[0] == pytest.approx(share[1])


def test_few_vectors_repeated_ids_and_large_entries(spark):
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])]).limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    vectors = [(None, [1.0, 0.0, 3.0]), (7, [1.0, 0.0, 3.0]), (7, [2.0, 5.0, 1.0]), (8, [-4.0, 2.0, 2.0]), (9, [0.0, 0.0, 0.25])]
    check(whitening.whiten(frame(spark, vectors, "float"), k=2).collect(), vectors, k=2)
    far = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [3e8, -5.0])]
    check(whitening.whiten(frame(spark, far)).collect(), far, tolerance=1e-5)
    huge = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])]
    rows = whitening.whiten(frame(spark, huge)).collect()
    assert {r.vec_id for r in rows} == {1, 2, 3} and all(math.isfinite(r.whitened) for r in rows)


def test_lengths_are_fitted_apart(spark):
    r = np.random.default_rng(3)
    a = [(i, r.standard_normal(3).tolist()) for i in range(30)]
    b = [(100 + i, r.standard_normal(5).tolist()) for i in range(40)]
    got = whitening.whiten(frame(spark, a + b)).collect()
    check([x for x in got if x.vec_id < 100], a)
    check([x for x in got if x.vec_id >= 100], b)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    r = np.random.default_rng(4)
    vectors = [(i, r.standard_normal(6).tolist()) for i in range(100)]
    monkeypatch.setattr(whitening, "BLOCK_NUMBERS", 60)
    check(whitening.whiten(frame(spark, vectors).repartition(3)).collect(), vectors)


def test_factors_are_a_bidiagonalisation(spark):
    r = np.random.default_rng(5)
    x = (r.standard_normal((200, 7)) @ r.standard_normal((7, 7)) * 1000).round()
    vectors = [(i, (v / 1024).tolist()) for i, v in enumerate(x)]
    rows = whitening.Centred(whitening.blocks_of(frame(spark, vectors)), 7)
    v, b = whitening.bidiagonalise(rows)
    c = x - x.mean(axis=0)
    u = c @ v @ np.linalg.inv(b)
    assert np.abs(v.T @ v - np.eye(7)).max() < 1e-13 and np.abs(u.T @ u - np.eye(7)).max() < 1e-9
    assert np.abs(np.tril(b, -1)).max() == 0 and np.abs(np.triu(b, 2)).max() == 0
