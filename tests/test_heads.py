import random

import numpy as np
import pytest

from shardloom.operators import heads as H
from shardloom.operators import training as P

SIZE, CLASSES = 5, 3


def table(seed, slots_per_run=130, runs=((17, "A"), (17, "B"), (29, "A"))):
    r = random.Random(seed)
    rows = []
    for s, a in runs:
        for slot in range(slots_per_run):
            c = r.randrange(CLASSES)
            rows.append((s, a, slot, c, [r.gauss(1.5 * (i == c), 1) for i in range(SIZE)]))
    return rows


def slots_of(spark, rows):
    return spark.createDataFrame(rows, "seed int, arm string, slot long, cls long, vector array<double>")


def plain(rows, batch, updates, epochs):
    """The runs one by one, by loops over classes and entries."""
    out = {}
    for run in sorted({(r[0], r[1]) for r in rows}):
        own = sorted((r[2], r[3], r[4]) for r in rows if (r[0], r[1]) == run)
        w, b = H.start_weights(run[0], CLASSES, SIZE)
        p = np.concatenate((w, b[:, None]), axis=1)
        m, v = np.zeros_like(p), np.zeros_like(p)
        step, losses = 0, []
        for u in range(-(-len(own) // batch)):
            part = own[u * batch : (u + 1) * batch]
            g, loss = np.zeros_like(p), 0.0
            for _, y, x in part:
                x = np.array([*x, 1.0])
                s = p @ x
                q = np.exp(s) / np.exp(s).sum()
                loss -= np.log(q[y]) / len(part)
                for c in range(CLASSES):
                    g[c] += (q[c] - (c == y)) * x / len(part)
            losses.append(loss)
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            p = p - 1e-3 * 1e-4 * p - 1e-3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            if (u + 1) % updates == 0 or (u + 1) * batch >= len(own):
                out[(*run, u // updates + 1)] = (round(float(np.mean(losses)), 5), p.copy())
                losses = []
    return out


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_heads_match_a_plain_loop_for_any_partitioning(spark, parts):
    rows = table(1)
    random.Random(parts).shuffle(rows)
    got = H.fit_heads(slots_of(spark, rows).repartition(parts), classes=CLASSES, size=SIZE, batch=8, updates_per_epoch=5).collect()
    want = plain(rows, 8, 5, 4)
    assert {(r.seed, r.arm, r.epoch) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        loss, p = want[(r.seed, r.arm, r.epoch)]
        assert abs(r.train_loss - loss) <= 1e-5
        assert np.abs(np.array(r.weights) - p[:, :-1]).max() < 1e-12 and np.abs(np.array(r.bias) - p[:, -1]).max() < 1e-12


def test_arms_of_a_seed_start_alike_and_unusable_slots_are_left_out(spark):
    rows = [(5, arm, s, s % 3, [float(s), 1.0, 0.0, 0.0, 0.0]) for arm in "AB" for s in range(8)]
    bad = [(5, "A", 3, 1, None), (5, "A", 4, 1, [1.0]), (5, "A", 5, 9, [0.0] * 5), (5, "A", 6, 1, [float("nan")] * 5), (5, "A", 7, None, [0.0] * 5)]
    got = H.fit_heads(slots_of(spark, rows + bad), classes=CLASSES, size=SIZE, batch=4, updates_per_epoch=2).collect()
    a, b = sorted(got, key=lambda r: r.arm)
    assert a.weights == b.weights and a.train_loss == b.train_loss and a.epoch == 1
    assert H.fit_heads(slots_of(spark, []), classes=CLASSES, size=SIZE).count() == 0


def test_history_choice_and_predictions(spark, monkeypatch):
    rows = table(2)
    heads = H.fit_heads(slots_of(spark, rows), classes=CLASSES, size=SIZE, batch=8, updates_per_epoch=4)
    r = random.Random(9)
    items = [(i, c := r.randrange(CLASSES), [r.gauss(1.5 * (k == c), 1) for k in range(SIZE)], "g") for i in range(200)] + [(900, 1, None, "g"), (901, None, [0.0] * SIZE, "g")]
    validation = spark.createDataFrame(items, "item long, label long, vector array<double>, pred string")
    history = {(x.seed, x.arm, x.epoch): x for x in H.head_history(heads, validation).collect()}
    usable = [x for x in items if x[2] is not None and x[1] is not None]
    x, y = np.array([v[2] for v in usable]), np.array([v[1] for v in usable])
    best = {}
    for h in heads.collect():
        pred = (x @ np.array(h.weights).T + np.array(h.bias)).argmax(axis=1)
        f1 = [2 * ((pred == c) & (y == c)).sum() / ((pred == c).sum() + (y == c).sum()) for c in range(CLASSES)]
        recall = [((pred == c) & (y == c)).sum() / (y == c).sum() for c in range(CLASSES)]
        seen = history[(h.seed, h.arm, h.epoch)]
        assert seen.val_macro_f1 == pytest.approx(np.mean(f1)) and seen.val_balanced_accuracy == pytest.approx(np.mean(recall)) and seen.train_loss == h.train_loss
        key = (h.seed, h.arm)
        best[key] = max(best.get(key, (-1, 0)), (seen.val_macro_f1, -h.epoch))
    chosen = H.chosen_heads(heads, H.head_history(heads, validation))
    assert {(c.seed, c.arm): (c.val_macro_f1, -c.epoch) for c in chosen.collect()} == best
    whole = H.predict(chosen, validation, ["item", "label"]).collect()
    monkeypatch.setattr(H, "HEAD_BYTES", 1)
    monkeypatch.setattr(H, "SLICE_NUMBERS", 50)
    parts = H.predict(chosen, validation, ["item", "label"]).collect()
    key = lambda p: (p.seed, p.arm, p.item)
    assert sorted(map(key, whole)) == sorted(map(key, parts)) and len(whole) == 3 * 201
    for a, b in zip(sorted(whole, key=key), sorted(parts, key=key), strict=True):
        assert a.pred == b.pred and a.scores == pytest.approx(b.scores) and sum(a.scores) == pytest.approx(1)
    export = P.select_export(P.select_epoch(H.head_history(heads, validation), H.RUN, "val_macro_f1"), 17, "val_macro_f1").first()
    assert export.arm == min("AB", key=lambda a: (-best[(17, a)][0], a))


def test_history_without_validation_rows(spark):
    heads = H.fit_heads(slots_of(spark, table(3, 16)), classes=CLASSES, size=SIZE, batch=8)
    none = spark.createDataFrame([], "label long, vector array<double>")
    assert [r.val_macro_f1 for r in H.head_history(heads, none).collect()] == [None] * 3
