import random


from shardloom.llm import domain_lm, langid, toxicity


def _docs(spark, n=900):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [r.choice(vocabulary) for _ in range(r.randint(5, 60))] + (["idiot"] if toxic else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), 7, "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows + [(1000, None, 1, "x"), (1001, "", 1, "x"), (1001, "", 1, "x"), (1002, "idiot " * 3000, 1, "x")], "doc_id long, text string, score int, keys string"), spark.createDataFrame(labels + [(5000, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity_learns_and_handles_odd_rows(spark):
    docs, labels = _docs(spark)
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    got = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out())
    assert got.where("toxic = 1 and score < 0.5 or toxic = 0 and score >= 0.5").count() <= 4
    odd = {r.doc_id: r.score for r in toxicity.score(docs, model).where("doc_id >= 1000").collect()}
    assert set(odd) == {1000, 1001, 1002} and odd[1000] == odd[1001] < 0.5 <= odd[1002]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id = 1002").count() == 0 and kept.where("doc_id >= 1000").count() == 3


def test_pairwise_weights_learn_a_combination(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = [f"w{r.randrange(12)}" for _ in range(3)] + ["insult"] * a + ["group"] * b
        rows.append((i, " ".join(words)))
        labels.append((i, int(a and b)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, lab, epochs=40, l1=1e-4)
    wrong = toxicity.score(docs, model).join(lab, "doc_id").where("(score >= 0.5) <> (toxic = 1)").count()
    assert wrong <= 12


def test_toxicity_without_labels_or_rows(spark):
    docs, _ = _docs(spark, 8)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert toxicity.score(docs, model).where("score >= 0.5").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def _languages(spark):
    r = random.Random(4)
    parts = {"en": ["the", "ing", "th", "ou", "ea"], "de": ["sch", "ein", "ung", "ö", "tz"], "es": ["ción", "ll", "que", "ñ", "os"]}
    rows = [(i, " ".join("".join(r.choice(parts[k]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(4, 40))), k, 1) for i, k in ((i, list(parts)[i % 3]) for i in range(300))]
    odd = [(900, None, "en", 1), (901, "", None, 1), (902, "12 34 !!", "de", 1), (903, "the ing thou", None, 1)]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int")


def test_language_identification(spark):
    docs = _languages(spark)
    model = langid.train(docs.where(~toxicity.held_out()), bits=14)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where(toxicity.held_out()).where("doc_id < 900 and lang <> lang_pred").count() <= 2
    odd = {r.doc_id: (r.lang_pred, r.score) for r in got.where("doc_id >= 900").collect()}
    assert odd[900] == odd[901] == odd[902] == ("und", 0.0) and odd[903][0] == "en"
    assert got.where("score < 0 or score > 1").count() == 0
    assert (model.weights == 0).mean() > 0.5


def test_language_identification_without_training_rows(spark):
    model = langid.train(_languages(spark).limit(0), bits=10)
    assert {r.lang_pred for r in langid.identify(_languages(spark), model).collect()} == {"und"}


def plain_losses(docs, target):
    """By dictionaries: for each row (n_tokens, target loss, background loss), its own occurrences left out of both corpora."""
    import math
    from collections import Counter

    def counts(texts):
        words, pairs = Counter(), Counter()
        for t in texts:
            w = (t or "").split()
            words.update(w)
            pairs.update(zip(w, w[1:], strict=False))
        return words, pairs

    sides = [counts([t for k, t in docs if k in target]), counts([t for k, t in docs if k not in target])]
    totals = [sum(words.values()) for words, _ in sides]
    small = min([x for x in totals if x], default=0)
    used = len(sides[0][0] | sides[1][0])
    out = []
    for k, t in docs:
        w, row = (t or "").split(), []
        own_words, own_pairs = counts([t])
        for side, (words, pairs) in enumerate(sides):
            mine = (k in target) == (side == 0)
            c = lambda table, own, x, mine=mine: table[x] - (own[x] if mine else 0)
            scale = small / totals[side] if totals[side] else 1.0
            total = 0.0
            for i, x in enumerate(w):
                p = (c(words, own_words, x) * scale + 1) / ((totals[side] - (len(w) if mine else 0)) * scale + used)
                if i and c(words, own_words, w[i - 1]) > 0:
                    before = c(words, own_words, w[i - 1])
                    p = (1 - domain_lm.MIX) * min(c(pairs, own_pairs, (w[i - 1], x)), before) / before + domain_lm.MIX * p
                total -= math.log(p)
            row.append(total / len(w) if w else None)
        out.append((k, len(w), *row))
    return out


def check_losses(spark, docs, target):
    rows = spark.createDataFrame([(k, t, 1, "s", 2) for k, t in docs], "doc_id long, text string, id int, score string, is_target int")
    got = sorted(map(tuple, domain_lm.score(rows, spark.createDataFrame([(k,) for k in target], "k long")).collect()), key=repr)
    want = sorted(plain_losses(docs, set(target) - {None}), key=repr)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for g, w in zip(got, want, strict=True):
        assert (g[2] is None) == (w[2] is None) and (w[2] is None or abs(g[2] - w[2]) < 1e-9 and abs(g[3] - w[3]) < 1e-9 and abs(g[4] - (w[2] - w[3])) < 1e-9)


def test_losses_match_a_plain_count(spark, monkeypatch):
    docs = [(1, "a b a b c"), (2, "a b d"), (3, "d d d d"), (4, None), (5, ""), (6, "a b a b c"), (None, "a d"), (7, "one"), (2, "c c a b")]
    check_losses(spark, docs, [1, 3, 4, None, 99])
    check_losses(spark, docs, [])
    r = random.Random(2)
    many = [(i, " ".join(f"w{min(r.randrange(300), r.randrange(300))}" for _ in range(r.randint(0, 60)))) for i in range(120)]
    monkeypatch.setattr(domain_lm, "BLOCK_BYTES", 1500)  # several blocks and ranges
    monkeypatch.setattr(domain_lm, "RANGE_BYTES", 2500)
    check_losses(spark, many, [i for i in range(120) if i % 3 == 0])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert domain_lm.score(empty, empty.select("doc_id")).count() == 0


def test_splits_of_the_input_between_counting_and_scoring_do_not_matter(spark, monkeypatch, tmp_path):
    r = random.Random(5)
    docs = [(i % 70, " ".join(f"w{r.randrange(80)}" for _ in range(r.randint(0, 50)))) for i in range(100)] + [(3, "w1 w2 w3")] * 40
    target = list(range(0, 70, 4))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(domain_lm, "BLOCK_BYTES", 900)
    monkeypatch.setattr(domain_lm, "RANGE_BYTES", 2500)
    plan = domain_lm.score(spark.read.parquet(f"{tmp_path}/docs"), spark.createDataFrame([(k,) for k in target], "k long"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        got = sorted(map(tuple, plan.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = sorted(plain_losses(docs, set(target)), key=repr)
    assert len(got) == len(want) and all(abs((g[4] or 0) - ((w[2] or 0) - (w[3] or 0))) < 1e-9 and g[:2] == w[:2] for g, w in zip(got, want, strict=True))


def test_default_parameters_learn_what_no_additive_model_can():
    """One of two words, but not both: additive weights get half of the rows right."""
    import numpy as np
    import pyarrow as pa

    def rows(seed):
        r = random.Random(seed)
        pairs = [(r.random() < 0.5, r.random() < 0.5) for _ in range(8000)]
        texts = [" ".join([f"w{r.randrange(12)}" for _ in range(3)] + ["insult"] * a + ["group"] * b) for a, b in pairs]
        return pa.array(texts), np.array([int(a != b) for a, b in pairs])

    model = toxicity.fit_rows(*rows(1))
    texts, labels = rows(2)
    words, h = toxicity.tn.word_hashes(texts)
    at = toxicity.tn.KeyIndex(model.keys).find(h)
    terms, first = toxicity.distinct_terms(words.rows()[at >= 0], at[at >= 0], len(texts), len(model.keys))
    alive = int((np.abs(model.v).sum(axis=1) > 0).sum())
    assert alive >= 2, f"{alive} of {len(model.v)} vectors are not 0"
    assert ((model.raw(terms, first) >= 0) == (labels == 1)).mean() > 0.95


def test_equal_probabilities_take_the_first_language_and_one_half_is_toxic(spark):
    import numpy as np

    docs = spark.createDataFrame([(1, "abc"), (2, "1 2"), (3, None), (None, "abc"), (1, "abc")], "doc_id long, text string")
    flat = langid.LangModel(["aa", "bb"], np.zeros((1 << 8, 2), np.float32), np.zeros(2), 1.0, 8, (1, 2, 3))
    got = sorted(map(tuple, langid.identify(docs, flat).collect()), key=repr)
    assert got == sorted([(1, "aa", 0.5), (1, "aa", 0.5), (None, "aa", 0.5), (2, "und", 0.0), (3, "und", 0.0)], key=repr)
    even = toxicity.FactorModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, 4)), 0.0)
    assert {r.score for r in toxicity.score(docs, even).collect()} == {0.5} and toxicity.drop_toxic(docs, even).count() == 0


def test_long_texts_in_parts_have_the_same_features(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["añb c", None, "", "xyz", "é" * 50 + "ab c" * 30 + "日本語" * 20, "ab"])

    def features():
        row, column, share = langid._features(texts, 12, langid.ORDERS)
        return sorted(zip(row.tolist(), column.tolist(), np.round(share, 12).tolist(), strict=True))

    whole = features()
    for size in (40, 7):
        monkeypatch.setattr(langid, "PART", size)
        assert features() == whole


def test_samples_are_bounded_in_bytes():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"t": ["x" * 10, "y" * 10]}), pa.RecordBatch.from_pydict({"t": ["z" * 10]})]
    count = lambda limit: sum(b.num_rows for b in toxicity.bounded(iter(batches), "t", limit))
    assert [count(n) for n in (0, 9, 10, 25, 30, 99)] == [0, 0, 1, 2, 3, 3]
