"""The pipeline on a small table against what each stage has to do, step by step in plain Python."""

import random

import corpus_pipeline
from shardloom.llm import pieces


def test_pipeline(spark, tmp_path):
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    item = " ".join(r.choice(words) for _ in range(20))
    rows, labels = [], []
    for i in range(600):
        text = " ".join(r.choice(words) for _ in range(r.randint(20, 50)))
        toxic = i % 3 == 0
        rows.append((i, text + (" idiot" if toxic else ""), "en", "s", 1))
        labels.append((i, 0, int(toxic)))
    clean = [x[0] for x in rows if x[0] % 3]
    copy_of = clean[5]
    base = dict((x[0], x[1]) for x in rows)
    rows += [(1000, base[copy_of].upper(), "en", "s", 1), (1001, f"before {item} after", "en", "s", 1), (1002, "call me on 555-123-4567 or a.b@c.org", "en", "s", 1), (1003, None, None, None, None), (1004, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
        kept[name] = docs.collect()
    ids = {name: {x.doc_id for x in found} for name, found in kept.items()}
    flagged = set(base) - ids["toxicity"]
    assert len(flagged ^ {i for i in base if i % 3 == 0}) <= 6
    assert ids["toxicity"] - ids["near_copies"] == ({1000} if copy_of in ids["toxicity"] else set())
    assert ids["near_copies"] - ids["decontamination"] == {1001}
    assert {1003, 1004} <= ids["pii"] == ids["decontamination"]
    text = {x.doc_id: (x.text, x.n_chars) for x in kept["pii"]}
    assert text[1002] == ("call me on [PHONE] or [EMAIL]", 29) and text[clean[9]][0] == base[clean[9]]
    vocabulary = pieces.load(corpus_pipeline.PIECES)
    back = {x.doc_id: x.text for x in pieces.decode(spark.createDataFrame(kept["pieces"], "doc_id long, part long, ids array<int>, row long"), vocabulary).collect()}
    assert all(back[k] == (t or "") for k, (t, _) in text.items())


def test_pipeline_of_repeated_rows_clashing_columns_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, doc string, c0 string, part int, row int, n long, key string"
    rest = (0.5, 7, "d", "c", 1, 2, 3, "k")
    rows = [(1, "one two three four five six", "en", "s", 1, *rest)] * 3 + [(None, "one two three four five six", None, None, None, *rest), (2, "One two three four five six", "en", "s", 1, *rest), (3, None, "en", "s", 1, *rest)]
    for name, documents in (("full", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(documents, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 0)] if documents else [], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for name_of, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(stage(spark, docs, d), name_of)
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        assert sorted((x.doc_id for x in docs.collect()), key=str) == ([1, 1, 1, 3, None] if documents else [])
        assert corpus_pipeline.run(spark, d).count() == (5 if documents else 0)
