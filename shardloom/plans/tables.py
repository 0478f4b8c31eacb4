"""Bindings of the operators to the given tables, and the same bindings as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions import vectors as V
from shardloom.functions.draws import draw
from shardloom.functions.expressions import normalised_text
from shardloom.operators.grouping import hash_split

VERSION = "v1"
SHARES = {"A": 0.3, "B": 0.5, "C": 0.8}
SEEDS = [17, 29, 43]
CLASSES = 10


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as items: item, text, lang, source, label, file_sha, pixel_sha, declared."""
    label = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("normal")
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("item"), "text", "lang", "source", label.alias("label"), F.sha2(F.col("text").cast("binary"), 256).alias("file_sha"),
        F.sha2(normalised_text(F.col("text")).cast("binary"), 256).alias("pixel_sha"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("s"), F.floor(F.col("doc_id") / 7).cast("string"))).alias("declared"),
    )


def split_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with a group (equal normalised texts) and its split."""
    g = items(spark, d).withColumn("group_id", F.concat(F.lit("g_"), F.substring("pixel_sha", 1, 16)))
    return g.withColumn("split", hash_split(F.col("group_id"), VERSION))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).select("label").distinct()


def budgets(spark: SparkSession, d: str) -> DataFrame:
    return labels(spark, d).withColumn("budget", F.when(F.col("label") == "normal", 64).when(F.col("label") == "toxic", 16).otherwise(8).cast("long"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), V.doubles(F.col("embedding")).alias("v"))


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, s, x) for a, x in SHARES.items() for s in SEEDS], "arm string, seed int, share double")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """arm, seed, item, group, true, pred, scores: nearest centroid of a drawn training part, for every fifth vector."""
    v = vectors(spark, d)
    every = F.broadcast(runs(spark))  # nine rows
    train = v.where("vec_id % 5 <> 0").join(every).where(draw("train", F.col("arm"), F.col("seed"), F.col("vec_id")) < F.col("share"))
    means = V.mean_vector(train, ["arm", "seed", "label"], "v", "m").select("arm", "seed", "label", F.transform("m", lambda x: F.round(x, 9)).alias("m"))
    heads = means.groupBy("arm", "seed").agg(F.map_from_entries(F.collect_list(F.struct("label", "m"))).alias("heads"))
    score = lambda c: F.coalesce(F.round(V.dot(F.col("v"), F.try_element_at("heads", c)), 6), F.lit(-1.0))
    scored = v.where("vec_id % 5 = 0").join(F.broadcast(heads)).withColumn("scores", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(CLASSES - 1).cast("long")), score))
    return scored.select(
        "arm", "seed", F.col("vec_id").alias("item"), F.concat(F.lit("g"), F.floor(F.col("vec_id") / 15).cast("string")).alias("group"), F.col("label").alias("true"), V.argmax(F.col("scores")).alias("pred"), "scores"
    )


def classes(spark: SparkSession) -> DataFrame:
    return spark.range(CLASSES).withColumnRenamed("id", "cls")


# The same as SQL for DuckDB.

def sql_draw(key: str) -> str:
    return f"(('0x' || substr(sha256({key}), 1, 15))::BIGINT / 1152921504606846976.0)"


NORM = r"trim(regexp_replace(lower(d.text), '[ \t\r\n]+', ' ', 'g'))"
ITEMS = f"""items AS (
  SELECT d.doc_id AS item, d.text, d.lang, d.source,
    CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'low' ELSE 'normal' END AS label,
    sha256(d.text) AS file_sha, sha256({NORM}) AS pixel_sha,
    CASE WHEN d.doc_id % 5 = 0 THEN 's' || (d.doc_id // 7) END AS declared
  FROM documents d JOIN labels l USING (doc_id))"""
_U = sql_draw(f"'{VERSION}|split|' || group_id")
SPLIT = ITEMS + f""",
grouped AS (SELECT *, 'g_' || substr(pixel_sha, 1, 16) AS group_id FROM items),
split_items AS (SELECT *, CASE WHEN {_U} < 0.6 THEN 'train' WHEN {_U} < 0.8 THEN 'val' ELSE 'test' END AS split FROM grouped)"""
PREDICTIONS = f"""runs AS (SELECT * FROM (VALUES ('A', 0.3), ('B', 0.5), ('C', 0.8)) a(arm, share), (VALUES (17), (29), (43)) s(seed)),
flat AS (
  SELECT arm, seed, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings, runs WHERE vec_id % 5 <> 0 AND {sql_draw("'train|' || arm || '|' || seed || '|' || vec_id")} < share),
parts AS (SELECT arm, seed, label, i, round(avg(x), 9) AS m FROM flat GROUP BY ALL),
heads AS (SELECT arm, seed, label, list(m ORDER BY i) AS m FROM parts GROUP BY ALL),
grid AS (SELECT arm, seed, cls FROM runs, range({CLASSES}) c(cls)),
scored AS (
  SELECT g.arm, g.seed, g.cls, e.vec_id AS item, 'g' || (e.vec_id // 15) AS "group", e.label::BIGINT AS "true",
    coalesce(round(list_dot_product(e.embedding::DOUBLE[], h.m), 6), -1.0) AS score
  FROM grid g LEFT JOIN heads h ON h.arm = g.arm AND h.seed = g.seed AND h.label = g.cls JOIN embeddings e ON e.vec_id % 5 = 0),
predictions AS (
  SELECT arm, seed, item, "group", "true", first(cls ORDER BY score DESC, cls) AS pred FROM scored GROUP BY ALL)"""
CONFUSION = PREDICTIONS + f""",
cm AS (
  SELECT r.arm, r.seed, t.cls AS "true", p.cls AS pred, count(x.item) AS n
  FROM runs r, range({CLASSES}) t(cls), range({CLASSES}) p(cls)
  LEFT JOIN predictions x ON x.arm = r.arm AND x.seed = r.seed AND x."true" = t.cls AND x.pred = p.cls GROUP BY ALL),
per_class AS (
  SELECT arm, seed, cls, sum(n) FILTER (t) AS support, sum(n) FILTER (NOT t) AS predicted, coalesce(sum(n) FILTER (t AND a = b), 0) AS tp
  FROM (SELECT arm, seed, "true" AS cls, true AS t, "true" AS a, pred AS b, n FROM cm UNION ALL SELECT arm, seed, pred, false, "true", pred, n FROM cm) GROUP BY ALL),
class_metrics AS (
  SELECT *, tp / nullif(predicted, 0) AS "precision", tp / nullif(support, 0) AS recall, CASE WHEN support > 0 THEN 2 * tp / (support + predicted) END AS f1 FROM per_class),
run_metrics AS (
  SELECT arm, seed, avg(f1) AS macro_f1, avg(recall) AS balanced_accuracy, sum(tp) / sum(support) AS accuracy, sum(support) AS n, count(*) FILTER (support = 0) AS missing_classes,
    coalesce(string_agg(cls::VARCHAR, ',' ORDER BY cls::VARCHAR) FILTER (support = 0), '') AS missing
  FROM class_metrics GROUP BY ALL)"""
