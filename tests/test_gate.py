import pytest
from pyspark.sql import functions as F

from shardloom.operators import gate


@pytest.fixture
def experiment(spark, tmp_path):
    rows = spark.range(60).select(
        F.col("id").alias("item"), F.sha2(F.col("id").cast("string"), 256).alias("file_sha"), F.when(F.col("id") % 3 == 0, "test").when(F.col("id") % 3 == 1, "train").otherwise("val").alias("split"), F.array(F.col("id") * 1.5).alias("v")
    )
    table, record = f"{tmp_path}/table", f"{tmp_path}/record"
    gate.write_splits(rows, "split", table)
    heads = spark.createDataFrame([("A", [0.5, 1.0])], "arm string, weights array<double>")
    inputs = {"train": gate.read_split(spark, table, "split", "train"), "manifest": rows.select("item", "file_sha", "split"), "heads": heads, "empty": rows.limit(0)}
    gate.freeze(inputs, record)
    return rows, table, record, inputs


def test_the_gate_reads_one_partition_and_only_it(spark, experiment):
    rows, table, record, inputs = experiment
    found = gate.open_held_out(spark, record, {k: v.repartition(5) for k, v in inputs.items()}, table, inputs["manifest"])
    assert sorted(r.item for r in found.collect()) == list(range(0, 60, 3))
    assert {f.rsplit("split=", 1)[1].split("/")[0] for f in found.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} == {"test"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "= test)" in plan


@pytest.mark.parametrize(("change", "message"), [
    (lambda i: i | {"heads": i["heads"].withColumn("weights", F.array(F.lit(0.5), F.lit(1.1)))}, "refused: heads: input changed"),
    (lambda i: {k: v for k, v in i.items() if k != "heads"}, "refused: heads: input missing"),
    (lambda i: i | {"extra": i["heads"]}, "refused: extra: not frozen"),
    (lambda i: i | {"train": i["train"].where("item <> 1"), "empty": i["train"]}, "refused: empty: input changed, train: input changed"),
    (lambda i: i | {"train": i["train"].withColumnRenamed("v", "w"), "manifest": i["manifest"].withColumn("split", F.lit("test"))}, "manifest: input changed"),
])
def test_changed_inputs_stop_it_by_name(spark, experiment, change, message):
    _, table, record, inputs = experiment
    with pytest.raises(ValueError, match=message):
        gate.open_held_out(spark, record, change(inputs), table, inputs["manifest"])


def test_a_modified_record_stops_it(spark, experiment, tmp_path):
    _, table, record, inputs = experiment
    spark.read.parquet(record).withColumn("sha256", F.when(F.col("name") == "heads", "0").otherwise(F.col("sha256"))).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError, match="modified after it was frozen"):
        gate.open_held_out(spark, f"{tmp_path}/other", inputs, table, inputs["manifest"])


def test_a_held_out_row_that_is_not_the_frozen_one_stops_it(spark, experiment, tmp_path):
    rows, _, record, inputs = experiment
    changed = rows.withColumn("file_sha", F.when(F.col("item") == 6, "other").otherwise(F.col("file_sha"))).where("item <> 9")
    gate.write_splits(changed.unionByName(rows.where("item = 0").withColumn("item", F.lit(99).cast("long"))), "split", f"{tmp_path}/t2")
    with pytest.raises(ValueError, match="refused: 6: changed or never frozen, 9: missing, 99: changed or never frozen"):
        gate.open_held_out(spark, record, inputs, f"{tmp_path}/t2", inputs["manifest"])


def test_rows_without_a_split_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="rows without split"):
        gate.write_splits(spark.createDataFrame([(1, None)], "item int, split string"), "split", f"{tmp_path}/t")
