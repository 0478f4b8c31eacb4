"""The held-out partition behind a frozen record: no scan of it exists before every input has been verified.

A table is written partitioned by split, and a record holds the digests of everything that was decided without the held-out rows: the training and validation
partitions, the manifest, heads, choices.  Opening the held-out partition compares the record with the inputs as they are now, and each of its rows with the manifest's
digest of it; anything that is changed, missing or new stops it by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators.provenance import dataset_digest, freeze_record, verify_frozen
from shardloom.operators.validate import verify_rows

#: Names that a refusal lists at most.
LISTED = 20


def write_splits(rows: DataFrame, split: str, path: str) -> None:
    """The rows as a table partitioned by split; rows without a split have no place in it and are refused."""
    if not rows.where(F.col(split).isNull()).isEmpty():
        raise ValueError(f"rows without {split}")
    rows.write.partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, split: str, value: str) -> DataFrame:
    """The rows of one split; other partitions are not read."""
    return spark.read.parquet(path).where(F.col(split) == value)


def input_digests(inputs: dict[str, DataFrame]) -> DataFrame:
    """name, sha256, bytes (rows) of every named table, over all its columns, whatever the order or partitioning of its rows.

    Columns of lists and structs are digested as JSON.  A table without rows has a digest as well.
    """
    out = None
    for name, rows in sorted(inputs.items()):
        columns = sorted(rows.columns)
        flat = rows.select(*[F.to_json(F.struct(F.col(f"`{c}`").alias("v"))).alias(c) if rows.schema[c].dataType.simpleString().startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c in columns])
        digest = dataset_digest(flat, columns).select(F.col("digest").alias("sha256"), F.col("n").alias("bytes"))
        one = rows.sparkSession.range(1).join(digest, how="left").select(F.lit(name).alias("name"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("sha256"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))  # one row each
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("nothing to freeze")
    return out


def freeze(inputs: dict[str, DataFrame], path: str) -> None:
    """Write the frozen record of the inputs."""
    freeze_record(input_digests(inputs)).write.parquet(path)


def open_held_out(spark: SparkSession, record: str, inputs: dict[str, DataFrame], path: str, manifest: DataFrame, *, split: str = "split", value: str = "test", key: str = "item", digest: str = "file_sha") -> DataFrame:
    """The rows of the held-out split of the table at `path`, if the record and every input and row are as they were frozen; refused by name otherwise.

    `inputs` must hold the tables that the record was made of, and `manifest` (key, digest, split), which is one of them.
    """
    frozen = spark.read.parquet(record)
    wrong = verify_frozen(frozen, input_digests(inputs)).where("status <> 'ok'").orderBy("name").limit(LISTED).collect()
    if any(r.status == "record modified" for r in wrong):
        raise ValueError("the record was modified after it was frozen")
    if wrong:
        raise ValueError("refused: " + ", ".join(f"{r.name}: {r.status}" for r in wrong))
    rows, wanted = read_split(spark, path, split, value), manifest.where(F.col(split) == value)
    gone = wanted.select(key).join(rows.select(key), key, "left_anti").select(F.col(key).cast("string").alias("k"), F.lit("missing").alias("s"))
    other = verify_rows(rows, wanted, key, digest).select(F.col(key).cast("string").alias("k"), F.lit("changed or never frozen").alias("s"))
    bad = gone.unionByName(other).orderBy("k").limit(LISTED).collect()
    if bad:
        raise ValueError("refused: " + ", ".join(f"{r.k}: {r.s}" for r in bad))
    return rows
