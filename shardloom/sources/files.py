"""Scans and sinks: files, images, archives, manifests, JSON lines and the exchange tables."""

from __future__ import annotations

import csv
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardloom.operators.shipping import ship_code
from shardloom.sources import headers, ranged

# Fixed value: the column order of a split manifest.
SPLIT_COLUMNS = ["image_id", "relpath", "product", "label", "official_split", "group_id", "split", "selected", "budget_rank", "exemplar", "exclusion_reason", "file_sha256", "pixel_sha256", "width", "height", "mode"]


def scan_files(spark: SparkSession, root: str, *, digest: bool = True, pattern: str = "*") -> DataFrame:
    """path, bytes and sha256 of every file below root; without `digest` no file is opened.  Files are read in chunks, whatever their size."""
    files = ranged.listing(spark, root, pattern)
    return ranged.digest_files(files) if digest else files


_HEADER = "format string, width int, height int, mode string, bits int, deep boolean"


def image_headers(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, bytes, file_sha256, format, width, height, mode, bits, deep of every file below root; nulls where the header is no image's.

    A file is read once, in chunks: the header from its first bytes (where a TIFF keeps its table), the digest along the way.  Nothing is decoded.
    """
    ship_code(spark)

    def task(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with ranged.open_file(path) as f:
                    found = headers.inspect(lambda at, n: f.read_at(n, at))  # noqa: B023
                    f.seek(0)
                    while chunk := f.read(ranged.CHUNK):
                        digest.update(chunk)
                rows.append((digest.hexdigest(), *(found or [None] * 6)))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["path", "bytes", "file_sha256", *(f.split()[0] for f in _HEADER.split(", "))])

    return ranged.listing(spark, root, pattern).mapInArrow(task, f"path string, bytes long, file_sha256 string, {_HEADER}")


def scan_images(spark: SparkSession, root: str, *, least: int = 64, most: int = 4096, refuse_deep: bool = True) -> DataFrame:
    """path, bytes, file_sha256, decode_ok, width, height, mode, pixel_sha256 of every file; one that is no image, or has a
    side outside the limits, is a row with decode_ok false.

    Size and mode (L, LA, P, RGB, ..) are the header's, null for files that are no image.  Images with more than 8 bits a sample are refused for the
    whole run before anything is decoded, unless `refuse_deep` is false; `high_bit_depth` lists them.
    """
    if refuse_deep:
        deep = [r.path for r in high_bit_depth(spark, root).orderBy("path").limit(5).collect()]
        if deep:
            raise ValueError(f"images with more than 8 bits a sample are not supported: {', '.join(deep)}")
    files = image_headers(spark, root)
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*").where("width > 0")
    # The image reader gives file:/// where the file reader gives file:/.
    where = lambda c: F.regexp_replace(c, "^file:/+", "/")
    shape = F.concat_ws("x", "width", "height", "nChannels")
    decoded = images.select(where("origin").alias("_path"), F.sha2(F.concat(shape.cast("binary"), F.lit(":").cast("binary"), "data"), 256).alias("_pixels"))
    fits = (F.least("width", "height") >= least) & (F.greatest("width", "height") <= most)
    ok = F.coalesce(F.col("_pixels").isNotNull() & fits, F.lit(False))
    return files.join(decoded, where("path") == F.col("_path"), "left").select("path", "bytes", "file_sha256", ok.alias("decode_ok"), "width", "height", "mode", F.when(ok, F.col("_pixels")).alias("pixel_sha256"))


def high_bit_depth(spark: SparkSession, root: str) -> DataFrame:
    """path, bit_depth of image files with more than 8 bits a sample or floating point, by their headers; only first bytes are read."""
    ship_code(spark)

    def task(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                with ranged.open_file(path) as f:
                    found = headers.inspect(lambda at, n: f.read_at(n, at))  # noqa: B023
                if found and found.deep:
                    rows.append((path, found.bits))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.int32())], names=["path", "bit_depth"])

    return ranged.listing(spark, root).mapInArrow(task, "path string, bit_depth int")


def image_signature(spark: SparkSession, root: str, side: int = 32) -> DataFrame:
    """path, signature: a side x side box thumbnail in grey, centred and of unit length; flat images give zeros."""
    import numpy as np

    from shardloom.functions.vectors import centred_unit

    images = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*").where("width > 0")

    def thumbnails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(np.float64)
                a = a.mean(axis=2) if r.nChannels == 1 else a[:, :, :3] @ np.array([0.114, 0.587, 0.299])
                rows = np.linspace(0, r.height, side + 1).astype(int)
                cols = np.linspace(0, r.width, side + 1).astype(int)
                total = np.zeros((r.height + 1, r.width + 1))
                total[1:, 1:] = a.cumsum(0).cumsum(1)
                y1, x1 = np.maximum(rows[1:], rows[:-1] + 1), np.maximum(cols[1:], cols[:-1] + 1)
                y0, x0 = y1 - np.maximum(np.diff(rows), 1), x1 - np.maximum(np.diff(cols), 1)
                box = total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]
                out.append((box / np.outer(y1 - y0, x1 - x0)).ravel())
            yield pd.DataFrame({"path": pdf["origin"], "signature": out})

    flat = images.select("origin", "width", "height", "nChannels", "data").mapInPandas(thumbnails, "path string, signature array<double>")
    return flat.withColumn("signature", centred_unit(F.col("signature")))


def scan_zip_members(spark: SparkSession, root: str, *, content: bool = False, max_entries: int = 100_000, max_member: int = 1 << 28, max_total: int = 1 << 36) -> DataFrame:
    """archive, ord, name, size, is_symlink, encrypted (and content) of every member of the zip files below root.

    Directories are skipped; a file that is no zip gives one row with a null name.  Only central directories are read for the listing, and members
    by their byte ranges.  Every member is listed; the content of one that is beyond a ceiling (entries, bytes of a member, running total), a link
    or encrypted is null and never unpacked.
    """
    names = ["archive", "ord", "name", "size", "is_symlink", "encrypted"]
    entries = ranged.zip_directory(spark, root)
    if not content:
        return entries.select(*names)
    read = ranged.read_members(ranged.within_limits(entries, max_entries=max_entries, max_member=max_member, max_total=max_total))
    return entries.select(*names).join(read.select("archive", "ord", "content"), ["archive", "ord"], "left")


def read_manifest_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV table with a header: names and cells trimmed, null cells ''.  Repeated or missing columns are refused by name."""
    head = spark.read.text(path).limit(1).collect()
    names = [n.strip() for n in next(csv.reader([head[0][0].lstrip("﻿")]))] if head else []
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"repeated columns: {', '.join(twice)}")
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=True)
    return rows.select(*[F.coalesce(F.trim(F.col(f"`{n}`")), F.lit("")).alias(n) for n in names])


def read_snapshot_manifest(spark: SparkSession, path: str) -> DataFrame:
    """modelId, revision, staging_repo, staging_revision, total_bytes, path, bytes, sha256: one row for each file of a JSON manifest."""
    schema = "modelId string, revision string, staging struct<repo:string,revision:string>, files array<struct<path:string,bytes:long,sha256:string>>, totalBytes long"
    m = spark.read.schema(schema).json(path, multiLine=True)
    return m.select(
        "modelId", "revision", F.col("staging.repo").alias("staging_repo"), F.col("staging.revision").alias("staging_revision"), F.col("totalBytes").alias("total_bytes"), F.explode("files").alias("f")
    ).select("*", "f.*").drop("f")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line, blank lines skipped."""
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object a line, keys sorted."""
    rows.select(*sorted(rows.columns)).write.json(path)


def write_split_manifest(rows: DataFrame, path: str) -> DataFrame:
    """Write the manifest columns in their order, sorted by image_id, booleans as 0 and 1; return its digest (n, digest)."""
    from shardloom.operators.provenance import dataset_digest

    flag = lambda c: F.col(c).cast("int").cast("string") if c in ("selected", "exemplar") else F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = rows.select(*[(flag(c) if c in rows.columns else F.lit("")).alias(c) for c in SPLIT_COLUMNS])
    out.orderBy("image_id").write.csv(path, header=True)
    return dataset_digest(out, SPLIT_COLUMNS)


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The written manifest with typed columns."""
    kinds = {"selected": "int", "exemplar": "int", "budget_rank": "int", "width": "int", "height": "int"}
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} {kinds.get(c, 'string')}" for c in SPLIT_COLUMNS))
    return rows.withColumns({c: F.col(c) == 1 for c in ("selected", "exemplar")})


def score_columns(rows: DataFrame, classes: list[str], scores: str = "scores") -> DataFrame:
    """The rows with one column score_<class> for each class in place of the array."""
    rest = [c for c in rows.columns if c != scores]
    return rows.select(*rest, *[F.col(scores)[i].alias(f"score_{c}") for i, c in enumerate(classes)])


def write_predictions(rows: DataFrame, path: str, classes: list[str]) -> None:
    """A CSV with identifiers, then the scores in class order; no rows still give a header."""
    score_columns(rows, classes).coalesce(1).write.csv(path, header=True) if rows.isEmpty() else score_columns(rows, classes).write.csv(path, header=True)


def caption_rows(rows: DataFrame) -> DataFrame:
    """id, file, caption, label, observer, inat_observation_url; file is <photo id>.jpg, else <id>.jpg; missing text is ''."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    photo = F.col("inat_photo_id").cast("string") if "inat_photo_id" in rows.columns else F.lit(None).cast("string")
    return rows.select("id", F.concat(F.coalesce(photo, F.col("id").cast("string")), F.lit(".jpg")).alias("file"), *[text(c).alias(c) for c in ("caption", "label", "observer", "inat_observation_url")])


def write_captions_csv(rows: DataFrame, path: str) -> None:
    caption_rows(rows).write.csv(path, header=True)
