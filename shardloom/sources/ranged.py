"""Reading parts of files inside tasks: digests by streamed reads, and archive members by their byte ranges.

Paths are what Spark's file scan reports, in file systems that Arrow knows as well (file, hdfs, s3, ...).  A task holds a few megabytes of
a file, whatever its size; a file is opened only if a row asks for it.
"""

from __future__ import annotations

import hashlib
import re
import zipfile
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators.graph import written
from shardloom.operators.shipping import ship_code
from shardloom.operators.validate import archive_rules, check_archive_entries, verify_manifest

CHUNK = 8 << 20
#: Bytes of an archive that one task reads.
RANGE_BYTES = 64 << 20
_STORED, _DEFLATED = 0, 8


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and bytes of every file below root; nothing is opened.  Spark's file scan passes over empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("bytes"))


def open_file(path: str) -> pa.NativeFile:
    # The file scan reports file:/a for file:///a, and characters as they are.
    if re.match("(file:)?/", path):
        return pa_fs.LocalFileSystem().open_input_file(re.sub("^(file:)?/+", "/", path))
    fs, inner = pa_fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return fs.open_input_file(inner)


def digest_files(files: DataFrame, path: str = "path", opened: Accumulator | None = None) -> DataFrame:
    """The rows with sha256 of the file at `path`, read in chunks, so files of any size will do.  `opened`, if given, counts the files opened.

    A null path gives null; a file that can't be read stops the job with its name.
    """
    ship_code(files.sparkSession)
    names = files.columns
    at = names.index(path)

    def task(batches):
        for batch in batches:
            out = []
            for p in batch.column(at).to_pylist():
                if p is None:
                    out.append(None)
                    continue
                digest = hashlib.sha256()
                with open_file(p) as f:
                    while chunk := f.read(CHUNK):
                        digest.update(chunk)
                if opened is not None:
                    opened.add(1)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, "sha256"])

    return files.mapInArrow(task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", sha256 string")


def verify_files(manifest: DataFrame, files: DataFrame, suffixes: tuple[str, ...], opened: Accumulator | None = None) -> DataFrame:
    """path, status of every file of a manifest (path, bytes, sha256) or of `files` (path, bytes, location): the first mismatch.

    Sizes are compared first; only files that are listed with their true size are opened.
    """
    named = files.select("path", F.col("bytes").alias("_found"), "location")
    worth = manifest.select("path", "bytes").join(named, "path").where(F.col("bytes") == F.col("_found")).select("path", "location").distinct()
    found = files.select("path", "bytes").join(digest_files(worth, "location", opened).select("path", "sha256"), "path", "left")
    return verify_manifest(manifest, found, suffixes)


_ENTRY = "archive string, ord int, name string, size long, is_symlink boolean, encrypted boolean, method int, crc long, packed long, header long"


def zip_directory(spark: SparkSession, root: str, pattern: str = "*.zip") -> DataFrame:
    """archive, ord, name, size, is_symlink, encrypted, method, crc, packed, header of every member of the zip files below root.

    A task reads an archive's central directory from the end of the file and nothing else.  Directories are skipped; a file that is no zip
    gives one row with a null name.
    """
    ship_code(spark)
    names = [f.split()[0] for f in _ENTRY.split(", ")]

    def task(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                try:
                    with open_file(path) as f, zipfile.ZipFile(f) as z:
                        files = [m for m in z.infolist() if not m.is_dir()]
                    for i, m in enumerate(files):
                        link = (m.external_attr >> 16) & 0o170000 == 0o120000
                        rows.append((path, i, m.orig_filename, m.file_size, link, bool(m.flag_bits & 1), m.compress_type, m.CRC, m.compress_size, m.header_offset))
                except (zipfile.BadZipFile, pa.ArrowInvalid):  # Arrow refuses to seek before a short file
                    rows = [(path, 0, *[None] * 8)]
                for i in range(0, len(rows), 10_000):
                    part = list(zip(*rows[i : i + 10_000], strict=True))
                    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds, strict=True)], names=names)

    return listing(spark, root, pattern).select("path").mapInArrow(task, _ENTRY)


def safe_members(entries: DataFrame, *, max_entries: int, max_member: int, max_total: int, suffixes: tuple[str, ...]) -> DataFrame:
    """The members of archives in which no rule of a safe archive is broken; one broken rule refuses the whole archive.

    Nothing has been unpacked by then: the rules see names, sizes and flags alone.
    """
    limits = {"max_entries": max_entries, "max_member": max_member, "max_total": max_total, "suffixes": suffixes}
    broken = check_archive_entries(entries.where("name is not null"), **limits)
    refused = broken.select(F.regexp_replace("key", ":[0-9]+$", "").alias("archive")).unionByName(entries.where("name is null").select("archive")).distinct()
    return entries.join(refused, "archive", "left_anti")


def _unpacked(f: pa.NativeFile, row: dict) -> bytes:
    """One member's bytes: never more than its directory says, and with its check sum."""
    head = f.read_at(30, row["header"])
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member {row['name']!r} where the directory of {row['archive']} says")
    start = row["header"] + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    if row["method"] not in (_STORED, _DEFLATED):
        raise ValueError(f"{row['archive']}: {row['name']!r} is packed by method {row['method']}")
    engine, out, at, left = zlib.decompressobj(-15), bytearray(), start, row["packed"]
    while left:
        data = f.read_at(min(CHUNK, left), at)
        if not data:
            break
        at, left = at + len(data), left - len(data)
        out += data if row["method"] == _STORED else engine.decompress(data, row["size"] + 1 - len(out))
        if len(out) > row["size"]:
            break
    if len(out) != row["size"] or zlib.crc32(out) != row["crc"]:
        raise ValueError(f"{row['archive']}: {row['name']!r} differs from its directory entry")
    return bytes(out)


def read_members(entries: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The entries (from `zip_directory`) with content.

    Members are dealt out by where they stand: a task has the members of one stretch of `range_bytes` of an archive and reads only those, so
    an archive is read by as many tasks as it has stretches, and a task holds one member at a time.
    """
    ship_code(entries.sparkSession)
    names = entries.columns

    def task(batches):
        held, f = None, None
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: batch.column(j)[i].as_py() for j, n in enumerate(names)}
                    if row["archive"] != held:
                        if f is not None:
                            f.close()
                        held, f = row["archive"], open_file(row["archive"])
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([_unpacked(f, row)], pa.binary())], names=[*names, "content"])
        finally:
            if f is not None:
                f.close()

    stretch = F.floor(F.col("header") / range_bytes)
    dealt = entries.where("name is not null").repartition("archive", stretch).sortWithinPartitions("archive", "header")
    return dealt.mapInArrow(task, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema) + ", content binary")


def within_limits(entries: DataFrame, *, max_entries: int, max_member: int, max_total: int) -> DataFrame:
    """The members that may be unpacked one by one: no link, not encrypted, within the ceilings of entries, size and running total."""
    counted, _ = archive_rules(entries.where("name is not null"), max_entries=max_entries, max_member=max_member, max_total=max_total, suffixes=())
    fits = (F.col("ord") < max_entries) & (F.col("size") <= max_member) & (F.col("_total") <= max_total)
    return counted.where(~F.col("is_symlink") & ~F.col("encrypted") & fits).select(*entries.columns)


def write_zip(rows: DataFrame, archive: str, name: str, content: str, root: str) -> DataFrame:
    """Write the rows as zip files, `<archive>.zip` below root, members sorted by name; return archive, file and entries (a written table).

    An archive is one task's; its members stream to the file one by one.  A task that is tried again writes the same bytes again.
    """
    ship_code(rows.sparkSession)
    base = root.rstrip("/")

    def task(batches):
        held, z, f, n = None, None, None, 0

        def closed():
            z.close()
            f.close()
            return pa.RecordBatch.from_pydict({"archive": pa.array([held]), "file": pa.array([f"{base}/{held}.zip"]), "entries": pa.array([n], pa.int64())})

        for batch in batches:
            for a, m, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if a != held:
                    if held is not None:
                        yield closed()
                    fs, inner = (pa_fs.LocalFileSystem(), re.sub("^(file:)?/+", "/", base)) if re.match("(file:)?/", base) else pa_fs.FileSystem.from_uri(quote(base, safe=":/@"))
                    fs.create_dir(inner, recursive=True)
                    held, f, n = a, fs.open_output_stream(f"{inner}/{a}.zip"), 0
                    z = zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED)
                z.writestr(zipfile.ZipInfo(m), c.as_py(), zipfile.ZIP_DEFLATED)
                n += 1
        if held is not None:
            yield closed()

    ordered = rows.select(F.col(archive).cast("string").alias("a"), F.col(name).alias("m"), F.col(content).alias("c")).repartition("a").sortWithinPartitions("a", "m")
    return written(ordered.mapInArrow(task, "archive string, file string, entries long"), "archives")
