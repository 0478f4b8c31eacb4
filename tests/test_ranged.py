import hashlib
import io
import struct
import zipfile

import pytest

from shardloom.operators import validate as R
from shardloom.sources import files as A
from shardloom.sources import ranged

LIMITS = {"max_entries": 5, "max_member": 1000, "max_total": 2500, "suffixes": (".txt",)}


def test_a_file_over_two_gigabytes_is_digested(spark, tmp_path):
    size = (2 << 30) + (100 << 20)
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)
    digest = hashlib.sha256()
    zeros = bytes(1 << 20)
    for _ in range(size >> 20):
        digest.update(zeros)
    assert [(r.bytes, r.sha256) for r in A.scan_files(spark, str(tmp_path)).collect()] == [(size, digest.hexdigest())]


def test_only_files_of_the_right_size_are_opened(spark, tmp_path):
    for name, text in {"a": "same", "b b%20": "other", "c": "longer text", "d": "unlisted"}.items():
        (tmp_path / f"{name}.txt").write_text(text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [("a.txt", 4, sha("same")), ("b b%20.txt", 5, sha("changed")), ("c.txt", 4, sha("long")), ("gone.txt", 1, sha("x"))]
    manifest = spark.createDataFrame(rows, "path string, bytes long, sha256 string")
    files = ranged.listing(spark, str(tmp_path)).selectExpr("substring_index(path, '/', -1) AS path", "bytes", "path AS location")
    opened = spark.sparkContext.accumulator(0)
    got = {r.path: r.status for r in ranged.verify_files(manifest, files, (".txt",), opened).collect()}
    assert got == {"a.txt": "ok", "b b%20.txt": "digest differs", "c.txt": "size differs", "gone.txt": "missing", "d.txt": "not listed"}
    assert opened.value == 2


def archive(path, members, **options):
    with zipfile.ZipFile(path, "w", options.get("method", zipfile.ZIP_DEFLATED)) as z:
        for name, data in members:
            z.writestr(name, data)


def test_members_are_read_by_stretches_of_an_archive(spark, tmp_path):
    data = {f"m{i:02d}.txt": bytes((i * j) % 251 for j in range(3000 + i)) for i in range(30)}
    archive(tmp_path / "a.zip", data.items(), method=zipfile.ZIP_STORED)
    archive(tmp_path / "b.zip", data.items())
    entries = ranged.zip_directory(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        read = ranged.read_members(entries, range_bytes=10_000)
        places = read.selectExpr("archive", "spark_partition_id() AS p").where("archive LIKE '%a.zip'").distinct().count()
        got = {(r.archive[-5:], r.name): bytes(r.content) for r in read.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(z, n): d for z in ("a.zip", "b.zip") for n, d in data.items()} and places > 1


@pytest.mark.parametrize(("members", "rule"), [
    ([("../x.txt", "a")], "traversal"), ([("/x.txt", "a")], "absolute"), ([("C:x.txt", "a")], "absolute"), ([("a\\b.txt", "a")], "absolute"),
    ([("x.exe", "a")], "suffix"), ([("a.txt", "b" * 1001)], "member_size"), ([(f"{i}.txt", "b" * 900) for i in range(3)], "total_size"), ([(f"{i}.txt", "b") for i in range(6)], "entries"),
])
def test_an_unsafe_archive_is_refused_before_anything_is_unpacked(spark, tmp_path, members, rule):
    archive(tmp_path / "bad.zip", members)
    archive(tmp_path / "good.zip", [("d/", ""), ("d/x.txt", "hello")])
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    entries = ranged.zip_directory(spark, str(tmp_path))
    assert rule in {r.rule for r in R.check_archive_entries(entries.where("name is not null"), **LIMITS).collect()}
    assert [(r.name, bytes(r.content)) for r in ranged.read_members(ranged.safe_members(entries, **LIMITS)).collect()] == [("d/x.txt", b"hello")]


def test_links_and_locked_members_are_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "link.zip", "w") as z:
        link = zipfile.ZipInfo("l.txt")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "target")
    data = io.BytesIO()
    archive(data, [("x.txt", "secret")])
    raw = bytearray(data.getvalue())
    for at in (raw.find(b"PK\x03\x04") + 6, raw.find(b"PK\x01\x02") + 8):
        raw[at] |= 1
    (tmp_path / "locked.zip").write_bytes(raw)
    entries = ranged.zip_directory(spark, str(tmp_path))
    assert {r.rule for r in R.check_archive_entries(entries, **LIMITS).collect()} == {"symlink", "encrypted"}
    assert ranged.safe_members(entries, **LIMITS).count() == 0
    assert all(r.content is None for r in A.scan_zip_members(spark, str(tmp_path), content=True).collect())


def test_a_member_that_lies_about_its_size_is_refused(spark, tmp_path):
    data = io.BytesIO()
    archive(data, [("x.txt", "a" * 900)])
    raw = bytearray(data.getvalue())
    at = raw.find(b"PK\x01\x02") + 24
    raw[at : at + 4] = struct.pack("<I", 10)
    (tmp_path / "lie.zip").write_bytes(raw)
    entries = ranged.safe_members(ranged.zip_directory(spark, str(tmp_path)), **LIMITS)
    assert entries.count() == 1
    with pytest.raises(Exception, match="differs from its directory entry"):
        ranged.read_members(entries).collect()


def test_written_archives_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, f"{k}.txt", bytes([k]) * k) for k in range(40)], "a int, n string, c binary")
    made = {r.archive: r.entries for r in ranged.write_zip(rows, "a", "n", "c", f"file://{tmp_path}/z").collect()}
    assert made == {"0": 14, "1": 13, "2": 13}
    got = {(r.archive[-5], r.name): bytes(r.content) for r in ranged.read_members(ranged.zip_directory(spark, f"{tmp_path}/z")).collect()}
    assert got == {(str(k % 3), f"{k}.txt"): bytes([k]) * k for k in range(40)}


def test_artifact_without_classes(spark):
    files = spark.createDataFrame([("a", 1, "x")], "path string, bytes long, sha256 string")
    none = spark.createDataFrame([], "class string, class_index int")
    assert [tuple(r) for r in R.check_artifact(files, files, none).collect()] == [("class", "", "no classes")]


def test_copies_of_frequent_and_blank_ids(spark):
    ids = ["hot"] * 500 + [""] * 300 + [None] * 20 + ["two"] * 2 + ["one"]
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, k int").repartition(7)
    got = R.with_copies(rows, "id").collect()
    assert len(got) == len(ids) and all(r._copies == ids.count(r.id) for r in got) and sorted(r.k for r in got) == list(range(len(ids)))
