import hashlib
import struct
import zipfile
import zlib

import pytest

from shardloom.sources import files as A
from shardloom.streaming import streams as Z


def png(width, height, value=None, depth=8):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes((value if value is not None else (x * 7 + y * 3) % 256) for x in range(width)) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_are_rows_even_when_broken(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(80, 70))
    (tmp_path / "b.png").write_bytes(b"no image")
    (tmp_path / "c.png").write_bytes(png(10, 10))
    got = {x.path.rsplit("/", 1)[1]: x for x in A.scan_images(spark, str(tmp_path)).collect()}
    assert {k: v.decode_ok for k, v in got.items()} == {"a.png": True, "b.png": False, "c.png": False}
    assert got["a.png"].pixel_sha256 and got["a.png"].mode == "L" and got["a.png"].width == 80
    assert A.high_bit_depth(spark, str(tmp_path)).count() == 0
    (tmp_path / "d.png").write_bytes(png(80, 70, depth=16))
    with pytest.raises(ValueError, match="more than 8 bits"):
        A.scan_images(spark, str(tmp_path))


def tiff(width, height, bits, samples=1, colour=1, floating=False, order="<"):
    """A little or big endian header with its table after the pixels."""
    data = bytes(width * height * samples * max(bits) // 8)
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, bits), (262, 3, [colour]), (277, 3, [samples]), *([(339, 3, [3])] if floating else [])]
    at = 8 + len(data)
    extra, table = b"", struct.pack(order + "H", len(tags))
    for tag, kind, values in tags:
        raw = struct.pack(order + f"{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            spot = at + 2 + 12 * len(tags) + 4 + len(extra)
            extra += raw
            raw = struct.pack(order + "I", spot)
        table += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + data + table + bytes(4) + extra


def jpeg(width, height, parts=3, bits=8):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xc4" + struct.pack(">H", 5) + bytes(3) + b"\xff\xc2" + struct.pack(">HBHHB", 8 + 3 * parts, bits, height, width, parts) + bytes(3 * parts)


def test_headers_name_size_mode_and_depth(spark, tmp_path):
    def kind(depth, colour):
        return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 300, 200, depth, colour, 0, 0, 0)

    files = {
        "p.png": (kind(8, 3), ("PNG", 300, 200, "P", 8, False)), "la.png": (kind(8, 4), ("PNG", 300, 200, "LA", 8, False)), "rgba.png": (kind(8, 6), ("PNG", 300, 200, "RGBA", 8, False)),
        "deep.png": (kind(16, 2), ("PNG", 300, 200, "RGB", 16, True)), "one.png": (kind(1, 0), ("PNG", 300, 200, "1", 1, False)),
        "l.jpg": (jpeg(640, 480, 1), ("JPEG", 640, 480, "L", 8, False)), "c.jpg": (jpeg(640, 480, 4), ("JPEG", 640, 480, "CMYK", 8, False)), "d.jpg": (jpeg(9, 8, 1, 12), ("JPEG", 9, 8, "L", 12, True)),
        "b.bmp": (b"BM" + bytes(12) + struct.pack("<IiiHH", 40, 70, -80, 1, 24), ("BMP", 70, 80, "RGB", 8, False)), "g.gif": (b"GIF89a" + struct.pack("<HH", 5, 6), ("GIF", 5, 6, "P", 8, False)),
        "a.tif": (tiff(70, 65, [8, 8, 8], 3, 2), ("TIFF", 70, 65, "RGB", 8, False)), "big.tif": (tiff(70, 65, [16], order=">"), ("TIFF", 70, 65, "L", 16, True)),
        "f.tif": (tiff(4, 4, [32], floating=True), ("TIFF", 4, 4, "L", 32, True)), "pal.tif": (tiff(4, 4, [8], colour=3), ("TIFF", 4, 4, "P", 8, False)),
        "none.txt": (b"no image at all", (None,) * 6), "cut.png": (kind(8, 2)[:20], (None,) * 6), "cut.tif": (b"II*\0\xff\xff\0\0", (None,) * 6), "cut.jpg": (b"\xff\xd8\xff", (None,) * 6),
    }
    for name, (data, _) in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in A.image_headers(spark, str(tmp_path)).collect()}
    assert {k: tuple(v[3:]) for k, v in got.items()} == {k: v for k, (_, v) in files.items()}
    assert all(got[k].file_sha256 == hashlib.sha256(d).hexdigest() and got[k].bytes == len(d) for k, (d, _) in files.items())
    assert {r.path.rsplit("/", 1)[1]: r.bit_depth for r in A.high_bit_depth(spark, str(tmp_path)).collect()} == {"deep.png": 16, "d.jpg": 12, "big.tif": 16, "f.tif": 32}
    with pytest.raises(ValueError, match="big.tif.*d.jpg.*deep.png.*f.tif"):
        A.scan_images(spark, str(tmp_path))


def test_signatures(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(80, 70))
    (tmp_path / "b.png").write_bytes(png(80, 70, 9))
    got = {x.path.rsplit("/", 1)[1]: x.signature for x in A.image_signature(spark, str(tmp_path)).collect()}
    assert len(got["a.png"]) == 1024 and abs(sum(x * x for x in got["a.png"]) - 1) < 1e-9 and not any(got["b.png"])


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/", "")
        z.writestr("d/x.txt", "hello")
    (tmp_path / "b.zip").write_bytes(b"broken")
    got = {(x.name, x.size) for x in A.scan_zip_members(spark, str(tmp_path)).collect()}
    assert got == {("d/x.txt", 5), (None, None)}
    read = lambda **limits: {x.name: x.content for x in A.scan_zip_members(spark, str(tmp_path), content=True, **limits).collect()}
    assert read()["d/x.txt"] == b"hello" and read(max_member=4)["d/x.txt"] is None and read(max_total=4)["d/x.txt"] is None and read(max_entries=0)["d/x.txt"] is None


def test_manifest_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿id , file,caption\n a ,x.jpg,\n")
    assert A.read_manifest_csv(spark, str(tmp_path / "m.csv"), ["id", "file"]).first().asDict() == {"id": "a", "file": "x.jpg", "caption": ""}
    quoted = A.read_manifest_csv(spark, _write(tmp_path, "q.csv", 'id,"file, or path"\n1,x\n'), ["id"])
    assert quoted.columns == ["id", "file, or path"] and quoted.first()[1] == "x"
    (tmp_path / "n.csv").write_text("id,id\n1,2\n")
    with pytest.raises(ValueError, match="repeated columns: id"):
        A.read_manifest_csv(spark, str(tmp_path / "n.csv"), ["id"])
    with pytest.raises(ValueError, match="missing columns: file"):
        A.read_manifest_csv(spark, _write(tmp_path, "o.csv", "id\n1\n"), ["id", "file"])


def _write(folder, name, text):
    (folder / name).write_text(text)
    return str(folder / name)


def test_snapshot_manifest(spark, tmp_path):
    path = _write(tmp_path, "s.json", '{"modelId": "m", "revision": "r",\n "staging": {"repo": "q", "revision": "s"}, "files": [{"path": "a", "bytes": 3, "sha256": "x"}, {"path": "b", "bytes": 4, "sha256": "y"}], "totalBytes": 7}')
    rows = A.read_snapshot_manifest(spark, path).collect()
    assert [(x.path, x.bytes, x.total_bytes, x.staging_repo) for x in rows] == [("a", 3, 7, "q"), ("b", 4, 7, "q")]


def test_written_tables_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("b", "spots", "train", True), ("a", "normal", "val", False)], "image_id string, label string, split string, selected boolean")
    A.write_split_manifest(rows, str(tmp_path / "m"))
    back = A.read_split_manifest(spark, str(tmp_path / "m"))
    assert [(x.image_id, x.selected) for x in back.orderBy("image_id").collect()] == [("a", False), ("b", True)]
    empty = spark.createDataFrame([], "arm string, scores array<double>")
    A.write_predictions(empty, str(tmp_path / "p"), ["x", "y"])
    assert "arm,score_x,score_y" in "".join(p.read_text() for p in (tmp_path / "p").glob("*.csv"))


def test_drained_stream_is_the_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id % 3 AS k").repartition(3).write.parquet(path)
    got = Z.drained(Z.stream_hash_split(Z.read_table(spark, path), "id", "v"))
    from pyspark.sql import functions as F

    from shardloom.operators.grouping import hash_split

    want = spark.read.parquet(path).withColumn("split", hash_split(F.col("id"), "v"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
