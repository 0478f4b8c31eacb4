import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shardloom.streaming import streams as Z

DAY = dt.datetime(2026, 1, 1)


def at(day, hour=0):
    return DAY + dt.timedelta(days=day, hours=hour)


class Feed:
    """A folder that gets a file for each micro-batch, and a query that is drained after each."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")

    def drain(self, rows):
        rows.writeStream.format("parquet").option("checkpointLocation", f"{self.path}/state").outputMode("append").trigger(availableNow=True).start(f"{self.path}/out").awaitTermination()
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/out").collect()


SCHEMA = "item long, digest string, t timestamp, size int"


def eligible(feed, **options):
    return Z.stream_eligibility(feed.stream(), "item", "digest", "t", [(F.col("size") < 2, "too small")], **({"delay": "2 days", "keep": "5 days"} | options))


def test_every_row_leaves_with_a_reason_over_several_batches(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), SCHEMA)
    out = {}
    feed.put([(2, "a", at(0, 5), 9), (1, "a", at(0, 5), 9), (3, "b", at(0), 1), (4, None, at(0), 9), (5, "b", at(0, 1), 9), (6, "z", None, 9)])
    out |= {r.item: (r.status, r.reason) for r in feed.drain(eligible(feed))}
    feed.put([(7, "a", at(1), 9), (8, "c", at(10), 9)])
    out |= {r.item: (r.status, r.reason) for r in feed.drain(eligible(feed))}
    # The watermark is at day 8 now: rows of day 3 are late, whether their digest is new or known; a digest is forgotten five days after it was seen.
    feed.put([(9, "new", at(3), 9), (10, "c", at(3), 9), (11, "c", at(9), 9), (12, "a", at(9), 9), (13, "late but small", at(0), 0)])
    out |= {r.item: (r.status, r.reason) for r in feed.drain(eligible(feed))}
    feed.put([(14, "new", at(10), 9)])
    out |= {r.item: (r.status, r.reason) for r in feed.drain(eligible(feed))}
    again = "exact duplicate of an earlier candidate"
    want = {1: "", 2: again, 3: "too small", 4: "no digest", 5: "", 6: "no time", 7: again, 8: "", 9: "late", 10: "late", 11: again, 12: "", 13: "too small", 14: ""}
    assert out == {k: ("rejected" if v else "eligible", v) for k, v in want.items()}


def test_a_drained_stream_is_the_batch_rule(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, r.choice("abcdef"), at(0, r.randrange(100)), r.randrange(5)) for i in range(300)]
    feed = Feed(spark, str(tmp_path), SCHEMA)
    feed.put(rows)
    got = {x.item: x.reason for x in feed.drain(eligible(feed, delay="400 days", keep="400 days"))}
    first = {}
    for i, g, t, s in sorted(rows, key=lambda x: (x[2], x[0])):
        if s >= 2:
            first.setdefault(g, i)
    assert got == {i: "too small" if s < 2 else "" if first[g] == i else "exact duplicate of an earlier candidate" for i, g, t, s in rows}


def test_a_batch_that_stops_between_its_two_writes_counts_once(spark, tmp_path, monkeypatch):
    feed = Feed(spark, str(tmp_path), "k long, v int")
    feed.put([(i, i % 3) for i in range(30)])
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    start = lambda: Z.stream_validate(feed.stream(), F.col("v") == 0, good, bad, f"{tmp_path}/state", f"{tmp_path}/log").awaitTermination()
    (tmp_path / "bad").write_text("in the way")  # the second write of the first batch fails
    with pytest.raises(Exception):  # noqa: B017, PT011
        start()
    assert Z.committed(spark, f"{tmp_path}/log") == set()
    assert Z.read_committed(spark, good, f"{tmp_path}/log", spark.read.parquet(f"{tmp_path}/in").schema).count() == 0
    (tmp_path / "bad").unlink()
    start()
    feed.put([(i, i % 3) for i in range(30, 40)])
    start()
    # A batch that Spark replays although both writes were done is recognised by the log.
    assert Z.committed(spark, f"{tmp_path}/log") == {0, 1}
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    for crc in (tmp_path / "state" / "commits").glob(f".{last.name}.crc"):
        crc.unlink()
    start()
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    kept = {r.k for r in Z.read_committed(spark, good, f"{tmp_path}/log", schema).collect()}
    rest = [r.k for r in Z.read_committed(spark, bad, f"{tmp_path}/log", schema).collect()]
    assert kept == {i for i in range(40) if i % 3} and sorted(rest) == [i for i in range(40) if i % 3 == 0]


def test_windows_close_behind_the_watermark_and_come_once(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), "label string, t timestamp, ok boolean")
    rows = lambda: Z.stream_status(feed.stream(), "label", F.col("ok"), "t")
    feed.put([("a", at(0, 3), True), ("a", at(0, 9), False), ("b", at(1), True)])
    assert feed.drain(rows()) == []
    feed.put([("a", at(0, 23), True), ("b", at(4), True)])
    first = sorted(map(tuple, feed.drain(rows())))
    assert first == [(at(0), "a", 3, 2), (at(1), "b", 1, 1)]
    feed.put([("a", at(0, 1), True), ("b", at(9), False)])  # the first row is late: its window is closed
    assert sorted(map(tuple, feed.drain(rows()))) == [*first, (at(4), "b", 1, 1)]
