"""Rows packed into blocks of bounded bytes, one block to a table row.

A block is written once and never split, so every later pass over the written table meets the same rows in the same
order, however Spark cuts its files and whatever executors come and go.  A pass that needs answers from elsewhere is joined
with them by the block's number.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from shardloom.llm import textnp as tn
from shardloom.operators.graph import shared_path

#: Text bytes of a block.  A longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: A row of the written table is a megabyte or more: small row groups keep a reader's batch small.
ROW_GROUPS = {"compression": "none", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def _bytes(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def rows_of(data: pa.Scalar) -> pa.RecordBatch:
    """The rows of a block."""
    with pa.ipc.open_stream(data.as_buffer()) as source:
        return source.read_next_batch()


def packed(source: DataFrame, text: str, measure: Callable[[pa.RecordBatch], int], limit: int = BLOCK_BYTES) -> DataFrame:
    """Rows block (a number), size (what `measure` says of the rows), data: the rows of `source` as a written table of blocks."""
    tn.ship_code(source.sparkSession)

    def task(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        total = 0

        def block():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "size": pa.array([measure(rows)], pa.int64()), "data": tn.binary([_bytes(rows)])})

        for part in tn.slices(batches, text, limit):
            n = len(tn.text_bytes(part.column(part.schema.get_field_index(text)))[0])
            if held and total + n > limit:
                yield block()
                number, held, total = number + 1, [], 0
            held.append(part)
            total += n
        if held:
            yield block()

    path = shared_path(source.sparkSession, "blocks")
    source.mapInArrow(task, "block long, size long, data binary").write.options(**ROW_GROUPS).parquet(path)
    return source.sparkSession.read.parquet(path)
