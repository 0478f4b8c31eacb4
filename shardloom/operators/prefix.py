"""Running sums along any order, without a window that holds a whole class.

Rows are sorted in ranges over (class, order), cut by Spark's sample, so a large class is many ranges.  Inside a range the sums run along the rows as a stream; what earlier
ranges of the same class hold is carried in: only the first class of a range can have a carry, so there are at most as many as ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shardloom.operators.graph import written


def running_sums(rows: DataFrame, by: list[str], order: list[str | Column], values: dict[str, str], range_rows: int | None = None) -> DataFrame:
    """The rows with a column for each of `values` (new name -> numeric column): the sum over the rows of the same `by` before it in `order`.

    Rows equal in `by` and `order` stand in one range, in any order; add up ties first where they are many.  Nulls count as 0.
    With `range_rows` there are as many ranges as it takes for so many rows each, whatever the number of shuffle partitions, so a task's sort does not grow with the rows.
    """
    kept = rows.columns
    flags = [F.col(c).asc() if isinstance(c, str) else c for c in order]
    kinds = {n: "double" if rows.schema[c].dataType.simpleString() in ("double", "float") else "long" for n, c in values.items()}
    # A 128-bit name of the class tells a stream where a new one begins.
    named = rows.withColumn("_class", F.concat_ws(",", *[F.xxhash64(F.lit(s), *by).cast("string") for s in (0, 1)]) if by else F.lit(""))

    def task(batches):
        from pyspark import TaskContext

        span, held, carry = TaskContext.get().partitionId(), None, {n: 0 for n in values}
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(len(kept)).dictionary_encode()
            code = names.indices.to_numpy()
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            ends = [*first[1:].tolist(), len(code)]
            out = []
            for n, c in values.items():
                x = batch.column(kept.index(c)).cast(pa.float64() if kinds[n] == "double" else pa.int64()).fill_null(0).to_numpy()
                total = np.cumsum(x)
                before = total - x
                base = before[first].copy()
                if names.dictionary[int(code[0])].as_py() == held:
                    base[0] -= carry[n]
                before -= np.repeat(base, np.diff([*first, len(code)]))
                carry[n] = before[-1] + x[-1]
                out.append(pa.array(before))
            held = names.dictionary[int(code[ends[-1] - 1])].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(code), span, np.int32)), *out], names=[*kept, "_class", "_span", *values])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    schema = f"{columns}, _class string, _span int, " + ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    ranges = [max(1, -(-rows.count() // range_rows))] if range_rows else []
    ordered = named.repartitionByRange(*ranges, *by, "_class", *flags).sortWithinPartitions(*by, "_class", *flags).select(*kept, "_class")
    spans = written(ordered.mapInArrow(task, schema), "spans")
    totals = spans.groupBy("_class", "_span").agg(*[F.sum(c).alias(n) for n, c in values.items()])
    earlier = Window.partitionBy("_class").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a class
    carried = totals.select("_class", "_span", F.count(F.lit(1)).over(earlier).alias("_k"), *[F.sum(n).over(earlier).alias(f"_{n}") for n in values]).where("_k > 0").drop("_k")
    return spans.join(F.broadcast(carried), ["_class", "_span"], "left").select(*kept, *[(F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0))).alias(n) for n in values])
