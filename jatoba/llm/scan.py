"""Distributed prefix sums: the running totals of a globally sorted table, without sorting it in one task.

The rows are dealt to ranges of the order and sorted there; each range adds up its own rows as it streams them
to the shared folder.  The totals of ranges (one row each, as many as there were partitions) give every range what
the ranges before it hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import stash

_ADDED = ("__range", "__at")


def scan(df: DataFrame, order: Sequence[str | Column], sums: Sequence[str] = (), xors: Sequence[str] = ()) -> DataFrame:
    """``df`` with position (from 0 in ``order``) and, for each named bigint column c, c_upto: its sum, or exclusive or,
    over all rows up to and with this one.  The order has to be total for the result to be the same each time; rows
    that tie in it are in any order.  The result rests on a stashed table (``_stash``)."""
    spark = df.sparkSession
    names = [*sums, *xors]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in (*_ADDED, *(f"{c}_upto" for c in names)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = TaskContext.get().partitionId(), 0
        total = {c: np.int64(0) for c in names}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [*batch.columns, pa.array(np.full(n, own)), pa.array(np.arange(at, at + n))]
            at += n
            for c in names:
                v = batch.column(batch.schema.get_field_index(c)).to_numpy()
                v = np.cumsum(v) + total[c] if c in sums else np.bitwise_xor.accumulate(v) ^ total[c]
                total[c] = v[-1]
                cols.append(pa.array(v))
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    dealt = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    added = [F.sum(c).alias(c) for c in sums] + [F.bit_xor(F.col(c)).alias(c) for c in xors]
    rows = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), *added).collect()
    before, held = [0] * (1 + len(names)), []
    for r in sorted(rows, key=lambda r: r["__range"]):
        held.append((r["__range"], *before))
        before[0] += r["__n"]
        for k, c in enumerate(names, 1):
            before[k] = before[k] + r[c] if c in sums else before[k] ^ r[c]
    ranges = spark.createDataFrame(held, "__range bigint, __n bigint" + "".join(f", `__b{k}` bigint" for k in range(len(names))))
    upto = [(F.col(f"{c}_upto") + F.col(f"__b{k}") if c in sums else F.col(f"{c}_upto").bitwiseXOR(F.col(f"__b{k}"))).alias(f"{c}_upto") for k, c in enumerate(names)]
    out = dealt.join(F.broadcast(ranges), "__range").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__at") + F.col("__n")).alias("position"), *upto)
    out._stash = dealt._stash
    return out


def folded(rows: DataFrame, combine: np.ufunc, kind: str) -> DataFrame:
    """(part int, v binary) with one row a part: arrays of ``kind`` of one length, put together by ``combine``.

    Tasks send a row a part each, so these are put together in two steps, 64 groups a part first, and each step streams its rows
    into one array a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(v.as_buffer(), kind)
                if part in held:
                    combine(held[part], x, out=held[part])
                else:
                    held[part] = x.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "v"])

    schema = "part int, v binary"
    first = rows.select("part", "v", (F.spark_partition_id() % 64).alias("slot")).repartition("part", "slot").select("part", "v").mapInArrow(run, schema)
    return first.repartition("part").mapInArrow(run, schema)
