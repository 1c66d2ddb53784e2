"""Running sums in order over keys of any size: no window over a key, and none without one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import staged


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; nulls are alike. The first place is left out."""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    unlike = pc.fill_null(pc.not_equal(now, before), False)
    return pc.or_(unlike, pc.xor(pc.is_null(now), pc.is_null(before))).to_numpy(zero_copy_only=False)


def _within(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums up to each place since the last start; the first place is one."""
    if values.dtype != np.int64:  # floating sums of one key do not take in another's rounding
        return np.concatenate([np.cumsum(x) for x in np.split(values, starts[1:])])
    total = np.cumsum(values)
    before = np.concatenate([[0], total])[starts]
    return total - np.repeat(before, np.diff(np.append(starts, len(values))))


def _local(keys: Sequence[str], sums: Sequence[str], before: bool):
    """Sums of each key's rows so far within one range, batch after batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: list | None = None
        carried = [0] * len(sums)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            changed = np.zeros(n, bool)
            for k in keys:
                changed[1:] |= _changes(batch.column(k))
            first = [batch.column(k)[0] for k in keys]
            goes_on = last is not None and all(a.as_py() == b.as_py() for a, b in zip(first, last, strict=True))
            starts = np.append(0, np.flatnonzero(changed))
            end = starts[1] if len(starts) > 1 else n
            added = []
            for i, name in enumerate(sums):
                values = pc.fill_null(batch.column(name), 0).to_numpy(zero_copy_only=False)
                values = values.astype(np.float64 if values.dtype.kind == "f" else np.int64)
                if goes_on:
                    values[0] += carried[i]
                local = _within(values, starts)
                if before:
                    earlier = np.append(carried[i] if goes_on else 0, local[:-1]).astype(values.dtype)
                    earlier[starts[1:]] = 0
                    added.append(pa.array(earlier))
                else:
                    added.append(pa.array(local))
                carried[i] = local[-1]
            last = [batch.column(k)[n - 1] for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), *added], [*batch.schema.names, "_range", *(f"_local_{s}" for s in sums)])

    return run


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column], before: bool = False) -> DataFrame:
    """rows with, under each name of sums, the sum of its values over the key's rows up to and with this one (before: without it).

    Rows are dealt out in ranges of (keys, order), sorted and summed range by range, and written
    in that form; what a key has summed in earlier ranges is added to them. A range begins inside
    one key at most, so these offsets are no more than there are ranges, however many rows or keys
    there are: they pass through the driver and are sent to all tasks. Without keys the sums run over the whole table.
    Rows that keys and order do not tell apart lie in one range: give an order that does. Values
    are longs or doubles, null counts as 0; keys may be null and are then one key.
    """
    names = list(sums)
    values = [f"_value_{n}" for n in names]
    valued = rows.withColumns(dict(zip(values, sums.values(), strict=True)))
    sort = [*(F.col(k).asc_nulls_first() for k in keys), *order]
    kinds = [T.DoubleType() if isinstance(valued.schema[v].dataType, (T.DoubleType, T.FloatType)) else T.LongType() for v in values]
    schema = T.StructType([*valued.schema.fields, T.StructField("_range", T.IntegerType()), *(T.StructField(f"_local_{v}", k) for v, k in zip(values, kinds, strict=True))])
    dealt = valued.repartitionByRange(*sort).sortWithinPartitions(*sort)
    local = staged(dealt.mapInArrow(_local(list(keys), values, before), schema))
    split = local
    if keys:
        spans = local.groupBy(*keys).agg(F.min("_range").alias("_from"), F.max("_range").alias("_to")).filter("_from < _to").select(*[F.col(k).alias(f"_key_{k}") for k in keys])
        split = local.join(F.broadcast(spans), reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]), "left_semi")  # fewer keys than ranges
    pieces = split.groupBy("_range", *keys).agg(*[F.sum(F.coalesce(v, F.lit(0))).alias(v) for v in values]).collect()  # two for each range at most
    total: dict[tuple, list] = {}
    offsets = []
    for r in sorted(pieces, key=lambda r: r["_range"]):
        key = tuple(r[k] for k in keys)
        if key in total:
            offsets.append((r["_range"], *key, *total[key]))
        total[key] = [a + r[v] for a, v in zip(total.get(key, [0] * len(values)), values, strict=True)]
    if not offsets:
        return local.select(*rows.columns, *[F.col(f"_local_{v}").alias(n) for n, v in zip(names, values, strict=True)])
    shape = [T.StructField("_at", T.IntegerType()), *(T.StructField(f"_key_{k}", rows.schema[k].dataType) for k in keys), *(T.StructField(f"_before_{v}", k) for v, k in zip(values, kinds, strict=True))]
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys], F.col("_range") == F.col("_at"))
    out = local.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, T.StructType(shape))), on, "left")
    added = {n: F.col(f"_local_{v}") + F.coalesce(f"_before_{v}", F.lit(0)) for n, v in zip(names, values, strict=True)}
    return out.withColumns(added).select(*rows.columns, *names)
