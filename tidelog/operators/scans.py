"""Running values in an order that no task holds whole: ranges, their summaries, and what earlier ranges carry over."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tidelog.shared import kept


def _ranged(rows: DataFrame, keys: list[str], order: list[str], ranges: int | None) -> DataFrame:
    x = rows.repartitionByRange(*([ranges] if ranges else []), *keys, *order).sortWithinPartitions(*keys, *order)
    return x.withColumn("_part", F.spark_partition_id())


def dealt(rows: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """rows dealt to tasks by ranges of (keys, order), so many if told, and sorted in each, with the range's number _part; a table, so that all readers see one deal."""
    return kept(_ranged(rows, keys, order, ranges))


def _running(keys: list[str], sums: list[str], lasts: list[str], before: list[str]):
    """Adds _goes_on, whether a row's group goes on from a row before it in the range, and the range's own running values _own_."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, carried = None, {}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            own, begins = [b.column(k) for k in keys], np.zeros(n, bool)
            for c in own:
                begins[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            begins[0] = at != tuple(c[0].as_py() for c in own)
            at = tuple(c[n - 1].as_py() for c in own)
            each = np.arange(n)
            first = np.maximum.accumulate(np.where(begins, each, -1))  # -1: the group goes on from the batch before
            out = [pa.array(~begins)]
            for c in sums:
                v = pc.fill_null(b.column(f"_in_{c}"), 0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(v)
                total = upto - np.where(first > 0, upto[np.maximum(first, 1) - 1], 0) + np.where(first < 0, carried.get(c, 0), 0)
                carried[c] = total[-1]
                out.append(pa.array(total, b.column(f"_in_{c}").type))
            for c, prior in [*((c, False) for c in lasts), *((c, True) for c in before)]:
                v = b.column(f"_in_{c}")
                place = each - 1 if prior else np.maximum.accumulate(np.where(v.is_valid().to_numpy(zero_copy_only=False), each, -1))
                none = begins if prior else place < first
                known = pa.concat_arrays([carried.get((c, prior), pa.nulls(1, v.type)), v])
                got = known.take(pa.array(place + 1, mask=none))
                out.append(got)
                carried[c, prior] = v.slice(n - 1) if prior else got.slice(n - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, "_goes_on", *(f"_own_{c}" for c in [*sums, *lasts, *before])])

    return run


def scanned(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """rows with running columns in order, for each value of keys: sums and lasts (the last value that is not null) up to and with a row, before: the value of the row before.

    A group of any size may lie over many ranges: a row for each range of such
    a group, two a range at most in all, is what the ranges tell each other.
    Keys and order are not null; order is unique within keys. Rows are dealt
    out once, and a range's own values are found before it is written.
    """
    sums, lasts, before = sums or {}, lasts or {}, before or {}
    columns = rows.columns
    for n, c in [*sums.items(), *lasts.items(), *before.items()]:
        rows = rows.withColumn(f"_in_{n}", c)
    for n in sums:
        rows = rows.withColumn(f"_in_{n}", F.col(f"_in_{n}").cast(rows.select(F.sum(f"_in_{n}")).schema[0].dataType))
    x = _ranged(rows, keys, order, ranges)
    made = [StructField("_goes_on", BooleanType()), *(StructField(f"_own_{n}", x.schema[f"_in_{n}"].dataType) for n in [*sums, *lasts, *before])]
    x = kept(x.mapInArrow(_running(keys, list(sums), list(lasts), list(before)), StructType([*x.schema.fields, *made])))
    place, of = F.struct(*order), lambda n: F.col(f"_in_{n}")
    told = [F.sum(of(n)).alias(f"_to_{n}") for n in sums]
    told += [F.max_by(of(n), F.when(of(n).isNotNull(), place)).alias(f"_to_{n}") for n in lasts]
    told += [F.max_by(F.struct(of(n)), place).alias(f"_to_{n}") for n in before]
    each = x.groupBy("_part", *keys).agg(F.lit(0).alias("_none"), *told)
    each = each.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n > 1")
    prior = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_to_{n}").over(prior).alias(f"_from_{n}") for n in sums] + [F.last(f"_to_{n}", True).over(prior).alias(f"_from_{n}") for n in [*lasts, *before]]
    x = x.join(F.broadcast(each.select("_part", *keys, *carried)), ["_part", *keys], "left")
    got = {n: F.col(f"_own_{n}") + F.coalesce(f"_from_{n}", F.lit(0)) for n in sums} | {n: F.coalesce(f"_own_{n}", f"_from_{n}") for n in lasts} | {n: F.when(F.col("_goes_on"), F.col(f"_own_{n}")).otherwise(F.col(f"_from_{n}")[f"_in_{n}"]) for n in before}
    return x.select(*[c for c in columns if c not in got], *[c.alias(n) for n, c in got.items()])


def summed(rows: DataFrame, order: list[str], size: Callable[[pa.RecordBatch], pa.Array], name: str) -> DataFrame:
    """rows with the sum of size (whole numbers) over all rows before, in order, which is unique; a range adds up its own in its task, and a row for each range tells the others."""
    x = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for b in batches:
            if b.num_rows:
                n = size(b)
                upto = pc.add(pc.cumulative_sum(n), so_far)
                so_far = upto[-1].as_py()
                yield pa.RecordBatch.from_arrays([*b.columns, pc.subtract(upto, n), upto], [*b.schema.names, "_own", "_upto"])

    x = x.mapInArrow(run, StructType([*x.schema.fields, StructField("_own", LongType()), StructField("_upto", LongType())]))
    x = kept(x)
    each = x.groupBy("_part").agg(F.max("_upto").alias("_all"))
    before = F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    x = x.join(F.broadcast(each.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))), "_part")
    return x.select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "i") -> DataFrame:
    """rows with their place from 0 among those of the same keys."""
    return scanned(rows, keys, order, sums={name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def smaller_before(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """rows with the nearest value before a row, in order within key, that is smaller than its own; null where there is none.

    A range finds most of them by itself. For the others, minima of the ranges
    of a key tell in which range to look, and there the last smaller value is
    the greatest smaller one of those that no later value of the range is
    below: a running value in order of the values.
    """
    x = rows.repartitionByRange(key, order).sortWithinPartitions(key, order).withColumn("_part", F.spark_partition_id())
    schema = StructType([*x.schema.fields, StructField(name, x.schema[value].dataType)])
    kind = to_arrow_type(x.schema[value].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []
        for b in batches:
            found = []
            for k, v in zip(b.column(key).to_pylist(), b.column(value).to_pylist()):
                if k != at:
                    at, stack = k, []
                while stack and stack[-1] >= v:
                    stack.pop()
                found.append(stack[-1] if stack else None)
                stack.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, name])

    x = kept(x.mapInArrow(run, schema))
    least = x.groupBy(key, "_part").agg(F.min(value).alias("_least")).withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n > 1")
    minima = least.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_part", "_least"))).alias("_minima"))  # two for each range at most, in all
    below = F.filter("_minima", lambda m: (m["_part"] < F.col("_part")) & (m["_least"] < F.col(value)))
    y = x.join(F.broadcast(minima), key, "left").withColumn("_there", F.when(F.col(name).isNull(), F.get(below, F.size(below) - 1)["_part"])).drop("_minima")
    asked = y.where("_there IS NOT NULL").select(key, "_there", value).distinct()
    asked = kept(asked)
    if asked.isEmpty():
        return y.select(*rows.columns, name)
    ranges = asked.select(key, F.col("_there").alias("_part")).distinct()
    later = Window.partitionBy(key, "_part").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    steps = x.join(F.broadcast(ranges), [key, "_part"], "left_semi").withColumn("_low", F.min(value).over(later)).where(F.col(value) == F.col("_low"))
    steps = steps.select(key, F.col("_part").alias("_there"), value, F.col(value).alias("_step"), F.lit(1).alias("_kind")).distinct()
    both = steps.unionByName(asked.select("*", F.lit(None).cast(x.schema[value].dataType).alias("_step"), F.lit(0).alias("_kind")))
    found = scanned(both, [key, "_there"], [value, "_kind"], lasts={"_found": F.col("_step")}).where("_kind = 0").select(key, value, "_there", "_found")
    return y.join(found, [key, value, "_there"], "left").select(*rows.columns, F.coalesce(name, "_found").alias(name))
