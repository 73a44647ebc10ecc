"""Two helpers that keep a hot key out of one task: running values along sorted rows, and look-ups by hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import shuffle_partitions, stored


def running(df: DataFrame, key: str, order: list, xors: list[str], sums: list[str], tag: str) -> DataFrame:
    """``df`` (rows with a long ``key``) with ``at`` (how many rows of the key come before, by ``order``) and, for
    each long column of ``xors`` and ``sums``, ``c_to``: the exclusive-or or sum up to and with the row.

    Rows are dealt by ranges of (key, order), so a key of any size lies in as many tasks as it
    needs; what its earlier tasks hold comes as one row a task, which is broadcast.
    """
    spark = df.sparkSession
    names = [*xors, *sums]
    dealt = df.repartitionByRange(shuffle_partitions(spark), F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", _part int, _at long" + "".join(f", `_{n}` long" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, np.zeros(1 + len(names), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            fresh = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.concatenate((fresh, [len(keys)])))
            first = np.repeat(fresh, sizes)
            goes_on = sizes[0] if keys[0] == last else 0
            out = [np.arange(len(keys)) - first]
            for n in names:
                x = batch.column(batch.schema.get_field_index(n)).to_numpy()
                step = np.bitwise_xor if n in xors else np.add
                total = step.accumulate(x)
                before = np.concatenate(([0], total))[first]
                out.append(total ^ before if n in xors else total - before)
            for i, x in enumerate(out):
                x[:goes_on] = x[:goes_on] ^ held[i] if i and names[i - 1] in xors else x[:goes_on] + held[i]
            last, held = keys[-1], np.array([out[0][-1] + 1, *[x[-1] for x in out[1:]]])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), part, np.int32)), *map(pa.array, out)],
                names=[*batch.schema.names, "_part", "_at", *[f"_{n}" for n in names]],
            )

    local = stored(dealt.mapInArrow(run, made), tag)
    # What each task has of its last key; a key that goes on has the rows of all tasks between as well.
    ends = local.groupBy("_part").agg(F.max_by(F.struct(key, "_at", *[f"_{n}" for n in names]), F.struct(key, "_at")).alias("e")).select("_part", "e.*")
    earlier = ends.select(F.col("_part").alias("_p"), F.col(key).alias("_k"), (F.col("_at") + 1).alias("_c0"), *[F.col(f"_{n}").alias(f"_c{i + 1}") for i, n in enumerate(names)])
    borders = earlier.unionByName(local.groupBy(F.col("_part").alias("_p")).agg(F.min(key).alias("_k")).select("_p", "_k", *[F.lit(None).cast("long").alias(f"_c{i}") for i in range(len(names) + 1)]))
    before = Window.partitionBy("_k").orderBy("_p", F.col("_c0").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    carried = borders.select(
        F.col("_p").alias("_to"), F.col("_k").alias("_key"), F.col("_c0").isNull().alias("_start"),
        *[(F.bit_xor if i and names[i - 1] in xors else F.sum)(f"_c{i}").over(before).alias(f"_c{i}") for i in range(len(names) + 1)],
    ).filter("_start and _c0 is not null")
    joined = local.join(F.broadcast(carried), (F.col("_part") == F.col("_to")) & (F.col(key) == F.col("_key")), "left")
    value = lambda own, i: F.col(own) + F.coalesce(f"_c{i}", F.lit(0))
    mixed = lambda own, i: F.col(own).bitwiseXOR(F.coalesce(f"_c{i}", F.lit(0)))
    return joined.select(*df.columns, value("_at", 0).alias("at"), *[(mixed if n in xors else value)(f"_{n}", i + 1).alias(f"{n}_to") for i, n in enumerate(names)])


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (unique by ``keys``; ``weight``: how many of the ``total`` rows have
    the key, counted before). Keys with more rows than a task's share are broadcast; by their weights there
    are no more of them than shuffle partitions."""
    share = max(1000, total // shuffle_partitions(rows.sparkSession))
    heavy = F.broadcast(facts.filter(F.col(weight) > share))
    met = rows.join(heavy, keys)
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(facts.filter(F.col(weight) <= share), keys)
    return met.unionByName(rest)
