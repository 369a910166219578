"""Ordered folds: state that depends on what was decided before, so that no window function expresses it; running sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Numbers that one step of a running sum takes together.
BLOCK = 128


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[Any, Any], tuple[Any, tuple]], outputs: str) -> DataFrame:
    """rows with the columns `outputs` (DDL). Null is a key like others. step(state, row) gives the next state and the values; state is None at the
    first row of each key. Rows are dealt and sorted by Spark and pass through a task batch by batch: what it keeps is one
    state, however long a key's rows go on."""
    names = rows.columns
    added = [c.split()[0] for c in outputs.split(",")]
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for batch in batches:
            values = []
            for row in batch.itertuples(index=False):
                key = tuple(None if pd.isna(row[i]) else row[i] for i in at)  # a null number comes as NaN, which no NaN equals
                if key != current:
                    current, state = key, None
                state, out = step(state, row)
                values.append(out)
            yield batch.assign(**{c: [v[i] for v in values] for i, c in enumerate(added)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{schema}, {outputs}")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once for all its mentions; an expression in a lambda is else computed anew for
    each mention and each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_running_sums(rows: DataFrame, numbers: str, to: str) -> DataFrame:
    """rows with the array column `to`: the sum of the numbers before each one, and, last, of all; null for null.

    Time grows with the numbers: sums run within blocks, then over the blocks' sums in blocks, then over those of these. Each
    array is a column of its own, so that no lambda computes it anew."""

    def run(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def in_blocks(values: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
        return F.when(F.size(values) > 0, F.transform(starts, lambda b: run(F.slice(values, b * BLOCK + 1, BLOCK))))

    def totals(runs: Column) -> Column:
        return F.transform(runs, lambda r: F.element_at(r, -1))

    one, sums, two, three = (f"{to}_{x}" for x in ("one", "sums", "two", "three"))
    rows = rows.withColumn(one, in_blocks(F.col(numbers))).withColumn(sums, totals(F.col(one)))
    rows = rows.withColumn(two, in_blocks(F.col(sums))).withColumn(three, run(totals(F.col(two))))
    before = lambda i: F.get(F.col(three), F.floor(i / BLOCK).cast("int")) + F.get(F.get(F.col(two), F.floor(i / BLOCK).cast("int")), i % BLOCK)
    each = F.flatten(F.transform(one, lambda r, i: F.transform(F.slice(r, 1, F.size(r) - 1), lambda x: before(i) + x)))
    whole = F.concat(each, F.array(F.element_at(F.col(three), -1)))
    return rows.withColumn(to, F.when(F.size(numbers) > 0, whole).when(F.size(numbers) == 0, F.array(F.lit(0)))).drop(one, sums, two, three)
