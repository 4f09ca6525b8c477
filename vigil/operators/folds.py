"""Folds over keys in order, for what windows can't say: steps whose state depends on what they gave before.

Rows lie in sorted partitions, and a task walks them batch by batch with the
state of one key at a time. So neither a group nor an array holds a key's
history, however long it is, and many small keys cost no more than their rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: (state, None at first; columns of some rows of one key, in order) -> (results, state)
Fold = Callable[[Any, dict[str, list]], tuple[list[tuple], Any]]


def folded(df: DataFrame, keys: list[str], order: list[str], output: str, fold: Fold, together: str | None = None) -> DataFrame:
    """keys and the results (output: names and types) of a fold over each key's rows in order.

    A key's rows come in as many calls as there are batches; those that are equal in the column together come in one.
    """
    kinds = dict(df.dtypes)
    names = [part.split()[0] for part in output.split(", ")]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), output])
    whole = [*keys, *([together] if together else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        held: pa.Table | None = None

        def walk(rows: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
            nonlocal key, state
            columns = {n: rows.column(n).to_pylist() for n in rows.schema.names}
            owners = list(zip(*(columns[k] for k in keys), strict=True))
            starts = [i for i in range(len(owners)) if i == 0 or owners[i] != owners[i - 1]]
            at, found = [], []
            for a, b in zip(starts, [*starts[1:], len(owners)], strict=True):
                if owners[a] != key:
                    key, state = owners[a], None
                results, state = fold(state, {n: c[a:b] for n, c in columns.items()})
                at += [a] * len(results)
                found += results
            own = [rows.column(k).take(pa.array(at, pa.int64())) for k in keys]
            own = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own]
            made = [pa.array(list(c)) for c in zip(*found, strict=True)] if found else [pa.nulls(0)] * len(names)
            return pa.RecordBatch.from_arrays([*own, *made], names=[*keys, *names])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            if together:  # the last rows that belong together may go on
                ends = [rows.column(c).combine_chunks() for c in whole]
                end = [c[len(c) - 1].as_py() for c in ends] if rows.num_rows else []
                cut = bisect_left(range(rows.num_rows), True, key=lambda i: all(c[i].as_py() == e for c, e in zip(ends, end, strict=True)))
                held, rows = rows.slice(cut), rows.slice(0, cut)
            if rows.num_rows:
                yield cast(walk(rows))
        if held is not None and held.num_rows:
            yield cast(walk(held))

    target = pa.schema([(k, arrow(kinds[k])) for k in keys] + [(p.split()[0], arrow(p.split()[1])) for p in output.split(", ")])

    def cast(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, target, strict=True)], schema=target)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[kind]
