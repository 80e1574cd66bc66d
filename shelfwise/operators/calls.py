"""Calls of a batch service (embeddings, classification) for the rows of a table."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type


def call_in_batches(
    rows: DataFrame,
    text: str,
    call: Callable[[list[str]], list[tuple[int, object]]],
    result_type,
    *,
    size: int = 100,
    tries: int = 3,
    first_wait: float = 1.0,
    wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """rows with result, error and tries: what call returns for each row's text.

    call takes up to `size` texts and returns (index, result) of each, in any order. A call that raises, or whose answer
    lacks an index or has one twice, is made again after a wait that doubles, `tries` times at most; then its rows have
    a null result and the error. Null texts are not sent. Texts of a task are sent on end, so that all calls but its
    last are full, and no more than `size` rows wait. A task that is run again calls again: call must allow that.

    result_type is a Spark data type. rows must have no columns named result, error or tries.
    """
    from pyspark.sql.types import IntegerType, StringType, StructType

    taken = {c.lower() for c in rows.columns} & {"result", "error", "tries"}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are in the way")
    schema = StructType([*rows.schema.fields]).add("result", result_type).add("error", StringType()).add("tries", IntegerType())
    kind = to_arrow_type(result_type)

    def answers(texts: list[str]) -> tuple[list, str | None, int]:
        error = None
        for n in range(1, tries + 1):
            try:
                found = dict(pairs := list(call(texts)))
                if len(pairs) != len(texts) or set(found) != set(range(len(texts))):
                    raise ValueError(f"{len(set(found) & set(range(len(texts))))} of {len(texts)} answers")
                return [found[i] for i in range(len(texts))], None, n
            except Exception as e:  # whatever a service raises is a failed try
                error = f"{type(e).__name__}: {e}"
                if n < tries:
                    wait(first_wait * 2 ** (n - 1))
        return [None] * len(texts), error, tries

    def answered(table: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = table.column(text).to_pylist()
        at = [i for i, t in enumerate(texts) if t is not None]
        result, error, used = [None] * len(texts), [None] * len(texts), [0] * len(texts)
        if at:
            found, failed, n = answers([texts[i] for i in at])
            for i, x in zip(at, found):
                result[i], error[i], used[i] = x, failed, n
        for name, column in (("result", pa.array(result, kind)), ("error", pa.array(error, pa.string())), ("tries", pa.array(used, pa.int32()))):
            table = table.append_column(name, pa.chunked_array([column]))
        yield from table.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, size - n)
                held.append(part)
                n, b = n + part.num_rows, b.slice(part.num_rows)
                if n == size:
                    yield from answered(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            yield from answered(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)
