"""Work on blocks of rows inside Arrow map tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK_ROWS = 256

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\r\x0b\x0c"


def by_blocks(one_block: Callable[..., Sequence], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """Apply `one_block(list per column) -> list` to blocks of a column function's batch, so that few texts are Python strings at once."""
    parts = [
        pa.array(one_block(*[c.slice(at, BLOCK_ROWS).to_pylist() for c in columns]), type=kind)
        for at in range(0, len(columns[0]), BLOCK_ROWS)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], type=kind)


def free_names(df: DataFrame, n: int) -> list[str]:
    """`n` names that no column of `df` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    names = (f"_scratch_{i}" for i in count())
    return list(islice((name for name in names if name not in taken), n))


def map_blocks(
    df: DataFrame, columns: Sequence[str], block: Callable[..., Sequence[Sequence]], schema: str, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Apply `block(list per column) -> list per output column` to blocks of at most `rows` rows.

    Only `columns` go to Python; other columns of `df`, whatever their names, play no part.
    """
    out = StructType.fromDDL(schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(out)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                made = block(*[c.to_pylist() for c in part.columns])
                arrays = [pa.array(values, type=f.type) for values, f in zip(made, target, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.select(*columns).mapInArrow(task, out)
