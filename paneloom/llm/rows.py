"""Map rows through a Python function in Arrow batches, beside columns that pass through untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType


def small_batches(df: DataFrame, rows: int = 1000, size: int = 1 << 24) -> DataFrame:
    """`df`, with its session's Arrow batches held to so many rows and bytes at most.

    Whole texts travel in these batches; a worker and its executor hold a few of
    them at a time. Results do not depend on it. Smaller settings are left alone.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return df


def per_row(df: DataFrame, inputs: Sequence[str], fields: dict[str, DataType], start: Callable[[], Callable],
            keep: Sequence[str] | None = None) -> DataFrame:
    """The kept columns of `df` and one new column per field.

    `start()` runs once per task and returns a function of the input values that
    gives a tuple, one value per field. An input column with the name of a new
    one is replaced. Batches are bounded in bytes by Spark's Arrow settings.
    """
    taken = {name.lower() for name in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    needed = kept + [c for c in dict.fromkeys(inputs) if c not in kept]
    added = [StructField(name, kind) for name, kind in fields.items()]
    types = [to_arrow_type(f.dataType) for f in added]
    places = [needed.index(c) for c in inputs]
    names = kept + list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 128):  # a few rows at a time as Python values, beside the batch
                few = batch.slice(at, 128)
                out += [fn(*values) for values in zip(*[few.column(i).to_pylist() for i in places])]
            new = [pa.array([row[i] for row in out], type=kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + new, names=names)

    source = small_batches(df).select(*[quoted(c) for c in needed])
    return source.mapInArrow(run, StructType([source.schema[c] for c in kept] + added))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
