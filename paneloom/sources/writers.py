"""Writers: conformed dataset, result tables, progress log, stacked figure table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from paneloom.operators.pairing import latest_wins


def write_dataset(df: DataFrame, path: str, fmt: str = "json", by: str = "split", compression: str | None = None) -> None:
    """One folder per split; text formats may be compressed, readers know it by the file's ending."""
    writer = df.write.mode("overwrite").partitionBy(by).format(fmt)
    (writer if compression is None else writer.option("compression", compression)).save(path)


def write_document_tree(df: DataFrame, path: str, by: str, **options: str) -> int:
    """A folder per value of `by` with its documents as JSON, one per line; returns the number of folders.

    Rows are dealt over all tasks, for a small table arrives in few and every folder is work. A task writes its own
    files through `pyarrow.fs`, under a name that readers skip until the file is whole; a repeated task replaces it.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    text = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != by]), options)
    name = F.coalesce(F.nullif(F.col(by).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    dealt = df.select(name.alias("name"), text.alias("text")).repartition(tasks, "name").sortWithinPartitions("name")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        rows = (row for batch in batches for row in zip(batch["name"].to_pylist(), batch["text"].to_pylist()))
        folders = 0
        for name, documents in groupby(rows, lambda row: row[0]):
            folder = f"{root}/{by}={quote(name, safe=' ')}"
            files.create_dir(folder)
            part = f"{folder}/.{uuid.uuid4().hex}"
            with files.open_output_stream(part) as out:
                out.write("".join(f"{text}\n" for _, text in documents).encode())
            files.move(part, f"{folder}/part-00000.json")
            folders += 1
        yield pa.RecordBatch.from_pydict({"folders": [folders]})

    fs.FileSystem.from_uri(path)[0].create_dir(fs.FileSystem.from_uri(path)[1])
    return dealt.mapInArrow(write, "folders bigint").agg(F.coalesce(F.sum("folders"), F.lit(0))).first()[0]


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Existing and new rows with the latest row of each key."""
    return latest_wins(existing.unionByName(new, allowMissingColumns=True), keys, [seq])


def append_progress(df: DataFrame, path: str) -> None:
    """Append events with a UTC timestamp."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    df.withColumn("at", stamp).write.mode("append").json(path)


def stack_panels(panels: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """Long (panel, ids..., measure, value) table; each panel names its id and value columns."""
    out = None
    for name, (df, ids, values) in panels.items():
        typed = [F.col(v).cast("double").alias(v) for v in values]
        part = df.unpivot(ids, typed, "measure", "value").withColumn("panel", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
