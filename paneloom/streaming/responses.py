"""Structured Streaming: latest-wins response log and incremental run health.

The log is merge-on-read. A micro-batch is reduced to the latest row per key and
written to the folder of its own batch id, so a replayed batch overwrites itself
and the cost of a batch does not depend on what is already stored. Readers take
the latest row over all batches.

`compact` folds finished batches into a generation, one row per key, and swaps a
pointer (a manifest) to it. A reader opens the generation that is in force and the
batches after it, and goes on with those folders whatever is compacted meanwhile; a
stream that is restarted writes a batch again into its own folder, which readers skip
if their generation holds it. `vacuum` removes what the last generations do not need.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from paneloom.operators.pairing import latest_wins
from paneloom.sources import manifest


def upsert_stream(stream: DataFrame, keys: list[str], order: list[str], log_path: str,
                  checkpoint: str, compact_every: int | None = None) -> StreamingQuery:
    """Start the upsert; it processes what is available and stops, or restarts where it stopped.

    With `compact_every` the log is compacted after each so many micro-batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        latest_wins(batch, keys, order).write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact(batch.sparkSession, log_path, keys, order)
            vacuum(batch.sparkSession, log_path)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _batches(spark: SparkSession, log_path: str, after: int) -> list[int]:
    """Finished batches behind a generation; one that is just being written has no mark yet."""
    ids = sorted(int(n.removeprefix("batch_id=")) for n in manifest.children(spark, log_path) if n.startswith("batch_id="))
    return [i for i in ids if i > after and "_SUCCESS" in manifest.children(spark, f"{log_path}/batch_id={i}")]


def _opened(spark: SparkSession, log_path: str) -> tuple[DataFrame, int, int]:
    """The rows of the generation in force and of the batches after it, the last batch among them, and the generation's number."""
    version, content = manifest.read(spark, log_path) or (-1, {"folder": None, "upto": -1})
    ids = _batches(spark, log_path, content["upto"])
    parts = [spark.read.parquet(f"{log_path}/{content['folder']}")] if content["folder"] else []
    if ids:
        parts.append(spark.read.option("basePath", log_path).parquet(*[f"{log_path}/batch_id={i}" for i in ids]))
    if not parts:
        raise ValueError(f"{log_path} holds no finished batch")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return rows, max(ids, default=content["upto"]), version


def read_latest(spark: SparkSession, log_path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The current row of each key."""
    return latest_wins(_opened(spark, log_path)[0], keys, [*order, "batch_id"]).drop("batch_id")


def compact(spark: SparkSession, log_path: str, keys: list[str], order: list[str]) -> int:
    """Fold the finished batches into a new generation and make it the one in force; its last batch."""
    rows, upto, version = _opened(spark, log_path)
    folder = f"_generations/{version + 1:012d}-{uuid.uuid4().hex}"
    latest_wins(rows, keys, [*order, "batch_id"]).write.parquet(f"{log_path}/{folder}")
    manifest.commit(spark, log_path, version + 1, {"folder": folder, "upto": upto})
    return upto


def vacuum(spark: SparkSession, log_path: str, keep: int = 2) -> None:
    """Remove batches and generations that none of the last `keep` generations needs."""
    kept = [manifest.read_version(spark, log_path, v) for v in manifest.versions(spark, log_path)[-keep:]]
    for name in manifest.children(spark, f"{log_path}/_generations"):
        if f"_generations/{name}" not in {k["folder"] for k in kept}:
            manifest.remove(spark, f"{log_path}/_generations/{name}")
    for name in manifest.children(spark, log_path):
        if name.startswith("batch_id=") and kept and int(name.removeprefix("batch_id=")) <= kept[0]["upto"]:
            manifest.remove(spark, f"{log_path}/{name}")


def health_counters(stream: DataFrame, group: str, tokens: str, valid: str) -> DataFrame:
    """Running counters per source; the median is approximate, as a stream needs."""
    return stream.groupBy(group).agg(
        F.count("*").alias("n"), F.sum(F.col(valid).cast("long")).alias("valid"),
        F.max(tokens).alias("tok_max"), F.percentile_approx(tokens, 0.5, 10000).alias("tok_median"))


def health_stream(stream: DataFrame, group: str, tokens: str, valid: str, path: str,
                  checkpoint: str) -> StreamingQuery:
    """Write the counters after every micro-batch; each batch holds the complete short table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (health_counters(stream, group, tokens, valid).writeStream.outputMode("complete")
            .foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def newest_batch(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.parquet(path)
    last = table.agg(F.max("batch_id").alias("batch_id"))
    return table.join(F.broadcast(last), "batch_id").drop("batch_id")
