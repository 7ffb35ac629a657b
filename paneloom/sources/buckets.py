"""Latest-wins store in hash buckets: an upsert reads and writes the buckets of its own keys only.

Keys are hashed into a fixed number of buckets. The manifest names the folder that holds each bucket; an upsert merges
the buckets that its rows fall into, writes them to a new folder and swaps the manifest. What it costs follows the rows
it brings and the size of a bucket, not the size of the store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from paneloom.operators.pairing import latest_wins
from paneloom.sources import manifest

MOST_BUCKETS = 65_536  # a manifest has a line per bucket


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int").alias("bucket")


def create(df: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = 4096) -> None:
    """A new store with the latest row of each key of `df`."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"a store has 1 to {MOST_BUCKETS} buckets")
    content = {"keys": keys, "order": order, "buckets": buckets, "schema": df.schema.jsonValue(), "folders": {}}
    _merge(df, path, 0, content)


def upsert(new: DataFrame, path: str) -> int:
    """Bring rows into a store; the number of buckets that were read and written."""
    version, content = manifest.read(new.sparkSession, path)
    return _merge(new, path, version + 1, content)


def _merge(new: DataFrame, path: str, version: int, content: dict) -> int:
    spark, keys, order, names = new.sparkSession, content["keys"], content["order"], [f["name"] for f in content["schema"]["fields"]]
    folder = f"data/{version:012d}-{uuid.uuid4().hex}"
    incoming = latest_wins(new.select(*names), keys, order).withColumn("bucket", _bucket(keys, content["buckets"]))
    incoming.write.partitionBy("bucket").parquet(f"{path}/{folder}-new")
    touched = [int(n.removeprefix("bucket=")) for n in manifest.children(spark, f"{path}/{folder}-new") if n.startswith("bucket=")]
    held = [f"{path}/{content['folders'][str(b)]}/bucket={b}" for b in touched if str(b) in content["folders"]]
    rows, tasks = spark.read.schema(incoming.schema).parquet(f"{path}/{folder}-new"), max(1, min(len(touched), 10_000))
    if held:  # one row per key on either side, dealt once by bucket
        old = _read(spark, held, content).withColumn("bucket", _bucket(keys, content["buckets"]))
        rows = latest_wins(rows.unionByName(old).repartition(tasks, "bucket"), ["bucket", *keys], order)
    else:
        rows = rows.repartition(tasks, "bucket")
    rows.write.partitionBy("bucket").parquet(f"{path}/{folder}")
    content["folders"].update({str(b): folder for b in touched})
    manifest.commit(spark, path, version, content)
    manifest.remove(spark, f"{path}/{folder}-new")
    return len(touched)


def _read(spark: SparkSession, paths: list[str], content: dict) -> DataFrame:
    schema = StructType.fromJson(content["schema"])
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a store, now or as of a manifest."""
    content = manifest.read(spark, path)[1] if version is None else manifest.read_version(spark, path, version)
    return _read(spark, [f"{path}/{folder}/bucket={b}" for b, folder in content["folders"].items()], content)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove the folders that none of the last `keep` manifests names; how many went."""
    found = manifest.versions(spark, path)
    named = {folder for v in found[-keep:] for folder in manifest.read_version(spark, path, v)["folders"].values()}
    gone = [name for name in manifest.children(spark, f"{path}/data") if f"data/{name}" not in named]
    for name in gone:
        manifest.remove(spark, f"{path}/data/{name}")
    return len(gone)
