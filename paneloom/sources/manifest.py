"""Numbered manifests: what a folder holds right now, swapped as a whole.

A manifest is a small JSON file. A new one is written beside the others and gets its number by a rename that fails if the
number is taken, so of two writers one wins, a killed writer leaves the old state in force, and a reader that has opened
a manifest goes on with the folders it names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_FOLDER = "_manifests"


def _files(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.getFileSystem(conf).getUri(), conf)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    jvm, fs, _ = _files(spark, path)
    place = jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    jvm, fs, _ = _files(spark, path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(name.removesuffix(".json")) for name in children(spark, f"{path}/{_FOLDER}") if name.endswith(".json") and not name.startswith("_")]


def read(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    """The newest manifest and its number."""
    found = versions(spark, path)
    return (found[-1], read_version(spark, path, found[-1])) if found else None


def read_version(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/{_FOLDER}/{version:012d}.json", wholetext=True).first()["value"])


def commit(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Make `content` manifest number `version`; an error if another writer has taken the number."""
    jvm, fs, context = _files(spark, path)
    make = jvm.org.apache.hadoop.fs.Path
    draft, final = make(f"{path}/{_FOLDER}/_{uuid.uuid4().hex}"), make(f"{path}/{_FOLDER}/{version:012d}.json")
    fs.mkdirs(final.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(draft, final, options)
