"""Bucketed upsert and compaction: equal rows, bounded work, old states readable."""

import os
import random

import pytest
from pyspark.sql import functions as F

from paneloom.sources import buckets, manifest
from paneloom.streaming import responses as live

SCHEMA = "user string, item int, seq long, value double"
KEYS = ["user", "item"]


def plain_latest(*parts):
    out = {}
    for user, item, seq, value in (r for part in parts for r in part):
        if (user, item) not in out or seq > out[user, item][0]:
            out[user, item] = (seq, value)
    return {(*k, *v) for k, v in out.items()}


def rows(n, start, users, seed):
    draw = random.Random(seed)
    return [(draw.choice(users), draw.randint(0, 9), start + i, draw.random()) for i in range(n)]


def got(df):
    return {tuple(r) for r in df.select("user", "item", "seq", "value").collect()}


def test_upserts_keep_the_latest_row(spark, tmp_path):
    path, users = str(tmp_path / "store"), [f"u{i}" for i in range(300)] + ["hot"] * 200 + [None]
    parts = [rows(3000, 0, users, 1), rows(500, 3000, users[:20], 2), rows(5, -5, ["u1", "new"], 3)]
    buckets.create(spark.createDataFrame(parts[0], SCHEMA), path, KEYS, ["seq"], buckets=64)
    assert got(buckets.read(spark, path)) == plain_latest(parts[0])
    for i in (1, 2):
        buckets.upsert(spark.createDataFrame(parts[i], SCHEMA), path)
        assert got(buckets.read(spark, path)) == plain_latest(*parts[:i + 1])
    assert got(buckets.read(spark, path, version=0)) == plain_latest(parts[0])
    everything = [(u, i, 10_000 + k, 0.25) for k, (u, i) in enumerate(sorted({(r[0], r[1]) for part in parts for r in part}, key=str))]
    parts.append(everything)
    buckets.upsert(spark.createDataFrame(everything, SCHEMA), path)
    assert buckets.vacuum(spark, path, keep=1) == 3 and len(os.listdir(f"{path}/data")) == 1
    assert got(buckets.read(spark, path)) == plain_latest(*parts)


def test_an_upsert_touches_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    store = spark.range(200_000).select(F.concat(F.lit("u"), "id").alias("user"), F.lit(1).alias("item"), F.col("id").alias("seq"), F.rand(1).alias("value"))
    buckets.create(store, path, KEYS, ["seq"], buckets=1024)
    before = manifest.read(spark, path)[1]["folders"]
    new = [(f"u{i * 37}", 1, 10**9 + i, 0.5) for i in range(100)]
    touched = buckets.upsert(spark.createDataFrame(new, SCHEMA), path)
    after = manifest.read(spark, path)[1]["folders"]
    assert 0 < touched <= 100 and sum(before[b] != after[b] for b in after) == touched
    result = buckets.read(spark, path)
    assert result.count() == 200_000 and result.where("value = 0.5 and seq >= 1000000000").count() == 100


def test_a_killed_write_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path, users = str(tmp_path / "store"), [f"u{i}" for i in range(30)]
    first, second = rows(200, 0, users, 4), rows(200, 200, users, 5)
    buckets.create(spark.createDataFrame(first, SCHEMA), path, KEYS, ["seq"], buckets=8)
    with monkeypatch.context() as m:
        m.setattr(manifest, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            buckets.upsert(spark.createDataFrame(second, SCHEMA), path)
    assert got(buckets.read(spark, path)) == plain_latest(first)
    buckets.upsert(spark.createDataFrame(second, SCHEMA), path)
    assert got(buckets.read(spark, path)) == plain_latest(first, second)


def test_of_two_writers_one_wins(spark, tmp_path):
    manifest.commit(spark, str(tmp_path), 3, {"a": 1})
    with pytest.raises(Exception, match="(?i)exist"):
        manifest.commit(spark, str(tmp_path), 3, {"a": 2})
    assert manifest.read(spark, str(tmp_path)) == (3, {"a": 1})


def test_empty_and_too_many(spark, tmp_path):
    path, empty = str(tmp_path / "store"), spark.createDataFrame([], SCHEMA)
    buckets.create(empty, path, KEYS, ["seq"])
    assert buckets.read(spark, path).count() == 0 and buckets.upsert(empty, path) == 0
    buckets.upsert(spark.createDataFrame([("a", 1, 1, 0.0)], SCHEMA), path)
    assert got(buckets.read(spark, path)) == {("a", 1, 1, 0.0)}
    with pytest.raises(ValueError, match="buckets"):
        buckets.create(empty, path + "2", KEYS, ["seq"], buckets=10**6)


def feed(spark, tmp_path, parts):
    source = str(tmp_path / "in")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)


def test_compaction_between_batches(spark, tmp_path):
    log, cp, users = str(tmp_path / "log"), str(tmp_path / "cp"), [f"u{i}" for i in range(40)]
    parts = [rows(120, 120 * i, users, i) for i in range(7)]
    live.upsert_stream(feed(spark, tmp_path, parts), KEYS, ["seq"], log, cp, compact_every=2).awaitTermination()
    assert got(live.read_latest(spark, log, KEYS, ["seq"])) == plain_latest(*parts)
    folders = [n for n in os.listdir(log) if n.startswith("batch_id=")]
    assert len(folders) <= 3 and len(os.listdir(f"{log}/_generations")) <= 2
    more = rows(50, 10_000, users, 99)
    live.upsert_stream(feed(spark, tmp_path, [more]), KEYS, ["seq"], log, cp, compact_every=2).awaitTermination()
    assert got(live.read_latest(spark, log, KEYS, ["seq"])) == plain_latest(*parts, more)


def test_readers_keep_the_generation_they_opened(spark, tmp_path):
    log, cp, users = str(tmp_path / "log"), str(tmp_path / "cp"), [f"u{i}" for i in range(20)]
    parts = [rows(60, 60 * i, users, i) for i in range(3)]
    stream = feed(spark, tmp_path, parts)
    live.upsert_stream(stream, KEYS, ["seq"], log, cp).awaitTermination()
    opened = live.read_latest(spark, log, KEYS, ["seq"])
    assert live.compact(spark, log, KEYS, ["seq"]) == 2
    live.vacuum(spark, log, keep=2)
    later = live.read_latest(spark, log, KEYS, ["seq"])
    live.compact(spark, log, KEYS, ["seq"])
    live.vacuum(spark, log, keep=2)
    assert got(later) == plain_latest(*parts)
    assert got(live.read_latest(spark, log, KEYS, ["seq"])) == plain_latest(*parts)
    assert opened is not None and not [n for n in os.listdir(log) if n.startswith("batch_id=")]


def test_a_replayed_batch_is_not_counted_twice(spark, tmp_path):
    log, cp, users = str(tmp_path / "log"), str(tmp_path / "cp"), [f"u{i}" for i in range(20)]
    parts = [rows(60, 60 * i, users, i) for i in range(3)]
    live.upsert_stream(feed(spark, tmp_path, parts), KEYS, ["seq"], log, cp).awaitTermination()
    live.compact(spark, log, KEYS, ["seq"])
    os.remove(f"{cp}/commits/2")  # killed after the batch was written and before it was committed
    crc = f"{cp}/commits/.2.crc"
    if os.path.exists(crc):
        os.remove(crc)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.upsert_stream(stream, KEYS, ["seq"], log, cp).awaitTermination()
    assert got(live.read_latest(spark, log, KEYS, ["seq"])) == plain_latest(*parts)


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    log = str(tmp_path / "log")
    spark.createDataFrame(rows(20, 0, ["a", "b"], 1), SCHEMA).write.parquet(f"{log}/batch_id=0")
    spark.createDataFrame(rows(20, 100, ["a", "c"], 2), SCHEMA).write.parquet(f"{log}/batch_id=1")
    os.remove(f"{log}/batch_id=1/_SUCCESS")
    assert live.compact(spark, log, KEYS, ["seq"]) == 0
    assert got(live.read_latest(spark, log, KEYS, ["seq"])) == plain_latest(rows(20, 0, ["a", "b"], 1))


def test_document_tree_is_written_by_every_task(spark, tmp_path):
    from paneloom.sources import readers, writers

    docs = spark.createDataFrame([(f"p{i}", str(i), i) for i in range(60)] + [("a b/c", "x", None)], "subject string, participant_id string, age long").coalesce(1)
    assert writers.write_document_tree(docs, str(tmp_path / "tree"), "subject") == 61
    assert len(list((tmp_path / "tree").iterdir())) == 61
    back = readers.persona_documents(spark, str(tmp_path / "tree"))
    got = {r.participant_id: (r.subject, r.age) for r in back.select("subject", "participant_id", "age").collect()}
    assert len(got) == 61 and got["7"] == ("p7", 7) and got["x"][1] is None
    writers.write_document_tree(docs, str(tmp_path / "tree"), "subject")  # a repeated task replaces its files
    assert back.count() == 61


def test_compressed_dataset_reads_back_the_same(spark, tmp_path):
    from paneloom.sources import writers

    df = spark.createDataFrame([(i, "long text " * 20, "a" if i % 2 else "b") for i in range(200)], "i long, t string, split string").coalesce(1)
    sizes = []
    for name, codec in (("plain", None), ("packed", "gzip")):
        writers.write_dataset(df, str(tmp_path / name), compression=codec)
        sizes.append(sum(f.stat().st_size for f in (tmp_path / name).rglob("part-*")))
        assert spark.read.schema(df.schema).json(str(tmp_path / name)).exceptAll(df).count() == 0
    assert sizes[1] < sizes[0] / 5
