"""Audit of filter interactions: what each of five filters removes in every order, kept up to date while files arrive.

Filters, on the whole text: A under 100 words, B distinct words under 80 %, C capitals over 10 % of the code points,
D a symbol of `#$%&*|`, E the text of a smaller id anywhere in the table. A to D are judged where a file is read; E
cannot be, for a smaller id may come in a later file. So a stream processes all files as available-now micro-batches
and keeps, for every text by its digest, the least id so far and what its rows count as. When a smaller id arrives, the
earlier rows are retracted from their part's counters and counted again as failing E. Counters are per part (language)
and code, a set of filters failed plus the labels; a micro-batch writes the change of its counters into a folder of its
own id, so a batch that is replayed overwrites itself, and their sum is exact after every batch.

Scale: texts never leave the task that reads them; a digest, an id, a part and a code travel. Before that shuffle each
task counts its copies of a text, so a group of copies of any size sends a row per task. State is a short entry per
distinct text, in RocksDB, on disk beyond the bound of its memory. A state key is a hash range of about `TEXTS_PER_KEY`
digests, for calling Python per text would cost more than reading it; the number of ranges follows the row counts in the
files' footers when a folder is first used, and stays. `interactions` works on at most 128 counters per
part. A lost executor costs a replayed batch: offsets, state and counters are in the shared folder.

Odd inputs: a null text is empty; a null or empty language is the part ''; a null id is neither smaller nor larger than
any other, so it never fails E; rows that share text and least id all pass E; labels repeat without effect (a document
has a label if any row says so), and null labels say nothing; an empty table gives no parts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paneloom.llm.rows import quoted, small_batches
from paneloom.session import work_path

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
_E = 1 << 4
_GOOD, _TOXIC = 1 << 5, 1 << 6
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = re.compile(r"[#$%&*|]")
_JUDGED = "doc_id bigint, part string, code int, twin binary"
_DEALT = "bucket bigint, twin binary, doc_id bigint, settled boolean, part string, code int, n bigint"
_CHANGES = "part string, code int, n bigint"
_STATE = "twins array<binary>, leasts array<bigint>, parts array<string>, codes array<int>, counts array<bigint>"
TEXTS_PER_KEY = 64
# RocksDB's memory, per executor, and state that grows on disk instead of on the heap.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each store reserves megabytes for its file list
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",  # an executor may hold a store for each of many partitions
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    return ((n < 100) | (100 * len(set(words)) < 80 * n) << 1
            | (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 10 * len(text)) << 2
            | bool(_SYMBOLS.search(text)) << 3)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, twins = [], []
        for row in range(batch.num_rows):
            text = batch.column(2)[row].as_py() or ""
            codes.append(failures(text))
            twins.append(hashlib.sha256(text.encode()).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(codes, pa.int32()), pa.array(twins, pa.binary())],
            names=["doc_id", "part", "code", "twin"])


def _bucket(twin: bytes, buckets: int) -> int:
    return int.from_bytes(twin[:8], "big") % buckets


def _count_copies(batches: Iterator[pa.RecordBatch], buckets: int = 1, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Per text the rows of its least id here, and counts of its other rows, whose codes are settled."""
    held: dict[bytes, tuple[int, Counter]] = {}
    settled: Counter = Counter()

    def sent() -> pa.RecordBatch:
        rows = [(_bucket(twin, buckets), twin, least, False, *cell, n) for twin, (least, cells) in held.items() for cell, n in cells.items()]
        rows += [(_bucket(twin, buckets), twin, 0, True, part, code, n) for (twin, part, code), n in settled.items()]
        held.clear()
        settled.clear()
        types = (pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)],
                                          names=["bucket", "twin", "doc_id", "settled", "part", "code", "n"])

    for batch in batches:
        for doc_id, part, code, twin in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if doc_id is None:
                settled[twin, part, code] += 1
                continue
            known = held.get(twin)
            if known is None or doc_id < known[0]:
                for (old_part, old_code), n in known[1].items() if known else ():
                    settled[twin, old_part, old_code | _E] += n
                held[twin] = (doc_id, Counter({(part, code): 1}))
            elif doc_id == known[0]:
                known[1][part, code] += 1
            else:
                settled[twin, part, code | _E] += 1
        if len(held) + len(settled) >= most:
            yield sent()
    yield sent()


def changes(rows: Iterator[tuple], held: dict[bytes, tuple[int, Counter]]) -> Counter:
    """The change of the counters by more rows (twin, doc_id, settled, part, code, n); `held` has the rows of every text's least id."""
    change: Counter = Counter()
    for twin, doc_id, settled, part, code, n in rows:
        known = held.get(twin)
        if settled:
            change[part, code] += n
        elif known is None or doc_id < known[0]:
            for (old_part, old_code), old_n in known[1].items() if known else ():  # a smaller id has come: retract, and count as copies
                change[old_part, old_code] -= old_n
                change[old_part, old_code | _E] += old_n
            held[twin] = (doc_id, Counter({(part, code): n}))
            change[part, code] += n
        elif doc_id == known[0]:
            known[1][part, code] += n
            change[part, code] += n
        else:
            change[part, code | _E] += n
    return change


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held: dict[bytes, tuple[int, Counter]] = {}
    if state.exists:
        for twin, least, *cell, n in zip(*state.get):
            held.setdefault(bytes(twin), (least, Counter()))[1][tuple(cell)] = n
    rows = (row for frame in frames for row in zip(*[frame[c].tolist() for c in ("twin", "doc_id", "settled", "part", "code", "n")]))
    change = changes(rows, held)
    kept = [(twin, least, *cell, n) for twin, (least, cells) in held.items() for cell, n in cells.items()]
    if kept:
        state.update(tuple(map(list, zip(*kept))))
    out = [(part, code, n) for (part, code), n in change.items() if n]
    yield pd.DataFrame({"part": [r[0] for r in out], "code": [r[1] for r in out], "n": [r[2] for r in out]})


def label_codes(labels: DataFrame) -> DataFrame:
    """(doc_id, label): one row per labelled document."""
    good, toxic = F.max(F.coalesce(F.col("quality") == 1, F.lit(False))), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        (good.cast("int") * _GOOD + toxic.cast("int") * _TOXIC).alias("label"))


def _ranges(spark: SparkSession, folder: str, rows: int) -> int:
    """How many hash ranges of texts the state of a folder has: chosen once, then read."""
    wanted = max(1, rows // TEXTS_PER_KEY)
    spark.range(1).select(F.lit(wanted).cast("bigint").alias("ranges")).write.mode("ignore").parquet(f"{folder}/layout")
    return spark.read.schema("ranges bigint").parquet(f"{folder}/layout").first()["ranges"]


def count_stream(docs: DataFrame, labels: DataFrame, folder: str, ranges: int) -> StreamingQuery:
    """Start counting a stream of documents (doc_id, text, lang) into `folder`; started again there, it goes on where it stopped."""
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    judged = small_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), part, F.col("text").cast("string").alias("text"))
                           ).mapInArrow(_judge, _JUDGED)
    coded = judged.join(label_codes(labels), "doc_id", "left").select(
        "doc_id", "part", (F.col("code") + F.coalesce("label", F.lit(0))).alias("code"), "twin")
    moved = coded.mapInArrow(lambda batches: _count_copies(batches, ranges), _DEALT).groupBy("bucket").applyInPandasWithState(
        _update, _CHANGES, _STATE, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("part", "code").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/changes/batch_id={batch_id}")

    return (moved.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, code, n): the counters after all micro-batches so far."""
    return (spark.read.schema("part string, code int, n bigint, batch_id bigint").parquet(f"{folder}/changes")
            .groupBy("part", "code").agg(F.sum("n").alias("n")).where("n != 0"))


def count_files(spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int | None = None, folder: str | None = None) -> DataFrame:
    """The counters of all files under `path`, by one run over what is available.

    A micro-batch takes a file per core unless told otherwise: more batches cost time, never results.
    """
    folder, path = folder or work_path(spark, "filter-audit"), path.rstrip("/")
    table = spark.read.parquet(path)
    schema = table.select(*[quoted(c) for c in ("doc_id", "text", "lang")]).schema
    ranges = _ranges(spark, folder, table.count())  # of the footers
    before = {key: spark.conf.get(key, None) for key in _STORE}
    try:
        for key, value in _STORE.items():
            spark.conf.set(key, value)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch or spark.sparkContext.defaultParallelism)
        # As a pattern, a path may name a folder or a single file; a stream refuses the latter by its plain name.
        count_stream(stream.parquet(f"{path[:-1]}[{path[-1]}]"), labels, folder, ranges).awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return counts(spark, folder)


def interactions(counters: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: documents kept, removed, redundant and failing that filter only, labelled
    ones lost, and what the filter removes over all orders."""
    amount = {"n": F.col("n"), "good": F.when(F.col("code").bitwiseAND(_GOOD) != 0, F.col("n")).otherwise(0),
              "toxic": F.when(F.col("code").bitwiseAND(_TOXIC) != 0, F.col("n")).otherwise(0)}
    # At most 32 cells per part.
    cells = counters.groupBy("part", F.col("code").bitwiseAND(31).alias("mask")).agg(
        *[F.sum(v).cast("bigint").alias(k) for k, v in amount.items()]).groupBy("part").agg(
        F.collect_list(F.struct("mask", *amount)).alias("cells"))
    steps = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.array(*map(F.lit, range(1, 6)))))
    bit = lambda letter: F.pow(F.lit(2), F.instr(F.lit(FILTERS), letter) - 1).cast("int")
    own = F.expr("substring(filter_order, step, 1)")
    before = F.aggregate(F.split(F.expr("substring(filter_order, 1, step - 1)"), ""), F.lit(0),
                         lambda acc, x: acc + F.when(x == "", 0).otherwise(bit(x)))
    placed = steps.select("part", "filter_order", "step", "cells", own.alias("letter"), bit(own).alias("own"), before.alias("before"))

    def total(condition, value="n"):
        return F.aggregate(F.filter("cells", condition), F.lit(0).cast("bigint"), lambda acc, x: acc + x[value])

    def removed(x):
        return (x["mask"].bitwiseAND(F.col("own")) != 0) & (x["mask"].bitwiseAND(F.col("before")) == 0)

    out = placed.select(
        "part", "filter_order", "step", "letter",
        total(lambda x: x["mask"].bitwiseAND(F.col("own") + F.col("before")) == 0).alias("kept"), total(removed).alias("removed"),
        total(lambda x: (x["mask"].bitwiseAND(F.col("own")) != 0) & (x["mask"].bitwiseAND(F.col("before")) != 0)).alias("redundant"),
        total(lambda x: x["mask"] == F.col("own")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def interactions_sql() -> str:
    """The same over tables documents and labels, as DuckDB SQL."""
    letters = ", ".join(f"'{x}'" for x in FILTERS)
    return rf"""WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY x) THEN 16 ELSE 0 END AS mask FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest([{letters}]) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, (1 << (instr('{FILTERS}', substr(filter_order, step, 1)) - 1)) AS own,
  coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (instr('{FILTERS}', substr(filter_order, i, 1)) - 1))), 0)::BIGINT AS before
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, letter,
  coalesce(sum(n) FILTER (mask & (own + before) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own != 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own != 0 AND mask & before != 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own != 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own != 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""
