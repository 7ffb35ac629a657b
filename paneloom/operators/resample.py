"""Resampling tests: sign flips, label permutation, cluster bootstrap.

Replicates cost what the data's counts cost, not its cases, where counts are enough:
a sign flip needs the number of cases per difference, a bootstrap replicate the draws
that fall on a task's own subjects. Every draw is a function of (seed, block of
replicates, key), see functions.variates, or of (seed, replicate, subject), see
functions.draws; none depends on partitioning, and none is shuffled.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import combinations, groupby, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from paneloom.functions import draws as R
from paneloom.functions import variates
from paneloom.operators import distance as M
from paneloom.operators.describe import over_groupings
from paneloom.operators.pairing import attach_single
from paneloom.session import materialise

SIGN_ALPHA = 0.0167
_BLOCK = R.SIGNS_PER_DIGEST
# Published budgets.
N_FLIPS, N_CLUSTER_FLIPS, N_BOOTSTRAPS = 1_000_000, 100_000, 10_000
# Blocks of signs that a task adds up at once: bounds its table of sums, whatever the number of replicates.
BLOCKS_AT_ONCE = 64
# Replicates that a task holds at once, and numbers in its largest array.
FLIP_BLOCK, BOOT_BLOCK, ORDER_BLOCK = 16_384, 500, 131_072
HELD = 4_000_000
# Weights drawn in one piece, and keys digested in one pass: both stay near the processor's cache.
DRAWN_AT_ONCE, DIGESTED_AT_ONCE = 500_000, 16_384
# Tasks of bootstrap counts: so many groups of ranges of subjects, times so many groups of blocks of replicates.
COUNT_PARTS, COUNT_SHARES = 8, 8
# Permuted orders: so many are drawn in one piece; tables of all orders up to so many values, four lanes of 16 bits to a
# word, steps of a half (medians of whole numbers); a task has this many units at least, before another one is made.
ORDERED_AT_ONCE, TABLED, LANES, LANE_MOST, STEPS, UNITS_A_PART = 16_384, 8, 4, 65_535, 2, 1_000
_LOW_HALF = 0 if sys.byteorder == "little" else 1
_BUCKETS = 4096  # hash ranges of subjects; bounds the table of their sizes


def _fan_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """Spread rows over all tasks before replicates multiply them.

    A small panel arrives coalesced in a partition or two; its replicates are the
    work. On a large panel this moves narrow rows once, against n_rep digests each.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def replicate_sums(cases: DataFrame, keys: list[str], unit: list[str], diffs: Column, n_rep: int,
                   seed: int) -> DataFrame:
    """(keys, label, rep, s, obs, n, sq): signed sums per replicate.

    `diffs` is an array of (label, d) on each unit. One digest gives a unit 32
    signs, shared by all labels. The 32 sums are columns of one aggregation, so
    replicates are never exploded into rows before the map-side combine. A zero
    difference adds nothing to any replicate and is carried in block 0 only, for n. Replicate 0 also carries the sum of squares.
    """
    blocks = math.ceil(n_rep / _BLOCK)
    ranges = math.ceil(blocks / BLOCKS_AT_ONCE)
    spark = cases.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rest = [c for c in unit if c not in keys]
    moved = F.exists("_diffs", lambda x: x["d"] != 0)
    # A task gets a part of the cases and a range of blocks. One row moved serves BLOCKS_AT_ONCE digests.
    narrow = cases.select(*keys, *rest, diffs.alias("_diffs")).withColumn(
        "_range", F.explode(F.when(moved, F.sequence(F.lit(0), F.lit(ranges - 1))).otherwise(F.array(F.lit(0)))))
    salt = F.pmod(F.xxhash64(*unit), F.lit(math.ceil(4 * tasks / ranges)))
    dealt = narrow.withColumn("_salt", salt).repartition(tasks, "_range", "_salt")
    first = F.col("_range") * BLOCKS_AT_ONCE
    last = F.least(first + BLOCKS_AT_ONCE, F.lit(blocks)) - 1
    spread = dealt.select(*keys, *rest, "_diffs", F.explode(
        F.when(moved, F.sequence(first, last)).otherwise(F.array(F.lit(0)))).alias("_block"))
    word = spread.withColumn("_bits", R.bits32(R.digest(seed, F.col("_block"), *[F.col(c) for c in unit])))
    rows = word.select(*keys, "_block", "_bits", F.explode("_diffs").alias("_x"))
    d = F.col("_x.d")
    # d is added where the bit is set: d * bit keeps the 32 sums branch-free.
    sums = rows.groupBy(*keys, F.col("_x.label").alias("label"), "_block").agg(
        F.count(d).alias("_n"), F.sum(d).alias("_tot"), F.sum(d * d).alias("_sq"),
        *[F.expr(f"sum(_x.d * (shiftright(_bits, {i}) & 1)) AS _s{i}") for i in range(_BLOCK)])
    table = sums.select(
        *keys, "label", "_block", "_n", "_tot", "_sq",
        F.expr(f"posexplode(array({', '.join(f'2 * _s{i} - _tot' for i in range(_BLOCK))})) AS (_pos, s)"))
    rep = F.col("_block") * _BLOCK + F.col("_pos")
    return table.select(*keys, "label", rep.alias("rep"), "s", F.col("_tot").alias("obs"),
                        F.when(rep == 0, F.col("_n")).otherwise(0).alias("n"),
                        F.when(rep == 0, F.col("_sq")).otherwise(0).alias("sq")).where(F.col("rep") < n_rep)


def sum_over_cells(replicates: DataFrame, groupings: list[list[str]]) -> DataFrame:
    """Replicate sums of coarser groupings, added up from the cells."""
    return over_groupings(replicates, [[*g, "label", "rep"] for g in groupings], [
        F.sum("s").alias("s"), F.sum("obs").alias("obs"), F.sum("n").alias("n"), F.sum("sq").alias("sq")])


def exceedance(replicates: DataFrame, group: list[str], tolerance: float = 0.0) -> DataFrame:
    """Observed sum, n, number of replicates and how many are at least as extreme."""
    extreme = F.abs("s") >= F.abs("obs") - tolerance
    return replicates.groupBy(*group).agg(
        F.max("obs").alias("obs"), F.sum("n").alias("n"), F.sum("sq").alias("sq"), F.count("*").alias("n_rep"),
        F.sum(extreme.cast("int")).alias("exceed"))


def difference_counts(cases: DataFrame, cells: list[str], diffs: Column, groupings: list[list[str]]) -> DataFrame:
    """(keys, label, level, n, net): cases per absolute difference, and how many more of them are positive than negative."""
    d = F.col("_x.d")
    counted = cases.select(*cells, F.explode(diffs).alias("_x")).where(d.isNotNull()).groupBy(
        *cells, F.col("_x.label").alias("label"), F.abs(d).cast("double").alias("level")).agg(
        F.count("*").alias("n"), F.sum(F.signum(d).cast("long")).alias("net"))
    # The groupings return keys as strings; a double comes back from its string unchanged.
    return over_groupings(counted, [[*g, "label", "level"] for g in groupings], [
        F.sum("n").alias("n"), F.sum("net").alias("net")]).withColumn("level", F.col("level").cast("double"))


def observed_differences(counts: DataFrame) -> DataFrame:
    """n, mean difference, its SD and the effect size of every group of `difference_counts`."""
    keys = [c for c in counts.columns if c not in ("level", "n", "net")]
    level, n = F.col("level"), F.col("n")
    sums = counts.groupBy(*keys).agg(
        F.sum(n).alias("n"), F.sum(level * F.col("net")).alias("_obs"), F.sum(level * level * n).alias("_sq"))
    mean = F.col("_obs") / n
    sd = F.sqrt(F.try_divide(F.greatest(F.col("_sq") - F.col("_obs") * mean, F.lit(0.0)), n - 1))
    return sums.select(*keys, "n", mean.alias("mean_diff"), sd.alias("sd_diff"), F.try_divide(mean, sd).alias("d_z"))


def _flip_blocks(rows: Iterator[tuple], n_keys: int, n_rep: int, seed: int) -> Iterator[tuple]:
    """Rows (keys, label, block, level, n, net) sorted by all but the last two: per block the replicates at least as extreme."""
    for key, levels in groupby(rows, lambda row: row[:n_keys + 2]):
        reps = min(FLIP_BLOCK, n_rep - key[-1] * FLIP_BLOCK)
        flipped, observed, size = np.zeros(reps), 0.0, 0.0
        for *_, level, n, net in levels:
            draws = variates.heads(variates.generator(seed, *key, level), n, reps)
            flipped += level * (2 * draws - n)
            observed += level * net
            size += level * n
        # Sums that differ by rounding alone are equal.
        yield (*key[:-1], int((np.abs(flipped) >= abs(observed) - 1e-12 * size).sum()), reps)


def counted_sign_flip(cases: DataFrame, cells: list[str], diffs: Column, groupings: list[list[str]],
                      n_rep: int = N_FLIPS, seed: int = 42) -> DataFrame:
    """Two-sided paired sign-flip test of a zero mean difference, drawn from counts; p can be 0.

    Of the n cases with one absolute difference, a replicate makes a binomial number positive, so a replicate costs
    the distinct differences of a group and not its cases. Each grouping draws from its own pooled counts. Groups and
    blocks of replicates are dealt over the tasks; a task reads a group's differences one by one, however many they are.
    """
    counts = difference_counts(cases, cells, diffs, groupings)
    keys = [c for c in counts.columns if c not in ("label", "level", "n", "net")]
    by = [*keys, "label", "_block"]
    tasks = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), counts.sparkSession.sparkContext.defaultParallelism)
    blocks = F.sequence(F.lit(0), F.lit(math.ceil(n_rep / FLIP_BLOCK) - 1))
    dealt = counts.where("level > 0").withColumn("_block", F.explode(blocks)).select(*by, "level", "n", "net").repartition(
        tasks, *by).sortWithinPartitions(*by, "level")
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        out = list(_flip_blocks(rows, n_keys, n_rep, seed))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*keys, "label", "exceed", "reps"])

    drawn = dealt.mapInArrow(run, ", ".join([*[f"{k} string" for k in keys], "label string, exceed bigint, reps bigint"]))
    exceed = drawn.groupBy(*keys, "label").agg(F.sum("exceed").alias("exceed"))
    joined = observed_differences(counts).join(exceed, [*keys, "label"], "left")
    # Without a nonzero difference every replicate equals the observed sum.
    exceeded = F.coalesce("exceed", F.lit(n_rep))
    p = exceeded / F.lit(n_rep)
    return joined.select(*keys, "label", "n", "mean_diff", "sd_diff", "d_z", exceeded.alias("exceed"), p.alias("p"),
                         (p < SIGN_ALPHA).alias("reject"))


def sign_flip(cases: DataFrame, cells: list[str], unit: list[str], diffs: Column, groupings: list[list[str]],
              n_rep: int = N_FLIPS, seed: int = 42) -> DataFrame:
    """The same test with a sign per unit and replicate, which all labels and groupings share; costs cases x replicates."""
    reps = sum_over_cells(replicate_sums(cases, cells, unit, diffs, n_rep, seed), groupings)
    keys = [k for k in dict.fromkeys(c for g in groupings for c in g)]
    out = exceedance(reps, [*keys, "label"])
    p = F.col("exceed") / F.col("n_rep")
    mean = F.col("obs") / F.col("n")
    sd = F.sqrt(F.try_divide(F.col("sq") - F.col("obs") * mean, F.col("n") - 1))
    return out.select(*keys, "label", "n", mean.alias("mean_diff"), sd.alias("sd_diff"), F.try_divide(mean, sd).alias("d_z"),
                      "exceed", p.alias("p"), (p < SIGN_ALPHA).alias("reject"))


def subject_errors(wide: DataFrame, subject: str, sources: list[str]) -> DataFrame:
    """Per subject the number of cases, and per source the sums of absolute error (its name) and of error (bias_ before it)."""
    error = {s: (F.col("h") - F.col(s)).cast("double") for s in sources}
    return wide.groupBy(subject).agg(
        F.count("*").alias("m"), *[F.sum(F.abs(e)).alias(s) for s, e in error.items()],
        *[F.sum(e).alias(f"bias_{s}") for s, e in error.items()])


def mean_errors(errors: DataFrame, group: list[str], sources: list[str], weight: Column | None = None) -> DataFrame:
    """(group, source, mae, bias) from subject sums: both are linear in subjects, so no case is looked at again."""
    w = F.lit(1) if weight is None else weight
    sums = errors.groupBy(*group).agg(F.sum(w * F.col("m")).alias("_m"), *[
        F.sum(w * F.col(c)).alias(c) for s in sources for c in (s, f"bias_{s}")])
    rows = F.explode(F.array(*[F.struct(
        F.lit(s).alias("source"), (F.col(s) / F.col("_m")).alias("mae"), (F.col(f"bias_{s}") / F.col("_m")).alias("bias"))
        for s in sources])).alias("x")
    return sums.where("_m > 0").select(*group, rows).select(*group, "x.*")


def flipped_sums(rows: DataFrame, unit: str, columns: list[str], n_rep: int, seed: int) -> DataFrame:
    """(rep, columns): sums over units, each unit's row taken with its sign of the replicate.

    A digest gives a unit 32 signs, the same in any engine. A task holds a range of units and of replicates, and
    multiplies a matrix of signs with its rows; one row per replicate leaves it.
    """
    per_block = _BLOCK * BLOCKS_AT_ONCE
    dealt, _ = _by_block(rows.select(F.col(unit).cast("string").alias("_unit"), *[F.col(c).cast("double").alias(c) for c in columns]),
                         "_unit", n_rep, per_block, 50_000)

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        first = int(frame["_block"].iat[0]) * BLOCKS_AT_ONCE
        blocks = range(first, min(first + BLOCKS_AT_ONCE, math.ceil(n_rep / _BLOCK)))
        out = np.zeros((len(blocks), _BLOCK, len(columns)))
        for digests, values in _digested(frame, columns):
            total = values.sum(axis=0)
            for at, block in enumerate(blocks):
                words = digests.words(f"{seed}|{block}|".encode()).astype("<u4")
                bits = np.unpackbits(words.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").astype(float)
                out[at] += 2 * (bits.T @ values) - total
        sums = pd.DataFrame(out.reshape(-1, len(columns)), columns=columns)
        return sums.assign(rep=first * _BLOCK + np.arange(len(sums))).query(f"rep < {n_rep}")

    schema = ", ".join([*[f"`{c}` double" for c in columns], "rep bigint"])
    return dealt.groupBy("_block", "_range").applyInPandas(summed, schema).groupBy("rep").agg(*[F.sum(c).alias(c) for c in columns])


def _digested(frame: pd.DataFrame, columns: list[str]) -> Iterator[tuple[variates.Digests, np.ndarray]]:
    """Digests of a task's units in their order, piece by piece, with the rows of each piece."""
    ordered = frame.sort_values("_unit")
    units, values = [u.encode() for u in ordered["_unit"]], ordered[columns].to_numpy(float)
    for at in range(0, len(units), DIGESTED_AT_ONCE):
        yield variates.Digests(units[at:at + DIGESTED_AT_ONCE]), values[at:at + DIGESTED_AT_ONCE]


def cluster_sign_flip(errors: DataFrame, subject: str, sources: list[str], n_rep: int, seed: int) -> DataFrame:
    """All source pairs on mean absolute error, flipping whole subjects; p is never 0.

    A flipped difference of two sources is the difference of their flipped sums,
    so subjects carry one value per source and pairs are formed from replicate
    sums.
    """
    totals = errors.agg(F.sum("m").alias("n_cases"), *[F.sum(c).cast("double").alias(f"obs_{c}") for c in sources])
    sums = attach_single(flipped_sums(errors, subject, sources, n_rep, seed), totals)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) - F.col(b)).alias("s"), (F.col(f"obs_{a}") - F.col(f"obs_{b}")).alias("obs"))
        for i, a in enumerate(sources) for b in sources[i + 1:]])).alias("x")
    rows = sums.select("rep", "n_cases", pairs).select("rep", "n_cases", "x.*").withColumns({"n": F.lit(0), "sq": F.lit(0)})
    return exceedance(rows, ["a", "b", "n_cases"], 1e-9).select(
        "a", "b", (F.col("obs") / F.col("n_cases")).alias("diff"),
        ((F.col("exceed") + 1) / (F.col("n_rep") + 1)).alias("p"))


def _by_block(rows: DataFrame, unit: str, n_rep: int, block: int, per_task: int) -> tuple[DataFrame, list[int]]:
    """Rows of units dealt to (hash range of units, block of replicates), and the units of every range.

    The number of ranges is a power of two, so that a range holds about `per_task` units; a row goes to every block.
    """
    sizes = _range_sizes(rows, unit, per_task)
    blocks = F.sequence(F.lit(0), F.lit(math.ceil(n_rep / block) - 1))
    return rows.withColumn("_range", _range_of(unit, len(sizes))).withColumn("_block", F.explode(blocks)), sizes


def _bucket(unit: str) -> Column:
    return F.pmod(F.xxhash64(unit), F.lit(_BUCKETS)).cast("int")


def _range_of(unit: str, ranges: int) -> Column:
    return F.floor(_bucket(unit) / (_BUCKETS // ranges)).cast("int")


def _range_sizes(rows: DataFrame, unit: str, per_task: int) -> list[int]:
    sizes = [0] * _BUCKETS  # at most 4096 rows reach the driver
    for row in rows.groupBy(_bucket(unit).alias("bucket")).agg(F.count_distinct(unit).alias("n")).collect():
        sizes[row["bucket"]] = row["n"]
    total, ranges = sum(sizes), 1
    while ranges < _BUCKETS and total > ranges * per_task:
        ranges *= 2
    width = _BUCKETS // ranges
    return [sum(sizes[i:i + width]) for i in range(0, _BUCKETS, width)]


def _arrangements(k: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders of k places as two tables: per choice of the first places, the orders of those and of the others.

    (choices, orders, LANES or fewer) each. An order of all is a choice and an order from either table.
    """
    choices = list(combinations(range(k), min(k, LANES)))
    return tuple(np.array([list(permutations(part)) for part in parts], dtype=np.intp) for parts in (
        choices, [tuple(i for i in range(k) if i not in c) for c in choices]))


def _below(rng: np.random.Generator, bound: int, out: np.ndarray) -> np.ndarray:
    """Uniform whole numbers below a bound under 2**31, as many as `out` (64 bits) has: the high half of a 32-bit word times the bound.

    Words whose low half shows a bias are drawn again.
    """
    size = len(out)
    words = rng.integers(0, 1 << 64, (size + 1) // 2, dtype=np.uint64, endpoint=False).view(np.uint32)[:size]
    np.multiply(words, np.uint64(bound), out=out, dtype=np.uint64)
    low, biased = out.view(np.uint32)[_LOW_HALF::2], (1 << 32) % bound
    again = np.flatnonzero(low < biased) if low.min() < biased else ()
    np.right_shift(out, np.uint64(32), out=out)
    for at in again:
        out[at] = rng.integers(0, bound)
    return out.view(np.int64)


def _steps(values: np.ndarray) -> np.ndarray | None:
    """Values as whole steps where they are short ones, so that sums of a lane of 16 bits are exact; else None."""
    steps = values * STEPS
    fits = 0 <= steps.min() and steps.max() < LANE_MOST and (steps == np.floor(steps)).all()
    return steps.astype(np.uint16) if fits else None


class _PermutedSums:
    """Sums over units of their values in random order, a row per replicate.

    Up to TABLED values, an order is one entry of the unit's table of all of them. Short whole steps, such as halves, are
    added four to a word and carried over before a lane is full; other values are added as doubles.
    """

    def __init__(self, k: int, reps: int):
        self.k, self.orders = k, math.factorial(k)
        self.sums = np.zeros((reps, k))
        self.halves = _arrangements(k) if k <= TABLED else None
        self.words = np.zeros((reps, -(-k // LANES)), dtype=np.uint64)
        self.held = 0  # the most that a lane may hold
        self.drawn = np.empty(ORDERED_AT_ONCE, dtype=np.uint64)
        self.picked = {kind: np.empty((ORDERED_AT_ONCE, rows.shape[1]), dtype=kind) for kind, rows in ((float, self.sums), (np.uint64, self.words))}

    def add(self, values: np.ndarray, rng: np.random.Generator) -> None:
        steps = _steps(values) if self.halves else None
        if steps is not None:
            if self.held + int(steps.max()) > LANE_MOST:
                self.carry()
            self.held += int(steps.max())
        target, kind = (self.sums, float) if steps is None else (self.words, np.uint64)
        table = None if self.halves is None else self._doubles(values) if steps is None else self._packed(steps)
        for at in range(0, len(target), ORDERED_AT_ONCE):
            part = target[at:at + ORDERED_AT_ONCE]
            if table is None:
                part += rng.permuted(np.tile(values, (len(part), 1)), axis=1)
            else:
                part += np.take(table, _below(rng, self.orders, self.drawn[:len(part)]), axis=0, mode="clip", out=self.picked[kind][:len(part)])

    def _doubles(self, values: np.ndarray) -> np.ndarray:
        first, rest = self.halves
        table = np.empty((*first.shape[:2], rest.shape[1], self.k))
        table[..., :first.shape[2]], table[..., first.shape[2]:] = values[first][:, :, None], values[rest][:, None]
        return table.reshape(self.orders, self.k)

    def _packed(self, steps: np.ndarray) -> np.ndarray:
        packed = []
        for half in self.halves[:self.words.shape[1]]:
            lanes = np.zeros((*half.shape[:2], LANES), dtype=np.uint16)
            lanes[..., :half.shape[2]] = steps[half]
            packed.append(lanes.view(np.uint64)[..., 0])
        table = np.empty((len(packed[0]), packed[0].shape[1], packed[-1].shape[1] if len(packed) > 1 else 1, len(packed)), dtype=np.uint64)
        table[..., 0] = packed[0][:, :, None]
        if len(packed) > 1:
            table[..., 1] = packed[1][:, None]
        return table.reshape(self.orders, len(packed))

    def carry(self) -> None:
        """Empty the lanes into the sums."""
        self.sums += self.words.view(np.uint16)[:, :self.k] / STEPS
        self.words[:] = 0
        self.held = 0


def omnibus(errors: DataFrame, subject: str, sources: list[str], n_rep: int, seed: int) -> DataFrame:
    """Do all sources have the same mean absolute error? Labels are permuted within subjects.

    A task holds a part of the subjects and a block of replicates, as many as a table of sums may have rows. Every subject
    has a generator of its own and block, which draws a whole order of its values for every replicate; the task adds
    them up over all its subjects. One row per replicate leaves a task, whatever the number of subjects.
    """
    k = len(sources)
    places = [f"p{i}" for i in range(k)]
    rows = errors.select(F.col(subject).cast("string").alias("_unit"), *[F.col(s).cast("double").alias(s) for s in sources])
    spark = rows.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = max(1, min(most, math.ceil(rows.count() / UNITS_A_PART)))
    blocks = math.ceil(n_rep / ORDER_BLOCK)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_unit"), F.lit(parts))).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(
        parts * blocks, "_block", "_part").sortWithinPartitions("_block", "_unit").select("_block", "_unit", *sources)

    def permuted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((block, unit, value) for batch in batches for block, unit, value in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.stack([batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(k)], axis=1)))
        for block, units in groupby(pieces, lambda piece: piece[0]):
            held = _PermutedSums(k, min(ORDER_BLOCK, n_rep - block * ORDER_BLOCK))
            for _, unit, values in units:
                held.add(values, variates.generator(seed, "order", block, unit, kind=np.random.SFC64))
            held.carry()
            for at in range(0, len(held.sums), ORDERED_AT_ONCE):
                some = held.sums[at:at + ORDERED_AT_ONCE]
                yield pa.RecordBatch.from_arrays([*map(pa.array, some.T), pa.array(block * ORDER_BLOCK + at + np.arange(len(some)))], names=[*places, "rep"])

    stat = dealt.mapInArrow(permuted, ", ".join(f"{p} double" for p in places) + ", rep bigint").groupBy(
        "rep").agg(*[F.sum(p).alias(p) for p in places])

    def variance(columns, n):
        means = [c / n for c in columns]
        centre = sum(means[1:], means[0]) / k
        return sum([(m - centre) * (m - centre) for m in means[1:]], (means[0] - centre) * (means[0] - centre)) / k

    observed = errors.agg(F.sum("m").alias("n"), *[F.sum(s).alias(s) for s in sources]).select(
        "n", variance([F.col(s) for s in sources], F.col("n")).alias("statistic"))
    null = attach_single(stat, observed).select("statistic", variance([F.col(p) for p in places], F.col("n")).alias("v"))
    return null.groupBy("statistic").agg(
        ((F.sum((F.col("v") >= F.col("statistic") - 1e-12).cast("int")) + 1) / (F.count("*") + 1)).alias("p"))


def numbered(ids: DataFrame, key: str) -> DataFrame:
    """Dense numbers 0..n-1 in hash order, with n, without ordering all ids in one task.

    Ids are spread evenly over 4096 hash buckets, numbered inside their bucket,
    and shifted by the counts of the buckets before it.
    """
    hashed = ids.select(key, R.digest(F.col(key)).alias("_h")).withColumn("_bucket", F.substring("_h", 1, 3))
    sizes = hashed.groupBy("_bucket").agg(F.count("*").alias("_size"))
    all_buckets = Window.partitionBy(F.lit(1))
    before = all_buckets.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"),
                          F.sum("_size").over(all_buckets).alias("n"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key)) - 1
    # At most 4096 bucket rows: three hex digits bound the broadcast.
    return hashed.withColumn("_in", inside).join(F.broadcast(shifts), "_bucket").select(
        key, (F.col("_in") + F.col("_shift")).alias("idx"), "n")


def _drawn(block: int, leaf: int, units: int, sizes: list[int], n_rep: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(replicates, weights of the range's units in their order) in pieces of at most about DRAWN_AT_ONCE weights."""
    reps = block * BOOT_BLOCK + np.arange(min(BOOT_BLOCK, n_rep - block * BOOT_BLOCK))
    draws = variates.descend(seed, block, np.full(len(reps), sum(sizes)), sizes, leaf)
    rng = variates.generator(seed, "units", block, leaf, len(sizes))
    step = max(1, min(HELD, DRAWN_AT_ONCE) // max(units, 1))
    for at in range(0, len(reps), step):
        yield reps[at:at + step], variates.spread_draws(rng, draws[at:at + step], units)


def _place_of(frame: pd.DataFrame) -> tuple[int, int, int]:
    return int(frame["_block"].iat[0]), int(frame["_range"].iat[0]), len(frame)


def _per_task(width: int) -> int:
    """Units of a task whose rows are so wide."""
    return max(1000, min(50_000, HELD // max(width, 1)))


def bootstrap_weights(subjects: DataFrame, subject: str, n_rep: int, seed: int) -> DataFrame:
    """(subject, rep, w): how often each subject is drawn, as rows; w is never 0 and adds up to the subjects in each replicate.

    The draws of a replicate are split down a tree of hash ranges by seeded binomials, and a task deals those that
    reach its own range over its subjects, so no draw is shuffled.
    """
    kind = dict(subjects.dtypes)[subject]
    dealt, sizes = _by_block(subjects.select(F.col(subject).alias("_unit")), "_unit", n_rep, BOOT_BLOCK, _per_task(1))

    def drawn(frame: pd.DataFrame) -> pd.DataFrame:
        units, out = np.sort(frame["_unit"].to_numpy()), []
        for reps, weights in _drawn(*_place_of(frame), sizes, n_rep, seed):
            rep, unit = np.nonzero(weights)
            out.append(pd.DataFrame({"unit": units[unit], "rep": reps[rep], "w": weights[rep, unit]}))
        return pd.concat(out)

    return dealt.groupBy("_block", "_range").applyInPandas(drawn, f"unit {kind}, rep bigint, w bigint").withColumnRenamed("unit", subject)


def bootstrap_sums(rows: DataFrame, subject: str, columns: list[str], n_rep: int, seed: int) -> DataFrame:
    """(rep, columns): sums of one row per subject under the draws of every replicate.

    A task multiplies the weights of its own subjects with their rows; what leaves it is one row per replicate.
    """
    dealt, sizes = _by_block(rows.select(F.col(subject).alias("_unit"), *[F.col(c).cast("double").alias(c) for c in columns]),
                             "_unit", n_rep, BOOT_BLOCK, _per_task(len(columns)))

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        values = frame.sort_values("_unit")[columns].to_numpy(float)
        return pd.concat([pd.DataFrame(weights @ values, columns=columns).assign(rep=reps)
                          for reps, weights in _drawn(*_place_of(frame), sizes, n_rep, seed)])

    schema = ", ".join([*[f"`{c}` double" for c in columns], "rep bigint"])
    return dealt.groupBy("_block", "_range").applyInPandas(summed, schema).groupBy("rep").agg(*[F.sum(c).alias(c) for c in columns])


def bootstrap_counts(cases: DataFrame, subject: str, keys: list[str], n_rep: int, seed: int) -> DataFrame:
    """(rep, keys, w): how many drawn cases have each combination of the keys; for keys of a closed domain.

    Cases are counted per subject first, and combinations are numbered. A task holds some ranges of subjects and some
    blocks of replicates; range by range it multiplies the weights with a matrix of counts, a column per combination.
    It adds its ranges up, so a row per replicate and combination leaves it, not one per range too.
    """
    entries = cases.groupBy(F.col(subject).alias("_unit"), *keys).agg(F.count("*").alias("_n"))
    places = materialise(entries.select(*keys).distinct().withColumn(
        "_place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*keys)) - 1), "places")
    combinations = places.count()
    named = places.select("_place", *[F.col(k).alias(f"_k_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    listed = entries.join(named, same).groupBy("_unit").agg(F.collect_list(F.struct("_place", "_n")).alias("_e")).select(
        "_unit", F.col("_e._place").alias("_places"), F.col("_e._n").alias("_counts"))
    listed = materialise(listed, "listed")
    sizes = _range_sizes(listed, "_unit", _per_task(combinations))
    ranges, blocks = len(sizes), math.ceil(n_rep / BOOT_BLOCK)
    parts, shares = min(ranges, COUNT_PARTS), min(blocks, COUNT_SHARES)
    placed = listed.withColumn("_range", _range_of("_unit", ranges)).withColumn("_part", F.col("_range") % parts).withColumn(
        "_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    by = ["_share", "_part", "_range"]
    dealt = placed.repartition(parts * shares, "_share", "_part").sortWithinPartitions(*by, "_unit").select(*by, "_places", "_counts")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (share, _), held in groupby(_whole_ranges(batches), lambda piece: piece[0][:2]):
            sums = {block: np.zeros((min(BOOT_BLOCK, n_rep - block * BOOT_BLOCK), combinations)) for block in range(share, blocks, shares)}
            for (*_, leaf), table in held:
                lengths, places = pc.list_value_length(table["_places"]).to_numpy(), _values(table["_places"])
                matrix = np.zeros((len(lengths), combinations), dtype=np.float32)
                n = _values(table["_counts"])
                matrix[np.repeat(np.arange(len(lengths)), lengths), places] = n
                for block, total in sums.items():
                    for reps, weights in _drawn(block, leaf, len(matrix), sizes, n_rep, seed):
                        # Single precision holds whole numbers up to 2**24: beyond, the product is taken in double.
                        kind = np.float32 if weights.sum(axis=1).max() * n.max() < 2**24 else np.float64
                        at = reps - block * BOOT_BLOCK
                        total[at] += weights.astype(kind) @ matrix.astype(kind, copy=False)
            for block, total in sums.items():
                rep, place = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(block * BOOT_BLOCK + rep), pa.array(place), pa.array(total[rep, place].astype(np.int64))],
                                                 names=["rep", "_place", "w"])

    drawn = dealt.mapInArrow(counted, "rep bigint, _place bigint, w bigint").groupBy("rep", "_place").agg(F.sum("w").alias("w"))
    return drawn.join(places, "_place").select("rep", *keys, "w")


def _values(lists: pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy()


def _whole_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """((share, part, range), its rows) of batches sorted by them; one range is held at a time."""
    key, held = None, []
    for batch in batches:
        places = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1), len(places)]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                own = tuple(map(int, places[start]))
                if own != key and held:
                    yield key, pa.Table.from_batches(held)
                    held = []
                key = own
                held.append(batch.slice(start, end - start))
    if held:
        yield key, pa.Table.from_batches(held)


def bootstrap_errors(errors: DataFrame, subject: str, sources: list[str], n_rep: int, seed: int) -> DataFrame:
    """(rep, source, mae, bias): subject sums under the draws of every replicate."""
    columns = ["m", *[c for s in sources for c in (s, f"bias_{s}")]]
    return mean_errors(bootstrap_sums(errors, subject, columns, n_rep, seed), ["rep"], sources)


def _poisson_steps() -> list[float]:
    """Bounds of a uniform draw at which a Poisson(1) weight goes up by one; weights end at 12."""
    steps, term, total = [], math.exp(-1.0), math.exp(-1.0)
    for k in range(1, 13):
        steps.append(total)
        term /= k
        total += term
    return steps


def poisson_weights(rows: DataFrame, subject: str, n_rep: int, seed: int) -> DataFrame:
    """`rows` with rep and an independent Poisson(1) weight w per subject: no draw leaves its row.

    The shuffle-free alternative for very many subjects; the multinomial above
    is this distribution given its total. Weights end at 12: the next has less
    probability than one step of the 32-bit draw.
    """
    unit = R.bits32(R.digest("poisson", seed, F.col("rep"), F.col(subject))) / F.lit(4294967296.0)
    w = sum([F.when(unit >= step, 1).otherwise(0) for step in _poisson_steps()], F.lit(0))
    return (_fan_out(rows, [subject]).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))))
            .withColumn("w", w).where(F.col("w") > 0))


def poisson_sums(rows: DataFrame, subject: str, columns: list[str], n_rep: int, seed: int) -> DataFrame:
    """(rep, columns): sums over rows, each taken with the Poisson weight that `poisson_weights` gives its subject.

    A task holds a range of subjects and of replicates and multiplies the weights with its rows; one row per
    replicate leaves it, never a row per subject and replicate.
    """
    dealt, _ = _by_block(rows.select(F.coalesce(F.concat(F.lit("|"), F.col(subject).cast("string")), F.lit("")).alias("_unit"), *[
        F.col(c).cast("double").alias(c) for c in columns]), "_unit", n_rep, BOOT_BLOCK, 50_000)
    # A draw is a 32-bit number over 2**32, so its bounds are whole numbers.
    steps = [np.uint32(word) for word in (math.ceil(step * 2**32) for step in _poisson_steps()) if word < 2**32]

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        first = int(frame["_block"].iat[0]) * BOOT_BLOCK
        reps = np.arange(first, min(first + BOOT_BLOCK, n_rep))
        out = np.zeros((len(reps), len(columns)))
        for digests, values in _digested(frame, columns):
            for at, rep in enumerate(reps):
                words = digests.words(f"poisson|{seed}|{rep}".encode())
                weights = np.zeros(len(words), dtype=np.uint8)
                for step in steps:
                    weights += words >= step
                out[at] += weights @ values
        return pd.DataFrame(out, columns=columns).assign(rep=reps)

    schema = ", ".join([*[f"`{c}` double" for c in columns], "rep bigint"])
    return dealt.groupBy("_block", "_range").applyInPandas(summed, schema).groupBy("rep").agg(*[F.sum(c).alias(c) for c in columns])


def poisson_errors(errors: DataFrame, subject: str, sources: list[str], n_rep: int, seed: int) -> DataFrame:
    """(rep, source, mae, bias): subject sums under the Poisson weights of every replicate."""
    columns = ["m", *[c for s in sources for c in (s, f"bias_{s}")]]
    return mean_errors(poisson_sums(errors, subject, columns, n_rep, seed), ["rep"], sources)


def bootstrap_metrics(cases: DataFrame, subject: str, n_rep: int, seed: int) -> DataFrame:
    """Every metric per replicate and source, all sources on the same draws.

    Drawn cases are joint counts of (h, y, init) before any metric.
    """
    counts = bootstrap_counts(cases, subject, ["source", "h", "y", "init"], n_rep, seed)
    return M.all_metrics(counts, ["rep", "source"], F.col("w"))


def percentile_interval(df: DataFrame, group: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Inverted-CDF interval: picks observed replicate values, so infinities survive."""
    return df.groupBy(*group).agg(
        F.expr(f"percentile_disc({alpha / 2}) WITHIN GROUP (ORDER BY {value})").alias("lo"),
        F.expr(f"percentile_disc({1 - alpha / 2}) WITHIN GROUP (ORDER BY {value})").alias("hi"))


def rank_replicates(reps: DataFrame, metric: str) -> DataFrame:
    """Rank of each source within each replicate; ties share the better rank, null goes last."""
    value = F.coalesce(F.col(metric), F.lit(float("inf")))
    return reps.withColumn("place", F.rank().over(Window.partitionBy("rep").orderBy(value)))


def point_ranks(point: DataFrame, metric: str, ranked: list[str]) -> DataFrame:
    """(source, place) among the ranked sources; ties share the better rank, null goes last."""
    order = Window.partitionBy(F.lit(1)).orderBy(F.coalesce(F.col(metric), F.lit(float("inf"))))
    return point.where(F.col("source").isin(ranked)).select("source", F.rank().over(order).alias("place"))


def rank_summary(point: DataFrame, reps: DataFrame, metric: str, ranked: list[str]) -> DataFrame:
    """Estimate, interval, rank, rank interval and the share of replicates ranked first."""
    among = F.col("source").isin(ranked)
    places = rank_replicates(reps.where(among), metric)
    ci = percentile_interval(reps, ["source"], metric)
    rank_ci = percentile_interval(places, ["source"], "place").withColumnsRenamed({"lo": "rank_lo", "hi": "rank_hi"})
    best = places.groupBy("source").agg(F.avg((F.col("place") == 1).cast("int")).alias("p_best"))
    rank = point_ranks(point, metric, ranked)
    return (point.select("source", F.col(metric).alias("estimate")).join(ci, "source").join(rank, "source", "left")
            .join(rank_ci, "source", "left").join(best, "source", "left"))


def pairwise(mae_reps: DataFrame, flips: DataFrame, sources: list[str], alpha: float = 0.05) -> DataFrame:
    """Source pairs with difference, bootstrap interval, p and the family-wise flag."""
    n_pairs = len(sources) * (len(sources) - 1) // 2
    wide = mae_reps.groupBy("rep").pivot("source", sources).agg(F.max("mae"))
    pairs = [(a, b) for i, a in enumerate(sources) for b in sources[i + 1:]]
    diffs = wide.select("rep", F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs
    ])).alias("x")).select("rep", "x.*")
    ci = percentile_interval(diffs, ["a", "b"], "d", 0.05)
    return flips.join(ci, ["a", "b"]).withColumn("significant", F.col("p") < alpha / n_pairs)
