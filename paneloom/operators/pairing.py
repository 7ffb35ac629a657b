"""Pairing of sources on (subject, item, round): cardinality, coverage and condition checks.

Long form throughout: one row per case and source. A panel of N sources is
assembled by one grouped pivot, not by N joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from paneloom.session import materialise

KEYS = ["subject", "item", "round"]


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row; empty when the side is one-to-one."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df`, which stops the job where a key repeats; it shares the shuffle of a join on the same keys."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    stop = F.raise_error(F.concat(F.lit("key is not unique: "), F.to_json(F.struct(*keys)))).cast("bigint")
    return df.withColumn("_n", F.when(n > 1, stop).otherwise(n)).where("_n = 1").drop("_n")


def pair(base: DataFrame, cand: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of two sources; every non-key column gets the suffix _b or _c. The base has each key once."""
    left = once(base, keys).select(*keys, *[F.col(c).alias(f"{c}_b") for c in base.columns if c not in keys])
    right = cand.select(*keys, *[F.col(c).alias(f"{c}_c") for c in cand.columns if c not in keys])
    return left.join(right, keys, how)


def require_unique(df: DataFrame, keys: list[str]) -> None:
    """Stop when a key repeats. Reads one row back at most."""
    hit = duplicate_keys(df, keys).limit(1).collect()
    if hit:
        raise ValueError(f"key is not unique: {hit[0].asDict()}")


def require_empty(df: DataFrame, message: str) -> None:
    """Stop when the frame has a row. Reads one row back at most."""
    hit = df.limit(1).collect()
    if hit:
        raise ValueError(f"{message}: {hit[0].asDict()}")


def condition_mismatches(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose condition column differs; null-safe."""
    return pairs.where(~F.col(left).eqNullSafe(F.col(right)))


def coverage_gaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by only one side, with the side named."""
    a = left.select(*keys).distinct()
    b = right.select(*keys).distinct()
    return (a.join(b, keys, "left_anti").withColumn("only_in", F.lit("left"))
            .unionByName(b.join(a, keys, "left_anti").withColumn("only_in", F.lit("right"))))


def pairing_audit(base: DataFrame, cand: DataFrame, keys: list[str], group: list[str],
                  conditions: list[str]) -> DataFrame:
    """Full-outer audit: unmatched rows, then differing conditions among matched rows."""
    b = base.select(*group, *keys, *[F.col(c).alias(f"{c}_b") for c in conditions], F.lit(1).alias("in_b"))
    c = cand.select(*group, *keys, *[F.col(x).alias(f"{x}_c") for x in conditions], F.lit(1).alias("in_c"))
    both = b.join(c, group + keys, "full_outer")
    matched = F.col("in_b").isNotNull() & F.col("in_c").isNotNull()
    return both.groupBy(*group).agg(
        F.sum(F.when(~matched, 1).otherwise(0)).alias("unmatched"),
        *[F.sum(F.when(matched & ~F.col(f"{x}_b").eqNullSafe(F.col(f"{x}_c")), 1).otherwise(0))
          .alias(f"differs_{x}") for x in conditions],
    )


def assemble(panel: DataFrame, sources: list[str], keys: list[str] = KEYS,
             carry: tuple[str, ...] = ("cell", "init", "h", "polarity")) -> DataFrame:
    """One row per case, one column per source holding its belief; one shuffle. A repeated answer stops the job."""
    def only(source: str) -> Column:
        own = F.col("source") == source
        stop = F.raise_error(F.lit(f"{source} answers a case twice")).cast(panel.schema["y"].dataType)
        return F.when(F.count(F.when(own, 1)) > 1, stop).otherwise(F.max(F.when(own, F.col("y")))).alias(source)

    return panel.groupBy(*keys).agg(*[F.max(c).alias(c) for c in carry], *[only(s) for s in sources])


def complete_cases(wide: DataFrame, sources: list[str]) -> DataFrame:
    """Cases every source answered."""
    return wide.dropna(subset=sources)


def dropped_counts(wide: DataFrame, sources: list[str]) -> DataFrame:
    """Cases each source failed to answer."""
    counts = wide.agg(*[F.sum(F.col(s).isNull().cast("long")).alias(s) for s in sources])
    return melt(counts, [], sources, "source", "n_dropped")


def melt(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """Wide to long without a shuffle."""
    return df.unpivot(ids or [F.lit(0).alias("_none")], values, name, value).drop("_none")


def long_cases(wide: DataFrame, sources: list[str], ids: list[str]) -> DataFrame:
    """Complete wide frame back to one row per case and source."""
    return wide.unpivot(ids, sources, "source", "y")


def shared_keys(df: DataFrame, keys: list[str], source: str, n_sources: int) -> DataFrame:
    """Keys present in all sources."""
    return (df.select(*keys, source).distinct().groupBy(*keys)
            .agg(F.count("*").alias("n_sources")).where(F.col("n_sources") == n_sources).select(*keys))


def remaining(todo: DataFrame, done: DataFrame, keys: list[str], expected: int | None = None) -> DataFrame:
    """What is left to run: keys not done, or done fewer than `expected` times."""
    counts = done.groupBy(*keys).agg(F.count("*").alias("n_done"))
    finished = counts if expected is None else counts.where(F.col("n_done") >= expected)
    return todo.join(finished, keys, "left_anti")


def lookup_exactly_one(df: DataFrame, prior: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Attach a prior run's value; stops when a key has no or several prior rows."""
    one = prior.groupBy(*keys).agg(F.count("*").alias("n_prior"), F.max(value).alias(value))
    found = df.join(one, keys, "left")
    ok = F.coalesce(F.col("n_prior"), F.lit(0)) == 1
    stop = F.raise_error(F.lit("expected exactly one prior row")).cast(prior.schema[value].dataType)
    return found.withColumn(value, F.when(ok, F.col(value)).otherwise(stop)).drop("n_prior")


def source_pairs(order: DataFrame) -> DataFrame:
    """Unordered pairs of sources, the one with the smaller `ord` first.

    Takes the short list of sources (a registry), never panel rows.
    """
    a = order.select(F.col("source").alias("a"), F.col("ord").alias("ord_a"))
    b = order.select(F.col("source").alias("b"), F.col("ord").alias("ord_b"))
    return a.join(b, F.col("ord_a") < F.col("ord_b")).select("a", "b", "ord_a", "ord_b")


def skip_reasons(matched: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Name the first rule that excludes a row; null means it is kept."""
    reason = reduce(lambda acc, rule: F.when(rule[1], rule[0]).otherwise(acc),
                    reversed(rules), F.lit(None).cast("string"))
    return matched.withColumn("reason", reason)


def attach_dimension(df: DataFrame, dimension: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join one row per key of a dimension; the join strategy is left to the size estimate."""
    return df.join(dimension.dropDuplicates([key]), key, how)


def attach_short(df: DataFrame, short: DataFrame, keys: list[str], how: str = "inner", most_rows: int = 10_000) -> DataFrame:
    """Join a table of few rows per design, such as one row per cell.

    It is written once and counted. Up to `most_rows` it is broadcast, so rows are
    not dealt by a key with few values; beyond that it is an ordinary join.
    """
    held = materialise(short, "short")
    return df.join(F.broadcast(held) if held.count() <= most_rows else held, keys, how)


def first_text(messages: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """First-seen text per key."""
    return messages.groupBy(*keys).agg(F.min_by(text, order).alias(text))


def restrict(df: DataFrame, item: str | None = None, cell: str | None = None,
             must_hold: bool = True) -> DataFrame:
    """Rows of a design cell; an empty cell is an error, for it means a wrong name."""
    out = df
    if item is not None:
        out = out.where(F.col("item") == item)
    if cell is not None:
        out = out.where(F.col("cell") == cell)
    if must_hold and (item is not None or cell is not None) and out.isEmpty():
        raise ValueError(f"no rows for item={item}, cell={cell}")
    return out


def require_no_nulls(df: DataFrame, columns: list[str], context: str = "") -> DataFrame:
    """A frame that stops the job at the first null or NaN in the named columns."""
    out = df
    for name in columns:
        missing = F.col(name).isNull()
        if df.schema[name].dataType.typeName() in ("double", "float"):
            missing = missing | F.isnan(name)
        stop = F.raise_error(F.lit(f"null in {name}{context}; drop or fill it explicitly"))
        out = out.withColumn(name, F.when(missing, stop.cast(df.schema[name].dataType)).otherwise(F.col(name)))
    return out


def null_counts(df: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*group).agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in columns])


def first_subjects(df: DataFrame, subject: str, n: int) -> DataFrame:
    """Rows of the first n subjects in sort order.

    The n subjects come from a top-n over distinct ids, not from a global window.
    """
    chosen = df.select(subject).distinct().orderBy(subject).limit(n)
    return df.join(chosen, subject, "left_semi")


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the last row of each key in arrival order.

    A grouped maximum with map-side combine, so a hot key shrinks before the shuffle.
    """
    others = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])


def rank_within(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Ties share the better rank. For short result tables."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(*order)))


def attach_single(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate to every row.

    `one_row` is an aggregate without grouping keys and so has exactly one row;
    that bound is what allows the broadcast.
    """
    left, right = df.withColumn("_one", F.lit(1)), one_row.withColumn("_one", F.lit(1))
    return left.join(F.broadcast(right), "_one").drop("_one")
