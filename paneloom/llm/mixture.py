"""Mix sources to target weights by equal-token blocks, apportioned by highest quotients.

Every source has a target of words. Blocks of `block` words are awarded to sources,
then to groups of shards and to the shards of a source, each time to the highest
quotient votes / (2 k + 1). A shard is a bounded, seeded part of one source; its
blocks are stretches of its documents in seeded order. A quota above the number of
blocks repeats all of them, and what is left goes to blocks spread evenly from a
seeded start. A document takes what its words have in the chosen blocks.

DataFrame functions only. A hot source is many shards; the orderings run over one
row per source, at most `fan` shards, or one shard's documents. A null text has size
0, a null source is a source of its own and comes last, repeated rows count each,
and an empty table gives an empty mix. Ties in quotients go to the lower shard, or
to the smaller source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paneloom.session import materialise


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def hashed(*parts: Column) -> Column:
    """32 bits of the parts' digest, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 8), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Sources with weight and target: shares by weight, none above `most` times its size.

    Resharing the excess until none is above fills the sources in the order of
    size per weight; the first that its share does not fill fixes the level of all
    after it.
    """
    every = Window.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weighted = ranked.withColumn("weight", F.element_at(
        F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    filled = weighted.withColumn("cap", most * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = filled.withColumn("level", (
        F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    capped = F.col("fill") < F.col("level")
    final = level.withColumn("common", F.max(F.when(~capped, F.col("level"))).over(every))
    return final.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(F.col("common") * F.col("weight")))


def sainte_lague(units: DataFrame, by: list[str], votes: str, seats: str, name: str, won: str) -> DataFrame:
    """`units` with the seats each has won of its group's `seats`, by the highest quotients votes / (2 k + 1).

    A unit's seats lie within one of its share or so: only quotients between two
    divisors that award surely too little and surely enough are ranked, about two
    per unit, however many seats there are.
    """
    group = Window.partitionBy(*by)
    near = units.withColumn("_all", F.sum(votes).over(group)).withColumn("_units", F.count(F.lit(1)).over(group))

    def at(sign: int) -> Column:
        level = F.greatest(F.lit(0.0), F.col(seats) + sign * F.col("_units") / 2) / F.col("_all")
        return F.when(F.col("_all") > 0, F.floor(F.col(votes) * level + 0.5)).otherwise(0).cast("bigint")

    sure = near.withColumn("_sure", at(-1)).withColumn("_open", F.greatest(at(1), F.col("_sure")))
    sure = sure.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    quotients = sure.withColumn("_k", F.explode(F.sequence("_sure", "_open"))).withColumn(
        "_quotient", F.col(votes) / (2 * F.col("_k") + 1))
    order = Window.partitionBy(*by).orderBy(F.desc("_quotient"), F.asc_nulls_last(name), "_k")
    placed = quotients.withColumn("_place", F.row_number().over(order))
    award = F.sum(F.when((F.col("_place") <= F.col("_left")) & (F.col("_all") > 0), 1).otherwise(0))
    return placed.groupBy(*units.columns).agg((F.first("_sure") + award).cast("bigint").alias(won))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 64,
        shard_words: int = 1 << 17, fan: int = 1024, salts: int = 64, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target of the source, and the words the mix takes of each document.

    `keep` names short columns that go along with their rows.
    """
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    sized = materialise(docs.select(
        "doc_id", "source", words_of(F.col("text")).alias("size"), key.alias("key"),
        F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string"))).alias("order"), *keep), "mix-sizes")
    sources = targets(sized.groupBy("key", "source").agg(F.sum("size").alias("source_size")), weights, most)
    sources = sources.withColumn("blocks", F.round(F.sum("source_size").over(Window.partitionBy()) / block).cast("bigint"))
    sources = sainte_lague(
        sources.select("key", "source", "rank", "source_size", "target", "blocks"), [], "target", "blocks", "rank", "quota")
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("bigint"))

    # One row per source meets every document: dealt by source and a salt, so no source is one task's.
    salted = sources.select("key", "source_size", "target", "quota", "shards", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    spread = sized.withColumn("salt", (F.conv(F.substring("order", 9, 8), 16, 10) % salts).cast("int"))
    placed = spread.join(salted, ["key", "salt"]).withColumn(
        "shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint") % F.col("shards"))
    shards = placed.groupBy("key", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota")).withColumn(
        "part", F.floor(F.col("shard") / fan))
    parts = sainte_lague(
        shards.groupBy("key", "part").agg(F.sum("words").alias("part_words"), F.first("quota").alias("quota")),
        ["key"], "part_words", "quota", "part", "part_quota")
    shards = sainte_lague(
        shards.drop("quota").join(parts.select("key", "part", "part_quota"), ["key", "part"]),
        ["key", "part"], "words", "part_quota", "shard", "won")
    shards = shards.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("words") / block)).cast("bigint"))
    won = F.least(F.col("won"), most * F.col("n"))
    shards = shards.select(
        "key", "shard", "n", F.floor(won / F.col("n")).alias("each"), (won % F.col("n")).alias("extra"),
        (hashed(F.lit(seed), F.col("key"), F.col("shard").cast("string")) % F.col("n")).alias("first"))

    stretch = Window.partitionBy("key", "shard").orderBy("order", "doc_id", "size")
    laid = placed.withColumn("upto", F.sum("size").over(stretch.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = laid.join(shards, ["key", "shard"])

    def extra(x: Column) -> Column:
        """Words in the blocks that get one more, among the first x words of the shard."""
        i = F.floor(x / block)
        chosen = lambda k: F.floor((k * F.col("extra") + F.col("first")) / F.col("n"))
        return block * chosen(i) + (chosen(i + 1) - chosen(i)) * (x - i * block)

    taken = F.col("each") * F.col("size") + extra(F.col("upto")) - extra(F.col("upto") - F.col("size"))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"), *keep)


# mix() in the order of its steps; divisions are of doubles, as above.
def _quotas(units: str, by: str, votes: str, seats: str, name: str, won: str, columns: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {columns}, CAST(any_value(_sure) + count(*) FILTER (WHERE _place <= _left AND _all > 0) AS BIGINT) AS {won}
  FROM (SELECT *, row_number() OVER ({part} ORDER BY {votes}::DOUBLE / (2 * _k + 1) DESC, {name} NULLS LAST, _k) AS _place
    FROM (SELECT *, unnest(range(_sure, greatest(_open, _sure) + 1)) AS _k
      FROM (SELECT *, {seats} - sum(_sure) OVER ({part}) AS _left
        FROM (SELECT *,
            CASE WHEN _all > 0 THEN CAST(floor({votes} * (greatest(0.0::DOUBLE, {seats} - _units::DOUBLE / 2) / _all::DOUBLE) + 0.5::DOUBLE) AS BIGINT) ELSE 0 END AS _sure,
            CASE WHEN _all > 0 THEN CAST(floor({votes} * (greatest(0.0::DOUBLE, {seats} + _units::DOUBLE / 2) / _all::DOUBLE) + 0.5::DOUBLE) AS BIGINT) ELSE 0 END AS _open
          FROM (SELECT *, sum({votes}) OVER ({part}) AS _all, count(*) OVER ({part}) AS _units FROM {units})))))
  GROUP BY {columns}"""


def mix_sql(documents: str = "documents", block: int = 64, shard_words: int = 1 << 17, fan: int = 1024,
            seed: str = "mix", most: int = 3) -> str:
    return rf"""
sized AS MATERIALIZED (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  coalesce('s' || source, 'n') AS key, md5('{seed}/' || doc_id) AS "order" FROM {documents}),
totals AS (SELECT key, source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY 1, 2),
weighted AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, {most} * source_size AS cap FROM totals),
levels AS (SELECT *, cap::DOUBLE / weight AS fill,
  (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM weighted WINDOW o AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS MATERIALIZED (SELECT key, source, rank, source_size, CASE WHEN fill < level THEN cap::DOUBLE
  ELSE max(CASE WHEN fill >= level THEN level END) OVER () * weight END AS target,
  CAST(round(sum(source_size) OVER () / {block}.0::DOUBLE) AS BIGINT) AS blocks FROM levels),
awarded AS MATERIALIZED (SELECT *, greatest(1, ceil(source_size / {shard_words}.0::DOUBLE))::BIGINT AS shards FROM (
  {_quotas('aims', '', 'target', 'blocks', 'rank', 'quota', 'key, source, rank, source_size, target, blocks')})),
placed AS MATERIALIZED (SELECT s.*, source_size, target, quota, ('0x' || substr("order", 1, 8))::BIGINT % shards AS shard
  FROM sized s JOIN awarded USING (key)),
pieces AS MATERIALIZED (SELECT key, shard, sum(size)::BIGINT AS words, any_value(quota) AS quota, shard // {fan} AS part FROM placed GROUP BY key, shard),
parted AS (SELECT key, part, sum(words)::BIGINT AS part_words, any_value(quota) AS quota FROM pieces GROUP BY 1, 2),
parts AS MATERIALIZED ({_quotas('parted', 'key', 'part_words', 'quota', 'part', 'part_quota', 'key, part, part_words, quota')}),
seated AS (SELECT key, part, shard, words, part_quota FROM pieces JOIN parts USING (key, part)),
shares AS MATERIALIZED ({_quotas('seated', 'key, part', 'words', 'part_quota', 'shard', 'won', 'key, part, shard, words, part_quota')}),
blocked AS (SELECT key, shard, n, least(won, {most} * n) // n AS each, least(won, {most} * n) % n AS extra,
  ('0x' || substr(md5('{seed}/' || key || '/' || shard), 1, 8))::BIGINT % n AS first
  FROM (SELECT *, greatest(1, ceil(words / {block}.0::DOUBLE))::BIGINT AS n FROM shares)),
laid AS (SELECT p.*, sum(size) OVER (PARTITION BY key, shard ORDER BY "order", doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM placed p),
ends AS (SELECT *, upto // {block} AS i1, (upto - size) // {block} AS i0 FROM laid JOIN blocked USING (key, shard)),
mixed AS (SELECT doc_id, source, size, source_size, target, CAST(each * size
  + {block} * ((i1 * extra + first) // n) + (((i1 + 1) * extra + first) // n - (i1 * extra + first) // n) * (upto - i1 * {block})
  - {block} * ((i0 * extra + first) // n) - (((i0 + 1) * extra + first) // n - (i0 * extra + first) // n) * (upto - size - i0 * {block})
  AS BIGINT) AS taken FROM ends)"""
