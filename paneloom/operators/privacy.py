"""De-identification: id collection, stable pseudonyms, text rewriting, pattern triage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from paneloom.functions import draws as R
from paneloom.functions.text import PII_PATTERNS, pattern_found, pattern_hints, redacted_hit
from paneloom.operators.pairing import attach_short
from paneloom.operators.resample import numbered

# What an id looks like, and what is never one.
ID_SHAPE = r"^[0-9A-Za-z]{24}$"
NOT_AN_ID = ["nan", "", "{{%PROLIFIC_PID%}}"]
PSEUDONYM = "P%04d"

# Cuts a text before and after every free-standing run of 24 letters or digits.
_CUT = r"(?U)(?<!\w)(?=[0-9A-Za-z]{24}(?!\w))|(?<=[0-9A-Za-z]{24})(?!\w)"
_TOKEN = r"(?U)\b([0-9A-Za-z]{24})\b"


def collect_ids(columns: list[DataFrame]) -> DataFrame:
    """Distinct ids from id-bearing columns only; each frame holds one column.

    Free text is never searched: words of the same shape occur in it.
    """
    ids = reduce(DataFrame.unionByName, [df.toDF("original") for df in columns])
    text = F.col("original").cast("string")
    return ids.select(text.alias("original")).where(
        F.col("original").rlike(ID_SHAPE) & ~F.col("original").isin(NOT_AN_ID)).distinct()


def extend_map(existing: DataFrame, ids: DataFrame, seed: int) -> DataFrame:
    """(original, pseudonym): existing assignments stay, new ids take free numbers in hash order.

    As many numbers are laid out as there are ids, so the free ones suffice.
    Everything is numbered by buckets, none of it in a single ordering.
    """
    new = ids.select("original").join(existing.select("original"), "original", "left_anti")
    everyone = existing.select("original").unionByName(new)
    used = existing.select(F.regexp_extract("pseudonym", r"(\d+)$", 1).cast("long").alias("number"))
    slots = numbered(everyone, "original").select((F.col("idx") + 1).alias("number"), "n")
    free = _ordered_index(slots.join(used, "number", "left_anti"), "number", F.col("n"))
    shuffled = _hash_index(new, "original", seed)
    fresh = shuffled.join(free.select("number", "idx"), "idx").select(
        "original", F.format_string(PSEUDONYM, "number").alias("pseudonym"))
    return existing.select("original", "pseudonym").unionByName(fresh)


def _shifted(df: DataFrame, inside: Column) -> DataFrame:
    """Adds idx: place inside the bucket plus the sizes of the buckets before it."""
    sizes = df.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(F.lit(1)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    # At most 4096 buckets, so the shifts are a short table.
    return df.withColumn("_in", inside).join(F.broadcast(shifts), "_bucket").withColumn(
        "idx", F.col("_in") + F.col("_shift"))


def _ordered_index(df: DataFrame, number: str, top: Column) -> DataFrame:
    bucketed = df.withColumn("_bucket", F.floor((F.col(number) - 1) * 4096 / top))
    return _shifted(bucketed, F.row_number().over(Window.partitionBy("_bucket").orderBy(number)) - 1)


def _hash_index(df: DataFrame, key: str, seed: int) -> DataFrame:
    hashed = df.withColumn("_h", R.digest(seed, F.col(key))).withColumn("_bucket", F.substring("_h", 1, 3))
    return _shifted(hashed, F.row_number().over(Window.partitionBy("_bucket").orderBy("_h", key)) - 1)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_TOKEN), 1))


def pseudonymise(df: DataFrame, key: str, text: str, mapping: DataFrame) -> DataFrame:
    """Replace every known id in a text column and count the replacements.

    Only (key, token) pairs meet the map; a text is cut at its tokens once and
    put together again, however many ids the map holds.
    """
    found = df.select(key, F.explode(tokens(F.col(text))).alias("original"))
    known = found.join(mapping, "original").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("original", "pseudonym"))).alias("_known"))
    pieces = F.split(text, _CUT)
    joined = df.join(known, key, "left").withColumn("_pieces", pieces)
    hits = F.size(F.filter("_pieces", lambda p: F.try_element_at(F.col("_known"), p).isNotNull()))
    rebuilt = F.array_join(F.transform(
        "_pieces", lambda p: F.coalesce(F.try_element_at(F.col("_known"), p), p)), "")
    has = F.col("_known").isNotNull()
    return joined.withColumns({
        text: F.when(has, rebuilt).otherwise(F.col(text)),
        "n_replaced": F.when(has, hits).otherwise(0)}).drop("_known", "_pieces")


def surviving_ids(df: DataFrame, dataset: Column, text: str, ids: DataFrame) -> DataFrame:
    """Occurrences of original ids per dataset; must be empty after a rewrite."""
    found = df.select(dataset.alias("dataset"), F.explode(
        F.regexp_extract_all(text, F.lit(_TOKEN), 1)).alias("original"))
    # Counted by token first, so a frequent id meets the id table once per dataset.
    counts = found.groupBy("dataset", "original").agg(F.count("*").alias("n"))
    return counts.join(ids.select("original"), "original", "left_semi").groupBy("dataset").agg(
        F.sum("n").alias("n_survivors"), F.count("*").alias("n_ids"))


def _not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def pattern_counts(texts: DataFrame, field: str, text: str) -> DataFrame:
    """(field, pattern, n, n_scanned): one hit per pattern and text.

    All patterns are counted as columns of one aggregation; only its few result
    rows are unpivoted. A text's hints decide which expressions run on it.
    """
    hinted = texts.where(_not_blank(F.col(text))).select(field, text, pattern_hints(F.col(text)).alias("_hints"))
    counts = hinted.groupBy(field).agg(
        F.count("*").alias("n_scanned"),
        *[F.sum(pattern_found(F.col(text), F.col("_hints"), name, p).cast("int")).alias(name) for name, p in PII_PATTERNS])
    return counts.unpivot([field, "n_scanned"], [name for name, _ in PII_PATTERNS], "pattern", "n")


def pattern_samples(texts: DataFrame, field: str, key: str, text: str, n: int,
                    patterns: list[tuple[str, str]] = PII_PATTERNS) -> DataFrame:
    """Masked context of the first n hits per field and pattern.

    The first n keys are chosen before any snippet is made; the row-number filter
    is applied inside every partition before the shuffle.
    """
    hinted = texts.where(_not_blank(F.col(text))).select(field, key, text, pattern_hints(F.col(text)).alias("_hints"))
    hits = hinted.select(field, key, F.explode(F.filter(
        F.array(*[F.when(pattern_found(F.col(text), F.col("_hints"), name, p), F.lit(name)) for name, p in patterns]),
        lambda x: x.isNotNull())).alias("pattern"))
    place = F.row_number().over(Window.partitionBy(field, "pattern").orderBy(key))
    first = hits.withColumn("_k", place).where(F.col("_k") <= n).drop("_k")
    snippet = reduce(lambda acc, p: F.when(F.col("pattern") == p[0], redacted_hit(F.col(text), p[1])).otherwise(acc),
                     reversed(patterns), F.lit(None).cast("string"))
    # At most n keys per field and pattern: counted, then sent to the texts, which stay where they are.
    return attach_short(texts.select(field, key, text), first, [field, key]).select(
        field, key, "pattern", snippet.alias("snippet"))


def string_leaves(value: Column, kind: T.DataType, path: Column) -> Column:
    """All strings of a nested value with their path, as an array; follows the schema."""
    none = F.array().cast("array<struct<path:string,text:string>>")
    if isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), F.array(F.struct(path.alias("path"), value.alias("text")))).otherwise(none)
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind.fields:
            step = F.when(path == "", F.lit(f.name)).otherwise(F.concat(path, F.lit("." + f.name)))
            parts.append(string_leaves(value[f.name], f.dataType, step))
        return F.flatten(F.array(*parts)) if parts else none
    if isinstance(kind, T.ArrayType):
        inner = F.transform(value, lambda x, i: string_leaves(
            x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(inner), none)
    if isinstance(kind, T.MapType):
        inner = F.transform(F.map_entries(value), lambda e: string_leaves(
            e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string"))))
        return F.coalesce(F.flatten(inner), none)
    return none


def long_strings(df: DataFrame, key: str, value: str, longer_than: int = 15) -> DataFrame:
    """Strings longer than a limit at any depth of a nested column, with their path."""
    leaves = string_leaves(F.col(value), df.schema[value].dataType, F.lit(""))
    return df.select(key, F.explode(leaves).alias("s")).select(key, "s.path", "s.text").where(
        F.length("text") > longer_than)


def drop_identifying(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns by name ending; each name must match exactly one column."""
    hits = {n: [c for c in df.columns if c.strip().endswith(n)] for n in names}
    for name, found in hits.items():
        if len(found) != 1:
            raise ValueError(f"expected exactly one {name!r} column, found {len(found)}")
    return df.drop(*[found[0] for found in hits.values()])


def assign_design(subjects: DataFrame, subject: str, items: list[str], cells: list[str],
                  wordings: dict[str, list[str]], seed: int) -> DataFrame:
    """Counterbalanced assignment: cycle all cell combinations, draw order and wording.

    One row per subject and item with position, cell, message order and wording.
    """
    index = numbered(subjects.select(subject).distinct(), subject)
    combo = F.col("idx") % (len(cells) ** len(items))
    orders = _permutations(len(items))
    drawn = F.element_at(F.array(*[F.array(*[F.lit(i) for i in o]) for o in orders]),
                         (R.below(F.lit(len(orders)), seed, "order", F.col(subject)) + 1).cast("int"))
    blocks = []
    for k, item in enumerate(items):
        power = len(cells) ** (len(items) - 1 - k)
        cell = F.element_at(F.array(*[F.lit(c) for c in cells]),
                            (F.floor(combo / power) % len(cells) + 1).cast("int"))
        words = wordings[item]
        wording = F.element_at(F.array(*[F.lit(w) for w in words]),
                               (R.below(F.lit(len(words)), seed, "wording", item, F.col(subject)) + 1).cast("int"))
        blocks.append(F.struct(
            F.lit(item).alias("item"), F.array_position("_order", F.lit(k)).cast("int").alias("position"),
            cell.alias("cell"), R.below(F.lit(6), seed, "messages", item, F.col(subject)).cast("int").alias("message_order"),
            wording.alias("wording")))
    staged = index.withColumn("_order", drawn)
    return staged.select(subject, F.explode(F.array(*blocks)).alias("b")).select(subject, "b.*")


def _permutations(n: int) -> list[tuple[int, ...]]:
    from itertools import permutations

    return list(permutations(range(n)))
