"""Run health of response sources: validity, truncation, token use, a verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

NEAR_LIMIT = 0.90


def summarize(df: DataFrame, group: list[str]) -> DataFrame:
    """One row per source. Absent diagnostic columns fall back as older files need.

    Truncations are counted over attempts; a recovered row still counts.
    """
    have = set(df.columns)
    nothing = F.lit(0).cast("bigint")
    if "valid_output" in have:
        valid = F.sum(F.coalesce("valid_output", F.lit(False)).cast("int"))
    elif "llm_new_belief" in have:
        valid = F.count("llm_new_belief")
    else:
        valid = nothing
    by_reason = (F.sum(F.when(F.col("finish_reason") == "length", 1).otherwise(0))
                 if "finish_reason" in have else nothing)
    if "n_truncated" in have:
        known = F.count("n_truncated") > 0
        truncated = F.when(known, F.sum(F.coalesce("n_truncated", F.lit(0)))).otherwise(by_reason)
        rows_truncated = F.when(known, F.sum(F.when(F.col("n_truncated") > 0, 1).otherwise(0))).otherwise(by_reason)
    else:
        truncated = rows_truncated = by_reason
    budget = F.max("max_tokens_budget") if "max_tokens_budget" in have else F.lit(None).cast("int")
    last = F.col("completion_tokens") if "completion_tokens" in have else F.lit(None).cast("int")
    peak = F.col("completion_tokens_max") if "completion_tokens_max" in have else F.lit(None).cast("int")
    has_budget = F.lit("max_tokens_budget" in have)

    def tokens(fn):
        return F.when(F.count(peak) > 0, fn(peak)).otherwise(fn(last))

    def near(column, name):
        """Rows close to the budget, from counts per token number: the budget meets counts, never rows."""
        counts = df.groupBy(*group, column.alias("_tokens")).agg(F.count(F.lit(1)).alias("_n"))
        return counts.join(limits, group).groupBy(*group).agg(
            F.sum(F.when(F.col("_tokens") >= NEAR_LIMIT * F.col("_budget"), F.col("_n")).otherwise(0)).alias(name))

    no_thinking = (F.sum(F.coalesce("thinking_disabled", F.lit(False)).cast("int"))
                   if "thinking_disabled" in have else nothing)
    tries = F.avg("n_tries") if "n_tries" in have else F.lit(None).cast("double")
    if {"reasoning_tokens", "completion_tokens"} <= have:
        both = F.col("reasoning_tokens").isNotNull() & (F.col("completion_tokens") > 0)
        think = (100 * F.sum(F.when(both, F.col("reasoning_tokens")))
                 / F.sum(F.when(both, F.col("completion_tokens"))))
    else:
        think = F.lit(None).cast("double")
    out = df.groupBy(*group).agg(
        F.count("*").alias("n"), valid.alias("valid"), truncated.alias("truncated"),
        rows_truncated.alias("rows_truncated"), budget.alias("budget"),
        F.floor(tokens(F.median)).cast("int").alias("tok_median"), tokens(F.max).alias("tok_max"),
        (F.count(peak) > 0).alias("_by_peak"), no_thinking.alias("no_thinking"),
        tries.alias("mean_tries"), think.alias("think_pct"))
    if "max_tokens_budget" in have:
        limits = df.groupBy(*group).agg(F.max("max_tokens_budget").alias("_budget"))
        out = out.join(near(peak, "_near_peak"), group).join(near(last, "_near_last"), group).withColumn(
            "near_limit", F.when(F.col("_by_peak"), F.col("_near_peak")).otherwise(F.col("_near_last")))
    else:
        out = out.withColumn("near_limit", nothing)
    out = out.drop("_by_peak", "_near_peak", "_near_last")
    return out.withColumns({
        "valid_pct": 100 * F.col("valid") / F.col("n"),
        "budget_used_pct": F.when(has_budget, 100 * F.col("tok_max") / F.col("budget")),
    })


def verdict(summary: DataFrame) -> DataFrame:
    """What to do before a full run; the order of the rules matters."""
    c = F.col
    cut = F.concat(c("truncated"), F.lit(" attempt(s) across "), c("rows_truncated"), F.lit("/"), c("n"),
                   F.lit(" rows hit the ceiling"))
    text = (
        F.when(c("n") == 0, "NO DATA - the run produced no rows")
        .when((c("truncated") > 0) & (c("no_thinking") > 0), F.concat(
            F.lit("NO-THINKING FALLBACK - "), cut, F.lit("; "), c("no_thinking"), F.lit("/"), c("n"),
            F.lit(" row(s) answered with thinking off")))
        .when((c("truncated") > 0) & (c("valid_pct") < 100), F.concat(F.lit("RAISE max_tokens - "), cut))
        .when(c("truncated") > 0, F.concat(
            F.lit("RAISE max_tokens - "), cut, F.lit(" (retries recovered, but they cost a call each)")))
        .when(c("near_limit") > 0, F.concat(
            F.lit("RAISE max_tokens - "), c("near_limit"), F.lit("/"), c("n"), F.lit(" used over 90% of it")))
        .when(c("valid_pct") < 100, F.concat(
            F.lit("FORMAT - "), c("n") - c("valid"), F.lit("/"), c("n"),
            F.lit(" unparseable, budget was not the limit")))
        .otherwise("OK"))
    return summary.withColumn("verdict", text)


def retry_share(df: DataFrame, limits: DataFrame, group: str) -> DataFrame:
    """Share of rows that used every retry the run allowed."""
    return df.join(limits, group).groupBy(group).agg(
        F.sum((F.col("n_tries") == F.col("max_tries")).cast("int")).alias("n_at_limit"),
        F.count("*").alias("total"), F.avg((F.col("n_tries") == F.col("max_tries")).cast("int")).alias("share"))


def validity(df: DataFrame, group: list[str], value: str) -> DataFrame:
    return df.groupBy(*group).agg(F.count(value).alias("n_valid"), F.count("*").alias("total"),
                                  (F.count(value) / F.count("*")).alias("share"))


def incomplete_sources(df: DataFrame, baseline: str) -> DataFrame:
    """Sources with fewer rows than the baseline: runs still in flight."""
    counts = df.groupBy("source").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(1))  # one row per source
    base = F.max(F.when(F.col("source") == baseline, F.col("n"))).over(every)
    return counts.withColumn("n_baseline", base).where(
        (F.col("source") != baseline) & (F.col("n") < F.col("n_baseline")))
