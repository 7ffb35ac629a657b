"""Readers: survey documents, panel and response files, run configs, packed records.

Every reader declares its schema; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paneloom import schema as S
from paneloom.functions import scalars as N


def persona_documents(spark: SparkSession, path: str) -> DataFrame:
    """A tree of JSON documents, one per subject; the subject is the folder's name."""
    docs = spark.read.schema(S.PERSONA_DOCUMENT).option("multiLine", True).option(
        "recursiveFileLookup", True).json(path)
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return docs.select(F.regexp_replace(folder, "^.*=", "").alias("subject"), "*")


def study_topics(spark: SparkSession, path: str) -> DataFrame:
    """Study documents with one row per subject and topic."""
    docs = spark.read.schema(S.STUDY_DOCUMENT).option("multiLine", True).option(
        "recursiveFileLookup", True).json(path)
    return docs.select("participant_id", "topic_order", F.explode("topics").alias("t")).select(
        "participant_id", "topic_order", "t.*")


def panel_file(spark: SparkSession, path: str) -> DataFrame:
    """The wide panel CSV with the common column names."""
    raw = spark.read.schema(S.PANEL_ROW).option("header", True).option("multiLine", True).option(
        "escape", '"').csv(path)
    return raw.withColumnsRenamed({
        "initial_belief": "initial_belief_unnormalized", "final_belief": "final_belief_unnormalized",
        "initial_belief_normalized": "init_stance", "final_belief_normalized": "new_belief"})


def response_files(spark: SparkSession, paths: list[str], fmt: str = "json") -> DataFrame:
    """Response rows of many files in one scan, with the file name each row came from."""
    reader = spark.read.schema(S.RESPONSE_ROW)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(fmt).load(paths).withColumn("file", F.col("_metadata.file_path"))


def normalised_responses(df: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    """Flip final belief and public stance into the common frame and rename; the initial belief stays raw."""
    sign = N.polarity(F.col("statement_formulation"), positive, negative)
    return df.withColumns({c: F.col(c) * sign for c in ("llm_new_belief", "llm_general_public_stance")}).withColumnsRenamed({
        "llm_new_belief": "new_belief", "llm_general_public_stance": "general_public_stance",
        "llm_reasoning": "reasoning", "init_belief": "init_stance"})


def run_configs(spark: SparkSession, path: str, exclude: DataFrame | None = None) -> DataFrame:
    """(model, output, max_tries) of run configs: a JSON list of one object, maybe with a byte-order mark."""
    text = spark.read.option("wholetext", True).text(path)
    clean = F.regexp_replace("value", "^﻿", "")
    entry = F.from_json(clean, T_LIST)[0]
    out = text.select(entry.alias("e")).select("e.model", F.col("e.paths.output").alias("output"), "e.max_tries")
    return out if exclude is None else out.join(exclude, "model", "left_anti")


T_LIST = f"array<{S.RUN_CONFIG.simpleString()}>"


def csv_fields(record: Column) -> Column:
    """Fields of a CSV record held in one text cell; ragged records keep their own length."""
    raw = F.regexp_extract_all(record, F.lit(r'(?:^|,)("[^"]*+(?:""[^"]*+)*+"|[^,]*)'), 1)
    return F.transform(raw, lambda f: F.when(
        F.startswith(f, F.lit('"')), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
