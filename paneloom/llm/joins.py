"""Joins that keep whole texts where they are when the other side is provably short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paneloom.session import materialise


def join_ids(docs: DataFrame, ids: DataFrame, on: str | Column, how: str, most_rows: int = 1_000_000) -> DataFrame:
    """Join documents with a table of ids that is written once and counted.

    Up to `most_rows` rows it is broadcast and no text is shuffled; beyond that it
    is a join by shuffle, with the same rows.
    """
    held = materialise(ids, "ids")
    return docs.join(F.broadcast(held) if held.count() <= most_rows else held, on, how)
