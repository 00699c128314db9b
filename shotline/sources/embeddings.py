"""Embedding store: loading, and scoring only what is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def load_embeddings(items: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with their stored vector, and the items that have none."""
    usable = store.where(F.col("vec").isNotNull())
    return items.join(usable, "item_id"), items.join(usable, "item_id", "left_anti")


def embed_missing(
    items: DataFrame, store: DataFrame, content: str, embed: Callable[[pd.Series], np.ndarray]
) -> DataFrame:
    """Vectors for the items the store does not hold yet.

    ``embed`` turns a batch of contents into an array of shape (rows, dims); a
    batch is as long as ``spark.sql.execution.arrow.maxRecordsPerBatch``. Rows
    without content come back with a null vector and status ``error``.
    """
    todo = items.join(store.select("item_id"), "item_id", "left_anti").select("item_id", content)
    item_type = todo.schema["item_id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            usable = batch[content].notna()
            out = pd.DataFrame(
                {"item_id": batch["item_id"], "vec": None, "status": "error"}, index=batch.index
            )
            if usable.any():
                found = embed(batch.loc[usable, content])
                out.loc[usable, "vec"] = pd.Series(
                    list(np.asarray(found, dtype=np.float32)), index=batch.index[usable]
                )
                out.loc[usable, "status"] = "ok"
            yield out

    return todo.mapInPandas(score, f"item_id {item_type}, vec array<float>, status string")


def embedding_status(items: DataFrame, store: DataFrame, scored: DataFrame) -> DataFrame:
    """How many items were skipped (already stored), scored or failed."""
    skipped = items.join(store.select("item_id"), "item_id", "left_semi").select(
        F.lit("skip").alias("status")
    )
    return skipped.unionByName(scored.select("status")).groupBy("status").agg(
        F.count(F.lit(1)).alias("n")
    )
