"""Embedding with a content-addressed cache."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.vectors import DIM, cache_key, mock_embedding

BATCH = 128
#: Rows are numbered in slices of equal first characters: hashes of the cache fall into 4,096 of them.
SLICE_CHARS = 3


class Embedder(Protocol):
    """Adds ``vec`` to a DataFrame with a distinct ``text`` column."""

    name: str

    def embed(self, texts: DataFrame) -> DataFrame: ...


class MockEmbedder:
    """Deterministic vectors from hashes, as one expression."""

    def __init__(self, dim: int = DIM):
        self.dim, self.name = dim, f"mock-{dim}"

    def embed(self, texts: DataFrame) -> DataFrame:
        return texts.withColumn("vec", mock_embedding(F.col("text"), self.dim))


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """``(key, text)``: the distinct texts that the cache lacks."""
    keyed = texts.select("text").where("text is not null").distinct().withColumn("key", cache_key(model, F.col("text")))
    return keyed.join(cache.select("key"), "key", "left_anti").select("key", "text")


def embed_cached(texts: DataFrame, cache: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """``(texts with vec, new cache entries)``: each distinct missing text is embedded once."""
    fresh = embedder.embed(cache_misses(texts, cache, embedder.name)).select("key", "vec")
    known = cache.select("key", "vec").unionByName(fresh)
    out = texts.withColumn("_key", cache_key(embedder.name, F.col("text"))).join(known.withColumnRenamed("key", "_key"), "_key", "left").drop("_key")
    return out, fresh


def batches(texts: DataFrame, order: str, size: int = BATCH) -> DataFrame:
    """``(batch, index)`` of each row for requests of at most ``size`` texts, per ``part``, in the order of a text column.

    A part may hold a third of all rows, so it is numbered in slices: those of equal first
    characters of the order column. Slices are counted, and each continues where the one before ended.
    """
    sliced = texts.withColumn("_slice", F.substring(order, 1, SLICE_CHARS))
    before = Window.partitionBy("part").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy("part", "_slice").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    starts = starts.withColumnsRenamed({"part": "_part", "_slice": "_same"})
    joined = sliced.join(starts, F.col("part").eqNullSafe(F.col("_part")) & F.col("_slice").eqNullSafe(F.col("_same")))
    n = F.col("_from") + F.row_number().over(Window.partitionBy("part", "_slice").orderBy(order)) - 1
    numbered = joined.withColumn("_at", n).drop("_part", "_same", "_slice", "_from")
    return numbered.withColumn("batch", F.floor(F.col("_at") / size).cast("int")).withColumn("index", (F.col("_at") % size).cast("int")).drop("_at")
