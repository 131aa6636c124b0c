"""Overlapping line windows, and the usable chunks of a chunk table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.text import is_blank
from tarnfold.operators.config import ChunkConfig
from tarnfold.operators.sketches import bitmap, maybe


def walk_key(path: Column) -> Column:
    """Sorts paths as a directory walk meets them (a/b.go before a.go)."""
    return F.split(path, "/")


def window_starts(lines: Column, window: Column, step: Column) -> Column:
    """0-based first lines of the windows over ``lines`` lines; the last one reaches the end."""
    beyond = F.greatest(lines - window, F.lit(0))
    return F.sequence(F.lit(0), (F.ceil(beyond / step) * step).cast("int"), step)


def chunk_windows(
    files: DataFrame, config: ChunkConfig | None = None, keys: tuple[str, ...] = ("corpus_id", "path"), content: str = "content",
    window: Column | None = None, overlap: Column | None = None,
) -> DataFrame:
    """``(*keys, start_line, end_line, content)``: the windows of each file that aren't blank.

    Settings come from ``config`` or, per row, from two columns of effective
    values. A file of null content has no windows.
    """
    c = (config or ChunkConfig()).normalised()
    w = F.lit(c.window) if window is None else window
    o = F.lit(c.overlap) if overlap is None else overlap
    split = files.where(F.col(content).isNotNull()).select(
        *keys, F.split(content, "\n").alias("_lines"), w.cast("int").alias("_w"), (w - o).cast("int").alias("_step")
    )
    starts = window_starts(F.size("_lines"), F.col("_w"), F.col("_step"))
    rows = split.select("*", F.explode(starts).alias("_at"))
    end = F.least(F.col("_at") + F.col("_w"), F.size("_lines"))
    text = F.array_join(F.slice("_lines", F.col("_at") + 1, end - F.col("_at")), "\n")
    return rows.select(
        *keys, (F.col("_at") + 1).cast("int").alias("start_line"), end.cast("int").alias("end_line"), text.alias("content")
    ).where(~is_blank(F.col("content")))


def usable_chunks(chunks: DataFrame) -> DataFrame:
    """One row per window: redelivered windows once (the smallest id), without null contents."""
    first = F.struct("chunk_id", "end_line", "content")
    return (
        chunks.where(F.col("content").isNotNull())
        .groupBy("corpus_id", "path", "start_line")
        .agg(F.min_by(first, F.col("chunk_id")).alias("x"))
        .select("corpus_id", "path", "start_line", "x.chunk_id", "x.end_line", "x.content")
    )


def sole_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(sole, others)``: together the rows of ``usable_chunks``.

    ``sole`` are rows whose window and whose chunk_id no other row has, where they are read; a Bloom filter
    of what is repeated keeps them from the shuffle. A chunk_id is in one of the two only.
    """
    there = chunks.where(F.col("content").isNotNull())
    window = F.xxhash64(F.lit("window"), "corpus_id", "path", "start_line")
    own = F.xxhash64(F.lit("chunk"), "chunk_id")
    counted = there.select(F.explode(F.array(window, own)).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    sketch = chunks.sparkSession.sparkContext.broadcast(bitmap(counted.where("n > 1").select("h")))

    @F.pandas_udf("boolean")
    def shared(w: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(maybe(sketch.value, w.to_numpy()) | maybe(sketch.value, c.to_numpy()))

    columns = ("corpus_id", "path", "start_line", "chunk_id", "end_line", "content")
    return there.where(~shared(window, own)).select(*columns), usable_chunks(there.where(shared(window, own)))


def cap_chunks(chunks: DataFrame, most: int) -> DataFrame:
    """The first ``most`` chunks of each corpus in walk order."""
    order = Window.partitionBy("corpus_id").orderBy(walk_key(F.col("path")), "start_line")
    return chunks.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most).drop("_rn")
