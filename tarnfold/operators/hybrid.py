"""Reciprocal-rank fusion of rank lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POOL = 50
RRF_K = 60
DECIMALS = 12


def fuse(parts: list[DataFrame], k: int, pool: int = POOL) -> DataFrame:
    """``(query_id, rank, chunk_id, path, start_line, score)``: the first ``pool`` of each list, fused.

    A chunk is known by ``path:start``; equal scores go by that text. The payload
    is that of the first list that has it.
    """
    marked = [
        p.where(F.col("rank") <= pool).select("query_id", F.lit(i).alias("part"), "rank", "chunk_id", "path", "start_line")
        for i, p in enumerate(parts)
    ]
    rows = reduce(DataFrame.unionByName, marked).withColumn("key", F.concat_ws(":", "path", F.col("start_line").cast("string")))
    fused = rows.groupBy("query_id", "key").agg(
        F.min_by(F.struct("chunk_id", "path", "start_line"), F.struct("part", "rank")).alias("x"),
        F.array_sort(F.collect_list(F.struct("part", "rank"))).alias("ranks"),
    )
    score = F.aggregate("ranks", F.lit(0.0), lambda s, r: s + F.lit(1.0) / (RRF_K + r["rank"]))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return (
        fused.withColumn("score", F.round(score, DECIMALS))
        .withColumn("rank", F.row_number().over(by))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "x.chunk_id", "x.path", "x.start_line", "score")
    )
