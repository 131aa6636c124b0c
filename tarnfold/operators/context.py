"""Context selection for prompts: none, retrieved chunks, the top files, the gold files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.operators.chunking import walk_key

MODES = ("none", "retrieval", "file", "oracle")
COLUMNS = ("query_id", "rank", "chunk_id", "path", "start_line")


def _walk_ranked(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(walk_key(F.col("path")), "start_line")
    ranked = rows.withColumn("rank", F.row_number().over(by))
    return (ranked.where(F.col("rank") <= k) if k > 0 else ranked).select(*COLUMNS)


def oracle_chunks(gold: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The chunks of ``gold(query_id, corpus_id, path)``'s files in walk order; k <= 0 keeps all."""
    return _walk_ranked(chunks.join(gold.distinct(), ["corpus_id", "path"]), k)


def top_file_chunks(ranked: DataFrame, chunks: DataFrame, top_files: int, k: int) -> DataFrame:
    """All chunks of the first ``top_files`` distinct files of a ranking, in walk order.

    ``ranked(query_id, corpus_id, rank, path)`` should hold max(50, 5 k) ranks.
    """
    files = ranked.groupBy("query_id", "corpus_id", "path").agg(F.min("rank").alias("first"))
    by = Window.partitionBy("query_id").orderBy("first")
    wanted = files.withColumn("n", F.row_number().over(by)).where(F.col("n") <= top_files).select("query_id", "corpus_id", "path")
    return _walk_ranked(chunks.join(wanted, ["corpus_id", "path"]), k)


def pool_size(k: int) -> int:
    return max(50, 5 * k)


def context_chunks(mode: str, k: int, ranked: DataFrame, chunks: DataFrame, gold: DataFrame, top_files: int = 1) -> DataFrame:
    """The chunks of a mode; ``none`` needs no corpus and gives no rows."""
    if mode == "none":
        return ranked.select(*COLUMNS).where(F.lit(False))
    if mode == "retrieval":
        return ranked.where(F.col("rank") <= k).select(*COLUMNS)
    if mode == "file":
        return top_file_chunks(ranked, chunks, top_files, k)
    if mode == "oracle":
        return oracle_chunks(gold, chunks, k)
    raise ValueError(f"unknown context {mode!r}; one of {', '.join(MODES)}")
