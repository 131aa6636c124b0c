"""Ad-hoc search and recall sweeps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.functions.diffs import changed_files
from tarnfold.functions.text import cap_code_points, first_line
from tarnfold.operators import hybrid, lexical, recall, semantic
from tarnfold.operators.embedding import Embedder
from tarnfold.session import cut

MODES = ("lexical", "semantic", "hybrid")
Ranker = Callable[[DataFrame, DataFrame, int], DataFrame]


def _semantic(embedder: Embedder) -> Ranker:
    def rank(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
        q = embedder.embed(queries.select("query_id", "corpus_id", "text"))
        c = embedder.embed(chunks.withColumnRenamed("content", "text"))
        return semantic.corpus_topk(q, c, k)

    return rank


def ranker(mode: str, embedder: Embedder | None = None) -> Ranker:
    """The ranking of a mode; an unknown mode or a missing embedder is an error at once."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    if mode == "lexical":
        return lexical.bm25_topk
    if embedder is None:
        raise ValueError(f"mode {mode!r} needs an embedder")
    if mode == "semantic":
        return _semantic(embedder)
    near = _semantic(embedder)
    return lambda q, c, k: hybrid.fuse([lexical.bm25_topk(q, c, hybrid.POOL), near(q, c, hybrid.POOL)], k)


def search(queries: DataFrame, chunks: DataFrame, k: int, mode: str = "lexical", embedder: Embedder | None = None) -> DataFrame:
    """``(query_id, rank, path, start_line, end_line, preview)``."""
    hits = ranker(mode, embedder)(queries, chunks, k).select("query_id", "rank", "chunk_id")
    shown = chunks.select("chunk_id", "path", "start_line", "end_line", first_line(F.col("content")).alias("preview"))
    return hits.join(shown, "chunk_id").select("query_id", "rank", "path", "start_line", "end_line", "preview")


def recall_sweep(
    instances: DataFrame, chunks: DataFrame, modes: list[str], ks: list[int], embedder: Embedder | None = None, max_query: int = 4000,
    failed: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(results, aggregates)`` of ``instances(instance_id, corpus_id, problem_statement, patch)``.

    Each mode ranks once, at the largest k. Instances of a corpus without chunks fail, as do
    those of ``failed(corpus_id, error)``, with that error; a mode whose ranking raises fails for every instance. The others go on.
    """
    sizes = sorted({k for k in ks if k > 0}) or [10]
    tasks = instances.select(F.col("instance_id").alias("query_id"), "corpus_id", changed_files(F.col("patch")).alias("changed_files"))
    queries = instances.select(F.col("instance_id").alias("query_id"), "corpus_id", cap_code_points(F.col("problem_statement"), max_query).alias("text"))
    there = chunks.select("corpus_id").distinct()
    known = failed if failed is not None else there.sparkSession.createDataFrame([], "corpus_id string, error string")
    known = known.groupBy("corpus_id").agg(F.min("error").alias("error"))
    runnable = tasks.join(there, "corpus_id", "left_semi").join(known, "corpus_id", "left_anti")
    lost = tasks.join(runnable.select("query_id"), "query_id", "left_anti").join(known, "corpus_id", "left").withColumn("error", F.coalesce("error", F.lit("no chunks")))
    results = recall.failed_rows(lost, modes, sizes)
    for mode in modes:
        rank = ranker(mode, embedder)
        try:
            part = cut(recall.sweep(rank(queries, chunks, max(sizes)), runnable, sizes, mode))
        except PySparkException as problem:
            part = recall.failed_rows(runnable.withColumn("error", F.lit(f"{mode}: {str(problem)[:300]}")), [mode], sizes)
        results = results.unionByName(part)
    return results, recall.summarize(results)
