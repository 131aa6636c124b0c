"""Cosine ranking of stated queries against all vectors, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.vectors import dot, norm
from tarnfold.operators.lexical import DECIMALS, top_k

#: Queries that every worker holds at a time; more of them are further passes.
BLOCK = 4096
#: Parts of a corpus that meet its queries apart.
SPREAD = 16


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        if v is not None and len(v) == dim:
            out[i] = v
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def _search(ids: np.ndarray, queries: np.ndarray, k: int, decimals: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_values("vec_id", kind="stable")
            sims = np.round(queries @ _matrix(batch.vec, queries.shape[1]).T, decimals)
            own = batch.vec_id.to_numpy()
            keep = min(len(own), k + 1)
            # The k + 1 best of a batch; of equal cosines at the edge those of the smallest ids, so copies of a vector don't pile up.
            edge = -np.partition(-sims, keep - 1, axis=1)[:, keep - 1 : keep]
            chosen = sims >= edge
            crowded = np.flatnonzero(chosen.sum(axis=1) > keep)
            if len(crowded):
                above, tied = sims[crowded] > edge[crowded], sims[crowded] == edge[crowded]
                chosen[crowded] = above | tied & (np.cumsum(tied, axis=1) <= keep - above.sum(axis=1, keepdims=True))
            q, v = np.nonzero(chosen)
            yield pd.DataFrame({"query_id": ids[q], "vec_id": own[v], "score": sims[q, v]})

    return run


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, dim: int, decimals: int = DECIMALS) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of ``queries(vec_id, vec)`` against ``vectors(vec_id, vec)``, itself left out.

    Vectors aren't shuffled: each batch keeps its best per query, then the ranks
    are taken over those. Negative cosines stay; ties go to the smaller id.
    """
    rows = queries.select("vec_id", "vec").toLocalIterator()
    parts, ids, block = [], [], []

    def flush() -> None:
        if ids:
            search = _search(np.array(ids), _matrix(pd.Series(block), dim), k, decimals)
            parts.append(vectors.select("vec_id", "vec").mapInPandas(search, "query_id bigint, vec_id bigint, score double"))
            ids.clear()
            block.clear()

    for row in rows:
        ids.append(row.vec_id)
        block.append(row.vec)
        if len(ids) == BLOCK:
            flush()
    flush()
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    hits = reduce(DataFrame.unionByName, parts).where(F.col("query_id") != F.col("vec_id"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def corpus_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Cosine ranking within each query's own corpus.

    ``queries(query_id, corpus_id, vec)`` meet ``chunks(corpus_id, chunk_id, path,
    start_line, vec)`` by an equi-join on the corpus; every chunk is a candidate. A
    corpus is spread over ``SPREAD`` salts, each with a copy of its queries, so that a hot one isn't one task.
    """
    # Norms are taken once per vector, before the join multiplies the rows.
    q = queries.select("query_id", "corpus_id", F.col("vec").alias("_q"), norm(F.col("vec")).alias("_nq"))
    c = chunks.select("corpus_id", "chunk_id", "path", "start_line", "vec", norm(F.col("vec")).alias("_nc"))
    c = c.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD)).cast("int"))
    q = q.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    size = F.col("_nq") * F.col("_nc")
    usable = F.coalesce((F.size("vec") == F.size("_q")) & (size > 0), F.lit(False))
    score = F.when(usable, dot(F.col("vec"), F.col("_q")) / size).otherwise(0.0)
    scored = c.join(q, ["corpus_id", "_salt"]).select("query_id", "corpus_id", "chunk_id", "path", "start_line", score.alias("score"))
    return top_k(scored, k).select("query_id", "rank", "corpus_id", "chunk_id", "path", "start_line", "score")
