"""BM25 over (queries x corpora): index tables, scores, ranking.

Statistics are per corpus. A query is scored against the postings of its own
terms only, so chunks without a common term are never touched. Postings and query
terms meet in cells: at most about ``CHUNK_BLOCK`` chunks and ``QUERY_BLOCK`` queries of one
corpus, so that no corpus, term or chunk is a task of its own, however hot, and the
sums over terms stay within a cell. Only the best of each cell leave it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.functions.text import WORD_CLASS, explode_terms, marked, term_count, terms, unique_terms
from tarnfold.operators.chunking import sole_chunks
from tarnfold.session import cut

K1, B = 1.5, 0.75
#: Decimals on which scores are compared, so that the order of summation can't decide a tie.
DECIMALS = 9
CHUNK_BLOCK, QUERY_BLOCK = 1024, 2048
#: Pairs of a posting and a query term that are summed at once.
SLICE = 1 << 22


@dataclass(frozen=True)
class LexicalIndex:
    """``postings(corpus_id, chunk_id, dl, term, f)``, ``df(corpus_id, term, df)``, ``stats(corpus_id, n, avg_dl)``."""

    postings: DataFrame
    df: DataFrame
    stats: DataFrame
    chunks: DataFrame


def lexical_index(chunks: DataFrame, wanted: DataFrame | None = None) -> LexicalIndex:
    """The index of ``chunks(corpus_id, chunk_id, path, start_line, content)``.

    ``wanted(corpus_id, term)`` limits postings to the terms that will be asked for, and
    everything to the corpora that will be; lengths and statistics always count all terms.
    """
    texts = chunks.select("corpus_id", "chunk_id", marked(F.col("content")).alias("_m")).withColumn("dl", term_count(F.col("_m")))
    # Each chunk has a row without a term besides, so one pass over the texts serves postings and statistics.
    flat = explode_terms(texts, "_m", "corpus_id", "chunk_id", "dl", empty=True)
    if wanted is not None:
        asked = wanted.select("corpus_id", F.explode(F.array(F.lit(""), F.col("term"))).alias("term"))
        flat = flat.join(asked.distinct(), ["corpus_id", "term"], "left_semi")
    # The index is written once to the shared folder: frequencies, statistics and scores read it.
    rows = cut(flat.groupBy("corpus_id", "term", "chunk_id", "dl").agg(F.count("*").alias("f")))
    stats = rows.where("term = ''").groupBy("corpus_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    postings = rows.where("term <> ''")
    df = postings.groupBy("corpus_id", "term").agg(F.count("*").alias("df"))
    return LexicalIndex(postings, df, stats, chunks)


def _postings(chunks: DataFrame) -> DataFrame:
    """``(corpus_id, term, chunk_id, dl, f)`` of every term, not written."""
    texts = chunks.select("corpus_id", "chunk_id", marked(F.col("content")).alias("_m")).withColumn("dl", term_count(F.col("_m")))
    flat = explode_terms(texts, "_m", "corpus_id", "chunk_id", "dl")
    return flat.groupBy("corpus_id", "term", "chunk_id", "dl").agg(F.count("*").alias("f"))


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """``(corpus_id, term, df)`` of all terms of a chunk table; redelivered windows count once.

    Postings of a whole table are many times its size, so none are written: terms of chunks that
    stand alone are made distinct within their row, only repeated windows and ids meet by a shuffle.
    """
    sole, others = sole_chunks(chunks)
    rows = sole.select("corpus_id", F.explode(unique_terms(F.col("content"))).alias("term"))
    return rows.unionByName(_postings(others).select("corpus_id", "term")).groupBy("corpus_id", "term").agg(F.count("*").alias("df"))


def _largest_count(words: Column) -> Column:
    """How often the most frequent term of a list is in it."""
    start = F.struct(F.lit("").alias("term"), F.lit(0).cast("bigint").alias("run"), F.lit(0).cast("bigint").alias("most"))

    def step(state: Column, term: Column) -> Column:
        run = F.when(state["term"] == term, state["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        return F.struct(term.alias("term"), run.alias("run"), F.greatest(state["most"], run).alias("most"))

    return F.aggregate(F.sort_array(words), start, step, lambda state: state["most"])


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, dl, terms, tokens, most)`` of a chunk table: distinct terms, all terms, the most frequent one's count.

    Made where chunks are read, as ``document_frequencies``; chunks without terms have no row.
    """
    sole, others = sole_chunks(chunks)
    rows = sole.where(F.col("content").rlike(WORD_CLASS)).select("chunk_id", terms(F.col("content")).alias("_t"))
    size = F.size("_t")
    alone = rows.select("chunk_id", size.alias("dl"), F.size(F.array_distinct("_t")).cast("bigint").alias("terms"), size.cast("bigint").alias("tokens"), _largest_count(F.col("_t")).alias("most"))
    met = _postings(others).groupBy("chunk_id", "dl").agg(F.count("*").alias("terms"), F.sum("f").alias("tokens"), F.max("f").alias("most"))
    return alone.unionByName(met)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """``(corpus_id, n, avg_dl)`` of a chunk table: lengths are made where chunks are read, so no content is shuffled."""
    length = term_count(marked(F.col("content")))
    sized = chunks.where(F.col("content").isNotNull()).select("corpus_id", "path", "start_line", "chunk_id", length.alias("dl"))
    once = sized.groupBy("corpus_id", "path", "start_line").agg(F.min(F.struct("chunk_id", "dl")).alias("x"))
    return once.groupBy("corpus_id").agg(F.count("*").alias("n"), F.avg("x.dl").alias("avg_dl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, corpus_id, term)``: the distinct terms of ``queries(query_id, corpus_id, text)``."""
    rows = queries.select("query_id", "corpus_id", marked(F.col("text")).alias("_m"))
    return explode_terms(rows, "_m", "query_id", "corpus_id").distinct()


def _cells(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """``(corpus_id, blocks, query_blocks)``: how many parts the chunks and the queries of a corpus have."""
    asked = queries.groupBy("corpus_id").agg(F.count_distinct("query_id").alias("q"))
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    return stats.join(asked, "corpus_id").select("corpus_id", parts("n", CHUNK_BLOCK).alias("blocks"), parts("q", QUERY_BLOCK).alias("query_blocks"))


def _score_cell(k: int | None) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, postings: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(postings) and len(asked):
            by_term = postings.sort_values("term")
            terms = by_term.term.to_numpy()
            chunk, chunks = pd.factorize(by_term.chunk_id)
            f, dl = by_term.f.to_numpy(dtype=float), by_term.dl.to_numpy(dtype=float)
            query, queries = pd.factorize(asked.query_id)
            order = np.argsort(query, kind="stable")
            query, term, idf = query[order], asked.term.to_numpy()[order], asked.idf.to_numpy()[order]
            weight = f * (K1 + 1) / (f + K1 * (1 - B + B * dl / float(asked.avg_dl.iloc[0])))
            low = np.searchsorted(terms, term, side="left")
            n = np.searchsorted(terms, term, side="right") - low
            ends = np.append(np.flatnonzero(np.diff(query)) + 1, len(query))
            total = np.cumsum(n)
            begin = 0
            while begin < len(query):
                # Whole queries, as many as a slice holds, one at least.
                limit = SLICE + (total[begin - 1] if begin else 0)
                at = np.searchsorted(ends, begin, side="right")
                end = int(ends[max(at, np.searchsorted(total[ends - 1], limit, side="right") - 1)])
                size = n[begin:end]
                hit = np.repeat(low[begin:end] - np.cumsum(size) + size, size) + np.arange(size.sum())
                first = query[begin]
                place = (np.repeat(query[begin:end], size) - first) * len(chunks) + chunk[hit]
                width = (query[end - 1] - first + 1) * len(chunks)
                score = np.bincount(place, weights=np.repeat(idf[begin:end], size) * weight[hit], minlength=width).reshape(-1, len(chunks))
                there = np.bincount(place, minlength=width).reshape(-1, len(chunks)) > 0
                if k is not None and k < len(chunks):
                    # Beyond the k best of a cell only equal scores could matter; they are kept as well.
                    rounded = np.where(there, np.round(score, DECIMALS), -np.inf)
                    there &= rounded >= -np.partition(-rounded, max(k, 1) - 1, axis=1)[:, max(k, 1) - 1 : max(k, 1)]
                q, c = np.nonzero(there)
                out.append(pd.DataFrame({"query_id": queries.to_numpy()[q + first], "corpus_id": key[0], "chunk_id": chunks.to_numpy()[c], "score": score[q, c]}))
                begin = end
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "corpus_id": [], "chunk_id": [], "score": []})

    return run


def bm25_scores(queries: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
    """``(query_id, corpus_id, chunk_id, score)`` of every chunk with a term of the query.

    The query side is as large as the queries' distinct terms, so postings of other
    terms end before they are counted. ``k`` leaves out chunks that can't be among a
    query's ``k`` best.
    """
    wanted = cut(query_terms(queries))
    index = lexical_index(chunks, wanted)
    stats = index.stats
    n, df = F.col("n").cast("double"), F.col("df").cast("double")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf")
    term = F.xxhash64("term").alias("term")
    cells = _cells(wanted, stats)
    part = lambda column, parts: F.pmod(F.xxhash64(column), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    rated = wanted.join(index.df, ["corpus_id", "term"]).join(stats, "corpus_id").join(cells, "corpus_id")
    asked = rated.select("query_id", "corpus_id", term, idf, "avg_dl", part("query_id", "query_blocks").alias("query_block"), every("blocks").alias("block"))
    held = index.postings.join(cells, "corpus_id").select(
        "corpus_id", "chunk_id", term, F.col("f").cast("int").alias("f"), F.col("dl").cast("int").alias("dl"),
        part("chunk_id", "blocks").alias("block"), every("query_blocks").alias("query_block"),
    )
    cell = ("corpus_id", "block", "query_block")
    schema = f"query_id string, corpus_id string, chunk_id {dict(chunks.dtypes)['chunk_id']}, score double"
    # Scores are compared after rounding (``DECIMALS``), so the order of a plain sum can't matter.
    return held.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInPandas(_score_cell(k), schema)


def top_k(scored: DataFrame, k: int, decimals: int = DECIMALS) -> DataFrame:
    """The ``k`` best rows of each query: score down, then path and start line up."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start_line")
    return (
        scored.withColumn("score", F.round("score", decimals)).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= max(k, 0))
    )


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, corpus_id, chunk_id, path, start_line, score)``."""
    scores = bm25_scores(queries, chunks, k)
    places = chunks.select("chunk_id", "path", "start_line")
    return top_k(scores.join(places, "chunk_id"), k).select("query_id", "rank", "corpus_id", "chunk_id", "path", "start_line", "score")
