"""Driver queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnfold.llm import credentials, encoding, handwritten, leakage, neighbors, packing, pairs, splitting, truncation
from tarnfold.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(function: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: function(*(table(spark, sf_dir, t) for t in tables))


def _stated_queries(vectors: DataFrame) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100; the number of shards asked is measured."""
    return neighbors.most_similar(vectors, queries=vectors.where("vec_id % 100 = 0"), beam=160)


def _shares(predictions: DataFrame) -> DataFrame:
    return truncation.shares(predictions, truncation.truncated(predictions))


def _packed(documents: DataFrame) -> DataFrame:
    return packing.pack_documents(packing.token_sizes(documents), total=documents.count())


def queries() -> dict[str, Query]:
    return {
        "p1_found": _over(neighbors.found, "chunk_vectors"),
        "p1_nearest": _over(_stated_queries, "chunk_vectors"),
        "p2_found": _over(truncation.found, "predictions"),
        "p2_shares": _over(_shares, "predictions"),
        "p2_hazards": _over(truncation.hazards, "predictions"),
        "p3_found": _over(pairs.found, "predictions", "instances"),
        "p4_found": _over(lambda c, k: splitting.found(splitting.split_oversized(c, k)), "chunks", "corpora"),
        "p4_pieces": _over(splitting.split_oversized, "chunks", "corpora"),
        "p5_found": _over(credentials.found, "chunks"),
        "p5_redacted": _over(credentials.redacted, "chunks"),
        "p6_found": _over(handwritten.found, "chunks", "corpora"),
        "p6_kinds": _over(handwritten.judged_files, "chunks", "corpora"),
        "p7_places": _over(_packed, "documents"),
        "p7_fill": _over(lambda d: packing.fill_report(_packed(d)), "documents"),
        "p8_found": _over(leakage.found, "documents", "eval_items"),
        "p8_report": _over(lambda d, e: leakage.leak_report(leakage.leaked_overlaps(d, e)), "documents", "eval_items"),
        "p9_found": _over(encoding.found, "documents"),
        "p9_restored": _over(encoding.restored, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL expresses the cases exactly; the other operators are tested against brute force."""
    return {
        "p4_found": "SELECT chunk_id FROM chunks WHERE length(content) > 3000",
        "p8_found": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
            i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
            dw AS (SELECT doc_id, array_to_string(w[p:p + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12)),
            iw AS (SELECT item_id, array_to_string(w[p:p + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) >= 12))
            SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)""",
    }
