"""Incremental forms: windows of arriving files, and the embedding cache as a sink.

Chunking is stateless, so the batch expression is the streaming one. The cache
is kept by ``foreachBatch`` with an anti-join, so that a text is embedded once
however often it arrives, and a batch that is run again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tarnfold.operators.chunking import chunk_windows
from tarnfold.operators.config import ChunkConfig
from tarnfold.operators.embedding import Embedder, cache_misses
from tarnfold.sources.files import load_cache, save_cache


def stream_windows(files: DataFrame, config: ChunkConfig | None = None) -> DataFrame:
    """The windows of a stream of ``(corpus_id, path, content)``."""
    return chunk_windows(files, config)


def embed_into_cache(texts: DataFrame, embedder: Embedder, path: str) -> DataStreamWriter:
    """Embeds the texts of a stream that the cache at ``path`` lacks."""

    def save(batch: DataFrame, _: int) -> None:
        fresh = embedder.embed(cache_misses(batch, load_cache(batch.sparkSession, path), embedder.name))
        save_cache(fresh, path)

    return texts.writeStream.foreachBatch(save)
