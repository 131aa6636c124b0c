"""Chunking and evaluation settings, as Python values and as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_WINDOW = 50
DEFAULT_OVERLAP = 10
DEFAULT_MAX_FILE_BYTES = 1 << 20
DEFAULT_MAX_CHUNKS = 50_000
OVERLAP_DIVISOR = 5


@dataclass(frozen=True)
class ChunkConfig:
    """Line-window settings; ``normalised`` replaces unusable values by the defaults."""

    window: int = DEFAULT_WINDOW
    overlap: int = DEFAULT_OVERLAP
    max_file_bytes: int = DEFAULT_MAX_FILE_BYTES
    max_chunks: int = DEFAULT_MAX_CHUNKS

    def normalised(self) -> ChunkConfig:
        window = self.window if self.window > 0 else DEFAULT_WINDOW
        usable = 0 <= self.overlap < window
        return ChunkConfig(
            window=window,
            overlap=self.overlap if usable else window // OVERLAP_DIVISOR,
            max_file_bytes=self.max_file_bytes if self.max_file_bytes > 0 else DEFAULT_MAX_FILE_BYTES,
            max_chunks=self.max_chunks if self.max_chunks > 0 else DEFAULT_MAX_CHUNKS,
        )

    @property
    def step(self) -> int:
        return self.window - self.overlap


def effective_window(window: Column) -> Column:
    """The window a configuration row really uses; null counts as zero, zero as the default."""
    return F.when(window > 0, window).otherwise(F.lit(DEFAULT_WINDOW)).cast("int")


def effective_overlap(window: Column, overlap: Column) -> Column:
    """The overlap a configuration row really uses: null is zero, and zero is no overlap."""
    real = effective_window(window)
    typed = F.coalesce(overlap, F.lit(0))
    usable = (typed >= 0) & (typed < real)
    return F.when(usable, typed).otherwise(F.floor(real / OVERLAP_DIVISOR)).cast("int")
