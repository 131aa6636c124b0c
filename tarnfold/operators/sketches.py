"""Bounded bitmaps that tell which hashes can't be in a table, ahead of the exact join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
#: Bits set for each hash; from different parts of it.
SHIFTS = (0, 19, 38)


def _places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    v = values.astype(np.uint64)
    return [((v >> np.uint64(s)) | (v << np.uint64(64 - s))) % np.uint64(bits) if s else v % np.uint64(bits) for s in SHIFTS]


def bitmap(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """The Bloom filter of the one bigint column of ``hashes``: ``bits`` bits, however many rows there are."""
    column = hashes.columns[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for at in _places(batch[column].to_numpy(), bits):
                np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        used = np.flatnonzero(own)
        yield pd.DataFrame({"at": used.astype(np.int32), "byte": own[used].astype(np.int32)})

    rows = hashes.mapInPandas(run, "at int, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow()
    out = np.zeros(bits // 8, dtype=np.uint8)
    out[rows.column("at").to_numpy()] = rows.column("byte").to_numpy().astype(np.uint8)
    return out


def maybe(filter_bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """False where a value is certainly none of the filter's."""
    out = np.ones(len(values), dtype=bool)
    for at in _places(values, len(filter_bits) * 8):
        out &= (filter_bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out
