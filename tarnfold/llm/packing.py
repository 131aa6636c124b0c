"""Filling fixed-capacity containers: harmonic packing, independently on every worker.

Method. Sizes are tokens of a public tokenizer. A size s with C / (j + 1) < s <= C / j
belongs to class j, j = 1 .. ``CLASSES`` - 1; smaller ones are the last class.
Each worker has a share of the documents (by a hash of the id, so a hot source
or repository makes no difference) and fills each class's containers with the
fixed count of j documents, longest first. What is left of a container is then
given, largest first, to documents of higher classes that still fit (the
refinement of the harmonic algorithm); the last class fills what remains by
next fit. A document above the capacity is cut into full containers plus a rest
that is packed like a document; no other one is split.

The share of a worker is a fixed number of documents, not a fixed number of
workers, so memory per task doesn't grow with the input and the waste at the end
of a share stays one container or so per class in some thousands.

Defined results: null and empty texts have size 0 and take part with no tokens,
in a container of their own share; repeated rows are packed once per row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
CLASSES = 24
SHARE = 20_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that the byte-level vocabulary belongs to.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PLACES = "doc_id bigint, part int, bin_no int, offset int, tokens int"


@functools.cache
def encoding(path: str):
    """The tokenizer of a ranks file, read once per worker."""
    import tiktoken

    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.text]
            yield pd.DataFrame({"doc_id": batch.doc_id, "tokens": np.array(sizes, dtype=np.int32)})

    return run


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, tokens)`` of each document row. The tokenizer's file is a path on every worker."""
    return documents.select("doc_id", "text").mapInPandas(count_tokens(tokenizer), "doc_id bigint, tokens int")


def pack(sizes: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES, top_up: bool = True) -> np.ndarray:
    """The container of each size (none above the capacity), numbered from 0. ``top_up`` = false is plain harmonic packing."""
    n = len(sizes)
    bins = np.full(n, -1, dtype=np.int64)
    if n == 0:
        return bins
    kind = np.minimum(capacity // np.maximum(sizes, 1), classes)
    order = np.argsort(-sizes, kind="stable")
    room: list[int] = []
    # Items of each class from the longest; ``left`` is what no container has yet taken.
    left = [(int(sizes[i]), int(i)) for i in order[::-1]]  # ascending by size
    keys = [s for s, _ in left]

    def take_at_most(most: int) -> int:
        at = bisect_left(keys, most + 1) - 1
        if at < 0:
            return -1
        keys.pop(at)
        return left.pop(at)[1]

    while keys:
        largest = take_at_most(capacity)
        j = int(kind[largest])
        number, free = len(room), capacity - int(sizes[largest])
        bins[largest] = number
        fixed = 1
        # The fixed count of the class: its longest remaining documents, as many as always fit.
        while keys and fixed < j < classes and kind[left[-1][1]] == j:
            i = left.pop()[1]
            keys.pop()
            bins[i] = number
            free -= int(sizes[i])
            fixed += 1
        # The rest of the container: the largest documents that still fit.
        while keys and (top_up or j >= classes) and (i := take_at_most(free)) >= 0:
            bins[i] = number
            free -= int(sizes[i])
        room.append(free)
    return bins


def _pack_share(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable")
        sizes = rows.tokens.to_numpy().astype(np.int64)
        bins = pack(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        out = rows.iloc[order][["doc_id", "part", "tokens"]].assign(share=np.int64(key[0]), bin_no=bins[order].astype(np.int32))
        out["offset"] = (out.groupby("bin_no").tokens.cumsum() - out.tokens).astype(np.int32)
        return out[["share", "doc_id", "part", "bin_no", "offset", "tokens"]]

    return run


def pack_documents(sizes: DataFrame, capacity: int = CAPACITY, share: int = SHARE, total: int | None = None) -> DataFrame:
    """``(share, doc_id, part, bin_no, offset, tokens)``; a container is ``(share, bin_no)``.

    ``part`` counts the pieces of a document that alone exceeds the capacity; each
    but the last fills a container. ``total`` is the number of documents if it is
    known; counting ``sizes`` would make them twice.
    """
    shares = max(1, round((sizes.count() if total is None else total) / share))
    pieces = sizes.select(
        "doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity) - 1).cast("int"))).alias("part")
    ).select(
        "doc_id", "part", F.least(F.lit(capacity), F.col("tokens") - F.col("part") * capacity).cast("int").alias("tokens")
    )
    spread = F.pmod(F.xxhash64("doc_id", "part"), F.lit(shares)).alias("share")
    return (
        pieces.withColumn("share", spread)
        .groupBy("share")
        .applyInPandas(_pack_share(capacity), "share bigint, doc_id bigint, part int, bin_no int, offset int, tokens int")
    )


def fill_report(places: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, documents, tokens, the share of space used and the fullest container."""
    bins = places.groupBy("share", "bin_no").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    return bins.agg(
        F.count("*").alias("containers"),
        F.sum("n").alias("pieces"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / (F.count("*") * capacity), 6).alias("used"),
        F.max("tokens").alias("fullest"),
    )
