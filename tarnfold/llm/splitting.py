"""Splitting oversized chunks at natural boundaries (content-defined chunking).

Method. A rolling hash runs over the text (one gear table of 64-bit words, so a
hash depends on the last 48 characters only). Positions whose hash has zero top
bits are landmarks. Going left to right, a piece may end between ``min_chars``
and ``max_chars`` of new text; the first landmark in that range is taken and
snapped to the nearest natural boundary: a blank line, the end of a line before
a less indented one, any end of a line, white space or closing punctuation.
Without a landmark the best boundary near the maximum is taken. Because hash and
boundaries depend on nearby text only, the cuts fall into step again after an
edit, and only neighbouring pieces change.

Piece i consists of the last ``overlap`` whole lines before its cut and the new
text up to the next cut. The new text is made long enough to hold the next overlap
where the limit permits. Whole lines are dropped from an overlap (the farthest
first) only while it leaves no room for the rest of the line after the cut or, if
that line alone exceeds the limit, for ``limit / MIN_SHARE`` characters of it.

Defined results: null content gives no piece, nor does content within the limit
(both are filtered by the scan, before Python); an unknown corpus has the default
overlap. Empty tables give an empty result; repeated rows give their pieces once
per row; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.operators.config import DEFAULT_OVERLAP, effective_overlap

LIMIT = 3000
MIN_SHARE = 4  # a piece has limit / MIN_SHARE characters of new text if overlap and line ends permit
LANDMARK_BITS = 8  # one landmark in 256 characters on average
GEAR_SPAN = 48
SNAP_CHARS = 320

PIECES = (
    "chunk_id bigint, corpus_id string, path string, piece_no int, char_start int, char_end int, "
    "overlap_chars int, start_line int, end_line int, content string"
)

_GEAR = np.random.RandomState(20240611).randint(0, 2**63 - 1, size=1024, dtype=np.int64).astype(np.uint64)
_CLOSERS = frozenset(";,}])>|.!?。；，")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def landmarks(text: str) -> np.ndarray:
    """Cut positions (after a character) whose rolling hash has ``LANDMARK_BITS`` zero bits.

    ``hash[i]`` is the sum of ``gear[c[i - j]] << j``; shifting lets a character
    leave the upper bits after ``GEAR_SPAN`` steps. It is summed here by doubling.
    """
    total = _GEAR[_codes(text) % 1024]
    span = 1
    with np.errstate(over="ignore"):
        while span < GEAR_SPAN:
            shifted = np.zeros_like(total)
            shifted[span:] = total[:-span] << np.uint64(span)
            total = total + shifted
            span *= 2
    # Bits 40-47 depend on the last 48 characters and on nothing before them.
    bits = (total >> np.uint64(GEAR_SPAN - LANDMARK_BITS)) & np.uint64((1 << LANDMARK_BITS) - 1)
    return np.flatnonzero(bits == 0) + 1


def boundary_ranks(text: str) -> np.ndarray:
    """For each cut position 0..n, how natural it is: 4 blank line ... 1 within a line, 0 none."""
    n = len(text)
    rank = np.zeros(n + 1, dtype=np.int8)
    codes = _codes(text)
    if n == 0:
        return rank
    space = (codes == 32) | (codes == 9) | (codes == 0x3000)
    rank[1:][space] = 1
    closer = np.isin(codes, np.fromiter((ord(c) for c in _CLOSERS), dtype=np.uint32))
    rank[1:][closer] = 1
    ends = np.flatnonzero(codes == 10)
    rank[ends + 1] = 2
    indent_before = 0
    lines = text.split("\n")
    at = 0
    for k, line in enumerate(lines[:-1]):
        at += len(line) + 1
        following = lines[k + 1]
        stripped = following.lstrip()
        indent = len(following) - len(stripped)
        if not line.strip():
            rank[at] = 4
        elif stripped and indent == 0 and indent_before > 0:
            rank[at] = 3
        if line.strip():
            indent_before = len(line) - len(line.lstrip())
    if n > 1:  # never between the two characters of a line end
        crlf = np.flatnonzero((codes[:-1] == 13) & (codes[1:] == 10))
        rank[crlf + 1] = -1
        marks = np.flatnonzero((codes[1:] >= 0x300) & (codes[1:] <= 0x36F))
        rank[marks + 1] = -1
    return rank


def _best(rank: np.ndarray, low: int, high: int, near: int) -> int:
    """The most natural position in [low, high]; among equals the one nearest to ``near``."""
    part = rank[low : high + 1]
    top = part.max()
    places = np.flatnonzero(part == top) + low
    return int(places[np.abs(places - near).argmin()])


def split_text(text: str, limit: int = LIMIT, overlap_lines: int = 0) -> list[tuple[int, int, int]]:
    """``(start, new_from, end)`` of each piece; ``text[start:new_from]`` repeats the piece before."""
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    rank, marks = boundary_ranks(text), landmarks(text)
    line_starts = np.concatenate([[0], np.flatnonzero(_codes(text) == 10) + 1])
    pieces: list[tuple[int, int, int]] = []
    cut = start = 0
    while True:
        if n - start <= limit:
            pieces.append((start, cut, n))
            return pieces
        high = start + limit
        low = cut + max(1, min(limit // MIN_SHARE, (high - cut) // 2))
        if overlap_lines > 0:  # the new text, else the piece, is to hold the lines that the next piece repeats, or as many as fit
            fits = int(np.searchsorted(line_starts, high, side="right")) - 1
            last = int(np.searchsorted(line_starts, cut)) + overlap_lines
            if last > fits:
                last = min(int(np.searchsorted(line_starts, start)) + overlap_lines, fits)
            low = max(low, int(line_starts[last]))
        first = int(np.searchsorted(marks, low))
        mark = int(marks[first]) if first < len(marks) and marks[first] <= high else 0
        if mark:
            end = _best(rank, max(low, mark - SNAP_CHARS), min(high, mark + SNAP_CHARS), mark)
            if rank[end] < 2:  # no end of a line nearby; the whole range may have one
                end = _best(rank, low, high, mark)
        else:
            end = _best(rank, low, high, high)
        if rank[end] < 2:  # a short piece rather than a cut within a line that the limit has room for
            at = int(np.searchsorted(line_starts, low)) - 1
            if line_starts[at] > cut and rank[line_starts[at]] >= 2 and _line_end(line_starts, at, n) - line_starts[at] <= limit:
                end = int(line_starts[at])
        pieces.append((start, cut, end))
        held, start = start, end
        cut = end
        # Whole lines before the cut; after a cut within a line its beginning is repeated along with them.
        at = int(np.searchsorted(line_starts, end, side="right")) - 1
        if overlap_lines > 0:
            new = _line_end(line_starts, at, n) - end
            new = new if new <= limit else limit // MIN_SHARE
            take = max(at - overlap_lines, int(np.searchsorted(line_starts, held)))
            while take < at and end - line_starts[take] + new > limit:
                take += 1
            start = int(line_starts[take]) if take < at else end


def _line_end(line_starts: np.ndarray, line: int, n: int) -> int:
    return int(line_starts[line + 1]) if line + 1 < len(line_starts) else n


def split_batches(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                text, base = row.content, row.start_line
                first = 1 if base is None or base != base else int(base)
                lines = np.flatnonzero(_codes(text) == 10)
                for k, (start, new, end) in enumerate(split_text(text, limit, int(row.overlap_lines))):
                    a = first + int(np.searchsorted(lines, start))
                    b = first + int(np.searchsorted(lines, max(start, end - 1)))
                    rows.append((row.chunk_id, row.corpus_id, row.path, k, start, end, new - start, a, b, text[start:end]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    return run


def split_oversized(chunks: DataFrame, corpora: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every chunk longer than ``limit`` code points as overlapping pieces within it.

    The length filter runs in the scan stage, so only oversized rows reach
    Python, and nothing but the small configuration side is shuffled.
    """
    settings = corpora.groupBy("corpus_id").agg(
        F.min(effective_overlap(F.col("window_lines"), F.col("overlap_lines"))).alias("overlap_lines")
    )
    long = chunks.select("chunk_id", "corpus_id", "path", "start_line", "content").where(
        F.char_length("content") > limit
    )
    joined = long.join(settings, "corpus_id", "left").withColumn(
        "overlap_lines", F.coalesce("overlap_lines", F.lit(DEFAULT_OVERLAP))
    )
    return joined.mapInPandas(split_batches(limit), PIECES)


def found(pieces: DataFrame) -> DataFrame:
    """The chunks that were cut, each once. Chunk ids are unique, so piece 0 stands for its chunk."""
    return pieces.where("piece_no = 0").select("chunk_id").distinct()
