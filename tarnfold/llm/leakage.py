"""Held-out evaluation passages inside a corpus, by spaced-seed hashing.

Method. A word is a maximal run of Unicode letters and digits, without case;
everything between words is ignored. Words are hashed for a whole batch of texts at
once, from arrays of their code points. Fixed masks of ``SPAN`` positions read only
some of the positions: each place of a text has a seed hash of the words read per
mask. Documents and items meet in a join on the seed hash. As a mask is no longer
than the shortest passage (12 words), every passage of 12 equal words has a hit of
every mask; as masks skip positions, most passages of that length with one replaced
word have a hit as well. Hits are verified on the diagonal (document position minus
item position): its equal words are cut into overlaps wherever more than
``MAX_SUBSTITUTIONS`` successive words differ, and an overlap that holds a hit is
reported with its length, its equal words and its longest run of equal words.

Both sides may be of any size. A Bloom filter of the items' seed hashes, of a fixed
size, lets a document's seeds through to the join; a document without any sends no row.
Documents with hits go along as word hashes. Hot seeds and hot items (a
passage in a third of all documents) are spread over salts.

Defined results: null, empty and blank texts hold no words and leak nothing; a
repeated document row gives its rows once per (doc_id, item_id); repeated item
rows likewise; an item of fewer than 12 words can't leak; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.sketches import bitmap, maybe
from tarnfold.operators.skew import salted_join
from tarnfold.session import cut

SPAN = 12
MASKS = ("110110111011", "101101011101", "111010010111")
MIN_RUN = 12
MAX_SUBSTITUTIONS = 2
#: Code points hashed at once; a longer text is a batch of its own.
BATCH_CHARS = 1 << 21

OVERLAPS = (
    "doc_id bigint, item_id bigint, doc_word int, item_word int, words int, equal_words int, longest_run int, item_words int"
)


READS = [np.flatnonzero(np.array(list(m)) == "1") for m in MASKS]
_MULTIPLIER = 0x9E3779B97F4A7C15


@cache
def _word_characters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


@cache
def _factors() -> list[np.ndarray]:
    rng = np.random.RandomState(5)
    return [rng.randint(1, 2**62, size=len(r)).astype(np.uint64) | np.uint64(1) for r in READS]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, starts)``: the 64-bit hashes of the words of all texts, and where each text's begin."""
    folded = [t.casefold() for t in texts]
    points = np.frombuffer("\n".join([*folded, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.flatnonzero(_word_characters()[points])
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    if not len(at):
        return np.zeros(0, dtype=np.uint64), starts
    begin = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    sizes = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, sizes)
    powers = np.full(int(sizes.max()), np.uint64(_MULTIPLIER))
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    hashes = np.add.reduceat((points[at].astype(np.uint64) + np.uint64(1)) * powers[place], begin)
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    ends = np.cumsum([len(f) + 1 for f in folded])
    starts[1:] = np.searchsorted(at[begin], ends)
    return hashes ^ (hashes >> np.uint64(29)), starts


def seeds(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(seed hashes, places)`` of all masks; a place is that of the span's first word, and no span leaves its text."""
    n = len(hashes) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    last = np.repeat(starts[1:], np.diff(starts))[:n]
    fits = np.flatnonzero(np.arange(n) + SPAN <= last)
    out = []
    for k, (reads, factors) in enumerate(zip(READS, _factors(), strict=True)):
        h = np.full(n, np.uint64(k))
        for at, factor in zip(reads, factors, strict=True):
            h += hashes[at : at + n] * factor
        out.append((h ^ (h >> np.uint64(31)))[fits])
    return np.concatenate(out), np.tile(fits, len(MASKS))


def overlaps(docs: list[np.ndarray], items: list[np.ndarray], pair: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(pair, doc_word, item_word, words, equal, longest run)`` of the overlaps that hold a seed hit, on all diagonals at once.

    ``pair`` and ``shift`` name the diagonals: document word minus item word, of which document and item.
    """
    d_size, i_size = np.array([len(x) for x in docs]), np.array([len(x) for x in items])
    lo, hi = np.maximum(0, -shift), np.minimum(i_size[pair], d_size[pair] - shift)
    some = np.flatnonzero(hi - lo >= SPAN)
    pair, shift, lo, n = pair[some], shift[some], lo[some], (hi - lo)[some]
    if not len(n):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    start = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    item_word = np.arange(len(row)) - start[row] + lo[row]
    in_doc = (np.cumsum(d_size) - d_size)[pair[row]] + item_word + shift[row]
    in_item = (np.cumsum(i_size) - i_size)[pair[row]] + item_word
    same = np.concatenate(docs)[in_doc] == np.concatenate(items)[in_item]
    whole = np.concatenate([same, np.zeros(SPAN, dtype=bool)])
    hit = np.zeros(len(same), dtype=bool)
    for reads in READS:
        hit |= np.logical_and.reduce([whole[at : at + len(same)] for at in reads])
    hit &= np.arange(len(row)) <= (start + n - SPAN)[row]
    hits, equal = np.concatenate([[0], np.cumsum(hit)]), np.concatenate([[0], np.cumsum(same)])
    places = np.flatnonzero(same)
    if not len(places):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    step, other = np.diff(places), np.diff(row[places]) > 0
    run = np.append(0, np.flatnonzero((step > 1) | other) + 1)
    part = np.append(0, np.flatnonzero((step > MAX_SUBSTITUTIONS + 1) | other) + 1)
    longest = np.maximum.reduceat(np.diff(np.append(run, len(places))), np.searchsorted(run, part))
    a, b = places[part], places[np.append(part[1:], len(places)) - 1] + 1
    # A mask may begin or end on words that it skips, so a hit may stand out at either side.
    fine = np.flatnonzero(hits[b] > hits[np.maximum(a - SPAN + 1, start[row[a]])])
    a, b, longest = a[fine], b[fine], longest[fine]
    return pair[row[a]], item_word[a] + shift[row[a]], item_word[a], b - a, equal[b] - equal[a], longest


SEEDED = "key bigint, id bigint, words array<bigint>, seeds array<struct<h: bigint, p: int>>"


def _seeded(sketch: np.ndarray | None, masks: int = 1):
    """Texts -> their word hashes and seeds; with a sketch, only those texts and places that it lets through by ``masks`` masks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch.text.map(len).to_numpy()
            part = np.cumsum(sizes) // BATCH_CHARS
            for _, some in batch.groupby(part, sort=False):
                hashes, starts = words(some.text.to_list())
                h, at = seeds(hashes, starts)
                h = h.view(np.int64)
                if sketch is not None:
                    through = maybe(sketch, h).reshape(len(MASKS), -1)
                    keep = np.flatnonzero(through & (through.sum(axis=0) >= masks))
                    h, at = h[keep], at[keep]
                owner = np.searchsorted(starts, at, side="right") - 1
                order = np.argsort(owner, kind="stable")
                h, at, owner = h[order], at[order], owner[order]
                rows = []
                for i in np.unique(owner):
                    a, b = np.searchsorted(owner, [i, i + 1])
                    s = starts[i]
                    found = [{"h": x, "p": y} for x, y in zip(h[a:b].tolist(), (at[a:b] - s).tolist(), strict=True)]
                    rows.append((some["key"].iat[i], some["id"].iat[i], hashes[s : starts[i + 1]].view(np.int64), found))
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "id", "words", "seeds"])

    return run


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes = batch.item_words.map(len).to_numpy() * batch.shifts.map(len).to_numpy()
        for _, some in batch.groupby(np.cumsum(sizes) // BATCH_CHARS, sort=False):
            shifts = [np.asarray(x, dtype=np.int64) for x in some.shifts]
            pair = np.repeat(np.arange(len(some)), [len(x) for x in shifts])
            items = some.item_words.to_list()
            pair, d, i, n, equal, run = overlaps(some.doc_words.to_list(), items, pair, np.concatenate(shifts))
            yield pd.DataFrame({
                "doc_id": some.doc_id.to_numpy()[pair], "item_id": some.item_id.to_numpy()[pair], "doc_word": d, "item_word": i,
                "words": n, "equal_words": equal, "longest_run": run, "item_words": np.array([len(x) for x in items])[pair],
            })


def _texts(table: DataFrame, name: str) -> DataFrame:
    """Each text of an id has a key of its own; rows given twice have the same one."""
    rows = table.select(F.col(name).alias("id"), "text").where(F.col("id").isNotNull() & F.col("text").isNotNull())
    return rows.select(F.xxhash64("id", "text").alias("key"), "id", "text")


def leaked_overlaps(documents: DataFrame, items: DataFrame, masks: int = 1) -> DataFrame:
    """Every verified overlap between a document and an item; one row per diagonal and place.

    ``masks``: how many masks must agree on a place for its diagonal to be verified. A run
    of ``SPAN`` equal words has the hits of all of them.
    """
    spark = documents.sparkSession
    held = cut(_texts(items, "item_id").dropDuplicates(["key"]).mapInPandas(_seeded(None), SEEDED))
    wanted = held.select(F.col("key").alias("item_key"), F.explode("seeds").alias("s")).select("item_key", "s.h", F.col("s.p").alias("q"))
    sketch = spark.sparkContext.broadcast(bitmap(wanted.select("h")))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _seeded(sketch.value, masks)(batches)

    hits = cut(_texts(documents, "doc_id").mapInPandas(scan, SEEDED))
    seeds_of = cut(hits.select("key", F.explode("seeds").alias("s")).select("key", "s.h", F.col("s.p").alias("p")).distinct())
    met = salted_join(seeds_of, wanted, ["h"]).select("key", "item_key", "p", "q")
    if masks > 1:
        met = met.groupBy("key", "item_key", "p", "q").agg(F.count("*").alias("n")).where(F.col("n") >= masks)
    met = met.groupBy("key", "item_key").agg(F.collect_set(F.col("p") - F.col("q")).alias("shifts"))
    texts = hits.select("key", F.col("id").alias("doc_id"), F.col("words").alias("doc_words")).dropDuplicates(["key"])
    pairs = cut(met.join(texts, "key").drop("key"))
    sides = held.select(F.col("key").alias("item_key"), F.col("id").alias("item_id"), F.col("words").alias("item_words"))
    return salted_join(pairs, sides, ["item_key"]).drop("item_key").mapInPandas(_verified, OVERLAPS)


def leak_report(overlaps: DataFrame) -> DataFrame:
    """Per document and item: overlaps, the longest, and the share of the item's words they cover at most."""
    return overlaps.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("overlaps"),
        F.max("longest_run").alias("longest_run"),
        F.max("words").alias("longest_overlap"),
        F.round(F.max(F.col("equal_words") / F.col("item_words")), 6).alias("share_of_item"),
    )


def found(documents: DataFrame, items: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``(doc_id, item_id)``: the document holds at least ``min_run`` successive words of the item."""
    sure = len(MASKS) if min_run >= SPAN else 1
    return leaked_overlaps(documents, items, sure).where(F.col("longest_run") >= min_run).select("doc_id", "item_id").distinct()
