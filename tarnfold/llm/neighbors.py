"""The k most similar vectors of every vector, from robust-pruned graphs.

Method.
1. Usable vectors (the given dimension, all entries finite, not all zero) are
   grouped by equality. A group keeps its k + 1 smallest ids, which is all that any
   member's result can hold of it. Copies thus never enter a graph, and a vector
   shared by a third of all rows is one graph node.
2. Spherical k-means over a bounded sample (``FIT_SAMPLE`` vectors) gives
   centroids, in proportion to the number of distinct vectors. Each vector is
   indexed in the shard of its nearest centroid. Shards above ``SHARD_MAX``
   vectors are cut into equal random parts, so that no task grows.
3. In each shard a directed graph is built by batched insertion: greedy beam
   search proposes neighbours, relaxed distance pruning (factor ``ALPHA``) keeps
   diverse edges, reversed edges are added and pruned again once a list overflows.
4. A vector's own shard is searched from its own node, which needs a short beam only;
   the graphs of the next nearest centroids by a longer beam from fixed entries. The
   shards' answers are merged by rank.
5. How many shards a vector asks is measured: the exact neighbours of ``CALIBRATE``
   sampled vectors are found in one pass over all vectors, and the smallest number
   of nearest centroids that covers ``COVERAGE`` of them is taken (each shard, if need be).

The index and the queries are routed apart, so queries of a few vectors move a few
vectors; each arrives by one shuffle of 256 bytes per vector and probe.

Defined results: null, empty, zero, wrong-length and non-finite vectors are left
out on both sides; equal similarities are ordered by smaller id; a repeated
row counts once (``vec_id`` is the key of a vector); an empty table gives no rows.
Cosines are computed from unit vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfold.operators.skew import salted_join
from tarnfold.session import cut

DIM = 64
K = 10
DEGREE = 28
ROOM = 36
BUILD_BEAM = 32
QUERY_BEAM = 64
FOUND_BEAM = 32
WARM_BEAM = 20
ALPHA = 1.2
EXPAND = 4
FIT_SAMPLE = 40_000
#: A shard holds so many vectors; fewer, down to the second figure, where that gives at least SHARDS of them.
SHARD_TARGET, SHARD_LEAST, SHARDS = 20_000, 6_000, 48
SHARD_MAX = 60_000
QUERY_MAX = 120_000
CALIBRATE = 512
COVERAGE = 0.995
BLOCK = 512

Arrays = tuple[np.ndarray, np.ndarray]


def beam_search(
    points: np.ndarray, edges: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int
) -> Arrays:
    """Greedy beam search of a block of queries at once; (ids, cosines) by falling cosine.

    Each round expands the ``EXPAND`` best unexpanded nodes of each query's beam,
    until no query has one left. ``entries`` are those of all queries, or a row for
    each. Missing places hold id -1 and cosine -2.
    """
    n_q = len(queries)
    rows = np.arange(n_q)[:, None]
    seen = np.zeros((n_q, len(points) + 1), dtype=bool)  # the last column stands for id -1
    seen[:, -1] = True
    first = entries if entries.ndim == 2 else np.broadcast_to(entries, (n_q, len(entries)))
    first = first[:, :beam]
    width = first.shape[1]
    seen[rows, first] = True
    ids = np.full((n_q, beam), -1, dtype=np.int32)
    sims = np.full((n_q, beam), -2.0, dtype=np.float32)
    done = np.ones((n_q, beam), dtype=bool)
    ids[:, :width] = first
    sims[:, :width] = np.matmul(points[first], queries[:, :, None])[:, :, 0]
    done[:, :width] = False
    alive = np.arange(n_q)
    expand = min(EXPAND, beam)
    while len(alive):
        open_sims = np.where(done[alive], -3.0, sims[alive])
        pick = np.argpartition(-open_sims, expand - 1, axis=1)[:, :expand]
        local = np.arange(len(alive))[:, None]
        usable = open_sims[local, pick] > -2.5
        nodes = np.where(usable, ids[alive[:, None], pick], -1)
        done[alive[:, None], pick] = True
        near = edges[nodes].reshape(len(alive), -1)  # edges[-1] is a row of -1
        near[seen[alive[:, None], near]] = -1
        near = -np.sort(-near, axis=1)
        near = near[:, : max(1, int((near >= 0).sum(axis=1).max()))]
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[alive[:, None], near] = True
        got = np.matmul(points[near], queries[alive][:, :, None])[:, :, 0]
        got[near < 0] = -2.0
        all_ids = np.concatenate([ids[alive], near], axis=1)
        all_sims = np.concatenate([sims[alive], got], axis=1)
        all_done = np.concatenate([done[alive], near < 0], axis=1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[alive] = all_ids[local, keep]
        sims[alive] = all_sims[local, keep]
        kept_done = all_done[local, keep]
        done[alive] = kept_done
        alive = alive[~kept_done.all(axis=1)]
    order = np.argsort(-sims, axis=1, kind="stable")
    return ids[rows, order], sims[rows, order]


def robust_prune(points: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Keep at most ``degree`` diverse neighbours of each node from its candidates (by falling cosine).

    A candidate is dropped if a kept neighbour is nearer to it, by the factor
    ``ALPHA`` in distance, than the node itself.
    """
    own = ids == nodes[:, None]
    live = (ids >= 0) & ~own
    vectors = points[ids]
    between = 1.0 - np.matmul(vectors, vectors.transpose(0, 2, 1))
    to_node = 1.0 - sims
    out = np.full((len(nodes), degree), -1, dtype=np.int32)
    filled = np.zeros(len(nodes), dtype=np.int64)
    rows = np.arange(len(nodes))
    relaxed = ALPHA * ALPHA  # 1 - cosine is half the squared distance
    for _ in range(degree):
        column = live.argmax(axis=1)
        has = live[rows, column]
        if not has.any():
            break
        r, c = rows[has], column[has]
        out[r, filled[has]] = ids[r, c]
        filled[has] += 1
        live[r, c] = False
        live[r] &= relaxed * between[r, c] > to_node[r]
    return out


def _sorted_candidates(points: np.ndarray, nodes: np.ndarray, ids: np.ndarray) -> Arrays:
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    sims = np.matmul(points[ids], points[nodes][:, :, None])[:, :, 0]
    sims[ids < 0] = -2.0
    order = np.argsort(-sims, axis=1, kind="stable")
    rows = np.arange(len(nodes))[:, None]
    return ids[rows, order], sims[rows, order]


def build_graph(points: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """``(edges, entries)`` of a shard. ``edges`` has an additional last row of -1.

    A list holds up to ``ROOM`` edges and is pruned to ``DEGREE`` when more arrive.
    """
    n = len(points)
    edges = np.full((n + 1, ROOM), -1, dtype=np.int32)
    order = np.random.RandomState(seed).permutation(n).astype(np.int32)
    entries = order[: min(n, 8)]
    first = min(n, DEGREE + 1)
    for node in order[:first]:  # the first few know each other
        others = order[:first][order[:first] != node][:DEGREE]
        edges[node, : len(others)] = others
    at = first
    while at < n:
        block = order[at : at + min(BLOCK, max(32, at // 2))]
        at += len(block)
        ids, sims = beam_search(points, edges, points[block], entries, BUILD_BEAM)
        edges[block, :DEGREE] = robust_prune(points, block, ids, sims, DEGREE)
        # Reversed edges: free places take them; a full list is pruned with them.
        source = np.repeat(block, DEGREE)
        target = edges[block, :DEGREE].ravel()
        ok = target >= 0
        source, target = source[ok], target[ok]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), BLOCK):
            part, b, c = nodes[lo : lo + BLOCK], begin[lo : lo + BLOCK], count[lo : lo + BLOCK]
            extra = np.full((len(part), c.max()), -1, dtype=np.int32)
            flat = np.concatenate([np.arange(x, x + y) for x, y in zip(b, c, strict=True)])
            extra[np.repeat(np.arange(len(part)), c), flat - np.repeat(b, c)] = source[flat]
            have = (edges[part] >= 0).sum(axis=1)
            merged = np.concatenate([edges[part], extra], axis=1)
            roomy = have + c <= ROOM
            if roomy.any():
                packed = -np.sort(-merged[roomy], axis=1)
                edges[part[roomy]] = packed[:, :ROOM]
            full = ~roomy
            if full.any():
                ids, sims = _sorted_candidates(points, part[full], merged[full])
                edges[part[full]] = -1
                edges[part[full], :DEGREE] = robust_prune(points, part[full], ids, sims, DEGREE)
    return edges, entries


def search_shard(points: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, beam: int = QUERY_BEAM) -> tuple[Arrays, Arrays]:
    """The ``k`` best points of each query, and of each node in ``own``, in one shard, by its graph."""
    edges, entries = build_graph(points)

    def search(x: np.ndarray, start: np.ndarray, width: int) -> Arrays:
        found = [
            beam_search(points, edges, x[lo : lo + BLOCK], start if start.ndim == 1 else start[lo : lo + BLOCK], max(width, k))
            for lo in range(0, len(x), BLOCK)
        ] or [(np.zeros((0, k), dtype=np.int32), np.zeros((0, k), dtype=np.float32))]
        return np.concatenate([f[0][:, :k] for f in found]), np.concatenate([f[1][:, :k] for f in found])

    return search(queries, entries, beam), search(points[own], own[:, None], max(WARM_BEAM, beam // 2))


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Spherical k-means; unit float32 centroids. The sample is bounded by the caller."""
    rng = np.random.RandomState(seed)
    centroids = sample[rng.permutation(len(sample))[:count]].copy()
    for _ in range(rounds):
        nearest = np.concatenate([(sample[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        keep = norms > 1e-6
        centroids[keep] = sums[keep] / norms[keep, None]
    return centroids


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """``(vec_id, vec)`` of the usable vectors, each id once."""
    v = F.col("vec")
    fine = (
        F.col("vec_id").isNotNull()
        & (F.size(v) == dim)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return vectors.select("vec_id", "vec").where(F.coalesce(fine, F.lit(False)))


def keyed(vectors: DataFrame) -> DataFrame:
    """Two independent 64-bit hashes, which stand for the vector wherever it isn't needed itself."""
    return vectors.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(2), "vec")})


def distinct_vectors(vectors: DataFrame, k: int = K) -> DataFrame:
    """``(rep, ids, h1, h2, vec)``: each distinct vector, its smallest id and its k + 1 smallest ids.

    The rank limit acts before the shuffle too, so a hot vector sends k + 1 rows a task.
    """
    by_vec = Window.partitionBy("h1", "h2").orderBy("vec_id")
    return (
        keyed(vectors)
        .withColumn("rn", F.dense_rank().over(by_vec))
        .where(F.col("rn") <= k + 1)
        .groupBy("h1", "h2")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.any_value("vec").alias("vec"))
        .select(F.col("ids")[0].alias("rep"), "ids", "h1", "h2", "vec")
    )


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest centroids of each vector, the nearest first."""
    out = []
    for i in range(0, len(x), 4096):
        sims = x[i : i + 4096] @ centroids.T
        n = min(probes, len(centroids))
        near = np.argpartition(-sims, n - 1, axis=1)[:, :n] if n < len(centroids) else np.tile(np.arange(n), (len(sims), 1))
        out.append(np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out) if out else np.zeros((0, min(probes, len(centroids))), dtype=np.int64)


ROUTED = "shard bigint, probe boolean, own boolean, rep bigint, vec array<float>"


@dataclass(frozen=True)
class Layout:
    """Cells and their shards: cell c has ``parts[c]`` disjoint parts, each of which answers every query of
    the cell, and ``copies[c]`` copies of each part, among which queries are spread."""

    centroids: np.ndarray
    parts: np.ndarray
    copies: np.ndarray
    probes: int

    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.parts * self.copies)])

    @staticmethod
    def spread(rep: np.ndarray) -> np.ndarray:
        return ((rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)

    def index(self, everyone: bool):
        """Rows to be indexed, in each copy of their part; one copy answers their own query, if everyone asks."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            offsets, parts, copies = self.offsets(), self.parts, self.copies
            for batch in batches:
                if not len(batch):
                    continue
                home = _nearest(_unit(batch.vec).astype(np.float32), self.centroids, 1)[:, 0]
                rep = batch.rep.to_numpy()
                spread = self.spread(rep)
                n = copies[home]
                row = np.repeat(np.arange(len(batch)), n)
                copy = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                h = home[row]
                own = everyone & (copy == (spread[row] // 64) % n[row])
                yield pd.DataFrame({
                    "shard": offsets[h] + (spread[row] % parts[h]) * copies[h] + copy, "probe": False, "own": own, "rep": rep[row], "vec": batch.vec.to_numpy()[row],
                })

        return run

    def queries(self, everyone: bool):
        """Rows that query the nearest cells; without their own part, if everyone asks there from its own node."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            offsets, parts, copies = self.offsets(), self.parts, self.copies
            for batch in batches:
                if not len(batch):
                    continue
                cells = _nearest(_unit(batch.vec).astype(np.float32), self.centroids, self.probes)
                rep = batch.rep.to_numpy()
                spread = self.spread(rep)
                row = np.repeat(np.arange(len(batch)), cells.shape[1])
                cell = cells.ravel()
                first = np.arange(len(row)) % cells.shape[1] == 0
                n = parts[cell]
                row, first, cell = np.repeat(row, n), np.repeat(first, n), np.repeat(cell, n)
                part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                keep = ~(everyone & first & (part == spread[row] % parts[cell]))
                row, cell, part = row[keep], cell[keep], part[keep]
                yield pd.DataFrame({
                    "shard": offsets[cell] + part * copies[cell] + (spread[row] // 64) % copies[cell], "probe": True, "own": False, "rep": rep[row], "vec": batch.vec.to_numpy()[row],
                })

        return run


def _hits(rep: list, near: list, sims: list) -> pd.DataFrame:
    lists = lambda x: pd.Series(x, dtype=object)
    return pd.DataFrame({"rep": pd.Series(rep, dtype="int64"), "near": lists(near), "sims": lists(sims)})


def _search(k: int, floor: float, beam: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        indexed = ~group.probe.to_numpy()
        if not indexed.any():
            return _hits([], [], [])
        unit = _unit(group.vec)
        points, ids, own = unit[indexed], group.rep.to_numpy()[indexed], group.own.to_numpy()[indexed]
        order = np.argsort(ids)
        points, ids, own = points[order], ids[order], np.flatnonzero(own[order])
        queries, reps = unit[~indexed], group.rep.to_numpy()[~indexed]
        asked, warm = search_shard(points.astype(np.float32), queries.astype(np.float32), own, k + 1, beam)
        out_near, out_sims, out_rep = [], [], []
        for got, who, x in ((asked[0], reps, queries), (warm[0], ids[own], points[own])):
            for lo in range(0, len(who), 4096):
                near = got[lo : lo + 4096]
                sims = np.einsum("qd,qkd->qk", x[lo : lo + 4096], points[near])
                there = (near >= 0) & (ids[near] != who[lo : lo + 4096, None]) & (sims >= floor)
                for i in np.flatnonzero(there.any(axis=1)):
                    out_rep.append(who[lo + i])
                    out_near.append(ids[near[i][there[i]]])
                    out_sims.append(sims[i][there[i]])
        return _hits(out_rep, out_near, out_sims)

    return run


def measured_probes(classes: DataFrame, centroids: np.ndarray, total: int, k: int, floor: float, coverage: float) -> int:
    """How many nearest centroids hold ``coverage`` of the exact neighbours of ``CALIBRATE`` sampled vectors."""
    if len(centroids) == 1:
        return 1
    share = min(1.0, CALIBRATE / max(1, total))
    picked = classes.where(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).select("rep", "vec")
    sample = picked.orderBy("rep").limit(2 * CALIBRATE).toPandas()
    if not len(sample):
        return 1
    asks, reps = _unit(sample.vec).astype(np.float32), sample.rep.to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[Arrays] = []
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(batch.vec).astype(np.float32)
            sims = asks @ x.T
            sims[reps[:, None] == batch.rep.to_numpy()[None, :]] = -2.0
            home = _nearest(x, centroids, 1)[:, 0]
            n = min(k, sims.shape[1])
            top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
            best.append((np.take_along_axis(sims, top, axis=1), home[top]))
            if len(best) == 16:
                best = [_top(best, k)]
        if best:
            sims, home = _top(best, k)
            q, c = np.nonzero(sims >= max(floor, -1.0))
            yield pd.DataFrame({"q": q.astype(np.int32), "home": home[q, c].astype(np.int32), "sim": sims[q, c].astype(np.float64)})

    by_query = Window.partitionBy("q").orderBy(F.desc("sim"), "home")
    rows = classes.select("rep", "vec").mapInPandas(run, "q int, home int, sim double")
    rows = rows.withColumn("rn", F.row_number().over(by_query)).where(F.col("rn") <= k).select("q", "home").toPandas()
    if not len(rows):
        return 1
    order = _nearest(asks, centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), axis=0), axis=1)
    needed = np.sort(place[rows.q.to_numpy(), rows.home.to_numpy()])
    return int(needed[min(len(needed) - 1, int(np.ceil(coverage * len(needed))) - 1)]) + 1


def _top(best: list[Arrays], k: int) -> Arrays:
    sims, home = np.concatenate([b[0] for b in best], axis=1), np.concatenate([b[1] for b in best], axis=1)
    n = min(k, sims.shape[1])
    top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
    return np.take_along_axis(sims, top, axis=1), np.take_along_axis(home, top, axis=1)


def most_similar(
    vectors: DataFrame,
    k: int = K,
    floor: float = -1.0,
    probes: int | None = None,
    queries: DataFrame | None = None,
    dim: int = DIM,
    beam: int = QUERY_BEAM,
    coverage: float = COVERAGE,
) -> DataFrame:
    """``(vec_id, rank, neighbor_id, cosine)``: the ``k`` most similar others of each vector.

    ``floor`` leaves out less similar ones; ``queries`` (a ``vec_id`` column)
    restricts whose neighbours are searched, never what is searched. ``probes`` fixes
    the number of shards that a vector asks, which is measured otherwise.
    """
    spark = vectors.sparkSession
    clean = usable(vectors, dim)
    classes = cut(distinct_vectors(clean, k))
    total = classes.count()
    share = min(1.0, FIT_SAMPLE / max(1, total))
    # The sample is by hash, so a rerun fits the same centroids; its bound is FIT_SAMPLE on average.
    taken = classes.where(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000)).select("vec")
    sample = taken.limit(2 * FIT_SAMPLE).toPandas()
    if not len(sample):
        return spark.createDataFrame([], "vec_id bigint, rank int, neighbor_id bigint, cosine double")
    fit = _unit(sample.vec).astype(np.float32)
    wished = max(total / SHARD_TARGET, min(total / SHARD_LEAST, SHARDS))
    count = max(1, min(round(wished), len(fit) // 4 or 1))
    centroids = fit_centroids(fit, count)
    probes = min(count, probes or measured_probes(classes, centroids, total, k, floor, coverage))
    members = keyed(clean).select("vec_id", "h1", "h2").distinct()
    asking = classes
    if queries is not None:
        members = members.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
        asking = classes.join(members, ["h1", "h2"], "left_semi")
    scale = total / len(fit)
    load = np.bincount((fit @ centroids.T).argmax(axis=1), minlength=count) * scale
    asks = np.bincount(_nearest(fit, centroids, probes).ravel(), minlength=count) * scale * (queries is None)
    parts = np.maximum(1, np.ceil(load / SHARD_MAX)).astype(np.int64)
    copies = np.maximum(1, np.ceil(asks / QUERY_MAX)).astype(np.int64)
    layout, everyone = Layout(centroids, parts, copies, probes), queries is None
    routed = classes.select("rep", "vec").mapInPandas(layout.index(everyone), ROUTED).unionByName(
        asking.select("rep", "vec").mapInPandas(layout.queries(everyone), ROUTED)
    )
    hits = routed.groupBy("shard").applyInPandas(
        _search(k, floor, beam), "rep bigint, near array<bigint>, sims array<double>"
    )
    # Per class: its own k + 1 smallest ids at cosine 1, then the neighbours' ids; k + 1 in all suffice.
    pairs = hits.select("rep", F.explode(F.arrays_zip("near", "sims")).alias("x")).select(
        "rep", F.col("x.near").alias("near"), F.col("x.sims").alias("cosine")
    )
    other = classes.select(F.col("rep").alias("near"), F.col("ids").alias("near_ids"))
    expanded = pairs.join(other, "near").select("rep", "cosine", F.explode("near_ids").alias("neighbor_id"))
    own = asking.select("rep", F.lit(1.0).alias("cosine"), F.explode("ids").alias("neighbor_id"))
    ranked = Window.partitionBy("rep").orderBy(F.desc("cosine"), "neighbor_id")
    lists = (
        expanded.unionByName(own)
        .withColumn("rn", F.row_number().over(ranked))
        .where(F.col("rn") <= k + 1)
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "neighbor_id", "cosine"))).alias("near"))
    )
    by_class = lists.join(asking.select("rep", "h1", "h2"), "rep")
    joined = salted_join(cut(members), by_class, ["h1", "h2"])
    others = F.slice(F.filter("near", lambda x: x["neighbor_id"] != F.col("vec_id")), 1, k)
    return joined.select("vec_id", F.posexplode(others).alias("p", "x")).select(
        "vec_id", (F.col("p") + 1).alias("rank"), F.col("x.neighbor_id").alias("neighbor_id"), F.col("x.cosine").alias("cosine")
    ).where(F.col("cosine") >= floor)


def found(vectors: DataFrame, floor: float = 0.90, k: int = K, dim: int = DIM) -> DataFrame:
    """``(vec_a, vec_b)``: pairs with cosine at least ``floor``, one among the other's ``k`` nearest."""
    near = most_similar(vectors, k, floor, dim=dim, beam=FOUND_BEAM)
    return near.select(
        F.least("vec_id", "neighbor_id").alias("vec_a"), F.greatest("vec_id", "neighbor_id").alias("vec_b")
    ).distinct()
