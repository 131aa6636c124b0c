import numpy as np
from pyspark.sql import functions as F

from tarnfold.llm import neighbors


def exact(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 12)
    out = {}
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-sims[a, b], ids[b]))
        out[i] = [ids[b] for b in order[:k]]
    return out, {(ids[a], ids[b]): sims[a, b] for a in range(len(ids)) for b in range(len(ids)) if a != b}


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, vec array<float>")


def test_recall_and_pairs_against_brute_force(spark):
    rng = np.random.RandomState(1)
    centers = rng.randn(40, 64)
    v = {i + 1: (centers[i % 40] + 0.2 * rng.randn(64)) * (1 + i % 3) for i in range(1200)}
    v |= {5000 + i: rng.randn(64) for i in range(400)}
    v = {i: np.float32(x).tolist() for i, x in v.items()}
    df = table(spark, list(v.items()))
    near, sims = exact(v, 10)
    got = {}
    for r in neighbors.most_similar(df, 10, probes=None).collect():
        got.setdefault(r.vec_id, []).append(r.neighbor_id)
    assert set(got) == set(v)
    recall = np.mean([len(set(got[i]) & set(near[i])) / 10 for i in v])
    assert recall >= 0.9, recall
    want = {(min(i, j), max(i, j)) for i in v for j in near[i] if sims[i, j] >= 0.9}
    pairs = {(r.vec_a, r.vec_b) for r in neighbors.found(df).collect()}
    assert len(pairs & want) >= 0.97 * len(want) and len(pairs - want) <= 0.03 * len(pairs)


def test_copies_ties_and_unusable_rows(spark):
    a, b = [1.0] + [0.0] * 63, [0.0, 1.0] + [0.0] * 62
    rows = [(i, a) for i in range(1, 31)] + [(1, a)] + [(100, b), (101, b)]
    rows += [(200, None), (201, []), (202, [0.0] * 64), (203, a[:32]), (204, [float("nan")] * 64), (205, [None] * 64), (None, a)]
    df = table(spark, rows).withColumn("cosine", F.lit("clash")).withColumn("rep", F.lit(1))
    got = {}
    for r in neighbors.most_similar(df, 10).orderBy("rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbor_id)
    assert got[30] == list(range(1, 11)) and got[1] == list(range(2, 12)) and got[100][0] == 101
    pairs = {(r.vec_a, r.vec_b) for r in neighbors.found(df).collect()}
    want = {(min(i, j), max(i, j)) for i in range(1, 31) for j in [x for x in range(1, 31) if x != i][:10]} | {(100, 101)}
    assert pairs == want


def test_empty_and_single(spark):
    assert neighbors.found(table(spark, [])).count() == 0
    assert neighbors.found(table(spark, [(1, [1.0] * 64)])).count() == 0


def test_stated_queries_search_all_rows(spark):
    rng = np.random.RandomState(2)
    v = {i: np.float32(rng.randn(64)).tolist() for i in range(1, 301)}
    df = table(spark, list(v.items()))
    near, _ = exact(v, 10)
    got = neighbors.most_similar(df, 10, probes=None, queries=df.where("vec_id % 100 = 0")).collect()
    assert {r.vec_id for r in got} == {100, 200, 300}
    assert sum(r.neighbor_id in near[r.vec_id] for r in got) >= 27
