import random

import numpy as np

from tessera.plans import readmodels as R


def test_vector_topk_against_all_pairs(spark):
    r = np.random.default_rng(1)
    vectors = {i: np.round(r.normal(size=4), 1).tolist() for i in range(200)}
    vectors |= {200 + i: vectors[i] for i in range(30)}  # ties
    rows = [*vectors.items(), (900, None), (901, [0.0] * 4), (902, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v in vectors.items() if any(v)}
    want = {(q, n + 1, i) for q in unit for n, (_, i) in enumerate(sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in unit if i != q)[:5])}
    for shard_rows in (65_536, 50):
        got = R.vector_topk(df, df, 5, shard_rows).collect()
        assert {(x["query_id"], x["rank"], x["vec_id"]) for x in got} == want
    assert R.vector_topk(df.limit(0), df, 5).count() == 0


def test_reachable_against_search(spark):
    r = random.Random(2)
    edges = {(r.randrange(12), r.randrange(12)) for _ in range(20)}
    got = {(x["src"], x["dst"]): x["hops"] for x in R.reachable(spark.createDataFrame(sorted(edges), "src int, dst int"), 3).collect()}
    want, frontier = {}, edges
    for n in range(1, 4):
        for e in frontier:
            want.setdefault(e, n)
        frontier = {(a, d) for a, b in frontier for c, d in edges if b == c}
    assert got == want
