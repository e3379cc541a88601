import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm import quality as C

from .helpers import awkward, frame, text

LABELS = "doc_id long, quality int, toxic int"


def test_isotonic_against_brute_force():
    """Each fitted value is max over starts of min over ends of the mean between them."""
    r = np.random.default_rng(1)
    for _ in range(30):
        n = int(r.integers(1, 25))
        s, y = np.round(r.normal(size=n), 1), (r.random(n) < 0.5).astype(float)
        u = np.unique(s)
        means = lambda a, b: y[(s >= u[a]) & (s <= u[b])].mean()
        want = [max(min(means(a, b) for b in range(i, len(u))) for a in range(i + 1)) for i in range(len(u))]
        assert np.allclose(np.interp(u, *C.isotonic(s, y)), want)
    assert C.isotonic(np.zeros(0), np.zeros(0))[0].tolist() == [0.0, 1.0]


def test_features_approximate_a_gaussian_kernel():
    r = random.Random(2)
    texts = [text(r, n) for n in (5, 20, 80, 300, 40, 60)]
    m = C.Model()
    x = C.statistics(texts, None)
    m.mean, m.scale = x.mean(0), x.std(0) + 1e-6
    z = m.features(texts)[:, :-1]
    x = np.clip((x - m.mean) / m.scale, -4, 4)
    far = ((x[:, None] - x[None]) ** 2).sum(2) / (C.WIDTH**2 * x.shape[1])
    assert np.abs(z @ z.T - np.exp(-far / 2)).max() < 0.2


def corpus(r, n):
    docs, labels = [], []
    for i in range(n):
        good, toxic = r.random() < 0.7, r.random() < 0.15
        t = text(r, r.choice([20, 80, 200])) if good else " ".join(r.choice(["@@", "$$$", "buy", "###", "now"]) for _ in range(r.choice([20, 80])))
        if toxic:
            own = t.split(" ")
            for _ in range(4):
                own.insert(r.randrange(len(own)), r.choice(["vileword", "nastyword"]))
            t = " ".join(own)
        docs.append((i, t))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_partition_sums_give_the_ridge_solution(spark):
    docs, labels = corpus(random.Random(3), 400)
    df = frame(spark, docs)
    m = C.fit(df, spark.createDataFrame(labels, LABELS))
    ids = {x["doc_id"] for x in df.where(F.pmod(F.xxhash64("doc_id"), F.lit(C.HOLDOUT)) != 0).collect()}
    firsts = {}
    for i, t in docs:
        firsts.setdefault(t, i)
    rows = [i for i in firsts.values() if i in ids]
    z = m.features([docs[i][1] for i in rows])
    y = np.array([labels[i][1:] for i in rows], float)
    penalty = np.eye(z.shape[1]) * C.RIDGE * len(rows) / C.FEATURES
    penalty[-1, -1] = 0
    want = np.linalg.solve(z.T @ z + penalty + 1e-9 * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ m.weights, z @ want, atol=1e-6)


def test_held_out_accuracy(spark):
    docs, labels = corpus(random.Random(4), 900)
    known = spark.createDataFrame(labels[:600], LABELS)
    got = {x["doc_id"]: x for x in C.score(frame(spark, docs), known).collect()}
    assert set(got) == set(range(900))
    rest = labels[600:]
    assert sum((got[i]["p_quality"] >= 0.5) == q for i, q, _ in rest) >= 0.95 * len(rest)
    assert sum((got[i]["p_toxic"] >= 0.5) == t for i, _, t in rest) >= 0.95 * len(rest)
    assert all(got[i]["keep"] == (got[i]["p_quality"] >= 0.5 and got[i]["p_toxic"] < 0.5) for i in got)


def test_awkward_rows(spark):
    docs, labels = corpus(random.Random(5), 100)
    df = awkward(spark, [(i + 100, t) for i, t in docs])
    known = spark.createDataFrame([(i + 100, q, t) for i, q, t in labels] + [(None, 1, 0), (100, None, 0), (101, 1, 1), (101, 0, 1), (5, 1, None), (9999, 1, 0)], LABELS).withColumns({c: F.lit("x") for c in ("text", "h", "a", "b", "keep", "label_id", "_q")})
    got = C.score(df, known).collect()
    assert len(got) == df.where("doc_id is not null").count()
    assert all(0 <= x["p_quality"] <= 1 and 0 <= x["p_toxic"] <= 1 for x in got)
    assert C.score(df.limit(0), known).count() == 0
    none = C.score(df, known.limit(0)).collect()
    assert len(none) == len(got) and all(x["keep"] and x["p_quality"] is None for x in none)
    one = C.score(df, known.where("doc_id = 102")).collect()
    assert len(one) == len(got)


def test_ratio_against_plain_arithmetic(spark):
    cases = [(10, 9), (10, 5), (40, 1), (7, 7), (50, 50), (100, 50)]
    rows, positive = 100, 50
    got = {(x["n"], x["k"]): x["r"] for x in spark.createDataFrame([(float(a), float(b)) for a, b in cases], "n double, k double").withColumn("r", C._ratio(F.col("n"), F.col("k"), rows, positive)).collect()}
    for n, k in cases:
        p, q, rest = positive / rows, k / n, (positive - k) / max(rows - n, 1)
        want = 0.0
        if q > rest:
            want = 2 * ((k * math.log(q / p) if k else 0) + ((n - k) * math.log((1 - q) / (1 - p)) if n > k else 0))
        assert abs(got[n, k] - want) < 1e-9


def test_every_tied_word_is_in_the_lexicon(spark):
    r = random.Random(3)
    bad = [f"bad{i}" for i in range(30)]
    rows = [(i, " ".join([*text(r, 30).split(), *(r.sample(bad, 12) if i % 2 else [])])) for i in range(300)]
    labels = spark.createDataFrame([(i, (i + 1) % 2, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = C.fit(frame(spark, rows), labels)
    found = model.lexicon[0](np.array([K.hash64(w) for w in bad], np.uint64))
    assert (found >= 0).all() and (model.lexicon[1][found] > C.TIED).all()
