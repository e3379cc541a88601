import math
import random
from collections import Counter

import numpy as np

from tessera.llm import class_lm as M
from tessera.llm import kernel as K

from .helpers import awkward, frame, text


def likelihood(n, cls):
    k = cls.max() + 1
    big = np.zeros((k, k))
    for i in range(len(n)):
        for j in range(len(n)):
            big[cls[i], cls[j]] += n[i, j]
    f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
    return f(big) - f(big.sum(0)) - f(big.sum(1))


def test_every_move_is_the_best_one():
    rng = np.random.default_rng(3)
    n = rng.poisson(0.8, (12, 12))
    cls = M.exchange(n, 4, sweeps=50)
    best = likelihood(n, cls)
    assert best > likelihood(n, np.arange(12) % 4)
    for w in range(12):
        for c in range(4):
            other = cls.copy()
            other[w] = c
            assert likelihood(n, other) <= best + 1e-6


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(1)
    n = np.zeros((20, 20))
    for i in range(20):
        for j in range(20):
            n[i, j] = rng.poisson(20 if (i // 10) != (j // 10) else 0.2)
    cls = M.exchange(n, 2)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:])) == 1 and cls[0] != cls[10]


def test_transitions_are_distributions():
    rng = np.random.default_rng(2)
    n = rng.poisson(1.0, (6, 6)).astype(float)
    n[2] = 0
    assert np.allclose(np.exp(M.smoothed(n)).sum(1), 1)


def test_scores_against_brute_force(spark):
    r = random.Random(5)
    texts = [text(r, r.choice([1, 5, 40, 200])) for _ in range(120)]
    df = frame(spark, [*enumerate(texts), (500, None), (501, "..."), (None, texts[0])])
    model, lookup = M.fit(df)
    rows = {x["doc_id"]: x for x in M.perplexity(df).collect()}
    assert len(rows) == 122
    words = [t.lower().replace(".", "").split() for t in [*texts, texts[0]]]
    count = Counter(w for own in words for w in own)
    vocab = {w for w in count if count[w] >= M.MIN_COUNT}
    rare = sum(count[w] < M.MIN_COUNT for w in count)
    cls = {w: int(model.cls[lookup.value(np.array([K.hash64(w)], np.uint64))[0]]) for w in vocab}
    c_of = lambda w: cls.get(w, M.CLASSES)
    mass = Counter()
    for w in vocab:
        mass[cls[w]] += count[w]
    n = np.zeros((M.CLASSES + 2, M.CLASSES + 2))
    for own in words:
        before = M.CLASSES + 1
        for w in own:
            n[before, c_of(w)] += 1
            before = c_of(w)
    base = n.sum(0) / n.sum()

    def transition(a, b):
        kinds = (n[a] > 0).sum()
        return (max(n[a, b] - M.DISCOUNT, 0) + M.DISCOUNT * kinds * base[b]) / n[a].sum()

    for i, own in enumerate(words[:-1]):
        lp, before = 0.0, M.CLASSES + 1
        for w in own:
            lp += math.log(transition(before, c_of(w))) + math.log(count[w] / mass[cls[w]] if w in vocab else 1 / rare)
            before = c_of(w)
        assert abs(rows[i]["log_prob"] - lp) < 1e-3
        assert rows[i]["n_tokens"] == len(own) and rows[i]["n_unknown"] == sum(w not in vocab for w in own)
        assert abs(rows[i]["perplexity"] / math.exp(-lp / len(own)) - 1) < 1e-4
    assert rows[500]["perplexity"] is None and rows[501]["n_tokens"] == 0


def test_words_beyond_the_head_join_by_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(M, "HEAD", 6)
    r = random.Random(3)
    left, right = ["aa", "bb", "cc"], ["xx", "yy", "zz"]
    rows = []
    for i in range(400):
        own = []
        for _ in range(10):
            own += [r.choice(left), r.choice(right)]
        own[r.randrange(0, 20, 2)] = "lefty"
        own[r.randrange(1, 20, 2)] = "righty"
        rows.append((i, " ".join(own)))
    model, lookup = M.fit(frame(spark, rows))
    c = lambda w: model.cls[lookup.value(np.array([K.hash64(w)], np.uint64))[0]]
    assert len(model.cls) == 8
    table = model.transition
    # A word of the tail must be as likely after and before the other side as the class that it joined.
    assert np.isfinite(table).all() and c("lefty") != c("righty")


def test_sweeps_over_all_words(spark, monkeypatch):
    monkeypatch.setattr(M, "CLASSES", 4)
    rng = np.random.default_rng(4)
    kind = rng.integers(0, 4, 60)
    n = rng.poisson(np.where((kind[:, None] + 1) % 4 == kind[None, :], 9.0, 0.3))
    pairs = spark.createDataFrame([(int(a), int(b), int(n[a, b])) for a, b in np.argwhere(n)], "a int, b int, n long")
    start = np.concatenate([M.exchange(n[:12, :12], 4), np.full(48, -1)])
    around = {(x["word"], x["context"]): x["n"] for x in M.contexts(pairs, start.astype(np.int16)).collect()}
    for w in range(60):
        for c in range(4):
            assert around.get((w, c), 0) == n[:, w][start == c].sum() and around.get((w, 4 + c), 0) == n[w][start == c].sum()
    assert {k: v for (w, k), v in around.items() if w == -1} == {a * 4 + b: n[np.ix_(start == a, start == b)].sum() for a in range(4) for b in range(4) if n[np.ix_(start == a, start == b)].sum()}
    found = M.settled(pairs, start)
    first = found.copy()
    first[12:] = 0
    assert likelihood(n, found) > likelihood(n, first)
    pure = sum(np.bincount(kind[found == c]).max() for c in range(4) if (found == c).any())
    assert pure >= 57


def test_unlikely_order_costs_more(spark):
    r = random.Random(6)
    rows = [(i, " ".join(w for _ in range(30) for w in (r.choice(["the", "a"]), r.choice(["cat", "dog"]), r.choice(["runs", "sits"])))) for i in range(200)]
    rows += [(1000, "runs the the sits dog a " * 10)]
    p = {x["doc_id"]: x["perplexity"] for x in M.perplexity(frame(spark, rows)).collect()}
    assert p[1000] > 2 * max(p[i] for i in range(200))


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = {x["doc_id"]: x for x in M.perplexity(df).collect()}
    assert set(rows) == set(range(1, 13))
    assert rows[1]["n_tokens"] == 0 and rows[8]["n_tokens"] == 30_000 and rows[8]["log_prob"] == rows[9]["log_prob"]
    assert M.perplexity(df.limit(0)).count() == 0
    assert M.perplexity(df.where("doc_id = 2")).first()["perplexity"] is None


def test_bigrams_leave_tasks_packed(spark):
    """One row a part, however many pairs of words there are; their counts, and what the sweeps make of them, are exact."""
    r = random.Random(8)
    texts = [text(r, 60) for _ in range(80)]
    df = frame(spark, enumerate(texts)).repartition(3)
    h, n, _, lookup = M.vocabulary(df)
    near = M.bigrams(df.select("text"), lookup, 5).persist()
    assert sorted(x["part"] for x in near.collect()) == [0, 1, 2, 3, 4]
    ids = {int(x): i for i, x in enumerate(h)}
    count = Counter()
    for t in texts:
        own = [ids.get(K.hash64(w), -1) for w in t.lower().replace(".", "").split()]
        count.update((a, b) for a, b in zip(own, own[1:]) if a >= 0 and b >= 0)
    dense = np.zeros((len(h), len(h)))
    for (a, b), k in count.items():
        dense[a, b] = k
    head = len(h) // 2
    assert (M.head_pairs(near, 5, head) == dense[:head, :head]).all() and (M.head_pairs(near, 5, len(h)) == dense).all()
    cls = np.arange(len(h)).astype(np.int16) % M.CLASSES
    onehot = np.eye(M.CLASSES)[cls]
    assert (M.class_pairs(near, 5, spark.sparkContext.broadcast(cls)) == onehot.T @ dense @ onehot).all()


def test_parts_and_repeated_pairs_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(M, "MERGED", 40)
    rng = np.random.default_rng(7)
    rows = [(int(a), int(b), int(n)) for a, b, n in zip(rng.integers(0, 50, 900), rng.integers(0, 50, 900), rng.integers(1, 9, 900))]
    once = Counter()
    for a, b, n in rows:
        once[a, b] += n
    many = spark.createDataFrame(rows, "a int, b int, n long").repartition(3)
    few = spark.createDataFrame([(*k, n) for k, n in once.items()], "a int, b int, n long")
    assert sum(x["n_after"] for x in M.packed(many, 1).collect()) < len(rows)  # added up
    cls = np.where(np.arange(60) < 20, np.arange(60) % 4, -1).astype(np.int16)  # words 50 to 59 have no neighbours
    assert sorted(map(tuple, M.contexts(many, cls, 7).collect())) == sorted(map(tuple, M.contexts(few, cls).collect()))
    assert (M.settled(many, cls, 7) == M.settled(few, cls)).all()


def test_parts_grow_with_the_text():
    assert [M.parts_of(x) for x in (0, 1, 80 << 20, 1 << 30, 1 << 32, 1 << 36)] == [1, 1, 80, 1024, 1024, 8192]


def test_word_counts_of_documents_need_no_classes(spark, tmp_path, monkeypatch):
    from tessera.llm import registry

    df = awkward(spark).drop("n")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    whole = sorted(map(tuple, M.perplexity(df).select("doc_id", "n_tokens", "n_unknown").collect()))
    monkeypatch.setattr(M, "exchange", None)
    got = registry.QUERIES["lm_tokens"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "n_unknown"] and sorted(map(tuple, got.collect())) == whole
