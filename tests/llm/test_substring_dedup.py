import random

import numpy as np

from tessera.llm import kernel as K
from tessera.llm import substring_dedup as S

from .helpers import awkward, edit, frame, text

N = S.MIN_WORDS


def test_sliding_minimum():
    rng = np.random.default_rng(1)
    for n in (1, 5, 40, 200):
        v = rng.integers(0, 50, n).astype(np.uint64)
        for k in (1, 3, 41):
            assert S.sliding_min(v, k).tolist() == [v[i : i + k].min() for i in range(n - k + 1)]


def test_every_long_run_holds_an_anchor_that_depends_on_it_alone():
    r = random.Random(1)
    run = text(r, N)
    a, b = K.Words([f"{text(r, 30)} {run} {text(r, 30)}"]), K.Words([f"{text(r, 77)} {run}"])
    (x, g), (_, h) = S.anchors(a), S.anchors(b)
    assert set(g.tolist()) & set(h.tolist())
    assert np.diff(x).max() <= S.WINDOW and not len(S.anchors(K.Words([text(r, N - 1)]))[0])
    assert len(S.anchors(K.Words([run]))[0]) == 1


def test_automaton_against_search():
    r = random.Random(2)
    small = S.MIN_WORDS
    S.MIN_WORDS = 4
    try:
        for _ in range(150):
            docs = [[r.randrange(3) for _ in range(r.randint(1, 25))] for _ in range(3)]
            tree = S.Automaton()
            for i, d in enumerate(docs[:2]):
                tree.add(d, i)
            for own in (1, 5):
                marked = set()
                q = docs[own] if own < 3 else docs[2]
                for s, e in tree.matches(q, own):
                    marked |= set(range(s, e))
                grams = {tuple(d[i : i + 4]) for j, d in enumerate(docs[:2]) if j < own for i in range(len(d) - 3)}
                due = {p for i in range(len(q) - 3) if tuple(q[i : i + 4]) in grams for p in range(i, i + 4)}
                assert marked == due
    finally:
        S.MIN_WORDS = small


def brute(docs):
    """Words of each document that lie in a run of N words which a document with a smaller id has."""
    words = {i: t.lower().replace(".", "").split() for i, t in docs}
    first, due = {}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - N + 1):
            g = tuple(words[i][p : p + N])
            if first.setdefault(g, i) < i:
                due.setdefault(i, set()).update(range(p, p + N))
    return words, due


def marks(docs, rows):
    out = {}
    for x in rows:
        t = dict(docs)[x["doc_id"]]
        w = K.Words([t])
        for s in x["spans"]:
            out.setdefault(x["doc_id"], set()).update(np.flatnonzero((w.s >= s["start"]) & (w.e <= s["end"])).tolist())
    return out


def corpus(r):
    passages = [text(r, r.choice([49, 50, 55, 80, 200])) for _ in range(12)]
    docs = []
    for i in range(120):
        t = text(r, r.choice([5, 60, 300]))
        for _ in range(r.choice([0, 1, 2])):
            t += " " + r.choice(passages) + " " + text(r, r.choice([1, 40]))
        docs.append((i, t))
    docs += [(200 + i, docs[i][1]) for i in range(10)]
    docs += [(300 + i, edit(r, docs[i][1], 0.02)) for i in range(20)]
    return docs


def test_spans_against_brute_force(spark):
    docs = corpus(random.Random(3))
    rows = S.shared_passages(frame(spark, docs)).collect()
    _, due = brute(docs)
    got = marks(docs, rows)
    n_due = sum(map(len, due.values()))
    assert n_due > 3000
    for i, m in got.items():
        assert m <= due.get(i, set())
    assert sum(len(m) for m in got.values()) >= 0.95 * n_due
    for x in rows:
        t = dict(docs)[x["doc_id"]]
        assert x["removed_chars"] == len(t) - len(x["text"]) == sum(s["end"] - s["start"] for s in x["spans"])


def test_many_shards_and_copies_give_the_same_rows(spark, monkeypatch):
    docs = corpus(random.Random(4))
    whole = sorted((x["doc_id"], x["text"]) for x in S.shared_passages(frame(spark, docs)).collect())
    monkeypatch.setattr(S, "SHARD_ANCHORS", 20)
    monkeypatch.setattr(S, "COPY_CHARS", 4000)
    assert sorted((x["doc_id"], x["text"]) for x in S.shared_passages(frame(spark, docs)).collect()) == whole


def test_a_passage_in_thousands_of_documents_is_kept_once(spark):
    r = random.Random(6)
    p = text(r, 70)
    docs = [(i, f"{text(r, 10)} {p} {text(r, 10)}") for i in range(2000)]
    rows = S.shared_passages(frame(spark, docs)).collect()
    assert len(rows) == 1999 and min(x["doc_id"] for x in rows) == 1
    assert not any(p[20:-20] in x["text"] for x in rows)


def test_a_stock_phrase_inside_a_passage_of_later_documents(spark):
    r = random.Random(8)
    docs = []
    for i in range(30):
        line, around = text(r, 20), [text(r, 18), text(r, 17)]
        passage = f"{around[0]} {line} {around[1]}"
        docs += [(i, f"{text(r, 60)} {line} {text(r, 60)}"), *((100 * k + i, f"{text(r, 60)} {passage} {text(r, 60)}") for k in (1, 2))]
    due = brute(docs)[1]
    assert set(due) == set(range(200, 230))
    assert marks(docs, S.shared_passages(frame(spark, docs)).collect()) == due


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = S.shared_passages(df).collect()
    assert [x["doc_id"] for x in rows] == [9] and not K.Words([rows[0]["text"]]).h.size
    assert S.shared_passages(df.limit(0)).count() == 0
    same = frame(spark, [(1, "a b " * 100), (1, "a b " * 100)])
    assert S.shared_passages(same).count() == 0


def test_cut():
    assert S.cut("0123456789", [(6, 8), (1, 3), (2, 4)]) == ("04589", [(1, 4), (6, 8)])
