import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import near_dedup as D
from tessera.llm import shared

from .helpers import awkward, edit, frame, text


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


@settings(deadline=None, max_examples=400)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 16))
def test_banded_alignment_is_the_edit_distance_within_the_band(a, b, most):
    d = distance(a, b)
    assert D.banded_distance(a, b, most) == (d if d <= most else most + 1)


def test_similarity_is_that_of_the_distance():
    r = random.Random(3)
    for n in (3, 200, 700):
        for rate in (0, 0.02, 0.1, 0.14, 0.2):
            a = [r.randrange(50) for _ in range(n)]
            b = [x if r.random() > rate else r.randrange(50) for x in a if r.random() > rate / 4]
            s = 1 - distance(a, b) / max(len(a), len(b))
            assert abs(D.similarity(a, b) - (s if s >= D.THRESHOLD - 1e-9 else 0)) < 1e-9


def test_filter_of_ids_loses_none(spark, monkeypatch):
    docs = awkward(spark, [(i, f"text {i}") for i in range(100, 400)])
    ids = spark.range(150, 250).select("id")
    for words in (shared.FILTER_WORDS, 1):
        monkeypatch.setattr(shared, "FILTER_WORDS", words)
        assert sorted(x["doc_id"] for x in shared.joined(shared.documents(docs), ids).collect()) == list(range(150, 250))
        kept = shared.without(docs, ids)
        assert kept.columns == docs.columns and kept.count() == docs.count() - 100 and kept.where("doc_id is null").count() == 2


def test_long_alignment():
    r = random.Random(1)
    a = [r.randrange(1000) for _ in range(3000)]
    b = [x for x in a if r.random() > 0.03]
    assert D.banded_distance(a, b, 300) == len(a) - len(b)


def test_occurrences_are_labelled_per_document():
    g = np.array([5, 5, 5, 5], np.uint64)
    out = D.occurrence_labelled(g, np.array([0, 0, 1, 1]))
    assert out[0] == out[2] and out[1] == out[3] and out[0] != out[1]


def test_sketches_are_sensitive_to_order():
    r = random.Random(2)
    t = [text(r, 8) for _ in range(30)]
    shuffled = t[:]
    r.shuffle(shuffled)
    near = edit(r, " ".join(t), 0.04)
    _, s, whole = D.sketches([" ".join(t), " ".join(shuffled), near, " ".join(t)])
    assert (s[0] == s[3]).all() and (whole[0] == whole[3]).all() and (whole[:3, 0] != whole[[1, 2, 0], 0]).all()
    assert (s[0] == s[2]).sum() > (s[0] == s[1]).sum()


def test_groups_against_brute_force(spark):
    r = random.Random(7)
    docs, n = [], 0
    for _ in range(40):
        base = text(r, r.choice([20, 60, 200, 400]))
        for rate in [0, *r.choices([0, 0.02, 0.05, 0.08], k=r.choice([0, 0, 1, 3]))]:
            docs.append((n, edit(r, base, rate)))
            n += 1
    r.shuffle(docs)
    seq = {i: t.lower().replace(".", "").split() for i, t in docs}
    true = [(a, b) for a in seq for b in seq if a < b and 1 - distance(seq[a], seq[b]) / max(len(seq[a]), len(seq[b])) >= D.THRESHOLD]
    found = {r["doc_id"]: (r["duplicate_of"], r["similarity"]) for r in D.near_duplicates(frame(spark, docs)).collect()}
    root = lambda i: found.get(i, (i,))[0]
    assert true
    assert sum(root(a) == root(b) for a, b in true) >= 0.9 * len(true)
    parent = {i: i for i in seq}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in true:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    for i, (lead, s) in found.items():
        assert top(i) == top(lead) and lead < i and s >= D.THRESHOLD and lead not in found


def test_thousands_of_copies_are_one_group(spark):
    r = random.Random(9)
    base = text(r, 60)
    found = D.near_duplicates(frame(spark, [(i, base) for i in range(3000)])).collect()
    assert len(found) == 2999 and {x["duplicate_of"] for x in found} == {0}


def test_a_lead_with_many_candidates_is_shared_out(spark, monkeypatch):
    r = random.Random(10)
    base = text(r, 120)
    docs = [(i, edit(r, base, 0.02)) for i in range(60)]
    whole = {(x["doc_id"], x["duplicate_of"]) for x in D.near_duplicates(frame(spark, docs)).collect()}
    monkeypatch.setattr(D, "LEAD_SHARE", 4)
    monkeypatch.setattr(shared, "FILTER_WORDS", 1)  # the filter lets everything through
    assert {(x["doc_id"], x["duplicate_of"]) for x in D.near_duplicates(frame(spark, docs)).collect()} == whole
    assert len(whole) >= 57


def test_copies_of_a_base_that_is_not_the_least_id(spark, monkeypatch):
    r = random.Random(12)
    base = text(r, 300)
    docs = [(i, base if i == 100 else edit(r, base, 0.1)) for i in range(200)]
    keys = D.sketches([t for _, t in docs])[1]
    due = {i for i, t in docs if i != 100 and (keys[i] == keys[100]).any() and D.similarity(*([hash(w) for w in x.lower().replace(".", "").split()] for x in (t, base)))}
    for block in (D.BLOCK, 30):
        monkeypatch.setattr(D, "BLOCK", block)
        found = {x["doc_id"]: x["duplicate_of"] for x in D.near_duplicates(frame(spark, docs)).collect()}
        root = found[100]
        assert len(due) > 150 and all(found.get(i, i) == root for i in due)


def test_rows_that_share_an_id_are_one_document(spark):
    r = random.Random(11)
    x, y = text(r, 80), text(r, 80)
    found = {(d["doc_id"], d["duplicate_of"]) for d in D.near_duplicates(frame(spark, [(7, x), (7, y), (3, x), (9, edit(r, y, 0.02)), (8, y)])).collect()}
    assert found == {(7, 3), (8, 3), (9, 3)}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100)], "doc_id long, lead long")
    got = {r["doc_id"]: r["group"] for r in D.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_awkward_rows(spark):
    df = awkward(spark)
    got = {(r["doc_id"], r["duplicate_of"]) for r in D.near_duplicates(df).collect()}
    assert got == {(6, 5), (9, 8)}
    kept = D.stage(spark, df, "")
    assert kept.columns == df.columns
    assert kept.count() == df.count() - 2
    assert D.near_duplicates(df.limit(0)).count() == 0
