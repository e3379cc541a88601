import random

import numpy as np

from tessera.llm import kernel as K
from tessera.llm import lz_fingerprint as Z

from .helpers import awkward, edit, frame, text


def parse(words):
    seen, w = set(), ()
    for x in words:
        w += (x,)
        if w not in seen:
            seen.add(w)
            w = ()
    return seen


def ids(t):
    return K.Words([t]).h.tolist()


def test_phrases_are_those_of_the_plain_parse():
    r = random.Random(1)
    for n in (0, 1, 2, 50, 400):
        t = text(r, n)
        assert len(Z.phrases(ids(t))) == len(parse(t.lower().replace(".", "").split()))
    assert len(Z.phrases([1, 1, 1, 1, 1, 1])) == 3  # 1, 11, 111


def test_signatures_estimate_the_similarity_of_phrase_sets():
    r = random.Random(2)
    for rate in (0, 0.02, 0.05, 0.2, 1):
        a = text(r, 600)
        b = edit(r, a, rate)
        p, q = parse(ids(a)), parse(ids(b))
        _, s = Z.signatures([a, b])
        assert abs(Z.similarity((s[0] == s[1]).mean()) - len(p & q) / len(p | q)) < 0.16


def test_short_texts_fill_their_bins():
    n, s = Z.signatures(["one two", "two one", "", "one two three"])
    assert n.tolist() == [2, 2, 0, 3]
    assert (s[0] == s[1]).all() and not s[2].any()
    assert 0.4 < Z.similarity((s[0] == s[3]).mean()) < 0.9


def test_links_against_brute_force(spark):
    r = random.Random(5)
    docs = []
    for _ in range(60):
        base = text(r, r.choice([40, 150, 500]))
        docs += [edit(r, base, x) for x in [0, *r.choices([0, 0.01, 0.03], k=r.choice([0, 1, 3]))]]
    r.shuffle(docs)
    _, sig = Z.signatures(docs)
    alike = Z.similarity((sig[:, None, :] == sig[None]).mean(2))
    rows = {x["doc_id"]: x for x in Z.lz_fingerprints(frame(spark, list(enumerate(docs)))).collect()}
    assert sorted(rows) == list(range(len(docs)))
    due = [i for i in range(len(docs)) if (alike[i, :i] >= Z.THRESHOLD).any()]
    linked = [i for i in rows if rows[i]["similar_to"] is not None]
    assert due and len(set(due) & set(linked)) >= 0.9 * len(due)
    for i in linked:
        j = rows[i]["similar_to"]
        assert j < i and abs(alike[i, j] - rows[i]["similarity"]) < 1e-5 and alike[i, j] >= Z.THRESHOLD
    same = {}
    for i, t in enumerate(docs):
        same.setdefault(t, []).append(i)
    for own in same.values():
        assert len({rows[i]["fingerprint"] for i in own}) == 1
        assert all(rows[i]["similar_to"] is not None for i in own[1:])


def test_copies_of_a_base_that_is_not_the_least_id(spark):
    r = random.Random(6)
    base = text(r, 500)
    docs = [base if i == 100 else edit(r, base, 0.07) for i in range(200)]
    _, sig = Z.signatures(docs)
    alike = Z.similarity((sig[:, None, :] == sig[None]).mean(2))
    due = {i for i in range(200) if (alike[i, :i] >= Z.THRESHOLD).any()}
    linked = {x["doc_id"] for x in Z.lz_fingerprints(frame(spark, list(enumerate(docs)))).collect() if x["similar_to"] is not None}
    assert len(due) > 50 and linked <= due and len(linked) >= 0.9 * len(due)


def test_a_document_that_only_a_linked_one_is_similar_to(spark, monkeypatch):
    rng = np.random.default_rng(1)
    sig = np.tile(rng.integers(2, 255, Z.BINS).astype(np.uint8), (4, 1))
    sig[1, :24] = sig[2, :48] = 1
    sig[3, 60:] = 0
    prints = spark.createDataFrame([(i + 1, 9, bytearray(x.tobytes())) for i, x in enumerate(sig)], "doc_id long, n_phrases int, signature binary")
    for block in (Z.BLOCK, 1):
        monkeypatch.setattr(Z, "BLOCK", block)
        assert {x["doc_id"]: x["similar_to"] for x in Z.similar(prints).collect()} == {2: 1, 3: 2}


def test_links_at_the_threshold_wherever_the_signatures_differ(spark):
    rng = np.random.default_rng(2)
    assert Z.similarity(np.array(Z.NEED / Z.BINS)) >= Z.THRESHOLD > Z.similarity(np.array((Z.NEED - 1) / Z.BINS))
    rows, most = [], Z.BINS - Z.NEED
    spread = np.arange(most) * Z.BINS // most  # in any six neighbouring bins there is one
    for i in range(60):
        a = rng.integers(0, 256, Z.BINS).astype(np.uint8)
        b, c = a.copy(), a.copy()
        b[spread if i < 20 else rng.permutation(Z.BINS)[:most]] += 1
        c[rng.permutation(Z.BINS)[: most + 1]] += 2
        rows += [(3 * i, a), (3 * i + 1, b), (3 * i + 2, c)]
    prints = spark.createDataFrame([(i, 9, bytearray(x.tobytes())) for i, x in rows], "doc_id long, n_phrases int, signature binary")
    assert {x["doc_id"]: x["similar_to"] for x in Z.similar(prints).collect()} == {3 * i + 1: 3 * i for i in range(60)}


def test_classes_and_numbers_of_links_against_brute_force(spark, monkeypatch):
    r = random.Random(9)
    docs = [text(r, 150) for _ in range(20)]
    for n, rate in ((60, 0.07), (12, 0.05), (5, 0.03)):
        base = text(r, 400)
        docs += [base, base] + [edit(r, base, rate) for _ in range(n)]
    docs += docs[:3]
    r.shuffle(docs)
    _, sig = Z.signatures(docs)
    alike = Z.similarity((sig[:, None, :] == sig[None]).mean(2))
    near = (alike >= Z.THRESHOLD) & ~np.eye(len(docs), dtype=bool)
    group = np.arange(len(docs))
    for _ in docs:
        group = np.minimum(group, np.where(near, group[None], len(docs)).min(1))
    due = {}
    for i in range(len(docs)):
        below = np.flatnonzero(near[i, :i])
        due[i] = (int(below[0]) if len(below) else None, round(float(alike[i, below[0]]), 6) if len(below) else None, int(group[i]), int(near[i].sum()))
    for small, block in ((64, 4096), (2, 7)):
        monkeypatch.setattr(Z, "SMALL", small)
        monkeypatch.setattr(Z, "BLOCK", block)
        rows = Z.lz_fingerprints(frame(spark, list(enumerate(docs)))).collect()
        assert {x["doc_id"]: (x["similar_to"], x["similarity"], x["class_id"], x["n_links"]) for x in rows} == due
    assert max(n for *_, n in due.values()) > 20


def test_a_tile_is_compared_alike_in_runs_of_any_length(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, Z.BINS).astype(np.uint8)
    sig = np.where(rng.random((40, Z.BINS)) < 0.16, rng.integers(0, 256, (40, Z.BINS)), base).astype(np.uint8)
    sig[:, Z.KEYS[0]] = base[Z.KEYS[0]]
    n = np.arange(40)
    key = Z.bucket_keys(sig)[:, 0]
    assert len(set(key.tolist())) == 1
    alike = Z.similarity((sig[:, None, :] == sig[None]).mean(2)) >= Z.THRESHOLD
    for two in (False, True):
        block = n // 20 if two else n * 0
        near = alike & ((block[:, None] != block[None]) if two else ~np.eye(40, dtype=bool))
        rows = {"key": key, "low": n * 0, "high": n * 0 + two, "block": block, "tid": n, "first": n, "copies": n % 3 + 1}
        due = {i: (int((near[i] * rows["copies"]).sum()), int(np.flatnonzero(near[i])[0])) for i in n.tolist() if near[i].any()}
        assert 20 < len(due) and not near.all()
        for pairs in (1, 7, 1 << 16):
            monkeypatch.setattr(Z, "PAIRS", pairs)
            assert {x["tid"]: (x["links"], x["least"]) for x in Z.links_in_tiles(rows, sig).to_pylist()} == due


def test_links_and_classes_of_texts_that_share_an_id(spark):
    r = random.Random(10)
    a, b = text(r, 300), text(r, 300)
    rows = [(3, a), (3, a), (3, b), (4, edit(r, a, 0.01)), (6, b), (8, None), (9, "")]
    got = [(x["doc_id"], x["class_id"], x["n_links"]) for x in Z.lz_fingerprints(frame(spark, rows)).collect()]
    assert sorted(got) == [(3, 3, 1), (3, 3, 1), (3, 3, 1), (4, 3, 1), (6, 3, 1), (8, 8, 0), (9, 9, 0)]


def test_texts_that_share_an_id(spark):
    r = random.Random(8)
    a, b = text(r, 300), text(r, 300)
    rows = [(1, a), (1, b), (2, edit(r, a, 0.01)), (5, edit(r, b, 0.01)), (7, b), (9, text(r, 300))]
    got = {(x["doc_id"], x["similar_to"]) for x in Z.lz_fingerprints(frame(spark, rows)).collect()}
    assert got == {(1, None), (2, 1), (5, 1), (7, 1), (9, None)}


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = Z.lz_fingerprints(df).collect()
    assert len(rows) == df.where("doc_id is not null").count()
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["n_phrases"] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 0, 1]
    assert by[1]["similar_to"] is None and by[6]["similar_to"] == 5 and by[9]["similar_to"] == 8
    assert by[1]["fingerprint"] == by[2]["fingerprint"]
    assert Z.lz_fingerprints(df.limit(0)).count() == 0


def test_hash_of_numbers_is_the_same_in_every_process():
    import subprocess
    import sys

    code = "print(hash((12345678901234567890, hash((0, 77)))))"
    out = {subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout for _ in range(3)}
    assert out == {f"{hash((12345678901234567890, hash((0, 77))))}\n"}
    assert np.iinfo(np.int64).min <= hash((1, 2)) <= np.iinfo(np.int64).max
