import itertools
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import pii as P

from .helpers import awkward, frame, text


@pytest.fixture(scope="module")
def params():
    return P.train()


def test_gradients_are_those_of_the_loss():
    p, r = P.initial(3), random.Random(5)
    x, y = P.training_batch(r, 3, P.corpus(r, 2000), 20)
    _, g = P.gradients(p, x, y)
    for k, v in p.items():
        at = tuple(np.argwhere(np.abs(g[k]) >= np.abs(g[k]).max())[0])
        old, e, loss = v[at], 1e-5, []
        for d in (e, -e):
            v[at] = old + d
            loss.append(P.gradients(p, x, y)[0])
        v[at] = old
        assert abs((loss[0] - loss[1]) / (2 * e) - g[k][at]) < 1e-6


def test_likelihood_and_viterbi_against_all_paths(monkeypatch):
    monkeypatch.setattr(P, "KINDS", P.KINDS[:2])
    monkeypatch.setattr(P, "LABELS", 5)
    monkeypatch.setattr(P, "LOCAL", 0)
    rng = np.random.default_rng(1)
    p = P.initial(1)
    x, y = np.array([[5, 60, 7, 9]]), np.array([[0, 1, 2, 0]])
    em = P.Steps(p, x[0], np.array([0]), np.array([4])).emissions(p, 0, 4)[:, :, 0]
    trans = p["t"] + P.allowed()
    score = lambda path: sum(em[i, c] for i, c in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
    everything = [score(c) for c in itertools.product(range(5), repeat=4)]
    assert abs(P.gradients(p, x, y)[0] * 4 - (np.logaddexp.reduce(everything) - score(y[0]))) < 1e-6
    e = rng.normal(0, 2, (4, 4, 5))
    size = np.array([4, 2, 1, 4])
    got = P._viterbi(e, trans, size)
    for i in range(4):
        n = int(size[i])
        best = max(itertools.product(range(5), repeat=n), key=lambda c: sum(e[i, k, v] for k, v in enumerate(c)) + sum(trans[a, b] for a, b in itertools.pairwise(c)))
        assert tuple(got[i, :n]) == best == tuple(P._viterbi_one(e[i, :n], trans))


def test_steps_against_a_plain_loop():
    p = P.initial(2)
    codes = np.random.default_rng(3).integers(0, P.N_CODES, 60)
    start, size = np.array([3, 20, 41]), np.array([14, 14, 5])
    net, h = P.Steps(p, codes, start, size), P.HIDDEN
    got = net.emissions(p, 0, 14)
    w = P.sloped(p["w"])
    for n in range(3):
        own, want = codes[start[n] : start[n] + size[n]], np.tile(p["o"], size[n])
        for d in range(2):
            s, c = np.zeros(h), np.zeros(h)
            for t in range(size[n]):
                at = t if d == 0 else size[n] - 1 - t
                a = w[d] @ np.concatenate([s, p["emb"][:, own[at]], [1]])
                i, f, o, u = np.clip(a[:h], 0, 1), np.clip(a[h : 2 * h], 0, 1), np.clip(a[2 * h : 3 * h], 0, 1), a[3 * h :] / (1 + np.abs(a[3 * h :]))
                c = f * c + i * u
                s = o * c / (1 + np.abs(c))
                want[:, at] += p["e"][d] @ s
        assert np.allclose(got[: size[n], :, n].T, want)


def test_windows_speak_for_every_character_once():
    sizes = [0, 1, 5, P.WINDOW - 1, P.WINDOW, P.WINDOW + 1, 3 * P.WINDOW, 7000, 0, 129_000]
    at = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
    w = P.Windows(at)
    seen = np.zeros(at[-1], int)
    for s, n, lo, hi in zip(w.start, w.size, w.lo, w.hi, strict=True):
        assert 0 <= lo < hi <= n <= P.WINDOW
        d = np.searchsorted(at, s, "right") - 1
        assert s + n < at[d + 1]
        # Text that goes on beyond a window is seen for half of the overlap at least.
        assert (lo == 0) == (s == at[d]) and (lo == 0 or lo >= P.OVERLAP // 2) and (s + hi == at[d + 1] - 1 or n - hi >= P.OVERLAP // 2)
        seen[s + lo : s + hi] += 1
    ends = np.zeros(at[-1], bool)
    ends[at[1:] - 1] = True
    assert (seen[~ends] == 1).all() and (seen[ends] == 0).all()
    assert seen.sum() == sum(sizes)


def test_decoding_is_viterbi_over_all_emissions_of_the_document(params):
    r = random.Random(8)
    texts = [P.labelled(r, n)[0] for n in (0, 3, 90, 700, 1500, 4000)] + ["", "7", "@", "ann.lee@example.com", "1 " * 900, text(r, 900), "plain", "a" * 9000, "plain", "7" * 3000, "e"]
    d = P.Decoder(params)
    got = P.find(texts, d)
    for t, spans in zip(texts, got, strict=True):
        if not t:
            assert not spans
            continue
        cp, at = P.K.codes([t])
        codes, w = P._code_table()[cp].astype(np.int64), P.Windows(at)
        em = np.full((len(t), P.LABELS), np.nan)
        for s, n, lo, hi in zip(w.start, w.size, w.lo, w.hi, strict=True):
            own = P.Steps(params, codes, np.array([s]), np.array([n])).emissions(params, 0, int(n))[:, :, 0]
            em[s + lo : s + hi] = own[lo:hi]
        em[0] += np.where((np.arange(P.LABELS) % 2 == 0) & (np.arange(P.LABELS) > 0), -1e4, 0)
        score, trans = em[0], params["t"] + P.allowed()
        back = []
        for k in range(1, len(t)):
            s = score[:, None] + trans
            back.append(s.argmax(0))
            score = s.max(0) + em[k]
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path, want, i = path[::-1], [], 0
        while i < len(t):
            if path[i] % 2:
                j = i + 1
                while j < len(t) and path[j] == path[i] + 1:
                    j += 1
                want.append((i, j, P.KINDS[path[i] // 2]))
                i = j
            else:
                i += 1
        assert spans == want


def test_held_out_accuracy(params):
    r = random.Random(99)
    samples = [P.labelled(r, 400) for _ in range(200)]
    found = P.find([t for t, _ in samples], P.Decoder(params))
    right, due, got = Counter(), Counter(), Counter()
    for (_, s), f in zip(samples, found, strict=True):
        due.update(k for *_, k in s)
        got.update(k for *_, k in f)
        right.update(k for *_, k in set(s) & set(f))
    told = [k for k in P.KINDS if k not in ("name", "address")]
    assert sum(right[k] for k in told) >= 0.93 * max(sum(due[k] for k in told), sum(got[k] for k in told))
    for k in ("name", "address"):  # where these end is open, as what follows may belong to them
        assert right[k] >= 0.7 * max(due[k], got[k])


def test_spans_in_long_documents_and_across_windows(params):
    r = random.Random(4)
    body = [text(r, 400) for _ in range(4)]
    data = [("card", "4556737586899855"), ("email", "nd.83@mail4.example.com"), ("ip", "190.137.223.204"), ("phone", "+1 (487) 555-7209")]
    t, want = body[0], []
    for (kind, value), b in zip(data, body, strict=True):
        want.append((len(t) + 1, len(t) + 1 + len(value), kind))
        t += f" {value} {b}"
    assert P.find([t], P.Decoder(params))[0] == want
    crowd = " ".join(v for _, v in data * 30)
    assert len(P.find([crowd], P.Decoder(params))[0]) >= 0.95 * 120
    assert P.redact("a bc d", [(2, 4, "email")]) == "a [EMAIL] d"


def test_clean_text_is_left_alone(params):
    r = random.Random(6)
    clean = [text(r, 300) for _ in range(50)] + ["Licensed under CC BY-NC 4.0. See version 3 of 2021, page 12."]
    assert not any(P.find(clean, P.Decoder(params)))


def test_queries_and_stage(spark):
    mail = "Write to the.77@mail3.example.com today"
    df = awkward(spark, [(30, mail), (30, mail), (31, f"{mail} " * 300)])
    rows = {}
    for x in P.detect(df).collect():
        rows.setdefault(x["doc_id"], []).append(x)
    assert len(rows[30]) == 2 and rows[30][0]["text"] == "Write to [EMAIL] today"
    s = rows[30][0]["spans"][0]
    assert mail[s["start"] : s["end"]] == "the.77@mail3.example.com" and s["kind"] == "email"
    assert rows[31][0]["n_spans"] == 300
    assert not {1, 2, 3, 4, 5, 8, 10} & set(rows)
    kept = P.stage(spark, df, "")
    assert kept.columns == df.columns and kept.count() == df.count()
    assert kept.where("text is null").count() == df.where("text is null").count()
    assert kept.where("doc_id = 30").first()["text"] == "Write to [EMAIL] today"
    assert P.detect(df.limit(0)).count() == 0
    assert P.detect(frame(spark, [(1, "plain")])).count() == 0
