import random

import numpy as np

from tessera.llm import packing as P

from .helpers import awkward, frame, text


def test_hilbert_keys_visit_every_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 3)):
        cells = np.stack([x.ravel() for x in np.meshgrid(*[np.arange(1 << bits)] * dims)], 1)
        keys = P.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(1 << bits * dims))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def laid_out(rows, sizes, capacity):
    """Pieces by walking through the documents in order, one token at a time."""
    out, place = [], 0
    for doc, key in rows:
        start = 0
        while start < sizes[doc]:
            seq, off = divmod(place, capacity)
            n = min(capacity - off, sizes[doc] - start)
            out.append((seq, off, doc, start, n, key))
            start += n
            place += n
    return out


def test_pieces_against_a_walk(spark):
    r = random.Random(1)
    docs = [(i, text(r, r.choice([1, 5, 40, 300]), r.choice(["en", "fr", "de"]))) for i in range(120)]
    docs += [(i + 200, t) for i, t in docs[:15]]
    got = sorted(tuple(x) for x in P.pack(frame(spark, docs), 64).select("sequence", "offset", "doc_id", "doc_start", "n_tokens", "hilbert_key").collect())
    n, _, h = P.project([t for _, t in docs])
    sizes, hashes = ({d: int(v) for (d, _), v in zip(docs, x, strict=True)} for x in (n, P.K.signed(h)))
    keys = {x[2]: x[5] for x in got}
    assert got == laid_out(sorted(keys.items(), key=lambda x: (x[1], hashes[x[0]], x[0])), sizes, 64)
    again = sorted(tuple(x) for x in P.pack(frame(spark, docs).repartition(7), 64).select("sequence", "offset", "doc_id", "doc_start", "n_tokens", "hilbert_key").collect())
    assert again == got


def test_neighbours_on_the_curve_are_alike(spark):
    r = random.Random(2)
    docs = [(i, text(r, 150, ["en", "fr", "de"][i % 3])) for i in range(300)]
    order = [x["doc_id"] for x in P.pack(frame(spark, docs)).orderBy("sequence", "offset").dropDuplicates(["doc_id"]).orderBy("sequence", "offset").collect()]
    _, x, _ = P.project([t for _, t in docs])
    near = np.mean([x[a] @ x[b] for a, b in zip(order, order[1:], strict=False)])
    assert near > np.mean(x @ x.T) + 0.1


def test_awkward_rows(spark):
    df = awkward(spark)
    got = P.pack(df, 2048).collect()
    total = {}
    for x in got:
        total[x["doc_id"]] = total.get(x["doc_id"], 0) + x["n_tokens"]
    assert total == {5: 1, 6: 1, 7: 4, 8: 30_000, 9: 30_000, 10: 3, 11: 1, 12: 1}
    fill = {}
    for x in got:
        fill[x["sequence"]] = fill.get(x["sequence"], 0) + x["n_tokens"]
    assert all(v == 2048 for k, v in fill.items() if k < max(fill))
    assert P.pack(df.limit(0)).count() == 0
    assert P.pack(frame(spark, [(1, None), (2, "...")])).count() == 0
