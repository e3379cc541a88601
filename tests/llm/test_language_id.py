import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language_id as L

from .helpers import awkward, text


def longest(data, reference):
    """Greedy cross-parsing by search, one phrase at a time."""
    n = i = 0
    while i < len(data):
        k = 1
        while i + k < len(data) and data[i : i + k + 1] in reference:
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrases_against_search(monkeypatch):
    r = random.Random(1)
    for few in (1, 24, 10_000):  # all side by side, both ways, all singly
        monkeypatch.setattr(L.Parser, "FEW", few)
        for _ in range(12):
            texts = {lang: bytes(r.choice((0, 2, 3, 4, 5)) for _ in range(r.randint(1, 60))) for lang in "abc"}
            local = {lang: np.array([0, 1, *(r.choice((1, 2, 3, 4, 5)) for _ in range(8))], np.uint8) for lang in "abc"}
            data = [np.array([r.randrange(10) for _ in range(r.choice([0, 1, 7, 40, 200]))], np.uint16) for _ in range(40)]
            got = L.Parser(texts, local, 6).count(data)
            assert got.tolist() == [[longest(local[lang][d].tobytes(), texts[lang]) for d in data] for lang in "abc"]
    assert L.Parser({}, {}, 6).count([np.zeros(3, np.uint16)]).shape == (0, 1)


def test_symbols():
    a = L.Alphabet({"x": Counter({97: 5, 98: 1}), "y": Counter({0x4E00 + i: 1000 - i for i in range(300)})})
    first, second, third = a.symbols(["", "  Ab, 12 c! ", "\u4e00\u4e01\u4e00"])
    assert len(first) == 0 and a.local["x"][second].tolist() == [2, 3, 0, 1, 0] and a.local["y"][second].tolist() == [1, 1, 0, 1, 0]
    assert a.local["y"][third].tolist() == [2, 3, 2] and a.local["x"][third].tolist() == [1, 1, 1]
    # Letters beyond those with symbols of their own share some, but none of the others'.
    shared = a.local["y"][a.symbols(["".join(chr(0x4E00 + i) for i in range(300))])[0]]
    assert len(set(shared[: L.LETTERS].tolist())) == L.LETTERS and set(shared[L.LETTERS :].tolist()) <= set(range(2 + L.LETTERS, 2 + L.LETTERS + L.SHARED))


def test_languages_without_spaces_are_told_apart():
    r = random.Random(9)
    zh = [chr(0x4E00 + int(r.paretovariate(0.8)) % 2500) for _ in range(400)]
    ja = [chr(0x3042 + r.randrange(80)) for _ in range(60)] + zh[:200]
    make = lambda pool, n: "".join(r.choice(pool) for _ in range(n))
    words = {"zh": [make(zh, 2) for _ in range(200)], "ja": [make(ja, 3) for _ in range(200)], "en": ["the", "and", "ing", "river", "stone"]}
    m = L.train({lang: ["".join(r.choice(own) for _ in range(6000))] for lang, own in words.items()})
    texts = [(lang, "".join(r.choice(own) for _ in range(60))) for lang, own in words.items() for _ in range(30)]
    assert sum(f[0] == lang for f, (lang, _) in zip(L.classify([t for _, t in texts], m), texts, strict=True)) >= 0.95 * len(texts)


def model():
    r = random.Random(4)
    return L.train({lang: [text(r, 3000, lang)] for lang in ("en", "fr", "de")})


def test_held_out_accuracy_and_rejection():
    m, r = model(), random.Random(5)
    texts = [(lang, text(r, r.choice([8, 30, 300]), lang)) for lang in ("en", "fr", "de") for _ in range(40)]
    found = L.classify([t for _, t in texts], m)
    assert sum(f[0] == lang for f, (lang, _) in zip(found, texts, strict=True)) >= 0.95 * len(texts)
    assert all(f[5] for f in found)
    noise = "".join(r.choice("qxzjkvwpbcfg") for _ in range(2000))
    greek = "".join(r.choice("αβγδεζηθικλμν ") for _ in range(2000))
    assert [f[5] for f in L.classify([noise, greek, "", "123 !!", "the"], m)] == [False, False, False, False, True]


def test_a_rare_label_changes_nothing_for_the_others():
    r = random.Random(6)
    pieces = {lang: [text(r, 3000, lang)] for lang in ("en", "fr", "de")}
    m = L.train(pieces | {"xx": [text(r, 40)]})
    assert {lang: len(t) for lang, t in m.texts.items()} == dict.fromkeys(("en", "fr", "de"), L.TRAIN_CHARS)
    texts = [(lang, text(r, r.choice([8, 30, 300]), lang)) for lang in ("en", "fr", "de") for _ in range(40)]
    assert sum(f[0] == lang for f, (lang, _) in zip(L.classify([t for _, t in texts], m), texts, strict=True)) >= 0.95 * len(texts)
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (300, 1000, 2000) for _ in range(10)]
    few = L.train(pieces | {"xx": [text(r, 120)]})
    assert len(few.texts) == 4 and 400 <= len(few.texts["xx"]) < 1500 and len(few.texts["en"]) == L.TRAIN_CHARS
    assert not any(f[5] for f in L.classify(noise, m)) and not any(f[5] for f in L.classify(noise, few))


def test_queries_and_stage(spark):
    r = random.Random(8)
    rows = [(i + 100, text(r, 200, lang), lang) for i, lang in enumerate(["en", "fr", "de"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    junk = spark.createDataFrame([(1, "".join(r.choice("qxzjk ") for _ in range(3000)), "en"), (2, None, None), (3, "", "fr")], df.schema)
    both = df.union(junk)
    found = {x["doc_id"]: x for x in L.identify(both, L.fit(df)).collect()}
    assert sum(found[i]["language"] == lang for i, _, lang in rows) >= 0.97 * len(rows)
    assert all(found[i]["keep"] for i, _, _ in rows)
    assert not any(found[i]["keep"] for i in (1, 2, 3)) and found[2]["language"] is None
    kept = L.stage(spark, df.union(junk.where("doc_id > 1")), "")
    assert kept.columns == df.columns and kept.count() == len(rows)


def test_awkward_rows(spark):
    df = awkward(spark).withColumn("lang", F.lit("en"))
    found = {x["doc_id"]: x for x in L.identify(df).collect()}
    assert set(found) == set(range(1, 13))
    assert [found[i]["keep"] for i in (1, 2, 3, 4, 11)] == [False] * 5
    assert found[8]["keep"] and found[9]["language"] == "en"
    assert L.identify(df.limit(0)).count() == 0
    for unlabelled in (df.withColumn("lang", F.lit(None).cast("string")), df.drop("lang")):
        assert all(r["keep"] and r["language"] is None for r in L.identify(unlabelled).collect())
        assert L.stage(spark, unlabelled, "").columns == unlabelled.columns and L.stage(spark, unlabelled, "").count() == df.count()
    assert L.stage(spark, df, "").columns == df.columns
    assert L.stage(spark, df.limit(0), "").count() == 0
