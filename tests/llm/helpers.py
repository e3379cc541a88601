"""Invented text for the tests of the corpus operators."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
SYLLABLES = {
    "en": "the and ing er tion on at re th nd ea ly wh ou ble".split(),
    "fr": "que le eau ou aux tion é è ment oi re an ier elle vi".split(),
    "de": "sch ung en der ein keit ü ö ch lich ge ver ä ß heit".split(),
}


def words(r, n, lang="en"):
    return ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def text(r, n, lang="en"):
    out, start = [], True
    for w in words(r, n, lang):
        out.append(w.capitalize() if start else w)
        start = r.random() < 0.1
        if start:
            out[-1] += "."
    return " ".join(out)


def edit(r, t, rate):
    """The text with this share of its words replaced."""
    return " ".join(w if r.random() > rate else "".join(r.choice(SYLLABLES["en"]) for _ in range(3)) + "x" for w in t.split(" "))


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def awkward(spark, rows=()):
    """Rows with nulls, empty and very long texts, repeated rows, and columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    r = random.Random(3)
    long = text(r, 30_000)
    odd = [(1, None), (2, ""), (3, " \n\t"), (4, "!!! ... ###"), (None, "no id at all"), (None, None), (5, "one"), (6, "one"), (7, "one two"), (7, "one two"), (8, long), (9, long), (10, "\U0001f600 日本語 العربية é"), (11, "7" * 40), (12, "a" * 5000)]
    df = frame(spark, [*odd, *rows])
    clash = ("lang", "source", "key", "lead", "group", "h", "n", "keep", "score", "similarity", "spans", "part", "sig", "copy", "shard", "_gone", "label_id", "nth", "chosen_id", "id", "found")
    return df.withColumns({c: F.lit("x") if c != "n" else F.lit(1) for c in clash})
