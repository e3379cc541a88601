"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics describe a document's characters, words and lines, and how strongly its words are tied to either label
(log-likelihood ratios of words learned from the labelled rows). Random Fourier features approximate a Gaussian kernel
over them; each partition adds up its part of the normal equations, the driver solves them for quality and toxicity at
once, and isotonic regression on rows that the ridge didn't see turns scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .shared import documents, written

#: Labelled rows that the fit may use (those of least hash), which bounds the fit alone, and the log-likelihood ratio from
#: which a word is tied to a label: a chance of one in a thousand.
FIT_ROWS, TIED = 20_000, 10.83
FEATURES, RIDGE, WIDTH, HOLDOUT = 384, 1e-3, 2.0, 5
SYMBOLS = "#$%&*|!@^~<>=_+{}[]\\/"
SCHEMA = "doc_id long, p_quality double, p_toxic double, keep boolean"
_U = np.uint64


def _per(ufunc_in: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of a flag over each text's characters."""
    total = np.concatenate([[0], np.cumsum(ufunc_in, dtype=np.int64)])
    return (total[at[1:]] - total[at[:-1]]).astype(float)


def statistics(texts: list[str], lexicon: tuple[K.Lookup, np.ndarray] | None) -> np.ndarray:
    """One row of numbers a text; a text without characters has zeros."""
    w = K.Words(texts)
    cp, at, ptr = w.cp, w.at, w.ptr
    n = np.diff(ptr).astype(float)
    chars = np.diff(at) - 1.0
    low = K.lower_table()[cp]
    word = _per(low != 0, at)
    space = _per(cp == 32, at)
    lines = _per(cp == 10, at)
    symbol = _per(np.isin(cp, [ord(c) for c in SYMBOLS]), at)
    digit = _per((cp >= 48) & (cp <= 57), at)
    upper = _per(K.upper_table()[cp], at)
    stops = _per(np.isin(cp, [33, 46, 63]), at)
    size = (w.e - w.s).astype(float)
    mean = K.reduce_by(np.add, size, ptr, 0.0) / np.maximum(n, 1)
    square = K.reduce_by(np.add, size * size, ptr, 0.0) / np.maximum(n, 1)
    distinct = np.array([len(np.unique(w.h[a:b])) for a, b in zip(ptr[:-1], ptr[1:], strict=True)], float)
    some, many = np.maximum(chars, 1), np.maximum(n, 1)
    cols = [np.log1p(chars), np.log1p(n), mean, np.sqrt(np.maximum(square - mean * mean, 0)), space / some, lines / many, np.sqrt(symbol / some), np.sqrt(digit / some), np.sqrt(upper / np.maximum(word, 1)), stops / many, (chars - word - space - lines) / some, distinct / many, np.log1p(n) * distinct / many]
    for side in range(2):
        weight = np.zeros(len(w.h))
        if lexicon is not None and len(w.h) and len(lexicon[1]):
            row = lexicon[0](w.h)
            weight[row >= 0] = lexicon[1][row[row >= 0], side]
        cols += [np.log1p(K.reduce_by(np.maximum, weight, ptr, 0.0)), np.log1p(K.reduce_by(np.add, weight, ptr, 0.0)), np.log1p(K.reduce_by(np.add, weight, ptr, 0.0) / many)]
    return np.stack(cols, 1)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every word, in how many documents of each label it stands."""
    for batch, texts in K.chunks(batches):
        w = K.Words(texts)
        own = np.concatenate([np.zeros(0, np.int64), *(a + np.unique(w.h[a:b], return_index=True)[1] for a, b in zip(w.ptr[:-1], w.ptr[1:], strict=True))])
        u, at = np.unique(w.h[own], return_inverse=True)
        y = np.stack([1 - batch.column("quality").to_numpy(), batch.column("toxic").to_numpy()], 1)[w.doc[own]]
        yield K.batch_of(h=K.signed(u), n=np.bincount(at, minlength=len(u)), low=np.bincount(at, y[:, 0], len(u)).astype(np.int64), toxic=np.bincount(at, y[:, 1], len(u)).astype(np.int64))


def _ratio(n: F.Column, k: F.Column, rows: float, positive: float) -> F.Column:
    """Signed log-likelihood ratio of a word standing in k of `positive` documents and n of all rows; 0 if it isn't over-represented."""
    p, q, r = F.lit(positive / rows), k / n, (F.lit(positive) - k) / F.greatest(F.lit(rows) - n, F.lit(1.0))
    term = lambda a, b: F.when(a > 0, a * F.log(b)).otherwise(0.0)
    with_word = term(k, q / p) + term(n - k, (1 - q) / (1 - p))
    return F.when(q > r, 2 * with_word).otherwise(0.0)


class Model:
    """Everything that scoring needs, of fixed size."""

    lexicon: tuple[K.Lookup, np.ndarray] | None = None
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: list[tuple[np.ndarray, np.ndarray]]

    def features(self, texts: list[str]) -> np.ndarray:
        x = np.clip((statistics(texts, self.lexicon) - self.mean) / self.scale, -4, 4)
        rng = np.random.default_rng(101)
        a = rng.standard_normal((x.shape[1], FEATURES)) / (WIDTH * np.sqrt(x.shape[1]))
        z = np.cos(x @ a + rng.uniform(0, 2 * np.pi, FEATURES)) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(x), 1))])

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.features(texts) @ self.weights

    def probabilities(self, texts: list[str]) -> np.ndarray:
        s = self.scores(texts)
        return np.stack([np.interp(s[:, j], *self.steps[j]) for j in range(2)], 1)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on score by pooling adjacent violators; equal scores are pooled first."""
    if not len(score):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    u, at = np.unique(score, return_inverse=True)
    weight, total = np.bincount(at).astype(float), np.bincount(at, y)
    blocks: list[list[float]] = []  # first, last, weight, sum
    for s, wt, t in zip(u, weight, total, strict=True):
        blocks.append([s, s, wt, t])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    x = np.array([v for b in blocks for v in b[:2]])
    return x, np.repeat([b[3] / b[2] for b in blocks], 2)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on up to FIT_ROWS labelled rows; None if there are no such rows. Copies of a text count once, a row whose labels are null or conflicting doesn't count."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("_q"), F.min("toxic").alias("toxic"), F.max("toxic").alias("_t")).where("quality = _q and toxic = _t")
    chosen = known.select("label_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(FIT_ROWS)
    rows = documents(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "quality", "toxic")  # at most FIT_ROWS rows
    once = rows.groupBy(F.xxhash64("text")).agg(F.min_by(F.struct("doc_id", "text", "quality", "toxic"), "doc_id").alias("r")).select("r.*")
    rows = written(once.coalesce(16), "quality-fit")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HOLDOUT)) == 0
    train, hold = rows.where(~held), rows.where(held)
    n, low, toxic = train.agg(F.count("*"), F.sum(1 - F.col("quality")), F.sum("toxic")).first()
    if not n:
        return None
    model = Model()
    counts = train.mapInArrow(_words, "h long, n long, low long, toxic long").groupBy("h").agg(*(F.sum(c).cast("double").alias(c) for c in ("n", "low", "toxic"))).where("n >= 5")
    lex = counts.withColumns({"a": _ratio(F.col("n"), F.col("low"), n, low) if 0 < low < n else F.lit(0.0), "b": _ratio(F.col("n"), F.col("toxic"), n, toxic) if 0 < toxic < n else F.lit(0.0)})
    top = {}
    for side in ("a", "b"):
        for r in lex.where(F.col(side) > TIED).orderBy("h").collect():  # words of at most FIT_ROWS documents, in five of them or more
            top.setdefault(r["h"], [0.0, 0.0])["ab".index(side)] = r[side]
    if top:
        model.lexicon = K.Lookup(np.array(list(top), np.int64).view(np.uint64)), np.array(list(top.values()))
    shared = spark.sparkContext.broadcast(model.lexicon)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for _, texts in K.chunks(batches):
            x = statistics(texts, shared.value)
            total = total + np.stack([np.full(x.shape[1], len(x)), x.sum(0), (x * x).sum(0)])
        if not isinstance(total, float):
            yield K.batch_of(sums=pa.array([total.ravel()]))

    sums = np.sum([r["sums"] for r in train.mapInArrow(moments, "sums array<double>").collect()], axis=0).reshape(3, -1)  # a row a partition, at most 16
    model.mean = sums[1] / sums[0]
    model.scale = np.sqrt(np.maximum(sums[2] / sums[0] - model.mean**2, 0)) + 1e-6
    ready = spark.sparkContext.broadcast(model)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 3))
        for batch, texts in K.chunks(batches):
            z = ready.value.features(texts)
            total += z.T @ np.hstack([z, np.stack([batch.column("quality").to_numpy(), batch.column("toxic").to_numpy()], 1)])
        yield K.batch_of(sums=pa.array([total.ravel()]))

    total = np.zeros((FEATURES + 1) * (FEATURES + 3))
    for r in train.mapInArrow(equations, "sums array<double>").toLocalIterator():
        total += np.array(r["sums"])
    total = total.reshape(FEATURES + 1, -1)
    penalty = np.eye(FEATURES + 1) * RIDGE * n / FEATURES
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(total[:, : FEATURES + 1] + penalty + 1e-9 * np.eye(FEATURES + 1), total[:, FEATURES + 1 :])
    scorer = spark.sparkContext.broadcast(model)

    def held_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in K.chunks(batches):
            s = scorer.value.scores(texts)
            yield K.batch_of(a=s[:, 0], b=s[:, 1], quality=batch.column("quality"), toxic=batch.column("toxic"))

    seen = np.array([tuple(r) for r in hold.mapInArrow(held_scores, "a double, b double, quality int, toxic int").collect()], float).reshape(-1, 4)  # a fifth of FIT_ROWS
    model.steps = [isotonic(seen[:, j], seen[:, 2 + j]) for j in range(2)]
    return model


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_quality, p_toxic and keep (p_quality at least a half and p_toxic below it) of every row with an id.

    Null and empty texts are scored as documents whose statistics are all 0; a text of any length is read whole. Equal
    scores have equal probabilities. Repeated rows give repeated rows, an empty
    table none; further columns of either table are ignored. Without labelled rows both probabilities are null and every
    document is kept.
    """
    model = fit(docs, labels)
    if model is None:
        return documents(docs).select("doc_id", F.lit(None).cast("double").alias("p_quality"), F.lit(None).cast("double").alias("p_toxic"), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in K.chunks(batches):
            p = np.round(shared.value.probabilities(texts), 6)
            yield K.batch_of(doc_id=batch.column("doc_id"), p_quality=p[:, 0], p_toxic=p[:, 1], keep=(p[:, 0] >= 0.5) & (p[:, 1] < 0.5))

    return documents(docs).mapInArrow(run, SCHEMA)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
