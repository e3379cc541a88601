"""Packing along a space-filling curve.

Every document is a hashed bag of words, projected to three dimensions by pseudo-random signs of its word hashes and
scaled to unit length. The coordinates are cut at global quantiles into 2**BITS cells, the cell's index along a Hilbert
curve is the sort key, and documents range-sorted by that key are laid end to end into sequences of a fixed number of
tokens, so that a sequence holds documents that are neighbours on the curve. Positions are global prefix sums: the
result doesn't depend on how the sort was partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .shared import documents, written

DIMS, BITS, CAPACITY = 3, 10, 2048
_U = np.uint64
_AXES = [f"x{i}" for i in range(DIMS)]
SCHEMA = "doc_id long, n_tokens long, text_hash long, " + ", ".join(f"{x} float" for x in _AXES)


def project(texts: list[str], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text, its unit vector in few dimensions, and a hash of its words; zeros for a text without words."""
    w = K.Words(texts)
    n = np.diff(w.ptr)
    x = np.zeros((len(texts), dims))
    with np.errstate(over="ignore"):
        for d in range(dims):
            unit = ((w.h * K.seeds(dims, 71)[d] >> _U(40)).astype(np.float64) - (1 << 23)) / (1 << 23)
            x[:, d] = K.reduce_by(np.add, unit, w.ptr, 0.0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return n, x.astype(np.float32), K.spans_hash(w.h, w.ptr[:-1], w.ptr[1:])


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer cells (rows) of `bits` bits a dimension; a bijection onto 0..2**(bits*dims)-1.

    Undoes, from the coarsest bit down, the exchange and inversion of axes that the curve applies within each octant,
    then reads the Gray code off the interleaved bits.
    """
    x = [c.astype(np.int64) for c in cells.T]
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            upper = (x[i] & q) != 0
            t = np.where(upper, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(upper, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in K.chunks(batches):
        n, x, h = project(texts)
        yield K.batch_of(doc_id=batch.column("doc_id"), n_tokens=n, text_hash=K.signed(h), **{a: x[:, d] for d, a in enumerate(_AXES)})


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents in sequences: sequence, offset (place in the sequence), doc_id, doc_start, n_tokens, hilbert_key.

    Tokens are words. Every sequence but the last is full, and the pieces of a document cover each of its tokens once.
    Rows with the same key are ordered by the hash of their words and then their id, so that copies are neighbours;
    repeated rows are laid out one after the other. Rows without an id, and null, empty or wordless texts, have nothing
    to pack and are left out; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    points = written(documents(docs).mapInArrow(_project, SCHEMA).where("n_tokens > 0"), "pack-points")
    cuts = points.approxQuantile(_AXES, [i / 256 for i in range(1, 256)], 1 / 2048)
    if not cuts[0]:
        return spark.createDataFrame([], "sequence long, offset long, doc_id long, doc_start long, n_tokens long, hilbert_key long")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = []
            for a, c in zip(_AXES, cuts, strict=True):
                edges = np.concatenate([[-1.0], c, [1.0]])
                cells.append(np.interp(b.column(a).to_numpy(), edges, np.linspace(0, (1 << BITS) - 1, len(edges))))
            yield K.batch_of(hilbert_key=hilbert_keys(np.floor(np.stack(cells, 1)).astype(np.int64)), text_hash=b.column("text_hash"), doc_id=b.column("doc_id"), n_tokens=b.column("n_tokens"))

    keyed = points.mapInArrow(key, "hilbert_key long, text_hash long, doc_id long, n_tokens long")
    order = ["hilbert_key", "text_hash", "doc_id", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield K.batch_of(part=np.full(len(n), part, np.int32), hilbert_key=b.column("hilbert_key"), doc_id=b.column("doc_id"), n_tokens=n, before=before)

    laid = written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "part int, hilbert_key long, doc_id long, n_tokens long, before long"), "pack-order")
    sizes = laid.groupBy("part").agg(F.sum("n_tokens").alias("size")).orderBy("part").collect()  # one row a partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r["part"], total))
        total += r["size"]
    at = spark.createDataFrame(starts, "part int, base long")
    placed = laid.join(F.broadcast(at), "part").withColumn("begin", F.col("before") + F.col("base"))
    pieces = placed.withColumn("sequence", F.explode(F.expr(f"sequence(begin div {capacity}, (begin + n_tokens - 1) div {capacity})")))
    low = F.greatest("begin", F.col("sequence") * capacity)
    high = F.least(F.col("begin") + F.col("n_tokens"), (F.col("sequence") + 1) * capacity)
    return pieces.select("sequence", (low - F.col("sequence") * capacity).alias("offset"), "doc_id", (low - F.col("begin")).alias("doc_start"), (high - low).alias("n_tokens"), "hilbert_key")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of the documents."""
    return pack(docs)
