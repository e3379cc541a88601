"""Compound questions over atoms and observations. All of them are derived, none is a store of record.

Membership of an atom in a list of subjects is always an exploded equi-join: containment would plan a nested loop.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_subject(observations: DataFrame) -> DataFrame:
    """One row for each observation and distinct subject, with the subject's first place."""
    places = observations.withColumn("subject", F.explode(F.array_distinct("subjects")))
    return places.withColumn("place", F.array_position("subjects", F.col("subject")).cast("int") - 1)


def atoms_with(atoms: DataFrame, observations: DataFrame, kind: str) -> DataFrame:
    """Atoms that have an observation of the kind."""
    subjects = by_subject(observations.where(F.col("kind") == kind)).select(F.col("subject").alias("atom_id"))
    return atoms.join(subjects, "atom_id", "left_semi")


def atoms_without(atoms: DataFrame, observations: DataFrame, kind: str) -> DataFrame:
    subjects = by_subject(observations.where(F.col("kind") == kind)).select(F.col("subject").alias("atom_id"))
    return atoms.join(subjects, "atom_id", "left_anti")


def neighbours(observations: DataFrame, kind: str) -> DataFrame:
    """(subject, other, observation_id): atoms related by an observation of the kind, in either direction."""
    pairs = observations.where(F.col("kind") == kind).select("observation_id", F.explode(F.array_distinct("subjects")).alias("subject"), "subjects")
    return pairs.select("subject", F.explode(F.array_distinct("subjects")).alias("other"), "observation_id").where("subject <> other")


def as_of(observations: DataFrame, instant: dt.datetime) -> DataFrame:
    """The latest observation of each subject and kind that was known and in effect at the instant; ties go to the greater id.

    The instant is the caller's; no clock is read.
    """
    t = F.lit(instant).cast("timestamp")
    known = by_subject(observations.where((F.col("recorded_at") <= t) & (F.col("effective_at") <= t)))
    order = Window.partitionBy("subject", "kind").orderBy(F.col("effective_at").desc(), F.col("recorded_at").desc(), F.col("observation_id").desc())
    return known.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def within_months(rows: DataFrame, column: str, instant: dt.datetime, months: int) -> DataFrame:
    """Rows whose time is in the months up to the instant."""
    t = F.lit(instant)
    return rows.where((F.col(column) > t - F.make_interval(months=F.lit(months))) & (F.col(column) <= t))


def translation_memory(atoms: DataFrame, observations: DataFrame, kind: str) -> DataFrame:
    """(source, target): text of related atoms, the first subject being the target and the second the source."""
    from ..functions.nodes import reconstruct

    pairs = observations.where((F.col("kind") == kind) & (F.size("subjects") >= 2)).select(F.col("subjects")[0].alias("target_id"), F.col("subjects")[1].alias("source_id"))
    side = lambda name: atoms.select(F.col("atom_id").alias(f"{name}_id"), F.col("language").alias(f"{name}_language"), reconstruct("content").alias(name))
    return pairs.join(side("target"), "target_id").join(side("source"), "source_id").select("source_language", "source", "target_language", "target")


def reachable(edges: DataFrame, hops: int) -> DataFrame:
    """(src, dst, hops): what can be reached in at most this many steps, with the fewest steps. Each step joins the frontier, of what wasn't reached before, once."""
    frontier = edges.select("src", "dst").distinct().withColumn("hops", F.lit(1))
    found = frontier
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")).distinct()
    for n in range(2, hops + 1):
        # What was reached before leads nowhere new, so a cycle isn't walked again.
        frontier = frontier.join(step, "dst").select("src", F.col("next").alias("dst")).distinct().join(found.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("hops", F.lit(n))
        found = found.union(frontier)
    return found


def _better(best_s: np.ndarray, best_i: np.ndarray, s: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best lists (a row a query, greatest similarity first, then least id) after a block of further vectors."""
    k = best_s.shape[1]
    least = best_s[:, -1:]
    if s.shape[1] > k:
        least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k, None])
    row, col = np.nonzero(s >= least)  # all that can be among the best, ties included
    row = np.concatenate([np.repeat(np.arange(len(best_s)), k), row])
    value, name = np.concatenate([best_s.ravel(), s[row[best_s.size :], col]]), np.concatenate([best_i.ravel(), ids[col]])
    order = np.lexsort((name, -value, row))
    first = np.searchsorted(row[order], np.arange(len(best_s)))
    take = order[first[:, None] + np.arange(k)]
    return value[take], name[take]


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, shard_rows: int = 65_536) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest vectors of every query by cosine, exactly; a vector isn't its own neighbour.

    Input: vec_id, embedding. Queries are broadcast in shards of a bounded size, each met by one pass over the corpus
    that keeps k per partition, and the partitions' lists are merged by rank. Ties go to the smaller id. Null vectors,
    those of length zero and those of another dimension than the first query's have no neighbours.
    """
    spark = queries.sparkSession
    schema = "query_id long, vec_id long, similarity double"
    out = spark.createDataFrame([], schema)
    rows = queries.where("embedding is not null").select("vec_id", "embedding")
    n_shards = -(-rows.count() // shard_rows)
    for i in range(n_shards):
        own = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)) == i).toArrow()
        ids = own.column("vec_id").to_numpy()
        if not len(ids):
            continue
        vectors = own.column("embedding").to_pylist()
        dims = len(vectors[0])
        good = [j for j, v in enumerate(vectors) if len(v) == dims and any(v)]
        q = np.array([vectors[j] for j in good], float).reshape(-1, dims)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids[good], q))

        def search(batches: Iterator[pa.RecordBatch], shared=shared, dims=dims) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_s, best_i = np.full((len(ids), k), -2.0), np.full((len(ids), k), np.iinfo(np.int64).max)
            for b in batches:
                pairs = [(i, v) for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True) if v is not None and i is not None and len(v) == dims and any(v)]
                for lo in range(0, len(pairs), 4096):
                    part = pairs[lo : lo + 4096]
                    own = np.array([i for i, _ in part])
                    v = np.array([x for _, x in part], float)
                    v /= np.linalg.norm(v, axis=1, keepdims=True)
                    for at in range(0, len(ids), 1024):
                        block = slice(at, at + 1024)
                        s = np.round(q[block] @ v.T, 6)
                        s[ids[block, None] == own] = -2
                        best_s[block], best_i[block] = _better(best_s[block], best_i[block], s, own)
            real = best_s > -2
            yield pa.RecordBatch.from_pydict({"query_id": np.repeat(ids, k)[real.ravel()], "vec_id": best_i[real], "similarity": best_s[real]})

        out = out.union(corpus.select("vec_id", "embedding").mapInArrow(search, schema))
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
