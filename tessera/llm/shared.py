"""Tables written to the folder that all executors share, and the checks that precede a broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a session on one machine (as in tests) gets a temporary folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables that this process wrote and hasn't removed, in order.
WRITTEN: list[str] = []


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that `written` made, once nothing reads them any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        WRITTEN.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: later steps neither recompute it nor depend on an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id (as long) and text of the rows that have an id, with any further columns named; all other columns are left behind."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra)


#: Words of 64 bits that a filter of ids may have: a bound on what is broadcast (about 40 MB), whatever the number of ids.
FILTER_WORDS = 1 << 20


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where df has such columns already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def _marked(docs: DataFrame, ids: DataFrame, bits: str, at_most: int, on: str = "doc_id") -> DataFrame:
    """docs with a column that is 1 where its column `on` may be among the ids (a column id), as it is for every one that is, and 0 elsewhere.

    A blocked Bloom filter: the hash of an id picks a word and two of its bits. It has a word for every eight ids, as many
    as at_most at most. Beyond that it lets more through, and that changes how many rows are joined and nothing else.
    """
    slots, word = free(docs, "_slot", "_word")
    n = max(64, min(at_most, ids.count() // 8))
    h = lambda c: F.xxhash64(F.lit(17), F.col(c).cast("long"))
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int"))
    mask = lambda c: one(F.pmod(F.shiftright(h(c), 6), F.lit(64))).bitwiseOR(one(F.pmod(h(c), F.lit(64))))
    slot = lambda c: F.pmod(F.shiftright(h(c), 12), F.lit(n))
    words = ids.groupBy(slot("id").alias(slots)).agg(F.bit_or(mask("id")).alias(word))
    met = docs.withColumn(slots, slot(on)).join(F.broadcast(words), slots, "left")  # at most at_most rows
    mine = mask(on)
    return met.select(*(F.col(f"`{c}`") for c in docs.columns), F.coalesce((F.col(word).bitwiseAND(mine) == mine).cast("int"), F.lit(0)).alias(bits))


def joined(docs: DataFrame, keys: DataFrame, on: str = "doc_id", at_most: int | None = None) -> DataFrame:
    """documents(), or other rows of known columns, joined with keys (written; by its column id) on doc_id or another column of longs.

    Rows that a filter of the ids rules out are dropped where they are read, so only the others are shuffled. The plan is
    the same at every size: filter, then merge join.
    """
    maybe = _marked(docs, keys, "_bits", at_most or FILTER_WORDS, on).where("_bits = 1").drop("_bits")
    return maybe.join(keys.hint("merge"), F.col(on) == F.col("id")).drop("id")


def without(docs: DataFrame, ids: DataFrame, at_most: int | None = None) -> DataFrame:
    """docs, whatever its columns, without the rows whose doc_id is among the ids (written; a column id).

    Rows that the filter rules out as such never move; only the others are shuffled to be compared with the ids.
    """
    bits, own = free(docs, "_bits", "_own")
    marked = _marked(docs, ids, bits, at_most or FILTER_WORDS)
    gone = ids.select(F.col("id").alias(own)).hint("merge")
    kept, maybe = marked.where(F.col(bits) == 0).drop(bits), marked.where(F.col(bits) == 1).drop(bits)
    return kept.union(maybe.join(gone, F.col("doc_id").cast("long") == F.col(own), "left_anti"))


def in_groups(df: DataFrame, group: list[str], order: list[str], carry: str, flag: str | None = None, name: str = "ordered") -> DataFrame:
    """df (narrow, written, all longs) with each row's place in its group: nth from 0, prev (carry of the row before, null for the first), head and since.

    head is carry of the last row at or before this one that is flagged or opens the group, since the rows from there to
    here. Rows are range-sorted by group and order, so a group may be larger than any task: each partition works on its
    own and what it needs from those before, one row a partition, is added after.
    """
    spark, fields = df.sparkSession, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, group_before, opening = TaskContext.get().partitionId(), 0, None, True
        nth0 = since0 = -1
        prev0 = head0 = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g = np.stack([b.column(c).to_numpy() for c in group], 1)
            v = b.column(carry).to_numpy()
            new, at = np.ones(n, bool), np.arange(n)
            new[1:] = (g[1:] != g[:-1]).any(1)
            new[0] = group_before is None or bool((g[0] != group_before).any())
            begin = np.maximum.accumulate(np.where(new, at, -1))
            nth = np.where(begin >= 0, at - begin, at + nth0 + 1)
            prev, no_prev = np.concatenate([[0 if prev0 is None else prev0], v[:-1]]), new.copy()
            heads = new | (b.column(flag).to_numpy() != 0) if flag else new.copy()
            still = ~np.logical_or.accumulate(new & ((at > 0) | (group_before is not None))) if opening else np.zeros(n, bool)
            if group_before is None:
                heads[0] = bool(flag) and b.column(flag)[0].as_py() != 0
            last = np.maximum.accumulate(np.where(heads, at, -1))
            head, since = np.where(last >= 0, v[last], 0 if head0 is None else head0), np.where(last >= 0, at - last, at + since0 + 1)
            no_head = (last < 0) & (head0 is None)
            columns = {c: b.column(c) for c in fields}
            yield pa.RecordBatch.from_pydict(columns | {"nth": pa.array(nth), "prev": pa.array(prev, mask=no_prev), "head": pa.array(head, mask=no_head), "since": pa.array(since), "part": pa.array(np.full(n, part, np.int64)), "row": pa.array(rows + at), "open": pa.array(still)})
            group_before, opening, rows = g[-1], bool(still[-1]), rows + n
            nth0, prev0, since0, head0 = int(nth[-1]), int(v[-1]), int(since[-1]), None if no_head[-1] else int(head[-1])

    schema = ", ".join(f"{c} long" for c in fields) + ", nth long, prev long, head long, since long, part long, row long, open boolean"
    laid = written(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).mapInArrow(run, schema), name)
    ends = laid.groupBy("part").agg(F.min_by(F.struct(*group, F.col(carry).alias("v")), "row").alias("first"), F.max_by(F.struct(*group, F.col(carry).alias("v"), "nth", "head", "since", "open"), "row").alias("last"))
    given, held = [], None
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # one row a partition
        first, last = r["first"], r["last"]
        if held is None or held[0] != tuple(first[c] for c in group):
            held = None, -1, None, first["v"], -1
        _, nth, prev, head, since = held
        given.append((r["part"], nth, prev, head, since))
        through = last["head"] is None
        held = tuple(last[c] for c in group), last["nth"] + (nth + 1 if last["open"] else 0), last["v"], head if through else last["head"], last["since"] + (since + 1 if through else 0)
    before = spark.createDataFrame(given, "part long, nth_in long, prev_in long, head_in long, since_in long")
    whole = laid.join(F.broadcast(before), "part")
    return whole.select(
        *fields,
        F.when(F.col("open"), F.col("nth") + F.col("nth_in") + 1).otherwise(F.col("nth")).alias("nth"),
        F.when(F.col("open") & (F.col("nth") == 0), F.col("prev_in")).otherwise(F.col("prev")).alias("prev"),
        F.coalesce("head", "head_in").alias("head"),
        F.when(F.col("head").isNull(), F.col("since") + F.col("since_in") + 1).otherwise(F.col("since")).alias("since"),
    )
