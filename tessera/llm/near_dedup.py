"""MinHash near-dedup with Order MinHash.

A document is a sequence of k-word shingles, each labelled with its occurrence number so that repeats count. Each of m
hash functions samples the `ell` labelled shingles of least hash and keeps them in text order; the hash of that ordered
tuple is one sketch. Two texts share a sketch with a probability that falls with their edit distance, since both the
sample and its order have to agree. Texts of the very same words are settled by a hash of all of them, and the first
stands for the others. Documents that share any sketch are candidates, and every candidate is verified by banded
alignment of all its words; connected components of the verified pairs are the groups. Each bucket is first compared
with its least id, the lead, for which texts are shuffled once to the leads that they are compared with. Buckets whose
members aren't all in one group after that get all pairs of different groups compared, in blocks of members.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .shared import documents, joined, without, written

SHINGLE, ELL, SKETCHES, THRESHOLD = 4, 2, 24, 0.85
#: Candidates of one lead that a task compares; a lead with more goes to as many tasks as it takes.
LEAD_SHARE = 2048
#: Members of a bucket in one block; a bucket with more is compared block by block, in as many tasks as there are pairs of blocks.
BLOCK = 512
_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)


def occurrence_labelled(g: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Shingle hashes with the number of earlier equal ones in the same document mixed in."""
    if not len(g):
        return g
    with np.errstate(over="ignore"):
        key = K.mix(g + doc.astype(np.uint64) * _U(0xA24BAED4963EE407))
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
    nth = np.empty(len(g), np.int64)
    nth[order] = np.arange(len(g)) - np.repeat(new, np.diff(np.append(new, len(g))))
    with np.errstate(over="ignore"):
        return K.mix(g + nth.astype(np.uint64) * _U(0x9FB21C651E98DF25))


def sketches(texts: list[str], shingle: int = SHINGLE, ell: int = ELL, m: int = SKETCHES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the texts with any word, and by row their m sketches and two hashes of all their words."""
    w = K.Words(texts)
    some = np.flatnonzero(np.diff(w.ptr))
    out = np.empty((len(some), m), np.uint64)
    first, last = w.ptr[:-1][some], w.ptr[1:][some]
    whole = np.stack([K.spans_hash(w.h, first, last), K.spans_hash(K.mix(w.h), first, last)], 1)
    if not len(some):
        return some, out, whole
    g = occurrence_labelled(w.grams(shingle), w.doc)
    place, begin = np.arange(len(g), dtype=np.uint64), first
    with np.errstate(over="ignore"):
        for j, (a, b) in enumerate(zip(K.seeds(m, 61) | _U(1), K.seeds(m, 67), strict=True)):
            v = g * a
            v += b
            v &= _U(0xFFFFFFFF00000000)
            v |= place
            picked = np.empty((len(some), ell), np.int64)
            for x in range(ell):
                least = np.minimum.reduceat(v, begin)
                at = (least & _U(0xFFFFFFFF)).astype(np.int64)
                at[least == _MAX] = -1
                v[at[at >= 0]] = _MAX
                picked[:, x] = at
            picked.sort(axis=1)
            key = np.full(len(some), b)
            for x in range(ell):
                key = K.mix(key * _U(0xD6E8FEB86659FD93) + np.where(picked[:, x] >= 0, g[picked[:, x]], _U(0)))
            out[:, j] = key
    return some, out, whole


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences by bit-parallel dynamic programming over the 2*most+1 diagonals, most+1 if it is larger."""
    n, m = len(a), len(b)
    if n < m:
        a, b, n, m = b, a, m, n
    if n - m > most:
        return most + 1
    if a == b:
        return 0
    most_ = most
    most = min(most, n)
    if most == 0:
        return most_ + 1
    if m == 0:
        return n
    width = 2 * most + 1
    full = (1 << width) - 1
    # Of each symbol its places, how many of them the band has reached, and their bits as seen from the last row that asked.
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    seen = {x: [0, 0, 0] for x in places}
    vp, vn = full & ~((1 << most) - 1), 0
    score, low, side = most, 1 << (2 * most), 1 << (2 * most - 1)
    for j, x in enumerate(b):
        eq = 0
        if x in seen:
            own, state = places[x], seen[x]
            nth, eq, row = state
            eq >>= j - row
            while nth < len(own) and own[nth] <= j + most:
                if own[nth] >= j - most:
                    eq |= 1 << (own[nth] + most - j)
                nth += 1
            state[:] = nth, eq, j
        d0 = ((((eq & vp) + vp) & full) ^ vp) | eq | vn
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if j < n - most:
            score += not d0 & low
        else:
            score += bool(hp & side) - bool(hn & side)
            side >>= 1
        d1 = d0 >> 1
        vp, vn = hn | (full & ~(d1 | hp)), d1 & hp
    return score if score <= most_ else most_ + 1


def similarity(a: list[int], b: list[int], threshold: float = THRESHOLD) -> float:
    """1 - distance / longer length in words if that is at least the threshold, else 0."""
    longer = max(len(a), len(b))
    if not longer:
        return 0.0
    most = int((1 - threshold) * longer + 1e-9)
    # Each edit settles one word at most, so the words beyond those in common are a lower bound.
    least = longer - sum((Counter(a) & Counter(b)).values())
    if least > most:
        return 0.0
    # A narrow band costs little and is enough for texts that differ little.
    band = min(most, max(64, 2 * least))
    d = banded_distance(a, b, band)
    while band < d and band < most:
        band = min(most, band * 4)
        d = banded_distance(a, b, band)
    return 0.0 if d > most else 1 - d / longer


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in K.chunks(batches):
        some, keys, whole = sketches(texts)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, SKETCHES, dtype=np.int32)), pa.array(K.signed(keys.ravel())))
        yield K.batch_of(doc_id=batch.column("doc_id").take(pa.array(some)), whole=K.signed(whole[:, 0]), again=K.signed(whole[:, 1]), keys=flat)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come lead by lead, the lead's own text (or texts, if its id is repeated) before the others; only that is held."""
    lead, held = None, []
    for batch in batches:
        for part, texts in K.chunks(iter([batch])):
            w = K.Words(texts)
            leads, members = part.column("lead").to_pylist(), part.column("is_member").to_pylist()
            found = np.zeros(len(texts))
            for i, own in enumerate(leads):
                words = w.h[w.ptr[i] : w.ptr[i + 1]]
                if own != lead:
                    lead, held = own, []
                if not members[i]:
                    held.append(words.copy())
                elif len(words):
                    listed = words.tolist()
                    found[i] = max((1.0 if np.array_equal(x, words) else similarity(x.tolist(), listed) for x in held), default=0.0)
            ok = pa.array(np.flatnonzero(found))
            yield K.batch_of(doc_id=part.column("doc_id").take(ok), lead=part.column("lead").take(ok), similarity=found[found > 0])


def exact_and_sketched(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, lead, similarity 1) of documents whose words are those of a smaller id; and doc_id, keys of every text's first document."""
    rows = written(documents(docs).mapInArrow(_emit, "doc_id long, whole long, again long, keys array<long>"), "near-sketches")
    # Equal words have equal sketches, so a group needs no row but its first; copies are added up before they move.
    once = written(rows.groupBy("whole", "again").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"), F.first("keys").alias("keys")), "near-once")
    first = once.where("lead <> last").select("whole", "again", "lead")
    led = rows.select("doc_id", "whole", "again").join(first, ["whole", "again"]).where("doc_id <> lead")
    return led.select("doc_id", "lead").distinct().withColumn("similarity", F.lit(1.0)), once.select(F.col("lead").alias("doc_id"), "keys")


def shared_buckets(sketched: DataFrame) -> DataFrame:
    """(doc_id, nth, key, lead) of the buckets with more than one document; lead is the least id of the bucket."""
    keys = sketched.select("doc_id", F.posexplode("keys").alias("nth", "key"))
    own = Window.partitionBy("key")
    both = keys.withColumns({"lead": F.min("doc_id").over(own), "last": F.max("doc_id").over(own)})
    return written(both.where("lead <> last").select("doc_id", "nth", "key", "lead"), "near-buckets")


def lead_pairs(docs: DataFrame, buckets: DataFrame) -> DataFrame:
    """Verified pairs of a document and the least id of a bucket that it is in."""
    pairs = written(buckets.where("doc_id <> lead").select("lead", "doc_id").distinct(), "near-pairs")
    shares = pairs.groupBy("lead").agg(F.ceil(F.count("*") / LEAD_SHARE).cast("int").alias("shares"))
    share: Column = F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int")
    members = pairs.join(shares, "lead").select(F.col("doc_id").alias("id"), "lead", share.alias("share"), F.lit(True).alias("is_member"))
    leads = shares.select(F.col("lead").alias("id"), "lead", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(False).alias("is_member"))
    wanted = written(members.union(leads), "near-wanted")
    rows = joined(documents(docs), wanted).select("lead", "share", "is_member", "doc_id", "text")
    found = rows.repartition("lead", "share").sortWithinPartitions("lead", "share", "is_member").mapInArrow(_verify, "doc_id long, lead long, similarity double")
    return found.groupBy("doc_id", "lead").agg(F.max("similarity").alias("similarity"))


def verified_in_tile(ids: list[int], groups: list[int], blocks: np.ndarray, words: list[np.ndarray], keys: np.ndarray, nth: int) -> list[tuple[int, int, float]]:
    """(greater id, smaller id, similarity) of pairs that join all groups which any pair of this tile joins.

    Pairs are of the two blocks if there are two. A pair that shares an earlier bucket is left to that one, and one of
    the same group is joined already. Documents with most sketches in common with others come first: the base of many
    copies then joins them before they are compared with each other. That order changes only how many are compared.
    """
    n = len(ids)
    size = np.array([len(x) for x in words])
    ptr = np.concatenate([[0], np.cumsum(size)])
    flat = occurrence_labelled(np.concatenate(words), np.repeat(np.arange(n), size))
    labels, flat = np.unique(flat, return_inverse=True)
    common = np.zeros(n, np.int64)
    for column in keys.T:
        _, at, count = np.unique(column, return_inverse=True, return_counts=True)
        common += count[at]
    group = np.unique(np.array(groups), return_inverse=True)[1]
    across = blocks.min() != blocks.max()
    marked = np.zeros(len(labels), bool)
    listed: dict[int, list[int]] = {}
    ahead, out = np.ones(n, bool), []
    for x in np.argsort(-common, kind="stable").tolist():
        ahead[x] = False
        due = ahead & (group != group[x])
        if across:
            due &= blocks != blocks[x]
        due &= (keys[:, :nth] != keys[x, :nth]).all(1)
        if not due.any():
            continue
        # As many words as the longer text has beyond those in common have to be edited at least.
        longer = np.maximum(size, size[x])
        marked[flat[ptr[x] : ptr[x + 1]]] = True
        due &= longer - np.add.reduceat(marked[flat], ptr[:-1]) <= ((1 - THRESHOLD) * longer + 1e-9).astype(np.int64)
        marked[flat[ptr[x] : ptr[x + 1]]] = False
        for y in np.flatnonzero(due).tolist():
            if group[y] == group[x]:
                continue
            for z in (x, y):
                if z not in listed:
                    listed[z] = words[z].tolist()
            s = similarity(listed[x], listed[y])
            if s:
                out.append((max(ids[x], ids[y]), min(ids[x], ids[y]), s))
                group[group == group[y]] = group[x]
    return out


def _verify_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come tile by tile; the words of one tile are held."""
    tile, held = None, []

    def settled() -> list[tuple[int, int, float]]:
        ids, groups, blocks, words, keys = zip(*held, strict=True) if held else ((),) * 5
        return verified_in_tile(list(ids), list(groups), np.array(blocks), list(words), np.stack(keys), tile[1]) if len(held) > 1 else []

    def emitted(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
        ids, leads, scores = zip(*found, strict=True) if found else ((),) * 3
        return K.batch_of(doc_id=pa.array(ids, pa.int64()), lead=pa.array(leads, pa.int64()), similarity=pa.array(scores, pa.float64()))

    for batch in batches:
        for part, texts in K.chunks(iter([batch])):
            w = K.Words(texts)
            some, keys, _ = sketches(texts)
            row = dict(zip(some.tolist(), range(len(some)), strict=True))
            found = []
            columns = (part.column(c).to_pylist() for c in ("key", "nth", "low", "high", "block", "group", "doc_id"))
            for i, (key, nth, low, high, block, group, own) in enumerate(zip(*columns, strict=True)):
                if tile != (key, nth, low, high):
                    found += settled()
                    tile, held = (key, nth, low, high), []
                # Of rows that share an id, only those texts that are in the bucket.
                if i in row and int(keys[row[i], nth].astype(np.int64)) == key:
                    held.append((own, group, block, w.h[w.ptr[i] : w.ptr[i + 1]].copy(), keys[row[i]].copy()))
            yield emitted(found)
    yield emitted(settled())


def remaining_pairs(docs: DataFrame, buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """Verified pairs that join groups (doc_id, group: of all that are in any) within a bucket."""
    named = buckets.join(groups.withColumnRenamed("doc_id", "grouped"), F.col("doc_id") == F.col("grouped"), "left")
    named = named.select("doc_id", "nth", "key", F.coalesce("group", "doc_id").alias("group"))
    mixed = named.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("least <> most").select("key", "blocks")
    block: Column = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    members = named.join(written(mixed, "near-mixed"), "key").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = members.select(F.col("doc_id").alias("id"), "key", "nth", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "group").distinct()
    wanted = written(tiles, "near-tiles")
    rows = joined(documents(docs), wanted)
    order = ("key", "nth", "low", "high")
    return rows.repartition(*order).sortWithinPartitions(*order).mapInArrow(_verify_tiles, "doc_id long, lead long, similarity double").groupBy("doc_id", "lead").agg(F.max("similarity").alias("similarity"))


def verified_pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs whose words are the same or align with at least the threshold (doc_id, lead, similarity), and edges that connect the same documents."""
    exact, sketched = exact_and_sketched(docs)
    buckets = shared_buckets(sketched)
    first = written(lead_pairs(docs, buckets).union(exact), "near-verified")
    groups = written(components(first), "near-groups")
    rest = written(remaining_pairs(docs, buckets, groups), "near-remaining")
    return first.union(rest), groups.withColumnRenamed("group", "lead").union(rest.select("doc_id", "lead"))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group): the least id of each node's connected component, by alternating large-star and small-star steps.

    Every round is written to the shared folder, so a lost executor costs one round at most.
    """
    pairs = written(edges.select(F.greatest("doc_id", "lead").alias("u"), F.least("doc_id", "lead").alias("v")).distinct(), "near-edges")
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
        large = low.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        star = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = written(star, "near-round")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return pairs.select(F.col("u").alias("doc_id"), F.col("v").alias("group"))
        before = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Documents that repeat another: doc_id, duplicate_of (the least id of the group, which stays), similarity.

    similarity is the best verified alignment of the row with a member of its group. Rows without an id are left out; a
    null, empty or wordless text has no sketch and is in no group; rows with the same doc_id count as one document; an
    empty table gives no rows; further columns are ignored.
    """
    pairs, edges = verified_pairs(docs)
    best = pairs.select("doc_id", "similarity").union(pairs.select("lead", "similarity")).groupBy("doc_id").agg(F.max("similarity").alias("similarity"))
    return components(edges).join(best, "doc_id").select("doc_id", F.col("group").alias("duplicate_of"), F.round("similarity", 6).alias("similarity"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, and all that are in none, those without an id or words included.

    All columns stay as they are. Rows that share an id are one document and stay or go together. An empty table gives
    none.
    """
    return without(docs, written(near_duplicates(docs).select(F.col("doc_id").alias("id")), "near-gone"))
