"""Document fingerprints: minimum-hash signatures of Lempel-Ziv phrase sets.

Each document is parsed once from left to right into dictionary phrases: a phrase is the shortest run of words that
isn't in the document's own dictionary yet, which it then joins. The phrases are hashed, and a one-permutation
minimum-hash signature of the phrase set estimates the Jaccard similarity of two dictionaries, a stand-in for how well
the two documents compress together. Words are the symbols, as phrases of characters are mostly fragments that any two
texts of a language share.

Two texts are linked if the similarity of their signatures reaches the threshold, and all such pairs are found. Linked
signatures differ in 37 of 126 bins at most. The bins are cut into 19 groups, so one group has one differing bin at most,
and of its three parts two are equal. Every text has a key for each two parts of each group, and linked texts share at
least one key. All pairs that share a key are compared, in blocks, and a link counts under the first key that its two
texts share. Copies are one signature with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .near_dedup import components
from .shared import documents, written

BINS, THRESHOLD = 126, 0.7
#: Signatures in a block: a larger bucket is compared block by block, in as many tasks as there are pairs of blocks.
BLOCK = 4096
#: Buckets up to this size are compared once if they have the same members. It changes how much is compared and nothing else.
SMALL = 64
#: Pairs compared at a time.
PAIRS = 1 << 16
_U = np.uint64
SCHEMA = "doc_id long, n_phrases int, signature binary"


def phrases(words: list[int]) -> set[int]:
    """Hashes of the phrases; the last phrase may repeat an earlier one, as the text ends within it."""
    seen: set[int] = set()
    add, w = seen.add, 0
    for c in words:
        w = hash((w, c))  # numbers hash alike in every process
        if w not in seen:
            add(w)
            w = 0
    return seen


def signatures(texts: list[str], bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Number of phrases of every text, and its signature: 8 bits of the least hash in each bin, empty bins filled from full ones.

    The fill takes, for bin b, the first full bin of a fixed pseudo-random sequence that depends on b alone, so equal
    sets have equal signatures and the estimate stays unbiased for short texts. A text without words has zeros.
    """
    w = K.Words(texts)
    words = w.h.tolist()
    sets = [np.fromiter(p, np.int64, len(p)) for p in (phrases(words[a:b]) for a, b in zip(w.ptr[:-1], w.ptr[1:], strict=True))]
    n = np.array([len(p) for p in sets], np.int64)
    h = K.mix(np.concatenate([*sets, np.zeros(0, np.int64)]).view(np.uint64))
    slot = np.repeat(np.arange(len(texts)), n) * bins + (h >> _U(33)).astype(np.int64) % bins
    none = 1 << 31
    sig = np.full(len(texts) * bins, none, np.int64)
    np.minimum.at(sig, slot, (h & _U(0x7FFFFFFF)).astype(np.int64))
    sig = sig.reshape(len(texts), bins)
    known, fill, probe = sig != none, sig.copy(), 0
    gaps = ~known & (n > 0)[:, None]
    while gaps.any():
        source = (K.mix(np.arange(bins, dtype=np.uint64) * _U(1013) + _U(probe << 32)) % _U(bins)).astype(np.int64)
        take = gaps & known[:, source]
        fill[take] = sig[:, source][take]
        gaps &= ~take
        probe += 1
    fill[n == 0] = 0
    return n, (K.mix(fill.astype(np.uint64)) & _U(255)).astype(np.uint8)


def similarity(agree: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity from the share of equal bins, of which one in 256 agrees by chance."""
    return np.maximum(0, (agree - 1 / 256) / (1 - 1 / 256))


#: Equal bins that reach the threshold, and the bins of every key: two of the three parts of a group.
NEED = next(n for n in range(BINS + 1) if similarity(np.array(n / BINS)) >= THRESHOLD)
GROUPS = (BINS - NEED) // 2 + 1
KEYS = [np.delete(np.arange(BINS)[group], part) for group in np.array_split(np.arange(BINS), GROUPS) for part in np.array_split(np.arange(len(group)), 3)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in K.chunks(batches):
        n, sig = signatures(texts)
        yield K.batch_of(doc_id=batch.column("doc_id"), n_phrases=n.astype(np.int32), signature=pa.array([row.tobytes() for row in sig], pa.binary()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_phrases and the signature of every row with an id."""
    return documents(docs).mapInArrow(_parse, SCHEMA)


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """By row its keys; the highest byte of a key is its number."""
    wide, keys = sig.astype(np.uint64), np.zeros((len(sig), len(KEYS)), np.uint64)
    with np.errstate(over="ignore"):
        for j, bins in enumerate(KEYS):
            for x in bins:
                keys[:, j] = keys[:, j] * _U(0xD6E8FEB86659FD93) + wide[:, x] + _U(1)
            keys[:, j] = (K.mix(keys[:, j]) >> _U(8)) | _U(j << 56)
    return K.signed(keys)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, BINS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row = pa.array(np.repeat(np.arange(b.num_rows), len(KEYS)))
        yield K.batch_of(tid=b.column("tid").take(row), key=bucket_keys(_matrix(b)).ravel())


NUMBERS = ("key", "low", "high", "block", "tid", "first", "copies")
FOUND = "tid long, first long, links long, least long, similarity double, joined long"


def links_in_tiles(rows: dict[str, np.ndarray], sig: np.ndarray) -> pa.RecordBatch:
    """By row of whole tiles that has any: its links, the least first document of a linked text, and one that links join it to.

    Pairs are of two blocks if a tile has two. A pair that shares an earlier key is left to that one.
    """
    n = len(sig)
    i, new = np.arange(n), np.ones(n, bool)
    new[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in ("key", "low", "high")], axis=0)
    begin = np.flatnonzero(new)
    tile = np.cumsum(new) - 1
    end, lower = np.append(begin[1:], n)[tile], rows["block"] == rows["low"]
    upper = (begin + np.add.reduceat(lower.astype(np.int64), begin))[tile] if n else i
    start = np.where(rows["low"] == rows["high"], i + 1, np.where(lower, upper, end))
    until = np.concatenate([[0], np.cumsum(end - start)])
    padded = np.zeros((n, -(-BINS // 8) * 8), np.uint8)
    padded[:, :BINS] = sig
    keys, nth = bucket_keys(sig), rows["key"] >> 56
    links, least, score, root = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n), i.copy()
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(until, until[at] + PAIRS, "right")) - 1)
        x = np.repeat(i[at:to], (end - start)[at:to])
        y = np.arange(until[at], until[to]) - until[x] + start[x]
        at = to
        # Equal bytes are ones; eight columns of them are added up at once.
        equal = (padded[x] == padded[y]).view(np.uint64).sum(axis=1, dtype=np.uint64) * _U(0x0101010101010101) >> _U(56)
        agree = equal.astype(np.int64) - (padded.shape[1] - BINS)
        ok = np.flatnonzero(agree >= NEED)
        ok = ok[(keys[x[ok]] == keys[y[ok]]).argmax(axis=1) == nth[x[ok]]]
        if not len(ok):
            continue
        a, b = np.concatenate([x[ok], y[ok]]), np.concatenate([y[ok], x[ok]])
        alike = np.tile(similarity(agree[ok] / BINS), 2)
        np.add.at(links, a, rows["copies"][b])
        order = np.lexsort((-alike, rows["first"][b], a))
        best = order[np.flatnonzero(np.diff(a[order], prepend=-1))]
        own, other = a[best], rows["first"][b[best]]
        better = (other < least[own]) | ((other == least[own]) & (alike[best] > score[own]))
        least[own[better]], score[own[better]] = other[better], alike[best][better]
        while (root[a] != root[b]).any():
            np.minimum.at(root, root[a], root[b])
            while (root != root[root]).any():
                root = root[root]
    some = np.flatnonzero(links)
    return K.batch_of(tid=rows["tid"][some], first=rows["first"][some], links=links[some], least=least[some], similarity=score[some], joined=rows["first"][root[some]])


def _in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come tile by tile and block by block; those of the last tile, about two blocks at most, wait for the next batch."""
    rows, sig = {c: np.zeros(0, np.int64) for c in NUMBERS}, np.zeros((0, BINS), np.uint8)
    for b in batches:
        if not b.num_rows:
            continue
        rows = {c: np.concatenate([rows[c], b.column(c).to_numpy()]) for c in NUMBERS}
        sig = np.concatenate([sig, _matrix(b)])
        last = np.any([rows[c] != rows[c][-1] for c in ("key", "low", "high")], axis=0)
        whole = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if whole:
            yield links_in_tiles({c: rows[c][:whole] for c in NUMBERS}, sig[:whole])
            rows, sig = {c: rows[c][whole:] for c in NUMBERS}, sig[whole:]
    yield links_in_tiles(rows, sig)


def tiles(texts: DataFrame) -> DataFrame:
    """(key, low, high, block, tid) of all that has to be compared: texts of a bucket, by pairs of blocks.

    Small buckets with the same members are compared once, under the least key. The first key that a pair shares is then
    never dropped: its bucket could only give way to one with a smaller key, which the pair would share as well.
    """
    keys = texts.select("tid", "signature").mapInArrow(_keys, "tid long, key long")
    met = written(keys.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"), "lz-met")
    small, zero = min(SMALL, BLOCK), F.lit(0).cast("long")
    lists = met.where(F.col("n") <= small).groupBy("key").agg(F.sort_array(F.collect_list("tid")).alias("tids"))  # at most SMALL each
    once = lists.groupBy("tids").agg(F.min("key").alias("key")).select("key", zero.alias("low"), zero.alias("high"), zero.alias("block"), F.explode("tids").alias("tid"))
    blocks = F.ceil(F.col("n") / BLOCK)
    large = met.where(F.col("n") > small).select("key", "tid", F.pmod(F.xxhash64("tid"), blocks).alias("block"), F.explode(F.sequence(zero, blocks - 1)).alias("other"))
    return once.union(large.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "tid"))


def linked(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By text (doc_id, signature) its n_links, similar_to and similarity; and edges (doc_id, lead) that connect the linked documents.

    A text is known by its id and its signature, as rows may share an id. n_links counts all other texts that are similar
    to it; similar_to is the least id of any that is smaller than its own.
    """
    rows = prints.where("n_phrases > 0").select("doc_id", "signature").distinct()
    once = rows.groupBy("signature").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    texts = written(once.withColumn("tid", F.monotonically_increasing_id()), "lz-texts")
    order = ("key", "low", "high")
    compared = tiles(texts).join(texts, "tid").select(*NUMBERS, "signature").repartition(*order).sortWithinPartitions(*order, "block")
    found = written(compared.mapInArrow(_in_tiles, FOUND), "lz-found")
    best = found.groupBy("tid").agg(F.sum("links").alias("links"), F.min(F.struct("least", (-F.col("similarity")).alias("minus"))).alias("other"))
    known = texts.join(best, "tid", "left").where("copies > 1 or links is not null")
    own = F.when(F.col("first") < F.col("doc_id"), F.struct(F.col("first").alias("least"), F.lit(-1.0).alias("minus")))
    other = F.when(F.col("other.least") < F.col("doc_id"), F.col("other"))
    each = rows.join(known, "signature").withColumn("s", F.least(own, other))
    each = each.select("doc_id", "signature", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("s.least").alias("similar_to"), (-F.col("s.minus")).alias("similarity"))
    each = written(each, "lz-linked")
    edges = each.select("doc_id", F.col("first").alias("lead")).union(found.select(F.col("first").alias("doc_id"), F.col("joined").alias("lead"))).where("doc_id <> lead")
    return each, edges


def least_similar(texts: DataFrame) -> DataFrame:
    """(doc_id, similar_to, similarity) of documents with a smaller one that any of their texts is similar to."""
    s = F.min(F.struct("similar_to", (-F.col("similarity")).alias("minus"))).alias("s")
    return texts.where("similar_to is not null").groupBy("doc_id").agg(s).select("doc_id", F.col("s.similar_to").alias("similar_to"), (-F.col("s.minus")).alias("similarity"))


def similar(prints: DataFrame) -> DataFrame:
    """(doc_id, similar_to, similarity): the least of all documents that a document is similar to, where that is smaller than itself."""
    return least_similar(linked(prints)[0])


def lz_fingerprints(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_phrases, fingerprint (64 bits of the signature), similar_to, similarity, class_id, n_links.

    Texts are linked if their signatures are similar by at least the threshold; no link is left out. n_links counts the
    other texts that the row's text is linked to, copies included; rows of the same id and signature are one text.
    class_id is the least document that links lead to over any number of steps, and the document itself where it has
    none. similar_to is the least document that it is linked to, and null where none has a smaller id. Rows that share an
    id are one document with several texts: each has its row, its fingerprint and its links, and all have the document's
    class_id and similar_to. Rows without an id are left out; null and empty texts have no phrases, the fingerprint of
    an empty set and no links; a text of any length is parsed whole; repeated rows give repeated rows; an empty table
    gives none; further columns are ignored.
    """
    prints = written(fingerprints(docs), "lz-prints")
    texts, edges = linked(prints)
    classes = components(edges).withColumnRenamed("group", "class_id")
    of_documents = classes.join(least_similar(texts), "doc_id", "left")
    rows = prints.join(texts.select("doc_id", "signature", "n_links"), ["doc_id", "signature"], "left").join(of_documents, "doc_id", "left")
    return rows.select(
        "doc_id",
        "n_phrases",
        F.xxhash64("signature").alias("fingerprint"),
        "similar_to",
        F.round("similarity", 6).alias("similarity"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.when(F.col("n_phrases") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"),
    )


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
