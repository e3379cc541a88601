"""Substring dedup with suffix automata of reference shards.

A passage is a run of at least MIN_WORDS words that also stands in a document with a smaller id. Content-defined
anchors (the least of each WINDOW consecutive hashes of GRAM words) find it: any run of MIN_WORDS words holds an anchor,
so two documents that share such a run share an anchor. The document with the least id that has a whole run around an
anchor is the run's reference: where all that have an anchor have the same words around it, that is the least of them;
where the words around it differ, as they do around a stock phrase, the runs are compared one by one. Passages of reference documents around their anchors are spread over shards, and each shard's suffix
automaton of words is built once per copy of the shard and streamed over by every document that shares an anchor with
it. A shard is broadcast to the tasks that need it by a shuffle, in as many copies as there are documents for: a broadcast
variable would go to every executor, and reference passages grow with the corpus.

While streaming, the matching statistics (the longest match that ends at each word) give the maximal spans of the
document that occur in an earlier one; those of at least MIN_WORDS words are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .shared import documents, joined, written

MIN_WORDS, GRAM = 50, 10
WINDOW = MIN_WORDS - GRAM + 1
#: Reference anchors per shard (an anchor brings about 21 new words), and characters of documents per copy of a shard.
SHARD_ANCHORS, COPY_CHARS = 4000, 16_000_000
_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)
SPAN = "array<struct<start:int,end:int>>"


def sliding_min(v: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values, from minima of prefixes and suffixes of blocks of k."""
    n = len(v) - k + 1
    if n <= 0:
        return v[:0]
    padded = np.concatenate([v, np.full(-len(v) % k, _MAX)]).reshape(-1, k)
    before = np.minimum.accumulate(padded, 1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[k - 1 : k - 1 + n])


def chosen(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every run of MIN_WORDS words of a text where it begins and the word at which its anchor begins, which depends on the run alone; and the hash of GRAM words from every word on."""
    n = len(w.h) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.arange(n)
    g = K.spans_hash(w.h, start, start + GRAM)
    v = (g & _U(0xFFFFFFFF00000000)) | start.astype(np.uint64)
    least = sliding_min(v, WINDOW)
    inside = np.flatnonzero(w.doc[: len(least)] == w.doc[MIN_WORDS - 1 : MIN_WORDS - 1 + len(least)])
    return inside, (least[inside] & _U(0xFFFFFFFF)).astype(np.int64), g


def anchors(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Words at which an anchor begins, and its hash. Every run of MIN_WORDS words of a text holds one that depends on the run alone."""
    _, at, g = chosen(w)
    at = np.unique(at)
    return at, g[at]


class Automaton:
    """A suffix automaton of word hashes, grown passage by passage in order of document id; each state knows the first document that has it."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last = 0
        self.long: dict[int, int] = {}

    def add(self, words: list[int], doc: int) -> None:
        """Append a passage; a word that stands nowhere else keeps it apart from the one before."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = self.last
        for c in (-len(nxt) - 1, *words):
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            first.append(doc)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.last = last

    def _first_of(self, state: int) -> int:
        """First document with the last MIN_WORDS words of what leads to the state: that of the highest state up its links that is as long."""
        found = self.long.get(state)
        if found is None:
            s = state
            while self.length[self.link[s]] >= MIN_WORDS:
                s = self.link[s]
            found = self.long[state] = self.first[s]
        return found

    def matches(self, words: list[int], doc: int) -> list[tuple[int, int]]:
        """Maximal spans of words, [start, end), made of runs of at least MIN_WORDS words that a document with a smaller id has."""
        nxt, link, length = self.next, self.link, self.length
        out: list[tuple[int, int]] = []
        s = size = 0
        for i, c in enumerate(words, 1):
            t = nxt[s].get(c)
            while t is None and s:
                s = link[s]
                size = length[s]
                t = nxt[s].get(c)
            if t is None:
                continue
            s = t
            size += 1
            if size >= MIN_WORDS and self._first_of(s) < doc:
                if out and out[-1][1] >= i - MIN_WORDS:
                    out[-1] = out[-1][0], i
                else:
                    out.append((i - MIN_WORDS, i))
        return out


def contexts(w: K.Words, at: np.ndarray) -> np.ndarray:
    """A hash of the words that any run of MIN_WORDS words around each anchor can have."""
    doc = w.doc[at]
    return K.spans_hash(w.h, np.maximum(at - WINDOW + 1, w.ptr[doc]), np.minimum(at + MIN_WORDS, w.ptr[doc + 1]))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in K.chunks(batches):
        w = K.Words(texts)
        at, g = anchors(w)
        doc = w.doc[at]
        yield K.batch_of(anchor=K.signed(g), context=K.signed(contexts(w, at)), doc_id=batch.column("doc_id").take(pa.array(doc)), place=(at - w.ptr[doc]).astype(np.int32))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all runs of MIN_WORDS words whose anchors are asked for; texts of a repeated id that don't have them are passed over."""
    for batch, texts in K.chunks(batches):
        w = K.Words(texts)
        asked = batch.column("asked")
        if isinstance(asked, pa.ChunkedArray):
            asked = asked.combine_chunks()
        row, own = np.repeat(np.arange(len(texts)), asked.value_lengths().to_numpy(zero_copy_only=False)), asked.flatten()
        place, anchor, context, around, many = (own.field(c).to_numpy(zero_copy_only=False) for c in ("place", "anchor", "context", "around", "many"))
        at = w.ptr[row] + place
        fits = np.flatnonzero(at + GRAM <= w.ptr[row + 1])
        fits = fits[(K.signed(K.spans_hash(w.h, at[fits], at[fits] + GRAM)) == anchor[fits])]
        fits = fits[K.signed(contexts(w, at[fits])) == context[fits]]
        which = np.full(len(w.h), -1)
        which[at[fits]] = fits
        start, anchored, _ = chosen(w)
        own = which[anchored]
        start, fits = start[own >= 0], own[own >= 0]
        run = K.spans_hash(w.h, start, start + MIN_WORDS)
        yield K.batch_of(run=K.signed(run), around=around[fits], first=batch.column("doc_id").take(pa.array(row[fits])), many=many[fits])


def owners(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(owner, doc_id, place): for every anchor of a document, the least documents with a run of MIN_WORDS words around it that several have."""
    one = F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), (F.min("context") != F.max("context")).alias("mixed")
    shared = written(found.groupBy("anchor").agg(*one).where("owner <> last").drop("last").withColumnRenamed("anchor", "id"), "sub-owners")
    met = written(joined(found, shared, "anchor"), "sub-met")  # anchors of one document stay where they are
    plain = met.where("not mixed").select("owner", "doc_id", "place")
    # Documents with the same words around an anchor have the same runs, so the least of them stands for all.
    around = F.xxhash64("anchor", "context").alias("around")
    least = F.min(F.struct("doc_id", "place")).alias("least"), (F.min("doc_id") < F.max("doc_id")).alias("many")
    alike = met.where("mixed").groupBy("anchor", "context", around).agg(*least)
    asked = alike.groupBy(F.col("least.doc_id").alias("id")).agg(F.collect_list(F.struct("least.place", "anchor", "context", "around", "many")).alias("asked"))
    runs = joined(documents(docs), written(asked, "sub-asked")).select("doc_id", "text", "asked")
    runs = written(runs.mapInArrow(_runs, "run long, around long, first long, many boolean"), "sub-runs")
    several = ((F.min("first") < F.max("first")) | F.max("many")).alias("several")
    owned = written(runs.groupBy(F.col("run").alias("id")).agg(F.min("first").alias("owner"), several).where("several").drop("several"), "sub-owned")
    owned = written(joined(runs.select("run", "around"), owned, "run").select("around", "owner").distinct(), "sub-around")
    return plain.union(met.where("mixed").drop("owner").withColumn("around", around).join(owned, "around").select("owner", "doc_id", "place"))


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come shard by shard, references (in order of id) before documents; one automaton is held at a time."""
    shard, tree = None, Automaton()
    for batch in batches:
        for part, texts in K.chunks(iter([batch])):
            w = K.Words(texts)
            h = w.h.tolist()
            ids, spans, kept = [], [], []
            shards, kinds, docs, places, versions = (part.column(c).to_pylist() for c in ("key", "is_query", "doc_id", "places", "version"))
            for i, doc in enumerate(docs):
                if shards[i] != shard:
                    shard, tree = shards[i], Automaton()
                own = h[w.ptr[i] : w.ptr[i + 1]]
                if not kinds[i]:
                    a = np.array(sorted(places[i]))
                    new = np.flatnonzero(np.diff(a, prepend=-MIN_WORDS * 9) > 2 * MIN_WORDS)
                    for lo, hi in zip(new, np.append(new[1:], len(a)), strict=True):
                        tree.add(own[max(0, int(a[lo]) - WINDOW + 1) : int(a[hi - 1]) + MIN_WORDS], doc)
                    continue
                found = tree.matches(own, doc)
                if found:
                    s, e, at = w.s[w.ptr[i] : w.ptr[i + 1]], w.e[w.ptr[i] : w.ptr[i + 1]], w.at[i]
                    ids.append(doc)
                    kept.append(versions[i])
                    spans.append([{"start": int(s[x] - at), "end": int(e[y - 1] - at)} for x, y in found])
            yield K.batch_of(doc_id=pa.array(ids, pa.int64()), version=pa.array(kept, pa.int64()), spans=pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the union of the spans, and that union; what follows a cut keeps its leading space."""
    union: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if union and s <= union[-1][1]:
            union[-1] = union[-1][0], max(e, union[-1][1])
        else:
            union.append((s, e))
    out, last = [], 0
    for s, e in union:
        out.append(text[last:s])
        last = e
    return "".join([*out, text[last:]]), union


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in K.chunks(batches):
        done = [cut(t, [(x["start"], x["end"]) for own in s for x in own]) for t, s in zip(texts, batch.column("found").to_pylist(), strict=True)]
        spans = pa.array([[{"start": s, "end": e} for s, e in u] for _, u in done], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        yield K.batch_of(doc_id=batch.column("doc_id"), n_spans=pa.array([len(u) for _, u in done], pa.int32()), removed_chars=pa.array([sum(e - s for s, e in u) for _, u in done], pa.int32()), spans=spans, text=pa.array([t for t, _ in done], pa.string()))


def shared_passages(docs: DataFrame) -> DataFrame:
    """Documents with passages that an earlier document has: doc_id, n_spans, removed_chars, spans (characters), text without them.

    Other documents have no row; nor have rows without an id, and null, empty and short texts. A text of any length is
    streamed whole. Of several earlier documents with a passage it makes no difference which is meant. Rows with the same doc_id
    are parts of one document, and nothing is removed from either for the other's sake; each gives its own row. A text
    that repeats itself isn't touched. An empty table gives no rows; further columns are ignored.
    """
    texts = documents(docs)
    found = written(texts.mapInArrow(_anchors, "anchor long, context long, doc_id long, place int"), "sub-anchors")
    hits = written(owners(docs, found), "sub-hits")
    n_reference = hits.where("owner = doc_id").count()
    n_shards = max(1, -(-n_reference // SHARD_ANCHORS))
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(n_shards)).cast("int")
    own = F.col("owner") == F.col("doc_id")
    needs = hits.groupBy("doc_id").agg(F.collect_set(F.when(~own, shard("owner"))).alias("shards"), F.collect_set(F.when(own, F.col("place"))).alias("places"))
    wanted = joined(texts, written(needs.withColumnRenamed("doc_id", "id"), "sub-needs")).withColumn("version", F.xxhash64("text"))
    wanted = written(wanted, "sub-texts")  # the only documents that can hold a passage or lend one
    query = wanted.where(F.size("shards") > 0).select(F.explode("shards").alias("shard"), F.lit(True).alias("is_query"), "doc_id", F.lit(None).cast("array<int>").alias("places"), "version", "text")
    reference = wanted.where(F.size("places") > 0).select(shard("doc_id").alias("shard"), F.lit(False).alias("is_query"), "doc_id", "places", "version", "text")
    copies = query.groupBy("shard").agg(F.ceil(F.sum(F.length("text")) / COPY_CHARS).cast("int").alias("copies"))
    query = query.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int"))
    reference = reference.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    columns = [F.concat_ws("/", "shard", "copy").alias("key"), "is_query", "doc_id", "places", "version", "text"]
    rows = query.select(*columns).union(reference.select(*columns)).repartition("key").sortWithinPartitions("key", "is_query", "doc_id")
    spans = rows.mapInArrow(_match, f"doc_id long, version long, spans {SPAN}").groupBy("doc_id", "version").agg(F.collect_list("spans").alias("found"))
    return wanted.select("doc_id", "version", "text").join(spans, ["doc_id", "version"]).select("doc_id", "text", "found").mapInArrow(_cut, f"doc_id long, n_spans int, removed_chars int, spans {SPAN}, text string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
