"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders (runs of one type become one), so that a question and its
re-parameterised copy have the same template. Windows of template tokens of the benchmark are the build side of a hash
join, probed by every window of every document inside one pass over the text. Hits that lie on one diagonal of a
document and an item are aligned, and the values of their slots have to map one to one: a value that the item repeats
must be repeated in the document and the other way round, whatever the new value is.

A capital that opens a sentence may or may not be a name, so texts are read both ways, on both sides. An item with too
few literal words for a window (such as "2 + 2 = 4") has no template to speak of and is looked up word for word, as is
any that is shorter than a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .shared import documents

#: Template tokens per window (fewer for an item that is shorter), the share of an item's tokens that hits must cover,
#: the share of its slots that have to be consistent, and literal tokens that a window needs at least.
WINDOW, COVERAGE, CONSISTENT, LITERALS = 8, 0.5, 0.8, 3
#: Characters of benchmark text broadcast at once; a larger benchmark is probed in as many passes as it takes.
SHARD_CHARS = 64_000_000
UNITS = "kg g mg lb lbs oz ton tons km m cm mm mi mile miles ft feet inch inches yard yards l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars usd euro euros eur pound pounds cent cents kmh mph hz khz mhz ghz w kw watt watts v volt volts degree degrees"
_U = np.uint64
NUM, NAME, UNIT = (_U(x) for x in K.seeds(3, 83))
SCHEMA = "doc_id long, item_id long, coverage double, window_hits int, slots int, changed_slots int, doc_start int, doc_end int"


class Template:
    """Template tokens of a run of texts: h (hash), value (of a slot), slot, doc, ptr, s and e (bounds in cp). openers: by text, which capitals that open a sentence are names: 0 none, 1 the text's first word, as where it is quoted within a sentence, 2 all."""

    def __init__(self, texts: list[str] | K.Words, openers: np.ndarray | int = 0) -> None:
        w = texts if isinstance(texts, K.Words) else K.Words(texts)
        kind = np.zeros(len(w.h), np.uint64)
        upper = K.upper_table()
        if len(w.h):
            c0 = w.cp[w.s]
            second = w.cp[np.minimum(w.s + 1, len(w.cp) - 1)]
            number = (c0 >= 48) & (c0 <= 57)
            one, two = w.cp[np.maximum(w.s - 1, 0)], w.cp[np.maximum(w.s - 2, 0)]
            inside = ((one == 32) & (K.lower_table()[two] != 0) | (one == 32) & np.isin(two, [44, 59])) & (w.s >= w.at[w.doc] + 2)
            capital = upper[c0] & ~upper[second] & (w.e - w.s > 1)
            reading = np.broadcast_to(openers, w.n)[w.doc]
            name = capital & (inside | (reading == 2) | (reading == 1) & (np.arange(len(w.h)) == w.ptr[w.doc]))
            unit = np.isin(w.h, _units())
            unit[1:] &= number[:-1] & (w.doc[1:] == w.doc[:-1])
            unit[:1] = False
            kind[name], kind[number], kind[unit] = NAME, NUM, UNIT
        keep = np.ones(len(kind), bool)
        keep[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1]) | (w.doc[1:] != w.doc[:-1])
        first = np.flatnonzero(keep)
        self.slot = kind[first] != 0
        self.h = np.where(self.slot, kind[first], w.h[first])
        last = np.append(first[1:], len(kind)) - 1
        self.value = K.spans_hash(w.h, first, last + 1) if len(first) else w.h
        self.s, self.e, self.doc, self.at = w.s[first], w.e[last] if len(first) else w.e, w.doc[first], w.at
        self.ptr = np.searchsorted(self.doc, np.arange(w.n + 1))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every window of k tokens that lies in one text and has enough literal tokens."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        start = np.arange(n)
        literal = np.concatenate([[0], np.cumsum(~self.slot)])
        ok = (self.doc[:n] == self.doc[k - 1 :]) & (literal[k:] - literal[:-k] >= LITERALS)
        start = start[ok]
        return start, K.spans_hash(self.h, start, start + k)


def _units() -> np.ndarray:
    w = K.Words([UNITS])
    return w.h


class Benchmark:
    """Windows of a shard of the benchmark, by window length, and the items' tokens for the check of slots; words of items without windows."""

    def __init__(self, items: list[int], texts: list[str]) -> None:
        # Items with the same template and the same pattern of repeated values match the same passages, so one row stands for all.
        rows: list[tuple[int, int]] = []
        members: dict[tuple[bytes, bytes], dict[int, np.ndarray]] = {}
        for reading in range(3):
            one = Template(texts, reading)
            for i in sorted(range(len(texts)), key=lambda i: items[i]):
                own = slice(one.ptr[i], one.ptr[i + 1])
                values = one.value[own][one.slot[own]]
                _, first, number = np.unique(values, return_index=True, return_inverse=True)
                key = one.h[own].tobytes(), first[number].tobytes()
                if key not in members:
                    members[key] = {}
                    rows.append((i, reading))
                members[key].setdefault(items[i], values)
        self.ids = [np.array(list(x), np.int64) for x in members.values()]
        self.values = [np.stack(list(x.values())) for x in members.values()]
        t = self.t = Template([texts[i] for i, _ in rows], np.array([x for _, x in rows]))
        size = np.diff(t.ptr)
        self.tables, windowed = [], set()
        for k in sorted({int(min(WINDOW, n)) for n in size if n}):
            start, h = t.windows(k)
            own = size[t.doc[start]] >= WINDOW if k == WINDOW else size[t.doc[start]] == k
            start, h = start[own], h[own]
            if not len(h):
                continue
            windowed |= {item for x in np.unique(t.doc[start]).tolist() for item in self.ids[x].tolist()}
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            self.tables.append((k, K.Lookup(keys), start[order], np.append(first, len(h))))
        self.plain: list[tuple[int, K.Lookup, list[list[int]]]] = []
        w = K.Words(texts)
        n, h = np.diff(w.ptr), K.spans_hash(w.h, w.ptr[:-1], w.ptr[1:])
        whole = np.diff(Template(texts).ptr)
        exact = [i for i in range(len(texts)) if (items[i] not in windowed or whole[i] < WINDOW) and n[i] > 1]
        for k in sorted({int(n[i]) for i in exact}):
            own: dict[int, list[int]] = {}
            for i in exact:
                if n[i] == k:
                    own.setdefault(int(h[i]), []).append(i)
            self.plain.append((k, K.Lookup(np.array(list(own), np.uint64)), [[items[i] for i in x] for x in own.values()]))

    def hits(self, t: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document token, item token and window length of every window that both have."""
        found = [(np.zeros(0, np.int64),) * 3]
        for k, lookup, starts, first in self.tables:
            at, h = t.windows(k)
            row = lookup(h)
            hit = np.flatnonzero(row >= 0)
            row = row[hit]
            n = first[row + 1] - first[row]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append((np.repeat(at[hit], n), starts[np.repeat(first[row], n) + nth], np.full(int(n.sum()), k)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]

    def contaminated(self, texts: list[str]) -> list[tuple]:
        """(text, item id, coverage, hits, slots, changed slots, first and last character) of the best passage for each text and item."""
        w = K.Words(texts)
        best: dict[tuple[int, int], tuple] = {}
        for d, i, *found in [*self._word_for_word(w), *self._aligned(Template(w)), *self._aligned(Template(w, 2))]:
            # Of two passages the better covered, then that with more hits, fewer changed slots, and the earlier.
            key, rank = (d, i), (found[0], found[1], -found[3], -found[4])
            if key not in best or rank > best[key][0]:
                best[key] = rank, found
        return [(*key, *found) for key, (_, found) in sorted(best.items())]

    def _word_for_word(self, w: K.Words) -> Iterator[tuple]:
        for k, lookup, rows in self.plain:
            start = np.arange(max(0, len(w.h) - k + 1))
            start = start[w.doc[start] == w.doc[start + k - 1]]
            row = lookup(K.spans_hash(w.h, start, start + k))
            for at, r in zip(start[row >= 0].tolist(), row[row >= 0].tolist(), strict=True):
                d = int(w.doc[at])
                for i in rows[r]:
                    yield d, i, 1.0, 1, 0, 0, int(w.s[at] - w.at[d]), int(w.e[at + k - 1] - w.at[d])

    def _aligned(self, t: Template) -> list[tuple]:
        """The best passage for each text and reading of an item."""
        a, b, k = self.hits(t)
        if not len(a):
            return []
        doc, item = t.doc[a], self.t.doc[b]
        # Placeholders of a template can stretch a passage by a token or two, so diagonals are followed from hit to hit.
        order = np.lexsort((a, a - b, item, doc))
        doc, item, a, b, k = doc[order], item[order], a[order], b[order], k[order]
        group = np.flatnonzero(np.diff(doc * len(self.ids) + item, prepend=-1))
        out = []
        for lo, hi in zip(group, np.append(group[1:], len(a)), strict=True):
            size = int(self.t.ptr[item[lo] + 1] - self.t.ptr[item[lo]])
            base = int(self.t.ptr[item[lo]])
            x, y = a[lo:hi], b[lo:hi] - base
            by = np.argsort(x, kind="stable")
            x, y, n = x[by], y[by], k[lo:hi][by]
            d, passing = int(doc[lo]), []
            for hits in _passages(x, y, size):
                covered, tokens = np.zeros(size, bool), np.full(size, -1, np.int64)
                for i in hits:
                    span = np.arange(n[i])
                    covered[y[i] + span] = True
                    tokens[y[i] + span] = x[i] + span
                coverage = float(covered.mean())
                if coverage < COVERAGE:
                    continue
                place = np.flatnonzero(covered & self.t.slot[base : base + size])
                mine, theirs = t.value[tokens[place]].tolist(), self.t.value[base + place].tolist()
                good = sum(p == 1 for p in _fan(mine, theirs))
                if len(place) and good < CONSISTENT * len(place):
                    continue
                nth = np.cumsum(self.t.slot[base : base + size])[place] - 1
                differ = (self.values[item[lo]][:, nth] != t.value[tokens[place]]).sum(1)
                best = int(np.argmin(differ))
                inside = tokens[covered]
                passing.append((coverage, len(hits), int(self.ids[item[lo]][best]), len(place), int(differ[best]), int(t.s[inside.min()] - t.at[d]), int(t.e[inside.max()] - t.at[d])))
            if passing:
                coverage, found, own, *rest = max(passing, key=lambda p: p[:2])
                out.append((d, own, coverage, found, *rest))
        return out


def _passages(x: np.ndarray, y: np.ndarray, size: int) -> list[list[int]]:
    """Hits (document token x in ascending order, item token y) of every passage that may hold the item.

    Stretches no longer than the item allows, from that of most hits on, without those hits that one before has; and
    chains of hits that go on in both texts along a diagonal, so that variants in a row or a line that is repeated
    beside the item are looked at one by one.
    """
    out, left = [], np.arange(len(x))
    while len(left):
        far = np.searchsorted(x[left], x[left] + 2 * size, "right")
        best = int(np.argmax(far - np.arange(len(left))))
        out.append(left[best : far[best]].tolist())
        left = np.delete(left, slice(best, far[best]))
    chains: list[list[int]] = []
    at, to = x.tolist(), y.tolist()
    for i in range(len(at)):
        chains = [c for c in chains if at[i] - at[c[0]] <= 2 * size]
        drift = [(abs((at[i] - to[i]) - (at[c[-1]] - to[c[-1]])), -c[-1], c) for c in chains if at[c[-1]] < at[i] and to[c[-1]] < to[i]]
        off, _, chain = min(drift, default=(WINDOW + 1, 0, []))
        if off <= WINDOW:
            chain.append(i)
        else:
            chains.append([i])
            out.append(chains[-1])
    return out


def _fan(mine: list[int], theirs: list[int]) -> list[int]:
    """For each slot, how many values its value is paired with, on the side where that is more."""
    forth: dict[int, set[int]] = {}
    back: dict[int, set[int]] = {}
    for p, q in zip(mine, theirs, strict=True):
        forth.setdefault(q, set()).add(p)
        back.setdefault(p, set()).add(q)
    return [max(len(forth[q]), len(back[p])) for p, q in zip(mine, theirs, strict=True)]


def shards(benchmark: DataFrame) -> Iterator[Benchmark]:
    """The benchmark in pieces of a checked size; rows without an id or text are left out."""
    items = benchmark.where("item_id is not null and length(text) > 0").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // SHARD_CHARS)
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).orderBy("item_id", "text").collect()
        yield Benchmark([r["item_id"] for r in rows], [r["text"] for r in rows])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Passages of the benchmark in documents: doc_id, item_id, coverage, window_hits, slots, changed_slots, doc_start, doc_end.

    One row for a row of docs and an item that it contains, with the bounds in characters of the best passage: the best
    covered, then that with more hits, with fewer changed slots, and the first. Items with the same template and the same
    pattern of repeated values can't be told apart by a passage: of these the one with fewest changed slots, then the
    least id, has the row. Texts that share an item's id are all
    looked for. Clean documents have no row; nor have rows without an id and null or empty texts. A text of any length
    is searched whole. An item of one word says nothing and is never found. Repeated rows give repeated rows; empty
    tables on either side give none; further columns are ignored.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    for shard in shards(benchmark):
        shared = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in K.chunks(batches):
                own = shared.value
                rows = own.contaminated(texts)
                if rows:
                    doc, item, *rest = zip(*rows, strict=True)
                    cols = dict(zip(("coverage", "window_hits", "slots", "changed_slots", "doc_start", "doc_end"), rest, strict=True))
                    cols = {c: pa.array(v, pa.float64() if c == "coverage" else pa.int32()) for c, v in cols.items()}
                    yield K.batch_of(doc_id=batch.column("doc_id").take(pa.array(doc)), item_id=np.array(item, np.int64), **cols)

        out = out.union(documents(docs).mapInArrow(run, SCHEMA))
    return out.withColumn("coverage", F.round("coverage", 6))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a passage of any benchmark item go. The text never leaves the one pass over it.

    Rows without an id are searched like all others; null and empty texts stay; repeated rows stay or go together; all
    columns stay as they are; with an empty benchmark every row stays.
    """
    fields = docs.schema
    for shard in shards(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        shared = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in K.chunks(batches):
                clean = np.ones(len(texts), bool)
                clean[[r[0] for r in shared.value.contaminated(texts)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, fields)
    return docs
