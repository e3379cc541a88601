"""LM scoring with Brown class-based bigrams.

The corpus is counted in full: words, then every bigram of words of the vocabulary. Exchange clustering of the most
frequent words (each in turn moves to the class that raises the likelihood of the class bigram model most) seeds the
classes. All other words then join, and all words go on to move, in sweeps over the table of bigrams: half of the words
at a time, each to the class that fits the classes of all its neighbours best, until hardly any moves. With classes
fixed, class bigrams are counted over the whole corpus, and a document's perplexity follows from smoothed class
transitions and word emissions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .shared import documents, written

#: Words that seed the classes, classes, sweeps over these; times that a word of the vocabulary is seen at least, and
#: words that the vocabulary may hold (the least count is raised until it fits). Words below share the unknown class.
HEAD, CLASSES, SWEEPS, MIN_COUNT, MAX_VOCAB, DISCOUNT = 1000, 48, 4, 5, 4_000_000, 0.75
#: Sweeps over all words at most, and the share of words of a sweep that has to move for another one.
ALL_SWEEPS, STILL = 6, 0.01
FLUSH = 1 << 20
SCHEMA = "doc_id long, n_tokens long, n_unknown long, log_prob double, perplexity double"


def _counted(batches: Iterator[pa.RecordBatch], keys: Callable[[K.Words], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and their counts, added up over chunks as long as they are few."""
    held_k, held_n, size = [], [], 0
    for _, texts in K.chunks(batches):
        k, n = np.unique(keys(K.Words(texts)), return_counts=True)
        held_k.append(k)
        held_n.append(n)
        size += len(k)
        if size > 2 * FLUSH:
            k, n = _merge(held_k, held_n)
            held_k, held_n, size = [k], [n], len(k)
            if size > FLUSH:
                yield k, n
                held_k, held_n, size = [], [], 0
    if size:
        yield _merge(held_k, held_n)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray], repeated: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts; a single list is distinct already unless said otherwise."""
    if len(keys) == 1 and not repeated:
        return keys[0], counts[0]
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n, first)


def _pairs(w: K.Words) -> np.ndarray:
    """Places of words that have a word before them in their text."""
    return np.flatnonzero(w.doc[1:] == w.doc[:-1]) + 1


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n): every distinct word of the corpus by its hash, and how often it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, n in _counted(batches, lambda w: w.h):
            yield K.batch_of(h=K.signed(k), n=n)

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def exchange(n: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of words from their bigram counts n, words being in order of frequency.

    Words start dealt out in turn, and are visited in order; a word moves only if the likelihood rises, to the first of
    the best classes. Class bigram counts are kept up to date; f(x) = x log x.
    """
    v = len(n)
    classes = min(classes, v)
    cls = np.arange(v) % classes
    n = n.astype(float)
    onehot = np.zeros((v, classes))
    onehot[np.arange(v), cls] = 1
    big = onehot.T @ n @ onehot
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    everyone = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(v):
            a = cls[w]
            out, into, own = np.bincount(cls, n[w], classes), np.bincount(cls, n[:, w], classes), n[w, w]
            out[a] -= own
            into[a] -= own
            if out.sum() + into.sum() + own == 0:
                continue
            big[a] -= out
            big[:, a] -= into
            big[a, a] -= own
            row, col = big.sum(1) + into, big.sum(0) + out  # what the others keep, wherever w goes
            # Gain of putting w into each class, in cells of its row and column; the shared cell is put right after.
            gain = (f(big + out) - f(big)).sum(1) + (f(big + into[:, None]) - f(big)).sum(0)
            d = big[everyone, everyone]
            gain += f(d + out + into + own) - f(d + out) - f(d + into) + f(d)
            gain -= f(row + out.sum() + own) - f(row) + f(col + into.sum() + own) - f(col)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            moved += b != a
            cls[w] = b
            big[b] += out
            big[:, b] += into
            big[b, b] += own
        if not moved:
            break
    return cls


class Model:
    """Classes and log emissions of the words of the vocabulary, and log transitions; class CLASSES is unknown, CLASSES + 1 a text's start."""

    def __init__(self, lookup: K.Lookup | None, cls: np.ndarray) -> None:
        self.lookup, self.cls = lookup, cls
        self.emission: np.ndarray = np.zeros(0)
        self.transition: np.ndarray = np.zeros((0, 0))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lookup": None}  # broadcast once, by itself

    def ids(self, w: K.Words) -> np.ndarray:
        return self.lookup(w.h) if self.lookup is not None else np.full(len(w.h), -1)

    def known(self, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words (-1 unknown), and of every text its words and its unknown words."""
        ids = self.ids(w)
        return ids, np.diff(w.ptr), K.reduce_by(np.add, (ids < 0).astype(np.int64), w.ptr, 0)

    def classes(self, w: K.Words, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words (-1 unknown), their classes, and the classes before them."""
        ids = self.ids(w) if ids is None else ids
        c = np.append(self.cls, CLASSES)[ids]
        before = np.full(len(c), CLASSES + 1)
        at = _pairs(w)
        before[at] = c[at - 1]
        return ids, c, before

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, unknown words and log probability of every text."""
        w = K.Words(texts)
        ids, n, unknown = self.known(w)
        _, c, before = self.classes(w, ids)
        lp = self.transition[before, c] + self.emission[ids]
        return n, unknown, K.reduce_by(np.add, lp, w.ptr, 0.0)


def smoothed(n: np.ndarray) -> np.ndarray:
    """Log transition probabilities by absolute discounting, backed off to how often each class follows any.

    A class that was never seen to follow has probability 0 everywhere, and can't be met while scoring the corpus.
    """
    follow = n.sum(0)
    base = follow / max(1, follow.sum())
    total = n.sum(1, keepdims=True)
    kinds = (n > 0).sum(1, keepdims=True)
    p = (np.maximum(n - DISCOUNT, 0) + np.minimum(DISCOUNT, 1) * kinds * base) / np.maximum(total, 1)
    p = np.where(total > 0, p, base)
    return np.log(np.maximum(p, 1e-300))


#: Layout of packed bigrams: a row for each part, which has the words whose number leaves its own as a remainder. A word is
#: known in its part by the quotient. `after` has (n, word, word after it), `before` (n, word, word before it), each packed
#: column by column; a pair of words may occur in several entries, which count together.
PACKED = "part int, n_before long, before binary, n_after long, after binary"
#: Words of text that a part has bigrams of: up to this many parts the first, beyond that up to the second.
PART_WORDS, FEW_PARTS, MOST_WORDS = 1 << 20, 1024, 1 << 23
#: Entries of a side of a part from which those of the same pair are added up.
MERGED = 1 << 22


def parts_of(words: int) -> int:
    """Parts for the bigrams of so many words of text: they grow with the text, so what a task holds doesn't."""
    return max(1, min(FEW_PARTS, words // PART_WORDS), words // MOST_WORDS)


def _pack(n: np.ndarray, word: np.ndarray, other: np.ndarray) -> bytes:
    return pa.compress(n.astype(np.int64).tobytes() + word.astype(np.int32).tobytes() + other.astype(np.int32).tobytes(), codec="zstd", asbytes=True)


def _unpack(size: int, packed: bytes | memoryview | pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    raw = pa.decompress(packed, decompressed_size=16 * size, codec="zstd")
    return np.frombuffer(raw, np.int64, size), np.frombuffer(raw, np.int32, size, 8 * size), np.frombuffer(raw, np.int32, size, 12 * size)


def _parted(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED for bigrams (a, b, n): word b follows word a n times."""
    for a, b, n in found:
        sides = []
        for word, other in ((b, a), (a, b)):
            part = word % parts
            order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
            ends = np.cumsum(np.bincount(part, minlength=parts))
            cut = [order[s:e] for s, e in zip(ends - np.diff(ends, prepend=0), ends)]
            sides.append((np.diff(ends, prepend=0), [_pack(n[at], word[at] // parts, other[at]) for at in cut]))
        (n_before, before), (n_after, after) = sides
        yield K.batch_of(part=np.arange(parts, dtype=np.int32), n_before=n_before, before=pa.array(before, pa.binary()), n_after=n_after, after=pa.array(after, pa.binary()))


def _joined(frames: list[tuple[int, bytes]], merge: bool = False) -> tuple[int, bytes]:
    """Entries and bytes of several packed runs as one; merge: with each pair of words once."""
    n, word, other = (np.concatenate(c) for c in zip(*(_unpack(*f) for f in frames)))
    if merge:
        k, n = _merge([(word.astype(np.int64) << 32) | other], [n], True)
        word, other = k >> 32, k & 0xFFFFFFFF
    return len(n), _pack(n, word, other)


def _gathered(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of PACKED with all of a part in one. The pairs of a frequent word are added up as they come, so no part outgrows what is distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for part, *sides in zip(*(batch.column(c).to_pylist() for c in ("part", "n_before", "before", "n_after", "after"))):
                for frames, size, packed in zip(held.setdefault(part, ([], [])), sides[::2], sides[1::2]):
                    frames.append((size, packed))
                    if sum(f[0] for f in frames[1:]) > max(MERGED, frames[0][0]):
                        frames[:] = [_joined(frames, True)]
        for part in sorted(held):
            (n_before, before), (n_after, after) = map(_joined, held.pop(part))
            yield K.batch_of(part=np.array([part], np.int32), n_before=np.array([n_before]), before=pa.array([before], pa.binary()), n_after=np.array([n_after]), after=pa.array([after], pa.binary()))

    return rows.repartition(parts, "part").mapInArrow(run, PACKED)


def bigrams(texts: DataFrame, lookup: Broadcast, parts: int) -> DataFrame:
    """How often every word of the vocabulary follows every other, over the whole corpus, as PACKED."""

    def keys(w: K.Words) -> np.ndarray:
        ids, at = lookup.value(w.h), _pairs(w)
        a, b = ids[at - 1], ids[at]
        both = (a >= 0) & (b >= 0)
        return (a[both] << 32) | b[both]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parted(((k >> 32, k & 0xFFFFFFFF, n) for k, n in _counted(batches, keys)), parts)

    return _gathered(texts.mapInArrow(run, PACKED), parts)


def packed(pairs: DataFrame, parts: int) -> DataFrame:
    """Bigrams (a, b, n) as PACKED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parted((tuple(b.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n")) for b in batches), parts)

    return _gathered(pairs.select("a", "b", "n").mapInArrow(run, PACKED), parts)


def _sides(batches: Iterator[pa.RecordBatch], *sides: str) -> Iterator[tuple]:
    """The number of every part, and (n, word, other) of each of these sides of it."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("part")[i].as_py(), *(_unpack(batch.column(f"n_{s}")[i].as_py(), batch.column(s)[i].as_buffer()) for s in sides)


def head_pairs(near: DataFrame, parts: int, head: int) -> np.ndarray:
    """Counts of the bigrams of the words below `head`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (n, word, other) in _sides(batches, "after"):
            a = word.astype(np.int64) * parts + part
            own = np.flatnonzero((a < head) & (other < head))
            k, m = _merge([a[own] * head + other[own]], [n[own]], len(own) > 0)
            yield K.batch_of(k=k, n=m)

    found = near.select("part", "n_after", "after").mapInArrow(run, "k long, n long").toArrow()  # at most HEAD * HEAD rows
    dense = np.zeros(head * head)
    dense[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return dense.reshape(head, head)


def class_pairs(near: DataFrame, parts: int, classes: Broadcast) -> np.ndarray:
    """How often each class comes before each class (rows before columns). Words of class -1 don't count yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, total = classes.value, np.zeros(CLASSES * CLASSES)
        for part, (n, word, other) in _sides(batches, "after"):
            before, after = cls[part::parts][word], cls[other]
            both = np.flatnonzero((before >= 0) & (after >= 0))
            total += np.bincount(before[both].astype(np.int64) * CLASSES + after[both], n[both], CLASSES * CLASSES)
        at = np.flatnonzero(total)
        yield K.batch_of(k=at, n=total[at].astype(np.int64))

    big = np.zeros(CLASSES * CLASSES)
    for r in near.select("part", "n_after", "after").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most CLASSES ** 2 rows
        big[r["k"]] = r["n"]
    return big.reshape(CLASSES, CLASSES)


def _around(batches: Iterator[pa.RecordBatch], parts: int, cls: np.ndarray, classes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of every part that have neighbours, and how often each has one of each class: before it, and `classes` more after it."""
    wide = 2 * classes
    for part, *sides in _sides(batches, "before", "after"):
        words = np.arange(part, len(cls), parts)
        m = np.zeros(len(words) * wide)
        for k, (n, word, other) in enumerate(sides):
            c = cls[other]
            some = np.flatnonzero(c >= 0)
            m += np.bincount(word[some].astype(np.int64) * wide + (c[some] + k * classes), n[some], len(m))
        m = m.reshape(-1, wide)
        met = m.any(1)
        yield words[met], m[met]


def contexts(pairs: DataFrame, cls: np.ndarray, parts: int = 1) -> DataFrame:
    """(word, context, n) of bigrams (a, b, n): how often a word has a neighbour of each class, the class itself before it and CLASSES more after it.

    Rows of word -1 have how often class context // CLASSES comes before class context % CLASSES. Words of class -1 are
    no neighbours yet. The sweeps use the same counts without making rows of them.
    """
    spark = pairs.sparkSession
    near, shared = packed(pairs, parts), spark.sparkContext.broadcast(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, m in _around(batches, parts, shared.value, CLASSES):
            w, c = np.nonzero(m)
            yield K.batch_of(word=words[w].astype(np.int32), context=c.astype(np.int32), n=m[w, c].astype(np.int64))

    big = class_pairs(near, parts, shared).ravel()
    total = spark.createDataFrame([(-1, int(k), int(big[k])) for k in np.flatnonzero(big)], "word int, context int, n long")
    return near.mapInArrow(run, "word int, context int, n long").union(total)


def best_classes(near: DataFrame, parts: int, classes: Broadcast, gain: np.ndarray) -> pa.Table:
    """(word, cls): of every word with neighbours the class that fits them best. gain: by context (rows) and class."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, m in _around(batches, parts, classes.value, CLASSES):
            yield K.batch_of(word=words.astype(np.int32), cls=np.argmax(np.round(m @ gain, 6), 1).astype(np.int16))

    return near.mapInArrow(choose, "word int, cls short").toArrow()  # at most MAX_VOCAB rows of six bytes


def swept(near: DataFrame, parts: int, cls: np.ndarray) -> np.ndarray:
    """Classes of all words, from those of the head (-1 for the others), by sweeps over all bigrams (as PACKED, written).

    The first sweep gives every other word its class; each one after that moves either the words of even or those of odd
    number, so that neighbours don't change places for ever. A word whose neighbours are all unknown stays in class 0.
    Nothing but a row for each pair of classes, and the classes chosen, leaves the tasks.
    """
    cls = cls.astype(np.int16)
    begun = cls >= 0
    for sweep in range(ALL_SWEEPS):
        classes = near.sparkSession.sparkContext.broadcast(cls)
        big = class_pairs(near, parts, classes) + 0.5
        gain = np.log(big / (big.sum(0) * big.sum(1)[:, None]))
        gain = np.vstack([gain, gain.T])  # rows: contexts left and right; columns: the class that the word would join
        found = best_classes(near, parts, classes, gain)
        classes.unpersist()
        words, new = found.column("word").to_numpy(), found.column("cls").to_numpy()
        own = ~begun[words] if sweep == 0 else words % 2 == sweep % 2
        words, new = words[own], new[own]
        moved = int((cls[words] != new).sum())
        cls = cls.copy()
        cls[words] = new
        if sweep == 0:
            cls[cls < 0] = 0
        elif moved <= STILL * max(1, len(words)):
            break
    return cls


def settled(pairs: DataFrame, cls: np.ndarray, parts: int = 1) -> np.ndarray:
    """`swept` over bigrams (a, b, n)."""
    return swept(written(packed(pairs, parts), "lm-bigrams"), parts, cls)


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int, Broadcast]:
    """Hashes and counts of the words of the vocabulary in order of frequency, how many rarer words there are, and the lookup, which is broadcast once and used by every pass."""
    counts = written(word_counts(docs), "lm-words")
    sizes = sorted((r["n"], r["types"]) for r in counts.where(F.col("n") >= MIN_COUNT).groupBy("n").agg(F.count("*").alias("types")).collect())
    least, room = (sizes[-1][0] + 1 if sizes else MIN_COUNT), MAX_VOCAB
    for n, types in reversed(sizes):
        room -= types
        if room < 0:
            break
        least = n
    if room >= 0:
        least = MIN_COUNT
    rare = counts.where(F.col("n") < least).agg(F.count("*")).first()[0]
    known = counts.where(F.col("n") >= least).toArrow()  # at most MAX_VOCAB rows
    h, n = known.column("h").to_numpy(), known.column("n").to_numpy()
    order = np.lexsort((h, -n))
    h, n = h[order].view(np.uint64), n[order]
    return h, n, rare, docs.sparkSession.sparkContext.broadcast(K.Lookup(h) if len(h) else None)


def fit(docs: DataFrame) -> tuple[Model, Broadcast]:
    """The model without its lookup, and the lookup."""
    spark = docs.sparkSession
    texts = docs.select("text")
    h, n, rare, lookup = vocabulary(docs)
    head = min(HEAD, len(h))
    cls = np.zeros(len(h), np.int16)
    if head:
        parts = parts_of(int(n.sum()))
        near = written(bigrams(texts, lookup, parts), "lm-bigrams")
        cls[head:] = -1
        cls[:head] = exchange(head_pairs(near, parts, head), CLASSES)
        cls = swept(near, parts, cls)
    model = Model(None, cls)
    shared = spark.sparkContext.broadcast(model)

    def class_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + 2) ** 2, np.int64)
        own = shared.value
        own.lookup = lookup.value
        for _, part in K.chunks(batches):
            _, c, before = own.classes(K.Words(part))
            total += np.bincount(before * (CLASSES + 2) + c, minlength=len(total))
        at = np.flatnonzero(total)
        yield K.batch_of(k=at, n=total[at])

    table = np.zeros((CLASSES + 2) ** 2)
    for r in texts.mapInArrow(class_bigrams, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        table[r["k"]] = r["n"]
    model.transition = smoothed(table.reshape(CLASSES + 2, -1))
    mass = np.bincount(cls, n, CLASSES)
    model.emission = np.append(np.log(n / mass[cls]), -np.log(max(1, rare)))
    return model, lookup


def perplexity(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_unknown, log_prob (natural) and perplexity of every row with an id, under the model of all rows.

    Counts are taken over every row, also those without an id. A null, empty or wordless text has no tokens, log_prob 0
    and a null perplexity. Repeated rows count, and are scored, as often as they stand there; an empty table gives no
    rows; further columns are ignored. A text of any length is scored whole. Equally good classes are told apart by their
    number, equally frequent words by their hash.
    """
    model, lookup = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.lookup = lookup.value
        for batch, texts in K.chunks(batches):
            n, unknown, lp = own.score(texts)
            ppl = np.exp(-lp / np.maximum(n, 1))
            yield K.batch_of(doc_id=batch.column("doc_id"), n_tokens=n, n_unknown=unknown, log_prob=np.round(lp, 6), perplexity=pa.array(np.round(ppl, 6), mask=n == 0))

    return documents(docs).mapInArrow(run, SCHEMA)


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and n_unknown as in `perplexity`. They follow from the vocabulary of all rows alone, so no classes are fitted."""
    *_, lookup = vocabulary(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(lookup.value, np.zeros(0, np.int16))
        for batch, texts in K.chunks(batches):
            n, unknown = own.known(K.Words(texts))[1:]
            yield K.batch_of(doc_id=batch.column("doc_id"), n_tokens=n, n_unknown=unknown)

    return documents(docs).mapInArrow(run, ", ".join(SCHEMA.split(", ")[:3]))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity(spark.read.parquet(f"{sf_dir}/documents.parquet"))
