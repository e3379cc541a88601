"""Language ID by cross-parsing entropy.

For every language a suffix automaton is built from labelled text. A document is parsed against it greedily: a phrase
is the longest piece from the current place that occurs in the labelled text, and the next phrase begins where it
breaks off. Divided by the phrases expected of text in that language, the language that needs fewest phrases wins. A
document whose best count is still far above what the language's own text needs is rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernel as K
from .shared import documents

#: Characters of labelled text per language from which an automaton is built, rows per language that may supply them;
#: letters of a language that have symbols of their own, and symbols that its other letters share by their code point.
#: These bound the fit, never the documents that are parsed.
TRAIN_CHARS, TRAIN_ROWS, LETTERS, SHARED = 8_000, 200, 96, 30
#: Symbols of labelled text that a label needs for an automaton. From fewer, almost any two letters break a phrase and nothing could be rejected.
LEAST_CHARS = 600
#: A document is rejected if its phrases exceed this multiple of what its language's own text needs, plus a slack that matters only for short texts.
MAX_RATIO, SLACK = 1.8, 15.0
#: Characters of whole documents that are parsed side by side.
TOGETHER = 4 << 20
SCHEMA = "doc_id long, language string, phrases int, n_letters int, score double, margin double, keep boolean"


class Alphabet:
    """Letters of all languages as numbers (0 for a run of anything but letters, 1 for a letter of none), and for each language the symbols that its automaton has for them: 0, 1 for a letter that it lacks, 2 and up."""

    def __init__(self, letters: dict[str, Counter[int]]) -> None:
        every = sorted(set().union(*letters.values())) if letters else []
        self.of = np.ones(len(K.lower_table()), np.uint16)
        self.of[0] = 0
        self.of[every] = np.arange(2, len(every) + 2)
        self.size = LETTERS + SHARED + 2
        self.local: dict[str, np.ndarray] = {}
        for lang, count in letters.items():
            own = np.ones(len(every) + 2, np.uint8)
            own[0] = 0
            ranked = sorted(count, key=lambda c: (-count[c], c))
            for i, c in enumerate(ranked):
                own[self.of[c]] = 2 + (i if i < LETTERS else LETTERS + c % SHARED)
            self.local[lang] = own

    def symbols(self, texts: list[str]) -> list[np.ndarray]:
        """Texts as numbers of letters."""
        cp, at = K.codes(texts)
        table = self.of[K.lower_table()]
        table[48:58] = 0
        sym = table[cp]
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
        keep[at[:-1]] &= sym[at[:-1]] != 0
        keep[at[1:] - 1] = False
        ends = np.concatenate([[0], np.cumsum(keep, dtype=np.int32)])[at]
        data = sym[keep]
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def suffix_states(data: bytes, size: int) -> list[list[int]]:
    """Next states by symbol (-1 where there is none) of data's suffix automaton, the start state first."""
    nxt, link, length = [[-1] * size], [-1], [0]
    last = 0
    for c in data:
        cur = len(nxt)
        nxt.append([-1] * size)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and nxt[p][c] < 0:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p][c] == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """The automata of all languages as one table, over which many texts step side by side.

    A row of the table is a state, and an entry where its next state's row begins, with BROKE set where a phrase breaks
    off and the next begins. A state that follows nothing, at the end of each automaton, is where texts start.
    """

    BROKE, FEW = 1 << 30, 24

    def __init__(self, texts: dict[str, bytes], local: dict[str, np.ndarray], size: int) -> None:
        self.languages, tables, base, self.start = sorted(texts), [], 0, []
        self.local = np.stack([local[lang] for lang in self.languages]).astype(np.int32) if texts else np.zeros((0, 2), np.int32)
        for lang in self.languages:
            nxt = np.array(suffix_states(texts[lang], size), np.int64)
            dead = len(nxt)
            nxt = np.vstack([nxt, np.full((1, size), -1)])
            broke = nxt < 0
            target = np.where(broke, np.where(nxt[0] >= 0, nxt[0], dead), nxt)
            tables.append(((target * size + base) | np.where(broke, self.BROKE, 0)).astype(np.int32).ravel())
            self.start.append(base + dead * size)
            base += nxt.size
        self.table = np.concatenate([*tables, np.zeros(0, np.int32)])

    def count(self, data: list[np.ndarray]) -> np.ndarray:
        """Phrases of every text (column) in every language (row)."""
        size = np.array([len(d) for d in data], np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        # Texts stand from long to short, so those that go on are always the first; the last few are followed singly.
        live = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), "right")
        together = int((live >= self.FEW).sum())
        at = np.concatenate([[0], np.cumsum(live[:together])])
        turn = np.empty(at[-1], np.uint16)  # first symbols of all texts, then second symbols, ...
        for i, k in enumerate(order[: int(live[0]) if together else 0]):
            own = data[k][:together]
            turn[at[: len(own)] + i] = own
        n = np.zeros((len(self.start), len(data)), np.int32)
        state = np.repeat(np.array(self.start)[:, None], len(data), 1)
        for a, lo in zip(live[:together].tolist(), at.tolist(), strict=False):
            state, n_ = state[:, :a], n[:, :a]
            v = self.table.take(state + self.local.take(turn[lo : lo + a], 1))
            n_ += v >> 30
            state = v & (self.BROKE - 1)
        table = memoryview(self.table)
        for i in range(int(live[together]) if together < len(live) else 0):
            rest = data[order[i]][together:]
            for j in range(len(self.start)):
                s, k, mask = int(state[j, i]), 0, self.BROKE - 1
                for c in self.local[j].take(rest).tolist():
                    s = table[s + c]
                    if s > mask:
                        k += 1
                        s &= mask
                n[j, i] += k
        out = np.empty_like(n)
        out[:, order] = n
        return out


class Model:
    """Alphabet, and by language the labelled text and phrases per letter of text that the automaton hasn't seen."""

    def __init__(self, alphabet: Alphabet, texts: dict[str, bytes], rates: dict[str, float]) -> None:
        self.alphabet, self.texts, self.rates = alphabet, texts, rates

    def parser(self) -> Parser:
        key = tuple(sorted((lang, text, self.alphabet.local[lang].tobytes()) for lang, text in self.texts.items()))
        return _parser(key, self.alphabet.size)


@lru_cache(2)
def _parser(key: tuple[tuple[str, bytes, bytes], ...], size: int) -> Parser:
    return Parser({k: t for k, t, _ in key}, {k: np.frombuffer(x, np.uint8) for k, _, x in key}, size)


def fit(docs: DataFrame) -> Model:
    """Learn from up to TRAIN_ROWS labelled rows per language, those with the least hash of their id, and of each a stretch of up to TRAIN_CHARS at a place that the hash picks."""
    if "lang" not in docs.columns:
        return train({})
    labelled = docs.where("lang is not null and doc_id is not null and length(text) > 0")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.select("lang", F.col("doc_id").cast("long").alias("doc_id")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= TRAIN_ROWS)
    ids = F.broadcast(chosen.select("lang", F.col("doc_id").alias("chosen_id"), "nth"))  # at most TRAIN_ROWS rows a language
    rows = labelled.select(F.col("lang").alias("doc_lang"), F.col("doc_id").cast("long").alias("id"), "text").join(ids, (F.col("id") == F.col("chosen_id")) & (F.col("doc_lang") == F.col("lang")))
    place = F.pmod(F.xxhash64("id", F.lit(3)), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1).cast("int") + 1
    found = rows.select("lang", "nth", F.substring(F.col("text"), place, F.lit(TRAIN_CHARS)).alias("text")).dropDuplicates(["lang", "nth"]).orderBy("lang", "nth").toLocalIterator()
    pieces: dict[str, list[str]] = {}
    for r in found:
        own = pieces.setdefault(r["lang"], [])
        if sum(map(len, own)) < 2 * TRAIN_CHARS:
            own.append(r["text"])
    return train(pieces)


def train(pieces: dict[str, list[str]]) -> Model:
    """Every language gets an automaton from two thirds of its own text, up to TRAIN_CHARS symbols; text beyond that gives its rate.

    A label with less than LEAST_CHARS symbols has no automaton, so no text is identified as it, and changes nothing for the others.
    """
    letters: dict[str, Counter[int]] = {}
    for lang, own in pieces.items():
        u, n = np.unique(K.lower_table()[K.codes(own)[0]], return_counts=True)
        letters[lang] = Counter({c: k for c, k in zip(u.tolist(), n.tolist(), strict=True) if c and not 48 <= c <= 57})
    alphabet = Alphabet(letters)
    as_symbols = lambda lang, own: (alphabet.local[lang][d].tobytes() for d in alphabet.symbols(own))
    data = {lang: [d for d in dict.fromkeys(as_symbols(lang, own)) if d] for lang, own in pieces.items()}  # copies would set the rate to nothing
    data = {lang: own for lang, own in data.items() if sum(map(len, own)) >= LEAST_CHARS}
    size = {lang: min(TRAIN_CHARS, sum(map(len, own)) * 2 // 3) for lang, own in data.items()}
    texts = {lang: b"\0".join(own)[: size[lang]] for lang, own in data.items()}
    model = Model(alphabet, texts, {})
    for lang in sorted(texts):
        # The median over the pieces that were left out, so that a few odd documents don't set the rate.
        rest = b"\0".join(data[lang])[size[lang] : size[lang] + TRAIN_CHARS]
        pieces_ = [rest[i : i + 500] for i in range(0, max(1, len(rest) - 250), 500)]
        seen = Parser({lang: texts[lang]}, {lang: np.arange(alphabet.size, dtype=np.uint8)}, alphabet.size).count([np.frombuffer(d, np.uint8).astype(np.uint16) for d in pieces_])[0]
        model.rates[lang] = float(np.median(seen / np.maximum(1, [len(d) for d in pieces_]))) or 1.0
    return model


def classify(texts: list[str], model: Model) -> list[tuple[str | None, int, int, float, float, bool]]:
    """For each text: language, phrases, letters, score (phrases over those expected), margin to the next language, keep."""
    parser, out = model.parser(), []
    data = model.alphabet.symbols(texts)
    counts = parser.count(data).T.tolist()
    for own, found in zip(data, counts, strict=True):
        letters = int(np.count_nonzero(own))
        if not letters or not found:
            out.append((None, 0, letters, 0.0, 0.0, not found))
            continue
        n = dict(zip(parser.languages, found, strict=True))
        score = {lang: n[lang] / (model.rates[lang] * len(own)) for lang in n}
        ranked = sorted(score, key=lambda x: (score[x], x))
        best = ranked[0]
        expected = model.rates[best] * len(own)
        keep = n[best] <= MAX_RATIO * expected + SLACK
        out.append((best, n[best], letters, score[best], score[ranked[1]] - score[best] if len(ranked) > 1 else 0.0, keep))
    return out


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, language, phrases, n_letters, score, margin and keep of every row with an id.

    A text without letters (null, empty, digits, symbols) has a null language and isn't kept. Ties go to the language
    first in alphabetical order. A text of any length is parsed whole. Repeated rows give repeated rows, an empty table
    none; further columns are ignored. Where no label has enough text, or there is no column lang, nothing can be
    identified: every language is null, and everything is kept.
    """
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TRAIN_CHARS bytes a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in K.chunks(batches, limit=TOGETHER):
            lang, n, letters, score, margin, keep = zip(*classify(texts, shared.value), strict=True)
            yield K.batch_of(doc_id=batch.column("doc_id"), language=pa.array(lang, pa.string()), phrases=pa.array(n, pa.int32()), n_letters=pa.array(letters, pa.int32()), score=pa.array(score, pa.float64()), margin=pa.array(margin, pa.float64()), keep=pa.array(keep, pa.bool_()))

    return documents(docs).mapInArrow(run, SCHEMA).withColumns({c: F.round(c, 6) for c in ("score", "margin")})


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that no language explains go; lang (where there is one) becomes the language found.

    Rows without an id are judged like all others, null and empty texts go, repeated rows stay or go together, all other
    columns stay as they are. Where nothing can be identified, for want of labels, everything stays as it is.
    """
    model = fit(docs)
    if not model.texts:
        return docs
    shared = spark.sparkContext.broadcast(model)
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in K.chunks(batches, limit=TOGETHER):
            found = classify(texts, shared.value)
            at = batch.schema.get_field_index("lang")
            if at >= 0:
                batch = batch.set_column(at, "lang", pa.array([x[0] for x in found], batch.schema.field(at).type))
            yield batch.filter(pa.array([x[5] for x in found]))

    return docs.mapInArrow(run, fields)
