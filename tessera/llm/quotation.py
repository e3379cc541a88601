"""Chat formatting by quotation linking.

Messages are cut into blocks of equal quote level (the number of leading ">" marks). A block's words are hashed as a
whole, paragraph by paragraph and line by line, so that a quotation is found whether it repeats all of a message or a
part. Quoted passages of every level are joined by hash to the first message that holds the passage unquoted, in the same
conversation if there is one; of those that can be traced the shallowest level, and there the quotation with most words,
decides which message is answered. Messages without a quotation that can be traced answer the turn before them. Threads
are ordered so that every message comes after the one it answers, and carry no quotations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .shared import in_groups, written

#: Words that a quoted line needs to be looked up by itself, and any passage to be looked up in other conversations; in their own, whole blocks and paragraphs are looked up at any length.
LINE_WORDS = 3
_MARKS = re.compile(r"^(?:[ \t]*>)+[ \t]?")
#: What introduces a quotation, such as "On Monday Ann wrote:".
_LEAD = re.compile(r"^.{0,200}\b(?:wrote|writes|said|schrieb|écrit|escribió)\s*:\s*$", re.IGNORECASE)
PARSED = "conv_id long, turn long, role string, body string, n_quotes int, passages array<struct<h:long,words:int,level:int,whole:boolean>>"


def blocks(text: str) -> list[tuple[int, str]]:
    """(quote level, text without marks) of every maximal run of lines of one level."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level = m.group().count(">") if m else 0
        if not out or out[-1][0] != level:
            out.append((level, []))
        out[-1][1].append(line[m.end() :] if m else line)
    return [(level, "\n".join(lines)) for level, lines in out]


def unquoted(parts: list[tuple[int, str]]) -> list[str]:
    """Level 0 blocks without the line that introduces the quotation after them."""
    out = []
    for i, (level, body) in enumerate(parts):
        if level:
            continue
        if i + 1 < len(parts):
            lines = body.rstrip().split("\n")
            if _LEAD.match(lines[-1]):
                body = "\n".join(lines[:-1])
        if body.strip():
            out.append(body.strip())
    return out


def pieces(body: str) -> dict[str, bool]:
    """The text, its paragraphs and its lines, each once, and whether it is more than a line of something longer."""
    whole = dict.fromkeys((x.strip() for x in [body, *re.split(r"\n\s*\n", body)]), True)
    return {x: w for x, w in (dict.fromkeys((x.strip() for x in body.split("\n")), False) | whole).items() if x}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in K.chunks(batches):
        bodies, quotes, owner, level, flat, whole = [], [], [], [], [], []
        for i, text in enumerate(texts):
            parts = blocks(text) if ">" in text else [(0, text)]
            own = unquoted(parts)
            bodies.append("\n\n".join(own))
            quotes.append(sum(lv > 0 for lv, _ in parts))
            todo = [(0, x) for x in ([bodies[-1]] if bodies[-1] else []) + own] + [(lv, b) for lv, b in parts if lv]
            found: dict[tuple[int, str], bool] = {}
            for lv, b in todo:
                for x, entire in pieces(b).items():
                    found[lv, x] = found.get((lv, x), False) or entire
            for (lv, x), entire in found.items():
                owner.append(i)
                level.append(lv)
                flat.append(x)
                whole.append(entire)
        w = K.Words(flat)
        words = np.diff(w.ptr)
        h = K.spans_hash(w.h, w.ptr[:-1], w.ptr[1:])
        keep = words > 0
        owner, level = np.array(owner, np.int64)[keep], np.array(level, np.int32)[keep]
        offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        passages = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(K.signed(h[keep])), pa.array(words[keep].astype(np.int32)), pa.array(level), pa.array(np.array(whole, bool)[keep])], ["h", "words", "level", "whole"]))
        yield K.batch_of(conv_id=batch.column("conv_id"), turn=batch.column("turn"), role=batch.column("role"), body=pa.array(bodies, pa.string()), n_quotes=pa.array(quotes, pa.int32()), passages=passages)


def parsed(messages: DataFrame) -> DataFrame:
    """One row a message: its own text, how many quoted blocks it had, and hashes of its passages by quote level."""
    named = messages.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("m"))
    once = named.groupBy("conv_id", "turn").agg(F.min("m").alias("m")).select("conv_id", "turn", "m.role", "m.text")
    return once.mapInArrow(_parse, PARSED)


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_conv, parent_turn): the message quoted at the shallowest level, there with most words, of those that have an original."""
    passages = messages.select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.*")
    long = F.col("words") >= LINE_WORDS
    quoted = passages.where((F.col("level") > 0) & (long | F.col("whole"))).groupBy("conv_id", "turn", "h", "words").agg(F.min("level").alias("level"))
    own = passages.where("level = 0")
    here = own.groupBy(F.col("conv_id").alias("c"), F.col("h").alias("g")).agg(F.min("turn").alias("t"))
    # Of all conversations the first that holds the passage: one row a hash, however often it stands there.
    anywhere = here.groupBy(F.col("g").alias("k")).agg(F.min(F.struct("c", "t")).alias("first"))
    near = quoted.join(here, (F.col("conv_id") == F.col("c")) & (F.col("h") == F.col("g")) & (F.col("t") < F.col("turn")), "left")
    far = near.join(anywhere, F.col("t").isNull() & long & (F.col("h") == F.col("k")) & (F.col("first.c") < F.col("conv_id")), "left")
    found = far.select("conv_id", "turn", "words", "level", F.coalesce("t", "first.t").alias("parent_turn"), F.when(F.col("t").isNotNull(), F.col("conv_id")).otherwise(F.col("first.c")).alias("parent_conv")).where("parent_turn is not null")
    best = F.min_by(F.struct("parent_conv", "parent_turn"), F.struct("level", -F.col("words"), F.col("parent_conv") != F.col("conv_id"), "parent_conv", -F.col("parent_turn")))
    return found.groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", "b.*")


def conversations(messages: DataFrame) -> DataFrame:
    """Threads in reply order without quotations: thread_conv, thread_turn (the first message), position, depth, conv_id, turn, role, text, parent_conv, parent_turn, link, n_quotes.

    link is "quote", "turn" (the turn before, as nothing quoted was found) or "start". An answer's parent always has a
    smaller (conv_id, turn), so threads have no cycles. Of equally good originals the first conversation's, and there the
    latest turn, is taken. Rows without conv_id or turn are left out; rows that repeat both count as one, the least by
    role and text; a null or empty text, and one of nothing but quotations, gives an empty text that still holds its
    place; a text of any length is parsed whole; an empty table gives no rows; further columns are ignored. Turns lie
    within 62 bits.
    """
    rows = written(parsed(messages), "quote-parsed")
    found = rows.select("conv_id", "turn").join(links(rows), ["conv_id", "turn"], "left")
    quote = F.col("parent_turn").isNotNull().cast("long")
    found = written(found.withColumns({"quote": quote, "mark": F.col("turn") * 2 + quote}), "quote-links")
    # A message that answers the turn before it belongs to the run of that turn. Runs begin where something is quoted or a conversation starts.
    runs = in_groups(found.select("conv_id", "turn", "quote", "mark"), ["conv_id"], ["turn"], "mark", "quote", "quote-runs")
    runs = written(runs.select("conv_id", "turn", F.shiftright("prev", 1).alias("before"), F.shiftright("head", 1).alias("head"), (F.col("head").bitwiseAND(F.lit(1)) == 1).alias("quoting"), "since"), "quote-turns")
    # Pointer doubling over the runs that begin with a quotation: after each round a run knows an ancestor twice as far up, or its thread's start.
    target = runs.select(F.col("conv_id").alias("parent_conv"), F.col("turn").alias("parent_turn"), F.col("head").alias("up_turn"), F.col("quoting").alias("more"), (F.col("since") + 1).alias("depth"))
    columns = ["conv_id", "turn", "up_conv", "up_turn", "depth", "more"]
    up = found.where("quote = 1").select("conv_id", "turn", "parent_conv", "parent_turn").join(target, ["parent_conv", "parent_turn"]).withColumnRenamed("parent_conv", "up_conv").select(*columns)
    up = written(up, "quote-up")
    done, active = up.where("not more"), up.where("more")
    while not active.isEmpty():
        on = done.union(active).select(F.col("conv_id").alias("up_conv"), F.col("turn").alias("up_turn"), F.col("up_conv").alias("far_conv"), F.col("up_turn").alias("far_turn"), F.col("depth").alias("further"), F.col("more").alias("still"))
        up = active.join(on, ["up_conv", "up_turn"]).select("conv_id", "turn", F.col("far_conv").alias("up_conv"), F.col("far_turn").alias("up_turn"), (F.col("depth") + F.col("further")).alias("depth"), F.col("still").alias("more"))
        up = written(up, "quote-up")
        done, active = done.union(up.where("not more")), up.where("more")
    start = done.select(F.col("conv_id").alias("start_conv"), F.col("turn").alias("start_turn"), F.col("up_conv").alias("thread_conv"), F.col("up_turn").alias("thread_turn"), F.col("depth").alias("above"))
    led = runs.join(start, F.col("quoting") & (F.col("conv_id") == F.col("start_conv")) & (F.col("head") == F.col("start_turn")), "left")
    threads = led.select("conv_id", "turn", F.coalesce("thread_conv", "conv_id").alias("thread_conv"), F.coalesce("thread_turn", "head").alias("thread_turn"), (F.col("since") + F.coalesce("above", F.lit(0))).alias("depth"))
    placed = in_groups(written(threads, "quote-threads"), ["thread_conv", "thread_turn"], ["depth", "conv_id", "turn"], "turn", name="quote-placed").withColumnRenamed("nth", "position")
    links_ = found.select("conv_id", "turn", "parent_conv", "parent_turn", "quote").join(runs.select("conv_id", "turn", "before"), ["conv_id", "turn"])
    quoted, turned = F.col("quote") == 1, F.col("before").isNotNull()
    tree = links_.select("conv_id", "turn", F.when(quoted, F.col("parent_conv")).when(turned, F.col("conv_id")).alias("parent_conv"), F.when(quoted, F.col("parent_turn")).otherwise(F.col("before")).alias("parent_turn"), F.when(quoted, "quote").when(turned, "turn").otherwise("start").alias("link"))
    full = rows.join(tree, ["conv_id", "turn"]).join(placed, ["conv_id", "turn"])
    return full.select("thread_conv", "thread_turn", "position", "depth", "conv_id", "turn", "role", F.col("body").alias("text"), "parent_conv", "parent_turn", "link", "n_quotes")


def op9_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
