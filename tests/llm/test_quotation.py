import random

from pyspark.sql import functions as F

from tessera.llm import quotation as Q

from .helpers import text

SCHEMA = "conv_id long, turn long, role string, text string"


def quote(t, level=1):
    return "\n".join(f"{'> ' * level}{line}" for line in t.split("\n"))


def run(spark, rows):
    got = Q.conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(x["conv_id"], x["turn"]): x for x in got}


def test_blocks():
    assert Q.blocks("a\n> b\n>> c\n> > d\ne") == [(0, "a"), (1, "b"), (2, "c\nd"), (0, "e")]
    assert Q.unquoted(Q.blocks("On Monday Ann wrote:\n> b\nthanks")) == ["thanks"]
    assert Q.unquoted(Q.blocks("Ann wrote: this")) == ["Ann wrote: this"]


def test_quotations_lead_to_their_originals(spark):
    r = random.Random(1)
    a, b, c, d = (f"{text(r, 12)}\n{text(r, 12)}" for _ in range(4))
    nested = f"{quote(quote(a) + chr(10) + b)}\n{d}"
    rows = [(1, 0, "user", a), (1, 1, "assistant", f"{quote(a)}\n\n{b}"), (1, 2, "user", c), (1, 3, "assistant", nested), (1, 4, "user", f"Ann wrote:\n{quote(a.splitlines()[1].upper())}\nwhy?")]
    got = run(spark, rows)
    assert [got[1, t]["parent_turn"] for t in range(5)] == [None, 0, 1, 1, 0]
    assert [got[1, t]["link"] for t in range(5)] == ["start", "quote", "turn", "quote", "quote"]
    assert [got[1, t]["text"] for t in range(5)] == [a, b, c, d, "why?"]
    assert not any(line.startswith(">") for x in got.values() for line in x["text"].split("\n"))


def test_quotations_across_conversations(spark):
    r = random.Random(2)
    a, b = text(r, 15), text(r, 15)
    got = run(spark, [(3, 0, "user", a), (5, 0, "user", f"{quote(a)}\n{b}"), (5, 1, "assistant", "fine"), (4, 0, "user", "another start")])
    assert (got[5, 0]["parent_conv"], got[5, 0]["parent_turn"], got[5, 0]["link"]) == (3, 0, "quote")
    assert {k: (x["thread_conv"], x["thread_turn"], x["position"], x["depth"]) for k, x in got.items()} == {(3, 0): (3, 0, 0, 0), (5, 0): (3, 0, 1, 1), (5, 1): (3, 0, 2, 2), (4, 0): (4, 0, 0, 0)}


def test_against_brute_force(spark):
    r = random.Random(3)
    rows, said, parent = [], {}, {}
    for conv in range(30):
        for turn in range(r.randint(1, 9)):
            own = f"{text(r, 9)}\n{text(r, 9)}"
            if turn and r.random() < 0.6:
                to = r.randrange(turn)
                whole = said[conv, to]
                body = f"{quote(whole if r.random() < 0.5 else whole.split(chr(10))[r.randrange(2)])}\n{own}"
            else:
                to, body = turn - 1, own
            said[conv, turn] = own
            parent[conv, turn] = to if turn else None
            rows.append((conv, turn, "user", body))
    got = run(spark, rows)
    assert {k: x["parent_turn"] for k, x in got.items()} == parent
    assert {k: x["text"] for k, x in got.items()} == said
    for (conv, turn), x in got.items():
        depth, at = 0, turn
        while parent[conv, at] is not None:
            depth, at = depth + 1, parent[conv, at]
        assert (x["depth"], x["thread_turn"]) == (depth, at)
        if turn:
            assert x["position"] > got[conv, parent[conv, turn]]["position"]


def test_short_and_deep_quotations(spark):
    r = random.Random(4)
    a, b, c = text(r, 12), text(r, 12), text(r, 12)
    rows = [(1, 0, "user", "Yes please"), (1, 1, "assistant", a), (1, 2, "user", f"> Yes please\n{b}"), (1, 3, "user", c), (1, 4, "user", f">> {a}\nindeed"), (1, 5, "user", f"> {c}\n>> {a}\nboth"), (2, 0, "user", "> Yes please\nother"), (2, 1, "user", f"> {a}\n> Yes please\nlines")]
    got = run(spark, rows)
    assert {k: (x["link"], x["parent_conv"], x["parent_turn"]) for k, x in got.items()} == {
        (1, 0): ("start", None, None), (1, 1): ("turn", 1, 0), (1, 2): ("quote", 1, 0), (1, 3): ("turn", 1, 2),
        (1, 4): ("quote", 1, 1), (1, 5): ("quote", 1, 3), (2, 0): ("start", None, None), (2, 1): ("quote", 1, 1),
    }


def test_one_conversation_over_many_partitions(spark):
    r = random.Random(5)
    own = [text(r, 9) for _ in range(3000)]
    to = [r.randrange(i) if i and r.random() < 0.5 else i - 1 for i in range(3000)]
    rows = [(7, i, "user", f"{quote(own[to[i]])}\n{own[i]}" if to[i] != i - 1 else own[i]) for i in range(3000)] + [(3, 0, "user", "hi"), (9, 0, "user", "ho")]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x["turn"]: x for x in Q.conversations(df).where("conv_id = 7").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    depth = [0] * 3000
    for i in range(1, 3000):
        depth[i] = depth[to[i]] + 1
    assert [got[i]["depth"] for i in range(3000)] == depth and all(x["thread_turn"] == 0 for x in got.values())
    assert [got[i]["parent_turn"] for i in range(3000)] == [None, *to[1:]]
    assert [x["turn"] for x in sorted(got.values(), key=lambda x: x["position"])] == sorted(range(3000), key=lambda i: (depth[i], i))


def test_awkward_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "user", ""), (1, 2, None, "> only a quotation of nothing known"), (1, 3, "b", "x"), (1, 3, "a", "y"), (1, 3, "a", "y"), (None, 1, "user", "x"), (2, None, "user", "x"), (2, 7, "user", "> " * 40 + "deep"), (3, 0, "user", "long " * 60_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("h", "c", "t", "k", "first", "m", "before", "words", "level", "passages", "body")})
    got = {(x["conv_id"], x["turn"]): x for x in Q.conversations(df).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 7), (3, 0)}
    assert [got[1, t]["text"] for t in range(4)] == ["", "", "", "y"] and got[1, 3]["parent_turn"] == 2
    assert len(got[3, 0]["text"]) == 5 * 60_000 - 1
    assert Q.conversations(df.limit(0)).count() == 0
