import hashlib
import json
import struct
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import identity as I  # noqa: E741
from tessera.functions import nodes as N
from tessera.functions import normalize as Z
from tessera.functions import validate as V
from tessera.functions import xliff as X
from tessera.functions.canonical import canonical, number
from tessera.model import ATOM_INPUT, InvalidPayload, ParseError

TEXTS = st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0"), max_size=12)
CONTENTS = st.lists(st.tuples(st.sampled_from(["text", "placeholder"]), TEXTS), max_size=8)
LANGUAGES = st.sampled_from(["en-US", "fr-FR", "de-DE", "ja-JP", "pt-BR", "zh-CN", "es-ES", "en-GB"])
RELAXED = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def frame(s):
    b = s.encode()
    return struct.pack(">I", len(b)) + b


def py_atom_id(language, content):
    body = b"".join(b"\0" + frame(d) if k == "text" else b"\1" for k, d in content)
    return hashlib.sha256(b"\0" + frame(language) + body).digest()


def py_row_digest(language, content):
    body = b"".join((b"\0" if k == "text" else b"\1") + frame(d) for k, d in content)
    return hashlib.sha256(b"\1" + frame(language) + body).digest()


def atoms(spark, rows):
    return spark.createDataFrame([(lang, [{"node_kind": k, "data": d} for k, d in c]) for lang, c in rows], ATOM_INPUT)


GOLDEN = [
    ("en-US", [], "361ecb49ff2ec4d965f408c18a34816a94d142b52795358d6531109c4d1a446d", "0c381d1d6a1be6519c4840e73f90b848b4e106f8c01676fbb93b87b633f460c8"),
    ("en-US", [("text", "Hello")], "46e976b33b66f65959ec53e49227ceacd6c16e568a6cca6e5772fb1fa9f94684", "6841981643f8c7c8b8dc436438fcf67ad5a3ec230519f1dd004fab7ea5f04e8d"),
    ("fr-FR", [("text", "Bonjour")], "a94feaed4eff3c805c5bc6e9c0a6317d9b5e3b9a53ff1f32fb22e5754065432a", "898143907cee974c706c86d02785c844d1693d339e07a637029eebbf95f7df57"),
    ("en-US", [("text", "Click "), ("placeholder", "<g id=1>"), ("text", "here"), ("placeholder", "</g>")], "0d580df03cf76e9e3d5afa3d62988ede54869f6645d2ee65d2333039cdc74200", "720e95266f455ec951fa265c16ad3a67e1fab033485316323e54695694603beb"),
    ("en-US", [("placeholder", "<ph/>")], "52197e159f28c0538a90f1e9d7016029bf3524800de9964aed627cb91d1d0084", "4272133b75d9a01fcf00048b250abf0ee39e824c19e4c8b67647a29ed52a29c1"),
    ("en-US", [("placeholder", "<bpt/>")], "52197e159f28c0538a90f1e9d7016029bf3524800de9964aed627cb91d1d0084", "d8d7e90bc974b889d399d8507e291b97900adfa6c12dbdda586ba527194a395d"),
    ("de-DE", [("text", "Gift")], "0ddb8cf0475dc437d92e4e00584fecfe34239577df2187db1b2537afb411f910", "a32bfad0422fa4097ca87da1a1d50240846a78531dbfac8b4898a0dc67e4c55b"),
]


def test_golden_digests(spark):
    rows = atoms(spark, [g[:2] for g in GOLDEN]).select(N.digest(I.atom_id("language", "content")), N.digest(I.row_digest("language", "content"))).collect()
    assert [tuple(r) for r in rows] == [g[2:] for g in GOLDEN]


def test_golden_observations(spark):
    hello, bonjour = bytes.fromhex(GOLDEN[1][2]), bytes.fromhex(GOLDEN[2][2])
    day = 86400
    rows = spark.createDataFrame(
        [
            (1, "translation_of", [bonjour, hello], 1000, 1000, canonical('{"author":"deepl:v2","confidence":0.91}')),
            (2, "approved_by", [hello], day, -365 * day, canonical('{"reviewer":"alice"}')),
            (3, "translation_of", [bonjour, hello], 0, 0, canonical(None)),
        ],
        "n int, kind string, subjects array<binary>, r long, e long, payload string",
    )
    ids = rows.orderBy("n").select(N.digest(I.observation_id("kind", "subjects", F.timestamp_seconds("r"), F.timestamp_seconds("e"), "payload"))).collect()
    assert [r[0] for r in ids] == [
        "1ed268e68e12a7734a27d44dbfc0b1267422cb848ead6e5c5aef0c9017a8f6d6",
        "1e8c7fa8c8695c9a4a2b1721e47f8c7fcd4c0b4770dc49bd65454e7380ce0fc7",
        "9b3dbe697edb0944526662669a59639d96c83a5feb2bc485f94d419639119248",
    ]


@RELAXED
@given(st.lists(st.tuples(LANGUAGES, CONTENTS), min_size=1, max_size=20))
def test_keys_match_the_byte_layout(spark, rows):
    got = atoms(spark, rows).select(I.atom_id("language", "content"), I.row_digest("language", "content")).collect()
    assert [tuple(map(bytes, r)) for r in got] == [(py_atom_id(*r), py_row_digest(*r)) for r in rows]


def py_collapse(content):
    out = []
    for k, d in content:
        if k == "text" and not d:
            continue
        if k == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + d)
        else:
            out.append((k, d))
    return out


def py_trim(content, mode, chars):
    out = []
    for i, (k, d) in enumerate(content):
        if k == "text":
            if mode in ("all_leading", "all_both") or (mode in ("outer_leading", "outer_both") and i == 0):
                d = d.lstrip(chars)
            if mode in ("all_trailing", "all_both") or (mode in ("outer_trailing", "outer_both") and i == len(content) - 1):
                d = d.rstrip(chars)
        out.append((k, d))
    return out


def pairs(nodes):
    return [(n["node_kind"], n["data"]) for n in nodes]


@RELAXED
@given(st.lists(CONTENTS, min_size=1, max_size=20))
def test_normalisation(spark, contents):
    df = atoms(spark, [("en-US", c) for c in contents])
    cols = {"collapsed": Z.collapse_adjacent("content"), "twice": Z.collapse_adjacent(Z.collapse_adjacent("content")), "dropped": Z.drop_empty("content"), "said": N.reconstruct("content")}
    cols |= {m: Z.trim_nodes("content", m, " .*") for m in Z.TRIM_MODES} | {f: Z.normalize_unicode("content", f) for f in Z.UNICODE_FORMS[:4]}
    for c, r in zip(contents, df.select(*(v.alias(k) for k, v in cols.items())).collect(), strict=True):
        assert pairs(r["collapsed"]) == pairs(r["twice"]) == py_collapse(c)
        assert r["said"] == "".join(d for _, d in c)
        assert pairs(r["dropped"]) == [(k, d) for k, d in c if k == "placeholder" or d]
        for m in Z.TRIM_MODES:
            assert pairs(r[m]) == py_trim(c, m, " .*")
        for f in ("nfc", "nfd"):
            assert [k for k, _ in pairs(r[f])] == [k for k, _ in c]
            assert [d for k, d in pairs(r[f]) if k == "placeholder"] == [d for k, d in c if k == "placeholder"]


@pytest.mark.parametrize(
    ("form", "given_", "wanted"),
    [("nfc", "é", "é"), ("nfkc", "ﬁle", "file"), ("nfd", "é", "é"), ("nfkd", "ﬁ", "fi"), ("cjk_compat_variants", "塚", "塚︀")],
)
def test_unicode_forms(spark, form, given_, wanted):
    df = atoms(spark, [("en-US", [("text", given_), ("placeholder", given_)])])
    assert pairs(df.select(Z.normalize_unicode("content", form).alias("c")).first()["c"]) == [("text", wanted), ("placeholder", given_)]


def test_unicode_forms_agree_with_python(spark):
    texts = ["Ångström ﬃ ½ ①", "한글", "가", "é̖x", "ÄÖÜ", ""]
    df = atoms(spark, [("en-US", [("text", t)]) for t in texts])
    for form in Z.UNICODE_FORMS[:4]:
        got = [r[0] for r in df.select(N.reconstruct(Z.normalize_unicode("content", form))).collect()]
        assert got == [unicodedata.normalize(form.upper(), t) for t in texts]


def test_language_tags(spark):
    cases = {"en-US": "ok", "en-WY": "ok", "en": "missing_region", "": "malformed", "not a tag": "malformed", "qaa-QM": "ok", "zh-Hant-TW": "ok", "es-419": "ok", "x-private": "missing_region", "i-klingon": "missing_region", "en_US": "malformed", "de-DE-1996": "ok", "en-US-x-a": "ok", "en-": "malformed", None: "malformed"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", V.language_outcome("t").alias("o"))
    assert {r["t"]: r["o"] for r in df.collect()} == cases
    row = spark.createDataFrame([("zh-Hant-TW",)], "t string").select(N.region("t"), N.script("t")).first()
    assert tuple(row) == ("TW", "Hant")
    assert spark.createDataFrame([("en-US",)], "t string").select(Z.normalize_language("t", "lower"), Z.normalize_language("t", "upper")).first() == ("en-us", "EN-US")
    with pytest.raises(Exception, match="InvalidLanguageTag missing_region"):
        spark.createDataFrame([("en",)], "t string").select(V.language_tag("t")).collect()


def test_kinds(spark):
    cases = {" Translation_Of ": True, "a": True, "": False, "   ": False, " 　": False, None: False}
    df = spark.createDataFrame([(k,) for k in cases], "k string").select("k", V.kind_ok("k").alias("o"))
    assert {r["k"]: r["o"] for r in df.collect()} == cases


# --- canonical JSON -------------------------------------------------------------------------------------------------

JSON = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | TEXTS, lambda x: st.lists(x, max_size=4) | st.dictionaries(TEXTS, x, max_size=4), max_leaves=12)


@given(JSON)
def test_canonical_json_is_stable_and_sorted(value):
    text = json.dumps(value)
    done = canonical(text)
    assert json.loads(done) == value
    assert canonical(done) == done == canonical(json.dumps(value, indent=3, ensure_ascii=False))


@pytest.mark.parametrize(
    ("x", "wanted"),
    [(1.0, "1.0"), (0.91, "0.91"), (1e16, "1e16"), (1e15, "1000000000000000.0"), (1e-5, "0.00001"), (1e-6, "1e-6"), (1.5e-7, "1.5e-7"), (123456.789, "123456.789"), (-0.0, "-0.0"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e308"), (0.1, "0.1"), (100.0, "100.0")],
)
def test_numbers(x, wanted):
    assert number(x) == wanted
    assert float(wanted) == x


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_keep_their_value(x):
    assert float(number(x)) == x


def test_canonical_json_cases():
    assert canonical('{"b": 1, "a": {"d": [2, 1], "c": null}}') == '{"a":{"c":null,"d":[2,1]},"b":1}'
    assert canonical('{"a": 1, "a": 2}') == '{"a":2}'
    assert canonical("1") != canonical("1.0")
    assert canonical("18446744073709551616") == "1.8446744073709552e19"
    assert canonical(None) == "null"
    for bad in ("not json", "NaN", "[Infinity]", "", '"\\ud800"', "1e999", "{'a': 1}"):
        with pytest.raises(InvalidPayload):
            canonical(bad)


# --- segments -------------------------------------------------------------------------------------------------------


def test_segment_examples():
    T, P = "text", "placeholder"
    assert X.parse('Click <ph id="1">{0}</ph> here') == [(T, "Click "), (P, '<ph id="1">{0}</ph>'), (T, " here")]
    assert X.parse('<g id="1">a<ph id="1">x</ph>b<g id="2">c</g>d</g>') == [(P, '<g id="1">'), (T, "a"), (P, '<ph id="1">x</ph>'), (T, "b"), (P, '<g id="2">'), (T, "c"), (P, "</g>"), (T, "d"), (P, "</g>")]
    assert X.parse("before<x/>after") == [(T, "before"), (P, "<x/>"), (T, "after")]
    assert X.parse('<ph id="1"/>') == [(P, '<ph id="1"/>')]
    assert X.parse("Tom &amp; Jerry &lt;3") == [(T, "Tom & Jerry <3")]
    assert X.parse("Tom &amp; Jerry &lt;3", "verbatim") == [(T, "Tom &amp; Jerry &lt;3")]
    assert X.parse("A&#66;C&#x44;") == [(T, "ABCD")]
    assert X.parse("a<![CDATA[b &amp; <c>]]>d") == [(T, "ab &amp; <c>d")]
    assert X.parse("a<![CDATA[b &amp; <c>]]>d", "verbatim") == [(T, "a<![CDATA[b &amp; <c>]]>d")]
    assert X.parse('<ph x="a>b">&nbsp;<sub>t</sub><ph>n</ph></ph>') == [(P, '<ph x="a>b">&nbsp;<sub>t</sub><ph>n</ph></ph>')]
    assert X.parse("<xlf:ph>x</xlf:ph>") == [(P, "<xlf:ph>x</xlf:ph>")]
    assert X.parse("plain &nbsp; text", "verbatim") == [(T, "plain &nbsp; text")]
    assert X.parse("") == []


@pytest.mark.parametrize(
    ("segment", "code"),
    [("plain &nbsp; text", "unknown_entity"), ("&#0;", "unknown_entity"), ("<foo>x</foo>", "unknown_tag"), ("<sub>x</sub>", "unknown_tag"), ("<x></x>", "unknown_tag"), ("a<!-- n -->b", "unsupported_construct"), ("<?pi x?>", "unsupported_construct"), ("<!DOCTYPE html>", "unsupported_construct"), ('<?xml version="1.0"?>', "unsupported_construct"), ("<g>a", "malformed"), ("a</g>", "malformed"), ("<ph>a", "malformed"), ("a & b", "malformed"), ("<g>a</mrk>", "malformed")],
)
def test_segment_errors(segment, code):
    with pytest.raises(ParseError) as e:
        X.parse(segment)
    assert e.value.code == code


LEAF = st.text("abcXYZ .,!?09", max_size=6) | st.sampled_from(["&amp;", "&lt;", "&gt;", "&quot;", "&apos;", "&#65;", "&#x41;"]) | st.sampled_from(["<x/>", '<bx id="1"/>', "<ex/>"]) | st.builds(lambda n, t: f'<{n} id="2">{t}</{n}>', st.sampled_from(["ph", "bpt", "ept", "it"]), st.text("ab{}", max_size=4))
FRAGMENT = st.recursive(LEAF, lambda x: st.lists(x, max_size=4).map("".join) | st.builds(lambda n, t: f"<{n}>{t}</{n}>", st.sampled_from(["g", "mrk"]), x), max_leaves=10)


@RELAXED
@given(st.lists(FRAGMENT, min_size=1, max_size=20))
def test_segments_round_trip(spark, segments):
    df = spark.createDataFrame([(s,) for s in segments], "s string")
    rows = df.select("s", X.parse_segment("s", "verbatim").alias("v"), X.parse_segment("s").alias("l"))
    rows = rows.select("s", X.emit_segment("v", "verbatim").alias("v"), "l", X.parse_segment(X.emit_segment("l")).alias("l2"))
    for r in rows.collect():
        assert r["v"] == r["s"]
        assert r["l"] == r["l2"]


def test_segment_columns(spark):
    df = spark.createDataFrame([("a<x/>",), ("<foo/>",), (None,)], "s string")
    r = df.select(X.try_parse_segment("s").alias("r")).collect()
    assert [x["r"]["error"] for x in r] == [None, "unknown_tag: foo", None]
    assert r[2]["r"]["content"] is None
    with pytest.raises(Exception, match="unknown_tag"):
        df.select(X.parse_segment("s")).collect()
    row = atoms(spark, [("en-US", [("text", 'a < b & c > "d"'), ("placeholder", "<x/>")])]).select(X.emit_segment("content")).first()
    assert row[0] == 'a &lt; b &amp; c &gt; "d"<x/>'
