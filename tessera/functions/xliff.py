"""XLIFF 1.2 segments: a string with inline markup to content nodes and back.

Elements that hold native code become one placeholder each, with everything in them; elements that wrap translatable
text become a placeholder for each tag; empty elements one. In logical mode entities are decoded and CDATA unwrapped,
in verbatim mode the text stays as it is written.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import CONTENT, ParseError
from .nodes import PLACEHOLDER, TEXT, _col, is_text

MODES = ("logical", "verbatim")
_CODE, _WRAP, _EMPTY = frozenset(("bpt", "ept", "ph", "it")), frozenset(("g", "mrk")), frozenset(("x", "bx", "ex"))
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_TOKEN = re.compile(
    r"""(?P<text>[^<&]+)|(?P<entity>&[^;&<\s]*;)|(?P<cdata><!\[CDATA\[.*?\]\]>)|(?P<comment><!--.*?-->)|(?P<decl><\?xml\s.*?\?>)|(?P<pi><\?.*?\?>)|(?P<doctype><![A-Za-z][^>]*>)
    |(?P<tag><(?P<close>/)?(?P<name>[^\s/<>"'=]+)(?P<attributes>(?:[^<>"']|"[^"]*"|'[^']*')*?)(?P<self>/)?\s*>)""",
    re.VERBOSE | re.DOTALL,
)
_REFUSED = {"comment": "comment", "pi": "processing instruction", "decl": "XML declaration", "doctype": "doctype"}


def _decode(entity: str) -> str:
    name = entity[1:-1]
    if name in _NAMED:
        return _NAMED[name]
    m = re.fullmatch(r"#(?:x([0-9a-fA-F]+)|([0-9]+))", name)
    if m:
        cp = int(m[1], 16) if m[1] else int(m[2])
        if 0 < cp <= 0x10FFFF and not 0xD800 <= cp <= 0xDFFF:
            return chr(cp)
    raise ParseError("unknown_entity", entity)


def parse(segment: str, mode: str = "logical") -> list[tuple[str, str]]:
    """(node_kind, data) of a segment. Raises ParseError for anything that isn't an inline body of well-formed markup."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} isn't one of {MODES}")
    out: list[tuple[str, str]] = []
    run: list[str] = []
    opened: list[str] = []
    at, size, logical = 0, len(segment), mode == "logical"

    def mark(start: int, end: int) -> None:
        if joined := "".join(run):
            out.append((TEXT, joined))
        run.clear()
        out.append((PLACEHOLDER, segment[start:end]))

    while at < size:
        m = _TOKEN.match(segment, at)
        if m is None:
            raise ParseError("malformed", segment[at : at + 40])
        kind, start, at = m.lastgroup, m.start(), m.end()
        if m["text"] is not None:
            run.append(m["text"])
        elif m["entity"] is not None:
            run.append(_decode(m["entity"]) if logical else m["entity"])
        elif m["cdata"] is not None:
            run.append(m["cdata"][9:-3] if logical else m["cdata"])
        elif m["tag"] is None:
            raise ParseError("unsupported_construct", _REFUSED[str(kind)])
        else:
            name = m["name"]
            local = name.rpartition(":")[2]
            if m["close"]:
                if local not in _WRAP:
                    raise ParseError("unknown_tag", local)
                if not opened or opened.pop() != name:
                    raise ParseError("malformed", f"</{name}> closes nothing")
                mark(start, at)
            elif m["self"]:
                if local not in _CODE | _WRAP | _EMPTY:
                    raise ParseError("unknown_tag", local)
                mark(start, at)
            elif local in _CODE:
                at = _closing(segment, name, at)
                mark(start, at)
            elif local in _WRAP:
                opened.append(name)
                mark(start, at)
            else:
                raise ParseError("unknown_tag", local)
    if opened:
        raise ParseError("malformed", f"<{opened[-1]}> isn't closed")
    if joined := "".join(run):
        out.append((TEXT, joined))
    return out


def _closing(segment: str, name: str, at: int) -> int:
    """Where the element of this name that was opened before `at` ends, elements of the same name inside it included."""
    depth = 1
    while depth:
        m = _TOKEN.match(segment, at)
        if m is None:
            if at < len(segment) and segment[at] == "&":  # native code is never decoded
                at += 1
                continue
            raise ParseError("malformed", f"<{name}> isn't closed")
        at = m.end()
        if m["tag"] is not None and m["name"] == name and not m["self"]:
            depth += -1 if m["close"] else 1
    return at


_RESULT = T.StructType([T.StructField("content", CONTENT), T.StructField("error", T.StringType())])


def _parser(mode: str) -> Callable[..., Column]:
    @F.pandas_udf(_RESULT)
    def run(segment: pd.Series) -> pd.DataFrame:
        rows = []
        for s in segment:
            try:
                rows.append((None if s is None else [{"node_kind": k, "data": d} for k, d in parse(s, mode)], None))
            except ParseError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["content", "error"])

    return run


_PARSERS = {mode: _parser(mode) for mode in MODES}


def try_parse_segment(segment: Column | str, mode: str = "logical") -> Column:
    """struct(content, error): one of them is null; both are for a null segment."""
    return _PARSERS[mode](_col(segment))


def parse_segment(segment: Column | str, mode: str = "logical") -> Column:
    """Content of a segment; the query fails at the first one that can't be parsed."""
    r = try_parse_segment(segment, mode)
    return F.when(r["error"].isNull(), r["content"]).otherwise(F.raise_error(F.concat(F.lit("ParseError "), r["error"])).cast("array<struct<node_kind:string,data:string>>"))


def emit_segment(content: Column | str, mode: str = "logical") -> Column:
    """The segment that content came from: text escaped (logical) or as it is (verbatim), placeholders as they are."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} isn't one of {MODES}")
    nodes = _col(content)

    def escaped(d: Column) -> Column:
        for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            d = F.replace(d, F.lit(raw), F.lit(entity))
        return d

    if mode == "verbatim":
        return F.array_join(F.transform(nodes, lambda n: n["data"]), "")
    return F.array_join(F.transform(nodes, lambda n: F.when(is_text(n), escaped(n["data"])).otherwise(n["data"])), "")
