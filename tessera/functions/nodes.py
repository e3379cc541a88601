"""Constructors and accessors of content nodes, atoms and observations, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT, PLACEHOLDER = "text", "placeholder"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(data: Column) -> Column:
    return F.struct(F.lit(TEXT).alias("node_kind"), data.alias("data"))


def placeholder(data: Column) -> Column:
    return F.struct(F.lit(PLACEHOLDER).alias("node_kind"), data.alias("data"))


def content(*nodes: Column) -> Column:
    return F.array(*nodes)


def is_text(node: Column) -> Column:
    return node["node_kind"] == TEXT


def reconstruct(nodes: Column | str) -> Column:
    """Every node's data, in order, as one string."""
    return F.array_join(F.transform(_col(nodes), lambda n: n["data"]), "")


#: What a quoted string shows instead of a character; further control characters are shown by their number.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}
_ESCAPES |= {chr(i): f"\\u{{{i:x}}}" for i in [*range(1, 32), *range(127, 160)] if chr(i) not in _ESCAPES}


def quoted(data: Column) -> Column:
    """Text in double quotes, with the backslash, the quote and control characters escaped."""
    plain = F.concat(F.lit('"'), data, F.lit('"'))
    escaped = reduce(lambda d, c: F.replace(d, F.lit(c), F.lit(_ESCAPES[c])), _ESCAPES, data)
    return F.when(data.rlike(r'[\\"\p{Cntrl}\x80-\x9f]'), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(plain)


def display(language: Column | str, nodes: Column | str) -> Column:
    """A readable form of an atom, for logs."""
    shown = F.transform(_col(nodes), lambda n: F.concat(F.when(is_text(n), F.lit("Text(")).otherwise(F.lit("Placeholder(")), quoted(n["data"]), F.lit(")")))
    return F.concat(F.lit("Atom(language="), _col(language), F.lit(", content=["), F.array_join(shown, ", "), F.lit("])"))


def digest(value: Column | str) -> Column:
    """A stored 32-byte key as lower-case hex."""
    return F.lower(F.hex(_col(value)))


def from_digest(value: Column | str) -> Column:
    return F.unhex(_col(value))


def region(tag: Column | str) -> Column:
    """The region subtag of a valid tag, null if there is none."""
    from .validate import LANGTAG

    found = F.regexp_extract(_col(tag), LANGTAG, 3)
    return F.when(found != "", found)


def script(tag: Column | str) -> Column:
    from .validate import LANGTAG

    found = F.regexp_extract(_col(tag), LANGTAG, 2)
    return F.when(found != "", found)


def observation(kind: Column, subjects: Column, recorded_at: Column, effective_at: Column, payload: Column) -> list[Column]:
    """The five fields as given; no default is applied."""
    return [kind.alias("kind"), subjects.alias("subjects"), recorded_at.alias("recorded_at"), effective_at.alias("effective_at"), payload.alias("payload")]


def property_of(kind: Column, subject: Column, recorded_at: Column, effective_at: Column | None, payload: Column) -> list[Column]:
    """A fact about one atom; without an effective time it holds from when it was recorded."""
    return relationship(kind, F.array(subject), recorded_at, effective_at, payload)


def relationship(kind: Column, subjects: Column, recorded_at: Column, effective_at: Column | None, payload: Column) -> list[Column]:
    """A fact about several atoms, in the order that the kind gives meaning to."""
    effective = recorded_at if effective_at is None else F.coalesce(effective_at, recorded_at)
    return observation(kind, subjects, recorded_at, effective, payload)


def sorted_subjects(subjects: Column | str) -> Column:
    """Subjects in byte order, for kinds that are symmetric; never applied by itself."""
    return F.array_sort(_col(subjects))
