"""Explicit normalisation of content. Text nodes change, placeholders never do, and nothing here is applied by itself."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CONTENT
from .nodes import TEXT, _col, is_text, text
from .validate import language_tag

TRIM_MODES = ("outer_leading", "outer_trailing", "outer_both", "all_leading", "all_trailing", "all_both")
UNICODE_FORMS = ("nfc", "nfd", "nfkc", "nfkd", "cjk_compat_variants")


def collapse_adjacent(content: Column | str) -> Column:
    """Merge neighbouring text nodes and drop those that stay empty; placeholders keep texts apart."""
    empty = F.array().cast(CONTENT)

    def step(acc: Column, n: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(text(F.concat(last["data"], n["data"]))))
        return F.when(is_text(n) & (n["data"] == ""), acc).when(is_text(n) & F.coalesce(is_text(last), F.lit(False)), joined).otherwise(F.concat(acc, F.array(n)))

    return F.aggregate(_col(content), empty, step)


def drop_empty(content: Column | str) -> Column:
    """Remove empty text nodes without merging their neighbours."""
    return F.filter(_col(content), lambda n: ~is_text(n) | (n["data"] != ""))


def trim_nodes(content: Column | str, mode: str, characters: str) -> Column:
    """Strip any of the characters from text nodes: from all of them, or only where the content begins or ends."""
    if mode not in TRIM_MODES:
        raise ValueError(f"mode {mode!r} isn't one of {TRIM_MODES}")
    where, _, side = mode.partition("_")
    nodes, chars = _col(content), F.lit(characters)
    lead = side in ("leading", "both")
    trail = side in ("trailing", "both")

    def cut(n: Column, front: Column, back: Column) -> Column:
        d = n["data"]
        d = F.when(front, F.ltrim(d, chars)).otherwise(d)
        d = F.when(back, F.rtrim(d, chars)).otherwise(d)
        return F.when(is_text(n), text(d)).otherwise(n)

    if where == "all":
        return F.transform(nodes, lambda n: cut(n, F.lit(lead), F.lit(trail)))
    return F.transform(nodes, lambda n, i: cut(n, F.lit(lead) & (i == 0), F.lit(trail) & (i == F.size(nodes) - 1)))


@lru_cache(1)
def _cjk_variants() -> dict[int, str]:
    """Compatibility ideographs as their base and a variation selector, numbered per base in code point order."""
    seen: dict[str, int] = {}
    table = {}
    for cp in [*range(0xF900, 0xFB00), *range(0x2F800, 0x2FA20)]:
        base = unicodedata.decomposition(chr(cp))
        if base and " " not in base:
            # A base may itself be a compatibility ideograph; the variation sequence is of the final one.
            final = unicodedata.normalize("NFD", chr(cp))
            n = seen[final] = seen.get(final, -1) + 1
            table[cp] = final + chr(0xFE00 + n)
    return table


@F.pandas_udf(CONTENT)
def _cjk(content: pd.Series) -> pd.Series:
    table = _cjk_variants()
    return content.map(lambda nodes: None if nodes is None else [{**n, "data": n["data"].translate(table)} if n["node_kind"] == TEXT else n for n in nodes])


def normalize_unicode(content: Column | str, form: str) -> Column:
    """A Unicode normal form of every text node, computed on the JVM, or CJK compatibility ideographs as variation sequences."""
    if form not in UNICODE_FORMS:
        raise ValueError(f"form {form!r} isn't one of {UNICODE_FORMS}")
    nodes = _col(content)
    if form == "cjk_compat_variants":
        return _cjk(nodes)
    how = "compose" if form.endswith("c") else "decompose"
    normal = lambda d: F.when(d.isNotNull(), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(how), d, F.lit("k" in form)))
    return F.transform(nodes, lambda n: F.when(is_text(n), text(normal(n["data"]))).otherwise(n))


def normalize_language(tag: Column | str, case: str) -> Column:
    """A tag in lower or upper case, validated again."""
    if case not in ("lower", "upper"):
        raise ValueError(f"case {case!r} is neither lower nor upper")
    return language_tag((F.lower if case == "lower" else F.upper)(_col(tag)))
