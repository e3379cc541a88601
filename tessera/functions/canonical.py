"""Canonical JSON: keys in byte order at every depth, arrays as they are, no white space, one text for each number.

Built-in JSON functions reformat numbers and refuse repeated keys, so this is an Arrow-batched function.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import InvalidPayload


def number(x: float) -> str:
    """The shortest digits that give x back, plain from 1e-5 up to below 1e16, else with an exponent."""
    if not math.isfinite(x):
        raise InvalidPayload("a number is out of range")
    if x == 0:
        return "-0.0" if math.copysign(1, x) < 0 else "0.0"
    mantissa, _, exponent = f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len(digits))
    digits = digits.rstrip("0") or "0"
    sign = "-" if x < 0 else ""
    if len(digits) <= point <= 16:
        return f"{sign}{digits}{'0' * (point - len(digits))}.0"
    if 0 < point <= 16:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -5 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    tail = f".{digits[1:]}" if len(digits) > 1 else ""
    return f"{sign}{digits[0]}{tail}e{point - 1}"


class _Float(float):
    """Written by `number`."""

    __repr__ = lambda self: number(float(self))


def _integer(token: str) -> int | _Float:
    """Integers that fit 64 bits stay integers; others, and minus zero, become floats."""
    n = int(token) if len(token) < 30 else None
    if n is not None and -(1 << 63) <= n < 1 << 64 and token != "-0":
        return n
    return _Float(token)


def _refuse(token: str) -> None:
    raise InvalidPayload(f"{token} isn't JSON")


_STRING = json.encoder.encode_basestring


def _write(x: object, out: list[str]) -> None:
    if isinstance(x, dict):
        out.append("{")
        for i, k in enumerate(sorted(x)):
            out.append(("," if i else "") + _STRING(k) + ":")
            _write(x[k], out)
        out.append("}")
    elif isinstance(x, list):
        out.append("[")
        for i, v in enumerate(x):
            if i:
                out.append(",")
            _write(v, out)
        out.append("]")
    elif isinstance(x, str):
        out.append(_STRING(x))
    else:
        out.append({None: "null", True: "true", False: "false"}[x] if x is None or isinstance(x, bool) else number(x) if isinstance(x, float) else str(x))


def canonical(text: str | None) -> str:
    """Canonical form of a JSON text; an absent payload is null. Raises InvalidPayload for anything else."""
    if text is None:
        return "null"
    try:
        out: list[str] = []
        _write(json.loads(text, parse_float=_Float, parse_int=_integer, parse_constant=_refuse), out)
        done = "".join(out)
        done.encode()
        return done
    except (ValueError, RecursionError) as e:
        raise InvalidPayload(f"{e}: {text[:200]}") from e


@F.pandas_udf(T.StringType())
def canonical_json(payload: pd.Series) -> pd.Series:
    return payload.map(canonical)
