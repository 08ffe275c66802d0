"""Python-style number formatting as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPEC = re.compile(r"^(?P<sign>[+-]?)(?P<sep>[,_]?)(?:\.(?P<precision>\d+))?(?P<kind>.?)$")


def parse(template: str) -> list[tuple[bool, str]]:
    """Pieces of an f-string template: (is a placeholder, text or format spec)."""
    out: list[tuple[bool, str]] = []
    text, i = "", 0
    while i < len(template):
        two = template[i : i + 2]
        if two in ("{{", "}}"):
            text, i = text + two[0], i + 2
        elif template[i] == "}":
            raise ValueError("Single '}' encountered in format string")
        elif template[i] == "{":
            end = template.find("}", i)
            if end < 0:
                raise ValueError("Expected '}' before end of string")
            if text:
                out.append((False, text))
            spec = template[i + 1 : end]
            if spec and not spec.startswith(":"):
                raise ValueError("placeholders must be empty or start with ':'")
            out.append((True, spec[1:]))
            text, i = "", end + 1
        else:
            text, i = text + template[i], i + 1
    if text:
        out.append((False, text))
    return out


def _apply(value: Column, spec: str) -> Column:
    if not spec:
        return value.cast("string")
    m = _SPEC.match(spec)
    if m is None or m["kind"] not in ("", "f", "%"):
        raise NotImplementedError(f"format spec {spec!r} is not supported")
    percent, precision = m["kind"] == "%", m["precision"]
    if precision is None and m["kind"]:
        precision = "6"
    number = value.cast("double") * (100.0 if percent else 1.0) if precision is not None or percent else value
    if precision is not None:
        shown = F.regexp_replace(F.format_number(number, int(precision)), ",", "")
    else:
        shown = value.cast("string")
    whole, rest = F.regexp_extract(shown, r"^(-?\d+)", 1), F.regexp_extract(shown, r"^-?\d+(.*)$", 1)
    if m["sep"]:
        whole = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", m["sep"])
    out = F.concat(whole, rest)
    if m["sign"] == "+":
        out = F.when(out.startswith("-"), out).otherwise(F.concat(F.lit("+"), out))
    return F.concat(out, F.lit("%")) if percent else out


def format(template: str, *args: Column | str | float) -> Column:  # noqa: A001
    """Fills a template such as ``"{:,.3f} of {}"``; plain strings and numbers are literals.

    Sign (+ or -), separator (, or _), precision, and the types f and % are
    supported; others raise NotImplementedError. A NULL argument makes the result NULL.
    """
    pieces = parse(template)
    n = sum(is_arg for is_arg, _ in pieces)
    if n != len(args):
        raise ValueError(f"the template has {n} placeholders, but {len(args)} arguments are given")
    given = iter(args)
    parts = []
    for is_arg, text in pieces:
        if is_arg:
            a = next(given)
            parts.append(_apply(a if isinstance(a, Column) else F.lit(a), text))
        else:
            parts.append(F.lit(text))
    return F.concat(*parts) if parts else F.lit("")
