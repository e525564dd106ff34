"""License expressions: parse, render, combine, simplify, keys, SPDX names.

Precedence from loosest: OR, AND, WITH. Keys are lower-cased; a key that starts with ``licenseref-`` is a reference.
An expression is a nested tuple: ("key", name), ("ref", name), (op, left, right).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Expression = tuple
_TOKEN = re.compile(r"\s*(?:([()])|([\w.+-]+))|\s*(\S)")
_TERM = re.compile(r"[\w.+-]+")
_OPERATORS = ("AND", "OR", "WITH")
NAMESPACE = "scancode"


class ExpressionError(ValueError):
    pass


def _tokens(text: str) -> Iterator[tuple[str, int]]:
    at, end = 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if m.group(3):
            raise ExpressionError(f"unexpected {m.group(3)!r} at {m.start(3)}")
        yield m.group(1) or m.group(2), m.start(1) if m.group(1) else m.start(2)
        at = m.end()


def parse(text: str) -> Expression:
    tokens = [*_tokens(text)]
    if not tokens:
        raise ExpressionError("empty expression")
    at = 0

    def peek() -> str | None:
        return tokens[at][0] if at < len(tokens) else None

    def level(k: int) -> Expression:
        nonlocal at
        if k == 3:
            return operand()
        name = ("OR", "AND", "WITH")[k]
        left = level(k + 1)
        while (p := peek()) is not None and p.upper() == name:
            at += 1
            left = (name, left, level(k + 1))
        return left

    def operand() -> Expression:
        nonlocal at
        token = peek()
        if token is None:
            raise ExpressionError("expression ends with an operator")
        where = tokens[at][1]
        at += 1
        if token == "(":
            inner = level(0)
            if peek() != ")":
                raise ExpressionError("missing closing parenthesis")
            at += 1
            return inner
        if token == ")" or token.upper() in _OPERATORS:
            raise ExpressionError(f"unexpected {token!r} at {where}")
        key = token.lower()
        return ("ref" if key.startswith("licenseref-") else "key", key)

    out = level(0)
    if at < len(tokens):
        raise ExpressionError(f"unexpected {tokens[at][0]!r} at {tokens[at][1]}")
    return out


def keys(e: Expression) -> list[str]:
    """Sorted, each once."""
    if e[0] in ("key", "ref"):
        return [e[1]]
    return sorted({*keys(e[1]), *keys(e[2])})


def fold(op: str, parts: Iterable[Expression]) -> Expression | None:
    """Left-associative chain; None of nothing, and the part itself of one."""
    out = None
    for p in parts:
        out = p if out is None else (op, out, p)
    return out


def chain(op: str, e: Expression) -> list[Expression]:
    return [*chain(op, e[1]), *chain(op, e[2])] if e[0] == op else [e]


def _form(e: Expression) -> tuple:
    """Equal for expressions that differ in order and nesting only."""
    if e[0] in ("AND", "OR"):
        return (e[0], frozenset(_form(p) for p in chain(e[0], e)))
    if e[0] == "WITH":
        return ("WITH", _form(e[1]), _form(e[2]))
    return e


def simplify(e: Expression) -> Expression:
    """Drops repeats and absorbed parts: A AND (A OR B) is A, as is A OR (A AND B). X WITH e and X are two things."""
    if e[0] not in ("AND", "OR"):
        return e
    op, other = e[0], "OR" if e[0] == "AND" else "AND"
    parts: list[Expression] = []
    seen = set()
    for p in chain(op, e):
        for q in chain(op, simplify(p)):
            if (f := _form(q)) not in seen:
                seen.add(f)
                parts.append(q)
    sets = [frozenset(_form(x) for x in chain(other, p)) for p in parts]
    left = [p for k, p in enumerate(parts) if not any(sets[j] < sets[k] for j in range(len(parts)) if j != k)]
    return fold(op, left)


def render(e: Expression, case: dict[str, str] | None = None) -> str:
    if e[0] in ("key", "ref"):
        return (case or {}).get(e[1], e[1])
    if e[0] == "WITH":
        return f"{render(e[1], case)} WITH {render(e[2], case)}"
    other = "OR" if e[0] == "AND" else "AND"
    return f" {e[0]} ".join(f"({render(p, case)})" if p[0] == other else render(p, case) for p in chain(e[0], e))


def combine(expressions: Iterable[str], op: str = "AND") -> str | None:
    """One expression of several, simplified, in the first spelling of each key. If one can't be parsed: the distinct
    ones in order, compound ones in parentheses."""
    given = [x.strip() for x in expressions if x and x.strip()]
    if not given:
        return None
    case: dict[str, str] = {}
    for x in given:
        for term in _TERM.findall(x):
            if term.upper() not in _OPERATORS:
                case.setdefault(term.lower(), term)
    try:
        return render(simplify(fold(op, [parse(x) for x in given])), case)
    except ExpressionError:
        bare = lambda x: " " not in x or (x[0] == "(" and x[-1] == ")")
        return f" {op} ".join(x if bare(x) else f"({x})" for x in sorted(set(given)))


@lru_cache(10_000)
def combined(expressions: tuple[str | None, ...], op: str = "AND") -> str | None:
    """``combine``, kept: files of a tree state the same few expressions again and again."""
    return combine(expressions, op)


def contains(whole: str, part: str) -> bool:
    """Whether all keys of ``part`` are in ``whole``."""
    try:
        return set(keys(parse(part))) <= set(keys(parse(whole)))
    except ExpressionError:
        return False


def to_spdx(text: str, names: dict[str, str | None], namespace: str = NAMESPACE) -> str:
    """Keys replaced by SPDX ones; a key without one gets a LicenseRef of the namespace; other references stay."""

    def change(e: Expression) -> Expression:
        if e[0] == "key":
            return ("key", names.get(e[1]) or f"LicenseRef-{namespace}-{e[1]}")
        if e[0] == "ref":
            return ("ref", names.get(e[1]) or e[1])
        return (e[0], change(e[1]), change(e[2]))

    return render(change(parse(text)))


_PARSED = "struct<ok:boolean,canonical:string,keys:array<string>,error:string>"


def parse_column(expression: Column) -> Column:
    """struct(ok, canonical, keys, error) of an expression; null stays null."""

    @F.udf(_PARSED, useArrow=True)
    def run(text):
        if text is None:
            return None
        try:
            e = parse(text)
        except ExpressionError as error:
            return (False, None, None, str(error))
        return (True, render(e), keys(e), None)

    return run(expression)


def combine_column(expressions: Column, op: str = "AND") -> Column:
    """``combine`` of an array of strings."""
    if op not in ("AND", "OR"):
        raise ValueError(op)

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else combined(tuple(v), op) for v in values.to_pylist()], pa.string())

    return run(expressions)


def spdx_column(expression: Column, names: dict[str, str | None], namespace: str = NAMESPACE) -> Column:
    """SPDX form; null where the expression is null or can't be parsed."""

    def spelled(text: str | None) -> str | None:
        try:
            return None if text is None else to_spdx(text, names, namespace)
        except ExpressionError:
            return None

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        different = values.dictionary_encode()
        return pa.array([spelled(v) for v in different.dictionary.to_pylist()], pa.string()).take(different.indices)

    return run(expression)


def keys_column(expression: Column) -> Column:
    """Sorted distinct keys, in the JVM; parentheses and operators aren't checked."""
    terms = F.regexp_extract_all(F.lower(expression), F.lit(r"[\w.+-]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(terms, lambda t: ~t.isin("and", "or", "with"))))
