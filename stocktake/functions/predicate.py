"""The filter language: parsing, checking, evaluation on plain values, and compilation to a ``Column``.

Values are 64-bit integers, doubles and booleans, or an error. A row whose filter
is an error stays; only ``false`` drops it. ``&&`` and ``||`` look at their left
side first: an error there is an error of the whole, whatever the right side.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column
from pyspark.sql import functions as F

from stocktake.schema import I64_MAX, I64_MIN

# Fixed values of the language: longest expression in bytes, and what nesting may cost.
MAX_BYTES = 512
MAX_DEPTH = 24
#: What a pair of parentheses costs, one for each level of precedence; a unary operator costs one.
NESTING = 7

PROPERTIES = {"size": "Size", "last_modified": "LastModified"}
#: Binary operators by how tightly they bind.
BINDING = {"||": 1, "&&": 2, "<": 3, "<=": 3, ">": 3, ">=": 3, "==": 3, "!=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}
COMPARISONS = {"<", "<=", ">", ">=", "==", "!="}
_TOKEN = re.compile(
    r"[ \t\r\n\f\v]*(?:(?P<number>[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9][0-9_]*)?)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>\|\||&&|<=|>=|==|!=|[-+*/%<>!().]))"
)


class FilterError(ValueError):
    """The expression is not a filter."""


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()
    value: object = None


Kind = Literal["int", "float", "bool", "error"]


class _Parser:
    """Precedence climbing over a token list."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        stripped = text.rstrip(" \t\r\n\f\v")
        while at < len(stripped):
            m = _TOKEN.match(stripped, at)
            if not m:
                raise FilterError(f"unexpected text at {at}: {stripped[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def expect(self, kind: str, text: str | None = None) -> str:
        got = self.take()
        if got[0] != kind or text is not None and got[1] != text:
            raise FilterError(f"expected {text or kind}, found {got[1] or 'the end'}")
        return got[1]

    def binary(self, least: int, depth: int) -> Node:
        left = self.unary(depth)
        while True:
            kind, op = self.peek()
            if kind != "op" or BINDING.get(op, 0) < least:
                return left
            self.take()
            left = Node(op, (left, self.binary(BINDING[op] + 1, depth)))

    def unary(self, depth: int) -> Node:
        if depth + NESTING > MAX_DEPTH:
            raise FilterError("nested too deeply")
        kind, text = self.peek()
        if kind == "op" and text in "!-+":
            self.take()
            return Node("u" + text, (self.unary(depth + 1),))
        return self.primary(depth)

    def primary(self, depth: int) -> Node:
        kind, text = self.take()
        if (kind, text) == ("op", "("):
            inner = self.binary(1, depth + NESTING)
            self.expect("op", ")")
            return inner
        if kind == "number":
            digits = text.replace("_", "")
            if re.fullmatch("[0-9]+", digits):
                if int(digits) > I64_MAX:
                    raise FilterError(f"{text} doesn't fit 64 bits")
                return Node("literal", value=int(digits))
            return Node("literal", value=float(digits))
        if kind == "word" and text in ("true", "false"):
            return Node("literal", value=text == "true")
        if kind == "word" and text in ("SOURCE", "TARGET"):
            self.expect("op", ".")
            name = self.expect("word")
            if name not in PROPERTIES:
                raise FilterError(f"{text} has no property {name}")
            return Node("property", value=(text, name))
        raise FilterError(f"unexpected {text or 'end'}")


def parse(text: str) -> Node:
    parser = _Parser(text)
    tree = parser.binary(1, 0)
    if parser.peek()[0] != "end":
        raise FilterError(f"unexpected {parser.peek()[1]}")
    return tree


def mentions_target(tree: Node) -> bool:
    return tree.op == "property" and tree.value[0] == "TARGET" or any(map(mentions_target, tree.args))


def _checked(n: int) -> int | None:
    return n if I64_MIN <= n <= I64_MAX else None


def _number(op: str, a, b):  # noqa: ANN001, ANN202
    if isinstance(a, int) and isinstance(b, int):
        if op in "/%":
            if b == 0 or a == I64_MIN and b == -1:
                return None
            q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            return q if op == "/" else a - q * b
        return _checked({"+": a + b, "-": a - b, "*": a * b}[op])
    a, b = float(a), float(b)
    if op == "/":
        if b == 0:
            return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1.0, b)
        return a / b
    if op == "%":
        return math.nan if b == 0 or math.isinf(a) else math.fmod(a, b)
    return {"+": a + b, "-": a - b, "*": a * b}[op]


def evaluate(tree: Node, row: dict[tuple[str, str], int | None]) -> int | float | bool | None:
    """The value for plain properties; ``None`` is an error."""
    if tree.op == "literal":
        return tree.value
    if tree.op == "property":
        return row.get(tree.value)
    if tree.op in ("&&", "||"):
        left = evaluate(tree.args[0], row)
        if not isinstance(left, bool):
            return None
        if left == (tree.op == "||"):
            return left
        right = evaluate(tree.args[1], row)
        return right if isinstance(right, bool) else None
    values = [evaluate(a, row) for a in tree.args]
    if any(v is None for v in values):
        return None
    flags = [isinstance(v, bool) for v in values]
    if tree.op == "u!":
        return not values[0] if flags[0] else None
    if tree.op in ("u-", "u+"):
        if flags[0]:
            return None
        return values[0] if tree.op == "u+" else _checked(-values[0]) if isinstance(values[0], int) else -values[0]
    a, b = values
    if tree.op in ("==", "!="):
        same = flags[0] == flags[1] and (a == b if isinstance(a, type(b)) else float(a) == float(b))
        return same == (tree.op == "==")
    if any(flags):
        return None
    if tree.op in COMPARISONS:
        if type(a) is not type(b):
            a, b = float(a), float(b)
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[tree.op]
    return _number(tree.op, a, b)


def compile_filter(text: str, diff: bool = False) -> Node:
    """Parse and check a filter; ``TARGET`` needs two sides."""
    if len(text.encode()) > MAX_BYTES:
        raise FilterError(f"longer than {MAX_BYTES} bytes")
    if '"' in text or "'" in text:
        raise FilterError("quotes are not allowed")
    tree = parse(text)
    if mentions_target(tree) and not diff:
        raise FilterError("TARGET needs a diff")
    zeros = {(side, p): 0 for side in ("SOURCE", "TARGET") for p in PROPERTIES}
    if not isinstance(evaluate(tree, zeros), bool):
        raise FilterError("not a condition")
    return tree


# --- columns -------------------------------------------------------------

_NULL = {"int": "bigint", "float": "double", "bool": "boolean", "error": "boolean"}


def _int_division(op: str, a: Column, b: Column) -> Column:
    bad = (b == 0) | ((a == F.lit(I64_MIN)) & (b == -1))
    safe = F.when(bad, F.lit(1)).otherwise(b)
    return F.when(bad, F.lit(None).cast("bigint")).otherwise(_div(a, safe) if op == "/" else F.try_mod(a, safe))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _float_division(op: str, a: Column, b: Column) -> Column:
    safe = F.when(b == 0, F.lit(1.0)).otherwise(b)
    if op == "%":
        return F.when(b == 0, F.lit(math.nan)).otherwise(a % safe)
    below = (b.cast("string") == "-0.0") != (a < 0)
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(math.nan)).when(below, F.lit(-math.inf)).otherwise(F.lit(math.inf))
    return F.when(b == 0, at_zero).otherwise(a / safe)


def _compare(op: str, a: Column, b: Column, floats: bool) -> Column:
    c = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    return F.when(F.isnan(a) | F.isnan(b), F.lit(op == "!=")).otherwise(c) if floats else c


def _column(tree: Node, bind: dict[tuple[str, str], Column]) -> tuple[Kind, Column]:
    error = ("error", F.lit(None).cast("boolean"))
    if tree.op == "literal":
        if isinstance(tree.value, bool):
            return "bool", F.lit(tree.value)
        return ("int", F.lit(tree.value).cast("bigint")) if isinstance(tree.value, int) else ("float", F.lit(tree.value))
    if tree.op == "property":
        return "int", bind[tree.value].try_cast("bigint")
    kinds, cols = zip(*[_column(a, bind) for a in tree.args])
    if tree.op in ("&&", "||"):
        if kinds[0] != "bool":
            return error
        right = cols[1] if kinds[1] == "bool" else F.lit(None).cast("boolean")
        stop = cols[0] if tree.op == "||" else ~cols[0]
        return "bool", F.when(cols[0].isNull(), F.lit(None).cast("boolean")).when(stop, cols[0]).otherwise(right)
    if "error" in kinds:
        return error
    if tree.op == "u!":
        return ("bool", ~cols[0]) if kinds[0] == "bool" else error
    if tree.op in ("u-", "u+"):
        if kinds[0] == "bool":
            return error
        if tree.op == "u+":
            return kinds[0], cols[0]
        return kinds[0], F.try_subtract(F.lit(0).cast("bigint"), cols[0]) if kinds[0] == "int" else -cols[0]
    a, b = cols
    numbers = "bool" not in kinds
    if tree.op in ("==", "!=") and kinds.count("bool") == 1:
        return "bool", F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(tree.op == "!="))
    if tree.op in ("==", "!=") and not numbers:
        return "bool", a == b if tree.op == "==" else a != b
    if not numbers:
        return error
    floats = "float" in kinds
    if floats:
        a, b = a.cast("double"), b.cast("double")
    if tree.op in COMPARISONS:
        return "bool", _compare(tree.op, a, b, floats)
    if tree.op in "/%":
        return ("float", _float_division(tree.op, a, b)) if floats else ("int", _int_division(tree.op, a, b))
    if floats:
        return "float", {"+": a + b, "-": a - b, "*": a * b}[tree.op]
    return "int", {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[tree.op](a, b)


def total(tree: Node) -> bool:
    """Whether the filter can't be an error on non-null 64-bit properties, so that a plain, pushable form will do."""
    if tree.op in ("&&", "||", "u!"):
        return all(map(total, tree.args))
    return tree.op in COMPARISONS and {a.op for a in tree.args} <= {"property", "literal"} and all(a.op == "property" or type(a.value) is int for a in tree.args)


def _plain(tree: Node, bind: dict[tuple[str, str], Column]) -> Column:
    if tree.op == "u!":
        return ~_plain(tree.args[0], bind)
    if tree.op in ("&&", "||"):
        a, b = (_plain(x, bind) for x in tree.args)
        return a & b if tree.op == "&&" else a | b
    a, b = (bind[x.value] if x.op == "property" else F.lit(x.value).cast("bigint") for x in tree.args)
    return _compare(tree.op, a, b, False)


def bindings(source: dict[str, Column], target: dict[str, Column] | None = None) -> dict[tuple[str, str], Column]:
    out = {("SOURCE", p): source[c] for p, c in PROPERTIES.items()}
    return out | ({("TARGET", p): target[c] for p, c in PROPERTIES.items()} if target else {})


def value_column(tree: Node, bind: dict[tuple[str, str], Column]) -> Column:
    """The filter's value: true, false, or null for an error."""
    return _column(tree, bind)[1]


def keep_column(tree: Node, bind: dict[tuple[str, str], Column], exact_longs: bool = False) -> Column:
    """Whether a row stays. ``exact_longs``: the properties are non-null 64-bit integers, so a total filter goes to the scan."""
    if exact_longs and total(tree):
        return _plain(tree, bind)
    return F.coalesce(value_column(tree, bind), F.lit(True))
