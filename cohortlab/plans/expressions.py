"""The expression language of programs, compiled to Columns.

Binding, weakest first: OR, XOR, AND, then LIKE and comparisons, & (join), + -, * / MOD %, ^ (from the right). NOT takes
a whole comparison, a sign one operand only, so -2^2 is 4. Logic has two values: a missing operand counts as false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions import scalars
from cohortlab.functions.missing import blank, finite, number, trimmed, yes_no

TOKEN = re.compile(
    r"""\s*(?:(?P<date>\d{1,2}/\d{1,2}/\d{4})|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|"(?P<text>[^"]*)"|\[(?P<quoted>[^\]]+)\]
    |(?P<constant>\([+\-.]\))|(?P<name>[A-Za-z_]\w*)|(?P<symbol><>|<=|>=|[-+*/^&=<>(),%]))""",
    re.X,
)
BINDING = {"OR": 1, "XOR": 2, "AND": 3, "LIKE": 4, "=": 4, "<>": 4, ">": 4, ">=": 4, "<": 4, "<=": 4, "&": 5, "+": 6, "-": 6, "*": 7, "/": 7, "MOD": 7, "%": 7, "^": 8}
FUNCTIONS = {"ABS": 1, "ROUND": 2, "STRLEN": 1, "UPPERCASE": 1}


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str  # literal, field, unary, binary, call
    value: object
    parts: tuple = ()


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:at + 10]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(text: str) -> Node:
    left = tokens(text)[::-1]

    def peek() -> str | None:
        if not left:
            return None
        kind, value = left[-1]
        return value.upper() if kind in ("name", "symbol") else None

    def need(symbol: str) -> None:
        if peek() != symbol:
            raise ExpressionError(f"expected {symbol}")
        left.pop()

    def operand() -> Node:
        if not left:
            raise ExpressionError("the expression ends too early")
        word = peek()
        kind, value = left.pop()
        if kind == "number":
            return Node("literal", float(value))
        if kind in ("text", "date"):
            return Node("literal", value)
        if kind == "constant":
            return Node("literal", {"(+)": True, "(-)": False, "(.)": None}[value])
        if word == "NOT":
            return Node("unary", "NOT", (binary(4),))
        if word in ("-", "+"):
            return Node("unary", word, (operand(),))
        if word == "(":
            inner = binary(1)
            need(")")
            return inner
        if kind == "name" and word in FUNCTIONS and peek() == "(":
            left.pop()
            parts = []
            while peek() != ")":
                parts.append(binary(1))
                if peek() == ",":
                    left.pop()
            left.pop()
            if not 1 <= len(parts) <= FUNCTIONS[word]:
                raise ExpressionError(f"{word} takes up to {FUNCTIONS[word]} arguments")
            return Node("call", word, tuple(parts))
        if kind in ("name", "quoted") and word not in BINDING:
            if kind == "name" and word in ("YES", "NO", "TRUE", "FALSE"):
                return Node("literal", word in ("YES", "TRUE"))
            return Node("field", value)
        raise ExpressionError(f"unexpected {value}")

    def binary(least: int) -> Node:
        node = operand()
        while (word := peek()) in BINDING and BINDING[word] >= least:
            left.pop()
            node = Node("binary", word, (node, binary(BINDING[word] + (word != "^"))))
        return node

    node = binary(1)
    if left:
        raise ExpressionError(f"unexpected {left[-1][1]}")
    return node


@dataclass
class Value:
    """A value as number, as text, as truth value, and whether it is missing."""

    number: Column
    text: Column
    truth: Column
    missing: Column
    kind: str


def field_named(df: DataFrame, name: str) -> str:
    found = [c for c in df.columns if c.lower() == name.lower()]
    if len(found) != 1:
        raise ExpressionError(f"{name}: {'no such field' if not found else 'ambiguous'}")
    return found[0]


def none() -> Column:
    return F.lit(None)


def _number(x: Column) -> Value:
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return Value(x, F.when(whole, F.format_string("%d", x.cast("long"))).otherwise(x.cast("string")), x != 0, x.isNull(), "number")


def _truth(x: Column) -> Value:
    return Value(none().cast("double"), F.when(x, "true").otherwise("false"), x, F.lit(False), "boolean")


def _text(x: Column) -> Value:
    return Value(number(x), x, yes_no(x), blank(x), "text")


def evaluate(node: Node, df: DataFrame, variables: dict[str, object] = {}, strict: bool = False) -> Value:
    """``strict`` is the rule of check code: a division by zero is an error, found while the result is computed; in selections
    it is missing."""
    if node.kind == "literal" or node.kind == "field" and node.value.lower() in variables:
        v = node.value if node.kind == "literal" else variables[node.value.lower()]
        if v is None:
            return Value(none().cast("double"), none().cast("string"), F.lit(False), F.lit(True), "missing")
        return _truth(F.lit(v)) if isinstance(v, bool) else _number(F.lit(float(v))) if isinstance(v, (int, float)) else _text(F.lit(v))
    if node.kind == "field":
        name = field_named(df, node.value)
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType.typeName()
        if kind == "boolean":
            return Value(none().cast("double"), c.cast("string"), c, c.isNull(), "boolean")
        if kind in ("string", "date", "timestamp", "timestamp_ntz"):
            return _text(c.cast("string"))
        return _number(finite(df, name))
    parts = [evaluate(p, df, variables, strict) for p in node.parts]
    holds = lambda v: F.coalesce(v.truth, F.lit(False)) & ~v.missing
    if node.kind == "unary":
        (a,) = parts
        return _truth(~holds(a)) if node.value == "NOT" else _number(-a.number if node.value == "-" else a.number)
    if node.kind == "call":
        x = parts[0]
        if node.value == "ABS":
            return _number(F.abs(x.number))
        if node.value == "ROUND":
            return _number(scalars.round_half_away(x.number, parts[1].number if len(parts) > 1 else F.lit(0.0)))
        if node.value == "STRLEN":
            return _number(F.when(~x.missing, F.length(x.text)).cast("double") if x.kind == "text" else none().cast("double"))
        return _text(F.when(~x.missing, F.upper(x.text)))
    a, b = parts
    op = node.value
    if op in ("AND", "OR", "XOR"):
        x, y = holds(a), holds(b)
        return _truth(x & y if op == "AND" else x | y if op == "OR" else x != y)
    if op == "&":
        return _text(F.concat(F.coalesce(a.text, F.lit("")), F.coalesce(b.text, F.lit(""))))
    if op in ("=", "<>", "<", "<=", ">", ">="):
        return _truth(_compare(op, a, b))
    if op == "LIKE":
        pattern = F.regexp_replace(b.text, r"([\\.\[\]{}()+?^$|])", r"\\$1")
        pattern = F.concat(F.lit("(?is)^"), F.replace(pattern, F.lit("*"), F.lit(".*")), F.lit("$"))
        return _truth(F.coalesce(F.regexp_like(a.text, pattern), F.lit(False)) & ~a.missing & ~b.missing)
    x, y = a.number, b.number
    some = F.when(y != 0, y)
    if strict:
        some = F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(y)
    return _number({"+": x + y, "-": x - y, "*": x * y, "/": x / some, "MOD": x % some, "%": x % some, "^": F.pow(x, y)}[op])


def _compare(op: str, a: Value, b: Value) -> Column:
    test = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    folded = lambda v: F.lower(trimmed(v.text))
    both = F.when(a.number.isNotNull() & b.number.isNotNull(), test(a.number, b.number)).otherwise(test(folded(a), folded(b)))
    either = a.missing | b.missing
    if op == "=":
        return F.when(either, a.missing & b.missing).otherwise(both)
    if op == "<>":
        return F.when(either, a.missing != b.missing).otherwise(both)
    return F.when(either, F.lit(False)).otherwise(both)


def condition(df: DataFrame, text: str, variables: dict[str, object] = {}) -> Column:
    """A selection. A lone comparison of a field with a literal never takes missing values, <> included."""
    node = parse(text)
    value = evaluate(node, df, variables)
    out = F.coalesce(value.truth, F.lit(False)) & ~value.missing
    if node.kind == "binary" and node.value == "<>" and node.parts[0].kind == "field" and node.parts[1].kind == "literal" and node.parts[1].value is not None:
        out = out & ~evaluate(node.parts[0], df, variables).missing
    if node.kind == "binary" and node.value in ("=", "<>") and [p.kind for p in node.parts] == ["field", "literal"] and isinstance(node.parts[1].value, bool):
        field = evaluate(node.parts[0], df, variables)
        same = field.truth == F.lit(node.parts[1].value)
        out = F.coalesce(same if node.value == "=" else ~same, F.lit(False))
    return out
