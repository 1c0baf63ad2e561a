"""Arithmetic over field names, compiled to columns with Python's rounding rules."""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, b: Column) -> Column:
    """Whole-number division that rounds down, exact to 64 bits; null for a zero divisor."""
    d = F.when(b != 0, b).cast("bigint")
    n = a.cast("bigint")
    return F.call_function("div", n - floor_mod(n, d), d)


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    d = F.when(b != 0, b)
    return ((a % d) + d) % d


OPERATORS = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: a / F.when(b != 0, b),
    ast.FloorDiv: floor_div,
    ast.Mod: floor_mod,
}


def fractional(node: ast.AST) -> bool:
    """Whether an operand has a fraction: a number with a point, or a division."""
    return any(isinstance(n, ast.Div) or (isinstance(n, ast.Constant) and isinstance(n.value, float)) for n in ast.walk(node))


def compiled(text: str, fields: Mapping[str, Column]) -> Column:
    """A column for + - * / // % over numbers and field names; anything else is refused."""

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
            left, right = build(node.left), build(node.right)
            if isinstance(node.op, ast.FloorDiv) and fractional(node):
                return F.floor(left / F.when(right != 0, right))
            return OPERATORS[type(node.op)](left, right)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            if node.id not in fields:
                raise ValueError(f"no field {node.id!r} in {text!r}")
            return fields[node.id]
        raise ValueError(f"not allowed in {text!r}: {type(node).__name__}")

    return build(ast.parse(text, mode="eval").body)
