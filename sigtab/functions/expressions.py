"""Formula text to a Column: a fixed list of names and operators, nothing is evaluated in Python."""

from __future__ import annotations

import ast
import math
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sigtab.functions.numeric import div

UNARY = {
    "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)),
    "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp,
    "log": lambda c: F.when(c > 0, F.log(c)),
}
BINARY = {
    "minimum": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
    "maximum": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
}
AGGREGATES = {
    "mean": F.avg, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "std": F.stddev_pop,
    "var": F.var_pop, "min": F.min, "max": F.max, "len": lambda c: F.count(F.lit(1)).cast("double"),
}
CONSTANTS = {"pi": math.pi, "e": math.e}
BINARY_OPERATORS = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b,
    ast.Div: div, ast.Pow: F.pow, ast.Mod: lambda a, b: F.pmod(a, F.when(b != 0, b)),
}


def split_names(text: str) -> tuple[str, dict[str, str]]:
    """Replace `` `any name` `` by plain identifiers."""
    names: dict[str, str] = {}

    def put(match):
        ident = f"_q{len(names)}_"
        names[ident] = match.group(1)
        return ident

    return re.sub(r"`([^`]+)`", put, text.strip()), names


class Compiler:
    """Turns one formula into a Column.

    ``column`` resolves a name, ``aggregate(kind, arg)`` and ``ordered(kind, args, options)``
    resolve the calls that need more than the current row.
    """

    unary, binary, operators = UNARY, BINARY, BINARY_OPERATORS
    constant, rounded = staticmethod(F.lit), staticmethod(F.bround)

    def __init__(self, column, aggregate=None, ordered=None):
        self.column, self.aggregate, self.ordered = column, aggregate, ordered

    def compile(self, text: str) -> Column:
        if not text or not text.strip():
            raise ValueError("the formula is empty")
        plain, self.names = split_names(text)
        try:
            tree = ast.parse(plain, mode="eval")
        except SyntaxError as error:
            raise ValueError(f"cannot read the formula: {text}") from error
        return self.visit(tree.body)

    def visit(self, node) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return self.constant(float(node.value))
        if isinstance(node, ast.Name):
            name = self.names.get(node.id, node.id)
            if node.id not in self.names and name in CONSTANTS:
                try:
                    return self.column(name)
                except KeyError:
                    return self.constant(CONSTANTS[name])
            return self.column(name)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            value = self.visit(node.operand)
            return -value if isinstance(node.op, ast.USub) else value
        if isinstance(node, ast.BinOp) and type(node.op) in self.operators:
            return self.operators[type(node.op)](self.visit(node.left), self.visit(node.right))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            return self.call(node.func.id, node)
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:60]}")

    def call(self, name: str, node: ast.Call) -> Column:
        if name in ("diff", "integrate") and self.ordered:
            options = {
                k.arg: k.value.value if isinstance(k.value, ast.Constant) else self.visit(k.value)
                for k in node.keywords
            }
            return self.ordered(name, [self.visit(a) for a in node.args], options)
        args = [self.visit(a) for a in node.args]
        if name in ("min", "max") and len(args) > 1:
            name = {"min": "minimum", "max": "maximum"}[name]
        if name in self.unary and len(args) == 1:
            return self.unary[name](args[0])
        if name in self.binary and len(args) == 2:
            return self.binary[name](*args)
        if name == "clip" and len(args) == 3:
            return self.binary["minimum"](self.binary["maximum"](args[0], args[1]), args[2])
        if name == "round" and len(args) in (1, 2):
            places = node.args[1].value if len(args) == 2 else 0
            return self.rounded(args[0], places)
        if name in AGGREGATES and len(args) == 1 and self.aggregate:
            return self.aggregate(name, args[0])
        raise ValueError(f"unknown function in a formula: {name}")


def _rest(a, b):
    left = np.fmod(a, b)
    return np.where(left < 0, np.fmod(left + b, b), left)


class ArrayCompiler(Compiler):
    """Evaluates one formula over arrays by the same rules; NaN stands where a column has null."""

    unary = {
        "sqrt": np.sqrt, "abs": np.abs, "sin": np.sin, "cos": np.cos, "tan": np.tan, "exp": np.exp,
        "log": lambda v: np.log(np.where(v > 0, v, np.nan)),
    }
    binary = {"minimum": np.minimum, "maximum": np.maximum}
    operators = {
        ast.Add: np.add, ast.Sub: np.subtract, ast.Mult: np.multiply, ast.Pow: lambda a, b: np.power(np.asarray(a, float), b),
        ast.Div: lambda a, b: np.divide(a, np.where(np.equal(b, 0), np.nan, b)),
        ast.Mod: lambda a, b: _rest(a, np.where(np.equal(b, 0), np.nan, b)),
    }
    constant, rounded = staticmethod(float), staticmethod(np.round)
