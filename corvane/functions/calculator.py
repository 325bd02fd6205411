"""The calculator tool: arithmetic over a parsed expression; nothing is ever evaluated as code."""

from __future__ import annotations

import ast
import math
import operator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: operator.truediv,
    ast.Mod: operator.mod,
    ast.Pow: operator.pow,
    ast.USub: operator.neg,
    ast.UAdd: operator.pos,
}
FUNCTIONS = {n: getattr(math, n) for n in ("sqrt", "sin", "cos", "tan", "exp", "log", "log10", "floor", "ceil")} | {"abs": abs, "min": min, "max": max, "round": round}
CONSTANTS = {"pi": math.pi, "e": math.e}
LARGEST_POWER = 1000


def evaluate(expression: str) -> float:
    """The value of an arithmetic expression (^ is a power); ValueError if it is anything else."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.Name) and node.id in CONSTANTS:
            return CONSTANTS[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
            left, right = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and abs(right) > LARGEST_POWER:
                raise ValueError("power too large")
            return OPERATORS[type(node.op)](left, right)
        if isinstance(node, ast.UnaryOp) and type(node.op) in OPERATORS:
            return OPERATORS[type(node.op)](value(node.operand))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords:
            return FUNCTIONS[node.func.id](*map(value, node.args))
        raise ValueError("not arithmetic")

    try:
        return float(value(ast.parse(expression.replace("^", "**"), mode="eval")))
    except (SyntaxError, TypeError, ArithmeticError, RecursionError, MemoryError) as e:
        raise ValueError(str(e)) from e


@F.pandas_udf(T.DoubleType())
def calculate(expressions: pd.Series) -> pd.Series:
    """evaluate() of each expression; null where it fails."""

    def one(x: str | None) -> float | None:
        try:
            return evaluate(x) if x else None
        except ValueError:
            return None

    return expressions.map(one).astype("float64")
