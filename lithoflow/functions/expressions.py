"""A small safe expression language over attribute names, compiled to column expressions.

Text is parsed with :mod:`ast`, every node is checked against a list, and each node
becomes the matching column operation. Nothing is ever evaluated as Python.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithoflow.functions.missing import INF, greatest_prop, least_prop, no_nan, safe_divide

Formula = Callable[[Mapping[str, Column]], Column]


def _where(c: Column, a: Column, b: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), a).otherwise(b)


def _log(c: Column, log: Callable[[Column], Column]) -> Column:
    return F.when(c == 0, F.lit(-INF)).when(c > 0, log(c))


#: Function name: number of arguments and column form. Missing values propagate.
FUNCTIONS = {
    "maximum": (2, greatest_prop),
    "minimum": (2, least_prop),
    "where": (3, _where),
    "exp": (1, F.exp),
    "sqrt": (1, lambda c: F.when(c >= 0, F.sqrt(c))),
    "log": (1, lambda c: _log(c, F.ln)),
    "log10": (1, lambda c: _log(c, F.log10)),
    "abs": (1, F.abs),
    "clip": (3, lambda c, lo, hi: least_prop(greatest_prop(c, lo), hi)),
}
_ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: no_nan(a * b),
    ast.Div: safe_divide,
    ast.FloorDiv: lambda a, b: F.floor(safe_divide(a, b)).cast("double"),
    ast.Mod: lambda a, b: F.when(b != 0, a - b * F.floor(a / F.when(b != 0, b)).cast("double")),
    ast.Pow: lambda a, b: no_nan(F.pow(a, b)),
}
_COMPARE = {
    ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}


def _check(node: ast.AST, names: set[str]) -> None:
    def bad(what: str):
        raise ValueError(f"expression: {what} is not allowed")

    match node:
        case ast.Expression(body=body):
            _check(body, names)
        case ast.BinOp(left=a, op=op, right=b):
            if type(op) not in _ARITHMETIC:
                bad(type(op).__name__)
            _check(a, names), _check(b, names)
        case ast.UnaryOp(op=op, operand=a):
            if not isinstance(op, ast.UAdd | ast.USub):
                bad(type(op).__name__)
            _check(a, names)
        case ast.BoolOp(values=values):
            for v in values:
                _check(v, names)
        case ast.Compare(left=a, ops=ops, comparators=rest):
            if len(ops) > 1:
                bad("a chained comparison")
            if type(ops[0]) not in _COMPARE:
                bad(type(ops[0]).__name__)
            _check(a, names), _check(rest[0], names)
        case ast.Call(func=f, args=args, keywords=keywords):
            if not isinstance(f, ast.Name) or f.id not in FUNCTIONS:
                bad("a call of anything but " + ", ".join(sorted(FUNCTIONS)))
            if keywords or any(isinstance(a, ast.Starred) for a in args):
                bad("a keyword or starred argument")
            if len(args) != FUNCTIONS[f.id][0]:
                raise ValueError(f"expression: {f.id} takes {FUNCTIONS[f.id][0]} argument(s)")
            for a in args:
                _check(a, names)
        case ast.Name(id=name):
            if name not in names:
                bad(f"the name {name!r}")
        case ast.Constant(value=value):
            if isinstance(value, bool) or not isinstance(value, int | float):
                bad(f"the constant {value!r}")
        case _:
            bad(type(node).__name__)


def _column(node: ast.AST, values: Mapping[str, Column]) -> Column:
    match node:
        case ast.BinOp(left=a, op=op, right=b):
            return _ARITHMETIC[type(op)](_number(a, values), _number(b, values))
        case ast.UnaryOp(op=ast.USub(), operand=a):
            return -_number(a, values)
        case ast.UnaryOp(operand=a):
            return _number(a, values)
        case ast.BoolOp(op=op, values=parts):
            cols = [_truth(v, values) for v in parts]
            out = cols[0]
            for c in cols[1:]:
                out = out & c if isinstance(op, ast.And) else out | c
            return out
        case ast.Compare(left=a, ops=[op], comparators=[b]):
            return _COMPARE[type(op)](_number(a, values), _number(b, values))
        case ast.Call(func=f, args=[test, *rest]) if f.id == "where":
            return _where(_truth(test, values), *(_number(a, values) for a in rest))
        case ast.Call(func=f, args=args):
            return FUNCTIONS[f.id][1](*(_number(a, values) for a in args))
        case ast.Name(id=name):
            return values[name]
        case ast.Constant(value=value):
            return F.lit(float(value))
    raise ValueError(f"expression: {type(node).__name__} is not allowed")


def _is_test(node: ast.AST) -> bool:
    return isinstance(node, ast.Compare | ast.BoolOp)


def _number(node: ast.AST, values: Mapping[str, Column]) -> Column:
    """A comparison used as a number counts 1 or 0; with a missing side it is 0."""
    c = _column(node, values)
    return F.coalesce(c, F.lit(False)).cast("double") if _is_test(node) else c


def _truth(node: ast.AST, values: Mapping[str, Column]) -> Column:
    c = _column(node, values)
    return c if _is_test(node) else c != 0


def compile_expr(text: str, attributes: Iterable[str]) -> Formula:
    """Compile ``text`` to a function from columns by name to one column; ``.expr`` keeps the source."""
    if not isinstance(text, str):
        raise ValueError(f"expression must be text, got {text!r}")
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise ValueError(f"invalid expression {text!r}: {e}") from e
    _check(tree, set(attributes))

    def formula(values: Mapping[str, Column]) -> Column:
        return _column(tree.body, values)

    formula.expr = text
    return formula
