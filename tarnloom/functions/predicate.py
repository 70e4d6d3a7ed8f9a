"""Predicates over image metadata, compiled to Columns.

An expression is parsed with Python's ``ast`` and translated node by node; only
the node kinds below have a translation, so nothing can be called or reached
but ``regex``. Logic has two values: a comparison with a missing value is false
(``!=`` is true if exactly one side is missing), and every translated condition
is a total boolean, so ``not`` never meets null. Types are checked when
compiling: the rules are Python's, not the engine's casts.
"""

from __future__ import annotations

import ast
import datetime
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SpecError

#: field -> (type, needs the label context)
FIELDS: dict[str, tuple[str, bool]] = {
    "file_name": ("text", False),
    "original_set": ("text", False),
    "batch_version": ("text", False),
    "blake3_hash": ("text", False),
    "subject_id": ("text", False),
    "width": ("number", False),
    "height": ("number", False),
    "area": ("number", False),
    "date_captured": ("date", False),
    "labels": ("texts", True),
    "targets": ("texts", True),
    "annotators": ("texts", True),
    "n_annotations": ("number", True),
}
ORDER = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
#: Python pattern parts that Java reads otherwise or not at all
UNSHARED = re.compile(r"\(\?P|\\Z|\\z|\(\?\(|\(\?#|\\N\{|\(\?[aLu]")


@dataclass
class Value:
    kind: str  # text, number, date, texts, flag, none, items
    column: Column | None
    constant: Any = None
    items: list[Value] | None = None

    @property
    def fixed(self) -> bool:
        return self.column is None


@dataclass
class Predicate:
    """``condition`` over image columns; ``context`` tells whether labels are needed."""

    condition: Column
    context: bool


def compile_predicate(expression: str) -> Predicate:
    try:
        tree = ast.parse(expression, mode="eval")
    except (SyntaxError, ValueError) as error:
        raise SpecError(f"predicate {expression!r} can't be parsed: {error}") from None
    compiler = _Compiler(expression)
    return Predicate(compiler.condition(tree.body), compiler.context)


class _Compiler:
    def __init__(self, expression: str):
        self.expression = expression
        self.context = False

    def refuse(self, why: str) -> SpecError:
        return SpecError(f"predicate {self.expression!r}: {why}")

    # conditions: total booleans

    def condition(self, node: ast.expr) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [self.condition(v) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~self.condition(node.operand)
        if isinstance(node, ast.Compare):
            return self.comparison(node)
        if isinstance(node, ast.Call):
            return self.regex(node)
        return self.truth(self.value(node))

    def truth(self, v: Value) -> Column:
        if v.fixed:
            return F.lit(bool(v.items if v.kind == "items" else v.constant))
        some = {"text": v.column != "", "number": v.column != 0, "texts": F.size(v.column) > 0}.get(v.kind, v.column.isNotNull())
        return F.coalesce(some, F.lit(False))

    def comparison(self, node: ast.Compare) -> Column:
        values = [self.value(v) for v in (node.left, *node.comparators)]
        out = F.lit(True)
        for left, op, right in zip(values, node.ops, values[1:]):
            out = out & self.compare(left, op, right)
        return out

    def compare(self, a: Value, op: ast.cmpop, b: Value) -> Column:
        if isinstance(op, (ast.Is, ast.IsNot)):
            if "none" not in (a.kind, b.kind):
                raise self.refuse("'is' compares with None only")
            other = b if a.kind == "none" else a
            missing = F.lit(other.kind == "none") if other.fixed else other.column.isNull()
            return missing if isinstance(op, ast.Is) else ~missing
        if isinstance(op, (ast.In, ast.NotIn)):
            inside = self.member(a, b)
            return inside if isinstance(op, ast.In) else ~inside
        if isinstance(op, ast.NotEq):
            return self.unequal(a, b)
        if "none" in (a.kind, b.kind):
            return F.lit(False)
        if isinstance(op, ast.Eq):
            a, b = self.dated(a, b)
            if a.kind != b.kind:
                return F.lit(False)
            return F.coalesce(self.column(a) == self.column(b), F.lit(False))
        a, b = self.dated(a, b)
        if a.kind != b.kind or a.kind in ("items", "texts"):
            raise self.refuse(f"{a.kind} and {b.kind} have no order")
        return F.coalesce(getattr(self.column(a), ORDER[type(op)])(self.column(b)), F.lit(False))

    def unequal(self, a: Value, b: Value) -> Column:
        if a.kind == "none" and b.kind == "none":
            return F.lit(False)
        if "none" in (a.kind, b.kind):
            other = b if a.kind == "none" else a
            return F.lit(True) if other.fixed else other.column.isNotNull()
        a, b = self.dated(a, b)
        if a.kind != b.kind:
            # values of different types differ; two missing ones do not
            both = [v.column.isNull() for v in (a, b) if not v.fixed]
            return ~(both[0] & both[1]) if len(both) == 2 else F.lit(True)
        return ~self.column(a).eqNullSafe(self.column(b))

    def member(self, a: Value, b: Value) -> Column:
        if b.kind == "items":
            fits = [i for i in b.items if (a.kind == i.kind or "none" in (a.kind, i.kind))]
            out = F.lit(False)
            for i in fits:
                if i.kind == "none":
                    out = out | (F.lit(a.kind == "none") if a.fixed else a.column.isNull())
                elif a.kind != "none":
                    out = out | F.coalesce(self.column(a) == self.column(i), F.lit(False))
            return out
        if b.kind == "texts":
            if a.kind != "text":
                return F.lit(False)
            found = F.array_contains(b.column, self.column(a))
            return F.coalesce(found, F.lit(False))
        if b.kind == "text":
            if a.kind != "text":
                raise self.refuse("only a string can be searched in a string")
            return F.coalesce(self.column(b).contains(self.column(a)), F.lit(False))
        raise self.refuse(f"'in' needs a list or a string, not {b.kind}")

    def regex(self, node: ast.Call) -> Column:
        if not (isinstance(node.func, ast.Name) and node.func.id == "regex" and len(node.args) == 2 and not node.keywords):
            raise self.refuse("regex(field, pattern) is the only call")
        field, pattern = self.value(node.args[0]), self.value(node.args[1])
        if not pattern.fixed or pattern.kind != "text":
            raise self.refuse("the pattern must be a string")
        try:
            re.compile(pattern.constant)
        except re.error as error:
            raise self.refuse(f"pattern {pattern.constant!r}: {error}") from None
        if UNSHARED.search(pattern.constant):
            raise self.refuse(f"pattern {pattern.constant!r} uses a construct that engines read differently")
        if field.kind == "none":
            return F.lit(False)
        return F.coalesce(self.column(field).cast("string").rlike(f"(?U){pattern.constant}"), F.lit(False))

    # values

    def column(self, v: Value) -> Column:
        return F.lit(v.constant) if v.fixed else v.column

    def dated(self, a: Value, b: Value) -> tuple[Value, Value]:
        """A string next to a date is read as an ISO date."""

        def read(v: Value) -> Value:
            try:
                return Value("date", None, datetime.date.fromisoformat(v.constant))
            except ValueError:
                raise self.refuse(f"{v.constant!r} is no date") from None

        if a.kind == "date" and b.kind == "text" and b.fixed:
            return a, read(b)
        if b.kind == "date" and a.kind == "text" and a.fixed:
            return read(a), b
        return a, b

    def value(self, node: ast.expr) -> Value:
        if isinstance(node, ast.Constant):
            c = node.value
            for kind, types in (("none", type(None)), ("flag", bool), ("number", (int, float)), ("text", str)):
                if isinstance(c, types):
                    return Value("number" if kind == "flag" else kind, None, int(c) if kind == "flag" else c)
            raise self.refuse(f"constant {c!r}")
        if isinstance(node, (ast.List, ast.Tuple)):
            items = [self.value(e) for e in node.elts]
            if any(not i.fixed for i in items):
                raise self.refuse("lists hold constants only")
            return Value("items", None, None, items)
        if isinstance(node, ast.Name):
            if node.id not in FIELDS:
                raise self.refuse(f"unknown field {node.id}; known are {', '.join(FIELDS)}")
            kind, context = FIELDS[node.id]
            self.context |= context
            return Value(kind, F.col("width") * F.col("height") if node.id == "area" else F.col(node.id))
        raise self.refuse(f"{type(node).__name__} is not allowed")
