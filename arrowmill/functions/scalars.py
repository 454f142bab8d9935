"""Scalar functions by name. Each takes and gives Values.

Choices where the language leaves room: substring counts from 0 and its second
argument is the end; between includes both bounds; division gives a Float;
a comparison with an empty value is empty, and filters keep what is true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AnalysisError, Rule
from ..model.catalog import NUMERIC, ONE, SPARK, TEMPORAL
from ..plans.frame import Value


def family(kind: str) -> str:
    if kind in NUMERIC:
        return "number"
    return "date" if kind in TEMPORAL else kind


def made(col: Column, kind: str, *values: Value, loose: bool = False) -> Value:
    many = ONE
    for v in values:
        if v.many.lower == 0:
            many = v.many
    return Value(col, kind, many, frozenset().union(*(v.of for v in values)), loose or any(v.loose for v in values))


def single(*values: Value) -> None:
    for v in values:
        if not v.many.to_one:
            raise AnalysisError(Rule.MULTIPLICITY, "a collection stands where a single value is needed")


def _text(v: Value, what: str) -> Value:
    single(v)
    if v.type not in ("String", "Any") and not v.loose:
        raise AnalysisError(Rule.STRING_RECEIVER, f"{what} on {v.type}")
    return v


def wider(a: str, b: str) -> str:
    for kind in ("Number", "Float", "Decimal"):
        if kind in (a, b):
            return kind
    return "Integer"


def arithmetic(op: str, a: Value, b: Value) -> Value:
    single(a, b)
    if op == "+" and (a.type == "String" or b.type == "String"):
        if not (a.type == b.type == "String" or a.loose or b.loose):
            raise AnalysisError(Rule.OPERAND_TYPE, f"{a.type} + {b.type}")
        return made(F.concat(a.col.cast("string"), b.col.cast("string")), "String", a, b)
    for v in (a, b):
        if v.type not in NUMERIC | {"Any"}:
            raise AnalysisError(Rule.OPERAND_TYPE, f"{a.type} {op} {b.type}")
    if op == "/":
        return made(a.col.cast("double") / b.col.cast("double"), "Float", a, b)
    col = {"+": lambda: a.col + b.col, "-": lambda: a.col - b.col, "*": lambda: a.col * b.col}[op]()
    return made(col, wider(a.type, b.type), a, b)


def comparison(op: str, a: Value, b: Value) -> Value:
    x, y = a.col, b.col
    if op not in ("==", "!="):
        single(a, b)
        for v, w in ((a, b), (b, a)):
            if family(v.type) not in ("number", "date", "Any") and not (v.loose or w.loose):
                raise AnalysisError(Rule.COMPARISON, f"{a.type} {op} {b.type}")
    if family(a.type) != family(b.type) and "Any" not in (a.type, b.type):
        if not (a.loose or b.loose):
            raise AnalysisError(Rule.OPERAND_TYPE, f"{a.type} {op} {b.type}")
        # A getter's column decides; the other side is read as its type.
        if a.literal is not None:
            x = x.try_cast(SPARK.get(b.type, "string"))
        else:
            y = y.try_cast(SPARK.get(a.type, "string"))
    elif family(a.type) == "date" and {a.type, b.type} == {"StrictDate", "DateTime"}:
        x, y = x.cast("timestamp_ntz"), y.cast("timestamp_ntz")
    col = {"==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()
    return made(col, "Boolean", a, b)


def _substring(v: Value, start: Value, end: Value | None = None) -> Value:
    _text(v, "substring")
    length = F.lit(2**31 - 1) if end is None else F.greatest(end.col - start.col, F.lit(0))
    return made(F.substr(v.col, (start.col + 1).cast("int"), length.cast("int")), "String", v, start, *([end] if end else []))


def _at_most(n: int, m: int | None = None):
    return n, n if m is None else m


FUNCTIONS = {
    "toLower": (_at_most(1), lambda v: made(F.lower(_text(v, "toLower").col), "String", v)),
    "toUpper": (_at_most(1), lambda v: made(F.upper(_text(v, "toUpper").col), "String", v)),
    "toString": (_at_most(1), lambda v: made(v.col.cast("string"), "String", v)),
    "length": (_at_most(1), lambda v: made(F.char_length(_text(v, "length").col).cast("bigint"), "Integer", v)),
    "trim": (_at_most(1), lambda v: made(F.trim(_text(v, "trim").col), "String", v)),
    "substring": (_at_most(2, 3), _substring),
    "parseInteger": (_at_most(1), lambda v: made(_text(v, "parseInteger").col.cast("bigint"), "Integer", v)),
    "parseFloat": (_at_most(1), lambda v: made(_text(v, "parseFloat").col.cast("double"), "Float", v)),
    "year": (_at_most(1), lambda v: made(F.year(_date(v).col).cast("bigint"), "Integer", v)),
    "monthNumber": (_at_most(1), lambda v: made(F.month(_date(v).col).cast("bigint"), "Integer", v)),
    "dayOfMonth": (_at_most(1), lambda v: made(F.dayofmonth(_date(v).col).cast("bigint"), "Integer", v)),
    "startsWith": (_at_most(2), lambda v, w: made(_text(v, "startsWith").col.startswith(w.col), "Boolean", v, w)),
    "endsWith": (_at_most(2), lambda v, w: made(_text(v, "endsWith").col.endswith(w.col), "Boolean", v, w)),
    "contains": (_at_most(2), lambda v, w: made(v.col.contains(w.col) if v.type == "String" else v.col == w.col, "Boolean", v, w)),
    "between": (_at_most(3), lambda v, a, b: _between(v, a, b)),
    "isEmpty": (_at_most(1), lambda v: made(v.col.isNull(), "Boolean", v)),
    "isNotEmpty": (_at_most(1), lambda v: made(v.col.isNotNull(), "Boolean", v)),
    "toOne": (_at_most(1), lambda v: Value(v.col, v.type, ONE, v.of, v.loose, v.name)),
    "floor": (_at_most(1), lambda v: made(F.floor(_number(v).col).cast("bigint"), "Integer", v)),
    "ceiling": (_at_most(1), lambda v: made(F.ceil(_number(v).col).cast("bigint"), "Integer", v)),
    "abs": (_at_most(1), lambda v: made(F.abs(_number(v).col), v.type, v)),
    "mod": (_at_most(2), lambda v, w: made(F.pmod(_number(v).col, _number(w).col), wider(v.type, w.type), v, w)),
    "rem": (_at_most(2), lambda v, w: made(_number(v).col % _number(w).col, wider(v.type, w.type), v, w)),
    "plus": (_at_most(2), lambda v, w: arithmetic("+", v, w)),
    "minus": (_at_most(2), lambda v, w: arithmetic("-", v, w)),
    "times": (_at_most(2), lambda v, w: arithmetic("*", v, w)),
    "divide": (_at_most(2), lambda v, w: arithmetic("/", v, w)),
    "equal": (_at_most(2), lambda v, w: comparison("==", v, w)),
    "toBytes": (_at_most(1), lambda v: made(F.encode(_text(v, "toBytes").col, "UTF-8"), "Any", v)),
}


def _number(v: Value) -> Value:
    single(v)
    if v.type not in NUMERIC | {"Any"}:
        raise AnalysisError(Rule.OPERAND_TYPE, f"a number is expected, not {v.type}")
    return v


def _date(v: Value) -> Value:
    single(v)
    if v.type not in TEMPORAL | {"Any"}:
        raise AnalysisError(Rule.OPERAND_TYPE, f"a date is expected, not {v.type}")
    return v


def _between(v: Value, a: Value, b: Value) -> Value:
    low, high = comparison(">=", v, a), comparison("<=", v, b)
    return made(low.col & high.col, "Boolean", v, a, b)


def constant(name: str) -> Value | None:
    """Functions without arguments; Spark binds them once per query."""
    if name == "today":
        return Value(F.current_date(), "StrictDate")
    if name == "now":
        return Value(F.localtimestamp(), "DateTime")
    return None


def cast(v: Value, kind: str) -> Value:
    if kind not in SPARK:
        return v
    return made(v.col.cast(SPARK[kind]), kind, v)
