"""Reading the arguments of steps: names, columns, sort keys."""

from __future__ import annotations

from ..errors import AnalysisError, Rule
from ..language import ast
from ..plans.frame import ClassRow, Frame, Grouped, Row, ToMany, Value


def count(args, least: int, most: int | None, name: str) -> None:
    if len(args) < least or most is not None and len(args) > most:
        raise AnalysisError(Rule.ARITY, f"{name} takes {least if least == most else f'{least} to {most or 'more'}'} arguments, not {len(args)}")


def text(node: ast.Node, what: str) -> str:
    if not isinstance(node, ast.Literal) or node.kind != "String":
        raise AnalysisError(Rule.ARGUMENT_KIND, f"{what} takes a string")
    return node.value


def integer(node: ast.Node, what: str) -> int:
    if not isinstance(node, ast.Literal) or node.kind != "Integer" or node.value < 0:
        raise AnalysisError(Rule.ARGUMENT_KIND, f"{what} takes a literal integer")
    return node.value


def items(node: ast.Node) -> tuple[ast.Node, ...]:
    return node.items if isinstance(node, ast.ListOf) else (node,)


def names(node: ast.Node, what: str) -> list[str]:
    """~[a, b], ~a, 'a' or ['a', 'b']; no name twice."""
    if isinstance(node, ast.Columns):
        if any(c.function for c in node.items):
            raise AnalysisError(Rule.ARGUMENT_KIND, f"{what} takes column names")
        found = [c.name for c in node.items]
    else:
        found = [text(n, what) for n in items(node)]
    if len(set(found)) != len(found):
        raise AnalysisError(Rule.DUPLICATE_COLUMN, f"{what} names a column twice")
    return found


def sort_keys(node: ast.Node) -> list[tuple[str, bool, bool]]:
    """(column, descending, nulls first) of ascending(~a), ~a->descending(), asc('a'), a list of them, or a bare column."""
    if isinstance(node, ast.ListOf):
        return [k for n in node.items for k in sort_keys(n)]
    first = False
    while isinstance(node, ast.Call) and node.name in ("nullsFirst", "nullsLast") and len(node.args) == 1:
        first, node = node.name == "nullsFirst", node.args[0]
    if isinstance(node, ast.Call) and node.name in ("ascending", "descending", "asc", "desc") and len(node.args) == 1:
        return [(n, node.name.startswith("desc"), first) for n in names(node.args[0], node.name)]
    if isinstance(node, (ast.Columns, ast.Literal)):
        return [(n, False, first) for n in names(node, "sort")]
    raise AnalysisError(Rule.ARGUMENT_KIND, "a sort key is expected")


def resolved(compiler, frame: Frame, function: ast.Node, env: dict) -> Value:
    """A column's function for a row of `frame`; a projected collection multiplies rows."""
    compiler.frames = [*compiler.frames, frame]
    found = compiler.call(function, frame.row, env=env)
    compiler.frames = compiler.frames[:-1]
    if isinstance(found, ToMany):
        found = compiler.spread(found)
    return found if isinstance(found, (ClassRow, Row)) else compiler.value(found)


def as_value(found, what: str) -> Value:
    if isinstance(found, ClassRow):
        raise AnalysisError(Rule.ARGUMENT_KIND, f"{what} is an instance; name one of its properties")
    if isinstance(found, Row):
        raise AnalysisError(Rule.ARGUMENT_KIND, f"{what} is a whole row")
    return found


def reduced(compiler, mapped, function: ast.Node, env: dict) -> Value:
    """A reducing function over what a row maps to."""
    whole = isinstance(mapped, (Row, ClassRow))
    found = compiler.call(function, Grouped(None if whole else mapped), env=env)
    if isinstance(found, Grouped):
        raise AnalysisError(Rule.REDUCER, "a reducing function ends with a reducer")
    return compiler.value(found)
