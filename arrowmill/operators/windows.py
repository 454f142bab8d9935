"""Window columns: extend(over(...), ...) and olapGroupBy.

Without an order a window is the whole partition; with one and no frame it
reaches from the start of the partition to the current row's peers.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..errors import AnalysisError, Rule
from ..language import ast
from ..plans.frame import Frame, Grouped, Row, Value, named
from .arguments import as_value, count, items, names, resolved, sort_keys, text
from .rows import only

RANKS = {"rank": F.rank, "denseRank": F.dense_rank, "rowNumber": F.row_number, "percentRank": F.percent_rank, "cumulativeDistribution": F.cume_dist}


def _offset(node: ast.Node) -> int:
    if isinstance(node, ast.Call) and node.name == "unbounded" and not node.args:
        return Window.unboundedPreceding
    if not isinstance(node, ast.Literal) or node.kind != "Integer":
        raise AnalysisError(Rule.ARGUMENT_KIND, "a frame's bounds are integers")
    return node.value


def _spec(frame: Frame, parts: list[str], keys: list[tuple[str, bool, bool]], bounds: ast.Call | None):
    w = Window.partitionBy(*[frame.column(p).col for p in parts])
    order = []
    for n, down, first in keys:
        c = frame.column(n).col
        order.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    if order:
        w = w.orderBy(*order)
    if bounds is not None:
        if len(bounds.args) != 2:
            raise AnalysisError(Rule.ARITY, f"{bounds.name} takes two bounds")
        lo, hi = map(_offset, bounds.args)
        if isinstance(bounds.args[1], ast.Call):
            hi = Window.unboundedFollowing
        if bounds.name in ("rows", "_rows"):
            if not order:  # rows without an order follow the partition's own
                w = w.orderBy(*[frame.column(p).col for p in parts] or [F.lit(1)])
            return w.rowsBetween(lo, hi)
        if len(keys) > 1 or not keys and not parts:
            raise AnalysisError(Rule.ARGUMENT_KIND, "range needs one order key")
        if not order:
            w = w.orderBy(frame.column(parts[0]).col)
        return w.rangeBetween(lo, hi)
    return w.rangeBetween(Window.unboundedPreceding, 0) if order else w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _window(frame: Frame, node: ast.Call):
    """The window of over(...), with and without its frame; ranks take none."""
    parts, keys, bounds = [], [], None
    for a in node.args:
        if isinstance(a, ast.Call) and a.name in ("rows", "range", "_rows", "_range"):
            bounds = a
        elif isinstance(a, ast.Columns):
            parts += names(a, "over")
        else:
            keys += sort_keys(a)
    plain = _spec(frame, parts, keys, None)
    if keys:
        plain = Window.partitionBy(*[frame.column(p).col for p in parts]).orderBy(*[frame.column(n).col.desc_nulls_last() if d else frame.column(n).col.asc_nulls_last() for n, d, _ in keys])
    return _spec(frame, parts, keys, bounds), plain, bool(keys)


def windowed(compiler, frame: Frame, args, env) -> Frame:
    count(args, 2, None, "extend")
    framed, plain, has_order = _window(frame, args[0])
    added = []
    for a in args[1:]:
        if not isinstance(a, ast.Columns):
            raise AnalysisError(Rule.ARGUMENT_KIND, "extend takes ~name: {p, w, r|...}")
        for c in a.items:
            if c.function is None or not c.function.parameters:
                raise AnalysisError(Rule.ARGUMENT_KIND, f"{c.name} needs a function")
            added.append((c.name, _windowed(compiler, frame, c, framed, plain, has_order, env)))
    return compiler.rebuilt(frame, [(n, as_value(v, n)) for n, v in frame.columns.items()] + added)


def _windowed(compiler, frame: Frame, c: ast.Column, framed, plain, has_order: bool, env) -> Value:
    f = c.function
    body = f.body
    if c.reduce is None and isinstance(body, ast.Call) and body.name in RANKS and body.args and body.args[0] == ast.Variable(f.parameters[0]):
        if not has_order:
            raise AnalysisError(Rule.ARGUMENT_KIND, f"{body.name} needs an order")
        whole = body.name not in ("percentRank", "cumulativeDistribution")
        col = RANKS[body.name]().over(plain)
        return Value(col.cast("bigint") if whole else col, "Integer" if whole else "Float", of=frozenset((frame.id,)))
    bound = dict(env)
    for p in f.parameters:
        bound[p] = Row(frame)  # the last parameter is the row; partition and window serve ranks only
    v = compiler.evaluate(body, bound)
    if c.reduce is None:
        return compiler.value(v)
    r = compiler.value(compiler.call(c.reduce, Grouped(None if isinstance(v, Row) else compiler.value(v), window=framed), env=env))
    return Value(r.col, r.type, r.many, frozenset((frame.id,)))


def olap_group_by(compiler, frame: Frame, args, env) -> Frame:
    """olapGroupBy(['part', ...], desc('order'), values|$values->rowNumber(), 'name'): the relation with one more column."""
    count(args, 3, None, "olapGroupBy")
    only(frame, "relation")
    parts, name, function = names(args[0], "olapGroupBy"), text(args[-1], "olapGroupBy"), args[-2]
    keys = [k for a in args[1:-2] for k in sort_keys(a)]
    value = None
    if isinstance(function, ast.Call) and function.name == "func" and len(function.args) == 2:
        value, function = frame.column(text(function.args[0], "func")), function.args[1]
    if isinstance(function, ast.Lambda) and isinstance(function.body, ast.Call) and function.body.name in RANKS:
        if not keys:
            raise AnalysisError(Rule.ARGUMENT_KIND, f"{function.body.name} needs an order")
        order = [frame.column(n).col.desc_nulls_last() if d else frame.column(n).col.asc_nulls_last() for n, d, _ in keys]
        w = Window.partitionBy(*[frame.column(p).col for p in parts]).orderBy(*order)
        v = Value(RANKS[function.body.name]().over(w).cast("bigint"), "Integer")
    else:
        v = compiler.value(compiler.call(function, Grouped(value, window=_spec(frame, parts, keys, None)), env=env))
    return compiler.rebuilt(frame, [(n, as_value(x, n)) for n, x in frame.columns.items()] + [(name, v)])


WINDOWS = {"olapGroupBy": olap_group_by}
