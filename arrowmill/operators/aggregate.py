"""groupBy in its three spellings, whole-collection reducers, pivot, fold."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..errors import AnalysisError, Rule
from ..language import ast
from ..plans.frame import ClassRow, Frame, Grouped, Value, named
from .arguments import as_value, count, items, names, reduced, resolved, text
from .rows import only


def _grouped(compiler, frame: Frame, keys: list[tuple[str, Value]], aggs: list[tuple[str, Value]]) -> Frame:
    labels = [n for n, _ in keys + aggs]
    if len(set(labels)) != len(labels):
        raise AnalysisError(Rule.DUPLICATE_COLUMN, ", ".join(labels))
    outs = [v.col.alias(n) for n, v in aggs]
    if keys:
        df = frame.df.groupBy(*[v.labelled(n) for n, v in keys])
        df = df.agg(*outs) if outs else frame.df.select(*[v.labelled(n) for n, v in keys]).distinct()
    else:
        df = frame.df.agg(*outs)
    id_ = next(compiler.ids)
    new = Frame(id_, df)
    for n, v in keys + aggs:
        new.columns[n] = Value(named(n), v.type, v.many, frozenset((id_,)), v.loose, n)
    return new


def group_by(compiler, frame: Frame, args, env) -> Frame:
    count(args, 2, None, "groupBy")
    only(frame, "extent", "relation")
    if frame.kind == "extent" and isinstance(args[0], ast.Literal):
        raise AnalysisError(Rule.ARGUMENT_KIND, "groupBy of an extent takes functions or columns")
    new = frame.with_df(frame.df)
    value = lambda f, n: as_value(resolved(compiler, new, f, env), n)
    if isinstance(args[0], ast.Columns):
        keys = [(c.name, value(c.function, c.name) if c.function else new.column(c.name)) for c in args[0].items]
        wanted = []
        for a in args[1:]:
            if not isinstance(a, ast.Columns) or any(c.function is None or c.reduce is None for c in a.items):
                raise AnalysisError(Rule.ARGUMENT_KIND, "groupBy takes ~name: row|value : values|reduced")
            wanted += [(c.name, c.function, c.reduce) for c in a.items]
    elif len(args) == 3 and isinstance(args[0], ast.ListOf) and isinstance(args[2], ast.ListOf) and all(isinstance(k, ast.Lambda) for k in args[0].items):
        labels = [text(n, "groupBy") for n in args[2].items]
        functions, parts = args[0].items, items(args[1])
        if len(labels) != len(functions) + len(parts):
            raise AnalysisError(Rule.NAME_COUNT, f"{len(functions) + len(parts)} columns and {len(labels)} names")
        keys = [(n, value(f, n)) for n, f in zip(labels, functions)]
        wanted = []
        for n, a in zip(labels[len(functions) :], parts):
            if not (isinstance(a, ast.Call) and a.name == "agg" and len(a.args) == 2):
                raise AnalysisError(Rule.ARGUMENT_KIND, "groupBy takes agg(row|value, values|reduced)")
            wanted.append((n, *a.args))
    else:
        keys = [(n, new.column(n)) for n in names(args[0], "groupBy")]
        wanted = []
        for a in (x for arg in args[1:] for x in items(arg)):
            if not (isinstance(a, ast.Call) and a.name == "agg" and len(a.args) == 3):
                raise AnalysisError(Rule.ARGUMENT_KIND, "groupBy takes agg('name', row|value, values|reduced)")
            wanted.append((text(a.args[0], "agg"), a.args[1], a.args[2]))
    mapped = [(n, resolved(compiler, new, f, env), r) for n, f, r in wanted]
    return _grouped(compiler, new, keys, [(n, reduced(compiler, v, r, env)) for n, v, r in mapped])


def whole(name: str):
    """A reducer over a whole collection; of none, a count is 0 and everything else empty."""

    def step(compiler, frame: Frame, args, env) -> Frame:
        count(args, 0, 0, name)
        value = None
        if frame.kind == "scalar":
            value = next(iter(frame.columns.values()))
        elif name not in ("count", "size"):
            raise AnalysisError(Rule.RECEIVER_KIND, f"{name} needs a collection of values")
        v = compiler.reducer(Grouped(value), name)
        out = compiler.relation(frame.df.agg(v.col.alias("value")), {"value": v.type})
        return replace(out, kind="scalar")

    return step


def empty(negated: bool):
    def step(compiler, frame: Frame, args, env) -> Frame:
        n = F.count(F.lit(1))
        return replace(compiler.relation(frame.df.limit(1).agg((n > 0 if negated else n == 0).alias("value"))), kind="scalar")

    return step


def pivot(compiler, frame: Frame, args, env) -> Frame:
    """pivot(~[column], [values], ~[name: row|value : values|reduced]): one column per value and aggregate, named value__name; other columns group.

    Without the list of values a job finds them while the query is planned, at
    most as many as Spark's spark.sql.pivotMaxValues, so the list is the way for
    large tables.
    """
    count(args, 2, 3, "pivot")
    only(frame, "relation")
    (column,) = names(args[0], "pivot")
    frame.column(column)
    values = None
    if len(args) == 3:
        if not isinstance(args[1], ast.ListOf) or not args[1].items or not all(isinstance(v, ast.Literal) for v in args[1].items):
            raise AnalysisError(Rule.ARGUMENT_KIND, "pivot takes its values as a list of literals")
        values = list(dict.fromkeys(v.value for v in args[1].items))
        args = (args[0], args[2])
    if not isinstance(args[1], ast.Columns) or any(c.function is None or c.reduce is None for c in args[1].items):
        raise AnalysisError(Rule.ARGUMENT_KIND, "pivot takes ~[name: row|value : values|reduced]")
    new = frame.with_df(frame.df)
    used: set[str] = set()
    aggs = []
    for c in args[1].items:
        v = as_value(resolved(compiler, new, c.function, env), c.name)
        used |= {v.name} if v.name else set()
        aggs.append((c.name, reduced(compiler, v, c.reduce, env)))
    keys = [n for n in new.columns if n != column and n not in used]
    wide = new.df.groupBy(*map(named, keys)).pivot(column, values).agg(*[v.col.alias(f"#{n}") for n, v in aggs])
    label = lambda c: c if c in keys else c.replace("_#", "__") if len(aggs) > 1 else f"{c}__{aggs[0][0]}"
    return compiler.relation(wide.toDF(*map(label, wide.columns)))


def fold(compiler, frame: Frame, args, env) -> Frame:
    """fold({x, a|$x + $a}, start): sums and products of numbers, which need no order."""
    count(args, 2, 2, "fold")
    only(frame, "scalar")
    f, start = args
    if not (isinstance(f, ast.Lambda) and len(f.parameters) == 2 and isinstance(f.body, ast.Binary) and f.body.op == "+" and {f.body.left, f.body.right} == {ast.Variable(p) for p in f.parameters}):
        raise AnalysisError(Rule.UNMODELED, "fold of another function than a sum depends on an order")
    v, s = compiler.reducer(Grouped(next(iter(frame.columns.values()))), "sum"), compiler.value(compiler.evaluate(start, env))
    return replace(compiler.relation(frame.df.agg((F.coalesce(v.col, F.lit(0)) + s.col).alias("value"))), kind="scalar")


AGGREGATES = {"groupBy": group_by, "isEmpty": empty(False), "isNotEmpty": empty(True), "pivot": pivot, "fold": fold, **{n: whole(n) for n in ("count", "size", "sum", "average", "min", "max")}}
