"""Joins: inner and left by any condition over both sides, and as-of joins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..errors import AnalysisError, Rule
from ..language import ast
from ..plans.frame import ClassRow, Frame, Value, named
from .arguments import as_value, count

KINDS = {"INNER": "inner", "LEFT": "left", "LEFT_OUTER": "left"}


def _kind(node: ast.Node) -> str:
    if not isinstance(node, ast.Property) or not isinstance(node.receiver, ast.Path) or node.receiver.simple not in ("JoinKind", "JoinType") or node.name not in KINDS:
        raise AnalysisError(Rule.JOIN_KIND, getattr(node, "name", "no kind"))
    return KINDS[node.name]


def _sides(compiler, left: Frame, node: ast.Node, env) -> tuple[Frame, Frame]:
    right = compiler.evaluate(node, env)
    if not isinstance(right, Frame):
        raise AnalysisError(Rule.ARGUMENT_KIND, "a join takes a query")
    left, right = left.with_df(left.df), right.with_df(right.df)
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise AnalysisError(Rule.DUPLICATE_COLUMN, f"both sides have {', '.join(sorted(clash))}; rename before joining")
    return left, right


def _merged(compiler, left: Frame, right: Frame, df) -> Frame:
    id_ = next(compiler.ids)
    new = Frame(id_, df)
    for side in (left, right):
        for n, v in side.columns.items():
            new.columns[n] = replace(v, frame=new) if isinstance(v, ClassRow) else replace(v, of=frozenset((id_,)))
    return new


def join(compiler, frame: Frame, args, env) -> Frame:
    count(args, 3, 3, "join")
    left, right = _sides(compiler, frame, args[0], env)
    how, condition = _kind(args[1]), args[2]
    if not isinstance(condition, ast.Lambda) or len(set(condition.parameters)) != 2:
        raise AnalysisError(Rule.JOIN_SIDES, "a join condition has two parameters")
    v = compiler.boolean(compiler.call(condition, left.row, right.row, env=env))
    if not {left.id, right.id} <= v.of:
        raise AnalysisError(Rule.JOIN_SIDES, "the condition must name both sides")
    # Joins that navigation added are dropped with the columns that only they brought.
    extra = [c for c in (*left.df.columns, *right.df.columns) if c not in left.physical() and c not in right.physical()]
    df = left.df.join(right.df, v.col, how)
    return _merged(compiler, left, right, df.drop(*map(named, extra)) if extra else df)


def as_of_join(compiler, frame: Frame, args, env) -> Frame:
    """asOfJoin(other, {a, b|$a.time >= $b.time}[, {a, b|$a.key == $b.key && ...}]): each left row with the last right row not after it.

    One shuffle by the keys: both sides are stacked, ordered by time, and each
    left row takes the last right row before it. Without keys all rows are one
    sequence. Rows without a match keep empty right columns. A strict > leaves
    out right rows of the same time.
    """
    count(args, 2, 3, "asOfJoin")
    left, right = _sides(compiler, frame, args[0], env)
    when, on = args[1], args[2] if len(args) == 3 else None
    if not isinstance(when, ast.Lambda) or len(when.parameters) != 2 or not isinstance(when.body, ast.Binary) or when.body.op not in (">", ">="):
        raise AnalysisError(Rule.JOIN_SIDES, "asOfJoin compares the left time with the right one by > or >=")

    def sides(parameters, a, b) -> tuple[Value, Value]:
        bound = {**env, parameters[0]: left.row, parameters[1]: right.row}
        x, y = (as_value(compiler.value(compiler.evaluate(n, bound)), "a key") for n in (a, b))
        if x.of == {right.id} and y.of == {left.id}:
            x, y = y, x
        if x.of != {left.id} or y.of != {right.id}:
            raise AnalysisError(Rule.JOIN_SIDES, "each side of a comparison belongs to one side of the join")
        return x, y

    time = sides(when.parameters, when.body.left, when.body.right)
    keys, todo = [], [on.body] if on is not None else []
    while todo:
        n = todo.pop()
        if isinstance(n, ast.Binary) and n.op == "&&":
            todo += [n.left, n.right]
        elif isinstance(n, ast.Binary) and n.op == "==":
            keys.append(sides(on.parameters, n.left, n.right))
        else:
            raise AnalysisError(Rule.JOIN_SIDES, "asOfJoin's keys are equal pairs")
    mine, theirs = left.physical(), right.physical()
    # At equal times right rows come first if they count as not after.
    rank = 0 if when.body.op == ">=" else 2
    stacked = left.df.select(*[x.col.alias(f"#k{i}") for i, (x, _) in enumerate(keys)], time[0].col.alias("#t"), F.lit(1).alias("#side"), F.struct(*map(named, mine)).alias("#l")).unionByName(
        right.df.select(*[y.col.alias(f"#k{i}") for i, (_, y) in enumerate(keys)], time[1].col.alias("#t"), F.lit(rank).alias("#side"), F.struct(*map(named, theirs)).alias("#r")), allowMissingColumns=True
    )
    w = Window.partitionBy(*[named(f"#k{i}") for i in range(len(keys))]).orderBy(named("#t").asc_nulls_first(), "#side").rowsBetween(Window.unboundedPreceding, 0)
    # Empty keys and times match nothing.
    usable = F.lit(True)
    for c in ["#t", *[f"#k{i}" for i in range(len(keys))]]:
        usable = usable & named(c).isNotNull()
    found = stacked.withColumn("#r", F.when(usable, F.last("#r", ignorenulls=True).over(w))).where(named("#side") == 1)
    flat = found.select(*[F.col("`#l`")[c].alias(c) for c in mine], *[F.col("`#r`")[c].alias(c) for c in theirs])
    return _merged(compiler, left, right, flat)


JOINS = {"join": join, "asOfJoin": as_of_join}
