"""Steps over rows: filter, project, extend, rename, sort, limit, set operations.

Sorts are stable: a later sort goes before the keys of an earlier one, as long
as steps between them keep rows and those columns. Spark would drop the earlier.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..errors import AnalysisError, Rule
from ..language import ast
from ..plans.frame import ClassRow, Frame, Value, named
from .arguments import as_value, count, integer, items, names, resolved, sort_keys, text


def only(frame: Frame, *kinds: str) -> None:
    if frame.kind not in kinds:
        raise AnalysisError(Rule.RECEIVER_KIND, f"the step needs a {' or '.join(kinds)}, not a {frame.kind}")


def keep(compiler, frame: Frame, args, env) -> Frame:
    count(args, 1, 1, "filter")
    new = frame.with_df(frame.df)
    function = args[0]
    if not isinstance(function, ast.Lambda) or len(function.parameters) != 1:
        raise AnalysisError(Rule.ARGUMENT_KIND, "filter takes a function of one parameter")
    compiler.frames = [*compiler.frames, new]
    compiler.keep(new, function.body, {**env, function.parameters[0]: new.row})
    compiler.frames = compiler.frames[:-1]
    return new


def mapped(compiler, frame: Frame, args, env) -> Frame:
    count(args, 1, 1, "map")
    new = frame.with_df(frame.df)
    found = resolved(compiler, new, args[0], env)
    if isinstance(found, ClassRow):
        return compiler.refocused(new, found)
    return compiler.scalar(new, as_value(found, "map"))


def project(compiler, frame: Frame, args, env) -> Frame:
    count(args, 1, 2, "project")
    only(frame, "extent", "relation")
    if isinstance(args[0], ast.Columns):
        count(args, 1, 1, "project")
        wanted = [(c.name, c.function) for c in args[0].items]
        if not args[0].bracketed or any(f is None or c.reduce for c, (_, f) in zip(args[0].items, wanted)):
            raise AnalysisError(Rule.ARGUMENT_KIND, "project takes ~[name: row|value, ...]")
    else:
        count(args, 2, 2, "project")
        functions, labels = items(args[0]), [text(n, "project") for n in items(args[1])]
        if len(functions) != len(labels):
            raise AnalysisError(Rule.NAME_COUNT, f"{len(functions)} columns and {len(labels)} names")
        wanted = list(zip(labels, functions))
    if not wanted:
        raise AnalysisError(Rule.ARITY, "project needs a column")
    new = frame.with_df(frame.df, bindable=True)
    found = [(n, resolved(compiler, new, f, env)) for n, f in wanted]
    if any(isinstance(v, ClassRow) for _, v in found):
        # Instances stay instances: their columns are carried under the column's name.
        labels = [n for n, _ in found]
        if len(set(labels)) != len(labels):
            raise AnalysisError(Rule.DUPLICATE_COLUMN, ", ".join(labels))
        cols, keep_ = [], {}
        for n, v in found:
            if isinstance(v, ClassRow):
                cols += [named(v.prefix + m.name) for m in v.members if not any(str(named(v.prefix + m.name)) == str(c) for c in cols)]
                keep_[n] = v
            else:
                cols.append(v.labelled(n))
                keep_[n] = replace(v, col=named(n), name=n)
        return new.with_df(new.df.select(*cols), kind="relation", columns=keep_, joined={}, order=[])
    return compiler.rebuilt(new, found)


def select(compiler, frame: Frame, args, env) -> Frame:
    count(args, 1, 1, "select")
    only(frame, "relation")
    wanted = names(args[0], "select")
    new = frame.with_df(frame.df)
    found = []
    for n in wanted:
        if isinstance(frame.columns.get(n), ClassRow):
            new.columns = {k: new.columns[k] for k in wanted if k in new.columns}
            if len(new.columns) != len(wanted):
                raise AnalysisError(Rule.UNKNOWN_COLUMN, ", ".join(wanted))
            return new.with_df(new.df.select(*map(named, new.physical())))
        found.append((n, frame.column(n)))
    return compiler.rebuilt(frame, found)


def rename(compiler, frame: Frame, args, env) -> Frame:
    count(args, 2, 2, "rename")
    only(frame, "relation")
    (old,), (new,) = names(args[0], "rename"), names(args[1], "rename")
    return _renamed(compiler, frame, {old: new})


def rename_columns(compiler, frame: Frame, args, env) -> Frame:
    count(args, 1, 1, "renameColumns")
    only(frame, "relation")
    pairs = {}
    for n in items(args[0]):
        if not (isinstance(n, ast.Call) and n.name == "pair" and len(n.args) == 2):
            raise AnalysisError(Rule.ARGUMENT_KIND, "renameColumns takes 'old'->pair('new')")
        pairs[text(n.args[0], "pair")] = text(n.args[1], "pair")
    return _renamed(compiler, frame, pairs)


def _renamed(compiler, frame: Frame, pairs: dict[str, str]) -> Frame:
    for old in pairs:
        frame.column(old)
    return compiler.rebuilt(frame, [(pairs.get(n, n), as_value(v, n)) for n, v in frame.columns.items()])


def extend(compiler, frame: Frame, args, env) -> Frame:
    from .windows import windowed

    only(frame, "relation")
    if args and isinstance(args[0], ast.Call) and args[0].name == "over":
        return windowed(compiler, frame, args, env)
    count(args, 1, 1, "extend")
    new = frame.with_df(frame.df)
    if isinstance(args[0], ast.Columns):
        wanted = [(c.name, c.function, c.reduce) for c in args[0].items]
        if any(f is None or r for _, f, r in wanted):
            raise AnalysisError(Rule.ARGUMENT_KIND, "extend takes ~name: row|value")
    else:
        wanted = []
        for n in items(args[0]):
            if not (isinstance(n, ast.Call) and n.name == "col" and len(n.args) == 2):
                raise AnalysisError(Rule.ARGUMENT_KIND, "extend takes col(row|value, 'name')")
            wanted.append((text(n.args[1], "col"), n.args[0], None))
    added = [(n, as_value(resolved(compiler, new, f, env), n)) for n, f, _ in wanted]
    return compiler.rebuilt(new, [(n, as_value(v, n)) for n, v in new.columns.items()] + added)


def ordered(frame: Frame, keys: list[tuple[str, bool, bool]]) -> Frame:
    cols = []
    for name, down, first in keys:
        c = named(name)
        cols.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return frame.with_df(frame.df.orderBy(*cols), order=keys)


def sort(compiler, frame: Frame, args, env) -> Frame:
    if len(args) == 2 and isinstance(args[0], ast.Literal) and isinstance(args[1], ast.Property):
        if args[1].name not in ("ASC", "DESC"):
            raise AnalysisError(Rule.ARGUMENT_KIND, "a sort direction is ASC or DESC")
        wanted = [(text(args[0], "sort"), args[1].name == "DESC", False)]
    elif not args and frame.kind == "scalar":
        wanted = [(next(iter(frame.columns)), False, False)]
    else:
        count(args, 1, None, "sort")
        wanted = [k for a in args for k in sort_keys(a)]
    if not wanted or len({n for n, _, _ in wanted}) != len(wanted):
        raise AnalysisError(Rule.DUPLICATE_SORT_KEY, ", ".join(n for n, _, _ in wanted) or "no key")
    keys = [(frame.column(n).name, down, first) for n, down, first in wanted]
    taken = {n for n, _, _ in keys}
    return ordered(frame, keys + [k for k in frame.order if k[0] not in taken])


def sort_by(compiler, frame: Frame, args, env) -> Frame:
    """Sort by a computed key; the key's column is carried, so that later sorts stay stable."""
    count(args, 1, 1, "sortBy")
    new = frame.with_df(frame.df)
    v = as_value(resolved(compiler, new, args[0], env), "sortBy")
    key = f"#{next(compiler.ids)}.key"
    return ordered(new.with_df(new.df.withColumn(key, v.col)), [(key, False, False), *new.order])


def reverse(compiler, frame: Frame, args, env) -> Frame:
    count(args, 0, 0, "reverse")
    if not frame.order:
        raise AnalysisError(Rule.RECEIVER_KIND, "reverse needs an order")
    return ordered(frame, [(n, not down, not first) for n, down, first in frame.order])


def limited(what: str, cut):
    def step(compiler, frame: Frame, args, env) -> Frame:
        count(args, 1, 1, what)
        return frame.with_df(cut(frame.df, integer(args[0], what)))

    return step


def sliced(compiler, frame: Frame, args, env) -> Frame:
    count(args, 2, 2, "slice")
    start, end = integer(args[0], "slice"), integer(args[1], "slice")
    return frame.with_df(frame.df.offset(start).limit(max(0, end - start)))


def first(compiler, frame: Frame, args, env) -> Frame:
    count(args, 0, 0, "first")
    return frame.with_df(frame.df.limit(1))


def last(compiler, frame: Frame, args, env) -> Frame:
    new = reverse(compiler, frame, args, env)
    return new.with_df(new.df.limit(1))


def tail(compiler, frame: Frame, args, env) -> Frame:
    count(args, 0, 0, "tail")
    return frame.with_df(frame.df.offset(1))


def init(compiler, frame: Frame, args, env) -> Frame:
    """All but the last: of the reversed order all but the first, in the order it had."""
    new = reverse(compiler, frame, args, env)
    return ordered(new.with_df(new.df.offset(1)), frame.order)


def distinct(compiler, frame: Frame, args, env) -> Frame:
    """Whole rows once; with columns, those columns' rows once."""
    count(args, 0, 1, "distinct")
    if args:
        wanted = names(args[0], "distinct")
        if not wanted:
            raise AnalysisError(Rule.ARITY, "distinct names no column")
        if frame.kind == "extent" and wanted == list(frame.columns):
            return distinct(compiler, frame, (), env)
        if any(isinstance(frame.columns.get(n), ClassRow) for n in wanted):
            new = frame.with_df(frame.df)
            missing = [n for n in wanted if n not in new.columns]
            if missing:
                raise AnalysisError(Rule.UNKNOWN_COLUMN, ", ".join(missing))
            # Columns keep the order they have in the relation.
            new.columns = {n: v for n, v in new.columns.items() if n in wanted}
            return distinct(compiler, new, (), env)
        only(frame, "relation", "scalar")
        for n in wanted:
            frame.column(n)
        frame = compiler.rebuilt(replace(frame, order=[]), [(n, v) for n, v in frame.columns.items() if n in wanted])
    rows = frame.df.select(*map(named, dict.fromkeys(frame.physical())))
    keys = [v.prefix + k for v in frame.columns.values() if isinstance(v, ClassRow) for k in v.info.key]
    if frame.kind == "extent" and keys and not frame.joined:
        # Instances of a keyed class are equal if their keys are; an extent holds each once.
        return frame.with_df(rows.dropDuplicates(keys), joined={}, order=[])
    return frame.with_df(rows.distinct(), joined={}, order=[])


def concatenate(compiler, frame: Frame, args, env) -> Frame:
    """All rows of both, columns by position."""
    count(args, 1, 1, "concatenate")
    from ..plans.frame import Items

    other = compiler.evaluate(args[0], env)
    if isinstance(other, Items):
        other = compiler.frame_of(other)
    if not isinstance(other, Frame) or other.kind != frame.kind:
        raise AnalysisError(Rule.RECEIVER_KIND, "concatenate needs two collections of a kind")
    if frame.kind == "extent":
        a, b = next(iter(frame.columns.values())), next(iter(other.columns.values()))
        if a.info.path != b.info.path:
            raise AnalysisError(Rule.OPERAND_TYPE, f"{a.info.path} and {b.info.path}")
        mine = [named(a.prefix + m.name) for m in a.members]
        theirs = [named(b.prefix + m.name) for m in b.members]
        return frame.with_df(frame.df.select(*mine).union(other.df.select(*theirs)), joined={}, order=[])
    if len(frame.columns) != len(other.columns):
        raise AnalysisError(Rule.NAME_COUNT, f"{len(frame.columns)} and {len(other.columns)} columns")
    mine = compiler.rebuilt(replace(frame, order=[]), [(n, as_value(v, n)) for n, v in frame.columns.items()], kind=frame.kind)
    theirs = other.df.select(*[as_value(v, n).col for n, v in other.columns.items()])
    return mine.with_df(mine.df.union(theirs))


def add(compiler, frame: Frame, args, env) -> Frame:
    count(args, 1, 1, "add")
    return concatenate(compiler, frame, (ast.ListOf((args[0],)),), env)


def same(compiler, frame: Frame, args, env) -> Frame:
    return frame


def to_one(compiler, frame: Frame, args, env) -> Frame:
    return frame.with_df(frame.df.limit(1))


def at(compiler, frame: Frame, args, env) -> Frame:
    count(args, 1, 1, "at")
    return frame.with_df(frame.df.offset(integer(args[0], "at")).limit(1))


def cast(compiler, frame: Frame, args, env) -> Frame:
    """To a relation type: its columns, checked or cast; to a class: a claim."""
    count(args, 1, 1, "cast")
    from ..functions import scalars

    kind = args[0]
    if not isinstance(kind, ast.TypeRef):
        raise AnalysisError(Rule.ARGUMENT_KIND, "cast takes a type")
    if kind.columns:
        only(frame, "relation")
        found = []
        for n, t in kind.columns:
            v = frame.column(n)
            found.append((n, v if v.type == t.name else scalars.cast(v, t.name)))
        return compiler.rebuilt(frame, found)
    if frame.kind == "scalar":
        (n, v), = frame.columns.items()
        return compiler.scalar(frame, scalars.cast(v, kind.name), n)
    return frame


def chosen(name: str):
    def step(compiler, frame: Frame, args, env):
        """exists and forAll over a whole collection."""
        count(args, 1, 1, name)
        body = args[0] if name == "exists" else ast.Lambda(args[0].parameters, ast.Unary("!", args[0].body))
        kept = keep(compiler, frame, (body,), env)
        n = kept.df.agg((F.count(F.lit(1)) > 0 if name == "exists" else F.count(F.lit(1)) == 0).alias("value"))
        return compiler.relation(n)

    return step


ROWS = {
    "filter": keep, "map": mapped, "project": project, "select": select, "restrict": select, "rename": rename, "renameColumns": rename_columns, "extend": extend,
    "sort": sort, "sortBy": sort_by, "reverse": reverse, "take": limited("take", lambda df, n: df.limit(n)), "limit": limited("limit", lambda df, n: df.limit(n)), "drop": limited("drop", lambda df, n: df.offset(n)),
    "slice": sliced, "first": first, "last": last, "tail": tail, "init": init, "distinct": distinct, "removeDuplicates": distinct, "concatenate": concatenate, "add": add,
    "tableToTDS": same, "toOne": to_one, "at": at, "cast": cast, "exists": chosen("exists"), "forAll": chosen("forAll"),
}
