"""Expressions of a query, evaluated to Columns and Frames.

Navigation inserts joins only for paths that are read, once per path: a left
join for one instance, a semi-join, anti-join or pre-aggregated left join for a
collection that is tested or counted, and a row-multiplying left join where a
collection is projected. Everything else is left to Catalyst.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import replace
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AnalysisError, Rule
from ..functions import scalars
from ..language import ast
from ..language.parser import parse
from ..model.catalog import Catalog, ClassInfo, MANY, Multiplicity, ONE, OPTIONAL, PRIMITIVES, SEVERAL, Reader, type_of
from .frame import ClassRow, Frame, Grouped, Items, Row, Test, ToMany, Value, named

GETTERS = {"getInteger": "Integer", "getFloat": "Float", "getString": "String", "getBoolean": "Boolean", "getDate": "Date", "getDateTime": "DateTime", "getNumber": "Number", "getDecimal": "Decimal"}
REDUCERS = ("count", "size", "sum", "average", "min", "max", "distinct", "removeDuplicates", "isEmpty", "isNotEmpty", "first")


class Compiler:
    def __init__(self, spark: SparkSession, catalog: Catalog, reader: Reader) -> None:
        self.spark, self.catalog, self.reader = spark, catalog, reader
        self.ids = itertools.count()

    # -- entry points

    def dataframe(self, text: str) -> DataFrame:
        return self.output(self.evaluate(parse(text), {}))

    def output(self, result) -> DataFrame:
        if isinstance(result, Items):
            result = self.frame_of(result)
        if isinstance(result, Value):
            return self.spark.range(1).select(result.col.alias("value"))
        if not isinstance(result, Frame):
            raise AnalysisError(Rule.RECEIVER_KIND, "the query gives neither a relation nor a value")
        if result.kind == "extent":
            row = next(iter(result.columns.values()))
            return result.df.select(*[named(row.prefix + m.name).alias(m.name) for m in row.members])
        out = []
        for name, v in result.columns.items():
            if isinstance(v, ClassRow):
                out.append(F.struct(*[named(v.prefix + m.name).alias(m.name) for m in v.members]).alias(name))
            else:
                out.append(v.labelled(name))
        return result.df.select(*out)

    # -- sources

    def columns_of(self, info: ClassInfo) -> list:
        members = [m for m in self.catalog.properties(info) if m.name in info.columns]
        if not members:
            raise AnalysisError(Rule.UNKNOWN_SOURCE, f"{info.path} is not mapped to a table")
        return members

    def extent(self, info: ClassInfo, dates: list[Value] | None = (), versions: bool = False, between: list[Value] = ()) -> Frame:
        if info.table is None:
            raise AnalysisError(Rule.UNKNOWN_SOURCE, f"{info.path} is not mapped to a table")
        dates = list(dates or ())
        if between:
            if len(between) != 2 * max(1, info.dates):
                raise AnalysisError(Rule.MILESTONE_ARITY, f"{info.path} needs {2 * max(1, info.dates)} dates of a range")
        elif not versions and len(dates) != info.dates:
            raise AnalysisError(Rule.MILESTONE_ARITY, f"{info.path} needs {info.dates} dates, not {len(dates)}")
        df = self.reader(info.table)
        for axis, (start, end) in enumerate(info.milestones):
            s, e = F.col(start), F.col(end)
            if between:
                lo, hi = between[2 * axis], between[2 * axis + 1]
                df = df.where((s <= hi.col) & (e.isNull() | (e > lo.col)))
            elif not versions and dates[axis].literal == "latest":
                df = df.where(e.isNull() | (e >= F.lit("9999-01-01").cast("timestamp_ntz")))
            elif not versions:
                df = df.where((s <= dates[axis].col) & (e.isNull() | (e > dates[axis].col)))
        members = self.columns_of(info)
        id_ = next(self.ids)
        prefix = f"#{id_}."
        frame = Frame(id_, df.select(*[F.expr(info.columns[m.name]).alias(prefix + m.name) for m in members]), kind="extent")
        frame.columns[info.simple] = ClassRow(frame, info, prefix, tuple(members), dates=tuple(dates))
        return frame

    def table(self, schema: str, name: str) -> Frame:
        physical = self.catalog.tables.get((schema, name))
        if physical is None:
            raise AnalysisError(Rule.UNKNOWN_SOURCE, f"no table {schema}.{name}")
        return self.relation(self.reader(physical))

    def relation(self, df: DataFrame, types: dict[str, str] | None = None) -> Frame:
        id_ = next(self.ids)
        frame = Frame(id_, df)
        for f in df.schema.fields:
            kind = (types or {}).get(f.name) or type_of(f.dataType)
            frame.columns[f.name] = Value(named(f.name), kind, OPTIONAL if f.nullable else ONE, frozenset((id_,)), name=f.name)
        return frame

    def rebuilt(self, frame: Frame, columns: list[tuple[str, Value]], **changes) -> Frame:
        """A relation of computed columns."""
        names = [n for n, _ in columns]
        if len(set(names)) != len(names):
            raise AnalysisError(Rule.DUPLICATE_COLUMN, f"{', '.join(n for n in names if names.count(n) > 1)}")
        id_ = next(self.ids)
        new = Frame(id_, frame.df.select(*[v.labelled(n) for n, v in columns]), **changes)
        for n, v in columns:
            new.columns[n] = Value(named(n), v.type, v.many, frozenset((id_,)), v.loose, n)
        renamed = {v.name: n for n, v in columns if v.name}
        for name, down, first in frame.order:
            if name not in renamed:
                break
            new.order.append((renamed[name], down, first))
        return new

    def scalar(self, frame: Frame, value: Value, name: str = "value") -> Frame:
        return self.rebuilt(frame, [(name, value)], kind="scalar")

    def frame_of(self, items: Items) -> Frame:
        """A literal collection as a frame that remembers its order."""
        id_ = next(self.ids)
        if not items.values:
            df, kind = self.spark.range(0).select(F.lit(0).alias("#at"), F.lit(None).cast("string").alias("value")), "Any"
        else:
            kind = items.values[0].type
            df = self.spark.range(1).select(F.posexplode(F.array(*[v.col for v in items.values])).alias("#at", "value"))
        frame = Frame(id_, df, kind="scalar", order=[("#at", False, False)])
        frame.columns["value"] = Value(named("value"), kind, ONE, frozenset((id_,)), name="value")
        return frame

    # -- navigation

    def dates_for(self, target: ClassInfo, given: list[Value] | None, row: ClassRow) -> list[Value]:
        if given:
            if len(given) != target.dates:
                raise AnalysisError(Rule.MILESTONE_ARITY, f"{target.path} needs {target.dates} dates, not {len(given)}")
            return given
        if target.dates and len(row.dates) != target.dates:
            raise AnalysisError(Rule.MILESTONE_ARITY, f"{target.path} needs {target.dates} dates and inherits none")
        return list(row.dates) if target.dates else []

    def navigate(self, row: ClassRow, name: str, args: list | None, env: dict):
        for suffix, mode in (("AllVersionsInRange", "range"), ("AllVersions", "versions")):
            if name.endswith(suffix) and not any(m.name == name for m in row.info.members):
                return self.association(row, self.catalog.member(row.info, name[: -len(suffix)]), args or [], mode)
        member = self.catalog.member(row.info, name)
        if member.parameters is not None and member.body is not None:
            if len(args or ()) != len(member.parameters):
                raise AnalysisError(Rule.ARITY, f"{name} takes {len(member.parameters)} arguments")
            return self.evaluate(member.body, {"this": row, **dict(zip(member.parameters, args or ()))})
        if member.association or member.type not in PRIMITIVES and member.type not in self.catalog.enums:
            return self.association(row, member, args)
        if args:
            raise AnalysisError(Rule.ARITY, f"{name} takes no arguments")
        return row.property(name)

    def association(self, row: ClassRow, member, args: list | None, mode: str = "point"):
        target = self.catalog.find(member.type)
        if not member.join:
            raise AnalysisError(Rule.UNKNOWN_SOURCE, f"{row.info.path}.{member.name} has no join columns")
        many = member.multiplicity if mode == "point" else SEVERAL
        dates = [self.value(a) for a in args or ()]
        if mode == "point":
            dates = self.dates_for(target, dates, row)
        elif (mode == "range") != bool(dates) or mode == "range" and len(dates) != 2 * max(1, target.dates):
            raise AnalysisError(Rule.MILESTONE_ARITY, f"{member.name} takes another number of dates")
        known = (row.prefix, member.name, mode, tuple(str(d.col) for d in dates))
        if known in row.frame.joined:
            return row.frame.joined[known]
        sub = self.extent(target, dates if mode == "point" else [], versions=mode == "versions", between=dates if mode == "range" else ())
        other = next(iter(sub.columns.values()))
        pairs = tuple((row.property(a).name, other.property(b).name) for a, b in member.join)
        if many.to_one:
            row.frame.df = row.frame.df.join(sub.df, fold(Column.__and__, [named(a) == named(b) for a, b in pairs]), "left")
            found = replace(other, frame=row.frame, many=row.many * many)
            row.frame.joined[known] = found
            return found
        return ToMany(row, sub, pairs, other)

    def from_many(self, many: ToMany, name: str, args: list | None, env: dict) -> ToMany:
        """many.name: a property of its elements, or a further collection."""
        if not isinstance(many.element, ClassRow):
            raise AnalysisError(Rule.RECEIVER_KIND, f".{name} on values")
        found = self.navigate(many.element, name, args, env)
        if isinstance(found, ToMany):
            # The nested collection's rows, joined to their owners.
            joined = many.frame.df.join(found.frame.df, fold(Column.__and__, [named(a) == named(b) for a, b in found.on]), "inner")
            sub = many.frame.with_df(joined)
            element = replace(found.element, frame=sub) if isinstance(found.element, ClassRow) else found.element
            return replace(many, frame=sub, element=element)
        return replace(many, element=found)

    def spread(self, many: ToMany):
        """A projected collection: its owner's rows multiply, and stay if it is empty."""
        owner = many.owner.frame
        on = fold(Column.__and__, [named(a) == named(b) for a, b in many.on])
        for c in many.correlated:
            on = on & c
        owner.df = owner.df.join(many.frame.df, on, "left")
        if isinstance(many.element, ClassRow):
            return replace(many.element, frame=owner, many=OPTIONAL)
        return Value(many.element.col, many.element.type, OPTIONAL, frozenset((owner.id,)), name=many.element.name)

    def exists(self, many: ToMany, negated: bool) -> Test:
        frame = many.frame
        if isinstance(many.element, Value):
            frame = frame.with_df(frame.df.where(many.element.col.isNotNull()))
        on = fold(Column.__and__, [named(a) == named(b) for a, b in many.on])
        for c in many.correlated:
            on = on & c
        pairs = None if many.correlated else tuple((named(a), b) for a, b in many.on)
        return Test(many.owner.frame, frame.df, on, negated, pairs, row=many.owner)

    def aggregated(self, many: ToMany, name: str) -> Value:
        """A collection's count, sum, ...: aggregated by its keys, then joined, one row per owner."""
        value = many.element if isinstance(many.element, Value) else None
        grouped = self.reducer(Grouped(value, many.distinct), name)
        id_ = next(self.ids)
        owner, rows = many.owner.frame, many.frame.df
        keys = [b for _, b in many.on]
        lefts = [a for a, _ in many.on]
        same = Column.__eq__
        if many.correlated:
            # What its owner's values filter is grouped by these: the collection meets each distinct owner once.
            lefts = keys = [many.owner.prefix + m.name for m in many.owner.members]
            same = Column.eqNullSafe
            on = fold(Column.__and__, [*[named(a) == named(b) for a, b in many.on], *many.correlated])
            rows = owner.df.dropDuplicates(lefts).join(rows, on)
        sub = rows.groupBy(*map(named, keys)).agg(grouped.col.alias(f"#{id_}.agg")).select(*[named(k).alias(f"#{id_}.k{i}") for i, k in enumerate(keys)], named(f"#{id_}.agg"))
        owner.df = owner.df.join(sub, fold(Column.__and__, [same(named(a), named(f"#{id_}.k{i}")) for i, a in enumerate(lefts)]), "left")
        col = named(f"#{id_}.agg")
        if name in ("count", "size"):
            col = F.coalesce(col, F.lit(0).cast("bigint"))
        return Value(col, grouped.type, ONE if name in ("count", "size") else OPTIONAL, frozenset((owner.id,)))

    # -- tests

    def tested(self, test: Test) -> Value:
        """A test as a value, where it isn't a filter of its own: a left join with the distinct keys."""
        id_ = next(self.ids)
        frame, flag = test.frame, named(f"#{id_}.in")
        if test.pairs is None:
            # The owner's values are read beyond equal keys: rows that pass are marked by their properties.
            keys = [test.row.prefix + m.name for m in test.row.members]
            passed = frame.df.join(test.other, test.on, "left_semi").select(*[named(k).alias(f"#{id_}.k{i}") for i, k in enumerate(keys)]).distinct()
            on = fold(Column.__and__, [named(k).eqNullSafe(named(f"#{id_}.k{i}")) for i, k in enumerate(keys)])
        else:
            passed = test.other.select(*[named(b).alias(f"#{id_}.k{i}") for i, (_, b) in enumerate(test.pairs)]).distinct()
            on = fold(Column.__and__, [a == named(f"#{id_}.k{i}") for i, (a, _) in enumerate(test.pairs)])
        frame.df = frame.df.join(passed.withColumn(f"#{id_}.in", F.lit(True)), on, "left")
        col = flag.isNotNull()
        if test.value is not None:
            found = self.contents(test)
            col = F.when(flag.isNotNull(), True).when(found == "none", False).when(test.value.isNull() | (found == "nulls"), F.lit(None).cast("boolean")).otherwise(False)
        return Value(~col if test.negated else col, "Boolean", ONE if test.value is None else OPTIONAL, frozenset((frame.id,)))

    def contents(self, test: Test) -> Column:
        """Of a membership's set: none, nulls (among others) or values, as one aggregated row."""
        key = named(test.pairs[0][1])
        said = F.when(F.count(F.lit(1)) == 0, "none").when(F.count(F.lit(1)) > F.count(key), "nulls").otherwise("values")
        return test.other.agg(said.alias("said")).scalar()

    def passing(self, df: DataFrame, test: Test) -> DataFrame:
        """The rows of `df` for which the test is true."""
        if not test.negated:
            return df.join(test.other, test.on, "left_semi")
        if test.value is None:
            return df.join(test.other, test.on, "left_anti")
        # Not in: beyond the anti-join, a null on either side leaves the result unknown unless the set is empty.
        found = self.contents(test)
        return df.join(test.other, test.on, "left_anti").where((found == "none") | (found == "values") & test.value.isNotNull())

    def keep(self, frame: Frame, node: ast.Node, env: dict) -> None:
        """Filter `frame` in place by a predicate; conjuncts that test become semi- or anti-joins."""
        if isinstance(node, ast.Binary) and node.op == "&&":
            self.keep(frame, node.left, env)
            self.keep(frame, node.right, env)
            return
        found = self.evaluate(node, env)
        if isinstance(found, Test) and found.frame is frame:
            frame.df = self.passing(frame.df, found)
            return
        # The condition may join what it reads; it is evaluated first.
        condition = self.boolean(found).col
        frame.df = frame.df.where(condition)

    def boolean(self, found) -> Value:
        if isinstance(found, Test):
            return self.tested(found)
        v = self.value(found)
        if v.type not in ("Boolean", "Any"):
            raise AnalysisError(Rule.OPERAND_TYPE, f"a condition is expected, not {v.type}")
        return v

    # -- expressions

    def value(self, found) -> Value:
        if isinstance(found, Value):
            return found
        if isinstance(found, Test):
            return self.tested(found)
        if isinstance(found, ToMany):
            raise AnalysisError(Rule.MULTIPLICITY, "a collection stands where a single value is needed")
        if isinstance(found, Frame) and found.kind != "extent" and len(found.columns) == 1:
            return self.subquery(found, next(iter(found.columns)))
        raise AnalysisError(Rule.ARGUMENT_KIND, "a value is expected")

    def subquery(self, frame: Frame, name: str) -> Value:
        """The one row of `frame`; several fail when it runs, as in SQL."""
        v = frame.column(name)
        return Value(frame.df.select(v.col).scalar(), v.type, OPTIONAL)

    def call(self, function: ast.Node, *args, env: dict):
        if not isinstance(function, ast.Lambda):
            raise AnalysisError(Rule.ARGUMENT_KIND, "a function is expected")
        if len(function.parameters) != len(args):
            raise AnalysisError(Rule.ARITY, f"a function of {len(args)} parameters is expected")
        return self.evaluate(function.body, {**env, **dict(zip(function.parameters, args))})

    def evaluate(self, node: ast.Node, env: dict):
        match node:
            case ast.Literal(value, kind):
                col = F.lit(value).cast("bigint") if kind == "Integer" else F.lit(value).cast("timestamp_ntz") if kind == "DateTime" else F.lit(None if kind == "LatestDate" else value)
                return Value(col, kind, literal=value)
            case ast.Variable(name):
                if name not in env:
                    raise AnalysisError(Rule.UNBOUND_VARIABLE, f"${name}")
                return env[name]
            case ast.Block(lets, result):
                inner = dict(env)
                for name, v in lets:
                    inner[name] = self.evaluate(v, inner)
                return self.evaluate(result, inner)
            case ast.Lambda((), body):
                return self.evaluate(body, env)
            case ast.ListOf(items):
                return Items(tuple(self.value(self.evaluate(i, env)) for i in items))
            case ast.TablePointer(store, table):
                schema, _, name = table.rpartition(".")
                return self.table(schema or "default", name)
            case ast.Unary("!", operand):
                found = self.evaluate(operand, env)
                if isinstance(found, Test):
                    return replace(found, negated=not found.negated)
                v = self.boolean(found)
                return scalars.made(~v.col, "Boolean", v)
            case ast.Unary("-", operand):
                v = self.value(self.evaluate(operand, env))
                return scalars.made(-v.col, scalars._number(v).type, v)
            case ast.Binary(op, left, right):
                return self.binary(op, left, right, env)
            case ast.Index(receiver, index):
                found = self.evaluate(receiver, env)
                if isinstance(found, Row) and index.kind == "String":
                    return found.frame.column(index.value)
                if isinstance(found, Row) and index.kind == "Integer" and index.value < len(found.frame.columns):
                    return found.frame.column(list(found.frame.columns)[index.value])
                if isinstance(found, (Value, ClassRow)) and index == ast.Literal(0, "Integer"):
                    return found
                raise AnalysisError(Rule.RECEIVER_KIND, "an index on this receiver")
            case ast.Instance(owner, values):
                return self.instance(owner, values, env)
            case ast.Property():
                return self.property(node, env)
            case ast.Call():
                return self.arrow(node, env)
            case ast.Path(name):
                raise AnalysisError(Rule.SOURCE_SHAPE, f"{name} stands alone")
        raise AnalysisError(Rule.UNMODELED, type(node).__name__)

    def instance(self, owner: ast.Path, values, env: dict) -> Frame:
        info = self.catalog.find(owner.name)
        id_ = next(self.ids)
        prefix, given = f"#{id_}.", dict(values)
        members = [m for m in self.catalog.properties(info)]
        for name in given:
            self.catalog.member(info, name)
        cols = []
        for m in members:
            v = self.value(self.evaluate(given[m.name], env)) if m.name in given else None
            cols.append((v.col if v else F.lit(None).cast("string")).alias(prefix + m.name))
        frame = Frame(id_, self.spark.range(1).select(*cols), kind="extent")
        frame.columns[info.simple] = ClassRow(frame, info, prefix, tuple(members))
        return frame

    def binary(self, op: str, left: ast.Node, right: ast.Node, env: dict):
        a, b = self.evaluate(left, env), self.evaluate(right, env)
        if op in ("&&", "||"):
            x, y = self.boolean(a), self.boolean(b)
            return scalars.made(x.col & y.col if op == "&&" else x.col | y.col, "Boolean", x, y)
        if op in ("==", "!="):
            for many, other, negated in ((a, b, op == "!="), (b, a, op == "!=")):
                if isinstance(many, ToMany):
                    raise AnalysisError(Rule.MULTIPLICITY, "a collection is compared with a value")
            return scalars.comparison(op, self.value(a), self.value(b))
        if op in ("<", "<=", ">", ">="):
            return scalars.comparison(op, self.value(a), self.value(b))
        return scalars.arithmetic(op, self.value(a), self.value(b))

    def property(self, node: ast.Property, env: dict):
        name, args = node.name, node.args
        if isinstance(node.receiver, ast.Path):
            return self.static(node.receiver, name, args, env)
        found = self.evaluate(node.receiver, env)
        if name in GETTERS and args is not None:
            if len(args) != 1 or not isinstance(args[0], ast.Literal):
                raise AnalysisError(Rule.ARITY, f"{name} takes one column name")
            if isinstance(found, Row):
                v = found.frame.column(args[0].value)
                return replace(v, loose=True, type=GETTERS[name] if v.type == "Any" else v.type)
            if isinstance(found, Frame):
                return replace(self.subquery(found, args[0].value), loose=True)
            raise AnalysisError(Rule.RECEIVER_KIND, f"{name} needs a row")
        values = None if args is None else [self.value(self.evaluate(a, env)) for a in args]
        if isinstance(found, ClassRow):
            return self.navigate(found, name, values, env)
        if isinstance(found, ToMany):
            return self.from_many(found, name, values, env)
        if isinstance(found, Row):
            v = found.frame.columns.get(name)
            return v if isinstance(v, ClassRow) else found.frame.column(name)
        if isinstance(found, Frame):
            if found.kind == "relation":
                return self.scalar(found, found.column(name), name)
            if found.kind == "extent":
                v = self.navigate(found.row, name, values, env)
                v = self.spread(v) if isinstance(v, ToMany) else v
                if isinstance(v, ClassRow):
                    return self.refocused(found, v)
                return self.scalar(found, v, name)
        raise AnalysisError(Rule.RECEIVER_KIND, f".{name} on this receiver")

    def refocused(self, frame: Frame, row: ClassRow) -> Frame:
        """The instances that a navigation reaches from an extent; those that reach none give none."""
        new = frame.with_df(frame.df.where(named(row.prefix + row.members[0].name).isNotNull()), order=[])
        new.columns = {row.info.simple: replace(row, frame=new)}
        return new

    def static(self, owner: ast.Path, name: str, args, env: dict):
        """Class.all(...), Class.allVersions, Enumeration.value, ..."""
        values = [] if args is None else [self.value(self.evaluate(a, env)) for a in args]
        if name == "all" and args is not None:
            return self.extent(self.catalog.find(owner.name), values)
        if name == "allVersions":
            return self.extent(self.catalog.find(owner.name), versions=True)
        if name == "allVersionsInRange":
            return self.extent(self.catalog.find(owner.name), between=values)
        for path, known in self.catalog.enums.items():
            if owner.name in (path, path.rsplit("::", 1)[-1]):
                if name not in known:
                    raise AnalysisError(Rule.UNKNOWN_PROPERTY, f"{path} has no value {name}")
                return Value(F.lit(name), "String", literal=name)
        if self.catalog.knows(owner.name):
            raise AnalysisError(Rule.SOURCE_SHAPE, f"{owner.name}.{name}: a class starts with all(...)")
        raise AnalysisError(Rule.UNKNOWN_SOURCE, f"{owner.name}.{name}")

    # -- calls

    def arrow(self, node: ast.Call, env: dict):
        from ..operators import STEPS

        name, args = node.name, node.args
        if not args:
            found = scalars.constant(name)
            if found is None:
                raise AnalysisError(Rule.UNMODELED, f"{name}()", node.at)
            return found
        if name == "if":
            return self.conditional(args, env)
        if name == "tableReference":
            if not isinstance(args[0], ast.Path):
                raise AnalysisError(Rule.SOURCE_SHAPE, "tableReference starts from a store")
            if len(args) != 3 or not all(isinstance(a, ast.Literal) and a.kind == "String" for a in args[1:]):
                raise AnalysisError(Rule.ARITY, "tableReference takes a schema and a table name")
            if self.catalog.stores and args[0].name not in self.catalog.stores:
                raise AnalysisError(Rule.UNKNOWN_SOURCE, f"no store {args[0].name}")
            return self.table(args[1].value, args[2].value)
        if name in ("not", "and", "or") and len(args) == (1 if name == "not" else 2):
            return self.evaluate(ast.Unary("!", args[0]) if name == "not" else ast.Binary("&&" if name == "and" else "||", *args), env)
        found = self.evaluate(args[0], env)
        rest = args[1:]
        if isinstance(found, Grouped):
            if rest:
                raise AnalysisError(Rule.ARITY, f"{name} takes no arguments")
            return self.reducer(found, name)
        if isinstance(found, Items) and name not in scalars.FUNCTIONS and name != "in":
            found = self.frame_of(found)
        if isinstance(found, Frame):
            if name in REDUCERS[:6] + ("isEmpty", "isNotEmpty", "toOne") and rest:
                raise AnalysisError(Rule.ARITY, f"{name} takes no arguments")
            if name not in STEPS:
                raise AnalysisError(Rule.UNMODELED, f"->{name} on a collection", node.at)
            return STEPS[name](self, found, rest, env)
        if isinstance(found, ToMany):
            return self.collection(found, name, rest, env)
        if name == "in":
            return self.membership(self.value(found), rest, env)
        if name == "cast" and len(rest) == 1 and isinstance(rest[0], ast.TypeRef):
            return found if isinstance(found, (ClassRow, Row)) else scalars.cast(self.value(found), rest[0].name)
        if isinstance(found, Items) and name == "contains" and len(rest) == 1:
            v = self.value(self.evaluate(rest[0], env))
            return scalars.made(v.col.isin(*[x.col for x in found.values]), "Boolean", v)
        if isinstance(found, ClassRow) and name in ("toOne", "first"):
            return found
        if isinstance(found, ClassRow) and name in ("isEmpty", "isNotEmpty"):
            key = found.property((found.info.key or (found.members[0].name,))[0])
            return scalars.FUNCTIONS[name][1](key)
        if isinstance(found, Value) and name in ("first", "at", "toOneMany"):
            return found
        if name not in scalars.FUNCTIONS:
            raise AnalysisError(Rule.RECEIVER_KIND, f"->{name} on a value", node.at)
        (least, most), function = scalars.FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise AnalysisError(Rule.ARITY, f"{name} takes {least - 1} arguments", node.at)
        return function(self.value(found), *[self.value(self.evaluate(a, env)) for a in rest])

    def conditional(self, args, env: dict) -> Value:
        if len(args) != 3:
            raise AnalysisError(Rule.ARITY, "if takes a condition and two functions")
        c = self.boolean(self.evaluate(args[0], env))
        a, b = (self.value(self.evaluate(x, env)) for x in args[1:])
        if scalars.family(a.type) != scalars.family(b.type) and "Any" not in (a.type, b.type):
            raise AnalysisError(Rule.OPERAND_TYPE, f"if gives {a.type} or {b.type}")
        kind = scalars.wider(a.type, b.type) if scalars.family(a.type) == "number" else a.type
        return scalars.made(F.when(c.col, a.col).otherwise(b.col), kind, c, a, b)

    def membership(self, v: Value, rest, env: dict):
        if len(rest) != 1:
            raise AnalysisError(Rule.ARITY, "in takes one collection")
        found = self.evaluate(rest[0], env)
        if isinstance(found, Items):
            return scalars.made(v.col.isin(*[x.col for x in found.values]), "Boolean", v)
        if isinstance(found, Frame) and found.kind != "extent" and len(found.columns) == 1:
            inner = next(iter(found.columns.values()))
            key = f"#{next(self.ids)}.in"
            other = found.df.select(inner.col.alias(key))
            owners = [f for f in self.frames if f.id in v.of]
            if len(owners) != 1:
                raise AnalysisError(Rule.ARGUMENT_KIND, "in needs a value of the row")
            return Test(owners[0], other, v.col == named(key), pairs=((v.col, key),), value=v.col)
        raise AnalysisError(Rule.ARGUMENT_KIND, "in takes a list or a one-column query")

    frames: list[Frame] = []

    def collection(self, many: ToMany, name: str, rest, env: dict):
        """An arrow on a collection of the current row."""
        if name in ("filter", "exists", "forAll"):
            if len(rest) != 1:
                raise AnalysisError(Rule.ARITY, f"{name} takes one function")
            sub = many.frame.with_df(many.frame.df)
            element = replace(many.element, frame=sub) if isinstance(many.element, ClassRow) else many.element
            body = ast.Lambda(rest[0].parameters, ast.Unary("!", rest[0].body)) if name == "forAll" else rest[0]
            outer, self.frames = self.frames, [*self.frames, sub]
            found = self.call(body, element, env=env)
            correlated = many.correlated
            if isinstance(found, Test) and found.frame is sub:
                sub.df = self.passing(sub.df, found)
            else:
                v = self.boolean(found)
                if many.owner.frame.id in v.of:
                    correlated = (*correlated, v.col)
                else:
                    sub.df = sub.df.where(v.col)
            self.frames = outer
            narrowed = replace(many, frame=sub, element=element, correlated=correlated)
            return narrowed if name == "filter" else self.exists(narrowed, name == "forAll")
        if name == "map" and len(rest) == 1:
            found = self.call(rest[0], many.element, env=env)
            return replace(many, element=found if isinstance(found, (Value, ClassRow)) else self.value(found))
        if rest:
            if name == "contains" and len(rest) == 1 and isinstance(many.element, Value):
                v = self.value(self.evaluate(rest[0], env))
                sub = many.frame.with_df(many.frame.df)
                same = scalars.comparison("==", many.element, v).col
                if many.owner.frame.id in v.of:
                    return self.exists(replace(many, correlated=(*many.correlated, same)), False)
                sub.df = sub.df.where(same)
                return self.exists(replace(many, frame=sub), False)
            raise AnalysisError(Rule.ARITY, f"{name} takes no arguments")
        if name in ("isEmpty", "isNotEmpty"):
            return self.exists(many, name == "isEmpty")
        if name in ("distinct", "removeDuplicates"):
            return replace(many, distinct=True)
        if name in ("toOne", "first"):
            return self.spread(many)
        if name in REDUCERS:
            return self.aggregated(many, name)
        raise AnalysisError(Rule.UNMODELED, f"->{name} on a collection")

    def reducer(self, g: Grouped, name: str):
        v = g.value
        over = (lambda c: c) if g.window is None else (lambda c: c.over(g.window))
        if name in ("distinct", "removeDuplicates"):
            return replace(g, distinct=True)
        if name in ("count", "size"):
            if v is None:
                return Value(over(F.count(F.lit(1))), "Integer")
            return Value(over(F.countDistinct(v.col) if g.distinct else F.count(v.col)), "Integer")
        if name == "rowNumber" and g.window is not None:
            return Value(over(F.row_number()).cast("bigint"), "Integer")
        if v is None:
            raise AnalysisError(Rule.REDUCER, f"{name} of whole rows")
        if name in ("sum", "average"):
            if v.type not in ("Integer", "Float", "Decimal", "Number", "Any"):
                raise AnalysisError(Rule.REDUCER, f"{name} of {v.type}")
            if name == "sum":
                return Value(over(F.sum_distinct(v.col) if g.distinct else F.sum(v.col)), v.type, OPTIONAL)
            if v.type == "Decimal":  # exact until the one division
                return Value(over(F.sum(v.col)).cast("double") / over(F.count(v.col)), "Float", OPTIONAL)
            return Value(over(F.avg(v.col)), "Float", OPTIONAL)
        if name in ("min", "max", "first"):
            return Value(over({"min": F.min, "max": F.max, "first": F.first}[name](v.col)), v.type, OPTIONAL)
        raise AnalysisError(Rule.UNMODELED, f"->{name} of a group")
