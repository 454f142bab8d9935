"""What expressions evaluate to while a query is compiled."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnalysisError, Rule
from ..model.catalog import ClassInfo, Multiplicity, ONE, PRIMITIVES


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Value:
    """A single value of the current row, or a constant."""

    col: Column
    type: str
    many: Multiplicity = ONE
    #: Ids of the frames whose columns it reads.
    of: frozenset[int] = frozenset()
    #: Read by a typed getter: its type is a claim, so comparisons coerce instead of refusing.
    loose: bool = False
    #: The physical column, if it is one as it stands.
    name: str | None = None
    literal: object = None

    def labelled(self, name: str) -> Column:
        """The column under `name`, without an alias where it has that name already."""
        return self.col if self.name == name else self.col.alias(name)


@dataclass
class Frame:
    """A relation, a class extent or a scalar collection; `df` grows joins as navigations are read."""

    id: int
    df: DataFrame
    #: Display name to Value or ClassRow, in order; of an extent its one class-typed column.
    columns: dict[str, object] = field(default_factory=dict)
    kind: str = "relation"  # relation, extent, scalar
    order: list[tuple[str, bool, bool]] = field(default_factory=list)
    joined: dict[tuple, object] = field(default_factory=dict)
    #: Rows can be bound to a variable.
    bindable: bool = True

    @property
    def row(self):
        """What a lambda's parameter stands for."""
        if not self.bindable:
            raise AnalysisError(Rule.NO_ROW_BINDING, "only distinct, sort, project or select may follow")
        if self.kind == "relation":
            return Row(self)
        return next(iter(self.columns.values()))

    def column(self, name: str) -> Value:
        if self.kind == "extent":
            return next(iter(self.columns.values())).property(name)
        if name not in self.columns:
            raise AnalysisError(Rule.UNKNOWN_COLUMN, f"no column {name}; there are {', '.join(self.columns)}")
        found = self.columns[name]
        if isinstance(found, ClassRow):
            raise AnalysisError(Rule.ARGUMENT_KIND, f"{name} is a class, not a value")
        return found

    def physical(self) -> list[str]:
        """The columns of `df` that make a row, without what only navigations added."""
        found = []
        for v in self.columns.values():
            found += [v.prefix + m.name for m in v.members] if isinstance(v, ClassRow) else [v.name]
        return found

    def with_df(self, df: DataFrame, **changes) -> "Frame":
        """A frame over the same columns; rows keep their ids, so class rows are rebound."""
        new = replace(self, **{"df": df, "joined": dict(self.joined), "order": list(self.order)} | changes)
        new.columns = {n: replace(v, frame=new) if isinstance(v, ClassRow) else v for n, v in new.columns.items()}
        new.joined = {k: replace(v, frame=new) for k, v in new.joined.items()}
        return new


@dataclass(frozen=True)
class Row:
    """A row of a relation."""

    frame: Frame


@dataclass(frozen=True)
class ClassRow:
    """An instance: columns of `frame.df` that start with `prefix`."""

    frame: Frame = field(repr=False, compare=False)
    info: ClassInfo
    prefix: str
    members: tuple
    many: Multiplicity = ONE
    #: Dates in force by axis, which dateless navigations inherit.
    dates: tuple = ()

    def property(self, name: str) -> Value:
        for m in self.members:
            if m.name == name:
                kind = m.type if m.type in PRIMITIVES else "String"  # an enumeration's values are strings
                return Value(named(self.prefix + name), kind, self.many * m.multiplicity, frozenset((self.frame.id,)), name=self.prefix + name)
        raise AnalysisError(Rule.UNKNOWN_PROPERTY, f"{self.info.path} has no column for {name}")


@dataclass(frozen=True)
class ToMany:
    """A collection that belongs to the current row of `owner`."""

    owner: ClassRow
    frame: Frame
    on: tuple[tuple[str, str], ...]
    element: object  # ClassRow or Value of `frame`
    correlated: tuple[Column, ...] = ()
    distinct: bool = False


@dataclass(frozen=True)
class Test:
    """Membership or existence: a semi-join, or an anti-join if negated."""

    frame: Frame  # the rows that are tested
    other: DataFrame
    on: Column
    negated: bool = False
    #: Equal pairs alone (left column, right name), if that is all `on` asks.
    pairs: tuple[tuple[Column, str], ...] | None = None
    #: The value of a membership, whose nulls count: without a match the result is unknown if it is null or a null is in the set.
    value: Column | None = None
    #: The class row that owns a collection; its properties tell rows apart where `on` asks for more than equal pairs.
    row: "ClassRow | None" = None


@dataclass(frozen=True)
class Grouped:
    """The values that a reducing function's parameter stands for."""

    value: Value | None  # None: whole rows
    distinct: bool = False
    #: The window over which reducers run, instead of groups.
    window: object = None


@dataclass(frozen=True)
class Items:
    """A literal collection."""

    values: tuple[Value, ...]
