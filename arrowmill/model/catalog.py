"""The catalogue: classes with typed, multiple-valued properties, associations and table mappings.

Model facts come from model text, from model JSON or from schema JSON (see
`load`); where a class lives and which columns join are given by `map_class`
and `map_association`, as models don't hold that.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import AnalysisError, Rule

NUMERIC = frozenset(("Integer", "Float", "Decimal", "Number"))
TEMPORAL = frozenset(("Date", "StrictDate", "DateTime", "LatestDate"))
PRIMITIVES = NUMERIC | TEMPORAL | {"String", "Boolean", "Any", "Nil"}
MANY = None
MAX_LEVELS = 256


@dataclass(frozen=True)
class Multiplicity:
    lower: int = 1
    upper: int | None = 1

    @staticmethod
    def of(text: str | None) -> "Multiplicity":
        if not text or text == "1":
            return Multiplicity()
        if text == "*":
            return Multiplicity(0, MANY)
        low, _, high = text.partition("..")
        return Multiplicity(int(low), MANY if high == "*" else int(high or low))

    @property
    def to_one(self) -> bool:
        return self.upper is not MANY and self.upper <= 1

    def __mul__(self, other: "Multiplicity") -> "Multiplicity":
        """Bounds of a chained navigation: 0 absorbs, otherwise the unbounded dominates."""
        if self.upper == 0 or other.upper == 0:
            upper = 0
        elif self.upper is MANY or other.upper is MANY:
            upper = MANY
        else:
            upper = self.upper * other.upper
        return Multiplicity(self.lower * other.lower, upper)

    def __str__(self) -> str:
        return f"{self.lower}..{'*' if self.upper is MANY else self.upper}"


ONE, OPTIONAL, SEVERAL = Multiplicity(1, 1), Multiplicity(0, 1), Multiplicity(0, MANY)


@dataclass(frozen=True)
class Member:
    name: str
    type: str
    multiplicity: Multiplicity = ONE
    #: Of an association end: pairs of this class's and the target's properties that join.
    join: tuple[tuple[str, str], ...] = ()
    association: bool = False
    #: Of a qualified property: parameter names and a body over $this.
    parameters: tuple[str, ...] | None = None
    body: object = None
    generated: bool = False

    @property
    def rank(self) -> int:
        return 0 if self.generated else 1 if self.parameters is not None else 3 if self.association else 2


@dataclass
class ClassInfo:
    path: str
    members: list[Member] = field(default_factory=list)
    supers: tuple[str, ...] = ()
    #: None, business, processing or bitemporal.
    temporal: str | None = None
    table: str | None = None
    #: Property to column of the table.
    columns: dict[str, str] = field(default_factory=dict)
    #: Business from and thru, then processing in and out, as far as the temporal kind has them; columns of the table.
    milestones: tuple[tuple[str, str], ...] = ()
    key: tuple[str, ...] = ()
    #: Something about the class isn't known, so that a missing member isn't an error of the query.
    incomplete: bool = False

    @property
    def simple(self) -> str:
        return self.path.rsplit("::", 1)[-1]

    @property
    def dates(self) -> int:
        return {None: 0, "business": 1, "processing": 1, "bitemporal": 2}[self.temporal]


@dataclass
class Catalog:
    classes: dict[str, ClassInfo] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    stores: set[str] = field(default_factory=set)
    #: (schema, table) names of stores, as tableReference gives them, to the reader's names.
    tables: dict[tuple[str, str], str] = field(default_factory=dict)
    #: What later sources replaced.
    warnings: list[str] = field(default_factory=list)

    def add(self, info: ClassInfo) -> ClassInfo:
        if info.path in self.classes:
            self.warnings.append(f"{info.path} is defined again; the later definition stands")
        self.classes[info.path] = info
        return info

    def find(self, path: str) -> ClassInfo:
        if path in self.classes:
            return self.classes[path]
        near = [c for p, c in self.classes.items() if p.rsplit("::", 1)[-1] == path]
        if len(near) == 1:
            return near[0]
        raise AnalysisError(Rule.UNKNOWN_SOURCE, f"no class {path}")

    def knows(self, path: str) -> bool:
        try:
            return bool(self.find(path))
        except AnalysisError:
            return False

    def member(self, owner: ClassInfo, name: str) -> Member:
        """Own members first, then by level of inheritance; of one class the lowest rank."""
        level, seen = [owner], {owner.path}
        for _ in range(MAX_LEVELS):
            found = {}
            for c in level:
                own = sorted((m for m in c.members if m.name == name), key=lambda m: m.rank)
                if own:
                    found[c.path] = own[0]
            if len(found) > 1:
                raise AnalysisError(Rule.AMBIGUOUS_PROPERTY, f"{owner.path}.{name} comes from {', '.join(sorted(found))}")
            if found:
                return next(iter(found.values()))
            following = []
            for c in level:
                for s in c.supers:
                    if s == owner.path:
                        raise AnalysisError(Rule.HIERARCHY_CYCLE, f"{owner.path} inherits from itself")
                    if s in self.classes and s not in seen:
                        seen.add(s)
                        following.append(self.classes[s])
            if not following:
                break
            level = following
        raise AnalysisError(Rule.UNKNOWN_PROPERTY, f"{owner.path} has no {name}" + (", as far as its model is known" if owner.incomplete else ""))

    def properties(self, owner: ClassInfo) -> list[Member]:
        """Primitive single-valued properties, own and inherited, that have a column."""
        found, names, todo = [], set(), [owner]
        while todo:
            c = todo.pop(0)
            for m in c.members:
                if m.name not in names and not m.association and m.parameters is None and (m.type in PRIMITIVES or m.type in self.enums):
                    names.add(m.name)
                    found.append(m)
            todo += [self.classes[s] for s in c.supers if s in self.classes]
        return found

    def associate(self, left: str, left_end: str, left_many: str, right: str, right_end: str, right_many: str, join: list[tuple[str, str]] = ()) -> None:
        """An association: `left_end` is what one navigates from `right` to `left`, and the other way round."""
        a, b = self.find(left), self.find(right)
        b.members.append(Member(left_end, a.path, Multiplicity.of(left_many), tuple((y, x) for x, y in join), association=True))
        a.members.append(Member(right_end, b.path, Multiplicity.of(right_many), tuple(join), association=True))

    def map_class(self, path: str, table: str, columns: dict[str, str], *, key: tuple[str, ...] = (), milestones: tuple[tuple[str, str], ...] = ()) -> None:
        info = self.find(path)
        info.table, info.columns, info.key, info.milestones = table, dict(columns), key, milestones

    def map_association(self, path: str, end: str, join: list[tuple[str, str]]) -> None:
        """Give the join columns, as properties, of an end and of its opposite."""
        info = self.find(path)
        for i, m in enumerate(info.members):
            if m.name == end and m.association:
                info.members[i] = Member(m.name, m.type, m.multiplicity, tuple(join), association=True)
                return
        raise AnalysisError(Rule.UNKNOWN_PROPERTY, f"{path} has no association end {end}")


#: Reads a table by name.
Reader = Callable[[str], DataFrame]


def type_of(kind: T.DataType) -> str:
    """The query language's type of a Spark type."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Integer"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "Float"
    if isinstance(kind, T.DecimalType):
        return "Decimal"
    if isinstance(kind, T.StringType):
        return "String"
    if isinstance(kind, T.BooleanType):
        return "Boolean"
    if isinstance(kind, T.DateType):
        return "StrictDate"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "DateTime"
    return "Any"


SPARK = {"Integer": "bigint", "Float": "double", "Decimal": "decimal(38,18)", "Number": "double", "String": "string", "Boolean": "boolean", "Date": "date", "StrictDate": "date", "DateTime": "timestamp_ntz"}
