"""The syntax tree. All nodes are immutable and compare by value."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Literal(Node):
    value: object
    kind: str  # Integer Float String Boolean StrictDate DateTime LatestDate


@dataclass(frozen=True)
class Variable(Node):
    name: str


@dataclass(frozen=True)
class Path(Node):
    """A qualified name: a class, a store, or the owner of an enumeration's value."""

    name: str

    @property
    def simple(self) -> str:
        return self.name.rsplit("::", 1)[-1]


@dataclass(frozen=True)
class Call(Node):
    """name(args) and, with the receiver first, receiver->name(args)."""

    name: str
    args: tuple[Node, ...]
    arrow: bool = field(default=True, compare=False)
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Property(Node):
    """receiver.name, or receiver.name(args)."""

    receiver: Node
    name: str
    args: tuple[Node, ...] | None = None
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Index(Node):
    receiver: Node
    index: Node


@dataclass(frozen=True)
class TypeRef(Node):
    name: str
    columns: tuple[tuple[str, "TypeRef"], ...] = ()
    multiplicity: str | None = None


@dataclass(frozen=True)
class Lambda(Node):
    parameters: tuple[str, ...]
    body: Node
    types: tuple[TypeRef | None, ...] = field(default=(), compare=False)


@dataclass(frozen=True)
class Column(Node):
    """One of ~[...]: a name, maybe a type, a function, and a reducing function."""

    name: str
    function: Lambda | None = None
    reduce: Lambda | None = None
    type: TypeRef | None = None


@dataclass(frozen=True)
class Columns(Node):
    items: tuple[Column, ...]
    bracketed: bool = field(default=True, compare=False)


@dataclass(frozen=True)
class ListOf(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class Instance(Node):
    """^Class(name = value, ...)"""

    type: Path
    values: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class TablePointer(Node):
    """#>{store.table}#"""

    store: str
    table: str


@dataclass(frozen=True)
class Island(Node):
    """Another embedded text, kept as it is."""

    text: str


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Block(Node):
    """let name = value; ... result"""

    lets: tuple[tuple[str, Node], ...]
    result: Node
