"""Typed errors: what the analysis refuses, and why."""

from __future__ import annotations

from enum import Enum


class Rule(Enum):
    """The static rules; each value says what is asked."""

    SYNTAX = "the text must parse"
    UNKNOWN_SOURCE = "a source is a mapped class or a store table"
    SOURCE_SHAPE = "a class starts with all(...), a store with tableReference(schema, table)"
    RECEIVER_KIND = "the step doesn't apply to this kind of receiver"
    ARITY = "the step takes another number of arguments"
    ARGUMENT_KIND = "the step takes another kind of argument"
    UNKNOWN_PROPERTY = "a property must exist on its class"
    AMBIGUOUS_PROPERTY = "a property is inherited from more than one class of the same level"
    HIERARCHY_CYCLE = "a class can't inherit from itself"
    UNKNOWN_COLUMN = "a column must exist in the relation"
    DUPLICATE_COLUMN = "the columns of a relation have different names"
    NAME_COUNT = "there must be as many names as columns"
    UNBOUND_VARIABLE = "a variable must be bound"
    OPERAND_TYPE = "the operands' types don't fit the operator"
    COMPARISON = "ordered comparisons need numbers or dates"
    REDUCER = "sums and averages need numbers"
    STRING_RECEIVER = "string functions need a string"
    MULTIPLICITY = "the operand must be a single value"
    JOIN_KIND = "a join is INNER, LEFT or LEFT_OUTER"
    JOIN_SIDES = "a join condition must name both sides"
    DUPLICATE_SORT_KEY = "a sort key stands once"
    NO_ROW_BINDING = "the rows of this relation can't be bound"
    MILESTONE_ARITY = "the number of dates must fit the class's temporal kind"
    INDEX_LITERAL = "an index is a literal string or integer"
    UNMODELED = "the construct is parsed but not executed"
    DEPTH = "the expression is nested too deeply"


    @property
    def code(self) -> str:
        """A stable identifier: numbers are given once, in the order of `CODES`, and never change."""
        return f"AM{CODES.index(self.name) + 1:03}"


#: Rules in the order in which they got their numbers; new ones go to the end.
CODES = (
    "SYNTAX UNKNOWN_SOURCE SOURCE_SHAPE RECEIVER_KIND ARITY ARGUMENT_KIND UNKNOWN_PROPERTY AMBIGUOUS_PROPERTY HIERARCHY_CYCLE UNKNOWN_COLUMN DUPLICATE_COLUMN NAME_COUNT UNBOUND_VARIABLE OPERAND_TYPE "
    "COMPARISON REDUCER STRING_RECEIVER MULTIPLICITY JOIN_KIND JOIN_SIDES DUPLICATE_SORT_KEY NO_ROW_BINDING MILESTONE_ARITY INDEX_LITERAL UNMODELED DEPTH"
).split()


class Reason(Enum):
    """Why a comparison of two queries settles nothing; each value says it to a reader."""

    UNREADABLE = "one of the texts doesn't parse"
    SOURCES = "they read different sources, whose rows may agree all the same"
    WINDOW = "windows are compared by their text only"
    MILESTONING = "dates in force are compared by their text only"
    ORDER = "the result depends on an order that may not be total"
    DIVISION = "quotients are compared by their text only"
    OPAQUE = "an embedded text is not interpreted"
    PREDICATE = "only conditions differ, and they have no normal form"
    REWRITE = "no known rewrite leads from one to the other"

    @property
    def code(self) -> str:
        return f"CMP-{self.name}"


class AnalysisError(Exception):
    def __init__(self, rule: Rule, message: str, at: int | None = None) -> None:
        super().__init__(f"{rule.code} {rule.name}: {message}" + ("" if at is None else f" (at {at})"))
        self.rule, self.at, self.code = rule, at, rule.code
