"""The engine's front door."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .language.canonical import Comparison, canonical, compare
from .model.catalog import Catalog, Reader
from .plans.compiler import Compiler


class Engine:
    """Compiles query text to DataFrames; nothing runs before an action."""

    def __init__(self, spark: SparkSession, catalog: Catalog, reader: Reader) -> None:
        self.spark, self.catalog, self.reader = spark, catalog, reader

    def query(self, text: str) -> DataFrame:
        return Compiler(self.spark, self.catalog, self.reader).dataframe(text)

    def schema(self, text: str) -> tuple[tuple[str, str], ...]:
        """Ordered column names and types."""
        return tuple((f.name, f.dataType.simpleString()) for f in self.query(text).schema.fields)

    def compare(self, left: str, right: str) -> Comparison:
        return compare(left, right, self.schema)

    @staticmethod
    def canonical(text: str) -> str:
        return canonical(text)
