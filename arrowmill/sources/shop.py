"""The catalogue over the star schema of the test tables, and its reader."""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine
from ..model.catalog import Catalog
from ..model.load import from_text

MODEL = """
Enum shop::Segment { AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD, MACHINERY }
Class shop::Named { name: String[0..1]; }
Class shop::Region extends shop::Named { key: Integer[1]; }
Class shop::Nation extends shop::Named { key: Integer[1]; regionKey: Integer[0..1]; }
Class shop::Customer extends shop::Named {
  key: Integer[1]; nationKey: Integer[0..1]; balance: Float[0..1]; account: Decimal[0..1]; segment: shop::Segment[0..1];
  label() { $this.name + ' of ' + $this.nation.name }: String[0..1];
}
Class shop::Supplier extends shop::Named { key: Integer[1]; nationKey: Integer[0..1]; balance: Float[0..1]; }
Class shop::Part extends shop::Named { key: Integer[1]; brand: String[0..1]; kind: String[0..1]; size: Integer[0..1]; price: Float[0..1]; }
Class shop::Order { key: Integer[1]; customerKey: Integer[0..1]; status: String[0..1]; total: Float[0..1]; amount: Decimal[0..1]; date: DateTime[0..1]; priority: String[0..1]; }
Class shop::LineItem {
  orderKey: Integer[1]; number: Integer[1]; partKey: Integer[0..1]; supplierKey: Integer[0..1]; quantity: Float[0..1]; price: Float[0..1]; amount: Decimal[0..1];
  discount: Float[0..1]; rate: Decimal[0..1]; tax: Float[0..1]; flag: String[0..1]; status: String[0..1]; shipped: DateTime[0..1];
}
Class shop::Event { key: Integer[1]; at: DateTime[0..1]; user: Integer[0..1]; kind: String[0..1]; value: Float[0..1]; }
Class <<temporal.businesstemporal>> shop::State { key: Integer[1]; user: Integer[0..1]; kind: String[0..1]; }
Class <<temporal.processingtemporal>> shop::Entry { key: Integer[1]; user: Integer[0..1]; kind: String[0..1]; }
Class <<temporal.bitemporal>> shop::Fact { key: Integer[1]; user: Integer[0..1]; kind: String[0..1]; }
"""

#: Class, table, columns by property, key.
_CLASSES = (
    ("Region", "region", "key=r_regionkey name=r_name"),
    ("Nation", "nation", "key=n_nationkey name=n_name regionKey=n_regionkey"),
    ("Customer", "customer", "key=c_custkey name=c_name nationKey=c_nationkey balance=c_acctbal account=CAST(c_acctbal&AS&DECIMAL(18,2)) segment=c_mktsegment"),
    ("Supplier", "supplier", "key=s_suppkey name=s_name nationKey=s_nationkey balance=s_acctbal"),
    ("Part", "part", "key=p_partkey name=p_name brand=p_brand kind=p_type size=p_size price=p_retailprice"),
    ("Order", "orders", "key=o_orderkey customerKey=o_custkey status=o_orderstatus total=o_totalprice amount=CAST(o_totalprice&AS&DECIMAL(18,2)) date=o_orderdate priority=o_orderpriority"),
    ("LineItem", "lineitem", "orderKey=l_orderkey number=l_linenumber partKey=l_partkey supplierKey=l_suppkey quantity=l_quantity price=l_extendedprice amount=CAST(l_extendedprice&AS&DECIMAL(18,2)) discount=l_discount rate=CAST(l_discount&AS&DECIMAL(18,2)) tax=l_tax flag=l_returnflag status=l_linestatus shipped=l_shipdate"),
    ("Event", "events", "key=event_id at=ts user=user_id kind=event_type value=value"),
)
#: Class at the one side's end, its end, class at the many side, its end, and the many side's and one side's joined properties.
_ASSOCIATIONS = (
    ("Region", "region", "Nation", "nations", "regionKey", "key"),
    ("Nation", "nation", "Customer", "customers", "nationKey", "key"),
    ("Nation", "nation", "Supplier", "suppliers", "nationKey", "key"),
    ("Customer", "customer", "Order", "orders", "customerKey", "key"),
    ("Order", "order", "LineItem", "lines", "orderKey", "key"),
    ("Part", "part", "LineItem", "lines", "partKey", "key"),
    ("Supplier", "supplier", "LineItem", "lines", "supplierKey", "key"),
)
PLAIN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


@functools.cache
def catalog() -> Catalog:
    c = from_text(MODEL)
    for name, table, columns in _CLASSES:
        pairs = dict(p.replace("&", " ").split("=", 1) for p in columns.split())
        c.map_class(f"shop::{name}", table, pairs, key=("orderKey", "number") if name == "LineItem" else ("key",))
    for one, end, several, ends, own, other in _ASSOCIATIONS:
        c.associate(f"shop::{one}", end, "0..1", f"shop::{several}", ends, "*", [(other, own)])
    versions = {"key": "event_id", "user": "user_id", "kind": "event_type"}
    c.map_class("shop::State", "versions", versions, key=("key",), milestones=(("valid_from", "valid_thru"),))
    c.map_class("shop::Entry", "versions", versions, key=("key",), milestones=(("ts", "next_ts"),))
    c.map_class("shop::Fact", "versions", versions, key=("key",), milestones=(("ts", "next_ts"), ("valid_from", "valid_thru")))
    for name in ("State", "Entry", "Fact"):
        c.associate(f"shop::{name}", name.lower(), "0..1", "shop::Customer", f"of{name}", "*", [("user", "key")])
    c.stores.add("shop::Db")
    c.tables.update({("default", t): t for t in (*PLAIN, "embeddings", "versions")})
    return c


def reader(spark: SparkSession, sf_dir: str):
    def read(name: str) -> DataFrame:
        if name == "versions":
            # Each event holds until the user's next one; business validity ends 30 days after at the latest.
            nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
            e = read("events").withColumn("next_ts", nxt)
            return e.select("event_id", "user_id", "event_type", "ts", "next_ts", F.col("ts").alias("valid_from"), F.col("next_ts").alias("valid_thru"))
        df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
        return df.drop("embedding") if name == "embeddings" else df

    return read


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, catalog(), reader(spark, sf_dir))
