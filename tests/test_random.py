"""Random pipelines, built as query text and as SQL side by side."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import rows_of, rows_of_sql

from arrowmill.sources.shop import engine


class Walk:
    """A relation's text, its SQL and its columns by type."""

    def __init__(self, r: random.Random) -> None:
        self.r, self.n = r, 0
        self.text = "shop::Order.all()->project(~[k: x|$x.key, c: x|$x.customerKey, s: x|$x.status])"
        self.sql = "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders"
        self.columns = {"k": "i", "c": "i", "s": "s"}

    def fresh(self) -> str:
        self.n += 1
        return f"v{self.n}"

    def some(self, kind: str) -> str | None:
        found = [c for c, t in self.columns.items() if t == kind]
        return self.r.choice(found) if found else None

    def condition(self) -> tuple[str, str]:
        a, s = self.some("i"), self.some("s")
        options = []
        if a:
            v = self.r.randrange(1, 3000)
            op = self.r.choice(["<", "<=", ">", ">=", "==", "!="])
            options += [(f"$r.{a} {op} {v}", f"{a} {op.replace('==', '=').replace('!=', '<>')} {v}"), (f"$r.{a}->between({v}, {v + 500})", f"{a} BETWEEN {v} AND {v + 500}"), (f"$r.{a}->isNotEmpty()", f"{a} IS NOT NULL")]
        if s:
            options += [(f"$r.{s}->in(['F', 'P'])", f"{s} IN ('F', 'P')"), (f"$r.{s}->toLower() == 'o'", f"lower({s}) = 'o'"), (f"!($r.{s} == 'F')", f"NOT ({s} = 'F')")]
        first = self.r.choice(options)
        if self.r.random() < 0.4:
            second, op = self.r.choice(options), self.r.choice([("&&", "AND"), ("||", "OR")])
            return f"({first[0]}) {op[0]} ({second[0]})", f"({first[1]}) {op[1]} ({second[1]})"
        return first

    def step(self) -> None:
        names = ", ".join(self.columns)
        kind = self.r.choice(["filter", "filter", "extend", "select", "rename", "distinct", "group", "join", "concatenate", "window", "top"])
        a = self.some("i")
        if kind == "filter":
            text, sql = self.condition()
            self.text, self.sql = f"{self.text}->filter(r|{text})", f"SELECT * FROM ({self.sql}) WHERE {sql}"
        elif kind == "extend" and a:
            v, b = self.fresh(), self.some("i")
            self.text, self.sql = f"{self.text}->extend(~{v}: r|$r.{a} * 2 - $r.{b} + 1)", f"SELECT *, {a} * 2 - {b} + 1 AS {v} FROM ({self.sql})"
            self.columns[v] = "i"
        elif kind == "select" and len(self.columns) > 1:
            keep = self.r.sample(list(self.columns), self.r.randrange(1, len(self.columns)))
            self.text, self.sql = f"{self.text}->select(~[{', '.join(keep)}])", f"SELECT {', '.join(keep)} FROM ({self.sql})"
            self.columns = {c: self.columns[c] for c in keep}
        elif kind == "rename":
            old, new = self.r.choice(list(self.columns)), self.fresh()
            self.text, self.sql = f"{self.text}->rename(~{old}, ~{new})", f"SELECT {', '.join(f'{c} AS {new}' if c == old else c for c in self.columns)} FROM ({self.sql})"
            self.columns = {new if c == old else c: t for c, t in self.columns.items()}
        elif kind == "distinct":
            self.text, self.sql = f"{self.text}->distinct()", f"SELECT DISTINCT * FROM ({self.sql})"
        elif kind == "group" and a:
            key, n, m = self.r.choice(list(self.columns)), self.fresh(), self.fresh()
            reducer, sql = self.r.choice([("sum()", "CAST(sum({}) AS BIGINT)"), ("max()", "max({})"), ("distinct()->count()", "count(DISTINCT {})"), ("count()", "count({})")])
            self.text = f"{self.text}->groupBy(~{key}, ~{n}: r|$r.{a} : y|$y->{reducer}, ~{m}: r|$r : y|$y->size())"
            self.sql = f"SELECT {key}, {sql.format(a)} AS {n}, count(*) AS {m} FROM ({self.sql}) GROUP BY {key}"
            self.columns = {key: self.columns[key], n: "i", m: "i"}
        elif kind == "join" and a:
            v, w, how = self.fresh(), self.fresh(), self.r.choice(["INNER", "LEFT"])
            self.text = f"{self.text}->join(shop::Customer.all()->project(~[{v}: x|$x.key, {w}: x|$x.nation.name]), JoinKind.{how}, {{p, q|$p.{a} == $q.{v}}})"
            self.sql = f"SELECT t.*, {v}, {w} FROM ({self.sql}) t {how} JOIN (SELECT c_custkey AS {v}, n_name AS {w} FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey) ON {a} = {v}"
            self.columns |= {v: "i", w: "s"}
        elif kind == "concatenate":
            text, sql = self.condition()
            self.text, self.sql = f"{self.text}->concatenate({self.text}->filter(r|{text}))", f"SELECT * FROM ({self.sql}) UNION ALL SELECT * FROM ({self.sql}) WHERE {sql}"
        elif kind == "window" and a:
            v, key = self.fresh(), self.r.choice(list(self.columns))
            self.text, self.sql = f"{self.text}->extend(over(~{key}), ~{v}: {{p, w, r|$r.{a}}} : y|$y->count())", f"SELECT *, count({a}) OVER (PARTITION BY {key}) AS {v} FROM ({self.sql})"
            self.columns[v] = "i"
        elif kind == "top":
            keys = list(self.columns)
            self.r.shuffle(keys)
            n = self.r.randrange(1, 200)
            self.text = f"{self.text}->sort([{', '.join(f'ascending(~{k})' for k in keys)}])->limit({n})"
            self.sql = f"SELECT {names} FROM ({self.sql}) ORDER BY {', '.join(f'{k} NULLS LAST' for k in keys)} LIMIT {n}"


@pytest.mark.parametrize("seed", range(24))
def test_random_pipelines_equal_their_sql(seed, spark, small, duck):
    walk = Walk(random.Random(seed))
    for _ in range(walk.r.randrange(2, 7)):
        walk.step()
    assert rows_of(engine(spark, small).query("|" + walk.text)) == rows_of_sql(duck, walk.sql), walk.text
