"""The registered queries of the language, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.shop import engine

T = "shop::Db->tableReference('default', '{}')->tableToTDS()".format
_V = "(SELECT event_id, user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)"

#: Name: (ids of the operators, query, SQL).
PAIRS: dict[str, tuple[str, str, str]] = {
    "scan_extent": ("S1 P4", "|shop::Nation.all()->project(~[k: x|$x.key, n: x|$x.name])", "SELECT n_nationkey AS k, n_name AS n FROM nation"),
    "scan_extent_bare": ("S1", "|shop::Nation.all()", "SELECT n_name AS name, n_nationkey AS key, n_regionkey AS \"regionKey\" FROM nation"),
    "scan_table": ("S2 S3", f"|{T('region')}", "SELECT * FROM region"),
    "scan_pointer": ("S7 P7", "|#>{shop::Db.nation}#->select(~[n_name, n_nationkey])", "SELECT n_name, n_nationkey FROM nation"),
    "scan_as_of": ("S4", "|shop::State.all(%2024-01-15)->project(~[k: x|$x.key])", f"SELECT event_id AS k FROM {_V} WHERE ts <= TIMESTAMP '2024-01-15' AND (nx IS NULL OR nx > TIMESTAMP '2024-01-15')"),
    "scan_latest": ("S4 F16", "|shop::State.all(%latest)->project([x|$x.key, x|$x.kind], ['k', 'kind'])", f"SELECT event_id AS k, event_type AS kind FROM {_V} WHERE nx IS NULL"),
    "scan_bitemporal": ("S4", "|shop::Fact.all(%2024-01-20, %2024-01-20T12:00:00)->project(~[k: x|$x.key])", f"SELECT event_id AS k FROM {_V} WHERE ts <= TIMESTAMP '2024-01-20' AND (nx IS NULL OR nx > TIMESTAMP '2024-01-20 12:00:00')"),
    "scan_let_date": ("S4 Q2", "{|let d = %2024-01-10; shop::Entry.all($d)->project(~[k: x|$x.key]);}", f"SELECT event_id AS k FROM {_V} WHERE ts <= TIMESTAMP '2024-01-10' AND (nx IS NULL OR nx > TIMESTAMP '2024-01-10')"),
    "scan_all_versions": ("S5 A11", "|shop::State.allVersions->count()", "SELECT count(*) AS value FROM events"),
    "scan_versions_in_range": ("S6", "|shop::State.allVersionsInRange(%2024-01-05, %2024-01-08)->project(~[k: x|$x.key])", f"SELECT event_id AS k FROM {_V} WHERE ts <= TIMESTAMP '2024-01-08' AND (nx IS NULL OR nx > TIMESTAMP '2024-01-05')"),
    "scan_bitemporal_range": ("S6", "|shop::Fact.allVersionsInRange(%2024-01-05, %2024-01-09, %2024-01-06, %2024-01-08)->project(~[k: x|$x.key])", f"SELECT event_id AS k FROM {_V} WHERE ts <= TIMESTAMP '2024-01-08' AND (nx IS NULL OR nx > TIMESTAMP '2024-01-06')"),
    "new_instance": ("S9", "|^shop::Region(key = 7, name = 'Far''s')->project(~[k: x|$x.key, n: x|$x.name])", "SELECT CAST(7 AS BIGINT) AS k, 'Far''s' AS n"),
    "collection_literal": ("S10 A15", "|[1, 1, 2]->removeDuplicates()", "SELECT CAST(v AS BIGINT) AS value FROM (VALUES (1), (2)) t(v)"),
    "parenthesized": ("S12", "|(shop::Nation.all()->filter(x|$x.regionKey == 1))->project(~[k: x|$x.key])", "SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1"),
    "filter_eq": ("P1 P11", "|shop::Customer.all()->filter(x|$x.segment == 'BUILDING')->project(~[k: x|$x.key])", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_ne": ("P12 F20", "|shop::Customer.all()->filter(x|$x.segment != 'BUILDING')->project(~[k: x|$x.key])", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "filter_tds": ("P1 P25", f"|{T('customer')}->filter(r: TDSRow[1]|$r.getString('c_mktsegment') == 'BUILDING')->restrict('c_custkey')", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "getter_coercion": ("P25", f"|{T('nation')}->filter(r: TDSRow[1]|$r.getInteger('n_regionkey') == '2')->restrict(['n_name'])", "SELECT n_name FROM nation WHERE n_regionkey = 2"),
    "filter_true": ("P15", "|shop::Region.all()->filter(x|true)->project(~[k: x|$x.key])", "SELECT r_regionkey AS k FROM region"),
    "map_scalar": ("P2", "|shop::Nation.all()->map(x|$x.name)", "SELECT n_name AS value FROM nation"),
    "extent_property": ("P3", "|shop::Customer.all().segment->distinct()", "SELECT DISTINCT c_mktsegment AS segment FROM customer"),
    "project_positional": ("P5", "|shop::Part.all()->project([x|$x.key, x|$x.size * 2], ['k', 'twice'])", "SELECT p_partkey AS k, CAST(p_size AS BIGINT) * 2 AS twice FROM part"),
    "project_to_many": ("P5 J7", "|shop::Region.all()->project([x|$x.name, x|$x.nations.name], ['r', 'n'])", "SELECT r_name AS r, n_name AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey"),
    "restrict_list": ("P6", f"|{T('orders')}->restrict(['o_orderkey', 'o_orderstatus'])", "SELECT o_orderkey, o_orderstatus FROM orders"),
    "rename_columns": ("P8 F21", f"|{T('region')}->renameColumns(['r_name'->pair('label'), 'r_regionkey'->pair('id')])", "SELECT r_regionkey AS id, r_name AS label FROM region"),
    "rename_one": ("P9", f"|{T('region')}->rename(~r_name, ~'the name')", "SELECT r_regionkey, r_name AS \"the name\" FROM region"),
    "extend_net": ("P10 F2 F3", f"|{T('lineitem')}->extend(col(r|$r.getFloat('l_extendedprice') * (1 - $r.getFloat('l_discount')), 'net'))->restrict(['l_orderkey', 'l_linenumber', 'net'])", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    "extend_constants": ("P10", f"|{T('region')}->extend([col(r|1, 'one'), col(r|$r.getString('r_name') + '!', 'loud')])", "SELECT r_regionkey, r_name, CAST(1 AS BIGINT) AS one, r_name || '!' AS loud FROM region"),
    "compare_ordered": ("P13", "|shop::Order.all()->filter(x|$x.total > 300000)->filter(x|$x.date < %1997-01-01)->project(~[k: x|$x.key])", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 300000 AND o_orderdate < TIMESTAMP '1997-01-01'"),
    "and_or_not": ("P14 P30", "|shop::Part.all()->filter(x|$x.size < 5 || $x.size > 45 && !($x.brand == 'Brand#11'))->project(~[k: x|$x.key])", "SELECT p_partkey AS k FROM part WHERE p_size < 5 OR p_size > 45 AND NOT (p_brand = 'Brand#11')"),
    "in_list": ("P16", "|shop::Nation.all()->filter(x|$x.name->in(['NATION_1', 'NATION_3']))->project(~[k: x|$x.key])", "SELECT n_nationkey AS k FROM nation WHERE n_name IN ('NATION_1', 'NATION_3')"),
    "in_subquery": ("P16 S11", f"|shop::Customer.all()->filter(x|$x.nationKey->in({T('nation')}->filter(n|$n.getInteger('n_regionkey') == 1).n_nationkey))->project(~[k: x|$x.key])", "SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "in_let": ("P16 Q2", "{|let some = shop::Nation.all()->filter(n|$n.regionKey == 2).key; shop::Supplier.all()->filter(x|$x.nationKey->in($some))->project(~[k: x|$x.key]);}", "SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "not_in_subquery": ("P30", "|shop::Customer.all()->filter(x|!$x.nationKey->in(shop::Nation.all()->filter(n|$n.regionKey == 1).key))->project(~[k: x|$x.key])", "SELECT c_custkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "in_or_condition": ("P16 P14", "|shop::Customer.all()->filter(x|$x.nationKey->in(shop::Nation.all()->filter(n|$n.regionKey == 1).key) || $x.balance > 9000)->project(~[k: x|$x.key])", "SELECT c_custkey AS k FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR c_acctbal > 9000"),
    "between": ("P17", "|shop::LineItem.all()->filter(x|$x.quantity->between(5, 10))->project(~[k: x|$x.orderKey, n: x|$x.number])", "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 10"),
    "exists_many": ("P18 J7", "|shop::Customer.all()->filter(c|$c.orders->exists(o|$o.total > 450000))->project(~[k: c|$c.key])", "SELECT c_custkey AS k FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)"),
    "exists_correlated": ("P18", "|shop::Order.all()->filter(o|$o.lines->exists(l|$l.price * 4 > $o.total))->project(~[k: o|$o.key])", "SELECT o_orderkey AS k FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_extendedprice * 4 > o.o_totalprice)"),
    "exists_correlated_or": ("P18", "|shop::Order.all()->filter(o|$o.lines->exists(l|$l.price * 4 > $o.total) || $o.total > 300000)->project(~[k: o|$o.key])", "SELECT o_orderkey AS k FROM orders o WHERE o_totalprice > 300000 OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_extendedprice * 4 > o.o_totalprice)"),
    "is_empty_many": ("P19 J7", "|shop::Customer.all()->filter(c|$c.orders->filter(o|$o.total > 450000)->isEmpty())->project(~[k: c|$c.key])", "SELECT c_custkey AS k FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)"),
    "is_not_empty_value": ("P19", "|shop::Customer.all()->filter(c|$c.nation.name->isNotEmpty())->project(~[k: c|$c.key])", "SELECT c_custkey AS k FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name IS NOT NULL"),
    "contains_string": ("P20", "|shop::Part.all()->filter(x|$x.kind->contains('MO'))->project(~[k: x|$x.key])", "SELECT p_partkey AS k FROM part WHERE contains(p_type, 'MO')"),
    "starts_ends": ("P21", "|shop::Nation.all()->filter(x|$x.name->startsWith('NATION_1') && !$x.name->endsWith('0'))->project(~[k: x|$x.key])", "SELECT n_nationkey AS k FROM nation WHERE starts_with(n_name, 'NATION_1') AND NOT ends_with(n_name, '0')"),
    "to_one": ("P22", "|shop::Nation.all()->project(~[k: x|$x.key, r: x|$x.region.name->toOne()->toLower()])", "SELECT n_nationkey AS k, lower(r_name) AS r FROM nation LEFT JOIN region ON r_regionkey = n_regionkey"),
    "nav_to_one": ("P23 J6", "|shop::Customer.all()->project(~[k: x|$x.key, r: x|$x.nation.region.name])", "SELECT c_custkey AS k, r_name AS r FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"),
    "quoted_column": ("P24", "|shop::Region.all()->project(~['the key': x|$x.key])->filter(r|$r.'the key' > 2)", "SELECT r_regionkey AS \"the key\" FROM region WHERE r_regionkey > 2"),
    "bracket_index": ("P26", f"|{T('region')}->filter(r|$r['r_name'] != 'ASIA')->restrict('r_regionkey')", "SELECT r_regionkey FROM region WHERE r_name <> 'ASIA'"),
    "milestoned_navigation": ("P27", "|shop::Customer.all()->project(~[k: c|$c.key, s: c|$c.state(%latest).kind])", f"SELECT c_custkey AS k, event_type AS s FROM customer LEFT JOIN (SELECT * FROM {_V} WHERE nx IS NULL) ON user_id = c_custkey"),
    "navigation_all_versions": ("P27 S5", "|shop::Customer.all()->filter(c|$c.stateAllVersions->exists(s|$s.kind == 'purchase'))->project(~[k: c|$c.key])", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'purchase')"),
    "cast_relation": ("P28 F14", f"|{T('region')}->cast(@Relation<(r_regionkey:Float[1], r_name:String[0..1])>)", "SELECT CAST(r_regionkey AS DOUBLE) AS r_regionkey, r_name FROM region"),
    "enum_value": ("P29", "|shop::Customer.all()->filter(c|$c.segment == Segment.MACHINERY)->project(~[k: c|$c.key])", "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'MACHINERY'"),
    "join_inner_classes": ("J1", "|shop::Nation.all()->join(shop::Region.all(), JoinKind.INNER, {a, b|$a.regionKey == $b.key})->project(~[n: r|$r.Nation.name, r: r|$r.Region.name])", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_left_relation": ("J2 J5", "|shop::Customer.all()->project(~[c: x|$x.key])->join(shop::Order.all()->filter(o|$o.total > 400000)->project(~[o: x|$x.key, oc: x|$x.customerKey]), JoinKind.LEFT, {a, b|$a.c == $b.oc})", "SELECT c_custkey AS c, o_orderkey AS o, o_custkey AS oc FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey"),
    "join_inner_tds": ("J3", f"|{T('orders')}->restrict(['o_orderkey', 'o_custkey'])->join({T('customer')}->restrict(['c_custkey', 'c_name']), JoinType.INNER, {{r1: TDSRow[1], r2: TDSRow[1]|$r1.getInteger('o_custkey') == $r2.getInteger('c_custkey')}})", "SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_left_tds": ("J4", f"|{T('customer')}->restrict('c_custkey')->join({T('orders')}->restrict(['o_orderkey', 'o_custkey']), JoinType.LEFT_OUTER, {{a: TDSRow[1], b: TDSRow[1]|$a.getInteger('c_custkey') == $b.getInteger('o_custkey')}})", "SELECT c_custkey, o_orderkey, o_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "join_grouped": ("J5", "|shop::Customer.all()->project(~[n: x|$x.nationKey, c: x|$x.key])->groupBy(~n, ~customers: x|$x.c : y|$y->count())->join(shop::Supplier.all()->project(~[m: x|$x.nationKey, s: x|$x.key])->groupBy(~m, ~suppliers: x|$x.s : y|$y->distinct()->count()), JoinKind.INNER, {a, b|$a.n == $b.m})->select(~[n, customers, suppliers])", "SELECT n, customers, suppliers FROM (SELECT c_nationkey AS n, count(c_custkey) AS customers FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS m, count(DISTINCT s_suppkey) AS suppliers FROM supplier GROUP BY 1) ON n = m"),
    "join_theta": ("J3 J8", "|shop::Region.all()->project(~[a: x|$x.key])->join(shop::Region.all()->project(~[b: x|$x.key]), JoinKind.INNER, {x, y|$x.a != $y.b})", "SELECT x.r_regionkey AS a, y.r_regionkey AS b FROM region x JOIN region y ON x.r_regionkey <> y.r_regionkey"),
    "count_many": ("J7 A5", "|shop::Customer.all()->project(~[k: c|$c.key, n: c|$c.orders->count(), big: c|$c.orders->filter(o|$o.total > 200000)->size()])", "SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS big FROM customer"),
    "count_many_correlated": ("J7 A5", "|shop::Customer.all()->project(~[k: c|$c.key, n: c|$c.orders->filter(o|$o.total > $c.balance * 30)->count(), top: c|$c.orders->filter(o|$o.total > $c.balance * 30).total->max()])", "SELECT c_custkey AS k, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30) AS n, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30) AS top FROM customer"),
    "not_in_or_condition": ("P16 P30", "|shop::Customer.all()->filter(x|!($x.nationKey->in(shop::Nation.all()->filter(n|$n.regionKey == 1).key) || $x.balance > 9000))->project(~[k: x|$x.key])", "SELECT c_custkey AS k FROM customer WHERE NOT (c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR c_acctbal > 9000)"),
    "sum_many": ("J7 A7", "|shop::Customer.all()->project(~[k: c|$c.key, t: c|$c.orders.amount->sum()->cast(@Float)])", "SELECT c_custkey AS k, (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders WHERE o_custkey = c_custkey) AS t FROM customer"),
    "nested_many": ("J7", "|shop::Customer.all()->filter(c|$c.orders.lines->exists(l|$l.quantity == 50 && $l.flag == 'R'))->project(~[k: c|$c.key])", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity = 50 AND l_returnflag = 'R')"),
    "as_of_join": ("J9", "|shop::Order.all()->filter(o|$o.customerKey < 300)->project(~[o: x|$x.key, c: x|$x.customerKey, d: x|$x.date])->asOfJoin(shop::Order.all()->filter(o|$o.status == 'F')->project(~[f: x|$x.key, fc: x|$x.customerKey, fd: x|$x.date]), {a, b|$a.d > $b.fd}, {a, b|$a.c == $b.fc})->select(~[o, fd])", "SELECT a.o_orderkey AS o, (SELECT max(b.o_orderdate) FROM orders b WHERE b.o_orderstatus = 'F' AND b.o_custkey = a.o_custkey AND b.o_orderdate < a.o_orderdate) AS fd FROM orders a WHERE a.o_custkey < 300"),
    "group_class": ("A1 A4 A8", "|shop::LineItem.all()->groupBy([x|$x.flag], [agg(x|$x.amount, y|$y->sum()->cast(@Float)), agg(x|$x.rate, y|$y->average())], ['flag', 'total', 'rate'])", "SELECT l_returnflag AS flag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(l_discount) AS rate FROM lineitem GROUP BY 1"),
    "group_class_nav": ("A1 P23", "|shop::Customer.all()->groupBy([x|$x.nation.region.name], [agg(x|$x.key, y|$y->count())], ['region', 'n'])", "SELECT r_name AS region, count(c_custkey) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "group_class_global": ("A1", "|shop::Customer.all()->groupBy([], [agg(x|$x.key, y|$y->count())], ['n'])", "SELECT count(c_custkey) AS n FROM customer"),
    "group_tds": ("A2 A5 A7", f"|{T('lineitem')}->groupBy(['l_returnflag', 'l_linestatus'], agg('cnt', r: TDSRow[1]|$r, y: TDSRow[*]|$y->count()), agg('qty', r: TDSRow[1]|$r.getFloat('l_quantity'), y: Float[*]|$y->sum()))", "SELECT l_returnflag, l_linestatus, count(*) AS cnt, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2"),
    "group_tds_global": ("A2", f"|{T('orders')}->groupBy([], agg('C', r: TDSRow[1]|$r, y: TDSRow[*]|$y->count()))", "SELECT count(*) AS \"C\" FROM orders"),
    "group_relation": ("A3", "|shop::Order.all()->project(~[s: x|$x.status, t: x|$x.amount])->groupBy(~[s], ~'Total': x|$x.t : y|$y->sum()->cast(@Float), ~n: x|$x.t : y|$y->size())", "SELECT o_orderstatus AS s, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS \"Total\", count(o_totalprice) AS n FROM orders GROUP BY 1"),
    "group_relation_global": ("A3", "|shop::Order.all()->groupBy(~[], ~n: x|$x.key : y|$y->count())", "SELECT count(o_orderkey) AS n FROM orders"),
    "count_distinct": ("A10", "|shop::Order.all()->groupBy(~[], ~c: x|$x.customerKey : y|$y->distinct()->count())", "SELECT count(DISTINCT o_custkey) AS c FROM orders"),
    "min_max_string": ("A9", "|shop::Nation.all()->groupBy([], [agg(x|$x.name, y|$y->min()), agg(x|$x.name, y|$y->max())], ['lo', 'hi'])", "SELECT min(n_name) AS lo, max(n_name) AS hi FROM nation"),
    "count_extent": ("A11 Q3b", "|count(shop::Part.all())", "SELECT count(*) AS value FROM part"),
    "size_scalar": ("A6 A11", "|shop::Nation.all().name->size()", "SELECT count(n_name) AS value FROM nation"),
    "having": ("A12", f"|{T('orders')}->groupBy('o_custkey', agg('cnt', r|$r, y|$y->count()))->filter(r|$r.getInteger('cnt') >= 15)", "SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY 1 HAVING count(*) >= 15"),
    "distinct_row": ("A13", f"|{T('lineitem')}->restrict('l_returnflag')->distinct()", "SELECT DISTINCT l_returnflag FROM lineitem"),
    "distinct_on": ("A14", "|shop::LineItem.all()->project(~[flag: x|$x.flag, n: x|$x.number, status: x|$x.status])->distinct(~[flag, status])", "SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status FROM lineitem"),
    "pivot_status": ("A16", "|shop::LineItem.all()->project(~[flag: x|$x.flag, status: x|$x.status, q: x|$x.quantity])->pivot(~[status], ['F', 'O'], ~[qty: x|$x.q : y|$y->sum()])", "SELECT l_returnflag AS flag, sum(l_quantity) FILTER (l_linestatus = 'F') AS \"F__qty\", sum(l_quantity) FILTER (l_linestatus = 'O') AS \"O__qty\" FROM lineitem GROUP BY 1"),
    "pivot_found_values": ("A16", "|shop::LineItem.all()->project(~[flag: x|$x.flag, status: x|$x.status, q: x|$x.quantity])->pivot(~[status], ~[qty: x|$x.q : y|$y->sum()])", "SELECT l_returnflag AS flag, sum(l_quantity) FILTER (l_linestatus = 'F') AS \"F__qty\", sum(l_quantity) FILTER (l_linestatus = 'O') AS \"O__qty\" FROM lineitem GROUP BY 1"),
    "olap_row_number": ("W1 W2", f"|{T('orders')}->restrict(['o_orderkey', 'o_custkey', 'o_totalprice'])->olapGroupBy(['o_custkey'], desc('o_totalprice'), asc('o_orderkey'), y|$y->rowNumber(), 'rn')->restrict(['o_orderkey', 'rn'])", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders"),
    "window_sum": ("W3 W4 W5", "|shop::Order.all()->project(~[o: x|$x.key, c: x|$x.customerKey, a: x|$x.amount])->extend(over(~c), ~[t: {p, w, r|$r.a} : y|$y->sum()->cast(@Float)])->select(~[o, t])", "SELECT o_orderkey AS o, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS t FROM orders"),
    "window_rank": ("W6", "|shop::Supplier.all()->project(~[s: x|$x.key, n: x|$x.nationKey, b: x|$x.balance])->extend(over(~n, ~b->ascending()), ~[rk: {p, w, r|$p->rank($w, $r)}])->select(~[s, rk])", "SELECT s_suppkey AS s, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS rk FROM supplier"),
    "window_rows": ("W7", "|shop::Order.all()->project(~[o: x|$x.key, c: x|$x.customerKey, a: x|$x.amount])->extend(over(~c, ~o->ascending(), rows(-2, 0)), ~[t: {p, w, r|$r.a} : y|$y->sum()->cast(@Float)])->select(~[o, t])", "SELECT o_orderkey AS o, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS t FROM orders"),
    "window_range": ("W8", "|shop::Order.all()->project(~[o: x|$x.key, c: x|$x.customerKey])->extend(over(~c, ~o->ascending(), range(-500, 0)), ~n: {p, w, r|$r.o} : y|$y->count())->select(~[o, n])", "SELECT o_orderkey AS o, count(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS n FROM orders"),
    "window_forms": ("W9 W10", "|shop::Nation.all()->project(~[k: x|$x.key, r: x|$x.regionKey])->extend(over(~[r, k]), ~[a: {p, w, x|$x.k} : y|$y->count()])->extend(over(~[]), ~[b: {p, w, x|$x.k} : y|$y->max()])->extend(over(~k->ascending()), ~[c: {p, w, x|$x.k} : y|$y->sum()])->extend(over(~r), ~[d: {p, w, x|$x.k}])", "SELECT n_nationkey AS k, n_regionkey AS r, count(n_nationkey) OVER (PARTITION BY n_regionkey, n_nationkey) AS a, max(n_nationkey) OVER () AS b, CAST(sum(n_nationkey) OVER (ORDER BY n_nationkey) AS BIGINT) AS c, n_nationkey AS d FROM nation"),
    "topk": ("O1 O7 O8", f"|{T('orders')}->restrict(['o_orderkey', 'o_totalprice'])->sort(desc('o_totalprice'), asc('o_orderkey'))->limit(10)", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10"),
    "sort_relation": ("O1 O6", "|shop::Part.all()->project(~[k: x|$x.key, s: x|$x.size])->sort([~s->descending(), ascending(~k)])->take(7)", "SELECT p_partkey AS k, p_size AS s FROM part ORDER BY p_size DESC NULLS LAST, p_partkey LIMIT 7"),
    "sort_direction": ("O2", f"|{T('nation')}->restrict(['n_nationkey'])->sort('n_nationkey', SortDirection.DESC)->limit(3)", "SELECT n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 3"),
    "sort_nulls_first": ("O4", "|shop::Region.all()->project(~[k: x|if($x.key < 2, |$x.key, |$x.key)])->sort([ascending(~k)->nullsFirst()])->take(2)", "SELECT r_regionkey AS k FROM region ORDER BY 1 NULLS FIRST LIMIT 2"),
    "sort_stable": ("O5", f"|{T('nation')}->restrict(['n_nationkey', 'n_regionkey'])->sort(desc('n_nationkey'))->sort(asc('n_regionkey'))->limit(20)", "SELECT n_nationkey, n_regionkey FROM nation ORDER BY n_regionkey, n_nationkey DESC LIMIT 20"),
    "sort_by_stable": ("O10 F22", "|[58, 34, 74, 38, 94]->sortBy(x|$x->mod(7))->sortBy(x|$x->mod(10))->take(2)", "SELECT CAST(v AS BIGINT) AS value FROM (VALUES (94), (74)) t(v)"),
    "to_bytes": ("F24", "|shop::Nation.all()->project(~[name: n|$n.name, raw: n|$n.name->toBytes()])->filter(r|$r.raw->isNotEmpty())->project(~[name: r|$r.name])", "SELECT n_name AS name FROM nation WHERE encode(n_name) IS NOT NULL"),
    "drop_slice": ("O9", "|shop::Nation.all()->project(~[k: x|$x.key])->sort([ascending(~k)])->drop(3)->slice(2, 6)", "SELECT n_nationkey AS k FROM nation ORDER BY 1 LIMIT 4 OFFSET 5"),
    "reverse_last": ("O9", "|shop::Nation.all()->project(~[k: x|$x.key])->sort([ascending(~k)])->reverse()->init()->last()", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey = 1"),
    "fold_add": ("O9", "|[1, 2, 3]->add(4)->fold({x, a|$x + $a}, 10)", "SELECT CAST(20 AS BIGINT) AS value"),
    "concat_rows": ("U1", f"|{T('nation')}->restrict('n_name')->renameColumns('n_name'->pair('name'))->concatenate({T('region')}->restrict('r_name'))", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region"),
    "concat_distinct": ("U2", "|shop::Customer.all()->project(~[n: x|$x.nationKey])->concatenate(shop::Supplier.all()->project(~[m: x|$x.nationKey]))->distinct()", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier"),
    "arithmetic": ("F1 F4 F5", "|shop::Part.all()->project(~[k: x|$x.key, a: x|$x.size + 1, b: x|$x.size / 4, c: x|-$x.size, d: x|($x.price - 1) * 2, s: x|$x.brand + '/' + $x.kind])", "SELECT p_partkey AS k, CAST(p_size AS BIGINT) + 1 AS a, p_size / 4.0::DOUBLE AS b, -p_size AS c, (p_retailprice - 1) * 2 AS d, p_brand || '/' || p_type AS s FROM part"),
    "if_expr": ("F6", "|shop::Customer.all()->project(~[k: x|$x.key, s: x|if($x.balance < 0, |'neg', |'pos')])", "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 'neg' ELSE 'pos' END AS s FROM customer"),
    "string_functions": ("F7 F8 F9", "|shop::Nation.all()->project(~[k: x|$x.key->toString(), u: x|$x.name->toUpper(), l: x|$x.name->toLower(), p: x|$x.name->substring(0, 3), q: x|$x.name->substring(2)])", "SELECT CAST(n_nationkey AS VARCHAR) AS k, upper(n_name) AS u, lower(n_name) AS l, substr(n_name, 1, 3) AS p, substr(n_name, 3) AS q FROM nation"),
    "parse_numbers": ("F10", "|shop::Nation.all()->project(~[k: x|$x.key->toString()->parseInteger(), f: x|($x.key->toString() + '.5')->parseFloat()])", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey || '.5' AS DOUBLE) AS f FROM nation"),
    "year_counts": ("F11", "|shop::Order.all()->groupBy([x|$x.date->year()], [agg(x|$x.key, y|$y->count())], ['y', 'n'])", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "scalar_at": ("F12 Q2", "{|let top = shop::Order.all()->project(~[t: x|$x.total, k: x|$x.key])->sort([descending(~t), ascending(~k)]); shop::Order.all()->filter(o|$o.total == $top->at(0).getFloat('t'))->project(~[k: o|$o.key]);}", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)"),
    "first_row": ("F13", "|shop::Order.all()->project(~[k: x|$x.key])->sort([ascending(~k)])->first()", "SELECT min(o_orderkey) AS k FROM orders"),
    "today_filter": ("F15", "|shop::Order.all()->filter(o|$o.date < today())->filter(o|$o.date < now())->groupBy(~[], ~n: x|$x.key : y|$y->count())", "SELECT count(*) AS n FROM orders WHERE o_orderdate < today()"),
    "float_literals": ("F19", "|shop::LineItem.all()->filter(l|$l.discount > .05 && $l.tax < 1.5e-2)->project(~[k: l|$l.orderKey, n: l|$l.number])", "SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_discount > 0.05::DOUBLE AND l_tax < 0.015::DOUBLE"),
    "qualified_property": ("F23", "|shop::Customer.all()->project(~[k: x|$x.key, l: x|$x.label()])", "SELECT c_custkey AS k, c_name || ' of ' || n_name AS l FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"),
    "prefix_calls": ("Q3b", "|filter(shop::Region.all(), {x|$x.key > 1})->project(~[k: x|toString($x.key)])", "SELECT CAST(r_regionkey AS VARCHAR) AS k FROM region WHERE r_regionkey > 1"),
    "typed_lambdas": ("Q3 Q4", "|shop::Region.all()->project(~[k: x: shop::Region[1]|$x.key])->filter({r: Relation<(k:Integer)>[1]|$r.k < 3})", "SELECT r_regionkey AS k FROM region WHERE r_regionkey < 3"),
    "flagship": ("S1 P1 P4 P23 O1", "|shop::Customer.all()->filter(x|$x.segment == 'BUILDING')->project(~[key: x|$x.key, nation: x|$x.nation.name])->sort([ascending(~key)])", "SELECT c_custkey AS key, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'"),
    "revenue_by_region": ("headline", "|shop::LineItem.all()->filter(l|$l.shipped->between(%1995-01-01, %1996-12-31))->groupBy([l|$l.order.customer.nation.region.name, l|$l.shipped->year()], [agg(l|$l.amount, y|$y->sum()->cast(@Float)), agg(l|$l.order.key, y|$y->distinct()->count())], ['region', 'year', 'revenue', 'orders'])", "SELECT r_name AS region, year(l_shipdate) AS year, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1, 2"),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).query(text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(q) for name, (_, q, _) in PAIRS.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, _, sql) in PAIRS.items()}
