"""What the analysis refuses, by rule; nothing of it starts a job."""

import pytest

from arrowmill.errors import AnalysisError, Rule
from arrowmill.registry import T
from arrowmill.sources.shop import engine

C, N = "|shop::Customer.all()", f"|{T('nation')}"
CASES = [
    ("|shop::Nothing.all()", Rule.UNKNOWN_SOURCE),
    ("|other::Db->tableReference('default', 'nation')->tableToTDS()", Rule.UNKNOWN_SOURCE),
    ("|shop::Db->tableReference('default', 'nowhere')", Rule.UNKNOWN_SOURCE),
    ("|shop::Db->tableReference('nation')", Rule.ARITY),
    ("|shop::Customer.some()", Rule.SOURCE_SHAPE),
    (f"{C}->restrict('name')", Rule.RECEIVER_KIND),
    (f"{C}->renameColumns('a'->pair('b'))", Rule.RECEIVER_KIND),
    (f"{C}->count(1)", Rule.ARITY),
    (f"{C}->filter(x|$x.orders->isEmpty(1))", Rule.ARITY),
    (f"{C}->groupBy('name', agg('n', r|$r, y|$y->count()))", Rule.ARGUMENT_KIND),
    (f"{C}->limit('3')", Rule.ARGUMENT_KIND),
    (f"{C}->filter(x|$x.nothing == 1)", Rule.UNKNOWN_PROPERTY),
    (f"{C}->filter(x|$x.nation.customerKey == 1)", Rule.UNKNOWN_PROPERTY),
    (f"{C}->filter(x|$y.name == 'a')", Rule.UNBOUND_VARIABLE),
    (f"{C}->filter(x|$x.name && true)", Rule.OPERAND_TYPE),
    (f"{C}->filter(x|$x.name == 1)", Rule.OPERAND_TYPE),
    (f"{C}->filter(x|$x.name < 'b')", Rule.COMPARISON),
    (f"{C}->filter(x|$x.key->startsWith('1'))", Rule.STRING_RECEIVER),
    (f"{C}->filter(x|$x.orders.total > 1)", Rule.MULTIPLICITY),
    (f"{C}->project(~[a: x|$x.name, a: x|$x.key])", Rule.DUPLICATE_COLUMN),
    (f"{C}->project([x|$x.name], ['a', 'b'])", Rule.NAME_COUNT),
    (f"{C}->project(~[])", Rule.ARITY),
    (f"{C}->groupBy([], [agg(x|$x.name, y|$y->sum())], ['t'])", Rule.REDUCER),
    (f"{C}->groupBy([], [agg(x|$x.key, y|$y)], ['t'])", Rule.REDUCER),
    (f"{C}->join(shop::Order.all(), JoinKind.OUTER, {{a, b|$a.key == $b.customerKey}})", Rule.JOIN_KIND),
    (f"{C}->join(shop::Order.all(), JoinKind.INNER, {{a, b|$a.key == 1}})", Rule.JOIN_SIDES),
    (f"{C}->join(shop::Customer.all(), JoinKind.INNER, {{a, b|$a.key == $b.key}})", Rule.DUPLICATE_COLUMN),
    (f"{N}->restrict('n_nothing')", Rule.UNKNOWN_COLUMN),
    (f"{N}->filter(r|$r.getString('n_nothing') == 'a')", Rule.UNKNOWN_COLUMN),
    (f"{N}->restrict(['n_name', 'n_name'])", Rule.DUPLICATE_COLUMN),
    (f"{N}->sort(asc('n_name'), desc('n_name'))", Rule.DUPLICATE_SORT_KEY),
    (f"{N}->extend(over(~n_regionkey), ~[r: {{p, w, x|$p->rank($w, $x)}}])", Rule.ARGUMENT_KIND),
    (f"{N}->distinct(~[n_name, other])", Rule.UNKNOWN_COLUMN),
    ("|shop::State.all()", Rule.MILESTONE_ARITY),
    ("|shop::Fact.all(%latest)", Rule.MILESTONE_ARITY),
    (f"{C}->filter(c|$c.state.kind == 'view')", Rule.MILESTONE_ARITY),
    (f"{C}->filter(c|$c.state(%latest, %latest).kind == 'view')", Rule.MILESTONE_ARITY),
    ("|shop::Fact.allVersionsInRange(%2020-01-01, %2020-01-02)", Rule.MILESTONE_ARITY),
    (f"{C}->filter(c|$c.segment == Segment.NONE)", Rule.UNKNOWN_PROPERTY),
    (f"{C}->nothing()", Rule.UNMODELED),
    ("|#/shop/path#", Rule.UNMODELED),
    (f"{C}.all", Rule.UNKNOWN_PROPERTY),
]


@pytest.mark.parametrize("text, rule", CASES)
def test_refused(text, rule, spark, small):
    with pytest.raises(AnalysisError) as e:
        engine(spark, small).query(text)
    assert e.value.rule is rule, str(e.value)
