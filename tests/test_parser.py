import pytest

from sluice.plans import nodes as N
from sluice.plans.dsl import Q
from sluice.plans.parser import ParseError, parse


def test_names_and_tables():
    plan = parse("(-> (from :orders [xt/id a]) (join (-> (from :c [*]) (left-join (from :n [x]) {:k :xt/id})) {:a :b :c :d}))")
    assert isinstance(plan, N.Join) and plan.keys == (("a", "b"), ("c", "d"))
    assert plan.input.names == ("_id", "a")
    assert plan.tables() == {"orders", "c", "n"}
    assert parse("(unify (from :a [x]) (from :b [x]) {:x :x})").tables() == {"a", "b"}


def test_with_keeps_order_and_takes_subqueries():
    plan = parse("(-> (from :t [a]) (with {:b 1 :a b :e (exists (from :u [k]) {:a :k}) :c 2}))")
    assert [n for n, _ in plan.fields] == ["c"]
    assert isinstance(plan.input, N.Exists)
    assert [n for n, _ in plan.input.input.fields] == ["b", "a"]


def test_where_takes_all_predicates_and_unnest_all_bindings():
    assert len(parse("(-> (from :t [a]) (where a (> a 1)))").predicates) == 2
    assert parse("(-> (from :t [a]) (unnest {:x a :y x}))").input.name == "x"


def test_group_names():
    def names(text):
        return parse(f"(-> (from :t [a b]) (aggregate {text} {{:n (row-count)}}))").group

    assert names(":a")[0][0] == "a" and names("a")[0][0] == "group_key" and names("nil") == ()
    assert parse("(-> (from :t [a b]) (aggregate [a :b] {:n (row-count)}))").packed


@pytest.mark.parametrize(
    "text",
    [
        "(order-by a)", "(where a)", "(-> (from :t [a]) (sort a))", "(from :t)", "(-> (from :t [a]) (limit -1))", "(-> (from :t [a]) (limit 1.5))",
        "(-> (from :t [a]) (aggregate {:x (median a)}))", "(-> (from :t [a]) (aggregate {:x (sum)}))", "(-> (from :t [a]) (join (from :u [b])))",
        "(-> (from :t [a]) (where (exists (from :u [b]) {:a :b})))", "(-> (from :t [a]) (exists :f (from :u [b])))", "(->)", "[a]", "(-> (from :t [a]) 5)",
    ],
)
def test_rejects(text):
    with pytest.raises(ParseError):
        parse(text)


def test_dsl_builds_the_same_plans():
    text = parse('(-> (from :o [a b]) (where (> a 1)) (with {:c (+ a 1)}) (join (from :u [k]) {:a :k}) (aggregate :b {:n (row-count) :s (sum c)}) (limit 3))')
    built = Q.table("o", "a", "b").where("(> a 1)").with_(c="(+ a 1)").join(Q.table("u", "k"), {"a": "k"}).aggregate("b", n="row-count", s=("sum", "c")).limit(3)
    assert built.plan == text
    assert Q.rel({"a": 1, "t": ["x"]}).unnest("u", "t").plan == parse('(-> (rel [{:a 1 :t ["x"]}]) (unnest {:u t}))')
