import pytest

from sluice.functions.expressions import UnknownFunction, lower, scope_of
from sluice.operators.rows import frame_of
from sluice.plans.parser import expression
from sluice.sources.edn import read

DOC = {"a": 7, "b": -3, "x": 2.5, "n": None, "s": " \tHi yo\n", "t": True, "f": False, "z": 0, "e": "", "m": {"k": [10, {"q": 1}.get("q")], "no": False}, "big": "abc"}

CASES = [
    # literals and fields
    ("1", 1), ('"s"', "s"), ("true", True), ("nil", None), ("a", 7), (":a", 7), ("missing", None),
    # comparisons: = is total, order comparisons with null are false
    ("(= a 7)", True), ("(= a 7.0)", True), ("(= n nil)", True), ("(= n 5)", False), ('(= a "7")', False), ("(!= n 5)", True), ("(<> a 7)", False),
    ("(> a 3)", True), ("(< a 3)", False), ("(>= a 7)", True), ("(<= x 2)", False), ("(> n 3)", False), ("(< n 3)", False), ("(> missing 1)", False),
    # logic: only null and false are falsy
    ("(and)", True), ("(and z e)", True), ("(and a n)", False), ("(or n f)", False), ("(or n a)", 7), ("(or f n)", None), ("(or t n)", True),
    ("(not n)", True), ("(not z)", False), ("(not f)", True), ("(nil? n)", True), ("(nil? f)", False), ("(true? t)", True), ("(true? a)", False), ("(false? f)", True), ("(false? n)", False),
    # strings
    ('(like big "a%")', True), ('(like big "a_c")', True), ('(like big "b%")', False), ('(like n "%")', True), ('(like big "a.c")', True), ('(like s "%Hi%")', False),
    ('(like-regex big "b")', True), ('(like-regex n "^$")', True),
    ("(trim s)", "Hi yo"), ("(trim-leading s)", "Hi yo\n"), ("(trim-trailing s)", " \tHi yo"), ("(trim n)", None),
    ('(overlay big "XY" 2)', "aXY"), ('(overlay big "XY" 2 1)', "aXYc"), ("(lower big)", "abc"), ("(upper (trim s))", "HI YO"),
    # arithmetic
    ("(+ a b)", 4), ("(+ a x 1)", 10.5), ("(- a)", -7), ("(- a b 1)", 9), ("(* a 2)", 14), ("(/ a 2)", 3.5), ("(/ 4)", 0.25), ("(/ 12 2 3)", 2.0), ("(+ a n)", None),
    ("(mod 7 3)", 1), ("(mod -7 3)", 2), ("(mod 7 -3)", -2), ("(mod -7 -3)", -1), ("(mod 7.9 3)", 1),
    ("(abs b)", 3.0), ("(abs n)", None), ("(floor x)", 2.0), ("(ceil x)", 3.0), ("(round 2.5)", 3), ("(round -2.5)", -2), ("(round -2.6)", -3), ("(sqrt 9)", 3.0), ("(pow 2 10)", 1024.0), ("(pow n 2)", None),
    # control
    ("(if z 1 2)", 1), ("(if n 1 2)", 2), ("(if f 1 2)", 2), ('(case n 1 t 2 3)', 2), ("(case n 1 f 2 3)", 3), ("(cond n 1 a 2)", 2), ("(cond n 1 5)", None), ("(cond)", None),
    ("(let [p 2 q (* p 3)] (+ p q a))", 15), ("(let [a 1] a)", 1), ("(coalesce n f a)", None), ("(coalesce n a)", 7), ("(null-if a 7)", None), ("(null-if a 8)", 7), ("(null-if n 1)", None),
    # paths
    ("(.. m :k 0)", 10), ("(.. m k 5)", None), ("(.. m :no)", False), ("(.. m :gone :x)", None), ("(.. a :x)", None), ('(.. m "k" 1)', 1),
]


@pytest.fixture(scope="module")
def doc(spark):
    return frame_of(spark, [DOC])


def test_table(doc):
    cases = [c for c in CASES if c[0] != "(coalesce n f a)"]
    columns = [lower(expression(read(text)), scope_of(doc.schema)).column.alias(f"c{i}") for i, (text, _) in enumerate(cases)]
    got = doc.select(*columns).first()
    for i, (text, want) in enumerate(cases):
        assert got[i] == want and isinstance(got[i], bool) == isinstance(want, bool), (text, got[i], want)


def test_boolean_coalesce(doc):
    assert doc.select(lower(expression(read("(coalesce n f t)")), scope_of(doc.schema)).column).first()[0] is False


def test_truthy_rows(spark):
    from sluice.operators.rows import where
    from sluice.plans.parser import parse

    rows = frame_of(spark, [{"i": i, "v": v} for i, v in enumerate([None, False, True])])
    plan = parse("(-> (rel [{:i 1}]) (where v))")
    assert [r["i"] for r in where(rows, plan).collect()] == [2]
    for values in ([None, 0, 1], [None, "", "x"], [None, [], [1]]):
        rows = frame_of(spark, [{"i": i, "v": v} for i, v in enumerate(values)])
        assert [r["i"] for r in where(rows, plan).orderBy("i").collect()] == [1, 2]


@pytest.mark.parametrize("text", ["(count a)", "(frobnicate 1)"])
def test_unknown_functions_raise(doc, text):
    with pytest.raises(UnknownFunction):
        lower(expression(read(text)), scope_of(doc.schema))


@pytest.mark.parametrize("text", ["(= 1)", "(if 1 2)", "(case 1 2)", "(like a)", "(like a b)"])
def test_arity(doc, text):
    with pytest.raises(ValueError):
        lower(expression(read(text)), scope_of(doc.schema))
