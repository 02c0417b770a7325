import random

import pytest

from graphcq.plans.normalize import canonical, normalize
from graphcq.syntax import CQ, ID, Atom, Concat, Edge, Intersect, parse_cpq, parse_cq
from graphcq.syntax.cpq import diameter, nested_return, random_cpq, size, to_cq


def test_parse_cq():
    cq = parse_cq("(x, y) ← 0(x,z), 0(z,y)")
    assert cq == CQ(("x", "y"), (Atom(0, "x", "z"), Atom(0, "z", "y")))
    assert str(cq) == "(x,y) ← 0(x,z), 0(z,y)"
    assert parse_cq(str(cq)) == cq
    assert parse_cq("(?x) <- 1(?x,?y)") == CQ(("x",), (Atom(1, "x", "y"),))
    assert parse_cq("(x,x) ← 0(x,y), 0(x,y)") == CQ(("x",), (Atom(0, "x", "y"),))
    assert parse_cq("() :- 0(x,y)").head == ()
    assert parse_cq("(x) ← 0⁻(x,y)") == parse_cq("(x) ← 0(y,x)")
    assert parse_cq("(x,v) ← 0(x,y)").isolated == ("v",)
    assert parse_cq("(x) ←").isolated == ("x",)


def test_label_alphabet():
    assert parse_cq("(x) ← knows(x,y)", {"knows": 3}).atoms[0].label == 3
    assert parse_cq("(x) ← knows(x,y)").atoms[0].label == "knows"
    with pytest.raises(ValueError, match="unknown label"):
        parse_cq("(x) ← likes(x,y)", {"knows": 3})


@pytest.mark.parametrize("text", ["", "x ← 0(x,y)", "(x) 0(x,y)", "(x) ← 0(x)", "(x) ← 0(x,y) 1(y,z)", "(x,) ← 0(x,y)", "() ←", "(x) ← 0(x,y),,"])
def test_bad_queries(text):
    with pytest.raises(ValueError):
        parse_cq(text)


def test_parse_cpq():
    assert parse_cpq("0◦1∩id") == Intersect(Concat(Edge(0), Edge(1)), ID)
    assert parse_cpq("0◦(1∩2⁻)") == Concat(Edge(0), Intersect(Edge(1), Edge(2, True)))
    assert parse_cpq("0.1-&id") == Intersect(Concat(Edge(0), Edge(1, True)), ID)
    assert parse_cpq("0◦1◦2") == Concat(Concat(Edge(0), Edge(1)), Edge(2))
    for bad in ("", "0◦", "(0", "0)", "0 1", "∩0"):
        with pytest.raises(ValueError):
            parse_cpq(bad)


def test_print_parses_back():
    rng = random.Random(5)
    for _ in range(200):
        q = random_cpq(rng, 4, 3)
        assert parse_cpq(str(q)) == q


def test_measures():
    q = parse_cpq("(0◦1)∩id")
    assert (size(q), diameter(q), diameter(ID)) == (5, 2, 0)


@pytest.mark.parametrize(("text", "form"), [
    ("id◦0", "0"), ("id◦id", "id"), ("(0◦1)◦2", "(0◦1◦2)"), ("0◦(1◦2)", "(0◦1◦2)"), ("1∩0", "(0∩1)"), ("0∩1∩0", "(0∩1)"),
    ("0∩0", "0"), ("0∩id", "(0∩id)"), ("((0◦1)∩(0◦1))◦2", "(0◦1◦2)"), ("(0∩(1∩2))∩0", "(0∩1∩2)"), ("(0∩0)∩1", "(0∩1)")])
def test_canonical(text, form):
    assert canonical(parse_cpq(text)) == form


def test_normalize_is_idempotent():
    rng = random.Random(8)
    for _ in range(300):
        q = normalize(random_cpq(rng, 5, 2))
        assert normalize(q) == q
        assert canonical(parse_cpq(canonical(q))) == canonical(q)


def test_normalize_rejects_other_trees():
    with pytest.raises(ValueError):
        normalize("0")


def test_nested_return():
    assert str(nested_return(1, 1)) == "((1◦1⁻)∩id)"
    assert canonical(nested_return(1, 2)) == "((1◦((1◦1⁻)∩id)◦1⁻)∩id)"
    with pytest.raises(ValueError):
        nested_return(1, 0)


def test_to_cq_unifies():
    cq, s, t = to_cq(parse_cpq("(0◦0⁻)∩id"))
    assert s == t and len(cq.variables) == 2
    cq, s, t = to_cq(parse_cpq("0∩1"))
    assert (s, t) == ("src", "trg") and len(cq.atoms) == 2
