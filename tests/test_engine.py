import itertools
import random
import re

import pytest

from graphcq.engine import Engine
from graphcq.functions.answers import answer_count, first_answers, format_answer, print_order
from graphcq.model import Graph
from graphcq.operators.analysis import join_nodes, json_difference
from graphcq.plans.components import Strategy, exact_covers
from graphcq.plans.planner import compile_components
from graphcq.sources.generator import PATTERNS
from graphcq.sources.pairstore import PairStore, label_sequences
from graphcq.syntax import parse_cpq, parse_cq
from graphcq.syntax.cpq import ID, Concat, Edge, Intersect, nested_return, random_cpq


def graph_of(spark, edges, vertices=None):
    """Edges (src, label, trg), repeated to show that answers are sets."""
    rows = [*edges, *edges[:3]]
    own = spark.createDataFrame(rows, "src long, label int, trg long")
    return Graph.of(own, None if vertices is None else spark.createDataFrame([(v,) for v in vertices], "v long"))


def brute(cq, edges, vertices):
    """Answers by trying every assignment of vertices."""
    out = set()
    names = cq.variables
    for values in itertools.product(vertices, repeat=len(names)):
        env = dict(zip(names, values, strict=True))
        if all((env[a.src], a.label, env[a.trg]) in edges for a in cq.atoms):
            out.add(tuple(env[v] for v in cq.head))
    return out


def pairs(cpq, edges, vertices):
    """Pairs of a path query by its definition."""
    if cpq == ID:
        return {(v, v) for v in vertices}
    if isinstance(cpq, Edge):
        return {(t, s) if cpq.inverse else (s, t) for s, label, t in edges if label == cpq.label}
    left, right = pairs(cpq.left, edges, vertices), pairs(cpq.right, edges, vertices)
    if isinstance(cpq, Intersect):
        return left & right
    return {(a, d) for a, b in left for c, d in right if b == c}


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)), "answers repeat"
    return set(got)


EDGES = sorted({(random.Random(i).randrange(5), random.Random(i + 99).randrange(3), random.Random(i + 999).randrange(5)) for i in range(22)})
VERTICES = sorted({v for s, _, t in EDGES for v in (s, t)})
CQS = [
    "(x,y) ← 0(x,y)", "(x,y) ← 0(x,z), 0(z,y)", "(x,y) ← 0(x,z), 1(z,w), 0(w,y)", "(x) ← 0(x,y)", "(y) ← 0(x,y)", "(x) ← 0(x,y), 0(y,x)",
    "(x) ← 1(x,x)", "(x,y) ← 0(x,x), 1(x,y)", "(x,y,z) ← 0(x,y), 1(y,z), 2(x,z)", "(x) ← 0(x,y), 1(y,z), 2(x,z)", "(x,a) ← 0(x,y), 1(a,b)",
    "(x) ← 0(x,y), 1(a,b)", "(x,v) ← 0(x,y)", "(v,x) ← 0(x,x)", "(c) ← 0(c,a), 0(c,b), 1(b,d), 2(a,e), 1(c,c)", "(x,y) ← 0(x,m), 1(m,y), 2(x,m)",
    "(y,x) ← 0(x,y), 1(x,y)", "(x,y) ← 9(x,y)", "(x,w) ← 0(x,y), 1(y,z), 2(z,w), 0(w,x)", "(x) ← 0(x,y), 9(a,b)", "(x) ←"]


@pytest.mark.parametrize("text", CQS)
@pytest.mark.parametrize("distinct", [False, True])
def test_queries_against_brute_force(spark, text, distinct):
    cq, graph = parse_cq(text), graph_of(spark, EDGES)
    answers = Engine(graph.as_set() if distinct else graph).query(cq)
    assert answers.columns == list(cq.head)
    assert rows(answers) == brute(cq, set(EDGES), VERTICES)


CYCLES = ["(x,y,z) ← 0(x,y), 1(y,z), 2(x,z)", "(x) ← 0(x,y), 1(y,z), 0(x,z), 2(x,z)", "(x,y,z) ← 0(x,y), 1(z,y), 0(z,x), 1(x,z)", "(a,c) ← 0(a,b), 1(b,c), 0(c,d), 1(d,a), 2(a,c)"]


@pytest.mark.parametrize("text", CYCLES)
@pytest.mark.parametrize("distinct", [False, True])
def test_cycles_closed_by_all_relations_at_once(spark, text, distinct, monkeypatch):
    monkeypatch.setattr("graphcq.plans.planner.HUB_FAN", 0.0)
    cq, graph = parse_cq(text), graph_of(spark, EDGES)
    answers = Engine(graph.as_set() if distinct else graph).query(cq)
    assert "_least" in answers._jdf.queryExecution().analyzed().toString()
    assert rows(answers) == brute(cq, set(EDGES), VERTICES)
    assert answers.count() == answers.distinct().count()


def test_a_cycle_through_hubs_makes_no_squared_rows(spark):
    """Every pair of the three relations joins to n x n rows here; closed at once, a row makes one."""
    n = 5000
    ends = "explode(array(struct(id AS s, 0L AS t), struct(0L AS s, id AS t))) AS e"
    star = spark.range(1, n).selectExpr(ends).selectExpr("e.s AS src", "explode(array(0, 1, 2)) AS label", "e.t AS trg")
    graph = Graph.of(star)
    text = "(x,y,z) ← 0(x,y), 1(y,z), 2(x,z)"
    assert Engine(graph).query(text).count() == 0
    assert graph.known[0].source_fan > 1000
    answers = Engine(graph).query(text)
    assert "_least" in answers._jdf.queryExecution().analyzed().toString()


def test_no_hubs_no_degrees(spark):
    answers = Engine(graph_of(spark, EDGES)).query(CYCLES[0])
    assert "_least" not in answers._jdf.queryExecution().analyzed().toString()


def _stages(answers):
    """The plan that adaptive execution ended with."""
    answers.collect()
    return answers._jdf.queryExecution().executedPlan().executedPlan().toString()


MEETINGS = ["(x,y) ← 0(x,z), 0(z,y)", "(x,y) ← 0(x,z), 1(y,z)", "(y,x) ← 0(z,x), 2(z,y)", "(x,y) ← 1(x,z), 1(y,z)", "(x,y) ← 0(x,z), 1(y,z), 2(z,w)", "(x,y,a) ← 0(x,z), 1(y,z), 2(a,b)", "(x,y) ← 0(x,z), 9(y,z)"]


@pytest.mark.parametrize("text", MEETINGS)
@pytest.mark.parametrize(("distinct", "several"), [(False, 4), (True, 1)])
def test_labels_that_meet_through_hubs(spark, text, distinct, several, monkeypatch):
    """Ends with one value of the middle variable and ends with several, in blocks of two rows."""
    monkeypatch.setattr("graphcq.plans.planner.MEET_ROWS", -1.0)
    monkeypatch.setattr("graphcq.plans.planner.MEET_FAN", -1.0)
    monkeypatch.setattr("graphcq.operators.relation.BLOCK", 2)
    r = random.Random(several)
    edges = sorted({(v, label, r.randrange(3)) for v in range(8) for label in range(3) for _ in range(r.choice([1, several]))})
    vertices = sorted({v for s, _, t in edges for v in (s, t)})
    cq, graph = parse_cq(text), graph_of(spark, edges)
    answers = Engine(graph.as_set() if distinct else graph).query(cq)
    assert "_low" in answers._jdf.queryExecution().analyzed().toString()
    assert rows(answers) == brute(cq, set(edges), vertices)


def test_pairs_that_cannot_repeat_are_not_deduplicated(spark, monkeypatch):
    """Every end has one middle, and the middles are hubs: 6000 edges make 200 000 pairs, all different."""
    monkeypatch.setattr("graphcq.plans.planner.MEET_ROWS", 1e5)
    edges = spark.range(6000).selectExpr("id + 100 AS src", "IF(id < 5000, 0, 1) AS label", "id % 25 AS trg")
    answers = Engine(Graph.of(edges)).query("(c,s) ← 0(c,n), 1(s,n)")
    assert not re.search(r"Aggregate\(keys=\[c#\w+, s#\w+\]", _stages(answers))
    assert answers.count() == answers.distinct().count() == 5000 * 1000 // 25


def test_join_size(spark):
    edges = spark.range(3000).selectExpr("id AS src", "IF(id < 2000, 0, 1) AS label", "id % 10 + 5000 AS trg")
    graph = Graph.of(edges)
    size, into = graph.join_size((0, "trg"), (1, "trg"))
    assert into == 3000 and size == pytest.approx(10 * 200 * 100, rel=0.1)
    assert graph.join_size((0, "src"), (1, "src"))[0] < 5000
    assert graph.join_size((0, "trg"), (7, "trg")) == (0.0, 2000)


@pytest.mark.parametrize(("text", "holds"), [("() ← 0(x,y)", True), ("() ← 9(x,y)", False), ("() ← 0(x,y), 9(a,b)", False), ("() ← 0(x,y), 1(a,b)", True)])
def test_boolean_queries(spark, text, holds):
    answers = Engine(graph_of(spark, EDGES)).query(text)
    assert [tuple(r) for r in answers.collect()] == [(holds,)]
    assert answer_count(answers).first()[0] == int(holds)


@pytest.mark.parametrize("text", ["(x,y) ← 0(x,z), 1(z,y)", "(x) ← 0(x,y), 1(y,x)", "(x,y) ← 0(x,x), 1(x,y)", "(x,y) ← 0(x,m), 1(m,y), 2(x,m)", "(x,v) ← 0(x,y)"])
def test_all_covers_answer_alike(spark, text):
    cq, graph = parse_cq(text), graph_of(spark, EDGES)
    want = brute(cq, set(EDGES), VERTICES)
    for cover in itertools.islice(exact_covers(cq, 2), 12):
        assert rows(compile_components(cover, cq.head, graph)) == want


@pytest.mark.parametrize("strategy", list(Strategy))
def test_strategies(spark, strategy):
    engine = Engine(graph_of(spark, EDGES))
    assert rows(engine.query_by("(x,y) ← 0(x,z), 1(z,y)", strategy, seed=3)) == rows(engine.query("(x,y) ← 0(x,z), 1(z,y)"))


@pytest.mark.parametrize(("text", "edges"), [
    ("(x,y) ← 0(x,x), 1(x,y)", [(5, 0, 6), (6, 1, 7)]),
    ("(x,y) ← 0(x,m), 1(m,y), 2(x,m), 3(m,y)", [(1, 0, 10), (10, 3, 2), (1, 2, 11), (11, 1, 2)])])
def test_unsound_components_are_not_made(spark, text, edges):
    graph, cq = graph_of(spark, edges), parse_cq(text)
    assert all(not rows(compile_components(c, cq.head, graph)) for c in exact_covers(cq, 2))


@pytest.mark.parametrize("seed", range(10))
def test_path_queries_against_their_definition(spark, seed):
    cpq = random_cpq(random.Random(seed), 3, 3)
    assert rows(Engine(graph_of(spark, EDGES)).paths(cpq)) == pairs(cpq, set(EDGES), VERTICES)


@pytest.mark.parametrize("text", ["id", "0∩id", "id∩id", "(0◦id)∩1", "0⁻", "(0∩id)◦1", "(0◦0⁻)∩id"])
def test_path_queries_with_identity(spark, text):
    cpq = parse_cpq(text)
    assert rows(Engine(graph_of(spark, EDGES)).paths(text)) == pairs(cpq, set(EDGES), VERTICES)


def test_vertices_may_be_given(spark):
    graph = graph_of(spark, [(0, 0, 1)], vertices=[0, 1, 2])
    assert rows(Engine(graph).paths("id")) == {(0, 0), (1, 1), (2, 2)}


def test_nested_return_is_a_chain_of_semi_joins(spark):
    cpq = nested_return(0, 3)
    found = Engine(graph_of(spark, EDGES)).paths(cpq)
    assert rows(found) == pairs(cpq, set(EDGES), VERTICES)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Inner" not in plan


def test_a_label_leaves_one_branch_of_a_union(spark):
    a, b = graph_of(spark, [(0, 0, 1)]).edges, spark.range(5).selectExpr("id as src", "1 as label", "id as trg")
    plan = Engine(Graph(a.where("label = 0").union(b))).query("(x) ← 0(x,y)")._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan


@pytest.mark.parametrize("name", PATTERNS)
def test_patterns_match_themselves_once(spark, name):
    edges = [(s, label, t) for s, t, label in PATTERNS[name]]
    names = sorted({v for s, _, t in edges for v in (s, t)})
    text = f"({','.join(f'v{v}' for v in names)}) ← {', '.join(f'{label}(v{s},v{t})' for s, label, t in edges)}"
    assert rows(Engine(graph_of(spark, edges)).query(text)) == {tuple(names)}


def test_null_edges_are_dropped(spark):
    own = spark.createDataFrame([(None, 0, 1), (1, None, 2), (1, 0, None), (1, 0, 2)], "src long, label int, trg long")
    assert rows(Engine(Graph.of(own)).query("(x,y) ← 0(x,y)")) == {(1, 2)}


def test_large_vertex_ids(spark):
    top = 2**31 - 1
    assert rows(Engine(graph_of(spark, [(top, 0, top), (2**40, 0, 3)])).query("(x) ← 0(x,x)")) == {(top,)}


def test_pair_store(spark, tmp_path):
    graph = graph_of(spark, EDGES)
    built = PairStore.build(graph, label_sequences([0, 1], 2), 2)
    built.save(str(tmp_path / "store"))
    store = PairStore.load(spark, str(tmp_path / "store"))
    assert store.k == 2 and store.keys == built.keys
    cpq = Concat(Edge(0), Edge(1, True))
    assert rows(store.lookup(cpq)) == pairs(cpq, set(EDGES), VERTICES)
    assert store.lookup(parse_cpq("2")) is None
    text = "(x,y) ← 0(x,z), 1(z,y)"
    assert rows(Engine(graph, store=store).query_by(text, Strategy.RANDOM, seed=1)) == rows(Engine(graph).query(text))
    assert rows(Engine(graph, store=store).paths("2")) == pairs(Edge(2), set(EDGES), VERTICES)


def test_first_answers(spark):
    engine = Engine(graph_of(spark, EDGES))
    answers = engine.query("(x,y) ← 0(x,y)")
    order = print_order(engine.cover("(x,y) ← 0(x,y)"))
    got = first_answers(answers, 2, order).collect()
    assert [tuple(r) for r in got] == sorted(brute(parse_cq("(x,y) ← 0(x,y)"), set(EDGES), VERTICES))[:2]
    assert format_answer(got[0]).startswith("{?x=")


def test_join_nodes(spark):
    part = spark.createDataFrame([("a", "b", "0", 0), ("b", "c", "1", 1), ("c", "d", "1", 1)], "source string, target string, label string, component int")
    free = spark.createDataFrame([("d",), ("z",)], "name string")
    assert rows(join_nodes(part, free)) == {("b",), ("d",)}


def test_json_difference(spark):
    left = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    right = spark.createDataFrame([("a", 1)], "s string, n int")
    assert rows(json_difference(left, right)) == {(2, None)}


def test_join_order_follows_the_statistics(spark):
    """A wide label is joined last: the triangle closes on few rows instead of growing through a hub."""
    hub = [(i, 5, 1000) for i in range(60)] + [(1000, 6, 2000 + i) for i in range(60)] + [(i, 4, 2000 + i) for i in range(3)]
    graph = graph_of(spark, hub)
    answers = Engine(graph).query("(a,b) ← 5(a,s), 6(s,b), 4(a,b)")
    assert rows(answers) == {(i, 2000 + i) for i in range(3)}
    assert graph.known[5].edges == 63 and graph.known[4].edges == 3
    from graphcq.operators.relation import Relation
    from graphcq.plans.planner import _order

    atoms = parse_cq("(a,b) ← 5(a,s), 6(s,b), 4(a,b)").atoms
    relations = [Relation.of_pairs(graph.labelled(a.label), a.src, a.trg, False, a.label) for a in atoms]
    assert _order(relations, ("a", "b"), graph.known)[:2] != [0, 1] and 2 in _order(relations, ("a", "b"), graph.known)[:2]


def test_no_statistics_where_there_is_no_choice(spark):
    graph = graph_of(spark, EDGES)
    Engine(graph).query("(x,y) ← 0(x,z), 1(z,y)")
    Engine(graph).query("(x) ← 0(x,y), 1(y,z), 2(z,w)")
    assert graph.known == {}


def test_query_uses_a_store(spark):
    graph = Graph(spark.createDataFrame([(1, 0, 2), (2, 0, 3), (3, 1, 4), (4, 0, 5)], "src long, label int, trg long"))
    store = PairStore.build(graph, [parse_cpq("0◦0")], 2)
    engine = Engine(graph, store=store)
    text = "(x,y) ← 0(x,z), 0(z,w), 1(w,y)"
    assert sorted(c.canonical for c in engine.stored_cover(engine.parse(text))) == ["(0◦0)", "1"]
    assert rows(engine.query(text)) == rows(Engine(graph).query(text)) == {(1, 4)}
