"""Queries of the graph engine by name, over graphs made of the test tables, and their SQL."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphcq.engine import Engine
from graphcq.functions.answers import answer_count, first_answers
from graphcq.model import Graph
from graphcq.operators.analysis import join_nodes
from graphcq.plans.components import Strategy, enumerate_components, exact_covers
from graphcq.plans.normalize import canonical
from graphcq.sources.derived import heterogeneous, order_customer
from graphcq.sources.edgefile import read_edge_file, read_free_variables, read_graph, read_partition, read_queries, write_edge_file, write_graph
from graphcq.sources.generator import PATTERNS, generate
from graphcq.sources.pairstore import PairStore, label_sequences
from graphcq.syntax import CQ, parse_cpq, parse_cq
from graphcq.syntax.cpq import nested_return

Query = Callable[[SparkSession, str], DataFrame]

GRAPHS: dict[str, Callable[[SparkSession, str], Graph]] = {
    "g1": heterogeneous,
    "g2": order_customer,
    "g3": lambda spark, sf_dir: order_customer(spark, sf_dir, by_priority=True),
}
GRAPH_SQL = {
    "g1": """SELECT DISTINCT src, label, trg FROM (
  SELECT CAST(c_custkey AS BIGINT) + 1000000 AS src, 0 AS label, CAST(c_nationkey AS BIGINT) + 100 AS trg FROM customer
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 100, 1, CAST(n_regionkey AS BIGINT) FROM nation
  UNION ALL SELECT s_suppkey + 500000, 2, CAST(s_nationkey AS BIGINT) + 100 FROM supplier
  UNION ALL SELECT o_orderkey + 10000000, 3, o_custkey + 1000000 FROM orders
  UNION ALL SELECT l_orderkey + 10000000, 4, l_partkey + 2000000 FROM lineitem
  UNION ALL SELECT l_orderkey + 10000000, 5, l_suppkey + 500000 FROM lineitem
  UNION ALL SELECT l_suppkey + 500000, 6, l_partkey + 2000000 FROM lineitem)""",
    "g2": "SELECT DISTINCT o_orderkey AS src, 0 AS label, o_custkey AS trg FROM orders",
    "g3": "SELECT DISTINCT o_orderkey AS src, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS label, o_custkey AS trg FROM orders",
}

#: name -> (graph, query)
CQS: dict[str, tuple[str, str]] = {
    "edge_scan": ("g2", "(x,y) ← 0(x,y)"),
    "path2": ("g2", "(x,y) ← 0(x,z), 0(z,y)"),
    "path3": ("g2", "(x,y) ← 0(x,z), 0(z,w), 0(w,y)"),
    "proj_src": ("g2", "(x) ← 0(x,y)"),
    "proj_trg": ("g2", "(y) ← 0(x,y)"),
    "two_cycle": ("g2", "(x) ← 0(x,y), 0(y,x)"),
    "self_loop": ("g2", "(x) ← 0(x,x)"),
    "mixed_path2": ("g3", "(x,y) ← 0(x,z), 1(z,y)"),
    "mixed_chain3": ("g3", "(x) ← 2(x,y), 3(y,z), 4(z,w)"),
    "common_target": ("g3", "(x,y) ← 0(x,z), 0(y,z)"),
    "order_nation": ("g1", "(o,n) ← 3(o,c), 0(c,n)"),
    "order_region": ("g1", "(o,r) ← 3(o,c), 0(c,n), 1(n,r)"),
    "supplier_part": ("g1", "(s,p) ← 6(s,p)"),
    "star_same_nation": ("g1", "(c,s) ← 0(c,n), 2(s,n)"),
    "supplier_pairs": ("g1", "(a,b) ← 2(a,n), 2(b,n)"),
    "cycle4": ("g1", "(o,s) ← 3(o,c), 0(c,n), 2(s,n), 5(o,s)"),
    "triangle": ("g1", "(o,p,s) ← 4(o,p), 5(o,s), 6(s,p)"),
    "triangle_exists_o": ("g1", "(o) ← 4(o,p), 5(o,s), 6(s,p)"),
    "boolean_sat": ("g1", "() ← 3(o,c), 0(c,n), 2(s,n), 5(o,s)"),
    "boolean_unsat": ("g1", "() ← 1(a,b), 1(b,c)"),
    "unknown_label": ("g1", "(x,y) ← 9(x,y)"),
    "cross_product": ("g1", "(a,b,c) ← 1(a,b), 1(c,d)"),
    "repeated_head": ("g1", "(a,a,b) ← 1(a,b)"),
}

#: name -> (graph, path query, SQL over that graph)
CPQS: dict[str, tuple[str, str, str]] = {
    "inverse": ("g1", "1⁻", "SELECT DISTINCT trg AS src, src AS trg FROM g WHERE label = 1"),
    "concat": ("g1", "2◦1", "SELECT DISTINCT a.src, b.trg FROM g a JOIN g b ON a.trg = b.src WHERE a.label = 2 AND b.label = 1"),
    "intersect": ("g1", "(5◦6)∩4", "SELECT DISTINCT a.src, b.trg FROM g a JOIN g b ON a.trg = b.src WHERE a.label = 5 AND b.label = 6 INTERSECT SELECT src, trg FROM g WHERE label = 4"),
    "identity": ("g2", "id", "SELECT v AS src, v AS trg FROM (SELECT src AS v FROM g UNION SELECT trg FROM g)"),
    "loop": ("g2", "0∩id", "SELECT DISTINCT src, trg FROM g WHERE label = 0 AND src = trg"),
    "nested_return": ("g2", str(nested_return(0, 3)), "SELECT DISTINCT a.src, a.src AS trg FROM g a JOIN g b ON a.trg = b.src JOIN g c ON b.trg = c.src"),
}


def cq_sql(cq: CQ, graph: str) -> str:
    """The query as SQL: an alias per atom, equal variables equal, distinct free variables."""
    where: list[str] = []
    first: dict[str, str] = {}
    for i, a in enumerate(cq.atoms):
        where.append(f"e{i}.label = {a.label}")
        for v, column in ((a.src, f"e{i}.src"), (a.trg, f"e{i}.trg")):
            if v in first:
                where.append(f"{first[v]} = {column}")
            first.setdefault(v, column)
    body = f"FROM {', '.join(f'g e{i}' for i in range(len(cq.atoms)))} WHERE {' AND '.join(where)}"
    prefix = f"WITH g AS ({GRAPH_SQL[graph]}) "
    if not cq.head:
        return f"{prefix}SELECT count(*) > 0 AS satisfied {body}"
    return f"{prefix}SELECT DISTINCT {', '.join(f'{first[v]} AS {v}' for v in cq.head)} {body}"


def _cq(name: str) -> Query:
    graph, text = CQS[name]
    return lambda spark, sf_dir: Engine(GRAPHS[graph](spark, sf_dir)).query(text)


def _cpq(name: str) -> Query:
    graph, text, _ = CPQS[name]
    return lambda spark, sf_dir: Engine(GRAPHS[graph](spark, sf_dir)).paths(text)


def _by(name: str, strategy: Strategy, seed: int = 0) -> Query:
    graph, text = CQS[name]
    return lambda spark, sf_dir: Engine(GRAPHS[graph](spark, sf_dir)).query_by(text, strategy, seed)


def isolated_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A free variable in no atom ranges over all vertices: the nations with every vertex of the whole graph."""
    return Engine(GRAPHS["g1"](spark, sf_dir)).query("(y,x) ← 1(y,z)")


def count_path2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_count(_cq("path2")(spark, sf_dir))


def top5_path2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_answers(_cq("path2")(spark, sf_dir), 5, ["x", "y"])


_TREE = parse_cq("(x,y) ← 0(x,z), 0(z,y)")


def components_path2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c.s, c.t, c.diameter, ",".join(map(str, sorted(c.mask))), ",".join(map(str, sorted(c.inverse))), c.canonical) for c in enumerate_components(_TREE, 2)]
    return spark.createDataFrame(rows, "s string, t string, diameter int, mask string, inverse string, canonical string")


def covers_path2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(" ; ".join(f"{c.s}{c.t}:{c.canonical}" for c in cover),) for cover in exact_covers(_TREE, 2)]
    return spark.createDataFrame(rows, "cover string")


_FORMS = ["id◦0", "id◦id", "(0◦1)◦2", "0◦(1◦2)", "1∩0", "0∩1∩0", "0∩0", "0∩id", "((0◦1)∩(0◦1))◦2"]
_NORMAL = ["0", "id", "(0◦1◦2)", "(0◦1◦2)", "(0∩1)", "(0∩1)", "0", "(0∩id)", "(0◦1◦2)"]


def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, canonical(parse_cpq(t))) for t in _FORMS], "input string, canonical string")


def pairstore_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps looked up in a store of all label sequences of one and two steps."""
    graph = order_customer(spark, sf_dir)
    store = PairStore.build(graph, label_sequences([0], 2), 2)
    return Engine(graph, store=store).paths("0◦0").select(F.col("src").alias("x"), F.col("trg").alias("y"))


def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or a temporary one where all is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return f"{root or tempfile.mkdtemp(prefix='graphs')}/{uuid.uuid4().hex}"


def edge_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph written as an edge file and read again."""
    graph, path = GRAPHS["g3"](spark, sf_dir), _scratch(spark)
    write_edge_file(graph.as_set(), path, 0, 5)
    return read_edge_file(spark, path).edges


def stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query over a graph stored by label."""
    path = _scratch(spark)
    write_graph(GRAPHS["g3"](spark, sf_dir), path)
    return Engine(read_graph(spark, path)).query(CQS["mixed_path2"][1])


def pairstore_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps by a store of all label sequences of one and two steps that was built, saved and loaded."""
    graph, path = order_customer(spark, sf_dir), _scratch(spark)
    PairStore.build(graph, label_sequences([0], 2), 2).save(path)
    return Engine(graph, store=PairStore.load(spark, path)).query(CQS["path3"][1])


_FILED = ("path2", "proj_trg", "two_cycle")


def query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, answers) of the queries of a file, with a comment and a blank line between them."""
    path = _scratch(spark)
    lines = ["# queries", "", *(f"  {CQS[n][1]} " for n in _FILED)]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    engine = Engine(order_customer(spark, sf_dir))
    counts = [answer_count(engine.query(text)).select(F.lit(i).alias("query"), "answers") for i, text in read_queries(spark, path)]
    return reduce(DataFrame.union, counts)


_PARTITION = [("x", "z", "0", 0), ("z", "y", "0", 1), ("z", "w", "1", 1), ("w", "y", "2", 2)]


def partition_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join nodes of a partition and free variables, both read from JSON files."""
    path = _scratch(spark)
    atoms = json.dumps([dict(zip(("source", "target", "label", "component"), r, strict=True)) for r in _PARTITION], indent=1)
    for name, text in (("partition", atoms), ("free", json.dumps(["x", "y"]))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{name}")
    return join_nodes(read_partition(spark, f"{path}/partition"), read_free_variables(spark, f"{path}/free"))


_EMBEDDED = ("example1", "example6")


def generated_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two embedded patterns and a regular filling; labels of the filling are left out, as they are random."""
    edges = generate(spark, vertices=50, edges=60, labels=6, seed=1, names=_EMBEDDED)
    return edges.groupBy("src", "trg").agg(F.count("*").alias("n"))


def _generated_sql() -> str:
    fixed = [(s + i * 25, t + i * 25) for i, n in enumerate(_EMBEDDED) for s, t, _ in PATTERNS[n]]
    values = ", ".join(f"({s}, {t})" for s, t in fixed)
    fill = f"SELECT i % 50 AS src, CASE WHEN (17 * i + 23) % 50 = i % 50 THEN (i % 50 + 1) % 50 ELSE (17 * i + 23) % 50 END AS trg FROM range({60 - len(fixed)}) t(i)"
    return f"SELECT CAST(src AS BIGINT) AS src, CAST(trg AS BIGINT) AS trg, count(*) AS n FROM (SELECT * FROM (VALUES {values}) v(src, trg) UNION ALL {fill}) GROUP BY 1, 2"


def join_nodes_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that both customers and suppliers are in, and nation 0: labels as components of a partition."""
    edges = heterogeneous(spark, sf_dir).edges.where("label in (0, 2)")
    partition = edges.select(F.col("src").cast("string").alias("source"), F.col("trg").cast("string").alias("target"), "label", F.col("label").alias("component"))
    return join_nodes(partition, spark.createDataFrame([("100",)], "name string"))


_OTHERS = (
    isolated_variable, count_path2, top5_path2, components_path2, covers_path2, canonical_forms, pairstore_lookup, generated_graph, join_nodes_customers,
    edge_file_round_trip, stored_graph, pairstore_saved, query_file, partition_json)
QUERIES: dict[str, Query] = {
    **{n: _cq(n) for n in CQS},
    **{n: _cpq(n) for n in CPQS},
    "single_edge_cover": _by("path2", Strategy.SINGLE_EDGE),
    "random_cover": _by("path2", Strategy.RANDOM, seed=4),
    "random_cover_triangle": _by("triangle", Strategy.RANDOM, seed=7),
    "first_cover_cycle4": _by("cycle4", Strategy.FIRST),
    **{f.__name__: f for f in _OTHERS},
}


def _values(rows: list[tuple], names: list[str]) -> str:
    def text(x) -> str:
        return str(x) if isinstance(x, int) else "'" + str(x) + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({', '.join(names)})"


_CQ_SQL = {n: cq_sql(parse_cq(text), graph) for n, (graph, text) in CQS.items()}
_G1 = f"WITH g AS ({GRAPH_SQL['g1']}) "
SQL: dict[str, str] = {
    **_CQ_SQL,
    **{n: f"WITH g AS ({GRAPH_SQL[graph]}) {sql}" for n, (graph, _, sql) in CPQS.items()},
    "single_edge_cover": _CQ_SQL["path2"],
    "random_cover": _CQ_SQL["path2"],
    "random_cover_triangle": _CQ_SQL["triangle"],
    "first_cover_cycle4": _CQ_SQL["cycle4"],
    "isolated_variable": f"{_G1} SELECT DISTINCT e.src AS y, v.v AS x FROM (SELECT DISTINCT src FROM g WHERE label = 1) e, (SELECT src AS v FROM g UNION SELECT trg FROM g) v",
    "count_path2": f"SELECT count(*) AS answers FROM ({_CQ_SQL['path2']})",
    "top5_path2": f"SELECT * FROM ({_CQ_SQL['path2']}) ORDER BY x, y LIMIT 5",
    "components_path2": _values(
        [("x", "z", 1, "0", "", "0"), ("z", "x", 1, "0", "0", "0⁻"), ("z", "y", 1, "1", "", "0"), ("y", "z", 1, "1", "1", "0⁻"), ("x", "y", 2, "0,1", "", "(0◦0)"), ("y", "x", 2, "0,1", "0,1", "(0⁻◦0⁻)")],
        ["s", "t", "diameter", "mask", "inverse", "canonical"]),
    "covers_path2": _values([(c,) for c in ("xz:0 ; zy:0", "xz:0 ; yz:0⁻", "zy:0 ; zx:0⁻", "yz:0⁻ ; zx:0⁻", "xy:(0◦0)", "yx:(0⁻◦0⁻)")], ["cover"]),
    "canonical_forms": _values(list(zip(_FORMS, _NORMAL, strict=True)), ["input", "canonical"]),
    "pairstore_lookup": _CQ_SQL["path2"],
    "edge_file_round_trip": GRAPH_SQL["g3"],
    "stored_graph": _CQ_SQL["mixed_path2"],
    "pairstore_saved": _CQ_SQL["path3"],
    "query_file": " UNION ALL ".join(f"SELECT {i} AS query, (SELECT count(*) FROM ({_CQ_SQL[n]})) AS answers" for i, n in enumerate(_FILED, 1)),
    "partition_json": _values([(v,) for v in "wxyz"], ["node"]),
    "generated_graph": _generated_sql(),
    "join_nodes_customers": f"{_G1}, e AS (SELECT CAST(src AS VARCHAR) AS v, label FROM g WHERE label IN (0, 2) UNION ALL SELECT CAST(trg AS VARCHAR), label FROM g WHERE label IN (0, 2)) SELECT v AS node FROM e GROUP BY v HAVING count(DISTINCT label) > 1 OR v = '100'",
}
