import pytest

from loomgraph.operators import chains as C
from loomgraph.operators import graph as G
from loomgraph.operators import refine as M
from loomgraph.operators import retrieval as R
from loomgraph.sources.tables import merge_nodes

EDGE = "id string, src string, dst string, predicate string, confidence double, persistence string"


@pytest.fixture(scope="module")
def edges(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("e", "f"), ("a", "a")]
    return spark.createDataFrame([(f"r{i}", s, d, "knows", 0.5 + i / 10, "stable") for i, (s, d) in enumerate(pairs)], EDGE)


def test_k_hop(spark, edges):
    got = {(r["node"], r["depth"]) for r in G.k_hop(spark.createDataFrame([("a",)], "center string"), edges, 2).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


def test_simple_paths(spark, edges):
    got = {tuple(r["path"]) for r in G.simple_paths(spark.createDataFrame([("a", "d")], "a string, b string"), edges, 3).collect()}
    assert got == {("a", "c", "d"), ("a", "b", "c", "d")}


def test_components(edges):
    assert {(r["node"], r["component"]) for r in G.components(edges, "src", "dst").collect()} == {(n, "a") for n in "abcd"} | {(n, "e") for n in "ef"}


def test_long_chain_is_one_component(spark):
    df = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r["component"] for r in G.components(df).collect()} == {0}


def test_page_rank_adds_up_to_one(spark, edges):
    nodes = spark.createDataFrame([(n,) for n in "abcdefg"], "id string")
    rank = {r["id"]: r["rank"] for r in G.page_rank(nodes, edges, 4).collect()}
    assert abs(sum(rank.values()) - 1) < 1e-9 and rank["c"] > rank["d"] > rank["g"]


def test_nodes_merge(spark):
    schema = "record_id bigint, id string, name string, entity_type array<string>, aliases array<string>, source_documents array<string>, description string, scope_level string, base_document string"
    rows = [(1, "X", "Ann", ["Entity", "Character"], ["A", None], None, "first", "Local ", "s"), (2, "x ", " ", None, ["B", "A", ""], ["d"], None, None, None), (3, "y", None, ["Entity"], None, None, "", None, None), (4, None, "Z", None, None, None, None, None, None)]
    got = {r["id"]: r for r in merge_nodes(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"x", "y"} and got["x"]["name"] == "Ann" and got["x"]["aliases"] == ["A", "B"] and got["x"]["types"] == ["Character"] and got["x"]["scope"] == "local"
    assert got["y"]["types"] == ["Concept"] and got["y"]["name"] is None and got["x"]["records"] == 2


def test_conflicts(spark):
    rows = [("1", "a", "b", "opposes", 1.0, "stable"), ("2", "b", "a", "allies", 1.0, "phase"), ("3", "c", "d", "opposes", 1.0, "momentary"), ("4", "c", "d", "allies", 1.0, "stable")]
    got = M.conflicts(spark.createDataFrame(rows, EDGE), spark.createDataFrame([("allies", "opposes")], "x string, y string")).collect()
    assert [tuple(r) for r in got] == [("a", "b", "allies|opposes")]


def test_trunks_and_subsets(spark):
    chains = spark.createDataFrame([("1", ["a", "b", "c"]), ("2", ["a", "b", "d"]), ("3", ["x"]), ("4", ["x", "y"])], "id string, chain array<string>")
    assert {tuple(r) for r in C.trie_trunks(chains, 1).collect()} == {("a>b", 2), ("x", 2)}
    sets = spark.createDataFrame([(["a"],), (["b", "a"],), (["a", "b"],), (["c"],), ([],)], "members array<string>")
    assert {tuple(r["members"]) for r in C.strict_subsets(sets).collect()} == {("a", "b"), ("c",)}
    assert {tuple(r) for r in C.frequent_subchains(chains, 2, 2).collect()} == {("a>b", 2)}


def test_vectors_of_odd_shape(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [3.0, 0.0])]
    v = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    q = v.where("id in (1, 2)").withColumnRenamed("id", "query_id")
    got = [(r["query_id"], r["id"], r["rank"]) for r in R.vector_top_k(q, v, 2, block=1).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 1), (1, 6, 2), (2, 2, 1), (2, 1, 2)]
    assert R.vector_top_k(q.where("false"), v, 2).count() == 0


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "The red lamp"), (2, "the lamp, the LAMP"), (3, "a door"), (4, None), (5, "door"), (6, "window")], "id bigint, text string")
    q = spark.createDataFrame([(9, "lamp lamp"), (8, None)], "query_id bigint, text string")
    got = [(r["query_id"], r["id"]) for r in R.top_k(R.bm25(q, docs), 5).orderBy("rank").collect()]
    assert got == [(9, 2), (9, 1)]
