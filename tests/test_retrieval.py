"""Searches on odd tables (repeated and missing ids, blank texts, ties, documents with and without vectors) against their SQL twins."""

import random

import pytest

from loomgraph.operators import retrieval as R
from loomgraph.plans import load_core

CORE = load_core()


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    rnd, at = random.Random(7), str(tmp_path_factory.mktemp("odd"))
    words = "lamp door the the the harbour second winter glass a_1 Éa 灯".split()
    text = lambda: " ".join(rnd.choice(words) + rnd.choice(["", "", ".", "!", ","]) for _ in range(rnd.randrange(0, 25)))
    title = lambda: rnd.choice([None, "", "The Second Lamp", "the lamp", "Lamp the", "Winter Harbour", "unheard 灯", "!!"])
    docs = [(i, rnd.choice([text(), text(), None, "the lamp"]), rnd.choice(["novel", "Novel", "wiki", None]), title()) for i in range(0, 1500)]
    docs += [(i, text(), "novel", "the lamp glass") for i in (100, 200, 200, 300, 7, 7)] + [(8, docs[8][1], "novel", None), (None, "the lamp", "novel", "x")]
    vectors = [(i, [rnd.uniform(-1, 1) for _ in range(4)], 3) for i in range(0, 450)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, title string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", ["bm25_topk", "bm25_candidates", "relevance_filter", "hybrid_linear_score", "sentence_topk", "sentence_document_score", "hybrid_evidence"])
def test_odd_tables_as_in_sql(name, spark, odd_tables):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd_tables}/{t}.parquet/*.parquet'")
    twin = con.sql(CORE.sql[name])
    got = [tuple(r) for r in CORE.queries[name](spark, odd_tables).select(*twin.columns).collect()]
    assert len(got) > 5 and sorted(got, key=repr) == sorted(twin.fetchall(), key=repr)


def test_queries_of_the_same_terms_are_one_set(spark):
    """What is scored grows with the distinct sets of terms, not with the queries."""
    asked = R.asked_sets(spark.createDataFrame([(i, "The lamp" if i % 2 else "lamp, the lamp") for i in range(50)], "query_id bigint, text string"))
    assert len(asked.sets) == 1 and asked.terms == ["lamp", "the"] and asked.queries.count() == 50


def test_all_hits_are_not_sent_to_the_driver(spark, odd_tables):
    """The queries are broadcast to the hits, which grow as documents times sets, whatever Spark takes their size for."""
    for most in ("-1", "1g"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            plan = CORE.queries["sentence_document_score"](spark, odd_tables)._jdf.queryExecution().sparkPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        join = next(x for x in plan.split("\n") if "Join" in x)
        assert "BuildRight" in join and "MapInArrow" in plan.split(join)[1].split("Join")[0]
