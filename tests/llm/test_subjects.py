import numpy as np

import __spark_entry__
from loomgraph.llm import subjects

DATA = "/root/testdata/sf0.01"


def test_p9_is_registered_over_all_documents(spark):
    queries = __spark_entry__.queries()
    found = queries["p9_found"](spark, DATA)
    assert found.columns == ["doc_id", "subject_area"]
    rows = [tuple(r) for r in found.collect()]
    areas = {r[0] for r in spark.read.parquet(f"{DATA}/subject_areas.parquet").select("subject_area").collect()}
    labelled = {r[0] for r in spark.read.parquet(f"{DATA}/subject_labels.parquet").select("doc_id").collect()}
    assert rows and len(rows) == len(set(rows))
    assert {a for _, a in rows} <= areas
    assert {d for d, _ in rows} - labelled


def test_p9_shares_are_registered(spark):
    shares = __spark_entry__.queries()["p9_shares"](spark, DATA).collect()
    assert shares and all(0 < r["share"] <= 1 for r in shares)


AREAS = ["law", "sea"]
WORDS = {"law": "judge court verdict witness appeal", "sea": "anchor sail harbour tide mast"}


def _documents(spark, n=60):
    rows = []
    for i in range(n):
        area = AREAS[i % 2]
        words = WORDS[area].split()
        text = " ".join(f"The {words[(i + j) % 5]} and the {words[(i + j + 2) % 5]} were there that day." for j in range(6))
        rows.append((i, text if i % 3 else text + " Nothing else was said about it.", "clash"))
    rows += [(1000, None, "clash"), (1001, "", "clash"), (1002, "The lamp was on the table. The cat slept near it all day.", "clash"), (1003, rows[0][1] * 300, "clash")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, subject_area string")


def test_areas_of_held_out_documents(spark):
    docs = _documents(spark)
    labels = spark.createDataFrame([(i, f" {AREAS[i % 2].upper()} ") for i in range(40)] * 2 + [(41, "no area"), (None, "law")], "doc_id bigint, subject_area string")
    areas = spark.createDataFrame([(a, "") for a in AREAS], "subject_area string, about string")
    got = {(r["doc_id"], r["subject_area"]) for r in subjects.assign_subjects(docs, labels, areas).collect()}
    assert {(i, AREAS[i % 2]) for i in range(60)} <= got
    assert {d for d, _ in got}.isdisjoint({1000, 1001, 1002}) and (1003, "law") in got
    assert subjects.assign_subjects(docs, labels.where("false"), areas).count() == 0
    assert subjects.assign_subjects(docs.where("false"), labels, areas).count() == 0


def test_weights_without_cases_are_the_prior():
    assert np.allclose(subjects.fit_weights(np.zeros((0, 3)), np.zeros(0)), subjects.PRIOR_WEIGHTS)


def test_redundant_rules():
    conf = {(("a",), "x"): 0.8, (("a", "b"), "x"): 0.7, (("a", "c"), "x"): 0.9, (("d",), "none"): 0.9}
    assert subjects.prune(conf) == [(("a",), "x", 0.8), (("a", "c"), "x", 0.9)]
