from datetime import datetime

from loomgraph.llm import survivors as S

SCHEMA = "record_id bigint, id string, description string, aliases array<string>, properties map<string,string>, origin string, updated_at timestamp, layer string"


def _rec(i, trust, recency, completeness, *fields):
    return {"record_id": i, "trust": trust, "recency": recency, "completeness": completeness, "fields": list(fields)}


def test_layers_of_dominance():
    a, b, c, d = _rec(1, 3, 9, 2), _rec(2, 1, 9, 3), _rec(3, 2, 5, 2), _rec(4, 2, 5, 1)
    layers = S.dominance_layers([d, c, b, a])
    assert [{r["record_id"] for r in x} for x in layers] == [{1, 2}, {3}, {4}]


def test_null_filled_from_the_second_layer():
    got = S.fill_fields([_rec(1, 3, 9, 2, "a", "b"), _rec(2, 2, 5, 2, "a", "c")])
    assert got == {"a": (1, 1), "b": (1, 1), "c": (2, 2)}


def test_deeper_layer_preferred_by_policy():
    """The first layer has the field only in a record of low trust; the policy wants the more trusted one below."""
    got = S.fill_fields([_rec(1, 3, 9, 5, "x"), _rec(2, 1, 10, 2, "f"), _rec(3, 2, 8, 1, "f")])
    assert got["f"] == (3, 2)


def _tables(spark, rows):
    t = lambda x: x and datetime(2024, 1, x)
    e = spark.createDataFrame([(i, k, d, a, p, o, t(u), "clash") for i, k, d, a, p, o, u in rows], SCHEMA)
    return e, spark.createDataFrame([("hand", 3), ("model", 1), (None, 9)], "origin string, trust int")


ROWS = [
    (1, "a", "A whole sentence.", None, {"age": "n/a", "job": "miller"}, "model", 9),
    (2, "a", "Broken off in the", ["unknown", "Ann"], {"age": "33"}, "hand", 1),
    (3, "a", "Another one.", [], {"job": "baker"}, "model", 9),
    (4, "b", "Only one record.", None, None, "hand", 1),
    (5, None, "No id.", None, None, "hand", 1),
    (6, None, "No id.", None, None, "hand", 1),
    (7, "c", None, None, None, None, None),
    (8, "c", "", ["", " "], {}, "nobody", None),
]


def test_survivors_by_hand(spark):
    e, o = _tables(spark, ROWS)
    got = {(r["id"], r["field"], r["record_id"]) for r in S.surviving_fields(e.unionByName(e), o).collect()}
    assert got == {("a", "description", 1), ("a", "aliases", 2), ("a", "properties.age", 2), ("a", "properties.job", 1)}
    one = S.surviving_records(e, o).collect()
    assert len(one) == 1 and one[0]["aliases"] == ["unknown", "Ann"] and one[0]["properties"] == {"age": "33", "job": "miller"}


def test_against_the_plain_rule(spark):
    d = "/root/testdata/sf0.01"
    e, o = spark.read.parquet(f"{d}/entities.parquet"), spark.read.parquet(f"{d}/origins.parquet")
    got = {tuple(r) for r in S.surviving_fields(e, o).select("id", "field", "record_id").collect()}
    assert got == {tuple(r) for r in S.best_by_window(e, o).collect()} and got


def test_empty(spark):
    e, o = _tables(spark, [])
    assert S.surviving_fields(e, o).count() == 0
