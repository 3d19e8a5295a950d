from datetime import datetime

from loomgraph.operators.integrity import ForeignKey, orphan_cascade, orphan_report

GONE = "table_name string, removed_id string, removed_at timestamp, restored_at timestamp"


def _t(day):
    return None if day is None else datetime(2024, 1, day)


def _table(spark, rows):
    return spark.createDataFrame([(i, p, _t(d), "clash") for i, p, d in rows], "id string, parent string, created_at timestamp, period string")


def _run(spark, tables, gone=(), fks=None):
    fks = fks or [ForeignKey(t, "parent", u, "id") for t, u in zip("abcd", "bcd") if t in tables]
    removals = spark.createDataFrame([(t, i, _t(x), _t(y)) for t, i, x, y in gone], GONE)
    return {(r["table_name"], r["row_key"], r["reason"], r["kind"], r["depth"]) for r in orphan_cascade(tables, removals, fks).collect()}


def test_cascade_through_a_chain_of_tables(spark):
    tables = {"a": _table(spark, [("a1", "b1", 9)]), "b": _table(spark, [("b1", "c1", 8)]), "c": _table(spark, [("c1", "d1", 7), ("c2", "d2", 7)]), "d": _table(spark, [("d2", None, 1)])}
    assert _run(spark, tables) == {("c", "c1", "missing", "direct", 0), ("b", "b1", "orphaned_parent", "inherited", 1), ("a", "a1", "orphaned_parent", "inherited", 2)}


def test_cycle_ends(spark):
    rows = [("x1", "x2", 2), ("x2", "x3", 2), ("x3", "x1", 2), ("x3", "nobody", 2)]
    got = _run(spark, {"x": _table(spark, rows)}, fks=[ForeignKey("x", "parent", "x", "id")])
    assert {(k, d) for _, k, _, _, d in got} >= {("x3", 0), ("x2", 1), ("x1", 2)}


def test_reasons_nulls_and_repeats(spark):
    a = _table(spark, [("a1", " B1 ", 5), ("a1", " B1 ", 5), ("a2", None, 5), ("a3", "  ", 5), ("a4", "b2", 5), ("a5", "b3", 5), ("a6", "b3", 20), ("a7", "b9", None)])
    b = _table(spark, [("b1", None, 1), ("b2", None, 6), ("b3", None, 1), (None, None, 1)])
    got = _run(spark, {"a": a, "b": b}, [("b", "b3", 3, 10), ("b", "b3", 3, 10), ("b", "zzz", 1, None)], [ForeignKey("a", "parent", "b", "id")])
    assert got == {("a", "a4", "late", "direct", 0), ("a", "a5", "deleted", "direct", 0), ("a", "a7", "missing", "direct", 0)}


def test_empty_tables(spark):
    fk = [ForeignKey("a", "parent", "b", "id")]
    assert _run(spark, {"a": _table(spark, []), "b": _table(spark, [])}, fks=fk) == set()
    tables = {"a": _table(spark, [("a1", "b1", 2)]), "b": _table(spark, [])}
    assert _run(spark, tables, fks=fk) == {("a", "a1", "missing", "direct", 0)}
    removals = spark.createDataFrame([], GONE)
    assert [tuple(r)[2:] for r in orphan_report(orphan_cascade(tables, removals, fk)).collect()] == [("missing", "direct", 1, 1)]
