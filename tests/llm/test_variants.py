import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import variants as V

SCHEMA = "record_id bigint, id string, name string, entity_type array<string>, aliases array<string>, cluster string"


def _entities(spark, rows):
    return spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], SCHEMA)


def _groups(spark, rows):
    by = defaultdict(set)
    for r in V.name_groups(_entities(spark, rows)).collect():
        by[r["cluster"]].add(r["id"])
    return {frozenset(v) for v in by.values() if len(v) > 1}


PEOPLE = [
    ("a", "Florence Dinnanmagir", ["Character"], ["Flo"]),
    ("b", "FLORENCE  DINNANMAGIR ", ["Character", "Entity"], None),
    ("c", "Dinnanmagir, F.", ["Character"], []),
    ("d", "Flo Dinnanmager", ["Character"], []),
    ("e", "the lodger", ["Character"], ["Florence Dinnanmagir"]),
    ("f", "Dr Dinnanmagir", ["Character"], ["unknown"]),
    ("g", "Quentin Zehicunu", ["Character"], []),
    ("h", "Robert Zehicunu", ["Character"], []),
    ("i", "Zehicunu, Robert", ["Character"], []),
    ("j", "the nurse", ["Character"], []),
    ("k", "the nurse", ["Character"], ["null"]),
    ("l", "waiter", ["Character"], []),
    ("m", "waiter", ["Character"], []),
    ("n", "Florence Dinnanmagir", ["Location"], []),
    ("o", None, None, None),
    (None, "Florence Dinnanmagir", ["Character"], None),
]
HOUSES = [
    ("p", "Wemaganke Trading Society", ["Concept"], []),
    ("q", "Trading Society of Wemaganke", ["Concept"], []),
    ("r", "WTS", ["Concept"], ["Wemaganke Trading Soc."]),
    ("s", "Wemaganke Shipping Company", ["Concept"], []),
    ("t", "Wemaganke Shipping Co., Ltd", ["Concept"], []),
    ("u", "WTS", ["Concept"], []),
]


def test_people_and_organisations(spark):
    got = _groups(spark, PEOPLE + HOUSES)
    assert got == {frozenset("abcdef"), frozenset("hi"), frozenset("pqr"), frozenset("st")}


def test_repeated_rows_and_pairs(spark):
    e = _entities(spark, PEOPLE)
    pairs = {tuple(r) for r in V.linked_pairs(V.name_groups(e.unionByName(e))).collect()}
    assert ("h", "i") in pairs and len(pairs) == 16 and all(a < b for a, b in pairs)


def test_empty_table_and_long_names(spark):
    assert V.name_groups(_entities(spark, [])).count() == 0
    long = "x" * 3000
    assert _groups(spark, [("a", f"Ann {long}", ["Character"], []), ("b", f"{long}, Ann", ["Character"], [])]) == {frozenset("ab")}


@pytest.mark.parametrize(("a", "b", "most", "d"), [("kirk", "krik", 2, 1), ("abc", "abc", 2, 0), ("abc", "xyz", 2, 3), ("ab", "abcd", 2, 2), ("ca", "abc", 3, 3)])
def test_distance(a, b, most, d):
    assert V.distance(a, b, most) == d


def test_cosine_join_against_all_pairs(spark):
    """The join on n-grams of surnames loses no similar pair that comparing all pairs finds."""
    names = [("ann", "marranrinman"), ("bob", "marranrinmon"), ("", "marranrinman"), ("ann", "gunsoran"), ("b", "gunsorann"), ("bob", "zodarmobu"), ("ann", "zodramobu")]
    rows = [(i, "person", g, [s], False, False) for i, (g, s) in enumerate(names)]
    forms = spark.createDataFrame(rows, "form bigint, kind string, given string, words array<string>, many boolean, known boolean")
    found = {(r["a"], r["b"]) for r in V.judged_pairs(V.similar_forms(forms, 3), 0.3).collect()}

    def grams(g, s):
        return {w[i : i + 3] for w in (f"_{g}_" if g else "", f"_{s}_") for i in range(len(w) - 2)}

    def surname_grams(s):
        return grams("", s)

    df = Counter(g for x in names for g in grams(*x))
    w = {g: math.log1p(len(names) / n) for g, n in df.items()}
    norm = lambda x: math.sqrt(sum(w[g] ** 2 for g in grams(*x)))
    want = set()
    for i, x in enumerate(names):
        for j, y in enumerate(names[:i]):
            cosine = sum(w[g] ** 2 for g in grams(*x) & grams(*y)) / norm(x) / norm(y)
            if cosine >= 0.3 and surname_grams(x[1]) & surname_grams(y[1]) and V.distance(x[1], y[1], 2) <= 2:
                want.add((j, i))
    assert found == want and (0, 2) in want and (5, 6) in want


def _linkage(pairs, nodes, least):
    """Average linkage one merge at a time."""
    like = defaultdict(float)
    for a, b, s in pairs:
        like[a, b] = like[b, a] = s
    groups = [{n} for n in nodes]
    while True:
        best = max(((sum(like[a, b] for a in x for b in y) / (len(x) * len(y)), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j), default=(0, 0, 0))
        if best[0] < least:
            return {frozenset(g) for g in groups if len(g) > 1}
        groups[best[1]] |= groups.pop(best[2])


def test_average_linkage_against_one_merge_at_a_time(spark):
    pairs = [(1, 2, 0.9), (2, 3, 0.81), (1, 3, 0.3), (4, 5, 0.7), (5, 6, 0.65), (4, 6, -2.0), (3, 4, 0.5), (7, 8, 0.45), (8, 9, 0.44)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint, likeness double").withColumn("void", F.lit(0).cast("bigint"))
    got = defaultdict(set)
    for r in V.average_linkage(df, 0.4).collect():
        got[r["cluster"]].add(r["node"])
    assert {frozenset(g) for g in got.values()} == _linkage(pairs, range(1, 10), 0.4)


def test_near_surnames_without_a_common_ngram_are_linked(spark):
    rows = [("a", "Florentina Kirk", ["Character"], []), ("b", "Florentina Krik", ["Character"], []), ("c", "Florentina Bo", ["Character"], []), ("d", "Zeno Bode", ["Character"], [])]
    assert _groups(spark, rows) == {frozenset("ab")}


def test_near_names_against_all_pairs(spark):
    base = "kirk krik kri marranrinman maranrinmna bo ob abc bcd gunsoranzodarmobukel gunsoranzodramobukle gunsoranzodarmobukelxy".split()
    long = ["q" * 40 + w for w in base] + ["x" * 3000, "x" * 3000 + "yy"]
    names = spark.createDataFrame([("person", w) for w in base + long] + [("organisation", "kirk")], "kind string, name string")
    got = {(r["x"], r["y"]) for r in V.near_names(names).where("kind = 'person'").collect()}
    assert got == {(x, y) for x in base + long for y in base + long if V.distance(x, y, 2) <= 2}


def test_far_pairs_among_linked_forms_are_judged(spark):
    """Forms that a chain of links joins: every pair of the cosine counts, even of surnames four errors apart."""
    rows = [(i, "person", "florentina", [s], False, False) for i, s in enumerate(["marran", "marranxy", "marranxyzw", "gunso"])]
    forms = spark.createDataFrame(rows, "form bigint, kind string, given string, words array<string>, many boolean, known boolean")
    assert {(r["a"], r["b"]): r["void"] for r in V.likenesses(forms, 4, 0.2).collect()} == {(0, 1): 0, (1, 2): 0, (0, 2): 1}


def test_many_borne_names_meet_only_rare_ones(spark):
    rows = [("person", "kirkan", True), ("person", "kirken", True), ("person", "kirkon", False)]
    got = {(r["x"], r["y"]) for r in V.near_names(spark.createDataFrame(rows, "kind string, name string, many boolean")).collect() if r["x"] < r["y"]}
    assert got == {("kirkan", "kirkon"), ("kirken", "kirkon")}


def test_mistyped_organisations_of_many_ids_are_linked(spark):
    """Founders' names that several ids bear can still be one, unlike surnames."""
    rows = [(f"{w}{i}", f"{w} Trading Society", ["Concept"], []) for w in ("Wemaganke", "Wemagenke") for i in range(3)]
    assert _groups(spark, rows) == {frozenset(r[0] for r in rows)}


def test_weights_count_all_forms_where_few_have_vectors(spark):
    rows = [(i, "person", g, [s], False, False) for i, (g, s) in enumerate([("ann", "kirk"), ("bob", "kirk"), ("", "zodarmobu")])]
    forms = spark.createDataFrame(rows, "form bigint, kind string, given string, words array<string>, many boolean, known boolean")
    whole = {r["form"]: sorted((x["gram"], x["w"]) for x in r["v"]) for r in V.form_vectors(forms, 3).collect()}
    few = {r["form"]: sorted((x["gram"], x["w"]) for x in r["v"]) for r in V.form_vectors(forms, 3, forms.select("form").where("form = 0")).collect()}
    assert set(few) == {0} and few[0] == whole[0] and set(whole) == {0, 1, 2}
