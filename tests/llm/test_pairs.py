from loomgraph.llm import pairs as P

SCHEMA = "key string, asked string, said string, text string"
EN = "Behind the old mill, a stranger found the lantern and waited for the rain."
FR = "Personne ne savait où la vieille dame avait caché la lettre de son frère."
DE = "Am Abend fand der Müller die Laterne nicht, und es war dunkel auf dem Hof."


def _found(spark, rows):
    fill = [(f"f{i}", "Who was at the mill?", f"{a} {i}.", "clash") for i in range(8) for a in (EN, FR, DE)]
    df = spark.createDataFrame([(*r, "clash") for r in rows] + [(k, None, s, c) for k, _, s, c in fill], SCHEMA)
    return {r["key"]: r["defect"] for r in P.find_defects(df, "key", "asked", "said").collect() if not r["key"].startswith("f")}


def test_each_defect(spark):
    q = "Who was at the mill with the lantern?"
    rows = [
        ("sound", q, EN), ("short", q, "The old mill"), ("says it first", q, f"{q} {EN}"), ("quotes", q, '"I am sorry, but I cannot answer," said Ann.'),
        ("null", q, None), ("blank", q, " 　 "), ("stand-in", q, "(N/A)"), ("copy", q, f"You asked: {q.lower()}"), ("refusal", q, "I'm sorry, but I can't help with that."),
        ("other", q, FR), ("cut", q, "Behind the old mill, a stranger found the"), ("marked", q, "The mill was old.\n...[truncated]...\nIt burnt."),
        ("bare item", q, "1. The mill was old.\n2. The clerk was late.\n3. "), ("list", q, "- The mill\n- The lantern\n- The rain"), (None, q, None),
    ]
    got = _found(spark, rows + rows)
    assert got == {"null": "empty", "blank": "empty", "stand-in": "empty", "copy": "copy", "refusal": "refusal", "other": "other_language", "cut": "truncated", "marked": "truncated", "bare item": "truncated"}


def test_shortened_versions_decide(spark):
    """A short answer and a list that another response continues inside a word."""
    rows = [("s", "Who?", "The har"), ("l", "What?", "- The lamp\n- The lan"), ("x", "Who?", "The harbour wall was wet."), ("y", "What?", "- The lamp\n- The lantern"), ("z", "Who?", "Des"), ("w", "Who?", "Desmond")]
    assert _found(spark, rows) == {"s": "truncated", "l": "truncated"}
    assert _found(spark, [r for r in rows if r[0] not in "xy"]) == {}


def test_length_spike(spark):
    """Lists that all stop at one length."""
    cut = [(f"c{i}", "What?", ("- item number %04d and its place " % i * 4)[:100].rstrip()) for i in range(60)]
    even = [(f"e{i}", "What?", f"- {i} " + "lamp " * (16 + i % 30) + "end") for i in range(60)]
    even = [r for r in even if len(r[2]) != 100]
    got = _found(spark, cut + even)
    assert {k for k in got if k.startswith("c")} == {k for k, _, s in cut if len(s) == 100} and len(got) >= 55
    assert not any(k.startswith("e") for k in got)


def test_empty_and_long(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert P.find_defects(df, "key", "asked", "said").count() == 0
    assert _found(spark, [("long", "Who?", "word " * 200_000)]) == {"long": "truncated"}
