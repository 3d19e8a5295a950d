"""Text expressions: tokens, lengths, languages, normal forms, query shapes.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a token, a CJK character, a stop word of grounding.
TOKEN = r"[a-z0-9_]+|[一-鿿]"
MIXED_TOKEN = r"[A-Za-z0-9_-]+|[一-鿿]"
STOP_WORDS = "a an and are as at be by did do does for from how in is it of on or that the to was were what when where which who why with".split()


def collapsed(c: Column) -> Column:
    """Blanks, tabs and line ends collapsed to one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, "[ \\t\\r\\n]+", " "), "^ | $", "")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, and single CJK characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def mixed_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(MIXED_TOKEN), F.lit(0))


def cjk_chars(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[一-鿿]")).cast("bigint")


def latin_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[A-Za-z0-9]+")).cast("bigint")


def word_length(c: Column) -> Column:
    """The larger of the Latin words and the CJK characters."""
    return F.greatest(latin_words(c), cjk_chars(c))


def language(c: Column) -> Column:
    """'zh' if CJK characters outnumber Latin letters, else 'en'."""
    return F.when(cjk_chars(c) > F.regexp_count(c, F.lit("[A-Za-z]")), "zh").otherwise("en")


def keywords(c: Column, least: int = 3) -> Column:
    """The distinct Latin words of ``least`` letters or more, in lower case and order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{%d,}" % least), F.lit(0)))


def sentences(c: Column) -> Column:
    """Split behind a sentence's sign and blanks."""
    return F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), "\u0001")


def surface(c: Column) -> Column:
    """A name without punctuation and case, its blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def variant_score(a: Column, b: Column) -> Column:
    """1 for equal surfaces, .85 if one begins with the other, .65 if it is contained, else 0."""
    x, y = surface(a), surface(b)
    both = (x != "") & (y != "")
    return F.when(both & (x == y), 1.0).when(both & (F.startswith(x, y) | F.startswith(y, x)), 0.85).when(both & (F.contains(x, y) | F.contains(y, x)), 0.65).otherwise(0.0)


def stemmed(w: Column) -> Column:
    """A crude stem: -ing, -ed, -es, -s off words long enough."""
    return F.when(F.endswith(w, F.lit("ing")) & (F.length(w) > 5), F.substring(w, F.lit(1), F.length(w) - 3)).when(F.endswith(w, F.lit("ed")) & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 2)).when(
        F.endswith(w, F.lit("es")) & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 2)
    ).when(F.endswith(w, F.lit("s")) & (F.length(w) > 3), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def grounding_tokens(c: Column) -> Column:
    """The distinct stems of the tokens that are no stop words."""
    kept = F.filter(tokens(c), lambda w: ~w.isin(STOP_WORDS))
    return F.array_distinct(F.transform(kept, stemmed))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of the members of ``a`` that ``b`` has too; 0 for an empty ``a``."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Shared members over the smaller set; two empty sets are alike, one empty is not."""
    x, y = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(x, y))


def char_ngrams(c: Column, n: int) -> Column:
    return F.array_distinct(F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))


def abstracted(c: Column) -> Column:
    """URLs, mail addresses, times and numbers replaced by placeholders."""
    out = F.regexp_replace(c, r"https?://\S+", "[URL]")
    out = F.regexp_replace(out, r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", "[EMAIL]")
    out = F.regexp_replace(out, r"[0-9]{1,2}:[0-9]{2}", "[TIME]")
    return F.regexp_replace(out, r"[0-9]+", "[NUMBER]")


def is_choice_question(c: Column) -> Column:
    return c.rlike(r"\(A\).*\(B\)")


def question_kind(c: Column) -> Column:
    """The shape of a question by its first word."""
    w = F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1))
    return (
        F.when(is_choice_question(c), "choice").when(w == "who", "person").when(w == "where", "place").when(w == "when", "time").when(w == "why", "cause")
        .when(w.isin("how", "explain", "describe"), "process").when(w.isin("compare", "list", "summarise"), w).when(w == "what", "event").otherwise("other")
    )


def choices(c: Column) -> Column:
    """The options of a choice question: ``array<struct<label, option>>``."""
    found = F.regexp_extract_all(c, F.lit(r"\(([A-D])\)\s*([^(]+)"), F.lit(1))
    texts = F.regexp_extract_all(c, F.lit(r"\(([A-D])\)\s*([^(]+)"), F.lit(2))
    return F.transform(found, lambda x, i: F.struct(x.alias("label"), F.trim(F.get(texts, i)).alias("option")))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("||", *parts)), 1, 12))
