"""Variant spellings of names: weighted n-gram vectors, a cosine join, average-linkage groups.

Names become *forms* (a person's given name and surname, an organisation's
words), each once however many records bear it.  Forms are vectors of character
n-grams weighted by rarity; pairs come from a join of
surnames and founders' names that typing errors can part.  A check of the words
says whether a pair can be one name at all; then all pairs of cosine ``least``
or more among forms that links join are judged, and average linkage groups the forms, in rounds in which all mutually nearest clusters merge.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.survivors import says_something
from loomgraph.operators.graph import components
from loomgraph.session import cut_lineage

PERSON, HOUSE = "person", "organisation"
CONTRADICTION = -2.0  # likeness of forms that cannot be one name, so that no third form brings them together

# Fixed values, in lower case.

#: Titles before a person's name.
TITLES = set("dr doctor capt captain judge prof professor mr mrs ms miss sir lady lord madame dame rev reverend father sister brother major colonel col general sergeant sgt lieutenant lt inspector".split())
#: What begins a mere description.
DETERMINERS = set("the a an our my his her their your its that this some one le la les un une der die das ein eine el los las".split())
#: Words of organisations that tell none apart.
LEGAL = set("limited ltd inc incorporated llc plc gmbh sons and the of".split())

_PARTS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_CAMEL = re.compile(r"(?<=[^\W\d_A-Z])(?=[A-Z])")


def _folded(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))


def person_form(name: str) -> tuple[str, str] | None:
    """(given name or initial, surname) of a person's name; a bare word is a surname; None for a description."""
    name = _CAMEL.sub(" ", _folded(name)).lower()
    before, comma, after = name.partition(",")
    if comma and _PARTS.search(after):
        name = f"{after} {before}"
    words = _PARTS.findall(name)
    initial = len(words) > 1 and words[0] == "a" and (len(words) == 2 or len(words[1]) == 1)
    if not words or (words[0] in DETERMINERS and not initial) or any(w.endswith(("'s", "’s")) for w in words):
        return None
    while len(words) > 1 and words[0] in TITLES:
        words = words[1:]
    if len(words[-1]) < 2:
        return None
    return (words[0] if len(words) > 1 else "", words[-1])


def organisation_form(name: str) -> tuple[str, ...] | None:
    """The words of an organisation's name, the founder's first; None for an acronym or a single word."""
    name = re.sub(r"['’]s\b", "", _CAMEL.sub(" ", _folded(name)).lower())
    kind, of, founder = name.partition(" of ")
    words = tuple(w for w in _PARTS.findall(f"{founder} {kind}" if of else name) if w not in LEGAL)
    return words if len(words) > 1 and any(len(w) > 3 for w in words) else None


def distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that part two words; ``most + 1`` if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _abbreviates(a: str, b: str) -> bool:
    """Whether the shorter word has the other's first letter and only letters of it, in order."""
    a, b = sorted((a, b), key=len)
    rest = iter(b)
    return len(a) > 1 and len(a) < len(b) and a[0] == b[0] and all(c in rest for c in a)


def one_organisation(a: list[str], b: list[str]) -> bool:
    """Whether two forms can name one organisation: word by word equal, mistyped or abbreviated, the founder's name not abbreviated."""
    if len(a) != len(b):
        return False
    typos = distance(a[0], b[0], 2)
    if typos > 2:
        return False
    for x, y in zip(a[1:], b[1:]):
        if not _abbreviates(x, y):
            typos += distance(x, y, 2)
        if typos > 2:
            return False
    return True


def one_person(a: tuple[str, str], b: tuple[str, str], common: tuple[bool, bool], known: tuple[bool, bool]) -> bool | None:
    """Whether two forms can name one person; None if that can't be told.

    Surnames are equal, or a rare one is up to two typing errors away; given
    names agree if equal, the initial of the other, missing, or, unless both are
    ``known`` ones, so near that both forms have two errors at most.  More
    errors than that between two forms, of which each may be a mistyped third,
    tell nothing, nor do two in a surname beside an initial or no given name.
    ``common``: whether several ids bear the surname.
    """
    (g, s), (h, t) = a, b
    off = distance(s, t, 2)
    if off and all(common):
        return False
    if len(g) > 1 and len(h) > 1:
        apart = distance(g, h, 4)
        if apart and (all(known) or apart > 4):
            return False
        return True if off <= 2 and (not apart or apart + off <= 2 and min(len(g), len(h)) > 3) else None
    if g and h and g[0] != h[0]:
        return False if all(known[k] or len(x) == 1 for k, x in enumerate((g, h))) else None
    return True if off < 2 else None


def mentions(entities: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``id, kind, given, words, alone``: the forms of names and aliases, and single words that ids are called too (``alone``)."""
    kind = F.lit(None).cast("string")
    for of, k in kinds.items():
        kind = F.coalesce(kind, F.when(F.array_contains("entity_type", of), F.lit(k)))
    names = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entities.where("id is not null").select("id", kind.alias("kind"), F.explode(names).alias("text")).where(F.col("kind").isNotNull() & says_something(F.col("text")))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, k, text in zip(pdf["id"], pdf["kind"], pdf["text"]):
                if k == PERSON:
                    form = person_form(text)
                    if form:
                        out.append((i, k, form[0], [form[1]], not form[0]))
                else:
                    words = organisation_form(text)
                    if words:
                        out.append((i, k, "", list(words), False))
            yield pd.DataFrame(out, columns=["id", "kind", "given", "words", "alone"])

    return rows.distinct().mapInPandas(parse, "id string, kind string, given string, words array<string>, alone boolean").distinct()


def short_names(said: DataFrame, least_share: float = 0.5) -> DataFrame:
    """``short, full``: given names that chiefly stand for another, more frequent one, told from ids with both."""
    people = said.where(F.col("kind") == PERSON)
    named = people.where(~F.col("alone") & (F.length("given") > 1))
    often = named.groupBy("given").agg(F.count_distinct("id").alias("n"))
    also = people.where("alone").select("id", F.col("words")[0].alias("also"))
    both = named.select("id", "given").distinct().join(also, "id").where("given <> also")
    either = both.select("id", F.col("also").alias("short"), F.col("given").alias("full")).unionByName(both.select("id", F.col("given").alias("short"), F.col("also").alias("full")))
    n = either.groupBy("short", "full").agg(F.count_distinct("id").alias("pairs"))
    n = n.join(often.select(F.col("given").alias("full"), F.col("n").alias("n_full")), "full").join(often.select(F.col("given").alias("short"), F.col("n").alias("n_short")), "short", "left")
    best = n.where("n_full > 2 * coalesce(n_short, 0)").groupBy("short").agg(F.max_by("full", F.struct("pairs", "n_full", "full")).alias("full"), F.max("pairs").alias("top"), F.sum("pairs").alias("of"))
    return best.where(F.col("top") >= least_share * F.col("of")).select("short", "full")


def forms_of_ids(said: DataFrame) -> DataFrame:
    """``id, kind, given, words``: what each id is called, given names in full where that is known.

    A single word is a name only if it is the surname of somebody called by two
    words; a form whose bearers have as many different surnames besides as they
    are themselves is a description ("old grey"); both name nobody in particular.
    An initial or missing given name is taken from the id's other names.
    """
    short = cut_lineage(short_names(said), "short")
    organisations = said.where(F.col("kind") != PERSON).select("id", "kind", "given", "words")
    people = said.where(F.col("kind") == PERSON).select("id", "given", F.col("words")[0].alias("surname"), "alone")
    full = people.where("not alone")
    # "A. Hale" is somebody, "a nurse" is nobody, unless somebody is called Nurse
    sure = full.where("given <> 'a'")
    full = sure.unionByName(full.where("given = 'a'").join(sure.select("surname").distinct(), "surname", "left_semi").select(*sure.columns))
    borne = full.groupBy("given", "surname").agg(F.count_distinct("id").alias("bearers"))
    besides = full.alias("x").join(full.alias("y"), "id").where("x.surname <> y.surname")
    besides = besides.groupBy(F.col("x.given").alias("given"), F.col("x.surname").alias("surname")).agg(F.count_distinct("y.surname").alias("others"))
    vague = borne.join(besides, ["given", "surname"]).where("others >= 2 and others > 0.6 * bearers").select("given", "surname")
    full = cut_lineage(full.join(vague, ["given", "surname"], "left_anti"), "full")
    houses = full.select("surname").distinct()
    bare = people.where("alone").join(houses, "surname", "left_semi")
    called = people.where("alone").join(houses, "surname", "left_anti").select("id", F.col("surname").alias("short"))
    called = called.join(short, "short", "left").select("id", F.coalesce("full", "short").alias("also"))
    called = called.join(full.select(F.col("given").alias("also")).where("length(also) > 1").distinct(), "also", "left_semi").groupBy("id").agg(F.min("also").alias("also"))
    forms = full.select("id", "given", "surname").unionByName(bare.select("id", "given", "surname"))
    forms = forms.join(short, forms["given"] == short["short"], "left").join(called, "id", "left")
    of_initial = (F.length("given") == 1) & F.startswith("also", "given")
    given = F.when(F.coalesce(of_initial | (F.col("given") == ""), F.lit(False)) & F.col("also").isNotNull(), F.col("also")).otherwise(F.coalesce("full", "given"))
    return forms.select("id", F.lit(PERSON).alias("kind"), given.alias("given"), F.array("surname").alias("words")).unionByName(organisations).distinct()


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _keys_of(names: list[str], most: int, long: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``names`` and the hashes of what is left of them (see ``near_names``), a batch of equal lengths at a time."""
    powers = np.cumprod(np.full(max([6, *map(len, names)]), _BASE, dtype=np.uint64))
    by_length: dict[int, list[int]] = {}
    for k, name in enumerate(names):
        by_length.setdefault(len(name), []).append(k)
        if len(name) > long:
            codes = np.frombuffer(f"_{name}_".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            runs = np.unique((np.lib.stride_tricks.sliding_window_view(codes, 6) * powers[:6]).sum(axis=1, dtype=np.uint64))
            yield np.full(len(runs), k), runs ^ np.uint64(most + 1)
    for length, at in by_length.items():
        places = np.array(at)
        if length > long + 2:
            continue
        codes = np.frombuffer("".join(names[k] for k in at).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64).reshape(len(at), length)
        for lost in range(min(most, length) + 1):
            for gone in combinations(range(length), lost):
                left = np.delete(codes, gone, axis=1)
                yield places, (left * powers[: length - lost]).sum(axis=1, dtype=np.uint64) + np.uint64((length - lost) * 1000003)


def near_names(names: DataFrame, most: int = 2, long: int = 18) -> DataFrame:
    """``kind, x, y``: the ``kind, name`` that ``distance`` puts ``most`` (2 at most) errors apart or less, both ways round, each with itself too.

    Words two errors apart become equal when each loses two letters at most, so
    what is left of them is the key that brings them together; above ``long``
    letters two such words share a run of six.  Keys are few a name and shared by
    near names only.  Names that are ``many``, if there is such a column, meet
    only names that are not.
    """
    many = F.col("many").cast("bigint") if "many" in names.columns else F.lit(0).cast("bigint")
    named = names.groupBy("kind", "name").agg(F.min(many).alias("many"))
    named = named.select("kind", "name", (F.shiftleft(F.xxhash64("kind", "name"), 1) + F.col("many")).alias("id"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            seeds = batch.column(2).to_numpy().view(np.uint64)
            for places, h in _gathered(_keys_of(batch.column(1).to_pylist(), most, long)):
                yield pa.RecordBatch.from_arrays([pa.array(_mixed(h ^ seeds[places]).view(np.int64)), pa.array(ids[places])], ["key", "id"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        key, of = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.lexsort((of, key))
        key, of = key[order], of[order]
        first, step = np.arange(len(key)), 1
        while len(first := first[first + step < len(key)]):
            first = first[key[first] == key[first + step]]
            a, b = of[first], of[first + step]
            good = (a != b) & ((a & b & 1) == 0)
            pairs = np.unique(np.stack([a[good], b[good]], axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs.min(axis=1))), pa.array(np.ascontiguousarray(pairs.max(axis=1)))], ["a", "b"])
            step += 1

    keyed = named.select("id", "name", F.xxhash64("kind").alias("seed")).mapInArrow(keys, "key bigint, id bigint")
    met = keyed.repartition("key").mapInArrow(meet, "a bigint, b bigint").distinct()
    met = met.join(named.select(F.col("id").alias("a"), "kind", F.col("name").alias("x")), "a").join(named.select(F.col("id").alias("b"), F.col("kind").alias("kind_b"), F.col("name").alias("y")), "b")
    met = met.where((F.col("kind") == F.col("kind_b")) & (F.abs(F.length("x") - F.length("y")) <= most)).select("kind", "x", "y", F.levenshtein("x", "y", 2 * most).alias("apart")).where("apart >= 0")

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[n <= most or distance(x, y, most) <= most for x, y, n in zip(pdf["x"], pdf["y"], pdf["apart"])], ["kind", "x", "y"]]

    met = cut_lineage(met.mapInPandas(judged, "kind string, x string, y string"), "names")
    return met.unionByName(met.select("kind", F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(names.select("kind", F.col("name").alias("x"), F.col("name").alias("y")).distinct())


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]], rows: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same places and hashes in fewer, larger arrays."""
    held, n = [], 0
    for places, h in parts:
        held.append((places, h))
        n += len(places)
        if n >= rows:
            yield np.concatenate([p for p, _ in held]), np.concatenate([h for _, h in held])
            held, n = [], 0
    if held:
        yield np.concatenate([p for p, _ in held]), np.concatenate([h for _, h in held])


def form_vectors(forms: DataFrame, n: int, of: DataFrame | None = None) -> DataFrame:
    """The ``form, kind, given, words, many, known`` with their n-grams and weights ``v`` and their ``norm``.

    All forms count for the weights; only those in ``of`` (``form``), if given, come out.
    """
    padded = F.transform(F.filter(F.concat(F.array("given"), "words"), lambda w: w != ""), lambda w: F.concat(F.lit("_"), w, F.lit("_")))
    grams = F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - n + 1)), lambda i: F.substring(w, i, F.lit(n))))))
    forms_out = forms if of is None else forms.join(of, "form", "left_semi")
    rows_out = forms_out.select("form", "kind", F.explode(grams).alias("gram"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        for pdf in batches:
            for kind, given, words in zip(pdf["kind"], pdf["given"], pdf["words"]):
                padded = [f"_{w}_" for w in (given, *words) if w]
                seen.setdefault(kind, Counter()).update({w[i : i + n] for w in padded for i in range(max(1, len(w) - n + 1))})
            if sum(map(len, seen.values())) > 300_000:
                yield counted(seen)
                seen.clear()
        yield counted(seen)

    def counted(seen: dict[str, Counter]) -> pd.DataFrame:
        return pd.DataFrame([(kind, gram, m) for kind, c in seen.items() for gram, m in c.items()], columns=["kind", "gram", "df"])

    seen = forms.select("kind", "given", "words").mapInPandas(count, "kind string, gram string, df bigint").groupBy("kind", "gram").agg(F.sum("df").alias("df"))
    total = forms.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    weights = seen.join(F.broadcast(total), "kind").select("kind", "gram", F.log1p(F.col("total") / F.col("df")).alias("w"))
    vectors = rows_out.join(weights, ["kind", "gram"]).groupBy("form").agg(F.collect_list(F.struct("gram", "w")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    return vectors.withColumn("norm", norm).join(forms_out, "form")


def _with_vectors(met: DataFrame, vectors: DataFrame) -> DataFrame:
    side = lambda s: vectors.select(F.col("form").alias(s), F.struct("kind", "given", "words", "norm", "v", "many", "known").alias(f"{s}_"))
    return met.join(side("a"), "a").join(side("b"), "b")


def _near_forms(forms: DataFrame) -> DataFrame:
    """``a < b``: the forms whose surnames (founders' names of organisations) are two errors apart at most, and equal if both are ``many`` (persons of such surnames are never one)."""
    named = forms.select("form", "kind", F.col("words")[0].alias("name"), (F.col("many") & (F.col("kind") == PERSON)).alias("many"))
    a, b = named.select("kind", F.col("name").alias("x"), F.col("form").alias("a")), named.select("kind", F.col("name").alias("y"), F.col("form").alias("b"))
    return near_names(named).join(a, ["kind", "x"]).join(b, ["kind", "y"]).where("a < b").select("a", "b")


def similar_forms(forms: DataFrame, n: int) -> DataFrame:
    """Pairs ``a < b`` of the ``form, kind, given, words`` that may be one name, with their n-gram vectors (``judged_pairs`` works out the cosine).

    Only surnames (founders' names of organisations) two errors apart or less can be one, so these are all the links
    that there are, whether or not they share an n-gram.  No list is cut.
    """
    vectors = cut_lineage(form_vectors(forms, n), "vectors")
    return _with_vectors(_near_forms(forms), vectors)


def likenesses(forms: DataFrame, n: int, least: float) -> DataFrame:
    """``a, b, likeness, void`` of all pairs of cosine ``least`` or more that average linkage with a bound above 0 can heed.

    Clusters merge only along links, so pairs of forms that no chain of links
    joins change nothing.  Of forms that one does join, all pairs are judged,
    also those of far surnames.
    """
    near = cut_lineage(_near_forms(forms), "near")
    vectors = cut_lineage(form_vectors(forms, n, near.select(F.explode(F.array("a", "b")).alias("form")).distinct()), "vectors")
    first = cut_lineage(judged_pairs(_with_vectors(near, vectors), least), "links")
    labels = cut_lineage(components(first.where("likeness > 0"), "a", "b"), "linked")
    x, y = labels.select("component", F.col("node").alias("a")), labels.select("component", F.col("node").alias("b"))
    met = x.join(y, "component").where("a < b").select("a", "b")
    known = first.join(labels.select(F.col("node").alias("a"), "component"), "a").join(labels.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").where("component = other")
    rest = met.join(first.select("a", "b"), ["a", "b"], "left_anti")
    return known.select("a", "b", "likeness", "void").unionByName(judged_pairs(_with_vectors(rest, vectors), least))


def judged_pairs(pairs: DataFrame, least: float) -> DataFrame:
    """``a, b, likeness, void``: the cosine of the pairs from ``least`` on that can be one name, ``CONTRADICTION`` for those that cannot, void those that tell nothing."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            sides = [list(zip(*(pdf[f"{c}_{x}"] for c in ("given", "words", "many", "known")))) for x in "ab"]
            for a, b, kind, cosine, (g, v, m, k), (h, w, o, q) in zip(pdf["a"], pdf["b"], pdf["kind"], pdf["cosine"], *sides):
                same = one_person((g, v[0]), (h, w[0]), (m, o), (k, q)) if kind == PERSON else one_organisation(list(v), list(w))
                out.append((a, b, 0.0 if same is None else cosine if same else CONTRADICTION, int(same is None)))
            yield pd.DataFrame(out, columns=["a", "b", "likeness", "void"])

    # an n-gram has one weight, so that the common ones are equal in both
    common = F.aggregate(F.array_intersect("a_.v", "b_.v"), F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
    flat = [F.col(f"{x}_.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("given", "words", "many", "known")]
    pairs = pairs.select("a", "b", F.col("a_.kind").alias("kind"), (common / (F.col("a_.norm") * F.col("b_.norm"))).alias("cosine"), *flat).where(F.col("cosine") >= least)
    return pairs.mapInPandas(judge, "a bigint, b bigint, likeness double, void bigint")


def average_linkage(pairs: DataFrame, least: float) -> DataFrame:
    """``node, cluster`` of every node of ``pairs`` (``a, b, likeness, void``) that is in a cluster of two or more.

    Average linkage: two clusters are as alike as the mean over all pairs of
    their members, a pair not given counting 0 and a void one nothing, and the most alike merge until
    no two reach ``least``.  In each round all clusters that are each other's
    nearest merge at once, which gives the same clusters; ties are broken by a
    hash, so that equal likenesses do not form a queue.  A round is a few
    aggregations over the pairs left between clusters.
    """
    spark = pairs.sparkSession
    state = pairs.select("a", "b", F.col("likeness").alias("sum"), "void", F.lit(1).cast("bigint").alias("n_a"), F.lit(1).cast("bigint").alias("n_b"))
    labels = spark.createDataFrame([], "node bigint, cluster bigint")
    while True:
        mean = F.col("sum") / F.greatest(F.lit(1), F.col("n_a") * F.col("n_b") - F.col("void"))
        open_ = state.withColumn("mean", mean).where(F.col("mean") >= least)
        rank = F.struct(F.col("mean"), F.xxhash64("a", "b").alias("h"), "a", "b")
        ends = open_.select(F.col("a").alias("node"), F.col("b").alias("other"), F.col("n_a").alias("size"), rank.alias("rank"))
        ends = ends.unionByName(open_.select(F.col("b").alias("node"), F.col("a").alias("other"), F.col("n_b").alias("size"), rank.alias("rank")))
        best = ends.groupBy("node").agg(F.max_by(F.struct("other", "size"), "rank").alias("m"))
        best = best.select("node", F.col("m.other").alias("other"), F.col("m.size").alias("size"))
        mutual = best.alias("x").join(best.alias("y"), (F.col("x.other") == F.col("y.node")) & (F.col("y.other") == F.col("x.node")) & (F.col("x.node") < F.col("y.node")))
        merged = mutual.select(F.col("x.node").alias("into"), F.col("y.node").alias("gone"), (F.col("x.size") + F.col("y.size")).alias("size"))
        moves = cut_lineage(merged.select(F.explode(F.array("into", "gone")).alias("node"), "into", "size"), "moves")
        if moves.isEmpty():
            return labels
        fresh = moves.select("node", F.col("into").alias("cluster"))
        into = moves.select(F.col("node").alias("cluster"), "into")
        labels = labels.join(into, "cluster", "left").select("node", F.coalesce("into", "cluster").alias("cluster"))
        labels = cut_lineage(labels.unionByName(fresh.join(labels.select("node"), "node", "left_anti")), "labels")
        for end in ("a", "b"):
            side = moves.select(F.col("node").alias(end), F.col("into").alias("to"), F.col("size").alias("new"))
            state = state.join(side, end, "left").withColumn(end, F.coalesce("to", end)).withColumn(f"n_{end}", F.coalesce("new", f"n_{end}")).drop("to", "new")
        turned = F.col("a") > F.col("b")
        state = state.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sum", "void", F.when(turned, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(turned, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"))
        state = cut_lineage(state.groupBy("a", "b").agg(F.sum("sum").alias("sum"), F.sum("void").alias("void"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")), "linkage")


def name_groups(
    entities: DataFrame,
    kinds: dict[str, str] | None = None,
    n: int = 4,
    least_cosine: float = 0.2,
    least_average: float = 0.1,
) -> DataFrame:
    """``id, cluster``: the ids of ``entities`` by whom they mean.

    ``kinds`` says which entity types are persons and which organisations; other
    rows are left out.  All rows, names and aliases count; n-gram statistics
    cover all forms; the partners of a form are all that reach ``least_cosine``
    (no top n cuts any off).  An id called by two names stands in both groups.

    Null ids, and ids without a name that says something (null, blank, a
    stand-in, a description, an acronym or single given name alone) come out in
    no group; repeated rows count once; an empty table gives no row; names of
    any length are treated whole; other columns are ignored.
    """
    kinds = kinds or {"Character": PERSON, "Concept": HOUSE}
    said = cut_lineage(mentions(entities, kinds), "mentions")
    called = forms_of_ids(said)
    called = cut_lineage(called.withColumn("form", F.xxhash64("kind", "given", "words")), "called")
    surname = F.col("words")[0]
    many = called.groupBy("kind", surname.alias("name")).agg((F.count_distinct("id") > 2).alias("many"))
    known = called.where(F.length("given") > 1).groupBy("given").agg((F.count_distinct(surname) >= 3).alias("known"))
    forms = called.select("form", "kind", "given", "words", surname.alias("name")).distinct()
    forms = forms.join(many, ["kind", "name"]).join(known, "given", "left").withColumn("known", F.coalesce("known", F.lit(False))).drop("name")
    pairs = cut_lineage(likenesses(cut_lineage(forms, "forms"), n, least_cosine), "likeness")
    groups = average_linkage(pairs, least_average)
    ids = called.select("id", "form").join(groups.withColumnRenamed("node", "form"), "form", "left")
    return ids.select("id", F.coalesce("cluster", "form").alias("cluster")).distinct()


def linked_pairs(groups: DataFrame) -> DataFrame:
    """``id_a < id_b``: all pairs of the ids of each group, once."""
    a, b = groups.alias("a"), groups.alias("b")
    met = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.id") < F.col("b.id")))
    return met.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
