"""Merging and refining what extraction gave: entity buckets, relations, scopes, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import stable_id, surface
from loomgraph.sources.tables import SUPER_LABEL, distinct_sorted, filled

#: Which type names an entity of several, in this order.
TYPE_ORDER = ["Event", "Occasion", "Character", "Object", "Location", "TimePoint", "Concept"]


def primary_type(types: Column) -> Column:
    """The first type in ``TYPE_ORDER``, else the smallest name, else Concept."""
    kept = distinct_sorted(F.filter(types, lambda t: t != SUPER_LABEL))
    known = [F.when(F.array_contains(kept, t), t) for t in TYPE_ORDER]
    return F.coalesce(*known, F.get(kept, 0), F.lit("Concept"))


def bucket_merge(entities: DataFrame) -> DataFrame:
    """Entities of one bucket merged: ``id, scope, base_document, type, name, aliases, source_documents, records``.

    A local entity's bucket is its story, type and name; a global one's its type
    and name.  The id is a digest of the bucket.  Rows without a name are left out.
    """
    is_global = F.coalesce(F.lower(F.trim("scope_level")) == "global", F.lit(False))
    rows = entities.select(
        F.when(is_global, "global").otherwise("local").alias("scope"), F.when(is_global, "").otherwise(F.coalesce(filled("base_document"), F.lit(""))).alias("base_document"),
        primary_type(F.coalesce("entity_type", F.array().cast("array<string>"))).alias("type"), filled("name").alias("name"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("source_documents", F.array().cast("array<string>")).alias("documents"),
    ).where("name is not null")
    out = rows.groupBy("scope", "base_document", "type", "name").agg(
        distinct_sorted(F.flatten(F.collect_set("aliases"))).alias("aliases"), distinct_sorted(F.flatten(F.collect_set("documents"))).alias("source_documents"), F.count(F.lit(1)).alias("records")
    )
    return out.withColumn("id", stable_id("ent_", "scope", "base_document", "type", "name"))


def merge_relations(edges: DataFrame) -> DataFrame:
    """Momentary edges stay; others merge by (predicate, src, dst): first id, longest description, first story."""
    is_momentary = F.col("persistence") == "momentary"
    key = F.when(is_momentary, F.col("id")).otherwise(F.lit(""))
    longest = F.max_by("description", F.struct(F.length("description").alias("n"), "id"))
    out = edges.groupBy("predicate", "src", "dst", key.alias("own")).agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("merged"), longest.alias("description"), F.min_by("base_document", F.when(F.col("base_document").isNotNull(), F.col("id"))).alias("base_document"), F.max("confidence").alias("confidence")
    )
    return out.drop("own")


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (a maximum over a struct, combined before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*")


def scope_votes(entities: DataFrame, tie_breaker: str = "global") -> DataFrame:
    """The scope of each name by majority: ``name, n_global, n_local, scope``; events, occasions and times are local."""
    s = F.lower(F.trim("scope_level"))
    rows = entities.select(filled("name").alias("name"), s.alias("s"), primary_type(F.coalesce("entity_type", F.array().cast("array<string>"))).alias("type")).where("name is not null")
    votes = rows.groupBy("name").agg(
        F.count_if(F.coalesce(F.col("s") == "global", F.lit(False))).alias("n_global"), F.count_if(F.coalesce(F.col("s") == "local", F.lit(False))).alias("n_local"), F.max(F.col("type").isin("Event", "Occasion", "TimePoint")).alias("induced")
    )
    scope = F.when(F.col("induced"), "local").when(F.col("n_global") > F.col("n_local"), "global").when(F.col("n_local") > F.col("n_global"), "local").otherwise(tie_breaker)
    return votes.select("name", "n_global", "n_local", scope.alias("scope"))


def lexical_blocks(nodes: DataFrame, largest: int = 32) -> DataFrame:
    """Blocks of ids that share a normal form or an anchor word: ``block, id, size``; larger blocks tell nothing and are no candidates."""
    whole = F.concat(F.lit("n:"), surface(F.col("name")))
    words = F.filter(F.split(surface(F.col("name")), " "), lambda w: F.length(w) >= 5)
    keys = F.array_distinct(F.concat(F.array(whole), F.transform(words, lambda w: F.concat(F.lit("w:"), w))))
    rows = nodes.where("name is not null").select("id", F.explode(keys).alias("block")).where("block <> 'n:'")
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where(F.col("size").between(2, largest))
    return rows.join(sizes, "block")


def type_pairs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The predicates seen between each unordered pair of types: ``type_a, type_b, predicates, edges``."""
    types = nodes.select("id", F.explode("types").alias("type"))
    both = edges.join(types.select(F.col("id").alias("src"), F.col("type").alias("s")), "src").join(types.select(F.col("id").alias("dst"), F.col("type").alias("o")), "dst")
    rows = both.select(F.least("s", "o").alias("type_a"), F.greatest("s", "o").alias("type_b"), "predicate")
    return rows.groupBy("type_a", "type_b").agg(F.array_join(F.array_sort(F.collect_set("predicate")), "|").alias("predicates"), F.count(F.lit(1)).alias("edges"))


def validated(edges: DataFrame, nodes: DataFrame, domains: DataFrame) -> DataFrame:
    """Edges against ``predicate, from_type, to_type``: ``id, verdict, src, dst``.

    'ok', 'swapped' (only the reversed pair is allowed; ends come out swapped),
    'self_loop', 'unknown_type' (a predicate without a domain), 'missing_end' or
    'bad_types'.
    """
    types = F.broadcast(domains.groupBy("predicate").agg(F.collect_set(F.concat_ws(">", "from_type", "to_type")).alias("allowed")))
    ends = nodes.select("id", F.col("types"))
    rows = edges.select("id", "src", "dst", "predicate").join(types, "predicate", "left")
    rows = rows.join(ends.select(F.col("id").alias("src"), F.col("types").alias("s")), "src", "left").join(ends.select(F.col("id").alias("dst"), F.col("types").alias("o")), "dst", "left")
    pairs = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat_ws(">", x, y))))
    fits, turned = F.arrays_overlap(pairs(F.col("s"), F.col("o")), "allowed"), F.arrays_overlap(pairs(F.col("o"), F.col("s")), "allowed")
    verdict = (
        F.when(F.col("s").isNull() | F.col("o").isNull(), "missing_end").when(F.col("src") == F.col("dst"), "self_loop").when(F.col("allowed").isNull(), "unknown_type")
        .when(fits, "ok").when(turned, "swapped").otherwise("bad_types")
    )
    rows = rows.withColumn("verdict", verdict)
    swap = F.col("verdict") == "swapped"
    return rows.select("id", "verdict", F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("dst"))


def conflicts(edges: DataFrame, opposites: DataFrame) -> DataFrame:
    """Pairs of nodes with both of two opposite relations that last: ``a, b, predicates``."""
    rows = edges.where("persistence <> 'momentary' or persistence is null").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "predicate")
    either = opposites.select("x", "y").unionByName(opposites.select(F.col("y").alias("x"), F.col("x").alias("y")))
    kinds = rows.distinct()
    met = kinds.join(F.broadcast(either), kinds["predicate"] == either["x"]).select("a", "b", "predicate", F.col("y").alias("against"))
    return met.join(kinds.select("a", "b", F.col("predicate").alias("against")), ["a", "b", "against"], "left_semi").groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("predicate")), "|").alias("predicates"))


def latest_by(df: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """Last write wins."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in seq])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
