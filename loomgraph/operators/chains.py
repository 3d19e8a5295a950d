"""Causal edges, paths and chains (arrays of steps)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_edges(edges: DataFrame, type_weights: dict[str, float], default: float = 0.5) -> DataFrame:
    """The strongest edge of each ordered pair: ``src, dst, id, predicate, effective_weight, pool`` (ids of the others, strongest first)."""
    weight = F.lit(default)
    for t, w in type_weights.items():
        weight = F.when(F.col("predicate") == t, w).otherwise(weight)
    rows = edges.withColumn("effective_weight", F.round(F.col("confidence") * weight, 9))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("effective_weight")).alias("w"), "id", "predicate")))
    out = rows.groupBy("src", "dst").agg(ranked.alias("r"))
    top = F.col("r")[0]
    pool = F.array_join(F.transform(F.slice("r", 2, 1_000_000), lambda x: x["id"]), "|")
    return out.select("src", "dst", top["id"].alias("id"), top["predicate"].alias("predicate"), (-top["w"]).alias("effective_weight"), pool.alias("pool"))


def triangles(edges: DataFrame) -> DataFrame:
    """Every a→b, b→c, a→c of distinct edges ``src, dst, w``: ``a, b, c, kind``.

    'keep_strong' if the direct edge is at least as strong as both others,
    'redundant' if it is weaker than both, else 'unclear'.
    """
    e = edges.select("src", "dst", "w")
    ab = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("w_ab"))
    bc = e.select(F.col("src").alias("b"), F.col("dst").alias("c"), F.col("w").alias("w_bc"))
    ac = e.select(F.col("src").alias("a"), F.col("dst").alias("c"), F.col("w").alias("w_ac"))
    t = ab.join(bc, "b").join(ac, ["a", "c"]).where("a <> b and b <> c and a <> c")
    kind = F.when((F.col("w_ac") >= F.col("w_ab")) & (F.col("w_ac") >= F.col("w_bc")), "keep_strong").when((F.col("w_ac") < F.col("w_ab")) & (F.col("w_ac") < F.col("w_bc")), "redundant").otherwise("unclear")
    return t.select("a", "b", "c", kind.alias("kind"))


def slices(chain: Column, least: int) -> Column:
    """All contiguous parts of at least ``least`` steps."""
    n = F.size(chain)
    at = lambda i: F.when(n - i + 1 >= least, F.transform(F.sequence(F.lit(least), n - i + 1), lambda k: F.slice(chain, i, k))).otherwise(F.array().cast("array<array<string>>"))
    return F.when(n >= least, F.flatten(F.transform(F.sequence(F.lit(1), n), at))).otherwise(F.array().cast("array<array<string>>"))


def frequent_subchains(chains: DataFrame, least: int, count: int) -> DataFrame:
    """``subchain, chains``: contiguous parts that at least ``count`` of the ``id, chain`` have."""
    rows = chains.select("id", F.explode(F.array_distinct(F.transform(slices(F.col("chain"), least), lambda s: F.array_join(s, ">")))).alias("subchain"))
    return rows.groupBy("subchain").agg(F.count(F.lit(1)).alias("chains")).where(F.col("chains") >= count)


def trie_trunks(chains: DataFrame, least: int) -> DataFrame:
    """Trunks of the prefix tree of the distinct ``chain`` s: ``trunk, paths``.

    A trunk runs from the root to the first prefix at which the tree branches or
    a chain ends; shorter ones than ``least`` are left out.
    """
    rows = chains.select("chain").distinct().where(F.size("chain") > 0)
    prefixes = rows.select("chain", F.explode(F.sequence(F.lit(1), F.size("chain"))).alias("n"))
    prefixes = prefixes.select(F.slice("chain", 1, F.col("n")).alias("prefix"), F.get("chain", F.col("n")).alias("next"))
    at = prefixes.groupBy("prefix").agg(F.count_distinct("next").alias("children"), F.max(F.col("next").isNull()).alias("ends"), F.count(F.lit(1)).alias("paths"))
    cuts = at.where((F.col("children") >= 2) | F.col("ends")).select("prefix", "paths")
    first = cuts.select("prefix", "paths", F.col("prefix")[0].alias("root"), F.size("prefix").alias("n"))
    # the first cut on the way: no shorter cut is a prefix of it
    shorter = first.select("root", F.col("prefix").alias("up"), F.col("n").alias("up_n"))
    beaten = first.join(shorter, "root").where((F.col("up_n") < F.col("n")) & (F.slice("prefix", F.lit(1), F.col("up_n")) == F.col("up"))).select("prefix").distinct()
    return first.join(beaten, "prefix", "left_anti").where(F.col("n") >= least).select(F.array_join("prefix", ">").alias("trunk"), "paths")


def strict_subsets(sets: DataFrame) -> DataFrame:
    """The distinct ``members`` (sorted arrays) that are no strict subset of another.

    Only sets that share their rarest member are compared, which every superset
    of a set holds too.
    """
    rows = sets.select(F.array_sort(F.array_distinct("members")).alias("members")).distinct().where(F.size("members") > 0)
    each = rows.select("members", F.explode("members").alias("m"))
    often = each.groupBy("m").agg(F.count(F.lit(1)).alias("df"))
    rarest = each.join(often, "m").groupBy("members").agg(F.min(F.struct("df", "m"))["m"].alias("m"))
    within = rarest.join(each.withColumnRenamed("members", "larger"), "m").where((F.size("members") < F.size("larger")) & (F.size(F.array_except("members", "larger")) == 0))
    return rows.join(within.select("members").distinct(), "members", "left_anti")


def split_at(steps: DataFrame, chain: str, pos: str, cut: Column) -> DataFrame:
    """``part`` of each step of a chain: a new part begins at every step where ``cut`` holds."""
    w = Window.partitionBy(chain).orderBy(pos)
    return steps.withColumn("part", F.sum(F.coalesce(cut, F.lit(False)).cast("bigint")).over(w))
