"""Communities, roll-ups along hierarchies and context texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import components
from loomgraph.session import cut_lineage


def rolled_down(parents: DataFrame, links: DataFrame, factor: float) -> DataFrame:
    """Scores handed from ``id, score`` to the children of ``parent, child``, lessened by ``factor``; a child keeps its best."""
    return parents.join(links, parents["id"] == links["parent"]).groupBy(F.col("child").alias("id")).agg(F.max(F.col("score") * factor).alias("score"))


def community_cards(edges: DataFrame, nodes: DataFrame, least: int = 2) -> DataFrame:
    """Connected components as communities: ``community, members, types, internal_edges``; the id is a digest of the first member."""
    labels = cut_lineage(components(edges, "src", "dst"), "communities")
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= least)
    inner = edges.where("src <> dst").join(labels.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("internal_edges"))
    types = labels.join(nodes.select(F.col("id").alias("node"), F.explode("types").alias("type")), "node").groupBy("component").agg(F.count_distinct("type").alias("types"))
    out = sizes.join(inner, "component", "left").join(types, "component", "left")
    return out.select(F.concat(F.lit("com_"), F.substring(F.md5("component"), 1, 12)).alias("community"), "members", F.coalesce("types", F.lit(0).cast("bigint")).alias("types"), F.coalesce("internal_edges", F.lit(0).cast("bigint")).alias("internal_edges"))


def relevant_or_best(rows: DataFrame, group: str, p: Column, score: Column, threshold: float) -> DataFrame:
    """Rows whose relevance ``p`` reaches ``threshold``, or the best one where none does; ordered by .55 p + .45 score."""
    w = Window.partitionBy(group)
    out = rows.withColumn("p", p).withColumn("final", F.round(0.55 * p + 0.45 * score, 6))
    out = out.withColumn("top_p", F.max("p").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("final"), "id")).cast("bigint"))
    return out.where((F.col("p") >= threshold) | ((F.col("top_p") < threshold) & (F.col("rank") == 1))).drop("top_p")


def within_budget(rows: DataFrame, group: str, order: list[str], text: str, most: int) -> DataFrame:
    """Whole texts of a group in order, as long as their characters add up to ``most`` at most."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(F.length(text)).over(w).cast("bigint")).where(F.col("used") <= most)
