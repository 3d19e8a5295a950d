"""Property-graph operators over ``nodes`` and ``edges`` (see ``loomgraph.sources.tables``).

Searches take a table of centres (``center``) and answer all of them at once;
ties are broken by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import cut_lineage


def either_way(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends: ``node, other, edge_id, predicate, confidence, direction``."""
    cols = ("id", "predicate", "confidence")
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *cols, F.lit("out").alias("direction"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), *cols, F.lit("in").alias("direction"))
    return out.unionByName(back).withColumnRenamed("id", "edge_id")


def with_label(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """Nodes that have any of the labels."""
    return nodes.where(F.arrays_overlap("types", F.array(*[F.lit(x) for x in labels])))


def stub_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints of edges that no node stands for: ``id``."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def related(centers: DataFrame, edges: DataFrame, nodes: DataFrame, predicates: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """Neighbours of each centre over edges of the ``predicates``, forward first: ``center, direction, edge_id, predicate, other, name``."""
    links = either_way(edges if predicates is None else edges.where(F.col("predicate").isin(predicates)))
    near = centers.join(links, centers["center"] == links["node"]).drop("node")
    found = nodes if labels is None else with_label(nodes, labels)
    return near.join(found.select(F.col("id").alias("other"), "name"), "other")


def common_neighbours(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours that both nodes of each pair ``a, b`` have: ``a, b, other``."""
    links = either_way(edges).select("node", "other").where("node <> other").distinct()
    left = pairs.join(links, pairs["a"] == links["node"]).drop("node")
    return left.join(links.select(F.col("node").alias("b"), "other"), ["b", "other"], "left_semi").select("a", "b", "other")


def induced_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both whose ends are among ``members`` (``id``)."""
    ids = members.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def in_same_sections(centers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that share a source document with each centre: ``center, document, other``; the grouping is by ``document``."""
    placed = nodes.select("id", F.explode("source_documents").alias("document"))
    of_center = placed.join(centers.withColumnRenamed("center", "id"), "id").select(F.col("id").alias("center"), "document")
    return of_center.join(placed.withColumnRenamed("id", "other"), "document").where("center <> other")


def first_in_groups(df: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group (a report's limit); the window keeps no more than that before it ranks."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= most)


def k_hop(centers: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Nodes within ``k`` undirected steps of each centre: ``center, node, depth``.

    A step joins the last frontier only, and nodes reached before are taken out,
    so each (centre, node) is walked from once.
    """
    links = either_way(edges).select("node", "other").where("node <> other").distinct()
    seen = frontier = cut_lineage(centers.select("center", F.col("center").alias("node"), F.lit(0).cast("bigint").alias("depth")).distinct(), "hop0")
    for step in range(1, k + 1):
        reached = frontier.select("center", "node").join(links, "node").select("center", F.col("other").alias("node")).distinct()
        frontier = cut_lineage(reached.join(seen.select("center", "node"), ["center", "node"], "left_anti").withColumn("depth", F.lit(step).cast("bigint")), f"hop{step}")
        seen = seen.unionByName(frontier.select("center", "node", "depth"))
    return seen


def simple_paths(pairs: DataFrame, edges: DataFrame, longest: int) -> DataFrame:
    """Simple undirected paths of at most ``longest`` edges between each pair ``a, b``: ``a, b, path``.

    Paths grow from both ends and meet in the middle, so neither side goes
    deeper than half of ``longest``.
    """
    links = either_way(edges).select("node", "other").where("node <> other").distinct()

    def grown(column: str, steps: int) -> list[DataFrame]:
        rows = pairs.select("a", "b", F.array(column).alias("path"), F.col(column).alias("end"))
        out = [rows]
        for _ in range(steps):
            rows = rows.join(links.withColumnRenamed("node", "end"), "end").where(~F.array_contains("path", F.col("other")))
            rows = rows.select("a", "b", F.concat("path", F.array("other")).alias("path"), F.col("other").alias("end"))
            out.append(rows)
        return out

    there, back = grown("a", (longest + 1) // 2), grown("b", longest // 2)
    found = []
    for length in range(1, longest + 1):
        x, y = there[(length + 1) // 2], back[length // 2]
        met = x.join(y.withColumnRenamed("path", "tail"), ["a", "b", "end"])
        met = met.where(F.size(F.array_intersect("path", "tail")) == 1)
        found.append(met.select("a", "b", F.concat("path", F.slice(F.reverse("tail"), 2, 100)).alias("path")))
    return reduce(DataFrame.unionByName, found).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, degree_in, degree_out, degree``, zeros included."""
    n = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    n = n.groupBy("id").agg(F.sum("i").alias("degree_in"), F.sum("o").alias("degree_out"))
    zero = F.lit(0).cast("bigint")
    out = nodes.select("id").join(n, "id", "left").select("id", F.coalesce("degree_in", zero).alias("degree_in"), F.coalesce("degree_out", zero).alias("degree_out"))
    return out.withColumn("degree", F.col("degree_in") + F.col("degree_out"))


def collapsed(edges: DataFrame) -> DataFrame:
    """One undirected edge a pair: ``a < b, edges, weight_max, weight_sum``."""
    rows = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "confidence")
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("edges"), F.max("confidence").alias("weight_max"), F.sum("confidence").alias("weight_sum"))


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """``id, rank`` after a fixed number of rounds on the undirected graph, weighted by confidence.

    The rank of nodes without edges is handed to all in equal shares.
    """
    pairs = collapsed(edges)
    links = pairs.select(F.col("a").alias("id"), F.col("b").alias("to"), F.col("weight_max").alias("w")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("to"), F.col("weight_max").alias("w")))
    links = links.join(nodes.select("id"), "id", "left_semi").join(nodes.select(F.col("id").alias("to")), "to", "left_semi")
    total = links.groupBy("id").agg(F.sum("w").alias("total"))
    links = cut_lineage(links.join(total, "id").select("id", "to", (F.col("w") / F.col("total")).alias("share")), "links")
    ids = cut_lineage(nodes.select("id").join(total.select("id", F.lit(True).alias("linked")), "id", "left"), "ids")
    n = ids.count()
    rank = ids.select("id", "linked", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(rounds):
        loose = rank.where("linked is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        given = links.join(rank.select("id", "rank"), "id").groupBy(F.col("to").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / max(n, 1))
        rank = cut_lineage(ids.join(given, "id", "left").join(F.broadcast(loose)).select("id", "linked", new.alias("rank")), "rank")
    return rank.select("id", "rank")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node connected to each; a few joins a round, in about log(diameter) rounds.

    Each round hands a node the smallest label of its neighbours, then the label
    of its label, until no label changes.
    """
    links = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    links = cut_lineage(links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    state = cut_lineage(links.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = links.join(state.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = state.join(near, "node").select("node", F.least("component", "near").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = cut_lineage(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        if new.join(state, ["node", "component"], "left_anti").isEmpty():
            return new
        state = new
