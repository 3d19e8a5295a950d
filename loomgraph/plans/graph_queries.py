"""Queries of the property graph.  Searches take every hundredth entity record as a centre."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.plans.registry import query
from loomgraph.session import read_table
from loomgraph.sources.tables import GRAPH_SQL, edges, nodes, sections

CENTERS_SQL = GRAPH_SQL + ", centers AS (SELECT DISTINCT lower(trim(id)) center FROM entities WHERE record_id % 100 = 0 AND trim(id) <> '')"
LINKS_SQL = """, links AS (SELECT DISTINCT node, other FROM (SELECT src node, dst other FROM edges UNION ALL SELECT dst, src FROM edges) WHERE node <> other)"""
BOTH_SQL = """, both_ways AS (SELECT src node, dst other, id edge_id, predicate, confidence, 'out' direction FROM edges
  UNION ALL SELECT dst, src, id, predicate, confidence, 'in' FROM edges)"""


def centers(spark: SparkSession, sf_dir: str, every: int = 100) -> DataFrame:
    e = read_table(spark, sf_dir, "entities").where(F.col("record_id") % every == 0)
    return e.select(F.lower(F.trim("id")).alias("center")).where("center <> ''").distinct()


def joined(c: str, by: str = "|"):
    return F.array_join(c, by)


@query("graph_upsert_nodes", GRAPH_SQL + " SELECT id, name, description, scope, array_to_string(types, '|') types, array_to_string(aliases, '|') aliases, array_to_string(source_documents, '|') source_documents, records FROM nodes")
def graph_upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("id", "name", "description", "scope", joined("types").alias("types"), joined("aliases").alias("aliases"), joined("source_documents").alias("source_documents"), "records")


@query("graph_upsert_edges", GRAPH_SQL + " SELECT id, src, dst, predicate, persistence, confidence FROM edges")
def graph_upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("id", "src", "dst", "predicate", "persistence", "confidence")


@query("graph_stub_nodes", GRAPH_SQL + " SELECT id FROM (SELECT src id FROM edges UNION SELECT dst FROM edges) WHERE id NOT IN (SELECT id FROM nodes)")
def graph_stub_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.stub_nodes(nodes(spark, sf_dir), edges(spark, sf_dir))


@query("graph_stats", GRAPH_SQL + " SELECT (SELECT count(*) FROM nodes) nodes, (SELECT count(*) FROM edges) edges, (SELECT count(DISTINCT predicate) FROM edges) predicates")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("predicate").alias("predicates"))
    return nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("nodes")).join(e)


@query("label_counts", GRAPH_SQL + " SELECT u.label, count(*) nodes FROM nodes, unnest(types) AS u(label) GROUP BY 1")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select(F.explode("types").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))


@query("nodes_by_type_and_scope", GRAPH_SQL + " SELECT id, name FROM nodes WHERE list_contains(types, 'Character') AND scope = 'global'")
def nodes_by_type_and_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_label(nodes(spark, sf_dir), ["Character"]).where("scope = 'global'").select("id", "name")


@query("edges_by_type", GRAPH_SQL + " SELECT id, src, dst FROM edges WHERE predicate IN ('knows', 'opposes')")
def edges_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where(F.col("predicate").isin("knows", "opposes")).select("id", "src", "dst")


@query("graph_without_types", GRAPH_SQL + " SELECT n.id, count(e.id) edges FROM nodes n LEFT JOIN edges e ON e.src = n.id AND e.predicate NOT IN ('knows') GROUP BY 1")
def graph_without_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a type filtered out, isolated nodes kept."""
    kept = edges(spark, sf_dir).where("predicate <> 'knows'").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return nodes(spark, sf_dir).select("id").join(kept, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("bigint")).alias("edges"))


@query("search_entities", GRAPH_SQL + " SELECT id, name FROM nodes WHERE contains(lower(name), 'mar') OR len(list_filter(aliases, lambda a: contains(lower(a), 'mar'))) > 0")
def search_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with a text within their name or an alias."""
    q = "mar"
    return nodes(spark, sf_dir).where(F.contains(F.lower("name"), F.lit(q)) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(q)))).select("id", "name")


@query("relations_by_name", GRAPH_SQL + " SELECT e.id, s.name subject_name, o.name object_name FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes o ON o.id = e.dst WHERE s.name LIKE 'William %' OR o.name LIKE 'William %'")
def relations_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).select("id", "name")
    e = edges(spark, sf_dir).select("id", "src", "dst")
    both = e.join(n.select(F.col("id").alias("src"), F.col("name").alias("subject_name")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("object_name")), "dst")
    return both.where("subject_name like 'William %' or object_name like 'William %'").select("id", "subject_name", "object_name")


@query("related_entities", CENTERS_SQL + BOTH_SQL + " SELECT c.center, b.direction, b.edge_id, b.predicate, b.other, n.name FROM centers c JOIN both_ways b ON b.node = c.center JOIN nodes n ON n.id = b.other WHERE b.predicate IN ('knows', 'opposes', 'kinship_with') AND list_contains(n.types, 'Character')")
def related_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = G.related(centers(spark, sf_dir), edges(spark, sf_dir), nodes(spark, sf_dir), ["knows", "opposes", "kinship_with"], ["Character"])
    return r.select("center", "direction", "edge_id", "predicate", "other", "name")


_PAIRS_SQL = CENTERS_SQL + LINKS_SQL + """, ordered AS (SELECT center, lead(center) OVER (ORDER BY center) nxt FROM centers),
  pairs AS (SELECT center a, nxt b FROM ordered WHERE nxt IS NOT NULL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each centre with the next one (centres are a hundredth of the records)."""
    from pyspark.sql import Window

    nxt = F.lead("center").over(Window.orderBy("center"))
    return centers(spark, sf_dir).withColumn("b", nxt).where("b is not null").withColumnRenamed("center", "a")


@query("common_neighbors", _PAIRS_SQL + " SELECT p.a, p.b, x.other FROM pairs p JOIN links x ON x.node = p.a JOIN links y ON y.node = p.b AND y.other = x.other")
def common_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.common_neighbours(_pairs(spark, sf_dir), edges(spark, sf_dir))


@query("common_neighbors_with_relations", _PAIRS_SQL + BOTH_SQL + """ SELECT p.a, p.b, x.other, string_agg(DISTINCT x.predicate, '|' ORDER BY x.predicate) a_relations, string_agg(DISTINCT y.predicate, '|' ORDER BY y.predicate) b_relations
  FROM pairs p JOIN both_ways x ON x.node = p.a JOIN both_ways y ON y.node = p.b AND y.other = x.other WHERE x.other <> p.a AND x.other <> p.b GROUP BY ALL""")
def common_neighbors_with_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = G.either_way(edges(spark, sf_dir))
    kinds = links.groupBy("node", "other").agg(F.array_join(F.array_sort(F.collect_set("predicate")), "|").alias("kinds"))
    p = _pairs(spark, sf_dir)
    x = kinds.select(F.col("node").alias("a"), "other", F.col("kinds").alias("a_relations"))
    y = kinds.select(F.col("node").alias("b"), "other", F.col("kinds").alias("b_relations"))
    return p.join(x, "a").join(y, ["b", "other"]).where("other <> a and other <> b").select("a", "b", "other", "a_relations", "b_relations")


@query("induced_subgraph", GRAPH_SQL + ", m AS (SELECT id FROM nodes WHERE list_contains(types, 'Concept')) SELECT id, src, dst FROM edges WHERE src IN (SELECT id FROM m) AND dst IN (SELECT id FROM m)")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.induced_edges(G.with_label(nodes(spark, sf_dir), ["Concept"]), edges(spark, sf_dir)).select("id", "src", "dst")


_PLACED_SQL = ", placed AS (SELECT id, u.document FROM nodes, unnest(source_documents) AS u(document))"


@query("co_section_entities", CENTERS_SQL + _PLACED_SQL + " SELECT DISTINCT c.center, y.id other FROM centers c JOIN placed x ON x.id = c.center JOIN placed y ON y.document = x.document AND y.id <> x.id")
def co_section_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.in_same_sections(centers(spark, sf_dir), nodes(spark, sf_dir)).select("center", "other").distinct()


@query("co_section_grouped", CENTERS_SQL + _PLACED_SQL + """, near AS (SELECT c.center, x.document, y.id other, row_number() OVER (PARTITION BY c.center, x.document ORDER BY y.id) rank
  FROM centers c JOIN placed x ON x.id = c.center JOIN placed y ON y.document = x.document AND y.id <> x.id)
  SELECT n.center, n.document, s.title, n.other, n.rank FROM near n LEFT JOIN sections s ON s.id = n.document WHERE n.rank <= 5""")
def co_section_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five neighbours of a section, with the section's title."""
    near = G.first_in_groups(G.in_same_sections(centers(spark, sf_dir), nodes(spark, sf_dir)), ["center", "document"], [F.col("other")], 5)
    titles = sections(spark, sf_dir).select(F.col("id").alias("document"), "title")
    return near.join(titles, "document", "left").select("center", "document", "title", "other", "rank")


@query("relation_summary", GRAPH_SQL + " SELECT src, dst, predicate, min(id) first_id, count(*) relations, string_agg(coalesce(description, ''), ' / ' ORDER BY id) summary FROM edges GROUP BY 1, 2, 3")
def relation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("description", F.lit("")).alias("d")))), lambda x: x["d"])
    return edges(spark, sf_dir).groupBy("src", "dst", "predicate").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("relations"), F.array_join(texts, " / ").alias("summary"))


@query("section_records", GRAPH_SQL + """, refs AS (SELECT n.id, u.document, u.pos FROM nodes n, unnest(source_documents) WITH ORDINALITY AS u(document, pos))
  SELECT r.id, coalesce(s.title, '') title, coalesce(s.raw_id, '') raw_id, min(r.pos) first_pos, count(*) documents FROM refs r JOIN sections s ON s.id = r.document GROUP BY 1, 2, 3""")
def section_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections (title, story) an entity stands in, in order of first appearance."""
    refs = nodes(spark, sf_dir).select("id", F.posexplode("source_documents").alias("pos", "document"))
    s = sections(spark, sf_dir).select(F.col("id").alias("document"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("raw_id", F.lit("")).alias("raw_id"))
    return refs.join(s, "document").groupBy("id", "title", "raw_id").agg((F.min("pos") + 1).cast("bigint").alias("first_pos"), F.count(F.lit(1)).alias("documents"))


@query("section_contains_edges", GRAPH_SQL + ", placed AS (SELECT id, u.document FROM nodes, unnest(source_documents) AS u(document)) SELECT DISTINCT 'rel_' || substr(md5(s.raw_id || '||contains||' || p.id), 1, 12) AS edge_id, s.raw_id AS src, p.id AS dst FROM placed p JOIN sections s ON s.id = p.document WHERE s.raw_id IS NOT NULL")
def section_contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each story to the entities of its sections, with a stable id."""
    placed = nodes(spark, sf_dir).select(F.col("id").alias("dst"), F.explode("source_documents").alias("document"))
    s = sections(spark, sf_dir).where("raw_id is not null").select(F.col("id").alias("document"), F.col("raw_id").alias("src"))
    rows = placed.join(s, "document").select("src", "dst").distinct()
    return rows.withColumn("edge_id", F.concat(F.lit("rel_"), F.substring(F.md5(F.concat_ws("||", "src", F.lit("contains"), "dst")), 1, 12)))


@query("k_hop_subgraph", CENTERS_SQL + LINKS_SQL + """, hops AS (SELECT center, center node, 0 depth FROM centers UNION SELECT h.center, l.other, h.depth + 1 FROM hops h JOIN links l ON l.node = h.node WHERE h.depth < 2)
  SELECT center, node, min(depth)::BIGINT AS depth FROM hops GROUP BY 1, 2""")
def k_hop_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.k_hop(centers(spark, sf_dir), edges(spark, sf_dir), 2)


@query("simple_paths", _PAIRS_SQL + """, walks AS (SELECT a, b, [a] path, a AS tip FROM pairs UNION ALL SELECT w.a, w.b, list_append(w.path, l.other), l.other FROM walks w JOIN links l ON l.node = w.tip WHERE len(w.path) <= 3 AND w.tip <> w.b AND NOT list_contains(w.path, l.other))
  SELECT DISTINCT a, b, array_to_string(path, '>') AS path FROM walks WHERE tip = b AND len(path) > 1""")
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.simple_paths(_pairs(spark, sf_dir), edges(spark, sf_dir), 3)
    return p.select("a", "b", F.array_join("path", ">").alias("path"))


_DEGREE_SQL = GRAPH_SQL + """, ends AS (SELECT src id, 0 i, 1 o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges),
  degree AS (SELECT n.id, coalesce(sum(i), 0)::BIGINT degree_in, coalesce(sum(o), 0)::BIGINT degree_out, (coalesce(sum(i), 0) + coalesce(sum(o), 0))::BIGINT degree FROM nodes n LEFT JOIN ends e ON e.id = n.id GROUP BY 1)"""


@query("degree_centrality", _DEGREE_SQL + " SELECT * FROM degree")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(nodes(spark, sf_dir), edges(spark, sf_dir))


@query("degree_top", _DEGREE_SQL + " SELECT d.id, n.name, d.degree FROM degree d JOIN nodes n ON n.id = d.id WHERE list_contains(n.types, 'Character') ORDER BY d.degree DESC, d.id LIMIT 20")
def degree_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = G.with_label(nodes(spark, sf_dir), ["Character"])
    return G.degrees(n, edges(spark, sf_dir)).join(n.select("id", "name"), "id").orderBy(F.desc("degree"), "id").limit(20).select("id", "name", "degree")


@query("degree_above", _DEGREE_SQL + " SELECT id, degree FROM degree WHERE degree > 10")
def degree_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(nodes(spark, sf_dir), edges(spark, sf_dir)).where("degree > 10").select("id", "degree")


@query("centrality_summary", _DEGREE_SQL + """ SELECT count(*) nodes, min(degree) min, max(degree) max, round(avg(degree), 6) mean, quantile_cont(degree::DOUBLE, 0.5) median, round(stddev_pop(degree), 6) stdev,
  quantile_cont(degree::DOUBLE, 0.05) p5, quantile_cont(degree::DOUBLE, 0.25) p25, quantile_cont(degree::DOUBLE, 0.75) p75, quantile_cont(degree::DOUBLE, 0.95) p95 FROM degree""")
def centrality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, range, mean, population deviation and exact, interpolated percentiles."""
    p = lambda q: F.percentile(F.col("degree").cast("double"), F.lit(q))
    return G.degrees(nodes(spark, sf_dir), edges(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("nodes"), F.min("degree").alias("min"), F.max("degree").alias("max"), F.round(F.avg("degree"), 6).alias("mean"), p(0.5).alias("median"),
        F.round(F.stddev_pop("degree"), 6).alias("stdev"), p(0.05).alias("p5"), p(0.25).alias("p25"), p(0.75).alias("p75"), p(0.95).alias("p95"),
    )


_COLLAPSED_SQL = ", collapsed AS (SELECT least(src, dst) a, greatest(src, dst) b, count(*) edges, max(confidence) weight_max, sum(confidence) weight_sum FROM edges WHERE src <> dst GROUP BY 1, 2)"


@query("parallel_edge_collapse", GRAPH_SQL + _COLLAPSED_SQL + " SELECT a, b, edges, weight_max, round(weight_sum, 6) weight_sum FROM collapsed")
def parallel_edge_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.collapsed(edges(spark, sf_dir)).withColumn("weight_sum", F.round("weight_sum", 6))


def _rank_sql(rounds: int) -> str:
    sql = GRAPH_SQL + _COLLAPSED_SQL + """, w AS (SELECT a id, b "to", weight_max w FROM collapsed UNION ALL SELECT b, a, weight_max FROM collapsed),
      k AS (SELECT * FROM w WHERE id IN (SELECT id FROM nodes) AND "to" IN (SELECT id FROM nodes)),
      t AS (SELECT id, sum(w) total FROM k GROUP BY 1), share AS (SELECT k.id, k."to", k.w / t.total s FROM k JOIN t ON t.id = k.id),
      c AS (SELECT count(*)::DOUBLE n FROM nodes), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT n FROM c) AS rank FROM nodes)"""
    for i in range(rounds):
        sql += f""", l{i} AS (SELECT coalesce(sum(rank), 0) loose FROM r{i} WHERE id NOT IN (SELECT id FROM t)),
          g{i} AS (SELECT s."to" id, sum(r.rank * s.s) got FROM share s JOIN r{i} r ON r.id = s.id GROUP BY 1),
          r{i + 1} AS (SELECT n.id, 0.15::DOUBLE / (SELECT n FROM c) + 0.85::DOUBLE * (coalesce(g.got, 0) + (SELECT loose FROM l{i}) / (SELECT n FROM c)) AS rank FROM nodes n LEFT JOIN g{i} g ON g.id = n.id)"""
    return sql + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query("pagerank_fixed", _rank_sql(5))
def pagerank_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page_rank(nodes(spark, sf_dir), edges(spark, sf_dir), 5).withColumn("rank", F.round("rank", 9))


@query("connected_components", GRAPH_SQL + LINKS_SQL + """, reach AS (SELECT node, node seen FROM links UNION SELECT r.node, l.other FROM reach r JOIN links l ON l.node = r.seen)
  SELECT node, min(seen) component FROM reach GROUP BY 1""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(edges(spark, sf_dir), "src", "dst")


@query("sources_and_sinks", GRAPH_SQL + ", k AS (SELECT DISTINCT src, dst FROM edges WHERE predicate = 'initiates'), v AS (SELECT src id FROM k UNION SELECT dst FROM k) SELECT id, CASE WHEN id NOT IN (SELECT dst FROM k) THEN 'source' ELSE 'sink' END AS role FROM v WHERE id NOT IN (SELECT dst FROM k) OR id NOT IN (SELECT src FROM k)")
def sources_and_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = edges(spark, sf_dir).where("predicate = 'initiates'").select("src", "dst").distinct()
    outs, ins = k.select(F.col("src").alias("id")).distinct(), k.select(F.col("dst").alias("id")).distinct()
    return outs.join(ins, "id", "left_anti").withColumn("role", F.lit("source")).unionByName(ins.join(outs, "id", "left_anti").withColumn("role", F.lit("sink")))


@query("nodes_deleted_by_label", GRAPH_SQL + " SELECT e.id FROM edges e WHERE e.src NOT IN (SELECT id FROM nodes WHERE list_contains(types, 'Event')) AND e.dst NOT IN (SELECT id FROM nodes WHERE list_contains(types, 'Event'))")
def nodes_deleted_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges left when all nodes of a label are deleted."""
    gone = G.with_label(nodes(spark, sf_dir), ["Event"]).select("id")
    e = edges(spark, sf_dir)
    return e.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("id")
